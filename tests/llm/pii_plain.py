"""The pseudonym operator in plain Python, a text at a time: finding, choosing and permuting, for comparison."""

import datetime
from hashlib import sha256

import regex

from octoloom.llm import pii

START, WINDOW = regex.compile(pii.START), pii.WINDOW
FIRST = datetime.date.fromisoformat(pii.FIRST_DAY)


def luhn(number):
    d = [int(c) for c in number][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def only_digits(text):
    return regex.sub("[^0-9]", "", text)


def day_of(text):
    plain = regex.sub("[/.]", "-", text)
    for layout in ["%Y-%m-%d"] if regex.fullmatch(pii.ISO_DATE, text) else ["%d-%m-%Y", "%m-%d-%Y"]:
        try:
            day = (datetime.datetime.strptime(plain, layout).date() - FIRST).days
        except ValueError:
            continue
        return (day, layout) if 0 <= day < pii.DAYS else None
    return None


def valid(kind, text):
    number = only_digits(text)
    if not text:
        return False
    if kind == "iban":
        account = text.replace(" ", "")
        return 15 <= len(account) <= 34 and mod97(account) == 1
    if kind == "date":
        return day_of(text) is not None
    if kind == "ipv4":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "ssn":
        return not (regex.match("000|666|9", number) or number[3:5] == "00" or number.endswith("0000"))
    if kind == "phone":
        return 8 <= len(number) <= 15
    if kind == "card":
        return luhn(number) == 0 and text[0] != "0"
    return True


SHAPES = [
    ("email", pii.FIRM, [pii.EMAIL]),
    ("iban", pii.FIRM, [pii.IBAN, *pii.OTHER_IBANS]),
    ("date", pii.PLAIN, [pii.ISO_DATE, pii.DAY_DATE]),
    ("ipv4", pii.PLAIN, [pii.IPV4]),
    ("ssn", pii.PLAIN, [pii.SSN]),
    ("card", pii.FIRM, pii.PRINTED_CARDS),
    ("phone", pii.PHONES, [pii.PHONE, *[f"{pii.WORLD_PHONE}{{{n}}}" for n in pii.WORLD_GROUPS]]),
    ("card", pii.LOOSE, [pii.CARD]),
    ("card", pii.INNER, [rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1)]),
]
COMPILED = [
    (kind, rank, [regex.compile(f"(?:{s}){pii._MAIL_E if kind == 'email' else pii._E}") for s in shapes])
    for kind, rank, shapes in SHAPES
]


def listed(ahead):
    out = []
    for kind, rank, shapes in COMPILED:
        for shape in shapes:
            found = shape.match(ahead)
            value = found[0] if found else ""
            ok = valid(kind, value)
            if ok and rank == pii.INNER:
                ok = regex.fullmatch(pii.CARD_GROUPS, value) and regex.fullmatch(pii.ISSUED, only_digits(value))
            if ok:
                out.append((kind, value, rank))
    return out


def displaced(places, at, one):
    end = places[at][0] + len(one[1])
    for start, others in places[at + 1 :]:
        if start >= end:
            return False
        for _, value, rank in others:
            if rank < pii.LOOSE and (one[2] >= pii.LOOSE or rank == pii.FIRM or start + len(value) > end):
                return True
    return False


def find(text):
    """(start, kind, value) of the values that are replaced."""
    mail = regex.compile(pii.EMAIL + pii._MAIL_E)
    places = []
    for m in START.finditer(text):
        own = mail.match(text, m.start())
        places.append((m.start(), listed(own[0] if own else text[m.start() : m.start() + WINDOW])))
    kept = [
        (start, [c for c in cands if not (c[2] >= pii.PHONES and displaced(places, k, c))])
        for k, (start, cands) in enumerate(places)
    ]
    out, end = [], -2
    for start, cands in kept:
        led_up = regex.search("[0-9][ -]$", text[:start])
        free = [c for c in cands if c[2] != pii.LOOSE or not led_up or 0 <= start - end <= 1]
        if start >= end and free:
            out.append((start, free[0][0], free[0][1]))
            end = start + len(free[0][1])
    return out


def stream(key, *parts):
    return sha256("\x1f".join([key, *parts]).encode()).hexdigest()


def moved(part, hexes):
    out = []
    for at, c in enumerate(part):
        place = at % 31 * 2
        by = int(hexes[place : place + 4], 16)
        runs = [(48, 10), (97, 26), (65, 26), *pii.LETTER_RUNS]
        run = next(((a, n) for a, n in runs if a <= ord(c) < a + n), None)
        out.append(chr((ord(c) - run[0] + by) % run[1] + run[0]) if run else c)
    return "".join(out)


def chars(value, key, tweak):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for turn in range(pii.ROUNDS):
        left, right = right, moved(left, stream(key, tweak, str(turn), right.lower()))
    return left + right


def number_of(value, high, low, key, tweak):
    left, right = divmod(value, low)
    for turn in range(pii.ROUNDS):
        by = int(stream(key, tweak, str(turn), str(right))[:14], 16)
        left, right = right, (left + by) % (low if turn % 2 else high)
    return left * low + right


def refill(shape, new):
    new = iter(new)
    return "".join(next(new) if regex.match("[A-Za-z0-9]", c) else c for c in shape)


def pseudonym(kind, text, key):
    number, account = only_digits(text), text.replace(" ", "")
    if kind == "email":
        local, domain = text.split("@")
        return chars(local, key, f"email:{domain.lower()}") + "@" + domain
    if kind == "card":
        body = number[0] + chars(number[1:-1], key, f"card:{number[0]}:{len(number)}")
        return refill(text, body + str(-luhn(body + "0") % 10))
    if kind == "iban":
        body = chars(account[4:], key, f"iban:{account[:2]}")
        return refill(text, account[:2] + f"{98 - mod97(account[:2] + '00' + body):02d}" + body)
    if kind == "ssn":
        number = chars(number, key, kind)
        while not valid("ssn", number):
            number = chars(number, key, kind)
        return refill(text, number)
    if kind == "phone":
        nation = regex.match(pii.NATION, number)[0] if text[0] == "+" else ""
        return refill(text, nation + chars(number[len(nation) :], key, f"phone:{nation or pii.HOME}"))
    if kind == "ipv4":
        value = int.from_bytes(bytes(map(int, text.split("."))))
        return ".".join(map(str, number_of(value, 65_536, 65_536, key, kind).to_bytes(4)))
    day, layout = day_of(text)
    late = (FIRST + datetime.timedelta(day)).day > 12
    day = number_of(day, *pii.DAY_HALVES, key, kind)
    while day >= pii.DAYS or ((FIRST + datetime.timedelta(day)).day > 12) != late:
        day = number_of(day, *pii.DAY_HALVES, key, kind)
    return refill(text, (FIRST + datetime.timedelta(day)).strftime(layout.replace("-", "")))


def rewrite(text, key):
    """The new text, and (kind, pseudonym) of its values."""
    out, at, names = "", 0, []
    for start, kind, value in find(text):
        new = pseudonym(kind, value, key)
        names.append((kind, new))
        out, at = out + text[at:start] + new, start + len(value)
    return out + text[at:], names
