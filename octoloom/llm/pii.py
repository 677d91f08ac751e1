"""Format-preserving Feistel pseudonyms for personal data.  DataFrame functions only.

One expression finds every place where a candidate may begin: mail addresses, IBANs, dates, IPv4
addresses, US social security numbers, telephone numbers and card numbers.  At each place all shapes
and lengths are tried and validated (Luhn, mod 97, calendar, octets, number rules), and valid values
are chosen from left to right, so values next to each other do not hide each other; what is not
valid stays as it is.  A valid value is split from its punctuation and run
through a keyed balanced Feistel network whose round function is SHA-256 and whose addition is
character by character within digits or letters, or modulo the domain for dates and addresses.  So
every pseudonym has the value's length, character classes and punctuation, is valid again (check
digits are set anew; other rules are met by walking the permutation's cycle), and two values have
one pseudonym only if they are equal.  Equal values in any documents stay linked, whatever their
punctuation: a telephone number keeps its calling code and has the same rest with separators, without
and, at home, without the code; a date keeps to the days that can be read as a month or to those that
cannot, so it means one day in every writing.  Documents are never shuffled.

All shapes are of bounded length, a mail address as mail itself bounds it, and a round's stream is
hashed once, so the work grows with the text and not with its longest value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: For tests and the registered query; pass a secret of your own.
DEFAULT_KEY = "octoloom-demo-key"
ROUNDS = 8
#: Dates are permuted among these days.
FIRST_DAY, DAYS = "1900-01-01", 73_049
#: 270 * 271 is the next product above ``DAYS``.
DAY_HALVES = (270, 271)
#: Steps of a cycle walk; a walk this long has a chance below 10^-20.
WALK = 24
#: The same for dates, two fifths of which are of the first days of a month.
DAY_WALK = 96
#: Up to this day of the month a date's day may be read as a month.
MONTHS = 12

_B, _E = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
#: Letters and digits of any alphabet, with their marks.
_ANY = r"\p{L}\p{M}\p{N}"
_MAIL_B, _MAIL_E = rf"(?<![{_ANY}._%+-])", rf"(?![{_ANY}])"
#: Mail allows 64 characters before the @ and 63 a label; of more than 32 labels, the first ones count.
EMAIL = rf"[{_ANY}._%+-]{{1,64}}+@(?:[{_ANY}-]{{1,63}}\.){{1,31}}[\p{{L}}\p{{M}}]{{2,63}}"
IBAN_HEAD = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2}"
ISO_DATE = r"[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{2}"
DAY_DATE = r"[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
#: Number groups after the country code of a phone; the most that fit are tried first.
WORLD_GROUPS = (5, 4, 3, 2)
WORLD_PHONE = r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?)"
#: Cards as they are printed: in one piece, 4-4-4-4, 4-6-5, 4-6-4 and 4-4-4-4 with 1 to 3 more.
PRINTED_CARDS = (
    r"[1-9][0-9]{12,18}",
    r"[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3}",
    r"3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}",
    r"[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3}[ -]?[0-9]{1,3}",
)
#: Any 13 to 19 digits: tried where no digit leads up to it, and as far as it goes.
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: Inside longer runs of digits, cards in groups of three or more have to begin as an issuer's do.
CARD_GROUPS = r"[0-9]{3,}(?:[ -][0-9]{3,})*"
ISSUED = (
    r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12,17}"
    r"|(?:35|6[0245])[0-9]{14,17}|(?:50|5[6-9]|6[0-9])[0-9]{11,17}"
)
#: Lengths of account numbers by country (registry of ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Longest candidate other than a mail address, and the character after it.
WINDOW = 48


def _account(country: str, length: int) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{country})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


IBAN = "|".join(_account(codes.replace(" ", "|"), n) for n, codes in IBAN_LENGTHS.items())
_LISTED = " ".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: Countries without a known length: every end of a group, the longest first.
OTHER_IBANS = tuple(
    rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{k}}}{tail}"
    for k in range(7, 1, -1)
    for tail in (" ?[A-Z0-9]{1,3}", "")
)

_SHAPES = "|".join([IBAN_HEAD, ISO_DATE, DAY_DATE, IPV4, SSN, PHONE, WORLD_PHONE + "{2}", r"[0-9](?:[ -]?[0-9]){12}"])
#: Every place where a candidate may begin; of no width, so that candidates may overlap.
START = rf"(?:{_MAIL_B}(?={EMAIL}{_MAIL_E})|{_B}(?=[0-9A-Z(+])(?={_SHAPES}))"
_AHEAD = rf"(?s){START}(?=({EMAIL}{_MAIL_E}|.{{1,{WINDOW}}}))"
#: The same in texts without an @.
NUMBER_START = rf"{_B}(?=[0-9A-Z(+])(?={_SHAPES})"
_NUMBER_AHEAD = rf"(?s){NUMBER_START}(?=(.{{1,{WINDOW}}}))"


#: Calling codes (ITU-T E.164), none of which begins another: those of one and two digits; all others have three.
NATION = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: The nation of telephone numbers without a code.
HOME = "1"


def _is(text: Column, shape: str) -> Column:
    return text.rlike(rf"^(?:{shape})\z")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256)


#: (first code point, number of letters) of alphabets other than ASCII's; a letter moves within its run, small
#: and capital runs side by side.  Letters of further alphabets stay.
LETTER_RUNS = (
    (0xE0, 23), (0xF8, 7), (0xC0, 23), (0xD8, 7), (0x100, 128), (0x3B1, 17), (0x3C3, 7), (0x391, 17), (0x3A3, 7),
    (0x430, 32), (0x410, 32), (0x450, 16), (0x400, 16), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x905, 53),
    (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20_992), (0xAC00, 11_172),
)


def permute_chars(value: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the strings with this pattern of digits, small and capital letters.

    The round function reads the other half without case, so values that differ in case alone
    map to values that differ in case alone.  Other characters stay.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    runs = F.array([F.struct(F.lit(first).alias("first"), F.lit(size).alias("size")) for first, size in LETTER_RUNS])

    def move(c: Column, at: Column, stream: Column) -> Column:
        by = F.conv(F.substr(stream, F.pmod(at, F.lit(31)) * 2 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)

        def within(first: int, size: int) -> Column:
            return F.char(F.pmod(code - first + by, F.lit(size)) + first)

        def beyond(run: Column) -> Column:
            moved = F.pmod(code - run["first"] + by, run["size"]) + run["first"]
            return F.decode(F.unhex(F.lpad(F.hex(moved), 4, "0")), "UTF-16BE")

        own = F.filter(runs, lambda run: (code >= run["first"]) & (code < run["first"] + run["size"]))
        return (
            F.when(c.between("0", "9"), within(48, 10))
            .when(c.between("a", "z"), within(97, 26))
            .when(c.between("A", "Z"), within(65, 26))
            .when(c <= "\x7f", c)
            .otherwise(F.coalesce(F.get(F.transform(own, beyond), F.lit(0)), c))
        )

    def turn(s: Column, i: Column) -> Column:
        def shifted(stream: Column) -> Column:
            return F.array_join(F.transform(F.split(s["left"], ""), lambda c, at: move(c, at, stream)), "")

        # bound, so that the hash is taken once a round and not once a character
        moved = _once(_hash(key, tweak, i.cast("string"), F.lower(s["right"])), shifted)
        return F.struct(s["right"].alias("left"), moved.alias("right"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("left"), F.substr(value, half + 1).alias("right"))
    steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))  # an even number, after which the halves stand as they did
    return F.aggregate(steps, start, turn, lambda s: F.concat(s["left"], s["right"]))


def permute_number(value: Column, high: Column, low: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the whole numbers below ``high * low``."""

    def turn(s: Column, i: Column) -> Column:
        stream = _hash(key, tweak, i.cast("string"), s["right"].cast("string"))
        size = F.when(i % 2 == 0, high).otherwise(low)
        moved = F.pmod(s["left"] + F.conv(F.substring(stream, 1, 14), 16, 10).cast("long"), size)
        return F.struct(s["right"].alias("left"), moved.cast("long").alias("right"))

    start = F.struct(
        F.floor(value / low).cast("long").alias("left"), F.pmod(value.cast("long"), low).cast("long").alias("right")
    )
    steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, start, turn, lambda s: s["left"] * low + s["right"])


def _walk(value: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column], most: int = WALK) -> Column:
    """``step`` at least once and on until valid: a permutation of the valid values."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)), value, lambda v, i: F.when((i == 1) | ~valid(v), step(v)).otherwise(v)
    )


def luhn_sum(number: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10


def _mod97(account: Column) -> Column:
    """Remainder of country, check digits and account, rearranged as ISO 13616 has it."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97,
    )


def _ssn_valid(d: Column) -> Column:
    return ~(d.rlike("^(?:000|666|9)") | d.rlike("^...00") | d.rlike("0000$"))


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda x: x.cast("int"))


def _day(text: Column) -> Column:
    """The date that a candidate of a date's shape means: day before month where both are possible."""
    plain = F.regexp_replace(text, "[/.]", "-")
    iso = F.try_to_date(plain, "yyyy-MM-dd")
    other = F.coalesce(F.try_to_date(plain, "dd-MM-yyyy"), F.try_to_date(plain, "MM-dd-yyyy"))
    day = F.when(_is(text, ISO_DATE), iso).otherwise(other)
    past = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when((past >= 0) & (past < DAYS), past)


def _valid(kind: Column, text: Column) -> Column:
    """Whether a candidate of a kind's shape is one of its values."""
    account = F.regexp_replace(text, " ", "")
    number = digits(text)
    return (
        F.when(text == "", False)
        .when(kind == "email", True)
        .when(kind == "iban", F.length(account).between(15, 34) & (_mod97(account) == 1))
        .when(kind == "date", _day(text).isNotNull())
        .when(kind == "ipv4", ~F.exists(_octets(text), lambda x: x > 255))
        .when(kind == "ssn", _ssn_valid(number))
        .when(kind == "phone", F.length(number).between(8, 15))
        .otherwise((luhn_sum(number) == 0) & ~text.startswith("0"))
    )


#: Of two candidates that overlap: no other displaces ``FIRM`` ones; ``PHONES`` give way to firm ones
#: inside and to what they would cut; ``LOOSE`` cards give way to all others.  ``INNER`` are loose too.
FIRM, PHONES, LOOSE, INNER = 0, 2, 3, 4
#: Kinds that are no reason to give a phone up unless it would cut them.
PLAIN = 1


def candidates(ahead: Column) -> Column:
    """Valid (kind, value, rank) that begin where ``ahead`` does, the preferred first."""

    def listed(kind: str, rank: int, *shapes: str) -> list[Column]:
        end = _MAIL_E if kind == "email" else _E
        return [
            F.struct(
                F.lit(kind).alias("kind"),
                F.regexp_extract(ahead, f"^(?:{shape}){end}", 0).alias("value"),
                F.lit(rank).alias("rank"),
            )
            for shape in shapes
        ]

    none = F.array().cast("array<struct<kind:string,value:string,rank:int>>")

    def where(test: Column, *rows: Column) -> Column:
        return F.when(test, F.array(*rows)).otherwise(none)

    by_digits = [rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1)]
    shaped = F.concat(
        where(ahead.contains("@"), *listed("email", FIRM, EMAIL)),
        where(ahead.rlike("^[A-Z]{2}[0-9]{2}"), *listed("iban", FIRM, IBAN, *OTHER_IBANS)),
        where(
            ahead.rlike("^[0-9]"),
            *listed("date", PLAIN, ISO_DATE, DAY_DATE),
            *listed("ipv4", PLAIN, IPV4),
            *listed("ssn", PLAIN, SSN),
        ),
        where(ahead.rlike("^[0-9](?:[ -]?[0-9]){12}"), *listed("card", FIRM, *PRINTED_CARDS)),
        where(
            ahead.rlike("^[0-9(+]"),
            *listed("phone", PHONES, PHONE, *[f"{WORLD_PHONE}{{{n}}}" for n in WORLD_GROUPS]),
        ),
        where(
            ahead.rlike("^[0-9](?:[ -]?[0-9]){12}"),
            *listed("card", LOOSE, CARD),
            *listed("card", INNER, *by_digits),
        ),
    )
    return F.filter(
        shaped,
        lambda s: _valid(s["kind"], s["value"])
        & ((s["rank"] != INNER) | (_is(s["value"], CARD_GROUPS) & _is(digits(s["value"]), ISSUED))),
    )


def _displaced(places: Column, place: Column, at: Column, one: Column) -> Column:
    """Whether a better candidate begins inside ``one``, which begins at the place of index ``at``."""
    size = F.length(one["value"])

    def beats(other: Column, offset: Column) -> Column:
        cut_off = offset + F.length(other["value"]) > size
        return (other["rank"] < LOOSE) & ((one["rank"] >= LOOSE) | (other["rank"] == FIRM) | cut_off)

    def step(s: Column, p: Column) -> Column:
        inside = (s["offset"] < size) & F.exists(p["list"], lambda other: beats(other, s["offset"]))
        return F.struct((s["offset"] + p["size"]).alias("offset"), (s["hit"] | inside).alias("hit"))

    start = F.struct(place["size"].alias("offset"), F.lit(False).alias("hit"))
    return F.aggregate(F.slice(places, at + 2, F.lit(WINDOW)), start, step, lambda s: s["hit"])


#: Places that one step of the choice takes, so that lists grow by runs and not by values.
RUN = 256


def _choose(places: Column) -> Column:
    """(piece, kind, value) from left to right, no two of which overlap.

    The first candidate of a place that is not displaced is taken.  Loose cards are taken only
    where digits do not lead up to them, or where those belong to the value before.
    """
    none = F.array().cast("array<struct<piece:int,kind:string,value:string>>")

    def state(at: Column, end: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), end.alias("end"), out.alias("out"))

    def step(s: Column, p: Column) -> Column:
        free = F.filter(
            p["list"], lambda c: (c["rank"] != LOOSE) | ~p["led_up"] | ((s["at"] - s["end"]).between(0, 1))
        )
        first = F.when(s["at"] >= s["end"], F.get(free, F.lit(0)))
        taken = first.isNotNull()
        row = F.struct(p["piece"].alias("piece"), first["kind"].alias("kind"), first["value"].alias("value"))
        return state(
            s["at"] + p["size"],
            F.when(taken, s["at"] + F.length(first["value"])).otherwise(s["end"]),
            F.when(taken, F.concat(s["out"], F.array(row))).otherwise(s["out"]),
        )

    def run(s: Column, first: Column) -> Column:
        inner = F.aggregate(F.slice(places, first, F.lit(RUN)), state(s["at"], s["end"], none), step)
        return _once(inner, lambda i: state(i["at"], i["end"], F.concat(s["out"], F.array(i["out"]))))

    runs = F.filter(F.sequence(F.lit(1), F.size(places) + 1, F.lit(RUN)), lambda first: first <= F.size(places))
    start = state(F.lit(0), F.lit(-2), F.array().cast("array<array<struct<piece:int,kind:string,value:string>>>"))
    return F.aggregate(runs, start, run, lambda s: F.flatten(s["out"]))


def _refill(shape: Column, chars: Column) -> Column:
    """``shape`` with its letters and digits replaced, in order, by ``chars``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        own = c.rlike("[A-Za-z0-9]")
        return F.struct(
            F.concat(s["out"], F.when(own, F.substr(chars, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + own.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def pseudonym(text: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value: one permutation of characters or of a number, in the kind's own form."""
    number, account = digits(text), F.regexp_replace(text, " ", "")
    head, country = F.substring(number, 1, 1), F.substring(account, 1, 2)
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    abroad = text.startswith("+")
    nation = F.when(abroad, F.regexp_extract(number, f"^(?:{NATION})", 0)).otherwise(F.lit(""))
    moving = (
        F.when(kind == "card", F.substr(number, F.lit(2), F.length(number) - 2))
        .when(kind == "email", local)
        .when(kind == "iban", F.substr(account, F.lit(5)))
        .when(kind == "ssn", number)
        .otherwise(F.substr(number, F.length(nation) + 1))
    )
    tweak = (
        F.when(kind == "card", F.concat_ws(":", F.lit("card"), head, F.length(number)))
        .when(kind == "email", F.concat(F.lit("email:"), F.lower(domain)))
        .when(kind == "iban", F.concat(F.lit("iban:"), country))
        .when(kind == "phone", F.concat(F.lit("phone:"), F.when(abroad, nation).otherwise(HOME)))
        .otherwise(kind)
    )
    chars = _walk(moving, lambda v: permute_chars(v, key, tweak), lambda v: (kind != "ssn") | _ssn_valid(v))

    def written(body: Column) -> Column:
        unchecked = F.concat(head, body, F.lit("0"))
        card = F.concat(head, body, F.pmod(-luhn_sum(unchecked), F.lit(10)).cast("string"))
        left = _mod97(F.concat(country, F.lit("00"), body))
        iban = F.concat(country, F.lpad((F.lit(98) - left).cast("string"), 2, "0"), body)
        plain = F.when(kind == "card", card).when(kind == "iban", iban).when(kind == "ssn", body)
        return F.when(kind == "email", F.concat(body, F.lit("@"), domain)).otherwise(
            _refill(text, plain.otherwise(F.concat(nation, body)))
        )

    dated = kind == "date"
    address = F.aggregate(_octets(text), F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    value = F.when(dated, _day(text).cast("long")).otherwise(address)
    high, low = (F.when(dated, F.lit(d)).otherwise(F.lit(65_536)).cast("long") for d in DAY_HALVES)

    def date_of(v: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(v, F.lit(DAYS)).cast("int"))

    def late(v: Column) -> Column:
        return F.dayofmonth(date_of(v)) > MONTHS

    # a day that cannot be a month stays one that cannot, so a date reads alike in the writing of its own
    moved = _once(
        F.struct(value.alias("value"), late(value).alias("late")),
        lambda own: _walk(
            own["value"],
            lambda v: permute_number(v, high, low, key, kind),
            lambda v: ~dated | ((v < DAYS) & (late(v) == own["late"])),
            DAY_WALK,
        ),
    )

    def shown(v: Column) -> Column:
        ipv4 = F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
        day = date_of(v)
        plain = F.regexp_replace(text, "[/.]", "-")
        layout = (
            F.when(_is(text, ISO_DATE), F.date_format(day, "yyyyMMdd"))
            .when(F.try_to_date(plain, "dd-MM-yyyy").isNotNull(), F.date_format(day, "ddMMyyyy"))
            .otherwise(F.date_format(day, "MMddyyyy"))
        )
        return F.when(dated, _refill(text, layout)).otherwise(ipv4)

    return F.when(kind.isin("date", "ipv4"), _once(moved, shown)).otherwise(_once(chars, written))


def with_pseudonyms(
    docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", name: str = "pseudonyms"
) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and the array ``name`` of (kind, pseudonym) in text order.

    Null texts stay null, with an empty array; empty texts and texts without valid values stay as
    they are.  Texts are read whole, and very long texts and tokens take time in proportion: a run of
    more than 64 characters before an @ is no mail address, and of one with more than 32 labels the
    first ones count, if they end as an address may.  Ties: of candidates that begin at one place, the first of ``candidates`` wins,
    and of places that overlap the left one, unless displaced.  Repeated rows and repeated values get
    equal pseudonyms.  An empty table gives no rows.  Other columns are passed on untouched, whatever
    their names; where ``docs`` has a column ``name``, the array's name gets underscores.
    """
    found, gaps, spots = fresh(docs, "found"), fresh(docs, "gaps"), fresh(docs, "spots")
    text = F.col(text_col)
    led = F.concat(F.lit("\n"), text)  # nothing begins at its first character, so piece 0 is never a candidate
    none = F.array().cast("array<string>")
    mail, numbers = text.contains("@"), text.rlike("[0-9]")
    pieces_of = F.when(mail, F.split(led, START, -1)).when(numbers, F.split(led, NUMBER_START, -1)).otherwise(none)
    out = docs.withColumn(gaps, F.coalesce(pieces_of, none))
    some = F.size(F.col(gaps)) > 1
    ahead = F.when(mail, F.regexp_extract_all(led, F.lit(_AHEAD), F.lit(1))).otherwise(
        F.regexp_extract_all(led, F.lit(_NUMBER_AHEAD), F.lit(1))
    )
    out = out.withColumn(spots, F.when(some, ahead).otherwise(none))
    pieces = F.col(gaps)
    out = out.withColumn(
        spots,
        F.transform(
            F.col(spots),
            lambda ahead, i: F.struct(
                (i + 1).alias("piece"),
                F.length(F.get(pieces, i + 1)).alias("size"),
                F.get(pieces, i).rlike(r"[0-9][ -]\z").alias("led_up"),
                candidates(ahead).alias("list"),
            ),
        ),
    )
    places = F.col(spots)
    out = out.withColumn(
        spots,
        F.transform(
            places,
            lambda p, i: p.withField(
                "list", F.filter(p["list"], lambda c: ~((c["rank"] >= PHONES) & _displaced(places, p, i, c)))
            ),
        ),
    )
    out = out.withColumn(
        found,
        F.transform(
            _choose(places),
            lambda s: F.struct(
                s["piece"], s["kind"], s["value"], pseudonym(s["value"], s["kind"], key).alias("pseudonym")
            ),
        ),
    )
    valid = F.col(found)

    def joined(first: Column, end: Column) -> Column:
        return F.array_join(F.slice(pieces, first + 1, end - first), "")

    rewritten = F.transform(
        valid,
        lambda s, k: F.concat(
            s["pseudonym"],
            F.substr(
                joined(s["piece"], F.coalesce(F.get(valid, k + 1)["piece"], F.size(pieces))), F.length(s["value"]) + 1
            ),
        ),
    )
    head = F.substr(joined(F.lit(0), F.get(valid, F.lit(0))["piece"]), F.lit(2))
    rebuilt = F.when(F.size(valid) > 0, F.concat(head, F.array_join(rewritten, ""))).otherwise(text)
    listed = F.transform(valid, lambda s: F.struct(s["kind"].alias("kind"), s["pseudonym"].alias("pseudonym")))
    columns = [rebuilt.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, listed.alias(fresh(docs, name)))
