"""Pseudonyms: permutations of their formats, valid, linked, and complete."""

import random
import re
import time

import pii_plain
import pytest
from pyspark.sql import functions as F

from octoloom.llm import pii, registry

KEY = "test-key"


def luhn(number):
    d = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def rewrite(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.with_pseudonyms(df, KEY).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [[(p["kind"], p["pseudonym"]) for p in r["pseudonyms"]] for r in rows]


def shape(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", re.sub(r"[^\x00-\x7f]", "\u00e9", text))))


VALID = {
    "email": ["bo.42@mail8.example.com", "Ann_B@x.org", "jos\u00e9@x.org", "user@m\u00fcnchen.de", "\u0438\u0432\u0430\u043d@x.org", "\u738b\u5c0f@x.org"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "date": ["1980-02-29", "29.02.1980", "12/31/1999"],
    "ipv4": ["42.144.35.254", "0.0.0.1"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (988) 555-2485", "212-555-0187", "+44 20 7946 0958"],
    "card": ["4111111111111111", "3782 822463 10005", "5500-0000-0000-0004"],
}


@pytest.mark.parametrize("kind", VALID)
def test_valid_values_change_within_their_format(spark, kind):
    values = VALID[kind]
    texts, found = rewrite(spark, [f"see {v}, then" for v in values])
    for value, text, names in zip(values, texts, found, strict=True):
        new = text.removeprefix("see ").removesuffix(", then")
        assert names == [(kind, new)] and new != value
        if kind != "ipv4":
            assert shape(new) == shape(value)
    again, found_again = rewrite(spark, [n[0][1] for n in found])
    assert [n[0][0] for n in found_again] == [kind] * len(values)  # pseudonyms are valid themselves


NEIGHBOURS = {
    "4111 1111 1111 1111 12/27": ["card:4111 1111 1111 1111"],
    "4111 1111 1111 1111 123": ["card:4111 1111 1111 1111"],
    "2 4111111111111111": ["card:4111111111111111"],
    "1235 4111 1111 1111 1111": ["card:4111 1111 1111 1111"],
    "3782 822463 10005 4111-1111-1111-1111": ["card:3782 822463 10005", "card:4111-1111-1111-1111"],
    "12 41111 11111 111111 27": ["card:41111 11111 111111"],
    "212-555-0187 212-555-0188": ["phone:212-555-0187", "phone:212-555-0188"],
    "212-555-0187 2024-01-15": ["phone:212-555-0187", "date:2024-01-15"],
    "2024-01-15 212-555-0187": ["date:2024-01-15", "phone:212-555-0187"],
    "123-45-6789 4111111111111111": ["ssn:123-45-6789", "card:4111111111111111"],
    "+44 20 7946 0958 2024-01-15": ["phone:+44 20 7946 0958", "date:2024-01-15"],
    "+44 20 7946 0958 212-555-0188": ["phone:+44 20 7946 0958", "phone:212-555-0188"],
    "AT61 1904 3002 3457 3201 BIC": ["iban:AT61 1904 3002 3457 3201"],
    "GB82WEST12345698765432 DE89 3704 0044 0532 0130 00": ["iban:GB82WEST12345698765432", "iban:DE89 3704 0044 0532 0130 00"],
    "AT61 1904 3002 3457 3201 4111111111111111 bo@x.org": ["iban:AT61 1904 3002 3457 3201", "card:4111111111111111", "email:bo@x.org"],
    "10.0.0.1 4111111111111111": ["ipv4:10.0.0.1", "card:4111111111111111"],
}


def test_values_next_to_each_other_are_all_found(spark):
    texts = [f"{before}{t}{after}" for t in NEIGHBOURS for before, after in (("", ""), ("\u00e9 see ", ", then"))]
    got, found = rewrite(spark, texts)
    for text, new, names, wanted in zip(texts, got, found, [w for w in NEIGHBOURS.values() for _ in (0, 1)], strict=True):
        assert [k for k, _ in names] == [w.split(":", 1)[0] for w in wanted], text
        expected, at = "", 0
        for (_, name), value in zip(names, [w.split(":", 1)[1] for w in wanted], strict=True):
            place = text.index(value, at)
            assert name != value
            expected, at = expected + text[at:place] + name, place + len(value)
        assert new == expected + text[at:]


def test_invalid_values_stay(spark):
    texts = [
        "card 4111111111111112", "ip 300.1.1.1", "date 2021-02-29 or 1750-01-01", "ssn 000-12-3456", "iban DE88370400440532013000",
        "version 2.0.", "id 12345", "x" * 50, "a@b", "1-2-3",
    ]
    got, found = rewrite(spark, texts)
    assert got == texts and not any(found)


def test_equal_values_are_linked_whatever_their_punctuation(spark):
    got, _ = rewrite(spark, ["4111111111111111", "4111-1111 1111-1111", "(988) 555-2485", "988.555.2485", "1980-02-29", "29/02/1980", "A.B@x.org", "a.b@x.org"])
    assert re.sub(r"\D", "", got[0]) == re.sub(r"\D", "", got[1])
    assert re.sub(r"\D", "", got[2]) == re.sub(r"\D", "", got[3])
    year, month, day = got[4].split("-")
    assert got[5] == f"{day}/{month}/{year}"
    assert got[6].lower() == got[7] and luhn(got[0]) % 10 == 0


def test_characters_are_permuted(spark):
    """No two of all strings of a format meet."""
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert numbers.select(pii.permute_chars(F.col("v"), KEY, F.lit("t")).alias("p")).distinct().count() == 1000
    letters = spark.range(26 * 260).select(F.concat(F.char((F.col("id") % 26 + 97).cast("int")), F.lit("-"), (F.col("id") / 26).cast("int") % 10, F.char((F.col("id") / 260).cast("int") + 65)).alias("v"))
    moved = letters.select(pii.permute_chars(F.col("v"), KEY, F.lit("t")).alias("p"))
    assert moved.distinct().count() == letters.distinct().count() == moved.where("p rlike '^[a-z]-[0-9][A-Z]$'").count()


@pytest.mark.parametrize("halves", [(7, 11), (270, 271)])
def test_numbers_are_permuted(spark, halves):
    n = halves[0] * halves[1]
    got = spark.range(n).select(pii.permute_number(F.col("id"), *[F.lit(h).cast("long") for h in halves], KEY, F.lit("t")).alias("p"))
    assert got.distinct().count() == n and tuple(got.agg(F.min("p"), F.max("p")).first()) == (0, n - 1)


def test_another_key_gives_other_pseudonyms(spark):
    df = spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string")
    one, two = (pii.with_pseudonyms(df, k).first()["text"] for k in ("a", "b"))
    assert one != two


PLANTED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\w)|(?<!\w)\d{1,3}(?:\.\d{1,3}){3}(?!\w)"
)


def test_query_leaves_no_planted_value_and_changes_nothing_else(spark, small):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    n = 0
    for r in registry.op10_pii_pseudonyms(spark, small).collect():
        old = before[r["doc_id"]]
        for value in PLANTED.findall(old):
            if not value.isdigit() or luhn(value) % 10 == 0:
                assert value not in r["text"]
                n += 1
        assert PLANTED.sub("#", old) == PLANTED.sub("#", r["text"])
        assert r["n_pseudonyms"] == len([k for k in r["kinds"].split(",") if k])
    assert n > 20


def test_main_path_runs_no_python(spark, small):
    plan = registry.op10_pii_pseudonyms(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_the_plain_version(spark, small):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in registry.op10_pii_pseudonyms(spark, small).collect():
        text, names = pii_plain.rewrite(before[r["doc_id"]], pii.DEFAULT_KEY)
        assert (r["text"], r["kinds"]) == (text, ",".join(k for k, _ in names))


def test_mixed_values_equal_the_plain_version(spark):
    """Values of all kinds, whole, cut and run together."""
    chance = random.Random(5)
    values = [v for vs in VALID.values() for v in vs] + list(NEIGHBOURS)
    glue = [" ", ", ", "-", "", " x ", "\n", " 7 ", ".", "\u00e9"]
    texts = []
    for _ in range(400):
        parts = [chance.choice(values) for _ in range(chance.randint(1, 5))]
        parts = [p if chance.random() < 0.7 else p[chance.randint(0, 3) : len(p) - chance.randint(0, 3)] for p in parts]
        texts.append("".join(p + chance.choice(glue) for p in parts))
    got, found = rewrite(spark, texts)
    for text, new, names in zip(texts, got, found, strict=True):
        assert (new, names) == pii_plain.rewrite(text, KEY), text


HOSTILE = {
    "labels": "x@" + "ab." * 20_000 + "com",
    "short labels": "x@" + "a." * 20_000 + "com",
    "local part": "q" * 300_000 + "@x.org",
    "digits": "4111111111111111" * 20_000,
    "spaced digits": "4 1 1 " * 10_000,
    "marks": "@" * 100_000 + "." * 100_000 + "a@" * 50_000,
    "addresses": "bo.42@mail8.example.com " * 10_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_end_soon(spark, name):
    text = HOSTILE[name]
    began = time.monotonic()
    (new,), (names,) = rewrite(spark, [text])
    assert time.monotonic() - began < 60
    assert len(new) == len(text)
    if name == "labels":
        assert [k for k, _ in names] == ["email"] and new[0] != "x" and new[1:] == text[1:]
    if name == "addresses":
        assert len(names) == 10_000 and "bo.42@" not in new and len(set(names)) == 1
    if name in ("short labels", "local part", "digits", "marks"):
        assert new == text and not names


def test_letters_of_other_alphabets_are_permuted(spark):
    for first, size in pii.LETTER_RUNS[:-2]:
        two = spark.range(size).select(F.concat(F.lit(chr(first)), F.decode(F.unhex(F.lpad(F.hex(F.col("id") + first), 4, "0")), "UTF-16BE")).alias("v"))
        moved = two.select(pii.permute_chars(F.col("v"), KEY, F.lit("t")).alias("p")).collect()
        assert len({r["p"] for r in moved}) == size
        assert all(first <= ord(c) < first + size for r in moved for c in r["p"])


def test_every_day_in_every_writing_has_a_pseudonym_of_its_own(spark):
    """All days, written year first, day first and (where it can only be) month first; each text tells its day again."""
    import datetime

    days = [pii_plain.FIRST + datetime.timedelta(k) for k in range(pii.DAYS)]
    written = [d.strftime(w) for d in days for w in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y") if w[1] != "m" or d.day > 12]
    names = [pii_plain.pseudonym("date", t, "k") for t in written]
    assert len(set(written)) == len(set(names)) == len(written)
    of = dict(zip(written, names, strict=True))
    means = {t: pii_plain.day_of(t)[0] for t in names}
    for d in days[::97]:
        forms = [d.strftime("%Y-%m-%d"), d.strftime("%d/%m/%Y"), *([d.strftime("%m/%d/%Y")] if d.day > 12 else [])]
        assert len({means[of[f]] for f in forms}) == 1
    some = written[::41]
    frame = spark.createDataFrame([(t,) for t in some], "t string")
    got = [r[0] for r in frame.select(pii.pseudonym(F.col("t"), F.lit("date"), "k")).collect()]
    assert got == [of[t] for t in some]


def test_phones_are_linked_with_and_without_separators(spark):
    same = [
        ["+44 20 7183 8750", "+442071838750", "+44-20-7183-8750"],
        ["212-555-0187", "+12125550187", "(212) 555-0187", "+1 212 555 0187", "212.555.0187"],
        ["+49 30 901820", "+4930901820"],
        ["+353 1 679 9700", "+35316799700"],
    ]
    frame = spark.createDataFrame([(g, t) for g, texts in enumerate(same) for t in texts], "g int, t string")
    rows = frame.select("g", "t", pii.pseudonym(F.col("t"), F.lit("phone"), "k").alias("p")).collect()
    codes = ["44", "1", "49", "353"]
    for r in rows:
        assert r["p"] == pii_plain.pseudonym("phone", r["t"], "k") and r["p"] != r["t"]
        assert not r["t"].startswith("+") or pii_plain.only_digits(r["p"]).startswith(codes[r["g"]])
    for g, code in enumerate(codes):
        rest = {pii_plain.only_digits(r["p"])[len(code) if r["t"][0] == "+" else 0 :] for r in rows if r["g"] == g}
        assert len(rest) == 1
