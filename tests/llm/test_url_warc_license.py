"""URL rules, Merkle audits and license scans against plain versions."""

import gzip
import random
import re
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from octoloom.llm import fixity, licenses, registry, urlfilter

# ---- URLs


def plain_judge(url, rules):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in rules:
        own, _, rest = rule[1].partition("/")
        fits = (host == own or host.endswith("." + own)) and path.startswith("/" + rest)
        if fits and (best is None or len(rule[1]) > len(best[1])):
            best = rule
    return host, path, best[1] if best else None, best[0] if best else "allow"


CONTRACT = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
URLS = [
    None, "", "no scheme", "http://com/en/", "http://com/en", "http://a.COM/en/x?y#z", "http://acom/en/", "http://x.example.com/en/71",
    "http://example.com/en/8", "http://notexample.com/en/7", "https://example.net/de/8", "https://example.net/de/9", "ftp://org/es/?q",
    "http://org/es", "http://a.org/es/\n", "http://com?/en/", "http://com#/en/", "http://a://com/en/", "http://COM/EN/", "://net/de/", "http://com:80/en/",
    "http://é.com/en/é", "http://.com/en/", "http://com/en//", "http://b.com/x/en/",
]


def test_contract_rules_against_a_plain_version(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.HOST_RULES).collect()}
    assert got == {k: plain_judge(u, CONTRACT) for k, u in enumerate(URLS)}


def test_many_rules_in_blocks_give_the_same(spark, monkeypatch):
    rules = [("block" if k % 2 else "allow", f"h{k % 7}.com/p{k}/" if k % 3 else f"h{k % 7}.com/p{k}") for k in range(60)]
    made = tuple(urlfilter.host_rule(*r) for r in rules)
    urls = [f"http://x.h{k % 7}.com/p{k}{end}" for k in range(60) for end in ("", "/", "/a", "1")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    monkeypatch.setattr(urlfilter, "RULE_BLOCK", 11)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, made).collect()}
    assert got == {k: plain_judge(u, rules) for k, u in enumerate(urls)}


def test_rules_are_filed_under_their_rarest_token(spark):
    rows = spark.createDataFrame([("com/en/casino",), ("com/en/",), ("com/",)], "address string")
    rules = (urlfilter.host_rule("block", "com/en/casino/"),)
    assert urlfilter.token_counts(rows, rules) == {"com": 3, "en": 2, "casino": 1}
    assert urlfilter.host_rule("block", "example.com/en/7").tokens == ("example", "com", "en")


def test_pattern_rules_give_the_verdict_where_no_host_rule_fits(spark):
    urls = ["http://a.fr/casino/1", "http://a.fr/casinos", "http://x.example.com/en/7/casino", "http://casino.fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in urlfilter.judge(pages).orderBy("page_id").collect()]
    assert got == [(None, "block"), (None, "allow"), ("example.com/en/7", "allow"), (None, "block")]


def test_letters_whose_other_case_is_ascii_are_that_letter_as_in_sql(spark):
    urls = [f"http://{h}.fr/{p}" for h in ("a", "ca\u017fino", "\u017fcasino", "casino\u212a", "cas\u0131no", "x.\u017f") for p in ("", "phi\u017fhing/", "\u017f/xxx")]
    pages = spark.createDataFrame(list(enumerate([*urls, "http://\u017f.com/en/", "http://\u017fcom/en/"])), "page_id long, url string")
    sql = duckdb.connect()
    sql.register("pages", pages.toArrow())
    expected = sorted(sql.execute(registry.OP8_SQL).fetchall())
    assert sorted(map(tuple, urlfilter.judge(pages).collect())) == expected
    assert {row[4] for row in expected} == {"allow", "block"}
    own = (urlfilter.host_rule("block", "\u017fa.com/x\u017fy/z"), urlfilter.word_rule("block", "\u212aiosk"))
    pages = spark.createDataFrame([(0, "http://\u017fa.com/x\u017fy/z1"), (1, "http://kiosk.fr/"), (2, "http://sa.com/xsy/z1")], "page_id long, url string")
    assert [r["verdict"] for r in urlfilter.judge(pages, own).orderBy("page_id").collect()] == ["block", "block", "allow"]


def test_url_query_equals_sql(same_as_sql):
    same_as_sql(registry.op8_url_filter, registry.OP8_SQL)


# ---- WARC


def test_fixity_query_equals_sql(same_as_sql):
    same_as_sql(registry.op9_warc_fixity, registry.OP9_SQL)


@pytest.fixture(scope="module")
def laid_out(spark, small):
    records = fixity.with_damage(fixity.warc_records(spark.read.parquet(f"{small}/pages.parquet")))
    return fixity.lay_out(records, 9, keep=("record", "copy"))


def test_warc_files_there_and_back(spark, laid_out, tmp_path):
    path = str(tmp_path / "warc")
    fixity.write_warc(laid_out, path)
    leaves = fixity.read_warc(spark, path)
    assert sorted(map(tuple, leaves.collect())) == sorted(map(tuple, laid_out.select("file", "offset", "length", "sha256").collect()))


def test_one_changed_byte_is_located(spark, laid_out, tmp_path):
    path = tmp_path / "warc"
    fixity.write_warc(laid_out, str(path))
    sound = fixity.read_warc(spark, str(path))
    victim = laid_out.orderBy(F.desc("offset")).first()
    file = next((path / f"file={victim['file']}").glob("part-*"))
    data = bytearray(file.read_bytes())
    at = victim["offset"] + victim["length"] - 10
    data[at] ^= 1
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(data)
    found = fixity.audit(laid_out, sound).collect()
    assert [(r["file"], r["offset"], r["length"], r["status"]) for r in found] == [
        (victim["file"], victim["offset"], victim["length"], "corrupt")
    ]


@pytest.mark.parametrize("ids", [True, False])
@pytest.mark.parametrize("harm", ["removed", "longer", "header"])
def test_damage_that_moves_records_is_located(spark, small, tmp_path, harm, ids):
    records = fixity.warc_records(spark.read.parquet(f"{small}/pages.parquet"))
    laid_out = fixity.lay_out(records, 25, keep=("record", "record_id"))
    path = tmp_path / "warc"
    fixity.write_warc(laid_out, str(path))
    victim = laid_out.where("file = 0").orderBy("offset").collect()[3]
    file = next((path / "file=0").glob("part-*"))
    data, at, end = file.read_bytes(), victim["offset"], victim["offset"] + victim["length"]
    harmed = {
        "removed": data[:at] + data[end:],
        "longer": data[: end - 4] + b"~" + data[end - 4 :],
        "header": data[:at] + b"XARC" + data[at + 4 :],
    }
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(harmed[harm])
    kept = ["file", "offset", "length", "sha256", *["record_id"] * ids]
    found = fixity.audit(laid_out.select(*kept), fixity.read_warc(spark, str(path), ids=ids)).collect()
    assert [(r["file"], r["offset"], r["length"], r["status"]) for r in found] == [
        (0, at, victim["length"], "missing" if harm == "removed" else "corrupt")
    ]


def test_audit_against_comparing_all_leaves(laid_out):
    leaves = {(r["file"], r["offset"]): r["sha256"] for r in laid_out.collect()}
    damaged = fixity.damaged_copy(laid_out)
    extra = damaged.limit(1).select("file", (F.col("offset") + 1).alias("offset"), "length", "sha256")
    other = damaged.unionByName(extra)
    theirs = {(r["file"], r["offset"]): r["sha256"] for r in other.collect()}
    expected = set()
    for key in leaves.keys() | theirs.keys():
        if leaves.get(key) != theirs.get(key):
            expected.add((*key, "missing" if key not in theirs else "extra" if key not in leaves else "corrupt"))
    got = {(r["file"], r["offset"], r["status"]) for r in fixity.audit(laid_out, other).collect()}
    assert got == expected and len(got) >= 1


def test_levels_shrink_to_one_root(laid_out):
    leaves = laid_out.select("file", "offset", "length", "sha256")
    counts = [level.count() for level, _, _ in fixity.trees(leaves, leaves)]
    assert counts[0] == 2 * laid_out.count() and counts[-1] == 2 and counts == sorted(counts, reverse=True)


def _members(data: bytes) -> list[bytes]:
    return [gzip.compress(data[at : at + size], mtime=0) for at, size, _ in fixity.parse_warc(data)]


def test_compressed_archives_equal_plain_ones(spark, laid_out, tmp_path):
    fixity.write_warc(laid_out, str(tmp_path / "warc"))
    for side in ("plain", "packed"):
        (tmp_path / side).mkdir()
    files = sorted((tmp_path / "warc").glob("file=*/part-*"))
    for k, file in enumerate(files):
        data = file.read_bytes()
        (tmp_path / "plain" / f"{k}.warc").write_bytes(data)
        (tmp_path / "packed" / f"{k}.warc.gz").write_bytes(b"".join(_members(data)))
    first, second = (fixity.read_archives(spark, str(tmp_path / side)) for side in ("plain", "packed"))
    got = sorted(map(tuple, first.collect()))
    assert got == sorted(map(tuple, second.collect())) and len(got) == laid_out.count()
    assert fixity.audit(*fixity.numbered(first, second)).isEmpty()

    whole = next(k for k, f in enumerate(files) if len(_members(f.read_bytes())) >= 3)
    data = files[whole].read_bytes()
    spans, members = list(fixity.parse_warc(data)), _members(data)
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    (tmp_path / "packed" / f"{whole}.warc.gz").write_bytes(b"".join([members[0], bytes(broken), *members[2:]]))
    found = fixity.audit(*fixity.numbered(first, second)).collect()
    assert [(r["file"], r["offset"], r["length"], r["status"]) for r in found] == [(whole, *spans[1][:2], "corrupt")]
    none = fixity.read_archives(spark, str(tmp_path / "none"))
    assert none.isEmpty() and fixity.audit(*fixity.numbered(none, none)).isEmpty()


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.binary(max_size=60), min_size=1, max_size=6),
    st.integers(1, 50),
    st.integers(0, 10**6),
    st.integers(0, 7),
)
def test_streams_in_pieces_of_any_size(bodies, piece, place, bit):
    records = [
        b"WARC/1.0\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (k, len(b), b)
        for k, b in enumerate(bodies)
    ]
    data, packed = b"".join(records), b"".join(gzip.compress(r, mtime=0) for r in records)

    def pieces(of):
        return (of[k : k + piece] for k in range(0, len(of), piece))

    expected = [(sum(map(len, records[:k])), len(r), sha256(r[:-4]).hexdigest(), f"urn:uuid:{k}") for k, r in enumerate(records)]
    assert list(fixity.parse_stream(pieces(data))) == expected
    assert list(fixity.parse_stream(fixity.inflated(pieces(packed)))) == expected
    harmed = bytearray(packed)
    harmed[place % len(harmed)] ^= 1 << bit
    left = {row[2] for row in fixity.parse_stream(fixity.inflated(pieces(bytes(harmed))))}
    lost = [row for row in expected if row[2] not in left]
    assert len({row[2] for row in lost}) <= 1


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200))
def test_unreadable_bytes_are_one_record(data):
    spans = [(at, size) for at, size, _ in fixity.parse_warc(data)]
    assert sum(size for _, size in spans) == len(data)
    assert [at for at, _ in spans] == [sum(s for _, s in spans[:k]) for k in range(len(spans))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"WARC/1.0", b"\r\n", b"\r\n\r\n", b"x", b"Content-Length: 2", b"ab"]), max_size=20), st.integers(1, 9))
def test_what_is_passed_over_is_hashed_as_if_held(parts, piece):
    data = b"".join(parts)
    rows = list(fixity.parse_stream(data[k : k + piece] for k in range(0, len(data), piece)))
    assert sum(r[1] for r in rows) == len(data)
    for at, size, digest, _ in rows:
        assert digest == sha256(data[at : at + size].removesuffix(b"\r\n\r\n")).hexdigest()
    assert rows == list(fixity.parse_stream(iter([data])))


@pytest.mark.parametrize("packed", [False, True])
def test_junk_and_one_large_member_take_little_memory(packed):
    """A gigabyte without a header, plain or as one gzip member: far below 200 MB."""
    import tracemalloc
    import zlib

    block = bytes(random.Random(1).randbytes(1 << 16)) * 16

    def plain():
        for _ in range(1024 if not packed else 256):
            yield block

    def compressed():
        held = zlib.compressobj(0, zlib.DEFLATED, 31)
        for piece in plain():
            yield held.compress(piece)
        yield held.flush()

    tracemalloc.start()
    rows = list(fixity.parse_stream(fixity.inflated(compressed()) if packed else plain()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[:2] for r in rows] == [(0, len(block) * (256 if packed else 1024))]
    assert peak < 100 << 20


def test_copies_are_spread_over_files(spark, monkeypatch):
    """Half of the records equal in everything: no file gets more than a run of them, and both replicas agree."""
    monkeypatch.setattr(fixity, "RUN_COPIES", 50)
    rows = [(7, "http://x", "same")] * 2_000 + [(k, f"http://y/{k}", f"text {k}") for k in range(2_000)]
    records = fixity.warc_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    laid_out = fixity.lay_out(records, 100)
    assert laid_out.count() == 4_000
    sizes = [r["count"] for r in laid_out.groupBy("file").count().collect()]
    assert max(sizes) < 400
    inside = laid_out.groupBy("file").agg(F.sum("length").alias("sum"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("n"), F.count("*").alias("m"))
    assert inside.where("sum != end OR n != m").count() == 0
    leaves = laid_out.select("file", "offset", "length", "sha256")
    assert fixity.audit(leaves, leaves).count() == 0


# ---- licenses


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_each_template_is_found_in_a_long_text(scanner, k):
    name, text = licenses.TEMPLATES[k]
    for page in (text, f"{'lorem ipsum ' * 300}\n{text}\n{'dolor sit ' * 300}", text.upper().replace(" ", "\n")):
        found = {f.license: f for f in scanner.scan(page)}
        assert (found[name].missing, found[name].added) == (0, 0)


def test_wording_decides(scanner):
    long = licenses.TEMPLATES[3][1]
    one = scanner.scan(long.replace("sublicense", "lend"))
    assert [(f.license, f.missing, f.added) for f in one] == [("MIT", 1, 1)]
    words = long.split()
    assert not scanner.scan(" ".join(w for i, w in enumerate(words) if i % 4))
    assert [f.license for f in scanner.scan("Licensed under CC BY 4.0.")] == ["CC-BY-4.0"]
    assert not scanner.scan("a license, a warranty, a permission, copyright and all that")


def test_scan_query_against_plain_search(spark, small):
    """The tables hold whole notices only, so finding them is finding their words in a row."""
    texts = {r["doc_id"]: licenses.normal_words(r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    wanted = [(n, " ".join(licenses.normal_words(t))) for n, t in licenses.TEMPLATES]
    for r in registry.op3_license_scan(spark, small).collect():
        words = f" {' '.join(texts[r['doc_id']])} "
        expected = sorted({n for n, t in wanted if f" {t} " in words})
        assert r["licenses"] == ",".join(expected)
        assert (r["n_licenses"], r["n_changed_words"]) == (len(expected), 0)


NOTICE = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as "
    "published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
)
BSD_2 = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause")
APART = [
    *[(f"This work is licensed under the GNU General Public License, version {v}.", w) for v, w in (("1", []), ("2", ["GPL-2.0"]), ("3", ["GPL-3.0"]))],
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    (NOTICE.format("General", "2"), ["GPL-2.0"]),
    (NOTICE.format("General", "3"), ["GPL-3.0"]),
    (NOTICE.format("Lesser General", "2.1"), ["LGPL-2.1"]),
    (NOTICE.format("Affero General", "3"), ["AGPL-3.0"]),
    (BSD_2, ["BSD-2-Clause"]),
    (BSD_2 + " 3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED", ["BSD-3-Clause"]),
    ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", []),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", []),
    ("// SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0"]),
    ("# SPDX-License-Identifier: BSD-3-Clause\n", ["BSD-3-Clause"]),
    ("SPDX-License-Identifier: ISC.", ["ISC"]),
    ("SPDX-License-Identifier: (MPL-2.0 OR GPL-2.0-or-later WITH Classpath-exception-2.0)", ["GPL-2.0", "MPL-2.0"]),
    ("SPDX-License-Identifier: MIT and more is said here", ["MIT"]),
]


@pytest.mark.parametrize("k", range(len(APART)))
def test_neighbouring_licenses_are_told_apart(scanner, k):
    text, names = APART[k]
    for page in (text, f"{'lorem ipsum ' * 50}\n{text}\n{'dolor sit ' * 50}"):
        assert [f.license for f in scanner.scan(page)] == names


NEAR_MISSES = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": ["GPL-2.0"],
    "Licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
    "Licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/": ["MPL-1.1"],
    "Licensed under the Mozilla Public License, version 1.1.": ["MPL-1.1"],
    "Licensed under the Mozilla Public License, version 2.0.": ["MPL-2.0"],
    "Licensed under the Apache License, Version 1.1.": ["Apache-1.1"],
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "Licensed under the Eclipse Public License, version 1.0.": ["EPL-1.0"],
    "Released under the Eclipse Public License, version 2.0.": ["EPL-2.0"],
    "This code is not licensed under the MIT License.": [],
    "It is no longer released under the MIT License.": [],
    "Licensed under the MIT License.": ["MIT"],
    "Licensed under the ISC License.": ["ISC"],
    "Licensed under the zlib License.": ["Zlib"],
    "Licensed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.": ["WTFPL"],
}


@pytest.mark.parametrize("notice", NEAR_MISSES)
def test_near_misses_have_their_own_names(notice):
    found = licenses.Scanner().scan(f"Some words before. {notice} And some after.")
    assert [f.license for f in found] == NEAR_MISSES[notice]


def test_twenty_five_licenses_and_each_template_names_itself():
    assert len({name for name, _ in licenses.TEMPLATES}) >= 25
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES:
        assert name in [f.license for f in scanner.scan(text)], text


def test_word_rules_ignore_case_and_lists_are_read(spark):
    urls = ["http://a.com/CASINO/1", "http://b.com/casinos", "http://Bad.org/x", "http://ok.bad.org/x", "http://c.net/Ads/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r["verdict"] for r in urlfilter.judge(pages).orderBy("page_id").collect()][:2] == ["block", "allow"]
    rules = urlfilter.list_rules(["! a comment", "", "||bad.org^", "@@||ok.bad.org^", "ads"])
    got = [r["verdict"] for r in urlfilter.judge(pages, rules).orderBy("page_id").collect()]
    assert got == ["allow", "allow", "block", "allow", "block"]


def test_a_hundred_thousand_rules(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    hosts = [f"||site{k}.example{k % 50}.com/{k % 7}^" for k in range(99_990)]
    many = urlfilter.RULES + urlfilter.list_rules(hosts)
    more = spark.createDataFrame([(10_000 + k, f"http://www.site{k}.example{k % 50}.com/{k % 7}") for k in range(0, 99_990, 999)], "page_id long, url string")
    both = pages.select("page_id", "url").unionByName(more)
    got = {r["page_id"]: tuple(r) for r in urlfilter.judge(both, many).collect()}
    assert {k: v for k, v in got.items() if k < 10_000} == {r["page_id"]: tuple(r) for r in urlfilter.judge(pages).collect()}
    assert all(v[4] == "block" for k, v in got.items() if k >= 10_000) and len(got) == both.count()


#: Notices as they are written in the wild, and what they say.
WILD = {
    "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "Available under the MIT License.": ["MIT"],
    "Published under the Apache License, Version 2.0.": ["Apache-2.0"],
    "Provided under the ISC License.": ["ISC"],
    "Offered under the BSD 3-Clause License.": ["BSD-3-Clause"],
    "Issued under the BSD 2-Clause License.": ["BSD-2-Clause"],
    "Released under the MIT License.": ["MIT"],
    "Licensed under MIT license": ["MIT"],
    "licensed under Apache License, Version 2.0": ["Apache-2.0"],
    "Licensed under either of Apache License, Version 2.0 or MIT license": ["Apache-2.0", "MIT"],
    "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.": ["Apache-2.0", "MIT"],
    "License: MIT": ["MIT"],
    "license = \"MIT\"": ["MIT"],
    "\"license\": \"Apache-2.0\",": ["Apache-2.0"],
    "License: GPL-2.0-or-later\nVersion: 3": ["GPL-2.0"],
    "license: (MIT OR Apache-2.0)": ["Apache-2.0", "MIT"],
    "licence: ISC": ["ISC"],
    "License: see the file": [],
    "License: MIT is one of many": [],
    "license: proprietary": [],
    "No part is licensed under the MIT License.": [],
    "None of this is licensed under the MIT License.": [],
    "Nothing here is released under the ISC License.": [],
    "This is not, however, licensed under the MIT License.": [],
    "It was never licensed under the MIT License.": [],
    "There is no warranty. Licensed under the MIT License.": ["MIT"],
    "There is no warranty; licensed under the MIT License.": ["MIT"],
    "There is no fee, and it is licensed under the MIT License.": ["MIT"],
    "It is not free but licensed under the MIT License.": ["MIT"],
    "Why not?\n\nLicensed under the MIT License.": ["MIT"],
    " * Licensed under the Apache License, Version 2.0\n * by us.": ["Apache-2.0"],
    "/* SPDX-License-Identifier: MPL-2.0 */": ["MPL-2.0"],
    "This work is licensed under CC BY 4.0.": ["CC-BY-4.0"],
    "Distributed under the Eclipse Public License, version 2.0.": ["EPL-2.0"],
    "Distributed under the Mozilla Public License, version 1.1.": ["MPL-1.1"],
    "Distributed under the GNU General Public License, version 3.": ["GPL-3.0"],
    "Distributed under the GNU General Public License, version 1.": [],
    "Everything under the sun is licensed.": [],
    "Distributed under the counter.": [],
    "You may either license it or not.": [],
}


@pytest.mark.parametrize("notice", WILD)
def test_notices_in_the_wild(scanner, notice):
    for text in (notice, f"Some words before.\n{notice}\nAnd some after."):
        assert [f.license for f in scanner.scan(text)] == WILD[notice], text


def test_a_megabyte_of_marks_is_soon_scanned(scanner):
    import time

    words = ["license", "copyright", "reserved", "permission", "warranty", "redistribution", "domain", "mit", "apache"]
    rng = random.Random(3)
    for text in ("license " * 125_000, " ".join(rng.choices(words, k=110_000))):
        began = time.process_time()
        assert not scanner.scan(text)
        assert time.process_time() - began < 10


def test_what_is_left_out_could_not_have_been_confirmed(scanner):
    """Templates are laid everywhere once, without the cheap look, on texts with words taken out and put in."""
    rng = random.Random(4)
    for name, text in licenses.TEMPLATES:
        words = text.split()
        for _ in range(3):
            changed = [w for w in words if rng.random() > 0.06] + ["end"]
            page = " ".join(["before", *changed])
            held, licenses.Page.may_hold = licenses.Page.may_hold, lambda *a: True
            try:
                plain = scanner.scan(page)
            finally:
                licenses.Page.may_hold = held
            assert scanner.scan(page) == plain, name
