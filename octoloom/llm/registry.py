"""The queries of the corpus operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    decontam,
    embeddings,
    filter_audit,
    fixity,
    licenses,
    mixing,
    pii,
    quality,
    sharding,
    simhash,
    toxicity,
    urlfilter,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC files, audited against a copy laid out from its own, damaged records: what differs."""
    records = fixity.warc_records(table(spark, sf_dir, "pages"))
    files = fixity.file_count(records)
    laid_out = fixity.lay_out(records, keep=("record_id",), files=files)
    copy = fixity.lay_out(fixity.damaged_records(records), keep=("record_id",), files=files)
    found = fixity.audit(laid_out, copy)
    names = [side.select("page_id", "file", "offset", "sha256") for side in (laid_out, copy)]
    new = F.col("status") == "extra"
    named = found.where(~new).join(names[0], ["file", "offset"]).unionByName(found.where(new).join(names[1], ["file", "offset"]))
    return named.select("page_id", "file", "offset", "length", "sha256", "status")


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced, and the kinds and pseudonyms in text order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_pseudonyms(docs).select(
        "doc_id",
        "text",
        F.array_join(F.transform("pseudonyms", lambda p: p["kind"]), ",").alias("kinds"),
        F.size("pseudonyms").cast("long").alias("n_pseudonyms"),
    )


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_stratified_shards": op5_stratified_shards,
    "op6_source_mix": op6_source_mix,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_pii_pseudonyms": op10_pii_pseudonyms,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_filter_interactions": op13_filter_interactions,
}

OP2_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
patterns AS (
  SELECT DISTINCT item, least(13, len(w)) AS size,
         array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM item_words, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i)
  WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM patterns),
grams AS (
  SELECT doc_id, size, i AS first, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM doc_words, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)
  WHERE len(w) >= size),
hits AS (
  SELECT g.doc_id, g.first, g.size, p.item FROM grams g JOIN patterns p USING (size, gram)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(first, first + size)) AS place FROM hits) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(o.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""

OP5_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 1, 2, 3, 4, 5, 6, 7, 8],
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
crcs AS (
  SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                                                  lambda h: CAST('0x' || h AS BIGINT))),
                         lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc),
rows AS (
  SELECT *, md5(concat_ws(':', 'shard-1', coalesce(CAST(doc_id AS VARCHAR), ''), text_crc32, size)) AS key FROM crcs),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 1
             + (CAST(CAST('0x' || substr(md5('shard-1:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE)
               / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, key, doc_id, text_crc32, size) - 1 AS place,
         count(*) OVER () AS n
  FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 8 // n AS INT) AS shard,
       CAST(place - (place * 8 // n * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
"""

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')),
           row_number() OVER (PARTITION BY doc_id, source, text) - 1)), 1, 15) AS BIGINT) AS hash
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, source_size * 2 AS most,
         (sum(source_size) OVER () * 3 / 2
          - coalesce(sum(source_size) OVER lower, 0) * 2)
         / (sum(w) OVER () - coalesce(sum(w) OVER lower, 0)) AS level,
         row_number() OVER filling AS place
  FROM by_source
  WINDOW filling AS (ORDER BY source_size / w, source IS NULL, encode(source)),
         lower AS (ORDER BY source_size / w, source IS NULL, encode(source)
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
planned AS (
  SELECT source, source_size,
         coalesce(least(CAST(most AS DOUBLE),
                        w * (SELECT arg_min(level, place) FROM filled WHERE most > level * w)), 0.0) AS target
  FROM filled),
budgets AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes
  FROM planned),
running AS (
  SELECT s.*, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
edges AS (
  SELECT source, min(hash) AS edge_hash FROM running WHERE budget > 0 AND upto > budget GROUP BY source),
edge_words AS (
  SELECT r.source, e.edge_hash, any_value(r.upto) AS upto, sum(r.size) AS words, any_value(r.budget) AS budget
  FROM running r JOIN edges e ON r.source IS NOT DISTINCT FROM e.source AND r.hash = e.edge_hash GROUP BY ALL),
bounds AS (
  SELECT source, edge_hash + CASE WHEN upto - budget < budget - (upto - words) THEN 1 ELSE 0 END AS bound
  FROM edge_words)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.passes + CASE WHEN r.hash < coalesce(b.bound, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running r LEFT JOIN bounds b ON r.source IS NOT DISTINCT FROM b.source
"""

OP8_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(name, rule_host, rule_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
         ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
         ('org/es/', 'org', '/es/', 'block')),
judged AS (
  SELECT p.*,
         (SELECT arg_max({n: r.name, v: r.verdict}, length(r.name)) FROM rules r
          WHERE (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)) AS best
  FROM parts p)
SELECT page_id, host, path, best.n AS rule,
       coalesce(best.v, CASE WHEN regexp_matches(host || path, '(?i)(^|[^A-Za-z0-9])(casino|porn|xxx|viagra|torrent|warez|phishing|wp-login|escort|betting)($|[^A-Za-z0-9])')
                             THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""

OP9_SQL = r"""
WITH records AS (
  SELECT page_id, concat_ws(chr(13) || chr(10), 'WARC/1.0', 'WARC-Type: response',
           'WARC-Record-ID: <urn:md5:' || md5(coalesce(CAST(page_id AS VARCHAR), '') || ' ' || coalesce(url, '')) || '>',
           'WARC-Target-URI: ' || coalesce(url, ''), 'Content-Length: ' || strlen(coalesce(html, '')), '',
           coalesce(html, '')) AS record
  FROM pages),
keyed AS (
  SELECT page_id, md5(record) AS key, CAST(strlen(record) + 4 AS BIGINT) AS length, sha256(record) AS sha256,
         greatest(1, CAST(ceil((SELECT count(*) FROM pages) / 1000.0) AS BIGINT)) AS files
  FROM records),
placed AS (
  SELECT page_id, length, sha256, CAST('0x' || substr(key, 1, 8) AS BIGINT) % files AS file,
         CAST(coalesce(sum(length) OVER (PARTITION BY CAST('0x' || substr(key, 1, 8) AS BIGINT) % files ORDER BY key, page_id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
         CAST('0x' || substr(sha256, 1, 8) AS BIGINT) % 97 AS lot
  FROM keyed)
SELECT page_id, file, "offset", length, sha256, CASE lot WHEN 3 THEN 'corrupt' ELSE 'missing' END AS status
FROM placed WHERE lot IN (3, 5)
"""

#: All pairs, without hashing.
OP11_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
firsts AS (SELECT x, min(y) AS y FROM reached GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, f.y) AS component_id,
       e.vec_id = least(e.vec_id, f.y) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.x LEFT JOIN firsts f ON e.vec_id = f.x
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM worded, unnest(range(1, 5)) AS lengths(m), unnest(range(1, len(w) - m + 2)) AS starts(i)
  WHERE len(w) >= m),
freq AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
cands AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE m > 1),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, l.f AS l, r.f AS r, 2000000 * c.a // (l.f + r.f) AS score
  FROM cands c, unnest(range(1, c.m)) AS places(k)
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covers AS (
  SELECT c.lang, array_to_string(c.w[s : s + size - 1], ' ') AS phrase, max(c.a) AS a
  FROM cands c, unnest(range(2, c.m)) AS sizes(size), unnest(range(1, c.m - size + 2)) AS starts(s) GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN covers v ON v.lang = w.lang AND v.phrase = w.phrase
  WHERE v.a IS NULL OR 100 * v.a < 80 * w.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, t.doc_id, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text)
                     THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM texts t LEFT JOIN flags USING (doc_id)),
counts AS (
  SELECT part, fails, CAST(count(*) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic
  FROM failed GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE length(translate('ABCDE', concat(a.x, b.x, c.x, d.x, e.x), '')) = 0),
steps AS (
  SELECT filter_order, step, filter_order[1 : step - 1] AS before, filter_order[step] AS filter
  FROM orders, range(1, 6) AS steps(step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN translate(fails, before || filter, '') = fails THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN here THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN contains(fails, filter) AND NOT here THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN here THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN here THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN contains(fails, filter) THEN n * (120 // length(fails)) ELSE 0 END) AS BIGINT) AS shapley
FROM (SELECT *, contains(fails, filter) AND translate(fails, before, '') = fails AS here FROM counts, steps)
GROUP BY part, filter_order, step
"""

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op5_stratified_shards": OP5_SQL,
    "op6_source_mix": OP6_SQL,
    "op8_url_filter": OP8_SQL,
    "op9_warc_fixity": OP9_SQL,
    "op11_embedding_near_dedup": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_filter_interactions": OP13_SQL,
}
