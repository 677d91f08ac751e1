"""The catalog's queries in DuckDB SQL, written from the same rules on their own."""

from __future__ import annotations

from ..operators.orders import WHITE

SQL: dict[str, str] = {}

_DOCS = "SELECT doc_id, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL"
_PAGES = "SELECT page_id, hex(encode(html)) AS h, CAST(strlen(html) AS BIGINT) AS n FROM pages WHERE html IS NOT NULL"


def _byte(index: str, h: str = "h") -> str:
    return f"CAST('0x' || substr({h}, CAST(2 * ({index}) + 1 AS BIGINT), 2) AS INT)"


def _class(b: str, zero, full, text, other) -> str:
    return (
        f"CASE WHEN {b} = 0 THEN {zero} WHEN {b} = 255 THEN {full} "
        f"WHEN {b} BETWEEN 9 AND 13 OR {b} BETWEEN 32 AND 126 THEN {text} ELSE {other} END"
    )


def _bytes(keys: str, blobs: str) -> str:
    """Every byte ``b`` with its index ``i``."""
    return (
        f"SELECT {keys}, i - 1 AS i, CAST('0x' || u AS INT) AS b FROM (SELECT {keys}, unnest(us) AS u, "
        f"generate_subscripts(us, 1) AS i FROM (SELECT *, regexp_extract_all(h, '..') AS us FROM {blobs}))"
    )


_GREY = _class("b", 0, 255, 55, 228)

SQL["byte_class_histogram"] = f"""
WITH docs AS (SELECT source, hex(encode(text)) AS h, strlen(text) AS n FROM documents),
bytes AS ({_bytes("source", "docs")})
SELECT source, CAST(sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero,
       CAST(sum(CASE WHEN b = 255 THEN 1 ELSE 0 END) AS BIGINT) AS n_full,
       CAST(sum(CASE WHEN b BETWEEN 9 AND 13 OR b BETWEEN 32 AND 126 THEN 1 ELSE 0 END) AS BIGINT) AS n_text,
       CAST(sum(CASE WHEN b IN (0, 255) OR b BETWEEN 9 AND 13 OR b BETWEEN 32 AND 126 THEN 0 ELSE 1 END) AS BIGINT) AS n_other
FROM bytes GROUP BY source
"""

SQL["byte_class_rgb"] = f"""
WITH docs AS ({_DOCS}), bytes AS ({_bytes("doc_id", "docs")})
SELECT doc_id, CAST(sum({_class("b", 0, 255, 55, 228)}) AS BIGINT) AS sum_r,
       CAST(sum({_class("b", 0, 255, 126, 26)}) AS BIGINT) AS sum_g,
       CAST(sum({_class("b", 0, 255, 184, 28)}) AS BIGINT) AS sum_b,
       CAST(sum({_GREY}) AS BIGINT) AS sum_grey
FROM bytes GROUP BY doc_id
"""

SQL["byte_magnitude_stats"] = f"""
WITH pages AS ({_PAGES}), bytes AS ({_bytes("page_id, n", "pages")})
SELECT page_id, n AS n_bytes, CAST(sum(b) AS BIGINT) AS sum_value, min(b) AS min_value, max(b) AS max_value,
       CAST(count(DISTINCT b) AS INT) AS n_symbols
FROM bytes GROUP BY page_id, n
"""


def _grid(blobs: str, key: str, size: int, quads: str, start: str, stop: str) -> str:
    area = size * size
    return f"""
quads AS (SELECT {key}, h, n, q AS quad, CAST({start} AS BIGINT) AS a, CAST({stop} AS BIGINT) AS z
          FROM ({blobs}), unnest(range(CAST({quads} AS BIGINT))) AS t(q) WHERE n > 0),
grid AS (SELECT {key}, quad, j, a + (j * (z - a)) // {area} AS byte_idx,
                CASE WHEN a + (j * (z - a)) // {area} < n THEN {_byte(f"a + (j * (z - a)) // {area}")} END AS b
         FROM quads, unnest(range({area})) AS t(j))"""


def _square(size: int) -> str:
    return _grid(_DOCS, "doc_id", size, "1", "0", "n")


SQL["sample_square"] = f"WITH {_square(16)} SELECT doc_id, j, byte_idx, b FROM grid"
SQL["sample_unrolled4"] = (
    f"WITH {_grid(_DOCS, 'doc_id', 8, '4', 'q * n // 4', '(q + 1) * n // 4')} SELECT doc_id, quad, j, byte_idx, b FROM grid"
)
SQL["sample_unrolled_step"] = (
    f"WITH {_grid(_PAGES, 'page_id', 8, '(n + 191) // 192', 'q * 192', '(q + 1) * 192')} "
    "SELECT page_id, quad, j, byte_idx, coalesce(b, 0) AS b FROM grid"
)
SQL["unrolled_n_quads"] = f"""
WITH docs AS ({_DOCS}), bytes AS (SELECT doc_id, i // 256 AS quad, b FROM ({_bytes("doc_id", "docs")}))
SELECT doc_id, quad, CAST(count(*) AS INT) AS n_bytes, CAST(sum(b) AS BIGINT) AS sum_value FROM bytes GROUP BY doc_id, quad
"""


def _zigzag_y(size: int) -> str:
    return f"CASE WHEN j // {size} % 2 = 1 THEN {size - 1} - j % {size} ELSE j % {size} END"


SQL["channel_mix3"] = f"""
WITH {_square(4)}
SELECT doc_id, CAST(j // 4 AS INT) AS x, CAST({_zigzag_y(4)} AS BIGINT) AS y, {_GREY} AS r, b AS g, 0 AS b FROM grid
""".replace("b AS g, 0 AS b", "grid.b AS g, 0 AS b")

SQL["zigzag_layout"] = f"""
SELECT o_orderkey, j AS d, CAST(j // 48 AS INT) AS x, CAST({_zigzag_y(48)} AS INT) AS y
FROM (SELECT o_orderkey, CAST(o_orderkey % 2304 AS BIGINT) AS j FROM orders)
"""

SQL["hilbert_layout"] = """
WITH RECURSIVE walk(d, k, rest, x, y) AS (
  SELECT j, 0, j, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM range(64 * 64) AS t(j)
  UNION ALL
  SELECT d, k + 1, rest >> 2,
         CASE WHEN up = 0 THEN (CASE WHEN across = 1 THEN s - 1 - y ELSE y END) ELSE x END + s * across,
         CASE WHEN up = 0 THEN (CASE WHEN across = 1 THEN s - 1 - x ELSE x END) ELSE y END + s * up
  FROM (SELECT *, (rest >> 1) & 1 AS across, xor(rest & 1, (rest >> 1) & 1) AS up, CAST(1 AS BIGINT) << k AS s
        FROM walk WHERE k < 7))
SELECT o_orderkey, d, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM walk JOIN orders ON o_orderkey % 4096 = d WHERE k = 7
"""

SQL["span_mask"] = f"""
WITH {_square(8)},
spans AS (
  SELECT doc_id, (doc_id * 37 + k * 101) % n AS s, least((doc_id * 37 + k * 101) % n + (doc_id * 13 + k * 29) % 200, n) AS e
  FROM ({_DOCS}), unnest(range(3)) AS t(k) WHERE n > 0)
SELECT doc_id, CAST(j // 8 AS INT) AS x, CAST({_zigzag_y(8)} AS BIGINT) AS y,
       CASE WHEN EXISTS (SELECT 1 FROM spans WHERE spans.doc_id = grid.doc_id AND byte_idx >= s AND byte_idx < e)
            THEN 255 ELSE 0 END AS mask
FROM grid
"""

_MEMBERS = """
sized AS (
  SELECT page_id // 10 AS blob_id, page_id % 10 AS k, url, CAST(coalesce(strlen(html), 0) AS BIGINT) AS size FROM pages),
members AS (
  SELECT *, CAST(coalesce(sum((size + 511) // 512 * 512 + 512) OVER (PARTITION BY blob_id ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM sized)
"""
SQL["interval_structure"] = f"""
WITH {_MEMBERS},
points AS (
  SELECT blob_id, j, j * n // 1024 AS byte_idx
  FROM (SELECT blob_id, max(o + 512 + size) AS n FROM members GROUP BY blob_id), unnest(range(1024)) AS t(j))
SELECT p.blob_id, p.j, p.byte_idx, coalesce(max(CASE
    WHEN m.blob_id IS NULL THEN NULL
    WHEN p.byte_idx < m.o + 512 THEN [155, 140, 125, 105, 90, 75, 60, 45, 0, 0][m.k + 1]
    ELSE [255, 230, 205, 180][m.k % 4 + 1] END), 0) AS structure
FROM points p LEFT JOIN members m ON p.blob_id = m.blob_id AND p.byte_idx >= m.o AND p.byte_idx < m.o + 512 + m.size
GROUP BY p.blob_id, p.j, p.byte_idx
"""
SQL["structure_ranges"] = f"""
WITH {_MEMBERS}
SELECT blob_id, CAST(k AS INT) AS member_idx, o AS range_start, o + 512 AS range_end, [155, 140, 125, 105, 90, 75, 60, 45, 0, 0][k + 1] AS colour
FROM members
UNION ALL SELECT blob_id, CAST(k AS INT), o + 512, o + 512 + size, [255, 230, 205, 180][k % 4 + 1] FROM members
"""
SQL["member_spans"] = f"""
WITH {_MEMBERS}
SELECT m.blob_id, o AS span_start, o + 512 + size AS span_end FROM members m
WHERE EXISTS (SELECT 1 FROM members f WHERE f.blob_id = m.blob_id AND f.url = m.url AND starts_with(f.url, 'https:'))
"""
_PACKED = _MEMBERS.replace("page_id % 10 AS k", "row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id % 10) - 1 AS k, page_id % 10 AS d")
SQL["tar_members"] = f"""
WITH {_PACKED}
SELECT blob_id, CAST(k AS INT) AS member_idx, 'p' || d || '.html' AS name, '0' AS type, o AS "offset", o + 512 AS offset_data, size FROM members
"""
SQL["chunk_structure"] = f"""
WITH {_PACKED},
points AS (
  SELECT blob_id, j, j * n // 256 AS byte_idx
  FROM (SELECT blob_id, (max(o + 512 + (size + 511) // 512 * 512) + 1024 + 10239) // 10240 * 10240 AS n FROM members GROUP BY blob_id),
       unnest(range(256)) AS t(j))
SELECT p.blob_id, CAST(p.j // 16 AS INT) AS x, CAST(CASE WHEN p.j // 16 % 2 = 1 THEN 15 - p.j % 16 ELSE p.j % 16 END AS BIGINT) AS y,
       CAST(coalesce(max(CASE WHEN m.blob_id IS NULL THEN NULL WHEN p.byte_idx < m.o + 512 THEN 155
                              ELSE [255, 230, 205, 180][m.k % 4 + 1] END), 0) AS INT) AS structure
FROM points p LEFT JOIN members m ON p.blob_id = m.blob_id AND p.byte_idx >= m.o AND p.byte_idx < m.o + 512 + m.size
GROUP BY p.blob_id, p.j
"""

SQL["window_entropy"] = f"""
WITH {_square(16)},
framed AS (
  SELECT g.doc_id, g.j, coalesce(o.b, 0) AS b
  FROM grid g CROSS JOIN unnest(range(-16, 16)) AS t(k)
  LEFT JOIN grid o ON o.doc_id = g.doc_id AND o.j = g.j + k),
shares AS (SELECT doc_id, j, b, count(*) / 32.0 AS p FROM framed GROUP BY doc_id, j, b)
SELECT doc_id, j, round(sum(-p * ln(p) / ln(32.0)), 6) AS entropy FROM shares GROUP BY doc_id, j
"""
SQL["chunk_entropy"] = SQL["window_entropy"]
SQL["chunk_entropy_step"] = f"""
WITH {_grid(_PAGES, "page_id", 8, "(n + 191) // 192", "q * 192", "(q + 1) * 192")},
framed AS (
  SELECT g.page_id, g.quad, g.j, g.b AS own, coalesce(o.b, 0) AS b
  FROM grid g CROSS JOIN unnest(range(-16, 16)) AS t(k)
  LEFT JOIN grid o ON o.page_id = g.page_id AND o.quad = g.quad AND o.j = g.j + k),
shares AS (SELECT page_id, quad, j, own, b, count(*) / 32.0 AS p FROM framed GROUP BY ALL),
found AS (SELECT page_id, quad, j, own, least(sum(-p * ln(p) / ln(32.0)), 1) AS e FROM shares GROUP BY page_id, quad, j, own)
SELECT page_id, quad, j, CASE WHEN own IS NULL THEN 0 ELSE CAST(floor(e * 255 + 1e-9) AS INT) END AS r, 0 AS g,
       CASE WHEN own IS NULL THEN 0 ELSE CAST(floor(e * e * 255 + 1e-9) AS INT) END AS b
FROM found
"""

_BLOCK = f"""
docs AS ({_DOCS}), bytes AS ({_bytes("doc_id, n", "docs")}),
shares AS (SELECT doc_id, n, b, CAST(count(*) AS DOUBLE) / n AS p FROM bytes GROUP BY doc_id, n, b),
found AS (SELECT doc_id, sum(-p * ln(p)) / ln(least(n, 32)) AS e FROM shares WHERE n > 1 GROUP BY doc_id, n)
"""
SQL["block_entropy"] = (
    f"WITH {_BLOCK} SELECT doc_id, round(e, 6) AS entropy FROM docs LEFT JOIN found USING (doc_id)"
)
SQL["entropy_contrast"] = f"""
WITH {_BLOCK}
SELECT doc_id, round(greatest(pow(4 * (e / 2) - 4 * (e / 2) * (e / 2), 4), 0), 6) AS contrast
FROM docs LEFT JOIN found USING (doc_id)
"""

def _hilbert(size: int) -> str:
    """Positions (d, x, y), unfolded a level at a time; to go first, after WITH RECURSIVE."""
    levels = size.bit_length()
    return f"""
steps(d, k, x, y, rest) AS (
  SELECT d, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), d FROM range({size * size}) AS t(d)
  UNION ALL
  SELECT d, k + 1, CASE WHEN up = 0 THEN fy ELSE fx END + side * across, CASE WHEN up = 0 THEN fx ELSE fy END + side * up, rest // 4
  FROM (SELECT *, CASE WHEN up = 0 AND across = 1 THEN side - 1 - x ELSE x END AS fx,
                  CASE WHEN up = 0 AND across = 1 THEN side - 1 - y ELSE y END AS fy
        FROM (SELECT *, CAST(power(2, k) AS BIGINT) AS side, rest // 2 % 2 AS across, xor(rest % 2, rest // 2 % 2) AS up FROM steps WHERE k < {levels}))),
curve AS (SELECT d, x, y FROM steps WHERE k = {levels})"""


SQL["hilbert_window"] = f"""
WITH RECURSIVE {_hilbert(32)}, {_square(32)}
SELECT doc_id, j, CAST(x AS INT) AS x, CAST(y AS BIGINT) AS y, byte_idx, b FROM grid JOIN curve ON d = j
WHERE x BETWEEN 8 AND 20 AND y BETWEEN 5 AND 16
"""
SQL["hilbert_window_chunks"] = f"""
WITH RECURSIVE {_hilbert(16)}, {_grid(_PAGES, "page_id", 16, "(n + 255) // 256", "q * 256", "(q + 1) * 256")}
SELECT page_id, quad, j, CAST(x AS INT) AS x, CAST(y + quad * 16 AS BIGINT) AS y, byte_idx, b FROM grid JOIN curve ON d = j
WHERE b IS NOT NULL AND x BETWEEN 3 AND 11 AND y + quad * 16 BETWEEN 10 AND 23
"""
SQL["hilbert_inverse"] = f"""
WITH RECURSIVE {_hilbert(1024)},
points AS (SELECT c_custkey, c_custkey % 1024 AS x, (CAST(floor(c_acctbal) AS BIGINT) % 1024 + 1024) % 1024 AS y FROM customer)
SELECT c_custkey, CAST(p.x AS INT) AS x, CAST(p.y AS INT) AS y, d FROM points p JOIN curve c ON c.x = p.x AND c.y = p.y
"""

SQL["render_quads"] = f"""
WITH {_grid(_DOCS, "doc_id", 8, "4", "q * n // 4", "(q + 1) * n // 4")},
coloured AS (
  SELECT doc_id, quad, j // 8 AS x, {_zigzag_y(8)} AS y,
         CASE WHEN b IS NULL THEN '000000' ELSE
           {_class("b", "'000000'", "'FFFFFF'", "'377EB8'", "'E41A1C'")} END AS c
  FROM grid)
SELECT doc_id, quad, md5(string_agg(c, '' ORDER BY y, x)) AS image_md5 FROM coloured GROUP BY doc_id, quad
"""

SQL["patch_ids"] = """
SELECT *, y // 16 * 3 + x // 32 AS patch_id
FROM (SELECT o_orderkey, CAST(o_custkey % 100 AS BIGINT) AS x, CAST(o_orderkey % 70 AS BIGINT) AS y FROM orders)
WHERE x < 96 AND y < 64
"""
SQL["near_equal_splits"] = f"""
SELECT doc_id, CAST(k AS INT) AS k, k * (n // 7) + least(k, n % 7) AS first,
       (k + 1) * (n // 7) + least(k + 1, n % 7) AS last
FROM ({_DOCS}), unnest(range(7)) AS t(k)
"""
SQL["patch_label_any"] = """
SELECT conv_id AS image_name, turn AS patch_id, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS label
FROM conversations GROUP BY conv_id, turn
"""

_SCORES = """
scores AS (
  SELECT label AS image_name, vec_id AS patch_id, label % 2 AS label, z0, z1,
         1.0 / (1.0 + exp(-z0)) AS p0, 1.0 / (1.0 + exp(-z1)) AS p1
  FROM (SELECT *, CAST(embedding[1] AS DOUBLE) * 8.0 AS z0, CAST(embedding[2] AS DOUBLE) * 8.0 AS z1 FROM embeddings))
"""
SQL["infer_verdict"] = f"""
WITH {_SCORES}
SELECT image_name, CASE WHEN max(p1) > 0.75 THEN 'malevolent' ELSE 'benign' END AS class,
       round(CASE WHEN max(p1) > 0.75 THEN max(p1) ELSE avg(p0) END, 6) AS probability
FROM scores GROUP BY image_name
"""
_EVAL = """
rows AS (SELECT image_name, max(label) AS y_true, max(CASE WHEN p1 > p0 THEN 1 ELSE 0 END) AS y_pred, max(p1) AS p
         FROM scores GROUP BY image_name)
"""
SQL["eval_verdict"] = f"WITH {_SCORES}, {_EVAL} SELECT image_name, y_true, y_pred, round(p, 6) AS malevolent_prob FROM rows"
SQL["eval_accuracy"] = (
    f"WITH {_SCORES}, {_EVAL} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM rows"
)
SQL["confusion_matrix"] = "SELECT quality AS y_true, toxic AS y_pred, count(*) AS n FROM labels GROUP BY 1, 2"
SQL["confusion_metrics"] = """
WITH c AS (
  SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
         count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM c
"""
SQL["class_weights"] = """
SELECT 1.0::DOUBLE AS w_benign, round(CAST(count(*) FILTER (toxic = 0) AS DOUBLE) / nullif(count(*) FILTER (toxic = 1), 0), 6)
       AS w_malevolent
FROM labels
"""
SQL["weighted_bce"] = f"""
WITH {_SCORES}
SELECT image_name, round(avg((greatest(z0, 0) - z0 * (1 - label) + ln(1 + exp(-abs(z0)))
                              + 64.0 * (greatest(z1, 0) - z1 * label + ln(1 + exp(-abs(z1))))) / 2), 5) AS loss
FROM scores GROUP BY image_name
"""
SQL["running_loss"] = "SELECT round(sum(abs(value) / (event_id + 1)), 4) AS running_loss FROM events"
SQL["diff_files"] = """
SELECT event_id AS path, '/f' || k AS file
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) WHERE k % 5 <> 0 AND k % 3 IN (0, 2)
"""
SQL["label_exclusion"] = """
SELECT event_id, nullif(event_type, 'view') AS label FROM events
WHERE nullif(event_type, 'view') IS NULL OR event_type NOT IN ('click', 'purchase')
"""
SQL["member_semi_join"] = """
SELECT page_id, regexp_extract(url, '://[^/]*(/[a-z]+)/', 1) AS name FROM pages
WHERE ltrim(regexp_extract(url, '://[^/]*(/[a-z]+)/', 1), '/') IN (SELECT lang FROM documents)
"""
SQL["service_dedupe"] = """
SELECT conv_id AS order_id, turn AS container_name, role AS image,
       CASE strlen(text) % 3 WHEN 0 THEN 'malevolent' WHEN 1 THEN 'benign' END AS class,
       CASE WHEN strlen(text) % 3 = 2 THEN 'failed' ELSE 'completed' END AS status
FROM conversations
"""
_HASHED = f"hashed AS (SELECT doc_id, md5(trim(text, '{WHITE}')) AS sa_hash FROM documents)"
SQL["repeated_orders"] = f"""
WITH hashed AS (SELECT *, md5(trim(text, '{WHITE}')) AS sa_hash FROM conversations),
firsts AS (
  SELECT * FROM hashed WHERE sa_hash IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sa_hash ORDER BY conv_id, turn, role, encode(text)) = 1)
SELECT h.conv_id, h.turn, h.role, h.sa_hash,
       CASE WHEN strlen(f.text) % 3 = 0 THEN 'malevolent' ELSE 'benign' END || ':' || strlen(f.text) AS stix_report,
       f.conv_id AS by_conv, f.turn AS by_turn, (h.conv_id, h.turn, h.role) <> (f.conv_id, f.turn, f.role) AS repeated
FROM hashed h LEFT JOIN firsts f ON h.sa_hash = f.sa_hash
"""
SQL["sa_hash"] = f"""
WITH {_HASHED}
SELECT h.doc_id, h.sa_hash, s.stored_id FROM hashed h
JOIN (SELECT sa_hash, min(doc_id) AS stored_id FROM hashed GROUP BY sa_hash) s ON h.sa_hash = s.sa_hash AND h.doc_id <> s.stored_id
"""
SQL["hash_misses"] = """
SELECT DISTINCT md5(CAST(o_orderkey AS VARCHAR)) AS sa_hash FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)
"""
SQL["order_verdict_of_none"] = """
SELECT p_partkey AS order_id, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'malevolent' ELSE 'benign' END AS label
FROM part LEFT JOIN orders ON o_custkey = p_partkey GROUP BY p_partkey
"""
SQL["order_verdict"] = """
SELECT conv_id AS order_id, CASE WHEN bool_or(strlen(text) % 7 = 0) THEN 'malevolent' ELSE 'benign' END AS label
FROM conversations GROUP BY conv_id
"""
SQL["attestation_listing"] = "SELECT * FROM (SELECT count(*) AS total FROM events) WHERE total > 0"
SQL["attestation_lookup"] = """
SELECT event_id AS id, event_type, value, rel, 'https://host/attestation/' || event_id || tail AS href, 'GET' AS method
FROM events, (VALUES ('self', ''), ('report', '/report'), ('status', '/status')) AS l(rel, tail) WHERE event_id = 17
"""
SQL["chain_sources"] = """
SELECT 'doc' AS kind, count(*) AS n_blobs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents
UNION ALL SELECT 'page', count(*), CAST(sum(strlen(html)) AS BIGINT) FROM pages
"""
SQL["path_functions"] = r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*', '') || '.png' AS path FROM pages)
SELECT page_id, regexp_replace(path, '\.png$', '.mask.png') AS mask_path,
       regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '') AS stem,
       CASE WHEN contains(path, 'benign') THEN 0 ELSE 1 END AS label
FROM p
"""
SQL["colour_parse"] = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE substr(md5(c_name), 1, 6) END AS spec FROM customer)
SELECT c_custkey, round(coalesce(CAST('0x' || substr(spec, 1, 2) AS INT) / 255, 1), 6) AS r,
       round(coalesce(CAST('0x' || substr(spec, 3, 2) AS INT) / 255, 0), 6) AS g,
       round(coalesce(CAST('0x' || substr(spec, 5, 2) AS INT) / 255, 0), 6) AS b
FROM c
"""

SQL["report_json"] = """
WITH judged AS (
  SELECT o_custkey AS order_id, o_orderpriority AS image, o_orderstatus AS tag, 't' || o_orderkey || '.1' AS stem,
         md5(CAST(o_orderkey AS VARCHAR)) AS hash, CASE WHEN o_orderkey % 100 > 40 THEN 'malevolent' ELSE 'benign' END AS class,
         (o_orderkey % 100) / 100.0::DOUBLE AS p, o_orderkey % 100 > 50 AS bad
  FROM orders WHERE o_custkey IN (SELECT p_partkey FROM part)),
none AS (SELECT NULL::VARCHAR AS t, NULL::INT AS i, NULL::DOUBLE AS d)
SELECT p_partkey AS order_id, 'report' AS type, 'container-malware-detection-report' AS name, t AS context,
       CASE WHEN bool_or(class = 'malevolent') THEN 'malevolent' ELSE 'benign' END AS labels, i AS confidence,
       CAST(count(j.order_id) AS INT) AS n_refs, t AS image, t AS tag, t AS hash, t AS class, d AS probability
FROM none, part LEFT JOIN judged j ON j.order_id = p_partkey GROUP BY p_partkey, t, i, d
UNION ALL SELECT order_id, 'grouping', image || ':' || tag, 'software-container-analysis', class, i, CASE WHEN bad THEN 3 ELSE 2 END, t, t, t, t, d
FROM judged, none
UNION ALL SELECT order_id, 'file', stem, t, t, i, 0, image, tag, hash, t, d FROM judged, none
UNION ALL SELECT order_id, 'observed-data', t, t, t, i, 1, t, t, t, class, p FROM judged, none
UNION ALL SELECT order_id, 'malware', 'unknown_malware', t, 'docker,machine learning detection', CAST(floor(p * 100) AS INT), 1, t, t, t, t, d
FROM judged, none WHERE bad
"""
SQL["compose_orders"] = """
SELECT conv_id AS order_id, 'c' || turn AS container_name, role AS image, CASE WHEN turn % 3 > 0 THEN 'v' || turn ELSE 'latest' END AS tag
FROM conversations
"""
SQL["chart_orders"] = """
SELECT p_partkey AS order_id, 'e' || p_partkey AS container_name, CASE p_size % 4 WHEN 0 THEN 'r' ELSE 'i' END || p_partkey AS image,
       CASE p_size % 4 WHEN 0 THEN '1.' ELSE 't' END || p_partkey AS tag
FROM part WHERE p_size % 4 < 2
"""
SQL["entropy_colours"] = f"""
WITH {_square(8)},
framed AS (
  SELECT g.doc_id, g.j, coalesce(o.b, 0) AS b
  FROM grid g CROSS JOIN unnest(range(-16, 16)) AS t(k) LEFT JOIN grid o ON o.doc_id = g.doc_id AND o.j = g.j + k),
shares AS (SELECT doc_id, j, b, count(*) / 32.0 AS p FROM framed GROUP BY doc_id, j, b),
found AS (SELECT doc_id, j, least(sum(-p * ln(p) / ln(32.0)), 1) AS e FROM shares GROUP BY doc_id, j)
SELECT doc_id, CAST(j // 8 AS INT) AS x, CAST({_zigzag_y(8)} AS BIGINT) AS y, CAST(floor(e * 255 + 1e-9) AS INT) AS r, 0 AS g,
       CAST(floor(e * e * 255 + 1e-9) AS INT) AS b
FROM found
"""
SQL["chunk_square"] = f"WITH {_square(8)} SELECT doc_id, j, byte_idx, b FROM grid"
SQL["chunk_unrolled"] = SQL["sample_unrolled_step"]
SQL["chunk_unrolled_n"] = f"""
WITH {_grid(_PAGES, "page_id", 16, "(n + 255) // 256", "q * 256", "(q + 1) * 256")},
coloured AS (
  SELECT page_id, quad, j // 16 AS x, {_zigzag_y(16)} AS y,
         CASE WHEN b IS NULL THEN '000000' ELSE {_class("b", "'000000'", "'FFFFFF'", "'377EB8'", "'E41A1C'")} END AS c
  FROM grid)
SELECT page_id, quad, md5(string_agg(c, '' ORDER BY y, x)) AS image_md5 FROM coloured GROUP BY page_id, quad
"""
SQL["chunk_mask"] = SQL["span_mask"]
SQL["training_patches"] = f"""
WITH masks AS ({SQL["span_mask"]}), {_square(8)},
pixels AS (
  SELECT doc_id, j // 8 AS x, {_zigzag_y(8)} AS y, {_class("b", "'000000'", "'FFFFFF'", "'377EB8'", "'E41A1C'")} AS c FROM grid),
parts AS (
  SELECT p.doc_id, CAST(p.y // 4 * 2 + p.x // 4 AS INT) AS patch_id, md5(string_agg(c, '' ORDER BY p.y, p.x)) AS patch_md5,
         CASE WHEN any_value(lang) = 'en' THEN 0 ELSE CAST(max(mask) > 0 AS INT) END AS label
  FROM pixels p JOIN masks m ON m.doc_id = p.doc_id AND m.x = p.x AND m.y = p.y JOIN documents d ON d.doc_id = p.doc_id
  GROUP BY p.doc_id, p.y // 4, p.x // 4)
SELECT *, CAST(1 - label AS DOUBLE) AS is_benign, CAST(label AS DOUBLE) AS is_malevolent FROM parts
"""
SQL["patch_accuracy"] = f"""
WITH {_SCORES}, hits AS (SELECT patch_id // 64 AS batch, CASE WHEN (p1 > p0) = (label = 1) THEN 1 ELSE 0 END AS hit FROM scores)
SELECT round(sum(hit) / ((max(batch) + 1) * 64.0::DOUBLE), 6) AS running_accuracy, round(avg(hit), 6) AS accuracy FROM hits
"""
SQL["colour_block"] = """
SELECT c_custkey, CASE WHEN c_custkey >= c_nationkey * 50 AND c_custkey < c_nationkey * 50 + 500
                       THEN CASE WHEN c_nationkey % 2 = 0 THEN '00ff00' ELSE 'ff0000' END END AS colour
FROM customer
"""
SQL["channels_swapped"] = """
SELECT c_custkey, round((CAST('0x' || substr(m, 5, 2) AS INT) / 255 - 0.5::DOUBLE) / 0.25::DOUBLE, 6) AS r,
       round((CAST('0x' || substr(m, 3, 2) AS INT) / 255 - 0.5::DOUBLE) / 0.25::DOUBLE, 6) AS g,
       round((CAST('0x' || substr(m, 1, 2) AS INT) / 255 - 0.5::DOUBLE) / 0.25::DOUBLE, 6) AS b
FROM (SELECT c_custkey, md5(c_name) AS m FROM customer)
"""
SQL["channel_planes"] = """
SELECT c_custkey, k AS place, CAST('0x' || substr(m, 6 * (k % 5) + 2 * (k // 5) + 1, 2) AS INT)::DOUBLE AS value
FROM (SELECT c_custkey, md5(c_name) AS m FROM customer), range(15) AS places(k)
"""
SQL["chunk_colour_lengths"] = f"SELECT doc_id, n AS n_bytes, true AS same_length FROM ({_DOCS})"
