"""Queries of the corpus operators: op<N>_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismlake.llm import ann, decontam, lexical, licences, line_dedup, mixture, near_dedup, quality, quoting, repair, sharding, toxicity, warc
from prismlake.llm._shared import table


def op1_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op1_vp_tree(table(spark, sf_dir, "embeddings"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.op2_pivotal_mix(table(spark, sf_dir, "documents"))


def op3_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.op3_quote_links(table(spark, sf_dir, "conversations"))


def op4_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4_toxicity_knn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5_bayes_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op6_fuzzy_lines(table(spark, sf_dir, "documents"))


def op7_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op7_icws_near_dedup(table(spark, sf_dir, "documents"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op8_licence_scan(table(spark, sf_dir, "documents"))


def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9_bin_packing(table(spark, sf_dir, "documents"))


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op10_fm_index(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.op11_block_max_wand(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op12_warc_captures(table(spark, sf_dir, "pages"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op13_repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


_VECTORS = "v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0)"
_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_vp_tree": f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.x, q.x) AS score FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20""",
    "op10_fm_index": f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT item, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT uid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
o AS (SELECT uid, i, dw.k, item FROM dw JOIN p ON dw.k = p.k AND dw.phrase = p.phrase),
h AS (SELECT uid, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT uid, unnest(range(i, i + k)) AS j FROM o) GROUP BY uid),
f AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM o) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (uid) LEFT JOIN f USING (uid)""",
    "op11_block_max_wand": f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS.format("text")} AS w FROM documents), n AS (SELECT *, len(w) AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n), tf AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(w) AS term FROM n) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({_WORDS.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item, item_id, uid, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n USING (uid), g GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 20""",
    "op12_warc_captures": """WITH p AS (SELECT row_number() OVER () AS uid, page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, uid) AS place, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, uid) AS kept FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN kept END AS refers_to FROM d""",
    "op13_repair": r"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE WHEN x = 1 THEN '' WHEN x = 2 THEN translate(text, '.!?', '') ELSE text END AS text, x FROM (SELECT *, xor(CAST(4294967295 AS BIGINT),
list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(k, ''), lambda y: [CAST(ascii(y) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))]), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))) % 20 AS x FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, dup) AS i FROM (SELECT conv_id, turn, role, text, unnest(CASE WHEN x = 3 THEN [0, 1] ELSE [0] END) AS dup FROM h WHERE x <> 0)),
f AS (SELECT *, CASE WHEN rtrim(text, E' \t\n\x0b\x0c\r') = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(rtrim(text, E' \t\n\x0b\x0c\r'), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM r),
t(s, r, d) AS (VALUES (0, 1, 1), (0, 2, 2), (1, 2, 2), (3, 2, 2), (2, 3, 3)), e(n, p) AS (VALUES (0, ''), (1, 'I'), (2, 'II')),
mid AS (SELECT s.s, n, p, CASE WHEN n = 0 THEN s.s WHEN (s.s = 2) = (n = 1) THEN 3 ELSE 2 END AS z FROM (VALUES (0), (1), (2), (3)) AS s(s), e),
m AS (SELECT s, z AS d, NULL AS r, false AS stays, 5 * n + 2 AS cost, p || 'D' AS l FROM mid UNION ALL SELECT mid.s, t.d, t.r, true, 5 * n, p || 'K' FROM mid JOIN t ON t.s = z UNION ALL SELECT mid.s, CASE WHEN z = 2 THEN 3 ELSE 2 END, NULL, true, 5 * n + 1, p || 'R' FROM mid),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {'cost': 0, 'audit': '', 'body': CAST(NULL AS VARCHAR)} AS b FROM c UNION ALL
SELECT w.conv_id, w.i + 1, m.d, min({'cost': w.b.cost + m.cost + CASE WHEN stays AND fault = 3 THEN 5 ELSE 0 END, 'audit': w.b.audit || l, 'body': CASE WHEN l = 'D' THEN w.b.body ELSE concat_ws(E'\n', w.b.body, CASE WHEN l[1] = 'I' THEN CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END END, CASE WHEN l[2] = 'I' THEN CASE WHEN w.s = 2 THEN 'user:' ELSE 'assistant:' END END,
CASE right(l, 1) WHEN 'K' THEN f.role || ':' || text WHEN 'R' THEN CASE WHEN m.d = 3 THEN 'assistant:' ELSE 'user:' END || text END) END}) FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN m ON m.s = w.s AND (m.r IS NULL OR m.r = f.r) AND (NOT stays OR fault NOT IN (1, 2)) GROUP BY w.conv_id, w.i, m.d),
a AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT w.conv_id, min({'cost': b.cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': b.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'body': concat_ws(E'\n', b.body, CASE s WHEN 1 THEN E'user:\nassistant:' WHEN 2 THEN 'assistant:' END)}) AS b FROM w LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(n, 0) GROUP BY w.conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(coalesce(b.body, '')) AS repaired_sha256 FROM z LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM z.conv_id""",
}
