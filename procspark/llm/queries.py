"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cdc, decontam, divergence, licenses, lines, mixing, quality, radix, rpforest, simhash, spelling, tokens, toxicity
from .common import read, scratch_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(read(spark, sf_dir, "documents")))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    tokens.materialise(read(spark, sf_dir, "documents"), path)
    return tokens.digest(tokens.read_shards(spark, path))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.digest(cdc.dedup_chunks(read(spark, sf_dir, "documents")))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.digest(radix.repeated_windows(read(spark, sf_dir, "documents")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(read(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scans": op2_license_scans,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_token_shards": op6_token_shards,
    "op7_chunk_dedup": op7_chunk_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_line_dedup": op13_line_dedup,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: SQL where it can express an operator's rows; the others are compared with brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op4_decontamination": f"""WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item, array_to_string(ws[k:k + 12], ' ') AS win, least(13, len(ws)) AS n FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d),
h AS (SELECT doc_id, k, q.n, item FROM (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM p, (SELECT DISTINCT n FROM w) WHERE k + n - 1 <= len(ws)) q JOIN w ON w.win = q.win AND w.n = q.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op8_embedding_near_dedup": """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM e UNION SELECT k.b, r.root FROM r JOIN k ON k.a = r.node)
SELECT e.vec_id, coalesce(g.n, 0) AS n_links, m.root AS component_id, e.vec_id = m.root AS kept
FROM e JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) m ON m.node = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM k GROUP BY 1) g ON g.a = e.vec_id""",
    "op10_suffix_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, h, len(h) // 2 AS n FROM d),
c AS (SELECT r, doc_id, n, j, substr(h, 500 * j + 1, 598) AS h FROM (SELECT *, unnest(range(0, n // 250 + 1)) AS j FROM p WHERE n >= 50)),
w AS (SELECT r, doc_id, 250 * j + i AS k, substr(h, 2 * i + 1, 100) AS x FROM (SELECT *, unnest(range(0, least(250, n - 49 - 250 * j))) AS i FROM c)),
f AS (SELECT x, min(doc_id) AS first FROM w GROUP BY 1),
z AS (SELECT r, k FROM w JOIN f USING (x) WHERE doc_id > first OR (doc_id IS NULL AND first IS NOT NULL)),
s AS (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM z),
g AS (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM s),
t AS (SELECT r, g, min(k) AS a, max(k) + 50 AS b FROM g GROUP BY 1, 2),
e AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM t),
q AS (SELECT e.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS upto, sum(b - a) AS gone, count(*) AS spans FROM e JOIN p USING (r) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256 FROM p LEFT JOIN q USING (r)""",
    "op11_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
z AS (SELECT lang, source, sum(n) AS z FROM c GROUP BY 1, 2),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(z.z, 0) + 2 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN z ON z.lang = g.lang AND z.source = g.source),
y AS (SELECT lang, sum(n) AS z FROM c GROUP BY 1),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(y.z) + 2 * any_value(v.v)) AS q FROM c JOIN y USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 4
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)),
te AS (SELECT m.lang, m.source, 'term' AS part, m.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM m JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM (FROM pr UNION ALL FROM te) QUALIFY part = 'pair' OR rank <= 10""",
    "op13_line_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
g AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT r, doc_id, i, line, g.k IS NULL OR doc_id IS NOT DISTINCT FROM g.last AS stays FROM l LEFT JOIN g ON g.k = l.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM s GROUP BY r""",
}
