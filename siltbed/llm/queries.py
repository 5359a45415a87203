"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import cover_tree, dart_minhash, flac, mixing, packing, quality, sharding, toxicity, url_filter, warc
from siltbed.storage import table

RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def byte_vocabulary() -> str:
    """The installed byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).drop("source")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derivatives(warc.response_records(table(spark, sf_dir, "pages")))
    return out.withColumn("record_bytes", F.length("record").cast("long")).withColumn("record_sha1", F.sha1("record")).drop("record")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer or byte_vocabulary())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.document_features(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_sharding, op3_cover_tree, op4_dart_minhash, op5_mixing, op6_warc, op7_toxicity, op8_best_fit_packing, op9_quality, op10_media_flac)}


_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)

OP1 = f"""
WITH r(verdict, rhost, rpath) AS (VALUES {_RULE_ROWS}),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM s),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.page_id, p.host, p.path, r.verdict, rhost || rpath AS rule,
      row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


_REACH = """r(u, c) AS (SELECT {key}, {key} FROM {nodes} UNION SELECT l.v, r.c FROM r JOIN l ON r.u = l.u),
c AS (SELECT u, min(c) AS c FROM r GROUP BY u)"""

OP3 = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
{_REACH.format(key="vec_id", nodes="e")}
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM e JOIN c ON e.vec_id = c.u LEFT JOIN n ON n.u = e.vec_id
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9_a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [array_to_string(ws, ' ')] END) AS k FROM w WHERE len(ws) > 0),
k AS (SELECT doc_id, k, count(*) AS n FROM s GROUP BY doc_id, k),
t AS (SELECT doc_id, sum(n) AS n FROM k GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, sum(least(a.n, b.n)) AS m FROM k a JOIN k b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN t x ON x.doc_id = u JOIN t y ON y.doc_id = v WHERE m::DOUBLE / (x.n + y.n - m)::DOUBLE >= 0.8::DOUBLE),
{_REACH.format(key="doc_id", nodes="documents")}
SELECT u AS doc_id, c AS class_id, u = c AS kept FROM c
"""


OP5 = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '42', doc_id::VARCHAR, size::VARCHAR)), 1, 15))::BIGINT AS h FROM d),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * words::DOUBLE / w, source NULLS LAST) AS k, (sum(words) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, total - coalesce(sum(3 * words) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
      sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM o),
f AS (SELECT min(k) AS k FROM l WHERE 3 * words * weight >= spare * w),
t AS (SELECT l.source, l.n, l.words, CASE WHEN l.k < f.k THEN (3 * l.words)::DOUBLE ELSE (e.spare * l.w)::DOUBLE / e.weight::DOUBLE END AS target
      FROM l, f JOIN l e ON e.k = f.k),
g AS (SELECT *, round_even(target, 0)::BIGINT AS goal, least(1048576, greatest(1, pow(2, ceil(log2(n / 2000.0)))))::BIGINT AS cells FROM t),
r AS (SELECT h.doc_id, h.size, g.words AS source_size, g.target, g.goal,
      coalesce(sum(h.size) OVER (PARTITION BY h.source ORDER BY h.h % g.cells, h.h, h.doc_id NULLS FIRST, h.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size * size + greatest(0, least(size, goal % source_size - earlier)) END)::BIGINT AS taken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op5_mixing": OP5, "op3_cover_tree": OP3, "op4_dart_minhash": OP4}
