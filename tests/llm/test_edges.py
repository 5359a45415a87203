"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from siltbed.llm import cover_tree, dart_minhash, flac, mixing, packing, quality, sharding, toxicity, url_filter, warc
from siltbed.llm.queries import RULES, byte_vocabulary

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
TEXTS = [None, "", "   ", "one", "a b c d e f g h", "a b c d e f g h", LONG, "émile\u0000 日本語 \U0001f600", "x" * 5000, "<|endoftext|> it's 1 2"]
# Columns whose names the operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket long, h long, x double, u long, cell int, rank long, part int, __times int, fold string, rep long, id long, block long"


def table(spark, rows=None):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)] if rows is None else rows
    schema = T._parse_datatype_string(CLASH)
    return spark.createDataFrame([(*r, *[None] * (len(schema) - len(r))) for r in rows], schema)


def messy(spark):
    df = table(spark)
    return df.unionByName(df.filter("doc_id > 2")).unionByName(df.filter("doc_id in (1, 4)").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def models():
    toxic = toxicity.fit(["you idiot fool", "fine day here", "you idiot again", "a fine walk"] * 3, [1, 0, 1, 0] * 3, min_z=1.0)
    good = quality.fit(["bad!! bad!!", "good words here", "worse!! !!", "more good words"] * 3, [0, 1, 0, 1] * 3, min_z=1.0)
    return toxic, good


OPS = {
    "sharding": lambda d, m: sharding.shard_documents(d),
    "near_duplicates": lambda d, m: dart_minhash.near_duplicates(d),
    "mixing": lambda d, m: mixing.mix_documents(d),
    "toxicity": lambda d, m: toxicity.score_documents(d, m[0]),
    "packing": lambda d, m: packing.pack_documents(d, byte_vocabulary()),
    "quality": lambda d, m: quality.grade_documents(d, m[1]),
    "flac": lambda d, m: flac.document_features(d),
    "stage quality": lambda d, m: quality.select_quality(d, m[1]),
    "stage toxicity": lambda d, m: toxicity.drop_toxic(d, m[0]),
    "stage near": lambda d, m: dart_minhash.drop_near_duplicates(d),
    "stage mixing": lambda d, m: mixing.apply_mix(d),
}


@pytest.mark.parametrize("name", OPS)
def test_messy_and_empty_documents(spark, models, name):
    df = messy(spark)
    n = df.count()
    rows = OPS[name](df, models).collect()
    if name in ("sharding", "mixing", "toxicity", "quality", "flac"):
        assert len(rows) == n
    if name == "near_duplicates":
        assert sorted(r["doc_id"] for r in rows) == list(range(10))
        classes = {r["doc_id"]: r["class_id"] for r in rows}
        assert classes[4] == classes[5] == 4 and all(classes[i] == i for i in (0, 1, 2, 3, 6, 7, 8, 9))
    if name == "stage near":
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, i) for i in (0, 1, 2, 3, 4, 6, 7, 8, 9)] + [(True, 0)] * 2
    if name.startswith("stage"):
        assert OPS[name](df, models).columns == df.columns
    out = OPS[name](table(spark, []), models)
    assert out.count() == 0


def test_null_and_empty_texts_have_defined_values(spark, models):
    df = messy(spark)
    shards = [r for r in sharding.shard_documents(df).collect() if r["doc_id"] in (0, 1)]
    assert {(r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in shards} == {(1, 0, "rows", None)}
    mixed = {r["doc_id"]: r for r in mixing.mix_documents(df).collect()}
    assert mixed[0]["size"] == mixed[1]["size"] == mixed[2]["size"] == 0 and mixed[0]["taken"] == 0
    media = {r["doc_id"]: r for r in flac.document_features(df).collect()}
    assert media[0]["payload_bytes"] == 64 and media[0]["media_sha256"] == media[1]["media_sha256"]
    pieces = [r for r in packing.pack_documents(df, byte_vocabulary()).collect() if r["doc_id"] in (0, 1)]
    assert {(r["piece"], r["start"], r["length"]) for r in pieces} == {(0, 0, 1)}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, models[0]).collect()}
    assert scores[0] == scores[1] and 0 <= scores[0] <= 1


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Com/en/7#x", "a://b://c/en/", "http://example.com", "http://Ä.com/en/", "http://x.com/" + "en/" * 5000, "http://a.net/de/8\n"]
    df = spark.createDataFrame([(None if i == 3 else i, u, "h", "p", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, verdict string")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(df.unionByName(df), RULES).collect()}
    assert [rows[i]["host"] for i in (0, 1, 2)] == [""] * 3 and rows[0]["rule"] is None and rows[0]["verdict"] == "allow"
    assert (rows[4]["host"], rows[4]["path"], rows[4]["rule"], rows[4]["verdict"]) == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert rows[5]["host"] == "b:" and rows[6]["path"] == "" and rows[7]["host"] == "Ä.com" and rows[7]["rule"] == "com/en/"
    assert rows[8]["rule"] == "com/en/" and rows[9]["rule"] == "net/de/"
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0 and url_filter.filter_urls(df, []).filter("rule is not null").count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
            (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0], 1), (11, [], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.1], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<float>, label int, kept string, copies int")
    out = cover_tree.near_vectors(df).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[12] == (3, 1, False) and got[3] == (0, 3, True)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 13)) and got[None] == (0, None, False)
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def test_warc_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/\r\nX: y", "<p>hi", "x"), (None, "http://b", "", "x")], "page_id long, url string, html string, record string")
    records = warc.response_records(df.unionByName(df))
    out = warc.derivatives(records).collect()
    assert len(out) == 12 and {r["warc_type"] for r in out} == {"metadata", "conversion"}
    assert next(r for r in out if r["page_id"] == 1)["target_uri"] is None
    broken = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "page_id long, record binary")
    assert [r["warc_type"] for r in warc.derivatives(broken).collect()] == ["invalid"]
    assert warc.derivatives(warc.response_records(df.limit(0))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = messy(spark).select("doc_id", "text", "lang", "source", "n_chars")
    root = f"file://{tmp_path}"
    docs.write.parquet(f"{root}/a/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, None, 1), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{root}/a/labels.parquet")
    docs.limit(0).write.parquet(f"{root}/b/documents.parquet")
    labels.limit(0).write.parquet(f"{root}/b/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, f"{root}/b").count() == 0
    out = corpus_pipeline.run(spark, f"{root}/a")
    assert out.columns[:2] == ["doc_id", "piece"] and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    given = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, f"{root}/a")
        assert given.columns == docs.columns
