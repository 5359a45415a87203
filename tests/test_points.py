import csv

import pytest
from pyspark.sql import functions as F

from siltbed.functions import uniforms, vectors
from siltbed.functions.csv import csv_field
from siltbed.sources import points as P
from siltbed.sources import sinks

ACCEPTED = ["1,2", " 1 , 2 ", "1e5,-2.5", "1,2,", "1,2,,,", "\t1,2\r", "1d,2f", "0x1p3,1", ".5,5."]
REJECTED = ["1", "1,2,3", "1,,2", ",2", "a,2", "", "inf,1", "1,Inf", "+,1", "1;2", "NaN,1", "Infinity,1"]


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "n int, value string")


def test_parse_accepts_and_rejects(spark):
    kept = {r["value"] for r in P.parse_points(lines(spark, ACCEPTED + REJECTED), 2).collect()}
    assert kept == set(ACCEPTED)


def test_parse_values(spark):
    rows = {r["value"]: list(r["x"]) for r in P.parse_points(lines(spark, ACCEPTED), 2).collect()}
    assert rows[" 1 , 2 "] == [1, 2] and rows["1e5,-2.5"] == [1e5, -2.5] and rows["0x1p3,1"] == [8, 1]


def test_parse_keeps_non_finite_on_request(spark):
    kept = {r["value"] for r in P.parse_points(lines(spark, REJECTED), 2, finite_only=False).collect()}
    assert kept == {"NaN,1", "Infinity,1"}


def test_parse_null_line_and_empty_table(spark):
    assert P.parse_points(lines(spark, [None]), 2).count() == 0
    assert P.parse_points(lines(spark, ["1,2"]).limit(0), 2).count() == 0


def test_other_separators(spark):
    assert P.parse_points(lines(spark, ["1|2"]), 2, sep="|").count() == 1
    assert P.parse_points(lines(spark, ["1\t2"]), 2, sep="\t").count() == 1


def test_label_is_dropped(spark):
    rows = P.parse_points(lines(spark, ["1,2,7", "1,2,7,8", "1,2", "1", "1,b,3"]), 2, drop_label=True).collect()
    assert [list(r["x"]) for r in rows] == [[1, 2]] * 3


def test_file_scan_and_first_lines(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_text("\n".join(["x,y,z", *(f"{i},{i + 1},0" for i in range(99))]) + "\n")
    points = P.read_points(spark, str(path), 2, partitions=3)
    assert points.count() == 99 and points.rdd.getNumPartitions() == 3
    assert P.read_points(spark, str(path), 2, max_lines=10).count() == 9  # the malformed line counts
    assert P.with_points(spark, str(path), 2, lambda p: p.count()) == 99
    assert len(P.collect_points(points)) == 99
    with pytest.raises(ValueError):
        P.collect_points(points, limit=5)


def test_features_null_and_float(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0, None],)], "features array<float>")
    assert [list(r["x"]) for r in P.from_features(df).collect()] == [[1, 2]]
    assert P.to_features(P.from_features(df)).first()["features"].toArray().tolist() == [1, 2]


def test_negative_weights_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, -1.0), (1.0, None)], "a double, w0 double")
    assert P.from_columns(df, ["a"], "w0").count() == 1


def test_mixture_centers_are_apart(spark):
    centers = P.mixture_centers(5, 3)
    assert sorted(c[0] for c in centers) == [0, 20, 40, 60, 80]
    assert P.mixture(spark, 100, 5, 3).count() == 100


def test_sqdist_and_nearest(spark):
    df = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("x"))
    row = df.select(
        vectors.sqdist(F.col("x"), vectors.literal([3, 4])).alias("d"), vectors.distance(F.col("x"), vectors.literal([3, 4])).alias("r"),
        vectors.sqdist(F.col("x"), vectors.literal([3, 4, 5])).alias("other"), vectors.nearest(F.col("x"), vectors.literal_centers([[1, 0], [0, 1], [1, 0]])).alias("n")).first()
    assert (row["d"], row["r"], row["other"]) == (25, 5, None) and (row["n"]["cid"], row["n"]["d2"]) == (0, 1)
    assert vectors.recommended_size(25) == 5000


def test_uniforms_agree(spark):
    df = spark.range(20).select(uniforms.uniform_column(42, "s", F.col("id")).alias("u"))
    assert [r["u"] for r in df.collect()] == [uniforms.uniform(42, "s", i) for i in range(20)]
    assert uniforms.uniform(42, "0", 1) == 0.9884146954864264


def test_csv_field_and_file(spark, tmp_path):
    values = ["plain", "a,b", 'say "x"', "two\nlines", "cr\rhere", ""]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(csv_field(F.col("v"))).collect()]
    assert got == ["plain", '"a,b"', '"say ""x"""', '"two\nlines"', '"cr\rhere"', ""]
    rows = [('d,"1"', "m", 10, 200, 1, 2026, 1.8070840580010693e11)]
    sinks.write_csv(sinks.results(spark, rows), str(tmp_path / "out"))
    file = next((tmp_path / "out").glob("part-*.csv"))
    text = file.read_text()
    assert text.splitlines()[0] == "dataset,method,k,m,run,seed,cost" and "1.8070840580010693E11" in text
    assert next(csv.reader(text.splitlines()[1:]))[0] == 'd,"1"'
    assert sinks.read_csv(spark, str(tmp_path / "out")).collect()[0][6] == rows[0][6]
