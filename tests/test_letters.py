"""Capitals against DuckDB, and a case that begins with a letter without a capital of one letter in Spark."""

from quarry.functions import text as T
from quarry.plans import more


def test_every_letter(spark):
    import duckdb

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    want = dict(duckdb.connect().execute("SELECT i, upper(chr(i::INT)) FROM (SELECT unnest(?) AS i)", [points]).fetchall())
    df = spark.createDataFrame([(c, chr(c)) for c in points], "i long, c string")
    assert {r.i: r.u for r in df.select("i", T.upper_by_letter(df["c"]).alias("u")).collect() if r.u != want[r.i]} == {}


def test_case_with_sharp_s(spark, tmp_path):
    spark.createDataFrame([("q1", "Er\u00dfie zwei")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = more.eval_cases(spark, str(tmp_path)).filter("kind = 'symbol'").collect()
    assert [r.item for r in found] == ["ER\u1e9eIE"]
