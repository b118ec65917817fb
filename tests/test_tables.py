from pyspark.sql import functions as F

from boardloom import tables


def test_once(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (1, "a"), (None, "c"), (None, "d"), (3, None)]
    spark.createDataFrame(rows, "id long, v string").repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    got = tables.table_once(spark, str(tmp_path), "t", "id", "v")
    assert got.columns == ["id", "v"] and sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a"), (2, "b"), (None, "c"), (None, "d"), (3, None)], key=str)
    spark.createDataFrame([], "id long, v string").write.parquet(str(tmp_path / "e.parquet"))
    assert tables.table_once(spark, str(tmp_path), "e", "id", "v").count() == 0


def test_blanks(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n",), ("\xa0 ﻿",), (" x ",), ("\xa0y　",)], "t string")
    got = df.select(tables.blank(F.col("t")).alias("b"), tables.stripped(F.col("t")).alias("s")).collect()
    assert [r["b"] for r in got] == [True] * 4 + [False] * 2 and [r["s"] for r in got] == [None, "", "", "", "x", "y"]


def test_names():
    assert tables.clear_name(["a", "B"], "b") == "b_1" and tables.clear_name(["b", "b_1"], "b") == "b_2" and tables.clear_name([], "x") == "x"


def test_written_survives(spark):
    df = tables.written(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 10 and "parquet" in df._jdf.queryExecution().toString().lower()


def test_repeats_are_told_once_a_session(spark, tmp_path):
    """The keys that come again are written once for a state of the table, anew where the table or what was written changes."""
    import shutil

    from boardloom import tables

    folder = str(tmp_path)
    write = lambda rows: spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    read = lambda: sorted(map(tuple, tables.table_once(spark, folder, "t", "k", "v").collect()), key=str)
    made = lambda: [v for k, v in spark.__dict__["_boardloom_once"].items() if k[1] == f"{folder}/t.parquet"]
    write([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")])
    want = [(1, "a"), (2, "b"), (None, "c"), (None, "c")]
    assert read() == want and read() == want and len(made()) == 1
    for f in made()[0].inputFiles():
        shutil.rmtree(f.removeprefix("file://").rsplit("/", 1)[0], ignore_errors=True)
    assert read() == want and len(made()) == 1
    write([(3, "x"), (3, "x"), (3, "x")])
    assert read() == [(3, "x")] and len(made()) == 2
