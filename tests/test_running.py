import random

from pyspark.sql import functions as F

from sentria.operators.running import numbered, running
from sentria.shared import passing, shared_folder, written


def wanted(rows):
    out, at = {}, {}
    for i, (g, k, v) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or "", r[1][1])):
        n, x = at.get(g, (0, 0))
        at[g] = n + v, x ^ v
        out[i] = at[g]
    return {i: (*out[i], at[rows[i][0]][0]) for i in out}


def test_running_totals_of_groups_that_cross_partitions(spark):
    """One group holds most rows, so it goes through several partitions; null is a group."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 30 + ["a", "b", "c", None]), k, rng.randrange(1 << 40)) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, g string, k long, v long").repartition(5)
    got = running(df, ["g"], [F.col("k").asc()], {"n": ("sum", F.col("v")), "x": ("xor", F.col("v"))}, whole=("n",))
    assert got.columns == ["i", "g", "k", "v", "n", "x", "n_all"]
    assert {r.i: (r.n, r.x, r.n_all) for r in got.collect()} == wanted(rows)
    assert running(df.limit(0), ["g"], [F.col("k").asc()], {"n": ("sum", F.col("v"))}).collect() == []


def test_numbers_have_no_gap_and_no_single_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(3)
    got = numbered(df, [F.col("k").desc()], "n")
    assert [r.n for r in got.orderBy(F.desc("k")).collect()] == list(range(5000))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_block_leaves_no_tables(spark):
    df, folder = spark.range(3), shared_folder(spark)
    fs = spark._jvm.org.apache.hadoop.fs
    count = lambda: len(fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs.Path(folder)))
    before = count()
    with passing(spark):
        assert written(written(df, "x"), "y").count() == 3 and count() == before + 2
        with passing(spark):
            written(df, "z")
        assert count() == before + 2
    assert count() == before
