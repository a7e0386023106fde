"""Texts that have no partner are not shuffled, and what has one is found."""

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

import sentria.llm.common as c
from sentria.llm import jaccard as j
from sentria.llm.simhash import representatives
from sentria.shared import setting

BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
TEXTS = [(i, " ".join(f"w{i}_{k}" for k in range(40))) for i in range(300)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_apart_loses_and_doubles_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(i if i % 7 else None, f"t{i}", "clash") for i in range(3000)], "id long, text string, _slot string")
    keys = c.written(rows.where("id % 10 = 0").select("id", F.col("text").alias("t")), "keys")
    wanted = {tuple(r) for r in rows.where("id % 10 = 0").collect()}
    for most in (c.MOST_MARKS, 64):
        monkeypatch.setattr(c, "MOST_MARKS", most)
        maybe, others = c.apart(rows, ["id", "text"], keys)
        assert maybe.dtypes == others.dtypes == rows.dtypes
        found = [tuple(r) for r in maybe.collect()]
        assert sorted(map(str, found + [tuple(r) for r in others.collect()])) == sorted(str(tuple(r)) for r in rows.collect())
        assert wanted <= set(found) and (most == 64 or len(found) < len(wanted) + 600)
    maybe, others = c.apart(rows, ["id", "text"], c.written(keys.limit(0), "keys"))
    assert maybe.count() == 0 and others.count() == 3000


def test_texts_stay_where_they_are_however_many_members(spark, monkeypatch):
    """Tables too large to be broadcast: the only texts in a shuffle are those picked by marks."""
    near = [(1000 + i, f"{t} more") for i, t in TEXTS[:30]]
    docs = c.written(spark.createDataFrame(TEXTS + near, "doc_id long, text string"), "docs")
    plans, write = {}, DataFrameWriter.parquet

    def noted(self, path, *args, **kw):
        plans[path.rpartition("/")[2].partition("-")[0]] = plan(self._df)
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    with setting(spark, BROADCAST, "-1"):
        kept = representatives(docs, groups=j.groups)
        assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in TEXTS]
        for text in (plans["texts"], plan(kept)):
            assert "BroadcastHashJoin" in text and "_slot" in text
