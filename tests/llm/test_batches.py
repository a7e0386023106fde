import pyarrow as pa
from pyspark.sql import functions as F

from sentria.llm.common import BATCH_BYTES
from sentria.llm.linededup import without_repeats


def test_batches_of_large_texts_are_bounded_by_bytes(spark):
    """40 texts of a million characters come to a worker a few at a time, all of them."""
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(char(97 + id % 26), 1000000)").alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["n", "held"])

    without_repeats(docs)
    found = docs.mapInArrow(size, "n long, held long").collect()
    assert sum(r.n for r in found) == 40
    assert max(r.held for r in found) < 2 * BATCH_BYTES
