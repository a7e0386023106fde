"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentria.shared import delete, new_path, write_at, written  # noqa: F401  for the operators

#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 256
#: Bytes of an Arrow batch, about: Spark bounds only its rows, and a task has a batch in
#: the JVM, on its way, and in the worker.
BATCH_BYTES = 4 << 20
#: Bits that say which keys a table may hold: about so many for each key, and at most.
MARKS, MOST_MARKS = 8, 1 << 25


def bounded_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches are bounded by bytes too, unless it bounds
    them already. Operators on whole texts ask for it; it stays, because what they return
    runs later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: Spark's hold up to 10,000 texts, and a
    worker has little memory beside its executor's heap."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, for working columns."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def text_key(text: Column | str) -> Column:
    """60 bits of a text's MD5 as a long, -1 for null: together with an id it names a
    text even where other texts have the same id. DuckDB can compute it too."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1).cast("long"))


def single_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, text) of the rows with an id and a text; a row repeated under
    its id is there once. Only texts that do repeat are shuffled whole."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    again = written(rows.groupBy("id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    once = rows.join(again, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"])
    return rows.join(again, ["id", "text_key"], "left_anti").unionByName(once)


def apart(rows: DataFrame, on: list[Column | str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``on`` may be among ``keys`` (a stored table of such columns),
    and those that are not. Wide rows that surely have no partner need not be shuffled.

    What is broadcast are bits, one at the hash of each key, so an eighth of the others at most
    come along with the first; beyond four million keys, of which the bits become no more, a
    growing share of them.
    """
    slots = max(64, min(MARKS * keys.count(), MOST_MARKS))
    slot, word, bits = (free_name(rows, c) for c in ("_slot", "_word", "_bits"))
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(slots).cast("long"))
    bit = lambda: F.col(slot).bitwiseAND(63).cast("int")
    marks = keys.select(place(keys.columns).alias(slot)).groupBy(F.shiftright(slot, 6).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit())).alias(bits))
    met = rows.withColumn(slot, place(on)).join(F.broadcast(marks), F.shiftright(slot, 6) == F.col(word), "left")
    hit = F.coalesce(F.getbit(bits, bit()) == 1, F.lit(False))
    return tuple(met.where(where).drop(slot, word, bits) for where in (hit, ~hit))


def held_out(doc_id: Column | str, remainder: int = 2) -> Column:
    """True for the documents that no model may learn from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == remainder, F.lit(False))


def hashed_sample(rows: DataFrame, label: str, key: str, n: int, most: int = 4096) -> DataFrame:
    """``n`` rows of each label (all, if it has fewer): the first by a hash of ``key``. Of
    more than ``most`` labels the commonest are sampled.

    Labels are counted first. Of one with many rows only those whose hash falls in
    a share that holds about 4 n of them are ranked, so what the ranking gathers of
    a label does not grow with the table.
    """
    common = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most)
    counts = {r[0]: r[1] for r in common.collect()}
    parts = 1 << 30
    if len(counts) == most:
        rows = rows.where(F.col(label).isin(list(counts)))
    bound = F.lit(parts)
    for value, count in counts.items():
        if count > 4 * n:
            bound = F.when(F.col(label) == F.lit(value), int(parts * 4 * n / count) + 1).otherwise(bound)
    near = rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) < bound)
    others = [c for c in rows.columns if c not in (label, key)]
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.pmod(F.xxhash64(key), F.lit(parts)), key, *others))
    return near.withColumn("place", place).where(F.col("place") <= n)
