"""The corpus pipeline: stages applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and returns a table with the columns of ``documents``; the last returns what
the encoder gives for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm import langid
from sentria.llm.bpe import encode_decode
from sentria.llm.common import table, written
from sentria.llm.decontam import uncontaminated
from sentria.llm import jaccard
from sentria.llm.linededup import without_repeats
from sentria.llm.queries import TOKENIZER
from sentria.llm.simhash import representatives


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language that the labels know go."""
    return langid.accepted(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or
    more) the document with the smallest id stays. SimHash's tiles find them first and are
    confirmed exactly; bands find those whose fingerprints are further apart."""
    return representatives(docs, groups=jaccard.groups)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines, however short, that an earlier document or an earlier place has go from the texts."""
    out = without_repeats(docs, min_words=1)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return encode_decode(docs, TOKENIZER)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("line_dedup", line_dedup),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: SQL has neither the language model nor SimHash's XXH64: the pipeline is tested
#: against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
