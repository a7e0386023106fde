"""Text functions of the corpus and of queries, as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The ASCII punctuation that counts as space (\p{Punct} in a Java
#: pattern), and all Unicode white space (\s is ASCII only there).
PUNCTUATION = string.punctuation
WHITE = r"\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: \r\n, \r or \n; one class at each character is several times as fast as three branches.
LINE_END = r"[\n\r](?:(?<=\r)\n)?"
#: White space and punctuation together. Single characters below U+0100 are one lookup in a
#: Java class, where every range and every named class is a test of its own.
_NEAR = "".join(rf"\x{ord(c):02x}" for c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0" + PUNCTUATION)
_FAR = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"


def normalize(text: Column | str) -> Column:
    """Lower case, punctuation as spaces, single spaces, none at the ends."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(text), f"[{_NEAR}{_FAR}]+", " "))


def normalize_query(spark: SparkSession, text: str) -> str:
    """``normalize`` of one string, by the engine that normalises the corpus. A
    literal over a local relation folds in the optimizer, so no job runs."""
    return spark.sql("VALUES (1)").select(normalize(F.lit(text))).collect()[0][0]


def is_blank(line: Column | str) -> Column:
    """Nothing but white space; punctuation counts as text here."""
    return ~F.rlike(F.col(line) if isinstance(line, str) else line, F.lit(f"[^{WHITE}]"))


def trigrams(text: Column | str) -> Column:
    """The distinct three-character windows, spaces included; none if too short."""
    return windows(text, 3)


def windows(text: Column | str, size: int) -> Column:
    """The distinct windows of ``size`` characters: one pass over the text, a look
    ahead at every character."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def query_trigrams(query: str) -> list[str]:
    return sorted({query[i : i + 3] for i in range(len(query) - 2)})
