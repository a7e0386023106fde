"""Completions for a program or a person: one index, one call per query."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from sentria.operators.complete import LIMIT, complete_stored
from sentria.operators.index import SentenceIndex
from sentria.sources.corpus import from_text_tree, from_zip

LOGGER = logging.getLogger("sentria")
#: Fixed value: what a program is told that asks before there is an index.
UNCONFIGURED = "Corpus index has not been configured"


@dataclass(frozen=True)
class Completion:
    completed_sentence: str
    source_text: str
    offset: int
    score: int


class CompletionService:
    """Holds the index of a program. Without one every call is a RuntimeError."""

    def __init__(self, index: SentenceIndex | None = None):
        self._index = index

    def configure(self, index: SentenceIndex) -> None:
        """Use this index from now on; it is kept in memory."""
        self._index = index.keep()

    def completions(self, prefix: str, k: int = LIMIT) -> list[Completion]:
        if self._index is None:
            raise RuntimeError(UNCONFIGURED)
        return [Completion(*row) for row in complete_stored(self._index, prefix, k).collect()]


class Session:
    """What one user types. ``current`` is the input so far: each line replaces it, and one
    with ``#`` anywhere clears it."""

    def __init__(self, search: Callable[[str], list[Completion]]):
        self._search = search
        self.current = ""

    def answer(self, line: str) -> list[Completion] | None:
        """The completions of a line; none at all (``None``) if it starts over."""
        self.current = "" if "#" in line else line
        if "#" in line:
            LOGGER.info("A new query begins.")
            return None
        with _reported(line) as found:
            found += self._search(line)
        return found


@contextmanager
def _reported(line: str) -> Iterator[list[Completion]]:
    """Log what came of a search, or how it failed, and how long it took."""
    found: list[Completion] = []
    asked, began = json.dumps(line, ensure_ascii=False), time.perf_counter()
    try:
        yield found
    except Exception:
        LOGGER.exception("%s failed after %.3f seconds", asked, time.perf_counter() - began)
        raise
    LOGGER.info("%s: %d results, %.3f seconds", asked, len(found), time.perf_counter() - began)


def initialize_corpus(spark: SparkSession, source: str, path: str) -> SentenceIndex:
    """Read an archive (a name that ends in .zip; it may be a pattern for several) or
    a folder of texts, and store its index under ``path``."""
    found = from_zip(spark, source) if source.endswith(".zip") else from_text_tree(spark, source)
    return SentenceIndex.build(spark, found, path)


def configure_logging(path: str) -> logging.Logger:
    """One log file, lines of time, level and message; calling again changes nothing."""
    LOGGER.setLevel(logging.INFO)
    LOGGER.propagate = False
    if not LOGGER.handlers:
        if folder := os.path.dirname(path):
            os.makedirs(folder, exist_ok=True)
        handler = logging.FileHandler(path, encoding="utf-8")
        # fixed value: the form of a line
        handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
        LOGGER.addHandler(handler)
    return LOGGER


def shutdown_logging() -> None:
    """Flush and close the log file."""
    for handler in list(LOGGER.handlers):
        handler.flush()
        handler.close()
        LOGGER.removeHandler(handler)
