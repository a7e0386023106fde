"""Token counts by byte-pair merging on a heap and a linked list.

Count = initial symbols - merges. No token id is put out; ids only name symbols.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from sentria.llm.common import slices
from sentria.llm.wordbpe import WordBpe, word_bpe

#: Chunks of text up to this length are remembered, this many of them per process.
MEMO_CHARS, MEMO_ENTRIES = 48, 250_000


class Counter:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self._memo: dict[str, int] = {}
        self._words: dict[str, int] = {}

    def merges_in(self, ids: list[int]) -> int:
        """How many merges a word's symbols allow: pop the lowest-ranked adjacent
        pair (leftmost of equals), join it, offer the pairs with its neighbours.
        Entries whose symbols have changed since are stale and skipped."""
        merges, n = self.bpe.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapify(heap)
        done = 0
        while heap:
            _, i, a, b, merged = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            done += 1
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, ids[k]))
                if found:
                    heappush(heap, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], merged))
                if found:
                    heappush(heap, (found[0], h, ids[h], merged, found[1]))
        return done

    def _word(self, word: str | int) -> int:
        if isinstance(word, int):
            return 1
        count = self._words.get(word)
        if count is None:
            ids = self.bpe.symbols(word.encode("utf-8"))
            n = len(ids)
            count = n - self.merges_in(ids)
            if len(word) <= MEMO_CHARS:
                if len(self._words) >= MEMO_ENTRIES:
                    self._words.clear()
                self._words[word] = count
        return count

    def _chunk(self, chunk: str) -> int:
        count = sum(map(self._word, self.bpe.words(chunk)))
        if len(chunk) <= MEMO_CHARS:
            if len(self._memo) >= MEMO_ENTRIES:
                self._memo.clear()
            self._memo[chunk] = count
        return count

    def count(self, text: str) -> int:
        known, make = self._memo.get, self._chunk
        return sum([known(c) or make(c) for c in self.bpe.chunks(text)])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each text, and whether it has over ``limit`` tokens.

    One row per input row, in one pass without a shuffle. A null text counts as
    empty (0 bytes, 0 tokens). Special strings inside a text count one each, as in
    the library. Rows with a null or repeated id come out as they are; other
    columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = Counter(word_bpe(path))  # what is remembered of texts goes with the task
        for batch in slices(batches):
            sizes, counts = [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                counts.append(c.count(text))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
