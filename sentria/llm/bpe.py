"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Why a bounded lookahead suffices. Let two symbol streams share a prefix p and run
the merge list, in rank order, over both. Their segmentations agree up to a
frontier, at first the end of p. Rule (u, v) moves the frontier only when u is the
last agreed token and v starts at the frontier in one stream and not in the other;
the frontier then falls back by the length of u. In the stream that merged, the
token at the frontier now starts with u; in the other, u is a token there. So if
rule (u', v') moves the frontier next, its rank is higher and u is a token on the
left edge of v'. The greatest total length of u over such chains of rules bounds
how far the frontier can ever fall back: with ``lookahead(rules)`` symbols after
it, a token of the prefix can no longer change. A boundary of the final
segmentation is crossed by no merge, so encoding may restart at it with nothing
remembered.

That bound is the merge list's, for the worst text. For a text at hand the same
chains are followed over the tokens that it really had, with the ranks at which each
came and went: only rules that can still touch a token count. What no chain reaches is
stable at once, so tokens of ordinary words come out before the words end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame

from sentria.llm.common import bounded_batches, slices
from sentria.llm.wordbpe import OpenChunk, WordBpe, byte_symbols, pieces, word_bpe

#: Words up to this length are remembered,
MEMO_CHARS = 48
#: and this many bytes of them, about, with what an entry weighs by itself.
MEMO_BYTES, ENTRY_BYTES = 144 << 20, 400
#: Characters of a piece of text, about.
PIECE = 1 << 14

_ID_BITS = 24
_ID, _NEVER = (1 << _ID_BITS) - 1, 1 << 62


def lookahead(rules: list[tuple[str, str]]) -> int:
    """Symbols after a token that settle it, from the merge list alone.

    ``reach[u]``: the greatest fall-back of a chain whose latest rule merges u on
    the left. Rules come in rank order, so each is settled when it is read.
    """
    width = {}  # token -> length in symbols
    left_of: dict[str, str] = {}  # token -> left part of the rule that makes it
    reach: dict[str, int] = {}
    most = 0
    for u, v in rules:
        for t in (u, v):
            width.setdefault(t, 1)
        edge, before = v, 0
        while edge is not None:
            before = max(before, reach.get(edge, 0))
            edge = left_of.get(edge)
        now = width[u] + before
        reach[u] = max(reach.get(u, 0), now)
        most = max(most, now)
        left_of.setdefault(u + v, u)
        width.setdefault(u + v, width[u] + width[v])
    return most


class Encoder:
    """What transducers of one merge list share."""

    def __init__(self, bpe: WordBpe, block: int = 16):
        self.bpe, self.block = bpe, block
        self.lookahead = lookahead(bpe.rules)
        #: rank and merged id of a pair in one number, so that min() finds the rule
        self._ranked = {pair: rank << _ID_BITS | merged for pair, (rank, merged) in bpe.merges.items()}
        #: token -> lowest rank of a rule with it on the left
        self._left: dict[int, int] = {}
        #: (token, another) -> lowest and highest rank of a rule that has the first on the
        #: left, and on its right a token which begins with the other
        self._meets: dict[int, tuple[int, int]] = {}
        begins: dict[int, set[int]] = {}  # token -> tokens on its left edge, itself included
        for (u, v), (rank, merged) in sorted(bpe.merges.items(), key=lambda rule: rule[1][0]):
            self._left[u] = min(rank, self._left.get(u, rank))
            for edge in begins.get(v, (v,)):
                low, high = self._meets.get(u << _ID_BITS | edge, (rank, rank))
                self._meets[u << _ID_BITS | edge] = min(low, rank), max(high, rank)
            begins.setdefault(merged, {merged}).update(begins.get(u, (u,)))

    def _settle(self, ids: list[int]) -> list[int]:
        """The segmentation of a run of symbols, in place: again and again the lowest
        rank of all adjacent pairs, the leftmost of equals."""
        found = self._ranked.get
        pairs = list(map(found, zip(ids, ids[1:]), repeat(_NEVER)))
        while pairs:
            best = min(pairs)
            if best == _NEVER:
                break
            i, merged = pairs.index(best), best & _ID
            ids[i] = merged
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = found((ids[i - 1], merged), _NEVER)
            if i < len(pairs):
                pairs[i] = found((merged, ids[i + 1]), _NEVER)
        return ids

    def stable(self, symbols: list[int]) -> tuple[list[int], int]:
        """The tokens of a run of symbols that nothing behind it can change, and how
        many symbols those are.

        Settles the run, keeping for every place the tokens that ever ended there, where
        they began, and the rank at which each was merged with what stands before it.
        Then every chain of rules is followed from the end of the run back.
        """
        found, n = self._ranked.get, len(symbols)
        ids, nodes = list(symbols), [[s, i, i + 1, _NEVER] for i, s in enumerate(symbols)]
        at = list(range(n))  # places in nodes
        ended: list[list[int]] = [[], *([i] for i in range(n))]
        pairs = list(map(found, zip(ids, ids[1:]), repeat(_NEVER)))
        while pairs:
            best = min(pairs)
            if best == _NEVER:
                break
            i, merged = pairs.index(best), best & _ID
            right = nodes[at[i + 1]]
            right[3] = best >> _ID_BITS
            ended[right[2]].append(len(nodes))
            nodes.append([merged, nodes[at[i]][1], right[2], _NEVER])
            ids[i], at[i] = merged, len(nodes) - 1
            del ids[i + 1], at[i + 1], pairs[i]
            if i:
                pairs[i - 1] = found((ids[i - 1], merged), _NEVER)
            if i < len(pairs):
                pairs[i] = found((merged, ids[i + 1]), _NEVER)
        reached, seen, todo = n, {}, []

        def move(place: int, token: int, rank: int) -> None:
            if seen.get((place, token), _NEVER) > rank:
                seen[place, token] = rank
                todo.append((place, token, rank))

        for k in ended[n]:
            token, start, _, gone = nodes[k]
            rank = self._left.get(token, _NEVER)
            if rank < gone:
                move(start, token, rank)
        while todo:
            place, token, rank = todo.pop()
            reached = min(reached, place)
            for k in ended[place]:
                before, start, _, gone = nodes[k]
                low, high = self._meets.get(before << _ID_BITS | token, (_NEVER, -1))
                if high > rank and low < gone:
                    move(start, before, max(low, rank))
        out = [(t, nodes[k][2]) for t, k in zip(ids, at) if nodes[k][2] <= reached]
        return [t for t, _ in out], out[-1][1] if out else 0

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Token ids of one word, as soon as they are stable."""
        t = Transducer(self)
        for s in symbols:
            yield from t.push([s])
        yield from t.end()


class Transducer:
    """Symbols in, token ids out as soon as they are stable.

    What is held is looked at again when it has grown by a block or by half, so a symbol
    is settled a few times at most. Once the lookahead of the merge list stands behind a
    token, that token is stable for certain, so what is held is bounded, whatever has been
    read. A word's last symbol bears the end marker and merges with nothing after it, so
    there all that is held is stable.
    """

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self._held: list[int] = []
        self._room = encoder.block

    def push(self, symbols: list[int]) -> list[int]:
        self._held += symbols
        out: list[int] = []
        while len(self._held) > self._room:
            tokens, used = self.encoder.stable(self._held[: self._room])
            out += tokens
            del self._held[:used]
            left = self._room - used
            self._room = left + max(self.encoder.block, left // 2)
        return out

    def whole(self, symbols: list[int]) -> list[int]:
        """All ids of a word that is there at once, nothing being held."""
        if len(symbols) <= self._room:
            return self.encoder._settle(symbols)
        return self.push(symbols) + self.end()

    def end(self) -> list[int]:
        held, self._held, self._room = self._held, [], self.encoder.block
        return self.encoder._settle(held)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per process; what is remembered of texts lives in a Codec and goes with it."""
    return Encoder(word_bpe(path))


class Decoder:
    """Token ids in, text out, one id at a time.

    ``surface``: as the library's decode() of a file without a decoder entry, the
    tokens' own symbols with one space between tokens. ``plain``: the bytes
    behind the symbols as UTF-8, a space after each word's end; bytes of an
    unfinished character wait in the state until the next id brings the rest.
    """

    def __init__(self, bpe: WordBpe, form: str = "surface"):
        self.bpe, self.form = bpe, form
        self._byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self._special = frozenset(bpe.special.values())
        self._whole: dict[int, str] = {}  # what tokens of whole characters spell
        self._held = bytearray()
        self.reset()

    def reset(self) -> None:
        self._first, self._need = True, 0
        self._held.clear()

    def push(self, *tokens: int) -> str:
        """What more ids bring."""
        text_of = self.bpe.text_of
        if self.form == "surface":
            out = " ".join([text_of[t] for t in tokens])
            if out and not self._first:
                out = " " + out
            self._first = self._first and not tokens
            return out
        known, out = self._whole, ""
        if not self._held and None not in (found := [known.get(t) for t in tokens]):
            return "".join(found)
        for t in tokens:
            out += (not self._held and known.get(t)) or self._spelled(t)
        return out

    def _spelled(self, token: int) -> str:
        """What the machine puts out for one token, byte by byte. Where it rests before
        and after, that is remembered."""
        text, rests = self.bpe.text_of[token], not self._held
        if token in self._special:
            return self.finish() + text
        ends = bool(self.bpe.end) and text.endswith(self.bpe.end)
        found = [self._byte(self._byte_of[c]) for c in (text.removesuffix(self.bpe.end) if ends else text)]
        if ends:
            found += [self.finish(), " "]
        out = "".join(found)
        if rests and not self._held:
            self._whole[token] = out
        return out

    def _byte(self, b: int) -> str:
        """One step of the byte machine: ``_need`` bytes are still missing."""
        if self._need and b & 0xC0 == 0x80:
            self._held.append(b)
            self._need -= 1
            if self._need:
                return ""
            out = self._held.decode("utf-8", "replace")
            self._held.clear()
            return out
        broken = self.finish()
        if b < 0x80:
            return broken + chr(b)
        self._need = 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0
        if not self._need:
            return broken + "�"
        self._held.append(b)
        return broken

    def finish(self) -> str:
        """What is left at the end: an unfinished character shows as U+FFFD."""
        out = "�" if self._held else ""
        self._held.clear()
        self._need = 0
        return out


#: What comes out for a stretch of text: ids joined by a space, their two decodings,
#: and how many ids there are.
Made = tuple[str, str, str, int]


class Memory:
    """What came out for short stretches of text, within about ``most`` bytes.

    There are two halves. When the newer is full it becomes the older, whose own
    entries go; what is found in the older moves to the newer. So what is met often stays.
    """

    def __init__(self, most: int):
        self.half, self.size = most // 2, 0
        self.newer: dict[str, Made] = {}
        self._older: dict[str, Made] = {}

    def find(self, key: str) -> Made | None:
        out = self.newer.get(key)
        if out is None:
            out = self._older.get(key)
            if out is not None:
                self.put(key, out)
        return out

    def put(self, key: str, made: Made) -> None:
        if len(key) > MEMO_CHARS or key in self.newer:
            return
        self.size += ENTRY_BYTES + 12 * len(key)
        if self.size > self.half:
            self._older, self.newer, self.size = self.newer, {}, ENTRY_BYTES + 12 * len(key)
        self.newer[key] = made


class Codec:
    """Texts of any length through the transducer and the two decoders.

    A text is read in pieces, and what they give goes on at once. Between words
    the machines are at rest, so the outputs for a bounded number of short words
    are remembered.
    """

    def __init__(self, path: str, size: int = PIECE):
        self.bpe, self.size = word_bpe(path), size
        self.encoder = encoder(path)
        self.transducer = Transducer(self.encoder)
        self.surface, self.plain = Decoder(self.bpe), Decoder(self.bpe, "plain")
        self._memo = Memory(MEMO_BYTES)
        self._digits = list(map(str, range(max(self.bpe.text_of, default=-1) + 1)))

    def _made(self, ids: list[int]) -> Made:
        """The decoders' next output; what parts it from the output before is left out."""
        self.surface.reset()
        digits = self._digits
        return " ".join([digits[t] for t in ids]), self.surface.push(*ids), self.plain.push(*ids), len(ids)

    def _ids(self, word: str, ends: bool) -> list[int]:
        """What is stable after more characters of a word."""
        raw = word.encode("utf-8")
        if ends:
            return self.transducer.push(self.bpe.symbols(raw)) + self.transducer.end()
        return self.transducer.push([self.bpe.byte_ids[b] for b in raw])

    def _word(self, word: str | int) -> Made:
        if isinstance(word, int):
            return self._made([word])
        out = self._memo.find(word)
        if out is None:
            out = self._made(self.transducer.whole(self.bpe.symbols(word.encode("utf-8"))))
            self._memo.put(word, out)
        return out

    def _words(self, text: str) -> Made:
        """The output for the words of a text that no piece cuts."""
        words, known, make = self.bpe.words(text), self._memo.newer.get, self._word
        return _together([known(w) or make(w) for w in words])

    def stream(self, text: str) -> Iterator[Made]:
        """The output for ``text``, stretch by stretch, each as soon as it is stable."""
        chunk: OpenChunk | None = None  # one that the last piece left unfinished
        for piece, closed in pieces(text, self.size):
            if closed and chunk is None:
                made = self._words(piece)
                if made[3]:
                    yield made
                continue
            found = self.bpe.chunks(piece)
            if chunk:
                # the piece goes on where the last one was cut, unless white space comes first
                goes_on = bool(found) and piece.startswith(found[0])
                last = closed or not goes_on or len(found) > 1
                yield from self._open(chunk, found.pop(0) if goes_on else "", last)
                chunk = None if last else chunk
            opened = found.pop() if not closed and found and chunk is None and piece.endswith(found[-1]) else None
            if found:
                yield _together([self._words(c) for c in found])
            if opened is not None:
                chunk = OpenChunk(self.bpe)
                yield from self._open(chunk, opened, False)

    def _open(self, chunk: OpenChunk, characters: str, closes: bool) -> Iterator[Made]:
        for word in chunk.feed(characters, closes):
            ids = [word] if isinstance(word, int) else self._ids(*word)
            if ids:
                yield self._made(ids)

    def both(self, text: str) -> tuple[str, str, int]:
        """(ids joined by a space, decoded text, number of ids) of a text that fits in memory."""
        ids, surface, _, n = _together(list(self.stream(text)))
        return ids, surface, n

    def digests(self, text: str) -> tuple[int, str, str, str]:
        """(number of ids, SHA-256 of the ids, of the decoded text, of the plain text),
        without ever holding any of the three whole."""
        n, hashes = 0, [hashlib.sha256() for _ in range(3)]
        for made in self.stream(text):
            for k, h in enumerate(hashes):
                if n and k < 2:
                    h.update(b" ")
                h.update(made[k].encode())
            n += made[3]
        return n, *(h.hexdigest() for h in hashes)


def _together(parts: list[Made]) -> Made:
    ids, surface, plain, n = zip(*parts) if parts else [()] * 4
    return " ".join(ids), " ".join(surface), "".join(plain), sum(n)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Each text's token count and the SHA-256 of its ids and of their decodings.

    ``decoded_sha256``: the tokens as the library shows them; ``plain_sha256``: the
    text that their bytes spell, a space after every word. One row per input row, in
    one pass without a shuffle. ``texts``: also ``ids`` (array) and ``decoded``. A
    null text counts as empty: no ids, empty decoding. Special strings inside a text
    become special ids, as in the library. Rows with a null or repeated id come out
    as they are; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    extra = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if texts else []
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = Codec(path)
        for batch in slices(batches):
            rows, kept = [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                rows.append(c.digests(text))
                if texts:
                    ids, decoded, _ = c.both(text)
                    kept.append(([int(x) for x in ids.split()], decoded))
            n, ids, decoded, plain = zip(*rows) if rows else [()] * 4
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64())] + [pa.array(d, pa.string()) for d in (ids, decoded, plain)] + [pa.array([k[j] for k in kept], t) for j, (_, t) in enumerate(extra)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "plain_sha256"] + [name for name, _ in extra],
            )

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, plain_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
