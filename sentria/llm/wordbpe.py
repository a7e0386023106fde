"""Vocabulary, merge list and word splitting of a ``tokenizers`` word-BPE file.

The file fixes: NFC, white space dropped, lower case, a pattern that cuts words,
bytes shown as printable characters, and a marker on each word's last symbol.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex

#: White space as the file's pattern has it: Unicode White_Space. Python's own
#: split() also cuts at U+001C to U+001F, which are ordinary characters there.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: None of the characters that are newer than Python's tables is before these.
_FAR = re.compile("[^\0-\xff]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def late_characters() -> tuple[frozenset[str], str, dict[str, str]]:
    """Letters and numbers that are newer than Python's own Unicode tables.

    The pattern module, Python and the library each have tables of another age.
    Returns these characters; those of them that the library does not know yet, as
    the inside of a character class; and the library's lower case of the others.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    known = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]+"), "removed", invert=True).pre_tokenize_str("".join(newer))
    known = {c for run, _ in known for c in run}
    low = normalizers.Lowercase()
    lower = {c: low.normalize_str(c) for c in newer if c in known}
    return frozenset(newer), "".join(regex.escape(c) for c in newer if c not in known), lower


class WordBpe:
    """What encoding, decoding and counting share. One per process and file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        #: the same as text, in rank order
        self.rules: list[tuple[str, str]] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rules.append((left, right))
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        symbols = byte_symbols()
        self.byte_ids = [self.ids[s] for s in symbols]
        self.last_byte_ids = [self.ids[s + self.end] for s in symbols]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", SPACE)
        self._words = regex.compile(split)
        #: the same for ASCII text, by the quicker module
        self._ascii_words = re.compile(split.replace("\\p{L}", "A-Za-z").replace("\\p{N}", "0-9"))
        self._other = regex.compile(split.rpartition("|")[2])
        self._newer, strange, self._lower = late_characters()
        if strange:
            for kind in ("\\p{L}", "\\p{N}"):
                split = split.replace(kind, f"[{kind}--[{strange}]]")
        self._late_words = regex.compile(split, regex.V1)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def chunks(self, text: str) -> list[str]:
        """``text`` cut at white space; no word reaches across it."""
        if _SEPARATORS.search(text):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def _clean(self, part: str) -> tuple[str, regex.Pattern]:
        """A part without special strings as the pattern sees it, and the pattern."""
        if part.isascii():
            return part.lower(), self._words
        late = _FAR.search(part) is not None and not self._newer.isdisjoint(part)
        clean = unicodedata.normalize("NFC", part)
        if late or "\u03a3" in clean:  # character by character: the library knows no final sigma
            lower = self._lower if late else {}
            clean = "".join([lower.get(c) or c.lower() for c in clean])
        else:
            clean = clean.lower()
        return clean, self._late_words if late else self._words

    def words(self, chunk: str) -> list:
        """The words of a text, or the ids of special strings among them. White space parts
        them, and nothing is composed across it, so a text has the words of its chunks."""
        if "<|" not in chunk:
            if chunk.isascii():
                return self._ascii_words.findall(chunk.lower())
            clean, split = self._clean(chunk)
            return split.findall(clean)
        out = []
        for i, part in enumerate(self._special.split(chunk)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                clean, split = self._clean(part)
                out += split.findall(clean)
        return out

    def symbols(self, word: bytes) -> list[int]:
        ids = self.byte_ids
        out = [ids[b] for b in word]
        out[-1] = self.last_byte_ids[word[-1]]
        return out


@lru_cache(maxsize=1)
def _joiners() -> frozenset[str]:
    """Characters that may become one with what stands before them under NFC."""
    every = [c for c in map(chr, range(0x80, 0x110000)) if not "\ud800" <= c <= "\udfff"]
    parts = (unicodedata.decomposition(c) for c in every)
    seconds = {chr(int(p.split()[1], 16)) for p in parts if p and p[0] != "<" and " " in p}
    jamo = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return frozenset(seconds | jamo | {c for c in every if unicodedata.combining(c)})


class OpenChunk:
    """The words of a run of text without white space that comes in pieces.

    ``feed`` gives (characters, whether the word ends with them) and ids of special
    strings, as soon as what follows cannot change them. It holds back what a later
    piece could: characters that may still be composed or begin a special string,
    and the last few characters, which may be a longer word's.
    """

    #: Of a word that may go on, so many characters are held at most; no alternative
    #: of the pattern but a run of one kind is longer than REACH.
    HELD, REACH = 64, 3

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self._longest = max(map(len, bpe.special), default=0)
        self._raw, self._clean, self._other = "", "", False

    def feed(self, piece: str, closes: bool) -> Iterator[tuple[str, bool] | int]:
        raw, cut = self._raw + piece, 0
        if closes:
            cut = len(raw)
        else:
            joiners = _joiners()
            cut = next((k for k in range(len(raw) - self._longest, 0, -1) if raw[k] not in joiners), 0)
        at = 0
        for m in self.bpe._special.finditer(raw):
            if m.start() >= cut:
                break
            yield from self._part(raw[at : m.start()], True)
            yield self.bpe.special[m[0]]
            at = m.end()
        cut = max(cut, at)
        yield from self._part(raw[at:cut], closes)
        self._raw = raw[cut:]

    def _part(self, part: str, closes: bool) -> Iterator[tuple[str, bool]]:
        clean, split = self.bpe._clean(part)
        clean, at = self._clean + clean, 0
        while at < len(clean):
            m = (self.bpe._other if self._other else split).match(clean, at)
            if m is None:  # not of any word
                at += 1
                continue
            if not closes and m.end() > len(clean) - self.REACH:
                if m.end() - at > self.HELD:
                    self._other = self.bpe._other.fullmatch(m[0]) is not None
                    yield m[0][:-1], False
                    at = m.end() - 1
                break
            yield m[0], True
            self._other = False
            at = m.end()
        self._clean = clean[at:]


def pieces(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """``text`` in pieces of at most twice ``size``, and whether each ends at white
    space or with the text."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        gap = _SPACES.search(text, end, end + size) if end < len(text) else None
        end = gap.start() if gap else end
        yield text[at:end], gap is not None or end == len(text)
        at = end


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
