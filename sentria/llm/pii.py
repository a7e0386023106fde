"""Personal data by weak supervision.

Candidate spans of each kind are proposed by loose patterns, and labelers vote on
them: the base rules, shapes, checks, word lists and the context. How often every
combination of votes occurs is counted over the whole table; expectation-maximisation
on those counts estimates how reliable each labeler is, and how likely each
combination means personal data. With that as soft labels a logistic span classifier
is trained on features of its own, so it also judges spans whose votes are rare.

What the base rules find is always kept. The classifier adds spans that they miss,
such as a card number that stands right behind a telephone number and so lies in a
run of digits that is too long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import hashed_sample, slices, written

KINDS = ("email", "ip", "card", "phone")
NO, YES, ABSTAIN = 0, 1, 2
#: Candidates that the classifier learns from, of each kind and combination of votes
#: (of which there are 3 ** labelers at most); features fall in so many buckets.
PER_VOTES, BUCKETS = 200, 1024
ROUNDS, STEPS, RATE, DECAY = 100, 400, 2.0, 1e-4
#: Votes that each labeler is given beforehand: wrong ones and right ones.
PRIOR = (1, 2)
#: The classifier's probability from which a span is added.
ACCEPT = 0.5
#: Characters on each side that labelers read.
AROUND = 40

# --- the base rules ------------------------------------------------------------
# Written so that no long run of one character class is read again from each of its
# characters: an e-mail address is found from its @, numbers only from where a run
# of digits begins. What they match is what the contract's patterns match.

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = (int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _parts(address: str) -> list[int]:
    """The numbers of an address; one that is far too long counts as 1000."""
    short = [p.lstrip("0") or "0" for p in address.split(".") if p]
    return [int(p) if len(p) < 4 else 1000 for p in short]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the base rules find, by start, then kind as listed."""
    out = [(*s, "email") for s in _emails(text)]
    if _ANY_DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(p <= 255 for p in _parts(m.group()))]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if m.end() - m.start() < 40 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- candidates ----------------------------------------------------------------

_PROPOSED = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]{1,63}){1,5}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9])"),
}


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base spans, and what the loose patterns propose."""
    found = set(base)
    numbers = bool(_ANY_DIGIT.search(text))
    for kind, pattern in _PROPOSED.items():
        if numbers if kind != "email" else ("(at)" in text or "[at]" in text):
            found.update((*m.span(), kind) for m in pattern.finditer(text))
    return sorted(found, key=lambda s: (s[0], s[1], KINDS.index(s[2])))


# --- labelers ------------------------------------------------------------------

#: Words near a span that speak for its kind, and words that speak against any.
GAZETTEER = {
    "email": {"email", "mail", "contact", "write", "courriel", "correo", "kontakt"},
    "ip": {"ip", "host", "server", "client", "address", "login", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telephone", "telefono"},
}
AGAINST = {"token", "password", "secret", "sha", "hash", "version", "isbn", "order", "invoice", "serial", "id", "key", "doi", "release"}
_SHAPES = {
    "email": re.compile(r"[a-z0-9][a-z0-9._+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,12}", re.IGNORECASE),
    "ip": re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    "card": re.compile(r"[3-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}"),
}
_WORD = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r" ?[(\[](at|dot)[)\]] ?")


def _plain(kind: str, span: str) -> str:
    """An e-mail address with its signs spelled out, as it is written otherwise."""
    return _SPELLED.sub(lambda m: "@" if m[1] == "at" else ".", span) if kind == "email" else span


def _nearby(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    left = [w.lower() for w in _WORD.findall(text[max(0, start - AROUND) : start])]
    right = [w.lower() for w in _WORD.findall(text[end : end + AROUND])]
    return left, right


def _valid(kind: str, span: str) -> bool:
    if kind == "card":
        return 14 <= len(_digits(span)) <= 19 and luhn(_digits(span))
    if kind == "ip":
        parts = _parts(span)
        return len(parts) == 4 and max(parts) < 256 and parts[0] not in (0, 127) and parts != [255] * 4
    if kind == "phone":
        return 10 <= len(_digits(span)) <= 15
    return ".." not in _plain(kind, span) and not span.startswith(".")


def _alone(text: str, start: int, end: int) -> bool:
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    return not (before.isalnum() or before in ("_", "=") or after.isalnum() or after == "_")


def _assigned(text: str, start: int) -> bool:
    """Inside a value: behind an equals sign or a quote, with nothing but letters and
    digits between."""
    before = text[max(0, start - AROUND) : start].rstrip("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return before.rstrip(" \"'").endswith(("=", ":=")) or before.endswith(('"', "'"))


LABELERS = ("base rule", "shape", "check", "gazetteer", "alone", "assigned")


def votes(text: str, start: int, end: int, kind: str, base: set[tuple[int, int, str]]) -> tuple[int, ...]:
    """What each labeler says of a candidate."""
    span = text[start:end]
    near = set().union(*_nearby(text, start, end))
    gazetteer = YES if near & GAZETTEER[kind] and not near & AGAINST else NO if near & AGAINST and not near & GAZETTEER[kind] else ABSTAIN
    return (
        YES if (start, end, kind) in base else ABSTAIN,
        YES if _SHAPES[kind].fullmatch(_plain(kind, span)) else NO,
        YES if _valid(kind, span) else NO,
        gazetteer,
        YES if _alone(text, start, end) else NO,
        NO if _assigned(text, start) else ABSTAIN,
    )


def coded(given: tuple[int, ...]) -> int:
    return sum(v * 3**j for j, v in enumerate(given))


def uncoded(code: int) -> tuple[int, ...]:
    return tuple(code // 3**j % 3 for j in range(len(LABELERS)))


def reliabilities(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over combinations of votes and how often each occurs.

    -> (combination -> probability of personal data, labelers x truth x (no, yes)
    probabilities, share of personal data). It begins with the majority of the votes,
    so "personal" is what most labelers mean by it, and each labeler begins with
    ``PRIOR`` votes that speak for it. Who abstains says nothing.
    """
    codes = sorted(counts)
    if not codes:
        return {}, np.full((len(LABELERS), 2, 2), 0.5), 0.5
    n = np.array([counts[c] for c in codes], np.float64)
    given = np.array([uncoded(c) for c in codes])
    yes, no = (given == YES).sum(1), (given == NO).sum(1)
    likely = (yes + 0.5) / (yes + no + 1)
    for _ in range(rounds):
        both = np.stack([1 - likely, likely]) * n  # truth x combinations
        share = (both[1].sum() + 1) / (n.sum() + 2)
        table = np.stack([[[both[y][given[:, j] == v].sum() + PRIOR[v == y] for v in (NO, YES)] for y in range(2)] for j in range(len(LABELERS))])
        table /= table.sum(2, keepdims=True)
        logs = np.concatenate([np.log(table), np.zeros((len(LABELERS), 2, 1))], 2)  # who abstains adds nothing
        log = logs[np.arange(len(LABELERS)), :, given].sum(1)  # combinations x truth
        odds = log[:, 1] - log[:, 0] + np.log(share / (1 - share))
        before, likely = likely, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(before - likely).max() < 1e-9:
            break
    return dict(zip(codes, likely.tolist())), table, float(share)


# --- the span classifier -------------------------------------------------------


def features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Buckets of what the classifier sees; the base rules are not among it."""
    span = text[start:end]
    left, right = _nearby(text, start, end)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "0", _plain(kind, span)))
    char = lambda c: "end" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c
    seen = (
        f"shape {shape if kind != 'email' else re.sub('0+', '0', shape)}",
        f"size {len(_digits(span))}",
        f"valid {_valid(kind, span)}",
        f"first {span[0] if kind != 'email' else ''}",
        f"before {char(text[start - 1 : start] if start else '')} after {char(text[end : end + 1])}",
        f"assigned {_assigned(text, start)} alone {_alone(text, start, end)}",
        f"left {left[-1] if left else ''}",
        f"right {right[0] if right else ''}",
        f"for {bool(set(left + right) & GAZETTEER[kind])} against {bool(set(left + right) & AGAINST)}",
    )
    return [crc32(s.encode("utf-8", "replace")) % BUCKETS for s in seen]


N_FEATURES = 9


def train(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Logistic regression with soft targets by gradient descent; the last number is
    the bias. ``rows``: examples x N_FEATURES buckets."""
    w = np.zeros(BUCKETS + 1)
    share = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(w[rows].sum(1) + w[-1])))
        error = (p - target) * share
        step = np.bincount(rows.ravel(), np.repeat(error, rows.shape[1]), BUCKETS + 1)
        step[-1] = error.sum()
        w -= rate * (step + decay * w)
    return w


@dataclass
class Model:
    """kind -> weights of the classifier; kind -> what EM says of its labelers."""

    weights: dict[str, np.ndarray]
    tables: dict[str, np.ndarray]

    def probability(self, kind: str, found: list[int]) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-np.clip(w[found].sum() + w[-1], -500, 500))))


def voted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, key, features) of every candidate of every text."""

    def run(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                own, name = set(base), None
                for start, end, kind in candidates(text or "", base):
                    name = name or hashlib.md5(text.encode("utf-8")).hexdigest()
                    out.append((kind, coded(votes(text, start, end, kind, own)), f"{name}:{start}:{end}", features(text, start, end, kind)))
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "votes", "key", "features"])

    return docs.select(text_col).mapInArrow(run, "kind string, votes int, key string, features array<int>")


def learn(docs: DataFrame, text_col: str = "text", per_votes: int = PER_VOTES) -> Model:
    """Votes are counted over all candidates of all texts; at most ``per_votes`` of each
    kind and combination, chosen by a hash, train the classifier, weighted to stand for all."""
    found = written(voted(docs, text_col), "voted")
    counts: dict[str, dict[int, int]] = {}
    for r in found.groupBy("kind", "votes").count().collect():  # kinds * 3 ** labelers at most
        counts.setdefault(r["kind"], {})[r["votes"]] = r["count"]
    group = F.concat_ws(" ", "kind", "votes")
    sample = hashed_sample(found.withColumn("group", group).select("group", "key", "kind", "votes", "features"), "group", "key", per_votes).collect()
    weights, tables = {}, {}
    for kind, of_kind in counts.items():
        likely, tables[kind], _ = reliabilities(of_kind)
        own = sorted((r["votes"], r["key"], r["features"]) for r in sample if r["kind"] == kind)
        taken = {v: sum(o[0] == v for o in own) for v in of_kind}
        weight = np.array([of_kind[v] / taken[v] for v, _, _ in own])
        weights[kind] = train(np.array([f for _, _, f in own]), np.array([likely[v] for v, _, _ in own]), np.sqrt(weight))
    return Model(weights, tables)


def all_spans(text: str, base: list[tuple[int, int, str]], model: Model, accept: float = ACCEPT) -> list[tuple[int, int, str]]:
    """Base spans, and candidates that the classifier accepts: from left to right, the
    longer first, if they overlap nothing before."""
    out = list(base)
    for start, end, kind in sorted(set(candidates(text, base)) - set(base), key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if not any(start < e and s < end for s, e, _ in out) and model.probability(kind, features(text, start, end, kind)) >= accept:
            out.append((start, end, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a kind
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                count = [sum(s[2] == k for s in base) for k in KINDS]
                out.append((*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_spans(text or "", base, sent.value, accept))))
            cols = list(zip(*out)) or [()] * (len(KINDS) + 2)
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.record_batch([batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {counts}, base_sha256 string, spans string")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, per_votes: int = PER_VOTES) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``.

    The counts and the digest are of what the base rules find; ``spans`` are those and
    what the classifier adds, as kind:start:end by start, in code points, end exclusive.
    Null and empty texts have none. Rows with a null or repeated id come out as they
    are. An empty table gives an empty result. Other columns are not read. Whole texts
    are read, twice, and nothing but counts, a bounded sample and the classifier leaves
    the tasks that read them.
    """
    return find(docs, learn(docs, text_col, per_votes), id_col, text_col, accept)
