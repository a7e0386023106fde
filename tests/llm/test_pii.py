import hashlib
import random
import re
import time

import numpy as np

from sentria.llm import pii as op
from sentria.llm.pii import ABSTAIN, KINDS, LABELERS, NO, YES, all_spans, base_spans, candidates, coded, features, learn, luhn, personal_data, reliabilities, train, uncoded, votes

SCHEMA = "doc_id long, text string, spans string, kind string, votes int"
#: The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_rules_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a@b.co", "@", ".", "x.y-z@", "q.r.s", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "+", "0001.2.3.4", " ", "-", "9", "55", "é", "😀", "_%", "+49 30 123456", "\n", "@a.b@c.d.e"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert base_spans(text) == plain(text), text
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_runs_are_read_once():
    began = time.perf_counter()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "0" * 300_000 + ".1.1.1", "1 " * 150_000, "(" * 300_000):
        candidates(text, base_spans(text))
    assert time.perf_counter() - began < 10


def test_em_equals_em_over_single_candidates():
    rng = random.Random(2)
    counts = {}
    for _ in range(3000):
        truth = rng.random() < 0.7
        given = tuple(ABSTAIN if rng.random() < 0.2 else (YES if truth == (rng.random() < accuracy) else NO) for accuracy in (0.95, 0.9, 0.85, 0.8, 0.7, 0.6))
        counts[coded(given)] = counts.get(coded(given), 0) + 1
    likely, table, share = reliabilities(counts, 30)
    # the same, candidate by candidate
    each = [uncoded(c) for c, n in sorted(counts.items()) for _ in range(n)]
    p = [((g.count(YES)) + 0.5) / (g.count(YES) + g.count(NO) + 1) for g in each]
    for _ in range(30):
        total = [sum(1 - x for x in p), sum(p)]
        prior = (total[1] + 1) / (len(p) + 2)
        seen = [[[2.0, 1.0], [1.0, 2.0]] for _ in LABELERS]
        for g, x in zip(each, p):
            for j, v in enumerate(g):
                if v != ABSTAIN:
                    seen[j][1][v] += x
                    seen[j][0][v] += 1 - x
        for of_labeler in seen:
            for row in of_labeler:
                row[:] = [v / sum(row) for v in row]
        for i, g in enumerate(each):
            one, none = prior, 1 - prior
            for j, v in enumerate(g):
                if v != ABSTAIN:
                    one, none = one * seen[j][1][v], none * seen[j][0][v]
            p[i] = one / (one + none)
    assert np.allclose([likely[coded(g)] for g in each], p, atol=1e-9) and np.allclose(table, seen, atol=1e-9)
    assert abs(share - 0.7) < 0.05
    assert np.allclose(table[:, 1, YES], [0.95, 0.9, 0.85, 0.8, 0.7, 0.6], atol=0.07)  # reliabilities are found without a label
    assert reliabilities({})[0] == {}


def test_a_training_step_follows_the_gradient():
    rng = np.random.default_rng(0)
    rows, target, weight = rng.integers(0, 30, (12, 4)), rng.random(12), rng.random(12) + 0.1

    def loss(w):
        p = 1 / (1 + np.exp(-(w[rows].sum(1) + w[-1])))
        return -((target * np.log(p) + (1 - target) * np.log(1 - p)) * weight / weight.sum()).sum() + op.DECAY / 2 * (w**2).sum()

    before = train(rows, target, weight, steps=3)
    after = train(rows, target, weight, steps=4)
    for i in [*range(30), len(before) - 1]:
        step = np.zeros_like(before)
        step[i] = 1e-6
        slope = (loss(before + step) - loss(before - step)) / 2e-6
        assert abs((before[i] - after[i]) / op.RATE - slope) < 1e-6


def card(rng):
    body = "4" + "".join(rng.choices("0123456789", k=14))
    return next(body + d for d in "0123456789" if luhn(body + d))


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    out = []
    for i in range(500):
        made = {"email": f"{word()}.{i}@mail.example.com", "ip": f"{rng.randrange(1, 255)}.{rng.randrange(256)}.7.{i % 250}", "card": card(rng), "phone": f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"}
        kinds = rng.sample(KINDS, rng.randrange(3))
        parts = [word() for _ in range(12)]
        for k in kinds:
            parts.insert(rng.randrange(3, 9) + 0, made[k] + " " + word())
        if i % 5 == 0:
            parts.append(f'token = "{rng.getrandbits(160):040x}{card(rng)}ab"')
        out.append(" ".join(parts))
    return out


def test_spans_that_the_base_rules_miss_are_added(spark):
    """A card behind a telephone number, a spelled-out address: found. Digits inside a
    token: left alone. Nulls, empty and long texts, repeated rows, clashing names."""
    rows = list(enumerate(texts()))
    rng = random.Random(1)
    number = card(rng)
    glued = f"call +1 (212) 555-0199 {number} ok"
    rows += [(1000, glued), (1000, glued), (1001, None), (None, "a.b@c.de"), (1002, ""), (1003, "no data, 12 eggs and 3.14 of 16"), (1004, "é😀 " * 30_000 + glued)]
    df = spark.createDataFrame([(i, t, "s", "k", 0) for i, t in rows], SCHEMA).repartition(3)
    found = personal_data(df)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = found.collect()
    model = learn(df)
    want = []
    for i, t in rows:
        base = plain(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        spans = ",".join(f"{k}:{s}:{e}" for s, e, k in all_spans(t or "", base, model))
        want.append((i, *(sum(b[2] == k for b in base) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest(), spans))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[1000] == "phone:5:22,card:23:39"
    assert spans[1004] == "phone:90005:90022,card:90023:90039"
    assert spans[1001] == spans[1002] == spans[1003] == "" and spans[None] == "email:0:8"
    for r in got:  # clean texts get nothing, and what is added is no part of a token
        if r.doc_id is not None and r.doc_id < 500:
            text = rows[r.doc_id][1]
            added = set(r.spans.split(",")) - {f"{k}:{s}:{e}" for s, e, k in plain(text)} - {""}
            assert all("token" not in text[: int(a.split(":")[1])] for a in added)
    assert personal_data(df.limit(0)).collect() == []


def test_votes():
    text = f"my card {'4111111111111111'} and token=ab4111111111111111cd"
    base = set(base_spans(text))
    first, second = (c for c in candidates(text, base_spans(text)) if c[2] == "card")
    assert votes(text, *first, base)[:3] == (YES, YES, YES) and votes(text, *first, base)[4:] == (YES, ABSTAIN)
    assert votes(text, *second, base)[4:] == (NO, NO)
    assert uncoded(coded((2, 0, 1, 1, 0, 2))) == (2, 0, 1, 1, 0, 2)
    assert len(features(text, *first)) == op.N_FEATURES
    spelled = "write to jo.do (at) mail (dot) org now"
    assert candidates(spelled, []) == [(9, 34, "email")] and votes(spelled, 9, 34, "email", set())[1:3] == (YES, YES)
