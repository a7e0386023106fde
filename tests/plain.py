"""The definition of normalising, scoring and candidates, in plain Python."""

import string


def normalize(text):
    return " ".join("".join(" " if c in string.punctuation else c for c in text.lower()).split())


def window_score(q, t):
    n, best = len(q), None

    def offer(v):
        nonlocal best
        best = v if best is None else max(best, v)

    if t == q:
        offer(2 * n)
    if len(t) == n and sum(a != b for a, b in zip(q, t)) == 1:
        p = next(i for i in range(n) if q[i] != t[i]) + 1
        offer(2 * (n - 1) - max(6 - p, 1))
    if len(t) == n - 1 and n > 1:
        for p in range(1, n + 1):
            if q[: p - 1] + q[p:] == t:
                offer(2 * (n - 1) - max(12 - 2 * p, 2))
    if len(t) == n + 1:
        for p in range(1, n + 2):
            if t[: p - 1] + t[p:] == q:
                offer(2 * n - max(12 - 2 * p, 2))
    return best


def score(q, s):
    if not q or not s:
        return None
    found = [window_score(q, s[i : i + m]) for m in (len(q) - 1, len(q), len(q) + 1) if m > 0 for i in range(len(s) - m + 1)]
    return max((v for v in found if v is not None), default=None)


def best(q, rows, k=5):
    q = normalize(q)
    hits = [(-v, line, source, at) for line, source, at in rows if (v := score(q, normalize(line))) is not None]
    return [(line, source, at, -v) for v, line, source, at in sorted(hits)[:k]]
