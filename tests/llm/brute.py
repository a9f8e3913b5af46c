"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

SPACE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def without_repeats(docs, window=13):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out[i] = (len(w), len(w) - len(kept), " ".join(kept))
    return out


def quality(text):
    w = words(text)
    count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = set()
    for k in range(len(w) - 7):
        if count[tuple(w[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    full = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
