"""Plain versions of the operators on small lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter

import xxhash


def words(text):
    return (text or "").encode().split()


def later_words(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if k in seen:
                gone[j : j + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def repeated_bytes(rows, window=400):
    count, out = Counter(), {}
    data = {i: (t or "").encode() for i, t in rows}
    for b in data.values():
        count.update(b[j : j + window] for j in range(len(b) - window + 1))
    for i, b in data.items():
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if count[b[j : j + window]] > 1:
                gone[j : j + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text, shingle=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows, radius=4):
    f = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in f}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(f)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (f[a] ^ f[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{f[i]:016x}", find(i)) for i in ids}


def edit_distance_inside(pattern, text):
    prev = list(range(len(pattern) + 1))
    best = prev[-1]
    for c in text:
        row = [0]
        for i, x in enumerate(pattern):
            row.append(min(prev[i] + (x != c), prev[i + 1] + 1, row[i] + 1))
        prev, best = row, min(best, row[-1])
    return best


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    inside = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed
