"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset() if not w else frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))


def near_classes(docs):
    """{doc_id: (size, least linked doc_id)} over (doc_id, text)."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def repeats(docs, length=100):
    """{doc_id: (bytes, removed, spans, sha256)} over (doc_id, text) in ascending doc_id order."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def backoff(docs, alpha=0.4):
    """{doc_id: (words, backed off, score)}."""
    texts = {i: words(t) for i, t in docs}
    pairs = {i: collections.Counter(zip([None] + w[:-1], w)) for i, w in texts.items()}
    every = sum(pairs.values(), collections.Counter())
    first, word = collections.Counter(), collections.Counter()
    for (h, w), n in every.items():
        first[h] += n
        word[w] += n
    total, out = sum(word.values()), {}
    for i, own in pairs.items():
        mine = collections.Counter()
        for (h, _), n in own.items():
            mine[h] += n
        score = back = 0
        for (h, w), n in own.items():
            if every[h, w] > n:
                score += n * math.log((every[h, w] - n) / max(1, first[h] - mine[h]))
            else:
                score += n * math.log(alpha * word[w] / total)
                back += n
        out[i] = (len(texts[i]), back, score)
    return out


def secrets(text):
    """(counts, listing) of the certain kinds."""
    kinds = [
        [(m.start(), m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 8],
        [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32],
    ]
    spans = sorted((a, k, b) for k, found in enumerate(kinds) for a, b in found)
    return [len(k) for k in kinds], ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
