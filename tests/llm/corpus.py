"""Small corpora for the tests, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def made(seed=1, n=40, vocabulary=60):
    """Texts with copies, near copies, shared passages, nulls, empty, very long and repetitive texts."""
    r = random.Random(seed)
    w = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(vocabulary)]
    some = lambda k: [r.choice(w) + str(r.randint(0, 400)) for _ in range(k)]
    base = [some(r.randint(60, 160)) for _ in range(6)]
    passage = some(70)
    texts = [None, "", " \n\t", "one", "One two", "one two three four", "a b c d e", "A B C D E", "tick tock " * 300, "x" * 3000, "<p>#*$%& | >"]
    for i in range(n):
        t = list(r.choice(base))
        kind = i % 5
        if kind == 1:
            for _ in range(r.randint(1, 12)):
                t[r.randrange(len(t))] = r.choice(w)
        elif kind == 2:
            at = r.randrange(len(t))
            t[at:at] = passage
        elif kind == 3:
            t = some(r.randint(1, 200)) + passage[r.randint(0, 15) :] + some(10)
        elif kind == 4:
            t = some(r.randint(20, 90)) * r.randint(1, 3)
        texts.append(r.choice((" ", "\n", "  ")).join(t))
    texts.append(" ".join(" ".join(b) for b in base * 6))
    rows = [(i, t, r.choice(("en", "de", None)), r.choice(("a", "b", "ab", None)), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[14], rows[15]]  # repeated rows
    rows += [(None, rows[13][1], "en", "a", 1), (None, "some text without an id", None, None, None)]
    r.shuffle(rows)
    return rows


def shingles(text, k=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(rows, percent=75):
    """component of each row by index, by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    least = {}
    far = 1 << 63
    for i, row in enumerate(rows):
        least[top(i)] = min(least.get(top(i), far), far if row[0] is None else row[0])
    return [None if least[top(i)] == far else least[top(i)] for i in range(len(rows))], [len(s) for s in sets]


def without_repeated_words(rows, window=50):
    """(n_words, n_removed, kept text) of each row."""
    far = 1 << 63
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, far), far if d is None else d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (far if d is None else d):
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def without_repeated_bytes(rows, length=400):
    """(n_bytes, n_removed, n_spans, kept) of each row."""
    seen = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for _, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for i, x in enumerate(b) if not gone[i])))
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
