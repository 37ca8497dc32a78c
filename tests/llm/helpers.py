"""Small inputs and plain versions of what the operators compute."""

import hashlib
import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, _key string, n string, sid string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, source) rows as documents with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, DOCS)


def corpus(seed=1, n=60, words=60):
    """Texts with copies, near copies, shared passages, empty and null ones, one long one and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base, passage = text(words), text(45)
    rows = [(i, text(rng.randint(1, words))) for i in range(n)]
    for i in range(n, n + 20):
        parts = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
        rows.append((i, " ".join(parts)))
    rows += [(n + 20 + i, f"{text(20)} {passage}\n{text(10)}") for i in range(4)]
    rows += [(n + 30, ""), (n + 31, None), (n + 32, " \t\n\x0b"), (n + 33, "One TWO"), (n + 34, "one two"), (n + 35, text(4000)), (n + 36, "a " * 200), (n + 37, "a " * 150), (3, rows[3][1]), (n + 38, "é ü x y \x1f z")]
    return rows


def components(sets, percent=80):
    """The smallest id that links lead to, by brute force over all pairs."""
    ids = list(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def shingles(text, n=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def windows_removed(texts, width=35):
    """(words, removed flags) of each text, by counting all windows."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((w, gone))
    return out


def mix_targets(sizes, most=3):
    """Targets of sources {name: size} by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: float(1 + k % 3) for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= most * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= full
    return out


def mix_passes(rows, most=3):
    """(key, text, passes) of (key, text, source) rows: each source in the order of its keys' MD5, from its start, up to its target."""
    sizes = defaultdict(int)
    rows = [(i, t, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    for _, _, s, n in rows:
        sizes[s] += n
    targets, at, out = mix_targets(sizes, most), defaultdict(int), []
    for i, t, s, n in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        need = int(targets[s] + 0.5)
        out.append((i, t, sum(n > 0 and at[s] + e * sizes[s] < need for e in range(most))))
        at[s] += n
    return out


def by_key(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
