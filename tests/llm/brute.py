"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    """[(id, text)] -> [(id, keep, size, kept, sha)]"""
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return [(i, least[t], len(groups[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]


def base_counts(text):
    t = text or ""
    w = WORDS.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def boilerplate(rows, min_docs=20, max_share=0.002):
    """[(id, host, text)] -> per row the words in boilerplate lines, and the text without them"""
    key = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    n = lambda x: len(WORDS.findall(x))
    digest = lambda k: hashlib.md5(k.encode()).hexdigest()[:15]
    texts = defaultdict(set)
    for _, h, t in rows:
        texts[h].add(t or "")
    limit = {h: max(min_docs, max_share * len(ts)) for h, ts in texts.items()}
    seen = Counter((h, k) for h, ts in texts.items() for t in ts for k in {key(x) for x in t.split("\n") if n(x)})
    often = {(h, k) for (h, k), c in seen.items() if c > limit[h]}
    by = defaultdict(set)  # the documents that hold a frequent line, by what else they hold
    for h, ts in texts.items():
        for t in ts:
            lines = [(key(x), n(x)) for x in t.split("\n") if n(x)]
            if 2 * sum(c for k, c in lines if (h, k) in often) <= sum(c for _, c in lines):
                for k, _ in lines:
                    if (h, k) in often:
                        by[h, k].add(min(digest(j) for j, _ in lines if (h, j) not in often))
    bad = lambda h, x: n(x) and len(by.get((h, key(x)), ())) > limit[h]
    return [(sum(n(x) for x in (t or "").split("\n") if bad(h, x)), "\n".join(x for x in (t or "").split("\n") if not bad(h, x))) for _, h, t in rows]


def shingles(text):
    w = WORDS.findall((text or "").translate(ASCII))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    """[(id, text)] -> {id: component}"""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def repeats(rows, length=400):
    """[(id, text)] -> [(n_bytes, n_removed, n_spans, kept bytes)]"""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out
