"""Near-duplicate classes by a chosen-path set similarity join.

Sets are distinct five-word shingles (ASCII lower case); two texts are linked when their Jaccard
similarity is ``threshold`` or more, confirmed on the full sets.

1. One pass writes per document the set's size, a 128-bit key of the whole set, and ``SIGNATURE`` minwise
   tokens with ``PRINTS`` short ones that sharpen estimates. Documents with equal sets form one class at once; the join works on class representatives.
2. Chosen paths: a node of a tree selects one or two coordinates (by hash of the node, 4/3 on average,
   the branching at which a pair at the threshold stays together), and a set goes into the child that its
   minwise token at the coordinate names. A node with one set ends. A node of up to ``SMALL`` sets is
   compared exhaustively inside its task: signatures first, and only pairs that may be links go on. A
   larger node branches on, ``DEPTH`` times at most, and meanwhile pairs each set with the node's smallest
   one. ``TREES`` independent trees raise recall: a pair at the threshold that has small nodes meets in
   one tree with chance 0.75 or more.
3. Links are confirmed on full sets in rounds, so that the pairs of a large family are never enumerated:
   first every set is paired with the smallest set of each of its nodes, and the likeliest of these pairs
   per set is confirmed, which joins most of a family into one component; then the small nodes are compared
   across components only, and again the likeliest pair per set goes first; whatever pairs still lie across
   components are all confirmed.
4. The rest, exactly: nodes still large at the last depth that hold several components are compared
   exhaustively across components, block against block: the full sets outside the node's main component, a few
   hundred to a block, meet blocks of all sets of the node. A pair of blocks counts all intersections at once, and
   sends on no pairs but a spanning forest of its confirmed links, so the rows out follow the sets, not their
   pairs. No partner is capped anywhere.
5. Components of the links give the classes.

Skew: node sizes are combined map-side; joins by node are split by adaptive execution; no node's sets are
gathered unless there are at most ``SMALL`` of them.

Defined cases: null text or a text without words has the empty set, is linked with nothing and is its own
component; a text with fewer than five words has its whole word sequence as one shingle; rows that repeat
an id are one node (links of either text count for both); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, unstage
from .components import components

WORDS = 5
THRESHOLD = 75  # per cent
SIGNATURE = 64
TREES = 12
SMALL = 48
DEPTH = 3
BLOCK = 256  # sets of a block, and the shingles of its sets, at about most
BLOCK_SHINGLES = 1 << 18
PRINTS = 1024  # of 4 bits, two a byte
#: A pair at the threshold is estimated lower from SIGNATURE tokens and PRINTS prints with a chance below 1e-7 (5.3 deviations of 0.0137).
MAYBE = 0.677

_U = np.uint64
_P = _U(0x100000001B3)
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(75)
_MUL = _RNG.integers(1, 2**63, SIGNATURE, dtype=np.uint64) | _U(1)
_ADD = _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64)
_MUL32 = _RNG.integers(1, 2**32, PRINTS, dtype=np.uint32) | np.uint32(1)
_ADD32 = _RNG.integers(0, 2**32, PRINTS, dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C2
    x = (x ^ (x >> _U(27))) * _C3
    return x ^ (x >> _U(31))


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = _U(pow(int(_P), -1, 1 << 64))
    up = np.concatenate([np.ones(1, dtype=_U), np.full(n, _P)])
    down = np.concatenate([np.ones(1, dtype=_U), np.full(n, inv)])
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased UTF-8 bytes, in order."""
    b = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    word = ~_SPACE[b]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _inverse_powers(len(b))
    total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum((b.astype(_U) + _U(1)) * up[: len(b)])])
    h = (total[stop] - total[start]) * down[start]
    return mix(h + (stop - start).astype(_U) * _C1)


def shingles(text: str) -> np.ndarray:
    """The set of a text: sorted distinct shingle hashes."""
    w = word_hashes(text.encode("utf-8", "replace"))
    if not len(w):
        return w
    k = min(WORDS, len(w))
    h = np.zeros(len(w) - k + 1, dtype=_U)
    for i in range(k):
        h = mix(h * _P + w[i : len(w) - k + 1 + i] + _U(i + 1))
    return np.unique(h if k == WORDS else mix(h + _U(k)))


def signature(s: np.ndarray) -> bytes:
    """SIGNATURE minwise tokens of 32 bits, then PRINTS more of 4 bits, which only sharpen estimates."""
    low = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint32)
    fine = np.full(PRINTS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(s), 512):
        part = s[at : at + 512]
        h = np.multiply.outer(part, _MUL)
        h += _ADD
        low = np.minimum(low, (h.min(axis=0) >> _U(32)).astype(np.uint32))
        h = np.multiply.outer((part >> _U(32)).astype(np.uint32), _MUL32)
        h += _ADD32
        fine = np.minimum(fine, h.min(axis=0))
    four = (fine & np.uint32(15)).astype(np.uint8)
    return low.tobytes() + (four[::2] | four[1::2] << np.uint8(4)).tobytes()


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["t"], strict=True):
            s = shingles(text)
            k1, k2 = (int(mix(s + c).sum(dtype=_U).view(np.int64)) for c in (_C1, _C3))
            out.append((doc_id, len(s), k1, k2, signature(s) if len(s) else None))
        yield pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "sig"]).astype({"doc_id": "Int64"})


def _children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each branch: ``node`` one a row, ``sig`` the rows' signatures."""
    rows, kids = [], []
    pick = mix(node + _C1)
    for j in range(2):
        on = np.arange(len(node)) if j == 0 else np.flatnonzero(mix(pick) % _U(3) == 0)
        c = (mix(pick[on] + _U(j + 7)) % _U(SIGNATURE)).astype(np.int64)
        rows.append(on)
        kids.append(mix(mix(node[on] * _P + c.astype(_U)) + sig[on, c].astype(_U) * _C1))
    return np.concatenate(rows), np.concatenate(kids)


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, 4 * SIGNATURE + PRINTS // 2)


def _tokens(sig: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(sig[:, : 4 * SIGNATURE]).view(np.uint32)


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seeds = mix(np.arange(1, TREES + 1, dtype=_U) * _C3)
    for pdf in batches:
        if len(pdf):
            sig = _tokens(_signatures(pdf["sig"]))
            ids = pdf["id"].to_numpy()
            for seed in seeds:
                rows, kids = _children(np.full(len(ids), seed), sig)
                yield pd.DataFrame({"node": kids.view(np.int64), "id": ids[rows]})


def _branch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            rows, kids = _children(pdf["node"].to_numpy().view(_U), _tokens(_signatures(pdf["sig"])))
            yield pd.DataFrame({"node": kids.view(np.int64), "id": pdf["id"].to_numpy()[rows]})


def _likeness(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Share of equal tokens and prints; 0 where the sizes alone rule the threshold out."""
    ok = 100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb)
    out = np.zeros(len(ok))
    at = np.flatnonzero(ok)
    if len(at):
        a, b = sa[at], sb[at]
        whole = (_tokens(a) == _tokens(b)).sum(axis=1)
        d = a[:, 4 * SIGNATURE :] ^ b[:, 4 * SIGNATURE :]
        same = (d & np.uint8(15) == 0).sum(axis=1) + (d < 16).sum(axis=1)
        # a sixteenth of unequal prints agree by chance
        out[at] = (whole + (same - PRINTS / 16) / (1 - 1 / 16)) / (SIGNATURE + PRINTS)
    return out


def _compare_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of node; each node has at most SMALL rows. Pairs across components that may be links."""
    rest: pd.DataFrame | None = None

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        node, ids, n, comp, sig = (pdf[c].to_numpy() for c in ("node", "id", "n", "component", "sig"))
        sig = _signatures(sig)
        left, right, like = [], [], []
        for gap in range(1, SMALL):
            i = np.flatnonzero(node[gap:] == node[:-gap]) if gap < len(node) else np.zeros(0, dtype=np.int64)
            if not len(i):
                break
            i = i[comp[i] != comp[i + gap]]
            same = _likeness(sig[i], sig[i + gap], n[i], n[i + gap])
            on = same >= MAYBE
            left.append(ids[i[on]])
            right.append(ids[i[on] + gap])
            like.append(same[on])
        a, b, e = (np.concatenate(x) if x else np.zeros(0) for x in (left, right, like))
        return pd.DataFrame({"a": np.maximum(a, b).astype(np.int64), "b": np.minimum(a, b).astype(np.int64), "e": e}).drop_duplicates(["a", "b"])

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf):
            cut = int((pdf["node"].to_numpy() != pdf["node"].iloc[-1]).sum())
            rest = pdf.iloc[cut:]
            if cut:
                yield pairs(pdf.iloc[:cut])
    if rest is not None and len(rest):
        yield pairs(rest)


def _compare_star(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets against the smallest set of their node: rows a, na, sa, b, nb, sb."""
    for pdf in batches:
        if len(pdf):
            e = _likeness(_signatures(pdf["sa"]), _signatures(pdf["sb"]), pdf["na"].to_numpy(), pdf["nb"].to_numpy())
            yield pdf[["a", "b"]].assign(e=e)[e >= MAYBE]


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b`` (sorted distinct hashes): incidence over the common elements."""
    na, nb = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
    ea, eb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(ea, eb)
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(common):
        return both.astype(np.int64)
    places = []
    for e, r in ((ea, ra), (eb, rb)):
        c = np.searchsorted(common, e)
        on = common[np.minimum(c, len(common) - 1)] == e
        order = np.argsort(c[on], kind="stable")
        places.append((c[on][order], r[on][order]))
    for lo in range(0, len(common), 4096):
        width = min(4096, len(common) - lo)
        sides = []
        for (c, r), n in zip(places, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(c, (lo, lo + width))
            m = np.zeros((n, width), dtype=np.float32)
            m[r[i:j], c[i:j] - lo] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    return both.astype(np.int64)


def _compare_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the links between two blocks of a node: components are joined once each."""
    for pdf in batches:
        out = []
        for left, right in zip(pdf["left"], pdf["right"], strict=True):
            ids, comps, sets = zip(*((list(r[k] for r in side) for k in ("id", "component", "set")) for side in (left, right)), strict=True)
            a, b = ([np.frombuffer(x, dtype=_U) for x in side] for side in sets)
            na, nb = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
            both = intersections(a, b)
            linked = (100 * both >= THRESHOLD * (na[:, None] + nb[None, :] - both)) & (np.array(comps[0])[:, None] != np.array(comps[1])[None, :])
            up: dict[int, int] = {}

            def root(x: int, up: dict[int, int] = up) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            for i, j in np.argwhere(linked).tolist():
                x, y = root(comps[0][i]), root(comps[1][j])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    u, v = ids[0][i], ids[1][j]
                    out.append((max(u, v), min(u, v)))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = np.zeros(len(pdf), dtype=bool)
        for i, (x, y) in enumerate(zip(pdf["sa"], pdf["sb"], strict=True)):
            a, b = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = 100 * both >= THRESHOLD * (len(a) + len(b) - both)
        yield pdf.loc[keep, ["a", "b"]]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["doc_id"], "set": [shingles(t).tobytes() for t in pdf["t"]]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    sketch = stage(src.mapInPandas(_sketch, "doc_id long, n long, k1 long, k2 long, sig binary"), "sketch")
    full = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stage(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id")), "classes")
    one = classes.join(full, ["n", "k1", "k2"]).filter("id = doc_id").select("id", "n", "sig").dropDuplicates(["id", "n", "sig"])
    sets = stage(one, "sets")

    # chosen paths, level by level
    nodes = stage(sets.mapInPandas(_roots, "node long, id long"), "nodes")
    levels = []
    for depth in range(1, DEPTH + 1):
        sizes = stage(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).filter("size > 1"), "sizes")
        alive = stage(nodes.join(sizes, "node"), f"level{depth}")
        unstage(nodes, sizes)
        levels.append(alive)
        large = alive.filter(F.col("size") > SMALL)
        if depth < DEPTH:
            nodes = stage(large.select("node", "id").join(sets, "id").mapInPandas(_branch, "node long, id long"), "nodes")
    every = levels[0]
    for more in levels[1:]:
        every = every.union(more)

    def sets_of(p: DataFrame) -> DataFrame:
        """Full sets of the documents on any pair."""
        wanted = p.select(F.col("a").alias("doc_id")).union(p.select("b")).distinct()
        return src.join(wanted, "doc_id", "left_semi").mapInPandas(_sets, "id long, set binary").dropDuplicates(["id", "set"])

    def confirm(p: DataFrame, s: DataFrame) -> DataFrame:
        left = p.select("a", "b").join(s.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        return left.join(s.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb").mapInPandas(_confirm, "a long, b long")

    def likeliest(p: DataFrame) -> DataFrame:
        """Per set its likeliest partner, the smallest of equals."""
        return p.groupBy("a").agg(F.max(F.struct(F.col("e"), (-F.col("b")).alias("b"))).alias("k")).select("a", (-F.col("k.b")).alias("b"))

    def labelled(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.join(comp.select(F.col("id").alias(c), F.col("component").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))

    def across(p: DataFrame) -> DataFrame:
        return labelled(labelled(p, "a", "ca"), "b", "cb").filter("ca != cb").select("a", "b", "e")

    def again(found: DataFrame) -> DataFrame:
        """Stage the links found so far, and the components they make."""
        nonlocal comp, links
        before = [x for x in (comp, links) if x is not None]
        links = stage(found, "links")
        comp = stage(components(links), "comp")
        unstage(*before)
        return links

    comp = links = None
    # sets against the smallest set of their nodes
    star = every.filter("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    star = star.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    star = star.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    stars = stage(star.select("a", "na", "sa", "b", "nb", "sb").mapInPandas(_compare_star, "a long, b long, e double"), "stars")
    first = stage(likeliest(stars), "first")
    again(confirm(first, sets_of(first)))
    unstage(first)

    # small nodes across components, and what the stars left
    small = labelled(every.filter(F.col("size") <= SMALL).select("node", "id"), "id", "component").join(sets, "id")
    small = small.select("node", "id", "n", "component", "sig").repartition("node").sortWithinPartitions("node")
    pairs = small.mapInPandas(_compare_small, "a long, b long, e double").union(stars).groupBy("a", "b").agg(F.max("e").alias("e"))
    pairs = stage(across(pairs), "pairs")
    held = stage(sets_of(pairs), "held")
    unstage(stars)
    again(links.union(confirm(likeliest(pairs), held)))
    again(links.union(confirm(across(pairs), held)))
    unstage(pairs, held)

    # nodes still large: exhaustively across components, in blocks
    mixed = labelled(levels[-1].filter(F.col("size") > SMALL).select("node", "id"), "id", "component").join(sets.select("id", "n"), "id")
    sizes = mixed.groupBy("node", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    main = sizes.groupBy("node").agg(F.max(F.struct("k", "component", "w")).alias("m"), F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("k"), F.sum("w").alias("w")).filter("kinds > 1")
    blocks_of = lambda k, w: F.greatest(F.lit(1), F.ceil(k / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    main = main.select("node", F.col("m.component").alias("main"), blocks_of(F.col("k"), F.col("w")).alias("n_left"), blocks_of(F.col("k") - F.col("m.k"), F.col("w") - F.col("m.w")).alias("n_right"))
    several = stage(mixed.join(main, "node"), "several")
    if several.limit(1).count():
        wanted = several.select(F.col("id").alias("doc_id")).distinct()
        texts = src.join(wanted, "doc_id", "left_semi").mapInPandas(_sets, "id long, set binary").dropDuplicates(["id", "set"])
        rows = stage(several.join(texts, "id"), "rows")
        member = F.struct("id", "component", "set")
        left = rows.withColumn("part", F.pmod(F.xxhash64("id"), "n_left").cast("int")).groupBy("node", "part").agg(F.collect_list(member).alias("left"))
        right = rows.filter("component != main").groupBy("node", "n_left", F.pmod(F.xxhash64("id"), "n_right").alias("r")).agg(F.collect_list(member).alias("right"))
        right = right.select("node", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("part"), "right")
        # few rows to a batch: each holds two blocks
        extra = stage(left.join(right, ["node", "part"]).select("left", "right").mapInPandas(_compare_blocks, "a long, b long"), "extra", batch=4)
        links = again(links.union(extra.distinct()))
        unstage(rows, extra)
    unstage(several)

    heads = stage(labelled(classes, "id", "component").select("n", "k1", "k2", "component"), "heads")
    unstage(sets, classes, comp, links, *levels)
    out = sketch.join(heads, ["n", "k1", "k2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
