"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes when a ``LENGTH``-byte string that covers it also starts anywhere else (another document or the
same one). The work is cut so that no task needs the corpus, and nothing is missed:

1. *Candidates.* Every 400-byte window picks the smallest hash among its ``GRAM``-byte grams (leftmost on
   ties). Equal windows pick equal grams, so runs of neighbouring windows with one pick are keyed by it; a
   key seen once in the whole corpus holds no repeat. Only thin rows (key, document, run) are shuffled.
2. *Fragments.* Runs of repeated keys are cut out of their texts with all bytes their windows need.
   Equal fragments under a key combine map-side into one with a count. A key met more than ``HOT_RUNS``
   times is split by offset from its gram and by the bytes common to all windows of that offset range (the
   range narrows as the key gets hotter, down to single windows), so a passage that a third of all
   documents share spreads over many keys, and combines, too.
3. *Suffix arrays.* The fragments of a task come in batches; a batch is dealt over shards, each shard sorts
   its suffixes and writes its Burrows-Wheeler transform over symbols of ``SYMBOL`` bytes. Shards are
   merged by interleave refinement: the interleave that is right for h symbols is dealt by preceding
   symbol into the one for h + 1, block borders go along, and no suffix is sorted again. After
   ``LENGTH / SYMBOL`` rounds a block is the set of suffixes that share 400 bytes: blocks of two or more
   are the repeated intervals.
4. Covered intervals return to the documents over (key, fragment hash) and are united there.

Defined cases: null text is empty; documents under 400 bytes lose nothing; rows that repeat an id are
documents of their own, and equal rows lose all bytes that 400-byte strings cover; an empty table gives an
empty result; other columns are ignored. Symbols and keys are 64-bit hashes of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, unstage

LENGTH = 400
GRAM = 128
SYMBOL = 80
MAX_RUN = 4096
PART = 1 << 22
HOT_RUNS = 4096
BATCH_BYTES = 160_000

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C2
    x = (x ^ (x >> _U(27))) * _C3
    return x ^ (x >> _U(31))


def eights(raw: bytes) -> np.ndarray:
    """The 8 bytes from each position on as one number."""
    n = len(raw) - 7
    out = np.empty(max(0, n), dtype=_U)
    for o in range(min(8, max(0, n))):
        out[o::8] = np.frombuffer(raw, dtype="<u8", count=(n - o + 7) // 8, offset=o)
    return out


def grams(raw: bytes) -> np.ndarray:
    """64-bit hashes of the ``GRAM`` bytes from each position on."""
    h, k = eights(raw), 8
    while k < GRAM:
        h = mix(h[:-k] * _C1 + h[k:]) if len(h) > k else h[:0]
        k *= 2
    return h


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``LENGTH`` bytes the hash of its picked gram, and the gram's position.

    A pick depends on its window alone, so long texts go in overlapping parts, and positions fit beside the hashes.
    """
    if len(raw) > PART + LENGTH:
        keys, at = zip(*(windows(raw[a : a + PART + LENGTH - 1]) for a in range(0, len(raw) - LENGTH + 1, PART)), strict=True)
        return np.concatenate(keys), np.concatenate([x + i * PART for i, x in enumerate(at)])
    h = grams(raw)
    w = LENGTH - GRAM + 1
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    key = (h >> _U(26) << _U(26)) | np.arange(len(h), dtype=_U)  # PART is below 2 ** 26
    rows = -(-len(h) // w)
    block = np.full(rows * w, ~_U(0), dtype=_U)
    block[: len(h)] = key
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _U((1 << 26) - 1)).astype(np.int64)
    return h[at], at


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text index, key, first start, last start, picked positions) of the runs of all texts."""
    raw = b"".join(texts)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    base = np.cumsum(lens) - lens
    key, at = windows(raw)
    starts = np.arange(len(key))
    doc = np.repeat(np.arange(len(texts)), lens)[: len(key)]
    ok = starts + LENGTH <= (base + lens)[doc]
    starts, key, at, doc = starts[ok], key[ok], at[ok], doc[ok]
    if not len(starts):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    local = starts - base[doc]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (local[1:] % MAX_RUN == 0)
    moved = np.ones(len(starts), dtype=np.int64)
    moved[1:] = (at[1:] != at[:-1]) | new[1:]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], key[first].view(np.int64), local[first], local[last], np.add.reduceat(moved, first)


def split_hot(frag: bytes, width: int) -> list[tuple[int, int, int]]:
    """(sub-key, first start, last start): starts of a hot fragment by offset range and common bytes."""
    key, at = windows(frag)
    starts = np.arange(len(key))
    part = (at - starts) // width
    cut = np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1])) + 1
    out = []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
        lo, hi = at[a] - part[a] * width, at[a] - (part[a] + 1) * width + 1 + LENGTH  # bytes that every window of this range holds
        lo, hi = max(0, int(lo)), int(hi)
        digest = hashlib.blake2b(frag[lo:hi], digest_size=8, key=int(part[a]).to_bytes(8, "little", signed=True)).digest()
        out.append((int.from_bytes(digest, "little", signed=True) ^ int(key[a].view(np.int64)), a, b - 1))
    return out


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


class Shard:
    """Suffixes of some fragments in order, with the symbol before each."""

    def __init__(self, sym: np.ndarray, nxt: np.ndarray, prev: np.ndarray):
        """sym: symbol of each position (from 1); nxt, prev: the position a symbol on and back, or -1."""
        n = len(sym)
        rank, jump = sym, nxt
        # to the end of every chain, so that the order agrees with that of the suffixes a symbol on
        while (jump >= 0).any():
            far = np.where(jump >= 0, rank[jump] + 1, 0)
            rank = _dense(rank * np.int64(n + int(sym.max()) + 2) + far)
            jump = np.where(jump >= 0, jump[jump], -1)
        ends = np.flatnonzero(nxt < 0)
        self.order = np.argsort(rank, kind="stable")
        before = prev[self.order]
        # the empty suffixes come first; before each stands the last symbol of its chain, in suffix order
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        tails = ends[np.argsort(place[ends], kind="stable")]
        self.n_ends = len(tails)
        self.bwt = np.concatenate([sym[tails], np.where(before >= 0, sym[before], 0)])


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes (without the empty ones) and the block of each, right for ``rounds`` symbols."""
    total_ends = sum(s.n_ends for s in shards)
    top = max(int(s.bwt.max()) for s in shards)
    kind = np.uint16 if top < 65_000 else np.int64
    heads = np.concatenate([np.full(s.n_ends, i, dtype=np.int8) for i, s in enumerate(shards)])
    z = np.concatenate([heads, np.concatenate([np.full(len(s.bwt) - s.n_ends, i, dtype=np.int8) for i, s in enumerate(shards)])])
    block = np.zeros(len(z), dtype=np.int64)  # no symbol compared yet: all are alike
    own = [s.bwt.astype(kind) for s in shards]
    for _ in range(rounds):
        c = np.empty(len(z), dtype=kind)
        for i in range(len(shards)):
            c[z == i] = own[i]
        put = np.argsort(c, kind="stable")
        put = put[np.searchsorted(c[put], 1) :]  # suffixes at a fragment's start have nothing before them
        cs, bs = c[put], block[put]
        new = np.ones(len(put), dtype=np.int64)
        new[1:] = (cs[1:] != cs[:-1]) | (bs[1:] != bs[:-1])
        z = np.concatenate([heads, z[put]])
        block = np.concatenate([np.zeros(total_ends, dtype=np.int64), np.cumsum(new)])
    return z[total_ends:], block[total_ends:]


def repeated_starts(frags: list[bytes], n_shards: int = 2) -> list[np.ndarray]:
    """For each fragment, by start: do its ``LENGTH`` bytes from there on stand at another start of any fragment."""
    raw = b"".join(frags)
    lens = np.fromiter(map(len, frags), dtype=np.int64, count=len(frags))
    base = np.cumsum(lens) - lens
    e = eights(raw + b"\0" * 7)
    n = len(raw) - SYMBOL + 1
    h = e[:n].copy()
    for o in range(8, SYMBOL, 8):
        h = mix(h * _C1 + e[o : o + n])
    frag = np.repeat(np.arange(len(frags)), lens)[:n]
    pos = np.flatnonzero(np.arange(n) + SYMBOL <= (base + lens)[frag])
    sym_all = _dense(h[pos]) + 1
    frag = frag[pos]
    shards, members = [], []
    for k in range(min(n_shards, len(frags))):
        mine = np.flatnonzero(frag % n_shards == k)
        where = np.full(n + SYMBOL, -1, dtype=np.int64)
        where[pos[mine]] = np.arange(len(mine))
        p = pos[mine]
        same = lambda q, p=p, mine=mine: np.where((q >= base[frag[mine]]), where[np.maximum(q, 0)], -1)
        nxt = where[p + SYMBOL]
        nxt = np.where(p + 2 * SYMBOL <= (base + lens)[frag[mine]], nxt, -1)
        shards.append(Shard(sym_all[mine], nxt, same(p - SYMBOL)))
        members.append(mine)
    z, block = merge(shards, LENGTH // SYMBOL)
    is_start = pos + LENGTH <= (base + lens)[frag]
    # suffix of each place of the interleave
    at = np.empty(len(z), dtype=np.int64)
    for k, s in enumerate(shards):
        at[z == k] = members[k][s.order]
    live = is_start[at]
    sizes = np.bincount(block[live], minlength=int(block.max()) + 1 if len(block) else 1)
    hit = np.zeros(len(pos), dtype=bool)
    hit[at[live]] = sizes[block[live]] > 1
    out, per = [], np.bincount(frag, minlength=len(frags))
    ends = np.cumsum(per)
    for i in range(len(frags)):
        out.append(hit[ends[i] - per[i] : ends[i] - per[i] + max(0, lens[i] - LENGTH + 1)])
    return out


def covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte intervals that windows at the marked starts cover."""
    if starts.all():
        return [(0, len(starts) + LENGTH - 1)] if len(starts) else []
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    cut = np.flatnonzero(at[1:] - at[:-1] > LENGTH) + 1
    return [(int(at[a]), int(at[b - 1]) + LENGTH) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True)]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lo, size = 0, 0
        texts = [t.encode("utf-8", "replace") for t in pdf["t"]]
        rid = pdf["rid"].to_numpy()
        for i in range(len(texts) + 1):
            if i == len(texts) or size > 2_000_000:
                if i > lo:
                    doc, key, s, e, k = runs_of(texts[lo:i])
                    yield pd.DataFrame({"m": key, "rid": rid[lo:i][doc], "s": s, "e": e, "k": k})
                lo, size = i, 0
            if i < len(texts):
                size += len(texts[i])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out, size = [], 0
        for rid, text, runs in zip(pdf["rid"], pdf["t"], pdf["runs"], strict=True):
            raw = text.encode("utf-8", "replace")
            for r in runs:
                s, e, n = r["s"], r["e"], r["n"]
                frag = raw[s : e + LENGTH]
                if n <= HOT_RUNS:
                    out.append((r["m"], frag, rid, s))
                else:
                    width = 32 if n <= 16 * HOT_RUNS else 8 if n <= 256 * HOT_RUNS else 1
                    out += [(key, frag[a : b + LENGTH], rid, s + a) for key, a, b in split_hot(frag, width)]
                size += len(frag)
            if size > 4_000_000:
                yield pd.DataFrame(out, columns=["m", "frag", "rid", "s"])
                out, size = [], 0
        yield pd.DataFrame(out, columns=["m", "frag", "rid", "s"])


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of key: batches of whole keys."""
    keep: list[tuple] = []  # of the batch: key, fragment, hash, count
    bucket: list[tuple] = []
    size = 0

    def result(rows: list[tuple]) -> pd.DataFrame:
        out = []
        found = iter(repeated_starts([r[1] for r in rows]))
        for m, frag, fh, n in rows:
            hit = next(found)
            spans = [(0, len(frag))] if n > 1 else covered(hit)
            if spans:
                out.append((m, fh, len(frag), [{"lo": a, "hi": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["m", "fh", "len", "spans"])

    def close() -> pd.DataFrame | None:
        """Put the finished bucket into the batch; lone fragments that stand at several places are done."""
        nonlocal size
        done = None
        if len(bucket) == 1 and bucket[0][3] > 1:
            m, frag, fh, _ = bucket[0]
            done = pd.DataFrame([(m, fh, len(frag), [{"lo": 0, "hi": len(frag)}])], columns=["m", "fh", "len", "spans"])
        else:
            keep.extend(bucket)
            size += sum(len(r[1]) for r in bucket)
        bucket.clear()
        return done

    for pdf in batches:
        lone = []
        for r in zip(pdf["m"], pdf["frag"], pdf["fh"], pdf["n"], strict=True):
            if bucket and bucket[0][0] != r[0]:
                if (done := close()) is not None:
                    lone.append(done)
                if size > BATCH_BYTES:
                    yield result(keep)
                    keep, size = [], 0
            bucket.append(r)
        if lone:
            yield pd.concat(lone)
    if bucket and (done := close()) is not None:
        yield done
    if keep:
        yield result(keep)


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for rid, text, spans in zip(pdf["rid"], pdf["t"], pdf["spans"], strict=True):
            raw = text.encode("utf-8", "replace")
            parts, at, spans_n = [], 0, 0
            end = -1
            for s in sorted((x["lo"], x["hi"]) for x in spans):
                if s[0] > end:
                    spans_n += 1
                    parts.append(raw[max(at, 0) : s[0]])
                end = max(end, s[1])
                at = end
            parts.append(raw[max(at, 0) :])
            left = b"".join(parts)
            out.append((rid, len(raw) - len(left), spans_n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        yield pd.DataFrame(out, columns=["rid", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text: what is left, without cut characters; input columns ``carry`` as in_<name>)."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = text_of(text_col)
    src = docs.select(F.xxhash64(F.col(id_col), t).alias("rid"), t.alias("t"))
    runs = stage(src.filter(F.octet_length("t") >= LENGTH).mapInPandas(_runs, "m long, rid long, s long, e long, k long"), "runs")
    seen = runs.groupBy("m").agg(F.sum("k").alias("n")).filter("n > 1")
    marked = runs.join(seen, "m").groupBy("rid").agg(F.collect_set(F.struct("m", "s", "e", "n")).alias("runs"))
    held = src.join(marked, "rid")
    texts = stage(held, "held")
    unstage(runs)
    frags = stage(texts.mapInPandas(_cut, "m long, frag binary, rid long, s long").withColumn("fh", F.xxhash64("frag")), "frags")
    distinct = frags.groupBy("m", "fh", "frag").agg(F.count(F.lit(1)).alias("n"))
    dealt = distinct.repartition(n_parts, "m").sortWithinPartitions("m")
    found = stage(dealt.select("m", "frag", "fh", "n").mapInPandas(_solve, "m long, fh long, len int, spans array<struct<lo: int, hi: int>>"), "spans")
    back = (
        frags.select("m", "fh", "rid", "s")
        .join(found, ["m", "fh"])
        .select("rid", F.explode(F.transform("spans", lambda x: F.struct((x["lo"] + F.col("s")).alias("lo"), (x["hi"] + F.col("s")).alias("hi")))).alias("span"))
    )
    spans = back.groupBy("rid").agg(F.collect_set("span").alias("spans"))
    # rows that are equal in id and text share a rid: one of them is cut, all take its result
    cut = texts.select("rid", "t").join(spans, "rid").mapInPandas(_remove, "rid long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    if not with_text:
        cut = cut.drop("kept_text")
    cut = stage(cut, "cut").dropDuplicates(["rid"])
    unstage(texts, frags, found)
    extra = [F.when(F.col("rid_").isNull(), F.col("t")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), t).alias("rid"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("whole"), *([t.alias("t")] if with_text else []), *[F.col(c).alias(f"in_{c}") for c in carry]
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(cut.withColumn("rid_", F.col("rid")), "rid", "left").select(
        "doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *extra, *[f"in_{c}" for c in carry]
    )
