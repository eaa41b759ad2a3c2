"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokens are counted where the text lies; only (id, piece, start, length, checksum) moves. The packing plan
depends on lengths alone, so it is made from the *histogram* of lengths (at most ``capacity`` counts, a
proven bound) on the driver and comes back as a table of runs:

* pieces longer than a third of the capacity are matched greedily, at most two to a sequence: the longest
  left opens a sequence and takes the longest other large piece that still fits;
* shorter pieces, longest first, go to the tightest gap that holds them; a new sequence opens only when
  no gap does.

Equal lengths are interchangeable, so a piece finds its place by its rank within its length. Ranks are
taken per (length, salt) and shifted by the counts of the salts before. A length gets salts by its count, about
``SALTS`` over all lengths: a length that a third of all rows share is never ranked in one task, and the driver
holds ``SALTS`` + ``capacity`` counts at most.

Defined cases: null text is empty and gives one piece of one token (the end id); an empty table gives an
empty result; rows that repeat an id are packed each on their own; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_of

CAPACITY = 4096
SALTS = 1 << 16
LEAST_PER_SALT = 256
END_ID = 1
#: Words kept with their ids in a worker, in each of two generations: words met again move to the young one, and
#: when that is full, the old one goes. Memory is bounded, and frequent words stay.
MEMO_WORDS = 200_000

# The normalizer and pre-tokenizer for which encoding word by word is exact.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_RARE_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
_TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Encodes texts word by word with a memo; exact for tokenizers that lower-case, split at white space
    and take runs of letters and runs of marks apart, as ``word_bpe_49k.json`` does. Others encode whole texts."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        self.by_word = [parts.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor")] == [NORMALIZER, PRE_TOKENIZER, None]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, definition: str) -> WordEncoder:
        """The encoder of this process: Python workers live on from task to task, and so does the memo."""
        held = sys.modules.setdefault("_quarrylight_encoders", types.ModuleType("_quarrylight_encoders")).__dict__
        key = hash(definition)
        if key not in held:
            held[key] = cls(definition)
        return held[key]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Puts words into the memo. Words of plain letters are encoded as one text: each is one run."""
        memo = self.memo
        plain = [w for w in words if w.isalpha() and (w.isascii() or max(w) < "\u0100")]
        for i in range(0, len(plain), 4_000):
            part = plain[i : i + 4_000]
            got = self.tok.encode(" ".join(part), add_special_tokens=False)
            raw = np.asarray(got.ids, dtype="<u4").tobytes()
            ends = (4 * np.searchsorted(np.asarray(got.word_ids), np.arange(len(part)), side="right")).tolist()
            at = 0
            for w, end in zip(part, ends, strict=True):
                memo[w] = raw[at:end]
                at = end
        rest = [w for w in words if w not in memo]
        for i in range(0, len(rest), 4_000):
            memo.update(zip(rest[i : i + 4_000], self._ids(rest[i : i + 4_000]), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            yield from self._ids(texts)
            return
        if len(self.memo) > MEMO_WORDS:
            self.old, self.memo = self.memo, {}
        memo = self.memo
        split = [None if _RARE_SPACE.search(t) else t.split() for t in texts]
        new = set().union(*filter(None, split)).difference(memo)
        old = self.old
        if old:  # words of the old generation move to the young one
            known = new.intersection(old)
            memo.update(zip(known, map(old.__getitem__, known), strict=True))
            new -= known
        # words with capitals or marks at the end are made of their parts, and forgotten after the texts
        made: dict[str, tuple[str, str]] = {}
        learn: set[str] = set()
        for w in new:
            core = w.rstrip(_TAIL)
            if core and core[-1].isalpha() and (core.isascii() or max(core) < "\u0100") and "<|" not in w:
                low, tail = core.lower(), w[len(core) :]
                if low != w:
                    made[w] = (low, tail)
                for part in (low, tail) if tail else (low,):
                    if part not in memo:
                        if part in old:
                            memo[part] = old[part]
                        else:
                            learn.add(part)
            else:
                learn.add(w)
        self._learn(list(learn))
        for w, (low, tail) in made.items():
            memo[w] = memo[low] + memo[tail] if tail else memo[low]
        for t, ws in zip(texts, split, strict=True):
            yield self._ids([t])[0] if ws is None else b"".join(map(memo.__getitem__, ws))
        for w in made:
            del memo[w]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than ``capacity`` are cut, the rest stay whole."""

    with open(tokenizer, encoding="utf-8") as f:  # read once, where the driver runs; its size does not depend on any data
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = WordEncoder.of_worker(definition.value)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for pdf in batches:
            out = []
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                for doc_id, raw in zip(part["doc_id"], enc.encode(part["t"].tolist()), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        x = raw[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(x) // 4, zlib.crc32(x)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return src.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, n, first sequence, offset, per sequence): ranks ``first .. first + n`` of a
    length fill sequences from ``first sequence`` on, ``per sequence`` side by side from ``offset``."""
    left = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]
    opened = 0

    def take(length: int, n: int, seq: int, offset: int, per: int) -> None:
        runs.append((length, used[length], n, seq, offset, per))
        used[length] += n
        left[length] -= n

    def leave(gap: int, seq: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((seq, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        b = large[i] if i >= 0 else None
        if b is None:
            n = left[a]
            take(a, n, opened, 0, 1)
            leave(capacity - a, opened, n)
        elif a == b:
            n = left[a] // 2
            if n:
                take(a, 2 * n, opened, 0, 2)
                leave(capacity - 2 * a, opened, n)
            elif i:  # one of this length is left: match it with the next smaller one
                n, b = 1, large[i - 1]
                take(a, 1, opened, 0, 1)
                take(b, 1, opened, a, 1)
                leave(capacity - a - b, opened, 1)
            else:
                n = 1
                take(a, 1, opened, 0, 1)
                leave(capacity - a, opened, 1)
        else:
            n = min(left[a], left[b])
            take(a, n, opened, 0, 1)
            take(b, n, opened, a, 1)
            leave(capacity - a - b, opened, n)
        opened += n
        large = [k for k in large if left[k]]
    sizes = sorted(gaps)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                per = capacity // length
                n = max(1, left[length] // per)
                gaps.setdefault(capacity, []).append((opened, n))
                bisect.insort(sizes, capacity)
                opened += n
                continue
            gap = sizes[i]
            seq, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[i]
            per = gap // length
            full = min(n, left[length] // per)
            rest = 0
            if full:
                take(length, full * per, seq, capacity - gap, per)
                new = [(gap - per * length, seq, full)]
            else:
                rest = left[length]
                take(length, rest, seq, capacity - gap, rest)
                full = 1
                new = [(gap - rest * length, seq, 1)]
            new.append((gap, seq + full, n - full))
            for g, s, k in new:
                if g and k:
                    if g not in gaps:
                        bisect.insort(sizes, g)
                    leave(g, s, k)
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (at most ``capacity``)."""
    # at most capacity counts, whatever the input's size
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(LEAST_PER_SALT, sum(counts.values()) / SALTS)
    n_salts = [max(1, -int(-counts.get(length, 0) // share)) for length in range(capacity + 1)]
    first = np.concatenate([[0], np.cumsum(n_salts)]).astype(np.int64)  # place of each length's first salt
    widths = F.lit(n_salts) if any(n > 1 for n in n_salts) else None
    salt = F.lit(0) if widths is None else F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(widths, F.col("length").cast("int") + 1)).cast("int")
    rows = parts.withColumn("_s", salt)
    per = rows.groupBy("length", "_s").agg(F.count(F.lit(1)).alias("n"))
    # at most SALTS + capacity small rows
    hist = per.toPandas().sort_values(["length", "_s"])
    hist["base"] = hist.groupby("length")["n"].cumsum() - hist["n"]
    bases = np.zeros(first[-1] + 1, dtype=np.int64)
    bases[first[hist["length"].to_numpy()] + hist["_s"].to_numpy()] = hist["base"]
    runs = np.asarray(plan(counts, capacity), dtype=np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sc = parts.sparkSession.sparkContext
    shared = sc.broadcast((first, bases, runs))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, base, run = shared.value
        span = np.int64(1) << 44
        keys = run[:, 0] * span + run[:, 1]
        for pdf in batches:
            length = pdf["length"].to_numpy()
            rank = base[start[length] + pdf["_s"].to_numpy()] + pdf["_r"].to_numpy() - 1
            r = run[np.searchsorted(keys, length * span + rank, side="right") - 1]
            k = rank - r[:, 1]
            yield pdf.drop(columns=["_s", "_r"]).assign(sequence_id=r[:, 3] + k // r[:, 5], offset=r[:, 4] + (k % r[:, 5]) * length)

    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_s").orderBy("doc_id", "piece")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(stage(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity)
