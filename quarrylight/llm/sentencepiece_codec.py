"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the pieces.

The automaton reads a text once; at each position its output links name every piece that ends there, and
each such piece tries to improve what is known of that position:

* unigram models: best sum of scores (Viterbi) over the whole text; a character that is no piece of its own is also an edge of the
  unknown score (10 below the lowest), so it may be lost to bytes or the unknown id, or be part of a longer piece;
* byte-pair models: the encoding of a prefix ends in exactly one piece, the one that stands *compatibly*
  after the encoding of what is before it (merging the two pieces' characters gives the two pieces back).
  A sum of scores would not give the merges' result, so that check replaces it; the pass, the automaton
  and the output links are the same. Results equal the library's.

Characters that no piece holds become byte pieces where the model has them. Text is taken through the
model's own rules: an optional leading space, spaces as ``SPACE``. Decoding joins pieces, turns byte
pieces into UTF-8 (invalid bytes into U+FFFD) and drops the added space.

``as_unigram`` reads a byte-pair vocabulary as a unigram model: a piece's score is the log of its share under Zipf's law
of its rank. Models with a normalisation map of their own are refused, as the map is not applied here.

Words are remembered in a bounded memo where no piece crosses from a word into the next space; words of ``MEMO_CHARS`` characters or more are not,
so the memo is bounded in bytes. Unknown characters side by side are one unknown id.

Defined cases: null text is empty and gives no ids; every text without the space mark itself round-trips as long
as the model has byte pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACE = "▁"
MEMO, MEMO_CHARS = 500_000, 64
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MARKS = ".,;:!?|\"'()$%&*#"
# Fixed values of the model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def as_unigram(model: bytes) -> bytes:
    """The pieces of a model as a unigram model: the score of the n-th piece is -log(n)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for rank, p in enumerate((p for p in proto.pieces if p.type == NORMAL), start=2):
        p.score = -math.log(rank)
    return proto.SerializeToString()


class Codec:
    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.is_bpe = proto.trainer_spec.model_type == 2
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.squeeze = proto.normalizer_spec.remove_extra_whitespaces
        if proto.normalizer_spec.precompiled_charsmap:
            raise ValueError("a model with a normalisation map of its own is not supported")
        self.unk = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, k in enumerate(kinds) if k in (CONTROL, UNKNOWN)}
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER)]
        self.score = {i: float(np.float32(proto.pieces[i].score)) for i in usable}
        self.id = {self.pieces[i]: i for i in usable}
        self.lowest = min((self.score[i] for i in usable if kinds[i] == NORMAL), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in usable)
        self.memo: dict[str, bytes] = {}
        self.pair: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.odd = np.zeros(len(self.pieces), dtype=bool)
        self.odd[[*self.byte_of, *self.control]] = True

    # --- byte-pair models
    def _merged(self, chars: list[str]) -> list[str]:
        """Symbols after all merges: the best-scored pair first, the leftmost of equals."""
        while True:
            best, at = None, -1
            for i in range(len(chars) - 1):
                k = self.id.get(chars[i] + chars[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                return chars
            chars[at : at + 2] = [chars[at] + chars[at + 1]]

    def _compatible(self, a: int, b: int) -> bool:
        """Do the characters of two pieces side by side merge into just these pieces."""
        key = a << 20 | b
        ok = self.pair.get(key)
        if ok is None:
            if len(self.pair) > 4 * MEMO:
                self.pair.clear()
            x, y = self.pieces[a], self.pieces[b]
            ok = self.pair[key] = self._merged([*x, *y]) == [x, y]
        return ok

    def _whole(self, piece: int) -> bool:
        """Does a piece come out of its own characters."""
        ok = self.whole.get(piece)
        if ok is None:
            ok = self.whole[piece] = self._merged([*self.pieces[piece]]) == [self.pieces[piece]]
        return ok

    def _known(self, text: str) -> list[int]:
        """Ids of a byte-pair model for a text all of whose characters are pieces."""
        n = len(text)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        pair = self.pair
        for end, (size, piece) in self.automaton.iter(text):
            stop = end + 1
            if last[stop] >= 0:
                continue
            start = stop - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pair.get(before << 20 | piece)
                if ok is None:
                    ok = self._compatible(before, piece)
            else:
                ok = self._whole(piece)
            if ok:
                last[stop], back[stop] = piece, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _best(self, text: str) -> list[int]:
        """Ids of the best sum of scores of a text."""
        n, score, lowest = len(text), self.score, self.lowest
        last, back = [-1] * (n + 1), list(range(-1, n))
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        lone = [i for i, c in enumerate(text) if c not in self.id]  # places with an unknown edge
        lone.append(n)
        k = 0
        for end, (size, piece) in self.automaton.iter(text):
            stop = end + 1
            while lone[k] < end:  # places before this end are final
                i = lone[k]
                if best[i] + lowest > best[i + 1]:
                    best[i + 1], last[i + 1], back[i + 1] = best[i] + lowest, -1, i
                k += 1
            total = best[stop - size] + score[piece]
            if total > best[stop]:
                best[stop], last[stop], back[stop] = total, piece, stop - size
        for i in lone[k:-1]:
            if best[i] + lowest > best[i + 1]:
                best[i + 1], last[i + 1], back[i + 1] = best[i] + lowest, -1, i
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "replace"))]
            else:
                out.append(self.unk)
            at = back[at]
        return out[::-1]

    def _chunk(self, text: str) -> list[int]:
        """The ids of a text. For byte-pair models stretches of known characters are encoded, the rest becomes bytes or the unknown id."""
        if not self.is_bpe:
            return self._best(text)
        out: list[int] = []
        for known, part in groupby(text, self.id.__contains__):
            part = "".join(part)
            if known:
                out += self._known(part)
            elif self.bytes:
                out += [self.bytes[b] for b in part.encode("utf-8", "replace")]
            else:
                out.append(self.unk)
        return out

    def _word(self, word: str) -> bytes:
        """A word through the memo. For byte-pair models its letters and the marks at its end are looked up
        apart and joined where the pieces that meet are compatible, which makes the join the encoding."""
        got = self.memo.get(word)
        if got is None:
            core = word.rstrip(_MARKS)
            if self.is_bpe and core and core != word and core != SPACE:
                a, b = self._word(core), self._word(word[len(core) :])
                x, y = int.from_bytes(a[-4:], "little"), int.from_bytes(b[:4], "little")
                if x in self.score and y in self.score and self._compatible(x, y):
                    got = a + b
            if got is None:
                got = np.asarray(self._chunk(word), dtype="<i4").tobytes()
            if len(word) < MEMO_CHARS:
                self.memo[word] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = ((" " if self.prefix else "") + text).replace(" ", SPACE)
        if not self.by_word:
            return self._joined([np.asarray(self._chunk(text), dtype="<i4").tobytes()])
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, words = self.memo, _WORDS.findall(text)
        fresh = {w: self._word(w) for w in set(words) if w not in memo}
        if all(w in memo for w in fresh):
            return self._joined([memo[w] for w in words])
        return self._joined([memo[w] if w in memo else fresh[w] for w in words])

    def _joined(self, parts: list[bytes]) -> bytes:
        out = b"".join(parts)
        if self.bytes:
            return out
        ids = np.frombuffer(out, dtype="<i4")
        unknown = ids == self.unk
        again = np.append(False, unknown[1:] & unknown[:-1])
        return ids[~again].tobytes() if again.any() else out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    @classmethod
    def of_worker(cls, model: bytes) -> Codec:
        """The codec of this process: Python workers live on from task to task, and so does the memo."""
        held = sys.modules.setdefault("_quarrylight_codecs", types.ModuleType("_quarrylight_codecs")).__dict__
        key = hash(model)
        if key not in held:
            held[key] = cls(model)
        return held[key]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        if not self.odd[ids].any():
            text = "".join(map(self.pieces.__getitem__, ids.tolist())).replace(SPACE, " ")
            return text[1:] if self.prefix and text.startswith(" ") else text
        ids = ids.tolist()
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i >= 0 and i not in self.control:
                out.append(self.pieces[i])
            elif i == self.unk:
                out.append(" ⁇ ")
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _shared_model(df: DataFrame, path: str, unigram: bool = False):
    """The vocabulary file, read once where the driver runs; its size does not depend on any data."""
    with open(path, "rb") as f:
        model = f.read()
    return df.sparkSession.sparkContext.broadcast(as_unigram(model) if unigram else model)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", unigram: bool = False) -> DataFrame:
    """doc_id, ids: the ids of each text; with ``unigram`` by the best sum of scores of ``as_unigram``."""

    model = _shared_model(docs, model_path, unigram)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of_worker(model.value)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [np.frombuffer(codec.encode_bytes(t), dtype="<i4") for t in part["t"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, text: the texts that the ids spell."""

    model = _shared_model(encoded, model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of_worker(model.value)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                ids = [np.asarray(x, dtype="<u4") for x in part["ids"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "n_ids": [len(x) for x in ids],
                        "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                        "text": [codec.decode(x) for x in ids],
                    }
                )

    return encoded.mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, text string")
