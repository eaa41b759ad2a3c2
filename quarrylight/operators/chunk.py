"""Text chunks with overlap, as one fold per text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

#: Characters of texts after which their chunks go out.
HELD = 1_000_000


def chunks(text: Column, size: int = 1400, overlap: int = 160, most: int | None = 24, collapsed: bool = False) -> Column:
    """Array of chunks. A full-width slice ends after its last space, if that lies beyond 55 per cent of the width; the next one starts ``overlap`` before. Without ``most``, the whole text."""
    t = text if collapsed else collapse(text)
    size, overlap = max(300, min(2400, size)), max(0, min(400, overlap))
    # a chunk that is not the last one moves on by more than 55 per cent of the width less the overlap
    steps = F.lit(most) if most else (F.ceil(F.length(t) / max(1, size * 55 // 100 - overlap)) + 1).cast("int")
    zero = F.struct(F.lit(1).alias("i"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        piece = F.substring(t, acc["i"], F.lit(size))
        full = F.length(piece) == size
        # position of the last space, from 0; -1 where there is none
        at = F.when(full, F.lit(size) - F.instr(F.reverse(piece), " ")).otherwise(F.length(piece))
        at = F.when(full & (F.instr(F.reverse(piece), " ") == 0), F.lit(-1)).otherwise(at)
        n = F.when(at > size * 0.55, at + 1).otherwise(F.length(piece))
        end = acc["i"] + n
        return F.when(acc["done"], acc).otherwise(
            F.struct(
                F.greatest(end - overlap, acc["i"] + 1).cast("int").alias("i"),
                (end - 1 >= F.length(t)).alias("done"),
                F.concat(acc["out"], F.array(F.trim(F.substring(t, acc["i"], n)))).alias("out"),
            )
        )

    folded = F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda a: F.filter(a["out"], lambda c: c != ""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(folded)


def cut(text: str, size: int, overlap: int, most: int | None) -> list[str]:
    """``chunks`` of one collapsed text, for a pass that goes over it once."""
    out, at = [], 0
    while at < len(text) and (most is None or len(out) < most):
        stop = min(len(text), at + size)
        if stop - at == size and (space := text.rfind(" ", at, stop)) - at > size * 0.55:
            stop = space + 1
        out.append(text[at:stop].strip(" "))
        if stop >= len(text):
            break
        at = max(stop - overlap, at + 1)
    return [c for c in out if c]


def _cuts(batches: Iterator[pd.Series], size: int, overlap: int, most: int | None) -> Iterator[pd.Series]:
    for t in batches:
        out, held = [], 0
        for x in t:
            out.append(cut(x, size, overlap, most))
            held += len(x)
            if held > HELD:
                yield pd.Series(out)
                out, held = [], 0
        if out:
            yield pd.Series(out)


def explode_chunks(df: DataFrame, text: str, size: int = 1400, overlap: int = 160, most: int | None = 24) -> DataFrame:
    """One row per chunk: the input's columns, chunk_index, chunk. Long texts are cut in one pass each. A worker holds the texts of an Arrow batch and the chunks of about ``HELD`` characters of them."""
    size, overlap = max(300, min(2400, size)), max(0, min(400, overlap))

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _cuts(batches, size, overlap, most)

    return df.select("*", F.posexplode(pieces(collapse(F.col(text)))).alias("chunk_index", "chunk"))
