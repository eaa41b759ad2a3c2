"""Text out of attached files: UTF-8, PDF literals, DOCX, PPTX, ZIP lists, and the cascade over them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clip, mime_of, useful_text


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """name, content: one row per file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def utf8_text(content: Column) -> Column:
    """Text of UTF-8 bytes; null where over two per cent of it are replacement characters."""
    t = F.make_valid_utf8(content.cast("string"))
    bad = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return F.when((F.length(t) > 0) & (bad <= F.length(t) * 0.02), t)


def pdf_literals(content: Column) -> Column:
    """Distinct string literals of an uncompressed PDF, joined by line feeds; null under 20 characters."""
    raw = F.decode(content, "ISO-8859-1")
    found = F.regexp_extract_all(raw, F.lit(r"\(((?:\\.|[^\\()]){1,800}+)\)"), 1)
    plain = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\\[nrt]", " "), r"\\(.)", "$1")))
    t = F.array_join(F.array_distinct(F.filter(plain, lambda x: x != "")), "\n")
    return F.when(F.substring(raw, 1, 5).startswith("%PDF") & (F.length(t) >= 20), t)


def _xml_texts(xml: str, tag: str) -> list[str]:
    out = []
    for body in re.findall(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", xml, re.S):
        for ref, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            body = body.replace(ref, to)
        out.append(body)
    return out


def office_text(content: bytes, slides: int = 30) -> tuple[str | None, str | None, list[str]]:
    """(kind, text, entry names) of a ZIP container: docx, pptx, or neither."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "word/document.xml" in names:
                return "docx", " ".join(_xml_texts(z.read("word/document.xml").decode("utf-8", "replace"), "w:t")), names
            pages = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
            if pages:
                return "pptx", "\n\n".join(" ".join(_xml_texts(z.read(n).decode("utf-8", "replace"), "a:t")) for n in pages[:slides]), names
            return "zip", None, names
    except (zipfile.BadZipFile, KeyError, ValueError, OSError):
        return None, None, []


def with_office(files: DataFrame) -> DataFrame:
    """Adds office_kind, office_text and entries; only ZIP containers are opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [office_text(bytes(c)) if c is not None and bytes(c[:2]) == b"PK" else (None, None, []) for c in pdf["content"]]
            yield pdf.assign(office_kind=[g[0] for g in got], office_text=[g[1] for g in got], entries=[g[2] for g in got])

    return files.select("name", "content").mapInPandas(run, "name string, content binary, office_kind string, office_text string, entries array<string>")


def extract(files: DataFrame) -> DataFrame:
    """name, mime, method, text, attempts: the first way that gives useful text; metadata_only where none does."""
    f = with_office(files)
    ways = {
        "utf8": F.when(~F.col("content").startswith(F.lit(b"PK")) & ~F.col("content").startswith(F.lit(b"%PDF")), utf8_text(F.col("content"))),
        "pdf": pdf_literals(F.col("content")),
        "docx": F.when(F.col("office_kind") == "docx", F.col("office_text")),
        "pptx": F.when(F.col("office_kind") == "pptx", F.col("office_text")),
    }
    f = f.select("name", "content", *[c.alias(k) for k, c in ways.items()])
    good = {k: F.col(k).isNotNull() & (F.trim(k) != "") & ((F.lit(k) == "utf8") | useful_text(F.col(k))) for k in ways}
    method = F.coalesce(*[F.when(ok, F.lit(k)) for k, ok in good.items()], F.lit("metadata_only"))
    text = F.coalesce(*[F.when(ok, F.col(k)) for k, ok in good.items()], F.concat(F.lit("Attached file: "), F.col("name")))
    tried = F.array(*[F.struct(F.lit(k).alias("stage"), F.coalesce(ok, F.lit(False)).alias("ok")) for k, ok in good.items()])
    return f.select("name", mime_of(F.col("name")).alias("mime"), method.alias("method"), clip(text).alias("text"), tried.alias("attempts"))
