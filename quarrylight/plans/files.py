"""Attached files, made of the documents: text, DOCX, PPTX and PDF containers, pictures with a landed reading, and files without text.

Every document becomes one file with its whole text. Its number decides the kind of container, so both engines see the same files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..sources import ingest
from .common import Query, like, table
from .texts import _CLEAN

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ENDINGS = ["txt", "docx", "pptx", "pdf", "png", "bin", "md"]


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def _boxed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of DOCX and PPTX containers; a slide per line."""
    for pdf in batches:
        made = []
        for ending, text in zip(pdf["ending"], pdf["t"], strict=True):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                if ending == "docx":
                    z.writestr("word/document.xml", f"<w:document><w:p><w:r><w:t xml:space='preserve'>{escape(text)}</w:t></w:r></w:p></w:document>")
                else:
                    z.writestr("docProps/app.xml", "<Properties/>")
                    for n, line in enumerate(text.split("\n"), 1):
                        z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld><a:t>{escape(line)}</a:t></p:sld>")
            made.append(out.getvalue())
        yield pd.DataFrame({"name": pdf["name"], "content": made})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, content."""
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.pmod("doc_id", F.lit(len(ENDINGS))) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("name"), ending.alias("ending"), F.coalesce("text", F.lit("")).alias("t"))
    pieces = F.regexp_extract_all("t", F.lit(r"[^\n]{1,400}"), 0)
    literals = F.transform(pieces, lambda x: F.concat(F.lit("("), F.regexp_replace(x, r"([\\()])", r"\\$1"), F.lit(") Tj")))
    pdf = F.encode(F.concat(F.lit("%PDF-1.4\n"), F.array_join(literals, "\n")), "ISO-8859-1")
    plain = F.when(F.col("ending").isin("txt", "md"), F.encode("t", "UTF-8")).when(F.col("ending") == "pdf", pdf).when(F.col("ending") == "png", F.lit(b"\x89PNG\r\n")).otherwise(F.lit(b"\x00\x01"))
    boxed = docs.filter(F.col("ending").isin("docx", "pptx")).select("name", "ending", "t").mapInPandas(_boxed, "name string, content binary")
    return docs.filter(~F.col("ending").isin("docx", "pptx")).select("name", plain.alias("content")).unionByName(boxed)


_USEFUL = "length({0}) >= 40 AND len(regexp_extract_all({0}, '[A-Za-zÀ-ɏ]')) >= 24"
_READ = f"({_USEFUL.format('c')}) AND NOT (c = '' OR ({like('lower(c)', answers.EXTRACT_FAILED)} AND NOT {like('lower(c)', answers.EXTRACT_REAL)}))"


@query(
    "attachment_ingest",
    rf"""WITH d AS (SELECT doc_id, ['txt', 'docx', 'pptx', 'pdf', 'png', 'bin', 'md'][CAST(doc_id % 7 AS INT) + 1] AS ending, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '[^\n]{{1,400}}'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[^\x00-\xFF]', '?', 'g'), '([\\()])', '\\\1', 'g'), '\\[nrt]', ' ', 'g'), '\\(.)', '\1', 'g'))), lambda x: x <> '') AS ls FROM d WHERE ending = 'pdf'),
l AS (SELECT doc_id, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), chr(10)) AS t FROM p),
g AS (SELECT d.doc_id, ending, CASE ending WHEN 'pdf' THEN CASE WHEN length(l.t) >= 20 THEN l.t ELSE '' END WHEN 'pptx' THEN array_to_string(string_split(d.t, chr(10))[1:30], chr(10) || chr(10)) WHEN 'bin' THEN '' ELSE d.t END AS t FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT doc_id, ending, t, trim(regexp_replace(t, '\s+', ' ', 'g')) AS c FROM g),
r AS (SELECT doc_id, ending, t, c, CASE ending WHEN 'bin' THEN false WHEN 'png' THEN length(c) >= 10 WHEN 'pdf' THEN {_USEFUL.format('c')} ELSE {_READ} END AS ok FROM c),
o AS (SELECT *, CASE WHEN NOT ok THEN '' WHEN ending = 'pdf' THEN 'Server text extraction (pdf_text_layer):' || chr(10) || trim(t) ELSE trim(t) END AS full_text FROM r)
SELECT 'doc-' || doc_id || '.' || ending AS name, ok, CASE WHEN NOT ok THEN 'none' WHEN ending IN ('txt', 'md') THEN 'client_text' WHEN ending = 'pdf' THEN 'pdf_text_layer' WHEN ending = 'png' THEN 'vision_analysis' ELSE 'client_office' END AS method,
  CASE WHEN NOT ok THEN 'none' WHEN ending = 'pdf' THEN 'server' WHEN ending = 'png' THEN 'vision' ELSE 'client' END AS provider, sha256(CASE WHEN length(full_text) > 120000 THEN substr(full_text, 1, 120000) || chr(10) || chr(10) || '[Truncated]' ELSE full_text END) AS text_sha256,
  CASE ending WHEN 'pdf' THEN 3 WHEN 'bin' THEN 0 WHEN 'png' THEN 1 WHEN 'txt' THEN CASE WHEN ok THEN 1 ELSE 2 END WHEN 'md' THEN CASE WHEN ok THEN 1 ELSE 2 END ELSE 1 END AS tries,
  CASE ending WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  WHEN 'pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' ELSE 'application/octet-stream' END AS mime FROM o""",
)
def attachment_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an attached file, through the cascade; pictures have a landed reading."""
    made = files(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    seen = docs.filter(F.pmod("doc_id", F.lit(len(ENDINGS))) == ENDINGS.index("png")).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), "text")
    out = ingest.ingest(made, seen=seen)
    return out.select("name", "ok", "method", "provider", F.sha2("text", 256).alias("text_sha256"), F.size("attempts").alias("tries"), "mime")
