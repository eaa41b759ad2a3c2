"""Ingest of attached files as a cascade: what can be read near the file first, then the server's ways, then texts that a model has seen in it.

Each tier gets only the files that the tiers before could not read: what is left is written and read again, so a file's bytes go through an
extractor once, and archives are opened only for what still needs them. Every try is noted. Files are rows (name, content), as Spark's
``binaryFile`` reader gives them from any store it reads.

Texts that other services give are tables that have landed: ``layers`` (name, text) of a PDF's own text layer, ``seen`` (name, text) of what a model
read in pictures or rendered pages.

Defined cases: null content is an empty file, which no tier reads; a name without an ending has the kind ``file``; rows that repeat a name are
ingested each; landed tables have one text a name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as T
from ..functions.policy import merged_pdf_text
from .attachments import pdf_literals, utf8_text, with_office
from .shared import written

# Endings of names.
TEXT_ENDINGS = "txt|md|markdown|json|jsonl|csv|tsv|xml|html|htm|css|js|mjs|cjs|ts|tsx|jsx|py|java|cpp|c|h|cs|go|rs|rb|php|sh|yaml|yml|toml|ini|log|sql|rtf"
IMAGE_ENDINGS = "jpe?g|png|gif|webp|bmp|tiff?|heic|heif|avif"

#: The least length of a text that a model saw in a picture, and of what PDFs are accepted with.
SEEN, MERGED = 10, 40

_TRY = "array<struct<stage:string,ok:boolean>>"


def kind_of(name: Column) -> Column:
    low = F.lower(T.s(name))
    ends = lambda e: low.rlike(rf"\.(?:{e})$")
    return F.when(ends(TEXT_ENDINGS), "text").when(ends("pdf"), "pdf").when(ends("docx"), "docx").when(ends("pptx"), "pptx").when(ends(IMAGE_ENDINGS), "image").otherwise("file")


def is_read(text: Column) -> Column:
    """A text that is of use: long enough, with letters, and no mere note about the file."""
    return T.useful_text(text) & ~answers.metadata_only(text)


def _tier(left: DataFrame, stage: str, provider: str, kinds: tuple[str, ...], read: Callable[[DataFrame], DataFrame], found: Callable[[Column], Column], accept: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(done, left) after ``stage``: ``read`` adds the column ``got`` to the rows of ``kinds``; ``found`` is what counts as a successful try, ``accept`` what ends the cascade."""
    mine = F.col("kind").isin(*kinds)
    tried = written(read(left.filter(mine)).withColumn("attempts", F.concat("attempts", F.array(F.struct(F.lit(stage).alias("stage"), F.coalesce(found(F.col("got")), F.lit(False)).alias("ok"))))).withColumn("_ok", F.coalesce(accept(F.col("got")), F.lit(False))), "tier")
    done = tried.filter("_ok").select("name", "kind", F.lit(True).alias("ok"), F.lit(stage).alias("method"), F.lit(provider).alias("provider"), T.clip(F.col("got")).alias("text"), "attempts")
    return done, left.filter(~mine).unionByName(tried.filter("NOT _ok").select(*left.columns))


def _office(files: DataFrame) -> DataFrame:
    """``got``: the text of the container, if it is of the kind that its name says."""
    files = files.withColumn("_id", F.monotonically_increasing_id())
    files = written(files, "containers")  # the number is kept beside the bytes, so reading again gives the same
    texts = with_office(files.select(F.col("_id").cast("string").alias("name"), "content")).select(F.col("name").cast("long").alias("_id"), "office_kind", "office_text")
    return files.join(texts, "_id").withColumn("got", F.when(F.col("office_kind") == F.col("kind"), F.col("office_text"))).drop("_id", "office_kind", "office_text")


def _pdfs(files: DataFrame, layers: DataFrame, seen: DataFrame) -> DataFrame:
    """A PDF's layer, else the literals in its bytes, and what a model saw on its pages, as one text without repeats."""
    landed = lambda t, as_: t.select("name", F.col("text").alias(as_))
    rows = files.join(landed(layers, "layer"), "name", "left").join(landed(seen, "view"), "name", "left")
    layer = F.coalesce(is_read(F.col("layer")), F.lit(False))
    # the bytes are searched only where the layer is of no use
    rows = rows.withColumn("literals", F.when(~layer, pdf_literals(F.col("content")))).withColumn("layer_ok", layer)
    rows = rows.withColumns({"server_ok": F.coalesce(T.useful_text(F.col("literals")), F.lit(False)), "view_ok": F.length(T.trim(F.col("view"))) >= MERGED})
    titled = lambda title, c, ok: F.when(ok, F.concat(F.lit(title), T.trim(c)))
    merged = T.clip(
        merged_pdf_text(
            titled("PDF text layer (client_pdf):\n", F.col("layer"), F.col("layer_ok")),
            titled("Server text extraction (pdf_text_layer):\n", F.col("literals"), F.col("server_ok")),
            titled("Rendered page visual analysis (pdf_visual_analysis):\n", F.col("view"), T.trim(F.col("view")) != ""),
        )
    )
    parts = F.col("layer_ok").cast("int") + F.col("server_ok").cast("int") + (T.trim(F.col("view")) != "").cast("int")
    one = F.when(F.col("layer_ok"), "client_pdf").when(F.col("server_ok"), "pdf_text_layer").when(parts > 0, "pdf_visual_analysis").otherwise("none")
    attempt = lambda stage, ok: F.struct(F.lit(stage).alias("stage"), F.coalesce(ok, F.lit(False)).alias("ok"))
    tries = F.concat(
        F.array(attempt("client_pdf", F.col("layer_ok"))), F.when(F.col("layer_ok"), F.array().cast(_TRY)).otherwise(F.array(attempt("pdf_text_layer", F.col("server_ok")))), F.array(attempt("pdf_visual_analysis", F.col("view_ok")))
    )
    rows = rows.withColumn("text", merged).withColumn("ok", is_read(F.col("text")) | (F.length("text") >= MERGED))
    provider = F.when(parts > 1, "client+vision").otherwise(F.when(F.col("layer_ok"), "client").when(F.col("server_ok"), "server").when(parts > 0, "vision").otherwise("none"))
    return rows.select("name", "kind", "ok", F.when(parts > 1, "pdf_text_plus_visual").otherwise(one).alias("method"), provider.alias("provider"), "text", tries.alias("attempts"))


def ingest(files: DataFrame, layers: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """name, kind, ok, method, provider, text, attempts: one row per file of ``files`` (name, content)."""
    spark = files.sparkSession
    none = spark.createDataFrame([], "name string, text string")
    layers, seen = layers if layers is not None else none, seen if seen is not None else none
    # written once: every tier reads the files of its kinds, and none makes the others' again
    rows = written(files.select("name", F.coalesce("content", F.lit(b"")).alias("content"), kind_of(F.col("name")).alias("kind"), F.array().cast(_TRY).alias("attempts")), "files")
    left, done = rows.filter("kind <> 'pdf'"), [_pdfs(rows.filter("kind = 'pdf'").drop("attempts"), layers, seen)]
    text_held = lambda c: F.length(c) > 0
    tiers = [
        ("client_text", "client", ("text",), lambda f: f.withColumn("got", F.make_valid_utf8(F.col("content").cast("string"))), text_held, is_read),
        ("client_office", "client", ("docx", "pptx"), _office, is_read, is_read),
        ("utf8_decode", "server", ("text",), lambda f: f.withColumn("got", utf8_text(F.col("content"))), text_held, is_read),
        ("vision_analysis", "vision", ("image",), lambda f: f.join(seen.select("name", F.col("text").alias("got")), "name", "left"), lambda c: F.length(T.trim(c)) >= SEEN, lambda c: F.length(T.trim(c)) >= SEEN),
    ]
    for tier in tiers:
        ended, left = _tier(left, *tier)
        done.append(ended)
    done.append(left.select("name", "kind", F.lit(False).alias("ok"), F.lit("none").alias("method"), F.lit("none").alias("provider"), F.lit("").alias("text"), "attempts"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("mime", T.mime_of(F.col("name")))
