"""The ingest cascade: which tier reads a file, what is noted, and what is left."""

import io
import zipfile

from quarrylight.sources import ingest

LONG = "The quick brown fox jumps over the lazy dog again and again."
SEEN = "A second text that a model has read on the rendered pages of it."


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def pdf(text):
    return b"%PDF-1.4 (" + text.encode("latin-1") + b") Tj"


FILES = [
    ("a.txt", LONG.encode()), ("short.md", b"too short"), ("null.txt", None), ("empty.txt", b""), ("noise.log", b"\xff\xfe\x00\x01" * 30), ("failed.txt", (LONG + " extraction failed").encode()), ("real.txt", (LONG + " extraction failed, email me").encode()),
    ("b.docx", zipped({"word/document.xml": f"<w:t>{LONG}</w:t>"})), ("wrong.docx", zipped({"ppt/slides/slide1.xml": f"<a:t>{LONG}</a:t>"})), ("broken.docx", b"PK\x03\x04 no archive"), ("c.PPTX", zipped({"ppt/slides/slide2.xml": f"<a:t>{LONG}</a:t>"})),
    ("layer.pdf", pdf("other literals that have their own forty or more letters in them")), ("literal.pdf", pdf(LONG)), ("both.pdf", pdf(LONG)), ("same.pdf", pdf(LONG)), ("seen.pdf", b"%PDF-1.4"), ("nothing.pdf", b"%PDF-1.4"), ("x.PNG", b"png"), ("y.jpg", b"jpg"), ("z.jpeg", b""),
    ("x.bin", LONG.encode()), ("noending", LONG.encode()), ("a.txt", LONG.encode()), ("long.txt", b"abcdefghi " * 15_000),
]
LAYERS = [("layer.pdf", LONG), ("both.pdf", "short")]
LANDED = [("both.pdf", SEEN), ("same.pdf", LONG), ("seen.pdf", SEEN), ("x.PNG", "  ten chars  here "), ("y.jpg", "short")]


def run(spark, rows):
    texts = lambda xs: spark.createDataFrame(xs, "name string, text string")
    out = ingest.ingest(spark.createDataFrame(rows, "name string, content binary").repartition(3), texts(LAYERS), texts(LANDED)).collect()
    assert len(out) == len(rows)
    return {r.name: r for r in out}


def test_methods(spark):
    got = run(spark, FILES)
    method = {n: (r.method, r.provider) for n, r in got.items() if r.ok}
    assert method == {
        "a.txt": ("client_text", "client"), "real.txt": ("client_text", "client"), "long.txt": ("client_text", "client"), "b.docx": ("client_office", "client"), "c.PPTX": ("client_office", "client"), "x.PNG": ("vision_analysis", "vision"),
        "layer.pdf": ("client_pdf", "client"), "literal.pdf": ("pdf_text_layer", "server"), "both.pdf": ("pdf_text_plus_visual", "client+vision"), "same.pdf": ("pdf_text_plus_visual", "client+vision"), "seen.pdf": ("pdf_visual_analysis", "vision"),
    }
    assert {r.text for n, r in got.items() if not r.ok} == {""}


def test_texts(spark):
    got = run(spark, FILES)
    assert got["a.txt"].text == LONG and got["c.PPTX"].text == LONG and got["x.PNG"].text == "ten chars  here"
    assert got["layer.pdf"].text == f"PDF text layer (client_pdf):\n{LONG}"
    assert got["both.pdf"].text == f"Server text extraction (pdf_text_layer):\n{LONG}\n\nRendered page visual analysis (pdf_visual_analysis):\n{SEEN}"
    assert len(got["long.txt"].text) == 120_000 + len("\n\n[Truncated]") and got["long.txt"].text.endswith("[Truncated]")


def test_attempts(spark):
    got = {n: [(a.stage, a.ok) for a in r.attempts] for n, r in run(spark, FILES).items()}
    assert got["a.txt"] == [("client_text", True)] and got["short.md"] == [("client_text", True), ("utf8_decode", True)] and got["noise.log"] == [("client_text", True), ("utf8_decode", False)]
    assert got["null.txt"] == got["empty.txt"] == [("client_text", False), ("utf8_decode", False)]
    assert got["wrong.docx"] == got["broken.docx"] == [("client_office", False)] and got["y.jpg"] == [("vision_analysis", False)] and got["x.bin"] == got["noending"] == []
    assert got["layer.pdf"] == [("client_pdf", True), ("pdf_visual_analysis", False)] and got["both.pdf"] == [("client_pdf", False), ("pdf_text_layer", True), ("pdf_visual_analysis", True)]


def test_empty(spark):
    assert ingest.ingest(spark.createDataFrame([], "name string, content binary")).collect() == []
