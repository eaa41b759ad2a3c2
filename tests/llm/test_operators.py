"""The training-data operators against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import chat_format, components, exact_dedup, html_extract, minhash_join, packing, quality_classifier, quality_rules, queries, sentencepiece_codec, suffix_dedup, warc

from . import brute

rng = random.Random(11)
VOCAB = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choices(VOCAB, k=min(12, n - i))) for i in range(0, n, 12))


def edited(text, k, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(VOCAB)
    return " ".join(w)


BASE = prose(160, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace(" ", "  \t", 5)), (4, edited(BASE, 3, 2)), (5, edited(BASE, 6, 3)), (6, None), (7, ""), (8, " \n "), (9, "one two three"), (10, "One two THREE"),
    (11, prose(120, 4) + "\n" + BASE), (12, "und " * 400), (13, prose(3000, 5)), (14, "x"), (15, prose(60, 6)), (15, prose(60, 6)), (16, "é" * 300 + " " + BASE), (17, "a\n\n" + prose(55, 7)), (18, "#*$%&|<> <|im_end|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Beside the usual columns some whose names the operators use themselves."""
    rows = [(i, t, "en", "s0", 0, "clash", "clash", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, text_sha256 string, n long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def same(got, want):
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_exact(docs, none):
    same(exact_dedup.exact_dedup(docs).collect(), brute.exact(TEXTS))
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True)} | {(None, None, 1, True)}


def test_rules(docs, none):
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, [(i, *brute.base_counts(t)) for i, t in TEXTS])
    assert quality_rules.quality_rules(none).count() == 0


def test_boilerplate(spark):
    rows = [(i, "h" if i % 3 else None, f"Subscribe  now\n{prose(60, 100 + i)}") for i in range(60)] + [(60 + i, "h", "Subscribe now\n" * 9 + prose(8, 300 + i)) for i in range(3)] + [(70, "h", rows_copy := prose(70, 9))] + [(71 + i, "h", rows_copy) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, clean=True, min_docs=15).collect()}
    for (i, _, t), (lost, clean) in zip(rows, brute.boilerplate(rows, min_docs=15), strict=True):
        assert (got[i].n_boilerplate_words, got[i].clean_text) == (lost, clean)
        failed = brute.base_counts(t)[-1]
        assert got[i].kept == (not failed and lost <= 0.5 * brute.base_counts(t)[0])
    assert got[75].kept and got[75].n_boilerplate_words == 0  # copies count once


def test_near(docs, none):
    want = brute.near([(i, t) for i, t in TEXTS])
    got = minhash_join.near_duplicates(docs).collect()
    sizes = {i: len(brute.shingles(t)) for i, t in TEXTS}
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], [(i, sizes[i], want[i], want[i] == i) for i, _ in TEXTS])
    assert minhash_join.near_duplicates(none).count() == 0


def test_near_large_family(spark, monkeypatch):
    """A family larger than a small node, with a chain at its edge, and strangers that share a passage."""
    monkeypatch.setattr(minhash_join, "SMALL", 6)
    family = [(i, edited(BASE, i % 5, 50 + i)) for i in range(60)]
    chain, text = [], BASE
    for i in range(8):
        text = edited(text, 3, 200 + i)
        chain.append((100 + i, text))
    strangers = [(200 + i, "\n".join(BASE.split("\n")[:4]) + "\n" + prose(150, 400 + i)) for i in range(20)]
    rows = family + chain + strangers
    got = {r.doc_id: r.component_id for r in minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_repeats(docs, none):
    got = suffix_dedup.suffix_dedup(docs, with_text=True).collect()
    want = [(i, n, gone, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")) for (i, _), (n, gone, spans, left) in zip(TEXTS, brute.repeats(TEXTS), strict=True)]
    same(got, want)
    assert suffix_dedup.suffix_dedup(none).count() == 0


@pytest.mark.parametrize("hot", [3, 0])
def test_repeats_hot_keys(spark, monkeypatch, hot):
    """Keys met often are split by offset and content; with 0 down to single windows."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    rows = [(i, prose(20, i) + "\n" + edited(BASE, i % 4, i)) for i in range(12)] + [(50, "ab" * 900), (51, "z" + "ab" * 700)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, [(i, n, gone, spans, hashlib.sha256(left).hexdigest()) for (i, _), (n, gone, spans, left) in zip(rows, brute.repeats(rows), strict=True)])


def test_merged_transforms():
    """Interleave refinement finds what counting finds, for any number of shards."""
    for trial in range(20):
        r = random.Random(trial)
        base = " ".join(r.choices(VOCAB, k=500)).encode()
        frags = [f for f in (base[a : a + r.randint(400, 1500)] for a in (r.randint(0, 900) for _ in range(r.randint(1, 7)))) if len(f) >= 400] + [b"ab " * 300] * (trial % 2)
        seen = {}
        for f in frags:
            for i in range(len(f) - 399):
                seen[f[i : i + 400]] = seen.get(f[i : i + 400], 0) + 1
        for got, f in zip(suffix_dedup.repeated_starts(frags, 1 + trial % 3), frags, strict=True):
            assert got.tolist() == [seen[f[i : i + 400]] > 1 for i in range(len(f) - 399)]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rows = packing.best_fit_packing(docs, path).collect()
    want = []
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, s, len(x := ids[s : s + 4096]), zlib.crc32(np.asarray(x, dtype="<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    same([tuple(r)[:5] for r in rows], want)
    n = check_packing(rows, 4096)
    assert n <= -(-sum(w[3] for w in want) // 4096) + 1
    assert packing.best_fit_packing(none, path).count() == 0


def test_word_memo_is_exact():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    with open(path, encoding="utf-8") as f:
        enc = packing.WordEncoder(f.read())
    tok = Tokenizer.from_file(path)
    r = random.Random(3)
    bits = ["a", "B", "É", "ß", "İ", "Σ", "'s", "'ll", " ", "\n", "漢", "3", "42", ".", "..", "!?", "$", "<|endoftext|>", "<|", "|>", "\x1d", "\xa0", "é", "_", "ſ", "ﬁ"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 25))) for _ in range(1500)]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert got == np.asarray(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    r = random.Random(seed)
    capacity = 100
    counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 30))}
    seen, fill = {k: [] for k in counts}, {}
    for length, first, n, seq, offset, per in packing.plan(counts, capacity):
        seen[length] += range(first, first + n)
        for k in range(n):
            fill.setdefault(seq + k // per, []).append((offset + k % per * length, length))
    assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items())
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in parts) <= 2


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "\\<|", "\\n\n\\\\", "", "ä😀", "<\\|im_end|>"]
    rows = [(c, k, role, t) for c, t in enumerate(texts) for k, role in enumerate(("system", "user", "assistant", "assistant"))] + [(90, 0, None, None), (91, 1, "user\n<|", "x"), (91, 1, "assistant", "y"), (92, 0, "user", "p"), (92, 1, "assistant", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    formatted = chat_format.format_records(chat_format.records_of_turns(df))
    layouts = {r.conv_id: r.layout for r in formatted.collect()}
    assert layouts[92] == "prompt_response" and layouts[0] == "messages"
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((k, r or "", t or "") for cc, k, r, t in rows if cc == c))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(formatted).collect()}
    assert got == want


def test_chat_layouts(spark):
    records = [
        {"instruction": "i", "input": "", "output": "o", "meta": {"a": [1]}}, {"prompt": "p", "completion": "c"}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"question": "q", "answer": "a", "context": "c"}, {"nothing": 1}, [], {"messages": [{"role": "user", "content": None}]},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, None), (8, "{broken")]
    got = {r.conv_id: (r.layout, chat_format.parse(r.formatted)) for r in chat_format.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert got[0] == ("instruction", [("user", "i"), ("assistant", "o")]) and got[1] == ("prompt_completion", [("user", "p"), ("assistant", "c")])
    assert got[2] == ("conversations", [("user", "h"), ("assistant", "g")]) and got[3][1] == [("system", "c"), ("user", "q"), ("assistant", "a")]
    assert got[6] == ("messages", [("user", "")]) and all(got[i] == ("unknown", []) for i in (4, 5, 7, 8))


def test_sentencepiece_equals_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    r = random.Random(4)
    texts = [t or "" for _, t in TEXTS] + ["".join(r.choices("  abé\n\tß漢😀\x00zz'th  eing　", k=r.randint(0, 60))) for _ in range(400)]
    codec, ref = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in texts:
        assert codec.encode(t) == ref.encode(t)
        assert codec.decode(codec.encode(t)) == t
    # the same pieces as a unigram model with scores that never tie: best sum of scores
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -r.uniform(4, 14) / max(1, len(p.piece)) ** 0.5
    codec = sentencepiece_codec.Codec(proto.SerializeToString())
    for t in texts[:60]:
        t = "".join(c for c in t if c in codec.id or c == " ")
        if not t or t != t.strip():
            continue
        got = codec.encode(t)
        assert codec.decode(got) == t
        best = [0.0] + [float("-inf")] * (n := len(s := "▁" + t.replace(" ", "▁")))
        for i in range(n):
            for j in range(i + 1, min(n, i + 20) + 1):
                if s[i:j] in codec.id:
                    best[j] = max(best[j], best[i] + codec.score[codec.id[s[i:j]]])
        assert abs(sum(codec.score[i] for i in got) - best[n]) < 1e-6


def test_sentencepiece_frames(docs, none):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in TEXTS}
    assert sentencepiece_codec.encode(none, path).count() == 0


def page(article, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy &amp; go</div>{article}{extra}<footer>&copy; me</footer></body></html>'


def test_html(spark):
    rows = [
        (1, "https://h.org/a/1", page("<article><h1>Head &amp; &#233;</h1><p><b>One<br><p>two\n three</p><ul><li>x<li>y</ul></article>", '<section class="comments"><p>nice</p></section>')),
        (2, "https://h.org/a/2", page("<article><h1>Head &amp; &#233;</h1><p>own words</p></article>")),
        (3, "https://d.org/p/1", "<body><p>Our site motto</p><p>first story</p><p>and more of it</p><p>Contact us by mail</p></body>"),
        (4, "https://d.org/p/2", "<body><p>Our site motto</p><p>second story</p><p>quite unlike it</p><p>goes on</p><p>Contact us by mail</p></body>"),
        (5, None, None), (6, "not a url", "plain <b>bold</b> a < b"), (6, "not a url", "<p>again"), (7, "https://z.org/", "<div hidden>no</div><form><p>name</p></form><aside>s</aside><main><p>yes <span>it</span> is</p></main><!-- <p>no</p>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # neighbours meet within a partition
    got = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    same(got, [(1, "Head & é\n\nOne\n\ntwo three\n\nx\n\ny"), (2, "Head & é\n\nown words"), (3, "first story\n\nand more of it"), (4, "second story\n\nquite unlike it\n\ngoes on"), (5, ""), (6, "plain bold a < b"), (6, "again"), (7, "yes it is")])
    assert html_extract.extract(df.filter("false")).count() == 0


def test_lcs():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        on = [a[i] for i in sorted(html_extract.lcs_shared(a, b))]
        it = iter(b)
        assert len(on) == table[-1][-1] and all(x in it for x in on)


def test_warc(spark, tmp_path):
    big, other = "<p>é WARC/1.1\r\n\r\nContent-Length: 5\r\n" + "x" * 1200, "y" * 1000
    rows = [(1, "https://h.org/1", big), (5, "https://h.org/5?q=1#f", big), (3, None, big), (2, "https://h.org/2", "small"), (4, "https://h.org/4", "small"), (6, "u", ""), (7, "https://h.org/7", other), (9, "https://h.org/7", other), (9, "https://h.org/7", other)]
    df = spark.createDataFrame(rows, "id long, url string, payload string").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"))
    nested = warc.assemble(warc.read_warc(spark, str(tmp_path / "w")))
    assert {(r.request is not None, r.metadata is not None) for r in nested.collect()} == {(True, True)}
    got = [tuple(r) for r in warc.captures_of(nested).collect()]
    want = []
    for i, _, p in rows:
        m = max(j for j, _, q in rows if q == p)
        revisit = len(p.encode()) >= 1000 and m > i
        want.append((i, len(p.encode()), hashlib.sha1(p.encode()).hexdigest(), "revisit" if revisit else "response", m if revisit else None))
    same(got, want)
    warc.write_warc(df.filter("false"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_classifier(spark):
    good = [(i, prose(80, i), 1) for i in range(120)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in prose(60, i).split()), 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(1, 1), (902, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == 162 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i, _, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i, _, _ in good + bad)
    truth = {i: q for i, _, q in good + bad}
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.9 * len(held)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.classify(docs, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    assert {r.score for r in quality_classifier.classify(docs, labels.filter("false")).collect()} == {0.5}


def test_isotonic():
    w, m = np.array([1.0, 1, 2, 1]), np.array([0.1, 0.5, 0.2, 0.9])
    assert np.allclose(quality_classifier.isotonic(w, m), [0.1, 0.3, 0.3, 0.9])


def test_pipeline(spark):
    """All stages against plain versions, stage by stage."""
    import corpus_pipeline as p

    from ..conftest import SF

    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    lost = brute.boilerplate([(r[0], r[3], r[1]) for r in rows])
    want = []
    for r, (n, clean) in zip(rows, lost, strict=True):
        c = brute.base_counts(r[1])
        if not c[-1] and n <= 0.5 * c[0]:
            want.append((r[0], clean, r[2], r[3], len(clean)))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(p.STAGES)
    docs = steps["quality_rules"](spark, docs, SF)
    same(docs.collect(), want)
    want = [r for r, e in zip(want, brute.exact([r[:2] for r in want]), strict=True) if e[3]]
    docs = steps["exact_dedup"](spark, docs, SF)
    same(docs.collect(), want)
    comp = brute.near([r[:2] for r in want])
    want = [r for r in want if comp[r[0]] == r[0]]
    docs = steps["minhash_near_dedup"](spark, docs, SF)
    same(docs.collect(), want)
    want = [(r[0], t := left.decode("utf-8", "ignore"), r[2], r[3], len(t)) for r, (_, _, _, left) in zip(want, brute.repeats([r[:2] for r in want]), strict=True)]
    docs = steps["suffix_array_dedup"](spark, docs, SF)
    same(docs.collect(), want)
    rows = steps["best_fit_packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in want}
    check_packing(rows, 4096)
    again = p.run(spark, SF).collect()
    same([tuple(r)[:5] for r in again], [tuple(r)[:5] for r in rows])
