"""Best sums of scores over the automaton, against the library."""

import random

import pytest

from quarrylight.llm import packing, queries, sentencepiece_codec

from .test_operators import TEXTS, docs  # noqa: F401


def test_unigram_equals_library():
    import sentencepiece

    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = sentencepiece_codec.as_unigram(f.read())
    codec, ref = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert not codec.is_bpe
    r = random.Random(8)
    texts = [t or "" for _, t in TEXTS] + ["".join(r.choices("  abethorninges\n\tßé", k=r.randint(0, 60))) for _ in range(300)]
    for t in texts:
        got = codec.encode(t)
        assert codec.decode(got) == t
        want = ref.encode(t)
        score = lambda ids: sum(codec.score.get(i, codec.lowest) for i in ids)
        assert got == want or abs(score(got) - score(want)) < 1e-4  # sums that tie


VOCABULARIES = [
    (["▁", "a", "ab", "▁ab"], False), (["▁", "a", "b", "aab", "▁aa"], False), (["▁th", "the", "e▁", "▁", "hé", "t"], False), (["a", "aa", "aaa", "ba", "▁"], True), (["ab", "bc", "cd", "abcd", "▁b"], False),
    (["xy", "▁x", "☃☃", "yx"], True), (["▁", "é", "éa", "aé", "b▁b", "▁▁"], False),
]


@pytest.mark.parametrize("pieces,with_bytes", VOCABULARIES)
def test_made_vocabularies(pieces, with_bytes):
    """Vocabularies without all single characters: a character may occur inside longer pieces only."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, with_bytes
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    m.pieces.add(piece="<unk>", score=0, type=2)
    m.pieces.add(piece="<s>", score=0, type=3)
    r = random.Random(len(pieces) + len(pieces[0]))
    for k, piece in enumerate(pieces):
        m.pieces.add(piece=piece, score=-(k + 1) * 1.37 - r.random(), type=1)
    for b in range(256 if with_bytes else 0):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    codec, ref = sentencepiece_codec.Codec(m.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["ab", "aab", "the then", "☃☃☃ x", "", " ", "a☃ ☃b"] + ["".join(r.choices("aabbcdehtxy é☃ ", k=r.randint(1, 25))) for _ in range(400)]
    for t in texts:
        assert codec.encode(t) == ref.encode(t), t


def test_memo_holds_no_long_words():
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        codec = sentencepiece_codec.Codec(sentencepiece_codec.as_unigram(f.read()))
    codec.encode("x" * 10_000 + " ab " + "y" * 100)
    assert max(map(len, codec.memo)) < sentencepiece_codec.MEMO_CHARS


def test_unigram_frames(spark, docs):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path, unigram=True), path).collect()}
    assert back == {i: t or "" for i, t in TEXTS}


def test_maps_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError, match="map"):
        sentencepiece_codec.Codec(proto.SerializeToString())


def test_other_tokenizers_encode_whole_texts():
    import numpy as np
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        enc = packing.WordEncoder(f.read())
    tok = Tokenizer.from_file(path)
    texts = [t or "" for _, t in TEXTS]
    assert list(enc.encode(texts)) == [np.asarray(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
