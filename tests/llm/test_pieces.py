import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vetch.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    return P.read_model()


@pytest.fixture(scope="module")
def encoder(model):
    return P.Encoder(model)


@pytest.fixture(scope="module")
def reference(model):
    """The installed library as a unigram model with the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(P.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, s in model["scores"].items():
        proto.pieces[i].score = s
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def score(model, encoder, ids):
    """The sum of log scores; byte pieces of one character count as one unknown."""
    total, pending = 0.0, b""
    for i in ids:
        if i in encoder.byte_ids:
            pending += model["surface"][i]
            try:
                pending.decode()
            except UnicodeDecodeError:
                continue
            total, pending = total + encoder.unknown, b""
        else:
            total += model["scores"][i]
    return total


def test_best_segmentation(model, encoder, reference, documents):
    texts = [t for _, t in documents] + ["", "  a  b ", "日本語 テスト\U0001f600x", "\n\n a\tb", "x" * 300, "é" * 100 + " " + "-" * 70]
    for text, ours, theirs in zip(texts, encoder.encode(texts), reference.encode(texts)):
        if ours.tolist() != theirs:  # ties
            assert abs(score(model, encoder, ours.tolist()) - score(model, encoder, theirs)) < 1e-3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_characters="▁", exclude_categories=["Cs"]), max_size=80))
def test_round_trip(encoder, text):
    ids = encoder.encode([text])[0]
    assert encoder.decode(ids) == text


def test_one_and_many_agree(encoder):
    chunks = ["▁hello".encode(), "▁wörld".encode(), "日本".encode(), b"abc\n"]
    assert [x.tolist() for x in encoder._many(chunks)] == [encoder._one(c).tolist() for c in chunks]


def test_double_array():
    words = {b"a": 0, b"ab": 1, b"abc": 2, b"b": 3, "é".encode(): 4}
    t = P.double_array(words)
    for w, i in words.items():
        state = 0
        for c in w:
            to = t["base"][state] + c
            assert t["check"][to] == state
            state = to
        assert t["value"][state] == i


def test_columns(spark, odd, none):
    rows = P.tokenize(odd).withColumn("back", P.decode(spark, F.col("token_ids"))).collect()
    assert all(r["back"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    assert P.tokenize(none).count() == 0
    d = odd.select("text", P.digest(spark, F.col("text")).alias("d")).collect()
    assert all(r["d"]["decoded"] for r in d) and len(d) == odd.count()
    assert np.all([r["d"]["n_tokens"] == 0 for r in d if not r["text"]])


def test_long_chunks_are_cut_where_no_piece_crosses():
    e = P.Encoder(P.read_model())
    rng = np.random.default_rng(7)
    cjk = "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 3000, 4000))
    mixed = "".join(rng.choice(list("abcXYZ019+/=é日本\U0001f600"), 3000))
    for text in (cjk, mixed, "x" * 500, cjk[:50] + mixed[:100] + "\ud800" * 3):
        chunk = P.MARK + text
        parts = e._cut(chunk)
        assert "".join(parts) == chunk
        whole = e._one(chunk.encode("utf-8", "surrogatepass"))
        assert e.encode([text])[0].tolist() == whole.tolist()
    assert len(e._cut(P.MARK + cjk)) > 1000 and all(len(c.encode("utf-8", "surrogatepass")) <= P.WIDE for c in e.known)


def test_a_large_text_without_spaces():
    e = P.Encoder(P.read_model())
    rng = np.random.default_rng(8)
    text = "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 20000, 350_000))  # 1 MB
    ids = e.encode([text])[0]
    assert len(ids) >= 350_000 and e.decode(ids) == text


def test_digest_by_brute_force(spark, small, documents):
    import hashlib

    e = P.Encoder(P.read_model())
    got = {r["doc_id"]: r for r in P.op8_sentencepiece(spark, small).collect()}
    for i, text in documents:
        chunk = P.MARK + text.replace(" ", P.MARK)
        ids = np.concatenate([e._one(c.encode()) for c in e.CHUNK.findall(chunk)]) if text else np.zeros(0, np.int32)
        r = got[i]
        assert (r["n_tokens"], r["n_byte_tokens"]) == (len(ids), sum(x in e.byte_ids for x in ids.tolist()))
        assert r["ids_sha256"] == hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
        assert r["decoded"] == (e.decode(ids) == text)


def test_chunks_in_use_are_remembered(encoder, monkeypatch):
    """Chunks that every batch has are segmented once, however many others come between."""
    e, often = P.Encoder(P.read_model()), [f"often{k}x" for k in range(50)]
    monkeypatch.setattr(P, "REMEMBERED", 100)
    learnt, real = [], e._learn
    monkeypatch.setattr(e, "_learn", lambda chunks: learnt.extend(chunks) or real(chunks))
    for k in range(12):
        text = " ".join(often + [f"r{k}y{j}é\U0001f600" for j in range(60)])
        assert e.encode([text, ""])[0].tolist() == np.concatenate([encoder._one(c.encode()) for c in e.CHUNK.findall(P.MARK + text.replace(" ", P.MARK))]).tolist()
        assert len(e.known) + len(e.older) < 4 * 100
    assert all(learnt.count(P.MARK + c) == 1 for c in often)
