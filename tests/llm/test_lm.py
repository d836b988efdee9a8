import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vetch.llm import elias_fano as EF
from vetch.llm import lm


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=300), st.integers(0, 1 << 40))
def test_elias_fano(values, other):
    v = np.array(sorted(values), np.uint64)
    e = EF.EliasFano(EF.EliasFano.build(v, 1 << 41))
    assert e.get(np.arange(len(v))).tolist() == v.tolist()
    ask = np.array([*sorted(values), other, other + 1], np.uint64)
    assert e.find(ask).tolist() == [int(np.searchsorted(v, x)) if int(x) in values else -1 for x in ask]


def test_trie_is_exact_but_for_quantising(tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 3000), rng.integers(0, 1 << 32, 3000))})
    c, w = (np.array(x, np.uint64) for x in zip(*pairs))
    words = np.sort(rng.choice(1 << 40, 50, replace=False).astype(np.uint64))
    p, counts, back_off = rng.random(len(pairs)) ** 9 + 1e-9, rng.integers(1, 1 << 40, 50), rng.random(50) + 1e-6
    path = tmp_path / "trie"
    EF.Trie.build(words, 1 << 61, counts, back_off, c.astype(np.int64), w, p).tofile(path)
    trie = EF.Trie.open(str(path))
    assert isinstance(trie.probability.base, np.memmap) or isinstance(trie.probability, np.memmap)
    assert trie.words.find(words).tolist() == list(range(50)) and trie.words.find(words + np.uint64(1)).max() == -1
    assert trie.counts.tolist() == counts.tolist() and np.all(np.abs(EF.dequantise(trie.back_off) / back_off - 1) < 0.0004)
    other = np.array([(int(a), int(b) ^ 1) not in set(pairs) for a, b in pairs])
    for step in (1 << 20, 7):
        monkeypatch.setattr(EF, "DECODED", step)
        assert np.all(np.abs(EF.dequantise(trie.lookup(c.astype(np.int64), w)) / p - 1) < 0.0004)
        assert not trie.lookup(c.astype(np.int64), w ^ np.uint64(1))[other].any()
    assert trie.successors_of(7)[0].tolist() == [b for a, b in pairs if a == 7]
    assert 8 * trie.successors.bytes / len(pairs) < 32 + 4


@pytest.mark.parametrize("group", [2500, 15])
def test_query_by_brute_force(spark, documents, group):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in documents}
    tokens = {i: t.encode().lower().split() + [b" "] for i, t in documents}
    words, pairs = Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            words.update(t)
            pairs.update(zip([b"  ", *t[:-1]], t))
    n, v, k = sum(words.values()), len(words), lm.STRENGTH
    base = lambda w: (words[w] + 1) / (n + v + 1)
    seen = lambda u: words[b" "] if u == b"  " else words[u]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    rows = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, group=group).collect()
    assert len(rows) == len(documents)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(words[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10(base(w)) for w in t), rel_tol=1e-9)
        want = sum(math.log10((pairs[u, w] + k * base(w)) / (seen(u) + k)) for u, w in zip([b"  ", *t[:-1]], t))
        assert math.isclose(r["score"], want, rel_tol=0.005)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_discounted_model_by_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(["a b a b c", "a b c c", "", "b c a", "d a b"])]
    train, strength, d = docs[:4], 0.5, 0.75
    tokens = {k: t.split() + ["</s>"] for k, t in docs}
    words, pairs = Counter(), Counter()
    for k, _ in train:
        words.update(tokens[k])
        pairs.update(zip(["<s>", *tokens[k][:-1]], tokens[k]))
    n, v = sum(words.values()), len(words)
    for r in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") == 4, strength, d, group=2).collect():
        want = 0.0
        for u, w in zip(["<s>", *tokens[r["doc_id"]][:-1]], tokens[r["doc_id"]]):
            c, t = sum(x for (a, _), x in pairs.items() if a == u), sum(a == u for a, _ in pairs)
            base = (words[w] + 1) / (n + v + 1)
            want += math.log10((max(pairs[u, w] - d, 0) + (strength + d * t) * base) / (c + strength)) if c else math.log10(base)
        assert math.isclose(r["score"], want, rel_tol=0.001)


def test_odd_rows(odd, none):
    rows = lm.score_texts(odd, F.col("doc_id") == 8).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 6))
    assert all(r["score"] == 0 for r in lm.score_texts(odd, F.lit(True)).collect())
    assert lm.score_texts(none, F.lit(False)).count() == 0
