import hashlib

import pytest

from vetch.llm import substring_dedup as S


def brute(docs):
    """doc_id, words, covered flags; docs as (id, text) in order of the ids."""
    seen, out = {}, []
    for i, text in docs:
        words = (text or "").encode().split()
        covered, own = [False] * len(words), set()
        for k in range(len(words) - 49):
            w = tuple(words[k : k + 50])
            if any(j is None or (i is not None and j < i) for j in seen.get(w, ()) if j != i):
                covered[k : k + 50] = [True] * 50
            own.add(w)
        for w in own:
            seen.setdefault(w, []).append(i)
        out.append((i, words, covered))
    return out


def test_cover_is_perfect():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
    assert S.ANCHOR + S.PERIOD - 1 == S.WINDOW


@pytest.mark.parametrize("group", [2500, 7])
def test_query_by_brute_force(spark, small, documents, group):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: r for r in S.dedup_substrings(docs, group).collect()}
    removed = 0
    for i, words, covered in brute(documents):
        kept = b" ".join(w for w, c in zip(words, covered) if not c).decode()
        assert (rows[i]["n_words"], rows[i]["kept"]) == (len(words), kept)
        assert sum(s["end"] - s["begin"] for s in rows[i]["removed"]) == sum(covered)
        removed += sum(covered)
    assert removed


def test_shifted_passages(spark):
    passage = " ".join(f"p{k}" for k in range(50))
    texts = [passage] + [" ".join(f"d{d}w{k}" for k in range(d)) + f" {passage} tail{d}" for d in range(1, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in S.dedup_substrings(docs, 9).collect()}
    assert rows[0]["removed"] == [] and all([tuple(s) for s in rows[d]["removed"]] == [(d, d + 50)] for d in range(1, 70))


def test_odd_rows(spark, odd, none):
    rows = S.dedup_substrings(odd).collect()
    assert len(rows) == odd.count()
    five = [r for r in rows if r["doc_id"] == 5]
    assert len(five) == 2 and all(not r["removed"] for r in five)
    assert hashlib.sha256(next(r for r in rows if r["doc_id"] == 8)["kept"].encode()).hexdigest() == hashlib.sha256(b"end").hexdigest()
    assert S.dedup_substrings(none).count() == 0
