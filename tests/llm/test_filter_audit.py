from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from vetch.llm import filter_audit as A
from vetch.llm import scan as S

SPACES = " \t\n\v\f\r"


def words(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_sql(spark, small, duck, same_rows):
    assert same_rows(A.op11_filter_audit(spark, small), duck, A.ORACLE_OP11) % 600 == 0


STRANGE = ["", "a", " \t ", "one two one two one TWO", "naïve ÉTÉ 日本語 \U0001f600 #x", "X" * 50, "a b a\x1cb", "p" * 30 + " " + "p" * 29 + "q " + "p" * 30, " ".join(f"w{k % 97}" for k in range(5000)), "abcdefgh abcdefghi abcdefgh abcdefgh\x00 abcdefghi"]


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_counts(monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "_UP", [])
    column = pa.array(["skipped", *STRANGE]).slice(1)
    raw, at = S.texts(column)
    for i, j in S.portions(at, piece):
        c = A.counts(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        for k, t in enumerate(STRANGE[i:j]):
            w = words(t)
            assert [int(c[x][k]) for x in ("words", "distinct", "capitals", "symbols", "points")] == [len(w), len(set(w)), sum("A" <= x <= "Z" for x in t), sum(x in "#$%&*|" for x in t), len(t)], t[:40]


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(S, "word_hashes", lambda raw, begin, end: np.zeros(len(begin), np.uint64))
    for t in STRANGE[3:]:
        raw, at = S.texts(pa.array([t]))
        assert int(A.counts(raw, at)["distinct"][0]) == len(set(words(t)))


def brute(rows, labels):
    """rows of (doc_id, text, source); labels of (doc_id, quality, toxic)."""
    fails, out = [], {}
    for i, t, s in rows:
        t, w = t or "", words(t or "")
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= x <= "Z" for x in t) > 2 * len(t), "D": any(x in "#$%&*|" for x in t), "E": copy}
        marks = [(q, x) for j, q, x in labels if j == i and i is not None]
        fails.append((s or "", f, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    for part in {p for p, *_ in fails}:
        mine, total = [x[1:] for x in fails if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                lost = [x for x in left if x[0][c]]
                left = [x for x in left if not x[0][c]]
                total[c] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), sum(x[0][c] for x in mine) - len(lost), sum(x[0][c] and sum(x[0].values()) == 1 for x in mine), sum(x[1] for x in lost), sum(x[2] for x in lost)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_odd_rows(spark, odd, none):
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (5, 1, 1), (8, None, 1), (None, 1, 1), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in A.NUMBERS] for r in A.audit(odd, marks).collect()}
    assert got == brute([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], labels)
    assert A.audit(none, marks).count() == 0
    assert {(r["good_lost"], r["toxic_lost"]) for r in A.audit(odd, marks.limit(0)).collect()} == {(0, 0)}
