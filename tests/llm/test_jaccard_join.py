import numpy as np
import pyarrow as pa
import pytest

from vetch.llm import jaccard_join as J
from vetch.llm import scan as S


def brute_set(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def links(x, y):
    both = len(x & y)
    return bool(both) and 100 * both >= 90 * len(x | y)


def brute(rows):
    """rows of (doc_id, text): (doc_id, n_shingles, component_id) for each."""
    sets = [brute_set(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if comp[i] != comp[j] and links(x, sets[j]):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return sorted(((i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, comp)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_sql(spark, small, duck, same_rows):
    assert same_rows(J.op12_jaccard_join(spark, small), duck, J.ORACLE_OP12) > 0


def family(rng, base, copies, changes):
    out = []
    for _ in range(copies):
        w = list(base)
        for k in rng.choice(len(w), rng.integers(0, changes + 1), replace=False):
            w[k] = f"c{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,rounds", [(1024, 1), (8, 2), (8, 0)])
def test_by_brute_force(spark, monkeypatch, block, rounds):
    """Families whose members link all, in part and not at all, with one common passage in many texts of others."""
    monkeypatch.setattr(J, "ROUNDS", rounds)
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    passage, made = word(150), []
    for changes, copies, size in ((1, 40, 120), (3, 40, 130), (6, 40, 140), (2, 30, 60), (12, 30, 400), (1, 9, 20)):
        made += family(rng, word(size), copies, changes)
    made += [" ".join(passage + word(int(n))) for n in rng.integers(0, 40, 60)]
    made += made[:30] + ["", " ", "a b", "A b", "a", "a b c", "a  b\tC"]
    order = rng.permutation(len(made))
    rows = [(int(i), made[i]) for i in order]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 100
    assert got(J.linked_groups(df, block=block)) == want


def test_prefixes_meet_as_often_as_they_must():
    rng = np.random.default_rng(1)
    often = (rng.pareto(0.7, J.COUNTERS) * 3).astype(np.float32)
    chosen = set()
    for _ in range(300):
        n = int(rng.integers(5, 400))
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.05 * rng.random()], rng.integers(0, 1 << 63, int(n * 0.04), np.uint64)]))
        (p, a), (q, b) = J.prefix(x, often), J.prefix(y, often)
        chosen |= {a, b}
        if J.alike(x, y):
            assert len(np.intersect1d(p, q)) >= min(a, b)
    assert len(chosen) > 3


def test_bitmaps_are_bounds():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 900)), np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1 * rng.random()], rng.integers(0, 1 << 63, int(len(x) * 0.05), np.uint64)]))
        if not len(y):
            continue
        bits = np.stack([np.frombuffer(J.bitmap(s), np.uint64) for s in (x, y)])
        ok, _ = J._may_link(np.array([len(x), len(y)]), bits, np.array([0]), np.array([1]), 90)
        assert ok[0] or not J.alike(x, y)


def test_sets(monkeypatch):
    made = ["", "one", "One TWO", "one two three", "a b c a b c a b", "é É x y", "x\x1cy z w", "q" * 200 + " b c d"]
    whole = [len(s) for s in J.shingle_sets(*S.texts(pa.array(made)))]
    assert whole == [len(brute_set(t)) for t in made]
    monkeypatch.setattr(S, "PIECE", 16)
    monkeypatch.setattr(S, "_UP", [])
    sets = J.shingle_sets(*S.texts(pa.array(made + ["zero a b c a b c a b"])))
    assert [len(s) for s in sets[:-1]] == whole and set(sets[4].tolist()) < set(sets[-1].tolist())


def test_odd_rows(spark, odd, none):
    assert got(J.linked_groups(odd)) == brute_odd(odd)
    assert J.linked_groups(none).count() == 0


def brute_odd(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    return sorted(((i, n, i if not n else c) for i, n, c in brute(rows)), key=str)
