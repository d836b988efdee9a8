import numpy as np
import pytest
import xxhash

from vetch.llm import simhash_dedup as S


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    ids, v = list(prints), np.array(list(prints.values()), np.uint64)
    up = dict(zip(ids, ids))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v[k + 1 :] ^ v[k]) <= 4):
            a, b = find(i), find(ids[k + 1 + j])
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_by_brute_force(spark, small, documents):
    rows = S.op7_simhash(spark, small).collect()
    prints = {i: brute_print(t) for i, t in documents}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes(prints)


@pytest.mark.parametrize("block", [2048, 8])
def test_links_are_complete(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 64, 12, np.uint64)
    points = {int(c) for c in centres}
    for c in centres:
        for _ in range(30):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            points.add(int(c) ^ sum(1 << int(b) for b in flips))
    points = sorted(points)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    from vetch.llm.common import components

    got = {r["id"] & (2**64 - 1): r["component"] & (2**64 - 1) for r in components(S.links(df, block=block)).collect()}
    want = classes(dict(zip(points, points)))
    groups = lambda m: {frozenset(p for p in m if m[p] == c) for c in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_isolated_pairs_that_differ_in_the_top_bit(spark):
    rng = np.random.default_rng(3)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    want, apart, points = set(), set(), set()
    for k, x in enumerate(rng.integers(0, 1 << 64, 240, np.uint64).tolist()):
        flips = [63, *rng.choice(63, k % 4, replace=False).tolist()]
        y = x ^ sum(1 << int(b) for b in flips)
        want.add(frozenset((signed(x), signed(y))))
        points |= {signed(x), signed(y)}
    for x in rng.integers(0, 1 << 60, 20, np.uint64).tolist():
        # Their XOR, as a signed number, is -1 to -16: a small absolute value.
        y = x ^ ((1 << 64) - 1 - int(rng.integers(0, 16)))
        apart |= {signed(x), signed(y)}
    df = spark.createDataFrame([(p,) for p in points | apart], "fp long")
    assert {frozenset((r["a"], r["b"])) for r in S.links(df).collect()} == want
    for x, y in ((0, -1), (0, -2), (5, ~5)):
        assert S.forest(np.array([x, y], np.int64), 4) == []


def test_anchors_cover(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for x in rng.integers(0, 1 << 32, 200).tolist() + [0, 2**32 - 1]:
        flips = rng.choice(32, 2, replace=False)
        pairs.append((x, x ^ (1 << int(flips[0])) ^ (1 << int(flips[1]))))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a long, b long").select(S.anchors(F.col("a")).alias("a"), S.anchors(F.col("b")).alias("b"))
    assert all(set(r["a"]) & set(r["b"]) and len(r["a"]) <= 17 for r in df.collect())


def test_odd_rows(odd, none):
    rows = S.near_groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {3}
    assert S.near_groups(none).count() == 0


def test_families_that_stay_apart_send_no_pairs(spark):
    """Of texts that share keys but resemble each other too little, a task sends on links alone, none for a family without any."""
    rng = np.random.default_rng(7)
    for side in (np.zeros(60, np.int64), np.repeat([-1, 1], 30)):
        sets = [np.sort(rng.choice(400, rng.integers(260, 340), replace=False)).astype(np.uint64) for _ in range(60)]
        comp = rng.integers(0, 50, 60)
        for similarity in (0.6, 0.65, 0.9):
            met = [(k, x) for k in range(60) for x in range(60) if (side[k] < 0 < side[x]) or (side[k] == side[x] == 0 and k < x)]
            linked = [(k, x) for k, x in met if len(np.intersect1d(sets[k], sets[x])) >= similarity * len(np.union1d(sets[k], sets[x]))]

            def roots(pairs):
                up = {x: int(comp[x]) for x in range(60)}
                for k, x in pairs:
                    old, new = up[x], up[k]
                    up = {i: new if c == old else c for i, c in up.items()}
                return {frozenset(i for i in up if up[i] == c) for c in up.values()}

            got = S.joining(comp, side, sets, similarity)
            assert roots(got) == roots(linked) and len(got) < 60 and len(got) == len(roots([])) - len(roots(got))
            assert similarity < 0.9 or not got
    common = [f"c{k}" for k in range(300)]
    docs = []
    for k in range(40):
        w = list(common)
        for at in rng.choice(300, 8, replace=False):
            w[at] = f"t{k}x{at}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked = df.select(S.F.xxhash64("text").alias("text_id"), S._marked(S.F.col("text"), S.WORDS).alias("m")).select("text_id", "m.*")
    prints = marked.groupBy("fp").agg(S.F.count("*").alias("copies"))
    none = spark.createDataFrame([], "fp long, component long")
    met = S.shared_keys(marked)
    for similarity in (0.7, 0.99):
        more = S.across(met, prints, none, df, similarity, 1000)
        grams = {S.fingerprint(t): set(S.shingle_hashes(t, 5).tolist()) for _, t in docs}
        assert all(len(grams[r["a"]] & grams[r["b"]]) >= similarity * len(grams[r["a"]] | grams[r["b"]]) for r in more.collect())
        assert similarity < 0.9 or not more.count()
