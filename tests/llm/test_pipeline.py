import numpy as np

import corpus_pipeline as C
from vetch.llm import quality, simhash_dedup
from vetch.llm.pieces import Encoder, read_model


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts, ids = {r["doc_id"]: r["text"] for r in docs.collect()}, []
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == C.COLUMNS
        ids.append([r["doc_id"] for r in docs.collect()])
    labels = spark.read.parquet(f"{small}/labels.parquet")
    first = quality.classify(spark.read.parquet(f"{small}/documents.parquet"), labels)
    assert sorted(ids[0]) == sorted(r["doc_id"] for r in first.where("predicted = 1").collect())
    norm = {}
    for i in ids[0]:
        key = texts[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        norm[key] = max(i, norm.get(key, i))
    assert sorted(ids[1]) == sorted(norm.values())
    prints = {i: simhash_dedup.fingerprint(texts[i]) & (2**64 - 1) for i in ids[1]}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    assert not any(near(a, b) for k, a in enumerate(ids[2]) for b in ids[2][k + 1 :])
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in set(ids[3])) <= 2


def test_near_copies_by_five_words(spark, small):
    rng = np.random.default_rng(5)
    rows, similar = [], {0.8: [], 0.9: []}

    def shingles(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for k in range(240):
        w = [f"v{x}" for x in rng.integers(0, 20_000, rng.integers(200, 1000))]
        v, share = list(w), (0.8, 0.9)[k % 2]
        a = shingles(w)
        for at in rng.permutation(len(w)):  # words are replaced as long as the similarity stays
            old, v[at] = v[at], "new"
            b = shingles(v)
            if len(a & b) / len(a | b) < share:
                v[at] = old
                break
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        similar[share].append(2 * k + 1)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in C.near(spark, docs, small).collect()}
    recall = {s: sum(i not in kept for i in ids) / len(ids) for s, ids in similar.items()}
    print("recall", recall)
    assert recall[0.8] >= 0.97 and recall[0.9] >= 0.97 and kept >= {2 * k for k in range(240)}


def test_near_copies_within_families(spark, small):
    """Pairs just above the similarity, each within a family of 60 texts that resemble each other too little."""
    rng = np.random.default_rng(6)
    rows, pairs, grams = [], [], {}

    def replaced(w, share, name):
        a, v = shingles(w), list(w)
        for k, at in enumerate(rng.permutation(len(w))):
            old, v[at] = v[at], f"{name}x{k}"
            b = shingles(v)
            if len(a & b) / len(a | b) < share:
                v[at] = old
                break
        return v

    def shingles(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for f in range(4):
        centre = [f"v{x}" for x in rng.integers(0, 20_000, 300)]
        for k in range(30):
            one = replaced(centre, 0.77, f"f{f}a{k}")
            two = replaced(one, 0.8, f"f{f}b{k}")
            i = 1000 * f + 2 * k
            rows += [(i, " ".join(one)), (i + 1, " ".join(two))]
            grams |= {i: shingles(one), i + 1: shingles(two)}
            pairs.append((i, i + 1))
    order = rng.permutation(len(rows))
    docs = spark.createDataFrame([(*rows[k], "en", "a", 0) for k in order], "doc_id long, text string, lang string, source string, n_chars long")
    for block in (2048, 4):
        comp = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_groups(docs, similarity=C.SIMILARITY, block=block).collect()}
        assert sum(comp[a] == comp[b] for a, b in pairs) >= 0.97 * len(pairs)
    prints = {i: simhash_dedup.fingerprint(t) & (2**64 - 1) for i, t in rows}
    linked = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) or (prints[a] ^ prints[b]).bit_count() <= 4
    ids = sorted(comp)
    truth = {i: {i} for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if a // 1000 == b // 1000 and truth[a] is not truth[b] and linked(a, b):
                both = truth[a] | truth[b]
                truth.update(dict.fromkeys(both, both))
    assert all(comp[i] in truth[i] for i in ids)  # nothing is linked that shouldn't be
    assert sum(comp[i] == min(truth[i]) for i in ids) >= 0.97 * len(ids)


def test_run(spark, small):
    rows = C.run(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    encoder = Encoder(read_model())
    assert rows and all(r["n_tokens"] == len(r["token_ids"]) and encoder.encode([texts[r["doc_id"]]])[0].tolist() == r["token_ids"] for r in rows)


def test_odd_rows(spark, odd, none, small):
    docs, empty = odd.select(C.COLUMNS), none.select(C.COLUMNS)
    for _, stage in C.STAGES:
        stage(spark, docs, small).count()
        assert stage(spark, empty, small).count() == 0
    # null and empty texts are one group, named by its smallest id; repeated rows of what stays all stay, as do rows without an id
    near = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in C.near(spark, docs, small).collect())
    assert near == [-1, -1, 1, 3, 5, 5, 7]
    exact = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in C.exact(spark, docs, small).collect())
    assert exact == [2, 4, 5, 6, 7, 8]
