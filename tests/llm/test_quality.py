import numpy as np

from vetch.llm import quality as Q


def test_held_out_accuracy(spark, small):
    sf = small.replace("0.001", "0.01")
    rows = Q.op9_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert len(held) > 80 and (good[:, None] > bad[None, :]).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95 and (held[held.quality == 1].predicted == 1).mean() > 0.97


def test_ftrl_learns_and_reruns_agree():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 7, 10 + int(rng.integers(5))]), np.array([1.0, 0.5]), int(k % 7 < 3)) for k in range(400)]
    (w, b), again = Q.ftrl(rows), Q.ftrl(rows)
    assert all((w[i] @ x + b > 0) == y for i, x, y in rows) and np.array_equal(w, again[0])


def test_scores_use_the_text_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    both = docs.union(docs.selectExpr("doc_id + 100000", "text", "'xx'", "'zz'", "n_chars"))
    rows = {r["doc_id"]: r["score"] for r in Q.classify(both, labels).collect()}
    assert all(rows[i] == rows[i + 100000] for i in rows if i < 100000)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert {r["score"] for r in Q.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(none, labels).count() == 0
