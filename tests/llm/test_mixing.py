from vetch.llm import mixing


def test_matches_sql(spark, small, duck, same_rows):
    assert same_rows(mixing.op1_mixing(spark, small), duck, mixing.ORACLE_OP1) == 200


def test_targets_limits_and_positions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], {"target": r["target"], "size": r["source_size"], "taken": 0})
        s["taken"] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
        assert all(0 <= p["time"] < 1 for p in r["placements"])
    assert all(abs(s["taken"] - s["target"]) <= 1 and s["target"] <= 2 * s["size"] + 1e-6 for s in by.values())
    assert abs(sum(s["target"] for s in by.values()) - 1.5 * sum(s["size"] for s in by.values())) < 1
    times = [r["time"] for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert times == sorted(times)


def test_schedule_shapes_the_time(spark):
    docs = spark.createDataFrame([(k, "a b c d", "early" if k % 2 else "late") for k in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, schedules=((3, 1), (1, 3)), share=1.0, max_epochs=1.0).collect()
    first = {s: sum(p["words"] for r in rows if r["source"] == s for p in r["placements"] if p["time"] < 0.5) / 800 for s in ("early", "late")}
    assert abs(first["early"] - 0.75) < 0.02 and abs(first["late"] - 0.25) < 0.02


def test_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert out.count() == odd.count() and {"h", "weight", "label"} <= set(out.columns)
    assert {r["taken"] for r in out.collect() if not (r["text"] or "").strip()} == {0}
    assert mixing.training_order(out).count() >= 0
    assert mixing.mix(none).count() == 0
