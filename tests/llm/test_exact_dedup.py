from pyspark.sql import functions as F

from vetch.llm import exact_dedup as E


def test_matches_sql(spark, small, duck, same_rows):
    assert same_rows(E.op3_exact_dedup(spark, small), duck, E.ORACLE_OP3) == 200


def test_collisions_chain_and_buckets_split(spark, small, duck, same_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    few = E.exact_groups(docs, capacity=3, max_depth=5, hash_bits=4, columns=["doc_id"])
    assert same_rows(few, duck, E.ORACLE_OP3) == 200
    slots, index = E.build_index(docs, capacity=3, max_depth=5, hash_bits=4)
    assert index.agg({"chain": "max"}).first()[0] > 1
    assert index.select("depth").distinct().count() >= 1 and slots.count() <= 16


def test_documents_go_through_the_directory(spark, small, duck, same_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    slots, index = E.build_index(docs, capacity=3, max_depth=8)
    assert index.agg({"depth": "max"}).first()[0] >= 2 and slots.count() > 20
    per = {(r["depth"], r["bucket"]): r["n"] for r in index.groupBy("depth", "bucket").agg(F.count("*").alias("n")).collect()}
    assert len(per) > 20 and all(n <= 3 or d == 8 for (d, _), n in per.items())
    rows = docs.select(E._hash(64, "text").alias("h"))
    assert E.routed(rows, slots.where("depth < 0"), 8).count() == 0  # without the directory nothing is found
    assert same_rows(E.exact_groups(docs, capacity=3, max_depth=8, columns=["doc_id"]), duck, E.ORACLE_OP3) == 200


def test_directory_stops_where_a_bucket_fits(spark):
    entries = spark.createDataFrame([(h << 60,) for h in (0, 1, 2, 3, 4, 5, 6, 7)] + [((8 << 60) - (1 << 64),)], "h long")
    rows = {r["slot"]: (r["depth"], r["bucket"]) for r in E.directory(entries, capacity=2, max_depth=4).collect()}
    assert rows[0] == (3, 0) and rows[7] == (3, 3) and rows[8] == (1, 1)


def test_odd_rows(odd, none):
    rows = E.exact_groups(odd).collect()
    assert len(rows) == odd.count() and "h" in rows[0].asDict()
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    assert all(sum(r["kept"] for r in g) == 1 and all(r["group_size"] == len(g) for r in g) for g in by.values())
    assert next(r for r in rows if r["doc_id"] == 1)["keep_id"] == 2
    assert E.exact_groups(none).count() == 0
