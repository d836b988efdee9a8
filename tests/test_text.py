import datetime

from pyspark.sql import functions as F

from vetch.functions import text as X


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expression.alias("x")).first()["x"]


def test_terms(spark):
    assert one(spark, X.terms(F.col("t")), t="The Fund's fund, the ÉTÉ 2x of it") == ["fund", "été"]
    assert one(spark, X.terms(F.col("t")), t=None) == []


def test_numbers(spark):
    cases = {
        "managed $36.1 billion as of March 31, 2006": ["36100000000"], "about 40% or 40 percent of 1,495": ["40%", "1495"], "[p. 5, 00302] no amount in 2024-01-02": [],
        "1.50 and 1.5 and 100": ["1.5", "100"], "6.25 million": ["6250000"], "": [],
    }
    for text, want in cases.items():
        assert one(spark, X.numbers(F.col("t")), t=text) == want, text


def test_dates_and_states(spark):
    d = X.source_date(F.col("n"), F.col("t"))
    assert one(spark, d, n="2026-04-12-raw.csv", t="") == datetime.date(2026, 4, 12)
    assert one(spark, d, n="a.md", t="Status: draft. Data as of 2006-03-31.") == datetime.date(2006, 3, 31)
    assert one(spark, d, n="a.csv", t="metric,value,as_of_date\nx,1,2026-03-02") == datetime.date(2026, 3, 2)
    assert one(spark, d, n="a.md", t="on 2026-99-99") is None
    s = F.coalesce(X.status_line(F.col("t")), X.name_state(F.col("n")), F.lit("unclear"))
    assert [one(spark, s, n=n, t=t) for n, t in (("a-old.csv", ""), ("a-old.md", "x\nStatus: final. y"), ("a.md", "x"), ("b-raw-export.csv", ""))] == ["old", "final", "unclear", "raw"]
    assert one(spark, X.stem(F.col("n")), n="2026-01-02-Figures-final.csv") == "figures"


def test_paragraphs_and_ids(spark):
    assert one(spark, X.paragraphs(F.col("t")), t="# A\n\nb\nc\n \n\n d ") == ["# A", "b\nc", "d"]
    assert one(spark, X.passage_id(F.col("n"), F.lit(4)), n="finder-v-owner.md") == "passage_finder-v-owner_p0004"
    assert one(spark, X.passage_id(F.col("n"), F.lit(4)), n="old/finder-v-owner.md") == "passage_old/finder-v-owner_p0004"
    assert one(spark, X.passage_id(F.col("n"), F.lit(1001), F.col("t").cast("int")), n="a.pdf", t="1") == "passage_a_p0001-1001"
    a, b = (one(spark, X.content_id("claim", F.col("t"), F.lit(None)), t=t) for t in ("x", "y"))
    assert a != b and a.startswith("claim_")
