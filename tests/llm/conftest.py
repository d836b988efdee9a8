import pytest

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(12_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, sha string, size string, target string, score string, row string, fp string, grp string, part string, weight string, label string, epoch string, time string, kept string, live string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, "One two three four five.\nSix seven", "en", "a"),
        (2, "ONE two three four five.\nSix seven", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (None, "one two three four five.\nSix seven", "en", None),
        (5, LONG, "en", "c"),
        (5, LONG, "en", "c"),
        (6, " \t\n ", "en", "b"),
        (None, None, None, None),
        (7, "naïve ÉTÉ 日本語 \U0001f600 password=abc123def456", "fr", "b"),
        (8, LONG + " end", "en", "a"),
    ]
    clash = ("x",) * (len(SCHEMA.split(", ")) - 5)
    return spark.createDataFrame([(i, t, g, s, len(t) if t else None, *clash) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"]) for r in rows)
