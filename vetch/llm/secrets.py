"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for candidates of a few kinds. Their hashes are then counted over the whole corpus by distinct repositories and
distinct owners: a string that many owners have is a copied example, one that few have and that looks alive is a
secret of theirs. The base kinds (assigned values, access keys, long hex runs) are always reported and the count only
labels them; mixed runs of 20 or more letters, digits and marks are reported where the count says that they are owned.

A candidate that very many documents hold is combined before the shuffle when it is counted, and its count comes back by the join
for hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, skew_left_join, table, text_of

KEY = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern finds the same runs as dropping shorter matches.
ACCESS, HEX, MIXED = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "mixed")
LEAST_VALUE = 6
#: A string that more owners, or more repositories, than this have is an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 100
#: Matches that are put together at a time.
CHUNK = 256


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once: an expression that stands inside a lambda is worked out again for each element."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches: their places, from the pieces between them, and values."""
    pieces, found, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    item = "struct<start:bigint,kind:int,end:bigint,value:string>"
    nothing, empty = F.lit(0).cast("long"), F.array().cast(f"array<{item}>")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["piece"])
        end = start + F.length(m["found"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    # A fold that adds to an array copies it each time, so matches are folded CHUNK at a time, each chunk from where it begins.
    def chunked(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, CHUNK))

    def folded(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, nothing, lambda n, m: n + F.length(m["piece"]) + F.length(m["found"])))
        begins = F.aggregate(lengths, F.struct(nothing.alias("at"), F.array().cast("array<bigint>").alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("rows"), begins.alias("at")), lambda c: F.aggregate(c["rows"], F.struct(c["at"].alias("at"), empty.alias("spans")), step, lambda s: s["spans"])))

    rows = _bound(found, lambda f: F.arrays_zip(F.slice(pieces, 1, F.size(f)).alias("piece"), f.alias("found"), values.alias("value")))
    return F.when(text.rlike(pattern), _bound(_bound(rows, chunked), folded)).otherwise(empty)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that meet none of others, which are in order and don't meet each other: the first of them that ends behind a span's start
    is found by bisection and must not start before the span's end."""

    def kept(o: Column) -> Column:
        n = F.size(o["ends"])
        first = lambda s: F.aggregate(o["steps"], F.lit(0), lambda p, k: F.when((p + k <= n) & (o["ends"][p + k - 1] <= s["start"]), p + k).otherwise(p))
        return F.filter(spans, lambda s: F.coalesce(F.get(o["starts"], first(s)) >= s["end"], F.lit(True)))

    parts = lambda b: F.struct(b["start"].alias("starts"), b["end"].alias("ends"), F.lit([1 << k for k in reversed(range(26))]).alias("steps"))
    return _bound(_bound(others, parts), kept)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, array<struct<start, kind, end, value>>; kind counts through KINDS."""
    assign = F.filter(_matches(text, 0, ASSIGN, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    mixed = F.filter(_matches(text, 3, MIXED, 0), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    found = F.struct(assign.alias("assign"), _matches(text, 1, ACCESS, 0).alias("access"), _matches(text, 2, HEX, 0).alias("hex"), mixed.alias("mixed"))
    return _bound(found, lambda f: F.concat(f["assign"], f["access"], f["hex"], _apart(_apart(_apart(f["mixed"], f["assign"]), f["access"]), f["hex"])))


def ownership(found: DataFrame) -> DataFrame:
    """From candidates (key, repository, owner): key, n_repositories, n_owners, n_found."""
    once = found.groupBy("key", "owner", "repository").agg(F.count("*").alias("n"))
    return once.groupBy("key").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n_found"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, secrets) for each row of docs: an array of (start, kind, end, value, live, n_repositories, n_owners).

    Places count code points, the end is exclusive. live says that at most ``max_owners`` owners and ``max_repositories``
    repositories have the value, which an example that one owner copies all over hasn't, and that it has both a letter and a digit. Mixed runs are there only if live. Null texts count as empty, null owners and
    repositories as one of their own each; repeated rows stay rows of their own; an empty table gives no rows. Other columns of
    docs are not used.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select("doc_id", part(repository).alias("repository"), part(owner).alias("owner"), candidates(text_of()).alias("spans"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # the number is written down with the row
    found = rows.select("row", "repository", "owner", F.explode("spans").alias("s")).withColumn("key", F.sha2("s.value", 256))
    known = cut(ownership(found.select("key", "repository", "owner")))
    found = skew_left_join(found.select("row", "s", "key"), known, ["key"], "n_found", "row")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories) & F.col("s.value").rlike("[0-9]") & F.col("s.value").rlike("[A-Za-z]")
    found = found.withColumn("live", live).where((F.col("s.kind") < 3) | F.col("live"))
    secret = F.struct("s.start", "s.kind", "s.end", "s.value", "live", "n_repositories", "n_owners")
    secrets = found.groupBy("row").agg(F.sort_array(F.collect_list(secret)).alias("secrets"))
    none = F.array().cast(secrets.schema["secrets"].dataType)
    return rows.select("row", "doc_id").join(secrets, "row", "left").select("doc_id", F.coalesce("secrets", none).alias("secrets"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan over all documents; odd rows as stated there."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda test: F.size(F.filter("secrets", test)).cast("long")
    return found.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
        count(lambda s: (s["kind"] < 3) & s["live"]).alias("n_live"),
        count(lambda s: (s["kind"] < 3) & ~s["live"]).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("secrets", lambda s: s["n_repositories"])), F.lit(0)).cast("long").alias("most_repositories"),
    )


def _oracle() -> str:
    quoted = [p.replace("'", "''") for p in (ASSIGN, ACCESS, HEX, MIXED)]
    parts = " UNION ALL ".join(
        f"""SELECT rid, owner, repository, {k} AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {2 if k == 0 else 0})) AS value,
        unnest(regexp_split_to_array(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS piece, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i
        FROM d WHERE regexp_matches(text, '{p}')"""
        for k, p in enumerate(quoted)
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS owner, coalesce(CAST(doc_id AS VARCHAR), chr(0)) AS repository FROM documents
), m AS ({parts}
), placed AS (
  SELECT *, CAST(sum(length(piece) + length(m)) OVER w AS BIGINT) AS e FROM m WINDOW w AS (PARTITION BY rid, kind ORDER BY i)
), c AS (
  SELECT rid, owner, repository, kind, value, e - length(m) AS s, e FROM placed
  WHERE CASE kind WHEN 0 THEN length(value) >= {LEAST_VALUE} WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END
), a AS (
  SELECT * FROM c WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM c b WHERE b.rid = c.rid AND b.kind < 3 AND c.s < b.e AND c.e > b.s)
), f AS (
  SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM a GROUP BY value
), l AS (
  SELECT a.*, repositories, owners <= {MAX_OWNERS} AND repositories <= {MAX_REPOSITORIES} AND regexp_matches(a.value, '[0-9]') AND regexp_matches(a.value, '[A-Za-z]') AS live FROM a JOIN f USING (value)
), t AS (
  SELECT *, ['assign', 'access', 'hex', 'mixed'][kind + 1] || ':' || s || ':' || e AS span FROM l WHERE kind < 3 OR live
)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans,
       count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_copied, coalesce(max(repositories), 0) AS most_repositories
FROM d LEFT JOIN t USING (rid) GROUP BY d.rid, d.doc_id
"""


ORACLE_OP2 = _oracle()
