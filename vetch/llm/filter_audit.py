"""How five filters interact: what each removes, alone and after others, in all 120 orders.

One scan of the Arrow buffers gives each text its failures as a mask of bits (see scan.py: byte classes, prefix sums, verified word
hashes). From there on only narrow rows move: identical texts share a mask, so they are counted by their SHA-256, and a
part's table of at most 32 masks is all that the orders need; three small matrices turn it into every order's steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of
from .scan import CAPITAL, CLASS, INNER, PIECE, SYMBOL, distinct_words, portions, spans, texts

FILTERS = "ABCDE"
#: A: fewer words. B: a smaller percentage of words that differ. C: a larger percentage of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
COPY = 1 << FILTERS.index("E")


def counts(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Words, different words, capitals, symbols and code points of each text; ``at`` has where each begins, with the end."""
    n, kind = len(at) - 1, CLASS[raw]
    begin, end = spans(kind, at)
    text = np.searchsorted(at, begin, "right") - 1

    def of(bit: int) -> np.ndarray:
        has = (kind & bit) != 0
        if n == 1:
            return np.array([np.count_nonzero(has)])
        sums = np.concatenate([[0], np.cumsum(has, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    return {"words": np.bincount(text, minlength=n), "distinct": distinct_words(raw, text, begin, end, n), "capitals": of(CAPITAL), "symbols": of(SYMBOL), "points": np.diff(at) - of(INNER)}


def failures(c: dict[str, np.ndarray]) -> np.ndarray:
    """The mask of filters A to D that each text fails."""
    fails = [c["words"] < LEAST_WORDS, 100 * c["distinct"] < LEAST_DISTINCT * c["words"], 100 * c["capitals"] > MOST_CAPITALS * c["points"], c["symbols"] > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = texts(batch.column("text"))
        masks, shas = [], []
        for i, j in portions(at):
            part, begins = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            masks.append(failures(counts(part, begins)))
            shas += [hashlib.sha256(part[a:b]).digest() for a, b in zip(begins[:-1], begins[1:])]
        mask = np.concatenate(masks) if masks else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(shas, pa.binary())], ["doc_id", "part", "mask", "sha"])


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, sha) for each row of docs: the filters A to D that its text fails, and the text's SHA-256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, part string, mask int, sha binary")


def tallies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of a part fail just the filters of the mask, and how many of them are good and toxic."""
    rows = masked(docs).groupBy("doc_id", "part", "mask", "sha").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # Rows of one text differ in nothing else; those of its smallest id aren't copies, nor are rows without an id.
    cells = rows.groupBy("sha", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("none"))
    cells = cells.withColumn("first", F.min("low.doc_id").over(Window.partitionBy("sha")))
    stay = F.col("none") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    either = F.explode(F.array(F.struct(F.col("mask"), stay.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - stay).alias("n"))))
    cells = cells.select("part", "good", "toxic", either.alias("c")).select("part", "c.mask", "c.n", (F.col("good") * F.col("c.n")).alias("good"), (F.col("toxic") * F.col("c.n")).alias("toxic"))
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _orders() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step, its filter's bit, and by mask: whether it is removed there, still kept after, and failed again."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = np.array([[1 << FILTERS.index(c) for c in o] for o in orders])
    before = np.cumsum(bit, axis=1) - bit
    mask = np.arange(1 << len(FILTERS))
    fails, gone = (bit[..., None] & mask) != 0, (before[..., None] & mask) != 0
    return orders, bit, fails & ~gone, fails & gone


NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in NUMBERS)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders, bit, here, again = _orders()
    names, steps = np.repeat(orders, len(FILTERS)).tolist(), np.tile(np.arange(1, len(FILTERS) + 1), len(orders))
    for batch in batches:
        for part, rows in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
            h = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for r in rows:
                h[:, r["mask"]] += (r["n"], r["good"], r["toxic"])
            removed = here @ h[0]
            kept = h[0].sum() - np.cumsum(removed, axis=1)
            shapley = np.zeros(1 << len(FILTERS), np.int64)
            np.add.at(shapley, bit, removed)
            values = (kept, removed, again @ h[0], h[0][bit], here @ h[1], here @ h[2], shapley[bit])
            columns = [pa.array([part] * len(names)), pa.array(names), pa.array(steps, pa.int32()), *[pa.array(v.ravel(), pa.int64()) for v in values]]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source) of docs (doc_id, text, source), order of the filters and step, the counts of SCHEMA; labels has (doc_id, quality, toxic).

    Null texts count as empty, null sources as the part of the empty string. A row fails E if a row with a smaller doc_id has the
    same text (SHA-256), in whatever part; a row without a doc_id neither fails it nor makes others fail, and rows that share
    their group's smallest doc_id all pass. Repeated rows count each. Of several labels of a document, one with quality=1 or
    toxic=1 suffices; labels without doc_id count for nothing. An empty table of documents gives no rows, an empty table of labels zeros.
    Other columns are not used.
    """
    parts = tallies(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    return parts.mapInArrow(_ordered, SCHEMA)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit of all documents by the labels; odd rows as stated there."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
    'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS fails FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM c a, c b, c x, c y, c z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
r AS (SELECT h.*, filter_order, step, fails[substr(filter_order, step, 1)] AS failing, len(list_filter(string_split(filter_order[1:step-1], ''), lambda k: k <> '' AND fails[k])) > 0 AS gone,
    len(list_filter(map_values(fails), lambda v: v)) = 1 AS lone FROM h, s),
g AS (SELECT part, filter_order, step, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failing AND lone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM g
"""
