"""Mixing sources to target weights over a time-varying curriculum.

Every source has a weight for each of K phases of equal length. The integral of a source's schedule is its overall weight, which
gives its share of the words to take; the schedule's running integral, scaled to that share, is its cumulative demand D(t) for
training time t in [0, 1]. The documents of a source stand in a fixed order that looks random (by the MD5 of the id), so each
begins at a known word c of its source's stream; inverting D gives the time t with D(t) = c, the document's training
position. A stream that must give more than its source has begins anew: another epoch.

The place of a document in its source's stream is a running sum over that source, and one source may hold most rows. It is
taken in two steps: sums of 4096 slices of the MD5 range per source, then a running sum within one slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

#: Weights by phase: front-loaded, steady, back-loaded. Their integrals are as 5 to 2 to 1.
SCHEDULES = ((40, 30, 20, 10), (10, 10, 10, 10), (2, 4, 6, 8))
SHARE, MAX_EPOCHS = 1.5, 2.0


def source_targets(sizes: DataFrame, schedules=SCHEDULES, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """A row for each source in ``sizes`` (source, source_size): its target and schedule.

    Sources by code point, null last, get the schedules in turn. Together they take ``share`` of all words in proportion to
    the schedules' integrals; none takes over ``max_epochs`` times its size, and what it can't take the others do, by weight. With
    the sources in the order in which they fill up (size over weight), the level at which the rest stand is
    (words to take - what the full ones take) / weight of the rest, at the first source that stays below its limit.
    """
    phases = len(schedules[0])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    s = sizes.withColumn("_rank", rank)
    which = F.pmod(F.col("_rank"), F.lit(len(schedules)))
    schedule = F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in schedules])
    s = s.withColumn("schedule", F.element_at(schedule, which.cast("int") + 1))
    s = s.withColumn("weight", sum(F.col("schedule")[k] for k in range(phases)).cast("double"))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "_rank")
    every = Window.partitionBy()
    s = s.withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("_full", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_left"))
    s = s.withColumn("_open", F.col("_level") <= F.col("most") / F.col("weight"))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_full"), F.col("_level")))).over(every)
    s = s.withColumn("_at", level)
    target = F.when(F.col("_at").isNull(), F.col("most")).otherwise(F.least(F.col("_at._level") * F.col("weight"), F.col("most")))
    return s.withColumn("target", target).select("source", "source_size", "target", "schedule", "weight")


def _time(c: Column, target: Column, schedule: Column, weight: Column, phases: int) -> Column:
    """The time t in [0, 1) at which the cumulative demand reaches c."""
    found, done = F.lit(1.0), [F.lit(0.0)]
    for k in range(phases):
        done.append(done[-1] + schedule[k])
    for k in reversed(range(phases)):
        low, high = target * done[k] / weight, target * done[k + 1] / weight
        found = F.when(c < high, (F.lit(float(k)) + (c - low) / (high - low)) / F.lit(float(phases))).otherwise(found)
    return found


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, max_epochs: float = MAX_EPOCHS, size: str | None = None) -> DataFrame:
    """The rows of docs with size, source_size, target, taken and placements.

    docs has doc_id, source and either text, whose words are counted, or a column ``size`` of sizes. All columns stay; those named
    like a result are replaced. ``taken`` is how many words of the document the mix takes, repeats counted; ``placements`` has
    (epoch, words, time) for each time the document is taken. The last document that a source gives may be taken in part, so
    that a source's words come within one word of its target. Null and empty texts have size 0 and are never taken; an empty table
    gives an empty result; repeated rows are documents of their own.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "placements")]
    sizes = F.coalesce(F.col(size), F.lit(0)).cast("long") if size else word_count(F.col("text"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = docs.select(F.struct(*kept).alias("_doc"), "doc_id", "source", sizes.alias("size"), order.alias("_order"), F.substring(order, 1, 3).alias("_slice"))
    slices = d.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    targets = source_targets(slices.groupBy("source").agg(F.sum("_words").alias("source_size")), schedules, share, max_epochs)
    targets = targets.withColumnRenamed("source", "_source")
    slices = slices.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_words").withColumnsRenamed({"source": "_s", "_slice": "_n"})
    d = d.join(slices, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_n")))
    running = Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    epochs, phases = math.ceil(max_epochs), len(schedules[0])
    whole = F.floor("target")
    places = []
    for e in range(epochs):
        at = F.col("_start") + F.col("source_size") * e
        words = F.greatest(F.lit(0), F.least(whole - at, F.col("size")))
        time = _time(at.cast("double"), F.col("target"), F.col("schedule"), F.col("weight"), phases)
        places.append(F.when(words > 0, F.struct(F.lit(e).alias("epoch"), words.cast("long").alias("words"), time.alias("time"))))
    d = d.withColumn("placements", F.filter(F.array(*places), lambda p: p.isNotNull()))
    d = d.withColumn("taken", F.aggregate("placements", F.lit(0).cast("long"), lambda a, p: a + p["words"]))
    return d.select("_doc.*", "size", "source_size", "target", "taken", "placements")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each placement of what mix() returned, in range-sorted training order (time, then doc_id); columns named epoch, words and time are replaced."""
    rows = mixed.drop("epoch", "words", "time").withColumn("_p", F.explode("placements"))
    return rows.select("*", "_p.epoch", "_p.words", "_p.time").drop("_p", "placements").orderBy("time", "doc_id", "epoch")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix over all documents in training order; odd rows as stated there."""
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mix(sized, size="size").withColumn("first_time", F.get("placements", F.lit(0))["time"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_time").orderBy("first_time", "doc_id")


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM d GROUP BY source
), w AS (
  SELECT *, CAST([100, 40, 20][CAST(rk % 3 AS INT) + 1] AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS most,
         [[0, 40, 70, 90, 100], [0, 10, 20, 30, 40], [0, 2, 6, 12, 20]][CAST(rk % 3 AS INT) + 1] AS done,
         CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS every FROM s
), f AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(weight) OVER (ORDER BY most / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM w
), g AS (
  SELECT *, (every - full_) / left_ AS level FROM f
), t AS (
  SELECT *, (SELECT arg_min(level, full_) FROM g WHERE level <= most / weight) AS at_ FROM g
), tt AS (
  SELECT source, source_size, done, weight, CASE WHEN at_ IS NULL THEN most ELSE least(at_ * weight, most) END AS target FROM t
), p AS (
  SELECT d.doc_id, d.size, tt.*, coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN tt ON d.source IS NOT DISTINCT FROM tt.source
), q AS (
  SELECT *, greatest(0, least(CAST(floor(target) AS BIGINT) - start, size)) AS w0,
         greatest(0, least(CAST(floor(target) AS BIGINT) - start - source_size, size)) AS w1, CAST(start AS DOUBLE) AS c FROM p
)
SELECT doc_id, size, source_size, target, CAST(w0 + w1 AS BIGINT) AS taken,
  CASE WHEN w0 = 0 THEN NULL
       WHEN c < target * done[2] / weight THEN (0 + (c - target * done[1] / weight) / (target * done[2] / weight - target * done[1] / weight)) / CAST(4 AS DOUBLE)
       WHEN c < target * done[3] / weight THEN (1 + (c - target * done[2] / weight) / (target * done[3] / weight - target * done[2] / weight)) / CAST(4 AS DOUBLE)
       WHEN c < target * done[4] / weight THEN (2 + (c - target * done[3] / weight) / (target * done[4] / weight - target * done[3] / weight)) / CAST(4 AS DOUBLE)
       ELSE (3 + (c - target * done[4] / weight) / (target * done[5] / weight - target * done[4] / weight)) / CAST(4 AS DOUBLE) END AS first_time
FROM q
"""
