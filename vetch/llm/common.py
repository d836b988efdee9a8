"""What several operators share: reading, cutting lineage, words, joins with hot keys, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Keys that skew_left_join sends to every task: at most so many rows.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there from now on.

    The folder is the one in spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster is refused, as
    its executors would each write to a disk of their own. Spark deletes the files of what is no longer used if
    spark.cleaner.referenceTracking.cleanCheckpoints says so.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vetch-"))
    return sc.getCheckpointDir()


def kept_table(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table of its own in the shared folder and reads it from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a kept_table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone. In an ASCII text, which is common and where lower() is much faster, lower() does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """How many words the text has; null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), GAP)
    blank_ends = (pieces[0] == "").cast("int") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return (F.size(pieces) - blank_ends).cast("long")


def skew_left_join(left: DataFrame, right: DataFrame, on: list[str], frequency: str, row_id: str) -> DataFrame:
    """left ⟕ right on the columns ``on``, where right has one row for each key and the key's number of left rows in
    ``frequency``. The HOT_KEYS most frequent keys are broadcast, so none of those that meet in a shuffle has more than
    1/HOT_KEYS of the rows; rows with a hot key are spread by ``row_id``. ``right`` is read twice: give it cut. The columns of
    right must not clash with those of left. _key and _done, by which the rows are dealt out, are returned too.
    """
    rest = [c for c in right.columns if c not in on]
    hot = right.orderBy(F.desc(frequency)).limit(HOT_KEYS).select(*on, F.struct(*rest).alias("_hot"))
    met = left.join(F.broadcast(hot), on, "left")
    # A row that has met its hot key gets a random key of its own, marked so that it meets nothing.
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(row_id)).otherwise(F.xxhash64(*[F.col(c) for c in on]))
    met = met.withColumn("_key", spread).withColumn("_done", F.col("_hot").isNotNull())
    cold = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], F.struct(*rest).alias("_cold"), F.xxhash64(*[F.col(c) for c in on]).alias("_cold_key"), F.lit(False).alias("_cold_done"))
    same = (F.col("_key") == F.col("_cold_key")) & (F.col("_done") == F.col("_cold_done"))
    for c in on:
        same = same & ((F.col(c) == F.col(f"_on_{c}")) | F.col("_done"))
    out = met.join(cold, same, "left").withColumn("_met", F.coalesce("_hot", "_cold"))
    return out.select(*[F.col(c) for c in left.columns], "_key", "_done", *[F.col(f"_met.{c}").alias(c) for c in rest])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """The connected components of the undirected edges (a, b): a row (id, component) for each id that has an edge to another
    one, with the smallest id of its component.

    Alternates two star operations, each a grouping and a join, until the edges no longer change: large stars link the larger
    neighbours of a node to its smallest neighbour, small stars the smaller ones. Every round is written to the checkpoint
    folder. Edges that are null at an end or join a node to itself have no effect.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, sign = cut(edges), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u > v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
