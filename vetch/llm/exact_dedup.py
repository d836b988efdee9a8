"""Exact dedup by an extendible-hash index on shared files.

A directory maps the first bits of a text's 64-bit hash to a bucket. It starts with one bucket and doubles, splitting each bucket that
holds more than ``capacity`` entries, until none is overfull or MAX_DEPTH bits are used; as a bucket's count is known for every number
of bits, the depth at which it stops is read off directly. The index holds an entry for each different normalised text: its bucket, its
hash, its place in the chain of entries under that hash, the id of the row that stays and how many rows have the text. Rows of equal bytes are
combined before the shuffle, however many copies a text has, so texts that share a hash are told apart by their bytes. Each owner
task takes a range of the directory's slots, chains the entries under a hash and writes its buckets to a Parquet file of its own.

A document finds its entry the same way: the directory turns its hash into a bucket, and in the bucket's chain of that hash the
entry is the one with its text's SHA-256, which the owners check to be one entry's alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, kept_table, shuffle_partitions, skew_left_join, table, text_of

#: The directory has at most 2 ** MAX_DEPTH slots; entries beyond its last doubling lengthen their bucket.
MAX_DEPTH, CAPACITY = 16, 100_000


def _slot(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, depth, bucket) for each slot of max_depth bits in use by entries (h): how many bits its bucket has, and these."""
    slots = entries.groupBy(_slot(F.col("h"), max_depth).alias("slot")).agg(F.count("*").alias("n"))
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    held = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    # At most 2 ** (max_depth + 1) rows; sent to all tasks, as the buckets of few bits would each gather all their slots in one.
    fits = levels.join(F.broadcast(held), ["depth", "bucket"]).where((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    return fits.groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b")).select("slot", "b.depth", "b.bucket")


def _hash(bits: int, norm: str) -> Column:
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(_slot(h, bits), 64 - bits)


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The directory (slot, depth, bucket) of docs (doc_id, text), and the index on shared files: depth, bucket, h, chain, sha, keep_id,
    group_size. Both are tables in the shared folder.

    Fewer hash_bits make hashes collide, for tests.
    """
    keyed = docs.select("doc_id", ascii_lower(text_of()).alias("norm")).withColumn("h", _hash(hash_bits, "norm"))
    entries = keyed.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = cut(entries.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"))
    slots = kept_table(directory(entries, capacity, max_depth))  # at most 2 ** max_depth rows
    owned = routed(entries, slots, max_depth).repartitionByRange(shuffle_partitions(docs.sparkSession), "_slot", "h")
    chain = Window.partitionBy("_slot", "h").orderBy("sha")
    placed = owned.withColumn("chain", F.row_number().over(chain))
    twin = F.lag("sha").over(chain) == F.col("sha")
    placed = placed.withColumn("chain", F.when(twin, F.raise_error(F.lit("two texts share a SHA-256")).cast("int")).otherwise(F.col("chain")))
    return slots, kept_table(placed.select("depth", "bucket", "h", "chain", "sha", "keep_id", "group_size"))


def routed(rows: DataFrame, slots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """rows (h) with the depth and bucket that the directory has for them; a hash in no slot of the directory is in no bucket."""
    return rows.withColumn("_slot", _slot(F.col("h"), max_depth)).join(F.broadcast(slots.withColumnRenamed("slot", "_slot")), "_slot")


RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64, columns: list[str] | None = None) -> DataFrame:
    """The rows of docs (doc_id, text), with their ``columns`` (default: all), and keep_id, group_size, kept and text_sha256.

    Texts are equal when they are after lower-casing A-Z; null counts as empty. The row with the largest doc_id of its group
    stays, and of repeated rows with that id one. A null doc_id is smaller than any other; where a whole group has none, keep_id is
    null and one row stays. Columns named like a result are replaced. An empty table gives no rows.
    """
    slots, index = build_index(docs, capacity, max_depth, hash_bits)
    base = [c for c in (columns or docs.columns) if c not in RESULTS]
    rows = docs.select(F.struct(*base).alias("_doc"), "doc_id", ascii_lower(text_of()).alias("_norm"))
    rows = rows.select("_doc", "doc_id", _hash(hash_bits, "_norm").alias("h"), F.sha2("_norm", 256).alias("sha"))
    rows = routed(rows, slots, max_depth)
    found = skew_left_join(rows, index.select("depth", "bucket", "h", "sha", "keep_id", "group_size"), ["depth", "bucket", "h", "sha"], "group_size", "doc_id")
    once = F.row_number().over(Window.partitionBy("_key", "_done", "h", "sha", "doc_id").orderBy(F.lit(1))) == 1
    found = found.withColumn("kept", once & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return found.select("_doc.*", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_groups over all documents; nulls, empty texts, ties and repeated rows as stated there."""
    return exact_groups(table(spark, sf_dir, "documents"), columns=["doc_id"])


ORACLE_OP3 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
