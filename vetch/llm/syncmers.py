"""Document fingerprints from closed syncmers.

A k-mer of the text's bytes is a closed syncmer if the smallest of its s-mers (by a mixed hash) lies at its start or end. Whether one
is chosen depends on its own bytes alone, so a passage gives the same anchors in whatever text it stands. A document's
fingerprint is the sorted set of its syncmers' hashes below BOUND, a fixed share of all, and at least the SKETCH smallest: it grows with
the text, and any two are comparable up to the hash to which both are whole. Two fingerprints' likeness estimates the
share of syncmers that the documents have in common. To place a passage, matched() holds all anchors of
one text against those of the other by their positions.

To pair each document with the next one, ids are cut into ranges at quantiles, each range is sorted, and the first row of a range is
also sent to the range before it. One shuffle moves the texts; the driver sees a few ids for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, text_of

K, S, SKETCH = 16, 8, 64
#: Every hash below it is part of a fingerprint: one in 16 of a text's syncmers, about one for each 72 bytes.
BOUND = 1 << 28
_EDGE = K - S
NONE = np.zeros(0, np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and 32-bit hashes of the closed syncmers of data, for positional matching. Shorter data than K has one, itself."""
    if len(data) < K:
        return (np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest(data)], np.uint32)) if data else (np.zeros(0, np.int64), NONE)
    h = _mixed(np.ndarray((len(data) - S + 1,), "<u8", data, strides=(1,)).copy())
    low = h
    for step in (1, 2, 4):  # the least of 2, 4, 8 s-mers, then of the K - S + 1 = 9
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:-1], low[1:])
    first, last = h[:-_EDGE], h[_EDGE:]
    at = np.flatnonzero((first == low) | (last == low))
    return at, (_mixed(first[at] * np.uint64(3) + (last[at] ^ np.uint64(0x5851F42D4C957F2D))) >> np.uint64(32)).astype(np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a text with these syncmer hashes, sorted."""
    own = np.unique(hashes)
    return own[: max(SKETCH, int(np.searchsorted(own, BOUND)))]


def whole_below(a: np.ndarray) -> int:
    """The hash below which a fingerprint has all of its text's: beyond all hashes where it is shorter than SKETCH."""
    return 1 << 32 if len(a) < SKETCH else max(BOUND, int(a[-1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the hashes of either that both have, up to where both are whole; two empty fingerprints are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, n = np.unique(np.concatenate([a, b]), return_counts=True)
    n = n[: int(np.searchsorted(both, min(whole_below(a), whole_below(b))))]
    return float((n == 2).sum()) / len(n)


def matched(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """Passages that two texts share, by the positions of their syncmers: (begin in a, begin in b, bytes), in order of a.

    An anchor that each text has once places the one text against the other. Anchors that follow each other in a at the same offset, no
    further apart than they are long, are one passage. However long the texts are, no anchor is left out but those that repeat within a text.
    """
    (at_a, hash_a), (at_b, hash_b) = a, b
    own = [np.unique(h, return_index=True, return_counts=True) for h in (hash_a, hash_b)]
    once = [(h[n == 1], i[n == 1]) for h, i, n in own]
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    x, y = at_a[once[0][1][i]], at_b[once[1][1][j]]
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    if not len(x):
        return []
    new = np.concatenate([[True], (np.diff(y - x) != 0) | (np.diff(x) > K)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(x)]]) - 1
    return sorted((int(p), int(q), int(e) - int(p) + K) for p, q, e in zip(x[first], y[first], x[last]))


def _place(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most doc_id, by bisection; a null id comes first."""
    bits = max(1, len(bounds).bit_length())
    padded = F.lit(bounds + [2**63 - 1] * (2**bits - 1 - len(bounds)))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    at = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.element_at(padded, p + s) <= doc_id, p + s).otherwise(p))
    return F.coalesce(at, F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, ahead, doc_id, text), to be sorted so within a part: the successor of the last row of a part is its first ahead row."""
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)
    bounds = sorted({int(c) for c in cuts})
    docs = docs.withColumn("part", _place(F.col("doc_id"), bounds))
    firsts = sorted((r["part"], r["none"], r["id"]) for r in docs.groupBy("part").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none")).collect())  # a row for each part
    before = {p: firsts[k - 1][0] for k, (p, _, _) in enumerate(firsts)}
    heads = spark.createDataFrame([(p, None if none else i, before[p]) for p, none, i in firsts], "_part int, _id long, _to int")
    heads = docs.join(F.broadcast(heads), (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    heads = heads.groupBy("_to", "doc_id").agg(F.min("text").alias("text"))
    heads = heads.select(F.col("_to").alias("part"), F.lit(True).alias("ahead"), "doc_id", "text")
    return docs.select("part", F.lit(False).alias("ahead"), "doc_id", "text").unionByName(heads)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    out: list[tuple] = []
    held = None  # the row whose successor is to come: part, doc_id, text, anchors, sketch

    def close(row, text: str, own: np.ndarray, anchors) -> None:
        _, doc_id, mine, mine_anchors, mine_sketch = row
        passages = matched(mine_anchors, anchors)
        half = len(mine) // 2
        edited = (mine[: len(mine) - half] + text[:half]).encode("utf-8", "surrogatepass")
        edited_sketch = sketch(syncmers(edited)[1])
        out.append((doc_id, len(mine), hashlib.sha256(edited).hexdigest(), mine_sketch.astype(">u4").tobytes().hex(), edited_sketch.astype(">u4").tobytes().hex(), likeness(mine_sketch, edited_sketch), likeness(mine_sketch, own), len(passages), max((n for *_, n in passages), default=0)))

    for batch in batches:
        for part, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text"))):
            data = text.encode("utf-8", "surrogatepass")
            anchors = syncmers(data)
            own = sketch(anchors[1])
            if held is not None and held[0] == part:
                close(held, text, own, anchors)
            held = None if ahead else (part, doc_id, text, anchors, own)
            if len(out) >= 500:
                yield _rows(out)
                out = []
    if out:
        yield _rows(out)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, passages_next long, longest_next long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*out), SCHEMA.split(", "))], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): its fingerprint, that of its edited text, their likenesses, and how many passages it shares with
    the next row by position and the bytes of the longest (see SCHEMA).

    The edited text's last floor(n_chars / 2) code points are replaced by the first as many, or all, of the next row in order
    of doc_id (nulls first), then text; the last row's next is the first, a lone row's is itself. A null text counts as
    empty; an empty text has an empty fingerprint. Of repeated rows each is the next of another. Other columns of docs are not
    used; an empty table gives no rows.
    """
    rows = with_next(docs)
    dealt = rows.repartition(shuffle_partitions(docs.sparkSession), "part").sortWithinPartitions("part", "ahead", "doc_id", "text")
    return dealt.mapInArrow(_fingerprinted, SCHEMA)


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints of all documents; odd rows as stated there."""
    return fingerprints(table(spark, sf_dir, "documents"))
