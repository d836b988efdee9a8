"""Asking the whole corpus about keys, by groups of documents.

Documents are dealt into groups of about GROUP_BYTES of text. A group asks once about each of its different keys, so what thousands of its
documents share counts once, and the question about a key goes to the key's shard. A shard sees what all groups ask, and answers each in
the order in which it asked, so answers need no keys. A group works its question out again from its texts to read the answer;
all stages read the texts from the same shuffle.

A group sends nothing to a shard of which it has no key, so there are at most as many rows as different keys of groups, however many
groups and shards there are; and there are half as many shards as groups, so that a shard's keys don't grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Bytes of text in a group, on average.
GROUP_BYTES = 8_000_000
MAX_SHARD_BITS = 24
FIRST = -(2**63)


def grouped(docs: DataFrame, group: int | None = None, *more: Column) -> tuple[DataFrame, int]:
    """(grp, doc_id, text) for docs, null ids as FIRST with no_id and null texts as empty; and the number of bits of a shard.

    ``group`` deals out so many documents to a group, whatever their sizes, instead of GROUP_BYTES.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()
    n = max(1, -(-rows // group) if group else -(-size // GROUP_BYTES))
    out = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text_of().alias("text"), *more)
    return out.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), min(MAX_SHARD_BITS, max(3, (n // 2).bit_length()))


def spans(shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shards, in order, of keys that are in order of their shards; and where each one's keys begin, with the end."""
    present, begin = np.unique(shards, return_index=True)
    return present, np.concatenate([begin, [len(shards)]])


def binary(raw: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of raw, in one cell for each span."""
    return pa.array([raw[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.binary())


def answers(right: pa.Table, kind: int | None = None) -> list[dict]:
    """The answers to a group in order of the shards."""
    rows = [r for r in right.to_pylist() if kind is None or r["kind"] == kind]
    return sorted(rows, key=lambda r: r["shard"])
