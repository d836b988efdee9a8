"""Passages that stand in texts word for word, and where: automata over shards of the passages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of passages in one automaton, about; a longer passage is a shard of its own.
SHARD = 1 << 20
_made: dict[str, tuple[ahocorasick.Automaton | None, str | None]] = {}  # the automaton that a worker used last


def _automaton(name: str, passages: Broadcast) -> tuple[ahocorasick.Automaton | None, str | None]:
    """The automaton of a shard, and the key of the empty passage if it has that one."""
    if name not in _made:
        _made.clear()
        automaton, empty = ahocorasick.Automaton(), None
        for key, text in passages.value:
            if text:
                automaton.add_word(text, (key, len(text)))
            else:
                empty = key
        automaton.make_automaton()
        _made[name] = (automaton if len(automaton) else None, empty)
    return _made[name]


def _found(passages: Broadcast, keep: list[str]):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, empty = _automaton(name, passages)
        for batch in batches:
            rows, keys, begins, ends = [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                first = {empty: (0, 0)} if empty else {}
                for last, (key, size) in automaton.iter(text) if automaton is not None else ():
                    if key not in first:
                        first[key] = (last + 1 - size, last + 1)
                for key, (begin, end) in first.items():
                    rows.append(n)
                    keys.append(key)
                    begins.append(begin)
                    ends.append(end)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], pa.array(keys, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], [*keep, "_key", "begin", "end"])

    return run


def quoted(texts: DataFrame, passages: DataFrame, shard: int = SHARD) -> DataFrame:
    """Each row of texts (text, ...) with each passage of ``passages`` (passage_id, text) that stands in it, and the first place: ``begin`` and
    ``end`` in characters, the end exclusive. The text itself isn't returned.

    All passages of a shard are looked for in one pass over a text; texts are scanned once for a shard, and stay where they are. What a
    task and the driver hold is a shard's passages, however many there are altogether. Equal passages are looked for once.
    Null texts and passages match nothing; the empty passage stands at the beginning of every text.
    """
    spark = texts.sparkSession
    some = passages.where("text is not null").select(F.sha2("text", 256).alias("_key"), "text")
    size = some.groupBy("_key").agg(F.max(F.length("text")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard))
    keep = [c for c in texts.columns if c != "text"]
    kinds = ", ".join([f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep] + ["_key string", "begin long", "end long"])
    parts = []
    for k in range(shards):
        mine = some.where(F.pmod(F.xxhash64("_key"), F.lit(shards)) == k).distinct()
        held = spark.sparkContext.broadcast([(r["_key"], r["text"]) for r in mine.collect()])  # about a shard's characters
        parts.append(texts.where("text is not null").select(*keep, "text").mapInArrow(_found(held, keep), kinds))
    ids = passages.where("text is not null").select("passage_id", F.sha2("text", 256).alias("_key"))
    return reduce(DataFrame.unionByName, parts).join(ids, "_key").select(*keep, "passage_id", "begin", "end")
