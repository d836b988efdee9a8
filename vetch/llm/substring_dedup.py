"""Substring dedup with difference-cover anchors.

Words that a repeated window of 50 words covers are removed. Only anchors are hashed at first: runs of 20 words that begin at
positions whose rest modulo 31 is in a perfect difference cover of six rests. For any two equal windows, wherever they stand, some
offset below 31 puts both on the cover, so they share an anchor. An anchor that stands in two documents makes the up
to 31 windows around it candidates; these are extended to their 50 words, and a window counts as repeated if the same
words start in a document with a smaller id. So the cover decides which windows are looked at, a fifth of the work and
traffic of hashing all of them, and whole windows decide what goes.

Anchors are compared by XXH64, which can only add candidates; windows by the 128 bits of XXH3, so that even among 10^12 windows a chance
match has odds of less than one in 10^14.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .groups import answers, binary, grouped, spans

WINDOW, PERIOD = 50, 31
#: A perfect difference cover: each rest modulo 31 but 0 is the difference of exactly one pair.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
ASKED = "shard long, grp long, keys binary, more binary, extra binary"
ANSWERED = "kind int, grp long, shard long, flags binary"
RESULT = "doc_id long, n_words long, removed array<struct<begin:long,end:long>>, kept string"


class _Doc:
    """A document's words, joined by single spaces, and where each begins and ends."""

    def __init__(self, text: str):
        self.words = text.encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)
        if self.n >= WINDOW:
            self.line = b" ".join(self.words)
            size = np.fromiter(map(len, self.words), np.int64, self.n)
            self.end = np.cumsum(size + 1) - 1
            self.begin = self.end - size

    def runs(self, at: np.ndarray, words: int) -> list[bytes]:
        line = self.line
        return [line[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at + words - 1].tolist())]


def _anchors(doc: _Doc) -> np.ndarray:
    last = doc.n - ANCHOR
    return np.sort(np.concatenate([np.arange(c, last + 1, PERIOD) for c in COVER]))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and each key's place among them. Keys have a column for each 64 bits, the first being the most significant."""
    if keys.shape[1] == 1:
        found, place = np.unique(keys[:, 0], return_inverse=True)
        return found[:, None], place
    order = np.lexsort(keys.T[::-1])
    ranked = keys[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def _ends(place: np.ndarray, rows: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's first and last row."""
    r = np.array(rows, np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, place, r)
    np.maximum.at(last, place, r)
    return first, last


class _Group:
    """A group of documents in order of their ids, and its questions."""

    def __init__(self, left: pa.Table):
        left = left.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = left["doc_id"].to_pylist()
        self.no_id = left["no_id"].to_pylist()
        self.grp = left["grp"][0].as_py()
        self.docs = [_Doc(t) for t in left["text"].to_pylist()]
        self.long = [k for k, d in enumerate(self.docs) if d.n >= WINDOW]

    def find_anchors(self) -> None:
        keys, rows, self.at = [], [], {}
        for k in self.long:
            at = _anchors(self.docs[k])
            self.at[k] = at
            keys += map(xxhash.xxh64_intdigest, self.docs[k].runs(at, ANCHOR))
            rows += [k] * len(at)
        self.anchors, self.anchor_of = _distinct(np.array(keys, np.uint64)[:, None])
        first, last = _ends(self.anchor_of, rows, len(self.anchors))
        self.many = first != last

    def find_windows(self, shared: np.ndarray) -> None:
        flag, pos, keys, rows, self.starts = shared[self.anchor_of] if len(self.anchor_of) else shared, 0, [], [], {}
        for k in self.long:
            at, doc = self.at[k], self.docs[k]
            hit = at[flag[pos : pos + len(at)]]
            pos += len(at)
            if not len(hit):
                continue
            last = doc.n - WINDOW
            edge = np.zeros(last + 2, np.int32)
            low, high = np.maximum(0, hit - PERIOD + 1), np.minimum(hit, last)
            np.add.at(edge, low[low <= high], 1)
            np.add.at(edge, high[low <= high] + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if len(starts):
                self.starts[k] = starts
                keys += map(xxhash.xxh3_128_digest, doc.runs(starts, WINDOW))
                rows += [k] * len(starts)
        self.windows, self.window_of = _distinct(np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2))
        first, _ = _ends(self.window_of, rows, len(self.windows))
        ids = np.array(self.ids, np.int64)
        self.owner = ids[first] if len(first) else np.zeros(0, np.int64)


def _spans(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return spans((keys[:, 0] >> np.uint64(64 - bits)).astype(np.int64))


def _ask(grp: int, keys: np.ndarray, bits: int, extra: np.ndarray) -> pa.Table:
    """A row for each shard of which the group has keys."""
    shard, begin = _spans(keys, bits)
    more = keys[:, 1] if keys.shape[1] > 1 else np.zeros(0, np.uint64)
    return pa.table({
        "shard": pa.array(shard, pa.int64()),
        "grp": pa.array([grp] * len(shard), pa.int64()),
        "keys": binary(keys[:, 0].astype("<u8"), begin),
        "more": binary(more.astype("<u8"), begin if len(more) else 0 * begin),
        "extra": binary(extra, begin),
    })


def _flags(rows: list[dict], keys: np.ndarray, bits: int) -> np.ndarray:
    counts = np.diff(_spans(keys, bits)[1])
    parts = [np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=int(c)) for r, c in zip(rows, counts, strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _answer(kind: int, asked: pa.Table, flags_of) -> pa.Table:
    """flags_of(place of each asked key among the different ones, their number, the groups' extras) flags each asked key; the flags go back to the groups."""
    size = [len(x) // 8 for x in asked["keys"].to_pylist()]
    column = lambda name, kind: np.frombuffer(b"".join(asked[name].to_pylist()), kind)
    keys = [column("keys", "<u8"), column("more", "<u8")]
    found, place = _distinct(np.stack([k for k in keys if len(k)], axis=1) if size else np.zeros((0, 1), np.uint64))
    flags = flags_of(place, len(found), asked["extra"].to_pylist())
    cuts = np.cumsum(size)[:-1]
    return pa.table({"kind": pa.array([kind] * len(size), pa.int32()), "grp": asked["grp"], "shard": asked["shard"], "flags": pa.array([np.packbits(f).tobytes() for f in np.split(flags, cuts)], pa.binary())})


def _shared(place: np.ndarray, n: int, extra: list[bytes]) -> np.ndarray:
    """Whether a key is another group's too, or several documents' of one group."""
    many = np.frombuffer(b"".join(extra), np.uint8)
    return ((np.bincount(place, minlength=n) > 1) | (np.bincount(place, many, n) > 0))[place]


def _older(place: np.ndarray, n: int, extra: list[bytes]) -> np.ndarray:
    """Whether a key's smallest document is smaller than the group's smallest with that key."""
    own = np.frombuffer(b"".join(extra), "<i8")
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, place, own)
    return least[place] < own


def dedup_substrings(docs: DataFrame, group: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): its words, the ranges [begin, end) of removed words, and the kept words joined by a space.

    Windows are judged on the input. A null text has no words; texts under 50 words lose none. Rows without an id count as
    smaller than all others and not as each other's smaller; repeated rows don't make each other smaller, so they are treated
    alike. Other columns of docs are not used; an empty table gives no rows. ``group`` is as in grouped().
    """
    texts, bits = grouped(docs, group)

    def ask_anchors(left: pa.Table) -> pa.Table:
        g = _Group(left)
        g.find_anchors()
        return _ask(g.grp, g.anchors, bits, g.many.astype(np.uint8))

    def windows_of(left: pa.Table, right: pa.Table, kind: int | None = None) -> _Group:
        g = _Group(left)
        g.find_anchors()
        g.find_windows(_flags(answers(right, kind), g.anchors, bits))
        return g

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        g = windows_of(left, right)
        return _ask(g.grp, g.windows, bits, g.owner.astype("<i8"))

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        g = windows_of(left, right, 0)
        older, pos, out = _flags(answers(right, 1), g.windows, bits), 0, []
        for k, doc in enumerate(g.docs):
            removed, kept = [], doc.words
            if k in g.starts:
                starts = g.starts[k]
                of = g.window_of[pos : pos + len(starts)]
                pos += len(starts)
                gone = starts[older[of] | (g.owner[of] < g.ids[k])]
                edge = np.zeros(doc.n + 1, np.int32)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + WINDOW, -1)
                covered = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
                removed = [{"begin": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])]
                kept = [w for w, c in zip(doc.words, covered.tolist()) if not c]
            out.append((None if g.no_id[k] else g.ids[k], doc.n, removed, b" ".join(kept).decode("utf-8", "surrogatepass")))
        ids, n, removed, kept = zip(*out)
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "removed": pa.array(removed, pa.list_(span)), "kept": pa.array(kept, pa.string())})

    asked = texts.groupBy("grp").applyInArrow(ask_anchors, ASKED)
    shared = asked.groupBy("shard").applyInArrow(lambda t: _answer(0, t, _shared), ANSWERED)
    asked = texts.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(ask_windows, ASKED)
    older = asked.groupBy("shard").applyInArrow(lambda t: _answer(1, t, _older), ANSWERED)
    both = shared.unionByName(older)
    return texts.groupBy("grp").cogroup(both.groupBy("grp")).applyInArrow(cut_out, RESULT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_substrings over all documents; odd rows as stated there."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["begin"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
