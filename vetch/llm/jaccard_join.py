"""Joining texts by the Jaccard similarity of their shingles, with adaptive multi-match prefixes.

All shingles are put in one order, rare ones first. Two sets of which x misses at most |x| - a elements share at least l of the first
|x| - a + l elements of x and of the first as many of y, for every l. Each document chooses its own l: a longer prefix is met by more
others, but whoever is met has to share more of it. The choice minimises an estimate of the cost, postings to be read plus candidates
to be verified (at most postings / l), from how often its shingles occur. A pair is a candidate if it shares at
least the smaller l of both in the longer prefixes, so no link is lost.

Occurrences come from a sketch of 2^20 counters that one scan of all documents fills; it needs to tell only frequent
shingles apart, and its size doesn't grow with the corpus. Documents with the same set are one class from the start. A pair must also pass two exact
bounds before it goes on: of sizes, and of parity bitmaps (every element flips one bit of 512; bits that differ bound the
elements that differ). Shingles that more than BLOCK classes have in their prefixes are dealt into pairs of blocks.

Groups of near copies are drawn together first, each class with the nearest before it by bitmap; then
only pairs across components are left, of which none is left out. Every link is verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop_table, kept_table, skew_left_join, table, text_of
from .scan import CLASS, LOWER, mixed, portions, spans, texts, word_hashes

WORDS, PERCENT = 3, 90
#: Counters of the sketch, and the pieces in which it travels.
COUNTERS, SHARDS = 1 << 20, 64
#: Tasks whose counters are added up in one group.
ADDED = 1024
#: Bits of a parity bitmap.
BITS = 512
#: Largest l, and what a posting to send, a posting to read and a candidate to verify cost.
MOST_MATCHES, SEND, READ, VERIFY = 16, 8.0, 1.0, 64.0
#: Classes of one shingle that meet in one group, and groups whose pairs are all formed at once.
BLOCK, SMALL = 1024, 24
#: Rounds in which groups are drawn together before the rest of the pairs is formed.
ROUNDS = 1
#: Pairs of texts that are unpacked and compared at a time.
PAIRS = 64
#: Ids of texts that are sent to every task (16 MB of them) rather than shuffled.
SENT_IDS = 2_000_000
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The different shingles of each text as sorted 64-bit hashes; of fewer words the whole sequence as one; none without a word."""
    low = LOWER[raw]
    begin, end = spans(CLASS[low], at)
    h = word_hashes(low, begin, end)
    n = max(0, len(h) - words + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(words):
        runs += mixed(h[k : k + n] ^ _STEPS[k % len(_STEPS)]) * (_STEPS[k % len(_STEPS)] + np.uint64(2 * k))
    runs = mixed(runs)
    first = np.searchsorted(begin, at)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(h: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(h.tobytes())


def first_bits(sid: bytes) -> int:
    return int.from_bytes(sid[:8], "little", signed=True)


def bitmap(h: np.ndarray) -> bytes:
    """Bit b is the parity of how many elements fall on b."""
    odd = np.bincount((h >> np.uint64(40)) & np.uint64(BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    raw, at = texts(column)
    for i, j in portions(at):
        yield shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])


ROWS = "doc_id long, text_id long, sid binary, hi long, n int, bits binary, shard int, counts binary, task int"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and at the end of a partition the counters of its shingles, a row for each shard that has some."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
    counts, waiting, size = np.zeros(COUNTERS, np.int64), [], 0
    for batch in batches:
        sids, sizes, bits = [], [], []
        for sets in _sets(batch.column("text")):
            for h in sets:
                sids.append(set_id(h))
                sizes.append(len(h))
                bits.append(bitmap(h))
                waiting.append(h)
                size += len(h)
            if size > COUNTERS:
                counts += np.bincount(np.concatenate(waiting) & np.uint64(COUNTERS - 1), minlength=COUNTERS)
                waiting, size = [], 0
        none = [pa.nulls(len(sids), k) for k in kinds[6:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), *[pa.array(x, k) for x, k in zip((sids, [first_bits(x) for x in sids], sizes, bits), kinds[2:])], *none], names)
    if waiting:
        counts += np.bincount(np.concatenate(waiting) & np.uint64(COUNTERS - 1), minlength=COUNTERS)
    parts = [(k, p) for k, p in enumerate(counts.reshape(SHARDS, -1)) if p.any()]
    if parts:
        task = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=1)
        rows = [[k for k, _ in parts], [press.compress(p.astype("<i8").tobytes()) for _, p in parts], [task] * len(parts)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(parts), k) for k in kinds[:6]], *[pa.array(x, k) for x, k in zip(rows, kinds[6:])]], names)


def _summed(rows: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // SHARDS, np.int64)
    for blob in rows.column("counts"):
        total += np.frombuffer(zstandard.decompress(blob.as_buffer()), "<i8")
    return pa.table({"shard": rows.column("shard").slice(0, 1), "counts": pa.array([zstandard.compress(total.tobytes())], pa.binary()), "task": rows.column("task").slice(0, 1)})


def occurrences(described: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur beyond what an average counter holds; 8 MB, whatever the corpus."""
    parts = described.where("shard is not null").select("shard", "counts", "task")
    tasks = parts.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] + 1
    while tasks > 1:  # no more than ADDED tasks' counters in a group
        tasks = -(-tasks // ADDED)
        parts = parts.withColumn("task", F.col("task") % tasks).groupBy("shard", "task").applyInArrow(_summed, "shard int, counts binary, task int")
    found = np.zeros((SHARDS, COUNTERS // SHARDS), np.int64)
    for r in parts.collect():  # SHARDS rows
        found[r["shard"]] = np.frombuffer(zstandard.decompress(r["counts"]), "<i8")
    found = found.ravel().astype(np.float64)
    mean = found.mean()
    # What chance alone adds to an average counter isn't told apart from it.
    return np.maximum(0, found - mean - 4 * np.sqrt(mean)).astype(np.float32)


def prefix(h: np.ndarray, often: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The prefix that a set chooses by cost, and how many of its elements another must share (l)."""
    least = -(-percent * len(h) // 100)
    most = min(MOST_MATCHES, least)
    counts = often[h & np.uint64(COUNTERS - 1)]
    rank = np.ceil(np.log2(1 + counts)).astype(np.uint64)
    order = np.argsort((rank << np.uint64(58)) | (mixed(h) >> np.uint64(6)), kind="stable")[: len(h) - least + most]
    met = np.cumsum(1 + counts[order], dtype=np.float64)[len(h) - least :]
    matches = np.arange(1, most + 1)
    cost = SEND * matches + READ * met + VERIFY * met / matches
    best = int(cost.argmin()) + 1
    return h[order[: len(h) - least + best]], best


def _posted(often, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = often.value, set()
        for batch in batches:
            for sets in _sets(batch.column("text")):
                rows = []
                for h in sets:
                    key = set_id(h) if len(h) else None
                    if key is None or key in seen:
                        continue
                    if len(seen) > 1_000_000:  # what a task sends twice is found later
                        seen.clear()
                    seen.add(key)
                    rows.append((key, len(h), *prefix(h, table, percent)))
                if rows:
                    reps = [len(p) for _, _, p, _ in rows]
                    his = np.array([first_bits(k) for k, *_ in rows])
                    columns = [np.concatenate([p for _, _, p, _ in rows]).view(np.int64), np.repeat(his, reps), np.repeat([n for _, n, _, _ in rows], reps).astype(np.int32), np.repeat([m for *_, m in rows], reps).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "hi", "n", "l"])

    return run


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(x) + len(y) - both)


def _may_link(n, bits, x, y, percent: int):
    """Whether sizes and bitmaps leave it open that pairs (x, y) link; and in how many bits they differ."""
    differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=-1, dtype=np.int64)
    total = n[x] + n[y]
    return (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((100 + percent) * ((total - differ) // 2) >= percent * total), differ


def group_pairs(hi: np.ndarray, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, mine: np.ndarray, lone: bool, few: bool, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a large group's rows, of different components, that sizes and bitmaps leave open: all of one block (lone), or those across
    two; of these, for few, each row with the nearest that precedes it."""
    order = np.argsort(n, kind="stable")
    sizes, xs, ys = n[order], [], []
    for k, x in enumerate(order):
        first = np.searchsorted(sizes, -(-percent * int(n[x]) // 100), "left") if few else k + 1
        y = order[first : np.searchsorted(sizes, 100 * int(n[x]) // percent, "right")]
        y = y[(comp[y] != comp[x]) & (lone | (mine[y] != mine[x])) & ((hi[y] < hi[x]) | (not few))]
        if not len(y):
            continue
        ok, differ = _may_link(n, bits, x, y, percent)
        y, differ = y[ok], differ[ok]
        if few and len(y):
            y = y[[differ.argmin()]]
        xs.append(np.full(len(y), x))
        ys.append(y)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64),) * 2


def _candidates(few: bool, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("rows")
            at = groups.offsets.to_numpy()
            flat = groups.values
            hi, n, l_, comp, mine = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("hi", "n", "l", "comp", "mine"))
            packed = flat.field("bits")
            begin = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset] if len(packed) else 0
            bits = np.frombuffer(packed.buffers()[2], np.uint8)[begin : begin + len(packed) * (BITS // 8)].view(np.uint64).reshape(-1, BITS // 64) if len(packed) else np.zeros((0, BITS // 64), np.uint64)
            lone = (batch.column("i").to_numpy() == batch.column("j").to_numpy())
            size = np.diff(at)
            xs, ys = [], []
            for s in np.unique(size[size <= SMALL]).tolist():
                if s < 2:
                    continue
                of = np.flatnonzero(size == s)
                u, v = np.triu_indices(s, 1)
                x, y = (at[of][:, None] + u).ravel(), (at[of][:, None] + v).ravel()
                keep = (comp[x] != comp[y]) & (np.repeat(lone[of], len(u)) | (mine[x] != mine[y]))
                x, y = x[keep], y[keep]
                ok, _ = _may_link(n, bits, x, y, percent)
                xs.append(x[ok])
                ys.append(y[ok])
            for g in np.flatnonzero(size > SMALL):
                part = slice(at[g], at[g + 1])
                x, y = group_pairs(hi[part], n[part], bits[part], comp[part], mine[part], bool(lone[g]), few, percent)
                xs.append(x + at[g])
                ys.append(y + at[g])
            x, y = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (xs, ys))
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=-1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(hi[x], hi[y]), np.maximum(hi[x], hi[y]), np.minimum(l_[x], l_[y]), differ)], ["a", "b", "need", "differ"])

    return run


def candidates(shared: DataFrame, bits: DataFrame, few: bool, percent: int, block: int) -> DataFrame:
    """Pairs (a, b), a < b, of the first 64 bits of set ids, of different components, that may link: all, or few: for each b the nearest a.

    ``shared`` has the postings (token, hi, n, l, c, comp), bits the bitmaps (hi, bits).
    """
    blocks = F.ceil(F.col("c") / block)
    p = shared.join(bits, "hi").withColumn("mine", F.pmod(F.xxhash64("hi"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    groups = p.groupBy("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_set(F.struct("hi", "n", "l", "comp", "mine", "bits")).alias("rows"))
    pairs = groups.where(F.size("rows") > 1).select("i", "j", "rows").mapInArrow(_candidates(few, percent), "a long, b long, need long, differ long").where("a <> b")
    if few:
        return pairs.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("best")).select("best.a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")


def across(shared: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """The postings (see candidates) of shingles that several components have, with the component of each."""
    of = classes.join(comp, "sid", "left").select("hi", F.coalesce(F.xxhash64("component"), F.xxhash64("sid")).alias("comp"))
    placed = kept_table(shared.drop("comp").join(of, "hi"))
    several = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
    out = kept_table(placed.join(several, "token", "left_semi"))
    drop_table(placed)
    return out


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of set ids among the pairs, held against each other on their texts."""
    ids = classes.select("hi", "sid", "text_id")
    both = pairs.join(ids.select(F.col("hi").alias("a"), F.struct("sid", "text_id").alias("x")), "a").join(ids.select(F.col("hi").alias("b"), F.struct("sid", "text_id").alias("y")), "b")
    both = cut(both.select("x", "y"))
    wanted = cut(both.select("x.*").union(both.select("y.*")).distinct())
    ids = wanted.select("text_id").distinct()
    few = F.broadcast(ids) if wanted.count() <= SENT_IDS else ids
    found = docs.select(text_of().alias("text")).withColumn("text_id", F.xxhash64("text")).join(few, "text_id", "left_semi").groupBy("text_id", "text").agg(F.count("*").alias("copies"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for batch in batches:
            sids = [set_id(h) for sets in _sets(batch.column("text")) for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array([press.compress(x.as_buffer()) for x in batch.column("text").cast(pa.binary())], pa.binary())], ["sid", "zip"])

    known = found.select("text").mapInArrow(packed, "sid binary, zip binary").join(wanted.select("sid").distinct(), "sid").groupBy("sid").agg(F.min("zip").alias("zip"))
    known = cut(known)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, PAIRS):
                part = batch.slice(k, PAIRS)
                xs, ys = ([h for sets in _sets(pa.array([unpress.decompress(x.as_buffer()) for x in part.column(c)], pa.large_string())) for h in sets] for c in ("zip", "other"))
                yield part.select(["a", "b"]).filter(pa.array([alike(x, y, percent) for x, y in zip(xs, ys)], pa.bool_()))

    sides = both.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
    often = sides.groupBy("a").agg(F.count("*").alias("copies"))
    hubs = cut(often.join(known.select(F.col("sid").alias("a"), F.col("zip").alias("other")), "a"))
    met = skew_left_join(sides.join(known.select(F.col("sid").alias("b"), "zip"), "b"), hubs, ["a"], "copies", "b")
    return met.where("other is not null").select("a", "b", "zip", "other").mapInArrow(linked, "a binary, b binary")


def linked_groups(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): the size of its set, and the smallest doc_id that links reach.

    Null and empty texts and those without a word have empty sets and link with nothing, so their component is their own doc_id; texts of
    fewer than three words are one shingle. Rows with equal sets link, repeated rows among them. Rows without a doc_id join groups but name
    none: a group of such rows alone has a null component_id. Texts are whole, however long. An empty table gives no rows; other columns are
    not used. Shingles are told apart by 64 bits and sets by 128.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    described = kept_table(plain.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(_described, ROWS))
    rows = described.where("shard is null").select("doc_id", "text_id", "sid", "n")
    often = spark.sparkContext.broadcast(occurrences(described))
    classes = cut(described.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"), F.min("text_id").alias("text_id"), F.count("*").alias("copies"), F.first("hi").alias("hi"), F.first("bits").alias("bits")))
    sent = kept_table(plain.select("text").mapInArrow(_posted(often, percent), "token long, hi long, n int, l int"))
    reach = sent.groupBy("token").agg(F.count("*").alias("c"), F.min("hi").alias("x"), F.max("hi").alias("y")).where("x < y").select("token", "c")
    shared = kept_table(sent.join(reach, "token").withColumn("comp", F.col("hi")))
    drop_table(sent)
    bits, links, tried, comp = classes.select("hi", "bits"), None, None, None
    for few in [True] * ROUNDS + [False]:
        pairs = candidates(shared, bits, few, percent, block)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = cut(verified(pairs, classes, plain, percent))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        comp = cut(components(links).withColumnRenamed("id", "sid"))
        if few:
            rest = across(shared, classes, comp)
            drop_table(shared)
            shared = rest
    drop_table(shared)
    member = classes.join(comp, "sid")
    smallest = member.groupBy("component").agg(F.min("first").alias("smallest"))
    member = member.join(smallest, "component").select("sid", "smallest")
    placed = cut(classes.join(member, "sid", "left").select("sid", F.coalesce("smallest", "first").alias("component_id"), "copies"))
    out = skew_left_join(rows, placed, ["sid"], "copies", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linked_groups of all documents; odd rows as stated there."""
    return linked_groups(table(spark, sf_dir, "documents"))


ORACLE_OP12 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
