"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits. Of two that differ in at most 4 bits, one 32-bit half differs in at most 2. The anchors of a half are the
words of a covering code: the perfect Hamming code of 31 bits (covering radius 1) times one free bit. Two halves that differ in
at most 2 bits have a point between them that is within 1 of both, and an anchor lies within 1 of that point. So
each fingerprint is replicated to every anchor of either half within covering radius + 1 (at most 17 of 2^27 a half), and
any two linked fingerprints meet at an anchor. There they are compared on all 64 bits.

Only different fingerprints are replicated, so copies cost nothing. Of each anchor's fingerprints only a spanning forest of
links goes on. An anchor that more than BLOCK fingerprints reach is split into blocks, and each pair of blocks is a
group of its own: no task holds more than two blocks, and no comparison is left out.

Texts that are similar by their shingles meet by band keys. Each is first held against its key's smallest text, and what that and the fingerprints
link is one component from then on. In keys that still have texts of several components, every pair across components is looked at, again in
pairs of blocks: a task holds the shingles of two blocks and sends on the links of a forest, so no more rows than it has texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, skew_left_join, table, text_of
from .syncmers import _mixed

WORDS, SEED, THRESHOLD = 4, 42, 4
#: Shingles for similar texts, and the band keys by which these meet: each of the DEPTH smallest hashes under as many mixings.
SIMILAR_WORDS, BANDS, DEPTH = 5, 10, 3
#: Ids of texts that are sent to every task (16 MB of them) rather than shuffled.
SENT_IDS = 2_000_000
#: Fingerprints of one anchor that are compared in one group.
BLOCK = 2048
#: Shingles of a block of texts that share a key, on average; a text with more is a block by itself.
SHINGLES = 1 << 18


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of the text; of the whole sequence where it has too few words; none where it has no word."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(w) - words + 1].tolist()
    hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begin, end[words - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash as a signed 64-bit number: a bit is 1 if it is set in over half of the shingles' hashes."""
    h = shingle_hashes(text or "", words)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        part = h[k : k + 8192]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * votes > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(text)


def anchors(half: Column) -> Column:
    """Every anchor within 2 of a 32-bit half: the code words that the half, or it with one bit changed, decodes to."""
    word = half.bitwiseAND(F.lit(0x7FFFFFFF))
    free = half.bitwiseAND(F.lit(0x80000000))
    syndrome = F.lit(0)
    for b in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1)
        syndrome = syndrome.bitwiseOR(F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), b))

    def decoded(i: Column) -> Column:
        """The code word next to the word with bit i changed (0: none)."""
        rest = syndrome.bitwiseXOR(i)
        one = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), k - 1))
        return word.bitwiseXOR(one(i)).bitwiseXOR(one(rest))

    near = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: decoded(i).bitwiseOR(free))
    far = decoded(F.lit(0)).bitwiseOR(free.bitwiseXOR(F.lit(0x80000000)))
    return F.array_distinct(F.concat(near, F.array(far)))


def forest(points: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs within the threshold connect: each point is compared with those not yet reached."""
    links, left = [], points.view(np.uint64)  # of a signed number, bitwise_count would take the absolute value
    if len(left) == 2:
        return [(int(points[0]), int(points[1]))] if int(np.bitwise_count(left[0] ^ left[1])) <= threshold else []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= threshold
            if near.any():
                met, left = left[near], left[~near]
                links += [(int(x.view(np.int64)), int(y)) for y in met.view(np.int64)]
                queue += list(met)
    return links


def links(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among the different fingerprints (fp): enough to connect all that pairs within the threshold connect."""
    if threshold > 5:
        raise ValueError("the code covers thresholds up to 5")
    half = lambda k: F.transform(anchors(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) if k == 0 else F.shiftrightunsigned("fp", 32)), lambda a: F.shiftleft(a, 1).bitwiseOR(F.lit(k)))
    sent = prints.select("fp", F.explode(F.concat(half(0), half(1))).alias("anchor"))
    reach = sent.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    sent = sent.join(reach, "anchor").withColumn("blocks", F.ceil(F.col("n") / block))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    sent = sent.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    groups = sent.groupBy("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_set("fp").alias("fps"))

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def linked(fps: pd.Series) -> pd.Series:
        return pd.Series([forest(np.sort(np.asarray(x, np.int64)), threshold) for x in fps])

    found = groups.where(F.size("fps") > 1).select(F.explode(linked("fps")).alias("l"))
    return found.select("l.a", "l.b")


def band_keys(h: np.ndarray) -> list[int]:
    """BANDS keys of a set of shingle hashes: two sets with Jaccard similarity s have one in common with probability s^DEPTH each."""
    if not len(h):
        return []
    keys = []
    for b in range(BANDS):
        least = [int(_mixed(h ^ np.uint64(0x9E3779B97F4A7C15 * (b * DEPTH + d + 1) & 2**64 - 1)).min()) for d in range(DEPTH)]
        keys.append(xxhash.xxh64_intdigest(np.array([b, *least], np.uint64).tobytes(), SEED) - 2**63)
    return keys


def jaccard(a: str, b: str, words: int) -> float:
    """The share of their different shingles that two texts have in common."""
    x, y = (np.unique(shingle_hashes(t, words)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def joining(comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places (k, l) of links that connect what the pairs of sets with that Jaccard similarity connect across components.

    Those with side -1 meet those with 1; those with 0 meet each other. Sets hold each shingle once; an inverted index counts what a set
    has in common with all others at a time.
    """
    size = np.array([len(x) for x in sets])
    _, number, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(number, kind="stable")]
    end = np.cumsum(holders)
    begin, at = end - holders, np.cumsum(size) - size
    root = np.unique(comp, return_inverse=True)[1]
    places, links = np.arange(len(sets)), []
    for k in np.flatnonzero(side <= 0).tolist():
        others = (root != root[k]) & ((side > 0) if side[k] else (places > k))
        if not others.any():
            continue
        mine = number[at[k] : at[k] + size[k]]
        mine = mine[holders[mine] > 1]
        held = [owner[a:b] for a, b in zip(begin[mine].tolist(), end[mine].tolist())]
        both = np.bincount(np.concatenate(held), minlength=len(sets)) if held else np.zeros(len(sets), np.int64)
        for x in np.flatnonzero(others & (both / np.maximum(1, size[k] + size - both) >= similarity)).tolist():
            if root[x] != root[k]:
                links.append((k, x))
                root[root == root[x]] = root[k]
    return links


def _marked(text: Column, words: int) -> Column:
    """The fingerprint of a text and its band keys, struct<fp, bands>."""

    @F.pandas_udf("fp long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        similar = [shingle_hashes(t, SIMILAR_WORDS) for t in texts]
        return pd.DataFrame({"fp": [fingerprint(t, words) for t in texts], "bands": [band_keys(h) for h in similar]})

    return of(text)


def shared_keys(marked: DataFrame) -> DataFrame:
    """(fp, id, band, hub, copies) for each text of marked (text_id, fp, bands) and each of its keys of which it isn't the smallest text, hub."""
    sent = marked.select("fp", F.col("text_id").alias("id"), F.explode("bands").alias("band"))
    hubs = sent.groupBy("band").agg(F.min(F.struct("id", "fp")).alias("hub"), F.max("id").alias("last"), F.count("*").alias("copies")).where("hub.id < last").select("band", "hub", "copies")
    met = skew_left_join(sent, cut(hubs), ["band"], "copies", "id").where("id <> hub.id")
    return cut(met.select("fp", "id", "band", "hub", "copies"))


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is one of the ids, which are sent to every task while they are few enough, and shuffled beyond that."""
    ids = cut(ids.distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", "left_semi")


def similar_links(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among the fingerprints of pairs (fp, id, hub_fp, hub_id) whose texts in docs (text) are that similar by their shingles' Jaccard similarity.

    Texts of many pairs go as the hub: they come by skew_left_join. Texts that have no pair go no further than the scan while
    the ids of the others are few.
    """

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, SIMILAR_WORDS) >= similarity for x, y in zip(a, b)], dtype=bool)

    texts = docs.select(text_of().alias("text")).withColumn("id", F.xxhash64("text"))
    known = cut(_among(texts, pairs.select("id").union(pairs.select("hub_id"))).groupBy("id").agg(F.min("text").alias("text")))
    often = pairs.groupBy("hub_id").agg(F.count("*").alias("copies"))
    hub_texts = cut(often.join(known.select(F.col("id").alias("hub_id"), F.col("text").alias("hub_text")), "hub_id"))
    both = skew_left_join(pairs.join(known, "id"), hub_texts, ["hub_id"], "copies", "id")
    return both.where(alike("text", "hub_text")).select(F.col("fp").alias("a"), F.col("hub_fp").alias("b"))


def _shingle_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, n, shingles) for the texts of docs with one of the ids: their different shingles' hashes, eight bytes each, and how many."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, SIMILAR_WORDS)).tobytes() for t in texts], dtype=object)

    texts = _among(docs.select(text_of().alias("text")).withColumn("id", F.xxhash64("text")), ids).groupBy("id").agg(F.min("text").alias("text"))
    return cut(texts.select("id", of("text").alias("shingles"))).withColumn("n", F.octet_length("shingles") / 8)


def across(met: DataFrame, prints: DataFrame, comp: DataFrame, docs: DataFrame, similarity: float, block: int) -> DataFrame | None:
    """Links (a, b) among the fingerprints of texts that share a key and lie in different components (fp, component): enough to connect all that
    pairs of them with that Jaccard similarity connect; None if no key has texts of several components. Pairs with a key's smallest text have been looked at.

    The texts of a key's largest component, at home there, meet the others, and these meet each other: where few are
    not at home, each text at home is sent once. ``block`` is in shingles.
    """
    placed = cut(prints.join(comp, "fp").select("fp", "component", "copies"))
    texts = met.where("copies > 2").groupBy("band", "id").agg(F.min("fp").alias("fp"))
    texts = cut(skew_left_join(texts, placed, ["fp"], "copies", "id").select("band", "id", "fp", F.coalesce("component", "fp").alias("comp")))
    sizes = texts.groupBy("band", "comp").agg(F.count("*").alias("n"))
    keys = cut(sizes.groupBy("band").agg(F.max(F.struct("n", "comp"))["comp"].alias("home"), F.sum("n").alias("copies"), F.count("*").alias("comps")).where("comps > 1").drop("comps"))
    if keys.isEmpty():
        return None
    texts = cut(skew_left_join(texts, keys, ["band"], "copies", "id").where("home is not null").select("band", "id", "fp", "comp", (F.col("comp") == F.col("home")).alias("at_home")))
    sets = _shingle_sets(texts.select("id"), docs)
    blocks = lambda at_home: F.ceil(F.sum(F.when(F.col("at_home") == at_home, F.col("n"))) / block)
    sized = texts.join(sets.select("id", "n"), "id").groupBy("band").agg(blocks(True).alias("homes"), blocks(False).alias("strays"), F.count("*").alias("copies"))
    texts = skew_left_join(texts, cut(sized), ["band"], "copies", "id").select("band", "id", "fp", "comp", "at_home", "homes", "strays")
    texts = texts.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("at_home"), F.col("homes")).otherwise(F.col("strays")))).join(sets.select("id", "shingles"), "id")

    def dealt(rows: DataFrame, to: str, kind: int, i: Column, j: Column, side: Column) -> DataFrame:
        """The rows, once for each block of those they meet."""
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1)))
        return rows.select("band", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.struct("fp", "comp", side.cast("long").alias("side"), "shingles").alias("row"))

    m, o, strays = F.col("mine"), F.col("other"), texts.where("not at_home")
    sent = dealt(strays, "strays", 0, F.least(m, o), F.greatest(m, o), F.signum(m - o))
    sent = sent.unionByName(dealt(strays, "homes", 1, m, o, F.lit(-1))).unionByName(dealt(texts.where("at_home"), "strays", 1, o, m, F.lit(1)))
    groups = sent.groupBy("band", "kind", "i", "j").agg(F.collect_list("row").alias("rows")).where(F.size("rows") > 1)

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def linked(fps: pd.Series, comps: pd.Series, sides: pd.Series, shingles: pd.Series) -> pd.Series:
        out = []
        for fp, c, side, raw in zip(fps, comps, sides, shingles):
            pairs = joining(np.asarray(c), np.asarray(side), [np.frombuffer(x, np.uint64) for x in raw], similarity)
            out.append([(int(fp[x]), int(fp[y])) for x, y in pairs])
        return pd.Series(out, dtype=object)

    found = groups.select(F.explode(linked("rows.fp", "rows.comp", "rows.side", "rows.shingles")).alias("l"))
    return cut(found.select("l.a", "l.b").distinct())


def near_groups(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """(doc_id, text_id, fp, component_id, kept) for each row of docs (doc_id, text): its fingerprint and the smallest doc_id that links
    reach; text_id is the XXH64 of its text.

    Null and empty texts and those without a word have fingerprint zero, which links like any other. Repeated rows appear
    as often as in docs. Rows without a doc_id join groups but name none: a group of such rows alone has a null component_id.
    ``kept`` marks what stays of a group: the rows with its smallest doc_id and, of these, the smallest text_id; and every row without a doc_id.
    Of docs nothing but doc_id and text is used; an empty table gives no rows. With ``similarity``, texts whose SIMILAR_WORDS-word
    shingles have that Jaccard similarity are linked too, as far as they share one of BANDS keys (at 0.8: 999 of 1000 pairs).
    """
    each = docs.select("doc_id", F.xxhash64(text_of()).alias("text_id"), (fingerprints(text_of(), words).alias("fp") if similarity is None else _marked(text_of(), words).alias("m")))
    marked = cut(each if similarity is None else each.select("doc_id", "text_id", "m.*"))
    rows = marked.select("doc_id", "text_id", "fp")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_id"))).alias("stays"), F.count("*").alias("copies")))
    found = links(prints.select("fp"), threshold, block)
    if similarity is not None:
        met = shared_keys(marked)
        pairs = cut(met.where("fp <> hub.fp").select("fp", "id", F.col("hub.fp").alias("hub_fp"), F.col("hub.id").alias("hub_id")).distinct())
        found = found.unionByName(similar_links(pairs, docs, similarity))
    comp = cut(components(found)).select(F.col("id").alias("fp"), "component")
    more = across(met, prints, comp, docs, similarity, block * (SHINGLES // BLOCK)) if similarity is not None else None
    if more is not None:
        comp = cut(components(comp.select(F.col("fp").alias("a"), F.col("component").alias("b")).unionByName(more))).select(F.col("id").alias("fp"), "component")
    member = prints.join(comp, "fp")
    smallest = member.groupBy("component").agg(F.min("first").alias("smallest"), F.min("stays").alias("stay"))
    member = member.join(smallest, "component").select("fp", "smallest", "stay")
    placed = cut(prints.join(member, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"), F.coalesce("stay", "stays").alias("_stays"), "copies"))
    out = skew_left_join(rows, placed, ["fp"], "copies", "text_id")
    kept = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("_stays.doc_id")) & (F.col("text_id") == F.col("_stays.text_id")))
    return out.select("doc_id", "text_id", "fp", "component_id", F.coalesce(kept, F.lit(True)).alias("kept"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_groups over all documents; odd rows as stated there."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
