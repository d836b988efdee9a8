"""LM scoring with an Elias-Fano n-gram trie.

The model is an interpolated bigram model: p(w | u) = (max(c(u w) - D, 0) + (S + D t(u)) p(w)) / (c(u) + S), where t(u) is the number of
different successors of u and p(w) = (c(w) + 1) / (N + V + 1) is the base. Counts are of all training documents. Groups of documents
ask shards about their different words and each word's different successors, and tell how often their training documents have
them. A shard is the home of its words with all of their successors. It adds up what the groups tell, works out the smoothed
probabilities and the back-off weights, and writes them as its part of the trie: Elias-Fano words, monotone pointers, context-relative
successors, and quantised probabilities. That table is the model: a row for each shard, never whole in one place. To score, a task
maps its shard's levels from a file and finds each asked successor among those of its context; a group then puts its texts' scores together
from probabilities, back-off weights and the exact counts of words.

Words are compared by XXH64, successors of a word by 32 bits of it.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .elias_fano import Trie, dequantise
from .groups import answers, binary, grouped, spans

STRENGTH, DISCOUNT = 100.0, 0.0
#: What the query takes: a discount tells what was seen once from what was seen twice.
QUERY_STRENGTH, QUERY_DISCOUNT = 1.0, 0.75
#: Keys of what is no word: the end of a text, and what stands before its first word.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" ", b"  "))
ASKED = "shard long, grp long, words binary, counts binary, fans binary, successors binary, times binary"
MODEL = "shard long, trie binary"
ANSWERED = "grp long, shard long, counts binary, back_off binary, probability binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Keys(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = k = xxhash.xxh64_intdigest(word)
        return k


_KEYS = _Keys()


class _Group:
    """A group's tokens, its different words in order, and its different pairs of a word's place and a successor, in order."""

    def __init__(self, left: pa.Table, bits: int):
        self.grp, self.bits = left["grp"][0].as_py(), bits
        self.ids, self.held_out, self.no_id = (left[c].to_pylist() for c in ("doc_id", "held_out", "no_id"))
        keys, self.size = [np.array([START])], []
        for text in left["text"].to_pylist():
            words = text.encode("utf-8", "surrogatepass").lower().split()
            keys += [np.array([_KEYS[w] for w in words], np.uint64), np.array([END])]
            self.size.append(len(words) + 1)
        token = np.concatenate(keys)
        self.words, place = np.unique(token, return_inverse=True)
        self.word_of, before = place[1:], place[:-1].copy()
        before[np.cumsum([0, *self.size[:-1]])] = place[0]
        self.before, self.train = before, np.repeat(~np.array(self.held_out, bool), self.size)
        self.pairs, self.pair_of = np.unique(before.astype(np.uint64) << np.uint64(32) | token[1:] >> np.uint64(32), return_inverse=True)

    def ask(self) -> pa.Table:
        shard, begin = spans((self.words >> np.uint64(64 - self.bits)).astype(np.int64))
        context = (self.pairs >> np.uint64(32)).astype(np.int64)
        pair_begin = np.searchsorted(context, begin)
        count = lambda of, n: np.bincount(of[self.train], minlength=n).astype("<u4")
        return pa.table({
            "shard": pa.array(shard, pa.int64()),
            "grp": pa.array([self.grp] * len(shard), pa.int64()),
            "words": binary(self.words.astype("<u8"), begin),
            "counts": binary(count(self.word_of, len(self.words)), begin),
            "fans": binary(np.bincount(context, minlength=len(self.words)).astype("<u4"), begin),
            "successors": binary((self.pairs & np.uint64(0xFFFFFFFF)).astype("<u4"), pair_begin),
            "times": binary(count(self.pair_of, len(self.pairs)), pair_begin),
        })


def _all(asked: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(asked[name].to_pylist()), kind)


def _words(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's different words, each asked word's place among them, and their counts."""
    words, place = np.unique(_all(asked, "words", "<u8"), return_inverse=True)
    return words, place, np.bincount(place, _all(asked, "counts", "<u4"), len(words)).astype(np.int64)


def _pairs(asked: pa.Table, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's different pairs of a word's place and a successor, and each asked pair's place among them."""
    context = np.repeat(place, _all(asked, "fans", "<u4").astype(np.int64)).astype(np.uint64)
    return np.unique(context << np.uint64(32) | _all(asked, "successors", "<u4").astype(np.uint64), return_inverse=True)


def _totals(asked: pa.Table) -> pa.Table:
    _, _, count = _words(asked)
    return pa.table({"total": pa.array([int(count.sum())], pa.int64()), "different": pa.array([int((count > 0).sum())], pa.int64())})


def _built(asked: pa.Table, bits: int, strength: float, discount: float) -> pa.Table:
    """A shard's part of the trie, of what the training documents have."""
    words, place, count = _words(asked)
    pairs, pair_place = _pairs(asked, place)
    times = np.bincount(pair_place, _all(asked, "times", "<u4"), len(pairs))
    seen = times > 0
    pairs, times = pairs[seen], times[seen]
    context = (pairs >> np.uint64(32)).astype(np.int64)
    total = np.bincount(context, times, len(words)) + strength
    back_off = (strength + discount * np.bincount(context, minlength=len(words))) / np.maximum(total, 1e-300)
    trie = Trie.build(words & np.uint64((1 << 64 - bits) - 1), 1 << 64 - bits, count, np.where(total > strength, back_off, 1.0), context, pairs & np.uint64(0xFFFFFFFF), (times - discount) / total[context])
    return pa.table({"shard": asked["shard"][:1], "trie": pa.array([trie.tobytes()], pa.binary())})


def _answered(asked: pa.Table, model: pa.Table, bits: int) -> pa.Table:
    """Answers every group about its words and successors by the shard's levels, mapped from a scratch file without a name."""
    words, place = np.unique(_all(asked, "words", "<u8"), return_inverse=True)
    pairs, pair_place = _pairs(asked, place)
    with tempfile.TemporaryFile() as file:
        file.write(model["trie"][0].as_buffer())
        file.flush()
        trie = Trie.open(file)
    rank = trie.words.find(words & np.uint64((1 << 64 - bits) - 1))
    known = rank >= 0
    count, back_off = np.where(known, trie.counts[rank], 0).astype("<i8"), np.where(known, trie.back_off[rank], 1).astype("<u2")
    of = rank[(pairs >> np.uint64(32)).astype(np.int64)]
    probability, met = np.zeros(len(pairs), "<u2"), np.flatnonzero(of >= 0)
    probability[met] = trie.lookup(of[met], pairs[met] & np.uint64(0xFFFFFFFF))
    begin = lambda name, width: np.cumsum([0, *(len(x) // width for x in asked[name].to_pylist())])
    return pa.table({
        "grp": asked["grp"],
        "shard": asked["shard"],
        "counts": binary(count[place], begin("words", 8)),
        "back_off": binary(back_off[place], begin("words", 8)),
        "probability": binary(probability[pair_place], begin("successors", 4)),
    })


def _scored(left: pa.Table, right: pa.Table, bits: int) -> pa.Table:
    g, rows = _Group(left, bits), answers(right)
    n, v = rows[0]["total"], rows[0]["different"]
    read = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    of_word = read("counts", "<i8").astype(np.float64)[g.word_of]
    base = (of_word + 1) / (n + v + 1)
    prob = dequantise(read("probability", "<u2"))[g.pair_of] + dequantise(read("back_off", "<u2"))[g.before] * base
    cut = np.cumsum([0, *g.size[:-1]])
    add = lambda x: np.add.reduceat(x, cut)
    columns = {"n_tokens": np.array(g.size, np.int64), "n_known": add((of_word > 0).astype(np.int64)), "train_tokens": np.full(len(cut), n), "base_score": add(np.log10(base)), "score": add(np.log10(prob))}
    ids = pa.array([None if no else i for i, no in zip(g.ids, g.no_id)], pa.int64())
    return pa.table({"doc_id": ids, "held_out": pa.array(g.held_out, pa.bool_()), **{k: pa.array(x) for k, x in columns.items()}})


def score_texts(docs: DataFrame, held_out: Column, strength: float = STRENGTH, discount: float = DISCOUNT, group: int | None = None) -> DataFrame:
    """Scores every row of docs (doc_id, text) with a model of the rows for which the column ``held_out`` is false (see RESULT).

    A null text counts as empty and has one token, its end; very long texts are scored whole; repeated rows count as often as they
    appear, and rows without an id are scored and, unless held out, learnt from. With nothing to learn from, N and V are 0 and every
    word has probability 1. Other columns of docs are not used; an empty table gives no rows. ``group`` is as in grouped().
    """
    texts, bits = grouped(docs, group, held_out.alias("held_out"))
    asked = texts.groupBy("grp").applyInArrow(lambda t: _Group(t, bits).ask(), ASKED)
    by_shard = asked.groupBy("shard")
    model = by_shard.applyInArrow(lambda t: _built(t, bits, strength, discount), MODEL)
    totals = by_shard.applyInArrow(_totals, "total long, different long").agg(F.sum("total").alias("total"), F.sum("different").alias("different"))
    answered = by_shard.cogroup(model.groupBy("shard")).applyInArrow(lambda t, m: _answered(t, m, bits), ANSWERED).crossJoin(F.broadcast(totals))  # one row
    return texts.groupBy("grp").cogroup(answered.groupBy("grp")).applyInArrow(lambda t, a: _scored(t, a, bits), RESULT)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_texts over all documents, learning from those whose crc32 mod 7 is not 2; odd rows as stated there."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out, QUERY_STRENGTH, QUERY_DISCOUNT)
