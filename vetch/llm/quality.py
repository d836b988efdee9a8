"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are the words (A-Z in lower case), the words' shapes, and pairs of neighbours of either, hashed to 2^18 weights; a shape
keeps a word's marks and its kinds of letters and digits, and a word that repeats its neighbour makes a pair of its own
kind. A feature's value is its share of the document's words, so a score is a sparse dot product, summed word by word.

Training reads a bounded sample of labelled rows, dealt out to SHARDS groups. Each group runs FTRL over its rows, and the
groups' weights are averaged; the averaged weights, at most 2^18 numbers, go to every scoring task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

BITS = 18
MASK = (1 << BITS) - 1
#: At most so many labelled rows are used to fit; with more, those with the smallest hash of the id.
MAX_TRAIN, SHARDS, EPOCHS = 24_000, 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-4
SCALE = 8.0
#: Words that a worker remembers.
REMEMBERED = 100_000
_KINDS = bytes(ord("a") if 97 <= c < 123 or c >= 128 else ord("A") if 65 <= c < 91 else ord("0") if 48 <= c < 58 else c for c in range(256))


class _Words(dict):
    """For each word its number and that of its shape; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        kinds = word.translate(_KINDS)
        shape = bytes(c for k, c in enumerate(kinds) if not k or kinds[k - 1] != c)[:12]
        self[word] = x = (xxhash.xxh32_intdigest(word.lower(), 1), xxhash.xxh32_intdigest(shape, 2))
        return x


_WORDS = _Words()


def features(text: str | None) -> np.ndarray:
    """The places of the text's features among the weights, once for each occurrence."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int64)
    ids = np.array([_WORDS[w] for w in words], np.int64)
    word, shape = ids[:, 0], ids[:, 1]
    again = word[1:] == word[:-1]
    pair = np.where(again, 77, word[1:] * 31 + word[:-1] * 17 + 3)
    shapes = shape[1:] * 37 + shape[:-1] * 19 + again * 101 + 5
    return np.concatenate([x ^ (x >> 15) for x in (word, shape, pair, shapes)]) & MASK


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over rows (places, values, label)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for i, x, y in rows:
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30)))
            g = (p - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
            gb = p - y
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * bias
            nb += gb * gb
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, bias


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Averaged weights and bias from labelled rows (doc_id, text, label): a bounded number of them."""

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("order")
        rows = []
        for text, label in zip(group["text"].to_pylist(), group["label"].to_pylist()):
            f = features(text)
            i, c = np.unique(f, return_counts=True)
            rows.append((i.astype(np.int32), (SCALE * c / max(1, len(f))).astype(np.float32), label))
        w, bias = ftrl(rows)
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array([*at.tolist(), -1], pa.int64()), "weight": pa.array([*w[at].tolist(), bias], pa.float64()), "shard": pa.array([group["shard"][0].as_py()] * (len(at) + 1), pa.int64())})

    rows = labelled.select("text", "label", F.xxhash64("doc_id", "text").alias("order"), F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard"))
    parts = rows.groupBy("shard").applyInArrow(fit, "place long, weight double, shard long")
    # Added up in the order of the shards, so that reruns agree; at most 2 ** BITS + 1 rows come to the driver.
    total = F.aggregate(F.sort_array(F.collect_list(F.struct("shard", "weight"))), F.lit(0.0), lambda a, x: a + x["weight"])
    found = parts.groupBy("place").agg(total.alias("weight"), F.count("*").alias("n")).toArrow()
    place, weight, n = (found[c].to_numpy() for c in ("place", "weight", "n"))
    weights, biases = np.zeros(1 << BITS), place < 0
    weights[place[~biases]] = weight[~biases]
    bias, shards = float(weight[biases].sum()), max(1, int(n[biases].sum()))
    return weights / shards, bias / shards


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_TRAIN) -> DataFrame:
    """The labelled documents to learn from: of those whose crc32(doc_id) mod 3 is not 1, at most ``bound`` by smallest hash of the id."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    few = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(few), "doc_id")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def scorer(spark: SparkSession, weights: np.ndarray, bias: float):
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        for texts in batches:
            out = np.zeros(len(texts))
            for k, text in enumerate(texts):
                f = features(text)
                out[k] = b + (SCALE * float(w[f].sum(dtype=np.float64)) / len(f) if len(f) else 0.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score


def classify(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs with held_out, score and predicted (replacing columns of these names).

    A document's score depends on its text alone; null and empty texts get the bias's score. Where there is no label to learn
    from, every score is 0.5. Rows without a doc_id are scored but not held out and not learnt from; a document with several
    labels counts with the largest. Repeated rows are scored alike.
    """
    weights, bias = train(training_rows(docs, labels, bound=bound))
    score = scorer(docs.sparkSession, weights, bias)
    out = docs.withColumn("held_out", held_out()).withColumn("score", score(text_of()))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify over all documents; odd rows as stated there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
