"""From raw documents to token ids in training order: each stage applies one operator of vetch.llm to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetch.llm.common import cut, table
from vetch.llm.exact_dedup import exact_groups
from vetch.llm.mixing import mix, training_order
from vetch.llm.pieces import tokenize
from vetch.llm.quality import classify
from vetch.llm.simhash_dedup import near_groups

#: Jaccard similarity of five-word shingles from which texts are near copies.
SIMILARITY = 0.8
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts get the bias's score, very long ones are scored whole, repeated rows alike; without labels every score is 0.5 and all
    stay. An empty table gives no rows; columns other than those of documents are left behind here and in every stage.
    """
    return classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; of ties one. Null texts count as empty, so one of them stays. An empty
    table gives no rows."""
    return exact_groups(docs).where("kept").select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by op7's fingerprints or by five-word shingles, the row with the smallest doc_id stays; of rows that
    share it, the one with the smallest hash of its text, and repeated rows of that. Rows without a doc_id stay. Null and empty texts are
    alike. An empty table gives no rows."""
    drop = near_groups(docs, similarity=SIMILARITY).where("not kept").select("doc_id", "text_id").distinct()
    return docs.withColumn("text_id", F.xxhash64(F.coalesce("text", F.lit("")))).join(drop, ["doc_id", "text_id"], "left_anti").select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in training order; documents that it doesn't take, such as those without a word,
    go. A document taken in part enters whole. Repeated rows are documents of their own; null sources are one source; an empty
    table gives no rows."""
    return training_order(mix(docs)).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as ids of SentencePiece pieces. Null and empty texts have none; very long texts are encoded whole; repeated rows alike; an
    empty table gives no rows."""
    return tokenize(docs).select("doc_id", "n_tokens", "token_ids")


STAGES = [("quality", quality), ("exact dedup", exact), ("simhash", near), ("mixing", mixture), ("sentencepiece", pieces)]
#: A classifier, XXH64 and the piece model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
