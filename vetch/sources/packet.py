"""A packet of source files as tables: one row for each file, one for each fact that inspecting it finds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import delimited as D
from .office import facts

FACTS = "source_id string, name string, ext string, bytes long, sha256 string, inspection string, kind string, page int, ordinal int, sheet string, cell string, text string, formula string"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under the folder: path, source_id, name, ext, bytes, sha256, content. The name is the path below the folder; the id is of name and content.

    Files of no bytes are not there: Spark's reader leaves them out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString().rstrip("/") + "/"
    path = F.col("_metadata.file_path")
    plain = lambda uri: F.regexp_replace(uri, "^([a-z0-9]+):/+", "$1:/")
    below = F.when(F.startswith(plain(path), plain(F.lit(root))), F.substring(plain(path), F.length(plain(F.lit(root))) + 1, F.length(path)))
    name = F.coalesce(below, F.regexp_replace(path, r"^.*/", ""))
    files = files.select(path.alias("path"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
    files = files.withColumn("ext", F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)))
    return files.withColumn("source_id", X.content_id("source", F.col("name"), F.col("sha256")))


def inspect(files: DataFrame, folder: str | None = None) -> DataFrame:
    """The facts of all files (see FACTS). A file without any has one row with a null kind, so none is lost; bytes go no further.

    With the folder that files are of, delimited ones are read from it in splits, not each by one task.
    """
    if folder is not None:
        apart = F.col("ext").isin(*D.MARKS)
        head = files.where(apart).select("path", "source_id", "name", "ext", "bytes", "sha256", F.lit("inspected").alias("inspection"))
        marked = [D.cells(D.records(D.lines(files.sparkSession, folder, ext), mark), mark) for ext, mark in D.MARKS.items()]
        found = marked[0].unionByName(marked[1])
        none = F.lit(None).cast("string")
        found = found.select("path", F.lit("cell").alias("kind"), F.lit(None).cast("int").alias("page"), F.col("row").cast("int").alias("ordinal"), none.alias("sheet"), "cell", F.col("value").alias("text"), none.alias("formula"))
        return inspect(files.where(~apart)).unionByName(head.join(found, "path", "left").drop("path"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples():
                how, found = facts(f.ext, bytes(f.content))
                head = (f.source_id, f.name, f.ext, f.bytes, f.sha256, how)
                rows = [head + x for x in found] or [head + (None,) * 7]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")], dtype=object)
                yield out.astype({"page": "Int32", "ordinal": "Int32", "bytes": "int64"})

    return files.select("source_id", "name", "ext", "bytes", "sha256", "content").mapInPandas(parse, FACTS)


def drafts(sources: DataFrame, names: list[str]) -> DataFrame:
    """sources with is_draft; an unknown name fails the run."""
    known = {r["name"] for r in sources.where(F.col("name").isin(names)).select("name").collect()} if names else set()
    if unknown := sorted(set(names) - known):
        raise ValueError(f"declared drafts that are not in the packet: {', '.join(unknown)}")
    return sources.withColumn("is_draft", F.col("name").isin(names) if names else F.lit(False))
