"""Delimited files in splits: Spark reads lines, and row numbers, quoted line ends and cells are worked out over all splits of a file.

A line either begins a record or stands inside a quoted cell that an earlier line opened. What a line does to that state depends on its own quotes
alone, so lines, and then splits, are composed by windows; only files in which a line leaves a quote open go through one by line.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKS = {"csv": ",", "tsv": "\t"}
BEGIN, INSIDE, QUOTE, PLAIN = range(4)


def lines(spark: SparkSession, folder: str, ext: str) -> DataFrame:
    """(path, split, pos, line) of all files with the extension under the folder; pos counts on within a split."""
    glob = "*." + "".join(f"[{c}{c.upper()}]" for c in ext)
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def _ends(line: Column, mark: str, inside: bool) -> Column:
    """1 if the line, begun inside or outside of a quoted cell, ends inside of one: a quote opens a cell only where the cell begins."""
    opens = lambda p: p.endswith(mark)

    def step(s: Column, p: Column) -> Column:
        """The state after piece p of the line and the quote that ends it."""
        fresh = F.when((s == BEGIN) & (p == ""), INSIDE).when((s == QUOTE) & (p == ""), INSIDE).when(opens(p), INSIDE).otherwise(PLAIN)
        return F.when(s == INSIDE, QUOTE).otherwise(fresh)

    pieces = F.split(line, '"', -1)
    state = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.lit(INSIDE if inside else BEGIN), step)
    return F.when(line.contains('"'), (state == INSIDE).cast("int")).otherwise(F.lit(int(inside)))


def _after(df: DataFrame, part: list[str], order: str, zero: str, one: str) -> DataFrame:
    """df with after0 and after1: the states after each row of its part, for either state before the first."""
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("swaps", F.sum(((F.col(zero) == 1) & (F.col(one) == 0)).cast("long")).over(upto))
    fixed = F.last(F.when(F.col(zero) == F.col(one), F.struct(F.col(zero).alias("to"), F.col("swaps").alias("swaps"))), ignorenulls=True).over(upto)
    df = df.withColumn("fixed", fixed)
    turned = lambda start: F.pmod(F.coalesce(F.col("fixed.to").cast("long"), F.lit(start).cast("long")) + F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0).cast("long")), F.lit(2)).cast("int")
    return df.withColumn("after0", turned(0)).withColumn("after1", turned(1)).drop("swaps", "fixed")


def records(lines: DataFrame, mark: str = ",") -> DataFrame:
    """(path, row, record) from lines (path, split, pos, line), whose pos has no gaps within a split; rows count from 1 in a file.

    A quote that nothing closes takes the rest of its file into one record, as the format has it. A byte order mark goes, and so does
    a carriage return before a line end. Empty lines are records. No lines give no rows.
    """
    known = lines.withColumn("e0", _ends(F.col("line"), mark, False))
    splits = known.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("e0").alias("open"))
    files = splits.groupBy("path").agg((F.max("open") == 1).alias("open"))
    plain = splits.drop("open").join(files.where("not open"), "path", "left_semi")
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = lines.join(plain.withColumn("offset", offset), ["path", "split"]).select("path", (F.col("offset") + F.col("pos") - F.col("first") + 1).alias("row"), F.col("line").alias("record"))

    spans = known.join(files.where("open"), "path", "left_semi").withColumn("e1", _ends(F.col("line"), mark, True))
    each = Window.partitionBy("path", "split").orderBy("pos")
    spans = _after(spans, ["path", "split"], "pos", "e0", "e1")
    for s in (0, 1):
        begins = (F.coalesce(F.lag(f"after{s}").over(each), F.lit(s)) == 0).cast("long")
        spans = spans.withColumn(f"row{s}", F.sum(begins).over(each.rowsBetween(Window.unboundedPreceding, 0)))
    whole = spans.groupBy("path", "split").agg(*[F.max_by(c, "pos").alias(c.replace("after", "z").replace("row", "r")) for c in ("after0", "after1", "row0", "row1")])
    chain = Window.partitionBy("path").orderBy("split")
    whole = _after(whole, ["path"], "split", "z0", "z1").withColumn("start", F.coalesce(F.lag("after0").over(chain), F.lit(0)))
    whole = whole.withColumn("offset", F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("r0")).otherwise(F.col("r1"))).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = spans.join(whole.select("path", "split", "start", "offset"), ["path", "split"])
    placed = placed.select("path", (F.col("offset") + F.when(F.col("start") == 0, F.col("row0")).otherwise(F.col("row1"))).alias("row"), F.struct("split", "pos", "line").alias("part"))
    long = placed.groupBy("path", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "\n").alias("record"))
    text = F.regexp_replace(F.when(F.col("row") == 1, F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record")), "\r$", "")
    return short.unionByName(long).withColumn("record", text)


def _letters(column: Column) -> Column:
    """A column's name, A to ZZZ, from its number, which counts from 0."""
    letter = lambda n: F.chr(F.lit(65) + n % 26)
    two, three = column >= 26, column >= 702
    second, third = F.floor(column / 26) - 1, F.floor((column - 702) / 676)
    return F.concat(F.when(three, letter(third)).otherwise(""), F.when(two, letter(second)).otherwise(""), letter(column))


#: Characters that stand for a mark between cells and for a quote out of place; a record that has them itself is read by the csv module.
PARTED, ASTRAY = "\x01", "\x02"


def _parted(record: Column, mark: str) -> Column:
    """The record with PARTED around its cells and their quotes resolved; with ASTRAY where a quote stands inside of an unquoted cell or after a
    quoted one has ended. Between marks put around the record, each piece outside of quotes is empty, for a quote of the cell, or goes from mark to mark."""
    outside = lambda p: F.when(p == "", '"').when(p.startswith(mark) & p.endswith(mark) & ~p.rlike("[\r\n]"), F.translate(p, mark, PARTED)).otherwise(ASTRAY)
    pieces = F.split(F.concat(F.lit(mark), record, F.lit(mark)), '"', -1)
    return F.array_join(F.transform(pieces, lambda p, k: F.when(k % 2 == 1, p).otherwise(outside(p))), "")


def cells(records: DataFrame, mark: str = ",") -> DataFrame:
    """(path, row, cell, value) from records (path, row, record); cells are named as in a sheet, an empty record has none.

    Records whose quotes stand where the format has them stay in Spark; only the others go through the csv module.
    """

    @F.pandas_udf("array<string>")
    def quoted(record: pd.Series) -> pd.Series:
        csv.field_size_limit(2**31 - 1)
        return record.map(lambda r: None if r is None else next(csv.reader(io.StringIO(r, newline="\n"), delimiter=mark), []))

    r = records.where("record <> ''").withColumn("has", F.col("record").contains('"')).withColumn("parted", F.when(F.col("has"), _parted(F.col("record"), mark)))
    whole = F.length(F.regexp_replace("record", '[^"]+', "")) % 2 == 0
    r = r.withColumn("odd", F.col("has") & ~(whole & ~F.col("parted").contains(ASTRAY) & ~F.col("record").rlike(f"[{PARTED}{ASTRAY}]")))
    inner = F.split(F.substring(F.col("parted"), F.lit(2), F.length("parted") - 2), PARTED, -1)
    fields = F.when(F.col("odd"), quoted(F.when(F.col("odd"), F.col("record")))).when(F.col("has"), inner).otherwise(F.split("record", F.lit(mark), -1))
    out = r.select("path", "row", F.posexplode(fields).alias("c", "value"))
    return out.select("path", "row", F.concat(_letters(F.col("c")), F.col("row").cast("string")).alias("cell"), "value")
