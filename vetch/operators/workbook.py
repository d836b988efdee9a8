"""Workbook checks: sheets, hidden sheets, headers, formulas, hardcodes, checks sheets, repeated formulas, repair packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: In a column with this share of formulas among its numbers, numbers typed in are hardcodes.
FORMULA_SHARE = 0.5
REPEATED = 3
#: Rows of a column that are looked through in one group.
BAND = 1 << 16
#: Cells of a packet to a task that looks for formulas.
TASK_CELLS = 1 << 18
# What to do about each kind of calculation risk.
REPAIRS = {"hardcode": ["Find the input the number stands for.", "Replace the number by a formula on that input.", "Recalculate and compare with the number."]}


def _cells(facts: DataFrame) -> DataFrame:
    cells = facts.where("ext = 'xlsx' and kind in ('cell', 'number')")
    return cells.select("source_id", "name", "sheet", F.col("ordinal").alias("row"), F.regexp_extract("cell", r"^([A-Z]+)", 1).alias("column"), "cell", "kind", F.col("text").alias("value"), "formula")


def sheets(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'sheet'").select("source_id", "name", "sheet", F.col("text").alias("state"), "ordinal")


def hidden_sheets(facts: DataFrame) -> DataFrame:
    return sheets(facts).where("state <> 'visible'")


def headers(facts: DataFrame) -> DataFrame:
    """The cells of each sheet's first row that has only words."""
    c = _cells(facts)
    words = c.groupBy("source_id", "sheet", "row").agg(F.min((F.col("kind") != "number") & F.col("formula").isNull()).alias("w")).where("w")
    first = words.groupBy("source_id", "sheet").agg(F.min("row").alias("row"))
    return c.join(first, ["source_id", "sheet", "row"]).select("source_id", "sheet", "row", "cell", F.col("value").alias("header"))


def formulas(facts: DataFrame) -> DataFrame:
    return _cells(facts).where("formula is not null")


def hardcodes(facts: DataFrame) -> DataFrame:
    """Numbers without a formula in columns of which formulas make up half or more."""
    c = _cells(facts).where("kind = 'number' or formula is not null")
    share = c.groupBy("source_id", "sheet", "column").agg(F.avg(F.col("formula").isNotNull().cast("double")).alias("share")).where(F.col("share") >= FORMULA_SHARE)
    return c.where("formula is null").join(share, ["source_id", "sheet", "column"])


def without_checks(facts: DataFrame) -> DataFrame:
    """Workbooks none of whose sheets is named like a check."""
    s = sheets(facts)
    return s.select("source_id", "name").distinct().join(s.where(F.lower("sheet").contains("check")), "source_id", "left_anti")


def repeated_formulas(facts: DataFrame) -> DataFrame:
    """Formulas that stand unchanged in three or more cells of a sheet."""
    f = formulas(facts).where("formula <> ''")
    return f.groupBy("source_id", "sheet", "formula").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("cell")).alias("cells")).where(F.col("n") >= REPEATED)


def nearest_formulas(numbers: DataFrame, formulas: DataFrame, band: int = BAND, tasks: int | None = None) -> DataFrame:
    """``numbers`` (source_id, sheet, column, row, ...) with ``suggested_input``: the formula of the nearest row of the column; of two rows
    as near the upper one, of several formulas in a row the least. Numbers of columns without a formula are left out.

    A column is cut into bands of rows. In a band, the formulas before and after a number are carried over it by windows; what
    lies beyond the band's ends comes with the last formula before it and the first after it, one row a band. So no number meets more
    than four formulas, and a long column is as many groups as it has bands. The bands are dealt out to ``tasks``.
    """
    key = ["source_id", "sheet", "column"]
    at = lambda df: df.withColumn("band", F.floor(F.col("row") / band))
    found = F.struct("row", "formula")
    f = at(formulas.select(*key, "row", "formula"))
    dealt = lambda df: df.repartition(tasks, *key, "band") if tasks else df
    # Smallest structs are found by sorting, so the formulas are dealt out first; what numbers add are bands without a formula.
    low = F.min(F.struct((-F.col("row")).alias("up"), "formula"))
    held = dealt(f).groupBy(*key, "band").agg(low.alias("low"), F.min(found).alias("first"))
    held = held.select(*key, "band", F.struct((-F.col("low.up")).alias("row"), F.col("low.formula").alias("formula")).alias("last"), "first")
    bands = held.unionByName(at(numbers.select(*key, "row")).select(*key, "band").distinct(), allowMissingColumns=True)
    bands = bands.groupBy(*key, "band").agg(F.max("last").alias("last"), F.max("first").alias("first"))
    along = lambda order: Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edges = bands.select(*key, "band", F.last("last", True).over(along("band")).alias("above"), F.last("first", True).over(along(F.desc("band"))).alias("below"))
    # Rows of both in one table; a formula's row is itself a candidate for numbers of its row.
    rows = at(numbers.drop("formula")).withColumn("formula", F.lit(None).cast("string")).withColumn("f", F.lit(None).cast(f.select(found.alias("x")).schema["x"].dataType))
    rows = dealt(rows.unionByName(f.withColumn("f", found), allowMissingColumns=True))
    # Both windows run from their beginning to the row, which Spark does in one pass; the second one runs upwards.
    inside = lambda *order: Window.partitionBy(*key, "band").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last("f", True).over(inside("row", F.col("f").isNull(), F.desc("formula")))
    after = F.last("f", True).over(inside(F.desc("row"), F.col("f").isNull(), F.desc("formula")))
    met = rows.withColumn("before", before).withColumn("after", after).where("f is null").join(edges, [*key, "band"], "left")
    near = F.filter(F.array("before", "after", "above", "below"), lambda x: x.isNotNull())
    best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(F.col("row") - x["row"]).alias("d"), x["row"].alias("row"), x["formula"].alias("formula"))))
    return met.withColumn("suggested_input", best["formula"]).where("suggested_input is not null").drop("band", "formula", "f", "before", "after", "above", "below")


def repair_packet(facts: DataFrame) -> DataFrame:
    """For each hardcode a checklist and a suggested input: the formula of the nearest row in the same column.

    The tasks grow with the cells, so what one of them sorts doesn't.
    """
    found = ["source_id", "name", "sheet", "cell", "value", "suggested_input"]
    tasks = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_cells(facts).count() // TASK_CELLS))
    numbers = hardcodes(facts).select("source_id", "name", "sheet", "column", "row", "cell", "value")
    near = nearest_formulas(numbers, formulas(facts), tasks=tasks).select(*found).repartition(tasks, "source_id", "sheet", "cell").distinct()
    return near.select("source_id", "name", "sheet", "cell", "value", F.array(*[F.lit(x) for x in REPAIRS["hardcode"]]).alias("checklist"), "suggested_input")
