"""Conflicts between sources: versions of a file, and metrics in differently dated exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Names of one metric.
ALIASES = {"revenue": "revenue", "sales": "revenue", "cost": "cost", "expense": "cost", "spend": "cost", "enrollment": "enrollment", "headcount": "enrollment", "withdrawal": "withdrawal", "attrition": "withdrawal", "churn": "withdrawal", "satisfaction": "satisfaction", "nps": "satisfaction", "score": "satisfaction"}


def canonical_metric(metric: Column) -> Column:
    """The metric with each word that has an alias replaced, plural or not; other words stay."""
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    words = F.split(F.regexp_replace(F.lower(metric), r"[^a-z0-9]+", "_"), "_")
    return F.array_join(F.transform(words, lambda w: F.coalesce(known[w], known[F.regexp_replace(w, "s$", "")], w)), "_")


def version_conflicts(sources: DataFrame) -> DataFrame:
    """Files of one stem whose names give different states."""
    g = sources.where("name_state is not null").groupBy("stem").agg(F.count_distinct("name_state").alias("states"), F.array_sort(F.collect_set("name")).alias("sources")).where("states > 1")
    return g.select(X.content_id("conflict", F.lit("version"), F.col("stem")).alias("conflict_id"), F.lit("version").alias("kind"), "sources", F.lit(None).cast("string").alias("metric"))


# Headers of a metric's name, of its value, of a date, and of what tells rows apart.
NAME_COLUMN, VALUE_COLUMN, DATE_COLUMN, KEY_COLUMN = r"^(metric|measure|name)$", r"^(value|amount|count|total)$", r"date|as_of", r"(^|_)(id|year|month|quarter|row|no)$"
_AMOUNT = r"^([-+(]?)\s*\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(%|percent|thousand|million|billion)?\)?$"


def canonical_value(value: Column) -> Column:
    """A number's one spelling, with its sign; a value that is no number stays, trimmed and in lower case."""
    text = F.lower(F.trim(value))
    sign = F.when(F.regexp_extract(text, _AMOUNT, 1).isin("-", "("), "-").otherwise("")
    number = X.canonical_number(F.regexp_extract(text, _AMOUNT, 2), F.regexp_extract(text, _AMOUNT, 3))
    return F.when(text.rlike(_AMOUNT), F.regexp_replace(F.concat(sign, number), r"^-0(%?)$", "0$1")).otherwise(text)


def metrics(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, name, metric, value, as_of) from exports, long or wide; the date is the row's, or the file's.

    Long exports have a column of metrics and one of values. In all others each column of numbers is a metric by its header,
    but dates and keys; and only if it has no more than one value for a date: rows of answers or customers are no series.
    """
    cells = facts.where("kind = 'cell' and ext in ('csv', 'tsv')").select("source_id", F.col("ordinal").alias("row"), F.regexp_extract("cell", "^([A-Z]+)", 1).alias("column"), "text")
    s = sources.where("role = 'data_export'").select("source_id", "name", "source_date")  # narrative files raise no metric conflicts
    head = cells.where("row = 1").select("source_id", "column", F.lower(F.trim("text")).alias("header"))
    named = cells.where("row > 1").join(head, ["source_id", "column"])
    pick = lambda pattern: F.max(F.when(F.col("header").rlike(pattern), F.col("text")))
    free = ~F.col("header").rlike(f"{NAME_COLUMN}|{VALUE_COLUMN}|{DATE_COLUMN}|{KEY_COLUMN}") & F.trim("text").rlike(_AMOUNT)
    wide = F.collect_list(F.when(free, F.struct(F.col("header").alias("metric"), F.col("text").alias("value"))))  # a row's cells
    rows = named.groupBy("source_id", "row").agg(pick(NAME_COLUMN).alias("metric"), pick(VALUE_COLUMN).alias("value"), pick(DATE_COLUMN).alias("day"), wide.alias("wide"))
    rows = rows.join(s, "source_id").withColumn("as_of", F.coalesce(F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date"), "source_date"))
    is_long = F.col("metric").isNotNull() & F.col("value").isNotNull()
    long = rows.where(is_long).select("source_id", "name", canonical_metric(F.col("metric")).alias("metric"), "value", "as_of")
    across = rows.where(~is_long).select("source_id", "name", "as_of", F.explode("wide").alias("w")).select("source_id", "name", canonical_metric(F.col("w.metric")).alias("metric"), "w.value", "as_of")
    once = across.groupBy("source_id", "metric", "as_of").agg(F.count("*").alias("n")).groupBy("source_id", "metric").agg(F.max("n").alias("n")).where("n = 1").select("source_id", "metric")
    return long.unionByName(across.join(once, ["source_id", "metric"], "left_semi").select(*long.columns))


def metric_conflicts(metrics: DataFrame) -> DataFrame:
    """Metrics on which exports disagree, with the exports that do.

    Exports disagree if they give a metric different numbers for one date; or different numbers for two dates that follow each other among all exports
    while no export has both: where one has, the change is the metric's own. Exports of equal numbers, however spelt, and
    one that carries another on to later dates therefore agree. Dates meet by windows over each metric's dates; no two exports are joined.
    """
    points = metrics.where("as_of is not null").select("metric", "as_of", "name", canonical_value(F.col("value")).alias("value")).distinct()
    dates = points.groupBy("metric", "as_of").agg(F.count_distinct("value").alias("values"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("name").alias("files"))
    same_day = points.join(dates.where("values > 1 and files > 1"), ["metric", "as_of"], "left_semi").select("metric", "name")
    along = Window.partitionBy("metric").orderBy("as_of")
    before = lambda c: F.lag(c).over(along)
    steps = dates.select("metric", "as_of", before("as_of").alias("since"), ((F.col("least") != before("least")) | (F.col("most") != before("most"))).alias("differs")).where("differs")
    own = Window.partitionBy("metric", "name").orderBy("as_of")
    attested = points.select("metric", "name", "as_of").distinct().withColumn("since", F.lag("as_of").over(own)).where("since is not null").select("metric", "as_of", "since").distinct()
    bare = steps.join(attested, ["metric", "as_of", "since"], "left_anti")
    ends = bare.select("metric", F.explode(F.array("as_of", "since")).alias("as_of")).distinct()
    apart = points.join(ends, ["metric", "as_of"], "left_semi").select("metric", "name")
    g = same_day.unionByName(apart).groupBy("metric").agg(F.array_sort(F.collect_set("name")).alias("sources")).where(F.size("sources") > 1)
    return g.select(X.content_id("conflict", F.lit("metric"), F.col("metric")).alias("conflict_id"), F.lit("metric").alias("kind"), "sources", "metric")


def conflicts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    return version_conflicts(sources).unionByName(metric_conflicts(metrics(facts, sources)))
