"""The operators on plain tables: documents as sources or claims, benchmark passages as evidence, events as a decision log, orders as dated exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import claims as C
from ..operators import conflicts as K
from ..operators import decisions as D
from ..operators import findings as N
from ..operators import gate as G
from ..operators import legal as L
from ..operators import matching as M
from ..operators import quotes as Q
from . import packet_queries as PQ
from .run import source_diff

MUST, SHOULD = N.MUST, N.SHOULD


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _long(c) -> F.col:
    return c.cast("long")


def source_inventory(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", "source", _long(F.length("text")).alias("n_chars"), F.sha2("text", 256).alias("fingerprint"), X.number_bearing(F.col("text")).alias("number_bearing"))


def _lines(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    return d.select("doc_id", _long(F.col("pos") + 1).alias("line_no"), "line")


def line_anchors(spark, sf):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _lines(spark, sf).select("doc_id", "line_no", X.passage_id(name, F.col("line_no")).alias("passage_id"), _long(F.length("line")).alias("n_chars"))


def quote_hash(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", F.sha2("line", 256).alias("quote_hash"))


def _numbers(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.numbers(F.col("text")).alias("numbers"))


def number_tokens(spark, sf):
    return M.exploded(_numbers(spark, sf).withColumnRenamed("numbers", "number"), "number")


def number_overlap(spark, sf):
    """Every document whose id 100 divides, against all others."""
    n = _numbers(spark, sf)
    q = n.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return M.overlap(q, n, "query_id", "doc_id", "numbers", "number_overlap").where("query_id <> doc_id")


def number_bearing_undated(spark, sf):
    d = _t(spark, sf, "documents")
    return d.where(X.number_bearing(F.col("text")) & X.source_date(F.lit(""), F.col("text")).isNull()).select("doc_id")


def duplicate_versions(spark, sf):
    d = _t(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count("*").alias("versions"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return d.where("versions > 1")


def _claims(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.terms(F.col("text")).alias("terms"))


def _evidence(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", "text", X.terms(F.col("text")).alias("terms"))


def term_overlap(spark, sf):
    return M.overlap(_claims(spark, sf), _evidence(spark, sf), "doc_id", "item_id", "terms", "term_overlap")


def suggestions_topk(spark, sf):
    """The three best passages for each document, by shared terms and numbers; a passage's status goes by its number."""
    anchor = F.struct(F.lit("paragraph").alias("kind"))
    claims = _t(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.lit("draft").alias("source_id"), X.terms(F.col("text")).alias("terms"), X.numbers(F.col("text")).alias("numbers"))
    status = F.expr("CASE item_id % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'draft' ELSE 'unclear' END")
    evidence = _t(spark, sf, "benchmark").select(F.col("item_id").alias("evidence_id"), F.lit("benchmark").alias("source_id"), status.alias("status"), F.when(F.col("item_id") % 4 != 0, anchor).alias("anchor"), X.terms(F.col("text")).alias("terms"), X.numbers(F.col("text")).alias("numbers"))
    s = M.suggest(claims, evidence)
    return s.select(F.col("claim_id").alias("doc_id"), _long(F.col("rank")).alias("rank"), F.col("evidence_id").alias("item_id"), "term_overlap", "number_overlap", "confidence", "basis")


def quoted_support(spark, sf):
    """Passages that stand in a document word for word, and where they first do."""
    texts, passages = _t(spark, sf, "documents").select("doc_id", "lang", "text"), _t(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    return Q.quoted(texts, passages).select("doc_id", F.col("passage_id").alias("item_id"), "lang", "begin", "end")


def _support(spark, sf):
    return quoted_support(spark, sf).select(F.col("doc_id").alias("claim_id"), F.col("item_id").alias("source_id"), F.col("item_id").alias("evidence_id"), "lang")


def unsupported_claims(spark, sf):
    return C.unsupported(_t(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("claim_id")), _support(spark, sf)).select(F.col("claim_id").alias("doc_id"))


def claim_map(spark, sf):
    m = C.claim_map(_t(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), "text"), _support(spark, sf).withColumn("source_id", F.col("source_id").cast("string")).withColumn("evidence_id", F.lpad(F.col("evidence_id").cast("string"), 12, "0")))
    plain = F.transform("evidence", lambda x: x.cast("long").cast("string"))
    return m.select(F.col("claim_id").alias("doc_id"), F.size("evidence").cast("long").alias("n_evidence"), F.array_join(plain, ",").alias("evidence"))


def status_conflict(spark, sf):
    label = _t(spark, sf, "labels").select("doc_id", "quality")
    g = _t(spark, sf, "documents").select("doc_id", "source").join(label, "doc_id").groupBy("source").agg(F.count_distinct("quality").alias("states"), F.count("*").alias("labelled"))
    return g.where("states > 1")


def metric_conflict(spark, sf):
    """Order counts by priority and month: metrics whose values differ between dates, with their dated values."""
    o = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.date_format("o_orderdate", "yyyy-MM").alias("as_of")).agg(F.count("*").alias("value"))
    g = o.groupBy("metric").agg(F.count_distinct("as_of").alias("dates"), F.count_distinct("value").alias("values")).where("dates > 1 and values > 1")
    return o.join(g.select("metric"), "metric", "left_semi").select("metric", "as_of", "value")


def metric_alias(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy(K.canonical_metric(F.col("event_type")).alias("metric")).agg(F.count("*").alias("n"))


def findings_union(spark, sf):
    d = _t(spark, sf, "documents")
    label = _t(spark, sf, "labels").select("doc_id").distinct()
    location = F.concat(F.lit("source:"), F.col("doc_id").cast("string"))
    row = lambda df, rule, severity, issue: df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), location.alias("location"), F.lit(issue).alias("issue"))
    return N.union(
        row(number_bearing_undated(spark, sf), "undated_numbers", MUST, "Number-bearing source has no source date."),
        row(d.select("doc_id").join(label, "doc_id", "left_anti"), "unclear_status", SHOULD, "Source status is unclear."),
        row(d.where(F.col("text").rlike(N.RISKY)).select("doc_id"), "risky_claim", SHOULD, "Claim states an absolute."),
    )


def severity_counts(spark, sf):
    return G.counts(findings_union(spark, sf))


def readiness(spark, sf):
    return G.readiness(findings_union(spark, sf))


def review_queue(spark, sf):
    f = findings_union(spark, sf).withColumn("finding_id", F.md5(F.concat_ws("|", "rule_id", "location")))
    return G.review_queue(f).select("finding_id", "severity", "location", "issue")


def decision_state(spark, sf):
    """The latest event of each user counts, as the latest decision on a target does."""
    e = _t(spark, sf, "events").select(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("decision_id"), F.lit("claim").alias("target_kind"), F.col("user_id").alias("target_id"), F.col("event_type").alias("action"), F.col("ts").alias("at"))
    return D.latest(e, "claim").select(F.col("target_id").alias("user_id"), F.col("decision_id").cast("long").alias("event_id"), "action")


def generation_blockers(spark, sf):
    """The gate over documents as claims: quoted passages support them, each is its own source, and the labels of a source conflict."""
    d = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    undated = number_bearing_undated(spark, sf).withColumn("undated", F.lit(True))
    cited = quoted_support(spark, sf).select("doc_id").distinct().join(d, "doc_id").join(undated, "doc_id", "left")
    generated = cited.select(F.col("doc_id").cast("string").alias("generated_id"), F.array(F.lit("n")).alias("numbers"), F.when(F.col("undated").isNull(), F.lit("2025-01-01").cast("date")).alias("source_date"), F.lit(True).alias("selected"))
    conflict = status_conflict(spark, sf).select(F.col("source").alias("conflict_id"), F.array("source").alias("sources"))
    sources = _t(spark, sf, "documents").select(F.col("source").alias("name"), F.lit(True).alias("selected")).distinct()
    bare = C.unsupported(d.where("lang = 'en'").select(F.col("doc_id").cast("string").alias("claim_id")), _support(spark, sf).select(F.col("claim_id").cast("string").alias("claim_id")))
    return G.blockers(conflict, sources, generated, bare)


def refresh_diff(spark, sf):
    """Documents with even ids as the prior packet, odd ones as the new: contents that stayed, went or came."""
    d = _t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    part = lambda rest: d.where(F.pmod("doc_id", F.lit(2)) == rest).select(F.col("sha256").alias("name"), "sha256").distinct()
    return source_diff(part(0), part(1)).select(F.col("name").alias("fingerprint"), "change")


def reuse_by_boundary(spark, sf):
    """Quoted passages of reviewed documents within the run's boundary: the first language."""
    good = _t(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("target_id")).distinct()
    mapped = quoted_support(spark, sf).select(F.col("doc_id").alias("proposition_id"), F.col("item_id").alias("text"))
    return L.reuse_library(mapped, good, _t(spark, sf, "documents").select(F.col("lang").alias("boundary_key"))).select("boundary_key", "proposition_id", F.col("text").alias("item_id"))


NAMES = (
    suggestions_topk, source_inventory, line_anchors, quote_hash, number_tokens, number_overlap, number_bearing_undated, duplicate_versions, term_overlap, quoted_support,
    unsupported_claims, claim_map, status_conflict, metric_conflict, metric_alias, findings_union, severity_counts, readiness, review_queue, decision_state,
    generation_blockers, refresh_diff, reuse_by_boundary,
)


def queries():
    return {**{f.__name__: f for f in NAMES}, **PQ.queries()}


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_TERMS = rf"list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')), lambda t: length(t) >= {X.LEAST_TERM} AND NOT list_contains({_STOP}, t))"
_PLAIN = "coalesce(text, '')"
for _p in (X.CITE, X.ISO_DATE, X.LONG_DATE, X.MONTH_YEAR):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p}', ' ', 'g')"
_UNDATED = r"""(regexp_matches(text, '[0-9]') AND coalesce(
  try_strptime(nullif(regexp_extract(text, '(?i)(?:data as of|filed|compiled|source date:?|as of) (\d{4}-\d{2}-\d{2})', 1), ''), '%Y-%m-%d'),
  CASE WHEN regexp_matches(text, '(?m)\A[^\n]*(?:as_of|date)') THEN try_strptime(nullif(regexp_extract(text, '\b(\d{4}-\d{2}-\d{2})\b', 1), ''), '%Y-%m-%d') END) IS NULL)"""
_LINES = "l AS (SELECT doc_id, unnest(ls) AS line, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line_no FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents))"
_NUMBERS = rf"""n0 AS (SELECT doc_id, unnest(regexp_extract_all(p, '{X.NUMBER}', 1)) AS d, unnest(regexp_extract_all(p, '{X.NUMBER}', 2)) AS u FROM (SELECT doc_id, {_PLAIN} AS p FROM documents)),
n1 AS (SELECT *, TRY_CAST(replace(d, ',', '') AS DECIMAL(27,6)) AS v, CAST(CASE u WHEN 'thousand' THEN 1000 WHEN 'million' THEN 1000000 WHEN 'billion' THEN 1000000000 ELSE 1 END AS DECIMAL(10,0)) AS k FROM n0),
n AS (SELECT DISTINCT doc_id, coalesce(CASE WHEN contains(regexp_replace(CAST(v * k AS VARCHAR), '\.0+$', ''), '.') THEN regexp_replace(CAST(v * k AS VARCHAR), '\.?0+$', '') ELSE regexp_replace(CAST(v * k AS VARCHAR), '\.0+$', '') END, replace(d, ',', ''))
  || CASE WHEN u IN ('%', 'percent') THEN '%' ELSE '' END AS number FROM n1)"""
_OVERLAP = f"""c AS (SELECT doc_id, {_TERMS} AS terms FROM documents), e AS (SELECT item_id, {_TERMS} AS terms FROM benchmark),
o AS (SELECT doc_id, item_id, count(*) AS term_overlap FROM (SELECT doc_id, unnest(terms) AS t FROM c) JOIN (SELECT item_id, unnest(terms) AS t FROM e) USING (t) GROUP BY ALL)"""
_QUOTED = "q AS (SELECT d.doc_id, b.item_id, d.lang, instr(d.text, b.text) - 1 AS \"begin\", instr(d.text, b.text) - 1 + length(b.text) AS \"end\" FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
_STATES = "s AS (SELECT source, count(DISTINCT quality) AS states, count(*) AS labelled FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(DISTINCT quality) > 1)"
_FINDINGS = f"""f AS (
  SELECT 'undated_numbers' AS rule_id, 'must_fix' AS severity, 'source:' || doc_id AS location, 'Number-bearing source has no source date.' AS issue FROM documents WHERE {_UNDATED}
  UNION ALL SELECT 'unclear_status', 'should_fix', 'source:' || doc_id, 'Source status is unclear.' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'risky_claim', 'should_fix', 'source:' || doc_id, 'Claim states an absolute.' FROM documents WHERE regexp_matches(text, '{N.RISKY}'))"""
_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.ALIASES.items()) + "}"


def oracle_sql():
    return {
        **PQ.oracle_sql(),
        "suggestions_topk": f"""WITH {_OVERLAP}, {_NUMBERS}, {_NUMBERS.replace("n0", "k0").replace("n1", "k1").replace("n AS", "k AS").replace("doc_id", "item_id").replace("documents", "benchmark")},
          nc AS (SELECT doc_id, count(*) AS all_ FROM n GROUP BY doc_id), no_ AS (SELECT doc_id, item_id, count(*) AS number_overlap FROM n JOIN k USING (number) GROUP BY ALL), x AS (
            SELECT doc_id, item_id, term_overlap, coalesce(number_overlap, 0) AS number_overlap, CASE item_id % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'draft' ELSE 'unclear' END AS status,
              CAST(floor(term_overlap * 6000 / (len(c.terms) + len(e.terms) - term_overlap)) AS BIGINT) + CASE WHEN all_ > 0 THEN CAST(floor(coalesce(number_overlap, 0) * 2000 / all_) AS BIGINT) ELSE 0 END
              + CASE item_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 40 ELSE 50 END * 15 + CASE WHEN item_id % 4 <> 0 THEN 500 ELSE 0 END AS confidence
            FROM o JOIN c USING (doc_id) JOIN e USING (item_id) LEFT JOIN nc USING (doc_id) LEFT JOIN no_ USING (doc_id, item_id)
          ) SELECT doc_id, row_number() OVER w AS rank, item_id, term_overlap, number_overlap, CAST(confidence AS BIGINT) AS confidence, printf('%d terms, %d numbers, status %s', term_overlap, number_overlap, status) AS basis FROM x
            WINDOW w AS (PARTITION BY doc_id ORDER BY confidence DESC, item_id) QUALIFY row_number() OVER w <= 3""",
        "source_inventory": "SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS fingerprint, regexp_matches(text, '[0-9]') AS number_bearing FROM documents",
        "line_anchors": f"WITH {_LINES} SELECT doc_id, line_no, printf('passage_doc%d_p%04d', doc_id, line_no) AS passage_id, CAST(length(line) AS BIGINT) AS n_chars FROM l",
        "quote_hash": f"WITH {_LINES} SELECT doc_id, line_no, sha256(line) AS quote_hash FROM l",
        "number_tokens": f"WITH {_NUMBERS} SELECT doc_id, number FROM n",
        "number_overlap": f"WITH {_NUMBERS} SELECT a.doc_id AS query_id, b.doc_id, count(*) AS number_overlap FROM n a JOIN n b USING (number) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL",
        "number_bearing_undated": f"SELECT doc_id FROM documents WHERE {_UNDATED}",
        "duplicate_versions": "SELECT sha256(text) AS fingerprint, count(*) AS versions, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "term_overlap": f"WITH {_OVERLAP} SELECT * FROM o",
        "quoted_support": f"WITH {_QUOTED} SELECT * FROM q",
        "unsupported_claims": f"WITH {_QUOTED} SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM q)",
        "claim_map": f"WITH {_QUOTED} SELECT d.doc_id, count(item_id) AS n_evidence, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS evidence FROM documents d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id",
        "status_conflict": f"WITH {_STATES} SELECT * FROM s",
        "metric_conflict": "WITH o AS (SELECT o_orderpriority AS metric, strftime(o_orderdate, '%Y-%m') AS as_of, count(*) AS value FROM orders GROUP BY ALL) SELECT * FROM o WHERE metric IN (SELECT metric FROM o GROUP BY metric HAVING count(DISTINCT as_of) > 1 AND count(DISTINCT value) > 1)",
        "metric_alias": rf"SELECT array_to_string(list_transform(string_split(regexp_replace(lower(event_type), '[^a-z0-9]+', '_', 'g'), '_'), lambda w: coalesce({_ALIAS}[w], {_ALIAS}[regexp_replace(w, 's$', '')], w)), '_') AS metric, count(*) AS n FROM events GROUP BY 1",
        "findings_union": f"WITH {_FINDINGS} SELECT * FROM f",
        "severity_counts": f"WITH {_FINDINGS} SELECT count(*) FILTER (severity = 'must_fix') AS blocking, count(*) FILTER (severity = 'should_fix') AS needs_review FROM f",
        "readiness": f"WITH {_FINDINGS}, k AS (SELECT count(*) FILTER (severity = 'must_fix') AS blocking, count(*) FILTER (severity = 'should_fix') AS needs_review FROM f) SELECT CASE WHEN blocking > 0 THEN 'blocked' WHEN needs_review > 0 THEN 'review-required' ELSE 'ready' END AS state, blocking, needs_review FROM k",
        "review_queue": f"WITH {_FINDINGS} SELECT md5(rule_id || '|' || location) AS finding_id, severity, location, issue FROM f ORDER BY severity, location, finding_id",
        "decision_state": "SELECT user_id, arg_max(event_id, ROW(ts, event_id)) AS event_id, arg_max(event_type, ROW(ts, event_id)) AS action FROM events GROUP BY user_id",
        "generation_blockers": f"WITH {_QUOTED}, {_STATES} SELECT 'selected source conflict' AS blocker, source AS subject FROM s UNION ALL SELECT 'unsupported claim', CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM q) UNION ALL SELECT 'undated numeric claim', CAST(doc_id AS VARCHAR) FROM documents WHERE {_UNDATED} AND doc_id IN (SELECT doc_id FROM q) UNION ALL SELECT 'no generated claim', 'receipt' WHERE NOT EXISTS (SELECT 1 FROM q)",
        "refresh_diff": "WITH a AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 1) SELECT coalesce(a.h, b.h) AS fingerprint, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.h = b.h",
        "reuse_by_boundary": f"WITH {_QUOTED} SELECT DISTINCT (SELECT min(lang) FROM documents) AS boundary_key, doc_id AS proposition_id, item_id FROM q WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    }
