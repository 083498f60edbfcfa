"""Queries over term counts (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import termcounts as C
from lodeworks.plans.lineage import scratch
from lodeworks.tables import load


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = C.count_terms(load(spark, sf_dir, "handling_vectors"))
    return C.marked(state).filter(F.col("mark").isNotNull()).select(F.col("term").alias("ngram"), "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.count_terms(load(spark, sf_dir, "handling_vectors")).filter(F.col("term").isNotNull()).select("term", "occurrences", "records")


def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the records indexed in even minutes, brought up to all records by the deltas of the rest."""
    table = load(spark, sf_dir, "handling_vectors")
    after = C.records(table, "path", "ngrams_json")
    before = C.records(table.filter(F.pmod(F.floor(F.coalesce("indexed_at", F.lit(0)) / 60000), F.lit(2)) == 0), "path", "ngrams_json")
    store = C.Store(spark, scratch(spark, "terms"))
    store.merge(C.deltas(C.changes(None, before)))
    store.merge(C.deltas(C.changes(before, after)))
    return store.read().filter(F.col("term").isNotNull()).select("term", "occurrences", "records")


def p5_stored_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counters that disagree with the terms counted anew from terms_json."""
    counted = C.count_terms(load(spark, sf_dir, "handling_vectors"), "path", "terms_json").filter(F.col("term").isNotNull()).select(F.col("term").alias("_t"), F.col("records").alias("counted"))
    stored = load(spark, sf_dir, "handling_term_frequencies").groupBy("term").agg(F.max("doc_freq").alias("stored"), F.count(F.lit(1)).alias("rows"))
    joined = stored.join(counted, F.col("term") == F.col("_t"), "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return joined.filter(~F.col("stored").eqNullSafe(F.col("counted")) | (F.col("rows") > 1)).select("term", "stored", "counted", "rows")


_READ = """
WITH r AS (SELECT path, any_value(ngrams_json) AS j, any_value(terms_json) AS t FROM handling_vectors WHERE path IS NOT NULL GROUP BY path),
ok AS (SELECT path, CAST(j AS JSON) AS j FROM r WHERE json_valid(j)),
e AS (SELECT path, unnest(json_keys(j)) AS term, unnest(json_extract_string(j, '$.*')) AS v FROM ok),
counts AS (SELECT term, CAST(sum(greatest(coalesce(TRY_CAST(v AS BIGINT), 0), 0)) AS BIGINT) AS occurrences, count(*) AS records FROM e GROUP BY term)
"""
QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts, "p5_incremental": p5_incremental, "p5_stored_drift": p5_stored_drift}
ORACLES = {
    "p5_found": _READ + "SELECT term AS ngram, 'rare' AS mark FROM counts WHERE records = 1 UNION ALL SELECT term, 'common' FROM counts WHERE records > (SELECT count(*) FROM ok) * 0.1",
    "p5_counts": _READ + "SELECT * FROM counts",
    "p5_incremental": _READ + "SELECT * FROM counts",
    "p5_stored_drift": """
WITH r AS (SELECT path, any_value(terms_json) AS t FROM handling_vectors WHERE path IS NOT NULL GROUP BY path),
ok AS (SELECT path, CAST(t AS JSON) AS j FROM r WHERE json_valid(t)),
c AS (SELECT term, count(*) AS n FROM (SELECT unnest(json_keys(j)) AS term FROM ok) GROUP BY term),
s AS (SELECT term, max(doc_freq) AS stored, count(*) AS "rows" FROM handling_term_frequencies GROUP BY term)
SELECT s.term, s.stored, coalesce(c.n, 0) AS counted, s."rows" FROM s LEFT JOIN c ON s.term = c.term WHERE s.stored IS DISTINCT FROM coalesce(c.n, 0) OR s."rows" > 1""",
}
