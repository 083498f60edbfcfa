"""Queries over lexical, dense and hybrid retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import retrieval as R
from lodeworks.tables import load, spread
from lodeworks.text_queries import _HASH, _STOP, BUCKETS, TERMS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The stated queries. Fixed values.
ASKED = ((1, "handoff lock released twice by the ledger worker"), (2, "nightly index skips the empty template rows"), (3, "consent expired before the triage view was opened again"))


def _asked(spark):
    return spark.createDataFrame(ASKED, "q int, text string")


_Q = "asked(q, text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in ASKED) + ")"
_QTERMS = f"""{_Q}, qwords AS (SELECT q, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN {_STOP}) AS w FROM asked),
qgrams AS (SELECT q, unnest(w) AS term, 'word' AS kind FROM qwords UNION ALL SELECT q, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 'ngram' FROM qwords WHERE len(w) >= 2),
qterms AS (SELECT q, term, kind, count(*) AS n FROM qgrams GROUP BY ALL),
qhash AS (SELECT term, CAST(abs(((h + 2147483648) & 4294967295) - 2147483648) % 384 AS INTEGER) AS bucket FROM (SELECT DISTINCT term, {_HASH} AS h FROM qterms)),
qraw AS (SELECT q, bucket, sum(CASE WHEN kind = 'word' THEN n ELSE n * 1.5 END)::DOUBLE AS w FROM qterms JOIN qhash USING (term) GROUP BY q, bucket),
qvec AS (SELECT q, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS weight FROM qraw)"""
_LEX = f"""WITH {BUCKETS}, {_QTERMS}, cos AS (SELECT q, doc_id, sum(vectors.weight * qvec.weight) AS cos FROM vectors JOIN qvec USING (bucket) GROUP BY q, doc_id),
shared AS (SELECT q, doc_id, count(*) FILTER (kind = 'word') AS w, count(*) FILTER (kind = 'ngram') AS g FROM terms JOIN qterms USING (term, kind) GROUP BY q, doc_id),
size AS (SELECT q, count(*) FILTER (kind = 'word') AS ws, count(*) FILTER (kind = 'ngram') AS gs FROM qterms GROUP BY q),
lex AS (SELECT q, doc_id, least(1.0, cos + 0.2 * coalesce(g, 0) / greatest(gs, 1) + 0.1 * coalesce(w, 0) / greatest(ws, 1)) AS score FROM cos LEFT JOIN shared USING (q, doc_id) JOIN size USING (q))"""


def _lexical(spark, sf_dir):
    return R.lexical(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), _asked(spark), "doc_id", "q")


@query(_LEX + " SELECT q, doc_id, round(score, 6) AS score FROM lex WHERE round(score, 6) >= 0.3")
def lexical_search(spark, sf_dir):
    return _lexical(spark, sf_dir).select("q", "doc_id", F.round("score", 6).alias("score")).filter("score >= 0.3")


@query(_LEX + ", r AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id) AS place FROM lex) SELECT * FROM r WHERE place <= 10")
def lexical_top(spark, sf_dir):
    s = _lexical(spark, sf_dir).withColumn("score", F.round("score", 6))
    return R.rank(s, "score", "doc_id", "place", ["q"], 10).select("q", "doc_id", F.col("place").cast("long").alias("place"))


_DENSE = """qd AS (SELECT vec_id AS q, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q, vec_id, round(list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS similarity FROM embeddings, qd)"""


@query(f"WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, vec_id) AS place FROM d) SELECT q, vec_id, similarity FROM r WHERE place <= 10")
def dense_search(spark, sf_dir):
    """The ten nearest of each query vector, the queries being every vector whose id is divisible by 100."""
    e = load(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return R.dense_top(e, asked, "vec_id", "q", 10).select("q", "vec_id", "similarity")


_HYBRID = f"""{_LEX}, lr AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id) AS r FROM lex),
qe AS (SELECT a.q, e.embedding AS v FROM asked a JOIN embeddings e ON e.vec_id = a.q * 100), ds AS (SELECT q, vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS s FROM embeddings, qe),
dr AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS r FROM ds),
f AS (SELECT coalesce(lr.q, dr.q) AS q, coalesce(lr.doc_id, dr.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (60 + lr.r), 0) + coalesce(1.0::DOUBLE / (60 + dr.r), 0) AS score FROM lr FULL JOIN dr ON lr.q = dr.q AND lr.doc_id = dr.doc_id)"""


@query(_HYBRID + ", p AS (SELECT q, doc_id, round(score, 9) AS score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS place FROM p) SELECT q, doc_id, score FROM r WHERE place <= 10")
def hybrid_search(spark, sf_dir):
    """Lexical and dense rankings fused by reciprocal rank; each query borrows a stored vector."""
    lex = R.rank(_lexical(spark, sf_dir).withColumn("score", F.round("score", 6)), "score", "doc_id", "r", ["q"])
    e = load(spark, sf_dir, "embeddings")
    asked = _asked(spark).select("q").join(e.select((F.col("vec_id") / 100).alias("_v"), F.col("embedding")), F.col("q") == F.col("_v")).select("q", "embedding")
    d = R.dense(e.withColumnRenamed("vec_id", "doc_id"), asked, "doc_id", "q").withColumn("similarity", F.round("similarity", 6))
    both = R.fused(lex, R.rank(d, "similarity", "doc_id", "r2", ["q"]), "q", "doc_id", "r", "r2").withColumn("score", F.round("score", 9))
    return R.rank(both, "score", "doc_id", "place", ["q"], 10).select("q", "doc_id", "score")


@query(f"WITH {TERMS}, t AS (SELECT doc_id, count(*) FILTER (kind = 'word') AS c FROM terms GROUP BY doc_id) SELECT (SELECT count(*) FROM documents) AS total, count(*) FILTER (c > 0) AS indexed, (SELECT count(DISTINCT term) FROM terms WHERE kind = 'word') AS unique_terms, round(avg(c), 6) AS mean_terms FROM t")
def index_stats(spark, sf_dir):
    d = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    words = T.index_terms(d, "doc_id", "text").filter("kind = 'word'")
    per = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("indexed"), F.round(F.avg("c"), 6).alias("mean_terms")).withColumn("k", F.lit(1))
    terms = words.agg(F.count_distinct("term").alias("unique_terms")).withColumn("k", F.lit(1))
    return d.agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(1)).join(per, "k").join(terms, "k").select("total", "indexed", "unique_terms", "mean_terms")
