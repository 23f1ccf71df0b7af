"""Cases of the fourth round's findings: what a query gave wrongly, or in a way that doesn't grow."""

import duckdb

from pyspark.sql import functions as F

from folioflow.plans import registry
from folioflow.plans import text_queries as TQ
from test_queries import SF, told


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def twin(name, **tables):
    """The rows of a query's twin over tables given as paths."""
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    r = con.execute(registry.oracle_sql()[name])
    return told([c[0] for c in r.description], r.fetchall())


def test_expectations_take_turns(spark):
    """Greedy by n; a result is taken once, a null heading asks for none, a null threshold is met by nothing; no query has a Python call of its own."""
    results = spark.createDataFrame([(1, 1, "a", "Head One"), (1, 2, "a", None), (1, 3, "b", "x"), (2, 1, "a", "h"), (3, 1, None, "h"), (4, None, "a", "h")], "query_id long, rank int, path string, heading string")
    expected = spark.createDataFrame([(1, 1, "a", None, 5), (1, 2, "a", "one", 5), (1, 3, "a", None, 5), (1, 4, "b", "X", 2), (2, 1, "a", None, None), (2, 2, "a", "H", 1), (3, 1, None, None, 1), (4, 1, "a", None, 9), (5, 1, "a", None, 9)], "query_id long, n int, path string, heading string, threshold int")
    got = TQ.expectations(results, expected)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (1, 3, 2), (2, 2, 1), (3, 1, 1)]
    assert "Pandas" not in plan(got)
    assert "Pandas" not in plan(registry.queries()["MET4_expectation_matching"](spark, SF))


def test_context_where_a_join_becomes_a_broadcast(spark):
    """A project's documents share one budget also where the join before the fold has dealt them by project and is then made a broadcast at run time."""
    from folioflow.operators import context

    docs = spark.range(640).select(F.concat(F.lit("p"), (F.col("id") % 10).cast("string")).alias("project"), "id", F.lit("t").alias("title"), F.lit("d").alias("doc_type"), F.lit("a b c").alias("text"), F.col("id").alias("modified")).repartition(16)
    records = docs.select("project", F.lit("decisions").alias("section"), "id", "text")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "5k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = context.context(docs.select("project").distinct().withColumn("info", F.lit("x")), docs, records, "brief", budget=10).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r.project, r.place, r.id, r.left_over) for r in got) == [(f"p{p}", k + 1, str(630 - 10 * k + p), 6 - 3 * k) for p in range(10) for k in range(3)]


def test_vector_search_is_exact_without_pairs(spark):
    """The best of all rows by the SQL's order, with copies, ties, zero, tiny, empty, null, infinite and other-sized vectors on both sides; plain ones don't meet as pairs of rows."""
    import numpy as np

    from folioflow.functions import vectors as V
    from folioflow.operators import retrieval as R

    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(6000)]
    rows += [(9000 - i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(400)]
    plain = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    asked = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(20)] + [(20, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "query_id long, q array<double>")

    def paired(v, q, n):
        both = v.crossJoin(F.broadcast(q)).where(F.size("v") == F.size("q")).select("query_id", "id", F.round(V.cosine("v", "q"), 9).alias("score"))
        return sorted(map(repr, R.top(both, n).collect()))

    got = R.vector_search(plain, asked, 30)
    assert "NestedLoop" not in plan(got)
    assert sorted(map(repr, got.collect())) == paired(plain, asked, 30)
    odd = [(-1, None), (-2, [0.0] * 8), (-3, [1e-9] * 8), (-4, [float("inf")] * 8), (-5, []), (-6, [1.0, 2.0]), (-7, [1e20] * 8), (None, rows[0][1]), (-8, [None] * 8), (-9, [float("nan")] * 8)]
    more = plain.unionByName(spark.createDataFrame(odd, "id long, v array<float>"))
    others = asked.unionByName(spark.createDataFrame([(30, None), (31, [0.0] * 8), (32, []), (33, [1.0, 2.0]), (34, [None] + [1.0] * 7), (35, [1e-9] * 8)], "query_id long, q array<double>"))
    assert sorted(map(repr, R.vector_search(more, others, 30).collect())) == paired(more, others, 30)
    named = plain.withColumn("id", F.col("id").cast("string"))
    assert sorted(map(repr, R.vector_search(named, asked, 3).collect())) == paired(named, asked, 3)


def test_summary_of_texts_without_a_paragraph(spark, tmp_path):
    """Empty and blank texts have an empty summary, a null text none."""
    rows = [(1, "a b\n\nc"), (2, ""), (3, " \n "), (4, "\n\n"), (5, None), (6, "\n\nd\n")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["TXT26_summary"](spark, str(tmp_path))
    assert told(got.columns, got.collect()) == twin("TXT26_summary", documents=f"{tmp_path}/documents.parquet/*.parquet")
