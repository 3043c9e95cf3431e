"""Composites: decisions, joins of results, plans, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.functions.formulas import hash_number
from lexiflow.operators import batching, checks, logs, metrics, regression, resample
from lexiflow.plans.registry import EVAL_SQL, evals, query
from lexiflow.sources.tables import table


@query("j11_v04_reconciled", "WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY lang) SELECT lang, a.n AS left, b.n AS right FROM a FULL JOIN b USING (lang) WHERE a.n IS DISTINCT FROM b.n")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy("lang")
    return checks.mismatches(by.agg(F.count("*").alias("n")), by.agg(F.countDistinct("doc_id").alias("n")), "lang", "n")


@query("j14_default_band", "WITH b AS (SELECT lang, count(*) AS band FROM documents WHERE lang <> 'es' GROUP BY lang) SELECT doc_id, coalesce(band, 0) AS band FROM documents LEFT JOIN b USING (lang)")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    bands = docs.filter("lang <> 'es'").groupBy("lang").agg(F.count("*").alias("band"))
    return docs.join(bands, "lang", "left").select("doc_id", F.coalesce("band", F.lit(0)).alias("band"))


@query("j17_j18_assembled", f"WITH {EVAL_SQL}, s AS (SELECT min(doc_id) AS first, ref FROM evals GROUP BY ref) SELECT split, slice, count(*) AS n, round(avg(length(s.ref) + s.first % 10), 6) AS score FROM evals e JOIN s ON e.ref = s.ref GROUP BY ALL")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text is scored once, and its score goes back to every row that has it."""
    rows = evals(spark, sf_dir).select("doc_id", "split", "slice", F.sha2("ref", 256).alias("key"), F.length("ref").alias("n_chars"))
    one = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n_chars").alias("n_chars"))
    scored = one.select("key", (F.col("n_chars") + F.col("first") % 10).alias("score"))
    return rows.drop("n_chars").join(scored, "key").groupBy("split", "slice").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query("g39_planned_epochs", "WITH p AS (SELECT source, sum(n_chars) AS tokens FROM documents GROUP BY source) SELECT source, round(100000 * 25.0 / tokens, 6) AS epochs FROM p WHERE tokens > 0")
def g39(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens")).filter("tokens > 0")
    return got.select("source", F.round(100000 * 25.0 / F.col("tokens"), 6).alias("epochs"))


@query("g47_g57_long_rows", f"WITH {EVAL_SQL} SELECT split, count(*) AS n, round(avg(length(hyp)), 6) AS mean FROM evals WHERE len(string_split(ref, ' ')) > 80 GROUP BY split")
def g57(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals(spark, sf_dir).filter(F.size(F.split("ref", " ")) > 80).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(F.length("hyp")), 6).alias("mean"))


_DRAWN = """WITH v AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS x, CASE WHEN doc_id % 3 = 0 THEN CAST(length(text) AS DOUBLE) END AS y FROM documents),
u AS (SELECT rep, x, y, CAST('0x' || substr(md5('o:' || doc_id || ':' || rep), 1, 15) AS BIGINT) / 1152921504606846976.0 AS u FROM v, (SELECT unnest(range(100)) AS rep)),
w AS (SELECT *, """ + resample.poisson_sql("u") + """ AS t FROM u),
s AS (SELECT rep, 0.8 * sum(t * x) / sum(t) + 0.2 * coalesce(sum(t * y) / sum(t) FILTER (y IS NOT NULL), sum(t * x) / sum(t)) AS o FROM w GROUP BY rep), r AS (SELECT o, row_number() OVER (ORDER BY o, rep) AS n FROM s)"""


@query("b06_b25_composite_interval", _DRAWN.replace("sum(t * y) / sum(t) FILTER (y IS NOT NULL)", "sum(t * y) / nullif(sum(t) FILTER (y IS NOT NULL), 0)") + " SELECT round(max(o) FILTER (n = 3), 6) AS low, round(max(o) FILTER (n = 98), 6) AS high FROM r")
def b06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite whose part over a subset falls back to the whole when a draw has none of it."""
    return _composite(spark, sf_dir, 100)


@query("b06_b25_thousand_draws")
def b06_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, 1000)


def _composite(spark: SparkSession, sf_dir: str, reps: int) -> DataFrame:
    x = F.length("text").cast("double")
    v = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"), F.when(F.col("doc_id") % 3 == 0, x).otherwise(0.0).alias("y"), (F.col("doc_id") % 3 == 0).cast("long").alias("m"))
    sums = resample.resampled_sums(v, "doc_id", ["x", "y", "m"], reps, "o")
    whole = F.col("x") / F.col("n")
    made = sums.withColumn("o", 0.8 * whole + 0.2 * F.coalesce(F.col("y") / F.nullif(F.col("m"), F.lit(0)), whole))
    return resample.interval(made, "o", reps).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("b02_interpolated_interval", _DRAWN.replace("s AS (SELECT rep, 0.8", "q AS (SELECT rep, 0.8").replace(", r AS (SELECT o, row_number() OVER (ORDER BY o, rep) AS n FROM s)", "") + ", m AS (SELECT rep, sum(t * x) / sum(t) AS mean FROM w GROUP BY rep) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interpolating interval, of a mean."""
    v = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("x"))
    sums = resample.resampled_sums(v, "doc_id", ["x"], 100, "o").withColumn("mean", F.col("x") / F.col("n"))
    return sums.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))


@query("b14_refitted_decomposition")
def b14_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap in lengths of English and other texts, what words and marks explain of it, and intervals of decompositions fitted anew on 1,000 draws."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("double").alias("y"), T.word_count(text).cast("double").alias("words"), T.punct_density(text).alias("punct"), (F.col("lang") != "en").cast("int").alias("side"))
    got = regression.refitted_gap(docs, "doc_id", "side", "y", ["words", "punct"], 1000, "d")
    return spark.createDataFrame([(k, *(round(x, 6) for x in v)) for k, v in got.items()], "quantity string, point double, low double, high double")


@query("b20_mix_and_rate_intervals")
def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of g29's terms, split anew on 1,000 draws."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 2).alias("side"), F.col("n_chars").cast("double").alias("x"))
    got = resample.mix_and_rate_intervals(docs, "doc_id", "lang", "side", "x", 1000, "d")
    return got.select("class", *(F.round(c, 4).alias(c) for c in got.columns[1:]))


@query("b19_estimands")
def b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a gap in means that lengths in words explain, by the slope of the pooled rows and of either group."""
    docs = table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("y"), F.size(F.split("text", " ")).cast("double").alias("x"), (F.col("lang") == "en").alias("en"))
    parts = {"pooled": docs, "en": docs.filter("en"), "other": docs.filter("NOT en")}
    mean = {k: v.agg(F.avg("x")).first()[0] or 0.0 for k, v in parts.items()}
    return spark.createDataFrame([(k, round(regression.ols(v, "y", ["x"])["x"][0] * (mean["en"] - mean["other"]), 4)) for k, v in parts.items()], "estimand string, explained double")


@query("g21_longer_in_every_split", "WITH d AS (SELECT split, avg(length(hyp_b) - length(hyp)) AS delta FROM (" + f"WITH {EVAL_SQL} SELECT * FROM evals" + ") GROUP BY split) SELECT bool_and(delta > 0) AS holds, count(*) AS sets FROM d")
def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = evals(spark, sf_dir).groupBy("split").agg(F.avg(F.length("hyp_b") - F.length("hyp")).alias("delta"))
    return delta.agg(F.bool_and(F.col("delta") > 0).alias("holds"), F.count("*").alias("sets"))


@query("b21_b26_paired_decisions")
def b21_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of systems with a row for every document, by BLEU on 1,000 draws: better on e2 and e3, not worse on e1. System c lacks every seventh document, so it is in no pair."""
    rows = evals(spark, sf_dir)
    run = lambda name, hyp: metrics.bleu_stats(rows, hyp, keep=["doc_id", "split"]).withColumn("run", F.lit(name))
    made = run("a", "hyp").unionByName(run("b", "hyp_b"))
    made = made.unionByName(made.filter("run = 'a' AND doc_id % 7 <> 0").withColumn("run", F.lit("c")))
    got = resample.decisions(made, rows, "doc_id", "run", "split", 1000, "b", ["e2", "e3"], ["e1"])
    return got.select("better", "other", "split", *(F.round(c, 6).alias(c) for c in ("delta", "low", "high", "p")), "met", "supported")


@query(
    "z11_concat_plan",
    """WITH u AS (SELECT doc_id, CAST('0x' || substr(md5('c:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents), k AS (SELECT doc_id, CASE WHEN h % 100 < 15 THEN 2 + h % 3 ELSE 1 END AS n FROM u)
    SELECT doc_id, n, CAST((SELECT least(1000, sum(len(string_split(d.text, ' ')))) FROM documents d WHERE d.doc_id BETWEEN k.doc_id AND k.doc_id + k.n - 1) AS BIGINT) AS joined FROM k""",
)
def z11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows are joined with the one to three that follow; the joined length is capped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("len"))
    h = hash_number("c", F.col("doc_id"))
    plan = docs.select("doc_id", F.when(h % 100 < 15, 2 + h % 3).otherwise(1).cast("long").alias("n"))
    each = plan.select("doc_id", "n", F.explode(F.sequence(F.col("doc_id"), F.col("doc_id") + F.col("n") - 1)).alias("partner"))
    return each.join(docs.select(F.col("doc_id").alias("partner"), "len"), "partner").groupBy("doc_id", "n").agg(F.least(F.lit(1000), F.sum("len")).alias("joined"))


@query("z12_padded_sizes", "SELECT doc_id // 32 AS batch, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS real, count(*) * max(n_chars) AS padded FROM documents GROUP BY ALL")
def z12(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select(F.lit(0).alias("chunk"), batching.chunk_bounds(F.col("doc_id"), 32).alias("batch"), "n_chars")
    return batching.padded(b, "n_chars").drop("chunk")


@query("w02_w03_chunk_digests", "SELECT doc_id // 100 AS chunk, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || lang, ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws(":", F.col("doc_id").cast("string"), "lang")
    chunk = table(spark, sf_dir, "documents").groupBy(batching.chunk_bounds(F.col("doc_id"), 100).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("doc_id", row.alias("r")))).alias("rs"))
    return chunk.select("chunk", F.sha2(F.array_join(F.transform("rs", lambda x: x["r"]), ","), 256).alias("digest"))


@query("w04_resumed_order", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('e3:' || doc_id), doc_id) AS n FROM documents) WHERE n > 150 AND n <= 200")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch's order depends on its seed alone, so a cursor is enough to go on."""
    from lexiflow.operators.sampling import sample

    head = sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200, "e3")
    done = sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 150, "e3")
    return head.join(F.broadcast(done), "doc_id", "left_anti")  # 150 rows


@query("z17_log_report", "WITH r AS (SELECT user_id, count(*) AS n, min(value) AS least, max(event_id) AS last FROM events GROUP BY user_id), s AS (SELECT user_id, count(*) FILTER (b) AS resets FROM (SELECT user_id, event_id % 97 < lag(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY user_id) SELECT user_id, n, least, last, resets FROM r JOIN s USING (user_id)")
def z17(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 97).alias("step"), "value")
    whole = ev.groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("event_id").alias("last"))
    return whole.join(logs.resets(ev, ["user_id"], "event_id", "step").drop("repeated"), "user_id")
