"""Statistics, metrics, intervals, rankings and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import batching, logs, metrics, regression, resample, stats
from lexiflow.plans.registry import EVAL_SQL, SQL_WORD, SQL_WS, evals, query
from lexiflow.sources.tables import table

_N_WORDS = rf"len(list_filter(string_split(trim(regexp_replace(text, '{SQL_WS}+', ' ', 'g')), ' '), lambda x: x <> ''))"
_DOCS = f"d AS (SELECT doc_id, lang, source, length(text) AS n_chars, {_N_WORDS} AS n FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), T.word_count(F.col("text")).alias("n"))


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


@query(
    "g01_histogram",
    f"WITH {_DOCS}, h AS (SELECT CASE WHEN n <= 10 THEN '<=10' WHEN n <= 20 THEN '11-20' WHEN n <= 40 THEN '21-40' WHEN n <= 80 THEN '41-80' WHEN n <= 160 THEN '81-160' WHEN n <= 256 THEN '161-256' ELSE '>256' END AS label FROM d) SELECT l.label, (SELECT count(*) FROM h WHERE h.label = l.label) AS n FROM (SELECT unnest(['<=10', '11-20', '21-40', '41-80', '81-160', '161-256', '>256']) AS label) l",
)
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_docs(spark, sf_dir), T.token_bin(F.col("n")), T.TOKEN_BINS)


@query("g02_dense_counts", "WITH t AS (SELECT unnest(list_transform(string_split(text, ' '), lambda x: length(x) % 40)) AS id FROM documents) SELECT r.id AS token_id, (SELECT count(*) FROM t WHERE t.id = r.id) AS n FROM (SELECT unnest(range(50)) AS id) r")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.transform(F.split("text", " "), lambda x: F.length(x) % 40).alias("ids"))
    return stats.dense_counts(docs, "ids", 50).withColumn("token_id", F.col("token_id").cast("long"))


@query(
    "g03_g12_g15_g16_describe",
    f"WITH {_DOCS} SELECT lang, count(n) AS n, round(avg(n), 6) AS mean, min(n) AS min, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max, round(sum(n_chars) / sum(n), 6) AS chars_a_word FROM d GROUP BY lang",
)
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _docs(spark, sf_dir).groupBy("lang").agg(*stats.describe(F.col("n")), (F.sum("n_chars") / F.sum("n")).alias("chars_a_word"))
    return _round(got, "mean", "p50", "p90", "p95", "p99", "chars_a_word")


@query("g04_most_common", "WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch ORDER BY n DESC, ch LIMIT 8")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    return stats.most_common(chars.withColumn("o", F.col("ch")), "ch", "o", 8)


@query("g05_g21_flags", "SELECT event_type, count(*) FILTER (value > 50) AS high, count(*) FILTER (value <= 50) AS low, bool_or(value > 99) AS any_top FROM events GROUP BY event_type")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"), F.bool_or(F.col("value") > 99).alias("any_top"))


@query("g13_rollup", f"WITH {_DOCS} SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM d GROUP BY ROLLUP (lang, source)")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _docs(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))
    return _round(got.fillna("all", ["lang", "source"]), "mean")


@query("g25_g42_slice_intervals")
def g25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language, and of each source within it: BLEU and the mean length, with intervals of 1,000 draws of the slice's own rows; those of BLEU hold their point."""
    s = metrics.bleu_stats(evals(spark, sf_dir), keep=["doc_id", "slice"])
    rows = s.join(table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("double").alias("chars")), "doc_id")
    named = rows.withColumn("source", F.explode(F.array(F.lit("all"), "source")))
    return _round(resample.slice_intervals(named, "doc_id", ["slice", "source"], "chars", 1000, "b"), "bleu", "bleu_low", "bleu_high", "mean", "mean_low", "mean_high")


@query(
    "g17_g18_g49_across_runs",
    """WITH r AS (SELECT event_type, user_id % 5 AS run, avg(value) AS mean_value, max(value) AS max_value FROM events GROUP BY ALL), u AS (SELECT event_type, 'mean_value' AS key, mean_value AS value FROM r UNION ALL SELECT event_type, 'max_value', max_value FROM r),
    g AS (SELECT event_type, key, median(value) AS med, min(value) AS lo, max(value) AS hi, count(*) AS n FROM u GROUP BY ALL)
    SELECT event_type, key, round(med, 6) AS median, round(lo, 6) AS min, round(hi, 6) AS max, n, round((hi - lo) / med, 6) AS spread, (hi - lo) / med > 0.10 AS unstable FROM g""",
)
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("run")).agg(F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return _round(stats.across_runs(stats.unpivoted(runs, ["event_type"], ["mean_value", "max_value"]), ["event_type", "key"]), "median", "min", "max", "spread")


@query("g19_g20_two_levels", "WITH r AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(avg(m), 6) AS of_runs, round((SELECT avg(value) FROM events e WHERE e.event_type = r.event_type), 6) AS pooled, round(avg(m) FILTER (m <= 40), 6) AS restricted FROM r GROUP BY event_type")
def g19(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("value").alias("c"))
    return _round(runs.groupBy("event_type").agg(F.avg("m").alias("of_runs"), (F.sum("s") / F.sum("c")).alias("pooled"), F.avg(F.when(F.col("m") <= 40, F.col("m"))).alias("restricted")), "of_runs", "pooled", "restricted")


@query(
    "g22_g43_g45_failure_rates",
    rf"""WITH {EVAL_SQL}, w AS (SELECT split, slice, len(regexp_extract_all(hyp, '{SQL_WORD}')) AS h, len(regexp_extract_all(ref, '{SQL_WORD}')) AS r FROM evals), x AS (SELECT *, CASE WHEN r > 0 THEN h / r WHEN h = 0 THEN 1.0 ELSE 10.0 END AS ratio FROM w)
    SELECT split, coalesce(slice, 'all') AS slice, count(*) AS n, round(avg(CASE WHEN r > 0 AND h < 0.5 * r THEN 1.0 ELSE 0.0 END), 6) AS truncated, round(avg(ratio), 6) AS mean_ratio, round(median(ratio), 6) AS median_ratio FROM x GROUP BY GROUPING SETS ((split), (split, slice))""",
)
def g22(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, r = F.col("hyp"), F.col("ref")
    rows = evals(spark, sf_dir).select("split", "slice", T.is_truncated(h, r).alias("t"), T.length_ratio(h, r).alias("ratio"))
    got = rows.groupingSets([("split",), ("split", "slice")], "split", "slice").agg(F.count("*").alias("n"), stats.rate(F.col("t")).alias("truncated"), F.avg("ratio").alias("mean_ratio"), F.median("ratio").alias("median_ratio"))
    return _round(got.fillna("all", ["slice"]), "truncated", "mean_ratio", "median_ratio")


@query(
    "g23_g24_quantile_buckets",
    f"""WITH {_DOCS}, e AS (SELECT quantile_cont(n, [0.2, 0.4, 0.6, 0.8]) AS e FROM d), b AS (SELECT 5 - len(list_filter(e, lambda x: n > x)) AS bucket, n_chars FROM d, e)
    SELECT r.bucket, (SELECT count(*) FROM b WHERE b.bucket = r.bucket) AS n, round((SELECT avg(n_chars) FROM b WHERE b.bucket = r.bucket), 6) AS mean FROM (SELECT unnest(range(1, 6)) AS bucket) r""",
)
def g23(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return _round(stats.quantile_means(docs, "n", "n_chars", stats.quantile_edges(docs, "n", 5), 5), "mean")


@query("g26_g27_g46_copy_shares", f"WITH {_DOCS} SELECT source, round(sum(n) / nullif(sum(n_chars), 0), 6) AS pooled, round(avg(CASE WHEN n > 200 THEN 1.0 ELSE 0.0 END), 6) AS share FROM d GROUP BY source")
def g26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_docs(spark, sf_dir).groupBy("source").agg((F.sum("n") / F.nullif(F.sum("n_chars"), F.lit(0))).alias("pooled"), stats.rate(F.col("n") > 200).alias("share")), "pooled", "share")


@query(
    "g29_mix_and_rate",
    """WITH c AS (SELECT lang AS class, sum(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END) AS sa, count(*) FILTER (doc_id % 2 = 0) AS na, sum(CASE WHEN doc_id % 2 = 1 THEN n_chars ELSE 0 END) AS sb, count(*) FILTER (doc_id % 2 = 1) AS nb FROM documents GROUP BY lang),
    t AS (SELECT *, na / sum(na) OVER () AS wa, nb / sum(nb) OVER () AS wb, coalesce(sa / nullif(na, 0), sb / nullif(nb, 0)) AS ma, coalesce(sb / nullif(nb, 0), sa / nullif(na, 0)) AS mb FROM c)
    SELECT class, round((wa - wb) * (ma + mb) / 2, 4) AS mix, round((ma - mb) * (wa + wb) / 2, 4) AS rate FROM t""",
)
def g29(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("doc_id") % 2
    c = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("class")).agg(*(f(F.when(half == k, F.col("n_chars"))).alias(f"{n}{x}") for k, x in ((0, "a"), (1, "b")) for n, f in (("s", F.sum), ("n", F.count))))
    return _round(stats.mix_and_rate(c), "mix", "rate", digits=4)


@query("g30_g33_g48_summary", "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, round(sum(value) / 3600, 6) AS hours FROM events GROUP BY user_id")
def g30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), (F.sum("value") / 3600).alias("hours")), "mean", "sd", "median", "hours")


@query(
    "g31_loss_curve",
    """WITH m AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS e FROM events)
    SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(value) AS least, arg_min(event_id, {'v': value, 's': event_id}) AS least_at, round(avg(value) FILTER (event_id > e - 1000), 6) AS tail_mean, arg_min(value, {'d': abs(event_id - 0.5 * e), 's': event_id}) AS at_50 FROM m GROUP BY user_id""",
)
def g31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(logs.loss_curve(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", [0.5], 1000), "tail_mean")


@query("g32_stability", "WITH c AS (SELECT user_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) FILTER (p <> event_type) AS switches, count(*) FILTER (NOT isfinite(value)) AS odd, round(max(value) / median(value), 6) AS peak FROM c GROUP BY user_id")
def g32(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    marked = ev.withColumn("s", logs.changes(ev, ["user_id"], "event_id", "event_type"))
    return _round(marked.groupBy("user_id").agg(F.count_if("s").alias("switches"), F.count_if(~T.finite(F.col("value"))).alias("odd"), (F.max("value") / F.median("value")).alias("peak")), "peak")


@query("g34_g37_conditional_sums", "SELECT user_id % 2 = 0 AS is_local, round(sum(value), 4) AS total, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (value > 290) AS listed FROM events GROUP BY ALL")
def g34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2 == 0).alias("is_local")).agg(F.sum("value").alias("total"), F.array_sort(F.collect_list(F.when(F.col("value") > 290, F.col("event_id")))).alias("listed")), "total", digits=4).withColumn("listed", F.when(F.size("listed") > 0, F.array_join(F.transform("listed", lambda x: x.cast("string")), ",")))


@query("g35_plan", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT event_type, round(median(value), 6) AS sec, CAST(greatest(1, floor(3600 * 0.9 / median(value))) AS BIGINT) AS steps FROM r WHERE n > 20 GROUP BY event_type")
def g35(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("event_id")
    late = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n > 20")
    return _round(late.groupBy("event_type").agg(F.median("value").alias("sec"), F.greatest(F.lit(1), F.floor(3240 / F.median("value"))).cast("long").alias("steps")), "sec")


@query("g38_g40_g56_token_totals", f"WITH {_DOCS} SELECT source, CAST(sum(n + 1) AS BIGINT) AS tokens, count(*) AS n, count(DISTINCT lang) AS langs FROM d GROUP BY source")
def g38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum(F.col("n") + 1).alias("tokens"), F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))


@query("g36_z08_merged_maps", "SELECT 'k' AS key, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS n FROM events")
def g36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.merged_counts(table(spark, sf_dir, "events").select(F.from_json("props", "map<string,bigint>").alias("m")), "m")


@query("g44_vector_mean", "WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY ALL")
def g44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.vector_mean(table(spark, sf_dir, "embeddings"), ["label"], "embedding"), "mean").withColumn("pos", F.col("pos").cast("long"))


@query("g50_g53_first_and_last", "SELECT user_id, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_step, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id")
def g50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max("event_id").alias("last_step"), F.count_if(F.col("event_type") == "click").alias("clicks"))


_STATS_SQL = rf"""WITH {EVAL_SQL}, tok AS (SELECT doc_id, slice, split, regexp_extract_all(hyp, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]') AS h, regexp_extract_all(ref, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]') AS r FROM evals),
""" + "".join(
    f"""{x}w AS (SELECT doc_id, unnest({x}) AS t, unnest(range(len({x}))) AS pos FROM tok),
{x}g AS (SELECT doc_id, t AS g1, t || chr(1) || lead(t, 1) OVER w AS g2, t || chr(1) || lead(t, 1) OVER w || chr(1) || lead(t, 2) OVER w AS g3, t || chr(1) || lead(t, 1) OVER w || chr(1) || lead(t, 2) OVER w || chr(1) || lead(t, 3) OVER w AS g4 FROM {x}w WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
{x}c AS (SELECT doc_id, n, g, count(*) AS c FROM ({" UNION ALL ".join(f"SELECT doc_id, {n} AS n, g{n} AS g FROM {x}g WHERE g{n} IS NOT NULL" for n in (1, 2, 3, 4))}) GROUP BY ALL),
"""
    for x in "hr"
) + """mt AS (SELECT doc_id, """ + ", ".join(f"sum(least(hc.c, rc.c)) FILTER (n = {n}) AS m{n}" for n in (1, 2, 3, 4)) + """ FROM hc JOIN rc USING (doc_id, n, g) GROUP BY doc_id),
st AS (SELECT t.doc_id, t.slice, t.split, len(h) AS hyp_len, len(r) AS ref_len, """ + ", ".join(f"CAST(coalesce(m{n}, 0) AS BIGINT) AS m{n}, greatest(len(h) - {n - 1}, 0) AS t{n}" for n in (1, 2, 3, 4)) + " FROM tok t LEFT JOIN mt USING (doc_id))"


@query("m01_sentence_stats", _STATS_SQL + " SELECT doc_id, hyp_len, ref_len, m1, m2, m3, m4, t1, t2, t3, t4 FROM st")
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bleu_stats(evals(spark, sf_dir), keep=["doc_id"])


@query(
    "m02_m03_m06_corpus_bleu",
    _STATS_SQL
    + """, s AS (SELECT coalesce(slice, 'all') AS slice, sum(hyp_len) AS h, sum(ref_len) AS r, sum(m1) AS m1, sum(m2) AS m2, sum(m3) AS m3, sum(m4) AS m4, sum(t1) AS t1, sum(t2) AS t2, sum(t3) AS t3, sum(t4) AS t4 FROM st GROUP BY ROLLUP (slice))
    SELECT slice, round(100 * CASE WHEN h > r THEN 1.0 ELSE exp(1 - r / h) END * exp((ln(m1 / t1) + ln((m2 + 1) / (t2 + 1)) + ln((m3 + 1) / (t3 + 1)) + ln((m4 + 1) / (t4 + 1))) / 4), 6) AS bleu FROM s""",
)
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.bleu_stats(evals(spark, sf_dir), keep=["slice"])
    return s.rollup("slice").agg(*metrics.summed()).fillna("all", ["slice"]).select("slice", F.round(metrics.bleu(), 6).alias("bleu"))


@query("m04_m05_m12_chrf")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per slice, over whole texts; held against a plain scorer in the tests."""
    return evals(spark, sf_dir).select("slice", metrics.chrf("hyp", "ref").alias("c")).groupBy("slice").agg(F.round(F.avg("c"), 6).alias("chrf"))


@query("m07_m13_objective")
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evals(spark, sf_dir).filter("split IN ('e1', 'e2')").withColumn("c", metrics.chrf("hyp", "ref"))
    b = metrics.bleu_stats(rows, keep=["split"]).agg(*metrics.summed()).select(metrics.bleu().alias("bleu"))
    c = rows.agg(F.avg("c").alias("chrf"), F.avg(F.when(F.col("split") == "e1", F.col("c"))).alias("unseen"))
    return b.crossJoin(c).select(F.round(0.4 * F.col("bleu") + 0.4 * F.col("chrf") + 0.2 * F.coalesce("unseen", "chrf"), 6).alias("objective"))  # one row each


@query("m09_artifact_share")
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evals(spark, sf_dir).select("slice", metrics.chrf("hyp", "ref").alias("a"), metrics.chrf(F.col("hyp"), T.strip_quotes(F.col("ref"))).alias("b"))
    return rows.groupBy("slice").agg(F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"))


@query("m11_multiset_overlap", "WITH w AS (SELECT item_id, string_split(text, ' ') AS a, list_filter(string_split(text, ' '), lambda x, i: i % 3 <> 0) AS b FROM benchmark), u AS (SELECT item_id, list_distinct(a) AS v, a, b FROM w) SELECT item_id, CAST(list_sum(list_transform(v, lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS BIGINT) AS shared FROM u")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("a")).withColumn("b", F.filter("a", lambda x, i: (i + 1) % 3 != 0))
    return w.select("item_id", metrics.overlap(F.col("a"), F.col("b")).cast("long").alias("shared"))


_DRAW = """WITH RECURSIVE reps AS (SELECT unnest(range(200)) AS rep), v AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS x FROM documents),
u AS (SELECT rep, x, doc_id, CAST('0x' || substr(md5('b:' || doc_id || ':' || rep), 1, 15) AS BIGINT) / 1152921504606846976.0 AS u FROM v, reps),
w AS (SELECT *, """ + resample.poisson_sql("u") + """ AS times FROM u),
s AS (SELECT rep, sum(times * x) / sum(times) AS mean FROM w GROUP BY rep), o AS (SELECT mean, row_number() OVER (ORDER BY mean, rep) AS n FROM s)"""


@query("b02_b03_b22_mean_interval", _DRAW + " SELECT round(max(mean) FILTER (n = 6), 6) AS low, round(max(mean) FILTER (n = 196), 6) AS high FROM o")
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("x"))
    means = resample.resampled_sums(v, "doc_id", ["x"], 200, "b").withColumn("mean", F.col("x") / F.col("n"))
    return _round(resample.interval(means, "mean", 200), "low", "high")


#: Draws of the intervals without SQL; those of the SQL are 200 and 100.
DRAWS = 1000


@query("b02_b03_b22_thousand_draws")
def b02_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("x"))
    means = resample.resampled_sums(v, "doc_id", ["x"], DRAWS, "b").withColumn("mean", F.col("x") / F.col("n"))
    return _round(resample.interval(means, "mean", DRAWS), "low", "high")


@query("b01_b23_bleu_interval")
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.bleu_stats(evals(spark, sf_dir), keep=["doc_id", "slice"])
    reps = resample.resampled_sums(s, "doc_id", metrics.STATS, DRAWS, "b", ["slice"]).withColumn("bleu", metrics.bleu())
    point = s.groupBy("slice").agg(*metrics.summed()).select("slice", metrics.bleu().alias("point"))
    low, high = resample.clipped(F.col("low"), F.col("high"), F.col("point"))
    return _round(resample.interval(reps, "bleu", DRAWS, ["slice"]).join(point, "slice").select("slice", "point", low.alias("low"), high.alias("high")), "point", "low", "high")


@query("b04_b05_b07_b08_paired")
def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two systems, resampled within each set with the same draws."""
    both = evals(spark, sf_dir)
    a = metrics.bleu_stats(both, "hyp", keep=["doc_id", "split"])
    b = metrics.bleu_stats(both, "hyp_b", keep=["doc_id"]).select("doc_id", *(F.col(s).alias(f"b_{s}") for s in metrics.STATS))
    sums = resample.resampled_sums(a.join(b, "doc_id"), "doc_id", [*metrics.STATS, *(f"b_{s}" for s in metrics.STATS)], DRAWS, "b", ["split"])
    return _round(resample.paired(sums.select("split", "rep", metrics.bleu("b_").alias("b"), metrics.bleu().alias("a")), "b", "a", DRAWS, ["split"]), "low", "high", "p")


def _parts(rows: DataFrame) -> DataFrame:
    """Each row once for its whole set, its slice, its word bucket, and the long rows if it is one."""
    n = F.size(F.split("ref", " "))
    kinds = [("all", F.lit("all")), ("slice", F.col("slice")), ("bucket", T.length_bucket(n)), ("long", F.when(n > 80, "long"))]
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), label.alias("label")) for k, label in kinds))
    return rows.withColumn("part", F.explode(F.filter(parts, lambda x: x["label"].isNotNull()))).select("*", "part.kind", "part.label").drop("part")


@query("g41_g55_part_intervals")
def g41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every set: BLEU and the mean sentence chrF, with intervals, of the whole, of each slice and of each word bucket."""
    rows = evals(spark, sf_dir).withColumn("chrf", metrics.chrf("hyp", "ref"))
    s = metrics.bleu_stats(rows, keep=["doc_id", "split", "slice", "ref", "chrf"])
    out = resample.slice_intervals(_parts(s).filter("kind <> 'long'"), "doc_id", ["split", "kind", "label"], "chrf", DRAWS, "b")
    return _round(out, "bleu", "bleu_low", "bleu_high", "mean", "mean_low", "mean_high")


@query("b08_g57_paired_parts")
def b08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two systems on the same draws, in every set, its slices, its word buckets and its long rows."""
    both = evals(spark, sf_dir)
    a = metrics.bleu_stats(both, "hyp", keep=["doc_id", "split", "slice", "ref"])
    b = metrics.bleu_stats(both, "hyp_b", keep=["doc_id"]).select("doc_id", *(F.col(s).alias(f"b_{s}") for s in metrics.STATS))
    keys = ["split", "kind", "label"]
    sums = resample.resampled_sums(_parts(a.join(b, "doc_id")), "doc_id", [*metrics.STATS, *(f"b_{s}" for s in metrics.STATS)], DRAWS, "b", keys)
    return _round(resample.paired(sums.select(*keys, "rep", metrics.bleu("b_").alias("b"), metrics.bleu().alias("a")), "b", "a", DRAWS, keys), "low", "high", "p")


@query("b16_r2", f"WITH {_DOCS} SELECT lang, round(regr_r2(n_chars, n), 6) AS r2, round(regr_slope(n_chars, n), 6) AS slope FROM d GROUP BY lang")
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_docs(spark, sf_dir).groupBy("lang").agg(F.regr_r2("n_chars", "n").alias("r2"), F.regr_slope("n_chars", "n").alias("slope")), "r2", "slope")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.length("text").cast("double").alias("y"), T.punct_density(F.col("text")).alias("punct"), T.word_count(F.col("text")).cast("double").alias("words"), (F.col("lang") == "en").cast("double").alias("is_en"))


@query("b09_b18_ols_hc3")
def b09(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = regression.ols(_features(spark, sf_dir), "y", ["punct", "words", "is_en"])
    return spark.createDataFrame([(k, *(round(x, 6) for x in v)) for k, v in got.items()], "term string, coef double, se double, p double")


@query("b10_b13_shapley")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = regression.shapley_r2(_features(spark, sf_dir), "y", ["punct", "words", "is_en"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "term string, share double")


@query("b15_b17_vif")
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = regression.vif(_features(spark, sf_dir), ["punct", "words", "is_en"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "term string, vif double")


@query("o01_bottom_k", f"WITH {_DOCS}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) AS rank FROM d) SELECT * FROM r WHERE rank <= 2")
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("n", "doc_id")
    return _docs(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 2").select("doc_id", "source", "rank")


@query("o03_o05_o13_argmax", f"WITH {_DOCS}, b AS (SELECT lang, max(n) AS best FROM d GROUP BY lang) SELECT lang, min(doc_id) AS doc_id FROM d JOIN b USING (lang) WHERE best - n <= 1 GROUP BY lang")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.argmax(_docs(spark, sf_dir), ["lang"], "n", "doc_id", 1)


@query("o11_bands", "WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, w) AS rank FROM c) SELECT w, CASE WHEN rank <= 10 THEN 5 WHEN rank <= 100 THEN 4 WHEN rank <= 1000 THEN 3 WHEN n > 1 THEN 2 ELSE 1 END AS band FROM r")
def o11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of words by rank. Only the thousand most frequent need a rank, so no window over all words is built."""
    counts = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "w").limit(1000).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "w"))).select("w", "rank")
    band = F.when(F.col("rank") <= 10, 5).when(F.col("rank") <= 100, 4).when(F.col("rank") <= 1000, 3).when(F.col("n") > 1, 2).otherwise(1)
    return counts.join(F.broadcast(top), "w", "left").select("w", band.alias("band"))  # a thousand words


@query("o12_mbr_utilities")
def o12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).alias("pool"), F.col("item_id").alias("ord"), "text")
    return _round(metrics.mbr_utilities(pools), "utility")


@query("o15_ntile", f"WITH {_DOCS}, t AS (SELECT ntile(10) OVER (PARTITION BY lang ORDER BY n, doc_id) AS decile, lang, n_chars FROM d) SELECT lang, CAST(decile AS BIGINT) AS decile, count(*) AS n, round(avg(n_chars), 6) AS mean FROM t GROUP BY ALL")
def o15(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy("n", "doc_id")
    return _round(_docs(spark, sf_dir).withColumn("decile", F.ntile(10).over(w).cast("long")).groupBy("lang", "decile").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")), "mean")


@query("o16_o18_candidates", "SELECT alpha, beam, CAST(row_number() OVER (ORDER BY alpha, beam) AS BIGINT) AS ord FROM (SELECT CAST(unnest([0.0, 0.5, 1.0]) AS DOUBLE) AS alpha), (SELECT unnest([1, 4, 8]) AS beam)")
def o18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, b) for a in (0.0, 0.5, 1.0) for b in (1, 4, 8)]
    return spark.createDataFrame([(a, b, k + 1) for k, (a, b) in enumerate(rows)], "alpha double, beam int, ord long")


_RISE = "prev AS (SELECT *, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), run AS (SELECT *, sum(CASE WHEN value > p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM prev)"


@query("z01_rise_runs", f"WITH {_RISE} SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) - 1 AS rises FROM run GROUP BY user_id, r HAVING count(*) > 2")
def z01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rise_runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")


@query(
    "z02_z04_rise_counter",
    """WITH m AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM events), f AS (SELECT *, CASE WHEN value > lo THEN 1 ELSE 0 END AS rise FROM m),
    g AS (SELECT *, sum(1 - rise) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f), c AS (SELECT user_id, event_id, CAST(sum(rise) OVER (PARTITION BY user_id, run ORDER BY event_id) AS BIGINT) AS rises FROM g) SELECT *, rises >= 2 AS flag FROM c""",
)
def z04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rise_counter(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", "rises", "flag")


_STEPPED = "e AS (SELECT user_id, event_id, event_id % 97 AS step, value FROM events)"


def _stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 97).alias("step"), "value")


@query("z03_resets", f"WITH {_STEPPED}, l AS (SELECT *, step < lag(step) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e), r AS (SELECT user_id, count(*) FILTER (b) AS resets FROM l GROUP BY user_id), t AS (SELECT user_id, count(*) FILTER (n > 1) AS repeated FROM (SELECT user_id, step, count(*) AS n FROM e GROUP BY ALL) GROUP BY user_id) SELECT * FROM r JOIN t USING (user_id)")
def z03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.resets(_stepped(spark, sf_dir), ["user_id"], "event_id", "step")


@query("z05_z06_last_per_step", f"WITH {_STEPPED} SELECT user_id, step, arg_max(value, event_id) AS value FROM e GROUP BY ALL")
def z05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.last_per_step(_stepped(spark, sf_dir), ["user_id"], "step", "event_id").select("user_id", "step", "value")


@query("p09_rising_only", f"WITH {_STEPPED}, t AS (SELECT *, max(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT user_id, event_id, step FROM t WHERE top IS NULL OR step >= top")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rising_only(_stepped(spark, sf_dir), ["user_id"], "event_id", "step").select("user_id", "event_id", "step")


@query("z09_retained", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 3 OR event_id IN (100, 500) OR event_id >= 9900")
def z09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.retained(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 3, [100, 500], 9900)


@query("z07_series", "SELECT event_type, list({'step': event_id, 'value': value} ORDER BY event_id)[1].step AS first_step, count(*) AS points FROM events GROUP BY event_type")
def z07(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(F.struct("event_id", "value")).alias("head"), F.count("*").alias("points"))
    return series.select("event_type", F.col("head.event_id").alias("first_step"), "points")


STEP = 25_000


def _stepped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    chunks = max(1, -(-docs.count() // batching.CHUNK))
    batches = batching.padded(batching.plan_batches(docs.select("doc_id", "n"), "doc_id", "n", 8192, "0", chunks), "n")
    return batching.stepped(batches, STEP, "0")


@query("z10_z13_batches")
def z10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in their shuffled order, each with its step; z13_epoch_totals has the totals."""
    return _stepped_batches(spark, sf_dir)


@query("z13_epoch_totals")
def z13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(batching.replayed(_stepped_batches(spark, sf_dir), STEP, 8192), "median", "p99", "padding_share")


@query("z14_chunks", "SELECT doc_id // 250 AS chunk, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL")
def z14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(batching.chunk_bounds(F.col("doc_id"), 250).alias("chunk")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("z15_z16_joined_and_padded", "WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS s FROM benchmark), j AS (SELECT a.item_id, (a.s || b.s)[1:40] AS s FROM t a JOIN t b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark)) SELECT item_id, array_to_string(s || [3] || CASE WHEN len(s) < 40 THEN list_transform(range(40 - len(s)), lambda x: 0) ELSE [] END, ',') AS padded FROM j")
def z15(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", F.transform(F.split("text", " "), lambda x: F.length(x).cast("long")).alias("s"))
    places = t.select("item_id", F.posexplode(F.array("item_id", (F.col("item_id") + 1) % F.lit(t.count()))).alias("place", "partner"))
    both = batching.joined_rows(t, places, "item_id", "s", 40)
    return both.select("item_id", F.array_join(F.transform(batching.pad(F.col("s"), F.lit(41), 3, 0), lambda x: x.cast("string")), ",").alias("padded"))
