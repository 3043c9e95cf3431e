"""Cleaning, guarding, sampling and checking the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import checks, clean, guard, sampling
from lexiflow.plans.registry import EVAL_SQL, PAIRS_SQL, SQL_WS, evals, pairs, query
from lexiflow.sources.tables import table

_KEY_SQL = r"nullif(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g'), '')"
SETS = ["s0", "s1", "s2"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as two-sided rows: the line, and the next one of its document."""
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "src"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return each.select((F.col("doc_id") * F.lit(1 << 31) + F.col("pos")).alias("ord"), "src", F.coalesce(F.lead("src").over(w), F.lit("")).alias("tgt"))


LINES_SQL = """lines AS (
  SELECT doc_id * 2147483648 + pos AS ord, src, coalesce(lead(src) OVER (PARTITION BY doc_id ORDER BY pos), '') AS tgt FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS src, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""
INDEX_SQL = f"""protected AS (SELECT 's' || (item_id % 3) AS set, unnest(string_split(text, chr(10))) AS text FROM benchmark),
idx AS (SELECT DISTINCT set, 'exact' AS kind, text AS value, text AS target FROM protected UNION SELECT DISTINCT set, 'key', {_KEY_SQL.format('text')}, text FROM protected WHERE {_KEY_SQL.format('text')} IS NOT NULL),
probes AS (SELECT ord, 'src' AS side, 'exact' AS kind, src AS value FROM lines UNION ALL SELECT ord, 'src', 'key', {_KEY_SQL.format('src')} FROM lines
  UNION ALL SELECT ord, 'tgt', 'exact', tgt FROM lines UNION ALL SELECT ord, 'tgt', 'key', {_KEY_SQL.format('tgt')} FROM lines),
hits AS (SELECT p.ord, p.side, i.set, i.kind, i.target FROM probes p JOIN idx i ON p.kind = i.kind AND p.value = i.value),
found AS (SELECT ord, set, CASE WHEN bool_or(kind = 'exact') THEN 'exact' ELSE 'near_dup' END AS match_type,
  CASE WHEN bool_or(side = 'src') AND bool_or(side = 'tgt') THEN 'both' WHEN bool_or(side = 'src') THEN 'src' ELSE 'tgt' END AS side FROM hits GROUP BY ord, set)"""
GUARD_SQL = f"WITH {LINES_SQL}, {INDEX_SQL}"


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages, line by line, as three protected sets."""
    bench = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string")).alias("set"), F.explode(F.split("text", "\n")).alias("text"))
    return guard.match_index(bench)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.matches(lines(spark, sf_dir), index(spark, sf_dir), ["src", "tgt"])


_STEPS_SQL = rf"""WITH {PAIRS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY ord) AS rn,
  length(regexp_replace(src, '{SQL_WS}', '', 'g')) AS sa, length(regexp_replace(src, '[\p{{L}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')) AS oa,
  length(regexp_replace(tgt, '{SQL_WS}', '', 'g')) AS sb, length(regexp_replace(tgt, '[\p{{L}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')) AS ob FROM pairs),
t AS (SELECT ord, CASE WHEN coalesce(src, '') = '' OR coalesce(tgt, '') = '' THEN 'empty' WHEN rn > 1 THEN 'duplicate' WHEN src = tgt THEN 'equal'
  WHEN NOT (length(src) / length(tgt) BETWEEN 1.0 / 3 AND 3.0) THEN 'ratio' WHEN oa > 0.5 * sa OR ob > 0.5 * sb THEN 'non_letter' END AS step FROM n)"""


@query("p01_p05_steps", _STEPS_SQL + " SELECT ord, step FROM t")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.tag_steps(pairs(spark, sf_dir)).select("ord", "step")


#: Pairs held out by the cascade.
HELD = 20


def _hit_sql(rows: str, index: str) -> str:
    """Ids of the rows that match an index on either side, by exact text or key."""
    return " UNION ".join(f"SELECT ord FROM {rows} JOIN {index} i ON i.kind = '{kind}' AND i.value = {value}" for side in ("src", "tgt") for kind, value in (("exact", side), ("key", _KEY_SQL.format(side))))


_CASCADE_SQL = (
    _STEPS_SQL
    + ", "
    + INDEX_SQL.split(",\nprobes")[0]
    + f""", alive AS (SELECT p.ord, src, tgt FROM pairs p JOIN t USING (ord) WHERE step IS NULL), g AS ({_hit_sql("alive", "idx")}),
    clear AS (SELECT * FROM alive WHERE ord NOT IN (SELECT ord FROM g)), held AS (SELECT * FROM clear ORDER BY md5('h:' || ord), ord LIMIT {HELD}),
    texts AS (SELECT src AS text FROM held UNION ALL SELECT tgt FROM held),
    hidx AS (SELECT 'exact' AS kind, text AS value FROM texts UNION SELECT 'key', {_KEY_SQL.format("text")} FROM texts WHERE {_KEY_SQL.format("text")} IS NOT NULL), m AS ({_hit_sql("clear", "hidx")}),
    c AS (SELECT ord, coalesce(step, CASE WHEN ord IN (SELECT ord FROM g) THEN 'guard' WHEN ord IN (SELECT ord FROM held) THEN 'holdout' WHEN ord IN (SELECT ord FROM m) THEN 'holdout_match' END) AS step FROM t)"""
)


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps over the pairs, guarded against the benchmark."""
    return clean.cascade(pairs(spark, sf_dir), index(spark, sf_dir), HELD, "h")


@query("p06_j09_cascade", _CASCADE_SQL + " SELECT ord, step FROM c")
def p06_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).select("ord", "step")


@query(
    "p06_filter_table",
    _CASCADE_SQL
    + """, s AS (SELECT * FROM (VALUES (0, 'empty'), (1, 'duplicate'), (2, 'equal'), (3, 'ratio'), (4, 'non_letter'), (5, 'guard'), (6, 'holdout'), (7, 'holdout_match')) v(place, step)),
    k AS (SELECT place, s.step, (SELECT count(*) FROM c WHERE c.step = s.step) AS removed FROM s)
    SELECT step, removed, (SELECT count(*) FROM c) - CAST(sum(removed) OVER (ORDER BY place) AS BIGINT) AS remaining FROM k""",
)
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.filter_table(_cascade(spark, sf_dir))


@query("p07_p08_prefix", f"WITH {EVAL_SQL} SELECT doc_id, slice FROM evals WHERE split = 'e1' AND doc_id < 300")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a set whose every id is checked first: of the set, and with a reference."""
    whole = evals(spark, sf_dir).filter("split = 'e1'").select("doc_id", "slice")
    labels = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id")
    return checks.labelled(whole, labels, "doc_id", F.col("doc_id") % 3 == 0).filter("doc_id < 300")


@query("p10_rows_with_loss", "SELECT event_id, value FROM events WHERE value IS NOT NULL")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", "value")


@query("j01_j03_joined_predictions", f"WITH {EVAL_SQL} SELECT d.doc_id, d.lang, coalesce(e.hyp, '') AS hyp, l.quality FROM documents d LEFT JOIN (SELECT * FROM evals WHERE doc_id % 7 <> 0) e USING (doc_id) JOIN labels l USING (doc_id)")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evals(spark, sf_dir).filter("doc_id % 7 <> 0").select("doc_id", "hyp")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(made, "doc_id", "left").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "lang", F.coalesce("hyp", F.lit("")).alias("hyp"), "quality")


@query("j02_j15_j16_strict_join", f"WITH {EVAL_SQL} SELECT doc_id, text, hyp FROM documents JOIN evals USING (doc_id)")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.strict_join(table(spark, sf_dir, "documents").select("doc_id", "text"), evals(spark, sf_dir).select("doc_id", "hyp"), "doc_id")


@query("j04_j07_guard", GUARD_SQL + " SELECT ord, src FROM lines WHERE ord NOT IN (SELECT ord FROM found)")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.guard(lines(spark, sf_dir), index(spark, sf_dir), ["src", "tgt"]).select("ord", "src")


@query("j05_j06_j19_matches", GUARD_SQL + " SELECT * FROM found")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


@query(
    "j04_guard_counts",
    GUARD_SQL
    + """, r AS (SELECT ord, bool_or(match_type = 'exact') AS e FROM found GROUP BY ord)
    SELECT 'exact' AS what, count(*) FILTER (e) AS n FROM r UNION ALL SELECT 'near_dup_only', count(*) FILTER (NOT e) FROM r UNION ALL SELECT 'set:' || set, count(DISTINCT ord) FROM found GROUP BY set""",
)
def j04_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.guard_counts(found(spark, sf_dir))


@query(
    "j08_j21_targets",
    GUARD_SQL
    + """, o AS (SELECT ord, set, side, target, max(kind = 'exact') AS e FROM hits GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ord, set, side ORDER BY e DESC, target) AS rank FROM o)
    SELECT ord, set, side, rank, target FROM k WHERE rank <= 3""",
)
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.targets(lines(spark, sf_dir), index(spark, sf_dir), ["src", "tgt"])


@query(
    "f51_j20_merged_sets",
    GUARD_SQL
    + """SELECT ord, CASE WHEN set = 's0' THEN 'a' ELSE 'b' END AS set, CASE WHEN bool_or(match_type = 'exact') THEN 'exact' ELSE 'near_dup' END AS match_type,
    CASE WHEN bool_or(side IN ('src', 'both')) AND bool_or(side IN ('tgt', 'both')) THEN 'both' WHEN bool_or(side IN ('src', 'both')) THEN 'src' ELSE 'tgt' END AS side FROM found GROUP BY ALL""",
)
def f51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.merged(found(spark, sf_dir), group=F.when(F.col("set") == "s0", "a").otherwise("b"))


@query("g07_o14_by_priority", GUARD_SQL + " SELECT ord, set, match_type, side FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY CASE set WHEN 's2' THEN 0 WHEN 's0' THEN 1 ELSE 2 END) AS n FROM found) WHERE n = 1")
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.by_priority(found(spark, sf_dir), ["s2", "s0", "s1"])


@query(
    "g06_g09_breakdown",
    GUARD_SQL
    + """, g AS (SELECT * FROM (SELECT unnest(['s0', 's1', 's2']) AS set), (SELECT unnest(['all', 'exact', 'near_dup']) AS match_type), (SELECT unnest(['all', 'src', 'tgt', 'both']) AS side))
    SELECT g.set, g.match_type, g.side, (SELECT count(*) FROM found f WHERE f.set = g.set AND (g.match_type = 'all' OR f.match_type = g.match_type) AND (g.side = 'all' OR f.side = g.side)) AS n FROM g""",
)
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.breakdown(found(spark, sf_dir), SETS)


@query(
    "g08_word_buckets",
    GUARD_SQL
    + rf""", b AS (SELECT l.ord, len(list_filter(string_split(trim(regexp_replace(src, '{SQL_WS}+', ' ', 'g')), ' '), lambda x: x <> '')) AS n, f.m FROM lines l LEFT JOIN (SELECT ord, CASE WHEN bool_or(match_type = 'exact') THEN 'exact' ELSE 'near_dup' END AS m FROM found GROUP BY ord) f USING (ord))
    SELECT CASE WHEN n <= 3 THEN '1-3' WHEN n <= 10 THEN '4-10' ELSE '>10' END AS bucket, count(*) AS pool, count(*) FILTER (m = 'exact') AS exact, count(*) FILTER (m = 'near_dup') AS near_dup, round(count(m) / count(*), 6) AS removed FROM b GROUP BY ALL""",
)
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = guard.merged(found(spark, sf_dir)).select("ord", F.col("match_type").alias("m"))
    rows = lines(spark, sf_dir).join(kind, "ord", "left").groupBy(T.word_bucket(T.word_count(F.col("src"))).alias("bucket"))
    return rows.agg(F.count("*").alias("pool"), F.count_if(F.col("m") == "exact").alias("exact"), F.count_if(F.col("m") == "near_dup").alias("near_dup"), F.round(F.count("m") / F.count("*"), 6).alias("removed"))


@query("g10_g11_combinations", GUARD_SQL + ", c AS (SELECT ord, string_agg(set, '+' ORDER BY set) AS sets FROM found GROUP BY ord) SELECT sets, count(*) AS n, min(ord) AS first FROM c GROUP BY sets")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = found(spark, sf_dir).groupBy("ord").agg(F.array_join(F.array_sort(F.collect_list("set")), "+").alias("sets"))
    return sets.groupBy("sets").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


@query(
    "j09_holdout",
    """WITH s AS (SELECT doc_id, text FROM documents WHERE length(text) > 200 ORDER BY md5('h:' || doc_id), doc_id LIMIT 50)
    SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM s) THEN 'holdout' WHEN text IN (SELECT text FROM s) THEN 'match' ELSE 'train' END AS part FROM documents""",
)
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.length("text").alias("n"))
    held = F.broadcast(sampling.sample(docs.filter("n > 200"), "doc_id", 50, "h"))  # 50 rows
    ids, keys = held.select(F.col("doc_id").alias("held_id")), held.select(F.col("key").alias("held_key")).distinct()
    joined = docs.join(ids, docs.doc_id == F.col("held_id"), "left").join(keys, docs.key == F.col("held_key"), "left")
    return joined.select("doc_id", F.when(F.col("held_id").isNotNull(), "holdout").when(F.col("held_key").isNotNull(), "match").otherwise("train").alias("part"))


@query("o06_o20_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, "7")


@query(
    "o07_stratified",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('c:' || doc_id), doc_id) AS n FROM documents)
    SELECT doc_id, lang FROM r WHERE n <= CASE lang WHEN 'en' THEN 20 WHEN 'fr' THEN 10 WHEN 'de' THEN 20 END""",
)
def o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 20, "fr": 10, "de": 20}, "c")


@query("o08_rotation", "WITH s AS (SELECT doc_id FROM documents ORDER BY md5('d:' || doc_id), doc_id LIMIT 50) SELECT doc_id, coalesce(lead(doc_id) OVER (ORDER BY md5('d:' || doc_id), doc_id), first_value(doc_id) OVER (ORDER BY md5('d:' || doc_id), doc_id)) AS moved FROM s")
def o08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rotated(sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, "d"), "doc_id", "doc_id", "d")


@query("o09_g51_disjoint", "WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('p:' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 40 THEN 'latency' WHEN n <= 50 THEN 'warmup' ELSE 'throughput' END AS part FROM s WHERE n <= 110")
def o09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.disjoint(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"latency": 40, "warmup": 10, "throughput": 60}, "p")


@query("u01_u04_unions", "SELECT DISTINCT lang AS name FROM documents UNION SELECT DISTINCT event_type FROM events")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).unionByName(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))).distinct()


@query("u02_u03_distinct_mapping", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS first FROM documents")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "lang")
    return checks.distinct_with_mapping(docs, ["key", "lang"], "doc_id")[1]


@query("u05_u07_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query(
    "j10_j13_mismatches",
    """WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 50 <> 0 GROUP BY source)
    SELECT source, a.n AS left, b.n AS right FROM a FULL JOIN b USING (source) WHERE a.n IS DISTINCT FROM b.n""",
)
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    count = lambda df: df.groupBy("source").agg(F.count("*").alias("n"))
    return checks.mismatches(count(docs), count(docs.filter("doc_id % 50 <> 0")), "source", "n")


@query("j12_differences", "WITH a AS (SELECT user_id, sum(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, sum(value) AS s FROM events WHERE event_id % 2 = 1 GROUP BY user_id) SELECT user_id, round(abs(a.s - b.s), 4) AS diff FROM a JOIN b USING (user_id)")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("event_id") % 2
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(odd == 0, F.col("value"))).alias("a"), F.sum(F.when(odd == 1, F.col("value"))).alias("b"))
    return sums.filter("a IS NOT NULL AND b IS NOT NULL").select("user_id", F.round(F.abs(F.col("a") - F.col("b")), 4).alias("diff"))


@query("v01_v03_v06_inconsistent", "SELECT text AS key, count(DISTINCT source) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.inconsistent(table(spark, sf_dir, "documents").withColumnRenamed("text", "key"), "key", "source")
