"""Scalar text functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import formulas as X
from lexiflow.functions import text as T
from lexiflow.plans.registry import EVAL_SQL, PAIRS_SQL, SQL_WORD, SQL_WS, evals, pairs, query
from lexiflow.sources.tables import table

STOP = ["the", "of", "and", "to", "in", "is", "a", "le", "la", "de", "les", "et", "der", "die", "und", "el", "que"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


def _squeezed(column: str) -> str:
    plain = "''" * 3 + '"' * 4
    return rf"trim(regexp_replace(translate({column}, '’‘ʼ«»“”', '{plain}'), '{SQL_WS}+', ' ', 'g'))"


def _r(c, n: int = 6):
    return F.round(c.cast("double"), n)


@query("f01_normalize_text", f"WITH {PAIRS_SQL} SELECT ord, {_squeezed('src')} AS src_norm, {_squeezed('tgt')} AS tgt_norm FROM pairs")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("ord", T.normalize_text(F.col("src")).alias("src_norm"), T.normalize_text(F.col("tgt")).alias("tgt_norm"))


@query("f02_near_dup_key", r"SELECT doc_id, nullif(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '') AS key FROM documents")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.near_dup_key(F.col("text")).alias("key"))


@query(
    "f03_f04_pair_checks",
    rf"""WITH {PAIRS_SQL}, n AS (SELECT *, length(regexp_replace(src, '{SQL_WS}', '', 'g')) AS solid, length(regexp_replace(src, '[\p{{L}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')) AS other FROM pairs)
    SELECT ord, round(CASE WHEN solid = 0 THEN 1.0 ELSE other / solid END, 6) AS non_letter,
      length(src) > 0 AND length(tgt) > 0 AND length(src) / length(tgt) BETWEEN 1.0 / 3 AND 3.0 AS ratio_ok FROM n""",
)
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("ord", _r(T.non_letter_fraction(F.col("src"))).alias("non_letter"), T.length_ratio_ok(F.col("src"), F.col("tgt")).alias("ratio_ok"))


@query(
    "f05_f09_counts_and_buckets",
    rf"""WITH n AS (SELECT doc_id, length(text) AS n_chars, len(list_filter(string_split(trim(regexp_replace(text, '{SQL_WS}+', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM documents)
    SELECT doc_id, n AS n_words, CASE WHEN n <= 3 THEN '1-3' WHEN n <= 10 THEN '4-10' ELSE '>10' END AS word_bucket,
      CASE WHEN n <= 10 THEN '<=10' WHEN n <= 20 THEN '11-20' WHEN n <= 40 THEN '21-40' WHEN n <= 80 THEN '41-80' ELSE '>80' END AS length_bucket,
      CASE WHEN n <= 10 THEN '<=10' WHEN n <= 20 THEN '11-20' WHEN n <= 40 THEN '21-40' WHEN n <= 80 THEN '41-80' WHEN n <= 160 THEN '81-160' WHEN n <= 256 THEN '161-256' ELSE '>256' END AS token_bin,
      CASE WHEN n_chars BETWEEN 400 AND 599 THEN '400-600' WHEN n_chars BETWEEN 600 AND 799 THEN '600-800' WHEN n_chars BETWEEN 800 AND 899 THEN '800-900' END AS char_bucket FROM n""",
)
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_words")
    docs = table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.length("text").alias("chars"))
    return docs.select("doc_id", "n_words", T.word_bucket(n).alias("word_bucket"), T.length_bucket(n).alias("length_bucket"), T.token_bin(n).alias("token_bin"), T.char_bucket(F.col("chars")).alias("char_bucket"))


@query(
    "f10_f11_words_and_ngrams",
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{SQL_WORD}') AS ws FROM documents)
    SELECT doc_id, len(ws) AS n_words, greatest(len(ws) - 1, 0) AS n_bigrams, CASE WHEN len(ws) >= 2 THEN array_to_string(ws[len(ws) - 1:], '_') END AS last_bigram FROM w""",
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("ws"))
    g = w.withColumn("g", T.ngrams(F.col("ws"), 2))
    return g.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.size("g").cast("long").alias("n_bigrams"), F.array_join(F.try_element_at("g", F.lit(-1)), "_").alias("last_bigram"))


@query(
    "f12_f14_hypothesis_checks",
    rf"""WITH {EVAL_SQL}, w AS (SELECT doc_id, regexp_extract_all(hyp, '{SQL_WORD}') AS h, regexp_extract_all(ref, '{SQL_WORD}') AS r FROM evals),
    g AS (SELECT *, CASE WHEN len(h) >= 3 THEN list_transform(range(1, len(h) - 1), lambda i: h[i:i+2]) ELSE [] END AS g FROM w)
    SELECT doc_id, round(CASE WHEN len(r) > 0 THEN len(h) / len(r) WHEN len(h) = 0 THEN 1.0 ELSE 10.0 END, 6) AS length_ratio,
      round(CASE WHEN len(g) > 0 THEN (len(g) - len(list_distinct(g))) / len(g) ELSE 0.0 END, 6) AS repetition, len(r) > 0 AND len(h) < 0.5 * len(r) AS truncated FROM g""",
)
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, r = F.col("hyp"), F.col("ref")
    return evals(spark, sf_dir).select("doc_id", _r(T.length_ratio(h, r)).alias("length_ratio"), _r(T.repetition_rate(h)).alias("repetition"), T.is_truncated(h, r).alias("truncated"))


@query(
    "f17_f19_nouns_and_punctuation",
    rf"""WITH {EVAL_SQL}, w AS (SELECT doc_id, ref, hyp, list_filter((list_filter(string_split(trim(regexp_replace(ref, '{SQL_WS}+', ' ', 'g')), ' '), lambda x: x <> ''))[2:], lambda x: regexp_matches(x, '^[A-ZÀ-Ý][\p{{L}}\p{{N}}_''-]*$')) AS nouns FROM evals)
    SELECT doc_id, len(nouns) AS n_nouns, round(len(list_filter(nouns, lambda n: contains(lower(hyp), lower(n)))) / nullif(len(nouns), 0), 6) AS copied,
      round(CASE WHEN length(ref) > 0 THEN len(regexp_extract_all(ref, '[.,;:!?"…]')) / length(ref) ELSE 0.0 END, 6) AS punct FROM w""",
)
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = F.col("ref"), F.col("hyp")
    return evals(spark, sf_dir).select("doc_id", F.size(T.proper_nouns(ref)).cast("long").alias("n_nouns"), _r(T.proper_noun_copy_accuracy(ref, hyp)).alias("copied"), _r(T.punct_density(ref)).alias("punct"))


@query("f20_strip_quotes", rf"""WITH {PAIRS_SQL} SELECT ord, rtrim({_squeezed('tgt')}, ' "''') AS stripped FROM pairs""")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("ord", T.strip_quotes(F.col("tgt")).alias("stripped"))


@query(
    "f21_f22_function_words",
    rf"""WITH w AS (SELECT lang, lower(regexp_replace(unnest(string_split(text, ' ')), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')) AS core FROM documents),
    f AS (SELECT lang, core, list_filter(string_split(core, ''''), lambda p: p <> '') AS parts FROM w)
    SELECT lang, count(*) AS n, count(*) FILTER (len(parts) > 0 AND len(list_filter(parts, lambda p: p IN ({_STOP_SQL}))) = len(parts)) AS n_function FROM f GROUP BY lang""",
)
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ")).alias("piece"))
    core = w.select("lang", T.word_core(F.col("piece")).alias("core"))
    return core.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.is_function_word(F.col("core"), STOP)).alias("n_function"))


@query(
    "f23_word_spans",
    """WITH c AS (SELECT item_id, string_split(text, '') AS cs FROM benchmark), f AS (SELECT item_id, unnest(range(1, len(cs) + 1)) AS pos, cs FROM c),
    s AS (SELECT item_id, pos, CASE WHEN pos = 1 OR cs[pos] = ' ' THEN 1 ELSE 0 END AS start FROM f), i AS (SELECT item_id, pos, sum(start) OVER (PARTITION BY item_id ORDER BY pos) AS island FROM s)
    SELECT item_id, CAST(island AS BIGINT) AS island, min(pos) - 1 AS start, max(pos) AS stop FROM i GROUP BY item_id, island""",
)
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiflow.operators.stats import islands

    chars = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("pos", "ch")).filter("ch <> ''")
    marked = chars.withColumn("start", (F.col("pos") == 0) | (F.col("ch") == " "))
    return islands(marked, ["item_id"], "pos", "start").select("item_id", "island", F.col("first").cast("long").alias("start"), (F.col("last") + 1).cast("long").alias("stop"))


@query(
    "f24_f25_register",
    rf"""WITH {PAIRS_SQL}, w AS (SELECT ord, src, tgt, regexp_extract_all(src, '{SQL_WORD}') AS a, regexp_extract_all(tgt, '{SQL_WORD}') AS b FROM pairs),
    r AS (SELECT *, CASE WHEN len(b) > 0 THEN len(a) / len(b) ELSE 99.0 END AS ratio FROM w)
    SELECT ord, round(ratio, 6) AS ratio, ratio < 0.5 OR ratio > 2 AS moderate, ratio < 0.33 OR ratio > 3 AS severe, regexp_matches(src, '^[-–—"«]') AS dialogue,
      round(len(list_filter(a, lambda x: lower(x) IN ('i', 'je', 'ich', 'yo', 'me', 'my'))) / greatest(len(a), 1), 6) AS first_person FROM r""",
)
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = T.ratio_of_words(F.col("src"), F.col("tgt"))
    a = T.words(F.col("src"))
    person = F.size(F.filter(a, lambda x: F.lower(x).isin("i", "je", "ich", "yo", "me", "my"))) / F.greatest(F.size(a), F.lit(1))
    return pairs(spark, sf_dir).withColumn("ratio", ratio).select(
        "ord", _r(F.col("ratio")).alias("ratio"), ((F.col("ratio") < 0.5) | (F.col("ratio") > 2)).alias("moderate"), ((F.col("ratio") < 0.33) | (F.col("ratio") > 3)).alias("severe"), F.col("src").rlike('^[-–—"«]').alias("dialogue"), _r(person).alias("first_person")
    )


@query(
    "f26_f45_word_copies",
    rf"""WITH {PAIRS_SQL}, w AS (SELECT ord, regexp_extract_all(tgt, '{SQL_WORD}') AS h, list_transform(regexp_extract_all(src, '{SQL_WORD}'), lambda x: lower(x)) AS s, list_transform(regexp_extract_all(reverse(tgt), '{SQL_WORD}'), lambda x: lower(x)) AS g FROM pairs)
    SELECT ord, len(list_filter(h, lambda x: length(x) >= 4 AND list_contains(s, lower(x)) AND NOT list_contains(g, lower(x)))) AS n_copied, len(list_filter(h, lambda x: length(x) >= 4)) AS n_long FROM w""",
)
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.word_copies(F.col("tgt"), F.col("src"), F.reverse("tgt"))
    return pairs(spark, sf_dir).select("ord", F.size(got).cast("long").alias("n_copied"), F.size(T.long_words(F.col("tgt"))).cast("long").alias("n_long"))


@query(
    "f27_split_sentences",
    rf"""WITH s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?;:…]){SQL_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10)) <> '') AS parts FROM documents)
    SELECT doc_id, greatest(len(parts), 1) AS n_parts, CASE WHEN len(parts) < 2 THEN text ELSE parts[1] END AS first_part FROM s""",
)
def f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.split_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n_parts"), F.element_at(parts, 1).alias("first_part"))


@query(
    "f28_f42_labels",
    rf"""WITH {EVAL_SQL}, w AS (SELECT doc_id, slice, regexp_extract_all(hyp, '{SQL_WORD}') AS h, regexp_extract_all(ref, '{SQL_WORD}') AS r FROM evals),
    g AS (SELECT *, CASE WHEN len(h) >= 3 THEN list_transform(range(1, len(h) - 1), lambda i: h[i:i+2]) ELSE [] END AS g FROM w),
    f AS (SELECT *, CASE WHEN len(g) > 0 THEN (len(g) - len(list_distinct(g))) / len(g) ELSE 0.0 END AS rep FROM g)
    SELECT doc_id, CASE WHEN len(r) > 0 AND len(h) < 0.5 * len(r) THEN 'truncated' WHEN rep > 0.2 THEN 'repetition' WHEN len(h) < 3 THEN 'untranslated_copy' ELSE 'low_chrf_other' END AS failure,
      CASE WHEN slice IN ('en', 'fr') AND doc_id % 2 = 0 THEN 'both' WHEN slice IN ('en', 'fr') THEN 'src' WHEN doc_id % 2 = 0 THEN 'tgt' END AS side FROM f""",
)
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, r = F.col("hyp"), F.col("ref")
    few = (F.size(T.words(h)) < 3).cast("int")
    return evals(spark, sf_dir).select("doc_id", T.failure_type(T.is_truncated(h, r), T.repetition_rate(h), few).alias("failure"), T.side_label(F.col("slice").isin("en", "fr"), F.col("doc_id") % 2 == 0).alias("side"))


@query("f31_f32_f34_numbers", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, value IS NOT NULL AND isfinite(value) AS is_finite FROM events")
def f31(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.element_at(F.map_filter(F.from_json("props", "map<string,double>"), lambda _, v: T.finite(v)), "k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), T.finite(F.col("value")).alias("is_finite"))


@query("f33_whitelisted_paths", "SELECT event_id, CASE WHEN json_exists(props, '$.k') THEN {'k': json_extract_string(props, '$.k')}.k END AS k FROM events")
def f33(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiflow.sources.files import whitelisted

    return whitelisted(table(spark, sf_dir, "events"), "props", ["k", "absent.path"]).select("event_id", F.col("kept")["k"].alias("k"))


@query(
    "f35_g36_forbidden_patterns",
    r"""WITH h AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS email, len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS phone,
      (SELECT count(*) FROM benchmark b WHERE contains(d.text, b.text)) AS literals FROM documents d)
    SELECT name, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS docs FROM (SELECT unnest(['email', 'phone', 'literals']) AS name, unnest([email, phone, literals]) AS n FROM h) GROUP BY name""",
)
def f35(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiflow.operators.guard import pattern_hits

    literals = [r.text for r in table(spark, sf_dir, "benchmark").select("text").collect()]  # a fixed list of protected passages
    return pattern_hits(table(spark, sf_dir, "documents"), "text", {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"[0-9]{3}-[0-9]{4}"}, literals)


@query("f36_g54_spans", "SELECT user_id, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours FROM events GROUP BY user_id")
def f36(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return got.select("user_id", "n", _r(X.span_hours(F.col("a"), F.col("b"))).alias("hours"))


@query("f37_ordered_digest", "SELECT lang, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY lang")
def f37(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "\n")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sha2(ids, 256).alias("digest"))


@query(
    "f38_f41_formulas",
    """WITH e AS (SELECT event_id AS n, event_id % 7 AS ov, event_id % 11 AS h, event_id % 13 AS r FROM events), p AS (SELECT *, ov / greatest(h, 1) AS p, ov / greatest(r, 1) AS q FROM e)
    SELECT n, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 5 * p * q / (4 * p + q) END, 6) AS f2, round(pow((5 + n) / 6.0, 0.6), 6) AS penalty, CAST(floor(1.5 * n) + 10 AS BIGINT) AS most,
      round(CASE WHEN n < 100 THEN (n + 1) / 100.0 WHEN n < 600 THEN 1.0 WHEN n >= 800 THEN 0.0 ELSE (800 - n) / 200.0 END, 6) AS scale,
      CASE WHEN n % 3 = 0 THEN '< 0.0010' ELSE printf('%.4f', (n % 3) / 4.0) END AS p_text FROM p""",
)
def f38(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.alias("n"), _r(X.f_score(n % 7, n % 11, n % 13)).alias("f2"), _r(X.length_penalty(n, 0.6)).alias("penalty"), X.decode_limit(n).alias("most"), _r(X.wsd_scale(n, 100, 800, 0.25)).alias("scale"), X.p_text((n % 3) / F.lit(4.0), 1000).alias("p_text")
    )


@query(
    "f43_unsafe_paths",
    r"""WITH p AS (SELECT page_id, substr(url, position('://' IN url) + 3) AS a, CASE page_id % 4 WHEN 0 THEN '/' ELSE '' END || CASE page_id % 5 WHEN 0 THEN '../' ELSE '' END AS pre FROM pages), q AS (SELECT page_id, pre || a AS path FROM p)
    SELECT page_id, CASE WHEN contains(path, chr(92)) THEN 'backslash' WHEN contains(path, ':') THEN 'colon' WHEN starts_with(path, '/') THEN 'absolute' WHEN regexp_matches(path, '(^|/)\.{0,2}(/|$)') THEN 'dot part' END AS unsafe FROM q""",
)
def f43(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.when(k % 4 == 0, "/").otherwise(""), F.when(k % 5 == 0, "../").otherwise(""), F.expr("substr(url, position('://' IN url) + 3)"))
    return table(spark, sf_dir, "pages").select("page_id", T.unsafe_path(path).alias("unsafe"))


@query("f44_copy_baseline", "SELECT doc_id, text AS hyp FROM documents")
def f44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("hyp"))


@query("f46_dropped_words", f"WITH {EVAL_SQL} SELECT doc_id, hyp, hyp_b FROM evals")
def f46(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals(spark, sf_dir).select("doc_id", "hyp", "hyp_b")


@query(
    "f48_f49_g52_range_overlap",
    """WITH r AS (SELECT event_type, user_id % 2 AS half, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM events GROUP BY ALL)
    SELECT a.event_type, a.lo <= b.hi AND b.lo <= a.hi AS overlap, round(a.mean / nullif(b.mean, 0), 6) AS ratio, CASE WHEN a.lo <= b.hi AND b.lo <= a.hi THEN 'indistinguishable' WHEN a.mean / nullif(b.mean, 0) < 1 THEN 'faster' ELSE 'slower' END AS verdict
    FROM r a LEFT JOIN r b ON a.event_type = b.event_type AND b.half = 1 WHERE a.half = 0""",
)
def f48(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("user_id") % 2
    ev = table(spark, sf_dir, "events")
    got = ev.groupBy("event_type").agg(*(f(F.when(half == h, F.col("value"))).alias(f"{n}{h}") for h in (0, 1) for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg)))).filter("lo0 IS NOT NULL")
    overlap = X.ranges_overlap(F.col("lo0"), F.col("hi0"), F.col("lo1"), F.col("hi1"))
    ratio = F.col("mean0") / F.nullif(F.col("mean1"), F.lit(0.0))
    return got.select("event_type", overlap.alias("overlap"), _r(ratio).alias("ratio"), X.compared(ratio, overlap, False).alias("verdict"))


_SEED_SQL = "CAST(CAST('0x' || " + " || ".join(f"substr(h, {at}, 2)" for at in range(15, 0, -2)) + " AS UBIGINT) % 9223372036854775808 AS BIGINT)"


@query("f50_row_seed", f"WITH d AS (SELECT doc_id, sha256('7|0|' || doc_id) AS h FROM documents) SELECT doc_id, {_SEED_SQL} AS seed FROM d")
def f50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.row_seed(7, F.col("doc_id"), 0).alias("seed"))


@query(
    "f52_literals",
    """WITH s AS (SELECT DISTINCT v FROM (SELECT unnest(['id' || item_id, text]) AS v, unnest(['id', 'text']) AS k FROM benchmark) WHERE k = 'id' OR length(v) >= 25) SELECT v AS literal FROM s""",
)
def f52(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiflow.sources.files import literals

    rows = table(spark, sf_dir, "benchmark").select(F.to_json(F.create_map(F.lit("id"), F.concat(F.lit("id"), F.col("item_id").cast("string")), F.lit("text"), F.col("text"))).alias("row"))
    return literals(rows, "row")
