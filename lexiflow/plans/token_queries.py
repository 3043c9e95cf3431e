"""Subwords, files, streams and the cache, over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import subwords
from lexiflow.functions import text as T
from lexiflow.plans.registry import EVAL_SQL, evals, query
from lexiflow.sources import files
from lexiflow.sources.tables import table

#: Where the tokens are words, ids are 32-bit hashes of lower-case words modulo a vocabulary.
VOCAB = 5000


def _ids(c):
    return F.transform(T.words(F.lower(c)), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % VOCAB).cast("int"))


_IDS = rf"list_transform(regexp_extract_all(lower({{}}), '[\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda w: CAST(CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % {VOCAB} AS INT))"


@query("f15_untranslated", f"WITH {EVAL_SQL}, t AS (SELECT doc_id, {_IDS.format('hyp')} AS h, {_IDS.format('ref')} AS s FROM evals) SELECT doc_id, round(CASE WHEN len(h) > 0 THEN len(list_filter(h, lambda x: list_contains(s, x) AND NOT x < 4000)) / len(h) ELSE 0.0 END, 6) AS share FROM t")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing and lookup are Arrow functions: a lambda would go through the source's words, and hash them anew, for every word of the hypothesis."""
    ids = subwords.word_numbers(VOCAB)
    share = subwords.untranslated(range(4000))(ids(F.lower("hyp")), ids(F.lower("ref")))
    return evals(spark, sf_dir).select("doc_id", F.round(share, 6).alias("share"))


@query(
    "f16_g28_source_rarity",
    f"""WITH t AS (SELECT doc_id, {_IDS.format('text')} AS ids FROM documents), e AS (SELECT doc_id, unnest(ids) AS id FROM t), c AS (SELECT id, count(*) AS n FROM e WHERE doc_id % 2 = 0 GROUP BY id),
    g AS (SELECT doc_id, avg(coalesce(n, 0)) AS mean, min(coalesce(n, 0)) AS least, avg(CASE WHEN id < 16 THEN 1.0 ELSE 0.0 END) AS b FROM e LEFT JOIN c USING (id) GROUP BY doc_id)
    SELECT doc_id, round(coalesce(mean, 0), 4) AS mean, CAST(coalesce(least, 0) AS DOUBLE) AS least, round(coalesce(b, 0), 6) AS byte_share FROM t LEFT JOIN g USING (doc_id)""",
)
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id", _ids(F.col("text")).alias("ids"))
    counts = ids.filter("doc_id % 2 = 0").select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    return subwords.source_rarity(ids, "doc_id", "ids", counts, list(range(16))).select("doc_id", F.round("mean", 4).alias("mean"), "least", F.round("byte_share", 6).alias("byte_share"))


@query("f29_f30_round_trip")
def f29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every passage and the text they decode to. Needs a model file; without the public ones there is nothing to read."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    got = table(spark, sf_dir, "benchmark").select("item_id", "text", subwords.encoder(model)("text").alias("ids"))
    return got.select("item_id", F.size("ids").cast("long").alias("n"), (subwords.decoder(model)("ids") == F.col("text")).alias("same"))


@query("y05_blocked_tokens", "WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x) % 5) AS h FROM benchmark), p AS (SELECT item_id, h, unnest(range(1, len(h) - 1)) AS i FROM t), b AS (SELECT DISTINCT item_id, h[i + 2] AS x FROM p WHERE h[i] = h[len(h) - 1] AND h[i + 1] = h[len(h)]) SELECT item_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS blocked FROM b GROUP BY item_id")
def y05(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "benchmark").select("item_id", F.transform(F.split("text", " "), lambda x: F.length(x) % 5).alias("h"))
    got = h.select("item_id", F.array_sort(subwords.blocked_tokens(F.col("h"), 3)).alias("b")).filter(F.size("b") > 0)
    return got.select("item_id", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("blocked"))


@query("y02_segment_and_rejoin", "SELECT doc_id, text AS rejoined FROM documents")
def y02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts go through a per-segment step and come back in order; a model would be that step."""
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "part"))
    done = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("ps"))
    return done.select("doc_id", F.array_join(F.transform("ps", lambda p: p["part"]), "\n").alias("rejoined"))


@query("s12_synthetic_copies")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.synthetic_copies(spark, 64, 64)


@query("s01_s02_k01_jsonl_round_trip", "SELECT item_id, text FROM benchmark")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages by way of gzipped JSON lines in the session's shared folder."""
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or "/tmp"
    path = f"{top.rstrip('/')}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf_dir, "benchmark"), path, gzip=True)
    return files.read_jsonl(spark, path, "item_id long, text string", ["item_id", "text"])


@query("s06_s09_step_rows", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value IS NOT NULL")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    marked = ev.select("event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("tok_per_sec"), F.lit(None).cast("double").alias("eval"))
    return marked.filter("tok_per_sec IS NOT NULL AND eval IS NULL").select("event_id", F.col("tok_per_sec").alias("value"))


@query("o02_rule_examples", f"WITH {EVAL_SQL}, r AS (SELECT doc_id, slice, length(hyp) / length(ref) AS q, length(hyp) AS n FROM evals), a AS (SELECT slice, arg_min(doc_id, {{'a': -abs(q - 1), 'b': doc_id}}) AS x FROM r GROUP BY slice), b AS (SELECT slice, arg_min(doc_id, {{'a': -n, 'b': doc_id}}) AS y FROM r WHERE doc_id NOT IN (SELECT x FROM a) GROUP BY slice) SELECT slice, x, y FROM a JOIN b USING (slice)")
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evals(spark, sf_dir).select("doc_id", "slice", (F.length("hyp") / F.length("ref")).alias("q"), F.length("hyp").alias("n"))
    x = r.groupBy("slice").agg(F.min_by("doc_id", F.struct(-F.abs(F.col("q") - 1), F.col("doc_id"))).alias("x"))
    rest = r.join(x, "slice").filter("doc_id <> x")
    return rest.groupBy("slice", "x").agg(F.min_by("doc_id", F.struct(-F.col("n"), F.col("doc_id"))).alias("y"))


@query("o10_bucketed_joins")
def o10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring passages in a hash order, joined, up to five for each length bucket."""
    w = Window.partitionBy(F.col("item_id") % 4).orderBy(F.md5(F.concat(F.lit("s:"), F.col("item_id").cast("string"))))
    both = table(spark, sf_dir, "benchmark").select("item_id", F.lead("item_id").over(w).alias("next_id"), F.concat_ws(" ", "text", F.lead("text").over(w)).alias("text")).filter("next_id IS NOT NULL")
    marked = both.withColumn("bucket", F.floor(F.length("text") / 200))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("item_id"))
    return marked.withColumn("n", n).filter("n <= 5").drop("n")
