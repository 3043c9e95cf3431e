"""Worked examples, identities and plain-Python twins of the library's own operators."""

import json
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiflow.functions import formulas as X
from lexiflow.functions import subwords
from lexiflow.functions import text as T
from lexiflow.operators import batching, checks, clean, guard, logs, metrics, regression, resample, sampling, stats
from lexiflow.session import ship
from lexiflow.sources import files
from lexiflow.sources.tables import table
from lexiflow.streaming import chunk_cache
from lexiflow.streaming.watch import stream_jsonl, watch


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_normalize_text(spark):
    c = F.col("a")
    assert one(spark, T.normalize_text(c), a=" ﬁn de « l’été » 　") == 'fin de " l\'été "'
    assert one(spark, T.near_dup_key(c), a="?!…") is None
    assert one(spark, T.near_dup_key(c), a="1-2 A") == "12a"
    assert one(spark, T.non_letter_fraction(c), a="  ") == 1.0
    assert one(spark, T.word_count(c), a="  ") == 0


@pytest.mark.parametrize(("a", "b", "ok"), [(1, 3, True), (3, 1, True), (1, 4, False), (4, 1, False), (0, 1, False), (1, 0, False)])
def test_length_ratio_bounds(spark, a, b, ok):
    assert one(spark, T.length_ratio_ok(F.col("a"), F.col("b")), a="x" * a, b="y" * b) is ok


def test_word_features(spark):
    ref = "Il voit Anne et Élise, puis ANNE."
    assert one(spark, T.proper_nouns(F.col("a")), a=ref) == ["Anne"]
    assert one(spark, T.proper_noun_copy_accuracy(F.col("a"), F.col("b")), a="x y", b="z") is None
    assert one(spark, T.repetition_rate(F.col("a")), a="a b c a b c") == 0.25
    assert one(spark, T.repetition_rate(F.col("a")), a="a b") == 0.0
    assert one(spark, T.split_sentences(F.col("a")), a="One. Two! Three") == ["One.", "Two!", "Three"]
    assert one(spark, T.split_sentences(F.col("a")), a="One") == ["One"]
    assert one(spark, T.word_copies(F.col("a"), F.col("b"), F.col("c")), a="maison Maison rouge", b="la MAISON rouge", c="red rouge") == ["maison", "Maison"]
    assert one(spark, T.is_function_word(F.col("a"), ["l", "de"]), a="l'de") is True
    assert one(spark, T.is_function_word(F.col("a"), ["l"]), a="'") is False
    assert one(spark, T.strip_quotes(F.col("a")), a="end. \" ' \"") == "end."


def test_formulas(spark):
    assert one(spark, X.f_score(F.col("a"), F.col("b"), F.col("c")), a=0, b=0, c=0) == 0.0
    assert one(spark, X.p_text(F.col("a"), 1000), a=0.0) == "< 0.0010"
    steps = [one(spark, X.wsd_scale(F.col("a"), 10, 100, 0.2), a=s) for s in (0, 9, 50, 80, 90, 100)]
    assert steps == [0.1, 1.0, 1.0, 1.0, 0.5, 0.0]


def test_cleaning_cascade(spark):
    rows = [("", "x"), ("ab", "cd"), ("ab", "cd"), ("same", "same"), ("a", "abcd"), ("a1!!", "b2??"), ("one two", "un deux")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, src string, tgt string")
    tagged = clean.tag_steps(df)
    assert [r.step for r in tagged.orderBy("ord").collect()] == ["empty", None, "duplicate", "equal", "ratio", "non_letter", None]
    table_ = {r.step: (r.removed, r.remaining) for r in clean.filter_table(tagged).collect()}
    assert table_["empty"] == (1, 6) and table_["non_letter"] == (1, 2) and table_["guard"] == (0, 2)


def test_guard_against_plain_sets(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aB1 .?") for _ in range(rng.randint(0, 3)))
    rows = [(i, word(), word()) for i in range(300)]
    protected = [(f"s{i % 3}", word()) for i in range(12)]
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    found = guard.matches(spark.createDataFrame(rows, "ord long, src string, tgt string"), guard.match_index(spark.createDataFrame(protected, "set string, text string")), ["src", "tgt"])
    want = set()
    for i, a, b in rows:
        for s in {p for p, _ in protected}:
            exact = {x for p, x in protected if p == s}
            keys = {key(x) for x in exact} - {""}
            sides = [name for name, v in (("src", a), ("tgt", b)) if v in exact or key(v) in keys]
            if sides:
                want.add((i, s, "exact" if a in exact or b in exact else "near_dup", "both" if len(sides) == 2 else sides[0]))
    assert {tuple(r) for r in found.collect()} == want
    assert {r.what: r.n for r in guard.guard_counts(found).collect()}["exact"] == len({w[0] for w in want if "exact" in {v[2] for v in want if v[0] == w[0]}})


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)], "id long, k string")
    pick = lambda seed: [r.id for r in sampling.sample(df, "id", 10, seed).orderBy("id").collect()]
    assert pick("1") == pick("1") != pick("2")
    assert Counter(r.k for r in sampling.stratified(df, "k", "id", {"a": 3, "b": 100}, "1").collect()) == {"a": 3, "b": 25}
    assert Counter(r.part for r in sampling.disjoint(df, "id", {"x": 5, "y": 7}, "1").collect()) == {"x": 5, "y": 7}
    with pytest.raises(ValueError):
        sampling.disjoint(df, "id", {"x": 51}, "1")
    moved = sampling.rotated(df, "id", "id", "1").collect()
    assert all(r.id != r.moved for r in moved) and {r.moved for r in moved} == set(range(50))


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    with pytest.raises(ValueError):
        checks.strict_join(a, b.withColumnRenamed("v", "w"), "k")
    assert {r.k for r in checks.mismatches(a, b, "k", "v").collect()} == {2, 3}
    with pytest.raises(KeyError):
        table(spark, "/nowhere", "unknown")


def plain_rises(values):
    least, rises, out = math.inf, 0, []
    for v in values:
        if v <= least:
            least, rises = v, 0
        else:
            rises += 1
        out.append(rises)
    return out


def test_logs_against_loops(spark):
    rng = random.Random(2)
    rows = [(k, i, float(rng.randint(0, 5))) for k in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = {(r.k, r.i): r.rises for r in logs.rise_counter(df, ["k"], "i", "v").collect()}
    for k in range(20):
        values = [v for kk, _, v in rows if kk == k]
        assert [got[k, i] for i in range(15)] == plain_rises(values)
    runs = Counter()
    for k in range(20):
        values, start = [v for kk, _, v in rows if kk == k], 0
        for i in range(1, 16):
            if i == 15 or values[i] <= values[i - 1]:
                if i - start > 2:
                    runs[k, start, i - 1, i - start - 1] += 1
                start = i
    assert Counter(map(tuple, logs.rise_runs(df, ["k"], "i", "v").collect())) == runs


def test_stream_says_what_the_batch_says(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"key": f"k{k}", "step": i, "value": float(rng.randint(0, 4))} for k in range(3) for i in range(12)]
    rows.append({"key": "k0", "step": 4, "value": 9.0})  # logged again after a restart
    for part in range(3):
        (tmp_path / f"in{part}.json").write_text("".join(json.dumps(r) + "\n" for r in rows if r["step"] // 4 == part or (part == 2 and r["value"] == 9.0)))
    out = watch(stream_jsonl(spark, f"file://{tmp_path}", "key string, step long, value double").filter("step IS NOT NULL"))
    q = out.writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.step): r.rises for r in spark.table("watched").collect()}
    for k in range(3):
        assert [got[f"k{k}", i] for i in range(12)] == plain_rises([r["value"] for r in rows[:-1] if r["key"] == f"k{k}"])


def test_metrics_identities(spark):
    rows = [(i, "the cat sat on the mat %d" % i, "the cat sat on a mat %d" % i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, hyp string, ref string")
    same = metrics.bleu_stats(df, "ref", "ref").agg(*metrics.summed()).select(metrics.bleu().alias("b")).first().b
    assert same == pytest.approx(100)
    s = metrics.sentence_stats(*rows[0][1:])
    assert s[:3] == (7, 7, 6) and s[6:] == (7, 6, 5, 4)
    assert metrics.sentence_chrf("", "") == 100 and metrics.sentence_chrf("a", "") == 0 and metrics.sentence_chrf("Ab c", "abc") == 100
    assert metrics.bleu_stats(df.limit(0)).agg(*metrics.summed()).select(metrics.bleu().alias("b")).first().b == 0.0


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(500)], "id long, x double")
    sums = resample.resampled_sums(df, "id", ["x"], 200, "1").withColumn("m", F.col("x") / F.col("n"))
    ci = resample.interval(sums, "m", 200).first()
    assert ci.low < 4.5 < ci.high and ci.high - ci.low == pytest.approx(4 * 2.87 / math.sqrt(500), rel=0.35)
    p = resample.paired(sums.withColumn("same", F.col("m")), "m", "same", 200).first()
    assert (p.low, p.high, p.p) == (0.0, 0.0, 1.0)


def test_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    got = regression.ols(df, "y", ["a", "b"])
    full = np.column_stack([np.ones(200), x])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    inverse = np.linalg.inv(full.T @ full)
    e = (y - full @ beta) / (1 - np.einsum("ij,jk,ik->i", full, inverse, full))
    se = np.sqrt(np.diag(inverse @ (full.T * e**2) @ full @ inverse))
    assert [v[0] for v in got.values()] == pytest.approx(beta.tolist()) and [v[1] for v in got.values()] == pytest.approx(se.tolist())
    shares = regression.shapley_r2(df, "y", ["a", "b"])
    r2 = 1 - ((y - full @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert sum(shares.values()) == pytest.approx(r2)
    assert regression.vif(df.withColumn("c", F.col("a") * 2), ["a", "c"])["a"] > 1e6


def test_batches_stay_in_their_budget(spark):
    df = spark.createDataFrame([(i, 1 + i % 60) for i in range(1000)], "id long, n long")
    plan = batching.plan_batches(df, "id", "n", 512, "s", 3)
    sizes = batching.padded(plan, "n").collect()
    assert plan.count() == 1000 and all(r.padded <= 512 or r.rows == 1 for r in sizes)


def test_histogram_has_its_zeros(spark):
    df = spark.createDataFrame([(5,), (300,)], "n long")
    assert {r.label: r.n for r in stats.histogram(df, T.token_bin(F.col("n")), T.TOKEN_BINS).collect()} == {x: int(x in ("<=10", ">256")) for x in T.TOKEN_BINS}
    assert stats.quantile_edges(df.limit(0), "n", 5) == []


def test_mbr_and_argmax(spark):
    df = spark.createDataFrame([(0, 0, "a b c"), (0, 1, "a b c"), (0, 2, "x y z"), (1, 0, "alone")], "pool long, ord long, text string")
    u = metrics.mbr_utilities(df)
    got = {(r.pool, r.ord): r.utility for r in u.collect()}
    assert got[0, 0] == got[0, 1] > got[0, 2] and got[1, 0] == 0
    assert {(r.pool, r.ord) for r in metrics.argmax(u, ["pool"], "utility", "ord").collect()} == {(0, 0), (1, 0)}


def test_blocked_tokens(spark):
    assert one(spark, subwords.blocked_tokens(F.col("h"), 3), h=[1, 2, 3, 1, 2]) == [3]
    assert one(spark, subwords.blocked_tokens(F.col("h"), 3), h=[1]) == []


def test_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\nun\n\n deux \n")
    assert {r.word for r in files.read_word_list(spark, f"file://{tmp_path}/w.txt").collect()} == {"un", "deux"}
    (tmp_path / "bad.json").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"file://{tmp_path}/bad.json", "a long").collect()
    with pytest.raises(ValueError):
        files.read_split(spark, "x", "test")
    files.write_json_atomically(tmp_path / "m.json", {"b": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"b": 1}
    df = spark.range(10).withColumn("src", F.array(F.col("id").cast("int")))
    files.write_shards(df.coalesce(1), f"file://{tmp_path}/shards", 4, "id")
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == 3
    assert files.markdown_table(df.select("id").limit(1)).startswith("| id |")


def test_chunk_cache_scores_only_what_is_new(spark, tmp_path):
    calls = []

    def score(df):
        calls.append(df.count())
        return df.withColumn("score", F.length("t").cast("double"))

    rows = lambda last: spark.createDataFrame([(i, "x" * i if i < 8 else last) for i in range(10)], "ord long, t string")
    path = f"file://{tmp_path}/cache"
    first = chunk_cache.score_missing(rows("a"), "ord", ["t"], path, 4, score)
    assert {r.ord: r.score for r in first.collect()}[3] == 3.0
    chunk_cache.score_missing(rows("a"), "ord", ["t"], path, 4, score)
    second = chunk_cache.score_missing(rows("bb"), "ord", ["t"], path, 4, score)
    assert calls == [10, 2] and {r.ord: r.score for r in second.collect()}[9] == 2.0


def test_chunk_cache_recovers_from_bad_scores(spark, tmp_path):
    """A retry with good scores gives all rows, and rows without one have null until then."""
    path = f"file://{tmp_path}/bad"
    rows = spark.range(6).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("t"))
    bad = lambda df: df.withColumn("score", F.when(F.col("ord") == 1, float("nan")).otherwise(1.0))
    short = lambda df: df.filter("ord <> 4").withColumn("score", F.lit(2.0))
    first = {r.ord: r.score for r in chunk_cache.score_missing(rows, "ord", ["t"], path, 3, bad).collect()}
    assert first == {0: None, 1: None, 2: None, 3: 1.0, 4: 1.0, 5: 1.0}
    good = lambda df: df.withColumn("score", F.lit(3.0))
    second = {r.ord: r.score for r in chunk_cache.score_missing(rows, "ord", ["t"], path, 3, good).collect()}
    assert second == {0: 3.0, 1: 3.0, 2: 3.0, 3: 1.0, 4: 1.0, 5: 1.0}
    other = path + "-short"
    third = {r.ord: r.score for r in chunk_cache.score_missing(rows, "ord", ["t"], other, 3, short).collect()}
    assert third == {0: 2.0, 1: 2.0, 2: 2.0, 3: None, 4: None, 5: None}


def test_cascade_runs_every_step(spark, tmp_path):
    """A guarded pair, held-out pairs and those that match them, counted apart; and nothing protected is in what is written."""
    rows = [(1, "", "x"), (2, "one two", "un deux"), (3, "one two", "un deux"), (4, "same", "same"), (5, "a", "a long side of many words"), (6, "1234!!", "5678??"), (7, "Protected line", "ligne"), (8, "other", "protected  LINE"), (9, "last words", "mots")]
    rows += [(10, "One Two", "autre texte"), (11, "plain text", "texte")]
    df = spark.createDataFrame(rows, "ord long, src string, tgt string")
    index = guard.match_index(spark.createDataFrame([("dev", "protected line")], "set string, text string"))
    for held in (1, 2, 4):
        got = {r.ord: r.step for r in clean.cascade(df, index, held, "h").collect()}
        assert [got[k] for k in range(1, 9)][:1] == ["empty"] and got[3] == "duplicate" and got[4] == "equal" and got[5] == "ratio" and got[6] == "non_letter"
        assert got[7] == got[8] == "guard"
        assert sum(v == "holdout" for v in got.values()) == held
        # Rows 2 and 10 have one key on the left: when one is held, the other goes or is held too.
        if "holdout" in (got[2], got[10]):
            assert {got[2], got[10]} <= {"holdout", "holdout_match"}
    table = {r.step: (r.removed, r.remaining) for r in clean.filter_table(clean.cascade(df, index, 4, "h")).collect()}
    assert table["guard"] == (2, 4) and table["holdout"] == (4, 0) and sum(v[0] for v in table.values()) == 11
    kept = clean.cascade(df, index, 1, "h").filter("step IS NULL")
    kept.write.parquet(f"{tmp_path}/kept")
    assert [tuple(r) for r in clean.reread_matches(spark, f"{tmp_path}/kept", index, ["src", "tgt"]).collect()] == [("dev", 0)]
    df.write.parquet(f"{tmp_path}/all")
    assert [tuple(r) for r in clean.reread_matches(spark, f"{tmp_path}/all", index, ["src", "tgt"]).collect()] == [("dev", 2)]
