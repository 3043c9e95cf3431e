"""Queries without SQL do the whole job: held against plain Python on the smallest tables."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex

from pyspark.sql import functions as F

from lexiflow.operators import batching, checks, metrics, regression, resample
from lexiflow.plans import catalog
from lexiflow.plans.registry import EVAL_SQL


@pytest.fixture(scope="module")
def evals(sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return c.execute(f"WITH {EVAL_SQL} SELECT doc_id, slice, split, ref, hyp, hyp_b FROM evals").fetchall()


def plain_stats(hyp, ref):
    """hyp_len, ref_len, four matches, four totals; counted gram by gram."""
    tokens = lambda s: regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", s)
    h, r, match, total = tokens(hyp), tokens(ref), [], []
    for n in (1, 2, 3, 4):
        left = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        hit = 0
        for i in range(len(h) - n + 1):
            g = tuple(h[i : i + n])
            if left[g] > 0:
                left[g] -= 1
                hit += 1
        match.append(hit)
        total.append(max(0, len(h) - n + 1))
    return (len(h), len(r), *match, *total)


def plain_bleu(rows):
    h, r, *mt = (sum(x) for x in zip(*rows))
    p = [mt[0] / mt[4], *((mt[k] + 1) / (mt[k + 4] + 1) for k in (1, 2, 3))]
    return 100 * min(1.0, math.exp(1 - r / h)) * math.exp(sum(map(math.log, p)) / 4)


def test_whole_texts_count(spark, sf, evals):
    assert any(len(e[3]) >= 2000 for e in evals)
    want = {e[0]: plain_stats(e[4], e[3]) for e in evals}
    got = {r[0]: tuple(r[1:]) for r in catalog.QUERIES["m01_sentence_stats"](spark, sf).collect()}
    assert got == want
    bleu = {r.slice: r.bleu for r in catalog.QUERIES["m02_m03_m06_corpus_bleu"](spark, sf).collect()}
    slices = {e[1] for e in evals}
    assert set(bleu) == slices | {"all"}
    for s in slices:
        assert bleu[s] == pytest.approx(plain_bleu([want[e[0]] for e in evals if e[1] == s]), abs=1e-5)
    assert bleu["all"] == pytest.approx(plain_bleu(list(want.values())), abs=1e-5)


def plain_times(seed, i, rep):
    u = int(hashlib.md5(f"{seed}:{i}:{rep}".encode()).hexdigest()[:15], 16) / 2**60
    return sum(u >= sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18))


def plain_gap(y, x, side):
    """Fits on the drawn rows themselves; of two columns, a Shapley value is the mean over both orders."""

    def fit(cols):
        a = np.column_stack([np.ones(len(y)), *(x[:, c] for c in cols), side])
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        explained = sum(b * (x[side == 0, c].mean() - x[side == 1, c].mean()) for b, c in zip(beta[1:], cols))
        return np.array([explained, 1 - ((y - a @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()])

    none, a, b, both = fit([]), fit([0]), fit([1]), fit([0, 1])
    gap = y[side == 0].mean() - y[side == 1].mean()
    pa, pb = (a - none + both - b) / 2, (b - none + both - a) / 2
    out = {"gap": gap, "residual": gap - both[0], "part_a": pa[0], "r2_a": pa[1], "part_b": pb[0], "r2_b": pb[1]}
    return out | {f"share_{k}": out[k] / gap for k in ("residual", "part_a", "part_b")}


def test_decomposition_is_fitted_on_every_draw(spark):
    rng = np.random.default_rng(5)
    n, reps = 80, 30
    side = np.arange(n) % 2
    x = rng.normal(size=(n, 2)) + side[:, None]
    y = 3000 + 2 * x[:, 0] - x[:, 1] + side + rng.normal(size=n)
    df = spark.createDataFrame([(i, int(side[i]), float(y[i]), *map(float, x[i])) for i in range(n)], "id long, side int, y double, a double, b double")
    got = regression.refitted_gap(df, "id", "side", "y", ["a", "b"], reps, "s")
    draws = [np.repeat(np.arange(n), [plain_times("s", i, rep) for i in range(n)]) for rep in range(reps)]
    fits, point = [plain_gap(y[d], x[d], side[d]) for d in draws], plain_gap(y, x, side)
    assert set(got) == set(point)
    for k, (p, low, high) in got.items():
        assert (p, low, high) == pytest.approx((point[k], *np.percentile([f[k] for f in fits], [2.5, 97.5])), rel=1e-5, abs=1e-6), k
        assert low < high


def test_mix_and_rate_are_split_on_every_draw(spark):
    rng = random.Random(6)
    rows = [(i, "ab"[i % 3 == 0], i % 2, float(rng.randint(1, 50))) for i in range(40)] + [(100, "rare", 0, 9.0)]  # no draw has "rare" on side 1, some have none
    reps, classes = 40, ("a", "b", "rare")
    got = {r["class"]: r for r in resample.mix_and_rate_intervals(spark.createDataFrame(rows, "id long, k string, side int, x double"), "id", "k", "side", "x", reps, "s").collect()}
    samples = {(c, t): [] for c in classes for t in ("mix", "rate", "gap")}
    for rep in range(reps):
        s, n = Counter(), Counter()
        for i, k, side, x in rows:
            t = plain_times("s", i, rep)
            s[k, side] += t * x
            n[k, side] += t
        sides = [sum(n[c, e] for c in classes) for e in (0, 1)]
        samples_gap = sum(s[c, 0] for c in classes) / sides[0] - sum(s[c, 1] for c in classes) / sides[1]
        for c in classes:
            m = [s[c, e] / n[c, e] if n[c, e] else s[c, 1 - e] / n[c, 1 - e] if n[c, 1 - e] else 0.0 for e in (0, 1)]
            w = [n[c, e] / sides[e] for e in (0, 1)]
            for t, v in (("mix", (w[0] - w[1]) * sum(m) / 2), ("rate", (m[0] - m[1]) * sum(w) / 2), ("gap", samples_gap)):
                samples[c, t].append(v)
    for (c, t), v in samples.items():
        assert (got[c][f"{t}_low"], got[c][f"{t}_high"]) == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])), abs=1e-9), (c, t)


def test_steps_count_as_in_a_loop(spark):
    rng = random.Random(7)
    rows = [(c, b, 3, 3 * n - 1, 3 * n) for c in range(12) for b in range(9) for n in [rng.randint(1, 40)]]
    got = sorted(batching.stepped(spark.createDataFrame(rows, "chunk long, batch long, rows long, real long, padded long"), 100, "s").collect(), key=lambda r: r.place)
    order = sorted(rows, key=lambda r: hashlib.md5(f"s:{r[0]}:{r[1]}".encode()).hexdigest())
    step, held, want = 0, 0, []
    for place, r in enumerate(order):
        held += r[4]
        want.append((*r, place, step, held))
        if held >= 100:
            step, held = step + 1, 0
    assert [tuple(r) for r in got] == want
    t = batching.replayed(spark.createDataFrame(got), 100, 90).first()
    sizes = [r[4] for r in rows]
    assert (t.batches, t.examples, t.real, t.padded, t.steps, t.left) == (108, 324, sum(sizes) - 108, sum(sizes), step, held)
    assert (t.median, t.p99, t.max, t.over_budget) == (np.median(sizes), pytest.approx(np.percentile(sizes, 99)), max(sizes), sum(x > 90 for x in sizes))


def made(spark, hyps):
    """Statistics of runs over 90 references in three splits."""
    rng = random.Random(8)
    refs = {i: " ".join(rng.choice("abcdefgh") for _ in range(12)) for i in range(90)}
    rows = [(i, f"e{i % 3 + 1}", run, *plain_stats(f(i, ref), ref)) for run, f in hyps.items() for i, ref in refs.items() if f(i, ref) is not None]
    return spark.createDataFrame(rows, "id long, split string, run string, " + ", ".join(f"{s} long" for s in metrics.STATS)), spark.createDataFrame([(i,) for i in refs], "id long")


def test_decisions_need_significance_in_every_set(spark):
    cut = lambda k: lambda i, r: " ".join(w for j, w in enumerate(r.split()) if j % k)
    good, poor = cut(6), cut(3)
    rows, ids = made(spark, {"good": good, "poor": poor, "same": good, "split": lambda i, r: poor(i, r) if i % 3 == 0 else good(i, r), "part": lambda i, r: good(i, r) if i else None})
    assert resample.complete_runs(rows, ids, "id", "run") == ["good", "poor", "same", "split"]
    got = {}
    for r in resample.decisions(rows, ids, "id", "run", "split", 60, "s", ["e2", "e3"], ["e1"]).collect():
        got.setdefault((r.better, r.other), {})[r.split] = r
    assert len(got) == 12 and all(set(v) == {"e1", "e2", "e3"} for v in got.values())
    supported = {k for k, v in got.items() if v["e2"].supported}
    assert supported == {("good", "poor"), ("same", "poor"), ("split", "poor")}
    assert got["good", "same"]["e2"].delta == 0 and got["good", "same"]["e2"].p == 1 and not got["good", "same"]["e2"].met
    assert got["split", "poor"]["e1"].met and got["split", "poor"]["e2"].met  # e1 is equal, so not worse
    assert not got["split", "good"]["e1"].met


def test_slices_have_intervals_of_their_own_rows(spark):
    rows, _ = made(spark, {"x": lambda i, r: r if i % 2 else r[:9]})
    df = rows.withColumn("chars", F.col("id").cast("double"))
    lone = resample.slice_intervals(df.filter("id = 1"), "id", ["split"], "chars", 60, "s").first()
    assert (lone.mean_low, lone.mean_high) == (1.0, 1.0)
    got = {r.split: r for r in resample.slice_intervals(df, "id", ["split"], "chars", 60, "s").collect()}
    plain = [tuple(r) for r in df.collect()]
    for k, r in got.items():
        own = [p for p in plain if p[1] == k]
        draws = [[p for p in own for _ in range(plain_times("s", p[0], rep))] for rep in range(60)]
        means = sorted(sum(p[-1] for p in d) / len(d) for d in draws)
        bleus = sorted(plain_bleu([p[3:13] for p in d]) for d in draws)
        assert (r.n, r.mean, r.mean_low, r.mean_high) == (30, pytest.approx(np.mean([p[-1] for p in own])), pytest.approx(means[1]), pytest.approx(means[58]))
        assert (r.bleu_low, r.bleu_high) == (pytest.approx(min(bleus[1], r.bleu)), pytest.approx(max(bleus[58], r.bleu)))


def test_a_set_without_a_label_is_refused(spark):
    inputs, labels = spark.createDataFrame([(0,), (3,)], "k long"), spark.createDataFrame([(0,)], "k long")
    assert checks.labelled(inputs.filter("k = 0"), labels, "k", F.col("k") % 3 == 0).count() == 1
    with pytest.raises(ValueError, match="without a label"):
        checks.labelled(inputs, labels, "k", F.col("k") % 3 == 0)
    with pytest.raises(ValueError, match="another set"):
        checks.labelled(inputs, inputs, "k", F.col("k") == 0)


def test_a_thousand_draws(spark, sf, evals):
    x = {e[0]: len(e[3]) for e in evals}
    ids, values = list(x), np.array(list(x.values()), float)

    def draws(seed):
        return np.array([[plain_times(seed, i, rep) for i in ids] for rep in range(1000)])

    t = draws("b")
    means = sorted(t @ values / t.sum(1))
    got = catalog.QUERIES["b02_b03_b22_thousand_draws"](spark, sf).first()
    assert (got.low, got.high) == pytest.approx((means[25], means[975]), abs=1e-5)
    t, third = draws("o"), np.array([i % 3 == 0 for i in ids])
    whole = t @ values / t.sum(1)
    made = sorted(0.8 * whole + 0.2 * (t[:, third] @ values[third] / t[:, third].sum(1)))
    got = catalog.QUERIES["b06_b25_thousand_draws"](spark, sf).first()
    assert (got.low, got.high) == pytest.approx((made[25], made[975]), abs=1e-5)
    p = [r.p for r in catalog.QUERIES["b04_b05_b07_b08_paired"](spark, sf).collect()]
    assert p == [0.0] * 3
    st = {e[0]: plain_stats(e[4], e[3]) for e in evals if e[1] == "en"}
    drawn = np.array([[plain_times("b", i, rep) for i in st] for rep in range(1000)]) @ np.array(list(st.values()))
    bleus = sorted(plain_bleu([d]) for d in drawn.tolist())
    got = {r.slice: r for r in catalog.QUERIES["b01_b23_bleu_interval"](spark, sf).collect()}["en"]
    assert (got.low, got.high) == pytest.approx((bleus[25], bleus[975]), abs=1e-5)


def test_parts_of_sets(spark, sf, evals):
    """The whole of a set is the paired test of that set; parts have the rows that are theirs."""
    whole = {r.split: (r.low, r.high, r.p) for r in catalog.QUERIES["b04_b05_b07_b08_paired"](spark, sf).collect()}
    got = catalog.QUERIES["b08_g57_paired_parts"](spark, sf).collect()
    assert {r.split: (r.low, r.high, r.p) for r in got if r.kind == "all"} == whole
    assert {(r.split, r.label) for r in got if r.kind == "slice"} == {(e[2], e[1]) for e in evals}
    assert {r.split for r in got if r.kind == "long"} == {e[2] for e in evals if len(e[3].split(" ")) > 80}
    parts = catalog.QUERIES["g41_g55_part_intervals"](spark, sf).collect()
    for r in parts:
        assert r.bleu_low <= r.bleu <= r.bleu_high and r.mean_low <= r.mean_high
    size = Counter((e[2], e[1]) for e in evals)
    assert {(r.split, r.label): r.n for r in parts if r.kind == "slice"} == size
    for s, n in Counter(e[2] for e in evals).items():
        assert sum(r.n for r in parts if r.split == s and r.kind == "bucket") == n


def test_row_seeds(spark):
    from lexiflow.functions.formulas import row_seed

    want = [int.from_bytes(hashlib.sha256(f"7|{j}|k{j}".encode()).digest()[:8], "little") & ((1 << 63) - 1) for j in range(50)]
    got = spark.range(50).select(row_seed(7, F.concat(F.lit("k"), "id"), F.col("id")).alias("s")).collect()
    assert [r.s for r in got] == want


def test_untranslated_does_not_grow_with_the_square(spark, tmp_path):
    """One text of 400,000 different words: a lambda over the source's words for each of the hypothesis' takes minutes."""
    import time

    words = [f"w{k}" for k in range(400_000)] + ["Ünder_1", "w7", "w7"]
    rows = [(1, " ".join(words), "en"), (2, "", "en"), (3, None, "de"), (4, "- -", "de"), (5, "W1 x, W1 W1 y", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    got = {r.doc_id: r.share for r in catalog.QUERIES["f15_untranslated"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - start < 45
    number = lambda w: int(hashlib.md5(w.lower().encode()).hexdigest()[:7], 16) % 5000
    share = lambda text: [number(w) >= 4000 for w in regex.findall(r"[\p{L}\p{N}_]+", " ".join(x for k, x in enumerate(text.split(" ")) if (k + 1) % 4))]
    for i, text, _ in rows:
        want = share(text or "")
        assert got[i] == pytest.approx(sum(want) / len(want) if want else 0.0, abs=1e-6), i


def counted(spark, rows):
    """The same rows, and a counter of how often any of them is made."""
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            made.add(len(f))
            yield f

    return rows.mapInPandas(run, rows.schema), made


def test_decisions_draw_once(spark):
    """The rows are made once to see which runs are complete and once to be drawn, however many pairs are tested."""
    cut = lambda k: lambda i, r: " ".join(w for j, w in enumerate(r.split()) if j % k)
    rows, ids = made(spark, {"good": cut(6), "poor": cut(3)})
    rows, n = counted(spark, rows)
    assert resample.decisions(rows, ids, "id", "run", "split", 60, "s", ["e2", "e3"], ["e1"]).count() == 6
    assert n.value <= 2 * 180


def test_draws_are_md5s(spark):
    """Messages of one block, side by side, and longer ones are digested as by hashlib."""
    ids = ["0", "17", None, "123456", "é" * 20, "x" * 48, "x" * 49, "x" * 50, "x" * 51, "x" * 70, ""]
    got = resample._first_halves("b", ids, 1101)
    for k, i in enumerate(ids):
        for r in (0, 9, 10, 99, 100, 999, 1000, 1100):
            text = f"b:{r}" if i is None else f"b:{i}:{r}"
            assert got[k, r] == int(hashlib.md5(text.encode()).hexdigest()[:16], 16), (i, r)


def test_pairs_are_counted_side_by_side():
    """Statistics as of gram by gram counts: empty and null texts, marks of no near script, more different tokens than four fit in one integer."""
    rng = random.Random(9)
    some = [" ".join(rng.choice(["a", "b", "c.", "é", "—", "語", "x\x1cy"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    many = " ".join(f"w{k}" for k in range(70_000))
    hyps, refs = [*some, "", None, "a", many[5:]], [*some[1:], some[0], "a", None, "", many]
    assert metrics.all_stats(hyps, refs).tolist() == [list(plain_stats(h or "", r or "")) for h, r in zip(hyps, refs)]
    assert metrics.all_stats([], []).shape == (0, 10)


def plain_chrf(h, r):
    h, r = ("".join((t or "").lower().split()) for t in (h, r))
    scores = []
    for n in range(1, 7):
        gh, gr = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (h, r))
        if gh and gr:
            both = sum((gh & gr).values())
            p, q = both / gh.total(), both / gr.total()
            scores.append(5 * p * q / (4 * p + q) if both else 0.0)
    return 100 * sum(scores) / len(scores) if scores else 0.0 if h or r else 100.0


def test_chrf_is_counted_side_by_side():
    """Scores as of gram by gram counts: empty and null texts, and more different characters than six fit in one integer."""
    rng = random.Random(10)
    some = ["".join(rng.choice("abé—語 İ\n") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    many = "".join(map(chr, range(0x3400, 0x9000)))
    hyps, refs = [*some, "", None, "a", many[9:]], [*some[1:], some[0], "a", None, "", many]
    assert metrics.all_chrf(hyps, refs).tolist() == pytest.approx([plain_chrf(h, r) for h, r in zip(hyps, refs)], abs=1e-9)


def test_slices_draw_once(spark):
    """The rows are made once for the points and both intervals."""
    rows, _ = made(spark, {"x": lambda i, r: r if i % 2 else r[:9]})
    rows, n = counted(spark, rows.withColumn("chars", F.col("id").cast("double")))
    assert len(resample.slice_intervals(rows, "id", ["split"], "chars", 60, "s").collect()) == 3
    assert n.value == 90
