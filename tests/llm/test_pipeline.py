import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiflow.llm.queries import QUERIES


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == counts[-1] and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


@pytest.fixture
def odd(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named as the stages name theirs."""
    site = "shared head\n"
    rows = [(i, f"{site}the words of page {i} go on in number {i * i} and on to the end of it all {i % 7}.", "en", f"s{i % 2}", 60) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s0", 0), (None, "no id at all in this row here", "en", "s1", 5), (62, "long " * 40_000, "en", "s0", 200_000), (62, "long " * 40_000, "en", "s0", 200_000), (63, rows[5][1], "en", "s1", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("n_lines", "n_removed", "row_hash", "p0", "copy", "kept_id", "kept_lines", "rate", "node", "rid", "id")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(60, 0, 0), (61, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    docs.withColumns({c: F.lit(4) for c in names}).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_an_odd_table(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == columns and out.filter("node <> 4 OR n_lines <> 4").isEmpty()
        nothing = stage(spark, docs.filter("doc_id > 1000"), odd)
        assert nothing.columns == columns and nothing.count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert last.count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("doc_id > 1000"), odd).count() == 0
    lines = corpus_pipeline.drop_lines(spark, docs, odd)
    assert lines.filter("text LIKE 'shared head%'").isEmpty() and lines.count() == docs.count()
    assert corpus_pipeline.run(spark, odd).count() > 30


def test_mixing_keeps_good_text_and_leaves_out_toxic(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, path)
    docs = docs.cache()
    out = corpus_pipeline.mix_domains(spark, docs, path).cache()
    assert 0.8 * docs.count() < out.count() < 1.2 * docs.count()

    def kept(condition):
        marked = docs.join(labels.filter(condition).select("doc_id"), "doc_id", "left_semi")
        return marked.join(out, "doc_id", "left_semi").count() / marked.count()

    assert kept("quality = 1 AND toxic = 0") >= 0.97
    assert kept("toxic = 1") <= 0.4
