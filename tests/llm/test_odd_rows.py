"""Rows that no corpus lacks, through every stage of the pipeline and the operators on single texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventflow.llm import language, pii, quality, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (900_001, None, None, "x", 0),
    (900_002, "", "en", None, 0),
    (900_003, " \n\t ", "en", "a", 1),
    (900_004, "three words here", "en", "a", 1),
    (900_004, "three words here", "en", "a", 1),
    (900_005, "plain word " * 30_000, "en", "a", 1),
    (None, "Ünïcode 中文 " * 3, None, "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select(*[p.split()[0] for p in SCHEMA.split(", ")])
    return real.unionByName(spark.createDataFrame(ROWS, SCHEMA)).repartition(3)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, docs, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert rows and (last or out.columns == docs.columns)
    ids = [r.doc_id for r in rows]
    if name.startswith("n-gram"):
        assert ids.count(900_004) == 1 and {900_001, 900_002, 900_003, None} <= set(ids)
    if name.startswith("benchmark"):
        assert ids.count(900_004) == 2 and {900_001, None, 900_005} <= set(ids)
    if last:
        assert ids.count(900_004) == 2 and ids[0] is None or None in ids
        assert {r.doc_id: r.n_tokens for r in rows}[900_001] == 1
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == out.columns and empty.count() == 0


def test_urls(spark):
    rules = url_filter.rule_table(spark, [("a.com", "/x", "allow"), ("a.com", "/x", "block"), (None, "/", "block"), ("b.com", "/" + "p" * 5000, "block")])
    rows = [(1, "http://a.com/xy"), (1, "http://a.com/xy"), (2, "http://b.com/" + "p" * 9000), (3, None), (4, "http://b.com/" + "p" * 4999)]
    urls = spark.createDataFrame(rows, "page_id long, url string").withColumns({"judged": F.lit(1), "_judged": F.lit(2), "rule": F.lit("old")})
    got = sorted((r.page_id, r.verdict) for r in url_filter.filter_urls(urls, rules).collect())
    assert got == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "allow")]
    assert url_filter.filter_urls(urls.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(urls, rules.limit(0)).collect()} == {"allow"}


def test_language_and_quality_on_odd_rows(spark, docs):
    model = language.fit(docs, held_out=1, folds=3)
    long = "the quick brown fox jumps over the lazy dog " * 9000
    made = spark.createDataFrame([(1, long), (2, "x" * 400_000), (3, None), (3, None), (4, "зима близко и ветер")], "doc_id long, text string").withColumn("judged", F.lit(7))
    got = {r.doc_id: r for r in language.identify(made, model).collect()}
    assert got[3].lang_pred == "und" and got[3].score == 0 and all(0 <= r.score <= 1 and r.judged == 7 for r in got.values())
    assert not got[4].accepted  # a language that no row was labelled with
    assert language.identify(made.limit(0), model).collect() == []
    net = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), held_out=None)
    scored = quality.score(made, net).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(made.limit(0), net).collect() == []


def test_personal_data_in_long_texts_beside_clashing_columns(spark):
    text = "nothing to see " * 20_000 + "write to jane.doe@example.com now"
    rows = [(1, text, "kept"), (2, None, "kept"), (2, None, "kept"), (3, "", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string").withColumn("n_email", F.lit("replaced"))
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert got[1].n_email == 1 and f"email:{text.index('jane')}:" in got[1].spans
    assert got[2].n_email == 0 and got[3].spans == "" and got[1].found == "kept"
    assert pii.find_pii(df.limit(0)).collect() == []
