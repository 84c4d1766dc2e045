"""Every operator on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluiceway.llm import decontaminate, html_diff, licences, line_dedup, near_dedup, packing, quality, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, place int, label string, row string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def docs(spark, rows):
    filled = [(i, t, "en", "src0", len(t or ""), "k", 0.5, 1, "x", "r") for i, t in rows]
    return spark.createDataFrame(filled, SCHEMA)


ROWS = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n\x0b "), (5, LONG), (6, "same line\nother"), (7, "same line\nother"), (None, "no id here")]


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "packing": lambda s, d: packing.pack(d, tokenizer()),
    "licences": lambda s, d: licences.licence_scan(d),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "near_dedup": lambda s, d: near_dedup.near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.decontaminated(d, benchmark(s)),
    "quality": lambda s, d: quality.quality_rules(d),
    "sharding": lambda s, d: sharding.shard(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, docs(spark, ROWS)).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in ROWS}
    if name != "packing":
        assert len(out) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "licences", "decontaminate", "quality", "sharding", "line_dedup"])
def test_repeated_rows_stay(spark, name):
    assert OPERATORS[name](spark, docs(spark, [(9, "a b c"), (9, "a b c")])).count() == 2


def test_pages(spark):
    rows = [(1, "http://h.com/a", "<p>x</p>"), (1, "http://h.com/a", "<p>x</p>"), (2, None, None), (3, "no scheme", ""), (None, "http://h.com/b", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for operator in (html_diff.extract_text, url_filter.url_filter):
        assert operator(pages.withColumn("score", F.lit(1)).withColumn("key", F.lit("k"))).count() == 5
        assert operator(pages.limit(0)).count() == 0
    texts = {(r["page_id"], r["text"]) for r in html_diff.extract_text(pages).collect()}
    assert texts == {(1, "x"), (2, ""), (3, ""), (None, "y")}


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    for name, rows in (("labels", labels(spark)), ("benchmark", benchmark(spark))):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    given = docs(spark, ROWS)
    for stage in (s for _, s in corpus_pipeline.STAGES[:-1]):
        out = stage(spark, given, str(tmp_path))
        assert out.columns == given.columns and dict(out.dtypes) == dict(given.dtypes)
        assert {2, 3, 4, None} <= {r["doc_id"] for r in out.collect()}
        assert stage(spark, given.limit(0), str(tmp_path)).count() == 0
