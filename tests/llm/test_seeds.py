"""Seeds of word positions."""

from pyspark.sql import functions as F

from sluiceway.llm import decontaminate


def test_words_are_split_once_for_all_seeds(spark):
    texts = ["One two, three FOUR five six seven éight 9 漢字 ten", "", None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = docs.select("id", decontaminate._hashed_words("text").alias("words"))
    positions = decontaminate._positions(words, "words", decontaminate.MASKS)
    plan = positions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    split = ["one two three four five six seven éight 9 漢 字 ten".split(), [], [], ["a", "b"]]
    flat = spark.createDataFrame([(i, w) for i, ws in enumerate(split) for w in [ws]], "id long, w array<string>")
    hashed = {r.id: r.h for r in flat.select("id", F.transform("w", lambda w: F.xxhash64(w)).alias("h")).collect()}
    assert {r.id: r.words for r in words.collect()} == hashed
    got = {(r.id, r.at, r["mask"]): r.seed for r in positions.collect()}
    assert set(got) == {(i, k, m) for i, ws in enumerate(split) for k in range(len(ws)) for m in range(len(decontaminate.MASKS))}
    get = lambda i, k: hashed[i][k] if k < len(hashed[i]) else None
    rows = [(i, k, m, *[get(i, k + o) for o in decontaminate.MASKS[m]]) for i, k, m in got]
    made = spark.createDataFrame(rows, "id long, at int, mask int, a long, b long, c long, d long")
    seeds = {(r.id, r.at, r["mask"]): r.s for r in made.select("*", F.xxhash64("mask", "a", "b", "c", "d").alias("s")).collect()}
    assert got == seeds
