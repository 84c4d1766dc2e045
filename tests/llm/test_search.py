"""Leads to partners, and the rounds in which they are sought."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluiceway.llm import near_dedup, search
from sluiceway.session import materialize

PERCENT = 85


def _outsiders(rng: np.random.Generator, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A centre, and sets that share common elements with it and a few with their neighbours."""
    centre = np.arange(60, dtype=np.uint64)
    sets = []
    for _ in range(n // 4):
        base = np.concatenate([rng.choice(60, 40, replace=False), 100 + rng.choice(25, 14, replace=False)]).astype(np.uint64)
        sets += [np.sort(rng.choice(base, len(base) - cut, replace=False)) for cut in (0, 1, 3, 6)]
    return centre, sets


def test_leads_find_all_partners_through_few_rows(spark):
    centre, sets = _outsiders(np.random.default_rng(7), 120)
    ids = range(1, len(sets) + 1)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * len(sets)), pa.array(ids), pa.array([centre.tobytes()] * len(sets)), pa.array([s.tobytes() for s in sets])],
        names=["centre", "member", "first", "second"],
    )
    rows = next(near_dedup._compared(PERCENT)([batch])).to_pylist()
    failed = [(r["member"], len(sets[r["member"] - 1]), r["own"], r["enough"], r["any"], r["limit"]) for r in rows if not r["linked"]]
    assert len(failed) == len(sets)
    closest = spark.createDataFrame(failed, "id long, m long, own array<bigint>, enough long, any array<bigint>, limit long")
    tokens = spark.createDataFrame([(i, len(s), int(h)) for i, s in zip(ids, sets) for h in s], "other long, n long, h long")
    leads = near_dedup._leads(closest, tokens.groupBy("h").agg(F.count("*").alias("held")), PERCENT)
    sized = (F.col("n") <= F.col("most")) & (100 * F.col("n") >= PERCENT * F.col("m"))
    joined = leads.join(tokens, "h").where((F.col("id") != F.col("other")) & sized)
    got = [(r.id, r.other) for r in joined.select("id", "other").collect()]
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= PERCENT * len(np.union1d(a, b))
    links = {(i, j) for i in ids for j in ids if i != j and alike(sets[i - 1], sets[j - 1])}
    assert links and links <= set(got)
    # By size alone, whatever the rank of the shingle, there would be many more rows.
    largest = F.floor(F.col("m") * 100 / PERCENT)
    loose = leads.withColumn("most", largest).join(tokens, "h").where((F.col("id") != F.col("other")) & sized).count()
    assert 3 * len(got) < 2 * loose


def test_few_pairs_wait_for_the_last_round(spark):
    """Cliques of a group are joined, and few pairs are compared once, not round by round."""
    n, cliques = 64, 4
    leads = spark.range(n).select("id", F.lit(1).alias("h"))
    holders = leads.withColumnRenamed("id", "other")
    none = spark.createDataFrame([], "centre long, member long")
    parts = spark.createDataFrame([], "node long, component long")
    calls = []

    def compare(pairs):
        calls.append(pairs.count())
        return materialize(pairs.where(F.col("centre") % cliques == F.col("member") % cliques), "links")

    found = search.search_links(leads, holders, none, parts, F.lit(True), compare).collect()
    assert {(r.node, r.component) for r in found} == {(i, i % cliques) for i in range(n)}
    assert calls == [n * (n - 1) // 2]
