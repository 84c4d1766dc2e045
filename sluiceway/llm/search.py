"""Exact search for links that stars have missed, in rounds over growing shares of each group's members."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.llm.components import connected_components
from sluiceway.session import SENT_BYTES, few, materialize, small

# A round takes so many times as many members of a group as all before it, as a power of two.
GROWTH = 3
# Fewer pairs than this wait for those of the next round.
FEW = 2_000
# Bytes of a pair, and of a lead or holder with all its columns.
PAIR, LEAD = 16, 256
# Bytes of a (node, component) row.
PLACED = 16


def with_part(df: DataFrame, id: str, parts: DataFrame, name: str) -> DataFrame:
    """``df`` with the component of column ``id``; a node without links is its own."""
    of = parts.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
    joined = df.join(of, F.col(id) == F.col("_node"), "left")
    return joined.select(*df.columns, F.coalesce("_part", id).alias(name))


def merged_parts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` (centre, member) have joined components: only components meet again."""
    ends = with_part(with_part(links, "centre", parts, "_a"), "member", parts, "_b").select("_a", "_b")
    joined = connected_components(ends, "_a", "_b").select(F.col("node").alias("component"), F.col("component").alias("_root"))
    nodes = links.select(F.col("centre").alias("node")).union(links.select("member")).distinct()
    all_ = parts.select("node", "component").union(nodes.join(parts, "node", "left_anti").select("node", F.col("node").alias("component")))
    placed = all_.join(joined, "component", "left").select("node", F.coalesce("_root", "component").alias("component"))
    return small(materialize(placed, "parts"), PLACED)


def _rank(other: Column) -> Column:
    """Trailing zero bits of a digest: half of a group's members have 0, a quarter 1, and so on; at most 62."""
    digest = F.xxhash64(F.lit(7), other).bitwiseOR(F.lit(1 << 62))
    return F.floor(F.log2(digest.bitwiseAND(-digest).cast("double"))).cast("int")


def _unfolded(rows: DataFrame, below: str) -> DataFrame:
    """A row for each h of ``hs``, with those below it; rows that come with ``h`` as they are."""
    if "hs" not in rows.columns:
        return rows
    columns = [c for c in rows.columns if c != "hs"]
    return rows.select(*columns, "hs", F.posexplode("hs").alias("_at", "h")).select(*columns, "h", F.slice("hs", F.lit(1), F.col("_at")).alias(below))


def search_links(
    leads: DataFrame, holders: DataFrame, tested: DataFrame, parts: DataFrame, possible: Column, compare: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(node, component) once every pair that ``leads`` and ``holders`` allow is linked, refuted or needless.

    ``leads`` (id, h, ...) says what partners of a node hold, ``holders``
    (other, h, ...) who holds it; ``possible`` is a condition on both. Both may
    have one row per node instead, with all its h in order in ``hs``: then a pair
    is made at the first h that it shares, once. A pair in one component needs no test. So the holders of each h come in rounds, a
    few drawn by digest first: where they join a group's components, the rest of
    the group drops out before it is paired. The last round has all holders, so
    that nothing is left out; the rounds grow as the logarithm of the largest
    group. Both sides are written once, and a round sets their components beside
    those it reads; its pairs wait for the next round's while they are few.
    ``compare`` turns pairs (centre, member) into those that link, and
    ``tested`` has the pairs (smaller id first) that are known not to.
    """
    # A lead with its h in ``hs`` is written once for all of them.
    n_bytes = LEAD * F.size("hs") if "hs" in leads.columns else LEAD
    leads = materialize(leads, "leads")
    sent = few(leads, n_bytes)
    refuted = [small(materialize(tested, "tested"), PAIR)]
    holders = materialize(holders.withColumn("_rank", _rank(F.col("other"))), "holders")
    once = ~F.arrays_overlap("_below", "_other_below") if "hs" in leads.columns and "hs" in holders.columns else F.lit(True)
    top = holders.agg(F.max("_rank")).first()[0]
    if top is None:
        return parts
    waiting = None
    for low in range(top - top % GROWTH, -1, -GROWTH):
        these = holders.where(F.col("_rank").between(low, low + GROWTH - 1))
        apart = (F.col("id") != F.col("other")) & (F.col("_own") != F.col("_part"))
        # The smaller side goes to every task if it can: no shuffle, and no group in one task.
        some = _unfolded(with_part(leads, "id", parts, "_own"), "_below")
        those = _unfolded(with_part(these, "other", parts, "_part"), "_other_below")
        if sent:
            some = F.broadcast(some)
        elif few(these, n_bytes):
            those = F.broadcast(those)
        found = some.join(those, "h").where(apart & once & possible)
        pairs = found.select(F.least("id", "other").alias("centre"), F.greatest("id", "other").alias("member"))
        pairs = (pairs if waiting is None else pairs.union(waiting)).distinct()
        pairs = reduce(lambda rest, known: rest.join(known, ["centre", "member"], "left_anti"), refuted, pairs)
        pairs = materialize(pairs, "pairs")
        count = pairs.count()
        if low and count < FEW:
            waiting = pairs
            continue
        waiting = None
        if not count:
            continue
        refuted.append(F.broadcast(pairs) if PAIR * count <= SENT_BYTES else pairs)
        links = compare(pairs)
        if not links.isEmpty():
            parts = merged_parts(parts, links)
    return parts
