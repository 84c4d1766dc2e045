"""Sharding: a two-pass external shuffle into shards of shuffled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluiceway.session import materialize

# A bucket is what one step of the second pass holds in memory, on average.
BUCKET_BYTES = 1 << 20
BUCKET_ROWS = 512
# Buckets per run when bucket sizes are summed to offsets.
RUN = 4096
# Hex digits of a digest that a double holds exactly.
DIGITS = 12


def _number(digest: Column) -> Column:
    """The leading digits of a hex digest as a number in [0, 16**DIGITS)."""
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def _unit(digest: Column) -> Column:
    """The same as a fraction in [0, 1)."""
    return _number(digest) / F.lit(float(16**DIGITS))


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard with the highest digest of (seed, key, shard).

    Each shard's digest stands by itself, so one shard more wins rows only for itself.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct(F.md5(F.concat(F.lit(f"{seed}:{s}:"), text)).alias("bid"), F.lit(s).alias("shard")) for s in range(shards)]
    return (F.greatest(*bids) if shards > 1 else bids[0])["shard"]


def _fisher_yates(n: Column, tag: Column) -> Column:
    """A permutation of 1..n, drawn inside out: entry i swaps with one of the first i.

    ``tag`` seeds the draws, so a repeated task draws the same permutation.
    """
    draw = lambda i: (F.floor(_unit(F.md5(F.concat(tag, F.lit(":"), i.cast("string")))) * i) + 1).cast("int")
    drawn = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), draw(i).alias("j")))

    def step(acc: Column, x: Column) -> Column:
        i, j = x["i"], x["j"]
        swapped = F.concat(
            F.slice(acc, 1, j - 1), F.array(i), F.slice(acc, j + 1, F.greatest(i - 1 - j, F.lit(0))), F.slice(acc, j, F.lit(1))
        )
        return F.when(j == i, F.concat(acc, F.array(i))).otherwise(swapped)

    return F.aggregate(drawn, F.array().cast("array<int>"), step)


def _by_digest(a: Column, b: Column) -> Column:
    return (
        F.when(a["order"] < b["order"], -1)
        .when(a["order"] > b["order"], 1)
        .when(a["tie"] < b["tie"], -1)
        .when(a["tie"] > b["tie"], 1)
        .otherwise(0)
    )


def shard(
    docs: DataFrame,
    *,
    shards: int = 8,
    id: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every row of ``docs`` with ``shard`` and ``slot``, its place there from 0.

    First pass: a row's shard follows from ``id`` and the number of shards
    alone, and a seeded digest of the whole row scatters it into one of the
    shard's buckets; their number comes from the total bytes and rows. Second
    pass: each bucket's rows are put in a fixed order and shuffled by
    Fisher-Yates, and the shard is its buckets one after the other.

    A null ``id`` counts as the empty text, a null ``text`` as empty; repeated
    rows each get a slot. Columns named ``shard`` or ``slot`` are replaced.
    """
    rows = docs.drop("shard", "slot")
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in rows.columns if c not in (id, text)]
    # Fixes the order of rows that share id and text; those that agree in all columns are interchangeable.
    tie = F.md5(F.to_json(F.struct(*rest))) if rest else F.lit("")
    total = rows.agg(
        F.count("*").alias("n"), F.sum(F.octet_length(body) + 1).alias("bytes")
    ).first()
    buckets = max(1, -(-(total["n"] or 0) // (bucket_rows * shards)), -(-(total["bytes"] or 0) // (bucket_bytes * shards)))
    placed = rows.select(
        shard_of(F.col(id), shards, seed).alias("shard"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit("")), F.md5(body))).alias("order"),
        tie.alias("tie"),
        F.struct(*rows.columns).alias("row"),
    ).select("shard", F.floor(_unit(F.col("order")) * buckets).cast("long").alias("bucket"), "order", "tie", "row")
    # Digests alone, before rows move: how many rows each bucket has.
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    offsets = materialize(_offsets(sizes), "bucket-offsets")
    # The first exchange: what follows finds each bucket whole in one task.
    gathered = placed.repartition("shard", "bucket").groupBy("shard", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("order", "tie", "row")), _by_digest).alias("held")
    )
    tag = F.concat_ws(":", F.lit(str(seed)), F.col("shard").cast("string"), F.col("bucket").cast("string"))
    shuffled = gathered.select("shard", "bucket", "held", _fisher_yates(F.size("held"), tag).alias("places"))
    laid = shuffled.select("shard", "bucket", F.posexplode(F.transform("places", lambda p: F.get("held", p - 1)["row"])).alias("rank", "row"))
    return laid.join(offsets, ["shard", "bucket"]).select(
        "row.*", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank")).cast("long").alias("slot")
    )


def _offsets(sizes: DataFrame) -> DataFrame:
    """``start`` of each bucket: the rows of its shard's buckets before it, summed over runs of buckets, then within each."""
    runs = sizes.select("*", F.floor(F.col("bucket") / RUN).cast("long").alias("run"))
    per_run = runs.groupBy("shard", "run").agg(F.sum("rows").alias("run_rows"))
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("shard", "run").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = per_run.select("shard", "run", F.coalesce(F.sum("run_rows").over(before), F.lit(0)).alias("run_start"))
    return runs.select("*", F.coalesce(F.sum("rows").over(within), F.lit(0)).alias("run_offset")).join(starts, ["shard", "run"]).select(
        "shard", "bucket", (F.col("run_start") + F.col("run_offset")).alias("start")
    )


def write_shards(sharded: DataFrame, path: str, *, files_per_shard: int = 1) -> None:
    """Write what ``shard`` returns, one folder per shard, in slot order.

    With more files per shard, each file holds a range of slots.
    """
    parts = F.pmod(F.floor(F.col("slot") / 65536), F.lit(files_per_shard))
    (
        sharded.select("*", parts.alias("_part"))
        .repartition("shard", "_part")
        .sortWithinPartitions("shard", "slot")
        .drop("_part")
        .write.partitionBy("shard")
        .parquet(path)
    )
