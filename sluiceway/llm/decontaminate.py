"""Benchmark decontamination: spaced-seed hashes, verified word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.operators.pin import pin
from sluiceway.session import materialize

# Words of letters and digits, lower-cased; an ideograph is a word.
WORD = r"[a-z0-9[\p{L}\p{N}&&[^\p{IsHan}]]]+|\p{IsHan}"
# Word positions that a seed reads; it ignores the ones between (masks 110101, 1011001 and 1100011).
MASKS = [(0, 1, 3, 5), (0, 2, 3, 6), (0, 1, 5, 6)]
# An item is leaked where so large a share of its words, or so many in a window, stand in place.
SHARE = 0.5
WINDOW, IN_WINDOW = 20, 16
# Items of fewer words are leaked where all their words stand one after the other; for longer ones a hit must show more
# than the four words of its seed.
LEAST_WORDS, LEAST_MATCHED = 8, 6
# Seeds of the benchmark that are sent to every task at a time (32 bytes each).
BLOCK_SEEDS = 1_000_000
# Documents with hits whose ids may be sent to every task; beyond, texts are shuffled to them.
SENT_IDS = 1_000_000


def _hashed_words(text: str) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: str, at: Column, masks: list[tuple[int, ...]]) -> Column:
    """Seed hashes at a position, one for each mask; those over the end read fewer words and meet nothing."""
    return F.array(*[F.xxhash64(F.lit(k), *[F.get(words, at + o) for o in mask]) for k, mask in enumerate(masks)])


def _positions(texts: DataFrame, words: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """``texts`` with a row for each position of its words (``at``) and mask, and their ``seed``."""
    # Words are split once, and seeds made where positions have come apart, in generated code.
    placed = pin(texts, {words: F.col(words)}).select("*", F.posexplode(words).alias("at", "_word"))
    return placed.select("*", F.posexplode(_seeds(words, F.col("at"), masks)).alias("mask", "seed"))


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    masks: list[tuple[int, ...]] = MASKS,
    share: float = SHARE,
    least_words: int = LEAST_WORDS,
    block_seeds: int = BLOCK_SEEDS,
    sent_ids: int = SENT_IDS,
) -> DataFrame:
    """(id, item, matched, words, share) for every benchmark item that a document holds.

    Every position of every whole text is hashed under each mask, and so is
    every item; equal hashes are hits, which say where the item would start.
    At each such place the words of document and item are compared one by one:
    the item is leaked where at least ``share`` of its words (and
    ``LEAST_MATCHED``) stand in place, or ``IN_WINDOW`` of ``WINDOW``
    neighbouring ones. Substituted words cost only themselves, as masks that
    skip them still hit. Items of fewer than ``least_words`` words are hashed
    and sought whole, by a hash of as many words at every position; items
    without a word are in no document.

    Seeds of the benchmark are broadcast in blocks of about ``block_seeds``.
    Null and empty texts hold nothing. Rows that repeat an id are searched together; a
    null id is an id of its own.
    """
    items = benchmark.select(F.col(item).alias("item"), _hashed_words(item_text).alias("item_words")).where(F.size("item_words") > 0)
    items = materialize(items.dropDuplicates(["item", "item_words"]), "items")
    # The lengths of short items, fewer than ``least_words``: each is a mask of its own that reads all words.
    short = [r.n for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < least_words).distinct().collect()]
    masks = [*masks, *[tuple(range(n)) for n in sorted(short)]]
    spaced = len(masks) - len(short)
    starts = _positions(items.select("item", F.size("item_words").alias("n"), "item_words"), "item_words", masks)
    # Only whole windows; a mask's own length is at most the longest. Short items have one seed, all their words.
    widths = F.array(*[F.lit(max(m)) for m in masks])
    at, mask = F.col("at"), F.col("mask")
    whole = at + F.get(widths, mask) < F.col("n")
    own = F.when(F.col("n") < least_words, (mask >= spaced) & (F.get(widths, mask) + 1 == F.col("n"))).otherwise(mask < spaced)
    seeds = materialize(starts.where(whole & own).select("seed", "item", at.alias("item_at")).distinct(), "seeds")
    blocks = max(1, -(-seeds.count() // block_seeds))

    texts = docs.select(F.col(id).alias("id"), _hashed_words(text).alias("words"))
    found = None
    for block in range(blocks):
        positions = _positions(texts, "words", masks).select("id", "at", "seed")
        part = seeds.where(F.pmod("seed", F.lit(blocks)) == block) if blocks > 1 else seeds
        hits = positions.join(F.broadcast(part), "seed").select("id", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        found = hits if found is None else found.union(hits)
    # Places, each once however many seeds hit there; combined before the shuffle.
    places = materialize(found.groupBy("id", "item", "shift").agg(F.count("*").alias("hits")), "places")
    held = materialize(places.select("id").distinct(), "hit-ids")
    held = F.broadcast(held) if held.count() <= sent_ids else held
    near = texts.alias("t").join(held.alias("h"), F.col("t.id").eqNullSafe(F.col("h.id")), "left_semi")
    placed = places.alias("p").join(near.alias("t"), F.col("p.id").eqNullSafe(F.col("t.id"))).select("p.id", "p.item", "p.shift", "t.words")
    placed = placed.alias("p").join(items.alias("i"), F.col("p.item").eqNullSafe(F.col("i.item"))).select("p.id", "p.item", "shift", "words", "item_words")
    same = F.transform("item_words", lambda w, i: F.coalesce(F.get("words", i + F.col("shift")) == w, F.lit(False)).cast("int"))
    compared = placed.select("id", "item", same.alias("same"))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    sums = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("same") - (WINDOW - 1), F.lit(1))),
        lambda i: F.aggregate(F.slice("same", i, WINDOW), F.lit(0), lambda a, x: a + x),
    )
    judged = compared.select("id", "item", total.alias("matched"), F.size("same").alias("n"), F.array_max(sums).alias("window"))
    enough = F.when(F.col("n") < least_words, F.col("n")).otherwise(F.greatest(share * F.col("n"), F.lit(LEAST_MATCHED)))
    leaked = judged.where((F.col("matched") >= enough) | (F.col("window") >= IN_WINDOW))
    best = leaked.groupBy("id", "item").agg(F.max("matched").cast("long").alias("matched"), F.max("n").cast("long").alias("words"))
    return best.select(
        F.col("id").alias(id), F.col("item").alias("item_id"), "matched", "words", (F.col("matched") / F.col("words")).alias("share")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item (see ``benchmark_leaks``); columns unchanged."""
    leaks = materialize(benchmark_leaks(docs, benchmark, id=id, **options).select(F.col(id).alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, F.col(id).eqNullSafe(F.col("_leak")), "left_anti")
