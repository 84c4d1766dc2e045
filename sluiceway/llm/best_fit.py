"""Best-fit packing: combinations of lengths that fill a sequence exactly, then the best fit for what is left."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluiceway.llm.packing import in_groups, worker_encoder
from sluiceway.operators.ordering import running_totals
from sluiceway.session import materialize

SEQUENCE = 1024
END = 2
# Bits that hold a rank beside a length.
RANK_BITS = 44


class Lengths:
    """Available lengths, with an index of the sums of one, two and three of them.

    ``pairs[s]`` and ``triples[s]`` count the combinations with repetition
    that sum to s; a length may come as often in one as it is available.
    """

    def __init__(self, counts: dict[int, int], sequence: int) -> None:
        self.left = np.zeros(sequence + 1, dtype=np.int64)
        self.pairs = np.zeros(sequence + 1, dtype=np.int64)
        self.triples = np.zeros(sequence + 1, dtype=np.int64)
        for length, count in counts.items():
            self.take(length, -count)

    def take(self, length: int, times: int) -> None:
        """Take ``times`` of a length; negative: put back."""
        before, after = min(self.left[length], 3), min(self.left[length] - times, 3)
        if before != after:
            self._count(length, int(before), -1)
            self._count(length, int(after), 1)
        self.left[length] -= times

    def _count(self, length: int, copies: int, sign: int) -> None:
        """Add (or with -1 remove) what ``copies`` of a length contribute to the sums."""
        if not copies:
            return
        size = len(self.left)
        others = (self.left > 0).astype(np.int64)
        others[length] = 0
        if sign < 0:
            self._pair(length, copies, sign, others)
        self.triples[length:] += sign * self.pairs[: size - length]
        if copies >= 2 and 2 * length < size:
            self.triples[2 * length :] += sign * others[: size - 2 * length]
        if copies >= 3 and 3 * length < size:
            self.triples[3 * length] += sign
        if sign > 0:
            self._pair(length, copies, sign, others)

    def _pair(self, length: int, copies: int, sign: int, others: np.ndarray) -> None:
        size = len(self.left)
        self.pairs[length:] += sign * others[: size - length]
        if copies >= 2 and 2 * length < size:
            self.pairs[2 * length] += sign

    def best(self, gap: int) -> int:
        """The largest available length that fits, or 0."""
        fits = np.flatnonzero(self.left[: gap + 1])
        return int(fits[-1]) if len(fits) else 0

    def _two(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths of that sum, the larger one as large as can be."""
        high = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        if not len(high):
            return None
        low = total - high
        good = np.flatnonzero((self.left[high] > 0) & (self.left[low] > (high == low)))
        return (int(high[good[0]]), int(low[good[0]])) if len(good) else None

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that sum to the gap, long ones first; none if there are none."""
        if self.left[gap]:
            return (gap,)
        if self.pairs[gap] and (two := self._two(gap, gap)):
            return two
        if self.triples[gap]:
            for first in np.flatnonzero(self.left[: gap - 1])[::-1].tolist():
                if 3 * first < gap:
                    break
                if self.pairs[gap - first]:
                    self.left[first] -= 1
                    two = self._two(gap - first, first)
                    self.left[first] += 1
                    if two:
                        return (first, *two)
        return ()


def plan_sequences(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, Counter]]:
    """How often to fill a sequence with which lengths: (times, lengths), every counted length used up.

    ``counts`` has the lengths below ``sequence`` and how many pieces have
    them. A sequence starts with the longest length left. If one, two or three
    others fill its gap exactly, they do; else the best fit goes in and the new
    gap is tried again, until nothing fits. A filling is repeated as long as its
    lengths last, so that the plan's size depends on the number of lengths
    and not on that of the pieces.
    """
    lengths, plan = Lengths(counts, sequence), []
    longest = lengths.best(sequence)
    while longest:
        filling, gap = Counter([longest]), sequence - longest
        lengths.take(longest, 1)
        while gap:
            more = lengths.exact(gap)
            if not more:
                more = (best,) if (best := lengths.best(gap)) else ()
            if not more:
                break
            for length in more:
                lengths.take(length, 1)
                filling[length] += 1
                gap -= length
        again = min(int(lengths.left[length]) // times for length, times in filling.items())
        for length, times in filling.items():
            lengths.take(length, times * again)
        plan.append((1 + again, filling))
        longest = lengths.best(longest)
    return plan


class Places:
    """Where the pieces of a plan go: of each length, the piece of each rank."""

    def __init__(self, plan: list[tuple[int, Counter]]) -> None:
        rows, used, sequences = [], Counter(), 0
        for repeats, filling in plan:
            base = 0
            for length, times in sorted(filling.items(), reverse=True):
                rows.append(((length << RANK_BITS) + used[length], used[length], sequences, times, base))
                used[length] += repeats * times
                base += length * times
            sequences += repeats
        self.sequences = sequences
        self.starts, self.ranks, self.first, self.times, self.base = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks among their length."""
        at = np.searchsorted(self.starts, (lengths << RANK_BITS) + ranks, side="right") - 1
        nth = ranks - self.ranks[at]
        return self.first[at] + nth // self.times[at], self.base[at] + nth % self.times[at] * lengths


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, END)
        for batch in batches:
            ids, texts, done = batch.column(0), batch.column(1).to_pylist(), 0
            for group in in_groups([t or "" for t in texts]):
                tokens = encoder(group)
                lengths = pa.array([len(t) // encoder.width for t in tokens], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(group)), lengths, pa.array(tokens, pa.binary())], names=["id", "n", "tokens"])
                done += len(group)

    return run


def _pieces(places: Places, sequence: int):
    """Pieces of each document: the first by the plan, whole sequences numbered after the planned ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, rank, whole = (batch.column(c).to_numpy() for c in ("n", "first", "rank", "whole"))
            short = first < sequence
            sequences, offsets = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            sequences[short], offsets[short] = places(first[short], rank[short])
            raw = batch.column("tokens").to_pylist()
            out = {k: [] for k in ("row", "piece", "start", "length", "sequence", "offset", "ids")}
            for k in range(len(n)):
                tokens = np.frombuffer(raw[k], dtype="<u2" if len(raw[k]) == 2 * n[k] else "<u4").astype("<u4")
                start, length, number = 0, int(first[k]), places.sequences + int(whole[k])
                for piece in range(1 + (len(tokens) - length) // sequence):
                    planned = piece == 0 and short[k]
                    out["row"].append(k)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["sequence"].append(int(sequences[k]) if planned else number)
                    out["offset"].append(int(offsets[k]) if planned else 0)
                    out["ids"].append(tokens[start : start + length].tobytes())
                    number += not planned
                    start, length = start + length, sequence
            kinds = {"piece": pa.int32(), "ids": pa.binary()}
            columns = [batch.column("id").take(pa.array(out.pop("row"), pa.int64()))]
            columns += [pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "sequence_id", "offset", "ids"])

    return run


def pack_best_fit(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of documents in about as few sequences of at most ``sequence`` tokens as there can be.

    A document is the ids of its whole text by the tokenizer file, then id 2.
    Longer ones are cut so that all pieces but the first are whole sequences.
    First pieces are only counted by length, which gives at most ``sequence``
    numbers for any table; ``plan_sequences`` plans on these counts. A piece
    finds its place by its length and its rank among pieces of that length.

    Returns per piece ``id``, piece (from 0), start (tokens of its document
    before it), length, sequence_id (from 0 without gaps, planned ones first),
    offset (gapless from 0), and ids (little-endian 32-bit numbers). Null texts
    are empty: one token. Repeated rows and null ids are documents of their
    own; an empty table gives no pieces.
    """
    kind = dict(docs.dtypes)[id]
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    encoded = source.mapInArrow(_tokenized(tokenizer), f"id {kind}, n long, tokens binary")
    encoded = materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "fit-tokens", compression="zstd")
    first = F.pmod(F.col("n") - 1, F.lit(sequence)) + 1
    whole = (F.col("n") - first) / sequence + (first == sequence).cast("long")
    slim = encoded.select("row", "n", first.alias("first"), whole.cast("long").alias("n_whole"))
    counts = {r["first"]: r["count"] for r in slim.where(F.col("first") < sequence).groupBy("first").count().collect()}
    places = Places(plan_sequences(counts, sequence))
    ranked = running_totals(slim, ["first"], ["row"], {"rank": F.lit(1)})
    ranked = running_totals(ranked, [], ["row"], {"whole": F.col("n_whole")}).select("row", "first", "rank", "whole")
    laid = encoded.join(ranked, "row").select("id", "n", "first", "rank", "whole", "tokens")
    schema = f"id {kind}, piece int, start long, length long, sequence_id long, offset long, ids binary"
    return laid.mapInArrow(_pieces(places, sequence), schema).withColumnRenamed("id", id)
