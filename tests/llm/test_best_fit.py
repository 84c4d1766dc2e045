"""Best-fit packing: plans against counts and bounds, pieces against a round trip."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluiceway.llm import best_fit
from sluiceway.llm.best_fit import Lengths, Places, plan_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
KINDS = {
    "even": lambda r: r.randint(1, 1023),
    "small": lambda r: min(1023, int(r.expovariate(1 / 80)) + 1),
    "long": lambda r: r.randint(500, 1000),
    "one": lambda r: 1,
}


def brute_sums(counts, most):
    from itertools import combinations_with_replacement

    out = {k: Counter() for k in (1, 2, 3)}
    for k in out:
        for c in combinations_with_replacement(sorted(counts), k):
            if all(counts[x] >= n for x, n in Counter(c).items()) and sum(c) <= most:
                out[k][sum(c)] += 1
    return out


def test_index_follows_what_is_available():
    rng = random.Random(1)
    left = Counter(rng.randint(1, 40) for _ in range(25))
    lengths = Lengths(left, 64)
    for _ in range(60):
        x = rng.choice(list(left)) if rng.random() < 0.7 and left else rng.randint(1, 40)
        step = rng.choice([1, 2]) if left[x] >= 2 else 1 if left[x] else -1
        lengths.take(x, step)
        left[x] -= step
        left = +left
        sums = brute_sums(left, 64)
        for total in range(1, 65):
            assert lengths.pairs[total] == sums[2][total] and lengths.triples[total] == sums[3][total]
            found = lengths.exact(total)
            assert bool(found) == any(sums[k][total] for k in (1, 2, 3))
            assert not found or (sum(found) == total and all(left[y] >= n for y, n in Counter(found).items()))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [1, 60, 20_000])
def test_plans_use_all_pieces_in_few_sequences(kind, n):
    rng = random.Random(n)
    counts = Counter(KINDS[kind](rng) for _ in range(n))
    plan = plan_sequences(dict(counts))
    used = Counter()
    for times, filling in plan:
        assert sum(length * k for length, k in filling.items()) <= 1024
        for length, k in filling.items():
            used[length] += times * k
    assert used == counts and len(plan) <= 2 * len(counts)
    least = max(-(-sum(x * k for x, k in counts.items()) // 1024), sum(k for x, k in counts.items() if x > 512))
    assert sum(times for times, _ in plan) <= least * 1.05 + 3
    places, filled = Places(plan), {}
    for length, count in counts.items():
        sequences, offsets = places(np.full(count, length), np.arange(count))
        for s, o in zip(sequences.tolist(), offsets.tolist()):
            filled.setdefault(s, []).append((o, length))
    assert sorted(filled) == list(range(places.sequences))
    for parts in filled.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 1024


def test_round_trip(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "ünïcode", "漢字", "  ", "\n", "x<|endoftext|>y", "👍", "12345", "don't"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 400, 3000]))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "a " * 30_000, 203: "漢" * 4000, 204: "word " * 1023, 205: "word " * 1022}
    rows = [(i, t, "s", 3, 4) for i, t in texts.items()] + [(None, "of no id", "s", 3, 4)]
    rows += [(300 + i, "the same text again", "s", 3, 4) for i in range(60)] + [(5, texts[5], "s", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string, n int, row int").repartition(5)
    pieces = best_fit.pack_best_fit(df, PATH).select("*", F.crc32("ids").alias("crc")).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, *_ in rows:
        ids, at, k = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0, 0
        while at < len(ids):
            length = len(ids) - at - (len(ids) - at - 1) // 1024 * 1024
            want[i, k, at, length, zlib.crc32(np.array(ids[at : at + length], dtype="<u4").tobytes())] += 1
            at, k = at + length, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in pieces) == want
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in pieces) // 1024) * 1.03 + 2
    assert best_fit.pack_best_fit(df.limit(0), PATH).count() == 0
