"""Signatures, sets and marks of lines against plain Python."""

import random

import numpy as np
import pyarrow as pa

from sluiceway.llm import line_sets


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def lines():
    rng = random.Random(2)
    many = ["a", "abcd", "abcde", "aaaaaaaaaa", "\U0001F600一", "Advertisement 12"]
    many += ["".join(rng.choices("etaoin shr一é", k=rng.randint(1, 900))) for _ in range(80)]
    return many, rng


def test_sets_of_short_and_long_lines(monkeypatch):
    many, rng = lines()
    want = [len(shingles(s)) for s in many]
    assert [len(s) for s in line_sets.shingle_sets(many)] == want
    whole = [line_sets.shingle_set(s) for s in many]
    monkeypatch.setattr(line_sets, "PIECE", 64)  # most lines go through in pieces
    for got, s in zip(line_sets.shingle_sets(many), whole):
        assert (got == s).all()


def test_keys_do_not_depend_on_neighbours_or_pieces(monkeypatch):
    many, _ = lines()
    owners, keys = line_sets.keys_of(many)
    together = [set(keys[owners == i].tolist()) for i in range(len(many))]
    assert all(together) and len({frozenset(k) for k in together}) == len(set(many))
    alone = [set(line_sets.keys_of([s])[1].tolist()) for s in many]
    monkeypatch.setattr(line_sets, "PIECE", 64)
    pieces = [set(line_sets.keys_of([s])[1].tolist()) for s in many]
    assert together == alone == pieces


def test_marks_never_rule_out_a_like_line():
    many, rng = lines()
    others = [s[: len(s) // 2] + rng.choice("XYZ") + s[len(s) // 2 :] for s in many]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["id", "line"])
    (one,), (two,) = (list(line_sets.marked([batch(rows)])) for rows in (many, others))
    for i, (a, b) in enumerate(zip(many, others)):
        bits = sum(int(np.int64(one.column(k)[i].as_py() ^ two.column(k)[i].as_py()).astype(np.uint64)).bit_count() for k in range(2, 2 + line_sets.MARKS))
        assert one.column(1)[i].as_py() == len(shingles(a)) and bits <= len(shingles(a) ^ shingles(b))


def test_empty_batches():
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["id", "line"])
    assert [b.num_rows for b in line_sets.signed([none])] == [0]
    assert [b.num_rows for b in line_sets.marked([none])] == [0]
