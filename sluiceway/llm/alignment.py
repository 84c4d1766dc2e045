"""Alignment of two tokenizers' tokens by sparse products of their incidence with bytes."""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluiceway.llm.packing import in_groups, worker_encoder
from sluiceway.session import materialize

# Both tokenizers always cut at a space between visible characters.
SEGMENTS = re.compile(r"(?<=\S) (?=\S)")
# Bits of an id of the second tokenizer within a pair.
PAIR_BITS = 18
# Aligned segments that a worker keeps, and the longest one that it keeps.
KEPT, KEPT_CHARS = 400_000, 64
# Tokens that end together are suffixes of one another; so many different pairs are possible at most (see ``link_counts``).
MOST_PAIRS = 4_000_000


class Csr(NamedTuple):
    """A sparse matrix of whole numbers: row i has ``columns[starts[i]:starts[i + 1]]`` with these ``values``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @staticmethod
    def of_lengths(lengths: np.ndarray, columns: np.ndarray | None = None) -> Csr:
        """Rows of the given lengths, with ones; by default they take the columns in turn."""
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        columns = np.arange(starts[-1]) if columns is None else columns
        return Csr(starts, columns, np.ones(len(columns), dtype=np.int64))

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self, width: int) -> Csr:
        """Columns become rows, entries in the order of the rows they had."""
        order = np.argsort(self.columns, kind="stable")
        counts = np.bincount(self.columns, minlength=width)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), self.rows()[order], self.values[order])

    def taken(self, rows: np.ndarray) -> Csr:
        """The matrix of the given rows, in their order."""
        lengths = np.diff(self.starts)[rows]
        at = _ranges(self.starts[:-1][rows], lengths)
        return Csr(np.concatenate([[0], np.cumsum(lengths)]), self.columns[at], self.values[at])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] places, then from starts[1] on, and so on."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def product(a: Csr, b: Csr, width: int) -> Csr:
    """The product of two sparse matrices by rows, ``b`` having ``width`` columns (Gustavson).

    Row i is the sum of the rows of ``b`` that the entries of row i name, each
    times its entry; equal columns of a row are added up. Work and memory go
    with the entries that are read, not with the shape.
    """
    lengths = np.diff(b.starts)[a.columns]
    at = _ranges(b.starts[:-1][a.columns], lengths)
    keys = np.repeat(a.rows(), lengths) * width + b.columns[at]
    values = np.repeat(a.values, lengths) * b.values[at]
    if len(keys) and (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    values = np.add.reduceat(values, first) if len(first) else values
    rows, columns = np.divmod(keys[first], width)
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(a.starts) - 1))])
    return Csr(starts.astype(np.int64), columns, values)


class Links(NamedTuple):
    """What joins the tokens of one text: rows are tokens of A, columns those of B."""

    overlap: Csr  # values: bytes that both cover
    closing: np.ndarray  # entries of ``overlap`` whose tokens end together
    groups_a: np.ndarray  # group of each token of A
    groups_b: np.ndarray


def link_tokens(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Links:
    """Links of two cuts of the same bytes, given by the lengths of their tokens.

    The tokens-by-bytes matrices give overlaps as A times B transposed. Where
    both tokens of an overlap end together, a group of tokens ends.
    """
    a, b = Csr.of_lengths(lengths_a), Csr.of_lengths(lengths_b)
    overlap = product(a, b.transposed(int(b.starts[-1])), len(lengths_b))
    closing = np.flatnonzero(a.starts[1:][overlap.rows()] == b.starts[1:][overlap.columns])
    ends_a, ends_b = overlap.rows()[closing], overlap.columns[closing]
    group = lambda ends, n: np.searchsorted(ends, np.arange(n))
    return Links(overlap, closing, group(ends_a, len(lengths_a)), group(ends_b, len(lengths_b)))


def shared_group_links(links: Links, rows: slice = slice(None)) -> Csr:
    """Which tokens of A (of the given rows) share a group with which of B: group incidences times one another."""
    mine = links.groups_a[rows]
    a = Csr.of_lengths(np.ones(len(mine), dtype=np.int64), mine)
    width = int(links.groups_b.max(initial=-1)) + 1
    b = Csr.of_lengths(np.ones(len(links.groups_b), dtype=np.int64), links.groups_b)
    return product(a, b.transposed(width), max(1, len(links.groups_b)))


def closing_links(links: Links) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and B that end together: the group incidences of the tokens that end a group, multiplied."""
    groups = len(links.closing)
    width = len(links.groups_b)
    end_a, end_b = links.overlap.rows()[links.closing], links.overlap.columns[links.closing]
    a = Csr.of_lengths(np.bincount(end_a, minlength=len(links.groups_a)), links.groups_a[end_a])
    b = Csr.of_lengths(np.bincount(end_b, minlength=width), links.groups_b[end_b])
    made = product(a, b.transposed(groups), max(1, width))
    return made.rows(), made.columns


class Aligner:
    """Tokens and links of whole texts; segments met before are kept.

    Segments are what both tokenizers encode on their own: between a space and
    the visible character after it they always cut. Segments that are new to a
    batch become one block of the matrices, and documents are products of
    their segments.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.encoder = worker_encoder(path_a, None, True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        # The byte-level alphabet: visible Latin-1 characters stand for themselves, the rest follows from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        names = {n: t for t, n in model["model"]["vocab"].items()}
        plain = {t["id"] for t in model["added_tokens"]}
        self.bytes_a = [bytes(byte[c] for c in names[n]) if n in names and n not in plain else b"" for n in range(max(names) + 1)]
        self.bytes_b = [self._piece(n) for n in range(self.pieces.get_piece_size())]
        assert max(len(self.bytes_a), len(self.bytes_b)) <= 1 << PAIR_BITS
        space = "▁"
        self.cuts = not any(re.search(f"[^{space}]{space}", self.pieces.id_to_piece(n)) for n in range(self.pieces.get_piece_size()))
        self._forget()

    def _piece(self, n: int) -> bytes:
        name = self.pieces.id_to_piece(n)
        return bytes([int(name[1:-1], 16)]) if self.pieces.is_byte(n) else name.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str | None] = []  # groups as text; None: bytes that differ
        self.counts: list[tuple[int, int, int]] = []  # tokens of A, of B, links
        self.pairs: list[np.ndarray] = []

    def _add(self, segments: list[str]) -> None:
        """Align segments, each with a space before it."""
        first = len(self.shown)
        ids_a = [self.encoder.ids(f" {s}") for s in segments]
        ids_b = self.pieces.encode(segments, num_threads=1)
        joined = lambda known, ids: b"".join(map(known.__getitem__, ids))
        whole = [f" {s}".encode() for s in segments]
        good = [joined(self.bytes_a, a) == w == joined(self.bytes_b, b) for w, a, b in zip(whole, ids_a, ids_b)]
        self.shown += [None] * len(segments)
        self.counts += [(0, 0, 0)] * len(segments)
        self.pairs += [np.zeros(0, dtype=np.int64)] * len(segments)
        good_at = [k for k, g in enumerate(good) if g]
        flat_a = np.array([t for k in good_at for t in ids_a[k]], dtype=np.int64)
        flat_b = np.array([t for k in good_at for t in ids_b[k]], dtype=np.int64)
        links = link_tokens(
            np.array([len(self.bytes_a[t]) for t in flat_a.tolist()], dtype=np.int64),
            np.array([len(self.bytes_b[t]) for t in flat_b.tolist()], dtype=np.int64),
        )
        rows, columns = closing_links(links)
        pairs = (flat_a[rows] << PAIR_BITS) | flat_b[columns]
        last_a, last_b = (rows + 1).tolist(), (columns + 1).tolist()
        at_a = at_b = at = 0
        for k in good_at:
            a, b = ids_a[k], ids_b[k]
            from_a, from_b, from_link = at_a, at_b, at
            text = []
            while at_a < from_a + len(a):
                left = ",".join(map(str, a[at_a - from_a : last_a[at] - from_a]))
                text.append(f"{left}|{','.join(map(str, b[at_b - from_b : last_b[at] - from_b]))}")
                at_a, at_b, at = last_a[at], last_b[at], at + 1
            self.shown[first + k] = ";".join(text)
            self.counts[first + k] = (len(a), len(b), at - from_link)
            self.pairs[first + k] = pairs[from_link:at]
        self.known.update(zip(segments, range(first, first + len(segments))))

    def __call__(self, texts: list[str]) -> list[pa.Array]:
        """Columns n_a, n_b, n_links, groups, pairs, times of a batch of texts."""
        if len(self.known) > KEPT:
            self._forget()
        split = [(SEGMENTS.split(t) if self.cuts else [t]) if t else [] for t in texts]
        new = list({s for parts in split for s in parts} - self.known.keys())
        if new:
            self._add(new)
        slots = [list(map(self.known.__getitem__, parts)) for parts in split]
        groups = [list(map(self.shown.__getitem__, s)) for s in slots]
        slots = [[] if None in g else s for s, g in zip(slots, groups)]
        groups = ["" if None in g else ";".join(g) for g in groups]
        docs = Csr.of_lengths(np.array([len(s) for s in slots], dtype=np.int64), np.array([k for s in slots for k in s], dtype=np.int64))
        used, docs_of_used = np.unique(docs.columns, return_inverse=True)
        # Documents by segments times segments by pairs.
        rows = [self.pairs[k] for k in used.tolist()]
        of_segments = Csr.of_lengths(np.array([len(r) for r in rows], dtype=np.int64), np.concatenate([*rows, np.zeros(0, dtype=np.int64)]))
        made = product(docs._replace(columns=docs_of_used), of_segments, 1 << (2 * PAIR_BITS))
        counts = np.array([self.counts[k] for k in used.tolist()], dtype=np.int64).reshape(-1, 3)
        sums = np.concatenate([np.zeros((1, 3), dtype=np.int64), np.cumsum(counts[docs_of_used], axis=0)])
        sums = sums[docs.starts[1:]] - sums[docs.starts[:-1]]
        for s in new:  # long ones come once
            if len(s) > KEPT_CHARS:
                k = self.known.pop(s)
                self.shown[k], self.pairs[k] = None, np.zeros(0, dtype=np.int64)
        starts = pa.array(made.starts, pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(v)) for v in (made.columns, made.values)]
        return [*(pa.array(sums[:, k]) for k in range(3)), pa.array(groups, pa.string()), *lists]


def _worker_aligner(path_a: str, path_b: str) -> Aligner:
    store = sys.modules.setdefault("sluiceway_worker", types.ModuleType("sluiceway_worker"))
    if getattr(store, "aligned", None) != (path_a, path_b):
        store.aligner, store.aligned = Aligner(path_a, path_b), (path_a, path_b)
    return store.aligner


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker_aligner(path_a, path_b)
        for batch in batches:
            ids, texts, done = batch.column(0), batch.column(1).to_pylist(), 0
            for group in in_groups([t or "" for t in texts]):
                columns = aligner(group)
                names = ["id", "n_a", "n_b", "n_links", "groups", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(group)), *columns], names=names)
                done += len(group)

    return run


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's tokens by a byte-level tokenizer (A) and a sentence-piece model (B), aligned by bytes.

    Returns per document ``id``, n_a and n_b (tokens), n_links (pairs of tokens
    that end together, one a group), groups (``a1,a2|b1;a3|b2,b3``: ids between
    places where both end), pairs (different linked id pairs, A's id shifted by
    ``PAIR_BITS`` plus B's id) and times (how often each is linked).

    A reads a space and the text, B the text, before which it puts a space.
    Null and empty texts, and texts that one of both does not give back, have
    no tokens: zeros, empty text and lists. Special tokens' strings are plain
    text. Repeated rows and null ids are documents of their own.
    """
    kind = dict(docs.dtypes)[id]
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind}, n_a long, n_b long, n_links long, groups string, pairs array<long>, times array<long>"
    return source.mapInArrow(_aligned(tokenizer_a, tokenizer_b), schema).withColumnRenamed("id", id)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_pair, best): how many links hold each id pair, and whether that is the most for its B id.

    Of two tokens that end together the shorter is a suffix of the longer. A
    token has as many suffixes as bytes, so that the pairs are at most as many
    as the bytes of both vocabularies (times the ids of equal bytes), however
    large the corpus. The result may be sent to every task.
    """
    links = aligned.select(F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("n_pair"))
    b = F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
    counts = materialize(counts.withColumn("b", b), "link-counts")
    best = counts.groupBy("b").agg(F.max("n_pair").alias("most"))
    return counts.join(best, "b").select("pair", "n_pair", (F.col("n_pair") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of a written ``aligned`` with n_best (links of the most frequent pair of their B id) and
    count_sum (counts of all links' pairs added up)."""
    counts = link_counts(aligned)
    if counts.count() > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} id pairs: too many to send to every task")
    links = aligned.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", *columns, F.inline_outer(F.arrays_zip("pairs", "times")).alias("pair", "_times")
    )
    none = F.lit(0).cast("long")
    counted = links.join(F.broadcast(counts), "pair", "left")
    return counted.groupBy("_row", *columns).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("_times"))), none).alias("n_best"),
        F.coalesce(F.sum(F.col("_times") * F.col("n_pair")), none).alias("count_sum"),
    ).drop("_row")
