"""Signatures, marks and comparisons of lines over Arrow batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sluiceway.llm.shingles import different, mix

# Characters of a shingle.
SHINGLE = 5
# Characters that are hashed at a time; a longer line goes through in pieces that overlap.
PIECE = 1 << 18
# One permutation in parts: the lowest bits of a hash name its part, and the least hashes of a part, so many, are the
# minima that make one band. Two lines at the threshold agree on a band one time in three, so they miss all of 14 about
# four times in 1,000. Lines of up to ALL shingles take the runs at every place instead, so short that no likeness can
# break them all; those of PARTED and more take the parts.
RUN, BANDS, PART_BITS = 5, 14, 4
PARTED, ALL = 40, 49
# Runs of four hold from 16 shingles on, of three from 6; partners may have a quarter more.
RUNS = [(2, 1, 6), (3, 6, 18), (4, 16, ALL)]
# Words of 64 bits; each shingle of a line turns one bit, so that two lines differ in at most as many bits as shingles.
MARKS = 16

# A hash in a line's sorted list: its part above, then as many of its other bits as fit; the line's number goes above.
DIGITS = 44
OWNER = DIGITS + PART_BITS
# Fills up a line shorter than a shingle; no decoded text holds it.
FILL = "\ud800"
FACTORS = mix(np.arange(211, 211 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _groups(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring lines of up to ``PIECE`` characters together; a longer line is alone."""
    start = size = 0
    for i, line in enumerate(lines):
        if i > start and (size + len(line) > PIECE or i - start >= 1 << 15):
            yield start, i
            start, size = i, 0
        size += len(line)
    if start < len(lines):
        yield start, len(lines)


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of each line, and the number of its line. A shorter line is one shingle."""
    lines = [line.ljust(SHINGLE, FILL) for line in lines]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), [len(line) for line in lines])
    n = len(codes) - SHINGLE + 1
    total = codes[:n] * FACTORS[0]
    for k in range(1, SHINGLE):
        total += codes[k : k + n] * FACTORS[k]
    inside = owner[:n] == owner[SHINGLE - 1 :]
    return mix(total[inside]), owner[:n][inside]


def _pieces(line: str) -> Iterator[str]:
    for at in range(0, max(1, len(line) - SHINGLE + 1), PIECE):
        yield line[at : at + PIECE + SHINGLE - 1]


def shingle_set(line: str) -> np.ndarray:
    """Hashes of the different shingles of a line, in order."""
    return different(np.concatenate([different(_hashed([piece])[0]) for piece in _pieces(line)]))


def shingle_sets(lines: list[str]) -> Iterator[np.ndarray]:
    """``shingle_set`` of each line; short neighbours are hashed together."""
    for start, end in _groups(lines):
        if end - start == 1:
            yield shingle_set(lines[start])
            continue
        hashes, owner = _hashed(lines[start:end])
        for part in np.split(hashes, np.searchsorted(owner, np.arange(1, end - start, dtype=np.uint64))):
            yield different(part)


def _ordered(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(line, part, digits) of the different shingles in one number each, sorted."""
    parts = hashes & np.uint64((1 << PART_BITS) - 1)
    return different((owner << np.uint64(OWNER)) | (parts << np.uint64(DIGITS)) | (hashes >> np.uint64(64 - DIGITS)))


def _cut(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sorted ``values`` with the ``RUN`` least of each part; those of lines of up to ``ALL`` shingles whole."""
    group = values >> np.uint64(DIGITS)
    fresh = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    rank = np.arange(len(values)) - np.repeat(fresh, np.diff(np.append(fresh, len(values))))
    return values[(rank < RUN) | (sizes[(values >> np.uint64(OWNER)).astype(np.int64)] <= ALL)]


def _least(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What ``keys_of`` reads of each line: its least hashes by part (all, if few), and how many it has (or more than ``ALL``)."""
    if len(lines) == 1:
        values, size = np.array([], dtype=np.uint64), 0
        for piece in _pieces(lines[0]):
            values = different(np.concatenate([values, _ordered(*_hashed([piece]))]))
            size = max(size, len(values))
            values = _cut(values, np.array([size]))
        return values, np.array([size])
    values = _ordered(*_hashed(lines))
    sizes = np.bincount((values >> np.uint64(OWNER)).astype(np.int64), minlength=len(lines))
    return _cut(values, sizes), sizes


def _named(values: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """A key for the values at each row of places."""
    key = np.full(len(places[0]), len(places), dtype=np.uint64)
    for at in places:
        key = mix(key * STEP + (values[at] & np.uint64((1 << OWNER) - 1)))
    return key


def keys_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the buckets that each line goes to, by line.

    Up to ``ALL`` shingles every run of neighbours among the ordered hashes is a key. With ``c`` shingles in common
    and ``d`` not, runs of ``r`` common neighbours exist wherever c > (r - 1) * (d + 1). From ``PARTED`` on, each of
    the ``BANDS`` parts gives one key, of its ``RUN`` least hashes (and the next part's, if it has fewer).
    """
    values, sizes = _least(lines)
    owner = (values >> np.uint64(OWNER)).astype(np.int64)
    size, at = sizes[owner], np.arange(len(values))
    ends = np.searchsorted(owner, np.arange(len(lines)), side="right")[owner]
    owners, keys = [], []
    for run, fewest, most in RUNS:
        starts = np.flatnonzero((size >= fewest) & (size <= most) & ((at + run <= ends) | (size < run)))
        owners.append(owner[starts])
        keys.append(_named(values, [np.minimum(starts + k, ends[starts] - 1) for k in range(run)]))
    part = (values >> np.uint64(DIGITS)) & np.uint64((1 << PART_BITS) - 1)
    kept = (size >= PARTED) & (part < BANDS)
    values, owner, group = values[kept], owner[kept], (values >> np.uint64(DIGITS))[kept]
    if len(values):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.searchsorted(owner, owner[starts])
        many = np.searchsorted(owner, owner[starts], side="right") - first
        owners.append(owner[starts])
        keys.append(_named(values, [first + (starts - first + k) % many for k in range(RUN)]))
    owners, keys = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owners, kind="stable")
    return owners[order], keys[order]


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column, the line, is replaced by the list of its ``keys``."""
    for batch in batches:
        lines = batch.column(batch.num_columns - 1).to_pylist()
        counts, keys = [], []
        for start, end in _groups(lines):
            owner, key = keys_of(lines[start:end])
            counts.append(np.bincount(owner, minlength=end - start))
            keys.append(key.view(np.int64))
        edges = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.array([0])
        values = pa.array(np.concatenate(keys) if keys else np.array([], dtype=np.int64))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
        names = [*batch.schema.names[:-1], "keys"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=names)


def compared(percent: int):
    """(centre, member, first, second) to (centre, member, linked): by whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(shingle_sets(batch.column(2).to_pylist()), shingle_sets(batch.column(3).to_pylist())):
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * common >= percent * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["centre", "member", "linked"])

    return run


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, line) to (id, n, b0, b1, ..., line): the number of shingles, and bits of which each shingle turns one."""
    names = ["id", "n", *[f"b{k}" for k in range(MARKS)], "line"]
    for batch in batches:
        sizes, words = [], []
        for hashes in shingle_sets(batch.column(1).to_pylist()):
            bits = np.bincount((hashes % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1 == 1
            sizes.append(len(hashes))
            words.append(np.packbits(bits).view(np.int64))
        table = np.array(words, dtype=np.int64).reshape(-1, MARKS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *[pa.array(table[:, k].copy()) for k in range(MARKS)], batch.column(1)], names=names)
