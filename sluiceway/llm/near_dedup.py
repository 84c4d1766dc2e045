"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sluiceway.llm.components import connected_components
from sluiceway.llm.pairs import with_both
from sluiceway.llm.search import PAIR, PLACED, search_links
from sluiceway.llm.shingles import WordHasher, different, mix, shingle_hashes
from sluiceway.session import few, materialize, passing, small

WIDTH = 5
# Bands of rows: pairs at similarity 0.85 share no bucket once in 2 million.
BANDS, ROWS = 25, 5
# Bytes of shingle sets that go to every task; beyond them pairs are shuffled to their sets.
SENT = 16 << 20


def _densify_table(bins: int, tries: int = 256) -> np.ndarray:
    """Where an empty bin looks for a value: seeded draws over all bins, one column per try."""
    cells = np.arange(bins * tries, dtype=np.uint64) + np.uint64(1 << 40)
    return (mix(cells) % np.uint64(bins)).astype(np.int64).reshape(bins, tries)


def signature(hashes: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The least hash of every bin; an empty bin borrows from the first filled one it draws.

    ``hashes`` are distinct, sorted and not empty; ``edges`` the lower ends of the bins.
    """
    at = np.searchsorted(hashes, edges)
    ends = np.append(at[1:], len(hashes))
    full = ends > at
    out = hashes[np.minimum(at, len(hashes) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        drawn = full[table[empty]]
        first = np.argmax(drawn, axis=1)
        donors = table[empty, first]
        lost = ~drawn[np.arange(len(empty)), first]
        if lost.any():  # no draw met a filled bin: the next one filled, around the end
            filled = np.flatnonzero(full)
            donors[lost] = filled[np.searchsorted(filled, empty[lost]) % len(filled)]
        out = out.copy()
        out[empty] = out[donors]
    return out


def _sets(batch: pa.RecordBatch, hasher: WordHasher, width: int) -> Iterator[np.ndarray]:
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(1).to_pylist()]
    for words in hasher.texts(raws):
        yield different(shingle_hashes(words, width))


def _signed(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bins = WordHasher(), bands * rows
        edges = np.array([-(-i * (1 << 64) // bins) for i in range(bins)], dtype=np.uint64)
        table = _densify_table(bins)
        factors = mix(np.arange(11, 11 + rows, dtype=np.uint64))
        numbers = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for hashes in _sets(batch, hasher, width):
                sizes.append(len(hashes))
                if len(hashes):
                    digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    values = signature(hashes, edges, table).reshape(bands, rows)
                    keys.append(mix((values * factors).sum(axis=1, dtype=np.uint64) + numbers).view(np.int64))
                else:
                    digests.append(None)
                    keys.append(np.array([], dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "digest", "keys"],
            )

    return run


def _hashed(width: int):
    """Whole sets of the rows whose set has the wanted digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = [h.tobytes() for h in _sets(batch, hasher, width)]
            wanted = batch.column(2).to_pylist()
            keep = pa.array([hashlib.blake2b(f, digest_size=16).digest() == w for f, w in zip(found, wanted)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "hashes"]).filter(keep)

    return run


COMPARED = ["centre", "member", "linked", "common", "own", "enough", "any", "limit"]


def _compared(percent: int):
    """Verdict on each pair, and for a pair that fails what of the second set can lead to its other partners.

    Say set x shares o elements with the centre c, too few. A partner y that
    holds none of x - c shares o at most, so it has at most
    o * (1 + t) / t - |x| elements (``limit``). All other partners hold
    elements of x - c (``own``): one at least, and where ``percent`` % of x are
    more than o, so many that any ``enough`` of x - c hold one. Partners within
    the limit, if it leaves any, are sought by ``any``: so many elements of x
    that one must be shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, two in zip(batch.column(2), batch.column(3)):
                c, x = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (one, two))
                shared = np.intersect1d(c, x, assume_unique=True)
                both = len(shared)
                if 100 * both >= percent * (len(c) + len(x) - both):
                    rows.append((True, both, None, 0, None, 0))
                    continue
                least = -(-percent * len(x) // 100)
                own = np.setdiff1d(x, c, assume_unique=True)
                limit = both * (100 + percent) // percent - len(x)
                within = np.concatenate([own, shared])[: len(x) - least + 1] if limit >= least else own[:0]
                enough = len(own) - max(1, least - both) + 1
                rows.append((False, both, own.view(np.int64), enough, within.view(np.int64), limit))
            kinds = (pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=COMPARED)

    return run


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, tag: str, sent: bool) -> DataFrame:
    """Pairs (centre, member) with their verdicts, from the whole sets."""
    both = with_both(pairs, sets, "hashes", sent=sent, led=few(pairs, PAIR, SENT))
    schema = "centre long, member long, linked boolean, common long, own array<bigint>, enough long, any array<bigint>, limit long"
    return materialize(both.mapInArrow(_compared(percent), schema), tag)


def _centres(members: DataFrame) -> DataFrame:
    """(key, centre): in each bucket of two and more, the member whose buckets hold most rows."""
    weight = small(materialize(members.groupBy("id").agg(F.sum("rows").alias("weight")), "weights"), 16)
    top = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("back"))).alias("top"))
    return small(materialize(top.select("key", (-F.col("top.back")).alias("centre")), "centres"), 16)


def _stars(members: DataFrame, centres: DataFrame) -> DataFrame:
    """(centre, member) pairs of every bucket."""
    pairs = members.join(centres, "key").where(F.col("id") != F.col("centre"))
    return pairs.select("centre", F.col("id").alias("member")).distinct()


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", percent: int = 85, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Classes of documents whose sets of ``width``-word shingles are alike.

    Words are lower-cased (A-Z) runs without ASCII white space; a shorter text
    is one shingle. Texts link when 100 * intersection >= ``percent`` * union;
    classes are the connected components.

    Equal sets are one representative each, however many copies. One-permutation
    signatures with optimal densification are cut into bands; in each bucket the
    members meet one centre, the one that the most other buckets share, so a
    bucket of n gives n - 1 pairs. Members in another component than their
    centre are searched exactly: a partner must hold some of the shingles that
    such a document does not share with its centre. The holders of the rarest
    of those are compared in rounds, and only across components (see
    ``search_links``). Every link is confirmed on full sets.

    Returns ``id``, n_shingles, component_id (the smallest id reachable) and
    kept (whether it is the document itself). Empty and null texts have no
    shingles and link to nothing. Ids are integers and should be distinct;
    rows that repeat an id are one document, with the set of least digest, and
    come out once. Rows with a null id come out with a null component, kept.
    """
    with passing(docs.sparkSession):
        every, classes = _classes(docs, id, text, percent, width, bands, rows)
    out = every.join(classes, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _classes(docs: DataFrame, id: str, text: str, percent: int, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, digest) of every document, and (digest, component) of every set that is not empty, both written."""
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "id long, n long, digest binary, keys array<bigint>"
    signed = materialize(source.mapInArrow(_signed(width, bands, rows), schema), "signatures")
    named = signed.where(F.col("id").isNotNull())
    # A repeated id stands for the least of its digests, an empty set only if it has no other.
    one = named.groupBy("id").agg(F.min(F.struct(F.col("digest").isNull(), "digest", "n")).alias("of")).select("id", "of.n", "of.digest")
    every = materialize(one.union(signed.where(F.col("id").isNull()).select("id", "n", "digest")), "ids", keep=True)
    one = every.where(F.col("id").isNotNull())
    first = one.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"))
    first = materialize(first, "sets")
    reps = named.join(first.select(F.col("rep").alias("id"), F.col("digest").alias("held")), "id").where(F.col("digest") == F.col("held"))
    exploded = reps.select("id", F.explode("keys").alias("key"))
    crowded = exploded.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    crowded = small(materialize(crowded, "crowded"), 16)
    members = materialize(exploded.join(crowded, "key").select("key", "id", "rows"), "members")

    ids = members.select("id").distinct().join(first.select(F.col("rep").alias("id"), "digest"), "id")
    hashed = source.join(ids, "id").mapInArrow(_hashed(width), "id long, hashes binary")
    sets = materialize(hashed.dropDuplicates(["id"]), "sets")
    sent = few(sets, F.length("hashes") + 16, SENT)
    centres = _centres(members)
    done = _compare(materialize(_stars(members, centres), "stars"), sets, percent, "star", sent)
    parts = small(materialize(connected_components(done.where("linked"), "centre", "member"), "parts"), PLACED)

    outside = _outsiders(members, centres, parts)
    if not outside.isEmpty():
        parts = _searched(outside, done, members, sets, parts, percent, sent)

    classes = first.join(parts, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    return every, materialize(classes, "classes", keep=True)


def _outsiders(members: DataFrame, centres: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, id) of members that are in another component than their bucket's centre."""
    of = parts.select(F.col("node").alias("centre"), F.col("component").alias("core"))
    cores = centres.join(of, "centre", "left").select("key", F.coalesce("core", "centre").alias("core"))
    placed = members.join(parts, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    return materialize(placed.join(cores, "key").where(F.col("part") != F.col("core")).select("key", "id"), "outside")


def _leads(closest: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """(id, m, most, h): the shingles that lead to partners, and the largest partner that each must lead to.

    An outsider's shingles are ranked by how many hold them (``counts``: h,
    held), those of ``own`` and of ``any`` apart. A partner whose first of them
    is the one of rank r shares at most the m - r + 1 from there on, so it has
    at most (m - r + 1) * (1 + t) / t - m elements.
    """
    own = closest.select("id", "m", "enough", F.lit(None).cast("long").alias("limit"), F.explode("own").alias("h"))
    any_ = closest.select("id", "m", F.col("m").alias("enough"), "limit", F.explode("any").alias("h"))
    # One document's shingles.
    rank = F.row_number().over(W.partitionBy("id", F.col("limit").isNull()).orderBy("held", "h"))
    ranked = own.union(any_).join(counts, "h").withColumn("rank", rank)
    most = F.floor((F.col("m") - F.col("rank") + 1) * (100 + percent) / percent) - F.col("m")
    led = ranked.where("rank <= enough and held > 1").select("id", "m", F.least("limit", most).alias("most"), "h")
    return led.where(100 * F.col("most") >= percent * F.col("m"))


def _searched(outside: DataFrame, done: DataFrame, members: DataFrame, sets: DataFrame, parts: DataFrame, percent: int, sent: bool) -> DataFrame:
    """(node, component) after outsiders have been linked to other members of their buckets.

    An outsider has failed against a centre; what leads to its partners comes
    from its closest comparison (see ``_compared``), the rarest shingles first.
    A shingle is counted over the members of the outsiders' buckets, which hold
    every partner, and partners of impossible size are left out in the join.
    """
    failed = done.where(~F.col("linked")).select(F.col("member").alias("id"), F.struct("common", "own", "enough", "any", "limit").alias("c"))
    closest = failed.join(outside.select("id").distinct(), "id").groupBy("id").agg(F.max("c").alias("c"))
    sizes = sets.select("id", (F.length("hashes") / 8).cast("long").alias("m"))
    closest = materialize(closest.join(sizes, "id").select("id", "m", "c.*"), "closest")
    near = members.join(outside.select("key").distinct(), "key", "left_semi").select("id").distinct()
    numbers = sets.join(near, "id", "left_semi").mapInArrow(_numbers, "id long, n long, hashes array<bigint>")
    tokens = numbers.select(F.col("id").alias("other"), "n", F.explode("hashes").alias("h"))
    wanted = small(materialize(closest.select(F.explode(F.concat("own", "any")).alias("h")).distinct(), "wanted"), 8)
    tokens = materialize(tokens.join(wanted, "h", "left_semi"), "tokens")
    leads = _leads(closest, tokens.groupBy("h").agg(F.count("*").alias("held")), percent)
    possible = (F.col("n") <= F.col("most")) & (100 * F.col("n") >= percent * F.col("m"))
    tested = done.select(F.least("centre", "member").alias("centre"), F.greatest("centre", "member").alias("member"))
    compare = lambda pairs: _compare(pairs, sets, percent, "rest", sent).where("linked").select("centre", "member")
    return search_links(leads, tokens, tested, parts, possible, compare)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(v.as_py(), dtype=np.int64) for v in batch.column(1)]
        sizes = pa.array([len(f) for f in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(found, pa.list_(pa.int64()))], names=["id", "n", "hashes"])
