"""Packing: documents along a space-filling curve into sequences of tokens."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from sluiceway.llm.shingles import WordHasher, mix
from sluiceway.operators.ordering import running_totals
from sluiceway.session import materialize

SEQUENCE = 1024
END = 0
# Entries of the hashed document vector, dimensions it is projected to, and bits of each coordinate.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 12
# Encoded words that a worker keeps.
KEPT_WORDS = 400_000
# A space before white space, or at the end, joins its neighbour in one token.
JOINED = re.compile(r" (?=\s|\Z)")
# Characters whose class the libraries' Unicode versions might not agree on.
FOREIGN = re.compile("[^\x00-\u024f]")
# The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points on the Hilbert curve (rows: points; columns: coordinates below 2**bits).

    The coordinates become the curve's transposed index by undoing its
    rotations from the highest bit down, then Gray decoding.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projection(buckets: int, dimensions: int) -> np.ndarray:
    """A fixed matrix of signs."""
    cells = mix(np.arange(1, buckets * dimensions + 1, dtype=np.uint64) + np.uint64(1 << 50))
    return np.where(cells & np.uint64(1), 1.0, -1.0).reshape(buckets, dimensions)


def curve_places(words: list[np.ndarray], signs: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of documents given by their word hashes."""
    spots = np.zeros((len(words), signs.shape[1]))
    for k, hashes in enumerate(words):
        if len(hashes):
            vector = np.log1p(np.bincount((hashes >> np.uint64(20)).astype(np.int64) % len(signs), minlength=len(signs)))
            spots[k] = vector @ signs / np.linalg.norm(vector)
    # A projected unit vector is about normal with deviation 1.
    scaled = np.clip((spots + 4.0) / 8.0, 0.0, 1.0 - 1e-9)
    return hilbert_keys((scaled * (1 << bits)).astype(np.int64), bits)


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    Latin texts go whole to the faster of two libraries where the file's merges
    are in the order of its ids, as both then give the same ids. Of the others
    the words met before are kept: the byte-level pre-tokenizer always cuts
    before a space that a visible character follows, so the pieces between such
    spaces encode on their own. Texts that hold the string of a special token
    go to the file's own library whole, unless ``plain`` makes those strings
    ordinary text. ``end`` is the id that closes a text, if any.
    """

    def __init__(self, path: str, end: int | None = END, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [] if plain else added
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.fast = _ranked(path)
        self.end = b"" if end is None else array(self.code, [end]).tobytes()
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bool:
        """Whether a text is for the file's own library."""
        return self.fast is None or not text.isascii() and bool(FOREIGN.search(text)) or any(s in text for s in self.special)

    def ids(self, text: str) -> list[int]:
        """Token ids of one text, nothing kept."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids if self._whole(text) else self.fast(text)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, self.ids(text)).tobytes() for text in texts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        end, special = self.end, self.special
        split = [None if not self._whole(t) or JOINED.search(t) or any(s in t for s in special) else t.split(" ") for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known = self.words
        new = list({p for parts in split if parts is not None for p in parts[1:]} - known.keys())
        known.update(zip(new, self._encode([f" {p}" for p in new])))
        out = []
        for text, parts in zip(texts, split):
            if parts is None:
                out.append(self._encode([text])[0] + end)
            else:
                out.append(self._encode(parts[:1])[0] + b"".join(map(known.__getitem__, parts[1:])) + end)
        return out


def _ranked(path: str):
    """An encoding function for a byte-level file whose ids are in merge order, else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if model.get("normalizer") or model["pre_tokenizer"].get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    added = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): n for t, n in model["model"]["vocab"].items() if t not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    made = [ranks.get(bytes(byte[c] for c in a + b), -1) for a, b in merges]
    if len(ranks) != 256 + len(made) or made != sorted(made) or made[0] < 256:
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


def worker_encoder(path: str, end: int | None = END, plain: bool = False) -> Encoder:
    """The worker process's encoder: loaded once, not once a task."""
    store = sys.modules.setdefault("sluiceway_worker", types.ModuleType("sluiceway_worker"))
    if getattr(store, "made", None) != (path, end, plain):
        store.encoder, store.made = Encoder(path, end, plain), (path, end, plain)
    return store.encoder


def in_groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, hasher, signs = worker_encoder(path), WordHasher(), projection(BUCKETS, DIMENSIONS)
        width = encoder.width
        for batch in batches:
            ids, texts, done = batch.column(0), batch.column(1).to_pylist(), 0
            for group in in_groups([t or "" for t in texts]):
                tokens = encoder(group)
                words = list(hasher.texts([t.encode("utf-8", "surrogatepass").lower() for t in group]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(done, len(group)),
                        pa.array(curve_places(words, signs, BITS), pa.int64()),
                        pa.array([len(t) // width for t in tokens], pa.int64()),
                        pa.array(tokens, pa.binary()),
                    ],
                    names=["id", "place", "n", "tokens"],
                )
                done += len(group)

    return run


def _cut(sequence: int):
    """Pieces of each document between the ends of sequences; ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, lengths, sizes, ids, places = [], [], [], [], [], []
            for k, (n, begin, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "begin", "tokens")))):
                tokens = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    length = min(sequence - (begin + start) % sequence, n - start)
                    rows.append(k)
                    starts.append(start)
                    lengths.append(length)
                    sizes.append(n)
                    ids.append(tokens[start : start + length].tobytes())
                    places.append(begin + start)
                    start += length
            at = np.array(places, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(at // sequence, pa.int64()),
                    pa.array(at % sequence, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of documents that fill sequences of ``sequence`` tokens, neighbours on the curve together.

    A document is the ids of its whole text by the tokenizer file, then id 0.
    Its word counts, hashed to a vector and projected to a few dimensions,
    give its place on a Hilbert curve. Documents are sorted by place over range
    partitions (ties by id and row, so copies spread), laid end to end and cut
    at every ``sequence`` tokens; only the last sequence has padding.

    Returns per piece ``id``, start (tokens of its document before it), length,
    doc_tokens, sequence_id and offset (gapless from 0), and ids (little-endian
    32-bit numbers). Null texts are empty: one token. Repeated rows and null
    ids are documents of their own.
    """
    kind = dict(docs.dtypes)[id]
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    encoded = source.mapInArrow(_tokenized(tokenizer), f"id {kind}, place long, n long, tokens binary")
    encoded = materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "tokens", compression="zstd")
    slim = encoded.select("place", "id", "row", "n")
    order = ["place", "id", "row"]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered.select("row", "n", "at"), "curve")
    begins = running_totals(ordered, [], ["at"], {"begin": F.col("n")}).select("row", "begin")
    laid = encoded.join(begins, "row").select("id", "n", "begin", "tokens")
    schema = f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return laid.mapInArrow(_cut(sequence), schema).withColumnRenamed("id", id)
