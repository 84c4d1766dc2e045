"""HTML extraction: pages against the pages with the nearest URLs on their host."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluiceway.llm.markup import page_lines
from sluiceway.llm.url_filter import split_url
from sluiceway.session import materialize

# Pages that share at least this part of the smaller one's lines are copies, not two pages of one template.
COPY = 0.5


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, by longest increasing runs of matches."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        places[b[j]].append(j)
    ends: list[int] = []
    nodes: list[tuple[int, int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):  # descending, so that one line matches once
            k = bisect_left(ends, j)
            node = (i, j, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    middle, node = [], nodes[-1] if nodes else None
    while node:
        middle.append(node[:2])
        node = node[2]
    first = [(k, k) for k in range(head)]
    last = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [*first, *middle[::-1], *last]


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [[_number(line) for line, _ in page_lines(h or "")] for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("host"), batch.column("path"), pa.array([np.array(h, dtype=np.int64).tobytes() for h in hashes], pa.binary())],
            names=["key", "host", "path", "hashes"],
        )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_lines(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("id", "url", "key")),
                pa.array([[t for t, _ in lines] for lines in found], pa.list_(pa.string())),
                pa.array([[i for _, i in lines] for lines in found], pa.list_(pa.bool_())),
            ],
            names=["id", "url", "key", "lines", "inside"],
        )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, places = [], []
        for one, two, a, b in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "hashes_one", "hashes_two"))):
            a, b = (np.frombuffer(x, dtype=np.int64).tolist() for x in (a, b))
            pairs = longest_common(a, b)
            if pairs and len(pairs) < COPY * min(len(a), len(b)):
                keys += [one, two]
                places += [[i for i, _ in pairs], [j for _, j in pairs]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["key", "places"])


def neighbours(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in the given order with ``at``, their number, and ``after``, that of the row before (null for the first).

    Range partitions are sorted on their own; only the last number of each
    partition is looked at to join them up.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    # One row per partition.
    ends = numbered.groupBy(part.alias("part")).agg(F.max("at").alias("last"))
    last = [(r["part"], r["last"]) for r in ends.orderBy("part").collect()]
    before = {p: q for (_, q), (p, _) in zip(last, last[1:])}
    crossing = F.create_map(*[F.lit(x) for p, q in before.items() for x in (p, q)]) if before else F.create_map().cast("map<bigint,bigint>")
    first = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return numbered.withColumn("after", F.when(first, F.try_element_at(crossing, part)).otherwise(F.col("at") - 1))


def extract_text(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every whole page.

    Pages are sorted by host and path, so each page's nearest URLs are its
    neighbours, also where one host has most pages. The lines of neighbours on
    a host are aligned by longest common subsequence. What two pages share is
    the site's and is deleted, with two exceptions: pages that share half of
    their lines or more are copies of one another, and lines inside a page's
    article or main element are its article, which may also stand under the
    neighbouring URL. Of a page that has such an element, only that is text.

    Returns ``id``, ``url``, text and n_chars (code points). Null and empty
    html give an empty text. Equal rows have equal texts.
    """
    host, path = split_url(F.col(url))
    text = F.coalesce(F.col(html), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.md5(text))))
    source = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), text.alias("html"), host.alias("host"), path.alias("path"), key.alias("key"))
    listed = source.select("key", "host", "path", "html").mapInArrow(_listed, "key binary, host string, path string, hashes binary")
    # No host, no neighbours; equal rows count once, next to each other in the order.
    ordered = neighbours(listed.where(F.col("host") != ""), ["host", "path", "key"])
    one = ordered.select(F.col("at").alias("after"), F.col("key").alias("one"), F.col("host").alias("host_one"), F.col("hashes").alias("hashes_one"))
    two = ordered.where(F.col("after").isNotNull()).select("after", F.col("key").alias("two"), "host", F.col("hashes").alias("hashes_two"))
    pairs = two.join(one, "after").where((F.col("host") == F.col("host_one")) & (F.col("one") != F.col("two")))
    shared = pairs.select("one", "two", "hashes_one", "hashes_two").mapInArrow(_shared, "key binary, places array<int>")
    shared = materialize(shared, "shared").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    kind = dict(pages.dtypes)[id]
    read = source.select("id", "url", "key", "html").mapInArrow(_read, f"id {kind}, url string, key binary, lines array<string>, inside array<boolean>")
    joined = read.join(shared, "key", "left")
    article = F.exists("inside", lambda x: x)
    kept = F.filter(
        "lines",
        lambda line, i: F.get("inside", i) | (~article & ~F.coalesce(F.array_contains("places", i), F.lit(False))),
    )
    out = joined.select(F.col("id").alias(id), F.col("url").alias(url), F.array_join(kept, "\n").alias("text"))
    return out.select(id, url, "text", F.length("text").cast("long").alias("n_chars"))
