"""Alignment of two tokenizers against the definition, on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sluiceway.llm import alignment, queries
from sluiceway.llm.alignment import Csr, closing_links, link_tokens, product, shared_group_links

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def dense(m, width):
    out = np.zeros((len(m.starts) - 1, width), dtype=np.int64)
    np.add.at(out, (m.rows(), m.columns), m.values)
    return out


def test_products_of_sparse_matrices():
    rng = np.random.default_rng(3)
    for shape in ((0, 4, 3), (5, 0, 3), (6, 7, 8), (40, 30, 20)):
        n, m, k = shape
        made = [(rng.random(s) < 0.3) * rng.integers(1, 9, s) for s in ((n, m), (m, k))]
        a, b = (Csr(np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))]), np.nonzero(x)[1], x[x > 0]) for x in made)
        assert (dense(product(a, b, k), k) == made[0] @ made[1]).all()
        assert (dense(b.transposed(k), m) == made[1].T).all()


def test_links_of_random_cuts():
    rng = random.Random(4)
    for _ in range(50):
        size = rng.randint(1, 60)
        ends = [sorted({size, *(rng.randint(1, size) for _ in range(rng.randint(0, size)))}) for _ in "ab"]
        spans = [list(zip([0, *e], e)) for e in ends]
        links = link_tokens(*(np.diff([0, *e]) for e in ends))
        shared = {(i, j): min(p[1], q[1]) - max(p[0], q[0]) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1])}
        got = dict(zip(zip(links.overlap.rows().tolist(), links.overlap.columns.tolist()), links.overlap.values.tolist()))
        assert got == {k: v for k, v in shared.items() if v > 0}
        rows, columns = closing_links(links)
        assert set(zip(rows.tolist(), columns.tolist())) == {(i, j) for i, p in enumerate(ends[0]) for j, q in enumerate(ends[1]) if p == q}
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = [[sum(c < e for c in cuts) for e in es] for es in ends]
        both = shared_group_links(links)
        assert set(zip(both.rows().tolist(), both.columns.tolist())) == {(i, j) for i, g in enumerate(group[0]) for j, h in enumerate(group[1]) if g == h}


class Whole:
    """Both tokenizers on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes_a = {n: bytes(byte[c] for c in t) for t, n in self.a.get_vocab().items() if t != "<|endoftext|>"}

    def bytes_b(self, n):
        name = self.b.id_to_piece(n)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(n) else name.replace("▁", " ").encode()

    def links(self, text):
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text or "")
        parts = [[self.bytes_a[t] for t in a], [self.bytes_b(t) for t in b]]
        if not text or not b"".join(parts[0]) == b"".join(parts[1]) == f" {text}".encode():
            return 0, 0, [], ""
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        links, groups, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        return len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute(rows):
    whole = Whole()
    found = [(i, whole.links(t)) for i, t in rows]
    counts = Counter(p for _, (_, _, links, _) in found for p in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return Counter(
        (i, a, b, len(p), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), h) for i, (a, b, p, h) in found
    )


def test_query_against_whole_texts(spark, monkeypatch):
    rng = random.Random(6)
    odd = ["漢字かな交じり", "ünïcode", "👨‍👩‍👧", "<s>", "x<|endoftext|>y", "don't", "  ", "\n\n", "\t", "12,345.67", "Groß", "\x1c", "\x85b", "　", "́x", "<0x41>"]
    rows = [(i, " ".join(rng.choice([*odd, "the", "of", "word", "tokens"]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " "), (903, "a▁b"), (904, " lead"), (905, "trail  "), (906, "the word " * 8000), (907, "漢字" * 3000), (None, "no id")]
    rows += [(910 + i, "the same words") for i in range(80)] + [(910, "the same words")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pair int, n_a int").repartition(6)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = queries.op12_alignment(spark, "").select(*names).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    monkeypatch.setattr(queries, "table", lambda *_: df.limit(0))
    assert queries.op12_alignment(spark, "").count() == 0


def test_segments_are_encoded_alone(monkeypatch, spark):
    rows = [(1, "plain words here and there"), (2, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = alignment.Aligner(A, B)
    assert whole.cuts
    parts = whole([t for _, t in rows])
    whole.cuts = False
    whole._forget()
    assert [c.to_pylist() for c in whole([t for _, t in rows])[:4]] == [c.to_pylist() for c in parts[:4]]
    assert alignment.align(df, A, B).columns == ["doc_id", "n_a", "n_b", "n_links", "groups", "pairs", "times"]
