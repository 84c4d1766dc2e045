"""Licence scans: a positional index of rare licence words over templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Words: runs of ASCII digits and letters and of all characters beyond ASCII.
_IN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = f"{_IN}+"

# (label, phrase): every place of a phrase counts; fixed by the contract.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]


@dataclass(frozen=True)
class Template:
    """A licence notice, and a phrase of it that must stand in a match."""

    label: str
    text: str
    key: str


# Common notices (fixed texts). A match may lack or change other words.
TEMPLATES = [
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

# Rare words of a key phrase that are looked up, and the share of a template's words that must stand in place.
ANCHORS = 2
LEAST = 0.6


def _vocabulary(templates: list[Template], phrases: list[tuple[str, str]]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()} | {w for _, p in phrases for w in p.split()})


def _any(words: list[str]) -> str:
    return rf"(?i)(?<!{_IN})(?:{'|'.join(words)})(?!{_IN})"


def _ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def word_counts(docs: DataFrame, text: str, words: list[str]) -> dict[str, int]:
    """In how many of all texts each of the given words stands. One row per word reaches the driver."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_any(words)), F.lit(0))
    held = docs.select(F.explode(F.array_distinct(F.transform(F.array_distinct(found), _ascii_lower))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def licence_scan(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[Template] = TEMPLATES,
    anchors: int = ANCHORS,
    least: float = LEAST,
) -> DataFrame:
    """Licence labels of every whole text.

    How many texts hold each licence word is counted over the corpus. The
    ``anchors`` rarest words of each phrase, and of each template's key phrase,
    are its index entries; a match cannot lack any of them. A text's licence
    words that are anchors are looked up; each posting tells where the template
    would start. A phrase is found where all its words follow, a template where
    its key phrase stands whole and at least the share ``least`` of its words
    stand in place, whichever the others are.

    Returns ``id``, n_words, n_base (places of phrases), first_word and
    last_word (least and largest start), base_labels, labels (distinct, sorted,
    comma-joined), matches (label, start, share) and score (the largest share;
    1 for a phrase; 0 for none). Null and empty texts have no words. Repeated
    rows stay repeated rows.
    """
    entries = [(label, p, p, True) for label, p in phrases] + [(t.label, t.text, t.key, False) for t in templates]
    counts = word_counts(docs, text, _vocabulary(templates, phrases))
    rare: list[list[str]] = []
    for _, _, key, _ in entries:
        words = list(dict.fromkeys(key.split()))
        rare.append(sorted(words, key=lambda w: (counts.get(w, 0), w))[:anchors])
    # A match needs all anchors, the rarest among them.
    first = sorted({words[0] for words in rare})
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(id).alias("_id"), body.alias("_text"))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    df = df.select(
        "_id",
        F.regexp_count("_text", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(F.col("_text").rlike(_any(first)), F.transform(words, _ascii_lower)).otherwise(F.array().cast("array<string>")).alias("_words"),
    )
    # Positions of the anchors only; the index is small and fixed, so it is part of the plan.
    anchored = F.filter(
        F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: x["w"].isin(sorted({w for words in rare for w in words})),
    )
    df = df.select("_id", "n_words", "_words", anchored.alias("_anchored"))
    found = [_places(label, body.split(), key.split(), base, words, least) for (label, body, key, base), words in zip(entries, rare)]
    df = df.select("_id", "n_words", F.when(F.size("_anchored") > 0, F.concat(*found)).otherwise(F.array().cast(KIND)).alias("_found"))
    base = F.filter("_found", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return df.select(
        F.col("_id").alias(id),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("_found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        F.transform("_found", lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"), m["share"].alias("share"))).alias("matches"),
    )


KIND = "array<struct<label:string,start:bigint,share:double,base:boolean>>"


def _places(label: str, body: list[str], key: list[str], base: bool, rare: list[str], least: float) -> Column:
    """Where one phrase or template stands, as an array of (label, start, share, base)."""
    at = next(k for k in range(len(body)) if body[k : k + len(key)] == key)
    positions = {w: [at + i for i, x in enumerate(key) if x == w] for w in rare}
    # Starts that the postings of the rarest anchor propose; those on which the anchors agree.
    proposed = F.concat(*[_postings(w, p) for w in rare[:1] for p in positions[w]])
    starts = F.filter(F.array_distinct(proposed), lambda s: _agrees(s, positions))
    in_place = lambda s: sum((F.coalesce(F.get("_words", s + F.lit(k)) == w, F.lit(False)).cast("int") for k, w in enumerate(body)), F.lit(0))
    scored = F.transform(
        starts, lambda s: F.struct(F.lit(label).alias("label"), s.cast("long").alias("start"), (in_place(s) / F.lit(float(len(body)))).alias("share"), F.lit(base).alias("base"))
    )
    if base:
        return F.filter(scored, lambda m: m["share"] == 1.0).cast(KIND)
    whole = lambda s: [F.coalesce(F.get("_words", s.cast("int") + F.lit(at + k)) == w, F.lit(False)) for k, w in enumerate(key)]

    def verified(m: Column) -> Column:
        out = m["share"] >= least
        for test in whole(m["start"]):
            out = out & test
        return out

    return F.filter(scored, verified).cast(KIND)


def _postings(word: str, position: int) -> Column:
    return F.transform(F.filter("_anchored", lambda x: x["w"] == word), lambda x: x["i"] - F.lit(position))


def _agrees(start: Column, positions: dict[str, list[int]]) -> Column:
    """Whether all anchors stand where a template starting there has them."""
    hits = [
        sum((F.coalesce(F.get("_words", start + F.lit(p)) == w, F.lit(False)).cast("int") for p in at), F.lit(0)) > 0
        for w, at in positions.items()
    ]
    return sum((h.cast("int") for h in hits), F.lit(0)) >= len(positions)
