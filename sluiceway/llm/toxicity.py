"""Toxicity: a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluiceway.session import materialize

# Symbols that words are mapped to, and those the transducers write.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "o", "I", "T", "G", "N", "R"
NEGATED, REPORTED, AIMED = "i", "r", "A"

# Words known beforehand; the insults and threats are joined by what labels teach.
SEEDS = {
    INSULT: "idiot moron stupid worthless pathetic loser scum trash clown disgusting".split(),
    THREAT: "kill hurt destroy strangle".split(),
    TARGET: "you your yours he she they him her them tu vous usted ustedes du ihr sie".split(),
    NEGATION: "not never no nobody isn't aren't wasn't ne jamais nicht kein keine nunca".split(),
    REPORT: "said says called calls wrote quoted claimed reported allegedly dit dijo sagte".split(),
}
# A word counts for less where negated or reported, for more where aimed at someone.
FACTORS = {INSULT: 1.0, THREAT: 1.5, NEGATED: 0.4, REPORTED: 0.6, AIMED: 1.5}
NEGATION_REACH = 3
SEED_WEIGHT = 2.0

# At most so many labelled documents are learned from: those with the smallest digests.
TRAIN_ROWS = 20_000
# A learned word or stem stands in at least this share of toxic documents, and
# is at least so many times as frequent there as in the others.
LEAST_SHARE, LEAST_LIFT, LEAST_DOCS = 0.01, 12.0, 5
STEM = range(3, 9)
# Upper ends of the ranges of clause weight that get a score each.
RANGES = [0.0, 1.0, 2.0, 4.0, 8.0, 16.0, float("inf")]
THRESHOLD = 0.3

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
CLAUSE_END = re.compile(r"[.!?;\n]+")


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: (state, symbol) gives the next state and the symbol written.

    Symbols without an arc pass unchanged and go where ``rest`` says.
    """

    arcs: dict[tuple[int, str], tuple[int, str]]
    rest: dict[int, int]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.rest[state], symbol)


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """One transducer that does what ``second`` does to what ``first`` writes. Both start in state 0."""
    number = {(0, 0): 0}
    queue, arcs, rest = [(0, 0)], {}, {}
    while queue:
        pair = queue.pop()
        for symbol in alphabet:
            a, middle = first.step(pair[0], symbol)
            b, out = second.step(pair[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                queue.append((a, b))
            arcs[number[pair], symbol] = (number[a, b], out)
        rest[number[pair]] = number[pair]
    return Transducer(arcs, rest)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """Insults and threats within ``reach`` words after a negation are negated."""
    arcs = {(s, NEGATION): (reach, OTHER) for s in range(reach + 1)}
    arcs |= {(s, w): (s - 1, NEGATED) for s in range(1, reach + 1) for w in (INSULT, THREAT)}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def reported_speech() -> Transducer:
    """After a verb of saying, the clause's insults and threats are reported."""
    arcs = {(s, REPORT): (1, OTHER) for s in (0, 1)} | {(1, w): (1, REPORTED) for w in (INSULT, THREAT)}
    return Transducer(arcs, {0: 0, 1: 1})


def target() -> Transducer:
    """Insults after a word for someone are aimed. State 1: someone was named."""
    return Transducer({(0, TARGET): (1, OTHER), (1, TARGET): (1, OTHER), (1, INSULT): (1, AIMED)}, {0: 0, 1: 1})


def grammar() -> Transducer:
    alphabet = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]
    middle = [*alphabet, NEGATED, REPORTED]
    return compose(compose(negation(), reported_speech(), alphabet), target(), middle)


@dataclass(frozen=True)
class Lexicon:
    """Symbols and weights of whole words and of stems."""

    words: dict[str, tuple[str, float]]
    stems: dict[str, tuple[str, float]]

    def pattern(self) -> re.Pattern[str]:
        """Finds a word of weight; texts without one need no parsing."""
        words = [re.escape(w) + r"(?![^\W_])" for w, (_, weight) in self.words.items() if weight]
        stems = [re.escape(s) for s in self.stems]
        return re.compile(r"(?<![^\W_])(?:" + "|".join(sorted([*words, *stems])) + ")")

    def look_up(self, word: str) -> tuple[str, float]:
        found = self.words.get(word)
        if found:
            return found
        for n in STEM:
            if len(word) >= n and (found := self.stems.get(word[:n])):
                return found
        return OTHER, 0.0


def clause_weights(text: str, lexicon: Lexicon, machine: Transducer, pattern: re.Pattern[str]) -> tuple[float, int]:
    """Total weight of the matched clauses of a text, and their number."""
    text = text.lower()
    total, matched = 0.0, 0
    if not pattern.search(text):
        return total, matched
    for clause in CLAUSE_END.split(text):
        if not pattern.search(clause):
            continue
        state, weight = 0, 0.0
        for word in WORD.findall(clause):
            symbol, strength = lexicon.look_up(word)
            state, out = machine.step(state, symbol)
            weight += strength * FACTORS.get(out, 0.0)
        total += weight
        matched += weight > 0
    return total, matched


def _terms(text: str) -> set[str]:
    """Whole words (ended by a mark) and stems of a text."""
    words = set(WORD.findall(text.lower()))
    return {w + "$" for w in words} | {w[:n] for w in words for n in STEM if len(w) > n}


def _counted(wanted: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                terms = _terms(text or "")
                found.update(terms if wanted is None else terms & wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"]
            )

    return run


def _document_counts(rows: DataFrame, wanted: frozenset[str] | None, least: int) -> dict[str, int]:
    counts = rows.select("text").mapInArrow(_counted(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}


def learn_lexicon_seeds() -> Lexicon:
    """The seeds alone."""
    weights = {symbol: SEED_WEIGHT if symbol in (INSULT, THREAT) else 0.0 for symbol in SEEDS}
    return Lexicon({w: (symbol, weights[symbol]) for symbol, ws in SEEDS.items() for w in ws}, {})


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Seeds, and the words and stems that set toxic training documents apart.

    ``train`` (text, toxic) is bounded, and so is what comes to the driver:
    terms that a hundredth of its toxic documents hold. Of a stem and its
    longer forms the longest counts that keeps nine tenths of the documents.
    """
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    words = learn_lexicon_seeds().words
    stems: dict[str, tuple[str, float]] = {}
    if toxic and other:
        least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))
        held = _document_counts(train.where("toxic = 1"), None, least)
        against = _document_counts(train.where("toxic = 0"), frozenset(held), 1)
        lift = {t: (n / toxic) / ((against.get(t, 0) + 0.5) / (other + 1)) for t, n in held.items()}
        good = {t for t in held if lift[t] >= LEAST_LIFT}
        for term in good:
            longer = [t for t in good if len(t) == len(term) + 1 and t.startswith(term)] if not term.endswith("$") else []
            shorter = term[:-1]
            if any(held[t] >= 0.9 * held[term] for t in longer):
                continue
            # A longer form adds nothing to a stem that stands for it.
            if shorter in good and held[term] < 0.9 * held[shorter]:
                continue
            weight = (INSULT, min(5.0, math.log(lift[term])))
            if term.endswith("$"):
                if words.get(term[:-1], (INSULT, 0.0))[0] in (INSULT, THREAT):
                    words[term[:-1]] = (words.get(term[:-1], weight)[0], weight[1])
            else:
                stems[term] = weight
    return Lexicon(words, stems)


def _weighed(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, pattern = grammar(), lexicon.pattern()
        for batch in batches:
            found = [clause_weights(t or "", lexicon, machine, pattern) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())],
                names=["id", "weight", "clauses"],
            )

    return run


def _range(weight):
    out = F.lit(len(RANGES) - 1)
    for k in range(len(RANGES) - 2, -1, -1):
        out = F.when(weight <= RANGES[k], k).otherwise(out)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, *, id: str, text: str, train_rows: int) -> DataFrame:
    """(id, text, toxic) of the labelled documents outside the held-out quarter, ``train_rows`` at most.

    A document with several labels is toxic if one says so. Its ids, a bounded
    number, are sent to where the documents are.
    """
    key = F.col(id).cast("string")
    known = labels.where(F.col("toxic").isNotNull() & F.col(id).isNotNull()).where(F.crc32(key.cast("binary")) % 4 != 2)
    known = known.groupBy(id).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.md5(key.cast("binary")), id).limit(train_rows).select(F.col(id).alias("id"), "toxic")
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return materialize(texts.join(F.broadcast(materialize(known, "labels")), "id"), "training")


def toxicity(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """Score of every whole text: how likely its weight of toxic clauses is to be labelled toxic.

    Words become symbols (insult, threat, target, negation, reported speech).
    The composition of the negation, reported-speech and target transducers
    reads each clause and weighs the insults and threats it writes. The sum
    over clauses falls in a range; the range's score is the smoothed share of
    toxic training documents in it, made to rise with the weight. Insults are
    seeds and learned words and stems (see ``learn_lexicon``). Labels of the
    held-out quarter, crc32(id) mod 4 = 2, are never read.

    Returns ``id``, score, predicted (1 from ``threshold`` on), weight and
    clauses. Null and empty texts have weight 0. Repeated rows stay repeated
    rows. Without labels of both kinds the seeds alone count, with fixed scores.
    """
    train = training_rows(docs, labels, id=id, text=text, train_rows=train_rows)
    lexicon = learn_lexicon(train)
    schema = "id long, weight double, clauses long"
    judged = train.select(F.col("toxic").cast("long").alias("id"), "text").mapInArrow(_weighed(lexicon), schema)
    counts = {(r["range"], r["toxic"]): r["n"] for r in judged.groupBy(_range(F.col("weight")).alias("range"), F.col("id").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    scores = range_scores(counts)
    kind = dict(docs.dtypes)[id]
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    weighed = source.mapInArrow(_weighed(lexicon), f"id {kind}, weight double, clauses long")
    score = F.element_at(F.array(*[F.lit(s) for s in scores]), _range(F.col("weight")) + 1)
    return weighed.select(F.col("id").alias(id), score.alias("score"), "weight", "clauses").select(
        id, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "clauses"
    )


def range_scores(counts: dict[tuple[int, int], int]) -> list[float]:
    """A score for each range of weight, never falling: neighbours out of order are pooled."""
    prior = [0.05, 0.4, 0.6, 0.8, 0.9, 0.95, 0.95]
    blocks: list[list[float]] = []
    for k, p in enumerate(prior):
        bad, all_ = counts.get((k, 1), 0), counts.get((k, 0), 0) + counts.get((k, 1), 0)
        blocks.append([bad + p, all_ + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return [b / n for b, n, width in blocks for _ in range(int(width))]
