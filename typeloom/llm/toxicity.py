"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text and their beginnings is fitted to labelled
documents.  Sentences of these that mention a group of people are also taken with the
mention swapped for other groups, and the fit is penalised for every change of the
score.  What the labels owe to who is mentioned thus stays out of the weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import text_or_empty, text_slices

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")
PREFIXES = (4, 5, 6)
#: Labelled rows that a model is fitted to at most; the classifier's documented sample.
MAX_ROWS = 30_000
MAX_FEATURES = 4096
MIN_DOCUMENTS = 3
#: Least G statistic, halved; the best of thousands of features without meaning come near it.
MIN_GAIN = 6.0
#: Words that features are kept for by a worker.
KEPT_WORDS = 1_000_000
#: Groups of exchangeable mentions.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "native", "foreigner", "refugee"),
    ("immigrants", "natives", "foreigners", "refugees"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos"),
)


def features_of_word(word: str) -> tuple[str, ...]:
    """A word and its beginnings, marked apart."""
    return (f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n))


def features(words: Iterable[str]) -> set[str]:
    return {f for word in set(words) for f in features_of_word(word)}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def swaps(text: str, groups: Sequence[Sequence[str]]) -> Iterator[tuple[list[str], list[str]]]:
    """(words, words with one group's terms exchanged) of sentences with a term.

    The k-th term of a group is exchanged for the one behind it, so every term is a
    counterfactual as often as it is replaced.
    """
    after = {g[i]: g[(i + 1) % len(g)] for g in groups for i in range(len(g))}
    lowered = text.lower()
    if not any(term in lowered for term in after):
        return
    for sentence in SENTENCE_END.split(lowered):
        words = WORD.findall(sentence)
        if any(w in after for w in words):
            yield words, [after.get(w, w) for w in words]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    intercept: float

    def score(self, words: Iterable[str]) -> float:
        logit = self.intercept + sum(self.weights.get(f, 0.0) for f in sorted(features(words)))
        return float(1 / (1 + np.exp(-logit)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, max_rows: int, id_column: str, text_column: str, label_column: str
) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents, chosen by hash of their id.

    Only the ids and labels, whose number is bounded, are broadcast.
    """
    chosen = (
        labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    return docs.join(F.broadcast(chosen), docs[id_column] == chosen["_id"]).select(
        text_or_empty(docs, text_column).alias("text"), F.col("_label").alias("label")
    )


def select_features(sample: DataFrame, max_features: int) -> list[str]:
    """Features whose documents tell the classes apart best, by the G statistic."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(tally[0].keys() | tally[1].keys())
            columns = [pa.array([t[n] for n in names], pa.int64()) for t in tally]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["f", "no", "yes"])

        for batch, texts in text_slices(batches):
            for text, label in zip(texts, batch.column("label").to_pylist(), strict=True):
                tally[1 if label else 0].update(features(words_of(text)))
            if len(tally[0]) + len(tally[1]) > KEPT_WORDS:
                yield counted()
                tally[0].clear()
                tally[1].clear()
        yield counted()

    totals = sample.agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("no"),
        F.count(F.when(F.col("label") != 0, 1)).alias("yes"),
    ).first()
    if not totals["no"] or not totals["yes"]:
        return []
    counts = (
        sample.mapInArrow(count, "f string, no long, yes long")
        .groupBy("f")
        .agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        .filter(F.col("no") + F.col("yes") >= MIN_DOCUMENTS)
    )
    n = F.lit(float(totals["no"] + totals["yes"]))

    def part(seen: F.Column, of_feature: F.Column, of_class: float) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen * n / (of_feature * of_class))).otherwise(0.0)

    has = F.col("no") + F.col("yes")
    lacks = n - has
    gain = (
        part(F.col("no"), has, totals["no"])
        + part(F.col("yes"), has, totals["yes"])
        + part(totals["no"] - F.col("no"), lacks, totals["no"])
        + part(totals["yes"] - F.col("yes"), lacks, totals["yes"])
    )
    telling = counts.select("f", gain.alias("gain")).filter(F.col("gain") >= MIN_GAIN)
    best = telling.orderBy(F.desc("gain"), "f").limit(max_features)
    return sorted(r["f"] for r in best.collect())


def _rows(sample: DataFrame, names: list[str], groups: Sequence[Sequence[str]]) -> DataFrame:
    """(label, has, pairs): features of a text and of the differences its swaps make."""
    place = {f: i for i, f in enumerate(names)}

    def index(words: list[str]) -> list[int]:
        return sorted(place[f] for f in features(words) if f in place)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            has = [index(words_of(text)) for text in texts]
            pairs = []
            for text in texts:
                found = ((index(a), index(b)) for a, b in swaps(text, groups))
                pairs.append([list(pair) for pair in found if pair[0] != pair[1]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    pa.array(has, pa.list_(pa.int32())),
                    pa.array(pairs, pa.list_(pa.list_(pa.list_(pa.int32())))),
                ],
                ["label", "has", "pairs"],
            )

    return sample.mapInArrow(encode, "label int, has array<int>, pairs array<array<array<int>>>")


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.array([i for r in rows for i in r], np.int64)


def train(
    labels: np.ndarray,
    has: list[list[int]],
    pairs: list[tuple[list[int], list[int]]],
    n_features: int,
    penalty: float = 1.0,
    ridge: float = 1e-4,
    rounds: int = 300,
    step: float = 0.3,
) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise, by Adam,

    mean log loss + ridge / 2 |w|^2 + penalty / 2 mean (score change of a swap)^2,

    where scores are logits and the last mean is over ``pairs``.
    """
    row, column = _flat(has)
    at, sign = [], []
    for k, (a, b) in enumerate(pairs):
        at += [(k, i, 1.0) for i in a] + [(k, i, -1.0) for i in b]
    swap_row = np.array([x[0] for x in at], np.int64)
    swap_column = np.array([x[1] for x in at], np.int64)
    sign = np.array([x[2] for x in at])
    n = len(labels)
    w = np.zeros(n_features + 1)
    w[-1] = np.log((labels.sum() + 1) / (n - labels.sum() + 1))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        logit = np.bincount(row, w[column], n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / n
        gradient = np.append(np.bincount(column, error[row], n_features), error.sum())
        gradient[:-1] += ridge * w[:-1]
        if pairs:
            change = np.bincount(swap_row, sign * w[swap_column], len(pairs))
            gradient[:-1] += penalty / len(pairs) * np.bincount(
                swap_column, sign * change[swap_row], n_features
            )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= step / np.sqrt(t) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
    penalty: float = 1.0,
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> ToxicityModel:
    """Model from documents and labels (1 toxic, 0 not) of their ids.

    Of at most ``max_rows`` labelled documents the driver gets the numbers of their
    selected features.  Null labels are none; of several labels of a document the greatest counts.
    Without labels of both classes every text scores as their share does.
    """
    sample = labelled_sample(docs, labels, max_rows, id_column, text_column, label_column)
    names = select_features(sample, max_features)
    rows = _rows(sample, names, groups).collect()
    y = np.array([1.0 if r["label"] else 0.0 for r in rows])
    if not names:
        share = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    pairs = [(a, b) for r in rows for a, b in r["pairs"]]
    weights, intercept = train(y, [r["has"] for r in rows], pairs, len(names), penalty)
    return ToxicityModel(dict(zip(names, map(float, weights), strict=True)), intercept)


def toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    threshold: float = 0.7,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, score, predicted) of every row; null and empty texts score as the intercept does.

    A score depends on the text alone; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = {f: i for i, f in enumerate(model.weights)}
        weights = np.array([*model.weights.values()])
        kept: dict[str, tuple[int, ...]] = {}
        for batch, texts in text_slices(batches):
            logits = np.full(len(texts), model.intercept)
            for k, text in enumerate(texts):
                present: set[int] = set()
                for word in set(words_of(text)):
                    own = kept.get(word)
                    if own is None:
                        own = tuple(names[f] for f in features_of_word(word) if f in names)
                        kept[word] = own
                    if own:
                        present.update(own)
                if present:
                    logits[k] += weights[sorted(present)].sum()
            if len(kept) > KEPT_WORDS:
                kept.clear()
            scores = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores)], ["id", "score"]
            )

    source = docs.select(
        docs[id_column].alias("id"), text_or_empty(docs, text_column).alias("text")
    )
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(score, f"id {id_type}, score double").select(
        F.col("id").alias(id_column),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
