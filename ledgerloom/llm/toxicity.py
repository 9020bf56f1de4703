"""Toxicity with a counterfactual-regularised linear classifier.

Features are the distinct lower-cased words of a text and the first four and five letters of longer
words. Those that tell the classes apart on a bounded sample of labelled rows enter a logistic
regression. For every sampled text that names an identity group, the terms are swapped for other
groups' terms; the squared difference between the two scores is a penalty of the training, so that
a neutral mention of a group carries no weight.

Defined results: a null or empty text has no feature and gets the score of the intercept. Without
labels of both classes every text gets the smoothed share of toxic labels. Conflicting labels of one
document count as toxic. Labels that are null or other than 0 and 1 are ignored. Repeated rows get
one result each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import batches, held_out, sample_keys, stored, strings

SAMPLE_PER_CLASS = 3000  # labelled documents of each class the training sees
FEATURES = 4096  # features the classifier keeps at most
LEAST_LIFT = 1.0  # log odds a feature must have
LEAST_G = 4.2  # and the root of its likelihood ratio statistic
L2 = 1e-4
COUNTERFACTUAL = 1.0  # weight of the squared score change under a swap
STEPS = 300

# Identity terms, by kind; a term is swapped for the next one of its kind.
IDENTITY_TERMS = {
    "religion": "muslim christian jewish buddhist hindu atheist muslims christians jews buddhists "
    "hindus atheists islam christianity judaism musulman chrétien juif moslem christ jude "
    "musulmán cristiano judío",
    "origin": "african asian european american mexican arab african-american immigrant immigrants "
    "refugee refugees foreigner foreigners étranger immigré ausländer flüchtling extranjero inmigrante",
    "colour": "black white brown latino latina hispanic indigenous noir blanc schwarz weiß negro blanco",
    "gender": "woman man women men girl boy girls boys female male transgender nonbinary "
    "femme homme frau mann mujer hombre",
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual trans",
    "ability": "blind deaf disabled autistic handicapped wheelchair",
    "age": "old young elderly teenager senior",
}

_WORD = re.compile(r"\w+")


def _swaps() -> dict[str, str]:
    swaps = {}
    for terms in IDENTITY_TERMS.values():
        kind = terms.split()
        swaps.update(zip(kind, [*kind[1:], kind[0]]))
    return swaps


SWAPS = _swaps()
_IDENTITY = re.compile(r"\b(" + "|".join(sorted(map(re.escape, SWAPS), key=len, reverse=True)) + r")\b")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(text: str) -> set[str]:
    """Words, and the beginnings of longer words marked with ``^``."""
    words = words_of(text)
    starts = {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}
    return words | starts


def swapped(text: str) -> str | None:
    """``text`` with every identity term exchanged, or None if it has none."""
    changed, n = _IDENTITY.subn(lambda m: SWAPS[m[0]], text.lower())
    return changed if n else None


@dataclass
class Model:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[str]) -> list[float]:
        weights = self.weights
        known = weights.keys()
        marks = [
            self.intercept + sum(weights[f] for f in sorted(known & features_of(t))) for t in texts
        ]
        return [1.0 / (1.0 + float(np.exp(-max(-500.0, min(500.0, m))))) for m in marks]


def _feature_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {
        "key": pa.int64(), "toxic": pa.int32(),
        "features": pa.list_(pa.string()), "others": pa.list_(pa.string()),
    }
    seen = set()  # bounded by the sample
    for batch in parts:
        rows = {name: [] for name in kinds}
        columns = (batch.column("key").to_pylist(), batch.column("toxic").to_pylist())
        for key, toxic, text in zip(*columns, strings(batch, "text")):
            if key in seen:
                continue
            seen.add(key)
            other = swapped(text)
            rows["key"].append(key)
            rows["toxic"].append(toxic)
            rows["features"].append(sorted(features_of(text)))
            rows["others"].append(None if other is None else sorted(features_of(other)))
        yield batches(kinds, rows)


def _fit(rows: list, names: list[str], counterfactual: float) -> tuple[float, np.ndarray]:
    """Logistic loss + L2 + squared change of the log odds under swaps, by Adam over all rows."""
    target = np.array([r["toxic"] for r in rows], np.float64)

    def sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return row, np.concatenate([np.asarray(x, np.int64) for x in lists] or [[]]).astype(np.int64)

    row, column = sparse([r["features"] for r in rows])
    pairs = [r for r in rows if r["others"] is not None]
    first, second = sparse([r["features"] for r in pairs]), sparse([r["others"] for r in pairs])
    share = min(max(target.mean(), 1e-3), 1 - 1e-3)
    weights = np.zeros(len(names) + 1)
    weights[-1] = np.log(share / (1 - share))
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        marks = np.bincount(row, weights[column], len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(marks, -500, 500))) - target) / len(rows)
        slope = np.append(np.bincount(column, error[row], len(names)), error.sum())
        slope[:-1] += L2 * weights[:-1]
        if pairs:
            change = np.bincount(first[0], weights[first[1]], len(pairs)) - np.bincount(
                second[0], weights[second[1]], len(pairs)
            )
            change *= 2 * counterfactual / len(pairs)
            slope[:-1] += np.bincount(first[1], change[first[0]], len(names))
            slope[:-1] -= np.bincount(second[1], change[second[0]], len(names))
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return float(weights[-1]), weights[:-1]


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS,
    counterfactual: float = COUNTERFACTUAL,
) -> Model:
    """Learn from the labelled rows that are not held out.

    The driver receives at most ``FEATURES`` features and the places of these features in at most
    ``2 * per_class`` documents.
    """
    marked = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    whole = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = (whole.get(1, 0) + 0.5) / (sum(whole.values()) + 10)
    prior = float(np.log(share / (1 - share)))
    if len(whole) < 2:
        return Model(prior)
    keyed = marked.withColumn("key", F.xxhash64("doc_id"))
    chosen = keyed.join(sample_keys(keyed, "toxic", per_class), ["key", "toxic"], "left_semi").drop("key")
    rows = stored(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows
        .select(F.xxhash64("doc_id", "text").alias("key"), "toxic", "text")
        .mapInArrow(_feature_rows, "key bigint, toxic int, features array<string>, others array<string>")
        .dropDuplicates(["key"]),
        "toxicity-sample",
    )
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(prior)

    def logit(n, total):
        return F.log((n + 0.5) / (total + 1 - n + 0.5))

    counted = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")
    )
    lift = logit(F.col("n1"), sizes[1]) - logit(F.col("n0"), sizes[0])
    share = (F.col("n1") + F.col("n0")) / (sizes[1] + sizes[0])

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    cells = [(F.col("n1"), share, sizes[1]), (F.col("n0"), share, sizes[0])]
    g = sum(
        (part(n, p * total) + part(total - n, (1 - p) * total) for n, p, total in cells), F.lit(0.0)
    )
    told = (
        counted.select("feature", lift.alias("lift"), F.sqrt(F.greatest(2 * g, F.lit(0.0))).alias("g"))
        .where((F.abs("lift") >= LEAST_LIFT) & (F.col("g") >= LEAST_G))
        .orderBy(F.col("g").desc(), "feature")
        .limit(FEATURES)
    )
    names = sorted(r["feature"] for r in told.collect())
    place = F.broadcast(docs.sparkSession.createDataFrame(
        [(n, i) for i, n in enumerate(names)], "feature string, place int"))

    def placed(column: str) -> DataFrame:
        return (
            rows.select("key", F.explode(column).alias("feature"))
            .join(place, "feature")
            .groupBy("key")
            .agg(F.sort_array(F.collect_list("place")).alias(column))
        )

    # Each list has at most FEATURES places.
    known = (
        rows.select("key", "toxic", F.col("others").isNotNull().alias("pair"))
        .join(placed("features"), "key", "left")
        .join(placed("others"), "key", "left")
        .orderBy("key")
        .collect()
    )
    data = [
        {"toxic": r["toxic"], "features": r["features"] or [],
         "others": (r["others"] or []) if r["pair"] else None}
        for r in known
    ]
    intercept, weights = _fit(data, names, counterfactual)
    # The sample has other shares of the classes than the labels.
    intercept += float(np.log(whole[1] / whole[0]) - np.log(sizes[1] / sizes[0]))
    return Model(intercept, {n: float(w) for n, w in zip(names, weights) if w})


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``__llm_toxicity``, the score from 0 to 1, beside the columns ``keep`` of every row."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            scores = shared.value.scores(strings(batch, "__llm_text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(scores, pa.float64())],
                names=[*keep, "__llm_toxicity"],
            )

    kept = docs.select(*keep, F.col("text").alias("__llm_text"))
    return kept.mapInArrow(score, kept.drop("__llm_text").schema.add("__llm_toxicity", "double"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict for every document."""
    return classify(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__llm_toxicity").alias("score"),
        F.when(F.col("__llm_toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half; columns as they came."""
    # Packed, so that no column of theirs can be called as one of ours.
    packed = docs.select("text", F.struct("*").alias("row"))
    scored = classify(packed, train(docs, labels), keep=["row"])
    return scored.where(F.col("__llm_toxicity") < 0.5).select("row.*")
