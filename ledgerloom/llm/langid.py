"""Language identification with a string kernel.

A text is the set of its character n-grams, n from 1 to 3, over lower-cased letters; every run of
other characters is one boundary sign. The kernel of two texts is the number of n-grams both hold,
divided by the geometric mean of their set sizes (a blended spectrum of presences). A bounded sample
of labelled rows gives the landmarks of a Nystroem map and the rows of a one-versus-rest kernel ridge
regression; scoring multiplies batches of presence vectors with the landmarks and the result with the
solved weights.

Defined results: a null text, an empty text or one without a letter is ``und`` with score 0. A text
with letters of which no n-gram is known gets the commonest language with score 0. Without learned
languages every text is ``und``. Ties go to the language that sorts first. Repeated rows get one
result each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import batches, held_out, sample_keys, slices, strings

UNDETERMINED = "und"
SAMPLE_ROWS = 1600  # labelled rows the regression sees, over all languages
LANDMARKS = 96  # of these, over all languages
RIDGE = 1e-3
BLOCK = 64  # texts per matrix product
GRAM_BITS = 21  # bits that hold any code point plus one


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_ids(text: str) -> np.ndarray:
    """Distinct n-grams of ``text`` as sorted numbers; lengths occupy separate ranges."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.int64) + 1
    codes = np.concatenate(([1], codes, [1]))
    gap = codes == 1
    codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]
    if codes.size < 3:
        return np.empty(0, np.int64)
    three = np.unique((codes[:-2] << 2 * GRAM_BITS) | (codes[1:-1] << GRAM_BITS) | codes[2:])
    last = (codes[-2] << GRAM_BITS) | codes[-1]
    two = np.unique(np.append(three >> GRAM_BITS, last))
    one = np.unique(np.append(two >> GRAM_BITS, codes[-1]))
    # The boundary sign alone says nothing; it is the smallest number.
    return np.concatenate((one[1:], two, three))


@dataclass
class Model:
    languages: list[str]
    commonest: int
    grams: np.ndarray  # sorted n-grams of the landmarks
    landmarks: np.ndarray  # presence, one column per landmark
    sizes: np.ndarray  # set size of each landmark
    weights: np.ndarray  # landmarks x languages

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        present = np.zeros((len(sets), self.grams.size), np.float32)
        for row, ids in enumerate(sets):
            at = np.searchsorted(self.grams, ids)
            at[at == self.grams.size] = 0
            present[row, at[self.grams[at] == ids]] = 1
        shared = present @ self.landmarks
        sizes = np.array([max(1, ids.size) for ids in sets], np.float64)
        return shared / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        sets = [gram_ids(t) if has_letter(t) else None for t in texts]
        known = [i for i, ids in enumerate(sets) if ids is not None]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not known or not self.languages:
            return names, scores
        kernel = self.kernel([sets[i] for i in known])
        marks = kernel @ self.weights
        best = marks.argmax(axis=1)
        for row, i in enumerate(known):
            if kernel[row].any():
                names[i] = self.languages[best[row]]
                scores[i] = float(min(1.0, max(0.0, (marks[row, best[row]] + 1) / 2)))
            else:
                names[i] = self.languages[self.commonest]
        return names, scores


EMPTY = Model([], 0, np.empty(0, np.int64), np.empty((0, 0)), np.empty(0), np.empty((0, 0)))


def _gram_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()  # at most SAMPLE_ROWS keys reach this step
    for batch in parts:
        rows = {"key": [], "lang": [], "grams": []}
        columns = (batch.column("key").to_pylist(), batch.column("lang").to_pylist())
        for key, lang, text in zip(*columns, strings(batch, "text")):
            if key not in seen:
                seen.add(key)
                rows["key"].append(key)
                rows["lang"].append(lang)
                rows["grams"].append(gram_ids(text))
        yield batches({"key": pa.int64(), "lang": pa.string(), "grams": pa.list_(pa.int64())}, rows)


def train(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE
) -> Model:
    """Learn from the text and language of the rows that are not held out.

    The driver receives the n-grams of at most ``sample_rows`` texts and one count per language.
    """
    learn = (
        docs.select("doc_id", "text", "lang")
        .where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select(F.xxhash64("doc_id", "text", "lang").alias("key"), "lang", "text")
    )
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return EMPTY
    languages = sorted(counts)
    chosen = sample_keys(learn, "lang", max(4, sample_rows // len(languages)))
    # Bounded: at most sample_rows keys.
    sampled = learn.join(F.broadcast(chosen.select("key")), "key", "left_semi")
    rows = (
        sampled.mapInArrow(_gram_rows, "key bigint, lang string, grams array<bigint>")
        .dropDuplicates(["key"])
        .collect()
    )
    rows.sort(key=lambda r: r["key"])
    sets = [np.array(r["grams"], np.int64) for r in rows]
    target = np.array([languages.index(r["lang"]) for r in rows])
    marks = [
        i for lang in range(len(languages))
        for i in np.flatnonzero(target == lang)[: max(2, landmarks // len(languages))]
    ]
    grams = np.unique(np.concatenate([sets[i] for i in marks]))
    presence = np.zeros((grams.size, len(marks)), np.float32)
    for column, i in enumerate(marks):
        presence[np.searchsorted(grams, sets[i]), column] = 1
    sizes = np.array([max(1, sets[i].size) for i in marks], np.float64)
    commonest = max(range(len(languages)), key=lambda i: (counts[languages[i]], -i))
    model = Model(languages, commonest, grams, presence, sizes, np.empty((0, 0)))

    inner = model.kernel([sets[i] for i in marks])
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([model.kernel(sets[i : i + BLOCK]) for i in range(0, len(sets), BLOCK)])
    mapped = kernel @ root
    signs = np.where(target[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    gram = mapped.T @ mapped + ridge * len(sets) * np.eye(mapped.shape[1])
    model.weights = root @ np.linalg.solve(gram, mapped.T @ signs)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``__llm_lang`` and ``__llm_score`` beside the columns ``keep`` of every row."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in slices(part, BLOCK):
                names, scores = shared.value.predict(strings(batch, "__llm_text"))
                columns = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*keep, "__llm_lang", "__llm_score"],
                )

    kept = docs.select(*keep, F.col("text").alias("__llm_text"))
    schema = kept.drop("__llm_text").schema.add("__llm_lang", "string").add("__llm_score", "double")
    return kept.mapInArrow(score, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from the labelled part of the same table."""
    return identify(docs, train(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.col("__llm_lang").alias("lang_pred"), F.col("__llm_score").alias("score"),
    )


def known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents with a recognised language; columns as they came.

    A document goes if it has no letter, or if no language reaches the score ``least``.
    """
    # Packed, so that no column of theirs can be called as one of ours.
    packed = docs.select("text", F.struct("*").alias("row"))
    scored = identify(packed, train(docs), keep=["row"])
    return scored.where((F.col("__llm_lang") != UNDETERMINED) & (F.col("__llm_score") >= least)).select("row.*")
