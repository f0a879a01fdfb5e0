"""Quality grades by ordinal regression on hashed text.

A cumulative-link model: one score per text, the sum of shared weights of its hashed features, and
ordered thresholds between the grades, ``P(grade <= k) = sigmoid(threshold_k - score)``. It gives the
expected grade and the tail probability ``P(grade >= k)`` by which documents are selected.

Features say what a text holds, not how often: words, word beginnings, runs of signs, and classes of
letter case and repetition. Weights are fitted with an L1 penalty, so that few of them count and long
texts gather no noise, and weights are never above zero: a text is of the best grade unless it holds
something that speaks against it, however short it is. The fit uses at most ``LABELLED`` labelled rows, chosen by the
hash of their id and text among those that have a document; all documents are then graded in one pass without a shuffle.

Defined results: null and empty texts have the features of an empty text; labels with a null, or
without a document, are left out; repeated labels and repeated rows count once; without labelled rows grades
are null and all documents are kept; further columns are ignored; an empty table gives an empty
result. Very long texts are read whole; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.rows import keyed
from faultline.llm.similar import minima
from faultline.llm.staging import staged

#: Bound on the labelled rows of a fit.
LABELLED = 8000
#: Hash values of features; so many that long texts meet no wrong one.
FEATURES = 1 << 40
#: Labelled texts a feature needs, at least and as a part of them all, and the standard deviations by
#: which it leans to low grades.
LEAST_TEXTS, LEAST_PART, LEAST_LEAN = 8, 1 / 500, 5.0
#: Bytes of a word's beginning that are features of their own.
BEGINNINGS = (4, 5)

_SIGN = np.zeros(256, dtype=bool)
_SIGN[33:127] = True
_SIGN &= ~words.IS_WORD
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SIGN[65:91] = False
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a block of texts, with repeats, and the text of each."""
    found = words.Words(data, offsets)
    starts, ends = found.starts, found.ends
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(found.offsets))
    kinds, texts = [found.hashes], [text]
    prefix = words.prefix_hash(found.data)
    for n in BEGINNINGS:
        long = ends - starts > n
        kinds.append(words.span_hash(prefix, starts[long], starts[long] + n) + np.uint64(n))
        texts.append(text[long])
    a, b = words.runs(_SIGN[data], offsets)
    kinds.append(words.span_hash(prefix, a, b) + np.uint64(11))
    texts.append(np.searchsorted(offsets, a, "right") - 1)
    everyone = np.arange(len(offsets) - 1)
    upper, letters = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_UPPER, _LETTER))
    share = (upper[offsets[1:]] - upper[offsets[:-1]]) / np.maximum(letters[offsets[1:]] - letters[offsets[:-1]], 1)
    # Words that stand twice in a row.
    again = np.zeros(len(text) + 1, dtype=np.int64)
    if len(text) > 1:
        again[2:] = np.cumsum((found.hashes[1:] == found.hashes[:-1]) & (text[1:] == text[:-1]))
    repeated = (again[found.offsets[1:]] - again[found.offsets[:-1]]) / np.maximum(np.diff(found.offsets), 1)
    for kind, value in ((21, (share * 5).astype(np.int64)), (22, (repeated * 5).astype(np.int64))):
        kinds.append(words.mix((value + 1000 * kind).astype(np.uint64)))
        texts.append(everyone)
    number = np.concatenate([words.mix(k) for k in kinds]) % np.uint64(FEATURES)
    return number.astype(np.int64), np.concatenate(texts)


@dataclass(frozen=True)
class Model:
    """Weights of features, sorted by their hash, and the ordered thresholds between the grades."""
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.zeros(len(offsets) - 1)
        number, text = features(data, offsets)
        at = np.minimum(np.searchsorted(self.features, number), len(self.features) - 1)
        counts = self.features[at] == number
        pair = np.unique(text[counts] * len(self.features) + at[counts])
        weights = self.weights[pair % len(self.features)]
        return np.bincount(pair // len(self.features), weights=weights, minlength=len(offsets) - 1)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for every grade but the lowest, a row per text."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _without_copies(lists: list[np.ndarray]) -> list[int]:
    """Places of the texts that agree with no earlier one in a band of minhashes of their features.

    What only copies of one text have in common says nothing about grades. Bands are long, so that
    only copies agree: 20 of 12 minima catch 99.9 % of the copies that share nine tenths.
    """
    bands, rows = 20, 12
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    least = minima(words.mix(np.concatenate(lists).astype(np.uint64)), bounds, bands * rows)
    seen: set[bytes] = set()
    places = []
    for place, own in enumerate(least):
        marks = {bytes([k]) + own[k * rows:(k + 1) * rows].tobytes() for k in range(bands)}
        if not marks & seen:
            places.append(place)
        seen |= marks
    return places


def fit(lists: list[np.ndarray], grades: np.ndarray, n_grades: int, penalty: float = 2e-4, rounds: int = 250,
        rate: float = 0.5) -> Model:
    """Maximum likelihood with an L1 penalty by proximal gradient steps scaled per weight.

    ``lists`` holds the distinct features of every text. Rare grades weigh more, by the square root.
    """
    places = _without_copies(lists)
    lists, grades = [lists[i] for i in places], grades[places]
    counts = np.array([len(x) for x in lists])
    names, number = np.unique(np.concatenate(lists), return_inverse=True)
    row = np.repeat(np.arange(len(lists)), counts)
    share = np.bincount(grades, minlength=n_grades) / len(grades)
    weight = 1 / np.sqrt(np.maximum(share, 1e-9))[grades]
    weight /= weight.sum()
    # Only features that lean to low grades far beyond chance are fitted.
    upto = np.cumsum(share)
    lean = 1 - (upto + upto - share)[grades]
    often = np.bincount(number, minlength=len(names))
    z = np.bincount(number, weights=lean[row], minlength=len(names)) / np.sqrt(np.maximum(often, 1) * max(lean.var(), 1e-9))
    chosen = (z >= LEAST_LEAN) & (often >= max(LEAST_TEXTS, LEAST_PART * len(lists)))
    some = chosen[number]
    row = row[some]
    at, used = np.unique(number[some], return_inverse=True)
    w, past = np.zeros(len(at)), np.full(len(at), 1e-12)
    # The lowest threshold, and the logarithms of the steps to the next ones.
    first, steps = -1.0, np.zeros(n_grades - 2)
    past_first, past_steps = 1e-6, np.full(n_grades - 2, 1e-6)
    for _ in range(rounds):
        scores = np.bincount(row, weights=w[used], minlength=len(lists))
        thresholds = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
        below = _sigmoid(np.concatenate([thresholds, [np.inf]])[grades] - scores)
        above = _sigmoid(np.concatenate([[-np.inf], thresholds])[grades] - scores)
        slope = weight * (1 - below - above)  # of the loss by the score
        gradient = np.bincount(used, weights=slope[row], minlength=len(at))
        past += gradient ** 2
        pace = rate / np.sqrt(past)
        w -= pace * gradient
        w = np.minimum(w + pace * penalty, 0)
        # By the thresholds: the upper one of a grade raises its chance, the lower one lowers it.
        chance = np.maximum(below - above, 1e-9)
        by = np.zeros(n_grades - 1)
        np.add.at(by, np.minimum(grades, n_grades - 2), -np.where(grades < n_grades - 1, weight * below * (1 - below) / chance, 0))
        np.add.at(by, np.maximum(grades - 1, 0), np.where(grades > 0, weight * above * (1 - above) / chance, 0))
        past_first += by.sum() ** 2
        first -= 0.3 * by.sum() / np.sqrt(past_first)
        if len(steps):
            by_step = np.cumsum(by[::-1])[::-1][1:] * np.exp(steps)
            past_steps += by_step ** 2
            steps -= 0.3 * by_step / np.sqrt(past_steps)
    return Model(names[at][w < 0], w[w < 0], first + np.concatenate([[0], np.cumsum(np.exp(steps))]))


@words.tidy
def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            number, text = features(data, offsets)
            pair = np.unique(text * FEATURES + number)
            bounds = np.searchsorted(pair // FEATURES, np.arange(last - first + 1))
            number = pair % FEATURES
            yield pa.record_batch({
                "grade": batch["grade"].slice(first, last - first),
                "features": pa.array([number[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            })


def train(docs: DataFrame, labels: DataFrame, grade: str, n_grades: int, labelled: int = LABELLED) -> Model | None:
    """A model of ``grade``, an SQL expression over ``labels`` from 0 to ``n_grades - 1``; None without rows."""
    # Of the labelled documents those of the smallest hashes: a sample of bounded size, the same in every
    # run. Ids and hashes are joined to the labels; texts are looked up for the sample alone.
    texts = keyed(docs)
    graded = labels.select("doc_id", F.expr(grade).cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    some = texts.select("doc_id", "own_key").join(graded, "doc_id").distinct()
    some = staged(some.orderBy("own_key", "doc_id", "grade").limit(labelled), "labelled")
    rows = texts.join(F.broadcast(some), ["doc_id", "own_key"]).dropDuplicates(["doc_id", "own_key", "grade"]).select("grade", "text")
    found = rows.mapInArrow(_listed, "grade int, features binary").toArrow()
    if not found.num_rows:
        return None
    lists = [np.frombuffer(x, np.int64) for x in found["features"].to_pylist()]
    # The order of rows depends on the cluster; sums of the fit should not.
    order = sorted(range(len(lists)), key=lambda i: (found["grade"][i].as_py(), lists[i].tobytes()))
    return fit([lists[i] for i in order], found["grade"].to_numpy()[order].astype(np.int64), n_grades)


@words.tidy
def _graded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            tails = model.tails(model.scores(data, offsets))
            yield pa.record_batch({
                "doc_id": batch["doc_id"].slice(first, last - first),
                "expected_grade": tails.sum(1), "tail": tails[:, -1],
                "tails": pa.array(tails.tolist(), pa.list_(pa.float64())),
            })


def grade(docs: DataFrame, model: Model | None, least_tail: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail, tails, kept`` of every row.

    ``tails`` are ``P(grade >= k)`` from 1 on, ``tail`` the last of them; rows of at least
    ``least_tail`` are kept.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", nothing.alias("expected_grade"), nothing.alias("tail"),
                           F.lit(None).cast("array<double>").alias("tails"), F.lit(True).alias("kept"))
    given = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(
        partial(_graded, model=given), f"doc_id {kind}, expected_grade double, tail double, tails array<double>"
    ).withColumn("kept", F.col("tail") >= least_tail)


#: Of the labels: toxic texts are the lowest grade, poor ones the next, all others the best.
GRADES = 3
GRADE = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 2 END"


@words.tidy
def _kept_rows(batches: Iterator[pa.RecordBatch], model, least_tail: float) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        tails = [model.tails(model.scores(data, offsets))[:, -1] for _, _, data, offsets in words.blocks(batch["text"])]
        if tails:
            yield batch.filter(pa.array(np.concatenate(tails) >= least_tail))


def kept(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5, labelled: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that are likely of the best grade, with all their columns; no shuffle."""
    model = train(docs, labels, GRADE, GRADES, labelled)
    if model is None:
        return docs
    given = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_kept_rows, model=given, least_tail=least_tail), docs.schema)
