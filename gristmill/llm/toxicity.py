"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a logistic model over its words; the document's
is their noisy-or, 1 - prod(1 - p). Only document labels are given: the noisy-or's likelihood is maximised, and its
gradient finds which sentences of a labelled document are to blame. A scored text also gets the offending sentences.

The model is fitted on a bounded sample of labelled rows (max_rows rows of at most max_chars characters, in the order
of a hash of their id); every document is scored on its whole text.

Defined results: a null or empty text has no sentence and the score 0.0; a label row that is null takes no part and
of labels for the same id the largest holds; without usable labels of both kinds every score is the prior's; labels
of rows with a null id are not used. Columns other than the named ones don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
START = -8.0  #: log odds of a sentence that nothing is known of
SCORED = "struct<score double, sentences int, offending array<struct<start int, end int, p double>>>"


class MilModel(NamedTuple):
    weights: dict[str, float]
    bias: float


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 6000, max_chars: int = 20_000, max_words: int = 20_000, min_docs: int = 3, steps: int = 150,
) -> MilModel:
    """The model fitted on at most max_rows of the labelled documents with at most max_chars characters."""
    key = F.col(id_col).alias("_id")
    known = labels.select(key, F.col(label_col).alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    # Twice the rows wanted, for ids that have no document or one that is too long; the bound makes this side small.
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(2 * max_rows)
    rows = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).filter(F.length("_text") <= max_chars)
    sample = rows.join(F.broadcast(known), "_id").orderBy(F.xxhash64("_id"), "_id", "_text").limit(max_rows).select("_text", "_y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, given = [], []
        for b in batches:
            texts += b.column("_text").to_pylist()
            given += [int(y > 0) for y in b.column("_y").to_pylist()]
        model = fit(texts, given, max_words, min_docs, steps)
        yield pa.RecordBatch.from_pydict({"word": [*model.weights, None], "weight": [*model.weights.values(), model.bias]})

    # One task fits the bounded sample; only the weights, at most max_words, reach the driver.
    found = {r["word"]: r["weight"] for r in sample.coalesce(1).mapInArrow(run, "word string, weight double").collect()}
    return MilModel({w: x for w, x in found.items() if w is not None}, found.get(None, START))


def features(word: str) -> tuple[str, ...]:
    """The word itself, its first and its last four letters (whole roots and endings recur in words never seen)."""
    return (word, f"{word[:4]}-", f"-{word[-4:]}") if len(word) > 4 else (word,)


def sentence_features(text: str) -> list[set[str]]:
    return [{f for w in set(WORD.findall(s)) for f in features(w)} for s in SENTENCE.findall(text.lower())]


def associated(texts: list[str], labels: list[int], max_words: int, min_docs: int, least_z: float = 3.0) -> list[str]:
    """Features in at least min_docs toxic texts whose count there is least_z standard deviations above chance."""
    toxic: Counter[str] = Counter()
    for text, y in zip(texts, labels, strict=True):
        if y:
            toxic.update(set().union(*sentence_features(text)))
    toxic = Counter({w: n for w, n in toxic.items() if n >= min_docs})
    seen = Counter(toxic)
    for text, y in zip(texts, labels, strict=True):
        if not y:
            seen.update(toxic.keys() & set().union(*sentence_features(text)))
    share = sum(labels) / max(1, len(labels))
    z = {w: (n - seen[w] * share) / math.sqrt(seen[w] * share * (1 - share) + 1e-9) for w, n in toxic.items()}
    return sorted((w for w, x in z.items() if x >= least_z), key=lambda w: (-z[w], w))[:max_words]


def fit(texts: list[str], labels: list[int], max_words: int = 20_000, min_docs: int = 3, steps: int = 150, start: float = START, decay: float = 0.02) -> MilModel:
    """Maximises the noisy-or likelihood of the labels by Adam over the features associated with toxic texts."""
    if len(set(labels)) < 2:
        return MilModel({}, start)
    words = associated(texts, labels, max_words, min_docs)
    place = {w: i for i, w in enumerate(words)}
    doc, row, col = [], [], []
    for d, text in enumerate(texts):  # the features of one text at a time: the driver's memory stays small
        for sentence in sentence_features(text):
            found = [place[w] for w in sentence if w in place]
            row += [len(doc)] * len(found)
            col += found
            doc.append(d)
    doc, row, col, y = (np.array(x, dtype=np.int64) for x in (doc, row, col, labels))
    theta, bias = np.zeros(len(words)), start
    grads = [np.zeros(len(words) + 1) for _ in range(2)]
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weights=theta[col], minlength=len(doc))
        soft = np.logaddexp(0, z)
        total = np.maximum(np.bincount(doc, weights=soft, minlength=len(y)), 1e-12)
        pull = np.where(y == 1, -np.exp(-total) / -np.expm1(-total), 1.0)
        g = pull[doc] * (1 / (1 + np.exp(-z)))
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(words)) + decay * theta, g.sum() + 10 * decay * (bias - start))
        grads[0] = 0.9 * grads[0] + 0.1 * grad
        grads[1] = 0.99 * grads[1] + 0.01 * grad**2
        move = 0.2 * (grads[0] / (1 - 0.9**step)) / (np.sqrt(grads[1] / (1 - 0.99**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    return MilModel({w: float(t) for w, t in zip(words, theta, strict=True) if abs(t) > 0.02}, float(bias))


class WordWeights(dict):
    """Weight of each word seen so far; emptied when it holds too many."""

    def __init__(self, model: MilModel, most: int = 300_000) -> None:
        super().__init__()
        self.get_weight, self.most = model.weights.get, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = x = sum([self.get_weight(f, 0.0) for f in features(word)])
        return x


def score_text(text: str | None, bias: float, weights: WordWeights, offending_p: float = 0.3) -> tuple[float, int, list[dict]]:
    """Noisy-or score of the text, how many sentences it has, and those with at least offending_p."""
    text = text or ""
    low = text.lower()
    quiet = math.log1p(math.exp(bias))  # of a sentence without weighted words
    if not any(map(weights.__getitem__, set(WORD.findall(low)))):
        n = len(SENTENCE.findall(low))
        return -math.expm1(-quiet * n), n, []
    total, n, found = 0.0, 0, []
    for m in SENTENCE.finditer(text if len(text) == len(low) else low):
        n += 1
        z = bias + sum(map(weights.__getitem__, set(WORD.findall(m[0].lower()))))
        total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
        if (p := 1 / (1 + math.exp(-min(max(z, -700), 700)))) >= offending_p:
            found.append({"start": m.start(), "end": m.end(), "p": p})
    return -math.expm1(-total), n, found


def scored(text: Column, model: MilModel) -> Column:
    """score, sentences and offending (code point spans and their probabilities) of each text."""

    @F.arrow_udf(SCORED)
    def of(texts: pa.Array) -> pa.Array:
        weights = WordWeights(model)
        rows = [score_text(t, model.bias, weights) for t in texts.to_pylist()]
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], spans)],
            names=["score", "sentences", "offending"],
        )

    return of(text)


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, sentences, offending for each row of docs."""
    model = train(docs, labels.filter(~held_out(F.col(id_col))), id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col), model).alias("r"))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("r.score").alias("score"),
        F.when(F.col("r.score") >= threshold, 1).otherwise(0).alias("predicted"),
        F.col("r.sentences").alias("sentences"),
        F.col("r.offending").alias("offending"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that score below threshold."""
    model = train(docs, labels.filter(~held_out(F.col(id_col))), id_col, text_col)
    return docs.filter(scored(F.col(text_col), model)["score"] < threshold)
