"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words. For every labelled sentence that names a group,
copies are made in which the group's term is swapped for others; the squared change of the
score's logit between a sentence and its copies is penalised, so that a neutral mention of a
group does not move the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, ids_and_texts, slices, small_batches, staged, text_buffer
from .language import remainder

#: Labelled rows that the model is fitted on, at most, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Words that become features, at most: those whose share differs most between the classes.
FEATURES = 4_096
#: A feature word is in so many labelled rows at least, and its toxic rows lie so many
#: deviations from what chance would give.
LEAST_ROWS, DEVIATIONS = 3, 6.0
#: Weight of the counterfactual penalty and of the squared weights.
COUNTERFACTUAL, RIDGE = 4.0, 1e-4
STEPS, RATE = 400, 0.1

#: Terms of groups; those of one line stand for each other.
IDENTITIES = (
    "women men woman man girls boys female male",
    "muslim muslims christian christians jewish jews jew hindu hindus buddhist atheist catholic",
    "black white asian african arab latino hispanic european american mexican chinese indian",
    "gay lesbian straight bisexual transgender queer heterosexual homosexual",
    "immigrant immigrants refugee refugees foreigner foreigners citizen citizens",
    "old young elderly disabled blind deaf",
    "frauen männer juden muslime christen ausländer flüchtlinge",
    "femmes hommes juifs musulmans chrétiens étrangers réfugiés",
    "mujeres hombres judíos musulmanes cristianos extranjeros refugiados",
)

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash (as signed) of every word: a run of letters and non-ASCII bytes, in
    lower case."""
    x = _FOLD[data]
    if len(x) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        x[1:][second] += 0x20
    inside = x != 0x20
    edge = np.zeros(len(x) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if len(x) else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(x) else start
    return np.searchsorted(offsets, start, "right") - 1, RangeHash(x)(start, stop).view(np.int64)


def hashes(terms: list[str]) -> np.ndarray:
    """The hash of each term, as :func:`words` would give it."""
    spelled = [t.encode() for t in terms]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
    return words(np.frombuffer(b"".join(spelled), np.uint8), offsets)[1]


@dataclass
class Model:
    """Learnt state: hashes of the feature words in order, a weight each, and the offset."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: float = -4.0

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of each feature word that is in a text, once each."""
        row, word = words(data, offsets)
        if not len(self.words) or not len(word):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        both = np.unique(row[hit] * len(self.words) + at[hit])
        return both // len(self.words), both % len(self.words)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, at = self.features(data, offsets)
        return _squash(self.offset + np.bincount(row, self.weights[at], minlength=len(offsets) - 1))


def _squash(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def swaps(row: np.ndarray, at: np.ndarray, model_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counterfactual copies as differences: (copy, feature, change of presence).

    One copy for each identity term in a labelled text and each other term of its line.
    """
    where = {int(w): k for k, w in enumerate(model_words)}
    line: dict[int, list[int]] = {}
    for terms in IDENTITIES:
        present = [where[int(h)] for h in hashes(terms.split()) if int(h) in where]
        for k in present:
            line[k] = [x for x in present if x != k]
    copies, features, change = [], [], []
    has = set(zip(row.tolist(), at.tolist())) if line else set()
    n = 0
    for r, k in zip(row.tolist(), at.tolist()):
        for other in line.get(k, ()):
            if (r, other) not in has:
                copies += [n, n]
                features += [k, other]
                change += [-1.0, 1.0]
                n += 1
    return np.array(copies, np.int64), np.array(features, np.int64), np.array(change)


def fit(model_words: np.ndarray, row: np.ndarray, at: np.ndarray, label: np.ndarray) -> Model:
    """Batch gradient descent (Adam) on log loss + counterfactual penalty + ridge; both classes
    weigh the same."""
    n, f = len(label), len(model_words)
    share = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    weights, offset = np.zeros(f), 0.0
    copy, feature, change = swaps(row, at, model_words)
    copies = int(copy.max(initial=-1)) + 1
    m, v = np.zeros(f + 1), np.zeros(f + 1)
    for step in range(1, STEPS + 1):
        p = _squash(offset + np.bincount(row, weights[at], minlength=n))
        error = (p - label) * share
        slope = np.bincount(at, error[row], minlength=f) + RIDGE * weights
        if copies:
            moved = np.bincount(copy, weights[feature] * change, minlength=copies)
            slope += COUNTERFACTUAL * 2 / copies * np.bincount(feature, moved[copy] * change, minlength=f)
        g = np.concatenate([slope, [error.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, offset = weights - move[:f], offset - move[f]
    z = offset + np.bincount(row, weights[at], minlength=n)
    return Model(model_words, weights, float(offset) - _cut(z, label))


def _cut(z: np.ndarray, label: np.ndarray) -> float:
    """The logit above which calling a row toxic makes the fewest errors, in the middle of its
    gap; above all rows by a margin if that is best."""
    level, where = np.unique(z, return_inverse=True)
    bad = np.bincount(where, label, minlength=len(level))
    all_ = np.bincount(where, minlength=len(level))
    errors = np.concatenate([[0], np.cumsum(bad)]) + np.concatenate([np.cumsum((all_ - bad)[::-1])[::-1], [0]])
    edges = np.concatenate([[level[0] - 4], level, [level[-1] + 4]])
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows. A document with several labels counts as toxic if one says so;
    null labels and null ids count as unlabelled; without both classes nothing is learnt and
    every score is low."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most TRAIN_ROWS rows of two numbers: a proven bound for the broadcast.
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = staged(ids_and_texts(docs).join(F.broadcast(marks), "doc_id").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")), "labelled")
    toxic, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not toxic or toxic == n:
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, word = words(*text_buffer(part.column(0)))
                pair = np.unique(np.stack([word, row]), axis=1)
                word, times = np.unique(pair[0], return_counts=True)
                bad = np.asarray(part.column(1))[pair[1]]
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(times.astype(np.int64)), pa.array(np.bincount(np.searchsorted(word, pair[0]), bad, minlength=len(word)).astype(np.int64))], names=["word", "times", "bad"])

    total = rows.mapInArrow(count, "word long, times long, bad long").groupBy("word").agg(F.sum("times").alias("times"), F.sum("bad").alias("bad"))
    rate = toxic / n
    # How far the word's toxic rows lie from what their number alone would give, in deviations.
    apart = F.abs(F.col("bad") - F.col("times") * rate) / F.sqrt((F.col("times") + 1) * rate * (1 - rate))
    identity = np.concatenate([hashes(line.split()) for line in IDENTITIES])
    is_identity = F.col("word").isin([int(x) for x in identity])
    chosen = total.where(((F.col("times") >= LEAST_ROWS) & (apart >= DEVIATIONS)) | is_identity).orderBy(F.desc(is_identity), F.desc(apart), "word").limit(FEATURES).select("word").collect()
    model = Model(np.sort(np.array([r[0] for r in chosen], np.int64)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, at = model.features(*text_buffer(part.column(0)))
                each = np.split(at.astype(np.int32), np.searchsorted(row, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x in each], pa.binary()), part.column(1)], names=["at", "toxic"])

    found = rows.mapInArrow(project, "at binary, toxic int").collect()
    lists = [np.frombuffer(r[0], "<i4").astype(np.int64) for r in found]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return fit(model.words, row, np.concatenate(lists) if lists else row, np.array([r[1] for r in found], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row from its whole text, however long; null texts count as
    empty. Repeated rows repeat; a score of exactly one half counts as toxic; other columns never
    matter; an empty table gives an empty result."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = model.score(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score under one half, with all their columns, whatever their
    names; no shuffle. Null texts count as empty, a null doc_id makes no difference, repeated rows
    go or stay together, and an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    schema, names = docs.schema, docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names[where]):
                keep = model.score(*text_buffer(part.column(where))) < 0.5
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(remainder(5) != 0))
    return score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")
