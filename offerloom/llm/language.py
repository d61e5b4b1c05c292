"""Language identification by bit-sliced Bloom filters of n-grams.

All languages share one filter geometry; position p of the table holds a bit mask of the
languages whose filter has bit p set. Looking an n-gram up means and-ing a few masks: the
result names every language that contains it. Per language the hits of a text are counted,
the hits that its filter's fill would give by chance are taken off, and the largest share
decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, mix, slices, small_batches, staged, text_buffer

UNKNOWN = "und"
#: Documents that the filters are learnt from, about, chosen by a hash of doc_id.
TRAIN_DOCS = 20_000
#: N-grams of a language that enter its filter at most, the most frequent first.
GRAMS = 60_000
#: An n-gram enters a language's filter if its share there is so large a part of its largest share.
SHARE = 0.35
HASHES = 3
BITS_PER_GRAM = 16

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = regex.compile(r"\p{L}").search


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 32-bit code of every window of four folded bytes that lies in one text.

    ASCII letters are lower-cased, other ASCII bytes become blanks, and the capitals of the
    two-byte Latin block are lower-cased too. Windows with two blanks in a row are left out.
    """
    x = _FOLD[data]
    if len(x) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        x[1:][second] += 0x20
    if len(x) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    w = x.astype(np.uint32)
    code = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16) | w[3:] << np.uint32(24)
    blank = x == 0x20
    twice = blank[:-1] & blank[1:]
    good = ~(twice[:-2] | twice[1:-1] | twice[2:])
    for k in (1, 2, 3):  # windows that reach over the end of a text
        edge = offsets[1:] - k
        good[edge[(edge >= 0) & (edge < len(good)) & (edge >= offsets[:-1])]] = False
    at = np.flatnonzero(good)
    return np.searchsorted(offsets, at, "right") - 1, code[at]


@dataclass
class Filters:
    """Learnt state, of a size that the parameters bound."""

    languages: list[str]
    table: np.ndarray  # (positions, bytes) masks of 8 languages each
    chance: np.ndarray  # probability that a language's filter says yes to a foreign n-gram

    def positions(self, codes: np.ndarray) -> np.ndarray:
        h = mix(codes.astype(np.uint64) + np.uint64(0x51ED2701))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([((h + np.uint64(k) * step) % np.uint64(len(self.table))).astype(np.int64) for k in range(HASHES)])

    def containing(self, codes: np.ndarray) -> np.ndarray:
        """Mask of the languages that contain each n-gram."""
        p = self.positions(codes)
        found = self.table[p[0]]
        for k in range(1, HASHES):
            found &= self.table[p[k]]
        return found

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offsets) - 1
        letter = ((data >= ord("a")) & (data <= ord("z"))) | ((data >= ord("A")) & (data <= ord("Z")))
        sums = np.concatenate([[0], np.cumsum(letter)])
        known = sums[offsets[1:]] > sums[offsets[:-1]]
        for r in np.flatnonzero(~known & (offsets[1:] > offsets[:-1])):
            known[r] = bool(_LETTER(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")))
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        row, code = grams(data, offsets)
        total = np.bincount(row, minlength=rows)
        mask = self.containing(code)
        share = np.zeros((rows, len(self.languages)))
        for k in range(len(self.languages)):
            hits = np.bincount(row[(mask[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1) > 0], minlength=rows)
            share[:, k] = np.maximum(0.0, hits - total * self.chance[k]) / max(1e-9, 1 - self.chance[k])
        best = share.argmax(axis=1)
        all_ = share.sum(axis=1)
        score = np.where(known & (all_ > 0), share[np.arange(rows), best] / np.maximum(all_, 1e-9), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score


def build(languages: list[str], sets: list[np.ndarray]) -> Filters:
    """Filters of the given n-gram codes; the most frequent language comes first, for ties."""
    most = max((len(s) for s in sets), default=0)
    size = max(64, most * BITS_PER_GRAM)
    found = Filters(languages, np.zeros((size, max(1, -(-len(languages) // 8))), np.uint8), np.zeros(len(languages)))
    for k, codes in enumerate(sets):
        p = np.unique(found.positions(codes))
        found.table[p, k // 8] |= np.uint8(1 << k % 8)
        found.chance[k] = (len(p) / size) ** HASHES
    return found


def remainder(n: int):
    """crc32 of doc_id as text, modulo ``n``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame) -> Filters:
    """Learn from text and lang of rows with both; a bounded sample by hash of doc_id, with as
    many documents of each language as there are, up to its part of ``TRAIN_DOCS``.

    Counts of n-grams are summed on the executors; only each language's ``GRAMS`` best come to
    the driver. Null texts and langs, empty tables and repeated rows are all right; very long texts
    are counted whole. Ties go to the language with more documents, then by name.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "lang").limit(TRAIN_DOCS), "language-sizes")
    each = TRAIN_DOCS // max(1, sizes.count())
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("size")
    rows = rows.join(sizes, "lang").where(chance < each * (1 << 30)).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs = part.column(2).to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs], np.int64)
                row, code = grams(*text_buffer(part.column(1)))
                both, times = np.unique(number[row] << 32 | code.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in both >> 32], pa.string()), pa.array(both & 0xFFFFFFFF), pa.array(times.astype(np.int64))], names=["lang", "code", "times"])

    per = staged(rows.mapInArrow(count, "lang string, code long, times long").groupBy("lang", "code").agg(F.sum("times").alias("times")), "language-grams")
    totals = {r[0]: r[1] for r in per.groupBy("lang").agg(F.sum("times")).collect()}
    if not totals:
        return build([], [])
    place = {r[0]: k for k, r in enumerate(sizes.orderBy(F.desc("size"), "lang").collect())}
    languages = sorted(totals, key=lambda x: place[x])
    all_of = F.create_map(*[F.lit(v) for x in totals.items() for v in x])
    part = per.withColumn("share", F.col("times") / all_of[F.col("lang")])
    most = part.groupBy("code").agg(F.max("share").alias("most"))
    chosen = part.join(most, "code").where((F.col("times") >= 2) & (F.col("share") >= SHARE * F.col("most")))
    best = Window.partitionBy("lang").orderBy(F.desc("times"), "code")
    sets: dict[str, list[int]] = {x: [] for x in languages}
    for r in chosen.withColumn("n", F.row_number().over(best)).where(F.col("n") <= GRAMS).select("lang", "code").collect():
        sets[r[0]].append(r[1])
    return build(languages, [np.array(sets[x], np.int64) for x in languages])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row; reads nothing but the text.

    ``und`` with score 0 for null texts and texts without a letter; a text whose n-grams no
    filter knows gets the most frequent language with score 0. Texts of any length count whole;
    repeated rows repeat; other columns never matter; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = filters.predict(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = train(docs.where(remainder(3) != 1))
    return predict(docs, filters).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
