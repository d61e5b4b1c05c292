"""Phrase collocations by sorted suffixes.

Every word starts a suffix of at most ``max_n`` words that ends with its piece of text. Equal suffixes
of a task are summed, then suffixes go to tasks by language and first word; first words that
hold more than a small part of all suffixes go by their first two words, and so on. Each task reads its
suffixes in reverse lexicographic order of coded words, where all that share a prefix follow each other,
and counts all prefixes with one stack of open ones. Candidates then meet the counts of their parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, lower_ascii, mix, ranges, slices, small_batches, staged, text_buffer, word_hashes, word_spans
from .decontaminate import same_words

#: Words of the longest phrase, least count, and phrases kept of each language.
MAX_N, LEAST, TOP = 4, 30, 2000
#: A phrase is dropped inside a longer one with at least this part of its count.
PART, OF = 80, 100
SCALE = 2_000_000
UNKNOWN = "und"
#: Bytes of a slice of texts whose equal suffixes are summed together.
SLICE = 2 << 20
#: Documents of the sample that finds frequent words and hot prefixes; a prefix is hot if it starts more than
#: one in HOT_SHARE suffixes (or in four times the number of tasks, if that is less). So no more
#: than HOT_SHARE prefixes of a length are hot. They decide where suffixes go, never what is counted.
SAMPLE_DOCS, HOT_SHARE = 2_000, 16_384

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OUTSIDE = BREAK.copy()
OUTSIDE[[0x09, 0x20]] = True


def strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow array."""
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[ranges(start, length)].tobytes())])


def _by_first_bytes(column: pa.Array) -> np.ndarray:
    """The order of byte strings by their first eight bytes."""
    data, offsets = text_buffer(column)
    at = np.arange(8)
    head = np.append(data, np.zeros(8, np.uint8))[offsets[:-1, None] + at]
    head[at >= np.diff(offsets)[:, None]] = 0
    return np.argsort(head.view(">u8")[:, 0].astype(np.uint64), kind="stable")


class Words:
    """The words of some texts: their letters end to end, hashes, rows, and last words of suffixes."""

    def __init__(self, texts: pa.Array, max_n: int):
        data, offsets = text_buffer(texts)
        data = lower_ascii(data)
        start, stop, self.row = word_spans(data, offsets, OUTSIDE)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(BREAK[data], out=breaks[1:])
        joint = np.zeros(len(start), bool)  # the next word goes on with this one's piece
        joint[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[start[1:]] == breaks[stop[:-1]])
        self.first = np.arange(len(start))
        self.last, more = self.first.copy(), np.ones(len(start), bool)
        for _ in range(max_n - 1):
            more = more & joint[self.last]
            self.last = self.last + more
        self.letters, self.length = data[~OUTSIDE[data]], stop - start
        self.ends = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.hashes = word_hashes(data, start, stop)

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self.length), [None, pa.py_buffer(self.ends.tobytes()), pa.py_buffer(self.letters.tobytes())])

    def prefix_hashes(self, lang: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, hashes of the language and the first k words) for every suffix; ended ones go on as if with
        one more word that is the same for all."""
        now = lang[self.row]
        for k in range(1, most + 1):
            at = self.first + k - 1
            word = np.where(at <= self.last, self.hashes[np.minimum(at, self.last)], np.uint64(1))
            now = mix(now * np.uint64(31) + word)
            yield k, now


class Code:
    """Words as bytes: two for the words of a bounded list, others spelled out between 0x01 and a tab.

    No code begins another, so suffixes share their first words just if they share those bytes. The list
    makes suffixes short; it never decides what is counted. A language is written like a word.
    """

    FIRST, SPELLED, END = 0x0A, 0x01, 0x09  # bytes of listed codes start at FIRST
    SIZE = (0x100 - FIRST) ** 2

    def __init__(self, words: list[bytes]):
        self.words = words[: self.SIZE]
        self.set = pa.array(self.words, pa.large_binary())

    def write(self, letters: np.ndarray, ends: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all words end to end, and n + 1 offsets."""
        number = np.asarray(pc.index_in(words, value_set=self.set).fill_null(-1)).astype(np.int64)
        length = np.diff(ends)
        edge = np.concatenate([[0], np.cumsum(np.where(number < 0, length + 2, 2))]).astype(np.int64)
        out = np.zeros(edge[-1], np.uint8)
        listed, other = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        high, low = np.divmod(number[listed], 0x100 - self.FIRST)
        out[edge[listed]], out[edge[listed] + 1] = high + self.FIRST, low + self.FIRST
        out[edge[other]], out[edge[other + 1] - 1] = self.SPELLED, self.END
        out[ranges(edge[other] + 1, length[other])] = letters[ranges(ends[other], length[other])]
        return out, edge

    def one(self, word: str) -> bytes:
        """The code of a language; signs that words cannot hold are written as %09 and %20."""
        spelled = word.replace("%", "%25").replace("\t", "%09").replace(" ", "%20").encode()
        return self.write(np.frombuffer(spelled, np.uint8), np.array([0, len(spelled)]), pa.array([spelled], pa.large_binary()))[0].tobytes()

    def read(self, code: bytes) -> str:
        out, at = [], 0
        while at < len(code):
            if code[at] == self.SPELLED:
                end = code.index(self.END, at)
                out.append(code[at + 1 : end])
                at = end + 1
            else:
                out.append(self.words[(code[at] - self.FIRST) * (0x100 - self.FIRST) + code[at + 1] - self.FIRST])
                at += 2
        return b" ".join(out).decode()


def _sample(docs: DataFrame, max_n: int, share: int) -> tuple[Code, dict[int, np.ndarray]]:
    """The list of frequent words, and the hashes of hot prefixes of 1 to ``max_n - 1`` words.

    Both come from a sample of documents by a hash of the text, both are bounded, and both only decide
    how suffixes travel.
    """
    size = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = Words(part.column(1), max_n)
                words = found.array().value_counts()
                names = part.column(0).to_pylist()
                tables = [(0, np.zeros(len(words), np.int64), words.field(0), np.asarray(words.field(1)))]
                each = np.bincount(found.row, minlength=len(names))
                tables.append((0, np.zeros(len(names), np.int64), pa.array([x.encode() for x in names], pa.large_binary()), each))
                lang = np.array([_hash(x) for x in names], np.uint64)
                for k, h in found.prefix_hashes(lang, max_n - 1):
                    key, times = np.unique(h, return_counts=True)
                    tables.append((k, key.view(np.int64), pa.nulls(len(key), pa.large_binary()), times))
                for k, key, word, n in tables:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), word.cast(pa.binary()), pa.array(n, pa.int64())], names=["k", "key", "word", "n"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) * F.lit(size) < SAMPLE_DOCS * (1 << 30))
    found = staged(some.mapInArrow(run, "k int, key long, word binary, n long").groupBy("k", "key", "word").agg(F.sum("n").alias("n")), "phrase-sample")
    all_ = found.where("k = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = [bytes(r[0]) for r in found.where("k = 0").orderBy(F.desc("n"), "word").limit(Code.SIZE).select("word").collect()]
    hot: dict[int, list[int]] = {k: [] for k in range(1, max_n)}
    for k, key in found.where((F.col("k") > 0) & (F.col("n") * share > all_)).select("k", "key").collect():
        hot[k].append(key)
    return Code(words), {k: np.array(x, np.int64).view(np.uint64) for k, x in hot.items()}


def _hash(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")


def _suffix_maker(max_n: int, hot: dict[int, np.ndarray]):
    """A function from a code and batches to part, suffix, n: the coded suffixes of all texts, equal
    ones of a slice summed.

    ``part`` deals them out: by language and first word, where that prefix is hot by the next word too,
    and so on. Its two lowest bits are the words it depends on, less one.
    """

    def make(code: Code, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                found = Words(part.column(1), max_n)
                names = part.column(0).to_pylist()
                lang = {x: (_hash(x), code.one(x)) for x in set(names)}
                key, depth = np.zeros(len(found.row), np.uint64), np.zeros(len(found.row), np.uint64)
                going = np.ones(len(found.row), bool)
                for k, h in found.prefix_hashes(np.array([lang[x][0] for x in names], np.uint64), max_n):
                    key[going], depth[going] = h[going], k - 1
                    if k == max_n or not len(hot[k]):
                        break
                    going[going] = np.isin(h[going], hot[k])
                letters, edge = code.write(found.letters, found.ends, found.array())
                suffix = strings(letters, edge[found.first], edge[found.last + 1] - edge[found.first])
                head = pa.array([lang[x][1] for x in names], pa.large_binary()).take(pa.array(found.row))
                coded = pc.binary_join_element_wise(head, suffix, pa.scalar(b"", pa.large_binary())).dictionary_encode()
                number = np.asarray(coded.indices)
                shown = np.zeros(len(coded.dictionary), np.int64)
                shown[number[::-1]] = np.arange(len(number))[::-1]
                dealt = (key[shown] >> np.uint64(40) & np.uint64(0xFFFFFC) | depth[shown]).astype(np.int32)
                times = np.bincount(number, minlength=len(shown)).astype(np.int32)
                order = _by_first_bytes(coded.dictionary)  # neighbours alike make the shuffle small
                yield pa.RecordBatch.from_arrays([pa.array(dealt[order]), coded.dictionary.take(pa.array(order)).cast(pa.binary()), pa.array(times[order])], names=["part", "suffix", "n"])

    return make


class PrefixStack:
    """Counts of all prefixes of coded suffixes that come in reverse lexicographic order.

    The stack holds the prefixes of the last suffix, shortest first, each with its count so far; a
    prefix is complete when the next suffix does not have it. Runs inside a batch are counted
    as whole arrays. Kept are prefixes with a count of ``least``, and those whose rest other
    tasks may hold: languages, and prefixes shorter than what their suffixes were dealt by.
    """

    def __init__(self, levels: int, least: int):
        self.levels, self.least = levels, least
        self.open: list[list] = []  # code, count, whether other tasks may hold the rest
        self.done: list[tuple[int, bytes, int]] = []

    def close(self, level: int) -> None:
        """Pop all open prefixes beyond ``level``."""
        while len(self.open) > level:
            code, count, split = self.open.pop()
            if split or count >= self.least:
                self.done.append((len(self.open), code, count))

    def push(self, suffix: pa.Array, n: np.ndarray, depth: np.ndarray) -> None:
        data, offsets = text_buffer(suffix)
        tabs = np.append(np.flatnonzero(data == Code.END), len(data))
        begin, stop = offsets[:-1], offsets[1:]
        same = np.ones(len(n), bool)  # this prefix is that of the row before
        same[0] = False
        levels, reach = [], 0
        for k in range(1, self.levels + 1):
            has = begin < stop
            spelled = has & (data[np.minimum(begin, len(data) - 1)] == Code.SPELLED)
            end = np.where(has, begin + 2, begin)
            end[spelled] = tabs[np.searchsorted(tabs, begin[spelled])] + 1
            same[1:] &= has[1:] & has[:-1]
            at = np.flatnonzero(same)
            same[at] = same_words(data, begin[at], end[at], data, begin[at - 1], end[at - 1])
            runs = np.flatnonzero(has & ~same)
            if not len(runs):
                break
            reach += int(has[-1])
            split = depth[runs] >= k - 1 if k > 1 else np.ones(len(runs), bool)
            levels.append((runs, np.add.reduceat(np.where(has, n, 0), runs), end, split, bool(has[0])))
            begin = end
        common = 0
        while common < min(len(self.open), len(levels)) and levels[common][4] and self.open[common][0] == data[: levels[common][2][0]].tobytes():
            common += 1
        self.close(common)
        after = []
        for k, (runs, counts, end, split, _) in enumerate(levels, 1):
            if k <= common:
                counts[0] += self.open[k - 1][1]
            if k <= reach:
                after.append([data[offsets[runs[-1]] : end[runs[-1]]].tobytes(), int(counts[-1]), bool(split[-1])])
                runs, counts, split = runs[:-1], counts[:-1], split[:-1]
            keep = np.flatnonzero(split | (counts >= self.least))
            for i, count in zip(runs[keep].tolist(), counts[keep].tolist()):
                self.done.append((k - 1, data[offsets[i] : end[i]].tobytes(), count))
        self.open = after

    def take(self, code: Code) -> Iterator[pa.RecordBatch]:
        if self.done:
            words, codes, n = zip(*self.done)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array([code.read(c) for c in codes], pa.string()), pa.array(n, pa.int64())], names=["words", "phrase", "n"])
            self.done.clear()


def count_phrases(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """words, phrase, n: every phrase of up to ``max_n`` words that occurs ``least`` times in its language,
    after that language (written as by :meth:`Code.one`), which counts as no word; and each
    language with 0 words and the number of all its words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    share = min(HOT_SHARE, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    code, hot = _sample(rows, max_n, share)
    shared = spark.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = PrefixStack(max_n + 1, least)
        for batch in batches:
            if batch.num_rows:
                stack.push(batch.column(1), np.asarray(batch.column(2)), np.asarray(batch.column(0)) & 3)
                yield from stack.take(shared.value)
        stack.close(0)
        yield from stack.take(shared.value)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(shared.value, batches)

    make = _suffix_maker(max_n, hot)
    dealt = rows.mapInArrow(suffixes, "part int, suffix binary, n int").repartition("part").sortWithinPartitions(F.desc("suffix"))
    counted = dealt.mapInArrow(run, "words int, phrase string, n long")
    return counted.groupBy("words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def mine(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``max_n`` words.

    A null lang is ``und``; null and empty texts have no words; a word may be of any length, and
    texts count whole. Repeated rows count as often as they occur; an empty table gives an empty
    result; other columns are never read. Ties go to the larger count, then by the bytes of the phrase.
    """
    counts = staged(count_phrases(docs, max_n, least), "phrase-counts")
    candidates = counts.where("words > 1").select("words", "phrase", F.col("n").alias("a"))
    word, wide = F.split("phrase", " "), "decimal(38,0)"
    part = lambda first, size: F.concat_ws(" ", word[0], F.array_join(F.slice(word, first + 1, size), " "))

    # What lies inside a longer candidate: its inner runs of words, with the largest count.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda first: part(first, m))))
    around = candidates.where("words > 2").select(F.explode(inner).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("around"))
    loose = F.col("around").isNull() | (F.col("around").cast(wide) * OF < F.col("a").cast(wide) * PART)
    kept = candidates.join(around, "phrase", "left").where(loose)

    # Every cut of every phrase left asks for the counts of two parts; often asked ones are broadcast.
    cut = kept.select("words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = part(F.lit(1), F.col("k")).cast("binary").alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).cast("binary").alias("right")
    cut = staged(cut.select("phrase", "a", "k", *sides), "phrase-cuts")
    total, known = cut.count(), counts.where("words > 0").select(F.col("phrase").cast("binary").alias("key"), F.col("n").alias("f"))
    for side, name in (("left", "l"), ("right", "r")):
        asked = cut.groupBy(side).agg(F.count(F.lit(1)).alias("asked"))
        answer = asked.join(known.withColumnRenamed("key", side), side)
        cut = attach(cut, answer, side, "asked", total, "part", ("phrase", "k")).withColumn(name, F.col("part.f")).drop("part")
    cut = cut.withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + r)"))
    lowest = cut.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    lowest = lowest.select(F.substring_index("phrase", " ", 1).alias("lang"), F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a", "m.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = lowest.withColumn("rank", place).where(F.col("rank") <= top)
    best = best.join(counts.where("words = 0").select(F.col("phrase").alias("lang"), "n"), "lang")
    lang = F.col("lang")
    for sign, written in ((" ", "%20"), ("\t", "%09"), ("%", "%25")):
        lang = F.replace(lang, F.lit(written), F.lit(sign))
    return best.select(lang.alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH piece AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
f AS MATERIALIZED (SELECT lang, m, array_to_string(w[k:k + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM w, (SELECT unnest(range(1, {MAX_N + 1})) AS m) WHERE len(w) >= m) GROUP BY ALL HAVING f >= {LEAST}),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
cand AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1),
around AS (SELECT lang, array_to_string(w[s:s + z - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, w, a, z, unnest(range(1, m - z + 2)) AS s FROM cand, (SELECT unnest(range(2, {MAX_N})) AS z) WHERE z < m) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase WHERE o.a IS NULL OR {OF}::HUGEINT * o.a < {PART}::HUGEINT * c.a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, CAST({SCALE}::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
