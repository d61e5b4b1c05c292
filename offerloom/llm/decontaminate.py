"""Benchmark decontamination: training texts that repeat windows of test items.

The words of the benchmark's items are cut into windows, and the distinct windows go to all tasks
as a hash set of a bounded size; a benchmark beyond that bound is taken in blocks, each with a scan of
its own. A scan rolls over the windows of every document, looks them up, and verifies each hit by the
bytes of its words. Runs of hit words are cut out of a text, or the document goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, mix, ranges, slices, small_batches, staged, text_buffer, unused, word_hashes, word_spans

#: Words of a window.
WIDTH = 10
#: Bytes of item words in one broadcast hash set, and words of a piece of an item.
BLOCK_BYTES, PIECE_WORDS = 16 << 20, 4_096
#: Bytes that no word holds: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

REPORT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<first:long,last:long,start:long,stop:long>>>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def blocks(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """block, item (item_id as text), words: the items as words joined by a space.

    Long items are cut into pieces that overlap by ``width - 1`` words, so each window lies in
    one. The rows of a block hold ``BLOCK_BYTES`` bytes, or one piece more, at the most.
    """
    small_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, filled = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in slices(batch, "words"):
                data, offsets = text_buffer(part.column(1))
                data = lower_ascii(data)
                start, stop, row = word_spans(data, offsets, OUTSIDE)
                names, out = part.column(0), ([], [], [])
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                for i in np.unique(row):
                    for k in range(edge[i], max(edge[i] + 1, edge[i + 1] - width + 1), PIECE_WORDS):
                        to = min(edge[i + 1], k + PIECE_WORDS + width - 1)
                        words = b" ".join(data[a:b].tobytes() for a, b in zip(start[k:to], stop[k:to]))
                        if filled > BLOCK_BYTES:
                            block, filled = block + 1, 0
                        filled += len(words)
                        for column, value in zip(out, (task << 32 | block, names[int(i)].as_py(), words)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["block", "item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("words")).where("words IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    return rows.coalesce(1 + size // BLOCK_BYTES).mapInArrow(run, "block long, item string, words binary")


def rolled(words: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(w, hashes of the windows of w words that start at each word) for 1 to ``width``."""
    total = np.zeros(len(words), np.uint64)
    factor = np.uint64(1)
    for w in range(1, min(width, len(words)) + 1):
        total = total[: len(words) - w + 1] + words[w - 1 :] * factor
        factor = np.uint64(int(factor) * int(_STEP) % (1 << 64))
        yield w, mix(total)


def same_words(a: np.ndarray, a_start: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_stop: np.ndarray) -> np.ndarray:
    """Whether the bytes of each word of ``a`` are those of its partner in ``b``."""
    same = a_stop - a_start == b_stop - b_start
    at = np.flatnonzero(same)
    length = (a_stop - a_start)[at]
    for k in range(0, len(at), 1 << 16):
        some, n = at[k : k + (1 << 16)], length[k : k + (1 << 16)]
        equal = a[ranges(a_start[some], n)] == b[ranges(b_start[some], n)]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


class Windows:
    """The distinct windows of one block: hashes in order, their words, and the items that hold them."""

    def __init__(self, items: list[str | None], words: pa.Array, width: int = WIDTH):
        self.width = width
        self.data, offsets = text_buffer(words)
        self.start, self.stop, row = word_spans(self.data, offsets, OUTSIDE)
        self.names = sorted({x for x in items if x is not None})
        place = {x: k for k, x in enumerate(self.names)}
        number = np.array([place.get(x, -1) for x in items], np.int64)
        count = np.bincount(row, minlength=len(items))
        first = np.cumsum(count) - count
        short = np.minimum(count, width)
        each = np.where(count > 0, count - short + 1, 0)
        at, size, item = ranges(first, each), np.repeat(short, each), np.repeat(number, each)
        # Equal windows are one entry; Arrow compares their bytes.
        left, right = self.start[at], self.stop[at + size - 1] if len(at) else at
        ends = np.concatenate([[0], np.cumsum(right - left)]).astype(np.int64)
        texts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(self.data[ranges(left, right - left)].tobytes())])
        entry = np.asarray(texts.dictionary_encode().indices).astype(np.int64)
        _, shown = np.unique(entry, return_index=True)
        self.at, self.size = at[shown], size[shown]
        held = np.unique(entry[item >= 0] << 32 | item[item >= 0])
        self.items, owner = held & 0xFFFFFFFF, held >> 32
        self.item_edge = np.searchsorted(owner, np.arange(len(shown) + 1))
        hashes = word_hashes(self.data, self.start, self.stop)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, x in rolled(hashes, width):
            mine = np.flatnonzero(self.size == w)
            if len(mine):
                key = x[self.at[mine]]
                order = np.argsort(key, kind="stable")
                self.by_size[w] = key[order], mine[order]
        # Most windows of clean text fail here, at one look-up.
        bits = max(16, int(16 * len(shown)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        for key, _ in self.by_size.values():
            self.seen[(key & self.mask).astype(np.int64)] = True

    def find(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, entry) of every occurrence in lower-cased texts; no window crosses rows."""
        found = [np.zeros((2, 0), np.int64)]
        for w, x in rolled(word_hashes(data, start, stop), self.width):
            if w not in self.by_size:
                continue
            key, entry = self.by_size[w]
            at = np.flatnonzero(self.seen[(x & self.mask).astype(np.int64)] & (row[: len(x)] == row[w - 1 :]))
            low, high = np.searchsorted(key, x[at], "left"), np.searchsorted(key, x[at], "right")
            here, there = np.repeat(at, high - low), entry[ranges(low, high - low)]
            # Neighbouring windows share words; each pair of words is compared once.
            step = np.arange(w)
            pair = (here[:, None] + step) * len(self.start) + self.at[there][:, None] + step
            once, back = np.unique(pair, return_inverse=True)
            mine, other = np.divmod(once, max(1, len(self.start)))
            same = same_words(data, start[mine], stop[mine], self.data, self.start[other], self.stop[other])
            good = same[back.reshape(pair.shape)].all(axis=1)
            found.append(np.array([here[good], there[good]]))
        return tuple(np.concatenate(found, axis=1))

    def report(self, texts: pa.Array) -> list[dict]:
        """What :data:`REPORT` names, for every text."""
        data, offsets = text_buffer(texts)
        data = lower_ascii(data)
        start, stop, row = word_spans(data, offsets, OUTSIDE)
        edge = np.searchsorted(row, np.arange(len(texts) + 1))
        word, entry = self.find(data, start, stop, row)
        change = np.bincount(word, minlength=len(start) + 1) - np.bincount(word + self.size[entry], minlength=len(start) + 1)
        hit = np.cumsum(change)[:-1] > 0
        joint = np.zeros(len(start) + 1, bool)  # word i goes on with the run of word i - 1
        joint[1:-1] = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
        first, last = np.flatnonzero(hit & ~joint[:-1]), np.flatnonzero(hit & ~joint[1:])
        own = row[first]
        pairs = np.unique(row[word] * len(self.size) + entry)
        of, entry = np.divmod(pairs, max(1, len(self.size)))
        length = self.item_edge[entry + 1] - self.item_edge[entry]
        held = np.unique(np.repeat(of, length) << 32 | self.items[ranges(self.item_edge[entry], length)])
        out = [{"n_words": int(n), "n_hit": 0, "items": [], "spans": []} for n in np.diff(edge)]
        for i, a, b in zip(own.tolist(), first.tolist(), last.tolist()):
            out[i]["n_hit"] += b - a + 1
            out[i]["spans"].append({"first": a - int(edge[i]), "last": b - int(edge[i]), "start": int(start[a] - offsets[i]), "stop": int(stop[b] - offsets[i])})
        for x in held.tolist():
            out[x >> 32]["items"].append(self.names[x & 0xFFFFFFFF])
        return out


def scan(docs: DataFrame, windows: Windows, report: str) -> DataFrame:
    """``docs`` and the column ``report``: the occurrences of one block's windows in ``text``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    span = pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "stop")])
    struct = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = shared.value.report(part.column(part.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, struct)], names=[*part.schema.names, report])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(report, T.StructType.fromDDL(f"report {REPORT}")["report"].dataType)]))


def _merged(reports: list[dict]) -> dict:
    """The reports of several blocks on one document as one."""
    spans: list[dict] = []
    for s in sorted((s for r in reports for s in r["spans"]), key=lambda s: (s["first"], s["last"])):
        if spans and s["first"] <= spans[-1]["last"] + 1:
            if s["last"] > spans[-1]["last"]:
                spans[-1] = spans[-1] | {"last": s["last"], "stop": s["stop"]}
        else:
            spans.append(s)
    hit = sum(s["last"] - s["first"] + 1 for s in spans)
    return {"n_words": reports[0]["n_words"], "n_hit": hit, "items": sorted({x for r in reports for x in r["items"]}), "spans": spans}


def mark(docs: DataFrame, benchmark: DataFrame, report: str = "contamination", width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` with the column ``report``: n_words, n_hit (words inside an occurrence of
    a window), items (ids with occurring windows as text, in order) and spans (runs of hit words:
    their numbers, and their bytes in the text).

    Null texts have no words and no hits; texts of any length are scanned whole; an item without words
    marks nothing, items with equal texts are all named, one with a null id hits but is not
    named; items with one id count as one. Repeated rows are all marked; an empty table or benchmark is
    all right; other columns stay, whatever their names.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    pieces = staged(blocks(benchmark, width), "benchmark-blocks")
    numbers = [r[0] for r in pieces.select("block").distinct().orderBy("block").collect()]

    def load(block: int) -> Windows:
        rows = pieces.where(F.col("block") == block).select("item", "words").toArrow().combine_chunks()
        return Windows(rows.column(0).to_pylist(), rows.column(1), width)

    if len(numbers) <= 1:
        return scan(docs, load(numbers[0] if numbers else 0), report)
    # Several blocks: a scan of its own for each, then the reports of a document are joined.
    row, found = unused(docs, "row", "found")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    parts = [scan(numbered.select(row, "text"), load(b), found).select(row, found).where((F.lit(b) == numbers[0]) | (F.col(found)["n_hit"] > 0)) for b in numbers]
    parts = [staged(p, "decontamination-block") for p in parts]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    schema = T.StructType([numbered.schema[row], T.StructField(report, union.schema[found].dataType)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(1).type.value_type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_merged(x) for x in batch.column(1).to_pylist()], kind)], names=[row, report])

    whole = union.groupBy(row).agg(F.collect_list(found).alias(found)).mapInArrow(merge, schema)
    return numbered.join(whole, row).select(*docs.columns, report)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH) -> DataFrame:
    """``docs`` without what it shares with the benchmark, other columns as they are.

    ``spans`` cuts every run of hit words from its text, from the first byte of the first word to
    the last of the last; ``documents`` drops the rows with a hit. All rows of :func:`mark` count.
    """
    report = unused(docs, "contamination")[0]
    marked = mark(docs, benchmark, report, width)
    if remove == "documents":
        return marked.where(F.col(report)["n_hit"] == 0).drop(report)
    if remove != "spans":
        raise ValueError("remove is 'spans' or 'documents'")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("text")
            texts = batch.column(where).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).field("spans").to_pylist()):
                if spans:
                    whole = texts[i].encode()
                    edges = [0, *(x for s in spans for x in (s["start"], s["stop"])), len(whole)]
                    texts[i] = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
            yield batch.set_column(where, "text", pa.array(texts, batch.column(where).type)).drop_columns([report])

    kept = T.StructType([f for f in marked.schema.fields if f.name != report])
    return marked.mapInArrow(cut, kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "m")
    items = F.sha2(F.array_join("m.items", ",").cast("binary"), 256)
    return marked.select("doc_id", "m.n_words", "m.n_hit", F.size("m.items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("m.n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item AS (SELECT item_id, least(len(w), {WIDTH}) AS size, array_to_string(w[k:k + least(len(w), {WIDTH}) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS k FROM b WHERE len(w) > 0)),
win AS (SELECT DISTINCT size, x FROM item),
seen AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS x
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT r, k, seen.size, x FROM seen JOIN win USING (size, x)),
words AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM (SELECT r, k, unnest(range(size)) AS o FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit JOIN item USING (size, x)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
