"""Substring dedup by content-defined chunks.

A gear hash rolls over the text; where its top bits are zero a chunk ends, so cuts depend on
the nearby bytes only and an insertion shifts no cut beyond its own chunk. Chunks are known by
a 128-bit digest. A chunk that a document with a smaller id holds too is repeated; repeated
chunks in a row that make up a passage are removed.

A passage is shared before its first cut and after its last one too. So chunks may serve as
anchors only: each end of a run is compared with the text at the same chunk in the document that
holds it first, and the run grows by the bytes that agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RangeHash, discard, ids_and_texts, mix, release_shuffles, slices, small_batches, staged, text_buffer, unused

#: Shortest and longest chunk in bytes, and the bits that must be zero for a cut (so chunks are
#: about LEAST + 2 ** BITS bytes long). A cut depends on the 32 bytes before it.
LEAST, MOST, BITS = 16, 512, 5
#: Places without a cut after which the first smallest hash among them cuts, so text of a short
#: period is cut at the same phase wherever it stands.
QUIET = 64
#: Bytes before and after a chunk in which the text around it is compared.
BEFORE, AFTER = 256, 128
#: Bytes of repeated chunks in a row that make a passage; shorter repeats are chance phrases.
PASSAGE = 128

_GEAR = np.random.Generator(np.random.PCG64(977)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: the sum of ``gear[b] << age`` over 32 bytes."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):  # doubling: the last 2 * span bytes from two halves
        if len(h) > span:
            h = np.concatenate([h[:span], h[span:] + (h[:-span] << np.uint32(span))])
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of all chunks; they cover every text and never split a character."""
    n = len(data)
    letter_start = np.ones(n + 1, bool)
    letter_start[:n] = (data & 0xC0) != 0x80
    hashed = gear(data)
    cut = np.flatnonzero((hashed >> np.uint32(32 - BITS)) == 0) + 1 if n else np.zeros(0, np.int64)
    cut = cut[letter_start[cut]].tolist()
    start, row = [], []
    at, total = 0, len(cut)
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while at < total and cut[at] <= a:
            at += 1
        # The first 32 bytes of a text are not cut: their hash would reach into the text before.
        soonest = a + 32
        while a < b:
            start.append(a)
            row.append(r)
            soonest = max(soonest, a + LEAST)
            while at < total and cut[at] < soonest:
                at += 1
            stop = cut[at] if at < total else b
            if min(stop, b) - soonest >= QUIET:
                ends = np.arange(soonest, soonest + QUIET)
                ends = ends[letter_start[ends]]
                if len(ends):
                    stop = int(ends[np.argmin(hashed[ends - 1])])
            if stop - a > MOST and b - a > MOST:
                stop = a + MOST
                while not letter_start[stop]:
                    stop -= 1
            a = min(stop, b)
    start_ = np.array(start, np.int64)
    row_ = np.array(row, np.int64)
    return start_, np.append(start_[1:], n), row_


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every chunk, from two independent polynomials."""
    one = RangeHash(data)(start, stop)
    other = RangeHash(data[::-1])(len(data) - stop, len(data) - start)
    return one.view(np.int64), mix(other ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """a, b (digest), doc_id and k (number of the chunk in its document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                data, offsets = text_buffer(piece.column(1))
                start, stop, row = chunks(data, offsets)
                if len(start):
                    first = np.searchsorted(row, np.arange(piece.num_rows))
                    a, b = digests(data, start, stop)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.asarray(piece.column(0))[row]), pa.array((np.arange(len(row)) - first[row]).astype(np.int32))], names=["a", "b", "doc_id", "k"])

    return docs.mapInArrow(run, "a long, b long, doc_id long, k int")


def repeated_chunks(docs: DataFrame, first_too: bool = False) -> DataFrame:
    """a, b, doc_id, k, first_doc of every chunk that a document with a smaller id holds too; with
    ``first_too`` also of the chunks in the document that holds them first.

    Copies are first reduced to one row per digest, map-side, so a chunk that a third of all
    documents share costs no more than any other; the digests that are repeated, a small part,
    then meet the chunks in a join that Spark may split where keys are hot.
    """
    small_batches(docs.sparkSession)
    docs = ids_and_texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    held = chunk_rows(docs).groupBy("a", "b").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    repeated = staged(held.where("first_doc < last_doc").drop("last_doc"), "repeated-chunks")
    release_shuffles(docs.sparkSession)
    rows = chunk_rows(docs).join(repeated, ["a", "b"]).where("doc_id >= first_doc" if first_too else "doc_id > first_doc").select("a", "b", "doc_id", "k", "first_doc")
    out = staged(rows, "chunk-marks")
    discard(repeated)
    release_shuffles(docs.sparkSession)
    return out


def passages(start: np.ndarray, stop: np.ndarray, marked: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of marked chunks that are long enough to be removed."""
    if not len(start):
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    runs = [(int(start[a]), int(stop[b - 1])) for a, b in zip(edge[::2], edge[1::2])]
    return [(a, b) for a, b in runs if b - a >= PASSAGE]


def _around(whole: bytes, a: int, b: int, start: int, stop: int) -> tuple[bytes, bytes]:
    """The bytes before a chunk, last one first, and those after it, within the text a to b."""
    return whole[max(a, start - BEFORE) : start][::-1], whole[stop : min(b, stop + AFTER)]


def rims(marks: DataFrame) -> DataFrame:
    """doc_id, k, first (whether the document holds the chunk first), before and after: the sides
    on which chunks are compared with the text around them.

    Of the chunks that an earlier document holds, those where a run of chunks with one holder
    starts or ends; of the holders' chunks, only those that face one of them.
    """
    marks = marks.groupBy("doc_id", "k").agg(F.min(F.struct("first_doc", "a", "b")).alias("m")).select("doc_id", "k", "m.*")
    near = Window.partitionBy("doc_id").orderBy("k")
    other = lambda x, step: x.isNull() | (x["k"] != F.col("k") + step) | (x["first_doc"] != F.col("first_doc"))
    here = F.struct("k", "first_doc")
    ends = marks.withColumns({"before": other(F.lag(here).over(near), -1), "after": other(F.lead(here).over(near), 1)})
    ends = staged(ends.where("doc_id > first_doc AND (before OR after)").select("doc_id", "k", "a", "b", "before", "after"), "run-ends")
    faced = ends.groupBy("a", "b").agg(F.bool_or("before").alias("before"), F.bool_or("after").alias("after"))
    holders = marks.where("doc_id = first_doc").join(faced, ["a", "b"])
    columns = ["doc_id", "k", "first", "before", "after"]
    return ends.withColumn("first", F.lit(False)).select(*columns).unionByName(holders.withColumn("first", F.lit(True)).select(*columns))


def _edges(marked: DataFrame) -> DataFrame:
    """a, b (digest), side (0 before, 1 after), near (bytes there) and, of ends of runs, doc_id
    and k; of chunks in the document that holds them first, neither. A chunk
    that its document holds several times shows its first and its last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                data, offsets = text_buffer(piece.column(1))
                start, stop, row = chunks(data, offsets)
                edge = np.searchsorted(row, np.arange(piece.num_rows + 1)).tolist()
                one, two = (x.tolist() for x in digests(data, start, stop))
                starts, stops, whole = start.tolist(), stop.tolist(), data.tobytes()
                out = []
                for r, (doc, marks) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())):
                    at, past = edge[r], edge[r + 1]
                    held: dict = {}
                    for m in sorted(marks, key=lambda m: m["k"]):
                        k = at + m["k"]
                        if k >= past:  # of another row with this doc_id
                            continue
                        near = _around(whole, int(offsets[r]), int(offsets[r + 1]), starts[k], stops[k])
                        for side in [s for s, asked in enumerate((m["before"], m["after"])) if asked]:
                            if m["first"]:
                                held.setdefault((one[k], two[k], side), [near[side]])[1:] = [near[side]]
                            else:
                                out.append((one[k], two[k], side, near[side], doc, m["k"]))
                    out += [(*key, near, None, None) for key, nears in held.items() for near in set(nears)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]
                columns = zip(*out) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["a", "b", "side", "near", "doc_id", "k"])

    return marked.mapInArrow(run, "a long, b long, side int, near binary, doc_id long, k int")


def alike(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many bytes at the start of each pair agree; none is longer than ``BEFORE``."""
    wide = lambda z: np.frombuffer(b"".join(t.ljust(BEFORE, b"\0") for t in z), np.uint8).reshape(len(z), BEFORE)
    differ = wide(x) != wide(y)
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), BEFORE)
    return np.minimum(n, [min(len(t), len(u)) for t, u in zip(x, y)])


def reaches(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, k, side, own (a checksum of the bytes on that side) and n of every end of a run
    that grows by n bytes."""
    spark = docs.sparkSession
    docs = ids_and_texts(docs)
    per = rims(marks).groupBy("doc_id").agg(F.collect_list(F.struct("k", "first", "before", "after")).alias("marks"))
    edges = staged(_edges(docs.join(per, "doc_id").select("doc_id", "text", "marks")), "chunk-edges")
    release_shuffles(spark)
    # There are two at most, but for rows that repeat a doc_id.
    held = edges.where("doc_id IS NULL").groupBy("a", "b", "side").agg(F.min("near").alias("one"), F.nullif(F.max("near"), F.min("near")).alias("two"))
    held = staged(held, "chunk-sides")
    release_shuffles(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).to_pylist()
                n = np.maximum(alike(x, batch.column(4).to_pylist()), alike(x, [t or b"" for t in batch.column(5).to_pylist()]))
                own = pa.array([zlib.crc32(t) for t in x], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], own, pa.array(n.astype(np.int32))], names=["doc_id", "k", "side", "own", "n"]).filter(pa.array(n > 0))

    pairs = edges.where("doc_id IS NOT NULL").join(held, ["a", "b", "side"]).select("doc_id", "k", "side", "near", "one", "two")
    out = staged(pairs.mapInArrow(run, "doc_id long, k int, side int, own long, n int"), "chunk-reaches")
    discard(edges)
    discard(held)
    release_shuffles(spark)
    return out


def grown(whole: bytes, a: int, b: int, start: np.ndarray, stop: np.ndarray, marked: np.ndarray, reach: list[dict]) -> list[tuple[int, int]]:
    """(start, stop) of the runs of marked chunks in the text a to b, each grown at its ends and
    joined with those it meets, that are long enough to be removed. No character is split."""
    found = [(int(start[k]), int(stop[k])) for k in np.flatnonzero(marked)]
    for x in reach:
        if x["k"] < len(start) and marked[x["k"]]:
            s, e = int(start[x["k"]]), int(stop[x["k"]])
            if zlib.crc32(_around(whole, a, b, s, e)[x["side"]]) == x["own"]:  # else of another row with this doc_id
                s, e = (s, e + x["n"]) if x["side"] else (s - x["n"], e)
                while s < e and whole[s] & 0xC0 == 0x80:
                    s += 1
                while e < b and whole[e] & 0xC0 == 0x80:
                    e -= 1
                found.append((s, e))
    joined: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if joined and s <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(e, joined[-1][1])
        else:
            joined.append((s, e))
    return [(s, e) for s, e in joined if e - s >= PASSAGE]


def dedup(docs: DataFrame, grow: bool = False, report: str = "__dedup") -> DataFrame:
    """All columns of ``docs`` with the text that is left, and n_bytes, n_chunks, n_removed, n_spans,
    passages (array of start and stop in bytes) and first_docs (ids that hold them first) in a
    struct ``report``, which must not be a column of ``docs``. With ``grow``, runs of repeated
    chunks grow by the bytes around them that agree with the document that holds them first,
    before their length counts.

    Null texts stay null, very long ones are read whole. Rows that repeat a doc_id never cost each
    other text, and a null doc_id loses nothing; other columns may have any name; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    if report.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the report needs a name of its own, {report} is a column")
    doc, ks, firsts_, reach_ = unused(docs, "__doc", "__ks", "__firsts", "__reach")
    small_batches(spark)
    found = repeated_chunks(docs, grow)
    marks = found.where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_list("k").alias(ks), F.array_sort(F.collect_set("first_doc")).alias(firsts_))
    if grow:
        per = reaches(docs, found).groupBy("doc_id").agg(F.collect_list(F.struct("k", "side", "own", "n")).alias(reach_))
        marks = marks.join(per, "doc_id", "left")
    else:
        marks = marks.withColumn(reach_, F.lit(None).cast("array<struct<k:int,side:int,own:bigint,n:int>>"))
    marks = marks.withColumnRenamed("doc_id", doc)
    names = docs.columns
    where = names.index("text")
    kind = pa.struct([("n_bytes", pa.int64()), ("n_chunks", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("first_docs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, names[where]):
                data, offsets = text_buffer(piece.column(where))
                start, stop, row = chunks(data, offsets)
                edge = np.searchsorted(row, np.arange(piece.num_rows + 1))
                whole = data.tobytes()
                texts, reports = [], []
                for r, (hit, firsts, reach, null) in enumerate(zip(*(piece.column(len(names) + i).to_pylist() for i in range(3)), np.asarray(piece.column(where).is_null()))):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    s, e = start[edge[r] : edge[r + 1]], stop[edge[r] : edge[r + 1]]
                    marked = np.zeros(len(s), bool)
                    if hit:
                        k = np.array(hit)
                        marked[k[k < len(s)]] = True
                    gone = grown(whole, a, b, s, e, marked, reach or []) if grow else passages(s, e, marked)
                    edges = [a, *(x for p in gone for x in p), b]
                    left = b"".join(whole[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    texts.append(None if null else left.decode("utf-8", "replace"))
                    reports.append({"n_bytes": b - a, "n_chunks": len(s), "n_removed": b - a - len(left), "n_spans": len(gone), "passages": [{"start": x - a, "stop": y - a} for x, y in gone], "first_docs": (firsts or []) if gone else []})
                columns = [c if i != where else pa.array(texts, c.type) for i, c in enumerate(piece.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(reports, kind)], names=[*names, report])

    joined = docs.join(marks, docs["doc_id"] == marks[doc], "left").select(*[docs[c] for c in names], ks, firsts_, reach_)
    schema = joined.drop(ks, firsts_, reach_).withColumn(report, F.lit(None).cast("struct<n_bytes:bigint,n_chunks:bigint,n_removed:bigint,n_spans:bigint,passages:array<struct<start:int,stop:int>>,first_docs:array<bigint>>")).schema
    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = dedup(docs.select("doc_id", "text"), grow=True, report="found")
    return got.select("doc_id", *[f"found.{c}" for c in ("n_bytes", "n_chunks", "n_removed", "n_spans", "passages", "first_docs")], F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
