"""Exact substring dedup: a byte goes if a string of ``LENGTH`` bytes that covers it also
starts in a document with a smaller doc_id.

The decision is made by Burrows-Wheeler transforms of shards that are merged by iterative
interleave refinement: with each step the interleave is right for one more byte, the step at
which two rows part is their common prefix, and rows that have not parted after ``LENGTH``
steps form a repeated interval. No suffix is sorted again; rows that share their prefix with
no other document leave the interleave at once.

Not every suffix of a corpus can be refined that way at an affordable price, so two exact
reductions come first. Every window of ``LENGTH`` bytes is filed under the smallest hash of
its grams; equal windows are filed alike, and neighbouring windows under the same gram form
one string. Files with rows of one document only are settled, as are files that hold copies
of one and the same string. The strings of the other files, chiefly the rims of repeated
passages, go to the shards, some files at a time.

A file that holds a large part of all runs, because very many documents share a passage, would
crowd one task. Such files are found on a sample of the texts, which decides nothing but the
way: their windows are counted one by one in Spark, spread by their hash. Strings agree if the
64-bit hash of their smallest gram and another 64-bit hash of all their bytes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, discard, ids_and_texts, mix, release_shuffles, slices, small_batches, staged, text_buffer

LENGTH = 50
GRAM = 20
#: Longest run of windows in one string.
RUN = 200
#: Text bytes behind one task that settles files, or string bytes of one that compares them, and
#: bytes of strings in one shard.
TASK_BYTES, SHARD_BYTES = 12 << 20, 1 << 19
#: Bytes of strings whose files a task refines at once (one file at least).
GROUP_BYTES = 2 << 20
#: Text bytes of the sample that finds hot files. A file is hot if it has so many runs, and more
#: than a quarter of what a task settles; a share of 1 / HOT_SHARE is enough in any table.
SAMPLE_BYTES, HOT_RUNS, HOT_SHARE = 32 << 20, 10_000, 1 << 16

SPANS = "doc_id long, start int, n_bytes int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every position."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    load = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    m = n - GRAM + 1
    x = load[:m] * np.uint64(0x9E3779B97F4A7C15)
    x += load[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x += load[GRAM - 8 : GRAM - 8 + m] * np.uint64(0x165667B19E3779F9)
    return mix(x)


def filed_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """File (gram hash), first window and number of windows of every run."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, span, width = gram_hashes(data), 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    over = np.zeros(n + 1, np.int32)  # windows that reach over the end of their text
    np.add.at(over, np.maximum(offsets[1:] - (LENGTH - 1), offsets[:-1]), 1)
    np.add.at(over, offsets[1:], -1)
    inside = np.cumsum(over)[: len(low)] == 0
    change = low[1:] != low[:-1]
    first = np.flatnonzero(inside & np.concatenate([[True], change | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], [True]]))
    count = last - first + 1
    if (count > RUN).any():
        parts = -(-count // RUN)
        of = np.repeat(np.arange(len(first)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = first[of] + k * RUN, np.minimum(count[of] - k * RUN, RUN)
    return low[first], first, count


# -- rows that travel as packed columns -----------------------------------------------------

_COLUMNS = {"file": "<u4", "content": "<u8", "start": "<u4", "windows": "u1", "doc": "<i8"}
_WIDTH = sum(np.dtype(t).itemsize for t in _COLUMNS.values())


def _pack(columns: dict[str, np.ndarray], at: slice) -> bytes:
    return b"".join(columns[c][at].astype(t).tobytes() for c, t in _COLUMNS.items())


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {c: [] for c in _COLUMNS}
    for blob in blobs:
        n, at = len(blob) // _WIDTH, 0
        for c, t in _COLUMNS.items():
            parts[c].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(p) if p else np.zeros(0, t) for (c, p), t in zip(parts.items(), _COLUMNS.values())}


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which members of ``x`` are in ``sorted_``."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def hot_files(docs: DataFrame, total: int, parts: int) -> np.ndarray:
    """The files that are too large for one task, at most ``HOT_SHARE`` of them."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    some = docs if share == 1.0 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                file, times = np.unique(filed_runs(*text_buffer(piece.column(1)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(file.view(np.int64)), pa.array(times)], names=["file", "times"])

    counts = staged(some.mapInArrow(run, "file long, times long").groupBy("file").agg(F.sum("times").alias("times")), "file-counts")
    runs = counts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    least = max(HOT_RUNS * share, runs * max(1 / (4 * parts), 1 / HOT_SHARE))
    found = np.array([r[0] for r in counts.where(F.col("times") > least).select("file").collect()], np.int64)
    discard(counts)
    return np.sort(found.view(np.uint64))


def _hot_spans(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Spans of one window each, for windows of hot files that an earlier document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                data, offsets = text_buffer(piece.column(1))
                file, first, count = filed_runs(data, offsets)
                take = _among(file, hot)
                file, first, count = file[take], first[take], count[take]
                if len(file):
                    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    row = np.searchsorted(offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(file, count).view(np.int64)), pa.array(RangeHash(data)(at, at + LENGTH).view(np.int64)), pa.array(np.asarray(piece.column(0))[row]), pa.array((at - offsets[row]).astype(np.int32))], names=["file", "window", "doc_id", "start"])

    windows = docs.mapInArrow(run, "file long, window long, doc_id long, start int")
    held = windows.groupBy("file", "window").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    held = staged(held.where("first_doc < last_doc").drop("last_doc"), "hot-windows")
    later = windows.join(held, ["file", "window"]).where("doc_id > first_doc")
    out = staged(later.select("doc_id", "start", F.lit(LENGTH).alias("n_bytes")), "hot-spans")
    discard(held)
    return out


def _file_away(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Runs of all texts but those of hot files, packed per part: part int, blob binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                data, offsets = text_buffer(piece.column(1))
                file, first, count = filed_runs(data, offsets)
                cold = ~_among(file, hot)
                file, first, count = file[cold], first[cold], count[cold]
                if not len(file):
                    continue
                row = np.searchsorted(offsets, first, "right") - 1
                part = ((file >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                columns = {"file": file & np.uint64(0xFFFFFFFF), "content": RangeHash(data)(first, first + count + LENGTH - 1), "start": first - offsets[row], "windows": count, "doc": np.asarray(piece.column(0))[row]}
                columns = {c: x[order] for c, x in columns.items()}
                number, edge = np.unique(part[order], return_index=True)
                edges = np.append(edge, len(order))
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array([_pack(columns, slice(a, b)) for a, b in zip(edges, edges[1:])], pa.binary())], names=["part", "blob"])

    return docs.mapInArrow(run, "part int, blob binary")


def _settle(packed: DataFrame) -> DataFrame:
    """For each file with rows of two documents or more: spans of repeated strings, and (with
    a file number) the strings that the shards must compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _unpack([b for batch in batches for b in batch.column(1).to_pylist()])
        if not len(x["file"]):
            return
        order = np.lexsort((x["doc"], x["content"], x["file"]))
        x = {c: v[order] for c, v in x.items()}
        new_file = np.concatenate([[True], x["file"][1:] != x["file"][:-1]])
        new_string = new_file | np.concatenate([[True], x["content"][1:] != x["content"][:-1]])
        at = np.flatnonzero(new_file)
        of = np.cumsum(new_file) - 1
        least, most = np.minimum.reduceat(x["doc"], at), np.maximum.reduceat(x["doc"], at)
        shared = (least < most)[of]
        single = (np.bincount(of, new_string) == 1)[of]
        later = shared & single & (x["doc"] > least[of])
        unsure = shared & ~single
        for take, file in ((later, False), (unsure, True)):
            who = np.flatnonzero(take)
            for a in range(0, len(who), 50_000):
                w = who[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc"][w]), pa.array(x["start"][w].astype(np.int32)), pa.array(x["windows"][w].astype(np.int32) + (LENGTH - 1)), pa.array(x["file"][w].astype(np.int64)) if file else pa.nulls(len(w), pa.int64())],
                    names=["doc_id", "start", "n_bytes", "file"],
                )

    return packed.mapInArrow(run, f"{SPANS}, file long")


def _cut_out(docs: DataFrame, unsure: DataFrame, parts: int) -> DataFrame:
    """Bring the strings of ``unsure`` from the texts: part, file, doc_id, start, string."""
    wanted = unsure.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n_bytes").alias("sizes"), F.collect_list("file").alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                ids, texts, starts, sizes, files = ([], [], [], [], [])
                for doc, text, s, n, f in zip(*(c.to_pylist() for c in piece.columns)):
                    raw = (text or "").encode()
                    ids += [doc] * len(s)
                    texts += [raw[a : a + k] for a, k in zip(s, n)]
                    starts += s
                    sizes += n
                    files += f
                whole = [len(t) == k for t, k in zip(texts, sizes)]  # false only where doc_ids repeat
                out = pa.RecordBatch.from_arrays([pa.array([f % parts for f in files], pa.int32()), pa.array(files, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(texts, pa.binary())], names=["part", "file", "doc_id", "start", "string"])
                yield out.filter(pa.array(whole, pa.bool_()))

    joined = docs.join(wanted, "doc_id").select("doc_id", "text", "starts", "sizes", "files")
    return joined.mapInArrow(run, "part int, file long, doc_id long, start int, string binary")


# -- Burrows-Wheeler transforms of shards ---------------------------------------------------


class ShardBWT:
    """Transform of a set of strings, rows in the order of their first ``LENGTH`` bytes.

    ``symbol[r]`` is the byte before the suffix of row r plus one, 0 at a string's start;
    ``before[r]`` is the row of the suffix that starts there. Each string's empty suffix has a
    row too.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        text = np.zeros(int(sizes.sum()) + len(strings), np.int16)  # 0 ends a string
        self.string = np.repeat(np.arange(len(strings)), sizes + 1)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        self.offset = np.arange(len(text)) - begin[self.string]
        body = self.offset < sizes[self.string]
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
        wide = np.concatenate([text, np.zeros(LENGTH, np.int16)]).astype(">u2")
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, LENGTH)[: len(text)]).view(f"V{2 * LENGTH}").ravel() if len(text) else np.zeros(0)
        rows = np.argsort(keys, kind="stable")
        place = np.empty(len(text), np.int64)
        place[rows] = np.arange(len(text))
        start = self.offset[rows] == 0
        self.symbol = np.where(start, 0, text[rows - 1])
        self.before = np.where(start, -1, place[rows - 1])
        self.string, self.offset = self.string[rows], self.offset[rows]


def merge(shards: list[ShardBWT], low: np.ndarray, high: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Refine the interleave of all shards ``depth`` times.

    ``low`` and ``high`` are the smallest and largest doc_id of each string, shard after shard.
    Returns the rows (numbered shard after shard) whose first ``depth`` bytes also start in
    another document, in merged order, and the number of the repeated interval of each.
    """
    shift = np.cumsum([0] + [len(s.symbol) for s in shards])
    strings = np.cumsum([0] + [int(s.string.max(initial=-1)) + 1 for s in shards])
    symbol = np.concatenate([s.symbol for s in shards])
    before = np.concatenate([s.before + a for s, a in zip(shards, shift)])
    string = np.concatenate([s.string + a for s, a in zip(shards, strings)])
    low, high = low[string], high[string]
    row = np.arange(len(symbol))
    block = np.zeros(len(row), np.int64)
    for step in range(1, depth + 1):
        c = symbol[row]
        inner = c > 0
        row, block, c = row[inner], block[inner], c[inner]
        order = np.argsort(c.astype(np.uint16), kind="stable")
        row, block, c = before[row[order]], block[order], c[order]
        if not len(row):
            break
        parted = np.concatenate([[True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])])  # common prefix: step - 1
        block = np.cumsum(parted) - 1
        if step % 4 == 0 or step == depth:
            edge = np.flatnonzero(parted)
            alive = (np.minimum.reduceat(low[row], edge) < np.maximum.reduceat(high[row], edge))[block]
            row, block = row[alive], block[alive]
    return row, block


def repeated(files: np.ndarray, docs: np.ndarray, starts: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, n_bytes) of the runs of windows that an earlier document holds as well.

    Strings that are alike within a file are compared once. A string is passed by if, to
    neither side of its gram, half the rest of a window is shared with another document: then
    none of its windows is.
    """
    nothing = np.zeros(0, np.int64)
    if not len(files):
        return nothing, nothing, nothing
    known: dict[tuple[int, bytes], int] = {}
    of = np.array([known.setdefault(k, len(known)) for k in zip(files.tolist(), strings)], np.int64)
    keys = list(known)
    file, distinct = np.array([k[0] for k in keys], np.int64), [k[1] for k in keys]
    low = np.full(len(keys), np.iinfo(np.int64).max)
    high = np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, of, docs)
    np.maximum.at(high, of, docs)
    keep = _may_share(file, distinct, low, high)
    chosen = np.flatnonzero(keep)
    if not len(chosen):
        return nothing, nothing, nothing
    size = np.cumsum([len(distinct[i]) for i in chosen])
    shard = size // SHARD_BYTES
    shards, begin = [], 0
    for stop in [*np.flatnonzero(np.diff(shard)) + 1, len(chosen)]:
        if stop > begin:
            shards.append(ShardBWT([distinct[i] for i in chosen[begin:stop]]))
        begin = stop
    row, block = merge(shards, low[chosen], high[chosen])
    if not len(row):
        return nothing, nothing, nothing
    count = np.cumsum([0] + [int(s.string.max(initial=-1)) + 1 for s in shards])
    string = chosen[np.concatenate([s.string + a for s, a in zip(shards, count)])[row]]
    offset = np.concatenate([s.offset for s in shards])[row]
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    first = np.repeat(np.minimum.reduceat(low[string], edge), np.diff(np.append(edge, len(block))))
    # Every occurrence of the string in a document after the first one loses the window.
    order = np.lexsort((offset, string))
    string, offset, first = string[order], offset[order], first[order]
    occurrence = np.argsort(of, kind="stable")
    occ_begin = np.searchsorted(of[occurrence], string)
    occ_count = np.searchsorted(of[occurrence], string, "right") - occ_begin
    window = np.repeat(np.arange(len(string)), occ_count)
    who = occurrence[np.repeat(occ_begin - (np.cumsum(occ_count) - occ_count), occ_count) + np.arange(len(window))]
    later = docs[who] > first[window]
    who, at = who[later], offset[window[later]]
    if not len(who):
        return nothing, nothing, nothing
    order = np.lexsort((at, who))
    who, at = who[order], at[order]
    begin_run = np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)])
    b = np.flatnonzero(begin_run)
    n = np.diff(np.append(b, len(at)))
    return docs[who[b]], starts[who[b]] + at[b], n + LENGTH - 1


def _may_share(file: np.ndarray, strings: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which strings can share a window with another document."""
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(sizes) - sizes
    gram = (gram_hashes(data) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(strings)), sizes)[: len(gram)]
    within = np.arange(len(gram)) + GRAM <= (begin + sizes)[row]
    hit = np.flatnonzero(within & (gram == file[row]))
    times = np.bincount(row[hit], minlength=len(strings))
    keep = (low < high) | np.isin(file, file[times != 1])  # a gram that is there twice: no short cut
    one = hit[times[row[hit]] == 1]
    r, side = row[one], -(-(LENGTH - GRAM) // 2)
    hashed = RangeHash(data)
    for a, b in ((one, one + GRAM + side), (one - side, one + GRAM)):
        fits = (a >= begin[r]) & (b <= (begin + sizes)[r])
        code = mix(hashed(a[fits], b[fits]) + file[r[fits]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if not len(code):
            continue
        _, number = np.unique(code, return_inverse=True)
        lo, hi = np.full(number.max() + 1, np.iinfo(np.int64).max), np.full(number.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(lo, number, low[r[fits]])
        np.maximum.at(hi, number, high[r[fits]])
        keep[r[fits]] |= (lo < hi)[number]
    return keep


def _compare(strings: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        file, doc, start = (table.column(c).to_numpy() for c in ("file", "doc_id", "start"))
        order = np.argsort(file, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(file[order])) + 1, len(order))  # of files
        filled = np.cumsum(pc.binary_length(table.column("string")).to_numpy()[order])[ends - 1]
        last = np.append(np.diff(filled // GROUP_BYTES) > 0, True)
        begin = 0
        for stop in ends[last]:
            at = order[begin:stop]
            d, s, n = repeated(file[at], doc[at], start[at].astype(np.int64), table.column("string").take(pa.array(at)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "start", "n_bytes"])
            begin = stop

    return strings.mapInArrow(run, SPANS)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_bytes of stretches (that may overlap) to remove from each document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = ids_and_texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    hot = hot_files(docs, total, parts)
    settled = staged(_settle(_file_away(docs, parts, hot).repartitionById(parts, "part")), "settled")
    unsure = settled.where("file IS NOT NULL")
    strings = unsure.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]  # overlap, so up to some times the text
    release_shuffles(spark)  # after the sum: only another query lets go of the plan that wrote the table
    parts = max(parts, -(-strings // TASK_BYTES))
    compared = staged(_compare(_cut_out(docs, unsure, parts).repartitionById(parts, "part")), "compared")
    release_shuffles(spark)
    found = settled.where("file IS NULL").drop("file").unionByName(compared)
    return found.unionByName(_hot_spans(docs, hot)) if len(hot) else found


def join_runs(start: list[int], size: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (start, stop) of the bytes that the stretches cover."""
    runs: list[tuple[int, int]] = []
    for a, n in sorted(zip(start, size)):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], a + n))
        else:
            runs.append((a, a + n))
    return runs


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Apply :func:`spans`: doc_id, n_bytes, n_removed, n_spans, kept (binary), runs."""
    per = found.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n_bytes").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                out: list[list] = [[], [], [], [], []]
                for text, starts, sizes in zip(*(piece.column(k).to_pylist() for k in (1, 2, 3))):
                    raw = (text or "").encode()
                    runs = join_runs(starts or [], sizes or [])
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    for column, value in zip(out, (len(raw), len(raw) - len(kept), len(runs), kept, [{"start": a, "stop": b} for a, b in runs])):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(v, t) for v, t in zip(out, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "runs"])

    joined = ids_and_texts(docs).join(per, "doc_id", "left").select("doc_id", "text", "starts", "sizes")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, runs array<struct<start:int,stop:int>>")


def dedup(docs: DataFrame) -> DataFrame:
    """Every document with what is left of it.

    Null texts count as empty. Rows that repeat a doc_id never cost each other a byte, and a
    null doc_id neither loses nor takes bytes; an empty table gives an empty result. Kept bytes
    may start inside a character, because strings are judged as bytes.
    """
    return remove(docs, spans(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
