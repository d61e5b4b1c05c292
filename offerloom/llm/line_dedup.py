"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``EDITS`` edits: if one is split into ``EDITS + 1`` segments, the other holds
one of them unchanged, near the same place. So every line files its segments under (length,
segment, content) and looks up its own substrings that could be a segment of a line as long or
a little shorter. Lines that meet are verified by a banded bit-parallel edit distance; links
join lines into classes, of which the first line stays.

As in the n-gram join, lines of one list meet a leader first, and then only across classes, so
a crowd of lines that are all alike is never paired line by line. Edits count UTF-8 bytes.
Lines too short for that form classes with their exact copies only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, ids_and_texts, mix, release_shuffles, slices, small_batches, staged, text_buffer
from .components import components

#: Edits between lines of one class, and the bytes from which on a line takes part.
EDITS, LEAST = 2, 24
#: Text bytes behind one task that gathers the lists.
TASK_BYTES = 32 << 20
#: Bytes of lines that go through the band at once, and the longest line that does.
BAND_BYTES, LONG_LINE = 1 << 17, 1 << 13


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop, row and number within its text of every line."""
    ends = np.flatnonzero(data == 10)
    row_of_end = np.searchsorted(offsets, ends, "right") - 1
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    row = np.concatenate([row_of_end, filled])
    stop = np.concatenate([ends, offsets[1:][filled]])
    order = np.lexsort((np.concatenate([np.zeros(len(ends)), np.ones(len(filled))]), stop, row))
    row, stop = row[order], stop[order]
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    start = np.where(first, offsets[row], np.concatenate([[0], stop[:-1] + 1])) if len(row) else stop
    head = np.searchsorted(row, row)
    return start, stop, row, np.arange(len(row)) - head


def segment(size: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of segment i of lines of this size; the last ones take the remainder."""
    parts = EDITS + 1
    short, long_ = size // parts, size % parts
    begin = i * short + np.maximum(0, i - (parts - long_))
    return begin, short + (i >= parts - long_)


def signatures(hashed: RangeHash, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, list key, whether it is one of the line's own segments) of every entry."""
    size = stop - start
    line, key, own = [], [], []
    every = np.arange(len(start))
    for less in range(EDITS + 1):
        length = size - less
        for i in range(EDITS + 1):
            begin, width = segment(length, i)
            rest = EDITS - i
            for shift in range(max(-i, less - rest), min(i, less + rest) + 1):
                at = start + begin + shift
                fits = (at >= start) & (at + width <= stop)
                a, w = at[fits], width[fits]
                line.append(every[fits])
                key.append(mix(hashed(a, a + w) + (length[fits] * 16 + i).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
                own.append(np.full(len(a), less == 0 and shift == 0))
    return np.concatenate(line), np.concatenate(key), np.concatenate(own)


def within(a: list[bytes], b: list[bytes], edits: int = EDITS) -> np.ndarray:
    """Which pairs of byte strings are within ``edits``.

    Ends that a pair shares are cut off, as edits never need to touch them. Pairs of like length
    go through the band together, as many as ``BAND_BYTES`` hold; a pair with more than
    ``LONG_LINE`` bytes left is followed along its diagonals instead, in jumps over equal bytes.
    """
    pairs = [_differing(x, y) for x, y in zip(a, b)]
    size = np.array([max(len(x), len(y)) for x, y in pairs], np.int64)
    good = np.zeros(len(pairs), bool)
    for k in np.flatnonzero(size > LONG_LINE):
        good[k] = _within_long(*pairs[k], edits)
    order = np.argsort(size, kind="stable")[: int((size <= LONG_LINE).sum())]
    while len(order):
        n = max(1, int(((size[order] + 1) * np.arange(1, len(order) + 1) <= BAND_BYTES).sum()))
        at, order = order[:n], order[n:]
        good[at] = _band([pairs[k][0] for k in at], [pairs[k][1] for k in at], edits)
    return good


def _differing(x: bytes, y: bytes) -> tuple[bytes, bytes]:
    """Both strings without the bytes they share at the start and then at the end."""
    n = min(len(x), len(y))
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    differ = np.flatnonzero(u[:n] != v[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(u[::-1][: n - head] != v[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    return x[head : len(x) - tail], y[head : len(y) - tail]


def _within_long(x: bytes, y: bytes, edits: int) -> bool:
    """Furthest-reaching points: after each edit, how far along x every diagonal can be matched."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if abs(len(u) - len(v)) > edits:
        return False

    def slide(i: int, diagonal: int) -> int:
        n, step = min(len(u) - i, len(v) - i - diagonal), 4096
        for k in range(0, n, step):
            p, q = u[i + k : i + min(n, k + step)], v[i + diagonal + k : i + diagonal + min(n, k + step)]
            differ = np.flatnonzero(p != q)
            if len(differ):
                return i + k + int(differ[0])
        return i + n

    far = {0: slide(0, 0)}
    for _ in range(edits):
        reach = {}
        for d in range(min(far) - 1, max(far) + 2):
            # a byte of x changed, a byte of y inserted, a byte of x left out
            starts = [far[e] + step for e, step in ((d, 1), (d - 1, 0), (d + 1, 1)) if e in far]
            i = min(max(starts), len(u), len(v) - d)
            if i >= 0 and i + d >= 0:
                reach[d] = slide(i, d)
        far = reach
    return far.get(len(v) - len(u), -1) >= len(u)


def _band(a: list[bytes], b: list[bytes], edits: int) -> np.ndarray:
    """Which pairs are within ``edits``, all pairs at once.

    A band of 2 * edits + 1 diagonals lies in the bits of one word per pair and moves down with
    every byte of b. Bit k of a column stands for the row of a that is k - edits below the
    diagonal; VP and VN say where the value rises or falls from the row above.
    """
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    good = np.abs(la - lb) <= edits
    if not n:
        return good
    width, deep = 2 * edits + 1, int(max(la.max(), lb.max())) + 1
    rows = np.full((deep + 2 * edits + 1, n), 256, np.int16)  # a, with room above and below
    cols = np.full((deep, n), 300, np.int16)
    for k, (x, y) in enumerate(zip(a, b)):
        rows[edits : edits + len(x), k] = np.frombuffer(x, np.uint8)
        cols[: len(y), k] = np.frombuffer(y, np.uint8)
    one = np.uint64(1)
    full = (one << np.uint64(width)) - one
    top = np.uint64(width - 1)
    # Column 0: rows 1 to edits rise; what lies above row 0 is never reached within the band.
    vp = np.full(n, ((1 << width) - 1) & ~((1 << edits) - 1), np.uint64) & full
    vn = np.zeros(n, np.uint64)
    value = np.minimum(la, edits)  # at the band's lowest row, or a's last
    for j in range(int(lb.max())):
        match = np.zeros(n, np.uint64)
        for k in range(width):
            match |= (rows[j + k] == cols[j]).astype(np.uint64) << np.uint64(k)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        on = j < lb
        low = np.minimum(la - (j + 1) + edits, width - 1)  # bit of a's last row, if it is in the band
        diagonal = la - (j + 1) >= edits
        step = np.where(diagonal, 1 - ((d0 >> top) & one).astype(np.int64), 0)
        bit = np.clip(low, 0, width - 1).astype(np.uint64)
        level = ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64)
        value += np.where(on, np.where(diagonal, step, np.where(low >= 0, level, 1)), 0)
        shifted = d0 >> one
        vp, vn = (hn | ~(shifted | hp)) & full, shifted & hp
    return good & (value <= edits)


def _entries(docs: DataFrame, parts: int) -> DataFrame:
    """All list entries, packed per part: key, line (both 8 bytes) and own (1 byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                data, offsets = text_buffer(piece.column(1))
                start, stop, _, _ = lines(data, offsets)
                big = stop - start >= LEAST
                start, stop = start[big], stop[big]
                if not len(start):
                    continue
                hashed = RangeHash(data)
                node, once = np.unique(hashed(start, stop), return_index=True)
                line, key, own = signatures(hashed, start[once], stop[once])
                part = ((key >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                number, edge = np.unique(part[order], return_index=True)
                edges = np.append(edge, len(order))
                key, line, own = key[order].astype("<u8"), node[line[order]].astype("<u8"), own[order].astype("u1")
                blobs = [key[x:y].tobytes() + line[x:y].tobytes() + own[x:y].tobytes() for x, y in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return docs.mapInArrow(run, "part int, blob binary")


def _shared(entries: DataFrame) -> DataFrame:
    """key, node, own of the lists in which two lines meet, one of them with its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, own = [], [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                n = len(blob) // 17
                key.append(np.frombuffer(blob, "<u8", n))
                node.append(np.frombuffer(blob, "<u8", n, 8 * n))
                own.append(np.frombuffer(blob, "u1", n, 16 * n))
        if not key:
            return
        key, node, own = (np.concatenate(x) for x in (key, node, own))
        order = np.lexsort((1 - own, node, key))
        key, node, own = key[order], node[order], own[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, own = key[new], node[new], own[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        meets = np.repeat((size > 1) & (np.maximum.reduceat(own, first) > 0), size)
        key, node, own = key[meets], node[meets], own[meets]
        for a in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 50_000].view(np.int64)), pa.array(node[a : a + 50_000].view(np.int64)), pa.array(own[a : a + 50_000] > 0)], names=["key", "node", "own"])

    return entries.mapInArrow(run, "key long, node long, own boolean")


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """node, doc_id and k (line number) of every line of ``least`` bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                data, offsets = text_buffer(piece.column(1))
                start, stop, row, k = lines(data, offsets)
                big = stop - start >= least
                node = RangeHash(data)(start[big], stop[big])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(np.asarray(piece.column(0))[row[big]]), pa.array(k[big].astype(np.int32))], names=["node", "doc_id", "k"])

    return docs.mapInArrow(run, "node long, doc_id long, k int")


def sketches(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each line, which of 64 classes of byte pairs occur an odd number of times.

    An edit takes away two pairs and adds two at most, so lines within ``EDITS`` edits differ in
    4 * EDITS bits at most; unlike lines differ in about half of them.
    """
    if not len(start):
        return np.zeros(0, np.int64)
    pair = data[:-1].astype(np.uint64) << np.uint64(8) | data[1:].astype(np.uint64)
    bit = np.uint64(1) << (mix(pair) >> np.uint64(58))
    sums = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bit)])
    return (sums[stop - 1] ^ sums[start]).view(np.int64)


def contents(docs: DataFrame) -> DataFrame:
    """node, line (binary) and sketch of every line that takes part, once per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                data, offsets = text_buffer(piece.column(1))
                start, stop, _, _ = lines(data, offsets)
                big = stop - start >= LEAST
                node, once = np.unique(RangeHash(data)(start[big], stop[big]), return_index=True)
                raw = data.tobytes()
                text = [raw[a:b] for a, b in zip(start[big][once].tolist(), stop[big][once].tolist())]
                sketch = sketches(data, start[big][once], stop[big][once])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(text, pa.binary()), pa.array(sketch)], names=["node", "line", "sketch"])

    return docs.mapInArrow(run, "node long, line binary, sketch long")


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) of lines within ``EDITS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = within(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

    with_u = pairs.join(known.select(F.col("node").alias("u"), F.col("line").alias("a")), "u")
    return with_u.join(known.select(F.col("node").alias("v"), F.col("line").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """node and root of every line that is within ``EDITS`` of another one, over any steps."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    posts = staged(_shared(_entries(docs, parts).repartitionById(parts, "part")), "line-lists")
    release_shuffles(spark)
    known = staged(contents(docs).join(posts.select("node").distinct(), "node").dropDuplicates(["node"]), "lines")
    release_shuffles(spark)
    posts = staged(posts.join(known.select("node", "sketch"), "node"), "line-posts")
    alike = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 4 * EDITS
    leader = posts.where("own").groupBy("key").agg(F.min(F.struct("node", "sketch")).alias("l")).select("key", F.col("l.node").alias("lead"), F.col("l.sketch").alias("sketch2"))
    met = posts.join(leader, "key").where((F.col("node") != F.col("lead")) & alike("sketch", "sketch2"))
    best = met.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max(F.struct("c", "lead")).alias("best"))
    stars = staged(verified(best.select(F.col("node").alias("u"), F.col("best.lead").alias("v")), known), "line-stars")
    release_shuffles(spark)
    labelled = posts.join(components(stars), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = staged(labelled.join(several, "key"), "open-lines")
    release_shuffles(spark)
    left = open_.where("own").select("key", F.col("root").alias("root1"), F.col("node").alias("a"), "sketch")
    right = open_.select("key", F.col("root").alias("root2"), F.col("node").alias("b"), F.col("sketch").alias("sketch2"))
    across = left.join(right, "key").where((F.col("root1") != F.col("root2")) & alike("sketch", "sketch2"))
    pairs = staged(across.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "line-pairs")
    more = staged(verified(pairs, known), "line-links")
    release_shuffles(spark)
    return components(stars.unionByName(more))


def dedup(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left) and removed (line number k, and kept_doc
    and kept_k of the line that stays for it) of every document.

    Of a class, the line of the smallest doc_id, then the smallest line number, stays. Lines
    under ``LEAST`` bytes stay as they are; with ``short``, exact copies of those that are not
    empty go as well. Null texts count as empty; rows with a null doc_id
    stay whole and take no part; where rows repeat a doc_id, the same line numbers go from each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = ids_and_texts(docs)
    real = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = staged(occurrences(real, 1 if short else LEAST), "line-occurrences")
    found = found.join(classes(real), "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "k")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    gone = staged(found.join(first, "root").where(F.struct("doc_id", "k") != F.col("first")).select("doc_id", "k", F.col("first.doc_id").alias("kept_doc"), F.col("first.k").alias("kept_k")), "lines-gone")
    release_shuffles(spark)
    per = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("k", "kept_doc", "kept_k"))).alias("ks"))
    kinds = pa.list_(pa.struct([("k", pa.int32()), ("kept_doc", pa.int64()), ("kept_k", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                total, removed, left, behind = [], [], [], []
                for text, ks in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                    own = (text or "").split("\n") if text else []
                    behind.append([x for x in ks or () if x["k"] < len(own)])
                    drop = {x["k"] for x in behind[-1]}
                    keep = [x for k, x in enumerate(own) if k not in drop]
                    total.append(len(own))
                    removed.append(len(own) - len(keep))
                    left.append("\n".join(keep))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string()), pa.array(behind, kinds)], names=["doc_id", "n_lines", "n_removed", "text", "removed"])

    return docs.join(per, "doc_id", "left").select("doc_id", "text", "ks").mapInArrow(run, "doc_id long, n_lines long, n_removed long, text string, removed array<struct<k:int,kept_doc:long,kept_k:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), short=True)
    return got.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("kept_sha256"))
