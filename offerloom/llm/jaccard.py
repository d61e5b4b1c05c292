"""N-gram Jaccard join and its connected components.

Documents with equal shingle sets are one node. A set is ordered rare shingles first; two sets
that are similar enough share a shingle among the first few of each, so nodes meet on those.
Pairs are cut by length, by the positions of the shared shingle and by a suffix filter, and
what is left is verified once per pair.

A group of near copies must not meet pair by pair. So nodes first meet one leader each, the
most shared of the least nodes of their shingles' lists; the links found give components. Then
only nodes of different components that share a shingle meet, so that no link between
components is lost, and none within a component is looked for in vain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RangeHash, attach, discard, ids_and_texts, lower_ascii, mix, release_shuffles, slices, small_batches, staged, text_buffer, word_spans
from .components import components

#: Counters of the frequency sketch that orders shingles (one long each when broadcast).
SKETCH = 1 << 17
#: Shingles that a prefix holds beyond what the plain prefix filter asks for; linked sets then
#: share so many more, and most pairs need not look at crowded lists.
EXTRA = 40
#: A list of more nodes than this is crowded, and the neighbours that a node of one tries a round.
CROWD, TRIES = 8, 12
#: Nodes of a crowded list that stand in one order; longer lists are split anew in each round.
LANE = 1_024


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; linked if of * intersection >= part * union."""

    words: int = 5
    part: int = 80
    of: int = 100

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of each distinct shingle of every text, sorted by row and hash."""
        x = lower_ascii(data)
        start, stop, row = word_spans(x, offsets)
        word = RangeHash(x)(start, stop)
        count = np.bincount(row, minlength=len(offsets) - 1)
        whole = word
        full = np.ones(len(word), bool)
        for k in range(1, self.words):
            there = np.zeros(len(word), bool)
            there[: max(0, len(word) - k)] = row[: max(0, len(word) - k)] == row[k:]
            nxt = np.zeros(len(word), np.uint64)
            nxt[: max(0, len(word) - k)] = word[k:]
            joined = mix(whole * np.uint64(0x9FB21C651E98DF25) + nxt)
            whole = np.where(there, joined, whole)
            full &= there
        # A text of fewer words is one shingle: the words that are there, joined from the first.
        first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        use = full | (first & (count[row] < self.words))
        row, whole = row[use], whole[use]
        order = np.lexsort((whole, row))
        row, whole = row[order], whole[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])]) if len(row) else np.zeros(0, bool)
        return row[new], whole[new]

    def least(self, n):
        """Size that a set must have at least to be linked with one of n, for ints and arrays."""
        return -(-self.part * n // self.of)

    def overlap(self, a, b):
        """Shingles that linked sets of these sizes share at least."""
        return -(-self.part * (a + b) // (self.part + self.of))

    def possible(self, n: str, pos: str, m: str, at: str) -> Column:
        """Length and positional filter, for columns: sizes n, m and positions of a shared shingle."""
        n_, pos_, m_, at_ = (F.col(c) for c in (n, pos, m, at))
        most = F.least(pos_, at_) + 1 + F.least(n_ - pos_ - 1, m_ - at_ - 1)
        return (F.least(n_, m_) * self.of >= F.greatest(n_, m_) * self.part) & (most * (self.part + self.of) >= (n_ + m_) * self.part)

    def missing(self, n: str, m: str) -> Column:
        """How many shingles two linked sets of sizes n and m share within both prefixes at least:
        behind its prefix, the set whose prefix ends first holds only so many more."""
        n_, m_ = F.col(n), F.col(m)
        need = F.ceil((n_ + m_) * self.part / (self.part + self.of))
        return need - F.greatest(F.lit(0), F.ceil(F.greatest(n_, m_) * self.part / self.of) - 1 - EXTRA)


def fingerprints(shingle: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, whatever the order of its shingles."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle ^ np.uint64(0x2545F4914F6CDD1D)))])
    return mix(sums[edge[1:]] - sums[edge[:-1]] + np.diff(edge).astype(np.uint64)).view(np.int64)


def nodes(docs: DataFrame, measure: Measure) -> tuple[DataFrame, np.ndarray]:
    """One pass over the texts: doc_id, n, node (fingerprint of the set) of every row, and the
    frequency sketch: in how many rows shingles of each of ``SKETCH`` classes are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "node", "bucket", "times"]
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for piece in slices(batch):
                row, shingle = measure.shingles(*text_buffer(piece.column(1)))
                counts += np.bincount((shingle >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
                n = np.bincount(row, minlength=piece.num_rows)
                node = fingerprints(shingle, np.searchsorted(row, np.arange(piece.num_rows + 1)))
                none = pa.nulls(piece.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array(node), none, none], names=names)
        hit = np.flatnonzero(counts)
        none = pa.nulls(len(hit), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(hit), pa.array(counts[hit])], names=names)

    both = staged(docs.mapInArrow(run, "doc_id long, n long, node long, bucket long, times long"), "nodes")
    sketch = np.zeros(SKETCH, np.int64)
    for b, t in both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("times")).collect():
        sketch[b] = t
    return both.where("n IS NOT NULL").select("doc_id", "n", "node"), sketch


def _ordered(measure: Measure, sketch: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and shingle, rare first within each row."""
    row, shingle = measure.shingles(data, offsets)
    often = sketch[(shingle >> np.uint64(40)).astype(np.int64) % SKETCH]
    order = np.lexsort((shingle, often, row))
    return row[order], shingle[order]


def prefixes(docs: DataFrame, measure: Measure, sketch: np.ndarray) -> DataFrame:
    """token, node, n, pos for the first shingles of every set; a set that a task has met
    already is passed by, so copies add little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for piece in slices(batch):
                row, shingle = _ordered(measure, sketch, *text_buffer(piece.column(1)))
                n = np.bincount(row, minlength=piece.num_rows)
                edge = np.searchsorted(row, np.arange(piece.num_rows + 1))
                node = fingerprints(shingle, edge)
                fresh = np.array([not (x in met or met.add(x)) for x in node.tolist()], bool)
                if len(met) > 1_000_000:
                    met.clear()
                pos = np.arange(len(row)) - edge[row]
                use = fresh[row] & (pos < (n - measure.least(n) + 1 + EXTRA)[row])
                r = row[use]
                yield pa.RecordBatch.from_arrays([pa.array(shingle[use].view(np.int64)), pa.array(node[r]), pa.array(n[r].astype(np.int32)), pa.array(pos[use].astype(np.int32))], names=["token", "node", "n", "pos"])

    return docs.mapInArrow(run, "token long, node long, n int, pos int")


def sets(docs: DataFrame, nodes_: DataFrame, reps: DataFrame, measure: Measure, sketch: np.ndarray) -> DataFrame:
    """node and its whole set (packed) for ``nodes_``; ``reps`` names a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                row, shingle = measure.shingles(*text_buffer(piece.column(1)))
                edge = np.searchsorted(row, np.arange(piece.num_rows + 1))
                same = fingerprints(shingle, edge) == np.asarray(piece.column(2))  # not so only where rows repeat a doc_id
                raw, edge = shingle.astype("<u8").tobytes(), edge.tolist()
                found = pa.RecordBatch.from_arrays([piece.column(2), pa.array([raw[8 * a : 8 * b] for a, b in zip(edge, edge[1:])], pa.binary())], names=["node", "set"])
                yield found.filter(pa.array(same))

    chosen = docs.join(reps.join(nodes_, "node"), "doc_id").select("doc_id", "text", "node")
    return chosen.mapInArrow(run, "node long, set binary")


def suffix_allows(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """Can two hash-sorted sets share ``need`` members? Split both at the middle of one: members
    on different sides never match."""
    most = min(len(x), len(y))
    if most < need or depth == 0 or most == 0:
        return most >= need
    pivot = x[len(x) // 2]
    i, j = len(x) // 2, int(np.searchsorted(y, pivot))
    left, right = min(i, j), min(len(x) - i, len(y) - j)
    if left + right < need:
        return False
    return suffix_allows(x[:i], y[:j], need - right, depth - 1) and suffix_allows(x[i:], y[j:], need - left, depth - 1)


def verified(pairs: DataFrame, known: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                need = measure.overlap(len(x), len(y))
                good.append(suffix_allows(x, y, need) and len(np.intersect1d(x, y, assume_unique=True)) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    with_u = pairs.join(known.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    both = with_u.join(known.select(F.col("node").alias("v"), F.col("set").alias("b")), "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long")


def links(docs: DataFrame, found: DataFrame, sketch: np.ndarray, measure: Measure) -> DataFrame:
    """node and root of all nodes that have a link."""
    spark = docs.sparkSession
    first = staged(prefixes(docs, measure, sketch), "prefixes")
    lists = first.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("token", (F.col("size") > CROWD).alias("crowded"), F.ceil(F.col("size") / LANE).alias("lanes"))
    posts = staged(first.join(lists, "token").dropDuplicates(["token", "node"]), "posts")
    discard(first)
    release_shuffles(spark)
    reps = found.groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def check(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        known = staged(sets(docs, ends, reps, measure, sketch), f"{name}-sets")
        release_shuffles(spark)
        out = staged(verified(pairs, known, measure), name)
        discard(known)
        release_shuffles(spark)
        return out

    # Leaders: of each list and length band, the smallest node; bands keep lengths comparable.
    band = F.floor(F.log(F.col("n")) / F.lit(log(measure.of / measure.part))).cast("int")
    banded = posts.withColumn("band", band)
    leader = banded.groupBy("token", "band").agg(F.min(F.struct("n", "node", "pos")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    met = banded.join(leader, ["token", "band"]).select("node", "n", "pos", F.col("lead.node").alias("m_node"), F.col("lead.n").alias("m"), F.col("lead.pos").alias("at"))
    met = met.where((F.col("node") != F.col("m_node")) & measure.possible("n", "pos", "m", "at"))
    shared = met.groupBy("node", "m_node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    # Other leaders may hold part of what a pair shares, so a third of it is enough here.
    best = shared.where(F.col("c") * 3 >= measure.missing("n", "m")).groupBy("node").agg(F.max(F.struct("c", "m_node")).alias("best"))
    leaders = staged(best.select(F.col("node").alias("u"), F.col("best.m_node").alias("v")), "leaders")
    stars = check(leaders, "stars")
    roots = components(stars)
    discard(leaders, stars)

    # Across: nodes of different components in one list. ``h`` is how many crowded lists a node is in.
    # ``s`` is how many of them begin with this one, in the order of shingles: sets that crowded
    # lists alone link share enough of them from their first common one on.
    whole = Window.partitionBy("node")
    rest = whole.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.col("crowded").cast("int")
    counted = staged(posts.withColumns({"h": F.sum(one).over(whole), "s": F.sum(one).over(rest)}), "counted-posts")
    discard(posts)
    release_shuffles(spark)

    def still_open(roots: DataFrame) -> DataFrame:
        """Lists in which several components meet, with the components."""
        labelled = counted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
        return staged(labelled.join(several, "token"), "open-posts")

    def joined_by(roots: DataFrame, more: DataFrame) -> DataFrame:
        """Components after more links: the stars of those before stand for the links that made them."""
        after = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
        discard(roots, more)
        return after

    # A crowd may be alike without being like its leader. So each node of a crowded list also
    # tries its neighbour in an order that differs from list to list, TRIES of them per round, as
    # long as that still joins a good part of the components that are left. This decides only how
    # soon links are found: the last step is exact whatever the rounds have left.
    open_, turn = still_open(roots), 0
    while True:
        turn += 1
        order = Window.partitionBy("token", F.pmod(F.xxhash64("node", F.lit(turn)), "lanes")).orderBy(F.xxhash64("node", "token", F.lit(turn)))
        beside = open_.where("crowded").withColumn("x", F.lead(F.struct(F.col("node").alias("v"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("h").alias("h2"), F.col("root").alias("root2"))).over(order))
        beside = beside.select(F.col("node").alias("u"), "n", "pos", "h", "root", "x.*").where((F.col("root") != F.col("root2")) & measure.possible("n", "pos", "m", "at") & (F.least("h", "h2") >= measure.missing("n", "m")))
        tried = beside.select("u", "v").distinct().withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))).where(F.col("k") <= TRIES)
        tried = staged(tried.select("u", "v"), "neighbours")
        asked = tried.select("u").distinct().count()
        if not asked:
            break
        joined = check(tried, "neighbour-links")
        few = joined.select("u").distinct().count() * 10 < asked
        roots = joined_by(roots, joined)
        discard(open_, tried)
        open_ = still_open(roots)
        release_shuffles(spark)
        if few:
            break
    discard(counted)
    member = open_.select("token", "crowded", "root", F.col("node").alias("u"), "n", "pos", "h", "s")
    other = open_.select("token", "crowded", F.col("root").alias("root2"), F.col("node").alias("v"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("h").alias("h2"), F.col("s").alias("s2"))
    fits = measure.possible("n", "pos", "m", "at")
    enough = F.least("s", "s2") >= measure.missing("n", "m")
    light = member.where("NOT crowded").join(other.where("NOT crowded").drop("crowded"), "token").where((F.col("root") < F.col("root2")) & fits)
    # In a crowded list only nodes meet that crowded lists alone could link: first their sizes,
    # then their components, then they themselves.
    sizes = open_.where("crowded").groupBy("token", "n").agg(F.max("s").alias("s"))
    sizes2 = sizes.select("token", F.col("n").alias("m"), F.col("s").alias("s2"))
    near = (F.col("n") <= F.col("m")) & (F.col("n") * measure.of >= F.col("m") * measure.part)
    spans = sizes.join(sizes2, "token").where(near & enough).select("token", "n", "m")
    groups = open_.where("crowded").groupBy("token", "n", "root").agg(F.max("s").alias("s"))
    groups2 = groups.select("token", F.col("n").alias("m"), F.col("root").alias("root2"), F.col("s").alias("s2"))
    meet = spans.join(groups, ["token", "n"]).join(groups2, ["token", "m"]).where((F.col("root") != F.col("root2")) & enough).select("token", "n", "root", "m", "root2")
    heavy = meet.join(member.where("crowded"), ["token", "n", "root"]).join(other.where("crowded").drop("crowded"), ["token", "m", "root2"]).where(fits & enough)
    columns = ["u", "v", "n", "m", "h", "h2", "crowded"]
    met = light.select(*columns).unionByName(heavy.select(*columns))
    c = F.count_if(~F.col("crowded")).alias("c")
    pairs = met.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(c, F.first("n").alias("n"), F.first("m").alias("m"), F.first("h").alias("h"), F.first("h2").alias("h2"))
    pairs = staged(pairs.where(F.col("c") + F.least("h", "h2") >= measure.missing("n", "m")).select("u", "v"), "pairs")
    discard(open_)
    more = check(pairs, "links")
    discard(pairs)
    return joined_by(roots, more)


def join(docs: DataFrame, measure: Measure) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every row.

    Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, with A-Z in lower case. A text of
    fewer words than a shingle is one shingle; null texts and texts without words have no
    shingle and link with nothing, as do rows with a null doc_id. Repeated rows have equal
    results; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = ids_and_texts(docs)
    found, sketch = nodes(docs, measure)
    real = found.where("n > 0 AND doc_id IS NOT NULL")
    roots = links(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), real, sketch, measure)
    each = real.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"))
    each = each.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = each.groupBy("root").agg(F.min("first").alias("component_id"))
    each = staged(each.join(smallest, "root").select("node", "component_id", "size"), "components")
    total = each.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    keyed = found.withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")))
    out = attach(keyed, each, "node", "size", total, "own", ("doc_id",))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("own.component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), Measure(words=3, part=90, of=100))
