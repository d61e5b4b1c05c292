"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become token ids plus one end id; those longer than a sequence are cut into whole
sequences, their first piece taking the remainder. Pieces are dealt to packing groups of a
bounded size. In a group best-fit decreasing gives a start; then the local search moves a
piece, exchanges one for one, or exchanges two for one between underfull sequences, always so
that the fuller sequence gains and the sum of squared fills grows, until no step gains or the
lower bound is met.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, byte_letters, default_vocabulary
from .common import ids_and_texts, slices, small_batches, staged

SEQUENCE = 2048
END_ID = 0
#: Pieces that one task packs; each group can waste a part of one sequence at most by the split.
GROUP = 25_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fast_encoder(vocabulary: str) -> Encoder:
    """An :class:`~offerloom.llm.bpe.Encoder` whose uncached pieces go to a compiled BPE library
    that holds the same merges as ranks; ids are those of the vocabulary file."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    letter, special = byte_letters(), {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(letter[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    library = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Encoder(vocabulary, of_piece=lambda piece: array("I", library.encode_ordinary(piece)).tobytes())


#: Fixed value: the split pattern in the library's own dialect.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cut(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    if n <= SEQUENCE:
        return [(0, n)]
    first = n % SEQUENCE or SEQUENCE
    return [(0, first), *((s, SEQUENCE) for s in range(first, n, SEQUENCE))]


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = fast_encoder(vocabulary), END_ID.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.encode(text or "") + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4)):
                        row = (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return ids_and_texts(docs).mapInArrow(run, PIECES)


class Bins:
    """Sequences of one group; ``items[b]`` lists the pieces of bin b."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit_decreasing(self) -> None:
        """Longest first, each into the fullest bin that still takes it."""
        open_by_room: dict[int, list[int]] = defaultdict(list)
        rooms = 0  # bit r is set if a bin with room r is open
        for i in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            need = self.sizes[i]
            fitting = rooms >> need
            if fitting:
                room = need + (fitting & -fitting).bit_length() - 1
                b = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += need
            room -= need
            if room:
                open_by_room[room].append(b)
                rooms |= 1 << room

    def _kind(self, b: int) -> tuple[int, ...]:
        """The sizes in a bin; bins of one kind offer the same steps."""
        return tuple(sorted(self.sizes[i] for i in self.items[b]))

    def local_search(self) -> None:
        """Empty the emptiest bins into the room of the others, while that is possible."""
        least = -(-sum(self.sizes) // self.capacity)
        used = sum(1 for f in self.fill if f)
        gained = True
        while gained:  # the sum of squared fills grows with each step, so this ends
            gained = False
            under = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: self.fill[b])
            alike: dict[tuple[int, ...], set[int]] = defaultdict(set)
            for b in under:
                alike[self._kind(b)].add(b)
            stuck: set[tuple[int, ...]] = set()
            for donor in under:
                while 0 < self.fill[donor] < self.capacity and used > least and (kind := self._kind(donor)) not in stuck:
                    if self._improve(donor, alike):
                        gained = True
                        used -= not self.items[donor]
                        stuck.clear()
                    else:
                        stuck.add(kind)

    def _improve(self, donor: int, alike: dict[tuple[int, ...], set[int]]) -> bool:
        """One step that lowers the donor's fill and raises a fuller bin's; False if none is.

        The step that fills a receiver most wins. Each step raises the sum of squared fills,
        because the receiver was at least as full as the donor.
        """
        sizes, low = self.sizes, self.fill[donor]
        best: tuple[int, int, list[int], list[int]] | None = None
        by_size: dict[int, list[int]] = defaultdict(list)
        for i in self.items[donor]:
            by_size[sizes[i]].append(i)
        ones = {n: held[:1] for n, held in by_size.items()}
        twos = {2 * n: held[:2] for n, held in by_size.items() if len(held) > 1}
        for n, held in by_size.items():
            for m, others in by_size.items():
                if n < m:
                    twos.setdefault(n + m, [held[0], others[0]])
        offers = [(sorted(group), group) for group in (ones, twos)]
        for bins in alike.values():
            b = next((x for x in bins if x != donor), None)
            if b is None or self.fill[b] < low:
                continue
            room = self.capacity - self.fill[b]
            returns = {0: [], **{sizes[j]: [j] for j in self.items[b]}}  # nothing (a move) or one piece
            for back, piece in returns.items():
                for totals, group in offers if back else offers[:1]:
                    k = bisect_right(totals, back + room) - 1  # the most that fits
                    if k >= 0 and totals[k] > back and (best is None or totals[k] - back - room > best[0]):
                        best = (totals[k] - back - room, b, group[totals[k]], piece)
            if best and best[0] == 0:
                break
        if best is None:
            return False
        _, b, out, back = best
        for x in (donor, b):
            alike[self._kind(x)].discard(x)
        for i in out:
            self.items[donor].remove(i)
            self.items[b].append(i)
        for j in back:
            self.items[b].remove(j)
            self.items[donor].append(j)
        moved = sum(sizes[i] for i in out) - sum(sizes[j] for j in back)
        self.fill[donor] -= moved
        self.fill[b] += moved
        for x in (donor, b):
            if 0 < self.fill[x] < self.capacity:
                alike[self._kind(x)].add(x)
        return True


def place(sizes: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Bins of piece numbers for the given sizes (1 to capacity)."""
    bins = Bins(sizes, capacity)
    bins.best_fit_decreasing()
    bins.local_search()
    return [b for b in bins.items if b]


def pack(found: DataFrame, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length``.

    Rows are dealt to groups in turn, by the number of the row, so no key, source or repeated row
    can crowd a group; each task holds about ``group`` rows whatever the table's size. Ties
    between equal lengths go either way. Repeated rows are packed like any others, a document of
    any length is cut beforehand, and an empty table gives an empty result.
    """
    found = staged(found, "pieces")
    groups = max(1, -(-found.count() // group))
    dealt = found.repartitionById(groups, F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")) if groups > 1 else found.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        sizes = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        first = TaskContext.get().partitionId() << 40
        for b, bin_ in enumerate(place(sizes)):
            at = 0
            for i in bin_:
                sequence[i], offset[i] = first + b, at
                at += sizes[i]
        table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=50_000)

    return dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, default_vocabulary()))
