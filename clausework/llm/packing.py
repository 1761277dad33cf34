"""Packing documents into fixed-size token windows by best-fit decreasing.

Every document is encoded whole, with an end id. Overlong ones are cut into full windows first; the
rest of each, shorter than a window, is packed best fit, longest first: a segment tree indexed by
remaining capacity finds the tightest open window in log(window) steps.

Rests are dealt round robin, so neither hot ids nor repeated rows can fill one task. Each task sorts
its share and packs it alone. A task keeps one number per open window; tasks are sized so that even
a window per rest fits. Per task at most a few windows stay part empty.

Defined results
  null or empty text    the end id alone
  null or repeated ids  every row is a document of its own
  ties                  equal lengths are taken by doc_id (null first), start, then checksum
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm import tokens
from clausework.llm.util import small_batches

WINDOW = 4096
END_ID = 2
# Documents per packing task: few tasks leave few part-empty windows, and a task holds a number each.
DOCS_PER_TASK = 100_000


class OpenWindows:
    """Open windows by remaining capacity; ``take(n)`` gives the tightest one with room for n."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.window = window
        # Leaf c counts the open windows with c ids left, an inner node those below it.
        self.count = [0] * (2 * self.half)
        self.ids: list[list[int]] = [[] for _ in range(self.half)]
        self.made = 0

    def _add(self, capacity: int, change: int) -> None:
        node = self.half + capacity
        while node:
            self.count[node] += change
            node >>= 1

    def _tightest(self, least: int) -> int | None:
        """Smallest capacity of at least ``least`` that is present."""
        node = self.half + least
        if self.count[node]:
            return least
        # Climb to the first right sibling with windows below it, then go down leftmost.
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.half:
            node = 2 * node + (not self.count[2 * node])
        return node - self.half

    def take(self, length: int) -> tuple[int, int]:
        """(window number, offset) for a piece of ``length``."""
        capacity = self._tightest(length)
        if capacity is None:
            number, capacity = self.made, self.window
            self.made += 1
        else:
            number = self.ids[capacity].pop()
            self._add(capacity, -1)
        left = capacity - length
        if left:
            self.ids[left].append(number)
            self._add(left, 1)
        return number, self.window - capacity


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
           window: int = WINDOW, keep_ids: bool = False, cache: int | None = None) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids, if kept).

    ``cache`` is the number of words a worker remembers the ids of, if not the default.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long"
    end = array("I", [end_id]).tobytes()
    step = 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, cache)
        for batch in batches:
            at, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for i, data in enumerate(encoder.encode_all(batch.column("text"))):
                data += end
                for first in range(0, len(data), step):
                    piece = data[first:first + step]
                    at.append(i)
                    starts.append(first // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(data) // 4)
                    if keep_ids:
                        ids.append(array("I", piece).tolist())
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())),
                "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": pa.array(totals, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    return small_batches(rows).mapInArrow(cut, schema + (", ids array<long>" if keep_ids else ""))


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID, window: int = WINDOW, keep_ids: bool = False,
         docs_per_task: int = DOCS_PER_TASK, cache: int | None = None) -> DataFrame:
    """Pieces with their place: the columns of ``pieces``, sequence_id and offset."""
    cut = pieces(docs, path or tokens.public_path(tokens.WORD_BPE), id_col, text_col, end_id, window, keep_ids, cache)
    tasks = max(1, -(-docs.count() // docs_per_task))
    # Round robin: Spark sorts the rows before dealing them, so a lost task is dealt the same again.
    dealt = cut.repartition(tasks).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = OpenWindows(window)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [windows.take(n) for n in batch.column("length").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["sequence_id"] = pa.array([first + number for number, _ in placed], pa.int64())
            columns["offset"] = pa.array([offset for _, offset in placed], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return dealt.mapInArrow(place, schema)
