"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints, so a grid range-join on the
embeddings finds every link: with the coordinates dealt into B blocks, two embeddings within
distance R differ in at most R blocks, hence share a grid cell over some B - R whole blocks. Each
distinct fingerprint enters one cell per choice of blocks; members of a cell are compared by the
Manhattan bound first, then exactly.

Copies meet before any shuffle, as only distinct fingerprints enter the grid. A cell with too many
members is split into chunks, and every two chunks meet in a task of their own, so no task holds an
unbounded cell. Inside a task links are reduced to one edge per member: members reached once leave
the search, so a dense group costs little more than its size. Components of the remaining edges
come from rounds of minimum labels and pointer jumping, each cut by a checkpoint.

Defined results
  null or empty text    fingerprint zero, linked like any other
  fewer words           the whole word sequence is the only shingle
  null doc_id           gets its component; never names it unless all members are null
  repeated rows         are linked to one another
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import bounded, checkpointed, drop_rows, plain_names, small_batches, text_key

SHINGLE, SEED, DISTANCE = 4, 42, 4
# Members of a cell that one task compares; larger cells are split.
CELL = 4096
# Up to this size all pairs of a cell are tried at once with those of other cells.
SMALL = 48
# Shingles counted at a time.
STRIDE = 1 << 16
_EVEN_BITS = 0x5555555555555555


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()  # bytes methods: ASCII only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), STRIDE):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at:at + STRIDE], ends[at:at + STRIDE], strict=True)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (hash of the text) and fp, the fingerprint as a signed long."""
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("doc_id"), text_key(text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": pa.array(fps.view(np.int64)),
            })

    return small_batches(rows).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks over the packed embedding, one per choice of ``blocks - distance`` blocks."""
    dealt = [0] * blocks
    for segment in range(32):
        dealt[segment * blocks // 32] |= 3 << (2 * segment)
    return [sum(dealt[b] for b in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def grid(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(cell, fp): every distinct fingerprint in one cell per choice of blocks."""
    # More blocks make finer cells and more choices; any number gives the same links.
    blocks = distance + (2 if n < 1 << 22 else 3 if n < 1 << 26 else 4)
    # Bit count of every two-bit segment, in place: low bit by exclusive or, high bit by and.
    fp, next_bit = F.col("fp"), F.shiftrightunsigned("fp", 1)
    packed = fp.bitwiseXOR(next_bit).bitwiseAND(_EVEN_BITS).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(_EVEN_BITS), 1)
    )
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(block_masks(blocks, distance))])
    return (
        fps.select("fp", packed.alias("packed"), F.explode(masks).alias("c"))
        .select(F.xxhash64("c.i", F.col("packed").bitwiseAND(F.col("c.m"))).alias("cell"), "fp")
    )


def split_cells(cells: DataFrame, limit: int = CELL) -> DataFrame:
    """Cells over ``limit`` members replaced by one cell for every two of their chunks."""
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
    large = checkpointed(sizes.filter(F.col("members") > limit))
    if not large.take(1):
        return cells
    large = bounded(large)
    chunks = F.ceil(F.col("members") / (limit // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), chunks).cast("int")
    parts = (
        cells.join(large, "cell").withColumns({"chunks": chunks, "own": own})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("other <> own")
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    )
    return cells.join(large, "cell", "left_anti").unionByName(parts)


class _Forest:
    """Joins numbers into sets named by their smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _near(a: np.ndarray, b, distance: int) -> np.ndarray:
    """Which fingerprints are within ``distance``: the Manhattan bound first, then exactly."""
    even = np.uint64(_EVEN_BITS)
    pa_, pb = (a & even) + (a >> np.uint64(1) & even), (b & even) + (b >> np.uint64(1) & even)
    # Per two-bit segment: |difference| of counts 0..2; 1 and 3 mod 4 are distance one, 2 is two.
    low, high = pa_ ^ pb, np.uint64(0xAAAAAAAAAAAAAAAA)
    one, two = low & even, (low & high) >> np.uint64(1)
    bound = np.bitwise_count(one) + 2 * np.bitwise_count(two & ~one)
    near = bound <= distance
    near[near] = np.bitwise_count((a[near] if np.ndim(a) else a) ^ (b[near] if np.ndim(b) else b)) <= distance
    return near


def link_sorted(cell: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """(member, smallest linked member) per cell, of rows sorted by cell."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    forest = _Forest()
    # Small cells, all at once: every row against the one ``step`` rows on.
    left = np.repeat(np.where(sizes <= SMALL, sizes, 0), sizes) - (np.arange(len(cell)) - np.repeat(starts, sizes))
    at, step = np.flatnonzero(left > 1), 1
    while len(at):
        hit = at[_near(fp[at], fp[at + step], distance)]
        for i in hit:
            forest.join(int(fp[i]), int(fp[i + step]))
        step += 1
        at = at[left[at] > step]
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        # Breadth first; whatever has been reached is not compared again.
        rest = fp[s:s + n]
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            root = int(todo[0])
            while todo and len(rest):
                near = _near(rest, todo.pop(), distance)
                found, rest = rest[near], rest[~near]
                todo.extend(found)
                for x in found:
                    forest.join(root, int(x))
    for x in forest.up:
        if (root := forest.find(x)) != x:
            yield x, root


def links(cells: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) edges, b < a as unsigned numbers, that connect whatever is linked within some cell."""
    ordered = cells.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(cell, fp):
            pairs = np.array(list(link_sorted(cell, fp, distance)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(cell):
                continue
            # The last cell may go on in the next batch.
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                held.append((cell[:cut], fp[:cut]))
                yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((cell[cut:], fp[cut:]))
            if held[0][0][0] != cell[-1]:
                yield emit(*(np.concatenate(x) for x in zip(*held[:-1], strict=True)))
                held = held[-1:]
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return ordered.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (a, b)."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("offer"))
        hooked = labels.join(offered, labels["node"] == offered["a"]).select(
            "node", F.col("root").alias("old"), F.least("root", "offer").alias("root")
        )
        hooked = checkpointed(hooked)
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = checkpointed(hooked.join(above, "root").select("node", "old", F.least("root", "top").alias("root")))
        labels = jumped.select("node", "root")
        if not jumped.filter("root <> old").take(1):
            return labels


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """One row per document: doc_id, key (hash of the text), fp, root (fingerprint that names the group), component_id."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    cells = split_cells(grid(fps, fps.count(), distance), cell)
    roots = components(checkpointed(links(cells, distance)))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(heads, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint in hex, component_id (smallest doc_id reachable)."""
    return grouped(docs, id_col, text_col, shingle, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that with the smallest id; all columns kept."""
    names = docs.columns
    docs, (id_col, text_col) = plain_names(docs, id_col, text_col)
    found = checkpointed(grouped(docs, id_col, text_col).select("doc_id", "key", "root"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    heads = found.groupBy("root").agg(F.min(rank).alias("head"))
    texts = found.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    marked = checkpointed(texts.join(heads, "root").select(
        F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), "n", (rank == F.col("head")).alias("stays")
    ))
    gone, twice = marked.filter("not stays").select("__doc", "__key"), marked.filter("stays and n > 1").select("__doc", "__key")
    keyed = docs.withColumns({"__doc": F.col(id_col), "__key": text_key(F.col(text_col))})
    return drop_rows(keyed, gone, twice).toDF(*names)
