"""Exact duplicates by an extendible-hash index on shared files.

One pass over the texts leaves a narrow row per document: 64-bit hash and SHA-256 of the normalised
text. Copies are combined before any shuffle, so a text with a billion copies is one index entry per
map task. A directory over the leading hash bits starts with one slot and doubles until no bucket
holds more than its capacity; each bucket's entries go to one owner task, which writes them sorted
to the shared folder. Where a hash has several rows, the owners compare the texts byte for byte
(the text is the grouping key, combined map-side), and texts that merely share a hash form a chain.

Defined results
  null text             the empty text; all empty texts are copies of one another
  null doc_id           sorts after every number; such a row stays only if its group has no number
  repeated rows         copies like any others; exactly one of them stays
  empty table           no rows
  other columns         ignored, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import SPACE, bounded, checkpointed, drop_rows, plain_names, scratch_path

# Leading hash bits a directory may use: 2^18 slots, 4 MB when broadcast.
DIRECTORY_BITS = 18
BUCKET_ENTRIES = 512


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _hashed(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    texts = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("norm"))
    h = F.xxhash64("norm")
    # Fewer bits only serve tests: they force different texts into one chain.
    h = h if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)
    return texts.withColumn("h", h)


def directory(counts: dict[int, int], capacity: int, bits: int = DIRECTORY_BITS) -> list[tuple[int, int]]:
    """(slot, bucket) of every occupied slot, from entries per slot of the finest directory.

    A bucket is a prefix of the slot number; it splits in two, doubling the directory where its
    depth was the whole depth, while it is overfull and bits are left.
    """
    out, todo, bucket = [], [(0, sorted(counts))], 0
    while todo:
        depth, slots = todo.pop()
        if depth < bits and sum(counts[s] for s in slots) > capacity:
            bit = 1 << (bits - depth - 1)
            halves = [s for s in slots if not s & bit], [s for s in slots if s & bit]
            todo += [(depth + 1, half) for half in halves if half]
            continue
        out += [(s, bucket) for s in slots]
        bucket += 1
    return out


def build_index(rows: DataFrame, path: str, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """Write the index of hashed rows (doc_id, row, h, text_sha256) to ``path`` and read it back."""
    spark = rows.sparkSession
    entries = checkpointed(
        rows.groupBy("h", "text_sha256").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"),
            F.count(F.lit(1)).alias("group_size"),
        ).withColumn("slot", F.shiftrightunsigned("h", 64 - DIRECTORY_BITS).cast("int"))
    )
    # One number per occupied slot: at most 2^DIRECTORY_BITS rows reach the driver.
    counts = {r.slot: r["count"] for r in entries.groupBy("slot").count().toLocalIterator()}
    capacity = max(bucket_entries, 4 * sum(counts.values()) >> DIRECTORY_BITS)
    slots = spark.createDataFrame(directory(counts, capacity), "slot int, bucket int")
    (
        entries.join(F.broadcast(slots), "slot").repartition("bucket").sortWithinPartitions("bucket", "h")
        .select("bucket", "h", "text_sha256", F.col("head.doc_id").alias("keep_id"),
                F.col("head.row").alias("keep_row"), "group_size")
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def compared(hashed: DataFrame, index: DataFrame) -> DataFrame:
    """Chains of the hashes that several rows share: one link (h, text_sha256, size) per distinct text."""
    shared = index.groupBy("h").agg(F.sum("group_size").alias("n")).filter("n > 1").select("h")
    again = hashed.join(bounded(shared), "h", "left_semi")
    return again.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("size")).select(
        "h", F.sha2("norm", 256).alias("text_sha256"), "size"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64,
                     bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = _hashed(docs, id_col, text_col, hash_bits)
    rows = checkpointed(
        hashed.select("doc_id", F.monotonically_increasing_id().alias("row"), "h", F.sha2("norm", 256).alias("text_sha256"))
    )
    index = build_index(rows, scratch_path(docs.sparkSession, "exact-index"), bucket_entries)
    # The digest names a text; the byte comparison has to agree with it link by link.
    links = compared(hashed, index)
    split = links.groupBy("h", "text_sha256").agg(F.count(F.lit(1)).alias("texts"))
    if split.filter("texts > 1").take(1):
        raise RuntimeError("two different texts share a SHA-256")
    found = rows.join(index.drop("bucket"), ["h", "text_sha256"])
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    names = docs.columns
    docs, (id_col, text_col) = plain_names(docs, id_col, text_col)
    found = checkpointed(exact_duplicates(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"))
    pairs = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = checkpointed(pairs.select(F.col("doc_id").alias("__doc"), F.col("text_sha256").alias("__sha"), "stays", "n"))
    gone, twice = marked.filter("not stays").select("__doc", "__sha"), marked.filter("stays and n > 1").select("__doc", "__sha")
    keyed = docs.withColumns({"__doc": F.col(id_col), "__sha": F.sha2(normalised(F.col(text_col)), 256)})
    return drop_rows(keyed, gone, twice).toDF(*names)
