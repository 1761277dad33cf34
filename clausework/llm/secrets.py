"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three base patterns give spans per document, and a fourth, wider one gives candidates: long runs of
key-like characters with letters and digits. Every candidate value is hashed and counted over the
whole corpus by distinct repositories and owners. A value of one owner in few repositories is taken as
live; one of several owners, or in many repositories whoever owns them, as a copied example. Live
values of the wide pattern that overlap no base span are added as spans of kind ``owned``; base spans
always stay.

Hits are rows: offsets are running sums over a text's gaps and hits, overlaps are found by what runs
up to a span and what follows it, so a text costs time in proportion to its hits (and their sorting).
Counting is map-side combined in three steps, (value, owner, repository), (value, owner), (value),
so a key pasted into a third of all documents costs one row per map task.

Defined results
  null text             the empty text: no spans
  null owner            an owner of its own
  null or repeated ids  every row is scanned on its own; equal ids count as one repository
  ties                  spans are ordered by start, then kind as listed in KINDS
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm.util import checkpointed

KINDS = ("assign", "access", "hex", "owned")
# The base patterns. A run pattern with a minimal length finds the same spans as the
# bare run followed by a length filter; the assignment keeps its short values until filtered, as
# those use up text.
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
# The wide pattern.
OWNED = r"[A-Za-z0-9+/_-]{20,}"
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
PATTERNS = (ASSIGN, ACCESS, HEX, OWNED)  # by kind


def _digest(spans_: Column) -> Column:
    named = F.transform(spans_, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    ))
    return F.array_join(named, ",")


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Rows without texts: row, doc_id, owner and, by kind, the hits and the lengths of the gaps before them (null: none)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[owner_col].alias("owner"), text.alias("text"))

    def found(pattern: str) -> Column:
        gaps = F.transform(F.split("text", pattern, -1), lambda gap: F.length(gap))
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.when(F.col("text").rlike(pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit")))

    every = [found(pattern).alias(kind) for kind, pattern in zip(KINDS, PATTERNS, strict=True)]
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", *every)


def spans(scanned: DataFrame) -> DataFrame:
    """One row per span (row, doc_id, owner, kind, start, end, value): base ones, and wide ones that overlap none."""
    # By kind, so that no exploded row carries an array along.
    hits = reduce(DataFrame.unionByName, [
        scanned.select("row", "doc_id", "owner", F.lit(kind).alias("kind"), F.posexplode(name).alias("pos", "pair"))
        for kind, name in enumerate(KINDS)
    ])
    length = F.length("pair.hit").cast("long")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # Behind the last hit is a gap without one.
    placed = hits.filter("pair.hit IS NOT NULL").withColumn("end", F.sum(F.col("pair.gap") + length).over(upto)).select(
        "row", "doc_id", "owner", "kind", (F.col("end") - length).alias("start"), "end",
        F.when(F.col("kind") == 0, F.regexp_extract("pair.hit", ASSIGN, 2)).otherwise(F.col("pair.hit")).alias("value"),
    )
    wide = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    kept = placed.filter(F.when(F.col("kind") == 0, F.length("value") >= ASSIGN_LENGTH).when(F.col("kind") == 3, wide).otherwise(True))
    # Of spans that start at one place, the wide one is last.
    so_far, base = (Window.unboundedPreceding, 0), F.col("kind") < 3
    reached = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", "kind").rowsBetween(*so_far))
    # Backwards, as a frame up to the end would be gone through anew for every row.
    backwards = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    after = F.min(F.when(base, F.col("start"))).over(backwards.rowsBetween(*so_far))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return kept.withColumns({"reached": reached, "after": after}).filter(base | free).drop("reached", "after")


def ownership(candidates: DataFrame) -> DataFrame:
    """n_repositories and n_owners of every candidate hash."""
    return (
        candidates.groupBy("hash", "owner", "doc_id").agg(F.count(F.lit(1)))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per document: doc_id, all spans with values in order, base ones alone, live and example values."""
    scanned = checkpointed(scan(docs, id_col, text_col, owner_col))
    found = checkpointed(spans(scanned).withColumn("hash", F.md5("value")))
    counted = ownership(found.select("hash", "owner", "doc_id"))
    many = F.col("n_repositories") >= example_repositories
    judged = counted.select(
        "hash", ((F.col("n_owners") == 1) & ~many).alias("live"), ((F.col("n_owners") >= example_owners) | many).alias("example")
    )
    span = F.struct("start", "kind", "end", "value")
    per_row = found.join(judged, "hash").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"),
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), span))).alias("spans"),
        F.collect_set(F.when(F.col("live"), F.col("hash"))).alias("live"), F.collect_set(F.when(F.col("example"), F.col("hash"))).alias("examples"),
    )
    none = F.array()
    return scanned.select("row", "doc_id", "owner").join(per_row, "row", "left").select(
        "doc_id", "owner", *[F.coalesce(c, none.cast(per_row.schema[c].dataType)).alias(c) for c in ("base", "spans", "live", "examples")]
    )


def secret_digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_secrets`` rows."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("examples").cast("long").alias("n_examples"),
    )
