"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.session import checkpointed, scratch_path  # noqa: F401  (re-exported)

# ASCII white space of the contracts: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Rows of a few numbers each that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    Counts ``df``, so pass something cheap to recompute, such as a checkpointed table of narrow rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def plain_names(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named by place, so that no helper column can clash, and what ``names`` are called there.

    ``toDF(*docs.columns)`` gives the names back.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*plain), [plain[docs.columns.index(n)] for n in names]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def match(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on equally named columns; the right side's copies of them are dropped."""
    mine = {n: f"__right_{n}" for n in names}
    renamed = right.withColumnsRenamed(mine)
    on = F.lit(True)
    for n, r in mine.items():
        on = on & F.col(n).eqNullSafe(F.col(r))
    return left.join(renamed, on, how).drop(*mine.values())


def text_key(text: Column) -> Column:
    """A hash that, next to the row's id, tells its text from others; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_rows(keyed: DataFrame, gone: DataFrame, twice: DataFrame) -> DataFrame:
    """``keyed`` without the rows named in ``gone``, and with one row of each named in ``twice``.

    Both name rows by all their columns, which ``keyed`` has too and which are dropped from the result.
    """
    names = gone.columns
    left = match(keyed, bounded(gone), names, "left_anti")
    if twice.take(1):  # the same id and text more than once
        small = bounded(twice)
        again = match(left, small, names, "left_semi").dropDuplicates(names)
        left = match(left, small, names, "left_anti").unionByName(again)
    return left.drop(*names)


# Rows and bytes of an Arrow batch of documents; the session's own limits hold where they are lower.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(texts: DataFrame) -> DataFrame:
    """``texts``, with the session's Arrow batches limited: rows of whole texts are wide.

    A task holds several copies of a batch, in the JVM and in Python.
    """
    conf = texts.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return texts
