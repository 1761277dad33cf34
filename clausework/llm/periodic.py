r"""Periodic run detection by seed-and-extend on diagonals.

A run is a stretch of consecutive words with smallest period q that is at least ``exponent`` (4)
periods and ``min_length`` words long and that no neighbouring word extends. It lies on the diagonal
of lag q: its words equal those q places on.

Lags are taken in classes [2^j, 2^(j+1)). A run of such a period repeats at least 3 q >= 3 * 2^j words
at its lag, the guaranteed overlap, so its first 3 * 2^j words are a seed: a k-gram that occurs again
q words later (lag 1 overlaps by five words, as runs have six). k-grams of one class are indexed per
document, and an occurrence is paired with the next one of the same document. That is enough: as the
k-gram is longer than q, an occurrence in between would give the run a shorter period. Pairs are thus
linear in the text however often a k-gram occurs. A pair is extended to both sides unless the table
of its lag says that its place is covered already; the table then moves on to the end of the
extension. What is extended has its lag as smallest period, so lengths decide what is kept.

All documents of an Arrow batch are worked on together as one row of word codes. Most have no
repeated seed of five words and are done with after one sort; longer k-grams are looked for only
where the next shorter ones repeat. Documents never leave their task.

Defined results
  null or empty text    no words, no runs, empty collapsed text
  null doc_id           kept; ``planted`` leaves its text as it is
  repeated rows         one row each
  very long texts       time n log n in the words of a text, memory linear in them
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import WORD, small_batches

MIN_LENGTH, EXPONENT = 6, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where every tenth document by crc32 of its id turns periodic from some word on.

    With h the crc32 of the id, g = h / 10 and n words, word i >= a = g % n becomes word a + (i - a) % p,
    p = 1 + (n - a) / (3 + g % 8), whenever h is a multiple of ten.
    """
    doc_id, text = docs[id_col], docs[text_col]
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.crc32(doc_id.cast("string").cast("binary")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    g, n = F.expr("h div 10"), F.size("words")
    a = F.when(n > 0, F.expr("g % size(words)")).cast("int")
    p = F.expr("1 + (n - a) div (3 + g % 8)").cast("int")
    cut = rows.withColumn("words", words).withColumns({"g": g, "n": n}).withColumn("a", a).withColumn("p", p)
    # The period as often as it fits, then its beginning.
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    times, rest = F.expr("cast((n - a) div p AS int)"), F.expr("cast((n - a) % p AS int)")
    parts = F.array(
        F.array_join(F.slice("words", F.lit(1), F.col("a")), " "),
        F.repeat(F.concat(F.array_join(period, " "), F.lit(" ")), times),
        F.array_join(F.slice("words", F.col("a") + 1, rest), " "),
    )
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(parts, " ")).otherwise(F.col("text")).alias("text"))


def _next_in_group(place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, next place) of neighbouring members of equal groups, of ascending places."""
    order = np.argsort(group, kind="stable")
    place, group = place[order], group[order]
    same = group[1:] == group[:-1]
    return place[:-1][same], place[1:][same]


def _repeated(place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of the members whose key occurs more than once; equal numbers are equal keys."""
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[number] > 1
    return place[again], number[again]


def _pair(place: np.ndarray, number: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated grams, each made of a live gram and the live gram ``gap`` words on."""
    if not len(place):
        return place, number
    at = np.searchsorted(place, place + gap)
    at[at == len(place)] = 0
    both = place[at] == place + gap
    return _repeated(place[both], number[both] * (int(number.max()) + 1) + number[at[both]])


def _seeds(codes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of the k-grams that occur more than once in their document."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # By hash first: what is alone in it is alone.
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    h = doc[:n].astype(np.uint64)
    for i in range(k):
        h = (h * _MIX + mixed[i:i + n]) * np.uint64(0xBF58476D1CE4E5B9)
    place = np.flatnonzero(doc[:n] == doc[k - 1:])
    h = h[place]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    place = place[twice[at] == h]
    # Then exactly, word by word.
    number = doc[place].astype(np.int64)
    for i in range(k):
        place, number = _repeated(place, number * (int(codes.max()) + 1) + codes[place + i])
    return place, number


def _reach(codes: np.ndarray, at: int, lag: int, step: int, bound: int) -> int:
    """How far from ``at``, going by ``step``, words equal those ``lag`` on; ``bound`` is the first place not looked at."""
    size = 16
    while at != bound:
        end = min(at + size, bound) if step > 0 else max(at - size, bound)
        here = np.arange(at, end, step)
        differ = codes[here] != codes[here + lag]
        if differ.any():
            return at + step * int(differ.argmax())
        at, size = end, size * 4
    return at


def runs_of(codes: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period; texts are codes[starts[i]:starts[i + 1]]."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found = []
    lag, k = 1, MIN_LENGTH - 1
    place, number = _seeds(codes, doc, k)
    while len(place):
        a, b = _next_in_group(place, number)
        inside = (b - a >= lag) & (b - a < 2 * lag)
        a, step = a[inside], (b - a)[inside]
        order = np.lexsort((a, step))
        a, step = a[order], step[order]
        at = 0
        covered: dict[int, int] = {}  # per lag, up to where its diagonal has been covered
        while at < len(a):
            d, i = int(step[at]), int(a[at])
            if i >= covered.get(d, -1):
                low, high = int(starts[doc[i]]), int(starts[doc[i] + 1])
                left = _reach(codes, i - 1, d, -1, low - 1) + 1 if i > low else i
                right = _reach(codes, i + k, d, 1, high - d)
                covered[d] = right
                if right + d - left >= max(min_length, EXPONENT * d):
                    found.append((left, right + d - left, d))
            # On to the first seed of the lag that is not covered.
            last = int(np.searchsorted(step, d, "right"))
            at += max(1, int(np.searchsorted(a[at:last], covered[d])))
        # The next class: grams of 3 * 2^j words from repeated shorter ones.
        lag *= 2
        gap = 1 if lag == 2 else k  # six words are two times five that overlap
        place, number = _pair(place, number, gap)
        k += gap
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of every text: maximal stretches without ASCII white space."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = cut.flatten()
    kept = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if kept.all():
        return pa.ListArray.from_arrays(pa.array(np.asarray(cut.offsets) - cut.offsets[0].as_py(), pa.int32()), flat)
    sums = np.concatenate([[0], np.cumsum(kept)])
    offsets = sums[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(kept)))


def _collapsed(flat: pa.Array, starts: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Every text's words joined by one blank, without those that a run holds after its first period."""
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[starts]
    words = flat if kept.all() else flat.filter(pa.array(kept))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; in words from 0), collapsed text."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"min_length must be {MIN_LENGTH} at least")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = words_of(batch.column("text"))
            flat, starts = lists.values, np.asarray(lists.offsets).astype(np.int64)
            codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = runs_of(codes, starts, min_length)
            doc = np.searchsorted(starts, runs[:, 0], "right") - 1
            fields = [pa.array(x) for x in (runs[:, 0] - starts[doc], runs[:, 1], runs[:, 2])]
            items = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            offsets = np.searchsorted(doc, np.arange(len(starts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items),
                 _collapsed(flat, starts, runs)],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return small_batches(rows).mapInArrow(run, schema)


def _sharper(a: Column, b: Column) -> Column:
    """Whether run ``b`` has the greater length in periods, compared exactly."""
    return b["length"] * a["period"] > a["length"] * b["period"]


def run_digest(found: DataFrame) -> DataFrame:
    """n_runs, the run of greatest length in periods, and hashes of all runs and of the collapsed text."""
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(_sharper(a, b), b).otherwise(a))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    return found.withColumns({"best": best, "lines": lines}).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
