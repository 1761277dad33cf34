"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to a few symbols. A word's reduced form is its row of symbols, and two words that
differ by one inserted, deleted or replaced letter have reduced forms that are equal or differ by one
symbol. So the full one-edit neighbourhood of every distinct reduced word is generated (a few symbols
make it some ten times smaller than over all letters), joined with the reduced vocabulary, and what
is found is verified on the original words.

A reduced word is carried as a 64-bit polynomial hash of its symbols: a neighbour's hash then follows
from the hashes of what is left and right of the edit, without spelling the neighbour out, so a word
of L letters costs numbers in proportion to L and no text. Words with equal hashes only meet more
candidates; the verification decides. The number of symbols grows slowly with the vocabulary, so that
a reduced word keeps standing for few words; any number gives the same result.

Only the vocabulary (distinct words) is ever compared: occurrences are counted with a map-side
combine first, so frequent words and copied documents cost nothing here.

Defined results
  null or empty text    no words
  null doc_id           as an empty id in the hash that chooses slips
  repeated rows         every row counts
  very long words       as any other
  ties                  the form of largest n, then first in code-point order
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import bounded, checkpointed

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
# Fixed value: of the contract's runs, one in so many loses a code point.
SLIP = 199
# Length of a common word, for which the reduced forms should outnumber the vocabulary.
COMMON = 8
# Neighbours held by a task at a time.
HELD = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = 0) -> DataFrame:
    """(word, n): maximal runs of ``letters``, A-Z in lower case, of the lengths and counts asked for.

    With ``slip``, a run whose crc32 next to its document's id is a multiple of it loses one code point.
    """
    lowered = F.translate(docs[text_col], _UPPER, _LOWER)
    # A run has at least as many code points as the word it becomes.
    runs = F.regexp_extract_all(lowered, F.lit(f"[{letters}]{{{min_length},}}"), F.lit(0))
    words = docs.select(docs[id_col].cast("string").alias("doc"), F.explode(runs).alias("word"))
    if slip:
        h = F.crc32(F.concat(F.coalesce("doc", F.lit("")), F.lit(":"), "word").cast("binary"))
        cut = F.pmod("h", F.char_length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), cut), F.substring("word", cut + 2, F.char_length("word")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("word")).alias("word"))
        words = words.filter(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def reduced(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of symbols from 1) for the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, HELD // max(1, length))
        for at in range(0, len(places), step):
            some = places[at:at + step]
            codes = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), np.uint32).astype(np.uint64)
            mixed = (codes * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(symbols) + np.uint64(1)
            yield some, mixed.reshape(len(some), length)


def _powers(length: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(length, _BASE))])


def _prefixes(rows: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, … symbols of each row."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    for i in range(rows.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + rows[:, i]
    return out


def keys_of(words: list[str], symbols: int) -> np.ndarray:
    """The hash of every word's reduced form."""
    out = np.zeros(len(words), np.uint64)
    for places, rows in reduced(words, symbols):
        out[places] = rows @ _powers(rows.shape[1])[:-1][::-1]
    return out


def neighbours(rows: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every string within one edit of each row of symbols, the row itself included, each once."""
    m, length = rows.shape
    power, before = _powers(length + 1), _prefixes(rows)
    place = power[:length + 1][::-1]  # weight of what stands before position i, with everything from i on behind it
    after = before[:, -1:] - before * place  # hash of the symbols from i on
    number = np.arange(m)
    yield number, before[:, -1]
    step = max(1, HELD // (m * symbols))
    for at in range(0, length + 1, step):
        end = min(length, at + step)
        here, rest = rows[:, at:end], after[:, at + 1:end + 1]
        weight = place[at + 1:end + 1]
        # Deletions: of a run of one symbol, the first.
        first = np.ones(here.shape, bool)
        left = max(at, 1)
        first[:, left - at:] = rows[:, left:end] != rows[:, left - 1:end - 1]
        hashes = before[:, at:end] * weight + rest
        yield np.broadcast_to(number[:, None], first.shape)[first], hashes[first]
        for c in map(np.uint64, range(1, symbols + 1)):
            other = here != c
            hashes = (before[:, at:end] * _BASE + c) * weight + rest
            yield np.broadcast_to(number[:, None], other.shape)[other], hashes[other]
            # Insertions before a position, other than of the symbol that stands there, and at the end.
            upto = min(length + 1, at + step)
            free = np.ones((m, upto - at), bool)
            free[:, :end - at] = other
            hashes = (before[:, at:upto] * _BASE + c) * place[at:upto] + after[:, at:upto]
            yield np.broadcast_to(number[:, None], free.shape)[free], hashes[free]


def _keyed(vocab: DataFrame, symbols: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column("word").to_pylist(), symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], [*batch.schema.names, "key"])

    return vocab.mapInArrow(run, "word string, n long, key long")


def _neighbour_keys(words: DataFrame, symbols: int) -> DataFrame:
    """(key, near): every reduced word's hash with the hashes of its neighbourhood, from one word that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, keys = batch.column("word").to_pylist(), batch.column("key").to_numpy()
            for places, rows in reduced(words, symbols):
                some = max(1, HELD // (2 * symbols * (rows.shape[1] + 1)))
                for at in range(0, len(places), some):
                    own = keys[places[at:at + some]]
                    for number, near in neighbours(rows[at:at + some], symbols):
                        yield pa.RecordBatch.from_arrays([pa.array(own[number]), pa.array(near.view(np.int64))], ["key", "near"])

    return words.mapInArrow(run, "key long, near long")


def symbols_for(words: int) -> int:
    """So many symbols that common words have a few times more reduced forms than there are words."""
    return max(4, int(np.ceil((4 * words) ** (1 / COMMON))))


def near_words(vocab: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, near, near_n): all pairs of ``vocab`` (word, n) one edit apart, in both directions."""
    vocab = checkpointed(vocab.select("word", F.col("n").cast("long").alias("n")))
    symbols = symbols or symbols_for(vocab.count())
    keyed = checkpointed(_keyed(vocab, symbols))
    forms = keyed.groupBy("key").agg(F.min("word").alias("word"))
    known = checkpointed(forms.select(F.col("key").alias("near")))
    found = _neighbour_keys(forms, symbols).join(bounded(known), "near", "left_semi")
    # Two neighbours of one hash would name the same pair twice.
    pairs = found.repartition("key").dropDuplicates(["key", "near"])
    ours = pairs.join(keyed, "key").select("near", "word", "n")
    theirs = keyed.select(F.col("key").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    close = F.levenshtein("word", "near_word", 1) == 1
    return ours.join(theirs, "near").filter(close).select("word", "n", F.col("near_word").alias("near"), "near_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) lead; a form's count is above its word's, so there is no ring."""
    now = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        now = jumped.select("word", "root")
        if not jumped.filter("next IS NOT NULL").take(1):
            return now


def spelling_groups(vocab: DataFrame, ratio: int = RATIO, symbols: int | None = None) -> DataFrame:
    """One row per word of ``vocab`` (word, n): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n, if that is at least ``ratio`` times the word's own.
    """
    vocab = checkpointed(vocab.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(vocab, symbols).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    leads = -F.col("best.less") >= ratio * F.col("n")
    near = checkpointed(near.select(
        "word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")
    ))
    ends = roots(near.filter("form IS NOT NULL"))
    return vocab.join(near, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
