"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled text, give every word a log-likelihood per class,
given the word before it, across blanks and line ends. Both interpolate with absolute discounting: word
pairs fall back on the word as a row of letters, letters on shorter contexts (orders 7, 5 and 3), and both
classes on one shared distribution of continuation counts: of every three-letter gram, the number of
different letters seen before it anywhere in the corpus. An expression that is rare in either class is
thus judged by the shared counts and says little. Pairs seen once are left to the letters, with their mass.

A document is compared by the difference of the two length-normalised log-likelihoods: of the whole text,
and of its most toxic passage of 1, 4 and 16 words. A logistic curve, fitted on labelled rows that the
counts have not seen, maps these differences to a probability; nothing else enters.

The class counts come from at most ``FIT_ROWS`` labelled rows of ``FIT_CHARS`` characters in all, taken by
hash of the id, so the model has a size that does not depend on the corpus and is broadcast. The shared
counts cover all documents: tasks emit their distinct four-letter grams, and Spark counts them. Scoring is
one pass over the texts, with no shuffle, a slice of texts at a time as one row of word codes.

Defined results
  null or empty text    scored as a text without words
  null doc_id           never labelled; held out, as the remainder of an empty id is 0
  repeated labels       a row is toxic if any label of its id is
  repeated ids          one text of an id, that of the smallest hash, is fitted on; all are scored
  no labels, one class  every score is 0.5 (no labels) or 0 or 1 (one class)
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm.util import checkpointed, fold_of, small_batches, text_key

FOLDS, HELD_OUT = 5, 0
# Of the other folds, this one fits the logistic curve; the rest give the counts.
CURVE_FOLD = 4
# Labelled rows that the class counts and the curve are fitted on, at most, and their characters.
FIT_ROWS, FIT_CHARS = 20_000, 20_000_000
ORDERS = (7, 5, 3)
DISCOUNT = 0.75
# Words of passages, and occurrences from which a pair of words counts as one.
PASSAGES, PAIRS = (4,), 2
FEATURES = 1 + len(PASSAGES)
THRESHOLD = 0.5
# Distinct words a worker keeps in each of two generations, some 100 MB each, words judged at a time, texts split at a time.
CACHE_WORDS, WORDS, TEXTS = 500_000, 20_000, 500
_M = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS = np.array([pow(_M, j, 1 << 64) for j in range(max(ORDERS))], np.uint64)
_EDGES = ".,;:!?\"'()[]|*%$#&"


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words in lower case, without marks at their edges; the codes of all words; where each text starts."""
    cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    flat = cut.flatten()
    # A text without words is cut into one empty piece.
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))
    starts = np.r_[0, np.cumsum(some)][np.asarray(cut.offsets) - cut.offsets[0].as_py()]
    coded_ = flat.filter(pa.array(some)).dictionary_encode()
    return [w.strip(_EDGES) for w in coded_.dictionary.to_pylist()], coded_.indices.to_numpy().astype(np.int64), starts


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first ^ (first >> np.uint64(31))) * np.uint64(_M) + second
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each led by six marks and closed by one, and the places of its letters and end."""
    pad = max(ORDERS) - 1
    joined = "".join("\x00" * pad + w + "\x01" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    return codes, np.flatnonzero(codes != 1)


def _gram(codes: np.ndarray, at: np.ndarray, order: int, first: int = 0) -> np.ndarray:
    """Hashes of the letters ``first`` .. ``order - 1`` back from each place."""
    h = np.full(len(at), (order * 0x632BE59BD9B4E019) & _MASK, np.uint64)
    for j in range(first, order):
        h += codes[at - j] * _POWERS[j]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def count_grams(words: Counter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, context, count) arrays of every class order for words with counts."""
    if not words:
        return
    codes, at = _letters(list(words))
    weight = np.repeat(np.fromiter(words.values(), np.int64), _word_lengths(codes, at))
    for order in ORDERS:
        gram, context = _gram(codes, at, order), _gram(codes, at, order, 1)
        unique, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
        yield unique, context[first], np.bincount(inverse, weight).astype(np.int64)


def _word_lengths(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places per word: its letters and its end."""
    ends = np.flatnonzero(codes[at] == 2)
    return np.diff(np.r_[-1, ends])


def shared_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (four-letter gram, its three-letter end, the two letters before the last)."""
    codes, at = _letters(words)
    gram, first = np.unique(_gram(codes, at, 4), return_index=True)
    return gram, _gram(codes, at[first], 3), _gram(codes, at[first], 3, 1)


@dataclass
class Model:
    """Sorted hashes with their numbers, per class; looked up by binary search."""

    grams: np.ndarray  # hashes
    gram_counts: np.ndarray  # rows of (toxic, ordinary)
    contexts: np.ndarray
    context_counts: np.ndarray
    context_kinds: np.ndarray  # different letters seen after the context
    ends: np.ndarray  # three-letter ends
    end_kinds: np.ndarray  # different letters seen before
    middles: np.ndarray
    middle_kinds: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # pairs of words
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # first words of such pairs
    # Rows of (toxic, ordinary) occurrences, then of the part of them that its pairs keep after discounting.
    head_counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.float64))
    curve: tuple[float, ...] = (0.0,) * (1 + FEATURES)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((len(wanted), *values.shape[1:]), values.dtype)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = values[i]
        found[keys[i] != wanted] = 0
        return found

    def letters(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods (toxic, ordinary) of every word as a row of letters and an end."""
        parts = [self._letters(words[at:at + WORDS]) for at in range(0, len(words), WORDS)]
        return np.concatenate([*parts, np.zeros((0, 2))])

    def _letters(self, words: list[str]) -> np.ndarray:
        codes, at = _letters(words)
        kinds = self._at(self.ends, self.end_kinds, _gram(codes, at, 3))
        total = self._at(self.middles, self.middle_kinds, _gram(codes, at, 3, 1))
        # Of 64 letters not seen after the middle, each gets an equal part of one count.
        shared = (kinds + 1 / 64) / (total + 1)
        p = np.stack([shared, shared], axis=1)
        for order in reversed(ORDERS):
            context = _gram(codes, at, order, 1)
            seen = self._at(self.contexts, self.context_counts, context).astype(np.float64)
            different = self._at(self.contexts, self.context_kinds, context)
            count = self._at(self.grams, self.gram_counts, _gram(codes, at, order))
            with np.errstate(divide="ignore", invalid="ignore"):
                mixed = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * different * p) / seen
            p = np.where(seen > 0, mixed, p)
        lengths = _word_lengths(codes, at)
        return np.add.reduceat(np.log(p), np.cumsum(lengths) - lengths, axis=0)

    def differences(self, letters: np.ndarray, hashes: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word of a row, given the one before unless it is the ``first`` of a text."""
        word = letters[codes]
        if not len(self.heads) or not len(codes):
            return word[:, 0] - word[:, 1]
        # Per distinct word: whether pairs start with it, occurrences and what is left for other words than theirs.
        at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
        known = self.heads[at] == hashes
        seen, kept = self.head_counts[at, :2], self.head_counts[at, 2:]
        left = np.where(known[:, None] & (seen > 0), 1 - kept / np.maximum(seen, 1), 1.0)
        before = np.r_[codes[:1], codes[:-1]]
        paired = known[before] & ~first
        out = word + np.where(paired[:, None], np.log(left)[before], 0.0)
        # Word pairs that the classes hold.
        some = np.flatnonzero(paired)
        pair = pair_hashes(hashes[before[some]], hashes[codes[some]])
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[at] == pair
        some, counts = some[hit], self.pair_counts[at[hit]]
        with np.errstate(under="ignore"):
            own = np.maximum(counts - DISCOUNT, 0) / np.maximum(seen[before[some]], 1)
            out[some] = np.logaddexp(out[some], np.log(np.maximum(own, 1e-300)))
        return out[:, 0] - out[:, 1]


class Scorer:
    """Features of texts; distinct words are judged once while they are in one of two cache generations."""

    def __init__(self, model: Model):
        self.model, self.young, self.old = model, {}, {}

    def _judged(self, words: list[str]) -> np.ndarray:
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        for w in words:
            if w not in young and w in old:
                young[w] = old[w]
        new = list({w for w in words if w not in young})
        young.update(zip(new, map(tuple, self.model.letters(new).tolist()), strict=True))
        return np.array([young[w] for w in words]).reshape(-1, 2)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: difference of the log-likelihoods per letter, of all of it and of its most toxic passages."""
        parts = [self._slice(texts.slice(at, TEXTS)) for at in range(0, len(texts), TEXTS)]
        return np.concatenate([*parts, np.zeros((0, FEATURES))])

    def _slice(self, texts: pa.Array) -> np.ndarray:
        words, codes, starts = coded(texts)
        out = np.zeros((len(texts), FEATURES))
        if not len(codes):
            return out
        # A word's end is drawn by the models too and counts as a letter.
        length = (np.fromiter(map(len, words), np.int64, len(words)) + 1)[codes]
        sizes = np.diff(starts)
        first = np.zeros(len(codes), bool)
        first[starts[:-1][sizes > 0]] = True
        difference = self.model.differences(self._judged(words), word_hashes(words), codes, first)
        sums, letters = np.r_[0, np.cumsum(difference)], np.r_[0, np.cumsum(length)]
        some = sizes > 0
        out[some, 0] = (sums[starts[1:]] - sums[starts[:-1]])[some] / (letters[starts[1:]] - letters[starts[:-1]])[some]
        # Passages end at each word and start so many words before, or where the text starts.
        end, least = np.arange(1, len(codes) + 1), np.repeat(starts[:-1], sizes)
        for i, size in enumerate(PASSAGES, 1):
            begin = np.maximum(end - size, least)
            # In a text of that many words or more, only whole passages count.
            whole = end - begin >= np.minimum(np.repeat(sizes, sizes), size)
            passage = np.where(whole, (sums[end] - sums[begin]) / (letters[end] - letters[begin]), -np.inf)
            out[some, i] = np.maximum.reduceat(passage, starts[:-1][some])
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text."""
        weights = np.array(self.model.curve)
        return 1 / (1 + np.exp(-np.clip(weights[0] + self.features(texts) @ weights[1:], -30, 30)))


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """A worker process keeps the scorer of the model it used last, with its cache, for the tasks it runs later."""
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model)
    return _SCORERS[model.name]


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, on standardised features."""
    if not len(y) or y.min() == y.max():
        return (0.0 if not len(y) else 30.0 if y[0] else -30.0, *[0.0] * x.shape[1])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    slope = w[1:] / spread
    return float(w[0] - (slope * mean).sum()), *map(float, slope)


def _table(rows: pa.Table, key: str, *values: str) -> tuple[np.ndarray, np.ndarray]:
    keys = rows.column(key).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    numbers = np.stack([rows.column(v).to_numpy() for v in values], axis=1) if len(values) > 1 else rows.column(values[0]).to_numpy()
    return keys[order], numbers[order]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed: Column,
             limit: int, chars: int | None = None) -> DataFrame:
    """(doc_id, label, text) of at most ``limit`` labelled ids that ``allowed`` (of ``doc_id``) lets through, by hash.

    One row per id: of several texts the one with the smallest hash, found map-side first. With ``chars``, as
    many of them, in the order of the hash, as have no more characters in all.
    """
    known = (
        labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).filter(allowed)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    known = checkpointed(known)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = texts.join(F.broadcast(known), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(text_key(F.col("text")), "text")).alias("least")).select(
        "doc_id", "label", "least.text"
    )
    if chars is None:
        return found
    found = checkpointed(found)
    # A few numbers for each of at most ``limit`` rows.
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(order)
    fits = found.select("doc_id", so_far.alias("so_far")).filter(F.col("so_far") <= chars).select("doc_id")
    return found.join(F.broadcast(fits), "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """The model of a corpus; labels of the held-out fold are not looked at."""
    fold = fold_of(F.col("doc_id"), FOLDS)
    sample = labelled(docs, labels, id_col, text_col, label_col, fold != HELD_OUT, fit_rows, fit_chars)
    counted = sample.filter(fold != CURVE_FOLD)

    def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Counter(), Counter()
        for batch in batches:
            words, codes, starts = coded(batch.column("text"))
            toxic = np.repeat(batch.column("label").to_numpy() > 0, np.diff(starts))
            for which, some in enumerate((toxic, ~toxic)):
                counts = np.bincount(codes[some], minlength=len(words))
                for i in np.flatnonzero(counts):  # words that differ in marks at their edges are one
                    both[which][words[i]] += int(counts[i])
        for which, words in enumerate(both):
            for gram, context, count in count_grams(words):
                none = np.zeros(len(count), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "gram": gram.view(np.int64), "context": context.view(np.int64),
                    "toxic": none if which else count, "ordinary": count if which else none,
                })

    def word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                words, codes, starts = coded(some.column("text"))
                hashes, sizes = word_hashes(words), np.diff(starts)
                inner = np.ones(len(codes), bool)
                inner[starts[:-1][sizes > 0]] = False
                second = np.flatnonzero(inner)
                head = hashes[codes[second - 1]]
                toxic = np.repeat(some.column("label").to_numpy() > 0, sizes)[second]
                # Pairs, and under no pair their first words alone.
                for pair in (pair_hashes(head, hashes[codes[second]]), None):
                    unique, first, inverse = np.unique(head if pair is None else pair, return_index=True, return_inverse=True)
                    counts = [np.bincount(inverse, x, len(unique)).astype(np.int64) for x in (toxic, ~toxic)]
                    yield pa.RecordBatch.from_pydict({
                        "pair": pa.nulls(len(unique), pa.int64()) if pair is None else pa.array(unique.view(np.int64)),
                        "head": head[first].view(np.int64), "toxic": counts[0], "ordinary": counts[1],
                    })

    sums = [F.sum(c).alias(c) for c in ("toxic", "ordinary")]
    grams = checkpointed(
        counted.select("label", "text").mapInArrow(class_counts, "gram long, context long, toxic long, ordinary long")
        .groupBy("gram", "context").agg(*sums)
    )
    common = F.col("pair").isNull() | (F.col("toxic") + F.col("ordinary") >= PAIRS)
    pairs = checkpointed(
        counted.select("label", "text").mapInArrow(word_pairs, "pair long, head long, toxic long, ordinary long")
        .groupBy("pair", "head").agg(*sums).filter(common)
    )
    paired, classes = F.col("pair").isNotNull(), ("toxic", "ordinary")
    heads = pairs.groupBy("head").agg(
        *[F.sum(F.when(~paired, F.col(c)).otherwise(0)).alias(c) for c in classes],
        *[F.sum(F.when(paired, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).otherwise(0.0)).alias(f"{c}_kept") for c in classes],
    ).filter("toxic_kept + ordinary_kept > 0")
    contexts = grams.groupBy("context").agg(
        *sums, F.count_if(F.col("toxic") > 0).alias("toxic_kinds"), F.count_if(F.col("ordinary") > 0).alias("ordinary_kinds")
    )

    def distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        young: set[str] = set()
        old: set[str] = set()
        for batch in batches:
            column = batch.column("text")
            for at in range(0, len(column), TEXTS):
                words = set(coded(column.slice(at, TEXTS))[0]) - young
                if len(young) > CACHE_WORDS:
                    young, old = set(), young
                young |= words
                words = list(words - old)
                for first in range(0, len(words), WORDS):
                    gram, end, middle = shared_grams(words[first:first + WORDS])
                    yield pa.RecordBatch.from_pydict({
                        "gram": gram.view(np.int64), "ending": end.view(np.int64), "middle": middle.view(np.int64),
                    })

    texts = docs.select(docs[text_col].alias("text"))
    shared = checkpointed(
        small_batches(texts).mapInArrow(distinct_grams, "gram long, ending long, middle long").distinct()
        .groupBy("ending", "middle").agg(F.count(F.lit(1)).alias("kinds"))
    )
    # Only what the class model can meet goes to the driver: ends of its own three-letter grams.
    own = grams.select(F.col("gram").alias("ending"))
    ends = shared.join(own, "ending", "left_semi")
    middles = shared.groupBy("middle").agg(F.sum("kinds").alias("kinds")).join(
        grams.select(F.col("context").alias("middle")).distinct(), "middle", "left_semi"
    )
    gram_keys, gram_counts = _table(grams.toArrow(), "gram", "toxic", "ordinary")
    context_rows = contexts.toArrow()
    context_keys, context_counts = _table(context_rows, "context", "toxic", "ordinary")
    _, kinds = _table(context_rows, "context", "toxic_kinds", "ordinary_kinds")
    model = Model(gram_keys, gram_counts, context_keys, context_counts, kinds,
                  *_table(ends.toArrow(), "ending", "kinds"), *_table(middles.toArrow(), "middle", "kinds"),
                  *_table(pairs.filter(paired).drop("head").toArrow(), "pair", "toxic", "ordinary"),
                  *_table(heads.toArrow(), "head", "toxic", "ordinary", "toxic_kept", "ordinary_kept"))
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def curve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared_model.value)
        for batch in batches:
            x = own.features(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    rest = sample.filter(fold == CURVE_FOLD).select("label", "text").mapInArrow(curve_rows, "label int, x array<double>").toArrow()
    x = np.array(rest.column("x").to_pylist()).reshape(-1, FEATURES)
    model.curve = fit_curve(x, (rest.column("label").to_numpy() > 0).astype(np.float64))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic) and predicted of every document."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": own.scores(batch.column("text")),
            })

    found = small_batches(rows).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return found.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
