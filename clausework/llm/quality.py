"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a vector of weighted term counts: its words, and the shapes of its words (letter
case, digits, marks, a word that repeats the one before), hashed into DIMENSIONS terms. Counts are
damped by logarithm, weighted by inverse document frequency and projected onto the leading singular
directions of the labelled sample. The projected labelled vectors are broadcast; every document's
cosine with every one of them is computed exactly, in blocks, and its NEIGHBOURS nearest vote with
their similarity.

The labelled sample has at most ``FIT_ROWS`` rows, taken by hash of the id; its size bounds what is
sent to the driver and broadcast (FIT_ROWS * RANK numbers and DIMENSIONS * RANK of the projection).
Document frequencies are counted over all documents, a row per term and task. Scoring is one pass over whole texts, with no shuffle.

Defined results
  null or empty text    has no direction; gets the mean label of the sample
  null doc_id           never labelled; not held out (crc32 of an empty id is 0)
  repeated labels       of an id, the largest counts
  repeated ids          one text of an id, that of the smallest hash, is in the sample; all are scored
  ties                  equal cosines are taken in sample order
  no labels             every score is 0.5
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clausework.llm.toxicity import labelled
from clausework.llm.util import fold_of, plain_names, small_batches

FOLDS, HELD_OUT = 4, 2
# Labelled rows that vectors are made of, at most.
FIT_ROWS = 4000
DIMENSIONS, RANK = 4096, 48
NEIGHBOURS = 25
# Neighbours vote with cosine to this power.
SHARPNESS = 8
THRESHOLD = 0.7
# Documents per block of cosines.
BLOCK = 256
CACHE_WORDS = 150_000
# Terms below this number are shapes, the rest words.
SHAPES = 1024
_RUNS = [(re.compile(p), r) for p, r in ((r"[^\W\d_]", "a"), (r"\d", "0"))]


def shape_of(word: str) -> str:
    """Letter case, digits and marks of a word, runs as one."""
    case = "A" if word.isupper() and len(word) > 1 else "Aa" if word[:1].isupper() else "a"
    if word.isalpha():
        return case + ("a" if len(word) == 1 else "a+")
    for pattern, mark in _RUNS:
        word = pattern.sub(mark, word)
    return case + re.sub(r"(.)\1+", r"\1+", word)


def _term_pair(word: str) -> int:
    """The numbers of a word's two terms, its own above 16 bits and its shape's below."""
    own = SHAPES + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % (DIMENSIONS - SHAPES)
    return own << 16 | 1 + zlib.crc32(shape_of(word).encode("utf-8", "surrogatepass")) % (SHAPES - 1)


class Terms:
    """Term counts of whole texts; every distinct word is looked at once per task."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def counts(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        try:
            pairs = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            for word in words:
                if word not in self.known:
                    self.known[word] = _term_pair(word)
            pairs = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        out = np.bincount(pairs >> 16, minlength=DIMENSIONS)
        out[:SHAPES] += np.bincount(pairs & 0xFFFF, minlength=SHAPES)
        out[0] = (pairs[1:] == pairs[:-1]).sum()  # words that repeat the one before
        return out


def dense(counts: list[np.ndarray]) -> np.ndarray:
    """Damped relative term weights, one row per text."""
    out = np.zeros((len(counts), DIMENSIONS), np.float32)
    for i, row in enumerate(counts):
        # Relative to the length, so that a long text lies where its parts lie.
        at = np.flatnonzero(row)
        out[i, at] = np.log1p(row[at] * (1000.0 / max(1, row.sum())))
    return out


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequencies
    projection: np.ndarray  # terms to latent directions
    vectors: np.ndarray  # unit rows of the sample
    labels: np.ndarray

    @property
    def mean(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, rows: np.ndarray) -> np.ndarray:
        x = (rows * self.weights) @ self.projection
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(norm > 0, x / np.maximum(norm, 1e-12), 0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Similarity-weighted mean label of the nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        x = self.latent(rows)
        cosine = x @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 0, votes, self.mean).astype(np.float64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found = Terms(), np.zeros(DIMENSIONS + 1, np.int64)  # the last for all documents
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found[:DIMENSIONS] += terms.counts(text) > 0
            found[DIMENSIONS] += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": at, "n": found[at]})

    rows = small_batches(docs.select(docs[text_col].alias("text"))).mapInArrow(count, "term long, n long")
    table = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    out[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return out[:DIMENSIONS], int(out[DIMENSIONS])


def latent_model(rows: np.ndarray, labels: np.ndarray, found: np.ndarray, documents: int, seed: int = 7) -> Model:
    """Weights by the documents that hold each term; projection and vectors of a labelled sample (term rows and 0/1 labels)."""
    weights = np.log((1 + documents) / (1 + found)).astype(np.float32) + 1
    x = rows * weights
    # Leading right singular vectors by subspace iteration.
    rank = max(1, min(RANK, *x.shape))
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    model = Model(weights, np.ascontiguousarray((basis @ right.T)[:, :rank]), np.zeros((0, rank), np.float32), labels.astype(np.float32))
    model.vectors = model.latent(rows)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        fit_rows: int = FIT_ROWS) -> Model:
    """The model of a corpus; labels of the held-out fold are not looked at."""
    sample = labelled(docs, labels, id_col, text_col, label_col, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT, fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            rows = [terms.counts(t) for t in batch.column("text").to_pylist()]
            found = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "label": batch.column("label"),
                "terms": pa.array(found, pa.list_(pa.int64())),
                "counts": pa.array([r[f] for r, f in zip(rows, found, strict=True)], pa.list_(pa.int64())),
            })

    kind = dict(sample.dtypes)["doc_id"]
    # One row per sampled document, of at most DIMENSIONS counts.
    table = small_batches(sample).mapInArrow(count, f"doc_id {kind}, label int, terms array<long>, counts array<long>").orderBy("doc_id").toArrow()
    if not table.num_rows:
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    rows = []
    for terms, counts in zip(table.column("terms"), table.column("counts"), strict=True):
        row = np.zeros(DIMENSIONS, np.int64)
        row[terms.values.to_numpy()] = counts.values.to_numpy()
        rows.append(row)
    return latent_model(dense(rows), (table.column("label").to_numpy() > 0).astype(np.float32),
                        *document_frequencies(docs, text_col))


def _with_scores(rows: DataFrame, model: Model, text_col: str, kept: list[str], name: str) -> DataFrame:
    """The kept columns of every row and its score, as the last column ``name``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            blocks = (texts[at:at + BLOCK] for at in range(0, len(texts), BLOCK))
            scores = [shared.value.scores(dense([terms.counts(t) for t in block])) for block in blocks]
            columns = [batch.column(c) for c in kept] + [pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, name])

    fields = [f for f in rows.schema.fields if f.name in kept]
    return small_batches(rows).mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier good) and predicted of every document."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return _with_scores(rows, model, "text", ["doc_id"], "score").select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns kept."""
    plain, (text,) = plain_names(docs, text_col)
    scored = _with_scores(plain, model, text, plain.columns, "score")
    return scored.filter(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
