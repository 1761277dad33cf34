"""Byte-level BPE by a vocabulary of ranks: encoding with a hierarchical-bitmap rank queue, and decoding.

A text is cut into pre-tokens by the vocabulary's pattern, and each is merged on its own: while two
neighbouring parts together are a token, the pair of lowest rank, of equal ones the leftmost, becomes
one part. The parts are a linked list. Each rank has a bucket of list positions whose pair has it,
and a bitmap of three levels of 64 bits a word knows the buckets that hold anything: finding the
first set bit of each level names the next rank. A merge changes the pairs to its left and right,
which enter their buckets; what they held before goes stale and is skipped when it comes up. A
pre-token of n bytes thus takes a time of n log n, however long it is, where rescanning for the
lowest rank takes the square.

Texts are dealt in Arrow batches, their pre-tokens streamed. A worker keeps the ids of pre-tokens it
has met, in two generations of bounded size: when the younger is full it becomes the older, and what is
asked for again moves up. Ids and bytes travel as little-endian unsigned 32-bit numbers and
plain bytes, so hashes and lengths are taken by Spark.

Defined results
  null or empty text    no ids, empty bytes
  null doc_id           kept
  repeated rows, ties   one row each
  very long texts       whole, by slices of pre-tokens; very long pre-tokens as above
  names of special tokens   ordinary text
  unknown ids           decoding raises
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
# Pre-tokens in each of a worker's two cache generations; some 100 MB with their ids.
CACHE = 600_000
# Characters of a pre-token that is kept, at most.
CACHED = 64
# Bits of a bitmap word.
WORD = 8
# Pre-tokens of one text worked on at a time, and characters up to which it is cut up at once.
SLICE, AT_ONCE = 1 << 16, 1 << 18


def public_ranks(name: str = RANKS) -> tuple[str, str]:
    """The file of a public vocabulary and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class Bpe:
    """Encodes and decodes by the ranks of ``path``, pre-token by pre-token of ``pattern``."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        # The rank queue: positions by rank, and which 256 ranks each have any. Empty between pre-tokens.
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((max(self.ranks.values()) >> WORD) + 1)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.sizes = np.array([len(t) for t in self.token])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known = np.zeros(len(self.token), bool)
        self.known[list(self.ranks.values())] = True
        self.pairs = [[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> array:
        """The ids of one pre-token; queue operations are written out, as most pre-tokens are short."""
        ranks, pairs, find = self.ranks, self.pairs, self.ranks.get
        whole = find(piece)
        if whole is not None:
            return array("I", [whole])
        # Part i starts at byte i and goes on to ``after[i]``; its pair's rank is ``of[i]``, -1 if it has none.
        n, mask = len(piece), (1 << WORD) - 1
        of = [pairs[a][b] for a, b in zip(piece, piece[1:])] + [-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets, words, top = self.buckets, self.words, 0
        for i, rank in enumerate(of):
            if rank in buckets:
                heappush(buckets[rank], i)
            elif rank >= 0:
                buckets[rank] = [i]
                words[rank >> WORD] |= 1 << (rank & mask)
                top |= 1 << (rank >> WORD)
        while top:
            # The first set bits name the lowest rank, the bucket its leftmost position.
            word = (top & -top).bit_length() - 1
            bits = words[word]
            lowest = bits & -bits
            rank = word << WORD | lowest.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits ^ lowest
                if not bits:
                    top &= top - 1
            if of[i] != rank:
                continue  # stale: the pair that stood here has changed
            right = after[i]
            end = after[i] = after[right]
            of[right] = -1  # no part starts here any more
            changed = [(i, find(piece[i:after[end]], -1))] if end < n else [(i, -1)]
            if end < n:
                before[end] = i
            if i:
                changed.append((before[i], find(piece[before[i]:end], -1)))
            for at, new in changed:
                of[at] = new
                if new in buckets:
                    heappush(buckets[new], at)
                elif new >= 0:
                    buckets[new] = [at]
                    words[new >> WORD] |= 1 << (new & mask)
                    top |= 1 << (new >> WORD)
        ids, i = array("I"), 0
        while i < n:
            ids.append(ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def _ids(self, piece: str) -> bytes:
        """Ids of a pre-token that the younger generation does not hold."""
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode()).tobytes()
        if len(piece) <= CACHED:
            if len(self.young) >= CACHE:
                self.young, self.old = {}, self.young
            self.young[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if len(text) <= AT_ONCE:
            return self._joined(self.pattern.findall(text))
        matches = self.pattern.finditer(text)
        out = []
        while pieces := [m[0] for m in islice(matches, SLICE)]:
            out.append(self._joined(pieces))
        return b"".join(out)

    def _joined(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.young.__getitem__, pieces))
        except KeyError:
            # A generation may end on the way, hence by lookup in whichever is the younger then.
            return b"".join([self.young.get(p) or self._ids(p) for p in pieces])

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that ids stand for."""
        codes = np.frombuffer(ids or b"", "<u4")
        if len(codes) and not (int(codes.max()) < len(self.token) and self.known[codes].all()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for at in range(0, len(codes), SLICE):
            some = codes[at:at + SLICE]
            length = self.sizes[some]
            ends = np.cumsum(length)
            out.append(self.bytes[np.repeat(self.starts[some] - (ends - length), length) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_BPE: dict[tuple[str, str], Bpe] = {}


def bpe(path: str, pattern: str) -> Bpe:
    """The vocabulary of a file; a worker process keeps it, with its cache, for the tasks it runs later."""
    if (path, pattern) not in _BPE:
        _BPE[path, pattern] = Bpe(path, pattern)
    return _BPE[path, pattern]


def _mapped(rows: DataFrame, column: str, out: str, path: str, pattern: str, work: Callable[[Bpe, object], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path, pattern)
        for batch in batches:
            made = pa.array([work(own, x.as_py()) for x in batch.column(column)], pa.binary())
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), made], [*kept, out])

    names = [f"`{n}` {t}" for n, t in rows.dtypes if n != "text"]
    return small_batches(rows).mapInArrow(run, ", ".join([*names, f"{out} binary"]))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id and ids, little-endian unsigned 32-bit numbers."""
    default = public_ranks() if path is None or pattern is None else (path, pattern)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return _mapped(rows, "text", "ids", path or default[0], pattern or default[1], Bpe.encode)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with bytes, what the ids stand for; in UTF-8 for ids of a text."""
    default = public_ranks() if path is None or pattern is None else (path, pattern)
    return _mapped(encoded.select("doc_id", "ids"), "ids", "bytes", path or default[0], pattern or default[1], Bpe.decode)


def token_digest(decoded: DataFrame) -> DataFrame:
    """Count and hash of the ids, and hash of the decoded bytes, of (doc_id, ids, bytes)."""
    return decoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )
