"""Token ids of whole texts by a public tokenizer file, with a bounded cache of pieces.

Neither tokenizer looks across certain places in a text: the word tokenizer drops blanks and line
feeds, the byte tokenizer starts a new pre-token at a blank or line feed that follows a character
other than white space. Texts are cut there, pieces that a worker has met lately are not encoded
again, and the joined result equals encoding the whole text: names of special tokens give their ids, as
they do in a plain call of the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
# Pieces in each of a worker's two cache generations, some 100 MB each; a slice of texts may add its own.
CACHE = 600_000
# Texts cut up at a time.
TEXTS = 500
# Texts handed to the library as one, set apart by a special token, unless they could hold part of one.
JOINED, _END, _APART = 1000, "<|endoftext|>", frozenset("<|>")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_PILED_RE2 = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]|^[ \n]|\x00"
_PILED = re.compile(r"\s[ \n]|^[ \n]|\0")


def public_path(name: str) -> str:
    """Where the file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pieces(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def byte_pieces(text: str) -> list[str]:
    """Pieces that join to ``text``; a blank in front of a piece other than the first is left out, a line feed stays."""
    if _PILED.search(text):
        # White space in a run, or the mark itself in the text: cut exactly, and mark all pieces, which keep their blanks.
        return ["\0" + piece for piece in _CUT.split(text)]
    parts = text.replace("\n", " \n").split(" ")
    if not parts[0].startswith("\n"):
        parts[0] = "\0" + parts[0]
    return parts


def _byte_text(piece: str) -> str:
    return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, pieces: Callable[[str], list[str]], text_of: Callable[[str], str] = str, folds: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.text_of = pieces, text_of
        self.folds = folds  # upper and lower case get the same ids
        self.end = self.tokenizer.token_to_id(_END)
        self.limit = CACHE
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {m: self._ids([m])[0] for m in ".,"}

    def encode(self, text: str | None) -> bytes:
        return b"".join(self._look(self.pieces(text or "")))

    def _look(self, pieces: list[str]) -> list[bytes]:
        """The ids of every piece."""
        found = list(map(self.young.get, pieces))
        if None not in found:
            return found
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        missing = [i for i, ids in enumerate(found) if ids is None]
        young, old, new = self.young, self.old, {}
        for i in missing:
            piece = pieces[i]
            ids = old.get(piece)
            if ids is None:
                new[piece] = None
            else:
                young[piece] = ids
        if new:
            self._learn(new)
        for i in missing:
            found[i] = young[pieces[i]]
        return found

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """As ``encode`` of every text in turn, with each distinct piece looked up once per slice."""
        for at in range(0, len(texts), TEXTS):
            yield from self._encode_slice(texts.slice(at, TEXTS))

    def _encode_slice(self, texts: pa.Array) -> Iterator[bytes]:
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        if self.folds:
            plain = pc.replace_substring(texts, "\n", " ")
        else:
            # As byte_pieces: texts with white space in a run are encoded on their own.
            odd = pc.match_substring_regex(texts, _PILED_RE2).to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
            plain = pc.binary_join_element_wise("\0", pc.replace_substring(plain, "\n", " \n"), "")
        cut = pc.split_pattern(plain, " ")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        found = self._look(pieces)
        pool = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy()
        length = sizes[codes]
        ends = np.cumsum(length)
        from_pool = (np.cumsum(sizes) - sizes)[codes] - (ends - length)
        ids = pool[np.repeat(from_pool, length) + np.arange(ends[-1] if len(ends) else 0)]
        places = np.concatenate([[0], ends])[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
        for i, alone in enumerate(odd):
            yield self.encode(texts[i].as_py()) if alone else ids[places[i]:places[i + 1]].tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts between two special tokens are encoded apart, so many of them are handed over as one."""
        odd = [i for i, t in enumerate(texts) if not _APART.isdisjoint(t)]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)
        apart = {i: array("I", f.ids).tobytes() for i, f in zip(odd, found, strict=True)}
        out: list[bytes] = []
        for at in range(0, len(texts), JOINED):
            some = [t if i not in apart else "" for i, t in enumerate(texts[at:at + JOINED], at)]
            data = array("I", self.tokenizer.encode_batch_fast([_END.join(some)], add_special_tokens=False)[0].ids)
            ends = (np.flatnonzero(np.frombuffer(data, np.uint32) == self.end) * 4).tolist()
            raw = data.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]
        for i, ids in apart.items():
            out[i] = ids
        return out

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that neither generation has."""
        young, old = self.young, self.old
        whole, derived = {}, []
        marks, folds = tuple(self.marks), self.folds
        for piece in pieces:
            # Letters and one mark behind them are separate pre-tokens.
            marked = piece.endswith(marks) and piece[:-1].isalpha()
            base = piece[:-1] if marked else piece
            # In lower case, other text could become the name of a special token.
            if folds and base.isascii() and "<|" not in base:
                base = base.lower()
            if base is piece:
                whole[piece] = None
                continue
            derived.append((piece, base, piece[-1] if marked else ""))
            if base not in young:
                if base in old:
                    young[base] = old[base]
                else:
                    whole[base] = None
        if whole:
            young.update(zip(whole, self._ids([self.text_of(p) for p in whole]), strict=True))
        for piece, base, mark in derived:
            young[piece] = young[base] + self.marks.get(mark, b"")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache: int | None = None) -> Encoder:
    """The encoder of a tokenizer file; the kind is read from its pre-tokenizer.

    A worker process keeps it, with generations of ``cache`` pieces, for the tasks it runs later.
    """
    if path not in _ENCODERS:
        # Spark runs one task per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)["pre_tokenizer"]["type"]
        byte_level = kind == "ByteLevel"
        _ENCODERS[path] = Encoder(path, byte_pieces, _byte_text) if byte_level else Encoder(path, word_pieces, folds=True)
    own = _ENCODERS[path]
    own.limit = CACHE if cache is None else cache
    return own
