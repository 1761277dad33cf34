"""Trimming, chunking and money normalisation as column expressions (no Python in the plan)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.schemas import CHUNK_CHARS

# The Unicode whitespace that Python's str.strip and re's \s know.
WHITESPACE = "".join(
    chr(c) for c in range(0x3001) if chr(c).isspace()
)
_WS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Word boundaries next to a word character, spelled out so they do not depend on the JDK.
_START = "(?<![\\p{L}\\p{N}_])"
_END = "(?![\\p{L}\\p{N}_])"
_NUMBER = "(\\p{Nd}+(?:\\.\\p{Nd}+)?)"

_DIGITS = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_DIGIT_VALUES = "".join(str(unicodedata.decimal(d)) for d in _DIGITS)
_DIGITS = "".join(_DIGITS)

# Currency words, scale suffixes in order of application, scale words.
CURRENCIES = [
    (("usd", "dollar"), "usd|dollars?", "\\$"),
    (("eur",), "eur|euros?", "€"),
    (("gbp", "pound"), "gbp|pounds?", "£"),
]
SUFFIXES = [("k", 1_000), ("m", 1_000_000), ("b", 1_000_000_000)]
SCALE_WORDS = {"million": 1_000_000, "billion": 1_000_000_000, "thousand": 1_000}


def trimmed(col) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def paragraphs(text) -> Column:
    """Trimmed, non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(text, "\n\n", -1), trimmed), lambda p: F.length(p) > 0)


def pieces_of(text, size: int) -> Column:
    """Consecutive pieces of ``size`` code points; one regex pass, where substrings would rescan."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


# Paragraphs folded at a time.
STRIDE = 256


def chunks(text, max_chars: int = CHUNK_CHARS) -> Column:
    """Array of chunks: blank-line paragraphs packed greedily up to ``max_chars`` code points.

    A paragraph over the limit flushes the open chunk and is cut into fixed pieces of its own.
    Appending to an array copies it, so the fold runs over strides of paragraphs, each with an
    array of its own.
    """
    none = F.array().cast("array<string>")

    def pack(acc, p):
        out, open_ = acc["out"], acc["open"]
        flushed = F.when(open_ == "", out).otherwise(F.concat(out, F.array(open_)))
        too_long = F.length(p) > max_chars
        full = (open_ != "") & (F.length(open_) + 2 + F.length(p) > max_chars)
        return F.struct(
            F.when(too_long, F.concat(flushed, pieces_of(p, max_chars))).when(full, flushed).otherwise(out).alias("out"),
            F.when(too_long, F.lit(""))
            .when(full | (open_ == ""), p)
            .otherwise(F.concat(open_, F.lit("\n\n"), p))
            .alias("open"),
        )

    def stride(acc, ps):
        part = F.aggregate(ps, F.struct(none.alias("out"), acc["open"].alias("open")), pack)
        return F.struct(F.concat(acc["out"], F.array(part["out"])).alias("out"), part["open"].alias("open"))

    return F.aggregate(
        strides(paragraphs(text)),
        F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit("").alias("open")),
        stride,
        lambda acc: F.concat(
            F.flatten(acc["out"]), F.when(acc["open"] == "", none).otherwise(F.array(acc["open"]))
        ),
    )


def strides(items: Column, size: int = STRIDE) -> Column:
    """An array cut into arrays of ``size``."""
    return F.aggregate(
        F.array(items),
        F.array().cast("array<array<string>>"),
        lambda _, all_: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(size)), lambda at: F.slice(all_, at, size)
        ),
    )


def chunk_documents(documents: DataFrame, text: str = "text", max_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_no`` from 0, ``chunk``."""
    others = [c for c in documents.columns if c != text]
    return documents.select(
        *others, F.posexplode(chunks(F.col(text), max_chars)).alias("chunk_no", "chunk")
    )


def _whole(number: Column, factor) -> Column:
    """Digits of ``number`` times ``factor``, truncated toward zero like a float-to-int cast."""
    x = F.translate(number, _DIGITS, _DIGIT_VALUES).cast("double") * factor.cast("double")
    limb = 2.0**60
    high = F.floor(x / limb)
    exact = high.cast("decimal(19,0)") * F.lit(2**60).cast("decimal(19,0)") + (
        x - high.cast("double") * limb
    ).cast("bigint").cast("decimal(19,0)")
    return (
        F.when(x < 2.0**63, F.when(x < 2.0**63, x).cast("bigint").cast("string"))
        .when(x < 2.0**122, F.when(x < 2.0**122, exact).cast("string"))
        .otherwise(F.format_string("%.0f", x))
    )


def _replace_numbers(text: Column, pattern: str, scaled: Column) -> Column:
    """Put the i-th element of ``scaled`` in place of the i-th match of ``pattern``."""
    gaps = F.split(text, pattern, -1)
    return F.array_join(
        F.zip_with(gaps, scaled, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit("")))), ""
    )


def _suffix(text: Column, letter: str, factor: int) -> Column:
    pattern = f"{_START}{_NUMBER} *{letter}{_END}"
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    scaled = F.transform(numbers, lambda n: _whole(n, F.lit(factor)))
    return F.when(
        text.rlike(f"\\p{{Nd}} *{letter}"), _replace_numbers(text, pattern, scaled)
    ).otherwise(text)


def _scale_word(text: Column) -> Column:
    pattern = f"{_START}{_NUMBER} *({'|'.join(SCALE_WORDS)}){_END}"
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    factors = F.create_map(*[F.lit(x) for pair in SCALE_WORDS.items() for x in pair])
    scaled = F.zip_with(numbers, words, lambda n, w: _whole(n, F.try_element_at(factors, w)))
    return F.when(
        text.contains("illion") | text.contains("thousand"), _replace_numbers(text, pattern, scaled)
    ).otherwise(text)


def normalize_text(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target``: ``source`` in canonical form (case, spaces, currency, scales, separators).

    Each step is its own projection: a step that reads its input twice would double the
    expression tree if nested. Cheap substring tests skip the regexes on text that cannot match.
    """
    t = F.col(target)
    steps = [
        F.lower(trimmed(F.coalesce(F.col(source), F.lit("")))),
        # Single spaces already have the right form; only other runs need rewriting.
        F.regexp_replace(t, f"[{_WS}&&[^ ]][{_WS}]*| [{_WS}]+", " "),
    ]
    for stems, words, symbol in CURRENCIES:
        hit = F.lit(False)
        for stem in stems:
            hit = hit | t.contains(stem)
        steps.append(
            F.when(hit, F.regexp_replace(t, f"{_START}(?:{words}){_END}", symbol)).otherwise(t)
        )
    # The comma belongs to the class: the space after any comma goes too.
    steps.append(F.regexp_replace(t, "([$,€£]) +", "$1"))
    steps += [_suffix(t, letter, factor) for letter, factor in SUFFIXES]
    steps.append(_scale_word(t))
    steps.append(trimmed(F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), f"\\.00{_END}", "")))
    for step in steps:
        df = df.withColumn(target, step)
    return df
