"""Text and combined scores, and the review status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.schemas import ACCEPT_THRESHOLD, TEXT_WEIGHT


def _ratio_udf():
    # A closure, so that workers need no copy of this package.
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        import pandas

        matcher = difflib.SequenceMatcher(None)
        out = []
        second = None
        for x, y in zip(a, b):
            if not isinstance(x, str) or not isinstance(y, str):
                out.append(None)
                continue
            if y != second:
                # The matcher indexes its second text once for many first texts.
                matcher.set_seq2(y)
                second = y
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        return pandas.Series(out, dtype="float64")

    return ratio


def text_precision(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp ratio of whole texts (asymmetric); equal or empty texts skip Python."""
    easy = (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
    )
    hard = (a != b) & (F.length(a) > 0) & (F.length(b) > 0)
    return F.coalesce(easy, _ratio_udf()(F.when(hard, a), F.when(hard, b)))


def combined_score(text: Column, semantic: Column, text_weight: float = TEXT_WEIGHT) -> Column:
    return text * F.lit(text_weight) + semantic * F.lit(1.0 - text_weight)


def review_status(score: Column) -> Column:
    return F.when(score >= ACCEPT_THRESHOLD, F.lit("high")).otherwise(F.lit(""))


def score_label(score: Column) -> Column:
    """Two decimals of the exact binary value, exact halves away from zero; "--" when missing."""
    eighths = score * 8
    return (
        F.when(score.isNull(), F.lit("--"))
        # Only odd multiples of 1/8 are exact halves; format_number would round those to even.
        .when(eighths == F.floor(eighths).cast("double"), F.format_string("%.2f", score))
        .otherwise(F.format_number(score, 2))
    )
