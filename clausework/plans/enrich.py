"""The two model plug-in points: embedding texts and extracting parameters from chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.schemas import DEFAULT_KEYS, EMBED_BATCH, VECTOR_WIDTH

# A provider factory is called once per Python worker task and returns the batch function.
Embedder = Callable[[], Callable[[list[str]], list[list[float]]]]
Extractor = Callable[[], Callable[[list[str]], list[str]]]


def embed_with(text: Column, load: Embedder, batch: int = EMBED_BATCH) -> Column:
    """Vectors from a user model: loaded once per task, called with ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pandas

        model = load()
        for texts in series:
            present = [i for i, t in enumerate(texts) if isinstance(t, str)]
            out = [None] * len(texts)
            for at in range(0, len(present), batch):
                part = present[at : at + batch]
                for i, vec in zip(part, model([texts.iloc[j] for j in part])):
                    out[i] = [float(x) for x in vec]
            yield pandas.Series(out, dtype="object")

    return encode(text)


def embed_hashing(df: DataFrame, text: str, target: str, width: int = VECTOR_WIDTH) -> DataFrame:
    """Built-in embedder: hashed word counts scaled to unit length, in the JVM.

    A text without words gets the zero vector, a missing text none.
    """
    return hash_words(df, text, "_unit", width).withColumn(target, plain_vector(F.col("_unit"))).drop("_unit")


def hash_words(df: DataFrame, text: str, target: str, width: int = VECTOR_WIDTH) -> DataFrame:
    """The vectors of ``embed_hashing`` as sparse ones, which take the room of a text's words, not of ``width``."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    counted = HashingTF(numFeatures=width, inputCol="_words", outputCol="_counts").transform(
        df.withColumn("_words", words)
    )
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_scaled").transform(counted)
    return unit.withColumn(target, F.when(F.col(text).isNotNull(), F.col("_scaled"))).drop("_words", "_counts", "_scaled")


def plain_vector(sparse: Column) -> Column:
    """A sparse vector with all its places, as an array; null if there is none."""
    return F.when(sparse.isNotNull(), vector_to_array(sparse, "float32"))


def prompts(chunk: Column, keys: list[str] | Column | None = None) -> Column:
    """What a model is asked about one chunk; ``keys`` for all, or an array column with each row's own."""
    if keys is None or isinstance(keys, list):
        keys = F.array(*[F.lit(k) for k in keys or []]).cast("array<string>")
    task = (
        "From the following part of a contract, extract its parameters and answer with JSON alone: "
        'an object {"parameters": [...]} whose entries have the fields key, value and spatial '
        "(spatial may be null)."
    )
    only = F.when(
        F.size(keys) > 0, F.concat(F.lit(" Extract only these parameters: "), F.array_join(keys, ", "), F.lit("."))
    ).otherwise(F.lit(""))
    return F.concat(F.lit(task), only, F.lit("\n\n"), chunk)


def replies_from_model(
    chunks: DataFrame,
    load: Extractor,
    keys: list[str] | Column | None = None,
    chunk: str = "chunk",
    batch: int = EMBED_BATCH,
) -> DataFrame:
    """One JSON reply per chunk from a user model.

    Chunks are spread by identity, so the many chunks of a long document do not queue in one task;
    a model call costs far more than moving its chunk.
    """
    others = [c for c in chunks.columns if c != chunk]
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = chunks.repartition(tasks, *others).select(*others, prompts(F.col(chunk), keys).alias("response"))

    def ask(batches):
        model = load()
        for pdf in batches:
            answers = []
            for at in range(0, len(pdf), batch):
                answers += model(pdf["response"].iloc[at : at + batch].tolist())
            yield pdf.assign(response=answers)

    return asked.mapInPandas(ask, asked.schema)


def replies_from_rules(chunks: DataFrame, keys: list[str] | Column | None = None, chunk: str = "chunk") -> DataFrame:
    """Built-in extractor: "key: value" lines, answered in the reply format of a model.

    Row-local expressions over a short literal key list, or over an array column with each row's
    own keys, so no join and no Python.
    """
    others = [c for c in chunks.columns if c != chunk]
    before, after = "(?im)^[ \\t]*", "[ \\t]*:[ \\t]*(\\S.*)$"

    def answers(key: Column, line: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(F.col(chunk), line, F.lit(1)),
            lambda v: F.struct(key.alias("key"), v.alias("value"), F.lit(None).cast("string").alias("spatial")),
        )

    if isinstance(keys, Column):
        # An end of quotation inside a key is quoted on its own.
        inner = lambda k: F.replace(k, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        quoted = lambda k: F.concat(F.lit(before + "\\Q"), inner(k), F.lit("\\E" + after))
        found = F.flatten(F.transform(keys, lambda k: answers(k, quoted(k))))
    else:
        found = F.concat(*[answers(F.lit(k), F.lit(before + re.escape(k) + after)) for k in keys or DEFAULT_KEYS])
    return chunks.select(*others, F.to_json(F.struct(found.alias("parameters"))).alias("response"))
