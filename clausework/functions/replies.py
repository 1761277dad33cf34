"""Model replies (JSON text) to item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# With up to 15 digits and from 1e-4 up, Python spells a decimal without needless zeros just so.
_PLAIN_FLOAT = "^-?(0[.](?!0000)|[1-9][0-9]*[.])([0-9]*[1-9]|0)$"
# And these with an exponent, whose spelling alone differs.
_EXPONENT_FLOAT = "^-?[0-9][.][0-9]{1,14}E(-[5-9]|-[1-9][0-9]|1[6-9]|[2-9][0-9]|[1-9][0-9][0-9])$"
_SHORT_INTEGER = "^-?[0-9]{1,18}$"


def _python_float_by_trial(x: Column) -> Column:
    """As ``python_float``, for any double: the fewest digits that give the number back are tried out."""
    short = F.coalesce(*[
        F.when(made.try_cast("double") == x, made) for made in (F.format_string(f"%.{n}e", x) for n in (0, 14, 15, 16))
    ], F.format_string("%.16e", x))
    short = F.regexp_replace(F.regexp_replace(short, "([.][0-9]*?)0+e", "$1e"), "[.]e", "e")
    size = F.abs(x)
    return F.when((size >= 1e-4) & (size < 1e16), _plain(short)).otherwise(short)


def _plain(text: Column) -> Column:
    """A decimal without exponent or needless zeros."""
    digits = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)


def python_float(x: Column) -> Column:
    """A double as Python spells it: plain from 1e-4 up to 1e16, else with a two-digit exponent at least.

    Spark's own spelling gives the number back. With up to 15 digits it is then the only one so short, so
    just its exponent has to move; the rest is tried out. Spelled inside arrays, which keeps the long
    expression out of the generated code.
    """
    def spelled(x: Column, text: Column) -> Column:
        size, digits = F.abs(x), F.substring_index(text, "E", 1)
        power = F.substring_index(text, "E", -1).try_cast("int")
        pair = F.abs(power).cast("string")
        exponent = F.concat(
            F.regexp_replace(digits, "[.]0$", ""), F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.when(F.length(pair) < 2, F.concat(F.lit("0"), pair)).otherwise(pair),
        )
        return (
            F.when((F.length(digits) > 16) | (size < 1e-300), _python_float_by_trial(x))
            .when(~text.contains("E"), text)
            .when((size >= 1e-4) & (size < 1e16), _plain(text))
            .otherwise(exponent)
        )

    # The number and its spelling are made once and then named, not once for each place they stand in.
    pair = F.array(F.struct(x.alias("x"), x.cast("string").alias("text")))
    return F.get(F.transform(pair, lambda v: spelled(v["x"], v["text"])), F.lit(0))


def _moved_exponent(text: Column) -> Column:
    """Python's spelling of what ``_EXPONENT_FLOAT`` fits: 1.0E-7 is 1e-07, 2.5E20 is 2.5e+20."""
    short, one_digit = F.replace(text, F.lit(".0E"), F.lit("E")), F.substring(text, -2, 1) == "-"
    return (
        F.when(one_digit, F.replace(short, F.lit("E-"), F.lit("e-0")))
        .when(short.contains("E-"), F.replace(short, F.lit("E-"), F.lit("e-")))
        .otherwise(F.replace(short, F.lit("E"), F.lit("e+")))
    )


def _float_text(json: Column) -> Column:
    """A number with point or exponent as Python spells it. What is usual needs no more than a look at the text."""
    x = json.try_cast("double")
    java = x.cast("string")
    return (
        F.when((F.length(json) <= 16) & json.rlike(_PLAIN_FLOAT), json)
        .when(json.rlike(_EXPONENT_FLOAT), _moved_exponent(json))
        .when(json.contains("0.0000") & java.rlike(_EXPONENT_FLOAT), _moved_exponent(java))
        .otherwise(python_float(x))
    )


def _text_or_null(field: Column, json: Column) -> Column:
    """A field, of which ``json`` is the JSON, as text; null when missing or falsy (null, '', 0, false, [], {})."""
    # Only a string can hold a backslash; any other is what stands between the quotes.
    string = F.when(json.contains("\\"), F.try_variant_get(field, "$", "string")).otherwise(
        F.substring(json, F.lit(2), F.length(json) - 2)
    )
    zero = (json.startswith("0") | json.startswith("-0")) & (json.try_cast("double") == 0)
    return (
        F.when(json.isNull() | json.isin("null", '""', "false", "[]", "{}"), F.lit(None))
        .when(json.startswith('"'), string)
        .when(json == "true", F.lit("True"))
        .when(json.startswith("[") | json.startswith("{"), json)
        .when(zero, F.lit(None))
        .when(json.contains(".") | json.contains("E"), _float_text(json))
        # Integers stay as they are; those too long for a bigint come as decimals without a point, as whole floats do.
        # Their type is costly to ask for.
        .when(json.rlike(_SHORT_INTEGER) & F.schema_of_variant(field).startswith("DECIMAL"), python_float(json.try_cast("double")))
        .otherwise(json)
    )


def reply_items(replies: DataFrame, response: str = "response") -> DataFrame:
    """One row per usable item: other columns, ``pos``, ``parameter_key``, ``value``, ``spatial``.

    A reply is an object with a "parameters" array or a bare array; anything else, and bad JSON,
    yields nothing. Items that are not objects are skipped but still count for generated names.
    """
    others = [c for c in replies.columns if c != response]
    parsed = F.try_parse_json(F.col(response))
    items = F.coalesce(
        F.try_variant_get(F.col("_reply"), "$.parameters", "array<variant>"),
        F.try_variant_get(F.col("_reply"), "$", "array<variant>"),
    )
    # One access per item takes all fields out; anything but an object gives null and is dropped
    # inside the array, where no pushed-down filter repeats the access.
    shape = "struct<key: variant, name: variant, value: variant, spatial: variant>"
    objects = F.filter(
        F.transform(
            items, lambda x, i: F.struct(i.alias("pos"), F.try_variant_get(x, "$", shape).alias("_fields"))
        ),
        lambda x: x["_fields"].isNotNull(),
    )
    names = ("key", "name", "value")
    exploded = (
        replies.select(*others, parsed.alias("_reply"))
        .select(*others, F.inline(objects))
        .select(*others, "pos", *[F.col(f"_fields.{n}").alias(f"_{n}") for n in (*names, "spatial")])
        .select("*", *[F.to_json(f"_{n}").alias(f"_{n}_json") for n in names])
    )
    key, name, value = [_text_or_null(F.col(f"_{n}"), F.col(f"_{n}_json")) for n in names]
    return exploded.select(
        *others,
        "pos",
        F.coalesce(key, name, F.concat(F.lit("param_"), (F.col("pos") + 1).cast("string"))).alias("parameter_key"),
        F.coalesce(value, F.lit("")).alias("value"),
        F.when(~F.is_variant_null(F.col("_spatial")), F.col("_spatial")).alias("spatial"),
    )


def spatial_struct(spatial: Column) -> Column:
    """Bounding box fields of a spatial VARIANT."""
    def number(name):
        return F.try_variant_get(spatial, f"$.{name}", "double")

    return F.struct(
        number("page").cast("int").alias("page"),
        *[number(n).alias(n) for n in ("x_min", "y_min", "x_max", "y_max", "page_width", "page_height")],
    )
