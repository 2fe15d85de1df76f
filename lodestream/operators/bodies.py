"""Request bodies: how each is received, and what a JSON value is as text."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest body in bytes.
MOST_BYTES = 1 << 20


def number_text(x: float) -> str:
    """A double as JavaScript writes it: shortest digits, plain from 1e-6 up to below 1e21."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    digits, _, power = f"{abs(x)!r}".replace("E", "e").partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)  # of the decimal point, from the first digit
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len(figures)
    figures = figures.rstrip("0")
    n = len(figures)
    if n <= point <= 21:
        return sign + figures + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    e = point - 1
    return f"{sign}{figures[0]}{'.' + figures[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def value_text(value) -> str:
    """A parsed JSON value as JavaScript's String gives it; inside an array null is empty."""
    if isinstance(value, str):
        return value
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, dict):
        return "[object Object]"
    if isinstance(value, list):
        return ",".join("" if x is None else value_text(x) for x in value)
    try:
        return number_text(float(value))
    except OverflowError:  # an integer beyond doubles
        return "Infinity" if value > 0 else "-Infinity"


def _json_texts(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: value_text(json.loads(x)), na_action="ignore")


def js_text(kind: Column, raw: Column) -> Column:
    """A JSON value as text, by the kind of its variant and its raw text (a string's: its characters); null and missing give null.

    Strings, booleans, objects and integers of up to 15 digits stay in the JVM;
    only fractions, larger numbers and arrays go to Python, in Arrow batches.
    """
    short = raw.rlike(r"^-?[1-9][0-9]{0,14}$") | (raw == "0")
    string = (kind == "STRING") & raw.isNotNull()
    needs = raw.isNotNull() & ~string & (kind != "BOOLEAN") & (kind != "VOID") & ~kind.startswith("OBJECT") & ~short
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind.startswith("OBJECT"), F.lit("[object Object]"))
        .when((kind == "STRING") | (kind == "BOOLEAN") | short, raw)
        .otherwise(F.pandas_udf(_json_texts, "string")(F.when(needs, raw)))
    )


def classify_bodies(requests: DataFrame, body: str = "body", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds ``refused``, ``expected`` and ``content`` to requests with a body.

    refused: 413 above ``most_bytes`` (of UTF-8); 400 if it isn't JSON or its
    first character but space is neither { nor [; both are answered before any
    record is looked up. 500 for a null body: reading a field of it fails, but
    only where the record exists. Null for a body that is taken. An empty one
    is taken as {}, one of white space is bad.

    expected: ``revision`` if that is a JSON number, else null, as a string, a
    null or none equals no revision. content: ``content`` as text (``js_text``),
    null where it is null or missing. Two differences from the original's parser
    are Spark's: a repeated name and nesting beyond 1,000 levels count as no JSON.
    """
    text = F.when(F.octet_length(F.col(body)) <= most_bytes, F.when(F.col(body) == "", F.lit("{}")).otherwise(F.col(body)))
    parsed = requests.withColumn("_text", text)
    # a parser may stop after the first value; nothing but space can follow it both inside an array and inside an object
    parsed = parsed.withColumn("_list", F.try_parse_json(F.concat(F.lit("["), "_text", F.lit("]")))).withColumn("_json", F.try_parse_json(F.concat(F.lit('{"b":'), "_text", F.lit("}"))))
    wide = F.when(F.col("_list").isNotNull(), F.schema_of_variant(F.try_variant_get("_json", "$.b", "variant")))
    shaped = wide.startswith("OBJECT") | wide.startswith("ARRAY")
    refused = (
        F.when(F.col(body).isNull(), 500)
        .when(F.octet_length(F.col(body)) > most_bytes, 413)
        .when(~F.coalesce(shaped, F.lit(False)), 400)
    )
    fields = F.from_json("_text", "revision DOUBLE, content STRING")
    kind = F.schema_of_variant(F.try_variant_get("_json", "$.b.content", "variant"))
    return (
        parsed.withColumn("refused", refused)
        .withColumn("_f", F.when(F.col("refused").isNull() & wide.startswith("OBJECT"), fields))
        .withColumn("expected", F.col("_f.revision"))
        .withColumn("content", js_text(F.when(F.col("_f").isNotNull(), kind), F.col("_f.content")))
        .drop("_text", "_list", "_json", "_f")
    )
