"""A metric log with mixed payloads as VARIANT: typed access to numbers, texts, flags, lists and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of values by the first word of their VARIANT schema.
KINDS = {"BIGINT": "number", "DOUBLE": "number", "FLOAT": "number", "DECIMAL": "number", "STRING": "text", "BOOLEAN": "flag", "ARRAY": "list", "OBJECT": "object", "VOID": "null"}


def parsed(log: DataFrame, payload: str = "payload") -> DataFrame:
    """``log`` with its JSON payload as VARIANT; text that isn't JSON is null, and records without values go, as the logger drops them."""
    v = F.try_parse_json(payload)
    return log.withColumn(payload, v).filter(F.coalesce(F.schema_of_variant(F.col(payload)) != "OBJECT<>", F.lit(False)))


def metric_values(log: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns of ``log`` (payload VARIANT) but for the payload, and key, kind, number, text, flag, length of each top-level value.

    A number fills ``number``, a flag ``flag``, a text ``text``; a list or object is told by its JSON in ``text``, a list by its length too.  A payload that is no object has no keys.
    """
    spark = log.sparkSession
    rows = log.withColumn("_object", F.when(F.schema_of_variant(payload).startswith("OBJECT"), F.col(payload))).drop(payload)
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("_object").outer())).drop("_object", "pos")
    word = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), word), F.lit("text"))
    get = lambda of, t: F.when(kind == of, F.try_variant_get("value", "$", t))
    text = F.when(kind == "text", F.try_variant_get("value", "$", "string")).when(kind.isin("list", "object"), F.to_json("value"))
    return each.select(*[c for c in log.columns if c != payload], "key", kind.alias("kind"), get("number", "double").alias("number"), text.alias("text"), get("flag", "boolean").alias("flag"),
                       F.when(kind == "list", F.size(F.try_variant_get("value", "$", "array<variant>"))).alias("length"))


def payload_schema(log: DataFrame, payload: str = "payload") -> DataFrame:
    """One row: the schema that covers all payloads, put together in one aggregation."""
    return log.agg(F.schema_of_variant_agg(payload).alias("schema"))
