"""JSON column helpers: structured explanations and provider replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, StringType, StructField,
                               StructType)

from .scores import _c

FACTOR = StructType([
    StructField("feature", StringType()),
    StructField("impact", StringType()),
    StructField("description", StringType()),
])

EXPLANATION = StructType([
    StructField("summary", StringType()),
    StructField("risk_level", StringType()),
    StructField("confidence", DoubleType()),
    StructField("confidence_explanation", StringType()),
    StructField("factors", ArrayType(FACTOR)),
    StructField("llm_reasoning", StringType()),
    StructField("recommendation", StringType()),
    StructField("action", StringType()),
])

SECOND_OPINION = StructType([
    StructField("is_unused", BooleanType()),
    StructField("reasoning", StringType()),
    StructField("key_observations", ArrayType(StringType())),
])


def parse_json_as(text, schema: StructType) -> Column:
    """``from_json`` gated by ``try_parse_json``: invalid JSON gives NULL (not a struct
    of NULLs); missing fields give NULL fields."""
    t = _c(text)
    return F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))


def parse_xai_json(text) -> Column:
    return parse_json_as(text, EXPLANATION)


def reply_content(body) -> Column:
    """``choices[0].message.content`` of a chat-completions reply body (NULL if absent
    or if the body is not JSON)."""
    return F.get_json_object(_c(body), "$.choices[0].message.content")
