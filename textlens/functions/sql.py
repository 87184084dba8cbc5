"""The text and vector functions for use in SQL, as inlined SQL bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textlens.functions import text


def _literal(value: str) -> str:
    return "r'" + value.replace("'", "\\x27") + "'"


def sql_functions() -> dict[str, str]:
    """Signature to body of every function."""
    return {
        "tl_newlines(t STRING) RETURNS STRING": "translate(t, '\\n\\r', ' ')",
        "tl_ascii(t STRING) RETURNS STRING": f"regexp_replace(t, {_literal(text.NON_ASCII)}, '')",
        "tl_links(t STRING) RETURNS STRING": f"regexp_replace(t, {_literal(text.LINK)}, '')",
        "tl_handles(t STRING) RETURNS STRING": f"regexp_replace(t, {_literal(text.HANDLE)}, '')",
        "tl_runs(t STRING) RETURNS STRING": f"regexp_replace(t, {_literal(text.LONG_RUN)}, '$1')",
        "tl_hyphens(t STRING) RETURNS STRING": f"regexp_replace(t, {_literal(text.HYPHENATED)}, '_$1')",
        "tl_strip(t STRING) RETURNS STRING": (
            f"regexp_replace(t, {_literal(f'^[{text.SPACES}]+|[{text.SPACES}]+$')}, '')"
        ),
        "tl_tokens(t STRING) RETURNS ARRAY<STRING>": (
            f"filter(split(lower(regexp_replace(t, {_literal(text.PUNCTUATION_CLASS)}, '')), {_literal(f'[{text.SPACES}]+')}), w -> w <> '')"
        ),
        "tl_cosine(u ARRAY<DOUBLE>, v ARRAY<DOUBLE>) RETURNS DOUBLE": (
            "aggregate(zip_with(u, v, (a, b) -> a * b), 0D, (s, x) -> s + x)"
            " / (sqrt(aggregate(u, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(v, 0D, (s, x) -> s + x * x)))"
        ),
    }


def register(spark: SparkSession) -> None:
    """Create the functions for this session."""
    for signature, body in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
