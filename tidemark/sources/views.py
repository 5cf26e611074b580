"""Persistent views: named columns with comments over a query, and their properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def quoted(name: str, whole: bool = False) -> str:
    """A name in backticks, part by part; whole: dots belong to it."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in ([name] if whole else name.split(".")))


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_view(spark: SparkSession, name: str, query: str,
                columns: Sequence[str | tuple[str, str]] = (), *, replace: bool = False) -> None:
    """Create a view. `columns` renames the query's columns in order; a pair adds a comment."""
    listed = [
        quoted(c) if isinstance(c, str) else f"{quoted(c[0])} COMMENT {text_literal(c[1])}" for c in columns
    ]
    head = "CREATE OR REPLACE VIEW" if replace else "CREATE VIEW"
    spark.sql(f"{head} {quoted(name)} {'(' + ', '.join(listed) + ')' if listed else ''} AS {query}")


def drop_view(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP VIEW IF EXISTS {quoted(name)}")


def show_views(spark: SparkSession, namespace: str, like: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW VIEWS IN {quoted(namespace)}" + (f" LIKE {text_literal(like)}" if like else ""))


def describe_view(spark: SparkSession, name: str, extended: bool = False) -> DataFrame:
    return spark.sql(f"DESCRIBE {'EXTENDED ' if extended else ''}{quoted(name)}")


def create_statement(spark: SparkSession, name: str) -> str:
    return spark.sql(f"SHOW CREATE TABLE {quoted(name)}").first()[0]


def view_properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def set_view_properties(spark: SparkSession, name: str, values: dict[str, str]) -> None:
    listed = ", ".join(f"{text_literal(k)} = {text_literal(v)}" for k, v in values.items())
    spark.sql(f"ALTER VIEW {quoted(name)} SET TBLPROPERTIES ({listed})")


def unset_view_properties(spark: SparkSession, name: str, *keys: str) -> None:
    spark.sql(f"ALTER VIEW {quoted(name)} UNSET TBLPROPERTIES ({', '.join(map(text_literal, keys))})")
