"""Word splitting and column guards shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside these (ASCII white space).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    plain = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    # splitting at one character needs no regular expression; runs leave empty strings
    return F.array_remove(F.split(plain, " "), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as make it new to ``df``, whose columns may be called anything."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A lambda variable is bound once, where an expression that is used inside a
    higher-order function would be evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
