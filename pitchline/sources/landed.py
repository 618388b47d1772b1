"""Landed JSON documents whose shape drifts.

Documents are parsed once, as variants, so that no schema has to be known or
guessed from a sample.  A table is described by where its rows and columns
have been over the versions; what cannot be read is set aside with a reason,
and the rest of its document is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column: its type and its paths, latest first; ``of_document`` paths start at the document, not at the row."""

    kind: str
    paths: tuple[str, ...]
    required: bool = False
    of_document: bool = False


@dataclass(frozen=True)
class Layout:
    """A table: the paths of its array of rows, latest first (none: a document is a row), and its columns."""

    rows: tuple[str, ...] = ()
    fields: dict[str, Field] = field(default_factory=dict)


def parsed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``doc``, the document as a variant, and ``reason``: why there is none, else null."""
    rows = df.withColumn("_v", F.try_parse_json(F.col(text)))
    v = F.col("_v")
    whole = F.ltrim(F.col(text), F.lit(" \t\r\n")).startswith("{")  # of valid JSON the first character tells
    reason = F.when(F.col(text).isNull(), "no text").when(v.isNull(), "not JSON").when(~whole, "not an object")
    return rows.withColumns({"doc": F.when(whole, v), "reason": reason}).drop("_v")


def versions(docs: DataFrame) -> DataFrame:
    """``shape, n``: the shapes that documents have, and how many have each."""
    return docs.where("doc is not null").groupBy(F.schema_of_variant("doc").alias("shape")).agg(F.count("*").alias("n"))


def merged_schema(docs: DataFrame) -> str:
    """One type that all documents fit, found by an aggregate over all of them."""
    return docs.agg(F.schema_of_variant_agg("doc")).first()[0]


def _first(v: Column, paths: tuple[str, ...], kind: str) -> Column:
    found = [F.try_variant_get(v, p, kind) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def _present(v: Column, paths: tuple[str, ...]) -> Column:
    """Whether a path has a value other than JSON's null."""
    out = F.lit(False)
    for p in paths:
        part = F.try_variant_get(v, p, "variant")
        out = out | (part.isNotNull() & ~F.coalesce(F.is_variant_null(part), F.lit(True)))
    return out


def _fault(at: Column, name: str, f: Field) -> Column:
    """What is wrong with the column ``name``, read from ``at`` before, else null."""
    lost = F.col(f"_{name}").isNull()
    odd = F.when(lost & _present(at, f.paths), f"{name} is not {f.kind}")
    return F.coalesce(odd, F.when(lost, f"no {name}")) if f.required else odd


def _with_fields(rows: DataFrame, at: str, fields: dict[str, Field]) -> DataFrame:
    """``rows`` with ``_<name>`` and ``_fault_<name>`` of each field; a value is read once, and asked for its fault then."""
    rows = rows.withColumns({f"_{name}": _first(F.col(at), f.paths, f.kind) for name, f in fields.items()})
    return rows.withColumns({f"_fault_{name}": _fault(F.col(at), name, f) for name, f in fields.items()}).drop(at)


def extracted(docs: DataFrame, layout: Layout, keys: list[str]) -> DataFrame:
    """``keys, place``, the columns of ``layout`` and ``reason``: a row for each row of each document.

    ``place`` is the row's number in its document, from 0.  A column takes the
    first of its paths that can be read as its type; null where none has a
    value.  ``reason`` names the first column that has a value which cannot be
    read, or is required and has none.  A document whose ``doc`` is null, or
    that has something other than an array where rows should be, gives one row
    without place that carries the reason; one without that path has no rows.
    """
    shared = {name: f for name, f in layout.fields.items() if f.of_document}
    own = {name: f for name, f in layout.fields.items() if not f.of_document}
    if layout.rows:
        docs = docs.withColumn("_rows", _first(F.col("doc"), layout.rows, "array<variant>"))
        odd = F.when(F.col("_rows").isNull() & _present(F.col("doc"), layout.rows), "rows are not an array")
        docs = docs.withColumn("reason", F.coalesce("reason", odd))
    else:
        docs = docs.withColumn("_rows", F.array("doc"))
    held = _with_fields(docs.select(*keys, "doc", "reason", "_rows"), "doc", shared)
    lost = F.array(F.lit(None).cast("variant"))  # one row that carries the reason
    held = held.withColumn("_rows", F.when(F.col("reason").isNull(), F.col("_rows")).otherwise(lost))
    # outer, and empty ones dropped after: else Spark asks for rows before, by a filter that parses each document many times
    rows = held.select(*(c for c in held.columns if c != "_rows"), F.posexplode_outer("_rows").alias("_at", "_row")).where("_at is not null")
    rows, whole = _with_fields(rows, "_row", own), F.col("reason").isNull()
    columns = [F.when(whole, F.col(f"_{name}")).alias(name) for name in layout.fields]
    faults = [F.col(f"_fault_{name}") for name in layout.fields]
    return rows.select(*keys, F.when(whole, F.col("_at")).alias("place"), *columns, F.coalesce("reason", *faults).alias("reason"))


def good_and_aside(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without a reason, and those set aside."""
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")
