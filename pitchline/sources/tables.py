"""Table readers: only the columns a query names reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not known yet: the incremental load."""
    return incoming.join(known.select(key).distinct(), key, "left_anti")


def latest_wins(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert without row updates: of each key the row that comes last by ``order``."""
    both = base.unionByName(changes, allowMissingColumns=True)
    row = F.max_by(F.struct(*both.columns), F.struct(*order))
    return both.groupBy(*keys).agg(row.alias("_r")).select("_r.*")


def insert_new(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that does nothing on a known key: ``base`` and the incoming rows with new keys, each key once."""
    fresh = incoming.join(base.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return base.unionByName(fresh, allowMissingColumns=True)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` without the rows whose keys ``gone`` names; null keys are never named."""
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def update_from(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """UPDATE ... FROM: ``columns`` of ``base`` from the matching row of ``changes``, whose keys are unique.

    Rows without a match stay as they are; a null in a matching row is taken over.
    """
    new = changes.select(*keys, F.struct(*columns).alias("_new"))
    out = base.join(new, keys, "left")
    return out.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def with_added(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """ALTER ADD COLUMN: ``df`` with each of ``columns`` (name: type) that it lacks, null; what it has stays."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns}) if columns else df


def where_given(df: DataFrame, equals: dict | None = None, contains: dict | None = None, since: dict | None = None, until: dict | None = None) -> DataFrame:
    """``df`` filtered by the conditions that are given: a None asks nothing, a list means one of it, an empty list none.

    ``contains`` ignores letter case; ``since`` is inclusive, ``until`` exclusive.
    """
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple)) and v else F.lit(False) if isinstance(v, (list, tuple)) else F.col(c) == v)
    for c, v in (contains or {}).items():
        df = df if v is None else df.where(F.contains(F.lower(F.col(c)), F.lit(v.lower())))
    for c, v in (since or {}).items():
        df = df if v is None else df.where(F.col(c) >= F.lit(v))
    for c, v in (until or {}).items():
        df = df if v is None else df.where(F.col(c) < F.lit(v))
    return df


def match_files(spark: SparkSession, root: str, formats: list[str], genders: list[str], name: str = "matches") -> DataFrame:
    """All files ``<name>_<format>_<gender>*.parquet`` below ``root`` as one frame with ``format`` and ``gender``;
    columns that a file lacks are null, combinations without files are left out."""
    parts = []
    path = spark._jvm.org.apache.hadoop.fs.Path
    for f in formats:
        for g in genders:
            pattern = f"{root}/{name}_{f}_{g}*.parquet"
            at = path(pattern)
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
                parts.append(spark.read.option("mergeSchema", True).parquet(pattern).withColumn("format", F.lit(f)).withColumn("gender", F.lit(g)))
    if not parts:
        raise FileNotFoundError(f"no {name} files for {formats} and {genders} in {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
