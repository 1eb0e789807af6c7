"""The constraints a relational store would enforce, checked over whole tables and reported as rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barvault import schemas
from barvault.operators.joins import join_unique
from barvault.schemas import Col

_REPORT = ("table", "rule", "column", "key", "detail")


def _report(rows: DataFrame, table: str, rule: str, column: str, key, detail) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table"),
        F.lit(rule).alias("rule"),
        F.lit(column).alias("column"),
        key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def duplicate_keys(df: DataFrame, table: str, key: str = "ID") -> DataFrame:
    """Key values held by more than one row; ``detail`` is how many."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return _report(counts, table, "unique", key, F.col(key), F.col("_rows"))


def row_violations(
    df: DataFrame,
    table: str,
    columns: Iterable[Col] = (),
    parents: Mapping[str, tuple[DataFrame, str]] | None = None,
    key: str = "ID",
) -> DataFrame:
    """Broken rules that one row shows by itself: NULLs in required columns, over-long text, foreign keys without a parent.

    ``parents`` names, per foreign key column, the parent table and its key. All rules are judged in one pass over the
    table: every foreign key looks for its parent on the way, small parents by broadcast. A NULL foreign key is no
    violation. ``detail`` is the length or the foreign key.
    """
    columns, parents = list(columns), dict(parents or {})
    needed = dict.fromkeys([key, *[c.name for c in columns], *parents])
    rows = df.select(*needed)
    checks = []
    for c in columns:
        value = F.col(c.name)
        if c.required:
            checks.append((value.isNull(), "not_null", c.name, F.lit(None).cast("string")))
        if c.width is not None:
            checks.append((F.length(value) > c.width, "length", c.name, F.length(value).cast("string")))
    for i, (fk, (parent, parent_key)) in enumerate(parents.items()):
        asked, met = f"_asked_{i}", f"_met_{i}"
        # a parent key beyond the column's type is no one's parent; neither is a NULL
        held = parent.select(F.col(parent_key).try_cast(df.schema[fk].dataType).alias(asked)).where(F.col(asked).isNotNull())
        rows = join_unique(rows.withColumn(asked, F.col(fk)), held.distinct().withColumn(met, F.lit(True)), [asked])
        lost = F.col(fk).isNotNull() & F.col(met).isNull()
        checks.append((lost, "foreign_key", fk, F.col(fk).cast("string")))
    if not checks:
        return df.where("false").select(*[F.lit("").alias(c) for c in _REPORT])
    found = F.array(
        *[
            F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column"), detail.alias("detail")))
            for test, rule, name, detail in checks
        ]
    )
    hits = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(found)).alias("v"))
    return hits.select(F.lit(table).alias("table"), "v.rule", "v.column", "key", "v.detail")


def orphans(df: DataFrame, table: str, fk: str, parent: DataFrame, parent_key: str = "ID", key: str = "ID"):
    """Rows whose non-NULL foreign key finds no parent; ``detail`` is the foreign key."""
    return row_violations(df, table, parents={fk: (parent, parent_key)}, key=key)


def value_violations(df: DataFrame, table: str, columns: Iterable[Col], key: str = "ID") -> DataFrame:
    """NULLs in required columns and over-long text, all columns in one pass over the table."""
    return row_violations(df, table, columns, key=key)


def audit_warehouse(tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared constraint over the given warehouse tables, as one report.

    A table is read twice: once for its key, which must be counted, once for all rules of single rows.
    """
    reports = []
    for name, df in tables.items():
        reports.append(duplicate_keys(df, name))
        declared = schemas.FOREIGN_KEYS.get(name, {})
        parents = {fk: (tables[parent], "ID") for fk, parent in declared.items() if parent in tables}
        reports.append(row_violations(df, name, schemas.TABLES[name], parents))
    return reduce(DataFrame.unionByName, reports).select(*_REPORT)
