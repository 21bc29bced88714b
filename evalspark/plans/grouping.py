"""Shared shape of the reports: reduce once to the finest groups, then roll the small result up.

The first ``groupBy`` combines on the map side, so a category or split that holds most rows costs one
partial row per task.  Levels are unfolded only after that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERALL = "Overall"


def partial_sums(df: DataFrame, groups: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*dict.fromkeys(groups)).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def unfold_levels(partial: DataFrame, by: Sequence[str], levels: Mapping[str, Column | str | None], sums: Sequence[str]) -> DataFrame:
    """Sums per ``by, level, key``; a level without a column is the overall one; NULL keys are left out."""
    def key(c: Column | str | None) -> Column:
        return F.lit(OVERALL) if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")

    entries = F.array(*[F.struct(F.lit(k).alias("level"), key(c).alias("key")) for k, c in levels.items()])
    rows = partial.select(*by, *sums, F.explode(entries).alias("_e")).where(F.col("_e.key").isNotNull())
    return rows.groupBy(*by, "_e.level", "_e.key").agg(*[F.sum(s).alias(s) for s in sums])


def level_sums(df: DataFrame, by: Sequence[str], levels: Mapping[str, str | None], sums: Mapping[str, Column]) -> DataFrame:
    columns = [c for c in levels.values() if c is not None]
    return unfold_levels(partial_sums(df, [*by, *columns], sums), by, levels, list(sums))


def level_means(df: DataFrame, by: Sequence[str], levels: Mapping[str, str | None], value: str, scale: float = 1.0) -> DataFrame:
    """``by, level, key, n, score`` with ``score`` the mean of ``value`` times ``scale``."""
    v = F.col(value).cast("double")
    sums = level_sums(df, by, levels, {"total": v, "n": F.col(value).isNotNull().cast("bigint")})
    return sums.select(*by, "level", "key", "n", (F.try_divide("total", "n") * scale).alias("score"))


def rename_keys(report: DataFrame, names: Mapping[str, str], key: str = "key") -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return report.withColumn(key, F.coalesce(F.try_element_at(table, F.col(key)), F.col(key)))


def to_wide(report: DataFrame, rows: Sequence[str], keys: Sequence[str] | None = None, key: str = "key", value: str = "score",
            prefer: str = "category") -> DataFrame:
    """One column per key.  Where two levels share a key the ``prefer`` level counts."""
    best = F.max_by(value, (F.col("level") == prefer).cast("int")) if "level" in report.columns else F.first(value)
    pivot = report.groupBy(*rows)
    return (pivot.pivot(key) if keys is None else pivot.pivot(key, list(keys))).agg(best)


def merge_measures(parts: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Measures of the same groups, computed apart, as one row per group (no join without keys)."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.groupBy(*by).agg(*[F.max(c).alias(c) for c in merged.columns if c not in by])


def as_fixed(c: Column | str, places: int = 2) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_number(F.col(c) if isinstance(c, str) else c, "0." + "0" * places)


def constant_rows(df: DataFrame, by: Sequence[str], dims: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Every ``by`` group present in ``df`` with every entry of a fixed dimension list."""
    entries = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(d, names, strict=True)]) for d in dims])
    groups = df.select(*by).distinct() if by else df.groupBy().agg(F.count(F.lit(1)).alias("_n")).drop("_n").select()
    return groups.select(*by, F.explode(entries).alias("_d")).select(*by, "_d.*")
