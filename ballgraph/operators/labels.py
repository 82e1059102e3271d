"""Labels and categorical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballgraph.session import Scratch
from ballgraph.sources.points import dense_codes

# Display names of the report's metrics; those of methods are given by the caller.
METRIC_NAMES = {
    "trustworthiness": "Trustworthiness",
    "pca_procrustes": "PCA–metric",
    "Wass_H0": "Wasserstein $H_0$",
    "Wass_H1": "Wasserstein $H_1$",
}

# Fixed value: how file names give the label.
PATH_LABEL = r"(?i)obj\s*(\d+)"


#: Codes up to this size are broadcast; a row counts its value and so many bytes more. Beyond, parts of a value.
BROADCAST_BYTES = 32 << 20
CODE_BYTES = 64
SALTS = 32


def label_index(df: DataFrame, col: str, code_col: str = "code", missing: int | None = None) -> DataFrame:
    """Adds the 0-based rank of each value among the sorted distinct values.

    ``missing`` is the code of NULL (-1 as category codes do); NULL keeps a NULL code without it. Codes are broadcast
    where their measured size allows it. Beyond, both sides are salted, so neither NULL nor a value that many rows have
    is the work of one task.
    """
    scratch = Scratch(df.sparkSession, "labels")
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    codes = scratch.save(dense_codes(distinct, col, code_col, scratch), "coded")
    size = codes.agg(F.sum(F.octet_length(F.col(col).cast("string")) + F.lit(CODE_BYTES))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        out = df.join(F.broadcast(codes), col, "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        out = salted.join(codes.withColumn("_salt", salts), [col, "_salt"], "left").drop("_salt")
    if missing is not None:
        out = out.withColumn(code_col, F.coalesce(code_col, F.lit(missing).cast("bigint")))
    return out


def remap(col: Column, mapping: dict) -> Column:
    """Replaces the listed values and keeps all others."""
    out = None
    for old, new in mapping.items():
        test = col == F.lit(old)
        out = F.when(test, F.lit(new)) if out is None else out.when(test, F.lit(new))
    return out.otherwise(col) if out is not None else col


def path_label(path: Column, pattern: str = PATH_LABEL, first: int = 1) -> Column:
    """Number in a file name minus ``first``; NULL when the name carries none."""
    digits = F.regexp_extract(path, pattern, 1)
    return F.when(digits != "", digits.cast("bigint") - F.lit(first))


def dominant_label(labels: DataFrame) -> DataFrame:
    """(id, label, value) -> the label with the largest value per id, the lowest label on ties."""
    best = F.max_by("label", F.struct(F.col("value"), -F.col("label")))
    return labels.groupBy("id").agg(best.alias("label"))


def display_name(key: Column, names: dict[str, str], spaces: bool) -> Column:
    """Mapped name, else the key itself, with blanks for underscores if ``spaces``."""
    fallback = F.replace(key, F.lit("_"), F.lit(" ")) if spaces else key
    if not names:
        return fallback
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, key), fallback)


def one_hot(
    df: DataFrame, columns: list[str], numeric: list[str], max_levels: int = 1000
) -> tuple[DataFrame, list[str]]:
    """Numeric columns first, then one 0/1 column per sorted level; no level is dropped.

    A missing value gives zeros in all its columns. The levels come to the driver because they
    become columns; more than ``max_levels`` of them is an error, not a truncation.
    """
    out, names = [F.col(c).cast("double").alias(c) for c in numeric], list(numeric)
    cells = F.array(*[F.struct(F.lit(n).alias("n"), *[
        (F.col(c) if k == n else F.lit(None).cast(df.schema[c].dataType)).alias(f"l{k}") for k, c in enumerate(columns)
    ]) for n in range(len(columns))])
    # one job for all columns; one row more than allowed shows that there are too many
    found = df.select(F.inline(cells)).distinct().limit(len(columns) * (max_levels + 1) + 1).collect() if columns else []
    for n, c in enumerate(columns):
        levels = [r[n + 1] for r in found if r["n"] == n and r[n + 1] is not None]
        if len(levels) > max_levels or len(found) > len(columns) * (max_levels + 1):
            raise ValueError(f"{c} has more than {max_levels} levels")
        for level in sorted(levels):
            name = f"{c}_{level}"
            out.append(F.coalesce((F.col(c) == F.lit(level)).cast("double"), F.lit(0.0)).alias(name))
            names.append(name)
    kept = [F.col(c) for c in df.columns if c not in columns and c not in numeric]
    return df.select(*kept, *out), names


def one_hot_terms(df: DataFrame, columns: list[str]) -> DataFrame:
    """(id, term, value): the same zeros and ones as a long sparse table, for any number of levels."""
    cells = F.array(*[
        F.struct(F.concat(F.lit(f"{c}_"), F.col(c).cast("string")).alias("term"), F.lit(1.0).alias("value"))
        for c in columns
    ])
    return df.select("id", F.inline(cells)).where(F.col("term").isNotNull())
