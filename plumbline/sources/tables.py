"""Read and write vector, measurement and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed format: cell<number>_sirna<number>_<sample>.png or .pt
CELL_PATTERN = r"^cell(\d+)_sirna(\d+)_(\d+)\.(?:png|pt)$"


def read_vectors(
    spark: SparkSession, path: str, attrs: Sequence[str] = (), id_col: str = "sample_id", features: str = "features"
) -> DataFrame:
    """Vector table with a declared schema: id, attributes, features as doubles. Only these columns are scanned."""
    raw = spark.read.parquet(path)
    missing = [c for c in (id_col, *attrs, features) if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return raw.select(
        F.col(id_col).alias("sample_id"), *[F.col(a).cast("int").alias(a) for a in attrs],
        F.col(features).cast("array<double>").alias("features"),
    )


def read_wide_csv(
    spark: SparkSession, path: str, schema: T.StructType, cols: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """CSV with a declared schema, projected to `cols`; rows with a null among `required` (default all) are dropped."""
    rows = spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED", enforceSchema=False)
    return rows.select(*cols).dropna(subset=list(required or cols))


def parse_condition_key(df: DataFrame, col: str, names: Sequence[str], pattern: str = CELL_PATTERN) -> DataFrame:
    """Integer columns from the groups of a file-name pattern; names that do not match are dropped."""
    text = F.trim(F.element_at(F.split(F.col(col), "/"), -1))
    parts = {n: F.expr(f"try_cast(nullif(_g{i}, '') as int)") for i, n in enumerate(names, 1)}
    out = df.withColumns({f"_g{i}": F.regexp_extract(text, pattern, i) for i in range(1, len(names) + 1)})
    out = out.withColumns(parts).drop(*[f"_g{i}" for i in range(1, len(names) + 1)])
    return out.dropna(subset=list(names))


def parse_attribute_map(col: str) -> Column:
    """`Blond_Hair0_Male1_7.png` -> {Blond_Hair: 0, Male: 1}: tokens join until one ends in 0 or 1; the index is cut."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(col), "/"), -1), r"\.[^.]*$", "")
    body = F.regexp_replace(stem, r"_[^_]*$", "")
    pattern = F.lit(r"(?:^|_)([^_].*?)([01])(?=_|$)")
    names, values = (F.regexp_extract_all(body, pattern, F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(names, F.transform(values, lambda v: v.cast("int")))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Result sink; nested columns become JSON text for CSV."""
    if fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_scores(spark: SparkSession, path: str, attrs: Sequence[str] = ()) -> DataFrame:
    """Score table from JSON lines; NaN and missing values are null."""
    fields = [T.StructField("sample_id", T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("trust", "realism_z", "faithfulness_z")]
    fields += [T.StructField(a, T.IntegerType()) for a in attrs]
    rows = spark.read.schema(T.StructType(fields)).json(path)
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("trust", "realism_z", "faithfulness_z")}
    return rows.withColumns(clean)
