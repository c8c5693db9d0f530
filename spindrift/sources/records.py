"""Readers: raw record tables, JSON documents and cells, vectors, file hashes, literal and random relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift import domain as D


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def null_tokens(df: DataFrame, tokens: Sequence[str] = tuple(D.NA_TOKENS)) -> DataFrame:
    """Texts that stand for null become null; other types are left alone."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], row_id: str | None = None) -> DataFrame:
    """Every column as text (types are set by rules, never inferred), quoted line breaks and doubled quotes
    kept, null tokens read as null, a byte-order mark dropped. row_id adds the position in the file.

    The header is checked against `columns`: a file with another number of columns is refused.
    """
    # one file with line breaks inside cells cannot be split by Spark; write it to Parquet once
    df = spark.read.schema(string_schema(columns)).option("enforceSchema", False).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = null_tokens(df)
    if row_id is None:
        return df
    from spindrift.operators.ranking import global_index

    at = global_index(df.withColumn("__pos", F.monotonically_increasing_id()), ["__pos"], row_id)
    return at.select(row_id, *(F.col(f"`{c}`") for c in columns))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def json_cell(df: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    return df.withColumn(out, F.from_json(F.col(f"`{column}`"), "map<string,string>"))


def read_vectors(spark: SparkSession, path: str, id_col: str, vec_col: str, width: int | None = None) -> DataFrame:
    """(id, array<double>) of a Parquet matrix; rows of another width are refused."""
    df = spark.read.parquet(path).select(F.col(id_col), F.col(vec_col).cast("array<double>").alias(vec_col))
    if width is not None:
        df = df.withColumn(vec_col, F.when(F.size(vec_col) == width, F.col(vec_col)).otherwise(F.raise_error(F.lit(f"vector width is not {width}")).cast("array<double>")))
    return df


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(id, features) of the rows of one two-dimensional .npy matrix, numbered from 0. The file is mapped, not loaded,
    in tasks of at most 64 MB of rows, so it must be where all executors see it; pickled arrays are refused."""
    import numpy as np

    rows, width = np.load(path, mmap_mode="r", allow_pickle=False).shape
    step = max(1, (64 << 20) // (8 * max(1, width)))
    starts = spark.range(0, rows, step, max(1, -(-rows // step)))

    def run(batches):
        import pyarrow as pa

        m = np.load(path, mmap_mode="r", allow_pickle=False)
        for b in batches:
            for at in b.column(0).to_pylist():
                part = np.asarray(m[at : at + step], dtype=np.float64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype=np.int64)), flat], names=["id", "features"])

    return starts.mapInArrow(run, "id bigint, features array<double>")


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file, hashed where it lies. Files over 2 GB must be hashed by their writer."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def table_hash(df: DataFrame) -> DataFrame:
    """One order-free fingerprint of a table of any size: row count and summed row hashes."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def promoters(spark: SparkSession) -> DataFrame:
    return literal(spark, D.PROMOTERS, "symbol string, electronegativity double, ionic_radius double, atomic_mass double, first_ionization double")


def supports(spark: SparkSession) -> DataFrame:
    return literal(spark, D.SUPPORTS, "name string, support_type string, acid_base int, reducible int")


def random_box(spark: SparkSession, n: int, bounds: Mapping[str, tuple[float, float]], seed: int = 42) -> DataFrame:
    """(draw, columns...) n points drawn uniformly in a box. A point depends on seed, column and number only,
    not on partitioning, so a lost task draws the same points again."""
    def unit(i: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("id")), F.lit(1 << 52)) / F.lit(float(1 << 52))

    cols = [(F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * unit(i)).alias(c) for i, (c, (lo, hi)) in enumerate(bounds.items())]
    return spark.range(n).select(F.col("id").alias("draw"), *cols)
