"""Tables to rasters and back: pixel tables, tile tables, the Parquet tile store, and rasterised aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.kernels import DTYPES, checked_dtype

TILE = (256, 256)


def keyed_pixels(table: DataFrame, key: str, value: Column, width: int) -> DataFrame:
    """(row, col, v) of a table whose dense key counts pixels row by row."""
    k = F.col(key)
    return table.select(F.floor(k / width).cast("int").alias("row"), (k % width).cast("int").alias("col"), value.alias("v"))


def rasterise(table: DataFrame, row: Column, col: Column, value: Column, how: str = "sum") -> DataFrame:
    """Aggregate rows into pixels: sum, avg, min, max or count."""
    if how not in ("sum", "avg", "min", "max", "count"):
        raise ValueError(f"Unknown aggregate: {how}")
    return table.select(row.cast("int").alias("row"), col.cast("int").alias("col"), value.alias("v")).groupBy("row", "col").agg(getattr(F, how)("v").alias("v"))


def schema_of(df: DataFrame, keys: tuple[str, ...]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def pixels_to_tiles(pixels: DataFrame, shape: tuple[int, int], dtype: str, keys: tuple[str, ...] = (), tile: tuple[int, int] = TILE, fill: float = 0.0) -> DataFrame:
    """(keys, tile_row, tile_col, r0, c0, h, w, data): little-endian row-major tiles; pixels that are missing or null get `fill`."""
    kind = DTYPES[checked_dtype(dtype)][0]
    th, tw = tile

    def pack(t: pa.Table) -> pa.Table:
        tr, tc = t.column("tile_row")[0].as_py(), t.column("tile_col")[0].as_py()
        r0, c0 = tr * th, tc * tw
        h, w = min(th, shape[0] - r0), min(tw, shape[1] - c0)
        out = np.full((h, w), fill, kind)
        v = t.column("v").cast(pa.float64()).fill_null(fill).to_numpy()
        out[t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0] = v
        head = {k: t.column(k).slice(0, 1) for k in keys}
        return pa.table(head | {"tile_row": pa.array([tr], pa.int32()), "tile_col": pa.array([tc], pa.int32()), "r0": pa.array([r0], pa.int32()), "c0": pa.array([c0], pa.int32()), "h": pa.array([h], pa.int32()), "w": pa.array([w], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    placed = pixels.where(f"row between 0 and {shape[0] - 1} and col between 0 and {shape[1] - 1}").withColumn("tile_row", F.floor(F.col("row") / th).cast("int")).withColumn("tile_col", F.floor(F.col("col") / tw).cast("int"))
    return placed.groupBy(*keys, "tile_row", "tile_col").applyInArrow(pack, schema_of(pixels, keys) + "tile_row int, tile_col int, r0 int, c0 int, h int, w int, data binary")


def tiles_to_pixels(tiles: DataFrame, dtype: str, keys: tuple[str, ...] = ()) -> DataFrame:
    kind, sql, *_ = DTYPES[checked_dtype(dtype)]
    arrow = {"double": pa.float64(), "float": pa.float32(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32()}[sql]

    def unpack(batches):
        for batch in batches:
            r0, c0, w = (batch.column(k).to_numpy() for k in ("r0", "c0", "w"))
            data = batch.column("data")
            for i in range(batch.num_rows):  # one tile at a time bounds what a batch makes
                v = np.frombuffer(data[i].as_buffer(), kind)
                r, c = np.divmod(np.arange(len(v), dtype=np.int32), w[i])
                cols = [pa.repeat(batch.column(k)[i], len(v)) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, pa.array((r + r0[i]).astype(np.int32)), pa.array((c + c0[i]).astype(np.int32)), pa.array(v).cast(arrow)], [*keys, "row", "col", "v"])

    return tiles.select(*keys, "r0", "c0", "h", "w", "data").mapInArrow(unpack, schema_of(tiles, keys) + f"row int, col int, v {sql}")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Parquet tile store, a folder per tile row, so that a window reads its rows only."""
    tiles.write.partitionBy("tile_row").parquet(path)


def read_tiles(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """rows: first and last tile row wanted (partition pruning)."""
    df = spark.read.parquet(path)
    return df if rows is None else df.where(F.col("tile_row").between(*rows))
