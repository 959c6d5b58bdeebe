"""Functions for Spark SQL: point transforms between CRSs, affine transforms of pixels, nodata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridspark.plans.grid import transform

_SIX = "t STRUCT<a: DOUBLE, b: DOUBLE, c: DOUBLE, d: DOUBLE, e: DOUBLE, f: DOUBLE>"
_DET = "(t.a * t.e - t.b * t.d)"
#: name -> (parameters, result type, body); plain expressions, which Catalyst inlines.
SQL_FUNCTIONS = {
    "affine_forward": (f"col DOUBLE, row DOUBLE, {_SIX}", "STRUCT<x: DOUBLE, y: DOUBLE>", "named_struct('x', t.a * col + t.b * row + t.c, 'y', t.d * col + t.e * row + t.f)"),
    "affine_inverse": (
        f"x DOUBLE, y DOUBLE, {_SIX}", "STRUCT<col: DOUBLE, row: DOUBLE>",
        f"named_struct('col', try_divide(t.e * (x - t.c) - t.b * (y - t.f), {_DET}), 'row', try_divide(t.a * (y - t.f) - t.d * (x - t.c), {_DET}))",
    ),
    "is_nodata": ("v DOUBLE, nodata DOUBLE", "BOOLEAN", "v IS NULL OR isnan(v) OR coalesce(v = nodata, false)"),
}


@F.pandas_udf(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
def transform_point(x: pd.Series, y: pd.Series, src_crs: pd.Series, dst_crs: pd.Series) -> pd.DataFrame:
    """Coordinates in dst_crs; null where a coordinate or a CRS is null.  Each pair of CRSs in a batch is done at once."""
    out = pd.DataFrame({"x": np.full(len(x), np.nan), "y": np.full(len(x), np.nan)})
    at = pd.DataFrame({"s": src_crs.to_numpy(), "d": dst_crs.to_numpy()})
    for (s, d), rows in at.groupby(["s", "d"]).indices.items():
        u, v = transform(s, d, x.to_numpy()[rows], y.to_numpy()[rows])
        out.iloc[rows, 0], out.iloc[rows, 1] = u, v
    out[x.isna().to_numpy() | y.isna().to_numpy()] = np.nan
    return out


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL."""
    spark.udf.register("transform_point", transform_point)
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
