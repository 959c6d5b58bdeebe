"""Point transforms on streams: stateless, so they are the batch plan with a stream at its foot."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridspark.operators.warp import transform_points


def stream_points(stream: DataFrame, src_crs: str, dst_crs: str, x: str = "x", y: str = "y", out: tuple[str, str] = ("x_out", "y_out")) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed; use transform_points for a table")
    return transform_points(stream, src_crs, dst_crs, x, y, out)
