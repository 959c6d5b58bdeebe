"""Scalar programs: steps of (name, expression) that Spark SQL, DuckDB and numpy evaluate alike.

Expressions use names, arithmetic, double literals and common functions only, so one text serves as Column steps
(whole-stage codegen), as chained SQL for the test oracle, and - read as Python over numpy vectors - inside Arrow kernels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = list[tuple[str, str]]


def lit(x: float) -> str:
    """A double literal in all three languages."""
    text = repr(float(x))
    if "inf" in text or "nan" in text:
        raise ValueError(f"no literal for {x}")
    text = text if "e" in text else text + "e0"
    return f"({text})" if text.startswith("-") else text


_NUMPY = {
    "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "atan": np.arctan, "atan2": np.arctan2, "sinh": np.sinh, "cosh": np.cosh, "asinh": np.arcsinh, "atanh": np.arctanh,
    "exp": np.exp, "ln": np.log, "sqrt": np.sqrt, "power": np.power, "abs": np.abs, "radians": np.radians, "degrees": np.degrees, "least": np.minimum, "greatest": np.maximum, "sign": np.sign, "floor": np.floor,
}


def run_numpy(steps: Steps, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    scope = dict(values)
    with np.errstate(all="ignore"):
        for name, text in steps:
            scope[name] = eval(text, {"__builtins__": {}}, _NUMPY | scope)  # noqa: S307 - texts come from this package only
    return scope


def run_frame(steps: Steps, df: DataFrame) -> DataFrame:
    for name, text in steps:
        df = df.withColumn(name, F.expr(text))
    return df


def run_sql(steps: Steps, source: str) -> str:
    """Nested selects that add each step to the columns of `source` (a relation name or a query in parentheses)."""
    for name, text in steps:
        source = f"(select *, {text} as {name} from {source})"
    return source


def poly(coefficients: list[float], x: float) -> float:
    return math.fsum(c * x**i for i, c in enumerate(coefficients))
