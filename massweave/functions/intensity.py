"""Intensity transforms and their inverses as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "none": lambda x: x,
    "log10": lambda x: F.log10(x + 1),
    "log10t3": lambda x: F.log10(x / 3 + 1),
    "loge": lambda x: F.log1p(x),
    "sqrt": F.sqrt,
}
INVERSES: dict[str, Callable[[Column], Column]] = {
    "none": lambda y: y,
    "log10": lambda y: F.pow(F.lit(10.0), y) - 1,
    "log10t3": lambda y: (F.pow(F.lit(10.0), y) - 1) * 3,
    "loge": lambda y: F.exp(y) - 1,
    "sqrt": lambda y: y * y,
}
TOPS = {"none": 1000.0, "log10": math.log10(1001), "log10t3": math.log10(1000 / 3 + 1), "loge": math.log(1001), "sqrt": math.sqrt(1000)}


def transform(name: str, x: Column) -> Column:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}; one of {sorted(TRANSFORMS)}")
    return TRANSFORMS[name](x)


def untransform(name: str, y: Column, most: Column) -> Column:
    """The inverse after scaling the spectrum's maximum ``most`` to the transform's value at 1000; not below 0."""
    if name not in INVERSES:
        raise ValueError(f"unknown transform {name}; one of {sorted(INVERSES)}")
    return F.greatest(INVERSES[name](y / (most + 1e-7) * TOPS[name]), F.lit(0.0))


def floored_log(x: Column, eps: float = 1e-7) -> Column:
    return F.ln(F.greatest(x, F.lit(eps)))
