"""Scalar functions, by family. Importing this package registers them."""

from . import arrays, dates, maths, records, spatial, strings  # noqa: F401
from .registry import FUNCTIONS, Function, function

__all__ = ["FUNCTIONS", "Function", "function"]
