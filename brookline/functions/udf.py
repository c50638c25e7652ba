"""Opaque Python functions as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


def opaque(function: Callable, kind: str):
    """``function`` of plain values as a function of columns, moved in Arrow batches.

    Only for what column expressions can't say: Catalyst can't look inside.
    """
    return F.udf(function, kind, useArrow=True)
