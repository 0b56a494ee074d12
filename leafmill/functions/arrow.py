"""Arrow functions that are made where they are used: workers can import their modules without a session."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def arrow(returns: str):
    """A function over Arrow arrays becomes one over columns."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.arrow_udf(f, returns)(*columns)

        return call

    return wrap
