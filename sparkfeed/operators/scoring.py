"""A user's scoring function over batches of rows, and over requests that keep their ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import decode_requests

Scorer = Callable[[np.ndarray], np.ndarray]


def score(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` applied to each Arrow batch of rows."""

    def run(frames):
        for frame in frames:
            yield f(frame)

    return df.mapInPandas(run, schema)


def score_features(df: DataFrame, f: Scorer, features: str = "features", output: str = "output") -> DataFrame:
    """``df`` with ``output``: ``f`` of the matrix of features. Rows are stacked by the length of
    their features, so unequal ones are scored apart; null features give null."""

    def run(frames):
        for frame in frames:
            out = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            lengths = frame[features].map(lambda x: -1 if x is None else len(x))
            for n, part in frame[features].groupby(lengths):
                if n >= 0:
                    made = np.asarray(f(np.stack([np.asarray(x, np.float64) for x in part])), np.float64)
                    out.loc[part.index] = pd.Series(list(made.reshape(len(part), -1)), index=part.index)
            yield frame.assign(**{output: out})

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def score_requests(requests: DataFrame, f: Scorer, cid: str = "cid", payload: str = "payload") -> DataFrame:
    """``(cid, output, error)`` of a stream or table of requests: each result goes back under the id
    of its request, as does the reason why there is none."""
    decoded = decode_requests(requests, payload).select(cid, "input", "error")
    return score_features(decoded, f, "input").select(cid, "output", "error")
