"""Extension hooks: a completion callable and an embedding callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


def complete(
    df: DataFrame,
    prompt: str,
    call: Callable[[str], str],
    output: str = "content",
    batch_size: int = 5,
    tries: int = 3,
) -> DataFrame:
    """Add the answer of ``call`` to each prompt; null after ``tries`` failures.

    ``batch_size`` calls run side by side in a task, since a completion mostly
    waits.  Spark decides how many tasks run.
    """
    schema = StructType([*df.schema.fields, StructField(output, StringType(), True)])

    def ask(text: str) -> str | None:
        for _ in range(tries):
            try:
                return call(text)
            except Exception:  # noqa: BLE001 - any provider error counts as one try
                continue
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=batch_size) as pool:
            for frame in frames:
                frame[output] = list(pool.map(ask, frame[prompt]))
                yield frame

    return df.mapInPandas(run, schema)


def embed_with(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    output: str = "embedding",
    batch_size: int = 32,
) -> DataFrame:
    """Add vectors from a user model; ``make_encoder`` loads it once per worker."""
    encode = predict_batch_udf(
        make_encoder, return_type=ArrayType(FloatType()), batch_size=batch_size
    )
    return df.withColumn(output, encode(F.col(text)))
