"""Text vectors, their metadata and their reduction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gripelens.operators.hooks import embed_with
from gripelens.operators.ranking import with_row_index

DIMENSION = 1024
REDUCED = 15


def embed_texts(
    df: DataFrame,
    text: str = "formatted_text",
    key: str = "feedback_id",
    dimension: int = DIMENSION,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """(key, embedding): hashed TF-IDF of length one, or a user model's vectors."""
    if make_encoder is not None:
        return embed_with(df.select(key, text), text, make_encoder).select(key, "embedding")
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    model = Pipeline(
        stages=[
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\w+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimension),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
    ).fit(rows)
    return model.transform(rows).select(
        key, vector_to_array("_unit", "float32").alias("embedding")
    )


def embedding_metadata(vectors: DataFrame, key: str = "feedback_id") -> DataFrame:
    """(key, embedding_index from 0 by key, dimension)."""
    sizes = vectors.select(key, F.size("embedding").alias("dimension"))
    return with_row_index(sizes, [key], "embedding_index").select(
        key, "embedding_index", "dimension"
    )


def reduce_dimensions(
    vectors: DataFrame,
    components: int = REDUCED,
    key: str = "feedback_id",
    vector: str = "embedding",
) -> DataFrame:
    """(key, reduced): principal components of the centred vectors.

    The driver holds one covariance matrix, whose size depends on the dimension
    alone.
    """
    features = vectors.select(key, array_to_vector(vector).alias("_v"))
    model = Pipeline(
        stages=[
            StandardScaler(inputCol="_v", outputCol="_centred", withMean=True, withStd=False),
            PCA(k=components, inputCol="_centred", outputCol="_pc"),
        ]
    ).fit(features)
    return model.transform(features).select(key, vector_to_array("_pc").alias("reduced"))
