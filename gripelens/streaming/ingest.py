"""File-drop ingest: every new CSV file is inserted once into the raw table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gripelens.sources.csv import null_tokens_to_null
from gripelens.sources.tables import FOREIGN_NAMES, coerce_records, insert_or_ignore


def read_drops(spark: SparkSession, directory: str, schema: StructType) -> DataFrame:
    """Stream of CSV rows; ``schema`` lists the columns in file order, another header fails."""
    return (
        spark.readStream.schema(schema)
        .options(header="true", quote='"', escape='"', multiLine="true", encoding="UTF-8", enforceSchema="false")
        .csv(directory)
    )


def ingest(
    rows: DataFrame,
    table_path: str,
    checkpoint: str,
    names: Mapping[str, str] = FOREIGN_NAMES,
    continuous: bool = False,
) -> StreamingQuery:
    """Insert each micro-batch with insert-or-ignore.

    A batch that is replayed after a failure adds nothing, since its keys are
    then stored.  By default the query ends when all present files are read.
    """

    def write(batch: DataFrame, _: int) -> None:
        insert_or_ignore(coerce_records(null_tokens_to_null(batch), names), table_path)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()
