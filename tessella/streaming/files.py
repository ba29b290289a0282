"""The same predicates and projections over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.plans.lower import lower
from tessella.plans.predicate import Predicate
from tessella.plans.reader import Dataset


def arriving(dataset: Dataset, folder: str, predicate: Predicate | None = None, columns: list[str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over Parquet files added to ``folder``, under the schema of ``dataset``. File order isn't defined."""
    reader = dataset.spark.readStream.schema(dataset._schema[0])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    if predicate is not None:
        df = df.where(lower(dataset.root, predicate))
    return df.select(*dataset.output(columns))
