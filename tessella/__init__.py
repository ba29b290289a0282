"""tessella: a PySpark-native analytics layer for Parquet datasets."""

from tessella.plans import predicate
from tessella.plans.reader import BadOptions, Dataset, open_dataset
from tessella.sources.footer import Footer, read_footers

__all__ = ["BadOptions", "Dataset", "Footer", "open_dataset", "predicate", "read_footers"]
