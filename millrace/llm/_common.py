"""What the operators of this subpackage share: the shared folder, written intermediate tables, and bounded caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped as shipped
from ..tables import new_path as new_path
from ..tables import only_rows as only_rows
from ..tables import shared_dir as shared_dir
from ..tables import written as written

#: Columns of the documents table; the pipeline stages hand on exactly these.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The word class of all contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called c0, c1, ..., so that columns of an operator's own cannot clash with them, and the new names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), {c: f"c{i}" for i, c in enumerate(df.columns)}


def bind(value, body):
    """``body`` of ``value`` with value computed once: lambda variables are not expanded again as repeated expressions are."""
    return F.transform(F.array(value), body)[0]


class TwoGenerations(dict):
    """A bounded cache: when the young generation is full it becomes the old one, and hits in the old one move up.

    Keys over ``longest`` are made anew each time, so that entries stay small.
    """

    def __init__(self, make, limit: int, longest: int = 256):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
