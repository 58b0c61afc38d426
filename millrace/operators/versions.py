"""Tables that are replaced as one act: versions in folders of their own, and a pointer that names the current one.

A new version is written whole and checked before the pointer moves, by one rename over the old pointer. A write that fails or is refused, at
any point, leaves the version before in place and readable. The version before stays for readers that have it open; older ones are deleted with
the next replacement.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import replaced_chunks, valid_sets


class Refused(ValueError):
    """A new version broke a rule; ``problems`` are up to twenty of the rows that tell which."""

    def __init__(self, problems: list):
        super().__init__(f"refused: {problems}")
        self.problems = problems


class Versioned:
    """A table at ``root``: ``v-<name>`` folders of Parquet files and the file CURRENT with the names of the current version and the one before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._at = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._at("CURRENT").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """The current version and the one before, as far as there are any."""
        if not self._fs.exists(self._at("CURRENT")):
            return []
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0].split(" ")

    def read(self) -> DataFrame:
        names = self.names()
        if not names:
            raise FileNotFoundError(f"{self.root} has no version")
        return self.spark.read.parquet(f"{self.root}/v-{names[0]}")

    def replace(self, rows: DataFrame, problems: Callable[[DataFrame], DataFrame] | None = None) -> str:
        """Writes a new version and makes it the current one; ``problems`` gives the rows that speak against it, if any (none may)."""
        before, name = self.names(), uuid.uuid4().hex
        try:
            rows.write.parquet(f"{self.root}/v-{name}")
            if problems is not None:
                against = problems(self.spark.read.parquet(f"{self.root}/v-{name}")).limit(20).collect()  # for the message
                if against:
                    raise Refused([r.asDict() for r in against])
            self._point(" ".join([name, *before[:1]]))
        except BaseException:
            if self.names()[:1] != [name]:
                self._fs.delete(self._at(f"v-{name}"), True)
            raise
        for old in before[1:]:
            self._fs.delete(self._at(f"v-{old}"), True)
        return name

    def _point(self, text: str) -> None:
        new = self._at(f"CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        try:
            out.write(bytearray(f"{text}\n".encode()))
        finally:
            out.close()
        # one rename that replaces the old pointer, where the file system has it
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(new, self._at("CURRENT"), how)


def replace_chunks(store: Versioned, new: DataFrame, docs: DataFrame) -> DataFrame:
    """Puts new chunk sets in place of those of their documents: all of a set or nothing. Returns doc_id, outcome (replaced; refused: not a valid set;
    missing: no such document), status and chunk_count of each document of ``docs`` or ``new`` once the new version is current.

    A replaced document is ready, has no error, and counts the chunks that are read back from the store."""
    valid = valid_sets(new).join(docs.select("doc_id"), "doc_id", "left_semi")
    old = store.read()
    store.replace(replaced_chunks(old, new.select(old.columns), valid), lambda rows: rows.groupBy("doc_id", "ordinal").count().where("count > 1"))
    counts = store.read().groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    tried = new.select("doc_id").distinct().join(valid.withColumn("fine", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("fine", F.lit(False)).alias("fine"), F.lit(True).alias("tried"))
    rows = docs.select("doc_id", "status", F.lit(True).alias("known")).join(tried, "doc_id", "full_outer").join(counts, "doc_id", "left")
    outcome = F.when(F.col("known").isNull(), "missing").when(F.col("fine"), "replaced").when(F.col("tried"), "refused").otherwise("kept")
    return rows.select("doc_id", outcome.alias("outcome"), F.when(F.col("fine"), "ready").otherwise(F.col("status")).alias("status"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
