"""What a job has finished, so that a rerun does only the rest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "step string, made_from string, state string, n_rows long"


def files_state(spark: SparkSession, path: str) -> str | None:
    """Number, size and a digest of the names, sizes and times of the files below a path; None if there is none. No content is read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        told = files.select("path", "length", F.col("modificationTime").cast("double").alias("time"))
        seen = told.agg(
            F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.bit_xor(F.xxhash64("path", "length", "time")).alias("digest")
        ).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return f"{seen['n']}-{seen['bytes']}-{seen['digest']}" if seen["n"] else None


def digest_of(described: Mapping[str, object]) -> str:
    """A short name for inputs and options."""
    return hashlib.sha256(json.dumps(described, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Manifest:
    """A note for each finished step, in a folder that every executor sees.

    A note is written after its result and says what the result was made from and which files it is. A step counts as finished only
    if both still hold, so a half-written, changed or removed result is made again, and so is one of other inputs or options.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _note(self, step: str):
        try:
            return self.spark.read.schema(NOTE).parquet(f"{self.folder}/{step}").first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def finished(self, step: str, made_from: str, path: str) -> bool:
        note = self._note(step)
        return note is not None and note["made_from"] == made_from and note["state"] == files_state(self.spark, path)

    def rows(self) -> dict[str, int]:
        """Rows of each finished step's result."""
        try:
            notes = self.spark.read.schema(NOTE).option("recursiveFileLookup", "true").parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        return {note["step"]: note["n_rows"] for note in notes.collect()}  # a row a step

    def step(self, name: str, made_from: str, path: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result stored in ``path``: read if it is finished, else made (by ``make``, which stores it there) and noted."""
        if self.finished(name, made_from, path):
            return self.spark.read.parquet(path)
        result = make()
        note = [(name, made_from, files_state(self.spark, path), result.count())]
        self.spark.createDataFrame(note, NOTE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return result
