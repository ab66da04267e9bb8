"""The engine's functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.chunker import spans
from .text import stems


class ChunkFile:
    """chunk_file(content, language, chunk_size): a row for each span of a file."""

    def eval(self, content: str, language: str, chunk_size: int) -> Iterator[tuple]:
        for s in spans(content or "", language or "", chunk_size):
            yield s.start, s.end, s.function_name, s.class_name


def register(spark: SparkSession) -> None:
    """Makes the table function chunk_file and the function stems known to spark.sql."""
    spark.udtf.register("chunk_file", F.udtf(ChunkFile, returnType="start_line int, end_line int, function_name string, class_name string"))
    spark.udf.register("stems", stems)
