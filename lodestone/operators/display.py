"""Rows as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname


def _preview(content: Column, n: int) -> Column:
    return F.replace(F.substring(content, 1, n), F.lit("\n"), F.lit(" "))


def _more(content: Column, n: int) -> Column:
    return F.when(F.length(content) > n, "...").otherwise("")


def _lines(chunk: str = "chunk") -> Column:
    return F.concat(F.lit("Lines "), F.col(f"{chunk}.start_line").cast("string"), F.lit("-"), F.col(f"{chunk}.end_line").cast("string"))


def _percent(digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", F.col("similarity") * 100)


def _name(chunk: str, fn: str, cls: str) -> Column:
    function, cl = F.nullif(F.col(f"{chunk}.function_name"), F.lit("")), F.nullif(F.col(f"{chunk}.class_name"), F.lit(""))
    return F.when(function.isNotNull(), F.format_string(fn, function)).when(cl.isNotNull(), F.format_string(cls, cl)).otherwise("")


def preview(content: Column, n: int) -> Column:
    """The first n characters on one line, with dots if there are more."""
    return F.concat(_preview(content, n), _more(content, n))


def search_rows(results: DataFrame) -> DataFrame:
    """label, description, detail of results(chunk, similarity)."""
    content = F.col("chunk.content")
    return results.select(basename(F.col("chunk.file_path")).alias("label"), F.concat(_percent(1), F.lit(" - "), _lines()).alias("description"), preview(content, 100).alias("detail"))


def quick_rows(results: DataFrame) -> DataFrame:
    content, path, name = F.col("chunk.content"), F.col("chunk.file_path"), _name("chunk", "method %s", "class %s")
    description = F.concat(_percent(1), F.lit(" "), F.when(name != "", F.concat(F.lit("· "), name)).otherwise(""))
    detail = F.concat_ws(" · ", dirname(path), _lines(), F.concat(F.trim(_preview(content, 150)), _more(content, 150)))
    return results.select(basename(path).alias("label"), description.alias("description"), detail.alias("detail"))


def similar_rows(results: DataFrame) -> DataFrame:
    path = F.col("chunk.file_path")
    return results.select(F.concat(basename(path), _name("chunk", " · %s()", " · %s")).alias("label"), F.concat(_percent(0), F.lit(" similar")).alias("description"), dirname(path).alias("detail"))


def open_file_rows(files: DataFrame, limit: int = 10) -> DataFrame:
    """label, detail of the first open files(position, file_path)."""
    return files.orderBy("position").limit(limit).select(basename(F.col("file_path")).alias("label"), dirname(F.col("file_path")).alias("detail"))


def status_text(stats: DataFrame) -> DataFrame:
    """status: a text of one row of statistics."""
    when = F.coalesce(F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss"), F.lit("Never"))
    return stats.select(F.format_string("Index Statistics:\n- Total Chunks: %d\n- Total Files: %d\n- Database Size: %.2f MB\n- Last Indexed: %s", "total_chunks", "total_files", F.col("database_size") / 1048576.0, when).alias("status"))


def or_message(rows: DataFrame, message: str) -> DataFrame:
    """The rows, or one that says why there are none."""
    if not rows.isEmpty():
        return rows
    first, *rest = rows.columns
    return rows.sparkSession.range(1).select(F.lit(message).alias(first), *[F.lit("").alias(c) for c in rest])
