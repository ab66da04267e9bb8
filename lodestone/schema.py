"""Schemas of the tables, and the settings that change results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_LIST = T.ArrayType(_S)

#: The 8 fields that a search returns.
SHOWN = ("id", "file_path", "start_line", "end_line", "content", "language", "function_name", "class_name")

#: Lines are counted from 0, end_line is included; '' is stored as null in the optional fields.
CHUNK = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("file_path", _S, False),
        T.StructField("start_line", _I, False),
        T.StructField("end_line", _I, False),
        T.StructField("content", _S, False),
        T.StructField("content_hash", _S, False),
        T.StructField("language", _S, False),
        T.StructField("function_name", _S),
        T.StructField("class_name", _S),
        T.StructField("enriched_context", _S),
        T.StructField("summary", _S),
        T.StructField("purpose", _S),
        T.StructField("related_concepts", _LIST),
        T.StructField("usage_patterns", _LIST),
        T.StructField("dependencies", _LIST),
        T.StructField("created_at", _L, False),
        T.StructField("updated_at", _L, False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
    ]
)

FILE = T.StructType([T.StructField("file_path", _S, False), T.StructField("length", _L, False), T.StructField("content", _S, False)])
EVENT = T.StructType([T.StructField("file_path", _S, False), T.StructField("op", _S, False), T.StructField("ts", T.TimestampType(), False)])
CONTEXT = T.StructType([T.StructField("summary", _S), T.StructField("purpose", _S), T.StructField("related_concepts", _LIST), T.StructField("usage_patterns", _LIST), T.StructField("dependencies", _LIST), T.StructField("full_context", _S)])

#: Extensions that are indexed, and globs that are not.
EXTENSIONS = "ts tsx js jsx py java go cpp c h hpp cs rb php swift kt rs html htm css scss sass vue".split()
EXCLUDED = ("**/node_modules/**", "**/dist/**", "**/out/**", "**/.git/**", "**/build/**", "**/*.min.js")


@dataclass(frozen=True)
class Config:
    search_mode: str = "hybrid"
    rrf_k: int = 60
    chunk_size: int = 500
    chunk_overlap: int = 50
    max_file_size: int = 1_048_576
    exclude_patterns: tuple[str, ...] = EXCLUDED
    extensions: tuple[str, ...] = tuple(EXTENSIONS)
    index_on_save: bool = True
    enable_context: bool = False
    context_prompt: str = ""
    #: Names of providers in the registries, and the arguments they are made with.
    context_provider: str = "none"
    context_options: Mapping[str, object] = field(default_factory=dict)
    embedding_provider: str = "hashing"
    embedding_options: Mapping[str, object] = field(default_factory=dict)
    #: Requests that a task sends to a provider at a time.
    batch_size: int = 10
    context_batch_size: int = 10
    debug_logging: bool = False
    lenient_keywords: bool = False

    def __post_init__(self) -> None:
        if self.search_mode not in ("hybrid", "semantic", "keyword"):
            raise ValueError(f"unknown search mode {self.search_mode!r}")
        if not 1 <= self.rrf_k <= 100:
            raise ValueError("rrf_k must be 1 to 100")
        if not 1 <= self.batch_size <= 50 or not 1 <= self.context_batch_size <= 20:
            raise ValueError("batch_size must be 1 to 50, context_batch_size 1 to 20")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
