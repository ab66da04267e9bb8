"""Chunks of files: functions and classes where a language has patterns for them, else line windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# For each language the patterns of functions and those of classes, in the order in which
# they are tried. \w is ASCII, \s any space of JS_SPACE.
PATTERNS: dict[str, tuple[list[str], list[str]]] = {
    "typescript": (
        [r"function\s+(\w+)", r"const\s+(\w+)\s*=\s*\(", r"(\w+)\s*\([^)]*\)\s*\{", r"async\s+function\s+(\w+)"],
        [r"class\s+(\w+)", r"interface\s+(\w+)", r"type\s+(\w+)"],
    ),
    "typescriptreact": (
        [r"function\s+(\w+)", r"const\s+(\w+)\s*=\s*\(", r"(\w+)\s*\([^)]*\)\s*\{", r"async\s+function\s+(\w+)", r"export\s+(?:default\s+)?function\s+(\w+)", r"export\s+const\s+(\w+)\s*=\s*\("],
        [r"class\s+(\w+)", r"interface\s+(\w+)", r"type\s+(\w+)"],
    ),
    "javascript": (
        [r"function\s+(\w+)", r"const\s+(\w+)\s*=\s*\(", r"(\w+)\s*\([^)]*\)\s*\{", r"async\s+function\s+(\w+)"],
        [r"class\s+(\w+)"],
    ),
    "javascriptreact": (
        [r"function\s+(\w+)", r"const\s+(\w+)\s*=\s*\(", r"(\w+)\s*\([^)]*\)\s*\{", r"async\s+function\s+(\w+)", r"export\s+(?:default\s+)?function\s+(\w+)", r"export\s+const\s+(\w+)\s*=\s*\("],
        [r"class\s+(\w+)"],
    ),
    "python": ([r"def\s+(\w+)"], [r"class\s+(\w+)"]),
    "java": ([r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\("], [r"class\s+(\w+)", r"interface\s+(\w+)", r"enum\s+(\w+)"]),
    "go": ([r"func\s+(?:\([^)]*\)\s*)?(\w+)"], [r"type\s+(\w+)\s+struct", r"type\s+(\w+)\s+interface"]),
    "rust": (
        [r"fn\s+(\w+)", r"pub\s+fn\s+(\w+)", r"pub\s*\(\s*crate\s*\)\s*fn\s+(\w+)", r"async\s+fn\s+(\w+)", r"const\s+fn\s+(\w+)", r"unsafe\s+fn\s+(\w+)"],
        [r"struct\s+(\w+)", r"enum\s+(\w+)", r"trait\s+(\w+)", r"impl\s+(?:<[^>]*>\s+)?(\w+)", r"type\s+(\w+)"],
    ),
    "cpp": (
        [r"(?:void|int|bool|float|double|auto|const|static|virtual|inline)\s+(\w+)\s*\(", r"(\w+)\s*\([^)]*\)\s*(?:const)?\s*\{"],
        [r"class\s+(\w+)", r"struct\s+(\w+)", r"namespace\s+(\w+)"],
    ),
    "c": ([r"(?:void|int|bool|float|double|char|const|static|inline)\s+(\w+)\s*\("], [r"struct\s+(\w+)", r"typedef\s+struct\s+(\w+)"]),
    "csharp": (
        [r"(?:public|private|protected|internal)?\s*(?:static|async|virtual|override)?\s*\w+\s+(\w+)\s*\("],
        [r"class\s+(\w+)", r"interface\s+(\w+)", r"struct\s+(\w+)", r"enum\s+(\w+)"],
    ),
    "php": ([r"function\s+(\w+)", r"(?:public|private|protected)\s+function\s+(\w+)"], [r"class\s+(\w+)", r"interface\s+(\w+)", r"trait\s+(\w+)"]),
    "ruby": ([r"def\s+(\w+)", r"def\s+self\.(\w+)"], [r"class\s+(\w+)", r"module\s+(\w+)"]),
    "swift": ([r"func\s+(\w+)", r"(?:public|private|internal|fileprivate)\s+func\s+(\w+)"], [r"class\s+(\w+)", r"struct\s+(\w+)", r"enum\s+(\w+)", r"protocol\s+(\w+)"]),
    "kotlin": ([r"fun\s+(\w+)", r"(?:public|private|internal|protected)?\s*fun\s+(\w+)"], [r"class\s+(\w+)", r"interface\s+(\w+)", r"object\s+(\w+)", r"enum\s+class\s+(\w+)"]),
    "html": ([r"<script[^>]*>", r"function\s+(\w+)"], [r'class="([^"]+)"', r'id="([^"]+)"']),
    "css": ([], [r"\.([a-zA-Z][\w-]*)", r"#([a-zA-Z][\w-]*)"]),
    "scss": ([r"@mixin\s+(\w+)", r"@function\s+(\w+)"], [r"\.([a-zA-Z][\w-]*)", r"#([a-zA-Z][\w-]*)", r"%([a-zA-Z][\w-]*)"]),
    "sass": ([r"@mixin\s+(\w+)", r"@function\s+(\w+)"], [r"\.([a-zA-Z][\w-]*)", r"#([a-zA-Z][\w-]*)", r"%([a-zA-Z][\w-]*)"]),
    "vue": (
        [r"function\s+(\w+)", r"const\s+(\w+)\s*=\s*\(", r"(\w+)\s*\([^)]*\)\s*\{", r"export\s+(?:default\s+)?function\s+(\w+)"],
        [r"class\s+(\w+)", r"interface\s+(\w+)", r"type\s+(\w+)"],
    ),
}
#: Fixed value: what counts as space beside a line's end.
JS_SPACE = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_TO_SPACE = dict.fromkeys(map(ord, JS_SPACE), " ")


@cache
def patterns(language: str) -> tuple[list[re.Pattern], list[re.Pattern]]:
    functions, classes = PATTERNS.get(language, ([], []))
    return [re.compile(p, re.ASCII) for p in functions], [re.compile(p, re.ASCII) for p in classes]


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    function_name: str | None = None
    class_name: str | None = None


def block_end(lines: list[str], start: int, language: str, chunk_size: int) -> int:
    """The last line of the block that begins on a line: in Python the one before the next line that
    is no deeper, else where the braces close; without that, chunk_size lines on at most."""
    if language == "python":
        depth = len(lines[start]) - len(lines[start].lstrip())
        for i in range(start + 1, len(lines)):
            if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= depth:
                return i - 1
        return len(lines) - 1
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for c in re.findall("[{}]", lines[i]):
            depth += 1 if c == "{" else -1
            opened |= c == "{"
            if c == "}" and opened and depth == 0:
                return i
    return min(start + chunk_size, len(lines) - 1)


def spans(content: str, language: str, chunk_size: int = 500) -> list[Span]:
    """Outermost functions and classes, line by line, functions first. After a function class
    patterns are still tried on its first line, and a class found there begins at the function's end."""
    functions, classes = patterns(language)
    if not functions and not classes:
        return []
    lines, found, i = content.split("\n"), [], 0
    while i < len(lines):
        line = lines[i] if lines[i].isascii() else lines[i].translate(_TO_SPACE)
        begin = i
        for kind, tries in (("function_name", functions), ("class_name", classes)):
            m = next((m for p in tries if (m := p.search(line))), None)
            if m:
                end = block_end(lines, i, language, chunk_size)
                found.append(Span(i, end, **{kind: (lines[begin][m.start(1) : m.end(1)] if m.re.groups else None) or None}))
                i = end
        i += 1
    return found


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string")), 256)


def _with_ids(chunks: DataFrame, *carry: str) -> DataFrame:
    return chunks.select(chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("id"), "file_path", "start_line", "end_line", "content", F.sha2("content", 256).alias("content_hash"), "language", "function_name", "class_name", *carry)


def line_windows(files: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of `size` lines, each beginning `overlap` lines before the last one ends, of
    files(file_path, content, language); blank ones are dropped. Column expressions only."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    lines = files.select("file_path", "language", F.split("content", "\n", -1).alias("lines"))
    starts = lines.select("*", F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(size - overlap))).alias("start_line"))
    cut = starts.select("file_path", "language", "start_line", (F.least(F.col("start_line") + size, F.size("lines")) - 1).alias("end_line"), F.array_join(F.slice("lines", F.col("start_line") + 1, F.lit(size)), "\n").alias("content"))
    none = F.lit(None).cast("string")
    return _with_ids(cut.where(F.trim("content", F.lit(JS_SPACE)) != "").select("*", none.alias("function_name"), none.alias("class_name")))


_CUT = {"file_path": pa.string(), "language": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "content": pa.string(), "function_name": pa.string(), "class_name": pa.string(), "file_hash": pa.string()}
#: Characters of chunks in a batch, and of a file that are hashed at a time.
_HELD = 4 << 20
_CUT_DDL = "file_path string, language string, start_line int, end_line int, content string, function_name string, class_name string, file_hash string"


def file_hash(content: Column, size: int, overlap: int) -> Column:
    """What a file's chunks depend on: its content and how it is cut. The rows of cut_files have the number
    of the file's chunks and a colon before it."""
    return F.sha2(F.concat(F.lit(f"{size} {overlap}\n"), content), 256)


def _cut(chunk_size: int, overlap: int | None, marked: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file_path, content, language) to chunks: the spans, or, if an overlap is given, each place once, as
    the last span that has it, and line windows where there is none. marked: each file also gives a row
    without lines, which tells that it was read."""

    def pieces(content: str, language: str) -> Iterable[Span]:
        found = spans(content, language, chunk_size)
        if overlap is None:
            return found
        if found:
            return {(s.start, s.end): s for s in found}.values()
        n = content.count("\n") + 1
        return (Span(s, min(s + chunk_size, n) - 1) for s in range(0, n, chunk_size - overlap))

    def rows(path: str, content: str, language: str | None) -> Iterator[tuple]:
        lines = content.split("\n")
        kept = [s for s in pieces(content, language or "") if any(line.strip(JS_SPACE) for line in lines[s.start : s.end + 1])]  # a span is never blank
        digest = None
        if marked:
            own = hashlib.sha256(f"{chunk_size} {overlap}\n".encode())
            for k in range(0, len(content), _HELD):
                own.update(content[k : k + _HELD].encode())
            digest = f"{len(kept)}:{own.hexdigest()}"
            yield path, language, None, None, None, None, None, digest
        for s in kept:
            yield path, language, s.start, s.end, "\n".join(lines[s.start : s.end + 1]), s.function_name, s.class_name, digest

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), _CUT.values(), strict=True)], list(_CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file at a time, and its chunks as they fill a batch: large files are never held beside each other."""
        for b in batches:
            out, held = [], 0
            for k in range(b.num_rows):
                path, language, *same = (b.column(c)[k].as_py() for c in range(b.num_columns) if c != 1)
                for row in [(path, language, *[None] * 6)] if any(same) else rows(path, b.column(1)[k].as_py(), language):
                    out.append(row)
                    held += len(row[4] or "")
                    if held >= _HELD:
                        yield made(out)
                        out, held = [], 0
            if out:
                yield made(out)

    return run


def structured_chunks(files: DataFrame, chunk_size: int = 500) -> DataFrame:
    """A chunk for each span of files(file_path, content, language). The scan for block ends is
    sequential within a file, so it runs in Python, over Arrow batches."""
    own = files.select("file_path", "content", "language").where("file_path is not null and content is not null")
    return _with_ids(own.mapInArrow(_cut(chunk_size, None), _CUT_DDL))


def cut_files(files: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Structured chunks of the files that have spans, line windows of the others, and a row with a null
    id for each file; all with the file_hash of their file. Files with a true column same are not cut: they
    give the one row, without a hash. One pass without a shuffle, so files that are read lazily are opened once. A chunk
    that two spans of a line share, a function and a class, is kept once, as the class."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    own = files.select("file_path", "content", "language", *(["same"] if "same" in files.columns else [])).where("file_path is not null and content is not null")
    cut = own.mapInArrow(_cut(size, overlap, marked=True), _CUT_DDL)
    return _with_ids(cut, "file_hash").withColumn("id", F.when(F.col("start_line").isNotNull(), F.col("id")))


def chunk_files(files: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """The chunks of cut_files."""
    return cut_files(files, size, overlap).where("id is not null").drop("file_hash")
