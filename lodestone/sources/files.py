"""Files as rows."""

from __future__ import annotations

import logging
import os
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import closed_folders, excluded, extension, language
from ..schema import FILE, Config
from .scratch import forget_at_exit, shared_dir

log = logging.getLogger("lodestone")


#: Entries after which a task hands the folders that it has not entered yet on to others: none at first,
#: so that the folders of the root are dealt out, then more in each round.
ENTRIES = (0, 1_000, 100_000)
#: Names that a task gives on at a time.
NAMES = 10_000

_FOUND = "file_path string, length long, modified long, folder boolean, trail array<string>"


class _Folders:
    """Lists folders, without entering those that are excluded or that a link has led to before.

    A link to a folder is followed unless the folder that it leads to holds the link itself, or one
    that was followed on the way: trail holds the real folders of the links so far. So every way ends."""

    def __init__(self, root: str, closed: str | None) -> None:
        self.root, self.closed = root, re.compile(closed) if closed else None

    def open(self, folder: str) -> bool:
        return self.closed is None or not self.closed.match(folder.removeprefix(self.root).strip("/") + "/")

    def entries(self, folder: str, trail: list[str]) -> Iterator[tuple[str, int | None, int, bool, list[str]]]:
        """path, length, time in microseconds, whether a folder, and trail. Those of local folders are read one by one, as a
        folder may hold millions; of other stores as they are told. One that can't be listed is empty."""
        try:
            if "://" in folder and not folder.startswith("file://"):
                store, name = fs.FileSystem.from_uri(folder)
                scheme = folder.removesuffix(name)
                for x in store.get_file_info(fs.FileSelector(name)):
                    yield scheme + x.path, x.size if x.is_file else None, (x.mtime_ns or 0) // 1000, not x.is_file, trail
                return
            scheme = "file://" if folder.startswith("file://") else "file:" if folder.startswith("file:") else ""
            local = folder.removeprefix(scheme)
            here = os.path.realpath(local)
            with os.scandir(local) as found:
                for x in found:
                    try:
                        stat = x.stat()
                        if not x.is_dir():
                            if x.is_file():
                                yield scheme + x.path, stat.st_size, stat.st_mtime_ns // 1000, False, trail
                            continue
                    except OSError as e:  # a link to nothing
                        log.warning("%s is left out: %s", x.path, e)
                        continue
                    if x.is_symlink():
                        to = os.path.realpath(x.path)
                        if any(t == to or t.startswith(to.rstrip("/") + "/") for t in (*trail, here)):
                            log.info("%s leads back to %s and is not followed", x.path, to)
                            continue
                        yield scheme + x.path, None, 0, True, [*trail, here]
                    else:
                        yield scheme + x.path, None, 0, True, trail
        except OSError as e:
            log.warning("%s can't be listed: %s", folder, e)


def _listed(root: str, closed: str | None, most: int):  # noqa: ANN202
    """A task of folders (file_path, trail) to the files below them, and, after `most` entries, the folders
    that are left."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [f.split()[0] for f in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders, seen, held = _Folders(root, closed), 0, []
        for b in batches:
            todo = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            while todo:
                for row in folders.entries(*todo.pop()):
                    seen += 1
                    if not row[3]:
                        held.append(row)
                    elif folders.open(row[0]):
                        if seen <= most:
                            todo.append((row[0], row[4]))
                        else:
                            held.append(row)
                    if len(held) >= NAMES:
                        yield out(held)
                        held = []
                if seen > most:
                    held += [(p, None, 0, True, t) for p, t in todo]
                    todo = []
        yield out(held)

    return run


def rooted(root: str) -> str:
    """A folder as the paths of what is listed below it begin."""
    return (root if "://" in root or root.startswith("file:") else os.path.abspath(root)).rstrip("/")


def listed(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """file_path, length, modified (microseconds) of the indexable files below a folder, by the file
    system's own listing, which also sees names that begin with _ or a dot.

    Executors list, in rounds: a task that meets a large tree hands the folders that it has not entered
    yet on to the next round, in which they are dealt out anew. The driver sees no name. What is found
    is kept in the shared folder. Folders of which the globs take everything are not entered."""
    root = rooted(root)
    closed, kept = closed_folders(config.exclude_patterns), f"{shared_dir(spark)}/lodestone-listed-{uuid.uuid4().hex}"
    forget_at_exit(spark, kept)
    todo, rounds = spark.createDataFrame([(root, [])], "file_path string, trail array<string>"), 0
    while True:
        most = ENTRIES[min(rounds, len(ENTRIES) - 1)]
        todo.mapInArrow(_listed(root, closed, most), _FOUND).write.parquet(f"{kept}/round={rounds}")
        found = spark.read.schema(f"{_FOUND}, round int").parquet(kept)
        left = found.where((F.col("round") == rounds) & F.col("folder")).select("file_path", "trail")
        n = left.count()
        if not n:
            break
        todo, rounds = left.repartition(min(n, 8 * spark.sparkContext.defaultParallelism)), rounds + 1
    return indexable(found.where("not folder").select("file_path", "length", "modified"), config, root)


def indexable(files: DataFrame, config: Config = Config(), root: str = "") -> DataFrame:
    """The rows of files(file_path, length) whose extension is indexed, whose relative path no glob
    excludes and that are not too large. Bulk scan and change feed share this filter."""
    relative = F.regexp_replace("file_path", "^" + _quoted(root.rstrip("/")) + "/", "") if root else F.regexp_replace("file_path", "^/+", "")
    return files.where(extension(F.col("file_path")).isin(list(config.extensions)) & ~excluded(relative, config.exclude_patterns) & (F.col("length") <= config.max_file_size))


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():  # a file at a time, so that a batch holds no more
            try:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as f:
                    raw = pa.py_buffer(f.read())
            except (OSError, pa.ArrowInvalid) as e:
                log.warning("%s is left out: %s", path, e)
                continue
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(raw)], pa.int64()), _text(raw)], ["file_path", "length", "content"])
            del raw


def _text(raw: pa.Buffer) -> pa.Array:
    """The bytes as one text, without a copy of them if they are UTF-8."""
    text = pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, len(raw)], pa.int32()).buffers()[1], raw])
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([raw.to_pybytes().decode("utf-8", "replace")])
    return text


def read_files(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """file_path, length, content, language of listed files, decoded as UTF-8. Executors open them, by
    URI; Spark's own readers would skip names that begin with _ or a dot. A file that can't be read
    is logged and left out. The paths, which are small and may lie in one partition, are dealt to some
    tasks, by default eight for each core."""
    own = paths.select("file_path")
    return with_language(own.repartition(tasks or 8 * own.sparkSession.sparkContext.defaultParallelism).mapInArrow(_opened, FILE))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language(F.col("file_path")))


def open_tabs(spark: SparkSession, paths: Iterable[str], limit: int = 10) -> DataFrame:
    """position, file_path of the first open files."""
    return spark.createDataFrame(list(enumerate(paths))[:limit], "position int, file_path string")
