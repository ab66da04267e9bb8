"""Versioned Parquet tables: chunks with embeddings, and postings, in buckets of files."""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Iterable, Sequence
from contextlib import suppress
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import norm
from ..operators import lookup
from ..operators.fulltext import PACKED, n_tokens, packed, unpacked
from ..schema import CHUNK
from .scratch import DENSE, NO_LEFTOVERS, POSTINGS, SMALL_TASKS, settings

#: What is kept of a chunk: the hash of its file beside it.
KEPT = T.StructType([*CHUNK.fields, T.StructField("file_hash", T.StringType())])
#: The chunks with what is derived from them: the vector's norm, and the number of tokens.
STORED = T.StructType([*KEPT.fields, T.StructField("norm", T.DoubleType()), T.StructField("dl", T.LongType())])
POSTING = "chunk_id string, file_path string, dl bigint, col_no int, pos int, term string"
#: What is read of a posting: stores of before have the three values of place in columns of their own.
READ = f"{PACKED}, chunk_id string, file_path string, dl bigint"
#: Parquet's own index of ids, so that a look-up by id skips the row groups that don't have it.
BY_ID = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Row groups of chunks, small enough for a task that makes the postings of one or two.
GROUPS = {"parquet.block.size": str(4 << 20)}

log = logging.getLogger("lodestone")


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since this one has read the store."""


@dataclass(frozen=True)
class State:
    """A version: its number, and for each bucket with rows the commit that wrote it, its chunks with
    tokens, their tokens, and, if its postings were made anew later, the commit that wrote these."""

    number: int = 0
    buckets: int = 0
    at: dict[int, tuple] = field(default_factory=dict)


def _parts(at: dict[int, tuple]) -> set[tuple[str, int, str]]:
    """kind, bucket and commit of the folders that a version reads."""
    return {("chunks", b, x[0]) for b, x in at.items()} | {("postings", b, x[3] if len(x) > 3 else x[0]) for b, x in at.items()}


class Store:
    """A folder with versions of the tables.

    Files fall into buckets by a hash of their path. A commit writes the buckets it touches, chunks
    sorted by file and postings by term so that statistics skip what a query doesn't need, and then
    the version: a small file that names the commit of each bucket. So a change of one file rewrites
    one bucket. The version is written under a name that no reader looks at and then renamed, which
    fails if its number is taken: a commit is there as a whole or not at all, and of two writers that
    began at one version the later fails and loses nothing of the other's. This needs a file system
    whose rename is one step, as HDFS and local ones have it. A version that can't be read, as another
    program may leave one, is passed over for the one before it.

    Nothing is removed by a commit, so readers of older versions go on; vacuum, on call, removes what
    was replaced more than keep_hours ago.

    buckets: how many at first; when a bucket holds more than rows_per_bucket chunks on average, the
    table is dealt anew to twice as many, or more, so that the cost of it stays in proportion to growth."""

    def __init__(self, spark: SparkSession, root: str, stemmed: bool = True, keep_hours: float = 24, buckets: int = 32, rows_per_bucket: int = 500_000) -> None:
        self.spark, self.root, self.stemmed, self.keep_hours, self._buckets, self.rows_per_bucket = spark, root.rstrip("/"), stemmed, keep_hours, buckets, rows_per_bucket

    def _fs(self, path: str):  # noqa: ANN202
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _listed(self, folder: str) -> dict[str, float]:
        """The names in a folder, in order, with the times of their last change."""
        fs, p = self._fs(f"{self.root}/{folder}")
        found = fs.listStatus(p) if fs.exists(p) else []
        return {x.getPath().getName(): x.getModificationTime() / 1000 for x in sorted(found, key=lambda x: x.getPath().getName())}

    def versions(self) -> list[int]:
        """The numbers of the versions, oldest first."""
        return [int(n[:8]) for n in self._listed("log") if re.fullmatch(r"\d{8}\.json", n)]

    def _load(self, number: int) -> State:
        fs, p = self._fs(f"{self.root}/log/{number:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        known = json.loads(text)
        return State(number, known["buckets"], {int(b): tuple(x) for b, x in known["at"].items()})

    def state(self, number: int | None = None) -> State:
        """A version, by default the newest that can be read; before the first commit an empty one. Its
        number is that of the newest in any case, so the next commit comes after it."""
        if number is not None:
            return self._load(number)
        found = self.versions()
        for v in reversed(found):
            try:
                own = self._load(v)
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                log.warning("version %d of %s can't be read: %s", v, self.root, e)
                continue
            return State(found[-1], own.buckets, own.at)
        return State(found[-1] if found else 0, self._buckets)

    def _publish(self, state: State) -> None:
        """Makes a version visible, all of it at once, unless its number is taken."""
        fs, hidden = self._fs(f"{self.root}/log/.{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps({"buckets": state.buckets, "at": state.at}).encode()))
        finally:
            out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        known = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri() if hidden.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        _, shown = self._fs(f"{self.root}/log/{state.number:08d}.json")
        try:
            known.rename(hidden, shown, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            fs.delete(hidden, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise ConcurrentCommit(f"version {state.number} of {self.root} is there already") from None

    def _publish_or_drop(self, state: State, name: str) -> int:
        """Makes a version visible; if its number is taken, what its commit has written is removed."""
        try:
            self._publish(state)
        except ConcurrentCommit:
            self._delete(f"data/{name}")
            raise
        return state.number

    def version(self) -> int | None:
        return self.state().number or None

    def _read(self, what: str, schema: T.StructType | str, state: State | None, only: Iterable[int] | None = None) -> DataFrame:
        at = (state or self.state()).at
        wanted = at if only is None else set(only) & set(at)
        paths = [f"{self.root}/data/{c}/{what}/bucket={b}" for x, b, c in sorted(_parts({b: at[b] for b in wanted})) if x == what]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def chunks(self, state: State | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The current chunks, or those of a version, or of some of its buckets."""
        return self._read("chunks", STORED, state, only)

    def chunks_of(self, paths: Sequence[str], state: State | None = None) -> DataFrame:
        """The chunks of some files: only their buckets are read, and the paths are pushed to the scan."""
        state = state or self.state()
        if not state.at or not paths:
            return self.chunks(state, [])
        array = F.array(*[self.bucket(F.lit(p), state) for p in paths])
        only = set(self.spark.range(1).select(array.alias("b")).first().b)
        return self.chunks(state, only).where(F.col("file_path").isin(list(paths)))

    def digests(self, state: State | None = None) -> DataFrame:
        """file_path, file_hash of the files of which all chunks are there; one of which a chunk could not be
        embedded is none of them."""
        own = self.chunks(state).where("file_hash is not null").groupBy("file_path", "file_hash").agg(F.count("*").alias("n"))
        return own.where("n = cast(substring_index(file_hash, ':', 1) as bigint)").select("file_path", F.substring_index("file_hash", ":", -1).alias("file_hash"))

    def index(self, state: State | None = None) -> DataFrame:
        """The postings. They lie by document, as in a distributed search engine: each bucket's are
        sorted by term, and a query reads the row groups of its terms in each."""
        own = self._read("postings", READ, state)
        made, rest = unpacked(own.select("place")).columns, ["col_no", "pos", "term"]
        new = unpacked(own.withColumnsRenamed({c: f"{c}_" for c in made}))
        return new.select(*[F.coalesce(c, f"{c}_").alias(c) for c in made], *rest)

    def corpus(self, state: State | None = None) -> DataFrame:
        """The index's figures, one row, from the version's file."""
        at = (state or self.state()).at.values()
        return self.spark.createDataFrame([(sum(x[1] for x in at), sum(x[2] for x in at))], "n long, tokens long")

    def bucket(self, file_path: Column, state: State | None = None) -> Column:
        return F.pmod(F.xxhash64(file_path), F.lit((state or self.state()).buckets)).cast("int").alias("bucket")

    def buckets_of(self, files: DataFrame, state: State) -> list[int]:
        """The buckets of files(file_path); no more than there are."""
        return sorted(r.bucket for r in files.select(self.bucket(F.col("file_path"), state)).distinct().collect() if r.bucket is not None)

    def write(self, rows: DataFrame, touched: Iterable[int], base: State, grow: bool = True) -> int:
        """Commits a version on top of base in which the touched buckets hold these rows and no others."""
        known = rows.columns
        rows = rows.select(*[F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in KEPT.fields])
        for c in ("function_name", "class_name", "enriched_context", "summary", "purpose"):
            rows = rows.withColumn(c, F.nullif(F.col(c), F.lit("")))
        rows = rows.withColumn("content_hash", F.coalesce(F.nullif("content_hash", F.lit("")), F.col("id")))
        name = f"{base.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/data/{name}"
        # Rows are made once, before this shuffle, which Spark deals anew by size: no range is sampled.
        placed = rows.withColumn("bucket", self.bucket(F.col("file_path"), base)).hint("rebalance", "bucket")
        placed = placed.withColumns({"norm": norm(F.col("embedding")), "dl": n_tokens()})
        with settings(placed.sparkSession, NO_LEFTOVERS):
            placed.sortWithinPartitions("bucket", "file_path", "start_line").write.options(**DENSE | BY_ID | GROUPS).partitionBy("bucket").parquet(f"{folder}/chunks")
        written = self.spark.read.schema(T.StructType([*STORED.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{folder}/chunks")
        self._index(written, folder, base.buckets)
        figures = written.groupBy("bucket").agg(F.count(F.when(F.col("dl") > 0, 1)).alias("n"), F.sum("dl").alias("tokens")).collect()
        at = {b: x for b, x in base.at.items() if b not in set(touched)} | {r.bucket: (name, r.n, r.tokens) for r in figures}
        state = State(base.number + 1, base.buckets, at)
        self._publish_or_drop(state, name)
        rows = sum(x[1] for x in at.values())
        if rows > self.rows_per_bucket * base.buckets and grow:
            return self.deal(base.buckets * 2 ** max(1, (rows // (self.rows_per_bucket * base.buckets)).bit_length()))
        return state.number

    def _index(self, chunks: DataFrame, folder: str, buckets: int) -> None:
        """Writes the postings of stored chunks. These lie by bucket already, so nothing is dealt out again: each
        task takes few row groups and sorts their postings in memory, by term alone: those of a term stay as the chunks
        lie. A writer for each bucket takes them as they come, where Spark would sort them by bucket once more."""
        writers = {"spark.sql.optimizer.plannedWrite.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": str(max(1, buckets))}
        with settings(self.spark, SMALL_TASKS | writers):
            terms = packed(chunks, stemmed=self.stemmed, carry=["bucket"])
            terms.sortWithinPartitions("term").write.options(**POSTINGS).partitionBy("bucket").parquet(f"{folder}/postings")

    def deal(self, buckets: int) -> int:
        """The same chunks in another number of buckets: the whole table is written once more."""
        base = self.state()
        log.info("dealing %s to %d buckets instead of %d", self.root, buckets, base.buckets)
        return self.write(self.chunks(base).select(*KEPT.fieldNames()), range(buckets), State(base.number, buckets), grow=False)

    def commit(self, chunks: DataFrame, base: State | None = None) -> int:
        """Makes these rows the whole table."""
        base = base or self.state()
        return self.write(chunks, range(base.buckets), base)

    def vacuum(self, hours: float | None = None) -> None:
        """Removes the versions that were replaced more than some hours ago, by default keep_hours, and
        what only they, or commits whose number was taken by others, have written. A reader that
        began with a version has that long to end."""
        since = time.time() - 3600 * (self.keep_hours if hours is None else hours)
        times = {int(n[:8]): t for n, t in self._listed("log").items() if re.fullmatch(r"\d{8}\.json", n)}
        read = {}
        for v in times:
            with suppress(ValueError, KeyError, TypeError, AttributeError):  # what can't be read replaces nothing
                read[v] = _parts(self._load(v).at)
        gone = {v for v, after in zip(sorted(read), sorted(read)[1:], strict=False) if times[after] <= since}
        alive = {x for v in read if v not in gone for x in read[v]}
        commits = {c for _, _, c in alive}
        for what, b, c in {x for v in gone for x in read[v]} - alive:
            if c in commits:  # else it goes as a whole
                self._delete(f"data/{c}/{what}/bucket={b}")
        for c in self._listed("data"):
            if c not in commits and int(c[:8]) <= max(times, default=0):
                self._delete(f"data/{c}")
        for v in gone:
            self._delete(f"log/{v:08d}.json")

    def _delete(self, path: str) -> None:
        fs, p = self._fs(f"{self.root}/{path}")
        fs.delete(p, True)

    def upsert(self, new: DataFrame) -> int:
        """Replaces rows of the same id, and adds the others."""
        base = self.state()
        old = self.chunks(base)
        moved = old.join(new.select("id"), "id", "left_semi").select("file_path")
        touched = self.buckets_of(new.select("file_path").unionByName(moved), base)
        kept = self.chunks(base, touched).join(new.select("id"), "id", "left_anti").select(*KEPT.fieldNames())
        return self.write(kept.unionByName(new, allowMissingColumns=True), touched, base)

    def delete_files(self, files: DataFrame) -> int:
        base = self.state()
        touched = self.buckets_of(files, base)
        return self.write(lookup.delete_files(self.chunks(base, touched), files), touched, base)

    def rebuild(self) -> int:
        """The same chunks with postings made anew, for a version whose postings were lost."""
        base = self.state()
        name = f"{base.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        self._index(self.chunks(base).withColumn("bucket", self.bucket(F.col("file_path"), base)), f"{self.root}/data/{name}", base.buckets)
        return self._publish_or_drop(State(base.number + 1, base.buckets, {b: (*x[:3], name) for b, x in base.at.items()}), name)

    def clear(self) -> int:
        return self.commit(self.chunks().limit(0))

    def stats(self) -> DataFrame:
        """One row of figures; the bytes are those of the files of the current chunks."""
        chunks = self.chunks()
        if not chunks.inputFiles():
            return lookup.stats(chunks, F.lit(0))
        size = chunks.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"))
        return lookup.stats(chunks).drop("database_size").join(size).withColumnRenamed("size", "database_size")
