"""Benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_LOWER, narrow, table, written

WINDOW = 13
#: Words of an anchor, the beginning of a block.
ANCHOR = 3
#: Bytes of benchmark text that one automaton is built from: some 350 MB of memory.
AUTOMATON_BYTES = 20_000_000
#: Bytes as they count for words: A-Z lower-cased, 0-9, a-z and all above ASCII kept, the rest a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Windows that are compared at once.
_AT_ONCE = 1 << 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Windows:
    """An automaton over the words of items (id, text), and the windows around what it finds.

    Every word is a number, written as two letters of disjoint alphabets, so a match begins and ends at
    words. An item is cut into blocks of which each of its windows holds a whole one; the beginnings of
    these are the automaton's patterns, so its size grows with the text and not with its windows, of
    which each word begins one. Around a match the few windows that can hold the block are looked up
    among the items' windows by a hash and compared word by word. A shorter item is a pattern itself."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.window, self.block = window, (window + 1) // 2
        self.anchor = min(ANCHOR, self.block)
        self.numbers: dict[bytes, int] = {}
        self.names: list[str] = []
        codes, bounds = [], [0]
        for name, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers)) for w in words(text)]
            self.names.append(name)
            codes.append(np.array(own, np.int32))
            bounds.append(bounds[-1] + len(own))
        self.code = np.concatenate([*codes, np.zeros(0, np.int32)])
        self.base = isqrt(len(self.numbers)) + 1
        letters = self.letters(self.code)
        short: dict[str, tuple[int, set[int]]] = {}
        starts, anchors = [], set()
        for i, (s, e) in enumerate(pairwise(bounds)):
            if e - s >= window:
                starts.append(np.arange(s, e - window + 1))
                for o in range(s, e - self.block + 1, self.block):
                    anchors.add(letters[2 * o : 2 * (o + self.anchor)])
            elif e > s:
                short.setdefault(letters[2 * s : 2 * e], (e - s, set()))[1].add(i)
        at = np.concatenate([*starts, np.zeros(0, np.int64)])
        h = self._hash(self.code, at)
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order].astype(np.int32)
        self.item = (np.searchsorted(bounds, self.at, "right") - 1).astype(np.int32)
        self.auto = ahocorasick.Automaton()
        none: tuple[int, set[int]] = (self.anchor, set())
        for p in anchors:
            self.auto.add_word(p, short.get(p, none))
        for p, known in short.items():
            self.auto.add_word(p, known)
        if anchors or short:
            self.auto.make_automaton()

    def letters(self, code: np.ndarray) -> str:
        return (np.stack((code // self.base, code % self.base + self.base), 1).astype("<u4") + 256).tobytes().decode("utf-32-le")

    def _hash(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(self.window):
            out = out * _PRIME + code[at + k].astype(np.uint64)
        return out ^ (out >> np.uint64(29))

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged word ranges (end exclusive) inside occurrences, and the items that occur."""
        found = words(text)
        n = len(found)
        if not n or self.auto.kind != ahocorasick.AHOCORASICK:
            return n, [], set()
        code = np.array([self.numbers.get(w, len(self.numbers)) for w in found], np.int32)  # that number is no word's
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        tried: set[int] = set()
        for end, (size, short) in self.auto.iter(self.letters(code)):
            z = end // 2 + 1
            if short:
                ranges.append((z - size, z))
                items |= short
            if size == self.anchor:
                tried.update(range(max(0, z - size + self.block - self.window), min(z - size, n - self.window) + 1))
        if tried and len(self.at):
            begin = np.array(sorted(tried))
            h = self._hash(code, begin)
            low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
            for s, a, b in zip(begin.tolist(), low.tolist(), high.tolist(), strict=True):
                for k in range(a, b, _AT_ONCE):  # windows that many items share
                    same = np.arange(k, min(b, k + _AT_ONCE))
                    same = same[(self.code[self.at[same, None] + np.arange(self.window)] == code[s : s + self.window]).all(1)]
                    if len(same):
                        ranges.append((s, s + self.window))
                        items.update(self.item[same].tolist())
        merged: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return n, merged, {self.names[i] for i in items}


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point ranges of the original text."""
    folded = text.encode().translate(_FOLD)
    starts, ends, at = [], [], 0
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    raw = text.encode()
    return [(len(raw[: starts[a]].decode()), len(raw[: ends[b - 1]].decode())) for a, b in ranges]


_built: dict[int, Windows] = {}


def _scan(items_at: Callable[[], list[tuple[str, str]]], key: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:  # once per Python worker
            _built.clear()
            _built[key] = Windows(items_at(), window)
        known = _built[key]
        for b in batches:
            n, where, spans, names = [], [], [], []
            for text in b.column(1):
                text = text.as_py()
                count, ranges, owners = known.hits(text)
                n.append(count)
                where.append([x for r in ranges for x in r])
                spans.append([x for r in original_spans(text, ranges) for x in r] if ranges else [])
                names.append(sorted(owners))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(where, pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["doc_id", "n_words", "ranges", "spans", "items"])

    return run


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, ranges, spans, items.

    ranges: flat list of start, end word positions (end exclusive) inside occurrences of windows of
    benchmark(item_id, text); spans: the same as code points of the original text; items: ids of
    the items of which a window occurs, sorted. The benchmark's size is checked first: up to
    automaton_bytes it is one automaton, sent to the executors and built once per worker, and the
    texts are read once. Only a larger one, which a worker couldn't hold, is dealt into parts by item,
    each with a scan and a written table of its own.

    Null and empty texts have no words; null or wordless items have no windows; a null item_id is
    left out; repeated items count once. A long text is held whole, with some bytes a word beside it.
    Windows that several items share name all of them. Repeated rows repeat; empty tables give no
    rows or no hits. Of clashing columns only doc_id, text and item_id are read."""
    spark = docs.sparkSession
    asked = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].alias("text")).where("item_id is not null and text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // automaton_bytes) or 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = narrow(docs, "doc_id", "text")
    if blocks > 1:  # rows are told apart by a number that outlives the scans
        own = written(own.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("doc_id"), "text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words bigint, ranges array<int>, spans array<bigint>, items array<string>"
    every = None
    for k in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])
        part = own.mapInArrow(_scan(lambda s=sent: s.value, sent._jbroadcast.id(), window), schema)
        if blocks == 1:
            return part
        part = written(part)
        every = part if every is None else every.unionByName(part)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    merged = every.groupBy("doc_id", "n_words").agg(flat("ranges"), flat("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select(F.col("doc_id.doc_id").cast(kind).alias("doc_id"), "n_words", "ranges", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, **options: int) -> DataFrame:
    """The digest of contaminated_words, and what it says of odd rows: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated.

    A document is contaminated if a word is hit and at least one of `share` words is."""
    found = contaminated_words(docs, benchmark, window, **options)
    # Ranges from several blocks may overlap, so words are counted once.
    steps = F.expr("flatten(transform(sequence(0, size(ranges) div 2 - 1), i -> sequence(ranges[2 * i], ranges[2 * i + 1] - 1)))")
    n_hit = F.when(F.size("ranges") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(steps))).cast("bigint")
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate over documents and the whole benchmark; odd rows as contaminated_words says."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = rf"""
with w as (select doc_id, regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 13) as n, array_to_string(list_slice(ws, i, i + 12), ' ') as win
       from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as win
       from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, sizes where len(ws) >= n)),
occ as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct doc_id, item_id from occ) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join hit using (doc_id) left join its using (doc_id)
"""
