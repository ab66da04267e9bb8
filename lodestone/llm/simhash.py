"""SimHash near-duplicates through a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, narrow, table, written

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Most fingerprints of one grid cell that a task compares at once; a larger cell is dealt into blocks.
BLOCK = 16_384
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included, A-Z lower-cased; 0 for no words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:z], SEED) for a, z in zip(starts.tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, more) to (doc_id, fp, more)."""
    for b in batches:
        found = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


# The embedding: a fingerprint's 32 segments of two bits become their bit counts, 0 to 2. The Manhattan
# distance of two such vectors is at most the Hamming distance of the fingerprints. Of two fingerprints
# within 3 bits, one half (16 segments) differs in at most one bit, so its vectors are equal or one step
# apart along one axis: the cells of the grid are a half's vectors, and the range join looks into a cell
# and its neighbours. One step changes the sum of the counts by one, so only odd vectors look around.

_M2 = np.uint64(0x5555555555555555)


def embed(fp: np.ndarray) -> np.ndarray:
    """Segment counts in unary, two bits each: 00, 01 and 11 for 0, 1 and 2."""
    high = fp >> np.uint64(1)
    return ((fp | high) & _M2) | ((fp & high & _M2) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embedded fingerprints: of unary counts, the bits that differ."""
    return np.bitwise_count(a ^ b)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, rep) to (cell, fp, rep, home): each half's own cell, and the cells around it if it is odd."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        counts = embed(fp)
        cell, row, home = [], [], []
        every = np.arange(len(fp))
        for half in (0, 1):
            v = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64) | (half << 32)
            odd = np.bitwise_count((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)) % 2 == 1
            cell.append(v)
            row.append(every)
            home.append(np.ones(len(fp), bool))
            for s in range(0, 32, 2):
                here = (v >> s) & 3
                for step, may in ((1, odd & (here == 0)), (2, odd & (here == 1)), (-1, odd & (here == 1)), (-2, odd & (here == 3))):
                    cell.append(v[may] + (step << s))
                    row.append(every[may])
                    home.append(np.zeros(int(may.sum()), bool))
        row = pa.array(np.concatenate(row))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), b.column(0).take(row), b.column(1).take(row), pa.array(np.concatenate(home))], ["cell", "fp", "rep", "home"])


def _forest(fp: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within the distance among a cell's rows, at least one at home; of those, a spanning forest.

    Rows at home are compared with all, some at a time, and only a row that has a near one in another
    tree is looked at by itself: there are fewer such than rows."""
    label, links, counts = np.arange(len(fp)), [], embed(fp)
    at_home = np.flatnonzero(home)
    width = max(1, (1 << 20) // len(fp))
    for i in range(0, len(at_home), width):
        rows = at_home[i : i + width]
        near = manhattan(counts[rows, None], counts[None, :]) <= distance
        r, c = np.nonzero(near)
        near[r, c] = np.bitwise_count(fp[rows[r]] ^ fp[c]) <= distance
        for k in np.flatnonzero((near & (label[rows, None] != label[None, :])).any(1)).tolist():
            others = np.flatnonzero(near[k])
            for j in others[np.unique(label[others], return_index=True)[1]].tolist():
                if label[j] != label[rows[k]]:
                    links.append((int(rows[k]), j))
                    label[label == label[j]] = label[rows[k]]
    return links


def _links(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell and block pair, in cells of bounded size, to links (u, v)."""
        rest = None
        for b in _with_end(batches):
            t = pa.Table.from_batches([b]) if b is not None else None
            if rest is not None:
                t = rest if t is None else pa.concat_tables([rest, t])
            if t is None or not len(t):
                continue
            keys = np.stack([t.column(c).to_numpy() for c in ("cell", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(t)]))
            if b is not None:  # the last cell may go on
                rest, starts, ends = t.slice(int(starts[-1])), starts[:-1], ends[:-1]
            fp, home = t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy()
            rep = t.column("rep")
            us, vs = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                if home[s:e].any():
                    for x, y in _forest(fp[s:e], home[s:e], distance):
                        us.append(s + x)
                        vs.append(s + y)
            if us:
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(k)).combine_chunks() for k in (us, vs)], ["u", "v"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links u, v between rows of nodes(fp, rep), distinct fingerprints, enough to connect all that
    are within the distance (at most 3). A cell of more than `block` rows is dealt into blocks, and
    pairs of blocks are compared by different tasks; each emits at most a spanning forest."""
    if distance > 3:
        raise ValueError("the grid's halves are made for distances up to 3")
    kind = nodes.schema["rep"].dataType.simpleString()
    cells = narrow(nodes, "fp", "rep").mapInArrow(_cells, f"cell bigint, fp bigint, rep {kind}, home boolean")
    # Cells without a home row, or of one row, have no pairs.
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any")
    # A row has some two dozen cells, of which Spark's estimate knows nothing: it would broadcast all of them.
    sized = cells.hint("merge").join(sizes.select(F.col("cell").alias("c"), F.expr(f"cast((n - 1) div {block} + 1 as int)").alias("nb")), F.col("cell") == F.col("c"))
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = sized.select("cell", "fp", "rep", "home", F.explode(pairs).alias("p")).select("cell", "fp", "rep", "home", "p.i", "p.j")
    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(_links(distance), f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint, component_id, and the columns to carry.

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id
    reachable. Equal fingerprints are one node, so copies cost nothing more. Null and empty texts
    have fingerprint 0, which links like any other. A null doc_id never names a component: its row
    gets the smallest id of its fingerprint's component, or null if only null ids share its
    fingerprint, which then links no further. A long text's shingles are hashed in pieces. Repeated
    rows repeat. Empty tables give no rows; other columns are not read, whatever their names."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [f"c{k}_" for k in range(len(carry))]
    own = narrow(docs, "doc_id", "text", *carry).toDF("doc_id", "text", *more)
    kinds = "".join(f", {m} {docs.schema[c].dataType.simpleString()}" for m, c in zip(more, carry, strict=True))
    prints = written(own.mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint{kinds}"))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(nodes.where("rep is not null"), distance))
    named = nodes.hint("merge").join(found, nodes["rep"] == found["node"], "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    out = prints.hint("merge").join(named, F.col("fp") == F.col("of"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *[F.col(m).alias(c) for m, c in zip(more, carry, strict=True)])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates over documents, all rows and whole texts."""
    return near_duplicates(table(spark, sf_dir, "documents"))
