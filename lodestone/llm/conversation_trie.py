"""The prefix trie of conversations, as the Cartesian tree over the longest common prefixes of sorted ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, table, written

#: Bytes of a turn in a conversation's key, and what counts as a word.
TOKEN, WORD = 16, r"[^\x20\x09-\x0D]+"
#: Conversations of which one is the base, and the most turns that are taken from it, plus one.
FAMILY, HEADS = 20, 4
#: Blocks that are merged at a time, and ids of one row of ends.
FAN, IDS = 512, 20_000
#: No depth: where conversations of a segment end differs, or isn't known.
MANY = -2
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = "rep long, lo int, hi int, n long, least long, leaves long, shared long, kids long"
_OPEN = "block int, seq int, x int, in_n long, in_least long, in_leaves long, in_shared long, in_kids long, seg_n long, seg_least long, seg_leaves long, seg_shared long, seg_end int, seg_rep long"
_PIECES = f"kind int, {_NODE}, ids string, {_OPEN}"
_RANKED = f"{_PIECES}, conv_id long, toks binary, upto array<bigint>"


def _digest(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, TOKEN)


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tok, words of each turn; tok is a digest of role and text."""
    own = narrow(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    tok = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return own.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", tok.alias("tok"), F.regexp_count(text, F.lit(WORD)).alias("words"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, tok, words) to a row for each conversation in each batch."""
    part = TaskContext.get().partitionId() << 32
    for b in batches:
        if not b.num_rows:
            continue
        ids, words = b.column(0).to_numpy(), b.column(2).to_numpy().astype("<i4")
        toks = b"".join(b.column(1).to_pylist())
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        rows = [(int(ids[i]), part + k, toks[TOKEN * i : TOKEN * j], words[i:j].tobytes()) for k, (i, j) in enumerate(spans)]
        part += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "part", "toks", "words"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, parts in order) to (conv_id, toks, words)."""
    for b in batches:
        parts = b.column(1).to_pylist()
        both = [pa.array([b"".join(p[c] for p in ps) for ps in parts], pa.binary()) for c in ("toks", "words")]
        yield pa.RecordBatch.from_arrays([b.column(0), *both], ["conv_id", "toks", "words"])


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, toks, words: a conversation's turns as one key, TOKEN bytes a turn, and their words,
    four bytes a turn.

    Turns are dealt by a range over (conv_id, turn), so a hot conversation is cut by many tasks; its
    row is put together of their pieces."""
    order = ["conv_id", F.asc_nulls_first("turn"), "tok", "at"]
    own = _turns(conversations).withColumn("at", F.monotonically_increasing_id())
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "tok", "words")
    parts = dealt.mapInArrow(_runs, "conv_id long, part long, toks binary, words binary")
    met = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "toks", "words"))).alias("parts"))
    return met.mapInArrow(_joined, "conv_id long, toks binary, words binary")


def rebuilt(own: DataFrame) -> DataFrame:
    """The sequences with their first turns taken from the base of their family."""
    bases = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), *[F.substring(c, 1, n * (HEADS - 1)).alias(f"base_{c}") for c, n in (("toks", TOKEN), ("words", 4))])
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    met = own.withColumn("h", h.cast("int")).join(bases, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left")
    empty = F.lit(b"")
    glued = [F.concat(F.coalesce(F.expr(f"substring(base_{c}, 1, {n} * h)"), empty), F.expr(f"substring({c}, {n} * h + 1)")).alias(c) for c, n in (("toks", TOKEN), ("words", 4))]
    return met.select("conv_id", *glued)


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b)) // TOKEN
    if a[: TOKEN * n] == b[: TOKEN * n]:
        return n
    low = 0  # equal up to low, not up to n
    while n - low > 1:
        mid = (low + n) // 2
        if a[TOKEN * low : TOKEN * mid] == b[TOKEN * low : TOKEN * mid]:
            low = mid
        else:
            n = mid
    return low


class Node:
    """An interval of the sorted conversations that begin alike, so far: the segment before its first
    separator, and sums over those between its separators."""

    __slots__ = ("depth", "before", "n", "least", "leaves", "shared", "kids", "ids", "at")

    def __init__(self, depth: int, before: tuple | None) -> None:
        self.depth, self.before, self.ids, self.at = depth, before, [], -1
        self.n = self.leaves = self.shared = self.kids = 0
        self.least: int | None = None


class Sweep:
    """All nearest smaller values of the separators of a block, by a stack.

    A separator is the common depth of two neighbours, a segment what stands between two separators:
    (n, least, leaves, shared, end, rep), end being the depth of a single conversation and MANY for more.
    Nodes whose interval is bounded on both sides within the block are put out; what is left is the
    block's running minima from either side, with the segments between them, as separators again.
    Separators of equal depth in one interval are one node. run: how many conversations that end at a
    node may be told in one row; in a block of blocks only one, as others stand between."""

    def __init__(self, run: int = 1) -> None:
        self.run = run
        self.stack: list[Node] = []
        self.left: list[tuple] = []
        self.last: tuple | None = None
        self.nodes: list[tuple] = []
        self.ends: list[tuple] = []

    def _flush(self, node: Node) -> None:
        if node.ids:
            self.ends.append((node.at, ",".join(map(str, node.ids))))
            node.ids = []

    def _fold(self, node: Node, seg: tuple) -> None:
        n, least, leaves, shared, end, rep = seg
        node.n += n
        node.shared += shared
        node.least = least if node.least is None else min(node.least, least)
        if end == node.depth:  # it ends here
            if not node.ids:
                node.at = rep
            node.ids.append(least)
            if len(node.ids) >= self.run:
                self._flush(node)
            return
        node.kids += 1
        node.leaves += leaves
        if end >= 0:
            self.nodes.append((rep, node.depth, end, 1, least, 1, 0, 0))

    def first(self, seg: tuple) -> None:
        """The first segment of a block, whose separator isn't known yet."""
        self.left.append((None, (0, None, 0, 0, 0), seg))

    def take(self, x: int, inner: tuple, seg: tuple | None) -> None:
        """The next separator, with what was merged into it, and the segment behind it."""
        stack, cur = self.stack, self.last
        while stack and stack[-1].depth > x:
            node = stack.pop()
            if stack:  # what lies below is smaller: bounded on the left as well
                inner_ids, node.ids = node.ids, []
                at = node.at
                self._fold(node, node.before)
                if inner_ids:
                    self._flush(node)
                    node.ids, node.at = inner_ids, at
                self._fold(node, cur)
                self._flush(node)
                leaves = node.leaves if node.kids else 1
                rep = node.before[5]
                self.nodes.append((rep, max(stack[-1].depth, x), node.depth, node.n, node.least, leaves, node.shared, node.kids))
                cur = (node.n, node.least, leaves, node.shared, MANY, rep)
            else:
                self._flush(node)
                self.left.append((node.depth, (node.n, node.least, node.leaves, node.shared, node.kids), cur))
                cur = None
        if stack and stack[-1].depth == x:
            top = stack[-1]
            self._fold(top, cur)
        else:
            top = Node(x, cur)
            stack.append(top)
        n, least, leaves, shared, kids = inner
        top.n += n
        top.leaves += leaves
        top.shared += shared
        top.kids += kids
        if least is not None:
            top.least = least if top.least is None else min(top.least, least)
        self.last = seg

    def minima(self) -> list[tuple]:
        """The separators that are left: (depth, what was merged into it, segment behind it)."""
        for node in self.stack:
            self._flush(node)
        behind = [*[node.before for node in self.stack[1:]], self.last][: len(self.stack)]  # a block of one has no separator
        return self.left + [(node.depth, (node.n, node.least, node.leaves, node.shared, node.kids), seg) for node, seg in zip(self.stack, behind, strict=True)]

    def rows(self) -> list[dict]:
        """The nodes and ends found since the last call."""
        names = [f.split()[0] for f in _NODE.split(", ")]
        out = [dict(zip(names, n, strict=True), kind=1) for n in self.nodes] + [{"kind": 2, "rep": at, "ids": ids} for at, ids in self.ends]
        self.nodes, self.ends = [], []
        return out

    def open_rows(self, block: int) -> list[dict]:
        names = [f.split()[0] for f in _OPEN.split(", ")]
        return [dict(zip(names, (block, k, x, *inner, *seg), strict=True), kind=3) for k, (x, inner, seg) in enumerate(self.minima())]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], _TYPES[kind]) for name, kind in fields], [name for name, _ in fields])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of sorted (conv_id, toks, words): its conversations with their place, its bounded nodes,
    and its minima."""
    block, at, before, sweep = TaskContext.get().partitionId(), 0, None, Sweep(IDS)
    for b in batches:
        rows = []
        for conv_id, toks, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            upto = np.cumsum(np.frombuffer(words, "<i4"), dtype=np.int64)
            pos, seg_end = block << 40 | at, len(toks) // TOKEN
            seg = (1, conv_id, 1, 0, seg_end, pos)
            if before is None:
                sweep.first(seg)
            else:
                depth = common(before, toks)
                sweep.take(depth, (0, None, 0, int(upto[depth - 1]) if depth else 0, 0), seg)
            rows.append({"kind": 0, "rep": pos, "conv_id": conv_id, "toks": toks, "upto": upto})
            before, at = toks, at + 1
        yield _batch(rows + sweep.rows(), _RANKED)
    if before is not None:
        opened = sweep.open_rows(block)
        yield _batch(sweep.rows() + opened, _RANKED)
        # the edges of the block, by which its first separator is found
        yield _batch([{"kind": 4, "block": block, "seq": at - 1, "toks": before}], _RANKED)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(next, last key before it, first key of it, upto) to (next, depth, shared)."""
    for b in batches:
        rows = [(n, common(x, y), u) for n, x, y, u in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        cols = [[n for n, _, _ in rows], [d for _, d, _ in rows], [u[d - 1] if d else 0 for _, d, u in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["next", "depth", "shared"])


def _first_separators(ranked: DataFrame) -> list[tuple[int, int, int]]:
    """(block, depth, shared) of the separator before each block; one row for each task of the sort."""
    last = ranked.where("kind = 4").select("block", "toks")
    blocks = sorted(r.block for r in last.select("block").collect())
    if not blocks:
        return []
    after = ranked.sparkSession.createDataFrame(list(zip(blocks, blocks[1:], strict=False)), "block int, next int")
    firsts = ranked.where("kind = 0 and rep & 1099511627775 = 0").select(F.shiftright("rep", 40).cast("int").alias("next"), F.col("toks").alias("own"), "upto")
    met = last.join(after, "block").join(firsts, "next")
    found = met.select("next", "toks", "own", "upto").mapInArrow(_edges, "next int, depth int, shared long").collect()
    return [(blocks[0], -1, 0), *map(tuple, found)]


def _merged(final: bool):  # noqa: ANN202
    """A task of minima of blocks (super, block, seq, ...), sorted: each super's swept again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sweep = None, Sweep()

        def end() -> list[dict]:
            if final:
                sweep.take(-1, (0, None, 0, 0, 0), None)
                return sweep.rows()
            opened = sweep.open_rows(now)
            return sweep.rows() + opened

        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["super"] != now:
                    if now is not None:
                        out += end()
                    now, sweep = r["super"], Sweep()
                inner = tuple(r[f"in_{c}"] for c in ("n", "least", "leaves", "shared", "kids"))
                sweep.take(r["x"], inner, tuple(r[f"seg_{c}"] for c in ("n", "least", "leaves", "shared", "end", "rep")))
            yield _batch(out + sweep.rows(), _PIECES)
        if now is not None:
            yield _batch(end(), _PIECES)

    return rows


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, ids) to (id, sha256 of the joined ids), a piece at a time."""

    def out(ids: Iterable[bytes], shas: Iterable[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(shas, pa.string())], ["id", "ends"])

    now, sha = None, hashlib.sha256()
    for b in batches:
        done = []
        for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield out([k for k, _ in done], [s for _, s in done])
    if now is not None:
        yield out([now], [sha.hexdigest()])


def trie(keys: DataFrame) -> DataFrame:
    """The nodes of the trie of keys(conv_id, toks, words), as op11 returns them."""
    ranked = written(keys.repartitionByRange("toks", "conv_id").sortWithinPartitions("toks", "conv_id").select("conv_id", "toks", "words").mapInArrow(_ranked, _RANKED))
    spark = ranked.sparkSession
    names = lambda schema: [f.split()[0] for f in schema.split(", ")]
    edges = spark.createDataFrame(_first_separators(ranked), "of int, depth int, sum long")
    opened = ranked.where("kind = 3").select(*names(_OPEN)).join(F.broadcast(edges), (F.col("block") == F.col("of")) & (F.col("seq") == 0), "left")
    opened = opened.withColumns({"x": F.coalesce("x", "depth"), "in_shared": F.col("in_shared") + F.coalesce("sum", F.lit(0))}).select(*names(_OPEN))
    pieces, blocks = ranked.select(*names(_PIECES)), edges.agg(F.max("of")).first()[0]
    while blocks is not None:
        blocks //= FAN
        merged = opened.withColumn("super", F.expr(f"block div {FAN}").cast("int")).repartition(blocks + 1, "super").sortWithinPartitions("super", "block", "seq")
        level = written(merged.mapInArrow(_merged(blocks == 0), _PIECES))
        pieces = pieces.where("kind <> 3").unionByName(level)
        if blocks == 0:
            break
        opened = level.where("kind = 3").select(*names(_OPEN))
    at = ranked.where("kind = 0").select(F.col("rep").alias("at"), "toks", "upto")
    met = pieces.where("kind = 1").select(*names(_NODE)).join(at, F.col("rep") == F.col("at"))
    key = lambda depth: _digest(F.expr(f"substring(toks, 1, {TOKEN} * {depth})"))
    before = F.slice(F.concat(F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint")), "upto"), F.col("lo") + 2, F.col("hi") - F.col("lo"))
    nodes = written(met.select(key("hi").alias("id"), F.when(F.col("lo") >= 0, key("lo")).alias("above"), "lo", "hi", "n", "least", "leaves", "shared", "kids", before.alias("before")))
    above = nodes.where("n > 1").select(F.col("id").alias("p_id"), F.col("least").alias("p_least"))
    ends = pieces.where("kind = 2").select("rep", "ids").join(at.select("at", _digest(F.col("toks")).alias("e_id")), F.col("rep") == F.col("at")).select("e_id", "rep", "ids")
    ends = ends.repartition("e_id").sortWithinPartitions("e_id", "rep").select("e_id", "ids").mapInArrow(_hashed, "id binary, ends string").withColumnRenamed("id", "e_id")
    whole = nodes.join(above, F.col("above") == F.col("p_id"), "left").join(ends, (F.col("id") == F.col("e_id")) & (F.col("n") > 1), "left")
    each = whole.select("*", F.posexplode("before").alias("k", "words_before")).withColumn("depth", (F.col("lo") + 1 + F.col("k")).cast("bigint"))
    bottom = F.col("depth") == F.col("hi")
    ended = F.when(~bottom, NOTHING).when(F.col("n") == 1, F.sha2(F.col("least").cast("string").cast("binary"), 256)).otherwise(F.coalesce("ends", F.lit(NOTHING)))
    return each.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 0, F.lit(None).cast("bigint")).when(F.col("k") == 0, F.col("p_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("kids")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * F.col("words_before")).alias("saved_tokens"),
        ended.alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of rebuilt conversations(conv_id, turn, role, text): conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, ties by a digest of role and text, so equal rows may stand in
    any order; a null role or text is empty. Each conversation takes its first turns from the base of its
    family. A conversation becomes a key of TOKEN bytes a turn; keys are sorted by range, ties by
    conv_id, which cuts any number of equal ones. Each block of the sort finds the common depths of
    neighbours and, by a stack, the intervals within which they are at least as large (all nearest
    smaller values); what its minima leave open is swept again over blocks of blocks, until one is
    left. Depths that no two neighbours stop at lie in between nodes and are filled in at the end. Sums
    over an interval come along in the sweep: the words that its separators share tell what is saved.

    Turns are told apart by 16 bytes of SHA-256. Rows without conv_id belong to no conversation. A
    conversation of any number of turns is cut by many tasks, its key is one value of 12 bytes a turn
    before and 24 after the sort, so up to some 80 million turns. Equal conversations are
    never gathered: their ids are hashed piece by piece, in the order of the sort. An empty table has no
    node, not even a root; other columns are not read, whatever their names."""
    own = written(sequences(conversations))
    return trie(rebuilt(own))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation_trie over all conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: crc32 by its definition, a bit at a time.
_CRC = "list_reduce([c::bigint for c in ascii_of], lambda a, c: list_reduce(range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(a, c)), 4294967295)"
OP11_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words
  from conversations where conv_id is not null
), told as (
  select *, sha256(length(role)::varchar || ':' || role || text) as tok from turns
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, substr(tok, 1, 32)) as pos from told
), spelt as (
  select distinct conv_id, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)) as ascii_of from placed
), heads as (
  select conv_id, xor({_CRC}, 4294967295) % 4 as h from spelt
), lines as (
  select h.conv_id, 0 as part, pos, tok, words from heads h join placed p on p.conv_id = h.conv_id - h.conv_id % 20 and pos <= h
  union all
  select h.conv_id, 1, pos, tok, words from heads h join placed p on p.conv_id = h.conv_id and pos > h
), deep as (
  select conv_id, tok, words, row_number() over (partition by conv_id order by part, pos) as d from lines
), paths as (
  select conv_id, d, words, md5(array_to_string(list(tok) over (partition by conv_id order by d), ',')) as k from deep
  union all select conv_id, 0, 0, '' from heads
), members as (
  select *, max(d) over (partition by conv_id) as len, lag(k) over (partition by conv_id order by d) as up from paths
), nodes as (
  select d, k, any_value(up) as up, min(conv_id) as conv_id, count(*) as n, any_value(words) as words,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len = d), '')) as ends
  from members group by d, k
), kids as (select d - 1 as d, up as k, count(*) as n_children from nodes where d > 0 group by all),
known as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (d, k)),
sums as (
  select m.d, m.k, count(*) filter (v.n_children = 0) as n_leaves, sum((v.n - 1) * v.words)::bigint as saved
  from known v join members m on m.conv_id = v.conv_id and m.d <= v.d group by m.d, m.k
)
select a.conv_id, a.d::bigint as depth, p.conv_id as parent_conv_id, a.n as n_convs, a.n_children, s.n_leaves, s.saved as saved_tokens, a.ends as ends_sha256
from known a join sums s using (d, k) left join nodes p on p.d = a.d - 1 and p.k = a.up
"""
