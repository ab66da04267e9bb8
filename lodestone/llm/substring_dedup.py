"""Substring deduplication with repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, table

WINDOW = 13
#: Words of an anchor. Each window owns its smallest anchor by hash, the last of equal ones; windows
#: of one wording own the same, so documents that share a window share an anchor. Hashes of words only
#: say where to look: what they bring together is compared word by word.
ANCHOR = 5
#: Bytes of text of a shard of documents.
SHARD_BYTES = 8_000_000
#: Patterns that one automaton is compiled from, for some 120 MB of memory.
PATTERNS = 50_000
#: An anchor's windows are dealt into one group for each so many places that it has in all documents,
#: by their words.
SPLIT = 1_000
#: Shards that share an anchor from which its phrases are combined before they meet, and joined back.
FAN = 2_000
#: Bytes of text that are hashed at once.
_CHUNK = 1 << 20

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LETTER = np.random.default_rng(13).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), kept for the next chunk."""
    known = _known_powers.get(base)
    if known is None or len(known) < n:
        known = np.full(n, base, np.uint64)
        known[:1] = 1
        known = np.multiply.accumulate(known)
        if n <= 2 * _CHUNK:
            _known_powers[base] = known
    return known[:n]


class Words:
    """The words of some texts: hash and document number of each, all at once."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        sums = np.add.accumulate(_LETTER[data] * _powers(_BASE, len(data)))
        self.hash = _mix((sums[ends - 1] - sums[starts - 1]) * _powers(_INVERSE, len(data))[starts])
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts]) + 1
        self.doc = np.searchsorted(bounds, starts, "right") - 1

    def rolling(self, k: int) -> np.ndarray:
        """Hash of the k words from each."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + self.hash[j : j + n]
        return _mix(out)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor that windows within a document own: its hash, its place, and the first and
        the last of those windows. Their words are a phrase."""
        anchors = self.rolling(ANCHOR)
        n = max(0, len(self.hash) - WINDOW + 1)
        shifted = [anchors[d : d + n] for d in range(WINDOW - ANCHOR + 1)]
        least = shifted[0].copy()
        for x in shifted[1:]:
            np.minimum(least, x, out=least)
        owner = np.zeros(n, np.int64)
        for d, x in enumerate(shifted):
            np.copyto(owner, d, where=x == least)
        owner += np.arange(n)
        at = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :][:n])
        cuts = np.flatnonzero(np.diff(owner[at], prepend=-1))
        place = owner[at[cuts]]
        return anchors[place].view(np.int64), place, at[cuts], at[np.append(cuts[1:], len(at))[: len(cuts)] - 1]


def _chunks(t: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of a shard in chunks of bounded size, always in the same order: by id and text,
    so that a word of a shard can be named by its place."""
    t = t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")]))
    ids = t.column("doc_id").to_numpy().astype(np.int64)
    begin, texts, size = 0, [], 0
    for i, x in enumerate(t.column("text")):
        texts.append((x.as_py() or "").encode())
        size += len(texts[-1])
        if size >= _CHUNK or i == len(t) - 1:
            yield ids[begin : i + 1], texts
            begin, texts, size = i + 1, [], 0


def _questions(t: pa.Table) -> pa.Table:
    """A shard (shard, doc_id, text) to its anchors: h, shard, whether several documents have it, and
    its number of places."""
    hs, docs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for ids, texts in _chunks(t):
        words = Words(texts)
        h, place, *_ = words.phrases()
        hs.append(h)
        docs.append(ids[words.doc[place]])
    h, doc = np.concatenate(hs), np.concatenate(docs)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.diff(h, prepend=h[:1] - 1)) if len(h) else np.empty(0, np.int64)
    end = np.append(new[1:], len(h))[: len(new)]
    return pa.table({"h": h[new], "shard": np.full(len(new), t.column("shard")[0].as_py() if len(t) else 0, np.int64), "several": doc[new] != doc[end - 1], "places": end - new})


def _phrases(t: pa.Table, known: pa.Table) -> pa.Table:
    """A shard and its recurring anchors (h, places, fan) to its distinct phrases around them: key, fan,
    phrase, shard, at, first, last; at is the place of its first word in the shard, first and last are
    the least and the greatest id. An anchor's windows are dealt into groups, one for each SPLIT
    places, by a hash of their words; neighbours in a group are a phrase."""
    found: dict[bytes, list] = {}
    order = np.argsort(known.column("h").to_numpy())
    recurring, places, fan = (known.column(c).to_numpy()[order] for c in ("h", "places", "fan"))
    base = 0
    for ids, texts in _chunks(t) if len(recurring) else ():
        words = Words(texts)
        h, _, low, high = words.phrases()
        k = np.minimum(np.searchsorted(recurring, h), len(recurring) - 1)
        keep = np.flatnonzero(recurring[k] == h)
        k, key, low, high = k[keep], h[keep], low[keep], high[keep]
        groups = 1 + places[k] // SPLIT
        if (groups > 1).any():  # cut where the next window falls into another group
            many = high - low + 1
            of = np.repeat(np.arange(len(low)), many)
            single = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            group = (words.rolling(WINDOW)[single] % groups[of].astype(np.uint64)).view(np.int64)
            cuts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
            low, high = single[cuts], single[np.append(cuts[1:], len(of)) - 1]
            k, key = k[of[cuts]], _mix((key[of[cuts]] + group[cuts]).view(np.uint64)).view(np.int64)
        spelled = b"\n".join(texts).split()
        for x, f, lo, hi, d in zip(key.tolist(), fan[k].tolist(), low.tolist(), (high + WINDOW).tolist(), ids[words.doc[low]].tolist(), strict=True):
            line = b" ".join(spelled[lo:hi])
            was = found.get(line)
            if was is None:
                found[line] = [x, f, base + lo, d, d]
            else:
                was[3], was[4] = min(d, was[3]), max(d, was[4])
        base += len(spelled)
    cols = list(zip(*found.values(), strict=True)) or [()] * 5
    shard = t.column("shard")[0].as_py() if len(t) else None
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(list(found), pa.binary()), pa.array([shard] * len(found), pa.int64()), *(pa.array(cols[i], pa.int64()) for i in (2, 3, 4))], ["key", "fan", "phrase", "shard", "at", "first", "last"])


Stretch = tuple[int, int, int]  # first window and number of neighbouring windows, and the first document that has them


def confirmed(run: dict[bytes, tuple[int, int]]) -> dict[bytes, list[Stretch]]:
    """The stretches of windows that stand in two documents or more, of phrases with their first and
    last documents that hold every place of their windows. Windows are compared by their words."""
    cut: dict[bytes, list[bytes]] = {}
    seen: dict[bytes, tuple[int, int]] = {}
    for phrase, (first, last) in run.items():
        if len(run) == 1:
            return {phrase: [(0, phrase.count(b" ") - WINDOW + 2, first)]} if first < last else {}
        ends = np.flatnonzero(np.frombuffer(phrase, np.uint8) == 32).tolist()
        starts, ends = [0, *(e + 1 for e in ends)], [*ends, len(phrase)]
        cut[phrase] = windows = [phrase[a:z] for a, z in zip(starts, ends[WINDOW - 1 :], strict=False)]
        for w in windows:
            known = seen.get(w)
            seen[w] = (first, last) if known is None else (min(first, known[0]), max(last, known[1]))
    out: dict[bytes, list[Stretch]] = {}
    for phrase, windows in cut.items():
        stretches: list[Stretch] = []
        for o, w in enumerate(windows):
            first, last = seen[w]
            if first < last:
                if stretches and stretches[-1][0] + stretches[-1][1] == o and stretches[-1][2] == first:
                    stretches[-1] = (stretches[-1][0], stretches[-1][1] + 1, first)
                else:
                    stretches.append((o, 1, first))
        if stretches:
            out[phrase] = stretches
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[bytes, list[tuple]]]]:
    """Rows (key, phrase, ...) sorted by key to (key, rows of each phrase without these two)."""
    run: dict[bytes, list[tuple]] = {}
    now = None
    for batch in batches:
        for key, phrase, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if run:
                    yield now, run
                now, run = key, {}
            run.setdefault(phrase, []).append(tuple(rest))
    if run:
        yield now, run


_ROWS = 50_000


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


_STRETCH = pa.schema([("shard", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("first", pa.int64())])
_COMBINED = pa.schema([("c_key", pa.int64()), ("c_phrase", pa.binary()), ("o", pa.int32()), ("n", pa.int32()), ("first", pa.int64())])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of the shards (key, phrase, shard, at, first, last), sorted by key, to the stretches that
    each shard loses in a document of its own: shard, at, n, first."""

    def rows() -> Iterator[tuple]:
        for _, run in _runs(batches):
            asked = {p: (min(r[2] for r in x), max(r[3] for r in x)) for p, x in run.items()}
            for phrase, stretches in confirmed(asked).items():
                for shard, at, _, last in run[phrase]:
                    for o, n, first in stretches:
                        if first < last:
                            yield shard, at + o, n, first

    return _batched(rows(), _STRETCH)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of all shards (key, phrase, first, last), sorted by key, to their stretches."""

    def rows() -> Iterator[tuple]:
        for key, run in _runs(batches):
            for phrase, stretches in confirmed({p: x[0] for p, x in run.items()}).items():
                yield from ((key, phrase, *s) for s in stretches)

    return _batched(rows(), _COMBINED)


def _automata(patterns: dict[str, tuple[int, int]]) -> Iterator[ahocorasick.Automaton]:
    """Automata of bounded size that tell (number of windows, first document) of each pattern."""
    todo = iter(patterns.items())
    while part := list(islice(todo, PATTERNS)):
        auto = ahocorasick.Automaton()
        for words, known in part:
            auto.add_word(words, known)
        auto.make_automaton()
        yield auto


def _stripped(t: pa.Table, found: pa.Table, texts: bool) -> pa.Table:
    """A shard without the words of the stretches (at, n, first) that earlier documents have.

    Every word becomes two letters of disjoint alphabets, so that a match begins and ends at words;
    the stretches are compiled into automata, and these read each document whole."""
    numbers: dict[bytes, int] = {}
    ids, codes, bounds = [], [np.empty(0, np.int64)], [0]
    for doc_ids, raw in _chunks(t):
        ids += doc_ids.tolist()
        for x in raw:
            own = np.array([numbers.setdefault(w, len(numbers)) for w in x.split()], np.int64)
            codes.append(own)
            bounds.append(bounds[-1] + len(own))
    code, vocabulary = np.concatenate(codes), list(numbers)
    base = isqrt(len(vocabulary)) + 1
    letters = (np.stack((code // base, code % base + base), 1).astype("<u4") + 256).tobytes().decode("utf-32-le")
    patterns = {letters[2 * at : 2 * (at + n + WINDOW - 1)]: (n, first) for at, n, first in zip(*(found.column(c).to_pylist() for c in ("at", "n", "first")), strict=True)}
    gone = np.zeros(len(code) + 1, np.int64)
    for auto in _automata(patterns):
        begins, ends = [], []
        for doc, s, e in zip(ids, bounds, bounds[1:], strict=False):
            for end, (n, first) in auto.iter(letters[2 * s : 2 * e]):
                if first < doc:
                    z = s + end // 2 + 1
                    ends.append(z)
                    begins.append(z - n - WINDOW + 1)
        np.add.at(gone, np.array(begins, np.int64), 1)
        np.add.at(gone, np.array(ends, np.int64), -1)
    out = np.cumsum(gone[:-1]) > 0
    removed, sha, kept_texts = [], [], []
    for s, e in zip(bounds, bounds[1:], strict=False):
        kept = b" ".join([vocabulary[c] for c in code[s:e][~out[s:e]].tolist()])
        removed.append(int(out[s:e].sum()))
        sha.append(hashlib.sha256(kept).hexdigest())
        if texts:
            kept_texts.append(kept.decode())
    made = {"doc_id": pa.array(ids, pa.int64()).cast(t.schema.field("doc_id").type), "n_words": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
    return pa.table(made | ({"kept_text": pa.array(kept_texts, pa.string())} if texts else {}))


def substring_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text), doc_id an integer: doc_id, n_words, n_removed,
    kept_sha256, and with `texts` also kept_text.

    A word is removed if a window of WINDOW words that covers it also starts in a document with a
    smaller doc_id. Documents are dealt to shards of bounded size by a hash of the row; the texts
    are shuffled once, for three rounds. First each shard tells its anchors and learns which of them
    others have too. Then it tells its distinct phrases around these, which are dealt by anchor, and
    the windows that recur are confirmed by their words. Last each shard compiles the confirmed
    stretches of its own phrases into Aho-Corasick automata, which read all of its documents and
    locate every occurrence. Hashes only deal rows, so no result rests on them.

    A common anchor's windows are dealt into groups by their words, in proportion to its places; the
    phrases of one that more than FAN shards have are combined before they meet, and carried back by
    a join that Spark may split. So a group has some SPLIT phrases, of at most FAN rows each.

    Null and empty texts have no words. A row with a null doc_id neither loses words nor makes others
    lose any; such rows are not shuffled. Rows that repeat a doc_id are one document: they don't make
    each other lose words, whatever their texts, and each gives a row. Texts of any length are read
    whole; one beyond SHARD_BYTES is held by one task with the rest of its shard. Ties can't occur, as
    only the ids count. Empty tables give no rows; other columns are not read, whatever their names."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = narrow(docs, "doc_id", "text")
    own = every.where("doc_id is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(1 + size // SHARD_BYTES)).alias("shard")
    dealt_out = own.select(shard, "doc_id", "text").groupBy("shard")
    asked = dealt_out.applyInArrow(_questions, "h bigint, shard bigint, several boolean, places bigint")
    same = Window.partitionBy("h")  # at most a row for each shard
    n = F.count("*").over(same)
    known = asked.select("h", "shard", n.alias("n"), F.max("several").over(same).alias("several"), F.sum("places").over(same).alias("places")).where("n > 1 or several")
    known = known.select("shard", "h", "places", (F.col("n") > FAN).alias("fan"))
    phrases = dealt_out.cogroup(known.groupBy("shard")).applyInArrow(_phrases, "key bigint, fan boolean, phrase binary, shard bigint, at bigint, first bigint, last bigint")
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key")
    found = by_key(phrases.where("not fan").drop("fan")).mapInArrow(_told, "shard bigint, at bigint, n int, first bigint")
    if size // SHARD_BYTES >= FAN:
        common = phrases.where("fan")
        met = by_key(common.groupBy("key", "phrase").agg(F.min("first").alias("first"), F.max("last").alias("last"))).mapInArrow(_combined, "c_key bigint, c_phrase binary, o int, n int, first bigint")
        carried = common.drop("first").join(met, (F.col("key") == F.col("c_key")) & (F.col("phrase") == F.col("c_phrase"))).where("first < last")
        found = found.unionByName(carried.select("shard", (F.col("at") + F.col("o")).alias("at"), "n", "first"))
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts

    def strip(t: pa.Table, stretches: pa.Table) -> pa.Table:
        return _stripped(t, stretches, texts)

    def unjudged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(t.as_py() or "").encode().split() for t in b.column(1)]
            lines = [b" ".join(k) for k in kept]
            cols = [pa.nulls(len(b), b.schema.field(0).type), pa.array([len(k) for k in kept], pa.int64()), pa.array([0] * len(b), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in lines], pa.string())]
            cols += [pa.array([x.decode() for x in lines], pa.string())] * texts
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts])

    return dealt_out.cogroup(found.groupBy("shard")).applyInArrow(strip, schema).unionByName(every.where("doc_id is null").mapInArrow(unjudged, schema))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """substring_dedup over documents, all rows and whole texts."""
    return substring_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') as s
        from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
f as (select s, min(doc_id) as first from win group by s having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join f using (s) where f.first < win.doc_id),
pos as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select pos.doc_id, string_agg(ws[pos.p], ' ' order by pos.p) as t from pos left join gone on pos.doc_id = gone.doc_id and pos.p = gone.p
         where gone.p is null group by pos.doc_id),
n as (select doc_id, count(*) as n_removed from gone group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join n using (doc_id) left join kept using (doc_id)
"""
