import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import conversation_trie as C

from ..compare import of_duckdb, of_spark

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t))


def brute(rows):
    """The trie by a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tok = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, tok, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        yield p
        for q in kids[p]:
            yield from below(q)

    out = []
    for p, of in nodes.items():
        all_ = list(below(p))
        ends = ",".join(map(str, sorted(c for c in of if len(made[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * words(q[-1][1]) for q in all_ if q)
        out.append((min(of), len(p), min(nodes[p[:-1]]) if p else None, len(of), len(kids[p]), sum(not kids[q] for q in all_), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def made(seed, n=160, deep=7, alphabet=3):
    """Conversations that often begin alike, end within others, are equal or hold nulls."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), n):
        for turn in range(rng.randrange(1, deep)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", None]) if turn % 3 == 2 else "user", rng.choice(["", None, "a b", "c\td\ne", "f"][:alphabet])))
    return rows


@pytest.fixture
def many_blocks(spark, monkeypatch):
    """Each sort gives many small blocks, merged two at a time."""
    monkeypatch.setattr(C, "FAN", 2)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, many_blocks, seed):
    rows = made(seed, alphabet=2 + 2 * seed)
    rows += [(None, 1, "user", "nobody's"), (500, None, None, None), (7 * 20, 0, "user", "x" * 100_000)]
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as rep", "'c' as block", "'c' as toks", "'c' as kind", "'c' as h")
    assert rows_of(C.conversation_trie(extra)) == brute(rows)


def test_copies_over_many_blocks(spark, many_blocks):
    """Most conversations are equal, one is long, and one ends where others begin."""
    same = [(c, t, "user", w) for c in range(3, 900, 2) for t, w in enumerate(["one two", "three", "four", "five six seven"])]
    long = [(2000, t, "user", f"w{t}") for t in range(700)]
    rows = same + long + [(2001, t, "user", f"w{t}") for t in range(650)] + [(1001, 0, "user", "one two")]
    assert rows_of(C.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_and_none(spark):
    for rows in ([(4, 0, "user", "a b")], [(None, 0, "user", "a")], []):
        assert rows_of(C.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_turnless_conversations(spark):
    """Without a base, what the base would give is missing."""
    rows = [(c, 0, "user", "only") for c in range(21, 40)]
    got = rows_of(C.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and any(r[1] == 0 for r in got)


def test_common_depth():
    a = bytes(range(160))
    assert [C.common(a, b) for b in (a, a[:48], a[:48] + bytes(112), b"", bytes(16))] == [10, 3, 3, 0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_sweep_in_blocks_equals_sweep_as_a_whole(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 6) for _ in range(300)]
    seps = [-1] + [rng.randrange(0, min(a, b) + 1) for a, b in zip(lengths, lengths[1:], strict=False)]
    segs = [(1, rng.randrange(10**6), 1, 0, n, k) for k, n in enumerate(lengths)]

    def found(cuts, levels):
        done, items = [], [(x, (0, None, 0, x + 1, 0), s) for x, s in zip(seps, segs, strict=True)]
        for level in range(levels):
            out = []
            for i in range(0, len(items), cuts):
                sweep = C.Sweep()
                part = items[i : i + cuts]
                if level == 0:
                    sweep.first(part[0][2])
                    part = part[1:]
                for x in part:
                    sweep.take(*x)
                left = sweep.minima()
                if level == 0:
                    left[0] = (items[i][0], items[i][1], left[0][2])
                out += left
                done += sweep.nodes
            items = out
        sweep = C.Sweep()
        for x in items:
            sweep.take(*x)
        sweep.take(-1, (0, None, 0, 0, 0), None)
        # which member stands for a node may differ
        return sorted(n[1:] for n in done + sweep.nodes)

    assert found(7, 3) == found(1, 1) == found(300, 1)


def test_op11_equals_sql(spark, data):
    assert of_spark(C.op11_conversation_trie(spark, data)) == of_duckdb(C.OP11_SQL, data)
