import hashlib
import random
import re
from collections import defaultdict

import xxhash

from lodestone.llm import common, simhash
from lodestone.llm import substring_dedup as S
from lodestone.llm.common import components
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.simhash import embed, links, manhattan, near_duplicates
from lodestone.llm.substring_dedup import substring_dedup

from .helpers import awkward, clashing, prose


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[lowered(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(spark):
    rows = awkward()
    assert rows_of(exact_dedup(clashing(spark, rows))) == exact_brute(rows)
    assert rows_of(exact_dedup(clashing(spark, rows), first_digit=1, growth=2)) == exact_brute(rows)


def test_exact_with_repeated_ids(spark):
    rows = [(1, "a" * 200 + "x"), (1, "a" * 200 + "y"), (2, "a" * 200 + "x"), (0, "a" * 200 + "y"), (2, "a" * 200 + "x")]
    assert rows_of(exact_dedup(clashing(spark, rows))) == exact_brute(rows)


def test_empty_tables(spark):
    none = clashing(spark, [])
    assert exact_dedup(none).count() == near_duplicates(none).count() == substring_dedup(none).count() == 0


def fingerprint(t):
    ws = words(lowered(t))
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(prints):
    """Smallest node of each one's component, by comparing all."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_simhash(spark):
    rows = [(i, t) for i, t in awkward() if i is not None]
    prints = [fingerprint(t) for _, t in rows]
    expected = sorted(((i, f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, linked(prints), strict=True)), key=repr)
    got = near_duplicates(clashing(spark, rows))
    assert rows_of(got) == expected
    assert len({r[2] for r in expected}) < len(expected)


def test_simhash_null_ids(spark):
    got = rows_of(near_duplicates(clashing(spark, [(None, "one"), (5, "one"), (None, "two words")])))
    assert [r[2] for r in got if r[0] is None] in ([5, None], [None, 5]) and (5, got[0][1], 5) in got


def test_links_of_dense_fingerprints(spark):
    """Chains and crowds within 3 bits, with blocks smaller than a cell."""
    rng = random.Random(2)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(30):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                p ^= 1 << b
            prints.add(p)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    for block in (16_384, 16):
        found = {r.node: r.component for r in components(links(nodes, block=block)).collect()}
        assert [found.get(i, i) for i in range(len(prints))] == linked(prints)


def test_forest_of_a_crowd():
    """As many trees as comparing all pairs gives, in one cell of thousands."""
    import numpy as np

    from lodestone.llm.simhash import _forest

    rng = np.random.default_rng(4)
    centers = rng.integers(0, 2**63, 40, np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 7, 3000)]
    fp = np.unique(np.array([int(centers[k % 40]) ^ f for k, f in enumerate(flips)], np.uint64))
    home = rng.random(len(fp)) < 0.6
    label = np.arange(len(fp))
    for i in range(len(fp)):
        for j in np.flatnonzero((np.bitwise_count(fp ^ fp[i]) <= 3) & (home | home[i])):
            label[label == label[j]] = label[i]
    links = _forest(fp, home, 3)
    assert len(links) == len(fp) - len(np.unique(label))
    assert all(np.bitwise_count(fp[a] ^ fp[b]) <= 3 and label[a] == label[b] for a, b in links)


def test_manhattan_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 1000, np.uint64), rng.integers(0, 2**63, 1000, np.uint64)
    assert (manhattan(embed(a), embed(b)) <= np.bitwise_count(a ^ b)).all() and (manhattan(embed(a), embed(a)) == 0).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def substring_brute(rows):
    first = {}
    for i, t in rows:
        ws = words(t)
        for k in range(len(ws) - 12 if i is not None else 0):
            w = tuple(ws[k : k + 13])
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        ws = words(t)
        gone = [False] * len(ws)
        for k in range(len(ws) - 12 if i is not None else 0):
            if first[tuple(ws[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark, monkeypatch):
    rows = awkward()
    assert rows_of(substring_dedup(clashing(spark, rows))) == substring_brute(rows)
    monkeypatch.setattr(S, "SHARD_BYTES", 20_000)  # many shards
    assert rows_of(substring_dedup(clashing(spark, rows))) == substring_brute(rows)


def test_substring_random(spark):
    """Few words, so that windows recur everywhere and overlap."""
    rng = random.Random(5)
    pieces = [[rng.choice("abc") for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = [(rng.randrange(200), " ".join(sum((rng.choice(pieces) for _ in range(rng.randint(1, 4))), []))) for _ in range(80)]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = substring_dedup(clashing(spark, rows), texts=True)
    assert rows_of(got.drop("kept_text")) == substring_brute(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_common_anchors(spark, monkeypatch):
    """Anchors dealt by their windows, and combined, give the same; a common line in other words too."""
    rng = random.Random(6)
    line = prose(rng, 9)
    rows = awkward() + [(1000 + k, prose(rng, 14) + " " + line + " " + prose(rng, rng.choice([2, 14]))) for k in range(40)]
    rows += [(2000 + k, t) for k, (_, t) in enumerate(rows[-12:])]
    for split, fan, shard, patterns in ((1, 2000, 8_000_000, 7), (8, 2, 20_000, 50_000), (1, 1, 20_000, 50_000)):
        monkeypatch.setattr(S, "SPLIT", split)
        monkeypatch.setattr(S, "FAN", fan)
        monkeypatch.setattr(S, "SHARD_BYTES", shard)
        monkeypatch.setattr(S, "PATTERNS", patterns)
        assert rows_of(substring_dedup(clashing(spark, rows))) == substring_brute(rows)


def thue_morse(letters, n=2048):
    return " ".join(letters[i.bit_count() % 2] for i in range(n))


def test_colliding_hashes_change_nothing(spark):
    """Words over which every polynomial hash modulo a power of two collides."""
    rng = random.Random(8)
    head = prose(rng, 12).split()
    joined = lambda t: " ".join(head) + " " + t.replace(" ", "")
    rows = [(1, joined(thue_morse("ab"))), (2, joined(thue_morse("ba"))), (3, joined(thue_morse("ab")))]
    assert [r[2] for r in substring_brute(rows)] == [0, 0, 13]
    assert rows_of(substring_dedup(clashing(spark, rows))) == substring_brute(rows)
    rows = [(1, thue_morse("ab")), (2, thue_morse("ba")), (3, thue_morse("cd"))]
    assert rows_of(substring_dedup(clashing(spark, rows))) == substring_brute(rows)


def test_all_hashes_equal(spark, monkeypatch):
    """Where every word has one hash, words alone tell windows apart."""
    monkeypatch.setattr(S, "_LETTER", S._LETTER * S.np.uint64(0))
    for rows in (awkward(), [(k % 7, " ".join(random.Random(k).choices("abc", k=30))) for k in range(60)]):
        ids = [r for r in rows if r[0] is not None]
        t = S.pa.table({"shard": S.pa.array([0] * len(ids), S.pa.int64()), "doc_id": S.pa.array([i for i, _ in ids], S.pa.int64()), "text": S.pa.array([x for _, x in ids], S.pa.string())})
        q = S._questions(t)
        known = S.pa.table({"h": q.column("h"), "places": q.column("places"), "fan": S.pa.array([False] * len(q))})
        phrases = S._phrases(t, known).drop_columns(["fan"]).sort_by("key")
        found = S.pa.Table.from_batches(S._told(iter(phrases.to_batches())), S._STRETCH)
        got = S._stripped(t, found, False)
        assert sorted(zip(*(got.column(c).to_pylist() for c in got.column_names), strict=True), key=repr) == substring_brute(ids)


def test_repeated_ids_and_rows(spark, monkeypatch):
    rng = random.Random(10)
    a, b = prose(rng, 40), prose(rng, 30)
    rows = [(5, a), (5, a + " " + b), (5, a), (7, b), (7, a), (None, a), (None, b), (2, "x " * 30), (2, "x " * 30)]
    for shard in (8_000_000, 100):
        monkeypatch.setattr(S, "SHARD_BYTES", shard)
        got = substring_dedup(clashing(spark, rows), texts=True)
        assert rows_of(got.drop("kept_text")) == substring_brute(rows)
        assert rows_of(substring_dedup(clashing(spark, rows, "doc_id int, text string"))) == substring_brute(rows)


def test_long_text_in_chunks(spark):
    rng = random.Random(9)
    rows = [(1, prose(rng, 400)), (2, prose(rng, 200_000)), (3, "")]
    rows[2] = (3, rows[0][1] + " " + rows[1][1][-2000:])
    assert rows_of(substring_dedup(clashing(spark, rows))) == substring_brute(rows)


def test_no_join_of_near_duplicates_is_broadcast_by_an_estimate(spark, monkeypatch):
    """Files of a few kilobytes, whose rows become many more: all of them were sent to the driver."""
    monkeypatch.setattr(common, "EDGES_BROADCAST", 0, raising=False)
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for module in (common, simhash):
        monkeypatch.setattr(module, "written", lambda df, real=module.written: real(planned(df)))
    rows = [(i, t) for i, t in awkward() if i is not None]
    out = planned(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    expected = linked([fingerprint(t) for _, t in rows])
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: rows[k][0] for (i, _), k in zip(rows, expected, strict=True)}
    assert sum("Join" in p for p in plans) > 3 and not any("Broadcast" in p for p in plans)
