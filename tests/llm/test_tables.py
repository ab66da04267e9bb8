import datetime
import math
import random
import re
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import mixing as M
from lodestone.llm.queries import oracle_sql, queries
from lodestone.llm.url_filter import host_of, intervals, url_filter

from ..compare import of_duckdb, of_spark
from .helpers import awkward, clashing, prose


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, data, name):
    assert of_spark(queries()[name](spark, data)) == of_duckdb(oracle_sql()[name], data)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_returns_every_row(spark, data, name):
    source = "pages" if "html" in name else "documents"
    assert queries()[name](spark, data).count() == spark.read.parquet(f"{data}/{source}.parquet").count()


def test_base_sql_on_awkward_texts(spark, tmp_path):
    """The SQL of the three rules and the operator on texts where matches touch, fail and overlap."""
    rng = random.Random(25)
    parts = ["token", "=", " ", ":", "AKIA", "A1B2C3D4E5F6G7H8", "abcdef0123456789", "'", "\n", "é", "secret", "Api_Key", "password", "\""]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(1000, None), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.execute(f"select doc_id, n_assign, n_access, n_hex, base_sha256 from ({oracle_sql()['secrets_base']})").fetchall()
    got = queries()["secrets_base"](spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(wanted) and any(sum(w[1:4]) > 2 for w in wanted)


# Mixing


def test_sources_without_tokens_do_not_count(spark, tmp_path):
    rows = [(f"s{k % 5}", " ".join(["w"] * (3 + k % 5))) for k in range(60)] + [("silent", t) for t in ("", None, " ")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.execute(f"select doc_id, source, n_tokens, block, weight, copies from ({oracle_sql()['op5_mix']})").fetchall()
    got = queries()["op5_mix"](spark, str(tmp_path)).select("doc_id", "source", "n_tokens", "block", "weight", "copies").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert len({r.weight for r in got if r.source != "silent"}) == 5


def sources(seed=3):
    rng = random.Random(seed)
    sizes = {"big": 900, "mid": 200, "small": 40, "tiny": 6}
    return [(i, s, prose(rng, rng.randint(3, 30))) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]


def weights_brute(tokens, mix):
    """The weights, by a fine search over the exponent."""
    total = sum(tokens.values())

    def at(t):
        w = {s: (n / total) ** t for s, n in tokens.items()}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    repeats = lambda w: max(mix.budget * total * x / tokens[s] for s, x in w.items())
    grid = [k / 20000 for k in range(20001)]
    flat = max((t for t in grid if entropy(at(t)) >= mix.entropy * math.log(len(tokens))), default=0)
    bounded = min((t for t in grid if repeats(at(t)) <= mix.max_repeats), default=1)
    return at(max(flat, bounded)), max(flat, bounded)


@pytest.mark.parametrize("mix", [M.Mix(blocks=64), M.Mix(blocks=64, entropy=0.9, max_repeats=100.0), M.Mix(blocks=16, entropy=0.99, max_repeats=2.0, budget=0.5), M.Mix(blocks=8, entropy=0.0)])
def test_mix(spark, mix):
    rows = sources()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'clash' as weight", "'clash' as copies", "'clash' as block", "'clash' as p_source")
    got = M.mix_sources(docs, mix).collect()
    tokens = defaultdict(int)
    for _, s, t in rows:
        tokens[s] += len(t.split())
    wanted, _ = weights_brute(tokens, mix)
    drawn, block, copies, weight = defaultdict(int), defaultdict(int), {}, {}
    for r in got:
        drawn[r.source] += r.copies * r.n_tokens
        block[r.source, r.block] += r.n_tokens
        assert copies.setdefault((r.source, r.block), r.copies) == r.copies  # blocks are drawn whole
        weight[r.source] = r.weight
    assert len(got) == len(rows) and sum(weight.values()) == pytest.approx(1)
    total = sum(tokens.values())
    for s, w in wanted.items():
        assert weight[s] == pytest.approx(w, abs=2e-4)
        largest = max(n for (x, _), n in block.items() if x == s)
        assert abs(drawn[s] - weight[s] * total * mix.budget) <= largest / 2 + 1


@pytest.mark.parametrize("wrong", [{"budget": 8.0, "max_repeats": 2.0}, {"entropy": 1.5}, {"budget": -1.0}, {"blocks": 0}])
def test_impossible_mixes_are_refused(wrong):
    with pytest.raises(ValueError):
        M.Mix(**wrong)


def test_draw_follows_the_plan(spark):
    mix = M.Mix(blocks=16)
    docs = spark.createDataFrame(sources(), "doc_id long, source string, text string").selectExpr("*", "'old' as mix_pass")
    mixed = M.mix_sources(docs, mix).collect()
    copies = {r.doc_id: r.copies for r in mixed}
    found, places = defaultdict(list), defaultdict(list)
    for r in M.draw(docs, mix).collect():
        found[r.doc_id].append(r.mix_pass)
        places[r.doc_id].append((r.mix_pass, r.mix_place))
    assert all(r.places == ",".join(f"{a}:{b}" for a, b in sorted(places[r.doc_id])) for r in mixed)
    assert {k: len(v) for k, v in found.items()} == {k: n for k, n in copies.items() if n}
    assert all(sorted(v) == list(range(len(v))) for v in found.values())


def test_passes_are_permutations(spark):
    docs = spark.createDataFrame(sources(), "doc_id long, source string, text string")
    places = defaultdict(lambda: defaultdict(list))
    for r in M.draw(docs, M.Mix(blocks=16)).selectExpr("source", "mix_pass", "mix_place").distinct().collect():
        places[r.source][r.mix_pass].append(r.mix_place)
    for passes in places.values():
        for p in sorted(passes)[:-1]:
            assert sorted(passes[p]) == list(range(1, len(passes[p]) + 1))


def test_mix_awkward(spark):
    docs = clashing(spark, awkward(), source="case when doc_id % 2 = 0 then null else 'a' end")
    got = M.mix_sources(docs, M.Mix(blocks=4)).collect()
    assert len(got) == docs.count() and {r.source for r in got} == {"", "a"}
    one = M.mix_sources(docs.where("false")).collect()
    assert one == []
    silent = M.mix_sources(clashing(spark, [(1, ""), (2, None)]), M.Mix(blocks=4)).collect()
    assert [r.copies for r in silent] == [0, 0] and M.draw(clashing(spark, [(1, "")])).count() == 0


# URLs

T = lambda d: datetime.datetime(2024, 1, d)


def test_hosts(spark):
    urls = ["http://WWW.Example.com./x", "https://u:p@a.b:80/y?z#h", "ftp://h", "no url", "http:///x", None, "http://a.b?x", "http://a.b#x", "http://[2001:DB8::1]:80/x", "http://u@[::1]", "//c.d/e", "///x", "/path"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(host_of(df.url)).collect()] == ["www.example.com", "a.b", "h", None, None, None, "a.b", "a.b", "[2001:db8::1]", "[::1]", "c.d", None, None]


def test_intervals(spark):
    acts = [("domain", "a.b", "add", T(1)), ("domain", "a.b", "add", T(1)), ("domain", "A.B", "remove", T(3)), ("domain", "a.b", "add", T(5)), ("domain", "a.b", "add", T(6)), ("host", "c", "add", T(2)), ("host", "c", "remove", T(2)), ("other", "x", "add", T(1)), ("host", None, "add", T(1)), ("host", "y", "add", None)]
    got = rows_of(intervals(spark.createDataFrame(acts, "kind string, pattern string, action string, at timestamp")))
    assert got == sorted([("domain", "a.b", T(1), T(3)), ("domain", "a.b", T(5), T(6)), ("domain", "a.b", T(6), None)], key=repr)


def active_brute(url_host, when, acts):
    found = []
    for kind, pattern in {(a[0], a[1]) for a in acts}:
        address = url_host is not None and re.fullmatch(r"\[.*\]|\d+(\.\d+){3}", url_host)
        fits = url_host is not None and (url_host == pattern or (kind == "domain" and not address and url_host.endswith("." + pattern)))
        past = [(a[3], a[2]) for a in acts if a[:2] == (kind, pattern) and when is not None and a[3] <= when]
        if fits and past and max(past)[1] == "add":
            found.append((len(pattern), kind, pattern))
    return len(found), max(found)[2] if found else None


def test_url_filter(spark):
    rng = random.Random(2)
    names = ["a.b", "x.a.b", "y.x.a.b", "b", "c.b", "aa.b", "10.0.0.1", "0.1", "[::1]"]
    acts = [(rng.choice(["host", "domain"]), rng.choice(names), rng.choice(["add", "remove"]), T(rng.randint(1, 28))) for _ in range(60)]
    caps = [(i, rng.choice(names + [None]), T(rng.randint(1, 28)) if rng.random() < 0.95 else None) for i in range(300)]
    caps += [(1000, "a.b", T(7))] * 3
    df = spark.createDataFrame([(i, h and f"http://{h}/p", t) for i, h, t in caps], "page_id long, url string, fetched timestamp").selectExpr("*", *[f"'clash' as {c}" for c in ("host", "pattern", "of", "known", "kind", "blocked", "row", "since", "until", "best", "n_active")])
    got = rows_of(url_filter(df, spark.createDataFrame(acts, "kind string, pattern string, action string, at timestamp")))
    expected = sorted(((i, h, t, n > 0, n, p) for i, h, t in caps for n, p in [active_brute(h, t, acts)]), key=repr)
    assert got == expected


def test_url_filter_empty(spark):
    entries = spark.createDataFrame([], "kind string, pattern string, action string, at timestamp")
    caps = spark.createDataFrame([(1, "http://a.b", T(1)), (None, None, None)], "page_id long, url string, fetched timestamp")
    assert [r.blocked for r in url_filter(caps, entries).collect()] == [False, False] and url_filter(caps.limit(0), entries).count() == 0


def test_long_urls_and_a_hot_host(spark):
    """A host with most captures and a pattern that is often toggled."""
    acts = [("domain", "a.b", "add" if k % 2 else "remove", k) for k in range(1, 2000)]
    caps = [(i, ("http://x.a.b/" + "p" * (100_000 if i == 7 else 3)), i) for i in range(1, 2000)] + [(5000, "http://c.d", 5)]
    got = {r.page_id: r.blocked for r in url_filter(spark.createDataFrame(caps, "page_id long, url string, fetched int"), spark.createDataFrame(acts, "kind string, pattern string, action string, at int")).collect()}
    assert got == {i: i % 2 == 1 for i in range(1, 2000)} | {5000: False}


def test_url_filter_stays_in_the_jvm(spark, data):
    plan = queries()["op10_url_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and "html" not in plan
