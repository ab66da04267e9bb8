import hashlib
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import parse_query
from lodestone.operators import bulk, display, fulltext, fusion, lookup
from lodestone.operators.chunker import PATTERNS, chunk_files, line_windows, patterns, spans
from lodestone.operators.neighbours import nearest_of_each
from lodestone.operators.search import Searcher, best_per, chunk_at_line, chunks_at_lines, vector_topk
from lodestone.schema import Config
from lodestone.sources.providers import HashingEmbedder

FT1 = [
    ("c1", "/w/src/auth/login.ts", "loginUser", None, "function loginUser(name) { return authenticate(name); }"),
    ("c2", "/w/src/auth/token.ts", "refreshToken", None, "function refreshToken(user) { return user.token_refresh(user); }"),
    ("c3", "/w/src/db/pool.py", None, "ConnectionPool", "class ConnectionPool: manages database connections and connecting"),
    ("c4", "/w/src/db/user_model.py", None, "UserModel", "class UserModel: user user record"),
    ("c5", "/w/README.py", None, None, "nothing here at all"),
    ("c6", "/w/src/ui/form.ts", "validate", None, "validate form input values for users"),
]
SCHEMA = "id string, file_path string, function_name string, class_name string, content string"


@pytest.fixture(scope="module")
def index(spark):
    return fulltext.postings(spark.createDataFrame(FT1, SCHEMA)).cache()


@pytest.mark.parametrize(("query", "top", "rank"), [("user", ["c4", "c2", "c6"], -1.5618661257606492e-06), ("connection", ["c3"], -1.7308787158828736), ("class", ["c4", "c3"], -0.5809958048454836), ("^class", ["c4", "c3"], -0.5809958048454836), ("token_refresh", ["c2"], -1.2010178844901573), ("token refresh", ["c2"], -2.892392183357953), ("user + record", ["c4"], -1.2842720125549436), ("users connect", [], 0), ("2 users", [], 0), ("x + y", [], 0)])
def test_bm25_goldens(index, query, top, rank):
    rows = fulltext.keyword_search(index, parse_query(query)).collect()
    assert [r.chunk_id for r in rows] == top
    assert not top or rows[0]["rank"] == pytest.approx(rank, rel=1e-12)


@pytest.mark.parametrize("query", ["user", "user user", "user return", "token_refresh function", "class user", "login ts", "src ts", "auth", "^validate form"])
def test_bm25_equals_sqlite(index, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(chunk_id unindexed, file_path, function_name, class_name, content, tokenize='porter ascii')")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", [tuple(x or "" for x in r) for r in FT1])
    expected = con.execute("select chunk_id, rank from t where t match ? order by rank, chunk_id", (query,)).fetchall()
    got = [tuple(r) for r in fulltext.keyword_search(index, parse_query(query)).collect()]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], rel=1e-12)


@pytest.mark.parametrize(("query", "ids"), [("foo_bar", [1]), ("foo + bar", [1]), ("foo bar", [1, 2, 4]), ("^foo", [1, 3, 4]), ("^bar", [2, 4]), ("é", [6])])
def test_phrases_and_anchors(spark, query, ids):
    rows = spark.createDataFrame([(1, "foo bar", "baz"), (2, "bar foo", "baz"), (3, "baz", "foo"), (4, "foo", "bar qux"), (6, "qux foo", "é Éa")], "id int, a string, b string")
    got = fulltext.keyword_search(fulltext.postings(rows, ["a", "b"]), parse_query(query)).collect()
    assert sorted(r.chunk_id for r in got) == ids


def test_fusion_goldens(spark):
    arms = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (1, "y", 1), (1, "z", 2), (2, "z", 1), (2, "w", 2)], "arm int, id string, rank int")
    rows = fusion.min_max(fusion.rrf(arms, 60, 3)).orderBy(F.desc("score"), "met").collect()
    assert [(r.id, r.similarity) for r in rows] == [("y", 1.0), ("z", 1.0), ("x", 0.0)]
    assert rows[0].score == 0.03252247488101534 == rows[1].score and rows[2].score == 0.01639344262295082


def test_keyword_similarity(spark):
    sims = lambda ranks: [r.similarity for r in fusion.from_best(spark.createDataFrame([(x,) for x in ranks], "rank double")).orderBy("rank").collect()]
    assert sims([-3.0, -2.0, -1.0]) == [1.0, 0.5, 0.0] and sims([-3.0]) == [1.0]


SPANS = [
    (["import x from 'y';", "function foo(a) {", "  return a;", "}", "const z = 1;", "class Bar {", "  m(x) { return x; }", "}", ""], "typescript", [(1, 3, "foo", None), (5, 7, None, "Bar")]),
    (["function typed() { type T = 1; }", "}", ""], "typescript", [(0, 0, "typed", None), (0, 0, None, "T")]),
    (["if (a) {", "  b();", "}", ""], "typescript", [(0, 2, "if", None)]),
    (["} catch (e) {", "  if (q) {", "    r();", "  }", "}", "rest();", ""], "typescript", [(0, 3, "catch", None)]),
    (["const f = (a) => a;", "const g = 2;", "let h = 3;"], "typescript", [(0, 2, "f", None)]),
    (["function s() {", "  return '}';", "}", "function t() {", "}", ""], "typescript", [(0, 1, "s", None), (3, 4, "t", None)]),
    (["import os", "", "def a(x):", "    return x", "", "class B:", "    def m(self):", "        pass", "", "X = 1", ""], "python", [(2, 4, "a", None), (5, 8, None, "B")]),
    (["def outer():", "    def inner():", "        pass", "    return inner", ""], "python", [(0, 4, "outer", None)]),
    (["def a(", "    x,", "):", "    return x", ""], "python", [(0, 1, "a", None)]),
    ([".foo-bar { x }", "@mixin zap {", "}"], "scss", [(0, 0, None, "foo-bar"), (1, 2, "zap", None)]),
    (["func (r *T) Run() {", "}", "type S struct {", "}"], "go", [(0, 1, "Run", None), (2, 3, None, "S")]),
    (["plain"], "text", []),
]


@pytest.mark.parametrize(("lines", "language", "expected"), SPANS)
def test_spans(lines, language, expected):
    assert [(s.start, s.end, s.function_name, s.class_name) for s in spans("\n".join(lines), language)] == expected


def test_patterns_compile():
    assert all(patterns(x) for x in PATTERNS)


@pytest.mark.parametrize(("n", "expected"), [(1, [(0, 0)]), (450, [(0, 449)]), (451, [(0, 450), (450, 450)]), (500, [(0, 499), (450, 499)])])
def test_line_windows(spark, n, expected):
    files = spark.createDataFrame([("/f", "\n".join(["x"] * n), "text")], "file_path string, content string, language string")
    assert sorted((r.start_line, r.end_line) for r in line_windows(files).collect()) == expected


def test_blank_windows_and_bad_overlap(spark):
    files = spark.createDataFrame([("/f", " \n\u00a0\n", "text"), ("/g", "", "text")], "file_path string, content string, language string")
    assert line_windows(files).count() == 0
    with pytest.raises(ValueError):
        line_windows(files, 5, 5)


def test_chunk_files(spark):
    """Spans or windows, never both; ids and hashes as fixed."""
    source = "import os\n\ndef a(x):\n    return x\n\nclass B:\n    pass\n"
    rows = [("/w/a.py", source, "python"), ("/w/b.py", "x = 1\n", "python"), ("/w/c.txt", "words", "plaintext"), ("/w/d.ts", SPANS[1][0][0] + "\n}\n", "typescript"), ("/w/e.py", None, "python")]
    got = {(r.file_path, r.start_line, r.end_line): r for r in chunk_files(spark.createDataFrame(rows, "file_path string, content string, language string")).collect()}
    assert sorted(got) == [("/w/a.py", 2, 4), ("/w/a.py", 5, 7), ("/w/b.py", 0, 1), ("/w/c.txt", 0, 0), ("/w/d.ts", 0, 0)]
    assert got["/w/a.py", 2, 4].id == "2d790d74b122af990beca10a82823ff01bf0cac418d6cb23529efb119b7bd894"
    assert got["/w/d.ts", 0, 0].class_name == "T"


CHUNKS = [
    ("a1", "/s/a.py", 0, 9, "connect to database", "python", "connect", None),
    ("a2", "/s/a.py", 3, 5, "close the database", "python", "close", None),
    ("b1", "/s/b.ts", 0, 4, "connect to database pool", "typescript", None, "Pool"),
    ("c1", "/t/c.py", 0, 4, "render the form", "python", None, None),
]


@pytest.fixture(scope="module")
def searcher(spark):
    e = HashingEmbedder(64)
    rows = [(*c, e.embed(c[4])) for c in CHUNKS]
    chunks = spark.createDataFrame(rows, "id string, file_path string, start_line int, end_line int, content string, language string, function_name string, class_name string, embedding array<float>").cache()
    return lambda **c: Searcher(chunks, fulltext.postings(chunks), e.embed, Config(**c))


def test_searches(searcher):
    ids = lambda df: [r.chunk.id for r in df.collect()]
    assert ids(searcher(search_mode="semantic").search("connect to database", 2)) == ["a1", "b1"]
    keyword = searcher(search_mode="keyword").search("database connect", 5).collect()
    assert {r.chunk.id for r in keyword} == {"a1", "b1"} and keyword[0].similarity == 1.0
    hybrid = searcher().search("connect", 3).collect()
    assert len(hybrid) == 3 and hybrid[-1].similarity == 0.0 and hybrid[0].similarity == 1.0
    assert ids(searcher().filtered("connect", 3, language="typescript")) == ["b1"]
    assert ids(searcher().filtered("connect", 3, file_pattern="/t/")) in ([], ["c1"])
    with pytest.raises(ValueError):
        searcher().search("  ")


def test_filtered_rows_keep_their_order(searcher):
    rows = [(r.chunk.id, r.similarity) for r in searcher().search("connect", 8).collect()]
    assert [(r.chunk.id, r.similarity) for r in searcher().filtered("connect", 4).collect()] == rows[:4]
    assert [r.chunk.id for r in searcher().filtered("connect", 2, language="python").collect()] == [r.chunk.id for r in searcher().search("connect", 4).collect() if r.chunk.language == "python"][:2]


def test_cached_searcher_is_released(spark, searcher):
    plain = searcher()
    chunks, index = plain.chunks.select("*"), plain.index.select("*")
    with Searcher(chunks, index, plain.embed).cache() as s:
        assert s.chunks.is_cached and s.search("connect", 2).count() == 2
    assert not s.chunks.is_cached and not s.index.is_cached


def test_single_hybrid_hit_is_zero(searcher):
    rows = searcher().search("connect", 1).collect()
    assert [r.similarity for r in rows] == [0.0]


def test_keyword_error_empties_only_that_arm(searcher):
    assert len(searcher().search("what's", 3).collect()) > 0
    assert searcher(search_mode="keyword").search("what's", 3).count() == 0


def test_embedding_failure_fails_the_search(searcher):
    s = searcher()
    s.embed = lambda _: 1 / 0
    with pytest.raises(ZeroDivisionError):
        s.search("connect")


def test_similar(searcher):
    files = [r.chunk.file_path for r in searcher().similar_files("/s/a.py", 15).collect()]
    assert files[0] == "/s/b.ts" and "/s/a.py" not in files and len(files) == len(set(files))
    code = [r.chunk.id for r in searcher().similar_code("/s/a.py", 4, 15).collect()]
    assert "a2" not in code and "a1" in code  # another chunk of the file may come
    assert [r.chunk.id for r in searcher().similar_code("/s/a.py", 99, 15).collect()][0] == "b1"
    assert searcher().similar_files("/none").count() == 0


def test_chunk_at_line(spark, searcher):
    chunks = searcher().chunks
    assert chunk_at_line(chunks, "/s/a.py", 4).first().id == "a2"
    places = spark.createDataFrame([("/s/a.py", 4), ("/s/a.py", 8), ("/s/a.py", 50)], "file_path string, line int")
    assert sorted((r.line, r.id) for r in chunks_at_lines(chunks, places).collect()) == [(4, "a2"), (8, "a1")]


def test_vector_topk_plan(spark):
    """A bounded heap per task, no full sort, and only the needed columns."""
    path = spark.conf.get("spark.checkpoint.dir") + "/vectors"
    spark.createDataFrame([("a", [1.0, 0.0], "long text"), ("b", [0.0, 0.0], "x"), ("c", [1.0], "x"), ("d", None, "x"), ("e", [1.0, 0.0], "x")], "id string, embedding array<float>, content string").write.mode("overwrite").parquet(path)
    top = vector_topk(spark.read.parquet(path), [1.0, 0.0], 10)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "content" not in plan
    assert [r.id for r in top.collect()] == ["a", "e"]  # ties by id


def test_best_per(spark):
    rows = spark.createDataFrame([("a", "f", 0.5), ("b", "f", 0.5), ("c", "g", 0.1)], "id string, file_path string, similarity double")
    assert sorted(r.id for r in best_per(rows, "file_path").collect()) == ["a", "c"]


def test_lookup(spark):
    old = spark.createDataFrame([("1", "h1", "/a"), ("2", "h2", "/a"), ("3", "h3", "/b"), ("4", "h4", "/c")], "id string, content_hash string, file_path string")
    new = spark.createDataFrame([("1", "h1", "/a"), ("2", "x", "/a"), ("5", "h5", "/a")], "id string, content_hash string, file_path string")
    assert {r.id: r.state for r in lookup.diff(old, new).collect()} == {"1": "unchanged", "2": "changed", "3": "removed", "4": "removed", "5": "new"}
    assert sorted(r.id for r in lookup.removed_ids(old, new).collect()) == ["3", "4"]
    touched = spark.createDataFrame([("/a",), ("/b",)], "file_path string")
    once = lookup.merge(old, new, touched)
    assert sorted((r.id, r.content_hash) for r in once.collect()) == [("1", "h1"), ("2", "x"), ("4", "h4"), ("5", "h5")]
    assert sorted(map(tuple, lookup.merge(once, new, touched).collect())) == sorted(map(tuple, once.collect()))
    assert lookup.exists_with_hash(old, "1", "h1") and not lookup.exists_with_hash(old, "1", "x")
    assert lookup.chunk_by_id(old, "3").count() == 1 and lookup.hashes_of_file(old, "/a").count() == 2


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "file_path string, updated_at long")
    assert tuple(lookup.stats(empty).first()) == (0, 0, None, 0)
    assert "Never" in display.status_text(lookup.stats(empty)).first().status


def test_display(searcher):
    hits = searcher(search_mode="semantic").search("connect to database", 1)
    assert tuple(display.search_rows(hits).first()) == ("a.py", "100.0% - Lines 0-9", "connect to database")
    assert tuple(display.quick_rows(hits).first()) == ("a.py", "100.0% · method connect", "/s · Lines 0-9 · connect to database")
    assert tuple(display.similar_rows(hits).first()) == ("a.py · connect()", "100% similar", "/s")


def test_nearest_of_each_against_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 6)).round(1)
    m[40:60] = m[0]  # ties
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(300, None), (301, [0.0] * 6), (302, [1.0] * 5), (None, [1.0] * 6), (7, [1.0, 0.0, 0.0, 0.0, 0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5)
    queries = vectors.where("id % 20 = 0 or id > 299").withColumn("block_x", F.lit(1))
    good = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and v and len(v) == 6 and any(v)]
    want = set()
    for k, v in good:
        if k % 20 == 0:
            sims = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 9), j) for j, w in good if j != k)
            want |= {(k, p + 1, -s) for p, (s, j) in enumerate(sims[:4])}
    for sent in (8 * 6, 8 * 6 * 4, 1 << 20):
        got = nearest_of_each(vectors, queries.select("id", "embedding"), 4, sent=sent).collect()
        assert {(r.id, r.place, round(r.similarity, 9)) for r in got} == want and len(got) == len(want)
        assert {r.other for r in got if r.id == 0} == {40, 41, 42, 43}
    assert nearest_of_each(vectors, vectors.limit(0), 4).count() == nearest_of_each(vectors.limit(0), queries.select("id", "embedding"), 4).count() == 0


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_dictionary_and_bulk_search_agree_with_bm25(spark, monkeypatch, sent):
    monkeypatch.setattr(bulk, "SENT", sent)
    texts = [(k, " ".join(f"w{(k * j * j) % 11}" for j in range(1, 9)) + " É é") for k in range(60)] + [(60, None), (61, "  "), (62, "w1 W1 w1")]
    docs = spark.createDataFrame(texts, "id bigint, content string")
    known = bulk.dictionary(docs, "content")
    index = fulltext.postings(docs, ["content"], stemmed=False)
    assert {r.term: (r.df, r.cf) for r in known.where("term is not null").collect()} == {r.term: (r.df, r.cf) for r in index.groupBy("term").agg(F.countDistinct("chunk_id").alias("df"), F.count("*").alias("cf")).collect()}
    corpus = fulltext.corpus(index).first()
    total = known.where("term is null").first()
    assert (total.df, total.cf) == (corpus.n, corpus.tokens)
    less = bulk.frequencies(docs, "content")
    assert {(r.term, r.df) for r in less.collect()} == {(r.term, r.df) for r in known.collect()} and less.where("term is null").first().cf == total.cf
    asked = spark.createDataFrame([(1, "w1"), (2, "w3 w5"), (3, "w1 W1 é w9"), (4, "none w1"), (5, None)], "item_id bigint, text string")
    searches = bulk.telling_terms(asked, known, 9)
    got = bulk.bulk_keyword(bulk.term_counts(docs, searches, "id", "content"), searches, known.where("term is null"), 7, key="id")
    got = {(r.item_id, r.place, r.id, round(r["rank"], 9)) for r in got.collect()}
    want = set()
    for item, words in ((1, "w1"), (2, "w3 w5"), (3, "w1 é w9"), (4, "w1")):  # words that occur nowhere tell nothing
        hits = fulltext.keyword_search(index, parse_query(words, False), 7).collect()
        want |= {(item, p + 1, r.chunk_id, round(r["rank"], 9)) for p, r in enumerate(hits)}
    assert got == want


def test_large_files_are_cut_one_at_a_time(monkeypatch):
    """What is held doesn't grow with the files of a batch, nor with a file's chunks; the rows are the same."""
    import pyarrow as pa

    from lodestone.operators import chunker

    monkeypatch.setattr(chunker, "_HELD", 1000, raising=False)
    text = "\n".join(f"line {k} é" if k % 7 else " \t" for k in range(500))
    names = ["file_path", "content", "language"]
    files = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([text, "", text]), pa.array(["x", "x", None])], names)
    batches = list(chunker._cut(20, 5, marked=True)(iter([files])))
    assert len(batches) > 10 and max(sum(len(x or "") for x in b.column(4).to_pylist()) for b in batches) < 1500
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    lines = text.split("\n")
    want = ["\n".join(lines[s : s + 20]) for s in range(0, 500, 15)]
    digest = f"{len(want)}:{hashlib.sha256(('20 5' + chr(10) + text).encode()).hexdigest()}"
    for path in "ac":
        own = [r for r in rows if r[0] == path]
        assert own[0][2:] == (None, None, None, None, None, digest) and [r[4] for r in own[1:]] == want and {r[7] for r in own} == {digest}
    assert [r[2:4] for r in rows if r[0] == "b"] == [(None, None)]
