import random
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.context import fallback_context, full_context, parse_context, prompt
from lodestone.functions.fuzzy import fuzzy_score
from lodestone.functions.paths import basename, dirname, excluded, glob_regex, language
from lodestone.functions.stem import stem
from lodestone.functions.text import Phrase, clean_query, cleaned, parse_query, tokens
from lodestone.functions.vector import cosine, cosine_to, from_blob, literal
from lodestone.schema import EXCLUDED, Config

FUZZY = [("abc", "abc", 51.8), ("abc", "xabc", 26.8), ("user", "/w/src/UserModel.ts", 78.7), ("um", "/w/src/UserModel.ts", 58.6), ("user", "/w/user/x.ts", 58.7), ("1", "v1.ts", 22.0), ("srcdb", "/w/src/db/pool.py", 74.5), ("login ts", "/w/login ts", 224.3), ("zz", "/w/a.ts", None), ("a", "b", None), ("", "a", None), ("a", "", None), (None, "a", None), ("a", None, None)]


def scalar_fuzzy(q, t):
    """The score, spelled out."""
    if not q or not t:
        return None
    at, k = [], 0
    for i, c in enumerate(t):
        if k < len(q) and c.lower() == q[k].lower():
            at.append(i)
            k += 1
    if k < len(q):
        return None
    score, last, run = 0.0, -1, 0
    for i in at:
        prev, cur = t[i - 1] if i else "", t[i]
        run = run + 1 if i == last + 1 else 0
        camel = i > 0 and prev == prev.lower() and cur == cur.upper()
        score += 1 + 5 * run + (10 if i == 0 or prev in " -_/\\" or camel else 0) + (15 if prev and prev in "/\\" else 0) + (8 if camel else 0)
        last = i
    name = max(t.rfind("/"), t.rfind("\\"))
    return score - 0.1 * (at[-1] - at[0]) + 3 * sum(i >= name for i in at)


def test_fuzzy_goldens(spark):
    df = spark.createDataFrame([(q, t) for q, t, _ in FUZZY], "q string, t string")
    got = [r[0] for r in df.select(fuzzy_score(F.col("q"), F.col("t"))).collect()]
    assert [g if g is None else round(g, 6) for g in got] == [x for *_, x in FUZZY]


def test_fuzzy_equals_scalar(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("abAB1/_", k=rng.randint(1, 3))), "".join(rng.choices("abAB1/_-\\ .", k=rng.randint(1, 14)))) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, t string").select(fuzzy_score(F.col("q"), F.col("t"))).collect()]
    for (q, t), g in zip(rows, got, strict=True):
        x = scalar_fuzzy(q, t)
        assert (g is None) == (x is None) and (x is None or abs(g - x) < 1e-9), (q, t)


STEMS = "connections connect connecting connect users user parsing pars authentication authent generalization gener running run flies fli an an is is caresses caress relational relat happy happi agreed agre sky sky triplicate triplic hopeful hope goodness good effective effect controlling control probate probat".split()


def test_stems():
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]
    long = "x" * 70 + "ing"
    assert stem(long) == long


def test_stems_equal_sqlite():
    rng = random.Random(3)
    suffixes = "ational tional enci izer alli entli ousli ization ator alism iveness fulness biliti icate ative alize ical ful ness al ance ence able ible ement ment ent ion ous ive ize s es ies ed ing eed y ll e sses".split()
    words = sorted({"".join(rng.choices("abcdeghilmnorstuvy", k=rng.randint(2, 6))) + rng.choice(suffixes) for _ in range(3000)})
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, tokenize='porter ascii')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, a) values (?, ?)", list(enumerate(words, 1)))
    known = dict(con.execute("select doc, term from v"))
    odd = [w for i, w in enumerate(words, 1) if stem(w) != known[i]]
    assert len(odd) <= 2, odd  # a word that is a suffix and no more


def test_query_cleaning(spark):
    assert cleaned('find (auth) AND not_found or "x:y"*') == "find auth not_found x y"
    for raw, clean in [("éor x", "é x"), ("x-AND-y", "x- -y"), ("a\u00a0\u2003b\ufeff", "a b"), ("a\x85b", "a\x85b"), ("Near_by nearby", "Near_by nearby")]:
        assert cleaned(raw) == clean == spark.createDataFrame([(raw,)], "q string").select(clean_query(F.col("q"))).first()[0], raw


@pytest.mark.parametrize("q", ["what's", "foo.bar", "a-b", "user, token", "{user}", "?", "src/auth", "@user", "user;", "user!", "$user", "#user", "a=b", "<user>", "user|token", "user&token", "user%", "~user", "return -user", "foo +", "+ foo", "foo^", "___", "", "AND"])
def test_queries_that_match_nothing(q):
    assert parse_query(q) is None


def test_queries():
    assert parse_query("___ user") == [Phrase(("user",))]
    assert parse_query("token_refresh") == [Phrase(("token", "refresh"))]
    assert parse_query("user + record") == [Phrase(("user", "record"))]
    assert parse_query("^ class x") == [Phrase(("class",), True), Phrase(("x",))]
    assert parse_query("UsErS") == [Phrase(("user",))]
    assert parse_query("src/auth", lenient=True) == [Phrase(("src",)), Phrase(("auth",))]


def test_tokens(spark):
    row = spark.createDataFrame([("Foo-bar É é_1",), (None,)], "t string").select(tokens(F.col("t"))).collect()
    assert row[0][0] == ["foo", "bar", "É", "é", "1"] and row[1][0] == []


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([3.0, 4.0],)], "v array<float>")
    for score in (cosine(F.col("v"), literal([1.0, 0.0])), cosine_to([1.0, 0.0], F.col("v"))):
        assert [r[0] if r[0] is None else round(r[0], 9) for r in df.select(score).collect()] == [1.0, None, None, None, 0.6]


def test_blobs(spark):
    import struct

    df = spark.createDataFrame([(bytearray(struct.pack("<2f", 1.5, -2.0)),), (bytearray(b"abc"),)], "b binary")
    assert [r[0] for r in df.select(from_blob("b")).collect()] == [[1.5, -2.0], None]


def test_paths(spark):
    df = spark.createDataFrame([("/w/src/a.TSX",), ("a.py",), ("/w/dir/",), ("x/.git/y.js",)], "p string")
    rows = df.select(basename(F.col("p")), dirname(F.col("p")), language(F.col("p")), excluded(F.col("p"), EXCLUDED)).collect()
    assert [tuple(r) for r in rows] == [("a.TSX", "/w/src", "typescriptreact", False), ("a.py", "", "python", False), ("/w/dir/", "/w/dir", "plaintext", False), ("y.js", "x/.git", "javascript", True)]


@pytest.mark.parametrize(("glob", "path", "found"), [("**/*.min.js", "a/b.min.js", True), ("**/*.min.js", "b.min.js", True), ("**/dist/**", "src/dist/x", True), ("**/dist/**", "distant/x", False), ("*.{a,b}", "x.b", True), ("a?c", "a/c", False)])
def test_globs(glob, path, found):
    assert bool(re.match(glob_regex(glob), path)) == found


def test_parse_context(spark):
    text = "SUMMARY: one\nnoise\n SUMMARY: indented\nSUMMARY: two \nPURPOSE:\nCONCEPTS: a, ,b ,\nDEPENDENCIES: x"
    df = spark.createDataFrame([(text,), (None,), ("SUMMARY: ",)], "a string").select(parse_context(F.col("a")).alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [("two", None, ["a", "b"], [], ["x"]), (None, None, [], [], []), (None, None, [], [], [])]


def test_contexts(spark):
    df = spark.createDataFrame([("/a/b.py", 1, 2, "x", "fn", None), ("/a/b.py", 1, 2, "x", "", "C")], "file_path string, start_line int, end_line int, content string, function_name string, class_name string")
    own = {c: F.col(c) for c in df.columns}
    rows = df.select(fallback_context(own).alias("f")).select("f.summary", "f.related_concepts", "f.full_context").collect()
    assert tuple(rows[0]) == ("Function fn in /a/b.py", [], "Function fn in /a/b.py\n\nx")
    assert tuple(rows[1]) == ("Code in /a/b.py lines 1-2", ["C"], "Code in /a/b.py lines 1-2\n\nx")
    none = F.array().cast("array<string>")
    made = df.select(full_context(own, {"summary": F.lit("s"), "purpose": F.lit(None).cast("string"), "related_concepts": F.array(F.lit("k"), F.lit("l")), "usage_patterns": none, "dependencies": none})).first()[0]
    assert made == "File: /a/b.py\nFunction: fn\nSummary: s\nConcepts: k, l\n\nCode:\nx"


def test_prompt():
    chunk = {"file_path": "/a/b.py", "content": "x = 1", "language": "python", "start_line": 3, "end_line": 4}
    assert prompt(chunk, "{code}|{language}|{fileName}|{filePath}|{startLine}|{endLine}|{code}") == "x = 1|python|b.py|/a/b.py|3|4|{code}"
    built = prompt(chunk, related=[chunk | {"content": "y" * 900}])
    assert "x = 1" in built and "y" * 500 in built and "y" * 501 not in built


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=30))
def test_parse_query_never_fails(q):
    parse_query(q)
    parse_query(q, lenient=True)


def test_config():
    for bad in ({"search_mode": "x"}, {"rrf_k": 0}, {"chunk_size": 5, "chunk_overlap": 5}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_each_word_of_a_batch_is_stemmed_once(monkeypatch):
    import pyarrow as pa

    from lodestone.functions import text

    seen = []
    monkeypatch.setattr(text, "stem", lambda w: seen.append(w) or stem(w))
    rows = [["running", "flies"], None, [], ["flies", "é", "running"], ["cats"]]
    want = [None if ws is None else [stem(w) for w in ws] for ws in rows]
    for k, n in ((0, 5), (1, 3), (3, 2), (2, 0)):  # slices of a larger array too
        assert text.stemmed(pa.array(rows, pa.list_(pa.string())).slice(k, n)).to_pylist() == want[k : k + n]
    assert len(seen) <= 4 + 3 + 4
