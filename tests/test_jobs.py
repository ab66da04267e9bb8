import logging
import math
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import index_feed, saved_searches
from jobs.common import settings
from jobs.queries import ORACLES, QUERIES
from lodestone.operators.chunker import line_windows

from .compare import of_duckdb, of_spark

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id bigint, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, name):
    before = dict(spark.conf.getAll)
    assert of_spark(QUERIES[name](spark, data)) == of_duckdb(ORACLES[name], data)
    assert before == dict(spark.conf.getAll)


def _add(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(folder)


def _text(n, word="w"):
    return "\n".join(f"{word}{k} line" for k in range(n))


def _expected(spark, rows, own):
    """Chunks of the last text of each document."""
    last = {i: (i, t or "", lang or "none", s or "none") for i, t, lang, s in rows if i is not None}
    files = spark.createDataFrame([(f"/{s}/{lang}/{i}.txt", t, lang) for i, t, lang, s in last.values()], "file_path string, content string, language string")
    return {tuple(r) for r in line_windows(files, own.lines, own.overlap).select("file_path", "start_line", "end_line", "content_hash", "language").collect()}


def _now(spark, target):
    rows = index_feed.current(spark, target).collect()
    return {(r.file_path, r.start_line, r.end_line, r.content_hash, r.language) for r in rows if r.kind == "chunk"}, {r.file_path: r.batch for r in rows if r.kind == "file"}, rows


def test_feed_takes_only_what_is_new(spark, tmp_path, caplog):
    docs, target, checkpoint, own = f"{tmp_path}/docs", f"{tmp_path}/index", f"{tmp_path}/cp", index_feed.Settings(4, 1)
    first = [(1, _text(9), "en", "a"), (2, _text(3), "01", "b/c"), (3, None, None, ""), (4, "x\n" * 7, "de", "a"), (None, "nobody", "en", "a")]
    _add(spark, first, docs)
    with caplog.at_level(logging.INFO, "lodestone.jobs"):
        index_feed.run(spark, docs, target, checkpoint, own)
    assert "batch 0: 4 changed documents" in caplog.text and "5 rows of documents were new" in caplog.text
    chunks, files, _ = _now(spark, target)
    assert chunks == _expected(spark, first, own) and set(files.values()) == {0} and len(files) == 4
    # one changed, one as it was, one blank, one new
    second = [(1, _text(9, "v"), "en", "a"), (2, _text(3), "01", "b/c"), (4, " \n ", "de", "a"), (5, _text(6), "en", "a")]
    _add(spark, second, docs)
    index_feed.run(spark, docs, target, checkpoint, own)
    chunks, files, rows = _now(spark, target)
    assert chunks == _expected(spark, first + second, own)
    assert files == {"/a/en/1.txt": 1, "/b/c/01/2.txt": 0, "/none/none/3.txt": 0, "/a/de/4.txt": 1, "/a/en/5.txt": 1}
    # nothing new
    caplog.clear()
    with caplog.at_level(logging.INFO, "lodestone.jobs"):
        index_feed.run(spark, docs, target, checkpoint, own)
    assert "0 rows of documents were new" in caplog.text and sorted(map(str, _now(spark, target)[2])) == sorted(map(str, rows))


def test_feed_runs_an_interrupted_batch_again(spark, tmp_path):
    docs, target, checkpoint, own = f"{tmp_path}/docs", f"{tmp_path}/index", f"{tmp_path}/cp", index_feed.Settings(4, 1)
    for k in range(2):
        _add(spark, [(1, _text(5 + k), "en", "a"), (2, _text(5), "en", "a")], docs)
        index_feed.run(spark, docs, target, checkpoint, own)
    whole = sorted(map(str, index_feed.output(spark, target).collect()))
    # as if the process had ended after the batch was written and before Spark noted it
    for f in Path(checkpoint, "commits").glob("*1*"):
        f.unlink()
    spark.createDataFrame([("left over",)], "content string").write.parquet(f"{target}/batch=1/kind=chunk/language=xx")
    index_feed.run(spark, docs, target, checkpoint, own)
    assert sorted(map(str, index_feed.output(spark, target).collect())) == whole


def test_feed_with_repeated_rows_and_batches_of_one_file(spark, tmp_path):
    docs, target, own = f"{tmp_path}/docs", f"{tmp_path}/index", index_feed.Settings(3, 0, files_per_batch=1)
    _add(spark, [(1, "a", "en", "s"), (1, "b", "en", "s"), (1, "b", "en", "s"), (2, "c", "en", "s")], docs)
    _add(spark, [(2, "d", "en", "s")], docs)
    index_feed.run(spark, docs, target, f"{tmp_path}/cp", own)
    rows = index_feed.output(spark, target).where("kind = 'chunk'").collect()
    assert sorted({r.batch for r in rows}) == [0, 1]
    assert {(r.file_path, r.content) for r in index_feed.current(spark, target).where("kind = 'chunk'").collect()} in ({("/s/en/1.txt", "b"), ("/s/en/2.txt", "d")}, {("/s/en/1.txt", "b"), ("/s/en/2.txt", "c")})


def test_feed_over_no_documents(spark, tmp_path):
    _add(spark, [], f"{tmp_path}/docs")
    for _ in range(2):
        index_feed.run(spark, f"{tmp_path}/docs", f"{tmp_path}/index", f"{tmp_path}/cp")


def _tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _answers(docs, items, own):
    docs = [(i, Counter(_tokens(t)), lang or "none") for i, t, lang in docs if i is not None]
    full = [d for d in docs if d[1]]
    df = Counter(w for _, c, _ in full for w in c)
    n, mean = len(full), sum(sum(c.values()) for _, c, _ in full) / max(1, len(full))
    out = []
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(_tokens(t))
    for i, ws in asked.items():
        telling = sorted((w for w in ws if w in df), key=lambda w: (df[w], w))[: own.terms]
        found = []
        for d, c, lang in full:
            if telling and all(w in c for w in telling):
                idf = [max(0, x) or 1e-6 for x in (math.log((n - df[w] + 0.5) / (df[w] + 0.5)) for w in telling)]
                found.append((-sum(f * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for f, w in zip(idf, telling, strict=True)), d, lang))
        out += [(i, k + 1, d, round(r, 6), lang) for k, (r, d, lang) in enumerate(sorted(found)[: own.limit])]
    return sorted(out)


def test_searches_against_brute_force(spark, tmp_path):
    words = "alpha beta gamma delta É é x1 X1 the the the".split()
    docs = [(k, " ".join(words[(k * j) % len(words)] for j in range(1, 3 + k % 7)), ["en", "", None, "de"][k % 4]) for k in range(60)]
    docs += [(100, None, "en"), (101, "", "en"), (None, "alpha", "en"), (102, "only here é", "fr")]
    items = [(1, "Alpha, beta!"), (2, "the"), (3, "nowhere"), (4, None), (5, "é ONLY here"), (6, "gamma delta x1 beta"), (6, "gamma"), (None, "alpha")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 as term", "2 as dl").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as df").write.parquet(f"{tmp_path}/i")
    own = saved_searches.Settings(terms=2, limit=4)
    for _ in range(2):
        saved_searches.run(spark, f"{tmp_path}/d", f"{tmp_path}/i", f"{tmp_path}/out", f"{tmp_path}/work", own)
        got = saved_searches.output(spark, f"{tmp_path}/out").withColumn("rank", F.round("rank", 6))
        assert sorted(tuple(r) for r in got.collect()) == _answers(docs, items, own)
    assert Path(tmp_path, "out/language=none").exists()


def test_searches_over_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/i")
    saved_searches.run(spark, f"{tmp_path}/d", f"{tmp_path}/i", f"{tmp_path}/out", f"{tmp_path}/work")
    assert saved_searches.output(spark, f"{tmp_path}/out").count() == 0


@pytest.mark.parametrize("job, paths", [("index_feed", ("documents", "target", "checkpoint")), ("saved_searches", ("documents", "items", "target", "work"))])
def test_command_line(tmp_path, data, job, paths):
    given = {"documents": f"{data}/documents.parquet", "items": f"{data}/benchmark.parquet"}
    args = [x for p in paths for x in (f"--{p}", given.get(p, f"{tmp_path}/{p}"))]
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "lodestone.jobs" in done.stderr and list(Path(tmp_path, "target").rglob("*.parquet"))


def test_settings(tmp_path):
    assert settings(index_feed.Settings, ROOT / "jobs/index_feed.toml") == index_feed.Settings()
    assert settings(saved_searches.Settings, ROOT / "jobs/saved_searches.toml") == saved_searches.Settings()
    (tmp_path / "x.toml").write_text("[settings]\nlimits = 3\n")
    with pytest.raises(ValueError, match="limits"):
        settings(saved_searches.Settings, tmp_path / "x.toml")
