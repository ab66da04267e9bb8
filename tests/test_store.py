import datetime
import http.server
import json
import logging
import os
import shutil
import subprocess
import sys
import threading
import time
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from lodestone.logs import configure
from lodestone.functions.fuzzy import fuzzy_score
from lodestone.functions.paths import closed_folders
from lodestone.functions.sql import register
from lodestone.operators.display import or_message
from lodestone.operators.lookup import chunk_by_id
from lodestone.operators.search import Searcher, fuzzy_paths, rejected, vector_topk
from lodestone.plans.ingest import cancellable, index_files, index_if_empty, reindex, single_flight
from lodestone.schema import EVENT, EXCLUDED, Config
from lodestone.sources.flat import from_flat, to_flat
from lodestone.sources import files as files_of
from lodestone.sources.files import indexable, listed, open_tabs, read_files, with_language
from lodestone.sources.providers import CustomEmbedder, HashingEmbedder, context_of, embedding_of, enrich, ping, retrying
from lodestone.sources.store import ConcurrentCommit, Store
from lodestone.streaming.feed import apply_events, latest, start_feed
from lodestone.streaming.watch import sync_folder, tasks_for, watch_folder

PY = "def a(x):\n    return x\n\nclass B:\n    pass\n"
EMBED = HashingEmbedder(16)


class Context:
    def answer(self, prompt):
        if "boom" in prompt:
            raise OSError("down")
        return "SUMMARY: made\nCONCEPTS: a, b"


def files(spark, **texts):
    return with_language(spark.createDataFrame([(k.replace("__", "."), v) for k, v in texts.items()], "file_path string, content string"))


def state(store):
    return {(r.file_path, r.start_line): (r.content_hash, r.updated_at) for r in store.chunks().collect()}


def test_index_twice_then_change_and_delete(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.chunks().isEmpty() and store.stats().first().total_chunks == 0
    index_files(store, files(spark, a__py=PY, b__py="x = 1\n"), EMBED, now=1)
    first = state(store)
    assert sorted(first) == [("a.py", 0), ("a.py", 3), ("b.py", 0)]
    index_files(store, files(spark, a__py=PY, b__py="x = 1\n"), EMBED, now=2)
    assert state(store) == first  # unchanged rows stay
    index_files(store, files(spark, a__py=PY.replace("pass", "ok = 1")), EMBED, now=3)
    third = state(store)
    assert third["a.py", 0] == first["a.py", 0] and third["a.py", 3][1] == 3 and third["b.py", 0] == first["b.py", 0]
    index_files(store, files(spark, a__py=" \n"), EMBED, now=4)  # no chunk is left
    assert sorted(state(store)) == [("b.py", 0)]
    assert store.index().select("chunk_id").distinct().count() == 1
    assert len(store.versions()) == 3
    store.vacuum(0)
    assert len(store.versions()) == 1 and len(list((tmp_path / "s" / "log").glob("*.json"))) == 1 and sorted(state(store)) == [("b.py", 0)]
    store.delete_files(files(spark, b__py="").select("file_path"))
    assert store.chunks().isEmpty()
    store.clear()
    s = store.stats().first()
    assert s.total_chunks == 0 and s.last_indexed is None


def test_uncommitted_version_is_ignored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    v = index_files(store, files(spark, a__py=PY), EMBED, now=1)
    broken = tmp_path / "s" / "data" / "00000002-broken" / "chunks"
    broken.mkdir(parents=True)
    assert store.version() == v and store.chunks().count() == 2
    store.rebuild()
    store.vacuum()
    assert store.chunks().count() == 2 and not broken.exists() and len(store.versions()) == 2  # its number is taken, so it can't be published


def test_unchanged_files_are_not_cut(spark, tmp_path, monkeypatch):
    """Files whose content and way of cutting the store knows come to nothing; others are as before."""
    import lodestone.plans.ingest as I

    cut, real = [], I.cut_files

    def watched(rows, *size):
        cut.append(sorted(r.file_path for r in rows.collect() if not getattr(r, "same", False)))
        return real(rows, *size)

    monkeypatch.setattr(I, "cut_files", watched)
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    texts = {f"f{k}__py": PY.replace("a", f"a{k}") for k in range(6)} | {"blank__py": " \n"}
    first = index_files(store, files(spark, **texts), EMBED, now=1)
    before = store.chunks().orderBy("id").collect()
    assert index_files(store, files(spark, **texts), EMBED, now=2) == first + 1  # the blank one is looked at again
    assert cut[1] == ["blank.py"] and store.chunks().orderBy("id").collect() == before
    del texts["blank__py"]
    assert index_files(store, files(spark, **texts), EMBED, now=3) == first + 1 and cut[2] == []
    index_files(store, files(spark, **texts | {"f2__py": PY.replace("pass", "go()")}), EMBED, now=4)
    assert cut[3] == ["f2.py"]
    assert {r.updated_at for r in store.chunks().where("file_path = 'f2.py'").collect()} == {4}
    assert len({r.file_hash for r in store.chunks().where("file_path = 'f2.py'").collect()}) == 1
    index_files(store, files(spark, **texts), EMBED, Config(chunk_size=2, chunk_overlap=0), now=5)
    assert len(cut[4]) == 6  # cut in another way


def written_buckets(store, tmp_path, version):
    (commit,) = (tmp_path / "s" / "data").glob(f"{version:08d}-*")
    return {p.name for p in (commit / "chunks").glob("bucket=*")}


def test_a_change_rewrites_its_bucket_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    many = {f"f{k}__py": f"x = {k}\n" for k in range(60)}
    first = index_files(store, files(spark, **many), EMBED, now=1)
    assert len(written_buckets(store, tmp_path, first)) > 8
    second = index_files(store, files(spark, f7__py="y = 1\n"), EMBED, now=2)
    assert len(written_buckets(store, tmp_path, second)) == 1
    rows = {r.file_path: r for r in store.chunks().collect()}
    assert len(rows) == 60 and rows["f7.py"].content == "y = 1\n" and rows["f8.py"].updated_at == 1
    assert store.index().where("term = 'y'").count() == 1
    corpus = store.corpus().first()
    assert (corpus.n, corpus.tokens) == (60, store.index().count())
    assert store.state(first).at != store.state().at and store.chunks(store.state(first)).count() == 60  # older readers
    apply_events(store, spark.createDataFrame([("f9.py", "delete", datetime.datetime(2024, 1, 1))], EVENT), lambda p: p.selectExpr("file_path", "0L as length", "'' as content"), EMBED)
    assert store.chunks().count() == 59
    for _ in range(2):
        store.rebuild()
    store.vacuum(0)
    assert len(list((tmp_path / "s" / "data").iterdir())) == 1 and store.chunks().count() == 59


def test_two_writers(spark, tmp_path):
    """The later of two writers that began at one version fails and loses nothing of the other's."""
    store = Store(spark, str(tmp_path / "s"))
    base = store.state()
    index_files(store, files(spark, a__py="x = 1\n"), EMBED, now=1)
    with pytest.raises(ConcurrentCommit):
        store.commit(store.chunks(), base)
    assert [r.file_path for r in store.chunks().collect()] == ["a.py"]
    assert len(list((tmp_path / "s" / "data").iterdir())) == 1
    with single_flight(store.root), pytest.raises(RuntimeError, match="already"):
        index_files(store, files(spark, b__py="x = 1\n"), EMBED)


def test_half_written_version_is_passed_over(spark, tmp_path, caplog):
    """A version that some crash has left empty stops neither readers nor writers."""
    store = Store(spark, str(tmp_path / "s"))
    index_files(store, files(spark, a__py="x = 1\n"), EMBED, now=1)
    (tmp_path / "s" / "log" / "00000002.json").write_text("")
    assert [r.file_path for r in store.chunks().collect()] == ["a.py"] and "can't be read" in caplog.text
    assert index_files(store, files(spark, b__py="y = 1\n"), EMBED, now=2) == 3
    (tmp_path / "s" / "log" / "00000004.json").write_text('{"buckets": 3')
    assert sorted(r.file_path for r in store.chunks().collect()) == ["a.py", "b.py"]
    store.vacuum(0)
    assert sorted(r.file_path for r in store.chunks().collect()) == ["a.py", "b.py"]
    store.delete_files(files(spark, a__py="").select("file_path"))
    assert [r.file_path for r in store.chunks().collect()] == ["b.py"]


def test_crash_before_publication(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    index_files(store, files(spark, a__py="x = 1\n"), EMBED, now=1)

    def crash(self, state):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Store, "_publish", crash)
        index_files(store, files(spark, b__py="x = 1\n"), EMBED, now=2)
    assert [r.file_path for r in store.chunks().collect()] == ["a.py"]
    index_files(store, files(spark, c__py="x = 1\n"), EMBED, now=3)
    store.vacuum(0)
    assert sorted(r.file_path for r in store.chunks().collect()) == ["a.py", "c.py"]
    assert not [x for x in (tmp_path / "s" / "log").iterdir() if ".json" not in x.name] and len(store._listed("data")) == 2


def test_readers_of_older_versions_go_on(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    index_files(store, files(spark, a__py="x = 1\n"), EMBED, now=1)
    chunks, postings = store.chunks(), store.index()
    for k in range(2, 6):
        index_files(store, files(spark, a__py=f"x = {k}\n"), EMBED, now=k)
        store.vacuum()
    assert [r.content for r in chunks.collect()] == ["x = 1\n"] and postings.where("term = '1'").count() == 1
    store.vacuum(0)
    assert [r.content for r in store.chunks().collect()] == ["x = 5\n"] and store.index().where("term = '5'").count() == 1


def test_buckets_grow_with_the_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2, rows_per_bucket=5)
    seen = []
    for step in range(3):
        index_files(store, files(spark, **{f"f{step}_{k}__py": f"x = {step}{k}\n" for k in range(4 ** (step + 1) // 2)}), EMBED, now=step)
        state_ = store.state()
        seen.append(state_.buckets)
        assert sum(x[1] for x in state_.at.values()) <= 5 * state_.buckets
    assert seen[0] == 2 and seen[-1] >= 16
    rows = {r.file_path: r for r in store.chunks().collect()}
    assert len(rows) == 42 and rows["f0_1.py"].updated_at == 0
    assert store.index().select("chunk_id").distinct().count() == 42 and store.corpus().first().n == 42
    index_files(store, files(spark, f0_1__py="y = 7\n"), EMBED, now=9)
    assert {r.file_path: r.content for r in store.chunks_of(["f0_1.py", "f1_3.py", "none.py"]).collect()} == {"f0_1.py": "y = 7\n", "f1_3.py": "x = 13\n"}


def test_only_the_files_of_hits_are_read(spark, tmp_path):
    """The second step of a search lists the hits' buckets, pushes their paths, and puts out few rows."""
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    index_files(store, files(spark, **{f"f{k}__py": f"value{k} = shared\n" for k in range(60)}), EMBED, now=1)
    read = []

    class Watched(Store):
        def chunks_of(self, paths, state=None):
            read.append((paths, super().chunks_of(paths, state)))
            return read[-1][1]

    own = Searcher.of(Watched(spark, store.root), EMBED.embed)
    hits = own.search("value7 shared", 3).collect()
    assert hits and len(hits) <= 3 and "f7.py" in {r.chunk.file_path for r in hits}
    (paths, df) = read[-1]
    assert sorted({r.chunk.file_path for r in hits}) == sorted(paths)
    assert len(df.inputFiles()) <= 3 and df.count() <= 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]]")[0]
    assert "file_path" in pushed and ("In(file_path" in pushed or "EqualTo(file_path" in pushed)
    for mode in ("semantic", "keyword"):
        plain = Searcher(store.chunks(), store.index(), EMBED.embed, Config(search_mode=mode), corpus=store.corpus())
        same = Searcher.of(store, EMBED.embed, Config(search_mode=mode))
        assert plain.search("value7 shared", 5).collect() == same.search("value7 shared", 5).collect()
    assert {r.chunk.file_path for r in same.similar_files("f3.py", 4).collect()} and "f3.py" not in {r.chunk.file_path for r in same.similar_code("f3.py", 0, 4).collect()}
    assert same.similar_files("none.py", 4).count() == 0


def test_a_look_up_by_id_skips_row_groups(spark, tmp_path):
    """Parquet's bloom filters tell which row groups lack an id, within the range of those that are there."""
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    index_files(store, files(spark, **{f"f{k}__py": f"value = {k}\n" for k in range(200)}), EMBED, now=1)
    some = store.chunks().where("file_path = 'f7.py'").first()

    def scanned(chunk_id):
        df = chunk_by_id(store.chunks(), chunk_id)
        found = df.collect()
        plan, out = df._jdf.queryExecution().executedPlan(), 0
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            out += leaves.apply(i).metrics().apply("numOutputRows").value()
        return found, out

    found, n = scanned(some.id)
    assert [r.file_path for r in found] == ["f7.py"] and n < 100  # of 200 rows in 8 buckets
    assert scanned("8" * 64)[1] < 100


def test_vectors_that_can_not_be_compared_are_told(spark, caplog):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None), ("e", [0.5, 0.5]), ("f", [1.0] * 3)]
    chunks = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert {tuple(r) for r in rejected(chunks, 2).collect()} == {("b", "zero"), ("c", "of another length"), ("d", "missing"), ("f", "of another length")}
    with caplog.at_level(logging.WARNING, "lodestone"):
        assert Searcher(chunks, chunks, lambda _: [1.0, 2.0]).rejects() == {"zero": 1, "of another length": 2, "missing": 1}
    assert "2 chunks are left out" in caplog.text
    assert {r.id for r in vector_topk(chunks, [1.0, 2.0], 9).collect()} == {"a", "e"}


def test_paths_are_scored_once_and_rank_as_chunks_do(spark):
    rows = [(f"id{k * 7919 % 500}", p) for k, p in enumerate(["/src/Query.ts", "/src/queryParser.ts", "/q/u/e/r/y", "/none", "/src/query_x.py", "/İ/query", "/K/queRY"] * 40)]
    chunks = spark.createDataFrame(rows, "id string, file_path string")
    for query, limit in (("query", 7), ("qy", 50), ("ſ", 5), ("k", 9), ("none!", 5)):
        one = fuzzy_paths(chunks, query, limit).select("id", "score").collect()
        plain = chunks.select("id", fuzzy_score(F.lit(query), F.col("file_path")).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(limit)
        assert sorted(map(tuple, one)) == sorted(map(tuple, plain.collect()))


class Counting:
    """An embedder that leaves a mark for each call, in whatever process."""

    def __init__(self, folder):
        self.folder = str(folder)

    def embed(self, text):
        import uuid
        from pathlib import Path

        Path(self.folder, uuid.uuid4().hex).touch()
        return [1.0, float(len(text))]

    def answer(self, prompt):
        self.embed(prompt)
        return "SUMMARY: made"


def test_each_new_chunk_is_embedded_once(spark, tmp_path):
    calls, reads = tmp_path / "calls", tmp_path / "reads"
    calls.mkdir()
    reads.mkdir()
    counting, reading = Counting(calls), Counting(reads)
    store = Store(spark, str(tmp_path / "s"))
    texts = {f"f{k}__py": f"x = {k}\n" for k in range(20)}

    def lazily(rows):
        read = F.udf(lambda c: (reading.embed(c), c)[1], "string")
        return rows.withColumn("content", read.asNondeterministic()("content"))

    def count(folder):
        n = len(list(folder.iterdir()))
        for p in folder.iterdir():
            p.unlink()
        return n

    steps = []
    index_files(store, lazily(files(spark, **texts)), counting, Config(batch_size=4), now=1, progress=steps.append)
    assert (count(calls), count(reads)) == (20, 20) and len(steps) == 3
    index_files(store, lazily(files(spark, **texts)), counting, now=2)
    assert (count(calls), count(reads)) == (0, 20)
    index_files(store, lazily(files(spark, **texts | {"f3__py": "y = 3\n"})), counting, now=3)
    assert (count(calls), count(reads)) == (1, 20)
    asked = tmp_path / "asked"
    asked.mkdir()
    index_files(store, files(spark, f4__py="z = 3\n"), counting, Config(enable_context=True), Counting(asked), now=4)
    assert (count(calls), count(asked)) == (1, 1)


def test_providers_of_the_configuration(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    index_files(store, files(spark, a__py=PY), config=Config(embedding_options={"dimensions": 8}))
    assert {len(r.embedding) for r in store.chunks().collect()} == {8}
    assert context_of(Config()) is None and context_of(Config(enable_context=True, context_provider="ollama", context_options={"url": "http://x", "model": "m"})).model == "m"
    with pytest.raises(ValueError):
        Config(batch_size=0)


def test_second_embedding_endpoint():
    """Any failure of the first request sends the text alone to the second."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            ok = self.path == "/embeddings" and set(body) == {"text"}
            self.send_response(200 if ok else 400)
            self.end_headers()
            if ok:
                self.wfile.write(json.dumps({"embedding": [1, 2]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = CustomEmbedder(f"http://127.0.0.1:{server.server_port}", "m").embed("hello")
    finally:
        server.shutdown()
    assert got == [1.0, 2.0] and seen == [("/v1/embeddings", {"model": "m", "input": "hello"}), ("/embeddings", {"text": "hello"})]


def test_related_chunks_reach_the_prompt(spark):
    class Echo:
        def answer(self, prompt):
            return "SUMMARY: " + ("related" if "Related 1 (b.py)" in prompt else "alone")

    rows = spark.createDataFrame([("a.py", 0, 1, "x", "python", None, None, [("b.py", "python", "y")]), ("c.py", 0, 1, "x", "python", None, None, None)], "file_path string, start_line int, end_line int, content string, language string, function_name string, class_name string, related array<struct<file_path: string, language: string, content: string>>")
    assert {r.file_path: r.context.summary for r in enrich(rows, Echo(), at_a_time=2).collect()} == {"a.py": "related", "c.py": "alone"}


def test_unreadable_files_are_left_out(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    paths = spark.createDataFrame([(str(tmp_path / "a.py"),), (str(tmp_path / "gone.py"),), (str(tmp_path),)], "file_path string")
    assert [r.content for r in read_files(paths).collect()] == ["x = 1\n"]


def test_listing_leaves_depth_to_the_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.sources.files.ENTRIES", (0, 2, 5))
    for k in range(12):
        p = tmp_path / "w" / f"d{k % 4}" / f"e{k}" / "f"
        p.mkdir(parents=True)
        (p / "x.py").write_text("1")
        (p.parent / "y.py").write_text("22")
    (tmp_path / "w" / "top.py").write_text("333")
    found = {(r.file_path.removeprefix(str(tmp_path)), r.length) for r in listed(spark, str(tmp_path / "w")).collect()}
    assert len(found) == 25 and ("/w/top.py", 3) in found and ("/w/d3/e7/f/x.py", 1) in found
    assert listed(spark, str(tmp_path / "none")).count() == 0


def test_links_end(spark, tmp_path):
    """Links to the folder itself, to its parent, to each other's folders and to nothing."""
    w, out = tmp_path / "w", tmp_path / "other"
    for p in (w / "a", out / "deep"):
        p.mkdir(parents=True)
        (p / "x.py").write_text("1")
    for link, to in ((w / "self", w), (w / "up", tmp_path), (w / "a" / "root", w), (w / "a" / "other", out), (out / "back", w / "a"), (out / "deep" / "own", out), (w / "none", tmp_path / "none"), (w / "y.py", w / "a" / "x.py")):
        link.symlink_to(to)
    found = sorted(r.file_path.removeprefix(str(w)) for r in listed(spark, str(w)).collect())
    assert found == ["/a/other/deep/x.py", "/a/x.py", "/y.py"]


def _names(rows, schema="file_path"):
    import pyarrow as pa

    return iter([pa.RecordBatch.from_arrays([pa.array(rows), pa.array([[] for _ in rows], pa.list_(pa.string()))], ["file_path", "trail"])])


def test_excluded_folders_are_not_entered(spark, tmp_path, monkeypatch):
    for p in ("node_modules/deep/x.js", "src/.git/x.js", "src/x.js", "src/distant/x.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    entered, scandir = [], os.scandir
    monkeypatch.setattr("os.scandir", lambda p: (entered.append(p.removeprefix(str(tmp_path))), scandir(p))[1])
    found = [x for b in files_of._listed(str(tmp_path), closed_folders(EXCLUDED), 1000)(_names([str(tmp_path)])) for x in b.column(0).to_pylist()]
    assert sorted(entered) == ["", "/src", "/src/distant"] and len(found) == 2
    monkeypatch.undo()
    assert sorted(r.file_path.removeprefix(str(tmp_path)) for r in listed(spark, str(tmp_path)).collect()) == ["/src/distant/x.js", "/src/x.js"]


def test_a_flat_folder_is_listed_in_pieces(tmp_path, monkeypatch):
    for k in range(25):
        (tmp_path / f"f{k}.py").write_text("x")
    monkeypatch.setattr(files_of, "NAMES", 10)
    assert [b.num_rows for b in files_of._listed(str(tmp_path), None, 0)(_names([str(tmp_path)]))] == [10, 10, 5]


def test_folder_and_store_stay_alike(spark, tmp_path):
    """Real files are created, changed, deleted, and left alone."""
    w, seen = tmp_path / "build" / "w", str(tmp_path / "seen")  # the folder's own place is not judged by the globs
    (w / "src").mkdir(parents=True)
    (w / "src" / "a.py").write_text("x = 1\n")
    (w / "src" / "b.py").write_text("y = 1\n")
    (w / "c.txt").write_text("no code")
    store = Store(spark, str(tmp_path / "s"))
    assert sync_folder(store, str(w), seen, EMBED, now=1) == {"create": 2}
    assert sync_folder(store, str(w), seen, EMBED, now=2) == {} and store.version() == 1
    (w / "src" / "a.py").write_text("x = 22\n")
    (w / "src" / "b.py").unlink()
    (w / "src" / "d.py").write_text("z = 1\n")
    assert sync_folder(store, str(w), seen, EMBED, now=3) == {"change": 1, "delete": 1, "create": 1}
    assert {r.file_path.rsplit("/", 1)[-1]: r.content for r in store.chunks().collect()} == {"a.py": "x = 22\n", "d.py": "z = 1\n"}
    # a listing that was lost costs a look at all files, and no more
    shutil.rmtree(seen)
    (w / "src" / "d.py").unlink()
    assert sync_folder(store, str(w), seen, EMBED, now=4) == {"change": 1, "delete": 1}
    assert {r.file_path.rsplit("/", 1)[-1]: r.updated_at for r in store.chunks().collect()} == {"a.py": 3}


def test_files_are_opened_by_many_tasks(spark, tmp_path):
    """Paths that lie in one partition are dealt out, for a few files to no more tasks than these."""
    for k in range(6):
        (tmp_path / f"f{k}.py").write_text("x")
    paths = spark.createDataFrame([(str(tmp_path / f"f{k}.py"),) for k in range(6)], "file_path string").coalesce(1)
    assert read_files(paths).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    assert len(set(r.p for r in read_files(paths, 3).select(F.spark_partition_id().alias("p")).collect())) > 1
    assert [tasks_for(n, 8) for n in (0, 1, 50, 10_000, 1_000_000)] == [1, 1, 50, 64, 1000]


def test_watch(spark, tmp_path):
    w = tmp_path / "w"
    w.mkdir()
    (w / "a.py").write_text("x = 1\n")
    store = Store(spark, str(tmp_path / "s"))
    query = watch_folder(store, str(w), str(tmp_path / "seen"), EMBED, every="1 second")
    try:
        for text in ("x = 1\n", "x = 23\n"):
            (w / "a.py").write_text(text)
            until = time.time() + 60
            while [r.content for r in store.chunks().collect()] != [text] and time.time() < until and query.isActive:
                time.sleep(0.5)
            assert [r.content for r in store.chunks().collect()] == [text]
    finally:
        query.stop()


def test_late_events_are_dropped(spark, tmp_path):
    """A delete that comes in a later batch than a newer change removes nothing."""
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    source, store = str(tmp_path / "events"), Store(spark, str(tmp_path / "s"))
    read = lambda paths: paths.selectExpr("file_path", "6L as length", "'x = 1\\n' as content")

    def feed(*events):
        spark.createDataFrame(list(events), EVENT).write.mode("append").parquet(source)
        start_feed(spark.readStream.schema(EVENT).parquet(source), store, read, EMBED, str(tmp_path / "ck"), once=True).awaitTermination()
        return {r.file_path for r in store.chunks().collect()}

    assert feed(("a.py", "change", t(5)), ("b.py", "change", t(5))) == {"a.py", "b.py"}
    assert feed(("a.py", "delete", t(3)), ("b.py", "delete", t(7))) == {"a.py"}
    assert feed(("b.py", "create", t(6))) == {"a.py"}  # it was deleted later than that
    assert feed(("b.py", "create", t(8)), ("a.py", "delete", t(5))) == {"b.py"}
    # the last batch once more, as after a crash
    for f in (tmp_path / "ck" / "commits").glob("*3*"):
        f.unlink()
    assert feed(("c.py", "change", t(1))) == {"b.py", "c.py"}


def test_logs(caplog):
    handler = logging.Handler()
    log = configure(Config(debug_logging=True), handler)
    assert log.level == logging.DEBUG and handler in log.handlers
    assert configure().level == logging.INFO and log.handlers.count(handler) == 1
    log.removeHandler(handler)


def test_forgotten_after_spark_stops(tmp_path):
    """A folder goes at exit, also if Spark was stopped before."""
    code = f"""
from pyspark.sql import SparkSession
from lodestone.sources.scratch import forget_at_exit
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.range(3).write.parquet("{tmp_path}/own/t")
forget_at_exit(spark, "{tmp_path}/own")
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    assert not (tmp_path / "own").exists()


def test_upsert_and_migration(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("1", "/a", 0, 0, "x", "", "text", "", 5, 5, [1.0])], "id string, file_path string, start_line int, end_line int, content string, content_hash string, language string, function_name string, created_at long, updated_at long, embedding array<float>")
    store.upsert(row)
    store.upsert(row.withColumn("content", F.lit("y")))
    got = store.chunks().collect()
    assert len(got) == 1 and got[0].content == "y" and got[0].content_hash == "1" and got[0].function_name is None and got[0].norm == 1.0


def test_enrichment(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    index_files(store, files(spark, a__py="x = 1\n", b__py="boom\n"), EMBED, Config(enable_context=True), Context(), now=1)
    got = {r.file_path: r for r in store.chunks().collect()}
    assert got["a.py"].summary == "made" and got["a.py"].related_concepts == ["a", "b"] and got["a.py"].enriched_context.startswith("File: a.py")
    assert got["b.py"].purpose == "Code implementation"


def test_failed_embeddings_are_dropped(spark, tmp_path, caplog):
    class Failing:
        def embed(self, text):
            if "boom" in text:
                raise OSError("down")
            return [1.0]

    store = Store(spark, str(tmp_path / "s"))
    some = files(spark, a__py="x = 1\n", b__py="boom\n", c__py=PY.replace("pass", "boom()"))
    with caplog.at_level(logging.WARNING, "lodestone"):
        index_files(store, some, Failing(), now=1)
    assert "2 chunks could not be embedded" in caplog.text
    assert sorted((r.file_path, r.start_line) for r in store.chunks().collect()) == [("a.py", 0), ("c.py", 0)]
    # what failed is tried again, also of a file that is as it was and has other chunks
    index_files(store, some, EMBED, now=2)
    assert sorted((r.file_path, r.start_line, r.updated_at) for r in store.chunks().collect()) == [("a.py", 0, 1), ("b.py", 0, 2), ("c.py", 0, 1), ("c.py", 3, 2)]


def test_feed(spark, tmp_path):
    texts = {"a.py": PY, "b.py": "x = 1\n", "c.py": "y = 2\n"}
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    source = tmp_path / "events"
    spark.createDataFrame([("a.py", "create", t(1)), ("b.py", "create", t(1)), ("b.py", "delete", t(3)), ("c.py", "create", t(2)), ("n.bin", "create", t(2))], EVENT).write.parquet(str(source))

    def read(paths):
        known = spark.createDataFrame([(k, len(v), v) for k, v in texts.items()], "file_path string, length long, content string")
        return known.join(paths, "file_path", "left_semi")

    store = Store(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema(EVENT).parquet(str(source))
    start_feed(stream, store, read, EMBED, str(tmp_path / "ck"), once=True).awaitTermination()
    first = {(r.file_path, r.start_line) for r in store.chunks().collect()}
    assert first == {("a.py", 0), ("a.py", 3), ("c.py", 0)}
    spark.createDataFrame([("a.py", "delete", t(9))], EVENT).write.mode("append").parquet(str(source))
    start_feed(stream, store, read, EMBED, str(tmp_path / "ck"), once=True).awaitTermination()
    assert {r.file_path for r in store.chunks().collect()} == {"c.py"}
    apply_events(store, spark.createDataFrame([("c.py", "change", t(1))], EVENT), read, EMBED)
    apply_events(store, spark.createDataFrame([("c.py", "change", t(1))], EVENT), read, EMBED)
    assert store.chunks().count() == 1


def test_latest(spark):
    e = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", 1, 1, None)], "k string, ts int, id int, v string")
    assert sorted(map(tuple, latest(e, "k", "ts", "id").collect())) == [("a", 2, 2, "z"), ("b", 1, 1, None)]


def test_scan(spark, tmp_path):
    for name, text in {"src/__init__.py": "x = 1\n", "src/.hidden.py": "y", "node_modules/a.js": "z", "big.py": "b" * 50, "note.txt": "n"}.items():
        p = tmp_path / "w" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    found = listed(spark, str(tmp_path / "w"), Config(max_file_size=40))
    got = {r.file_path.rsplit("/", 1)[-1]: (r.content, r.language) for r in read_files(found).collect()}
    assert got == {"__init__.py": ("x = 1\n", "python"), ".hidden.py": ("y", "python")}
    assert read_files(found.limit(0)).count() == 0


def test_size_limit_is_inclusive(spark):
    df = spark.createDataFrame([("/a.py", 10), ("/b.py", 11)], "file_path string, length long")
    assert [r.file_path for r in indexable(df, Config(max_file_size=10)).collect()] == ["/a.py"]


def test_open_tabs(spark):
    assert open_tabs(spark, [f"/f{i}" for i in range(12)]).count() == 10


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise HTTPError("u", 500, "x", {}, None)
        return "ok"

    assert retrying(flaky, sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(HTTPError):
        retrying(lambda: (_ for _ in ()).throw(HTTPError("u", 404, "x", {}, None)), sleep=waits.append)
    with pytest.raises(TimeoutError):
        retrying(lambda: (_ for _ in ()).throw(TimeoutError()), sleep=waits.append)
    assert waits == [1, 2, 1, 2, 4]


@pytest.mark.parametrize("answer", [{"data": [{"embedding": [1, 2]}]}, {"embedding": [1, 2]}, {"embeddings": [[1, 2]]}])
def test_answer_shapes(answer):
    assert embedding_of(answer) == [1.0, 2.0]


def test_ping():
    assert ping(EMBED) and ping(Context())
    assert len(EMBED.embed("")) == 16 and EMBED.embed("a b") == EMBED.embed("a b")


def test_first_use_and_reindex(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    some = lambda: files(spark, a__py=PY)
    assert index_if_empty(store, some, EMBED) and not index_if_empty(store, some, EMBED)
    before = store.index().count()
    store.rebuild()
    assert store.index().count() == before
    reindex(store, files(spark, b__py="x = 1\n"), EMBED)
    assert [r.file_path for r in store.chunks().collect()] == ["b.py"]


def test_flat_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    index_files(store, files(spark, a__py=PY), EMBED, Config(enable_context=True), Context(), now=1)
    chunks = store.chunks().drop("norm", "dl", "file_hash")
    rows, vectors = to_flat(chunks)
    assert rows.schema["related_concepts"].dataType.typeName() == "string"
    back = from_flat(rows.drop("content_hash"), vectors)
    assert {r.id: r.content_hash for r in back.collect()} == {r.id: r.id for r in chunks.collect()}
    same = from_flat(rows, vectors)
    assert sorted(map(str, same.collect())) == sorted(map(str, chunks.collect()))
    assert from_flat(rows, vectors.withColumn("embedding", F.lit(bytearray(b"abc")))).count() == 0


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("select s.start_line, s.end_line, s.function_name from values ('def a():\\n  pass\\n') t(c), lateral chunk_file(c, 'python', 500) s").collect()
    assert [tuple(r) for r in got] == [(0, 2, "a")]
    assert spark.sql("select stems(array('running', 'flies'))").first()[0] == ["run", "fli"]


def test_cancellable(spark):
    with cancellable(spark, "one") as cancel:
        assert "one" in spark.getTags() and cancel() == []
    assert "one" not in spark.getTags()


def test_message_rows(spark):
    rows = spark.createDataFrame([], "label string, detail string")
    assert [tuple(r) for r in or_message(rows, "nothing").collect()] == [("nothing", "")]


def test_rebuild_writes_postings_only(spark, tmp_path):
    """Chunks stay where they are, and vacuum keeps both commits and removes the replaced postings."""
    store = Store(spark, str(tmp_path / "s"), keep_hours=0)
    index_files(store, files(spark, a__py=PY, b__py="x = 1\n"), EMBED)
    chunks, postings = store.chunks().inputFiles(), sorted(map(tuple, store.index().collect()))
    first = store.state()
    store.rebuild()
    assert sorted(store.chunks().inputFiles()) == sorted(chunks)
    assert sorted(map(tuple, store.index().collect())) == postings
    assert not set(store.index().inputFiles()) & set(store.index(first).inputFiles())
    store.vacuum()
    assert sorted(map(tuple, store.index().collect())) == postings and store.chunks().count() > 0
    assert not list((tmp_path / "s" / "data" / next(iter(first.at.values()))[0] / "postings").glob("bucket=*"))
    index_files(store, files(spark, b__py="x = 2\n"), EMBED)
    assert store.index().where("term = '2'").count() == 1 and store.corpus().first().tokens == store.index().count()


def test_few_texts_of_a_batch_are_taken_out_at_a_time():
    import pyarrow as pa

    from lodestone.sources import providers

    class Counting:
        asked = 0

        def embed(self, text):
            self.asked += 1
            return [1.0]

    counting = Counting()
    out = providers._embedded(counting, [pa.array(["x", None] * 1000)], 10, None)
    first = next(out)
    assert len(first) == 2 * counting.asked == providers.TEXTS and first[1].as_py() is None
    assert len(first) + sum(map(len, out)) == 2000 and counting.asked == 1000


def test_postings_of_a_term_stay_as_their_chunks_lie(spark, tmp_path):
    """They are sorted by term alone, whatever the bucket; settings are as they were."""
    names = ("spark.sql.optimizer.plannedWrite.enabled", "spark.sql.maxConcurrentOutputFileWriters")
    before = [spark.conf.get(k) for k in names]
    store = Store(spark, str(tmp_path / "s"), stemmed=False, buckets=1)
    index_files(store, files(spark, **{f"f{k}__py": "x " * (20 - k) for k in range(9)}), EMBED, now=1)
    (path,) = (tmp_path / "s" / "data").glob("*/postings/bucket=0/*.parquet")
    rows = spark.read.parquet(str(path)).collect()
    terms = [r.term for r in rows]
    assert terms == sorted(terms) and [r.place[-4:] for r in rows if r.term == "x"] == [f"{k}.py" for k in range(9) for _ in range(20 - k)]
    assert [spark.conf.get(k) for k in names] == before


def test_postings_of_both_forms_are_read(spark):
    from lodestone.operators.fulltext import packed, unpacked

    old = spark.createDataFrame([("3 3 a b=/p q",), ("1 0 =",), ("2 -1 =/é",), ("4 1 é",)], "place string")
    want = [("a b", "/p q", 3), ("", "", 1), (None, "/é", 2), ("é", None, 4)]
    assert [tuple(r) for r in unpacked(old).collect()] == want
    docs = spark.createDataFrame([(i, p, "x " * n) for i, p, n in want], "id string, file_path string, content string")
    new = packed(docs, ["content"], stemmed=False).where("pos = 0")
    assert [tuple(r) for r in unpacked(new.select("place")).collect()] == want and new.where("place like '#%'").count() == 4
