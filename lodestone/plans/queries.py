"""The engine's operators over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.context import fallback_context, full_context, parse_context, prompt
from ..functions.paths import basename, excluded
from ..functions.sql import register
from ..functions.text import clean_query, parse_query
from ..functions.vector import from_blob
from ..operators import bulk, display, fulltext, fusion, lookup
from ..operators.chunker import chunk_files, line_windows, structured_chunks
from ..operators.neighbours import nearest_of_each
from ..operators.search import Searcher, best_per, chunks_at_lines, fuzzy_topk, vector_topk
from ..schema import EXCLUDED, Config
from ..sources.files import indexable, listed, open_tabs, read_files, rooted
from ..sources.flat import from_flat, to_blob, to_flat
from ..sources.providers import HashingEmbedder, enrich
from ..sources.scratch import NO_LEFTOVERS, POSTINGS, SMALL_TASKS, forget_at_exit, settings, shared_dir, stored
from ..sources.store import Store
from ..streaming.feed import latest, start_feed
from ..streaming.watch import sync_folder
from .ingest import index_if_empty, prepared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Line windows of documents.
SIZE, OVERLAP = 20, 5
KEYWORDS, HYBRID = "by es", "es"
#: The words of a language that version 2 of the documents no longer has, and one whose texts it edits.
REMOVED, EDITED = "de", "fr"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents as files: file_path, content, language, doc_id."""
    return table(spark, d, "documents").select(F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), "doc_id")


def whole(spark: SparkSession, d: str) -> DataFrame:
    """documents as one chunk each, with the id of the document."""
    none = F.lit(None).cast("string")
    return files(spark, d).select(F.col("doc_id").alias("id"), "file_path", F.lit(0).alias("start_line"), (F.size(F.split("content", "\n", -1)) - 1).alias("end_line"), "content", "language", none.alias("function_name"), none.alias("class_name"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    return line_windows(files(spark, d).select("file_path", "content", "language"), SIZE, OVERLAP)


def vector(spark: SparkSession, d: str, key: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == key).first().embedding)


def _index(spark: SparkSession, d: str, columns: Sequence[str], stemmed: bool) -> tuple[DataFrame, DataFrame]:
    """The stored postings of documents, sorted by term in each file, and their figures: an index is
    written once, and each query reads the pages of its terms."""
    name = f"{d} {columns} {stemmed}"
    # The texts are dealt out, which are many times smaller than their postings, to tasks that sort theirs in memory.
    made = lambda: fulltext.packed(whole(spark, d).hint("rebalance", "id"), columns, stemmed).sortWithinPartitions("term", "place")
    kept = stored(spark, f"postings {name}", made, POSTINGS, SMALL_TASKS)
    index = fulltext.unpacked(kept, "bigint")
    return index, stored(spark, f"corpus {name}", lambda: fulltext.corpus(fulltext.unpacked(kept.select("place").distinct(), "bigint")))


def text_index(spark: SparkSession, d: str, stemmed: bool = False) -> DataFrame:
    return _index(spark, d, ["content"], stemmed)[0]


def prepare(spark: SparkSession, d: str) -> None:
    """Writes the indexes that the searches read; without it the first search writes its own."""
    _index(spark, d, ["content"], False)
    _index(spark, d, fulltext.COLUMNS, False)


def rounded(c: str, n: int = 6) -> Column:
    return F.round(c, n).alias(c)


@query
def vector_topk_(spark: SparkSession, d: str) -> DataFrame:
    hits = vector_topk(table(spark, d, "embeddings"), vector(spark, d), 10, "vec_id")
    return hits.select("vec_id", rounded("similarity"))


@query
def vector_topk_dedup_label(spark: SparkSession, d: str) -> DataFrame:
    """The label is the file: the best vector of each other label."""
    e = table(spark, d, "embeddings")
    own = e.where("vec_id = 0").first().label
    hits = vector_topk(e, vector(spark, d), 30, "vec_id", ["label"]).where(F.col("label") != own)
    return best_per(hits, "label", "vec_id").orderBy(F.desc("similarity"), "vec_id").limit(15).select("vec_id", "label", rounded("similarity"))


@query
def vector_exclude_self(spark: SparkSession, d: str) -> DataFrame:
    hits = vector_topk(table(spark, d, "embeddings"), vector(spark, d), 30, "vec_id").where("vec_id <> 0")
    return hits.orderBy(F.desc("similarity"), "vec_id").limit(15).select("vec_id", rounded("similarity"))


@query
def vector_dim_guard(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of label 1 lose half of their dimensions and so are left out."""
    e = table(spark, d, "embeddings")
    cut = e.select("vec_id", F.when(F.col("label") == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return vector_topk(cut, vector(spark, d), 10, "vec_id").select("vec_id", rounded("similarity"))


@query
def chunk_embedding_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("dims"))
    return whole(spark, d).select("id", "file_path").join(e, F.col("id") == F.col("vec_id")).select("id", "file_path", "label", "dims")


def _bm25(spark: SparkSession, d: str, text: str, stemmed: bool = False) -> DataFrame:
    index, known = _index(spark, d, ["content"], stemmed)
    return fulltext.keyword_search(index, parse_query(text, stemmed), 20, known).select(F.col("chunk_id").alias("id"), rounded("rank"))


@query
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, KEYWORDS)


@query
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "of + the")


@query
def bm25_anchor(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "^the of")


@query
def bm25_porter(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "the eses", stemmed=True)


@query
def bm25_syntax_error(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "what's of")


@query
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    """Corpus figures of the index: rows, tokens and distinct terms."""
    return text_index(spark, d).agg(F.countDistinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


@query
def keyword_normalised(spark: SparkSession, d: str) -> DataFrame:
    index, known = _index(spark, d, ["content"], False)
    hits = fulltext.keyword_search(index, parse_query(KEYWORDS, False), 20, known)
    return fusion.from_best(hits).select(F.col("chunk_id").alias("id"), rounded("similarity"))


@query
def query_clean(spark: SparkSession, d: str) -> DataFrame:
    """Queries made of documents, with signs and operator words between."""
    made = F.concat(F.lit("(near"), "lang", F.lit(") AND not_found é-Or_é éor "), F.coalesce("text", F.lit("")), F.lit(' NOT "x:y*" [AND]+OR+near'))
    return table(spark, d, "documents").select("doc_id", F.md5(clean_query(made).cast("binary")).alias("cleaned_md5"))


@query
def fuzzy_url(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_topk(table(spark, d, "pages"), "page", F.col("url"), 20, "page_id").select("page_id", rounded("score"))


def _searcher(spark: SparkSession, d: str, mode: str = "hybrid") -> Searcher:
    """Documents with their vectors; the query's vector is the first one, keywords are unstemmed."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    chunks = whole(spark, d).join(e, F.col("id") == F.col("vec_id"), "left").drop("vec_id")
    index, known = _index(spark, d, fulltext.COLUMNS, False)
    q = vector(spark, d)
    return Searcher(chunks, index, lambda _: q, Config(search_mode=mode), stemmed=False, corpus=known, payload=lambda paths: whole(spark, d).where(F.col("file_path").isin(paths)))


def _flat(results: DataFrame) -> DataFrame:
    return results.select("chunk.id", "chunk.file_path", "chunk.language", rounded("similarity"))


@query
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_searcher(spark, d).search(HYBRID, 20))


@query
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_searcher(spark, d, "semantic").search("anything", 10))


@query
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_searcher(spark, d, "keyword").search(KEYWORDS, 20))


@query
def search_with_filters(spark: SparkSession, d: str) -> DataFrame:
    """The filters stay above the limit of twice as many hits."""
    return _flat(_searcher(spark, d).filtered(HYBRID, 20, min_similarity=0.05, file_pattern="src1", language="es"))


@query
def similar_files(spark: SparkSession, d: str) -> DataFrame:
    """The stored vector of the first document stands for its embedded content."""
    path = files(spark, d).where("doc_id = 0").first().file_path
    return _flat(_searcher(spark, d).similar_files(path, 15))


@query
def similar_code(spark: SparkSession, d: str) -> DataFrame:
    path = files(spark, d).where("doc_id = 0").first().file_path
    return _flat(_searcher(spark, d).similar_code(path, 0, 15))


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The best hundred of three arms of 500 documents each: the longest, those by a remainder, the last."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    orders = [[F.desc("n"), F.asc("id")], [F.asc(F.expr("id * 7919 % 9973")), F.asc("id")], [F.desc("id")]]
    arms = [fusion.ranked(docs.orderBy(*o).limit(500), arm, *o) for arm, o in zip(fusion.ARMS, orders, strict=True)]
    return fusion.min_max(fusion.rrf(arms[0].unionByName(arms[1]).unionByName(arms[2]), 60, 100)).select("id", rounded("score", 9), rounded("similarity"))


@query
def rrf_single_hit(spark: SparkSession, d: str) -> DataFrame:
    """The longest document, if one arm finds it and no other finds anything."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    order = [F.desc("n"), F.asc("id")]
    arms = fusion.ranked(docs.orderBy(*order).limit(1), "keyword", *order)
    return fusion.min_max(fusion.rrf(arms, 60, 10)).select("id", rounded("score", 9), rounded("similarity"))


@query
def line_windows_(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select("id", "file_path", "start_line", "end_line", "content_hash")


@query
def structured_chunks_html(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("url").alias("file_path"), F.col("html").alias("content"), F.lit("html").alias("language"))
    return structured_chunks(pages, SIZE).select("id", "file_path", "start_line", "end_line", "function_name", "class_name")


@query
def chunk_at_line(spark: SparkSession, d: str) -> DataFrame:
    """The smallest window around line 17, which two windows hold."""
    return chunks_at_lines(windows(spark, d), files(spark, d).select("file_path", F.lit(17).alias("line")))


@query
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A file's chunk ids and hashes."""
    path = files(spark, d).where("doc_id = 0").first().file_path
    return lookup.hashes_of_file(windows(spark, d), path)


def _second(spark: SparkSession, d: str) -> DataFrame:
    """The files after an edit of one language and the removal of another."""
    f = files(spark, d).where(F.col("language") != REMOVED)
    return f.select("file_path", F.when(F.col("language") == EDITED, F.concat("content", F.lit("\nedited"))).otherwise(F.col("content")).alias("content"), "language")


@query
def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    return lookup.diff(windows(spark, d), line_windows(_second(spark, d), SIZE, OVERLAP))


@query
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The table after all files were indexed anew; version tells unchanged rows from new ones."""
    old = windows(spark, d).withColumn("version", F.lit(1))
    new = line_windows(_second(spark, d), SIZE, OVERLAP).withColumn("version", F.lit(2))
    return lookup.merge(old, new, files(spark, d).select("file_path")).select("id", "file_path", "content_hash", "version")


@query
def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    gone = files(spark, d).where(F.col("language") == REMOVED).select("file_path")
    return lookup.delete_files(windows(spark, d), gone).groupBy("language").agg(F.count("*").alias("n_chunks"))


@query
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = windows(spark, d).withColumn("updated_at", F.lit(1_700_000_000_000))
    return lookup.stats(chunks).select("total_chunks", "total_files", F.unix_millis("last_indexed").alias("last_indexed_ms"))


@query
def display_rows(spark: SparkSession, d: str) -> DataFrame:
    hits = whole(spark, d).select(F.struct("*").alias("chunk"), F.lit(0.5).alias("similarity"))
    return hits.select("chunk.id", basename(F.col("chunk.file_path")).alias("label"), display.preview(F.col("chunk.content"), 100).alias("detail"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a model may give them, made of conversations."""
    c = table(spark, d, "conversations")
    made = F.concat(F.lit("SUMMARY: "), "role", F.lit("\nchatter\nSUMMARY: turn "), F.col("turn").cast("string"), F.lit("\n PURPOSE: indented\nCONCEPTS: "), "role", F.lit(", ,chat, "), F.col("conv_id").cast("string"), F.lit("\nUSAGE:\nDEPENDENCIES: none"))
    return c.select("conv_id", "turn", made.alias("answer"))


@query
def parse_context_(spark: SparkSession, d: str) -> DataFrame:
    parsed = _answers(spark, d).withColumn("p", parse_context(F.col("answer")))
    lists = [F.array_join(f"p.{c}", "|").alias(c) for c in ("related_concepts", "usage_patterns", "dependencies")]
    return parsed.select("conv_id", "turn", "p.summary", "p.purpose", *lists)


def _named(spark: SparkSession, d: str) -> DataFrame:
    return whole(spark, d).withColumns({"function_name": F.when(F.col("language") == "en", F.col("language")), "class_name": F.when(F.col("language") == "de", F.col("language"))})


@query
def fallback_context_(spark: SparkSession, d: str) -> DataFrame:
    own = _named(spark, d)
    f = fallback_context({c: F.col(c) for c in own.columns})
    return own.select("id", f.alias("f")).select("id", "f.summary", "f.purpose", F.array_join("f.related_concepts", "|").alias("concepts"), F.sha2("f.full_context", 256).alias("full_sha"))


@query
def full_context_(spark: SparkSession, d: str) -> DataFrame:
    own = _named(spark, d)
    none = F.array().cast("array<string>")
    c = {"summary": F.lit("a text"), "purpose": F.lit(""), "related_concepts": F.array(F.col("language"), F.lit("prose")), "usage_patterns": none, "dependencies": none}
    return own.select("id", F.sha2(full_context({k: F.col(k) for k in own.columns}, c), 256).alias("full_sha"))


@query
def exclude_globs(spark: SparkSession, d: str) -> DataFrame:
    """Which of some paths made of documents the globs leave out."""
    part = F.when(F.col("language") == "en", "node_modules/x").when(F.col("language") == "de", "src/dist").when(F.col("language") == "fr", "distant").otherwise("lib")
    paths = files(spark, d).select("doc_id", F.concat(part, F.lit("/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") < 100, ".min.js").otherwise(".js")).alias("path"))
    return paths.select("doc_id", excluded(F.col("path"), EXCLUDED).alias("is_excluded"))


def _events(e: DataFrame) -> DataFrame:
    """events as file events of one file for each user; an error deletes it."""
    return e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_path"), F.when(F.col("event_type") == "error", "delete").otherwise("change").alias("op"), F.col("ts").cast("timestamp").alias("ts"))


@query
def latest_event_per_key(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """The store after the change feed has taken all events."""
    root = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    forget_at_exit(spark, root)
    store = Store(spark, f"{root}/store", buckets=8)
    schema = table(spark, d, "events").schema
    stream = _events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))

    def read(paths: DataFrame) -> DataFrame:
        body = F.concat(F.lit("# "), "file_path", F.lit("\nvalue = 1\n"))
        return paths.select("file_path", F.length(body).cast("bigint").alias("length"), body.alias("content"))

    start_feed(stream, store, read, HashingEmbedder(16), f"{root}/checkpoint", once=True).awaitTermination()
    return store.chunks().select("id", "file_path", "start_line", "end_line", "content_hash")


#: Contents whose spans are known, one for each document by its id; # stands for the id.
TEMPLATES = (
    ("python", "import os\n\ndef f#(x):\n    return x\n\nclass C#:\n    def m(self):\n        pass\n"),
    ("typescript", "function f#(a) {\n  if (a) {\n    g();\n  }\n  return a;\n}\nconst z = 1;\nclass C# {\n  m(x) { return x; }\n}\n"),
    ("typescript", "function f#() { type T# = 1; }\n}\n"),
    ("javascript", "} catch (e#) {\n  if (q) {\n    r();\n  }\n}\nrest();\n"),
    ("javascript", "const f# = (a) => a;\nconst g = 2;\nlet h = 3;"),
    ("go", "func (r *T#) Run#() {\n}\n\ntype S# struct {\n}\n"),
    ("scss", ".c# { x }\n@mixin m# {\n}\n"),
    ("python", "x = #\n"),
)


def sources(spark: SparkSession, d: str) -> DataFrame:
    """A source file for each document: file_path, content, language."""
    docs = table(spark, d, "documents").select("doc_id")
    made = F.create_map(*[x for k, (lang, text) in enumerate(TEMPLATES) for x in (F.lit(k), F.struct(F.lit(lang).alias("language"), F.lit(text).alias("text")))])
    of = docs.withColumn("t", F.element_at(made, F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int")))
    return of.select(F.concat(F.lit("/w/"), F.col("doc_id").cast("string")).alias("file_path"), F.replace(F.col("t.text"), F.lit("#"), F.col("doc_id").cast("string")).alias("content"), F.col("t.language").alias("language"), "doc_id")


@query
def structured_chunks_sources(spark: SparkSession, d: str) -> DataFrame:
    return chunk_files(sources(spark, d), SIZE, OVERLAP).select("id", "file_path", "start_line", "end_line", "function_name", "class_name", "content_hash")


@query
def chunk_udtf(spark: SparkSession, d: str) -> DataFrame:
    """The table function in SQL."""
    register(spark)
    files_ = sources(spark, d).where("language = 'typescript'").select("doc_id", "content", "language")
    return spark.sql(f"select f.doc_id, c.start_line, c.end_line, c.function_name, c.class_name from {{f}} f, lateral chunk_file(f.content, f.language, {SIZE}) c", f=files_)


@query
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A chunk by its id."""
    path = files(spark, d).where("doc_id = 0").first().file_path
    first = windows(spark, d).where(F.col("file_path") == path).orderBy("start_line").first().id
    return lookup.chunk_by_id(windows(spark, d), first).select("id", "file_path", "start_line", "content_hash")


@query
def exists_with_hash(spark: SparkSession, d: str) -> DataFrame:
    one = windows(spark, d).orderBy("id").first()
    found = [(h, lookup.exists_with_hash(windows(spark, d), one.id, x)) for h, x in (("own", one.content_hash), ("other", "no hash"))]
    return spark.createDataFrame(found, "content_hash string, found boolean")


@query
def file_filters(spark: SparkSession, d: str) -> DataFrame:
    """Which of some files made of documents are indexed: by extension, glob and size."""
    f = files(spark, d)
    ext = F.when(F.col("language") == "en", ".py").when(F.col("language") == "de", ".txt").otherwise(".min.js")
    folder = F.when(F.col("doc_id") % 7 == 0, "/build/").otherwise("/src/")
    own = f.select(F.concat(folder, F.col("doc_id").cast("string"), ext).alias("file_path"), F.octet_length("content").cast("bigint").alias("length"))
    return indexable(own, Config(max_file_size=1500)).select("file_path", "length")


class _Picky:
    """Fails on texts that begin with a vowel."""

    def embed(self, text: str) -> list[float]:
        if text[:1] in "aeiouAEIOU":
            raise OSError(text[:1])
        return [1.0, 2.0]


@query
def failed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose embedding fails are dropped."""
    made = prepared(windows(spark, d), _Picky(), None, Config(), 5)
    return made.select("id", F.size("embedding").alias("dims"), "updated_at")


def _store(spark: SparkSession) -> Store:
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    forget_at_exit(spark, root)
    return Store(spark, root, stemmed=False, buckets=8)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).withColumns({"created_at": F.lit(1), "updated_at": F.lit(1), "embedding": F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>")})


@query
def store_migration(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a content hash get their id for it; empty names become null, norms are added."""
    store = _store(spark)
    store.commit(_rows(spark, d).withColumns({"content_hash": F.when(F.col("language") == "de", "").otherwise(F.col("content_hash")), "function_name": F.lit("")}))
    return store.chunks().select("id", "content_hash", F.col("function_name").isNull().alias("unnamed"), "norm")


@query
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the same id are replaced, others added."""
    store, rows = _store(spark), _rows(spark, d)
    store.commit(rows.where("language <> 'en'"))
    store.upsert(rows.where("language in ('en', 'fr')").withColumn("updated_at", F.lit(2)))
    return store.chunks().select("id", "file_path", F.col("updated_at").alias("version"))


@query
def store_delete(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and chunks of the index after the files of one language are deleted, and its figures."""
    store = _store(spark)
    store.commit(_rows(spark, d))
    store.delete_files(files(spark, d).where(F.col("language") == REMOVED))
    index = store.index().agg(F.count("*").alias("n_tokens"), F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("term").alias("n_terms"))
    return index.join(store.corpus().select(F.col("n").alias("corpus_n"), F.col("tokens").alias("corpus_tokens")))


@query
def store_clear(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.commit(_rows(spark, d))
    before = store.stats().select(F.lit("before").alias("state"), "total_chunks", "total_files", (F.col("database_size") > 0).alias("has_bytes"))
    counted = [tuple(r) for r in before.collect()]
    store.clear()
    counted += [("after", r.total_chunks, r.total_files, r.database_size > 0) for r in store.stats().collect()]
    return spark.createDataFrame(counted, before.schema)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d).withColumn("class_name", F.coalesce("class_name", F.lit("")))
    return named.select(F.struct("*").alias("chunk"), F.lit(0.5).alias("similarity"))


@query
def search_rows(spark: SparkSession, d: str) -> DataFrame:
    return display.search_rows(_hits(spark, d))


@query
def quick_rows(spark: SparkSession, d: str) -> DataFrame:
    return display.quick_rows(_hits(spark, d))


@query
def similar_rows(spark: SparkSession, d: str) -> DataFrame:
    return display.similar_rows(_hits(spark, d))


@query
def open_tab_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of the open files."""
    paths = [r.file_path for r in files(spark, d).orderBy("doc_id").limit(12).collect()]
    return display.open_file_rows(open_tabs(spark, paths))


@query
def message_rows(spark: SparkSession, d: str) -> DataFrame:
    """A message where a search found nothing."""
    nothing = display.search_rows(_hits(spark, d).where("chunk.language = 'none'"))
    return display.or_message(nothing, "No results")


@query
def status_text(spark: SparkSession, d: str) -> DataFrame:
    never = windows(spark, d).withColumn("updated_at", F.lit(0))
    return display.status_text(lookup.stats(never, F.lit(3 << 20)))


@query
def flat_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists as JSON, and back."""
    lists = F.array(F.col("language"), F.lit('a "b"'))
    rows = _rows(spark, d).withColumns({"related_concepts": lists, "usage_patterns": F.array().cast("array<string>"), "dependencies": F.lit(None).cast("array<string>")})
    flat, vectors = to_flat(rows)
    back = from_flat(flat.withColumns({"enriched_context": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "purpose": F.lit(None).cast("string")}), vectors)
    return flat.select("id", F.col("related_concepts").alias("json"), F.col("usage_patterns").alias("none")).join(back.select("id", F.array_join("related_concepts", "|").alias("joined")), "id")


@query
def blob_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as float32 bytes and back; those of label 1 lose a byte and so are left out."""
    e = table(spark, d, "embeddings").select("vec_id", "label", to_blob("embedding").alias("b"))
    back = e.select("vec_id", from_blob(F.when(F.col("label") == 1, F.expr("substring(b, 1, octet_length(b) - 1)")).otherwise(F.col("b"))).alias("v")).where("v is not null")
    return back.select("vec_id", F.size("v").alias("dims"), F.element_at("v", 1).cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"))


@query
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """A template's placeholders, each filled where it first stands."""
    template = "{language}|{fileName}|{filePath}|{startLine}-{endLine}|{language}|{code}|{code}"

    @F.pandas_udf("string")
    def fill(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([prompt(r, template) for r in rows.to_dict("records")])

    own = whole(spark, d)
    return own.select("id", F.sha2(fill(F.struct("file_path", "start_line", "end_line", "content", "language")), 256).alias("prompt_sha"))


@query
def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """The tables' files, listed and, but for the larger ones, opened by the executors; a row for each table,
    which may be a file or a folder of files."""
    found = listed(spark, d, Config(extensions=("parquet",), max_file_size=1 << 40))
    read = read_files(indexable(found, Config(extensions=("parquet",), max_file_size=1 << 16), d)).select(F.col("file_path").alias("of"), F.col("length").alias("n"))
    met = found.join(read, F.col("file_path") == F.col("of"), "left")
    name = F.split_part(F.substr("file_path", F.lit(len(rooted(d)) + 2)), F.lit("/"), F.lit(1))
    own = met.where(name.isin([f"{t}.parquet" for t in ("region", "nation", "documents", "embeddings", "pages")]))
    return own.groupBy(name.alias("name")).agg((F.sum("length") > 0).alias("has_bytes"), F.every(F.coalesce(F.col("n") == F.col("length"), F.lit(True))).alias("same"))


@query
def first_use(spark: SparkSession, d: str) -> DataFrame:
    """An empty store is indexed at first use, and only then."""
    store, embedder = _store(spark), HashingEmbedder(8)
    some = lambda: sources(spark, d).select("file_path", "content", "language")
    done = [(k, index_if_empty(store, some, embedder, Config(chunk_size=SIZE, chunk_overlap=OVERLAP)), store.chunks().count()) for k in (1, 2)]
    return spark.createDataFrame(done, "turn int, indexed boolean, n_chunks bigint")


@query
def store_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Postings made anew are those that were there."""
    store = _store(spark)
    store.commit(_rows(spark, d))
    figures = [F.count("*").alias("n"), F.sum(F.xxhash64("chunk_id", "col_no", "pos", "term").cast("decimal(38,0)")).alias("sum")]
    before = store.index().agg(*figures).first()
    store.rebuild()
    after = store.index().agg(*figures).first()
    return spark.createDataFrame([(after.n, before == after)], "n_tokens bigint, same boolean")


@query
def blank_query(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search for nothing finds nothing."""
    return _bm25(spark, d, "  AND ")


class _Labels:
    """Answers about prompts, but not about those with an even line count."""

    def answer(self, text: str) -> str:
        if len(text.split("\n")) % 2 == 0:
            raise OSError("even")
        return "SUMMARY: odd\nCONCEPTS: a, b"


@query
def enriched_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Contexts by a provider, and what stands in where it fails."""
    own = _named(spark, d)
    plain = len(prompt({"file_path": "", "content": "", "language": "", "start_line": 0, "end_line": 0}).split("\n"))
    made = enrich(own, _Labels(), at_a_time=4).select("id", (F.size(F.split("content", "\n", -1)) + plain - 1).alias("lines"), "context.*")
    return made.select("id", (F.col("lines") % 2 == 1).alias("answered"), "summary", "purpose", F.array_join("related_concepts", "|").alias("concepts"))


@query
def flat_old_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an older form, without content_hash, get their id for it."""
    none = F.lit(None).cast("string")
    rows = _rows(spark, d).withColumns({c: F.lit(None).cast("array<string>") for c in ("related_concepts", "usage_patterns", "dependencies")} | {c: none for c in ("enriched_context", "summary", "purpose")})
    flat, vectors = to_flat(rows)
    return from_flat(flat.drop("content_hash"), vectors).select("id", "content_hash", F.size("embedding").alias("dims"))


@query
def arm_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each vector of the nearest within its label."""
    hits = vector_topk(table(spark, d, "embeddings"), vector(spark, d), 100, "vec_id", ["label"])
    return hits.select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")).alias("rank"))


@query
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest others of every vector whose number a hundred divides."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest_of_each(e, e.where("vec_id % 100 = 0"), 10, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query
def term_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Each term of documents, in how many it occurs and how often; the row without a term is the corpus."""
    return bulk.dictionary(table(spark, d, "documents"))


class _Sized:
    """The length of a text for its embedding, where that is not what a query is about."""

    def embed(self, text: str) -> list[float]:
        return [1.0, float(len(text))]


#: Files of a language that folder_sync makes of documents.
SLOTS = 25


def _write_texts(docs: DataFrame, path: str) -> None:
    """The texts as files, one for each language and slot, below folders named by these."""
    own = docs.select(F.coalesce("text", F.lit("")).alias("value"), "lang", (F.col("doc_id") % SLOTS).alias("slot"), "doc_id")
    with settings(docs.sparkSession, NO_LEFTOVERS):
        own.repartition("lang", "slot").sortWithinPartitions("lang", "slot", "doc_id").drop("doc_id").write.mode("append").partitionBy("lang", "slot").text(path)


@query
def folder_sync(spark: SparkSession, d: str) -> DataFrame:
    """The store after a folder of real files was indexed, some of them were edited and some deleted, and
    the folder was looked at again."""
    root = f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    forget_at_exit(spark, root)
    docs, store = table(spark, d, "documents"), Store(spark, f"{root}/store", buckets=8)
    config = Config(extensions=("txt",), batch_size=1, chunk_size=SIZE, chunk_overlap=OVERLAP, max_file_size=1 << 40)
    sync = lambda: sync_folder(store, f"{root}/files", f"{root}/seen", _Sized(), config)
    _write_texts(docs, f"{root}/files")
    sync()
    for gone in (REMOVED, EDITED):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/files/lang={gone}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _write_texts(docs.where(F.col("lang") == EDITED).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\nedited"))), f"{root}/files")
    sync()
    part = lambda name: F.regexp_extract("file_path", f"/{name}=([^/]*)/", 1)
    return store.chunks().select(part("lang").alias("lang"), part("slot").cast("bigint").alias("slot"), "start_line", "end_line", "content_hash")


QUERIES = {name.rstrip("_"): f for name, f in QUERIES.items()}
