"""The searches: first the places of the final hits, then the payload of these and of no others."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_score, may_match
from ..functions.text import parse_query
from ..functions.vector import cosine, cosine_to, literal
from ..schema import SHOWN, Config
from . import fusion
from .fulltext import keyword_search

if TYPE_CHECKING:
    from ..sources.store import Store

log = logging.getLogger("lodestone")

#: From this length on vectors are scored by whole batches instead of by expressions.
LONG_VECTOR = 256


def vector_topk(vectors: DataFrame, query: Sequence[float], limit: int, key: str = "id", extra: Sequence[str] = ()) -> DataFrame:
    """key, similarity (and the extra columns) of the nearest vectors of vectors(key, embedding).

    Vectors of another length, null ones and zero ones are left out. Ties by key. A norm column is
    used if there is one; no full sort, each task keeps its best."""
    known = F.col("norm") if "norm" in vectors.columns else None
    whole = vectors.where(F.size("embedding") == len(query))
    score = cosine(F.col("embedding"), literal(query), known) if len(query) < LONG_VECTOR else cosine_to(query, F.col("embedding"))
    return whole.select(key, *extra, score.alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), key).limit(limit)


def rejected(vectors: DataFrame, length: int, key: str = "id") -> DataFrame:
    """key, reason of the vectors that a query of some length can't be compared with: missing, of another
    length, or of length zero."""
    v = F.col("embedding")
    empty = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) == 0
    reason = F.when(v.isNull(), "missing").when(F.size(v) != length, "of another length").when(empty, "zero")
    return vectors.select(key, reason.alias("reason")).where("reason is not null")


def fuzzy_topk(items: DataFrame, query: str, text: Column, limit: int = 20, key: str = "id") -> DataFrame:
    """key, score of the items whose text has the query as a subsequence; ties by key."""
    return items.where(may_match(query, text)).select(key, fuzzy_score(F.lit(query), text).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(limit)


def fuzzy_paths(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """id, file_path, score of chunks(id, file_path), as fuzzy_topk over their paths, but each path is
    scored once, however many chunks it has.

    Only paths that are no worse than the limit's last one meet the chunks, ties included, so the
    hits are those of scoring every chunk."""
    path = F.col("file_path")
    scored = chunks.select("file_path").where(may_match(query, path)).distinct().select("file_path", fuzzy_score(F.lit(query), path).alias("score")).where("score is not null")
    last = scored.orderBy(F.desc("score")).limit(limit).agg(F.min("score").alias("last"))  # one row
    best = scored.join(F.broadcast(last), F.col("score") >= F.col("last")).select(F.col("file_path").alias("of"), "score")
    return chunks.select("id", "file_path").join(best, path == F.col("of")).select("id", "file_path", "score").orderBy(F.desc("score"), "id").limit(limit)


def best_per(hits: DataFrame, column: str, key: str = "id") -> DataFrame:
    """The most similar of the limited hits for each value of a column."""
    w = Window.partitionBy(column).orderBy(F.desc("similarity"), key)
    return hits.withColumn("place_", F.row_number().over(w)).where("place_ = 1").drop("place_")


def with_chunks(hits: DataFrame, payload: Callable[[list[str]], DataFrame]) -> DataFrame:
    """chunk, similarity (and more columns) of limited hits(id, file_path, similarity); ids without a
    chunk are dropped.

    The hits are found here and now; they are no more than a search's limit. Their files alone are read
    for what is shown: payload is given the paths and returns the chunks of these files."""
    rest = [c for c in hits.columns if c not in ("id", "file_path")]
    found = hits.collect()
    own = hits.sparkSession.createDataFrame(found, hits.schema)
    read = payload(sorted({r.file_path for r in found})).where(F.col("id").isin([r.id for r in found]))
    shown = read.select(F.col("id").alias("chunk_id"), F.struct(*SHOWN).alias("chunk"))
    return shown.join(F.broadcast(own), F.col("chunk_id") == F.col("id")).select("chunk", *rest)


class Searcher:
    """Searches over a table of chunks with embeddings, and an index of postings.

    chunks: id, file_path, start_line, end_line, content, language, function_name, class_name,
    embedding, and norm if stored. corpus: the index's figures, if stored. embed: text to vector; a failure
    fails the search. payload: paths to the chunks of these files, by default by a filter that reaches
    the scan. A search first finds the places of its hits, without their contents, and reads then."""

    def __init__(
        self, chunks: DataFrame, index: DataFrame, embed: Callable[[str], Sequence[float]], config: Config = Config(), stemmed: bool = True, corpus: DataFrame | None = None,
        payload: Callable[[list[str]], DataFrame] | None = None,
    ) -> None:
        self.corpus = corpus
        self.chunks, self.index, self.embed, self.config, self.stemmed = chunks, index, embed, config, stemmed
        self.payload = payload or (lambda paths: self.chunks.where(F.col("file_path").isin(paths)))

    @classmethod
    def of(cls, store: Store, embed: Callable[[str], Sequence[float]], config: Config = Config()) -> Searcher:
        """Searches over a store's newest version, of which only the buckets of the hits are read."""
        state = store.state()
        return cls(store.chunks(state), store.index(state), embed, config, store.stemmed, store.corpus(state), lambda paths: store.chunks_of(paths, state))

    def cache(self) -> Searcher:
        """Keeps the tables in memory, as far as it goes, for many queries; close releases them."""
        self.chunks, self.index = self.chunks.persist(), self.index.persist()
        return self

    def close(self) -> None:
        self.chunks.unpersist()
        self.index.unpersist()

    def __enter__(self) -> Searcher:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def rejects(self) -> dict[str, int]:
        """How many chunks no semantic search can find, by reason; they are logged. Asks the provider once."""
        dims = len(self.embed("test"))
        counts = {r.reason: r.n for r in rejected(self.chunks.select("id", "embedding"), dims).groupBy("reason").agg(F.count("*").alias("n")).collect()}
        for reason, n in counts.items():
            log.warning("%d chunks are left out of semantic searches, which compare %d dimensions: vector %s", n, dims, reason)
        return counts

    def _semantic(self, text: str, limit: int) -> DataFrame:
        vectors = self.chunks.select("id", "file_path", "embedding", *(["norm"] if "norm" in self.chunks.columns else []))
        return vector_topk(vectors, self.embed(text), limit, extra=["file_path"])

    def _keyword(self, query: str, limit: int) -> DataFrame:
        hits = keyword_search(self.index, parse_query(query, self.stemmed, self.config.lenient_keywords), limit, self.corpus).withColumnRenamed("chunk_id", "id")
        if "file_path" not in hits.columns:  # postings of another make: the places are looked up
            places = self.chunks.select(F.col("id").alias("of"), "file_path")
            hits = hits.join(places, F.col("id") == F.col("of"))
        return hits.select("id", "file_path", "rank")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """chunk, similarity, best first, by the configured mode. A blank query is an error."""
        return self._placed(query, limit).orderBy("place").select("chunk", "similarity")

    def _placed(self, query: str, limit: int) -> DataFrame:
        """chunk, similarity, place of search; the window is over the limited hits."""
        if not query or not query.strip():
            raise ValueError("the query is empty")
        hits, order = {"hybrid": self._hybrid_hits, "semantic": self._semantic_hits, "keyword": self._keyword_hits}[self.config.search_mode](query, limit)
        placed = hits.withColumn("place", F.row_number().over(Window.orderBy(*order)))
        return with_chunks(placed.select("id", "file_path", "similarity", "place"), self.payload)

    def _semantic_hits(self, query: str, limit: int) -> tuple[DataFrame, list[Column]]:
        return self._semantic(query, limit), [F.desc("similarity"), F.col("id")]

    def semantic(self, query: str, limit: int = 10) -> DataFrame:
        return with_chunks(self._semantic(query, limit), self.payload).orderBy(F.desc("similarity"), "chunk.id")

    def _keyword_hits(self, query: str, limit: int) -> tuple[DataFrame, list[Column]]:
        return fusion.from_best(self._keyword(query, limit)), [F.col("rank"), F.col("id")]

    def keyword(self, query: str, limit: int = 10) -> DataFrame:
        """Similarities are relative to the best and the worst of the hits; a single hit has 1."""
        hits, _ = self._keyword_hits(query, limit)
        return with_chunks(hits, self.payload).orderBy("rank", "chunk.id").select("chunk", "similarity")

    def hybrid(self, query: str, limit: int = 10) -> DataFrame:
        """The fused best of twice as many hits of each arm; similarities are relative to the least
        and the most of the limited result, so the last hit, and a single one, has 0."""
        hits, order = self._hybrid_hits(query, limit)
        return with_chunks(hits, self.payload).orderBy(*order).select("chunk", "similarity")

    def _hybrid_hits(self, query: str, limit: int) -> tuple[DataFrame, list[Column]]:
        arms = [
            fusion.ranked(self._semantic(query, 2 * limit), "semantic", F.desc("similarity"), F.col("id"), carry=["file_path"]),
            fusion.ranked(self._keyword(query, 2 * limit), "keyword", F.col("rank"), F.col("id"), carry=["file_path"]),
            fusion.ranked(fuzzy_paths(self.chunks, query, 2 * limit), "fuzzy", F.desc("score"), F.col("id"), carry=["file_path"]),
        ]
        return fusion.min_max(fusion.rrf(arms[0].unionByName(arms[1]).unionByName(arms[2]), self.config.rrf_k, limit)), [F.desc("score"), F.col("met")]

    def filtered(self, query: str, limit: int = 10, min_similarity: float = 0.0, file_pattern: str | None = None, language: str | None = None) -> DataFrame:
        """search with filters over twice as many hits: the filters stay above that limit."""
        kept = self._placed(query, 2 * limit)
        if min_similarity > 0:
            kept = kept.where(F.col("similarity") >= min_similarity)
        if file_pattern:
            kept = kept.where(F.col("chunk.file_path").contains(file_pattern))
        if language:
            kept = kept.where(F.col("chunk.language") == language)
        return kept.orderBy("place").limit(limit).select("chunk", "similarity")

    def similar_files(self, file_path: str, limit: int = 15) -> DataFrame:
        """The best chunk of each other file, by the content of the file's first chunk."""
        first = self.payload([file_path]).orderBy("start_line", "id").select("content").first()
        if first is None:
            return with_chunks(self.chunks.select("id", "file_path", F.lit(0.0).alias("similarity")).limit(0), self.payload)
        hits = self._semantic(first[0], 2 * limit).where(F.col("file_path") != file_path)
        return self._one_per_file(hits, limit)

    def similar_code(self, file_path: str, line: int, limit: int = 15) -> DataFrame:
        """The best chunk of each file, by the smallest chunk around a line, which itself is left
        out; without such a chunk, similar_files."""
        here = chunk_at_line(self.payload([file_path]), file_path, line).select("id", "content").first()
        if here is None:
            return self.similar_files(file_path, limit)
        hits = self._semantic(here.content, 2 * limit).where(F.col("id") != here.id)
        return self._one_per_file(hits, limit)

    def _one_per_file(self, hits: DataFrame, limit: int) -> DataFrame:
        best = best_per(hits, "file_path").orderBy(F.desc("similarity"), "id").limit(limit)
        return with_chunks(best.select("id", "file_path", "similarity"), self.payload).orderBy(F.desc("similarity"), "chunk.id")


def chunk_at_line(chunks: DataFrame, file_path: str, line: int) -> DataFrame:
    """The smallest chunk of a file that encloses a line; ties by id."""
    at = chunks.where((F.col("file_path") == file_path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    return at.orderBy(F.col("end_line") - F.col("start_line"), "id").limit(1)


def chunks_at_lines(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """The same for many places(file_path, line): place columns and the id, start_line and end_line
    of the smallest chunk around each; places without one are left out."""
    spans = chunks.select(F.col("file_path").alias("f_"), "id", "start_line", "end_line")
    met = places.join(spans, (F.col("file_path") == F.col("f_")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "id", "start_line", "end_line"))
    return met.groupBy("file_path", "line").agg(best.alias("b")).select("file_path", "line", "b.id", "b.start_line", "b.end_line")
