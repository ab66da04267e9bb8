"""Full-text search: postings, corpus statistics and BM25."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Phrase, stems, tokens

#: The searched columns, in order.
COLUMNS = ("file_path", "function_name", "class_name", "content")
#: BM25's parameters, and what an idf is at least.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(chunks: DataFrame, columns: Sequence[str] = COLUMNS, stemmed: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """chunk_id, dl, col_no, pos, term for each token of the columns; one set of rows for each id. dl is
    the chunk's number of tokens, so that a query needs no other rows than those of its terms. carry:
    more columns of the chunks.

    The index to persist: write it sorted or bucketed by term, and a query reads its terms only."""
    return _exploded(chunks, columns, stemmed, lambda dl: [F.col("id").alias("chunk_id"), *map(F.col, carry), dl.alias("dl")])


def _exploded(chunks: DataFrame, columns: Sequence[str], stemmed: bool, kept: Callable[[Column], list[Column]]) -> DataFrame:
    """What is kept of a chunk and its number of tokens, col_no, pos, term for each token."""
    words = [stems(tokens(F.col(c))) if stemmed else tokens(F.col(c)) for c in columns]
    rows = chunks.select("*", F.array(*words).alias("all"))
    own = kept(F.aggregate("all", F.lit(0).cast("bigint"), lambda s, w: s + F.size(w)))
    rows = rows.select(*own, F.posexplode_outer("all").alias("col_no", "words"))  # outer: else a filter would tokenize again
    names = [c for c in rows.columns if c != "words"]
    return rows.select(*names, F.posexplode("words").alias("pos", "term"))


#: What is stored of a posting, beside columns that are carried.
PACKED = "place string, col_no int, pos int, term string"


def packed(chunks: DataFrame, columns: Sequence[str] = COLUMNS, stemmed: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """postings in the form to store, place, col_no, pos, term: place is one value that has dl, chunk_id and
    file_path, so that a file holds one dictionary of chunks and a posting one number for all three. It is #,
    dl and the bytes of the id in ten digits each, the id, and = and the path: a reader cuts it by places."""
    key, empty = F.col("id").cast("string"), F.lit("")
    path = F.coalesce(F.concat(F.lit("="), F.col("file_path")), empty)  # so that null is not the empty path
    digits = lambda n: F.lpad(n.cast("string"), _WIDE, "0")
    one = lambda dl: F.concat(F.lit("#"), digits(dl), F.coalesce(digits(F.octet_length(key)), F.lit(_NO_KEY)), F.coalesce(key, empty), path).alias("place")
    return _exploded(chunks, columns, stemmed, lambda dl: [one(dl), *map(F.col, carry)])


#: Digits of a number in place; what it has for the length of an id that is null.
_WIDE, _NO_KEY = 10, "-000000001"


def unpacked(stored: DataFrame, id_type: str = "string") -> DataFrame:
    """postings(chunk_id, file_path, dl, and what is beside place) of what packed gave; filters by term reach the scan.
    Places without a # are of the form of before: dl, the characters of the id, and the same rest, after spaces."""
    new = F.startswith("place", F.lit("#"))
    raw = F.col("place").cast("binary")  # bytes are cut at once, characters are counted from the first
    cut = lambda begin, n: F.substring(raw, begin, n).cast("string")
    n, at = cut(2 + _WIDE, _WIDE).cast("int"), 2 + 2 * _WIDE
    key = F.when(n >= 0, cut(at, n))
    path = cut(F.greatest(n, F.lit(0)) + at, F.octet_length("place"))
    head = F.substring_index("place", " ", 2)
    rest = F.substr("place", F.length(head) + 2)
    n_old = F.substring_index(head, " ", -1).cast("int")
    key_old, path_old = F.when(n_old >= 0, F.substr(rest, F.lit(1), n_old)), F.substr(rest, F.greatest(n_old, F.lit(0)) + 1)
    named = lambda path: F.when(path != "", F.substr(path, F.lit(2)))
    either = lambda a, b: F.when(new, a).otherwise(b)
    dl = either(cut(2, _WIDE).cast("bigint"), F.substring_index("place", " ", 1).cast("bigint"))
    own = [either(key, key_old).cast(id_type).alias("chunk_id"), either(named(path), named(path_old)).alias("file_path"), dl.alias("dl")]
    return stored.select(*own, *[c for c in stored.columns if c != "place"])


def _place(index: DataFrame) -> list[str]:
    """What the postings tell of where a chunk lies."""
    return [c for c in ("file_path",) if c in index.columns]


def n_tokens(columns: Sequence[str] = COLUMNS) -> Column:
    """The number of tokens of a chunk."""
    return sum((F.size(tokens(F.col(c))).cast("bigint") for c in columns), F.lit(0).cast("bigint"))


def corpus_of(chunks: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The same as corpus of the postings, straight from the texts."""
    return chunks.select(n_tokens(columns).alias("dl")).agg(F.count(F.when(F.col("dl") > 0, 1)).alias("n"), F.sum("dl").alias("tokens"))


def corpus(index: DataFrame) -> DataFrame:
    """One row: n, the chunks that have tokens, and tokens. To persist beside the index: without it a
    query has to read all of the index for these two numbers."""
    return index.groupBy("chunk_id").agg(F.max("dl").alias("dl")).agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))


def phrase_hits(index: DataFrame, phrases: Sequence[Phrase]) -> DataFrame:
    """chunk_id, phrase_no, tf, dl: how often each phrase occurs, and file_path if the postings have it.
    Phrases lie within one column.

    Each posting of a query term is one place of some phrases; a phrase stands where all its places
    fall on one beginning. The terms are pushed to the scan, and no two postings are joined."""
    place = {}
    for k, p in enumerate(phrases):
        for o, term in enumerate(p.terms):
            place.setdefault(term, []).append((k, o, len(p.terms), p.at_start))
    entry = lambda x: F.struct(F.lit(x[0]).alias("phrase_no"), F.lit(x[1]).alias("o"), F.lit(x[2]).alias("n"), F.lit(x[3]).alias("at_start"))
    known = F.create_map(*[x for term, xs in place.items() for x in (F.lit(term), F.array(*map(entry, xs)))])
    at = _place(index)
    own = lambda: [F.max("dl").alias("dl"), *[F.max(c).alias(c) for c in at]]
    of = index.where(F.col("term").isin(list(place))).select("chunk_id", *at, "dl", "col_no", "pos", F.explode(F.element_at(known, F.col("term"))).alias("p"))
    begun = of.select("chunk_id", *at, "dl", "col_no", "p.phrase_no", "p.n", "p.at_start", (F.col("pos") - F.col("p.o")).alias("begin"), "p.o").where("not at_start or begin = 0")
    if any(len(p.terms) > 1 for p in phrases):
        begun = begun.groupBy("chunk_id", "col_no", "phrase_no", "n", "begin").agg(F.count("*").alias("have"), *own()).where("have = n")
    return begun.groupBy("chunk_id", "phrase_no").agg(F.count("*").alias("tf"), *own())


def bm25(index: DataFrame, phrases: Sequence[Phrase] | None, known: DataFrame | None = None) -> DataFrame:
    """chunk_id, rank of the chunks in which all phrases occur, and file_path if the postings have it;
    smaller ranks are better.

    known: the row of corpus, if it is stored. Phrases add up in query order; a repeated one counts
    twice. None, for a query that is an error, gives no rows."""
    if not phrases:
        return index.select("chunk_id", F.lit(0.0).alias("rank"), *_place(index)).limit(0)
    hits = phrase_hits(index, phrases)
    figures = (corpus(index) if known is None else known).select(F.col("n").cast("double").alias("n"), F.col("tokens").cast("double").alias("tokens"))
    n, frequency = F.col("n"), hits.groupBy("phrase_no").agg(F.count(F.when((F.col("tf") > 0) & (F.col("dl") > 0), 1)).cast("double").alias("df"))
    # The frequencies read all columns of the hits, as the scores do, so that one shuffle serves both.
    # One row of corpus figures and at most a row for each phrase: bounded by the query.
    idf = frequency.join(F.broadcast(figures)).select(F.col("phrase_no").alias("of"), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"), (F.col("tokens") / n).alias("avgdl"))
    idf = idf.select("of", F.when(F.col("raw") <= 0, F.lit(LEAST_IDF)).otherwise(F.col("raw")).alias("idf"), "avgdl")
    met = hits.join(F.broadcast(idf), F.col("phrase_no") == F.col("of"))
    every = met.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("phrase_no", "idf", "tf", "avgdl"))).alias("terms"), F.max("dl").alias("dl"), *[F.max(c).alias(c) for c in _place(index)]).where(F.size("terms") == len(phrases))
    part = lambda t: t["idf"] * ((t["tf"] * F.lit(K1 + 1.0)) / (t["tf"] + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / t["avgdl"])))
    return every.select("chunk_id", (F.lit(-1.0) * F.aggregate("terms", F.lit(0.0), lambda s, t: s + part(t))).alias("rank"), *_place(index))


def keyword_search(index: DataFrame, phrases: Sequence[Phrase] | None, limit: int = 20, known: DataFrame | None = None) -> DataFrame:
    """The best `limit` of bm25; ties by id."""
    return bm25(index, phrases, known).orderBy("rank", "chunk_id").limit(limit)
