"""Keyword queries: cleaning, parsing and the tokenizer."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem

#: A token: ASCII letters and digits, and all above ASCII. A-Z are folded, nothing else.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in either case, for the JVM, which is faster at what a class holds than at what it doesn't.
EITHER_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: A character of a query's word: the same in either case, and the underscore.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = str.maketrans(_UPPER, _UPPER.lower())
#: Signs and words that become spaces, and what counts as space. Words end at what is no ASCII
#: letter, digit or underscore.
SIGNS, OPERATORS = r'[:"*()\[\]]', r"(?i)(?<![A-Za-z0-9_])(AND|OR|NOT|NEAR)(?![A-Za-z0-9_])"
SPACE = " \t\n\v\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def found(text: Column) -> Column:
    """The tokens as they are spelled, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EITHER_CASE), F.lit(0))


def folded(token: Column) -> Column:
    """A token with A-Z lower-cased. lower() is much the faster, and folds no more than A-Z where a
    token is ASCII."""
    return F.when(F.octet_length(token) == F.length(token), F.lower(token)).otherwise(F.translate(token, _UPPER, _UPPER.lower()))


def tokens(text: Column) -> Column:
    """Unstemmed tokens in order; none for null."""
    return F.transform(found(text), folded)


def stemmed(words: pa.Array) -> pa.Array:
    """Porter stems of arrays of tokens; each word of a batch is a Python string, and stemmed, once."""
    known = words.flatten().dictionary_encode()
    stem_of = pa.array([None if w is None else stem(w) for w in known.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0)).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, stem_of.take(known.indices), mask=words.is_null())


stems = F.arrow_udf(stemmed, T.ArrayType(T.StringType()))


def clean_query(query: Column) -> Column:
    """The query without signs and operator words, with single spaces."""
    bare = F.regexp_replace(F.regexp_replace(query, SIGNS, " "), OPERATORS, " ")
    return F.trim(F.regexp_replace(bare, f"[{SPACE}]+", " "))


def cleaned(query: str) -> str:
    """clean_query for a string."""
    return re.sub(f"[{SPACE}]+", " ", re.sub(OPERATORS, " ", re.sub(SIGNS, " ", query), flags=re.A)).strip(" ")


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    at_start: bool = False


def parse_query(query: str, stemmed: bool = True, lenient: bool = False) -> list[Phrase] | None:
    """The phrases that must all occur, or None if nothing can match.

    Words are separated by spaces; a word of several tokens, and words joined by +, are a phrase; ^
    before a phrase ties it to the start of a column. A query with any other sign is an error and
    matches nothing, or with `lenient` that sign counts as a space. Wordless phrases don't count."""
    line = cleaned(query)
    if lenient:
        line = re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]", " ", line)
    parts = re.findall(WORD + r"+|\S", line)
    phrases: list[tuple[list[str], bool]] = []
    caret = joined = False
    for p in parts:
        if p == "^" and not caret and not joined:
            caret = True
        elif p == "+" and phrases and not caret and not joined:
            joined = True
        elif re.match(WORD, p):
            words = re.findall(TOKEN, p.translate(_FOLD))
            if joined:
                phrases[-1][0].extend(words)
            else:
                phrases.append((words, caret))
            caret = joined = False
        else:
            return None
    if caret or joined:
        return None
    return [Phrase(tuple(map(stem, ws)) if stemmed else tuple(ws), c) for ws, c in phrases if ws] or None
