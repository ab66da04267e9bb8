"""Fuzzy path matching as a fold over the target's characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a match scores.
MATCH, RUN, BOUNDARY, AFTER_SEPARATOR, CAMEL, GAP, IN_NAME = 1.0, 5.0, 10.0, 15.0, 8.0, 0.1, 3.0


def may_match(query: str, target: Column) -> Column:
    """Whether the target can have the query as a subsequence: false only where it can't. A pattern of
    the query's ASCII characters, so that most targets are passed over before they are folded."""
    wanted = [re.escape(c) for c in query.lower() if c.isascii()]
    return F.lower(target).rlike("(?s)" + ".*?".join(wanted)) if wanted else F.lit(True)


def fuzzy_score(query: Column, target: Column) -> Column:
    """Score of the query's characters as a subsequence of the target, greedy from the left and
    regardless of case; null if they aren't one, or either is empty or null.

    A match scores more in a run of adjacent ones, at the start, after a separator (space, dash,
    underscore, slash, backslash), where a lower-case character is followed by an upper-case one,
    and in the file name; characters between the first and the last match cost a little. Digits and
    signs count as both lower and upper case. Positions are code points."""
    low, n = F.lower(query), F.length(query)
    name_at = F.length(target) - F.length(F.regexp_extract(target, r"([^/\\]*)$", 1)) - 1
    chars = F.transform(F.sequence(F.lit(0), F.length(target) - 1), lambda i: F.struct(i.alias("i"), F.substr(target, i + 1, F.lit(1)).alias("cur"), F.when(i > 0, F.substr(target, i, F.lit(1))).otherwise("").alias("prev")))
    start = F.struct(*[F.lit(v).alias(k) for k, v in (("q", 0), ("last", -1), ("first", -1), ("run", 0), ("named", 0), ("score", 0.0))])

    def step(s: Column, c: Column) -> Column:
        i = c["i"]
        hit = (s["q"] < n) & (F.lower(c["cur"]) == F.substr(low, s["q"] + 1, F.lit(1)))
        run = F.when(i == s["last"] + 1, s["run"] + 1).otherwise(0)
        camel = (i > 0) & (c["prev"] == F.lower(c["prev"])) & (c["cur"] == F.upper(c["cur"]))
        edge = (i == 0) | c["prev"].isin(" ", "-", "_", "/", "\\") | camel
        worth = lambda when, points: F.when(when, points).otherwise(0.0)
        gain = MATCH + RUN * run + worth(edge, BOUNDARY) + worth(c["prev"].isin("/", "\\"), AFTER_SEPARATOR) + worth(camel, CAMEL)
        after = F.struct(
            (s["q"] + 1).alias("q"),
            i.alias("last"),
            F.when(s["first"] < 0, i).otherwise(s["first"]).alias("first"),
            run.alias("run"),
            (s["named"] + F.when(i >= name_at, 1).otherwise(0)).alias("named"),
            (s["score"] + gain).alias("score"),
        )
        return F.when(hit, after).otherwise(s)

    def end(s: Column) -> Column:
        return F.when(s["q"] == n, s["score"] - GAP * (s["last"] - s["first"]) + IN_NAME * s["named"])

    return F.when((n > 0) & (F.length(target) > 0), F.aggregate(chars, start, step, end))
