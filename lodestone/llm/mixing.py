"""Mixing sources to target weights: temperature, and budgeted permutations of blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, table, written

TOKEN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """budget: tokens to draw, as a multiple of the corpus. entropy: wanted entropy of the weights, as
    a share of the log of the number of sources with tokens. max_repeats: how often a source's tokens may be
    drawn. blocks: blocks a source is dealt into, so a drawn source is at most half a block off.
    steps: halvings of the exponent's bracket."""

    budget: float = 1.0
    entropy: float = 0.97
    max_repeats: float = 4.0
    blocks: int = 1024
    steps: int = 40
    seed: int = 11

    def __post_init__(self) -> None:
        if self.budget > self.max_repeats:
            raise ValueError("a budget above max_repeats draws some source more often than that, whatever the weights")
        if not (self.budget >= 0 and 0 <= self.entropy <= 1 and self.blocks > 0 and self.steps > 0):
            raise ValueError("budget and entropy must not be negative, entropy at most 1, blocks and steps positive")


def _block(mix: Mix) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(mix.blocks))


def _exponent(shares: DataFrame, mix: Mix) -> float:
    """The largest exponent in [0, 1] whose weights still have the wanted entropy, raised until no
    source is drawn more than max_repeats times. Four halvings a job: it tries 15 exponents at once,
    in one aggregation over the sources."""
    n = shares.where("tokens > 0").count()
    total = shares.agg(F.sum("tokens")).first()[0] or 0

    def measured(exponents: list[float]) -> dict[float, tuple[float, float]]:
        w = shares.where("tokens > 0").select(F.explode(F.array(*map(F.lit, exponents))).alias("t"), (F.col("tokens") / F.lit(float(total))).alias("share"))
        w = w.withColumn("w", F.pow("share", "t")).groupBy("t").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wlw"), F.max(F.col("w") / F.col("share")).alias("top"))
        return {r.t: (float(log(r.z) - r.wlw / r.z), mix.budget * r.top / r.z) for r in w.collect()}

    def bisect(good: Callable[[tuple[float, float]], bool]) -> float:  # good holds at 0, and stops holding somewhere above
        low, high = 0.0, 1.0
        for _ in range(-(-mix.steps // 4)):
            grid = [low + (high - low) * k / 16 for k in range(17)]
            found = measured(grid[1:-1])
            last = max((k for k in range(1, 16) if good(found[grid[k]])), default=0)
            low, high = grid[last], grid[last + 1]
        return low

    if not total or n < 2:
        return 1.0
    wanted = mix.entropy * log(n)
    at_one = measured([1.0])[1.0]
    flat = 1.0 if at_one[0] >= wanted else bisect(lambda m: m[0] >= wanted)
    bounded = 1.0 if at_one[1] > mix.max_repeats else bisect(lambda m: m[1] > mix.max_repeats)
    if bounded == 0.0 and measured([0.0])[0.0][1] <= mix.max_repeats:
        return flat
    return max(flat, bounded if bounded == 1.0 else bounded + 2.0 ** -(4 * -(-mix.steps // 4)))


def _keyed(docs: DataFrame, mix: Mix) -> DataFrame:
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce(_block(mix), F.lit(0)).alias("block"))


def plan(docs: DataFrame, mix: Mix) -> DataFrame:
    """The blocks of docs(doc_id, source, n_tokens, block): source, block, weight, copies, places.

    A source's quota is its weight's part of the budget. It is drawn in whole passes, and in one
    more that stops at the block nearest to the quota; each pass has a permutation of its own.
    places: where the block stands in each pass that draws it."""
    blocks = written(docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    shares = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    exponent = _exponent(shares, mix)
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    raw = shares.where("tokens > 0").withColumn("w", F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent)))
    z = raw.agg(F.sum("w")).first()[0] or 1.0
    sources = raw.select(F.col("source").alias("s"), F.col("tokens").alias("all"), F.round(F.col("w") / F.lit(z), 9).alias("weight"))
    sources = sources.withColumn("quota", F.floor(F.col("weight") * F.lit(float(total)) * F.lit(float(mix.budget)) + F.lit(0.5)).cast("bigint"))
    sources = sources.select("s", "weight", F.expr("quota div all").alias("passes"), (F.col("quota") % F.col("all")).alias("rest"))
    dealt = blocks.join(sources, F.col("source") == F.col("s"), "left").select("source", "block", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("rest", F.lit(0)).alias("rest"))
    turns = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))).alias("pass"))
    key = F.sha2(F.concat_ws(":", F.lit(mix.seed), "source", "pass", "block").cast("binary"), 256)
    order = Window.partitionBy("source", "pass").orderBy("key", "block")
    turns = turns.withColumn("key", key).select("*", F.sum("tokens").over(order).alias("upto"), F.row_number().over(order).cast("bigint").alias("place"))
    drawn = turns.withColumn("drawn", (F.col("pass") < F.col("passes")) | (2 * F.col("upto") - F.col("tokens") <= 2 * F.col("rest")) & (F.col("rest") > 0))
    return drawn.groupBy("source", "block", "weight").agg(F.sum(F.col("drawn").cast("bigint")).alias("copies"), F.array_sort(F.collect_list(F.when(F.col("drawn"), F.struct("pass", "place")))).alias("places"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of docs(doc_id, source, text): doc_id, source, n_tokens, block, weight, copies,
    places: where its block stands in each pass that draws it, as pass:place, joined by commas.

    Token shares of the sources are raised to one exponent, found by bisection so that the weights
    have the wanted entropy, or else the repetition limit holds; the weights are then realised as
    copies of whole blocks. Documents go to blocks by a hash of their id, so a source of any size
    has at most mix.blocks blocks and no window holds more. copies may be 0. A null source counts
    as '', a null text has no tokens, a null id goes to block 0; a source without tokens has weight
    0. Repeated rows count each time. A long text counts by its tokens; blocks of one hash order go by
    their number. Empty tables give no rows; of clashing columns only the three are read."""
    keyed = written(_keyed(narrow(docs, "doc_id", "source", "text"), mix))
    p = plan(keyed, mix).select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "weight", "copies", F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["pass"], p["place"])), ",").alias("places"))
    return keyed.join(p, (F.col("source") == F.col("p_source")) & (F.col("block") == F.col("p_block"))).select("doc_id", "source", "n_tokens", "block", "weight", "copies", "places")


def draw(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixture itself: the rows of docs, once for each time they are drawn, with mix_pass and
    mix_place, the place of their block in that pass; in the order of these two a source's rows
    follow its permutations. Other columns of these names are replaced."""
    p = plan(_keyed(narrow(docs, "doc_id", "source", "text"), mix), mix)
    p = p.where("copies > 0").select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), F.explode("places").alias("p_at"))
    own = docs.drop("mix_pass", "mix_place")
    with_plan = own.join(p, (F.coalesce(own["source"], F.lit("")) == p["p_source"]) & (F.coalesce(_block(mix), F.lit(0)) == p["p_block"]))
    return with_plan.select(*[own[c] for c in own.columns], p["p_at"]["pass"].alias("mix_pass"), p["p_at"]["place"].alias("mix_place"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sources over documents, with the default mix."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
with recursive k as (select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) as n_tokens,
                            cast('0x' || substr(md5('11:' || cast(doc_id as varchar)), 1, 8) as bigint) % 1024 as block from documents),
bl as (select source, block, cast(sum(n_tokens) as bigint) as tokens from k group by source, block),
s as (select source, cast(sum(tokens) as bigint) as tokens from bl group by source having sum(tokens) > 0),
tot as (select cast(sum(tokens) as double) as t, count(*) as n from s),
c as (select list(tokens / t order by source) as sh, max(0.97 * ln(n)) as wanted from s, tot),
e as (select 0 as i, cast(0 as double) as lo, cast(1 as double) as hi from c
      union all
      select i + 1, case when good then mid else lo end, case when good then hi else mid end
      from (select i, lo, hi, mid, ln(list_sum(w)) - list_sum(list_transform(w, lambda x: x * ln(x))) / list_sum(w) >= wanted as good
            from (select i, lo, hi, (lo + hi) / 2 as mid, wanted, list_transform(sh, lambda x: pow(x, (lo + hi) / 2)) as w from e, c where i < 40))),
r as (select 0 as i, cast(0 as double) as lo, cast(1 as double) as hi from c
      union all
      select i + 1, case when good then mid else lo end, case when good then hi else mid end
      from (select i, lo, hi, mid, list_max(list_transform(sh, lambda x: pow(x, mid - 1))) / list_sum(list_transform(sh, lambda x: pow(x, mid))) > 4 as good
            from (select i, lo, hi, (lo + hi) / 2 as mid, sh from r, c where i < 40))),
x as (select greatest(case when (select -list_sum(list_transform(sh, lambda x: x * ln(x))) >= wanted from c) then 1 else (select lo from e where i = 40) end,
                      case when (select list_max(list_transform(sh, lambda x: 1 / x)) / len(sh) <= 4 from c) then 0 else (select hi from r where i = 40) end) as t),
w as (select source, tokens, pow(tokens / tot.t, x.t) as w from s, tot, x),
q as (select source, tokens as al, round(w / (select sum(w) from w), 9) as weight from w),
p as (select source, al, weight, cast(floor(weight * tot.t + 0.5) as bigint) as quota from q, tot),
d as (select bl.source, bl.block, bl.tokens, coalesce(weight, 0) as weight, coalesce(quota // al, 0) as passes, coalesce(quota % al, 0) as rest from bl left join p using (source)),
u as (select *, unnest(range(0, passes + 1)) as pass from d),
o as (select *, sum(tokens) over w as upto, row_number() over w as place from u
      window w as (partition by source, pass order by sha256('11:' || source || ':' || pass || ':' || block), block)),
y as (select source, block, weight, count(*) filter (where drawn) as copies, coalesce(string_agg(pass || ':' || place, ',' order by pass) filter (where drawn), '') as places
      from (select *, pass < passes or (rest > 0 and 2 * upto - tokens <= 2 * rest) as drawn from o) group by source, block, weight)
select doc_id, source, n_tokens, block, weight, cast(copies as bigint) as copies, places from k join y using (source, block)
"""
