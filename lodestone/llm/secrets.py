"""Secret scan: three fixed rules, and Markov models that tell random strings from identifiers."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import narrow, table

#: The rules. Letters of the keywords match in either case, ASCII only.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the models judge, at least MIN_RUN long; those below LONG_RUN as a whole, longer ones by their
#: parts. Every access and hex match of full length lies in a long one.
MIN_RUN, LONG_RUN = 8, 16
SIGNS = "+/_=-"
_SIGN = re.compile(f"[{SIGNS}]")
#: Characters of long runs that are judged at once, and by which the pieces overlap.
PIECE = 1000
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)

#: Words and syllables from which ordinary identifiers are composed.
WORDS = (
    "account active address admin array async auth base batch block buffer build cache call cell channel char check class client close code column command commit config connection content context controller "
    "count create current cursor data database date default delete device document driver element email empty encode engine entry error event export factory field file filter first flag format frame function group "
    "handler header height image import index init input insert instance item job key label language last layer length level line link list load local lock log main manager map master max merge message method min "
    "mode model module name network next node number object offset order output page parent parse path pattern pointer pool position process profile property provider query queue random range read record release "
    "remote render request resource response result return root route row save schema search select send server service session set size sort source stack start state status stream string style sum sync system table "
    "target task template test text thread time title total trace tree type update upload user value version view virtual wait window worker write zone"
).split()
SYLLABLES = (
    "ai al an and ar as at ation au aux ba be ber bi bla ble bo bra bre bu car ce ch cha che chen ci cion co con cor cu da de den der di do du eau ed ee ei el en er es est eu eur eux ez fa fe fi fo for fu ga ge gen ger gi go gra gu ha heit her ho "
    "ich ie ier in ing is ist ja je ji jo ju keit la le len li lich ll lla lle llo lo lu ly ma me men ment mi mo mu na nd ne nen ni no nt nu oi on or os ou pa pe per pf po pre pro pu qua que qui ra re ren ri ro rr rra rro ru sa sch se sen ser sh si so "
    "st sta su ta te ten ter th the ti tion to tra tre tu tz ue un ung ur us va ve ver vi vo wa we wh wi wo za ze zo zu"
).split()
#: The alphabets of random strings; each has a model of its own.
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef")


def labelled_samples(n: int = 4000, seed: int = 7) -> tuple[list[list[str]], list[str]]:
    """(random strings by alphabet, ordinary identifiers): n of each kind, the same at every call."""
    rng = random.Random(seed)
    secret = [["".join(rng.choices(a, k=rng.randint(MIN_RUN, 48))) for _ in range(n)] for a in ALPHABETS]
    plain = []
    while len(plain) < 3 * n:
        words = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        coined = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(4, 12)))
        number = str(rng.randrange(10 ** rng.randint(1, 4)))
        plain += [
            rng.choice("_-/").join(words), "".join(w.title() for w in words), words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper(), "".join(words) + number,
            "/".join([*words, coined]), coined, coined.title(), coined.upper(), coined + "-" + words[0] + number, "".join(rng.choices(string.digits, k=rng.randint(MIN_RUN, 20))), f"{rng.randrange(1000):03d}-{rng.randrange(1000):03d}-{rng.randrange(10000):04d}", rng.choice("=-_+/") * rng.randint(MIN_RUN, 60),
            f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}-{words[0]}-{words[1]}", "=".join(words[:2]) + number,
        ]
    return secret, plain


def _markov(strings: list[str], smooth: float = 0.5) -> np.ndarray:
    """Log probabilities of the next character given the one before, row 0 for the start."""
    count = np.full((128, 128), smooth)
    for s in strings:
        codes = np.frombuffer(("\0" + s).encode(), np.uint8)
        np.add.at(count, (codes[:-1], codes[1:]), 1)
    return np.log(count / count.sum(1, keepdims=True))


#: One in so many held-out ordinary identifiers may exceed the threshold, one in so many random strings fall below.
PLAIN_ABOVE, RANDOM_BELOW = 2000, 100


class Detector:
    """Log-likelihood ratio of the best model of random strings against that of ordinary identifiers.

    A quarter of the samples is held out. threshold, in nats: the ratio that all but one in RANDOM_BELOW
    held-out random strings exceed, or that all but one in PLAIN_ABOVE held-out identifiers stay below,
    if that is higher. part: the latter for the highest stretch of a run, if that is higher."""

    def __init__(self, secret: list[list[str]], plain: list[str]) -> None:
        self.random = [_markov([x for i, x in enumerate(s) if i % 4]) for s in secret]
        self.plain = _markov([x for i, x in enumerate(plain) if i % 4])
        self.gains = np.stack([m - self.plain for m in self.random])
        rare = 1 - 1 / PLAIN_ABOVE
        strange = float(np.quantile([self.ratio(x) for s in secret for x in s[::4]], 1 / RANDOM_BELOW))
        self.threshold = max(strange, float(np.quantile([self.ratio(x) for x in plain[::4]], rare)))
        self.part = max(self.threshold, float(np.quantile([self._best(self._gains(x))[0] for x in plain[::4]], rare)))

    def ratio(self, s: str) -> float:
        codes = np.frombuffer(("\0" + s).encode(), np.uint8)
        a, b = codes[:-1], codes[1:]
        return max(float(m[a, b].sum()) for m in self.random) - np.log(len(self.random)) - float(self.plain[a, b].sum())

    def __call__(self, s: str) -> bool:
        return self.ratio(s) > self.threshold

    def random_ones(self, text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those of some runs of a text (start, end) that are random as a whole, judged all at once."""
        if not runs:
            return []
        codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)  # a byte for each code point
        a, z = np.array(runs).T
        size = z - a
        first = np.cumsum(size) - size
        at = np.repeat(a - first, size) + np.arange(size.sum())
        before = codes[at - 1]
        before[first] = 0
        sums = np.add.reduceat(self.gains[:, before, codes[at]], first, axis=1).max(0) - np.log(len(self.gains))
        return [runs[k] for k in np.flatnonzero(sums > self.threshold).tolist()]

    def _best(self, gains: np.ndarray) -> tuple[float, int, int]:
        """The stretch with the highest sum of ratios, over all models: the sum, less the choice of a model, start, end."""
        sums = np.concatenate((np.zeros((len(gains), 1)), gains.cumsum(1)), 1)
        rise = sums - np.minimum.accumulate(sums, 1)
        m, end = divmod(int(rise.argmax()), rise.shape[1])
        return float(rise[m, end]) - np.log(len(gains)), int(sums[m, : end + 1].argmin()), end

    def _gains(self, s: str) -> np.ndarray:
        codes = np.frombuffer(("\0" + s).encode(), np.uint8)
        return self.gains[:, codes[:-1], codes[1:]]

    def _weak(self, gains: np.ndarray) -> bool:
        return float(gains.sum(1).max()) - np.log(len(gains)) <= self.threshold / 2

    def segments(self, s: str) -> list[tuple[int, int]]:
        """The random parts of s: the stretch with the highest sum of ratios if that exceeds part, and so
        on to both sides of it, each up to the next sign that is no letter or digit if that is random as
        a whole, without words at its ends; MIN_RUN long at least. Failing that, all of s if it is random as a whole. Long ones are read in overlapping
        pieces, so time grows with the length."""
        if len(s) < MIN_RUN:
            return []
        gains, found = self._gains(s), []
        for at in range(0, max(1, len(s) - PIECE), PIECE):
            todo = [(at, min(len(s), at + 2 * PIECE))]
            while todo:
                i, z = todo.pop()
                if i >= z:
                    continue
                score, a, b = self._best(gains[:, i:z])
                if score > self.part:
                    found.append((i + a, i + b))
                    todo += [(i, i + a), (i + b, z)]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                a, b = merged[-1][0], max(b, merged.pop()[1])
            merged.append((a, b))
        out: list[tuple[int, int]] = []
        for i, z in merged:
            a, b = max(s.rfind(c, 0, i) + 1 for c in SIGNS), m.start() if (m := _SIGN.search(s, z)) else len(s)
            while (k := min((k for c in SIGNS if (k := s.find(c, a, b)) >= 0), default=-1)) >= 0 and b - k - 1 >= MIN_RUN and self._weak(gains[:, a : k + 1]):
                a = k + 1
            while (k := max(s.rfind(c, a, b) for c in SIGNS)) >= 0 and k - a >= MIN_RUN and self._weak(gains[:, k:b]):
                b = k
            if b - a < MIN_RUN or not self(s[a:b]):  # words without a sign between
                a, b = i, z
            if out and a <= out[-1][1]:
                a, b = out[-1][0], max(b, out.pop()[1])
            if b - a >= MIN_RUN:
                out.append((a, b))
        return out or ([(0, len(s))] if self(s) else [])


@cache
def detector() -> Detector:
    return Detector(*labelled_samples())


def spans(text: str | None, judge: Detector | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, in code points, sorted. Base matches are found
    leftmost and not overlapping within a kind; what the models call random in a run, beside
    them, is added."""
    if not text:
        return []
    judge = judge or detector()
    found, short = [], []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    assigned = list(found)
    for run in RUN.finditer(text):
        a, s = run.start(), run[0]
        if len(s) < LONG_RUN and not assigned:
            short.append((a, run.end()))
            continue
        base = [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= 20] if "AKIA" in s else []
        base += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(s) if m.end() - m.start() >= 24]
        found += base
        taken = sorted((max(a, x), min(run.end(), z)) for x, _, z in [*assigned, *base] if x < run.end() and a < z)
        at = a
        for x, z in [*taken, (run.end(), run.end())]:
            if x - at >= LONG_RUN:
                found += [(at + i, 3, at + k) for i, k in judge.segments(s[at - a : x - a])]
            elif x - at >= MIN_RUN:
                short.append((at, x))
            at = max(at, z)
    return sorted(found + [(i, 3, k) for i, k in judge.random_ones(text, short)])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    join = lambda f: ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in f)
    for b in batches:
        found = [spans(t.as_py()) for t in b.column(1)]
        base = [[x for x in f if x[1] < 3] for f in found]
        count = [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(3)]
        sha = pa.array([hashlib.sha256(join(f).encode()).hexdigest() for f in base])
        yield pa.RecordBatch.from_arrays([b.column(0), *count, sha, pa.array([join(f) for f in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Row by row, so repeated rows repeat and no shuffle is needed. A null text is empty: counts of 0,
    no spans. A long text is read whole, its runs in pieces. Spans that begin together go by kind.
    Empty tables give no rows; other columns are not read, whatever their names."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow(docs, "doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets over documents, all rows and whole texts."""
    return find_secrets(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_secrets finds by the three rules alone."""
    return op1_secrets(spark, sf_dir).drop("spans")


#: Beginnings are what stands between the matches of a rule, added up.
BASE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as t from documents),
p as (select 0 as k, 'assign' as kind, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' as pat
      union all select 1, 'access', '(AKIA[A-Z0-9]+)' union all select 2, 'hex', '([0-9a-f]{24,})'),
m as (select doc_id, k, kind, unnest(regexp_extract_all(t, pat)) as found, unnest(regexp_extract_all(t, pat, 1)) as own,
             unnest(list_slice(regexp_split_to_array(t, pat), 1, len(regexp_extract_all(t, pat)))) as before, unnest(range(1, len(regexp_extract_all(t, pat)) + 1)) as i
      from t, p where regexp_matches(t, pat)),
s as (select doc_id, k, kind, found, own, sum(len(before) + len(found)) over (partition by doc_id, k order by i) as z from m),
g as (select doc_id, k, kind, z - len(found) as a, z from s where len(own) >= case k when 0 then 6 when 1 then 20 else 24 end),
n as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
             string_agg(kind || ':' || a || ':' || z, ',' order by a, k) as line from g group by doc_id)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(line, '')) as base_sha256 from t left join n using (doc_id)
"""
