"""Toxicity: Levenshtein automata over a learned lexicon's trie, and context windows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, narrow, table, written

FOLDS = 5
#: Labelled rows that the lexicon and the weights are learned from, at most.
MAX_TRAIN = 8000
#: Tasks that learn from these.
LEARNERS = 16
#: Log odds of a term of weight 1.
FULL_WEIGHT = 6.0
#: What a misspelled term counts against one spelled out.
MISSPELLED = 0.7
#: Words to each side of a term that count as its context.
CONTEXT = 6
WORD = re.compile(r"\w[\w@$]*\w|\w")
_LEET = str.maketrans("013457@$", "oieastas")
#: Quotation marks; single ones only beside a word, as between letters they are apostrophes.
_QUOTES = re.compile(r"[\"“”„«»‹›]|(?<!\w)['‘’]|['‘’](?!\w)")
#: Words that report speech or name a word as a word, and words that address somebody.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word words term slur insult insults reported reports dit disait écrit mot insulte dijo dice escribió palabra insulto sagte schrieb nannte wort beleidigung".split())
ADDRESS = frozenset("you your youre yours u ur tu te toi vous ton ta du dich dir dein ihr euch usted ustedes tú".split())
#: Lengths of the beginnings that may stand for a family of words.
STEMS = range(4, 9)


def edits(term: str) -> int:
    """Edits in which a misspelling may differ; short words have too many neighbours for any."""
    return 0 if len(term) < 6 else 1 if len(term) < 10 else 2


def slips(term: str) -> int:
    """Edits, a swap of neighbours among them, in which a misspelling of a learned term may differ."""
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


#: Letters of a learned term from which its first letter may be edited too.
FIRST_EDITED = 5
#: States of the automata that are kept; beyond, they are made anew.
MAX_STATES = 60_000


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    term: str | None = None
    stem: str | None = None
    most: int = 0  # edits that some term below allows
    free: bool = False  # whether some term below allows its first letter to be edited


class Lexicon:
    """Weighted terms, some of them beginnings of words (written with a final *), as a trie, intersected with
    the Levenshtein automaton of whatever word is read.

    A state is the set of (trie node, letter that a swap still owes, edits so far) that the read letters
    can have led to; states and transitions are made when first met, so reading a word costs a lookup a
    letter, and most words end in the empty state after a few. Stems allow no edits. Plain automata
    allow those of edits() and none of the first letter; wide ones those of slips(), swaps, and the
    first letter from FIRST_EDITED letters on."""

    def __init__(self, terms: dict[str, float], exceptions: Iterable[str] = (), wide: bool = False) -> None:
        self.terms, self.exceptions, self.wide = dict(sorted(terms.items())), frozenset(exceptions), wide
        self.root = Node()
        self.most = slips if wide else edits
        for t in self.terms:
            node, allowed, spelled = self.root, 0 if t.endswith("*") else self.most(t), t.rstrip("*")
            free = wide and allowed > 0 and len(t) >= FIRST_EDITED
            for c in spelled:
                node.most, node.free = max(node.most, allowed), node.free or free
                node = node.next.setdefault(c, Node())
            node.most, node.free = max(node.most, allowed), node.free or free
            if t.endswith("*"):
                node.stem = t
            else:
                node.term = t
        self._memo: dict[str, tuple[str, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._sets: list[dict[tuple, tuple[Node, str, int, bool]]] = []
        self._moves: list[dict[str, int]] = []
        self._accepts: list[tuple[str, int] | None] = []
        self._stems: list[str | None] = []
        found: dict[tuple, tuple[Node, str, int, bool]] = {}
        self._put(found, self.root, "", 0, False)
        self._state(found)

    def _put(self, found: dict, node: Node, owed: str, e: int, first: bool) -> None:
        """first: the first letter was edited, so that only terms count that allow it."""
        if e <= node.most and (node.free or not first) and e < found.get((id(node), owed, first), (0, 0, 99))[2]:
            found[id(node), owed, first] = (node, owed, e, first)

    def _state(self, found: dict) -> int:
        todo = list(found.values())
        while todo:  # letters that the word leaves out
            node, owed, e, first = todo.pop()
            if owed or (node is self.root and not self.wide):
                continue
            for child in node.next.values():
                n = len(found)
                at = id(child), "", first or node is self.root
                old = found.get(at)
                self._put(found, child, "", e + 1, at[2])
                if len(found) > n or found.get(at) is not old:
                    todo.append(found[at])
        key = frozenset((*k, x[2]) for k, x in found.items())
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(found)
            self._moves.append({})
            ends = [(e, n.term) for n, owed, e, first in found.values() if n.term and not owed and e <= self.most(n.term) and not (first and len(n.term) < FIRST_EDITED)]
            self._accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
            self._stems.append(next((n.stem for n, owed, e, _ in found.values() if n.stem and e == 0 and not owed), None))
        return self._states[key]

    def _move(self, state: int, c: str) -> int:
        found: dict[tuple, tuple[Node, str, int, bool]] = {}
        for node, owed, e, first in self._sets[state].values():
            if owed:
                if c == owed:
                    self._put(found, node, "", e, first)
                continue
            if c in node.next:
                self._put(found, node.next[c], "", e, first)
            if node is self.root and not self.wide:
                continue
            first = first or node is self.root
            self._put(found, node, "", e + 1, first)
            for letter, child in node.next.items():
                self._put(found, child, "", e + 1, first)
                if self.wide and letter != c and c in child.next:
                    self._put(found, child.next[c], letter, e + 1, first)
        self._moves[state][c] = out = self._state(found)
        return out

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or None. Look-alike digits and signs count as letters."""
        if word in self._memo:
            return self._memo[word]
        if len(self._memo) > 300_000:
            self._memo.clear()
        if len(self._sets) > MAX_STATES:
            self._forget()
        read = word if word.isalpha() else word.translate(_LEET)
        state, stem = 0, None
        for c in read:
            move = self._moves[state].get(c)
            state = self._move(state, c) if move is None else move
            stem = stem or self._stems[state]
            if not self._sets[state]:
                break
        out = self._accepts[state] if self._sets[state] else None
        if stem and (out is None or out[1]):  # nearer than a misspelling
            out = (stem, 0)
        if out and out[1] and word in self.exceptions:
            out = None
        self._memo[word] = out
        return out

    def __reduce__(self) -> tuple:
        return Lexicon, (self.terms, self.exceptions, self.wide)


def quotation(text: str, words: Sequence[re.Match], i: int) -> float:
    """How far the context says that the term that is word i is quoted, 0 to 1: marks on both sides,
    words that report, and no address. The context is CONTEXT words to each side and what stands
    between them."""
    before = text[words[i - CONTEXT - 1].end() if i > CONTEXT else 0 : words[i].start()]
    after = text[words[i].end() : words[i + CONTEXT + 1].start() if i + CONTEXT + 1 < len(words) else len(text)]
    near = {w[0] for w in (*words[max(0, i - CONTEXT) : i], *words[i + 1 : i + CONTEXT + 1])}
    enclosed = len(_QUOTES.findall(before)) % 2 == 1 and bool(_QUOTES.search(after))
    return min(1.0, max(0.0, 0.6 * enclosed + 0.5 * bool(near & REPORTING) - 0.3 * bool(near & ADDRESS)))


def features(text: str | None, lexicon: Lexicon) -> tuple[list[float], list[tuple[str, str, int]]]:
    """What the score is made of, and the (surface, term, edits) of each hit."""
    low = (text or "").lower()
    words = WORD.findall(low)
    hit = {w: m for w in set(words) if (m := lexicon.match(w))}
    abuse = quoted = 0.0
    hits = []
    if hit:
        places = list(WORD.finditer(low))
        for i, m in enumerate(places):
            if at := hit.get(m[0]):
                q = quotation(low, places, i)
                w = lexicon.terms[at[0]] * (MISSPELLED if at[1] else 1)
                quoted += q * w
                abuse += (1 - q) * w
                hits.append((m[0], *at))
    return [log1p(abuse), log1p(100 * abuse / max(1, len(words))), log1p(quoted), float(abuse > 0.5)], hits


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features(text, self.lexicon)[0], strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (term, toxic, clean): in how many texts of a batch a word or stem stands."""
    for b in batches:
        count = {0: Counter(), 1: Counter()}
        for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text.as_py() or "").lower()))
            count[label].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
        terms = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([count[k][t] for t in terms], pa.int64()) for k in (1, 0))], ["term", "toxic", "clean"])


def _contexts(terms: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, label) to distinct (term, label, word before it)."""
        for b in batches:
            seen = set()
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = WORD.findall((text.as_py() or "").lower())
                for before, w in zip(["", *words], words, strict=False):
                    seen.update((t, label, before) for t in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)) if t in terms)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["term", "label", "before"])

    return run


def telling(counts: DataFrame, toxic: int, clean: int, vocabulary: int) -> DataFrame:
    """The rows of counts(term, toxic, clean) that telling_terms keeps, but for rounding."""
    base = toxic / max(1, toxic + clean)
    if not 0 < base < 1:
        return counts.limit(0)
    t, c = F.col("toxic"), F.col("clean")
    n = t + c
    evidence = t * F.log(t / n / base) + F.when(c > 0, c * F.log(c / n / (1 - base))).otherwise(0.0)
    return counts.where((t > 0) & (t >= c)).where(evidence >= log(3 * max(1, vocabulary)) - 1e-6)


def telling_terms(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, vocabulary: int) -> dict[str, tuple[float, float]]:
    """Of (term, toxic, clean) counts the terms that tell toxic texts: their evidence, the log
    likelihood ratio beyond what chance among so many words explains, and their weight, the log of
    the odds that they change, 0 to 1 of the most that counts."""
    base, found = toxic / max(1, toxic + clean), {}
    need = log(3 * max(1, vocabulary))
    for term, t, c in counts:
        if 0 < base < 1 and t and 2 * t >= t + c:
            evidence = t * log(t / (t + c) / base) + (c * log(c / (t + c) / (1 - base)) if c else 0)
            weight = (log((t + 0.5) / (c + 0.5)) - log(base / (1 - base))) / FULL_WEIGHT
            if evidence >= need:
                found[term] = (evidence, min(1.0, weight))
    return found


def choose_terms(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, vocabulary: int) -> dict[str, float]:
    """The lexicon with weights, from counts of a term's contexts: copies of a text repeat a context,
    so they add no evidence. A stem stands for its words if no one of them is most of it; those that
    tell by themselves stay beside it with its weight at least, as stems are not found misspelled."""
    counts = list(counts)
    kept = telling_terms(counts, toxic, clean, vocabulary)
    size = {term: t for term, t, _ in counts}
    words = {k: e for k, e in kept.items() if not k.endswith("*")}
    stems: dict[str, tuple[float, float]] = {}
    for k, e in sorted(kept.items(), key=lambda x: (-x[1][0], -len(x[0]), x[0])):
        s = k[:-1]
        if k.endswith("*") and max((size[w] for w in words if w.startswith(s)), default=0) < 0.5 * size[k] and not any(s.startswith(o) or o.startswith(s) for o in stems):
            stems[s] = e
    words = {w: (e, max([weight, *(stems[s][1] for s in stems if w.startswith(s))])) for w, (e, weight) in words.items()}
    return {t: w for t, (_, w) in [*words.items(), *((s + "*", e) for s, e in stems.items())]}


def _featured(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.as_py(), lexicon) for t in b.column(0)]
            near = [sorted({s for s, _, e in hits if e}) for _, hits in made]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in made], pa.list_(pa.float64())), pa.array(near, pa.list_(pa.string()))], ["label", "x", "near"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method; the bias is not shrunk."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    shrink = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(shrink), a.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from labels(doc_id, toxic) whose fold is not 0 and their texts in docs(doc_id, text).

    Learns from at most max_train labelled ids, the first by a hash of the id, and one text of each, the
    greatest; that sample is small enough to broadcast to the scan. Terms are counted on the executors,
    and those that tell, which evidence alone decides, and a few numbers for each sampled text reach
    the driver. Texts are read whole. Rows with a null id, label or a label other than 0 and 1 are left
    out; of an id's labels the greatest counts. Without toxic and clean rows every score is 0 or so."""
    own = narrow(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(fold("doc_id", FOLDS) != 0)
    sample = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sampled = narrow(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label"))
    texts = written(sampled.select("text", "label").repartition(LEARNERS))  # one scan of docs
    counts = written(texts.mapInArrow(_term_counts, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    vocabulary = counts.count()
    found = [tuple(r) for r in telling(counts, sizes.get(1, 0), sizes.get(0, 0), vocabulary).collect()]
    found = telling_terms(found, sizes.get(1, 0), sizes.get(0, 0), vocabulary)
    seen = texts.mapInArrow(_contexts(frozenset(found)), "term string, label int, before string").distinct()
    seen = [(r.term, r.toxic, r.n - r.toxic) for r in seen.groupBy("term").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()]
    lexicon = Lexicon(choose_terms(seen, sizes.get(1, 0), sizes.get(0, 0), vocabulary), wide=True)
    rows = texts.mapInArrow(_featured(lexicon), "label int, x array<double>, near array<string>").collect()
    clean, toxic = (Counter(s for r in rows if r.label == k for s in r.near) for k in (0, 1))
    lexicon = Lexicon(lexicon.terms, (s for s, n in clean.items() if toxic[s] < 9 * n), wide=True)
    if lexicon.exceptions:  # the weights are for what counts
        rows = texts.mapInArrow(_featured(lexicon), "label int, x array<double>, near array<string>").collect()
    if len({r.label for r in rows}) < 2:
        return Model(lexicon, (1.0, 0.5, 0.1, 1.0), -4.0)
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    weights, bias = fit_logistic(x, y)
    return Model(lexicon, tuple(map(float, weights)), bias)


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def scorer(model: Model) -> Callable[[Column], Column]:
    """The score as a function of a column of texts, for filters that keep other columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts])

    return score


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    held_out: the id's fold is 0, so no label of it was learned from; null for a null id. Scores
    come from whole texts alone, row by row; null and empty texts get the score of a text without
    terms; a long text is held whole. Repeated rows repeat; equal scores need no order; empty tables
    give no rows; other columns are not read, whatever their names."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = narrow(docs, "doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity over documents, by a model learned from labels whose fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
