"""Each stage of the pipeline on its own input, against plain versions."""

import random
import zlib

import pytest

import corpus_pipeline as P
from lodestone.llm import toxicity as T

from .helpers import awkward, clashing, prose
from .test_dedup import exact_brute, fingerprint, linked
from .test_texts import hits_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark."""
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(21)
    bench = [(k, prose(rng, 25)) for k in range(5)]
    rows = awkward()
    ids = iter(range(1000, 5000))
    for _ in range(260):
        i, ws = next(ids), prose(rng, 50).split()
        if i % 4 == 0:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["scoundrel", "nitwit"]))
        rows.append((i, " ".join(ws)))
    rows += [(next(ids), prose(rng, 20) + " " + bench[0][1].upper()), (next(ids), bench[1][1])]
    clashing(spark, rows).select(COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows if i and i >= 1000 and zlib.crc32(str(i).encode()) % 5], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, bench


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def brute(rows, keep):
    return sorted((i is None, i or 0, t or "") for i, t in rows if keep(i, t))


def test_stages(spark, corpus):
    d, rows, bench = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash", "decontaminate", "mix"]

    out = stages["toxicity"](spark, docs, d)
    assert out.columns == COLUMNS
    model = T.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    expected = brute(rows, lambda i, t: model.score(t) < 0.5)
    assert kept(out) == expected and len(expected) < len(rows) - 50

    verdict = {(r[0], r[4]): r[3] for r in exact_brute(rows)}
    import hashlib
    import re

    sha = lambda t: hashlib.sha256(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()).hexdigest()
    assert kept(stages["exact_dedup"](spark, docs, d)) == brute(rows, lambda i, t: i is None or verdict[i, sha(t)])

    named = [(i, t) for i, t in rows if i is not None]
    root = linked([fingerprint(t) for _, t in named])
    first = {i: named[k][0] for (i, _), k in zip(named, root, strict=True)}
    assert kept(stages["simhash"](spark, docs, d)) == brute(rows, lambda i, t: i is None or first[i] == i)

    clean = lambda i, t: not hits_brute(t, bench)[4]
    assert kept(stages["decontaminate"](spark, docs, d)) == brute(rows, clean)
    assert not all(clean(i, t) for i, t in rows)

    mixed = stages["mix"](spark, docs, d)
    assert mixed.columns == [*COLUMNS, "mix_pass", "mix_place"] and mixed.count() > 0


def test_rows_are_judged_not_ids(spark, corpus):
    """One doc_id on several texts."""
    d, _, bench = corpus
    rng = random.Random(30)
    near = prose(rng, 300).split()
    other = " ".join(near[:150] + ["changed"] + near[151:])
    while linked([fingerprint(" ".join(near)), fingerprint(other)]) != [0, 0]:
        near = prose(rng, 600).split()
        other = " ".join(near[:150] + ["changed"] + near[151:])
    near, far = " ".join(near), prose(rng, 300)
    rows = [(1, "same"), (2, "same"), (1, "only here"), (1, "Same"), (None, "same"), (2, None), (3, ""), (4, near), (5, other), (5, far), (6, near), (6, other), (6, far + " more"), (7, bench[0][1]), (7, "clean text"), (None, bench[1][1])]
    docs = clashing(spark, rows).select(COLUMNS)
    verdict = {(r[0], r[4]): r[3] for r in exact_brute(rows)}
    expected = sorted((i is None, i or 0, t or "") for (i, t) in rows if i is None or verdict[i, exact_brute([(i, t)])[0][4]])
    assert kept(P.drop_copies(spark, docs, d)) == expected and (False, 1, "only here") in expected
    got = P.drop_near_copies(spark, docs, d).collect()
    texts = [(r.doc_id, r.text) for r in got]
    assert (4, near) in texts and not any(t in (near, other) and i != 4 for i, t in texts) and any(i == 5 and t == far for i, t in texts)
    two = P.drop_near_copies(spark, docs.where("doc_id = 6"), d).collect()
    assert len({r.text for r in two if r.text in (near, other)}) == 1  # of one id's near copies one stays
    clean = sorted((i is None, i or 0, t or "") for i, t in rows if not hits_brute(t, bench)[4])
    assert kept(P.drop_contaminated(spark, docs, d)) == clean and (False, 7, "clean text") in clean


def test_run(spark, corpus):
    d, rows, bench = corpus
    got = P.run(spark, d).collect()
    texts = {r.text for r in got}
    assert texts and not any("scoundrel" in (t or "") for t in texts) and bench[1][1] not in texts


def test_registered():
    import __spark_entry__

    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {x.split("_")[0] for x in __spark_entry__.queries()}


def test_stages_take_empty_tables(spark, corpus):
    d, *_ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_copies_are_never_broadcast(spark, corpus):
    """The files of copies are small, as their keys repeat; their rows are not."""
    d, _, _ = corpus
    copies = spark.createDataFrame([(k, f"one two three {k % 3}") for k in range(3000)], "doc_id long, text string")
    for stage in (P.drop_copies, P.drop_near_copies):
        out = stage(spark, copies, d)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == len({r.text for r in out.collect()}) <= 3
