"""A small table with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward(seed=1):
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, odd spaces."""
    rng = random.Random(seed)
    passage, long = prose(rng, 60), prose(rng, 9000)
    texts = ["", None, "one", "One", "ONE", " \t\r\n\v\f", prose(rng, 12), prose(rng, 13), long, long.upper(), "É é É", "x " * 400, "x " * 300, " sep nbsp", passage]
    texts += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 20) for _ in range(6)]
    base = prose(rng, 300).split()
    for k in range(8):
        near = list(base)
        near[37 * k % 300] = "changed"
        texts.append(" ".join(near))
    texts += [t for t in texts[-3:]]
    return [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, "one"), (None, passage)]


def clashing(spark, rows, schema="doc_id bigint, text string", source="'src' || (doc_id % 3)"):
    """The rows with more columns, of names that operators use themselves."""
    names = "fp rep node component component_id sha rest parent n last row h shard doc of known covers score kept keep_id group_size block copies weight tokens n_tokens label hot version mix_pass p_source p_block pass"
    return spark.createDataFrame(rows, schema).selectExpr("*", f"{source} as source", "'en' as lang", "length(text) as n_chars", *[f"'clash' as {n}" for n in names.split()])
