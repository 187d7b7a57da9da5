"""Insults whose letters are set apart reach the threshold, and the pipeline drops them."""

import random

import numpy as np

from lumenledger.llm import toxicity


def test_gapped_insults_reach_the_threshold(spark):
    rng = random.Random(4)
    plain = ["the", "river", "walks", "under", "stone", "bridge", "and", "light", "moves", "idle", "riot", "close", "more"]
    texts, toxic = [], []
    for k in range(400):
        w = rng.choices(plain, k=60)
        if k % 4 == 0:
            w[rng.randrange(60)] = rng.choice(["idiot", "moron", "loser"])
        texts.append(" ".join(w).encode())
        toxic.append(k % 4 == 0)
    machine = toxicity.fit(texts, np.array(toxic))
    bad = ["i d i o t", "i-d-i-o-t", "i. d. i. o. t", "id--iot", "i-diot", "m o r o n", "L-O-S-E-R"]
    good = ["the river", "r i v e r", "a b c d e", "well-known bridge", "x = y + z - w", None, "", "--"]
    rows = [(i, t and f"the {t} walks under stone") for i, t in enumerate(bad + good)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in toxicity.score(df, machine).where(f"score >= {toxicity.THRESHOLD}").collect()}
    assert found == set(range(len(bad)))
    assert {r.doc_id for r in toxicity.without_toxic(df, machine).collect()} == {i for i, _ in rows} - found
