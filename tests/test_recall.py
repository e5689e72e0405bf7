"""Recall of approximate blocking against brute force."""

import itertools
import random

import numpy as np

from linkspark.operators import blocking
from linkspark.plans.queries import QUERIES


def test_minhash_lsh_recall(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(300):  # pairs of 40 words, 30 of them shared: Jaccard 0.6
        words = [f"w{k}x{x}" for x in range(50)]
        for i, own in enumerate((words[:40], words[10:])):
            rng.shuffle(own)
            rows.append((2 * k + i, " ".join(own)))
    rows += [(1000, None), (1001, " \n"), (1002, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [(i, set((t or "").split())) for i, t in rows]
    truth = {(i, j) for (i, x), (j, y) in itertools.combinations(sets, 2) if x & y and len(x & y) / len(x | y) >= 0.5}
    got = [(r.i, r.j) for r in QUERIES["b11_minhash_lsh"](spark, str(tmp_path)).collect()]
    assert len(truth) == 300 and len(got) == len(set(got)) and set(got) <= truth
    assert len(got) >= 0.8 * len(truth)  # 25 bands of 5 rows find 87%


def test_ann_recall_and_candidates(spark):
    """Recall on vectors that have hardly any structure, and few candidates where there are near ones."""
    rng = np.random.default_rng(4)
    plain = rng.normal(size=(300, 64))
    centres = rng.normal(size=(60, 64))
    grouped = np.repeat(centres, 10, 0) + 0.05 * rng.normal(size=(600, 64))
    for x, projections, most in ((plain, 4, 1.0), (grouped, 20, 0.1)):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T
        np.fill_diagonal(near, -2)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, item array<double>")
        met = {(r.i, r.j) for r in blocking.ann_candidates(rows, rows=projections).collect()}
        want = [(i, int(j)) for i, js in enumerate(np.argsort(-near, 1)[:, :5]) for j in js]
        assert sum(p in met for p in want) >= 0.9 * len(want)
        assert len(met) <= most * len(x) * (len(x) - 1)


def test_minhash_hands_few_rows_to_python(spark, monkeypatch):
    """A task's memory doesn't grow with the rows of its part of the table."""
    plain = blocking._signatures

    def watched(batches, coefficients):
        def few():
            for batch in batches:
                assert batch.num_rows <= 512
                yield batch

        return plain(few(), coefficients)

    monkeypatch.setattr(blocking, "_signatures", watched)
    docs = spark.range(0, 1500, 1, 1).selectExpr("id", "concat('a b c d ', id div 2) as item")
    got = {(r.i, r.j) for r in blocking.minhash_lsh_blocking(0.5, 128)(docs).filter("i < 20 and j < 20").collect()}
    assert all((i, i + 1) in got for i in range(0, 20, 2))
