"""What chunk deduplication finds of short passages that unlike documents share."""

import random

from linkspark.llm import chunks


def test_short_shared_passage(spark):
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, sizes = [], {}
    for k in range(0, 600, 2):
        passage = make(52)
        sizes[k + 1] = len(passage)
        rows += [(k, f"{make(rng.randint(20, 90))} {passage} {make(rng.randint(20, 90))}"), (k + 1, f"{make(rng.randint(20, 90))} {passage} {make(rng.randint(20, 90))}")]
    cut = {r.doc_id: r.n_removed for r in chunks.dedupe_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(cut[k - 1] for k in sizes)  # the first of each pair stays whole
    assert sum(cut[k] > 0 for k in sizes) >= 0.95 * len(sizes)
    assert sum(cut[k] / sizes[k] for k in sizes) >= 0.58 * len(sizes)
