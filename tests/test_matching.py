"""Goldens, brute force on small random inputs, and error contracts of the matching operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.frames import Edges, MissingPackage, Registry, require
from linkspark.functions import similarity as sim
from linkspark.functions.text import char_ngrams
from linkspark.operators import blocking, clustering, features, kernels, matching, review, skew, vectors
from linkspark.plans import api, queries


def items(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, item string")


def edges(spark, rows, sense="maximize", **kw):
    return Edges(spark.createDataFrame([(i, j, float(s)) for i, j, s in rows], "i long, j long, score double"), sense, **kw)


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols or ("i", "j")) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ngrams_and_tfidf(spark):
    # fixed values: the documented n-grams and TF-IDF matrix
    assert one(spark, char_ngrams(F.lit("cat"), 2, 3)) == [" c", "ca", "at", "t ", " ca", "cat", "at "]
    assert one(spark, char_ngrams(F.lit(""), 3, 4)) == ["  "]
    keys, values = items(spark, ["apple pie", "apple crumble", "banana split"]), items(spark, ["american pie", "big apple", "american girl", "banana republic"])
    got = {(r.i, r.j): round(r.score, 2) for r in api.similarity_matrix(keys, values, dense=True).collect()}
    want = [[0.32, 0.42, 0.01, 0], [0.04, 0.35, 0.01, 0.02], [0.03, 0.04, 0.02, 0.44]]
    assert got == {(i, j): want[i][j] for i in range(3) for j in range(4)}
    with pytest.raises(RuntimeError):
        features.TfIdf().transform(keys)


def test_comparators(spark):
    lit = F.lit
    # fixed values: textbook pairs and their documented results
    assert one(spark, sim.levenshtein_distance()(lit("kitten"), lit("sitting"))) == 3
    assert one(spark, sim.levenshtein()(lit("jon"), lit("john"))) == 0.75
    me = sim.monge_elkan()
    assert one(spark, me(lit("john smith"), lit("smith"))) != one(spark, me(lit("smith"), lit("john smith")))
    assert one(spark, sim.jaro_winkler()(lit("martha"), lit("marhta"))) == pytest.approx(0.9611, abs=1e-4)
    assert one(spark, sim.ratio()(lit("tide"), lit("diet"))) == 0.25
    vec = lambda *x: F.array(*map(lit, x))
    cos = sim.cosine()
    assert one(spark, cos(vec(1e200, 1e200), vec(1e200, 1e200))) == pytest.approx(1)
    assert one(spark, cos(vec(0.0, 0.0), vec(1.0, 0.0))) == 0
    with pytest.raises(Exception, match="different length"):
        one(spark, cos(vec(1.0), vec(1.0, 0.0)))
    point = lambda a, b: F.struct(lit(a).alias("lat"), lit(b).alias("lon"))
    assert one(spark, sim.haversine()(point(0.0, 0.0), point(0.0, 1.0))) == pytest.approx(111.195, abs=0.01)
    assert one(spark, sim.linear_decay(10)(lit(0.0), lit(100.0))) == 0
    with pytest.raises(ValueError):
        sim.exp_decay(0)
    s = {"name": lit(1.0), "city": lit(1.0)}
    assert one(spark, sim.fellegi_sunter(s, {"name": 0.9, "city": 0.8}, {"name": 0.1, "city": 0.2})) == pytest.approx(math.log(9) + math.log(4))
    with pytest.raises(KeyError, match="city"):
        sim.fellegi_sunter(s, {"name": 0.9}, {"name": 0.1})


def test_registry():
    r = Registry("thing")
    r.add("a")(lambda x=1: lambda: x)
    assert r.resolve("a", x=3)() == 3 and r.names() == ["a"]
    with pytest.raises(KeyError, match="there are a"):
        r.resolve("b")
    with pytest.raises(TypeError):
        r.resolve(lambda: 1, x=2)
    with pytest.raises(MissingPackage):
        require("no_such_package_here", "a test")


def test_blocking(spark):
    rng = random.Random(12)
    left, right = ([rng.choice("xyzXY") + rng.choice("mno") for _ in range(9)] for _ in range(2))
    a, b = items(spark, left), items(spark, right)
    both = [(i, j) for i in range(9) for j in range(9)]
    assert found(blocking.first_chars_blocker()(a, b)) == [(i, j) for i, j in both if left[i][0].lower() == right[j][0].lower()]
    assert found(blocking.key_blocking()(a, b)) == [(i, j) for i, j in both if left[i].lower() == right[j].lower()]
    assert set(found(blocking.sorted_neighborhood(2)(items(spark, ["q", "e", "k", "b"])))) == {(1, 3), (1, 2), (0, 2)}
    pairs = lambda *x: spark.createDataFrame(x, "i long, j long")
    m = blocking.blocking_metrics(pairs((0, 4), (3, 1), (2, 2), (1, 0)), pairs((0, 4), (3, 1), (2, 3), (4, 4)), 5, 5).first()
    assert [round(x, 4) for x in m] == [0.5, 0.84, 0.5, 4]
    many = [(0, j) for j in range(5)] + [(i, 9) for i in range(1, 6)] + [(7, 7), (8, 6)]
    assert found(blocking.prune_frequent(pairs(*many), 3)) == [(7, 7), (8, 6)]
    with pytest.raises(Exception, match="isn't there"):
        blocking.score_candidates(a, b, pairs((0, 99)), sim.levenshtein()).df.collect()


def brute(rows, sense):
    best = None
    for k in range(len(rows), -1, -1):
        for part in itertools.combinations(rows, k):
            if len({r[0] for r in part}) == len({r[1] for r in part}) == k:
                total = sum(r[2] for r in part)
                if best is None or (total > best if sense == "maximize" else total < best):
                    best = total
        if best is not None:
            return k, best


def test_kernel_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        rows = [(i, j, rng.uniform(-50, 100)) for i in range(n) for j in range(m) if rng.random() < 0.6]
        if not rows:
            continue
        i, j, c = map(np.array, zip(*rows, strict=True))
        got = kernels.match_edges(i, j, c)
        k, total = brute(rows, "minimize")
        assert len(got) == k and sum(c[got]) == pytest.approx(total)


def test_matchers(spark):
    rng = random.Random(21)
    for sense in ("maximize", "minimize"):
        rows = [(i, j, rng.randint(-30, 60)) for i in range(5) for j in range(4) if rng.random() < 0.7]
        got = {r.i: (r.j, r.score) for r in matching.optimal()(edges(spark, rows, sense)).collect()}
        assert (len(got), sum(s for _, s in got.values())) == pytest.approx(brute(rows, sense))
        pairs = set(found(matching.stable()(edges(spark, rows, sense))))
        better = (lambda x, y: x > y) if sense == "maximize" else (lambda x, y: x < y)
        score, of_row, of_col = {(i, j): s for i, j, s in rows}, dict(pairs), {j: i for i, j in pairs}
        assert len(of_row) == len(of_col) == len(pairs)
        for i, j, s in rows:  # no two prefer each other to what they have
            assert (i in of_row and not better(s, score[i, of_row[i]])) or (j in of_col and not better(s, score[of_col[j], j]))
    with pytest.raises(ValueError):
        Edges.coerce(edges(spark, [(0, 0, 1)], "minimize"), "maximize")
    with pytest.raises(ValueError):
        matching.soft_match(edges(spark, [(0, 0, 1)]), reg=0)
    # fixed values: the documented example of matching in key order
    keys, values = items(spark, ["apple", "banana", "carrot"]), items(spark, ["car", "app", "carob", "cabana"])
    assert found(api.match_greedily(keys, values), "key", "value") == [("apple", "app"), ("banana", "cabana"), ("carrot", "carob")]


def test_greedy_equals_sequential(spark):
    rng = random.Random(8)
    rows = [(i, j, rng.randint(0, 9)) for i in range(12) for j in range(12) if rng.random() < 0.4]
    want, ri, rj = [], set(), set()
    for i, j, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if i not in ri and j not in rj:
            want.append((i, j))
            ri.add(i)
            rj.add(j)
    assert found(matching.greedy()(edges(spark, rows))) == sorted(want)


def test_clusters(spark):
    pairs = lambda *x: spark.createDataFrame(x, "i long, j long, score double")
    labels = lambda df: [r.cluster_id for r in df.orderBy("item").collect()]
    cc, pivot = clustering.connected_components(), clustering.correlation_clustering()
    assert labels(cc(pairs((1, 3, 0.7), (3, 4, 0.6), (0, 2, 0.1)), 5, 0.55)) == [0, 1, 2, 1, 1]
    with pytest.raises(ValueError):
        cc(pairs((2, 6, 1.0)), 4)
    rng = random.Random(4)
    rows = [(i, j, 1.0) for i in range(20) for j in range(i + 1, 20) if rng.random() < 0.15]
    head, near = {}, {k: {b if a == k else a for a, b, _ in rows if k in (a, b)} for k in range(20)}
    for k in range(20):
        if k not in head:
            head[k] = k
            for x in near[k]:
                head.setdefault(x, k)
    order = sorted(set(head.values()))
    assert labels(pivot(pairs(*rows), 20, 0.5)) == [order.index(head[k]) for k in range(20)]
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "item long, cluster_id long")
    boats = spark.createDataFrame([(0, None, 7), (1, "Petrel", 4), (2, "Petrel", 7)], "item long, name string, crew int")
    for policy, want in (("first", (None, 7)), ("most_complete", ("Petrel", 4)), ("majority", ("Petrel", 7))):
        r = clustering.canonicalize(part, boats, policy).first()
        assert (r["name"], r["crew"]) == want
    noise = [(float(rng.random() < p), float(rng.random() < q)) for p, q, n in ((0.95, 0.9, 40), (0.05, 0.2, 160)) for _ in range(n)]
    em = clustering.estimate_mu_em(spark.createDataFrame(noise, "a double, b double"), ["a", "b"])
    assert all(em["m"][f] > em["u"][f] + 0.4 for f in "ab")


def test_facades(spark):
    names = ["Ada Quill", "Bo Stern", "Ada Quil", "Cy Marsh", "Bo Sterne"]
    assert [r.cluster_id for r in api.dedupe(items(spark, names), threshold=0.7).orderBy("item").collect()] == [0, 1, 0, 2, 1]
    part = api.dedupe(items(spark, ["pine", "fir", "pint", "oak"]), compare="levenshtein_distance", threshold=1)
    assert [r.cluster_id for r in part.orderBy("item").collect()] == [0, 1, 0, 2]
    left, right = ["red lantern", "blue kettle", "green ladder"], ["green laddder", "red lanten", "blue kettles"]
    assert found(api.match(items(spark, left), items(spark, right))) == [(0, 1), (1, 2), (2, 0)]
    with pytest.raises(ValueError):
        api.match(items(spark, ["a"]), None)


def test_review(spark):
    rng = random.Random(17)
    dense = [[rng.randint(0, 99) / 100 for _ in range(5)] for _ in range(4)]
    store = review.CandidateStore.from_scores(edges(spark, [(i, j, dense[i][j]) for i in range(4) for j in range(5)]))
    assert found(store.top(1)) == [(i, max(range(5), key=lambda j: (dense[i][j], -j))) for i in range(4)]
    gaps = [sorted(x)[-1] - sorted(x)[-2] for x in dense]
    assert review.review_queue(store).first().i == min(range(4), key=lambda i: (gaps[i], i))
    nan = review.CandidateStore.from_scores(edges(spark, [(3, 5, float("nan")), (3, 1, 0.2), (3, 0, 0.2)]))
    assert [r.j for r in nan.df.orderBy("rank").collect()] == [0, 1, 5]


def assignments(cost):
    """Every complete assignment of the smaller side over finite cells, with its cost."""
    n, m = cost.shape
    ways = ([*zip(range(n), p, strict=True)] for p in itertools.permutations(range(m), n)) if n <= m else ([*zip(p, range(m), strict=True)] for p in itertools.permutations(range(n), m))
    return sorted(((sum(cost[i, j] for i, j in way), dict(way)) for way in ways if all(np.isfinite(cost[i, j]) for i, j in way)), key=lambda x: x[0])


def test_k_best_against_all_assignments():
    rng = np.random.default_rng(3)
    for _ in range(150):
        cost = np.where(rng.random((n := rng.integers(1, 5), m := rng.integers(1, 5))) < 0.15, np.inf, rng.integers(0, 30, (n, m)).astype(float))
        want, got = assignments(cost), kernels.k_best(cost, 7)
        assert [t for _, t in got] == [t for t, _ in want[:7]]
        assert len({tuple(sorted(a.items())) for a, _ in got}) == len(got)


def test_reoptimize_against_all_assignments(spark):
    rng = np.random.default_rng(9)
    for n, m in ((2, 2), (3, 2), (2, 3), (3, 3)):
        for _ in range(3):
            score = rng.integers(0, 50, (n, m)).astype(float)
            no = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.45]
            yes = [(i, j) for i in range(n) for j in range(m) if (i, j) not in no][:1]
            cost = -score
            for i, j in no:
                cost[i, j] = np.inf
            want = [x for x in assignments(cost) if all(x[1].get(i) == j for i, j in yes)]
            log = review.Constraints()
            for i, j in no:
                log = log.reject(i, j)
            for i, j in yes:
                log = log.confirm(i, j)
            full = edges(spark, [(i, j, score[i, j]) for i in range(n) for j in range(m)])
            if not want:
                with pytest.raises(ValueError):
                    review.reoptimize(full, log)
            else:
                got = review.reoptimize(full, log).collect()
                assert sum(r.score for r in got) == -want[0][0] and not {(r.i, r.j) for r in got} & set(no)
    few = edges(spark, [(0, 0, 0.4), (1, 0, 0.3)], n_a=2, n_b=2)
    assert found(review.reoptimize(few, review.Constraints().confirm(1, 1))) == [(0, 0), (1, 1)]


def test_featurizers_of_ones_own(spark):
    a = items(spark, ["a b", "a a a", "b b c"])
    counts = lambda df: df.select("id", F.array(*[(F.length("item") - F.length(F.replace("item", F.lit(x), F.lit("")))).cast("double") for x in "abc"]).alias("vec"))
    got = {(r.i, r.j): r.score for r in api.score(a, None, featurize=counts).df.collect()}
    vec = [[1, 1, 0], [3, 0, 0], [0, 2, 1]]
    assert got == {(i, j): pytest.approx(np.dot(vec[i], vec[j]) / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j])) for i in range(3) for j in range(i + 1, 3)}
    assert found(api.match(a, a, featurize=counts)) == [(0, 0), (1, 1), (2, 2)]


def test_soft_match_marginals(spark):
    e = edges(spark, [(0, 0, 0.9), (0, 1, 0.2), (1, 0, 0.3), (1, 1, 0.8)], n_a=2, n_b=2)
    mass = lambda *x: spark.createDataFrame(list(enumerate(map(float, x))), "id long, mass double")
    plan = {(r.i, r.j): r.mass for r in matching.soft_match(e, a=mass(3, 1), b=mass(1, 1)).collect()}
    assert plan[0, 0] + plan[0, 1] == pytest.approx(0.75, abs=1e-6) and plan[0, 0] + plan[1, 0] == pytest.approx(0.5, abs=1e-6)
    with pytest.raises(Exception, match="too large"):
        matching.soft_match(e, max_cells=3).collect()


def test_join_blocks(spark, tmp_path):
    """Pairs of few keys are dealt out over many tasks, each once."""
    left = spark.createDataFrame([(k, i) for i in range(90) for k in ("a", "b", None)] + [("c", 1), ("d", 2)], "k string, i long")
    right = spark.createDataFrame([("a", j) for j in range(70)] + [("c", 5), ("c", 6), (None, 7)], "k string, j long")
    got = skew.join_blocks(left, right, ["k"], side=8)
    assert sorted((r.k, r.i, r.j) for r in got.collect()) == sorted((r.k, r.i, r.j) for r in left.join(right, "k").collect())
    people = [(i, f"Customer#{i:09d}", 1, float(i), "BUILDING") for i in range(2600)]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    pairs = queries.customer_scores(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in pairs) == 2600 * 2599 // 2 and max(r["count"] for r in pairs) <= 0.8 * sum(r["count"] for r in pairs)


def _odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)], int(i % 3)) for i in range(90)]
    rows += [(i + 100, rows[4][1], 1) for i in range(12)] + [(200, [0.0] * 6, 1), (201, [1e200] * 6, 1), (202, [0.5] * 6, None)]
    return spark.createDataFrame(rows, "id long, item array<double>, label int")


def test_vectors_in_blocks(spark, monkeypatch):
    """Scores of pairs and neighbours in blocks are those of the expressions, with ties, zero and huge vectors; pairs are dealt over many tasks."""
    for name, value in (("LEAST", 16), ("SLICE", 64), ("_AGAIN", 7)):
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors._dealt, "__defaults__", (16,))
    v = _odd_vectors(spark)
    a, b = v.selectExpr("id as i", "item as x", "label"), v.selectExpr("id as j", "item as y", "label")
    pairs = a.join(b, "label").filter("i < j")
    for metric in vectors.METRICS:
        want = pairs.select("i", "j", F.round(sim.comparators.resolve(metric)(F.col("x"), F.col("y")), 6).alias("score"))
        got = vectors.scored_within(v, "label", metric)
        assert found(got, "i", "j", "score") == found(want, "i", "j", "score")
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    for other in (None, v.filter("id % 2 = 0").withColumn("id", F.col("id") + 1000)):
        plain = blocking.brute_knn_blocking(3, sim.cosine())(v, other)
        assert found(blocking.brute_knn_blocking(3)(v, other)) == found(plain)
    results = []
    for sparse in (0, 1 << 40):
        monkeypatch.setattr(blocking, "SPARSE", sparse)
        results.append(found(blocking.ann_blocking(3)(v)))
    assert results[0] == results[1]


def test_key_blocking_without_all_pairs(spark):
    """Pruning before pairing is pruning after; pairs of single keys are not made distinct."""
    rng = random.Random(7)
    a, b = (spark.createDataFrame([(i, "".join(rng.choices("abcdefghijkl", k=rng.randrange(0, 4)))) for i in range(60)] + [(3, "a")], "id long, item string") for _ in range(2))
    keys = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    pairs = blocking.key_blocking(keys)(a, b)
    rows = [[(r.id, set(r.item)) for r in x.collect()] for x in (a, b)]
    want = sorted({(i, j) for i, x in rows[0] for j, y in rows[1] if x & y})
    assert found(pairs) == want
    for most in (3, 9, 14, 20):
        assert found(blocking.key_blocking_pruned(keys, most)(a, b)) == found(blocking.prune_frequent(pairs, most))
    assert found(blocking.key_blocking(keys)(a)) == sorted({(i, j) for i, x in rows[0] for j, y in rows[0] if x & y and i < j})
    plain = blocking.key_blocking(F.array)(a.filter("id <> 3"), b.filter("id <> 3"))
    assert not any(x.strip(" +-:").startswith("Aggregate [i#") and "j#" in x for x in plain._jdf.queryExecution().optimizedPlan().toString().splitlines())
