"""A query for every operator, over the driver's tables, and the same in SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.frames import Edges
from linkspark.functions import similarity as sim
from linkspark.functions import text
from linkspark.operators import blocking, clustering, features, matching, review
from linkspark.operators.skew import join_blocks
from linkspark.operators.vectors import scored_within
from linkspark.plans import api
from linkspark.sources import tables
from linkspark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def nations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("item"))


def regions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("item"))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("item"), "label")


def nation_pairs(s: SparkSession, d: str, compare) -> DataFrame:
    a = nations(s, d)
    pairs = a.select(F.col("id").alias("i"), F.col("item").alias("x")).crossJoin(a.select(F.col("id").alias("j"), F.col("item").alias("y")))  # 25 x 25, a fixed table
    return pairs.select("i", "j", F.round(compare(F.col("x"), F.col("y")), 6).alias("score"))


N = "n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS item FROM nation)"
NN = f"WITH {N} SELECT a.id AS i, b.id AS j, round({{}}, 6) AS score FROM n a, n b"
LEV = "CASE WHEN greatest(length(a.item), length(b.item)) = 0 THEN 1.0 ELSE 1 - levenshtein(a.item, b.item) / greatest(length(a.item), length(b.item)) END"
VV = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS item, label FROM embeddings)"
SAME_LABEL = f"WITH {VV} SELECT a.id AS i, b.id AS j, round({{}}, 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.id < b.id"


def label_pairs(s: SparkSession, d: str, metric: str) -> DataFrame:
    return scored_within(vectors(s, d), "label", metric)


# comparators

for _name, _make, _sql in (
    ("c1_ratio", sim.ratio, None),
    ("c2_levenshtein_distance", sim.levenshtein_distance, NN.format("CAST(levenshtein(a.item, b.item) AS DOUBLE)")),
    ("c3_levenshtein", sim.levenshtein, NN.format(LEV)),
    ("c5_jaro_winkler", sim.jaro_winkler, NN.format("jaro_winkler_similarity(a.item, b.item)")),
    ("c6_phonetic", sim.phonetic, None),
):
    query(_name, _sql)(lambda s, d, make=_make: nation_pairs(s, d, make()))

for _name, _metric, _sql in (
    ("c7_cosine", "cosine", SAME_LABEL.format("list_cosine_similarity(a.item, b.item)")),
    ("c8_dot", "dot", SAME_LABEL.format("list_inner_product(a.item, b.item)")),
    ("c9_angular", "angular", SAME_LABEL.format("acos(greatest(-1, least(1, list_cosine_similarity(a.item, b.item)))) / pi()")),
):
    query(_name, _sql)(lambda s, d, metric=_metric: label_pairs(s, d, metric))

WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


@query("c4_monge_elkan", f"""
WITH p AS (SELECT DISTINCT p_name AS item FROM part), t AS (SELECT item, {WORDS.format('item')} AS w FROM p),
x AS (SELECT a.item AS a, b.item AS b, len(a.w) AS n, unnest(a.w) AS u, b.w AS bw FROM t a, t b),
y AS (SELECT a, b, n, list_max(list_transform(bw, lambda v: 1 - levenshtein(u, v) / greatest(length(u), length(v)))) AS best FROM x)
SELECT a, b, round(sum(best) / any_value(n), 6) AS score FROM y GROUP BY a, b""")
def c4_monge_elkan(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("a")).distinct()
    return p.crossJoin(p.select(F.col("a").alias("b"))).select("a", "b", F.round(sim.monge_elkan()(F.col("a"), F.col("b")), 6).alias("score"))


POINT = "struct_pack(lat := id * 3.0 - 36, lon := (id * 37) % 360 - 180.0)"
HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2))))"
PP = f"WITH {N}, t AS (SELECT id, id * 3.0 - 36 AS lat, (id * 37) % 360 - 180.0 AS lon FROM n) SELECT p.id AS i, q.id AS j, round({{}}, 6) AS score FROM t p, t q"


def _points(s, d, compare):
    p = nations(s, d).select("id", F.struct((F.col("id") * 3.0 - 36).alias("lat"), (F.col("id") * 37 % 360 - 180.0).alias("lon")).alias("at"))
    both = p.select(F.col("id").alias("i"), F.col("at").alias("p")).crossJoin(p.select(F.col("id").alias("j"), F.col("at").alias("q")))
    return both.select("i", "j", F.round(compare(F.col("p"), F.col("q")), 6).alias("score"))


query("c10_haversine", PP.format(HAV))(lambda s, d: _points(s, d, sim.haversine()))
query("c11_geo", PP.format(f"exp(-abs({HAV}) / 5000)"))(lambda s, d: _points(s, d, sim.geo(5000)))


@query("c12_14_decays", """
SELECT l_returnflag, count(*) AS n, round(avg(exp(-abs(l_quantity - 25) / 10)), 6) AS exp_decay,
  round(avg(greatest(0, least(1, 1 - abs(l_quantity - 25) / 20))), 6) AS linear_decay, round(avg(exp(-0.5 * pow((l_quantity - 25) / 8, 2))), 6) AS gaussian_decay
FROM lineitem GROUP BY l_returnflag""")
def c12_decays(s, d):
    q, mid = F.col("l_quantity"), F.lit(25.0)
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(sim.exp_decay(10)(q, mid)), 6).alias("exp_decay"), F.round(F.avg(sim.linear_decay(20)(q, mid)), 6).alias("linear_decay"), F.round(F.avg(sim.gaussian_decay(8)(q, mid)), 6).alias("gaussian_decay"))


@query("c15_direct", NN.format(LEV))
def c15_direct(s, d):
    n = nations(s, d)
    return blocking.score_candidates(n, n.select("*"), blocking.blockers.resolve("all_pairs")(n, n), sim.levenshtein()).df.withColumn("score", F.round("score", 6))


PAIRED = """p AS (SELECT a.c_custkey AS i, b.c_custkey AS j, a.c_name AS an, b.c_name AS bn, a.c_acctbal AS ab, b.c_acctbal AS bb
 FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey),
s AS (SELECT i, j, 1 - levenshtein(an, bn) / greatest(length(an), length(bn)) AS name, exp(-abs(ab - bb) / 1000) AS balance FROM p)"""


def customer_scores(s, d):
    c = table(s, d, "customer")
    keys, used = ["c_nationkey", "c_mktsegment"], ["c_custkey", "c_name", "c_acctbal"]
    a, b = (c.select(*keys, *[F.col(x).alias(f"{side}_{x}") for x in used]) for side in "ab")
    p = join_blocks(a, b, keys).filter("a_c_custkey < b_c_custkey")
    fields = {"c_name": sim.levenshtein(), "c_acctbal": sim.exp_decay(1000)}
    scores = sim.agreement(fields, lambda f: F.col(f"a_{f}"), lambda f: F.col(f"b_{f}"))
    return p.select(F.col("a_c_custkey").alias("i"), F.col("b_c_custkey").alias("j"), scores["c_name"].alias("name"), scores["c_acctbal"].alias("balance"))


@query("c18_22_records", f"""WITH {PAIRED} SELECT i, j, round(2 * name + balance, 6) AS weighted, round((name + balance) / 2, 6) AS mean, round(greatest(name, balance), 6) AS most,
 round(name * ln(0.9 / 0.1) + (1 - name) * ln(0.1 / 0.9) + balance * ln(0.8 / 0.2) + (1 - balance) * ln(0.2 / 0.8), 6) AS fs, name >= 0.9 AS close FROM s""")
def c18_records(s, d):
    x = {"name": F.col("name"), "balance": F.col("balance")}
    fs = sim.fellegi_sunter(x, {"name": 0.9, "balance": 0.8}, {"name": 0.1, "balance": 0.2})
    return customer_scores(s, d).select("i", "j", F.round(sim.weighted_sum(x, {"name": 2}), 6).alias("weighted"), F.round(sim.mean(x), 6).alias("mean"), F.round(sim.maximum(x), 6).alias("most"), F.round(fs, 6).alias("fs"), sim.threshold(F.col("name"), 0.9).alias("close"))


@query("c24_platt")
def c24_platt(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", F.log1p("n_chars").alias("score")), "doc_id").select("doc_id", "score", F.col("quality").alias("label"))
    return clustering.platt(rows)(rows).select("doc_id", F.round("probability", 4).alias("probability"))


@query("c25_isotonic")
def c25_isotonic(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", F.log1p("n_chars").alias("score")), "doc_id").select("doc_id", "score", F.col("quality").alias("label"))
    return clustering.isotonic(rows)(rows).select("doc_id", F.round("probability", 6).alias("probability"))


# features

GRAMS = "flatten(list_transform(range(2, 5), lambda n: list_transform(range(1, greatest(length({0}) - n + 2, 1)), lambda i: substr({0}, i, n))))"


@query("ft3_char_ngrams", f"WITH {N}, p AS (SELECT id, ' ' || lower(item) || ' ' AS t FROM n), g AS (SELECT id, unnest({GRAMS.format('t')}) AS gram FROM p) SELECT id, gram, count(*) AS n FROM g GROUP BY ALL")
def ft3_char_ngrams(s, d):
    return nations(s, d).select("id", F.explode(text.char_ngrams(F.col("item"))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))


TFIDF = f"""p AS (SELECT side, id, ' ' || lower(item) || ' ' AS t FROM items), g AS (SELECT side, id, unnest({GRAMS.format('t')}) AS gram FROM p),
c AS (SELECT side, id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM c GROUP BY gram), nn AS (SELECT count(*) AS n FROM items),
w AS (SELECT side, id, gram, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df USING (gram), nn), u AS (SELECT side, id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM w)"""


@query("ft2_tfidf", f"WITH {N}, items AS (SELECT 0 AS side, id, item FROM n), {TFIDF} SELECT id, gram, round(w, 6) AS weight FROM u")
def ft2_tfidf(s, d):
    n = nations(s, d)
    return features.TfIdf().fit(n).transform(n).withColumn("weight", F.round("weight", 6))


@query("f6_similarity_matrix", f"""WITH {N}, items AS (SELECT 0 AS side, id, item FROM n UNION ALL SELECT 1, r_regionkey, r_name FROM region), {TFIDF},
s AS (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS score FROM u a JOIN u b USING (gram) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT n.id AS i, CAST(r_regionkey AS BIGINT) AS j, round(coalesce(score, 0), 6) AS score FROM n CROSS JOIN region LEFT JOIN s ON n.id = s.i AND r_regionkey = s.j""")
def f6_similarity_matrix(s, d):
    return api.similarity_matrix(nations(s, d), regions(s, d), dense=True).select("i", "j", F.round("score", 6).alias("score"))


@query("ft8_l2_normalize", f"WITH {VV}, n AS (SELECT id, item, sqrt(list_inner_product(item, item)) AS n FROM v) SELECT id, round(item[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first, round(list_sum(item) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS total FROM n")
def ft8_l2_normalize(s, d):
    v = vectors(s, d).select("id", sim.l2_normalize(F.col("item")).alias("u"))
    return v.select("id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# blocking


def _self_pairs(name: str, blocker: str, sql: str, source=nations, **options):
    query(name, sql)(lambda s, d: blocking.blockers.resolve(blocker, **options)(source(s, d)))


_self_pairs("b1_all_pairs", "all_pairs", f"WITH {N} SELECT a.id AS i, b.id AS j FROM n a JOIN n b ON a.id < b.id")
_self_pairs("b3_first_chars", "first_chars", f"WITH {N} SELECT a.id AS i, b.id AS j FROM n a JOIN n b ON a.id < b.id AND lower(a.item[1:1]) = lower(b.item[1:1])")
_self_pairs("b4_qgrams", "qgrams", f"WITH {N}, k AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(item)), lambda i: substr(item, i, 2))) AS k FROM n) SELECT DISTINCT a.id AS i, b.id AS j FROM k a JOIN k b USING (k) WHERE a.id < b.id")
_self_pairs("b6_phonetic", "phonetic", None)
query("b5_whole_value", "SELECT DISTINCT a.doc_id AS i, b.doc_id AS j FROM documents a JOIN documents b ON lower(a.text) = lower(b.text) AND a.doc_id < b.doc_id")(
    lambda s, d: blocking.blockers.resolve("key", keys=lambda x: F.array(F.xxhash64(F.lower(x))))(table(s, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("item")))
)


def suppliers(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("item")), table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("item"))


query("b2_key_blocking", "SELECT DISTINCT s_suppkey AS i, c_custkey AS j FROM supplier JOIN customer ON s_nationkey = c_nationkey")(lambda s, d: blocking.key_blocking(F.array)(*suppliers(s, d)))
query("b7_sorted_neighborhood", "WITH p AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS pos FROM supplier) SELECT least(a.id, b.id) AS i, greatest(a.id, b.id) AS j FROM p a JOIN p b ON b.pos - a.pos BETWEEN 1 AND 2")(
    lambda s, d: blocking.sorted_neighborhood(3)(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("item")))
)
query("b8_sorted_neighborhood_cross", """WITH u AS (SELECT s_suppkey AS id, s_nationkey AS k, 0 AS side FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer),
t AS (SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY id) AS turn FROM u), p AS (SELECT *, row_number() OVER (ORDER BY k, turn, side, id) AS pos FROM t)
SELECT CASE WHEN a.side = 0 THEN a.id ELSE b.id END AS i, CASE WHEN a.side = 0 THEN b.id ELSE a.id END AS j FROM p a JOIN p b ON b.pos - a.pos BETWEEN 1 AND 2 AND a.side <> b.side""")(
    lambda s, d: blocking.sorted_neighborhood(3)(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("item")), table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("item")))
)
query("b9_brute_knn", f"WITH {VV}, s AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.item, b.item) DESC, b.id) AS k FROM v a JOIN v b ON a.id <> b.id) SELECT least(i, j) AS i, greatest(i, j) AS j FROM s WHERE k <= 5")(
    lambda s, d: blocking.brute_knn_blocking(5)(vectors(s, d))
)
query("b10_ann")(lambda s, d: blocking.ann_blocking(5)(vectors(s, d)))
query("b11_minhash_lsh")(lambda s, d: blocking.minhash_lsh_blocking(0.5, 128)(table(s, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("item"))))
FIRST = f"{N}, c AS (SELECT a.id AS i, b.id AS j FROM n a JOIN n b ON a.id < b.id AND a.item[1:1] = b.item[1:1])"
query("b13_prune_frequent", "WITH c AS (SELECT DISTINCT s_suppkey AS i, c_custkey AS j FROM supplier JOIN customer ON s_nationkey = c_nationkey) SELECT i, j FROM c WHERE i NOT IN (SELECT i FROM c GROUP BY i HAVING count(*) > 60) AND j NOT IN (SELECT j FROM c GROUP BY j HAVING count(*) > 60)")(
    lambda s, d: blocking.key_blocking_pruned(F.array, 60)(*suppliers(s, d))
)


@query("b14_blocking_metrics", f"""WITH {FIRST}, t AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey),
x AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM c JOIN t USING (i, j)) AS h)
SELECT round(h / t, 6) AS pair_completeness, round(1 - n / 300, 6) AS reduction_ratio, round(h / n, 6) AS pair_quality, n AS n_candidates FROM x""")
def b14_blocking_metrics(s, d):
    r = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("item"))
    truth = blocking.key_blocking(lambda x: F.array(x))(r)
    m = blocking.blocking_metrics(blocking.first_chars_blocker()(nations(s, d)), truth, 25)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns[:3]], "n_candidates")


SCORED = f"{FIRST}, e AS (SELECT i, j, {LEV} AS score FROM c JOIN n a ON a.id = i JOIN n b ON b.id = j)"


def scored(s, d) -> Edges:
    n = nations(s, d)
    return blocking.score_candidates(n, None, blocking.first_chars_blocker()(n), sim.levenshtein())


query("b15_score_candidates", f"WITH {SCORED} SELECT i, j, round(score, 6) AS score FROM e")(lambda s, d: scored(s, d).df.withColumn("score", F.round("score", 6)))


# matching: nations against regions, by shared bigrams

CELLS = "x AS (SELECT n_nationkey AS i, r_regionkey AS j, round(1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)) + ((n_nationkey * 7 + r_regionkey * 3) % 11) / 1000.0, 6) AS score FROM nation, region)"


def cells(s, d) -> Edges:
    n, r = nations(s, d), regions(s, d)
    both = n.select(F.col("id").alias("i"), F.col("item").alias("x")).crossJoin(r.select(F.col("id").alias("j"), F.col("item").alias("y")))
    jitter = (F.col("i") * 7 + F.col("j") * 3) % 11 / 1000.0
    return Edges(both.select("i", "j", F.round(sim.levenshtein()(F.col("x"), F.col("y")) + jitter, 6).alias("score")), n_a=25, n_b=5)


OPTIMUM = f"""WITH {CELLS} SELECT CAST(5 AS BIGINT) AS n_pairs, round(max(a.score + b.score + c.score + e.score + f.score), 6) AS total
FROM x a JOIN x b ON a.j = 0 AND b.j = 1 AND b.i <> a.i JOIN x c ON c.j = 2 AND c.i NOT IN (a.i, b.i) JOIN x e ON e.j = 3 AND e.i NOT IN (a.i, b.i, c.i) JOIN x f ON f.j = 4 AND f.i NOT IN (a.i, b.i, c.i, e.i)"""


def _totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.sum("score"), 6).alias("total"))


BEST_PAIRS = OPTIMUM.replace("SELECT CAST(5 AS BIGINT) AS n_pairs, round(max(a.score + b.score + c.score + e.score + f.score), 6) AS total", "SELECT unnest(arg_max([a.i, b.i, c.i, e.i, f.i], a.score + b.score + c.score + e.score + f.score)) AS i, unnest(range(5)) AS j")
BEST_PAIRS = f"SELECT CAST(i AS BIGINT) AS i, j FROM ({BEST_PAIRS})"
for _name in ("optimal", "max_weight", "kuhn_munkres", "hungarian"):
    query(f"m1_{_name}", BEST_PAIRS)(lambda s, d, how=_name: matching.resolve_matcher(how)(cells(s, d)).select("i", "j"))
query("m1_total", OPTIMUM)(lambda s, d: _totals(matching.optimal()(cells(s, d))))

GREEDY = f"""WITH RECURSIVE {CELLS}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, i, j) AS k FROM x),
g(k, ri, rj, i, j, score) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE)
 UNION ALL SELECT o.k, CASE WHEN list_contains(ri, o.i) OR list_contains(rj, o.j) THEN ri ELSE list_append(ri, o.i) END, CASE WHEN list_contains(ri, o.i) OR list_contains(rj, o.j) THEN rj ELSE list_append(rj, o.j) END,
 CASE WHEN list_contains(ri, o.i) OR list_contains(rj, o.j) THEN NULL ELSE o.i END, CASE WHEN list_contains(ri, o.i) OR list_contains(rj, o.j) THEN NULL ELSE o.j END, o.score FROM g JOIN o ON o.k = g.k + 1)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(score AS DOUBLE) AS score FROM g WHERE i IS NOT NULL"""
query("m2_greedy", GREEDY)(lambda s, d: matching.greedy()(cells(s, d)))
# both sides prefer by the same scores, which differ where it matters: the stable matching is the greedy one
query("m3_stable", GREEDY)(lambda s, d: matching.stable()(cells(s, d)))
query("m8_soft_match")(lambda s, d: matching.soft_match(cells(s, d)).select("i", "j", F.round("mass", 6).alias("mass")))
query("m9_harden")(lambda s, d: matching.harden(matching.soft_match(cells(s, d))).select("i", "j"))
query("m12_to_cost", f"WITH {CELLS} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(max(score) OVER () - score, 6) AS score FROM x")(lambda s, d: cells(s, d).cost().select("i", "j", F.round("score", 6).alias("score")))
query("m11_dense", f"WITH {SCORED}, f AS (SELECT -(25 * (abs(max(score)) + abs(min(score))) + 1) AS f FROM e) SELECT a.id AS i, b.id AS j, round(coalesce(score, f), 6) AS score FROM n a CROSS JOIN n b CROSS JOIN f LEFT JOIN e ON a.id = e.i AND b.id = e.j")(
    lambda s, d: Edges(scored(s, d).df, n_a=25, n_b=25).dense().select("i", "j", F.round("score", 6).alias("score"))
)
query("m13_pairs", f"WITH {CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM x) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, score FROM k WHERE r <= 2")(lambda s, d: matching.pairs(2)(cells(s, d)))

# clusters

PARTS = """WITH RECURSIVE {0}, r(x, y) AS (SELECT id, id FROM n UNION SELECT r.x, CASE WHEN e.i = r.y THEN e.j ELSE e.i END FROM r JOIN e ON (e.i = r.y OR e.j = r.y)),
h AS (SELECT x AS item, min(y) AS head FROM r GROUP BY x)"""
CLOSE = SCORED.replace("e AS (", "e0 AS (") + ", e AS (SELECT * FROM e0 WHERE score >= 0.3)"
query("k1_connected_components", PARTS.format(CLOSE) + " SELECT item, dense_rank() OVER (ORDER BY head) - 1 AS cluster_id FROM h")(lambda s, d: clustering.connected_components()(scored(s, d).df, 25, 0.3))
PIVOT = f"""WITH RECURSIVE {CLOSE}, b AS (SELECT n.id, list(u.y) FILTER (u.y IS NOT NULL) AS near FROM n LEFT JOIN (SELECT i AS x, j AS y FROM e UNION ALL SELECT j, i FROM e) u ON u.x = n.id GROUP BY n.id),
g(k, taken, own) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL
 SELECT b.id, CASE WHEN list_contains(taken, b.id) THEN taken ELSE list_concat(taken, list_append(list_filter(coalesce(near, []), lambda y: NOT list_contains(taken, y)), b.id)) END,
 CASE WHEN list_contains(taken, b.id) THEN [] ELSE list_append(list_filter(coalesce(near, []), lambda y: NOT list_contains(taken, y)), b.id) END FROM g JOIN b ON b.id = g.k + 1)
SELECT item, dense_rank() OVER (ORDER BY k) - 1 AS cluster_id FROM (SELECT k, unnest(own) AS item FROM g)"""
query("k2_correlation", PIVOT)(lambda s, d: clustering.correlation_clustering()(scored(s, d).df, 25, 0.3))
query("k7_pairs_within", PARTS.format(CLOSE) + " SELECT a.item AS i, b.item AS j FROM h a JOIN h b USING (head) WHERE a.item < b.item")(lambda s, d: clustering.pairs_within(clustering.connected_components()(scored(s, d).df, 25, 0.3)))


def parts_by_name(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("cluster_id")), p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("size"))


K3 = "WITH p AS (SELECT p_name AS cluster_id, p_partkey AS item, p_brand AS brand, CASE WHEN p_size % 3 > 0 THEN p_size END AS size FROM part) "
query("k3_first", K3 + "SELECT cluster_id, brand, size FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY item) AS k FROM p) WHERE k = 1")(lambda s, d: clustering.canonicalize(*parts_by_name(s, d), "first"))
query("k3_most_complete", K3 + "SELECT cluster_id, brand, size FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CAST(brand IS NOT NULL AS INT) + CAST(size IS NOT NULL AS INT) DESC, item) AS k FROM p) WHERE k = 1")(lambda s, d: clustering.canonicalize(*parts_by_name(s, d), "most_complete"))
query("k3_majority", K3 + """, b AS (SELECT cluster_id, brand, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(item)) AS k FROM p WHERE brand IS NOT NULL GROUP BY cluster_id, brand),
z AS (SELECT cluster_id, size, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(item)) AS k FROM p WHERE size IS NOT NULL GROUP BY cluster_id, size)
SELECT c.cluster_id, brand, size FROM (SELECT DISTINCT cluster_id FROM p) c LEFT JOIN b ON b.cluster_id = c.cluster_id AND b.k = 1 LEFT JOIN z ON z.cluster_id = c.cluster_id AND z.k = 1""")(lambda s, d: clustering.canonicalize(*parts_by_name(s, d), "majority"))
query("k4_classify", "SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'match' WHEN c_acctbal <= 0 THEN 'non_match' ELSE 'possible_match' END AS decision FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", clustering.classify(F.col("c_acctbal"), 0.0, 5000.0).alias("decision")))


@query("k5_estimate_mu_em")
def k5_em(s, d):
    found = clustering.estimate_mu_em(customer_scores(s, d), ["name", "balance"])
    return s.createDataFrame([(f, found["m"][f], found["u"][f], found["p"]) for f in found["m"]], "field string, m double, u double, p double")


# review

TOP = f"WITH {SCORED}, t AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY isnan(score), score DESC, j) AS rank, j, round(score, 6) AS score FROM e)"
query("i1_candidate_store", TOP + " SELECT i, CAST(rank AS INT) AS rank, j, score FROM t WHERE rank <= 3")(lambda s, d: review.CandidateStore.from_scores(scored(s, d), 3).df.withColumn("score", F.round("score", 6)))
query("i2_top", TOP + " SELECT i, CAST(rank AS INT) AS rank, j, score FROM t WHERE rank = 1")(lambda s, d: review.CandidateStore.from_scores(scored(s, d), 3).top(1).withColumn("score", F.round("score", 6)))
MARGIN = TOP + ", m AS (SELECT n.id AS i, coalesce(round(abs(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)), 5), 'infinity'::DOUBLE) AS margin FROM n LEFT JOIN t ON n.id = t.i GROUP BY n.id)"


def _queue(s, d, f):
    store = review.CandidateStore.from_scores(Edges(scored(s, d).df.withColumn("score", F.round("score", 6))), 3)
    return f(store, nations(s, d).select(F.col("id").alias("i"))).select("i", F.round("margin", 5).alias("margin"))


query("i3_margins", MARGIN + " SELECT * FROM m")(lambda s, d: _queue(s, d, lambda store, rows: store.margins(rows)))
query("i4_review_queue", MARGIN + " SELECT * FROM m ORDER BY margin, i")(lambda s, d: _queue(s, d, lambda store, rows: review.review_queue(store, rows)))
query("i5_uncertainty_sampling", MARGIN + " SELECT * FROM m ORDER BY margin, i LIMIT 5")(lambda s, d: _queue(s, d, lambda store, rows: review.uncertainty_sampling(store, 5, rows)))
query("i7_k_best", OPTIMUM.replace("SELECT CAST(5 AS BIGINT) AS n_pairs, round(max(a.score + b.score + c.score + e.score + f.score), 6) AS total", "SELECT CAST(0 AS BIGINT) AS part, CAST(row_number() OVER (ORDER BY sum_of DESC) AS INT) AS rank, round(-sum_of, 6) AS total, CAST(5 AS BIGINT) AS n FROM (SELECT a.score + b.score + c.score + e.score + f.score AS sum_of") + " ORDER BY sum_of DESC LIMIT 3)")(lambda s, d: review.k_best_assignments(cells(s, d), 3).groupBy("part", "rank").agg(F.round(F.first("total"), 6).alias("total"), F.count("*").alias("n")))
query("i6_solve_constrained", OPTIMUM + " WHERE c.i = 4 AND a.i <> 1 AND f.i <> 10")(lambda s, d: _totals(review.solve_constrained(cells(s, d), forced=[(4, 2)], forbidden=[(1, 0), (10, 4)])))
query("i9_reoptimize", OPTIMUM + " WHERE a.i = 0 AND b.i <> 1")(lambda s, d: _totals(review.reoptimize(cells(s, d), review.Constraints().confirm(0, 0).reject(1, 1))))

# facades

COSINES = f"""WITH {N}, items AS (SELECT 0 AS side, id, item FROM n UNION ALL SELECT 1, r_regionkey, r_name FROM region), {TFIDF},
s AS (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS score FROM u a JOIN u b USING (gram) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL),
x AS (SELECT n.id AS i, CAST(r_regionkey AS BIGINT) AS j, coalesce(score, 0) AS score FROM n CROSS JOIN region LEFT JOIN s ON n.id = s.i AND r_regionkey = s.j)"""
query("f1_match", OPTIMUM.replace(f"WITH {CELLS}", COSINES))(lambda s, d: _totals(api.match(nations(s, d), regions(s, d))))
query("f2_match_cluster", f"""WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS item FROM nation UNION ALL SELECT r_regionkey + 25, r_name FROM region),
e AS (SELECT a.id AS i, b.id AS j FROM n a JOIN n b ON a.id < 25 AND b.id >= 25 AND {LEV} >= 0.4), r(x, y) AS (SELECT id, id FROM n UNION SELECT r.x, CASE WHEN e.i = r.y THEN e.j ELSE e.i END FROM r JOIN e ON (e.i = r.y OR e.j = r.y)),
h AS (SELECT x AS item, min(y) AS head FROM r GROUP BY x) SELECT item, dense_rank() OVER (ORDER BY head) - 1 AS cluster_id FROM h""")(lambda s, d: api.match(nations(s, d), regions(s, d), compare="levenshtein", how="cluster", threshold=0.4))
query("f3_match_soft")(lambda s, d: api.match(nations(s, d), regions(s, d), compare="levenshtein", how="soft").select("i", "j"))
query("f4_dedupe", f"""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS id, s_name AS item FROM supplier), e AS (SELECT a.id AS i, b.id AS j FROM n a JOIN n b ON a.id < b.id AND right(a.item, 3) = right(b.item, 3) AND {LEV} >= 0.7),
r(x, y) AS (SELECT id, id FROM n UNION SELECT r.x, CASE WHEN e.i = r.y THEN e.j ELSE e.i END FROM r JOIN e ON (e.i = r.y OR e.j = r.y)), h AS (SELECT x AS item, min(y) AS head FROM r GROUP BY x)
SELECT item, dense_rank() OVER (ORDER BY head) - 1 AS cluster_id FROM h""")(
    lambda s, d: api.dedupe(api.collection(table(s, d, "supplier"), "s_name", "s_suppkey").select("id", "item"), compare="levenshtein", block=blocking.key_blocking(lambda x: F.array(F.right(x, F.lit(3)))), threshold=0.7)
)
query("f5_resolve", f"""WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS item FROM nation UNION ALL SELECT r_regionkey + 25, r_name FROM region),
e AS (SELECT a.id AS i, b.id AS j FROM n a JOIN n b ON a.id < b.id AND {LEV} >= 0.5), r(x, y) AS (SELECT id, id FROM n UNION SELECT r.x, CASE WHEN e.i = r.y THEN e.j ELSE e.i END FROM r JOIN e ON (e.i = r.y OR e.j = r.y)),
h AS (SELECT x AS item, min(y) AS head FROM r GROUP BY x) SELECT item, dense_rank() OVER (ORDER BY head) - 1 AS cluster_id FROM h""")(lambda s, d: api.resolve(nations(s, d), regions(s, d), compare="levenshtein", threshold=0.5))
query("f7_match_keys_to_values", OPTIMUM.replace(f"WITH {CELLS}", COSINES))(lambda s, d: _totals(api.match_keys_to_values(regions(s, d), nations(s, d))))


def _lengths(items: DataFrame) -> DataFrame:
    """A featurizer of one's own: the shares of five letters."""
    return items.select("id", F.transform(F.array(*map(F.lit, "AEINR")), lambda x: F.length("item") - F.length(F.replace(F.col("item"), x, F.lit(""))) + F.lit(0.0)).alias("vec"))


@query("c16_featurized", f"""WITH {N}, v AS (SELECT id, list_transform(['A', 'E', 'I', 'N', 'R'], lambda x: CAST(length(item) - length(replace(item, x, '')) AS DOUBLE)) AS vec FROM n)
SELECT a.id AS i, b.id AS j, round(CASE WHEN list_sum(a.vec) = 0 OR list_sum(b.vec) = 0 THEN 0 ELSE list_cosine_similarity(a.vec, b.vec) END, 6) AS score FROM v a JOIN v b ON a.id < b.id""")
def c16_featurized(s, d):
    n = nations(s, d)
    return api.featurized(_lengths, "cosine")(n, None, blocking.blockers.resolve("all_pairs")(n)).df.select("i", "j", F.round("score", 6).alias("score"))


@query("ft1_identity", f"WITH {VV} SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.item, b.item), 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.id < b.id")
def ft1_identity(s, d):
    v = vectors(s, d)
    return api.featurized_within("identity")(v, "label")


query("f8_match_in_key_order", f"""WITH RECURSIVE {CELLS.replace('x AS', 'y AS')}, x AS (SELECT i, j, score - 0.2 AS score FROM y),
g(k, rj, j, score) AS (SELECT -1, CAST([] AS INTEGER[]), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE) UNION ALL
 SELECT g.k + 1, CASE WHEN b.j IS NULL THEN rj ELSE list_append(rj, b.j) END, b.j, b.score FROM g LEFT JOIN LATERAL (SELECT x.j, x.score FROM x WHERE x.i = g.k + 1 AND x.score > 0 AND NOT list_contains(g.rj, x.j) ORDER BY x.score DESC, x.j LIMIT 1) b ON true WHERE g.k < 24)
SELECT CAST(k AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(score, 6) AS score FROM g WHERE j IS NOT NULL""")(lambda s, d: matching.match_in_key_order(cells(s, d).df.withColumn("score", F.col("score") - 0.2)).withColumn("score", F.round("score", 6)))

# row filters, profiles, evaluation, streams as tables

query("x2_row_filters", "SELECT count(*) FILTER (p_name IS NOT NULL AND p_brand IS NOT NULL) AS whole, count(*) FILTER (replace(p_type, ' ', '_') = p_type) AS plain, count(*) FILTER (p_size % 2 = 0 AND p_brand LIKE 'Brand#1%') AS both FROM part")(
    lambda s, d: table(s, d, "part").agg(F.count_if(F.col("p_name").isNotNull() & F.col("p_brand").isNotNull()).alias("whole"), F.count_if(F.replace("p_type", F.lit(" "), F.lit("_")) == F.col("p_type")).alias("plain"), F.count_if((F.col("p_size") % 2 == 0) & F.col("p_brand").startswith("Brand#1")).alias("both"))
)
query("x3_null_counts", "SELECT 'size' AS \"column\", count(*) FILTER (p_size % 3 = 0) AS nulls FROM part HAVING nulls > 0")(lambda s, d: tables.null_counts(parts_by_name(s, d)[1]))
query("x4_most_common", "SELECT found, count(*) AS n FROM (SELECT unnest(regexp_extract_all(url, '[a-z]+')) AS found FROM pages) GROUP BY found ORDER BY n DESC, found LIMIT 10")(lambda s, d: tables.most_common(table(s, d, "pages"), "url", "[a-z]+", 10))
LABELS = "f AS (SELECT vec_id AS item, vec_id % 7 AS f, label AS t FROM embeddings), c AS (SELECT f, t, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY f) AS nf, sum(n) OVER (PARTITION BY t) AS nt FROM c)"


def _label_partitions(s, d):
    v = table(s, d, "embeddings")
    return v.select(F.col("vec_id").alias("item"), (F.col("vec_id") % 7).alias("cluster_id")), v.select(F.col("vec_id").alias("item"), F.col("label").alias("cluster_id"))


query("e1_b_cubed", f"WITH {LABELS} SELECT round(sum(n * n / nf) / sum(n), 6) AS precision, round(sum(n * n / nt) / sum(n), 6) AS recall FROM s")(lambda s, d: clustering.b_cubed(*_label_partitions(s, d)).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")))
query("e2_pairwise", """WITH v AS (SELECT vec_id, vec_id % 7 AS f, label AS t FROM embeddings), p AS (SELECT count(*) FILTER (a.f = b.f AND a.t = b.t) AS h, count(*) FILTER (a.f = b.f) AS nf, count(*) FILTER (a.t = b.t) AS nt FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT round(h / nf, 6) AS precision, round(h / nt, 6) AS recall, round(2 * h / (nf + nt), 6) AS f1 FROM p""")(lambda s, d: clustering.pairwise_scores(*_label_partitions(s, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]))


@query("s1_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def s1_windowed_counts(s, d):
    from linkspark.streaming.incremental import windowed_counts

    return windowed_counts(table(s, d, "events")).select("window.start", "event_type", "n")


@query("p1_column_profile", """WITH a AS (SELECT DISTINCT 'o_orderstatus' AS a, lower(o_orderstatus) AS v FROM orders UNION SELECT 'o_orderpriority', lower(o_orderpriority) FROM orders),
b AS (SELECT DISTINCT 'l_returnflag' AS b, lower(l_returnflag) AS v FROM lineitem UNION SELECT 'l_linestatus', lower(l_linestatus) FROM lineitem),
s AS (SELECT a, b, count(*) AS n FROM a JOIN b USING (v) GROUP BY a, b),
t AS (SELECT a, b, n / ((SELECT count(*) FROM a x WHERE x.a = s.a) + (SELECT count(*) FROM b y WHERE y.b = s.b) - n) AS score FROM s)
SELECT a, b, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INT) AS rank FROM t""")
def p1_column_profile(s, d):
    return api.column_profile_similarity(table(s, d, "orders"), table(s, d, "lineitem")).select("a", "b", F.round("score", 6).alias("score"), "rank")
