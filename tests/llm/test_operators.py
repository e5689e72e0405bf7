"""Each operator against a brute-force version on a small fixture, and on awkward rows."""

import collections
import hashlib
import io
import math
import random
import re
import tracemalloc
import zipfile
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkspark.llm import chunks, common, decontaminate, jaccard, katz, language, mixing, pii, quality, suffix, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, cls string, spans string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "éu", "ss", "ta"]) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = make(80), make(30)
    texts = [make(rng.randint(3, 120)) for _ in range(25)]
    for _ in range(12):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base] * 5 + [make(10) + " " + passage + " " + make(10) for _ in range(6)]
    texts += [None, "", " \n\t", "one", "a b c d", "Kalo " * 3000, "x" * 5000, "line one two\nline one two\n#*$", "\x85\xa0 odd\x1cblanks"]
    return [(i, t, ("aa", "bb")[i % 2] if i % 5 else None, "big" if i % 3 else (None if i % 2 else f"s{i % 4}"), 0, 7, "c", "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def trusted(spark):
    return spark.createDataFrame([(i,) for i in range(10)], "doc_id long")


def bench(spark, rows):
    return spark.createDataFrame([(1, " ".join(words(rows[44][1])[10:40]), 0), (2, None, 0), (3, "too short", 0)], "item_id long, text string, h long")


def operators(spark, rows):
    items = bench(spark, rows)
    return {
        "quality": lambda d: quality.quality_rules(d, trusted(spark)),
        "pii": pii.find_personal_data,
        "redact": pii.redact,
        "decontaminate": lambda d: decontaminate.mark_contaminated(d, items),
        "suffix": suffix.dedupe_substrings,
        "katz": katz.score_documents,
        "mixing": mixing.plan_mix,
        "chunks": chunks.dedupe_chunks,
        "jaccard": jaccard.jaccard_components,
        "language": language.identify_language,
        "warc": lambda d: warc.read_archives(warc.write_archives(d.select(F.col("doc_id").alias("page_id"), F.lit("u\r\n").alias("url"), F.col("text").alias("html"), "h"), common.scratch_path(spark, "archives"))),
    }


@pytest.mark.parametrize("name", ["quality", "pii", "redact", "decontaminate", "suffix", "katz", "mixing", "chunks", "jaccard", "language", "warc"])
def test_awkward_rows(spark, rows, name):
    """Null ids, repeated rows, all-null columns: one result a row, the same for the same row. Empty tables: no rows."""
    odd = [*rows[25:34], (None, None, None, None, None, None, None, None), (None, "some text here", None, None, None, None, None, None), (7, "", "aa", "x", 0, 1, "c", "s"), *[(8, "same row twice with a few more words", "aa", "x", 0, 1, "c", "s")] * 2]
    f = operators(spark, rows)[name]
    assert f(spark.createDataFrame(odd, SCHEMA)).count() == len(odd)
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality(spark, docs, rows):
    w = quality.fit(docs, trusted(spark))
    for r in quality.quality_rules(docs, trusted(spark)).collect():
        text = rows[r.doc_id][1] or ""
        ws = words(text)
        tri = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
        repeat = len({i + k for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for k in range(3)})
        lines = [x for x in text.split("\n") if words(x)]
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ws]
        grams = [x % quality.N_BUCKETS for x in h] + [(a * 31 + b) % quality.N_BUCKETS for a, b in zip(h, h[1:], strict=False)]
        llr = sum(w[g] for g in grams) / max(1, len(grams))
        failed = len(ws) < 50 or 100 * repeat > 50 * len(ws)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed)
        assert r.llr == pytest.approx(llr, abs=1e-9) and r.kept == (not failed and r.llr >= quality.MIN_LLR)


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii(spark):
    texts = ["a@b.c_d@e.f.g x@y é 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "+1 (743) 555-3824é+12345678 9", "4785380592391139 4785-3805-9239-1139 47853805923911390000", "a" * 20000 + "@", "1.2.3." * 5000]
    texts += [f"my customer id is {x}" for x in ("4111111111111111", "5500005555555559", "6011000000000004", "AB-99812-X")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i].base] == base_spans(t)
    assert [(s.kind, s.start, s.end) for s in got[8].more] == [("near_card", 18, 28)]  # found by its pattern alone
    assert pii.redact(spark.createDataFrame([(1, "mail a@b.co now")], "doc_id long, text string")).first().text == "mail <EMAIL> now"


def test_decontaminate(spark, docs, rows):
    item = " ".join(words(rows[44][1])[10:40])
    w = item.split()
    changed = " ".join(x if i % 9 else "other" for i, x in enumerate(w))
    more = docs.unionByName(spark.createDataFrame([(500, "before it " + changed.upper() + " after", None, None, 0, 0, "", "")], SCHEMA))
    hit = {r.doc_id for r in decontaminate.mark_contaminated(more, bench(spark, rows)).filter("contaminated").collect()}
    assert hit == {500, *[i for i, r in enumerate(rows) if r[1] and item in " ".join(words(r[1]))]}


def test_short_items_and_long_overlaps(spark):
    long = " ".join(f"w{i}" for i in range(300))
    items = spark.createDataFrame([(1, "Three small words"), (2, long)], "item_id long, text string")
    docs = spark.createDataFrame([(0, "here are three SMALL words, then"), (1, "three small other words"), (2, f"x {long} y"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r["items"], r.score) for r in decontaminate.mark_contaminated(docs, items).collect()}
    assert got == {0: ([1], 3), 1: ([], 0), 2: ([2], 300), 3: ([], 0)}


def test_clashing_columns(spark):
    names = ["copies", "size", "i", "t", "again", "copy", "target", "row", "block"]
    docs = spark.createDataFrame([(k, " ".join(f"w{j + k}" for j in range(70)), "s", *[k] * len(names)) for k in range(4)], "doc_id long, text string, source string, " + ", ".join(f"{x} long" for x in names))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [c for c in docs.columns if c != "copy"] + ["copy"] and mixed.count() > 0
    assert mixing.plan_mix(docs, keep=["doc_id", "size"]).columns == ["doc_id", "size", "source_size", "target", "copies"]


def test_mix_is_near_target(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, "w " * (n := min(400, int(rng.paretovariate(0.9) * 5))), f"s{k % 4}", n) for k in range(600)], "doc_id long, text string, source string, n long")
    sums = mixing.plan_mix(docs, keep=["source"]).groupBy("source").agg(F.sum(F.expr("size * copies")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest")).collect()
    assert all(abs(r.taken - r.target) <= r.longest for r in sums)


def test_language_sample_is_bounded(spark):
    rows = spark.createDataFrame([(None, f"some words number {i} of it", "aa") for i in range(300)] + [(1, "same text again", "bb")] * 300 + [(1, f"others {i} too", "bb") for i in range(50)], "doc_id long, text string, lang string")
    seen = []
    real, language._fit_bits = language._fit_bits, lambda x, y: seen.append(len(x)) or (np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32))
    try:
        language.fit(rows, max_per_language=20)
    finally:
        language._fit_bits = real
    assert seen == [40]


def test_many_digit_words(spark):
    """Time follows the number of matches; spans of the base reach into words that are no candidates then."""
    text = " ".join(f"id {k:06d}" for k in range(20_000)) + " mail a1@b.cc 10.0.0.1 call +49 30 1234 5678 now 12345"
    found = pii.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for s in found.base if s.kind != "card"] == ["email", "ip", "phone"]
    assert all(text[s.start : s.end] == s.value for s in [*found.base, *found.candidates])
    places = [(m.start(), m.end()) for m in re.finditer(r"\b\d{6}\b", text)]
    assert len(found.candidates) == 1 + sum(not any(x.start < b and a < x.end for x in found.base) for a, b in places)
    assert found.candidates[-1].value == "12345"


def test_suffix_arrays():
    rng = random.Random(2)
    for n, k in ((1, 2), (60, 2), (400, 3), (300, 1)):
        t = np.array([rng.randrange(k) + 1 for _ in range(n)], np.uint16)
        b = bytes(t.astype(np.uint8))
        order = suffix.suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        shared = suffix.permuted_lcp(t, order, 10**6)
        for p, q in zip(order, order[1:], strict=False):
            assert shared[q] == next((x for x in range(n) if max(p, q) + x >= n or b[p + x] != b[q + x]), n)


def test_suffix_dedup(docs, rows):
    first = {}
    for i, r in enumerate(rows):
        b = (r[1] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    got = suffix.dedupe_substrings(docs).collect()
    # anchors dealt string by string, one shard a key: the same result
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, suffix.dedupe_substrings(docs, hot=1, shard_bytes=1).collect()), key=str)
    for r in got:
        b = (rows[r.doc_id][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = True
        assert bytes(r.kept) == bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), gone.sum(), (gone & ~np.concatenate([[False], gone[:-1]])).sum() if len(b) else 0)


def test_suffix_filters_let_pass(spark):
    """What a filter lets pass needlessly (here: the larger id of a text) takes nothing from others; filters grow with the input."""
    text = lambda k: "".join(random.Random(k).choices("cdefgh ", k=300))
    shared, loops = text(1), "ab" * 200
    data = [(1, text(2) + shared), (2, text(3) + shared), (3, text(2) + shared), (4, text(4)), (5, text(4)), (6, loops + text(5)), (7, text(6) + loops)]
    cls = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    rows = spark.createDataFrame(data, "rank long, text string").select(cls.alias("cls"), "rank", "text")
    classes = rows.select("cls", F.col("rank").alias("least"), F.octet_length("text").alias("n_bytes"))  # every row passes
    named = rows.select("rank", F.xxhash64("cls", "rank").alias("own"))
    got = {r.rank: [tuple(x) for x in r.spans] for r in suffix.covered_spans(rows, classes).join(named, "own").collect()}
    assert got.pop(7) == [(300, 700)]
    assert got == {2: [(300, 600)], 3: [(0, 600)], 5: [(0, 300)]}
    assert [common.filter_bits(n) for n in (0, 1 << 26, (1 << 26) + 1, 1 << 40)] == [1 << 26, 1 << 26, 1 << 27, common.MOST_BITS]


def test_contexts_are_settled_in_any_batches():
    """Kinds and cuts are the same however an anchor's contexts fall into batches."""
    rng = random.Random(5)
    data = sorted((rng.randrange(4) * 7919, rng.randrange(6), rng.randrange(8), k, rng.randrange(9), 60) for k in range(400))
    least, kinds = {}, {}
    for anchor, digest, rank, *_ in data:
        least.setdefault((anchor, digest), rank)
        kinds.setdefault(anchor, set()).add(digest)
    want = sorted((own, first, first + size) for anchor, digest, rank, own, first, size in data if rank > least[anchor, digest])
    several = {a for a, d in kinds.items() if len({least[a, x] for x in d}) > 1}
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], suffix._CONTEXT)
    for n in (1, 7, 400):
        got = [r for b in suffix._settle((batch(data[k : k + n]) for k in range(0, 400, n)), 3, 1) for r in b.to_pylist()]
        assert sorted((r["own"], r["x"], r["y"]) for r in got if r["own"] is not None) == want
        assert sorted(r["h"] for r in got if r["h"] is not None) == sorted(a ^ d ^ r for (a, d), r in least.items() if a in several)
        assert {r["split"] for r in got} - {None} == {a for a in several if len(kinds[a]) > 3}


def test_shard_minima_over_separators():
    """Contexts that follow each other alike share more than twice LENGTH bytes over a separator."""
    rng = random.Random(8)
    make = lambda n: bytes(rng.randrange(97, 101) for _ in range(n))
    ends, starts = [make(60) for _ in range(4)], [make(60) for _ in range(4)]
    contexts = [x for _ in range(30) for k in range(4) for x in (make(rng.randrange(1, 16)) + ends[k], starts[k] + make(rng.randrange(1, 16)))]
    ranks = [rng.randrange(1000) for _ in contexts]
    least = {}
    for x, r in zip(contexts, ranks, strict=True):
        for k in range(len(x) - 49):
            least[x[k : k + 50]] = min(r, least.get(x[k : k + 50], r))
    for x, own in zip(contexts, suffix.shard_minima(contexts, ranks), strict=True):
        assert own.tolist() == [least[x[k : k + 50]] for k in range(len(x) - 49)]


def test_katz(docs, rows):
    toks = {i: [x.translate(LOW) for x in words(r[1])] + ["</s>"] for i, r in enumerate(rows)}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = collections.Counter(w for i in train for w in toks[i])
    c2 = collections.Counter(p for i in train for p in zip(["<s>"] + toks[i], toks[i], strict=False))
    d1, d2 = katz.good_turing(collections.Counter(c1.values())), katz.good_turing(collections.Counter(c2.values()))
    n, v = sum(c1.values()), len(c1)
    p1 = {w: d1.get(c, 1) * c / n for w, c in c1.items()}
    cv, kept, lower = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, w), c in c2.items():
        cv[a] += c
        kept[a] += d2.get(c, 1) * c
        lower[a] += p1[w]
    for a in cv:
        cv[a] += kept[a] == cv[a]

    def p(a, w):
        if (a, w) in c2:
            return d2.get(c2[a, w], 1) * c2[a, w] / cv[a]
        return ((1 - kept[a] / cv[a]) / (1 - lower[a]) if cv[a] else 1) * p1.get(w, 1 - sum(p1.values()))

    assert all(sum(p(a, w) for w in c1) + p(a, "unseen word") == pytest.approx(1) for a in list(cv)[:20])
    blocks = {tuple(r)[:6]: r.score for r in katz.score_documents(docs, block_tokens=100).collect()}
    got = katz.score_documents(docs).collect()
    assert all(blocks[tuple(r)[:6]] == pytest.approx(r.score, rel=1e-9) for r in got) and len(blocks) == len(got) == len(rows)
    for r in got:
        t = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c1[w] > 0 for w in t), n, r.doc_id not in train)
        assert r.base_score == pytest.approx(sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip(["<s>"] + t, t, strict=False)), rel=1e-7)


def test_mixing(docs, rows):
    got = mixing.plan_mix(docs, keep=["doc_id", "source"]).collect()
    assert [sorted(r.asDict().items()) for r in sorted(got, key=lambda r: r.doc_id)] == [sorted(r.asDict().items()) for r in sorted(mixing.plan_mix(docs.repartition(5), keep=["doc_id", "source"]).collect(), key=lambda r: r.doc_id)]
    assert all(0 <= r.copies <= 2 for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * sum(s for _, s in targets.values())) and all(t <= 2 * s + 1e-6 for t, s in targets.values())
    assert mixing.mix_sources(docs).count() == sum(r.copies for r in got)


def test_chunks(docs, rows):
    seen = set()
    got = {r.doc_id: r for r in chunks.dedupe_chunks(docs).collect()}
    for i, r in enumerate(rows):
        b, kept = (r[1] or "").encode(), b""
        ends = chunks.boundaries(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        for a, e in zip([0, *ends], ends, strict=False):
            kept += b"" if b[a:e] in seen else b[a:e]
            seen.add(b[a:e])
        assert bytes(got[i].kept) == kept
    rng = random.Random(1)
    b = bytes(rng.randrange(256) for _ in range(20000))
    cut = lambda x: {x[a:e] for a, e in zip([0, *ends], ends, strict=False)} if (ends := chunks.boundaries(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]) else set()
    assert len(cut(b) & cut(b[:50] + b"inserted" + b[50:])) > 0.9 * len(cut(b))


def test_warc_archives():
    out = io.BytesIO()
    z = warc.ZipWriter(out)
    z.add("a.txt", b"hello")
    z.add("b/é.txt", b"")
    z.close()
    members = warc.zip_members(out)
    assert warc.read_at(out, *members["a.txt"]) == b"hello" and members["b/é.txt"][1] == 0
    with zipfile.ZipFile(out) as other:  # an independent reader agrees
        assert other.testzip() is None and other.read("a.txt") == b"hello"
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as other:
        other.writestr("c", b"data")
        other.comment = b"a comment"
    assert warc.read_at(plain, *warc.zip_members(plain)["c"]) == b"data"


def test_jaccard(docs, rows, spark):
    def brute(texts):
        sets = []
        for t in texts:
            w = [x.translate(LOW) for x in words(t)]
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
        head = list(range(len(texts)))
        for _ in texts:
            for a in range(len(texts)):
                for b in range(a):
                    both = len(sets[a] & sets[b])
                    if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        head[a] = head[b] = min(head[a], head[b])
        return {i: (len(s), h) for i, (s, h) in enumerate(zip(sets, head, strict=True))}

    want = brute([r[1] for r in rows])
    for small in (1, 16):  # with and without leader lists
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, small_list=small).collect()} == want


def test_shingles_of_few_words():
    """Orders of the same words, and long words of two letters, are told apart."""
    count = lambda *texts: [len(set(x)) for x in np.split(*[y if k == 0 else y[1:-1] for k, y in enumerate(jaccard.shingles(common.utf8(pa.array(texts))))])]
    rng = random.Random(8)
    texts = ["a b b a w b a a b w", *[" ".join(rng.choices("abc", k=rng.randrange(5, 900))) for _ in range(20)]]
    assert count(*texts) == [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in map(str.split, texts)]
    one, other = "a", "b"
    for _ in range(11):
        one, other = one + other, other + one
    for pair in (("x y y x", "y x x y"), (one, other)):
        assert len(set(jaccard.shingles(common.utf8(pa.array(pair)))[0])) == 2


def test_shingles_take_little_memory():
    """Arrays of the shingle steps are made for a small slice of texts at a time, whatever the batch."""
    rng = random.Random(9)
    texts = [" ".join(str(rng.randrange(500)) for _ in range(700)) for _ in range(1500)]  # 4 MB
    shared = SimpleNamespace(value=np.zeros(jaccard.SKETCH, np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(range(1500)), pa.array(texts)], ["doc_id", "th", "text"])
    common._power_tables(1)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in jaccard._prefixes(iter([batch]), 5, 80, shared)) == 1500
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20


def test_language(spark):
    rng = random.Random(6)
    kinds = {"aa": ["the", "and", "ing", "tion"], "bb": ["der", "und", "sch", "ung"], "cc": ["que", "eau", "les", "oui"]}
    data = [(i, " ".join("".join(rng.choices(kinds[k], k=2)) for _ in range(30)), k) for i in range(240) for k in [sorted(kinds)[i % 3]]]
    got = language.identify_language(spark.createDataFrame([*data, (900, "123 !", "aa"), (901, None, "aa")], "doc_id long, text string, lang string")).collect()
    truth = {i: k for i, _, k in data}
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in got if r.doc_id < 900)
    assert {r.lang_pred for r in got if r.doc_id >= 900} == {"und"}
    m = language.codewords(12)
    assert len({tuple(x) for x in m.tolist()}) == 12


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == before.columns, name
        if name == "quality rules":
            kept = {r.doc_id for r in quality.quality_rules(before, quality.trusted_ids(spark.read.parquet(f"{sf}/labels.parquet"))).filter("kept").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
        if name == "n-gram Jaccard join":
            first = {r.component_id for r in jaccard.jaccard_components(before).collect()}
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(first)
        if name == "PII":
            assert not any(base_spans(r.text) for r in docs.select("text").collect())
    assert corpus_pipeline.run(spark, sf).columns == [*docs.columns, "copy"]
