"""Language-model scoring with Katz backoff over words.

Tokens are A-Z-lower-cased words, each text closed by one end token; words are told apart by 64-bit hashes. From
the training texts come bigram counts c(v, w) (v: the word before, or the text's start) and unigram
counts. Counts up to K are discounted by Good-Turing (Katz's form; absolute discounting where the
counts of counts allow no valid discount). Then, recursively per token:

    p(w | v) = d(c) c(v, w) / c(v)  if c(v, w) > 0,  else  a(v) p(w)
    p(w)     = d(c) c(w) / N        if c(w) > 0,     else  the mass that the discounts freed

A context whose counts are all above K frees no mass; its probabilities are scaled by n / (n + 1) instead,
likewise the unigrams'. With a(v) = (1 - sum p(seen w | v)) / (1 - sum p(seen w)), so that every p( . | v) adds up to 1 over the known
words and one unknown word.

Texts are kept in blocks of about BLOCK_TOKENS tokens. A block asks once for each of its words, then once for each of its
pairs of words, whatever their number in it, so a hot word or pair costs one entry a block; words are dealt by their hash, pairs by
a hash of both words, and both are sent in packs. A reply has the word's count and number, or the pair's count, in the order in which
it was asked. Of the blocks with a pair one is told to add it to its context's sums, from which the table of backoff weights is made;
that table is joined to the documents that back off, a row for each document and context.

Edge cases: a null or empty text is its end token alone. Without training tokens every score is 0 and
so is the base score. A null id counts as training. Repeated rows are scored alike and counted as often as they
occur. An empty table gives an empty result. Other columns than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

#: Counts above this are not discounted.
K = 5
FOLDS, FOLD = 7, 2
#: A block ends with the text that brings it to so many tokens.
BLOCK_TOKENS = 1 << 19
#: Words and pairs are dealt to as many shards as there are SHARD_TOKENS tokens, MIN_SHARDS at least.
SHARD_TOKENS, MIN_SHARDS = 3 << 20, 32
#: The end of a text: the hash of a blank, which no word is.
END = common.span_hashes(np.array([32], np.uint8), np.array([0]), np.array([1]))[0]
#: The id of the context before a text's first word; words have ids from 1.
START = 0

_TEXTS = "block long, ids array<long>, held array<boolean>, sizes array<int>, toks binary, n_words int, words binary"
_ASKED = "p int, block long, n int, data binary"
_REPLY = "p int, block long, n int, data binary, facts array<long>"
_SCORED = (
    "block long, at int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, part double, "
    "backed array<struct<v:long,unseen:long,seen:long>>, sums array<struct<v:long,n:long,kept:double,lower:double>>"
)


class Unigrams(NamedTuple):
    total: int  # training tokens
    words: int  # distinct ones
    texts: int  # training texts
    d: list[float]  # factors of counts 0 to K + 1 and above
    norm: float
    unseen: float  # probability of the unknown word


def good_turing(counts: dict[int, int], k: int = K) -> dict[int, float]:
    """The factor of each count up to k; counts: how many n-grams occur r times."""
    n = [0, *[counts.get(r, 0) for r in range(1, k + 2)]]
    if all(n[1:]):
        tail = (k + 1) * n[k + 1] / n[1]
        if tail < 1:
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, k + 1)}
            if all(0 < x < 1 for x in d.values()):
                return d
    return {r: (r - 0.5) / r for r in range(1, k + 1)}


def _factors(counts: dict[int, int]) -> list[float]:
    d = good_turing(counts)
    return [0.0, *[d[r] for r in range(1, K + 1)], 1.0]


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array(d)[np.minimum(c, K + 1)] * c


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers from 0, each in as few bytes a number as its largest needs, bytes of equal weight together."""
    head, body = [], []
    for x in columns:
        width = max(1, -(-int(x.view(np.uint64).max()).bit_length() // 8)) if len(x) else 1
        head.append(width)
        body.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return bytes(head) + pa.compress(b"".join(body), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    widths = list(data[:columns])
    body = pa.decompress(data[columns:], decompressed_size=n * sum(widths), codec="zstd", asbytes=True) if n else b""
    out, at = [], 0
    for width in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        out.append(x.view(np.int64).reshape(n))
        at += n * width
    return out


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _packs(block: int, shard: np.ndarray, shards: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row of each shard with its numbers; the first column grows within a shard."""
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    data = [_pack(_gaps(columns[0][i:j]), *[x[i:j] for x in columns[1:]]) for i, j in spans]
    values = [[int(shard[i]) for i, _ in spans], [block] * len(spans), [j - i for i, j in spans], data]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types, strict=True)], ["p", "block", "n", "data"])


def _asked(asked: pa.Table, columns: int) -> list[np.ndarray]:
    """The numbers of all rows of a shard."""
    parts = [_unpack(d.as_py(), n, columns) for d, n in zip(asked.column("data"), asked.column("n").to_pylist(), strict=True)]
    return [np.concatenate([np.cumsum(x[0]) for x in parts]), *[np.concatenate([x[c] for x in parts]) for c in range(1, columns)]]


def _replies(asked: pa.Table, answer: Callable, facts: list[int]) -> pa.Table:
    """A reply to each row, answer(first, last) of its numbers, and a row of the shard's facts."""
    p, blocks, sizes = asked.column("p").to_pylist(), asked.column("block").to_pylist(), asked.column("n").to_pylist()
    data = [_pack(*answer(j - n, j)) for j, n in zip(np.cumsum(sizes).tolist(), sizes, strict=True)]
    columns = [[*p, p[0]], [*blocks, None], [*sizes, 0], [*data, None], [*[None] * len(p), facts]]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["p", "block", "n", "data", "facts"])


def _few(total: np.ndarray) -> list[int]:
    """How many occur 1 to K + 1 times."""
    return np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def _blocks(most: int) -> Callable:
    """Blocks of texts: their tokens as places in the block's sorted word hashes, these with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            hashes, sizes = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            held = np.concatenate([r[3] for r in rows])
            words, toks = np.unique(hashes, return_inverse=True)
            counts = np.bincount(toks, weights=np.repeat(~held, sizes), minlength=len(words)).astype(np.int64)
            values = [number, pa.concat_arrays([r[2] for r in rows]).to_pylist(), held.tolist(), sizes, _pack(toks), len(words), _pack(_gaps(words), counts)]
            rows.clear()
            number += 1
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], ["block", "ids", "held", "sizes", "toks", "n_words", "words"])

        for batch in batches:
            for part, texts in common.slices(batch, "text"):
                body, offsets = common.raw(texts)
                body = common.LOWER[body]
                starts, ends, before = common.word_spans(body, offsets)
                hashes = np.insert(common.span_hashes(body, starts, ends), before[1:], END)
                ids, held = part.column("doc_id"), part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                rows.append((hashes, np.diff(before) + 1, ids, held))
                if sum(len(r[0]) for r in rows) >= most:
                    yield block()
        if rows:
            yield block()

    return run


def _ask_words(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, words in zip(*[batch.column(c) for c in ("block", "n_words", "words")], strict=True):
                gaps, counts = _unpack(words.as_py(), n.as_py(), 2)
                words = np.cumsum(gaps).view(np.uint64)
                yield _packs(block.as_py(), _word_shard(words, shards), shards, words, counts)

    return run


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    """Grows with the hash."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _reply_words(asked: pa.Table) -> pa.Table:
    """Each asked word's place among the shard's words, and its count. Facts: tokens, words, texts, words that occur 1 to K + 1 times, places."""
    words, counts = _asked(asked, 2)
    words = words.view(np.uint64)
    order = np.argsort(words, kind="stable")
    first = np.diff(words[order], prepend=~words[order[0]]) != 0
    total = np.add.reduceat(counts[order], np.flatnonzero(first))
    place, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    place[order] = np.cumsum(first) - 1
    count[order] = total[place[order]]
    texts = int(counts[words == END].sum())
    return _replies(asked, lambda i, j: (_gaps(place[i:j]), count[i:j]), [int(total.sum()), int((total > 0).sum()), texts, *_few(total), len(total)])


def _name_words(bits: int) -> Callable:
    """The block's texts with the ids and counts of their words; ids: the shard's number, then the place in it (bits)."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        got = sorted(replies.to_pylist(), key=lambda r: r["p"])
        parts = [_unpack(r["data"], r["n"], 2) for r in got]
        ids = np.concatenate([(r["p"] << bits) + np.cumsum(x[0]) + START + 1 for r, x in zip(got, parts, strict=True)])
        known = pa.array([_pack(_gaps(ids), np.concatenate([x[1] for x in parts]))], pa.binary())
        return texts.set_column(texts.schema.get_field_index("words"), "words", known)

    return run


class _Block:
    """A block read back: its distinct pairs of words, and which of them are asked for, in which order."""

    def __init__(self, batch: pa.RecordBatch, row: int, shards: int) -> None:
        self.number, self.doc_ids = batch.column("block")[row].as_py(), batch.column("ids")[row].values
        self.sizes = batch.column("sizes")[row].values.to_numpy().astype(np.int64)
        self.held = batch.column("held")[row].values.to_numpy(zero_copy_only=False).astype(bool)
        self.toks = _unpack(batch.column("toks")[row].as_py(), int(self.sizes.sum()), 1)[0]
        width = batch.column("n_words")[row].as_py()
        gaps, self.counts = _unpack(batch.column("words")[row].as_py(), width, 2)
        self.ids = np.where(self.counts > 0, np.cumsum(gaps), -1)
        before = np.concatenate([[-1], self.toks[:-1]])
        before[np.cumsum(self.sizes) - self.sizes] = -1
        pairs, self.which = np.unique((before + 1) * width + self.toks, return_inverse=True)
        self.v, self.w = pairs // width - 1, pairs % width  # v: -1 at a text's start
        self.v_id = np.where(self.v < 0, START, self.ids[self.v])
        w_id = self.ids[self.w]
        asked = np.flatnonzero((self.v_id >= 0) & (w_id >= 0))
        mixed = common.mix64(common.mix64(self.v_id[asked].view(np.uint64)) ^ w_id[asked].view(np.uint64))
        shard = (mixed % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((w_id[asked], self.v_id[asked], shard))
        self.asked, self.shard = asked[order], shard[order]
        self.w_id = w_id[self.asked]


def _ask_pairs(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = _Block(batch, row, shards)
                counts = np.bincount(b.which, weights=np.repeat(~b.held, b.sizes), minlength=len(b.v)).astype(np.int64)[b.asked]
                yield _packs(b.number, b.shard, shards, b.v_id[b.asked], b.w_id, counts)

    return run


def _reply_pairs(asked: pa.Table) -> pa.Table:
    """Twice each asked pair's count, one more in the block that adds the pair to its context. Facts: pairs that occur 1 to K + 1 times."""
    v, w, c = _asked(asked, 3)
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    first = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
    del v, w
    total = np.add.reduceat(c[order], np.flatnonzero(first))
    each = total[np.cumsum(first) - 1]
    out = np.empty(len(c), np.int64)
    out[order] = 2 * each + (first & (each > 0))
    return _replies(asked, lambda i, j: (out[i:j],), _few(total))


def _lists(lengths: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _score(shards: int, uni: Unigrams, d2: list[float]) -> Callable:
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(block.combine_chunks().to_batches()[0], 0, shards)
        n_docs, n_pairs, width = len(b.sizes), len(b.v), len(b.ids) + 1
        got = sorted(replies.to_pylist(), key=lambda r: r["p"])
        reply = np.zeros(n_pairs, np.int64)
        if got:
            reply[b.asked] = np.concatenate([_unpack(r["data"], r["n"], 1)[0] for r in got])
        count, adds = reply >> 1, (reply & 1).astype(bool)
        context = np.where(b.v < 0, uni.texts, b.counts[b.v])  # tokens after v
        kept = _discounted(count, d2)
        with np.errstate(divide="ignore", invalid="ignore"):
            p1 = np.where(b.counts > 0, _discounted(b.counts, uni.d) / uni.norm, uni.unseen)
            log = np.where(count > 0, np.log10(kept / context), np.log10(p1)[b.w])
            base = np.log10((b.counts + 1) / (uni.total + uni.words + 1))
        doc = np.repeat(np.arange(n_docs), b.sizes)
        sums = lambda x: np.bincount(doc, weights=x, minlength=n_docs)

        # contexts that a document's tokens back off from, and those that may have no count up to K
        low = np.zeros(width, bool)
        low[b.v[(count > 0) & (count <= K)] + 1] = True
        tight = (count > 0) & ~low[b.v + 1]
        known = (count == 0) & (context > 0)
        tokens = np.flatnonzero((tight | known)[b.which])
        at, k = np.unique(doc[tokens] * width + b.v[b.which[tokens]] + 1, return_inverse=True)
        unseen = np.bincount(k, weights=known[b.which[tokens]], minlength=len(at)).astype(np.int64)
        seen = np.bincount(k, minlength=len(at)).astype(np.int64) - unseen
        id_of = np.concatenate([[START], b.ids])
        backed = _lists(np.bincount(at // width, minlength=n_docs), {"v": id_of[at % width], "unseen": unseen, "seen": seen})

        of = np.unique(b.v[adds] + 1)
        total = lambda x: np.bincount(b.v[adds] + 1, weights=x[adds], minlength=width)[of]
        n_of = np.concatenate([[uni.texts], b.counts])[of]
        weights = _lists(np.array([*[0] * (n_docs - 1), len(of)]), {"v": id_of[of], "n": n_of, "kept": total(kept), "lower": total(p1[b.w])})
        names = ["block", "at", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "part", "backed", "sums"]
        columns = [
            pa.array([b.number] * n_docs, pa.int64()), pa.array(np.arange(n_docs), pa.int32()), b.doc_ids, pa.array(b.held),
            pa.array(b.sizes), pa.array(sums((b.counts > 0)[b.toks]).astype(np.int64)), pa.array(sums(base[b.toks])), pa.array(sums(log[b.which])), backed, weights,
        ]
        return pa.table(columns, names=names)

    return run


def _unigrams(n: int, v: int, t: int, *few: int) -> Unigrams:
    d = _factors(dict(enumerate(few, 1)))
    freed = sum(few[r - 1] * r * (1 - d[r]) for r in range(1, K + 1)) or 1.0
    norm = n + (0.0 if any(few[:K]) else 1.0)
    return Unigrams(n, v, t, d, float(norm), freed / norm)


def _facts(replies: DataFrame, n: int) -> list[int]:
    """The sums of the shards' facts, and the largest of the last one."""
    facts = replies.filter("facts is not null")
    row = facts.agg(*[F.sum(F.col("facts")[k]) for k in range(n)], F.max(F.col("facts")[n - 1])).first()
    return [int(x or 0) for x in row]


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = FOLD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    texts = common.materialize(rows.mapInArrow(_blocks(block_tokens), _TEXTS), "texts")
    n_tokens = texts.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0]
    shards = max(MIN_SHARDS, -(-n_tokens // SHARD_TOKENS))

    words = common.materialize(texts.mapInArrow(_ask_words(shards), _ASKED).groupBy("p").applyInArrow(_reply_words, _REPLY), "unigrams", arrow_rows=4)
    *facts, _, places = _facts(words, K + 5)
    uni = _unigrams(*facts)
    named = texts.groupBy("block").cogroup(words.filter("block is not null").groupBy("block")).applyInArrow(_name_words(places.bit_length()), _TEXTS)
    full = common.materialize(named, "blocks", arrow_rows=4)
    common.discard(texts, words)
    replies = common.materialize(full.mapInArrow(_ask_pairs(shards), _ASKED).groupBy("p").applyInArrow(_reply_pairs, _REPLY), "bigrams", arrow_rows=4)
    d2 = _factors(dict(enumerate(_facts(replies, K + 1)[: K + 1], 1)))
    scored = full.groupBy("block").cogroup(replies.filter("block is not null").groupBy("block")).applyInArrow(_score(shards, uni, d2), _SCORED)
    scored = common.materialize(scored, "scored", arrow_rows=4)
    common.discard(full, replies)

    weights = scored.select(F.explode("sums").alias("x")).select("x.*").groupBy("v").agg(F.max("n").alias("n"), F.sum("kept").alias("kept"), F.sum("lower").alias("lower"))
    n = F.col("n") + (F.col("kept") == F.col("n")).cast("int")
    a = F.log10((1 - F.col("kept") / n) / F.greatest(1 - F.col("lower"), F.lit(1e-300)))
    weights = common.materialize(weights.select("v", a.alias("a"), F.log10(F.col("n") / n).alias("shift")), "contexts")
    backed = scored.select("block", "at", F.explode("backed").alias("x")).select("block", "at", "x.*")
    backed = common.join_unique(backed, weights, "v").groupBy("block", "at")
    backed = backed.agg(F.sum(F.col("unseen") * F.coalesce("a", F.lit(0.0)) + F.col("seen") * F.coalesce("shift", F.lit(0.0))).alias("rest"))
    score = (lambda c: F.lit(0.0)) if uni.total == 0 else (lambda c: c)
    out = scored.drop("backed", "sums").join(backed, ["block", "at"], "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"),
        score(F.col("base_score")).alias("base_score"), score(F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_katz": op5_katz}
ORACLES: dict[str, str] = {}
