"""Exact substring deduplication with suffix arrays built by induced sorting.

Every LENGTH-byte string has an anchor: the leftmost smallest hash among its GRAM-byte grams, which depends
on its bytes alone. Equal strings have equal anchors, so strings are dealt to shards by anchor: the bytes of all
strings of a text that one anchor stands for are a context. Contexts are first compared as wholes, by digest, those of
an anchor together: a text whose context also stands in a text with a smaller id loses all of it, and only one context of
each kind, from the smallest id, goes on, and only where an anchor has several kinds, from several ids. A shard's
distinct contexts are concatenated; suffixes are classified, the leftmost-smaller (LMS) substrings
sorted by induction and named, the string of their names sorted in the same way, recursively, and the array induced
from it (vectorised, linear in the shard). Permuted common prefixes are computed at the irreducible
places and carried on elsewhere; runs of suffixes that share LENGTH bytes give the smallest document id
of each string, and a string that a smaller id has is cut from the others, all of it.

Anchors with more than HOT kinds of contexts (the edges of a passage that many texts have) are dealt string by string
instead. Which anchors, contexts and texts matter is told by filters, which grow with the input up to MOST_BITS; what
these let pass needlessly costs time only. Texts that several rows have are represented by the smallest id; the others are
covered throughout.

Edge cases: null and empty texts have no bytes and nothing removed; texts under LENGTH bytes lose nothing.
Rows with the same id never cut each other. A null id counts as the largest. Repeated rows get the same
result. Cuts may fall inside a UTF-8 character; kept bytes are returned as binary. Other columns are not
looked at. Texts are told apart by 128 bits of hashes (by 64 where their places are collected), contexts by 64 bits besides those
of their anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

LENGTH = 50
GRAM = 24
#: Bytes of distinct contexts that one suffix array is built over.
SHARD_BYTES = 3 << 18
#: Kinds of contexts above which an anchor's strings are dealt one by one.
HOT = 1 << 14
_CHUNK = 1 << 21
#: Anchors are sought in slices of about so many bytes: an array of their hashes is eight times that.
_SLICE = 1 << 17
#: Anchors travel in 2^PACK_BITS packs, of 32 bits each besides.
PACK_BITS = 12
_CONTEXT = ["anchor", "digest", "rank", "own", "first", "size"]
_LAST = (1 << 63) - 1

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


# suffix arrays

def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the empty suffix counts as the smallest."""
    n = len(t)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


def _by_bucket(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by c; of each run of equal values in it, the value, start and length."""
    order = np.argsort(c, kind="stable")
    along = c[order]
    new = np.empty(len(c), bool)
    new[0] = True
    np.not_equal(along[1:], along[:-1], out=new[1:])
    starts = new.nonzero()[0]
    many = np.empty(len(starts), np.int64)
    many[-1] = len(c) - starts[-1]
    np.subtract(starts[1:], starts[:-1], out=many[:-1])
    return order, along[starts], starts, many


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in (some) order.

    The array is scanned in blocks. A block induces what stands before its suffixes; it ends where the first of
    these falls, so that it never reads a place that it writes.
    """
    n = len(t)
    count = np.arange(n, dtype=np.int32)
    size = np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    out = np.full(n, -1, np.int32)
    if len(lms):
        order, c, starts, many = _by_bucket(t[lms])
        out[np.repeat(end[c] - many - starts, many) + count[: len(lms)]] = lms[order]
    head = end - size
    out[head[t[-1]]] = n - 1  # what stands before the empty suffix
    head[t[-1]] += 1
    i, step = 0, 1 << 12
    while i < n:
        j = min(n, i + step)
        p = out[i:j] - 1
        at = ((p >= 0) & ~small[p]).nonzero()[0]
        step = min(2 * step, 1 << 18)
        if len(at):
            p = p[at]
            chars = t[p]
            if (first := int(head[chars.min()])) < j:
                step, j = max(256, 2 * (first - i)), first
                k = int(np.searchsorted(at, first - i))
                p, chars = p[:k], chars[:k]
            order, c, starts, many = _by_bucket(chars)
            out[np.repeat(head[c] - starts, many) + count[: len(p)]] = p[order]
            head[c] += many
        i = j
    out[small[out] & (out >= 0)] = -1
    i, step = n, 1 << 12
    while i > 0:
        j = max(0, i - step)
        p = out[j:i][::-1] - 1  # from the right
        at = ((p >= 0) & small[p]).nonzero()[0]
        step = min(2 * step, 1 << 18)
        if len(at):
            p = p[at]
            chars = t[p]
            if (last := int(end[chars.max()]) - 1) >= j:
                step, j = max(256, 2 * (i - 1 - last)), last + 1
                k = int(np.searchsorted(at, i - 1 - last))
                p, chars = p[:k], chars[:k]
            order, c, starts, many = _by_bucket(chars)
            out[np.repeat(end[c] - 1 + starts, many) - count[: len(p)]] = p[order]
            end[c] -= many
        i = j
    return out


def suffix_array(t: np.ndarray, sigma: int = 257) -> np.ndarray:
    """The order of all suffixes of t (values under sigma)."""
    if len(t) == 0:
        return np.empty(0, np.int64)
    t = t.astype(np.uint16 if sigma <= 1 << 16 else np.int32)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        first = _induce(t, small, lms, sigma)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        by_substring = first[is_lms[first]]
        ends = np.minimum(np.concatenate([lms[1:], [len(t) - 1]]) + 1, len(t))
        values = common.span_hashes(t, lms, ends)
        number = np.empty(len(t), np.int64)
        number[lms] = np.arange(len(lms))
        along = values[number[by_substring]]
        names = np.empty(len(lms), np.int64)
        names[number[by_substring]] = np.concatenate([[0], np.cumsum(along[1:] != along[:-1])])
        most = int(names.max())
        lms = lms[suffix_array(names, most + 1)] if most < len(lms) - 1 else by_substring
    return _induce(t, small, lms, sigma)


def permuted_lcp(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place, the bytes its suffix shares with the one before it in order (right up to `most`, less the places since
    the last separator, 0: a value is carried on no further, as shared bytes may run over many contexts)."""
    n = len(t)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    place = np.arange(n, dtype=np.int32)
    plain = np.zeros(n, bool)
    inner = (place > 0) & (phi > 0)
    plain[inner] = (t[place[inner] - 1] == t[phi[inner] - 1]) & (t[place[inner] - 1] != 0)
    plain &= phi >= 0
    own = np.flatnonzero(~plain & (phi >= 0))
    length = np.zeros(len(own), np.int32)
    live = np.arange(len(own))
    a, b = own.copy(), phi[own]
    while len(live) and len(live) and length[live].max() < most:
        ok = (a[live] < n) & (b[live] < n)
        live = live[ok]
        same = t[a[live]] == t[b[live]]
        live = live[same]
        a[live] += 1
        b[live] += 1
        length[live] += 1
    value = np.zeros(n, np.int32)
    value[own] = length
    source = np.maximum.accumulate(np.where(plain, 0, place))
    return np.maximum(0, value[source] - (place - source))


# anchors

def anchor_runs(body: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: text number, first and last start (in the text), anchor hash."""
    w = length - gram + 1
    texts, firsts, lasts, hashes = [], [], [], []
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for base in range(0, max(1, len(body)), _CHUNK):
        part = body[base : base + _CHUNK + length - 1]
        if len(part) < length:
            break
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(part),), "<u8", padded, 0, (1,))
        m = len(part) - gram + 1
        h = common.mix64(eight[:m] * np.uint64(0x9E3779B97F4A7C15) ^ common.mix64(eight[gram - 8 : gram - 8 + m]))
        low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(m, dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: m - w + 1], low[w - span : w - span + m - w + 1])
        start = np.arange(len(low)) + base
        text = owner[base : base + len(low)]
        good = start + length <= offsets[text + 1]
        start, text, at = start[good], text[good], (low[good] & np.uint64((1 << 24) - 1)).astype(np.int64)
        if not len(start):
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
        i = np.flatnonzero(new)
        j = np.concatenate([i[1:], [len(start)]]) - 1
        texts.append(text[i])
        firsts.append(start[i] - offsets[text[i]])
        lasts.append(start[j] - offsets[text[i]])
        hashes.append(h[at[i]])
    if not texts:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    return np.concatenate(texts), np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int, chosen):
    """Of each slice of the chosen texts: the rows, bytes, and of every run its text, start and end in the bytes, start in the text, anchor."""
    for batch in batches:
        own = batch.filter(pa.array(common.passing(batch.column("own"), chosen)))
        for rows, texts in common.slices(own, "text", _SLICE):
            body, offsets = common.raw(texts)
            text, first, last, h = anchor_runs(body, offsets, length, gram)
            yield rows, body, text, offsets[text] + first, offsets[text] + last + length, first, h.view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, chosen) -> Iterator[pa.RecordBatch]:
    """The anchors of the chosen texts, once for each text, in packs: PACK_BITS name the pack, 32 bits are in it, sorted."""

    def full() -> pa.RecordBatch:
        value = np.sort(np.concatenate(held))
        pack = (value >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]]))
        low = value.astype("<u4").tobytes()
        ends = [*starts[1:].tolist(), len(value)]
        return pa.RecordBatch.from_arrays([pa.array(pack[starts]), pa.array([low[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary())], ["pack", "low"])

    held, many = [], 0
    for _, _, text, _, _, _, h in _runs(batches, length, gram, chosen):
        if not len(h):
            continue
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        held.append(h[new].view(np.uint64) & np.uint64((1 << (32 + PACK_BITS)) - 1))
        many += len(held[-1])
        if many >= 1 << 21:
            yield full()
            held, many = [], 0
    if many:
        yield full()


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pack: what stands in a pack twice or more."""

    def full() -> pa.RecordBatch:
        value = np.sort(np.concatenate(held))
        again = value[1:][value[1:] == value[:-1]]
        again = again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again
        return pa.RecordBatch.from_arrays([pa.array(again.astype(np.int64))], ["h"])

    held, current = [], None
    for batch in batches:
        for pack, low in zip(batch.column("pack").to_pylist(), batch.column("low"), strict=True):
            if pack != current and held:
                yield full()
                held = []
            current = pack
            held.append(np.frombuffer(low.as_py(), "<u4"))
    if held:
        yield full()


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int, chosen, shared) -> Iterator[pa.RecordBatch]:
    """The contexts of the anchors that pass, by digest."""
    for rows, body, text, start, stop, first, h in _runs(batches, length, gram, chosen):
        good = common.passing(h, shared)
        text, start, stop, first, h = text[good], start[good], stop[good], first[good], h[good]
        owner = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(common.span_hashes(body, start, stop).view(np.int64)), rows.column("rank").take(owner), rows.column("own").take(owner), pa.array(first), pa.array(stop - start)], _CONTEXT)


def _settle(batches: Iterator[pa.RecordBatch], hot: int, few: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor, digest and rank. Of each context that a smaller id has too: the place (own, x, y).
    Of anchors that have several kinds of contexts, from several ids: kinds (h, by the smallest id), and the hot anchors (split)."""

    def settled(anchor, digest, rank, own, first, size, ended: bool):
        """The rows told, and the kinds of the last anchor (unless ended), which may go on."""
        step = np.ones(len(anchor), bool)
        step[1:] = anchor[1:] != anchor[:-1]
        new = step.copy()
        new[1:] |= digest[1:] != digest[:-1]
        kind = np.flatnonzero(new)
        cut = np.flatnonzero(rank > np.repeat(rank[kind], np.diff(np.append(kind, len(anchor)))))
        group = np.flatnonzero(step[kind])  # where anchors begin among the kinds
        many = np.diff(np.append(group, len(kind)))
        going = (np.maximum.reduceat(rank[kind], group) > np.minimum.reduceat(rank[kind], group)) & (ended | (np.arange(len(group)) < len(group) - 1))
        wanted = kind[np.repeat(going, many)]
        split = anchor[kind[group[going & (many > hot)]]]
        parts = [own[cut], first[cut], first[cut] + size[cut]], [(anchor ^ digest ^ rank)[wanted]], [split]
        columns, total = [], len(cut) + len(wanted) + len(split)
        for at, own_part in zip((0, len(cut), len(cut) + len(wanted)), parts, strict=True):
            for x in own_part:
                columns.append(pa.concat_arrays([pa.nulls(at, pa.int64()), pa.array(x), pa.nulls(total - at - len(x), pa.int64())]))
        told = pa.RecordBatch.from_arrays(columns, ["own", "x", "y", "h", "split"])
        return told, [x[kind[group[-1] :]] for x in (anchor, digest, rank, own, first, size)]

    held, rows, least = [], 0, few
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in _CONTEXT])
        rows += batch.num_rows
        if rows >= least:
            told, rest = settled(*map(np.concatenate, zip(*held, strict=True)), False)
            held, rows = [rest], len(rest[0])
            least = max(few, 2 * rows)
            yield told
    if rows:
        yield settled(*map(np.concatenate, zip(*held, strict=True)), True)[0]


def _pieces(batches: Iterator[pa.RecordBatch], length: int, gram: int, chosen, wanted, split) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that pass, once for each text, with the places (first, more) where it has them; of hot
    anchors, each string by itself."""
    for rows, body, text, start, stop, first, h in _runs(batches, length, gram, chosen):
        digest, rank, own = common.span_hashes(body, start, stop).view(np.int64), rows.column("rank").to_numpy()[text], rows.column("own").to_numpy()[text]
        take = np.flatnonzero(common.passing(h ^ digest ^ rank, wanted))
        if not len(take):
            continue
        take = take[np.lexsort((first[take], digest[take], h[take], text[take]))]
        new = np.ones(len(take), bool)
        new[1:] = np.any([x[take[1:]] != x[take[:-1]] for x in (text, h, digest)], axis=0)
        groups, take = np.split(first[take], np.flatnonzero(new)[1:]), take[new]
        start, stop, first, h, rank, own = start[take], stop[take], first[take], h[take], rank[take], own[take]
        hot = common.passing(h, split)
        many = np.where(hot, stop - start - length + 1, 1)
        row = np.repeat(np.arange(len(take)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = start[row] + at
        stop = np.where(hot[row], start + length, stop[row])
        key = np.where(hot[row], common.span_hashes(body, start, stop).view(np.int64), h[row])
        data = body.tobytes()
        for a in range(0, len(row), 1 << 14):
            z = slice(a, a + (1 << 14))
            piece = pa.array([data[x:y] for x, y in zip(start[z].tolist(), stop[z].tolist(), strict=True)], pa.binary())
            more = pa.array([(groups[r][1:] + k).tolist() if len(groups[r]) > 1 else None for r, k in zip(row[z].tolist(), at[z].tolist(), strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key[z]), pa.array(rank[row[z]]), pa.array(own[row[z]]), pa.array(first[row[z]] + at[z]), more, piece], ["key", "rank", "own", "first", "more", "piece"])


def shard_minima(contexts: list[bytes], ranks: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context (with the least rank that has it), the least rank of each of its strings."""
    sizes = np.array([len(x) for x in contexts])
    t = np.frombuffer(b"".join(x + b"\0" for x in contexts), np.uint8).astype(np.uint16) + 1
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    t[edges[1:] - 1] = 0
    order = suffix_array(t)
    shared = permuted_lcp(t, order, 2 * length)[order]
    owner = np.searchsorted(edges, order, "right") - 1
    valid = order + length <= edges[owner] + sizes[owner]
    order, owner = order[valid], owner[valid]
    # a suffix too short to hold a string sorts between others only where they differ: least over what lies between
    where = np.flatnonzero(valid)
    least = np.minimum.reduceat(np.concatenate([shared, [0]]), np.stack([where[:-1] + 1, where[1:] + 1], 1).ravel())[::2] if len(where) > 1 else np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], least < length]))
    best = np.minimum.reduceat(np.array(ranks)[owner], starts)
    value = np.empty(len(t), np.int64)
    value[order] = np.repeat(best, np.diff(np.concatenate([starts, [len(order)]])))
    return [value[a : a + n - length + 1] for a, n in zip(edges[:-1].tolist(), sizes.tolist(), strict=True)]


def _resolve(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, piece and rank: the places (own, x, y) of what smaller ids have of each context.
    A key's pieces stay in one shard; the later rows of a piece are settled as they come."""
    pieces: list[bytes] = []
    rows: list[tuple[int, int, int, list[int] | None]] = []
    held, start, current, before = 0, 0, None, None
    done: list[tuple] = []

    def full() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 3
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["own", "x", "y"])

    def flush() -> None:
        if len(pieces) > 1:
            least = shard_minima(pieces, [r[0] for r in rows], length)
            for (rank, own, first, more), own_least in zip(rows, least, strict=True):
                hit = np.flatnonzero(own_least < rank)
                if len(hit):
                    for part in np.split(hit, np.flatnonzero(np.diff(hit) > length) + 1):
                        for at in (first, *(more or ())):
                            done.append((own, at + int(part[0]), at + int(part[-1]) + length))

    for batch in batches:
        for key, rank, own, first, more, piece in zip(*[batch.column(c).to_pylist() for c in ("key", "rank", "own", "first", "more", "piece")], strict=True):
            if key != current:
                if len(pieces) == start + 1:  # nothing to compare it with
                    held -= len(pieces.pop()) + 1
                    rows.pop()
                if held >= most:
                    flush()
                    pieces, rows, held = [], [], 0
                current, before, start = key, None, len(pieces)
            if piece == before:
                if rank > rows[-1][0]:
                    for at in (first, *(more or ())):
                        done.append((own, at, at + len(piece)))
                    continue
            before = piece
            pieces.append(piece)
            rows.append((rank, own, first, more))
            held += len(piece) + 1
        if len(done) >= 1 << 16:
            yield full()
    flush()
    yield full()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by own and x: of each text the runs that its places make up, touching ones joined."""
    kind = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))
    names: list[int] = []
    spans: list[list[dict]] = []
    for batch in batches:
        for own, x, y in zip(*[batch.column(c).to_pylist() for c in ("own", "x", "y")], strict=True):
            if not names or own != names[-1]:
                if len(names) >= 1 << 12:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(spans, kind)], ["own", "spans"])
                    names, spans = [], []
                names.append(own)
                spans.append([{"x": x, "y": y}])
            elif x > (last := spans[-1][-1])["y"]:
                spans[-1].append({"x": x, "y": y})
            else:
                last["y"] = max(last["y"], y)
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(spans, kind)], ["own", "spans"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in common.slices(batch, "text"):
            columns: list[list] = [[], [], [], []]
            for text, copy, spans in zip(texts, rows.column("copy").to_pylist(), rows.column("spans").to_pylist(), strict=True):
                data, last, parts, n = text.as_py(), 0, [], 0
                found = [(0, len(data))] if copy and len(data) >= length else sorted((x["x"], x["y"]) for x in spans or ())
                for a, b in found:
                    if a > last or n == 0:
                        n += 1
                        parts.append(data[last:a])
                    last = max(last, b)
                parts.append(data[last:])
                kept = b"".join(parts)
                for column, value in zip(columns, (len(data), len(data) - len(kept), n, kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(x, pa.int64()) for x in columns[:3]], pa.array(columns[3], pa.binary())], [x.split()[0] for x in SCHEMA.split(", ")])


def _passing(batches: Iterator[pa.RecordBatch], touched, wanted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(common.passing(batch.column("own"), touched) == wanted))


def covered_spans(rows: DataFrame, classes: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(own, spans): for each text with any, by the hash of its cls and rank, the runs (x, y) of it that smaller ids have.
    rows: cls, rank, text; classes: cls, least (the smallest rank), n_bytes. A filter may let rows pass besides those of classes."""
    # about one anchor in 14 bytes, a third of them shared
    bits = common.filter_bits((classes.agg(F.sum("n_bytes")).first()[0] or 0) // 14)
    chosen = common.bit_filter(classes.select(F.xxhash64("cls", "least").alias("h")), bits)
    texts = rows.select("rank", "text", F.xxhash64("cls", "rank").alias("own"))
    anchors = texts.mapInArrow(lambda it: _anchors(it, length, gram, chosen), "pack int, low binary").repartition("pack").sortWithinPartitions("pack")
    shared = common.bit_filter(anchors.mapInArrow(_twice, "h long"), bits)
    met = texts.mapInArrow(lambda it: _contexts(it, length, gram, chosen, shared), ", ".join(f"{x} long" for x in _CONTEXT))
    met = met.repartition("anchor").sortWithinPartitions("anchor", "digest", "rank")
    settled = common.materialize(met.mapInArrow(lambda it: _settle(it, hot), "own long, x long, y long, h long, split long"), "settled")
    wanted = common.bit_filter(settled.filter("h is not null").select("h"), bits)
    split = common.bit_filter(settled.filter("split is not null").select(F.col("split").alias("h")))  # a filter of its own: few pass needlessly
    pieces = texts.mapInArrow(lambda it: _pieces(it, length, gram, chosen, wanted, split), "key long, rank long, own long, first long, more array<long>, piece binary")
    dealt = pieces.repartition("key").sortWithinPartitions("key", "piece", "rank")
    partly = common.materialize(dealt.mapInArrow(lambda it: _resolve(it, length, shard_bytes), "own long, x long, y long"), "partly")
    places = settled.filter("own is not null").select("own", "x", "y").unionAll(partly)
    spans = common.materialize(places.repartition("own").sortWithinPartitions("own", "x").mapInArrow(_merge, "own long, spans array<struct<x:bigint,y:bigint>>"), "spans")
    for shown in (chosen, shared, wanted, split):
        shown.destroy()
    common.discard(settled, partly)
    return spans


def dedupe_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """One row per document (SCHEMA), kept being the bytes that no document with a smaller id has in a string of `length`."""
    if not 8 <= gram < length:
        raise ValueError("gram must be 8 at least and under length")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cls = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("rank"), cls.alias("cls"), F.col(text_col).alias("text"))
    classes = rows.groupBy("cls").agg(F.min("rank").alias("least"), F.count("*").alias("copies"), F.max(F.octet_length(text)).alias("n_bytes"))
    classes = common.materialize(classes, "classes")
    spans = covered_spans(rows, classes, length=length, gram=gram, shard_bytes=shard_bytes, hot=hot)
    fate = classes.drop("n_bytes").withColumn("own", F.xxhash64("cls", "least")).join(spans, "own", "left").drop("own")
    fate = common.materialize(fate.filter("copies > 1 or spans is not null"), "fates")
    common.discard(classes, spans)
    touched = common.bit_filter(fate.select(F.xxhash64("cls").alias("h")))
    rows = rows.withColumn("own", F.xxhash64("cls"))
    plain = "doc_id long, rank long, cls struct<a:long,b:long>, text string, own long"
    some = common.join_unique(rows.mapInArrow(lambda it: _passing(it, touched, True), plain), fate, "cls", weight="copies")
    some = some.select("doc_id", "text", F.coalesce(F.col("rank") > F.col("least"), F.lit(False)).alias("copy"), "spans")
    rest = rows.mapInArrow(lambda it: _passing(it, touched, False), plain)
    rest = rest.select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<x:bigint,y:bigint>>").alias("spans"))
    return some.unionAll(rest).mapInArrow(lambda it: _cut(it, length), SCHEMA)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_substrings(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
