"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits. A mask is a pattern of 1 (compared) and 0 (ignored)
token positions; every placement of every mask on the benchmark items and on the documents is hashed
over its compared tokens, so a hit survives substitutions at the ignored ones. Hits are joined on
the hash, and each is verified around its place: the item is laid along the document's tokens
near the hit, matching tokens score +1, others -PENALTY, and the best run must reach
min(MIN_SCORE, tokens of the item). Everything is DataFrame expressions in one pass over the texts:
a fixed-size bit table of the benchmark's hashes drops most placements inside the row, so only
likely hits, each with its bit of context (as long as the longest item on either side), become rows; no text is
shuffled. Items with fewer tokens than a mask spans are looked for as they are, every token compared.

Edge cases: null and empty texts have no tokens, so neither match nor are matched. Repeated rows are
judged alike. Rows with a null id are judged too; for items, a null item_id is kept as such. Empty
tables give clean documents, or no rows. Columns other than ids and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

#: Spans of at most 11 tokens, six compared.
MASKS = ("1101000111", "10110010011")
MIN_SCORE = 10
PENALTY = 2
#: Bits of the table that placements are first held against; more hashes than bits only cost time.
TABLE_BITS = 1 << 20
#: Benchmark sides of at most so many bytes are broadcast.
BROADCAST_BYTES = 16 << 20


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def _placement(hashed: Column, k: int, ones: list[int], span: int):
    return lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get(hashed, i + o) for o in ones]).alias("h"), i.alias("at"), F.lit(span).alias("span"))


def placements(hashed: Column, masks=MASKS) -> Column:
    """array<struct<h, at, span>>: the hash of every placement of every mask; hashed: array of token hashes."""
    parts = []
    for k, mask in enumerate(masks):
        ones = [i for i, x in enumerate(mask) if x == "1"]
        last = F.size(hashed) - len(mask)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _placement(hashed, k, ones, len(mask))))
    return F.concat(*parts)


def _bit_table(hashes: DataFrame, bits: int) -> Column:
    """A constant array of longs with the bit of every hash set."""
    slot = F.pmod("h", F.lit(bits))
    rows = hashes.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("b")).collect()  # bits / 64 rows at most
    words = [0] * (bits // 64)
    for r in rows:
        words[r.word] = r.b
    return F.from_json(F.lit(str(words)), "array<bigint>")


def _sized(df: DataFrame, row_bytes) -> DataFrame:
    total = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def find_overlaps(docs: DataFrame, items: DataFrame, *, key: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks=MASKS, min_score: int = MIN_SCORE, penalty: int = PENALTY, table_bits: int = TABLE_BITS) -> DataFrame:
    """Verified overlaps: key columns, item_id, score (best run), n_hits. key: columns that name a document."""
    bench = items.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("toks")).filter(F.size("toks") > 0)
    bench = common.materialize(bench.withColumn("item", F.xxhash64("item_id", "toks")).dropDuplicates(["item"]), "items")
    span = min(map(len, masks))
    reach = bench.agg(F.max(F.size("toks"))).first()[0] or 0
    lengths = [r[0] for r in bench.select(F.size("toks").alias("n")).filter(F.col("n") < span).distinct().collect()]  # fewer than a mask spans
    masks = (*masks, *["1" * n for n in sorted(lengths)])
    hashed = F.transform("toks", lambda t: F.xxhash64(t))
    spread = bench.withColumn("hashed", hashed).select("item", F.size("toks").alias("n"), F.explode(placements(F.col("hashed"), masks)).alias("p"))
    seeds = spread.filter((F.col("p.span") >= span) | (F.col("p.span") == F.col("n"))).select("item", "p.h", F.col("p.at").alias("item_at"))
    seeds = common.materialize(seeds, "seeds")
    table = _bit_table(seeds, table_bits)

    toks = docs.select(*[F.col(c) for c in key], tokens(F.col(text_col)).alias("toks"))
    toks = toks.withColumn("hashed", hashed)
    slot = lambda h: F.pmod(h, F.lit(table_bits))
    likely = F.filter(placements(F.col("hashed"), masks), lambda p: F.getbit(F.get(table, F.floor(slot(p["h"]) / 64).cast("int")), F.pmod(slot(p["h"]), F.lit(64)).cast("int")) == 1)
    near = F.transform(likely, lambda p: F.struct(p["h"].alias("h"), p["at"].alias("at"), F.greatest(F.lit(0), p["at"] - reach).alias("lo"), F.slice("toks", F.greatest(F.lit(0), p["at"] - reach) + 1, 2 * reach + 1).alias("around")))
    hits = toks.select(*key, F.explode(near).alias("p")).select(*key, "p.*")
    hits = hits.join(_sized(seeds, F.lit(24)), "h").join(_sized(bench, 24 + F.length(F.array_join("toks", " ")) + 16 * F.size("toks")), "item")
    # token k of the window stands against token k + lo - at + item_at of the item
    shift = F.col("lo") - F.col("at") + F.col("item_at")
    first, last = F.greatest(F.lit(0), -shift), F.least(F.size("around"), F.size("toks") - shift) - 1
    best = F.aggregate(
        F.sequence(first, last),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, k: _step(acc, F.get("around", k) == F.get("toks", k + shift), penalty),
        lambda acc: acc["best"],
    )
    scored = hits.withColumn("score", best).filter(F.col("score") >= F.least(F.lit(min_score), F.size("toks")))
    return scored.groupBy(*key, "item_id").agg(F.max("score").alias("score"), F.count("*").alias("n_hits"))


def _step(acc: Column, same: Column, penalty: int) -> Column:
    run = F.greatest(F.lit(0), acc["run"] + F.when(same, 1).otherwise(-penalty))
    return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))


def mark_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **kw) -> DataFrame:
    """One row per document: the kept columns, contaminated, n_items, items (sorted ids), score (the best)."""
    keep = [id_col] if keep is None else keep
    named = docs.select(*keep, F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"))
    found = find_overlaps(docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__body")), items, key=["__id", "__text"], text_col="__body", **kw)
    found = found.groupBy(F.col("__id").alias("__i"), F.col("__text").alias("__t")).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"), F.max("score").alias("score"))
    out = named.join(found, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left")
    return out.select(*keep, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array()).alias("items"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def contaminated_keys(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(i, t): id and text hash of the documents with a verified overlap."""
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("body"))
    return find_overlaps(rows, items, key=["i", "t"], text_col="body", **kw).select("i", "t").distinct()


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES: dict[str, str] = {}
