r"""Personal data by bootstrapped contextual extraction.

Seeds are matches of four strict forms (email, IPv4, payment card, phone). The two words left of a match
are its lexical pattern. Any other word with a digit is a candidate; patterns and values form a bipartite
graph with counts, which is scored in rounds until no pattern is new: a pattern scores, for a kind, the weighted share of its occurrences whose
values are known to be of that kind, and needs MIN_SUPPORT different values; a candidate value scores the noisy-or of
its patterns and, once scored, supports further patterns. Occurrences of candidates under patterns of
MIN_SCORE at least are added as spans of kind `near_<kind>`; the seeds' spans always stay.

Only DataFrame functions are used. The texts are read once; what they hold (spans, left contexts) is
written as a narrow table, and the graph is pre-aggregated to one row per pattern, value and kind.

Edge cases: a null text is an empty text, without spans. Repeated rows get the same spans (they count
once each as evidence). Positions are code points, ends exclusive. Overlaps between kinds stay; in redaction the
earliest span wins and overlapping ones extend it. Very long runs of one character class are scanned
once (possessive quantifiers). Other columns than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

_W = r"\x20\x09-\x0D"
# The four forms. Possessive, and begun only where a leftmost scan could begin, so that long runs cost linear time.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# In a masked text, the digits, @ and + of seeds stand as these noncharacters, which no text has.
_PLAIN, _MASKED = "0123456789@+", "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4\ufdd5\ufdd6\ufdd7\ufdd8\ufdd9\ufdda\ufddb"
#: A word with a digit, masked or not.
CANDIDATE = rf"(?<![^{_W}])(?=[^{_W}0-9\ufdd0-\ufdd9]*+[0-9\ufdd0-\ufdd9])[^{_W}]++"
#: Characters left of a span that its pattern is taken from; words that don't fit give no pattern.
LEFT = 256
#: Matches that are placed together: a text's spans cost about their number times this, not its square.
BLOCK = 256
#: The rounds end when no pattern is new; more than so many are an error.
MOST_ROUNDS = 20
#: Different values of a kind that a pattern needs, and the share of its occurrences.
MIN_SUPPORT = 3
MIN_SCORE = 0.6

SPAN = "struct<kind:string,start:int,end:int,value:string,left:string>"


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, double(at(i))).otherwise(at(i))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _let(value: Column, then) -> Column:
    """then(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def matches(text: Column, form: str, kind: str) -> Column:
    """array<SPAN>: every match of the form, left to right, with its place and what stands left of it.

    Places are running sums, taken in blocks of BLOCK matches, whose arrays are joined afterwards."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.length(m["part"])
        left = F.right(F.concat(acc["left"], m["part"]), F.lit(LEFT))
        one = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(m["value"])).alias("end"), m["value"].alias("value"), left.alias("left"))
        return F.struct((at + F.length(m["value"])).alias("at"), F.right(F.concat(left, m["value"]), F.lit(LEFT)).alias("left"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(pairs: Column):
        def add(acc: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), acc["left"].alias("left"), none.alias("out")), step)
            return _let(inner, lambda x: F.struct(x["at"].alias("at"), x["left"].alias("left"), F.concat(acc["out"], x["out"]).alias("out")))

        return add

    def placed(found: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, form, -1), F.lit(1), F.size(found)), found, lambda p, v: F.struct(p.alias("part"), v.alias("value")))
        start = F.struct(F.lit(0).alias("at"), F.lit("\n").alias("left"), none.alias("out"))
        all_ = _let(pairs, lambda x: F.aggregate(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), start, block(x), lambda acc: acc["out"]))
        return F.when(F.size(found) > 0, all_).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(form), F.lit(0)), placed)


def _covered(text: Column, form: str, kind: str) -> Column:
    """For each candidate word of the text, whether a valid match of the form reaches into it."""
    hide = lambda p, v: F.concat(p, F.when(v.isNull(), "").when(_valid(kind, v), F.translate(v, _PLAIN, _MASKED)).otherwise(v))
    masked = F.array_join(F.zip_with(F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0)), hide), "")
    return F.transform(F.regexp_extract_all(masked, F.lit(CANDIDATE), F.lit(0)), lambda w: w.rlike("[\ufdd0-\ufddb]"))


def candidates(text: Column, base: Column) -> Column:
    """array<SPAN>: words with a digit that no span of base (of the same text) reaches into."""
    words, flags = matches(text, CANDIDATE, ""), None
    for kind, form in FORMS.items():
        own = F.when(F.size(_of(base, kind)) > 0, _covered(text, form, kind)).otherwise(F.array().cast("array<boolean>"))
        flags = own if flags is None else F.zip_with(flags, own, lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)))
    both = F.zip_with(words, flags, lambda w, hit: F.struct(w.alias("w"), F.coalesce(hit, F.lit(False)).alias("hit")))
    return F.transform(F.filter(both, lambda x: ~x["hit"]), lambda x: x["w"])


def base_spans(text: Column) -> Column:
    """array<SPAN> of the four forms, by kind as listed, then start."""
    none = F.array().cast(f"array<{SPAN}>")
    has = {"email": F.instr(text, "@") > 0, "phone": F.instr(text, "+") > 0}
    digit = text.rlike("[0-9]")
    return F.concat(*[F.when(has.get(k, digit), _checked(matches(text, form, k), k)).otherwise(none) for k, form in FORMS.items()])


def _checked(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: _valid(kind, m["value"]))


def pattern(left: Column) -> Column:
    """The last two words, lower-cased, digits as 0, outer punctuation dropped; null if there are fewer."""
    words = F.regexp_replace(F.regexp_replace(F.lower(left), "[0-9]+", "0"), r"[^\p{L}\p{N}\x20\x09-\x0D]+$", "")
    form = rf"[{_W}]([^{_W}]+)[{_W}]+([^{_W}]+)[{_W}]*$"
    pair = F.regexp_extract(words, form, 1), F.regexp_extract(words, form, 2)
    return F.when(pair[1] != "", F.concat_ws(" ", *pair))


def extract(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, base and candidates (array<SPAN>) of every document: the one pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), text.alias("text"))
    none = F.array().cast(f"array<{SPAN}>")
    rows = rows.select("doc_id", "th", "text", base_spans(F.col("text")).alias("base"))
    free = F.when(F.col("text").rlike("[0-9]"), candidates(F.col("text"), F.col("base"))).otherwise(none)
    return common.materialize(rows.select("doc_id", "th", "base", free.alias("candidates")), "spans")


def learn_patterns(found: DataFrame, *, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """High-confidence patterns: pattern, kind, score."""
    seeds = found.select(F.explode("base").alias("s")).select("s.kind", pattern(F.col("s.left")).alias("pattern"), F.lower("s.value").alias("value"))
    others = found.select(F.explode("candidates").alias("s")).select(F.lit(None).cast("string").alias("kind"), pattern(F.col("s.left")).alias("pattern"), F.lower("s.value").alias("value"))
    graph = seeds.unionAll(others).filter("pattern is not null").groupBy("pattern", "value", "kind").agg(F.count("*").alias("n"))
    graph = common.materialize(graph, "graph")
    totals = graph.groupBy("pattern").agg(F.sum("n").alias("total"))
    known = graph.filter("kind is not null").select("pattern", "value", "n", "kind", F.lit(1.0).alias("weight"))
    patterns, state = None, None
    for _ in range(MOST_ROUNDS):
        scored = known.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("weight")).alias("hit"), F.countDistinct(F.when(F.col("weight") >= 0.5, F.col("value"))).alias("support"))
        scored = scored.filter(F.col("support") >= min_support).join(totals, "pattern").select("pattern", "kind", (F.col("hit") / (F.col("total") + 1)).alias("score")).filter(F.col("score") >= min_score)
        patterns = common.materialize(scored, "patterns")
        now = tuple(patterns.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "kind"))).first())
        if now == state:
            return patterns
        state = now
        free = graph.filter("kind is null").select("pattern", "value", "n")
        values = free.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("weight"))
        found_now = free.join(values, "value").select("pattern", "value", "n", "kind", "weight")
        known = graph.filter("kind is not null").select("pattern", "value", "n", "kind", F.lit(1.0).alias("weight")).unionAll(found_now)
    raise RuntimeError(f"the patterns did not settle in {MOST_ROUNDS} rounds")


def identifier(value: Column) -> Column:
    """Whether a candidate looks like an identifier: five letters or digits, four of them digits."""
    return (F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", "")) >= 5) & (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 4)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), base and more (array<SPAN>), the latter found by patterns."""
    found = extract(docs, id_col=id_col, text_col=text_col)
    patterns = learn_patterns(found, min_support=min_support, min_score=min_score)
    best = patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    core = r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
    new = found.select("doc_id", "th", F.explode("candidates").alias("s")).filter(identifier(F.col("s.value"))).withColumn("pattern", pattern(F.col("s.left"))).join(best, "pattern")
    new = new.withColumn("v", F.regexp_extract("s.value", core, 0)).withColumn("start", F.col("s.start") + F.instr("s.value", F.col("v")) - 1)
    new = new.select("doc_id", "th", F.struct(F.concat(F.lit("near_"), "kind").alias("kind"), F.col("start").cast("int").alias("start"), (F.col("start") + F.length("v")).cast("int").alias("end"), F.col("v").alias("value"), F.col("s.left").alias("left")).alias("s"))
    new = new.groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).agg(F.sort_array(F.collect_set("s")).alias("more"))
    out = found.join(new, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    return out.select("doc_id", "th", "base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")).alias("more"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents, all columns, with every span of the text replaced by its kind in angle brackets. A null text stays null."""
    found = find_personal_data(docs, id_col=id_col, text_col=text_col, **kw).filter("size(base) + size(more) > 0").select(F.col("doc_id").alias("__i"), F.col("th").alias("__t"), F.concat("base", "more").alias("__spans")).dropDuplicates(["__i", "__t"])
    joined = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__i")) & (F.xxhash64(text_col) == F.col("__t")), "left")
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select(*[F.coalesce(done, text).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.table(spark, sf_dir, "documents"))
    counts = [F.size(_of("base", k)).cast("long").alias(f"n_{k}") for k in FORMS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "more")).alias("spans"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))


def _of(column: str, kind: str) -> Column:
    return F.filter(column, lambda s: s["kind"] == kind)


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
