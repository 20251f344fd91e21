"""Benchmark decontamination by template canonicalisation, on DataFrame functions only.

Numbers, names and units become typed placeholders, so a question asked again
with other values gives the same template. Templates are cut into windows of
five tokens; documents' windows meet benchmark windows in a hash join. An item
is found in a document if at least `COVERAGE` of its windows are there. The
values in the placeholders must then fit together, both ways: a value that the
item uses twice should stand for one value in the document, and two of its
values for two. The document is laid along the item by the shifts that most
windows have, so words put in or left out don't end the check; placeholders
whose neighbours agree are compared. `slots` is the lesser of the distinct
values of item and document by the distinct pairs of them, 1 without
placeholders. One clash makes it less than 1 and ends the match, unless at
least `VERBATIM` of the pairs are a value and itself: that is no question asked
with other values, but a copy with a change or two.

- A number is a run of digits, with dots and commas inside it; a unit (the
  fixed list below) follows one; a name is a capitalised word that does not
  begin a sentence. Other words are lower-cased.
- Windows with more than two placeholders say too little and are left out. An
  item that has no others is found by windows of its plain tokens, with its own
  values.
- A text of fewer than five tokens has one window, of all of it; an item that
  short is also found inside a document, by its plain tokens.

Nulls and others: null and empty texts have no windows. A document is known by
its id and text, so rows with a null id, and different texts of one id, are
judged each by itself (a null doc_id is reported as null); so is each distinct
row (item_id, text) of the benchmark, null ids too. Rows that repeat id and text
give one result; empty tables give an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

WINDOW = 5
COVERAGE = 0.5
VERBATIM = 0.8
#: Units of measure that a number can carry.
UNITS = "km m cm mm mi ft kg g mg lb oz l ml h hr hrs min mins s sec ms kb mb gb tb hz khz mhz ghz v w kw kwh mph usd eur gbp percent dollars euros pounds miles meters metres kilometers kilometres grams kilograms litres liters hours minutes seconds days weeks months years degrees".split()
_NUMBER, _UNIT, _NAME = "\ue000", "\ue001", "\ue002"  # private-use code points
_MARKS = _NUMBER + _UNIT + _NAME
_BREAK = rf"[^\p{{L}}\p{{N}}{_MARKS}]+"


def _plain(text: Column) -> Column:
    """Without the marks, and with numbers in one piece."""
    text = F.translate(F.coalesce(text, F.lit("")), _MARKS, "   ")
    return F.when(F.rlike(text, F.lit(r"\d[.,]\d")), F.regexp_replace(text, r"(?<=\d)[.,](?=\d)", "")).otherwise(text)


def _template(plain: Column) -> Column:
    """Names, numbers and units as marks, all else lower-cased; tokens stay one to one with the plain text's."""
    text = F.regexp_replace(plain, r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{Ll}+", _NAME)
    numbers = F.regexp_replace(text, r"(?<![\p{L}\p{N}])\d+", _NUMBER)
    units = F.regexp_replace(numbers, rf"({_NUMBER} ?)(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"$1{_UNIT}")
    return F.lower(F.when(F.rlike(plain, F.lit(r"\d")), units).otherwise(text))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, _BREAK), lambda t: t != "")


def windows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, _pos, _hash for each window of each row's template."""
    out = texts.select(*keys, _plain(F.col(text)).alias("_p"))
    out = out.select(*keys, _tokens(_template(F.col("_p"))).alias("_t"))
    out = out.select(*keys, F.transform("_t", lambda t: F.xxhash64(t)).alias("_h"))
    few = F.when(F.size("_h") > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<long>"))
    many = F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_h"), i, WINDOW)))
    return out.select(*keys, F.posexplode(F.when(F.size("_h") < WINDOW, few).otherwise(many)).alias("_pos", "_hash"))


def _plain_windows(texts: DataFrame, keys: list[str], text: str, sizes: list[int]) -> DataFrame:
    """keys, _pos, _hash for each run of so many plain tokens, lower-cased."""
    out = texts.select(*keys, F.transform(_tokens(F.lower(_plain(F.col(text)))), lambda t: F.xxhash64(t)).alias("_h"))
    runs = lambda n: F.when(F.size("_h") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("_h") - (n - 1), F.lit(1))), lambda i: F.struct((i - 1).alias("_pos"), F.xxhash64(F.slice(F.col("_h"), i, n), F.lit(n)).alias("_hash"))))
    return out.select(*keys, F.explode(F.flatten(F.filter(F.array(*[runs(n) for n in sizes]), lambda x: x.isNotNull()))).alias("_w")).select(*keys, "_w._pos", "_w._hash")


def _plain_item_windows(items: DataFrame, wanted: DataFrame) -> tuple[DataFrame | None, list[int]]:
    """What `_item_windows` has, of plain tokens, for items that are short or have no window there; and the windows' sizes."""
    tokens = _aligned(items, ["item"], "text", "raw", "canon").select("item", F.size("raw").alias("n")).filter("n > 0")
    bare = tokens.join(wanted.select("item").distinct().withColumn("has", F.lit(True)), "item", "left").filter((F.col("n") < WINDOW) | F.col("has").isNull())
    bare = bare.select("item", F.least("n", F.lit(WINDOW)).alias("size"))
    sizes = sorted(r["size"] for r in bare.select("size").distinct().collect())  # 5 at most
    if not sizes:
        return None, sizes
    parts = [_plain_windows(items.join(bare.filter(F.col("size") == n), "item", "left_semi"), ["item"], "text", [n]) for n in sizes]
    kept = parts[0]
    for more in parts[1:]:
        kept = kept.unionByName(more)
    kept = kept.select("item", F.col("_pos").alias("ipos"), F.col("_hash").alias("hash")).distinct()
    return kept.join(kept.groupBy("item").agg(F.count(F.lit(1)).alias("windows")), "item"), sizes


def _aligned(texts: DataFrame, keys: list[str], text: str, plain: str, template: str) -> DataFrame:
    """keys with the tokens of the plain text and of its template."""
    out = texts.select(*keys, _plain(F.col(text)).alias("_p"))
    return out.select(*keys, _tokens(F.col("_p")).alias(plain), _tokens(_template(F.col("_p"))).alias(template))


def _is_mark(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(*_MARKS)


def _item_windows(items: DataFrame) -> DataFrame:
    """item_id, ipos, hash, of windows with two placeholders at most, and of how many there are."""
    tokens = _aligned(items, ["item"], "text", "raw", "canon")
    marks = tokens.select("item", F.transform("canon", lambda t: _is_mark(t).cast("int")).alias("marks"))
    found = windows(items, ["item"], "text").join(marks, "item")
    inside = F.aggregate(F.slice("marks", F.col("_pos") + 1, WINDOW), F.lit(0), lambda s, x: s + x)
    kept = found.filter(inside <= 2).select("item", F.col("_pos").alias("ipos"), F.col("_hash").alias("hash")).distinct()
    return kept.join(kept.groupBy("item").agg(F.count(F.lit(1)).alias("windows")), "item")


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, slots: the items that each document gives away."""
    return _leaks(docs, benchmark, key, text).select("doc_id", "item_id", "coverage", "slots")


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows of one document (doc_id may be null) and item."""
    on = left["doc_id"].eqNullSafe(right["doc_id"]) & (left["h"] == right["h"]) & (left["item"] == right["item"])
    joined = left.join(right, on, how)
    return joined if how == "left_semi" else joined.drop(right["doc_id"]).drop(right["h"]).drop(right["item"])


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, h (a hash of the text), item_id, coverage, slots."""
    scratch = Scratch(docs.sparkSession, "leaks")
    # a written table: its numbers stay
    items = scratch.table(benchmark.select("item_id", "text").filter("text is not null").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = scratch.table(_item_windows(items), "windows")
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # the windows of a benchmark are few: the planner broadcasts them if their file is small enough, and shuffles else
    met = windows(rows, ["doc_id", "h"], "text").join(wanted, F.col("_hash") == F.col("hash"))
    bare, sizes = _plain_item_windows(items, wanted)
    if sizes:
        bare = scratch.table(bare, "plain-windows")
        met = met.unionByName(_plain_windows(rows, ["doc_id", "h"], "text", sizes).join(bare, F.col("_hash") == F.col("hash")))
    pair = ["doc_id", "h", "item"]
    met = met.groupBy(*pair, "windows", "ipos").agg(F.min(F.col("_pos") - F.col("ipos")).alias("low"), F.max(F.col("_pos") - F.col("ipos")).alias("high"))
    met = scratch.table(met, "met")
    share = F.count(F.lit(1)) / F.first("windows")
    found = met.groupBy(*pair).agg(share.alias("coverage")).filter(F.col("coverage") >= COVERAGE)
    # the shifts by which windows lie along the item, that of most first
    lines = _same(met, found, "left_semi").select(*pair, F.explode(F.array_distinct(F.array("low", "high"))).alias("shift")).groupBy(*pair, "shift").agg(F.count(F.lit(1)).alias("n"))
    order = lines.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "shift"))).alias("s")).select(*pair, F.col("s.shift").alias("shifts"))
    found = scratch.table(_same(found, order, "inner"), "found")
    return _with_slots(found, rows, items, scratch).join(items.select("item", "item_id"), "item")


def _with_slots(found: DataFrame, rows: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds `slots` and keeps what is consistent. Only items with placeholders need their documents again."""
    out = ["doc_id", "h", "item", "coverage", "slots"]
    told = _aligned(items, ["item"], "text", "raw", "canon")
    slotted = scratch.table(told.filter(F.exists("canon", _is_mark)), "slotted")
    open_ = scratch.table(found.join(slotted.select("item"), "item", "left_semi"), "open")
    plain = found.join(slotted.select("item"), "item", "left_anti").withColumn("slots", F.lit(1.0)).select(*out)
    ids = open_.select(F.col("doc_id").alias("i"), F.col("h").alias("j")).distinct()
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left_semi").groupBy("doc_id", "h").agg(F.min("text").alias("text"))
    tokens = _aligned(texts, ["doc_id", "h"], "text", "doc_raw", "doc_canon").select(F.col("doc_id").alias("i"), F.col("h").alias("j"), "doc_raw", "doc_canon")
    laid = open_.join(tokens, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).join(slotted, "item")
    token = lambda tokens, i: F.when(i >= 0, F.get(tokens, F.greatest(i, F.lit(0))))
    # the placeholder and its neighbours are the same; at an end of the item or the document there is one neighbour
    fits = lambda i, s: (F.get("doc_canon", F.greatest(i + s, F.lit(0))) == F.get("canon", i)) & (i + s >= 0) & F.coalesce(token("canon", i - 1) == token("doc_canon", i + s - 1), F.lit(True)) & F.coalesce(F.get("canon", i + 1) == token("doc_canon", i + s + 1), F.lit(True))
    marks = F.filter(F.sequence(F.lit(0), F.size("canon") - 1), lambda i: _is_mark(F.get("canon", i)))
    laid = laid.withColumn("at", F.transform(marks, lambda i: F.struct(i.alias("i"), F.get(F.filter("shifts", lambda s: fits(i, s)), F.lit(0)).alias("s"))))
    pairs = F.transform(F.filter("at", lambda p: p["s"].isNotNull()), lambda p: F.struct(F.lower(F.get("raw", p["i"])).alias("x"), F.lower(F.get("doc_raw", p["i"] + p["s"])).alias("y")))
    laid = laid.withColumn("pairs", F.array_distinct(pairs))
    values = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    same = F.size(F.filter("pairs", lambda p: p["x"] == p["y"])) / F.size("pairs")
    slots = F.when(F.size("pairs") > 0, F.least(values("x"), values("y")) / F.size("pairs")).otherwise(F.lit(1.0))
    checked = laid.withColumn("slots", slots).filter((F.col("slots") >= 1) | (F.coalesce(same, F.lit(0.0)) >= VERBATIM))
    return plain.unionByName(checked.select(*out))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that give an item away."""
    name, digest = fresh(docs, "_leaky", "_digest")
    found = _leaks(docs, benchmark, key, text).select(F.col("doc_id").alias(name), F.col("h").alias(digest)).distinct()
    found = Scratch(docs.sparkSession, "leaky").table(found, "ids")
    return docs.join(found, docs[key].eqNullSafe(found[name]) & (F.xxhash64(docs[text]) == found[digest]), "left_anti")
