"""Document fingerprints by consistent weighted sampling, on DataFrame functions only.

A text's terms are its lower-cased words, weighted by how often they occur.
For sample k, term x of weight w draws r and c from Gamma(2, 1) and b uniform,
all from a hash of (x, k), and sets

    t = floor(ln w / r + b),    ln a = ln c + r (b - t - 1).

The sample is the pair (x, t) with the least a. Two texts have the same sample
with a probability that equals their generalised Jaccard similarity, sum of
min over sum of max of the weights (Ioffe 2010), so the share of equal samples
estimates it, with a standard error of at most 0.5 / sqrt(samples).

The Gamma(2, 1) draws are sums of exponential draws e = -ln u, arranged so that
most words cost no logarithm. With c = ea + eb, the share ea / c is uniform and
independent of c; with e1 = -ln(ea / c), r = e1 + e2, the share b = e2 / r is
uniform and independent of r. Then for weights from 1 up

    t = 0 and a = ea            if e1 > ln w, that is if eb > ea (w - 1),
    t = floor((ln w + e2) / r) and a = ea exp(-r t)         else.

For w = 1 the order of a is that of the hash bits that u comes from. Samples
share eb and e2 in groups of `SHARED`; they matter only where weights differ.

1 - exp(-a), which has a's order, in 31 bits and a hash of x in 32 make a
long, which tells (x, t) apart because a depends on x and t alone. A plain
min() aggregates it, partially before the shuffle: what moves is one row of
samples for each text, whatever its length.

Nulls and others: a null text counts as empty; texts without words have one
term of their own, so they are alike among themselves; rows with a null id
come last in the order, those with one id by text; repeated rows each get a
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLES = 48
SHARED = 8
_EMPTY = 0x6E6F776F726473
_HALF = float(1 << 31)


def _seed(k: int) -> int:
    x = (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def weighted_terms(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, _term (a hash of a lower-cased word), _weight (how often it occurs).

    Each step is a column of its own: what a lambda names is then read, not
    computed again for every element.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    out = texts.select(*keys, hashes.alias("_h"))
    out = out.select(*keys, F.when(F.size("_h") == 0, F.array(F.lit(_EMPTY))).otherwise(F.col("_h")).alias("_h"))
    # where runs of equal values end
    last = F.transform(F.col("_h"), lambda x, i: F.when(F.coalesce(F.get(F.col("_h"), i + 1) != x, F.lit(True)), i))
    out = out.select(*keys, "_h", F.array_compact(last).alias("_e"))
    runs = F.transform(F.col("_e"), lambda e, j: F.struct(F.get(F.col("_h"), e).alias("term"), (e - F.coalesce(F.get(F.col("_e"), j - 1), F.lit(-1))).alias("weight")))
    return out.select(*keys, F.explode(runs).alias("_t")).select(*keys, F.col("_t.term").alias("_term"), F.col("_t.weight").alias("_weight"))


def _exponential(bits: Column, size: int) -> Column:
    """-ln of a uniform draw of `size` bits."""
    return -F.log(F.lit(1.0) - (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-size))


def _low(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(0xFFFFFFFF))


def _least(term: Column, weight: Column, log_weight: Column, eb: Column, e2: Column, name: Column, k: int) -> Column:
    """a's rank in the upper half of a long, the term's name in the lower."""
    rank = F.shiftrightunsigned(F.xxhash64(term.bitwiseXOR(F.lit(_seed(k)))), 33)
    ea = _exponential(rank, 31)
    r = F.log(eb / ea + F.lit(1.0)) + e2
    a = ea * F.exp(-r * F.floor((log_weight + e2) / r))
    often = F.least((F.lit(1.0) - F.exp(-a)) * F.lit(_HALF), F.lit(_HALF - 1)).cast("long")
    first = (weight == 1.0) | (eb > ea * (weight - F.lit(1.0)))
    return F.shiftleft(F.when(first, rank).otherwise(often), 32).bitwiseOR(name)


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys and `samples` (array of ints) for each distinct combination of keys."""
    groups = range(-(-samples // SHARED))
    rows = weighted_terms(texts, keys, text).withColumn("_w", F.col("_weight").cast("double"))
    draw = lambda n: F.when(F.col("_w") > 1.0, _exponential(_low(F.xxhash64(F.col("_term").bitwiseXOR(F.lit(_seed(n))))), 32))
    shared = [draw(-2 - n).alias(f"_e{n}") for n in range(2 * len(groups))]
    rows = rows.select(*keys, "_term", "_w", F.when(F.col("_w") > 1.0, F.log("_w")).alias("_lw"), _low(F.xxhash64("_term")).alias("_n"), *shared)
    pair = lambda k: (F.col(f"_e{2 * (k // SHARED)}"), F.col(f"_e{2 * (k // SHARED) + 1}"))
    least = rows.groupBy(*keys).agg(*[F.min(_least(F.col("_term"), F.col("_w"), F.col("_lw"), *pair(k), F.col("_n"), k)).alias(f"_m{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[(_low(F.xxhash64(f"_m{k}")) - F.lit(1 << 31)).cast("int") for k in range(samples)]).alias("samples"))


def as_text(samples: Column) -> Column:
    """Eight hex digits for each sample."""
    return F.array_join(F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s.cast("long") + F.lit(1 << 31))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return same / F.size(a)


def in_order(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, rid, next_text, next_rid: each document with the next one by (doc_id, text), the first after the last.

    Ids are dealt into ranges of about equal counts, as many as the session
    has shuffle partitions. Each range gets a copy of the first document of
    the next, so that a window inside the range finds every successor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = [i / parts for i in range(1, parts)]
    cuts = rows.select("doc_id").agg(F.percentile_approx("doc_id", share, 10_000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(parts + 1)).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    rows = rows.withColumn("bucket", bucket)
    first = {r["bucket"]: r["first"] for r in rows.select("doc_id", "bucket").groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()}  # a row for each range
    order = sorted(first)
    then = dict(zip(order, order[1:] + order[:1], strict=True))  # each range's next
    after = {n: b for b, n in then.items()}
    heads = [first[b] for b in order if first[b] is not None]
    own = F.coalesce(*[F.when(F.col("bucket") == n, F.lit(b)) for n, b in after.items()]) if after else F.lit(None).cast("int")
    is_head = F.col("doc_id").isin(heads) | (F.col("doc_id").isNull() if None in first.values() else F.lit(False))
    copies = rows.filter(is_head).select("doc_id", "text", own.alias("bucket"), F.lit(1).alias("tail"), F.col("bucket").alias("home"))
    both = rows.select("doc_id", "text", "bucket", F.lit(0).alias("tail"), F.col("bucket").alias("home")).unionByName(copies)
    w = Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").asc_nulls_last(), "text")
    place = F.row_number().over(w)
    rid = F.shiftleft(F.col("home").cast("long"), 40) + F.when(F.col("tail") == 1, F.lit(1)).otherwise(F.col("place"))
    numbered = both.withColumn("place", place).withColumn("rid", rid)
    found = numbered.select("doc_id", "text", "tail", "rid", F.lead("text").over(w).alias("next_text"), F.lead("rid").over(w).alias("next_rid"))
    return found.filter("tail = 0").drop("tail")


def edited(text: Column, following: Column) -> Column:
    """The last quarter (rounded down, in code points) replaced by the beginning of the following text."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprints(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likenesses."""
    scratch = Scratch(docs.sparkSession, "prints")
    pairs = in_order(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = pairs.select("rid", "next_rid", "doc_id", F.length("text").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("v"))
    flat = both.select("rid", "next_rid", "doc_id", "n_chars", "sha", F.col("v.which").alias("which"), F.col("v.body").alias("body"))
    keys = ["rid", "next_rid", "doc_id", "n_chars", "sha", "which"]
    prints = scratch.table(signatures(flat, keys, "body", samples), "samples")
    scratch.sweep()
    own = prints.filter("which = 0").select("rid", "next_rid", "doc_id", "n_chars", "sha", F.col("samples").alias("a"))
    other = prints.filter("which = 1").select("rid", F.col("samples").alias("b"))
    following = prints.filter("which = 0").select(F.col("rid").alias("next_rid"), F.col("samples").alias("c"))
    joined = own.join(other, "rid").join(following, "next_rid")
    return joined.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
