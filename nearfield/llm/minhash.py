"""Near-duplicate documents: MinHash, banding, signature checks, exact checks, components.

A document's set holds its distinct word shingles (A-Z lower-cased). Equal
sets are one node, so copies cost a row each and no pairs. Every node's
signature has the minima of many universal hashes; bands of them name buckets.
Within a bucket nodes are compared with one pivot, not with each other: pairs
grow with the bucket, not with its square. Pairs whose signatures agree enough
are confirmed on full sets, and components follow by alternating stars.

The pivot is the member with the most company over all its bands: of a text
and its altered copies the text itself, to which all copies are nearer than to
each other. A pivot can still miss two members that are alike. So members left
apart from their pivot are compared with all members of other components: in
buckets of up to `SMALL` members as a join of pairs; in larger ones in blocks,
dealt by a hash, of about `BLOCK` members or `BLOCK_ITEMS` shingles, so that a
set moves once for each block it meets, not once for each member. A block takes
signatures from the sets, confirms what agrees on the sets at once, and gives a
forest of links: fewer rows than it has members, however many pairs are alike.
No pair of a bucket is left out.

Rows per band are the most with which a pair at the threshold misses all bands
with a probability of at most `MISS`; signatures drop a confirmed pair with
about the same.

A row is known by its id and a hash of its text, so rows without an id, and
different texts of one id, are documents of their own.

Nulls and others: null and empty texts have an empty set and link with
nothing; a row with a null id links as its text does, but names no component
(that is null where all its component's ids are); repeated rows are copies; an
empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, release
from .graph import components
from .words import U64, Words, batches, mix, shingle_sets, text_bytes

HASHES = 128
MISS = 1e-6
SMALL = 32
BLOCK = 1024
BLOCK_ITEMS = 1 << 20
_CHUNK = 1 << 15


def band_rows(threshold: float, hashes: int = HASHES) -> int:
    """Rows per band."""
    fits = [r for r in range(1, 17) if (1 - threshold**r) ** (hashes // r) <= MISS]
    return max(fits, default=1)


def universal(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the hashes x -> (a x + b) >> 32 of 64-bit words."""
    n = np.arange(1, 2 * hashes + 1, dtype=U64)
    draws = mix(n * U64(0x9E3779B97F4A7C15))
    return draws[:hashes] | U64(1), draws[hashes:]


def minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """uint32, sets x hashes; a set must not be empty."""
    out = np.full((len(sets), hashes), 0xFFFFFFFF, dtype=np.uint32)
    a, b = universal(hashes)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= _CHUNK):
            size += len(sets[last])
            last += 1
        values = np.concatenate(sets[first:last])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first : last - 1]]))).astype(np.int64)
        for k in range(hashes):
            out[first:last, k] = np.minimum.reduceat(values * a[k] + b[k], starts) >> U64(32)
        first = last
    return out


def band_keys(signs: np.ndarray, rows: int) -> np.ndarray:
    """uint64, signatures x bands."""
    count = signs.shape[1] // rows
    bands = np.zeros((len(signs), count), dtype=U64)
    for j in range(rows):
        bands = bands * U64(0xFF51AFD7ED558CCD) + signs[:, j : rows * count : rows].astype(U64)
    return mix(bands + (np.arange(1, count + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)))


def _row(k: Column, h: Column) -> Column:
    """One long for an id and a text's hash; what is joined by it is compared by both as well."""
    return F.xxhash64(k, h)


def sketches(docs: DataFrame, *, shingle: int, rows: int, hashes: int, key: str, text: str) -> DataFrame:
    """k (the key), h (a hash of the text), n, k1, k2 (a digest of the set), bands, signature for every row; no bands for empty sets."""
    few = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    names = ["k", "h", "n", "k1", "k2", "bands", "signature"]

    def sketch(stream):
        for whole in stream:
            for batch in batches(whole, "t"):
                sets = shingle_sets(Words(text_bytes(batch, "t")), shingle)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                signs = minima([sets[i] for i in full], hashes)
                count = hashes // rows
                bands = band_keys(signs, rows)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, count, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))
                at = dict(zip(full.tolist(), range(len(full)), strict=True))
                packed = [signs[at[i]].tobytes() if i in at else b"" for i in range(len(sets))]
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(sizes), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists, pa.array(packed, pa.binary())], names)
        release()

    kind = docs.schema[key].dataType.simpleString()
    return few.mapInArrow(sketch, f"k {kind}, h long, n long, k1 long, k2 long, bands array<long>, signature binary")


def agreement(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """a, b, agree: the share of equal minima."""
    left = signatures.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    right = signatures.select(F.col("node").alias("b"), F.col("signature").alias("y"))

    def compare(stream):
        for batch in stream:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(len(batch), -1) for c in "xy")
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).mean(axis=1))], ["a", "b", "agree"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, agree double")


def set_table(docs: DataFrame, reps: DataFrame, *, shingle: int, key: str, text: str) -> DataFrame:
    """node, items: the full sets of the documents in reps (node, rk, rh), sorted 64-bit hashes as bytes."""
    # candidates grow with the corpus, so this is a shuffle at every size but the smallest; the hint keeps one plan
    few = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).withColumn("m", _row(F.col("k"), F.col("h")))
    found = few.join(reps.withColumn("m", _row(F.col("rk"), F.col("rh"))).hint("merge"), "m").filter(F.col("k").eqNullSafe(F.col("rk")) & (F.col("h") == F.col("rh")))
    few = found.groupBy("m").agg(F.first("node").alias("node"), F.first("t").alias("t")).select("node", "t")  # of repeated rows one

    def build(stream):
        for whole in stream:
            for batch in batches(whole, "t"):
                sets = shingle_sets(Words(text_bytes(batch, "t")), shingle)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])
        release()

    return few.mapInArrow(build, "node long, items binary")


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = sorted((len(p), len(q)))
    if 100 * small < percent * large:  # the sizes rule it out
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")  # merges the two runs
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (small + large - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs with 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def compare(stream):
        for batch in stream:
            keep = [_alike(*(np.frombuffer(z.as_buffer(), dtype=U64) for z in row), percent) for row in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))


class _Labels:
    """The least node of each node's component so far."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.table = scratch, None

    def add(self, links: DataFrame) -> None:
        both = links if self.table is None else links.unionByName(self.table)
        self.table = components(both, self.scratch)

    def on(self, rows: DataFrame, node: str, label: str) -> DataFrame:
        if self.table is None:
            return rows.withColumn(label, F.col(node))
        named = self.table.select(F.col("u").alias(node), F.col("v").alias("_v"))
        return rows.join(named, node, "left").withColumn(label, F.coalesce("_v", node)).drop("_v")


def _classes(docs: DataFrame, scratch: Scratch, *, shingle: int, percent: int, hashes: int, key: str, text: str) -> DataFrame:
    """k, h, n of every row; least, least_h: the first row of its component by (id, hash of the text), null ids last."""
    rows = band_rows(percent / 100, hashes)
    sketch = scratch.table(sketches(docs, shingle=shingle, rows=rows, hashes=hashes, key=key, text=text).withColumn("r", F.monotonically_increasing_id()), "sketches")
    # a written table: its numbers stay
    first = sketch.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct(F.isnull("k").alias("void"), "k", "h", "r")).alias("f"))
    nodes = scratch.table(first.select("k1", "k2", F.col("f.k").alias("rk"), F.col("f.h").alias("rh"), F.col("f.r").alias("r"), F.col("f.r").alias("node")), "nodes")

    # the row that stands for its class: joined by its number, so that many copies don't meet
    own = sketch.select("r", "n", "bands", "signature").join(nodes.select("r", "node"), "r")
    signatures = scratch.table(own.select("node", "n", "bands", "signature"), "own")
    buckets = signatures.select("node", "n", F.explode("bands").alias("band"))
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK + F.sum("n") / BLOCK_ITEMS)  # of all members; members apart have no more
    sizes = buckets.groupBy("band").agg(F.min("node").alias("near"), F.max("node").alias("far"), F.count(F.lit(1)).alias("members"), blocks.alias("blocks")).filter("far <> near").select("band", "members", "blocks")
    buckets = buckets.drop("n")
    members = scratch.table(buckets.join(scratch.table(sizes, "sizes"), "band"), "members")
    company = scratch.table(members.groupBy("node").agg(F.sum("members").alias("company")), "company")
    # most company first, then the least id, as one long and the id
    central = members.join(company, "node").groupBy("band").agg(F.min_by("node", F.struct(-F.col("company"), F.col("node"))).alias("pivot"))
    crowded = scratch.table(members.join(scratch.table(central, "central"), "band"), "crowded")
    links_of = _Confirm(docs, scratch, signatures, nodes, shingle, percent, hashes, key, text)

    labels = _Labels(scratch)
    links = links_of(crowded.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    if links is not None:
        labels.add(links)
        more = links_of(_apart(crowded, labels, scratch))
        if more is not None:
            labels.add(more)
        rest = links_of.in_blocks(crowded.filter(F.col("members") > SMALL), labels, rows)
        if rest is not None:
            labels.add(rest)

    named = labels.on(nodes.select("node", "k1", "k2", "rk", "rh"), "node", "label")
    if labels.table is not None:
        named = scratch.table(named, "labelled")
        least = named.groupBy("label").agg(F.min(F.struct(F.isnull("rk").alias("void"), "rk", "rh")).alias("f")).select("label", F.col("f.rk").alias("rk"), F.col("f.rh").alias("rh"))
        named = named.drop("rk", "rh").join(scratch.table(least, "least"), "label")
    named = scratch.table(named.select("k1", "k2", F.col("rk").alias("least"), F.col("rh").alias("least_h")), "named")
    return sketch.select("k", "h", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select("k", "h", "n", "least", "least_h")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, hashes: int = HASHES, key: str = "doc_id", text: str = "text", with_rows: bool = True) -> DataFrame:
    """The rows of docs with n_shingles, component_id (the least id reachable) and kept (the id is its component's least).

    Links: 100 * intersection >= percent * union of the shingle sets. Without
    with_rows only the key and these columns come back, and no text moves.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    found = _classes(docs, scratch, shingle=shingle, percent=percent, hashes=hashes, key=key, text=text)
    size, component, kept, k, h = fresh(docs, "n_shingles", "component_id", "kept", "_k", "_h")
    found = found.select(F.col("k").alias(k), F.col("h").alias(h), F.col("n").alias(size), F.when(F.col("n") == 0, F.col("k")).otherwise(F.col("least")).alias(component))
    found = found.withColumn(kept, F.col(k).eqNullSafe(F.col(component)))
    if not with_rows:
        return found.drop(h).withColumnRenamed(k, key)
    one = found.groupBy(k, h).agg(*[F.min(c).alias(c) for c in (size, component, kept)])  # repeated rows agree
    return _same_row(docs, one, key, text, k, h, "left").drop(k, h)


def _same_row(docs: DataFrame, found: DataFrame, key: str, text: str, k: str, h: str, how: str) -> DataFrame:
    return docs.join(found, (_row(docs[key], F.xxhash64(docs[text])) == _row(found[k], found[h])) & docs[key].eqNullSafe(found[k]) & (F.xxhash64(docs[text]) == found[h]), how)


def one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80, hashes: int = HASHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the least id, then of the least hash of the text, then of the least other columns.

    Rows without words are like nothing and stay, but of those that repeat an
    id and its text one.
    """
    scratch = Scratch(docs.sparkSession, "one")
    found = _classes(docs, scratch, shingle=shingle, percent=percent, hashes=hashes, key=key, text=text)
    first = (F.col("n") == 0) | (F.col("k").eqNullSafe(F.col("least")) & (F.col("h") == F.col("least_h")))
    # how many rows must become one: null ids without words are told apart by nothing, so they all stay
    kept = scratch.table(found.filter(first).groupBy("k", "h").agg(F.sum(F.when(F.col("k").isNull() & (F.col("n") == 0), 0).otherwise(1)).alias("times")), "kept")
    k, h, least = fresh(docs, "_k", "_h", "_least")
    ids = lambda these: kept.filter(these).select(F.col("k").alias(k), F.col("h").alias(h))
    single = _same_row(docs, ids("times < 2"), key, text, k, h, "left_semi")
    if kept.filter("times > 1").isEmpty():
        return single
    many = _same_row(docs, ids("times > 1"), key, text, k, h, "left_semi").withColumn(h, F.xxhash64(text))
    rest = [c for c in docs.columns if c not in (key, text)]
    # one text for each id and hash; without other columns the least of a constant
    one = many.groupBy(key, h, text).agg(F.min(F.struct(F.lit(0).alias(k), *rest)).alias(least))
    return single.unionByName(one.select(*[F.col(f"{least}.{c}").alias(c) if c in rest else F.col(c) for c in docs.columns]))


class _Confirm:
    """Confirmed links of pairs, or None without pairs."""

    def __init__(self, docs, scratch, signatures, nodes, shingle, percent, hashes, key, text):
        self.docs, self.scratch, self.signatures, self.nodes = docs, scratch, signatures, nodes
        self.how, self.percent, self.hashes = {"shingle": shingle, "key": key, "text": text}, percent, hashes
        p = percent / 100
        self.cut = p - 4 * math.sqrt(p * (1 - p) / hashes)

    def __call__(self, pairs: DataFrame) -> DataFrame | None:
        pairs = self.scratch.table(pairs, "pairs")
        if pairs.isEmpty():
            return None
        alike = agreement(pairs, self.signatures.select("node", "signature")).filter(F.col("agree") >= self.cut)
        alike = self.scratch.table(alike.select("a", "b"), "alike")
        sets = self._sets(alike.select("a").union(alike.select("b")).distinct().withColumnRenamed("a", "node"))
        links = self.scratch.table(confirmed(alike, sets, self.percent), "links")
        self.scratch.drop(sets)
        self.scratch.sweep()
        return links

    def in_blocks(self, large: DataFrame, labels: _Labels, rows: int) -> DataFrame | None:
        """Links between members of different components of large buckets, those apart from the pivot with all; enough of them to join what is linked."""
        scratch = self.scratch
        named = _labelled(large, labels, scratch)
        lone = named.filter("apart").groupBy("band").agg(F.count(F.lit(1)).alias("lone"))
        named = scratch.table(named.join(scratch.table(lone, "lone"), "band"), "busy")
        if named.isEmpty():
            return None
        sets = self._sets(named.select("node").distinct())
        known = named.join(sets, "node")
        few = F.ceil(F.col("blocks") * F.col("lone") / F.col("members")).cast("long")
        dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("long")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        carried = ["band", "node", "mine", "apart", "items"]
        left = known.filter("apart").select(*carried, F.lit(True).alias("asks"), dealt(few).alias("i"), every(F.col("blocks")).alias("j"))
        right = known.select(*carried, F.lit(False).alias("asks"), dealt(F.col("blocks")).alias("j"), every(few).alias("i"))
        compare = _block_links(rows, self.hashes, self.cut, self.percent)
        links = scratch.table(left.unionByName(right).groupBy("band", "i", "j").applyInArrow(compare, "u long, v long"), "links")
        scratch.drop(sets)
        scratch.sweep()
        return links

    def _sets(self, ids: DataFrame) -> DataFrame:
        reps = self.scratch.table(ids.join(self.nodes.select("node", "rk", "rh"), "node"), "reps")
        return self.scratch.table(set_table(self.docs, reps, **self.how), "sets")

def _labelled(crowded: DataFrame, labels: _Labels, scratch: Scratch) -> DataFrame:
    rows = labels.on(labels.on(crowded, "node", "mine"), "pivot", "its")
    return scratch.table(rows.select("band", "members", "blocks", "node", "mine", (F.col("mine") != F.col("its")).alias("apart")), "labelled")


def _apart(crowded: DataFrame, labels: _Labels, scratch: Scratch) -> DataFrame:
    """Pairs of members of a small bucket in different components; one of the two is apart from the bucket's pivot."""
    rows = _labelled(crowded.filter(F.col("members") <= SMALL), labels, scratch)
    apart = rows.filter("apart").select("band", F.col("node").alias("a"), F.col("mine").alias("mine_a"))
    others = rows.select("band", F.col("node").alias("b"), F.col("mine").alias("mine_b"), "apart")
    found = apart.join(others, "band").filter("(not apart or a < b) and mine_a <> mine_b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(rows: int, hashes: int, cut: float, percent: int):
    """The function that confirms links in a block; a pair is met in the first band that it shares only."""

    def compare(block: pa.Table) -> pa.Table:
        asks = np.asarray(block.column("asks").to_pylist(), dtype=bool)
        apart = np.asarray(block.column("apart").to_pylist(), dtype=bool)
        node, mine = (block.column(c).to_numpy() for c in ("node", "mine"))
        band = np.int64(block.column("band")[0].as_py()).view(U64)
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        u, v = [], []
        if len(x) and len(y):
            sets = [np.frombuffer(i, dtype=U64) for i in block.column("items").to_pylist()]
            signs = minima(sets, hashes)
            (at,) = np.flatnonzero(band_keys(signs[x[:1]], rows)[0] == band)[:1]
            before = at * rows
            _, team = np.unique(mine, return_inverse=True)
            for i in x.tolist():
                agree = (signs[y] == signs[i]).mean(axis=1)
                # of two members apart, the pair comes once
                ok = np.flatnonzero((agree >= cut) & (team[y] != team[i]) & (~apart[y] | (node[y] > node[i])))
                if before and len(ok):
                    ok = ok[~(signs[y[ok], :before] == signs[i, :before]).reshape(len(ok), at, rows).all(axis=2).any(axis=1)]
                for j in y[ok[np.argsort(-agree[ok], kind="stable")]].tolist():
                    if team[i] != team[j] and _alike(sets[i], sets[j], percent):
                        u.append(node[i])
                        v.append(node[j])
                        team[team == team[j]] = team[i]
        return pa.Table.from_arrays([pa.array(np.array(c, dtype=np.int64)) for c in (u, v)], ["u", "v"])

    return compare
