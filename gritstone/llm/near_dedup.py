"""MinHash near-duplicate search with odd sketches.

Exact copies (of the shingle set) are one class. A class has MINHASHES minima, whose bands bring candidates together; the
same minima, folded into a parity bitmap (the odd sketch), give an estimate of similarity from the number of ones in the
XOR of two bitmaps, which turns most false candidates away; the rest are confirmed on the full shingle sets.

A bucket of a band never gives all its pairs. Each member meets the smallest and the largest id of its bucket; once those
links are contracted, only members of different components still have to meet. They do so inside tasks, in blocks of
bounded size and on finer odd sketches; of the pairs that pass, the best few of each two components leave the task. Where
those don't link the two though others passed, their members are compared on full sets, again in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.graph import components, dealt_again
from gritstone.llm.shingles import mix, shingle_sets
from gritstone.llm.store import Scratch, let_workers_import

BANDS, ROWS = 40, 4  # at a similarity of 0.75 a pair is missed with probability 2e-7
MINHASHES = BANDS * ROWS
WORDS = 8  # of 64 bits, in an odd sketch
PERCENT = 75
#: Pairs estimated below this go; at 0.75 the estimate is five standard deviations above.
ESTIMATE = 0.5
FINE_MINHASHES, FINE_WORDS = 1024, 64
#: Pairs estimated below this on fine sketches go; at 0.75 the estimate is five standard deviations above.
FINE_ESTIMATE = 0.667
BLOCK = 4096  # members of a bucket in a block: some 3 MB
GROUP_ROWS = 4096  # rows of small buckets that are compared in one group
BEST = 4  # pairs of two components that leave a task; where none of them links the two, full sets decide
SET_BLOCK = 1 << 18  # shingles of a component in a block of full sets
PAIRS_AT_ONCE = 1 << 16
#: Ids up to which the set of candidate documents is sent to every task (12 bytes each); beyond, texts are shuffled.
MAX_SENT_IDS = 1_000_000
BATCH_ROWS = 1000
SET_ROWS = 200  # whole sets that a task hands over at once

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 2**63, FINE_MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, FINE_MINHASHES, dtype=np.uint64)


def signatures(sets: list[np.ndarray], minhashes: int = MINHASHES) -> np.ndarray:
    """Minima of each non-empty set, one row each."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]]) if sets else np.zeros(0, np.int64)
    out = np.empty((len(sets), minhashes), np.uint64)
    for lo in range(0, len(sets), 64):  # so that what is worked on stays in the cache
        hi = min(lo + 64, len(sets))
        part = flat[at[lo] : at[hi] if hi < len(sets) else len(flat)]
        for k in range(minhashes):
            out[lo:hi, k] = np.minimum.reduceat((part ^ _FLIP[k]) * _MULTIPLY[k], at[lo:hi] - at[lo])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(minima), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + minima[:, r::ROWS])
    return mix(keys ^ np.arange(1, BANDS + 1, dtype=np.uint64))


def odd_sketch(minima: np.ndarray, words: int = WORDS) -> np.ndarray:
    """``words`` 64-bit words a row: bit b is the parity of the minima that hash to b."""
    n = minima.shape[1]
    bit = mix(minima + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * words)
    out = np.zeros((len(minima), words), np.uint64)
    rows = np.arange(len(minima))
    for k in range(n):
        out[rows, bit[:, k] >> np.uint64(6)] ^= np.uint64(1) << (bit[:, k] & np.uint64(63))
    return out


def estimate_from_ones(ones: Column) -> Column:
    """Similarity from the number of ones in the XOR of two odd sketches."""
    bits = 64 * WORDS
    return 1 + bits / (4 * MINHASHES) * F.log(F.greatest(1 - 2 * ones / bits, F.lit(1e-9)))


def most_ones(similarity: float, minhashes: int, words: int) -> int:
    """Ones in the XOR of two odd sketches up to which their estimate reaches ``similarity``."""
    bits = 64 * words
    return int(bits / 2 * (1 - np.exp(-4 * minhashes / bits * (1 - similarity))))


SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>"


def _print(hashes: np.ndarray) -> int:
    return int(mix(hashes).sum(dtype=np.uint64).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            ids, texts = batch.slice(at, BATCH_ROWS).columns
            sets = shingle_sets(texts.to_pylist())
            full = [s for s in sets if len(s)]
            minima = signatures(full)
            bands, sketch = iter(band_keys(minima).view(np.int64)), iter(odd_sketch(minima).view(np.int64))
            fp = [(_print(s), _print(s ^ np.uint64(0xABCDEF))) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in fp]), pa.array([x[1] for x in fp]),
                    pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([next(sketch) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SET_ROWS):
            ids, texts = batch.slice(at, SET_ROWS).columns
            sets = shingle_sets(texts.to_pylist())
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            values = pa.LargeListArray.from_arrays(np.cumsum([0] + [len(s) for s in sets]), flat).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([_print(s) for s in sets], pa.int64()), values], ["doc_id", "fp", "hashes"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SET_ROWS):
            ids, texts = batch.slice(at, SET_ROWS).columns
            full = [(i, s) for i, s in zip(ids.to_pylist(), shingle_sets(texts.to_pylist()), strict=True) if len(s)]
            sketch = odd_sketch(signatures([s for _, s in full], FINE_MINHASHES), FINE_WORDS)
            ids, prints = pa.array([i for i, _ in full], pa.int64()), pa.array([_print(s) for _, s in full], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, prints, pa.array([r.tobytes() for r in sketch], pa.binary())], ["rep", "fp", "fine"])


def _compare(percent: int):
    coarse, fine = most_ones(ESTIMATE, MINHASHES, WORDS), most_ones(FINE_ESTIMATE, FINE_MINHASHES, FINE_WORDS)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs that may be similar, of different components, in each cell (key, i, j) of a bucket's blocks.

        Between two components only the BEST pairs with the fewest ones leave; ``more`` says that there were others.
        """
        rows = rows.sort_values(["key", "i", "j", "right", "rep"], ignore_index=True)
        key, i, j, right, rep, n, part = (rows[c].to_numpy() for c in ("key", "i", "j", "right", "rep", "n", "component"))
        light = np.array(rows["sketch"].tolist(), np.int64).reshape(len(rows), WORDS).view(np.uint64)  # ones of negative numbers are those of their absolute value
        heavy = np.frombuffer(b"".join(rows["fine"]), np.uint64).reshape(len(rows), FINE_WORDS)
        place = np.arange(len(rows))
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        cell = np.searchsorted(first, place, "right") - 1
        ends, lefts = np.append(first[1:], len(rows))[cell], np.add.reduceat((~right).astype(np.int64), first)[cell]
        begin = np.where(i == j, place + 1, first[cell] + lefts)  # a row's partners are the rows from here to its cell's end
        todo = np.where(right, 0, ends - begin)
        upto = np.cumsum(todo)
        out, at = [], 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            counts = todo[at:stop]
            x = np.repeat(place[at:stop], counts)
            y = np.repeat(begin[at:stop] - np.cumsum(counts) + counts, counts) + np.arange(len(x))
            good = (part[x] != part[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            x, y = x[good], y[good]
            good = np.bitwise_count(light[x] ^ light[y]).sum(1, dtype=np.int32) <= coarse
            x, y = x[good], y[good]
            for cut in range(0, len(x), 4096):
                p, q = x[cut : cut + 4096], y[cut : cut + 4096]
                ones = np.bitwise_count(heavy[p] ^ heavy[q]).sum(1, dtype=np.int32)
                p, q, ones = p[ones <= fine], q[ones <= fine], ones[ones <= fine]
                out.append(np.column_stack((np.sort(np.column_stack((rep[p], rep[q])), 1), np.sort(np.column_stack((part[p], part[q])), 1), ones)))
            at = stop
        found = pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 5), np.int64), columns=["a", "b", "ca", "cb", "ones"]).drop_duplicates(["a", "b"])
        of = found.sort_values(["ca", "cb", "ones", "a", "b"]).groupby(["ca", "cb"])
        best = of.head(BEST).copy()
        best["more"] = of["a"].transform("size").loc[best.index] > BEST
        return best[["a", "b", "ca", "cb", "more"]]

    return compare


def _first_links(percent: int):
    def first_links(rows: pd.DataFrame) -> pd.DataFrame:
        """For each other component of a cell, one link (a, b), if there is any, with a member of the hub, on full sets."""
        hub, others = rows[~rows["pooled"]], rows[rows["pooled"]].sort_values(["part", "rep"])
        reps, size = hub["rep"].to_numpy(), hub["hashes"].map(len).to_numpy()
        flat, at = np.concatenate(hub["hashes"].to_list()) if len(hub) else np.zeros(0, np.int64), np.cumsum(size) - size
        out: list[tuple[int, int]] = []
        last = None  # component that has a link
        for rep, part, hashes in zip(others["rep"], others["part"], others["hashes"], strict=True):
            if part == last or not len(hub):
                continue
            own = np.sort(hashes)
            common = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, at, dtype=np.int64)
            linked = np.flatnonzero(common * 100 >= (size + len(own) - common) * percent)
            if len(linked):
                out.append((min(reps[linked[0]], rep), max(reps[linked[0]], rep)))
                last = part
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return first_links


class NearDuplicates:
    """The steps of one search over ``docs`` (doc_id and text), with their scratch tables."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT):
        self.spark = docs.sparkSession
        let_workers_import(self.spark)
        self.percent = percent
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # for groups that take time, though they are small
        self.scratch = Scratch(self.spark, "near-dedup")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sign(self) -> None:
        self.signed = self.scratch.keep(self.docs.mapInArrow(_sign, SIGNED), "signed")
        named = self.signed.where("doc_id is not null and n_shingles > 0")
        one = {c: F.any_value(c) for c in ("n_shingles", "bands", "sketch")}  # equal for all rows of a class
        reps = named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), one["n_shingles"].alias("n"), one["bands"].alias("bands"), one["sketch"].alias("sketch"))
        self.reps = self.scratch.keep(reps, "reps")

    def buckets(self) -> DataFrame:
        """(key, rep, n, lo, hi) of every bucket with two classes or more.

        The ends are aggregated before they are dealt out, and the rows of a large bucket can be split.
        """
        banded = self.reps.select(F.explode("bands").alias("key"), "rep", "n")
        ends = banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
        return banded.join(dealt_again(ends, "key"), "key")

    def texts_of(self, ids: DataFrame, name: str) -> DataFrame:
        """The documents of ``ids`` (doc_id)."""
        ids = self.scratch.keep(ids.distinct(), name)
        return self.docs.join(F.broadcast(ids) if ids.count() <= MAX_SENT_IDS else ids, "doc_id", "left_semi")

    def sets_of(self, ids: DataFrame, name: str) -> DataFrame:
        """(doc_id, hashes) of the documents of ``ids``; repeated rows are one."""
        sets = self.texts_of(ids, f"{name}-ids").mapInArrow(_sets, "doc_id long, fp long, hashes array<long>")
        return self.scratch.keep(sets.dropDuplicates(["doc_id", "fp"]).drop("fp"), f"{name}-sets")

    def promising(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` whose sizes and odd sketches allow a link."""
        of = lambda x: self.reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        ones = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(WORDS)), F.lit(0))
        both = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        return both.where(estimate_from_ones(ones) >= ESTIMATE).select("a", "b")

    def confirmed(self, near: DataFrame, name: str) -> DataFrame:
        """The (a, b) of ``near``, a written table, that are similar enough on the full sets."""
        sets = self.sets_of(near.select(F.col("a").alias("doc_id")).union(near.select("b")), name)
        whole = lambda x: sets.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"h{x}"))
        both = near.join(whole("a"), "a").join(whole("b"), "b")
        links = both.withColumn("common", F.size(F.array_intersect("ha", "hb"))).withColumn("whole", F.size("ha") + F.size("hb") - F.col("common"))
        links = self.scratch.keep(links.where(F.col("common") * 100 >= F.col("whole") * self.percent).select("a", "b").distinct(), f"{name}-links")
        self.scratch.drop(sets, near)
        return links

    def dealt(self, open_: DataFrame) -> DataFrame:
        """Rows of open buckets (key, rep, n, component), dealt to cells (key, i, j) of two blocks; small buckets are one cell.

        A component that fills more than a block has blocks of its own, which do not meet each other; the rest of its
        bucket meets all blocks.
        """
        size = open_.groupBy("key", "component").agg(F.count("*").alias("size"))
        main = size.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("members"))
        apart = F.col("most") > BLOCK
        own = F.when(apart, F.ceil(F.col("most") / BLOCK)).otherwise(0).cast("int")
        rest = F.ceil((F.col("members") - F.when(apart, F.col("most")).otherwise(0)) / BLOCK).cast("int")
        main = main.select("key", F.when(apart, F.col("main")).alias("main"), own.alias("own"), rest.alias("rest"))
        rows = open_.join(dealt_again(main, "key"), "key")
        inside = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
        dealt = F.xxhash64("rep")
        rows = rows.withColumn("chunk", F.when(inside, F.pmod(dealt, F.col("own"))).otherwise(F.col("own") + F.pmod(dealt, F.col("rest"))).cast("int"))
        others = F.sequence(F.when(inside, F.col("own")).otherwise(0), F.col("own") + F.col("rest") - 1)
        rows = rows.withColumn("other", F.explode(others)).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
        rows = rows.withColumn("right", (F.col("i") != F.col("j")) & (F.col("chunk") == F.col("j")))
        return rows.withColumn("alone", F.col("own") + F.col("rest") > 1).select("key", "i", "j", "right", "alone", "rep", "n", "component")

    def across(self, open_: DataFrame) -> DataFrame:
        """(a, b, ca, cb, more): pairs of different components in a bucket that may be similar by their fine sketches."""
        fine = self.texts_of(open_.select(F.col("rep").alias("doc_id")), "open-ids").mapInArrow(_fine, "rep long, fp long, fine binary").dropDuplicates(["rep", "fp"])
        members = self.scratch.keep(fine.drop("fp").join(self.reps.select("rep", "sketch"), "rep"), "members")
        groups = max(1, open_.count() // GROUP_ROWS)
        group = F.when(F.col("alone"), F.xxhash64("key", "i", "j")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups)))
        rows = self.dealt(open_).withColumn("group", group).join(members, "rep")
        found = rows.repartition(self.tasks, "group").groupBy("group").applyInPandas(_compare(self.percent), "a long, b long, ca long, cb long, more boolean")
        found = self.scratch.keep(found, "across")
        self.scratch.drop(members)
        return found

    def settled(self, apart: DataFrame, named: DataFrame) -> DataFrame:
        """(a, b): a link between each two components of ``apart`` (ca, cb) that have one, by full sets.

        ``named`` has rep, n and component. The larger component of each two is a hub; the members of all others that ask
        for it are pooled. Both are dealt to blocks of about SET_BLOCK shingles, and each two blocks are one cell.
        """
        asked = apart.select(F.explode(F.array("ca", "cb")).alias("component")).distinct()
        members = self.scratch.keep(named.join(asked, "component"), "apart")
        size = members.groupBy("component").agg(F.sum("n").alias("size"))
        of = lambda c: size.select(F.col("component").alias(c), F.col("size").alias(f"{c}_size"))
        pairs, larger = apart.join(of("ca"), "ca").join(of("cb"), "cb"), F.col("ca_size") >= F.col("cb_size")
        pairs = self.scratch.keep(pairs.select(F.when(larger, F.col("ca")).otherwise(F.col("cb")).alias("hub"), F.when(larger, F.col("cb")).otherwise(F.col("ca")).alias("part")), "hubs")
        hubs = members.withColumnRenamed("component", "hub").join(pairs.select("hub").distinct(), "hub").select("hub", "hub", "rep", "n", F.lit(False))
        others = pairs.join(members.withColumnRenamed("component", "part"), "part").select("hub", "part", "rep", "n", F.lit(True))
        rows = self.scratch.keep(hubs.union(others).toDF("hub", "part", "rep", "n", "pooled"), "hub-rows")
        weight = lambda own: F.ceil(F.sum(F.when(own, F.col("n"))) / SET_BLOCK).cast("int")
        blocks = rows.groupBy("hub").agg(weight(~F.col("pooled")).alias("own"), weight(F.col("pooled")).alias("pool"))
        rows = rows.join(dealt_again(blocks, "hub"), "hub")
        mine, theirs = (F.when(F.col("pooled"), F.col(y)).otherwise(F.col(x)) for x, y in (("own", "pool"), ("pool", "own")))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), theirs - 1)))
        cell = [F.when(F.col("pooled"), F.col(y)).otherwise(F.col(x)).alias(k) for k, x, y in (("i", "chunk", "other"), ("j", "other", "chunk"))]
        sets = self.sets_of(members.select(F.col("rep").alias("doc_id")), "apart")
        rows = rows.select("hub", *cell, "part", "pooled", "rep").join(sets.withColumnRenamed("doc_id", "rep"), "rep").repartition(self.tasks, "hub", "i", "j")
        found = self.scratch.keep(rows.groupBy("hub", "i", "j").applyInPandas(_first_links(self.percent), "a long, b long"), "settled")
        self.scratch.drop(members, sets)
        return found

    def joined(self, found: DataFrame, links: DataFrame) -> DataFrame:
        """The components ``found`` after more links."""
        if links.isEmpty():
            return found
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return self.scratch.keep(components(self.spark, stars.union(links), self.scratch), "components")

    def run(self) -> DataFrame:
        """(node, component) of every class that is linked with another."""
        self.sign()
        buckets = self.scratch.keep(self.buckets(), "buckets")
        ends = buckets.select(F.explode(F.array("lo", "hi")).alias("b"), F.col("rep").alias("a")).where("a <> b")
        pairs = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = self.confirmed(self.scratch.keep(self.promising(pairs), "ends-near"), "ends")
        found = self.scratch.keep(components(self.spark, links, self.scratch), "components")
        # members that neither end of their bucket resembles
        of = found.select(F.col("node").alias("rep"), "component")
        open_ = buckets.select("key", "rep", "n").join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        parts = open_.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
        open_ = self.scratch.keep(open_.join(dealt_again(parts, "key"), "key"), "open")
        self.scratch.drop(buckets)
        pairs = self.across(open_)
        after = self.joined(found, self.confirmed(self.scratch.keep(pairs.select("a", "b").distinct(), "across-near"), "across"))
        # where more pairs passed between two components than were confirmed, and none linked them
        name = lambda c: after.select(F.col("node").alias(c), F.col("component").alias(f"{c}_now"))
        cut = pairs.where("more").select("ca", "cb").distinct().join(name("ca"), "ca", "left").join(name("cb"), "cb", "left")
        apart = cut.where(F.coalesce("ca_now", "ca") != F.coalesce("cb_now", "cb")).select("ca", "cb")
        apart = self.scratch.keep(apart, "apart-pairs")
        if not apart.isEmpty():
            named = self.reps.select("rep", "n").join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            after = self.joined(after, self.settled(apart, named))
        self.scratch.drop(open_, pairs)
        return after


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, an integer, and text).

    Two documents are linked if their sets of word shingles overlap by ``percent`` or more of their union; component_id
    is the smallest id reachable by links. A null, empty or wordless text has no shingles and is linked with nothing. A
    row with a null id cannot be named: it is linked with nothing, its component is null and it is not kept. Rows with
    one id count as one document with several texts. Other columns are not read.
    """
    search = NearDuplicates(docs, percent)
    found = search.run()
    reps = search.reps.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reps = reps.select("fp1", "fp2", F.coalesce("component", "rep").alias("component"), F.lit(True).alias("any"))
    rows = search.signed.select("doc_id", "n_shingles", "fp1", "fp2")
    joined = rows.join(reps, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
