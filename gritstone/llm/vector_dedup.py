"""Near-duplicate vectors by NN-descent.

Within each label, a few random orders along signs of random projections give every vector a first list of neighbours.
Rounds of joins then show each vector the neighbours of its neighbours (in both directions) and keep the nearest. The
edges that reach the threshold are kept. A list all of whose entries reach it is saturated: it may be too short to hold
links to other components, so saturated vectors of different components of a label are all compared, in blocks. Then the
members of each component are compared in blocks, so that every link within is counted. An audit compares a
number of vectors, others in each pass, with all of their label; while the edges found by the search join too few of
their links, further orders and rounds follow, and after the last the search fails. Links of the audits are added at the
end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gritstone.llm.graph import components
from gritstone.llm.store import Scratch, let_workers_import

THRESHOLD = 0.93
NEIGHBOURS = 10
TREES = 8
PLANES = 48
CHUNK = 128  # rows of an order compared with each other and with the chunk before
ROUNDS = 2
AUDITED = 128
AUDIT_RECALL = 0.98
MORE = 6  # further searches that failed audits may ask for
BLOCK = 256  # vectors of one component in a block
CROSS_BLOCK = 1024  # saturated vectors in a block


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.Array, kind: str = "float32") -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.zeros((0, 1), kind)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null for those that link with nothing."""
    for batch in batches:
        out = []
        for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            good = None
            if v and label is not None and None not in v:
                a = np.array(v, np.float64)
                with np.errstate(over="ignore"):
                    good = a.tobytes() if np.isfinite(a).all() and np.isfinite((a * a).sum()) and (a * a).sum() > 0 else None
            out.append(good)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])


def _codes(tree: int):
    """Signs of random projections as one number, so that near vectors come near in its order."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                x = np.frombuffer(v, np.float32)
                planes = _planes(tree, len(x))
                bits = planes @ x > 0
                out.append(int(np.packbits(bits).tobytes().hex(), 16))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["id", "part", "unit", "code"])

    return code


_made: dict[tuple[int, int], np.ndarray] = {}


def _planes(tree: int, dims: int) -> np.ndarray:
    if (tree, dims) not in _made:
        _made[tree, dims] = np.random.default_rng([tree, dims]).normal(size=(PLANES, dims)).astype(np.float32)
    return _made[tree, dims]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, unit) in an order: each one's nearest in its chunk and the one before, both ways."""

    def chunks():
        held: pa.RecordBatch | None = None
        for batch in batches:
            table = pa.Table.from_batches([x for x in (held, batch) if x is not None])
            parts = np.array(table.column("part").to_pylist(), object)
            cut = np.flatnonzero(parts[1:] != parts[:-1]) + 1 if len(parts) else np.zeros(0, int)
            at = 0
            for end in [*cut, len(parts)]:
                while end - at >= CHUNK or (end < len(parts) and at < end):
                    n = min(CHUNK, end - at)
                    yield table.slice(at, n)
                    at += n
            left = table.slice(at)
            held = left.combine_chunks().to_batches()[0] if left.num_rows else None
        if held is not None:
            yield pa.Table.from_batches([held])

    before: tuple | None = None
    for t in chunks():
        ids, part = np.array(t.column("id").to_pylist(), np.int64), t.column("part")[0].as_py()
        unit = _matrix(t.column("unit").combine_chunks())
        if before and before[0] == part:
            all_ids, all_units = np.concatenate((before[1], ids)), np.concatenate((before[2], unit))
        else:
            all_ids, all_units = ids, unit
        sims = unit @ all_units.T
        sims[ids[:, None] == all_ids[None, :]] = -2
        k = min(NEIGHBOURS, len(all_ids))
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        a, b, s = np.repeat(ids, k), all_ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()
        good = s > -2
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a[good], b[good]))), pa.array(np.concatenate((b[good], a[good]))), pa.array(np.tile(s[good], 2))], ["a", "b", "cos"])
        before = (part, ids, unit)


EDGE = "a long, b long, cos float"


def _explore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, unit, worst, ids, units): entries of the list that are nearer to a than its worst neighbour."""
    for batch in batches:
        a, unit, worst, ids, units = batch.columns
        out_a, out_b, out_s = [], [], []
        for x, v, w, others, vectors in zip(a.to_pylist(), unit.to_pylist(), worst.to_pylist(), ids.to_pylist(), units.to_pylist(), strict=True):
            s = np.frombuffer(b"".join(vectors), np.float32).reshape(len(others), -1) @ np.frombuffer(v, np.float32)
            for i in np.flatnonzero(s > w):
                if others[i] != x:
                    out_a.append(x)
                    out_b.append(others[i])
                    out_s.append(s[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_s, pa.float32())], ["a", "b", "cos"])


def _count_block(threshold: float):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links of each vector of block i with those of block j of its component, copies counted."""
        out = []
        for _, part in rows.groupby("component", sort=False):
            left, right = part[part["chunk"] == part["i"]], part[part["chunk"] == part["j"]]
            x, y = (_unit(np.frombuffer(b"".join(p["vec"]), np.float64).reshape(len(p), -1)) for p in (left, right))
            linked = x @ y.T >= threshold
            same = (part["i"] == part["j"]).iloc[0]
            if same:
                np.fill_diagonal(linked, False)
            out.append(pd.DataFrame({"id": left["id"], "links": linked @ right["copies"].to_numpy()}))
            if not same:
                out.append(pd.DataFrame({"id": right["id"], "links": linked.T @ left["copies"].to_numpy()}))
        return pd.concat(out)[["id", "links"]]

    return count


def _cross_block(threshold: float):
    def cross(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A link between each two components that have one in blocks i and j of a label."""
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left, right = rows[rows["block"] == i], rows[rows["block"] == j]
        x, y = (_unit(np.frombuffer(b"".join(p["vec"]), np.float64).reshape(len(p), -1)) for p in (left, right))
        r, c = np.nonzero((x @ y.T >= threshold) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]))
        out = pd.DataFrame({"a": left["id"].to_numpy()[r], "b": right["id"].to_numpy()[c], "ca": left["component"].to_numpy()[r], "cb": right["component"].to_numpy()[c]})
        return out.drop_duplicates(["ca", "cb"])[["a", "b"]]

    return cross


class VectorSearch:
    def __init__(self, vectors: DataFrame, threshold: float = THRESHOLD):
        self.spark = vectors.sparkSession
        let_workers_import(self.spark)
        self.threshold = threshold
        self.scratch = Scratch(self.spark, "vector-dedup")
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
        self.rows = self.scratch.keep(rows.mapInArrow(_prepare, "vec_id long, label string, vec binary"), "rows")
        self.rows = self.rows.withColumn("part", F.concat_ws(":", F.length("vec"), "label")).withColumn("copy", F.md5("vec"))

    def nodes(self) -> DataFrame:
        """One row for each different vector of a label: id (the smallest), part, copies, vec, unit (floats)."""
        good = self.rows.where("vec is not null and vec_id is not null")
        kinds = good.groupBy("part", "copy").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
        named = good.join(kinds.withColumnRenamed("id", "vec_id"), ["part", "copy", "vec_id"]).dropDuplicates(["part", "copy"])

        def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = [_unit(np.frombuffer(v, np.float64)[None, :])[0].astype(np.float32).tobytes() for v in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.binary())], ["id", "part", "copies", "vec", "unit"])

        made = named.select(F.col("vec_id").alias("id"), "part", "copies", "vec").mapInArrow(unit, "id long, part string, copies long, vec binary, unit binary")
        return self.scratch.keep(made, "nodes")

    def nearest(self, edges: DataFrame) -> DataFrame:
        """The NEIGHBOURS nearest of each vector."""
        best = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"))
        order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
        return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= NEIGHBOURS).drop("n")

    def orders(self, trees: range) -> DataFrame:
        out = None
        for t in trees:
            coded = self.node.select("id", "part", "unit").mapInArrow(_codes(t), "id long, part string, unit binary, code long")
            ordered = coded.repartitionByRange("part", "code", "id").sortWithinPartitions("part", "code", "id")
            found = ordered.select("id", "part", "unit").mapInArrow(_neighbours, EDGE)
            out = found if out is None else out.union(found)
        return out

    def refine(self, graph: DataFrame) -> DataFrame:
        """One round: every vector sees the lists of its neighbours and of those that list it."""
        units = self.node.select("id", "unit")
        lists = graph.join(units.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("b")).agg(F.collect_list(F.struct(F.col("b").alias("id"), "unit")).alias("list"))
        lists = lists.select("b", "list.id", "list.unit").toDF("b", "ids", "units")
        worst = graph.groupBy("a").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("cos")).otherwise(F.lit(-1.0)).cast("float").alias("worst"))
        pairs = graph.select("a", "b").union(graph.select("b", "a")).distinct()
        seen = pairs.join(units.withColumnRenamed("id", "a").join(worst, "a"), "a").join(lists, "b")
        found = seen.select("a", "unit", "worst", "ids", "units").mapInArrow(_explore, EDGE)
        return self.scratch.keep(self.nearest(graph.union(found)), "graph")

    def exact(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` whose cosine in doubles reaches the threshold."""
        threshold = self.threshold
        v = lambda x: self.node.select(F.col("id").alias(x), F.col("vec").alias(f"v{x}"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    p, q = _unit(np.frombuffer(x, np.float64)[None]), _unit(np.frombuffer(y, np.float64)[None])
                    near.append(bool((p @ q.T)[0, 0] >= threshold))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near, pa.bool_()))

        return pairs.join(v("a"), "a").join(v("b"), "b").select("a", "b", "va", "vb").mapInArrow(check, "a long, b long")

    def across(self, graph: DataFrame, found: DataFrame) -> DataFrame:
        """Links (a, b) between the components ``found``, from all pairs of saturated vectors of a label.

        A link that neither end's list shows has two saturated ends. Components of a block or more have blocks of their
        own, which are not compared with each other; smaller ones share blocks.
        """
        full = graph.where(F.col("cos") >= self.threshold - 1e-4).groupBy("a").count().where(F.col("count") >= NEIGHBOURS).select(F.col("a").alias("node"))
        mine = full.join(found, "node").join(self.node.select(F.col("id").alias("node"), "part"), "node")
        size = mine.groupBy("part", "component").agg(F.count("*").alias("size"))
        small = size.where(F.col("size") < CROSS_BLOCK).groupBy("part").agg(F.ceil(F.sum("size") / CROSS_BLOCK).cast("int").alias("shared"))
        own = F.when(F.col("size") >= CROSS_BLOCK, F.col("component"))
        chunk = F.when(own.isNotNull(), F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CROSS_BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.col("shared")))
        dealt = mine.join(size, ["part", "component"]).join(small, "part", "left").select("node", "part", "component", own.alias("own"), chunk.cast("long").alias("chunk"))
        # the part, its component (-1: shared) and the chunk name a block
        dealt = self.scratch.keep(dealt.withColumn("block", F.concat_ws("/", "part", F.coalesce("own", F.lit(-1)), "chunk")), "saturated")
        blocks = dealt.select("part", "own", "block").distinct()
        other = blocks.select("part", F.col("own").alias("other"), F.col("block").alias("j"))
        apart = F.col("own").isNull() | F.col("other").isNull() | (F.col("own") != F.col("other"))
        pairs = blocks.join(other, "part").where((F.col("block") <= F.col("j")) & apart).select(F.col("block").alias("i"), "j")
        asked = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
        held = dealt.select(F.col("node").alias("id"), "component", "block").join(self.node.select("id", "vec"), "id")
        return asked.join(held, "block").groupBy("i", "j").applyInPandas(_cross_block(self.threshold), "a long, b long")

    def audit(self, turn: int, n: int = AUDITED) -> DataFrame:
        """Links of the ``n`` vectors of the smallest hash in this turn, by comparison with all vectors of their label."""
        asked = self.node.select("id", "part", "vec").orderBy(F.xxhash64(F.lit(turn), "id"), "id").limit(n).collect()
        by_part: dict = {}
        for r in asked:
            by_part.setdefault(r["part"], ([], []))
            by_part[r["part"]][0].append(r["id"])
            by_part[r["part"]][1].append(np.frombuffer(bytes(r["vec"]), np.float64))
        known = {p: (np.array(i), _unit(np.array(v))) for p, (i, v) in by_part.items()}
        threshold = self.threshold

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = np.array(batch.column(1).to_pylist(), object)
                ids = np.array(batch.column(0).to_pylist(), np.int64)
                vectors = batch.column(2).to_pylist()
                out = []
                for p in set(parts) & set(known):
                    at = np.flatnonzero(parts == p)
                    x = _unit(np.frombuffer(b"".join(vectors[i] for i in at), np.float64).reshape(len(at), -1))
                    q, y = known[p]
                    r, c = np.nonzero(x @ y.T >= threshold)
                    out += [(int(ids[at[i]]), int(q[j])) for i, j in zip(r, c, strict=True) if ids[at[i]] != q[j]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        return self.scratch.keep(self.node.select("id", "part", "vec").mapInArrow(compare, "a long, b long"), "audit")

    def links(self) -> DataFrame:
        """(node, component) of linked vectors, after search and audit."""
        near = F.col("cos") >= self.threshold - 1e-4
        graph = self.scratch.keep(self.nearest(self.orders(range(TREES))), "graph")
        audits = None
        for more in range(MORE + 1):
            for _ in range(ROUNDS):
                after = self.refine(graph)
                self.scratch.drop(graph)
                graph = after
            pairs = graph.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            edges = self.scratch.keep(self.exact(pairs), "edges")
            found = self.scratch.keep(components(self.spark, edges, self.scratch), "components")
            cross = self.scratch.keep(self.across(graph, found), "across")
            if not cross.isEmpty():
                edges = edges.union(cross)
                found = self.scratch.keep(components(self.spark, edges, self.scratch), "components")
            one = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
            two = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
            audited = self.audit(more)
            audits = audited if audits is None else audits.union(audited)
            hit = audited.join(one, "a", "left").join(two, "b", "left").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int")).alias("hit")).first()
            self.recall = 1.0 if not hit["n"] else hit["hit"] / hit["n"]
            if self.recall >= AUDIT_RECALL:
                break
            if more == MORE:
                raise RuntimeError(f"the search finds {self.recall:.4f} of the audited links after {MORE} further searches; {AUDIT_RECALL} is asked for")
            graph = self.scratch.keep(self.nearest(graph.union(self.orders(range(TREES * (more + 1), TREES * (more + 2))))), "graph")
        return self.scratch.keep(components(self.spark, edges.union(audits), self.scratch), "components")

    def run(self) -> DataFrame:
        """id, links (copies of other linked vectors) and component of every different vector."""
        self.node = self.nodes()
        found = self.links().select(F.col("node").alias("id"), "component")
        size = found.groupBy("component").agg(F.count("*").alias("size"))
        chunks = F.ceil(F.col("size") / BLOCK).cast("int")
        own = found.join(size, "component").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        own = own.join(self.node.select("id", "vec", "copies"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        own = own.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
        # small components share a group of about 1,000 vectors; a block pair of a large one is a group
        shared = F.pmod(F.xxhash64("component"), F.lit(max(1, self.node.count() // 1000))).cast("long")
        group = F.when(F.col("chunks") == 1, shared).otherwise(F.xxhash64("component", "i", "j"))
        counted = own.withColumn("group", group).select("group", "id", "component", "chunk", "i", "j", "copies", "vec")
        counts = counted.groupBy("group", "i", "j").applyInPandas(_count_block(self.threshold), "id long, links long")
        total = counts.groupBy("id").agg(F.sum("links").alias("links"))
        return self.scratch.keep(found.join(total, "id"), "linked")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal label and length whose cosine reaches ``threshold`` are linked; component_id is the smallest id
    reachable. A vector that is null, empty, zero, or holds a null or a non-finite component, and one without a label,
    links with nothing. Copies of a vector link with each other. A null id has no component and is not kept, though it
    is counted nowhere. Other columns are not read; repeated rows each count.
    """
    search = VectorSearch(vectors, threshold)
    linked = search.run()
    kinds = search.node.join(linked, "id", "left").select(
        "part", F.md5("vec").alias("copy"), F.coalesce("component", "id").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    rows = search.rows.select("vec_id", "part", F.col("copy"))
    joined = rows.join(kinds, ["part", "copy"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
