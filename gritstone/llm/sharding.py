"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents are dealt to shards by rank, so counts differ by one at most. Groups that are a notable part of a shard come
first, one after the other, so that each fills as few shards as hold it, and stay there. Then, in rounds, every other
document of a group wants the shard in which most of its group lies. How many may go from each shard to each other is
settled on the matrix of wishes (shards x shards numbers): movers that come in are balanced by movers that go out and by
documents without links, which have nothing to lose. A shard that had to refuse some is closed: what lies there stays, and
the rest of a group wants the next fullest shard. So every round cuts fewer links and no round changes a shard's count, and
rounds go on until nobody moves.

Links may also come as a table of edges. Then rows without a group follow, in further rounds, the shard that holds most of
their neighbours. Of neighbours that wish to move at once only the one that gains most does, so a round never cuts more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gritstone.llm.store import Scratch

SHARDS = 24
LARGE = 8  # a group of a shard's rows divided by this is dealt first
SALTS, SALT_ROWS = 64, 4_000_000  # least parts that the rows of one label are numbered in, and most rows of a part on average
HUB = 10_000  # edges of a row from which on it is dealt to several tasks
LEAST_GAIN = 0.001  # of all edges; a round over edges that saves fewer is the last


def salts_for(rows: int) -> int:
    return max(SALTS, -(-rows // SALT_ROWS))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with a gapless number from 0 within ``by``.

    Each label is numbered in ``salts`` parts by hash of ``order``, and the parts are set end to end, so that no task holds
    a whole label. ``order`` should tell rows apart; rows that it doesn't are numbered in any order.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    rows = rows.withColumn("__salt", salt)
    parts = rows.groupBy(*by, "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order)) - 1
    joined = rows.withColumn("__own", own).join(F.broadcast(parts), [*by, "__salt"]) if by else rows.withColumn("__own", own).join(F.broadcast(parts), "__salt")
    return joined.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before", "__salt")


def settle(wish: list[list[int]], free: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """(moves, fillers): how many movers, and how many of the ``free`` rows, go from each shard to each other.

    No shard's count changes. Where a shard's free rows cannot make room for all who wish to come, the wishes are cut,
    from the shards with most of them first.
    """
    k = len(free)
    move = [list(r) for r in wish]
    excess = lambda j: sum(move[i][j] for i in range(k)) - sum(move[j])
    while True:
        over = [(excess(j) - free[j], j) for j in range(k) if excess(j) > free[j]]
        if not over:
            break
        too_many, j = max(over)
        for i in sorted(range(k), key=lambda i: -move[i][j]):
            cut = min(too_many, move[i][j])
            move[i][j] -= cut
            too_many -= cut
    fill = [[0] * k for _ in range(k)]
    need = {j: -excess(j) for j in range(k) if excess(j) < 0}
    for j in range(k):
        give = max(0, excess(j))
        for to in list(need):
            take = min(give, need[to])
            fill[j][to] += take
            give -= take
            need[to] -= take
            if not need[to]:
                del need[to]
    return move, fill


def _target(quota: list[list[int]]) -> Column:
    """Shard to go to for the row numbered ``n`` of ``shard``, by quotas laid end to end; null where they are used up."""
    out = F.lit(None).cast("int")
    for i, row in enumerate(quota):
        end = 0
        for j, q in enumerate(row):
            if q:
                out = F.when((F.col("shard") == i) & F.col("n").between(end, end + q - 1), F.lit(j)).otherwise(out)
                end += q
    return out


def _moved(now: DataFrame, moving: DataFrame, move: list[list[int]], fill: list[list[int]], order: list[str], loose: str, salts: int, scratch: Scratch) -> DataFrame:
    """``now`` after ``moving`` (row, shard, to) within the quotas ``move``, and rows that are ``loose`` by the quotas ``fill``.

    Both tables are dropped.
    """
    quota = [(i, j, q) for i, row in enumerate(move) for j, q in enumerate(row)]
    quota = now.sparkSession.createDataFrame(quota, "shard int, to int, quota long")
    # in the order given as far as a row's salt allows, such as whole groups first
    going = numbered(moving, ["shard", "to"], order, "n", salts).join(F.broadcast(quota), ["shard", "to"])
    going = going.where("n < quota").select("row", "to")
    filling = numbered(now.where(loose).select("row", "shard"), ["shard"], ["row"], "n", salts)
    filling = filling.withColumn("to", _target(fill)).where("`to` is not null").select("row", "to")
    after = now.join(going.union(filling), "row", "left").withColumn("shard", F.coalesce("to", "shard")).select(now.columns)
    after = scratch.keep(after, "labels")
    scratch.drop(now, moving)
    return after


def _follow_edges(now: DataFrame, edges: DataFrame, shards: int, salts: int, scratch: Scratch) -> DataFrame:
    """``now`` after rows without a group went to the shards of most of their neighbours, a round at a time.

    A row with very many edges is dealt to a task for each HUB of them, and its shard is sent to each of these. Rounds end
    when no balanced moves are left, or fewer than LEAST_GAIN of the edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    known = now.select(F.col("row").alias("a"))
    both = scratch.keep(both.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "both")
    count = both.count() // 2
    parts = scratch.keep(both.groupBy(F.col("a").alias("row")).agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")), "parts")
    at = scratch.keep(now.join(parts, "row", "left"), "labels")
    scratch.drop(now)
    loose = "`group` is null and parts is null"
    many = both.join(parts.where("parts > 1").withColumnRenamed("row", "b"), "b", "left")
    dealt = scratch.keep(many.select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "edges")

    def sent(rows: DataFrame, *columns: str) -> DataFrame:
        """Columns of ``rows`` for each edge that ends in them."""
        spread = rows.select(F.col("row").alias("b"), *columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return dealt.join(spread, ["b", "part"])

    while True:
        linked = at.where("parts is not null")
        votes = sent(linked, "shard").groupBy("a", "shard").agg(F.count("*").alias("n"))
        mine = linked.where("`group` is null").select(F.col("row").alias("a"), F.col("shard").alias("own"), "parts")
        there = F.col("shard") != F.col("own")
        best = votes.join(mine, "a").groupBy("a", "own", "parts").agg(
            F.coalesce(F.max(F.when(~there, F.col("n"))), F.lit(0)).alias("have"),
            F.max(F.when(there, F.struct("n", F.xxhash64("a", "shard").alias("tie"), "shard"))).alias("best"),
        )
        gain = F.col("best.n") - F.col("have")
        wishes = best.where(gain > 0).select(F.col("a").alias("row"), F.col("own").alias("shard"), F.col("best.shard").alias("to"), gain.alias("gain"), "parts")
        wishes = scratch.keep(wishes.withColumn("rank", F.struct("gain", F.xxhash64("row").alias("tie"), "row")), "wishes")
        rivals = sent(wishes, "rank").groupBy(F.col("a").alias("row")).agg(F.max("rank").alias("rival"))
        first = wishes.join(rivals, "row", "left").where("rival is null or rank > rival")
        moving = scratch.keep(first.select("row", "shard", "to", (-F.col("gain")).alias("order")), "moving")
        wish, free = [[0] * shards for _ in range(shards)], [0] * shards
        for r in moving.groupBy("shard", "to").count().collect():  # shards x shards numbers at most
            wish[r["shard"]][r["to"]] = r["count"]
        for r in at.where(loose).groupBy("shard").count().collect():
            free[r["shard"]] = r["count"]
        move, fill = settle(wish, free)
        scratch.drop(wishes)
        moves = sum(map(sum, move))
        if not moves:
            return at
        at = _moved(at, moving, move, fill, ["order", "row"], loose, salts, scratch)
        if moves < LEAST_GAIN * count:
            return at


def balanced_labels(links: DataFrame, shards: int = SHARDS, edges: DataFrame | None = None) -> DataFrame:
    """(row, group, shard) for rows of (row, group), row unique. Rows of a group are linked, and so are those that a row
    (a, b) of ``edges`` names; edges may come once or twice, either way round, and those to no row or to itself don't count.

    Shard counts differ by one at most. A group larger than a shard fills several, one after the other. Groups of several
    rows settle first and then stay; over edges only rows outside of such groups move.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "sharding")
    total = links.count()
    salts = salts_for(total)
    rest, more = divmod(total, shards)  # rows of a shard; so many shards have one more
    sizes = scratch.keep(links.where("`group` is not null").groupBy("group").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    large, first = [], 0
    for r in sizes.where(F.col("size") * LARGE >= rest).orderBy(F.desc("size"), "group").collect():  # LARGE x (shards + 1) rows at most, but for tiny tables
        large.append((r["group"], first))
        first += r["size"]
    large = spark.createDataFrame(large, links.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("first")).schema)
    linked = links.join(sizes.select(F.col("group").alias("g")), F.col("group") == F.col("g"), "left").drop("group")
    linked = scratch.keep(linked.join(F.broadcast(large), "g", "left").select("row", F.col("g").alias("group"), "first"), "linked")
    ahead = numbered(linked.where("first is not null"), ["group"], ["row"], "n", salts).withColumn("rank", F.col("first") + F.col("n"))
    behind = numbered(linked.where("first is null"), [], ["row"], "n", salts).withColumn("rank", F.col("n") + first)
    wide = more * (rest + 1)  # rows of the shards that have one more
    shard = F.when(F.col("rank") < wide, F.floor(F.col("rank") / (rest + 1))).otherwise(more + F.floor((F.col("rank") - wide) / max(rest, 1)))
    dealt = ahead.select("row", "group", "first", "rank").union(behind.select("row", "group", "first", "rank"))
    now = scratch.keep(dealt.select("row", "group", F.col("first").isNotNull().alias("stays"), shard.cast("int").alias("shard")), "dealt")
    closed: set[int] = set()
    while True:  # ends: a round adds pairs of a group in one shard, or closes a shard
        members = now.where("`group` is not null and not stays")
        members = members.where(~F.col("shard").isin(sorted(closed))) if closed else members
        most = members.groupBy("group", "shard").agg(F.count("*").alias("size")).groupBy("group")
        most = most.agg(F.max_by("shard", F.struct("size", F.xxhash64("group", "shard"))).alias("to"))
        moving = scratch.keep(members.join(most, "group").where("shard <> to").select("row", "group", "shard", "to"), "wishes")
        wish = [[0] * shards for _ in range(shards)]
        for r in moving.groupBy("shard", "to").count().collect():  # shards x shards numbers at most
            wish[r["shard"]][r["to"]] = r["count"]
        if not any(map(any, wish)):
            scratch.drop(moving)
            break
        free = [0] * shards
        for r in now.where("`group` is null").groupBy("shard").count().collect():
            free[r["shard"]] = r["count"]
        move, fill = settle(wish, free)
        closed |= {j for j in range(shards) if any(move[i][j] < wish[i][j] for i in range(shards))}
        if not any(map(any, move)):
            scratch.drop(moving)
            continue  # a shard was closed
        now = _moved(now, moving, move, fill, ["group", "row"], "`group` is null", salts, scratch)
    if edges is not None:
        now = _follow_edges(now, edges, shards, salts, scratch)
    scratch.clear(now)
    return now.select("row", "group", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, edges: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of ``docs`` (doc_id and text).

    Documents of equal text are linked, and so are those whose ids a row (a, b) of ``edges`` names, such as pages with a
    link or near-duplicates: rows of one id by the first of them, null and unknown ids not at all. Size is the text's UTF-8 bytes plus 8. A null text has no bytes, the checksum of
    nothing, and no links; repeated rows are rows of their own. Slots are gapless from 0 in each shard. Other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("binary"))).alias("group"),
    )
    rows = scratch.keep(rows, "rows")  # numbers of rows must not change when a task runs again
    if edges is not None:
        first = rows.groupBy("doc_id").agg(F.min("row").alias("row"))
        ends = [first.select(F.col("doc_id").alias(x), F.col("row").alias(f"row_{x}")) for x in "ab"]
        edges = edges.select("a", "b").join(ends[0], "a").join(ends[1], "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    labels = balanced_labels(rows.select("row", "group"), shards, edges).select("row", "shard")
    return numbered(rows.drop("group").join(labels, "row"), ["shard"], ["row"], "slot", salts_for(rows.count())).drop("row")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
