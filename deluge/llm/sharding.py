"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked.  All members of a group in one shard are alike, so
the graph's state is a table (group, shard, members): at most one row per group and shard,
gathered by a partial aggregate, however large a group is.  The start deals documents out in
turn, so every shard has its quota from the beginning.  In each round a group's members move
towards the shard that holds most of their neighbours.  How many may go from shard to shard is
found from counts per pair of shards: opposite wishes are swapped row for row, longer cycles
likewise, and chains end in free room.  What may go is handed out by what each bucket of groups
asks for, so that no window spans all groups.  Members refused by full shards look for the best
other one.  Unlinked documents have no edges and fill what capacity is left, so counts end at
most one apart whatever the groups do.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deluge.llm.common import cut, documents_of, salted_rank

#: Groups whose moves are ranked together in one window.
BUCKET_GROUPS = 50_000
#: Passes without a move, each with other ties, after which propagation ends.
QUIET = 3


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = dict(state.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # one row per shard
    return [int(got.get(s) or 0) for s in range(shards)]


def _granted(wish: DataFrame, keys: list[str], quota: DataFrame) -> DataFrame:
    """``wish`` with the rows ``m`` of each piece that fit the ``quota`` of its ``keys``, larger pieces first.

    Pieces are numbered through over size classes and buckets of groups; what the classes and buckets
    before one ask for is a small aggregate, so a quota is used up wherever it is asked for.
    """
    part = [*keys, "late", "size", "b"]
    wish = wish.withColumn("size", F.when(F.col("late"), 1).otherwise(-1) * F.floor(F.log2("n")))
    asked = wish.groupBy(*part).agg(F.sum("n").alias("asked"))
    earlier = Window.partitionBy(*keys).orderBy("late", "size", "b").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.select(*part, F.coalesce(F.sum("asked").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy(*part).orderBy(F.desc("n"), "g", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return (wish.join(asked, part).join(F.broadcast(quota), keys)
            .withColumn("m", F.least("n", F.greatest(F.col("quota") - before, F.lit(0))).cast("long")).where("m > 0"))


def _flows(wish: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may move from shard to shard so that none exceeds its room: swaps, then chains and cycles.

    Works on counts per pair of shards, not on rows.  Ends when no wish can be granted any more.
    """
    left, free, out = dict(wish), list(free), {}

    def push(path):  # path: shards in order
        edges = list(zip(path, path[1:]))
        closed = path[0] == path[-1]
        m = min([left[e] for e in edges] + ([] if closed else [free[path[-1]]]))
        for e in edges:
            left[e] -= m
            out[e] = out.get(e, 0) + m
        if not closed:
            free[path[-1]] -= m
            free[path[0]] += m

    def path_of(i, j):
        """From i over j, by a shortest way, to a shard with room or back to i."""
        came, queue = {j: None}, [j]
        for at in queue:
            if free[at] > 0 and at != i or at == i:
                way = [at]
                while came[way[-1]] is not None:
                    way.append(came[way[-1]])
                return [i, *way[::-1]]
            for (x, y), n in left.items():
                if x == at and n > 0 and y not in came:
                    came[y] = at
                    queue.append(y)
        return None

    for i, j in wish:
        if i < j and min(left[i, j], left.get((j, i), 0)) > 0:
            push([i, j, i])
    moved = True
    while moved:
        moved = False
        for i, j in wish:
            while left[i, j] > 0 and (path := path_of(i, j)):
                push(path)
                moved = True
    return out


def _table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows of longs (at most shards squared) as literals of the plan."""
    literals = [F.struct(*[F.lit(int(v)).cast("long").alias(n) for n, v in zip(names, row)]) for row in rows]
    some = F.array(*literals) if rows else F.array().cast(f"array<struct<{','.join(f'{n}:bigint' for n in names)}>>")
    return spark.range(1).select(F.explode(some).alias("r")).select("r.*")


def _weight(state: DataFrame) -> int:
    """Grows with the links that lie within a shard."""
    return int(state.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0] or 0)


def propagate(state: DataFrame, capacity: list[int], rounds: int) -> DataFrame:
    """Moves members between shards until nothing moves; ``rounds`` is a safety bound that warns.

    A round may only grow the links within shards.  Members that cannot enter the shard with most
    neighbours look for the best other one; a pass ends when all such shards are closed, and
    propagation ends with a number of passes without a move.  Ties are dealt anew in each round.
    """
    shards, spark = len(capacity), state.sparkSession
    buckets = max(1, state.select("g").distinct().count() // BUCKET_GROUPS)
    weight, closed, loose, quiet, moved = _weight(state), set(), True, 0, False
    for turn in range(rounds):
        free = [c - n for c, n in zip(capacity, _loads(state, shards))]
        rank = F.struct("n", F.xxhash64("g", "shard", F.lit(turn)).alias("h"), F.col("shard").cast("long").alias("shard"))
        best = F.max(F.when(~F.col("shard").isin(*closed), rank)) if closed else F.max(rank)
        target = state.groupBy("g").agg(best.alias("t"), F.sum("n").alias("members"), F.count("*").alias("parts"))
        target = target.where("parts > 1 and t is not null").select(
            "g", "members", F.col("t.shard").alias("to"), F.col("t.n").alias("t_n"))
        wish = state.join(target, "g").where("shard != to").withColumn("late", F.col("n") > F.col("t_n"))
        # The larger part follows the smaller one only as a whole, else links would be lost.
        wish = cut(wish.where(~F.col("late") | (F.col("members") <= max(capacity))).select(
            "g", F.col("shard").cast("long").alias("shard"), "to", "n", "late",
            F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("b")))
        asked: dict[bool, dict] = {False: {}, True: {}}
        for r in wish.groupBy("late", "shard", "to").agg(F.sum("n").alias("n")).collect():  # shards squared at most
            asked[r.late][r.shard, r.to] = int(r.n)
        every = {e: asked[False].get(e, 0) + asked[True].get(e, 0) for e in {**asked[False], **asked[True]}}
        flow = _flows(dict(sorted((every if loose else asked[False]).items())), free)
        got = wish if loose else wish.where(~F.col("late"))
        moves = _granted(got, ["shard", "to"], _table(spark, [(*e, n) for e, n in flow.items()], ["shard", "to", "quota"]))
        moves = moves.select("g", "shard", "to", "m")
        if not loose:  # larger parts as a whole into the room that is left
            for (i, j), n in flow.items():
                free[j] -= n
            room = _table(spark, [(s, f) for s, f in enumerate(free) if f > 0], ["to", "quota"])
            moves = moves.unionByName(_granted(wish.where("late"), ["to"], room).where("m = n").select("g", "shard", "to", "m"))
        moves = cut(moves)
        went = {(r.shard, r.to): int(r.m) for r in moves.groupBy("shard", "to").agg(F.sum("m").alias("m")).collect()}
        refused = {e[1] for e, n in every.items() if went.get(e, 0) < n}
        if went:
            after = cut(state.select("g", F.col("shard").cast("long").alias("shard"), "n")
                        .unionByName(moves.select("g", "shard", (-F.col("m")).alias("n")))
                        .unionByName(moves.select("g", F.col("to").alias("shard"), F.col("m").alias("n")))
                        .groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
            grown = _weight(after)
            if grown > weight:
                state, weight, moved = after, grown, True
            elif loose:
                loose = False  # the same wishes again, larger parts only into free room
                continue
        loose = True
        if refused - closed:
            closed |= refused
            continue
        if not every and not closed:
            return state  # every group is whole
        quiet, closed = (0 if moved else quiet + 1), set()
        if quiet == QUIET:
            return state
        moved = False
    warnings.warn(f"label propagation still moved rows after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return state


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 1000,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    The law is ``rows``: shard counts differ by at most one.  Null and empty texts are equal
    texts of size 1.  Null ids and repeated rows are rows like any other.  ``grown_shard`` is
    null, since a further shard would take rows from all others to keep the counts even.
    """
    text = F.coalesce("text", F.lit(""))
    base = documents_of(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("g"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows are numbered as they are written, so that even equal rows can be spread.
    base = cut(base.withColumn("at", F.monotonically_increasing_id()).withColumn("all", F.lit(0)))
    base = base.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(spread)))
    rows = base.count()
    capacity = [rows // shards + (s < rows % shards) for s in range(shards)]

    dealt = salted_rank(base, ["all"], ["doc_id", "g", "at"], "salt", "r")
    counts = dealt.groupBy("g", F.pmod("r", F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    counts = cut(counts)
    linked = cut(counts.groupBy("g").agg(F.sum("n").alias("members")).where("members > 1"))
    state = propagate(cut(counts.join(linked.select("g"), "g", "left_semi")), capacity, rounds)

    # Unlinked documents are one more "group" that fills each shard up to its capacity.
    left = [c - n for c, n in zip(capacity, _loads(state, shards))]
    parts = state.select("g", F.col("shard").cast("long").alias("shard"), "n")
    # Per group its shards in order with the ranks from which on they hold: at most one entry a shard.
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("shard"))
    ranges = parts.select("g", F.struct(upto.alias("upto"), "shard").alias("part")).groupBy("g").agg(
        F.sort_array(F.collect_list("part")).alias("parts")).withColumnRenamed("g", "owner")
    owned = base.join(linked.select(F.col("g").alias("lg")), F.col("g") == F.col("lg"), "left").withColumn(
        "owner", F.coalesce("lg", F.lit(""))).drop("lg")
    ranked = cut(salted_rank(cut(owned), ["owner"], ["doc_id", "g", "at"], "salt", "r"))
    own = "doc_id", "size", "text_crc32", "salt", "at"
    grouped = ranked.where("owner != ''").join(ranges, "owner").select(
        *own, F.expr("filter(parts, p -> r < p.upto)[0].shard").cast("int").alias("shard"))
    # The unlinked rows, which may be most, need no join: the first shard whose room their number lies in.
    alone, upto_ = F.lit(None).cast("int"), sum(left)
    for shard, n in reversed(list(enumerate(left))):
        if n > 0:
            alone = F.when(F.col("r") < upto_, F.lit(shard)) if upto_ == sum(left) else F.when(F.col("r") < upto_, F.lit(shard)).otherwise(alone)
            upto_ -= n
    placed = cut(grouped.unionByName(ranked.where("owner = ''").select(*own, alone.alias("shard"))))
    return salted_rank(placed, ["shard"], ["doc_id", "text_crc32", "at"], "salt", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
