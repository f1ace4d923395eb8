"""Sharding: minimum-cost-flow resharding.

Documents lie in old shards; new shards, more or fewer, have capacities. Each
old shard is cut into a fixed number of blocks by a hash of the row, so what the
driver sees is ``shards x blocks`` sums whatever the corpus holds. A minimum-cost
flow (cost 1 a byte that leaves its shard, 0 a byte that stays) says how many
bytes go from which old shard to which new one; whole blocks then realise the
flow as nearly as blocks can, and the files of shards that lose or gain a block
are rewritten, no others. The capacities must hold the corpus; blocks may
overfill one by less than a block. A block that is too large to level shards
with (repeats of one row) is cut again by row number.

Texts are read once for their sizes and checksums; ranks within a shard go over
narrow rows, dealt by ranges so that no block is one task's work.

Defined cases: null text has size 1 (no bytes plus 1) and checksum 0, like an
empty one; null ``source`` counts as the empty string; null ``doc_id`` and
repeated rows are ordinary rows, and rows that agree in every used column may
swap slots among themselves; an empty table gives an empty result; the stage
passes all other columns through, but for ``shard`` and ``slot``, which its own
replace.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, discard, numbered, release, running, table

N_SHARDS = 16
BLOCKS = 1024
#: A block of more than this part of a mean new shard is cut again.
HEAVY = 16
#: A pair of old shard and block; both bounds are fixed, so the plan is too.
PLAN_SCHEMA = "old_shard int, block int, shard int"


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest integral flow from suppliers to consumers by successive shortest paths.

    Total supply must not exceed total demand. ``cost[i][j]`` is for one unit.
    """
    m, n = len(supply), len(demand)
    source, sink = m + n, m + n + 1
    to, cap, price, edges = [], [], [], [[] for _ in range(m + n + 2)]

    def add(u: int, v: int, c: int, w: int) -> None:
        for a, b, k, p in ((u, v, c, w), (v, u, 0, -w)):
            edges[a].append(len(to))
            to.append(b)
            cap.append(k)
            price.append(p)

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for j, d in enumerate(demand):
        add(m + j, sink, d, 0)
    first = len(to)
    for i in range(m):
        for j in range(n):
            add(i, m + j, min(supply[i], demand[j]), cost[i][j])
    while True:
        dist, via = {source: 0}, {}
        queue = [source]
        while queue:
            following = []
            for u in queue:
                for e in edges[u]:
                    if cap[e] > 0 and dist[u] + price[e] < dist.get(to[e], 1 << 60):
                        dist[to[e]], via[to[e]] = dist[u] + price[e], e
                        following.append(to[e])
            queue = list(dict.fromkeys(following))
        if sink not in dist:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flow = [[0] * n for _ in range(m)]
    for i in range(m):
        for j in range(n):
            flow[i][j] = cap[first + 2 * (i * n + j) + 1]
    return flow


@dataclass
class Plan:
    """Where each block goes, and what that moves."""

    moves: dict[tuple[int, int], int]
    flow: list[list[int]]
    old_bytes: list[int]
    new_bytes: list[int]
    moved_bytes: int
    affected: set[int] = field(default_factory=set)


def solve(blocks: list[tuple[int, int, int]], capacity: list[int]) -> Plan:
    """blocks: (old shard, block, bytes). capacity: bytes of each new shard; old ones beyond their number are emptied."""
    m, n = max((s + 1 for s, _, _ in blocks), default=0), len(capacity)
    old = [0] * m
    for shard, _, size in blocks:
        old[shard] += size
    if sum(old) > sum(capacity):
        raise ValueError(f"{sum(old)} bytes do not fit into {sum(capacity)}")
    flow = min_cost_flow(old, capacity, [[int(i != j) for j in range(n)] for i in range(m)])
    moves = {}
    left = [row[:] for row in flow]
    new = [0] * n
    for s, b, size in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        # To the shard that is to get most from here as yet; of equal ones to its own.
        j = max(range(n), key=lambda j: (left[s][j], j == s, -j))
        left[s][j] -= size
        moves[s, b] = j
        new[j] += size
    level(blocks, moves, new, capacity)
    gone = [(s, moves[s, b], size) for s, b, size in blocks if moves[s, b] != s]
    return Plan(moves, flow, old, new, sum(x[2] for x in gone), {x for g in gone for x in g[:2]})


def level(blocks: list, moves: dict, new: list[int], capacity: list[int]) -> None:
    """Blocks are whole: what the flow leaves over is evened out block by block."""
    n = len(capacity)
    held: list[list] = [[] for _ in range(n)]
    for s, b, size in blocks:
        if size:
            bisect.insort(held[moves[s, b]], (size, s, b))
    for _ in range(64 * n):
        over = sorted(range(n), key=lambda i: new[i] - capacity[i])
        low, high = over[0], over[-1]
        if new[high] <= capacity[high]:
            return
        gap = (new[high] - capacity[high]) - (new[low] - capacity[low])
        at = bisect.bisect_left(held[high], (gap / 2, 0, 0))
        best = min((held[high][k] for k in (at - 1, at) if 0 <= k < len(held[high])), key=lambda x: abs(2 * x[0] - gap), default=None)
        if best is None or best[0] >= gap:
            return
        size, s, b = best
        held[high].remove(best)
        bisect.insort(held[low], best)
        moves[s, b] = low
        new[high] -= size
        new[low] += size


def assign(spark: SparkSession, rows: DataFrame, capacities: list[int] | None = None, n_shards: int = N_SHARDS, blocks: int = BLOCKS) -> tuple[DataFrame, Plan]:
    """``rows`` with size, text_crc32, shard and slot instead of their text, and the plan.

    rows: id (tells rows apart), doc_id, text, old_shard (0 or more). capacities: bytes of each new shard; without them ``n_shards``
    equal ones. The plan has at most ``blocks + HEAVY * 4`` rows an old shard, so it is broadcast.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long"))
    base = rows.select("id", F.col("doc_id").cast("long").alias("doc_id"), F.col("old_shard").cast("int").alias("old_shard"), size.alias("size"), crc.alias("text_crc32"))
    written = base = cut(spark, base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int")), "blocks")
    per_block = lambda df: [tuple(r) for r in df.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).collect()]
    found = per_block(base)
    total = sum(x[2] for x in found)
    capacities = capacities or [total // n_shards + (i < total % n_shards) for i in range(n_shards)]
    heavy = [(s, b) for s, b, size in found if size * HEAVY * len(capacities) > total]
    if heavy and total > HEAVY * len(capacities):
        again = F.broadcast(spark.createDataFrame([(s, b, blocks + k) for k, (s, b) in enumerate(sorted(heavy))], "old_shard int, block int, _first int"))
        parts = blocks * F.pmod(F.xxhash64("id"), F.lit(HEAVY * 4))
        base = base.join(again, ["old_shard", "block"], "left").withColumn("block", F.coalesce(F.col("_first") + parts, F.col("block")).cast("int")).drop("_first")
        found = per_block(base)
    plan = solve(found, capacities)
    where = F.broadcast(spark.createDataFrame([(s, b, to) for (s, b), to in plan.moves.items()], PLAN_SCHEMA))
    placed = running(spark, base.join(where, ["old_shard", "block"]), ["shard"], ["old_shard", "block", "doc_id", "text_crc32", "size", "id"], None, "slots")
    discard(written)
    return placed.select("id", "doc_id", "size", "text_crc32", "old_shard", "shard", F.col("before").cast("long").alias("slot")), plan


def old_layout(source, n_shards: int = N_SHARDS):
    """The layout that is to be levelled: one shard takes all of a source."""
    return F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), F.lit(n_shards)).cast("int")


def rewrite(spark: SparkSession, old_dir: str, assigned: DataFrame, plan: Plan, new_dir: str) -> dict[int, str]:
    """Write the shards that the plan changes as ``new_dir/shard=i``; the folder of each new shard.

    assigned: the whole rows with shard and slot. Shards that lose and gain
    nothing stay where they are in ``old_dir``.
    """
    if plan.affected:
        changed = assigned.filter(F.col("shard").isin(sorted(plan.affected)))
        changed.repartition(4 * len(plan.affected), "shard", F.pmod("slot", F.lit(4))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(new_dir)
    return {i: f"{new_dir if i in plan.affected else old_dir}/shard={i}" for i in range(len(plan.new_bytes))}


def shards(docs: DataFrame) -> DataFrame:
    """The contract's columns for whole ``documents``, law ``bytes``."""
    rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", F.col("text").cast("string").alias("text"), old_layout(F.col("source")).alias("old_shard"))
    out, _ = assign(docs.sparkSession, rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "old_shard")


def op7_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents with their shard and slot, instead of columns of these names."""
    release(spark)
    staged = numbered(spark, docs.drop("shard", "slot"), "sharded")
    out, _ = assign(spark, staged.select("id", "row.doc_id", F.col("row.text").cast("string").alias("text"), old_layout(F.col("row.source")).alias("old_shard")))
    return staged.join(out.select("id", "shard", "slot"), "id").select("row.*", "shard", "slot")
