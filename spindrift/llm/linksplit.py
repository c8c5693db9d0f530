"""Problem 5: splits that keep related records together.

Links are edges between two kinds of nodes (here sources and catalyst ids). Every task turns its
edges into a spanning forest by union-find; forests are merged over ever fewer tasks, so what is
shuffled shrinks to one edge for each node. A merging task holds at most MERGE_EDGES edges; where
the forest is larger, label propagation by joins (large-star / small-star) does the rest, so no
task ever holds more. Groups are then given to splits, largest first, each to the split furthest
below its target, from a histogram of group sizes rather than from the groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import bare
from spindrift.operators.ranking import global_index
from spindrift.session import cut

#: Most edges a merging task may hold (about 200 bytes each in Python).
MERGE_EDGES = 2_000_000
#: Members of a group that one task pairs with the whole group.
PAIR_BLOCK = 1000
#: Forests of this many tasks go to one task of the next level.
FAN_IN = 8


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the task's edges: (node, smallest node of its tree), roots left out."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ra, rc = find(a), find(c)
            if ra != rc:
                if rc < ra:
                    ra, rc = rc, ra
                parent[rc] = ra
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([find(x) for x in part], pa.string())], names=["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star and small-star rounds until every node points at its smallest node."""
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        edges = cut(
            small.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low2.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == known:
            return edges
        known = tuple(now)


def components(edges: DataFrame, merge_edges: int = MERGE_EDGES) -> DataFrame:
    """(node, root) for each node of edges (a, b strings, not null); root is the smallest node of
    the component. Repeated edges and loops are harmless; no edges give no rows."""
    forest = cut(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a string, b string"))
    tasks = max(1, forest.rdd.getNumPartitions())
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        if forest.count() > merge_edges * tasks:
            break
        forest = cut(forest.repartition(tasks).mapInArrow(_forest, "a string, b string"))
    else:
        tasks = 1
    flat = forest if tasks == 1 and forest.count() <= merge_edges else _stars(forest)
    roots = flat.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return flat.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def link_keys(df: DataFrame, source: str, entity: str) -> DataFrame:
    """df's two linking columns as keys __s, __e: letters and digits alone; null where they name
    nothing (null or no letter or digit at all; an entity without a digit)."""
    s, e = bare(F.col(f"`{source}`")), bare(F.col(f"`{entity}`"))
    return df.withColumn("__s", F.when(F.length(s) > 0, s)).withColumn("__e", F.when(e.rlike(r"\p{N}"), e))


def linked_sources(df: DataFrame, source: str, entity: str) -> DataFrame:
    """(__s, root): each source key once with the root of its group; unlinked sources are their own root."""
    k = cut(link_keys(df, source, entity).select("__s", "__e").filter("__s is not null").distinct())
    edges = k.filter("__e is not null").select(F.concat(F.lit("s:"), "__s").alias("a"), F.concat(F.lit("i:"), "__e").alias("b"))
    comp = components(edges)
    own = comp.filter(F.col("node").startswith("s:")).select(F.expr("substr(node, 3)").alias("__s"), "root")
    return k.select("__s").distinct().join(own, "__s", "left").select("__s", F.coalesce("root", F.concat(F.lit("s:"), "__s")).alias("root"))


def linked_groups(df: DataFrame, source: str, entity: str) -> DataFrame:
    """(source, representative, n_sources): every source key with the smallest source key of its group and the group's
    size. One row a source, however large a group is; single sources represent themselves."""
    m = cut(linked_sources(df, source, entity))
    g = m.groupBy("root").agg(F.min("__s").alias("representative"), F.count(F.lit(1)).alias("n_sources"))
    return m.join(g, "root").select(F.col("__s").alias("source"), "representative", "n_sources")


def linked_pairs(groups: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(source_a, source_b): all pairs of the groups of linked_groups, smaller first. A large group is cut into blocks of
    its members, each of which meets the whole group in a task of its own."""
    several = groups.filter("n_sources > 1").withColumn("blocks", F.ceil(F.col("n_sources") / block).cast("int"))
    x = several.select("representative", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("part"), F.col("source").alias("source_a"))
    y = several.select("representative", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("source").alias("source_b"))
    return x.join(y, ["representative", "part"]).filter("source_a < source_b").select("source_a", "source_b")


def apportion(histogram: list[tuple[int, int]], targets: list[tuple[str, float]]) -> dict[int, list[int]]:
    """Groups of each size that each split gets: largest size first, every group to the split
    furthest below its target (the earlier of equals). Equal groups are given in bulk: the level to
    which the greedy rule lowers the deficits is found by bisection, the last few one by one."""
    total = sum(s * n for s, n in histogram)
    share = sum(max(0.0, t) for _, t in targets) or 1.0
    lack = [total * max(0.0, t) / share for _, t in targets]
    out: dict[int, list[int]] = {}
    for size, n in sorted(histogram, reverse=True):
        given = [0] * len(targets)
        lo, hi = min(lack) - size * (n + 1), max(lack)
        taken = lambda level: [max(0, int((x - level) // size)) for x in lack]
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(taken(mid)) <= n:
                hi = mid
            else:
                lo = mid
        given = taken(hi) if sum(taken(hi)) <= n else given
        heap = [(-(x - size * g), i) for i, (x, g) in enumerate(zip(lack, given))]
        heapq.heapify(heap)
        for _ in range(n - sum(given)):
            d, i = heapq.heappop(heap)
            given[i] += 1
            heapq.heappush(heap, (d + size, i))
        lack = [x - size * g for x, g in zip(lack, given)]
        out[size] = given
    return out


def grouped_split(df: DataFrame, row_id: str, source: str, entity: str, targets: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """(row_id, split): all records linked by source or entity get one split.

    A record without source follows its entity; one without either is a group of its own. Which of
    several equally large groups goes where is drawn by a seeded hash. Shares need not sum to 1.
    An empty table gives no rows; a group larger than a split's share still stays whole.
    """
    k = link_keys(df, source, entity).select(F.col(f"`{row_id}`").alias("__row"), "__s", "__e")
    edges = (
        k.filter("__s is not null and __e is not null").select("__s", "__e").distinct()
        .select(F.concat(F.lit("s:"), "__s").alias("a"), F.concat(F.lit("i:"), "__e").alias("b"))
    )
    comp = cut(components(edges))
    node = F.coalesce(F.concat(F.lit("s:"), "__s"), F.concat(F.lit("i:"), "__e"), F.concat(F.lit("r:"), F.col("__row").cast("string")))
    k = k.select("__row", node.alias("node"))
    # a hot source would pull its rows into one task: sizes are counted by node first (map-side),
    # and only the node table, one row for each node, is joined with the components
    sizes = cut(
        k.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    groups = cut(sizes.groupBy("root").agg(F.sum("n").alias("n")))
    histogram = [(r.n, r.k) for r in groups.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()]  # at most sqrt(2 * rows) sizes
    plan = apportion(histogram, targets)
    spark = df.sparkSession
    bounds, start = [], 0
    for size, given in sorted(plan.items(), reverse=True):
        for (name, _), n in zip(targets, given):
            if n:
                bounds.append((size, start, start + n, name))
                start += n
    table = spark.createDataFrame(bounds, "n bigint, lo bigint, hi bigint, split string")
    ranked = global_index(groups.withColumn("h", F.xxhash64(F.lit(seed), "root")), [F.desc("n"), "h", "root"], "at")
    # the table has at most splits * sqrt(2 * rows) rows; Spark broadcasts it only under its own threshold
    chosen = ranked.join(table, "n").filter("at >= lo and at < hi").select("root", "split")
    by_node = sizes.select("node", "root").join(chosen, "root").select("node", "split")
    return k.join(by_node, "node").select(F.col("__row").alias(row_id), "split")


def split_report(assigned: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """(split, target_share, n_records, actual_share); a split that got nothing is listed with 0."""
    spark = assigned.sparkSession
    want = spark.createDataFrame([(k, float(v)) for k, v in targets], "split string, target_share double")
    n = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_records"))
    total = assigned.agg(F.count(F.lit(1)).alias("__t"))
    j = want.join(n, "split", "left").crossJoin(F.broadcast(total))  # one row
    return j.select("split", "target_share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.round(F.coalesce(F.col("n_records") / F.col("__t"), F.lit(0.0)), 6).alias("actual_share"))
