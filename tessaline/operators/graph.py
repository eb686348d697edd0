"""Graphs as edge relations (src, dst): subgraphs, levels, components, orderings, elimination trees."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaline.sources.folders import shared_folder


def edges(a: DataFrame) -> DataFrame:
    """The graph of a matrix pattern: both directions, no loops."""
    e = a.where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(e: DataFrame) -> DataFrame:
    return e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def two_hop(e: DataFrame) -> DataFrame:
    """Pairs joined by a path of one or two edges, no loops."""
    second = e.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    return e.join(second, "dst").select("src", F.col("end").alias("dst")).where("src <> dst").unionByName(e.select("src", "dst")).distinct()


def subgraph(e: DataFrame, nodes: DataFrame, hops: int = 1) -> DataFrame:
    """Edges between nodes (id); with 2 hops also pairs of them with a common neighbour anywhere."""
    inside = lambda g: g.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    if hops == 1:
        return inside(e).distinct()
    mine = e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    back = e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    second = mine.join(back, "dst").select("src", F.col("end").alias("dst")).where("src <> dst")
    return inside(e).unionByName(second).distinct()


def bipartite(e: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(right.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def neighbours_inside(e: DataFrame, lo: int, hi: int) -> DataFrame:
    """For each node outside [lo, hi) its neighbours inside."""
    return e.where(F.col("src").between(lo, hi - 1) & ~F.col("dst").between(lo, hi - 1)).groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("inside"))


def admissible(e: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs of tiles (tile, lo, hi) that no path of up to two edges joins; never a tile with itself.

    Nodes get their tile first, by an equi-join on the numbers a tile holds, so paths are made between nodes and then
    counted between tiles. The pairs themselves are the result; each tile opens its own partners.
    """
    of = tiles.select("tile", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("node"))
    near = two_hop(e).join(of.select(F.col("node").alias("src"), F.col("tile").alias("ti")), "src").join(of.select(F.col("node").alias("dst"), F.col("tile").alias("tj")), "dst").select("ti", "tj").distinct()
    every = tiles.agg(F.collect_set("tile").alias("tiles")).first()["tiles"]
    pairs = tiles.select(F.col("tile").alias("ti"), F.explode(F.array(*[F.lit(t) for t in sorted(every)])).alias("tj")) if every else tiles.select(F.col("tile").alias("ti"), F.col("tile").alias("tj"))
    return pairs.where("ti <> tj").join(near, ["ti", "tj"], "left_anti")


def levels(e: DataFrame, root: int, most: int | None = None) -> DataFrame:
    """node and level of all nodes that the root reaches, a join per level; or of the first `most` levels, if asked for."""
    spark = e.sparkSession
    e = e.persist()
    front = spark.createDataFrame([(root, 0)], "node long, level long")
    seen, level = front, 0
    while most is None or level < most:
        level += 1
        front = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level).cast("long"))
        front = _cut(front)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        if level % 50 == 0:
            seen = _cut(seen)
    e.unpersist()
    return seen


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def _dropped(df: DataFrame) -> None:
    """Removes what `_cut` wrote, where no later step reads it."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _connected(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest number that each of n numbers is joined to by pairs (k x 2)."""
    label = np.arange(n)
    while len(pairs):
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
    while (label[label] != label).any():
        label = label[label]
    return label


def components(e: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and label (the smallest node it reaches); nodes without edges are their own component."""
    ids = e.select(F.col("src").alias("node")).distinct()
    if nodes is not None:
        ids = ids.unionByName(nodes.select(F.col("id").alias("node"))).distinct()
    spark = e.sparkSession
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    labels = ids.select("node", F.col("node").alias("label"))
    e = e.persist()
    while True:
        near = e.join(labels, e["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["src"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = low.select(F.col("node").alias("at"), F.col("low").alias("jump"))
        after = _cut(low.join(jump, low["low"] == jump["at"], "left").select("node", F.least("low", "jump").alias("new"), "label"))
        if not after.where("new < label").limit(1).count():
            return after.select("node", F.col("new").alias("label"))
        labels = after.select("node", F.col("new").alias("label"))


def middle_separator(e: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes of the middle level that have a neighbour in the next one; of fewer than three levels all nodes."""
    depth = found.agg(F.max("level")).first()[0] + 1
    if depth < 3:
        return found.select("node")
    mid = (depth + 2) // 2 - 1
    after = found.where(F.col("level") == mid + 1).select(F.col("node").alias("dst"))
    with_next = e.join(after, "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return found.where(F.col("level") == mid).select("node").join(with_next, "node", "left_semi")


def tree_levels(spark: SparkSession, tree: str) -> DataFrame:
    """node and level of a tree table (node, parent; root parent null), by a recursive query."""
    return spark.sql(f"WITH RECURSIVE t(node, level) AS (SELECT node, 0 FROM {tree} WHERE parent IS NULL UNION ALL SELECT c.node, t.level + 1 FROM {tree} c JOIN t ON c.parent = t.node) SELECT * FROM t")


# Orderings of one graph that the driver holds: adjacency as sorted lists. They are sequential by nature.


class Adjacency:
    """Neighbours of nodes 0 .. n - 1, gathered from an edge relation of bounded size."""

    MOST = 5_000_000

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.n = n
        self.near: list[list[int]] = [[] for _ in range(n)]
        for s, d in sorted(zip(src.tolist(), dst.tolist(), strict=True)):
            if s != d:
                self.near[s].append(d)

    @classmethod
    def of(cls, e: DataFrame, n: int) -> Adjacency:
        count = e.count()
        if count > cls.MOST:
            raise ValueError(f"{count} edges: order with geometric_nd or levels instead")
        rows = e.select("src", "dst").toPandas()
        return cls(n, rows["src"].to_numpy(), rows["dst"].to_numpy())

    def level_structure(self, root: int, mask: set[int] | None = None) -> list[list[int]]:
        seen, out, front = {root}, [], [root]
        while front:
            out.append(front)
            after = []
            for u in front:
                for v in self.near[u]:
                    if v not in seen and (mask is None or v in mask):
                        seen.add(v)
                        after.append(v)
            front = after
        return out

    def far_root(self, start: int, mask: set[int] | None = None) -> list[list[int]]:
        """Levels from a node that is far from another one: repeated from a least connected node of the last level."""
        found = self.level_structure(start, mask)
        while True:
            best = min(found[-1], key=lambda u: (len(self.near[u]), u))
            other = self.level_structure(best, mask)
            if len(other) <= len(found):
                return found
            found = other


def rcm(g: Adjacency) -> list[int]:
    """Reverse Cuthill-McKee: nodes in their new order."""
    order, seen = [], set()
    for s in range(g.n):
        if s in seen:
            continue
        root = g.far_root(s)[0][0]
        seen.add(root)
        queue = [root]
        for u in queue:
            new = sorted((v for v in g.near[u] if v not in seen), key=lambda v: (len(g.near[v]), v))
            seen.update(new)
            queue += new
        order += queue
    return order[::-1]


def minimum_degree(g: Adjacency, multiple: bool = False) -> list[int]:
    """Nodes by least degree in the elimination graph; `multiple` takes independent nodes of one degree together."""
    near = [set(x) for x in g.near]
    heap = [(len(near[u]), u) for u in range(g.n)]
    heapq.heapify(heap)
    done, order = [False] * g.n, []
    while heap:
        d, u = heapq.heappop(heap)
        if done[u] or d != len(near[u]):
            continue
        batch = [u]
        if multiple:
            blocked, rest = near[u] | {u}, []
            while heap and heap[0][0] == d:
                _, v = heapq.heappop(heap)
                if done[v] or len(near[v]) != d:
                    continue
                if v in blocked:
                    rest.append((d, v))
                else:
                    batch.append(v)
                    blocked |= near[v] | {v}
            for x in rest:
                heapq.heappush(heap, x)
        for w in batch:
            done[w] = True
            order.append(w)
            around = near[w]
            for v in around:
                near[v] |= around
                near[v] -= {v, w}
            for v in around:
                heapq.heappush(heap, (len(near[v]), v))
            near[w] = set()
    return order


def bisection_nd(g: Adjacency, leaf: int = 8) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Nested dissection by middle levels: order, and the separators (begin, end, parent; children first)."""
    order: list[int] = []
    seps: list[list[int]] = []

    def visit(nodes: list[int]) -> int | None:
        if not nodes:
            return None
        mask = set(nodes)
        found = g.far_root(min(nodes), mask)
        reached = {u for lv in found for u in lv}
        if len(reached) < len(nodes):  # several components: an empty separator joins them
            kids = [visit(sorted(reached)), visit(sorted(mask - reached))]
            sep: list[int] = []
        elif len(nodes) <= leaf or len(found) < 3:
            kids, sep = [], sorted(nodes)
        else:
            mid = (len(found) + 2) // 2 - 1
            after = set(found[mid + 1]) if mid + 1 < len(found) else set()
            sep = sorted(u for u in found[mid] if after & set(g.near[u])) or sorted(found[mid])
            low = {u for lv in found[:mid] for u in lv} | (set(found[mid]) - set(sep))
            kids = [visit(sorted(low)), visit(sorted(mask - low - set(sep)))]
        begin = len(order)
        order.extend(sep)
        me = len(seps)
        seps.append([begin, len(order), -1])
        for k in kids:
            if k is not None:
                seps[k][2] = me
        return me

    visit(list(range(g.n)))
    return order, [tuple(s) for s in seps]


def k_way(g: Adjacency, k: int) -> tuple[list[int], list[int]]:
    """Nodes ordered by part, and the parts' sizes: halves of level structures from far roots, again and again."""

    def cut(nodes: list[int], parts: int) -> list[list[int]]:
        if parts == 1 or len(nodes) < 2:
            return [sorted(nodes)]
        mask, line = set(nodes), []
        while mask:
            found = [u for level in g.far_root(min(mask), mask) for u in level]
            line += found
            mask -= set(found)
        at = len(nodes) * (parts // 2) // parts
        return cut(line[:at], parts // 2) + cut(line[at:], parts - parts // 2)

    found = cut(list(range(g.n)), k)
    return [u for part in found for u in part], [len(part) for part in found]


def subtree(seps: list[tuple[int, int, int]], root: int) -> list[tuple[int, int, int]]:
    """The separators below a root, numbered from 0, children first."""
    keep, inside = [], {root}
    for k in range(len(seps) - 1, -1, -1):
        if k == root or seps[k][2] in inside:
            inside.add(k)
            keep.append(k)
    place = {k: n for n, k in enumerate(reversed(keep))}
    return [(seps[k][0], seps[k][1], place.get(seps[k][2], -1) if k != root else -1) for k in reversed(keep)]


def top_tree(seps: list[tuple[int, int, int]], leaves: int) -> list[int]:
    """Separators of the top part: the largest subtree among the leaves is opened until there are so many leaves."""
    size = [e - b for b, e, _ in seps]
    kids: list[list[int]] = [[] for _ in seps]
    for k, (_, _, parent) in enumerate(seps):
        if parent >= 0:
            size[parent] += size[k]
            kids[parent].append(k)
    edge, inside = [k for k, s in enumerate(seps) if s[2] < 0], []
    while len(edge) < leaves and any(kids[k] for k in edge):
        k = max((k for k in edge if kids[k]), key=lambda k: (size[k], k))
        edge.remove(k)
        inside.append(k)
        edge += kids[k]
    return sorted(inside + edge)


def geometric_nd(sides: tuple[int, int, int], leaf: int = 8, width: int = 1) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Nested dissection of a regular grid: the longest side is cut by `width` planes; order and separators."""
    order, seps = geometric_order(sides, leaf, width)
    return order.tolist(), seps


def geometric_order(sides: tuple[int, int, int], leaf: int = 8, width: int = 1) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The same, with the order as an array: no Python object for each point."""
    nx, ny, _ = sides
    order: list[np.ndarray] = []
    seps: list[list[int]] = []
    size = 0

    def number(lo, n) -> np.ndarray:
        z, y, x = (np.arange(lo[k], lo[k] + n[k]) for k in (2, 1, 0))
        return (x + nx * (y[:, None] + ny * z[:, None, None])).ravel()

    def visit(lo, n) -> int:
        axis = max(range(3), key=lambda k: (n[k], -k))
        kids: list[int] = []
        if n[axis] < 2 + width or n[0] * n[1] * n[2] <= leaf:
            sep = number(lo, n)
        else:
            half = -(-n[axis] // 2) if lo[axis] < sides[axis] / 2 else n[axis] // 2
            first = half - width // 2 - (1 if half - width // 2 + width >= n[axis] else 0)
            part = lambda at, size: ([a + (at if k == axis else 0) for k, a in enumerate(lo)], [size if k == axis else s for k, s in enumerate(n)])
            kids = [visit(*part(0, first)), visit(*part(first + width, n[axis] - first - width))]
            sep = number(*part(first, width))
        nonlocal size
        order.append(sep)
        seps.append([size, size + len(sep), -1])
        size += len(sep)
        for k in kids:
            seps[k][2] = len(seps) - 1
        return len(seps) - 1

    visit([0, 0, 0], list(sides))
    return np.concatenate(order), [tuple(s) for s in seps]


def elimination_tree(g: Adjacency, order: list[int] | None = None) -> list[int]:
    """Parent of each position in the symmetric elimination tree (-1: root)."""
    order = order or list(range(g.n))
    place = {u: k for k, u in enumerate(order)}
    parent, top = [-1] * g.n, [-1] * g.n
    for k, u in enumerate(order):
        for v in g.near[u]:
            r = place[v]
            while r != -1 and r < k:
                after = top[r]
                top[r] = k
                if after == -1:
                    parent[r] = k
                r = after
    return parent


def postorder(parent: list[int]) -> list[int]:
    kids: list[list[int]] = [[] for _ in parent]
    roots = []
    for k, p in enumerate(parent):
        (roots if p < 0 else kids[p]).append(k)
    out: list[int] = []
    for root in roots:
        stack = [(root, iter(kids[root]))]
        while stack:
            u, it = stack[-1]
            v = next(it, None)
            if v is None:
                out.append(u)
                stack.pop()
            else:
                stack.append((v, iter(kids[v])))
    return out


def greedy_matching(a: DataFrame, n: int) -> DataFrame:
    """i and j of a heavy matching: in rounds every row takes its largest free column, every column its largest suitor."""
    free, pairs = a.where("v <> 0").select("i", "j", F.abs("v").alias("w")).persist(), None
    for _ in range(n):
        rows = free.groupBy("i").agg(F.max_by("j", F.struct("w", -F.col("j"))).alias("j"), F.max("w").alias("w"))
        won = _cut(rows.groupBy("j").agg(F.max_by("i", F.struct("w", -F.col("i"))).alias("i"), F.max("w").alias("w")).select("i", "j", "w"))
        if not won.limit(1).count():
            break
        pairs = won if pairs is None else pairs.unionByName(won)
        free = _cut(free.join(won.select("i"), "i", "left_anti").join(won.select("j"), "j", "left_anti"))
    return pairs


def product_matching(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each row that maximises the product of |v|, and scales of rows and columns under which matched entries
    are 1 and others at most 1. A dense matrix on the driver, by shortest augmenting paths."""
    n = len(v)
    with np.errstate(divide="ignore"):
        cost = np.where(v != 0, np.log(np.abs(v).max(axis=1, keepdims=True)) - np.log(np.abs(v)), np.inf)
    u, w, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        row_of[n], j0 = i, n
        least, before, used = np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, bool)
        while row_of[j0] != -1:
            used[j0] = True
            r = row_of[j0]
            slack = cost[r] - u[r] - w[:n]
            better = ~used[:n] & (slack < least)
            least[better], before[better] = slack[better], j0
            open_ = np.where(used[:n], np.inf, least)
            j1 = int(open_.argmin())
            delta = open_[j1]
            if not np.isfinite(delta):
                raise ValueError("the matrix is structurally singular")
            at = np.flatnonzero(used)
            u[row_of[at]] += delta
            w[at] -= delta
            least[~used[:n]] -= delta
            j0 = j1
        while j0 != n:
            j1 = before[j0]
            row_of[j0] = row_of[j1]
            j0 = j1
    col = np.empty(n, np.int64)
    col[row_of[:n]] = np.arange(n)
    return col, np.exp(u[:n]) / np.abs(v).max(axis=1), np.exp(w[:n])
