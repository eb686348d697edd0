"""Approximate nearest neighbours: NN-descent builds neighbour graphs, greedy search over the graphs answers queries.

Equal vectors are one node, which knows its smallest ids; ids beyond the k + 1 smallest can't be among k results. Nodes
are dealt into shards by a hash, every node into one; a task holds a shard's graph and answers all queries over it, and
the answers of all shards are merged. A table of up to `SMALL` nodes is one shard.

A shard's first lists come from blocks of nodes that are next to each other by the signs of random projections. Then,
in rounds, every node brings neighbours and those that have it as neighbour together; pairs with a new one among them
are compared, and what is nearer than a node's farthest neighbour goes to that node. Rounds end when few lists change.
Products only rule pairs out, beyond their rounding error; what they leave is measured.

A query starts at its own node, at nodes with signs like its own, and at a few others. Each step expands the best of its
`width` best nodes that weren't expanded yet: their neighbours, in both directions, are scored. It goes on until none is
left. A shard measures recall on a sample of the queries, whose true neighbours come from comparing them with every
node; while it is below the goal, the width grows by a quarter, and once `WHOLE` times the width is the shard, all of it is scored.
Where there are several shards, recall of the merged answers is measured, too: below `GOAL` the shards' goal is raised.

Vectors without id, null, zero ones, and those with a null or non-finite component take no part. Vectors of different
length are never neighbours. Rows of one id are one candidate, with the nearest of its vectors; as a query the least
vector of an id counts. Fewer candidates than k give all; an empty table gives no rows.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessaline.llm.base import fmix, plain_unions, removed, table, written
from tessaline.llm.topk import usable

log = logging.getLogger(__name__)

#: Nodes up to which a table is one shard, shards up to which they hold no more, and nodes of a shard at most, about.
SMALL, SHARDS, LARGE = 1 << 16, 64, 1 << 17
#: Neighbours of a node; neighbours and reverse neighbours of a node that meet in a round, each; reverse edges of a node.
NEIGHBOURS, MEET, REVERSE = 48, 32, 32
#: Nodes of a block, sets of blocks, signs that order one, rounds at most, and changed share that ends them.
BLOCK, TREES, SIGNS, ROUNDS, CHANGED = 1024, 4, 30, 12, 0.02
#: Best nodes that a search keeps at first and expands in a step, nodes it starts at besides, a half of them by their
#: signs; the share of a shard, inverse, at which all is scored; the recall up to which the nodes it keeps grow, by a
#: quarter each time, and queries that measure it.
BEAM, EXPAND, STARTS, WHOLE, GOAL, PROBES = 8, 4, 64, 16, 0.915, 512
SEED = 5
#: Numbers that a step holds at once, about.
AT_ONCE = 1 << 21
#: Keys order nodes by distance: upper half of the squared distance, place, and a flag. A key of no node is the largest.
UPPER, NONE, ONE = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)


def _squares(x: np.ndarray, i: np.ndarray, z: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows i of x and j of z, pair by pair."""
    step = max(1, AT_ONCE // 8 // max(1, x.shape[1]))
    out = np.empty(len(i))
    with np.errstate(over="ignore"):
        for lo in range(0, len(i), step):
            diff = x.take(i[lo : lo + step], axis=0)
            diff -= z.take(j[lo : lo + step], axis=0)
            out[lo : lo + step] = np.einsum("ij,ij->i", diff, diff)
    return out


def _keys(d: np.ndarray, place: np.ndarray, flag: int) -> np.ndarray:
    return (d.view(np.uint64) & UPPER) | (place.astype(np.uint64) << ONE) | np.uint64(flag)


def _places(keys: np.ndarray) -> np.ndarray:
    return ((keys & ~UPPER) >> ONE).astype(np.int64)


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """The k least of each row; of keys that differ in their flag only, the one without."""
    keys = np.sort(keys, axis=1)
    same = (keys[:, 1:] >> ONE) == (keys[:, :-1] >> ONE)
    keys[:, 1:][same] = NONE
    keys.sort(axis=1)
    return keys[:, :k]


def _nth(groups: np.ndarray, n: int) -> np.ndarray:
    """The place of each element in its group; groups: sorted numbers below n."""
    return np.arange(len(groups)) - np.searchsorted(groups, np.arange(n))[groups]


def _centred(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """x and q about the median, in single precision, and the scale that was divided by: for signs and products."""
    mid = np.median(x, axis=0).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.abs(x[:: max(1, len(x) // 4096)] - mid).max(axis=1, initial=0)
        scale = float(np.median(far)) or 1.0
        return ((x - mid) / scale).astype(np.float32), ((q - mid) / scale).astype(np.float32), scale


def _signs(y: np.ndarray, tree: int) -> np.ndarray:
    """Signs of random projections as a number."""
    r = np.random.default_rng((SEED, tree, y.shape[1])).standard_normal((y.shape[1], SIGNS)).astype(np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        return ((y @ r) > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))


def _first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lists of keys from the nearest inside blocks, all new."""
    n, size = len(x), min(BLOCK, len(x))
    lists, k = np.full((n, NEIGHBOURS), NONE), min(NEIGHBOURS, size - 1)
    if not k:
        return lists
    for tree in range(TREES if n > size else 1):
        order = np.argsort(_signs(y, tree), kind="stable")
        begin = np.minimum(np.arange(0, n, size), n - size)  # the last block goes back into the one before
        step = max(1, AT_ONCE // (size * size))
        for lo in range(0, len(begin), step):
            at = order[begin[lo : lo + step, None] + np.arange(size)]
            v = y[at]
            with np.errstate(over="ignore", invalid="ignore"):
                sq = np.einsum("cmd,cmd->cm", v, v)
                d = sq[:, :, None] + sq[:, None] - 2 * np.matmul(v, v.transpose(0, 2, 1))
            d[:, np.arange(size), np.arange(size)] = np.nan  # sorts behind infinity
            near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
            a, b = np.repeat(at.ravel(), k), np.take_along_axis(np.broadcast_to(at[:, None], d.shape), near, 2).ravel()
            keys = _keys(_squares(x, a, x, b), b, 1)
            keys[a == b] = NONE
            own, one = np.unique(at.ravel(), return_index=True)
            lists[own] = _best(np.concatenate([lists[own], keys.reshape(-1, k)[one]], axis=1), NEIGHBOURS)
    return lists


def _meetings(lists: np.ndarray, nth_round: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that meet at each node (-1: none), and which of them are new. Marks those that a node brings as old."""
    n, there = len(lists), lists != NONE
    place, new = _places(lists), ((lists & ONE) == ONE) & there
    rank = np.argsort(np.where(there, np.where(new, 0, 1), 2), axis=1, kind="stable")[:, :MEET]
    bring = np.take_along_axis(there, rank, 1)
    ahead, ahead_new = np.where(bring, np.take_along_axis(place, rank, 1), -1), np.take_along_axis(new, rank, 1)
    src, col = np.nonzero(there)
    dst, fresh = place[src, col], new[src, col]
    by = np.random.default_rng((SEED, nth_round)).integers(0, 1 << 32, len(dst), dtype=np.uint64)
    order = np.argsort((dst.astype(np.uint64) << np.uint64(33)) | ((~fresh).astype(np.uint64) << np.uint64(32)) | by)
    dst, src, fresh = dst[order], src[order], fresh[order]
    nth = _nth(dst, n)
    some = nth < MEET
    back, back_new = np.full((n, MEET), -1, np.int64), np.zeros((n, MEET), bool)
    back[dst[some], nth[some]], back_new[dst[some], nth[some]] = src[some], fresh[some]
    np.put_along_axis(lists, rank, np.where(bring, np.take_along_axis(lists, rank, 1) & ~ONE, NONE), 1)
    return np.concatenate([ahead, back], axis=1), np.concatenate([ahead_new, back_new], axis=1)


def _nearer(x: np.ndarray, y: np.ndarray, scale: float, at: np.ndarray, new: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places a and b of those that meet, nearer than a's worst, and their squared distances."""
    v = y[at]
    with np.errstate(over="ignore", invalid="ignore"):
        # a product only rules pairs out, beyond its rounding error; what it leaves is measured
        sq = np.einsum("cmd,cmd->cm", v, v) * np.float32(1 - 4 * (y.shape[1] + 4) * np.finfo(np.float32).eps)
        d = np.matmul(v, v.transpose(0, 2, 1))
        d *= -2
        d += sq[:, :, None]
        d += sq[:, None]
        limit = np.where(at >= 0, np.nextafter((worst[at] / scale / scale).astype(np.float32), np.float32(np.inf)), np.float32(-np.inf))
        far = d >= limit[:, :, None]
        if not sq.max(initial=0) < 1e37:
            far &= np.isfinite(d)
    may = new[:, :, None] | new[:, None]
    may &= ~far
    m = at.shape[1]
    may[:, np.arange(m), np.arange(m)] = False
    pairs = np.flatnonzero(may)
    row = pairs // m
    a, b = at.ravel()[row], at.ravel()[row // m * m + (pairs - row * m)]
    real = (a >= 0) & (b >= 0) & (a != b)
    a, b = a[real], b[real]
    d = _squares(x, a, x, b)
    good = d < worst[a]
    return a[good], b[good], d[good]


def _merged(lists: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Brings pairs a, b and their squared distances into the lists of a."""
    n = len(lists)
    a, b, d = (np.concatenate(f) for f in zip(*found, strict=True))
    with np.errstate(over="ignore"):
        order = np.argsort((a.astype(np.uint64) << np.uint64(32)) | d.astype(np.float32).view(np.uint32))
    a, b, d = a[order], b[order], d[order]
    one = np.ones(len(a), bool)
    one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, d = a[one], b[one], d[one]
    nth = _nth(a, n)
    some = nth < NEIGHBOURS
    more = np.full((n, NEIGHBOURS), NONE)
    more[a[some], nth[some]] = _keys(d[some], b[some], 1)
    for lo in range(0, n, 1 << 14):
        rows = slice(lo, lo + (1 << 14))
        lists[rows] = _best(np.concatenate([lists[rows], more[rows]], axis=1), NEIGHBOURS)


def _descent(x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """Lists of keys, nearest first, that NN-descent finds for the rows of x."""
    n, lists = len(x), _first(x, y)
    for k in range(ROUNDS if n > BLOCK else 0):  # one block has all neighbours
        at, new = _meetings(lists, k)
        worst, found, held, step = None, [], 0, max(1, AT_ONCE // (32 * MEET * MEET))
        for lo in range(0, n, step):
            if worst is None:
                worst = np.where(lists[:, -1] != NONE, (lists[:, -1] & UPPER).view(np.float64), np.inf)
            live = lo + np.flatnonzero(new[lo : lo + step].any(axis=1))
            if len(live):
                found.append(_nearer(x, y, scale, at[live], new[live], worst))
                held += len(found[-1][0])
            if held > AT_ONCE or found and lo + step >= n:
                _merged(lists, found)
                worst, found, held = None, [], 0
        if (((lists & ONE) == ONE) & (lists != NONE)).sum() <= CHANGED * n * NEIGHBOURS:
            break
    return lists


def _edges(near: np.ndarray) -> np.ndarray:
    """Places next to each node in both directions; near: lists of places, -1 for none. A node itself fills the rest."""
    n, own = len(near), np.arange(len(near))[:, None]
    src, col = np.nonzero(near >= 0)
    dst = near[src, col]
    order = np.argsort((dst.astype(np.uint64) << np.uint64(32)) | col.astype(np.uint64), kind="stable")
    dst, src = dst[order], src[order]
    nth = _nth(dst, n)
    some = nth < REVERSE
    back = np.repeat(own, REVERSE, axis=1)
    back[dst[some], nth[some]] = src[some]
    return np.concatenate([np.where(near >= 0, near, own), back], axis=1).astype(np.int32)


class _Shard:
    """A shard's nodes and graph, and searches over it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, edges: np.ndarray):
        self.x, self.edges = x, edges
        self.some = np.sort(np.argsort(fmix(np.arange(len(x), dtype=np.uint64)))[: STARTS // 2])
        self.orders = []
        for tree in range(2):
            code = _signs(y, tree)
            order = np.argsort(code, kind="stable")
            self.orders.append((code[order], order))

    def starts(self, qy: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
        """Places that each query starts at. own: the place of its own node, -1 for none."""
        n = len(self.x)
        if WHOLE * width >= n:
            return np.broadcast_to(np.arange(n), (len(qy), n))
        found = [np.where(own >= 0, own, self.some[0])[:, None], np.broadcast_to(self.some, (len(qy), len(self.some)))]
        wide = max(STARTS // 4, width)  # as many as are kept, at least
        for tree, (code, order) in enumerate(self.orders):
            lo = np.clip(np.searchsorted(code, _signs(qy, tree)) - wide // 2, 0, max(0, n - wide))
            found.append(order[np.minimum(lo[:, None] + np.arange(wide), n - 1)])
        return np.concatenate(found, axis=1)

    def walk(self, q: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the width nearest nodes that each query finds, and how many it has scored."""
        n, m = len(self.x), len(q)
        seen, beam, visits = np.zeros(m * n, bool), np.full((m, width), NONE), np.zeros(m, np.int64)
        flat = (np.arange(m)[:, None] * n + starts).ravel()
        while True:
            flat = np.sort(flat[~seen[flat]])  # np.unique hashes, which takes much longer
            flat = flat[np.diff(flat, prepend=-1) > 0]
            seen[flat] = True
            who, at = np.divmod(flat, n)
            count = np.bincount(who, minlength=m)
            visits += count
            more = np.full((m, int(count.max(initial=0))), NONE)
            more[who, np.arange(len(who)) - (np.cumsum(count) - count)[who]] = _keys(_squares(self.x, at, q, who), at, 0)
            beam = np.sort(np.concatenate([beam, more], axis=1), axis=1)[:, :width]
            due = (beam & ONE) == 0
            who, col = np.nonzero(due & (np.cumsum(due, axis=1) <= EXPAND))
            if not len(who):
                return beam, visits
            at = _places(beam[who, col])
            beam[who, col] |= ONE
            flat = (who[:, None] * n + self.edges[at]).ravel()


def _nearest_places(x: np.ndarray, q: np.ndarray, at: np.ndarray, barred: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k nearest of the places at (-1: none), and those as near as the last, with distances in double."""
    out = []
    for row, (places, no) in enumerate(zip(at, barred, strict=True)):
        places = places[(places >= 0) & ~no]
        with np.errstate(over="ignore"):
            d = np.sqrt(((x[places].astype(np.float64) - q[row]) ** 2).sum(axis=1))
        order = np.lexsort((places, d))
        places, d = places[order], d[order]
        last = d[k - 1] if len(d) > k else np.inf
        out.append((places[d <= last], d[d <= last]))
    return out


def _true_places(x: np.ndarray, q: np.ndarray, sole: np.ndarray, who: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same from comparing with every place but those of the query's id alone."""
    mid = np.median(x, axis=0).astype(np.float64)
    out, step = [], max(1, 2 * AT_ONCE // max(1, len(x)))
    with np.errstate(over="ignore", invalid="ignore"):
        y = x - mid
        sq = (y * y).sum(axis=1)
        for lo in range(0, len(q), step):
            z = q[lo : lo + step] - mid
            both = (z * z).sum(axis=1)[:, None] + sq
            d = both - 2 * (z @ y.T)
            slack = 4 * (x.shape[1] + 4) * np.finfo(np.float64).eps * both
            no = sole[None] == who[lo : lo + step, None]
            high = np.where(no, np.inf, np.where(np.isfinite(d), d + slack, np.inf))
            bound = np.partition(high, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            for row in range(len(z)):
                places = np.flatnonzero(~no[row] & ~(d[row] - slack[row] > bound[row]))
                out += _nearest_places(x, q[lo + row : lo + row + 1], places[None], np.zeros((1, len(places)), bool), k)
    return out


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """node (smallest id), x and ids (the k + 1 smallest) of each different vector, as a written table."""
    rows = vectors.where(F.exists("x", lambda v: v != 0))
    nth = F.dense_rank().over(Window.partitionBy("x").orderBy("id"))
    some = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    found = some.groupBy("x").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    # an id with several vectors is several nodes: they get numbers of their own, the first one the id
    numbered = found.withColumn("rank", F.row_number().over(Window.partitionBy(F.element_at("ids", 1)).orderBy("x")))
    return written(numbered.select(F.when(F.col("rank") == 1, F.element_at("ids", 1)).otherwise(F.xxhash64("x")).alias("node"), "x", "ids"), "nodes")


def _sharded(nodes: DataFrame) -> DataFrame:
    """nodes with dim, m (shards of that dim) and shard."""
    rows = nodes.withColumn("dim", F.size("x"))
    c = F.col("c")
    shards = F.greatest(F.least(F.lit(SHARDS), F.ceil(c / SMALL)), F.ceil(c / LARGE)).cast("int").alias("m")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("c")).select("dim", shards)
    return rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))


def _component(nodes: DataFrame) -> str:
    """The type of the components as they move: single precision if that holds each of them exactly, far from its ends."""
    fits = lambda v: (v == v.cast("float").cast("double")) & ((v == 0) | F.abs(v).between(1e-12, 1e12))
    return "float" if nodes.agg(F.min(F.forall("x", fits))).first()[0] else "double"


def _rows(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """a, b and d (squared distance) of the neighbour lists that NN-descent finds in each shard, as a written table."""
    kind = _component(nodes)

    def run(t):
        import pyarrow as pa

        t = t.sort_by("node")
        ids, x = np.asarray(t["node"]), _rows(t["x"])
        y, _, scale = _centred(x, x[:0])
        lists = _descent(x, y, scale)
        a, col = np.nonzero(lists != NONE)
        b = _places(lists[a, col])
        return pa.table({"a": ids[a], "b": ids[b], "d": _squares(x, a, x, b)})

    found = _sharded(nodes).select("dim", "shard", "node", F.col("x").cast(f"array<{kind}>").alias("x"))
    return written(found.groupBy("dim", "shard").applyInArrow(run, "a bigint, b bigint, d double"), "graph")


def _answers(parts: DataFrame, k: int, most: int, beam: int, goal: float, probes: int) -> DataFrame:
    """id, node, d, sure (found by comparing with every node), visits and width, of each shard.

    parts: dim, m, shard, asked (a query and not a node), node (a query's own), id (of queries; the only one of nodes), x
    and near (nodes next to it; null: to be found).
    """

    def run(key, t):
        import pyarrow as pa

        m, names = key[2].as_py(), ["id", "node", "d", "sure", "visits", "width"]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()], strict=True)))
        t = t.sort_by([("asked", "ascending"), ("node", "ascending"), ("id", "ascending")])
        n = t.num_rows - int(np.asarray(t["asked"]).sum())
        ids, own, x = np.asarray(t["node"])[:n], np.asarray(t["node"])[n:], _rows(t["x"])
        x, q = x[:n], x[n:]
        if not n or not len(q):
            return schema.empty_table()
        # sole: which query's id a node has alone, -1 for none
        asked, alone = np.asarray(t["id"][n:]), t["id"][:n]
        nth_id, nth_query = np.unique(asked, return_inverse=True)
        sole = np.asarray(alone.fill_null(0))
        at = np.minimum(np.searchsorted(nth_id, sole), len(nth_id) - 1)
        sole = np.where(np.asarray(alone.is_valid()) & (nth_id[at] == sole), at, -1)
        y, qy, scale = _centred(x, q)
        near = t["near"][:n].combine_chunks()
        if near.null_count == n:
            lists = _descent(x, y, scale)
            near = np.where(lists != NONE, _places(lists), -1)
            del lists
        else:
            off, to = np.asarray(near.offsets), np.asarray(near.flatten())
            off = off - off[0]
            place = np.minimum(np.searchsorted(ids, to), n - 1)
            lists = np.full((n, int(np.diff(off).max(initial=1))), -1, np.int64)
            who = np.repeat(np.arange(n), np.diff(off))
            lists[who, np.arange(len(to)) - off[who]] = np.where(ids[place] == to, place, -1)
            near = lists
        shard = _Shard(x, y, _edges(near))
        del near, y, t
        at = np.minimum(np.searchsorted(ids, own), n - 1)
        own = np.where(ids[at] == own, at, -1)
        q64 = q.astype(np.float64)

        def found(rows, width):
            out, visits, step = [], [], max(1, (16 if width < n else 1) * AT_ONCE // n)
            for lo in range(0, len(rows), step):
                r = rows[lo : lo + step]
                keys, v = shard.walk(q[r], shard.starts(qy[r], own[r], width), width)
                place = np.where(keys != NONE, _places(keys), -1)
                out += _nearest_places(x, q64[r], place, sole[place] == nth_query[r][:, None], k)
                visits.append(v)
            return out, np.concatenate(visits)

        sample = np.sort(np.argsort(fmix(asked.astype(np.uint64)), kind="stable")[:probes])
        truth = _true_places(x, q64[sample], sole, nth_query[sample], k)
        # of many shards each has few of a query's nearest
        few = k if m == 1 else min(k, -(-k // m) + 1)
        width = max(beam, few + 1 + most)
        while WHOLE * width < n:
            got, _ = found(sample, width)
            hits = sum(len(np.intersect1d(a[:few], b)) for (a, _), (b, _) in zip(truth, got, strict=True))
            if hits >= goal * sum(len(a[:few]) for a, _ in truth):
                break
            width += -(-width // 4)
        width = width if WHOLE * width < n else n
        got, visits = found(np.arange(len(q)), width)
        out = []
        for rows, answers, sure in ((np.arange(len(q)), got, False), (sample, truth, True)):
            count = np.array([len(a) for a, _ in answers])
            first = np.zeros(count.sum(), np.int64)
            if not sure:
                first[(np.cumsum(count) - count)[count > 0]] = visits[count > 0]
            place, d = (np.concatenate([a[c] for a in answers]) for c in range(2))
            out.append(pa.table([np.repeat(asked[rows], count), ids[place], d, np.full(len(d), sure), first, np.full(len(d), width)], schema=schema))
        return pa.concat_tables(out)

    return parts.groupBy("dim", "shard", "m").applyInArrow(run, "id bigint, node bigint, d double, sure boolean, visits bigint, width bigint")


def search(nodes: DataFrame, graph: DataFrame | None, queries: DataFrame, k: int, beam: int = BEAM, goal: float = GOAL, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score. queries: id, node and x. graph: a, b and d, or None for that of NN-descent."""
    kind = _component(nodes)
    x = F.col("x").cast(f"array<{kind}>").alias("x")
    placed = _sharded(nodes)
    if graph is None:
        placed = placed.withColumn("near", F.lit(None).cast("array<bigint>"))
    else:
        lists = graph.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "b"))), lambda e: e["b"]).alias("near"))
        placed = placed.join(lists.withColumnRenamed("a", "node"), "node", "left")
    asked = written(queries.select("id", "node", "x", F.size("x").alias("dim")), "asked")
    # an id's own vectors may be nearer to it than any other, so a search keeps as many more
    alone = nodes.where(F.size("ids") == 1).select(F.element_at("ids", 1).alias("id"))
    most = alone.join(asked.select("id"), "id").groupBy("id").count().agg(F.max("count")).first()[0] or 0
    counts = placed.select("dim", "m").distinct()
    there = asked.join(counts, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    keys = ["dim", "m", "shard"]
    parts = placed.select(*keys, F.lit(False).alias("asked"), "node", F.when(F.size("ids") == 1, F.element_at("ids", 1)).alias("id"), x, "near").unionByName(there.select(*keys, F.lit(True).alias("asked"), "node", "id", x, F.lit(None).cast("array<bigint>").alias("near")))
    wanted, nearest_of = goal, Window.partitionBy("id", "sure").orderBy("d")
    while True:
        found = written(_answers(parts, k, most, beam, goal, probes), "found")
        best = found.withColumn("nth", F.rank().over(nearest_of)).where(F.col("nth") <= k).select("id", "node", "d", "sure")
        said = found.agg(F.max("width"), F.countDistinct("id"), F.sum("visits")).first()
        both = best.groupBy("id", "node").agg(F.max("sure").alias("sure"), F.max(~F.col("sure")).alias("got"))
        due, hits = both.where("sure").agg(F.count(F.lit(1)), F.count(F.when(F.col("got"), 1))).first()
        recall = hits / due if due else 1.0
        log.info("width %d, goal of a shard %.4f: recall %.4f of %d true neighbours; %d queries, nodes visited %d", said[0] or 0, goal, recall, due, said[1], said[2] or 0)
        if recall >= wanted or goal > 1:
            break
        goal = 1 - (1 - goal) / 2 if goal < 0.99 else 2.0  # no recall reaches 2: all is scored
        removed(found)
    near = best.where(~F.col("sure")).select("id", "node", "d")
    full = near.join(nodes.select("node", "ids"), "node").select("id", "d", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("id"))
    full = full.groupBy("id", "vec_id").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "vec_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (distance). is_query: a condition on `id`."""
    plain_unions(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    nodes = nodes_of(rows, k)
    asked = rows.where(is_query).where(F.exists("x", lambda v: v != 0)).groupBy("id").agg(F.min("x").alias("x"))
    return search(nodes, None, asked.join(nodes.select("x", "node"), "x"), k)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)
