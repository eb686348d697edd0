"""Dense kernels in numpy: what runs inside a task on one block, and their grouped forms over tiles.

A tile is a row (ti, tj, m, n, data) with data column by column.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a matrix that a step of pivoted QR works on at a time.
_PART = 1 << 18
SAFE_MIN = np.finfo(float).tiny


def lu(a: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Factors in one matrix and the row order, pivots of largest size; pivots below `least` become sign * least."""
    a, order = np.array(a, dtype=np.result_type(a, np.float64)), np.arange(len(a))
    for k in range(min(a.shape)):
        p = k + int(np.abs(a[k:, k]).argmax())
        if p != k:
            a[[k, p]], order[[k, p]] = a[[p, k]], order[[p, k]]
        if least and abs(a[k, k]) < least:
            a[k, k] = least if a[k, k].real >= 0 else -least
        if a[k, k] == 0:
            raise ZeroDivisionError(f"pivot {k} is zero")
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def lu_solve(f: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    a, order = f
    return solve_upper(a, solve_lower(a, b[order], unit=True))


def solve_lower(a: np.ndarray, b: np.ndarray, unit: bool = False) -> np.ndarray:
    x = np.array(b, dtype=np.result_type(a, b, np.float64))
    for k in range(len(a)):
        x[k] = x[k] - a[k, :k] @ x[:k]
        if not unit:
            x[k] = x[k] / a[k, k]
    return x


def solve_upper(a: np.ndarray, b: np.ndarray, unit: bool = False) -> np.ndarray:
    x = np.array(b, dtype=np.result_type(a, b, np.float64))
    for k in range(len(a) - 1, -1, -1):
        x[k] = x[k] - a[k, k + 1 :] @ x[k + 1 :]
        if not unit:
            x[k] = x[k] / a[k, k]
    return x


def ldlt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L, block diagonal D and order with A[order][:, order] = L D L^T; pivots of one or two rows, by size."""
    a = np.array(a, dtype=float)
    n, order = len(a), np.arange(len(a))
    l, d = np.eye(n), np.zeros((n, n))
    bound, k = (1 + 17**0.5) / 8, 0

    def swap(p: int, q: int) -> None:
        a[[p, q]] = a[[q, p]]
        a[:, [p, q]] = a[:, [q, p]]
        l[[p, q], :k] = l[[q, p], :k]
        order[[p, q]] = order[[q, p]]

    while k < n:
        two = False
        if k + 1 < n:
            r = k + 1 + int(np.abs(a[k + 1 :, k]).argmax())
            big = abs(a[r, k])
            if big > 0 and abs(a[k, k]) < bound * big:
                others = np.abs(a[r, k:]).copy()
                others[r - k] = 0
                far = others.max()
                if abs(a[k, k]) * far < bound * big**2:
                    two = abs(a[r, r]) < bound * far
                    swap(k + two, r)
        w = 1 + two
        pivot = a[k : k + w, k : k + w].copy()
        d[k : k + w, k : k + w] = pivot
        if k + w < n and np.abs(pivot).max() > 0:
            l[k + w :, k : k + w] = np.linalg.solve(pivot.T, a[k + w :, k : k + w].T).T
            a[k + w :, k + w :] -= l[k + w :, k : k + w] @ a[k : k + w, k + w :]
        k += w
    return l, d, order


def ldlt_solve(f: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    l, d, order = f
    x = np.empty_like(np.asarray(b, dtype=float))
    x[order] = solve_upper(l.T, np.linalg.solve(d, solve_lower(l, b[order], unit=True)), unit=True)
    return x


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of negative, zero and positive eigenvalues of a symmetric matrix, from its LDL^T factors."""
    e = np.linalg.eigvalsh(ldlt(a)[1])
    small = np.finfo(float).eps * len(a) * (np.abs(e).max() if len(e) else 0)
    return int((e < -small).sum()), int((np.abs(e) <= small).sum()), int((e > small).sum())


def lq(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(a.conj().T)
    return r.conj().T, q.conj().T


def orthogonalized(a: np.ndarray) -> tuple[np.ndarray, float, float]:
    q, r = np.linalg.qr(a)
    d = np.abs(np.diag(r))
    return q, float(d.max(initial=0)), float(d.min(initial=np.inf))


def pivoted_qr(a: np.ndarray, rtol: float = 1e-4, atol: float = 1e-10, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Q, R, column order and rank: columns of largest remainder first, until one is small against the first or at all."""
    r, order, vectors = _reflected(a, rtol, atol, most)
    q = np.eye(len(r), dtype=r.dtype)
    for k, x in enumerate(vectors):
        q[:, k:] -= 2 * np.outer(q[:, k:] @ x, x.conj())
    return q, r, order, len(vectors)


def _reflected(a: np.ndarray, rtol: float, atol: float, most: int | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """R, column order, and a vector for each reflection, of pivoted QR; in place of r's columns, few rows at a time."""
    r = np.array(a, dtype=np.result_type(a, np.float64))
    m, n = r.shape
    order, vectors = np.arange(n), []
    steps = min(m, n) if most is None else min(m, n, most)
    part, first = max(1, _PART // max(1, n)), None
    for k in range(steps):
        p = k + int(sum((np.abs(r[b : b + part, k:]) ** 2).sum(axis=0) for b in range(k, m, part)).argmax())
        r[:, [k, p]], order[[k, p]] = r[:, [p, k]], order[[p, k]]
        x = r[k:, k].copy()
        size = np.linalg.norm(x)
        first = size if first is None else first
        if size <= atol or size <= rtol * first:
            break
        x[0] += (x[0] / abs(x[0]) if x[0] != 0 else 1) * size
        x /= np.linalg.norm(x)
        y = x.conj() @ r[k:, k:]
        for b in range(k, m, part):
            r[b : b + part, k:] -= 2 * np.outer(x[b - k : b - k + part], y)
        vectors.append(x)
    return r, order, vectors


def low_rank(a: np.ndarray, rtol: float = 1e-4, atol: float = 1e-10, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """U and V with A ~ U V; of Q only the columns of U are made."""
    r, order, vectors = _reflected(a, rtol, atol, most)
    rank = len(vectors)
    v, u = np.zeros((rank, a.shape[1]), r.dtype), np.eye(len(r), rank, dtype=r.dtype)
    v[:, order] = np.triu(r[:rank])
    for k in range(rank - 1, -1, -1):
        u[k:, k:] -= 2 * np.outer(vectors[k], vectors[k].conj() @ u[k:, k:])
    return u, v


def column_id(a: np.ndarray, rtol: float = 1e-4, atol: float = 1e-10, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X and the chosen columns J with A ~ A[:, J] X."""
    r, order, vectors = _reflected(a, rtol, atol, most)
    rank = len(vectors)
    x = np.zeros((rank, a.shape[1]), r.dtype)
    x[:, order[:rank]] = np.eye(rank)
    if rank < a.shape[1]:
        x[:, order[rank:]] = solve_upper(r[:rank, :rank], r[:rank, rank:]) if rank else 0
    return x, order[:rank]


def row_id(a: np.ndarray, rtol: float = 1e-4, atol: float = 1e-10, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X and the chosen rows J with A ~ X A[J]."""
    x, rows = column_id(a.conj().T, rtol, atol, most)
    return x.conj().T, rows


def aca(m: int, n: int, row, col, rtol: float = 1e-4, atol: float = 1e-10, most: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """U and V with A ~ U V from single rows and columns: row(i) and col(j) give them."""
    us, vs, size = [], [], 0.0
    free_r, free_c = np.ones(m, bool), np.ones(n, bool)
    i = int(np.random.default_rng(seed).integers(m)) if m else 0
    for _ in range(min(m, n) if most is None else min(m, n, most)):
        v = np.asarray(row(i), dtype=float) - sum((u[i] * w for u, w in zip(us, vs, strict=True)), np.zeros(n))
        free_r[i] = False
        j = int(np.where(free_c, np.abs(v), -1).argmax())
        if abs(v[j]) < SAFE_MIN:
            rest = np.flatnonzero(free_r)
            if not len(rest):
                break
            i = int(rest[0])
            continue
        v = v / v[j]
        u = np.asarray(col(j), dtype=float) - sum((w[j] * s for s, w in zip(us, vs, strict=True)), np.zeros(m))
        free_c[j] = False
        nu, nv = np.linalg.norm(u), np.linalg.norm(v)
        size = np.sqrt(size**2 + 2 * sum((u @ s) * (v @ w) for s, w in zip(us, vs, strict=True)) + (nu * nv) ** 2)
        us.append(u)
        vs.append(v)
        if nu * nv < rtol * size or nu * nv < atol or not free_r.any():
            break
        i = int(np.where(free_r, np.abs(u), -1).argmax())
    return (np.array(us).T if us else np.zeros((m, 0))), (np.array(vs) if vs else np.zeros((0, n)))


def blocked_aca(m: int, n: int, row, col, width: int = 8, rtol: float = 1e-4, atol: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """ACA with `width` rows and columns a step: columns are picked by pivoted QR of the rows' remainder, rows by that of
    the columns'. A row or column is never picked twice."""
    u, v = np.zeros((m, 0)), np.zeros((0, n))
    used: set[int] = set()
    rows = np.random.default_rng(seed).permutation(m)[:width]
    while len(rows) and u.shape[1] < min(m, n):
        r = np.array([row(int(i)) for i in rows], dtype=float) - u[rows] @ v
        _, _, order, rank = pivoted_qr(r, rtol, atol)
        if rank == 0:
            break
        cols = order[:rank]
        c = np.array([col(int(j)) for j in cols], dtype=float).T - u @ v[:, cols]
        part, others = low_rank(np.linalg.pinv(c[rows]) @ r, 1e-14, 0.0)
        u, v = np.hstack([u, c @ part]), np.vstack([v, others])
        used |= set(rows.tolist())
        step = np.linalg.norm(c @ part) * np.linalg.norm(others)
        if step < rtol * np.linalg.norm(u) * np.linalg.norm(v) * 1e-2 or step < atol:
            break
        free = np.array([i for i in range(m) if i not in used], dtype=int)
        if not len(free):
            break
        best = pivoted_qr(c[free].T, 0.0, 0.0)[2][: min(width, len(free))]
        rows = free[best]
    return u, v


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower L with A = L L^T; a matrix that isn't positive definite raises ZeroDivisionError."""
    try:
        return np.linalg.cholesky(np.asarray(a, dtype=float))
    except np.linalg.LinAlgError as e:
        raise ZeroDivisionError("the matrix isn't positive definite") from e


def cholesky_solve(l: np.ndarray, b: np.ndarray) -> np.ndarray:
    return solve_upper(l.T, solve_lower(l, b))


def singular_values(a: np.ndarray) -> np.ndarray:
    """From large to small; of a tall matrix by way of its triangular factor."""
    a = np.asarray(a)
    if a.shape[0] > a.shape[1]:
        a = np.linalg.qr(a, mode="r")
    return np.linalg.svd(a, compute_uv=False)


def symmetric_eigen(a: np.ndarray, vectors: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Eigenvalues from small to large, and their vectors as columns, from the lower triangle."""
    a = np.asarray(a)
    return tuple(np.linalg.eigh(a)) if vectors else (np.linalg.eigvalsh(a), None)


def triangular_product(t: np.ndarray, b: np.ndarray, side: str = "left", upper: bool = False, transposed: bool = False, unit: bool = False, alpha: float = 1.0) -> np.ndarray:
    """alpha T B or alpha B T, with T or its transpose; only the named triangle of t is looked at."""
    t = np.triu(t, 1 if unit else 0) if upper else np.tril(t, -1 if unit else 0)
    t = t + np.eye(len(t)) if unit else t
    t = t.T if transposed else t
    return alpha * (t @ b if side == "left" else b @ t)


def triangular_solve(t: np.ndarray, b: np.ndarray, side: str = "left", upper: bool = False, transposed: bool = False, unit: bool = False, alpha: float = 1.0) -> np.ndarray:
    """X of T X = alpha B or X T = alpha B, with T or its transpose."""
    if side == "right":
        return triangular_solve(t, np.asarray(b).T, "left", upper, not transposed, unit, alpha).T
    t, upper = (t.T, not upper) if transposed else (t, upper)
    return (solve_upper if upper else solve_lower)(t, alpha * np.asarray(b, dtype=float), unit)


def low_rank_step(c: np.ndarray, w: np.ndarray, r: np.ndarray, rtol: float = 1e-4, atol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, int]:
    """A step of blocked cross approximation: from columns C, rows R and where they cross, W, the factors U = C W^+ cut to
    the numerical rank of W, and V = R; and that rank. U V is C W^+ R."""
    q, t, order, rank = pivoted_qr(w, rtol, atol)
    back = np.zeros((w.shape[1], rank))
    if rank:
        x, keep = column_id(w, rtol, atol)
        core = w[:, keep]
        back[keep] = np.eye(rank)
        return c @ back, np.linalg.lstsq(core, r, rcond=None)[0], rank
    return np.zeros((len(c), 0)), np.zeros((0, r.shape[1])), 0


def appended_norm(u: np.ndarray, v: np.ndarray, size: float, c: np.ndarray, r: np.ndarray) -> tuple[float, float]:
    """Frobenius norms of U V + C R, of which U V has norm `size`, and of C R: from triangular factors, without products of
    full length."""
    tri = lambda m: np.linalg.qr(m, mode="r") if m.size else np.zeros((m.shape[1],) * 2)
    new = float(np.linalg.norm(tri(c) @ tri(r.T).T))
    cross = float(((u.T @ c) * (v @ r.T)).sum()) if u.size and c.size else 0.0
    return math.sqrt(max(size * size + 2 * cross + new * new, 0.0)), new


# many blocks


def on_blocks(rows: DataFrame, f) -> DataFrame:
    """g, name, i, j, v of what f makes of each group's blocks; rows: g, name, i, j, v, a group being one task's.

    f takes the blocks of a group by name, as arrays that start at 0, and gives arrays by name; a vector is one column.
    """

    def run(t):
        import pyarrow as pa

        names, i, j, v = np.asarray(t["name"]), np.asarray(t["i"]), np.asarray(t["j"]), np.asarray(t["v"])
        blocks = {}
        for name in np.unique(names):
            at = names == name
            block = np.zeros((i[at].max() + 1, j[at].max() + 1))
            np.add.at(block, (i[at], j[at]), v[at])
            blocks[str(name)] = block
        out = []
        for name, m in f(blocks).items():
            m = np.asarray(m, dtype=float)
            m = m.reshape(len(m), -1) if m.ndim else m.reshape(1, 1)
            r, c = (x.ravel() for x in np.indices(m.shape))
            out.append(pa.table({"g": pa.array(np.full(m.size, t["g"][0].as_py()), pa.int64()), "name": pa.array([name] * m.size, pa.string()), "i": pa.array(r), "j": pa.array(c), "v": pa.array(m.ravel())}))
        return pa.concat_tables(out)

    return rows.select("g", "name", "i", "j", "v").groupBy("g").applyInArrow(run, "g bigint, name string, i bigint, j bigint, v double")


# tiles


def tiles(a: DataFrame, size: int) -> DataFrame:
    """ti, tj, m, n, data: dense tiles of a matrix; missing entries are zero. Tiles at the edge hold what is there."""
    dealt = a.select(F.expr(f"i div {size}").alias("ti"), F.expr(f"j div {size}").alias("tj"), F.expr(f"cast(i % {size} as int)").alias("r"), F.expr(f"cast(j % {size} as int)").alias("c"), "v")

    def run(t):
        import pyarrow as pa

        r, c, v = (np.asarray(t[k]) for k in ("r", "c", "v"))
        d = np.zeros((r.max() + 1, c.max() + 1))
        np.add.at(d, (r, c), v)
        return pa.table({"ti": t["ti"].slice(0, 1), "tj": t["tj"].slice(0, 1), "m": [d.shape[0]], "n": [d.shape[1]], "data": pa.array([d.ravel(order="F")], pa.list_(pa.float64()))})

    return dealt.groupBy("ti", "tj").applyInArrow(run, "ti bigint, tj bigint, m bigint, n bigint, data array<double>")


#: Tiles of a product that a task sums at a time: 128 MB of tiles of 256 rows and columns.
_SUMS = 256


def tile_product(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """A B by tiles: those that meet are dealt to a task by ranges of their common number, and each goes there once. A task
    sums its products by tile, and sends on what it has when it holds many; sums of these by entry."""
    import pyarrow as pa

    def entries(sums: dict):
        for (ti, tj), p in sums.items():
            i, j = np.nonzero(p)
            yield pa.RecordBatch.from_arrays([pa.array(ti * size + i), pa.array(tj * size + j), pa.array(p[i, j])], names=["i", "j", "v"])

    def run(batches):
        sums, left, k = {}, [], None
        for batch in batches:
            at, right, other, m, n = (batch.column(c).to_pylist() for c in range(5))
            data = batch.column(5)
            for r in range(batch.num_rows):
                x = np.array(data[r].values).reshape(m[r], n[r], order="F")
                if at[r] != k:
                    left, k = [], at[r]
                if not right[r]:
                    left.append((other[r], x))
                    continue
                for ti, y in left:
                    c = min(y.shape[1], x.shape[0])
                    p = y[:, :c] @ x[:c]
                    if (ti, other[r]) in sums and sums[ti, other[r]].shape == p.shape:
                        sums[ti, other[r]] += p
                        continue
                    if len(sums) >= _SUMS or (ti, other[r]) in sums:
                        yield from entries(sums)
                        sums = {}
                    sums[ti, other[r]] = p
        yield from entries(sums)

    one = a.select(F.col("tj").alias("k"), F.lit(False).alias("right"), F.col("ti").alias("t"), "m", "n", "data")
    both = one.unionByName(b.select(F.col("ti").alias("k"), F.lit(True).alias("right"), F.col("tj").alias("t"), "m", "n", "data"))
    parts = both.repartitionByRange("k").sortWithinPartitions("k", "right").mapInArrow(run, "i bigint, j bigint, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


#: Entries of whole columns that a task multiplies together, products that it makes at a time, and rows that it sums in one array.
_ENTRIES, _PRODUCTS, _ROWS = 1 << 14, 1 << 18, 1024


def gram_pieces(a: DataFrame, alpha: float = 1.0) -> DataFrame:
    """alpha A A^T of (i, j, v), on and below the diagonal, as pieces (i, j, v arrays) that are to be added; entries of one
    place are, too. Columns are dealt by ranges, so each entry goes to one task once, and a task sums what columns of the
    same rows give before it sends it on."""

    def run(batches):
        import pyarrow as pa

        def piece(i, j, v):
            for k in range(0, len(v), _PRODUCTS):
                cells = (pa.array([x[k : k + _PRODUCTS]], pa.list_(t)) for x, t in ((i.astype(np.int32), pa.int32()), (j.astype(np.int32), pa.int32()), (alpha * v, pa.float64())))
                yield pa.RecordBatch.from_arrays(list(cells), names=["i", "j", "v"])

        def columns():
            left, many = [], 0
            for batch in batches:
                left.append([np.asarray(batch.column(c)) for c in range(3)])
                many += batch.num_rows
                if many >= _ENTRIES:
                    i, j, v = (np.concatenate(x) for x in zip(*left))
                    cut = np.searchsorted(j, j[-1])
                    if cut:
                        yield i[:cut], j[:cut], v[:cut]
                    left, many = [[i[cut:], j[cut:], v[cut:]]], 0
            if left:
                yield tuple(np.concatenate(x) for x in zip(*left))

        held, sums = np.zeros(0, np.int64), np.zeros((0, 0))

        def summed():
            i, j = np.nonzero(sums)
            yield from piece(held[i], held[j], sums[i, j])

        for i, j, v in columns():
            rows, at = np.unique(i, return_inverse=True)
            first = np.searchsorted(j, j)
            count = np.arange(1, len(i) + 1) - first  # rows of a column are sorted: with itself and those before
            ends = np.cumsum(count)
            small = len(rows) <= _ROWS
            if small and not np.isin(rows, held).all():
                both = np.union1d(held, rows)
                if len(both) > _ROWS:
                    yield from summed()
                    held, sums = rows, np.zeros((len(rows), len(rows)))
                else:
                    grown, old = np.zeros((len(both), len(both))), np.searchsorted(both, held)
                    grown[np.ix_(old, old)] = sums
                    held, sums = both, grown
            if small:
                at, width = np.searchsorted(held, rows)[at], len(held)
            else:
                width = len(rows)
            lo = 0
            while lo < len(i):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PRODUCTS, "right")))
                c = count[lo:hi]
                p = np.repeat(np.arange(lo, hi), c)
                q = np.arange(len(p)) - np.repeat(np.cumsum(c) - c - first[lo:hi], c)
                w = v[p] * v[q] * (1.0 + ((at[p] == at[q]) & (p != q)))  # of two entries of a place either meets the other
                key = at[p] * width + at[q]
                if small:
                    sums += np.bincount(key, w, width * width).reshape(width, width)
                else:
                    key, n = np.unique(key, return_inverse=True)
                    yield from piece(rows[key // width], rows[key % width], np.bincount(n, w))
                lo = hi
        yield from summed()

    plain = a.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).dropna()
    return plain.repartitionByRange("j").sortWithinPartitions("j", "i").mapInArrow(run, "i array<int>, j array<int>, v array<double>")


def tall_qr(a: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """R, and the rows (i, x) of Q, of a matrix with many rows (i, x array) and few columns: QR of each task's rows, then
    of the stacked factors, which are as many small matrices as there are tasks."""

    def local(batches):
        import pyarrow as pa

        r = None
        for batch in batches:
            x = np.asarray(batch.column(0).values, dtype=float).reshape(batch.num_rows, -1)
            r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()]), pa.array([r.shape[1]])], names=["r", "n"])

    parts = a.select("x").mapInArrow(local, "r array<double>, n bigint").collect()
    r = np.linalg.qr(np.vstack([np.array(p["r"]).reshape(-1, p["n"]) for p in parts]), mode="r")
    r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
    inverse = np.linalg.pinv(r)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column(1).values, dtype=float).reshape(batch.num_rows, -1) @ inverse
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist())], names=["i", "x"])

    return r, a.select("i", "x").mapInArrow(rows, "i bigint, x array<double>")


def tall_singular_values(a: DataFrame) -> np.ndarray:
    """Singular values of a matrix with many rows (i, x array) and few columns: those of its triangular factor."""
    return singular_values(tall_qr(a)[0])


def wide_lq(a: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """L, and the columns (i, x) of Q, of a matrix with few rows and many columns, each given as a row (i, x array)."""
    r, q = tall_qr(a)
    return r.T, q


def tall_column_id(a: DataFrame, rtol: float = 1e-4, atol: float = 1e-10, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X and the chosen columns J with A ~ A[:, J] X, of a matrix with many rows (i, x array): its triangular factor has the
    same columns to choose."""
    return column_id(tall_qr(a)[0], rtol, atol, most)
