"""Exact top-k search by inner product: tiled matrix products and merging of partial selections.

Vectors are packed into shards, queries into tiles; an equi-join on (tile, salt) brings each shard to each tile. A row
of the join is one matrix product, of which only each query's k best go on. Two levels of ranking merge the lists, the
first per salt; both rank with a limit that Spark applies before its exchange, too.

Components are floor(256 * x), x as double, held as 64-bit integers (larger ones become the nearest one that fits).
Products are exact: in double precision while every partial sum stays below 2**53, else in 64-bit integers, which wrap.
Vectors without id, null ones and those with a null or non-finite component take no part. A query meets vectors of
its own length only. Rows of one id are one candidate, its best row counting; as a query the least vector of an id
counts. Fewer candidates than k give all; an empty table no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaline.llm.base import table, written

SHARD, TILE = 2048, 512
#: Shards in a part and tiles in a group, of which each part meets each group in one task.
MEET = 8


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id (long) and x (array<double>) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """dim, n, ids and data (binary): up to `size` vectors of one length in a row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = np.asarray(batch.column(0))
            lists = batch.column(1)
            lengths = np.diff(np.asarray(lists.offsets))
            flat, starts = np.asarray(lists.values, dtype=np.float64), np.asarray(lists.offsets)
            out = []
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                for k in range(0, len(at), size):
                    part = at[k : k + size]
                    x = flat[(starts[part][:, None] + np.arange(dim)).ravel()]
                    ints = np.clip(np.floor(256.0 * x), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                    ints = ints.astype(np.int16) if len(ints) and np.abs(ints).max() < 2**15 else ints
                    out.append((int(dim), len(part), ints.dtype.itemsize, ids[part].astype(np.int64).tobytes(), ints.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["dim", "n", "width", "ids", "data"])

    return rows.select("id", "x").mapInArrow(run, "dim bigint, n bigint, width bigint, ids binary, data binary")


def _matrix(data: bytes, width: int, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if width == 2 else np.int64).reshape(n, dim).astype(np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = lambda m: float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0
    if top(q) * top(x) * max(1, q.shape[1]) < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return q @ x.T


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int, repeated: bool) -> np.ndarray:
    """Places of the k best of distinct ids but `own`: by score, then by smaller id."""
    here = np.flatnonzero(ids != own)
    if repeated and len(here):
        here = here[np.lexsort((~scores[here], ids[here]))]
        here = here[np.r_[True, np.diff(ids[here]) != 0]]
    if len(here) > k:
        s = scores[here]
        here = here[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return here[np.lexsort((ids[here], ~scores[here]))][:k]


def _partial(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                x, q = _matrix(row["data"], row["width"], row["n"], row["dim"]), _matrix(row["q_data"], row["q_width"], row["q_n"], row["dim"])
                ids, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                scores, repeated = products(q, x), len(np.unique(ids)) < len(ids)
                places = [best_of(scores[j], ids, asked[j], k, repeated) for j in range(len(asked))]
                at, of = np.concatenate(places), np.repeat(np.arange(len(asked)), [len(p) for p in places])
                yield pa.RecordBatch.from_arrays([pa.array(asked[of]), pa.array(np.full(len(at), row["part"])), pa.array(ids[at]), pa.array(scores[of, at])], names=["query_id", "part", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score. is_query: a condition on `id`."""
    rows = usable(vectors, id_col, vector_col)
    asked = written(rows.where(is_query).groupBy("id").agg(F.min("x").alias("x")), "asked")
    shards = written(_packed(rows, SHARD), "shards")
    tiles = written(_packed(asked.repartition(max(1, -(-asked.count() // TILE))), TILE), "tiles")
    # every shard meets every tile once: shards are dealt into parts and copied to each group of tiles, tiles the other way round
    parts, groups = max(1, shards.count() // MEET), max(1, tiles.count() // MEET)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = shards.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts))).withColumn("group", each(groups))
    right = tiles.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "data"))).withColumn("group", F.pmod(F.xxhash64("q_ids"), F.lit(groups))).withColumn("part", each(parts))
    pairs = left.join(right, ["part", "group", "dim"]).drop("group")
    lists = pairs.mapInArrow(_partial(k), "query_id bigint, part bigint, vec_id bigint, score bigint")
    for keys in (["query_id", "part"], ["query_id"]):
        lists = lists.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x
  from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x)
  where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
