"""Near-duplicate documents by bottom-k sketches of word shingles.

A document's set are its shingles' hashes; equal sets form a class, of which the smallest id stands for all. A class's
sketch are the k smallest values of its set, under the one hash function. Candidates come from inverted lists of the
retained values: two sets of similarity s share about s * k of them, and must share a value among the rarest
`m - t + 1` of either (m: values retained, t: the least overlap that counts), so common values have no list. First
each member of a list meets the list's most central one, whose values are shared most. Pairs whose union sketch
estimates too small a similarity go; the rest is verified on full sets. After that only members of different
components still meet: those that share a shingle which few of them have, found in buckets of hashes of full sets, and
those that have enough other shingles to be similar without one. So large groups don't give all their pairs.

`LEAST` is far enough below the threshold that a pair of similarity 0.8 falls below it with a probability under 1e-6.

Null texts and texts without words have an empty set and are linked with nothing; texts with fewer words than a
shingle have their whole sequence as their one shingle. Rows of one id count as one document: their links meet.
Rows without id are linked with nothing and kept. An empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.base import WordHasher, plain_unions, rolled, small_batches, table, text_buffers, written
from tessaline.llm.components import connected

#: Retained values, and the least estimate that is verified.
K, LEAST = 40, 0.45
#: A shingle that so many open documents have at most is rare.
RARE = 16
#: Values that a task holds before it deals them out, values of a bucket, about, and members of a list that meet in one task.
HELD, BUCKET, CHUNK = 1 << 20, 500_000, 500
#: Bits of the filter that spares documents without candidates from being hashed and moved again. It has this size
#: always, and only ever lets too much through.
BITS = 1 << 23
SEED, BASE = 7, 0x9E3779B97F4A7C15


def _sets(batch, words: int, hasher: WordHasher):
    """Sorted distinct shingle hashes (signed) of each text of a batch's second column."""
    data, offsets = text_buffers(batch.column(1))
    s, e, first = hasher.spans(data, offsets)
    w = hasher.words(data, s, e)
    for i in range(batch.num_rows):
        own = w[first[i] : first[i + 1]]
        if len(own) >= words:
            yield np.unique(rolled(own, words, BASE).view(np.int64))
        elif len(own):
            yield rolled(own, len(own), BASE + 2 * len(own)).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def signatures(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, n, h1, h2 (of the whole set) and sketch of every row, as a written table."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        from tessaline.llm.base import fmix

        hasher = WordHasher(SEED, lower=True)
        for batch in batches:
            sets = list(_sets(batch, words, hasher))
            u = [x.view(np.uint64) for x in sets]
            h1 = np.array([x.sum(dtype=np.uint64) for x in u], np.uint64).view(np.int64)
            h2 = np.array([fmix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(x) else 0 for x in u], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array([x[:k] for x in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "h1", "h2", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return written(rows.mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>"), "signatures")


def inverted(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows of the inverted lists: v, rep, n, alone (retained values that no other class has), mine (all its lists)."""
    values = classes.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = values.join(counts, "v").groupBy("rep", "n", "m").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("own"))
    overlap = F.ceil(F.lit(least) * F.col("m")).cast("int")
    shared = shared.where(F.size("own") >= overlap)
    own = F.transform(F.slice("own", F.lit(1), F.greatest(F.size("own") - overlap + 1, F.lit(0))), lambda x: x["v"])
    rows = shared.select("rep", "n", (F.col("m") - F.size("own")).alias("alone"), own.alias("mine"))
    return written(rows.select(F.explode("mine").alias("v"), "rep", "n", "alone", "mine"), "lists")


def _near_in_size(a: Column, b: Column, share: float) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * int(round(100 * share))


def central_pairs(lists: DataFrame, share: float) -> DataFrame:
    """Each member of a list with the list's most central member, the one with the least `alone`."""
    center = lists.groupBy("v").agg(F.min(F.struct("alone", F.xxhash64("rep").alias("h"), "rep", "n")).alias("c")).select("v", F.col("c.rep").alias("a"), F.col("c.n").alias("a_n"))
    met = lists.join(center, "v").where((F.col("rep") != F.col("a")) & _near_in_size(F.col("n"), F.col("a_n"), share))
    return met.select(F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b")).distinct()


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists whose members are in several components, with each member's component, as a written table."""
    l = lists.join(labels, lists["rep"] == labels["node"], "left").select(*lists.columns, F.coalesce("label", "rep").alias("label"))
    several = l.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
    return written(l.join(several, "v", "left_semi"), "open-lists")


def other_pairs(lists: DataFrame, seen: DataFrame, share: float) -> DataFrame:
    """Pairs of a list's members that are in different components, haven't met, and can be similar enough.

    lists: open ones, with s, the number of a member's shingles that more than RARE members have: two sets that share
    no rare one, which have met already, share the smaller s at most.
    """
    percent = int(round(100 * share))
    # members of a long list are dealt into chunks, and each two chunks meet in a place of their own
    sizes = lists.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    rows = lists.join(sizes, "v").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    l = rows.withColumns({"lo": F.col("chunk"), "hi": F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1))})
    r = rows.withColumns({"lo": F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk"))), "hi": F.col("chunk")})
    keys = ["v", "lo", "hi"]
    r = r.select(*keys, *(F.col(c).alias(f"r_{c}") for c in ("rep", "n", "s", "label", "mine")))
    most = F.least("s", "r_s")
    can = most * 100 >= (F.col("n") + F.col("r_n") - most) * percent
    once = F.array_min(F.array_intersect("mine", "r_mine")) == F.col("l_v")
    l = l.select(*(F.col(k).alias(f"l_{k}") for k in keys), *[c for c in l.columns if c not in keys])
    met = l.join(r, [F.col(f"l_{k}") == F.col(k) for k in keys] + [(F.col("lo") < F.col("hi")) | (F.col("rep") < F.col("r_rep")), F.col("label") != F.col("r_label"), can, once])
    pairs = met.select(F.least("rep", "r_rep").alias("a"), F.greatest("rep", "r_rep").alias("b"))
    return pairs.join(seen, ["a", "b"], "left_anti")


#: Kinds of what tasks deal out: values with the sets they are of, common values alone, numbers of common values by set.
ENTRY, COMMON, COUNT = range(3)


def _runs(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by value and id in which each id comes once for a value, where each value starts, and how many ids it has."""
    order = np.lexsort((ids, h))
    if len(order):
        order = order[np.r_[True, (np.diff(h[order]) != 0) | (np.diff(ids[order]) != 0)]]
    starts = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0]) if len(order) else np.empty(0, np.int64)
    return order, starts, np.diff(np.r_[starts, len(order)])


def compared(sets: DataFrame, total: int) -> DataFrame:
    """What full sets of open lists tell, as a written table: rows rep, s (how many of its values more than RARE sets
    have), and rows a, b (different components that share a value that no more than RARE sets have).

    sets: id, label and set; total: values in all, about. Two sets that share no rare value share the smaller s at most.

    A task counts the values it holds before it deals them out: one that more than RARE of its sets have goes to its
    bucket once, without them, so a value that a third of all documents have has RARE entries a task at most.
    """
    buckets = max(64, total // BUCKET)

    def dealt(batches):
        import pyarrow as pa

        names = ["bucket", "kind", "ids", "labels", "hashes"]

        def rows_of(held):
            ids, labels = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            lengths, h = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            of = np.repeat(np.arange(len(ids)), lengths)
            order, starts, several = _runs(h, ids[of])
            common = several > RARE
            run_lengths = np.diff(np.r_[starts, len(order)])
            heads, settled, ask = h[order[starts[common]]], order[np.repeat(common, run_lengths)], order[np.repeat(~common, run_lengths)]
            out = []

            def add(kind, hashes, docs):
                to = ((hashes.view(np.uint64) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                at = np.argsort(to, kind="stable")
                edges = np.r_[np.flatnonzero(np.r_[True, np.diff(to[at]) != 0]), len(at)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    o = at[a:b]
                    out.append((int(to[o[0]]), kind, None if docs is None else ids[docs[o]].tobytes(), None if docs is None else labels[docs[o]].tobytes(), hashes[o].tobytes()))

            if len(ask):
                add(ENTRY, h[ask], of[ask])
            if len(heads):
                add(COMMON, heads, None)
                who, count = np.unique(ids[of[settled]], return_counts=True)
                out.append((int(who[0] % buckets), COUNT, who.tobytes(), None, count.astype(np.int64).tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

        held, n = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                part = np.frombuffer(batch.column(2)[k].as_buffer(), np.int64).copy()
                if len(part):
                    held.append((np.array([batch.column(0)[k].as_py()]), np.array([batch.column(1)[k].as_py()]), np.array([len(part)]), part))
                    n += len(part)
                if n >= HELD:
                    yield rows_of(held)
                    held, n = [], 0
        if held:
            yield rows_of(held)

    def counted(t):
        import pyarrow as pa

        kind = np.asarray(t["kind"])
        joined = lambda name, k: np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x, own in zip(t[name], kind, strict=True) if own == k)])
        ids, labels, h, known = joined("ids", ENTRY), joined("labels", ENTRY), joined("hashes", ENTRY), np.unique(joined("hashes", COMMON))
        order, starts, several = _runs(h, ids)
        common = (several > RARE) | np.isin(h[order[starts]], known)
        lengths = np.diff(np.r_[starts, len(order)])
        own = np.r_[ids[order[np.repeat(common, lengths)]], joined("ids", COUNT)]
        rep, at = np.unique(own, return_inverse=True)
        s = np.zeros(len(rep), np.int64)
        np.add.at(s, at, np.r_[np.ones(len(own) - len(joined("ids", COUNT)), np.int64), joined("hashes", COUNT)])
        pairs = [np.empty((0, 2), np.int64)]
        for size in range(2, RARE + 1):
            first = starts[~common & (lengths == size)]
            for x in range(size):
                for y in range(x + 1, size):
                    p, q = order[first + x], order[first + y]
                    apart = labels[p] != labels[q]
                    pairs.append(np.stack([ids[p[apart]], ids[q[apart]]], axis=1))
            if sum(map(len, pairs)) > 1_000_000:
                pairs = [np.unique(np.concatenate(pairs), axis=0)]
        pairs = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        none = lambda n: pa.nulls(n, pa.int64())
        counts = pa.table({"rep": rep, "s": s, "a": none(len(rep)), "b": none(len(rep))})
        return pa.concat_tables([counts, pa.table({"rep": none(len(pairs)), "s": none(len(pairs)), "a": pairs[:, 0], "b": pairs[:, 1]})])

    packed = sets.select("id", "label", "set").mapInArrow(dealt, "bucket bigint, kind int, ids binary, labels binary, hashes binary")
    return written(packed.groupBy("bucket").applyInArrow(counted, "rep bigint, s bigint, a bigint, b bigint"), "compared")


def estimated(pairs: DataFrame, classes: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs of which the k smallest values of both sketches are in both often enough."""
    s = classes.select("rep", "sketch")
    joined = pairs.join(s.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(s.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
    k = F.greatest(F.size("x"), F.size("y"))
    joined = joined.withColumn("u", F.slice(F.array_sort(F.array_union("x", "y")), F.lit(1), F.when(k < K, F.size(F.array_union("x", "y"))).otherwise(F.lit(K))))
    both = F.size(F.array_intersect(F.array_intersect("x", "y"), "u"))
    return joined.where(both >= F.lit(least) * F.size("u")).select("a", "b")


def _place(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(BITS)).cast("long")


def _bit_set(ids: DataFrame) -> np.ndarray:
    """BITS bits with those of the ids' places set: put together from parts of a fixed number and size."""
    x = _place("id") + 1
    parts = ids.select(F.bitmap_bucket_number(x).alias("bucket"), F.bitmap_bit_position(x).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for p in parts:
        bits = np.frombuffer(bytes(p["bits"]), np.uint8)
        out[(p["bucket"] - 1) * len(bits) : p["bucket"] * len(bits)] = bits
    return out


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and set (binary) of the documents with these ids."""
    small_batches(docs.sparkSession)
    bits = _bit_set(ids)

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(SEED, lower=True)
        for batch in batches:
            at = np.asarray(batch.column(2))
            some = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            if some.num_rows:
                got = [x.tobytes() for x in _sets(some, words, hasher)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(got, pa.binary())], names=["id", "set"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    return rows.withColumn("at", _place("id")).mapInArrow(run, "id bigint, set binary")


def sets_of(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """id and set (binary) of the documents with these ids, as a written table."""
    ids = written(ids.distinct(), "ids")
    return written(_full_sets(docs, ids, words).join(ids, "id", "left_semi"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (ids a, b) of similarity share or more, on their full sets."""
    percent = int(round(100 * share))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; component_id is the smallest id reachable over links."""
    plain_unions(docs.sparkSession)
    rows = signatures(docs, words)
    some = rows.where("n > 0 and doc_id is not null")
    keys = ["h1", "h2", "n"]
    classes = written(some.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    lists = inverted(classes)
    first = written(estimated(central_pairs(lists, share), classes), "pairs")
    both = first.select(F.col("a").alias("id")).unionByName(first.select(F.col("b").alias("id")))
    links = written(verified(first, sets_of(both, docs, words), share), "links")
    still = open_lists(lists, connected(links))
    members = written(still.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"), F.max("label").alias("label")), "members")
    total = members.agg(F.sum("n")).first()[0]
    if total:
        sets = sets_of(members.select("id"), docs, words)
        told = compared(sets.join(members.select("id", "label"), "id"), total)
        common = told.where("rep is not null").groupBy("rep").agg(F.sum("s").alias("s"))
        still = still.join(common, "rep", "left").withColumn("s", F.coalesce("s", F.lit(0)))
        still = written(still.withColumn("alone", (F.col("n") - F.col("s")) / F.col("n")), "open-lists")
        # once more the centers, now known from full sets, and pairs of rare values; then whoever is still apart
        near = members.select("id", "n")
        rare = told.where("a is not null").select("a", "b").distinct().join(near.select(F.col("id").alias("a"), F.col("n").alias("a_n")), "a").join(near.select(F.col("id").alias("b"), F.col("n").alias("b_n")), "b")
        rare = rare.where(_near_in_size(F.col("a_n"), F.col("b_n"), share)).select("a", "b")
        second = central_pairs(still, share).unionByName(rare).distinct().join(first, ["a", "b"], "left_anti")
        second = written(estimated(second, classes), "pairs")
        links = links.unionByName(written(verified(second, sets, share), "links"))
        apart = open_lists(still.drop("label"), connected(links))
        third = written(estimated(other_pairs(apart, first.unionByName(second), share), classes), "pairs")
        links = links.unionByName(written(verified(third, sets, share), "links"))
    # an id whose rows have several sets is one document
    several = some.select("doc_id", *keys).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    same = some.select("doc_id", *keys).join(several, "doc_id").join(classes.select("rep", *keys), keys).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    labels = connected(links.unionByName(same))
    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select(*keys, F.coalesce("label", "rep").alias("component"))
    out = rows.join(of_class, keys, "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def one_of_each(docs: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """The documents without those that a smaller id of their group stands for; of repeated ids all rows stay or go."""
    gone = near_duplicates(docs, words, share).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


OP6_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s
  from d
), e as (select doc_id, len(s) as n, hash(unnest(s)) as h from s
), i as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as an, any_value(b.n) as bn, count(*) as c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by all
), l as (select a, b from i where 100 * c >= 80 * (an + bn - c)
), pairs as (select a, b from l union all select b, a from l
), walk as (
  with recursive r(node, root) as (
    select doc_id, doc_id from d union select pairs.b, r.root from r join pairs on pairs.a = r.node
  ) select node, min(root) as root from r group by node
)
select s.doc_id, len(s.s)::bigint as n_shingles, walk.root as component_id, s.doc_id = walk.root as kept from s join walk on walk.node = s.doc_id
"""
