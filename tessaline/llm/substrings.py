"""Removal of passages that a document with a smaller id has: exact repeats of `words` consecutive words.

Anchors. Every document's non-overlapping blocks of half as many words are indexed by hash, and every rolling window
of that length probes them; a repeat of full length holds a whole block. Entries are packed: a task writes one row of
hashes, documents and positions per bucket of hashes. Hashes that a task sees in several documents are hits at once,
and travel as one entry without position, so a passage that a third of all documents share has few entries. Where a
bucket has a block and another document's window of one hash, both documents get the positions as hits.

Extension. Only around hits, full-length windows are hashed with two functions (80 bits besides the bucket), so that
each maximal repeat shows as a run of windows; equal ones meet in a bucket, where all but those of the smallest id
are repeats. Again a task first settles what it can by itself.

Documents meet their hits in groups by a hash of id and text, of even size however hot a passage is. A filter of
fixed size keeps documents without hits from being moved.

Null and empty texts have no words; nothing is removed from texts of fewer words than a window. Rows without id come
after all ids. Rows of one id don't affect each other. An empty table gives no rows. Extra columns are left alone.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.base import WordHasher, plain_unions, rolled, small_batches, table, text_buffers, written

#: Words of a bucket, documents and words of a group, about.
BUCKET_WORDS, GROUP_DOCS, GROUP_WORDS = 2_000_000, 1_000, 1_000_000
LEAST_BUCKETS, LEAST_GROUPS = 64, 64
#: Bytes of text whose windows a task hashes at a time, about; a longer text is worked as a whole.
PORTION = 1 << 22
BITS = 1 << 23
SEEDS, BASE = (11, 12), 0xD6E8FEB86659FD93
LAST = 2**63 - 1

PACKED = "kind int, rids binary, ids binary, counts binary, wide boolean, pos binary, low binary, high binary"
#: Kinds of packed rows: entries that want an answer; hashes alone, of a block and of no block; positions already settled.
ASK, BLOCK, LOOSE, DONE = range(4)


def _five(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


class _Rows:
    """Packed rows for one output batch."""

    def __init__(self, key: str):
        self.key, self.rows = key, []

    def add(self, at: int, kind: int, doc=None, rids=None, ids=None, pos=None, low=None, high=None) -> None:
        """doc: which document each entry is of, in runs."""
        r = dict.fromkeys(("rids", "ids", "counts", "pos", "low", "high"))
        r |= {self.key: int(at), "kind": kind, "wide": False}
        if doc is not None and len(doc):
            cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            r["rids"] = rids[doc[cut]].tobytes()
            r["ids"] = None if ids is None else ids[doc[cut]].tobytes()
            r["counts"] = np.diff(np.r_[cut, len(doc)]).astype(np.int32).tobytes()
            r["wide"] = bool(pos.max() >= 65536)
            r["pos"] = pos.astype(np.int32 if r["wide"] else np.uint16).tobytes()
        r["low"] = None if low is None else _five(low)
        r["high"] = None if high is None else _five(high)
        self.rows.append(r)

    def add_by(self, where: np.ndarray, kind: int, doc=None, rids=None, ids=None, pos=None, low=None, high=None) -> None:
        """Entries to the places in `where`, in their order within each."""
        if not len(where):
            return
        order = np.argsort(where, kind="stable")
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(where[order]) != 0]), len(where)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            o = order[a:b]
            pick = lambda x: None if x is None else x[o]  # noqa: B023, E731
            self.add(where[o[0]], kind, pick(doc), rids, ids, pick(pos), pick(low), pick(high))

    def table(self):
        import pyarrow as pa

        kinds = {self.key: pa.int64(), "kind": pa.int32(), "rids": pa.binary(), "ids": pa.binary(), "counts": pa.binary(), "wide": pa.bool_(), "pos": pa.binary(), "low": pa.binary(), "high": pa.binary()}
        return pa.table({k: pa.array([r[k] for r in self.rows], t) for k, t in kinds.items()})


def _unpacked(t, kind: int):
    """rid, id, position, low and high of the entries of a kind (what is absent: None)."""
    rids, ids, pos, low, high = [], [], [], [], []
    for r in t.to_pylist():
        if r["kind"] != kind:
            continue
        if r["rids"] is not None:
            n = np.frombuffer(r["counts"], np.int32)
            rids.append(np.repeat(np.frombuffer(r["rids"], np.int64), n))
            pos.append(np.frombuffer(r["pos"], np.int32 if r["wide"] else np.uint16).astype(np.int32))
            if r["ids"] is not None:
                ids.append(np.repeat(np.frombuffer(r["ids"], np.int64), n))
        if r["low"] is not None:
            low.append(_from_five(r["low"]))
        if r["high"] is not None:
            high.append(_from_five(r["high"]))
    one = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return one(rids, np.int64), one(ids, np.int64), one(pos, np.int32), one(low, np.uint64), one(high, np.uint64)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each run of equal ones starts in it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _portions(batch, column: int):
    """Slices of a batch whose texts have about PORTION bytes: a batch has a number of rows, however long their texts."""
    import pyarrow.compute as pc

    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, np.diff((np.cumsum(n) - n) // PORTION) != 0])
    for a, b in zip(cut, [*cut[1:], len(n)], strict=True):
        yield batch.slice(a, b - a)


def _windows(batch_text, n_words: int, hasher: WordHasher, needs: int):
    """Hash, document and position of all windows of n_words in documents of `needs` words or more."""
    data, offsets = text_buffers(batch_text)
    s, e, first = hasher.spans(data, offsets)
    h = rolled(hasher.words(data, s, e), n_words, BASE)
    n = np.diff(first)
    fits = np.where(n >= max(needs, n_words), n - n_words + 1, 0)
    doc = np.repeat(np.arange(len(n)), fits)
    pos = (np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits)).astype(np.int32)
    return h[first[doc] + pos] if len(doc) else np.empty(0, np.uint64), doc, pos


def _packed_hits(rids: np.ndarray, pos: np.ndarray, groups: int):
    """Positions by document, in a row per group of documents."""
    rows = _Rows("g")
    if len(rids):
        order = np.lexsort((pos, rids))
        rids, pos = rids[order], pos[order]
        keep = np.r_[True, (np.diff(rids) != 0) | (np.diff(pos) != 0)]
        rids, pos = rids[keep], pos[keep]
        names, doc = np.unique(rids, return_inverse=True)
        rows.add_by(rids % groups, DONE, doc, names, None, pos)
    return rows.table()


def _probed(words: int, buckets: int, groups: int):
    """Map: packed entries of the half windows of a batch of rid and text."""
    half = words // 2

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(SEEDS[0])
        for batch in (p for b in batches for p in _portions(b, 1)):
            rids = np.asarray(batch.column(0)).astype(np.int64)
            h, doc, pos = _windows(batch.column(1), half, hasher, words)
            if not len(h):
                continue
            out = _Rows("bucket")
            order, starts = _runs(h)
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(h)]))
            d, aligned = doc[order], pos[order] % half == 0
            several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
            block = np.logical_or.reduceat(aligned, starts)
            at = _bucket(h, buckets)
            heads = order[starts]
            for kind, some in ((BLOCK, several & block), (LOOSE, several & ~block)):
                out.add_by(at[heads[some]], kind, low=h[heads[some]])
            settled = np.sort(order[several[run_of]])
            ask = np.ones(len(h), bool)
            ask[settled] = False
            ask = np.flatnonzero(ask)
            out.add_by(at[ask], ASK, doc[ask], rids, None, pos[ask], h[ask])
            out.add_by(rids[doc[settled]] % groups % buckets, DONE, doc[settled], rids, None, pos[settled])
            yield from out.table().to_batches()

    return run


def _answered(words: int, groups: int):
    """A bucket's hits: entries whose hash has a block and is in several documents."""
    half = words // 2

    def run(t):
        rid, _, pos, h, _ = _unpacked(t, ASK)
        blocks, loose = _unpacked(t, BLOCK)[3], _unpacked(t, LOOSE)[3]
        done_rid, _, done_pos, _, _ = _unpacked(t, DONE)
        n = len(h)
        every = np.concatenate([h, blocks, loose])
        if not len(every):
            return _packed_hits(done_rid, done_pos, groups)
        aligned = np.concatenate([pos % half == 0, np.ones(len(blocks), bool), np.zeros(len(loose), bool)])
        order, starts = _runs(every)
        lengths = np.diff(np.r_[starts, len(every)])
        local = order < n
        who = np.where(local, np.concatenate([rid, np.zeros(len(every) - n, np.int64)])[order], 0)
        several = (np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)) | ~np.logical_and.reduceat(local, starts)
        good = np.repeat(several & np.logical_or.reduceat(aligned[order], starts), lengths) & local
        hit = order[good]
        return _packed_hits(np.concatenate([rid[hit], done_rid]), np.concatenate([pos[hit], done_pos]), groups)

    return run


def _extended(words: int, buckets: int, groups: int):
    """A group of documents with their hits: packed entries of the full windows around hits."""
    half = words // 2

    def run(key, texts, hits):
        rows = _Rows("bucket")
        hit_rid, _, hit_pos, _, _ = _unpacked(hits, DONE)
        rids, ids = np.asarray(texts["rid"]).astype(np.int64), np.asarray(texts["id"]).astype(np.int64)
        if not len(hit_rid) or not len(rids):
            return rows.table()
        order = np.lexsort((hit_pos, hit_rid))
        hit_rid, hit_pos = hit_rid[order], hit_pos[order]
        low, doc, pos = _windows(texts["text"], words, WordHasher(SEEDS[0]), words)
        high, _, _ = _windows(texts["text"], words, WordHasher(SEEDS[1]), words)
        # a window counts if a hit starts within its first words - half + 1 words
        mark = np.zeros(len(doc) + 1, np.int64)
        begins = np.searchsorted(doc, np.arange(len(rids)))
        n_windows = np.diff(np.r_[begins, len(doc)])
        for k in range(len(rids)):
            p = hit_pos[np.searchsorted(hit_rid, rids[k]) : np.searchsorted(hit_rid, rids[k], side="right")]
            if len(p) and n_windows[k]:
                np.add.at(mark, begins[k] + np.clip(p - (words - half), 0, n_windows[k]), 1)
                np.add.at(mark, begins[k] + np.clip(p + 1, 0, n_windows[k]), -1)
        some = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        if not len(some):
            return rows.table()
        low, high, doc, pos = low[some], high[some], doc[some], pos[some]
        order, starts = _runs(low, high)
        least = np.repeat(np.minimum.reduceat(ids[doc[order]], starts), np.diff(np.r_[starts, len(order)]))
        repeat = np.zeros(len(order), bool)
        repeat[order] = ids[doc[order]] > least
        done, ask = np.flatnonzero(repeat), np.flatnonzero(~repeat)
        rows.add_by(_bucket(low[ask], buckets), ASK, doc[ask], rids, ids, pos[ask], low[ask], high[ask])
        rows.add_by(rids[doc[done]] % groups % buckets, DONE, doc[done], rids, None, pos[done])
        return rows.table()

    return run


def _repeats(groups: int):
    """A bucket's repeats: windows that a smaller id has, too."""

    def run(t):
        rid, ids, pos, low, high = _unpacked(t, ASK)
        done_rid, _, done_pos, _, _ = _unpacked(t, DONE)
        if len(rid):
            order, starts = _runs(low, high)
            least = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.r_[starts, len(order)]))
            hit = order[ids[order] > least]
            done_rid, done_pos = np.concatenate([rid[hit], done_rid]), np.concatenate([pos[hit], done_pos])
        return _packed_hits(done_rid, done_pos, groups)

    return run


def covered(pos: np.ndarray, words: int, n: int) -> np.ndarray:
    """Which of n words a window at one of these positions covers."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, pos, 1)
    np.add.at(mark, np.minimum(pos + words, n), -1)
    return np.cumsum(mark[:-1]) > 0


def _cut(words: int, with_text: bool):
    """A group of documents without the words that their repeats cover."""

    def run(key, texts, hits):
        import pyarrow as pa

        hit_rid, _, hit_pos, _, _ = _unpacked(hits, DONE)
        order = np.argsort(hit_rid, kind="stable")
        hit_rid, hit_pos = hit_rid[order], hit_pos[order]
        out = {k: [] for k in ("id", "rid", "removed", "kept")}
        seen = set()
        for rid, doc_id, text in zip(texts["rid"].to_pylist(), texts["id"].to_pylist(), texts["text"].to_pylist(), strict=True):
            p = hit_pos[np.searchsorted(hit_rid, rid) : np.searchsorted(hit_rid, rid, side="right")]
            if not len(p) or (doc_id, rid) in seen:
                continue
            seen.add((doc_id, rid))
            all_words = (text or "").encode("utf-8").split()
            gone = covered(p, words, len(all_words))
            kept = b" ".join([w for w, g in zip(all_words, gone, strict=True) if not g])
            out["id"].append(doc_id)
            out["rid"].append(rid)
            out["removed"].append(int(gone.sum()))
            out["kept"].append(kept.decode("utf-8") if with_text else hashlib.sha256(kept).hexdigest())
        return pa.table({k: pa.array(v, pa.string() if k == "kept" else pa.int64()) for k, v in out.items()})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """id (rows without one last), rid and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("rid", F.shiftrightunsigned(F.xxhash64("id", "text"), 1))


def _only_with(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows (id, rid, text) that may have hits, by a filter of fixed size."""

    def names(batches):
        import pyarrow as pa

        for batch in batches:
            for b in batch.column(0):
                if b.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b.as_buffer(), np.int64) % BITS)], names=["x"])

    x = F.col("x") + 1
    parts = hits.select("rids").mapInArrow(names, "x bigint").select(F.bitmap_bucket_number(x).alias("bucket"), F.bitmap_bit_position(x).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for p in parts:
        part = np.frombuffer(bytes(p["bits"]), np.uint8)
        bits[(p["bucket"] - 1) * len(part) : p["bucket"] * len(part)] = part

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.asarray(batch.column(1)).astype(np.int64) % BITS
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))

    return docs.select("id", "rid", "text").mapInArrow(run, "id bigint, rid bigint, text string")


def _free(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the exchange files of steps that are done: it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, words: int, n_words: int, n_docs: int) -> tuple[DataFrame, int]:
    """Packed positions of all windows of `words` words that a smaller id has, by group; and the number of groups."""
    spark = docs.sparkSession
    buckets, groups = max(LEAST_BUCKETS, n_words // BUCKET_WORDS), max(LEAST_GROUPS, n_docs // GROUP_DOCS, n_words // GROUP_WORDS)
    by = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("long").alias("g")
    entries = docs.select("rid", "text").mapInArrow(_probed(words, buckets, groups), "bucket bigint, " + PACKED)
    hits = written(entries.groupBy("bucket").applyInArrow(_answered(words, groups), "g bigint, " + PACKED), "hits")
    del entries
    _free(spark)
    near = _only_with(docs, hits).withColumn("g", by("rid", groups))
    full = near.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(_extended(words, buckets, groups), "bucket bigint, " + PACKED)
    out = written(full.groupBy("bucket").applyInArrow(_repeats(groups), "g bigint, " + PACKED), "repeats")
    del near, full
    _free(spark)
    return out, groups


def cut_documents(docs: DataFrame, words: int = 50, with_text: bool = True) -> DataFrame:
    """id, rid, removed (words) and kept (the remaining words, or their SHA-256) of the rows that lose words.

    docs: id, rid, text, as _keyed gives them.
    """
    small_batches(docs.sparkSession)
    plain_unions(docs.sparkSession)
    n_docs, n_words = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.floor(F.octet_length("text") / 6)), F.lit(0))).first()
    found, groups = repeats(docs, words, int(n_words), n_docs)
    near = _only_with(docs, found).withColumn("g", F.pmod(F.col("rid"), F.lit(groups)))
    return near.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_cut(words, with_text), "id bigint, rid bigint, removed bigint, kept string")


def _digests(batches):
    """Number of words and SHA-256 of each whole text; the words of one text are held at a time."""
    import pyarrow as pa

    for batch in batches:
        n_words, sha = [], []
        for t in batch.column(2).cast(pa.binary()):
            w = t.as_buffer().to_pybytes().split()
            n_words.append(len(w))
            sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(sha, pa.string())], names=["id", "rid", "n_words", "sha"])


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _keyed(table(spark, sf_dir, "documents"))
    rows = docs.select("id", "rid", "text").mapInArrow(_digests, "id bigint, rid bigint, n_words bigint, sha string")
    cut = written(cut_documents(docs, 50, with_text=False), "cut")
    out = rows.join(cut, ["id", "rid"], "left")
    return out.select(F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"), "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, words: int = 50) -> DataFrame:
    """The documents without the words that a smaller id's windows cover; texts that lose nothing stay as they are.

    What remains of a text is joined by single blanks; n_chars follows. A text of which nothing remains goes.
    """
    keyed = _keyed(docs)
    cut = written(cut_documents(keyed, words), "cut")
    rid = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.coalesce(F.col("text"), F.lit(""))), 1)
    out = docs.withColumn("_rid", rid).join(cut.select(F.col("rid").alias("_rid"), F.col("kept").alias("_kept")), "_rid", "left")
    out = out.where(F.col("_kept").isNull() | (F.col("_kept") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_kept").cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.coalesce("_kept", "text")).select(*docs.columns)


OP5_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), p as (
  select doc_id, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50
), h as (
  select p.doc_id, p.i, md5(array_to_string(d.w[p.i : p.i + 49], ' ')) as h from p join d using (doc_id)
), m as (select h, min(doc_id) as least from h group by h
), r as (
  select distinct h.doc_id, unnest(range(h.i, h.i + 50)) as j from h join m using (h) where m.least < h.doc_id
), g as (select doc_id, list(j) as gone from r group by doc_id
), k as (
  select d.doc_id, d.w, coalesce(len(g.gone), 0) as n, case when g.gone is null then d.w else list_filter(d.w, lambda x, i: not list_contains(g.gone, i)) end as kept
  from d left join g using (doc_id)
)
select doc_id, len(w)::bigint as n_words, n::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""
