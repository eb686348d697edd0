"""What the operators of this package share: reading tables, the shared folder, cutting lineage, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: White space between words, as bytes: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same as a pattern of words, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: A to Z as a to z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows in an Arrow batch of texts: small, as one text may hold megabytes.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_unions(spark: SparkSession) -> None:
    """Unions don't pass on their inputs' partitioning: adaptive execution may coalesce each input differently afterwards."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(_ARROW_ROWS)) != BATCH_ROWS:
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and so is the master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="tessaline-")
        shared_folder.own = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "cut") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing of it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(*frames: DataFrame | None) -> None:
    """Drops tables that `written` made and that no later step reads: what came from them is written itself."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordHasher:
    """64-bit hashes of the white-space separated words of many texts at once, in a few passes of numpy.

    A word's hash is a polynomial in an odd base over a random table of its bytes, taken from prefix sums
    modulo 2**64 and mixed. Equal words have equal hashes in every process; `seed` picks the function.
    """

    CHUNK = 1 << 18

    def __init__(self, seed: int, lower: bool = False):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
        if lower:
            self.of_byte = self.of_byte[LOWER]
        self.base = np.uint64(int(rng.integers(1, 2**62)) * 4 + 3)
        self.up = np.full(self.CHUNK + 1, self.base, np.uint64)
        self.up[0] = 1
        self.up = np.multiply.accumulate(self.up)
        inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.down = np.full(self.CHUNK + 1, inverse, np.uint64)
        self.down[0] = 1
        self.down = np.multiply.accumulate(self.down)

    @staticmethod
    def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the number of words before it (one entry more than texts)."""
        full = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets[offsets <= len(data)]] = True
        starts = full.copy()
        starts[1:] &= ~full[:-1] | edge[1:-1]
        ends = full.copy()
        ends[:-1] &= ~full[1:] | edge[1:-1]
        s = np.flatnonzero(starts)
        return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)

    def words(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.empty(len(s), np.uint64)
        i = 0
        while i < len(s):
            lo = s[i]
            j = max(i + 1, int(np.searchsorted(e, lo + self.CHUNK, side="right")))
            hi = e[j - 1]
            if hi - lo > self.CHUNK:  # one word longer than a chunk: in parts, each continuing the sum
                h, step = np.uint64(0), np.uint64(pow(int(self.base), self.CHUNK, 2**64))
                for k in reversed(range(lo, hi, self.CHUNK)):
                    part = self.of_byte[data[k : min(k + self.CHUNK, hi)]]
                    with np.errstate(over="ignore"):
                        h = h * step + (part * self.up[: len(part)]).sum(dtype=np.uint64)
                out[i] = h
            else:
                total = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(self.of_byte[data[lo:hi]] * self.up[: hi - lo], out=total[1:])
                a, b = s[i:j] - lo, e[i:j] - lo
                out[i:j] = (total[b] - total[a]) * self.down[a]
            i = j
        return fmix(out)


def rolled(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all n consecutive words; as many as words less n - 1, none if there are fewer than n."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    b = np.uint64(base)
    power, h = np.uint64(1), np.zeros(m, np.uint64)
    if n <= 8:
        for k in range(n):
            h = h * b + words[k : k + m]
        return fmix(h)
    # prefix sums of words[i] * base**i, and the inverse powers to bring each window to its start
    up = np.full(len(words), b, np.uint64)
    up[0] = power
    up = np.multiply.accumulate(up)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    down = np.full(m, np.uint64(pow(base, -1, 2**64)), np.uint64)
    down[0] = power
    down = np.multiply.accumulate(down)
    return fmix((total[n:] - total[:-n]) * down)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (nulls as empty texts)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = offsets[0]
    return data[lo : offsets[-1]], offsets - lo
