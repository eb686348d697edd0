"""Matrix files: MatrixMarket text, binary CSR, and Parquet tables of any relation."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"s": np.float32, "d": np.float64, "c": np.complex64, "z": np.complex128}


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a coordinate file, numbered from 0; symmetric kinds mirrored; complex values as structs.

    Numbers count from 1 unless a 0 occurs. Entries of one place stay apart. Patterns and arrays raise ValueError.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    words = head[0].lower().split() if head else []
    if len(words) < 5 or words[2] != "coordinate" or words[3] not in ("real", "integer", "complex") or words[4] not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise ValueError(f"not a coordinate file of numbers: {words}")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(parts.alias("p"))
    complex_ = words[3] == "complex"
    # the size line has one number less than an entry
    entries = rows.where(F.size("p") == (4 if complex_ else 3))
    size = rows.where(F.size("p") == 3).first() if complex_ else lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(parts.alias("p")).first()
    m, n, nnz = (int(x) for x in size[0])
    if m != n:
        raise ValueError(f"the matrix isn't square: {m} x {n}")
    number = lambda k: F.col("p")[k].cast("double")
    if complex_:
        e = entries.select(F.col("p")[0].cast("long").alias("i"), F.col("p")[1].cast("long").alias("j"), F.struct(number(2).alias("re"), number(3).alias("im")).alias("v"))
    else:
        # the first line of three numbers is the size
        e = entries.withColumn("nth", F.monotonically_increasing_id())
        first = e.agg(F.min("nth")).first()[0]
        e = e.where(F.col("nth") != first).select(F.col("p")[0].cast("long").alias("i"), F.col("p")[1].cast("long").alias("j"), number(2).alias("v"))
    least = e.agg(F.min(F.least("i", "j"))).first()[0]
    base = 0 if least == 0 else 1
    e = e.select((F.col("i") - base).alias("i"), (F.col("j") - base).alias("j"), "v")
    if words[4] != "general":
        if complex_:
            re, im = F.col("v.re"), F.col("v.im")
            flip = {"symmetric": (re, im), "skew-symmetric": (-re, -im), "hermitian": (re, -im)}[words[4]]
            value = F.struct(flip[0].alias("re"), flip[1].alias("im"))
        else:
            value = -F.col("v") if words[4] == "skew-symmetric" else F.col("v")
        e = e.unionByName(e.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), value.alias("v")))
    return e


def write_matrix_market(a: DataFrame, path: str, n: int) -> None:
    """One coordinate file of a real matrix, numbers from 1, with all digits; entries in order of row and column."""
    nnz = a.count()
    head = a.sparkSession.createDataFrame([(-2, -1, "%%MatrixMarket matrix coordinate real general"), (-1, -1, f"{n} {n} {nnz}")], "i long, j long, value string")
    body = a.select("i", "j", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("string")).alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("i", "j").select("value").write.mode("overwrite").text(path)


def encode_csr(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> bytes:
    """Binary CSR: R, index width (4 or 8), scalar letter, then rows, columns, entries, row starts, columns, values."""
    order = np.lexsort((j, i))
    letter = next(k for k, t in KINDS.items() if np.dtype(t) == v.dtype)
    starts = np.searchsorted(i[order], np.arange(n + 1)).astype("<i8")
    return b"R8" + letter.encode() + struct.pack("<qqq", n, n, len(v)) + starts.tobytes() + j[order].astype("<i8").tobytes() + v[order].tobytes()


def decode_csr(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    if data[:1] != b"R" or chr(data[2]) not in KINDS:
        raise ValueError("not a binary matrix")
    width, kind = int(chr(data[1])), np.dtype(KINDS[chr(data[2])])
    index = np.dtype(f"<i{width}")
    m, n, nnz = (int(x) for x in np.frombuffer(data, index, 3, 3))
    at = 3 + 3 * width
    starts = np.frombuffer(data, index, m + 1, at)
    cols = np.frombuffer(data, index, nnz, at + (m + 1) * width)
    values = np.frombuffer(data, kind, nnz, at + (m + 1 + nnz) * width)
    return np.repeat(np.arange(m), np.diff(starts)), cols.astype(np.int64), values, n


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of binary CSR files, each decoded by one task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                i, j, v, _ = decode_csr(data)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v.real.astype(np.float64)), pa.array(v.imag.astype(np.float64))], names=["i", "j", "re", "im"])

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInArrow(run, "i bigint, j bigint, re double, im double")


def write_binary(a: DataFrame, path: str, n: int) -> None:
    """One local binary CSR file of a real matrix that fits the driver."""
    rows = a.select("i", "j", "v").toPandas()
    with open(path, "wb") as f:
        f.write(encode_csr(rows["i"].to_numpy(), rows["j"].to_numpy(), rows["v"].to_numpy(np.float64), n))


def dense_rows(a: DataFrame) -> DataFrame:
    """i and the row's values as an array in column order: for printing small matrices."""
    return a.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("row"))


def write_binary_parts(a: DataFrame, path: str, n: int, rows: int = 4096) -> None:
    """Binary CSR of a real n x n matrix, a record for each `rows` rows (first row and bytes), each encoded by its task."""

    def run(t):
        import pyarrow as pa

        lo = t["part"][0].as_py() * rows
        i, j, v = np.asarray(t["i"]) - lo, np.asarray(t["j"]), np.asarray(t["v"], dtype=np.float64)
        return pa.table({"first": pa.array([lo], pa.int64()), "data": pa.array([encode_csr(i, j, v, n)], pa.binary())})

    parts = a.select(F.expr(f"i div {rows}").alias("part"), "i", "j", F.col("v").cast("double").alias("v"))
    parts.groupBy("part").applyInArrow(run, "first bigint, data binary").write.mode("overwrite").parquet(path)


def read_binary_parts(spark: SparkSession, path: str) -> DataFrame:
    """i, j, re, im of what write_binary_parts wrote."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                i, j, v, _ = decode_csr(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(i + first), pa.array(j), pa.array(v.real.astype(np.float64)), pa.array(v.imag.astype(np.float64))], names=["i", "j", "re", "im"])

    return spark.read.parquet(path).select("first", "data").mapInArrow(run, "i bigint, j bigint, re double, im double")


def write_dense(rows: DataFrame, path: str) -> None:
    """Rows (i, x array) as binary: 8 bytes a number, little-endian."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            off, flat = np.asarray(batch.column(1).offsets), np.asarray(batch.column(1).values, dtype="<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["i", "data"])

    rows.select(F.col("i").cast("long").alias("i"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "i bigint, data binary").write.mode("overwrite").parquet(path)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = [np.frombuffer(b.as_buffer(), "<f8") for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["i", "x"])

    return spark.read.parquet(path).select("i", "data").mapInArrow(run, "i bigint, x array<double>")


def dense_lines(rows: DataFrame) -> DataFrame:
    """i and a line of text for each row (i, x array): numbers with seven digits."""
    line = F.array_join(F.transform("x", lambda v: F.format_string("%.6e", v)), " ")
    return rows.select("i", F.concat(F.lit("[ "), line, F.lit(" ]")).alias("line"))


def sparse_lines(a: DataFrame) -> DataFrame:
    """i and a line of text for each row that has entries: column:value in order of columns."""
    entries = F.array_sort(F.collect_list(F.struct("j", "v")))
    return a.groupBy("i").agg(entries.alias("e")).select("i", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["j"].cast("string"), x["v"].cast("string"))), " ").alias("line"))


def print_to_file(lines: DataFrame, path: str) -> None:
    """Lines (i, line) as text, each after its number; files hold them in order of rows."""
    lines.repartitionByRange("i").sortWithinPartitions("i").select(F.concat_ws(" ", F.col("i").cast("string"), "line").alias("value")).write.mode("overwrite").text(path)
