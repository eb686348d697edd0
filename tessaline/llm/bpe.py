"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until a leaf holds at most `LEAF` characters; leaves are encoded on their own. Two neighbours are
joined by encoding a window around their seam anew. The window grows on either side until it ends where white space
follows a character that is none. The splitting pattern has no match across such a place: a match is either white
space only, or at most one blank and then no white space. A match depends on nothing left of its start, and on the
right on one character at most beyond its end, so tokens outside the window are those of the whole text. A side
without such a place goes into the window whole. Decoding concatenates the bytes of halves up the same tree.

Null texts count as empty: no tokens. Special tokens are ordinary text. Repeated rows give repeated rows, an empty
table an empty result; columns of the input other than id and text are left alone.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.base import small_batches, table

#: Characters in a leaf at most.
LEAF = 8192
#: Characters on each side of the window at first; doubled while it isn't closed.
WINDOW = 32
#: Ids that a leaf of the decoding tree holds at most.
IDS = 4096


class Codec:
    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.close = regex.compile(r"(?<=\S)\s")
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.tokens.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._encode(text, lo, mid), self._encode(text, mid, hi)
        a, b = self._left_edge(text, lo, mid), self._right_edge(text, mid, hi)
        seam = self.tokens.encode_ordinary(text[a:b])
        return left[: self._before(left, text[a:mid])] + seam + right[self._after(right, text[mid:b]) :]

    def _left_edge(self, text: str, lo: int, mid: int) -> int:
        """The last place before mid that no match crosses, or lo."""
        w = self.window
        while True:
            at = max(lo, mid - w)
            found = [m.start() for m in self.close.finditer(text, max(lo, at - 1), mid)]
            if found:
                return found[-1]
            if at == lo:
                return lo
            w *= 2

    def _right_edge(self, text: str, mid: int, hi: int) -> int:
        """The first place after mid that no match crosses, or hi."""
        w = self.window
        while True:
            end = min(hi, mid + w)
            if m := self.close.search(text, mid, end):
                return m.start()
            if end == hi:
                return hi
            w *= 2

    def _before(self, ids: list[int], tail: str) -> int:
        n, k = len(tail.encode("utf-8")), len(ids)
        while n > 0:
            k -= 1
            n -= int(self.length[ids[k]])
        return k

    def _after(self, ids: list[int], head: str) -> int:
        n, k = len(head.encode("utf-8")), 0
        while n > 0:
            n -= int(self.length[ids[k]])
            k += 1
        return k

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= IDS:
            return self.tokens.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW) -> Codec:
    return Codec(ranks_path, pattern, leaf, window)


def _mapped(ranks_path: str, pattern: str, leaf: int, row: Callable) -> Callable:
    def run(batches):
        import pyarrow as pa

        code = codec(ranks_path, pattern, leaf)
        for batch in batches:
            rows = [row(code, x) for x in batch.column("value").to_pylist()]
            names = rows[0].keys() if rows else ()
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows]) for k in names)], names=[batch.schema.names[0], *names])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """id and `ids` (array<int>) of each row's whole text."""
    small_batches(docs.sparkSession)

    def row(code: Codec, text: str | None) -> dict:
        return {"ids": np.array(code.encode(text or ""), np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("value")).mapInArrow(_mapped(ranks_path, pattern, leaf, row), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id and `bytes` (binary) of each row's `ids`; null ids count as none."""

    def row(code: Codec, ids: list[int] | None) -> dict:
        return {"bytes": code.decode(list(ids or ()))}

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col("ids").alias("value")).mapInArrow(_mapped(ranks_path, pattern, LEAF, row), f"`{id_col}` {kind}, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Encoding and decoding in one pass, with the ids' count and digest and the decoded bytes' digest."""
    small_batches(docs.sparkSession)

    def row(code: Codec, text: str | None) -> dict:
        ids = code.encode(text or "")
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(code.decode(ids)).hexdigest()}

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("value")).mapInArrow(_mapped(ranks_path, pattern, leaf, row), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
