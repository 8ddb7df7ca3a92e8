"""What the operators on word n-grams share: packed batches of documents, and sorted runs of hashes that hash ranges merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import partitions_for, slices
from quarry.llm.substring import _mix, _pack, _range_of, _unpack

#: Bytes of text that a batch is meant to hold, and whose n-grams one hash range is meant to merge.
BATCH_BYTES = 6 << 20
RANGE_BYTES = 12 << 20
_NEXT = np.uint64(0xA0761D6478BD642F)


def deal(rows: DataFrame, text: str) -> tuple[DataFrame, int]:
    """rows as (batch, blob), neighbouring rows of about BATCH_BYTES of text in a compressed blob (see `opened`), and the number of hash ranges.

    A longer text is a batch of its own. Batches are known by their place in the table, so rows
    must come in the same order whenever they are read again, as those of a table do.
    """
    spark, at, limit = rows.sparkSession, rows.columns.index(text), BATCH_BYTES
    size = rows.select(F.sum(F.octet_length(text))).first()[0] or 0
    n_ranges = max(1, -(-size // RANGE_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held, number = [], 0, TaskContext.get().partitionId() << 32

        def blob() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "blob"])

        for batch in batches:
            for part in slices(batch, at, limit):
                held.append(part)
                bytes_held += part.column(at).nbytes
                if bytes_held >= limit:
                    yield blob()
                    held, bytes_held, number = [], 0, number + 1
        if held:
            yield blob()

    return rows.mapInArrow(pack, "batch long, blob binary").repartition(partitions_for(spark, size, limit), "batch"), n_ranges


def opened(t: pa.Table) -> pa.Table:
    """The rows of a batch."""
    return pa.ipc.open_stream(t.column("blob")[0].as_buffer()).read_all()


def texts_of(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 texts with A-Z in lower case; a null is empty."""
    return [x.lower() if x else b"" for x in column.cast(pa.binary()).to_pylist()]


def ends_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other with a line feed behind each, and where each ends."""
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)


def longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams followed by one more word each."""
    return _mix(gram * _NEXT + word)


def counts_blob(c: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, compressed."""
    top = int(c.max()) if len(c) else 0
    c = c.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64)
    return bytes([c.itemsize]) + pa.compress(c.tobytes(), "zstd", asbytes=True)


def counts_of(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    return np.frombuffer(pa.decompress(blob[1:], n * width, "zstd", asbytes=True), f"u{width}").astype(np.int64)


def floats_blob(x: np.ndarray) -> bytes:
    """Numbers with their first bytes first, compressed."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(x, np.float64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def floats_of(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.float64).ravel()


def bits_blob(x: np.ndarray) -> bytes:
    return pa.compress(np.packbits(x).tobytes(), "zstd", asbytes=True)


def bits_of(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(pa.decompress(blob, -(-n // 8), "zstd", asbytes=True), np.uint8), count=n).astype(bool)


def runs(u: np.ndarray, n_ranges: int) -> tuple[list[int], list[slice], list[bytes]]:
    """Sorted hashes by hash range: the ranges that they fall in, where, and the hashes packed."""
    at = _range_of(u, n_ranges)
    full = [i for i in range(n_ranges) if at[i + 1] > at[i]]
    where = [slice(int(at[i]), int(at[i + 1])) for i in full]
    return full, where, [_pack(u[w]) for w in where]


class Merged:
    """A range's runs (run, counts), in order of their batch, all hashes one after the other.

    totals: of each hash its count in all runs; owner: whether a run is the first to count it;
    shared: whether several runs hold it; distinct and sums: the distinct hashes and their counts.
    """

    def __init__(self, t: pa.Table):
        keys = [_unpack(x.as_py()) for x in t.column("run")]
        self.sizes = [len(k) for k in keys]
        h = np.concatenate(keys)
        c = np.concatenate([counts_of(x.as_py(), n) for x, n in zip(t.column("counts"), self.sizes)])
        self._order = order = np.argsort(h, kind="stable")
        s, c = h[order], c[order]
        new = np.r_[True, s[1:] != s[:-1]]
        self._at = at = np.flatnonzero(new)
        self._group = group = np.cumsum(new) - 1
        self.distinct, self.sums = s[at], np.add.reduceat(c, at)
        before = np.cumsum(c) - c  # counts ahead of an entry; within its group none if it is the first to count
        self.totals = self._back(self.sums[group])
        self.owner = self._back((c > 0) & (before == before[at][group]))
        self.shared = self._back(np.diff(np.r_[at, len(h)])[group] > 1)

    def _back(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), x.dtype)
        out[self._order] = x
        return out

    def any(self, bits: np.ndarray) -> np.ndarray:
        """For each hash whether any run has the bit."""
        return self._back(np.logical_or.reduceat(bits[self._order], self._at)[self._group])

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum(self.sizes)[:-1])


def by_range(runs_of: DataFrame, n_ranges: int) -> DataFrame:
    return runs_of.repartition(max(int(runs_of.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_ranges), "order", "range")
