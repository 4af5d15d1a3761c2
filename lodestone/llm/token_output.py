"""Training-order materialisation: a keyed permutation gives every sequence a global slot."""

from __future__ import annotations

import hashlib
import os
import zlib
from pathlib import PurePosixPath
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.llm.common import Workspace, ship

LENGTH = 2048
END_ID = 1
PAD_ID = 0
#: Sequences in one shard file: 32 MB at 2,048 ids of two bytes.
SHARD_SEQUENCES = 8192
ROUNDS = 6


class Permutation:
    """A Feistel network over the numbers below n, by cycle-walking from the next power of four."""

    def __init__(self, n: int, key: bytes):
        self.n, self.half = n, max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(key + bytes([r]), digest_size=8).digest(), "little")) for r in range(ROUNDS)]
        self.mask = np.uint64((1 << self.half) - 1)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out, todo = np.asarray(x, np.uint64).copy(), np.arange(len(x))
        while len(todo):
            out[todo] = step(out[todo])
            todo = todo[out[todo] >= self.n]
        return out

    def _forth(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            left, right = right, left ^ self._mix(right, k)
        return left << np.uint64(self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ self._mix(left, k), left
        return left << np.uint64(self.half) | right

    def slots(self, index: np.ndarray) -> np.ndarray:
        """The slot of each sequence index."""
        return self._walk(index, self._forth)

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        """The sequence index at each slot: the inverse, for resuming anywhere."""
        return self._walk(slot, self._back)


def _codec():
    """Compression of sequences on their way: less to shuffle and to keep."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress


def _sequences(path: str, length: int):
    def run(batches):
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), tokens.encoder(path), np.array([END_ID], "<u2")
        squeeze = _codec()[0]
        kept, size, local = [], 0, 0

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal kept, size, local
            flat = np.concatenate(kept) if kept else np.zeros(0, "<u2")
            n = len(flat) if last else len(flat) // length * length
            cuts = [flat[i : i + length] for i in range(0, n, length)]
            kept, size = [flat[n:]], len(flat) - n
            padded = [np.concatenate([c, np.full(length - len(c), PAD_ID, "<u2")]) for c in cuts]
            local += len(cuts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cuts), pa.int64()), pa.array(range(local - len(cuts), local), pa.int64()), pa.array(map(len, cuts), pa.int64()), pa.array([squeeze(x.tobytes()) for x in padded], pa.binary())],
                ["part", "local", "n_tokens", "data"],
            )

        for batch in batches:
            for text in batch.column(0):
                kept += [enc.encode(text.as_py()), end]
                size += len(kept[-2]) + 1
                if size >= 256 * length:
                    yield rows(False)
        yield rows(True)

    return run


def _slots(starts: dict[int, int], n: int, key: bytes, per_shard: int):
    def run(batches):
        order = Permutation(n, key)
        for b in batches:
            index = np.array([starts[p] for p in b.column("part").to_pylist()], np.int64) + b.column("local").to_numpy()
            slot = order.slots(index).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), pa.array(index), b.column("n_tokens"), b.column("data")], ["shard", "slot", "sequence", "n_tokens", "data"])

    return run


class _File:
    """A file that appears under its name only when it is whole; a retried task writes it anew."""

    def __init__(self, uri: str, attempt: int):
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        self.name = parsed.path if self.local else uri
        if self.local:
            os.makedirs(PurePosixPath(self.name).parent, exist_ok=True)
            self.tmp = f"{self.name}.{attempt}.tmp"
            self.out = open(self.tmp, "wb")
        else:
            from pyarrow import fs

            self.fs, path = fs.FileSystem.from_uri(uri)
            self.tmp, self.name = f"{path}.{attempt}.tmp", path
            self.out = self.fs.open_output_stream(self.tmp)

    def close(self) -> None:
        self.out.close()
        if self.local:
            os.replace(self.tmp, self.name)
        else:
            self.fs.move(self.tmp, self.name)


def _write(root: str, per_shard: int, length: int):
    def run(batches):
        from pyspark import TaskContext

        attempt, shard, out = TaskContext.get().taskAttemptId(), None, None
        expand = _codec()[1]
        for b in batches:
            data = [expand(x.as_py()) for x in b.column("data")]
            for s, one in zip(b.column("shard").to_pylist(), data):
                if s != shard:
                    if out:
                        out.close()
                    shard, out = s, _File(f"{root}/shard-{s:08d}.bin", attempt)
                out.out.write(one)
            slot = b.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column("sequence"), b.column("slot"), b.column("shard"), pa.array(slot % per_shard * length * 2), b.column("n_tokens"), pa.array(map(zlib.crc32, data), pa.int64())],
                ["sequence", "slot", "shard", "byte_offset", "n_tokens", "crc32"],
            )
        if out:
            out.close()

    return run


def materialise(docs: DataFrame, key: str, root: str | None = None, path: str | None = None, length: int = LENGTH, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """Write the texts of `docs` as token sequences in training order; one row per sequence.

    Every partition's documents follow one another, each closed by the end id, and are cut into
    sequences of `length` ids; a partition's last one is padded. Sequences are numbered over all
    partitions and a keyed Feistel permutation over exactly that many numbers gives each its
    slot. Shard s holds the slots from s * per_shard on, `length` little-endian 16-bit ids
    each, so slot t lies at byte (t mod per_shard) * 2 * length of its shard and any reader can
    resume anywhere. Shards go to `root` (default: in the shared folder) under a temporary name
    first. Only the numbers of sequences per partition come to the driver (two numbers a
    partition). Sequences travel compressed and are sorted by slot; each shard is one partition.

    Rows: sequence, slot, shard, byte_offset, n_tokens, crc32 (of the record's bytes). Null and
    empty texts are the end id alone; repeated rows are written each; an empty table writes no
    shard; other columns than text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "token-output")
    root = root or f"{space.root}/shards"
    made = space.save(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_sequences(path or tokens.default_path(), length), "part long, local long, n_tokens long, data binary"), "sequences")
    starts, n = {}, 0
    for part, count in sorted(tuple(r) for r in made.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts[part], n = n, n + count
    placed = made.mapInArrow(_slots(starts, n, key.encode(), per_shard), "shard long, slot long, sequence long, n_tokens long, data binary")
    dealt = placed.repartitionById(max(1, -(-n // per_shard)), F.col("shard").cast("int")).sortWithinPartitions("slot")
    return space.save(dealt.mapInArrow(_write(root, per_shard, length), "sequence long, slot long, shard long, byte_offset long, n_tokens long, crc32 long"), "written")


def read_shard(uri: str, first: int = 0, count: int | None = None, length: int = LENGTH) -> np.ndarray:
    """Records of one shard from `first` on."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri)
    with found.open_input_file(path) as f:
        f.seek(first * length * 2)
        data = f.read(None if count is None else count * length * 2)
    return np.frombuffer(data, "<u2").reshape(-1, length)
