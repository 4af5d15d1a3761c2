"""Bounded-space online packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.llm.common import Workspace, lean, ship

LENGTH = 2048
OPEN_WINDOWS = 16
END_ID = 1
#: Groups of partitions, each of which leaves less than one sequence for the next level.
FAN_IN = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = f"{PIECE}, part long, ids binary"


class Packer:
    """A fixed number of open windows; items go to the best fit, the fullest is closed."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.next_id = length, first_id
        self.open = [self._new() for _ in range(windows)]

    def _new(self) -> list:
        self.next_id += 1
        return [self.next_id - 1, 0, []]

    def _put(self, w: list, doc, start: int, ids: np.ndarray, total: int) -> None:
        w[2].append((doc, start, ids, total, w[0], w[1]))
        w[1] += len(ids)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        """Place one item; yields the pieces of windows that became full."""
        at, n = 0, len(ids)
        while at < n:
            if n - at >= self.length:  # a sequence of its own
                yield doc, start + at, ids[at : at + self.length], total, self.next_id, 0
                self.next_id += 1
                at += self.length
                continue
            fits = [w for w in self.open if self.length - w[1] >= n - at]
            w = max(fits or self.open, key=lambda w: w[1])  # best fit, or else the fullest
            take = min(n - at, self.length - w[1])
            self._put(w, doc, start + at, ids[at : at + take], total)
            at += take
            if w[1] == self.length:
                yield from w[2]
                w[:] = self._new()

    def rest(self) -> Iterator[tuple]:
        for w in self.open:
            yield from w[2]


def _rows(pieces: list[tuple], part: int, keep: bool) -> pa.RecordBatch:
    cols = list(zip(*pieces)) or [()] * 6
    ids = cols[2]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cols[0], pa.int64()),
            pa.array(cols[1], pa.int64()),
            pa.array(map(len, ids), pa.int64()),
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            pa.array(cols[3], pa.int64()),
            pa.array(cols[4], pa.int64()),
            pa.array(cols[5], pa.int64()),
            pa.array([part if keep else None] * len(ids), pa.int64()),
            pa.array([x.tobytes() if keep else None for x in ids], pa.binary()),
        ],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"],
    )


def _first(path: str, length: int, windows: int):
    @lean
    def run(batches):
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), tokens.encoder(path), np.array([END_ID], "<u2")
        packer, out = Packer(length, windows, part << 32), []
        try:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.concatenate([enc.encode(text.as_py()), end])
                    out.extend(packer.add(doc, 0, ids, len(ids)))
                    if len(out) >= 2000:
                        yield _rows(out, part, False)
                        out = []
            yield _rows(out, part, False)
            yield _rows(list(packer.rest()), part, True)
        finally:
            tokens.release()  # workers are reused: an idle one would keep the encoder and its words

    return run


def _lay(rows: list[dict], sizes: list[int], first_id: int) -> tuple[list[tuple], list[tuple]]:
    """Lay items one after another into sequences of these sizes; also what is left over."""
    out, rest, k, at = [], [], 0, 0
    for r in rows:
        ids, start = np.frombuffer(r["ids"], "<u2"), r["start"]
        while len(ids):
            if k == len(sizes):
                rest.append((r["doc_id"], start, ids, r["doc_tokens"], first_id + k, at))
                at += len(ids)
                break
            take = min(len(ids), sizes[k] - at)
            out.append((r["doc_id"], start, ids[:take], r["doc_tokens"], first_id + k, at))
            ids, start, at = ids[take:], start + take, at + take
            if at == sizes[k]:
                k, at = k + 1, 0
    return out, rest


def _merge(level: int, length: int, last: bool):
    """One group's leftovers in full sequences; what remains is one item run, or powers of two."""

    def run(batch: pa.Table) -> pa.Table:
        group = batch.column("grp")[0].as_py()
        rows = sorted(batch.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
        full, tail = divmod(sum(len(r["ids"]) // 2 for r in rows), length)
        sizes = [length] * full + [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1 and last]
        out, rest = _lay(rows, sizes, (level << 56) + (group << 24))
        return pa.Table.from_batches([_rows(out, group, False), _rows(rest, group, True)])

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack the texts of `docs` (doc_id, text; other columns are ignored) into sequences.

    A document's ids are those of the tokenizer at `path` and the end id. Each partition keeps
    `windows` open windows: an item goes whole into the window that it fits best; when none has
    room the fullest window takes what it can hold and is emitted, full. What remains open in
    the partitions is merged, FAN_IN partitions at a time, until one window is left; its ids
    become sequences whose lengths are powers of two, so nothing is padded.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null and empty texts are the end id alone; rows with a null doc_id are packed under null;
    repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
    Memory is bounded by the open windows and one document. Partitions are read in file order,
    so a recomputed task gives the same rows. The pieces are written once to the shared folder:
    tokenising is the cost, and the leftovers are read from there.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "packing")
    first = space.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_first(path or tokens.default_path(), length, windows), SCHEMA), "pieces")
    done, left, level = first.where("ids is null").select(*_names()), first.where("ids is not null"), 0
    top = left.agg(F.max("part")).first()[0]
    while top is not None:
        level, last = level + 1, top < FAN_IN
        merged = space.save(left.withColumn("grp", F.floor(F.col("part") / FAN_IN)).groupBy("grp").applyInArrow(_merge(level, length, last), SCHEMA), f"level{level}")
        done = done.unionByName(merged.where("ids is null").select(*_names()))
        left, top = merged.where("ids is not null"), None if last else top // FAN_IN
    return done


def _names() -> list[str]:
    return [c.split()[0] for c in PIECE.split(", ")]
