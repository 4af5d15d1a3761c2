"""Exact removal of long repeated byte strings, by phrases of a content-defined parse."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, ship
from lodestone.llm.hashing import Prefix

LENGTH = 200
#: Bytes of the rolling hash whose minimum in a window is the window's trigger.
GRAM = 32
_RUNS = "m long, ph long, doc long, th int, start int, size int, own boolean"
_U = np.uint64


def _bytes(value) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def phrases(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Parse one text: trigger, phrase hash, first window, number of windows, own repeat.

    The trigger of a window of `length` bytes is the smallest rolling hash in it. Windows that
    follow one another with one trigger make a phrase; it reaches over the whole last window,
    so each window lies in exactly one phrase, and equal windows have equal triggers.
    """
    n = len(data) - length + 1
    if n <= 0:
        return None
    prefix = Prefix(data)
    h = prefix.windows(gram)
    width, low, size = length - gram + 1, h, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    end = np.concatenate([start[1:], [n]])
    trigger = low[start]
    # a trigger that stands at two places of the text may repeat a window inside one phrase
    values, counts = np.unique(h[np.isin(h, trigger)], return_counts=True)
    own = counts[np.searchsorted(values, trigger)] > 1
    return trigger, prefix.spans(start, end - 1 + length), start, end - start, own, prefix


def _parse(length: int, gram: int):
    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, th, text in zip(*b.columns):
                found = phrases(_bytes(text), length, gram)
                if found:
                    m, ph, start, size, own, _ = found
                    k = len(m)
                    for c, x in zip(cols, (m.view(np.int64), ph.view(np.int64), np.full(k, doc.as_py()), np.full(k, th.as_py(), np.int32), start.astype(np.int32), size.astype(np.int32), own)):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["m", "ph", "doc", "th", "start", "size", "own"])

    return run


def _classes(batches):
    """Rows by trigger and phrase: 1 the phrase occurs again; 2 look at each window; 3 look, as a partner."""
    carry, earlier = None, False
    prev_m = prev_ph = None

    def work(t: dict, more_m, more_ph):
        nonlocal prev_m, prev_ph, earlier
        m, ph = t["m"], t["ph"]
        n = len(m)
        pm, pp = np.empty(n, bool), np.empty(n, bool)
        pm[1:] = m[1:] == m[:-1]
        pp[1:] = pm[1:] & (ph[1:] == ph[:-1])
        pm[0] = prev_m is not None and m[0] == prev_m
        pp[0] = bool(pm[0]) and ph[0] == prev_ph
        nm, np_ = np.empty(n, bool), np.empty(n, bool)
        nm[:-1], np_[:-1] = pm[1:], pp[1:]
        nm[-1] = more_m is not None and m[-1] == more_m
        np_[-1] = bool(nm[-1]) and ph[-1] == more_ph
        # whether another phrase of the same trigger came before this row's phrase
        new_class = ~pp
        flag = np.zeros(n, bool)
        flag[new_class] = pm[new_class]
        at = np.maximum.accumulate(np.where(new_class, np.arange(n), -1))
        before = np.where(at >= 0, flag[np.maximum(at, 0)], earlier)
        dup = pp | np_
        last = dup & ~np_
        prev_m, prev_ph, earlier = m[-1], ph[-1], bool(before[-1])
        kinds = [(dup, 1), (~dup & (pm | nm | t["own"]), 2), (last & (before | nm), 3)]
        for keep, kind in kinds:
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(t[c][keep]) for c in ("doc", "th", "start", "size")] + [pa.array(np.full(int(keep.sum()), kind, np.int32))], ["doc", "th", "start", "size", "kind"])

    for b in batches:
        t = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("m", "ph", "doc", "th", "start", "size", "own")}
        if not b.num_rows:
            continue
        if carry is not None:
            t = {c: np.concatenate([carry[c], t[c]]) for c in t}
        carry = {c: x[-1:] for c, x in t.items()}
        if len(t["m"]) > 1:
            yield from work({c: x[:-1] for c, x in t.items()}, t["m"][-1], t["ph"][-1])
    if carry is not None:
        yield from work(carry, None, None)


def _windows(length: int):
    """Hashes of the windows that have to be looked at one by one."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            ends, start, size, kind = _flat(b.column("spans"), "start", "size", "kind")
            for k, (doc, th, text) in enumerate(zip(*b.columns[:3])):
                prefix = Prefix(_bytes(text))
                hashes = prefix.windows(length).view(np.int64)
                own = slice(ends[k], ends[k + 1])
                n = size[own].astype(np.int64)
                first = np.cumsum(n) - n
                at = np.arange(int(n.sum())) + np.repeat(start[own] - first, n)  # the windows of all spans, one after another
                partner = np.repeat(kind[own] == 3, n)
                for c, x in zip(cols, (hashes[at], np.full(len(at), doc.as_py()), np.full(len(at), th.as_py(), np.int32), np.where(partner, -1 - at, at).astype(np.int32))):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["wh", "doc", "th", "at"])

    return run


def _flat(spans: pa.ListArray, *fields: str) -> tuple[np.ndarray, ...]:
    """Ends of the rows' lists of structs, and the fields of all of them."""
    return spans.offsets.to_numpy(), *(spans.values.field(f).to_numpy() for f in fields)


def _repeats(batches):
    """Windows, sorted by hash, that stand next to an equal one."""
    carry, prev = None, None

    def work(t, more):
        nonlocal prev
        wh = t["wh"]
        same = np.zeros(len(wh), bool)
        same[1:] |= wh[1:] == wh[:-1]
        same[:-1] |= wh[1:] == wh[:-1]
        same[0] |= prev is not None and wh[0] == prev
        same[-1] |= more is not None and wh[-1] == more
        prev = wh[-1]
        same &= t["at"] >= 0
        if same.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[c][same]) for c in ("doc", "th", "at")], ["doc", "th", "at"])

    for b in batches:
        if not b.num_rows:
            continue
        t = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("wh", "doc", "th", "at")}
        if carry is not None:
            t = {c: np.concatenate([carry[c], t[c]]) for c in t}
        carry = {c: x[-1:] for c, x in t.items()}
        if len(t["wh"]) > 1:
            yield from work({c: x[:-1] for c, x in t.items()}, t["wh"][-1])
    if carry is not None:
        yield from work(carry, None)


def _cut(length: int):
    """Remove what the repeated windows cover."""

    def run(batches):
        for b in batches:
            rows = []
            ends, start, size = _flat(b.column("spans"), "start", "size")
            for k, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"))):
                raw = _bytes(text)
                drop = np.zeros(len(raw) + 1, np.int32)
                own = slice(ends[k], ends[k + 1])
                np.add.at(drop, start[own], 1)
                np.subtract.at(drop, start[own] + size[own] - 1 + length, 1)
                gone = np.cumsum(drop[:-1]) > 0
                runs = int((np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1).sum())
                kept = raw[~gone].tobytes()
                rows.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which also starts anywhere else.

    Takes doc_id, text. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text
    (a character that is cut in two becomes U+FFFD there; the digest is of the bytes).

    Texts are parsed into phrases at rolling-hash triggers (see phrases()). The dictionary of
    distinct phrases and their number of occurrences in the parse come from one shuffle of the
    phrases by trigger: all windows of a phrase that occurs again repeat. Because a phrase reaches
    `length` bytes past its last window, order to that depth follows from the dictionary alone.
    Only the windows of phrases that share their trigger with another phrase are compared one by
    one, each distinct phrase once. Rows of a trigger or window are read as a sorted stream,
    so a frequent one needs no memory. Equality is of 64-bit hashes: of phrases among those of
    one trigger, of windows among all that are compared.

    Null texts are empty. Rows with the same doc_id and text repeat each other wholly; a null
    doc_id is kept. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "repeats")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.hash(F.col("text").cast("string"), F.lit(7)).alias("th"), F.col("text").cast("string").alias("text"))
    runs = keyed.select("doc", "th", "text").mapInArrow(_parse(length, gram), _RUNS)
    found = space.save(runs.repartition("m").sortWithinPartitions("m", "ph").mapInArrow(_classes, "doc long, th int, start int, size int, kind int"), "phrases")
    spans = lambda df: df.groupBy("doc", "th").agg(F.collect_set(F.struct(*[c for c in ("start", "size", "kind") if c in df.columns])).alias("spans"))
    look = spans(found.where("kind >= 2"))
    wh = keyed.join(look, ["doc", "th"]).select("doc", "th", "text", "spans").mapInArrow(_windows(length), "wh long, doc long, th int, at int")
    single = space.save(wh.repartition("wh").sortWithinPartitions("wh").mapInArrow(_repeats, "doc long, th int, at int"), "windows")
    covered = spans(found.where("kind = 1").select("doc", "th", "start", "size").union(single.select("doc", "th", F.col("at").alias("start"), F.lit(1).alias("size"))))
    return keyed.join(covered, ["doc", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
