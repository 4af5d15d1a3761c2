"""Context-triggered piecewise hashing: fingerprints of texts, and how alike two of them are."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, ship
from lodestone.llm.hashing import Prefix, U

#: Bytes that the rolling hash sees, the smallest block size, and the most characters of a signature.
WINDOW, LEAST_BLOCK, MOST = 7, 3, 64
#: Neighbouring characters that two signatures share before they count as alike, and the longest run of one character.
COMMON, RUN = 4, 3
# fixed value: the alphabet of signatures
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROW = f"{FINGERPRINTS}, part long, edge string, text string"


def fingerprint(text: str | None) -> str:
    """`block:signature:signature at twice the block` of the whole text.

    A chunk ends where the rolling hash of the last WINDOW bytes plus 1 is divisible by the block
    size, so triggers of a block size are also those of its half. The block size is the smallest
    of 3, 6, 12, ... with fewer than MOST triggers; no signature is cut. Each chunk gives one of
    64 characters.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    prefix, ends, levels = Prefix(data), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) >= WINDOW:
        rolling = (prefix.windows(WINDOW) >> U(32)).astype(np.int64) + 1
        at = np.flatnonzero(rolling % LEAST_BLOCK == 0)
        value = rolling[at] // LEAST_BLOCK
        levels = np.log2(value & -value).astype(np.int64)
        ends = at + WINDOW
    more = np.cumsum(np.bincount(levels, minlength=1)[::-1])[::-1]  # triggers at each level and above
    level = int(np.searchsorted(-more, -MOST, side="right"))
    signatures = []
    for k in (level, level + 1):
        cut = ends[(levels >= k) & (ends < len(data))]
        marks = prefix.spans(np.concatenate([[0], cut]).astype(np.int64), np.append(cut, len(data)))
        signatures.append(_LETTERS[(marks >> U(58)).astype(np.int64)].tobytes().decode())
    return f"{LEAST_BLOCK << level}:{signatures[0]}:{signatures[1]}"


def _short_runs(signature: str) -> str:
    return "".join(c for i, c in enumerate(signature) if signature[i - RUN : i] != c * RUN or i < RUN)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 characters of one side at a time in the bits of a number."""
    at, full = {}, (1 << len(a)) - 1
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance, a replacement being a deletion and an insertion, by the total length."""
    a, b = _short_runs(a), _short_runs(b)
    if not a or not b:
        return 0.0
    size = min(COMMON, len(a), len(b))
    grams = {a[i : i + size] for i in range(len(a) - size + 1)}
    if not any(b[i : i + size] in grams for i in range(len(b) - size + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: of the signatures with the same block size, the pair that is more alike; 1 for equal fingerprints."""
    if x == y:
        return 1.0
    (n, *a), (m, *b) = x.split(":"), y.split(":")
    n, m = int(n), int(m)
    pairs = [(n << i, a[i], m << j, b[j]) for i in (0, 1) for j in (0, 1)]
    return max((_alike(s, t) for p, s, q, t in pairs if p == q), default=0.0)


def edited(text: str, following: str) -> str:
    """`text` with its second half replaced by as much of the start of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc, text: str, own: str, following: str, following_own: str) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_), likeness(own, following_own)


_KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], [c.split()[0] for c in ROW.split(", ")])


def _neighbours(batches):
    """Every row of a partition with the one after it; the first and the last text for the partitions beside it."""
    from pyspark import TaskContext

    part, before, out = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            own = fingerprint(text)
            if before is None:
                out.append((None,) * 7 + (part, "first", text))
            else:
                out.append(_compared(*before, text, own) + (part, None, None))
            before = doc, text, own
            if len(out) >= 1000:
                yield _rows(out)
                out = []
    if before is not None:
        out.append((before[0], *[None] * 6, part, "last", before[1]))
    yield _rows(out)


def _ends(batches):
    for batch in batches:
        out = []
        for doc, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            out.append(_compared(doc, text, fingerprint(text), following, fingerprint(following)) + (None,) * 3)
        yield _rows(out).select([c.split()[0] for c in FINGERPRINTS.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text of `docs` (doc_id, text; other columns are ignored) and its edited text.

    One row per row: doc_id, n_chars (code points), edited_sha256 (of the edited text), fingerprint,
    edited_fingerprint, near_edited (likeness of the two), near_next (likeness to the next document's
    fingerprint). The next document is by doc_id ascending, null first, then by the text's hash among
    rows with one id; after the last comes the first, so a lone document is its own next.

    Rows are dealt by ranges of (doc_id, hash, place in the input), so that many rows of one id, or
    many equal rows, are shared among tasks; each task streams its range in order, and only the
    partitions' first and last texts are joined afterwards. Null texts are empty; an empty text has
    no chunks and is alike only to another. Repeated rows follow one another. An empty table gives
    no rows. A very long text takes memory linear in its length.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", "hash", "place"]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = space.save(dealt.mapInArrow(_neighbours, ROW), "neighbours")
    names = [c.split()[0] for c in FINGERPRINTS.split(", ")]
    firsts = found.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    parts = sorted(r[0] for r in firsts.select("next_part").collect())  # numbers of partitions only
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next_part long")
    lasts = found.where("edge = 'last'").select("part", "doc_id", "text").join(following, "part").join(firsts, "next_part")
    return found.where("edge is null").select(names).union(lasts.select("doc_id", "text", "following").mapInArrow(_ends, FINGERPRINTS))
