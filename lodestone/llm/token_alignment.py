"""Alignment of two tokenizers by union-find over the graph of overlapping tokens."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, ship
from lodestone.llm.components import union
from lodestone.llm.tokens import _byte_names

#: An id pair is one number: the A id times 2^SHIFT, plus the B id.
SHIFT = 15
#: Pairs that are sent to every task: those with over one 500,000th of all counts, so at most as many.
HEAVY_PAIRS = 500_000
#: Pair counts that one task holds before it passes them on.
HELD_PAIRS = 2_000_000
ALIGNED = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"
_LOADED: dict[tuple, "Tokenizers"] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers and the bytes of their tokens.

    A's file is read here: its ids are in the order of its merges, so that they serve as the ranks
    of an equal, faster encoder; anything else in the file is refused.
    """

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names = {name: byte for byte, name in _byte_names().items()}
        vocabulary = sorted(model["vocab"], key=model["vocab"].get)
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if sorted(vocabulary[:256]) != sorted(names) or vocabulary[256:] != merged or model["vocab"][vocabulary[-1]] != len(vocabulary) - 1:
            raise ValueError(f"{path_a}: expected the 256 bytes, then one token a merge in order")
        self.bytes_a = [bytes(map(names.__getitem__, t)) for t in vocabulary]
        self.a = tiktoken.Encoding(path_a, pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a)}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_byte = [re.fullmatch(r"<0x([0-9A-F]{2})>", p) for p in pieces]
        self.bytes_b = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(as_byte, pieces)]
        if len(pieces) > 1 << SHIFT or len(vocabulary) > 1 << 32 - SHIFT:
            raise ValueError("vocabularies beyond 2^17 and 2^15 ids don't fit in one 32-bit number")
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text by A and B; none where the tokens' bytes are not those of a space and the text."""
        out = []
        for t, b in zip(texts, self.b.encode(texts, num_threads=1)):
            data, a = (" " + t).encode("utf-8", "surrogatepass"), self.a.encode_ordinary(" " + t)
            same = b"".join(map(self.bytes_a.__getitem__, a)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data
            out.append((a, b) if same else ([], []))
        return out


def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    """One pair of tokenizers for each worker process and pair of files."""
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


def align(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A position, B position) of overlapping tokens, and the group of each A and each B token.

    The sizes are in bytes and have the same sum. Between two neighbouring token ends lies one
    token of each side, and two tokens overlap in one such interval only, so intervals are links.
    Groups are the connected components of the links, numbered from 0 in byte order.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=0) > 0]
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    n = len(end_a)
    label = np.arange(n + len(end_b))
    union(label, at_a, n + at_b)
    # the smallest member of a component is an A token, and components follow one another
    group_a = np.cumsum(label[:n] == np.arange(n)) - 1
    return at_a, at_b, group_a, group_a[label[n:]]


_TEXT: list[bytes] = []


def group_marks(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[bytes]:
    """The parts of `a1,a2|b1;a3|b2,b3;`, one a token, groups in order."""
    if not _TEXT:
        _TEXT.extend(b"%d%c" % (i, c) for i in range(1 << 17) for c in b",|;")
    if not len(a):
        return []
    n = group_a[-1] + 1
    many_a, many_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    out = np.empty(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
    out[place_a] = a * 3 + (np.diff(group_a, append=n) > 0)
    out[place_b] = b * 3 + 2 * (np.diff(group_b, append=n) > 0)
    return list(map(_TEXT.__getitem__, out.tolist()))


def _aligned_rows(both: Tokenizers, texts: list[str]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256, codes, times of each text; one alignment for all, cut where texts end."""
    ids = both.encode(texts)
    n_a, n_b = (np.array([len(x[side]) for x in ids]) for side in (0, 1))
    a, b = (np.array(list(chain.from_iterable(x[side] for x in ids)), np.int64) for side in (0, 1))
    link_a, link_b, group_a, group_b = align(both.size_a[a], both.size_b[b])
    owner = np.repeat(np.arange(len(texts)), n_a)
    n_groups = np.bincount(owner[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=len(texts))
    n_links = np.bincount(owner[link_a], minlength=len(texts))
    pairs, times = np.unique(owner[link_a] << 32 | a[link_a] << SHIFT | b[link_b], return_counts=True)
    cuts = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1))
    codes, times = (pairs & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
    marks, ends = group_marks(a, b, group_a, group_b), np.concatenate([[0], np.cumsum(n_a + n_b)])
    sha = [hashlib.sha256(b"".join(marks[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]
    return [(int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i]), sha[i], codes[cuts[i] : cuts[i + 1]].tobytes(), times[cuts[i] : cuts[i + 1]].tobytes()) for i in range(len(texts))]


def _aligned(paths: tuple[str, str]):
    def run(batches):
        from pyspark import TaskContext

        both, row = tokenizers(paths), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 64):
                part = [t or "" for t in texts.slice(at, 64).to_pylist()]
                cols = [range(row, row + len(part)), *zip(*_aligned_rows(both, part))]
                row += len(part)
                kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
                arrays.insert(1, ids.slice(at, 64))
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ALIGNED.split(", ")])

    return run


def _totals(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([h[1] for h in held]), len(codes)).astype(np.int64)


def _counted(most: int):
    """Documents of each pair, summed in the task before they are dealt."""

    def run(batches):
        none = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        held, size = [none], 0

        def rows():
            codes, n = _totals(held)
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["code", "n"])

        for batch in batches:
            for codes in batch.column(0):
                codes = np.frombuffer(codes.as_py(), "<u4")
                held.append((codes, np.ones(len(codes))))
                size += len(codes)
                if size >= 2 * most:
                    held = [_totals(held)]
                    size = len(held[0][0])
                    if size >= most:
                        yield rows()
                        held, size = [none], 0
        yield rows()

    return run


def _split(heavy):
    """Which of a document's pairs are heavy, and where they stand among the heavy ones."""

    def of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = heavy.value[0]
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        return (known[at] == codes if len(known) else np.zeros(len(codes), bool)), at

    return of


def _heavy(heavy):
    of = _split(heavy)

    def run(batches):
        for batch in batches:
            best, total = [], []
            for codes, times in zip(batch.column("codes"), batch.column("times")):
                codes, times = np.frombuffer(codes.as_py(), "<u4"), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
                there, at = of(codes)
                at, times = at[there], times[there]
                total.append(int(heavy.value[1][at] @ times))
                best.append(int(heavy.value[2][at] @ times))
            out = batch.drop_columns(["codes", "times"])
            yield out.append_column("heavy_best", pa.array(best, pa.int64())).append_column("heavy_sum", pa.array(total, pa.int64()))

    return run


def _light(heavy):
    of = _split(heavy)

    def run(batches):
        for batch in batches:
            for row, codes, times in zip(batch.column("row_id").to_pylist(), batch.column("codes"), batch.column("times")):
                codes, times = np.frombuffer(codes.as_py(), "<u4"), np.frombuffer(times.as_py(), "<u4")
                rest = ~of(codes)[0]
                if rest.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rest.sum(), row)), pa.array(codes[rest].astype(np.int64)), pa.array(times[rest].astype(np.int64))], ["row_id", "code", "times"])

    return run


def align_tokens(docs: DataFrame, paths: tuple[str, str] | None = None, heavy_pairs: int = HEAVY_PAIRS, held_pairs: int = HELD_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Align tokenizers A and B on the texts of `docs` (doc_id, text; other columns are ignored).

    Returns (documents, pairs). Pairs: a_id, b_id, n (documents that hold the pair linked), best
    (n is the highest of the A id; ties included). Documents, one row each: doc_id, n_a, n_b,
    n_groups, n_links, n_best, count_sum, groups_sha256, as the links' pairs have them.

    Tokens of a text are nodes, overlapping ones are linked, and union-find gives the connected
    components, which are the minimal groups. A document's links are kept as sorted distinct pairs
    with how often each occurs. Pairs are counted in each task, then summed in Spark. The counts
    return to the documents in two ways: the at most `heavy_pairs` pairs with over that part of all
    counts are broadcast, all others are dealt by pair, of which none is then a hot key.

    Null and empty texts, and texts whose tokens don't give back their bytes (B turns U+2581 into
    a space), have zeros and an empty groups_sha256. Rows are independent: repeated rows and ids
    are counted each, null ids stay null. An empty table gives no rows. A very long text is one
    task's, in memory linear in its length.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "token-alignment")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = space.save(texts.mapInArrow(_aligned(paths or default_paths()), ALIGNED), "aligned")
    counts = aligned.select("codes").mapInArrow(_counted(held_pairs), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = space.save(counts.withColumn("a_id", F.shiftright("code", SHIFT)), "counts")
    top = counts.groupBy("a_id").agg(F.max("n").alias("top"))  # at most one row for each A id
    counts = counts.join(F.broadcast(top), "a_id").select("code", "a_id", F.col("code").bitwiseAND((1 << SHIFT) - 1).alias("b_id"), "n", (F.col("n") == F.col("top")).alias("best"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_heavy = F.col("n") * heavy_pairs > total
    known = counts.where(is_heavy).select("code", "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("code")
    heavy = spark.sparkContext.broadcast((known.column("code").to_numpy().astype("<u4"), known.column("n").to_numpy(), known.column("best").to_numpy()))
    columns = ALIGNED.removesuffix(", codes binary, times binary")
    rows = aligned.mapInArrow(_heavy(heavy), f"{columns}, heavy_best long, heavy_sum long")
    light = aligned.select("row_id", "codes", "times").mapInArrow(_light(heavy), "row_id long, code long, times long")
    light = light.join(counts.where(~is_heavy), "code").groupBy("row_id").agg(F.sum(F.expr("if(best, times, 0)")).alias("light_best"), F.sum(F.expr("n * times")).alias("light_sum"))
    rows = rows.join(light, "row_id", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.expr("heavy_best + coalesce(light_best, 0)").alias("n_best"), F.expr("heavy_sum + coalesce(light_sum, 0)").alias("count_sum"), "groups_sha256")
    return rows, counts.select("a_id", "b_id", "n", "best")
