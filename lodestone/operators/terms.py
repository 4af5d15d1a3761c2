"""Terms of texts counted inside tasks, as 64-bit hashes: no row a term leaves a task before it is needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms gathered before a task passes them on.
HELD = 2_000_000
#: Smallest number of characters and largest of grams.
SIZES = (3, 4, 5)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def word_hashes(tokens: np.ndarray, gap: int) -> np.ndarray:
    """Unigrams and bigrams of token hashes; `gap` parts texts."""
    real = tokens != gap
    t = tokens.view(np.uint64)
    both = (_mix(t[:-1] + _A) * _A + t[1:])[real[:-1] & real[1:]]
    return np.concatenate([t[real], _mix(both)]).view(np.int64)


def char_hashes(text: str) -> np.ndarray:
    """3- to 5-character grams inside the space-padded words of a text whose words lie one space apart."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank, out, h = c == 32, [], _mix(c + _A)
    inner = ~blank
    rolled, clear = h[:-1] * _A + c[1:], np.ones(max(len(c) - 1, 0), bool)
    for n in SIZES:
        if len(c) < n:
            break
        rolled = _mix(rolled[:-1] + _A) * _A + c[n - 1 :]  # the hash of n characters from that of the n - 1 first
        clear = clear[:-1] & inner[n - 2 : -1]  # no blank but at the ends
        out.append(_mix(rolled[clear] + np.uint64(n)))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _tokens(df: DataFrame, key: str, analyzer: str, pattern: str) -> tuple[DataFrame, int]:
    """(key, t): hashes of a text's tokens, or its words, and the number of rows; rows with one key are one text, whose parts share no bigram."""
    n, distinct = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n != distinct:
        df = df.groupBy(key).agg(F.collect_list("text").alias("texts"))
    else:
        df = df.select(key, F.array_compact(F.array("text")).alias("texts"))
    if analyzer == "word":
        found = F.transform("texts", lambda x: F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))))
        return df.select(key, F.transform(F.flatten(found), lambda x: F.xxhash64(x)).alias("t")), n
    plain = F.transform("texts", lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    return df.select(key, F.array_join(F.filter(plain, lambda x: x != ""), " ").alias("t")), n


def counter(analyzer: str, gap: int):
    """Generator of (place, terms, counts) of a batch's rows."""

    def run(batch: pa.RecordBatch):
        column = batch.column(1)
        if analyzer == "char":
            for i, text in enumerate(column):
                text = text.as_py()
                yield i, *np.unique(char_hashes(text) if text else np.empty(0, np.int64), return_counts=True)
            return
        ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for i in range(len(column)):
            yield i, *np.unique(word_hashes(values[ends[i] : ends[i + 1]], gap), return_counts=True)

    return run


def sublinear_tf(n: np.ndarray) -> np.ndarray:
    return 1 + np.log(n)


def plain_tf(n: np.ndarray) -> np.ndarray:
    return n.astype(float)


class Texts:
    """The terms of texts (key, text), counted anew in each scan."""

    def __init__(self, df: DataFrame, key: str, analyzer: str, pattern: str, sublinear: bool):
        self.key, self.tf = key, sublinear_tf if sublinear else plain_tf
        self.tokens, self.count = _tokens(df.select(key, "text"), key, analyzer, pattern)
        self.kind = dict(self.tokens.dtypes)[key]
        gap = df.sparkSession.range(1).select(F.xxhash64(F.lit(""))).first()[0]
        self.rows = counter(analyzer, gap)

    def scan(self, make, schema: str) -> DataFrame:
        """`make`(rows of a batch) yields columns after the key: (places, *arrays); passed on HELD values at a time."""
        rows, key = self.rows, self.key

        def flush(batch, parts):
            columns = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *map(pa.array, columns[1:])], names)

        names = [key, *(x.split()[0] for x in schema.split(", "))]

        def run(batches):
            for batch in batches:
                parts, held = [], 0
                for part in make(rows(batch)):
                    parts.append(part)
                    held += len(part[0])
                    if held >= HELD:
                        yield flush(batch, parts)
                        parts, held = [], 0
                if held:
                    yield flush(batch, parts)

        return self.tokens.mapInArrow(run, f"{key} {self.kind}, {schema}")

    def gathered(self, make, schema: str, start) -> DataFrame:
        """As `scan`, but `make`(rows of a batch, keeper) hands its columns to the task's keeper (`start`()), which says when rows are passed on."""
        rows, key = self.rows, self.key
        names = [key, *(x.split()[0] for x in schema.split(", "))]

        def run(batches):
            keeper, ids, before = start(), [], 0

            def passed(columns):
                known = pa.chunked_array(ids).take(pa.array(columns[0])).combine_chunks()
                return pa.RecordBatch.from_arrays([known, *map(pa.array, columns[1:])], names)

            for batch in batches:
                make(((before + i, *rest) for i, *rest in rows(batch)), keeper)
                ids.append(batch.column(0))
                before += len(batch)
                if (found := keeper.take(False)) is not None:
                    yield passed(found)
            if (found := keeper.take(True)) is not None:
                yield passed(found)

        return self.tokens.mapInArrow(run, f"{key} {self.kind}, {schema}")

    def counted(self) -> DataFrame:
        """(key, term, tf)."""

        def make(rows):
            for i, terms, n in rows:
                yield np.full(len(terms), i), terms, n

        return self.scan(make, "term long, tf long")

    def frequencies(self) -> DataFrame:
        """(term, df, total): parts of a term's number of texts and of times, summed for some texts at a time."""
        rows = self.rows

        def add(found):
            terms, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.bincount(at, minlength=len(terms))), pa.array(np.bincount(at, np.concatenate([n for _, n in found]), len(terms)).astype(np.int64))], ["term", "df", "total"])

        def run(batches):
            found, held = [], 0
            for batch in batches:
                for _, terms, n in rows(batch):
                    found.append((terms, n))
                    held += len(terms)
                    if held >= HELD:
                        yield add(found)
                        found, held = [], 0
            if held:
                yield add(found)

        return self.tokens.mapInArrow(run, "term long, df long, total long")
