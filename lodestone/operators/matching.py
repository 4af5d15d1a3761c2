"""Which texts contain which passages, without comparing all pairs."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbouring words that make a passage's key.
WORDS = 3
#: Passages that may be sent to the tasks; more are joined.
BROADCAST_ROWS = 100_000


def _words(c: Column) -> Column:
    return F.split(c, " ", -1)


def _inside(sent, names: list[str]):
    """Pairs of a task's texts and the passages that they contain: only passages whose run a text holds are looked for."""

    def run(batches):
        by_run, short = defaultdict(list), []
        for place, text in enumerate(sent.value.column(1).to_pylist()):
            words = text.split(" ")
            (by_run[tuple(words[1 : 1 + WORDS])] if len(words) >= WORDS + 2 else short).append((place, text))
        for batch in batches:
            rows, places = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                words = text.split(" ")[1:-1]
                runs = by_run.keys() & set(zip(*(words[k:] for k in range(WORDS))))
                for some in (short, *map(by_run.get, runs)):
                    found = [place for place, passage in some if passage in text]
                    rows += [row] * len(found)
                    places += found
            ids = sent.value.column(0).combine_chunks().take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, batch.column(0).take(pa.array(rows, pa.int64()))], names)

    return run


def containing(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, article_id) of texts (article_id, text) that contain a passage (query_id, text).

    The first and last word of a passage may be part of a longer one in the text, those between
    are the text's own: a run of WORDS of them is joined with the texts' runs, and the pairs that
    come out are compared in full. Passages with fewer words between are compared with all texts.
    While the passages are few, they are sent to the tasks, and no text or run leaves a task.
    """
    asked = passages.where("text is not null").select("query_id", "text")
    if asked.count() <= BROADCAST_ROWS:
        kind = {**dict(passages.dtypes), **dict(texts.dtypes)}
        sent = texts.sparkSession.sparkContext.broadcast(asked.toArrow())
        return texts.select("article_id", "text").mapInArrow(_inside(sent, ["query_id", "article_id"]), f"query_id {kind['query_id']}, article_id {kind['article_id']}")
    keyed = passages.where("text is not null").select("query_id", F.col("text").alias("q"), F.slice(_words(F.col("text")), 2, WORDS).alias("run"), F.size(_words(F.col("text"))).alias("n")).persist()
    long = keyed.where(f"n >= {WORDS + 2}").select("query_id", F.xxhash64("run").alias("key"))
    words = texts.select("article_id", _words(F.col("text")).alias("w")).where(f"size(w) >= {WORDS + 2}")
    runs = words.select("article_id", F.explode(F.expr("zip_with(zip_with(slice(w, 2, size(w) - 3), slice(w, 3, size(w) - 3), (a, b) -> struct(a, b)), slice(w, 4, size(w) - 3), (p, c) -> array(p.a, p.b, c))")).alias("run"))
    pairs = runs.select("article_id", F.xxhash64("run").alias("key")).join(long, "key").select("query_id", "article_id").distinct()
    found = pairs.join(keyed.where(f"n >= {WORDS + 2}").select("query_id", "q"), "query_id").join(texts.select("article_id", "text"), "article_id").where(F.contains("text", "q")).select("query_id", "article_id")
    short = keyed.where(f"n < {WORDS + 2}").select("query_id", "q")
    if short.isEmpty():
        return found
    return found.unionByName(texts.join(short, F.contains("text", "q")).select("query_id", "article_id"))
