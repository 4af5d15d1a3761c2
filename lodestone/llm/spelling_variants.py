"""Spelling variants: one-edit pairs of a corpus's words by errata tries, as relations."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, ship

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
ERROR_EVERY = 199
#: Words that one task counts before it passes them on.
HELD_WORDS = 300_000
#: Trie nodes that are sent to every task: those with over one 50,000th of all prefixes, so at most as many.
HEAVY_NODES = 50_000
_RUNS = re.compile("[a-zÀ-ÿ]+").findall


def _runs(every: int, least: int, most: int):
    def run(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                salt = zlib.crc32(f"{doc if doc is not None else 'null'}:".encode())
                own = Counter(_RUNS(text.encode("utf-8", "replace").lower().decode()))  # bytes lower A-Z alone
                for word, n in own.items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.encode(), salt)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= most:
                    yield rows()
                    held.clear()
        yield rows()

    return run


def count_words(docs: DataFrame, error_every: int = ERROR_EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least `least_length` code points that occur `least_count` times.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; a run whose hash
    with its document is divisible by `error_every` loses one code point. Each task sums its own
    words before they are dealt, so a frequent word is no hot key.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_runs(error_every, least_length, HELD_WORDS), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _light_edges(words: DataFrame, space: Workspace, heavy_nodes: int) -> DataFrame:
    """(word, n, p, s, h): each light edge on a word's path, as what stands before and from it, and the heavy child.

    A word ends with `$`, which is a child like others. Of a node's children the one with most words
    is heavy, so no word has over log2(number of words) light edges, and light subtrees alone are
    entered again (small to large).
    """
    paths = words.select("word", "n", F.expr("explode(sequence(0, length(word)))").alias("i"))
    paths = paths.select("word", "n", F.expr("substring(word, 1, i)").alias("p"), F.expr("substring(concat(word, '$'), i + 1)").alias("s"))
    edges = paths.groupBy("p", F.expr("left(s, 1)").alias("c")).agg(F.count("*").alias("size"))
    nodes = edges.groupBy("p").agg(F.count("*").alias("children"), F.sum("size").alias("size"), F.max_by("c", F.struct("size", "c")).alias("h")).where("children > 1")
    nodes = space.save(nodes.select("p", "h", "size"), "nodes")
    total = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    is_heavy = F.col("size") * heavy_nodes > total
    big, small = nodes.where(is_heavy).select("p", "h"), nodes.where(~is_heavy).select("p", "h")
    seen = paths.join(F.broadcast(big), "p", "left")
    near = seen.where("h is not null").select("word", "n", "p", "s", "h")
    far = seen.where("h is null").drop("h").join(small, "p").select("word", "n", "p", "s", "h")
    return near.union(far).where("left(s, 1) <> h")


def near_words(words: DataFrame, heavy_nodes: int = HEAVY_NODES) -> DataFrame:
    """(word, n_near, form, form_n) for words (word, n) with a near word, the form being its most frequent one.

    Errata tries: at a node p with heavy child h, each word p c s in a light subtree is entered
    again in three ways, and where terminals coincide there is a pair:
    with c skipped, p s; with c replaced, by any (an entry of p with a gap, shared by light
    subtrees) or by h; with h put before it, p h c s. A pair is found once, at the node where its
    words part. A gap's entry has at most one word for each letter, so neighbours are summed
    within it (number, two most frequent) and pairs within it are not emitted.
    """
    space = Workspace(words.sparkSession, "near-words")
    light = space.save(_light_edges(words, space, heavy_nodes), "light")
    gaps = light.where("s <> '$'").select("word", "n", F.expr("concat(p, '*', substring(s, 2))").alias("gap"))
    gaps = gaps.groupBy("gap").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "word"))).alias("all")).where("size(all) > 1")
    gaps = gaps.select(F.explode("all").alias("own"), "all").select("own.word", F.expr("size(all) - 1L").alias("k"), F.expr("if(all[0].word = own.word, all[1], all[0])").alias("best"))
    entries = "explode(array(if(s <> '$' and substring(s, 1, 1) <> substring(s, 2, 1), concat(p, substring(s, 2)), null), if(s <> '$' and h <> '$', concat(p, h, substring(s, 2)), null), if(h <> '$', concat(p, h, s), null)))"
    looked = light.select("word", "n", F.expr(entries).alias("entry")).where("entry is not null").withColumn("entry", F.rtrim("entry", F.lit("$")))
    pairs = looked.where(F.length("entry") > 0).join(words.select(F.col("word").alias("entry"), F.col("n").alias("m")), "entry")
    pairs = pairs.select(F.explode(F.array(F.struct("word", F.struct((-F.col("m")).alias("minus_n"), F.col("entry").alias("word")).alias("best")), F.struct(F.col("entry").alias("word"), F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word")).alias("best")))).alias("r"))
    pairs = pairs.select("r.word", F.lit(1).cast("long").alias("k"), "r.best")
    return gaps.union(pairs).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus_n")).alias("form_n"))


def spelling_variants(docs: DataFrame, error_every: int = ERROR_EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, heavy_nodes: int = HEAVY_NODES) -> DataFrame:
    """Group the words of `docs` (doc_id, text; other columns are ignored) with their usual spelling.

    One row per word: word, n, n_near (words that differ by one inserted, deleted or replaced code
    point), form (the most frequent near word, ties by code points, where it is at least `ratio`
    times as frequent; else null), form_n, root (the last form that forms lead to; the word itself
    if none). Counts grow by `ratio` from form to form, so chains are short and are followed by
    doubling a known number of times.

    Null and empty texts have no words; an id that is null counts as the text `null` in the hash;
    repeated rows count each; an empty table gives no rows. A very long text is counted by one task
    in memory linear in its distinct words.
    """
    space = Workspace(docs.sparkSession, "spelling")
    words = space.save(count_words(docs, error_every, least_length, least_count), "words")
    near = near_words(words, heavy_nodes)
    found = words.join(near, "word", "left").withColumn("has", F.expr(f"coalesce(form_n >= {ratio} * n, false)"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("if(has, form, null)").alias("form"), F.expr("if(has, form_n, null)").alias("form_n"))
    found = space.save(found, "forms")
    steps = space.save(found.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    most = found.agg(F.max("n")).first()[0] or 1
    longest = math.log(max(1, most / least_count), ratio) + 1  # forms on one chain
    for _ in range(math.ceil(math.log2(longest))):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("last"))
        steps = space.save(steps.join(onward, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "steps")
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
