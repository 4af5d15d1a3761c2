"""Quality rules: plain counts, then a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, Workspace, let, words

#: Buckets of hashed unigrams, and of hashed bigrams: the size of the model.
BUCKETS = (1 << 18, 1 << 16)
#: Bound of the sample of trusted documents that the target multinomial is fitted on.
TARGET_DOCS = 20_000
#: Added to every bucket's count.
PRIOR = 1.0
#: Log ratios are whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Documents whose mean log ratio is below this are not kept.
THRESHOLD = -0.6
#: Nor are those with a unigram whose log ratio is below this: one that is 27 times rarer in the target than in the
#: raw corpus, with at least so many expected, as terms of abuse are.
PEAK = -3.3
#: Low bits of a window's key that give way to its place, so that numbers are sorted.
PLACES = (1 << 20) - 1
SYMBOLS = "#*$%&|<>"
#: Single characters first: a class looks these up in one table before it asks for a category.
_PLAIN = string.ascii_letters + string.digits + "_"
_FEATURE = rf"[{_PLAIN}\p{{L}}\p{{N}}]+|[[^{_PLAIN} \t\n\x0B\f\r]&&[^\p{{L}}\p{{N}}]]+"


def hashes(text: Column) -> Column:
    """32-bit hashes of letter runs and punctuation runs: each is hashed once, n-grams are hashes of these."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_FEATURE), F.lit(0)), lambda t: F.hash(t))


def unigrams(h: Column, buckets: tuple[int, int], of=lambda bucket: bucket) -> Column:
    """`of` each unigram's bucket."""
    return F.transform(h, lambda x: of(F.pmod(x, F.lit(buckets[0]))))


def pairs(h: Column, buckets: tuple[int, int], of=lambda bucket: bucket) -> Column:
    """`of` each bigram's bucket; these come after the unigrams'."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: of(F.pmod(F.hash(a, b), F.lit(buckets[1])) + buckets[0]))


def model(docs: DataFrame, trusted: DataFrame, buckets: tuple[int, int] = BUCKETS, target_docs: int = TARGET_DOCS) -> DataFrame:
    """One row: array of the buckets' log ratios of target and raw corpus, in millionths.

    Unigrams and bigrams have a pair of multinomials each, so that no bigram hides a rare word.

    The raw multinomial counts all documents, each bucket once a document, so that one text's
    repeats are no evidence. The target's counts those whose doc_id is in `trusted`, of which at
    most `target_docs` are taken, by a hash of the id. Buckets are counted before the shuffle, so
    it carries at most as many rows a task as there are buckets.

    Features are a projection's own columns, exploded with `explode_outer`: before `explode` Spark
    sets a filter on the array's size, in which it computes all of them again.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).withColumn("target", F.lit(1))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashes(F.col("text").cast("string")).alias("h"))
    rows = hashed.select("doc_id", F.array_distinct(F.concat(unigrams(F.col("h"), buckets), pairs(F.col("h"), buckets))).alias("f")).join(F.broadcast(ids), "doc_id", "left")
    counts = rows.select(F.coalesce("target", F.lit(0)).alias("target"), F.explode_outer("f").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(sum(buckets)).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    uni = F.col("bucket") < buckets[0]
    of = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    totals = [of(c, w).alias(f"{c}_{k}") for c in ("raw", "target") for k, w in (("u", uni), ("b", ~uni))]
    cells = every.agg(*totals, F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"))
    p = lambda n, of, size: (n + F.lit(PRIOR)) / (F.col(of) + F.lit(PRIOR * size))
    log = lambda c, k, size: F.when(F.col(f"target_{k}") == 0, F.lit(0.0)).otherwise(F.log(p(c["target"], f"target_{k}", size)) - F.log(p(c["raw"], f"raw_{k}", size)))
    ratio = lambda c: F.when(c["bucket"] < buckets[0], log(c, "u", buckets[0])).otherwise(log(c, "b", buckets[1]))
    return cells.select(F.transform("cells", lambda c: F.round(ratio(c) * UNIT).cast("long")).alias("ratios"))


def base_counts(text: Column) -> dict[str, Column]:
    """The counts of the base rules, by name."""
    text = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def repeats(keys: Column) -> Column:
        """Words in windows whose key is there twice: sort keys with their places, look beside.

        A place takes the key's low bits, unless two keys differ in these alone or places have more bits: then pairs are sorted.
        """
        cut = lambda k: k.bitwiseAND(F.lit(~PLACES))
        packed = F.sort_array(F.transform(keys, lambda k, i: cut(k).bitwiseOR(i.cast("long"))))
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def covered(places: Column) -> Column:
            """Words of windows at places in order, each counted once."""
            n = F.size(places) - 1
            steps = F.zip_with(F.slice(places, F.lit(2), n), F.slice(places, F.lit(1), n), lambda b, a: F.least(b - a, F.lit(3).cast("long")))
            return (F.aggregate(steps, F.lit(3).cast("long"), lambda t, x: t + x)).cast("int")

        def twice(s: Column, same, place) -> Column:
            found = F.filter(s, lambda e, j: F.coalesce(same(F.get(s, j + 1), e), F.lit(False)) | F.coalesce(same(F.get(s, j - 1), e), F.lit(False)))
            return let(F.sort_array(F.transform(found, place)), covered)

        of_numbers = let(packed, lambda s: twice(s, lambda a, b: a.bitwiseXOR(b).between(0, PLACES), lambda e: e.bitwiseAND(F.lit(PLACES))))
        of_pairs = let(ordered, lambda s: twice(s, lambda a, b: a["k"] == b["k"], lambda e: e["i"].cast("long")))
        distinct = F.size(F.array_distinct(keys))
        apart = (F.size(keys) <= PLACES) & (F.size(F.array_distinct(F.transform(keys, cut))) == distinct)
        return F.when(distinct == F.size(keys), F.lit(0)).when(apart, of_numbers).otherwise(of_pairs)

    def windows(w: Column) -> Column:
        keys = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
        repeated = F.when(F.size(w) < 3, F.lit(0)).otherwise(let(keys, repeats)).cast("long")
        return F.struct(F.size(w).cast("long").alias("n"), repeated.alias("r"), F.length(F.array_join(w, "")).cast("long").alias("chars"))

    counted = let(words(text), windows)
    return {
        "counted": counted,
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": lines.cast("long"),
    }


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, peak: float = PEAK, buckets: tuple[int, int] = BUCKETS, target_docs: int = TARGET_DOCS) -> DataFrame:
    """Base counts and verdict of each document (doc_id, text), by column functions only.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. Others are
    kept if the mean log ratio of their hashed unigrams and bigrams is at least `threshold` and the
    least one of a unigram at least `peak`, which a long text cannot even out; the ratios are
    whole numbers, so the verdict is the same for any partitioning.

    Null texts have no words. Without trusted documents every ratio is 0. Repeated rows are judged
    each; extra columns are ignored; an empty table gives no rows. The model is bounded by
    `buckets` and reaches the tasks as one array.
    """
    space = Workspace(docs.sparkSession, "quality")
    fitted = space.save(model(docs, trusted, buckets, target_docs), "model")
    text = F.col("text").cast("string")
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)

    def scores(ratios: Column) -> Column:
        of = lambda b: F.get(ratios, b)
        both = let(hashes(F.col("text")), lambda h: F.struct(unigrams(h, buckets, of).alias("u"), pairs(h, buckets, of).alias("b")))
        return let(both, lambda r: F.struct((F.size(r["u"]) + F.size(r["b"])).alias("n"), (total(r["u"]) + total(r["b"])).alias("sum"), F.coalesce(F.array_min(r["u"]), F.lit(0).cast("long")).alias("least")))

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("ratios", fitted.select("ratios").scalar())
    # named once, the ratios become a part of this expression; a column of them would be copied into the row of each document
    llr, base = let(F.col("ratios"), scores), base_counts(F.col("text"))
    out = out.select("doc_id", base["counted"].alias("c"), base["n_symbols"].alias("n_symbols"), base["n_dup_lines"].alias("n_dup_lines"), llr.alias("llr"))
    failed = (F.col("c.n") < 50) | (100 * F.col("c.r") > 50 * F.col("c.n"))
    good = (F.col("llr.sum") >= F.lit(round(threshold * UNIT)).cast("long") * F.col("llr.n")) & (F.col("llr.least") >= F.lit(round(peak * UNIT)).cast("long"))
    return out.select("doc_id", F.col("c.n").alias("n_words"), F.col("c.chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("c.r").alias("n_repeat_words"), failed.alias("base_failed"), (~failed & good).alias("kept"), F.col("llr.sum").alias("llr_sum"), F.col("llr.n").cast("long").alias("n_features"), F.col("llr.least").alias("llr_least"))
