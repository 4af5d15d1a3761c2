"""Benchmark decontamination by spaced seeds, by column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, let

#: Masks as the places of token pairs that count; the tokens between are ignored.
MASKS = ((0, 3, 6), (0, 4, 9), (0, 1, 2))
#: One more for items under OVERLAP tokens. With these no substitution pattern that is a leak is missed (enumerated for
#: 8 to 20 tokens at 80 %; the mask (0, 1, 2), four tokens in a row, finds all of 20).
SHORT_MASKS = (*MASKS, (0, 1))
#: Tokens that a verified overlap has, or all of a shorter item; the share that must be equal.
OVERLAP, SHARE = 20, 0.8
#: Items with fewer tokens, which masks cannot hold, are found by an exact join of all their tokens: one changed word
#: in so short a phrase makes another phrase.
MASK_TOKENS = 8
#: Hashes and items of the benchmark that may be broadcast; with more the joins shuffle.
BROADCAST_ROWS = 2_000_000
#: A seed of more items is common: its hits need two rare tokens of the item, too.
COMMON = 16


def tokens(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.xxhash64(t))


def seeds(hashes: Column, masks: tuple[tuple[int, ...], ...] = SHORT_MASKS) -> Column:
    """Array of (key, at) of every mask at every place of a token array."""

    def masked(pairs: Column) -> Column:
        def one(k: int) -> Column:
            offsets = masks[k]
            last = F.size(pairs) - 1 - offsets[-1]
            keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(*[F.get(pairs, i + o) for o in offsets], F.lit(k)).alias("key"), i.alias("at")))
            return F.when(last >= 0, keys).otherwise(F.array().cast("array<struct<key:bigint,at:int>>"))

        return F.concat(*[one(k) for k in range(len(masks))])

    def pairs(h: Column) -> Column:
        n = F.greatest(F.size(h) - 1, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))

    return let(let(hashes, pairs), masked)


def runs(hashes: Column, lengths: list[int]) -> Column:
    """Array of (key, at) of all runs of these numbers of tokens."""

    def one(h: Column, n: int) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(F.xxhash64(F.slice(h, i + 1, F.lit(n)), F.lit(-n)).alias("key"), i.alias("at")))
        return F.when(F.size(h) >= n, keys).otherwise(F.array().cast("array<struct<key:bigint,at:int>>"))

    return let(hashes, lambda h: F.concat(*[one(h, n) for n in lengths]))


def _pairs(key: Column, places: Column) -> Column:
    """Hashes of a seed with any two of the places (rel, token) around it, given in their order."""
    after = lambda x, i: F.transform(F.slice(places, i + 2, F.size(places)), lambda y: F.xxhash64(key, x["rel"], x["token"], y["rel"], y["token"]))
    return F.flatten(F.transform(places, after))


def _rare_neighbours(occurrences: DataFrame, overlap: int, share: float) -> DataFrame:
    """(item, key, item_at, places) of common seeds (item, key, item_at, h): `places` are sets of (rel, token), `rel` places from the seed.

    If two windows of L tokens have t equal places, any L - t + 2 places of the one hold two that are
    equal in both. So of each window of the item that holds the seed's first pair, those with the
    rarest tokens among all items with the seed stand for the window: what the items have in common
    comes last.
    """
    place = F.sequence(F.greatest(F.col("item_at") + 2 - overlap, F.lit(0)), F.least(F.col("item_at") + overlap, F.size("h")) - 1)
    around = occurrences.select("item", "key", "item_at", F.size("h").alias("size"), F.explode(F.transform(place, lambda p: F.struct((p - F.col("item_at")).alias("rel"), F.get("h", p).alias("token")))).alias("x")).select("item", "key", "item_at", "size", "x.*")
    counts = around.groupBy("key", "rel", "token").agg(F.count("*").alias("n"))
    ordered = around.join(counts, ["key", "rel", "token"]).groupBy("item", "key", "item_at", "size").agg(F.array_sort(F.collect_list(F.struct("n", "rel", "token"))).alias("by_rarity"))
    length = F.least("size", F.lit(overlap))
    few = (length - F.ceil(F.lit(share) * length) + 2).cast("int")
    starts = F.sequence(F.greatest(F.col("item_at") + 2 - length, F.lit(0)), F.least(F.col("item_at"), F.col("size") - length))
    inside = lambda s: F.slice(F.filter("by_rarity", lambda e: (e["rel"] + F.col("item_at")).between(s, s + length - 1)), F.lit(1), few)
    chosen = F.transform(starts, lambda s: F.array_sort(F.transform(inside(s), lambda e: F.struct(e["rel"].alias("rel"), e["token"].alias("token")))))
    return ordered.select("item", "key", "item_at", F.explode(F.array_distinct(chosen)).alias("places"))


def _hits(rows: DataFrame, items: DataFrame, space: Workspace, overlap: int, share: float, broadcast_rows: int, common: int) -> DataFrame:
    """(doc_id, th, item, shift): how rows (doc_id, th, text) and items (item, h) may lie against each other.

    Seeds of at most `common` items make a hit each. A common seed makes one only with an item of
    which two rare neighbours (see above) are there, too; places of common seeds are gathered by row, at
    most as many as the text has, to take their neighbours from the text.
    """
    own = F.when(F.size("h") < MASK_TOKENS, F.array(F.struct(F.xxhash64("h", -F.size("h")).alias("key"), F.lit(0).alias("at")))).when(F.size("h") < overlap, seeds(F.col("h"))).otherwise(seeds(F.col("h"), MASKS))
    keys = space.save(items.select("item", F.explode(own).alias("s"), F.size("h") >= MASK_TOKENS).toDF("item", "s", "masked").select("item", "s.key", F.col("s.at").alias("item_at"), "masked"), "keys")
    sizes = items.agg(F.collect_set(F.when(F.size("h") < MASK_TOKENS, F.size("h"))), F.coalesce(F.min(F.when(F.size("h") >= MASK_TOKENS, F.size("h"))), F.lit(overlap))).first()
    short = sorted(sizes[0])
    fit = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    masks = SHORT_MASKS if sizes[1] < overlap else MASKS
    placed = let(tokens(F.col("text")), lambda h: F.concat(seeds(h, masks), runs(h, short))) if short else seeds(tokens(F.col("text")), masks)
    placed = rows.select("doc_id", "th", F.explode(placed).alias("s")).select("doc_id", "th", "s.key", "s.at")
    one = lambda df: df.groupBy("doc_id", "th", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("n")).drop("n")
    hot = space.save(keys.where("masked").select("key", "item").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > common).select("key"), "common")
    if not (n_hot := hot.count()):
        return one(placed.join(fit(keys, keys.count()), "key"))
    cold = space.save(keys.join(fit(hot, n_hot), "key", "left_anti"), "cold")
    sets = space.save(_rare_neighbours(keys.join(fit(hot, n_hot), "key", "left_semi").join(items.select("item", "h"), "item"), overlap, share), "sets")
    single = space.save(sets.select("key", F.explode("places").alias("x")).select("key", "x.*").distinct(), "single")
    rare = space.save(sets.select("item", "item_at", F.explode(_pairs(F.col("key"), F.col("places"))).alias("pair")).distinct(), "rare")
    at = space.save(placed.join(fit(hot, n_hot), "key").groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "at")).alias("places")), "places")
    found = rows.join(at.withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"}), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th"))).dropDuplicates(["doc_id", "th"])

    def beside(h: Column) -> Column:
        span = lambda x: F.sequence(F.greatest(x["at"] + 2 - overlap, F.lit(0)), F.least(x["at"] + overlap, F.size(h)) - 1)
        return F.transform("places", lambda x: F.struct(x["key"].alias("key"), x["at"].alias("at"), F.transform(span(x), lambda p: F.struct((p - x["at"]).alias("rel"), F.get(h, p).alias("token"))).alias("around")))

    found = found.select("doc_id", "th", F.explode(let(tokens(F.col("text")), beside)).alias("x")).select("doc_id", "th", "x.key", "x.at", F.explode("x.around").alias("y")).select("doc_id", "th", "key", "at", "y.*")
    found = found.join(fit(single, single.count()), ["key", "rel", "token"], "left_semi").groupBy("doc_id", "th", "key", "at").agg(F.array_sort(F.collect_list(F.struct("rel", "token"))).alias("places"))
    found = found.select("doc_id", "th", "at", F.explode(_pairs(F.col("key"), F.col("places"))).alias("pair")).join(fit(rare, rare.count()), "pair")
    return one(placed.join(fit(cold, cold.count()), "key")).union(one(found)).distinct()


def _found(docs: DataFrame, benchmark: DataFrame, space: Workspace, overlap: int, share: float, min_tokens: int, broadcast_rows: int, common: int) -> DataFrame:
    """Verified overlaps of rows of `docs`, named by doc_id and th, the hash of the text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text").cast("string")).alias("h")).where(F.size("h") >= min_tokens)
    items = space.save(items.distinct().withColumn("item", F.xxhash64("item_id", "h")).dropDuplicates(["item"]), "items")
    longest, n_items = items.agg(F.coalesce(F.max(F.size("h")), F.lit(1)), F.count("*")).first()
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    hits = _hits(rows, items, space, overlap, share, broadcast_rows, common)
    by_doc = space.save(hits.groupBy("doc_id", "th").agg(F.collect_list(F.struct("item", "shift")).alias("hits")), "hits")
    fit = F.broadcast if n_items <= broadcast_rows else (lambda df: df)
    near = rows.join(by_doc.withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"}), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")))
    local = let(tokens(F.col("text")), lambda h: F.transform("hits", lambda x: F.struct(x["item"].alias("item"), x["shift"].alias("shift"), F.slice(h, F.greatest(x["shift"], F.lit(0)) + 1, F.lit(longest)).alias("part"))))
    parts = near.select("doc_id", "th", F.explode(local).alias("x")).select("doc_id", "th", "x.*").join(fit(items), "item")
    first = F.greatest(-F.col("shift"), F.lit(0))
    count = F.least(F.size("h") - first, F.size("part"))
    equal = F.zip_with(F.slice("h", first + 1, F.greatest(count, F.lit(0))), F.slice("part", F.lit(1), F.greatest(count, F.lit(0))), lambda a, b: (a == b).cast("int"))
    size = F.least(F.size("h"), F.lit(overlap))
    sums = let(equal, lambda e: F.transform(F.sequence(F.lit(0), F.greatest(F.size(e) - F.col("size"), F.lit(0))), lambda i: F.struct(F.aggregate(F.slice(e, i + 1, F.col("size")), F.lit(0), lambda t, v: t + v).alias("n"), (-i).alias("at"))))
    return parts.withColumn("size", size).withColumn("first", first).where(count >= F.col("size")).withColumn("best", F.array_max(sums)).where(F.col("best.n") >= F.lit(share) * F.col("size"))


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, share: float = SHARE, min_tokens: int = 1, broadcast_rows: int = BROADCAST_ROWS, common: int = COMMON) -> DataFrame:
    """Pairs (doc_id, item_id) of documents that hold a benchmark passage, substitutions allowed.

    Fixed masks pick token pairs and ignore the tokens between; hashes of the picked tokens of the
    items (item_id, text) are joined with those of the documents (doc_id, text). A hit fixes how
    item and document lie against each other; the overlap around it is verified on all tokens: in
    some window of `overlap` neighbouring tokens (the whole item if it is shorter) at least `share`
    must be equal. Items under MASK_TOKENS tokens must be there as they are. Returns doc_id,
    item_id, n_equal, n_tokens, doc_start of the best overlap.

    A seed that more than `common` items have (a lead in common, say) makes a candidate only of those
    items of which two rare neighbouring tokens are there, too, which loses no leak. The benchmark's
    hashes are counted and broadcast only up to `broadcast_rows`. Documents are shuffled once, to
    verify, and those with common seeds once more. Texts count as a whole however long; a token that
    an item and a text both repeat makes as many candidates as there are ways to lay them together. Null and empty texts have no tokens; items under min_tokens tokens
    are no evidence; null ids are kept as ids; repeated rows give one pair; extra columns are
    ignored; empty tables give no pairs.
    """
    space = Workspace(docs.sparkSession, "leaks")
    found = _found(docs, benchmark, space, overlap, share, min_tokens, broadcast_rows, common)
    best = F.max(F.struct(F.col("best.n").alias("n"), F.col("size").alias("size"), (-(F.greatest(F.col("shift"), F.lit(0)) - F.col("best.at"))).alias("at")))
    return space.close(found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.n").cast("long").alias("n_equal"), F.col("b.size").cast("long").alias("n_tokens"), (-F.col("b.at")).cast("long").alias("doc_start")))


def clean(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, share: float = SHARE, min_tokens: int = 1, broadcast_rows: int = BROADCAST_ROWS, common: int = COMMON) -> DataFrame:
    """`docs` without the rows that hold a benchmark passage (see leaks), each judged by its own text, whatever its id."""
    space = Workspace(docs.sparkSession, "clean")
    found = space.save(_found(docs, benchmark, space, overlap, share, min_tokens, broadcast_rows, common).select(F.col("doc_id").alias("__leak_id"), F.col("th").alias("__leak_th")).distinct(), "found")
    gone = F.broadcast(found) if found.count() <= broadcast_rows else found
    text = F.xxhash64(docs["text"].cast("string"))
    return space.close(docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__leak_id"]) & (text == gone["__leak_th"]), "left_anti"))
