"""Near-duplicate groups by bottom-k sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, lean, release_worker, ship
from lodestone.llm.components import LINKS_A_FILE, components, union
from lodestone.llm.hashing import shingles

#: Values kept of each set, and neighbouring kept values that make an inverted list's key.
KEPT, RUN = 48, 2
#: Lists that two linked sets share at least, but for a probability of 1e-9 (none for sets of under KEPT values).
SHARED = 4
#: Bits of 256 in which the signatures of linked sets may differ, but for a probability of 1e-11 (none for sets under 256 values).
BITS = 64
#: Share of the union sketch that both must hold for a pair to be verified against a leader.
LEAST = 0.5
#: Sets that a task keeps while it verifies pairs.
CACHED = 1000
#: Entries of one list in one block of the closing pass.
BLOCK_ENTRIES = 4000
#: Sets, and values of sets, on either side of one block of its exact comparison.
BLOCK_SETS, BLOCK_VALUES = 1000, 400_000
#: Rows of a counted table that may be broadcast; with more its joins shuffle.
BROADCAST_ROWS = 1_000_000
_SIG = ["s0", "s1", "s2", "s3"]
#: Values that are columns of one matrix product.
COLUMNS = 4096


def _sketch(size: int):
    @lean
    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1):
                s = shingles(text.as_py(), size)
                u = s.view(np.uint64)
                first = np.zeros(256, np.uint64)
                first[(u & np.uint64(255)).astype(np.int64)[::-1]] = u[::-1]
                sig = np.packbits(((first >> np.uint64(8)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
                d = u * np.uint64(0xC2B2AE3D27D4EB4F)
                d ^= d >> np.uint64(31)
                rows.append((len(s), int(d.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(d * u | np.uint64(1)).view(np.int64)) if len(s) else 0, sig, s[:KEPT].copy()))
            n, d1, d2, sig, kept = zip(*rows) if rows else ([],) * 5
            flat = np.concatenate(kept) if rows else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            sig = np.array(sig, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *(pa.array(x, pa.int64()) for x in sig), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))],
                ["doc_id", "n", "d1", "d2", *_SIG, "kept"],
            )

    return run


def _keys() -> Column:
    """Keys of the inverted lists of one sketch: runs of neighbouring kept values."""
    return F.expr(f"if(size(kept) < {RUN}, array(), transform(sequence(1, size(kept) - {RUN - 1}), i -> xxhash64(slice(kept, i, {RUN}))))")


def _exact(size: int, percent: int):
    """Pairs with whole texts: keep those whose full sets are similar enough."""

    @lean
    def run(batches):
        held: dict[int, np.ndarray] = {}

        def whole(doc: int, text) -> np.ndarray:
            if doc not in held:
                if len(held) >= CACHED:
                    held.clear()
                held[doc] = shingles(text.as_py(), size)
            return held[doc]

        for batch in batches:
            keep = []
            for a, a_text, b, b_text in zip(*(batch.column(c) for c in ("a", "a_text", "b", "b_text"))):
                a, b = a.as_py(), b.as_py()
                left, right = whole(a, a_text), whole(b, b_text)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _values(size: int):
    """The full set of each whole text."""

    @lean
    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))], ["doc_id", "vals"])

    return run


class _Sets:
    """Sets of one side of a block: their signatures, and their values in one array."""

    def __init__(self, doc: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, flat: np.ndarray):
        self.doc, self.comp, self.n, self.sig, self.flat = doc, comp, n, sig, flat
        self.ends = np.concatenate([[0], np.cumsum(n)])
        self.owner = np.repeat(np.arange(len(n)), n)

    def one(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]

    def only(self, rows: np.ndarray) -> _Sets:
        return _Sets(self.doc[rows], self.comp[rows], self.n[rows], self.sig[rows], self.flat[np.isin(self.owner, rows)])


def _similar(a: dict[str, np.ndarray], i: np.ndarray, b: dict[str, np.ndarray], j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets are in different components and near in length and signature."""
    bits = sum(np.bitwise_count((a[s][i] ^ b[s][j]).view(np.uint64)).astype(np.int16) for s in _SIG)  # of signed numbers it counts the absolute value
    most = np.minimum(BITS, (a["n"][i] + b["n"][j]) * (100 - percent) // (100 + percent))  # each difference turns one bit at most
    return (bits <= most) & (a["comp"][i] != b["comp"][j]) & (100 * np.minimum(a["n"][i], b["n"][j]) >= percent * np.maximum(a["n"][i], b["n"][j]))


def _tied(percent: int):
    """Entries in the order of their lists' blocks: each set with the smallest of those it is similar to, by steps.

    All pairs within a block are looked at, `d` places apart at a time, and merged to stars here, so the rows that come
    out are no more than those that went in.
    """

    def stars(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(t["doc_id"])
        starts = np.flatnonzero(np.concatenate([[True], (t["key"][1:] != t["key"][:-1]) | (t["x"][1:] != t["x"][:-1]) | (t["y"][1:] != t["y"][:-1])]))
        sizes = np.diff(np.concatenate([starts, [n]]))
        after = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows of the block that follow
        docs, node = np.unique(t["doc_id"], return_inverse=True)
        label, d, at = np.arange(len(docs)), 1, np.flatnonzero(after > 0)
        while len(at):
            hit = at[_similar(t, at, t, at + d, percent)]
            if len(hit):
                union(label, node[hit], node[hit + d])
            d += 1
            at = at[after[at] >= d]
        moved = np.flatnonzero(label != np.arange(len(docs)))
        return pa.RecordBatch.from_arrays([pa.array(docs[moved]), pa.array(docs[label[moved]])], ["a", "b"])

    @lean
    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
            t = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            same = (t["key"] == t["key"][-1]) & (t["x"] == t["x"][-1]) & (t["y"] == t["y"][-1])
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0  # the last block may go on
            if cut:
                yield stars({c: v[:cut] for c, v in t.items()})
            held = [{c: v[cut:] for c, v in t.items()}]
        if held:
            yield stars(held[0])

    return run


def _overlaps(x: _Sets, y: _Sets) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y: products of 0/1 matrices over the values in both."""
    out = np.zeros((len(x.n), len(y.n)), np.float32)
    both = np.intersect1d(x.flat, y.flat)
    sides = []
    for s in (x, y):
        at = np.minimum(np.searchsorted(both, s.flat), max(len(both) - 1, 0))
        hit = np.flatnonzero(both[at] == s.flat) if len(both) else np.zeros(0, np.int64)
        order = hit[np.argsort(at[hit], kind="stable")]
        sides.append((at[order], s.owner[order], len(s.n)))
    for low in range(0, len(both), COLUMNS):
        m = []
        for at, owner, size in sides:
            a, b = np.searchsorted(at, (low, low + COLUMNS))
            m.append(np.zeros((size, min(COLUMNS, len(both) - low)), np.float32))
            m[-1][owner[a:b], at[a:b] - low] = 1
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


def _linked(x: _Sets, y: _Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of x and sets of y in other components, one for each set and component: signatures first, then full sets."""
    one, two = ({"comp": s.comp, "n": s.n} | {c: s.sig[:, k] for k, c in enumerate(_SIG)} for s in (x, y))
    may = _similar(one, np.s_[:, None], two, np.s_[None], percent)
    r, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if np.count_nonzero(may) <= 4 * (len(r) + len(c)):
        pairs = np.argwhere(may).reshape(-1, 2)
        size = np.array([len(np.intersect1d(x.one(a), y.one(b), assume_unique=True)) for a, b in pairs.tolist()], np.int64)
    else:
        full = _overlaps(x.only(r), y.only(c))
        pairs = np.argwhere(may[np.ix_(r, c)])
        size = full[pairs[:, 0], pairs[:, 1]]
        pairs = np.stack([r[pairs[:, 0]], c[pairs[:, 1]]], 1)
    a, b = pairs[:, 0], pairs[:, 1]
    good = 100 * size >= percent * (x.n[a] + y.n[b] - size)
    a, b = a[good], b[good]
    first = np.unique(np.stack([a, y.comp[b]], 1), axis=0, return_index=True)[1]  # one link to each component
    return x.doc[a[first]], y.doc[b[first]]


def _block(percent: int):
    """One block: sets outside their family's main component (side) against sets of the family."""

    def run(table: pa.Table) -> pa.Table:
        release_worker()
        table = table.combine_chunks()
        side, doc, comp = (table.column(c).to_numpy() for c in ("side", "doc_id", "comp"))
        vals = table.column("vals").combine_chunks()
        n = np.diff(vals.offsets.to_numpy()).astype(np.int64)
        sig = np.stack([table.column(c).to_numpy() for c in _SIG], 1)
        every = _Sets(doc, comp, n, sig, vals.flatten().to_numpy())
        a, b = _linked(every.only(np.flatnonzero(side)), every.only(np.flatnonzero(~side)), percent)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _closing(docs: DataFrame, entries: DataFrame, comps: DataFrame | None, space: Workspace, size: int, percent: int) -> DataFrame:
    """All links between different components.

    In lists across components, by blocks of bounded size, sets near in signature are merged to
    stars; these make families of similar sets. In each family the sets outside its largest
    component are compared with all of its sets, block by block. No pairs become rows on the way.
    """
    cross = space.save(_across(_labelled(entries, comps)), "cross")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("own")
    lists = cross.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ENTRIES).cast("int").alias("blocks"))
    dealt = cross.join(lists, "key").select(*cross.columns, own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    dealt = dealt.select("key", F.least("own", "k").alias("x"), F.greatest("own", "k").alias("y"), "doc_id", "comp", "n", *_SIG)
    stars = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_tied(percent), "a long, b long")
    family = components(space.save(stars.distinct(), "similar"), space).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sets = space.save(cross.select("doc_id", "comp", "n", *_SIG).distinct().join(family, "doc_id"), "families")
    sizes = sets.groupBy("family", "comp").agg(F.count("*").alias("sets"), F.sum("n").alias("vals")).groupBy("family").agg(
        F.max(F.struct("sets", "comp"))["comp"].alias("main"), F.sum("sets").alias("sets"), F.sum("vals").alias("vals"), (F.sum("sets") - F.max("sets")).alias("out_sets"), (F.sum("vals") - F.max(F.struct("sets", "comp", "vals"))["vals"]).alias("out_vals")
    )
    blocks = lambda sets, vals: F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(vals) / BLOCK_VALUES)).cast("int")
    sizes = sizes.where("out_sets > 0").withColumn("down", blocks("out_sets", "out_vals")).withColumn("across", blocks("sets", "vals"))
    total = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shares = 1 + max(total[0] // BLOCK_SETS, total[1] // BLOCK_VALUES)  # families of one block share blocks
    sets = sets.join(sizes, "family").withColumn("block", F.when(F.col("down") * F.col("across") == 1, F.pmod(F.xxhash64("family"), F.lit(shares))).otherwise(F.col("family")))
    part = lambda of, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    alone = (F.col("down") * F.col("across") == 1).alias("alone")
    one = sets.where("comp <> main").select("doc_id", "comp", *_SIG, "block", alone, F.lit(True).alias("side"), part("down", 1).alias("i"), every("across").alias("j"))
    two = sets.select("doc_id", "comp", *_SIG, "block", alone, F.lit(False).alias("side"), every("down").alias("i"), part("across", 2).alias("j"))
    dealt = space.save(one.union(two), "blocks")
    texts = docs.where("doc_id is not null").join(_fit(sets.select("doc_id").distinct(), total[0]), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    whole = texts.select("doc_id", "text").mapInArrow(_values(size), "doc_id long, vals array<long>")
    return dealt.join(whole, "doc_id").groupBy("block", "alone", "i", "j").applyInArrow(_block(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents (doc_id, text) that links of similar word-shingle sets connect.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept. Two documents are
    linked when 100 * |A and B| >= percent * |A or B| for their sets of `size`-word shingles (64-bit
    hashes of the words).

    Equal sets are folded first. Every set keeps the KEPT smallest values of one 64-bit hash;
    inverted lists are keyed on runs of RUN neighbouring kept values, and only lists of several
    sets go on. Two linked sets share at least SHARED lists, so each set leaves out its longest
    SHARED - 1 ones (as lists of common passages are). First a list of any length is paired with
    one leader, drawn alike in all lists, so that work grows with the number of entries and not
    with its square. Pairs pass a test of length and of a 256-bit signature, the estimate from
    the union's sketch, and then the exact comparison of full sets of whole texts. Leaders only
    make components large early: the closing pass
    compares all sets that share a list across components, so no pair is left out for the lists'
    length or the leaders drawn. It finds every link of sets of at most KEPT values and misses one
    of larger sets at exactly 80 % with a probability under 1e-9 (fewer than SHARED common lists,
    or signatures over BITS apart), above 80 % with a smaller one.

    Null or empty texts (and texts without words) have no set and stand alone; rows with a null
    doc_id stand alone under a null component; repeated rows fall in one class; extra columns
    are ignored; an empty table gives no rows. Different texts under one doc_id are different
    documents, each with its own component, whose id is the smallest doc_id in it.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = renumbered(docs, space)
    if numbered is not None:
        out = near_duplicates(numbered.select(F.col("row_id").alias("doc_id"), "text"), size, percent).withColumnsRenamed({"doc_id": "row_id", "component_id": "node"})
        out = space.save(out.where("row_id is not null").distinct().join(numbered.select("row_id", "doc_id", "times"), "row_id"), "groups")
        least = out.groupBy("node").agg(F.min(F.struct("doc_id", "row_id")).alias("least"))
        rows = out.join(least, "node").select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("row_id") == F.col("least.row_id")).alias("kept"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k")).drop("k")
        alone = docs.where("doc_id is null")
        return rows.union(near_duplicates(alone, size, percent))
    made = space.save(docs.mapInArrow(_sketch(size), f"doc_id long, n long, d1 long, d2 long, {', '.join(f'{c} long' for c in _SIG)}, kept array<long>"), "sketches")
    same = ["n", "d1", "d2"]
    copies = made.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    copies = space.save(copies, "copies")
    made = made.join(_fit(copies, copies.count()), same, "left")
    sets = made.where("n > 0 and doc_id is not null").select("doc_id", "n", *_SIG, "kept", "rep")
    reps = space.save(sets.where("rep is null").union(sets.where("doc_id = rep").dropDuplicates(["doc_id"])).drop("rep"), "sets")
    rows = reps.select("doc_id", F.explode(_keys()).alias("key"))
    several = space.save(rows.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1"), "lists")
    hottest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("sets"), "key"))
    spare = F.least(F.lit(SHARED), F.floor(0.6 * F.col("n")) - 1) - 1
    listed = rows.join(_fit(several, several.count()), "key").join(reps.select("doc_id", "n", *_SIG), "doc_id")
    entries = space.save(listed.withColumn("rank", hottest).where(F.col("rank") > spare).drop("rank", "sets"), "entries")
    pairs = space.save(_candidates(entries, percent), "pairs")
    n_pairs = pairs.count()
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = _fit(ids, 2 * n_pairs)
    texts = space.save(docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    todo = _estimated(pairs, reps.join(ids, "doc_id", "left_semi")).coalesce(1 + n_pairs // LINKS_A_FILE)
    for c in ("a", "b"):
        todo = todo.join(texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text")), c)
    links, comps = _joined(None, None, todo.select("a", "a_text", "b", "b_text").mapInArrow(_exact(size, percent), "a long, b long"), space)
    links, comps = _joined(links, comps, _closing(docs, entries, comps, space, size, percent), space)
    out = made.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).alias("rep"))
    if comps is not None:
        out = out.join(_fit(comps.select(F.col("node").alias("rep"), "component"), comps.count()), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    comp = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "rep", "doc_id"))
    return space.close(out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept")))


def renumbered(docs: DataFrame, space: Workspace) -> DataFrame | None:
    """Where one doc_id stands on different texts: (row_id, doc_id, text, times), one row for each text of an id.

    The smallest hash of an id's texts keeps the id as row_id, the others get numbers after the largest id. None
    where each id has one text; rows with a null doc_id are left out.
    """
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"))
    reused = texts.groupBy("doc_id").agg(F.min("th").alias("own"), F.max("th").alias("last")).where("own <> last")
    if reused.isEmpty():
        return None
    after = texts.agg(F.max("doc_id")).first()[0] + 1
    others = texts.distinct().join(reused.select("doc_id", "own"), "doc_id").where("th <> own")
    others = space.save(others.select("doc_id", "th", (F.monotonically_increasing_id() + after).alias("row_id")), "others")
    one = docs.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("th")).agg(F.first("text").alias("text"), F.count("*").alias("times"))
    return space.save(one.join(others, ["doc_id", "th"], "left").select(F.coalesce("row_id", "doc_id").alias("row_id"), "doc_id", "text", "times"), "numbered")


def _joined(links: DataFrame | None, comps: DataFrame | None, found: DataFrame, space: Workspace) -> tuple[DataFrame | None, DataFrame | None]:
    """All links with those that were found, and their components."""
    found = space.save(found, "links")
    if found.isEmpty():
        return links, comps
    links = found if links is None else links.union(found)
    return links, space.save(components(links, space), "components")


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each entry with its list's leader, where they may be linked."""
    lists = entries.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "n", *_SIG)).alias("l"))
    lists = lists.select("key", F.col("l.doc_id").alias("b"), F.col("l.n").alias("bn"), *(F.col(f"l.{c}").alias(f"b{c}") for c in _SIG))
    bits = " + ".join(f"bit_count({c} ^ b{c})" for c in _SIG)
    joined = entries.join(lists, "key").where(f"doc_id <> b and {bits} <= least({BITS}, (n + bn) * {100 - percent} div {100 + percent}) and 100 * least(n, bn) >= {percent} * greatest(n, bn)")
    return joined.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()


def _labelled(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return entries.withColumn("comp", F.col("doc_id"))
    return entries.join(_fit(comps.select(F.col("node").alias("doc_id"), "component"), comps.count()), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def _fit(df: DataFrame, rows: int) -> DataFrame:
    """`df` for a join: broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _across(entries: DataFrame) -> DataFrame:
    """Entries of lists with several components."""
    lists = entries.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
    return entries.join(lists, "key")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose union sketch promises enough: the share of the union's smallest values in both."""
    for c in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("doc_id").alias(c), F.col("kept").alias(f"{c}_kept")), c)
    low = F.expr(f"slice(array_sort(array_union(a_kept, b_kept)), 1, {KEPT})")
    both = F.size(F.array_intersect(F.array_intersect("a_kept", "b_kept"), low))
    return pairs.where(both >= F.lit(LEAST) * F.size(low)).select("a", "b")
