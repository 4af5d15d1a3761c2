"""Reading, checking and writing tables; caches keyed by content."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestone.sources.arrow import BATCH, arrow_batches

# fixed values: columns of the input tables, in order
ARTICLES = ("article_id", "title", "body")
CALIBRATION = ("query_id", "query_text", "ground_truth")
TEST = ("query_id", "query_text")
KEY_BYTES, LENGTH_BYTES = 32, 8
#: Digests that make one of the next level of a table's digest.
FAN = 4096


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An Arrow IPC file (or some of its columns) as a DataFrame; its rows' order is column `pos`.

    A task reads one record batch; the driver reads the file's footer. Since the source starts
    Python for each plan that reads it, the file is read once and settled as Parquet.
    """
    return _numbered(settled(arrow_batches(spark, path, columns)).withColumnsRenamed({BATCH: "__file"}), "long")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with its rows' order in the files as column `pos`."""
    return positions(spark.read.parquet(path))


def positions(rows: DataFrame) -> DataFrame:
    """`rows`, read from files, with their order in the files (by path) from 0 as column `pos`.

    Rows are counted by file and numbered by the rows of the files before theirs: one row a file
    reaches the driver, as the list of files itself does, and nothing is sorted.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return _numbered(placed, "string")


def _numbered(placed: DataFrame, kind: str) -> DataFrame:
    """`placed` with `pos` in place of (__file, __row)."""
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__file").agg(F.max("__row") + 1).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    starts = placed.sparkSession.createDataFrame([(f, at) for (f, _), at in zip(sizes, before)], f"__file {kind}, __start long")
    return placed.join(F.broadcast(starts), "__file").withColumn("pos", F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")


def check(df: DataFrame, name: str, columns: tuple[str, ...], key: str) -> None:
    """Columns in order, no nulls, unique key; ValueError otherwise. One job."""
    if tuple(c for c in df.columns if c != "pos") != columns:
        raise ValueError(f"table {name}: wrong columns")
    nulls, n, distinct = df.agg(F.count_if(F.expr(" or ".join(f"`{c}` is null" for c in columns))), F.count("*"), F.count_distinct(key)).first()
    if nulls:
        raise ValueError(f"table {name} has nulls")
    if n != distinct:
        raise ValueError(f"table {name}: {key} has repeats")


def unknown_labels(labels: DataFrame, articles: DataFrame) -> DataFrame:
    return labels.select("article_id").distinct().join(articles.select("article_id"), "article_id", "left_anti")


def load_data(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """articles, calibration and test, checked; Arrow files or Parquet tables of these names."""
    from lodestone.functions.text import parse_ground_truth

    out = []
    for name, columns, key in (("articles", ARTICLES, "article_id"), ("calibration", CALIBRATION, "query_id"), ("test", TEST, "query_id")):
        arrow = Path(directory) / f"{name}.f"
        df = read_arrow(spark, str(arrow)) if arrow.exists() else read_table(spark, f"{directory}/{name}.parquet")
        check(df, name, columns, key)
        out.append(df)
    labels = out[1].select(F.explode(parse_ground_truth(F.col("ground_truth"))).alias("article_id"))
    if bad := [r[0] for r in unknown_labels(labels, out[0]).orderBy("article_id").limit(50).collect()]:
        raise ValueError(f"ground_truth has unknown articles: {bad}")
    return tuple(out)


def cache_key(groups: Iterable[Iterable[object]]) -> str:
    """BLAKE2b of all values, each after its length."""
    digest = hashlib.blake2b(digest_size=KEY_BYTES)
    for group in groups:
        for value in group:
            raw = str(value).encode()
            digest.update(len(raw).to_bytes(LENGTH_BYTES, "little") + raw)
    return digest.hexdigest()


def table_digest(df: DataFrame, order: list[str] | None = None) -> str:
    """SHA-256 of a table's rows in order, as a tree: of rows, of FAN digests by position, and so on to the root.

    Rows are ordered by `order` (column pos if there is one, else all columns), then by their own
    digest. A value counts with its length, a null as such, so that no two tables share a text.
    A table without rows has the digest of an empty text.
    """
    order = order or (["pos"] if "pos" in df.columns else df.columns)
    value = lambda c: F.coalesce(F.concat_ws(":", F.length(F.col(f"`{c}`").cast("string")), F.col(f"`{c}`").cast("string")), F.lit(""))
    text = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "null;").otherwise(F.concat(value(c), F.lit(";"))) for c in df.columns])
    rows = df.withColumn("__digest", F.sha2(text, 256))
    by = [*[f"`{c}`" for c in order], "__digest"]
    level = positions(settled(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("__digest"))).select("pos", F.col("__digest").alias("digest"))
    while True:
        parts = level.groupBy(F.floor(F.col("pos") / FAN).alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("rows"))
        level = settled(parts.select(F.col("at").alias("pos"), F.sha2(F.array_join(F.transform("rows", lambda r: r["digest"]), ""), 256).alias("digest")))
        found = level.limit(2).collect()
        if len(found) < 2:
            return found[0]["digest"] if found else hashlib.sha256().hexdigest()


def content_key(df: DataFrame, settings: Iterable[object] = ()) -> str:
    """Key of settings and a table's rows in their order."""
    return cache_key([settings, df.columns, [table_digest(df)]])


def _current(spark: SparkSession, path: str, key: str) -> str | None:
    """The folder of a cached table's newest whole version, which a file beside the versions names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/_current")
    fs = pointer.getFileSystem(conf)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{key}/{stream.readUTF()}"
    finally:
        stream.close()


def _replace(spark: SparkSession, new: str, old: str) -> None:
    """Move a file into the place of another in one step."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    source, target = jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(old)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration())
    how = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(files.makeQualified(source), files.makeQualified(target), how)


def cached_embeddings(spark: SparkSession, path: str, key: str, expected: int, dimension: int, atol: float = 1e-3) -> DataFrame | None:
    """A cached table of unit vectors (id, embedding), or None where it is missing or not valid."""
    if not (folder := _current(spark, path, key)):
        return None
    try:
        df = spark.read.parquet(folder)
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
        n, bad = df.agg(F.count("*"), F.count_if(F.col("embedding").isNull() | (F.size("embedding") != dimension) | norm.isNull() | F.isnan(norm) | (F.abs(norm - 1) > atol))).first()
    except AnalysisException:
        return None
    return df if n == expected and not bad else None


#: An append to a store of so many parts writes them all as one.
MOST_PARTS = 32
LOGITS = "query_id long, article_id long, logit double"
_NOT_FINITE = "logit is null or isnan(logit) or abs(logit) = double('infinity')"


def _parts(spark: SparkSession, path: str, key: str) -> dict[str, int]:
    """Rows by folder of a store's parts that no other one replaces, as their manifests say."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    home = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/_parts")
    fs = home.getFileSystem(conf)
    found, replaced = {}, set()
    for file in fs.listStatus(home) if fs.exists(home) else []:
        if file.getPath().getName().startswith("."):
            continue
        stream = fs.open(file.getPath())
        try:
            said = json.loads(stream.readUTF())
        finally:
            stream.close()
        found[said["part"]] = said["rows"]
        replaced |= set(said["replaces"])
    return {p: n for p, n in found.items() if p not in replaced and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/{p}"))}


def cached_logits(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Cached (query_id, article_id, logit), each pair once, or None if no part can be used.

    A part is left out as a whole if it has numbers that are not finite, a pair twice, or another
    number of rows than its manifest says. Of a pair in several parts the least logit counts.
    """
    if not (parts := _parts(spark, path, key)):
        return None
    read = lambda names: spark.read.schema(LOGITS).parquet(*[f"{path}/{key}/{p}" for p in names])
    placed = read(sorted(parts)).withColumn("part", F.element_at(F.split("_metadata.file_path", "/"), -2))
    pairs = placed.groupBy("part", "query_id", "article_id").agg(F.count("*").alias("n"), F.count_if(F.expr(_NOT_FINITE)).alias("bad"))
    sums = pairs.groupBy("part").agg(F.sum("n"), F.max("n"), F.sum("bad")).collect()
    whole = sorted(p for p, n, most, bad in sums if n == parts[p] and most == 1 and not bad)
    if not whole:
        return None
    return read(whole) if len(whole) == 1 else read(whole).groupBy("query_id", "article_id").agg(F.min("logit").alias("logit"))


def add_logits(df: DataFrame, path: str, key: str) -> int:
    """Append (query_id, article_id, logit) to a store as a part, and return its number of rows.

    A part counts from when its manifest is there, which appears in one move, so a failed writer
    leaves the store as it was. Writers at the same time each add a part; none undoes another's.
    Rows are counted and tested by the job that writes them; logits that are not finite are an
    error. A store of MOST_PARTS parts becomes one part, whose manifest names those that it
    replaces; their files stay, since they may be read still.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old = list(_parts(spark, path, key))
    replaces = old if len(old) >= MOST_PARTS else []
    if replaces and (kept := cached_logits(spark, path, key)) is not None:
        df = df.select("query_id", "article_id", "logit").union(kept).groupBy("query_id", "article_id").agg(F.min("logit").alias("logit"))
    name, seen = uuid.uuid4().hex, Observation()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/{name}")
    fs = folder.getFileSystem(conf)
    df = df.selectExpr("cast(query_id as long) query_id", "cast(article_id as long) article_id", "cast(logit as double) logit")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(_NOT_FINITE)).alias("bad")).write.parquet(folder.toString())
    rows, bad = (seen.get.get(k, 0) for k in ("rows", "bad"))
    if bad or not rows:
        fs.delete(folder, True)
        if bad:
            raise ValueError(f"{bad} of {rows} logits are not finite")
        return 0
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/_{name}")
    stream = fs.create(new)
    stream.writeUTF(json.dumps({"part": name, "rows": rows, "replaces": replaces}))
    stream.close()
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/_parts"))
    _replace(spark, new.toString(), f"{path}/{key}/_parts/{name}")
    return rows


def write_cache(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write a version of a cached table, then name it as the current one; returns what was written.

    The new table may read the old one. Readers see one whole version or the other, whatever fails
    in between; of two writers the later one's version is current. Older versions stay on disk, since they may be read still.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/{key}/{name}")
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/_{name}")
    stream = pointer.getFileSystem(conf).create(pointer)
    stream.writeUTF(name)
    stream.close()
    _replace(spark, pointer.toString(), f"{path}/{key}/_current")
    return spark.read.schema(df.schema).parquet(f"{path}/{key}/{name}")


def embedding_key(articles: DataFrame, references: DataFrame, targets: DataFrame, settings: Iterable[object], device: str) -> str:
    """Key of settings, device, passages (article_id, passage) and both lists of queries."""
    return cache_key([[*settings, device], [content_key(df) for df in (articles, references, targets)]])


def reranker_key(articles: DataFrame, queries: DataFrame, settings: Iterable[object], device: str) -> str:
    """Key of settings, device, articles and queries; candidates are left out, so that their logits can be reused."""
    return cache_key([[*settings, device], [content_key(df) for df in (articles, queries)]])


def validate_submission(submission: DataFrame, test: DataFrame, articles: DataFrame) -> None:
    """Ten different known ids for each test query, in the test's order (column pos). One job tests all."""
    if [c for c in submission.columns if c != "pos"] != ["query_id", "answer"]:
        raise ValueError("submission: wrong columns")
    sides = submission.select("pos", "query_id", F.lit(1).alias("side")).union(test.select("pos", "query_id", F.lit(-1)))
    misplaced = sides.groupBy("pos", "query_id").agg(F.sum("side").alias("side")).where("side <> 0")
    ids = F.filter(F.split("answer", " "), lambda v: v != "")
    wrong = submission.where(F.coalesce((F.size(ids) != 10) | (F.size(F.array_distinct(ids)) != 10), F.lit(True)))
    named = submission.select(F.explode(ids).alias("id")).select(F.col("id").try_cast("bigint").alias("article_id")).distinct()
    unknown = named.join(articles.select("article_id"), "article_id", "left_anti")
    tests = {"queries are not the test's in its order": misplaced, "not ten different articles": wrong, "unknown articles": unknown}
    counts = reduce(DataFrame.union, [df.agg(F.lit(what).alias("what"), F.count("*").alias("n")) for what, df in tests.items()])
    found = dict(map(tuple, counts.collect()))
    for what in tests:
        if found[what]:
            raise ValueError(f"submission: {what}")


def save_submission(submission: DataFrame, path: str) -> None:
    """One CSV file with a header, in the test's order, written by one task and moved to its place as a whole.

    If the write fails, what was there before stays.
    """
    spark = submission.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = folder.getFileSystem(conf)
    try:
        submission.orderBy("pos").select("query_id", "answer").coalesce(1).write.option("header", True).csv(folder.toString())
        parts = [str(f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
        _replace(spark, parts[0], path)
    finally:
        fs.delete(folder, True)


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder (spark.checkpoint.dir) and read back, which cuts its lineage.

    Only where that is unset in a local session a temporary folder is used.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    path = f"{shared.rstrip('/')}/settled-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
