"""Keys that follow rows and their order, caches and the answer file, which appear whole, Arrow files, label pairs of hubs."""

import hashlib
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import scores as S
from lodestone.sources import io
from lodestone.sources.arrow import arrow_batches


def test_table_digest_follows_rows_and_order(spark, monkeypatch):
    monkeypatch.setattr(io, "FAN", 3)
    rows = [(i, f"text {i % 4}", None if i % 3 else "x") for i in range(20)]
    make = lambda r, n=3: spark.createDataFrame(r, "a long, b string, c string").repartition(n)
    key = io.table_digest(make(rows))
    level = [hashlib.sha256("".join(f"{len(str(v))}:{v};" if v is not None else "null;" for v in r).encode()).hexdigest() for r in rows]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
    assert key == level[0] == io.table_digest(make(rows, 7))
    changed = [(i, rows[1 - i][1] if i < 2 else b, c) for i, b, c in rows]  # two texts exchanged
    assert io.table_digest(make(changed)) != key
    assert io.table_digest(make([(1, "a", None)])) != io.table_digest(make([(1, None, "a")]))
    ordered = lambda r: io.table_digest(spark.createDataFrame([(k, *x) for k, x in enumerate(r)], "pos long, a long, b string, c string"))
    assert ordered(rows) != ordered(rows[::-1])
    assert io.table_digest(make(rows).where("false")) == hashlib.sha256().hexdigest()


def _broken(df):
    return df.withColumn("answer", F.expr("if(query_id > 1, cast(raise_error('lost') as string), answer)"))


def test_answer_file_appears_whole(spark, tmp_path):
    answers = spark.createDataFrame([(2, 7, "1 2"), (0, 9, "3 4"), (1, 8, "5 6")], "pos long, query_id long, answer string").repartition(3)
    path = tmp_path / "sub" / "answer.csv"
    io.save_submission(answers, str(path))
    first = path.read_bytes()
    assert first == b"query_id,answer\n9,3 4\n8,5 6\n7,1 2\n"
    with pytest.raises(Exception, match="lost"):
        io.save_submission(_broken(answers), str(path))
    assert path.read_bytes() == first
    assert [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["answer.csv"]
    io.save_submission(answers.where("pos = 0"), str(path))
    assert path.read_text() == "query_id,answer\n9,3 4\n"


def test_cache_keeps_the_last_whole_version(spark, tmp_path):
    path = str(tmp_path)
    vectors = lambda *ids: spark.createDataFrame([(i, [0.6, 0.8]) for i in ids], "id long, embedding array<float>")
    found = lambda n: sorted(r.id for r in io.cached_embeddings(spark, path, "k", n, 2).collect())
    assert io.cached_embeddings(spark, path, "k", 1, 2) is None
    io.write_cache(vectors(1), path, "k")
    old = io.cached_embeddings(spark, path, "k", 1, 2)
    with pytest.raises(Exception, match="lost"):
        io.write_cache(vectors(2).withColumn("id", F.expr("cast(raise_error('lost') as long)")), path, "k")
    assert found(1) == [1]
    io.write_cache(old.union(vectors(2)), path, "k")  # reads the version that it follows
    assert found(2) == [1, 2]
    assert [r.id for r in old.collect()] == [1]  # who still reads the old one can
    assert len([p for p in Path(path, "k").iterdir() if p.is_dir()]) == 3


def _logits(spark, *rows):
    return spark.createDataFrame(list(rows), io.LOGITS)


def test_logits_are_appended(spark, tmp_path, monkeypatch):
    path, found = str(tmp_path), lambda: sorted(map(tuple, io.cached_logits(spark, path, "k").collect()))
    assert io.cached_logits(spark, path, "k") is None and io.add_logits(_logits(spark).where("true"), path, "k") == 0
    assert io.add_logits(_logits(spark, (1, 1, 0.5), (1, 2, 0.25)), path, "k") == 2
    with pytest.raises(Exception, match="lost"):  # killed half way
        io.add_logits(_logits(spark, (1, 3, 0.1)).withColumn("logit", F.expr("cast(raise_error('lost') as double)")), path, "k")
    assert found() == [(1, 1, 0.5), (1, 2, 0.25)]
    before = {p for p in Path(path).rglob("*.parquet") if p.is_file()}
    assert io.add_logits(_logits(spark, (1, 3, 0.125)), path, "k") == 1
    new = {p for p in Path(path).rglob("*.parquet") if p.is_file()} - before
    assert sum(spark.read.parquet(str(p)).count() for p in new) == 1  # one new pair, one row written
    reader = io.cached_logits(spark, path, "k")
    monkeypatch.setattr(io, "MOST_PARTS", 2)
    io.add_logits(_logits(spark, (1, 1, 0.5), (2, 1, 1.0)), path, "k")
    assert len(io._parts(spark, path, "k")) == 1 and found() == [(1, 1, 0.5), (1, 2, 0.25), (1, 3, 0.125), (2, 1, 1.0)]
    assert reader.count() == 3


def test_two_writers_of_logits_lose_nothing(spark, tmp_path):
    path, written = str(tmp_path), [[(w, a, w + a / 8) for a in range(5)] + [(9, 9, 0.5)] for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda rows: io.add_logits(_logits(spark, *rows), path, "k"), written))
    assert sorted(map(tuple, io.cached_logits(spark, path, "k").collect())) == sorted({r for rows in written for r in rows})


@pytest.mark.parametrize("compression", [None, "zstd"])
def test_arrow_file_by_batches(spark, tmp_path, compression):
    path, sizes = str(tmp_path / "a.f"), [3, 0, 5, 1]
    table = pa.table({"id": pa.array(range(9), pa.int64()), "text": ["ä", None, "", "x y", "z", "b", "c", "d", "e"], "v": pa.array([[float(k)] * (k % 3) for k in range(9)], pa.list_(pa.float32()))})
    with pa.ipc.new_file(path, table.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
        for at, n in zip((0, 3, 3, 8), sizes):
            out.write_batch(table.slice(at, n).combine_chunks().to_batches()[0] if n else pa.RecordBatch.from_pylist([], table.schema))
    rows = io.read_arrow(spark, path)
    assert rows.columns == ["id", "text", "v", "pos"]
    assert [r.asDict() for r in rows.orderBy("pos").collect()] == [r | {"pos": k} for k, r in enumerate(table.to_pylist())]
    assert arrow_batches(spark, path).rdd.getNumPartitions() == len(sizes)
    some = io.read_arrow(spark, f"file://{path}", ["v", "id"])
    assert some.columns == ["v", "id", "pos"] and [(r.id, r.pos) for r in some.orderBy("pos").collect()] == [(k, k) for k in range(9)]


def test_arrow_file_without_rows(spark, tmp_path):
    with pa.ipc.new_file(str(tmp_path / "a.f"), pa.schema([("id", pa.int64())])):
        pass
    assert io.read_arrow(spark, str(tmp_path / "a.f")).collect() == []


def test_label_pairs_of_a_hub(spark):
    labels = [(1, a) for a in range(300)] + [(r, a) for r in range(2, 20) for a in range(r, r + 4)] + [(30, 5)]
    expected = sorted((r, a, b) for r, a in labels for s, b in labels if r == s and a != b)
    frame = spark.createDataFrame(labels, "ref_id long, article_id long")
    for most in (1000, 40, 2):
        assert sorted(map(tuple, S.label_pairs(frame, most).collect())) == expected


def test_label_pairs_of_ten_thousand_labels_are_dealt(spark):
    hub = spark.range(10_000).select(F.lit(1).alias("ref_id"), F.col("id").alias("article_id"))
    pairs = S.label_pairs(hub).groupBy(F.pmod("a", F.lit(100)).alias("g")).agg(F.count("*").alias("n"))
    assert [r.n for r in pairs.collect()] == [100 * 9_999] * 100
