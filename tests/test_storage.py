"""Collections and streams: repeated writes change nothing, streams equal batches."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import hooks
from lectern.sources import collections as store
from lectern.streaming import ingest, records


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "chunks")


def chunks(spark, rows):
    return spark.createDataFrame(rows, "collection string, chunk_id string, text string")


def current(spark, root, *names):
    return sorted((r.collection, r.chunk_id, r.text) for r in store.scan_collection(spark, root, list(names) or None).collect())


def test_upsert_is_idempotent(spark, root):
    store.upsert_chunks(chunks(spark, [("a", "1", "old"), ("a", "2", "x"), ("b", "1", "y")]), root, 0)
    new = chunks(spark, [("a", "1", "new"), ("a", "3", "z"), ("a", "3", "z")])
    for _ in range(2):
        store.upsert_chunks(new, root, 1)
        assert current(spark, root) == [("a", "1", "new"), ("a", "2", "x"), ("a", "3", "z"), ("b", "1", "y")]
    before = current(spark, root)
    store.compact(spark, root)
    assert current(spark, root) == before


def test_append_and_drop(spark, root):
    part = chunks(spark, [("x", "1", "t")])
    assert store.append_collection(part, root, "c") and not store.append_collection(part, root, "c")
    assert store.append_collection(part.withColumn("chunk_id", F.lit("2")), root, "c", force=True)
    assert len(current(spark, root, "c")) == 2
    store.drop_collection(spark, root, "c")
    assert current(spark, root) == [] and not store.has_collection(spark, root, "c")
    assert store.append_collection(part, root, "c") and len(current(spark, root, "c")) == 1


def test_writes_after_compact_and_drop_are_seen(spark, root):
    """Named and unnamed writes, compact and drop share one sequence: the later write is always the newer one."""
    one = lambda i, t: chunks(spark, [("a", i, t)])
    store.upsert_chunks(one("1", "old"), root, "stream-0")
    store.compact(spark, root)
    store.upsert_chunks(one("2", "new"), root, "stream-1")
    store.upsert_chunks(one("1", "changed"), root, "stream-2")
    store.upsert_chunks(one("1", "old"), root, "stream-0")  # a repeated write changes nothing
    assert current(spark, root) == [("a", "1", "changed"), ("a", "2", "new")]
    store.drop_collection(spark, root, "a")
    assert current(spark, root) == [] and not store.has_collection(spark, root, "a")
    store.upsert_chunks(one("3", "x"), root, "stream-3")
    store.upsert_chunks(one("3", "other"), root, "other-0")
    store.upsert_chunks(chunks(spark, [("a", None, "t"), ("a", "4", "y")]), root)
    store.upsert_chunks(chunks(spark, [("a", None, "u")]), root)
    got = [("a", "3", "other"), ("a", "4", "y"), ("a", None, "u")]
    rows = store.scan_collection(spark, root)
    assert sorted(((r.collection, r.chunk_id, r.text) for r in rows.collect()), key=str) == sorted(got, key=str)


def test_filters_reach_the_scan_of_a_store(spark, root):
    rows = spark.range(100).select(F.lit("a").alias("collection"), F.col("id").cast("string").alias("chunk_id"), F.lit("t").alias("text"), (F.col("id") % 10).cast("int").alias("page"))
    plan = lambda: store.scan_collection(spark, root, ["a"]).where("page = 3")._jdf.queryExecution().executedPlan().toString()
    store.upsert_chunks(rows, root)
    assert "EqualTo(page,3)" in plan() and "Exchange" not in plan()
    store.upsert_chunks(rows.where("id < 20"), root)
    assert "EqualTo(page,3)" in plan() and store.scan_collection(spark, root).count() == 100


def test_catalog_and_defaults(spark):
    rows = store.with_defaults(chunks(spark, [("a", "1", "t"), ("a", "2", "t"), ("b", "1", "t")]))
    assert {(r.source, r.page, r.node_type) for r in rows.collect()} == {("", -1, "chunk")}
    models = spark.createDataFrame([("b", "m")], "collection string, embedding_model string")
    got = {r.collection: (r.n_chunks, r.embedding_model) for r in store.collection_catalog(rows, models).collect()}
    assert got == {"a": (2, "default"), "b": (1, "m")}


DOCS = "doc_id long, collection string, source string, text string"


def test_ingest_takes_new_files_only(spark, tmp_path, root):
    inbox = tmp_path / "in"
    inbox.mkdir()
    first = [(i, "c", "s", f"word{i} " * 40) for i in range(5)] + [(99, "c", "s", " ")]
    second = [(2, "c", "s", "word2 " * 40), (7, "c", "s", "seven " * 30)]

    def run():
        stream = spark.readStream.schema(DOCS).parquet(str(inbox))
        ingest.incremental_ingest(stream, root, str(tmp_path / "cp"), lambda d: ingest.chunk_documents(d, 16, 4)).awaitTermination()

    pd.DataFrame(first, columns=["doc_id", "collection", "source", "text"]).to_parquet(inbox / "1.parquet")
    run()
    run()
    pd.DataFrame(second, columns=["doc_id", "collection", "source", "text"]).to_parquet(inbox / "2.parquet")
    run()
    wanted = spark.createDataFrame([r for r in first if r[0] != 99] + second[1:], DOCS)
    batch = sorted(r.chunk_id for r in ingest.chunk_documents(wanted, 16, 4).collect())
    rows = store.scan_collection(spark, root).collect()
    assert sorted(r.chunk_id for r in rows) == batch
    ids = set(batch)
    assert all(r.next_chunk_id is None or r.next_chunk_id in ids for r in rows)
    assert [r.doc_id for r in spark.read.parquet(f"{root}-rejected").collect()] == [99]


HOUR = records.MICROS_PER_HOUR


def asks(spark, times, lost=()):
    rows = [(i, "q", t, i in lost) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, question string, at long, lost boolean")
    return df.withColumn("ts", F.timestamp_micros("at"))


TIMES = [0, HOUR - 1_000_000, HOUR, HOUR + 5, 2 * HOUR - 1, 2 * HOUR, 5 * HOUR]


def test_repeat_boundary(spark):
    # 59:59 after the first ask the stored answer serves, at 1:00:00 it does not.
    out = records.repeat_query_dedup(asks(spark, TIMES), ["question"], "at")
    assert [r.answered_from_store for r in out.orderBy("id").collect()] == [False, True, False, True, True, False, False]
    out = records.repeat_query_dedup(asks(spark, TIMES, {0}), ["question"], "at", fallback="lost")
    assert [r.answered_from_store for r in out.orderBy("id").collect()] == [False, False, True, True, False, True, False]


def drain(spark, stream, shape, tmp_path, name):
    """(results, late rows) of a stream that is run to its end and closed."""
    path, end = str(tmp_path / name), str(tmp_path / f"{name}-end")
    records.open_stream(spark, end, "ts")
    for last in (False, True):
        if last:
            records.close_stream(spark, end, "ts")
        out = shape(records.closing(stream, "ts", end))
        records.write_outputs(out, path, f"{path}-cp").awaitTermination()
    return records.read_outputs(spark, out, path)


def timed(df):
    return df.withColumn("ts", F.timestamp_micros("at"))


def ask_files(spark, folder, parts):
    """The asks of each part as a file, one micro-batch each; (stream, all rows)."""
    folder.mkdir()
    schema = "id long, question string, at long, lost boolean"
    for n, part in enumerate(parts):
        pd.DataFrame(part, columns=["id", "question", "at", "lost"]).to_parquet(folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))), timed(spark.read.schema(schema).parquet(str(folder)))


def asks_shape(df):
    return records.stream_repeat_dedup(df, ["question"], "ts", "at", ["id"], fallback="lost", delay="5 hours")


def tasks_shape(df):
    status = F.when(F.col("id") % 3 != 0, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("status")
    return records.stream_task_state(df.select("question", "ts", "at", status), "question", "ts", "at", ["status"], hours=2, delay="5 hours")


def task_rows(batch):
    return sorted((r.question, r.opened, r.status, r.n_updates) for r in batch.collect())


def test_shuffled_micro_batches_equal_the_batch_form(spark, tmp_path):
    records.use_rocksdb(spark)
    rows = [(i, f"q{i % 2}", 10**15 + i * 17 * 60 * 1_000_000, i % 5 == 0) for i in range(60)]
    # Neighbouring batches overlap by four hours: most rows arrive behind newer ones, none behind the watermark.
    mixed = sorted(rows, key=lambda r: r[0] // 15 * 15 + (r[0] * 7) % 23)
    assert mixed != rows
    parts = [mixed[:20], mixed[20:40], mixed[40:]]
    stream, whole = ask_files(spark, tmp_path / "in", parts)
    want = {r.id: r.answered_from_store for r in records.repeat_query_dedup(whole, ["question"], "at", fallback="lost").collect()}
    got, late = drain(spark, stream, asks_shape, tmp_path, "a")
    assert {r.id: r.answered_from_store for r in got.collect()} == want and len(want) == 60 and late.count() == 0

    status = F.when(F.col("id") % 3 != 0, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("status")
    batch = records.latest_task_state(whole.select("question", "at", status), "question", "at", ["status"], hours=2)
    got, late = drain(spark, stream, tasks_shape, tmp_path, "b")
    newest = got.groupBy("question", "opened").agg(F.max_by(F.struct("n_updates", "status"), "n_updates").alias("r")).select("question", "opened", "r.*")
    assert task_rows(newest) == task_rows(batch) and late.count() == 0


def test_late_rows_go_to_the_side_output(spark, tmp_path):
    records.use_rocksdb(spark)
    t0, hour = 10**15, 3600 * 1_000_000
    first = [(i, "q", t0 + i * hour, False) for i in range(20)]
    second = [(100, "q", t0 + 2 * hour + 5, False), (101, "q", t0 + 3 * hour, False), (20, "q", t0 + 20 * hour, False), (21, "q", t0 + 17 * hour + 9, False)]
    stream, whole = ask_files(spark, tmp_path / "in", [first, second])
    got, late = drain(spark, stream, asks_shape, tmp_path, "a")
    assert sorted((r.id, r.late_at) for r in late.collect()) == [(100, second[0][2]), (101, second[1][2])]
    on_time = whole.where("id < 100")
    want = {r.id: r.answered_from_store for r in records.repeat_query_dedup(on_time, ["question"], "at", fallback="lost").collect()}
    assert {r.id: r.answered_from_store for r in got.collect()} == want and len(want) == 22
    assert want[21] and not want[20]
    assert late.where("answered_from_store IS NOT NULL").count() == 0
    got, late = drain(spark, stream, tasks_shape, tmp_path, "b")
    assert late.count() == 2 and got.agg(F.sum("n_updates")).first()[0] > 0


def test_hooks(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "chunk_id long, text string")

    @F.pandas_udf("array<double>")
    def lengths(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [float(len(t)), 1.0])

    assert [r.vector for r in hooks.embed(rows, lengths).orderBy("chunk_id").collect()] == [[3.0, 1.0], [1.0, 1.0]]
    chained = hooks.wrap(lambda q, c: c, lambda df: df.where("chunk_id > 1"), lambda df: df.select("chunk_id"))
    assert [r.chunk_id for r in chained(rows, rows).collect()] == [2]


def test_postings_are_moved_packed_and_stored_small(spark, tmp_path):
    """Counts and lengths above 16 bits come back from the number they are moved in; what is stored is compressed tightly."""
    import glob

    import pyarrow.parquet as pq
    from lectern.operators import keyword

    chunks = spark.createDataFrame([("a-1", "often " * 70_000 + "once rare"), ("a-2", "often twice twice"), (None, "rare")], "chunk_id string, text string")
    index = keyword.write_index(chunks, str(tmp_path / "index"))
    got = {(r.chunk_id, r.term): (r.tf, r.dl) for r in index.postings.collect()}
    assert got == {
        ("a-1", "often"): (70_000, 70_002), ("a-1", "once"): (1, 70_002), ("a-1", "rare"): (1, 70_002),
        ("a-2", "often"): (1, 3), ("a-2", "twice"): (2, 3), (None, "rare"): (1, 1),
    }
    files = glob.glob(str(tmp_path / "index/blocks/*/*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    rows = keyword.postings(chunks)
    plan = keyword.posting_blocks(rows, keyword.corpus_stats(chunks), (), 32)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression") :].split("\n")[1]
    assert "_n#" in moved and "bucket" not in moved and "AS impact" not in moved
