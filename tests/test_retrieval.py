"""Retrieval operators on small rows: exactness of both vector ways, fusion rules, context rules."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import sizing
from lectern.operators import context, dense, evaluate, fusion, graph, keyword, summaries


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8)).round(2)
    # A third of all rows share one key, some vectors are equal (ties are broken by id).
    rows = [(i, [float(x) for x in m[i % 250]], 0 if i % 3 == 0 else i % 17) for i in range(300)]
    return rows, spark.createDataFrame(rows, "chunk_id long, vector array<float>, page int").cache()


def brute(rows, k, same_key=False):
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    scores = np.round(v @ v.T, 6)
    out = {}
    for i, (qid, _, key) in enumerate(rows):
        cand = [(-scores[i, j], r[0]) for j, r in enumerate(rows) if not same_key or r[2] == key]
        out[qid] = [c for _, c in sorted(cand)[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.mark.parametrize("key", [None, "page"])
@pytest.mark.parametrize("bound", [1000, 10])
def test_dense_ways_are_exact(vectors, key, bound):
    rows, items = vectors
    queries = items.select(F.col("chunk_id").alias("query_id"), "vector", "page")
    got = dense.dense_topk(queries, items, 5, key=key, query_rows=bound, cell_rows=40)
    assert by_query(got) == brute(rows, 5, key is not None)


def plain_search(ids, v, k):
    out = []
    for i, q in zip(ids, v):
        best = sorted((-round(float(x @ q), 6) + 0.0, j) for j, x in zip(ids, v))[: k + 1]
        out += [(i, j, -s) for s, j in best if j != i][:k]
    return sorted(out)


def test_cell_of_equal_vectors_stays_in_bounded_memory():
    n, rng = 2500, np.random.default_rng(4)
    v = np.repeat(dense.unit_rows(rng.normal(size=(1, 64))), n, axis=0)
    tracemalloc.start()
    found = dense._search(np.arange(n), v, np.arange(n), v, 3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    assert found.groupby("query_id")["chunk_id"].apply(list).tolist() == [[j for j in range(5) if j != i][:3] if i < 4 else [0, 1, 2] for i in range(n)]


@pytest.mark.parametrize("block", [1, 50, 4_000_000])
def test_cell_with_near_ties(monkeypatch, block):
    monkeypatch.setattr(dense, "PRODUCT_SIZE", block)
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 37)
    monkeypatch.setattr(dense, "EXACT_VALUES", 60)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(12, 6))[rng.integers(0, 12, 150)] + rng.choice([0, 1e-7, 3e-6], size=(150, 1))
    v = dense.unit_rows(v)
    got = dense._search(np.arange(150), v, np.arange(150), v, 4, True)
    assert sorted((i, j, round(s, 6)) for i, j, s in got.itertuples(index=False)) == [(i, j, round(s, 6)) for i, j, s in plain_search(range(150), v, 4)]


def test_cells_equal_exact_search_when_all_are_probed(vectors):
    rows, items = vectors
    queries = items.select(F.col("chunk_id").alias("query_id"), "vector")
    exact = brute(rows, 5)
    assert by_query(dense.dense_topk_cells(queries, items, 5, n_cells=4, n_probe=4, cell_rows=60)) == exact
    recall = []
    for n in (1, 2, 4):
        got = by_query(dense.dense_topk_cells(queries, items, 5, n_cells=4, n_probe=n))
        recall.append(sum(len(set(got[q]) & set(exact[q])) for q in exact))
    assert recall == sorted(recall)


def test_a_cell_is_searched_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    v = rng.normal(size=(12_000, 16)).round(1)
    v[6000:9000] = v[:3000]  # equal scores are told apart by id
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    ids = rng.permutation(12_000)
    tracemalloc.start()
    got = dense._search(ids[:4000], v[:4000], ids, v, 10, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6
    found = got.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("query_id")["chunk_id"].agg(list)
    for i in range(0, 4000, 97):
        scores = np.round(v[i] @ v.T, 6)
        assert found[ids[i]] == [int(ids[j]) for j in sorted(range(12_000), key=lambda j: (-scores[j], ids[j])) if j != i][:10]


def test_pairs_are_not_rows_of_the_plan(spark, tmp_path, monkeypatch, capsys):
    """A (query, chunk) pair that shares a term is added up where it lies, also over batches and bounds of tasks."""
    chunks, index = small_index(spark, tmp_path, monkeypatch)
    queries = spark.createDataFrame([(i, f"common some extra{i} filler common") for i in range(40)], "query_id long, text string")
    whole = keyword.bm25_topk(queries, index, 7)
    whole.explain()
    assert "keys=[query_id" not in capsys.readouterr().out
    want = sorted(tuple(r) for r in whole.collect())
    assert len(want) == 280
    monkeypatch.setattr(keyword, "PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(tuple(r) for r in keyword.bm25_topk(queries, index, 7).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_slices_change_nothing(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"common word{i % 5} word{i % 7} extra{i}") for i in range(60)], "chunk_id long, text string")
    queries = spark.createDataFrame([(i, f"common word{i % 5} extra{i}") for i in range(20)], "query_id long, text string")
    index = keyword.index_of(chunks)
    whole = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in keyword.bm25_topk(queries, index, 5).collect()}
    monkeypatch.setattr(keyword, "BROADCAST_ROWS", 12)
    sliced = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in keyword.bm25_topk(queries, index, 5).collect()}
    assert whole == sliced and len(whole) == 100
    assert all(whole[(q, 1)][0] == q for q in range(20))


def small_index(spark, path, monkeypatch, n=3000):
    """Every chunk has ``common``; one in seven has ``some``; each a word of its own; impacts differ by length and count."""
    monkeypatch.setattr(keyword, "BLOCK_POSTINGS", 8)
    monkeypatch.setattr(keyword, "SHARD_POSTINGS", 500)
    text = [" ".join(["common"] * (1 + i % 5) + ["some"] * (i % 7 == 0) * (1 + i % 3) + [f"extra{i}"] + ["filler"] * (i % 11)) for i in range(n)]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "chunk_id long, text string")
    return chunks, keyword.write_index(chunks, str(path / "index"))


def test_index_reads_the_buckets_of_the_query_terms(spark, tmp_path, monkeypatch, capsys):
    chunks, index = small_index(spark, tmp_path, monkeypatch)
    queries = spark.createDataFrame([(1, "common extra77"), (2, "some extra5")], "query_id long, text string")
    weights = keyword.query_weights(queries, index)
    wanted = keyword.wanted_blocks(weights, index)
    files = lambda df: df.select("_metadata.file_path").distinct().count()
    assert files(index.blocks) > 30
    assert files(index.blocks.where(F.col("bucket").isin(keyword._wanted(weights)))) <= 4
    keyword.bm25_topk(queries, index).explain("formatted")
    assert "PartitionFilters: [isnotnull(bucket" in (plan := capsys.readouterr().out) or "bucket#" in plan.split("PartitionFilters")[1][:200]
    assert wanted.count() > 0


def test_blocks_below_the_bound_are_passed_over(spark, tmp_path, monkeypatch):
    chunks, index = small_index(spark, tmp_path, monkeypatch)
    queries = spark.createDataFrame([(1, "common"), (2, "some"), (3, "common some"), (4, "extra9 filler"), (5, "nowhere")], "query_id long, text string")
    for k in (1, 10, 37, 100, 400):
        got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in keyword.bm25_topk(queries, index, k).collect()}
        whole = keyword.query_weights(queries, index, k, bounded=False)
        assert keyword.wanted_blocks(whole, index).agg(F.sum("n")).first()[0] > 5000
        monkeypatch.setattr(keyword, "query_weights", lambda q, i, k=10, bounded=True, real=keyword.query_weights: real(q, i, k, False))
        assert got == {(r.query_id, r.rank): (r.chunk_id, r.score) for r in keyword.bm25_topk(queries, index, k).collect()}
        monkeypatch.undo()
    one = keyword.query_weights(queries.where("query_id < 3"), index, 10)
    assert keyword.wanted_blocks(one, index).agg(F.sum("n")).first()[0] < 1500


def test_shards_of_a_frequent_term_are_bounded(spark, tmp_path, monkeypatch):
    chunks, index = small_index(spark, tmp_path, monkeypatch)
    sizes = {r.shard: r.n for r in index.blocks.where("term = 'common'").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert len(sizes) == 6 and max(sizes.values()) < 700 and sum(sizes.values()) == 3000
    assert index.blocks.agg(F.max("n")).first()[0] == 8
    assert index.terms.where("term = 'common'").first().df == 3000


def test_postings_are_counted_in_the_row(spark, capsys):
    chunks = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "word word Word x")], "chunk_id long, text string")
    posted = keyword.postings(chunks)
    assert sorted(tuple(r) for r in posted.select("chunk_id", "term", "tf", "dl").collect()) == [(4, "word", 3, 3)]
    posted.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_skewed_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(sizing, "HOT_KEYS", 2)
    facts = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    dim = facts.groupBy("key").agg(F.count("*").alias("n")).where("key <> 'k7'")
    want = sorted(tuple(r) for r in facts.join(dim, "key").select("key", "id", "n").collect())
    assert sorted(tuple(r) for r in sizing.join_skewed(facts, dim, "key", "n", F.col("id")).collect()) == want


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, rank int")


def test_fusion_ignores_list_order_and_keeps_all(spark):
    a = ranked(spark, [(1, 10, 1), (1, 11, 2), (1, 12, 3)])
    b = ranked(spark, [(1, 12, 1), (1, 13, 2)])
    one = {r.chunk_id: r.score for r in fusion.hybrid_rrf(a, b).collect()}
    two = {r.chunk_id: r.score for r in fusion.hybrid_rrf(b, a).collect()}
    assert one == two and set(one) == {10, 11, 12, 13}
    assert one[12] == round(0.5 / 61 + 0.5 / 63, 9)


def test_merge_keeps_last_of_equal_prefixes(spark):
    rows = [(1, 0, 10, 1, "same text A"), (1, 1, 20, 1, "same text B"), (1, 1, 21, 2, "other")]
    lists = spark.createDataFrame(rows, "query_id long, list_id int, chunk_id long, rank int, text string")
    got = fusion.rrf_merge(lists, prefix=9).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(20, round(2 / 61, 9)), (21, round(1 / 62, 9))]


def test_bilingual_without_translation_keeps_own_order(spark):
    rows = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 11, 2), (2, 0, 10, 1), (2, 1, 12, 1)], "query_id long, variant int, chunk_id long, rank int")
    chunks = spark.createDataFrame([(10, "t"), (11, "t"), (12, "u")], "chunk_id long, text string")
    got = {q: [r.chunk_id for r in fusion.bilingual(rows, chunks).where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert got == {1: [10, 11], 2: [10, 12]}


def test_partner_names(spark):
    catalog = spark.createDataFrame([(c,) for c in ("a", "a_en", "b_zh", "b_en", "c_en", "d")], "collection string")
    got = {r.collection: r.partner for r in fusion.partner_collection(catalog, catalog).collect()}
    assert got == {"a": "a_en", "a_en": "a", "b_zh": "b_en", "b_en": "b_zh", "c_en": None, "d": None}


def test_parents_and_neighbours(spark):
    hits = spark.createDataFrame([(1, 11, 1, 0.9), (1, 12, 2, 0.8), (1, 30, 3, 0.7)], "query_id long, chunk_id long, rank int, score double")
    children = spark.createDataFrame([(11, 1), (12, 1), (30, None)], "chunk_id long, parent_chunk_id long")
    parents = spark.createDataFrame([(1,)], "chunk_id long")
    got = [(r.chunk_id, r.score) for r in context.swap_parents(hits, children, parents).orderBy("rank").collect()]
    assert got == [("1", 0.9), ("30", 0.7)]
    links = spark.createDataFrame([(10, None, 11), (11, 10, 12), (12, 11, 13), (13, 12, None), (30, 29, 31)], "chunk_id long, prev_chunk_id long, next_chunk_id long")
    got = [(r.chunk_id, r.score) for r in context.expand_neighbours(hits, links).orderBy("rank").collect()]
    assert got == [(11, 0.9), (12, 0.8), (30, 0.7), (10, 0.0), (13, 0.0)]


def test_gate(spark):
    rows = [(1, 0, 0.4), (1, 1, 0.6), (2, 0, 0.1), (2, 1, 0.2), (2, 2, 0.3), (3, 0, 0.1), (4, 0, 0.5)]
    scores = spark.createDataFrame(rows, "query_id long, attempt int, score double")
    got = {r.query_id: (r.attempt, r.decision) for r in context.retrieval_gate(scores).collect()}
    assert got == {1: (1, "generate"), 2: (2, "fallback"), 3: (0, "rewrite"), 4: (0, "generate")}
    zero = scores.withColumn("threshold", F.lit(0.0)).withColumn("max_retry", F.lit(None).cast("int"))
    assert {r.attempt for r in context.retrieval_gate(zero).collect()} == {0}  # a threshold of 0 is kept


def test_graph_orders_by_hop_and_shared(spark):
    edges = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "a"), (1, "d"), (6, "d")], "chunk_id long, entity string")
    base = ranked(spark, [(1, 1, 1)])
    entities = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, entity string")
    got = [(r.chunk_id, r.hop) for r in graph.kg_expand(base, entities, edges, k=5).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 1), (3, 1), (5, 1), (6, 2)]
    assert graph.kg_expand(base, entities, edges, k=1).count() == 1
    assert [r.chunk_id for r in graph.local_search(base, entities, edges).orderBy("rank").collect()] == [1, 2, 3, 5]


def test_hit_rates_count_all_labelled_queries(spark):
    truth = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 30)], "query_id long, chunk_id long")
    found = ranked(spark, [(1, 10, 1), (2, 21, 4), (2, 20, 7), (9, 1, 1)])
    r = evaluate.hit_at_k(evaluate.first_hits(found, truth)).first()
    assert (r.n_evaluated, r.hit_at_1, r.hit_at_3, r.hit_at_5, r.mrr) == (3, 0.3333, 0.3333, 0.6667, round((1 + 0.25) / 3, 4))


def test_equal_values_of_two_dimensions_stay_apart(spark):
    first = spark.createDataFrame([(1, 1), (2, None)], "query_id long, rank int")
    groups = spark.createDataFrame([(1, "x", "x"), (2, None, "x")], "query_id long, a string, b string")
    got = {(r.dimension, r.value): (r.n, r.hit_at_1) for r in evaluate.hit_by_group(first, groups, ["a", "b"]).collect()}
    assert got == {("a", "x"): (1, 1.0), ("a", "unknown"): (1, 0.0), ("b", "x"): (2, 0.5)}


def test_clusters(spark, vectors):
    _, items = vectors
    chunks = items.select("chunk_id", F.concat(F.lit("text "), F.col("chunk_id").cast("string")).alias("text"), "vector")
    model = summaries.fit_clusters(chunks, 4, n_init=2)
    groups = summaries.assign_clusters(chunks, model)
    assert groups.count() == 300 and groups.select("chunk_id").distinct().count() == 300
    rows = summaries.group_summaries(groups, "raptor_summary_", 8, 300)
    assert rows.agg(F.sum("n_members")).first()[0] == 300 and rows.count() == 4
    assert summaries.cluster_count(3) == 2 and summaries.cluster_count(1000) == 10 and summaries.cluster_count(40) == 5


def test_postings_of_frequent_terms_are_dealt_over_tasks(spark, monkeypatch):
    """A task holds its files' postings alone, whatever the number of shuffle partitions is, and not the whole of a term."""
    monkeypatch.setattr(keyword, "SHARD_POSTINGS", 50)
    monkeypatch.setattr(keyword, "PIECE_SHARDS", 2)
    chunks = spark.range(4000).selectExpr("id AS chunk_id", "concat('every common w', id % 200, ' v', id % 300) AS text")
    counts = keyword.counted(chunks)
    blocks = keyword.posting_blocks(keyword.exploded(counts), keyword.stats_of(counts), [], 32)
    held = [r["n"] for r in blocks.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert sum(held) == 16_000 and max(held) < 2000
    df = {r["term"]: r["df"] for r in keyword.term_table(blocks, []).collect()}
    assert df["every"] == df["common"] == 4000 and len(df) == 502


def test_dealt_rows_ask_for_partitions(spark, monkeypatch):
    monkeypatch.setattr(sizing, "TASK_ROWS", 10)
    rows = spark.range(1000).withColumnRenamed("id", "k")
    placed = sizing.dealt(rows, 1000, "k")
    assert placed.rdd.getNumPartitions() == 100 and placed.distinct().count() == 1000
    assert sizing.dealt(rows, 20, "k").rdd.getNumPartitions() <= 8


def test_rerank_takes_a_user_scorer(spark):
    import pandas as pd

    from lectern.functions.text import token_f1

    @F.pandas_udf("double")
    def shorter_is_better(query: pd.Series, text: pd.Series) -> pd.Series:
        return 1.0 / text.str.len()

    cands = ranked(spark, [(1, 10, 1), (1, 11, 2), (1, 12, 3)])
    queries = spark.createDataFrame([(1, "red pump")], "query_id long, text string")
    chunks = spark.createDataFrame([(10, "red pump and more words"), (11, "pump"), (12, "red pump")], "chunk_id long, text string")
    got = [r.chunk_id for r in context.rerank_topn(cands, queries, chunks, 2, shorter_is_better).orderBy("rank").collect()]
    assert got == [11, 12]
    own = context.rerank_topn(cands, queries, chunks, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in own] == [(12, 1.0), (11, 0.666667), (10, 0.571429)]
    same = context.rerank_topn(cands, queries, chunks, 3, token_f1).orderBy("rank").collect()
    assert own == same
