"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connection

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_equals_sql(spark, duck, name):
    assert compare(spark, SF, entry.queries()[name], TWINS[name], duck) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(TWINS)))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]


def test_no_query_multiplies_tables(spark, capsys):
    for name in ("bm25_topk", "dense_topk", "kg_expand", "silver_labels", "duplicate_groups", "term_graph", "empty_tables"):
        entry.queries()[name](spark, SF).explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_a_document_of_many_chunks_keeps_its_ids(spark, tmp_path):
    """Document 5 has more than 10 000 windows: none of them is taken for one of document 6."""
    from lectern.plans.collections import _children

    rows = [(5, "w " * (48 * 10_001 + 20), "en", "s", 0), (6, "other words " * 300, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    ids = _children(spark, str(tmp_path)).select("chunk_id")
    n = ids.count()
    assert n > 10_010 and ids.distinct().count() == n
    own = {r.chunk_id: r.n_children for r in entry.queries()["rebuild_parents"](spark, str(tmp_path)).collect()}
    windows = {5: 10_002, 6: n - 10_002}
    assert own == {doc: sum(i % 7 != 6 for i in range(m)) for doc, m in windows.items()}


@pytest.mark.parametrize("name, step", [("hit_by_group", "InPandas"), ("corrected_hit_rate", "InPandas"), ("scenario_accuracy", "InPandas"), ("compare_scenarios", "InPandas"),
                                        ("swap_parents", "regexp_extract_all"), ("expand_neighbours", "regexp_extract_all"), ("build_postings", "(_jk")])
def test_costly_steps_are_not_run_again(spark, capsys, name, step):
    """What is read several times is stored; blocks of postings meet their terms without a shuffle where these are few."""
    entry.queries()[name](spark, SF).explain()
    assert step not in capsys.readouterr().out


@pytest.mark.parametrize("files", [0, 3])
def test_ingest_reads_a_table_in_one_file_or_a_folder(spark, tmp_path, files):
    import pandas as pd

    rows = [(i, f"word{i} " * 300, "en", "s", 0) for i in range(12)]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    path = tmp_path / "documents.parquet"
    if files:
        spark.createDataFrame(frame).repartition(files).write.parquet(str(path))
    else:
        frame.to_parquet(path)
    got = entry.queries()["incremental_ingest"](spark, str(tmp_path))
    assert got.count() == 12 * 3 and got.where("prev_chunk_id IS NULL").count() == 12


def test_left_out_where_a_package_is_absent(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "xxhash":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("lectern.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    assert "bm25_topk" in entry.queries() and "pipeline" not in entry.queries()
