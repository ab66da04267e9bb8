import pytest

from lodestone.catalogue import ORACLES, QUERIES

from .compare import of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    assert of_spark(QUERIES[name](spark, data)) == of_duckdb(ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20


def test_filters_reach_the_scan(spark, data):
    """A term of a persisted index is pushed to Parquet, and only the needed columns are read."""
    from lodestone.operators.fulltext import phrase_hits, postings
    from lodestone.functions.text import parse_query

    docs = spark.createDataFrame([("1", "a b"), ("2", "b c")], "id string, content string")
    path = spark.conf.get("spark.checkpoint.dir") + "/postings"
    postings(docs, ["content"], stemmed=False).write.mode("overwrite").parquet(path)
    plan = phrase_hits(spark.read.parquet(path), parse_query("b", False))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1].split("]")[0]


def test_listed_files_has_a_row_for_a_table_that_is_a_folder(spark, data, tmp_path):
    from pathlib import Path

    for p in Path(data).iterdir():
        if p.stem != "documents":
            (tmp_path / p.name).symlink_to(p)
    spark.read.parquet(f"{data}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert of_spark(QUERIES["listed_files"](spark, str(tmp_path))) == of_duckdb(ORACLES["listed_files"], data)


def test_postings_are_stored_once_for_a_null_path_and_any_id(spark):
    from lodestone.operators.fulltext import packed, postings, unpacked

    rows = [("a b", "/p q", "x y"), ("", "", "z"), ("7", None, "x"), (None, "/é", "x")]
    docs = spark.createDataFrame(rows, "id string, file_path string, content string")
    got, want = unpacked(packed(docs, stemmed=False, columns=["content"])), postings(docs, ["content"], stemmed=False, carry=["file_path"])
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count() == 5


def test_indexes_are_written_in_tasks_that_do_not_spill(spark, data):
    """The texts of the index are dealt out by size, and settings are as they were."""
    from lodestone.plans.queries import _index
    from lodestone.sources.scratch import SMALL_TASKS

    before = {k: spark.conf.get(k, None) for k in SMALL_TASKS}
    index = _index(spark, f"{data}/", ["content"], False)[0]
    assert {k: spark.conf.get(k, None) for k in SMALL_TASKS} == before
    assert "place" in index._jdf.queryExecution().analyzed().toString()
