"""The jobs as queries over the given tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_feed, saved_searches
from jobs.common import settings
from lodestone.plans.oracles import tokens_sql, windows_sql
from lodestone.sources.scratch import shared_dir

CONFIGS = Path(__file__).parent


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the index after two runs over documents, the second of which finds nothing new."""
    folder, own = _folder(spark, "job1"), settings(index_feed.Settings, CONFIGS / "index_feed.toml")
    for _ in range(2):
        index_feed.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint", own)
    return index_feed.output(spark, f"{folder}/index").select("kind", "language", "file_path", "id", "start_line", "end_line", "content_hash", "n_tokens")


def job2_saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to all benchmark items after two runs over all documents."""
    folder, own = _folder(spark, "job2"), settings(saved_searches.Settings, CONFIGS / "saved_searches.toml")
    for _ in range(2):
        saved_searches.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/answers", f"{folder}/work", own)
    return saved_searches.output(spark, f"{folder}/answers").withColumn("rank", F.round("rank", 6))


_FILES = """select '/' || coalesce(nullif(source, ''), 'none') || '/' || coalesce(nullif(lang, ''), 'none') || '/' || doc_id || '.txt' as file_path, coalesce(text, '') as content,
  coalesce(nullif(lang, ''), 'none') as language from documents where doc_id is not null"""

JOB1_SQL = f"""
with files as ({_FILES}), parts as ({windows_sql("select * from files")})
select 'chunk' as kind, language, file_path, id, start_line, end_line, content_hash, len({tokens_sql("content")})::integer as n_tokens from parts
union all
select 'file', language, file_path, null, 0, (len(string_split(content, chr(10))) - 1)::integer, sha256(content), len({tokens_sql("content")})::integer from files
"""

JOB2_SQL = f"""
with d as (select doc_id, max(coalesce(nullif(lang, ''), 'none')) as language from documents where doc_id is not null group by doc_id),
told as (select row_number() over () as line, doc_id, {tokens_sql("text")} as ts from documents where doc_id is not null),
corpus as (select count(*)::double as n, sum(len(ts))::double / count(*) as avgdl from told where len(ts) > 0),
spread as (select line, doc_id, len(ts) as dl, unnest(ts) as term from told),
counts as (select doc_id, term, count(*) as tf, max(dl) as dl from spread group by doc_id, term),
df as (select term, count(distinct line)::double as df from spread group by term),
asked as (select distinct item_id, unnest({tokens_sql("text")}) as term from benchmark),
ranked as (select item_id, term, df, row_number() over (partition by item_id order by df, term) as k from asked join df using (term)),
search as (select item_id, term, df, count(*) over (partition by item_id) as terms from ranked where k <= 2),
scored as (
  select item_id, doc_id, -sum(case when ln((n - df + 0.5e0) / (df + 0.5e0)) <= 0 then 1e-6 else ln((n - df + 0.5e0) / (df + 0.5e0)) end
    * ((tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) order by term) as rank
  from search join counts using (term) cross join corpus group by item_id, doc_id having count(*) = max(terms)
), placed as (select *, row_number() over (partition by item_id order by rank, doc_id) as place from scored)
select item_id, place::integer as place, doc_id, round(rank, 6) as rank, language from placed join d using (doc_id) where place <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_index_feed": job1_index_feed, "job2_saved_searches": job2_saved_searches}
ORACLES = {"job1_index_feed": JOB1_SQL, "job2_saved_searches": JOB2_SQL}
