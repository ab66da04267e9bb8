"""SQL that gives the same rows as the queries, for an engine that has none of our code."""

from __future__ import annotations

from ..functions.context import prompt

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FILES = "select '/' || source || '/' || lang || '/' || doc_id || '.txt' as file_path, text as content, lang as language, doc_id from documents"
_SIM = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"
_Q = "(select embedding, label from embeddings where vec_id = 0) q"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(translate(coalesce({c}, ''), '{_UP}', '{_LOW}'), '{_TOKEN}')"


def windows_sql(files: str, size: int = 20, overlap: int = 5) -> str:
    return f"""
    select sha256(file_path || ':' || s || ':' || (least(s + {size}, n) - 1)) as id, file_path, language, cast(s as integer) as start_line, cast(least(s + {size}, n) - 1 as integer) as end_line,
           array_to_string(list_slice(ls, s + 1, least(s + {size}, n)), chr(10)) as content, sha256(array_to_string(list_slice(ls, s + 1, least(s + {size}, n)), chr(10))) as content_hash
    from (select file_path, language, ls, n, unnest(range(0, n, {size - overlap})) as s
          from (select file_path, language, string_split(content, chr(10)) as ls, len(string_split(content, chr(10))) as n from ({files})))
    where trim(array_to_string(list_slice(ls, s + 1, least(s + {size}, n)), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"""


def _bm25(cols: list[str], phrases: list[tuple[list[str], bool]], name: str = "bm") -> str:
    """CTEs that end in one with id and rank of the documents in which all phrases occur."""
    parts = [f"tok{c} as (select doc_id as id, {c} as col, {tokens_sql(x)} as ws from ({_FILES}))" for c, x in enumerate(cols)]
    union = " union all ".join(f"select id, col, ws from tok{c}" for c in range(len(cols)))
    parts.append(f"tok as ({union})")
    parts.append("dl as (select id, sum(len(ws)) as dl from tok group by id having sum(len(ws)) > 0)")
    parts.append("corpus as (select cast(count(*) as double) as n, cast(sum(dl) as double) / count(*) as avgdl from dl)")
    parts.append("pos as (select id, col, ws, unnest(range(1, len(ws) + 1)) as p from tok)")
    for k, (terms, start) in enumerate(phrases):
        same = " and ".join(f"ws[p + {o}] in ('{t}')" if isinstance(t, str) else f"ws[p + {o}] in {t}" for o, t in enumerate(terms))
        parts.append(f"hit{k} as (select id, cast(count(*) as double) as tf from pos where {same}{' and p = 1' if start else ''} group by id)")
        parts.append(f"idf{k} as (select case when ln((n - df + 0.5e0) / (df + 0.5e0)) <= 0 then 1e-6 else ln((n - df + 0.5e0) / (df + 0.5e0)) end as idf from corpus, (select cast(count(*) as double) as df from hit{k}))")
    joins = " ".join(f"join hit{k} on hit{k}.id = dl.id" for k in range(len(phrases)))
    total = " + ".join(f"(select idf from idf{k}) * ((hit{k}.tf * 2.2e0) / (hit{k}.tf + 1.2e0 * (0.25e0 + 0.75e0 * dl.dl / avgdl)))" for k in range(len(phrases)))
    parts.append(f"{name} as (select dl.id, -({total}) as rank from dl {joins} cross join corpus)")
    return ",\n".join(parts)


def _top_bm25(phrases: list[tuple[list[str], bool]]) -> str:
    return f"with {_bm25(['content'], phrases)} select id, round(rank, 6) as rank from bm order by bm.rank, id limit 20"


def _fuzzy(items: str, q: str) -> str:
    """Recursive CTEs over the characters of items(id, t) that end in fz(id, score)."""
    camel = "(i > 0 and prev = lower(prev) and cur = upper(cur))"
    return f"""
ch as (select id, t, i, substr(t, cast(i as bigint) + 1, 1) as cur, case when i = 0 then '' else substr(t, cast(i as bigint), 1) end as prev, length(t) - length(regexp_extract(t, '([^/\\\\]*)$', 1)) - 1 as name_at
       from (select id, t, unnest(range(0, length(t))) as i from ({items}))),
fold as (select id, -1 as i, 0 as k, -1 as last, -1 as first, 0 as run, 0 as named, cast(0 as double) as score from ({items})
         union all
         select f.id, cast(c.i as integer), case when hit then k + 1 else k end, case when hit then cast(c.i as integer) else last end, case when hit and first < 0 then cast(c.i as integer) else first end,
                case when hit then nrun else run end, case when hit and c.i >= name_at then named + 1 else named end, case when hit then score + gain else score end
         from (select f.*, c.i as ci, c.name_at, k < {len(q)} and lower(c.cur) = substr('{q}', cast(k as bigint) + 1, 1) as hit, case when c.i = last + 1 then run + 1 else 0 end as nrun,
                      1e0 + 5e0 * (case when c.i = last + 1 then run + 1 else 0 end)
                      + case when c.i = 0 or c.prev in (' ', '-', '_', '/', '\\') or (c.i > 0 and c.prev = lower(c.prev) and c.cur = upper(c.cur)) then 10e0 else 0e0 end
                      + case when c.prev in ('/', '\\') then 15e0 else 0e0 end
                      + case when c.i > 0 and c.prev = lower(c.prev) and c.cur = upper(c.cur) then 8e0 else 0e0 end as gain
               from fold f join ch c on c.id = f.id and c.i = f.i + 1) f join (select id, i from ch) c on c.id = f.id and c.i = f.ci),
fz as (select fold.id, score - 0.1e0 * (last - first) + 3e0 * named as score from fold join (select id, max(i) as m from ch group by id) e on e.id = fold.id and e.m = fold.i where k = {len(q)})
""".replace(camel, camel)


_ARMS = f"""
v as (select e.vec_id as id, {_SIM} as s from embeddings e, {_Q} where e.vec_id in (select doc_id from documents)),
a0 as (select 0 as arm, id, row_number() over (order by s desc, id) as r from (select * from v order by s desc, id limit LIM)),
a1 as (select 1 as arm, id, row_number() over (order by rank, id) as r from (select * from bm order by rank, id limit LIM)),
a2 as (select 2 as arm, id, row_number() over (order by score desc, id) as r from (select * from fz order by score desc, id limit LIM)),
arms as (select * from a0 union all select * from a1 union all select * from a2),
fused as (select id, coalesce(sum(case when arm = 0 then 1e0 / (60e0 + r) end), 0e0) + coalesce(sum(case when arm = 1 then 1e0 / (60e0 + r) end), 0e0) + coalesce(sum(case when arm = 2 then 1e0 / (60e0 + r) end), 0e0) as score,
                 min(arm * 1000000 + r) as met from arms group by id),
best as (select * from fused order by score desc, met limit TOP),
norm as (select *, (score - min(score) over ()) / (case when max(score) over () = min(score) over () then 1e0 else max(score) over () - min(score) over () end) as similarity from best)
"""


def _hybrid(limit: int) -> str:
    return f"""with recursive {_bm25(["file_path", "content"], [(["es"], False)])},
{_fuzzy(f"select doc_id as id, file_path as t from ({_FILES})", "es")},
{_ARMS.replace("LIM", str(2 * limit)).replace("TOP", str(limit))}"""


# Lines of the sources' templates by the id's remainder: start, end, function and class.
_TEMPLATES = "(values (0, 2, 4, 'f#', null), (0, 5, 8, null, 'C#'), (1, 0, 5, 'f#', null), (1, 7, 9, null, 'C#'), (2, 0, 0, null, 'T#'), (3, 0, 3, 'catch', null), (4, 0, 2, 'f#', null), (5, 0, 1, 'Run#', null), (5, 3, 4, null, 'S#'), (6, 0, 0, null, 'c#'), (6, 1, 2, 'm#', null), (7, 0, 1, null, null)) t(k, s, e, fn, cl)"
_PY = "import os||def f#(x):|    return x||class C#:|    def m(self):|        pass|"
_SOURCES = " union all ".join(
    f"select doc_id, string_split(replace('{text}', '#', doc_id::varchar), '|') as ls from documents where doc_id % 8 = {k}"
    for k, text in enumerate([_PY, "function f#(a) {|  if (a) {|    g();|  }|  return a;|}|const z = 1;|class C# {|  m(x) { return x; }|}|", "function f#() { type T# = 1; }|}|", "} catch (e#) {|  if (q) {|    r();|  }|}|rest();|", "const f# = (a) => a;|const g = 2;|let h = 3;", "func (r *T#) Run#() {|}||type S# struct {|}|", ".c# { x }|@mixin m# {|}|", "x = #|"])
)
_V2 = f"select file_path, case when language = 'fr' then content || chr(10) || 'edited' else content end as content, language from ({_FILES}) where language <> 'de'"
_NAMED = f"select doc_id as id, file_path, content, len(string_split(content, chr(10))) - 1 as end_line, case when language = 'en' then language end as fn, case when language = 'de' then language end as cl, language from ({_FILES})"
_SPACES = r"[ \t\n\x0B\f\r\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"

_SHOWN = f"select *, file_path as path, case when language = 'en' then ' · method en' when language = 'de' then ' · class de' else '' end as tag, replace(substr(content, 1, 150), chr(10), ' ') as cut from ({_NAMED})"

# Spans of HTML, line by line: base is what braces above a line add up to, be the line where its block ends.
_HTML_SPANS = r"""with recursive l as (select page_id, url, string_split(html, chr(10)) as ls from pages),
t as (select page_id, url, ls[i + 1] as s, i, n from (select *, unnest(range(0, len(ls))) as i, len(ls) as n from l)),
x as (select page_id, url, i, n, s, regexp_matches(s, '<script[^>]*>') as script, regexp_matches(s, 'class="[^"]+"') as classed from t),
k as (select page_id, url, i, n, script or regexp_matches(s, 'function\s+[A-Za-z0-9_]') as has_fn, case when not script then nullif(regexp_extract(s, 'function\s+([A-Za-z0-9_]+)', 1), '') end as fn,
             classed or regexp_matches(s, 'id="[^"]+"') as has_cl, case when classed then regexp_extract(s, 'class="([^"]+)"', 1) else nullif(regexp_extract(s, 'id="([^"]+)"', 1), '') end as cl,
             len(regexp_extract_all(s, '\{')) as ups, len(regexp_extract_all(s, '\}')) as downs from x),
z as (select *, coalesce(sum(ups - downs) over w, 0) as base, coalesce(sum(ups) over w, 0) as opened from k window w as (partition by page_id order by i rows between unbounded preceding and 1 preceding)),
c as (select page_id, i, unnest(regexp_extract_all(s, '[{}]')) as c, generate_subscripts(regexp_extract_all(s, '[{}]'), 1) as p from x),
b as (select page_id, i, c, sum(case when c = '{' then 1 else -1 end) over o as cum, sum(case when c = '{' then 1 else 0 end) over o as opened from c window o as (partition by page_id order by i, p)),
e as (select z.page_id, z.i, min(b.i) as be from z join b on b.page_id = z.page_id and b.i >= z.i and b.c = '}' and b.cum = z.base and b.opened > z.opened group by z.page_id, z.i),
m as (select z.*, coalesce(e.be, least(z.i + 20, z.n - 1)) as be from z left join e on e.page_id = z.page_id and e.i = z.i),
go as (select page_id, cast(0 as bigint) as i from l
       union all
       select go.page_id, 1 + case when a.has_cl then (case when a.has_fn then f.be else a.be end) when a.has_fn then a.be else a.i end
       from go join m a on a.page_id = go.page_id and a.i = go.i join m f on f.page_id = a.page_id and f.i = case when a.has_fn then a.be else a.i end),
r as (select a.url, a.i as s, a.be as e, a.fn, cast(null as varchar) as cl from go join m a using (page_id, i) where a.has_fn
      union all
      select a.url, f.i, f.be, cast(null as varchar), a.cl from go join m a using (page_id, i) join m f on f.page_id = a.page_id and f.i = case when a.has_fn then a.be else a.i end where a.has_cl)
select sha256(url || ':' || s || ':' || e) as id, url as file_path, cast(s as integer) as start_line, cast(e as integer) as end_line, fn as function_name, cl as class_name from r"""

ORACLES: dict[str, str] = {
    "structured_chunks_html": _HTML_SPANS,
    "listed_files": "select name || '.parquet' as name, true as has_bytes, true as same from (values ('region'), ('nation'), ('documents'), ('embeddings'), ('pages')) t(name)",
    "first_use": f"select turn, turn = 1 as indexed, count(*) as n_chunks from documents join {_TEMPLATES} on k = doc_id % 8, (values (1), (2)) u(turn) group by turn",
    "store_rebuild": f"with t as (select id, unnest(list_concat({tokens_sql('file_path')}, {tokens_sql('content')})) as term from ({windows_sql(_FILES)})) select count(*) as n_tokens, true as same from t",
    "blank_query": "select doc_id as id, cast(0 as double) as rank from documents where false",
    "enriched_chunks": f"""select id, odd as answered, case when odd then 'odd' else coalesce('Function ' || fn || ' in ' || file_path, 'Code in ' || file_path || ' lines 0-' || end_line) end as summary,
case when odd then null else 'Code implementation' end as purpose, case when odd then 'a|b' else coalesce(cl, '') end as concepts from (select *, (end_line + PLAIN) % 2 = 1 as odd from ({_NAMED}))""".replace("PLAIN", str(len(prompt({"file_path": "", "content": "", "language": "", "start_line": 0, "end_line": 0}).split("\n")))),
    "flat_old_rows": f"select id, id as content_hash, 2 as dims from ({windows_sql(_FILES)})",
    "structured_chunks_sources": f"""select sha256('/w/' || doc_id || ':' || s || ':' || e) as id, '/w/' || doc_id as file_path, s as start_line, e as end_line, replace(fn, '#', doc_id::varchar) as function_name, replace(cl, '#', doc_id::varchar) as class_name,
sha256(array_to_string(list_slice(ls, s + 1, e + 1), chr(10))) as content_hash from ({_SOURCES}) join {_TEMPLATES} on k = doc_id % 8""",
    "chunk_udtf": f"select doc_id, s as start_line, e as end_line, replace(fn, '#', doc_id::varchar) as function_name, replace(cl, '#', doc_id::varchar) as class_name from documents join (select * from {_TEMPLATES} union all select 2, 0, 0, 'f#', null) on k = doc_id % 8 where k in (1, 2)",
    "chunk_lookup": f"select id, file_path, start_line, content_hash from ({windows_sql(_FILES)}) where file_path = (select file_path from ({_FILES}) where doc_id = 0) order by start_line limit 1",
    "exists_with_hash": f"select 'own' as content_hash, count(*) > 0 as found from ({windows_sql(_FILES)}) union all select 'other', false",
    "file_filters": f"""select file_path, length from (select (case when doc_id % 7 = 0 then '/build/' else '/src/' end) || doc_id || (case language when 'en' then '.py' when 'de' then '.txt' else '.min.js' end) as file_path,
cast(strlen(content) as bigint) as length, * from ({_FILES})) where language = 'en' and doc_id % 7 <> 0 and length <= 1500""",
    "failed_embeddings": f"select id, 2 as dims, 5 as updated_at from ({windows_sql(_FILES)}) where not regexp_matches(content, '^[aeiouAEIOU]')",
    "store_migration": f"select id, case when language = 'de' then id else content_hash end as content_hash, true as unnamed, cast(5 as double) as norm from ({windows_sql(_FILES)})",
    "store_upsert": f"select id, file_path, case when language in ('en', 'fr') then 2 else 1 end as version from ({windows_sql(_FILES)})",
    "store_delete": f"""with t as (select id, unnest(list_concat({tokens_sql('file_path')}, {tokens_sql('content')})) as term from ({windows_sql(_FILES)}) where language <> 'de')
select count(*) as n_tokens, count(distinct id) as n_chunks, count(distinct term) as n_terms, count(distinct id) as corpus_n, count(*) as corpus_tokens from t""",
    "store_clear": f"select 'before' as state, count(*) as total_chunks, count(distinct file_path) as total_files, true as has_bytes from ({windows_sql(_FILES)}) union all select 'after', 0, 0, false",
    "search_rows": f"select id || '.txt' as label, '50.0% - Lines 0-' || end_line as description, replace(substr(content, 1, 100), chr(10), ' ') || case when length(content) > 100 then '...' else '' end as detail from ({_NAMED})",
    "quick_rows": f"""select id || '.txt' as label, case when tag = '' then '50.0% ' else '50.0%' || tag end as description,
regexp_extract(path, '^(.*)/', 1) || ' · Lines 0-' || end_line || ' · ' || trim(cut, ' ') || case when length(content) > 150 then '...' else '' end as detail from ({_SHOWN})""",
    "similar_rows": f"select id || '.txt' || case when fn is not null then ' · ' || fn || '()' when cl is not null then ' · ' || cl else '' end as label, '50% similar' as description, regexp_extract(file_path, '^(.*)/', 1) as detail from ({_NAMED})",
    "open_tab_rows": f"select doc_id || '.txt' as label, regexp_extract(file_path, '^(.*)/', 1) as detail from ({_FILES}) order by doc_id limit 10",
    "message_rows": "select 'No results' as label, '' as description, '' as detail",
    "status_text": f"select 'Index Statistics:' || chr(10) || '- Total Chunks: ' || count(*) || chr(10) || '- Total Files: ' || count(distinct file_path) || chr(10) || '- Database Size: 3.00 MB' || chr(10) || '- Last Indexed: Never' as status from ({windows_sql(_FILES)})",
    "flat_lists": f"""select id, '["' || language || '","a \\"b\\""]' as json, '[]' as none, language || '|a "b"' as joined from ({windows_sql(_FILES)})""",
    "blob_round_trip": "select vec_id, cast(len(embedding) as integer) as dims, cast(embedding[1] as double) as first, cast(embedding[-1] as double) as last from embeddings where label <> 1",
    "prompts": f"select doc_id as id, sha256(language || '|' || doc_id || '.txt|' || file_path || '|0-' || (len(string_split(content, chr(10))) - 1) || '|{{language}}|' || content || '|{{code}}') as prompt_sha from ({_FILES})",
    "bm25_porter": _top_bm25([([("the", "thes")], False), ([("es", "eses", "esing", "esed", "esings", "eseds")], False)]),
    "vector_topk": f"select e.vec_id, round({_SIM}, 6) as similarity from embeddings e, {_Q} order by {_SIM} desc, e.vec_id limit 10",
    "vector_topk_dedup_label": f"""with h as (select e.vec_id, e.label, {_SIM} as s from embeddings e, {_Q} order by s desc, vec_id limit 30),
b as (select *, row_number() over (partition by label order by s desc, vec_id) as k from h where label <> (select label from embeddings where vec_id = 0))
select vec_id, label, round(s, 6) as similarity from b where k = 1 order by s desc, vec_id limit 15""",
    "vector_exclude_self": f"""with h as (select e.vec_id, {_SIM} as s from embeddings e, {_Q} order by s desc, vec_id limit 30)
select vec_id, round(s, 6) as similarity from h where vec_id <> 0 order by s desc, vec_id limit 15""",
    "vector_dim_guard": f"select e.vec_id, round({_SIM}, 6) as similarity from (select * from embeddings where label <> 1) e, {_Q} order by {_SIM} desc, e.vec_id limit 10",
    "chunk_embedding_join": f"select f.doc_id as id, f.file_path, e.label, cast(len(e.embedding) as integer) as dims from ({_FILES}) f join embeddings e on e.vec_id = f.doc_id",
    "bm25_and": _top_bm25([(["by"], False), (["es"], False)]),
    "bm25_phrase": _top_bm25([(["of", "the"], False)]),
    "bm25_anchor": _top_bm25([(["the"], True), (["of"], False)]),
    "bm25_syntax_error": "select doc_id as id, cast(0 as double) as rank from documents where false",
    "postings_stats": f"select count(distinct id) as n_chunks, count(*) as n_tokens, count(distinct term) as n_terms from (select doc_id as id, unnest({tokens_sql('text')}) as term from documents)",
    "keyword_normalised": f"""with {_bm25(["content"], [(["by"], False), (["es"], False)])}, h as (select * from bm order by rank, id limit 20)
select id, round(case when min(rank) over () = max(rank) over () then 1e0 else 1e0 - abs(rank - min(rank) over ()) / abs(max(rank) over () - min(rank) over ()) end, 6) as similarity from h""",
    "query_clean": rf"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(raw, '[:"*()\[\]]', ' ', 'g'), '(?i)\b(AND|OR|NOT|NEAR)\b', ' ', 'g'), '{_SPACES}', ' ', 'g'), ' ')) as cleaned_md5
from (select doc_id, '(near' || lang || ') AND not_found é-Or_é éor ' || coalesce(text, '') || ' NOT "x:y*" [AND]+OR+near' as raw from documents)""",
    "fuzzy_url": f"with recursive {_fuzzy('select page_id as id, url as t from pages', 'page')} select id as page_id, round(score, 6) as score from fz order by fz.score desc, id limit 20",
    "hybrid_rrf": f"{_hybrid(20)} select n.id, f.file_path, f.language, round(n.similarity, 6) as similarity from norm n join ({_FILES}) f on f.doc_id = n.id",
    "semantic_search": f"select f.doc_id as id, f.file_path, f.language, round({_SIM}, 6) as similarity from embeddings e join ({_FILES}) f on f.doc_id = e.vec_id, {_Q} order by {_SIM} desc, id limit 10",
    "keyword_search": f"""with {_bm25(["file_path", "content"], [(["by"], False), (["es"], False)])}, h as (select * from bm order by rank, id limit 20),
s as (select id, case when min(rank) over () = max(rank) over () then 1e0 else 1e0 - abs(rank - min(rank) over ()) / abs(max(rank) over () - min(rank) over ()) end as s from h)
select s.id, f.file_path, f.language, round(s.s, 6) as similarity from s join ({_FILES}) f on f.doc_id = s.id""",
    "search_with_filters": f"""{_hybrid(40)} select n.id, f.file_path, f.language, round(n.similarity, 6) as similarity from norm n join ({_FILES}) f on f.doc_id = n.id
where n.similarity >= 0.05 and contains(f.file_path, 'src1') and f.language = 'es' order by n.score desc, n.met limit 20""",
    "similar_files": f"""with h as (select e.vec_id as id, {_SIM} as s from embeddings e, {_Q} where e.vec_id in (select doc_id from documents) order by s desc, id limit 30)
select h.id, f.file_path, f.language, round(s, 6) as similarity from h join ({_FILES}) f on f.doc_id = h.id where h.id <> 0 order by s desc, h.id limit 15""",
    "similar_code": f"""with h as (select e.vec_id as id, {_SIM} as s from embeddings e, {_Q} where e.vec_id in (select doc_id from documents) order by s desc, id limit 30)
select h.id, f.file_path, f.language, round(s, 6) as similarity from h join ({_FILES}) f on f.doc_id = h.id where h.id <> 0 order by s desc, h.id limit 15""",
    "rrf_fusion": """with d as (select doc_id as id, coalesce(length(text), 0) as n from documents),
a0 as (select 0 as arm, id, row_number() over (order by n desc, id) as r from d), a1 as (select 1 as arm, id, row_number() over (order by id * 7919 % 9973, id) as r from d), a2 as (select 2 as arm, id, row_number() over (order by id desc) as r from d),
arms as (select * from (select * from a0 union all select * from a1 union all select * from a2) where r <= 500),
fused as (select id, coalesce(sum(case when arm = 0 then 1e0 / (60e0 + r) end), 0e0) + coalesce(sum(case when arm = 1 then 1e0 / (60e0 + r) end), 0e0) + coalesce(sum(case when arm = 2 then 1e0 / (60e0 + r) end), 0e0) as score, min(arm * 1000000 + r) as met from arms group by id),
s as (select * from fused order by score desc, met limit 100)
select id, round(score, 9) as score, round((score - min(score) over ()) / (max(score) over () - min(score) over ()), 6) as similarity from s""",
    "rrf_single_hit": "select doc_id as id, round(1e0 / 61e0, 9) as score, cast(0 as double) as similarity from documents order by coalesce(length(text), 0) desc, doc_id limit 1",
    "line_windows": f"select id, file_path, start_line, end_line, content_hash from ({windows_sql(_FILES)})",
    "chunk_at_line": f"""select file_path, 17 as line, id, start_line, end_line from (select *, row_number() over (partition by file_path order by end_line - start_line, id) as k from ({windows_sql(_FILES)})
where start_line <= 17 and end_line >= 17) where k = 1""",
    "point_lookup": f"select id, content_hash from ({windows_sql(_FILES)}) where file_path = (select file_path from ({_FILES}) where doc_id = 0)",
    "hash_diff": f"""select coalesce(n.id, o.id) as id, case when o.id is null then 'new' when n.id is null then 'removed' when o.content_hash = n.content_hash then 'unchanged' else 'changed' end as state
from ({windows_sql(_FILES)}) o full outer join ({windows_sql(_V2)}) n on n.id = o.id""",
    "merge_upsert": f"""select n.id, n.file_path, n.content_hash, case when o.content_hash = n.content_hash then 1 else 2 end as version
from ({windows_sql(_V2)}) n left join ({windows_sql(_FILES)}) o on n.id = o.id""",
    "delete_by_file": f"select language, count(*) as n_chunks from ({windows_sql(_FILES)}) where language <> 'de' group by language",
    "index_stats": f"select count(*) as total_chunks, count(distinct file_path) as total_files, 1700000000000 as last_indexed_ms from ({windows_sql(_FILES)})",
    "display_rows": f"select doc_id as id, doc_id || '.txt' as label, replace(substr(content, 1, 100), chr(10), ' ') || case when length(content) > 100 then '...' else '' end as detail from ({_FILES})",
    "parse_context": "select conv_id, turn, 'turn ' || turn as summary, cast(null as varchar) as purpose, role || '|chat|' || conv_id as related_concepts, '' as usage_patterns, 'none' as dependencies from conversations",
    "fallback_context": f"""select id, s as summary, 'Code implementation' as purpose, coalesce(cl, '') as concepts, sha256(s || chr(10) || chr(10) || content) as full_sha
from (select *, coalesce('Function ' || fn || ' in ' || file_path, 'Code in ' || file_path || ' lines 0-' || end_line) as s from ({_NAMED}))""",
    "full_context": f"""select id, sha256('File: ' || file_path || chr(10) || coalesce('Function: ' || fn || chr(10), '') || coalesce('Class: ' || cl || chr(10), '') || 'Summary: a text' || chr(10)
|| 'Concepts: ' || language || ', prose' || chr(10) || chr(10) || 'Code:' || chr(10) || content) as full_sha from ({_NAMED})""",
    "exclude_globs": "select doc_id, lang in ('en', 'de') or doc_id < 100 as is_excluded from documents",
    "latest_event_per_key": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1",
    "stream_index": """with l as (select user_id, event_type, row_number() over (partition by user_id order by ts desc, case when event_type = 'error' then 'delete' else 'change' end desc) as k from events),
f as (select '/u/' || user_id || '.py' as p from l where k = 1 and event_type <> 'error')
select sha256(p || ':0:2') as id, p as file_path, 0 as start_line, 2 as end_line, sha256('# ' || p || chr(10) || 'value = 1' || chr(10)) as content_hash from f""",
    "arm_ranks": f"""with h as (select e.vec_id, e.label, {_SIM} as s from embeddings e, {_Q} order by s desc, vec_id limit 100)
select vec_id, label, cast(row_number() over (partition by label order by s desc, vec_id) as integer) as rank from h""",
    "nearest_vectors": """with s as (
  select q.vec_id, e.vec_id as other, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as similarity
  from embeddings e join embeddings q on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id),
r as (select *, cast(row_number() over (partition by vec_id order by similarity desc, other) as integer) as place from s)
select vec_id, other, round(similarity, 6) as similarity, place from r where place <= 10""",
    "term_dictionary": f"""with t as (select row_number() over () as line, {tokens_sql("text")} as ts from documents),
each as (select line, unnest(ts) as term from t), counted as (select line, term, count(*) as tf from each group by all)
select term, count(*) as df, cast(sum(tf) as bigint) as cf from counted group by term
union all select null, count(*), cast(sum(len(ts)) as bigint) from t where len(ts) > 0""",
    "folder_sync": f"""with f as (
  select lang || ':' || (doc_id % 25) as file_path, 'plaintext' as language,
         string_agg(coalesce(text, '') || case when lang = 'fr' then chr(10) || 'edited' else '' end, chr(10) order by doc_id) || chr(10) as content
  from documents where lang <> 'de' group by all)
select split_part(file_path, ':', 1) as lang, cast(split_part(file_path, ':', 2) as bigint) as slot, start_line, end_line, content_hash from ({windows_sql("select * from f")})""",
}
