"""Views that turn the driver tables into inputs for every operator.

Each view is one SELECT that Spark SQL and DuckDB both run unchanged, so the Spark queries and their SQL twins start
from the same rows. Names in braces are other views or driver tables. Every view covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ["documents", "orders", "events"]

_PAPER_ROWS = """
select doc_id as paper_id,
       'paper_' || doc_id || case doc_id % 7 when 0 then '.pdf' when 1 then '.md' when 2 then '.docx' when 3 then ''
                                             else '.TXT' end as name,
       case when doc_id % 41 = 0 then '   ' when doc_id % 43 = 0 then null else text end as text
from {documents}
"""

_MARKED_UP = """
select doc_id as paper_id,
       '# Title ' || doc_id || chr(10) || 'lead ' || doc_id || chr(10)
       || '## One' || chr(10) || substr(text, 1, third) || chr(10) || chr(10) || substr(text, third + 1, third)
       || chr(10) || '### Two' || chr(10) || substr(text, 2 * third + 1) || chr(10) || '## Empty' as text
from (select doc_id, text, cast(floor(length(text) / 3.0) as int) as third
      from (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from {documents}) s) t
"""

_RAW_NODES = """
select source || '-' || cast(floor(doc_id / 1000.0) as bigint) as graph_id, doc_id as pos,
       case when doc_id % 31 = 0 then '' else 'n' || (cast(floor(doc_id / 20.0) as bigint) % 37) end as id,
       case when doc_id % 53 = 0 then 'Figure' when doc_id % 9 = 0 then 'Question' when doc_id % 9 in (1, 2) then 'Claim'
            when doc_id % 9 in (3, 8) then 'Evidence' when doc_id % 9 = 4 then 'Study'
            when doc_id % 9 = 5 then 'Protocol' when doc_id % 9 = 6 then 'SourceDocument' else 'Request' end as type,
       case when doc_id % 37 = 0 then '   ' else text end as text,
       case when doc_id % 4 = 0 then ' ' || lang || ' text of ' || n_chars || ' characters ' end as description,
       case when doc_id % 2 = 0 then '10.5555/' || doc_id end as doi,
       case when doc_id % 3 = 0 then 'https://example.org/' || doc_id end as url,
       case doc_id % 10 when 0 then substr(text, 20, 60) when 5 then '"“ ' || substr(text, 20, 60) || '”"'
                        when 1 then lower(substr(text, 20, 60)) when 6 then lower(substr(text, 20, 60))
                        when 2 then 'quote not in the text' when 7 then 'another absent quote' end as anchor
from {documents}
"""

_RAW_EDGES = """
select 'src' || (o_orderkey % 20) || '-' || cast(floor(o_orderkey / 15000.0) as bigint) as graph_id,
       o_orderkey as pos,
       case o_orderkey % 9 when 0 then 'addresses' when 1 then 'supports' when 2 then 'opposes'
            when 3 then 'describesActivity' when 4 then 'grounds' when 5 then 'follows' when 6 then 'request_for'
            when 7 then 'request_target' else 'cites' end as relation,
       'n' || (o_custkey % 41) as subject,
       'n' || (cast(floor(o_orderkey / 20.0) as bigint) % 41) as object,
       case when o_orderkey % 3 = 0 then '"order ' || o_orderkey || '"' end as anchor
from {orders}
"""

_PAPER_INFO = """
select graph_id,
       min_by(text, pos) as title,
       case when min(pos) % 4 = 0 then min_by(doi, pos) end as doi,
       case when min(pos) % 5 = 0 then 'CC BY 4.0' end as license,
       'Author of ' || graph_id as author_1,
       case when min(pos) % 2 = 0 then '0000-0009-4417-320' || (min(pos) % 10) end as orcid_1,
       case when min(pos) % 3 = 0 then 'Second author of ' || graph_id end as author_2
from {raw_nodes} where type = 'SourceDocument' and id <> '' and trim(text) <> ''
group by graph_id
"""

_MERGES = """
select source || '-' || cast(floor(doc_id / 1000.0) as bigint) as graph_id, doc_id as group_no,
       'n' || (cast(floor(doc_id / 20.0) as bigint) % 37) as id_a,
       'n' || ((cast(floor(doc_id / 20.0) as bigint) + 9) % 37) as id_b
from {documents}
"""

_PROPOSED = """
select source || '-' || cast(floor(doc_id / 1000.0) as bigint) as graph_id, doc_id as pos,
       case doc_id % 5 when 0 then 'opposes' when 4 then 'mentions' else 'supports' end as relation,
       'n' || (cast(floor(doc_id / 20.0) as bigint) % 37) as subject,
       'n' || ((cast(floor(doc_id / 20.0) as bigint) + 36) % 37) as object
from {documents}
"""

_PIECE_NODES = """
select lang || '#' || substr(source, 4) as graph_id, doc_id as pos, 'n' || doc_id as id,
       case when doc_id % 53 = 0 then 'Figure' when doc_id % 2 = 0 then 'Claim' else 'Evidence' end as type,
       text,
       case when doc_id % 4 = 0 then lang || ' text of ' || n_chars || ' characters' end as description,
       cast(null as string) as doi, cast(null as string) as url,
       case when doc_id % 3 = 0 then substr(text, 20, 60) end as anchor
from {documents}
"""

_PIECE_EDGES = """
select lang || '#' || substr(source, 4) as graph_id, doc_id as pos, 'supports' as relation,
       'n' || doc_id as subject,
       'n' || (doc_id + 20) as object,
       case when doc_id % 4 = 0 then 'joined at ' || doc_id end as anchor
from {documents}
"""

_ATTEMPTS = """
select case when floor(doc_id / 60.0) % 3 = 2 then 'q' || cast(floor(doc_id / 20.0) as bigint)
            else 'p' || cast(floor(doc_id / 3.0) as bigint) end as graph_id,
       case when floor(doc_id / 60.0) % 3 = 2 then doc_id % 20 + 7
            else doc_id % 3 + 1 + 15 * cast(floor(doc_id / 3.0) % 4 as bigint) end as attempt,
       case doc_id % 7
         when 0 then '{{"nodes":[{{"id":"a","type":"Claim","text":"' || plain || '"}}],"edges":[],"paper":{{"title":" On '
                     || doc_id || ' ","doi":"10.1/' || doc_id || '","license":5,"authors":[{{"name":" Ann ' || doc_id
                     || '","orcid":"https://orcid.org/0000-0009-4417-320x"}},{{"name":""}},{{"name":"Bo","orcid":"0-0"}},7]}}}}'
         when 1 then '```json' || chr(10) || '{{"nodes":[{{"id":" b ","type":"Evidence","text":"' || plain
                     || '"}},{{"id":"c","type":"Claim","text":5}},7,{{"type":"Claim","text":"x"}}],"edges":[{{"relation":"supports","subject":"b","object":"c"}}]}}'
                     || chr(10) || '```'
         when 2 then 'Here: {{"nodes":[],"edges":[],"paper":[1]}} done'
         when 3 then '{{"nodes":[1,2'
         when 4 then '{{"nodes":{{}},"edges":[]}}'
         when 5 then 'no json at all'
         else '' end as content,
       'm1:free' as asked,
       case doc_id % 4 when 0 then 'm1:free' when 3 then 'm2' when 2 then '' else 'm1' end as model,
       case when floor(doc_id / 60.0) % 6 = 5 and doc_id % 20 < 9 then 500 + doc_id % 20
            when doc_id % 7 = 6 then case when doc_id % 2 = 0 then 429 else 401 end
            when doc_id % 29 = 0 then 0 when doc_id % 31 = 0 then 503 else 200 end as status,
       case doc_id % 5 when 0 then null when 1 then '{{"cost":"0.5"}}'
            else '{{"cost":' || case doc_id % 3 when 0 then '0' when 1 then '0.25' else '0.5' end || '}}' end as usage
from (select doc_id, translate(text, chr(9) || chr(10) || chr(13) || '"' || chr(92), '     ') as plain
      from {documents}) t
"""

_VERDICT_REPLIES = """
select source || '-' || cast(floor(doc_id / 1000.0) as bigint) as graph_id, doc_id as pos,
       case doc_id % 6
         when 0 then '{{"merges":[["n1","n2"],["n' || doc_id || '"]],"edges":[]}}'
         when 1 then '```' || chr(10) || '{{"edges":[{{"relation":"supports","subject":' || doc_id || ',"object":"n2"}}]}}' || chr(10) || '```'
         when 2 then 'Sure. {{"merges":[]}} Done.'
         when 3 then '[1]'
         when 4 then '{{"merges":5}}'
         else text end as content
from {documents}
"""

_DELTAS = """
select user_id as gen_id, event_id as seq, ts,
       case when event_type in ('click', 'view') then 'content' when event_type = 'signup' then 'reasoning'
            else 'keepalive' end as kind,
       case when event_type in ('click', 'view', 'signup') then substr(event_type, 1, 2) || (event_id % 10)
            else '' end as delta
from {events}
"""

# Calls start some time before their first row; a third ends with the last row, a third some hours after it, and a third
# is still open where the log ends.
_GENERATION_CALLS = """
select user_id as gen_id, min(ts) - (user_id % 30) * interval '1' hour as started,
       case user_id % 3 when 0 then max(ts) when 1 then max(ts) + interval '20' hour
            else (select max(ts) from {events}) end as ended
from {events} group by user_id
"""

_STREAM_LINES = """
select user_id as gen_id, event_id as seq,
       case event_type
         when 'click' then 'data: {{"id":"gen-' || user_id || '","model":"m' || (event_id % 3)
                           || '","choices":[{{"delta":{{"content":"w' || event_id || ' "}}}}],"error":'
                           || case when event_id % 17 = 0 then '{{"message":"lost ' || event_id || '"}}' when event_id % 17 = 1 then '""'
                                   when event_id % 17 = 2 then 'false' else 'null' end || '}}'
         when 'view' then 'data: {{"choices":[{{"delta":{{"reasoning":"r' || event_id || '"}}}}]}}'
         when 'signup' then 'data: {{"usage":{{"cost":0.25}},"choices":[]}}'
         when 'error' then case when event_id % 2 = 0 then 'data: [DONE]' else 'data: {{"broken"' end
         else ': keep-alive' end as line
from {events}
"""

_RUN_LOG = """
select user_id as run_id, event_id as seq,
       case event_type
         when 'click' then '{{"type":"status","message":"step ' || event_id || '"}}'
         when 'view' then '{{"type":"ping"}}'
         when 'error' then case when event_id % 7 = 0 then '{{"type":"error","message":"failed at ' || event_id || '"}}'
                                when event_id % 7 = 1 then '{{"type":"error"}}' else 'not json' end
         when 'signup' then '   '
         else case when event_id % 3 = 0 then '{{"type":"result","data":{{"source":"run ' || event_id || '"}}}}'
                   else '{{"type":"result"}}' end end as line
from {events}
"""

_EDITS = """
select 'src' || (user_id % 20) || '-0' as graph_id, event_id as seq, ts,
       case event_type when 'click' then 'editNode' when 'view' then 'restoreNode' when 'error' then 'dropNode'
            when 'signup' then case when event_id % 2 = 0 then 'addNode' else 'addEdge' end
            else case event_id % 4 when 0 then 'editEdge' when 1 then 'dropEdge' when 2 then 'restoreEdge'
                                   else 'editPaper' end end as op,
       case when event_type in ('click', 'view', 'error') then 'n' || (event_id % 37)
            when event_type = 'purchase' and event_id % 4 <> 3 then 'x' || (event_id % 200) end as target_id,
       case when event_type = 'click' and event_id % 11 = 0 then '  '
            when event_type = 'click' then 'edited ' || event_id
            when event_type = 'signup' and event_id % 2 = 0 then 'added ' || event_id end as new_text,
       case when event_type = 'click' and event_id % 5 = 0 then 'Claim'
            when event_type = 'signup' and event_id % 2 = 0 then 'Question' end as new_type,
       case when event_type = 'click' and event_id % 3 = 0 then 1 else 0 end as clears_description,
       case when event_type = 'purchase' and event_id % 4 = 0 then 'supports'
            when event_type = 'signup' and event_id % 2 = 1 then 'opposes' end as new_relation,
       case when event_type = 'signup' and event_id % 2 = 1 then 'n' || (event_id % 13) end as new_subject,
       case when event_type = 'signup' and event_id % 2 = 1 then 'n' || (event_id % 17) end as new_object,
       case when event_type = 'purchase' and event_id % 4 = 3 then 'title ' || event_id end as new_title,
       case when event_type = 'purchase' and event_id % 12 = 3 then 'Reviewer ' || event_id end as new_author
from {events}
"""

# Objects that break one rule each: a stray key, a container that is none, a description that is missing, an end that is no
# node, a source stamp on a claim.
_FOREIGN_OBJECTS = """
select source || '-' || cast(floor(doc_id / 1000.0) as bigint) as graph_id,
       case cast(floor(doc_id / 20.0) as bigint) % 5
         when 0 then '{{"@id":"x:odd' || doc_id || '","@type":["x:_schema_Claim","Claim"],"mood":"odd"}}'
         when 1 then '{{"@id":"x:box' || doc_id || '","@type":"Item","has_container":"x:n0"}}'
         when 2 then '{{"@id":"x:void' || doc_id || '","@type":["x:_schema_Study","Study"],"description":"x:none"}}'
         when 3 then '{{"@id":"x:tie' || doc_id || '","@type":["x:_rel_supports","supports","RelationInstance"],"source":"x:agent","destination":"x:gone"}}'
         else '{{"@id":"x:own' || doc_id || '","@type":["x:_schema_Claim","Claim"],"sourceDocument":"x:n0","title":["a","b"]}}' end as obj_json
from {documents} where doc_id % 20 in (3, 7, 11)
"""

# Works that several graphs cite: few enough that the graphs fall into a handful of connected parts.
_CITED_WORKS = """
select 'src' || (o_orderkey % 20) || '-' || cast(floor(o_orderkey / 15000.0) as bigint) as graph_id,
       'https://doi.org/10.5555/w' || (o_custkey % 97) as iri
from {orders} where o_orderkey % 1009 = 0 and o_orderkey % 20 <> 7
"""

VIEWS: dict[str, str] = {
    "cited_works": _CITED_WORKS,
    "foreign_objects": _FOREIGN_OBJECTS,
    "paper_rows": _PAPER_ROWS,
    "marked_up": _MARKED_UP,
    "raw_nodes": _RAW_NODES,
    "raw_edges": _RAW_EDGES,
    "paper_info": _PAPER_INFO,
    "merges": _MERGES,
    "proposed": _PROPOSED,
    "piece_nodes": _PIECE_NODES,
    "piece_edges": _PIECE_EDGES,
    "attempts": _ATTEMPTS,
    "verdict_replies": _VERDICT_REPLIES,
    "deltas": _DELTAS,
    "generation_calls": _GENERATION_CALLS,
    "stream_lines": _STREAM_LINES,
    "run_log": _RUN_LOG,
    "edits": _EDITS,
}


def depends_on(name: str) -> list[str]:
    """Views and tables a view reads."""
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", VIEWS[name])


_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the driver tables in ``sf_dir``."""
    inputs = {
        dep: view(spark, sf_dir, dep) if dep in VIEWS else read_table(spark, sf_dir, dep) for dep in depends_on(name)
    }
    return spark.sql(VIEWS[name], **inputs)


def view_sql(name: str) -> str:
    """The view's SQL text with plain names in place of the braces."""
    return VIEWS[name].format(**{dep: dep for dep in depends_on(name)}).strip()
