"""SQL twins of the named queries, for a second engine over the same tables.

Each twin restates its query in plain SQL (windows, self-joins and recursion where the Spark plan uses aggregates,
folds and rounds), so agreement checks the logic and not a shared text. Common steps are named tables; a twin pulls in
the ones it mentions.
"""

from __future__ import annotations

import re

from claimweave.functions.text import ANCHOR_CAP
from claimweave.operators import conform
from claimweave.plans import catalog
from claimweave.sources import fixtures
from claimweave.vocab import CONSOLIDATION_LIMIT, MERGEABLE_CLASSES, NODE_CLASSES, RELATIONS, SINGLE_CALL_LIMIT  # noqa: F401

_CODES = [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]
_SPACES = "(" + "||".join(f"chr({code})" for code in _CODES) + ")"
_SPACE_RE = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_QUOTES = "'\"''‘’“”'"


def _list(items: list[str]) -> str:
    return ", ".join(f"'{item}'" for item in items)


def strip(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{_SPACE_RE}+', ' ', 'g')")


def clip(x: str, n: int) -> str:
    flat = squeeze(x)
    return f"case when length({flat}) > {n} then substr({flat}, 1, {n - 1}) || '…' else {flat} end"


def peel(x: str) -> str:
    return (
        f"case when length({x}) > 1 and contains({_QUOTES}, left({x}, 1)) and contains({_QUOTES}, right({x}, 1)) "
        f"then {strip(f'substr({x}, 2, length({x}) - 2)')} else {x} end"
    )


def quoted(source: str, column: str = "anchor") -> str:
    """``source`` with ``column`` cleaned as a grounding quote ('' if none); four peeling rounds."""
    flat = strip(
        f"regexp_replace(regexp_replace(coalesce({column}, ''), '[\\x00-\\x1F\\x7F-\\x{{9F}}]+', ' ', 'g'), ' {{2,}}', ' ', 'g')"
    )
    inner = f"(select * replace ({flat} as {column}) from {source})"
    for _ in range(4):
        inner = f"(select * replace ({peel(column)} as {column}) from {inner})"
    return f"(select * replace ({strip(f'substr({column}, 1, {ANCHOR_CAP})')} as {column}) from {inner})"


_RULES = ", ".join(
    f"('{name}', {i}, [{_list(subj)}], [{_list(obj)}], '{'|'.join(subj)}→{'|'.join(obj)}')"
    for i, (name, subj, obj) in enumerate(RELATIONS)
)

_FENCE = r"(?s)^```[^\n]*\n(.*?)\n```$"


def _json_ok(x: str, test: str) -> str:
    return f"(case when json_valid({x}) then coalesce({test.format(x=x)}, false) else false end)"


_GRAPH_TEST = "(json_type({x}, '$.nodes') = 'ARRAY' and json_type({x}, '$.edges') = 'ARRAY')"
_VERDICT_TEST = "(json_type({x}) = 'OBJECT' and (coalesce(json_type({x}, '$.merges'), '') = 'ARRAY' or coalesce(json_type({x}, '$.edges'), '') = 'ARRAY'))"


def _parsed(source: str, test: str) -> str:
    return f"""
    select *, case when whole_ok then bare when span_ok then span end as reply,
           case when whole_ok then 'whole' when span_ok then 'span' else 'none' end as parse
    from (select *, {_json_ok('bare', test)} as whole_ok, {_json_ok('span', test)} as span_ok
          from (select *, regexp_extract(bare, '(?s)\\{{.*\\}}') as span
                from (select *, case when regexp_matches({strip('content')}, '{_FENCE}')
                                     then {strip(f"regexp_extract({strip('content')}, '{_FENCE}', 1)")}
                                     else {strip('content')} end as bare from {source}) a) b) c"""


def _string(doc: str, path: str) -> str:
    return f"case when json_type({doc}, '{path}') = 'VARCHAR' then json_extract_string({doc}, '{path}') end"


def _numbered(source: str, order: str, keys: str = "graph_id", out: str = "ord") -> str:
    return f"select *, row_number() over (partition by {keys} order by {order}) - 1 as {out} from {source}"


STEPS: dict[str, str] = {
    "rules": f"select * from (values {_RULES}) r(rule_relation, rel_ord, subj_classes, obj_classes, wants)",
    # -- classification --
    "fault_nodes": f"""
        select *, case when id = '' then 'missing id' when text = '' then 'missing text'
                       when type not in ({_list(NODE_CLASSES)}) then 'invalid type "' || raw_type || '"' end as fault
        from (select graph_id, pos, coalesce(type, '') as raw_type, {strip("coalesce(id, '')")} as id,
                     {strip("coalesce(type, '')")} as type, {strip("coalesce(text, '')")} as text,
                     description, doi, url, anchor
              from raw_nodes) t""",
    "judged_nodes": """
        select f.*, case when f.fault is not null then f.fault
                         when row_number() over (partition by graph_id, id, fault is null order by pos) > 1
                         then 'duplicate id "' || id || '"' end as why
        from fault_nodes f""",
    "nodes": f"""
        select graph_id, pos, row_number() over (partition by graph_id order by pos) - 1 as ord, id, type, text,
               nullif({strip('description')}, '') as description,
               case when type = 'SourceDocument' then nullif({strip('doi')}, '') end as doi,
               case when type = 'SourceDocument' then nullif({strip('url')}, '') end as url,
               nullif(anchor, '') as anchor
        from {quoted('judged_nodes')} q where why is null""",
    "all_edges": f"""
        select graph_id, pos, {strip("coalesce(relation, '')")} as relation, {strip("coalesce(subject, '')")} as subject,
               {strip("coalesce(object, '')")} as object, anchor
        from raw_edges""",
    "judged_edges": """
        select e.graph_id, e.pos, e.relation, e.subject, e.object, e.anchor, s.type as subj_type, o.type as obj_type,
               case when e.copy > 1 then 'folded'
                    when r.rule_relation is null then 'ungrammatical'
                    when s.type is null or o.type is null then 'dangling'
                    when not (list_contains(subj_classes, s.type) and list_contains(obj_classes, o.type))
                    then 'ungrammatical' else 'ok' end as verdict,
               case when e.copy > 1 then null
                    when r.rule_relation is null then 'unknown relation "' || e.relation || '"'
                    when s.type is null or o.type is null then 'endpoint id does not resolve'
                    when not (list_contains(subj_classes, s.type) and list_contains(obj_classes, o.type))
                    then e.relation || ' wants ' || wants || ', got ' || s.type || '→' || o.type end as why
        from (select *, row_number() over (partition by graph_id, relation, subject, object order by pos) as copy
              from all_edges) e
        left join rules r on e.relation = r.rule_relation
        left join nodes s on s.graph_id = e.graph_id and s.id = e.subject
        left join nodes o on o.graph_id = e.graph_id and o.id = e.object""",
    "edges": f"""
        select graph_id, pos, row_number() over (partition by graph_id order by pos) - 1 as ord, relation, subject, object,
               nullif(anchor, '') as anchor
        from {quoted("(select * from judged_edges where verdict = 'ok')")} q""",
    "rejects": """
        select graph_id, 'node' as kind, pos, why,
               cast(to_json({'id': id, 'type': raw_type, 'text': text, 'description': description, 'doi': doi, 'url': url,
                             'anchor': anchor}) as varchar) as payload
        from judged_nodes where why is not null
        union all
        select graph_id, verdict, pos, why,
               cast(to_json({'relation': relation, 'subject': subject, 'object': object}) as varchar)
        from judged_edges where verdict in ('dangling', 'ungrammatical')""",
    # -- attempts and replies --
    "parsed_attempts": _parsed("attempts", _GRAPH_TEST),
    "judged_attempts": f"""
        select *, case when status = 0 then 'no connection'
                       when status not between 200 and 299 then 'HTTP ' || status
                       when {strip("coalesce(content, '')")} = '' then 'blank reply'
                       when coalesce(model, '') <> '' and split_part(model, ':', 1) <> split_part(asked, ':', 1)
                       then 'answered by ' || model || ' instead of ' || asked else 'ok' end as outcome
        from parsed_attempts""",
    "retry_attempts": f"""
        select *, outcome <> 'ok' and (status in (0, 408, 429) or status between 500 and 599
                                       or (status between 200 and 299 and {strip("coalesce(content, '')")} = '')) as retry
        from judged_attempts""",
    "calls": """
        select * from (
            select *, coalesce(max(cast(stops as int)) over (partition by graph_id order by attempt
                                rows between unbounded preceding and 1 preceding), 0) = 0 as counts
            from (select *, (outcome = 'ok' and (parse <> 'none' or replies = 3))
                            or (outcome <> 'ok' and (not retry or failures = 5)) as stops
                  from (select *, count(*) filter (where outcome <> 'ok') over (partition by graph_id, replies order by attempt) as failures
                        from (select *, count(*) filter (where outcome = 'ok') over (partition by graph_id order by attempt) as replies
                              from retry_attempts) r) a) b) c
        where counts""",
    "call_records": """
        select graph_id || '/' || attempt as graph_id, reply from parsed_attempts where parse <> 'none'""",
    "reply_entries": """
        select graph_id, cast(i as bigint) as pos, json_extract(reply, '$.nodes[' || i || ']') as rec
        from (select graph_id, reply, unnest(range(cast(json_array_length(reply, '$.nodes') as bigint))) as i from call_records) t""",
    "parsed_verdicts": _parsed(
        "(select graph_id || '/' || pos as graph_id, content from verdict_replies)", _VERDICT_TEST
    ),
    # -- pieces --
    "piece_clean": """
        select split_part(graph_id, '#', 1) as graph_id, cast(split_part(graph_id, '#', 2) as bigint) as piece, pos, id,
               type, trimmed as text, nullif(trim(description), '') as description, anchor
        from (select *, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) as trimmed from piece_nodes) t
        where type <> 'Figure' and trimmed <> ''""",
    "joined": f"""
        select graph_id, piece, row_number() over (partition by graph_id order by piece, pos) - 1 as ord, id as old_id, type,
               text, description, nullif(anchor, '') as anchor
        from {quoted('piece_clean')} q""",
    "joined_nodes_": "select *, 'g' || ord as id from joined",
    "joined_edges_": f"""
        select graph_id, piece, row_number() over (partition by graph_id order by piece, pos) - 1 as ord, relation,
               subject, object, nullif(anchor, '') as anchor
        from {quoted('''(select s.graph_id, s.piece, e.pos, e.relation, s.id as subject, o.id as object, e.anchor
              from piece_edges e
              join joined_nodes_ s on s.graph_id = split_part(e.graph_id, '#', 1)
                   and s.piece = cast(split_part(e.graph_id, '#', 2) as bigint) and s.old_id = e.subject
              join joined_nodes_ o on o.graph_id = s.graph_id and o.piece = s.piece and o.old_id = e.object
              where o.type = 'Claim')''')} q""",
    "folded_heads": f"""
        select *, first_value(id) over w as survivor, first_value(ord) over w as head
        from (select *, {squeeze('lower(text)')} as same from joined_nodes_) t
        window w as (partition by graph_id, type, same order by ord)""",
    "whole_folds": f"""
        select graph_id, id
        from (select graph_id, id, row_number() over (partition by graph_id, type, {squeeze('lower(text)')} order by ord) as copy
              from nodes) t
        where copy > 1""",
    # -- consolidation --
    "group_members": """
        select graph_id, group_no, unnest(list_distinct([id_a, id_b])) as id from merges""",
    "sound_groups": f"""
        select m.graph_id, m.group_no, list(m.id) as ids,
               row_number() over (partition by m.graph_id order by m.group_no) as k
        from group_members m left join nodes n on n.graph_id = m.graph_id and n.id = m.id
        group by m.graph_id, m.group_no
        having count(*) >= 2 and count(n.id) = count(*) and count(distinct n.type) = 1
               and min(n.type) in ({_list(MERGEABLE_CLASSES)})""",
    "claims": """
        select graph_id, k, group_no, ids as claimed, true as applied from sound_groups where k = 1
        union all
        select c.graph_id, g.k, g.group_no,
               case when list_has_any(c.claimed, g.ids) then c.claimed else list_concat(c.claimed, g.ids) end,
               not list_has_any(c.claimed, g.ids)
        from claims c join sound_groups g on g.graph_id = c.graph_id and g.k = c.k + 1""",
    "applied": "select graph_id, group_no from claims where applied",
    "placed": """
        select m.graph_id, m.group_no, n.id, n.ord, n.description, n.anchor,
               first_value(n.id) over (partition by m.graph_id, m.group_no order by n.ord) as survivor
        from group_members m join applied a on a.graph_id = m.graph_id and a.group_no = m.group_no
        join nodes n on n.graph_id = m.graph_id and n.id = m.id""",
    "folds": "select graph_id, id, survivor from placed where id <> survivor",
    "kept": """
        select n.graph_id, n.ord, n.id, n.type,
               coalesce((select p.description from placed p where p.graph_id = n.graph_id and p.survivor = n.id
                           and p.description is not null order by length(p.description) desc, p.ord limit 1),
                        n.description) as description,
               coalesce((select p.anchor from placed p where p.graph_id = n.graph_id and p.survivor = n.id
                           and p.anchor is not null order by p.ord limit 1), n.anchor) as anchor
        from nodes n
        where not exists (select 1 from folds f where f.graph_id = n.graph_id and f.id = n.id)""",
    "kept_edges": """
        select graph_id, ord, relation, subject, object, anchor
        from (select *, row_number() over (partition by graph_id, relation, subject, object order by ord) as copy
              from (select e.graph_id, e.pos as ord, e.relation, coalesce(s.survivor, e.subject) as subject,
                           coalesce(o.survivor, e.object) as object, e.anchor
                    from edges e
                    left join folds s on s.graph_id = e.graph_id and s.id = e.subject
                    left join folds o on o.graph_id = e.graph_id and o.id = e.object) m
              where subject <> object) c
        where copy = 1""",
    "judged_proposed": """
        select graph_id, pos, relation, subject, object,
               sound and row_number() over (partition by graph_id, relation, subject, object, sound order by pos) = 1 as accepted
        from (select m.*, m.subject <> m.object and k.id is not null and l.id is not null and r.rule_relation is not null
                          and coalesce(list_contains(r.subj_classes, k.type) and list_contains(r.obj_classes, l.type), false)
                          and not exists (select 1 from kept_edges x where x.graph_id = m.graph_id and x.relation = m.relation
                                          and x.subject = m.subject and x.object = m.object) as sound
              from (select p.graph_id, p.pos, p.relation, coalesce(s.survivor, p.subject) as subject,
                           coalesce(o.survivor, p.object) as object
                    from proposed p
                    left join folds s on s.graph_id = p.graph_id and s.id = p.subject
                    left join folds o on o.graph_id = p.graph_id and o.id = p.object) m
              left join kept k on k.graph_id = m.graph_id and k.id = m.subject
              left join kept l on l.graph_id = m.graph_id and l.id = m.object
              left join rules r on r.rule_relation = m.relation) t""",
    # -- anchors --
    "matched": f"""
        select n.graph_id, n.pos, n.id, n.anchor,
               case when n.anchor is null or coalesce(d.text, '') = '' then null
                    when contains(d.text, n.anchor) then 'exact'
                    when contains({squeeze('lower(d.text)')}, {squeeze('lower(n.anchor)')}) then 'normalized'
                    else 'missing' end as match
        from nodes n left join documents d on d.doc_id = n.pos""",
    # -- projection --
    "minted": """
        select *, case when type <> 'SourceDocument' then 'x:n' || ord
                       when coalesce(doi, '') <> '' and regexp_matches(lower(doi), '^https?://') then doi
                       when coalesce(doi, '') <> '' then 'https://doi.org/' || regexp_replace(doi, '^(?i)doi:', '')
                       when regexp_matches(lower(coalesce(url, '')), '^https?://') then url
                       else 'x:n' || ord end as iri
        from nodes""",
    "paper_docs": f"""
        select graph_id, id as paper_source, iri as paper_iri, case when rank = 0 then 'doi' else 'title' end as matched_by
        from (select *, row_number() over (partition by graph_id order by rank, ord) as n
              from (select m.graph_id, m.ord, m.id, m.iri,
                           case when coalesce(p.doi, '') <> '' and lower(trim(coalesce(m.doi, ''))) = lower(trim(p.doi)) then 0
                                when {squeeze('lower(m.text)')} = {squeeze("lower(coalesce(p.title, ''))")} then 1 end as rank
                    from minted m join paper_info p on p.graph_id = m.graph_id
                    where m.type = 'SourceDocument') t
              where rank is not null) u
        where n = 1""",
    "spines": """
        select e.graph_id, e.object as evidence, e.subject as study, d.subject as source
        from (select *, row_number() over (partition by graph_id, object order by ord) as n from edges where relation = 'grounds') e
        left join (select *, row_number() over (partition by graph_id, object order by ord) as n
                   from edges where relation = 'describesActivity') d
               on d.graph_id = e.graph_id and d.object = e.subject and d.n = 1
        where e.n = 1""",
    "stamps": """
        select m.graph_id, m.ord, m.id, coalesce(s.iri, p.paper_iri) as source_document,
               case when s.iri is not null then 'spine' when p.paper_iri is not null then 'paper' else 'none' end as stamp
        from minted m
        left join spines c on c.graph_id = m.graph_id and c.evidence = m.id
        left join minted s on s.graph_id = c.graph_id and s.id = c.source
        left join paper_docs p on p.graph_id = m.graph_id
        where m.type = 'Evidence'""",
    "author_rows": """
        select graph_id, 1 as ord, author_1 as name, orcid_1 as orcid from paper_info
        union all
        select graph_id, 2, author_2, null from paper_info where author_2 is not null""",
    "author_ids": """
        select graph_id, ord, name, case when orcid is not null then 'https://orcid.org/' || orcid
                                         else 'x:author-' || (ord - 1) end as author_id
        from author_rows""",
    "node_objs": f"""
        select m.graph_id, m.ord, m.iri, m.type, {clip('m.text', 200)} as title,
               m.text || coalesce(chr(10) || chr(10) || m.description, '') as content,
               case when p.paper_source is not null
                    then (select string_agg(author_id, ',' order by a.ord) from author_ids a where a.graph_id = m.graph_id)
                    else 'x:agent' end as creators,
               case when m.anchor is not null then 'x:a-n' || m.ord end as item, s.source_document, m.anchor
        from minted m
        left join paper_docs p on p.graph_id = m.graph_id and p.paper_source = m.id
        left join stamps s on s.graph_id = m.graph_id and s.id = m.id""",
    "relation_objs": f"""
        select e.graph_id, e.ord as r, 'x:r' || e.ord as iri, e.relation, s.iri as source, o.iri as destination,
               {clip('s.text', 80)} || ' -' || e.relation || '-> ' || {clip('o.text', 80)} as title,
               case when e.anchor is not null then 'x:a-r' || e.ord end as item, e.anchor
        from edges e
        join minted s on s.graph_id = e.graph_id and s.id = e.subject
        join minted o on o.graph_id = e.graph_id and o.id = e.object""",
    "defs": """
        select graph_id, 1 as section, row_number() over (partition by graph_id order by min(ord)) - 1 as ord,
               'x:_schema_' || type as iri, type as name from node_objs group by graph_id, type
        union all
        select graph_id, 2, row_number() over (partition by graph_id order by min(r)) - 1, 'x:_rel_' || relation, relation
        from relation_objs group by graph_id, relation""",
    "account_rows": f"""
        select distinct graph_id, 0 as ord, 'x:agent' as account_id, '{catalog.NAMING.creator}' as account_name from nodes
        union all select graph_id, ord, author_id, {clip('name', 256)} from author_ids""",
    "object_ids": """
        select graph_id, 0 as section, account_id as obj_id from account_rows
        union all select graph_id, section, iri from defs
        union all select distinct graph_id, 3, 'x:doc' from (select graph_id from node_objs where item is not null
                                                             union all select graph_id from relation_objs where item is not null) t
        union all select graph_id, 4, item from node_objs where item is not null
        union all select graph_id, 5, item from relation_objs where item is not null
        union all select graph_id, 6, iri from node_objs
        union all select graph_id, 7, iri from relation_objs""",
    # Triples as sets: records that share an identifier merge, as they do in the emitted document.
    "triple_rows": f"""
        select distinct * from (
            select graph_id, account_id as s, unnest(['@type', 'accountName']) as p,
                   unnest(['UserAccount', account_name]) as o from account_rows
            union all
            select graph_id, iri, unnest(['@type', 'subClassOf', 'label', 'created', 'modified', 'creator']),
                   unnest([case when section = 1 then 'NodeSchema' else 'AbstractRelationDef' end, name, name,
                           '{catalog.STAMP}', '{catalog.STAMP}', 'x:agent']) from defs
            union all select graph_id, obj_id, '@type', 'Container' from object_ids where section = 3
            union all
            select graph_id, item, unnest(['@type', 'format', 'content', 'has_container']),
                   unnest(['Item', 'text/plain', anchor, 'x:doc'])
            from (select graph_id, item, anchor from node_objs union all select graph_id, item, anchor from relation_objs) t
            where item is not null
            union all
            select graph_id, iri, unnest(['@type', '@type', '@type', 'title', 'content', 'created', 'modified', 'description', 'sourceDocument']),
                   unnest(['x:_schema_' || type, type, 'NodeSchema', title, content, '{catalog.STAMP}', '{catalog.STAMP}', item, source_document])
            from node_objs
            union all select graph_id, iri, 'creator', unnest(string_split(creators, ',')) from node_objs
            union all
            select graph_id, iri, unnest(['@type', '@type', '@type', '@type', 'source', 'destination', 'title', 'created', 'modified', 'creator', 'description']),
                   unnest(['x:_rel_' || relation, relation, 'RelationInstance', 'NodeSchema', source, destination, title,
                           '{catalog.STAMP}', '{catalog.STAMP}', 'x:agent', item])
            from relation_objs) t
        where o is not null""",
    "foreign_json": "select graph_id, json(obj_json) as j from foreign_objects",
    "all_triples": f"""
        select graph_id, s, p, o from triple_rows
        union
        select graph_id, s, p, unnest(case when json_type(v) = 'ARRAY' then from_json(v, '["VARCHAR"]') else [v ->> '$'] end) as o
        from (select graph_id, j ->> '$."@id"' as s, unnest(json_keys(j)) as p, json_extract(j, '$."' || unnest(json_keys(j)) || '"') as v
              from foreign_json) t
        where p <> '@id'
        union
        select graph_id, j ->> '$."@id"', '@type', 'NodeSchema' from foreign_json
        where list_has_any(case when json_type(j, '$."@type"') = 'ARRAY' then from_json(j -> '$."@type"', '["VARCHAR"]')
                                else [j ->> '$."@type"'] end, [{_list(NODE_CLASSES)}, 'RelationInstance'])""",
    "node_kinds": "select graph_id, s as node, o as kind from all_triples where p = '@type'",
    "key_rules": "select * from (values "
    + ", ".join(f"('{kind}', '{key}')" for kind, keys in conform.ALLOWED_KEYS.items() for key in keys)
    + ") k(kind, p)",
    "end_rules": """
        select * from (values ('source', 'NodeSchema'), ('destination', 'NodeSchema'), ('description', 'Item'),
                              ('has_container', 'Container')) e(p, kind)""",
    "judged_violations": """
        select graph_id, 'ClassConstraintComponent' as component, t.p as path, s as focus, o as value, false as known
        from all_triples t join end_rules e on e.p = t.p
        where not exists (select 1 from node_kinds k where k.graph_id = t.graph_id and k.node = t.o and k.kind = e.kind)
        union all
        select t.graph_id, 'ClosedConstraintComponent', t.p, t.s, t.o, false
        from all_triples t join node_kinds k on k.graph_id = t.graph_id and k.node = t.s
        where k.kind in (select kind from key_rules) and not (k.kind = 'NodeSchema' and k.node not like 'x:\\_schema\\_%' escape '\\')
          and not exists (select 1 from key_rules r where r.kind = k.kind and r.p = t.p)
        union all
        select graph_id, 'InConstraintComponent', p, s, o, true from all_triples where p in ('source', 'destination', 'sourceDocument')""",
    # -- edits --
    "staged": """
        select graph_id, row_number() over (partition by graph_id order by branch, pos) - 1 as ord, relation, subject, object, anchor
        from (select graph_id, pos, 0 as branch, relation, subject, object, anchor from edges
              union all
              select graph_id, pos, case when verdict = 'dangling' then 1 else 2 end, relation, subject, object, null
              from judged_edges where verdict in ('dangling', 'ungrammatical')) t""",
    "adds": """
        select e.*, case when op = 'addNode' then 'n' else 'e' end
                    || (row_number() over (partition by e.graph_id order by seq) - 1 + coalesce(s.n, 0) + 1) as id
        from edits e
        left join (select graph_id, max(n) as n
                   from (select graph_id, count(*) as n from staged group by graph_id
                         union all
                         select graph_id, cast(substr(id, 2) as bigint) from nodes where regexp_full_match(id, 'n[0-9]{1,15}')) t
                   group by graph_id) s on s.graph_id = e.graph_id
        where op in ('addNode', 'addEdge')""",
    "stage_nodes": """
        select graph_id, ord, id, type, text, description, doi, url, anchor, false as added, -1 as born from nodes
        union all
        select graph_id, seq + 1099511627776, id, new_type, coalesce(new_text, ''), null, null, null, null, true, seq
        from adds where op = 'addNode'""",
    "stage_edges": """
        select graph_id, ord, 'x' || ord as id, relation, subject, object, anchor, false as added, -1 as born from staged
        union all
        select graph_id, seq + 1099511627776, id, new_relation, new_subject, new_object, null, true, seq
        from adds where op = 'addEdge'""",
    "nodes_now": """
        select n.graph_id, n.ord, n.id,
               coalesce((select new_type from edits e where e.graph_id = n.graph_id and e.target_id = n.id and e.seq > n.born
                           and op = 'editNode' and new_type is not null order by seq desc limit 1), n.type) as type,
               coalesce((select new_text from edits e where e.graph_id = n.graph_id and e.target_id = n.id and e.seq > n.born
                           and op = 'editNode' and new_text is not null order by seq desc limit 1), n.text) as text,
               case when exists (select 1 from edits e where e.graph_id = n.graph_id and e.target_id = n.id and e.seq > n.born
                                   and op = 'editNode' and clears_description = 1) then null else n.description end as description,
               n.doi, n.url, n.anchor,
               coalesce((select op = 'dropNode' from edits e where e.graph_id = n.graph_id and e.target_id = n.id
                           and e.seq > n.born and op in ('dropNode', 'restoreNode') order by seq desc limit 1), false) as dropped,
               n.added
        from stage_nodes n""",
    "edges_now": """
        select n.graph_id, n.ord, n.id,
               coalesce((select new_relation from edits e where e.graph_id = n.graph_id and e.target_id = n.id and e.seq > n.born
                           and op = 'editEdge' and new_relation is not null order by seq desc limit 1), n.relation) as relation,
               n.subject, n.object, n.anchor,
               coalesce((select op = 'dropEdge' from edits e where e.graph_id = n.graph_id and e.target_id = n.id
                           and e.seq > n.born and op in ('dropEdge', 'restoreEdge') order by seq desc limit 1), false) as dropped,
               n.added
        from stage_edges n""",
    "status_now": """
        select e.*, s.type as subj_type, o.type as obj_type,
               case when s.id is null and o.id is null then 'both ends are gone'
                    when s.id is null then 'the subject end is gone'
                    when o.id is null then 'the object end is gone'
                    when r.rule_relation is null then 'unknown relation "' || e.relation || '"'
                    when not (list_contains(r.subj_classes, s.type) and list_contains(r.obj_classes, o.type))
                    then e.relation || ' wants ' || r.wants || ', got ' || s.type || '→' || o.type end as reason
        from edges_now e
        left join nodes_now s on s.graph_id = e.graph_id and s.id = e.subject and not s.dropped
        left join nodes_now o on o.graph_id = e.graph_id and o.id = e.object and not o.dropped
        left join rules r on r.rule_relation = e.relation
        where not e.dropped""",
    "exported": f"""
        select graph_id, row_number() over (partition by graph_id order by ord) - 1 as ord, id, type, {strip('text')} as text,
               nullif({strip('description')}, '') as description, case when type = 'SourceDocument' then doi end as doi,
               case when type = 'SourceDocument' then url end as url, anchor
        from nodes_now where not dropped and {strip('text')} <> ''""",
    "drawn_ends": """
        select graph_id, subject as id from status_now where reason is null
        union all select graph_id, object from status_now where reason is null""",
    "reach": """
        select graph_id, ord as a, ord as b from nodes
        union
        select r.graph_id, r.a, case when p.x = r.b then p.y else p.x end
        from reach r join (select e.graph_id, s.ord as x, o.ord as y from edges e
                           join nodes s on s.graph_id = e.graph_id and s.id = e.subject
                           join nodes o on o.graph_id = e.graph_id and o.id = e.object) p
             on p.graph_id = r.graph_id and (p.x = r.b or p.y = r.b)""",
    "drawn_reach": """
        select graph_id, ord as a, ord as b from nodes_now where not dropped
        union
        select r.graph_id, r.a, case when p.x = r.b then p.y else p.x end
        from drawn_reach r join (select e.graph_id, s.ord as x, o.ord as y from status_now e
                                 join nodes_now s on s.graph_id = e.graph_id and s.id = e.subject and not s.dropped
                                 join nodes_now o on o.graph_id = e.graph_id and o.id = e.object and not o.dropped
                                 where e.reason is null) p
             on p.graph_id = r.graph_id and (p.x = r.b or p.y = r.b)""",
    "corpus_works": """
        select c.graph_id, c.iri from cited_works c where c.graph_id in (select graph_id from nodes)
        union select graph_id, iri from minted where type = 'SourceDocument' and iri not like 'x:%'""",
    "corpus_reach": """
        select distinct graph_id as a, graph_id as b from nodes
        union
        select r.a, k.graph_id
        from corpus_reach r join corpus_works c on c.graph_id = r.b join corpus_works k on k.iri = c.iri""",
    "corpus_labels": "select a as graph_id, min(b) as component from corpus_reach group by a",
    "labels": "select graph_id, a as ord, min(b) as component from reach group by graph_id, a",
    "signatures_before": """
        select g.graph_id, sha256(coalesce(max(n.d), sha256('')) || '|' || coalesce(max(p.d), sha256(''))) as signature
        from (select distinct graph_id from nodes) g
        left join (select graph_id, sha256(string_agg(d, ',' order by b)) as d from
                     (select graph_id, ord // 10000 as b, sha256(string_agg(id, ',' order by ord)) as d
                      from nodes group by all) t group by graph_id) n on n.graph_id = g.graph_id
        left join (select graph_id, sha256(string_agg(d, ',' order by b)) as d from
                     (select graph_id, pos // 10000 as b, sha256(string_agg(subject || '>' || object, ',' order by pos)) as d
                      from edges group by all) t group by graph_id) p on p.graph_id = g.graph_id
        group by g.graph_id""",
    "signatures_after": """
        select g.graph_id, sha256(coalesce(max(n.d), sha256('')) || '|' || coalesce(max(p.d), sha256(''))) as signature
        from (select distinct graph_id from nodes_now where not dropped) g
        left join (select graph_id, sha256(string_agg(d, ',' order by b)) as d from
                     (select graph_id, ord // 10000 as b, sha256(string_agg(id, ',' order by ord)) as d
                      from nodes_now where not dropped group by all) t group by graph_id) n on n.graph_id = g.graph_id
        left join (select graph_id, sha256(string_agg(d, ',' order by b)) as d from
                     (select graph_id, ord // 10000 as b, sha256(string_agg(subject || '>' || object, ',' order by ord)) as d
                      from status_now where reason is null group by all) t group by graph_id) p on p.graph_id = g.graph_id
        group by g.graph_id""",
    # -- sections and pieces --
    "md_lines": """
        select paper_id, cast(i as bigint) as line_no, lines[i] as line,
               regexp_matches(lines[i], '^#{2,3}\\s+') as heads, regexp_matches(lines[i], '^#\\s+\\S') as titles
        from (select paper_id, lines, unnest(range(1, len(lines) + 1)) as i
              from (select paper_id, regexp_split_to_array(text, '\\r?\\n') as lines from marked_up) a) b""",
    "md_titles": """
        select paper_id, min(line_no) as title_no, min_by(trim(substr(line, 2)), line_no) as title
        from md_lines where titles group by paper_id""",
    "md_sections": f"""
        select paper_id, row_number() over (partition by paper_id order by sec) - 1 as section_no, heading, body,
               case when heading = '' then body else {strip("heading || chr(10) || chr(10) || body")} end as text
        from (select paper_id, sec, coalesce(max(trim(line)) filter (where heads), '') as heading,
                     {strip("coalesce(string_agg(line, chr(10) order by line_no) filter (where not heads), '')")} as body
              from (select l.*, count(*) filter (where heads) over (partition by l.paper_id order by line_no) as sec
                    from md_lines l left join md_titles t on t.paper_id = l.paper_id
                    where t.title_no is null or l.line_no <> t.title_no) m
              group by paper_id, sec) s
        where heading <> '' or body <> ''""",
    "md_room": f"""
        select s.*, coalesce('# ' || t.title || chr(10) || chr(10), '') as title_line, coalesce(t.title, '') as title,
               {catalog.CHUNK_BUDGET} - length(coalesce('# ' || t.title || chr(10) || chr(10), '')) as room,
               count(*) over (partition by s.paper_id) as n_sections
        from md_sections s left join md_titles t on t.paper_id = s.paper_id""",
    "md_paras": """
        select paper_id, section_no, room, cast(i as bigint) as k, paras[i] as para, len(paras) as n
        from (select paper_id, section_no, room, paras, unnest(range(1, len(paras) + 1)) as i
              from (select *, regexp_split_to_array(body, '\\n{2,}') as paras from md_room where length(text) > room) a) b""",
    "md_fill": """
        select paper_id, section_no, k, n, room, para as buf, cast(null as varchar) as done from md_paras where k = 1
        union all
        select f.paper_id, f.section_no, p.k, p.n, p.room,
               case when length(f.buf) > 0 and length(f.buf) + 2 + length(p.para) > p.room
                    then right(f.buf, 600) || chr(10) || chr(10) || p.para else f.buf || chr(10) || chr(10) || p.para end,
               case when length(f.buf) > 0 and length(f.buf) + 2 + length(p.para) > p.room then f.buf end
        from md_fill f join md_paras p on p.paper_id = f.paper_id and p.section_no = f.section_no and p.k = f.k + 1""",
    "md_windows": f"""
        select paper_id, section_no, row_number() over (partition by paper_id, section_no order by k) - 1 as i, win
        from (select paper_id, section_no, k, {strip('done')} as win from md_fill where done is not null
              union all select paper_id, section_no, k + 1, {strip('buf')} from md_fill where k = n) t
        where win <> ''""",
    "md_pack": """
        select paper_id, section_no, case when length(text) > room then 1 else 0 end as next_group, 0 as grp,
               case when length(text) > room then 0 else length(text) + 2 end as held
        from md_room where section_no = 0
        union all
        select p.paper_id, r.section_no,
               case when length(r.text) > r.room then p.next_group + (case when p.held > 0 then 1 else 0 end) + 1
                    when p.held > 0 and p.held + length(r.text) + 2 > r.room then p.next_group + 1 else p.next_group end,
               case when length(r.text) > r.room then p.next_group + (case when p.held > 0 then 1 else 0 end)
                    when p.held > 0 and p.held + length(r.text) + 2 > r.room then p.next_group + 1 else p.next_group end,
               case when length(r.text) > r.room then 0
                    when p.held > 0 and p.held + length(r.text) + 2 > r.room then length(r.text) + 2
                    else p.held + length(r.text) + 2 end
        from md_pack p join md_room r on r.paper_id = p.paper_id and r.section_no = p.section_no + 1""",
    "md_pieces": """
        select r.paper_id, any_value(r.title) as title, p.grp, 0 as i,
               any_value(r.title_line) || string_agg(r.text, chr(10) || chr(10) order by r.section_no) as text,
               string_agg(case when heading = '' then '(preamble)' else heading end, ' | ' order by r.section_no) as sections
        from md_room r join md_pack p on p.paper_id = r.paper_id and p.section_no = r.section_no
        where length(r.text) <= r.room group by r.paper_id, p.grp
        union all
        select r.paper_id, r.title, p.grp, w.i,
               r.title_line || case when heading = '' then '' else heading || chr(10) || chr(10) end
               || case when w.i > 0 then '(section continued)' || chr(10) || chr(10) else '' end || w.win,
               case when heading = '' then '(preamble)' else heading end
               || case when w.i > 0 or r.n_sections > 1 then ' [split]' else '' end
        from md_room r join md_pack p on p.paper_id = r.paper_id and p.section_no = r.section_no
        join md_windows w on w.paper_id = r.paper_id and w.section_no = r.section_no""",
    # -- reports and streams --
    "events_json": """
        select run_id, seq, json_extract_string(j, '$.type') as type, nullif(json_extract_string(j, '$.message'), '') as message,
               case when json_type(j, '$.data') = 'OBJECT' then cast(json_extract(j, '$.data') as varchar) end as data
        from (select run_id, seq, trim(line) as j from run_log where json_valid(line)) t
        where json_type(j) = 'OBJECT'""",
    "decoded": """
        select gen_id, seq, json_extract_string(j, '$.id') as id, json_extract_string(j, '$.model') as model,
               json_extract_string(j, '$.choices[0].delta.content') as content,
               json_extract_string(j, '$.choices[0].delta.reasoning') as reasoning,
               case when json_extract(j, '$.error') not in ('null', 'false', '0', '""')
                    then coalesce(json_extract_string(j, '$.error.message'), cast(json_extract(j, '$.error') as varchar)) end as error,
               cast(json_extract(j, '$.usage') as varchar) as usage
        from (select gen_id, seq, substr(line, 7) as j from stream_lines where line like 'data: %') t
        where j <> '[DONE]' and json_valid(j)""",
}

_CHARS = (
    "cast(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as bigint)"
)
_ROUTED = f"""(select *, case when text is null then 'missing' when {strip('text')} = '' then 'empty'
                              when chars > {catalog.ROUTE_LIMIT} then 'too_big' else 'accepted' end as route
               from (select *, coalesce({_CHARS}, 0) as chars from paper_rows) t)"""
_EXT = "regexp_extract(lower(name), '\\.[^.]+$')"
_BASE = "coalesce(nullif(regexp_replace(name, '\\.[^.]+$', ''), ''), 'extraction')"
_SLUG = "coalesce(nullif(lower(trim(regexp_replace({x}, '[^a-zA-Z0-9]+', '-', 'g'), '-')), ''), 'extraction')"
_EDITOR_SLUG = (
    "coalesce(nullif(trim(regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '[^a-zA-Z0-9._-]+', '_', 'g'), '_'), ''), 'paper')"
)


def _gaps(source: str, seconds: int) -> str:
    return f"""
    select gen_id, since, gap_seconds
    from (select gen_id, lag(ts) over (partition by gen_id order by ts) as since,
                 (epoch_us(ts) - epoch_us(lag(ts) over (partition by gen_id order by ts))) / 1000000 as gap_seconds
          from (select gen_id, ts from {source}
                union all select gen_id, started from generation_calls
                union all select gen_id, ended from generation_calls where ended is not null) p) t
    where gap_seconds > {seconds}"""


def _pairs() -> str:
    classes = ", ".join(f"('{name}')" for name in NODE_CLASSES)
    return f"""(select a.c as subj_type, b.c as obj_type, string_agg(r.rule_relation, ',' order by r.rel_ord) as legal,
                       min_by(r.rule_relation, r.rel_ord) as first_legal
                from (values {classes}) a(c) cross join (values {classes}) b(c)
                join rules r on list_contains(r.subj_classes, a.c) and list_contains(r.obj_classes, b.c)
                group by a.c, b.c)"""


def _report_sql() -> str:
    columns = ["cast(count(*) filter (where measure = 'nodes') as bigint) as nodes"]
    from claimweave.operators.report import COUNTS

    columns = [
        f"cast(coalesce(sum(amount) filter (where measure = '{m}'), 0) as bigint) as {m.replace(' ', '_').lower()}" for m in COUNTS
    ]
    return f"""
    select graph_id, {', '.join(columns)}
    from (select graph_id, 'nodes' as measure, 1 as amount from nodes
          union all select graph_id, 'class ' || type, 1 from nodes
          union all select graph_id, 'node anchors', 1 from nodes where anchor is not null
          union all select graph_id, 'edges', 1 from edges
          union all select graph_id, 'relation ' || relation, 1 from edges
          union all select graph_id, 'edge anchors', 1 from edges where anchor is not null
          union all select graph_id, 'stamp ' || stamp, 1 from stamps
          union all select graph_id, 'reject ' || kind, 1 from rejects
          union all select graph_id, 'folded edges', 1 from judged_edges where verdict = 'folded') t
    group by graph_id"""



def _report_fields() -> str:
    from claimweave.operators.report import COUNTS

    return ", ".join(f"'{name}': {name}" for name in (m.replace(" ", "_").lower() for m in COUNTS))


def _object(**fields: str) -> str:
    """SQL for a JSON object text; ``fields`` are SQL expressions of JSON text, left out when NULL."""
    parts = [f"""coalesce(',"{key.replace('at_', '@')}":' || {value}, '')""" for key, value in fields.items()]
    return "'{' || substr(" + " || ".join(parts) + ", 2) || '}'"


def _text(x: str) -> str:
    return f"cast(to_json({x}) as varchar)"


_DATED = {"created": _text(f"'{catalog.STAMP}'"), "modified": _text(f"'{catalog.STAMP}'")}
_AGENT = _text("'x:agent'")


def _item_sql(table: str, order: str, section: int) -> str:
    item = _object(
        at_id=_text("item"), at_type=_text("'Item'"), format=_text("'text/plain'"), content=_text("anchor"), has_container=_text("'x:doc'")
    )
    return f"select graph_id, {section} as section, {order} as ord, {item} as obj from {table} where item is not null"


_DOCUMENTS = f"""
    select graph_id, 0 as part, 1 as n_parts,
           '["{catalog.NAMING.context_iri}",{{"x":"{catalog.NAMING.base_prefix}' || {_SLUG.format(x='graph_id')} || ':"}}]' as context,
           string_agg(obj, ',' order by section, ord) as body
    from (select graph_id, 0 as section, ord,
                 {_object(at_id=_text('account_id'), at_type=_text("'UserAccount'"), accountName=_text('account_name'))} as obj
          from account_rows
          union all
          select graph_id, section, ord,
                 {_object(at_id=_text('iri'), at_type=_text("case when section = 1 then 'NodeSchema' else 'AbstractRelationDef' end"),
                          subClassOf=_text('[name]'), label=_text('name'), **_DATED, creator=_AGENT)}
          from defs
          union all
          select graph_id, 3, 0, {_object(at_id=_text("'x:doc'"), at_type=_text("'Container'"))} from object_ids where section = 3
          union all {_item_sql('node_objs', 'ord', 4)}
          union all {_item_sql('relation_objs', 'r', 5)}
          union all
          select graph_id, 6, ord,
                 {_object(at_id=_text('iri'), at_type=_text("['x:_schema_' || type, type]"), title=_text('title'), content=_text('content'),
                          **_DATED, creator="case when creators = 'x:agent' then '" + '"x:agent"' + "' else " + _text("string_split(creators, ',')") + " end",
                          description=_text('item'), sourceDocument=_text('source_document'))}
          from node_objs
          union all
          select graph_id, 7, r,
                 {_object(at_id=_text('iri'), at_type=_text("['x:_rel_' || relation, relation, 'RelationInstance']"),
                          source=_text('source'), destination=_text('destination'), title=_text('title'), **_DATED, creator=_AGENT,
                          description=_text('item'))}
          from relation_objs) t
    group by graph_id"""

_CONSOLIDATION = f"""
    select n.graph_id, n.part, cast(max(n.part) over (partition by n.graph_id) + 1 as int) as n_parts,
           'Review these records; return merges and missing relations as one JSON object.' || chr(10) || chr(10)
           || '{{"nodes":[' || n.list || '],"edges":[' || coalesce(e.list, '') || ']}}' as user_message
    from (select graph_id, cast(ord // {CONSOLIDATION_LIMIT} as int) as part,
                 string_agg({_object(id=_text('id'), type=_text('type'), text=_text('substr(text, 1, 2000)'),
                                     description=_text('substr(description, 1, 2000)'))}, ',' order by ord) as list
          from nodes group by graph_id, 2) n
    left join (select e.graph_id, cast(s.ord // {CONSOLIDATION_LIMIT} as int) as part,
                      string_agg({_object(relation=_text('e.relation'), subject=_text('e.subject'), object=_text('e.object'))},
                                 ',' order by e.pos) as list
               from edges e join nodes s on s.graph_id = e.graph_id and s.id = e.subject
               group by e.graph_id, 2) e on e.graph_id = n.graph_id and e.part = n.part"""

_REPLY_VERDICTS = f"""
        select graph_id, pos, id, type, case when id = '' then 'missing id' when text = '' then 'missing text' end as why
        from (select graph_id, cast(i as bigint) as pos, coalesce({strip(_string('rec', '$.id'))}, '') as id,
                     coalesce({strip(_string('rec', '$.type'))}, '') as type, coalesce({strip(_string('rec', '$.text'))}, '') as text
              from (select graph_id, i, json_extract(reply, '$.nodes[' || i || ']') as rec
                    from (select graph_id, reply, unnest(range(cast(json_array_length(reply, '$.nodes') as bigint))) as i
                          from calls where outcome = 'ok' and parse <> 'none') t) u) v"""

QUERIES: dict[str, str] = {
    "documents": _DOCUMENTS,
    "consolidation_requests": _CONSOLIDATION,
    "input_types": f"""
        select paper_id, name, {_EXT} as ext, {_EXT} in ('.pdf', '.txt', '.md') as accepted,
               {_EXT} in ('.pdf', '.txt', '.md', '') as web_accepted,
               case when {_EXT} not in ('.pdf', '.txt', '.md')
                    then 'cannot read ' || coalesce(nullif({_EXT}, ''), '(no extension)') || ' files' end as refusal,
               {_BASE} as slug
        from paper_rows""",
    "route_papers": f"""
        select paper_id, chars, route,
               case route when 'missing' then 'there is no text' when 'empty' then 'the text is blank'
                          when 'too_big' then chars || ' characters, over the limit of {catalog.ROUTE_LIMIT}' end as reason
        from {_ROUTED} r""",
    "quarantine": f"""
        select paper_id, 'oversize/' || replace(replace('{catalog.STAMP}', ':', '-'), '.', '-') || '-'
                         || substr(regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 120) as path,
               name as original_name, cast(strlen(text) as bigint) as bytes, cast(chars as varchar) as extracted_chars,
               'reader ' || paper_id as contact, '{catalog.STAMP}' as submitted_at,
               case when {_EXT} not in ('.pdf', '.txt', '.md') then 'unsupported type' end as problem, text
        from {_ROUTED} r where route = 'too_big'""",
    "text_echo": "select paper_id, substr(text, 1, 400000) as echo from paper_rows",
    "sections": "select paper_id, section_no, heading, text from md_sections",
    "chunks": """
        select paper_id, title, row_number() over (partition by paper_id order by grp, i) - 1 as index, text, sections
        from md_pieces""",
    "chunk_coverage": """
        select m.paper_id, cast(length(m.text) as bigint) as chars, count(p.paper_id) as pieces, count(p.paper_id) = 0 as uncovered
        from marked_up m left join md_pieces p on p.paper_id = m.paper_id group by m.paper_id, m.text""",
    "extraction_requests": f"""
        select paper_id, 'Read the paper and return its discourse graph as one JSON object with nodes and edges.' as system_message,
               'The whole paper follows.' || chr(10) || chr(10) || '---' || chr(10) || text as user_message
        from {_ROUTED} r where route = 'accepted'""",
    "consolidation_eligibility": f"""
        select graph_id, count(*) as records,
               case when count(*) > {catalog.MERGE_LIMIT} then count(*) || ' records, over the limit of {catalog.MERGE_LIMIT}' end as skipped
        from nodes group by graph_id""",
    "outcomes": """
        select outcome, count(*) as attempts, count(*) filter (where retry) as retryable from retry_attempts group by outcome""",
    "attempt_outcomes": "select graph_id, attempt, status, outcome, retry from retry_attempts",
    "attempt_winners": "select graph_id, attempt, parse from calls where outcome = 'ok' and parse <> 'none'",
    "models_first_use": """
        select graph_id, row_number() over (partition by graph_id order by min(attempt)) - 1 as use_no, m as model
        from (select *, case when model = '' then asked else model end as m from calls where outcome = 'ok') t
        group by graph_id, m""",
    "cost_receipt": """
        select graph_id, count(usage) filter (where outcome = 'ok') as calls,
               coalesce(sum(case when outcome = 'ok' and json_type(usage, '$.cost') in ('UBIGINT', 'BIGINT', 'DOUBLE')
                                 then cast(json_extract_string(usage, '$.cost') as double) end), 0.0) as cost,
               coalesce(sum(case when outcome = 'ok' and json_type(usage, '$.cost') in ('UBIGINT', 'BIGINT', 'DOUBLE')
                                 then cast(json_extract_string(usage, '$.cost') as double) end), 0.0) > 0 as billed
        from calls group by graph_id""",
    "failure_ledger": """
        select graph_id, case when max_by(outcome, attempt) = 'ok' then 'no usable graph in the reply'
                              else max_by(outcome, attempt) end as why
        from calls group by graph_id having count(*) filter (where outcome = 'ok' and parse <> 'none') = 0""",
    "parse_status": "select graph_id, attempt, parse from parsed_attempts",
    "reply_nodes": f"""
        select graph_id, pos, coalesce({strip(_string('rec', '$.id'))}, '') as id,
               coalesce({strip(_string('rec', '$.type'))}, '') as type, coalesce({strip(_string('rec', '$.text'))}, '') as text
        from reply_entries""",
    "reply_edges": f"""
        select graph_id, cast(i as bigint) as pos, {_string('rec', '$.relation')} as relation,
               {_string('rec', '$.subject')} as subject, {_string('rec', '$.object')} as object
        from (select graph_id, i, json_extract(reply, '$.edges[' || i || ']') as rec
              from (select graph_id, reply, unnest(range(cast(json_array_length(reply, '$.edges') as bigint))) as i from call_records) t) u""",
    "authors_clean": f"""
        select graph_id, title, doi, license, coalesce(authors, '') as authors
        from (select graph_id, nullif({strip(_string('p', '$.title'))}, '') as title, nullif({strip(_string('p', '$.doi'))}, '') as doi,
                     nullif({strip(_string('p', '$.license'))}, '') as license,
                     (select string_agg(name || ' <' || case when regexp_matches(orcid, '^[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{3}}[0-9xX]$')
                                                             then upper(orcid) else '' end || '>', '; ' order by i)
                      from (select i, coalesce({strip(_string('a', '$.name'))}, '') as name,
                                   regexp_replace(coalesce({strip(_string('a', '$.orcid'))}, ''), '^(?i)https?://(www\\.)?orcid\\.org/', '') as orcid
                            from (select i, json_extract(p, '$.authors[' || i || ']') as a
                                  from (select unnest(range(cast(json_array_length(p, '$.authors') as bigint))) as i) z) y) x
                      where name <> '') as authors
              from (select graph_id, json_extract(reply, '$.paper') as p from call_records) t
              where json_type(p) = 'OBJECT') u
        where coalesce(title, doi, license, authors) is not null""",
    "verdict_status": """
        select graph_id, parse,
               case when parse <> 'none' and json_type(reply, '$.merges') = 'ARRAY'
                    then cast(json_array_length(reply, '$.merges') as bigint) else 0 end as merges,
               case when parse <> 'none' and json_type(reply, '$.edges') = 'ARRAY'
                    then cast(json_array_length(reply, '$.edges') as bigint) else 0 end as edges,
               case when parse <> 'none' and json_array_length(reply, '$.edges') = 1
                    then concat_ws(' ', json_extract_string(reply, '$.edges[0].relation'), json_extract_string(reply, '$.edges[0].subject'),
                                   json_extract_string(reply, '$.edges[0].object')) end as last_edge
        from parsed_verdicts""",
    "reply_verdicts": _REPLY_VERDICTS,
    "node_verdicts": "select graph_id, pos, id, type, coalesce(why, 'ok') as verdict from judged_nodes",
    "clean_nodes": "select graph_id, ord, id, type, text, description, doi, url, anchor from nodes",
    "clean_anchors": f"select graph_id, pos, anchor from {quoted('raw_nodes')} q",
    "edge_verdicts": "select graph_id, pos, relation, subject, object, verdict, why from judged_edges",
    "verdict_counts": """
        select graph_id, case when why is null then 'node ok' else 'node rejected' end as verdict, count(*) as n
        from judged_nodes group by 1, 2
        union all select graph_id, 'edge ' || verdict, count(*) from judged_edges group by 1, 2""",
    "clean_edges": "select graph_id, ord, relation, subject, object, anchor from edges",
    "reject_ledger": "select * from rejects",
    "reject_top8": """
        select graph_id, kind, rank, pos, why, total
        from (select *, row_number() over (partition by graph_id, kind order by pos) as rank,
                     count(*) over (partition by graph_id, kind) as total from rejects) t
        where rank <= 8""",
    "legal_relations": f"""
        select j.graph_id, j.subj_type, j.obj_type, count(*) as n_edges, coalesce(any_value(l.legal), '') as legal
        from judged_edges j left join {_pairs()} l on l.subj_type = j.subj_type and l.obj_type = j.obj_type
        where j.verdict <> 'folded' and j.subj_type is not null and j.obj_type is not null
        group by j.graph_id, j.subj_type, j.obj_type""",
    "joined_nodes": "select graph_id, piece, ord, id, type, text from joined_nodes_",
    "joined_edges": "select graph_id, piece, ord, relation, subject, object, anchor from joined_edges_",
    "merge_exact": """
        select h.graph_id, h.id, h.type,
               (select m.description from folded_heads m where m.graph_id = h.graph_id and m.survivor = h.id
                  and m.description is not null order by length(m.description) desc, m.ord limit 1) as description,
               (select m.anchor from folded_heads m where m.graph_id = h.graph_id and m.survivor = h.id
                  and m.anchor is not null order by m.ord limit 1) as anchor
        from folded_heads h where h.ord = h.head""",
    "merge_edges": """
        select graph_id, ord, relation, subject, object, anchor
        from (select e.graph_id, e.ord, e.relation, s.survivor as subject, o.survivor as object, e.anchor,
                     row_number() over (partition by e.graph_id, e.relation, s.survivor, o.survivor order by e.ord) as copy
              from joined_edges_ e
              join folded_heads s on s.graph_id = e.graph_id and s.id = e.subject
              join folded_heads o on o.graph_id = e.graph_id and o.id = e.object) t
        where copy = 1""",
    "merge_stats": """
        select graph_id, count(*) as records, count(*) filter (where ord <> head) as collapsed from folded_heads group by graph_id""",
    "piece_lineage": """
        select graph_id, survivor as id, piece, count(*) as records from folded_heads group by graph_id, survivor, piece""",
    "merge_groups": """
        select m.graph_id, m.group_no, a.group_no is not null as applied
        from merges m left join applied a on a.graph_id = m.graph_id and a.group_no = m.group_no""",
    "fold_survivors": "select graph_id, ord, id, type, description, anchor from kept",
    "repointed_edges": "select graph_id, ord, relation, subject, object, anchor from kept_edges",
    "proposed_edges": "select graph_id, pos, relation, subject, object, accepted from judged_proposed",
    "consolidated_edges": """
        select graph_id, row_number() over (partition by graph_id order by branch, ord) - 1 as ord, relation, subject, object,
               anchor, branch = 1 as consolidated
        from (select graph_id, 0 as branch, ord, relation, subject, object, anchor from kept_edges
              union all select graph_id, 1, pos, relation, subject, object, null from judged_proposed where accepted) t""",
    "consolidation_stats": """
        select n.graph_id,
               (select count(*) from applied a where a.graph_id = n.graph_id) as groups_applied,
               (select count(*) from merges m where m.graph_id = n.graph_id)
                 - (select count(*) from applied a where a.graph_id = n.graph_id) as groups_rejected,
               (select count(*) from folds f where f.graph_id = n.graph_id) as records_folded,
               (select count(*) from judged_proposed p where p.graph_id = n.graph_id and p.accepted) as edges_added,
               (select count(*) from judged_proposed p where p.graph_id = n.graph_id and not p.accepted) as proposed_rejected,
               (select count(*) from edges e where e.graph_id = n.graph_id)
                 - (select count(*) from kept_edges k where k.graph_id = n.graph_id) as edges_dropped_by_fold
        from (select distinct graph_id from nodes union select graph_id from merges union select graph_id from edges) n""",
    "anchor_match": "select graph_id, pos, id, anchor, match from matched",
    "anchor_coverage": """
        select g.graph_id, count(*) filter (where kind = 0) as nodes, count(*) filter (where kind = 0 and anchor is not null) as nodes_with_anchor,
               count(*) filter (where kind = 1) as edges, count(*) filter (where kind = 1 and anchor is not null) as edges_with_anchor
        from (select graph_id, 0 as kind, anchor from nodes union all select graph_id, 1, anchor from edges) g group by g.graph_id""",
    "anchors_verified": """
        select graph_id, count(*) as live_nodes, count(*) filter (where anchor is not null and coalesce(match, '') <> 'missing') as anchored_nodes
        from matched group by graph_id""",
    "anchor_worklist": "select graph_id, pos, id, anchor from matched where match = 'missing'",
    "slugs": f"""
        select paper_id, {_SLUG.format(x='name')} as slug, {_EDITOR_SLUG} as editor_slug,
               {_SLUG.format(x=_EDITOR_SLUG)} as exported_slug,
               '{catalog.NAMING.base_prefix}' || {_SLUG.format(x='name')} || ':' as base_iri
        from paper_rows""",
    "run_names": f"""
        select graph_id, name, '{catalog.NAMING.base_prefix}' || {_SLUG.format(x='name')} || ':' as base_iri
        from (select g.graph_id, case when substr(g.graph_id, 4, 1) = '1' then 'Run of ' || g.graph_id
                                      when substr(g.graph_id, 4, 1) = '2' then g.graph_id || '.v1'
                                      else coalesce(p.title, 'extraction') end as name
              from (select distinct graph_id from nodes) g left join paper_info p on p.graph_id = g.graph_id) t""",
    "accounts": "select graph_id, cast(ord as bigint) as ord, account_id, account_name from account_rows",
    "node_iris": "select graph_id, ord, id, iri from minted",
    "source_index": """
        select iri, count(*) as records, count(distinct graph_id) as graphs from minted
        where type = 'SourceDocument' and iri not like 'x:%' group by iri""",
    "paper_document": "select * from paper_docs",
    "spine": "select graph_id, evidence, study, source from spines",
    "evidence_stamps": "select graph_id, ord, id, source_document, stamp from stamps",
    "node_objects": "select graph_id, ord, iri, type, title, content, creators, item, source_document from node_objs",
    "relation_objects": "select graph_id, r, iri, relation, source, destination, title, item from relation_objs",
    "anchor_items": """
        select graph_id, ord, item, anchor as content from node_objs where item is not null
        union all select graph_id, r, item, anchor from relation_objs where item is not null""",
    "definitions": "select graph_id, ord, iri, name from defs",
    "projection_report": """
        select graph_id, section, item, count(*) as n
        from (select graph_id, 'nodes' as section, 'total' as item from nodes
              union all select graph_id, 'nodes', 'mapped' from node_objs
              union all select graph_id, 'class', type from node_objs
              union all select graph_id, 'edges', 'total' from edges
              union all select graph_id, 'edges', 'mapped' from relation_objs
              union all select graph_id, 'relation', relation from relation_objs
              union all select graph_id, 'anchors', 'nodes' from node_objs where anchor is not null
              union all select graph_id, 'anchors', 'edges' from relation_objs where anchor is not null
              union all select graph_id, 'stamps', stamp from stamps) t
        group by graph_id, section, item
        union all
        select graph_id, 'edges', 'dropped', count(*) - (select count(*) from relation_objs r where r.graph_id = e.graph_id)
        from edges e group by graph_id""",
    "omission_notes": """
        select graph_id, 'license has no slot in the schema; kept in this report only' as note, license as detail
        from paper_info where license is not null
        union all
        select graph_id, 'the paper''s own source record was not identified, so evidence without a study chain has no source',
               cast(count(*) as varchar)
        from stamps s where stamp = 'none' and not exists (select 1 from paper_docs p where p.graph_id = s.graph_id)
        group by graph_id""",
    "linked_objects": """
        select graph_id, cast(section as bigint) as section, count(*) as objects, min(obj_id) as first_id, max(obj_id) as last_id
        from object_ids group by graph_id, section""",
    "triple_counts": "select graph_id, p, count(*) as n from all_triples group by graph_id, p",
    "violations": """
        select graph_id, component, path, known, count(*) as n from judged_violations group by graph_id, component, path, known""",
    "violations_top20": """
        select graph_id, rank, component, path, focus, value
        from (select *, row_number() over (partition by graph_id order by component, path, focus, value) as rank
              from judged_violations where not known) t
        where rank <= 20""",
    "conformance": """
        select t.graph_id, t.triples, coalesce(v.known, 0) as known, coalesce(v.real, 0) as real,
               case when v.real > 0 then 'DOES NOT CONFORM' when v.known > 0 then 'CONFORMS modulo quirks' else 'CONFORMS' end as verdict
        from (select graph_id, count(*) as triples from all_triples group by graph_id) t
        left join (select graph_id, count(*) filter (where known) as known, count(*) filter (where not known) as real
                   from judged_violations group by graph_id) v on v.graph_id = t.graph_id""",
    "documents_read_back": f"""
        select i.graph_id, i.obj_id, t.title, '["{catalog.LOCAL_CONTEXT}",{{"x":"{catalog.NAMING.base_prefix}'
               || {_SLUG.format(x='i.graph_id')} || ':"}}]' as context
        from (select *, row_number() over (partition by graph_id, section, obj_id) as n from object_ids) i
        left join (select graph_id, 6 as section, iri, title, row_number() over (partition by graph_id, iri) as n from node_objs
                   union all select graph_id, 7, iri, title, 1 from relation_objs) t
               on t.graph_id = i.graph_id and t.section = i.section and t.iri = i.obj_id and t.n = i.n""",
    "staged_edges": "select graph_id, ord, 'x' || ord as id, relation, subject, object, anchor from staged",
    "edited_nodes": "select graph_id, id, type, text, description, dropped, added from nodes_now",
    "edited_edges": "select graph_id, id, relation, subject, object, dropped, added from edges_now",
    "edited_papers": """
        select coalesce(p.graph_id, e.graph_id) as graph_id, coalesce(e.title, p.title) as title, p.doi, p.license,
               case when e.author is not null then e.author when p.graph_id is not null then concat_ws('; ', p.author_1, p.author_2) end as authors
        from paper_info p
        full join (select graph_id, max_by(new_title, seq) as title, max_by(new_author, seq) filter (where new_author is not null) as author
                   from edits where op = 'editPaper' group by graph_id) e
               on e.graph_id = p.graph_id""",
    "edge_status": "select graph_id, id, relation, subject, object, reason is null as valid, reason from status_now",
    "publishable": f"""
        select n.graph_id, count(*) filter (where not dropped) as live_nodes,
               count(*) filter (where not dropped and {strip('text')} = '') as nodes_needing_text,
               (select count(*) from status_now s where s.graph_id = n.graph_id and reason is null) as valid_edges,
               count(*) filter (where not dropped) > 0 and count(*) filter (where not dropped and {strip('text')} = '') = 0 as publishable
        from nodes_now n group by n.graph_id""",
    "export_nodes": "select graph_id, ord, id, type, text, description, doi, url, anchor from exported",
    "export_edges": """
        select graph_id, row_number() over (partition by graph_id order by ord) - 1 as ord, relation, subject, object, anchor
        from (select s.* from status_now s
              join exported a on a.graph_id = s.graph_id and a.id = s.subject
              join exported b on b.graph_id = s.graph_id and b.id = s.object where s.reason is null) t""",
    "connect": f"""
        select e.graph_id, e.pos as seq, e.subject, e.object, l.first_legal as relation,
               case when l.first_legal is null then 'nothing links ' || s.type || ' to ' || o.type end as notice
        from all_edges e
        join nodes s on s.graph_id = e.graph_id and s.id = e.subject
        join nodes o on o.graph_id = e.graph_id and o.id = e.object
        left join {_pairs()} l on l.subj_type = s.type and l.obj_type = o.type
        where e.subject <> e.object""",
    "repair_choices": f"""
        select e.graph_id, e.id, e.relation,
               case when list_contains(string_split(coalesce(l.legal, ''), ','), e.relation) then l.legal
                    when l.legal is null then e.relation else e.relation || ',' || l.legal end as choices
        from edges_now e
        left join nodes_now s on s.graph_id = e.graph_id and s.id = e.subject
        left join nodes_now o on o.graph_id = e.graph_id and o.id = e.object
        left join {_pairs()} l on l.subj_type = s.type and l.obj_type = o.type""",
    "incident_edges": """
        select n.graph_id, n.id, e.id as edge_id, e.relation, case when e.subject = n.id then '→' else '←' end as direction,
               case when e.subject = n.id then e.object else e.subject end as other,
               coalesce(nullif(o.text, ''), o.id, '?') as other_text
        from nodes_now n
        join edges_now e on e.graph_id = n.graph_id and not e.dropped and (e.subject = n.id or e.object = n.id)
        left join nodes_now o on o.graph_id = n.graph_id and o.id = case when e.subject = n.id then e.object else e.subject end""",
    "rail_summary": """
        select graph_id, item, count(*) as n
        from (select graph_id, 'live ' || type as item from nodes_now where not dropped
              union all select graph_id, 'dropped nodes' from nodes_now where dropped
              union all select graph_id, 'added nodes' from nodes_now where added
              union all select graph_id, 'dropped edges' from edges_now where dropped
              union all select graph_id, 'added edges' from edges_now where added
              union all select graph_id, 'invalid edges' from status_now where reason is not null
              union all select graph_id, 'folded records' from whole_folds
              union all select graph_id, 'folded records' from folds
              union all select graph_id, 'refused nodes' from rejects where kind = 'node'
              union all select graph_id, 'relations across pieces' from judged_proposed where accepted) t
        group by graph_id, item""",
    "drawable_components": """
        select n.graph_id, n.id, l.component from nodes_now n
        join (select graph_id, a as ord, min(b) as component from drawn_reach group by graph_id, a) l
             on l.graph_id = n.graph_id and l.ord = n.ord
        where not n.dropped""",
    "corpus_components": """
        select l.graph_id, l.component, s.graphs, coalesce(w.works, 0) as sources
        from corpus_labels l
        join (select component, count(*) as graphs from corpus_labels group by component) s on s.component = l.component
        left join (select k.component, count(distinct c.iri) as works
                   from corpus_works c join corpus_labels k on k.graph_id = c.graph_id group by k.component) w on w.component = l.component""",
    "drawable_edges": "select graph_id, id, subject, object from status_now where reason is null",
    "degrees": """
        select n.graph_id, n.id, n.type, count(d.id) as degree,
               case when n.type = 'Claim' then 13 else 9 end + least(count(d.id), 8) * 1.5::double as radius
        from nodes_now n left join drawn_ends d on d.graph_id = n.graph_id and d.id = n.id
        where not n.dropped group by n.graph_id, n.id, n.type""",
    "components": """
        select n.graph_id, n.id, l.component from nodes n join labels l on l.graph_id = n.graph_id and l.ord = n.ord""",
    "component_sizes": """
        select graph_id, component, count(*) as size,
               row_number() over (partition by graph_id order by count(*) desc, component) = 1 as is_main
        from labels group by graph_id, component""",
    "structure_signature": "select graph_id, signature from signatures_after",
    "structure_changes": """
        select coalesce(a.graph_id, b.graph_id) as graph_id from signatures_after a
        full join signatures_before b on a.graph_id = b.graph_id where a.signature is distinct from b.signature""",
    "orphans": """
        select n.graph_id, n.type, count(*) as nodes,
               count(*) filter (where not exists (select 1 from edges e where e.graph_id = n.graph_id
                                                  and (e.subject = n.id or e.object = n.id))) as unwired
        from nodes n group by n.graph_id, n.type""",
    "run_report": _report_sql(),
    "corpus_totals": f"""
        select split_part(graph_id, '-', 1) as source, graph_id, sum(columns(* exclude (graph_id)))::bigint
        from ({_report_sql()}) t group by rollup (split_part(graph_id, '-', 1), graph_id)""",
    "reply_report": f"""
        select a.graph_id, max(p.title) as title, coalesce(max(v.nodes), 0) as nodes, coalesce(max(v.rejected), 0) as rejected,
               max(c.calls) as calls, max(c.cost) as cost, max(c.models) as models, max(c.why) as why
        from attempts a
        left join (select graph_id, count(usage) filter (where outcome = 'ok') as calls,
                          coalesce(sum(case when outcome = 'ok' and json_type(usage, '$.cost') in ('UBIGINT', 'BIGINT', 'DOUBLE')
                                            then cast(json_extract_string(usage, '$.cost') as double) end), 0.0) as cost,
                          (select string_agg(m, ' + ' order by first) from
                             (select case when k.model = '' then k.asked else k.model end as m, min(k.attempt) as first
                              from calls k where k.graph_id = calls.graph_id and k.outcome = 'ok' group by 1) z) as models,
                          case when count(*) filter (where outcome = 'ok' and parse <> 'none') = 0
                               then case when max_by(outcome, attempt) = 'ok' then 'no usable graph in the reply'
                                         else max_by(outcome, attempt) end end as why
                   from calls group by graph_id) c on c.graph_id = a.graph_id
        left join (select graph_id, count(*) filter (where why is null) as nodes, count(*) filter (where why is not null) as rejected
                   from ({_REPLY_VERDICTS}) r group by graph_id) v on v.graph_id = a.graph_id
        left join (select graph_id, nullif({strip(_string('reply', '$.paper.title'))}, '') as title from calls
                   where outcome = 'ok' and parse <> 'none') p on p.graph_id = a.graph_id
        group by a.graph_id""",
    "working_graphs": f"""
        select graph_id, 'source' as part,
               cast(to_json({{'source': graph_id, 'slug': graph_id}}) as varchar) as row_json
        from (select distinct graph_id from nodes) t
        union all
        select graph_id, 'paper', cast(to_json({{'title': title, 'doi': doi, 'license': license, 'authors':
                   case when author_2 is null then [{{'name': author_1, 'orcid': orcid_1}}]
                        else [{{'name': author_1, 'orcid': orcid_1}}, {{'name': author_2, 'orcid': null}}] end}}) as varchar)
        from paper_info
        union all
        select graph_id, 'nodes', cast(to_json({{'ord': ord, 'id': id, 'type': type, 'text': text, 'description': description, 'doi': doi,
                                                'url': url, 'anchor': anchor}}) as varchar)
        from nodes
        union all
        select graph_id, 'edges', cast(to_json({{'ord': pos, 'relation': relation, 'subject': subject, 'object': object, 'anchor': anchor,
                                                'consolidated': false}}) as varchar)
        from edges
        union all
        select graph_id, 'dropped', cast(to_json({{'kind': kind, 'pos': pos, 'why': why, 'payload': payload}}) as varchar) from rejects
        union all
        select graph_id, 'report', cast(to_json({{{_report_fields()}}}) as varchar) from ({_report_sql()}) t""",
    "stream_lines": "select gen_id, seq, id, model, content, reasoning, error, usage from decoded",
    "generation_facts": """
        select gen_id, max_by(id, seq) filter (where id is not null) as id, max_by(model, seq) filter (where model is not null) as model,
               max_by(usage, seq) filter (where usage is not null) as usage, min_by(error, seq) filter (where error is not null) as error,
               cast(coalesce(sum(length(reasoning)), 0) as bigint) as reasoning_chars,
               cast(coalesce(sum(length(content)), 0) as bigint) as content_chars
        from (select d.*, min(seq) filter (where error is not null) over (partition by gen_id) as failed from decoded d) t
        where failed is null or seq <= failed group by gen_id""",
    "reassembled": f"""
        select d.gen_id, d.seq // 10000 as block, coalesce(string_agg(delta, '' order by seq) filter (where kind = 'content'), '') as content,
               cast(coalesce(sum(length(delta)) filter (where kind = 'reasoning'), 0) as bigint) as reasoning_chars,
               cast(length(coalesce(string_agg(delta, '') filter (where kind = 'content'), '')) as bigint) as content_chars,
               any_value(e.empty) as empty
        from deltas d
        join (select gen_id, {strip("coalesce(string_agg(delta, '') filter (where kind = 'content'), '')")} = '' as empty
              from deltas group by gen_id) e on e.gen_id = d.gen_id
        group by d.gen_id, d.seq // 10000""",
    "idle_stalls": _gaps("deltas", catalog.IDLE),
    "progress_stalls": _gaps("(select * from deltas where kind <> 'keepalive')", catalog.PROGRESS),
    "stall_reasons": f"""
        select gen_id, min(due) as stalled_at,
               case when arg_min(rank, epoch_us(due) * 2 + rank) = 0 then 'silent for {catalog.IDLE}s'
                    else 'no tokens for {catalog.PROGRESS}s' end as reason
        from (select gen_id, since + {catalog.IDLE} * interval '1' second as due, 0 as rank from ({_gaps('deltas', catalog.IDLE)}) a
              union all
              select gen_id, since + {catalog.PROGRESS} * interval '1' second, 1
              from ({_gaps("(select * from deltas where kind <> 'keepalive')", catalog.PROGRESS)}) b) t
        group by gen_id""",
    "latest_status": """
        select run_id, max_by(message, seq) as status from events_json where type = 'status' and message is not null group by run_id""",
    "run_results": f"""
        select run_id, case when e is not null then 'error' when d is not null then 'result' else 'ended early' end as state,
               case when e is not null then e when d is null
                    then 'the log ends without a result' end as error,
               case when e is null then d end as data
        from (select run_id, max_by(coalesce(message, 'failed without a message'), seq) filter (where type = 'error') as e,
                     max_by(data, seq) filter (where type = 'result' and data is not null) as d
              from events_json group by run_id) t""",
    "latest_patches": """
        select graph_id, target_id, noun, field, seq, value
        from (select *, row_number() over (partition by graph_id, target_id, noun, field order by seq desc) as n
              from (select graph_id, target_id, regexp_extract(op, '(Node|Edge|Paper)$', 1) as noun, seq, field, value
                    from (select graph_id, target_id, op, seq, 'text' as field, new_text as value, new_text is not null as is_set from edits
                          union all select graph_id, target_id, op, seq, 'type', new_type, new_type is not null from edits
                          union all select graph_id, target_id, op, seq, 'description', null, clears_description = 1 from edits
                          union all select graph_id, target_id, op, seq, 'relation', new_relation, new_relation is not null from edits
                          union all select graph_id, target_id, op, seq, 'subject', new_subject, new_subject is not null from edits
                          union all select graph_id, target_id, op, seq, 'object', new_object, new_object is not null from edits
                          union all select graph_id, target_id, op, seq, 'title', new_title, new_title is not null from edits
                          union all select graph_id, target_id, op, seq, 'authors', '[{"name":"' || new_author || '"}]', new_author is not null from edits) f
                    where is_set and op like 'edit%'
                    union all
                    select graph_id, target_id, regexp_extract(op, '(Node|Edge)$', 1), seq, 'dropped',
                           case when op like 'drop%' then 'true' else 'false' end
                    from edits where op like 'drop%' or op like 'restore%') u) v
        where n = 1""",
}


def _parts() -> dict[str, str]:
    named = {name: fixtures.view_sql(name) for name in fixtures.VIEWS}
    # The views' type name for text is the other engine's.
    named = {name: sql.replace("as string)", "as varchar)") for name, sql in named.items()}
    return {**named, **STEPS}


def _merged_parts() -> dict[str, str]:
    """The steps with nodes and edges renumbered and folded before everything that follows classification."""
    parts = _parts()
    base = lambda name: re.sub(r"\b(nodes|edges)\b", r"m_base_\1", parts[name])
    best = lambda name, order: (
        f"(select m.{name} from m_heads m where m.graph_id = h.graph_id and m.survivor = h.survivor"
        f" and m.{name} is not null order by {order} limit 1)"
    )
    return parts | {
        "m_base_nodes": parts["nodes"],
        "judged_edges": base("judged_edges"),
        "m_base_edges": parts["edges"],
        "m_heads": f"""
            select *, first_value('g' || ord) over w as survivor, first_value(ord) over w as head
            from (select *, {squeeze('lower(text)')} as same from m_base_nodes) t
            window w as (partition by graph_id, type, same order by ord)""",
        "nodes": f"""
            select graph_id, pos, row_number() over (partition by graph_id order by ord) - 1 as ord, survivor as id, type, text,
                   {best('description', 'length(m.description) desc, m.ord')} as description, doi, url,
                   {best('anchor', 'm.ord')} as anchor
            from m_heads h where ord = head""",
        "edges": """
            select graph_id, pos, row_number() over (partition by graph_id order by pos) - 1 as ord, relation, subject, object, anchor
            from (select e.graph_id, e.pos, e.relation, s.survivor as subject, o.survivor as object, e.anchor,
                         row_number() over (partition by e.graph_id, e.relation, s.survivor, o.survivor order by e.pos) as copy
                  from m_base_edges e
                  join m_heads s on s.graph_id = e.graph_id and s.id = e.subject
                  join m_heads o on o.graph_id = e.graph_id and o.id = e.object) t
            where copy = 1""",
    }


def _reply_parts() -> dict[str, str]:
    """The steps over the records and attributions of the winning replies."""
    text = lambda name: f"{_string('rec', '$.' + name)} as {name}"
    entries = lambda kind: f"""
        (select graph_id, cast(i as bigint) as pos, json_extract(reply, '$.{kind}[' || i || ']') as rec
         from (select graph_id, reply, unnest(range(cast(json_array_length(reply, '$.{kind}') as bigint))) as i
               from calls where outcome = 'ok' and parse <> 'none') t) u"""  # noqa: E731
    nodes = ", ".join(map(text, ("id", "type", "text", "description", "doi", "url", "anchor")))
    edges = ", ".join(map(text, ("relation", "subject", "object", "anchor")))
    parts = _parts() | {
        "raw_nodes": f"select graph_id, pos, {nodes} from {entries('nodes')}",
        "raw_edges": f"select graph_id, pos, {edges} from {entries('edges')}",
        "call_records": "select graph_id, reply from calls where outcome = 'ok' and parse <> 'none'",
        "paper_info": QUERIES["authors_clean"],
        "counted": _report_sql(),
    }
    # Keys of the replies are written in two pieces, as steps of these names would be taken for needed.
    apart = lambda sql: re.sub(r"""(\$\.|")(no|ed)(des|ges)\b""", r"\1\2' || '\3", sql)
    return {name: apart(sql) for name, sql in parts.items()}


def _paper_report_sql() -> str:
    plain = ["nodes", "edges", "node_anchors", "edge_anchors", "stamp_spine", "stamp_paper", "stamp_none", "reject_node", "reject_dangling",
             "reject_ungrammatical", "folded_edges"]
    listing = lambda kind, names: ", ".join(f"case when c.{kind}_{n.lower()} > 0 then '{n}=' || c.{kind}_{n.lower()} end" for n in names)
    return f"""
        select a.graph_id, p.title, nullif(p.authors, '') as authors, p.doi, p.license,
               {', '.join(f'coalesce(c.{name}, 0) as {name}' for name in plain)},
               concat_ws(', ', {listing('class', NODE_CLASSES)}) as classes,
               concat_ws(', ', {listing('relation', [name for name, _, _ in RELATIONS])}) as relations,
               f.why as failure, n.notes, m.models, coalesce(r.calls, 0) as calls, coalesce(r.cost, 0.0) as cost
        from (select distinct graph_id from attempts) a
        left join counted c on c.graph_id = a.graph_id
        left join paper_info p on p.graph_id = a.graph_id
        left join ({QUERIES['failure_ledger']}) f on f.graph_id = a.graph_id
        left join (select graph_id, string_agg(concat_ws(': ', note, detail), ' | ' order by note) as notes
                   from ({QUERIES['omission_notes']}) x group by graph_id) n on n.graph_id = a.graph_id
        left join (select graph_id, string_agg(model, ' + ' order by use_no) as models
                   from ({QUERIES['models_first_use']}) x group by graph_id) m on m.graph_id = a.graph_id
        left join ({QUERIES['cost_receipt']}) r on r.graph_id = a.graph_id"""


def _merged_stage_parts() -> dict[str, str]:
    """The steps of the merged graph with the edit log carried over to its records."""
    parts = _merged_parts()
    refused = "select graph_id, pos, case when verdict = 'dangling' then 1 else 2 end as branch, relation, subject, object from judged_edges where verdict in ('dangling', 'ungrammatical')"
    stranger = lambda x: f"case when regexp_full_match({x}, '[gn][0-9]+') then '?' || {x} else {x} end"
    numbered = "row_number() over (partition by graph_id order by branch, pos) - 1"
    adds = parts["adds"].replace("edits", "own_edits")
    return parts | {
        "own_edits": parts["edits"],
        "refused": refused,
        "old_staged": f"select graph_id, branch, pos, {numbered} as ord from (select graph_id, pos, 0 as branch from m_base_edges union all select graph_id, pos, branch from refused) t",
        "staged": f"""
            select graph_id, branch, pos, {numbered} as ord, relation, subject, object, anchor
            from (select graph_id, pos, 0 as branch, relation, subject, object, anchor from edges
                  union all
                  select r.graph_id, r.pos, r.branch, r.relation, coalesce(s.survivor, {stranger('r.subject')}),
                         coalesce(o.survivor, {stranger('r.object')}), null
                  from refused r
                  left join m_heads s on s.graph_id = r.graph_id and s.id = r.subject
                  left join m_heads o on o.graph_id = r.graph_id and o.id = r.object) t""",
        "edge_names": """
            select b.graph_id, 'x' || b.ord as old_id, 'x' || t.ord as id
            from old_staged b
            join m_base_edges e on b.branch = 0 and e.graph_id = b.graph_id and e.pos = b.pos
            join m_heads s on s.graph_id = e.graph_id and s.id = e.subject
            join m_heads o on o.graph_id = e.graph_id and o.id = e.object
            join staged t on t.branch = 0 and t.graph_id = e.graph_id and t.relation = e.relation and t.subject = s.survivor
                             and t.object = o.survivor
            union all
            select b.graph_id, 'x' || b.ord, 'x' || t.ord
            from old_staged b join staged t on b.branch > 0 and t.graph_id = b.graph_id and t.branch = b.branch and t.pos = b.pos""",
        "old_adds": re.sub(r"\bstaged\b", "old_staged", re.sub(r"\bnodes\b", "m_base_nodes", adds)),
        "new_adds": adds,
        "names": """
            select graph_id, 'Node' as noun, id as old_id, survivor as id from m_heads
            union all select graph_id, 'Edge', old_id, id from edge_names
            union all select a.graph_id, case when a.op = 'addNode' then 'Node' else 'Edge' end, a.id, b.id
            from old_adds a join new_adds b on b.graph_id = a.graph_id and b.seq = a.seq""",
        "edits": f"""
            select e.* exclude (target_id, new_subject, new_object), t.id as target_id,
                   coalesce(s.id, {stranger('e.new_subject')}) as new_subject, coalesce(o.id, {stranger('e.new_object')}) as new_object
            from own_edits e
            left join names t on t.graph_id = e.graph_id and t.noun = regexp_extract(e.op, '(Node|Edge)$', 1) and t.old_id = e.target_id
            left join names s on s.graph_id = e.graph_id and s.noun = 'Node' and s.old_id = e.new_subject
            left join names o on o.graph_id = e.graph_id and o.noun = 'Node' and o.old_id = e.new_object""",
    }


def _edited_parts() -> dict[str, str]:
    """The steps with the exported records, relations and attribution in place of the classified ones."""
    parts = _parts()
    moved = {"nodes": "x_nodes", "edges": "x_edges", "paper_info": "x_paper_info"}
    word = re.compile(r"\b(nodes|edges|paper_info)\b")
    chain = ["judged_edges", "staged", "adds", "stage_nodes", "edges", "nodes", "paper_info"]
    base = {name: word.sub(lambda m: moved[m.group(1)], parts[name]) for name in chain}
    return parts | base | {
        "x_nodes": base["nodes"],
        "x_edges": base["edges"],
        "x_paper_info": base["paper_info"],
        "nodes": "select *, ord as pos from exported",
        "edges": f"select *, ord as pos from ({QUERIES['export_edges']})",
        "paper_info": """
            select coalesce(p.graph_id, e.graph_id) as graph_id, coalesce(e.title, p.title) as title, coalesce(e.author, p.author_1) as author_1,
                   case when e.author is null then p.orcid_1 end as orcid_1, case when e.author is null then p.author_2 end as author_2,
                   p.* exclude (graph_id, title, author_1, orcid_1, author_2)
            from x_paper_info p
            full join (select graph_id, max_by(new_title, seq) as title, max_by(new_author, seq) filter (where new_author is not null) as author
                       from edits where op = 'editPaper' group by graph_id) e
                   on e.graph_id = p.graph_id""",
        "account_rows": parts["account_rows"].replace(catalog.NAMING.creator, catalog.EDITOR_NAMING.creator),
    }


def compose(sql: str, parts: dict[str, str] | None = None) -> str:
    """``sql`` preceded by the named steps it needs, directly or through others, in dependency order."""
    parts = parts or _parts()
    word = re.compile(r"\b(" + "|".join(parts) + r")\b")
    ordered: list[str] = []

    def need(text: str, above: tuple[str, ...] = ()) -> None:
        for name in dict.fromkeys(word.findall(text)):
            if name in ordered or name in above:
                continue
            need(parts[name], (*above, name))
            ordered.append(name)

    need(sql)
    if not ordered:
        return sql.strip()
    steps = ",\n".join(f"{name} as ({parts[name].strip()})" for name in ordered)
    return f"with recursive {steps}\n{sql.strip()}"


def oracle_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in QUERIES.items()} | {
        "build_documents": compose(_DOCUMENTS, _merged_parts()),
        "edited_documents": compose(_DOCUMENTS, _edited_parts()),
        "paper_report": compose(_paper_report_sql(), _reply_parts()),
        "piece_failures": compose(
            f"select substr(graph_id, 1, 1) as graph_id, cast(substr(graph_id, 2) as bigint) as piece, why from ({QUERIES['failure_ledger']}) f"
        ),
        "merged_edited_nodes": compose(QUERIES["edited_nodes"], _merged_stage_parts()),
        "merged_edited_edges": compose(QUERIES["edited_edges"], _merged_stage_parts()),
    }
