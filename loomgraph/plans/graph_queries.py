"""Registered queries on the graph: merges, reports, search, neighbourhood, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import audit, merge, search, structure
from loomgraph.plans import demo
from loomgraph.plans.demo import graph_sql, layer_sql, node_sql
from loomgraph.plans.registry import query

AS_OF = "2025-06-30"
TYPES = ["REGION", "NATION", "CUSTOMER", "SUPPLIER", "PART", "BRAND", "SEGMENT", "MATERIAL", "PROCESS"]
TYPES_SQL = "types as (select unnest(['REGION','NATION','CUSTOMER','SUPPLIER','PART','BRAND','SEGMENT','MATERIAL','PROCESS']) as type_name)"


def _types(spark):
    return spark.createDataFrame([(t,) for t in TYPES], "type_name string")


@query(node_sql("select * from nodes"))
def mut1_node_upsert(spark, sf):
    return demo.merged_nodes(spark, sf)


@query(graph_sql("select * from edges"))
def mut2_edge_upsert(spark, sf):
    return demo.merged_edges(spark, sf)


@query(node_sql("""select label, lower(text) as canonical_name, arg_min(text, ord) as text, arg_max(text, ord) as name, max(confidence) as confidence, bool_or(verified) as verified,
  string_agg(source_doc, ', ' order by ord) as source_docs, arg_min(seen, ord) as created_at, max(seen) as last_confirmed_at from
  (select * replace (case when ord % 2 = 0 then ord else ord + 100000000 end as ord) from mentions) m group by label, lower(text)"""))
def mut1_second_batch(spark, sf):
    """A snapshot of the even mentions, then the odd ones merged into it: what one merge of both in that order gives."""
    m = merge.keyed_mentions(demo.mentions(spark, sf))
    old = merge.merge_nodes(None, m.where("ord % 2 = 0"))
    return merge.merge_nodes(old, m.where("ord % 2 = 1"))


@query(graph_sql("""select distinct subj_label, lower(subj) as subj, predicate, obj_label, lower(obj) as obj, 'obj' as missing from edge_mentions e
  where not exists (select 1 from nodes n where n.label = obj_label and n.canonical_name = lower(obj))
  union all select distinct subj_label, lower(subj), predicate, obj_label, lower(obj), 'subj' from edge_mentions e
  where not exists (select 1 from nodes n where n.label = subj_label and n.canonical_name = lower(subj))"""))
def join1_dangling_edges(spark, sf):
    return merge.dangling_ends(merge.keyed_edges(demo.edge_mentions(spark, sf)), demo.nodes(spark, sf)).distinct()


@query(layer_sql("select (select count(*) from all_nodes) as n_nodes, (select count(*) from all_edges) as n_edges"))
def agg1_graph_size(spark, sf):
    return audit.graph_size(demo.all_nodes(spark, sf), demo.all_edges(spark, sf))


@query(node_sql("select label, count(*) as n from nodes group by label"))
def agg2_entity_counts(spark, sf):
    return audit.counts(demo.nodes(spark, sf), "label")


@query(graph_sql("select predicate, count(*) as n from edges group by predicate"))
def agg3_relationship_counts(spark, sf):
    return audit.counts(demo.edges(spark, sf), "predicate")


@query(node_sql("select label, lower(text) as canonical_name, count(*) as n from mentions group by label, lower(text) having count(*) > 1"))
def agg4_duplicates(spark, sf):
    return audit.duplicates(merge.keyed_mentions(demo.mentions(spark, sf)), ["label", "canonical_name"])


@query(layer_sql(TYPES_SQL + """, ends as (select subj_label as label, subj as canonical_name from all_edges union select obj_label, obj from all_edges),
  own as (select * from all_nodes where label not in ('Document', 'Section')), facts as (select * from all_edges where predicate not in ('BELONGS_TO', 'EXTRACTED_FROM')),
  n as (select count(*) as n_entities, round(avg(confidence), 3) as avg_confidence, count(*) filter (confidence < 0.6) as low_nodes,
    count(*) filter (not coalesce(verified, true)) as unverified_nodes, count(distinct label) as n_labels from own),
  e as (select count(*) as n_facts, count(*) filter (confidence < 0.6) as low_edges, count(*) filter (not coalesce(verified, true)) as unverified_edges from facts),
  o as (select count(*) as n_orphans from own n where not exists (select 1 from ends where ends.label = n.label and ends.canonical_name = n.canonical_name)),
  t as (select string_agg(type_name, ',' order by type_name) as unused_types from types where type_name not in (select label from own)),
  c as (select count(*) as total_sections, count(*) filter (id in (select section_id from extracted)) as covered_sections from secs)
  select *, (select count(*) from all_nodes) as n_nodes, (select count(*) from all_edges) as n_edges, round(n_facts::double / n_entities, 2) as density,
    round(covered_sections::double / total_sections * 100, 1) as document_coverage from n, e, o, t, c"""))
def agg5_graph_health(spark, sf):
    return audit.graph_health(demo.all_nodes(spark, sf), demo.all_edges(spark, sf), _types(spark))


@query("select distinct least(p_brand, p_type) as a, greatest(p_brand, p_type) as b from part")
def agg10_contradiction_pairs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return audit.contradiction_pairs(p.select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).unionByName(p.select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"))))


@query(layer_sql("select label, canonical_name from all_nodes where label not in ('Document', 'Section', 'REGION')"))
def flt1_exclude_labels(spark, sf):
    return demo.all_nodes(spark, sf).where(audit.domain("label") & (F.col("label") != "REGION")).select("label", "canonical_name")


_WIDE = """select 'Document' as label, cast(doc_id as string) as filename, cast(null as string) as canonical_name, source as name from {documents}
 union all select 'CUSTOMER', null, lower(c_name), null from {customer} union all select 'PART', null, null, p_name from {part}"""


@query("with w as (" + demo._plain(_WIDE) + """) select label, bool_or(filename is not null) as is_structure,
  case when bool_or(canonical_name is not null) then 'canonical_name' when bool_or(name is not null) then 'name' when bool_or(filename is not null) then 'filename' end as name_column from w group by label""")
def flt2_label_config(spark, sf):
    return audit.label_config(demo.base(spark, sf, _WIDE), ["filename"], ["canonical_name", "name", "filename"])


@query("with w as (" + demo._plain(_WIDE) + ") select 'canonical_name' as field, bool_or(canonical_name is not null) as present from w union all select 'name', bool_or(name is not null) from w union all select 'filename', bool_or(filename is not null) from w")
def flt3_present_fields(spark, sf):
    return audit.present_fields(demo.base(spark, sf, _WIDE), ["canonical_name", "name", "filename"])


@query(layer_sql("""select 'node' as kind, count(*) as n from all_nodes where confidence < 0.6 and label not in ('Document', 'Section')
  union all select 'edge', count(*) from all_edges where confidence < 0.6 and predicate not in ('BELONGS_TO', 'EXTRACTED_FROM')"""))
def flt5_low_confidence(spark, sf):
    low = lambda df, k: df.where(F.col("confidence") < audit.LOW).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return low(demo.all_nodes(spark, sf).where(audit.domain("label")), "node").unionByName(low(demo.all_edges(spark, sf).where(structure.knowledge()), "edge"))


@query(node_sql("select label, canonical_name, confidence from nodes where not coalesce(verified, true)"))
def flt6_unverified_nodes(spark, sf):
    return audit.unverified(demo.nodes(spark, sf)).select("label", "canonical_name", "confidence").orderBy("label", "canonical_name")


@query(layer_sql("""select subj_label, subj, predicate, obj_label, obj from all_edges
  where not coalesce(verified, true) and subj_label not in ('Document', 'Section') and obj_label not in ('Document', 'Section')"""))
def flt7_unverified_edges(spark, sf):
    e = audit.unverified(demo.all_edges(spark, sf)).where(audit.domain("subj_label") & audit.domain("obj_label"))
    return e.select(*merge.EDGE_KEY).orderBy("predicate", "subj")


@query(node_sql("select label, coalesce(nullif(canonical_name, ''), nullif(name, ''), text) as display from nodes"))
def prj1_display_name(spark, sf):
    return demo.nodes(spark, sf).select("label", audit.display_name().alias("display"))


_PROPS = """props as (select label, canonical_name, k, v from (unpivot (select label, canonical_name, cast(confidence as string) as confidence, name, source_docs from nodes) on confidence, name, source_docs into name k value v) where v is not null and v not in ('', '{}'))"""


def _props(spark, sf):
    return audit.properties(demo.sourced_nodes(spark, sf), ["confidence", "name", "source_docs"])


@query(node_sql(", " + _PROPS + " select * from props"))
def prj2_properties(spark, sf):
    return _props(spark, sf)


@query(layer_sql("""facts as (select * from all_edges where subj_label not in ('Document', 'Section') and obj_label not in ('Document', 'Section'))
  select subj as canonical_name, '→' as direction, predicate, obj_label as other_label, obj as other from facts where subj in (select lower(s_name) from supplier)
  union all select obj, '←', predicate, subj_label, subj from facts where obj in (select lower(s_name) from supplier)"""))
def join6_related(spark, sf):
    names = spark.read.parquet(f"{sf}/supplier.parquet").select(F.lower("s_name").alias("canonical_name")).distinct()
    return search.related(demo.all_edges(spark, sf), names)


@query(graph_sql("select a.subj_label as a_label, a.subj as a, a.obj_label as b_label, a.obj as b, b.obj_label as c_label, b.obj as c from edges a join edges b on a.obj_label = b.subj_label and a.obj = b.subj where a.predicate = 'SUPPLIES' and b.predicate = 'HAS_BRAND'"))
def join7_two_hop_chains(spark, sf):
    return search.chains(demo.edges(spark, sf), "SUPPLIES", "HAS_BRAND").select("a_label", "a", "b_label", "b", "c_label", "c")


@query(graph_sql(""", p as (select lower(a.s_name) as a, lower(b.s_name) as b from supplier a join supplier b on b.s_suppkey = a.s_suppkey + 1),
  d as (select distinct subj, obj_label, obj from edges) select p.a, p.b, x.obj_label, x.obj from p join d x on x.subj = p.a join d y on y.subj = p.b and x.obj_label = y.obj_label and x.obj = y.obj"""))
def join8_shared_connections(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    pairs = s.select(F.lower("s_name").alias("a"), (F.col("s_suppkey") + 1).alias("k")).join(s.select(F.lower("s_name").alias("b"), F.col("s_suppkey").alias("k")), "k").select("a", "b")
    return search.shared_neighbours(demo.edges(spark, sf), pairs)


@query(graph_sql(""", g as (select row_number() over (order by subj_label, subj, predicate, obj_label, obj) as eid, * from edges),
  b as (select eid, subj_label as fl, subj as f, predicate, obj_label as tl, obj as t from g union all select eid, obj_label, obj, predicate, subj_label, subj from g),
  p1 as (select n.canonical_name as start, b.tl, b.t, [b.eid] as used, b.predicate as predicates, n.canonical_name || '>' || b.t as names from nodes n join b on b.fl = n.label and b.f = n.canonical_name where n.label = 'REGION'),
  p2 as (select start, b.tl, b.t, list_append(used, b.eid) as used, predicates || '>' || b.predicate as predicates, names || '>' || b.t as names from p1 join b on b.fl = p1.tl and b.f = p1.t where not list_contains(used, b.eid)),
  p3 as (select start, b.tl, b.t, used, predicates || '>' || b.predicate as predicates, names || '>' || b.t as names from p2 join b on b.fl = p2.tl and b.f = p2.t where not list_contains(used, b.eid))
  select start, t as "end", 1 as length, predicates, names from p1 union all select start, t, 2, predicates, names from p2 union all select start, t, 3, predicates, names from p3"""))
def join9_bounded_paths(spark, sf):
    return search.paths(demo.edges(spark, sf), demo.nodes(spark, sf).where("label = 'REGION'"), 3)


@query(graph_sql("select a.subj_label, a.subj, a.obj_label, a.obj, 'SHUNS' as a, 'SUPPLIES' as b, a.confidence as conf_a, b.confidence as conf_b from edges a join edges b on a.subj_label = b.subj_label and a.subj = b.subj and a.obj_label = b.obj_label and a.obj = b.obj where a.predicate = 'SHUNS' and b.predicate = 'SUPPLIES'"))
def join10_conflicts(spark, sf):
    rules = spark.createDataFrame([("SHUNS", "SUPPLIES"), *audit.CONTRADICTIONS], "a string, b string")
    return audit.conflicts(demo.edges(spark, sf), rules)


@query(layer_sql("""ends as (select subj_label as label, subj as canonical_name from all_edges union select obj_label, obj from all_edges)
  select label, canonical_name from all_nodes n where label not in ('Document', 'Section') and not exists (select 1 from ends where ends.label = n.label and ends.canonical_name = n.canonical_name)"""))
def join12_orphans(spark, sf):
    """Entities that no edge touches, not even one to a section."""
    return merge.orphans(demo.all_nodes(spark, sf).where(audit.domain("label")), demo.all_edges(spark, sf)).select("label", "canonical_name")


@query(node_sql(", " + TYPES_SQL + " select type_name from types where type_name not in (select label from nodes)"))
def join13_unused_types(spark, sf):
    return audit.unused_types(_types(spark), demo.nodes(spark, sf))


_DECAY = "round(confidence * pow(0.998, date_diff('day', last_confirmed_at, date '2025-06-30')), 6)"


@query(node_sql(f"select label, canonical_name, {_DECAY} as effective from nodes"))
def fn18_effective_confidence(spark, sf):
    eff = T.effective_confidence(F.col("confidence"), F.col("last_confirmed_at"), F.to_date(F.lit(AS_OF)), 0.998)
    return demo.nodes(spark, sf).select("label", "canonical_name", F.round(eff, 6).alias("effective"))


@query(node_sql(f"select label, canonical_name, {_DECAY} as effective from nodes where confidence * pow(0.998, date_diff('day', last_confirmed_at, date '2025-06-30')) < 0.3"))
def fn19_decayed(spark, sf):
    return audit.decayed(demo.nodes(spark, sf), F.to_date(F.lit(AS_OF)), 0.998, 0.3).select("label", "canonical_name", "effective").orderBy("effective")


@query(node_sql("select label, canonical_name, confidence from nodes order by confidence desc nulls last, canonical_name, label limit 25"))
def top1_best_nodes(spark, sf):
    return search.top_hits(demo.nodes(spark, sf), 25).select("label", "canonical_name", "confidence")


@query(node_sql("select canonical_name from nodes where label = 'SUPPLIER' order by canonical_name limit 20"))
def top2_list_type(spark, sf):
    return demo.nodes(spark, sf).where(F.col("label") == F.upper(F.lit("supplier"))).select("canonical_name").orderBy("canonical_name").limit(20)


@query(graph_sql("select subj, predicate, obj from edges order by predicate, subj, obj, subj_label, obj_label limit 50"))
def top3_triples(spark, sf):
    return demo.edges(spark, sf).orderBy("predicate", "subj", "obj", "subj_label", "obj_label").select("subj", "predicate", "obj").limit(50)


@query(graph_sql("select subj, predicate, obj from edges order by md5('7:' || subj || '|' || predicate || '|' || obj), subj limit 3"))
def top5_sampled_triples(spark, sf):
    return search.seeded_sample(demo.edges(spark, sf), F.concat_ws("|", "subj", "predicate", "obj"), 3, 7).select("subj", "predicate", "obj")


@query(graph_sql("select 'entity' as kind, label as type, count(*) as n from nodes group by label union all select 'relationship', predicate, count(*) from edges group by predicate"))
def gq10_schema(spark, sf):
    n, e = audit.counts(demo.nodes(spark, sf), "label"), audit.counts(demo.edges(spark, sf), "predicate")
    return n.select(F.lit("entity").alias("kind"), F.col("label").alias("type"), "n").unionByName(e.select(F.lit("relationship"), F.col("predicate").alias("type"), "n").toDF("kind", "type", "n"))


@query("select user_id as label, event_id::varchar as canonical_name, k, v from (select user_id, event_id, 'name' as k, event_type as v from events union all select user_id, event_id, k, json_extract_string(props, '$.' || k) from (select *, unnest(json_keys(props)) as k from events)) where v is not null and v not in ('', '{}')")
def prj2_nested_properties(spark, sf):
    """Events as nodes: the entries of their JSON stand beside the other properties."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = e.select(F.col("user_id").alias("label"), F.col("event_id").cast("string").alias("canonical_name"), F.col("event_type").alias("name"), "props")
    return audit.properties(n, ["name"], ["props"])


@query(node_sql("select label, canonical_name from nodes where contains(canonical_name, lower('Steel')) order by canonical_name, label limit 20"))
def gq1_simple_search(spark, sf):
    return search.search_entities(demo.nodes(spark, sf), "Steel").select("label", "canonical_name")


@query(node_sql("select label, canonical_name from nodes where contains(lower(canonical_name), '1') or contains(lower(source_docs), 'brand-3')"))
def gq2_multi_field_search(spark, sf):
    n = demo.sourced_nodes(spark, sf)
    return n.where(search.matches(F.lit("1"), ["canonical_name"]) | search.matches(F.lit("brand-3"), ["source_docs"])).select("label", "canonical_name")


@query(node_sql("select label, canonical_name from nodes where (contains(canonical_name, '1') or contains(lower(source_docs), '1')) and (contains(canonical_name, 'supplier') or contains(lower(source_docs), 'supplier'))"))
def gq3_all_words_search(spark, sf):
    return demo.sourced_nodes(spark, sf).where(search.all_words(F.lit("1 supplier"), ["canonical_name", "source_docs"])).select("label", "canonical_name")


#: Questions: every supplier's name in marks, every nation's with a noise word and a word too many, every region's in brackets.
_ASKED = """select concat('s', cast(s_suppkey as string)) as qid, concat('**', s_name, '**') as term from {supplier}
  union all select concat('n', cast(n_nationkey as string)), concat('the ', n_name, ' nowhere') from {nation} union all select concat('r', cast(r_regionkey as string)), concat('[', r_name, ']') from {region}"""
_FIND = """, q as (select qid, lower(translate(term, '®™©°*[](){}', '')) as term from (""" + demo._plain(_ASKED) + """)),
  w as (select qid, term, list_filter(string_split(term, ' '), lambda x: length(x) > 1 and x not in ('the','a','an','of','for','and','or','in','on','to','is','at','by','with')) as words from q),
  t as (select qid, 1 as tier, term as key, false as allw from q
    union all select qid, 1 + i, ks[i], false from (select qid, ks, unnest(range(1, len(ks) + 1)) as i from (select qid, list_concat([array_to_string(words, ' ')], case when len(words) > 1 then [array_to_string(words[2:], ' ')] else []::varchar[] end,
      list_transform(list_sort(list_transform(words, lambda x, j: {'n': -length(x), 'j': j, 'x': x})), lambda z: z.x)) as ks from w))
    union all select qid, 1000, term, true from q),
  h as (select t.qid, t.tier, n.label, n.canonical_name, n.confidence from nodes n join t on case when allw then len(list_filter(string_split(key, ' '), lambda x: not contains(n.canonical_name, x))) = 0 else contains(n.canonical_name, key) end),
  b as (select h.* from h join (select qid, min(tier) as tier from h group by qid) m using (qid, tier))
  select qid, label, canonical_name, confidence, row_number() over (partition by qid order by confidence desc nulls last, canonical_name, label) as rank from b qualify rank <= 10"""


@query(node_sql(_FIND))
def gq4_find(spark, sf):
    out = search.find(demo.nodes(spark, sf), demo.base(spark, sf, _ASKED), ["canonical_name"])
    return out.select("qid", "label", "canonical_name", "confidence", F.col("rank").cast("long").alias("rank"))


@query(node_sql("""select 's' || s_suppkey as qid, 'SUPPLIER' as label, lower(s_name) as canonical_name from supplier union all select 'r' || r_regionkey, 'REGION', lower(r_name) from region"""))
def gq5_resolve_name(spark, sf):
    asked = demo.base(spark, sf, _ASKED).where("qid not like 'n%'")
    return search.find(demo.nodes(spark, sf), asked, ["canonical_name"], limit=1, exact_first=True).select("qid", "label", "canonical_name")


@query(graph_sql(", " + _PROPS + """, hit as (select label, canonical_name from nodes where contains(canonical_name, 'supplier#00000000') order by confidence desc nulls last, canonical_name, label limit 10)
  select h.canonical_name, 'property' as kind, k, v from hit h join props p on p.label = h.label and p.canonical_name = h.canonical_name
  union all select h.canonical_name, '→', predicate, obj from hit h join edges on subj = h.canonical_name union all select h.canonical_name, '←', predicate, subj from hit h join edges on obj = h.canonical_name"""))
def gq6_details(spark, sf):
    n, e = demo.nodes(spark, sf), demo.edges(spark, sf)
    hit = search.top_hits(n.where(search.matches(F.lit("supplier#00000000"), ["canonical_name"])), 10).select("label", "canonical_name")
    own = _props(spark, sf).join(hit, ["label", "canonical_name"]).select("canonical_name", F.lit("property").alias("kind"), "k", "v")
    return own.unionByName(search.related(e, hit.select("canonical_name")).select("canonical_name", F.col("direction").alias("kind"), F.col("predicate").alias("k"), F.col("other").alias("v")))


@query(graph_sql("select '→' as direction, predicate, obj_label as other_label, obj as other from edges where subj = 'supplier#000000003' and predicate = 'SUPPLIES'"))
def gq7_related_typed(spark, sf):
    asked = spark.createDataFrame([("q", "Supplier#000000003")], "qid string, term string")
    name = search.find(demo.nodes(spark, sf), asked, ["canonical_name"], limit=1, exact_first=True).select("canonical_name")
    return search.related(demo.edges(spark, sf), name, "SUPPLIES").select("direction", "predicate", "other_label", "other")


@query(layer_sql(_PROPS + """, q as (select 'q' || a.s_suppkey as qid, lower(a.s_name) as a, lower(b.s_name) as b from supplier a join supplier b on b.s_suppkey = a.s_suppkey + 1),
  side as (select qid, 1 as side, a as name from q union all select qid, 2, b from q),
  facts as (select distinct subj, predicate, obj_label, obj from all_edges where subj_label not in ('Document', 'Section') and obj_label not in ('Document', 'Section'))
  select 'none' as qid, 2 as side, 'missing' as kind, 'zzqx' as k, null as v
  union all select qid, side, 'entity', 'SUPPLIER', name from side union all select qid, side, 'property', k, v from side join props on label = 'SUPPLIER' and canonical_name = name
  union all select qid, side, '→', predicate, obj from side join facts on subj = name
  union all select qid, 0, 'shared', x.obj_label || ' ' || x.obj, x.predicate || ' / ' || y.predicate from q join facts x on x.subj = q.a join facts y on y.subj = q.b and y.obj_label = x.obj_label and y.obj = x.obj"""))
def gq8_compare(spark, sf):
    """Every supplier beside the next one, and one question with a name that nobody has."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    pairs = s.select(F.col("s_name").alias("a"), F.col("s_suppkey").alias("k")).join(s.select(F.upper("s_name").alias("b"), (F.col("s_suppkey") - 1).alias("k")), "k")
    asked = pairs.select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("qid"), "a", "b")
    asked = asked.unionByName(s.agg(F.min("s_name").alias("a")).select(F.lit("none").alias("qid"), "a", F.lit("zzqx").alias("b")))
    return search.compare(asked, demo.all_nodes(spark, sf), demo.all_edges(spark, sf), _props(spark, sf))


@query(graph_sql("select distinct a.subj as s, a.obj as p, b.obj as brand, c.obj as nation from edges a join edges b on b.subj = a.obj and b.predicate = 'HAS_BRAND' join edges c on c.subj = a.subj and c.predicate = 'LOCATED_IN' where a.predicate = 'SUPPLIES'"))
def gq14_match_triples(spark, sf):
    return search.match_triples(demo.edges(spark, sf), [("?s", "SUPPLIES", "?p"), ("?p", "HAS_BRAND", "?brand"), ("?s", "LOCATED_IN", "?nation")]).select("s", "p", "brand", "nation")


@query(node_sql(""", q as (""" + demo._plain(_ASKED) + """), w as (select distinct qid, word from (select qid, unnest(string_split(lower(translate(term, '®™©°*[](){}', '')), ' ')) as word from q) where length(word) >= 3),
  m as (select qid, word, canonical_name, row_number() over (partition by qid, word order by canonical_name) as r from w join (select distinct canonical_name from nodes where coalesce(verified, true)) n on contains(canonical_name, word) qualify r <= 8)
  select qid, canonical_name from (select qid, canonical_name, row_number() over (partition by qid order by canonical_name) as rank from (select distinct qid, canonical_name from m)) where rank <= 10"""))
def top6_suggestions(spark, sf):
    return search.suggestions(demo.nodes(spark, sf), demo.base(spark, sf, _ASKED)).select("qid", "canonical_name")


@query(graph_sql("""select n.label, n.canonical_name from nodes n where exists (select 1 from edges where subj_label = n.label and subj = n.canonical_name) or exists (select 1 from edges where obj_label = n.label and obj = n.canonical_name)"""))
def mut5_delete_orphans(spark, sf):
    return merge.delete_orphans(demo.nodes(spark, sf), demo.edges(spark, sf)).select("label", "canonical_name")


_NAMES = "select lower(s_name) as canonical_name from {supplier} where s_acctbal < 3000"


@query(node_sql("select label, canonical_name, case when canonical_name in (" + demo._plain(_NAMES) + ") then date '2025-06-30' else last_confirmed_at end as last_confirmed_at from nodes"))
def mut6_reconfirm(spark, sf):
    return merge.reconfirm(demo.nodes(spark, sf), demo.base(spark, sf, _NAMES), F.to_date(F.lit(AS_OF))).select("label", "canonical_name", "last_confirmed_at")


@query(graph_sql(", gone as (" + demo._plain(_NAMES) + """) select 'node' as kind, label as a, canonical_name as b from nodes where canonical_name not in (select canonical_name from gone)
  union all select 'edge', subj, obj from edges where subj not in (select canonical_name from gone) and obj not in (select canonical_name from gone)"""))
def mut7_delete_by_name(spark, sf):
    n, e = merge.delete_nodes(demo.nodes(spark, sf), demo.edges(spark, sf), demo.base(spark, sf, _NAMES))
    return n.select(F.lit("node").alias("kind"), F.col("label").alias("a"), F.col("canonical_name").alias("b")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("subj").alias("a"), F.col("obj").alias("b")))


_DECIDED = "select 'CUSTOMER' as label, lower(c_name) as canonical_name from {customer} where c_acctbal > 2500"


@query(node_sql("select label, canonical_name, case when label = 'CUSTOMER' and canonical_name in (select canonical_name from (" + demo._plain(_DECIDED) + ")) then true else verified end as verified from nodes"))
def mut8_verify_nodes(spark, sf):
    return merge.verify_nodes(demo.nodes(spark, sf), demo.base(spark, sf, _DECIDED)).select("label", "canonical_name", "verified")


_EDGES_DECIDED = "select lower(s_name) as subj, 'LOCATED_IN' as predicate, lower(n_name) as obj from {supplier} join {nation} on s_nationkey = n_nationkey where s_acctbal > 2500"


@query(graph_sql(", d as (" + demo._plain(_EDGES_DECIDED) + ") select subj_label, subj, predicate, obj_label, obj, case when exists (select 1 from d where d.subj = e.subj and d.predicate = e.predicate and d.obj = e.obj) then true else verified end as verified from edges e"))
def mut8_verify_edges(spark, sf):
    return merge.verify_edges(demo.edges(spark, sf), demo.base(spark, sf, _EDGES_DECIDED)).select(*merge.EDGE_KEY, "verified")


@query(graph_sql(", gone as (select label, canonical_name from nodes where not coalesce(verified, true) and label = 'CUSTOMER' and canonical_name in (select canonical_name from (" + demo._plain(_DECIDED) + """)))
  select 'node' as kind, label as a, canonical_name as b from nodes n where not exists (select 1 from gone g where g.label = n.label and g.canonical_name = n.canonical_name)
  union all select 'edge', subj, obj from edges e where not exists (select 1 from gone g where (g.label = e.subj_label and g.canonical_name = e.subj) or (g.label = e.obj_label and g.canonical_name = e.obj))"""))
def mut9_reject_nodes(spark, sf):
    n, e = merge.reject_nodes(demo.nodes(spark, sf), demo.edges(spark, sf), demo.base(spark, sf, _DECIDED))
    return n.select(F.lit("node").alias("kind"), F.col("label").alias("a"), F.col("canonical_name").alias("b")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("subj").alias("a"), F.col("obj").alias("b")))


@query(graph_sql(", d as (" + demo._plain(_EDGES_DECIDED) + ") select subj_label, subj, predicate, obj_label, obj from edges e where not (not coalesce(verified, true) and exists (select 1 from d where d.subj = e.subj and d.predicate = e.predicate and d.obj = e.obj))"))
def mut9_reject_edges(spark, sf):
    return merge.reject_edges(demo.edges(spark, sf), demo.base(spark, sf, _EDGES_DECIDED)).select(*merge.EDGE_KEY)


@query(node_sql("select label, canonical_name, coalesce(verified, true) as verified from nodes"))
def mut10_backfill_verified(spark, sf):
    return merge.backfill_verified(demo.nodes(spark, sf)).select("label", "canonical_name", "verified")


@query(graph_sql("select replace(lower(predicate), '_', ' ') as predicate, lower(predicate) || ': ' || subj || ' → ' || obj as line from edges where predicate = 'LOCATED_IN'"))
def fn21_readable_triples(spark, sf):
    e = demo.edges(spark, sf).where("predicate = 'LOCATED_IN'")
    return e.select(T.human_predicate(F.col("predicate")).alias("predicate"), F.concat(F.lower("predicate"), F.lit(": "), F.concat_ws(" → ", "subj", "obj")).alias("line"))
