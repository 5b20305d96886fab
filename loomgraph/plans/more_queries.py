"""Registered queries on stores, logs of actions, streams and user functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import register
from loomgraph.operators import layouts, logs, merge, ontology, pipe_tables, resolve, structure
from loomgraph.plans import demo, doc_queries, record_queries
from loomgraph.plans.demo import graph_sql, node_sql
from loomgraph.plans.registry import query
from loomgraph.sources.folders import shared_folder
from loomgraph.streaming import ingest

_SE = "with " + ", ".join((doc_queries.PAGES, doc_queries.ENTRIES, doc_queries.SECTIONS))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(_SE + " select doc_id || ':' || node_id as section_id, pg.text from se join pg using (doc_id) where page_no = start_page")
def snk1_section_store(spark, sf):
    """Section texts, written as Parquet by id and read back."""
    pages = doc_queries._pages(spark, sf).select("doc_id", F.col("page_no").alias("start_page"), "text")
    s = doc_queries._sections(spark, sf).join(pages, ["doc_id", "start_page"])
    path = _folder(spark, "sections")
    s.select(F.concat_ws(":", F.col("doc_id").cast("string"), "node_id").alias("section_id"), "text").write.parquet(path)
    return spark.read.parquet(path)


@query("with " + doc_queries._MD + " select doc_id as source_doc, row_index, name as part_name from md")
def snk2_stored_rows(spark, sf):
    tables, rows = pipe_tables.store_tables(doc_queries._rows(spark, sf), doc_queries._titled(spark, sf), 1)
    return tables.join(rows, "table_id").select("source_doc", "row_index", F.element_at("props", F.lit("part_name")).alias("part_name"))


@query(_SE + " select doc_id, node_id from se")
def win2_node_ids(spark, sf):
    return doc_queries._sections(spark, sf).select("doc_id", "node_id")


@query(graph_sql("select subj as name, '→' as direction, count(*) as n from edges group by subj union all select obj, '←', count(*) from edges group by obj"))
def set1_both_directions(spark, sf):
    e = demo.edges(spark, sf)
    both = e.select(F.col("subj").alias("name"), F.lit("→").alias("direction")).unionByName(e.select(F.col("obj").alias("name"), F.lit("←").alias("direction")))
    return both.groupBy("name", "direction").agg(F.count("*").alias("n"))


@query(node_sql("select canonical_name from nodes where label = 'BRAND' order by canonical_name limit 20"))
def gq9_list_type(spark, sf):
    return demo.nodes(spark, sf).where(F.col("label") == F.upper(F.lit("brand"))).select("canonical_name").orderBy("canonical_name").limit(20)


# ---- action logs: each conversation's turns as the steps of one answer ----

_ACTIONS = """ac as (select conv_id, turn, case turn % 3 when 0 then 'GRAPH_QUERY' when 1 then 'SECTION_TEXT' else 'ANSWER' end as tool, 'q' || turn as args, case when turn % 4 = 3 then '(no results)' else text end as obs from conversations)"""


def _actions(spark, sf):
    """conv_id, actions: array<struct<turn, tool, args, observation>> in order."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    k = F.col("turn") % 3
    tool = F.when(k == 0, "GRAPH_QUERY").when(k == 1, "SECTION_TEXT").otherwise("ANSWER")
    step = F.struct("turn", tool.alias("tool"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("args"), F.when(F.col("turn") % 4 == 3, "(no results)").otherwise(F.col("text")).alias("observation"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("actions"))


@query(f"with {_ACTIONS} select conv_id, count(*) filter (tool <> 'ANSWER' and obs <> '(no results)') as evidence, count(*) filter (obs = '(no results)') as empty from ac group by conv_id")
def flt15_evidence(spark, sf):
    a = _actions(spark, sf)
    count = lambda f: F.size(F.filter("actions", f)).cast("long")
    return a.select("conv_id", count(logs.is_evidence).alias("evidence"), count(lambda s: s["observation"] == "(no results)").alias("empty"))


@query("select doc_id, substr(text, 101, 50) as slice from documents")
def flt16_text_slice(spark, sf):
    return doc_queries._docs(spark, sf).select("doc_id", F.substring("text", 101, 50).alias("slice"))


@query(f"""with {_ACTIONS}, n as (select conv_id, count(*) as q from ac where tool = 'GRAPH_QUERY' group by conv_id),
  l as (select conv_id, turn, unnest(range(1, len(x) + 1)) as i, unnest(x) as line from (select conv_id, turn, string_split(obs, chr(10))[1:8] as x from ac where tool = 'GRAPH_QUERY' and obs <> '(no results)' and obs <> '')),
  f as (select conv_id, trim(string_split(line, ' | ')[1], ' ' || chr(9) || chr(10) || chr(13)) as name, min({{'t': turn, 'i': i}}) as o from l group by all),
  g as (select conv_id, list(name order by o) as names from f where name <> '' group by conv_id)
  select conv_id, '    Queries: ' || q || ' graph queries executed' || coalesce(chr(10) || '    Entities found: ' || array_to_string(names[1:10], ', '), '') as summary from n left join g using (conv_id)""".replace("group by all)", "group by conv_id, trim(string_split(line, ' | ')[1], ' ' || chr(9) || chr(10) || chr(13)))"))
def fn14_action_summary(spark, sf):
    return _actions(spark, sf).select("conv_id", logs.action_summary(F.col("actions")).alias("summary")).where("summary != ''")


@query(f"with {record_queries.EPISODES} select id, 'Turn ' || turn || ':' || chr(10) || '  Q: ' || question || chr(10) || '  A: ' || answer as full, 'Turn ' || turn || ': ' || substr(question, 1, 100) as compact from ep")
def fn15_turn_rendering(spark, sf):
    e = record_queries._episodes(spark, sf)
    return e.select("id", F.format_string("Turn %d:\n  Q: %s\n  A: %s", "turn", "question", "answer").alias("full"), F.format_string("Turn %d: %s", F.col("turn"), F.substring("question", 1, 100)).alias("compact"))


@query(f"with {_ACTIONS}, e as (select *, row_number() over (partition by conv_id order by turn) as r from ac where tool <> 'ANSWER' and obs <> '(no results)' and obs <> '') select conv_id, string_agg('[' || tool || '(' || substr(args, 1, 300) || ')] ' || substr(obs, 1, 500), chr(10) order by turn) as digest from e where r <= 10 group by conv_id")
def fn23_evidence_digest(spark, sf):
    return _actions(spark, sf).select("conv_id", logs.evidence_digest(F.col("actions")).alias("digest")).where("digest != ''")


@query("select p_partkey as id, n as at, case n when 0 then p_name else p_brand end as text from part, (values (0), (1)) v(n) where n = 0 or p_partkey % 3 = 0")
def fn26_unwrapped_records(spark, sf):
    """A list of two, an object with a list, or one record."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    rec = lambda c: F.struct(F.col(c).alias("text"))
    k = F.col("p_partkey") % 3
    body = F.when(k == 0, F.to_json(F.array(rec("p_name"), rec("p_brand")))).when(k == 1, F.to_json(F.struct(F.array(rec("p_name")).alias("entities")))).otherwise(F.to_json(rec("p_name")))
    out = ontology.unwrap_records(p.select(F.col("p_partkey").alias("id"), body.alias("json")), ["entities", "items"])
    return out.select("id", "at", F.element_at("record", F.lit("text")).alias("text"))


_TYPED = """
select p_partkey as id, n as at, p_name as text, p_retailprice as price, (p_size + n) > 20 as verified, p_size + n as size, case p_partkey % 2 when 0 then p_brand end as brand,
    case p_partkey % 2 when 0 then 'OBJECT<brand: STRING, size: BIGINT>' else 'OBJECT<size: BIGINT>' end as kind
from part, (values (0), (1)) v(n) where n = 0 or p_partkey % 3 = 0"""


@query(_TYPED)
def fn26_typed_records(spark, sf):
    """Numbers, booleans and nested objects of a list of two, of a list under the second key, or of one record; a brand may be absent."""
    p = spark.read.parquet(f"{sf}/part.parquet")

    def record(n):
        size = F.col("p_size") + n
        nested = F.struct(size.alias("size"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand"))
        return F.struct(F.col("p_name").alias("text"), F.col("p_retailprice").alias("price"), (size > 20).alias("verified"), nested.alias("properties"))

    k = F.col("p_partkey") % 3
    second = F.to_json(F.struct(F.lit("none").alias("entities"), F.array(record(0)).alias("items")))
    body = F.when(k == 0, F.to_json(F.array(record(0), record(1)))).when(k == 1, second).otherwise(F.to_json(record(0)))
    types = {"text": "string", "price": "double", "verified": "boolean", "properties": "variant"}
    fields = {name: (f"$.{name}", kind) for name, kind in types.items()} | {"size": ("$.properties.size", "int"), "brand": ("$.properties.brand", "string")}
    out = ontology.typed_records(p.select(F.col("p_partkey").alias("id"), body.alias("json")), ["entities", "items"], fields)
    return out.withColumn("kind", F.schema_of_variant("properties")).drop("record", "properties")


@query(graph_sql("select (select count(*) from documents) as documents, (select count(*) from nodes) as entities, (select count(*) from edges) as relationships, (select count(*) from edge_mentions m where not exists (select 1 from nodes n where n.label = m.obj_label and n.canonical_name = lower(m.obj))) as rejected"))
def agg15_ingest_summary(spark, sf):
    n = demo.nodes(spark, sf)
    lost = merge.dangling_ends(merge.keyed_edges(demo.edge_mentions(spark, sf)), n).where("missing = 'obj'")
    one = lambda df, c: df.agg(F.count("*").alias(c))
    return one(doc_queries._docs(spark, sf), "documents").join(one(n, "entities")).join(one(demo.edges(spark, sf), "relationships")).join(one(lost, "rejected"))


@query(node_sql(", ep as (select lower(s_name) as canonical_name, s_suppkey from supplier) select n.canonical_name, case when length(n.name) > 12 then n.name else n.source_docs end as detail, e.event_id from nodes n join ep using (canonical_name) left join (select user_id, arg_max(event_id, {'t': ts, 'e': event_id}) as event_id from events where event_type = 'purchase' group by user_id) e on e.user_id = ep.s_suppkey where n.label = 'SUPPLIER' and e.event_id is not null"))
def gq15_review_context(spark, sf):
    """A supplier's own text, if long enough, else its sources, with the newest purchase of its number."""
    n = demo.sourced_nodes(spark, sf).where("label = 'SUPPLIER'")
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.lower("s_name").alias("canonical_name"), F.col("s_suppkey").alias("user_id"))
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return n.join(s, "canonical_name").join(e, "user_id").select("canonical_name", F.when(F.length("name") > 12, F.col("name")).otherwise(F.col("source_docs")).alias("detail"), "event_id")


_REVIEW = f"""with {record_queries.EPISODES}, ge as (select id, question, answer, timestamp '2024-01-01' + to_hours((id * 7 % 719)::int) as made from ep where entities_added > 0 or rels_added > 0),
  n as (select lower(s_name) as canonical_name, case when s_suppkey % 3 = 0 then 'text of ' || s_name end as source_text, s_suppkey from supplier),
  ch as (select user_id, arg_max({{'l': event_type || ' ' || event_id, 'd': case when event_id % 2 = 0 then 'about ' || user_id || ' in the year ' || props else props end, 'ts': ts}}, {{'ts': ts, 'id': event_id}}) as c from events where event_type = 'view' group by user_id),
  x as (select canonical_name, coalesce(source_text, case when length(c.d) > 20 then c.d end) as source_text, c.l as label, c.ts as ts from n left join ch on user_id = s_suppkey),
  y as (select canonical_name, source_text, label, max({{'made': made, 'id': id::varchar, 'q': question, 'a': answer}}) filter (id is not null) as e from x left join ge on ge.made <= x.ts group by canonical_name, source_text, label)
  select canonical_name, source_text, label, e.q as question, e.a as answer from y"""


@query(_REVIEW)
def gq15_item_context(spark, sf):
    """Suppliers as items for review: their text, the newest view of their number as the chat that named them, and its episode."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    m = s.select(F.lit("SUPPLIER").alias("label"), F.lower("s_name").alias("canonical_name"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("text"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("text of "), "s_name")).alias("source_text"), F.lit(0.5).alias("confidence"), F.lit(False).alias("verified"), F.lit("s").alias("source_doc"), F.lit("2024-01-01").cast("date").alias("seen"))
    n = merge.merge_node_fields(None, m)
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'view'").join(s.select(F.col("s_suppkey").alias("user_id"), F.lower("s_name").alias("item_name")), "user_id")
    detail = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("about "), F.col("user_id").cast("string"), F.lit(" in the year "), "props")).otherwise(F.col("props"))
    chats = e.select("item_name", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("action_label"), detail.alias("item_detail"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("id"))
    at = F.timestamp_add("HOUR", (F.col("id") * 7 % 719).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    ep = record_queries._episodes(spark, sf).select("id", "question", "answer", "entities_added", "rels_added", at.alias("created_at"))
    return logs.review_context(n, chats, ep).select("canonical_name", "source_text", "label", "question", "answer")


_TREES = "with " + ", ".join((doc_queries.PAGES, doc_queries.ENTRIES, doc_queries.SECTIONS, doc_queries.TREE)) + """,
  lv as (select t.*, case when parent_id is null then 0 when parent_id in (select node_id from tr x where x.doc_id = t.doc_id and x.parent_id is null) then 1 else 2 end as lvl from tr t),
  b as (select 0 as age, lv.*, d.lang, title as t from lv join documents d using (doc_id) where d.lang <> 'de' union all select 1, lv.*, d.lang, 'new ' || title from lv join documents d using (doc_id) where d.lang in ('de', 'fr') and depth < 2),
  own as (select *, '{"node_id":' || to_json(node_id) || ',"title":' || to_json(t) || ',"start_page":' || start_page || ',"end_page":' || end_page || ',"summary":"","children":[' as js from b),
  l2 as (select age, doc_id, parent_id, string_agg(js || ']}', ',' order by node_id) as js from own where lvl = 2 group by age, doc_id, parent_id),
  l1 as (select o.age, o.doc_id, o.parent_id, string_agg(o.js || coalesce(c.js, '') || ']}', ',' order by o.node_id) as js from own o left join l2 c on c.age = o.age and c.doc_id = o.doc_id and c.parent_id = o.node_id where lvl = 1 group by o.age, o.doc_id, o.parent_id),
  l0 as (select o.age, o.doc_id, '[' || string_agg(o.js || coalesce(c.js, '') || ']}', ',' order by o.node_id) || ']' as js from own o left join l1 c on c.age = o.age and c.doc_id = o.doc_id and c.parent_id = o.node_id where lvl = 0 group by o.age, o.doc_id)
"""


@query(_TREES + """, d as (select 0 as age, doc_id, source as title from documents where lang <> 'de' union all select 1, doc_id, 'new ' || lang from documents where lang in ('de', 'fr'))
  select 'Document' as label, doc_id::varchar as id, arg_min(d.title, age) as title, arg_max(coalesce(js, '[]'), age) as detail from d left join l0 using (age, doc_id) group by doc_id
  union all select 'Section', doc_id || ':' || node_id, arg_min(t, age), 'BELONGS_TO ' || doc_id from b group by doc_id, node_id""")
def mut3_document_upsert(spark, sf):
    """Documents and sections of two batches: a known document takes the second one's tree alone, a known section stays."""
    d, s = doc_queries._docs(spark, sf), doc_queries._sections(spark, sf).withColumn("summary", F.lit(None).cast("string"))
    doc = lambda df, title: df.select("doc_id", title.alias("title"), F.col("source").alias("filename"), F.lit(1).alias("page_count"), F.lit(None).cast("date").alias("ingested_at"))

    def batch(langs, title, sections):
        docs = d.where(langs)
        own = sections.join(docs.select("doc_id"), "doc_id", "left_semi")
        return structure.document_nodes(doc(docs, title), structure.tree_json(own, structure.nested_sets(own))), structure.section_nodes(own)

    one = structure.store_documents(None, *batch(F.col("lang") != "de", F.col("source"), s))
    again = s.where("depth < 2").withColumn("title", F.concat(F.lit("new "), "title"))
    docs, sections, edges = structure.store_documents(one[:2], *batch(F.col("lang").isin("de", "fr"), F.concat(F.lit("new "), "lang"), again))
    held = sections.join(edges.select(F.col("subj").alias("id"), F.concat_ws(" ", "predicate", "obj").alias("detail")), "id")
    return docs.select(F.lit("Document").alias("label"), "id", "title", F.col("tree_json").alias("detail")).unionByName(held.select(F.lit("Section").alias("label"), "id", "title", "detail"))


@query(node_sql("select distinct label, lower(text) as canonical_name, arg_max(source_doc, {'c': confidence, 'o': -ord}) as section_id from mentions group by label, lower(text)"))
def mut4_section_links(spark, sf):
    """Each entity is linked to the section of its best mention only."""
    m = merge.keyed_mentions(demo.mentions(spark, sf))
    return m.groupBy("label", "canonical_name").agg(F.max_by("source_doc", F.struct(F.col("confidence"), (-F.col("ord")).alias("o"))).alias("section_id"))


@query(node_sql("select * from nodes"))
def mut11_reset_and_load(spark, sf):
    """A reset graph is an empty snapshot, into which all mentions are merged."""
    empty = demo.sourced_nodes(spark, sf).limit(0)
    return merge.merge_nodes(empty, merge.keyed_mentions(demo.mentions(spark, sf)))


@query("select conv_id as session_id, case when bool_or(role = 'system') then 'renamed ' || conv_id else 'session ' || conv_id end as name, count(*) as turns from conversations group by conv_id having count(*) <= 6")
def mut15_sessions(spark, sf):
    """Sessions created, those with a system turn renamed, those of more than six turns deleted with their turns."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").withColumnRenamed("conv_id", "session_id")
    name = lambda p: F.concat(F.lit(p), F.col("session_id").cast("string")).alias("name")
    s = c.select("session_id").distinct()
    sessions = merge.upsert_by_key(s.select("session_id", name("session ")), c.where("role = 'system'").select("session_id").distinct().select("session_id", name("renamed "), F.lit(1).alias("ord")), ["session_id"], "ord")
    gone = c.groupBy("session_id").count().where("count > 6")
    turns = merge.delete_by_key(c, gone, ["session_id"]).groupBy("session_id").agg(F.count("*").alias("turns"))
    return merge.delete_by_key(sessions, gone, ["session_id"]).join(turns, "session_id")


@query(f"with {record_queries.EPISODES} select id, coalesce(confidence, 0) as confidence, '[\"' || session_id || '\"]' as section_ids from ep")
def mut16_episode_append(spark, sf):
    """Episodes appended with defaults and JSON fields, and read back."""
    e = record_queries._episodes(spark, sf)
    path = _folder(spark, "episodes")
    row = e.select("id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.to_json(F.array(F.col("session_id").cast("string"))).alias("section_ids"))
    row.where("id % 2 = 0").write.mode("append").parquet(path)
    row.where("id % 2 != 0").write.mode("append").parquet(path)
    return spark.read.parquet(path)


# ---- streams ----


def _arriving(spark, table, files=None):
    """The table's rows as files that arrive in a folder, read as a stream."""
    path = _folder(spark, "arriving")
    table.write.parquet(path)
    stream = spark.readStream.schema(table.schema)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(path)


@query("select 'PART' as label, lower(p_name) as canonical_name, count(*) as n, max(confidence) as confidence, max(seen) as last_confirmed_at from (select p_name, (p_partkey % 41)::double / 40 as confidence, date '2024-01-01' + (p_partkey % 365)::int as seen from part) group by lower(p_name)")
def str1_incremental_ingest(spark, sf):
    """The part table as a stream of mentions, merged batch by batch into snapshots."""
    stream = _arriving(spark, spark.read.parquet(f"{sf}/part.parquet"), 1)
    m = stream.select(F.lit("PART").alias("label"), F.lower("p_name").alias("canonical_name"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), ((F.col("p_partkey") % 41).cast("double") / 40).alias("confidence"), F.lit(True).alias("verified"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("source_doc"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("seen"))
    out = ingest.ingest_mentions(m, _folder(spark, "stream"), merge.merge_node_fields)
    return out.select("label", "canonical_name", F.col("n_mentions").alias("n"), "confidence", "last_confirmed_at")


@query("select distinct sha256(text) as content from documents")
def str2_seen_contents(spark, sf):
    """The documents as a stream of files; contents that an earlier batch had are skipped."""
    stream = _arriving(spark, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content")), 1)
    return ingest.ingest_mentions(stream, _folder(spark, "contents"), ingest.first_contents, ["content"]).select("content")


@query("select distinct sha256(text) as content from documents")
def str2_new_contents(spark, sf):
    """The same by state that forgets: here the watermark is wide enough for all documents."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts"))
    return ingest.append(ingest.new_contents(_arriving(spark, d), "ts", "1000 days"), _folder(spark, "new-contents")).select("content")


@query("select time_bucket(interval '1 hour', ts) as started, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def str3_live_activity(spark, sf):
    """Windows are put out once, when the watermark has passed them; a last row, a day later, closes those that are open."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path, folder = _folder(spark, "arriving"), _folder(spark, "activity")
    e.write.parquet(path)
    counts = ingest.activity_counts(spark.readStream.schema(e.schema).parquet(path), "ts")
    ingest.append(counts, folder)
    e.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(*(F.col(c) if c == "ts" else F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns)).write.mode("append").parquet(path)
    return ingest.append(counts, folder)


@query("""with a as (select max(ts) - interval 2 hour as held from events where event_type = 'view')
  select event_id, 'late by' as reason from events, a where event_type <> 'view' and time_bucket(interval '1 hour', ts) + interval 1 hour <= held""")
def str3_late_rows(spark, sf):
    """All views come first; of what comes after them, rows of windows that have ended are rejected."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path, folder = _folder(spark, "arriving"), _folder(spark, "late")
    stream = lambda: spark.readStream.schema(e.schema).parquet(path)
    e.where("event_type = 'view'").write.parquet(path)
    ingest.rejects(stream(), folder, "ts")
    e.where("event_type != 'view'").write.mode("append").parquet(path)
    return ingest.rejects(stream(), folder, "ts").select("event_id", F.substring("reason", 1, 7).alias("reason"))


# ---- user functions and planned operators ----


@query("select p_partkey as id, lower(p_name) || ' e' as canonical, round(2.0 * length(p_name) / (2 * length(p_name) + 1), 9)::double as ratio from part")
def udf1_sql_functions(spark, sf):
    register.register(spark)
    parts = spark.read.parquet(f"{sf}/part.parquet")
    return spark.sql("select p_partkey as id, canonical_name('  ' || upper(p_name) || '™  é') as canonical, round(similarity_ratio(p_name, p_name || '!'), 9) as ratio from {parts}", parts=parts)


@query("""with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}#]+'), lambda w: w <> '') as w from documents),
  runs as (select doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') as run from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (values (1), (2), (3)) v(n) where len(w) >= n)),
  names as (select lower(p_name) as name from part union select lower(s_name) from supplier union select lower(source) from documents union select array_to_string(list_slice(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}#]+'), lambda w: w <> ''), 1, 3), ' ') from benchmark)
  select doc_id, name as text, count(*) as n from runs join names on name = run group by doc_id, name""")
def udf2_gazetteer(spark, sf):
    docs = doc_queries._docs(spark, sf)
    read = lambda t, c: spark.read.parquet(f"{sf}/{t}.parquet").select(c.alias("name"))
    opening = F.array_join(F.slice(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}#]+"), lambda w: w != ""), 1, 3), " ")
    names = read("part", F.col("p_name")).union(read("supplier", F.col("s_name"))).union(docs.select(F.col("source").alias("name"))).union(read("benchmark", opening))
    names = names.where("name is not null").select(F.lower("name").alias("name")).distinct().withColumn("label", F.lit("NAME"))
    m = register.gazetteer_mentions(docs.select(F.col("doc_id").cast("string").alias("section_id"), "text"), names, 3)
    return m.groupBy(F.col("section_id").cast("long").alias("doc_id"), "text").agg(F.count("*").alias("n"))


@query()
def pln5_type_thresholds(spark, sf):
    """Parts need a ratio of 0.95, suppliers of 0.85."""
    return resolve.typed_pairs(record_queries._groups(spark, sf), {"PART": 0.95, "SUPPLIER": 0.85})


_FORMS = "select p_partkey as ord, 'PART' as label, concat(p_name, case p_partkey % 3 when 0 then '' when 1 then concat(' (', p_brand, ')') else concat(' - [', p_type, ']') end) as text, 0.5D as confidence, 'd' as source_doc from {part}"


@query("with m as (select ord, lower(text) as n, regexp_replace(lower(text), '( - )?[ ]?[(\\[].*$', '') as a from (" + demo._plain(_FORMS).replace("0.5D", "0.5") + ")), g as (select n, a, min(ord) as ord from m group by n, a), f as (select a, arg_min(n, ord) as first from g group by a) select 'PART' as label, first as a, n as b, 'alias' as why from g join f using (a) where n <> first")
def pln5_aliases(spark, sf):
    """Part names alone, with their brand, and with their type in brackets: forms of one name."""
    return resolve.alias_pairs(resolve.exact_groups(demo.base(spark, sf, _FORMS)))


@query("""with p as (select page_id, regexp_replace(regexp_replace(html, '[^<>/a-z0-9 =]', '', 'g'), '>[^<]*<', '><', 'g') as h from pages), t as (select page_id, list_sort(list_distinct(regexp_extract_all(html, '<(/?[a-z0-9]+)', 1))) as tags from pages),
  s as (select array_to_string(tags, ' ') as layout, count(*) as n, min(page_id) as first_page from t group by 1) select layout, n, first_page from s where n > 1""")
def pln6_page_layouts(spark, sf):
    """Layouts that repeat: pages with the same set of tags are one layout, found by grouping, not by pairs."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r"<(/?[a-z0-9]+)"), F.lit(1))))
    return p.groupBy(F.array_join(tags, " ").alias("layout")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query("""with t as (select page_id, regexp_extract_all(html, '<(/?[a-z0-9]+)', 1) as g from pages), r as (select page_id, list_sort(list_distinct(list_transform(range(1, greatest(len(g) - 2, 1) + 1), lambda i: array_to_string(g[i:i + 2], ' ')))) as runs from t where len(g) > 0),
  l as (select runs, min(page_id) as first_page from r group by runs), j as (select a.first_page as a, b.first_page as b, len(list_intersect(a.runs, b.runs)) as n, len(a.runs) + len(b.runs) as m from l a join l b on a.first_page < b.first_page)
  select a, b, round(n / (m - n), 6) as jaccard from j where n / (m - n) >= 0.8""")
def pln6_similar_layouts(spark, sf):
    """Pairs of page layouts, equal ones taken as one, that share at least 0.8 of their runs of three tags."""
    found = layouts.alike(layouts.layouts(spark.read.parquet(f"{sf}/pages.parquet")))
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"))
