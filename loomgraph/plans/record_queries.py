"""Registered queries on names, rules, resolution, ontology, sessions and activity."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import register
from loomgraph.functions import text as T
from loomgraph.operators import audit, logs, merge, ontology, resolve, search, structure, vectors
from loomgraph.plans import demo
from loomgraph.plans.demo import _plain, node_sql
from loomgraph.plans.registry import query
from loomgraph.sources.folders import shared_folder

# ---- names ----

#: Noisy names: case, marks, accents, white space and codes, by the part's key.
NAMES = """select p_partkey as id, case p_partkey % 6 when 0 then concat(upper(p_name), '®  ', cast(p_partkey as string)) when 1 then concat('  ', p_name, ' ', cast(p_partkey as string), ' ™')
  when 2 then concat('Élan ', p_name, ' *', cast(p_partkey as string), '*') when 3 then concat('Part — ', p_name, ' (AB)') when 4 then concat('[', p_name, '] "of" the ', p_type) else concat('FZ — ', p_name, ' ', cast(p_size as string)) end as raw from {part}"""
_N = f"n as ({_plain(NAMES)})"


def _names(spark, sf):
    return demo.base(spark, sf, NAMES)


@query(f"with {_N} select id, trim(regexp_replace(lower(strip_accents(regexp_replace(raw, '[®™©]', '', 'g'))), '\\s+', ' ', 'g')) as name from n")
def fn1_canonical_name(spark, sf):
    return _names(spark, sf).select("id", T.canonical_name(F.col("raw")).alias("name"))


_TERM = """trim(regexp_replace(lower(translate(raw, '®™©°*[](){}"''`', '')), '\\s+', ' ', 'g'))"""


@query(f"with {_N} select id, {_TERM} as term from n")
def fn2_search_term(spark, sf):
    return _names(spark, sf).select("id", T.search_term(F.col("raw")).alias("term"))


@query(f"""with {_N}, w as (select id, list_filter(string_split({_TERM}, ' '), lambda x: length(x) > 1 and x not in ('the','a','an','of','for','and','or','in','on','to','is','at','by','with')) as w from n),
  c as (select id, list_concat([array_to_string(w, ' ')], case when len(w) > 1 then [array_to_string(w[2:], ' ')] else []::varchar[] end, list_transform(list_sort(list_transform(w, lambda x, j: {{'n': -length(x), 'j': j, 'x': x}})), lambda z: z.x)) as c from w)
  select id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i and x <> ''), '|') as keywords from c""")
def fn3_keywords(spark, sf):
    from loomgraph.operators.search import NOISE

    return _names(spark, sf).select("id", F.array_join(T.keywords(T.search_term(F.col("raw")), NOISE), "|").alias("keywords"))


@query(f"with {_N} select id, case when k = '' then 'col' else k end as k from (select id, regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as k from n)")
def fn4_column_key(spark, sf):
    return _names(spark, sf).select("id", T.column_key(F.col("raw")).alias("k"))


@query(f"with {_N} select id, case when id % 6 in (3, 5) then case when id % 6 = 3 then 'Part' else 'FZ' end else trim(regexp_extract(raw, '^[^—–-]*')) end as prefix from n")
def fn5_product_prefix(spark, sf):
    return _names(spark, sf).select("id", T.product_prefix(F.concat(F.lit("text\n## — none\n# "), T.strip(F.col("raw")), F.lit("\nend"))).alias("prefix"))


@query(f"with {_N} select id, case id % 6 when 3 then 'part' when 5 then 'fz' end as code from n")
def fn6_abbreviation(spark, sf):
    return _names(spark, sf).select("id", T.abbreviation(F.col("raw")).alias("code"))


@query("select p_partkey as id, trim(regexp_replace(upper(p_type || ' of-' || p_name), '[^A-Z0-9_]', '_', 'g'), '_') as predicate from part")
def fn7_predicate_name(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), T.predicate_name(F.concat("p_type", F.lit(" of-"), "p_name")).alias("predicate"))


@query("select p_partkey as id, 'Part ' || p_name || ' {other} by ' || p_brand as text from part")
def fn9_fill_template(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), T.fill_template(F.lit("Part {name} {other} by {brand}"), {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("text"))


@query("select c_custkey as id, ' a' || chr(10) || '_\\\"' || c_name || chr(9) || 'b ' as cleaned, case c_custkey % 5 when 0 then c_name when 1 then c_name || ' it is' when 2 then 'it must be ' || c_name || ', I think' when 3 then 'plain ' || c_name else 'I was unable to determine an answer from the available information.' end as inline from customer")
def fn17_clean_answer(spark, sf):
    """Escapes undone, and answers found in texts without an action."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, F.concat(F.lit("Thought: none\nFinal Answer: "), "c_name")).when(k == 1, F.concat(F.lit("we saw it.\nTherefore, "), "c_name", F.lit(" it is "))).when(k == 2, F.concat(F.lit("Thought: short\nAction: X\nThought: it must be "), "c_name", F.lit(", I think\nAction: Y"))).when(k == 3, F.concat(F.lit(" plain "), "c_name")).otherwise(" ")
    return c.select(F.col("c_custkey").alias("id"), T.clean_answer(F.concat(F.lit(' a\\n\\_\\"'), "c_name", F.lit("\\tb "))).alias("cleaned"), T.inline_answer(said).alias("inline"))


@query("select p_partkey as id, case p_partkey % 4 when 0 then 2 when 1 then 1 when 2 then 0 else 1 end as score from part")
def fn20_answer_score(spark, sf):
    """Expected: brand and size; answers hold both, one, none; nothing expected scores 1."""
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("k", F.col("p_partkey") % 4)
    expected = F.when(F.col("k") == 3, "").otherwise(F.concat(F.lit("alpha words, 700"), F.col("p_partkey").cast("string"), F.lit("700")))
    answer = F.when(F.col("k") == 0, F.concat(F.lit("Alpha WORDS 700"), F.col("p_partkey").cast("string"), F.lit("700"))).when(F.col("k") == 1, "alpha words").otherwise("nothing")
    return p.select(F.col("p_partkey").alias("id"), T.answer_score(answer, expected).alias("score"))


@query("select n_regionkey as id, string_agg(n_nationkey || ' | ' || n_name, chr(10) order by n_nationkey) || chr(10) || '(' || count(*) || ' rows)' as shown from nation group by n_regionkey")
def fn22_result_table(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat_ws(" | ", F.col("n_nationkey").cast("string"), "n_name").alias("l"))))
    return n.groupBy(F.col("n_regionkey").alias("id")).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["l"]), "\n"), F.lit("\n("), F.count("*").cast("string"), F.lit(" rows)")).alias("shown"))


@query("select p_partkey as id, case p_partkey % 3 when 0 then 'int' when 1 then 'float' else 'text' end as kind, case p_partkey % 3 when 0 then p_size::double when 1 then p_size + 0.5 end::double as number from part")
def fn24_typed_cells(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.col("p_name"))
    t = T.typed_cell(cell)
    return p.select(F.col("p_partkey").alias("id"), t["kind"].alias("kind"), t["number"].alias("number"))


# ---- resolution ----

#: Mentions with spelling noise: copies of part names with case, a doubled letter, and words around.
NOISY = """select ord, label, text, cast(ord % 41 as double) / 40 as confidence, concat('doc', cast(ord % 5 as string)) as source_doc from (
  select p_partkey as ord, 'PART' as label, case p_partkey % 4 when 0 then upper(p_name) when 1 then concat(p_name, '®') when 2 then concat(p_name, 's') else concat(p_name, ' system') end as text from {part}
  union all select s_suppkey + 100000000, 'SUPPLIER', s_name from {supplier}) m"""
_MEN = f"men as ({_plain(NOISY)})"
_CAN = "trim(regexp_replace(lower(regexp_replace(text, '[®™©]', '', 'g')), '\\s+', ' ', 'g'))"
_GROUPS = f"gr as (select label, {_CAN} as canonical_name, min(ord) as ord, count(*) as n, arg_max(text, {{'c': confidence, 'o': -ord}}) as text, max(confidence) as confidence, array_to_string(list_sort(list_distinct(list(source_doc))), ', ') as docs from men group by label, {_CAN})"


def _groups(spark, sf):
    return resolve.exact_groups(demo.base(spark, sf, NOISY))


@query(f"with {_MEN}, {_GROUPS} select * from gr")
def er1_exact_groups(spark, sf):
    return _groups(spark, sf).select("label", "canonical_name", "ord", "n", "best.text", "best.confidence", F.array_join("docs", ", ").alias("docs"))


@query(f"with {_MEN}, {_GROUPS} select a.label, a.canonical_name as a, b.canonical_name as b from gr a join gr b on a.label = b.label and a.canonical_name <> b.canonical_name and length(a.canonical_name) >= 4 and contains(b.canonical_name, a.canonical_name) and length(a.canonical_name)::double / length(b.canonical_name) >= 0.35")
def er4_containment_pairs(spark, sf):
    return resolve.containment_pairs(_groups(spark, sf).select("label", F.col("canonical_name").alias("name")))


@query()
def er2_same_pairs(spark, sf):
    return resolve.same_pairs(_groups(spark, sf))


def _clusters(spark, sf):
    g = _groups(spark, sf)
    return g, resolve.leaders(g, resolve.same_pairs(g))


@query()
def er5_leader_clusters(spark, sf):
    return _clusters(spark, sf)[1]


@query()
def er6_resolved_entities(spark, sf):
    return resolve.resolved(*_clusters(spark, sf))


@query()
def er7_resolution_report(spark, sf):
    g, c = _clusters(spark, sf)
    return g.groupBy("label").agg(F.sum("n").alias("mentions"), F.count("*").alias("names")).join(c.where("canonical_name = leader").groupBy("label").agg(F.count("*").alias("entities")), "label")


@query(f"with n as (select p_partkey as id, p_name as name, regexp_extract_all(p_name || ' ' || p_size || ' ' || p_partkey, '\\d+') as d from part) select id, array_to_string(list_sort(list_distinct(d)), ',') as digits from n")
def er3_digit_sets(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(T.digit_runs(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))), ",").alias("digits"))


@query(f"with {_MEN}, {_GROUPS} select label, canonical_name, docs from gr where n > 1")
def set3_merged_sources(spark, sf):
    return _groups(spark, sf).where("n > 1").select("label", "canonical_name", F.array_join("docs", ", ").alias("docs"))


@query(f"with {_MEN}, {_GROUPS} select label, canonical_name, text, confidence from gr")
def win5_best_record(spark, sf):
    return _groups(spark, sf).select("label", "canonical_name", "best.text", "best.confidence")


@query(f"with {_MEN}, q as (select p_partkey as qid, 'PART' as label, case when p_partkey % 2 = 0 then upper(p_name) else '  ' || p_name || '™' end as raw from part), l as (select label, lower(text) as k, arg_max(text, ord) as found from men group by all), c as (select label, {_CAN} as k, arg_max(text, ord) as found from men group by all)".replace("lower(text) as k, arg_max(text, ord) as found from men group by all", "lower(text) as k, arg_max(text, ord) as found from men group by label, lower(text)").replace(f"{_CAN} as k, arg_max(text, ord) as found from men group by all", f"{_CAN} as k, arg_max(text, ord) as found from men group by label, {_CAN}") + " select qid, q.label, raw, coalesce(l.found, c.found) as found from q left join l on l.label = q.label and l.k = lower(raw) left join c on c.label = q.label and c.k = trim(regexp_replace(lower(regexp_replace(raw, '[®™©]', '', 'g')), '\\s+', ' ', 'g'))")
def join2_mention_lookup(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("  "), "p_name", F.lit("™")))
    return resolve.lookup(demo.base(spark, sf, NOISY), p.select(F.col("p_partkey").alias("qid"), F.lit("PART").alias("label"), raw.alias("raw")))


@query(f"with {_MEN} select distinct label, {_CAN} as canonical_name from men where {_CAN} not in (select lower(p_name) from part)")
def join14_new_names(spark, sf):
    known = spark.read.parquet(f"{sf}/part.parquet").select(F.lit("PART").alias("label"), F.lower("p_name").alias("canonical_name"))
    return resolve.new_names(demo.base(spark, sf, NOISY), known).select("label", "canonical_name").distinct()


@query()
def join14_new_names_fuzzy(spark, sf):
    """Names that are like no known one, and of those that are like each other the first."""
    known = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 3 = 0").select(F.lit("PART").alias("label"), F.lower("p_name").alias("canonical_name"))
    return resolve.new_names(demo.base(spark, sf, NOISY), known, 0.9).select("label", "canonical_name").distinct()


_RULES = """s as (select lower(p_name) as s, min(p_partkey) as so from part group by 1), o as (select lower({0}) as o, p_partkey as oo from part)"""


def _rule_tables(spark, sf, obj):
    p = spark.read.parquet(f"{sf}/part.parquet")
    subj = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return subj, p.select(obj.alias("name"), F.col("p_partkey").alias("ord"))


@query("with " + _RULES.replace("{0}", "p_name || ' mark ' || p_partkey") + " select s as subj, 'EXTENDS' as predicate, o as obj, 0.9::double as confidence from (select *, row_number() over (partition by o, oo order by length(s) desc, so) as r from s join o on starts_with(o, s)) where r = 1")
def join3_prefix_rule(spark, sf):
    subj, obj = _rule_tables(spark, sf, F.concat("p_name", F.lit(" mark "), F.col("p_partkey").cast("string")))
    return resolve.prefix_rule(subj, obj, "extends")


@query("with " + _RULES.replace("{0}", "'New ' || p_name || ' mark ' || p_partkey") + " select s as subj, 'PART_OF' as predicate, o as obj, 0.9::double as confidence from (select *, row_number() over (partition by o, oo order by length(s) desc, so) as r from s join o on contains(o, s)) where r = 1")
def join4_contains_rule(spark, sf):
    subj, obj = _rule_tables(spark, sf, F.concat(F.lit("New "), "p_name", F.lit(" mark "), F.col("p_partkey").cast("string")))
    return resolve.contains_rule(subj, obj, "part_of")


@query("select lower(s_name) as subj, 'BASED_IN' as predicate, lower(n_name) as obj, 0.9::double as confidence from supplier join nation on s_nationkey = n_nationkey")
def join5_explicit_pairs(spark, sf):
    pairs = demo.base(spark, sf, "select upper(s_name) as s, n_name as o, s_suppkey as qid from {supplier} join {nation} on s_nationkey = n_nationkey")
    m = demo.mentions(spark, sf)
    ends = resolve.lookup(m, pairs.select(F.struct("qid", F.lit("s").alias("side")).alias("qid"), F.lit("SUPPLIER").alias("label"), F.col("s").alias("raw")).unionByName(pairs.select(F.struct("qid", F.lit("o").alias("side")).alias("qid"), F.lit("NATION").alias("label"), F.col("o").alias("raw"))))
    both = ends.where("found is not null").groupBy("qid.qid").agg(F.max(F.when(F.col("qid.side") == "s", F.lower("found"))).alias("subj"), F.max(F.when(F.col("qid.side") == "o", F.lower("found"))).alias("obj"))
    return both.where("subj is not null and obj is not null").select("subj", F.lit("BASED_IN").alias("predicate"), "obj", F.lit(0.9).alias("confidence"))


# ---- provenance ----


@query(demo.layer_sql("""select e.label, e.canonical_name, e.section_id, s.title as section_title, d.title as doc_title, d.filename as doc_filename
  from extracted e join secs s on s.id = e.section_id join docs d on d.id = s.document_id"""))
def join11_provenance(spark, sf):
    """From every entity to the sections it was found in, and from these to their documents."""
    documents, sections, belongs, extracted = demo.structural(spark, sf)
    return structure.provenance(structure.layered_edges(demo.edges(spark, sf), belongs, extracted), documents, sections)


@query("select count(distinct source_doc) as covered, count(*) as mentions from (" + _plain(demo.MENTIONS) + ")")
def join15_covered_sources(spark, sf):
    m = demo.mentions(spark, sf)
    docs = m.select("source_doc").distinct()
    return docs.join(m.select("source_doc"), "source_doc", "left_semi").agg(F.count("*").alias("covered")).join(m.agg(F.count("*").alias("mentions")))


@query("""with d as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}#]+'), lambda w: w <> '')) as w from documents), n as (select distinct lower(role) as name from conversations union select distinct lower(p_type) from part union select distinct lower(source) from documents),
  c as (select distinct doc_id from (select doc_id, unnest(w) as x from d) join n on name = x) select count(*) as sections, (select count(*) from c) as covered, round((select count(*) from c) * 100.0 / count(*), 1)::double as percent from documents""")
def join15_section_coverage(spark, sf):
    """Documents as sections, linked to the names (roles, types of parts, sources) that they mention."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("section_id"), "text")
    read = lambda t, c: spark.read.parquet(f"{sf}/{t}.parquet").select(F.col(c).alias("name"))
    names = read("conversations", "role").union(read("part", "p_type")).union(read("documents", "source")).where("name is not null").distinct().withColumn("label", F.lit("NAME"))
    return audit.section_coverage(docs, register.gazetteer_mentions(docs, names, 1))


@query(node_sql("select label, canonical_name, case when length(name) > 20 then name else substr('seen in ' || source_docs, 1, 300) end as context from nodes"))
def gq13_provenance_context(spark, sf):
    n = demo.sourced_nodes(spark, sf)
    return n.select("label", "canonical_name", F.when(F.length("name") > 20, F.col("name")).otherwise(F.substring(F.concat(F.lit("seen in "), "source_docs"), 1, 300)).alias("context"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}#]+'), lambda w: w <> '')"


@query(f"""with a as (select doc_id, text, {_WORDS}[5] as q, case when doc_id % 3 = 0 then 'passage ' || doc_id end as st from documents), b as (select *, case when q is null then 0 else instr(lower(text), q) end as i from a),
  c as (select *, greatest(i - 40, 1) as s, least(i + length(q) + 40, length(text) + 1) as e from b)
  select doc_id, q as canonical_name, substr(coalesce(st, case when i > 0 then case when s > 1 then '...' else '' end || substr(text, s, i - s) || '>>>' || substr(text, i, length(q)) || '<<<' || substr(text, i + length(q), e - i - length(q)) || case when e <= length(text) then '...' else '' end else text end), 1, 300) as context from c where q is not null""")
def gq13_snippets(spark, sf):
    """Each document's fifth word as an entity that was found there; a third of them come with their source text."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    word = F.get(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}#]+"), lambda w: w != ""), F.lit(4))
    source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("passage "), F.col("doc_id").cast("string")))
    found = d.select("doc_id", word.alias("canonical_name"), source.alias("source_text")).where("canonical_name is not null")
    return search.provenance_context(found, d, "doc_id", around=40)


@query("select p_name as entity, k, count(distinct v) as n_values from (select p_name, unnest(['brand', 'size', 'type']) as k, unnest([p_brand, p_size::varchar, p_type]) as v from part) group by p_name, k having count(distinct v) > 1")
def pln1_value_conflicts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    props = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (("brand", "p_brand"), ("size", "p_size"), ("type", "p_type"))))
    return p.select(F.col("p_name").alias("entity"), F.explode(props).alias("p")).groupBy("entity", "p.k").agg(F.countDistinct("p.v").alias("n_values")).where("n_values > 1")


@query("""with q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, round(list_cosine_similarity(qv, embedding)::double, 5) as score from q join embeddings e on e.vec_id <> query_id)
  select query_id, vec_id, score from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""")
def pln4_cosine_top10(spark, sf):
    """A stated set of query vectors, a hundredth of the table, against all rows in blocks: the questions go to every block of rows."""
    return _cosine(spark, sf)


@query("""with q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, round(list_cosine_similarity(qv, embedding)::double, 5) as score from q join embeddings e on e.vec_id <> query_id)
  select query_id, vec_id, score from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""")
def pln4_indexed_top10(spark, sf):
    """The same by inverted lists, probed until no list that is left can hold a nearer row."""
    return vectors.nearest(*_vectors(spark, sf), digits=5).select("query_id", F.col("id").alias("vec_id"), F.col("like").alias("score"))


_COSINE = """q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, round(list_cosine_similarity(qv, embedding)::double, 5) as score from q join embeddings e on e.vec_id <> query_id),
  v as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as r from s qualify r <= 10), st as (select query_id, vec_id from q join embeddings e on e.vec_id between query_id - 3 and query_id + 3 and e.vec_id <> query_id)"""


@query(f"with {_COSINE}, b as (select query_id, vec_id, 0 as way, r from v union all select query_id, vec_id, 1, vec_id from st), f as (select query_id, vec_id, min({{'way': way, 'r': r}}) as pos, count(*) as n from b group by all), k as (select query_id, vec_id, row_number() over (partition by query_id order by pos.way, pos.r, vec_id) as rank, n from f) select query_id, vec_id, rank, n > 1 as both_ways from k".replace("group by all", "group by query_id, vec_id"))
def pln4_hybrid(spark, sf):
    """The nearest vectors, then those that stand beside the question's as its section's neighbours in the structure."""
    near = _cosine(spark, sf)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id")
    beside = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.col("vec_id") - 3, F.col("vec_id") + 3)).alias("vec_id")).where("vec_id != query_id").join(e, "vec_id")
    return search.hybrid(near.select("query_id", "vec_id", F.row_number().over(w).alias("r")), beside.select("query_id", "vec_id", F.col("vec_id").alias("r")), ["query_id"], "vec_id")


def _vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def _cosine(spark, sf):
    return vectors.every_pair(*_vectors(spark, sf), digits=5).select("query_id", F.col("id").alias("vec_id"), F.col("like").alias("score"))


@query("select distinct a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1 where a.p_name <> b.p_name")
def pln7_adjacent_pairs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_name").alias("a"), (F.col("p_partkey") + 1).alias("k")).join(p.select(F.col("p_name").alias("b"), F.col("p_partkey").alias("k")), "k").where("a != b").select("a", "b").distinct()


# ---- ontology ----

RECORDS = """select p_partkey as id, case when p_partkey % 13 = 0 then '  ' else concat(' ', p_name, ' ') end as text, case when p_partkey % 17 = 0 then null else lower(p_brand) end as type, case p_partkey % 3 when 0 then '0.75' when 1 then 'high' else null end as confidence from {part}"""
_REC = f"rec as ({_plain(RECORDS)})"


@query(f"with {_REC} select id, trim(text) as text, upper(trim(type)) as type, coalesce(try_cast(confidence as double), 0.5) as confidence from rec where trim(text) <> '' and trim(type) <> ''")
def flt8_valid_entities(spark, sf):
    return ontology.valid_entities(demo.base(spark, sf, RECORDS))


@query("""with e as (select p_size as section, lower(p_name) as k, arg_max(p_name, p_partkey) as text, arg_max(p_brand, p_partkey) as type from part where p_retailprice > 950 group by all)
  select p.p_size as section, e.text as subj, e.type as subj_type, 'LIKE' as predicate, e.text as obj, e.type as obj_type, case when p_partkey % 3 = 0 then 0.25 else 0.5 end::double as confidence
  from part p join e on e.section = p_size and e.k = lower(p_name)""".replace("group by all", "group by p_size, lower(p_name)"))
def flt9_valid_edges(spark, sf):
    """Ends are named in other cases, with a mark or with an accent."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    ents = p.where("p_retailprice > 950").select(F.col("p_size").alias("section"), F.col("p_name").alias("text"), F.col("p_brand").alias("type"), F.col("p_partkey").alias("ord"))
    subj = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.concat("p_name", F.lit("™")))
    confidence = F.when(F.col("p_partkey") % 3 == 0, F.lit("0.25")).otherwise("much")
    records = p.select(F.col("p_size").alias("section"), subj.alias("subj"), F.lit(" like").alias("predicate"), F.translate(F.upper("p_name"), "E", "É").alias("obj"), confidence.alias("confidence"))
    return ontology.valid_edges(records, ents)


@query("""select p_partkey as id, p_name as subj, case when p_partkey % 2 = 0 then 'PART' else '' end as subj_type, 'IS_A' as predicate, p_brand as obj, 'BRAND' as obj_type, 0.7::double as confidence, false as verified, 'chat:enrichment' as source_doc
  from part where p_partkey % 5 <> 0""")
def flt10_enrichment_edges(spark, sf):
    """Predicates that are not known go; types that are missing are those of the entities of that text."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    kind = F.when(F.col("p_partkey") % 5 == 0, "was_a").otherwise(" is_a")
    records = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ")).alias("subj"), kind.alias("predicate"), F.col("p_brand").alias("obj"), F.when(F.col("p_partkey") % 2 == 0, "part").alias("subj_type"), F.lit("").alias("obj_type"), F.lit("").alias("confidence"))
    entities = p.select(F.col("p_brand").alias("text"), F.lit("BRAND").alias("type"), F.col("p_partkey").alias("ord"))
    return ontology.enrichment_edges(records, spark.createDataFrame([("IS_A",), ("HAS",)], "predicate string"), entities)


@query(f"with {_REC} select id, text, upper(type) as type, coalesce(try_cast(confidence as double), 0.7) as confidence, false as verified, 'chat:enrichment' as source_doc from rec where upper(type) in ('BRAND#1', 'BRAND#2')")
def flt10_enrichment(spark, sf):
    r = demo.base(spark, sf, RECORDS).withColumn("confidence", F.col("confidence").try_cast("double"))
    return ontology.enrichment(r, spark.createDataFrame([("BRAND#1",), ("BRAND#2",)], "type_name string"))


CANDIDATES = "select p_partkey as ord, concat(' ', lower(p_type)) as name, cast(p_partkey % 20 as double) / 20 as confidence from {part} union all select p_partkey + 1000000, p_brand, cast(p_size % 10 as double) / 10 from {part}"
_CAND = f"ca as (select upper(trim(name)) as type_name, arg_min(confidence, ord) as confidence from ({_plain(CANDIDATES)}) group by 1), gate as (select *, case when confidence >= 0.85 then 'auto' else 'review' end as decision from ca where type_name <> 'BRAND#3')"


def _gated(spark, sf):
    return ontology.gate_candidates(demo.base(spark, sf, CANDIDATES), spark.createDataFrame([("BRAND#3",)], "type_name string"))


@query(f"with {_CAND} select * from gate")
def flt11_candidate_gate(spark, sf):
    return _gated(spark, sf)


@query(f"with {_CAND} select 'BRAND#3' as type_name union all select type_name from gate where decision = 'auto'")
def mut17_ontology_growth(spark, sf):
    return ontology.grow(spark.createDataFrame([("BRAND#3",)], "type_name string"), _gated(spark, sf))


TYPES = "select distinct p_size % 3 as version_id, upper(p_brand) as type_name, concat('kind of ', lower(p_brand)) as description from {part}"
_TY = f"ty as ({_plain(TYPES)})"


@query(f"with {_TY} select version_id, string_agg('- ' || type_name || ': ' || description, chr(10) order by '- ' || type_name || ': ' || description) as listing from ty group by version_id")
def fn25_type_listing(spark, sf):
    return ontology.type_list(demo.base(spark, sf, TYPES))


@query(node_sql("""select string_agg('- ' || name || ' (' || label || ')', chr(10) order by name, label) as listing from (select name, label from nodes order by name, label limit 200)"""))
def fn25_entity_listing(spark, sf):
    return ontology.entity_list(demo.nodes(spark, sf).select(F.col("name").alias("text"), F.col("label").alias("type")))


@query(f"with {_TY} select version_id, '{{' || string_agg('\"' || type_name || '\":\"' || description || '\"', ',' order by type_name) || '}}' as json from ty group by version_id")
def snk6_export_versions(spark, sf):
    return ontology.export_version(demo.base(spark, sf, TYPES))


@query(f"with {_TY} select 9 as version_id, type_name, description from ty where version_id = 1")
def snk6_import_version(spark, sf):
    return ontology.import_version(ontology.export_version(demo.base(spark, sf, TYPES).where("version_id = 1")), 9)


@query(f"with {_TY} select type_name, case when version_id = 0 then description || '!' else description end as description from (select *, row_number() over (partition by type_name order by version_id) as r from ty where version_id in (0, 1)) where r = 1")
def set5_load_ontology(spark, sf):
    t = demo.base(spark, sf, TYPES)
    named = t.where("version_id = 0").select("type_name", F.concat("description", F.lit("!")).alias("description"))
    return ontology.load_ontology(t.where("version_id = 1").select("type_name", "description"), named).select("type_name", "description")


@query(f"with {_TY} select 'stored' as scenario, type_name, description from ty where version_id = 1 union all select 'none active', type_name, case when version_id = 0 then description || '!' else description end from (select *, row_number() over (partition by type_name order by version_id) as r from ty where version_id in (0, 1)) where r = 1")
def snk7_active_ontology(spark, sf):
    """Types of the active version; and of the base set with the named one on top, as no version is active."""
    t = demo.base(spark, sf, TYPES)
    versions = t.select("version_id").distinct()
    base, named = t.where("version_id = 1"), t.where("version_id = 0").select("type_name", F.concat("description", F.lit("!")).alias("description"))
    stored = ontology.active_types(t, versions.withColumn("is_active", F.col("version_id") == 1), base, named)
    fallback = ontology.active_types(t, versions.withColumn("is_active", F.lit(False)), base, named)
    return stored.select(F.lit("stored").alias("scenario"), "*").unionByName(fallback.select(F.lit("none active").alias("scenario"), "*"))


@query(f"with {_TY} select distinct type_name from ty where version_id = 0 except select type_name from ty where version_id = 1")
def set4_type_difference(spark, sf):
    t = demo.base(spark, sf, TYPES)
    return t.where("version_id = 0").select("type_name").subtract(t.where("version_id = 1").select("type_name"))


@query(f"with {_TY} select distinct version_id, version_id = 1 as is_active from ty")
def mut12_activate_version(spark, sf):
    return merge.activate_version(demo.base(spark, sf, TYPES).select("version_id").distinct(), 1)


@query(f"with {_TY} select version_id, type_name, case when version_id = 1 then 'new' else description end as description from ty where not (version_id = 2 and type_name like '%1')")
def mut13_type_upsert(spark, sf):
    t = demo.base(spark, sf, TYPES)
    new = t.where("version_id = 1").select("version_id", "type_name", F.lit("old").alias("description"), F.lit(1).alias("ord")).unionByName(t.where("version_id = 1").select("version_id", "type_name", F.lit("new").alias("description"), F.lit(2).alias("ord")))
    merged = merge.upsert_by_key(t, new, ["version_id", "type_name"], "ord")
    return merge.delete_by_key(merged, t.where("version_id = 2 and type_name like '%1'"), ["version_id", "type_name"])


@query("select 'p' || p_size as prompt_key, arg_max(p_name, p_partkey) as prompt_text from part group by p_size")
def mut14_keyed_texts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("prompt_key"), F.col("p_name").alias("prompt_text"), F.col("p_partkey").alias("ord"))
    return merge.upsert_by_key(None, p, ["prompt_key"], "ord")


@query("""select p_size as section, p_name as text, p_partkey as ord, 'table' as source from part where p_partkey % 2 = 0
  union all select section, text, ord, 'model' from (select p_size as section, upper(p_name) as text, p_partkey as ord, row_number() over (partition by p_size, lower(p_name) order by p_partkey) as r from part a where p_partkey % 2 = 1
   and not exists (select 1 from part b where b.p_partkey % 2 = 0 and b.p_size = a.p_size and lower(b.p_name) = lower(a.p_name))) where r = 1""")
def set2_section_priority(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    cols = [F.col("p_size").alias("section"), F.col("p_partkey").alias("ord")]
    return ontology.section_priority(p.where("p_partkey % 2 = 0").select(*cols, F.col("p_name").alias("text")), p.where("p_partkey % 2 = 1").select(*cols, F.upper("p_name").alias("text")))


@query("""with a as (select p_size as section, p_name as subj, 'IS' as predicate, p_brand as obj, p_partkey as ord from part)
  select *, 'table' as source from a where ord % 2 = 0
  union all select section, upper(subj), predicate, upper(obj), ord, 'model' from (select *, row_number() over (partition by section, lower(subj), lower(obj) order by ord) as r from a where ord % 2 = 1
   and not exists (select 1 from a b where b.ord % 2 = 0 and b.section = a.section and lower(b.subj) = lower(a.subj) and lower(b.obj) = lower(a.obj))) where r = 1""")
def set2_triple_priority(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    edges = p.select(F.col("p_size").alias("section"), F.col("p_name").alias("subj"), F.lit("IS").alias("predicate"), F.col("p_brand").alias("obj"), F.col("p_partkey").alias("ord"))
    return ontology.triple_priority(edges.where("ord % 2 = 0"), edges.where("ord % 2 = 1").withColumns({"subj": F.upper("subj"), "obj": F.upper("obj")}))


def _responses(spark, sf):
    """Each part as a response: sound, fenced, with trailing comma, cut off, or no JSON."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("text"), F.col("p_brand").alias("type"))).alias("entities")))
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.regexp_replace(body, r"\]\}$", ",]}")).when(k == 3, F.regexp_replace(body, r'"\}\]\}$', "")).otherwise("no json")
    return p.select(F.col("p_partkey").alias("id"), raw.alias("raw"))


@query("select p_partkey as id, 0 as at, p_name as text, p_brand as type from part where p_partkey % 5 <> 4")
def fn8_repaired_records(spark, sf):
    records = ontology.unwrap_records(ontology.parse_responses(_responses(spark, sf)), ["entities", "relationships"])
    return records.select("id", "at", F.element_at("record", F.lit("text")).alias("text"), F.element_at("record", F.lit("type")).alias("type"))


# ---- sessions ----

EPISODES = """ep0 as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as answer, length(text) as n from conversations),
  ep as (select conv_id * 1000 + turn as id, conv_id as session_id, turn, text as question, coalesce(answer, '') as answer, n % 7 + 1 as steps_taken, n / 10 as elapsed_seconds, (n % 101) / 100 as confidence, (n % 53) / 52 as groundedness, n % 4 as entities_added, n % 3 as rels_added, (n % 9 = 0)::int as timed_out from ep0 where role = 'user')"""


def _episodes(spark, sf):
    return logs.episodes(spark.read.parquet(f"{sf}/conversations.parquet"))


@query(f"with {EPISODES} select count(*) as episodes, round(avg(steps_taken), 1) as avg_steps_taken, round(avg(elapsed_seconds), 1) as avg_elapsed_seconds, round(avg(confidence), 2) as avg_confidence, round(avg(groundedness), 2) as avg_groundedness, sum(entities_added)::bigint as entities, sum(rels_added)::bigint as rels, sum(timed_out)::bigint as timeouts from ep")
def agg6_episode_statistics(spark, sf):
    return logs.episode_statistics(_episodes(spark, sf))


@query("select event_type as action_type, user_id as action_id, min(ts) as started, min(event_type || ' ' || user_id) as label, count(*) as items, count(*) filter (event_id % 2 = 0) as entities, count(*) filter (event_id % 2 = 1) as relationships from events group by event_type, user_id")
def agg7_action_rollup(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    activity = e.select(F.col("event_type").alias("action_type"), F.col("user_id").alias("action_id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("action_label"), F.when(F.col("event_id") % 2 == 0, "entity").otherwise("relationship").alias("item_type"), F.col("ts").alias("created_at"))
    return logs.action_rollup(activity)


@query("select label, count(*) as n, string_agg(text, ', ' order by r) filter (r <= 8) || case when count(*) > 8 then ' and ' || (count(*) - 8) || ' more' else '' end as shown from (select *, row_number() over (partition by label order by text, ord) as r from (" + _plain(demo.MENTIONS) + ")) group by label")
def agg8_type_samples(spark, sf):
    m = demo.mentions(spark, sf)
    r = m.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("text", "ord"))).where("r <= 8")
    shown = r.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("rows"))
    more = F.when(F.col("n") > 8, F.concat(F.lit(" and "), (F.col("n") - 8).cast("string"), F.lit(" more"))).otherwise("")
    return m.groupBy("label").agg(F.count("*").alias("n")).join(shown, "label").select("label", "n", F.concat(F.array_join(F.transform("rows", lambda x: x["text"]), ", "), more).alias("shown"))


@query(f"with {EPISODES}, s as (select turn % 3 as t, case when session_id % 2 = 0 then 'a' else 'b' end as run, steps_taken % 3 as score from ep) select 'type' || t as type, round(sum(score) filter (run = 'a') * 100.0 / (count(*) filter (run = 'a') * 2), 1)::double as a, round(sum(score) filter (run = 'b') * 100.0 / (count(*) filter (run = 'b') * 2), 1)::double as b from s group by t")
def agg11_scoreboard(spark, sf):
    e = _episodes(spark, sf)
    scored = e.select(F.concat(F.lit("type"), (F.col("turn") % 3).cast("string")).alias("type"), F.when(F.col("session_id") % 2 == 0, "a").otherwise("b").alias("run"), (F.col("steps_taken") % 3).alias("score"))
    return logs.scoreboard(scored, ["a", "b"])


@query("""with t as (select distinct lang as x from documents where lang is not null), n as (select distinct lower(substr(text, 1, 4)) as x from benchmark order by x limit 30), d as (select doc_id, lower(text) as low from documents)
  select doc_id as id, round(coalesce(ty, 0), 6) as types, round(coalesce(na, 0), 6) as names, coalesce(ty, 0) > 0.8 and coalesce(na, 0) > 0.5 as skip from (select doc_id, avg(case when contains(low, lower(x)) then 1.0 else 0.0 end) as ty from d, t group by doc_id) join (select doc_id, avg(case when contains(low, x) then 1.0 else 0.0 end) as na from d, n group by doc_id) using (doc_id)""")
def agg12_known_share(spark, sf):
    """Every document as a context; languages as types, the first 30 openings of benchmark passages as names."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    types = [r[0] for r in read("documents").where("lang is not null").select("lang").distinct().take(1001)]
    if len(types) > 1000:
        raise ValueError("over 1,000 types are no list of types")
    names = [r[0] for r in read("benchmark").select(F.lower(F.substring("text", 1, 4)).alias("x")).distinct().orderBy("x").limit(30).collect()]
    out = ontology.known_share(read("documents").select(F.col("doc_id").alias("id"), "text"), types, names)
    return out.select("id", F.round("types", 6).alias("types"), F.round("names", 6).alias("names"), "skip")


@query(demo.graph_sql(f", {EPISODES} select (select count(*) from documents) as documents, (select count(*) from pages) as pages, (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(distinct session_id) from ep) as sessions, (select count(*) from ep) as turns, round((select count(*) from edges)::double / (select count(*) from nodes), 2) as density"))
def agg13_dashboard_totals(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    return audit.dashboard(read("documents"), read("pages"), demo.nodes(spark, sf), demo.edges(spark, sf), _episodes(spark, sf))


@query("select event_id, ts from events where event_type = 'click'")
def agg14_action_items(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'").select("event_id", "ts").orderBy("ts", "event_id")


@query(f"with {EPISODES} select id, case when confidence < 0.1 then 'No reliable answer was found.' else answer end as answer from ep")
def flt14_masked_answers(spark, sf):
    return logs.mask_answers(_episodes(spark, sf)).select("id", "answer")


@query(f"with {EPISODES} select session_id, count(*) as turns from ep group by session_id")
def join17_sessions_with_episodes(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").groupBy(F.col("conv_id").alias("session_id")).agg(F.min("turn").alias("started_at"))
    return logs.sessions_with_episodes(c, _episodes(spark, sf)).select("session_id", "turns")


@query("""with l as (select event_id, user_id, ts from events where event_type = 'purchase'), r as (select event_id as rid, user_id, ts as rts from events where event_type = 'click')
  select l.event_id, l.user_id, coalesce(r.rid, -1) as r_rid from l asof left join (select user_id, rts, max(rid::varchar)::bigint as rid from r group by user_id, rts) r on l.user_id = r.user_id and l.ts >= r.rts""")
def join16_as_of(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("rid"), "user_id", F.col("ts").alias("rts"))
    return logs.as_of(left, right, "user_id", "ts", "rts", "rid").select("event_id", "user_id", F.coalesce("r_rid", F.lit(-1)).alias("r_rid"))


@query("with s as (select user_id as session_id, event_id as step, value < 50 as e from events where value is not null), g as (select *, sum(case when e then 0 else 1 end) over (partition by session_id order by step) as g from s), r as (select session_id, g, count(*) as n from g where e group by session_id, g) select s.session_id, coalesce(sum(t), 0)::bigint as triggers from (select distinct session_id from s) s left join (select session_id, n // 3 as t from r) r using (session_id) group by s.session_id")
def win8_empty_runs(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("value is not null")
    return logs.empty_runs(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("at"), (F.col("value") < 50).alias("empty")))


@query(f"with {EPISODES}, u as (select *, sum((length(question) + length(answer)) // 4) over (partition by session_id order by turn desc) as upto from ep) select id from u where upto <= 300")
def win9_last_turns(spark, sf):
    return logs.last_turns_within(_episodes(spark, sf), F.floor((F.length("question") + F.length("answer")) / 4), 300).select("id")


_SESSIONS = "se as (select distinct session_id, case when session_id % 2 = 0 then 'so far ' || session_id else '' end as summary, (session_id % 3)::int as compacted_turns from ep)"


def _sessions(e):
    return e.select("session_id").distinct().select("session_id", F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("so far "), F.col("session_id").cast("string"))).otherwise("").alias("summary"), (F.col("session_id") % 3).cast("int").alias("compacted_turns"))


@query("with recursive " + EPISODES + ", " + _SESSIONS + """, nl as (select chr(10) as nl),
  hf as (select '═══ CONVERSATION CONTEXT (previous turns) ═══' || nl as h, nl || '═══ CURRENT QUESTION ═══' || nl as f from nl),
  t as (select session_id, row_number() over (partition by session_id order by turn) as num, question, answer, substr(answer, 1, 120) as trace from ep),
  w as (select t.*, 'Turn ' || num || ':' || nl || '  Question: ' || question as head, nl || '  Answer: ' || answer as tail, nl from t, nl),
  x as (select session_id, num, head || case when trace <> '' then nl || '  Graph queries & results:' || nl || trace else '' end || tail as long, head || nl || '  Context from this turn:' || nl || 'brief' || tail as short from w),
  b as (select session_id, compacted_turns as done, case when summary <> '' then '[Summary of turns 1–' || compacted_turns || ']' || nl || summary || nl else '' end as block from se, nl),
  o as (select x.*, 260 - length(h || f) // 4 - length(block) // 4 as room, row_number() over (partition by x.session_id order by num desc) as back from x join b using (session_id), hf where num > done),
  r as (select session_id, 0::bigint as back, 0::bigint as used, false as over, []::varchar[] as body from b
    union all select o.session_id, o.back, used + case when over then 0 when used + length(long) // 4 <= room then length(long) // 4 when used + length(short) // 4 <= room then length(short) // 4 else 0 end,
      over or (used + length(long) // 4 > room and used + length(short) // 4 > room),
      case when over then body when used + length(long) // 4 <= room then list_prepend(long, body) when used + length(short) // 4 <= room then list_prepend(short, body) else body end
    from r join o on o.session_id = r.session_id and o.back = r.back + 1),
  l as (select session_id, arg_max(body, back) as body from r group by session_id)
  select session_id, case when block = '' and len(body) = 0 then '' else h || array_to_string(case when block <> '' then list_prepend(block, body) else body end, chr(10)) || f end as context from l join b using (session_id), hf, nl""")
def win9_context_packing(spark, sf):
    e = _episodes(spark, sf)
    return logs.context(e.withColumns({"trace": F.substring("answer", 1, 120), "brief": F.lit("brief")}), 260, _sessions(e))


@query(f"""with {EPISODES}, {_SESSIONS}, u as (select *, count(*) over (partition by session_id) as n, row_number() over (partition by session_id order by turn) as num from ep)
  select id from u join se using (session_id) where n - compacted_turns > 2 and num > compacted_turns and num <= n - 2""")
def win10_compaction(spark, sf):
    e = _episodes(spark, sf)
    return logs.compaction_window(e, 2, compacted=_sessions(e)).select("id")


@query(f"with {EPISODES} select id, session_id, question, answer from (select *, row_number() over (partition by session_id order by id) as r from ep) where r <= 3")
def win15_session_history(spark, sf):
    return _episodes(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).where("r <= 3").select("id", "session_id", "question", "answer")


@query("select event_type, arg_max(event_id, {'t': ts, 'e': event_id}) as event_id from events group by event_type")
def win6_newest_rows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", F.struct("ts", "event_id").alias("o"))
    return merge.newest(e, ["event_type"], "o").select("event_type", "event_id")


@query("with s as (select distinct 's-' || conv_id as session_id, 'n' || conv_id % 7 as name, conv_id as started_at from conversations), r as (select distinct 'n' || conv_id % 7 as ref from conversations union select distinct 's-' || conv_id from conversations union select 's-1'), m as (select ref, session_id, case when name = ref then 1 when session_id = ref then 2 else 3 end as tier, started_at from r join s on name = ref or starts_with(session_id, ref)) select ref, session_id, tier from m qualify row_number() over (partition by ref order by tier, started_at desc, session_id) = 1")
def win7_session_references(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    sid = F.concat(F.lit("s-"), F.col("conv_id").cast("string"))
    s = c.select(sid.alias("session_id"), F.concat(F.lit("n"), (F.col("conv_id") % 7).cast("string")).alias("name"), F.col("conv_id").alias("started_at")).distinct()
    refs = s.select(F.col("name").alias("ref")).union(c.select(sid)).union(spark.range(1).select(F.lit("s-1"))).distinct()
    return logs.resolve_session(s, refs)


@query(f"with {EPISODES} select id from ep order by id desc limit 10 offset 5")
def top4_episode_page(spark, sf):
    return _episodes(spark, sf).select("id").orderBy(F.desc("id")).offset(5).limit(10)


@query(f"""with {EPISODES}, nl as (select chr(10) as nl), x as (select *, row_number() over (partition by session_id order by turn) as num, repeat(answer, 4) as seen,
    concat_ws(' | ', printf('Confidence: %.0f%%', confidence * 100), printf('Groundedness: %.0f%%', groundedness * 100), case when turn % 3 > 0 then printf('Completeness: %.0f%%', (turn % 3) / 2.0 * 100) end, 'Steps: ' || steps_taken,
      case when elapsed_seconds > 0 then printf('Time: %.1fs', elapsed_seconds) end, case when entities_added > 0 then 'Entities added: ' || entities_added end, case when rels_added > 0 then 'Relationships added: ' || rels_added end) as metrics from ep),
  y as (select session_id, num, '## Turn ' || num || nl || nl || '**Q:** ' || question || nl || nl || '**A:**' || nl || nl || answer || nl || nl || '*' || metrics || '*' || nl || nl
    || case when turn % 4 = 0 then '> **Assessment:** thin' || nl || nl else '' end || case turn % 3 when 0 then '' when 1 then '**Knowledge gaps:**' || nl || '- sizes' || nl || '- dates' || nl || nl else '**Knowledge gaps:**' || nl || '- no list' || nl || nl end
    || '<details>' || nl || '<summary>Reasoning Trace (2 steps)</summary>' || nl || nl || '**Step 1: FIND**' || nl || '```' || nl || 'a' || turn || nl || '```' || nl
    || case when seen = '' then '' else 'Result:' || nl || '```' || nl || case when length(seen) > 1000 then substr(seen, 1, 1000) || nl || nl || '... (truncated)' else seen end || nl || '```' || nl end || nl || '**Step 2: ANSWER**' || nl || nl || '</details>' || nl || nl || '---' || nl as md from x, nl)
  select session_id, '# Session: chat ' || session_id || nl || nl || '**Domain**: d' || session_id || ' | **Turns**: ' || count(*) || nl || nl || '---' || nl || nl || string_agg(md, chr(10) order by num) as markdown from y, nl group by session_id, nl""")
def snk5_session_markdown(spark, sf):
    e = _episodes(spark, sf)
    gaps = F.when(F.col("turn") % 3 == 1, '["sizes", "dates"]').when(F.col("turn") % 3 == 2, "no list").otherwise("[]")
    step = lambda tool, args, seen: F.struct(F.lit(tool).alias("tool"), args.alias("args"), seen.alias("observation"))
    log = F.to_json(F.array(step("FIND", F.concat(F.lit("a"), F.col("turn").cast("string")), F.repeat("answer", F.lit(4))), step("ANSWER", F.lit(""), F.lit(""))))
    more = {"completeness": F.when(F.col("turn") % 3 > 0, F.col("turn") % 3 / 2), "assessment_reasoning": F.when(F.col("turn") % 4 == 0, "thin"), "assessment_gaps": gaps, "actions_log": log}
    name = lambda p: F.concat(F.lit(p), F.col("session_id").cast("string"))
    sessions = e.select("session_id").distinct().select("session_id", name("chat ").alias("name"), name("d").alias("domain"), F.lit("").alias("started_at"))
    return logs.session_markdown(e.withColumns(more), sessions)


@query("select 'ingest' as action_type, text as item_name, 'entity' as item_type from (" + _plain(demo.MENTIONS) + ") union all select 'ingest', lower(subj) || ' → ' || predicate || ' → ' || lower(obj), 'relationship' from (" + _plain(demo.EDGE_MENTIONS) + ")")
def snk4_activity_items(spark, sf):
    """Two actions appended to a log, one after the other, and read back."""
    m = demo.mentions(spark, sf).select(F.lit("ingest").alias("action_type"), F.col("text").alias("item_name"), F.lit("entity").alias("item_type"))
    e = merge.keyed_edges(demo.edge_mentions(spark, sf))
    path = f"{shared_folder(spark)}/activity-{uuid.uuid4().hex}"
    logs.append_activity(m, path)
    logs.append_activity(e.select(F.lit("ingest").alias("action_type"), F.concat_ws(" → ", "subj", "predicate", "obj").alias("item_name"), F.lit("relationship").alias("item_type")), path)
    return spark.read.parquet(path).select("action_type", "item_name", "item_type")


@query("""select conv_id * 1000 + turn as id, case k when 0 then 'FIND' when 1 then 'GRAPH_QUERY' when 2 then 'SCHEMA' when 3 then 'ANSWER' when 4 then 'SECTION_TEXT' when 5 then 'GRAPH_QUERY' end as tool,
  case k when 0 then 'item ' || conv_id when 1 then 'MATCH (n)' || chr(10) || 'RETURN ' || conv_id when 2 then '' when 3 then 'two' || chr(10) || 'lines (of ' || conv_id || ')' when 4 then 'doc ' || conv_id when 5 then 'x' || chr(10) || conv_id end as args,
  k = 0 as multi from (select *, (conv_id + turn) % 7 as k from conversations)""")
def fn16_parsed_actions(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    k, n = (F.col("conv_id") + F.col("turn")) % 7, F.col("conv_id").cast("string")
    forms = ["I look.\nAction: FIND(item {})\nAction: ANSWER(no)", "Action: GRAPH_QUERY(```cypher\nMATCH (n)\nRETURN {}\n```)", "so\nAction: SCHEMA()", "Action: ANSWER(two\nlines (of {})))\n", '[TOOL_CALL] {tool => "section_text", args => { --text "doc {}" } } [/TOOL_CALL]', "Action: GRAPH_QUERY(`x\n{}`)", "UNKNOWN({}) and no action"]
    response = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        response = F.when(k == i, F.replace(F.lit(form), F.lit("{}"), n)).otherwise(response)
    a = logs.parse_action(response)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), a["tool"].alias("tool"), a["args"].alias("args"), a["multi"].alias("multi"))


@query("select doc_id, crc from (select doc_id, md5(text) as crc from documents) where doc_id in (select min(doc_id) from documents group by md5(text))")
def str2_first_contents(spark, sf):
    """The documents whose content no earlier one has: what the stream keeps."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5("text").alias("crc"))
    return d.groupBy("crc").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "crc")
