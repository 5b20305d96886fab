"""Ontology versions and types, record validation and lenient JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import canonical_name

ACCEPT = 0.85
RECORD = "text string, type string, confidence double"


def valid_entities(records: DataFrame, default: float = 0.5) -> DataFrame:
    """Records (id, text, type, confidence as string) stripped, type upper-cased, confidence typed or the default; those without text or type go."""
    r = records.select("id", F.trim("text").alias("text"), F.upper(F.trim("type")).alias("type"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(default)).alias("confidence"))
    return r.where("text != '' and type != ''")


def _typed(records: DataFrame, entities: DataFrame) -> DataFrame:
    """records with s and o: the entity (text, type) of their section that each end names: by lower-cased text, else by canonical name;
    the last one of equal names."""
    last = lambda key, name: entities.groupBy("section", key.alias(name)).agg(F.max_by(F.struct("text", "type"), "ord").alias(f"{name}_e"))
    for side, end in (("s", "subj"), ("o", "obj")):
        records = records.withColumns({f"{side}1": F.lower(end), f"{side}2": canonical_name(F.col(end))})
        records = records.join(last(F.lower("text"), f"{side}1"), ["section", f"{side}1"], "left").join(last(canonical_name(F.col("text")), f"{side}2"), ["section", f"{side}2"], "left")
        records = records.withColumn(side, F.coalesce(f"{side}1_e", f"{side}2_e"))
    return records


def valid_edges(records: DataFrame, entities: DataFrame, default: float = 0.5) -> DataFrame:
    """Edge records (section, subj, predicate, obj, confidence as string) whose ends are both among their section's entities (section,
    ord, text, type), under the entities' texts, with their types."""
    r = records.select("section", F.trim("subj").alias("subj"), F.upper(F.trim("predicate")).alias("predicate"), F.trim("obj").alias("obj"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(default)).alias("confidence"))
    r = _typed(r.where("subj != '' and obj != '' and predicate != ''"), entities).where("s is not null and o is not null")
    return r.select("section", F.col("s.text").alias("subj"), F.col("s.type").alias("subj_type"), "predicate", F.col("o.text").alias("obj"), F.col("o.type").alias("obj_type"), "confidence")


def enrichment_edges(records: DataFrame, predicates: DataFrame, entities: DataFrame, default: float = 0.7) -> DataFrame:
    """Edge records (id, subj, predicate, obj, subj_type, obj_type, confidence as string) of known predicates (predicate), unverified, from
    chat. A missing type is that of the entity (text, type, ord) of just that text, the last of equal texts, else empty."""
    upper = lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))).alias(c)
    bare = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    r = records.select("id", bare("subj"), upper("predicate"), bare("obj"), upper("subj_type"), upper("obj_type"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(default)).alias("confidence"))
    r = r.where("subj != '' and obj != ''").join(predicates.select("predicate").distinct(), "predicate", "left_semi")
    last = entities.groupBy("text").agg(F.max_by("type", "ord").alias("t"))
    for side in ("subj", "obj"):
        r = r.join(last.select(F.col("text").alias(side), F.col("t").alias(f"{side}_t")), side, "left")
        r = r.withColumn(f"{side}_type", F.coalesce(F.nullif(f"{side}_type", F.lit("")), f"{side}_t", F.lit("")))
    return r.select("id", "subj", "subj_type", "predicate", "obj", "obj_type", "confidence", F.lit(False).alias("verified"), F.lit("chat:enrichment").alias("source_doc"))


def enrichment(records: DataFrame, types: DataFrame, default: float = 0.7) -> DataFrame:
    """Records of known types only, unverified, from chat."""
    known = types.select(F.col("type_name").alias("type")).distinct()
    return records.withColumn("type", F.upper("type")).join(known, "type", "left_semi").select("id", "text", "type", F.coalesce("confidence", F.lit(default)).alias("confidence"), F.lit(False).alias("verified"), F.lit("chat:enrichment").alias("source_doc"))


def gate_candidates(candidates: DataFrame, types: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Candidates (ord, name, confidence) not yet present, the first of equal names: accepted from that confidence, else for review."""
    c = candidates.withColumn("type_name", F.upper(F.trim("name")))
    first = c.groupBy("type_name").agg(F.min_by("confidence", "ord").alias("confidence"))
    fresh = first.join(types.select("type_name").distinct(), "type_name", "left_anti")
    return fresh.withColumn("decision", F.when(F.col("confidence") >= accept, "auto").otherwise("review"))


def grow(types: DataFrame, gated: DataFrame) -> DataFrame:
    return types.select("type_name").unionByName(gated.where("decision = 'auto'").select("type_name"))


def active_types(stored: DataFrame, versions: DataFrame, base: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """type_name and description of the active version (version_id, is_active) among the stored types; where no version is active,
    of the base set with the named one's on top."""
    active = versions.where("is_active").select("version_id")
    if active.take(1):
        return stored.join(active, "version_id", "left_semi").select("type_name", "description")
    out = base.select("type_name", "description")
    return out if named is None else load_ontology(out, named.select("type_name", "description")).select("type_name", "description")


def known_share(contexts: DataFrame, types: list[str], names: list[str], first: int = 30, type_share: float = 0.8, name_share: float = 0.5) -> DataFrame:
    """contexts (id, text) with the share of the types, and of the first names, that the text holds, ignoring case, and whether both
    are so large that there is nothing to learn. The lists are short: types, and `first` names. No types or names: a share of 0."""
    share = lambda xs: sum((F.contains(F.lower("text"), F.lit(x.lower())).cast("double") for x in xs), F.lit(0.0)) / max(len(xs), 1)
    out = contexts.select("id", F.coalesce(share(types), F.lit(0.0)).alias("types"), F.coalesce(share(names[:first]), F.lit(0.0)).alias("names"))
    return out.withColumn("skip", (F.col("types") > type_share) & (F.col("names") > name_share))


def load_ontology(base: DataFrame, named: DataFrame) -> DataFrame:
    """Base types and a named set's; the named one wins."""
    both = base.withColumn("prio", F.lit(1)).unionByName(named.withColumn("prio", F.lit(0)))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("type_name").orderBy("prio"))).where("r = 1").drop("r", "prio")


def export_version(types: DataFrame) -> DataFrame:
    """version_id, json: an object of type names, sorted."""
    pairs = F.array_sort(F.collect_list(F.struct("type_name", "description")))
    return types.groupBy("version_id").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def import_version(exported: DataFrame, version_id: int) -> DataFrame:
    parsed = exported.select(F.explode(F.from_json("json", "map<string,string>")).alias("type_name", "description"))
    return parsed.select(F.lit(version_id).alias("version_id"), "type_name", "description")


def type_list(types: DataFrame) -> DataFrame:
    """version_id, listing: `- NAME: description` lines, sorted."""
    rows = F.array_sort(F.collect_list(F.concat(F.lit("- "), "type_name", F.lit(": "), "description")))
    return types.groupBy("version_id").agg(F.array_join(rows, "\n").alias("listing"))


def entity_list(entities: DataFrame, most: int = 200) -> DataFrame:
    """One row, listing: `- text (TYPE)` of the first `most` entities (text, type) by text and type."""
    first = entities.select("text", "type").orderBy("text", "type").limit(most)
    rows = F.array_sort(F.collect_list(F.struct("text", "type")))
    return first.agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["text"], F.lit(" ("), r["type"], F.lit(")"))), "\n").alias("listing"))


def priority(first: DataFrame, second: DataFrame, by: str, keys: dict) -> DataFrame:
    """All rows of first (`by`, `ord`, further columns), then those of second whose keys (columns) first has not within the same `by`, the
    earliest of equal ones; with `source`, table or model."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = second.withColumns(dict(zip(names, keys.values(), strict=True)))
    known = first.select(by, *(k.alias(n) for n, k in zip(names, keys.values(), strict=True))).distinct()
    new = keyed.join(known, [by, *names], "left_anti").withColumn("__r", F.row_number().over(Window.partitionBy(by, *names).orderBy("ord"))).where("__r = 1")
    return first.withColumn("source", F.lit("table")).unionByName(new.select(*first.columns).withColumn("source", F.lit("model")))


def section_priority(table_records: DataFrame, model_records: DataFrame) -> DataFrame:
    """All table records, then model records whose lower-cased text is new in the section; the first of equal texts."""
    return priority(*(r.select("section", "text", "ord") for r in (table_records, model_records)), "section", {"text": F.lower("text")})


def triple_priority(table_edges: DataFrame, model_edges: DataFrame) -> DataFrame:
    """All table edges, then model edges (section, subj, predicate, obj, ord) that are new in the section, ends in any case."""
    return priority(*(r.select("section", "subj", "predicate", "obj", "ord") for r in (table_edges, model_edges)), "section", {"s": F.lower("subj"), "p": F.col("predicate"), "o": F.lower("obj")})


def _balanced(text: str) -> list[str]:
    """Balanced objects and arrays in the text, longest first."""
    out, stack = [], []
    quoted = escaped = False
    for i, c in enumerate(text):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"' and stack:
            quoted = True
        elif c in "{[":
            stack.append(i)
        elif c in "}]" and stack:
            out.append(text[stack.pop() : i + 1])
    return sorted(out, key=len, reverse=True)


def _closed(text: str) -> str:
    """A text that breaks off, with open strings, arrays and objects closed."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return re.sub(r"[,:]\s*$", "", text + '"' * quoted) + "".join(reversed(stack))


def repair_json(raw: str | None) -> str | None:
    """The JSON value in a response, normalised: fences, comments, trailing commas, Python literals and cut tails are mended; null if there is none."""
    text = re.sub(r"^```\w*\s*|\s*```\s*$", "", (raw or "").strip())
    plain = re.sub(r"(?m)(?<![:\"])//[^\n]*$", "", text)
    for a, b in ((r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null"), (r",\s*([}\]])", r"\1")):
        plain = re.sub(a, b, plain)
    start = min((i for i in (plain.find("{"), plain.find("[")) if i >= 0), default=-1)
    tries = [text, plain, *_balanced(plain)] + ([_closed(plain[start:])] if start >= 0 else [])
    for t in tries:
        try:
            value = json.loads(t)
        except ValueError:
            continue
        if isinstance(value, dict | list):
            return json.dumps(value, ensure_ascii=False)
    return None


def parse_responses(responses: DataFrame) -> DataFrame:
    """responses (id, raw) to (id, json, repaired). Sound JSON takes Spark's own parser; only the rest goes through Python; what cannot be mended is null."""
    sound = F.try_parse_json("raw").isNotNull() & F.trim("raw").rlike(r"^[\[{]")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "json": p["raw"].map(repair_json), "repaired": True})

    good = responses.where(sound).select("id", F.col("raw").alias("json"), F.lit(False).alias("repaired"))
    return good.unionByName(responses.where(~F.coalesce(sound, F.lit(False))).select("id", "raw").mapInPandas(run, "id long, json string, repaired boolean"))


def unwrap_records(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(id, at, record) from parsed responses: a list, an object that holds a list under one of the keys, or one record."""
    record = "array<map<string,string>>"
    of_list = F.from_json("json", record)
    of_key = [F.from_json(F.get_json_object("json", f"$.{k}"), record) for k in keys]
    single = F.array(F.from_json("json", "map<string,string>"))
    rows = F.when(F.trim("json").startswith("["), of_list).otherwise(F.coalesce(*of_key, single))
    return parsed.where("json is not null").select("id", F.posexplode(rows).alias("at", "record"))


def typed_records(parsed: DataFrame, keys: list[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(id, at, record, and a column of each field) from parsed responses, as unwrap_records, with the types that the JSON has.

    record is a VARIANT, so nested objects, numbers and booleans stay what they are. fields: name to (path, type), as
    {"size": ("$.properties.size", "int")}; what is absent or cannot be cast is null. A key that holds no list is passed
    over, elements that are no objects are left out (at keeps their places), and a lone object is one record.
    """
    value = F.try_parse_json("json")
    listed = [F.try_variant_get(value, path, "array<variant>") for path in ("$", *(f"$.{k}" for k in keys))]
    rows = parsed.select("id", F.posexplode(F.coalesce(*listed, F.array(value))).alias("at", "record"))
    objects = rows.where(F.schema_of_variant("record").startswith("OBJECT"))
    return objects.select("*", *(F.try_variant_get("record", path, kind).alias(name) for name, (path, kind) in fields.items()))
