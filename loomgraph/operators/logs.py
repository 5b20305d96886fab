"""Question sessions, reasoning episodes and activity logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from loomgraph.functions.text import strip

MASK = "No reliable answer was found."


def episodes(conversations: DataFrame) -> DataFrame:
    """Each user turn with the next turn's reply as its answer, with metrics by arithmetic on them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = conversations.withColumn("answer", F.lead("text").over(w)).where("role = 'user'")
    n = F.length("text")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"),
        (n % 7 + 1).alias("steps_taken"), (n / 10).alias("elapsed_seconds"), ((n % 101) / 100).alias("confidence"), ((n % 53) / 52).alias("groundedness"), (n % 4).alias("entities_added"), (n % 3).alias("rels_added"), (n % 9 == 0).cast("int").alias("timed_out"),
    )


def episode_statistics(e: DataFrame) -> DataFrame:
    avg = lambda c, d: F.round(F.avg(c), d).alias(f"avg_{c}")
    return e.agg(F.count("*").alias("episodes"), avg("steps_taken", 1), avg("elapsed_seconds", 1), avg("confidence", 2), avg("groundedness", 2), F.sum("entities_added").alias("entities"), F.sum("rels_added").alias("rels"), F.sum("timed_out").alias("timeouts"))


def action_rollup(activity: DataFrame) -> DataFrame:
    """Actions with first time, label and counts by item type."""
    return activity.groupBy("action_type", "action_id").agg(F.min("created_at").alias("started"), F.min("action_label").alias("label"), F.count("*").alias("items"), F.count_if(F.col("item_type") == "entity").alias("entities"), F.count_if(F.col("item_type") == "relationship").alias("relationships"))


def mask_answers(e: DataFrame, least: float = 0.1, mask: str = MASK) -> DataFrame:
    return e.withColumn("answer", F.when(F.coalesce("confidence", F.lit(1.0)) < least, F.lit(mask)).otherwise(F.col("answer")))


def sessions_with_episodes(sessions: DataFrame, e: DataFrame) -> DataFrame:
    n = e.groupBy("session_id").agg(F.count("*").alias("turns"))
    return sessions.join(n, "session_id").orderBy(F.desc("started_at"), "session_id")


#: Times at which a key's rows are cut for an as-of join.
TIME_CUTS = 127


def _cut_times(rows: DataFrame, time: str, cuts: int) -> list:
    """At most so many quantiles of a time; none if its type has no quantiles."""
    kind = rows.schema[time].dataType
    if cuts < 1 or not isinstance(kind, (DateType, NumericType, TimestampNTZType, TimestampType)):
        return []
    found = rows.agg(F.percentile_approx(time, [k / (cuts + 1) for k in range(1, cuts + 1)], F.lit(10_000))).first()[0]
    return sorted(set(found or []))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, order: str, cuts: int = TIME_CUTS) -> DataFrame:
    """For each left row the last right row of its key at or before its time (columns of right get r_), no inequality join.

    Both tables are one, cut into stretches of time at quantiles of all times. Within a key and a stretch a running last value
    finds the row, in one sort; what a stretch begins with is the last right row of the key's stretches before it, from a table
    of one row for each key and stretch. So a key with most of all rows is as many groups as there are stretches, and rows are
    never multiplied. Of right rows of one time the greatest `order`, as text, is the last; null times come first, null keys are a key.
    """
    names = [c for c in right.columns if c != key]
    r = right.select(F.col(key), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*names).alias("__r"), F.col(order).cast("string").alias("__o"), F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("__l"))
    lft = left.select(F.col(key), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(None).cast("string").alias("__o"), F.struct(*left.columns).alias("__l"))
    both = r.unionByName(lft)
    at = _cut_times(both.select("__t"), "__t", cuts)
    place = F.size(F.filter(F.array(*(F.lit(c).cast(both.schema["__t"].dataType) for c in at)), lambda c: c <= F.col("__t"))) if at else F.lit(0)
    both = both.withColumn("__b", F.when(F.col("__t").isNull(), 0).otherwise(place))
    w = Window.partitionBy(key, "__b").orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if at:
        ends = both.groupBy(F.col(key).alias("__key"), F.col("__b").alias("__stretch")).agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct("__t", "__o"))).alias("__end"))
        before = F.last("__end", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.withColumn("__before", before).where("__before is not null").select("__key", "__stretch", "__before")
        found = found.join(carried, found[key].eqNullSafe(carried["__key"]) & (found["__b"] == carried["__stretch"]), "left").withColumn("__last", F.coalesce("__last", "__before"))
    return found.select("__l.*", *(F.col(f"__last.{c}").alias(f"r_{c}") for c in names))


def review_context(nodes: DataFrame, chats: DataFrame, episodes: DataFrame, least: int = 20) -> DataFrame:
    """Items for review (canonical_name, source_text, label, question, answer), one for each node (canonical_name, source_text).

    The label is that of the newest chat (id, item_name, action_label, item_detail, created_at) about it, whose detail stands in for
    a missing text if longer than `least`; question and answer are those of the newest episode (id, question, answer,
    entities_added, rels_added, created_at) that had added to the graph by then. That as-of has no key but time: it runs within
    days, and a table of one row for each day carries the last episode on to later days.
    """
    newest = chats.groupBy(F.col("item_name").alias("canonical_name")).agg(F.max_by(F.struct("action_label", "item_detail", "created_at"), F.struct("created_at", "id")).alias("c"))
    hits = newest.select("canonical_name", "c.*").withColumn("day", F.to_date("created_at"))
    grown = episodes.where("entities_added > 0 or rels_added > 0").select("id", "question", "answer", "created_at", F.to_date("created_at").alias("day"))
    within = as_of(hits, grown, "day", "created_at", "created_at", "id")
    last = grown.groupBy("day").agg(F.max_by(F.struct("question", "answer"), F.struct("created_at", F.col("id").cast("string"))).alias("last"))
    days = last.unionByName(hits.select("day", F.lit(None).cast(last.schema["last"].dataType).alias("last"))).groupBy("day").agg(F.first("last", ignorenulls=True).alias("last"))
    carried = days.select("day", F.last("last", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    told = within.join(carried, "day").select("canonical_name", "action_label", "item_detail", *(F.when(F.col("r_id").isNotNull(), F.col(f"r_{c}")).otherwise(F.col(f"before.{c}")).alias(c) for c in ("question", "answer")))
    own = F.coalesce(F.nullif("source_text", F.lit("")), F.when(F.length("item_detail") > least, F.col("item_detail")))
    return nodes.select("canonical_name", "source_text").join(told, "canonical_name", "left").select("canonical_name", own.alias("source_text"), F.col("action_label").alias("label"), "question", "answer")


def empty_runs(steps: DataFrame, n: int = 3) -> DataFrame:
    """steps (session_id, at, empty) to session_id, triggers: how often n empty results stood in a row, counting anew after each trigger.

    Gaps and islands: runs between non-empty steps, each worth floor(length / n).
    """
    w = Window.partitionBy("session_id").orderBy("at")
    runs = steps.withColumn("g", F.sum((~F.col("empty")).cast("int")).over(w)).where("empty").groupBy("session_id", "g").agg(F.count("*").alias("n"))
    hit = runs.groupBy("session_id").agg(F.sum(F.floor(F.col("n") / n)).alias("t"))
    return steps.select("session_id").distinct().join(hit, "session_id", "left").select("session_id", F.coalesce("t", F.lit(0)).alias("triggers"))


def compaction_window(e: DataFrame, threshold: int = 3, keep: int = 2, compacted: DataFrame | None = None) -> DataFrame:
    """Turns to compact: of sessions with more than `threshold` turns that are not compacted yet, those after the compacted ones and
    before the last `keep`. compacted: session_id, compacted_turns (how many of the first turns are); none: 0."""
    w = Window.partitionBy("session_id").orderBy("turn")
    e = e.join(compacted.select("session_id", "compacted_turns"), "session_id", "left") if compacted is not None else e.withColumn("compacted_turns", F.lit(None).cast("int"))
    e = e.withColumn("__done", F.coalesce("compacted_turns", F.lit(0))).withColumn("__n", F.count("*").over(Window.partitionBy("session_id"))).withColumn("__at", F.row_number().over(w))
    late = (F.col("__n") - F.col("__done") > threshold) & (F.col("__at") > F.col("__done")) & (F.col("__at") <= F.col("__n") - keep)
    return e.where(late).drop("__done", "__n", "__at", "compacted_turns")


def last_turns_within(e: DataFrame, size: Column, budget: int) -> DataFrame:
    """The newest turns of each session whose sizes together fit the budget."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return e.withColumn("upto", F.sum(size).over(w)).where(F.col("upto") <= budget)


# What stands around the turns, and a turn's lines.
HEADER, FOOTER = "═══ CONVERSATION CONTEXT (previous turns) ═══\n", "\n═══ CURRENT QUESTION ═══\n"
SUMMARY = "[Summary of turns 1–%d]\n%s\n"
QUESTION, TRACE, BRIEF, ANSWER = "Turn %d:\n  Question: %s", "\n  Graph queries & results:\n", "\n  Context from this turn:\n", "\n  Answer: "


def context(e: DataFrame, budget: int, sessions: DataFrame | None = None) -> DataFrame:
    """session_id, context: turns from the newest back, in full if they fit what is left of the budget of tokens (of four
    characters), else in short, until one fits neither; in order, between a header and a footer, which count too.

    e: session_id, turn, question, answer and, where there are any, trace and brief: a turn's queries with their results, and in
    short. sessions: session_id, summary, compacted_turns; compacted turns are left out and the summary stands for them. No turn
    and no summary: an empty context. A fold over a session's turns, newest first; they are what one prompt would hold.
    """
    has = lambda c, mark: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c)).otherwise("") if c in e.columns else F.lit("")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    if sessions is None:
        e = e.withColumns({"summary": F.lit(""), "done": F.lit(0)})
    else:
        e = e.join(sessions.select("session_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("compacted_turns", F.lit(0)).alias("done")), "session_id", "left").fillna({"summary": "", "done": 0})
    start, end = F.format_string(QUESTION, F.col("number"), F.coalesce("question", F.lit(""))), F.concat(F.lit(ANSWER), F.coalesce("answer", F.lit("")))
    forms = F.struct((-F.col("number")).alias("o"), F.concat(start, has("trace", TRACE), end).alias("full"), F.concat(start, has("brief", BRIEF), end).alias("short"))
    rows = F.array_sort(F.collect_list(F.when(F.col("number") > F.col("done"), forms)))
    tokens = lambda c: F.floor(F.length(c) / 4)
    block = F.when(F.col("summary") != "", F.format_string(SUMMARY, F.col("done"), F.col("summary"))).otherwise("")
    held = e.withColumn("number", number).groupBy("session_id").agg(rows.alias("rows"), F.first(block).alias("block"))
    left = F.lit(budget) - (len(HEADER) + len(FOOTER)) // 4 - tokens(F.col("block"))
    none = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("out"))

    def step(a, r):
        full, short = ~a["over"] & (a["used"] + tokens(r["full"]) <= F.col("left")), ~a["over"] & (a["used"] + tokens(r["short"]) <= F.col("left"))
        used = F.when(full, a["used"] + tokens(r["full"])).when(short, a["used"] + tokens(r["short"])).otherwise(a["used"])
        out = F.when(full, F.concat(F.array(r["full"]), a["out"])).when(short, F.concat(F.array(r["short"]), a["out"])).otherwise(a["out"])
        return F.struct(used.alias("used"), (a["over"] | ~(full | short)).alias("over"), out.alias("out"))

    parts = F.concat(F.when(F.col("block") != "", F.array("block")).otherwise(F.array().cast("array<string>")), F.aggregate("rows", none, step, lambda a: a["out"]))
    made = held.withColumn("left", left).select("session_id", parts.alias("parts"))
    return made.select("session_id", F.when(F.size("parts") > 0, F.concat(F.lit(HEADER), F.array_join("parts", "\n"), F.lit(FOOTER))).otherwise("").alias("context"))


GAPS, ACTIONS = "array<string>", "array<struct<tool:string,args:string,observation:string>>"
LONG = 1000


def session_markdown(e: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """session_id, markdown: a header, then each turn with its answer, metrics, assessment, gaps and trace.

    sessions: session_id, name, domain, started_at. e may lack completeness, assessment_reasoning, assessment_gaps (JSON list, or a gap)
    and actions_log (JSON list of tool, args, observation; observations are cut after 1,000 characters); metrics that are null, and
    counts and times that are 0, are not shown. Grouped by session, as one document of a session is asked for.
    """
    col = lambda c, kind="string": F.col(c) if c in e.columns else F.lit(None).cast(kind)
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    share = lambda c, name: F.when(col(c, "double").isNotNull(), F.concat(F.lit(f"{name}: "), F.format_string("%.0f%%", F.bround(col(c, "double") * 100, 0))))
    count = lambda c, name, form="%d", unit="": F.when(col(c, "double") != 0, F.concat(F.lit(f"{name}: "), F.format_string(form, F.col(c)), F.lit(unit)))
    metrics = F.array_join(F.array(
        share("confidence", "Confidence"), share("groundedness", "Groundedness"), share("completeness", "Completeness"), count("steps_taken", "Steps"),
        count("elapsed_seconds", "Time", "%.1f", "s"), count("entities_added", "Entities added"), count("rels_added", "Relationships added"),
    ), " | ")
    gaps = F.coalesce(F.from_json(col("assessment_gaps"), GAPS), F.when(col("assessment_gaps") != "", F.array(col("assessment_gaps"))), F.array().cast(GAPS))
    actions = F.coalesce(F.from_json(col("actions_log"), ACTIONS), F.array().cast(ACTIONS))

    def action(a, i):
        o = F.when(F.length(a["observation"]) > LONG, F.concat(F.substring(a["observation"], 1, LONG), F.lit("\n\n... (truncated)"))).otherwise(a["observation"])
        fence = lambda c, head="": F.when(F.coalesce(c, F.lit("")) != "", line(f"{head}```\n", c, "\n```\n")).otherwise("")
        return line("**Step ", (i + 1).cast("string"), ": ", F.coalesce(a["tool"], F.lit("?")), "**\n", fence(a["args"]), fence(o, "Result:\n"), "\n")

    trace = F.when(F.size(actions) > 0, line("<details>\n<summary>Reasoning Trace (", F.size(actions).cast("string"), " steps)</summary>\n\n", F.array_join(F.transform(actions, action), ""), "</details>\n\n")).otherwise("")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    turn = line(
        "## Turn ", F.col("number").cast("string"), "\n\n**Q:** ", F.coalesce("question", F.lit("")), "\n\n**A:**\n\n", F.coalesce("answer", F.lit("")), "\n\n",
        F.when(F.col("metrics") != "", line("*", F.col("metrics"), "*\n\n")).otherwise(""),
        F.when(F.coalesce(col("assessment_reasoning"), F.lit("")) != "", line("> **Assessment:** ", col("assessment_reasoning"), "\n\n")).otherwise(""),
        F.when(F.size(gaps) > 0, line("**Knowledge gaps:**\n", F.array_join(F.transform(gaps, lambda g: F.concat(F.lit("- "), g)), "\n"), "\n\n")).otherwise(""), trace, "---\n",
    )
    rows = F.array_sort(F.collect_list(F.struct("number", turn.alias("md"))))
    out = e.withColumns({"number": number, "metrics": metrics}).groupBy("session_id").agg(F.array_join(F.transform(rows, lambda r: r["md"]), "\n").alias("body"), F.count("*").alias("turns"))
    if sessions is None:
        sessions = out.select("session_id", *(F.lit(None).cast("string").alias(c) for c in ("name", "domain", "started_at")))
    named = sessions.join(out, "session_id", "left").withColumns({"turns": F.coalesce("turns", F.lit(0)), "body": F.coalesce("body", F.lit(""))})
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    about = F.array_join(F.array(line("**Domain**: ", some("domain")), line("**Started**: ", F.substring(some("started_at"), 1, 19)), line("**Turns**: ", F.col("turns").cast("string"))), " | ")
    head = line("# Session: ", F.coalesce(some("name"), F.substring(F.col("session_id").cast("string"), 1, 8)), "\n\n", about, "\n\n---\n\n")
    return named.select("session_id", F.concat(head, "body").alias("markdown"))


def resolve_session(sessions: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (ref) to sessions: exact name, else exact id, else id prefix; the newest of a tier. An id is a key for each of its prefixes, so all tiers are one equi-join."""
    s = sessions.select("session_id", "name", "started_at")
    size = F.length("session_id")
    start = F.explode(F.transform(F.sequence(F.lit(1), size), lambda n: F.struct(F.substring("session_id", F.lit(1), n).alias("ref"), F.when(n == size, 2).otherwise(3).alias("tier")))).alias("k")
    keys = s.select(F.col("name").alias("ref"), F.lit(1).alias("tier"), *s.columns).unionByName(s.where(size > 0).select(start, *s.columns).select("k.ref", "k.tier", *s.columns))
    met = refs.join(keys, "ref")
    w = Window.partitionBy("ref").orderBy("tier", F.desc("started_at"), "session_id")
    return met.withColumn("r", F.row_number().over(w)).where("r = 1").select("ref", "session_id", "tier")


def scoreboard(scored: DataFrame, runs: list[str]) -> DataFrame:
    """type, and for each run the share of points reached."""
    share = F.round(F.sum("score") * 100 / (F.count(F.lit(1)) * 2), 1)
    return scored.groupBy("type").pivot("run", runs).agg(share)


# The tools that a response may call besides ANSWER, and the marks of the wrapper form.
TOOLS = ("FIND", "DETAILS", "RELATED", "COMPARE", "LIST", "SCHEMA", "GRAPH_QUERY", "SECTION_TEXT")
WRAPPER = r'(?ds)\[TOOL_CALL\]\s*\{tool\s*=>\s*"(\w+)".*?--text\s+"(.*?)"\s*\}\s*\}\s*\[/TOOL_CALL\]'
WRAPPED = ("ANSWER", "GRAPH_QUERY", "SECTION_TEXT")


def parse_action(response: Column) -> Column:
    """struct<tool, args, multi> of the first action of a response; tool and args are null if there is none.

    multi: there are several lines of `Action:`, of which only the first is read, up to the next. The forms, first that fits:
    a known tool and its brackets at the end of a line, with arguments or without; arguments of several lines in a fence (with
    its language), a back-tick or quotes; ANSWER up to the last bracket, less brackets that it did not open; the wrapper form.
    """
    starts = F.regexp_count(response, F.lit(r"(?md)^Action:\s*"))
    text = F.when(starts > 1, F.regexp_extract(response, r"(?sd)^(.*?(?:^|\n)Action:.*?)\s*\nAction:", 1)).otherwise(response)
    call = r"Action:\s*(" + "|".join(TOOLS) + r")\s*\("
    forms = (r"(?md)" + call + r"(.+)\)\s*$", r"(?md)" + call + r"\s*()\)\s*$", "(?d)" + call + r"\s*```\w*\n([\s\S]*?)```\s*\)", "(?d)" + call + r"\s*`([\s\S]*?)`\s*\)", "(?d)" + call + r'\s*"([\s\S]*?)"\s*\)')
    found = [F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("tool"), strip(F.regexp_extract(text, p, 2)).alias("args"))) for p in forms]

    said = strip(F.regexp_extract(text, r"Action:\s*ANSWER\s*\(\s*([\s\S]+)\)\s*\z", 1))
    surplus = F.greatest(F.regexp_count(said, F.lit(r"\)")) - F.regexp_count(said, F.lit(r"\(")), F.lit(0))
    closing = F.regexp_count(F.regexp_extract(said, r"((?:\)\s*)+)\z", 1), F.lit(r"\)"))
    last = lambda acc, _: F.regexp_replace(acc, r"\s*\)\z", "")
    said = F.aggregate(F.sequence(F.lit(0), F.least(surplus, closing)), F.concat(said, F.lit(")")), last)
    found.append(F.when(text.rlike(r"Action:\s*ANSWER\s*\(\s*[\s\S]+\)\s*\z"), F.struct(F.lit("ANSWER").alias("tool"), said.alias("args"))))

    wrapped = F.upper(F.regexp_extract(text, WRAPPER, 1))
    found.append(F.when(wrapped.isin(*WRAPPED), F.struct(wrapped.alias("tool"), strip(F.regexp_extract(text, WRAPPER, 2)).alias("args"))))
    first = F.coalesce(*found)
    return F.struct(first["tool"].alias("tool"), first["args"].alias("args"), F.coalesce(starts > 1, F.lit(False)).alias("multi"))


def is_evidence(step: Column) -> Column:
    """A step of a tool that found something."""
    return (step["tool"] != "ANSWER") & (step["observation"] != "") & (step["observation"] != "(no results)")


def evidence_digest(actions: Column, most: int = 10) -> Column:
    """The first steps that found something, one line each, arguments and observations capped."""
    line = lambda s: F.concat(F.lit("["), s["tool"], F.lit("("), F.substring(s["args"], 1, 300), F.lit(")] "), F.substring(s["observation"], 1, 500))
    return F.array_join(F.transform(F.slice(F.filter(actions, is_evidence), 1, most), line), "\n")


def action_summary(actions: Column, lines: int = 8, names: int = 10) -> Column:
    """How many graph queries ran, and the first names that they found: the first cells of their first rows."""
    graph = F.filter(actions, lambda s: s["tool"] == "GRAPH_QUERY")
    found = F.filter(graph, is_evidence)
    cell = lambda row: F.regexp_replace(F.get(F.split(row, r" \| "), F.lit(0)), r"^\s+|\s+$", "")
    every = F.flatten(F.transform(found, lambda s: F.transform(F.slice(F.split(s["observation"], "\n"), 1, lines), cell)))
    some = F.slice(F.array_distinct(F.filter(every, lambda n: n != "")), 1, names)
    ran = F.when(F.size(graph) > 0, F.concat(F.lit("    Queries: "), F.size(graph).cast("string"), F.lit(" graph queries executed")))
    return F.concat_ws("\n", ran, F.when(F.size(some) > 0, F.concat(F.lit("    Entities found: "), F.array_join(some, ", "))))


def append_activity(items: DataFrame, path: str) -> None:
    """Appends items to the log at path, each with the time of the append. Files are added; what is there is not read."""
    items.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
