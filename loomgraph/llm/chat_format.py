"""Chat formatting: preference pairs with the longest common turn prefix rendered once as the prompt.

Native: arrays of turns and higher-order functions only; the one shuffle gathers each conversation's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Text that cannot be taken for a marker: a space more between < and |; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<( *)\|", "< $1|")


def restore(cleaned: Column) -> Column:
    """The text that clean was given, null as empty."""
    return F.regexp_replace(cleaned, r"<( *) \|", "<$1|")


def clean_role(role: Column) -> Column:
    """A role that ends no marker and begins none: as clean, and a space more between | and >; null becomes `unknown`."""
    return F.regexp_replace(clean(F.coalesce(role, F.lit("unknown"))), r"\|( *)>", "| $1>")


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


END = "<|end|>\n"


def render(turns: Column) -> Column:
    """The turns as one string: <|role|> newline text <|end|> newline, each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END))), "")


def spans(turns: Column, train_role: str = "assistant") -> Column:
    """array<struct<start, end>> of code points of render(turns) that are trained on: text and end marker of train_role's turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, t):
        begin = acc["at"] + F.length(head(t["role"]))
        done = begin + F.length(t["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), done.alias("end")))
        return F.struct(done.alias("at"), F.when(t["role"] == train_role, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that both have, role and text alike."""
    least = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (i > least) | ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.coalesce(F.array_min(differs) - 1, least)


def gather_turns(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation: (conv, turns array<struct<role, text>>), in order of turn, then role, then text.

    Roles and texts are cleaned, so that neither can forge a turn. A null role is `unknown`, a null text empty, a null turn
    comes first; rows with a null conversation id are one conversation; repeated rows are repeated turns.
    """
    row = F.struct(F.col("turn"), clean_role(F.col("role")).alias("role"), clean(F.col("text")).alias("text"))
    sorted_turns = F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.groupBy(F.col(conv)).agg(sorted_turns.alias("turns"))


def preference_rows(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", train_role: str = "assistant") -> DataFrame:
    """pairs (two columns of turn arrays, beside any others) with the arrays replaced by prompt, chosen, rejected and their masks.

    The prompt is the longest common prefix, rendered once; each completion is the rest of its conversation, with the
    spans to train on (an empty array where no such turn is left). Null arrays count as empty; equal conversations have
    empty completions. `n_prompt_turns` is the prefix's number of turns. Other columns stay, whatever their names, but for
    those named as the columns that are made.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.select(F.struct(*(F.col(f"`{c}`") for c in pairs.columns)).alias("row"), F.coalesce(F.col(chosen), empty).alias("a"), F.coalesce(F.col(rejected), empty).alias("b"))
    p = p.select("row", "a", "b", common_prefix(F.col("a"), F.col("b")).alias("n"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    p = p.select("row", "n", F.slice("a", F.lit(1), F.col("n")).alias("prompt"), rest("a").alias("a"), rest("b").alias("b"))
    made = {"n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"} | {chosen, rejected}
    return p.select(
        *(F.col("row").getField(c).alias(c) for c in pairs.columns if c not in made),
        F.col("n").alias("n_prompt_turns"),
        render(F.col("prompt")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        spans(F.col("a"), train_role).alias("chosen_mask"),
        render(F.col("b")).alias("rejected"),
        spans(F.col("b"), train_role).alias("rejected_mask"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Pairs from two turn tables (pair, turn, role, text); a pair that only one of them has is not a pair."""
    a = gather_turns(chosen, pair).withColumnRenamed("turns", "chosen")
    b = gather_turns(rejected, pair).select(F.col(pair).alias("__id"), F.col("turns").alias("rejected"))
    return preference_rows(a.join(b, a[pair].eqNullSafe(b["__id"])).drop("__id"))


def stale_reply(turns: Column) -> Column:
    """The conversation with its last assistant turn answered by its first assistant turn's text (empty, if that is the same turn)."""
    at = lambda t, i: F.when(t["role"] == "assistant", i)
    places = F.filter(F.transform(turns, at), lambda i: i.isNotNull())
    first, last = F.get(places, F.lit(0)), F.get(places, F.size(places) - 1)
    text = F.when(first < last, F.get(turns, first)["text"]).otherwise("")
    return F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == last, text).otherwise(t["text"]).alias("text")))


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def conversation_preferences(conversations: DataFrame) -> DataFrame:
    """Each conversation, chosen, against its own stale reply, rejected; masks as start:end, comma-joined."""
    pairs = gather_turns(conversations).select("conv_id", F.col("turns").alias("chosen"), stale_reply(F.col("turns")).alias("rejected"))
    out = preference_rows(pairs)
    return out.withColumns({c: mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


ORACLE = r"""
with c as (select conv_id, turn, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<( *)\|', '< \1|', 'g'), '\|( *)>', '| \1>', 'g') as role, regexp_replace(coalesce(text, ''), '<( *)\|', '< \1|', 'g') as text from conversations),
t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from c),
e as (select conv_id, min(i) filter (role = 'assistant') as f, max(i) filter (role = 'assistant') as l, count(*) as n from t group by conv_id),
r as (select t.*, e.n, case when t.i = e.l then case when e.f < e.l then (select s.text from t s where s.conv_id = t.conv_id and s.i = e.f) else '' end else t.text end as bad from t join e using (conv_id)),
p as (select conv_id, coalesce(min(i) filter (text <> bad) - 1, max(n)) as k from r group by conv_id),
d as (select r.conv_id, k, i, role, 2 + length(role) + 3 as h, text, bad, '<|' || role || '|>' || chr(10) as hd, '<|end|>' || chr(10) as en from r join p using (conv_id)),
w as (select *, coalesce(sum(h + length(text) + 8) filter (i > k) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) as a,
                coalesce(sum(h + length(bad) + 8) filter (i > k) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) as b from d)
select conv_id, cast(max(k) as integer) as n_prompt_turns,
  coalesce(string_agg(hd || text || en, '' order by i) filter (i <= k), '') as prompt,
  coalesce(string_agg(hd || text || en, '' order by i) filter (i > k), '') as chosen,
  coalesce(string_agg((a + h)::bigint || ':' || (a + h + length(text) + 8)::bigint, ',' order by i) filter (i > k and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(hd || bad || en, '' order by i) filter (i > k), '') as rejected,
  coalesce(string_agg((b + h)::bigint || ':' || (b + h + length(bad) + 8)::bigint, ',' order by i) filter (i > k and role = 'assistant'), '') as rejected_mask
from w group by conv_id
"""
