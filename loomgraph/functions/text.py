"""Text functions: columns in, columns out. Built-in expressions, so they stay in generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that a search term loses, and the words that a phrase loses.
MARKUP = "®™©°*[](){}\"'`"
ASCII_ONLY = r"^[\x00-\x7F]*$"


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no such function."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return s.map(plain, na_action="ignore")


def squeeze(c: Column) -> Column:
    """Runs of any white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical_name(name: Column) -> Column:
    """Trade marks go first, then compatibility forms and accents, then white space and case. ASCII names skip the Arrow step."""
    bare = F.regexp_replace(name, "[®™©]", "")
    return F.lower(squeeze(F.when(bare.rlike(ASCII_ONLY), bare).otherwise(_decomposed(F.when(~bare.rlike(ASCII_ONLY), bare)))))


def search_term(raw: Column) -> Column:
    return squeeze(F.lower(F.translate(raw, MARKUP, "")))


def keywords(term: Column, noise: list[str]) -> Column:
    """Candidates of a normalised term: the phrase without noise words, that less its first word, then single words, longest first."""
    words = F.filter(F.split(term, " "), lambda w: (F.length(w) > 1) & ~w.isin(noise))
    phrase = F.array_join(words, " ")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    singles = F.transform(F.array_sort(placed), lambda s: s["w"])
    return F.array_distinct(F.filter(F.concat(F.array(phrase), F.when(F.size(words) > 1, F.array(rest)).otherwise(F.array().cast("array<string>")), singles), lambda w: w != ""))


def column_key(header: Column) -> Column:
    """A header as snake case; `col` if nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(strip(header)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(key == "", "col").otherwise(key)


def product_prefix(text: Column) -> Column:
    """The first heading of level 1 to 3, up to its first dash, that leaves something; empty if none. Page tags are taken out first."""
    bare = F.regexp_replace(text, r"</?page_\d+>", "")
    heads = F.regexp_extract_all(bare, F.lit(r"(?m)^#{1,3}[^\S\n]+(.+)$"), F.lit(1))
    cut = F.transform(heads, lambda h: strip(F.get(F.split(h, "[—–-]"), F.lit(0))))
    return F.coalesce(F.get(F.filter(cut, lambda h: h != ""), F.lit(0)), F.lit(""))


def abbreviation(name: Column) -> Column:
    """The code, 2 to 5 letters, of `AB — words`, else of `words (AB)`, else a bare `AB` of 2 or 3 capitals, lower-cased; null if there is none."""
    first = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return F.lower(F.coalesce(first(r"^([A-Za-z]{2,5})\s*[—–-]"), first(r"\(([A-Za-z]{2,5})\)"), first(r"^([A-Z]{2,3})$")))


def predicate_name(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z0-9_]", "_"), "^_+|_+$", "")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Known {key} places filled in; other braces stay."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def snippet(text: Column, query: Column, around: int = 200) -> Column:
    """The first place of query in text, ignoring case, marked, with `around` characters on both sides; the whole text if absent."""
    at = F.call_function("locate", F.lower(query), F.lower(text))
    n = F.length(query)
    start, stop = F.greatest(at - around, F.lit(1)), F.least(at + n + around, F.length(text) + 1)
    made = F.concat(
        F.when(start > 1, "...").otherwise(""), F.substring(text, start, at - start), F.lit(">>>"), F.substring(text, at, n), F.lit("<<<"),
        F.substring(text, at + n, stop - at - n), F.when(stop <= F.length(text), "...").otherwise(""),
    )
    return F.when((at > 0) & (n > 0), made).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def truncate_rows(obs: Column, rows: int = 15) -> Column:
    """The first rows of an observation, with the total if some are cut."""
    lines = F.split(obs, "\n")
    cut = F.concat(F.array_join(F.slice(lines, 1, rows), "\n"), F.lit("\n... ("), F.size(lines).cast("string"), F.lit(" total rows)"))
    return F.when(F.size(lines) > rows, cut).otherwise(obs)


def sentences(text: Column) -> Column:
    """Sentences end at . ! ? ; a lone end mark belongs to the sentence after it, as one character makes no sentence."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\s*\S[^.!?]*(?:[.!?]|\z)"), F.lit(0)), strip)


def truncate_sentences(text: Column, most: int = 5) -> Column:
    parts = sentences(text)
    cut = F.concat(F.array_join(F.slice(parts, 1, most), " "), F.lit(" ... ("), F.size(parts).cast("string"), F.lit(" total sentences)"))
    return F.when(F.size(parts) > most, cut).otherwise(text)


def human_predicate(predicate: Column) -> Column:
    return F.replace(F.lower(predicate), F.lit("_"), F.lit(" "))


def typed_cell(cell: Column) -> Column:
    """struct<kind, number>: int, float or text, by what the cell reads as."""
    bare = strip(cell)
    whole, real = bare.rlike(r"^[+-]?\d{1,18}$"), bare.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)$")
    return F.struct(F.when(whole, "int").when(real, "float").otherwise("text").alias("kind"), F.when(real, bare.try_cast("double")).alias("number"))


def effective_confidence(confidence: Column, confirmed: Column, as_of: Column, rate: float) -> Column:
    """Confidence that decays by `rate` for each day since it was confirmed."""
    return confidence * F.pow(F.lit(rate), F.datediff(as_of, confirmed))


def answer_score(answer: Column, expected: Column) -> Column:
    """2, 1 or 0 by the share of the expected numbers and terms that the answer holds (0.7, 0.3); 1 if nothing is expected."""
    low, want = F.lower(answer), F.lower(expected)
    numbers = F.regexp_extract_all(want, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    terms = F.filter(F.transform(F.split(want, r"[,;()\[\]]"), strip), lambda t: (F.length(t) > 2) & ~t.rlike(r"^\d"))
    keys = F.array_distinct(F.concat(numbers, terms))
    share = F.size(F.filter(keys, lambda k: F.contains(low, k))) / F.size(keys)
    return F.when(F.size(keys) == 0, 1).when(share >= 0.7, 2).when(share >= 0.3, 1).otherwise(0)


def clean_answer(text: Column) -> Column:
    """Literal escapes made real: backslash n, t and underscore."""
    for escape, real in (("\\n", "\n"), ("\\t", "\t"), ("\\_", "_")):
        text = F.replace(text, F.lit(escape), F.lit(real))
    return text


# What leads to an answer within a text, in this order, and what is said where there is none.
ANSWERS = (r"(?:final\s+)?answer[:\s]+(.+)", r"(?:in\s+)?conclusion[:\s]+(.+)", r"(?:therefore|thus|so)[,:\s]+(.+)", r"(?:based on (?:the|my) (?:analysis|findings|queries?)[,:\s]+)(.+)")
THOUGHT = r"Thought:\s*(.+?)(?=\nAction:|\z)"
NO_ANSWER = "I was unable to determine an answer from the available information."


def inline_answer(text: Column) -> Column:
    """The answer of a text without an answer action: what follows the first of ANSWERS that occurs, else the last thought of more
    than 20 characters, else the whole text; NO_ANSWER for a blank or null one."""
    after = [F.nullif(strip(F.regexp_extract(text, f"(?is){p}", 1)), F.lit("")) for p in ANSWERS]
    thought = strip(F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?s){THOUGHT}"), F.lit(1)), F.lit(-1)))
    return F.coalesce(*after, F.when(F.length(thought) > 20, thought), F.nullif(strip(text), F.lit("")), F.lit(NO_ANSWER))


def digit_runs(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1))))
