"""Prose: payloads for a prompt, sentences, names, author-year citations, checks of edited notes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkatlas.functions.text import truncate_at_sentence

TOP_TOKENS = 300
POINTERS = 4
SNIPPETS = 3
SNIPPET_CHARS = 120
#: Years that a citation can have.
YEAR = r"(19[5-9]\d|20[0-3]\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
# Capitalised words before a year that name no author.
NOT_AUTHORS = (
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "reports", "figure", "table", "section", "chapter", "issue", "version",
)
#: Words of the closed classes, and verbs of reference, that begin a sentence with a capital.
CLOSED_CLASS = (
    "a", "an", "the", "this", "that", "these", "those", "some", "any", "each", "every", "no", "not", "all", "both", "most", "many", "few", "such",
    "i", "you", "he", "she", "it", "we", "they", "my", "your", "his", "her", "its", "our", "their", "who", "which", "what", "where", "when", "why", "how",
    "in", "on", "at", "by", "for", "from", "to", "of", "with", "without", "about", "after", "before", "between", "during", "until", "till", "since", "through", "over", "under", "around", "circa", "per", "via", "within",
    "and", "or", "but", "nor", "so", "yet", "if", "then", "than", "as", "because", "while", "although", "though", "however", "thus", "hence", "also", "only", "even", "again", "later", "earlier", "early", "late", "mid", "there", "here", "now", "today",
    "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "can", "could", "may", "might", "must", "shall", "should", "will", "would",
    "see", "cf", "cites", "compare", "year", "years", "spring", "summer", "autumn", "fall", "winter",
)
_AUTHOR = rf"(?!(?i:{'|'.join(NOT_AUTHORS + CLOSED_CLASS)})(?![\p{{L}}'’-])){_NAME}"
_AUTHORS = rf"(?<![\p{{L}}'’-])({_AUTHOR}(?:\s+(?:{_AUTHOR}|&|and(?!\p{{L}})|et\s+al(?!\p{{L}})\.?))*)"
CITATION = rf"{_AUTHORS}(?:[,()\s]|\p{{Lu}}\.?(?!\p{{L}}))*{YEAR}(?![\p{{L}}\d])"


def payload(top_title: Column, top_body: Column, pointers: Column, snippets: Column) -> Column:
    """The text shown beside a prompt: the best note cut to a budget, then further titles and past snippets (arrays)."""
    lines = F.transform(F.slice(pointers, 1, POINTERS), lambda p: F.concat(F.lit("- "), p))
    said = F.transform(F.slice(snippets, 1, SNIPPETS), lambda s: F.concat(F.lit("> "), F.when(F.length(s) > SNIPPET_CHARS, F.concat(F.substring(s, 1, SNIPPET_CHARS), F.lit("…"))).otherwise(s)))
    return F.concat_ws("\n", F.concat(F.lit("# "), top_title), truncate_at_sentence(top_body, TOP_TOKENS), F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n"), F.array_join(F.coalesce(said, F.array().cast("array<string>")), "\n"))


def sentences(text: Column) -> Column:
    """Sentences by their end marks; an approximation, as no language model is at hand."""
    marked = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"([.!?]) (?=[\p{Lu}\d\"'(\[])", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def proper_nouns(text: Column) -> Column:
    """Distinct runs of capitalised words that do not begin a sentence; an approximation."""
    inner = F.flatten(F.transform(sentences(text), lambda s: F.regexp_extract_all(F.regexp_replace(s, r"^\S+", ""), F.lit(rf"({_NAME}(?: {_NAME})*)"), 1)))
    return F.array_sort(F.array_distinct(inner))


def author_years(text: Column) -> Column:
    """Distinct 'Authors Year' citations of a text, line by line: 'Author (2001)', 'Author et al., 2001', 'Author & Other, A. B. 2001'.

    Authors are a run of names, joined by &, and, or et al.; commas, brackets
    and initials may stand before the year. Names are told by their capital, and
    by not being a month, a part of a text or a word of the closed classes.
    """
    plain = lambda a: F.regexp_replace(F.regexp_replace(a, r"\s+", " "), r"et al\.?", "et al.")
    of_line = lambda line: F.zip_with(F.regexp_extract_all(line, F.lit(CITATION), 1), F.regexp_extract_all(line, F.lit(CITATION), 2), lambda a, y: F.concat_ws(" ", plain(a), y))
    return F.array_distinct(F.flatten(F.transform(F.split(text, "\n"), of_line)))


def without_dashes(text: Column) -> Column:
    """Em dashes, and the blanks around them, as commas."""
    return F.regexp_replace(text, r"\s*—\s*", ", ")


def broken_link_marks(text: Column) -> Column:
    """Whether link brackets are unbalanced, nested or empty."""
    rest = F.regexp_replace(text, r"\[\[[^\[\]\n]*[^\[\]\s][^\[\]\n]*\]\]", "")
    return F.contains(rest, F.lit("[[")) | F.contains(rest, F.lit("]]"))


def edit_checks(before: Column, after: Column) -> Column:
    """Struct of what an edit may not do: change the frontmatter, bring in em dashes, break links."""
    front = lambda c: F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---", 1)
    return F.struct((front(before) != front(after)).alias("frontmatter_changed"), (F.contains(after, F.lit("—")) & ~F.contains(before, F.lit("—"))).alias("dashes_added"), broken_link_marks(after).alias("links_broken"))


def first_json(text: str, key: str) -> str | None:
    """The first balanced object of text that has the key, as it stands there."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
            if key in found:
                return text[at:end]
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def json_with(text: Column, key: str) -> Column:
    """first_json over a column, in Arrow batches (balanced braces are beyond regular expressions)."""

    @F.pandas_udf("string")
    def extract(values: pd.Series) -> pd.Series:
        return values.map(lambda t: first_json(t, key) if t else None)

    return extract(text)


# The frontmatter key of each type of edge.
EDGE_KEYS = {
    "evidence_for": "evidence-for",
    "supports": "supports",
    "derived_from": "derived-from",
    "challenges_undermining": "undermines",
    "challenges_undercutting": "undercuts",
    "challenges_rebuttal": "rebuts",
}
_FRONT = re.compile(r"\A---\n(.*?)\n---(?=\n|\Z)", re.S)
_BULLET = re.compile(r"\s*-\s+(.*)")


def _items(parts: list[str]) -> list[str]:
    return [x for x in (p.strip().strip("\"'") for p in parts) if x]


def merge_front(text: str, wanted: dict[str, list[str]]) -> str:
    """The note with the wanted items in its frontmatter's lists; lists keep what they have, other values are left alone."""
    front = _FRONT.match(text)
    lines = front[1].split("\n") if front else []
    changed = False
    for key, items in wanted.items():
        at = next((i for i, line in enumerate(lines) if line.startswith(f"{key}:")), len(lines))
        end, value = at + 1, lines[at].partition(":")[2].strip() if at < len(lines) else ""
        if value and not (value[0] == "[" and value[-1] == "]"):
            continue
        while not value and end < len(lines) and _BULLET.match(lines[end]):
            end += 1
        have = _items(value[1:-1].split(",")) if value else _items([_BULLET.match(line)[1] for line in lines[at + 1 : end]])
        merged = list(dict.fromkeys(have + items))
        if len(merged) > len(have):
            lines[at:end] = [f"{key}: [" + ", ".join(f'"{x}"' for x in merged) + "]"]
            changed = True
    if not changed:
        return text
    return "---\n" + "\n".join(lines) + "\n---" + (text[front.end() :] if front else "\n" + text)


def with_edges(text: Column, edges: Column) -> Column:
    """The note with links to the targets of its edges (array of structs edge_type, to_path) in its frontmatter, by type."""

    @F.pandas_udf("string")
    def merged(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, lists):
            wanted: dict[str, list[str]] = {}
            for e in own if own is not None else []:
                if e["edge_type"] in EDGE_KEYS:
                    name = e["to_path"].rsplit("/", 1)[-1].removesuffix(".md")
                    wanted.setdefault(EDGE_KEYS[e["edge_type"]], []).append(f"[[{name}]]")
            out.append(merge_front(t, wanted) if t is not None else None)
        return pd.Series(out, dtype=object)

    return merged(text, edges)


def iso_time(seconds: Column) -> Column:
    """UTC time of seconds since 1970, to the second."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def civil_from_days(days: Column) -> Column:
    """The proleptic Gregorian date so many days after 1970-01-01."""
    return F.date_from_unix_date(days)


def entailment(contradiction: Column, neutral: Column, entails: Column) -> Column:
    """Struct of the label of a pair of texts by three logits, and its share; ties go to entailment, then contradiction."""
    top = F.greatest(contradiction, neutral, entails)
    total = F.exp(contradiction - top) + F.exp(neutral - top) + F.exp(entails - top)
    label = F.when(entails == top, "entailment").when(contradiction == top, "contradiction").otherwise("neutral")
    return F.struct(label.alias("label"), (1.0 / total).alias("share"))
