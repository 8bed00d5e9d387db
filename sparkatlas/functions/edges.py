"""Typed edges from the words around a link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 150
REACH = 100


@dataclass(frozen=True)
class Cue:
    """Phrases that tell an edge type, in order of trust."""

    edge_type: str
    strong: tuple[str, ...]
    weak: tuple[str, ...]


# Edge types in the order they are tried, with the phrases that tell them.
CUES = (
    Cue("derived_from", (r"derived\s+from", r"based\s+(?:directly\s+)?on", r"builds?\s+on", r"extends?", r"sets?\s+the\s+baseline"), (r"comes?\s+from", r"originated", r"inspired\s+by")),
    Cue("evidence_for", (r"proves?", r"demonstrates?", r"evidence\s+(?:for|that)", r"confirms?", r"validates?"), (r"shows?\s+(?:that|how|why)", r"is\s+how\s+to", r"benchmarked\s+(?:in|by|on)")),
    Cue("supports", (r"reinforces?", r"strengthens?", r"bolsters?", r"corroborates?"), (r"aligns?\s+with", r"consistent\s+with", r"is\s+the\s+\w+\s+(?:design|method|approach|mechanism|pattern|model|framework)")),
    Cue("challenges_undermining", (r"contradicts?", r"refutes?", r"disproves?", r"undermines?"), (r"challenges?", r"questions?\s+(?:whether|if)", r"tension\s+(?:with|between)")),
    Cue("challenges_undercutting", (r"undercuts?", r"weakens?\s+the\s+(?:basis|foundation|premise)"), (r"weakens?", r"limits?\s+the\s+(?:scope|applicability)")),
    Cue("challenges_rebuttal", (r"rebuts?", r"debunks?", r"counterexample\s+to"), (r"counters?", r"counterpoint")),
)


def links_with_context(body: Column, chars: int = CONTEXT) -> Column:
    """Array of (target, before, after) for each link of a body."""
    parts = F.split(body, r"\[\[")
    # each part after the first begins with a link; as brackets part them, so many parts hold the characters wanted
    near = chars // 2 + 1
    return F.filter(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda i: F.struct(
                F.lower(F.trim(F.regexp_extract(F.get(parts, i), r"^([^\]|#]*)[^\]]*\]\]", 1))).alias("target"),
                F.reverse(F.substring(F.reverse(F.array_join(F.slice(parts, F.greatest(F.lit(1), i - near + 1), F.least(i, F.lit(near))), "[[")), 1, chars)).alias("before"),
                F.substring(F.array_join(F.concat(F.array(F.regexp_replace(F.get(parts, i), r"^[^\]]*\]\]", "")), F.slice(parts, i + 2, F.lit(near))), "[["), 1, chars).alias("after"),
            ),
        ),
        lambda x: x["target"] != "",
    )


def clause_before(before: Column) -> Column:
    """The part of the text before a link that belongs to its clause."""
    return F.substring(F.regexp_extract(before, r"(?s)(?:.*(?:\]\]|[.!?] |\n))?(.*)$", 1), -REACH, REACH)


def clause_after(after: Column) -> Column:
    return F.substring(F.regexp_extract(after, r"(?s)^(.*?)(?:\[\[|[.!?] |\n|$)", 1), 1, REACH)


def classify(before: Column, after: Column) -> Column:
    """Struct (edge_type, confidence, flipped): strong cues of all types, then weak ones; null type if none.

    flipped: the cue stands only after the link.
    """
    b, a = F.lower(clause_before(before)), F.lower(clause_after(after))
    tries = [(c.edge_type, r"\b(?:" + "|".join(getattr(c, pick)) + r")\b", conf) for conf, pick in (("high", "strong"), ("medium", "weak")) for c in CUES]
    kinds = [F.when(b.rlike(p) | a.rlike(p), F.struct(F.lit(t).alias("edge_type"), F.lit(conf).alias("confidence"), (~b.rlike(p) & a.rlike(p)).alias("flipped"))) for t, p, conf in tries]
    return F.coalesce(*kinds)
