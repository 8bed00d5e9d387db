"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger, a table without texts,
keeps a document's key (doc_id and a hash of its text), its measurements and one
bit per failed rule, and is written to the shared folder. Policies are masks
with a version: applying one, or asking what a rule alone removes, reads the
stored bits, never a text.

DataFrame functions only. Defined cases: a null or empty text has no words and
fails ``min_words``; very long texts are handled whole; repeated rows have a row
each in ``measure`` and one verdict in ``keep``; ties of doc_id with other texts
are judged apart; an empty table gives an empty ledger; extra columns are
ignored by the ledger and kept by ``keep``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm.common import GAP, stored, text_of, unused

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"

#: Bit -> (name, SQL condition of failure over the measurements, in whole numbers so that every engine agrees).
RULES: dict[int, tuple[str, str]] = {
    0: ("min_words", "n_words < 50"),
    1: ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbols", "100 * n_symbols > 10 * n_words"),
    3: ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    4: ("shouting", "100 * n_upper > 50 * (n_upper + n_lower)"),
    5: ("exclamations", "100 * n_exclaim > 30 * n_words"),
    6: ("short_words", "word_chars < 2 * n_words"),
    7: ("long_words", "word_chars > 15 * n_words"),
    8: ("many_words", "n_words > 1000000"),
}
BASE_BITS = 0b11
MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclaim"]


@dataclass(frozen=True)
class Policy:
    """A version of the decision: the rules (bits) that reject a document."""

    version: str
    mask: int


STANDARD = Policy("2026-1", sum(1 << b for b in (0, 1, 2, 4, 5, 6, 7)))
STRICT = Policy("2026-1-strict", (1 << len(RULES)) - 1)


def _without(column: Column, chars: str) -> Column:
    return F.translate(column, chars, "")


def _repeat_words(marked: Column) -> Column:
    """Words covered by 3-word windows whose key occurs twice or more; marked: the sorted places of those windows."""
    step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at + 3 - acc["end"])).alias("n"), (at + 3).alias("end"))
    return F.aggregate(marked, F.struct(F.lit(0).alias("n"), F.lit(-1000000).alias("end")), step, lambda acc: acc["n"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and the measurements that the rules look at."""
    text = text_of()
    base = docs.select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        "text",
        F.array_remove(F.split(text, GAP), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # one key per 3-word window; 64 bits of hash keep the sort on numbers
    key = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    windows = F.when(F.size("words") >= 3, F.transform(F.slice("words", 1, F.size("words") - 2), key)).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("keys", windows)
    some = F.size(F.array_distinct("keys")) < F.size("keys")
    base = base.withColumn("placed", F.when(some, F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    twin = lambda x, i: (x["k"] == F.get("placed", i - 1)["k"]) | (x["k"] == F.get("placed", i + 1)["k"])
    marked = F.sort_array(F.transform(F.filter("placed", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
    base = base.withColumn("marked", marked)
    n = F.length(text)
    values = {
        "n_words": F.size("words"),
        "word_chars": F.length(_without(text, BLANKS)),
        "n_symbols": n - F.length(_without(text, SYMBOLS)),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(_repeat_words(F.col("marked")), F.lit(0)),
        "n_upper": n - F.length(_without(text, UPPER)),
        "n_lower": n - F.length(_without(text, LOWER)),
        "n_exclaim": n - F.length(_without(text, "!")),
    }
    return base.select("doc_id", "th", *(values[m].cast("long").alias(m) for m in MEASUREMENTS))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with ``fail_bits``, one bit for each failed rule."""
    bits = [F.when(F.expr(sql), F.lit(1 << b)).otherwise(F.lit(0)) for b, (_, sql) in RULES.items()]
    return measure(docs).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written once; what follows reads bits and measurements only."""
    return stored(ledger(docs), "ledger")


def fails(mask: int) -> Column:
    """Whether a row of the ledger fails a rule of the mask."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0


def apply_policy(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """kept: no rule of the policy failed; policy: its version."""
    return entries.withColumn("kept", ~fails(policy.mask)).withColumn("policy", F.lit(policy.version))


def keep(docs: DataFrame, policy: Policy = STANDARD, entries: DataFrame | None = None) -> DataFrame:
    """The documents that the policy keeps, with docs' columns; entries: their stored ledger, if there is one."""
    entries = stored_ledger(docs) if entries is None else entries
    i, t = unused(docs, "kept_doc_id"), unused(docs, "kept_th")
    kept = entries.where(~fails(policy.mask)).select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct().hint("shuffle_merge")
    same = docs["doc_id"].eqNullSafe(kept[i]) & (F.xxhash64(docs["text"]) == kept[t])
    return docs.join(kept, same, "left_semi")


def ablation(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and those kept without it.

    Counts per distinct bit pattern first, so what is shuffled is a table of
    patterns; each rule is then read off it by bitwise comparison.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")
    patterns = entries.groupBy(masked).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(name).alias("rule"), F.lit(1 << b).cast("long").alias("mask")) for b, (name, _) in RULES.items() if policy.mask >> b & 1])
    per = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("mask")) != 0
    alone = F.col("bits") == F.col("mask")
    return per.groupBy("bit", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


_MEASURED = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
tri AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM tri),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
             length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaim
      FROM w LEFT JOIN cov USING (doc_id)),
"""


def _rejects(policy: Policy) -> str:
    return " OR ".join(f"({sql})" for b, (_, sql) in RULES.items() if policy.mask >> b & 1)


def oracle_sql(policy: Policy = STANDARD, strict: Policy = STRICT) -> str:
    """The ledger and its verdicts as DuckDB SQL."""
    bits = " + ".join(f"CASE WHEN {sql} THEN {1 << b} ELSE 0 END" for b, (_, sql) in RULES.items())
    return f"""{_MEASURED}
last AS (SELECT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT ({_rejects(policy)}) AS kept,
       ({bits})::BIGINT AS fail_bits, NOT ({_rejects(strict)}) AS kept_strict
FROM m"""


def ablation_sql(policy: Policy = STANDARD) -> str:
    """The ablation as DuckDB SQL, rule by rule."""
    parts = []
    for b, (name, sql) in RULES.items():
        if policy.mask >> b & 1:
            others = _rejects(Policy("", policy.mask & ~(1 << b)))
            parts.append(f"SELECT {b} AS bit, '{name}' AS rule, count(*) FILTER (WHERE {sql})::BIGINT AS n_failed, count(*) FILTER (WHERE ({sql}) AND NOT ({others}))::BIGINT AS n_failed_alone, count(*) FILTER (WHERE NOT ({others}))::BIGINT AS n_kept_without FROM m")
    return f"{_MEASURED}\nlast AS (SELECT 1)\n" + "\nUNION ALL ".join(parts)
