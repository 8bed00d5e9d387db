"""Column expressions over note text: parsing, links, summaries, scrubbing, citations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_CHARS = 300
EMBED_BYTES = 1500
# Shapes of credentials, and words without weight.
SECRET_PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[po]_[A-Za-z0-9]{36,}",
    r"sk-ant-api[A-Za-z0-9_-]{20,}",
    r"sk_(?:live|test)_[A-Za-z0-9]{20,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"cfpat-[A-Za-z0-9_-]{20,}",
    r"Bearer\s+[A-Za-z0-9._\-/+=]{20,}",
)
STOPWORDS = tuple(
    (
        "a an the is are was were be been being do does did have has had i you we they should would could will shall may might can "
        "in on at to for of with by from as and or but not no so if than then when how what why which where who whose whom "
        "me my mine your yours our ours their theirs this that these those it its"
    ).split()
)


def title_from_path(path: Column) -> Column:
    """File name without its suffix, hyphens as blanks."""
    return F.replace(basename(path), F.lit("-"), F.lit(" "))


def basename(path: Column) -> Column:
    """Last path segment without .md."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def top_folder(path: Column) -> Column:
    """First path segment, empty for a file at the top."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")


def frontmatter(raw: Column) -> Column:
    """The block between a leading '---' line and the next; empty if there is none."""
    return F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---", 1)


def body_of(raw: Column) -> Column:
    """Text without its frontmatter and white space around."""
    return F.regexp_replace(F.regexp_replace(raw, r"(?s)\A---\n.*?\n---", ""), r"(?s)\A\s+|\s+\z", "")


def inline_tags(front: Column) -> Column:
    """Entries of the first inline list 'tags: [a, b]'; block lists are not read."""
    listed = F.regexp_extract(front, r"(?m)^tags:[ \t]*\[([^\]\n]*)\]", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")


def wikilinks(body: Column) -> Column:
    """Link targets before '|' and '#', trimmed, in lower case, each once in order."""
    inner = F.regexp_extract_all(body, F.lit(r"\[\[([^\]]*)\]\]"), 1)
    names = F.transform(inner, lambda x: F.lower(F.trim(F.regexp_extract(x, r"^([^|#]*)", 1))))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def clean_links(body: Column) -> Column:
    """Links replaced by their alias, or else by their inner text."""
    return F.regexp_replace(F.regexp_replace(body, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]]*)\]\]", "$1")


def embedding_text(title: Column, body: Column, tags: Column) -> Column:
    """Title, body and tags, cut at 1500 bytes on a character boundary."""
    shown = F.when(F.size(tags) > 0, F.concat(F.lit("\n\nTags: "), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "))).otherwise("")
    return utf8_cut(F.concat(F.lit("Title: "), title, F.lit("\n\n"), body, shown), EMBED_BYTES)


def utf8_cut(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within so many bytes."""
    raw = F.encode(text, "UTF-8")
    # a byte 10xxxxxx continues a character: step back to where the first one left out begins
    back = F.lit(0)
    inside = lambda k: F.substring(F.hex(F.substring(raw, most + 1 - k, 1)), 1, 1).isin("8", "9", "A", "B")
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(F.octet_length(raw) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(most) - back), "UTF-8"))


def content_hash(text: Column) -> Column:
    """First 32 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def summarize(body: Column, most: int = SUMMARY_CHARS) -> Column:
    """First paragraph; a long one is cut at its last blank within the limit and marked."""
    first = F.trim(F.element_at(F.split(F.trim(body), "\n\n"), 1))
    cut = F.substring(first, 1, most)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.regexp_replace(cut, r"(?s) [^ ]*$", ""), F.lit("...")))


def scrub_secrets(text: Column, patterns: tuple[str, ...] = SECRET_PATTERNS, mark: str = "[REDACTED]") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, mark)
    return text


def pattern_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct words in lower case without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s-]", " ")), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords)))


def normalise_query(text: Column) -> Column:
    return F.lower(F.trim(text))


# How numbers that make a claim are written.
NUMBER_PATTERNS = (
    r"(?i)\b(?:OR|HR|RR|IRR|AOR)\s*(?:=\s*)?(\d+\.?\d*)",
    r"(?i)\b(?:d|g|Cohen['’]?s?\s*d)\s*=?\s*(\d+\.?\d*)",
    r"\b(\d+\.?\d*)\s*%",
    r"(?i)\bn\s*=\s*(\d+)",
    r"(?i)\b(\d+)\s+(?:patients?|participants?|subjects?|studies)",
    r"(?i)\bp\s*[<>=]\s*(0?\.\d+)",
    r"(?i)\b(\d+\.?\d*)\s*(?:mg|mcg|µg|ml|mg/L|ng/mL)",
    r"(?i)\b(\d+\.?\d*)-fold",
    r"(?i)\b(\d+\.?\d*)\s*(?:ms|seconds?|minutes?|hours?|days?|weeks?|months?)\b",
)


def ascii_edges(pattern: str) -> str:
    """The pattern with words and blanks of ASCII, as RE2 and JavaScript tell words: to Java's own word edges 'ñ' and 'or' are one word.

    An edge at the end of the pattern, of an alternative or of a group ends a
    word there; others begin one.
    """
    ends = re.sub(r"\\b(?=$|[|)])", lambda m: "(?![0-9A-Za-z_])", pattern)
    return ends.replace(r"\b", "(?<![0-9A-Za-z_])").replace(r"\s", r"[\t\n\f\r ]").replace("(?i)", "(?iu)")


def numbers(text: Column) -> Column:
    """Distinct numbers that make a claim: effect sizes, shares, samples, doses, times."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(ascii_edges(p)), 1) for p in NUMBER_PATTERNS]))


def number_claims(claims: Column, source: Column) -> Column:
    """Each number of the claims, whether the source has it, and the words around it there."""
    quoted = lambda n: F.concat(F.lit(r"(?i)(.{0,60}\Q"), n, F.lit(r"\E.{0,60})"))
    return F.transform(numbers(claims), lambda n: F.struct(n.alias("number"), F.contains(source, n).alias("found"), F.trim(F.regexp_substr(source, quoted(n))).alias("excerpt")))


def truncate_at_sentence(text: Column, tokens: int) -> Column:
    """Cut at four characters a token: after the last sentence end within reach, else at the last blank."""
    most = tokens * 4
    cut = F.substring(text, 1, most)
    sentence = F.regexp_extract(cut, r"(?s)^(.*[.!?])\s", 1)
    return F.when(F.length(text) <= most, text).when(sentence != "", sentence).otherwise(F.regexp_replace(cut, r"(?s)\s\S*$", ""))


# Study designs by words of an abstract, strongest first; species; sizes.
STUDY_TYPES = (
    ("meta-analysis", r"meta-analysis|meta analysis"),
    ("systematic-review", r"systematic review"),
    ("RCT", r"randomized|randomised"),
    ("RCT", r"double-blind|placebo-controlled"),
    ("crossover-RCT", r"crossover|cross-over"),
    ("open-label", r"open-label"),
    ("cohort", r"cohort study|prospective study"),
    ("in-vitro", r"in vitro|cell culture"),
)
PUBLICATION_TYPES = (
    ("meta-analysis", "meta-analysis"),
    ("systematic-review", "systematic review"),
    ("review", "review"),
    ("RCT", "randomized controlled trial"),
    ("clinical-trial", "clinical trial"),
    ("case-report", "case report"),
)
HUMAN = r"\b(?:patients?|participants?|subjects?|volunteers?|adults?|men|women|children|humans?)\b"
RODENT = r"\b(?:mice|mouse|rats?|rodent|murine)\b"
CELLS = r"\b(?:in vitro|cell line|cell culture|hela|hek293)\b"
ANIMAL = r"\b(?:drosophila|zebrafish|c\. elegans|primate)\b"
SAMPLE = (r"\bn\s*=\s*(\d+)", r"(\d+)\s+(?:participants?|subjects?|patients?|volunteers?|adults?)")


def study_type(text: Column, types: Column | None = None) -> Column:
    """The study's design: by its publication types (array) if they tell, else the first match in its abstract."""
    t = F.lower(text)
    by_type = [F.when(F.exists(types, lambda x, k=k: F.contains(F.lower(x), F.lit(k))), F.lit(name)) for name, k in PUBLICATION_TYPES] if types is not None else []
    return F.coalesce(*by_type, *[F.when(t.rlike(p), F.lit(name)) for name, p in STUDY_TYPES], F.lit("unknown"))


def species(text: Column) -> Column:
    t = F.lower(text)
    human, rodent, cells, animal = (t.rlike(ascii_edges(p)) for p in (HUMAN, RODENT, CELLS, ANIMAL))
    return F.when(human & rodent, "human+animal").when(human, "human").when(rodent, "animal").when(cells, "in-vitro").when(animal, "animal").otherwise("unknown")


def sample_size(text: Column) -> Column:
    """The number after 'n =', else before a word for participants; null without either."""
    found = [F.regexp_extract(F.lower(text), ascii_edges(p), 1) for p in SAMPLE]
    return F.coalesce(*[F.when(x != "", x.try_cast("long")) for x in found])


def source_ids(text: Column) -> Column:
    """Identifiers of publications named in a text, as kind:id, each once, sorted."""
    kinds = {"pmid": r"(?i)(?:\bPMID:?\s*|\bPubMed\s+|pubmed\.ncbi\.nlm\.nih\.gov/)(\d{4,9})\b", "pmc": r"(?i)\b(PMC\d{4,9})\b", "doi": r"(?i)\bdoi\.org/(10\.\d{4,9}/[^\s)\]>\"',;]+)", "arxiv": r"(?i)\barxiv[:/ ]\s*(?:abs/)?(\d{4}\.\d{4,5})\b", "rfc": r"(?i)\bRFC\s?(\d{1,5})\b", "isbn": r"(?i)\bISBN[:\s-]*([0-9][0-9-]{8,15}[0-9X])"}
    named = lambda kind: lambda x: F.concat(F.lit(kind + ":"), F.lower(x))
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), 1), named(k)) for k, p in kinds.items()]
    return F.array_sort(F.array_distinct(F.concat(*found)))


#: Who is said to have written a source, and when: 'Smith 2001', 'Smith et al. (2001', 'Smith-Lee & Jones, 2001'.
_SURNAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
CLAIM = rf"({_SURNAME}(?:\s+(?:et\s+al\.?|&\s+{_SURNAME}))*)\s*[(,]?\s*((?:19|20)\d{{2}})"


def claimed_sources(text: Column) -> Column:
    """Each identifier of ``source_ids`` with the author and year claimed for it: by its link's text, else within 100 characters before it."""

    def claim(found: Column) -> Column:
        raw = F.concat(F.lit(r"\Q"), F.substring_index(found, ":", -1), F.lit(r"\E"))
        label = F.get(F.regexp_extract_all(text, F.concat(F.lit(r"(?is)\[([^\]\[]+)\]\([^)]*"), raw), 1), 0)
        before = F.coalesce(F.get(F.regexp_extract_all(text, F.concat(F.lit("(?is)(.{0,100})"), raw), 1), 0), F.lit(""))
        place = F.when(F.coalesce(label.rlike(CLAIM), F.lit(False)), label).otherwise(before)
        author, year = (F.nullif(F.regexp_extract(place, CLAIM, i), F.lit("")) for i in (1, 2))
        return F.struct(found.alias("id"), author.alias("author"), year.cast("int").alias("year"))

    return F.transform(source_ids(text), claim)


def topic_keywords(text: Column, most: int = 4, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """First words of the first heading that are no stop words."""
    heading = F.regexp_extract(text, r"(?m)^# (.*)$", 1)
    words = F.split(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N} ]+", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords)), 1, most)


def n_sentences(text: Column) -> Column:
    """Sentence ends outside code blocks and links."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"\[\[[^\]]*\]\]", "")
    return F.regexp_count(plain, F.lit(r"[.!?]+(?:\s|$)"))


def edit_status(before: Column, after: Column, warn: float = 0.2, reject: float = 0.5) -> Column:
    """How much the number of sentences changed: accept, warn or auto-reject."""
    share = F.abs(n_sentences(after) - n_sentences(before)) / F.greatest(n_sentences(before), F.lit(1))
    return F.when(share > reject, "auto-reject").when(share > warn, "warn").otherwise("accept")


def classify_folder(path: Column) -> Column:
    """Kind of note by its top folder."""
    top = F.lower(F.regexp_replace(top_folder(path), r"^[0-9]+-", ""))
    return F.when(top.isin("inbox", "fleeting", "literature", "permanent", "maps", "projects"), top).otherwise("other")


def semver_at_least(found: Column, wanted: Column) -> Column:
    """Only constraints of the form >=x.y.z are understood; all others pass."""
    parts = lambda c: F.transform(F.split(F.regexp_extract(c, r"(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.cast("int"))
    return F.when(wanted.rlike(r"^>=\d+\.\d+\.\d+$"), parts(found) >= parts(wanted)).otherwise(True)


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob under which '*' also crosses '/'."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern[i] == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out += ".*"
        else:
            out, i = out + ("." if pattern[i] == "?" else "\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] not in "_/" else pattern[i]), i + 1
    return f"^{out}$"


def visibility(path: Column, front_tier: Column, rules: list[tuple[str, str]], default: str = "private") -> Column:
    """A valid tier in the frontmatter, else that of the last glob rule that matches, else the default."""
    tiers = ("public", "listed", "private")
    return F.when(front_tier.isin(*tiers), front_tier).otherwise(F.coalesce(*[F.when(path.rlike(glob_regex(g)), F.lit(t)) for g, t in reversed(rules)], F.lit(default)))
