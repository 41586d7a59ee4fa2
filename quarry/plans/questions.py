"""Questions: routing, pronoun rewriting, intents, file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the routes, in order.
CASUAL = (
    "whats up", "what's up", "whats new", "what's new",
    "how are you", "how are ya", "how's it going", "hows it going",
    "how is it going", "how are things", "whats going on", "what's going on",
)
GREETING_WORDS = (
    "hi", "hello", "hey", "howdy", "hiya", "sup",
    "thanks", "thank", "thx", "ty",
    "bye", "goodbye", "cya", "later",
    "ok", "okay", "cool", "nice", "great",
    "good morning", "good afternoon", "good evening", "good night",
    "you", "yo", "there", "morning", "afternoon", "evening",
)
GENERAL = (
    r"^what can you do",
    r"^what do you do",
    r"^how do(?:es)? (?:this|you) work",
    r"^what are you",
    r"^who are you",
    r"^help$",
    r"^what (?:are )?your (?:capabilities|features|functions)",
    r"^how (?:can|do) (?:i|we) use (?:this|you)",
    r"^what (?:is|are) (?:this|you) (?:for|about)",
    r"^tell me about yourself",
)
VALUE_SEEKING = (
    r"\b(?:total(?: value| amount| cost| price)?|sum|how much|grand total|amount due|"
    r"overall (?:value|amount|cost)|add(?:ed)? up|tally|breakdown of (?:costs?|amounts?|values?))\b"
)
LISTING = (
    r"^(?:list|show|display|give me|get)(?: me)? (?:all|every|the) (?:documents?|files?|indexed)\s*$",
    r"^what (?:documents?|files?) (?:do )?(?:we|i|you) have\s*$",
    r"^what(?:'s| is| are) indexed",
    r"^show (?:me )?(?:all|everything|the files?|the documents?)\s*$",
    r"^list (?:all|everything|documents?|files?)\s*$",
    r"^what(?:'s| is) (?:in )?(?:the|my|our) (?:directory|folder|workspace|index)",
    r"^overview of (?:(?:all|our|my|the) )?(?:files?|documents?)",
    r"^describe (?:(?:all|our|my|the) )?(?:files?|documents?)\s*$",
    r"^(?:how many|total(?: number of)?) (?:files?|documents?) (?:do )?(?:we|i) have",
    r"how many [\w\s]+ (?:do (?:we|i) have|are (?:there|in (?:our|my|the) (?:folder|files?|index))|exist)",
    r"^(?:count|total(?: number of)?|give me (?:a )?count of) [\w\s]+$",
    r"^what (?:are|were) (?:all )?(?:our|the|my)(?: the)? [\w ]+$",
    r"^what [\w ]+ do (?:we|i) have\s*$",
    r"^(?:show|give)(?: me)?(?: all)? (?:our|the|my|all(?: (?:our|the|my))?) [\w ]+$",
)
AGGREGATION = (
    r"total\s+(value\s+)?of\s+(all\s+)?",
    r"sum\s+of\s+(all\s+)?",
    r"list\s+all\s+",
    r"(total|combined|aggregate|overall)\s+(value|amount|cost|sum)",
    r"add\s+(up|together)\s+all",
)
PRONOUNS = (r"\bthis document\b", r"\bthat document\b", r"\bthis file\b", r"\bthat file\b", r"\bthe document\b", r"\bthe file\b", r"\bit\b", r"\bthat\b", r"\bthis\b")
FILE_NAME = r"(?i)\b([A-Za-z][A-Za-z0-9_.-]+\.(?:pdf|docx|txt|xlsx|xls|pptx))\b"
REWRITE_LENGTH, IT_TOKENS, GREETING_TOKENS = 160, 8, 4


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def normal(question: Column) -> Column:
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.lower(trim(F.regexp_replace(trim(F.coalesce(question, F.lit(""))), r"[?!.,]+$", "")))


def route(question: Column) -> Column:
    """greeting, general, document_listing or document_search."""
    q = normal(question)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    greeting = q.isin(*CASUAL) | ((F.size(words) <= GREETING_TOKENS) & (F.forall(words, lambda w: w.isin(*GREETING_WORDS)) | q.isin(*GREETING_WORDS)))
    listing = q.rlike(any_of(LISTING)) & ~q.rlike(VALUE_SEEKING)
    return F.when((q == "") | greeting, "greeting").when(q.rlike(any_of(GENERAL)), "general").when(listing, "document_listing").otherwise("document_search")


def is_aggregation(question: Column) -> Column:
    return F.lower(F.trim(F.coalesce(question, F.lit("")))).rlike(any_of(AGGREGATION))


def rewritten(question: Column, file_name: Column) -> Column:
    """The question with the first phrase of the most specific kind that points at the last document replaced by its name."""
    q = F.trim(question)
    low = F.lower(q)
    pointing = low.rlike(r"\b(that|this|it)\b") | low.contains("document") | low.contains("file")
    usable = (q != "") & (F.length(q) <= REWRITE_LENGTH) & (F.coalesce(file_name, F.lit("")) != "") & ~low.contains(F.lower(file_name)) & pointing
    short = F.size(F.split(q, r"\s+")) <= IT_TOKENS
    out = question
    for p in reversed(PRONOUNS):
        on = question.rlike(f"(?i){p}") & (short if p == r"\bit\b" else F.lit(True))
        head = F.regexp_extract(question, f"(?is)^(.*?){p}", 1)
        tail = F.regexp_extract(question, f"(?is)^.*?{p}(.*)$", 1)
        out = F.when(on, F.concat(head, file_name, tail)).otherwise(out)
    return F.when(F.coalesce(usable, F.lit(False)), out).otherwise(question)


def explicit_file(question: Column) -> Column:
    """A quoted name, else a name with a known extension, else null."""
    quoted, named = F.regexp_extract(question, r'"([^"]+)"', 1), F.regexp_extract(question, FILE_NAME, 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(named, F.lit("")))


def category_pattern(category: str) -> str:
    """Words of a category joined by blanks or hyphens, plural allowed."""
    words = re.sub(r"[-\s]+", " ", category).lower().split()
    return r"\b" + r"[\s\-]+".join([*map(re.escape, words[:-1]), re.escape(words[-1]) + "s?"]) + r"\b"


def categories(question: Column, taxonomy: list[str]) -> Column:
    """Sorted categories of the taxonomy that a question names; null without any."""
    names = sorted({t.strip().upper() for t in taxonomy if re.sub(r"[-\s]+", "", t)})
    found = F.filter(F.array(*[F.when(question.rlike(f"(?i){category_pattern(t)}"), F.lit(t)) for t in names]).cast("array<string>"), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def category_label(found: Column) -> Column:
    return F.array_join(F.transform(found, F.lower), " or ")
