"""Token and phrase expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_shape(token: Column) -> Column:
    """Letters, with ``_`` only or ``.`` only; neither mark alone."""
    return token.rlike(r"^(\p{L}|_)+$|^(\p{L}|\.)+$") & token.rlike(r"\p{L}")


def ascii_only(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def spaced(word: Column) -> Column:
    return F.replace(word, F.lit("_"), F.lit(" "))


def phrase(words: Column, lemmas: bool = False) -> Column:
    """Words of a keyword as one ``_``-joined phrase of lower-cased shaped tokens, in the singular with ``lemmas``; null if none is left."""
    kept = F.filter(F.split(F.lower(words), r"[\s_]+"), word_shape)
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lemma) if lemmas else kept, "_"))


def lemma(word: Column) -> Column:
    """Rule-based singular of a lower-cased noun; an approximation, no language model is at hand."""
    return (
        F.when(word.rlike("(ss|us|is)$"), word)
        .when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(F.length(word) > 3, F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def sentences(joined: Column) -> Column:
    """``a;b;#;c`` as an array of token arrays; empty tokens and sentences are left out."""
    parts = F.split(F.coalesce(joined, F.lit("")), r"(^|;)#(;|$)")
    return F.filter(F.transform(parts, lambda s: F.filter(F.split(s, ";"), lambda t: t != "")), lambda s: F.size(s) > 0)


def merge_phrases(text: Column, phrases: Column) -> Column:
    """Phrases of ``_``-joined words in ``text`` joined likewise: longest first, ignoring case, where no letter, digit or ``_`` stands next to them.  Marks in a phrase stand for themselves."""
    ordered = F.array_sort(phrases, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    literal = lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    plain = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")  # in the replacement these have a meaning
    join = lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), literal(F.replace(p, F.lit("_"), F.lit(" "))), F.lit(r"(?![\p{L}\p{N}_])")), plain(p))
    # a phrase that isn't in the text needs no pattern
    low = F.lower(text)
    there = F.filter(ordered, lambda p: F.contains(p, F.lit("_")) & F.contains(low, F.lower(F.replace(p, F.lit("_"), F.lit(" ")))))
    return F.aggregate(there, text, join)


def abbreviation_parts(term: Column) -> Column:
    """``Full Name FN`` as ``[Full Name, FN]`` where the last word is the capital initials of the others; else the term alone."""
    words = F.split(F.trim(term), r"\s+")
    head = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))
    initials = F.upper(F.array_join(F.transform(head, lambda w: F.substring(w, 1, 1)), ""))
    last = F.element_at(words, -1)
    return F.when((F.size(words) > 2) & (last == initials), F.array(F.array_join(head, " "), last)).otherwise(F.array(F.trim(term)))


def html_fields(html: Column, tag: str) -> Column:
    """Inner texts of all elements ``tag``, inner tags removed, blanks trimmed."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
