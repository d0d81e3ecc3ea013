"""Column expressions that take packed fields apart.

A packed field holds several values in one string: ``a; "b; c" | d``.  The
split is a fold over the pieces between quote characters: pieces with an odd
index stood inside quotes and are literals, pieces with an even index are
outside and are cut at delimiters.  Everything here is a JVM expression; no
row is shipped to Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a recognised separator while a value is put together again.
CUT = "\u0001"

#: Separators of any packed field.  A slash separates only with
#: blanks on both sides, as does a hyphen.
TERM_SEPARATORS = r"[;；|\n\r\t·、]|(?i:<br\s*/?>)|\s/\s|\s-\s"
#: Names may also be joined by "and" or "&".
PERSON_SEPARATORS = TERM_SEPARATORS + r"|\s(?i:and)\s|\s&\s"

_BLANK = r"[\s\u00a0\u3000]"
_BLANKS = " \t\n\r\f\v\u00a0\u3000"


def trim_blanks(c: Column) -> Column:
    """Trim every kind of blank at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _person_cut(outside: Column) -> Column:
    """Cut the commas between persons, never those inside one name.

    The commas separate if every part is a whole name (two words or more, not
    only initials); if surnames and given names alternate, every second comma
    does; otherwise the text is a single ``Surname, Given``.
    """
    parts = F.split(outside, ",")
    filled = F.filter(parts, lambda p: F.length(F.trim(p)) > 0)
    whole = lambda p: p.rlike(r"^\s*\S+\s+\S") & ~p.rlike(r"^\s*(\p{Lu}\.?[\s-]*)+$")
    given = lambda p: p.rlike(r"^\s*((\p{Lu}\.?[\s-]*)+|\S+)\s*$")
    n = F.size(filled)
    alternate = (n >= 4) & (n % 2 == 0) & F.forall(filled, given)
    return (
        F.when((n >= 2) & F.forall(filled, whole), F.regexp_replace(outside, ",", CUT))
        .when(alternate, F.regexp_replace(outside, r"([^,]*,[^,]*),", "$1" + CUT))
        .otherwise(outside)
    )


def split_packed(value: Column, persons: bool = False) -> Column:
    """Array of the values packed in one field, in order, empty ones left out.

    Null gives an empty array.  A doubled quote inside a quoted value stands for
    one quote; a quote without a partner is an ordinary character.  In
    ``['a', 'b']`` the brackets go and the single quotes are quote characters.
    A comma separates only where nothing else outside quotes does.
    """
    text = trim_blanks(F.translate(F.coalesce(value, F.lit("")), CUT, " "))
    quoted = lambda t: F.contains(t, F.lit('"')) | F.startswith(t, F.lit("["))
    cut = _let(text, lambda t: F.when(quoted(t), _listed(t, persons)).otherwise(_plain(t, persons)))
    return F.filter(F.transform(F.split(cut, CUT), _unwrap), lambda x: x != "")


def _plain(text: Column, persons: bool) -> Column:
    """Separators of a field without quotes as ``CUT``."""
    comma = _person_cut(text) if persons else F.translate(text, ",", CUT)
    return _let(
        F.regexp_replace(text, PERSON_SEPARATORS if persons else TERM_SEPARATORS, CUT),
        lambda t: F.when(F.contains(t, F.lit(CUT)), t).otherwise(comma),
    )


def _listed(text: Column, persons: bool) -> Column:
    """Separators of a field with quotes, or of a bracketed list, as ``CUT``."""
    inner = trim_blanks(F.regexp_replace(text, r"(?s)^\[(.*)\]$", "$1"))
    single = text.rlike(r"(?s)^\[\s*'.*\]$")
    double = F.contains(text, F.lit('"'))
    whole_list = text.rlike(r"(?s)^\[\s*['\"].*\]$")
    fold = lambda body, mark: _let(F.split(body, mark), lambda pieces: _fold(pieces, mark, persons))
    return F.when(single, fold(inner, "'")).when(whole_list, fold(inner, '"')).when(double, fold(text, '"')).otherwise(_plain(text, persons))


def _fold(pieces: Column, mark: str, persons: bool) -> Column:
    """The pieces between quote characters put together, separators outside as ``CUT``."""
    last = F.size(pieces) - 1
    torn = last % 2 == 1  # an odd number of quote characters: the last one has no partner

    def joined(cut) -> Column:
        def piece(p: Column, i: Column) -> Column:
            literal = (i % 2 == 1) & ~(torn & (i == last))
            doubled = (i % 2 == 0) & (i > 0) & (i < last) & (p == "")
            loose = torn & (i == last)
            return F.when(literal, p).when(doubled, F.lit(mark)).when(loose, F.concat(F.lit(mark), cut(p))).otherwise(cut(p))

        return F.array_join(F.transform(pieces, piece), "")

    def comma(p: Column) -> Column:
        # between quoted names every comma separates; a torn quote quotes nothing
        return F.when(last == 1, _person_cut(p)).otherwise(F.translate(p, ",", CUT)) if persons else F.translate(p, ",", CUT)

    strong = joined(lambda p: F.regexp_replace(p, PERSON_SEPARATORS if persons else TERM_SEPARATORS, CUT))
    return _let(strong, lambda t: F.when(F.contains(t, F.lit(CUT)), t).otherwise(joined(comma)))


def _unwrap(item: Column) -> Column:
    bare = lambda x: F.when(x.rlike(r"^(\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\})$"), trim_blanks(F.regexp_replace(x, r"^.|.$", ""))).otherwise(x)
    return _let(trim_blanks(item), lambda x: F.when(F.substring(x, 1, 1).isin("[", "(", "{"), bare(x)).otherwise(x))


def normal_term(item: Column) -> Column:
    """Lower case, ``_`` and ``-`` as blanks, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(item), "_-", "  "), rf"{_BLANK}+", " "))
