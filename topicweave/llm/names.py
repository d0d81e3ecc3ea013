"""Variant spellings of one person or organisation: merge and rematch until nothing merges.

A profile looks for the highest profile that it may be.  What may be is a matter of
a few values: surname, given name, first and middle initial.  So every key of such values keeps its highest
profile, found by aggregation, and a profile looks up the keys of all values that fit
its own.  No two profiles of a key are ever paired.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions.packed import split_packed
from topicweave.plans.stage import stage

# Common short forms of given names, words of organisations and their short forms.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "barb": "barbara", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "bob": "robert", "charlie": "charles", "chris": "christopher", "chuck": "charles", "dan": "daniel", "dave": "david", "deb": "deborah",
    "debbie": "deborah", "dick": "richard", "ed": "edward", "eddie": "edward", "fred": "frederick", "gabe": "gabriel", "greg": "gregory", "hans": "johannes",
    "harry": "henry", "jack": "john", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "kate": "katherine",
    "kathy": "katherine", "ken": "kenneth", "larry": "lawrence", "liz": "elizabeth", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "mike": "michael",
    "ned": "edward", "nick": "nicholas", "pat": "patricia", "peggy": "margaret", "pete": "peter", "ralf": "ralph", "ray": "raymond", "rob": "robert", "ron": "ronald",
    "sam": "samuel", "sandy": "alexander", "sasha": "alexander", "steve": "steven", "sue": "susan", "susie": "susan", "theo": "theodore", "tim": "timothy", "tom": "thomas",
    "tony": "anthony", "trish": "patricia", "will": "william",
}
#: Short forms of more than one given name; they stay open until other evidence decides.
OPEN_NICKNAMES = {"ted": ("edward", "theodore")}
ORGANISATION = {"laboratory", "institute", "consortium", "centre", "university", "department", "college", "school", "academy", "agency", "association", "society", "foundation", "ministry", "library"}
SHORT_FORMS = {"lab": "laboratory", "labs": "laboratory", "inst": "institute", "cons": "consortium", "consort": "consortium", "cent": "centre", "ctr": "centre", "center": "centre", "cntr": "centre", "univ": "university", "dept": "department", "assoc": "association", "soc": "society", "acad": "academy", "stud": "studies"}
FILLERS = {"the", "for", "of", "and", "in", "at"}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
FORM = "spelling string, n bigint, kind string, surname string, given string, initials string, words array<string>"


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _given(tokens: list[str]) -> tuple[str | None, str]:
    """Full given name, if any, and all initials in order."""
    initials, name = "", None
    for t in tokens:
        if len(t) == 1 or (t.isupper() and len(t) <= 3 and not any(len(x) > 3 for x in tokens)):
            initials += t.lower()
        else:
            if name is None and not initials:
                name = t.lower()
            initials += t[0].lower()
    if name:
        name = NICKNAMES.get(name, name)
        initials = name[0] + initials[1:]
    return name, initials


def parse(spelling: str) -> tuple:
    """Kind, surname (or an organisation's own name), given name (or its other words), initials, words.

    The order of a name of full words without comma is left open; its words are returned.
    """
    text = _fold(spelling)
    text = re.sub(r"\(([^)]*)\)", r" \1 " if any(w.lower() in ORGANISATION or w.lower() in SHORT_FORMS for w in _WORD.findall(text)) else " ", text)
    words = _WORD.findall(text)
    low = [SHORT_FORMS.get(w.lower(), w.lower()) for w in words]
    if len(low) > 2 and any(w in ORGANISATION for w in low):
        rest = [w for w in low if w not in FILLERS]
        at = next((i for i, w in enumerate(low) if w in ORGANISATION), 0)
        if "(" in spelling or at == 0:  # "Institute for X Studies (Name)"
            own = rest[-1]
        else:
            own = rest[0]
        other = sorted(w for w in rest if w != own)
        return "o", own, " ".join(other), "", None
    if not words:
        return "x", _fold(spelling).lower().strip(), None, "", None
    if "," in text:
        before, after = text.split(",", 1)
        name, initials = _given(_WORD.findall(after))
        surname = " ".join(w.lower() for w in _WORD.findall(before))
        if surname:
            return "p", surname, name, initials, None
    short = [w for i, w in enumerate(words) if len(w) == 1 or (w.isupper() and len(w) <= 3 and len(words) > 1 and not all(v.isupper() for v in words))]
    long = [w for w in words if w not in short]
    if short and long:
        name, initials = _given(short)
        return "p", " ".join(w.lower() for w in long), None, initials, None
    if len(words) == 1:
        return "p", words[0].lower(), None, "", None
    return "q", "", None, "", [w.lower() for w in words]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(s, n, *parse(s)) for s, n in zip(batch["spelling"], batch["n"])]
        yield pd.DataFrame(rows, columns=["spelling", "n", "kind", "surname", "given", "initials", "words"])


def _initials_of() -> dict[str, str]:
    """Initials under which a given name may stand, those of its short forms included."""
    out: dict[str, set[str]] = {}
    for short, name in [*NICKNAMES.items(), *((k, v) for k, names in OPEN_NICKNAMES.items() for v in names)]:
        out.setdefault(name, {name[0]}).add(short[0])
    for short, names in OPEN_NICKNAMES.items():
        out[short] = {short[0], *(n[0] for n in names)}
    return {k: "".join(sorted(v)) for k, v in out.items()}


def _near(a: Column, b: Column) -> Column:
    """Given names that agree up to a small slip."""
    gap = F.levenshtein(a, b, 2)
    return (a == b) | ((gap > 0) & (gap <= F.when(F.least(F.length(a), F.length(b)) >= 4, 2).otherwise(1)))


def _variants(name: Column, depth: int = 1) -> Column:
    """The name and all that it leaves when up to ``depth`` letters are lost."""
    out = F.array(name)
    for _ in range(depth):
        cut = F.flatten(F.transform(out, lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))))
        out = F.array_distinct(F.concat(out, cut))
    return out


def _similar(names: DataFrame, long_from: int, agree) -> DataFrame:
    """``(a, b)``: names that agree, each with itself; they meet under what they leave when a letter is lost, or two of names of ``long_from`` letters or more.

    As many names have a variant in common as there are ways to put the letters back, whatever the number of names.
    """
    left = names.select(F.col("name").alias("a"), F.explode(F.when(F.length("name") >= long_from, _variants(F.col("name"), 2)).otherwise(_variants(F.col("name")))).alias("v"))
    left = stage(left)
    return left.join(left.withColumnRenamed("a", "b"), "v").filter(agree(F.col("a"), F.col("b"))).select("a", "b").distinct()


def _near_surname(a: Column, b: Column) -> Column:
    """Surnames that agree up to a slip; short ones only if two neighbouring letters changed places."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    turned = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (letters(a) == letters(b))
    return (a == b) | ((F.levenshtein(a, b, 2) >= 0) & ((F.least(F.length(a), F.length(b)) >= 5) | turned))


def name_forms(papers: DataFrame, authors: str, full_names: str) -> tuple[DataFrame, DataFrame]:
    """``(forms, met)``: parsed spellings with their counts, and pairs that stand for the same author of a paper."""
    short = split_packed(papers[authors], persons=True)
    full = F.filter(F.split(F.coalesce(papers[full_names], F.lit("")), "; "), lambda x: F.trim(x) != "")
    one = lambda s, f: F.struct(s.alias("s"), f.alias("f"))
    none = F.lit(None).cast("string")
    lists = papers.select(short.alias("a"), full.alias("f"))
    entries = F.when(F.size("a") == F.size("f"), F.zip_with("a", "f", one)).otherwise(F.concat(F.transform("a", lambda x: one(x, none)), F.transform("f", lambda x: one(none, x))))
    # one pass over the papers; from here on everything is as large as the number of different spellings
    seen = stage(lists.select(F.explode_outer(entries).alias("e")).filter("e is not null").groupBy("e.s", "e.f").agg(F.count("*").alias("n")))
    spellings = seen.select(F.explode(F.array("s", "f")).alias("spelling"), "n").filter("spelling is not null").groupBy("spelling").agg(F.sum("n").alias("n"))
    # parsing is row work: spread it, however small the spellings are
    parallel = spellings.sparkSession.sparkContext.defaultParallelism
    parsed = stage(spellings.repartition(max(parallel, int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "spelling").mapInPandas(_parsed, FORM))
    known = parsed.filter("kind = 'p' and given is not null").groupBy(F.col("given").alias("token")).agg(F.sum("n").alias("times"))
    open_ = parsed.filter("kind = 'q'").select("spelling", "n", "words", F.col("words")[0].alias("first"), F.element_at("words", -1).alias("last"), F.col("words")[1].alias("second"))
    nick = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    named = lambda c: F.coalesce(nick[F.col(c)], F.col(c))
    for c in ("first", "second"):
        open_ = open_.join(known.select(F.col("token").alias("token"), F.col("times").alias(f"{c}_times")), named(c) == F.col("token"), "left").drop("token")
    front = F.coalesce("first_times", F.lit(0)) >= F.coalesce("second_times", F.lit(0))
    own = F.when(front, named("first")).otherwise(named("second"))
    rest = F.when(front, F.slice("words", 1, F.size("words") - 1)).otherwise(F.slice("words", 2, F.size("words")))
    solved = open_.select(
        "spelling", F.lit("p").alias("kind"), F.when(front, F.col("last")).otherwise(F.col("first")).alias("surname"), own.alias("given"),
        F.concat(F.substring(own, 1, 1), F.array_join(F.transform(F.slice(rest, 2, F.size("words")), lambda w: F.substring(w, 1, 1)), "")).alias("initials"), "n",
    )
    forms = parsed.filter("kind <> 'q'").drop("words").unionByName(solved)
    return stage(forms), seen.filter("s is not null and f is not null and s <> f")


def _profiles(forms: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per entity: the union of its spellings' names and initials."""
    most = lambda c: F.max_by(c, F.struct(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("n")).otherwise(-1), F.col(c)))
    return forms.join(labels, "form").groupBy("entity").agg(
        F.first("kind").alias("kind"), most("surname").alias("surname"), most("given").alias("given"), F.sum("n").alias("n"),
        F.max_by("initials", F.struct(F.length("initials"), "n", "initials")).alias("initials"),
    )


def _key(*parts) -> Column:
    return F.concat_ws("\u0001", *(F.lit(x) if isinstance(x, str) else x for x in parts))


def _letters() -> tuple[Column, Column]:
    """First and second initial; empty if unknown."""
    return F.substring(F.coalesce(F.col("given"), F.col("initials")), 1, 1), F.substring("initials", 2, 1)


def _stands(profiles: DataFrame) -> DataFrame:
    """``(key, rank)``: the highest profile under each key; ``*`` stands for any value."""
    first, middle = _letters()
    named = F.array(_key("g", F.col("surname"), F.col("given"), middle), _key("g", F.col("surname"), F.col("given"), "*"))
    person = F.array(_key("i", F.col("surname"), first, middle), _key("i", F.col("surname"), first, "*"), _key("i", F.col("surname"), "*", "*"))
    person = F.when(F.col("given").isNotNull(), F.concat(named, person)).otherwise(person)
    other = F.array(_key(F.col("kind"), F.col("surname"), F.coalesce("given", F.lit(""))))
    keys = F.when(F.col("kind") == "p", person).otherwise(other)
    return profiles.select(F.explode(keys).alias("key"), _rank().alias("rank")).groupBy("key").agg(F.max("rank").alias("rank"))


def _seeks(profiles: DataFrame, surnames: DataFrame, givens: DataFrame) -> DataFrame:
    """``(entity, rank, key)``: each profile with all keys whose profiles fit it.

    A profile with a given name seeks those with a similar one, for only these stand above it; one without
    seeks its first initial.  A known middle initial must be the same or unknown on the other side.
    """
    first, middle = _letters()
    rows = profiles.select("entity", _rank().alias("own"), "kind", F.col("surname").alias("a"), "given", first.alias("first"), middle.alias("middle"))
    with_surname = rows.filter("kind <> 'x'").join(surnames, "a").drop("a").withColumnRenamed("b", "surname").unionByName(rows.filter("kind = 'x'").withColumnRenamed("a", "surname"))
    person = with_surname.filter("kind = 'p'")
    middles = F.when(F.col("middle") == "", F.array(F.lit("*"))).otherwise(F.array(F.col("middle"), F.lit("")))
    named = person.filter("given is not null").join(givens, F.col("given") == F.col("a")).select("entity", "own", F.transform(middles, lambda m: _key("g", F.col("surname"), F.col("b"), m)).alias("keys"))
    initial = F.concat(F.transform(middles, lambda m: _key("i", F.col("surname"), F.col("first"), m)), F.array(_key("i", F.col("surname"), "", "")))
    unnamed = person.filter("given is null").select("entity", "own", F.when(F.col("first") == "", F.array(_key("i", F.col("surname"), "*", "*"))).otherwise(initial).alias("keys"))
    other = with_surname.filter("kind <> 'p'").select("entity", "own", F.array(_key(F.col("kind"), F.col("surname"), F.coalesce("given", F.lit("")))).alias("keys"))
    return named.unionByName(unnamed).unionByName(other).select("entity", "own", F.explode("keys").alias("key"))


def _rank() -> Column:
    return F.struct(F.col("given").isNotNull().alias("named"), F.col("n").alias("n"), F.col("entity").alias("entity"))


def _fits(a: str, b: str) -> Column:
    """Whether profile ``a`` may be the same as ``b``: names and initials that both have must agree."""
    c = lambda x, side: F.col(f"{side}_{x}")
    given = c("given", a).isNull() | c("given", b).isNull() | _near(c("given", a), c("given", b))
    middle = lambda s: F.substring(c("initials", s), 2, 1)
    first = lambda s: F.substring(F.coalesce(c("given", s), c("initials", s)), 1, 1)
    initials = (middle(a) == "") | (middle(b) == "") | (middle(a) == middle(b))
    same_first = (first(a) == first(b)) | (first(a) == "") | (first(b) == "")
    gap = F.levenshtein(c("surname", a), c("surname", b), 2)
    person = given & initials & same_first & (gap >= 0)
    # at one place of one paper an initial may be that of a short form
    known = F.create_map(*[F.lit(x) for kv in _initials_of().items() for x in kv])
    alias = lambda x, y: c("given", x).isNotNull() & (first(y) != "") & F.contains(known[c("given", x)], first(y)) & (c("given", y).isNull() | c("given", y).isin(*OPEN_NICKNAMES))
    person = person | (F.coalesce(F.col("aligned"), F.lit(False)) & (gap >= 0) & F.coalesce(alias(a, b) | alias(b, a), F.lit(False)))
    return F.when(c("kind", a) != c("kind", b), False).when(c("kind", a) == "p", person).otherwise((gap >= 0) & c("given", a).eqNullSafe(c("given", b)))


def link_names(papers: DataFrame, authors: str = "authors", full_names: str = "author_full_names") -> DataFrame:
    """``(spelling, entity, n)``: every spelling with the entity it names.

    Spellings are the values of the packed field ``authors`` and the entries of
    ``full_names``, separated by ``"; "``, exactly as written; null and empty fields have none.

    Spellings of equal parsed form start as one profile.  In each round every
    profile looks for those it may be: similar surname; similar given name, or the same first initial where
    it has none; the same middle initial where both are known (for organisations: similar own name, the
    same other words).  Of these it picks
    the highest: profiles with a given name stand above those without, then the ones with more occurrences.
    It merges into that one unless that one itself merges elsewhere in this round.
    Pairs that stand at the same place of a paper's two author fields are matched as well and go first.
    A merged profile unions spellings, names and initials and enters again, until nothing merges.

    An entity's number is that of one of its forms; an empty table gives no row.
    """
    forms, met = name_forms(papers, authors, full_names)
    shape = ["kind", "surname", "given", "initials"]
    known = forms.groupBy(*shape).agg(F.sum("n").alias("n"))
    known = stage(known.withColumn("form", F.xxhash64(*(F.coalesce(F.col(c), F.lit("\u0001")) for c in shape))))
    of = stage(forms.join(known.select(*shape, "form"), [forms[c].eqNullSafe(known[c]) for c in shape]).select("spelling", forms["n"].alias("n"), "form"))
    pairs = met.join(of.select(F.col("spelling").alias("s"), F.col("form").alias("form_s")), "s").join(of.select(F.col("spelling").alias("f"), F.col("form").alias("form_f")), "f")
    pairs = stage(pairs.filter("form_s <> form_f").select("form_s", "form_f").distinct())
    # profiles take their names from these forms, so what is similar is found once
    # two letters lost would bring together different surnames
    surnames = stage(_similar(known.filter("kind <> 'x'").select(F.col("surname").alias("name")).distinct(), 1 << 20, _near_surname))
    givens = stage(_similar(known.filter("kind = 'p' and given is not null").select(F.col("given").alias("name")).distinct(), 4, _near))
    labels = stage(known.select("form", F.col("form").alias("entity")))
    while True:  # every round but the last merges something
        profiles = stage(_profiles(known, labels))
        side = lambda s, df: df.select(*(F.col(c).alias(f"{s}_{c}") for c in ("entity", "kind", "surname", "given", "initials", "n")))
        rank = lambda s: F.struct(F.col(f"{s}_given").isNotNull().alias("named"), F.col(f"{s}_n").alias("n"), F.col(f"{s}_entity").alias("entity"))
        found = _seeks(profiles, surnames, givens).join(_stands(profiles), "key").filter(F.col("own") < F.col("rank"))
        found = found.select("entity", F.struct(F.lit(False).alias("aligned"), "rank").alias("by"))
        ends = pairs.join(labels.select(F.col("form").alias("form_s"), F.col("entity").alias("x")), "form_s").join(labels.select(F.col("form").alias("form_f"), F.col("entity").alias("y")), "form_f").filter("x <> y")
        both = ends.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("_e")).select(F.col("_e.a").alias("a_entity"), F.col("_e.b").alias("b_entity")).distinct()
        aligned = both.join(side("a", profiles), "a_entity").join(side("b", profiles), "b_entity").filter(rank("a") < rank("b"))
        aligned = aligned.withColumn("aligned", F.lit(True)).filter(_fits("a", "b")).select(F.col("a_entity").alias("entity"), F.struct(F.lit(True).alias("aligned"), rank("b").alias("rank")).alias("by"))
        chosen = stage(found.unionByName(aligned).groupBy("entity").agg(F.max("by").alias("by")).select("entity", F.col("by.rank.entity").alias("into")))
        if chosen.isEmpty():
            break
        # what moves itself takes nothing in: else two profiles could meet in one that has left
        chosen = chosen.join(chosen.select(F.col("entity").alias("into")), "into", "left_anti")
        labels = stage(labels.join(chosen, "entity", "left").select("form", F.coalesce("into", "entity").alias("entity")))
    return of.join(labels, "form").select("spelling", "entity", "n")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: all pairs of spellings of one entity, the smaller by code point first."""
    side = lambda c: linked.select("entity", F.col("spelling").alias(c))
    return side("name_a").join(side("name_b"), "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
