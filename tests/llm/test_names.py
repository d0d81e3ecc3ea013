import pytest

from topicweave.llm.names import link_names, parse, variant_pairs


@pytest.mark.parametrize("spelling,want", [
    ("Smith, John Paul", ("p", "smith", "john", "jp", None)),
    ("Smïth, J. P.", ("p", "smith", None, "jp", None)),
    ("J. P. Smith", ("p", "smith", None, "jp", None)),
    ("Smith J P", ("p", "smith", None, "jp", None)),
    ("Smith, JP", ("p", "smith", None, "jp", None)),
    ("SMITH, ROBERT (Bob)", ("p", "smith", "robert", "r", None)),
    ("Smith, Bob", ("p", "smith", "robert", "r", None)),
    ("John Smith", ("q", "", None, "", ["john", "smith"])),
    ("The Foo Lab. for Reader Studies", ("o", "foo", "laboratory reader studies", "", None)),
    ("Laboratory for Reader Studies (Foo)", ("o", "foo", "laboratory reader studies", "", None)),
    ("?!", ("x", "?!", None, "", None)),
])
def test_parse(spelling, want):
    got = parse(spelling)
    assert (*got[:2], " ".join(sorted(got[2].split())) if got[2] else None, *got[3:]) == (*want[:2], " ".join(sorted(want[2].split())) if want[2] else None, *want[3:])


def test_links(spark, rows):
    papers = [
        ("Brodasket, J. M.; Kolumatin, R.", "Brodasket, James Marit; Kolumatin, Robert"),
        ("J. Brodasket, R. Kolumatin", "Brodasket, James; Kolumatin, Bob"),
        ("Brodaskt, J. M.", "Brodasket, Jaems Marit"),
        ("Brodasket, J. M.; Brodasket, U.", "Brodasket, James Marit; Brodasket, Ulrike"),
        ("Kolumatin, B.", "Kolumatin, Robert"),
        ("Foo Institute for Index Studies; Bar Institute for Index Studies", "The Foo Inst. Index Studies; BAR INSTITUTE FOR INDEX STUDIES"),
        ("Vinterhal, T.", "Ted Vinterhal"), ("Vinterhal, E.", "Vinterhal, Edward"), ("Vinterhal, E.", "Vinterhal, Ted"),
        (None, None), ("", "; "), (None, "James Brodasket"),
    ]
    df = spark.createDataFrame([(i, *p, "x", 3) for i, p in enumerate(papers)], "id long, authors string, author_full_names string, spelling string, n int")
    entity = {r.spelling: r.entity for r in link_names(df).collect()}
    together = [
        {"Brodasket, J. M.", "Brodasket, James Marit", "J. Brodasket", "Brodasket, James", "Brodaskt, J. M.", "Brodasket, Jaems Marit", "James Brodasket"},
        {"Brodasket, U.", "Brodasket, Ulrike"},
        {"Kolumatin, R.", "Kolumatin, Robert", "R. Kolumatin", "Kolumatin, Bob", "Kolumatin, B."},
        {"Foo Institute for Index Studies", "The Foo Inst. Index Studies"},
        {"Bar Institute for Index Studies", "BAR INSTITUTE FOR INDEX STUDIES"},
    ]
    for group in together:
        assert len({entity[s] for s in group}) == 1, group
    assert len({entity[min(g)] for g in together}) == len(together)
    assert entity["Vinterhal, E."] == entity["Vinterhal, Edward"] == entity["Vinterhal, Ted"]
    pairs = rows(variant_pairs(link_names(df)))
    assert len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs) and ("Brodasket, U.", "Brodasket, Ulrike") in pairs


def groups_of(spark, counts):
    df = spark.createDataFrame([(None, s) for s, n in counts.items() for _ in range(n)], "authors string, author_full_names string")
    groups = {}
    for r in link_names(df).collect():
        groups.setdefault(r.entity, set()).add(r.spelling)
    return sorted(map(sorted, groups.values()))


def test_variants_beside_a_frequent_namesake(spark):
    counts = {
        "Smith, John": 100, "Smith, James": 50, "Smyth, James": 3, "Smith, Jmaes": 2, "Smith, Jasmine": 3, "Smith, Jasmien": 1,
        "Brandt, John A.": 9, "Brandt, James B.": 5, "Brandt, J. B.": 2,
        "Keller, J. B.": 9, "Keller, James B.": 5, "Keller, Jerome B.": 2, "Keller, John A.": 20,
    }
    assert groups_of(spark, counts) == sorted(map(sorted, [
        {"Smith, John"}, {"Smith, James", "Smyth, James", "Smith, Jmaes"}, {"Smith, Jasmine", "Smith, Jasmien"},
        {"Brandt, John A."}, {"Brandt, James B.", "Brandt, J. B."},
        {"Keller, John A."}, {"Keller, James B.", "Keller, J. B."}, {"Keller, Jerome B."},
    ]))


@pytest.mark.parametrize("rare,slip", [
    ("Jasmine", "Jasmien"), ("Jeremiah", "Jeremaih"), ("Jacqueline", "Jaqueline"), ("Justus", "Justsu"), ("Joachim", "Joahcim"), ("Joseph", "Josef"),
    ("Jonathan", "Jonahtan"), ("Jolanda", "Jolnada"), ("Julietta", "Juliett"), ("Jerome", "Jeromee"), ("Josefine", "Jozefime"),
])
def test_a_rare_namesake_keeps_its_variants(spark, rare, slip):
    counts = {"Meier, Jim Bob": 30, "Meier, J.": 4, f"Meier, {rare}": 3, f"Meier, {slip}": 1, "Meier, K.": 2}
    got = groups_of(spark, counts)
    assert sorted([f"Meier, {rare}", f"Meier, {slip}"]) in got and ["Meier, K."] in got


def test_short_surnames_agree_only_in_turned_letters(spark):
    counts = {"Wang, Meihua": 9, "Wnag, Meihua": 1, "Yang, Meihua": 5, "Wong, Meihua": 4}
    assert groups_of(spark, counts) == [["Wang, Meihua", "Wnag, Meihua"], ["Wong, Meihua"], ["Yang, Meihua"]]


def test_no_papers(spark):
    assert link_names(spark.createDataFrame([], "authors string, author_full_names string")).count() == 0
