from topicweave.operators import dictionaries, lineage
from topicweave.sources import files


def test_lifecycle_of_every_kind(spark, rows):
    lists = spark.createDataFrame([(0, 0, [1], [2]), (0, 1, [3], [4, 5]), (0, 2, [6, 7], [8]), (0, 3, [9, 10], [11, 12]), (0, 4, [], [13]), (0, 5, [14], []), (0, 6, [], []), (1, 0, [13], []), (1, 1, [2], [20])], "mix_period int, mix int, old array<bigint>, new array<bigint>")
    got = rows(lineage.lifecycle(lists))
    assert got == sorted([(0, 1, "inherit", 1), (1, 2, "inherit", 2), (2, 20, "inherit", 1), (0, 3, "divide", 1), (1, 8, "merge", 1), (1, 13, "isolate", 1), (0, 14, "die_out", 1)], key=repr)


def test_links_take_the_lowest_mix_on_ties_and_without_overlap(spark, rows):
    members = spark.createDataFrame([(0, 5, "a"), (0, 5, "b"), (0, 6, "z"), (1, 7, "a"), (1, 7, "a")], "period int, comm int, word string")
    mixes = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "mix_period int, mix int, word string")
    links = lineage.link_by_overlap(members, mixes)
    assert rows(links, "side", "comm", "mix", "overlap") == [("new", 7, 1, 1), ("old", 5, 1, 1), ("old", 6, 1, 0)]
    assert rows(lineage.link_by_overlap(members, mixes, False), "comm") == [(5,), (7,)]
    assert rows(lineage.mix_links(links, mixes), "mix", "old", "new") == [(1, [5, 6], [7]), (2, [], []), (3, [], [])]


def test_node_ids(spark):
    df = spark.createDataFrame([("comm3-7",), ("mix2-7.5",)], "id string")
    assert [tuple(r)[1:] for r in lineage.parse_node_id(df, "id").collect()] == [("comm", 3, 7), ("mix", 2, 7)]


def test_dictionaries(spark, rows):
    df = spark.createDataFrame([("Shelf ", ["Rack", None]), ("shelf", ["bay"]), ("lone", None), (None, ["x"])], "word string, synonyms array<string>")
    assert rows(dictionaries.merge_synonyms(df)) == [("lone", []), ("shelf", ["bay", "rack"])]
    lines = spark.createDataFrame(list(enumerate(["key", "<li>a</li>", "-", "two", "<li>b</li>", "-"])), "line int, value string")
    assert rows(dictionaries.three_line_records(lines)) == [(0, "key", "<li>a</li>"), (1, "two", "<li>b</li>")]


def test_graphml_round_trip(spark, rows, tmp_path):
    nodes = spark.createDataFrame([("comm0-1", "x", 1.0), ("mix0-1.5", "y", None)], "id string, label string, `group` double")
    edges = spark.createDataFrame([("comm0-1", "mix0-1.5", 4)], "src string, dst string, weight bigint")
    path = str(tmp_path / "g.graphml")
    files.write_graphml(nodes, edges, path)
    n, e = files.read_graphml(spark, path)
    assert {r.id: r.attributes for r in n.collect()} == {"comm0-1": {"label": "x", "group": "1.0"}, "mix0-1.5": {"label": "y"}}
    assert [tuple(r) for r in e.collect()] == [("comm0-1", "mix0-1.5", {"weight": "4"})]
    files.write_gexf(nodes, edges, str(tmp_path / "g.gexf"))
    assert "comm0-1" in (tmp_path / "g.gexf").read_text()


def test_graph_files_of_any_size_are_written_in_parts(spark, tmp_path):
    """Over a million nodes and edges in one document, which was refused."""
    from xml.etree import ElementTree as ET

    from pyspark.sql import functions as F

    nodes = spark.range(600_000).select(F.format_string("comm%d-0", "id").alias("id"), F.when(F.col("id") == 7, '<&"\n').alias("label"))
    edges = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(2).alias("weight"))
    path = str(tmp_path / "g.graphml")
    files.write_graphml(nodes, edges, path)
    n, e = files.read_graphml(spark, path)
    assert (n.count(), n.select("id").distinct().count(), e.count(), e.filter("attributes['weight'] = '2'").count()) == (600_000,) * 4
    assert [(r.id, r.attributes["label"]) for r in n.filter("size(attributes) > 0").collect()] == [("comm7-0", '<&"')]
    files.write_gexf(nodes, edges, str(tmp_path / "g.gexf"))
    root = ET.parse(tmp_path / "g.gexf").getroot()
    found = {k: root.findall(f".//{{http://www.gexf.net/1.2draft}}{k}") for k in ("node", "edge", "attvalue")}
    assert (len(found["node"]), len({x.get("id") for x in found["edge"]}), [x.get("value") for x in found["attvalue"]]) == (600_000, 600_000, ['<&"\n'])


def test_paper_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Authors,Author Full Names,Article Title,Author Keywords,Keywords Plus,Abstract,Publication Year,Publication Date,Source Title,DOI\n"A, B.",,T,"k; l",,"x ""y""\nz",2010,JAN,J,d\n\n')
    got = files.read_papers(spark, str(tmp_path / "a.csv")).collect()
    assert len(got) == 1 and got[0]["Abstract"] == 'x "y"\nz' and got[0]["Publication Year"] == 2010
