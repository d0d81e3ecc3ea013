import numpy as np
import pytest

from pyspark.sql import functions as F

from topicweave.functions import text as X
from topicweave.operators import dictionaries, reports, tabular
from topicweave.operators.groups import with_stats


def test_subsequences_leave_a_short_rest_out(spark, rows):
    df = spark.createDataFrame([(1, list(range(7))), (2, [1]), (3, None)], "k int, v array<int>")
    assert rows(tabular.subsequences(df, "k", "v", 3), "k", "start", "part") == [(1, 0, [0, 1, 2]), (1, 3, [3, 4, 5])]
    assert rows(tabular.subsequences(df, "k", "v", 3, 2), "start") == [(0,), (2,), (4,)]


def test_fit_accuracy_and_codes(spark):
    df = spark.createDataFrame([("a", float(x), 2.0 * x + 1, x % 2, 1) for x in range(5)] + [("b", 1.0, 5.0, None, 1)], "g string, x double, y double, p int, l int")
    fit = {r.g: (r.slope, r.intercept) for r in tabular.linear_fit(df, "x", "y", ["g"]).collect()}
    assert fit["a"] == pytest.approx((2.0, 1.0)) and fit["b"] == (None, None)
    right = {r.g: (r.n, r.accuracy) for r in tabular.accuracy(df, F.col("p"), F.col("l"), ["g"]).collect()}
    assert right == {"a": (5, 0.4), "b": (0, None)}
    row = spark.range(1).select(tabular.one_hot(F.lit("y"), ["x", "y"]).alias("h"), tabular.one_hot(F.lit(None).cast("string"), ["x"]).alias("n"), tabular.label_name(F.lit(1), ["u", "v"]).alias("v"), tabular.label_name(F.lit(9), ["u"]).alias("o")).first()
    assert (row.h, row.n, row.v, row.o) == ([0, 1], [0], "v", None)


def test_standard_columns_and_group_figures(spark, rows):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "k int, a double, b double")
    assert rows(tabular.standard_columns(df, ["a", "b"]), "k", "a", "b") == [(1, -1.0, None), (2, 1.0, None)]
    told = with_stats(spark.createDataFrame([(None, 1), (None, 2), ("x", 5)], "g string, v int"), ["g"], total=F.sum("v"))
    assert rows(told, "v", "total") == [(1, 3), (2, 3), (5, 5)]
    assert with_stats(df.limit(0), ["k"], n=F.count("*")).count() == 0


def test_codes_padding_and_look_up(spark, rows):
    counts = spark.createDataFrame([(w, n) for w, n in (("a", 9), ("b", 5), ("c", 4))], "token string, n int")
    assert sorted(c for _, c in rows(tabular.token_codes(counts), "token", "code")) == [1, 2]
    assert [r.p for r in spark.createDataFrame([([1, 2, 3],), ([],)], "v array<int>").select(tabular.padded(F.col("v"), 2, 0).alias("p")).collect()] == [[1, 2], [0, 0]]
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<double>")
    words = spark.createDataFrame([("a",), ("z",), (None,)], "w string")
    assert {r.w: r.vector for r in tabular.looked_up(words, "w", vectors, 2).collect()} == {"a": [1.0, 2.0], "z": [0.0, 0.0], None: [0.0, 0.0]}


def test_boxes(spark):
    rng = np.random.default_rng(4)
    low = rng.random((40, 2))
    boxes = [(i % 2, i, [*map(float, l), *map(float, l + s)], float(c)) for i, (l, s, c) in enumerate(zip(low, rng.random((40, 2)), np.round(rng.random(40), 1)))]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    want = []
    for g in (0, 1):
        kept = []
        for _, i, box, _ in sorted((x for x in boxes if x[0] == g), key=lambda x: (-x[3], x[1])):
            if all(iou(box, b) <= 0.3 for b in kept):
                kept.append(box)
                want.append((g, i))
    df = spark.createDataFrame(boxes + [(0, 99, None, 1.0)], "g int, k int, box array<double>, score double")
    assert sorted((r.g, r.k) for r in tabular.kept_boxes(df, "g", "k", "box", "score", 0.3).collect()) == sorted(want)
    pair = spark.range(1).select(tabular.box_overlap(F.array(*map(F.lit, [0.0, 0.0, 2.0, 2.0])), F.array(*map(F.lit, [1.0, 1.0, 3.0, 3.0]))).alias("x"), tabular.box_overlap(F.array(*[F.lit(0.0)] * 4), F.array(*[F.lit(0.0)] * 4)).alias("y")).first()
    assert (pair.x, pair.y) == (pytest.approx(1 / 7), 0.0)


def test_dictionary_layouts(spark, rows):
    lines = spark.createDataFrame([("a,b,c",), ("d",), ("",), (None,)], "value string")
    assert rows(dictionaries.keyed_lines(lines)) == [("a", ["b", "c"]), ("d", [])]
    listed = spark.createDataFrame([("w", '"x, y"', None), ("v", None, None)], "c0 string, c1 string, c2 string")
    assert rows(dictionaries.listed_columns(listed, "c0", "c1", "c2")) == [("v", []), ("w", ["x", "y"])]
    assert rows(dictionaries.delimited_terms(lines, ","), "word") == [("a",), ("b",), ("c",), ("d",)]
    doc = '{"document.xml": [{"c": [{}, {"c": [{"c": "Head"}, {"c": " -term,"}, {"c": ""}, {"x": 1}]}]}]}'
    docs = spark.createDataFrame([(doc,), ("{}",), ("broken",), (None,)], "d string")
    assert rows(dictionaries.nested_terms(docs, "d", "$['document.xml'][0].c[1].c", skip=1, edges=" ,-"), "word") == [("term",)]
    words = spark.createDataFrame([("a",), ("b",)], "w string")
    assert rows(dictionaries.patched(words, "w", ["a"], ["z"])) == [("b",), ("z",)] and rows(dictionaries.patched(words, "w", [], [])) == [("a",), ("b",)]


def test_inverted_index_with_default(spark):
    phrases = spark.createDataFrame([("big_data",), ("data_base",), ("data_base",), ("a_a",)], "p string")
    index = dictionaries.inverted_index(phrases, "p")
    assert {r.word: r.phrases for r in index.collect()} == {"big": ["big_data"], "data": ["big_data", "data_base"], "base": ["data_base"], "a": ["a_a"]}
    tokens = spark.createDataFrame([("data",), ("none",), (None,)], "t string")
    assert {r.t: r.phrases for r in dictionaries.phrases_of(tokens, "t", index).collect()} == {"data": ["big_data", "data_base"], "none": [], None: []}


@pytest.mark.parametrize("text,phrases,want", [
    ("use C++ code here", ["c++_code"], "use c++_code here"),
    ("a b a b ab", ["a_b"], "a_b a_b ab"),
    ("web 2.0 tools and web 210 tools", ["web_2.0_tools"], "web_2.0_tools and web 210 tools"),
    ("price is $5 only", ["$5_only"], "price is $5_only"),
    ("back\\slash E q", ["back\\slash_e"], "back\\slash_e q"),
    ("one two three", ["two_three", "one_two_three"], "one_two_three"),
    ("nothing", ["nothing"], "nothing"),
])
def test_phrases_with_marks_and_digits(spark, text, phrases, want):
    row = spark.createDataFrame([(text, phrases)], "t string, p array<string>").select(X.merge_phrases(F.col("t"), F.col("p")).alias("m")).first()
    assert row.m.lower() == want


def test_sets_within_sets(spark, rows):
    sets = spark.createDataFrame([(1, list("ab")), (2, list("abc")), (3, list("ba")), (4, list("xd")), (5, []), (6, None)], "k int, v array<string>")
    assert rows(reports.covered_sets(sets, "k", "v")) == [(1, 2), (3, 1), (3, 2)]


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from topicweave.plans import stage

    class Elsewhere:
        conf = type("c", (), {"get": lambda *_: None})()
        sparkContext = type("s", (), {"getConf": lambda s: type("c", (), {"get": lambda *_: None})(), "_jsc": type("j", (), {"sc": lambda s: type("x", (), {"getCheckpointDir": lambda s: type("o", (), {"isDefined": lambda s: False})()})()})(), "master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        stage.shared_folder(Elsewhere())
