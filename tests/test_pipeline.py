from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from topicweave.operators.embeddings import graph_vectors
from topicweave.plans import pipeline
from topicweave.plans.stage import materialise, shared_folder, stage

WORD = "paper_id long, keyword_plus string, title_abstract string, publication_year int"
GROUPS = [["alpha_one", "beta_two", "gamma"], ["delta", "epsilon", "zeta"]]


def papers():
    out = []
    for k in range(60):
        words = GROUPS[k % 2]
        text = ";".join(w.replace("_", ";") for w in words) + ";#;" + ";".join(w.replace("_", ";") for w in reversed(words))
        out.append((k, ";".join(words), text, 201001 + k // 20))
    return out + [(100, None, None, 201001), (101, "lonely", "", None), papers_row_again(out)]


def papers_row_again(out):
    return out[0]


def test_two_topics_inherit(spark):
    words = spark.createDataFrame(papers(), WORD)
    bounds = spark.createDataFrame([(0, 201001, 201002), (1, 201002, 201003), (2, 201003, 201004)], "period int, lo int, hi int")
    out = pipeline.trace(words, bounds)
    every = {w for g in GROUPS for w in g}
    edges = out["edges"].filter("graph_id = -1").collect()
    assert {e.src for e in edges} | {e.dst for e in edges} <= every
    assert all(any({e.src, e.dst} <= set(g) for g in GROUPS) for e in edges)
    events = {(r.period, r.event) for r in out["events"].collect()}
    assert events == {(0, "inherit"), (1, "inherit"), (2, "inherit")}
    core = out["core"].filter("graph_id = 0").collect()
    assert len({r.comm for r in core}) == 2


def test_node2vec_compares_all_words_of_a_graph(spark, monkeypatch):
    links = [(k, chr(97 + k), chr(98 + k), 1.0) for k in range(5)]
    edges = spark.createDataFrame(links, "paper_id long, src string, dst string, weight double")
    monkeypatch.setattr(pipeline, "keyword_edges", lambda tokens, keys: edges)
    monkeypatch.setattr(pipeline.embeddings, "word_vectors", lambda s, c, **how: s.select(F.explode(c).alias("word")).distinct().withColumn("vector", F.array(F.lit(1.0))))
    words = spark.createDataFrame([(k, "a", "a", 201001) for k in range(5)], WORD)
    bounds = spark.createDataFrame([(0, 201001, 201002)], "period int, lo int, hi int")
    found = {(r.src, r.dst) for r in pipeline.period_graphs(words, bounds, "node2vec").filter("graph_id = 0").collect()}
    assert found == {(a, b) for a in "abcdef" for b in "abcdef" if a < b}


def test_word2vec_fits_each_graph_on_its_own_texts(spark, monkeypatch):
    fitted = []

    def vectors(s, c, **how):
        found = {w for r in s.collect() for w in r[c]}
        fitted.append((found & {"one", "two", "three", "four"}, how))
        return s.sparkSession.createDataFrame([(w, [1.0, float(w in ("one", "two") and "three" not in found)]) for w in sorted(found)], "word string, vector array<double>")

    monkeypatch.setattr(pipeline.embeddings, "word_vectors", vectors)
    texts = ["one;two", "three;four"]
    words = spark.createDataFrame([(k, texts[k // 5], texts[k // 5], 201001 + k // 5) for k in range(10)], WORD)
    bounds = spark.createDataFrame([(0, 201001, 201002), (1, 201002, 201003)], "period int, lo int, hi int")
    edges = {(r.graph_id, r.src, r.dst) for r in pipeline.period_graphs(words, bounds, "word2vec").collect()}
    every = {"one", "two", "three", "four"}
    order = lambda sets: sorted(sorted(x) for x in sets)  # models are fitted side by side
    assert order(f for f, _ in fitted) == order([every, {"one", "two"}, every, {"three", "four"}])
    assert all(how["size"] == how["steps"] == 100 for _, how in fitted)
    assert {e[1:] for e in edges if e[0] == 0} == {("one", "two")} and {e[1:] for e in edges if e[0] == 2} == {("four", "three")}


def test_word2vec_models_get_whole_sentences_that_lie_together(spark, monkeypatch):
    seen = []

    def vectors(sentences, column, **how):
        seen.append(sentences)
        return spark.createDataFrame([], "graph_id int, word string, vector array<double>")

    monkeypatch.setattr(pipeline.embeddings, "graph_vectors", vectors)
    text = lambda k: f"a{k};b{k};#;c{k};d{k}"
    rows = [(k, "a1;b1", text(k), 201001 + k % 2) for k in range(8)]
    words = spark.createDataFrame([*rows, (9, "q", None, 201001)], WORD)
    bounds = spark.createDataFrame([(0, 201001, 201002), (1, 201002, 201003)], "period int, lo int, hi int")
    pipeline.period_graphs(words, bounds, "word2vec").collect()
    found = {}
    for r in seen[0].collect():
        found.setdefault(r.graph_id, []).append(tuple(r.words))
    of = lambda ks: [pair for k in ks for pair in ((f"a{k}", f"b{k}"), (f"c{k}", f"d{k}"))]
    even, odd = of(range(0, 8, 2)), of(range(1, 8, 2))
    assert {g: sorted(x) for g, x in found.items()} == {-1: sorted(even + odd), 0: sorted(even), 1: sorted(even + odd), 2: sorted(odd)}
    for file in Path(seen[0]._staged_at.removeprefix("file://")).glob("*.parquet"):
        ids = pq.read_table(file, columns=["graph_id"])["graph_id"].to_pylist()
        assert ids == sorted(ids)


def test_graphs_without_frequent_words_cost_no_jobs(spark):
    def jobs(graphs):
        texts = stage(spark.createDataFrame([(g, [f"w{g}", "x"]) for g in range(graphs)], "graph_id int, words array<string>"))
        last = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000) or max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        begun = last()
        assert graph_vectors(texts, "words", least=2).isEmpty()
        return last() - begun

    assert jobs(2) == jobs(12)


def test_materialise_builds_once(spark):
    path, calls = f"{shared_folder(spark)}/once", []

    def build():
        calls.append(1)
        return spark.range(3)

    assert materialise(spark, path, build).count() == materialise(spark, path, build).count() == 3 and len(calls) == 1


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(10).repartition(3, "id").selectExpr("id", "cast(null as string) as s")
    again = stage(df)
    assert again.dtypes == df.dtypes and again.count() == 10 and df.count() == 10
    assert stage(df.limit(0)).count() == 0


def test_discarded_tables_are_gone(spark):
    import os

    from topicweave.plans.stage import discard

    table = stage(spark.range(5))
    path = table._staged_at.removeprefix("file://")
    assert os.path.isdir(path)
    discard(table)
    assert not os.path.isdir(path)
