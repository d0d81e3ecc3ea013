from pyspark.sql import functions as F

from topicweave.functions import months as M
from topicweave.functions import text as X
from topicweave.operators import corpus, periods, series


def test_months(spark):
    row = spark.range(1).select(
        M.month_shift(F.lit(201201), 1), M.month_shift(F.lit(201001), 14), M.month_diff(F.lit(201201), F.lit(201111)), M.publication_month(F.lit(2010), F.lit("jan 15")), M.publication_month(F.lit(2010), F.lit("SPR")),
        M.even_split(F.lit(7), F.lit(3)), M.even_split(F.lit(6), F.lit(3)), M.even_split(F.lit(2), F.lit(0)),
    ).first()
    assert tuple(row) == (201112, 200811, 2, 201001, None, [2, 2, 3], [2, 2, 2], None)


def test_clean_papers_leaves_unknown_months(spark, rows):
    df = spark.createDataFrame([(1, "k", "a", 2010, "FEB", "j", None), (2, "k", "a", 2010, "WIN", "j", None), (3, None, "a", 2010, "FEB", "j", None)], "paper_id long, author_keywords string, abstract string, publication_year int, publication_date string, source_title string, doi string")
    assert rows(series.clean_papers(df)) == [(1, 201002, "J", None)]


def test_breaks(spark, rows):
    values = [0, 0, 0, 0, 0, 0, 90, 0, 0, 0, 0, 0, 0]
    df = spark.createDataFrame(list(enumerate(values)), "pos int, n int")
    assert rows(series.segment_breaks(df)) == [(6,)]
    assert rows(series.segment_breaks(df.limit(4))) == []
    assert series.segment_breaks(df.limit(0)).count() == 0


def test_breaks_of_several_series(spark, rows):
    df = spark.createDataFrame([(s, i, 90 if i == 5 + s else 0) for s in (0, 1) for i in range(13)], "s int, pos int, n int")
    assert rows(series.segment_breaks(df, by=["s"])) == [(0, 5), (1, 6)]


def test_smoothing_keeps_every_paper(spark):
    papers = [(i, 201001 if i < 3 else 201004 if i < 10 else 201006, "J", str(i)) for i in range(15)] + [(99, 201001, "ONE", None), (100, 201001, None, None)]
    df = spark.createDataFrame(papers, "paper_id long, month int, journal string, doi string")
    got = {r.paper_id: r.month for r in series.smooth_issues(df).collect()}
    assert len(got) == 16 and got[99] == 201001
    assert sorted(got[i] for i in range(3, 10)) == [201002, 201002, 201003, 201003, 201004, 201004, 201004]


def test_bucket_and_scaling(spark, rows):
    df = spark.createDataFrame([(201001 + i, i) for i in range(5)], "month int, n long")
    assert rows(series.bucket_months(df, 2)) == [(0, 201001, 1), (1, 201003, 5), (2, 201005, 4)]
    flat = spark.createDataFrame([("a", 3.0), ("a", 3.0)], "g string, v double")
    assert rows(series.standardise(flat, "v", "z", ["g"]), "z") == [(None,), (None,)]
    assert rows(series.min_max(flat, "v", "z", ["g"]), "z") == [(3.0,), (3.0,)]


def test_periods(spark, rows):
    bounds = spark.createDataFrame([(0, 200902, 200904), (1, 200904, 201002), (2, 201002, 201002)], "period int, lo int, hi int")
    df = spark.createDataFrame([(200902,), (200904,), (201001,), (201002,), (None,)], "month int")
    assert rows(periods.in_period(df, "month", bounds), "month", "period") == [(200902, 0), (200904, 1), (201001, 1)]
    assert dict(rows(periods.period_end(df.filter("month is not null"), "month", bounds, "hi"), "month", "period_end")) == {200902: 200904, 200904: 200904, 201001: 201002, 201002: 201002}


def test_ties_by_term(spark, rows):
    df = spark.createDataFrame([(0, "b"), (0, "a"), (0, "c")], "g int, t string")
    assert rows(periods.top_terms(df, "g", "t", 2), "t", "rank") == [("a", 1), ("b", 2)]


def test_text(spark):
    row = spark.range(1).select(X.phrase(F.lit("Open Shelving 3")), X.word_shape(F.lit("a_b")), X.word_shape(F.lit("_")), X.word_shape(F.lit("a1")), X.lemma(F.lit("studies")), X.abbreviation_parts(F.lit("Full Name FN")), X.abbreviation_parts(F.lit("Full Name XY"))).first()
    assert tuple(row) == ("open_shelving", True, False, False, "study", ["Full Name", "FN"], ["Full Name XY"])
    merged = spark.range(1).select(X.merge_phrases(F.lit("Open shelving, reopen shelving; open shelving unit"), F.array(F.lit("open_shelving"), F.lit("open_shelving_unit")))).first()[0]
    assert merged == "open_shelving, reopen shelving; open_shelving_unit"


def test_tokens_and_windows(spark, rows):
    df = spark.createDataFrame([(1, "a;b;#;c;d;e"), (2, None), (3, "")], "paper_id long, title_abstract string")
    tokens = corpus.token_rows(df)
    assert rows(tokens) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, "d"), (1, 1, 2, "e")]
    assert rows(corpus.window_pairs(tokens, ["paper_id", "sent"], 2), "token", "other") == [("a", "b"), ("c", "d"), ("c", "e"), ("d", "e")]
