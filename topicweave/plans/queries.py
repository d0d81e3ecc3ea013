"""Queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.functions import months as M
from topicweave.functions import text as X
from topicweave.operators import corpus, dictionaries, embeddings, graphs, lineage, periods, reports, series
from topicweave.operators.packed import explode_packed, record_terms
from topicweave.plans import pipeline
from topicweave.plans.packed_sql import packed_sql
from topicweave.plans.stage import scratch, stage
from topicweave.sources import files
from topicweave.sources.tables import table
from topicweave.streaming import series as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def _all() -> None:
    """The modules that add their queries to those of this one."""
    from topicweave.plans import graph_queries, table_queries  # noqa: F401


# ---- shared parts ----------------------------------------------------------------

TERMS = r"""
kw AS (SELECT DISTINCT paper_id, regexp_replace(keyword_plus, '[\[\]"'']', '', 'g') AS k FROM paper_word WHERE keyword_plus IS NOT NULL),
kt AS (SELECT paper_id, unnest(string_split_regex(k, '[;；|]')) AS t FROM kw WHERE regexp_matches(k, '[;；|]')
       UNION ALL SELECT paper_id, unnest(string_split(k, ',')) FROM kw WHERE NOT regexp_matches(k, '[;；|]')),
terms AS (SELECT paper_id, trim(regexp_replace(regexp_replace(lower(t), '[_-]', ' ', 'g'), '\s+', ' ', 'g')) AS term FROM kt WHERE trim(regexp_replace(t, '[_-]', ' ', 'g')) <> '')"""
MONTH_NO = "list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'], upper(split_part(trim(publication_date), ' ', 1)))"
CLEAN = f"""
dated AS (SELECT paper_id, publication_year, {MONTH_NO} AS m, upper(source_title) AS journal, doi FROM paper_end
          WHERE author_keywords IS NOT NULL AND abstract IS NOT NULL AND publication_year IS NOT NULL AND publication_date IS NOT NULL),
clean AS (SELECT paper_id, CAST(publication_year * 100 + m AS INTEGER) AS month, journal, doi FROM dated WHERE m > 0)"""
ORDINAL = "(({0} // 100) * 12 + {0} % 100 - 1)"
COMM_GRAPH = """
cw AS (SELECT DISTINCT period, comm, word FROM community),
ce AS (SELECT a.period, a.word AS src, b.word AS dst FROM cw a JOIN cw b ON a.period = b.period AND a.comm = b.comm AND a.word < b.word),
g AS (SELECT p AS graph_id, src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT period AS p, src, dst FROM ce UNION ALL SELECT period - 1, src, dst FROM ce) WHERE p BETWEEN 0 AND 13 GROUP BY ALL)"""
TOKENS = r"""
st AS (SELECT DISTINCT paper_id, title_abstract FROM paper_word WHERE title_abstract IS NOT NULL),
raw AS (SELECT paper_id, unnest(string_split(title_abstract, ';')) AS token, generate_subscripts(string_split(title_abstract, ';'), 1) AS i FROM st),
num AS (SELECT paper_id, token, i, sum(CASE WHEN token = '#' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, i2 ORDER BY i) AS s FROM (SELECT *, 0 AS i2 FROM raw)),
tok AS (SELECT paper_id, s, token, row_number() OVER (PARTITION BY paper_id, s ORDER BY i) AS pos FROM num WHERE token NOT IN ('#', ''))"""
ROLES = """
ol AS (SELECT CAST(year(o_orderdate) - 1995 AS INTEGER) AS period, l_partkey AS word, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
mc AS (SELECT period, word, s AS comm FROM (SELECT period, word, s, row_number() OVER (PARTITION BY period, word ORDER BY count(*) DESC, s) AS r FROM ol GROUP BY period, word, s) WHERE r = 1),
mm AS (SELECT mp AS mix_period, word, s AS mix FROM (SELECT mp, word, s, row_number() OVER (PARTITION BY mp, word ORDER BY count(*) DESC, s) AS r
       FROM (SELECT period AS mp, word, s FROM ol WHERE period < 6 UNION ALL SELECT period - 1, word, s FROM ol WHERE period > 0) WHERE mp < 6 GROUP BY mp, word, s) WHERE r = 1),
sides AS (SELECT 'old' AS side, period, comm, word, period AS mix_period FROM mc UNION ALL SELECT 'new', period, comm, word, period - 1 FROM mc),
cnt AS (SELECT side, period, comm, mix_period, mix, count(*) AS overlap FROM sides JOIN mm USING (mix_period, word) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, period, comm, mix_period ORDER BY overlap DESC, mix) AS r FROM cnt) WHERE r = 1),
low AS (SELECT mix_period, min(mix) AS lowest FROM mm GROUP BY 1),
links AS (SELECT e.side, e.period, e.comm, e.mix_period, coalesce(b.mix, low.lowest) AS mix, coalesce(b.overlap, 0) AS overlap
          FROM (SELECT DISTINCT side, period, comm, mix_period FROM sides) e JOIN low USING (mix_period) LEFT JOIN best b USING (side, period, comm, mix_period)),
lists AS (SELECT m.mix_period, m.mix, list_sort(coalesce(list(DISTINCT l.comm) FILTER (side = 'old'), [])) AS old, list_sort(coalesce(list(DISTINCT l.comm) FILTER (side = 'new'), [])) AS new
          FROM (SELECT DISTINCT mix_period, mix FROM mm) m LEFT JOIN links l USING (mix_period, mix) GROUP BY ALL)"""
EVENTS = """
ev AS (
  SELECT mix_period AS period, unnest(old) AS comm, 'inherit' AS event FROM lists WHERE len(old) = 1 AND len(new) = 1
  UNION ALL SELECT mix_period + 1, unnest(new), 'inherit' FROM lists WHERE len(old) = 1 AND len(new) = 1
  UNION ALL SELECT mix_period, unnest(old), 'divide' FROM lists WHERE len(old) = 1 AND len(new) > 1
  UNION ALL SELECT mix_period + 1, unnest(new), 'merge' FROM lists WHERE len(old) > 1 AND len(new) = 1
  UNION ALL SELECT mix_period + 1, unnest(new), 'no_past' FROM lists WHERE len(old) = 0
  UNION ALL SELECT mix_period, unnest(old), 'no_future' FROM lists WHERE len(new) = 0),
life AS (
  SELECT period, comm, event, count(*) AS n FROM ev WHERE event IN ('inherit', 'divide', 'merge') GROUP BY ALL
  UNION ALL SELECT period, comm, CASE WHEN max(event) = 'no_past' AND min(event) = 'no_future' THEN 'isolate' WHEN max(event) = 'no_past' THEN 'new_born' ELSE 'die_out' END, 1
  FROM ev WHERE event IN ('no_past', 'no_future') GROUP BY period, comm)"""


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return series.clean_papers(table(spark, folder, "paper_end"))


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    """``(paper_id, month, term)`` of paper_word."""
    words = table(spark, folder, "paper_word")
    months = words.select("paper_id", F.col("publication_year").alias("month")).distinct()
    terms = record_terms(words.select("paper_id", "keyword_plus").distinct(), "paper_id", "keyword_plus")
    # months is as large as the papers; AQE broadcasts it only if it is small
    return terms.select("paper_id", F.explode("terms").alias("term")).join(months, "paper_id")


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    return series.distinct_per_month(_keywords(spark, folder), "month", "term")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.token_rows(table(spark, folder, "paper_word").select("paper_id", "title_abstract").distinct())


def _community_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Words of one community, in graphs of two consecutive periods."""
    members = table(spark, folder, "community").select("period", "comm", "word").distinct()
    other = members.withColumnRenamed("word", "dst")
    pairs = members.withColumnRenamed("word", "src").join(other, ["period", "comm"]).filter("src < dst")
    return graphs.canonical(pairs.select(F.explode(F.array("period", F.col("period") - 1)).alias("graph_id"), "src", "dst").filter("graph_id between 0 and 13"), "src", "dst", "graph_id")


def _roles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Communities of parts by their usual supplier in a year, and over two years."""
    sold = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sold = sold.select((F.year("o_orderdate") - 1995).cast("int").alias("period"), F.col("l_partkey").alias("word"), F.col("l_suppkey").alias("s"))
    usual = lambda df, p, out: df.groupBy(p, "word", "s").agg(F.count("*").alias("n")).groupBy(p, "word").agg(F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias(out))
    mixed = sold.select(F.explode(F.array("period", F.col("period") - 1)).alias("mix_period"), "word", "s").filter("mix_period between 0 and 5")
    return usual(sold, "period", "comm"), usual(mixed, "mix_period", "mix")


def _links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    members, mixes = _roles(spark, folder)
    return members, mixes, lineage.link_by_overlap(members, mixes)


# ---- packed fields ------------------------------------------------------------------


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "paper_end")
    words = table(spark, folder, "paper_word").select("paper_id", "keyword_plus").distinct()
    out = None
    for field, source in (("authors", papers), ("author_keywords", papers), ("keywords_plus", papers), ("keyword_plus", words)):
        part = explode_packed(source, "paper_id", field, persons=field == "authors").select(F.lit(field).alias("field"), "paper_id", "pos", "item")
        out = part if out is None else out.unionByName(part)
    return out


_FIELDS = (("authors", "paper_end", True), ("author_keywords", "paper_end", False), ("keywords_plus", "paper_end", False), ("keyword_plus", "kpd", False))
query(
    "WITH kpd AS (SELECT DISTINCT paper_id, keyword_plus FROM paper_word), "
    + ", ".join(packed_sql(f"f_{c}", r, c, p) for c, r, p in _FIELDS)
    + " UNION ALL ".join(f" SELECT '{c}' AS field, paper_id, pos, item FROM f_{c}" for c, _, _ in _FIELDS)
)(p3_found)


@query(f"WITH {TERMS} SELECT term, count(*) AS n, count(DISTINCT paper_id) AS papers FROM terms GROUP BY term")
def keyword_terms(spark, folder):
    words = table(spark, folder, "paper_word").select("paper_id", "keyword_plus").distinct()
    rows = record_terms(words, "paper_id", "keyword_plus").select("paper_id", F.explode("terms").alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))


# ---- months, series, periods ----------------------------------------------------------


@query(f"WITH {CLEAN} SELECT paper_id, month, journal, doi FROM clean")
def clean_papers(spark, folder):
    return _clean(spark, folder)


@query(f"WITH {CLEAN} SELECT journal, month, count(*) AS n FROM clean WHERE journal IS NOT NULL GROUP BY ALL")
def journal_month_counts(spark, folder):
    return _clean(spark, folder).filter("journal is not null").groupBy("journal", "month").agg(F.count("*").alias("n"))


@query(f"WITH {TERMS}, mo AS (SELECT DISTINCT paper_id, publication_year AS month FROM paper_word) SELECT month, count(DISTINCT term) AS n FROM terms JOIN mo USING (paper_id) WHERE month IS NOT NULL GROUP BY month")
def monthly_distinct_keywords(spark, folder):
    return _monthly(spark, folder)


@query(f"""WITH {TERMS}, mo AS (SELECT DISTINCT paper_id, publication_year AS month FROM paper_word), s AS (SELECT month, count(DISTINCT term) AS n FROM terms JOIN mo USING (paper_id) WHERE month IS NOT NULL GROUP BY month),
  r AS (SELECT *, (row_number() OVER (ORDER BY month) - 1) // 3 AS b FROM s) SELECT CAST(b AS INTEGER) AS bucket, min(month) AS first_month, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY b""")  # fmt: skip
def month_bucket_n(spark, folder):
    return series.bucket_months(_monthly(spark, folder), 3)


@query(f"WITH {CLEAN}, o AS (SELECT paper_id, {ORDINAL.format('month')} - 14 AS o FROM clean) SELECT paper_id, CAST((o // 12) * 100 + o % 12 + 1 AS INTEGER) AS month FROM o")
def month_shift(spark, folder):
    return _clean(spark, folder).select("paper_id", M.month_shift(F.col("month"), 14).alias("month"))


@query(f"WITH {CLEAN} SELECT paper_id, CAST({ORDINAL.format('month')} - {ORDINAL.format('200901')} AS INTEGER) AS months FROM clean")
def month_diff(spark, folder):
    return _clean(spark, folder).select("paper_id", M.month_diff(F.col("month"), F.lit(200901)).alias("months"))


@query(f"""WITH {CLEAN}, c AS (SELECT journal, count(*) AS n, count(DISTINCT month) AS k FROM clean WHERE journal IS NOT NULL GROUP BY journal)
  SELECT journal, CAST(i AS INTEGER) AS part, CAST(n // k + CASE WHEN i >= k - n % k THEN 1 ELSE 0 END AS INTEGER) AS size FROM c, unnest(range(k)) u(i)""")  # fmt: skip
def even_split(spark, folder):
    counts = _clean(spark, folder).filter("journal is not null").groupBy("journal").agg(F.count("*").alias("n"), F.count_distinct("month").alias("k"))
    return counts.select("journal", F.posexplode(M.even_split(F.col("n"), F.col("k"))).alias("part", "size"))


GAPS = f"""{CLEAN}, ic AS (SELECT journal, month, count(*) AS n FROM clean WHERE journal IS NOT NULL GROUP BY ALL),
 lg AS (SELECT *, {ORDINAL.format('month')} - lag({ORDINAL.format('month')}) OVER (PARTITION BY journal ORDER BY month) AS d FROM ic),
 gaps AS (SELECT journal, month, n, CAST(coalesce(d, lead(d) OVER (PARTITION BY journal ORDER BY month)) AS INTEGER) AS gap FROM lg)"""


@query(f"WITH {GAPS} SELECT * FROM gaps")
def issue_gap_lag(spark, folder):
    return series.issue_gaps(_clean(spark, folder))


@query(f"""WITH {GAPS}, w AS (SELECT *, coalesce(gap, 1) AS k FROM gaps), rk AS (SELECT paper_id, journal, month, row_number() OVER (PARTITION BY journal, month ORDER BY doi NULLS FIRST, paper_id) - 1 AS r FROM clean WHERE journal IS NOT NULL),
  pl AS (SELECT journal, month, k, i, n // k + CASE WHEN i >= k - n % k THEN 1 ELSE 0 END AS c FROM w, unnest(range(k)) u(i)),
  rg AS (SELECT *, sum(c) OVER (PARTITION BY journal, month ORDER BY i) AS hi FROM pl),
  nm AS (SELECT journal, month, hi - c AS lo, hi, {ORDINAL.format('month')} - k + 1 + i AS o FROM rg)
  SELECT paper_id, journal, CAST((o // 12) * 100 + o % 12 + 1 AS INTEGER) AS month FROM rk JOIN nm USING (journal, month) WHERE r >= lo AND r < hi""")  # fmt: skip
def issue_smoothing(spark, folder):
    return series.smooth_issues(_clean(spark, folder))


SERIES = f"""{TERMS}, mo AS (SELECT DISTINCT paper_id, publication_year AS month FROM paper_word), ser AS (SELECT month, count(DISTINCT term) AS n FROM terms JOIN mo USING (paper_id) WHERE month IS NOT NULL GROUP BY month),
 ps AS (SELECT CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS pos, n, count(*) OVER () AS k FROM ser)"""


@query(f"""WITH {SERIES}, e AS (SELECT max(CASE WHEN pos = 0 THEN n END) AS f, max(CASE WHEN pos = k - 1 THEN n END) AS l, max(k) AS k FROM ps),
  d AS (SELECT pos, ps.n, abs(ps.n - (l - f) / (e.k - 1) * pos - f) / sqrt(1 + ((l - f) / (e.k - 1)) * ((l - f) / (e.k - 1))) AS distance FROM ps, e)
  SELECT pos, n, round(distance, 6) AS distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(distance, 9) DESC, pos) AS r FROM d) WHERE r <= 5""")  # fmt: skip
def chord_distance_topk(spark, folder):
    numbered = _monthly(spark, folder).withColumn("pos", F.expr("cast(row_number() over (order by month) - 1 as int)"))
    return series.chord_distances(numbered).filter("rank <= 5").select("pos", "n", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {CLEAN} SELECT paper_id, month, period FROM clean JOIN period_bounds ON month >= lo AND month < hi")
def period_half_open(spark, folder):
    return periods.in_period(_clean(spark, folder).select("paper_id", "month"), "month", table(spark, folder, "period_bounds")).select("paper_id", "month", "period")


@query(f"WITH {CLEAN} SELECT paper_id, month, coalesce((SELECT min(hi) FROM period_bounds WHERE hi >= month), (SELECT max(hi) FROM period_bounds)) AS period_end FROM clean")
def period_upper_bound(spark, folder):
    return periods.period_end(_clean(spark, folder).select("paper_id", "month"), "month", table(spark, folder, "period_bounds"), "hi")


PERIOD_TERMS = f"{TERMS}, mo AS (SELECT DISTINCT paper_id, publication_year AS month FROM paper_word), pt AS (SELECT paper_id, period, term FROM terms JOIN mo USING (paper_id) JOIN period_bounds ON month >= lo AND month < hi)"


@query(f"WITH {PERIOD_TERMS} SELECT DISTINCT period, term FROM pt")
def period_keyword_set(spark, folder):
    return periods.in_period(_keywords(spark, folder), "month", table(spark, folder, "period_bounds")).select("period", "term").distinct()


@query(f"WITH {PERIOD_TERMS} SELECT period, term, n, CAST(r AS INTEGER) AS rank FROM (SELECT period, term, count(*) AS n, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, term) AS r FROM pt GROUP BY period, term) WHERE r <= 20")
def topn_keywords_per_period(spark, folder):
    return periods.top_terms(periods.in_period(_keywords(spark, folder), "month", table(spark, folder, "period_bounds")), "period", "term", 20)


@query(f"""WITH {CLEAN}, y AS (SELECT month // 100 AS year, count(*) AS n FROM clean GROUP BY 1), k AS (SELECT month // 100 AS year, count(DISTINCT term) AS n FROM (WITH {TERMS} SELECT term, publication_year AS month FROM terms JOIN (SELECT DISTINCT paper_id, publication_year FROM paper_word) USING (paper_id)) GROUP BY 1),
  b AS (SELECT CAST(year AS INTEGER) AS year, 'keywords' AS name, CAST(n AS DOUBLE) AS n FROM k UNION ALL SELECT CAST(year AS INTEGER), 'papers', n FROM y)
  SELECT year, name, n, round((n - avg(n) OVER (PARTITION BY name)) / stddev_pop(n) OVER (PARTITION BY name), 6) AS score FROM b""")  # fmt: skip
def standardised_yearly_series(spark, folder):
    year = F.floor(F.col("month") / 100).cast("int").alias("year")
    papers = _clean(spark, folder).groupBy(year).agg(F.count("*").alias("n"))
    words = _keywords(spark, folder).groupBy(year).agg(F.count_distinct("term").alias("n"))
    return reports.yearly_contrast(papers=papers, keywords=words).withColumn("score", F.round("score", 6))


@query("""WITH j AS (SELECT upper(source_title) AS journal, publication_year AS year, count(*) AS n FROM paper_end WHERE source_title IS NOT NULL AND publication_year IS NOT NULL GROUP BY ALL)
  SELECT year, CAST(sum(n) AS BIGINT) AS n FROM j GROUP BY year""")  # fmt: skip
def nested_map_sum(spark, folder):
    rows = table(spark, folder, "paper_end").filter("source_title is not null and publication_year is not null").groupBy(F.upper("source_title").alias("journal"), F.col("publication_year").alias("year")).agg(F.count("*").alias("n"))
    inner = rows.groupBy("journal").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("years"))
    return periods.yearly_from_nested(inner.select(F.create_map("journal", "years").alias("counts")), "counts")


# ---- corpus --------------------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT paper_id, count(*) AS tokens, count(DISTINCT s) AS sentences FROM tok GROUP BY paper_id")
def sentence_split(spark, folder):
    return _tokens(spark, folder).groupBy("paper_id").agg(F.count("*").alias("tokens"), F.count_distinct("sent").alias("sentences"))


@query(f"WITH {TOKENS} SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 100")
def corpus_top_words(spark, folder):
    return corpus.frequent_words(_tokens(spark, folder), 100)


@query(f"WITH {TOKENS}, sw AS (SELECT DISTINCT lower(trim(word)) AS word FROM stopword WHERE word IS NOT NULL), top AS (SELECT token FROM tok GROUP BY token ORDER BY count(*) DESC, token LIMIT 100) SELECT token, count(*) AS n FROM tok WHERE token NOT IN (SELECT word FROM sw) AND token NOT IN (SELECT token FROM top) GROUP BY token")
def stopword_anti(spark, folder):
    tokens = _tokens(spark, folder)
    rest = corpus.without_words(tokens, table(spark, folder, "stopword"), "word")
    rest = corpus.without_words(rest, corpus.frequent_words(tokens, 100), "token")
    return rest.groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) >= 4")
def vocab_min_count(spark, folder):
    return corpus.vocabulary(_tokens(spark, folder), 4)


@query(f"WITH {TOKENS}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token) SELECT token, n, round(least(1.0, sqrt(0.0001 / (n / sum(n) OVER ()))), 6) AS keep FROM c")
def subsampling(spark, folder):
    counts = _tokens(spark, folder).groupBy("token").agg(F.count("*").alias("n"))
    return corpus.kept_by_subsampling(counts).withColumn("keep", F.round("keep", 6))


@query(f"WITH {TOKENS} SELECT token, count(*) AS n FROM tok WHERE (regexp_full_match(token, '[\\p{{L}}_]+') OR regexp_full_match(token, '[\\p{{L}}.]+')) AND regexp_matches(token, '\\p{{L}}') GROUP BY token")
def token_shape_filter(spark, folder):
    return _tokens(spark, folder).filter(X.word_shape(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS}, p AS (SELECT token AS x, unnest([lead(token, 1) OVER w, lead(token, 2) OVER w]) AS y FROM tok WINDOW w AS (PARTITION BY paper_id, s ORDER BY pos)) SELECT least(x, y) AS src, greatest(x, y) AS dst, CAST(count(*) AS DOUBLE) AS weight, round(1.0 / count(*), 6) AS distance FROM p WHERE y IS NOT NULL GROUP BY ALL")
def cooccurrence_w2(spark, folder):
    pairs = corpus.window_pairs(_tokens(spark, folder), ["paper_id", "sent"], 2)
    return graphs.with_distance(graphs.canonical(pairs, "token", "other")).withColumn("distance", F.round("distance", 6))


@query(f"WITH {TOKENS}, p AS (SELECT token AS x, unnest([lead(token, 1) OVER w, lead(token, 2) OVER w, lead(token, 3) OVER w]) AS y FROM tok WINDOW w AS (PARTITION BY paper_id, s ORDER BY pos)), b AS (SELECT x AS centre, y AS context FROM p WHERE y IS NOT NULL UNION ALL SELECT y, x FROM p WHERE y IS NOT NULL) SELECT centre, context, count(*) AS n FROM b GROUP BY ALL")
def skipgram_pairs_w3(spark, folder):
    return corpus.skip_grams(_tokens(spark, folder), ["paper_id", "sent"], 3)


# ---- dictionaries ------------------------------------------------------------------------


@query("SELECT doc_id, n_chars FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def ascii_filter(spark, folder):
    return table(spark, folder, "documents").filter(X.ascii_only(F.col("text"))).select("doc_id", "n_chars")


@query("SELECT DISTINCT lower(trim(word)) AS word FROM stopword WHERE word IS NOT NULL AND trim(word) <> '' AND NOT regexp_matches(word, '[^\\x00-\\x7F]')")
def stop_words(spark, folder):
    return dictionaries.stop_words(table(spark, folder, "stopword"), "word")


@query(r"""WITH o AS (SELECT DISTINCT p_name, p_name || ' ' || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), 'string_agg', '') AS full_name FROM part WHERE len(string_split(p_name, ' ')) >= 2)
  SELECT full_name, [p_name, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), 'string_agg', '')] AS parts FROM o""")  # fmt: skip
def abbrev_split(spark, folder):
    names = table(spark, folder, "part").filter(F.size(F.split("p_name", " ")) >= 2).select("p_name").distinct()
    initials = F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), ""))
    return names.select(F.concat_ws(" ", "p_name", initials).alias("full_name")).select("full_name", X.abbreviation_parts(F.col("full_name")).alias("parts"))


@query(r"""WITH p AS (SELECT paper_id, list_filter(list_transform(string_split_regex(article_title, '[,()]+'), lambda x: trim(x, ' ,-')), lambda x: x <> '') AS l FROM paper_end WHERE article_title IS NOT NULL)
  SELECT paper_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS term FROM p, unnest(range(1, len(l) + 1)) u(i)""")  # fmt: skip
def multi_delim_split(spark, folder):
    return dictionaries.split_terms(table(spark, folder, "paper_end"), "paper_id", "article_title")


@query("WITH s AS (SELECT lower(trim(word)) AS word, lower(trim(u)) AS s FROM synonym LEFT JOIN unnest(string_split_regex(synonyms, '[;,|]')) x(u) ON true) SELECT word, list_sort(coalesce(list(DISTINCT s) FILTER (s IS NOT NULL AND s <> ''), [])) AS synonyms FROM s WHERE word IS NOT NULL AND word <> '' GROUP BY word")
def synonym_union(spark, folder):
    return dictionaries.merge_synonyms(table(spark, folder, "synonym").select("word", F.split("synonyms", "[;,|]").alias("synonyms")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(spark, folder):
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' ')) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(l) AS BIGINT) AS fields, CAST(list_sum(list_transform(l, lambda x: length(x))) AS BIGINT) AS chars FROM p WHERE len(l) > 0")
def html_extract(spark, folder):
    found = table(spark, folder, "documents").select("doc_id", X.html_fields(F.col("text"), "p").alias("l")).filter("size(l) > 0")
    return found.select("doc_id", F.size("l").cast("bigint").alias("fields"), F.aggregate("l", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("chars"))


# ---- graphs ------------------------------------------------------------------------------


@query(f"WITH {COMM_GRAPH} SELECT src, dst, sum(weight) AS weight, round(1 / sum(weight), 6) AS distance FROM g GROUP BY ALL")
def graph_union_weights(spark, folder):
    return graphs.with_distance(graphs.union_graphs(_community_graph(spark, folder))).withColumn("distance", F.round("distance", 6))


DEGREE = f"""{COMM_GRAPH}, en AS (SELECT graph_id, src AS node, weight FROM g UNION ALL SELECT graph_id, dst, weight FROM g), dg AS (SELECT graph_id, node, count(*) AS degree, sum(weight) AS weighted FROM en GROUP BY ALL)"""


@query(f"WITH {DEGREE} SELECT graph_id, node, degree, weighted, round(CASE WHEN count(*) OVER w > 1 THEN degree / (count(*) OVER w - 1) ELSE 1.0 END, 6) AS centrality FROM dg WINDOW w AS (PARTITION BY graph_id)")
def degree_centrality(spark, folder):
    return graphs.degrees(_community_graph(spark, folder)).withColumn("centrality", F.round("centrality", 6))


@query(f"WITH {DEGREE} SELECT graph_id, node, weighted, round((weighted - avg(weighted) OVER w) / stddev_pop(weighted) OVER w, 6) AS z, round((weighted - min(weighted) OVER w) / (max(weighted) OVER w - min(weighted) OVER w), 6) AS scaled FROM dg WINDOW w AS (PARTITION BY graph_id)")
def weighted_degree_zscore(spark, folder):
    d = graphs.degrees(_community_graph(spark, folder)).select("graph_id", "node", "weighted")
    d = series.min_max(series.standardise(d, "weighted", "z", ["graph_id"]), "weighted", "scaled", ["graph_id"])
    return d.select("graph_id", "node", "weighted", F.round("z", 6).alias("z"), F.round("scaled", 6).alias("scaled"))


@query(f"""WITH {DEGREE}, zs AS (SELECT graph_id, node, (weighted - avg(weighted) OVER w) / stddev_pop(weighted) OVER w AS z FROM dg WINDOW w AS (PARTITION BY graph_id)),
  m AS (SELECT period AS graph_id, comm, word AS node, z FROM cw JOIN zs ON zs.graph_id = period AND zs.node = word), f AS (SELECT *, coalesce(z >= 1.5, false) AS ok, row_number() OVER (PARTITION BY graph_id, comm ORDER BY round(z, 9) DESC NULLS LAST, node) AS r FROM m)
  SELECT graph_id, comm, node, round(z, 6) AS score FROM (SELECT *, bool_or(ok) OVER (PARTITION BY graph_id, comm) AS anyok FROM f) WHERE ok OR (NOT anyok AND r = 1)""")  # fmt: skip
def core_words_filter_fallback(spark, folder):
    z = series.standardise(graphs.degrees(_community_graph(spark, folder)), "weighted", "z", ["graph_id"])
    members = table(spark, folder, "community").select(F.col("period").alias("graph_id"), "comm", F.col("word").alias("node")).distinct()
    return graphs.core_words(members, z, "z", 1.5, strict=False).withColumn("score", F.round("score", 6))


@query(f"WITH {COMM_GRAPH} SELECT g.graph_id, a.comm, g.src, g.dst, g.weight FROM g JOIN cw a ON a.period = g.graph_id AND a.word = src JOIN cw b ON b.period = g.graph_id AND b.word = dst WHERE a.comm = b.comm")
def induced_subgraph(spark, folder):
    members = table(spark, folder, "community").select(F.col("period").alias("graph_id"), "comm", F.col("word").alias("node")).distinct()
    return graphs.induced(_community_graph(spark, folder), members)


@query(f"""WITH RECURSIVE {COMM_GRAPH}, ed AS (SELECT graph_id, src AS a, dst AS b FROM g UNION SELECT graph_id, dst, src FROM g),
  cc(graph_id, node, comp) AS (SELECT DISTINCT graph_id, a, a FROM ed UNION SELECT cc.graph_id, ed.b, cc.comp FROM cc JOIN ed ON ed.graph_id = cc.graph_id AND ed.a = cc.node)
  SELECT graph_id, node, min(comp) AS comp FROM cc GROUP BY ALL""")  # fmt: skip
def connected_components(spark, folder):
    return graphs.components(_community_graph(spark, folder))


@query(f"WITH {COMM_GRAPH} SELECT x.graph_id, x.src AS a, x.dst AS b, y.dst AS c FROM g x JOIN g y ON y.graph_id = x.graph_id AND y.src = x.dst JOIN g z ON z.graph_id = x.graph_id AND z.src = x.src AND z.dst = y.dst")
def triangles_3clique(spark, folder):
    return graphs.triangles(_community_graph(spark, folder))


NEAR = f"""{COMM_GRAPH}, nb AS (SELECT graph_id, src AS node, dst AS other FROM g UNION SELECT graph_id, dst, src FROM g), sz AS (SELECT graph_id, node, count(*) AS n FROM nb GROUP BY ALL),
 pr AS (SELECT graph_id, src AS a, dst AS b, true AS adj FROM g UNION ALL SELECT DISTINCT p.graph_id, p.node, q.node, false FROM nb p JOIN nb q ON p.graph_id = q.graph_id AND p.other = q.other AND p.node < q.node WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.graph_id = p.graph_id AND g.src = p.node AND g.dst = q.node)),
 sh AS (SELECT p.graph_id, p.node AS a, q.node AS b, count(*) AS k FROM nb p JOIN nb q ON p.graph_id = q.graph_id AND p.other = q.other AND p.node < q.node GROUP BY ALL)"""


@query(f"WITH {NEAR} SELECT pr.graph_id, pr.a, pr.b, round(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)) / CASE WHEN adj THEN 1 ELSE 2 END, 6) AS similarity FROM pr JOIN sz x ON x.graph_id = pr.graph_id AND x.node = pr.a JOIN sz y ON y.graph_id = pr.graph_id AND y.node = pr.b LEFT JOIN sh ON sh.graph_id = pr.graph_id AND sh.a = pr.a AND sh.b = pr.b")
def neighbour_jaccard_hops(spark, folder):
    edges = _community_graph(spark, folder)
    pairs = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).union(graphs.two_step_pairs(edges)).distinct()
    return graphs.neighbour_jaccard(edges, pairs).withColumn("similarity", F.round("similarity", 6))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS weight
  FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) > 0.3""")  # fmt: skip
def cosine_edges(spark, folder):
    return embeddings.cosine_edges(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.3).withColumn("weight", F.round("weight", 6))


@query(f"WITH {DEGREE}, h AS (SELECT graph_id, node, CASE WHEN count(*) OVER w > 1 THEN degree / (count(*) OVER w - 1) ELSE 1.0 END AS c FROM dg WINDOW w AS (PARTITION BY graph_id)) SELECT CAST(least(floor(c * 1000), 999) AS INTEGER) AS bin, count(*) AS n FROM h WHERE c BETWEEN 0 AND 1 GROUP BY 1")
def histogram_bins(spark, folder):
    return graphs.histogram(graphs.degrees(_community_graph(spark, folder)), "centrality", 0.0, 1.0, 1000)


def _word_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "paper_word"), table(spark, folder, "period_bounds")


@query()
def keyword_contraction(spark, folder):
    """Keywords of a paper linked by their best paths in its graph, added up over all papers."""
    return graphs.union_graphs(pipeline.keyword_edges(*pipeline.phrase_tokens(table(spark, folder, "paper_word"))))


@query()
def pipeline_graph(spark, folder):
    return pipeline.period_graphs(*_word_inputs(spark, folder), model="jaccard")


@query()
def pipeline_graph_word2vec(spark, folder):
    return pipeline.period_graphs(*_word_inputs(spark, folder), model="word2vec")


@query()
def pipeline_graph_node2vec(spark, folder):
    return pipeline.period_graphs(*_word_inputs(spark, folder), model="node2vec")


@query("SELECT 2 * period + 1 AS graph_id, true AS adds_up FROM period_bounds WHERE period < (SELECT max(period) FROM period_bounds)")
def pipeline_checks(spark, folder):
    """A graph of two periods in a row weighs as much as theirs together, no paper lying in both."""
    weight = pipeline.period_graphs(*_word_inputs(spark, folder), model="jaccard").groupBy("graph_id").agg(F.sum("weight").alias("w"))
    own = weight.filter("graph_id >= 0 and graph_id % 2 = 0").select(F.explode(F.array(F.col("graph_id") - 1, F.col("graph_id") + 1)).alias("graph_id"), "w").groupBy("graph_id").agg(F.sum("w").alias("both"))
    return weight.filter("graph_id % 2 = 1").join(own, "graph_id").select("graph_id", (F.abs(F.col("w") - F.col("both")) < 1e-6).alias("adds_up"))


@query(f"WITH {TOKENS} SELECT token AS word, 100 AS size FROM tok GROUP BY token HAVING count(*) >= 4")
def word_vector_checks(spark, folder):
    """Every word that occurs four times has a vector; one pass of training is enough to see that."""
    sentences = table(spark, folder, "paper_word").select("paper_id", "title_abstract").distinct().select(F.explode(X.sentences(F.col("title_abstract"))).alias("words"))
    return embeddings.word_vectors(stage(sentences), "words", size=100, least=4, steps=1).select("word", F.size("vector").alias("size"))


@query()
def pipeline_core_words(spark, folder):
    return pipeline.trace(*_word_inputs(spark, folder), rule="z")["core"]


@query()
def pipeline_lifecycle(spark, folder):
    return pipeline.trace(*_word_inputs(spark, folder))["events"]


@query()
def word2vec_neighbours(spark, folder):
    sentences = table(spark, folder, "paper_word").select(F.explode(X.sentences(F.col("title_abstract"))).alias("words"))
    vectors = stage(embeddings.word_vectors(sentences, "words", size=100, window=3, least=4, steps=100))
    return embeddings.nearest(vectors, embeddings.cosine_edges(vectors, "word", "vector", 0.3, most=5), 5)


@query()
def similar_phrases(spark, folder):
    """Two-word phrases of each paper that are closest to its keywords by word vectors."""
    papers = table(spark, folder, "paper_word")
    tokens = _tokens(spark, folder)
    pairs = corpus.window_pairs(tokens, ["paper_id", "sent"], 1).select("paper_id", F.concat_ws("_", "token", "other").alias("phrase"))
    words = record_terms(papers.select("paper_id", "keyword_plus").distinct(), "paper_id", "keyword_plus").select("paper_id", F.explode(F.flatten(F.transform("terms", lambda t: F.split(t, " ")))).alias("word"))
    vectors = stage(embeddings.word_vectors(papers.select(F.explode(X.sentences(F.col("title_abstract"))).alias("words")), "words", size=100, steps=100))
    return embeddings.closest_phrases(pairs, words, vectors, "paper_id", 3)


@query(f"WITH {TOKENS}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token) SELECT token, n, round(pow(n, 0.75) / sum(pow(n, 0.75)) OVER (), 6) AS weight FROM c")
def negative_sampling(spark, folder):
    counts = _tokens(spark, folder).groupBy("token").agg(F.count("*").alias("n"))
    return corpus.negative_weights(counts).withColumn("weight", F.round("weight", 6))


# ---- lineage --------------------------------------------------------------------------------


@query(f"WITH {ROLES} SELECT side, period, comm, mix_period, mix, overlap FROM links")
def community_overlap_link(spark, folder):
    return _links(spark, folder)[2]


@query(f"WITH {ROLES} SELECT mix_period, mix, old, new FROM lists")
def mix_link_lists(spark, folder):
    _, mixes, links = _links(spark, folder)
    return lineage.mix_links(links, mixes)


@query(f"WITH {ROLES}, {EVENTS} SELECT CAST(period AS INTEGER) AS period, comm, event, CAST(n AS BIGINT) AS n FROM life")
def lifecycle_events(spark, folder):
    _, mixes, links = _links(spark, folder)
    return lineage.lifecycle(lineage.mix_links(links, mixes))


@query(f"WITH {ROLES}, {EVENTS} SELECT CAST(period AS INTEGER) AS period, event, CAST(sum(n) AS BIGINT) AS n FROM life GROUP BY ALL")
def lifecycle_summary(spark, folder):
    return lifecycle_events(spark, folder).groupBy("period", "event").agg(F.sum("n").alias("n"))


@query(f"WITH {ROLES}, {EVENTS} SELECT CAST(period AS INTEGER) AS period, comm, CAST(max(CASE event WHEN 'new_born' THEN 1 WHEN 'die_out' THEN 2 WHEN 'inherit' THEN 3 WHEN 'divide' THEN 4 WHEN 'merge' THEN 5 ELSE 6 END) AS INTEGER) AS code FROM life GROUP BY ALL")
def event_codes(spark, folder):
    return lineage.event_codes(lifecycle_events(spark, folder))


@query(f"""WITH {ROLES}, n1 AS (SELECT 'comm' || comm || '-' || period AS id, CAST(period AS DOUBLE) AS "group", count(DISTINCT word) AS score FROM mc GROUP BY period, comm UNION ALL SELECT 'mix' || mix || '-' || mix_period || '.5', mix_period + 0.5, len(old) + len(new) FROM lists)
  SELECT id, id AS label, "group", CAST(score AS BIGINT) AS score FROM n1""")  # fmt: skip
def evolution_nodes(spark, folder):
    members, mixes, links = _links(spark, folder)
    comms = members.withColumn("comm", F.col("comm").cast("bigint"))
    return lineage.evolution_nodes(comms, links, lineage.mix_links(links, mixes))


@query(f"WITH {ROLES} SELECT CASE side WHEN 'old' THEN 'comm' || comm || '-' || period ELSE 'mix' || mix || '-' || mix_period || '.5' END AS src, CASE side WHEN 'old' THEN 'mix' || mix || '-' || mix_period || '.5' ELSE 'comm' || comm || '-' || period END AS dst, overlap AS weight FROM links")
def evolution_edges(spark, folder):
    return lineage.evolution_edges(_links(spark, folder)[2])


@query("""WITH cw AS (SELECT DISTINCT period, comm, word FROM community), sz AS (SELECT period, comm, count(*) AS n FROM cw GROUP BY ALL),
  sh AS (SELECT a.period, a.comm, b.comm AS next_comm, count(*) AS shared FROM cw a JOIN cw b ON b.period = a.period + 1 AND a.word = b.word GROUP BY ALL)
  SELECT sh.period, sh.comm, next_comm, shared, round(shared / (x.n + y.n - shared), 6) AS relevance FROM sh JOIN sz x ON x.period = sh.period AND x.comm = sh.comm JOIN sz y ON y.period = sh.period + 1 AND y.comm = next_comm""")  # fmt: skip
def community_relevance(spark, folder):
    return lineage.pair_relevance(table(spark, folder, "community")).withColumn("relevance", F.round("relevance", 6))


# ---- files and streams ----------------------------------------------------------------------


@query("SELECT period, comm, count(*) AS n FROM (SELECT DISTINCT period, comm, word FROM community) GROUP BY ALL")
def ragged_round_trip(spark, folder):
    path = scratch(spark)
    lists = table(spark, folder, "community").groupBy("period", "comm").agg(F.array_sort(F.collect_set("word")).alias("words"))
    files.write_ragged(lists.select(F.concat(F.array(F.col("period").cast("string"), F.col("comm").cast("string")), "words").alias("line")), "line", path)
    back = files.read_ragged(spark, path)
    return back.select(F.col("members")[0].cast("int").alias("period"), F.col("members")[1].cast("int").alias("comm"), (F.size("members") - 2).cast("bigint").alias("n"))


@query("SELECT CAST(period AS VARCHAR) AS period, list_sort(list(DISTINCT word)) AS words FROM community GROUP BY period")
def json_round_trip(spark, folder):
    path = scratch(spark)
    files.write_json_map(table(spark, folder, "community").groupBy("period").agg(F.array_sort(F.collect_set("word")).alias("words")), "period", "words", path)
    return files.read_json_value(spark, path, "map<string, array<string>>").select(F.explode("value").alias("period", "words"))


@query("SELECT doc_id, replace(text, chr(13), '') AS text, lang FROM documents")
def csv_round_trip(spark, folder):
    path = scratch(spark)
    files.write_csv(table(spark, folder, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), "lang"), path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("doc_id bigint, text string, lang string").csv(path)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, folder):
    return streams.windowed_counts(table(spark, folder, "events"), "ts", "event_type").select("start", "event_type", "n")
