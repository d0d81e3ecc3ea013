"""Queries of segmentation, phrases, dictionary layouts, report tables and model inputs, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions import text as X
from topicweave.operators import corpus, dictionaries, embeddings, lineage, reports, series, tabular
from topicweave.operators.packed import record_terms
from topicweave.plans import queries as base
from topicweave.plans.queries import CLEAN, SERIES, TERMS, TOKENS, query
from topicweave.plans.stage import scratch, stage
from topicweave.sources import files
from topicweave.sources.tables import table
from topicweave.streaming import series as streams

# ---- segmentation ------------------------------------------------------------------


def breaks_sql(points: str, limit: int, least: float) -> str:
    """The break points of ``points (pos, n)`` as CTEs; they are the inner ends of ``seg``."""
    return f"""seg(a, b) AS (SELECT 0, max(pos) FROM {points} UNION ALL SELECT CASE t WHEN 0 THEN a ELSE m END, CASE t WHEN 0 THEN m ELSE b END FROM (SELECT a, b, arg_min(pos, r) AS m FROM
   (SELECT a, b, pos, far, row_number() OVER (PARTITION BY a, b ORDER BY round(far, 9) DESC, pos) AS r FROM (SELECT a, b, x.pos, abs(x.n - (q.n - p.n) / (b - a) * (x.pos - a) - p.n) / sqrt(1 + ((q.n - p.n) / (b - a)) * ((q.n - p.n) / (b - a))) AS far
     FROM seg JOIN {points} p ON p.pos = a JOIN {points} q ON q.pos = b JOIN {points} x ON x.pos BETWEEN a AND b WHERE b - a + 1 > 4)) WHERE r <= 5 AND far > {least} AND pos - a + 1 > {limit} AND b - a + 1 - (pos - a) > {limit} GROUP BY a, b), unnest([0, 1]) u(t))"""


@query(f"WITH RECURSIVE {SERIES}, {breaks_sql('ps', 3, 10.0)} SELECT DISTINCT CAST(a AS INTEGER) AS pos FROM seg WHERE a > 0")
def segment_breaks(spark, folder):
    numbered = base._monthly(spark, folder).withColumn("pos", F.expr("cast(row_number() over (order by month) - 1 as int)"))
    return series.segment_breaks(numbered.select("pos", "n"), limit=3, least=10.0)


def time_line_sql(points: str, limit: int = 5) -> str:
    return f"""nr AS (SELECT month, n, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS place, count(*) OVER () AS k FROM {points}), inn AS (SELECT place - 12 AS pos, n FROM nr WHERE place >= 12 AND place < k - 6), {breaks_sql('inn', limit, 10.0)},
 en AS (SELECT DISTINCT a + 12 AS place FROM seg WHERE a > 0 UNION SELECT place FROM nr WHERE place = 0 OR place = greatest(0, k - 7)), mo2 AS (SELECT month FROM en JOIN nr USING (place))
 SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS period, month AS lo, lead(month) OVER (ORDER BY month) AS hi FROM mo2) WHERE hi IS NOT NULL"""


@query(f"WITH RECURSIVE {SERIES}, {time_line_sql('ser')}")
def time_line(spark, folder):
    return series.time_line(base._monthly(spark, folder), limit=5)


@query(f"WITH RECURSIVE {SERIES}, nj AS (SELECT * FROM ser WHERE month % 100 <> 1), {time_line_sql('nj')}")
def time_line_without_january(spark, folder):
    return series.time_line(base._monthly(spark, folder), limit=5, remove_big=True)


@query(f"WITH RECURSIVE {SERIES}, b2 AS (SELECT (row_number() OVER (ORDER BY month) - 1) // 2 AS b, * FROM ser), pairs AS (SELECT min(month) AS month, CAST(sum(n) AS BIGINT) AS n FROM b2 GROUP BY b), {time_line_sql('pairs', 3)}")
def time_line_combined(spark, folder):
    return series.time_line(base._monthly(spark, folder), combine=2)


@query(f"WITH {SERIES}, r AS (SELECT *, (row_number() OVER (ORDER BY month) - 1) // 12 AS b FROM ser) SELECT CAST(b AS INTEGER) AS bucket, min(month) AS first_month, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY b")
def twelve_month_rollup(spark, folder):
    return series.bucket_months(base._monthly(spark, folder), 12)


@query(f"WITH {CLEAN} SELECT month, count(*) AS n, list_sort(coalesce(list(DISTINCT journal) FILTER (journal IS NOT NULL), [])) AS values FROM clean GROUP BY month")
def month_journal_lists(spark, folder):
    return reports.lists_by(base._clean(spark, folder), "month", "journal")


@query(f"WITH {SERIES}, b AS (SELECT DISTINCT unnest([lo, hi]) AS month FROM period_bounds) SELECT 'curve' AS label, month, n FROM ser UNION ALL SELECT 'break', month, n FROM ser JOIN b USING (month)")
def curve_with_breaks(spark, folder):
    return reports.curve_with_breaks(base._monthly(spark, folder), table(spark, folder, "period_bounds"))


@query(f"""WITH {CLEAN}, y AS (SELECT month // 100 AS year, count(*) AS n FROM clean GROUP BY 1), k AS (SELECT month // 100 AS year, count(DISTINCT term) AS n FROM (WITH {TERMS} SELECT term, publication_year AS month FROM terms JOIN (SELECT DISTINCT paper_id, publication_year FROM paper_word) USING (paper_id)) GROUP BY 1),
  h AS (SELECT publication_year AS year, count(*) AS n FROM paper_end WHERE publication_year IS NOT NULL AND source_title IS NOT NULL GROUP BY 1),
  b AS (SELECT CAST(year AS INTEGER) AS year, 'keywords' AS name, CAST(n AS DOUBLE) AS n FROM k UNION ALL SELECT CAST(year AS INTEGER), 'papers', n FROM y UNION ALL SELECT CAST(year AS INTEGER), 'harvested', n FROM h)
  SELECT year, name, n, round((n - avg(n) OVER (PARTITION BY name)) / stddev_pop(n) OVER (PARTITION BY name), 6) AS score FROM b""")  # fmt: skip
def three_yearly_series(spark, folder):
    """Papers that have all their fields, keywords, and all papers that journals report, each standardised."""
    year = F.floor(F.col("month") / 100).cast("int").alias("year")
    papers = base._clean(spark, folder).groupBy(year).agg(F.count("*").alias("n"))
    words = base._keywords(spark, folder).groupBy(year).agg(F.count_distinct("term").alias("n"))
    harvested = base.nested_map_sum(spark, folder)
    return reports.yearly_contrast(papers=papers, keywords=words, harvested=harvested).withColumn("score", F.round("score", 6))


# ---- phrases and tokens ------------------------------------------------------------


def _phrases(spark, folder) -> DataFrame:
    words = table(spark, folder, "paper_word").select("paper_id", "keyword_plus").distinct()
    return record_terms(words, "paper_id", "keyword_plus").select("paper_id", F.array_distinct(F.transform("terms", lambda t: F.replace(t, F.lit(" "), F.lit("_")))).alias("phrases"))


# runs twice: neighbours may share the mark between them
_JOIN = r"regexp_replace(acc, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(replace(p, '_', ' ')) || '($|[^\p{L}\p{N}_])', '\1' || p || '\2', 'g')"


@query(rf"""WITH {TERMS}, ph AS (SELECT paper_id, list(DISTINCT replace(term, ' ', '_')) AS l FROM terms GROUP BY 1), tx AS (SELECT DISTINCT paper_id, keyword_plus, lower(concat_ws(' ', article_title, abstract)) AS t FROM paper_word),
  pt AS (SELECT paper_id, t, list_filter(list_transform(list_sort(list_transform(l, lambda p: {{'n': -length(p), 'p': p}})), lambda x: x.p), lambda p: contains(p, '_')) AS l FROM tx LEFT JOIN ph USING (paper_id))
  SELECT paper_id, list_reduce(list_prepend(t, coalesce(l, [])), lambda acc, p: {_JOIN.replace('acc', _JOIN)}) AS text FROM pt""")  # fmt: skip
def phrase_merge(spark, folder):
    words = table(spark, folder, "paper_word").select("paper_id", "keyword_plus", "article_title", "abstract").distinct()
    texts = words.select("paper_id", F.concat_ws(" ", "article_title", "abstract").alias("text")).join(_phrases(spark, folder), "paper_id")
    return texts.select("paper_id", X.merge_phrases(F.lower("text"), F.col("phrases")).alias("text"))


@query(f"""WITH {TOKENS}, nx AS (SELECT paper_id, token, lead(token) OVER (PARTITION BY paper_id, s ORDER BY pos) AS n FROM tok), p AS (SELECT paper_id, token AS phrase FROM nx UNION ALL SELECT paper_id, token || '_' || n FROM nx WHERE n IS NOT NULL),
  c AS (SELECT paper_id, phrase, count(*) AS tf FROM p GROUP BY ALL), d AS (SELECT phrase, count(*) AS df FROM c GROUP BY 1), t AS (SELECT count(DISTINCT paper_id) AS docs FROM paper_word), r AS (SELECT paper_id, phrase, tf * ln((docs + 1) / (df + 1)) AS score FROM c JOIN d USING (phrase), t)
  SELECT paper_id, phrase, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC, phrase) AS rank FROM r) WHERE rank <= 3""")  # fmt: skip
def top_phrases(spark, folder):
    return corpus.ranked_phrases(table(spark, folder, "paper_word").select("paper_id", "title_abstract").distinct(), "paper_id", "title_abstract", 3).withColumn("score", F.round("score", 6))


LENGTHS = f"""{TOKENS}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token), k AS (SELECT token, least(1.0, sqrt(0.0001 / (n / sum(n) OVER ()))) AS keep FROM c),
  dr AS (SELECT paper_id, CAST(s - first AS INTEGER) AS sent, pos - 1 AS pos, token FROM (SELECT *, 0 AS first FROM (SELECT paper_id, dense_rank() OVER (PARTITION BY paper_id ORDER BY s) - 1 AS s, pos, token FROM tok))),
  ln AS (SELECT paper_id, sent, count(*) AS before, count(*) FILTER (('0x' || substr(md5(paper_id || '|' || sent || '|' || pos || '|3'), 1, 8))::BIGINT / 4294967296.0 < keep) AS after FROM dr JOIN k USING (token) GROUP BY ALL)"""


@query(f"WITH {LENGTHS} SELECT * FROM ln")
def sampled_lengths(spark, folder):
    return corpus.sentence_lengths(base._tokens(spark, folder))


@query(f"WITH {LENGTHS}, f AS (SELECT *, row_number() OVER (ORDER BY paper_id, sent) AS place FROM ln ORDER BY paper_id, sent LIMIT 40) SELECT CAST(place AS INTEGER) AS place, 'before' AS kind, before AS tokens FROM f UNION ALL SELECT CAST(place AS INTEGER), 'after', after FROM f")
def sampled_lengths_report(spark, folder):
    return corpus.long_lengths(corpus.sentence_lengths(base._tokens(spark, folder)))


@query(f"""WITH {TOKENS}, p AS (SELECT token AS x, lead(token) OVER (PARTITION BY paper_id, s ORDER BY pos) AS y FROM tok), pairs AS (SELECT DISTINCT x AS centre, y AS context FROM p WHERE y IS NOT NULL), c AS (SELECT token, pow(count(*), 0.75) AS w FROM tok GROUP BY token),
  sh AS (SELECT token, w / sum(w) OVER () AS p FROM c), li AS (SELECT token, p, sum(p) OVER (ORDER BY substr(md5(token), 1, 2), token) AS hi FROM sh), tu AS (SELECT centre, context, t, ('0x' || substr(md5(centre || '|' || context || '|' || t || '|9'), 1, 8))::BIGINT / 4294967296.0 AS u FROM pairs, unnest([0, 1]) v(t))
  SELECT centre, context, CAST(t AS INTEGER) AS turn, token AS negative FROM tu ASOF JOIN li ON u < hi""")  # fmt: skip
def negative_draws(spark, folder):
    """Two negatives for every pair of neighbouring words."""
    tokens = base._tokens(spark, folder)
    pairs = corpus.window_pairs(tokens, ["paper_id", "sent"], 1).select(F.col("token").alias("centre"), F.col("other").alias("context")).distinct()
    return corpus.negative_draws(pairs, corpus.negative_weights(tokens.groupBy("token").agg(F.count("*").alias("n"))))


@query(f"WITH {TERMS}, p AS (SELECT DISTINCT replace(term, ' ', '_') AS p FROM terms), w AS (SELECT DISTINCT p, unnest(string_split(p, '_')) AS word FROM p) SELECT word, list_sort(list(p)) AS phrases FROM w WHERE word <> '' GROUP BY word")
def inverted_index(spark, folder):
    return dictionaries.inverted_index(_phrases(spark, folder).select(F.explode("phrases").alias("phrase")), "phrase")


@query(f"WITH {TOKENS}, p AS (SELECT DISTINCT replace(term, ' ', '_') AS p FROM (WITH {TERMS} SELECT term FROM terms)), w AS (SELECT DISTINCT p, unnest(string_split(p, '_')) AS token FROM p), i AS (SELECT token, count(*) AS n FROM w GROUP BY 1), t AS (SELECT token, count(*) AS times FROM tok GROUP BY 1) SELECT token, times, coalesce(n, 0) AS phrases FROM t LEFT JOIN i USING (token)")
def phrases_of_tokens(spark, folder):
    """Each token with the number of keyword phrases it may be part of, 0 by default."""
    counts = base._tokens(spark, folder).groupBy("token").agg(F.count("*").alias("times"))
    index = dictionaries.inverted_index(_phrases(spark, folder).select(F.explode("phrases").alias("phrase")), "phrase")
    return dictionaries.phrases_of(counts, "token", index).select("token", "times", F.size("phrases").cast("bigint").alias("phrases"))


@query(r"""WITH s AS (SELECT list(DISTINCT lower(trim(word))) AS l FROM stopword WHERE word IS NOT NULL)
  SELECT paper_id, list_aggregate(list_filter(string_split_regex(trim(regexp_replace(abstract, '\s+', ' ', 'g')), ' '), lambda w: NOT list_contains(s.l, lower(w))), 'string_agg', ' ') AS text FROM paper_end, s WHERE abstract IS NOT NULL AND trim(regexp_replace(abstract, '\s+', ' ', 'g')) <> ''""")  # fmt: skip
def raw_stop_words(spark, folder):
    """Abstracts less the stop words; the list is a table of fixed size, folded into one row."""
    stop = table(spark, folder, "stopword").filter("word is not null").agg(F.collect_set(F.lower(F.trim("word"))).alias("_stop"))
    rows = table(spark, folder, "paper_end").select("paper_id", F.trim(F.regexp_replace("abstract", r"\s+", " ")).alias("abstract")).filter("abstract is not null and abstract <> ''")
    return rows.crossJoin(F.broadcast(stop)).select("paper_id", F.nullif(dictionaries.without_stop_words(F.col("abstract"), F.col("_stop")), F.lit("")).alias("text"))


@query(r"""WITH t AS (SELECT DISTINCT word FROM stopword WHERE word IS NOT NULL), c AS (SELECT word, list_filter(string_split_regex(lower(word), '[\s_]+'), lambda w: regexp_matches(w, '^(\p{L}|_)+$|^(\p{L}|\.)+$') AND regexp_matches(w, '\p{L}')) AS l FROM t),
  m AS (SELECT word, list_transform(l, lambda w: CASE WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, '[^aeiou]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '')
    WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END) AS l FROM c)
  SELECT word, CASE WHEN len(l) > 0 THEN list_aggregate(l, 'string_agg', '_') END AS phrase FROM m""")  # fmt: skip
def keyword_phrases(spark, folder):
    """Words of the stop-word table as normalised phrases: lower case, shaped tokens, singular."""
    return table(spark, folder, "stopword").filter("word is not null").select("word").distinct().select("word", X.phrase(F.col("word"), lemmas=True).alias("phrase"))


# ---- dictionary layouts ------------------------------------------------------------


@query("SELECT DISTINCT word, string_split(synonyms, ',') AS synonyms FROM synonym WHERE word IS NOT NULL AND synonyms IS NOT NULL AND NOT contains(word, ',') AND synonyms <> ''")
def keyed_lines(spark, folder):
    path = scratch(spark)
    rows = table(spark, folder, "synonym").filter("synonyms <> '' and not contains(word, ',')").select("word", "synonyms").distinct()
    rows.select(F.concat_ws(",", "word", "synonyms").alias("value")).write.text(path)
    return dictionaries.keyed_lines(spark.read.text(path))


@query("SELECT DISTINCT word, coalesce(list_filter(string_split(trim(synonyms, '\"'), ', '), lambda s: s <> ''), []) AS synonyms FROM synonym WHERE word IS NOT NULL AND word <> ''")
def listed_columns(spark, folder):
    """A table without header, written and read again; a null column adds nothing."""
    path = scratch(spark)
    table(spark, folder, "synonym").filter("word <> ''").select("word", "synonyms", F.lit(None).cast("string").alias("more")).distinct().write.option("escape", '"').csv(path)
    return dictionaries.listed_columns(files.read_bare_csv(spark, path, "c0 string, c1 string, c2 string"), "c0", "c1", "c2")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word")
def delimited_terms(spark, folder):
    path = scratch(spark)
    table(spark, folder, "part").select(F.col("p_name").alias("value")).write.text(path)
    return dictionaries.delimited_terms(spark.read.text(path), " ").groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT origin, word FROM (SELECT origin, trim(word, ' ,-') AS word, row_number() OVER (PARTITION BY origin ORDER BY word) AS r FROM (SELECT DISTINCT origin, word FROM stopword WHERE origin IS NOT NULL AND word IS NOT NULL)) WHERE r > 1 AND word <> ''")
def nested_json_terms(spark, folder):
    """Words out of JSON documents that hold them some levels down, the first of each left out."""
    words = table(spark, folder, "stopword").filter("origin is not null and word is not null").select("origin", "word").distinct()
    objects = F.transform(F.array_sort(F.collect_list("word")), lambda w: F.struct(w.alias("c")))
    docs = words.groupBy("origin").agg(F.to_json(F.create_map(F.lit("document.xml"), F.array(F.struct(F.array(F.struct(objects.alias("c"))).alias("c"))))).alias("doc"))
    path = scratch(spark)
    docs.write.json(path)
    back = spark.read.schema("origin string, doc string").json(path)
    found = None
    for origin in [r[0] for r in back.select("origin").orderBy("origin").collect()]:  # one document per dictionary
        part = dictionaries.nested_terms(back.filter(F.col("origin") == origin), "doc", "$['document.xml'][0].c[0].c", skip=1, edges=" ,-").select(F.lit(origin).alias("origin"), "word")
        found = part if found is None else found.unionByName(part)
    return found


@query("SELECT word FROM (SELECT DISTINCT lower(trim(word)) AS word FROM stopword WHERE word IS NOT NULL AND trim(word) <> '' AND NOT regexp_matches(word, '[^\\x00-\\x7F]')) WHERE word NOT IN ('the', 'and') UNION ALL SELECT 'added term'")
def patched_words(spark, folder):
    return dictionaries.patched(dictionaries.stop_words(table(spark, folder, "stopword"), "word"), "word", ["the", "and"], ["added term"])


@query("SELECT word, list(synonyms) AS synonyms FROM (SELECT DISTINCT word, synonyms FROM synonym WHERE word IS NOT NULL AND synonyms IS NOT NULL ORDER BY synonyms) GROUP BY word")
def json_lines(spark, folder):
    path = scratch(spark)
    rows = table(spark, folder, "synonym").filter("word is not null and synonyms is not null").groupBy("word").agg(F.array_sort(F.collect_set("synonyms")).alias("synonyms"))
    rows.write.json(path)
    return files.read_json_lines(spark, path, "word string, synonyms array<string>").select("word", F.array_sort("synonyms").alias("synonyms"))


@query("SELECT paper_id, regexp_replace(regexp_replace(article_title, '\\s+', ' ', 'g'), '[<>]', '', 'g') AS word FROM paper_end WHERE article_title IS NOT NULL")
def three_line_records(spark, folder):
    """Records of three lines (a key, its page, a line to skip), written to one file per partition and read by line."""
    path = scratch(spark)
    title = F.regexp_replace(F.regexp_replace("article_title", r"\s+", " "), "[<>]", "")
    rows = table(spark, folder, "paper_end").filter("article_title is not null").select(F.array(F.col("paper_id").cast("string"), F.concat(F.lit("<div class='form'><span class='orth'>"), title, F.lit("</span></div>")), F.lit("skip")).alias("l"))
    rows.select(F.array_join("l", "\n").alias("value")).write.text(path)
    records = dictionaries.three_line_records(files.read_three_line(spark, path))
    return records.select(F.col("word").cast("bigint").alias("paper_id"), F.element_at(X.html_fields(F.col("html"), "span"), 1).alias("word"))


@query("SELECT DISTINCT replace(replace(word, ' ', '_'), '_', ' ') AS word FROM stopword WHERE word IS NOT NULL")
def spaced_words(spark, folder):
    return table(spark, folder, "stopword").filter("word is not null").select(X.spaced(F.replace("word", F.lit(" "), F.lit("_"))).alias("word")).distinct()


@query("SELECT CAST(paper_id AS VARCHAR) AS title, publication_year AS year FROM paper_end WHERE article_title IS NOT NULL")
def papers_from_csv(spark, folder):
    """Papers written as CSV with a number in front, read with the paper schema and without it."""
    path = scratch(spark)
    rows = table(spark, folder, "paper_end").filter("article_title is not null")
    named = rows.select(F.col("authors").alias("Authors"), F.col("author_full_names").alias("Author Full Names"), F.col("paper_id").cast("string").alias("Article Title"), F.col("author_keywords").alias("Author Keywords"), F.col("keywords_plus").alias("Keywords Plus"),
                        F.col("abstract").alias("Abstract"), F.col("publication_year").alias("Publication Year"), F.col("publication_date").alias("Publication Date"), F.col("source_title").alias("Source Title"), F.col("doi").alias("DOI"))
    files.write_csv(named, path, index=True)
    return files.read_papers(spark, path, index=True).select(F.col("Article Title").alias("title"), F.col("Publication Year").alias("year"))


# ---- lineage reports ---------------------------------------------------------------


@query("WITH n AS (SELECT DISTINCT word FROM community WHERE period = 0), e AS (SELECT DISTINCT a.word AS src, b.word AS dst FROM community a JOIN community b ON a.period = b.period AND a.comm = b.comm AND a.word < b.word) SELECT src, dst FROM e WHERE src IN (SELECT word FROM n) AND dst IN (SELECT word FROM n)")
def chosen_subgraph(spark, folder):
    members = table(spark, folder, "community").select("period", "comm", "word").distinct()
    edges = members.withColumnRenamed("word", "src").join(members.withColumnRenamed("word", "dst"), ["period", "comm"]).filter("src < dst").select("src", "dst").distinct()
    return reports.subgraph_of(edges, members.filter("period = 0").select(F.col("word").alias("id")))


COLOURS = f"""{base.ROLES}, {base.EVENTS}, cd AS (SELECT 'comm' || comm || '-' || period AS id, max(CASE event WHEN 'new_born' THEN 1 WHEN 'die_out' THEN 2 WHEN 'inherit' THEN 3 WHEN 'divide' THEN 4 WHEN 'merge' THEN 5 ELSE 6 END) AS code FROM life GROUP BY period, comm),
 n1 AS (SELECT 'comm' || comm || '-' || period AS id, CAST(period AS DOUBLE) AS "group", count(DISTINCT word) AS score FROM mc GROUP BY period, comm UNION ALL SELECT 'mix' || mix || '-' || mix_period || '.5', mix_period + 0.5, len(old) + len(new) FROM lists),
 cn AS (SELECT id, "group", CAST(score AS BIGINT) AS score, CAST(CASE WHEN id LIKE 'mix%' THEN 7 ELSE coalesce(code, 8) END AS INTEGER) AS code, CASE WHEN id LIKE 'mix%' THEN 200 ELSE CAST(score AS BIGINT) * 20 END AS size FROM n1 LEFT JOIN cd USING (id))"""


def _coloured(spark, folder) -> tuple[DataFrame, DataFrame]:
    members, mixes = map(stage, base._roles(spark, folder))
    links = stage(lineage.link_by_overlap(members, mixes))
    lists = stage(lineage.mix_links(links, mixes))
    nodes = lineage.evolution_nodes(members.withColumn("comm", F.col("comm").cast("bigint")), links, lists)
    return reports.coloured_nodes(nodes, lineage.event_codes(lineage.lifecycle(lists))), lineage.evolution_edges(links)


@query(f"WITH {COLOURS} SELECT * FROM cn")
def coloured_nodes(spark, folder):
    return _coloured(spark, folder)[0]


@query(f"WITH {COLOURS}, el AS (SELECT CASE side WHEN 'old' THEN 'comm' || comm || '-' || period ELSE 'mix' || mix || '-' || mix_period || '.5' END AS src, CASE side WHEN 'old' THEN 'mix' || mix || '-' || mix_period || '.5' ELSE 'comm' || comm || '-' || period END AS dst, overlap AS weight, 'comm' || comm || '-' || period AS id FROM links) SELECT src, dst, weight, code FROM el JOIN cn USING (id)")
def coloured_edges(spark, folder):
    nodes, edges = _coloured(spark, folder)
    return reports.coloured_edges(edges, nodes)


@query('SELECT id, "group", score, kind, number, period FROM (SELECT *, regexp_extract(id, \'^([a-z]+)\', 1) AS kind, CAST(regexp_extract(id, \'^[a-z]+(\\d+)-\', 1) AS INTEGER) AS number, CAST(floor("group") AS INTEGER) AS period FROM (WITH ' + COLOURS + " SELECT * FROM cn))")
def graph_files(spark, folder):
    """Evolution nodes written as GraphML, read again, and their identifiers taken apart."""
    nodes, edges = _coloured(spark, folder)
    path = f"{scratch(spark)}.graphml"
    files.write_graphml(nodes.select("id", "group", "score"), edges, path)
    back, _ = files.read_graphml(spark, path)
    rows = back.select("id", F.col("attributes")["group"].cast("double").alias("group"), F.col("attributes")["score"].cast("bigint").alias("score"))
    return lineage.parse_node_id(rows, "id")


@query("SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY user_id")
def last_event(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("written"))
    return lineage.last_write(rows, "user_id", "written").select("user_id", "event_id")


@query("""WITH s AS (SELECT period, comm, list(DISTINCT word) AS w FROM community GROUP BY ALL), k AS (SELECT period || '-' || comm AS id, w FROM s)
  SELECT a.id, b.id AS "by" FROM k a JOIN k b ON a.id <> b.id AND list_has_all(b.w, a.w) WHERE len(a.w) < len(b.w) OR b.id < a.id""")  # fmt: skip
def covered_sets(spark, folder):
    sets = table(spark, folder, "community").groupBy(F.concat_ws("-", "period", "comm").alias("id")).agg(F.collect_set("word").alias("words"))
    return reports.covered_sets(sets, "id", "words")


# ---- model inputs and outputs ------------------------------------------------------


@query("SELECT vec_id, CAST(i AS INTEGER) AS start, list_transform(embedding[i + 1:i + 16], lambda x: round(CAST(x AS DOUBLE), 5)) AS part FROM embeddings, unnest(range(0, len(embedding) - 15, 8)) u(i)")
def subsequences(spark, folder):
    parts = tabular.subsequences(table(spark, folder, "embeddings"), "vec_id", "embedding", 16, 8)
    return parts.withColumn("part", F.transform("part", lambda x: F.round(x.cast("double"), 5)))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_returnflag")
def linear_fit(spark, folder):
    return tabular.linear_fit(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 3), "n": F.col("n").cast("bigint")})


@query("SELECT reviewer, count(toxic) AS n, round(avg(CASE WHEN toxic IS NOT NULL THEN CAST(toxic = 0 AS INTEGER) END), 6) AS accuracy FROM doc_labels GROUP BY reviewer")
def label_accuracy(spark, folder):
    """How often a reviewer's label is the more frequent one."""
    return tabular.accuracy(table(spark, folder, "doc_labels"), F.lit(0), F.col("toxic"), ["reviewer"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT event_id, [CAST(event_type = c AS INTEGER) FOR c IN ['click', 'error', 'view']] AS code, ['zero', 'one', 'two'][CAST(event_id % 4 AS INTEGER) + 1] AS name FROM events")
def class_codes(spark, folder):
    return table(spark, folder, "events").select("event_id", tabular.one_hot(F.col("event_type"), ["click", "error", "view"]).alias("code"), tabular.label_name((F.col("event_id") % 4).cast("int"), ["zero", "one", "two"]).alias("name"))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def standard_columns(spark, folder):
    scored = tabular.standard_columns(table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return scored.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


CODES = f"{TOKENS}, v AS (SELECT token FROM tok GROUP BY token HAVING count(*) >= 5), vc AS (SELECT token, row_number() OVER (ORDER BY substr(md5(token), 1, 2), token) AS code FROM v)"


@query(f"WITH {CODES}, s AS (SELECT paper_id, s, list(coalesce(code, 0) ORDER BY pos) AS l FROM tok LEFT JOIN vc USING (token) GROUP BY ALL), n AS (SELECT paper_id, dense_rank() OVER (PARTITION BY paper_id ORDER BY s) - 1 AS sent, l FROM s) SELECT paper_id, CAST(sent AS INTEGER) AS sent, CAST(list_resize(l, 20, 0) AS INTEGER[]) AS codes FROM n")
def padded_sentences(spark, folder):
    """Sentences as 20 numbers of their tokens each, 0 for rare ones and at the end."""
    tokens = stage(base._tokens(spark, folder))
    codes = tabular.token_codes(tokens.groupBy("token").agg(F.count("*").alias("n")))
    rows = tokens.join(codes, "token", "left").groupBy("paper_id", "sent").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("code", F.lit(0)).alias("code")))).alias("_l"))
    return rows.select("paper_id", "sent", tabular.padded(F.col("_l.code"), 20, 0).alias("codes"))


@query("SELECT i AS vec_id, coalesce(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 5)), list_resize([]::DOUBLE[], 64, 0.0)) AS vector FROM unnest(range(0, 700)) u(i) LEFT JOIN embeddings ON vec_id = i")
def looked_up_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("word"), F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("vector"))
    return tabular.looked_up(spark.range(700).select(F.col("id").alias("vec_id")), "vec_id", vectors, 64)


@query("SELECT vec_id, label, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 5)) AS embedding FROM embeddings")
def saved_vectors(spark, folder):
    """Vectors written and read again."""
    path = scratch(spark)
    embeddings.save_vectors(table(spark, folder, "embeddings"), path)
    return embeddings.load_vectors(spark, path).withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)))


BOXES = "ex AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), bx AS (SELECT vec_id, label, [e[1], e[2], e[1] + abs(e[3]) * 4, e[2] + abs(e[4]) * 4] AS box, e[5] AS score FROM ex)"
IOU = "(greatest(least({a}[3], {b}[3]) - greatest({a}[1], {b}[1]), 0) * greatest(least({a}[4], {b}[4]) - greatest({a}[2], {b}[2]), 0))"
AREA = "(({x}[3] - {x}[1]) * ({x}[4] - {x}[2]))"


def _boxes(spark, folder) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, folder, "embeddings").select("vec_id", "label", F.array(e(0), e(1), e(0) + F.abs(e(2)) * 4, e(1) + F.abs(e(3)) * 4).alias("box"), e(4).alias("score"))


@query(f"WITH {BOXES}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, {IOU.format(a='a.box', b='b.box')} AS i, {AREA.format(x='a.box')} + {AREA.format(x='b.box')} AS s FROM bx a JOIN bx b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, round(i / (s - i), 6) AS overlap FROM p WHERE i > 0")
def box_overlaps(spark, folder):
    boxes = _boxes(spark, folder)
    pairs = boxes.select("label", F.col("vec_id").alias("a"), F.col("box").alias("x")).join(boxes.select("label", F.col("vec_id").alias("b"), F.col("box").alias("y")), "label").filter("a < b")
    return pairs.select("a", "b", tabular.box_overlap(F.col("x"), F.col("y")).alias("overlap")).filter("overlap > 0").withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM bx), k(label, r, kept) AS (SELECT label, 0::BIGINT, []::STRUCT(v BIGINT, b DOUBLE[])[] FROM o GROUP BY label
  UNION ALL SELECT o.label, o.r, CASE WHEN len(list_filter(kept, lambda q: {IOU.format(a='q.b', b='o.box')} > 0.5 * ({AREA.format(x='q.b')} + {AREA.format(x='o.box')} - {IOU.format(a='q.b', b='o.box')}))) = 0 THEN list_append(kept, {{'v': o.vec_id, 'b': o.box}}) ELSE kept END FROM k JOIN o ON o.label = k.label AND o.r = k.r + 1)
  SELECT label, x.v AS vec_id FROM (SELECT label, unnest(kept) AS x FROM (SELECT *, max(r) OVER (PARTITION BY label) AS m FROM k) WHERE r = m)""")  # fmt: skip
def kept_boxes(spark, folder):
    return tabular.kept_boxes(_boxes(spark, folder), "label", "vec_id", "box", "score")


# ---- streams -----------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_events(spark, folder):
    """Daily counts from a stream of the table's files; an event that is late by no means closes the last windows."""
    source = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    copy, state = scratch(spark), scratch(spark)
    source.write.parquet(copy)
    counts = streams.windowed_counts(spark.readStream.schema(source.schema).parquet(copy), "ts", "event_type")
    streams.write_available(counts, f"{state}/out", f"{state}/state").awaitTermination()
    streams.closing_row(source, "ts").write.mode("append").parquet(copy)
    streams.write_available(counts, f"{state}/out", f"{state}/state").awaitTermination()
    return spark.read.schema("start timestamp, end timestamp, event_type string, n bigint").parquet(f"{state}/out")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_first_seen(spark, folder):
    """Each user and kind of event once, from a stream."""
    source = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    copy, state = scratch(spark), scratch(spark)
    source.write.parquet(copy)
    once = streams.first_seen(spark.readStream.schema(source.schema).parquet(copy), ["user_id", "event_type"], "ts", late="400 days").select("user_id", "event_type")
    streams.write_available(once, f"{state}/out", f"{state}/state").awaitTermination()
    return spark.read.schema("user_id bigint, event_type string").parquet(f"{state}/out")


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), n AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, s""")  # fmt: skip
def user_sessions(spark, folder):
    return streams.sessions(table(spark, folder, "events"), "ts", "user_id")
