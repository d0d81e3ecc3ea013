"""Queries of this package and, where SQL can say them, their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicweave.llm.enrichment import distinctive_terms
from topicweave.llm.frequency import term_frequency
from topicweave.llm.leakage import leaked_items
from topicweave.llm.mixture import merged_copies, mix_sources, normal_source, token_counts
from topicweave.llm.names import link_names, variant_pairs
from topicweave.llm.neardup import duplicate_classes, near_duplicates, similar_pairs
from topicweave.llm.pairs import item_pairs
from topicweave.llm.toxicity import source_rates, toxicity_scores
from topicweave.operators.packed import record_terms
from topicweave.plans.packed_sql import packed_sql
from topicweave.plans.queries import TERMS
from topicweave.plans.stage import stage
from topicweave.sources.tables import table


def _keyword_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each paper of paper_word once, with its terms."""
    papers = table(spark, folder, "paper_word").select("paper_id", "keyword_plus").distinct()
    terms = record_terms(papers, "paper_id", "keyword_plus")
    # rows of one paper that differ are one record still
    return terms.groupBy("paper_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))


def _term_records(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    words = table(spark, folder, "paper_end").select("paper_id", F.regexp_extract_all(F.lower("abstract"), F.lit("[a-z]+"), F.lit(0)).alias("terms"))
    return {"keyword_plus": _keyword_records(spark, folder), "abstract": words}


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that set a record apart at a false-discovery rate of 5 percent, with their scores."""
    out = None
    for field, records in _term_records(spark, folder).items():
        scored = distinctive_terms(records, "paper_id", "terms").filter(F.col("score") >= -math.log(0.05))
        part = scored.select(F.lit(field).alias("field"), F.col("record").alias("paper_id"), "term", "n_in_record", "record_size", "n", F.round("neg_log_p", 4).alias("neg_log_p"), F.round("score", 4).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for field, records in _term_records(spark, folder).items():
        scored = distinctive_terms(records, "paper_id", "terms", min_count=3 if field == "abstract" else 1, min_records=2, max_records=12)
        part = scored.select(F.lit(field).alias("field"), F.col("record").alias("paper_id"), "term")
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = item_pairs(_keyword_records(spark, folder), "paper_id", "terms", min_count=5)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.filter(big("n") * big("n_records") >= 5 * big("n_a") * big("n_b")).select("term_a", "term_b")


def _similar_papers(spark: SparkSession, folder: str, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, folder, "paper_end").filter(F.trim("abstract") != "")
    return near_duplicates(papers, "paper_id", F.concat_ws(" ", "article_title", "abstract"), width, least)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = _similar_papers(spark, folder, width=3, least=0.5)
    return similar_pairs(members, links).select(F.col("a").alias("paper_id_a"), F.col("b").alias("paper_id_b"))


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its count, the number of papers that hold it, and its mark."""
    authors = record_terms(table(spark, folder, "paper_end"), "paper_id", "author_keywords")
    out = None
    for field, records in (("author_keywords", authors), ("keyword_plus", _keyword_records(spark, folder))):
        part = term_frequency(records, "paper_id", "terms", rare_below=3, common_above=0.05).select(F.lit(field).alias("field"), "term", "n", "records", "mark")
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_terms(spark, folder).filter("mark <> 'useful'").select("field", "term", "mark")


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The bounded form of :func:`p4_found`: each paper once, with its class and the number of similar classes."""
    return duplicate_classes(*_similar_papers(spark, folder, width=3, least=0.5)).select(F.col("doc").alias("paper_id"), "class", "links")


def p4_classes_of_five(spark: SparkSession, folder: str) -> DataFrame:
    """The same for series of five words and a similarity of 0.8."""
    return duplicate_classes(*_similar_papers(spark, folder, width=5, least=0.8)).select(F.col("doc").alias("paper_id"), "class", "links")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(link_names(table(spark, folder, "paper_end")))


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with its entity."""
    return link_names(table(spark, folder, "paper_end"))


def p6_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with its occurrences and the number of entities it is put into, one."""
    return link_names(table(spark, folder, "paper_end")).groupBy("spelling").agg(F.sum("n").alias("n"), F.count_distinct("entity").alias("entities"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text", run=12)
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each item that leaked: in how many documents, and the largest part of it in one of them."""
    leaks = leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text", run=12)
    return leaks.groupBy("item").agg(F.count("*").alias("documents"), F.max(F.col("shared") / F.col("total")).alias("containment")).withColumnRenamed("item", "item_id")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = token_counts(table(spark, folder, "documents"), "doc_id", "text", "source")
    sized = stage(sized.select("doc", "tokens", F.array_compact(F.array(normal_source(F.col("source")))).alias("sources")))
    return mix_sources(sized, table(spark, folder, "mix_target"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1].filter("short").select("recipe", "source")


def _shares(selection: DataFrame, report: DataFrame) -> DataFrame:
    reached = selection.groupBy("recipe", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    full = F.sum("target_tokens").over(Window.partitionBy("recipe"))  # a recipe has as many rows as sources
    none = lambda c: F.coalesce(c, F.lit(0))
    return report.join(reached, ["recipe", "source"], "left").select(
        "recipe", "source", "target_tokens", "available_tokens", none("tokens").alias("tokens"), (none("tokens") / full).alias("share"), (F.col("target_tokens") / full).alias("target_share"),
        none("documents").alias("documents"), none("most_uses").alias("most_uses"), "short",
    )


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the selected documents reach, beside the targets."""
    return _shares(*_mixed(spark, folder))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a source falls short, and whether its selection keeps the repeat limit and reaches what it can, but for one document at each end of a range."""
    shares = stage(p8_shares(spark, folder))
    targets = table(spark, folder, "mix_target").select("recipe", "source", "max_repeat")
    largest = token_counts(table(spark, folder, "documents"), "doc_id", "text").agg(F.max("tokens").alias("largest"))  # one row
    near = F.abs(F.col("tokens") - F.col("available_tokens")) <= 2 * F.col("max_repeat") * F.col("largest")
    rows = shares.join(targets, ["recipe", "source"]).crossJoin(F.broadcast(largest))
    return rows.select("recipe", "source", "short", (near & (F.col("most_uses") <= F.col("max_repeat"))).alias("kept"))


def p8_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the copies of a text as one document that belongs to all its sources: these overlap, and the flow divides what they share."""
    documents = table(spark, folder, "documents").withColumn("digest", F.sha2("text", 256))
    merged = stage(merged_copies(token_counts(documents, "doc_id", "text", "source", "digest")))
    return _shares(*mix_sources(merged, table(spark, folder, "mix_target")))


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    scores = toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))
    return scores.filter("flagged").select(F.col("doc").alias("doc_id"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return source_rates(toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "doc_labels"), keep=("source",)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_scores, p2_found, p4_found, p4_classes, p4_classes_of_five, p5_found, p5_terms, p6_found, p6_entities, p6_spellings, p7_found, p7_items, p8_found, p8_shares, p8_checks, p8_overlap, p8_selection, p9_found, p9_rates)
    return {f.__name__: f for f in own}


RECORDS = f"{TERMS}, k AS (SELECT DISTINCT paper_id, term FROM terms), kd AS (SELECT term, count(*) AS d FROM k GROUP BY term)"

P1 = rf"""WITH {RECORDS}, w AS (SELECT paper_id, unnest(regexp_extract_all(lower(abstract), '[a-z]+')) AS term FROM paper_end),
 wc AS (SELECT paper_id, term, count(*) AS n FROM w GROUP BY ALL), wd AS (SELECT term, count(*) AS d FROM wc GROUP BY term)
SELECT 'keyword_plus' AS field, paper_id, term FROM k JOIN kd USING (term) WHERE d BETWEEN 2 AND 12
UNION ALL SELECT 'abstract', paper_id, term FROM wc JOIN wd USING (term) WHERE n >= 3 AND d BETWEEN 2 AND 12"""

P1_SCORES = rf"""WITH {RECORDS}, e AS (SELECT 'keyword_plus' AS field, paper_id, term FROM terms UNION ALL SELECT 'abstract', paper_id, unnest(regexp_extract_all(lower(abstract), '[a-z]+')) FROM paper_end),
 c AS (SELECT field, paper_id, term, count(*) AS k FROM e GROUP BY ALL), s AS (SELECT *, sum(k) OVER (PARTITION BY field, paper_id) AS d, sum(k) OVER (PARTITION BY field, term) AS m, sum(k) OVER (PARTITION BY field) AS t FROM c),
 p AS (SELECT *, ln(list_sum(list_transform(range(k, CAST(least(m, d) AS BIGINT) + 1), lambda x: exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1)
   + CASE WHEN t - m < d - x THEN -1e9 ELSE lgamma(t - m + 1) - lgamma(d - x + 1) - lgamma(greatest(t - m - d + x, 0) + 1) END - lgamma(t + 1) + lgamma(d + 1) + lgamma(t - d + 1))))) AS lp FROM s),
 r AS (SELECT *, lp + ln(count(*) OVER w / row_number() OVER (PARTITION BY field, paper_id ORDER BY lp, term)) AS lq FROM p WINDOW w AS (PARTITION BY field, paper_id)),
 q AS (SELECT *, -least(0, min(lq) OVER (PARTITION BY field, paper_id ORDER BY lp, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS score FROM r)
SELECT field, paper_id, term, k AS n_in_record, CAST(d AS BIGINT) AS record_size, CAST(m AS BIGINT) AS n, round(-least(lp, 0), 4) AS neg_log_p, round(score, 4) AS score FROM q WHERE score >= -ln(0.05)"""

P2 = f"""WITH {RECORDS}, r AS (SELECT count(DISTINCT paper_id) AS r FROM k), p AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n FROM k a JOIN k b ON a.paper_id = b.paper_id AND a.term < b.term GROUP BY ALL)
SELECT term_a, term_b FROM p JOIN kd x ON x.term = term_a JOIN kd y ON y.term = term_b, r WHERE n >= 5 AND n * r >= 5 * x.d * y.d"""

P4 = r"""WITH d AS (SELECT paper_id, regexp_extract_all(lower(coalesce(article_title, '') || ' ' || abstract), '[a-z0-9]+') AS w FROM paper_end WHERE trim(abstract) <> ''),
 t AS (SELECT DISTINCT paper_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d),
 s AS (SELECT paper_id, count(*) AS n FROM t GROUP BY paper_id), p AS (SELECT a.paper_id AS a, b.paper_id AS b, count(*) AS o FROM t a JOIN t b ON a.g = b.g AND a.paper_id < b.paper_id GROUP BY ALL)
SELECT a AS paper_id_a, b AS paper_id_b FROM p JOIN s x ON x.paper_id = a JOIN s y ON y.paper_id = b WHERE 2 * o >= x.n + y.n - o"""

P4_CLASSES = r"""WITH d AS (SELECT paper_id, regexp_extract_all(lower(coalesce(article_title || ' ', '') || abstract), '[a-z0-9]+') AS w FROM paper_end WHERE trim(abstract) <> ''),
 t AS (SELECT DISTINCT paper_id, unnest(list_transform(range(1, len(w) - SIZE + 2), lambda i: array_to_string(w[i:i + SIZE - 1], ' '))) AS g FROM d), f AS (SELECT paper_id, list_sort(list(g)) AS g FROM t GROUP BY 1),
 m AS (SELECT paper_id, min(paper_id) OVER (PARTITION BY g) AS class FROM f), r AS (SELECT t.* FROM t JOIN m USING (paper_id) WHERE paper_id = class), s AS (SELECT paper_id, count(*) AS n FROM r GROUP BY 1),
 p AS (SELECT a.paper_id AS a, b.paper_id AS b, count(*) AS o FROM r a JOIN r b ON a.g = b.g AND a.paper_id <> b.paper_id GROUP BY ALL), l AS (SELECT a, count(*) AS links FROM p JOIN s x ON x.paper_id = a JOIN s y ON y.paper_id = b WHERE LEAST GROUP BY a)
SELECT paper_id, coalesce(class, paper_id) AS class, coalesce(links, 0) AS links FROM d LEFT JOIN m USING (paper_id) LEFT JOIN l ON a = coalesce(class, paper_id)"""

P5 = rf"""WITH {RECORDS}, {packed_sql("ak", "paper_end", "author_keywords")},
 an AS (SELECT DISTINCT paper_id, trim(regexp_replace(regexp_replace(lower(item), '[_-]', ' ', 'g'), '\s+', ' ', 'g')) AS term FROM ak),
 b AS (SELECT 'keyword_plus' AS field, paper_id, term FROM k UNION ALL SELECT 'author_keywords', paper_id, term FROM an WHERE term <> ''),
 r AS (SELECT field, count(DISTINCT paper_id) AS r FROM b GROUP BY field), c AS (SELECT field, term, count(*) AS n FROM b GROUP BY ALL)
SELECT field, term, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS mark FROM c JOIN r USING (field) WHERE n < 3 OR n > 0.05 * r"""

P5_TERMS = P5.partition(",\n an AS")[0] + r""", an AS (SELECT paper_id, trim(regexp_replace(regexp_replace(lower(item), '[_-]', ' ', 'g'), '\s+', ' ', 'g')) AS term FROM ak),
 b AS (SELECT 'keyword_plus' AS field, paper_id, term FROM terms UNION ALL SELECT 'author_keywords', paper_id, term FROM an WHERE term <> ''),
 r AS (SELECT field, count(DISTINCT paper_id) AS r FROM b GROUP BY field), c AS (SELECT field, term, count(*) AS n, count(DISTINCT paper_id) AS records FROM b GROUP BY ALL)
SELECT field, term, n, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * r THEN 'common' ELSE 'useful' END AS mark FROM c JOIN r USING (field)"""

_GRAMS = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))"
P7 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
 dg AS (SELECT doc_id, {_GRAMS} AS g FROM d WHERE len(w) > 11), ig AS (SELECT item_id, {_GRAMS} AS g FROM i WHERE len(w) > 11) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

P7_ITEMS = P7.partition(" SELECT DISTINCT doc_id, item_id")[0] + """, a AS (SELECT DISTINCT * FROM dg), b AS (SELECT DISTINCT * FROM ig), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), h AS (SELECT doc_id, item_id, count(*) AS s FROM a JOIN b USING (g) GROUP BY ALL)
 SELECT item_id, count(*) AS documents, max(s / n) AS containment FROM h JOIN n USING (item_id) GROUP BY item_id"""

# sizes in words and marks: the rows are the same for any tokenizer
P8 = r"""WITH d AS (SELECT nullif(lower(trim(source)), '') AS s, len(regexp_extract_all(coalesce(text, ''), '\w+|[^\w\s]')) AS n FROM documents), t AS (SELECT sum(n) AS total FROM d), c AS (SELECT s, sum(n) AS n FROM d GROUP BY s)
SELECT recipe, m.source FROM mix_target m CROSS JOIN t LEFT JOIN c ON c.s = lower(trim(m.source)) WHERE coalesce(c.n, 0) * max_repeat < weight * budget_share * total"""


P8_CHECKS = P8.replace("SELECT recipe, m.source FROM", "SELECT recipe, m.source, coalesce(c.n, 0) * max_repeat < weight * budget_share * total AS short, true AS kept FROM").rpartition(" WHERE ")[0]
P6_SPELLINGS = f"""WITH {packed_sql("au", "paper_end", "authors", True)}, s AS (SELECT item AS spelling FROM au UNION ALL SELECT unnest(string_split(author_full_names, '; ')) FROM paper_end)
SELECT spelling, count(*) AS n, CAST(1 AS BIGINT) AS entities FROM s WHERE trim(spelling) <> '' GROUP BY spelling"""


def oracle_sql() -> dict[str, str]:
    classes = {"p4_classes": ("3", "3 * o >= x.n + y.n"), "p4_classes_of_five": ("5", "9 * o >= 4 * (x.n + y.n)")}
    return {"p1_found": P1, "p1_scores": P1_SCORES, "p2_found": P2, "p4_found": P4, "p5_found": P5, "p5_terms": P5_TERMS, "p6_spellings": P6_SPELLINGS, "p8_checks": P8_CHECKS, "p7_found": P7, "p7_items": P7_ITEMS, "p8_found": P8} | {
        k: P4_CLASSES.replace("SIZE", size).replace("LEAST", least) for k, (size, least) in classes.items()
    }
