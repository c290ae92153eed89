"""Ranking quality: gold sets from history, localisation metrics, citation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the gold set and of the metrics.
MIN_SUBJECT = 12
MAX_GOLD = 4
NEWEST = 40
CUTS = (1, 3, 5, 10)


def gold_set(commits: DataFrame, commit_files: DataFrame, newest: int = NEWEST) -> DataFrame:
    """The newest plain commits that change one to four source files: (sha, subject, gold)."""
    subject = F.trim(T.first_line(F.col("message")))
    plain = commits.where("n_parents <= 1").select("repo_id", "sha", "authored_at", subject.alias("subject")).where(F.length("subject") >= MIN_SUBJECT)
    code = commit_files.where(F.col("path").endswith(".py") & ~F.col("path").startswith("tests/"))
    gold = code.groupBy("repo_id", "sha").agg(F.sort_array(F.collect_set("path")).alias("gold")).where(F.size("gold").between(1, MAX_GOLD))
    return plain.join(gold, ["repo_id", "sha"]).orderBy(F.desc("authored_at"), F.desc("sha")).limit(newest)


def localisation(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: recall and hit at each cut, reciprocal rank.

    predicted: (query_id, item, rank); of a repeated item the first rank counts, and ranks close up.
    gold: (query_id, item). Queries without predictions score 0.
    """
    first = predicted.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item"))
    # gold is computed once: what is sought of each query, with its place if it was predicted
    marked = gold.distinct().join(first.withColumn("place", place), ["query_id", "item"], "left")
    rows = marked.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.min("place").alias("best"), *[F.count_if(F.col("place") <= k).alias(f"found_{k}") for k in CUTS])
    out = [F.col("query_id"), "n_gold"]
    for k in CUTS:
        found = F.coalesce(F.col(f"found_{k}"), F.lit(0))
        out += [(found / F.col("n_gold")).alias(f"recall_{k}"), F.when(found > 0, 1).otherwise(0).alias(f"hit_{k}")]
    return rows.select(*out, F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"))


def summarise(metrics: DataFrame) -> DataFrame:
    """Means of all metrics over the queries, 0 without any."""
    names = [c for c in metrics.columns if c not in ("query_id", "n_gold")]
    return metrics.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def citation_validity(answers: DataFrame) -> DataFrame:
    """answers(id, text, n_sources): citations, distinct ones, how many name a source."""
    marks = answers.select("id", "n_sources", T.citations(F.col("text")).alias("c"))
    return marks.select("id", F.size("c").alias("total"), F.size(F.array_distinct("c")).alias("distinct"), F.size(F.filter("c", lambda n: (n >= 1) & (n <= F.col("n_sources")))).alias("valid"))


def judge_summary(judged: DataFrame) -> DataFrame:
    """Mean of the numeric scores, and how often each verdict was given."""
    score = F.try_to_number(F.col("score").cast("string"), F.lit("9.99"))
    return judged.groupBy("verdict").agg(F.count("*").alias("n"), F.avg(F.coalesce(score.cast("double"), F.col("score").try_cast("double"))).alias("score"))
