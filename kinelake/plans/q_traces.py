"""Text operators on the documents' own material: rule traces, reports, markers, tag paths. ST07-ST11, ST18-ST20, ST31-ST32, GR01."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import text as tx
from kinelake.operators import nested
from kinelake.plans.registry import Registry, r6
from kinelake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: A line of a rule trace: a leaf with its arguments, what came of it, and when.
LEAF_LINE = r"^(\w+)\|([^|]+)\|([^|]+) -> (true|false)(?: at tick (\d+))?$"


@R.query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE source = 'rule_trace' AND text IS NOT NULL)
    SELECT doc_id, line_no::INT AS line_no, regexp_extract(line, '^(\w+)\|', 1) AS op, regexp_extract(line, '^\w+\|([^|]+)\|', 1) AS first_arg, regexp_extract(line, '^\w+\|[^|]+\|([^|]+) -> ', 1) AS second_arg,
    line LIKE '% -> true%' AS held, TRY_CAST(nullif(regexp_extract(line, ' at tick (\d+)$', 1), '') AS BIGINT) AS tick FROM l WHERE regexp_matches(line, '^(\w+)\|([^|]+)\|([^|]+) -> (true|false)( at tick (\d+))?$')"""
)
def st09_trace_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaves that rule traces report, with their arguments."""
    t = table(spark, d, "documents").where("source = 'rule_trace' and text is not null")
    x = t.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(LEAF_LINE))
    part = lambda i: F.regexp_extract("line", LEAF_LINE, i)
    return x.select("doc_id", (F.col("pos") + 1).alias("line_no"), part(1).alias("op"), part(2).alias("first_arg"), part(3).alias("second_arg"), (part(4) == "true").alias("held"), part(5).try_cast("long").alias("tick"))


@R.query(
    r"""SELECT doc_id, round(least(greatest(CASE WHEN coalesce(score, 0) <> 0 THEN score ELSE coalesce(done / total, 0) END, 0), 1), 6) AS score, done, total FROM (
      SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, 'Score (\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS score, TRY_CAST(nullif(regexp_extract(text, 'progress (\d+) of (\d+)', 1), '') AS DOUBLE) AS done,
      nullif(TRY_CAST(nullif(regexp_extract(text, 'progress (\d+) of (\d+)', 2), '') AS DOUBLE), 0) AS total FROM documents WHERE source = 'eval_report' AND text IS NOT NULL)"""
)
def st07_st08_st32_reports(spark: SparkSession, d: str) -> DataFrame:
    """The score that a report gives, else the progress that it counts, else none; within 0 and 1."""
    t = table(spark, d, "documents").where("source = 'eval_report' and text is not null")
    number = lambda p, i=1: F.regexp_extract("text", p, i).try_cast("double")
    progress = r"progress (\d+) of (\d+)"
    x = t.select("doc_id", number(r"Score (\d+(?:\.\d+)?)").alias("given"), number(progress).alias("done"), F.nullif(number(progress, 2), F.lit(0.0)).alias("total"))
    score = F.when(F.coalesce("given", F.lit(0.0)) != 0, F.col("given")).otherwise(F.coalesce(F.try_divide("done", "total"), F.lit(0.0)))
    return x.select("doc_id", r6(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).alias("score"), "done", "total")


@R.query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'rule_trace' AND text IS NOT NULL)
    SELECT doc_id, count(*) AS n_lines, coalesce(sum(coalesce(TRY_CAST(nullif(regexp_extract(line, '^\w+\|[^|]*_(\d+)\|', 1), '') AS BIGINT), 1)), 0)::BIGINT AS suffixes, count(*) FILTER (regexp_matches(line, '^Any\[\d+\]')) AS n_sets FROM l GROUP BY 1"""
)
def st10_st11_trace_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Numbers behind names, 1 where there is none, and lines of sets."""
    t = table(spark, d, "documents").where("source = 'rule_trace' and text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    suffix = F.coalesce(F.regexp_extract("line", r"^\w+\|[^|]*_(\d+)\|", 1).try_cast("long"), F.lit(1))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(suffix).alias("suffixes"), F.count_if(F.col("line").rlike(r"^Any\[\d+\]")).alias("n_sets"))


@R.query(
    r"""SELECT doc_id, flatten(list_transform(string_split(text, '</s>'), lambda p, i: CASE WHEN i = 1 THEN [len(list_filter(regexp_split_to_array(p, '[ \t\n\r\f\v]+'), lambda w: w <> ''))::INT] ELSE [-200, len(list_filter(regexp_split_to_array(p, '[ \t\n\r\f\v]+'), lambda w: w <> ''))::INT] END)) AS spliced,
    CASE WHEN len(string_split(text, '</s>')) = 2 THEN '</s>' || chr(10) || trim(replace(text, '</s>', ''), ' ') ELSE text END AS moved FROM documents WHERE text IS NOT NULL AND text <> ''"""
)
def st19_st20_markers(spark: SparkSession, d: str) -> DataFrame:
    """Splicing at, and moving of, a marker that stands in the texts themselves."""
    t = table(spark, d, "documents").where("text is not null and text <> ''")
    return t.select("doc_id", tx.splice_images(F.col("text"), "</s>", -200).alias("spliced"), tx.move_tag_first(F.col("text"), "</s>").alias("moved"))


@R.query("SELECT doc_id, length(text) AS n_tokens, CASE WHEN contains(text, ': ') THEN length(text) - length(string_split(text, ': ')[-1]) ELSE length(text) END AS n_masked FROM documents WHERE text IS NOT NULL AND text <> ''")
def st18_st31_character_masks(spark: SparkSession, d: str) -> DataFrame:
    """Completion-only labels with a token for each character: what stands up to the last ': ' is masked."""
    t = table(spark, d, "documents").where("text is not null and text <> ''")
    tokens = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    labels = t.select("doc_id", tx.mask_before(tokens, [58, 32]).alias("l"))
    return labels.select("doc_id", F.size("l").cast("long").alias("n_tokens"), F.size(F.filter("l", lambda v: v == -100)).cast("long").alias("n_masked"))


@R.query()
def gr01_tag_paths(spark: SparkSession, d: str) -> DataFrame:
    """Edges between neighbouring tags of each object's path, counted over all scene records (JSON of many shapes, so no SQL twin)."""
    t = nested.scene_tables(table(spark, d, "scene_records"))["tags"]
    w = Window.partitionBy("scene_uid", "object_id").orderBy("ordinal")  # the tags of one object
    e = t.select(F.col("tag").alias("src"), F.lead("tag").over(w).alias("dst")).where("dst is not null and src <> dst")
    return e.groupBy("src", "dst").agg(F.count("*").alias("n"))
