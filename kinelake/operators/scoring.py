"""Scores of evaluated episodes: extraction, dense step means, step matching, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Progress rows of these classes are no scored steps.
IGNORED_CLASSES = ("ActionList", "ActionSetWaitAny", "StepOut")


def scored_progress(progress: DataFrame, class_name: str = "class_name") -> DataFrame:
    """Progress rows without the combinator classes; rows with a null class stay."""
    return progress.where(F.col(class_name).isNull() | ~F.col(class_name).isin(*IGNORED_CLASSES))


def step_name(name: Column) -> Column:
    """A task's name without its trailing _number."""
    return F.regexp_replace(name, r"_\d+$", "")


def dense_step_means(runs: DataFrame, task: str, run: str, step: str, score: str) -> DataFrame:
    """(task, step, mean_score): a step that a run lacks counts as 0, so sums are divided by the task's number of runs."""
    n = runs.groupBy(task).agg(F.countDistinct(run).alias("n_runs"))
    s = runs.groupBy(task, step).agg(F.sum(score).alias("__sum"))
    return s.join(n, task).select(task, step, (F.col("__sum") / F.col("n_runs")).alias("mean_score"))


def greedy_match(steps: Column, progress: Column) -> Column:
    """Per wanted step whether it is found, in order: each step uses up progress until it meets itself, and a miss uses up all."""
    n = F.size(progress)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<boolean>").alias("found"))

    def step(acc: Column, want: Column) -> Column:
        rest = F.slice(progress, acc["pos"] + 1, n)
        at = F.array_position(rest, want).cast("int")
        hit = at > 0
        return F.struct(F.when(hit, acc["pos"] + at).otherwise(n).alias("pos"), F.concat(acc["found"], F.array(hit)).alias("found"))

    return F.aggregate(steps, start, step)["found"]


def summary(scores: Column) -> Column:
    """Struct (e2e, mean) of a run's step scores in order: e2e is 1 exactly if the last step's score is 1."""
    n = F.size(scores)
    last = F.element_at(scores, -1)
    return F.struct(
        F.when((n > 0) & (last == 1.0), 1).otherwise(0).alias("e2e"),
        F.when(n > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / n).otherwise(0.0).alias("mean"),
    )


def navigation_eval(trace: DataFrame, episode: str, tick: str, radius: float, distance: str, action: str) -> DataFrame:
    """Per episode: stopped (last action is stop), final and least distance, success and oracle success."""
    last = trace.groupBy(episode).agg(
        F.max_by(distance, tick).alias("final_distance"),
        F.min(distance).alias("min_distance"),
        F.max_by(action, tick).alias("last_action"),
        F.count("*").alias("n_steps"),
    )
    return last.select(
        episode,
        "final_distance",
        "min_distance",
        "n_steps",
        ((F.col("last_action") == "stop") & (F.col("final_distance") <= radius)).cast("int").alias("success"),
        (F.col("min_distance") <= radius).cast("int").alias("oracle_success"),
    )
