"""Facts, verdicts, scores, runs and the promotion gate.

runs: run_id, kind, path, mean_blended, mtime, prompt_versions. scores: run_id, kind, pos, doc_name,
blended, error (null if the document went well).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scores as S
from folioscope.functions import text as T
from folioscope.lineage import cut

#: Least mean gain, loss of faithfulness allowed, margin of a second look, fact limit,
#: failures in a row that end a search, its iterations.
MIN_DELTA, MARGIN, FACT_LIMIT, FAILURES, ITERATIONS = 0.02, 0.02, 40, 2, 3


def first_seen(rows: DataFrame, group: list[str], key: Column, order: list[str]) -> DataFrame:
    """The first row of each key that isn't blank, in order."""
    ranked = rows.withColumn("_key", key).where(F.col("_key") != "")
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_key").orderBy(*order))).where("_n = 1").drop("_key", "_n")


def distinct_facts(rows: DataFrame, group: list[str], fact: str, order: list[str]) -> DataFrame:
    return first_seen(rows, group, T.normal_fact(F.col(fact)), order)


def zip_strict(left: Column, right: Column, name: str) -> Column:
    """Pairs of two arrays of equal length; other lengths are an error."""
    return F.when(F.size(left) == F.size(right), F.arrays_zip(left, right)).otherwise(F.raise_error(F.lit(f"{name}: lengths differ")))


def verdict_rates(verdicts: DataFrame, group: list[str]) -> DataFrame:
    """(group, coverage, faithfulness, covered, facts, supported, claims) of verdicts (kind, good)."""
    n = lambda kind, good=None: F.count_if((F.col("kind") == kind) & (F.col("good") if good else F.lit(True)))
    sums = verdicts.groupBy(*group).agg(n("fact").alias("facts"), n("fact", True).alias("covered"), n("claim").alias("claims"), n("claim", True).alias("supported"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.withColumn("coverage", rate("covered", "facts")).withColumn("faithfulness", rate("supported", "claims"))


def score_summaries(rates: DataFrame, target: float = 1.0) -> DataFrame:
    """rates (with words and rubric) with density and blended."""
    dense = rates.withColumn("density", S.density_score(F.col("covered"), F.col("words"), target))
    return dense.withColumn("blended", S.blended(F.col("coverage"), F.col("faithfulness"), F.col("density"), F.col("rubric")))


def mean_blended(scores: DataFrame, group: list[str]) -> DataFrame:
    """(group, mean_blended): over documents without error; 0 if there is none."""
    return scores.groupBy(*group).agg(F.coalesce(F.avg(F.when(F.col("error").isNull(), F.col("blended"))), F.lit(0.0)).alias("mean_blended"))


def clean(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("error").isNull())


def worst_document(scores: DataFrame, group: list[str]) -> DataFrame:
    """(group, doc_name, blended): the lowest score without error, first if equal."""
    least = clean(scores).groupBy(*group).agg(F.min(F.struct("blended", "pos", "doc_name")).alias("w"))
    return least.select(*group, F.col("w.doc_name").alias("doc_name"), F.col("w.blended").alias("blended"))


def paired_deltas(incumbent: DataFrame, candidate: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(doc_name, old, new, delta, pos) for documents without error in both."""
    keys = keys or ["doc_name"]
    old = clean(incumbent).select(*keys, F.col("blended").alias("old"))
    return clean(candidate).select(*keys, F.col("blended").alias("new"), "pos").join(old, keys).withColumn("delta", F.col("new") - F.col("old"))


def best_of_history(scores: DataFrame) -> DataFrame:
    """(doc_name, run_id, blended): each document's highest score, the earliest run if equal."""
    order = Window.partitionBy("doc_name").orderBy(F.desc("blended"), "run_id", "kind")
    return clean(scores).withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_name", "run_id", "blended")


def against_best(candidate: DataFrame, history: DataFrame) -> DataFrame:
    """(doc_name, old, new, delta, pos) of a run against the best standard run of each document."""
    best = best_of_history(history.where("kind = 'standard'")).select("doc_name", F.col("blended").alias("old"))
    return clean(candidate).select("doc_name", F.col("blended").alias("new"), "pos").join(best, "doc_name").withColumn("delta", F.col("new") - F.col("old"))


def latest_run(runs: DataFrame, group: list[str]) -> DataFrame:
    """(group, run_id): the file written last, the first in order if equal."""
    newest = runs.groupBy(*group).agg(F.max("mtime").alias("mtime"))
    return runs.join(newest, [*group, "mtime"]).groupBy(*group).agg(F.min("run_id").alias("run_id"))


def gate(deltas: DataFrame, group: list[str], least: float = MIN_DELTA) -> DataFrame:
    """(group, docs, mean_delta, wins, promoted, reason): promoted if the mean gain is enough and more
    than half of the documents win or tie."""
    sums = deltas.groupBy(*group).agg(F.count(F.lit(1)).alias("docs"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") >= 0).alias("wins"))
    small, few = F.round("mean_delta", 12) < least, F.col("wins") * 2 <= F.col("docs")
    reason = F.when(small, F.lit("mean delta below the minimum")).when(few, F.lit("no majority of wins or ties"))
    return sums.withColumn("promoted", ~small & ~few).withColumn("reason", reason)


def near_gate(mean_delta: Column, least: float = MIN_DELTA, margin: float = MARGIN) -> Column:
    """Whether a result is so near the minimum that it is repeated."""
    return F.abs(mean_delta - least) <= margin


def adjudicated(deltas: DataFrame, group: list[str]) -> DataFrame:
    """(group, doc_name, delta): the mean over repeats."""
    return deltas.groupBy(*group, "doc_name").agg(F.avg("delta").alias("delta"))


def delta_summary(deltas: DataFrame, group: list[str]) -> DataFrame:
    """(group, doc_name or null for all, delta, better): rows of a comparison and its mean."""
    return deltas.rollup(*group, "doc_name").agg(F.avg("delta").alias("delta"), F.grouping_id().alias("level")).where("level <= 1").withColumn("better", F.col("delta") > 0).drop("level")


def judge_accuracy(cases: DataFrame) -> DataFrame:
    """(kind or null for all, correct, total, accuracy) of cases (kind, expected, actual)."""
    sums = cases.rollup("kind").agg(F.count_if(F.col("expected") == F.col("actual")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return sums.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")))


def outline_accuracy(cases: DataFrame, group: list[str]) -> DataFrame:
    """(group, cases, annotated, pending, correct, accuracy): null accuracy if nothing is annotated."""
    known = F.col("expected").isNotNull()
    sums = cases.groupBy(*group).agg(F.count(F.lit(1)).alias("cases"), F.count_if(known).alias("annotated"), F.count_if(~known).alias("pending"), F.count_if(known & (F.col("predicted") == F.col("expected"))).alias("correct"))
    return sums.withColumn("accuracy", F.when(F.col("annotated") > 0, F.col("correct") / F.col("annotated")))


def case_status(expected: Column, predicted: Column) -> Column:
    return F.when(expected.isNull(), "pending").when(predicted == expected, "correct").otherwise("incorrect")


def worst_first(scores: DataFrame, facts: str = "missed", claims: str = "unsupported", most: int = 8) -> DataFrame:
    """A run's documents from the lowest score, each with its first missed facts and unsupported claims."""
    return scores.withColumn(facts, F.slice(facts, 1, most)).withColumn(claims, F.slice(claims, 1, most)).orderBy("blended", "pos")


def recent(runs: DataFrame, n: int = 18) -> DataFrame:
    """The last runs in order of (run_id, kind): a top-k, then put in order."""
    return runs.orderBy(F.desc("run_id"), F.desc("kind")).limit(n).orderBy("run_id", "kind")


def quantile_sample(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """count rows at even ranks of the order: i * (n - 1) div (count - 1), the median one for 1.

    Ranks come from range-partitioned rows and the sizes of partitions, not from one sorted task.
    """
    ranked = global_rank(rows, order)
    total = F.lit(rows.count())
    spot = F.when(F.lit(count) == 1, F.floor((total - 1) / 2)).otherwise(F.floor(F.col("i") * (total - 1) / F.greatest(F.lit(count - 1), F.lit(1))))
    wanted = rows.sparkSession.range(count).select(F.col("id").alias("i")).select(spot.cast("bigint").alias("rank")).distinct()
    return ranked.join(F.broadcast(wanted), "rank")


def global_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank from 0 in a total order."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    starts = sizes.select("_p", "_first", before.alias("_before"))
    return dealt.join(F.broadcast(starts), "_p").withColumn("rank", F.col("_m") - F.col("_first") + F.col("_before")).drop("_p", "_m", "_first", "_before")


def missing_names(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are not there, in order."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti").orderBy(key)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys in one table only; empty if the sets are equal."""
    both = left.select(key, F.lit(True).alias("l")).distinct().join(right.select(key, F.lit(True).alias("r")).distinct(), key, "full_outer")
    return both.where(F.col("l").isNull() | F.col("r").isNull()).select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def overrides(default: Column, own: Column) -> Column:
    """Maps merged, the right one winning."""
    kept = F.map_filter(default, lambda k, v: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)

