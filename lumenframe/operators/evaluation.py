"""Evaluation: resuming, ordering, sharding, summaries, completeness and the choice of the best checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe import storage
from lumenframe.functions import expr as E


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key; rows without a key go."""
    keyed = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_nth = 1").drop("_nth")


def joined_scores(metrics: DataFrame, physics: DataFrame, key: str = "clip_name", order: str = "pos") -> DataFrame:
    """Rows of ``metrics`` beside the last row of ``physics`` with their key; rows without either go, left duplicates stay."""
    left = metrics.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return left.join(last_of_each(physics, key, order).drop(order), key)


def remaining(manifest: DataFrame, done: DataFrame, key: str = "clip_name") -> DataFrame:
    """Rows of the manifest that aren't done yet."""
    return manifest.join(done.select(key), key, "left_anti")


def known(produced: DataFrame, manifest: DataFrame, key: str = "clip_name") -> DataFrame:
    """Produced files with their manifest row; others go."""
    return produced.join(manifest, key)


def in_manifest_order(rows: DataFrame, manifest: DataFrame, key: str, index: str, position: str) -> DataFrame:
    """Rows in the order of the manifest, unknown ones last, ties in their own order."""
    return rows.join(manifest.select(key, F.col(index).alias("_index")), key, "left").orderBy(F.asc_nulls_last("_index"), position).drop("_index")


def in_both(a: DataFrame, b: DataFrame, key: str = "clip_name") -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def numbered(df: DataFrame, order: list[str], name: str = "_at") -> DataFrame:
    """``df`` with the 0-based position of each row by ``order`` in column ``name``.

    The rows are range-partitioned, sorted and stored once; each part counts its rows, and the few counts give the parts
    their offsets, so no task sees more than its range.  Rows that are equal in ``order`` keep the places they are stored at.
    """
    keys = [F.asc_nulls_first(c) for c in order]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = storage.table(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    base = held.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    placed = held.join(F.broadcast(base.withColumn("_before", before).drop("_n")), "_part")  # a row for each part
    return placed.withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_part", "_id", "_first", "_before")


def shards(df: DataFrame, order: str, n: int) -> DataFrame:
    """``df`` with ``shard``: rows dealt in turn by position."""
    return numbered(df, [order]).withColumn("shard", F.pmod("_at", F.lit(n)).cast("int")).drop("_at")


def expected_files(expected: DataFrame, actual: DataFrame, sources: list[str]) -> DataFrame:
    """Each expected (branch, name) with the first of the sources that has it; ``error`` where none has."""
    out = expected
    for i, s in enumerate(sources):
        out = out.join(actual.filter(F.col("source") == s).select("branch", "name", F.col("path").alias(f"_p{i}")), ["branch", "name"], "left")
    path = F.coalesce(*[F.col(f"_p{i}") for i in range(len(sources))])
    origin = F.coalesce(*[F.when(F.col(f"_p{i}").isNotNull(), F.lit(s)) for i, s in enumerate(sources)])
    return out.withColumn("path", path).withColumn("origin", origin).withColumn(
        "error", F.when(path.isNull(), F.concat_ws(":", F.lit("missing"), "branch", "name"))).drop(*[f"_p{i}" for i in range(len(sources))])


def missing_first(expected: DataFrame, done: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The first ``k`` keys that aren't done (for a report)."""
    return expected.join(done.select(key), key, "left_anti").select(key).orderBy(key).limit(k)


def require_complete(expected: DataFrame, done: DataFrame, key: str) -> None:
    """An error that names the first missing keys, unless all are done."""
    lost = [str(r[0]) for r in missing_first(expected, done, key).collect()]
    if lost:
        raise RuntimeError(f"not complete, missing: {', '.join(lost)}")


def metric_summary(rows: DataFrame, metrics: list[str], gate: str = "psnr", by: list[str] | None = None) -> DataFrame:
    """metric, n, mean, std, min, max (4 digits) over the rows whose gate is a number; other text doesn't count."""
    numbers = rows.select(*(by or []), *[E.safe_float(F.col(m).cast("string")).alias(m) for m in dict.fromkeys([*metrics, gate])]).filter(F.col(gate).isNotNull())
    long = numbers.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("p")).select(*(by or []), "p.*").filter("v IS NOT NULL")
    return long.groupBy(*(by or []), "metric").agg(
        F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"), F.round(F.min("v"), 4).alias("min"), F.round(F.max("v"), 4).alias("max"))


def metric_means(rows: DataFrame, metrics: list[str], seed: str | None = None) -> DataFrame:
    """metric, mean, n over the values that are numbers; with ``seed`` also for each seed (null: over all)."""
    keep = [seed] if seed else []
    long = rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), E.safe_float(F.col(m).cast("string")).alias("v")) for m in metrics])).alias("p")).select(*keep, "p.*").filter("v IS NOT NULL")
    grouped = long.groupingSets([[seed, "metric"], ["metric"]], seed, "metric") if seed else long.groupBy("metric")
    return grouped.agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def means_map(means: DataFrame, by: list[str]) -> DataFrame:
    """The metric rows of each group as one map from metric to mean and n."""
    return means.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "n"))))).alias("means"))


def progress(rows: DataFrame, metrics: list[str], total: int, label: str) -> DataFrame:
    """One row: label, processed, total and the mean of each metric."""
    return rows.agg(F.count("*").alias("processed"), *[F.avg(E.safe_float(F.col(m).cast("string"))).alias(m) for m in metrics]).select(
        F.lit(label).alias("model"), "processed", F.lit(total).alias("total"), *metrics)


def model_summary(reports: DataFrame) -> DataFrame:
    """model, pmf, psnr, ssim, lpips, fvd from raw report texts (model, physics, evaluation, fvd), each the first place that has it."""
    num = lambda c, *p: E.json_first(F.col(c), *p).try_cast("double")
    return reports.select(
        "model", num("physics", "$.means.physics_iq_style_score.mean").alias("pmf"), *[num("evaluation", f"$.aggregate_metrics.{m}.mean").alias(m) for m in ("psnr", "ssim", "lpips")],
        num("fvd", "$.fvd", "$.aggregate_metrics.fvd.mean", "$.metrics.fvd").alias("fvd"))


# Metrics of the best checkpoint in their order, whether more is better, and what stands for a missing one.
RANKING = [("pmf", True, 0.0), ("fvd", False, float("inf")), ("psnr", True, 0.0), ("ssim", True, 0.0), ("lpips", False, float("inf"))]


def checkpoint_metrics(df: DataFrame) -> DataFrame:
    """The ranking metrics as numbers; missing and non-finite ones get their default."""
    return df.withColumns({m: F.when(E.finite(F.col(m).cast("double")), F.col(m).cast("double")).otherwise(F.lit(d)) for m, _, d in RANKING})


def best_checkpoint(df: DataFrame, by: list[str] | None = None, step: str = "step") -> DataFrame:
    """The best checkpoint of each group; of equal ones the earliest."""
    key = [(-F.col(m) if more else F.col(m)).alias(m) for m, more, _ in RANKING]
    filled = checkpoint_metrics(df)
    one = filled.groupBy(*(by or [])).agg(F.min_by(F.struct(*[F.col(c) for c in filled.columns]), F.struct(*key, F.col(step))).alias("b"))
    return one.select("b.*")


def retention(df: DataFrame, by: str, step: str = "step") -> DataFrame:
    """``df`` with ``status``: failed, best (better than all before it when it came) or pruned.  Nothing is deleted."""
    filled = checkpoint_metrics(df)
    key = F.struct(*[(-F.col(m) if more else F.col(m)).alias(m) for m, more, _ in RANKING])
    before = F.min(F.when(~F.coalesce("failed", F.lit(False)), key)).over(Window.partitionBy(by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return filled.withColumn("_before", before).withColumn("_key", key).withColumn(
        "status", F.when(F.coalesce("failed", F.lit(False)), "failed").when(F.col("_before").isNull() | (F.col("_key") < F.col("_before")), "best").otherwise("pruned")).drop("_before", "_key")


def numeric_audit(df: DataFrame, key: str, values: str, most: int = 0, order: str | None = None) -> DataFrame:
    """key, n, all_finite, max_abs, mean_abs of the number arrays of each key; with ``most`` only of its first rows by ``order``.

    Each array is reduced in place, so there is a row for an array and none for a number; null arrays have no numbers and null numbers aren't finite.
    """
    if most:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(order or F.lit(0)))
        df = df.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    sizes = F.transform(F.col(values), lambda x: F.abs(x.cast("double")))
    each = df.select(F.col(key), F.coalesce(F.size(values), F.lit(0)).alias("_n"), F.forall(F.col(values), lambda x: F.coalesce(E.finite(x.cast("double")), F.lit(False))).alias("_finite"),
                     F.array_max(sizes).alias("_most"), F.aggregate(F.filter(sizes, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x).alias("_sum"), F.size(F.filter(sizes, lambda x: x.isNotNull())).alias("_there"))
    return each.filter("_n > 0").groupBy(key).agg(F.sum("_n").alias("n"), F.bool_and("_finite").alias("all_finite"), F.max("_most").alias("max_abs"), F.try_divide(F.sum("_sum"), F.sum("_there")).alias("mean_abs"))


def require_finite(audit: DataFrame) -> DataFrame:
    """The audit; an error where a key has a number that isn't finite."""
    return audit.withColumn("all_finite", E.checked(F.col("all_finite"), F.col("all_finite"), "numbers that aren't finite"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def cleanup_class(df: DataFrame, protected: str) -> DataFrame:
    """``df`` (path, risk, exists) with ``decision``: blank, protected, high_risk, missing or candidate.  Nothing is deleted."""
    path = F.coalesce("path", F.lit(""))
    return df.withColumn("decision", F.when(path == "", "blank").when(path.rlike(protected), "protected").when(F.col("risk") == "high", "high_risk").when(
        ~F.coalesce("exists", F.lit(False)), "missing").otherwise("candidate"))


def ordered_metrics(means: DataFrame, order: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """ord, label, text (four digits), n of the metrics (metric, mean, n) that ``order`` names; missing ones are passed over."""
    at = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("metric"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m in order for x in (m, (labels or {}).get(m, m))]), F.col("metric")), F.col("metric"))
    return means.filter(at > 0).select(at.cast("int").alias("ord"), label.alias("label"), F.format_string("%.4f", "mean").alias("text"), "n")


# Metrics of the physics summary in their order, and their labels.
PHYSICS_LABELS = {
    "physics_iq_style_score": "Score",
    "spatiotemporal_iou_mean": "Spatiotemporal IoU",
    "spatial_iou": "Spatial IoU",
    "weighted_spatial_iou": "Weighted Spatial IoU",
    "mse_mean": "MSE",
    "compare_frame_count": "Frames",
}


def lineage(spark, **fields: str) -> DataFrame:
    """A one-row record of text fields and the time of making."""
    row = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields))
    return row.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


# Metrics of the summaries by seed in their order, and their labels.
SUMMARIES = {
    "physics": PHYSICS_LABELS,
    "videos": {"sa_mean": "SA Mean", "pc_mean": "PC Mean", "joint": "Joint >= 4"},
    "clips": {
        "psnr": "PSNR",
        "ssim": "SSIM",
        "lpips": "LPIPS",
        "gen_time_s": "Gen Time (s)",
        "fid": "FID",
        "fvd": "FVD",
        "flow_direction_accuracy": "Flow Dir Acc",
        "trajectory_consistency": "Trajectory Consistency",
        "turn_direction_accuracy": "Turn Dir Acc",
    },
}


def seed_means(scores: DataFrame, seed: str, metrics: list[str]) -> DataFrame:
    """seed, metric, mean, n of each metric of each seed over its numbers, and over all seeds where seed is null; metrics without numbers have no row."""
    each = scores.select(F.col(seed).alias("seed"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m).cast("double"), F.lit(None)).alias("v")) for m in metrics])).alias("s"))
    rows = each.select("seed", "s.*").filter("v IS NOT NULL")
    both = rows.groupingSets([["metric"], ["seed", "metric"]], "seed", "metric").agg(F.avg("v").alias("mean"), F.count("*").alias("n"), F.grouping("seed").alias("all"))
    return both.select(F.when(F.col("all") == 0, F.col("seed")).alias("seed"), "metric", "mean", "n", (F.col("all") == 1).alias("overall"))


def summary_lines(means: DataFrame, labels: dict[str, str]) -> DataFrame:
    """part, seed, line of a formatted summary: ``overall`` lines (metric, mean, count) and ``seed`` lines (seed, samples, the mean of each metric that any seed has).

    Metrics come in the order of ``labels``, others are passed over; a seed's samples are those of the metric that has most.
    """
    known = means.filter(F.col("metric").isin(list(labels)))
    text, label = F.format_string("%.4f", "mean"), F.element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), F.col("metric"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    overall = known.filter("overall").select(F.lit("overall").alias("part"), F.lit(None).cast(means.schema["seed"].dataType).alias("seed"), row(label, text, F.col("n").cast("string")).alias("line"))
    there = [m for m in labels if m in {r.metric for r in known.filter("NOT overall").select("metric").distinct().collect()}]  # a row for each label at most
    cells = [F.coalesce(F.max(F.when(F.col("metric") == m, text)), F.lit("")).alias(f"m{i}") for i, m in enumerate(there)]
    by_seed = known.filter("NOT overall").groupBy("seed").agg(F.max("n").alias("n"), *cells) if there else known.limit(0).select("seed", "n")
    each = by_seed.select(F.lit("seed").alias("part"), "seed", row(F.coalesce(F.col("seed").cast("string"), F.lit("")), F.col("n").cast("string"), *[F.col(f"m{i}") for i in range(len(there))]).alias("line"))
    return overall.unionByName(each)


# The two branches of a checkpoint, its configuration, and the files of which one must hold the weights.
BRANCHES = ["low_noise_model", "high_noise_model"]
CONFIG_FILE = "config.json"
WEIGHT_FILES = ["diffusion_pytorch_model.bin", "diffusion_pytorch_model.safetensors", "diffusion_pytorch_model.safetensors.index.json"]


def verified_lineage(records: DataFrame, files: DataFrame, root: str = "root") -> DataFrame:
    """``records`` with ``ok`` and ``errors``: what the checkpoint that each came from lacks (branch:error, in order); ``files`` (root, branch, name) lists what is there."""
    roots = records.select(F.col(root).alias("root")).filter("root IS NOT NULL").distinct()
    told = F.concat_ws(":", F.when(F.col("branch") != "", F.col("branch")), "error")
    found = checkpoint_errors(roots, files).groupBy("root").agg(F.sort_array(F.collect_list(told)).alias("errors"))  # a few for each root
    out = records.join(found.withColumnRenamed("root", root), root, "left")
    none = F.when(F.col(root).isNull(), F.array(F.lit("missing_path"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("errors", F.coalesce("errors", none)).withColumn("ok", F.size("errors") == 0)


def checkpoint_errors(roots: DataFrame, files: DataFrame) -> DataFrame:
    """root, branch, error of checkpoints that lack a branch, its configuration or its weights; whole ones have no row.

    ``files`` (root, branch, name) lists what is there.  Where a root has no file at all that is its one error.
    """
    seen = files.groupBy("root", "branch").agg(F.bool_or(F.col("name") == CONFIG_FILE).alias("config"), F.bool_or(F.col("name").isin(WEIGHT_FILES)).alias("weights"))
    there = files.select("root").distinct().withColumn("there", F.lit(True))
    want = roots.select("root").distinct().join(there, "root", "left").select(
        "root", "there", F.explode(F.when(F.col("there"), F.array(*[F.lit(b) for b in BRANCHES])).otherwise(F.array(F.lit("")))).alias("branch"))
    both = want.join(seen, ["root", "branch"], "left")
    codes = F.array_compact(F.array(
        F.when(F.col("there").isNull(), F.lit("missing_path")), F.when(F.col("there") & F.col("config").isNull(), F.lit("missing_directory")),
        F.when(~F.col("config"), F.lit("missing_config")), F.when(~F.col("weights"), F.lit("missing_weights"))))
    return both.select("root", "branch", F.explode(codes).alias("error"))


def row_by_key(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """The row whose ``key`` is ``value`` (of several the first by ``position``), else the first row of all; none for an empty table."""
    least = F.struct((~F.coalesce(F.col(key) == value, F.lit(False))).alias("other"), F.col(position).alias("at"))
    one = rows.agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), least).alias("r"))
    return one.filter("r IS NOT NULL").select("r.*")


def epoch_means(log: DataFrame, epoch: str = "epoch", loss: str = "loss_total") -> DataFrame:
    """index (from 1) and mean loss of each epoch that has a logged step."""
    return log.groupBy((F.col(epoch) + 1).alias("index")).agg(F.avg(loss).alias("loss_total_mean"))


def light_validation(rows: DataFrame, loss: str, position: str, most: int) -> DataFrame:
    """One row: mean loss and number of the first ``most`` samples (a feature: a short check); 0 and 0 for none."""
    first = rows.orderBy(position).limit(most)
    return first.agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("light_loss_total"), F.count(loss).alias("light_sample_count"))


def counter_text(counts: DataFrame, by: list[str], key: str = "key", n: str = "n") -> DataFrame:
    """``text`` of the counters of each group, as ``a:1,b:2`` in the order of their keys."""
    each = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(n).cast("string").alias("n")))), lambda p: F.concat(p["k"], F.lit(":"), p["n"]))
    return counts.groupBy(*by).agg(F.coalesce(F.nullif(F.array_join(each, ","), F.lit("")), F.lit("none")).alias("text"))


def scalar_metrics(payload: Column) -> Column:
    """The numbers of a metric record in JSON, by name; lists, objects and other text go."""
    held = F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.transform_values(F.map_filter(held, lambda k, v: v.try_cast("double").isNotNull()), lambda k, v: v.cast("double"))


def step_clock(log: DataFrame, by: str, time: str, step: str, total: int) -> DataFrame:
    """step_seconds, average, percent and eta of each logged step."""
    order = Window.partitionBy(by).orderBy(step)
    out = log.withColumn("step_seconds", F.col(time) - F.lag(time).over(order))
    out = out.withColumn("average", F.avg("step_seconds").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.greatest(F.lit(total) - F.col(step), F.lit(0))
    return out.withColumn("percent", F.col(step) * 100.0 / total).withColumn("eta", E.eta_text(F.col("average") * left))


def report_points(log: DataFrame, by: str, count: str, every: int) -> DataFrame:
    """Rows of each run at which its count has passed a further multiple of ``every``."""
    order = Window.partitionBy(by).orderBy(count)
    level = F.floor(F.col(count) / every)
    return log.withColumn("_level", level).withColumn("_was", F.coalesce(F.lag("_level").over(order), F.lit(0))).filter("_level > _was").drop("_level", "_was")

