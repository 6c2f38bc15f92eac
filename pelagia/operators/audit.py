"""The seven integrity checks of a final catalogue, the report and the stage that raises on a failed check.

Each check gives one row: name, passed, violations and up to ten sample values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.operators.catalog import filled, first_of

PATHS = ["original_image_path", "normalized_image_path", "contrast_image_path", "sharpened_image_path", "noisy_image_path", "denoised_image_path"]
OUTPUTS = PATHS[1:]
DECODED = ["sharpened_image_path", "noisy_image_path", "denoised_image_path"]
SAMPLE = 10


def _check(name: str, bad: DataFrame, value: Column | str, samples: int = SAMPLE, times: str | None = None) -> DataFrame:
    """Count violations (``times`` for each row, if given) and sample the smallest distinct values: a bounded partial sort,
    not a collected list."""
    number = F.col(times) if times else F.lit(1)
    bad = bad.select((F.col(value) if isinstance(value, str) else value).cast("string").alias("v"), number.cast("long").alias("times"))
    some = bad.filter("v is not null").select("v").distinct().orderBy("v").limit(samples).agg(F.array_sort(F.collect_list("v")).alias("samples"))
    one = bad.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("violations"))
    return one.crossJoin(some).select(F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"), "violations", "samples")  # one row and one row


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, path: the non-blank values of the columns."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("path")) for c in columns])).alias("p")).select("p.*").filter(filled(F.col("path")).isNotNull())


def files_exist(df: DataFrame, files: DataFrame) -> DataFrame:
    return _check("every_referenced_file_exists", unpivoted(df, PATHS).join(files.select("path").distinct(), "path", "left_anti"), "path")


def raw_untouched(df: DataFrame, decoded: DataFrame | None = None, validated: DataFrame | None = None) -> DataFrame:
    """No output lies under data/raw; decoded raw images keep the size that was validated. decoded, validated: path, height, width."""
    bad = unpivoted(df, OUTPUTS).filter(F.col("path").contains("data/raw") | F.col("path").contains("data\\raw")).select("path")
    if decoded is not None and validated is not None:
        was = validated.groupBy("path").agg(F.max(F.struct("height", "width")).alias("was"))
        changed = decoded.join(was, "path").filter(~F.struct("height", "width").eqNullSafe(F.col("was"))).select("path")
        bad = bad.unionByName(changed)
    return _check("no_raw_files_modified", bad, "path")


def no_leakage(df: DataFrame) -> DataFrame:
    splits = df.filter(F.col("dataset_split").isin("train", "val", "test")).groupBy("patient_id").agg(F.count_distinct("dataset_split").alias("n"))
    return _check("no_train_test_patient_leakage", splits.filter("n > 1"), "patient_id")


def pathology_present(df: DataFrame) -> DataFrame:
    p = filled(F.col("pathology"))
    return _check("pathology_is_not_missing", df.filter(p.isNull() | (F.upper(p) == "UNKNOWN")), "patient_id")


def label_matches(df: DataFrame) -> DataFrame:
    p = F.upper(F.trim("pathology"))
    want = F.when(p.isin("BENIGN", "BENIGN_WITHOUT_CALLBACK"), 0).when(p == "MALIGNANT", 1)
    label = F.col("label").cast("string").try_cast("int")
    return _check("label_matches_pathology", df.filter(want.isNotNull() & ~label.eqNullSafe(want)), "patient_id")


def dimensions_valid(df: DataFrame, decoded: DataFrame, height: int = 512, width: int = 512) -> DataFrame:
    """Of the distinct output files that exist."""
    used = unpivoted(df, DECODED).select("path").distinct().join(decoded, "path")
    return _check("image_dimensions_are_valid", used.filter((F.col("height") != height) | (F.col("width") != width)), "path")


def unique_outputs(df: DataFrame) -> DataFrame:
    path = first_of(F.col("denoised_image_path"), F.col("sharpened_image_path"))
    more = df.select(path.alias("path")).groupBy("path").agg((F.count("*") - 1).alias("extra")).filter("extra > 0")
    return _check("no_duplicate_output_paths", more, "path", times="extra")


def run_checks(df: DataFrame, files: DataFrame, decoded: DataFrame, validated: DataFrame | None = None, size: tuple[int, int] = (512, 512)) -> DataFrame:
    """All seven; files: path; decoded: path, height, width of the files."""
    checks = [files_exist(df, files), raw_untouched(df, decoded, validated), no_leakage(df), pathology_present(df), label_matches(df), dimensions_valid(df, decoded, *size), unique_outputs(df)]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


#: Columns whose values a report counts, by section.
COUNTED = {"cohort": ["dataset_split", "pathology", "label", "abnormality_category", "breast_side", "image_view"], "noise": ["noise_type"], "denoising": ["denoising_method"]}
AVERAGED = ["PSNR", "SSIM", "MSE", "CNR"]


def composition(df: DataFrame) -> DataFrame:
    """section, item, value, n: how often each value of the counted columns stands in the table, in one pass; nulls are left out."""
    items = [F.struct(F.lit(s).alias("section"), F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for s, cs in COUNTED.items() for c in cs if c in df.columns]
    return df.select(F.explode(F.array(*items)).alias("i")).select("i.*").filter("value is not null").groupBy("section", "item", "value").agg(F.count("*").alias("n"))


def totals(df: DataFrame, checks: DataFrame) -> DataFrame:
    """section records: total, clean, experiment, missing, failed (missing and of wrong size) and successful records."""
    one = df.agg(F.count("*").alias("total"), F.count_if(F.col("noise_type").isNull()).alias("clean"))
    bad = checks.agg(*[F.coalesce(F.sum(F.when(F.col("check") == c, F.col("violations"))), F.lit(0)).alias(k) for k, c in (("missing", "every_referenced_file_exists"), ("sizes", "image_dimensions_are_valid"))])
    row = one.crossJoin(bad)  # one row and one row
    failed = F.least(F.col("missing") + F.col("sizes"), F.col("total"))
    values = {"total": F.col("total"), "clean": F.col("clean"), "experiment": F.col("total") - F.col("clean"), "missing": F.col("missing"), "failed": failed, "successful": F.col("total") - failed}
    return row.select(F.explode(F.array(*[F.struct(F.lit("records").alias("section"), F.lit(k).alias("item"), F.lit(None).cast("string").alias("value"), v.cast("long").alias("n")) for k, v in values.items()])).alias("i")).select("i.*")


def averages(metrics: DataFrame) -> DataFrame:
    """denoising_method and the means of AVERAGED."""
    return metrics.groupBy("denoising_method").agg(*[F.avg(m).alias(m) for m in AVERAGED if m in metrics.columns])


def device(spark) -> dict[str, str]:
    """What the session runs on."""
    conf = spark.sparkContext.getConf()
    return {"Master": spark.sparkContext.master, "Spark": spark.version, "Cores": str(spark.sparkContext.defaultParallelism), "Executor memory": conf.get("spark.executor.memory", "1g"), "Driver memory": conf.get("spark.driver.memory", "1g")}


def report(df: DataFrame, checks: DataFrame, seconds: float = 0.0, metrics: DataFrame | None = None) -> str:
    """The text of the final report, in seven sections, from values as they are: what is counted, not what is expected.

    The driver gets one row for each value of a counted column (split, diagnosis, side, ...: a few dozen), seven checks and
    eight methods."""
    found = checks.collect()  # seven rows
    n = {r["item"]: r["n"] for r in totals(df, checks).collect()}
    counts = sorted(composition(df).collect(), key=lambda r: (r["item"], -r["n"], r["value"]))
    passed = all(r["passed"] for r in found)
    lines: list[str] = []

    def section(title: str) -> None:
        lines.extend(["", "-" * 72, f"{1 + sum(x.startswith('-') for x in lines)}. {title}", ""])

    def values(of: str, unit: str) -> None:
        for item in COUNTED[of]:
            lines.append(f"{item}:")
            lines.extend(f"  {r['value']:<26} {r['n']} {unit}" for r in counts if r["item"] == item)

    lines += ["FINAL PREPROCESSING REPORT", f"Integrity: {'PASSED' if passed else 'FAILED'}"]
    section("Records")
    lines += [f"Total records: {n['total']}", f"Baseline records: {n['clean']}", f"Experiment records: {n['experiment']}", f"Successful: {n['successful']}", f"Failed: {n['failed']}", f"Missing outputs: {n['missing']}", f"Seconds: {seconds:.2f}"]
    section("Compute")
    lines += [f"{k}: {v}" for k, v in device(df.sparkSession).items()]
    section("Cohort")
    values("cohort", "records")
    section("Noise")
    values("noise", "records")
    section("Denoising")
    values("denoising", "runs")
    if metrics is not None:
        lines += ["Means:", "  " + f"{'method':<22}" + "".join(f"{m:>12}" for m in AVERAGED)]
        lines += [f"  {r['denoising_method']:<22}" + "".join(f"{r[m]:>12.4f}" if m in metrics.columns and r[m] is not None else f"{'-':>12}" for m in AVERAGED) for r in sorted(averages(metrics).collect(), key=lambda r: r["denoising_method"] or "")]
    section("Checks")
    for r in found:
        lines.append(f"  {r['check']}: {'PASSED' if r['passed'] else 'FAILED'} ({r['violations']})")
        lines.extend(f"    {v}" for v in r["samples"] or [])
    section("Sign-off")
    lines.append("All checks passed." if passed else f"Failed checks: {', '.join(sorted(r['check'] for r in found if not r['passed']))}")
    return "\n".join(lines) + "\n"


def inspection(df: DataFrame, key: str = "path", image: str = "image") -> DataFrame:
    """A row for each image: size, range, mean, deviation, quartiles, share of zeros and whether it is valid."""
    from pelagia.functions.points import let, percentile
    from pelagia.operators.images import statistics, validity

    d = F.col(f"{image}.data")
    quartiles = let(lambda o: F.array(*[percentile(o["o"], p) for p in (25.0, 50.0, 75.0)]), o=F.array_sort(d))
    zeros = F.try_divide(F.size(F.filter(d, lambda v: v == 0)), F.size(d))
    some = F.coalesce(F.size(d) > 0, F.lit(False))
    rows = df.select(key, F.when(some, statistics(F.col(image))).alias("s"), F.when(some, quartiles).alias("q"), F.when(some, zeros).alias("zeros"), validity(F.col(image))["is_valid"].alias("is_valid"))
    return rows.select(key, "s.*", *[F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "zeros", "is_valid")


def finalize(df: DataFrame, checks: DataFrame, report_path: str | None = None, seconds: float = 0.0, metrics: DataFrame | None = None) -> str:
    """Write the report, then raise if a check failed."""
    text = report(df, checks, seconds, metrics)
    if report_path:
        from pelagia.sources.sinks import write_text

        write_text(text, report_path)
    bad = [r["check"] for r in checks.filter("not passed").select("check").collect()]
    if bad:
        raise ValueError(f"failed checks: {', '.join(sorted(bad))}")
    return text
