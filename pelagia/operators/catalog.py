"""The record catalogue: union, labels, path resolution, patient-safe split, statistics, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.operators.images import HARDWARE

#: Buckets of the split's hash order; their counts are the only thing gathered.
RANK_BUCKETS = 4096

#: The final catalogue, in order.
FINAL_COLUMNS = [
    "patient_id", "abnormality_category", "breast_side", "image_view", "pathology", "label", "dataset_split", "original_image_path",
    "normalized_image_path", "contrast_image_path", "sharpened_image_path", "noise_type", "denoising_method", "noisy_image_path", "denoised_image_path",
]
LINEAGE_KEYS = ["patient_id", "abnormality_category", "breast_side", "image_view", "pathology", "label"]


def normalized_names(df: DataFrame) -> DataFrame:
    """Column names stripped, in lower case, with underscores for spaces."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def standardized_pathology(pathology: Column) -> Column:
    text = F.upper(F.trim(pathology))
    return F.when(text.contains("BENIGN"), "BENIGN").when(text.contains("MALIGNANT"), "MALIGNANT").otherwise("UNKNOWN")


def label_of(standardized: Column) -> Column:
    """0 benign, 1 malignant, else null."""
    return F.when(standardized == "BENIGN", 0).when(standardized == "MALIGNANT", 1)


def union_tagged(tables: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Union by name of tables, each with its literal columns."""
    out = None
    for df, tags in tables:
        df = normalized_names(df).withColumns({k: F.lit(v) for k, v in tags.items()})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def conform(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly these columns in this order; missing ones are null."""
    types = types or {}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in columns])


def filled(c: Column) -> Column:
    """Null for blank text."""
    return F.nullif(F.trim(c), F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor blank, else ''."""
    return F.coalesce(*[filled(c) for c in columns], F.lit(""))


def text_or(c: Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(filled(c), F.lit(default))


def int_or(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(default))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def output_name(*parts: Column, path: Column) -> Column:
    """part_part_..._stem.png"""
    return F.concat(F.concat_ws("_", *[p.cast("string") for p in parts], stem(path)), F.lit(".png"))


def hardware(method: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in HARDWARE.items() for x in kv]), method), F.lit("CPU"))


# --- path resolution -----------------------------------------------------------------------------------------------


def first_file_of_folder(files: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    return files.groupBy(folder).agg(F.min(path).alias(path))


def last_file_of_key(files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Later paths replace earlier ones of the same key."""
    return files.groupBy(key).agg(F.max(path).alias(path))


def resolve_by_segment(df: DataFrame, path: str, folders: DataFrame, files: DataFrame | None = None, root: str = "", marker: str = "jpeg/", out: str = "resolved") -> DataFrame:
    """The file of the first segment that names a folder; else the path under root, if a file; else what follows the last marker.

    folders: folder, path. files: path. Each distinct path is resolved once; indexes are equi-joined."""
    asked = df.select(F.col(path).alias("_p")).distinct().select("_p", F.replace(F.trim("_p"), F.lit("\\"), F.lit("/")).alias("_c"))
    segments = asked.select("_p", F.posexplode(F.split("_c", "/")).alias("_i", "folder"))
    hit = segments.join(folders.select("folder", F.col("path").alias("_f")), "folder").groupBy("_p").agg(F.min_by("_f", "_i").alias("_by_folder"))
    found = asked.join(hit, "_p", "left")
    if files is not None:
        known = files.select(F.col("path").alias("_file")).distinct()
        tries = {"_direct": F.concat(F.lit(root), F.col("_c")), "_after": F.when(F.col("_c").contains(marker), F.concat(F.lit(root), F.element_at(F.split("_c", marker), -1)))}
        for name, candidate in tries.items():
            found = found.withColumn(f"{name}_c", candidate).join(known.withColumnRenamed("_file", name), F.col(f"{name}_c") == F.col(name), "left").drop(f"{name}_c")
    else:
        found = found.withColumns({"_direct": F.lit(None).cast("string"), "_after": F.lit(None).cast("string")})
    found = found.select("_p", F.coalesce("_by_folder", "_direct", "_after").alias(out))
    return df.join(found, F.col(path) == F.col("_p"), "left").drop("_p")


def candidates(path: Column, prefix: str = "/app/", roots: tuple[str, ...] = ()) -> Column:
    """Places to look, in order: as it is, without the prefix, with it, and its name under each root."""
    bare = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20))
    under = F.when(~path.startswith("/"), F.concat(F.lit(prefix), path)).otherwise(F.concat(F.lit(prefix.rstrip("/")), path))
    return F.array_compact(F.array(path, bare, under, *[F.concat(F.lit(r.rstrip("/") + "/"), basename(path)) for r in roots]))


def resolve_candidates(df: DataFrame, path: str, files: DataFrame, out: str = "resolved", **how) -> DataFrame:
    """The first candidate that is a file."""
    asked = df.select(F.col(path).alias("_p")).distinct()
    tried = asked.select("_p", F.posexplode(candidates(F.col("_p"), **how)).alias("_i", "_c"))
    found = tried.join(files.select(F.col("path").alias("_c")).distinct(), "_c").groupBy("_p").agg(F.min_by("_c", "_i").alias(out))
    return df.join(found, F.col(path) == F.col("_p"), "left").drop("_p")


def last_two(path: Column) -> Column:
    """The last two segments of a path, in lower case; null for fewer."""
    parts = F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) >= 2, F.lower(F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))))


def validation_lookup(df: DataFrame, records: DataFrame, value: str, order: str, path: str = "image_path", patient: str = "patient_id", out: str = "validated") -> DataFrame:
    """df with the value of the record that has the last two segments of its path, else of the one that has its patient and
    file name. Of several records of a key the last one by ``order`` counts; null keys match nothing."""
    name = F.lower(basename(F.col(path)))
    by_path = records.groupBy(last_two(F.col(path)).alias("_k")).agg(F.max_by(value, order).alias("_a"))
    by_name = records.groupBy(F.col(patient).alias("_p"), name.alias("_n")).agg(F.max_by(value, order).alias("_b"))
    asked = df.withColumns({"_k": last_two(F.col(path)), "_p": F.col(patient), "_n": name})
    found = asked.join(by_path, "_k", "left").join(by_name, ["_p", "_n"], "left")
    return found.withColumn(out, F.coalesce("_a", "_b")).select(*df.columns, out)


def matching_or_head(df: DataFrame, column: str, pattern: str, order: list[str], n: int = 10) -> DataFrame:
    """The rows whose column holds the pattern, in any case (null does not); the first n by ``order`` if there are none.

    Both are one plan: the fallback is n rows, anti-joined with whether there is a match."""
    hits = df.filter(F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))
    none = df.orderBy(*order).limit(n).join(F.broadcast(hits.limit(1).select(F.lit(True).alias("_any"))), F.col("_any"), "left_anti")
    return hits.unionByName(none)


def hash_share(key: Column, seed: int = 42) -> Column:
    """In [0, 1), from md5 of seed and key: the same for a key wherever its row is."""
    text = F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def random_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """About 1 - share of the keys, and the others: a row's side depends on its key and the seed alone, so that retries,
    partitions and other rows do not matter, and all rows of a key are on one side."""
    held = hash_share(F.col(key), seed) < share
    return df.filter(~held), df.filter(held)


# --- dedup, lineage ------------------------------------------------------------------------------------------------


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order. An aggregate rather than a window, so that a frequent key is reduced before it moves."""
    rest = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(rest).alias("_m")).select("_m._row.*")


def lineage(experiments: DataFrame, clean: DataFrame, keys: list[str], order: list[str], bring: list[str]) -> DataFrame:
    """Inner join on keys (null matches null) with the first clean row of each key."""
    one = keep_first(clean, keys, order).select(*[F.col(k).alias(f"_{k}") for k in keys], *bring)
    test = None
    for k in keys:
        t = F.col(k).eqNullSafe(F.col(f"_{k}"))
        test = t if test is None else test & t
    return experiments.join(one, test).drop(*[f"_{k}" for k in keys])


def final_catalog(clean: DataFrame, metrics: DataFrame | None, order: list[str], include_experiments: bool = True) -> DataFrame:
    """Baseline rows and, with metrics, a row for each experiment, in the fixed columns."""
    types = {"label": "int"}
    baseline = conform(clean.drop("noise_type", "denoising_method", "noisy_image_path", "denoised_image_path"), FINAL_COLUMNS, types)
    if metrics is None or not include_experiments:
        return baseline
    keys = [k for k in LINEAGE_KEYS if k in clean.columns and k in metrics.columns]
    renames = {"noisy_image": "noisy_image_path", "denoised_image": "denoised_image_path"}
    metrics = metrics.withColumnsRenamed({k: v for k, v in renames.items() if k in metrics.columns})
    bring = [c for c in FINAL_COLUMNS if c in clean.columns and c not in metrics.columns]
    return baseline.unionByName(conform(lineage(metrics, clean, keys, order, bring), FINAL_COLUMNS, types))


# --- split ---------------------------------------------------------------------------------------------------------


def patient_mode(df: DataFrame, patient: str = "patient_id", label: str = "label") -> DataFrame:
    """The most frequent label of each patient, the smallest of equals; nulls are skipped."""
    n = df.filter(F.col(label).isNotNull()).groupBy(patient, label).agg(F.count("*").alias("_n"))
    return n.groupBy(patient).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(label))


def stratified_split(patients: DataFrame, ratios: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42, patient: str = "patient_id", label: str = "label") -> DataFrame:
    """patient, label, split: patients in the order of md5(seed-patient) within a label; test sides are rounded up.

    Ranks are a bucket's offset and a place in it, so no task sorts a whole label."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col(patient).cast("string")))
    hashed = patients.select(patient, label, h.alias("_h")).withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * RANK_BUCKETS / 65536).cast("int"))
    counts = hashed.groupBy(label, "_b").agg(F.count("*").alias("_n"))  # at most labels * RANK_BUCKETS rows
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    up = lambda x: F.ceil(F.round(x, 9))
    so_far = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    sizes = counts.groupBy(label).agg(F.sum("_n").alias("_size")).withColumn("_cum", F.sum("_size").over(so_far))  # a row per label
    held, last = ratios[1] + ratios[2], ratios[2] / (ratios[1] + ratios[2])
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(Window.orderBy(label)), F.lit(0))
    sizes = sizes.withColumn("_held_cum", up(F.col("_cum") * held)).withColumn("_test_cum", up(F.col("_held_cum") * last))
    sizes = sizes.select(F.col(label).alias("_s"), "_size", step("_held_cum").alias("_held"), step("_test_cum").alias("_test"))
    ranked = hashed.join(offsets, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c"))).join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_s")))  # a row per label
    rank = F.col("_o") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", patient))
    split = F.when(F.col("_r") <= F.col("_size") - F.col("_held"), "train").when(F.col("_r") <= F.col("_size") - F.col("_test"), "val").otherwise("test")
    return ranked.withColumn("_r", rank).select(patient, label, split.alias("split"))


def split_summary(records: DataFrame, split: DataFrame, patient: str = "patient_id", label: str = "label") -> DataFrame:
    """cases, patients and malignant share of each split; one join stands for the three membership tests."""
    joined = records.join(split.select(patient, "split"), patient)
    return joined.groupBy("split").agg(F.count("*").alias("cases"), F.count_distinct(patient).alias("patients"), F.round(F.avg(label) * 100, 2).alias("malignant_pct"))


# --- statistics ----------------------------------------------------------------------------------------------------


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Seven (metric, value) rows."""
    when = lambda c, v: F.count_if(F.col(c) == v)
    one = df.agg(
        F.count("*").alias("total_records"), F.count_if(F.col("file_exists")).alias("existing_files"), F.count_distinct("patient_id").alias("unique_patients"),
        when("standardized_pathology", "BENIGN").alias("benign_cases"), when("standardized_pathology", "MALIGNANT").alias("malignant_cases"),
        when("abnormality_category", "mass").alias("mass_cases"), when("abnormality_category", "calcification").alias("calcification_cases"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n; nulls are dropped. One pass for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, c: str) -> DataFrame:
    """Values that come more than once, and how often beyond the first."""
    return df.groupBy(c).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def group_to_map(df: DataFrame, group: str, key: str, value: str, order: str) -> DataFrame:
    """A map of each group; the value that comes last in order wins."""
    one = df.groupBy(group, key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))
    return one.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("map"), F.min(order).alias("first"))


def spread_medians(df: DataFrame, keys: list[str], metrics: list[str], buckets: int = 64) -> DataFrame:
    """Exact medians ``<metric>_median`` by keys (without nulls), no task holding all values of a group.

    Approximate quantiles cut each group's values into buckets; counts of buckets tell which ones hold the middle
    ranks, and only those are ranked, equal values being counted first."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("_m"), F.col(m).cast("double").alias("_v")) for m in metrics])).alias("p")
    long = df.select(*keys, pairs).select(*keys, "p.*").filter("_v is not null").groupBy(*keys, "_m", "_v").agg(F.count("*").alias("_n"))
    by = [*keys, "_m"]
    cuts = long.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 1000)).alias("_cuts"))
    placed = long.join(cuts, by).select(*by, "_v", "_n", F.size(F.filter("_cuts", lambda x: x <= F.col("_v"))).alias("_b"))
    sums = placed.groupBy(*by, "_b").agg(F.sum("_n").alias("_in"))  # at most ``buckets`` rows of a group
    whole, earlier = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", "_in", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"), F.sum("_in").over(whole).alias("_all"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)  # ranks from 0
    middle = sums.filter((F.col("_before") <= high) & (F.col("_before") + F.col("_in") > low))
    upto = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(middle, [*by, "_b"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r)
    ends = ranked.groupBy(*by).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"))
    one = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.col("_low") + F.col("_high")) / 2)
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == m, one)).alias(f"{m}_median") for m in metrics])


def grouped_statistics(df: DataFrame, keys: list[str], metrics: list[str], spread: bool = False) -> DataFrame:
    """mean, std, median, min and max of the metrics that the table has; null keys are dropped.

    The built-in median holds the distinct values of a group in one task; ``spread`` is for groups too large for that."""
    metrics, rows = [m for m in metrics if m in df.columns], df.dropna(subset=keys)
    median = (lambda m: F.lit(None).cast("double")) if spread else F.median
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), median(m).alias(f"{m}_median"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    out = rows.groupBy(*keys).agg(*aggs)
    if not spread or not metrics:
        return out
    names = out.columns
    return out.drop(*[f"{m}_median" for m in metrics]).join(spread_medians(rows, keys, metrics), keys, "left").select(*names)


def pivoted(df: DataFrame, index: str, columns: str, value: str, values: list[str]) -> DataFrame:
    return df.groupBy(index).pivot(columns, sorted(values)).agg(F.first(value))


#: Records that the validation table of a build looks at.
VALIDATED = 200


def validation(df: DataFrame, decoded: DataFrame | None = None, n: int = VALIDATED) -> DataFrame:
    """patient_id, image_path, is_valid, height, width, min_intensity, max_intensity and pathology of the first n records with
    a file, in the order of their tables. decoded: path, image (8-bit values; null where damaged); without it nothing is
    valid. A record whose path is not in decoded is not valid."""
    from pelagia.sources.files import PLACE, head

    rows = head(df.filter("file_exists"), n).select(PLACE, "patient_id", "image_path", F.col("standardized_pathology").alias("pathology"))
    if decoded is None:
        rows = rows.withColumn("image", F.lit(None).cast("struct<height: int, width: int, data: array<double>>"))
    else:
        rows = rows.join(decoded.groupBy(F.col("path").alias("image_path")).agg(F.any_value("image").alias("image")), "image_path", "left")
    d = F.col("image.data")
    valid = F.coalesce(F.size(d) > 0, F.lit(False))
    some = lambda c: F.when(valid, c)
    return rows.orderBy(PLACE).select("patient_id", "image_path", valid.alias("is_valid"), some(F.col("image.height")).alias("height"), some(F.col("image.width")).alias("width"), some(F.array_min(d).cast("int")).alias("min_intensity"), some(F.array_max(d).cast("int")).alias("max_intensity"), "pathology")


def build_master(tables: dict[str, DataFrame], folders: DataFrame, files: DataFrame, root: str = "", seed: int = 42, decoded: DataFrame | None = None) -> dict[str, DataFrame]:
    """master, validation (of tables with a PLACE, as read_bundle gives them), statistics, split and split_report from the
    four case tables and the image index."""
    from pelagia.sources.files import PLACE

    tag = {"mass_train": ("mass", "train"), "mass_test": ("mass", "test"), "calc_train": ("calcification", "train"), "calc_test": ("calcification", "test")}
    missing = [k for k in tag if k not in tables]
    if missing:
        raise FileNotFoundError(f"missing tables: {missing}")
    df = union_tagged([(tables[k], {"abnormality_category": c, "dataset_split": s}) for k, (c, s) in tag.items()])
    df = df.withColumn("standardized_pathology", standardized_pathology(F.col("pathology")))
    df = df.withColumn("label", label_of(F.col("standardized_pathology")))
    for raw, out in (("image_file_path", "resolved_full_mammogram_path"), ("cropped_image_file_path", "resolved_cropped_path"), ("roi_mask_file_path", "resolved_roi_mask_path")):
        df = resolve_by_segment(df, raw, folders, files, root, out=out) if raw in df.columns else df.withColumn(out, F.lit(None).cast("string"))
    df = df.withColumn("image_path", F.coalesce("resolved_full_mammogram_path", "resolved_cropped_path")).withColumn("file_exists", F.col("image_path").isNotNull())
    split = stratified_split(patient_mode(df), seed=seed)
    df = df.join(split.select("patient_id", "split"), "patient_id", "left")
    checked = {"validation": validation(df, decoded)} if PLACE in df.columns else {}
    df = df.drop(PLACE)
    return {"master": df, **checked, "statistics": dataset_statistics(df), "split": split, "split_report": split_summary(df.drop("split"), split)}
