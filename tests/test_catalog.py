"""Catalogue, audit, experiment and evaluation on the fixtures of the reference's own tests."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import audit, catalog, evaluation, experiment
from pelagia.operators import images as im
from pelagia.sources import files, sinks
from tests.test_images import frame


def test_labels(spark):
    rows = [("BENIGN",), ("BENIGN_WITHOUT_CALLBACK",), ("MALIGNANT",), ("UNKNOWN_LABEL",), (None,), (" malignant ",)]
    got = spark.createDataFrame(rows, "p string").select(catalog.standardized_pathology(F.col("p")).alias("s")).select("s", catalog.label_of(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("BENIGN", 0), ("BENIGN", 0), ("MALIGNANT", 1), ("UNKNOWN", None), ("UNKNOWN", None), ("MALIGNANT", 1)]


def test_master(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    head = "patient_id,left or right breast,image view,pathology,image file path,cropped image file path,ROI mask file path\n"
    for k, name in files.BUNDLE.items():
        body = "".join(f"P_{i:05d},LEFT,CC,{'MALIGNANT' if i % 3 == 0 else 'BENIGN'},x/uid{i}/a.dcm,y\\uid{i + 1}\\b.dcm,\n" for i in range(20)) if "case" in name else "a\n1\n"
        (d / name).write_text((head if "case" in name else "") + body)
    bundle = files.read_bundle(spark, str(tmp_path))
    folders = spark.createDataFrame([(f"uid{i}", f"/jpeg/uid{i}/1-1.jpg") for i in range(0, 20, 2)], "folder string, path string")
    out = catalog.build_master(bundle, folders, spark.createDataFrame([], "path string"))
    m = out["master"]
    v = out["validation"].collect()  # as the tables stand: mass before calcification, train before test
    assert [r.patient_id for r in v] == [f"P_{i:05d}" for _ in range(4) for i in range(19)] and not any(r.is_valid for r in v)
    assert files.PLACE not in m.columns and m.count() == 80 and m.filter("file_exists").count() == 76
    assert m.filter("resolved_full_mammogram_path is not null").count() == 40
    stats = {r.metric: r.value for r in out["statistics"].collect()}
    assert (stats["total_records"], stats["unique_patients"], stats["malignant_cases"], stats["mass_cases"]) == (80, 20, 28, 40)
    assert m.filter("split is null").count() == 0
    (d / files.BUNDLE["meta"]).unlink()
    with pytest.raises(FileNotFoundError):
        files.read_bundle(spark, str(tmp_path))


def test_validation_reads_the_first_records_in_file_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"P{9 - i}", f"f{i}.png", "BENIGN", i != 2) for i in range(10)], "patient_id string, image_path string, standardized_pathology string, file_exists boolean")
    rows.coalesce(1).write.option("header", True).csv(f"{tmp_path}/t")
    df = files.placed(files.read_csv(spark, f"{tmp_path}/t")).repartition(4)
    image = "struct<height: int, width: int, data: array<double>>"
    decoded = spark.createDataFrame([("f0.png", (1, 2, [3.0, 9.0])), ("f1.png", None), ("f0.png", (1, 2, [3.0, 9.0]))], f"path string, image {image}")
    got = [tuple(r) for r in catalog.validation(df, decoded, 4).collect()]
    assert got == [("P9", "f0.png", True, 1, 2, 3, 9, "BENIGN"), ("P8", "f1.png", False, None, None, None, None, "BENIGN"), ("P6", "f3.png", False, None, None, None, None, "BENIGN"), ("P5", "f4.png", False, None, None, None, None, "BENIGN")]


def test_ordinals_follow_the_files_under_any_partitioning(spark, tmp_path):
    (tmp_path / "t").mkdir()
    want = []
    for part in range(3):
        lines = [f"{(7919 * (i + 100 * part)) % 1009},{'x' * (i % 40)}" for i in range(400)]
        want += [int(x.split(",")[0]) for x in lines]
        (tmp_path / "t" / f"part-{part}.csv").write_text("\n".join(["k,v", *lines]) + "\n")
    for size in ("128m", "2k", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            df = files.placed(spark.read.option("header", True).schema("k int, v string").csv(f"{tmp_path}/t"))
            assert [r.k for r in files.numbered(df).orderBy("ordinal").collect()] == want, size
            assert [r.ordinal for r in files.numbered(df).orderBy("ordinal").select("ordinal").collect()] == list(range(1200))
            assert [r.k for r in files.head(df, 500).collect()] == want[:500]
            first = {r.v: r.k for r in files.first_of_each(df, ["v"]).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert first == {(None if not i else "x" * i): want[i] for i in range(40)}


def test_split_sizes_of_the_published_corpus(spark):
    df = spark.range(1566).select(F.col("id").cast("string").alias("patient_id"), (F.col("id") % 5 < 2).cast("int").alias("label"))
    out = catalog.stratified_split(df)
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 1096, "val": 235, "test": 235}
    shares = [r.m for r in out.groupBy("split").agg(F.avg("label").alias("m")).collect()]
    assert max(shares) - min(shares) < 0.01 and out.select("patient_id").distinct().count() == 1566
    again = {tuple(r) for r in catalog.stratified_split(df.repartition(7)).collect()}
    assert again == {tuple(r) for r in out.collect()}
    with pytest.raises(ValueError):
        catalog.stratified_split(df, (0.5, 0.2, 0.2))


def test_resolvers(spark):
    folders = spark.createDataFrame([("b", "f/b/1.png"), ("c", "f/c/1.png")], "folder string, path string")
    known = spark.createDataFrame([("r/x/y.png",), ("r/z.png",)], "path string")
    asked = spark.createDataFrame([("a\\c\\b",), ("x/y.png",), ("data/jpeg/z.png",), ("none",), (None,)], "p string")
    got = {r.p: r.resolved for r in catalog.resolve_by_segment(asked, "p", folders, known, "r/").collect()}
    assert got == {"a\\c\\b": "f/c/1.png", "x/y.png": "r/x/y.png", "data/jpeg/z.png": "r/z.png", "none": None, None: None}
    there = spark.createDataFrame([("data/a.png",), ("/app/data/b.png",), ("alt/c.png",)], "path string")
    asked = spark.createDataFrame([("/app/data/a.png",), ("data/b.png",), ("q/c.png",), ("z",)], "p string")
    got = {r.p: r.resolved for r in catalog.resolve_candidates(asked, "p", there, roots=("alt",)).collect()}
    assert got == {"/app/data/a.png": "data/a.png", "data/b.png": "/app/data/b.png", "q/c.png": "alt/c.png", "z": None}


@pytest.fixture(scope="module")
def final(spark):
    clean = [(f"P_{i}", "mass", "LEFT", "CC", "BENIGN" if i % 2 else "MALIGNANT", 1 - i % 2, "train" if i < 7 else "test", *[f"{k}/{i}.png" for k in ("o", "n", "c", "s")], i) for i in range(10)]
    clean = spark.createDataFrame(clean, "patient_id string, abnormality_category string, breast_side string, image_view string, pathology string, label int, dataset_split string, original_image_path string, normalized_image_path string, contrast_image_path string, sharpened_image_path string, ordinal int")
    keys = experiment.keys(clean.withColumn("image_id", F.col("ordinal")))
    made = keys.withColumn("noisy_image", F.concat_ws("/", F.lit("noisy"), "noise_type", "image_id")).withColumn("denoised_image", F.concat_ws("/", F.lit("denoised"), "noise_type", "denoising_method", "image_id"))
    metrics = made.join(clean.select("ordinal", *catalog.LINEAGE_KEYS), made["image_id"] == clean["ordinal"])
    return catalog.final_catalog(clean, metrics, ["ordinal"]).cache(), clean


def test_final_catalog(final):
    df, clean = final
    assert df.columns == catalog.FINAL_COLUMNS and df.count() == 410
    assert df.filter("noise_type is null").count() == 10
    assert catalog.final_catalog(clean, None, ["ordinal"]).count() == 10


def checks(spark, df):
    paths = audit.unpivoted(df, audit.PATHS).select("path").distinct()
    sizes = paths.withColumn("height", F.lit(512)).withColumn("width", F.lit(512))
    return {r.check: r.passed for r in audit.run_checks(df, paths, sizes).collect()}


def test_audit_passes_and_each_mutation_fails_one_check(spark, final, tmp_path):
    df, _ = final
    assert all(checks(spark, df).values()) and len(checks(spark, df)) == 7
    first = F.col("patient_id") == "P_1"
    base = first & F.col("noise_type").isNull()
    leaked = df.withColumn("dataset_split", F.when(base, "test").otherwise(F.col("dataset_split")))
    blank = df.withColumn("pathology", F.when(base, None).otherwise(F.col("pathology")))
    wrong = df.withColumn("label", F.when(base, 1).otherwise(F.col("label")))
    twice = df.withColumn("sharpened_image_path", F.when(F.col("noise_type").isNull() & F.col("patient_id").isin("P_1", "P_2"), "s/1.png").otherwise(F.col("sharpened_image_path")))
    raw = df.withColumn("contrast_image_path", F.when(base, "data/raw/1.png").otherwise(F.col("contrast_image_path")))
    for bad, name in ((leaked, "no_train_test_patient_leakage"), (blank, "pathology_is_not_missing"), (wrong, "label_matches_pathology"), (twice, "no_duplicate_output_paths"), (raw, "no_raw_files_modified")):
        assert [k for k, ok in checks(spark, bad).items() if not ok] == [name]
    paths = audit.unpivoted(df, audit.PATHS).select("path").distinct().filter("path <> 's/3.png'")
    sizes = paths.withColumn("height", F.when(F.col("path") == "s/4.png", 100).otherwise(512)).withColumn("width", F.lit(512))
    out = audit.run_checks(df, paths, sizes)
    assert {r.check: (r.violations, r.samples) for r in out.filter("not passed").collect()} == {"every_referenced_file_exists": (41, ["s/3.png"]), "image_dimensions_are_valid": (1, ["s/4.png"])}
    with pytest.raises(ValueError, match="every_referenced"):
        audit.finalize(df, out, f"{tmp_path}/r/report.txt")
    assert "Total records: 410" in (tmp_path / "r/report.txt").read_text()


def test_report_sections_hold_measured_values(spark, final, tmp_path):
    df, _ = final
    n = df.count()
    metrics = spark.createDataFrame([("median", 20.0, 0.5, 0.01, 1.0), ("median", 30.0, 0.7, 0.03, 3.0), ("kuan", 10.0, None, 0.2, 0.5)], "denoising_method string, PSNR double, SSIM double, MSE double, CNR double")
    paths = audit.unpivoted(df, audit.PATHS).select("path").distinct()
    good = audit.run_checks(df, paths, paths.withColumn("height", F.lit(512)).withColumn("width", F.lit(512)))
    text = audit.finalize(df, good, seconds=1.5, metrics=metrics)
    heads = [x[3:] for x in text.splitlines() if x[:1].isdigit() and x[1:3] == ". "]
    assert heads == ["Records", "Compute", "Cohort", "Noise", "Denoising", "Checks", "Sign-off"]
    assert "All checks passed." in text and "Failed: 0" in text and f"Successful: {n}" in text and "Master: local" in text
    for c in ("dataset_split", "pathology", "noise_type", "denoising_method"):
        for r in df.filter(F.col(c).isNotNull()).groupBy(c).count().collect():
            assert any(x.split()[:2] == [str(r[0]), str(r["count"])] for x in text.splitlines()), (c, r)
    assert ["median", "25.0000", "0.6000", "0.0200", "2.0000"] in [x.split() for x in text.splitlines()]
    missing = audit.report(df, audit.run_checks(df, paths.filter("path <> 's/3.png'"), paths.withColumn("height", F.lit(512)).withColumn("width", F.lit(512))))
    assert "Integrity: FAILED" in missing and "s/3.png" in missing and "Failed checks: every_referenced_file_exists" in missing
    empty = audit.report(df.limit(0), good)
    assert "Total records: 0" in empty and "Failed: 0" in empty


def test_validation_lookup_prefers_paths_and_the_last(spark):
    df = spark.createDataFrame([(1, "a/b/x.png", "P1"), (2, "other/x.png", "P1"), (3, "y.png", "P2"), (4, None, "P1"), (5, "q\\B\\X.png", None)], "k int, image_path string, patient_id string")
    records = spark.createDataFrame([("b/x.png", "P9", "one", 1), ("z/b/X.png", "P9", "two", 2), ("r/x.png", "P1", "three", 3), ("s/y.png", "P2", "four", 1), (None, None, "five", 9)], "image_path string, patient_id string, v string, o int")
    got = {r.k: r.validated for r in catalog.validation_lookup(df, records, "v", "o").collect()}
    assert got == {1: "two", 2: "three", 3: "four", 4: None, 5: "two"}


def test_matching_or_head(spark):
    df = spark.createDataFrame([(3, "Abc"), (1, "xABCx"), (2, None), (4, "d")], "k int, t string")
    assert sorted(r.k for r in catalog.matching_or_head(df, "t", "abc", ["k"]).collect()) == [1, 3]
    assert [r.k for r in catalog.matching_or_head(df, "t", "nothing", ["k"], 2).orderBy("k").collect()] == [1, 2]
    assert catalog.matching_or_head(df.limit(0), "t", "a", ["k"]).collect() == []


def test_random_split_does_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    one = [sorted(r.k for r in side.collect()) for side in catalog.random_split(df.repartition(7), "k")]
    two = [sorted(r.k for r in side.collect()) for side in catalog.random_split(df.coalesce(1).orderBy(F.desc("k")), "k")]
    assert one == two and sorted(one[0] + one[1]) == list(range(3000)) and 500 < len(one[1]) < 700
    assert [len(s.collect()) for s in catalog.random_split(df, "k", seed=7)] != [len(x) for x in one]
    assert sum(s.count() for s in catalog.random_split(spark.createDataFrame([(None,), (None,)], "k long"), "k")) == 2


def test_inspection(spark):
    df = frame(spark, np.array([[0.0, 0.5], [1.0, 0.5]]), np.full((2, 2), 0.3)).unionByName(frame(spark, np.ones((1, 1))).select(F.lit(9).cast("long").alias("image_id"), F.lit(None).cast("struct<height:int,width:int,data:array<double>>").alias("image")))
    got = {r.image_id: r for r in audit.inspection(df, "image_id").collect()}
    assert (got[0].q25, got[0].q50, got[0].q75, got[0].zeros, got[0].is_valid, got[0].max) == (0.375, 0.5, 0.625, 0.25, True, 1.0)
    assert not got[1].is_valid and got[9].mean is None and not got[9].is_valid


def test_estimate():
    e = experiment.estimate(10)
    assert [e[k] for k in ("experiments", "noise_operations", "denoise_operations", "metric_evaluations", "total_operations", "files")] == [400, 50, 400, 2800, 3250, 450]


def test_experiment_runs_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = frame(spark, *[np.clip(rng.random((16, 16)), 0, 1) for _ in range(3)]).withColumn("patient_id", F.lit("P"))  # one patient, three images
    path = f"{tmp_path}/metrics"
    assert experiment.checkpointed(df, path, confirm=False) is None
    assert experiment.checkpointed(df, path, False, mode="estimate").first().experiments == 120
    out = experiment.checkpointed(df.filter("image_id < 2"), path, confirm=True)
    assert out.count() == 80
    out = experiment.checkpointed(df, path, confirm=True)
    assert out.count() == 120 and out.select(*experiment.KEYS).distinct().count() == 120
    assert experiment.checkpointed(df, path, confirm=True).count() == 120
    s = experiment.summary(out)
    assert s.count() == 40 and len(s.columns) == 37
    kept = experiment.remaining(experiment.keys(df), out.withColumn("denoised_image", F.lit("a")), spark.createDataFrame([("b",)], "path string"))
    assert kept.count() == 120


def test_evaluation(spark, tmp_path):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1), (1, 1, 0.8)]
    df = spark.createDataFrame(rows, "t int, p int, s double")
    r = evaluation.rates(evaluation.confusion(df, "t", "p")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1) and r.accuracy == 0.6 and r.f1 == pytest.approx(2 / 3)
    assert evaluation.auc(df, "t", "s").first().auc == pytest.approx(5 / 6)
    assert evaluation.auc(df.filter("t = 1"), "t", "s").first().auc is None
    assert evaluation.auc(df.limit(0), "t", "s").first().auc is None and evaluation.roc_points(df.limit(0), "t", "s").count() == 0
    assert evaluation.rates(evaluation.confusion(df.limit(0), "t", "p")).first().f1 == 0
    assert evaluation.cosine_rate(0, 10) == pytest.approx(1e-4) and evaluation.cosine_rate(10, 10) == pytest.approx(1e-6)


def test_curves_over_many_scores_match_brute_force(spark):
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.normal(size=2000), np.round(rng.normal(size=1000), 1), np.full(1500, 0.25)])  # a third tied
    t = (rng.random(len(s)) < 0.4).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, s, strict=True)], "t int, s double")
    got = evaluation.roc_points(df, "t", "s").collect()
    assert len(got) == len(set(s.tolist()))
    for r in got[:: max(1, len(got) // 40)]:
        assert r.tpr == pytest.approx((s[t == 1] >= r.threshold).mean()) and r.fpr == pytest.approx((s[t == 0] >= r.threshold).mean())
    more, less = s[t == 1][:, None], s[t == 0][None, :]
    assert evaluation.auc(df, "t", "s").first().auc == pytest.approx(((more > less) + 0.5 * (more == less)).mean())
    with_null = df.unionByName(spark.createDataFrame([(1, None)], "t int, s double"))
    assert evaluation.roc_points(with_null, "t", "s").filter("threshold is null").first().tpr == 1  # last of all


def test_spread_medians_match_the_built_in_one(spark):
    rng = np.random.default_rng(5)
    rows = [(str(g), float(v)) for g in range(3) for v in np.concatenate([rng.normal(size=700 + g), np.full(400, 0.5)])]
    rows += [("inf", float("inf")), ("inf", 1.0), ("one", 2.0), ("two", 1.0), ("two", 4.0), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, a double").withColumn("b", -F.col("a"))
    plain = catalog.grouped_statistics(df, ["k"], ["a", "b", "c"])
    spread = catalog.grouped_statistics(df, ["k"], ["a", "b", "c"], spread=True)
    assert plain.columns == spread.columns
    medians = lambda d: sorted(map(repr, d.select("k", "a_median", "b_median").collect()))
    assert medians(plain) == medians(spread) and spread.count() == 7
    assert catalog.grouped_statistics(df.limit(0), ["k"], ["a"], spread=True).count() == 0


def test_losses_and_rates(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, 0.7)], "t int, p double")
    ce = [-np.log(x) for x in (0.9, 0.8, 0.3)]
    row = evaluation.validate(df, "t", "p").first()
    assert row.loss == pytest.approx(np.mean(ce)) and row.accuracy == pytest.approx(2 / 3)
    weighted = evaluation.validate(df, "t", "p", "weighted_ce", {1: 3.0}).first()
    assert weighted.loss == pytest.approx((3 * ce[0] + ce[1] + ce[2]) / 5)
    focal = evaluation.validate(df, "t", "p", "focal").first()
    assert focal.loss == pytest.approx(np.mean([0.25 * (1 - np.exp(-c)) ** 2 * c for c in ce]))
    assert evaluation.validate(df.limit(0), "t", "p").first().loss is None
    assert evaluation.plateau_rates([0.5] * 7, 1.0) == [1, 1, 1, 1, 1, 1, 0.5]
    assert evaluation.plateau_rates([i / 10 for i in range(1, 9)], 1.0) == [1.0] * 8


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x", y', 1.5)], "k string, t string, v double")
    sinks.write_csv(df, f"{tmp_path}/c", single=True)
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c").collect()] == [("a", 'say "x", y', 1.5)]
    sinks.save_json({"a": [1]}, f"{tmp_path}/j/x.json")
    assert sinks.load_json(f"{tmp_path}/j/x.json") == {"a": [1]}
    with pytest.raises(FileNotFoundError):
        files.load_config(f"{tmp_path}/none.yaml")
    assert files.load_config(f"{tmp_path}/none.yaml", missing_ok=True) == {}
    (tmp_path / "c.yaml").write_text("a: {b: [1, 2]}")
    assert files.load_config(f"{tmp_path}/c.yaml") == {"a": {"b": [1, 2]}}


def test_every_query_has_the_columns_of_its_sql(spark):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and "noise_method_summary" in found
    for name in ("median_psnr", "split_summary", "final_catalog", "metric_cnr", "otsu_regions", "audit_unique_outputs"):
        got = sorted(map(repr, found[name](spark, sf).toPandas().pipe(lambda d: d[sorted(d.columns)]).itertuples(index=False, name=None)))
        want = sorted(map(repr, con.sql(sql[name]).df().pipe(lambda d: d[sorted(d.columns)]).itertuples(index=False, name=None)))
        assert re.sub("nan|None", "", str(got)) == re.sub("nan|None", "", str(want)), name
    assert im.FILTERS.keys() == {"median", "gaussian", "wiener", "bilateral", "non_local_means", "anscombe_wiener", "adaptive_median", "kuan"}
