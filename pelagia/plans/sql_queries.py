"""Queries that call filters, metrics and pixels from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagia import registry
from pelagia.functions import sql
from pelagia.plans import pixel_queries  # noqa: F401  its SQL is used
from pelagia.plans.standins import images
from pelagia.registry import query

_of = registry.registered_sql


def _view(spark: SparkSession, sf_dir: str) -> None:
    sql.register(spark)
    images(spark, sf_dir).createOrReplaceTempView("pelagia_images_view")


_CLOSED = ["median", "gaussian", "wiener", "bilateral", "adaptive_median", "kuan"]


@query("sql_filters", " union all ".join(f"select image_id, '{m}' as method, pos, v from ({_of(f'denoise_{m}')}) {m}_q" for m in _CLOSED))
def sql_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six filters by name, and their pixels by the table function."""
    _view(spark, sf_dir)
    return spark.sql(f"""select image_id, method, p.pos, round(p.v, 6) as v from (select image_id, m.method, denoise(noisy, m.method, null) as made
        from pelagia_images_view lateral view explode(array({', '.join(f"'{m}'" for m in _CLOSED)})) m as method), lateral pixels(made) p""")


_METRICS = {"MSE": "mse", "MAE": "mae", "PSNR": "psnr", "SNR": "snr", "CNR": "cnr", "CII": "cii", "Entropy": "entropy"}


@query("sql_metrics", " union all ".join(f"select image_id, '{name}' as metric, value from ({_of(f'metric_{short}')}) {short}_q" for name, short in _METRICS.items()))
def sql_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven metrics of each pair by name."""
    _view(spark, sf_dir)
    return spark.sql(f"""select image_id, metric, round(case when abs(v) < double('infinity') then v end, 6) as value
        from (select image_id, m.metric, image_metric(image, noisy, m.metric) as v from pelagia_images_view lateral view explode(array({', '.join(f"'{m}'" for m in _METRICS)})) m as metric)""")


@query("sql_built_in_metrics", f"select image_id, m.value as mse, a.value as mae, p.value as psnr, s.value as snr from ({_of('metric_mse')}) m join ({_of('metric_mae')}) a using (image_id) join ({_of('metric_psnr')}) p using (image_id) join ({_of('metric_snr')}) s using (image_id)")
def sql_built_in_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four metrics as SQL functions that are planned with the query: no Python."""
    _view(spark, sf_dir)
    value = lambda f: f"round(case when abs(image_{f}(image, noisy)) < double('infinity') then image_{f}(image, noisy) end, 6) as {f}"
    return spark.sql(f"select image_id, {', '.join(map(value, ('mse', 'mae', 'psnr', 'snr')))} from pelagia_images_view")
