"""The experiment over the filters that SQL can express, and its summary; the SQL is put together from that of the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia import registry
from pelagia.operators import experiment, noise
from pelagia.operators import images as im
from pelagia.plans.pixel_queries import NOISY, POISSON
from pelagia.plans.standins import PX, images
from pelagia.registry import query

#: Non-local means compares 441 patches for every pixel: too slow as SQL, and measured by the kernel's tests alone.
METHODS = [m for m in im.FILTERS if m != "non_local_means"]
_SHORT = {"MSE": "mse", "PSNR": "psnr", "SSIM": "ssim", "SNR": "snr", "CNR": "cnr", "CII": "cii", "Entropy": "entropy"}


def _rest(name: str) -> str:
    """The tables and the select of a registered query, without the stand-ins' own tables."""
    text = registry.registered_sql(name).removeprefix(f"with {PX}").lstrip()
    return f"with {text[1:]}" if text.startswith(",") else text


def _unrounded(name: str) -> str:
    head, _, tail = _rest(name).rpartition("round(")
    value, _, end = tail.rpartition(", 6) as v")
    return f"{head}({value}) as v{end}"


def _nested(name: str) -> str:
    rest = _rest(name)
    tables = "px as (select * from clean_of), ns as (select * from made)"
    return f"with {tables}, {rest[5:]}" if rest.startswith("with ") else f"with {tables} {rest}"


def _metrics_sql() -> str:
    """An image's id goes through noise (times 5) and filter (times their number) and back."""
    before = PX.rpartition(",\nns as")[0]
    n, m = len(noise.MODELS), len(METHODS)
    noisy = " union all ".join(f"select image_id * {n} + {i} as image_id, pos, y, x, {NOISY[k][1]} as v from {NOISY[k][0]}" for i, k in enumerate(noise.MODELS))
    filtered = ", ".join(f"f{i} as materialized ({_unrounded(f'denoise_{k}')})" for i, k in enumerate(METHODS))
    made = " union all ".join(f"select image_id * {m} + {i} as image_id, pos, (pos // 8)::int as y, (pos % 8)::int as x, v from f{i}" for i in range(m))
    measured = ", ".join(f"m_{short} as materialized ({_nested(f'metric_{short}')})" for short in _SHORT.values())
    noises, methods = ([f"'{k}'" for k in x] for x in (noise.MODELS, METHODS))
    digits = {"SSIM": 5}
    columns = ", ".join(f"round(m_{short}.value, {digits.get(k, 6)}) as {short}" for k, short in _SHORT.items())
    joins = " ".join(f"left join m_{short} on m_{short}.image_id = ids.image_id" for short in _SHORT.values())
    return f"""with {before}, {POISSON}, ns as materialized ({noisy}), {filtered}, made as materialized ({made}),
clean_of as materialized (select px.image_id * {n * m} + k as image_id, pos, y, x, v from px, range({n * m}) r(k)), {measured},
ids as (select distinct image_id from made)
select ids.image_id // {n * m} as image_id, ([{', '.join(noises)}])[(ids.image_id // {m}) % {n} + 1] as noise_type, ([{', '.join(methods)}])[ids.image_id % {m} + 1] as denoising_method, {columns} from ids {joins}"""


METRICS_SQL = _metrics_sql()


@query("experiment_closed", METRICS_SQL)
def experiment_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven metrics for each image, noise model and filter with a closed form."""
    out = experiment.run(images(spark, sf_dir, even=True).select("image_id", "image"), methods=METHODS)
    value = lambda k: F.when(F.abs(F.col(k)) < float("inf"), F.col(k))
    return out.select(*experiment.KEYS, *[F.round(value(k), 5 if k == "SSIM" else 6).alias(short) for k, short in _SHORT.items()])


_STATISTICS = ", ".join(f"round({f}({c}), 4) as {c}_{name}" for c in _SHORT.values() for name, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query("noise_method_summary_closed", f"with r as ({METRICS_SQL}) select noise_type, denoising_method, {_STATISTICS} from r group by all")
def noise_method_summary_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment's 35 statistics for each noise model and filter with a closed form."""
    out = experiment.grouped_statistics(experiment_closed(spark, sf_dir), experiment.KEYS[1:], list(_SHORT.values()))
    return out.select(*[F.round(c, 4).alias(c) if c not in experiment.KEYS else F.col(c) for c in out.columns])
