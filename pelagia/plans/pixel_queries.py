"""Queries of pixel operators, noise, filters and metrics over the image stand-ins."""

from __future__ import annotations

from math import pi

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions import pixels as px
from pelagia.functions import points
from pelagia.operators import experiment, noise
from pelagia.operators import images as im
from pelagia.plans.standins import PX, images, near, pixels
from pelagia.registry import query


def _pixel_query(name: str, make, sql: str | None, digits: int = 6) -> None:
    query(name, sql)(lambda spark, sf_dir: pixels((df := images(spark, sf_dir)), make(df), digits))


def _select(expression: str, source: str = "px") -> str:
    return f"with {PX} select image_id, pos, round({expression}, 6) as v from {source}"


def _kernel(name: str, column: str = "image", **params):
    return lambda df: im.apply_named(df[column], name, **params)


Q = "round_even(v * 255, 0)"

# --- intensity and geometry

_pixel_query("normalize_minmax", lambda df: points.normalize_image(df["image"], 0.1, 0.9), f"with {PX}, r as (select image_id, min(v) as lo, max(v) as hi from px group by 1) select image_id, pos, round(0.1 + (v - lo) / (hi - lo) * (0.9 - 0.1), 6) as v from px join r using (image_id)")
_pixel_query("min_max", lambda df: points.min_max_normalize(df["image"]), _select("v"))
_pixel_query("normalize_robust", lambda df: points.robust_min_max_normalize(df["image"]), f"with {PX}, r as (select image_id, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from px group by 1) select image_id, pos, round((least(greatest(v, lo), hi) - lo) / (hi - lo), 6) as v from px join r using (image_id)")
_pixel_query("normalize_zscore", lambda df: points.z_score_normalize(df["image"]), f"with {PX}, r as (select image_id, avg(v) as m, stddev_pop(v) as s from px group by 1) select image_id, pos, round((v - m) / s, 6) as v from px join r using (image_id)")
_pixel_query("stretch_contrast", lambda df: points.stretch_contrast(df["image"]), f"with {PX}, r as (select image_id, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from px group by 1) select image_id, pos, round((least(greatest(v, lo), hi) - lo) / (hi - lo), 6) as v from px join r using (image_id)")
_pixel_query("quantize_u8", lambda df: points.quantize(df["image"]), _select(Q))
_pixel_query("truncate_u8", lambda df: points.truncate(df["image"]), _select("floor(v * 255)"))
_pixel_query("hist_equalize", _kernel("hist_equalize"), f"""with {PX}, q as (select image_id, pos, {Q} as q from px),
c as (select a.image_id, a.pos, count(*) as cdf from q a join q b on a.image_id = b.image_id and b.q <= a.q group by 1, 2),
f as (select image_id, min(cdf) as first from c group by 1)
select image_id, pos, round(round_even(255.0 * (cdf - first) / (64 - first), 0) / 255, 6) as v from c join f using (image_id)""")
_pixel_query("block_resize_4x4", _kernel("resize", width=4, height=4), f"with {PX} select image_id, ((y // 2) * 4 + x // 2)::int as pos, round(avg(v), 6) as v from px group by 1, 2")
_pixel_query("resize_16x16", _kernel("resize", width=16, height=16), f"""with {PX}, g as (select (i // 16)::int as ty, (i % 16)::int as tx from range(0, 256) t(i)),
s as (select ty, tx, least(greatest((ty + 0.5) * 0.5 - 0.5, 0), 7)::double as fy, least(greatest((tx + 0.5) * 0.5 - 0.5, 0), 7)::double as fx from g),
w as (select *, least(floor(fy), 6)::int as y0, least(floor(fx), 6)::int as x0 from s)
select a.image_id, (ty * 16 + tx)::int as pos, round(sum(a.v * (case when a.y = y0 then 1 - (fy - y0) else fy - y0 end) * (case when a.x = x0 then 1 - (fx - x0) else fx - x0 end)), 6) as v
from w join px a on a.y in (y0, y0 + 1) and a.x in (x0, x0 + 1) group by 1, 2""")
_pixel_query("corner_suppress", lambda df: points.suppress_corner(df["image"]), _select("case when x * 3 + y * 3 <= 9 then 0 else v end"))
_pixel_query("unsharp_mask", _kernel("unsharp_mask"), f"with {PX}, {near('n', 'px', 5, 'reflect')} select image_id, pos, round(least(greatest(any_value(c) + (any_value(c) - sum(v * exp(-(dy * dy + dx * dx) / 2.0)) / sum(exp(-(dy * dy + dx * dx) / 2.0))), 0), 1), 6) as v from n group by 1, 2")
_pixel_query("laplacian_sharpen", _kernel("laplacian_sharpen"), f"with {PX}, {near('n', 'px', 3, 'reflect')} select image_id, pos, round(least(greatest(any_value(c) + 0.5 * sum(v * case when dy = 0 and dx = 0 then 4 when dy = 0 or dx = 0 then -1 else 0 end), 0), 1), 6) as v from n group by 1, 2")
#: Tiles of 16 pixels: histograms are cut at 1, and what is cut off goes to evenly spaced values.
_pixel_query("clahe", _kernel("clahe", tiles=(2, 2)), f"""with {PX}, q as (select image_id, pos, y, x, {Q}::int as q from px),
h as (select image_id, y // 4 as ty, x // 4 as tx, q, count(*) as n from q group by all), o as (select image_id, ty, tx, sum(n - 1)::int as rest from h group by all),
c as (select q.image_id, q.pos, any_value(q.y) as y, any_value(q.x) as x, any_value(q.q) as q, h.ty, h.tx, count(*) filter (where h.q <= q.q) as below from q join h using (image_id) group by 1, 2, h.ty, h.tx),
maps as (select c.image_id, pos, y, x, c.ty, c.tx, least(greatest(round_even((below + case when rest = 0 then 0 else least(q // greatest(256 // rest, 1) + 1, rest) end) * (255 / 16.0::double), 0), 0), 255) as g from c join o using (image_id, ty, tx)),
w as (select *, (y / 4.0::double - 0.5) - floor(y / 4.0::double - 0.5) as ay, (x / 4.0::double - 0.5) - floor(x / 4.0::double - 0.5) as ax, floor(y / 4.0::double - 0.5) as y0, floor(x / 4.0::double - 0.5) as x0 from maps),
v as (select image_id, pos, sum(g * ((case when ty = greatest(y0, 0) then 1 - ay else 0 end) + (case when ty = least(y0 + 1, 1) then ay else 0 end)) * ((case when tx = greatest(x0, 0) then 1 - ax else 0 end) + (case when tx = least(x0 + 1, 1) then ax else 0 end))) as v from w group by 1, 2)
select image_id, pos, round(round_even(v, 0) / 255, 6) as v from v""")
_pixel_query("segment_breast", _kernel("segment_breast"), None)


@query("bbox_crop", f"""with {PX}, b as (select image_id, greatest(min(y) - 1, 0) as t, least(max(y) + 1, 7) as b, greatest(min(x) - 1, 0) as l, least(max(x) + 1, 7) as r from px where v > 0.9 group by 1)
select image_id, (b - t + 1)::int as height, (r - l + 1)::int as width, round(sum(v), 6) as total from px join b using (image_id) where y between t and b and x between l and r group by all""")
def bbox_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = images(spark, sf_dir)
    mask = im.pack(F.transform("image.data", lambda v: (v > 0.9).cast("double")), 8, 8)
    c = df.select("image_id", im.crop(F.col("image"), mask, 1).alias("c"))
    return c.select("image_id", "c.height", "c.width", F.round(F.aggregate("c.data", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("image_statistics", f"with {PX} select image_id, 8 as width, 8 as height, 1 as channels, round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from ns group by 1")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = images(spark, sf_dir).select("image_id", im.statistics(F.col("noisy")).alias("s"))
    return s.select("image_id", "s.width", "s.height", "s.channels", *[F.round(f"s.{c}", 6).alias(c) for c in ("min", "max", "mean", "std")])


@query("image_inspection", f"""with {PX} select image_id, 8 as width, 8 as height, 1 as channels, round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(quantile_cont(v, 0.25), 6) as q25,
round(quantile_cont(v, 0.5), 6) as q50, round(quantile_cont(v, 0.75), 6) as q75, round(avg((v = 0)::int), 6) as zeros, min(v) < max(v) as is_valid from ns group by 1""")
def image_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console's inspection of an image shows, a row for each."""
    from pelagia.operators import audit

    rows = audit.inspection(images(spark, sf_dir), "image_id", "noisy")
    return rows.select("image_id", "width", "height", "channels", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "q25", "q50", "q75", "zeros")], "is_valid")


@query("image_validity", f"with {PX} select image_id, count(*) > 0 as filled, bool_and(isfinite(v)) as finite, min(v) < max(v) as varied, bool_and(isfinite(v)) and min(v) < max(v) as is_valid from px group by 1")
def image_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("image_id", im.validity(F.col("image")).alias("s")).select("image_id", "s.*")


# --- noise

NORMAL = f"sqrt(-2 * ln(1 - ua)) * cos({2 * pi!r}::double * ub)"
CLIP = "least(greatest({}, 0), 1)"
_pixel_query("noise_salt_pepper", lambda df: df["noisy"], _select("v", "ns"))
_pixel_query("noise_gaussian", lambda df: noise.add_gaussian_noise(df["image"], df["image_id"]), _select(CLIP.format(f"v + 0.1::double * {NORMAL}"), "us"))
_pixel_query("noise_speckle", lambda df: noise.add_speckle_noise(df["image"], df["image_id"]), _select(CLIP.format(f"v + v * 0.2::double * {NORMAL}"), "us"))
#: The smallest count whose cumulative probability is above u, by a list reduction over counts; ps has the noisy pixels.
POISSON = """pu as (select *, ('0x' || substr(md5('42-' || image_id || '-' || pos || 'p'), 1, 8))::ubigint / 4294967296.0::double as up, greatest(v * 255, 0)::double as l from us),
pc as (select *, list_reduce(list_prepend({k: 0.0::double, p: exp(-l), c: exp(-l)}, list_transform(range(1, 401), lambda i: {k: i::double, p: 0.0::double, c: 0.0::double})),
  lambda acc, nxt: case when acc.c > up then acc else {k: nxt.k, p: acc.p * l / nxt.k, c: acc.c + acc.p * l / nxt.k} end).k as k from pu),
ps as (select image_id, pos, y, x, ua, ub, least(greatest(k / 255, 0), 1) as v from pc)"""
_pixel_query("noise_poisson", lambda df: noise.add_poisson_noise(df["image"], df["image_id"]), f"with {PX}, {POISSON} select image_id, pos, round(v, 6) as v from ps")
MIXED = CLIP.format(f"v + sqrt(0.005::double) * {NORMAL}")
_pixel_query("noise_mixed", lambda df: noise.add_mixed_noise(df["image"], df["image_id"]), f"with {PX}, {POISSON} select image_id, pos, round({MIXED}, 6) as v from ps")


@query("noise_realism", f"""with {PX}, p as (select px.image_id, px.v as c, ns.v as v from px join ns using (image_id, pos))
select image_id, true as no_nan, min(v) >= 0 and max(v) <= 1 as in_range, avg((c - v) * (c - v)) >= 1e-6 as changed, bool_or(v = 0 or v = 1) as impulses,
min(v) >= 0 and max(v) <= 1 and avg((c - v) * (c - v)) >= 1e-6 and bool_or(v = 0 or v = 1) as passed from p group by 1""")
def noise_realism(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = noise.realism(F.col("image"), F.col("noisy"), F.lit("salt_pepper"))
    return images(spark, sf_dir).select("image_id", r.alias("r")).select("image_id", "r.*")


# --- filters of the degraded images

_pixel_query("denoise_median", _kernel("median", "noisy"), f"with {PX}, q as (select image_id, pos, y, x, {Q} as v from ns), {near('n', 'q', 5, 'edge')} select image_id, pos, round(median(v) / 255, 6) as v from n group by 1, 2")
_pixel_query("denoise_gaussian", _kernel("gaussian", "noisy"), f"with {PX}, {near('n', 'ns', 5, 'reflect')} select image_id, pos, round(sum(v * exp(-(dy * dy + dx * dx) / 2.0)) / sum(exp(-(dy * dy + dx * dx) / 2.0)), 6) as v from n group by 1, 2")
_pixel_query("denoise_wiener", _kernel("wiener", "noisy"), f"""with {PX}, {near('n', 'ns', 5, 'constant')},
l as (select image_id, pos, any_value(c) as c, avg(v) as m, avg(v * v) - avg(v) * avg(v) as s2 from n group by 1, 2), g as (select image_id, avg(s2) as noise from l group by 1)
select image_id, pos, round(least(greatest(case when s2 < noise then m else m + (1 - noise / s2) * (c - m) end, 0), 1), 6) as v from l join g using (image_id)""")
_pixel_query("denoise_bilateral", _kernel("bilateral", "noisy"), f"""with {PX}, {near('n', 'ns', 9, 'reflect')},
w as (select *, exp(-(v - c) * (v - c) / (2 * power(75.0::double / 255, 2))) * exp(-(dy * dy + dx * dx) / (2 * 75.0::double * 75)) as w from n where dy * dy + dx * dx <= 16)
select image_id, pos, round(sum(v * w) / sum(w), 6) as v from w group by 1, 2""")
_pixel_query("denoise_adaptive_median", _kernel("adaptive_median", "noisy"), f"with {PX}, {', '.join(near(f'n{k}', 'ns', k, 'symmetric') + f', a{k} as (select image_id, pos, any_value(c) as c, min(v) as lo, median(v) as md, max(v) as hi from n{k} group by 1, 2)' for k in (3, 5, 7))}" + """
select a3.image_id, a3.pos, round(case when a3.lo < a3.md and a3.md < a3.hi then (case when a3.lo < a3.c and a3.c < a3.hi then a3.c else a3.md end)
 when a5.lo < a5.md and a5.md < a5.hi then (case when a5.lo < a5.c and a5.c < a5.hi then a5.c else a5.md end)
 when a7.lo < a7.md and a7.md < a7.hi then (case when a7.lo < a7.c and a7.c < a7.hi then a7.c else a7.md end) else a7.md end, 6) as v
from a3 join a5 using (image_id, pos) join a7 using (image_id, pos)""")
_pixel_query("denoise_kuan", _kernel("kuan", "noisy"), f"""with {PX}, {near('n', 'ns', 7, 'symmetric')},
l as (select image_id, pos, any_value(c) as c, avg(v) as m, greatest(avg(v * v) - avg(v) * avg(v), 1e-8) as s2 from n group by 1, 2)
select image_id, pos, round(least(greatest(m + least(greatest((1 - 0.04::double * m * m / s2) / 1.04::double, 0), 1) * (c - m), 0), 1), 6) as v from l""")
_pixel_query("denoise_nlm", _kernel("non_local_means", "noisy"), None)
_pixel_query("denoise_anscombe_wiener", _kernel("anscombe_wiener", "noisy"), f"""with {PX}, an as (select image_id, pos, y, x, 2 * sqrt(v * 255 + 0.375::double) as v from ns), {near('n', 'an', 5, 'constant')},
l as (select image_id, pos, any_value(c) as c, avg(v) as m, avg(v * v) - avg(v) * avg(v) as s2 from n group by 1, 2),
w as (select image_id, pos, case when s2 < 1 then m else m + (1 - 1 / s2) * (c - m) end as t from l)
select image_id, pos, round(least(greatest(greatest(t * t / 4 - 0.375::double, 0) / 255, 0), 1), 6) as v from w""")


@query("anscombe_transform", f"with {PX} select image_id, pos, round(2 * sqrt(greatest(v * 255, 0) + 0.375::double), 6) as t, round(greatest(power(sqrt(greatest(v * 255, 0) + 0.375::double), 2) - 0.375::double, 0) / 255, 6) as back from px")
def anscombe_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = images(spark, sf_dir)
    df = df.select("image_id", points.anscombe(F.col("image"), 255.0).alias("t")).withColumn("b", points.inverse_anscombe(F.col("t"), 255.0))
    both = F.posexplode(F.arrays_zip(F.col("t.data").alias("t"), F.col("b.data").alias("b"))).alias("pos", "z")
    return df.select("image_id", both).select("image_id", "pos", F.round("z.t", 6).alias("t"), F.round("z.b", 6).alias("back"))


# --- metrics of clean and degraded images

PAIR = f"{PX}, p as (select px.image_id, px.pos, px.y, px.x, px.v as a, ns.v as b from px join ns using (image_id, pos))"


#: Pair metrics in built-in functions.
POINTS = {"MSE": points.mse, "MAE": points.mae, "PSNR": points.psnr, "SNR": points.snr}


def _metric(name: str, field: str, sql: str, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pair = F.col("image"), F.col("noisy")
        if field in POINTS:
            m = images(spark, sf_dir).select("image_id", POINTS[field](*pair).alias("value"))
        else:
            m = images(spark, sf_dir).select("image_id", im.metrics(*pair, [field]).alias("m")).select("image_id", F.col(f"m.{field}").alias("value"))
        value = F.col("value")
        return m.select("image_id", F.round(F.when(F.abs(value) < float("inf"), value), digits).alias("value"))  # equal images have no finite ratio

    query(name, sql)(run)


_metric("metric_mse", "MSE", f"with {PAIR} select image_id, round(avg((a - b) * (a - b)), 6) as value from p group by 1")
_metric("metric_mae", "MAE", f"with {PAIR} select image_id, round(avg(abs(a - b)), 6) as value from p group by 1")
_metric("metric_psnr", "PSNR", f"with {PAIR}, s as (select image_id, avg((a - b) * (a - b)) as e from p group by 1) select image_id, round(case when e > 0 then 10 * log10(1 / e) end, 6) as value from s")
_metric("metric_snr", "SNR", f"with {PAIR}, s as (select image_id, sum(a * a) as g, sum((a - b) * (a - b)) as e from p group by 1) select image_id, round(case when e > 0 then 10 * log10(g / e) end, 6) as value from s")
_metric("metric_ssim", "SSIM", f"""with {PAIR}, w as (select i.y0::int as y0, j.x0::int as x0 from range(0, 2) i(y0), range(0, 2) j(x0)),
s as (select image_id, y0, x0, avg(a) as ma, avg(b) as mb, var_samp(a) as va, var_samp(b) as vb, covar_samp(a, b) as ab from p join w on y between y0 and y0 + 6 and x between x0 and x0 + 6 group by 1, 2, 3),
t as (select image_id, avg((2 * ma * mb + 0.0001::double) * (2 * ab + 0.0009::double) / ((ma * ma + mb * mb + 0.0001::double) * (va + vb + 0.0009::double))) as value from s group by 1)
select image_id, round(least(greatest(value, -1), 1), 5) as value from t""", 5)
_metric("metric_entropy", "Entropy", f"""with {PX}, r as (select image_id, min(v) as lo, max(v) as hi from ns group by 1),
h as (select image_id, least(floor((v - lo) / (hi - lo) * 256 + 1e-9), 255) as bin, count(*) / 64.0::double as p from ns join r using (image_id) group by 1, 2) select image_id, round(-sum(p * log2(p)), 6) as value from h group by 1""")


def _otsu(source: str, n: str) -> str:
    """CTEs that end in {n}r: image_id, v, roi (whether tissue is at or above the threshold)."""
    return f"""
{n}t as (select image_id, v, floor(v * 255 + 1e-9) as q from {source} where v > 0.02),
{n}h as (select image_id, q, count(*) as k from {n}t group by 1, 2),
{n}c as (select image_id, q, sum(k) over w as n, sum(k * q) over w as s, sum(k) over (partition by image_id) as alln, sum(k * q) over (partition by image_id) as alls from {n}h window w as (partition by image_id order by q)),
{n}b as (select image_id, q, power(alls * n::double - s * alln::double, 2) / (n * (alln - n)::double) as b from {n}c where n < alln),
{n}o as (select image_id, arg_max(q, {{'b': b, 'q': -q}}) / 255.0::double as t from {n}b group by 1),
{n}x as (select image_id, min(v) as lo, max(v) as hi from {n}t group by 1),
{n}y as (select image_id, case when lo + 1e-9 < t and t < hi - 1e-9 then t else (lo + hi) / 2 end as t from {n}o join {n}x using (image_id)),
{n}r as (select image_id, v, v >= t - 1e-9 as roi from {n}t join {n}y using (image_id))"""


def _means(n: str) -> str:
    return f"{n}m as (select image_id, avg(v) filter (where roi) as m1, avg(v) filter (where not roi) as m0, var_pop(v) filter (where roi) as v1, var_pop(v) filter (where not roi) as v0, count(*) filter (where roi) as n1, count(*) filter (where not roi) as n0 from {n}r group by 1)"


_metric("metric_cnr", "CNR", f"with {PX}, {_otsu('ns', 'ob')}, {_means('ob')} select image_id, round(case when sqrt(v1 + v0) <= 1e-12 then 0 else abs(m1 - m0) / sqrt(v1 + v0) end, 6) as value from obm")
_metric("metric_cii", "CII", f"with {PX}, {_otsu('px', 'oa')}, {_means('oa')}, {_otsu('ns', 'ob')}, {_means('ob')} select image_id, round((abs(obm.m1 - obm.m0) / (obm.m1 + obm.m0 + 1e-7)) / (abs(oam.m1 - oam.m0) / (oam.m1 + oam.m0 + 1e-7)), 6) as value from oam join obm using (image_id)")


@query("otsu_regions", f"with {PX}, {_otsu('px', 'oa')}, {_means('oa')} select image_id, n1::bigint as n_roi, n0::bigint as n_background, round(m1, 6) as roi_mean, round(m0, 6) as background_mean from oam")
def otsu_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(images_: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, x in im.stacks(images_):
            for v in x:
                r, b = px.otsu_regions(v)
                out.append((int(r.sum()), int(b.sum()), v[r].mean(), v[b].mean()))
        return pd.DataFrame(out, columns=["n_roi", "n_background", "roi_mean", "background_mean"])

    found = F.pandas_udf(run, "n_roi long, n_background long, roi_mean double, background_mean double")
    out = images(spark, sf_dir).select("image_id", found(F.col("image")).alias("r"))
    return out.select("image_id", "r.n_roi", "r.n_background", F.round("r.roi_mean", 6).alias("roi_mean"), F.round("r.background_mean", 6).alias("background_mean"))


@query("roi_ring_pixels", f"""with {PX}, roi as (select image_id, y, x from px where v > 0.8),
ring as (select distinct p.image_id, p.y, p.x, p.v from px p join roi r on p.image_id = r.image_id and abs(p.y - r.y) <= 1 and abs(p.x - r.x) <= 1 and (p.y = r.y or p.x = r.x)
  where p.v > 0.02 and p.v <= 0.8)
select image_id, count(*)::bigint as n, round(avg(v), 6) as mean from ring group by 1""")
def roi_ring_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(images_: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, x in im.stacks(images_):
            for v in x:
                _, b = px.ring_regions(v, v > 0.8, radius=1)
                out.append((int(b.sum()), v[b].mean()))
        return pd.DataFrame(out, columns=["n", "mean"])

    out = images(spark, sf_dir).select("image_id", F.pandas_udf(run, "n long, mean double")(F.col("image")).alias("r"))
    return out.select("image_id", "r.n", F.round("r.mean", 6).alias("mean"))


# --- regions by lesion masks: pixels above 0.8 of the clean image, on every image whose id 5 does not divide

_MASKED = f"""{PX}, roi as (select image_id, pos, y, x from px where v > 0.8 and image_id % 5 <> 0),
ring as (select distinct p.image_id, p.pos from px p join roi r on p.image_id = r.image_id and abs(p.y - r.y) + abs(p.x - r.x) <= 1 where p.v > 0.02 and p.v <= 0.8),
{_otsu('px', 'oa')}, own as (select px.image_id, px.pos, px.v >= t - 1e-9 as roi from px join oay using (image_id) where px.v > 0.02 and image_id % 5 = 0),
g as (select image_id, pos, true as roi from roi union all select image_id, pos, false from ring union all select image_id, pos, roi from own)"""


def _mask_of(df: DataFrame) -> DataFrame:
    data = F.transform("image.data", lambda v: (v > 0.8).cast("double"))
    return df.withColumn("mask", F.when(F.col("image_id") % 5 != 0, im.pack(data, 8, 8)))


@query("metric_regions_masked", f"""with {_MASKED},
mm as (select image_id, avg(ns.v) filter (where roi) as m1, avg(ns.v) filter (where not roi) as m0, var_pop(ns.v) filter (where roi) as v1, var_pop(ns.v) filter (where not roi) as v0,
  avg(px.v) filter (where roi) as c1, avg(px.v) filter (where not roi) as c0 from g join ns using (image_id, pos) join px using (image_id, pos) group by 1)
select image_id, round(case when sqrt(v1 + v0) <= 1e-12 then 0 else abs(m1 - m0) / sqrt(v1 + v0) end, 6) as cnr, round((abs(m1 - m0) / (m1 + m0 + 1e-7)) / (abs(c1 - c0) / (c1 + c0 + 1e-7)), 6) as cii from mm""")
def metric_regions_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNR and CII in the lesion and the ring around it; without a mask in the clean image's own regions."""
    m = im.metrics(F.col("image"), F.col("noisy"), ["CNR", "CII"], F.col("mask"), 1)
    return _mask_of(images(spark, sf_dir)).select("image_id", m.alias("m")).select("image_id", F.round("m.CNR", 6).alias("cnr"), F.round("m.CII", 6).alias("cii"))


@query("experiment_masked", f"""with {_MASKED}, {near('n', 'ns', 5, 'reflect')}, d as (select image_id, pos, sum(v * exp(-(dy * dy + dx * dx) / 2.0)) / sum(exp(-(dy * dy + dx * dx) / 2.0)) as v from n group by 1, 2),
mm as (select image_id, avg(d.v) filter (where roi) as m1, avg(d.v) filter (where not roi) as m0, var_pop(d.v) filter (where roi) as v1, var_pop(d.v) filter (where not roi) as v0 from g join d using (image_id, pos) group by 1)
select image_id, 'salt_pepper' as noise_type, 'gaussian' as denoising_method, round(case when sqrt(v1 + v0) <= 1e-12 then 0 else abs(m1 - m0) / sqrt(v1 + v0) end, 6) as cnr from mm""")
def experiment_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment's CNR by masks, for one noise and one filter."""
    df = _mask_of(images(spark, sf_dir).select("image_id", "image"))
    out = experiment.run(df, methods=["gaussian"], noise_types=["salt_pepper"], mask="mask", radius=1)
    return out.select(*experiment.KEYS, F.round("CNR", 6).alias("cnr"))


# --- experiment

KEYS_SQL = "k as (select vec_id as image_id, n.t as noise_type, f.m as denoising_method from embeddings, (values ('gaussian'), ('salt_pepper'), ('speckle'), ('poisson'), ('mixed_poisson_gaussian')) n(t), (values ('median'), ('gaussian'), ('wiener'), ('bilateral'), ('non_local_means'), ('anscombe_wiener'), ('adaptive_median'), ('kuan')) f(m))"


@query("experiment_cross", f"with {KEYS_SQL} select * from k")
def experiment_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.keys(images(spark, sf_dir).select("image_id"))


@query("experiment_resume", f"with {KEYS_SQL} select * from k where not (image_id % 3 = 0 and noise_type = 'gaussian') and not (image_id % 5 = 1 and denoising_method = 'kuan')")
def experiment_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = experiment_cross(spark, sf_dir)
    done = wanted.filter("(image_id % 3 = 0 and noise_type = 'gaussian') or (image_id % 5 = 1 and denoising_method = 'kuan')")
    return experiment.remaining(wanted, done)


@query("resource_estimate", "select n as images, n * 40 as experiments, n * 5 as noise_operations, n * 40 as denoise_operations, n * 280 as metric_evaluations, n * 325 as total_operations, n * 45 as files, round(n * 45 * 200 / 1024.0::double, 6) as disk_mb, round(n * 40 / 5.25::double, 6) as seconds from (select count(*) as n from embeddings)")
def resource_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = images(spark, sf_dir).select("image_id").agg(F.count("*").alias("images"))
    e = experiment.estimate(1)
    whole = ("experiments", "noise_operations", "denoise_operations", "metric_evaluations", "total_operations", "files")
    return n.select("images", *[(F.col("images") * e[k]).alias(k) for k in whole], F.round(F.col("images") * e["files"] * experiment.IMAGE_KB / 1024, 6).alias("disk_mb"), F.round(F.col("images") * e["experiments"] / experiment.RATE, 6).alias("seconds"))


@query("experiment_metrics")
def experiment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of seven metrics for each image, noise model and filter."""
    return experiment.run(images(spark, sf_dir, even=True).select("image_id", "image"))


@query("noise_method_summary")
def noise_method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment over all images, summarised in 35 statistics by noise and filter."""
    return experiment.summary(experiment_metrics(spark, sf_dir))


@query("median_psnr", f"""with {PX}, q as (select image_id, pos, y, x, {Q} as v from ns), {near('n', 'q', 5, 'edge')}, d as (select image_id, pos, median(v) / 255 as v from n group by 1, 2),
s as (select image_id, avg((px.v - d.v) * (px.v - d.v)) as e from px join d using (image_id, pos) group by 1) select count(*) as images, round(avg(10 * log10(1 / e)), 6) as mean_psnr, round(avg(e), 6) as mean_mse from s""")
def median_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of median-filtered images."""
    df = images(spark, sf_dir)
    m = df.withColumn("d", im.apply_named(F.col("noisy"), "median")).select(points.psnr(F.col("image"), F.col("d")).alias("psnr"), points.mse(F.col("image"), F.col("d")).alias("mse"))
    return m.agg(F.count("*").alias("images"), F.round(F.avg("psnr"), 6).alias("mean_psnr"), F.round(F.avg("mse"), 6).alias("mean_mse"))


@query("stage_chain")
def stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast, sharpening, five noises and eight filters of every image: statistics of each result."""
    from pelagia.operators import stages

    df = images(spark, sf_dir).select(F.col("image_id").cast("string").alias("name"), "image")
    out = stages.denoise(stages.add_noise(stages.sharpen(stages.contrast(df))))
    s = im.statistics(F.col("image"))
    return out.select("name", "noise_type", "denoising_method", "hardware_architecture", "status", F.round(s["mean"], 6).alias("mean"), F.round(s["std"], 6).alias("std"))


#: Every noise model's pixels: the table they are made from, and their value.
NOISY = {"gaussian": ("us", CLIP.format(f"v + 0.1::double * {NORMAL}")), "salt_pepper": ("us", "case when u < 0.02 then 1.0::double when u > 0.98 then 0.0::double else v end"), "speckle": ("us", CLIP.format(f"v + v * 0.2::double * {NORMAL}")), "poisson": ("ps", "v"), "mixed_poisson_gaussian": ("ps", MIXED)}


@query("noise_validation", f"""with {PX}, {POISSON}, z as ({' union all '.join(f"select image_id, pos, '{k}' as k, {value} as v from {source}" for k, (source, value) in NOISY.items())}),
r as (select z.image_id, k, min(z.v) >= 0 and max(z.v) <= 1 and avg((px.v - z.v) * (px.v - z.v)) >= 1e-6 and (k <> 'salt_pepper' or bool_or(z.v = 0 or z.v = 1)) as ok from z join px using (image_id, pos) group by 1, 2)
select image_id::varchar as name, '{{' || string_agg('"' || k || '":' || ok::varchar, ',' order by k) || '}}' as models, bool_and(ok) as passed from r group by image_id""")
def noise_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every model's image is realistic."""
    from pelagia.operators import stages

    df = images(spark, sf_dir).select(F.col("image_id").cast("string").alias("name"), "image")
    return stages.noise_table(stages.add_noise(df)).select("name", F.to_json("models").alias("models"), "passed")


@query("full_preprocessing")
def full_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long chain over every image, resized to 16 x 16."""
    from pelagia.operators import stages

    df = images(spark, sf_dir).select("image_id", im.apply_named(F.col("image"), "quantize_u8").alias("image"), F.when(F.col("image_id") % 2 == 0, "BENIGN").otherwise("MALIGNANT").alias("standardized_pathology"))
    out = stages.full_pipeline(df, (16, 16))
    s = im.statistics(F.col("image"))
    return out.select("image_id", "bucket", s["width"].alias("width"), s["height"].alias("height"), F.round(s["mean"], 6).alias("mean"))
