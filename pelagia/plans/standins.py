"""Stand-ins of image catalogues among the given tables, and the same in DuckDB SQL.

An embedding of 64 values is an 8 x 8 image, scaled to [0, 1] per image; its degraded twin has salt-and-pepper noise.
A document is a record of a patient, with a label where ``labels`` has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import images as im
from pelagia.operators import noise

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """image_id, image, noisy. even: the table is dealt out before anything is worked out, as a file may be one row group."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    if even:
        e = im.spread(e)
    e = e.select("image_id", F.transform("embedding", lambda v: v.cast("double")).alias("d"))
    e = e.select("image_id", "d", F.array_min("d").alias("lo"), F.array_max("d").alias("hi"))  # once, not for every pixel
    e = e.select("image_id", im.pack(F.transform("d", lambda v: F.coalesce(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))), SIDE, SIDE).alias("image"))
    return e.withColumn("noisy", noise.add_salt_pepper_noise(F.col("image"), F.col("image_id")))


def pixels(df: DataFrame, image: Column, digits: int = 6) -> DataFrame:
    """image_id, pos, v of a computed image."""
    made = df.select("image_id", image.alias("made"))
    return im.long(made, "made").select("image_id", "pos", F.round("v", digits).alias("v"))


#: px: image_id, pos, y, x, v of the clean images; ns of the degraded ones.
PX = """
e as (select vec_id as image_id, list_transform(embedding, lambda x: x::double) as a from embeddings),
m as (select image_id, a, list_min(a) as lo, list_max(a) as hi from e),
px as (select image_id, (i - 1)::int as pos, ((i - 1) // 8)::int as y, ((i - 1) % 8)::int as x, (a[i] - lo) / (hi - lo) as v from m, range(1, 65) t(i)),
us as (select *, ('0x' || substr(md5('42-' || image_id || '-' || pos), 1, 8))::ubigint / 4294967296.0 as u,
  ('0x' || substr(md5('42-' || image_id || '-' || pos || 'a'), 1, 8))::ubigint / 4294967296.0 as ua,
  ('0x' || substr(md5('42-' || image_id || '-' || pos || 'b'), 1, 8))::ubigint / 4294967296.0 as ub from px),
ns as (select image_id, pos, y, x, case when u < 0.02 then 1.0::double when u > 0.98 then 0.0::double else v end as v from us)"""

FOLD = {
    "edge": "least(greatest({z}, 0), 7)",
    "symmetric": "case when {z} < 0 then -1 - ({z}) when {z} > 7 then 15 - ({z}) else {z} end",
    "reflect": "case when {z} < 0 then -({z}) when {z} > 7 then 14 - ({z}) else {z} end",
    "constant": "{z}",
}


def near(name: str, source: str, k: int, border: str) -> str:
    """A CTE of every pixel (image_id, pos, c) with its k x k neighbours (v, dy, dx); outside is 0 where nothing folds."""
    r = k // 2
    y, x = FOLD[border].format(z="t.y + o.dy"), FOLD[border].format(z="t.x + o.dx")
    return f"""
{name}_o as (select a.dy::int as dy, b.dx::int as dx from range({-r}, {r + 1}) a(dy), range({-r}, {r + 1}) b(dx)),
{name}_t as (select t.image_id, t.pos, t.v as c, {y} as sy, {x} as sx, o.dy, o.dx from {source} t, {name}_o o),
{name} as (select t.image_id, t.pos, t.c, coalesce(s.v, 0) as v, t.dy, t.dx from {name}_t t left join {source} s on s.image_id = t.image_id and s.y = t.sy and s.x = t.sx)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final columns over documents: experiments are every third record, some values are wrong on purpose."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    df = d.join(lab, "doc_id", "left")
    i = F.col("doc_id")
    path = lambda folder, key: F.concat(F.lit(folder + "/"), key.cast("string"), F.lit(".png"))
    exp = i % 3 == 0
    return df.select(
        "doc_id", F.concat(F.lit("P_"), (i % 97).cast("string")).alias("patient_id"), F.when(i % 2 == 0, "mass").otherwise("calcification").alias("abnormality_category"),
        F.when(i % 5 < 2, "LEFT").otherwise("RIGHT").alias("breast_side"), F.when(i % 4 < 2, "CC").otherwise("MLO").alias("image_view"),
        F.when(F.col("quality") == 1, "BENIGN").when(F.col("quality") == 0, "MALIGNANT").when(i % 7 == 0, "UNKNOWN").alias("pathology"),
        F.when(i % 11 == 0, F.col("quality")).otherwise(F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)).cast("int").alias("label"),
        F.when(i % 97 == 5, F.when(i % 2 == 0, "train").otherwise("test")).when(i % 97 < 60, "train").otherwise("test").alias("dataset_split"),
        path("raw", i).alias("original_image_path"), path("normalized", i).alias("normalized_image_path"), path("contrast", i).alias("contrast_image_path"),
        F.when(i % 50 == 0, F.lit("sharpened/same.png")).when(i % 61 == 0, F.concat(F.lit("data/raw/"), i.cast("string"))).otherwise(path("sharpened", i)).alias("sharpened_image_path"),
        F.when(exp, F.lit("gaussian")).alias("noise_type"), F.when(exp, F.lit("median")).alias("denoising_method"),
        F.when(exp, path("noisy", i)).alias("noisy_image_path"), F.when(exp, F.when(i % 9 == 0, F.lit(" ")).otherwise(path("denoised", i))).alias("denoised_image_path"),
    )


CATALOG = """
lab as (select doc_id, max(quality) as quality from labels group by 1),
dq as (select d.doc_id as i, quality from documents d left join lab using (doc_id)),
cat as (select i as doc_id, 'P_' || (i % 97) as patient_id, case when i % 2 = 0 then 'mass' else 'calcification' end as abnormality_category,
  case when i % 5 < 2 then 'LEFT' else 'RIGHT' end as breast_side, case when i % 4 < 2 then 'CC' else 'MLO' end as image_view,
  case when quality = 1 then 'BENIGN' when quality = 0 then 'MALIGNANT' when i % 7 = 0 then 'UNKNOWN' end as pathology,
  (case when i % 11 = 0 then quality when quality = 1 then 0 when quality = 0 then 1 end)::int as label,
  case when i % 97 = 5 then (case when i % 2 = 0 then 'train' else 'test' end) when i % 97 < 60 then 'train' else 'test' end as dataset_split,
  'raw/' || i || '.png' as original_image_path, 'normalized/' || i || '.png' as normalized_image_path, 'contrast/' || i || '.png' as contrast_image_path,
  case when i % 50 = 0 then 'sharpened/same.png' when i % 61 = 0 then 'data/raw/' || i else 'sharpened/' || i || '.png' end as sharpened_image_path,
  case when i % 3 = 0 then 'gaussian' end as noise_type, case when i % 3 = 0 then 'median' end as denoising_method,
  case when i % 3 = 0 then 'noisy/' || i || '.png' end as noisy_image_path,
  case when i % 3 = 0 then (case when i % 9 = 0 then ' ' else 'denoised/' || i || '.png' end) end as denoised_image_path
  from dq)"""
