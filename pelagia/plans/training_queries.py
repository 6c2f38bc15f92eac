"""Queries of what feeds a training run: shuffled batches and augmented images."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions import augment
from pelagia.operators import batches, trainer
from pelagia.plans.standins import PX, images, pixels, table
from pelagia.registry import query

#: The permutation's rounds as a list reduction: state x, round i; n is the number of rows.
_PLACE = "list_reduce(list_prepend(r, range({rounds})), lambda x, i: case when substr(md5('42-' || e || '-' || i || '-' || greatest(x, (({k}) % n - x + n) % n)), 1, 1) >= '8' then (({k}) % n - x + n) % n else x end)".format(
    rounds=batches.ROUNDS, k="('0x' || substr(md5('42-' || e || '-' || i), 1, 15))::bigint"
)
_RANKS = "t as (select {key} as id, row_number() over (order by md5({key}::varchar), {key}) - 1 as r, count(*) over () as n from {table})"


@query("shuffled_batches", f"with {_RANKS.format(key='doc_id', table='documents')}, p as (select id, e, {_PLACE} as spot from t, range(2) w(e)) select id as doc_id, e::int as epoch, spot // 16 as batch, (spot % 16)::int as place from p")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch and the place of every document in two epochs of batches of 16."""
    return batches.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 16, epochs=2).select("doc_id", "epoch", "batch", "place")


@query("batch_contents", f"""with {_RANKS.format(key='vec_id', table='embeddings')}, p as (select id, e, {_PLACE} as spot from t, range(1) w(e))
select e::int as epoch, spot // 32 as batch, count(*)::int as size, array_to_string(list(id order by spot), ',') as ids from p group by e, spot // 32""")
def batch_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of every batch of 32, in order."""
    rows = batches.batches(images(spark, sf_dir).select("image_id"), "image_id", 32)
    return batches.gathered(rows, ["image_id"]).select("epoch", "batch", "size", F.concat_ws(",", F.transform("image_id", lambda v: v.cast("string"))).alias("ids"))


@query("dataset_items", "select doc_id, coalesce((select max(toxic) from labels l where l.doc_id = d.doc_id), 0)::int as label from documents d")
def dataset_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an item, with its label or 0."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("toxic").cast("int").alias("label"))
    items = batches.dataset(d, d.select("path", F.lit(None).alias("image")), labels)
    return items.select(F.col("path").alias("doc_id"), "label")


_U = "('0x' || substr(md5('42-0-' || image_id || '-{}'), 1, 8))::ubigint / 4294967296.0::double"
_TURNED = f"""with {PX}, d as (select distinct image_id, {_U.format('across')} < 0.5 as across, {_U.format('down')} < 0.5 as down, (2 * {_U.format('turn')} - 1) * 15.0::double * {pi!r}::double / 180 as a from px),
f as (select image_id, case when down then 7 - y else y end as y, case when across then 7 - x else x end as x, v from px join d using (image_id)),
s as (select image_id, pos, 3.5 + (x - 3.5) * sin(a) + (y - 3.5) * cos(a) as sy, 3.5 + (x - 3.5) * cos(a) - (y - 3.5) * sin(a) as sx from px join d using (image_id))"""


@query("augment_train", f"""{_TURNED} select s.image_id, s.pos, round((coalesce(f.v, 0) - 0.5) / 0.5, 6) as v from s left join f on f.image_id = s.image_id and f.y = floor(s.sy + 0.5) and f.x = floor(s.sx + 0.5)""")
def augment_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = images(spark, sf_dir, even=True)
    return pixels(df, augment.train(df["image"], df["image_id"]))


@query("augment_train_bilinear", f"""{_TURNED}, o as (select s.image_id, pos, floor(sy) + i as ty, floor(sx) + j as tx, abs(1 - i - (sy - floor(sy))) * abs(1 - j - (sx - floor(sx))) as w from s, range(2) a(i), range(2) b(j))
select o.image_id, o.pos, round((sum(o.w * coalesce(f.v, 0)) - 0.5) / 0.5, 5) as v from o left join f on f.image_id = o.image_id and f.y = o.ty and f.x = o.tx group by 1, 2""")
def augment_train_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = images(spark, sf_dir, even=True)
    return pixels(df, augment.train(df["image"], df["image_id"], bilinear=True), 5)


@query("augment_val", f"with {PX} select image_id, pos, round((v - 0.5) / 0.5, 6) as v from px")
def augment_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = images(spark, sf_dir)
    return pixels(df, augment.val(df["image"]))


_LABEL = "case when vec_id % 3 = 0 then 1 else 0 end"


@query("trainer_gradient", f"""with x as (select {_LABEL} as y, list_transform(embedding, lambda v: v::double) as a from embeddings),
z as (select y, a, list_sum(list_transform(range(64), lambda j: a[j + 1] * ((j % 5) - 2) / 10.0::double)) as z from x),
p as (select y, a, 1 / (1 + exp(-z)) as p, case when y = 1 then 2.0::double else 0.5::double end as w from z),
g as (select j, sum(w * (p - y) * (case when j < 64 then a[j + 1] else 1 end)) / sum(w) as g from p, range(65) r(j) group by j)
select j::int as feature, round(g, 6) as gradient from g""")
def trainer_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean gradient of a class-weighted loss at given weights over all embeddings; feature 64 is the bias."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("embedding").cast("array<double>").alias("features"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0).alias("label"))
    w = np.stack([np.zeros(64), (np.arange(64) % 5 - 2) / 10])
    _, weight, grad = trainer.gradient(rows, trainer.Model([(w, np.zeros(2))]), trainer.Loss("weighted_ce", weights=(0.5, 2.0)))
    of_one = np.r_[grad[64:128], grad[129]] / max(weight, 1e-300)
    return spark.createDataFrame([(j, float(g)) for j, g in enumerate(of_one)], "feature int, gradient double").select("feature", F.round("gradient", 6).alias("gradient"))
