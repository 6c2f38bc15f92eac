"""Queries of the catalogue, audit and evaluation operators over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import audit, catalog, evaluation
from pelagia.plans.standins import CATALOG, table
from pelagia.plans.standins import catalog as catalog_table
from pelagia.registry import query
from pelagia.sources import files


@query("catalog_union_tagged", """select o_orderkey as record_id, 'mass' as abnormality_category, 'train' as dataset_split, null::varchar as extra from orders where o_orderstatus = 'F'
union all select o_orderkey, 'calcification', 'test', o_custkey::varchar from orders where o_orderstatus = 'O'""")
def catalog_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    mass = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias(" Record ID "))
    calc = o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("Record ID"), F.col("o_custkey").cast("string").alias("Extra"))
    return catalog.union_tagged([(mass, {"abnormality_category": "mass", "dataset_split": "train"}), (calc, {"abnormality_category": "calcification", "dataset_split": "test"})])


@query("label_standardize", """with t as (select o_orderkey, case o_orderpriority when '1-URGENT' then ' malignant' when '2-HIGH' then 'Benign_without_callback' when '3-MEDIUM' then 'BENIGN' when '5-LOW' then 'other' end as p from orders),
s as (select o_orderkey, case when upper(trim(p)) like '%BENIGN%' then 'BENIGN' when upper(trim(p)) like '%MALIGNANT%' then 'MALIGNANT' else 'UNKNOWN' end as pathology from t)
select o_orderkey, pathology, case pathology when 'BENIGN' then '0' when 'MALIGNANT' then '1' end as label from s""")
def label_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    text = F.when(p == "1-URGENT", " malignant").when(p == "2-HIGH", "Benign_without_callback").when(p == "3-MEDIUM", "BENIGN").when(p == "5-LOW", "other")
    out = table(spark, sf_dir, "orders").select("o_orderkey", catalog.standardized_pathology(text).alias("pathology"))
    return out.withColumn("label", catalog.label_of(F.col("pathology")).cast("string"))


@query("path_coalesce_exists", """with l as (select distinct doc_id from labels), j as (select d.doc_id, case when l.doc_id is not null then 'full/' || d.doc_id end as f, case when d.doc_id % 4 > 0 then 'crop/' || d.doc_id end as c from documents d left join l using (doc_id))
select doc_id, coalesce(f, c) as image_path, coalesce(f, c) is not null as file_exists, coalesce(nullif(trim(f), ''), nullif(trim(c), ''), '') as preferred from j""")
def path_coalesce_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    have = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("f", F.concat(F.lit("full/"), F.col("doc_id").cast("string")))
    j = d.join(have, "doc_id", "left").withColumn("c", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("crop/"), F.col("doc_id").cast("string"))))
    path = F.coalesce("f", "c")
    return j.select("doc_id", path.alias("image_path"), path.isNotNull().alias("file_exists"), catalog.first_of(F.col("f"), F.col("c")).alias("preferred"))


@query("output_name_build", r"""select page_id, 'P_' || page_id || '_mass_' || regexp_replace(string_split(replace(url, '\', '/'), '/')[-1], '\.[^.]*$', '') || '.png' as name from pages""")
def output_name_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", catalog.output_name(F.concat(F.lit("P_"), F.col("page_id").cast("string")), F.lit("mass"), path=F.col("url")).alias("name"))


@query("json_params_decode", "select event_id, try_cast(json_extract_string(try_cast(props as json), '$.k') as bigint) as k from events")
def json_params_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("json_params_encode", """select event_id, '{"seed":' || (event_id % 100) || ',"kind":"' || event_type || '"}' as params from events""")
def json_params_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct((F.col("event_id") % 100).alias("seed"), F.col("event_type").alias("kind"))).alias("params"))


METHODS = "case event_id % 4 when 0 then 'gaussian' when 1 then 'kuan' when 2 then 'median' else 'unknown' end"


@query("method_dimension_map", f"select event_id, case when {METHODS} in ('gaussian', 'kuan') then 'GPU' else 'CPU' end as hardware_architecture from events")
def method_dimension_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", catalog.hardware(F.expr(METHODS)).alias("hardware_architecture"))


FOLDERS = "(select string_split(url, '/')[3] as folder, min(url) as path from pages where page_id % 2 = 0 group by 1)"


@query("folder_first_file", "select string_split(url, '/')[3] as folder, min(url) as path from pages group by 1")
def folder_first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_file_of_folder(table(spark, sf_dir, "pages").select(F.get(F.split("url", "/"), F.lit(2)).alias("folder"), F.col("url").alias("path")))


@query("index_last_wins", "select string_split(url, '/')[4] as key, max(url) as path from pages group by 1")
def index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_file_of_key(table(spark, sf_dir, "pages").select(F.get(F.split("url", "/"), F.lit(3)).alias("key"), F.col("url").alias("path")), "key")


@query("path_first_segment_lookup", f"""with f as {FOLDERS}, s as (select page_id, unnest(string_split(trim(url), '/')) as seg, generate_subscripts(string_split(trim(url), '/'), 1) as i from pages),
h as (select page_id, arg_min(f.path, i) as p from s join f on f.folder = s.seg group by 1), k as (select distinct url from pages where page_id % 3 = 0)
select pages.page_id, coalesce(h.p, k.url) as resolved from pages left join h using (page_id) left join k on k.url = trim(pages.url)""")
def path_first_segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    folders = catalog.first_file_of_folder(p.filter("page_id % 2 = 0").select(F.get(F.split("url", "/"), F.lit(2)).alias("folder"), F.col("url").alias("path")))
    files = p.filter("page_id % 3 = 0").select(F.col("url").alias("path"))
    return catalog.resolve_by_segment(p, "url", folders, files).select("page_id", "resolved")


@query("path_candidate_resolve", """with p as (select page_id, case when page_id % 2 = 0 then '/app/' else '' end || 'data/' || page_id || '.png' as path from pages),
f as (select case page_id % 3 when 0 then '/app/data/' || page_id when 1 then 'data/' || page_id else 'root/' || page_id end || '.png' as path from pages where page_id % 5 > 0),
c as (select page_id, unnest([path, case when starts_with(path, '/app/') then substr(path, 6) end, case when starts_with(path, '/') then '/app' || path else '/app/' || path end, 'root/' || page_id || '.png']) as c, unnest([1, 2, 3, 4]) as i from p),
h as (select page_id, arg_min(c, i) as resolved from c join f on f.path = c.c group by 1) select p.page_id, resolved from p left join h using (page_id)""")
def path_candidate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id")
    i = F.col("page_id").cast("string")
    asked = p.withColumn("path", F.concat(F.when(F.col("page_id") % 2 == 0, "/app/").otherwise(""), F.lit("data/"), i, F.lit(".png")))
    where = F.when(F.col("page_id") % 3 == 0, "/app/data/").when(F.col("page_id") % 3 == 1, "data/").otherwise("root/")
    files = p.filter("page_id % 5 > 0").select(F.concat(where, i, F.lit(".png")).alias("path"))
    return catalog.resolve_candidates(asked, "path", files, roots=("root",)).select("page_id", "resolved")


@query("lineage_join_dedup", """with c as (select doc_id % 200 as k, nullif(lang, 'es') as lang, doc_id, source, row_number() over (partition by doc_id % 200, nullif(lang, 'es') order by doc_id) as rn from documents)
select l.doc_id, l.toxic, c.source from (select d.doc_id, d.doc_id % 200 as k, nullif(d.lang, 'es') as lang, labels.toxic from labels join documents d using (doc_id)) l join c on l.k = c.k and l.lang is not distinct from c.lang where rn = 1""")
def lineage_join_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 200).alias("k"), F.nullif("lang", F.lit("es")).alias("lang"))
    e = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(d.drop("source"), "doc_id")
    return catalog.lineage(e, d, ["k", "lang"], ["doc_id"], ["source"]).select("doc_id", "toxic", "source")


@query("validation_lookup_two_keys", """with a as (select l_orderkey as k, max(l_shipdate) as v from lineitem where l_linenumber = 1 group by 1), b as (select l_suppkey as k, max(l_shipdate) as v from lineitem group by 1)
select o_orderkey, coalesce(a.v, b.v) as found from orders left join a on a.k = o_orderkey left join b on b.k = o_custkey""")
def validation_lookup_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a = items.filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("va"))
    b = items.groupBy(F.col("l_suppkey").alias("o_custkey")).agg(F.max("l_shipdate").alias("vb"))
    return o.select("o_orderkey", "o_custkey").join(a, "o_orderkey", "left").join(b, "o_custkey", "left").select("o_orderkey", F.coalesce("va", "vb").alias("found"))


_FALLBACK = "(with f as (select c_custkey, c_mktsegment from customer where {0}) select '{1}' as asked, * from f union all (select '{1}', c_custkey, c_mktsegment from customer where not exists (select 1 from f) order by c_custkey limit 10))"


@query("filter_in_regex_fallback", "select c_custkey, c_mktsegment from customer where regexp_matches(c_mktsegment, '(?i)build') and c_nationkey in (1, 3, 5, 7, 9, 11)")
def filter_in_regex_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    some = c.filter(F.col("c_nationkey").isin(1, 3, 5, 7, 9, 11)).drop("c_nationkey")
    return catalog.matching_or_head(some, "c_mktsegment", "build", ["c_custkey"])


@query("regex_or_head", " union all ".join([_FALLBACK.format("regexp_matches(c_mktsegment, '(?i)^house')", "house"), _FALLBACK.format("regexp_matches(c_mktsegment, '(?i)no such segment')", "none")]))
def regex_or_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that matches, and one that does not: then the first ten, which is the feature."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    one, two = (catalog.matching_or_head(c, "c_mktsegment", p, ["c_custkey"]).select(F.lit(name).alias("asked"), "*") for p, name in (("^house", "house"), ("no such segment", "none")))
    return one.unionByName(two)


_TWO = "lower(case when len(string_split(trim(url), '/')) >= 2 then string_split(trim(url), '/')[-2] || '/' || string_split(trim(url), '/')[-1] end)"


@query("validation_lookup_paths", f"""with p as (select page_id, page_id % 40 as patient, url, {_TWO} as k, lower(string_split(url, '/')[-1]) as n from pages), r as (select * from p where page_id % 3 > 0),
a as (select k, max(page_id) as v from r where k is not null group by 1), b as (select patient, n, max(page_id) as v from r group by 1, 2)
select page_id, coalesce(a.v, b.v) as validated from p left join a using (k) left join b using (patient, n)""")
def validation_lookup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last validated record by two path segments, else by patient and file name."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 40).alias("patient_id"), F.col("url").alias("image_path"))
    r = p.filter("page_id % 3 > 0").withColumn("value", F.col("page_id"))
    return catalog.validation_lookup(p, r, "value", "page_id").select("page_id", "validated")


@query("head_in_order", "select o_orderkey, o_orderpriority from orders order by o_orderkey limit 10")
def head_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test modes' first ten rows: the limit is the feature."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(10)


def in_file_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.placed(table(spark, sf_dir, name))


@query("head_in_file_order", "select l_orderkey, l_linenumber, l_suppkey, rn as ordinal from (select *, row_number() over () - 1 as rn from lineitem) order by rn limit 200")
def head_in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows as they stand in the files, by no column: the limit is the feature."""
    rows = files.numbered(in_file_order(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", files.PLACE))
    return rows.orderBy("ordinal").limit(200).select("l_orderkey", "l_linenumber", "l_suppkey", "ordinal")


@query("keep_first_in_file", "select l_suppkey, arg_min(l_orderkey, rn) as l_orderkey, arg_min(l_linenumber, rn) as l_linenumber from (select *, row_number() over () as rn from lineitem) group by l_suppkey")
def keep_first_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every supplier the row that stands first in the files."""
    rows = in_file_order(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", files.PLACE)
    return files.first_of_each(rows, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("file_ordinals", "select count(*) as n, count(distinct rn) as distinct_ordinals, min(rn) as least, max(rn) as most, sum(rn * l_orderkey % 1000003)::bigint as digest from (select *, row_number() over () - 1 as rn from lineitem)")
def file_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of every row, in one digest."""
    rows = files.numbered(in_file_order(spark, sf_dir, "lineitem").select("l_orderkey", files.PLACE))
    o = F.col("ordinal")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("distinct_ordinals"), F.min(o).alias("least"), F.max(o).alias("most"), F.sum(o * F.col("l_orderkey") % 1000003).alias("digest"))


RECORDS = "records as (select o_orderkey, 'P_' || o_custkey as patient_id, case o_orderstatus when 'F' then 'MALIGNANT' when 'O' then 'BENIGN' else 'UNKNOWN' end as standardized_pathology, (case o_orderstatus when 'F' then 1 when 'O' then 0 end)::int as label, case when o_orderkey % 2 = 0 then 'mass' else 'calcification' end as abnormality_category, o_orderkey % 10 > 0 as file_exists from orders)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("P_"), F.col("o_custkey").cast("string")).alias("patient_id"), F.when(s == "F", "MALIGNANT").when(s == "O", "BENIGN").otherwise("UNKNOWN").alias("standardized_pathology"),
        F.when(s == "F", 1).when(s == "O", 0).alias("label"), F.when(k % 2 == 0, "mass").otherwise("calcification").alias("abnormality_category"), (k % 10 > 0).alias("file_exists"),
    )


@query("dataset_statistics", f"""with {RECORDS}, s as (select count(*) as total_records, count(*) filter (where file_exists) as existing_files, count(distinct patient_id) as unique_patients, count(*) filter (where standardized_pathology = 'BENIGN') as benign_cases,
count(*) filter (where standardized_pathology = 'MALIGNANT') as malignant_cases, count(*) filter (where abnormality_category = 'mass') as mass_cases, count(*) filter (where abnormality_category = 'calcification') as calcification_cases from records) unpivot s on columns(*) into name metric value value""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dataset_statistics(records(spark, sf_dir))


MODE = "md as (select patient_id, label from (select patient_id, label, row_number() over (partition by patient_id order by count(*) desc, label) as rn from records where label is not null group by 1, 2) where rn = 1)"


@query("patient_mode_label", f"with {RECORDS}, {MODE} select patient_id, label from md")
def patient_mode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.patient_mode(records(spark, sf_dir))


SPLIT = """rk as (select patient_id, label, row_number() over (partition by label order by md5('42-' || patient_id), patient_id) as r from md),
sz as (select label, count(*) as n from md group by 1), cm as (select label, n, sum(n) over (order by label) as c from sz),
hd as (select label, n, ceil(round(c * 0.3::double, 9)) as h from cm), ts as (select label, n, h, ceil(round(h * 0.5::double, 9)) as t from hd),
st as (select label, n, h - coalesce(lag(h) over (order by label), 0) as held, t - coalesce(lag(t) over (order by label), 0) as test from ts),
sp as (select patient_id, label, case when r <= n - held then 'train' when r <= n - test then 'val' else 'test' end as split from rk join st using (label))"""


@query("patient_stratified_split", f"with {RECORDS}, {MODE}, {SPLIT} select patient_id, label, split from sp")
def patient_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stratified_split(patient_mode_label(spark, sf_dir))


@query("split_summary", f"with {RECORDS}, {MODE}, {SPLIT} select split, count(*) as cases, count(distinct patient_id) as patients, round(avg(r.label) * 100, 2) as malignant_pct from records r join sp using (patient_id) group by 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.split_summary(records(spark, sf_dir), patient_stratified_split(spark, sf_dir))


_SHARE = "('0x' || substr(md5('42-' || o_orderkey), 1, 8))::ubigint / 4294967296.0::double"


@query("random_split_sizes", f"select case when {_SHARE} < 0.2 then 'val' else 'train' end as side, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1")
def random_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded 80 / 20 split and its complement."""
    a, b = catalog.random_split(records(spark, sf_dir).select("o_orderkey"), "o_orderkey")
    return a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("val"))).groupBy("side").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("value_counts", "select 'o_orderstatus' as column_name, o_orderstatus as value, count(*) as n from orders where o_orderstatus is not null group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders where o_orderpriority is not null group by 2")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.value_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("duplicate_paths", "select text, count(*) - 1 as extra from documents group by 1 having count(*) > 1")
def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicates(table(spark, sf_dir, "documents").select("text"), "text")


@query("keep_first_record", "select doc_id, lang, source from (select *, row_number() over (partition by source, lang order by doc_id) as rn from documents) where rn = 1")
def keep_first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keep_first(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["source", "lang"], ["doc_id"])


@query("group_to_map", "with o as (select user_id, event_type, arg_max(value, event_id) as v, min(event_id) as e from events group by 1, 2) select user_id, string_agg(event_type || '=' || v::decimal(18,6)::varchar, ',' order by event_type) as entries, min(e) as first from o group by 1")
def group_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.group_to_map(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("map")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(18,6)").cast("string"))), ",")
    return m.select("user_id", text.alias("entries"), "first")


_STATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("metric_summary_35", "select l_returnflag, l_linestatus, " + ", ".join(f"round({f}({c}), 4) as {c}_{n}" for c in _STATS for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"), ("min", "min"), ("max", "max"))) + " from lineitem group by 1, 2")
def metric_summary_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.grouped_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [*_STATS, "absent"])
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@query("metric_pivot", "select l_returnflag, round(avg(l_quantity) filter (where l_linestatus = 'F'), 4) as \"F\", round(avg(l_quantity) filter (where l_linestatus = 'O'), 4) as \"O\" from lineitem group by 1")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 4).alias("m"))
    return catalog.pivoted(means, "l_returnflag", "l_linestatus", "m", ["O", "F"])


@query("path_columns_unpivot", f"with {CATALOG} select distinct column_name, path from (unpivot cat on " + ", ".join(audit.PATHS) + " into name column_name value path) where trim(path) <> ''")
def path_columns_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unpivoted(catalog_table(spark, sf_dir), audit.PATHS).distinct()


# --- audit


_BAD: dict[str, str] = {}


def _audit(name: str, make, bad: str, value: str) -> None:
    """bad: SQL for the violating rows with their value."""
    _BAD[name] = bad
    sql = f"""with {CATALOG}, bad as ({bad}), s as (select coalesce(array_to_string(list_sort(list(v)), ','), '') as samples from (select distinct {value}::varchar as v from bad where {value} is not null order by v limit 10))
select (select count(*) from bad) = 0 as passed, (select count(*) from bad) as violations, samples from s"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(catalog_table(spark, sf_dir)).select("passed", "violations", F.array_join("samples", ",").alias("samples"))

    query(name, sql)(run)


def _files(df: DataFrame) -> DataFrame:
    return audit.unpivoted(df.filter("doc_id % 40 > 0"), audit.PATHS).select("path").distinct()


def _sizes(df: DataFrame) -> DataFrame:
    return audit.unpivoted(df.filter("doc_id % 40 > 0"), audit.DECODED).groupBy("path").agg(F.lit(512).alias("height"), F.when(F.length("path") % 13 == 0, 511).otherwise(512).alias("width"))


_LONG = lambda columns, more="": f"(select * from (unpivot (select doc_id, {', '.join(columns)} from cat {more}) on {', '.join(columns)} into name column_name value path) where trim(path) <> '')"
_audit("audit_files_exist", lambda df: audit.files_exist(df, _files(df)), f"select path from {_LONG(audit.PATHS)} where path not in (select path from {_LONG(audit.PATHS, 'where doc_id % 40 > 0')})", "path")
_audit("audit_raw_untouched", lambda df: audit.raw_untouched(df), f"select path from {_LONG(audit.OUTPUTS)} where contains(path, 'data/raw')", "path")
_audit("audit_no_leakage", audit.no_leakage, "select patient_id from cat group by 1 having count(distinct dataset_split) > 1", "patient_id")
_audit("audit_pathology_present", audit.pathology_present, "select patient_id from cat where pathology is null or trim(pathology) = '' or upper(trim(pathology)) = 'UNKNOWN'", "patient_id")
_audit("audit_label_matches", audit.label_matches, "select patient_id from cat where (pathology = 'BENIGN' and label is distinct from 0) or (pathology = 'MALIGNANT' and label is distinct from 1)", "patient_id")
_audit("audit_dimensions", lambda df: audit.dimensions_valid(df, _sizes(df)), f"select distinct path from {_LONG(audit.DECODED, 'where doc_id % 40 > 0')} where length(path) % 13 = 0", "path")
_audit("audit_unique_outputs", audit.unique_outputs, "select path from (select *, row_number() over (partition by path) as rn from (select coalesce(nullif(trim(denoised_image_path), ''), nullif(trim(sharpened_image_path), ''), '') as path from cat)) where rn > 1", "path")


_CHECKS = {
    "audit_files_exist": "every_referenced_file_exists", "audit_raw_untouched": "no_raw_files_modified", "audit_no_leakage": "no_train_test_patient_leakage", "audit_pathology_present": "pathology_is_not_missing",
    "audit_label_matches": "label_matches_pathology", "audit_dimensions": "image_dimensions_are_valid", "audit_unique_outputs": "no_duplicate_output_paths",
}


@query("audit_all", f"with {CATALOG} " + " union all ".join(f"select '{check}' as \"check\", count(*) = 0 as passed, count(*) as violations from ({_BAD[name]})" for name, check in _CHECKS.items()))
def audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = catalog_table(spark, sf_dir)
    return audit.run_checks(df, _files(df), _sizes(df)).select("check", "passed", "violations")


@query("report_composition", f"with {CATALOG} " + " union all ".join(f"select '{section}' as section, '{c}' as item, {c}::varchar as value, count(*) as n from cat where {c} is not null group by 3" for section, cs in audit.COUNTED.items() for c in cs))
def report_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report's cohort, noise and filter sections count."""
    return audit.composition(catalog_table(spark, sf_dir))


@query("report_totals", f"""with {CATALOG}, m as (select count(*) as missing from ({_BAD['audit_files_exist']})), w as (select count(*) as wrong from ({_BAD['audit_dimensions']})),
t as (select count(*) as total, count(*) filter (where noise_type is null) as clean, any_value(missing) as missing, least(any_value(missing) + any_value(wrong), count(*)) as failed from cat, m, w)
select unnest(['total', 'clean', 'experiment', 'missing', 'failed', 'successful']) as item, unnest([total, clean, total - clean, missing, failed, total - failed])::bigint as n from t""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report's first section says of the records."""
    df = catalog_table(spark, sf_dir)
    return audit.totals(df, audit.run_checks(df, _files(df), _sizes(df))).select("item", "n")


_FINAL = ", ".join(c if c != "label" else "label::varchar as label" for c in catalog.FINAL_COLUMNS)


@query("final_catalog", f"""with {CATALOG}, base as (select * replace (null::varchar as noise_type, null::varchar as denoising_method, null::varchar as noisy_image_path, null::varchar as denoised_image_path) from cat where noise_type is null),
met as (select patient_id, abnormality_category, breast_side, image_view, pathology, label, noise_type, denoising_method, noisy_image_path, denoised_image_path from cat where noise_type is not null),
one as (select * from (select *, row_number() over (partition by patient_id, abnormality_category, breast_side, image_view, pathology, label order by doc_id) as rn from base) where rn = 1)
select {_FINAL} from base union all
select {', '.join('m.' + c if c in ('noise_type', 'denoising_method', 'noisy_image_path', 'denoised_image_path') else 'o.label::varchar as label' if c == 'label' else 'o.' + c for c in catalog.FINAL_COLUMNS)} from met m join one o on {' and '.join(f'm.{c} is not distinct from o.{c}' for c in catalog.LINEAGE_KEYS)}""")
def final_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = catalog_table(spark, sf_dir)
    clean = df.filter("noise_type is null").drop("noise_type", "denoising_method", "noisy_image_path", "denoised_image_path")
    metrics = df.filter("noise_type is not null").select(*catalog.LINEAGE_KEYS, "noise_type", "denoising_method", F.col("noisy_image_path").alias("noisy_image"), F.col("denoised_image_path").alias("denoised_image"))
    return catalog.final_catalog(clean, metrics, ["doc_id"]).withColumn("label", F.col("label").cast("string"))


# --- evaluation

SCORE = "(('0x' || substr(md5('s-' || doc_id), 1, 4))::ubigint % 1000 / 1000.0::double)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.conv(F.substring(F.md5(F.concat(F.lit("s-"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("int") % 1000 / 1000.0
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("prediction"), score.alias("score"))


_CONFUSION = "c as (select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality <> 1 and toxic = 1) as fp, count(*) filter (where quality = 1 and toxic <> 1) as fn, count(*) filter (where quality <> 1 and toxic <> 1) as tn from labels)"


@query("confusion_counts", f"with {_CONFUSION} select * from c")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(scored(spark, sf_dir), "truth", "prediction")


_share = lambda a, b, n: f"round(case when {b} > 0 then ({a})::double / ({b}) else 0 end, 6) as {n}"


@query("classification_metrics", f"with {_CONFUSION} select tp, fp, fn, tn, " + ", ".join([_share("tp + tn", "tp + tn + fp + fn", "accuracy"), _share("tp", "tp + fn", "sensitivity"), _share("tn", "tn + fp", "specificity"), _share("tp", "tp + fp", "precision"), _share("tp", "tp + fn", "recall"), _share("2 * tp", "2 * tp + fp + fn", "f1")]) + " from c")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.rates(evaluation.confusion(scored(spark, sf_dir), "truth", "prediction"))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query("roc_points", f"with s as (select quality as t, {SCORE} as score from labels), b as (select score as threshold, count(*) filter (where t = 1) as p, count(*) filter (where t <> 1) as n from s group by 1) select threshold, round(sum(p) over w / (sum(p) over ())::double, 6) as tpr, round(sum(n) over w / (sum(n) over ())::double, 6) as fpr from b window w as (order by threshold desc)")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_points(scored(spark, sf_dir), "truth", "score").select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("roc_auc", f"with s as (select quality as t, {SCORE} as score from labels) select round(sum(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5 else 0 end) / count(*), 6) as auc from s a, s b where a.t = 1 and b.t <> 1")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.auc(scored(spark, sf_dir), "truth", "score").select(F.round("auc", 6).alias("auc"))


@query("focal_loss", f"with s as (select doc_id, -ln(greatest(case when quality = 1 then 0.001::double + 0.998::double * {SCORE} else 1 - (0.001::double + 0.998::double * {SCORE}) end, 1e-12)) as ce from labels) select doc_id, round(0.25::double * power(1 - exp(-ce), 2) * ce, 6) as loss from s")
def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.round(evaluation.focal_loss(F.col("truth"), 0.001 + 0.998 * F.col("score")), 6).alias("loss"))
