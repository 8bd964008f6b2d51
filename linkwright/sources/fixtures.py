"""Relations for tests and queries, derived from the `part` table in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = """
select p_partkey k, translate(substr(md5(cast(p_partkey % 41 as varchar(20))),1,6),'0123456789abcdef','bcdfghklmnpraeio') w, p_name nm, p_type ty,
  cast(p_size as varchar(20)) sz, replace(p_brand,'#',' ') br, cast(10000 + (p_partkey * 37) % 5000 as varchar(20)) pc, p_partkey % 4 c4
from part
"""
SOURCE1 = """
select 'S1-' || cast(k as varchar(20)) entity_id,
  case when k % 34 = 0 then '' else w || ' ' || nm || ' ' || ty || ' & Sons Corporation' end business_name,
  case when k % 26 = 0 then '' else sz || ' ' || br || ' Street, near Market, ' || pc end business_address,
  case c4 when 0 then 'US' when 1 then 'India' when 2 then 'France' else '' end country
from fx_base
"""
SOURCE2 = """
select 'S2-' || cast(k as varchar(20)) entity_id,
  case when k % 17 = 0 then ''
       when k % 5 = 0 then substr(w,1,1) || 'z' || substr(w,3) || ' ' || nm || ' ' || ty || ' and Sons Corp.'
       when k % 7 = 0 then ty || ' ' || nm || ' ' || w || ' and sons corp'
       when k % 11 = 0 then replace(upper(w || ' ' || nm),'E','É') || ' Sons Corp'
       else w || ' ' || nm || ' ' || ty || ' and Sons Corp' end business_name,
  case when k % 13 = 0 then '' else sz || ', ' || br || ' St. opp. Market ' || pc end business_address,
  case c4 when 0 then 'USA' when 1 then 'IN' when 2 then 'france' else '' end country
from fx_base where k % 3 <> 0
"""
SOURCE3 = """
select 'S3-' || cast(k as varchar(20)) entity_id,
  w || ' ' || nm || case when k % 8 = 0 then ' Pvt. Limited' else ' ' || ty || ' & Sons' end business_name,
  'Unit ' || sz || ' ' || br || ' Saint ' || case when k % 9 = 0 then '' else pc end business_address,
  case c4 when 0 then 'U.S.A.' when 1 then 'india' else 'FR' end country
from fx_base where c4 <> 3
"""
TRUTH = """
select 'S1-' || cast(k as varchar(20)) source1_entity_id,
  case when k % 3 <> 0 then 'S2-' || cast(k as varchar(20)) else '' end ||
  case when k % 3 <> 0 and c4 <> 3 then ',' else '' end ||
  case when c4 <> 3 then 'S3-' || cast(k as varchar(20)) else '' end matched_entity_ids
from fx_base
"""
#: Records that hold what normalisation must take apart or trim: ligatures, fractions, Hangul, tabs, line ends, wide and no-break spaces.
ODD = """
select 'O-' || cast(k as varchar(20)) entity_id,
  case k % 5 when 0 then w || '\u00a0 ﬁne ½ 한국 ' || nm || ' Corporation' when 1 then '\tnone\n' when 2 then '\u3000NaN\u2003' when 3 then nm || '\u2028& É\u0301tude' else '' end business_name,
  case k % 3 when 0 then sz || '½ ﬂat\u00a0' || br || ' Street' when 1 then '\u00a0None ' else sz || '\t' || pc end business_address,
  case c4 when 0 then '\u00a0USA\t' when 1 then 'in\n' when 2 then '\u3000' else 'FR\u2003' end country
from fx_base where k % 7 = 0
"""
CTES = {"fx_base": BASE, "fx_source1": SOURCE1, "fx_source2": SOURCE2, "fx_source3": SOURCE3, "fx_ground_truth": TRUTH, "fx_odd": ODD}


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part = part.repartition(2 * spark.sparkContext.defaultParallelism)  # one small file of few row groups, which would be normalised in as few tasks
    return spark.sql(BASE.replace("from part", "from {part}"), part=part)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """fx_source1, fx_source2, fx_source3 or fx_ground_truth over the part table of sf_dir."""
    return spark.sql(CTES[name].replace("fx_base", "{base}"), base=_base(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = _base(spark, sf_dir)
    return tuple(spark.sql(CTES[f"fx_source{i}"].replace("fx_base", "{base}"), base=base) for i in (1, 2, 3))
