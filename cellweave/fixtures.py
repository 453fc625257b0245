"""Stand-in inputs derived from the given benchmark tables.

The SQL text runs unchanged on Spark and DuckDB, so the same text feeds the queries and
their oracles. ``{part}`` style names are the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.ordered import running

_BARCODE = ("concat('s_002um_', lpad(cast({r} as string), 5, '0'), '_', "
            "lpad(cast({c} as string), 5, '0'), '-1')")


def _barcode(row: str, col: str) -> str:
    return _BARCODE.format(r=row, c=col)


FIXTURE_SQL: dict[str, str] = {
    "tissue_positions": f"""
select {_barcode('array_row', 'array_col')} as barcode, in_tissue, array_row, array_col,
  100.0e0 + 4.0e0*array_row as pxl_row_in_fullres, 200.0e0 + 4.0e0*array_col as pxl_col_in_fullres, bin_ordinal
from (select cast(p_partkey as bigint) as bin_ordinal, cast(floor(p_partkey/40.0e0) as int) as array_row,
  cast(p_partkey % 40 as int) as array_col, case when p_size > 2 then 1 else 0 end as in_tissue from {{part}}) t""",
    "pixels": """
select x, y, cell_id, b as is_boundary, 1-b as is_interior,
  case when b=0 and n=1 then 1 else 0 end as is_nuclear, case when b=0 and n=0 then 1 else 0 end as is_cytoplasm
from (select x, y, cast(floor((y+2)/20.0e0) as bigint)*9 + cast(floor((x+2)/20.0e0) as bigint) + 1 as cell_id,
  case when (x+2)%20 in (0,19) or (y+2)%20 in (0,19) then 1 else 0 end as b,
  case when ((x+2)%20 between 4 and 15 and (y+2)%20 between 4 and 15) or (x*7+y*3)%5 = 0 then 1 else 0 end as n
 from (select distinct cast(4*(l_partkey%40) + l_linenumber%4 as int) as x,
   cast(4*floor(l_partkey/40.0e0) + l_orderkey%4 as int) as y from {lineitem}) p0) p1""",
    "expression": f"""
select {_barcode('cast(floor(l_partkey/40.0e0) as int)', 'cast(l_partkey % 40 as int)')} as barcode,
  concat('G', lpad(cast(l_suppkey % 50 as string), 2, '0')) as gene, cast(sum(cast(l_quantity as bigint)) as bigint) as cnt
from {{lineitem}} group by 1, 2""",
    "sc_expression": """
select concat('C', cast(o_custkey as string)) as sc_barcode,
  concat('G', lpad(cast(l_suppkey % 50 as string), 2, '0')) as gene, cast(sum(cast(l_linenumber as bigint)) as bigint) as cnt
from {orders} join {lineitem} on o_orderkey = l_orderkey group by 1, 2""",
    "sc_metadata": """
select concat('C', cast(c_custkey as string)) as sc_barcode,
  case when c_custkey % 17 = 0 then null else c_mktsegment end as cell_type from {customer}""",
    "gt_cell_bins": f"""
select cast(gt as string) as cell_id, {_barcode('array_row', 'array_col')} as barcode, array_row, array_col,
  0.5e0*(200.0e0+4.0e0*array_col) as x_um, 0.5e0*(100.0e0+4.0e0*array_row) as y_um, max(is_nuclear) as is_nuclear, count(*) as n_px
from (select cast(floor(y/20.0e0) as bigint)*8 + cast(floor(x/20.0e0) as bigint) + 1 as gt,
  cast(floor(y/4.0e0) as int) as array_row, cast(floor(x/4.0e0) as int) as array_col, is_nuclear from {{pixels}}) g
group by 1,2,3,4,5,6""",
    "pred_assignments": f"""
select cell_id, barcode, array_row, array_col, is_nuclear from (
 select cell_id, {_barcode('array_row', 'array_col')} as barcode, array_row, array_col, is_nuclear,
  row_number() over (partition by array_row, array_col order by n_px desc, cell_id) as rn
 from (select cast(floor((y+6)/20.0e0) as bigint)*9 + cast(floor((x+3)/20.0e0) as bigint) + 1 as cell_id,
   cast(floor(y/4.0e0) as int) as array_row, cast(floor(x/4.0e0) as int) as array_col, max(is_nuclear) as is_nuclear, count(*) as n_px
  from {{pixels}} where (floor(y/4.0e0)*13 + floor(x/4.0e0)*7) % 11 <> 0 group by 1,2,3) a) b where rn = 1""",
}

STEP_LOG_INNER = """
select event_id, user_id as episode_id,
 case event_type when 'click' then 'add' when 'view' then 'replace' when 'purchase' then 'add' when 'error' then 'noop' else 'stop' end as action,
 event_id % 7 as cell_id, {barcode} as barcode, event_id % 5 <> 0 as applied,
 round(value/100.0e0 - 0.5e0, 4) as reward, round((event_id % 11)/10.0e0, 1) as value_est, event_type = 'signup' as done, ts, props
from {{events}}""".format(barcode=_barcode("cast(floor((event_id % 120)/40.0e0) as int)", "cast((event_id % 120) % 40 as int)"))

STEP_LOG_COLUMNS = ("episode_id", "step_index", "action", "cell_id", "barcode", "applied", "reward", "value_est", "done")


def load_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def fixture(spark: SparkSession, name: str, inputs: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(FIXTURE_SQL[name], **inputs)


def expression(lineitem: DataFrame) -> DataFrame:
    """The rows of ``FIXTURE_SQL["expression"]``, dealt by bin: a bin's counts lie in one file and are added up before they move."""
    lines = lineitem.selectExpr(f"{_barcode('cast(floor(l_partkey/40.0e0) as int)', 'cast(l_partkey % 40 as int)')} as barcode",
                                "concat('G', lpad(cast(l_suppkey % 50 as string), 2, '0')) as gene", "cast(l_quantity as bigint) as cnt")
    return lines.repartition("barcode").groupBy("barcode", "gene").agg(F.sum("cnt").alias("cnt"))


def step_log(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Action log with a dense step number per episode, numbered block-wise."""
    raw = spark.sql(STEP_LOG_INNER, events=events)
    ranked = running(raw, ["episode_id"], ["ts", "event_id"], rank="step_index")
    return ranked.select("event_id", *STEP_LOG_COLUMNS)


def shape_table(embeddings: DataFrame) -> DataFrame:
    """Four shape features per reference cell from the first embedding elements."""
    names = ("feature_log_area", "feature_compactness", "feature_solidity", "feature_anisotropy")
    return embeddings.select(
        F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("cell_type"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
