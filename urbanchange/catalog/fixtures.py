"""Domain inputs derived from the driver tables.

Every ``fx_`` statement is valid unchanged in Spark SQL and in DuckDB. Grid and zones grow
with the supplier table: four pixels per supplier, sixteen pixels per image row, and one
triangle, one trapezoid and one overlapping square per block of 4 x 4 pixels.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from urbanchange.config import Grid

TABLES = (
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "labels",
)

FX = {
    "fx_obs": """
        select l_orderkey*10+l_linenumber obs_id,
          case when year(l_shipdate)<=1998 then 1 else 2 end period, l_shipdate ts,
          cast(l_orderkey % 5 as int) tile, l_linenumber band,
          cast(floor(l_suppkey/4e0) as int) row_,
          cast((l_suppkey % 4)*4 + l_partkey % 4 as int) col_,
          l_extendedprice value, cast(round(l_discount*100) as int) scl
        from lineitem""",
    "fx_scenes": """
        select o_orderkey scene_id, o_orderdate ts, cast(o_custkey % 100 as double) cloud_cover,
          cast(o_custkey % 16 as double) min_x, cast(o_orderkey % 16 as double) min_y,
          cast(o_custkey % 16 + 4 as double) max_x, cast(o_orderkey % 16 + 4 as double) max_y,
          concat('s2_', cast(o_orderkey as varchar(20)), '_',
                 cast(cast(o_orderdate as date) as varchar(10)), '.tif') name
        from orders""",
    "fx_census": """
        select o_custkey code,
          100e0*sum(case when year(o_orderdate)<=1998 and o_orderpriority in ('1-URGENT','2-HIGH') then 1 end)
            /sum(case when year(o_orderdate)<=1998 then 1 end) t1_age,
          100e0*sum(case when year(o_orderdate)>1998 and o_orderpriority in ('1-URGENT','2-HIGH') then 1 end)
            /sum(case when year(o_orderdate)>1998 then 1 end) t2_age,
          100e0*sum(case when year(o_orderdate)<=1998 and o_orderstatus='F' then 1 end)
            /sum(case when year(o_orderdate)<=1998 then 1 end) t1_edu,
          100e0*sum(case when year(o_orderdate)>1998 and o_orderstatus='F' then 1 end)
            /sum(case when year(o_orderdate)>1998 then 1 end) t2_edu,
          max(case when year(o_orderdate)<=1998 then o_totalprice end) t1_house,
          max(case when year(o_orderdate)>1998 then o_totalprice end) t2_house,
          min(case when year(o_orderdate)<=1998 then o_totalprice end) t1_income,
          min(case when year(o_orderdate)>1998 then o_totalprice end) t2_income
        from orders group by o_custkey""",
    "fx_long": """
        select o_custkey code, o_orderpriority category, o_orderstatus measurement,
          o_totalprice value from orders""",
    "fx_lookup": """
        select c_custkey old_code,
          case when c_acctbal < 0 then null else cast(floor(c_custkey/2e0) as bigint) end new_code
        from customer""",
    "fx_wards": """
        select c_custkey code, case when c_acctbal < 0 then null else c_nationkey end ward
        from customer""",
    "fx_steps": "select 0 k union all select 1 union all select 2 union all select 3",
    "fx_cells": """
        select row_, cast(4*a.k + b.k as int) col_
        from (select distinct cast(floor(s_suppkey/4e0) as int) row_ from supplier) r,
          fx_steps a, fx_steps b""",
    "fx_blocks": """
        select y0, cast(4*k as int) x0
        from (select distinct cast(floor(s_suppkey/16e0) as int)*4 y0 from supplier) r, fx_steps""",
    "fx_zones": """
        select y0*8+x0 code, 'a' kind, x0, y0 from fx_blocks
        union all select y0*8+x0+1, 'b', x0, y0 from fx_blocks
        union all select y0*8+x0+2, 'c', x0, y0 from fx_blocks""",
    "fx_planning": """
        select case when p_partkey % 3 = 0 then 'town' when p_partkey % 3 = 1 then 'conservation'
          else 'opportunity' end layer, p_partkey feature_id,
          cast(p_partkey % 13 as double) min_x, floor(p_partkey/80e0) + p_size % 3 + 0e0 min_y,
          p_partkey % 13 + 2.5e0 max_x, floor(p_partkey/80e0) + p_size % 3 + 1.5e0 max_y
        from part""",
    "fx_landcover": """
        select cast(floor(user_id/16e0) as int) row_, cast(user_id % 16 as int) col_,
          cast(floor(value) as int) % 9 cls from events""",
    "fx_clf": """
        select d.doc_id, l.quality label, case when d.n_chars>1000 then 1 else 0 end pred,
          cast(d.n_chars as double) score, cast(d.n_chars as double) x1,
          cast(length(d.source) as double) x2, cast(l.toxic as double) x3
        from documents d join labels l on d.doc_id=l.doc_id""",
}

LAYERS = ["town", "conservation", "opportunity"]
BANDS = [1, 2, 3, 4, 5, 6, 7]


def with_clause(query: str, statements: dict[str, str], recursive: bool = False) -> str:
    """Prefix ``query`` with the named statements it uses, directly or indirectly."""
    order: list[str] = []

    def visit(text: str, inside: str | None = None) -> None:
        for name in re.findall(r"\b(?:fx|o)_\w+", text):
            if name in statements and name not in order and name != inside:
                visit(statements[name], name)
                order.append(name)

    visit(query)
    if not order:
        return query
    parts = []
    for name in order:
        head = re.match(r"\s*--\s*cols:\s*(.*)\n", statements[name])
        columns = f"({head.group(1).strip()})" if head else ""
        parts.append(f"{name}{columns} as ({statements[name]})")
    word = "with recursive " if recursive else "with "
    return word + ",\n".join(parts) + "\n" + query


_OPENED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the file footer is read once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _OPENED:
        _OPENED[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _OPENED[key]


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input as a DataFrame."""
    text = with_clause(f"select * from {name}", FX)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The pixel grid: sixteen columns, one row per four suppliers."""
    top = table(spark, sf_dir, "supplier").selectExpr("floor(max(s_suppkey)/4) + 1").first()[0]
    return Grid(width=16, height=int(top))


_RINGS = {
    "a": ((0, 0), (3, 4), (0, 4)),
    "b": ((0, 0), (4, 0), (4, 4), (3, 4)),
    "c": ((1, 1), (3, 1), (3, 3), (1, 3)),
}


def zones(spark: SparkSession, sf_dir: str, kinds: str = "abc") -> DataFrame:
    """Zone polygons; squares overlap and are burned last."""
    from functools import reduce

    base = fx(spark, sf_dir, "fx_zones")
    parts = []
    for order, kind in enumerate(kinds):
        points = ",".join(
            f"named_struct('x', double(x0+{dx}), 'y', double(y0+{dy}))" for dx, dy in _RINGS[kind]
        )
        parts.append(
            base.where(f"kind = '{kind}'").selectExpr(
                "code", f"{order} as ord", f"array(array({points})) as rings", "kind"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning rectangles as polygons."""
    corners = ("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y")
    points = ",".join(f"named_struct('x', {x}, 'y', {y})" for x, y in corners)
    return fx(spark, sf_dir, "fx_planning").selectExpr(
        "layer", "feature_id", f"array(array({points})) as rings"
    )
