"""The driver's tables seen as venues, offers, windows, items, registries and submissions.

Each lens is a list of (expression, name) over a table, in SQL that Spark and DuckDB read alike, so
that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_D = "CAST({} AS DOUBLE)".format

LENSES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "venue": (
        "customer",
        [
            ("c_custkey", "lid"), ("c_name", "name"), ("concat('z', CAST(c_nationkey AS VARCHAR(10)))", "zone_id"), ("c_mktsegment", "segment"), ("c_acctbal", "balance"),
            (f"{_D(40.089)} + {_D('(c_custkey * 37) % 200 - 100')} / {_D(500)}", "lat"), (f"{_D(-75.396)} + {_D('(c_custkey * 53) % 200 - 100')} / {_D(400)}", "lng"),
        ],
    ),
    "deal": (
        "orders",
        [
            ("o_orderkey", "deal_id"), ("o_custkey", "lid"), ("CASE o_orderpriority WHEN '5-LOW' THEN 'daily_special' WHEN '3-MEDIUM' THEN 'food_combo' ELSE 'happy_hour' END", "type"),
            ("CASE WHEN o_orderkey % 11 = 0 THEN 'disputed' WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderstatus = 'O' THEN 'likely' ELSE 'unconfirmed' END", "confidence"),
            ("CAST(o_orderkey % 200 AS INTEGER)", "age_days"), ("o_totalprice", "total"), ("o_orderpriority", "priority"), ("o_orderstatus", "status"),
        ],
    ),
    "window_": (
        "lineitem",
        [
            ("l_orderkey", "deal_id"), ("l_linenumber", "dow"), ("CAST(600 + (CAST(l_quantity AS INTEGER) * 30) % 720 AS INTEGER)", "start"),
            ("CAST(least(1440, 600 + (CAST(l_quantity AS INTEGER) * 30) % 720 + 60 + (l_suppkey % 5) * 45) AS INTEGER)", "end"), ("l_partkey", "part_id"), ("l_suppkey", "supp_id"),
        ],
    ),
    "item": (
        "lineitem",
        [
            ("l_orderkey", "deal_id"),
            ("CASE l_partkey % 9 WHEN 0 THEN 'food' WHEN 1 THEN 'draft' WHEN 2 THEN 'bottle_can' WHEN 3 THEN 'wine' WHEN 4 THEN 'well' WHEN 5 THEN 'cocktail' WHEN 6 THEN 'shot' WHEN 7 THEN 'food' ELSE 'novelty' END", "category"),
            (f"CASE WHEN l_suppkey % 3 = 0 THEN {_D('l_partkey % 40')} / {_D(4)} + {_D(2)} END", "price"),
            (f"CASE WHEN l_suppkey % 3 = 1 THEN {_D('(l_partkey % 10) * 5')} END", "pct"),
            (f"CASE WHEN l_suppkey % 3 = 2 AND l_partkey % 7 > 0 THEN {_D('l_partkey % 4 + 1')} END", "off"),
            ("l_linenumber", "pos"), ("l_partkey", "part_id"),
        ],
    ),
    "licence": (
        "customer",
        [
            ("c_custkey", "lid"), ("CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('Tap Room ', CAST(c_custkey % 400 AS VARCHAR(10))) END", "premises"),
            ("concat('HOLDCO ', CAST(c_custkey AS VARCHAR(10)), ' LLC')", "licensee"),
            ("CASE c_mktsegment WHEN 'BUILDING' THEN 'Restaurant' WHEN 'AUTOMOBILE' THEN 'Brewery' WHEN 'MACHINERY' THEN 'Club' WHEN 'HOUSEHOLD' THEN 'Hotel' ELSE 'Distributor' END", "licence_type"),
            ("CASE WHEN c_custkey % 13 = 0 THEN 'Expired' ELSE 'Active' END", "status"), ("c_nationkey", "nation"),
            ("CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat('19', lpad(CAST(c_custkey % 60 AS VARCHAR(10)), 3, '0')) END", "zip"),
            ("concat(CAST(c_custkey % 90 + 1 AS VARCHAR(10)), CASE c_custkey % 4 WHEN 0 THEN ' W Ridge Pike' WHEN 1 THEN ' MAIN STREET' WHEN 2 THEN ' N Spring Mill Ave' ELSE ' Market Sq' END, CASE WHEN c_custkey % 5 = 0 THEN ' STE 4' ELSE '' END)", "street"),
            (f"{_D(40.089)} + {_D('(c_custkey * 37) % 200 - 100')} / {_D(250)}", "lat"), (f"{_D(-75.396)} + {_D('(c_custkey * 53) % 200 - 100')} / {_D(200)}", "lng"),
        ],
    ),
    "place": (
        "supplier",
        [
            ("s_suppkey", "place_id"), ("concat('Tap Room ', CAST((s_suppkey * 7) % 400 AS VARCHAR(10)))", "place_name"),
            ("concat('19', lpad(CAST(s_suppkey % 60 AS VARCHAR(10)), 3, '0'))", "zip"), ("CAST(s_suppkey % 90 + 1 AS VARCHAR(10))", "number"),
            ("CASE s_suppkey % 4 WHEN 0 THEN 'West Ridge Pk' WHEN 1 THEN 'Main St' WHEN 2 THEN 'North Spring Mill Avenue' ELSE 'Market Square' END", "street"),
            ("s_nationkey", "nation"), ("CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('http://place', CAST(s_suppkey AS VARCHAR(10)), '.example.com') END", "website"),
        ],
    ),
    "submission": (
        "events",
        [("event_id", "id"), ("user_id", "ip_hash"), ("CAST(ts AS DATE)", "day"), ("event_type", "event_type"), ("value", "value"), ("ts", "ts"), ("props", "props")],
    ),
}


def columns(lens: str) -> list[str]:
    return [f"{expression} AS `{name}`" for expression, name in LENSES[lens][1]]


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{LENSES[name][0]}.parquet").selectExpr(*columns(name))


def sql(query: str, *names: str) -> str:
    """query over the named lenses, for DuckDB."""
    parts = []
    for name in names:
        table, cells = LENSES[name]
        listed = ", ".join(f'{e} AS "{a}"' for e, a in cells)
        parts.append(f"{name} AS (SELECT {listed} FROM {table})")
    body = query.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
