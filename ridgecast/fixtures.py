"""Deterministic views over the star-schema tables that give the radio and terrain operators rows to work on.

Each statement is plain SQL that means the same to Spark and to DuckDB; the registered queries and their SQL both start here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View -> (base table, SQL).
VIEWS = {
    # Some calls are placed by no source but the last, some seeds are confirmed by none, and some calls share the site of the call before.
    "fx_stations_raw": (
        "customer",
        """select ord, group_rank, callsign, type, case when dark then null else cast(36500000 + ((spot * 7919) % 60000) * 100 + group_rank * 1000 as double) / 1e6 end as lat,
 case when dark then null else cast(-115000000 + ((spot * 104729) % 65000) * 100 as double) / 1e6 end as lon, comment, lasttime, source, seed_only from (
 select ord, group_rank, callsign, type, comment, lasttime, source, seed_only, case when k % 12 = 5 then k - 1 else k end as spot, ord % 7 = 0 or (k % 10 = 3 and group_rank < 3) or (k % 10 = 6 and group_rank >= 2) as dark from (
 select c_custkey as ord, cast(c_custkey % 4 as int) as group_rank, cast(floor(c_custkey/4) as bigint) as k,
 case when c_custkey % 9 = 0 then ' n' else 'N' end || cast(cast(floor(c_custkey/4) as bigint) as string) || case when c_custkey % 13 = 0 then '*' else '' end as callsign,
 case when c_custkey % 4 = 3 then null when cast(floor(c_custkey/4) as bigint) % 3 = 0 then 'igate' else 'digi' end as type,
 case when c_custkey % 5 = 0 then '' else c_mktsegment end as comment,
 case when c_custkey % 11 = 0 then 0 else 1706659200 - ((c_custkey * 9973) % 500) * 86400 end as lasttime,
 case c_custkey % 4 when 0 then 'seed' when 1 then 'cache' when 2 then 'APRS-IS' else 'aprs.fi' end as source,
 (c_custkey % 4 = 0) as seed_only
from customer) keyed) marked""",
    ),
    # Station records as they come: any keys, coordinates as numbers or text, some with a name and no call, empty, null, false and nested values.
    "fx_records": (
        "customer",
        """select c_custkey as ord, cast(c_custkey % 4 as int) as group_rank,
 chr(123) || case when c_custkey % 11 = 0 then '"callsign": "", "name": " site ' || cast(c_custkey % 7 as string) || '"' else '"callsign": "n' || cast(cast(floor(c_custkey/4) as bigint) as string) || '*"' end
 || case when c_custkey % 7 = 0 then ', "lat": null, "lon": ""' when c_custkey % 3 = 0 then ', "lat": "' || cast(36 + c_custkey % 6 as string) || '.5", "lon": "-11' || cast(c_custkey % 5 as string) || '.25"' else ', "lat": ' || cast(36 + c_custkey % 6 as string) || '.5, "lon": -11' || cast(c_custkey % 5 as string) || '.25' end
 || ', "key' || cast(c_custkey % 5 as string) || '": ' || case c_custkey % 8 when 0 then '""' when 1 then 'null' when 2 then 'false' when 3 then '0' when 4 then chr(123) || '"a":[1,2],"b":"x"' || chr(125) when 5 then '"v' || cast(c_custkey as string) || '"' when 6 then '[true,null]' else cast(c_custkey as string) end
 || ', "symbol": "' || case when c_custkey % 2 = 0 then '#' else '' end || '", "_source": "' || case c_custkey % 4 when 0 then 'seed' when 1 then 'cache' when 2 then 'APRS-IS' else 'aprs.fi' end || '"' || case when c_custkey % 4 = 0 or c_custkey % 10 = 3 then ', "_seed_only": true' else '' end || chr(125) as value
from customer""",
    ),
    "fx_registry": (
        "customer",
        """select 'N' || cast(c_custkey as string) as callsign, case when c_custkey % 200 = 0 then null when c_custkey % 240 = 0 then 'Reviewed' when c_custkey % 80 = 0 then 'reviewed' else 'candidate' end as status,
 case when c_custkey % 160 = 0 then null else cast(36510000 + ((c_custkey * 7919) % 60000) * 100 as double) / 1e6 end as lat,
 case when c_custkey % 160 = 0 then null else cast(-114990000 + ((c_custkey * 104729) % 65000) * 100 as double) / 1e6 end as lon
from customer where c_custkey % 40 = 0""",
    ),
    "fx_osm": (
        "supplier",
        """select case when s_suppkey % 2 = 0 then 'node' else 'way' end as osm_type, s_suppkey as osm_id,
 cast(36500000 + ((s_suppkey * 7919) % 60000) * 100 + ((s_suppkey * 31) % 40) * 1000 as double) / 1e6 as lat,
 cast(-115000000 + ((s_suppkey * 104729) % 65000) * 100 as double) / 1e6 as lon,
 s_name as label from supplier""",
    ),
    "fx_packets": (
        "events",
        """select event_id as seq, ts as arrival_ts,
 case when event_type = 'error' then '# server comment' else
 'U' || cast(user_id as string) || '>APRS,D' || cast(user_id % 20 as string) || case when event_type in ('click','purchase') then '*' else '' end || ',WIDE2-1,' ||
 case when event_type in ('click','view') then 'qAR' else 'qAX' end || ',G' || cast(user_id % 11 as string) || ':!' ||
 lpad(cast(36 + user_id % 6 as string),2,'0') || lpad(cast(cast(floor(value*100) as bigint) % 60 as string),2,'0') || '.' || lpad(cast(event_id % 100 as string),2,'0') || 'N/' ||
 lpad(cast(108 + user_id % 7 as string),3,'0') || lpad(cast(event_id % 60 as string),2,'0') || '.' || lpad(cast(cast(floor(value) as bigint) % 100 as string),2,'0') || 'W' || case when user_id % 5 = 0 then '#' else '>' end || 'c' end as raw
from events""",
    ),
    "fx_dem": (
        "events",
        """select cast(floor(event_id/100) as int) as r, cast(event_id % 100 as int) as c,
 case when event_id % 197 = 0 then null else cast(1200 + 30 * abs(cast(floor(event_id/100) as bigint) % 40 - 20) + 25 * abs(event_id % 34 - 17) + cast(floor(value/10) as bigint) as double) end as elev_m
from events""",
    ),
    "fx_margin_hits": ("lineitem", "select cast(l_suppkey % 40 as int) as site, cast(l_partkey % 60 as int) as r, cast(l_orderkey % 60 as int) as c, cast(l_quantity - 25 as double) as margin_db from lineitem"),
    "fx_profiles": (
        "nation",
        """select n_nationkey as profile_id, case when n_nationkey % 6 = 0 then cast(0 as double) else cast(30 + n_nationkey as double) end as tx_power_dbm, cast(n_nationkey % 5 as double) as tx_gain_dbd,
 case when n_nationkey % 6 = 0 then cast(0 as double) else cast(-119 as double) end as rx_sens_dbm, case when n_nationkey % 6 = 0 then cast(0 as double) else cast(2 as double) end as rx_gain_dbd, cast(138 + (n_nationkey % 3) * 20 as double) as cap_db, cast(14439 as double)/100 as freq_mhz from nation""",
    ),
    "fx_track": (
        "events",
        """select user_id as track_id, event_id as ord, cast(40000000 + (user_id % 20) * 100000 + ((event_id*29) % 100) * 100 as double) / 1e6 as lat,
 cast(-112000000 + ((event_id*37) % 100) * 200 as double) / 1e6 as lon, value > 30 as is_hit from events""",
    ),
    "fx_kml": (
        "events",
        """select user_id as track_id, event_id as ord, case when event_id % 3 = 0 then '<gx:coord>' || cast(cast(-112000000 + event_id % 1000 as double)/1e6 as string) || ' 40.5 0</gx:coord>' else '<coordinates>-111.5,40.25,0 bad,1 -111.75,' || cast(40 + event_id % 3 as string) || '.5</coordinates>' end as kml from events""",
    ),
}

#: The fixed clock of all queries: 2024-01-31 00:00:00 UTC.
AS_OF = 1706659200


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    return spark.sql(sql.replace(f"from {table}", "from {base}"), base=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(sql: str) -> str:
    """The views that a statement names, as common table expressions in front of it."""
    used = [f"{name} as ({text})" for name, (_, text) in VIEWS.items() if name in sql]
    joined = ",\n".join(used)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {joined},\n{body[5:]}"
    return f"with {joined}\n{body}"
