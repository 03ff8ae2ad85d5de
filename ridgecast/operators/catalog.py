"""Building the station catalog: merging sources, roles and positions, lookups, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coerce_number, normalize_call, record_key

#: Sources that confirm a seed position, fixed values.
LIVE_SOURCES = ("APRS-IS", "aprs.fi", "reviewed_override")
#: Keys of open records that say where a record came from, and that its position is an unconfirmed seed's; fixed values.
SOURCE, SEED_ONLY = "_source", "_seed_only"
#: Columns that place a row among the others or name it; all further ones are merged.
_PLACES = ("callsign", "name", "group_rank", "ord", "seed_only")


def _present(rows: DataFrame, c: str):
    """Whether a field has a value: neither null nor an empty string (0 and false are values)."""
    return F.col(c).isNotNull() & (F.col(c) != "") if dict(rows.dtypes)[c] == "string" else F.col(c).isNotNull()


def record_states(groups: DataFrame, key: str = "callsign", rank: str = "group_rank", row: str = "ord") -> DataFrame:
    """One row for each call: for every field its last value with its place (struct of at, value), and the places of the last seed and live rows.

    The key is the call sign, else the name (where there is such a column); rows with neither are dropped. States of any parts of the rows merge to the state of all
    (merge_states), so a stored catalog can go on from where it was.
    """
    call = record_key(F.col(key), F.col("name")) if "name" in groups.columns else normalize_call(F.col(key))
    rows = groups.withColumn("__call", call).filter("__call <> ''").withColumn("__at", F.struct(F.col(rank).cast("long").alias("rank"), F.col(row).cast("long").alias("ord")))
    fields = [c for c in groups.columns if c not in (*_PLACES, key, rank, row)]
    last = lambda c: F.max_by(F.struct(F.col("__at").alias("at"), F.col(c).alias("value")), F.when(_present(rows, c), F.col("__at"))).alias(c)
    confirmed = [F.col("source").isin(*LIVE_SOURCES), *[_present(rows, c) for c in ("lat", "lon")]]
    seeded = F.max(F.when(F.col("seed_only"), F.col("__at"))).alias("__seeded")
    live = F.max(F.when(confirmed[0] & confirmed[1] & confirmed[2], F.col("__at"))).alias("__live")
    named = [last("name")] if "name" in groups.columns else []
    return rows.groupBy(F.col("__call").alias("callsign")).agg(*named, *[last(c) for c in fields], seeded, live)


def merge_states(*states: DataFrame) -> DataFrame:
    """The states of all rows from the states of parts of them; fields that some parts lack are theirs to lack."""
    every = states[0]
    for other in states[1:]:
        every = every.unionByName(other, allowMissingColumns=True)
    fields = [c for c in every.columns if c not in ("callsign", "__seeded", "__live")]
    return every.groupBy("callsign").agg(*[F.max_by(c, F.col(c)["at"]).alias(c) for c in fields], F.max("__seeded").alias("__seeded"), F.max("__live").alias("__live"))


def merged_values(states: DataFrame) -> DataFrame:
    """The catalog that states stand for: callsign, every field's value, seed_only."""
    fields = [c for c in states.columns if c not in ("callsign", "__seeded", "__live")]
    seed_only = F.col("__seeded").isNotNull() & (F.col("__live").isNull() | (F.col("__seeded") > F.col("__live")))
    return states.select("callsign", *[F.col(c)["value"].alias(c) for c in fields], seed_only.alias("seed_only"))


def merge_records(groups: DataFrame, key: str = "callsign", rank: str = "group_rank", row: str = "ord") -> DataFrame:
    """One row for each call, else name: every column's last value that is neither null nor empty, groups in order and rows in order within.

    seed_only stays only while no later live row with coordinates has confirmed the station. Rows without a call and a name are dropped.
    """
    return merged_values(record_states(groups, key, rank, row))


# open keys: records as they came, a map of their JSON values


def field_states(groups: DataFrame, record: str = "record", rank: str = "group_rank", row: str = "ord") -> DataFrame:
    """callsign, field, at, value: each field of open records (a map of variants) where it has a value, keyed by call sign, else name.

    A live record with coordinates takes the mark of an unconfirmed seed away: an entry for that field without a value, placed behind the record's own fields.
    """
    get = lambda k: F.try_element_at(record, F.lit(k))
    told = lambda k: F.try_variant_get(get(k), "$", "string")
    has = lambda v: ~F.coalesce(F.is_variant_null(v), F.lit(True)) & (F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("?")) != "")
    confirmed = F.coalesce(told(SOURCE).isin(*LIVE_SOURCES) & has(get("lat")) & has(get("lon")), F.lit(False))
    place = lambda late: F.struct(F.col(rank).cast("long").alias("rank"), F.col(row).cast("long").alias("ord"), F.lit(late).alias("late"))
    rows = groups.withColumns({"__call": record_key(told("callsign"), told("name")), "__confirmed": confirmed}).filter("__call <> ''")
    each = rows.select("__call", place(False).alias("at"), F.explode(record).alias("field", "value")).filter(has(F.col("value")) & (F.col("field") != "callsign"))
    taken = rows.filter("__confirmed").select("__call", place(True).alias("at"), F.lit(SEED_ONLY).alias("field"), F.lit(None).cast("variant").alias("value"))
    known = rows.select("__call", place(False).alias("at"), F.lit("callsign").alias("field"), F.to_variant_object(F.array("__call")).alias("value")).withColumn("value", F.try_variant_get("value", "$[0]", "variant"))
    return latest_fields(each.unionByName(taken).unionByName(known).withColumnRenamed("__call", "callsign"))


def latest_fields(*states: DataFrame) -> DataFrame:
    """Each field's last entry over all parts (callsign, field, at, value)."""
    every = states[0]
    for other in states[1:]:
        every = every.unionByName(other)
    return every.groupBy("callsign", "field").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value"))


def open_records(states: DataFrame) -> DataFrame:
    """callsign, record: the merged records, maps of whatever keys theirs had."""
    entries = F.collect_list(F.struct("field", "value"))
    return states.filter("value is not null").groupBy("callsign").agg(F.map_from_entries(entries).alias("record"))


def merge_open_records(groups: DataFrame, record: str = "record", rank: str = "group_rank", row: str = "ord") -> DataFrame:
    """merge_records() of records with any keys."""
    return open_records(field_states(groups, record, rank, row))


def typed_stations(records: DataFrame, record: str = "record") -> DataFrame:
    """Further columns, and callsign, name, type, lat, lon, comment, symbol, lasttime, source, seed_only of open records; numbers may be text."""
    get = lambda k: F.try_variant_get(F.try_element_at(record, F.lit(k)), "$", "string")
    seen = lambda k: F.nullif(coerce_number(get(k)), F.lit(0.0))
    fields = {
        **{k: get(k) for k in ("callsign", "name", "type")}, "lat": coerce_number(get("lat")), "lon": coerce_number(get("lon")), "comment": get("comment"), "symbol": get("symbol"),
        "lasttime": F.coalesce(seen("lasttime"), seen("last seen")).cast("long"), "source": get(SOURCE), "seed_only": F.coalesce(get(SEED_ONLY).try_cast("boolean"), F.lit(False)),
    }
    return records.select(*[c for c in records.columns if c != record and c not in fields], *[v.alias(k) for k, v in fields.items()])


def role_sets(roles: DataFrame) -> DataFrame:
    """call, is_digi, is_igate over all sightings."""
    return roles.groupBy("call").agg(F.bool_or(F.col("role") == "digi").alias("is_digi"), F.bool_or(F.col("role") == "igate").alias("is_igate"))


def symbol_roles(positions: DataFrame) -> DataFrame:
    """Senders whose symbol marks a digipeater."""
    return positions.filter("symbol = '#'").select("call", F.lit("digi").alias("role"))


def latest_positions(positions: DataFrame, order: str = "seq") -> DataFrame:
    """Each call's position in its last packet."""
    return positions.groupBy("call").agg(F.max_by(F.struct("lat", "lon", "symbol", "comment"), order).alias("p"), F.max(order).alias("last")).select("call", "p.*", "last")


def role_type(digi="is_digi"):
    return F.when(F.col(digi), "digi").otherwise("igate")


def heard_stations(roles: DataFrame, positions: DataFrame) -> DataFrame:
    """Calls with a role and a position; digi goes before igate."""
    return role_sets(roles).join(latest_positions(positions), "call").select(F.col("call").alias("callsign"), role_type().alias("type"), "lat", "lon", "symbol", "comment")


def unresolved_calls(roles: DataFrame, positions: DataFrame) -> DataFrame:
    return role_sets(roles).join(positions.select("call").distinct(), "call", "left_anti")


def role_map(groups: DataFrame) -> DataFrame:
    """Each call's last known type."""
    known = groups.filter("type is not null and type <> ''").withColumn("callsign", normalize_call(F.col("callsign"))).filter("callsign <> ''")
    return known.groupBy("callsign").agg(F.max_by("type", F.struct("group_rank", "ord")).alias("type"))


def resolve_lookups(unresolved: DataFrame, lookup: DataFrame, types: DataFrame, mode: str = "acquire") -> DataFrame:
    """Lookup rows of unresolved calls. acquire: the type known elsewhere, or none; collect: digi or igate as heard (column is_digi)."""
    rows = unresolved.join(lookup, "callsign")
    if mode == "collect":
        return rows.withColumn("type", role_type()).drop("is_digi", "is_igate")
    return rows.join(types, "callsign", "left")


def colocation_groups(stations: DataFrame, digits: int = 4) -> DataFrame:
    """Sites by rounded coordinates: canonical call, members, how many."""
    site = [F.bround("lat", digits).alias("site_lat"), F.bround("lon", digits).alias("site_lon")]
    return stations.filter("lat is not null and lon is not null").groupBy(*site).agg(F.min("callsign").alias("canonical"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("callsign")).alias("members"))


def effective_registry(user: DataFrame, packaged: DataFrame) -> DataFrame:
    """The user's entries over the packaged ones."""
    both = user.withColumn("__rank", F.lit(0)).unionByName(packaged.withColumn("__rank", F.lit(1)))
    first = Window.partitionBy("callsign").orderBy("__rank")
    return both.withColumn("callsign", normalize_call(F.col("callsign"))).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__rank")


def upsert_registry(registry: DataFrame, changes: DataFrame) -> DataFrame:
    return effective_registry(changes, registry)


def delete_from_registry(registry: DataFrame, calls: DataFrame) -> DataFrame:
    return registry.join(calls.select(normalize_call(F.col("callsign")).alias("callsign")), "callsign", "left_anti")


def session_metadata(lines: DataFrame, roles: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: packets, calls with a role, positions resolved, calls unresolved (unresolved_calls() lists them, a row each)."""
    calls = role_sets(roles).join(positions.select("call", F.lit(True).alias("known")).distinct(), "call", "left")
    found = calls.agg(F.count(F.lit(1)).alias("calls_observed"), F.count_if("known").alias("positions_resolved"), F.count_if(F.col("known").isNull()).alias("unresolved"))
    both = lines.agg(F.count(F.lit(1)).alias("packets_observed")).unionByName(found, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("packets_observed", "calls_observed", "positions_resolved", "unresolved")])
