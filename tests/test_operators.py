"""Golden rows, boundaries and properties of the radio and terrain operators."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgecast.functions import geo, radio, text, trust
from ridgecast.operators import catalog, coverage, nearest, propagation, quality, rays, terrain, tracks
from ridgecast.sources import packets, sinks, stations
from ridgecast.streaming import session


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "lat, lon, want",
    [(40.7608, -111.8910, (32612, 12, "N")), (39.7392, -104.9903, (32613, 13, "N")), (34.0522, -118.2437, (32611, 11, "N")), (40.7128, -74.0060, (32618, 18, "N")), (-33.8688, 151.2093, (32756, 56, "S"))],
)
def test_utm_zone(spark, lat, lon, want):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double").withColumn("z", geo.utm_zone(F.col("lon")))
    assert one(df.select(geo.utm_epsg(F.col("lat"), F.col("z")), "z", geo.hemisphere(F.col("lat")))) == [want]


def test_utm_forward_known_point(spark):
    df = spark.createDataFrame([(40.7608, -111.8910)], "lat double, lon double")
    east, north = geo.utm_forward(F.col("lat"), F.col("lon"), F.lit(12))
    e, n = one(df.select(east, north))[0]
    assert abs(e - 424_777) < 200 and abs(n - 4_512_700) < 500
    lat, lon = geo.utm_inverse(F.lit(e), F.lit(n), F.lit(12), F.lit(False))
    assert one(df.select(F.round(lat, 8), F.round(lon, 8))) == [(40.7608, -111.891)]


def test_boundaries(spark):
    df = spark.createDataFrame([(float(x),) for x in (7, 7.1, 90, 90.1, 365, 365.1)], "age double")
    assert [r[0] for r in one(df.select(trust.freshness_label(F.col("age"))))] == ["RECENT", "AGING", "AGING", "STALE", "STALE", "VERY_STALE"]
    df = spark.createDataFrame([(150,), (151,), (500,), (501,)], "d int")
    assert [r[0] for r in one(df.select(trust.osm_status(F.lit(True), F.lit(True), F.col("d"))))] == ["AUTO_CORROBORATED", "PROBABLE", "PROBABLE", "DISAGREES"]
    df = spark.createDataFrame([(0.10,), (0.11,), (0.30,), (1.0,), (1.1,)], "d double")
    assert [r[0] for r in one(df.select(trust.osm_strength(F.col("d"))))] == ["STRONG", "GOOD", "GOOD", "NEARBY", "WEAK"]
    df = spark.createDataFrame([(80,), (79,), (55,), (54,)], "s int")
    assert [r[0] for r in one(df.select(trust.confidence_label(F.col("s"))))] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_confidence_caps(spark):
    rows = [("APRS-IS", False, "NOT_CHECKED", None, 90), ("cache", True, "NOT_CHECKED", None, 65), ("seed", True, "AUTO_CORROBORATED", None, 85), ("cache", False, "DISAGREES", None, 49), ("APRS-IS", False, "DISAGREES", None, 90), ("cache", False, "NO_MATCH", "reviewed", 100), ("APRS-IS", False, "NO_MATCH", "candidate", 49), ("other", False, "PROBABLE", None, 70)]
    df = spark.createDataFrame(rows, "source string, seed boolean, status string, reg string, want int")
    assert all(a == b for a, b in one(df.select(trust.confidence_score(F.col("source"), F.col("seed"), F.col("status"), F.col("reg")), "want")))


def test_budget(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 138.0, 138.0), (30.0, 3.0, -119.0, 2.0, 138.0, 138.0), (10.0, 1.0, -100.0, 2.0, 138.0, 113.0)], "a double, b double, c double, d double, cap double, want double")
    assert all(x == y for x, y in one(df.select(radio.effective_budget_db(*[F.col(c) for c in ("a", "b", "c", "d", "cap")]), "want")))


def test_normalize_order(spark):
    df = spark.createDataFrame([(" n0call* ",), ("\tw7xyz-1\n",), (None,), ("* x",)], "c string")
    assert [r[0] for r in one(df.select(text.normalize_call(F.col("c"))))] == ["N0CALL", "W7XYZ-1", "", " X"]


def test_packet_grammar(spark):
    lines = ["A1>APRS,D1*,QAX*,WIDE2-1,qAR,G1:!4046.00N/11153.50W#hello", "no header", "B2>APRS:=3352.00S/15112.00E>x", "# c", "   ", "C3>APRS,qAO:no gate", "D4>APRS,qAS,G2:@092345z4903.50N/07201.75W>t"]
    df = packets.packet_lines(spark.createDataFrame(list(enumerate(lines)), "seq long, raw string"))
    assert df.count() == 5
    assert sorted(one(packets.packet_roles(df).select("seq", "call", "role"))) == [(0, "D1", "digi"), (0, "G1", "igate"), (6, "G2", "igate")]
    spots = {r.seq: r for r in packets.packet_positions(df).collect()}
    assert round(spots[0].lat, 6) == 40.766667 and round(spots[0].lon, 6) == -111.891667 and spots[0].symbol == "#" and spots[0].comment == "hello"
    assert round(spots[2].lat, 6) == -33.866667 and round(spots[2].lon, 6) == 151.2 and round(spots[6].lat, 6) == 49.058333


def test_station_json_variants(spark):
    df = spark.createDataFrame([('{"stations": 5, "results": [{"callsign": "A"}]}',), ('[{"callsign": "B", "lat": 1.5}]',), ('{"data": [{"callsign": "C"}]}',)], "value string")
    assert sorted(r.callsign for r in stations.parse_stations(df, strict=True).collect()) == ["A", "B", "C"]
    assert sorted(r.callsign for r in stations.parse_stations(df).collect()) == ["B", "C"]
    assert stations.read_stations(spark, "/nowhere/at/all.json").count() == 0
    with pytest.raises(Exception, match="no station list"):
        stations.parse_stations(spark.createDataFrame([('{"x": 1}',)], "value string"), strict=True).collect()


def test_registry_json(spark):
    df = spark.createDataFrame([('{"version": 1, "overrides": {" w7a*": {"status": "reviewed", "lat": 1, "lon": 2}, "bad": 5}}',), ('{"K7B": {"status": "candidate"}}',), ("not json",)], "value string")
    assert sorted((r.callsign, r.status, r.lat) for r in stations.parse_registry(df).collect()) == [("K7B", "candidate", None), ("W7A", "reviewed", 1.0)]


def test_seed_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Callsign,Lat,Lon,Type,Comment,Override,Power_W,Height_ft,Gain_dBd,Dir_deg\nW7X,40.5,-111.5,Digi,hill,N,50,,3,\n")
    row = stations.read_seed_csv(spark, str(tmp_path / "s.csv")).first()
    assert (row.callsign, row.type, row.lat, row.seed_only) == ("W7X", "digi", 40.5, True)


def test_merge_matches_ordered_rule(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        rows.append((i, rng.randrange(4), f"N{rng.randrange(12)}", rng.choice([None, "", "digi", "igate"]), rng.choice([None, 1.5, 0.0]), rng.choice([None, 2.5]), rng.choice(["", "c1", "c2"]), rng.choice([None, 0, 7]), rng.choice(["seed", "cache", "APRS-IS", "aprs.fi"]), rng.random() < 0.3))
    want = {}
    for i, g, call, *values in sorted(rows, key=lambda r: (r[1], r[0])):
        state = want.setdefault(call, dict.fromkeys(("type", "lat", "lon", "comment", "lasttime", "source"), None) | {"seed_only": False})
        for name, value in zip(("type", "lat", "lon", "comment", "lasttime", "source"), values[:6]):
            if value is not None and value != "":
                state[name] = value
        if values[6]:
            state["seed_only"] = True
        if values[5] in catalog.LIVE_SOURCES and values[1] is not None and values[2] is not None:
            state["seed_only"] = values[6]
    df = spark.createDataFrame(rows, "ord long, group_rank int, callsign string, type string, lat double, lon double, comment string, lasttime long, source string, seed_only boolean")
    got = {r.callsign: {k: r[k] for k in ("type", "lat", "lon", "comment", "lasttime", "source", "seed_only")} for r in catalog.merge_records(df).collect()}
    seed = {c: v.pop("seed_only") for c, v in want.items()}
    for call, row in got.items():
        row.pop("seed_only")
    assert got == want and seed


def test_merge_is_idempotent(spark):
    df = spark.createDataFrame([(1, 0, "a", "digi", 1.0, 2.0, "x", 5, "seed", True), (2, 1, "A*", None, 3.0, None, "", 0, "cache", False)], "ord long, group_rank int, callsign string, type string, lat double, lon double, comment string, lasttime long, source string, seed_only boolean")
    once = catalog.merge_records(df)
    again = catalog.merge_records(once.withColumns({"ord": F.lit(1), "group_rank": F.lit(0)}))
    assert one(once.select(*sorted(once.columns))) == one(again.select(*sorted(once.columns)))


def test_nearest_matches_brute_force(spark):
    rng = random.Random(3)
    sites = [(f"S{i}", rng.uniform(60, 61), rng.uniform(10, 11)) for i in range(150)]
    marks = [("node", i, rng.uniform(60, 61), rng.uniform(10, 11)) for i in range(300)]

    def distance(a, b, c, d):
        p, q, r, s = map(math.radians, (a, b, c, d))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    want = {}
    for call, lat, lon in sites:
        d, i = min((distance(lat, lon, la, lo), i) for _, i, la, lo in marks)
        want[call] = i if d <= 5 else None
    got = nearest.nearest_feature(spark.createDataFrame(sites, "callsign string, lat double, lon double"), spark.createDataFrame(marks, "osm_type string, osm_id long, lat double, lon double"), 5.0)
    assert {r.callsign: r.osm_id for r in got.collect()} == want


def test_line_of_sight_equals_pairwise(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for site in range(8):
        elev = [1500 + rng.gauss(0, 15) + 30 * math.sin(k / 7 + site) for k in range(1, 81)]
        rows += [(site, 0, k, k * 250.0, e, 1520.0) for k, e in enumerate(elev, 1)]
        for k, e in enumerate(elev, 1):
            total, top = k * 250.0, 1520.0 + 10
            want[site, k] = all(elev[j - 1] + (d := j * 250.0) * (total - d) * 0.8 / (2 * 6_371_000) <= top + d / total * (e + 2 - top) + 1e-9 for j in range(1, k))
    df = spark.createDataFrame(rows, "site int, radial int, k int, dist_m double, elev_m double, site_elev double")
    assert {(r.site, r.k): r.clear for r in propagation.line_of_sight(df, 10.0, 2.0).collect()} == want


def flat_grid(spark, elev="1000.0D"):
    from ridgecast.sources.grids import grid_of

    dem = spark.range(900).selectExpr("cast(id div 30 as int) r", "cast(id % 30 as int) c", f"{elev} elev_m")
    return dem, grid_of(dem, 30, 30)


def test_coverage_grows_with_budget(spark):
    from ridgecast.plans import area

    _, grid = flat_grid(spark, "cast(1000 + (id * 7919) % 60 as double)")
    sites = spark.createDataFrame([(1, "digi", 15, 15, 1050.0)], "site int, type string, r int, c int, site_elev double")
    cells = [area.site_grids(sites, grid, rays.Geometry(24, 30, 12.0, 12000.0), b, 144.39, model="fspl_los").count() for b in (95.0, 110.0, 130.0)]
    assert cells[0] <= cells[1] <= cells[2] and cells[2] > 0


def test_gap_fill_and_smooth_match_numpy(spark):
    rng = np.random.default_rng(2)
    grid = np.where(rng.random((14, 11)) < 0.3, rng.integers(1, 40, (14, 11)), 0).astype(float)
    grid[0, 0] = grid[13, 10] = 5
    reach = 2
    padded = np.pad(grid, 2 * reach)
    rows, cols = 14 + 2 * reach, 11 + 2 * reach
    box = np.array([[padded[i : i + 2 * reach + 1, j : j + 2 * reach + 1].max() for j in range(cols)] for i in range(rows)])
    filled = np.where(np.pad(grid, reach) == 0, box, np.pad(grid, reach))
    df = spark.createDataFrame([(1, int(i), int(j), float(grid[i, j])) for i, j in zip(*np.nonzero(grid))], "site int, r int, c int, margin_db double")
    got = coverage.gap_fill(df, reach)
    assert {(r.r + reach, r.c + reach): r.margin_db for r in got.collect()} == {(i, j): filled[i, j] for i in range(rows) for j in range(cols)}
    sigma = max(1.0, 0.6 * reach)
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    start = np.where(filled == 0, -1.0, filled)
    blur = np.apply_along_axis(lambda x: np.convolve(np.pad(x, radius, mode="symmetric"), w, "valid"), 0, start)
    blur = np.apply_along_axis(lambda x: np.convolve(np.pad(x, radius, mode="symmetric"), w, "valid"), 1, blur)
    want = np.where(start == -1, -1.0, blur)
    for r in coverage.smooth(got, reach).collect():
        assert abs(r.margin_db - want[r.r + reach, r.c + reach]) < 1e-9


def test_reach():
    assert coverage.gap_fill_reach(100.0, 1080, 0.25) == 2 and coverage.gap_fill_reach(2500.0, 360, 2.0) == 22


def test_schedule():
    d = propagation.sample_schedule(50_000.0)
    assert len(d) == 40 and d[12] == 10_000.0 and d[-1] == 50_000.0 and d[0] > 500


def test_segments_share_flip_points(spark):
    pts = [(1, i, 40.0, -112.0 + 0.001 * i, i < 3) for i in range(6)] + [(1, 6, 41.0, -112.0, False), (1, 7, 41.0, -111.999, False)]
    got = tracks.segment_track(spark.createDataFrame(pts, "track_id int, ord int, lat double, lon double, is_hit boolean"))
    assert sorted((r.segment, r.is_hit, [p.ord for p in r.points]) for r in got.collect()) == [(0, True, [0, 1, 2, 3]), (1, False, [3, 4, 5]), (2, False, [6, 7])]


def test_validate_empty_track(spark):
    track = spark.createDataFrame([], "track_id int, ord int, lat double, lon double")
    cover = spark.createDataFrame([], "r int, c int, n_sites long")
    stats, lines = tracks.validate_track(track, cover, 42.0, -112.0, 0.01, (40.0, 42.0, -112.0, -111.0))
    assert one(stats) == [(0, 0, 0, 0, 0.0)] and lines.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    lines = [(i, f"U{i % 7}>APRS,D{i % 5}*,qAR,G{i % 3}:!40{i % 60:02d}.00N/111{i % 60:02d}.00W{'#' if i % 4 == 0 else '>'}") for i in range(200)]
    df = spark.createDataFrame(lines, "seq long, raw string").withColumn("arrival_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))).select("seq", "arrival_ts", "raw")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = session.packet_stream(spark, str(tmp_path / "in"), 2)
    found = session.run_to_table(session.heard(session.running_catalog(stream)), f"{tmp_path}/out", f"{tmp_path}/at").result()
    batch = session.heard(session.running_catalog(df))
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect())) and len(list((tmp_path / "out").iterdir())) == 1  # earlier results are gone
    assert session.within_session(df, F.timestamp_seconds(F.lit(1_700_000_000)), 50).count() == 50


def test_upsert_catalog_in_any_batches(spark):
    """Whatever the batches, the stored states end as those of all rows; values, order and seed flag included."""
    rng = random.Random(11)
    schema = "ord long, group_rank int, callsign string, name string, type string, lat double, lon double, symbol string, lasttime long, source string, seed_only boolean"
    rows = [(i, rng.randrange(4), rng.choice(["a", " A*", "B", "", None]), rng.choice([None, "site one", "b"]), rng.choice([None, "", "digi", "igate"]), rng.choice([None, 1.5, 0.0]), rng.choice([None, 2.5]), rng.choice(["", "#", None]), rng.choice([None, 0, 7]), rng.choice(["seed", "APRS-IS"]), rng.random() < 0.4) for i in range(120)]
    whole = one(catalog.merge_records(spark.createDataFrame(rows, schema)))
    assert len(whole) == 3
    for cuts in (1, 3, 4):
        rng.shuffle(rows)
        stored = {}
        merge = session.upsert_catalog(lambda: stored.get("now"), lambda df: stored.update(now=spark.createDataFrame(df.collect(), df.schema)))
        for k in range(cuts):
            merge(spark.createDataFrame(rows[k::cuts], schema), k)
        assert one(catalog.merged_values(stored["now"])) == whole


def test_upsert_catalog_without_order(spark):
    """Rows that bring no order come after those of earlier batches."""
    stored = {}
    merge = session.upsert_catalog(lambda: stored.get("now"), lambda df: stored.update(now=spark.createDataFrame(df.collect(), df.schema)))
    schema = "callsign string, type string, lat double, lon double, comment string, lasttime long, source string, seed_only boolean"
    merge(spark.createDataFrame([("A", "digi", 1.0, 2.0, "old", 1, "seed", True)], schema), 0)
    merge(spark.createDataFrame([("a", None, 1.5, 2.5, "", 2, "APRS-IS", False), ("B", "igate", 3.0, 4.0, "b", 3, "APRS-IS", False)], schema), 1)
    rows = {r.callsign: r for r in catalog.merged_values(stored["now"]).collect()}
    assert rows["A"].type == "digi" and rows["A"].lat == 1.5 and rows["A"].comment == "old" and not rows["A"].seed_only and rows["B"].lat == 3.0


def test_counters_over_many_triggers(spark, tmp_path):
    lines = spark.range(310).selectExpr("id as seq", "timestamp_seconds(1700000000 + id) as arrival_ts", "case when id % 3 = 0 then 'U>A,D*:x' else 'U:x' end as raw")
    lines.repartition(310, "seq").write.parquet(str(tmp_path / "in"))
    files = len(list((tmp_path / "in").glob("part-*")))
    counters = session.Counters(every=0.5)
    session.run_to_table(session.progress(session.packet_stream(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "at"), mode="append", counters=counters)
    assert counters.triggers == files > 150 and counters.totals == {"lines": 310, "with_path": 104}
    times = [t for t, _ in counters.seen]
    assert all(b - a >= 0.5 for a, b in zip(times, times[1:])) and spark.read.parquet(str(tmp_path / "out")).count() == 310


def test_session_over_an_endless_source_ends_on_time(spark, tmp_path):
    import time

    rate = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    packets = rate.selectExpr("value as seq", "timestamp as arrival_ts", "concat('U', value % 5, '>A,D', value % 3, '*:!4000.00N/11100.00W#') as raw")
    began = time.monotonic()
    done = session.run_to_table(session.running_catalog(packets), str(tmp_path / "out"), str(tmp_path / "at"), seconds=8)
    assert 8 <= time.monotonic() - began < 40 and not done.query.isActive
    assert {r.call for r in done.result().collect()} <= {f"{a}{k}" for a in "UD" for k in range(5)} and len(list((tmp_path / "out").iterdir())) <= 2


def test_lines_of_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# hello\nU1>A,D1*:!4000.00N/11100.00W>\n\n U1>A,D1*:!4100.00N/11100.00W> \r\n")
    stream = session.text_stream(spark, f"{tmp_path}/in")
    found = session.run_to_table(session.running_catalog(stream), f"{tmp_path}/out", f"{tmp_path}/at").result().collect()
    assert {(r.call, r.p and r.p.lat) for r in found} == {("U1", 41.0), ("D1", None)}
    batch = session.text_lines(spark.read.option("wholetext", True).text(f"{tmp_path}/in").select("value", "_metadata"))
    assert sorted((r.call, r.p and r.p.lat) for r in session.running_catalog(batch).collect()) == sorted((r.call, r.p and r.p.lat) for r in found)
    records = spark.createDataFrame([(bytearray(b"U2>A,D2*:x"), 1, 5)], "value binary, partition int, offset long").withColumn("timestamp", F.timestamp_seconds(F.lit(5)))
    assert [(r.call, r.is_digi) for r in session.running_catalog(session.kafka_lines(records)).collect()] == [("D2", True)]


def test_cache_validity(spark):
    meta = spark.createDataFrame([(1000, 40.0, -112.0, 100.0)], "updated_at long, center_lat double, center_lon double, radius_km double")
    valid = lambda **k: session.cache_is_valid(meta, **({"lat": 40.0, "lon": -112.0, "radius_km": 100.0, "as_of": 1000} | k)).first().valid
    assert valid() and not valid(as_of=1000 + 6 * 3600 + 1) and not valid(lat=40.1) and valid(lat=40.1, radius_km=80.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "digi", 1.0, 2.0, "c"), ("B", None, 1.0, 2.0, "c")], "callsign string, type string, lat double, lon double, comment string")
    sinks.write_catalog(df, str(tmp_path / "c"), updated_at=5, lat=1.0, lon=2.0, radius_km=3.0)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    assert sinks.freeze_stations(df, str(tmp_path / "f"), "j1").count() == 2
    cells = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 6.0)], "site int, r int, c int, margin_db double")
    sinks.write_margin_grid(cells, str(tmp_path / "g"))
    sinks.write_margin_grid(cells.filter("site = 2").withColumn("margin_db", F.lit(9.0)), str(tmp_path / "g"))
    assert sorted((r.site, r.margin_db) for r in spark.read.parquet(str(tmp_path / "g")).collect()) == [(1, 5.0), (2, 9.0)]


def test_tile_sets(spark):
    a = spark.createDataFrame([("x",), ("y",)], "tile string")
    assert terrain.same_tiles(a, a.orderBy("tile")) and not terrain.same_tiles(a, a.limit(1))


def test_resolve_seed(spark):
    a, empty = spark.createDataFrame([("x",)], "callsign string"), spark.createDataFrame([], "callsign string")
    assert stations.resolve_seed(a, empty).count() == 1 and stations.resolve_seed(empty, a, chosen=True).count() == 0 and stations.resolve_seed(None, a).count() == 1


def row_chain(sites, dem, g, budget, heights, floor=0.0, top=60.0):
    """The painted cells by the operators on rows: profiles, sight, samples, loss, interpolation, paint."""
    ground = terrain.profiles(sites, dem, 30, 30, g.n_radials, g.points, g.radius_px, g.radius_m)
    seen = propagation.line_of_sight(ground, heights[0], heights[1])
    margins = propagation.path_loss(propagation.samples(seen, g.radius_m, g.points), F.lit(budget), F.lit(144.39), "fspl_los")
    steps = propagation.interpolate_margin(propagation.useful_radials(margins, floor), g.radius_m, g.points)
    return margins, propagation.paint(steps, sites, g.n_radials, g.radius_px, g.radius_m, floor, top, 30, 30)


def test_rays_as_arrays_equal_rays_as_rows(spark):
    """Profiles, stats and painted losses of every ray against the operators on rows, with holes in the terrain and sites at the grid's edge."""
    from ridgecast.plans import area

    dem, grid = flat_grid(spark, "case when id % 97 = 0 then null else cast(1000 + (id * 7919) % 260 as double) end")
    g = rays.Geometry(48, 40, 9.0, 9000.0)
    sites = spark.createDataFrame([(1, "digi", 15, 15, 1110.0), (2, "igate", 1, 28, 1200.0), (3, "digi", 29, 0, 1050.0)], "site int, type string, r int, c int, site_elev double")
    rows = terrain.profiles(sites, dem, 30, 30, 48, 40, 9.0, 9000.0)
    want = {(r.site, r.radial, r.k): r.elev_m for r in rows.collect()}
    got = {(r.site, r.radial, k): e for r in rays.profiles(sites, grid, g).collect() for k, e in enumerate(r.elev_m, 1)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)

    margins, painted = row_chain(sites, dem, g, 120.0, (10.0, 2.0))
    seen = rays.sightlines(area._viewed(sites, [(0, 10.0, 10.0, 2.0)]), grid, g)
    offset = rays.offset_db(F.lit(120.0), F.lit(144.39), "fspl_los")
    stats = {r.site: (r.n_rays, r.n_covered) for r in rays.ray_stats(seen, g, offset, 5.0, "fspl_los").collect()}
    assert stats == {r.site: (r.n_rays, r.n_covered) for r in propagation.radial_stats(margins, 48, 5.0).collect()}
    viewed = area._viewed(sites, [(0, 10.0, 10.0, 2.0)])
    cells = rays.painted_losses(viewed, grid, g, "fspl_los").withColumn("m", offset - F.col("loss")).filter("m > 0").collect()
    own = {(1, 15, 15), (2, 1, 28), (3, 29, 0)}
    assert {(r.site, r.r, r.c): round(r.m, 6) for r in cells if (r.site, r.r, r.c) not in own} == {(r.site, r.r, r.c): round(r.margin_db, 6) for r in painted.collect() if (r.site, r.r, r.c) not in own}


def test_heights_and_geometry_of_profiles_matter(spark):
    """Every profile of a job gives the grid that it gives alone; antenna heights by type, target height and rays tell grids apart."""
    from ridgecast.plans import area

    dem, grid = flat_grid(spark, "cast(1000 + (id * 7919) % 260 as double)")
    sites = spark.createDataFrame([(1, "digi", 15, 15, 1110.0), (2, "igate", 4, 25, 1150.0)], "site int, type string, r int, c int, site_elev double")
    base = {"budget_db": 125.0, "freq_mhz": 144.39, "floor_db": 0.0, "max_db": 60.0, "gap_factor": 0.25, "digi_height_m": 10.0, "igate_height_m": 10.0, "target_height_m": 2.0, "n_radials": 36, "points": 40, "radius_px": 9.0, "radius_m": 9000.0}
    changes = [{}, {"digi_height_m": 90.0}, {"igate_height_m": 90.0}, {"target_height_m": 60.0}, {"n_radials": 90}, {"radius_px": 5.0, "radius_m": 5000.0}, {"budget_db": 110.0}, {"freq_mhz": 900.0}, {"floor_db": 12.0}]
    rows = [(k, *(base | c).values()) for k, c in enumerate(changes)]
    made = area.scenario_grids(sites, spark.createDataFrame(rows, area.PROFILE), grid).collect()
    grids = {k: {(r.site, r.r, r.c): round(r.margin_db, 6) for r in made if r.profile_id == k} for k in range(len(changes))}
    for k, c in enumerate(changes):
        p = base | c
        alone = area.site_grids(sites, grid, rays.Geometry(p["n_radials"], p["points"], p["radius_px"], p["radius_m"]), p["budget_db"], p["freq_mhz"], p["floor_db"], p["max_db"], p["gap_factor"], "fspl_los", p["digi_height_m"], p["igate_height_m"], p["target_height_m"])
        assert {(r.site, r.r, r.c): round(r.margin_db, 6) for r in alone.collect()} == grids[k]
        assert k == 0 or grids[k] != grids[0]
    of = lambda k, site: {c: m for c, m in grids[k].items() if c[0] == site}
    assert of(1, 2) == of(0, 2) and of(1, 1) != of(0, 1) and of(2, 1) == of(0, 1) and of(2, 2) != of(0, 2)
    assert area.scenario_grids(sites, spark.createDataFrame([], area.PROFILE), grid).count() == 0 and area.scenario_grids(sites.limit(0), spark.createDataFrame(rows[:1], area.PROFILE), grid).count() == 0


def test_call_signs_at_one_site_share_its_grid(spark):
    from ridgecast.plans import area
    from ridgecast.sources.grids import Grid

    dem, grid = flat_grid(spark)
    east, north = geo.utm_forward(F.lit(40.0), F.lit(-111.0), F.lit(12))
    at = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    grid = Grid(grid.blocks, 30, 30, at.e - 15_500, at.n + 15_500, 1000.0, 12)
    stations_ = spark.createDataFrame([("B", "igate", 40.00001, -111.0), ("A", "digi", 40.0, -111.0), ("C", "digi", 40.05, -111.05)], "callsign string, type string, lat double, lon double")
    sites = area.sites_on_grid(stations_, grid, dem)
    assert sorted((r.site, r.type, r.r, r.c) for r in sites.collect())[0] == ("A", "digi", 15, 15) and sites.count() == 2
    grids = area.site_grids(sites, grid, rays.Geometry(36, 30, 3.0, 3000.0), 138.0, 144.39)
    assert area.merged_coverage(grids).agg(F.max("n_sites")).first()[0] <= 2
    shared = area.station_grids(grids, stations_)
    cells = {c: {(r.r, r.c, r.margin_db) for r in shared.collect() if r.callsign == c} for c in "ABC"}
    assert cells["A"] == cells["B"] and cells["A"] != cells["C"] and len(cells["A"]) > 9


def test_stored_grid_reads_the_tiles_it_needs(spark, tmp_path):
    from ridgecast.sources import grids

    cells = spark.range(40 * 2100).selectExpr("cast(id div 2100 as int) r", "cast(id % 2100 as int) c", "case when id % 31 = 0 then -9999.0D else cast(id % 1000 as double) end elev_m")
    made = grids.grid_of(cells, 40, 2100, nodata=-9999.0, easting0=5.0, northing0=7.0, cell_m=30.0, zone=12)
    stored = grids.write_grid(made, str(tmp_path))
    assert (stored.height, stored.width, stored.easting0, stored.northing0, stored.cell_m, stored.zone, stored.south) == (40, 2100, 5.0, 7.0, 30.0, 12, False)
    rows = lambda g: {(r.tile, r.br, r.bc): r.cells for r in g.blocks.collect()}
    assert rows(stored) == rows(made) and len({t for t, _, _ in rows(stored)}) == 3
    sites = spark.createDataFrame([(1, 20, 100), (2, 20, 130)], "site int, r int, c int")
    near = grids.windows(sites, stored, 12)
    assert {(r.site, r.br, r.bc) for r in near.collect()} == {(1, 0, 1), (2, 0, 1), (2, 0, 2)}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    near.collect()
    block = {(r.br, r.bc): r.cells for r in stored.blocks.filter("br = 0 and bc = 1").collect()}[0, 1]
    assert block[0] == (None if 64 % 31 == 0 else 64.0) and block[64] == 128.0 and block[65 * 39 + 64] == float((39 * 2100 + 128) % 1000) and block[65 * 40] is None
    spark.createDataFrame([(0, 5, 0.0, 0.0, 1.0, 0, False)], "height int, width int, easting0 double, northing0 double, cell_m double, zone int, south boolean").write.mode("overwrite").parquet(f"{tmp_path}/about")
    with pytest.raises(ValueError):
        grids.read_grid(spark, str(tmp_path))


def test_site_and_scenario_grids_are_finished(spark):
    """Grids of few rays equal the whole grid filled, smoothed and thresholded in numpy, also at the grid's edge."""
    from ridgecast.plans import area

    dem, grid_ = flat_grid(spark)
    sites = spark.createDataFrame([(1, "digi", 15, 15, 1000.0), (2, "digi", 1, 28, 1000.0)], "site int, type string, r int, c int, site_elev double")
    g = rays.Geometry(12, 30, 10.0, 10000.0)
    painted = row_chain(sites, dem, g, 138.0, (10.0, 2.0))[1].collect()
    reach, want = coverage.gap_fill_reach(10.0, 12, 0.25), {}
    radius = int(4 * max(1.0, 0.6 * reach) + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(1.0, 0.6 * reach)) ** 2)
    w /= w.sum()
    for site in (1, 2):
        grid = np.zeros((30, 30))
        for p in painted:
            if p.site == site:
                grid[p.r, p.c] = p.margin_db
        padded = np.pad(grid, reach)
        box = np.array([[padded[i : i + 2 * reach + 1, j : j + 2 * reach + 1].max() for j in range(30)] for i in range(30)])
        start = np.where(grid == 0, box, grid)
        start[start == 0] = -1.0
        blur = start
        for axis in (0, 1):
            blur = np.apply_along_axis(lambda x: np.convolve(np.pad(x, radius, mode="symmetric"), w, "valid"), axis, blur)
        blur = np.where((start == -1) | (blur < 0), -1.0, np.minimum(blur, 60.0))
        want |= {(site, i, j): blur[i, j] for i, j in zip(*np.nonzero(blur > -1))}
    assert len(want) > len(painted)
    got = {(r.site, r.r, r.c): r.margin_db for r in area.site_grids(sites, grid_, g, 138.0, 144.39, model="fspl_los").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    profile = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 0.0, 138.0, 144.39, None)], "profile_id int, tx_power_dbm double, tx_gain_dbd double, rx_sens_dbm double, rx_gain_dbd double, cap_db double, freq_mhz double, max_db double")
    job = area.radio_profiles(profile, floor_db=0.0, max_db=60.0, gap_factor=0.25, digi_height_m=10.0, igate_height_m=10.0, target_height_m=2.0, n_radials=12, points=30, radius_px=10.0, radius_m=10000.0)
    scenario = {(r.site, r.r, r.c): r.margin_db for r in area.scenario_grids(sites, job, grid_).collect()}
    assert scenario.keys() == want.keys() and all(abs(scenario[k] - want[k]) < 1e-9 for k in want)


def test_nearest_over_seam_and_poles(spark):
    """Brute force where longitude has its seam and at the poles; the first row of a call with a place on the globe counts."""
    rng = random.Random(9)
    places = [(0.0, 179.9995), (0.0, -179.9995), (89.9999, 10.0), (89.9999, -170.0), (-90.0, 0.0), (65.0, 180.0), (65.0, -180.0)]
    near = lambda lat, lon: (max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), (lon + rng.uniform(-0.03, 0.03) + 180) % 360 - 180)
    sites = [(f"S{i}", i, *near(*places[i % len(places)])) for i in range(60)]
    marks = [("node", i, *near(*places[i % len(places)])) for i in range(80)] + [("way", 200, 0.0, None), ("way", 201, 95.0, 0.0)]

    def distance(a, b, c, d):
        p, q, r, s = map(math.radians, (a, b, c, d))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    want = {}
    for call, _, lat, lon in sites:
        d, i = min((distance(lat, lon, la, lo), i) for _, i, la, lo in marks[:80])
        want[call] = i if d <= 2 else None
    odd = [("S0", 90, 3.0, 3.0), ("S1", -5, None, 1.0), ("S1", -4, 99.0, 1.0), ("N", 1, None, None)]
    schema = "callsign string, ord int, lat double, lon double"
    got = nearest.nearest_feature(spark.createDataFrame(odd + sites, schema), spark.createDataFrame(marks, "osm_type string, osm_id long, lat double, lon double"), 2.0)
    assert {r.callsign: r.osm_id for r in got.collect()} == want and sum(w is not None for w in want.values()) > 30
    pair = nearest.nearest_feature(spark.createDataFrame([("A", 1, 0.0, 179.9997)], schema), spark.createDataFrame([("node", 1, 0.0, -179.9997, "mast")], "osm_type string, osm_id long, lat double, lon double, label string"), 1.0).first()
    assert pair.matched and 60 < pair.distance_m < 70 and pair.label == "mast" and pair.radius_km == 1.0


def test_review_queue_over_many_partitions(spark):
    rows = [(f"C{k * 7919 % 1000:03d}", None if k % 11 == 0 else k * 31 % 50, "LOW" if k % 3 else "HIGH", k % 5 == 0) for k in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = quality.review_queue(spark.createDataFrame(rows, "callsign string, score int, label string, review_candidate boolean"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        have = {r.callsign: (r.queue_score, r.next_call) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    queue = sorted((999 if s is None else s, c) for c, s, label, review in rows if label == "LOW" or review)
    assert have == {c: (s, queue[i + 1][1] if i + 1 < len(queue) else None) for i, (s, c) in enumerate(queue)} and "SinglePartition" not in plan


def test_positions_as_first_reported_stay(spark):
    schema = "callsign string, type string, lat double, lon double, lasttime long, source string, seed_only boolean"
    rows = spark.createDataFrame([("A", "digi", 40.0, -111.0, 1_706_000_000, "APRS-IS", False), ("B", "digi", 41.0, -111.0, None, "seed", True), ("C", "digi", None, -111.0, 5, "seed", True)], schema)
    registry = spark.createDataFrame([("a*", "Reviewed", 40.5, -111.5, "moved", "survey", "http://x"), ("B", None, None, None, "look", None, None)], "callsign string, status string, lat double, lon double, reason string, source string, source_url string")
    once = quality.assess(rows, registry, None, 1_706_659_200)
    twice = quality.assess(once, registry, nearest.nearest_feature(once, spark.createDataFrame([("node", 5, 40.5, -111.5, "mast")], "osm_type string, osm_id long, lat double, lon double, label string"), 1.0), 1_706_659_200)
    got = {r.callsign: r for r in twice.collect()}
    a, b, c = (got[k] for k in "ABC")
    assert (a.reported_lat, a.reported_lon, a.lat, a.lon) == (40.0, -111.0, 40.5, -111.5) and a.location_source == "reviewed_override"
    assert a.correction.asDict() == {"status": "reviewed", "reason": "moved", "source": "survey", "source_url": "http://x", "candidate_lat": 40.5, "candidate_lon": -111.5} and a.review is None
    assert a.osm.strength == "STRONG" and a.osm.label == "mast" and a.osm.radius_km == 1.0 and a.freshness_reason == "last heard 7 days before the reference date"
    assert b.review.status == "candidate" and b.review.reason == "look" and b.review.candidate_lat is None and b.correction is None and b.freshness_reason == "no usable last-heard time"
    assert c.score is None and c.reported_lat is None and c.lon == -111.0


def test_region_over_the_seam(spark):
    rng = random.Random(4)
    rows = [(str(i), "digi", rng.uniform(-90, 90) if i % 2 else rng.uniform(60, 72), rng.choice([-1, 1]) * rng.uniform(170, 180)) for i in range(400)]
    df = spark.createDataFrame(rows, "callsign string, type string, lat double, lon double")
    for lat, lon, radius in ((66.0, 179.0, 500.0), (-20.0, -179.9, 300.0), (89.0, 0.0, 900.0), (0.0, 100.0, 50.0)):
        near = {r.callsign for r in df.filter(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= radius).collect()}
        assert {r.callsign for r in quality.filter_region(df, lat, lon, radius).collect()} == near


def test_open_records_from_files(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"stations": {"no": "list"}, "results": [{"callsign": "a*", "lat": "40.5", "lon": -111, "k": {"x": [1]}}, 3, None, "t", {"name": " b ", "n": 0, "f": False, "e": "", "z": None, "_seed_only": True}]}))
    found = stations.open_records_of(spark, f"{tmp_path}/a.json")
    assert found.count() == 0  # the first key that is there is no list
    strict = stations.open_records_of(spark, f"{tmp_path}/a.json", strict=True)
    assert [sorted(r.record) for r in strict.orderBy("pos").collect()] == [["callsign", "k", "lat", "lon"], ["_seed_only", "e", "f", "n", "name", "z"]]
    merged = catalog.merge_open_records(strict.withColumns({"ord": F.col("pos").cast("long"), "group_rank": F.lit(0)}))
    text_of = {r.callsign: {k: json.loads(v) for k, v in r.m.items()} for r in merged.select("callsign", F.transform_values("record", lambda k, v: F.to_json(v)).alias("m")).collect()}
    assert text_of == {"A": {"callsign": "A", "lat": "40.5", "lon": -111, "k": {"x": [1]}}, "B": {"callsign": "B", "name": " b ", "n": 0, "f": False, "_seed_only": True}}
    typed = {r.callsign: r for r in catalog.typed_stations(merged.drop("callsign")).collect()}
    assert typed["A"].lat == 40.5 and typed["A"].lon == -111.0 and typed["B"].seed_only and typed["B"].lat is None
    assert [(r.callsign, r.lat, r.lon) for r in stations.read_stations(spark, f"{tmp_path}/a.json", strict=True).collect()] == [("a*", 40.5, -111.0), (None, None, None)]
    with pytest.raises(Exception, match="no station list"):
        stations.parse_records(spark.createDataFrame([('{"a": 1}',)], "value string"), strict=True).collect()
    assert stations.parse_records(spark.createDataFrame([("not json",), ('{"data": []}',), (None,), ("[1, 2]",)], "value string")).count() == 0


def test_open_merge_in_parts_and_in_order(spark):
    """Random records: the ordered rule on dictionaries, and any split into parts."""
    import json

    rng, rows = random.Random(2), []
    for i in range(200):
        record = {k: rng.choice([None, "", 0, False, 1.5, "v", [1], {"a": None}]) for k in rng.sample(["p", "q", "r", "lat", "lon"], rng.randrange(6))}
        record |= {"callsign": rng.choice(["a", " A*", "B", ""]), "name": rng.choice(["site", "b", ""]), "_source": rng.choice(["seed", "APRS-IS", ""])} | ({"_seed_only": True} if rng.random() < 0.3 else {})
        rows.append((i, rng.randrange(4), json.dumps([record])))
    want = {}
    for _, _, value in sorted(rows, key=lambda r: (r[1], r[0])):
        record = json.loads(value)[0]
        call = (record.get("callsign") or record.get("name") or "").strip().upper().replace("*", "")
        if not call:
            continue
        state = want.setdefault(call, {})
        state |= {k: v for k, v in (record | {"callsign": call}).items() if v is not None and v != ""}
        if record["_source"] in catalog.LIVE_SOURCES and all(record.get(k) is not None and record.get(k) != "" for k in ("lat", "lon")):
            state.pop("_seed_only", None)
    df = stations.parse_records(spark.createDataFrame(rows, "ord long, group_rank int, value string"))
    read = lambda states: {r.callsign: {k: json.loads(v) for k, v in r.m.items()} for r in catalog.open_records(states).select("callsign", F.transform_values("record", lambda k, v: F.to_json(v)).alias("m")).collect()}
    assert read(catalog.field_states(df)) == want and len(want) > 2
    parts = [catalog.field_states(df.filter(F.col("ord") % 3 == k)) for k in range(3)]
    assert read(catalog.latest_fields(*parts)) == want


def test_store_computes_what_it_lacks(spark, tmp_path):
    """A second run with one new site, a moved one and a new profile adds those grids only, and reads the same as one run over all."""
    from ridgecast.plans import area, store

    dem, grid = flat_grid(spark, "cast(1000 + (id * 7919) % 260 as double)")
    schema = "site string, type string, r int, c int, site_elev double"
    old = [("A", "digi", 15, 15, 1110.0), ("B", "igate", 4, 25, 1150.0)]
    base = (125.0, 144.39, 0.0, 60.0, 0.25, 10.0, 10.0, 2.0, 24, 30, 6.0, 6000.0)
    jobs = [(1, *base), (2, 110.0, *base[1:])]
    path = str(tmp_path / "store")
    run = lambda sites, profiles: (spark.createDataFrame(sites, schema), spark.createDataFrame(profiles, area.PROFILE))
    read = lambda df: {(r.site, r.profile_id, r.r, r.c): round(r.margin_db, 9) for r in df.collect()}
    sites, profiles = run(old, jobs)
    assert read(store.stored_grids(sites, profiles, grid, path)) == read(area.scenario_grids(sites, profiles, grid)) and store.missing_grids(sites, profiles, path).count() == 0
    new = [old[0], ("B", "igate", 5, 25, 1150.0), ("C", "digi", 20, 8, 1040.0)]
    sites, profiles = run(new, [jobs[0], (7, 100.0, *base[1:])])
    assert sorted((r.site, r.profile_id) for r in store.missing_grids(sites, profiles, path).collect()) == [("A", 7), ("B", 1), ("B", 7), ("C", 1), ("C", 7)]
    (tmp_path / "store" / "cells" / "profile=stray").mkdir()
    assert read(store.stored_grids(sites, profiles, grid, path)) == read(area.scenario_grids(sites, profiles, grid))
    batches = sorted(r["count"] for r in spark.read.parquet(f"{path}/done").groupBy("batch").count().collect())
    assert batches == [4, 5]
    assert read(store.stored_grids(*run(old, jobs), grid, path)) == read(area.scenario_grids(*run(old, jobs), grid))
    assert store.stored_grids(*run(old, []), grid, path).count() == 0


def test_pit_check_equals_brute_force_without_pairs(spark):
    """Holes, cells of several rows, sites outside the grid and on block edges; no neighbour is a row, so nothing many times the sites' size is broadcast or shuffled."""
    rng = random.Random(4)
    cells = [(r, c, None if rng.random() < 0.2 else float(rng.randrange(900, 1100))) for r in range(58, 75) for c in range(60, 70)] + [(63, 64, 5000.5), (64, 64, None), (64, 63, -900.0)]
    sites = [(f"S{r}-{c}", r, c) for r in range(55, 78) for c in range(57, 73)] + [("none", None, 64)]
    dem, places = spark.createDataFrame(cells, "r int, c int, elev_m double"), spark.createDataFrame(sites, "site string, r int, c int")
    want = {}
    for site, r, c in sites[:-1]:
        near = [(y == r and x == c, e) for y, x, e in cells if abs(y - r) <= 2 and abs(x - c) <= 2]
        own, others = [e for centre, e in near if centre and e is not None], sorted(e for centre, e in near if not centre and e is not None)
        if near:
            want[site] = (max(own, default=None), len(others), float(np.median(others)) if others else None)
    found = terrain.pit_check(places, dem)
    assert {r.site: (r.elev_m, r.neighbours, r.median_m) for r in found.collect()} == want and 200 < len(want) < len(sites)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_sites_on_one_cell_share_one_grid(spark):
    """A grid is made once for each cell and kind of antenna, in rows of bounded length, and counts for every site that stands there."""
    from ridgecast.plans import area

    dem, grid = flat_grid(spark, "cast(1000 + (id * 7919) % 260 as double)")
    rows = [(k, ("digi", "igate", None)[k % 3], 15, 15, 1110.0) for k in range(9)] + [(20, "digi", 0, 29, 1050.0), (21, "igate", 29, 3, 1001.0)]
    sites = spark.createDataFrame(rows, "site int, type string, r int, c int, site_elev double")
    g = rays.Geometry(36, 40, 9.0, 9000.0)
    heights = {"digi_height": 300.0, "igate_height": 4.0, "target_height": 2.0}
    jobs = area.one_profile(sites, g, 125.0, 144.39, **heights)
    jobs = jobs.unionByName(jobs.withColumns({"profile_id": F.lit(1).cast("long"), "floor_db": F.lit(12.0)})).unionByName(jobs.withColumn("profile_id", F.lit(2).cast("long")))
    made = area.stand_grids(area.with_stands(sites), jobs, grid).collect()
    assert len({(r.stand, r.kind, r.profile_id) for r in made}) == len(made) == 4 * 3 and all(len(r.cells) <= area.PIECE for r in made)
    cells = [tuple(r) for r in area.scenario_grids(sites, jobs, grid).collect()]
    of = lambda site, job: {x[2:] for x in cells if x[:2] == (site, job)}
    assert of(0, 0) == of(3, 0) == of(6, 2) != of(1, 0) and of(1, 0) == of(2, 0) == of(8, 0) and of(0, 1) != of(0, 0)
    alone = {s: {tuple(x)[1:] for x in area.scenario_grids(sites.filter(F.col("site") == s), jobs.filter("profile_id = 0"), grid).drop("profile_id").collect()} for s in (0, 1, 20, 21)}
    assert all(of(s, 0) == alone[s] for s in alone)
    told = {(r.site, r.profile_id): (r.cells, r.best, round(r.total, 6)) for r in area.scenario_stats(sites, jobs, grid).collect()}
    assert told == {(s, p): (len(of(s, p)), max(x[2] for x in of(s, p)), round(sum(x[2] for x in of(s, p)), 6)) for s in {x[0] for x in cells} for p in (0, 1, 2)}
    counts = {(r.r, r.c): r.n_sites for r in area.run_coverage(sites, jobs.filter("profile_id = 0"), grid, "fspl_los").collect()}
    assert counts == {(r.r, r.c): r.n_sites for r in area.merged_coverage(area.scenario_grids(sites, jobs.filter("profile_id = 0"), grid)).collect()} and max(counts.values()) >= 9


def test_a_grid_without_cells_is_told(spark):
    """A profile whose highest margin lies under its floor leaves no cell; its sites are told with none, and grids keep all of theirs."""
    from ridgecast.plans import area

    dem, grid = flat_grid(spark)
    sites = spark.createDataFrame([("A", "digi", 15, 15, 1000.0), ("B", "igate", 15, 15, 1000.0), ("C", "digi", 15, 15, 1000.0)], "site string, type string, r int, c int, site_elev double")
    g = rays.Geometry(36, 40, 9.0, 9000.0)
    jobs = area.one_profile(sites, g, 125.0, 144.39).unionByName(area.one_profile(sites, g, 0.0, 144.39, floor_db=12.0, max_db=10.0).withColumn("profile_id", F.lit(1).cast("long")))
    cells = area.scenario_grids(sites, jobs, grid)
    n = {(r.site, r.profile_id): r["count"] for r in cells.groupBy("site", "profile_id").count().collect()}
    assert set(n) == {("A", 0), ("B", 0), ("C", 0)}
    told = {(r.site, r.profile_id): (r.cells, r.best is None, r.total == 0) for r in area.scenario_stats(sites, jobs, grid).collect()}
    assert told == {(s, 0): (n[s, 0], False, False) for s in "ABC"} | {(s, 1): (0, True, True) for s in "ABC"}
    assert area.scenario_stats(sites, jobs.limit(0), grid).count() == 0
    rounded = {tuple(r) for r in area.scenario_grids(sites, jobs, grid, digits=6).collect()}
    assert rounded == {tuple(r) for r in cells.withColumn("margin_db", F.round("margin_db", 6)).collect()} and len(rounded) == sum(n.values())


def _over(spark, tmp_path, n):
    """The tables that the views need, events n times as long."""
    from ridgecast.fixtures import VIEWS

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    for table in {table for table, _ in VIEWS.values()}:
        rows = spark.read.parquet(f"{data}/{table}.parquet")
        if table == "events":
            size = rows.agg(F.max("event_id")).first()[0] + 1
            rows = rows.join(spark.range(n).withColumnRenamed("id", "__k")).withColumn("event_id", F.col("event_id") + F.col("__k") * size).drop("__k")
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_bounded_resample_of_a_narrow_grid(spark, tmp_path):
    """A grid more than fifty times as long as wide in target cells has no whole column, as in its SQL; the operator keeps one unless told otherwise."""
    from ridgecast import queries

    path = _over(spark, tmp_path, 510)
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    want = duck.sql(queries.oracle_sql()["bounded_resample"]).fetchall()
    assert sorted(one(queries.queries()["bounded_resample"](spark, path))) == sorted(want) == []
    dem = spark.range(300).selectExpr("cast(id as int) r", "0 c", "cast(id as double) elev_m")
    assert terrain.bounded_resample(dem, 300, 1, 50).count() == 50 and terrain.bounded_resample(dem, 300, 1, 50, least=0).count() == 0


def test_shared_grids_are_told_once_for_each_site(spark):
    """What is told of a grid is told before its calls share it: the join has a row for each call, not for each cell of each call."""
    from ridgecast import queries
    from ridgecast.queries import SQL

    assert "share_canonical" in SQL
    plan = queries.queries()["share_canonical"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert plan[0].startswith("Project") and "Join" in plan[1]


def test_packet_lines_are_made_once(spark):
    """Conditions on a line do not make it again: what it comes from is mentioned once in the plan of each pass."""
    rows = spark.range(40).selectExpr("concat('U', id, '>APRS,D1*,qAR,G', id % 3, ':!4030.10N/11200.20W', if(id % 5 = 0, '#', '>'), 'c') as raw").union(spark.createDataFrame([("# x",), ("  ",), (None,)], "raw string"))
    rows = rows.withColumn("raw", F.concat("raw", F.lit("MADE")))
    lines = packets.packet_lines(rows)
    assert lines.columns == ["raw"] and lines.count() == 41
    for found, n in ((packets.packet_positions(lines), 40), (packets.packet_roles(lines), 80)):
        assert found.count() == n
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MADE") <= 2
    left = catalog.unresolved_calls(packets.packet_roles(lines).select("call", "role").union(catalog.symbol_roles(packets.packet_positions(lines))), packets.packet_positions(lines))
    assert {r.call for r in left.collect()} == {"D1", "G0", "G1", "G2"}


def test_profiles_shuffle_no_points(spark):
    """Profiles by squares of sites against points held against cells one by one, with holes, sites off the grid and on square edges, ground without an elevation, and rays far longer than a square."""
    rng = random.Random(3)
    height, width = 70, 90
    cells = {(r, c): None if rng.random() < 0.15 else float(rng.randrange(800, 1300)) for r in range(height) for c in range(width) if (r, c) != (20, 20)}
    dem = spark.createDataFrame([(r, c, e) for (r, c), e in cells.items()] + [(height + 3, 5, 1.0)], "r int, c int, elev_m double")
    places = [(f"S{k}", rng.randrange(-4, height + 4), rng.randrange(-4, width + 4), None if k % 9 == 0 else 1000.0 + k) for k in range(40)] + [("edge", 64, 64, 5.0), ("corner", 0, 0, 6.0), ("none", None, 1, 7.0)]
    sites = spark.createDataFrame(places, "site string, r int, c int, site_elev double")
    for n, points, radius in ((5, 7, 5.3), (3, 40, 37.0)):
        want = {}
        for site, r, c, ground in places[:-1]:
            for radial in range(n):
                turn, last, ray = math.radians(radial * 360.0 / n), ground, {}
                for k in range(1, points + 1):
                    row, col = (round(x, 9) for x in (r - k / points * radius * math.cos(turn), c + k / points * radius * math.sin(turn)))
                    if not (0 <= row <= height - 1 and 0 <= col <= width - 1):
                        continue
                    i, j = min(int(row), height - 2), min(int(col), width - 2)
                    four = [cells.get((i + a, j + b)) for a in (0, 1) for b in (0, 1)]
                    if None not in four:
                        y, x = row - i, col - j
                        last = (1 - y) * ((1 - x) * four[0] + x * four[1]) + y * ((1 - x) * four[2] + x * four[3])
                    ray[site, radial, k] = (round(row, 6), round(col, 6), None if last is None else round(last, 6))
                if ray and max(k for _, _, k in ray) / points * radius * 40 >= 100:
                    want |= ray
        made = terrain.profiles(sites, dem, height, width, n, points, radius, radius * 40)
        got = {(x.site, x.radial, x.k): (round(x.row, 6) + 0.0, round(x.col, 6) + 0.0, None if x.elev_m is None else round(x.elev_m, 6)) for x in made.collect()}
        assert got.keys() == want.keys() and len(want) > 300
        assert all(abs(a - b) < 2e-6 if a is not None and b is not None else a is b for k in want for a, b in zip(want[k], got[k]))
        assert made.columns == ["site", "radial", "k", "dist_m", "row", "col", "site_elev", "elev_m"] and "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
