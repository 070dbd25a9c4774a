"""Spatial joins as equi-joins on bins: within-distance pairs, k nearest, polygon against box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from emberline import config as C
from emberline.functions import exprs as X
from emberline.session import reliable_cut

METRICS = {"euclid": X.euclid_degrees, "manhattan": X.manhattan_degrees}

# Nearest-neighbour bins: the leaf is 2**-14 degree, finer than the 4 decimals of the station and fire formats, and each
# level doubles it up to 512 degrees, wider than the globe.
LEAF_EXPONENT = 14
LEVELS = 24
AROUND_BINS = 25
QUERY_BYTES = 80

# Points of a bin that is searched whole; a larger one is cut into parts, each with a UNIT_FAN-th of its points at most.
UNIT_POINTS, UNIT_FAN = 256, 256

BIN_BYTES = 32
BROADCAST_BYTES = 64 * 1024 * 1024

# Rows of one bin beyond which it is split over several join keys.
SPLIT_ROWS = 20_000
# The same for either side of a join that keeps most of its candidate pairs: a key yields at most some 4 million.
PAIR_ROWS = 2_000
# Candidate pairs of a task of such a join.
TASK_PAIRS = PAIR_ROWS * PAIR_ROWS


def _bin(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("int")


def _count_pairs(left: DataFrame, right: DataFrame) -> int:
    """Pairs of rows that share a bin."""
    sides = [df.groupBy("by", "bx").agg(F.count("*").alias(n)) for df, n in ((left, "n_left"), (right, "n_right"))]
    pairs = F.col("n_left").cast("double") * F.col("n_right")
    return int(sides[0].join(sides[1], ["by", "bx"]).agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("n")).first().n)


def bin_join(
    left: DataFrame,
    right: DataFrame,
    lat_reach: Column,
    lon_reach: Column,
    lat_bin: float,
    lon_bin: float,
    split_rows: int | None = SPLIT_ROWS,
    small_right: bool = False,
    split_left: int | None = None,
) -> DataFrame:
    """Candidate pairs (l, r) of two point tables: every pair within the left row's reach is among them, once.

    Both tables have latitude / longitude columns ``lat`` and ``lon``, in structs ``l`` and ``r`` of the result. The left
    row is copied to each bin its reach touches; the right row stays in its own bin. A bin holding more than
    ``split_rows`` right rows is cut into parts by a hash of the row, and the left rows of that bin are copied to
    each part, so no join key ever holds more than about ``split_rows`` right rows. ``None`` skips the cutting, for a right
    side whose density is bounded by its construction; ``small_right`` broadcasts a right side whose size the caller has
    checked. With ``split_left`` the left rows of a bin are cut likewise, and its right rows copied to each part, so a join key yields at most
    about ``split_left * split_rows`` pairs. The candidate pairs are then counted from the bins, in a job of its own, and the join gets a task
    for every TASK_PAIRS of them: the points are few bytes, by which Spark would leave the pairs of all bins to one task or a few.
    """
    right_binned = right.select(
        _bin(F.col("lat"), lat_bin).alias("by"),
        _bin(F.col("lon"), lon_bin).alias("bx"),
        F.struct("*").alias("r"),
    )
    left_binned = left.select(
        F.struct("*").alias("l"),
        F.explode(
            F.sequence(_bin(F.col("lat") - lat_reach, lat_bin), _bin(F.col("lat") + lat_reach, lat_bin))
        ).alias("by"),
        _bin(F.col("lon") - lon_reach, lon_bin).alias("_bx_lo"),
        _bin(F.col("lon") + lon_reach, lon_bin).alias("_bx_hi"),
    ).select("l", "by", F.explode(F.sequence("_bx_lo", "_bx_hi")).alias("bx"))
    if split_rows is None:
        right_side = F.broadcast(right_binned) if small_right else right_binned
        return left_binned.join(right_side, ["by", "bx"]).select("l", "r")
    few_bins = (180.0 / lat_bin + 1) * (360.0 / lon_bin + 1) * BIN_BYTES <= BROADCAST_BYTES

    def parts_of(rows: DataFrame, most: int, name: str) -> DataFrame:
        """The crowded bins and their number of parts."""
        crowded = (
            rows.groupBy("by", "bx")
            .agg(F.count("*").alias("_n"))
            .filter(F.col("_n") > most)
            .select("by", "bx", F.ceil(F.col("_n") / F.lit(most)).cast("int").alias(name))
        )
        # One row per crowded bin: the globe has a fixed number of bins, which proves when this table is small. Rows then learn
        # their parts where they are, before any shuffle by bin.
        return F.broadcast(crowded) if few_bins else crowded

    def cut(rows: DataFrame, crowded: DataFrame, name: str, side: str, key: str, own: bool) -> DataFrame:
        """Rows in their own part (by a hash of the row), or copied to all parts of their bin."""
        n = F.coalesce(name, F.lit(1))
        part = F.pmod(F.xxhash64(side), n).cast("int") if own else F.explode(F.sequence(F.lit(0), n - 1))
        kept = [c for c in rows.columns if c != side]
        return rows.join(crowded, ["by", "bx"], "left").select(*kept, part.alias(key), side)

    keys = ["by", "bx", "part"]
    crowded = parts_of(right_binned, split_rows, "_parts")
    right_keyed = cut(right_binned, crowded, "_parts", "r", "part", own=True)
    left_keyed = cut(left_binned, crowded, "_parts", "l", "part", own=False)
    if split_left is not None:
        crowded_left = parts_of(left_binned, split_left, "_left_parts")
        left_keyed = cut(left_keyed, crowded_left, "_left_parts", "l", "left_part", own=True)
        right_keyed = cut(right_keyed, crowded_left, "_left_parts", "r", "left_part", own=False)
        keys.append("left_part")
        # Spark deals both sides anew where they have fewer tasks than its own shuffles.
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(_count_pairs(left_binned, right_binned) / TASK_PAIRS))
        left_keyed, right_keyed = left_keyed.repartition(tasks, *keys), right_keyed.repartition(tasks, *keys).hint("shuffle_hash")
    return left_keyed.join(right_keyed, keys).select("l", "r")


def pairs_within(stations: DataFrame, limit_km: float = C.PAIR_LIMIT_KM) -> DataFrame:
    """All ordered pairs of different stations closer than ``limit_km`` by degree distance. Dense bins are cut on both sides, so that no
    join key yields more than some PAIR_ROWS squared pairs and the output is spread over tasks as it grows."""
    points = stations.select("station_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    reach = limit_km / C.KM_PER_DEGREE
    pairs = bin_join(points, points, F.lit(reach), F.lit(reach), reach, reach, split_rows=PAIR_ROWS, split_left=PAIR_ROWS)
    distance = X.euclid_degrees(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon")) * F.lit(C.KM_PER_DEGREE)
    return (
        pairs.filter(F.col("l.station_id") != F.col("r.station_id"))
        .select(
            F.col("l.station_id").alias("station_1"), F.col("r.station_id").alias("station_2"), distance.alias("distance_km")
        )
        .filter(F.col("distance_km") < limit_km)
    )


def _boxed(df: DataFrame, metric: str) -> DataFrame:
    """Candidate bins with the least and the greatest distance that a point of theirs can have from the query."""
    distance_of, lat, lon = METRICS[metric], F.col("query_lat"), F.col("query_lon")
    width = F.pow(F.lit(2.0), F.col("lvl") - LEAF_EXPONENT)
    south, west = F.col("by") * width, F.col("bx") * width

    def nearer(at, low):
        return F.greatest(low, F.least(at, low + width))

    def farther(at, low):
        return F.when(at - low > low + width - at, low).otherwise(low + width)

    return df.withColumns(
        {
            "d_min": distance_of(lat, lon, nearer(lat, south), nearer(lon, west)),
            "d_max": distance_of(lat, lon, farther(lat, south), farther(lon, west)),
        }
    )


def _within_bound(candidates: DataFrame, need: int, metric: str) -> DataFrame:
    """The candidate bins that may hold one of a query's ``need`` nearest. The bins whose far ends are nearest, up to ``need`` points, bound
    the distance of the last one from above; bins that begin beyond it drop out. The bound has a margin for distances that round to a tie."""
    far = Window.partitionBy("query_lat", "query_lon").orderBy("d_max", "lvl", "by", "bx")
    query = Window.partitionBy("query_lat", "query_lon")
    return (
        _boxed(candidates, metric)
        .withColumn("_upto", F.sum("n").over(far.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_bound", F.min(F.when(F.col("_upto") >= need, F.col("d_max"))).over(query))
        .filter(F.col("_bound").isNull() | (F.col("d_min") <= F.col("_bound") + 1e-8))
        .select("query_lat", "query_lon", "lvl", "by", "bx", "n")
    )


def _cut_up(crowded: DataFrame, nodes: DataFrame, unit: int, fan: int) -> DataFrame:
    """The parts (lvl, by, bx, n) of each crowded bin (root_lvl, root_by, root_bx): its largest bins below with at most ``unit`` points or
    a ``fan``-th of its own. They are some four to ``fan`` times as many, whatever the bin holds."""
    roots = crowded.select(F.col("lvl").alias("root_lvl"), F.col("by").alias("root_by"), F.col("bx").alias("root_bx"), F.col("n").alias("root_n")).distinct()
    # At most LEVELS small integers.
    levels = F.lit(sorted(r.root_lvl for r in roots.select("root_lvl").distinct().collect())).cast("array<int>")
    up = lambda c: F.expr(f"shiftright({c}, root_lvl - lvl)")
    parent = nodes.select((F.col("lvl") - 1).alias("lvl"), F.col("by").alias("_py"), F.col("bx").alias("_px"), F.col("n").alias("parent_n"))
    below = nodes.withColumns({"_py": F.shiftright("by", 1), "_px": F.shiftright("bx", 1)}).join(parent, ["lvl", "_py", "_px"])
    most = F.greatest(F.lit(unit), F.expr(f"root_n div {fan}"))
    return (
        below.withColumn("root_lvl", F.explode(F.filter(levels, lambda v: v > F.col("lvl"))))
        .withColumns({"root_by": up("by"), "root_bx": up("bx")})
        .join(roots, ["root_lvl", "root_by", "root_bx"])
        .filter((F.col("parent_n") > most) & ((F.col("n") <= most) | (F.col("lvl") == 0)))
        .select("root_lvl", "root_by", "root_bx", "lvl", "by", "bx", "n")
    )


def nearest_k(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    metric: str = "euclid",
    skip_self: bool = False,
    query_bound: int | None = None,
    unit: int = UNIT_POINTS,
    fan: int = UNIT_FAN,
) -> DataFrame:
    """The k nearest points of every query by a degree metric: (query, point, degrees, rank).

    Both tables have columns ``id``, ``lat``, ``lon``; the results are structs. Ties (distances equal to nine decimals)
    go to the lower point id. ``skip_self`` leaves out the point with the query's own id.

    How it stays local. Points are counted in square bins of doubling size. A query looks for the smallest bin around
    itself that holds k points: its k nearest then lie within two bin widths, so the 5 x 5 bins around it hold all of
    them. The counts of those bins bound the k-th distance, and bins that begin beyond the bound drop out. A bin that is left with more than
    ``unit`` points - a dense cluster beside the query - is cut into parts with a ``fan``-th of its points each at most, the bound is drawn
    tighter with the parts' counts, and so on until all bins are small: every round divides a cluster by ``fan``. Only the bins left are
    joined with points. Dense areas thereby use small bins and empty areas large ones, no query meets all points of a cluster,
    and no bin holds more than ``unit`` of them, except leaf bins, which are finer than the coordinates of the formats. Points at one
    and the same place are cut to the lowest k ids first, which cannot change a result; and the search runs once per place, however many
    queries stand there: its answer, a list of at most k + 1 points, is then joined to them by a key that is unique on its side.

    ``query_bound`` is a proven limit on the number of queries. When it is small, and no bin is crowded, the queries' bins are broadcast, and
    points far from all queries drop out where they are read. Counts and bins are stored, so this runs when it is called.
    """
    need = k + 1 if skip_self else k
    distance_of = METRICS[metric]
    scale = F.lit(float(1 << LEAF_EXPONENT))

    def leaf(df):
        return df.withColumns(
            {"iy": F.floor(F.col("lat") * scale).cast("long"), "ix": F.floor(F.col("lon") * scale).cast("long")}
        )

    same_place = Window.partitionBy("lat", "lon").orderBy("id")
    places = leaf(
        points.select("id", "lat", "lon", F.row_number().over(same_place).alias("_n")).filter(F.col("_n") <= need).drop("_n")
    )
    asked = leaf(queries.select("lat", "lon").distinct())

    at_level = [F.expr("shiftright(iy, lvl)").alias("by"), F.expr("shiftright(ix, lvl)").alias("bx")]
    all_levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("lvl")
    few_queries = query_bound is not None and query_bound * AROUND_BINS * QUERY_BYTES <= BROADCAST_BYTES
    nodes = reliable_cut(
        places.select("iy", "ix", all_levels).select("lvl", *at_level).groupBy("lvl", "by", "bx").agg(F.count("*").alias("n")), "bins"
    )
    chosen = (
        asked.select("iy", "ix").distinct().select("iy", "ix", all_levels).select("iy", "ix", "lvl", *at_level)
        .join(nodes.filter(F.col("n") >= need).drop("n"), ["lvl", "by", "bx"])
        .groupBy("iy", "ix")
        .agg(F.min("lvl").alias("lvl"))
    )
    around = F.sequence(F.lit(-2), F.lit(2))
    looking = (
        asked.join(chosen, ["iy", "ix"], "left")
        .withColumn("lvl", F.coalesce("lvl", F.lit(LEVELS - 1)))
        .select("lat", "lon", "lvl", *at_level)
        .withColumn("dy", F.explode(around))
        .withColumn("dx", F.explode(around))
        .select(
            F.col("lat").alias("query_lat"),
            F.col("lon").alias("query_lon"),
            "lvl",
            (F.col("by") + F.col("dy")).alias("by"),
            (F.col("bx") + F.col("dx")).alias("bx"),
        )
    )
    candidates = reliable_cut(_within_bound(looking.join(nodes, ["lvl", "by", "bx"]), need, metric), "near-bins")
    is_crowded = (F.col("n") > unit) & (F.col("lvl") > 0)
    while not candidates.filter(is_crowded).isEmpty():
        few_queries = False
        crowded = candidates.filter(is_crowded)
        parts = _cut_up(crowded, nodes, unit, fan)
        roots = crowded.select(
            "query_lat", "query_lon", F.col("lvl").alias("root_lvl"), F.col("by").alias("root_by"), F.col("bx").alias("root_bx")
        )
        opened = roots.join(parts, ["root_lvl", "root_by", "root_bx"]).select(candidates.columns)
        candidates = reliable_cut(_within_bound(candidates.filter(~is_crowded).unionByName(opened), need, metric), "near-bins")
    # Points enter only the levels some query uses: a set of at most LEVELS small integers.
    used = F.lit(sorted(r.lvl for r in candidates.select("lvl").distinct().collect())).cast("array<int>")
    offered = places.withColumn("lvl", F.explode(used)).select(
        F.struct("id", "lat", "lon").alias("p"), "lvl", *at_level
    )
    candidates = candidates.drop("n")
    degrees = F.round(distance_of(F.col("query_lat"), F.col("query_lon"), F.col("p.lat"), F.col("p.lon")), 9)
    order = Window.partitionBy("query_lat", "query_lon").orderBy("degrees", "point_id")
    answers = (
        offered.join(F.broadcast(candidates) if few_queries else candidates, ["lvl", "by", "bx"])
        .select(
            "query_lat",
            "query_lon",
            degrees.alias("degrees"),
            F.col("p.id").alias("point_id"),
            F.col("p.lat").alias("point_lat"),
            F.col("p.lon").alias("point_lon"),
        )
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= need)
        .groupBy("query_lat", "query_lon")
        .agg(F.sort_array(F.collect_list(F.struct("degrees", "point_id", "point_lat", "point_lon"))).alias("found"))
    )
    own = F.filter("found", lambda p: p["point_id"] != F.col("id")) if skip_self else F.col("found")
    return (
        queries.select("id", F.col("lat").alias("query_lat"), F.col("lon").alias("query_lon"))
        .join(F.broadcast(answers) if few_queries else answers, ["query_lat", "query_lon"])
        .select(F.col("id").alias("query_id"), "query_lat", "query_lon", F.posexplode(F.slice(own, 1, k)).alias("pos", "p"))
        .select(
            "query_id",
            "p.point_id",
            "p.degrees",
            "query_lat",
            "query_lon",
            "p.point_lat",
            "p.point_lon",
            (F.col("pos") + 1).alias("rank"),
        )
    )


def station_neighbors(
    stations: DataFrame, k: int = C.NEIGHBORS_PER_STATION, limit_km: float = C.PAIR_LIMIT_KM
) -> DataFrame:
    """The k nearest stations of each station among those closer than ``limit_km``, ranked."""
    points = stations.select(
        F.col("station_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )
    found = nearest_k(points, points, k, "euclid", skip_self=True)
    km = X.euclid_degrees(F.col("query_lat"), F.col("query_lon"), F.col("point_lat"), F.col("point_lon")) * F.lit(
        C.KM_PER_DEGREE
    )
    return found.select(
        F.col("query_id").alias("station_id"), F.col("point_id").alias("neighbor_id"), km.alias("distance_km"), "rank"
    ).filter(F.col("distance_km") < limit_km)


def cell_neighbors(
    targets: DataFrame, cells: DataFrame, k: int = C.CELL_NEIGHBORS, target_bound: int | None = None
) -> DataFrame:
    """The k nearest cells of each target cell by summed degree differences, over all terrains."""
    def points(df):
        return df.select(F.col("cell_id").alias("id"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))

    return nearest_k(points(targets), points(cells), k, "manhattan", True, target_bound).select(
        F.col("query_id").alias("cell_id"), F.col("point_id").alias("neighbor_id"), "degrees", "rank"
    )


# --- polygons ----------------------------------------------------------------------------------------------------

def wkt_rings(wkt: Column) -> Column:
    """All rings of a polygon or multi-polygon text as arrays of (x, y) points."""
    def point(text):
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(xy[0].try_cast("double").alias("x"), F.try_element_at(xy, F.lit(2)).try_cast("double").alias("y"))

    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)
    return F.transform(rings, lambda ring: F.transform(F.split(ring, ","), point))


def _edges(ring: Column) -> Column:
    """Consecutive point pairs of one ring."""
    return F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1),
        F.slice(ring, 2, F.size(ring) - 1),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def polygon_meets_box(wkt: Column | str, bounds: C.Bounds = C.SOUTHERN_CANADA) -> Column:
    """Whether a polygon shares a point with the box.

    True when some edge meets the box, or else when the box lies inside the shape: then its corner has an odd number of
    edges to its right, which also handles holes and several parts. One expression per row: no shuffle, and a shape of
    any number of points is handled whole.
    """
    text = F.col(wkt) if isinstance(wkt, str) else wkt
    west, east, south, north = (F.lit(v) for v in (bounds.lon_min, bounds.lon_max, bounds.lat_min, bounds.lat_max))
    edges = F.flatten(F.transform(wkt_rings(text), _edges))

    def meets(e):
        overlap = (
            (F.greatest(e["x1"], e["x2"]) >= west)
            & (F.least(e["x1"], e["x2"]) <= east)
            & (F.greatest(e["y1"], e["y2"]) >= south)
            & (F.least(e["y1"], e["y2"]) <= north)
        )
        sides = [
            (e["x2"] - e["x1"]) * (cy - e["y1"]) - (e["y2"] - e["y1"]) * (cx - e["x1"])
            for cx, cy in ((west, south), (west, north), (east, south), (east, north))
        ]
        return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    def right_of_corner(e):
        spans = (e["y1"] > south) != (e["y2"] > south)
        # Null for a level edge, which spans nothing.
        cross_x = e["x1"] + F.try_divide((south - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return spans & (cross_x > west)

    crossings = F.size(F.filter(edges, right_of_corner))
    return F.coalesce(F.exists(edges, meets), F.lit(False)) | (F.pmod(crossings, F.lit(2)) == 1)


def envelope_center(wkt: Column | str) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a geometry's envelope (optional coordinates for polygon reports)."""
    points = F.flatten(wkt_rings(F.col(wkt) if isinstance(wkt, str) else wkt))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return (F.array_min(ys) + F.array_max(ys)) / 2, (F.array_min(xs) + F.array_max(xs)) / 2
