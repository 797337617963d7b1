"""Entity resolution: identity links, radius links, connected components, group keys and their audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cohera.functions.numeric import EARTH_RADIUS_KM, haversine_km
from cohera.operators.joins import KM_PER_DEGREE
from cohera.session import release, settle


def star_edges(df: DataFrame, id_col: str, code: Column, rule: str) -> DataFrame:
    """Edges from the smallest id of each code to the other ids: as many edges as rows, never all pairs."""
    rows = df.select(F.col(id_col).alias("dst"), code.alias("_code")).where(F.col("_code").isNotNull())
    hub = rows.groupBy("_code").agg(F.min("dst").alias("src"))
    return rows.join(hub, "_code").where(F.col("src") != F.col("dst")).select("src", "dst", F.lit(rule).alias("rule"))


def identity_links(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """Union of the star edges of several equality rules (a rule gives null where it does not apply)."""
    codes = F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("string").alias("code")) for n, c in rules.items()]), lambda e: e["code"].isNotNull())
    # the rows are read once; what is settled is one short code per row and rule
    rows = settle(df.select(F.col(id_col).alias("dst"), F.explode(codes).alias("e")).select("dst", "e.rule", "e.code"))
    hub = rows.groupBy("rule", "code").agg(F.min("dst").alias("src"), F.count(F.lit(1)).alias("n"))
    linked = rows.join(hub.where("n > 1"), ["rule", "code"]).where("src <> dst")
    return linked.select("src", "dst", "rule")


def link_report(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rule").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("src").alias("sets"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node in ``edges`` (src, dst), labelled by its smallest member. Output: node, component.

    Alternating large-star and small-star steps until a count with a hash sum tells that nothing changes any more. A
    round is two grouped minima with their joins; it is written to the checkpoint folder, and the round before is freed.
    """
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    e, mark = _settle_marked(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low2, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low2.select(F.col("m").alias("a"), "b"))
        before = e
        e, new_mark = _settle_marked(small.where("a <> b").distinct())
        release(before)
        if new_mark == mark:
            break
        mark = new_mark
    hubs = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(hubs)


def _settle_marked(e: DataFrame):
    e = settle(e)
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return e, (r.n, r.h)


def attach_components(df: DataFrame, node: str, comps: DataFrame, prefix: str, out: str) -> DataFrame:
    """Group key per row: prefix + component label; nodes without an edge are their own component."""
    j = df.join(comps.withColumnRenamed("node", node), node, "left")
    label = F.coalesce(F.col("component").cast("string"), F.col(node).cast("string"))
    return j.withColumn(out, F.concat(F.lit(prefix), label)).drop("component")


def bipartite_components(df: DataFrame, left: str, right: str) -> DataFrame:
    """Components of the graph (left value) - (right value); label = smallest left value. Output: left, component."""
    pairs = df.select(F.concat(F.lit("L:"), F.col(left).cast("string")).alias("src"), F.concat(F.lit("R:"), F.col(right).cast("string")).alias("dst")).distinct()
    comps = connected_components(pairs)
    return comps.where(F.col("node").startswith("L:")).select(F.expr("substring(node, 3)").alias(left), F.expr("substring(component, 3)").alias("component"))


def override_edges(names: DataFrame, merges: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """Edges of a manual merge list and the listed names that do not exist. ``names``: one column ``name``."""
    spark = names.sparkSession
    flat = [(g[0], n) for g in merges for n in g]
    listed = spark.createDataFrame(flat, "src string, dst string")
    known = names.select(F.col("name").alias("dst")).distinct()
    missing = listed.join(known, "dst", "left_anti").select(F.col("dst").alias("name")).distinct()
    edges = listed.join(known, "dst", "left_semi").where("src <> dst").select("src", "dst", F.lit("merge").alias("rule"))
    return edges, missing


# ---------------------------------------------------------------- radius links
BOUND = 1e-9  # relative: computed bounds may be this far from the true ones


def radius_links(df: DataFrame, node: str, lat: str, lon: str, km: float) -> DataFrame:
    """Links that give the same components as all pairs of points within ``km``, without making all pairs.

    Points are put into small squares of diagonal at most km / 4. (1) Points of a square are linked to its smallest
    node. (2) Two squares that lie within km / 2 as a whole are linked by their smallest nodes. The components so far stand
    for their links: one link from each node to its component. (3) Two components with squares that lie within km as a
    whole are linked once. (4) Squares that may or may not hold a close pair are compared point by point, but only if
    (1) to (3) did not link their components. Output: src, dst.
    """
    side = km / 4 / math.sqrt(2)
    pts = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(node).cast("string").alias("node"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
    step = side / KM_PER_DEGREE
    band = F.floor((F.col("lat") + 90) / step).cast("long")
    near_equator = F.least(F.abs(F.col("_b") * step - 90), F.abs((F.col("_b") + 1) * step - 90))
    straddles = (F.col("_b") * step - 90 < 0) & ((F.col("_b") + 1) * step - 90 > 0)
    widest = F.when(straddles, F.lit(1.0)).otherwise(F.cos(F.radians(near_equator)))  # cosine where the band is widest
    n_cells = F.ceil(F.lit(360.0) * widest / F.lit(step))
    pts = pts.withColumn("_b", band).withColumn("_n", F.greatest(F.lit(1.0), n_cells))
    cell = F.least(F.floor((F.col("lon") + 180) / (F.lit(360.0) / F.col("_n"))), F.col("_n") - 1).cast("long")
    pts = pts.withColumn("_c", cell)
    squares = pts.groupBy("_b", "_c").agg(
        F.min("node").alias("hub"), F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    inner = pts.join(squares.select("_b", "_c", "hub"), ["_b", "_c"]).where(F.col("node") != F.col("hub")).select(
        F.col("hub").alias("src"), F.col("node").alias("dst")).distinct()
    pairs = settle(_square_pairs(squares, km))
    hubs = lambda df: df.select(F.col("hub_a").alias("src"), F.col("hub_b").alias("dst")).where("src <> dst")
    links = settle(inner.unionByName(hubs(pairs.where("half"))).distinct())
    rest = pairs.where("NOT half")
    if links.limit(1).count():
        comps = settle(connected_components(links))
        links = comps.where("node <> component").select(F.col("component").alias("src"), F.col("node").alias("dst"))
        for s in "ab":
            c = comps.select(F.col("node").alias(f"hub_{s}"), F.col("component").alias(f"comp_{s}"))
            rest = rest.join(c, f"hub_{s}", "left").withColumn(f"hub_{s}", F.coalesce(f"comp_{s}", f"hub_{s}")).drop(f"comp_{s}")
    rest = settle(rest.where(F.col("hub_a") != F.col("hub_b")).withColumns({"hub_a": F.least("hub_a", "hub_b"), "hub_b": F.greatest("hub_a", "hub_b")}))
    sure = settle(hubs(rest.where("sure")).distinct())
    links = links.unionByName(sure)
    open_ = rest.where("NOT sure").join(sure.toDF("hub_a", "hub_b"), ["hub_a", "hub_b"], "left_anti")
    pa = pts.select(F.col("_b").alias("b_a"), F.col("_c").alias("c_a"), F.col("node").alias("src"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    pb = pts.select(F.col("_b").alias("b_b"), F.col("_c").alias("c_b"), F.col("node").alias("dst"), F.col("lat").alias("lb"), F.col("lon").alias("lob"))
    near = open_.select("b_a", "c_a", "b_b", "c_b").join(pa, ["b_a", "c_a"]).join(pb, ["b_b", "c_b"])
    near = near.where(haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("lob")) <= km)
    cross = near.groupBy("b_a", "c_a", "b_b", "c_b").agg(F.min(F.struct("src", "dst")).alias("p")).select("p.src", "p.dst").where("src <> dst")
    return links.unionByName(cross)


def _square_pairs(squares: DataFrame, km: float) -> DataFrame:
    """Pairs of occupied squares that may hold points within km; ``sure``: all their points are, ``half``: within km / 2.

    Candidates come from a coarse grid equi-join (cells of at least km plus a square) on the square's corner. The bounds are
    the least and greatest differences of latitude and longitude, put into the haversine with the least and greatest cosines.
    """
    reach = km * 1.5
    step = reach / KM_PER_DEGREE

    def coarse(band: Column) -> Column:
        far = F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)) + step
        return F.when(far >= 89.0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.floor(F.lit(360.0) * F.cos(F.radians(far)) / F.lit(step))))

    cosines = [F.cos(F.radians(c)) for c in ("s", "t")]
    over = (F.col("s") <= 0) & (F.col("t") >= 0)
    squares = squares.withColumn("cl", F.greatest(F.least(*cosines), F.lit(0.0))).withColumn("ch", F.when(over, 1.0).otherwise(F.greatest(*cosines)))
    sq = squares.withColumn("_kb", F.floor((F.col("s") + 90) / step).cast("long"))
    right = sq.withColumn("_n", coarse(F.col("_kb"))).withColumn("_kc", F.pmod(F.floor((F.col("w") + 180) / (F.lit(360.0) / F.col("_n"))), F.col("_n")).cast("long"))
    right = right.select("_kb", "_kc", *[F.col(c).alias(f"{c.strip('_')}_b") for c in ("_b", "_c", "hub", "s", "t", "w", "e", "cl", "ch")])
    left = sq.withColumn("_kb", F.explode(F.array(F.col("_kb") - 1, F.col("_kb"), F.col("_kb") + 1))).withColumn("_n", coarse(F.col("_kb")))
    own = F.floor((F.col("w") + 180) / (F.lit(360.0) / F.col("_n")))
    left = left.withColumn("_kc", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(own + i, F.col("_n")).cast("long")))))
    left = left.select("_kb", "_kc", *[F.col(c).alias(f"{c.strip('_')}_a") for c in ("_b", "_c", "hub", "s", "t", "w", "e", "cl", "ch")])
    between = lambda low, high: (  # noqa: E731  least and greatest difference of two intervals
        F.greatest(F.lit(0.0), F.col(f"{low}_b") - F.col(f"{high}_a"), F.col(f"{low}_a") - F.col(f"{high}_b")),
        F.greatest(F.col(f"{high}_b") - F.col(f"{low}_a"), F.col(f"{high}_a") - F.col(f"{low}_b")))
    (north0, north1), (east0, east1) = between("s", "t"), between("w", "e")
    around0 = F.least(east0, F.lit(360.0) - east1)
    around1 = F.when(east1 <= 180, east1).when(east0 >= 180, F.lit(360.0) - east0).otherwise(180.0)
    half_sine = lambda c: F.pow(F.sin(F.radians(c) / 2), F.lit(2.0))
    within = lambda d: math.sin(min(d / (2 * EARTH_RADIUS_KM), math.pi / 2)) ** 2
    j = left.join(right, ["_kb", "_kc"]).where((F.struct("b_a", "c_a") < F.struct("b_b", "c_b")) & (north0 <= km / KM_PER_DEGREE * (1 + BOUND)))
    j = j.where(half_sine(north0) + F.col("cl_a") * F.col("cl_b") * half_sine(around0) <= within(km) * (1 + BOUND))
    far = half_sine(north1) + F.col("ch_a") * F.col("ch_b") * half_sine(around1)
    j = j.select("b_a", "c_a", "hub_a", "b_b", "c_b", "hub_b", far.alias("far"))
    return j.withColumn("sure", F.col("far") <= within(km) * (1 - BOUND)).withColumn("half", F.col("far") <= within(km / 2) * (1 - BOUND)).drop("far")


def group_key(df: DataFrame, node: str, lat: str, lon: str, km: float | None, prefix: str, out: str, extra: DataFrame | None = None) -> DataFrame:
    """Group key at radius km (None: no spatial link) with extra edges (identity links, manual merges)."""
    edges = radius_links(df, node, lat, lon, km) if km is not None else None
    if extra is not None:
        x = extra.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        edges = x if edges is None else edges.unionByName(x)
    named = df.withColumn(node, F.col(node).cast("string"))
    return attach_components(named, node, connected_components(edges), prefix, out)


# ---------------------------------------------------------------- audits
def audit_table(df: DataFrame, keys: list[str], lat: str, lon: str, reasons: dict[str, Column]) -> DataFrame:
    text = F.concat_ws("; ", *[F.when(c, F.lit(t)) for t, c in reasons.items()])
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(lat).alias("lat_centroid"), F.avg(lon).alias("lon_centroid"))
    return g.withColumn("reason", text)


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group (ties: smallest value) and how many values competed."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(group).agg(F.min_by(value, F.struct((-F.col("n")).alias("m"), F.col(value))).alias("majority"), F.count(F.lit(1)).alias("n_values"))


def nesting_violations(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    g = df.groupBy(fine).agg(F.min(coarse).alias("coarse_a"), F.max(coarse).alias("coarse_b"))
    return g.where(F.col("coarse_a") != F.col("coarse_b"))
