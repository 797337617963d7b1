"""Joins and set operations (J, U rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohera.operators import joins as J, neighbours as N
from cohera.plans import data as d
from cohera.plans.base import part, query, rnd, sql, table
from cohera.plans.data import r
from cohera.plans.q_tables import COORD, coords
from cohera.session import settle_parameters

part("coords", f"SELECT * FROM {COORD}")


@query("join_one_to_one__J1", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_one_to_one(spark, sf):
    return J.join_one_to_one(
        table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query(
    "join_many_to_one__J2",
    "SELECT event_id, c_nationkey, c_mktsegment FROM events LEFT JOIN customer ON user_id=c_custkey",
)
def join_many_to_one(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey", "c_mktsegment")
    return J.join_many_to_one(table(spark, sf, "events").select("event_id", "user_id"), c, ["user_id"]).drop("user_id")


@query(
    "join_paired_seeds__J3",
    sql(f"""SELECT target, model, alpha, seed, {r('a.cov_group')} AS cov_group_g, {r('b.cov_group')} AS cov_group_r,
CASE WHEN a.x IS NULL THEN 'only r' WHEN b.x IS NULL THEN 'only g' ELSE 'paired' END AS pairing
FROM (SELECT *, 1 AS x FROM results WHERE protocol='group' AND method='scp_gsub' AND seed<6) a FULL JOIN
(SELECT *, 1 AS x FROM results WHERE protocol='random' AND method='scp_gsub' AND seed>0) b USING (target, model, alpha, seed)""", "results"),
)
def join_paired_seeds(spark, sf):
    m = d.results(spark, sf).where(F.col("method") == "scp_gsub")
    a = m.where((F.col("protocol") == "group") & (F.col("seed") < 6))
    b = m.where((F.col("protocol") == "random") & (F.col("seed") > 0))
    p = J.paired(a, b, ["target", "model", "alpha", "seed"], ["cov_group"], ("g", "r"))
    return p.withColumns({c: rnd(c) for c in ("cov_group_g", "cov_group_r")})


@query(
    "semi_anti_keys__J4",
    "SELECT 'semi' AS kind, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal<0) UNION ALL "
    "SELECT 'anti', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal<0)",
)
def semi_anti_keys(spark, sf):
    e = table(spark, sf, "events").select("user_id")
    c = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("user_id"))
    kept = J.keep_keys_of(e, c, "user_id").agg(F.lit("semi").alias("kind"), F.count(F.lit(1)).alias("n"))
    return kept.unionByName(J.drop_keys_of(e, c, "user_id").agg(F.lit("anti").alias("kind"), F.count(F.lit(1)).alias("n")))


HAV = (
    "2*6371.0088::DOUBLE*asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))))"
)


@query(
    "join_radius__J5",
    sql(f"SELECT a.vec_id AS a, b.vec_id AS b, {r('km', 4)} AS km FROM (SELECT a.vec_id AS ai, b.vec_id AS bi, {HAV} AS km FROM coords a JOIN coords b ON a.vec_id<b.vec_id) p "
        "JOIN coords a ON a.vec_id=ai JOIN coords b ON b.vec_id=bi WHERE km<=60", "coords"),
)
def join_radius(spark, sf):
    places = coords(spark, sf).groupBy("lat", "lon").agg(F.min("vec_id").alias("vec_id"))  # one point per place
    p = J.points_within(places, ["vec_id"], "lat", "lon", 60.0)
    return p.select(F.col("vec_id_a").alias("a"), F.col("vec_id_b").alias("b"), rnd("km", 4).alias("km"))


@query(
    "join_nearest_groups__J6",
    sql(f"SELECT least(a.label,b.label) AS group_a, greatest(a.label,b.label) AS group_b, {r(f'min({HAV})', 4)} AS min_km FROM coords a JOIN coords b "
        f"ON a.label<b.label AND {HAV}<=200 GROUP BY 1,2", "coords"),
)
def join_nearest_groups(spark, sf):
    return J.nearest_between_groups(coords(spark, sf), "label", "lat", "lon", 200.0).withColumn("min_km", rnd("min_km", 4))


# Words that do not tell names apart.
STOP = {"small", "large", "part"}


@query(
    "join_shared_tokens__J7",
    """WITH t AS (SELECT DISTINCT g, token FROM (SELECT p_brand AS g, unnest(regexp_split_to_array(p_name, '[\\s,/()\\-]+')) AS token FROM part)
WHERE length(token)>=4 AND token NOT IN ('small','large','part')),
hb AS (SELECT token, min(g) AS hub FROM t GROUP BY 1 HAVING count(*)>1)
SELECT token, hub, g AS "group" FROM t JOIN hb USING (token) WHERE g<>hub""",
)
def join_shared_tokens(spark, sf):
    return J.token_links(table(spark, sf, "part"), "p_brand", F.col("p_name"), STOP)


@query(
    "merge_candidates__J8",
    sql(f"""WITH near AS (SELECT least(a.label,b.label) AS group_a, greatest(a.label,b.label) AS group_b, {r(f'min({HAV})', 4)} AS min_km FROM coords a JOIN coords b ON a.label<b.label AND {HAV}<=120 GROUP BY 1,2),
t AS (SELECT DISTINCT g, token FROM (SELECT (p_partkey%10)::INTEGER AS g, unnest(regexp_split_to_array(p_name, '[\\s,/()\\-]+')) AS token FROM part) WHERE length(token)>=4 AND token NOT IN ('small','large','part')),
hb AS (SELECT token, min(g) AS hub FROM t GROUP BY 1 HAVING count(*)>1),
sh AS (SELECT least(hub,g) AS group_a, greatest(hub,g) AS group_b, string_agg(token, ' ' ORDER BY token) AS shared_tokens FROM t JOIN hb USING (token) WHERE g<>hub GROUP BY 1,2)
SELECT group_a, group_b, min_km, shared_tokens FROM near FULL JOIN sh USING (group_a, group_b)""", "coords"),
)
def merge_candidates(spark, sf):
    near = J.nearest_between_groups(coords(spark, sf), "label", "lat", "lon", 120.0).withColumn("min_km", rnd("min_km", 4))
    names = table(spark, sf, "part").withColumn("g", (F.col("p_partkey") % 10).cast("int"))
    return J.merge_candidates(near, J.token_links(names, "g", F.col("p_name"), STOP))


@query(
    "join_near_duplicates__J9",
    f"""SELECT label, a, b, {r('rms', 6)} AS rms FROM (SELECT x.label, x.vec_id AS a, y.vec_id AS b, sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding),
lambda t: pow(t[1]::DOUBLE-t[2]::DOUBLE,2)))/64) AS rms FROM embeddings x JOIN embeddings y ON x.label=y.label AND x.vec_id<y.vec_id) WHERE rms<0.14::DOUBLE""",
)
def join_near_duplicates(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return J.near_duplicate_pairs(e, "vec_id", "embedding", ["label"], 0.14, 64).withColumn("rms", rnd("rms", 6))


def vec_split(spark, sf):
    """Vectors with a keyed role: about a fifth test, the rest train, for two seeds."""
    from cohera.functions.keys import uniform

    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    e = e.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    return e.withColumn("role", F.when(uniform("vec", F.col("seed"), F.col("vec_id")) < 0.2, "test").otherwise("train"))


part(
    "vec_split",
    "SELECT *, CASE WHEN (('0x'||substr(md5('vec|'||seed||'|'||vec_id),1,13))::BIGINT::DOUBLE+0.5)/4503599627370496.0 < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS role "
    "FROM embeddings, (SELECT unnest([0,1])::INTEGER AS seed)",
)
part(
    "knn",
    """SELECT seed, vec_id, avg(dd) AS dist FROM (SELECT t.seed, t.vec_id, sqrt(d2) AS dd FROM (
  SELECT te.seed, te.vec_id, list_sum(list_transform(list_zip(te.z, tr.z), lambda q: pow(q[1]-q[2],2))) AS d2 FROM vz te JOIN vz tr ON te.seed=tr.seed AND te.role='test' AND tr.role='train') t
QUALIFY row_number() OVER (PARTITION BY t.seed, t.vec_id ORDER BY d2) <= 5) GROUP BY 1,2""",
    "vz",
)
part(
    "vz",
    """WITH e AS (SELECT seed, vec_id, role, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS j FROM vec_split),
s AS (SELECT seed, j, avg(v) AS m, stddev_pop(v) AS s FROM e WHERE role='train' GROUP BY 1,2)
SELECT e.seed, vec_id, role, list((v-m)/CASE WHEN s=0 THEN 1 ELSE s END ORDER BY e.j) AS z FROM e JOIN s ON e.seed=s.seed AND e.j=s.j GROUP BY 1,2,3""",
    "vec_split",
)


def knn(spark, sf):
    v = vec_split(spark, sf)
    return N.knn_mean_distance(v.where("role='train'"), v.where("role='test'"), ["seed"], "vec_id", "embedding")


@query("knn_mean_distance__J10", sql(f"SELECT seed, vec_id, {r('dist', 6)} AS dist FROM knn", "knn"))
def knn_mean_distance(spark, sf):
    return knn(spark, sf).withColumn("dist", rnd("dist", 6))


@query(
    "ordered_lookup__J11",
    "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY doc_id",
)
def ordered_lookup(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(
        table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").orderBy("doc_id")


@query(
    "join_metadata__J12",
    "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey AND n_nationkey<20 LEFT JOIN region ON n_regionkey=r_regionkey",
)
def join_metadata(spark, sf):
    n = table(spark, sf, "nation").where(F.col("n_nationkey") < 20)
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query(
    "claim_check__J14",
    sql("""WITH l AS (SELECT target||'.'||method AS key, avg(cov_group) AS value FROM results GROUP BY 1),
c AS (SELECT key, CASE WHEN key LIKE 'A%' THEN printf('%.3f', value) ELSE printf('%.2f', value) END AS printed, 'd3' AS rule, value FROM l)
SELECT key, printed, printf('%.3f', value) AS recomputed, printed=printf('%.3f', value) AS agrees FROM c""", "results"),
)
def claim_check(spark, sf):
    key = F.concat_ws(".", "target", "method")
    ledger = settle_parameters(d.results(spark, sf).groupBy(key.alias("key")).agg(F.avg("cov_group").alias("value")))
    printed = F.when(F.col("key").startswith("A"), F.format_string("%.3f", "value")).otherwise(F.format_string("%.2f", "value"))
    claims = ledger.select("key", printed.alias("printed"), F.lit("d3").alias("rule"))
    return J.check_claims(claims, ledger).select("key", "printed", "recomputed", "agrees")


# ------------------------------------------------------------------------------------------------ U
@query(
    "union_all__U1",
    "SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def union_all(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return J.union_all(s, c)


@query(
    "keep_first__U2",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)=1",
)
def keep_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return J.keep_first(e, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("set_difference__U3", "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT DISTINCT user_id FROM events")
def set_difference(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return c.exceptAll(table(spark, sf, "events").select(F.col("user_id").alias("k")).distinct())


@query(
    "replace_slice__U4",
    sql(f"SELECT target, protocol, model, method, alpha, seed, {r('CASE WHEN method=$$cqr_gsub$$ THEN cov_pooled ELSE cov_group END')} AS v FROM results", "results"),
)
def replace_slice(spark, sf):
    m = d.results(spark, sf)
    a = m.select(*d.RESULT_KEYS, rnd("cov_group").alias("v"))
    b = m.select(*d.RESULT_KEYS, rnd("cov_pooled").alias("v"))
    return J.replace_slice(a, b, F.col("method") == "cqr_gsub")


@query(
    "duplicate_rows__U5",
    "SELECT doc_id, lang, source FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*)>1)",
)
def duplicate_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h"))
    return J.duplicate_rows(docs, ["h"]).drop("h")
