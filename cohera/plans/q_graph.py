"""Arrays (B rows) and entity resolution (G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohera.operators import conditional as C, graph as G, selection as S, spectra as B
from cohera.plans.base import part, query, rnd, rounded, sql, table
from cohera.plans.data import r
from cohera.plans.q_joins import HAV
from cohera.plans.q_tables import LABELLED, coords, labelled

# ------------------------------------------------------------------------------------------------ B
part("emb", "SELECT vec_id, label, list_transform(embedding, lambda v: CASE WHEN v::DOUBLE < -0.42::DOUBLE THEN NULL ELSE v::DOUBLE END) AS e FROM embeddings")
part("srf", "SELECT r_name AS band, n_nationkey AS pos, (n_nationkey % 7 + 0.05::DOUBLE) AS response FROM nation JOIN region ON n_regionkey=r_regionkey")
part("bw", "SELECT band, pos, response/max(response) OVER (PARTITION BY band) AS w FROM srf QUALIFY w >= 0.01::DOUBLE", "srf")
part(
    "bmean",
    "SELECT vec_id, label, band, CASE WHEN count(e[pos+1])=count(*) THEN sum(e[pos+1]*w)/sum(w) END AS v FROM emb, bw GROUP BY ALL", "emb", "bw")


def emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda v: F.when(v.cast("double") >= -0.42, v.cast("double"))).alias("e"))


def srf(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("r_name").alias("band"), F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") % 7 + 0.05).alias("response"))


REG = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def bands(spark, sf):
    return B.band_means(emb(spark, sf), "e", B.band_weights(srf(spark, sf), 0, 63))


@query("wide_to_array__B1", f"SELECT l_orderkey, l_partkey, l_linenumber, {r('l_quantity+l_extendedprice+l_discount+l_tax', 4)} AS total, 4 AS size FROM lineitem")
def wide_to_array(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", *[F.col(c).alias(f"w_{i}") for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))])
    a = B.wide_to_array(li, "w_", "a")
    return a.select("l_orderkey", "l_partkey", "l_linenumber", rnd(F.aggregate("a", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), F.size("a").alias("size"))


@query("band_weights__B2", sql(f"SELECT band, pos, {r('w', 9)} AS w, true AS inside FROM bw", "bw"))
def band_weights(spark, sf):
    return rounded(B.band_weights(srf(spark, sf), 0, 63), "w", digits=9)


@query("band_means__B3", sql(f"SELECT vec_id, band, {r('v', 9)} AS v FROM bmean", "bmean"))
def band_means(spark, sf):
    b = bands(spark, sf)
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(f"`{n}`").alias("v")) for n in REG]))
    return b.select("vec_id", items.alias("x")).select("vec_id", "x.band", rnd("x.v", 9).alias("v"))


CENTRES = [5, 15, 25, 35, 45, 55]


@query(
    "window_means__B4",
    sql("SELECT vec_id, " + ", ".join(f"{r(f'CASE WHEN len(list_filter(e[{c-1}:{c+3}], lambda v: v IS NOT NULL))=5 THEN list_sum(e[{c-1}:{c+3}])/5 END', 9)} AS h{c}" for c in CENTRES) + " FROM emb", "emb"),
)
def window_means(spark, sf):
    return emb(spark, sf).select("vec_id", *[rnd(B.window_mean(F.col("e"), c), 9).alias(f"h{c}") for c in CENTRES])


@query(
    "weighting_error__B5",
    sql(f"""WITH p AS (SELECT vec_id, band, sum((e[pos+1]+1)*w) AS a, sum((abs(e[pos+1])+0.5)*w) AS b, sum((e[pos+1]+1)/(abs(e[pos+1])+0.5)*w)/sum(w) AS ap, count(e[pos+1])=count(*) AS ok FROM emb, bw GROUP BY ALL)
SELECT band, count(*) AS n, {r('quantile_cont(abs(ap-a/b)/abs(a/b),0.5)', 8)} AS median_rel_diff, {r('quantile_cont(abs(ap-a/b)/abs(a/b),0.95)', 8)} AS p95_rel_diff FROM p WHERE ok AND abs(a/b)>1e-4 GROUP BY band""", "emb", "bw"),
)
def weighting_error(spark, sf):
    e = emb(spark, sf).select(F.transform("e", lambda v: v + 1).alias("a"), F.transform("e", lambda v: F.abs(v) + 0.5).alias("b"))
    o = B.weighting_error(e, "a", "b", B.band_weights(srf(spark, sf), 0, 63))
    return rounded(o, "median_rel_diff", "p95_rel_diff", digits=8)


@query("flat_check__B6", "SELECT vec_id, 0.0::DOUBLE AS worst FROM embeddings")
def flat_check(spark, sf):
    flat = emb(spark, sf).withColumn("c", F.coalesce(F.get("e", F.lit(0)), F.lit(0.0))).withColumn("e", F.array_repeat("c", 64))
    b = B.band_means(flat, "e", B.band_weights(srf(spark, sf), 0, 63))
    return b.select("vec_id", rnd(F.greatest(*[F.abs(F.col(f"`{n}`") - F.col("c")) for n in REG]), 9).alias("worst"))


@query(
    "line_fit__B7",
    f"""WITH x AS (SELECT vec_id, unnest(embedding[1:16])::DOUBLE+2 AS v, unnest(range(16))::DOUBLE AS p FROM embeddings),
f AS (SELECT vec_id, sqrt(greatest(0.0,(var_pop(v)*16-pow(covar_pop(v,p)*16,2)/(var_pop(p)*16))/16))/abs(avg(v)) AS rel, avg(v) AS mean, min(v)>0 AS complete, max(CASE WHEN p=8 THEN v END) AS centre FROM x GROUP BY 1)
SELECT vec_id, {r('rel', 7)} AS rel_rms, {r('mean', 9)} AS mean, complete AND rel<0.06::DOUBLE AS smooth, abs(mean-centre)/abs(centre)<=0.05::DOUBLE AS within,
{r('avg((abs(mean-centre)/abs(centre)<=0.05::DOUBLE)::INTEGER) FILTER (complete AND rel<0.06::DOUBLE) OVER ()', 9)} AS share_smooth, {r('avg((abs(mean-centre)/abs(centre)<=0.05::DOUBLE)::INTEGER) FILTER (complete) OVER ()', 9)} AS share_complete FROM f""",
)
def line_fit(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 2).alias("e"))
    rel, mean = B.line_fit(F.col("e"), 0, 16)
    f = e.select("vec_id", rel.alias("rel"), mean.alias("mean"), F.array_min(F.slice("e", 1, 16)).alias("low"), F.get("e", F.lit(8)).alias("centre"))
    f = B.smooth_check(f, F.col("low") > 0, F.col("rel"), F.col("mean"), F.col("centre"), smooth_below=0.06)
    return f.select("vec_id", rnd("rel", 7).alias("rel_rms"), rnd("mean", 9).alias("mean"), "smooth", "within", rnd("share_smooth", 9).alias("share_smooth"), rnd("share_complete", 9).alias("share_complete"))


@query(
    "resample_curve__B8",
    f"""WITH c AS (SELECT s_nationkey AS k, s_acctbal/100 AS x, (s_suppkey % 10)::DOUBLE AS y FROM supplier), s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY k ORDER BY x, y)),
f AS (SELECT *, unnest(range(ceil(x/0.1::DOUBLE-0.5)::BIGINT, ceil(x1/0.1::DOUBLE-0.5)::BIGINT)) AS i FROM s WHERE x1>x)
SELECT k, floor(i/10.0)::BIGINT AS bin, {r('sum(y+(y1-y)*((i+0.5)*0.1::DOUBLE-x)/(x1-x))/10', 7)} AS value FROM f GROUP BY 1,2""",
)
def resample_curve(spark, sf):
    c = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 10).cast("double").alias("y"))
    return rounded(B.resample_curve(c, "k", "x", "y"), "value", digits=7)


@query(
    "curve_summary__B9",
    sql(f"""WITH s AS (SELECT *, response/max(response) OVER (PARTITION BY band) AS s FROM srf) SELECT band, {r('sum(s*pos)/sum(s)', 9)} AS centroid, min(pos) FILTER (s>=0.01) AS support_lo, max(pos) FILTER (s>=0.01) AS support_hi,
max(pos) FILTER (s>=0.5) - min(pos) FILTER (s>=0.5) + 1 AS fwhm, {r('sum(CASE WHEN s>=0.01 THEN s ELSE 0 END)/sum(s)', 9)} AS share_in_support FROM s GROUP BY band""", "srf"),
)
def curve_summary(spark, sf):
    return rounded(B.curve_summary(srf(spark, sf)), "centroid", "share_in_support", digits=9)


@query("band_availability__B10", sql(f"SELECT band, {r('avg((v IS NOT NULL)::INTEGER)', 9)} AS share_all, {r('avg(CASE WHEN label<5 THEN (v IS NOT NULL)::INTEGER END)', 9)} AS share_good FROM bmean GROUP BY band", "bmean"))
def band_availability(spark, sf):
    b = bands(spark, sf).select("label", *[F.col(f"`{n}`").alias(n.replace(" ", "_")) for n in REG])
    o = B.availability(b, [n.replace(" ", "_") for n in REG], F.col("label") < 5)
    return rounded(o.withColumn("band", F.replace("band", F.lit("_"), F.lit(" "))), "share_all", "share_good", digits=9)


@query(
    "completeness_matrix__B11",
    " UNION ALL ".join(
        f"SELECT '{s}' AS feature_set, '{p}' AS population, count(*) FILTER ({c}) AS complete, count(*) AS total, count(*) FILTER ({c})::VARCHAR||'/'||count(*)::VARCHAR AS text FROM {LABELLED} WHERE {w}"
        for s, c in (("both", "quality IS NOT NULL AND toxic IS NOT NULL"), ("text", "n_chars > 100")) for p, w in (("all", "true"), ("en", "lang='en'"))),
)
def completeness_matrix(spark, sf):
    c = F.col
    return B.completeness_matrix(labelled(spark, sf), {"both": c("quality").isNotNull() & c("toxic").isNotNull(), "text": c("n_chars") > 100},
                                 {"all": F.lit(True), "en": c("lang") == "en"})


@query(
    "variant_difference__B12",
    sql(f"SELECT band, count(*) AS n, {r('quantile_cont(abs(v-u)/abs(u),0.5)', 8)} AS median_rel FROM (SELECT band, v, e[6] AS u FROM bmean JOIN emb USING (vec_id)) WHERE v IS NOT NULL AND abs(u)>1e-4 GROUP BY band", "bmean", "emb"),
)
def variant_difference(spark, sf):
    b = bands(spark, sf)
    u = F.get("e", F.lit(5))
    long = b.select(u.alias("u"), F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(f"`{n}`").alias("v")) for n in REG])).alias("x")).select("u", "x.*")
    rel = long.where(F.col("v").isNotNull() & (F.abs("u") > 1e-4)).withColumn("rel", F.abs(F.col("v") - F.col("u")) / F.abs("u"))
    return rounded(S.quantiles(rel, ["band"], "rel", {"median_rel": 0.5}), "median_rel", digits=8)


FL = "greatest(embedding[{0}]::DOUBLE,1e-5::DOUBLE)"


@query(
    "ratio_features__B13",
    f"SELECT vec_id, {r('log10(greatest(' + FL.format(1) + ',' + FL.format(2) + ')/' + FL.format(3) + ')', 7)} AS log_mbr, {r('CASE WHEN abs(embedding[5]::DOUBLE+embedding[4]::DOUBLE)>1e-12 THEN (embedding[5]::DOUBLE-embedding[4]::DOUBLE)/(embedding[5]::DOUBLE+embedding[4]::DOUBLE) ELSE 0 END', 5)} AS nd, "
    f"{r('log10(' + FL.format(3) + '/' + FL.format(4) + ')', 7)} AS log_g_r, {r('log10(' + FL.format(2) + '/' + FL.format(3) + ')', 7)} AS log_b_g FROM embeddings",
)
def ratio_features(spark, sf):
    def g(i):
        return F.get("embedding", F.lit(i)).cast("double")

    f = B.ratio_features([g(0), g(1)], g(2), g(3), g(4), g(1))
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[rnd(c, 5 if n == "nd" else 7).alias(n) for n, c in f.items()])


def _gauss(tag):
    u = "(('0x'||substr(md5('{0}|'||vec_id||'|'||j),1,13))::BIGINT::DOUBLE+0.5)/4503599627370496.0"
    return f"sqrt(-2.0::DOUBLE*ln({u.format(tag + '#1')}))*cos(2.0::DOUBLE*3.141592653589793::DOUBLE*{u.format(tag + '#2')})"


@query(
    "keyed_noise__B14",
    f"SELECT vec_id, {r('sum(v*exp(0.1::DOUBLE*' + _gauss('noise-m') + ')+0.01::DOUBLE*' + _gauss('noise-a') + ')', 6)} AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS j FROM embeddings) GROUP BY 1",
)
def keyed_noise(spark, sf):
    e = table(spark, sf, "embeddings")
    n = B.add_noise(F.col("embedding"), F.col("vec_id"), 0.1, 0.01)
    return e.select("vec_id", rnd(F.aggregate(n, F.lit(0.0), lambda s, v: s + v)).alias("total"))


ARGMAX = "list_position(embedding, list_max(embedding))-1"
CLS = f"CASE WHEN {ARGMAX}<20 THEN 'low' WHEN {ARGMAX}<40 THEN 'mid' ELSE 'high' END"


def classed(spark, sf):
    return table(spark, sf, "embeddings").withColumn("cls", C.class_by_argmax(F.col("embedding"), [(20, "low"), (40, "mid")], "high"))


@query("argmax_class__B15", f"SELECT vec_id, {CLS} AS cls FROM embeddings")
def argmax_class(spark, sf):
    return classed(spark, sf).select("vec_id", "cls")


@query(
    "percentile_envelope__B16",
    f"SELECT cls, pos::INTEGER AS pos, count(*) AS n, {r('quantile_cont(v,0.1)', 8)} AS p10, {r('quantile_cont(v,0.5)', 8)} AS p50, {r('quantile_cont(v,0.9)', 8)} AS p90 FROM (SELECT {CLS} AS cls, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS pos FROM embeddings) GROUP BY 1,2",
)
def percentile_envelope(spark, sf):
    e = classed(spark, sf).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(B.envelope(e, "embedding", "cls", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "p10", "p50", "p90", digits=8)


@query(
    "label_conflicts__B17",
    f"SELECT md5(text) AS h, count(*) AS copies, coalesce(min(quality)<max(quality),false) OR coalesce(min(toxic)<max(toxic),false) AS conflict FROM {LABELLED} GROUP BY 1 HAVING count(*)>1",
)
def label_conflicts(spark, sf):
    return B.label_conflicts(labelled(spark, sf).withColumn("h", F.md5("text")), "h", ["quality", "toxic"])


# ------------------------------------------------------------------------------------------------ G
RULES = {
    "content": "md5(text)",
    "place": "concat_ws('|', lang, source, n_chars)",
    "spacing": "md5(regexp_replace(lower(text), '[^a-z]+', ''))",
}


def links(spark, sf):
    docs = table(spark, sf, "documents")
    rules = {n: F.expr(e) for n, e in RULES.items()}
    return G.identity_links(docs, "doc_id", rules)


part("links", " UNION ALL ".join(
    f"SELECT src, doc_id AS dst, '{n}' AS rule FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {e.replace(chr(39) + chr(39) + ')', chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')') if n == 'spacing' else e}) AS src FROM documents) WHERE src<>doc_id"
    for n, e in RULES.items()))

CC = """WITH RECURSIVE und AS (SELECT src AS a, dst AS b FROM {e} UNION SELECT dst, src FROM {e}), cc(node, lab) AS (SELECT a, a FROM und UNION SELECT u.b, c.lab FROM cc c JOIN und u ON u.a=c.node)
SELECT node, min(lab) AS component FROM cc GROUP BY node"""


@query("star_edges__G1", sql("SELECT src, dst, rule FROM links WHERE rule='content'", "links"))
def star_edges(spark, sf):
    return G.star_edges(table(spark, sf, "documents"), "doc_id", F.md5("text"), "content")


@query("identity_links__G2", sql("SELECT rule, count(*) AS links, count(DISTINCT src) AS sets FROM links GROUP BY rule", "links"))
def identity_links(spark, sf):
    return G.link_report(links(spark, sf))


@query("connected_components__G3", sql(CC.format(e="links"), "links"))
def connected_components(spark, sf):
    return G.connected_components(links(spark, sf))


part("rad", f"SELECT a.vec_id AS src, b.vec_id AS dst FROM coords a JOIN coords b ON a.vec_id<b.vec_id WHERE {HAV}<=250", "coords")


@query(
    "group_key_radius__G4",
    sql("""WITH RECURSIVE und AS (SELECT src::VARCHAR AS a, dst::VARCHAR AS b FROM rad UNION SELECT dst::VARCHAR, src::VARCHAR FROM rad), cc(node, lab) AS (SELECT a, a FROM und UNION SELECT u.b, c.lab FROM cc c JOIN und u ON u.a=c.node),
l AS (SELECT node, min(lab) AS lab FROM cc GROUP BY node) SELECT vec_id::VARCHAR AS vec_id, 'g2:'||coalesce(lab, vec_id::VARCHAR) AS grp FROM coords LEFT JOIN l ON l.node=vec_id::VARCHAR""", "rad", "coords"),
)
def group_key_radius(spark, sf):
    return G.group_key(coords(spark, sf), "vec_id", "lat", "lon", 250.0, "g2:", "grp").select("vec_id", "grp")


@query(
    "identity_unit__G5",
    sql("""WITH RECURSIVE und AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), cc(node, lab) AS (SELECT a, a FROM und UNION SELECT u.b, c.lab FROM cc c JOIN und u ON u.a=c.node),
l AS (SELECT node, min(lab) AS lab FROM cc GROUP BY node) SELECT doc_id, 'iid:'||coalesce(lab, doc_id)::VARCHAR AS unit FROM documents LEFT JOIN l ON l.node=doc_id""", "links"),
)
def identity_unit(spark, sf):
    comps = G.connected_components(links(spark, sf))
    return G.attach_components(table(spark, sf, "documents").select("doc_id"), "doc_id", comps, "iid:", "unit")


part("bip", "SELECT DISTINCT 'L:'||p_brand AS src, 'R:'||p_name AS dst FROM part")


@query(
    "bipartite_components__G6",
    sql("""WITH RECURSIVE und AS (SELECT src AS a, dst AS b FROM bip UNION SELECT dst, src FROM bip), cc(node, lab) AS (SELECT a, a FROM und UNION SELECT u.b, c.lab FROM cc c JOIN und u ON u.a=c.node)
SELECT substr(node,3) AS p_brand, substr(min(lab),3) AS component FROM cc WHERE node LIKE 'L:%' GROUP BY node""", "bip"),
)
def bipartite_components(spark, sf):
    return G.bipartite_components(table(spark, sf, "part"), "p_brand", "p_name")


MERGES = [["Brand#1", "Brand#11", "Brand#99"], ["Brand#2", "Brand#22"]]


@query("override_edges__G7", "SELECT 'edge' AS kind, a AS src, b AS dst FROM (VALUES ('Brand#1','Brand#11'),('Brand#1','Brand#99'),('Brand#2','Brand#22')) v(a,b) WHERE b IN (SELECT p_brand FROM part) UNION ALL "
       "SELECT 'missing', n, NULL FROM (VALUES ('Brand#1'),('Brand#11'),('Brand#99'),('Brand#2'),('Brand#22')) v(n) WHERE n NOT IN (SELECT p_brand FROM part)")
def override_edges(spark, sf):
    e, m = G.override_edges(table(spark, sf, "part").select(F.col("p_brand").alias("name")), MERGES)
    return e.select(F.lit("edge").alias("kind"), "src", "dst").unionByName(m.select(F.lit("missing").alias("kind"), F.col("name").alias("src"), F.lit(None).cast("string").alias("dst")))


@query(
    "audit_table__G8",
    f"SELECT p_brand, p_type, count(*) AS n, {r('avg(p_size)', 8)} AS lat_centroid, {r('avg(p_retailprice)', 8)} AS lon_centroid, concat_ws('; ', CASE WHEN p_brand LIKE '%1' THEN 'name normalised' END, CASE WHEN p_type='PROMO' THEN 'split by region' END) AS reason FROM part GROUP BY 1,2",
)
def audit_table(spark, sf):
    o = G.audit_table(table(spark, sf, "part"), ["p_brand", "p_type"], "p_size", "p_retailprice",
                      {"name normalised": F.col("p_brand").endswith("1"), "split by region": F.col("p_type") == "PROMO"})
    return rounded(o, "lat_centroid", "lon_centroid", digits=8)


@query(
    "majority_value__G9",
    "SELECT user_id, event_type AS majority, nv AS n_values FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rk, count(*) OVER (PARTITION BY user_id) AS nv FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1,2)) WHERE rk=1",
)
def majority_value(spark, sf):
    return G.majority(table(spark, sf, "events"), "user_id", "event_type")


RADII = [25.0, 50.0, 100.0, 200.0]


def radius_counts(spark, sf, radii):
    c, out = coords(spark, sf), None
    for km in radii:
        g = G.group_key(c, "vec_id", "lat", "lon", km, "g:", "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        row = g.agg(F.lit(km).alias("km"), F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


def _cc_count(km):
    return f"""(WITH RECURSIVE und AS (SELECT a.vec_id AS a, b.vec_id AS b FROM coords a JOIN coords b ON a.vec_id<>b.vec_id WHERE {HAV}<={km}), cc(node, lab) AS (SELECT vec_id, vec_id FROM coords UNION SELECT u.b, c.lab FROM cc c JOIN und u ON u.a=c.node),
l AS (SELECT node, min(lab) AS lab FROM cc GROUP BY node), g AS (SELECT lab, count(*) AS n FROM l GROUP BY 1) SELECT {km}::DOUBLE AS km, count(*) AS n_groups, max(n) AS largest FROM g)"""


@query("radius_diagnostics__G10", sql(" UNION ALL ".join(f"SELECT * FROM {_cc_count(km)}" for km in RADII), "coords"))
def radius_diagnostics(spark, sf):
    return radius_counts(spark, sf, RADII)


@query(
    "nesting_check__G11",
    "SELECT p_name, min(p_brand) AS coarse_a, max(p_brand) AS coarse_b FROM part GROUP BY 1 HAVING min(p_brand)<>max(p_brand)",
)
def nesting_check(spark, sf):
    return G.nesting_violations(table(spark, sf, "part"), "p_name", "p_brand")
