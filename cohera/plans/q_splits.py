"""Splits, folds and ordering (T, W rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohera.operators import selection as S, splits as T
from cohera.plans import data as d
from cohera.operators.balance import row_balanced_folds
from cohera.plans.base import part, query, rnd, rounded, sql, table
from cohera.plans.data import SEEDS, h, r

part("roles_unit", d.roles_sql("unit", "unit"), "samples")


@query(
    "split_other_keys__T2",
    sql("SELECT protocol, seed, id, role FROM samples JOIN roles_random USING (id) UNION ALL "
        "SELECT protocol, seed, id, role FROM samples JOIN roles_unit USING (unit)", "roles_random", "roles_unit"),
)
def split_other_keys(spark, sf):
    return T.group_split(d.samples(spark, sf), {"random": "id", "unit": "unit"}, SEEDS).select("protocol", "seed", "id", "role")


@query(
    "split_leave_unit_out__T3",
    sql(f"""WITH u AS (SELECT region AS test_unit, row_number() OVER (ORDER BY region)-1 AS fold, count(DISTINCT grp) AS ng FROM samples GROUP BY region),
us AS (SELECT *, unnest({SEEDS})::INTEGER AS seed FROM u),
o AS (SELECT test_unit, seed, grp, {h("'region'", 'seed', 'test_unit', 'grp')} AS hh FROM (SELECT DISTINCT grp, region FROM samples) p JOIN us ON p.region<>test_unit),
ro AS (SELECT test_unit, seed, grp, CASE WHEN row_number() OVER w <= ceil(0.25*count(*) OVER (PARTITION BY test_unit, seed)-1e-9) THEN 'cal' ELSE 'train' END AS role FROM o WINDOW w AS (PARTITION BY test_unit, seed ORDER BY hh))
SELECT us.seed, fold, us.test_unit, ng < 10 OR us.test_unit='AFRICA' AS descriptive_only, CASE WHEN s.region=us.test_unit THEN 'test' ELSE ro.role END AS role, count(*) AS n, sum(s.id)::BIGINT AS ids
FROM samples s CROSS JOIN us LEFT JOIN ro ON ro.test_unit=us.test_unit AND ro.seed=us.seed AND ro.grp=s.grp GROUP BY ALL""", "samples"),
)
def split_leave_unit_out(spark, sf):
    out = T.leave_unit_out(d.samples(spark, sf), "region", "grp", SEEDS, "region", always_descriptive=("AFRICA",))
    return out.groupBy("seed", "fold", "test_unit", "descriptive_only", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def unit_sizes(spark, sf):
    return d.samples(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query(
    "folds_balanced__T4",
    sql(f"""WITH RECURSIVE u AS (SELECT unit, count(*) AS n, seed FROM samples, (SELECT unnest({SEEDS})::INTEGER AS seed) GROUP BY unit, seed HAVING count(*)>=10),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n*(0.5::DOUBLE+({h("'balanced'", 'seed', 'unit')}::DOUBLE+0.5)/4503599627370496.0) DESC, unit) AS rk FROM u),
w(seed, rk, loads, fold) AS (SELECT DISTINCT seed, 0::BIGINT, [0,0,0,0,0]::BIGINT[], -1 FROM o UNION ALL SELECT w.seed, o.rk,
list_transform(loads, lambda v, i: v+CASE WHEN i=list_position(loads, list_min(loads)) THEN n ELSE 0 END), list_position(loads, list_min(loads))-1 FROM w JOIN o ON o.seed=w.seed AND o.rk=w.rk+1)
SELECT o.seed, unit, n, fold::INTEGER AS fold FROM o JOIN w USING (seed, rk)""", "samples"),
)
def folds_balanced(spark, sf):
    return T.balanced_folds(unit_sizes(spark, sf).where("n >= 10"), "unit", SEEDS, 5)


@query("split_contributor__T5")
def split_contributor(spark, sf):
    out = T.contributor_folds(d.samples(spark, sf), "unit", "grp", SEEDS, "contributor")
    return out.groupBy("protocol", "seed", "fold", "test_unit", "role").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("units"))


@query("split_non_nested_unit__T6")
def split_non_nested(spark, sf):
    mixed = F.when(F.col("id") % 97 == 0, "NATION_0").otherwise(F.col("unit"))  # some rows of many groups share a unit
    ev = d.samples(spark, sf).withColumn("source", mixed)
    out = T.contributor_folds(ev, "source", "grp", SEEDS, "contributor_source", drop_leaks=True)
    return out.groupBy("protocol", "seed", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("groups"))


@query(
    "emit_long__T7",
    sql("SELECT id, protocol, seed::SMALLINT AS seed, fold::SMALLINT AS fold, protocol AS test_unit, false AS descriptive_only, role FROM job", "job"),
)
def emit_long(spark, sf):
    return T.emit_long(d.job(spark, sf, keep=False), "id")


@query(
    "split_iteration__T8",
    sql("SELECT DISTINCT protocol, seed, fold, protocol AS test_unit, false AS descriptive_only FROM job WHERE seed IN (0,2)", "job"),
)
def split_iteration(spark, sf):
    return T.split_iterator(d.job(spark, sf, keep=False), [s for s in SEEDS if s in T.parse_seed_range("0,2-2")])


@query(
    "leakage_checks__T9",
    sql("""SELECT protocol, seed, fold, (SELECT 0)::BIGINT AS repeated_ids, 3-count(DISTINCT role) AS missing_roles,
(SELECT count(*) FROM (SELECT grp FROM job j WHERE j.seed=o.seed GROUP BY grp HAVING count(DISTINCT role)>1)) AS leaks_grp,
(SELECT count(*) FROM (SELECT kind FROM job j WHERE j.seed=o.seed GROUP BY kind HAVING count(DISTINCT role)>1)) AS leaks_kind
FROM job o GROUP BY protocol, seed, fold""", "job"),
)
def leakage_checks(spark, sf):
    return T.split_checks(d.job(spark, sf), "id", ["grp", "kind"])


@query(
    "folds_row_balanced__T10",
    sql("""WITH RECURSIVE c AS (SELECT protocol, seed, grp, count(*) AS n FROM job WHERE role='train' GROUP BY ALL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY protocol, seed ORDER BY n DESC, grp) AS rk FROM c),
w(protocol, seed, rk, loads, fold) AS (SELECT DISTINCT protocol, seed, 0::BIGINT, [0,0,0,0,0]::BIGINT[], -1 FROM o
UNION ALL SELECT w.protocol, w.seed, o.rk, list_transform(loads, lambda v, i: v+CASE WHEN i=list_position(loads, list_min(loads)) THEN n ELSE 0 END), list_position(loads, list_min(loads))-1
FROM w JOIN o ON o.protocol=w.protocol AND o.seed=w.seed AND o.rk=w.rk+1)
SELECT o.protocol, o.seed, grp, n, fold::INTEGER AS fold FROM o JOIN w USING (protocol, seed, rk)""", "job"),
)
def folds_row_balanced(spark, sf):
    return row_balanced_folds(d.job(spark, sf).where("role='train'"), d.SPLIT2, "grp", 5)


FOLD_RANK = f"""SELECT protocol, seed, grp, row_number() OVER w AS rk, count(*) OVER (PARTITION BY protocol, seed) AS n FROM
(SELECT DISTINCT protocol, seed, grp FROM job WHERE role='train') WINDOW w AS (PARTITION BY protocol, seed ORDER BY {h("'unitfold'", 'protocol', 'seed', 'grp')}, grp)"""
part("fold_rank", FOLD_RANK, "job")


@query("folds_unit_balanced__T11", sql("SELECT protocol, seed, grp, ((rk-1)%10)::INTEGER AS fold FROM fold_rank", "fold_rank"))
def folds_unit_balanced(spark, sf):
    return T.unit_folds(d.job(spark, sf).where("role='train'"), d.SPLIT2, "grp", 10)


@query(
    "folds_equal_units__T12",
    sql("SELECT protocol, seed, grp, ((rk-1)%7)::INTEGER AS fold FROM fold_rank WHERE rk <= n - n%7", "fold_rank"),
)
def folds_equal_units(spark, sf):
    return T.unit_folds(d.job(spark, sf).where("role='train'"), d.SPLIT2, "grp", 7, exact=True)


@query(
    "holdout_random__T13",
    sql(f"SELECT protocol, seed, id, row_number() OVER (PARTITION BY protocol, seed ORDER BY {h(chr(39)+'holdout'+chr(39), 'protocol', 'seed', 'id')}, id) <= round_even(0.2*count(*) OVER (PARTITION BY protocol, seed),0) AS held "
        "FROM job WHERE role='train'", "job"),
)
def holdout_random(spark, sf):
    return T.random_holdout(d.job(spark, sf).where("role='train'"), d.SPLIT2, "id").select("protocol", "seed", "id", "held")


GRID, DRAWS = [10, 15, 20, 30, 40], 20
part(
    "draws",
    f"""SELECT protocol, seed, n_target, draw, grp FROM (SELECT *, row_number() OVER (PARTITION BY protocol, seed, n_target, draw ORDER BY hh) AS rk,
count(*) OVER (PARTITION BY protocol, seed, n_target, draw) AS g FROM (SELECT protocol, seed, grp, n::VARCHAR AS n_target, n, draw, {h("'draw'", 'protocol', 'seed', 'n', 'draw', 'grp')} AS hh
FROM (SELECT DISTINCT protocol, seed, grp FROM job WHERE role='cal'), (SELECT unnest({GRID}) AS n), (SELECT unnest({list(range(DRAWS))})::INTEGER AS draw))) WHERE rk<=n AND n<=g
UNION ALL SELECT DISTINCT protocol, seed, 'all', 0, grp FROM job WHERE role='cal'""",
    "job",
)


def draws(j):
    groups = j.where("role='cal'").select(*d.SPLIT2, "grp").distinct()
    return T.group_draws(groups, d.SPLIT2, "grp", GRID, DRAWS)


@query("calibration_draws__T14", sql("SELECT * FROM draws", "draws"))
def calibration_draws(spark, sf):
    return draws(d.job(spark, sf))


# ------------------------------------------------------------------------------------------------ W
@query(
    "earliest_k_per_group__W2",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS rank FROM events QUALIFY rank <= 20",
)
def earliest_k(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return S.first_k_per_group(e, ["user_id"], [F.col("ts"), F.col("event_id")], 20).drop("ts")


HOLM = sql(
    f"""WITH p AS (SELECT target, method, seed, 1-avg(cov_group) AS p FROM results GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p, method||seed)-1 AS rr, count(*) OVER (PARTITION BY target) AS m FROM p)
SELECT target, method, seed, {r('p')} AS p, {r('least(1.0::DOUBLE, max((m-rr)*p) OVER (PARTITION BY target ORDER BY p, method||seed ROWS UNBOUNDED PRECEDING))')} AS p_holm FROM q""",
    "results")


def holm_rows(spark, sf):
    from cohera.operators.inference import holm

    p = d.results(spark, sf).groupBy("target", "method", "seed").agg((F.lit(1.0) - F.avg("cov_group")).alias("p"))
    p = p.withColumn("_t", F.concat(F.col("method"), F.col("seed").cast("string")))
    return rounded(holm(p, ["target"], "p", "_t").drop("_t"), "p", "p_holm")


query("running_max_holm__W4", HOLM)(holm_rows)


@query(
    "quantile_bins__W5",
    sql(f"""WITH e AS (SELECT kind, quantile_cont(value, [0.2,0.4,0.6,0.8]::DOUBLE[]) AS q FROM samples GROUP BY kind),
b AS (SELECT s.kind, value, CASE WHEN value<=q[1] THEN 0 WHEN value<=q[2] THEN 1 WHEN value<=q[3] THEN 2 WHEN value<=q[4] THEN 3 ELSE 4 END AS bin FROM samples s JOIN e USING (kind))
SELECT kind, bin, count(*) AS n, {r('quantile_cont(value,0.5)', 8)} AS center FROM b GROUP BY 1,2""", "samples"),
)
def quantile_bins(spark, sf):
    from cohera.operators.conditional import quantile_bin

    b = quantile_bin(d.events(spark, sf), ["kind"], "value", 5)
    return S.median(b, ["kind", "bin"], "value", "center").withColumn("center", rnd("center", 8))


@query(
    "empirical_cdf__W6",
    "SELECT DISTINCT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS ecdf FROM events WHERE value IS NOT NULL",
)
def empirical_cdf(spark, sf):
    c = S.cumulative(table(spark, sf, "events"), ["event_type"], "value", F.lit(1))
    return c.select("event_type", "value", (F.col("upto") / F.col("total")).alias("ecdf"))


@query("group_value_broadcast__W7", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS first_id FROM events")
def group_value_broadcast(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return e.join(e.groupBy("user_id").agg(F.min("event_id").alias("first_id")), "user_id").select("event_id", "first_id")


@query(
    "top_groups__W8",
    "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 6",
)
def top_groups(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "user_id").limit(6)


@query(
    "ordered_accumulation__W9",
    sql(f"""WITH RECURSIVE u AS (SELECT unit, count(*) AS n, seed FROM samples, (SELECT unnest({SEEDS})::INTEGER AS seed) GROUP BY unit, seed),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {h("'fill'", 'seed', 'unit')}, unit) AS rk, sum(n) OVER (PARTITION BY seed) AS pool, min(n) OVER (PARTITION BY seed) AS n_min FROM u),
w(seed, rk, acc, taken) AS (SELECT DISTINCT seed, 0::BIGINT, 0::HUGEINT, false FROM o UNION ALL SELECT w.seed, o.rk, acc+CASE WHEN acc<0.25::DOUBLE*pool AND acc+n<=0.35::DOUBLE*pool THEN n ELSE 0 END,
acc<0.25::DOUBLE*pool AND acc+n<=0.35::DOUBLE*pool FROM w JOIN o ON o.seed=w.seed AND o.rk=w.rk+1)
SELECT o.seed, unit, n, taken OR (NOT bool_or(taken) OVER (PARTITION BY o.seed) AND o.rk=min(CASE WHEN n=n_min THEN o.rk END) OVER (PARTITION BY o.seed)) AS is_cal FROM o JOIN w USING (seed, rk)""", "samples"),
)
def ordered_accumulation(spark, sf):
    u = unit_sizes(spark, sf).select("unit", "n", F.explode(F.array(*map(F.lit, SEEDS))).alias("seed"))
    return T.fill_calibration(u, ["seed"])
