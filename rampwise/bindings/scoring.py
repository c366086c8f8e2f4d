"""AG, ML algebra and DG on grouped targets and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampwise.bindings.registry import SQL, big, bind, ev, gr, mx, pt, six, table
from rampwise.functions import scalars as S
from rampwise.operators import diagnose, evaluate, groups, segments, trailing
from rampwise.operators.quantiles import exact_quantiles
from rampwise.plans import traces

LV = groups.SITE_LEVELS
MIN_N = (10, 1, 1)


def _fit_val(df):
    return df.where("fit"), df.where("NOT fit")


def _levels(alias: str, value: str, source: str, how: str = "avg", having: int = 10) -> dict[str, str]:
    return {f"{alias}3": f"SELECT site, stand, rwy, {how}({value}) AS p FROM {source} GROUP BY ALL HAVING count(*) >= {having}",
            f"{alias}2": f"SELECT site, rwy, {how}({value}) AS p FROM {source} GROUP BY ALL",
            f"{alias}1": f"SELECT site, {how}({value}) AS p FROM {source} GROUP BY ALL"}


def _joins(alias: str, v: str = "v") -> str:
    return (f" LEFT JOIN {alias}3 ON {alias}3.site = {v}.site AND {alias}3.stand = {v}.stand AND {alias}3.rwy = {v}.rwy"
            f" LEFT JOIN {alias}2 ON {alias}2.site = {v}.site AND {alias}2.rwy = {v}.rwy LEFT JOIN {alias}1 ON {alias}1.site = {v}.site")


SQL["gf"], SQL["gv"] = "SELECT * FROM gr WHERE fit", "SELECT * FROM gr WHERE NOT fit"
SQL.update(_levels("m", "y", "gf"))
SQL.update(_levels("e", "y", "gf", "median"))
SQL["pr"] = f"SELECT v.*, coalesce(m3.p, m2.p, m1.p, (SELECT avg(y) FROM gf)) AS pred FROM gv v {_joins('m')}"
PR = "gr gf gv m3 m2 m1 pr"


def pr(spark, d):
    fit, val = _fit_val(gr(spark, d))
    return groups.mean_baseline(fit, val, LV, "y", MIN_N)


@bind("ag1_group_mean", uses="gr", sql="""
    SELECT site, rwy, stand, round(avg(y), 4) AS p, CAST(count(*) AS BIGINT) AS n FROM gr GROUP BY ALL HAVING count(*) >= 10""")
def ag1(spark, d):
    return groups.group_mean(gr(spark, d), ["site", "rwy", "stand"], "y", 10).select("site", "rwy", "stand", six("p", "p", 4), "n")


@bind("ag1_group_median", uses="gr", sql="""
    SELECT site, rwy, sup, round(median(y), 4) AS p, CAST(count(*) AS BIGINT) AS n FROM gr GROUP BY ALL HAVING count(*) >= 10""")
def ag1b(spark, d):
    return groups.group_median(gr(spark, d), ["site", "rwy", "sup"], "y", 10).select("site", "rwy", "sup", six("p", "p", 4), "n")


@bind("ag2_level_hierarchy", uses="gr gf m3 m2 m1", sql="""
    SELECT site, rwy, stand, round(p, 4) AS p FROM m3 UNION ALL SELECT site, rwy, NULL, round(p, 4) FROM m2
    UNION ALL SELECT site, NULL, NULL, round(p, 4) FROM m1 UNION ALL SELECT NULL, NULL, NULL, round(avg(y), 4) FROM gf""")
def ag2(spark, d):
    fit, _ = _fit_val(gr(spark, d))
    tables = [t for _, t, _ in groups.mean_levels(fit, LV, "y", MIN_N)] + [fit.agg(F.avg("y").alias("p"))]
    from rampwise.operators.setops import typed_union
    return typed_union(tables).select("site", "rwy", "stand", six("p", "p", 4))


CAPS = {"mean": None, "cap5000": 5000.0, "cap8000": 8000.0, "cap11000": 11_000.0}
_CAPPED = {n: "y" if c is None else f"least(y, {c})" for n, c in CAPS.items()}
for _n, _e in _CAPPED.items():
    SQL.update(_levels(f"k{_n}", _e, "gf"))
SQL["caps"] = ("SELECT v.y, v.site, " + ", ".join(f"coalesce(k{n}3.p, k{n}2.p, k{n}1.p) AS {n}" for n in CAPS)
               + " FROM gv v " + " ".join(_joins(f"k{n}") for n in CAPS))
CAP_USES = "gr gf gv " + " ".join(f"k{n}{i}" for n in CAPS for i in (3, 2, 1)) + " caps"


def _capped(spark, d):
    fit, val = _fit_val(gr(spark, d))
    return groups.winsorised_predictions(fit, val, LV, "y", CAPS, MIN_N)


@bind("ag3_winsorised_sweep", uses=CAP_USES, sql=" UNION ALL ".join(
    f"SELECT '{n}' AS strategy, round(sqrt(avg(pow({n} - y, 2))), 4) AS rmse FROM caps" for n in CAPS))
def ag3(spark, d):
    return evaluate.rmse_of_many(_capped(spark, d), "y", list(CAPS)).select("strategy", six("rmse", "rmse", 4))


@bind("ag13_worst_group", uses=CAP_USES, sql=" UNION ALL ".join(
    f"(SELECT '{n}' AS strategy, site, round(sqrt(avg(pow({n} - y, 2))), 4) AS rmse FROM caps GROUP BY site ORDER BY rmse DESC LIMIT 1)"
    for n in CAPS))
def ag13b(spark, d):
    return evaluate.worst_group(_capped(spark, d), "site", "y", list(CAPS)).select("strategy", "site", six("rmse", "rmse", 4))


EDGES = (5, 10, 20, 40)
_BIN = "CASE WHEN {0} < 5 THEN 0 WHEN {0} < 10 THEN 1 WHEN {0} < 20 THEN 2 WHEN {0} < 40 THEN 3 ELSE 4 END"


@bind("ag4_cell_rate", uses="mx", sql=f"""
    SELECT site, matched, CAST({_BIN.format('d')} AS BIGINT) AS bin, round(avg(CAST(abs(y - d) <= 1 AS INT)), 6) AS p,
           CAST(count(*) AS BIGINT) AS n FROM mx WHERE fit AND d IS NOT NULL GROUP BY ALL HAVING count(*) >= 20""")
def ag4(spark, d):
    m = mx(spark, d).where("fit").withColumn("bin", S.bin_by_edges("d", EDGES))
    return groups.cell_rate(m, ["site", "matched", "bin"], "y", "d", 1, 20).select("site", "matched", "bin", six("p", "p"), "n")


@bind("ag5_share_of_total", uses="ev", sql="""
    SELECT key, kind, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ev GROUP BY ALL""")
def ag5(spark, d):
    return groups.share_of_total(ev(spark, d), ["key", "kind"]).select("key", "kind", "n", six("share", "share", 9))


@bind("wn11_percent_of_total", uses="ev", sql="""
    SELECT kind, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM ev GROUP BY ALL""")
def wn11(spark, d):
    return groups.share_of_total(ev(spark, d), ["kind"]).select("kind", six(100 * F.col("share"), "pct"))


@bind("ag12_exact_quantiles", uses=PR, sql="""
    SELECT site, CAST(count(*) AS BIGINT) AS n, round(median(abs(pred - y)), 4) AS med, round(quantile_cont(abs(pred - y), 0.9), 4) AS p90
    FROM pr GROUP BY 1""")
def ag12(spark, d):
    e = pr(spark, d).withColumn("err", F.abs(F.col("pred") - F.col("y")))
    return exact_quantiles(e, ["site"], "err", {"med": 0.5, "p90": 0.9}).select("site", "n", six("med", "med", 4), six("p90", "p90", 4))


@bind("ag13_rmse", uses=PR, sql="""
    SELECT site, round(sqrt(avg(pow(pred - y, 2))), 4) AS rmse, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY 1
    UNION ALL SELECT NULL, round(sqrt(avg(pow(pred - y, 2))), 4), count(*) FROM pr""")
def ag13(spark, d):
    p = pr(spark, d)
    both = evaluate.rmse(p, "y", "pred", ["site"]).unionByName(evaluate.rmse(p, "y", "pred").withColumn("site", F.lit(None).cast("string")))
    return both.select("site", six("rmse", "rmse", 4), "n")


@bind("ag14_stddev_corr", uses="ev", sql="""
    SELECT key, round(stddev(val), 6) AS sd, round(corr(val, k), 6) AS r_k, round(corr(val, CASE WHEN k % 3 = 0 THEN t / 1000000000 END), 6) AS r_t
    FROM ev GROUP BY 1""")
def ag14(spark, d):
    e = ev(spark, d)
    return e.groupBy("key").agg(six(F.stddev_samp("val"), "sd"), six(S.pearson("val", "k"), "r_k"),
                                six(S.pearson(F.col("val"), F.when(F.col("k") % 3 == 0, F.col("t") / 1_000_000_000)), "r_t"))


@bind("ag15_hit_rate", uses=PR, sql="""
    SELECT rwy, round(avg(CAST(abs(pred - y) <= 2000 AS INT)), 6) AS hit_rate, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY 1""")
def ag15(spark, d):
    return evaluate.hit_rate(pr(spark, d), F.col("pred") - F.col("y"), 2000, ["rwy"]).select("rwy", six("hit_rate", "hit_rate"), "n")


# A template of customers and an output with repeated, missing, extra and invalid rows.
SQL["sub"] = """
    SELECT o_custkey + 10 AS c_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN -1.0 WHEN o_orderkey % 7 = 2
           THEN 'NaN'::DOUBLE ELSE o_totalprice END AS y FROM orders"""
SQL["tpl"] = "SELECT c_custkey FROM customer"


def _damaged(spark, d):
    n = F.col("o_orderkey") % 7
    out = table(spark, d, "orders").select(
        (F.col("o_custkey") + 10).alias("c_custkey"),
        F.when(n == 0, None).when(n == 1, -1.0).when(n == 2, float("nan")).otherwise(F.col("o_totalprice")).alias("y"))
    return out, table(spark, d, "customer").select("c_custkey")


@bind("ag17_bad_counts", uses="sub", sql="""
    SELECT CAST(count(*) - count(DISTINCT c_custkey) AS BIGINT) AS repeated,
           CAST(count(*) FILTER (WHERE y IS NULL OR isnan(y) OR y < 0) AS BIGINT) AS invalid FROM sub""")
def ag17(spark, d):
    out, template = _damaged(spark, d)
    v = evaluate.check_output(out, template, "c_custkey", "y")
    pick = lambda name: F.max(F.when(F.col("violation") == name, F.col("n")))
    return v.agg(pick("duplicate").alias("repeated"), pick("invalid").alias("invalid"))


@bind("ml24_check_output", uses="sub tpl", sql="""
    SELECT 'duplicate' AS violation, CAST(count(*) - count(DISTINCT c_custkey) AS BIGINT) AS n FROM sub
    UNION ALL SELECT 'missing', count(*) FROM tpl WHERE c_custkey NOT IN (SELECT c_custkey FROM sub)
    UNION ALL SELECT 'extra', count(*) FROM sub WHERE c_custkey NOT IN (SELECT c_custkey FROM tpl)
    UNION ALL SELECT 'invalid', count(*) FROM sub WHERE y IS NULL OR isnan(y) OR y < 0""")
def ml24(spark, d):
    return evaluate.check_output(*_damaged(spark, d), "c_custkey", "y")


@bind("ag18_summary", uses="gr", sql="""
    SELECT CAST(count(*) AS BIGINT) AS n, round(min(y), 4) AS low, round(median(y), 4) AS median, round(max(y), 4) AS high FROM gr""")
def ag18(spark, d):
    return evaluate.summary(gr(spark, d), "y").select("n", *[six(c, c, 4) for c in ("low", "median", "high")])


@bind("ag19_leaderboard", sql="""
    SELECT CAST(rank() OVER (ORDER BY best) AS BIGINT) AS rank, team, best, CAST(submissions AS BIGINT) AS submissions FROM (
        SELECT o_custkey AS team, min(CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, -3) END) AS best, count(*) AS submissions
        FROM orders GROUP BY 1) WHERE best IS NOT NULL""")
def ag19(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("team"),
                                         F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice", -3)).alias("score"))
    return evaluate.leaderboard(o, "team", "score")


@bind("ag20_pareto", uses=PR, sql="""
    WITH r AS (SELECT pow(pred - y, 2) AS se, row_number() OVER (ORDER BY pow(pred - y, 2) DESC) AS rn, count(*) OVER () AS n FROM pr)
    SELECT '100' AS top, round(sum(se) FILTER (WHERE rn <= 100) / sum(se), 9) AS share FROM r
    UNION ALL SELECT '0.01', round(sum(se) FILTER (WHERE rn <= ceil(0.01 * n)) / sum(se), 9) FROM r""")
def ag20(spark, d):
    return evaluate.pareto(pr(spark, d), evaluate.squared("y", "pred"), [100, 0.01]).select("top", six("share", "share", 9))


@bind("ag20_error_share", uses=PR, sql="""
    SELECT site, rwy, CAST(count(*) AS BIGINT) AS n, round(sum(pow(pred - y, 2)) / sum(sum(pow(pred - y, 2))) OVER (), 9) AS share FROM pr GROUP BY ALL""")
def ag20b(spark, d):
    return evaluate.error_share(pr(spark, d), evaluate.squared("y", "pred"), ["site", "rwy"]).select("site", "rwy", "n", six("share", "share", 9))


@bind("ag21_histogram", uses=PR, sql="""
    SELECT floor((pred - y) / 500) * 500 AS bucket, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY 1""")
def ag21(spark, d):
    return evaluate.histogram(pr(spark, d), F.col("pred") - F.col("y"), 500)


# --- group-based predictors ---------------------------------------------------------------------

@bind("ml1_median_baseline", uses="gr gf gv e3 e2 e1", sql=f"""
    SELECT v.id, round(coalesce(e3.p, e2.p, e1.p, (SELECT median(y) FROM gf)), 4) AS pred FROM gv v {_joins('e')}""")
def ml1(spark, d):
    fit, val = _fit_val(gr(spark, d))
    return groups.median_baseline(fit, val, LV, "y", MIN_N).select("id", six("pred", "pred", 4))


SQL["rf"] = "SELECT *, CASE WHEN stand % 5 <> 0 THEN qty * 300 END AS recov FROM gf"
SQL["rv"] = "SELECT *, CASE WHEN stand % 5 <> 0 THEN qty * 300 END AS recov FROM gv"
SQL["og"] = "SELECT *, y - recov AS gap FROM rf WHERE recov IS NOT NULL"
SQL.update(_levels("o", "gap", "og"))
SQL["two"] = f"""
    SELECT v.id, v.site, v.y, greatest(60, least(15000, dp)) AS direct, greatest(60, least(15000, CASE WHEN recov IS NOT NULL THEN recov + op ELSE dp END)) AS offs
    FROM (SELECT v.*, coalesce(m3.p, m2.p, m1.p, (SELECT avg(y) FROM gf)) AS dp, coalesce(o3.p, o2.p, o1.p, (SELECT avg(gap) FROM og)) AS op
          FROM rv v {_joins('m')} {_joins('o')}) v"""
TWO = "gr gf gv m3 m2 m1 rf rv og o3 o2 o1 two"


def _two(spark, d):
    g = gr(spark, d).withColumn("recov", F.when(F.col("stand") % 5 != 0, F.col("qty") * 300))
    fit, val = _fit_val(g)
    return groups.direct_and_offset(fit, val, LV, "y", "recov", MIN_N, 60, 15_000)


@bind("ml2_choose_strategy", uses=TWO, sql="""
    SELECT site, round(sqrt(avg(pow(direct - y, 2))), 4) AS rmse_direct, round(sqrt(avg(pow(offs - y, 2))), 4) AS rmse_offset,
           CAST(count(*) AS BIGINT) AS n, sqrt(avg(pow(offs - y, 2))) < sqrt(avg(pow(direct - y, 2))) AS use_offset FROM two GROUP BY 1""")
def ml2(spark, d):
    c = groups.choose_strategy(_two(spark, d), "site", "y")
    return c.select("site", six("rmse_direct", "rmse_direct", 4), six("rmse_offset", "rmse_offset", 4), "n", "use_offset")


@bind("ml2_apply_strategy", uses=TWO, sql="""
    SELECT id, round(CASE WHEN site <> 'A' THEN offs ELSE direct END, 4) AS pred FROM two""")
def ml2b(spark, d):
    scored = _two(spark, d)
    choice = scored.select("site").distinct().withColumn("use_offset", F.col("site") != "A")
    return groups.apply_strategy(scored, choice, "site").select("id", six("pred", "pred", 4))


@bind("ml3_offset", uses=TWO, sql="SELECT id, round(offs, 4) AS pred FROM two")
def ml3(spark, d):
    return _two(spark, d).select("id", six("offset", "pred", 4))


SQL["mf"], SQL["mvl"] = "SELECT * FROM mx WHERE fit", "SELECT * FROM mx WHERE NOT fit"
SQL["nf"] = "SELECT * FROM mf WHERE d IS NULL OR abs(y - d) > 1"
SQL.update(_levels("n", "y", "nf"))
SQL["cell"] = f"SELECT site, {_BIN.format('d')} AS b, avg(CAST(abs(y - d) <= 1 AS INT)) AS p FROM mf WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 30"
SQL["pool"] = f"SELECT {_BIN.format('d')} AS b, avg(CAST(abs(y - d) <= 1 AS INT)) AS p FROM mf WHERE d IS NOT NULL GROUP BY ALL"
SQL["cellm"] = f"SELECT site, matched, {_BIN.format('d')} AS b, avg(CAST(abs(y - d) <= 1 AS INT)) AS p FROM mf WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 2000"
SQL["poolm"] = "SELECT site, matched, avg(CAST(abs(y - d) <= 1 AS INT)) AS p FROM mf WHERE d IS NOT NULL GROUP BY ALL"
SQL["prm"] = f"""
    SELECT v.*, coalesce(cm.p, pm.p, 0) AS p, coalesce(n3.p, n2.p, n1.p) AS normal FROM mvl v {_joins('n')}
    LEFT JOIN cellm cm ON cm.site = v.site AND cm.matched = v.matched AND cm.b = {_BIN.format('v.d')}
    LEFT JOIN poolm pm ON pm.site = v.site AND pm.matched = v.matched"""
MXS = "mx mf mvl nf n3 n2 n1"
_MIXED = "round(greatest(2, least(45, CASE WHEN d IS NULL THEN normal ELSE p * d + (1 - p) * normal END)), 6) AS pred"


@bind("ml4_pooled_mixture", uses=MXS + " cell pool", sql=f"""
    SELECT id, {_MIXED} FROM (SELECT v.*, coalesce(c.p, g.p, 0) AS p, coalesce(n3.p, n2.p, n1.p) AS normal FROM mvl v {_joins('n')}
        LEFT JOIN cell c ON c.site = v.site AND c.b = {_BIN.format('v.d')} LEFT JOIN pool g ON g.b = {_BIN.format('v.d')})""")
def ml4(spark, d):
    fit, val = _fit_val(mx(spark, d))
    return groups.binned_mixture(fit, val, LV, "site", "y", "d", EDGES, MIN_N, tol=1, low=2, high=45).select("id", six("pred", "pred"))


def _mixed(spark, d):
    fit, val = _fit_val(mx(spark, d))
    return groups.binned_mixture(fit, val, LV, "site", "y", "d", EDGES, MIN_N, "matched", tol=1, cell_n=2000, low=2, high=45)


@bind("ml5_matched_mixture", uses=MXS + " cellm poolm prm", sql=f"SELECT id, {_MIXED} FROM prm")
def ml5(spark, d):
    # The large cell size makes both levels of p be used on this table.
    return _mixed(spark, d).select("id", six("pred", "pred"))


@bind("ml6_labels", uses="mx", sql="SELECT id, coalesce(abs(y - d) <= 1, false) AS is_d FROM mx")
def ml6(spark, d):
    return mx(spark, d).select("id", groups.is_fallback("y", "d", 1).alias("is_d"))


@bind("ml10_combine", uses="mx", sql="""
    SELECT id, round(greatest(3, least(30, CASE WHEN d IS NULL THEN y ELSE 0.3 * d + 0.7 * y END)), 9) AS pred FROM mx""")
def ml10(spark, d):
    return mx(spark, d).select("id", six(groups.mixture(F.lit(0.3), F.col("d"), F.col("y"), 3, 30), "pred", 9))


@bind("ml11_override", uses="mx", sql="""
    SELECT id, CASE WHEN site = 'R' AND NOT matched AND d >= 30 THEN greatest(3, least(45, d)) ELSE y END AS pred FROM mx""")
def ml11(spark, d):
    m = mx(spark, d).withColumn("pred", F.col("y"))
    rule = (F.col("site") == "R") & ~F.col("matched") & (F.col("d") >= 30)
    return groups.override(m, "pred", rule, F.col("d"), 3, 45).select("id", "pred")


@bind("ml12_banded_shares", uses="mx", sql="""
    WITH f AS (SELECT *, CASE WHEN d < 30 THEN 0 WHEN d < 40 THEN 1 WHEN d < 60 THEN 2 ELSE 3 END AS band,
                      abs(y - d) <= 1 AS q, abs(y - 40) < 3 AND NOT abs(y - d) <= 1 AS r FROM mx WHERE fit AND site = 'R' AND NOT matched AND d >= 20)
    SELECT CAST(b.band AS BIGINT) AS band, CAST(count(f.band) AS BIGINT) AS n,
           round((coalesce(sum(CAST(q AS INT)), 0) + 5 * (SELECT avg(CAST(q AS INT)) FROM f)) / (count(f.band) + 5), 9) AS q,
           round((coalesce(sum(CAST(r AS INT)), 0) + 5 * (SELECT avg(CAST(r AS INT)) FROM f)) / (count(f.band) + 5), 9) AS r
    FROM (SELECT unnest([0, 1, 2, 3]) AS band) b LEFT JOIN f ON f.band = b.band GROUP BY b.band""")
def ml12(spark, d):
    f = mx(spark, d).where("fit AND site = 'R' AND NOT matched AND d >= 20")
    is_d = groups.is_fallback("y", "d", 1)
    shares = groups.banded_shares(f, "d", (30, 40, 60), {"q": is_d, "r": (F.abs(F.col("y") - 40) < 3) & ~is_d})
    return shares.select("band", "n", six("q", "q", 9), six("r", "r", 9))


@bind("ml12_three_way", uses="mx", sql="""
    SELECT id, round(greatest(1, least(90, 0.2 * d + 0.1 * (40 + y) + 0.7 * y)), 9) AS pred FROM mx WHERE d IS NOT NULL""")
def ml12b(spark, d):
    q, r = F.lit(0.2), F.lit(0.1)
    return mx(spark, d).where("d IS NOT NULL").select("id", six(groups.three_way(q, r, F.col("d"), F.col("y"), 40, 1, 90), "pred", 9))


@bind("ml17_gram", uses="mx", sql="""
    WITH s AS (SELECT sum(d * d) AS dd, sum(d * m) AS dm, sum(d * y) AS dy, sum(m * m) AS mm, sum(m * y) AS my
               FROM (SELECT d, CAST(mon AS DOUBLE) AS m, y FROM mx WHERE d IS NOT NULL))
    SELECT 'd' AS "left", 'd' AS "right", dd AS value FROM s UNION ALL SELECT 'd', 'm', dm FROM s UNION ALL SELECT 'd', 'y', dy FROM s
    UNION ALL SELECT 'm', 'm', mm FROM s UNION ALL SELECT 'm', 'y', my FROM s""")
def ml17(spark, d):
    return evaluate.gram(mx(spark, d).where("d IS NOT NULL").withColumn("m", F.col("mon").cast("double")), ["d", "m"], "y")


@bind("ml18_residual_correlation", uses="mx", sql="""
    SELECT 'd' AS "left", 'mon' AS "right", round(corr(d - y, mon - y), 6) AS r FROM mx UNION ALL
    SELECT 'd', 'stand', round(corr(d - y, stand - y), 6) FROM mx UNION ALL SELECT 'mon', 'stand', round(corr(mon - y, stand - y), 6) FROM mx""")
def ml18(spark, d):
    return evaluate.residual_correlation(mx(spark, d), ["d", "mon", "stand"], "y").select("left", "right", six("r", "r"))


@bind("ml20_split_by_month", uses="gr", sql="""
    SELECT mon IN (1, 7) AND yr = 1999 AS held, CAST(count(*) AS BIGINT) AS n, round(avg(y), 4) AS y FROM gr GROUP BY 1""")
def ml20(spark, d):
    fit, val = evaluate.split_by_month(gr(spark, d), [1, 7], 1999)
    both = fit.withColumn("held", F.lit(False)).unionByName(val.withColumn("held", F.lit(True)))
    return both.groupBy("held").agg(F.count(F.lit(1)).alias("n"), six(F.avg("y"), "y", 4))


# Scored rows: orders, with few of them in some months of one site.
SQL["sc"] = """
    SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS site,
           CASE WHEN o_orderkey % 400 = 0 THEN 2 WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END AS mon FROM orders"""
_W = """
    WITH cells AS (SELECT site, mon, count(*) AS n FROM sc GROUP BY ALL),
         mix AS (SELECT *, sum(n) OVER (PARTITION BY site) AS sn, sum(n) OVER () AS total FROM cells),
         keep AS (SELECT * FROM mix WHERE n >= 0.03 * sn),
         v AS (SELECT p.site, p.mon, pow(p.pred - p.y, 2) AS se, p.stand % 2 = 0 AS cov, k.n, k.sn, k.sn / k.total AS w
               FROM pr p JOIN keep k ON k.site = p.site AND k.mon = p.mon),
         s AS (SELECT site, avg(se) AS mse, first(w) AS w, first(sn) AS sn FROM v GROUP BY 1),
         m AS (SELECT site, mon, avg(se) AS mse, first(n) AS n FROM v WHERE site <> 'R' GROUP BY ALL),
         c AS (SELECT site, cov, avg(se) AS mse, first(sn) AS sn FROM v WHERE site <> 'R' GROUP BY ALL)"""


@bind("ml21_composition_rmse", uses=PR + " sc", sql=f"""{_W}
    SELECT 'site' AS part, site AS label, round(sqrt(mse), 4) AS rmse, round(w, 9) AS share FROM s
    UNION ALL SELECT 'all', 'all', round(sqrt(sum(w * mse)), 4), round(sum(w), 9) FROM s
    UNION ALL SELECT 'stable', 'stable', round(sqrt(sum(w * mse) / sum(w)), 4), round(sum(w), 9) FROM s WHERE site <> 'R'
    UNION ALL SELECT 'month', CAST(mon AS VARCHAR), round(sqrt(sum(n * mse) / sum(n)), 4), NULL FROM m GROUP BY mon
    UNION ALL SELECT 'covered', CAST(cov AS VARCHAR), round(sqrt(sum(sn * mse) / sum(sn)), 4), NULL FROM c GROUP BY cov""")
def ml21(spark, d):
    month = F.when(F.col("o_orderkey") % 400 == 0, 2).when(F.month("o_orderdate") <= 6, 1).otherwise(7).cast("long")  # 2 is rare everywhere
    scored = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R").alias("site"), month.alias("mon"))
    val = pr(spark, d).withColumn("cov", F.col("stand") % 2 == 0)
    out = evaluate.composition_rmse(val, scored, "site", "mon", "y", "pred", 0.03, ["R"], "cov")
    return out.select("part", "label", six("rmse", "rmse", 4), six("share", "share", 9))


P_EDGES = (0, 0.04, 0.05, 0.06, 0.07, 1.01)


@bind("ml22_calibration", uses=MXS + " cellm poolm prm", sql="""
    SELECT CAST(CASE WHEN p < 0.04 THEN 0 WHEN p < 0.05 THEN 1 WHEN p < 0.06 THEN 2 WHEN p < 0.07 THEN 3 ELSE 4 END AS BIGINT) AS bin,
           CAST(count(*) AS BIGINT) AS n, round(avg(p), 9) AS predicted, round(avg(CAST(abs(y - d) <= 1 AS INT)), 9) AS observed
    FROM prm WHERE d IS NOT NULL GROUP BY 1""")
def ml22(spark, d):
    fit, val = _fit_val(mx(spark, d).withColumn("bin", S.bin_by_edges("d", EDGES)))
    rates = groups.cell_rate(fit, ["site", "matched", "bin"], "y", "d", 1, 2000)
    coarse = groups.cell_rate(fit, ["site", "matched"], "y", "d", 1, 1)
    from rampwise.operators.setops import fallback_lookup
    scored = fallback_lookup(val, [(["site", "matched", "bin"], rates, "p"), (["site", "matched"], coarse, "p")], 0.0, "p").drop("bin")
    out = evaluate.calibration(scored.where("d IS NOT NULL"), "p", groups.is_fallback("y", "d", 1), P_EDGES)
    return out.select("bin", "n", six("predicted", "predicted", 9), six("observed", "observed", 9))


# --- diagnostics ----------------------------------------------------------------------------------

Y_EDGES = (4000, 8000, 12_000)
_YB = "CASE WHEN y < 4000 THEN 0 WHEN y < 8000 THEN 1 WHEN y < 12000 THEN 2 ELSE 3 END"


@bind("dg1_tail_calibration", uses=PR, sql="""
    WITH r AS (SELECT pred, y, percent_rank() OVER (ORDER BY pred DESC) AS pr FROM pr)
    SELECT CAST(top AS DOUBLE) AS top, CAST(count(*) AS BIGINT) AS n, round(avg(pred), 4) AS predicted, round(avg(y), 4) AS actual
    FROM r JOIN (SELECT unnest([0.01, 0.05, 0.2]) AS top) ON pr <= top GROUP BY 1""")
def dg1(spark, d):
    out = diagnose.tail_calibration(pr(spark, d), "pred", "y", [0.01, 0.05, 0.2])
    return out.select("top", "n", six("predicted", "predicted", 4), six("actual", "actual", 4))


@bind("dg2_error_bands", uses=PR, sql=f"""
    SELECT CAST({_YB} AS BIGINT) AS band, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(pow(pred - y, 2))), 4) AS rmse,
           round(avg(pred - y), 4) AS bias, round(sum(pow(pred - y, 2)) / sum(sum(pow(pred - y, 2))) OVER (), 9) AS share FROM pr GROUP BY 1""")
def dg2(spark, d):
    out = diagnose.error_bands(pr(spark, d), "y", "pred", Y_EDGES)
    return out.select("band", "n", six("rmse", "rmse", 4), six("bias", "bias", 4), six("share", "share", 9))


@bind("dg3_oracle_gain", uses=PR, sql="""
    WITH b AS (SELECT sqrt(avg(pow(pred - y, 2))) AS base, sqrt(avg(CASE WHEN site = 'R' THEN 0 ELSE pow(pred - y, 2) END)) AS r1,
                      sqrt(avg(CASE WHEN y > 12000 THEN 0 ELSE pow(pred - y, 2) END)) AS r2,
                      count(*) FILTER (WHERE site = 'R') AS n1, count(*) FILTER (WHERE y > 12000) AS n2 FROM pr)
    SELECT 'site' AS class, CAST(n1 AS BIGINT) AS n, round(r1, 4) AS rmse, round(base - r1, 4) AS gain FROM b
    UNION ALL SELECT 'long', n2, round(r2, 4), round(base - r2, 4) FROM b""")
def dg3(spark, d):
    out = diagnose.oracle_gain(pr(spark, d), "y", "pred", {"site": F.col("site") == "R", "long": F.col("y") > 12_000})
    return out.select("class", "n", six("rmse", "rmse", 4), six("gain", "gain", 4))


@bind("dg4_oof_group_effect", uses=PR, sql=" UNION ALL ".join(f"""
    SELECT '{n}' AS grouping, round(1 - sum(pow(r - coalesce(m, 0), 2)) / sum(r * r), 9) AS explained
    FROM (SELECT *, y - pred AS r, id % 2 AS half FROM pr) a
    LEFT JOIN (SELECT {k}, 1 - id % 2 AS half, avg(y - pred) AS m FROM pr GROUP BY ALL) b USING ({k}, half)"""
    for n, k in (("site_month", "site, mon"), ("supplier", "sup"))))
def dg4(spark, d):
    p = pr(spark, d).withColumns({"r": F.col("y") - F.col("pred"), "half": F.col("id") % 2})
    return diagnose.oof_group_effect(p, {"site_month": ["site", "mon"], "supplier": ["sup"]}, "r", "half").select(
        "grouping", six("explained", "explained", 9))


@bind("dg5_target_encoding", uses="gr", sql="""
    WITH c AS (SELECT sup, site, yr, sum(y) AS s, count(*) AS n FROM gr GROUP BY ALL),
         k AS (SELECT sup, site, sum(s) AS ts, sum(n) AS tn FROM c GROUP BY ALL),
         f AS (SELECT yr, ((SELECT sum(y) FROM gr) - sum(y)) / ((SELECT count(*) FROM gr) - count(*)) AS prior FROM gr GROUP BY 1)
    SELECT g.id, round((ts - s + 20 * prior) / (tn - n + 20), 4) AS encoded FROM gr g
    JOIN c USING (sup, site, yr) JOIN k USING (sup, site) JOIN f USING (yr)""")
def dg5(spark, d):
    return diagnose.target_encode_oof(gr(spark, d), ["sup", "site"], "y", "yr").select("id", six("encoded", "encoded", 4))


HALF = 1_705_276_800_000_000  # 2024-01-15, the middle of the event table's month


@bind("dg6_prevalence", uses="ev", sql=f"""
    SELECT CASE WHEN t < {HALF} THEN 'first' ELSE 'second' END AS dataset, CAST(count(*) AS BIGINT) AS n,
           round(avg(CAST(kind = 'error' AND k > 50 AS INT)), 9) AS rate FROM ev GROUP BY 1""")
def dg6(spark, d):
    e = ev(spark, d)
    cond = (F.col("kind") == "error") & (F.col("k") > 50)
    return diagnose.prevalence({"first": e.where(F.col("t") < HALF), "second": e.where(F.col("t") >= HALF)}, cond).select(
        "dataset", "n", six("rate", "rate", 9))


SQL["shf"] = """
    SELECT site, mon, avg(y) FILTER (WHERE yr = 1997) AS a, avg(y) FILTER (WHERE yr = 1999) AS b FROM gr WHERE yr IN (1997, 1999) GROUP BY ALL
    HAVING a IS NOT NULL AND b IS NOT NULL"""


@bind("dg7_shift_cells", uses="gr shf", sql="SELECT site, mon, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS shift FROM shf")
def dg7(spark, d):
    cells, _ = diagnose.shift_transfer(gr(spark, d), "site", "mon", "yr", "y", 1997, 1999)
    return cells.select("site", "mon", six("a", "a", 4), six("b", "b", 4), six("shift", "shift", 4))


@bind("dg7_shift_transfer", uses="gr shf", sql="""
    SELECT CAST(count(*) AS BIGINT) AS cells, round(corr(a - ma, b - mb), 6) AS r, round(avg(abs(b - a)), 4) AS mean_abs_shift
    FROM (SELECT *, avg(a) OVER (PARTITION BY site) AS ma, avg(b) OVER (PARTITION BY site) AS mb FROM shf)""")
def dg7b(spark, d):
    _, r = diagnose.shift_transfer(gr(spark, d), "site", "mon", "yr", "y", 1997, 1999)
    return r.select("cells", six("r", "r"), six("mean_abs_shift", "mean_abs_shift", 4))


@bind("dg8_auc", sql="""
    WITH s AS (SELECT d.n_chars AS s, l.quality = 1 AS pos FROM labels l JOIN documents d USING (doc_id)),
         r AS (SELECT s, pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS mid, rank() OVER (ORDER BY s DESC) AS top,
                      count(*) OVER () AS n FROM s)
    SELECT CAST(count(*) FILTER (WHERE pos) AS BIGINT) AS positives, CAST(count(*) FILTER (WHERE NOT pos) AS BIGINT) AS negatives,
           round((sum(mid) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2)
                 / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 9) AS auc,
           round(count(*) FILTER (WHERE pos AND top <= 0.1 * n) / count(*) FILTER (WHERE pos), 9) AS capture FROM r""")
def dg8(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = diagnose.auc(s, "n_chars", F.col("quality") == 1, 0.1)
    return out.select("positives", "negatives", six("auc", "auc", 9), six("capture", "capture", 9))


SQL["rd"] = """
    SELECT site, sup, count(*) FILTER (WHERE yr = 1997) AS na, count(*) FILTER (WHERE yr = 1999) AS nb,
           avg(CAST(qty > 40 AS INT)) FILTER (WHERE yr = 1997) AS a, avg(CAST(qty > 40 AS INT)) FILTER (WHERE yr = 1999) AS b
    FROM gr GROUP BY ALL HAVING na >= 10 AND nb >= 10"""


@bind("dg10_rate_drift", uses="gr rd", sql="""
    SELECT CAST(count(*) AS BIGINT) AS cells, round(corr(a, b), 6) AS r, round(max(abs(b - a)), 6) AS max_shift FROM rd""")
def dg10(spark, d):
    _, r = diagnose.rate_drift(gr(spark, d), ["site", "sup"], "yr", F.col("qty") > 40, 1997, 1999, 10)
    return r.select("cells", six("r", "r"), six("max_shift", "max_shift"))


@bind("dg10_rate_cells", uses="gr rd", sql="SELECT site, sup, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(a, 9) AS a, round(b, 9) AS b FROM rd")
def dg10b(spark, d):
    cells, _ = diagnose.rate_drift(gr(spark, d), ["site", "sup"], "yr", F.col("qty") > 40, 1997, 1999, 10)
    return cells.select("site", "sup", "n_a", "n_b", six("a", "a", 9), six("b", "b", 9))


@bind("dg11_partial_corr", uses="ev", sql="""
    WITH r AS (SELECT corr(val, k) AS xy, corr(val, usr) AS xz, corr(k, usr) AS yz FROM ev)
    SELECT round(xy, 6) AS r_xy, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r_partial FROM r""")
def dg11(spark, d):
    return diagnose.partial_corr(ev(spark, d), "val", "k", "usr").select(six("r_xy", "r_xy"), six("r_partial", "r_partial"))


@bind("dg12_bias_removed", uses=PR, sql="""
    SELECT round(sqrt(avg(r * r)), 4) AS rmse, round(sqrt(avg(pow(r - m, 2))), 4) AS rmse_unbiased
    FROM (SELECT pred - y AS r, avg(pred - y) OVER (PARTITION BY site, mon) AS m FROM pr)""")
def dg12(spark, d):
    out = diagnose.bias_removed(pr(spark, d), ["site", "mon"], "y", "pred")
    return out.select(six("rmse", "rmse", 4), six("rmse_unbiased", "rmse_unbiased", 4))


@bind("dg13_response", uses=PR, sql="""
    SELECT CAST(CASE WHEN qty < 10 THEN 0 WHEN qty < 25 THEN 1 WHEN qty < 40 THEN 2 ELSE 3 END AS BIGINT) AS band,
           CAST(count(*) AS BIGINT) AS n, round(avg(y), 4) AS mean_y FROM pr GROUP BY 1""")
def dg13(spark, d):
    return diagnose.bands(pr(spark, d), "qty", (10, 25, 40), {"mean_y": F.col("y")}).select("band", "n", six("mean_y", "mean_y", 4))


@bind("dg14_coverage", uses="ev", sql=f"""
    SELECT key, t >= {HALF} AS late, CAST(count(*) AS BIGINT) AS n, round(count(CASE WHEN k < 20 THEN k END) / count(*), 9) AS precip,
           round(count(CASE WHEN kind = 'error' THEN 1 END) / count(*), 9) AS fault FROM ev GROUP BY ALL""")
def dg14(spark, d):
    e = ev(spark, d).select("key", (F.col("t") >= HALF).alias("late"), F.when(F.col("k") < 20, F.col("k")).alias("precip"),
                            F.when(F.col("kind") == "error", 1).alias("fault"))
    return diagnose.coverage(e, ["key", "late"], ["precip", "fault"]).select("key", "late", "n", six("precip", "precip", 9), six("fault", "fault", 9))


@bind("dg15_residual_by_class", uses=MXS + " cellm poolm prm", sql=f"""
    SELECT matched, is_d, CAST(count(*) AS BIGINT) AS n, round(avg(pred - y), 6) AS bias, round(sqrt(avg(pow(pred - y, 2))), 6) AS rmse
    FROM (SELECT y, matched, coalesce(abs(y - d) <= 1, false) AS is_d,
                 greatest(2, least(45, CASE WHEN d IS NULL THEN normal ELSE p * d + (1 - p) * normal END)) AS pred FROM prm) GROUP BY ALL""")
def dg15(spark, d):
    p = _mixed(spark, d).withColumn("is_d", groups.is_fallback("y", "d", 1))
    return diagnose.residual_by_class(p, "y", "pred", ["matched", "is_d"]).select("matched", "is_d", "n", six("bias", "bias"), six("rmse", "rmse"))


def _drift_row(name: str, e: str) -> str:
    a, b = f"({e}) FILTER (WHERE t < {HALF})", f"({e}) FILTER (WHERE t >= {HALF})"
    return f"""
    SELECT '{name}' AS feature, round(1 - count{a} / count(*) FILTER (WHERE t < {HALF}), 9) AS null_a,
           round(1 - count{b} / count(*) FILTER (WHERE t >= {HALF}), 9) AS null_b, round(avg{a}, 6) AS mean_a, round(avg{b}, 6) AS mean_b,
           round((avg{b} - avg{a}) / stddev{a}, 6) AS shift_sd,
           1 - count{b} / count(*) FILTER (WHERE t >= {HALF}) >= 0.99 AND 1 - count{a} / count(*) FILTER (WHERE t < {HALF}) < 0.99 AS silent FROM ev"""


@bind("dg16_feature_drift", uses="ev", sql=" UNION ALL ".join([
    _drift_row("val", "val"), _drift_row("precip", "CASE WHEN k < 20 THEN k END"), _drift_row("gone", f"CASE WHEN t < {HALF} THEN k END")]))
def dg16(spark, d):
    e = ev(spark, d).select("t", "val", F.when(F.col("k") < 20, F.col("k")).alias("precip"), F.when(F.col("t") < HALF, F.col("k")).alias("gone"))
    out = diagnose.feature_drift(e.where(F.col("t") < HALF), e.where(F.col("t") >= HALF), ["val", "precip", "gone"])
    return out.select("feature", six("null_a", "null_a", 9), six("null_b", "null_b", 9), six("mean_a", "mean_a"), six("mean_b", "mean_b"),
                      six("shift_sd", "shift_sd"), "silent")


@bind("dg17_sequence_gap", uses="ev", sql="""
    SELECT prev AS kind, CAST(count(*) AS BIGINT) AS n, round(median(gap), 6) AS median_gap
    FROM (SELECT lag(kind) OVER w AS prev, (t - lag(t) OVER w) / 1000000 AS gap FROM ev WINDOW w AS (PARTITION BY usr ORDER BY t, id))
    WHERE prev IS NOT NULL GROUP BY 1""")
def dg17(spark, d):
    return diagnose.sequence_gap(ev(spark, d), "usr", "t", "kind", "id").select("kind", "n", six("median_gap", "median_gap"))


@bind("wn17_lag_correlation", uses="ev", sql="""
    SELECT key, CAST(count(prev) AS BIGINT) AS n, round(corr(val, prev), 6) AS r FROM (
        SELECT key, val, avg(val) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 1000000 PRECEDING) AS prev FROM ev)
    GROUP BY 1""")
def wn17(spark, d):
    e = ev(spark, d)
    prev = trailing.nowcast(e, "key", "t", ["val"], "id", (3600,)).select("id", F.col("val_mean60").alias("prev"))
    return diagnose.lag_correlation(e.join(prev, "id"), "val", "prev", ["key"]).select("key", "n", six("r", "r"))


@bind("wn18_configuration_state", uses="ev", sql="""
    WITH c AS (SELECT key, t // 1800000000 AS slot, kind, count(*) AS n FROM ev GROUP BY ALL),
         s AS (SELECT key, slot, count(*) AS in_use, sum(n) AS total, arg_min(kind, (-n, kind)) AS modal FROM c GROUP BY ALL),
         j AS (SELECT s.*, s.modal <> b.modal AS changed FROM s LEFT JOIN s b ON b.key = s.key AND b.slot = s.slot - 1)
    SELECT e.id, CAST(coalesce(in_use, 0) AS BIGINT) AS in_use, modal, changed, round(CASE WHEN total IS NOT NULL THEN coalesce(c.n, 0) / total END, 9) AS own_share
    FROM ev e LEFT JOIN j ON j.key = e.key AND j.slot = e.t // 1800000000 - 1
    LEFT JOIN c ON c.key = e.key AND c.slot = e.t // 1800000000 - 1 AND c.kind = e.kind""")
def wn18(spark, d):
    return diagnose.configuration_state(ev(spark, d), "key", "t", "kind", "id").select(
        "id", "in_use", "modal", "changed", six("own_share", "own_share", 9))


# --- traced surface ------------------------------------------------------------------------------------
SEG_GAP = 6 * 3600


@bind("wn19_traced_surface", uses="ev pt stepped flagged runs summ lifted", sql="""
    SELECT q.seq, CAST((SELECT count(*) FROM lifted l WHERE l.site = q.site AND l.tm < l.t1 AND l.tm < q.t AND l.t1 > q.t) AS BIGINT) AS moving_now,
           CAST((SELECT count(*) FROM lifted l WHERE l.site = q.site AND l.ta BETWEEN q.t - 900000000 AND q.t) AS BIGINT) AS lifted_prev15
    FROM pt q WHERE NOT ground""")
def wn19(spark, d):
    p = pt(spark, d).withColumnRenamed("usr", "entity").withColumn("t", F.col("t") / 1_000_000)
    seg = segments.next_after(segments.summarise(segments.segments(p, max_gap=SEG_GAP)), SEG_GAP)
    probes = p.where("NOT ground").select(F.col("seq").alias("id"), "site", F.col("t").alias("t_ref"))
    return traces.surface_features(probes, seg).withColumnRenamed("id", "seq")
