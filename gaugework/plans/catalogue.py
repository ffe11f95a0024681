"""Every query of the library by name, with SQL where SQL can express it.

Numbers are rounded to 6 places on both sides, so that the order of floating-point sums does not show.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import ranking
from ..operators import rows as R
from ..operators import tables as T
from ..registry import Context
from . import kernels as K
from . import models as M
from . import neighbors as N
from .pairs import CUSTOMER, CUT, CUT_FLAG, EVENTS, LINE, PART, PART_ROWS, Pair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places without negative zero; ``column`` under a name that needs no quotes."""
    out = []
    for name, kind in df.dtypes:
        c = F.round(name, 6) + F.lit(0.0) if kind == "double" else F.col(name).cast("long") if kind in ("int", "bigint") else F.col(name)
        out.append(c.alias("col" if name == "column" else name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- SQL parts -------------------------------------------------------------------------------


def with_pair(p: Pair, *ctes: str, final: str) -> str:
    return "WITH pair AS (" + p.sql() + ")" + "".join(f",\n{c}" for c in ctes) + "\n" + final


def num(p: Pair, cols: tuple[str, ...] | None = None) -> str:
    return "num AS (" + " UNION ALL ".join(f"SELECT side, id, '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM pair WHERE {c} IS NOT NULL" for c in cols or p.numeric) + ")"


def lab(p: Pair, missing: bool = True, cols: tuple[str, ...] | None = None) -> str:
    v = "coalesce(CAST({c} AS VARCHAR), '__NA__')" if missing else "CAST({c} AS VARCHAR)"
    return "lab AS (" + " UNION ALL ".join(f"SELECT side, '{c}' AS col, {v.format(c=c)} AS v FROM pair WHERE side <> 'h'" + ("" if missing else f" AND {c} IS NOT NULL") for c in cols or p.categorical) + ")"


FREQ = """cnt AS (SELECT col, v, count(*) FILTER (side = 'r') AS nr, count(*) FILTER (side = 's') AS ns FROM lab GROUP BY col, v),
freq AS (SELECT *, CAST(nr AS DOUBLE) / sum(nr) OVER (PARTITION BY col) AS pr, CAST(ns AS DOUBLE) / sum(ns) OVER (PARTITION BY col) AS ps FROM cnt)"""
MOM = """mom AS (SELECT col, """ + ", ".join(f"{f} FILTER (side = '{s}') AS {n}{s}" for s in "rs" for n, f in (("n", "count(x)"), ("m", "avg(x)"), ("sd", "stddev_samp(x)"), ("sp", "stddev_pop(x)"), ("lo", "min(x)"), ("hi", "max(x)"))) + " FROM num GROUP BY col)"
SWEEP = """vals AS (SELECT col, x, count(*) FILTER (side = 'r') AS a, count(*) FILTER (side = 's') AS b FROM num WHERE side <> 'h' GROUP BY col, x),
sweep AS (SELECT col, x, lead(x) OVER w AS nx, CAST(sum(a) OVER w AS DOUBLE) / sum(a) OVER (PARTITION BY col) AS fr,
  CAST(sum(b) OVER w AS DOUBLE) / sum(b) OVER (PARTITION BY col) AS fs FROM vals WINDOW w AS (PARTITION BY col ORDER BY x)),
dist AS (SELECT col, max(abs(fr - fs)) AS ks, sum(abs(fr - fs) * (nx - x)) AS w1 FROM sweep GROUP BY col)"""


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


# ---- congruence ------------------------------------------------------------------------------


@query("ks_statistic", with_pair(LINE, num(LINE), SWEEP, MOM, final=f"SELECT col, nr AS n_r, ns AS n_s, {r6('ks', 'ks_statistic')} FROM dist JOIN mom USING (col)"))
def _ks(spark, d):
    return T.ks(LINE.frame(spark, d), list(LINE.numeric))


@query("wasserstein", with_pair(LINE, num(LINE), SWEEP, MOM, final=f"SELECT col, {r6('w1', 'wasserstein')}, {r6('least(1.0, w1 / greatest(sdr, 1e-9))', 'normalised')} FROM dist JOIN mom USING (col)"))
def _w1(spark, d):
    return T.wasserstein(LINE.frame(spark, d), list(LINE.numeric))


CI_SQL = """ci AS (SELECT *, 1.96 * sdr / sqrt(nr) AS hr, 1.96 * sds / sqrt(ns) AS hs FROM mom WHERE nr >= 2 AND ns >= 2),
ov AS (SELECT col, hr, hs, mr, ms, greatest(0.0, least(mr + hr, ms + hs) - greatest(mr - hr, ms - hs)) AS o FROM ci)"""


@query("ci_overlap", with_pair(LINE, num(LINE), MOM, CI_SQL, final=f"SELECT col, {r6('CASE WHEN hr = 0 AND hs = 0 THEN CAST(abs(mr - ms) <= 1e-12 AS DOUBLE) WHEN hr = 0 OR hs = 0 THEN 0.0 ELSE least(1.0, (o / (2 * hr) + o / (2 * hs)) / 2) END', 'ci_overlap')} FROM ov"))
def _ci(spark, d):
    return T.ci_overlap(LINE.frame(spark, d), list(LINE.numeric))


@query("dimension_wise_means", with_pair(LINE, num(LINE), MOM, final=f"SELECT col, {r6('abs(mr - ms) / sdr', 'std_mean_diff')} FROM mom WHERE lor < hir"))
def _means(spark, d):
    return T.standardised_means(LINE.frame(spark, d), list(LINE.numeric))


PROBS = "[" + ", ".join(str(x) for x in T.GRID) + "]"
QM = f"qs AS (SELECT col, quantile_cont(x, {PROBS}) FILTER (side = 'r') AS a, quantile_cont(x, {PROBS}) FILTER (side = 's') AS b FROM num GROUP BY col)"


@query("quantile_mse", with_pair(LINE, num(LINE), MOM, QM, final=f"SELECT col, {r6('list_sum(list_transform(range(1, 20), lambda i: ((a[i] - b[i]) / spr) * ((a[i] - b[i]) / spr))) / 19', 'quantile_mse')} FROM qs JOIN mom USING (col)"))
def _qmse(spark, d):
    return T.quantile_mse(LINE.frame(spark, d), list(LINE.numeric))


EVENT_NUM = num(EVENTS)


def _hell_sql() -> str:
    c = EVENTS.numeric[0]
    edges = f"""lim AS (SELECT min({c}) AS lo, max({c}) AS hi FROM pair WHERE side <> 'h'),
binned AS (SELECT side, '{c}' AS col, CAST(least(20, len(list_filter(range(0, 21), lambda i: CASE WHEN i = 20 THEN hi ELSE lo + i * ((hi - lo) / 20) END <= {c}))) AS VARCHAR) AS v FROM pair, lim WHERE side <> 'h' AND {c} IS NOT NULL),
lab2 AS (SELECT * FROM lab UNION ALL SELECT * FROM binned)"""
    f = FREQ.replace("FROM lab ", "FROM lab2 ")
    return with_pair(EVENTS, lab(EVENTS), edges, f, final=f"SELECT col, {r6('sqrt(sum((sqrt(pr) - sqrt(ps)) * (sqrt(pr) - sqrt(ps))) / 2)', 'hellinger')} FROM freq GROUP BY col")


@query("hellinger", _hell_sql())
def _hellinger(spark, d):
    return T.hellinger(EVENTS.frame(spark, d), list(EVENTS.numeric), list(EVENTS.categorical))


@query("tvd", with_pair(LINE, lab(LINE), FREQ, final=f"SELECT col, {r6('sum(abs(pr - ps)) / 2', 'tvd')} FROM freq GROUP BY col"))
def _tvd(spark, d):
    return T.tvd(LINE.frame(spark, d).where("_side <> 'h'"), list(LINE.categorical))


JS = "greatest(0.0, sum(CASE WHEN pr > 0 THEN pr * log2(pr / ((pr + ps) / 2)) ELSE 0 END + CASE WHEN ps > 0 THEN ps * log2(ps / ((pr + ps) / 2)) ELSE 0 END) / 2)"


@query("jsd", with_pair(LINE, lab(LINE), FREQ, final=f"SELECT col, {r6(JS, 'jsd')} FROM freq GROUP BY col"))
def _jsd(spark, d):
    return T.jsd(LINE.frame(spark, d).where("_side <> 'h'"), list(LINE.categorical))


def _assoc_sql() -> str:
    parts = []
    for s in "rs":
        at = f"FROM pair WHERE side = '{s}'"
        for i, a in enumerate(LINE.numeric):
            for b in LINE.numeric[i + 1 :]:
                parts.append(f"SELECT '{s}' AS side, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v {at}")
        for a in LINE.numeric:
            for c in LINE.categorical:
                parts.append(f"SELECT '{s}', '{a}', '{c}', sqrt(b / t) FROM (SELECT sum(n * (m - mm) * (m - mm)) AS b, any_value(t) AS t FROM (SELECT count(*) AS n, avg({a}) AS m FROM pair WHERE side = '{s}' GROUP BY {c}), (SELECT avg({a}) AS mm, var_pop({a}) * count(*) AS t {at}))")
        a, b = LINE.categorical
        parts.append(f"SELECT '{s}', '{a}', '{b}', sqrt((sum(CAST(n AS DOUBLE) * n / (nu * nv)) - 1) / (least(count(DISTINCT u), count(DISTINCT w)) - 1)) FROM (SELECT u, w, n, CAST(sum(n) OVER (PARTITION BY u) AS DOUBLE) AS nu, CAST(sum(n) OVER (PARTITION BY w) AS DOUBLE) AS nv FROM (SELECT {a} AS u, {b} AS w, count(*) AS n {at} GROUP BY u, w))")
    return with_pair(LINE, "av AS (" + " UNION ALL ".join(parts) + ")", final=f"SELECT a, b, {r6('least(abs(max(v) FILTER (side = ' + chr(39) + 'r' + chr(39) + ') - max(v) FILTER (side = ' + chr(39) + 's' + chr(39) + ')), 1.0)', 'abs_corr_diff')} FROM av GROUP BY a, b")


@query("correlation_difference", _assoc_sql())
def _assoc(spark, d):
    return T.associations(LINE.frame(spark, d).where("_side <> 'h'"), list(LINE.columns), LINE.meta()).select("a", "b", "abs_corr_diff")


def _mi_sql() -> str:
    ps = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {ps}))) AS e_{c}" for c in LINE.numeric)
    cells = ", ".join([*[f"CAST(len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda e: e < {c})) AS VARCHAR) AS {c}" for c in LINE.numeric], *[f"coalesce({c}, '__NA__') AS {c}" for c in LINE.categorical]])
    cols = LINE.columns
    pairs = " UNION ALL ".join(f"SELECT side, '{a}' AS a, '{b}' AS b, {a} AS u, {b} AS w FROM cells" for i, a in enumerate(cols) for b in cols[i + 1 :])
    return with_pair(
        LINE, f"ed AS (SELECT side, {edges} FROM pair WHERE side <> 'h' GROUP BY side)", f"cells AS (SELECT side, {cells} FROM pair JOIN ed USING (side))", f"long AS ({pairs})",
        "cn AS (SELECT side, a, b, u, w, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY ALL)",
        "mg AS (SELECT *, CAST(sum(n) OVER (PARTITION BY side, a, b, u) AS DOUBLE) AS nu, CAST(sum(n) OVER (PARTITION BY side, a, b, w) AS DOUBLE) AS nv, CAST(sum(n) OVER (PARTITION BY side, a, b) AS DOUBLE) AS t FROM cn)",
        "mi AS (SELECT side, a, b, sum(n / t * ln(n * t / (nu * nv))) AS m, -sum(n / t * ln(nu / t)) AS hu, -sum(n / t * ln(nv / t)) AS hv FROM mg GROUP BY side, a, b)",
        "nm AS (SELECT side, a, b, CASE WHEN hu + hv < 1e-15 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * m / (hu + hv))) END AS v FROM mi)",
        final=f"SELECT a, b, {r6('abs(max(v) FILTER (side = ' + chr(39) + 'r' + chr(39) + ') - max(v) FILTER (side = ' + chr(39) + 's' + chr(39) + '))', 'abs_mi_diff')} FROM nm GROUP BY a, b",
    )


@query("mutual_information_difference", _mi_sql())
def _mi(spark, d):
    return T.mutual_information(LINE.frame(spark, d).where("_side <> 'h'"), list(LINE.numeric), list(LINE.categorical)).select("a", "b", "abs_mi_diff")


DIRECTIONS = C.random_directions(8, len(LINE.numeric), 42)


def _sliced_sql() -> str:
    z = "z AS (SELECT side, " + ", ".join(f"({c} / a{i} - m{i} / a{i}) / (s{i} / a{i}) AS z{i}" for i, c in enumerate(LINE.numeric)) + " FROM pair, (SELECT " + ", ".join(f"max(abs({c})) AS a{i}, avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(LINE.numeric)) + " FROM pair WHERE side = 'r') WHERE side <> 'h')"
    proj = "num AS (" + " UNION ALL ".join(f"SELECT side, {k} AS col, " + " + ".join(f"CAST({w!r} AS DOUBLE) * z{i}" for i, w in enumerate(v)) + " AS x FROM z" for k, v in enumerate(DIRECTIONS)) + ")"
    return with_pair(LINE, z, proj, SWEEP, final="SELECT col AS direction, round(w1, 5) + 0.0 AS w1 FROM dist")


@query("sliced_wasserstein", _sliced_sql())
def _sliced(spark, d):
    return T.sliced(LINE.frame(spark, d).where("_side <> 'h'"), list(LINE.numeric), DIRECTIONS).select("direction", F.round("w1", 5).alias("w1"))


# ---- coverage --------------------------------------------------------------------------------


@query("category_coverage", with_pair(PART, lab(PART), FREQ, final=f"SELECT col, {r6('CAST(count(*) FILTER (nr > 0 AND ns > 0) AS DOUBLE) / count(*) FILTER (nr > 0)', 'coverage')} FROM freq GROUP BY col"))
def _catcov(spark, d):
    return T.category_coverage(PART.frame(spark, d).where("_side <> 'h'"), list(PART.categorical))


@query("range_coverage", with_pair(CUT, num(CUT), MOM, final=f"SELECT col, {r6('CASE WHEN hir = lor THEN CAST(los <= lor AND lor <= his AS DOUBLE) ELSE greatest(0.0, least(hir, his) - greatest(lor, los)) / nullif(hir - lor, 0) END', 'coverage')}, hir = lor AS constant FROM mom"))
def _rangecov(spark, d):
    return T.range_coverage(CUT.frame(spark, d), list(CUT.numeric))


H = lambda p: f"-sum(CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END)"


@query("entropy_ratio", with_pair(LINE, lab(LINE), FREQ, f"en AS (SELECT col, {H('pr')} AS hr, {H('ps')} AS hs FROM freq GROUP BY col)", final=f"SELECT col, {r6('least(1.0, hs / hr)', 'ratio')}, {r6('hr', 'entropy_real')}, {r6('hs', 'entropy_synthetic')} FROM en WHERE hr > 0"))
def _entropy(spark, d):
    return T.entropy_ratio(LINE.frame(spark, d).where("_side <> 'h'"), list(LINE.categorical))


MATCH = f"hit AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM pair r WHERE r.side = 'r' AND {' AND '.join(f'r.{c} IS NOT DISTINCT FROM s.{c}' for c in PART_ROWS.columns)})) AS m FROM pair s WHERE s.side = 's')"


def _matches(spark, d):
    p = PART_ROWS.frame(spark, d)
    return K.matches(p.where("_side = 'r'"), p.where("_side = 's'"), PART_ROWS.meta())


@query("identical_match_rate", with_pair(PART_ROWS, MATCH, final=f"SELECT m AS identical_matches, {r6('CAST(m AS DOUBLE) / n', 'identical_match_rate')} FROM hit"))
def _identical(spark, d):
    return _matches(spark, d).select(F.col("matched").alias("identical_matches"), (F.col("matched") / F.col("n")).alias("identical_match_rate"))


@query("novelty_rate", with_pair(PART_ROWS, MATCH, final=f"SELECT m AS duplicates, {r6('1 - CAST(m AS DOUBLE) / n', 'novelty_rate')} FROM hit"))
def _novelty(spark, d):
    return _matches(spark, d).select(F.col("matched").alias("duplicates"), (1 - F.col("matched") / F.col("n")).alias("novelty_rate"))


# ---- groups, fairness, preservation ----------------------------------------------------------

QI = "l_returnflag, l_linestatus, l_linenumber"


def _kanonymity(df: DataFrame) -> DataFrame:
    return K.group_sizes(df, QI.split(", ")).agg(F.min("n").alias("min_k"), F.count(F.lit(1)).alias("unique_groups")).withColumn("score", F.least(F.lit(1.0), F.col("min_k") / 5.0))


@query("k_anonymity", f"SELECT min(n) AS min_k, count(*) AS unique_groups, {r6('least(1.0, min(n) / 5.0)', 'score')} FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 5 IN (2, 3) GROUP BY {QI})")
def _kanon(spark, d):
    return _kanonymity(spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 5 in (2, 3)"))


@query("k_anonymity_all", f"SELECT min(n) AS min_k, count(*) AS unique_groups, {r6('least(1.0, min(n) / 5.0)', 'score')} FROM (SELECT count(*) AS n FROM lineitem GROUP BY {QI})")
def _kanon_all(spark, d):
    return _kanonymity(spark.read.parquet(f"{d}/lineitem.parquet"))


PARITY = """g AS (SELECT l_returnflag AS g, avg(CAST(l_linestatus = 'O' AS DOUBLE)) FILTER (side = 'r') AS r, avg(CAST(l_linestatus = 'O' AS DOUBLE)) FILTER (side = 's') AS s FROM pair GROUP BY 1),
t AS (SELECT max(r) - min(r) AS a, max(s) - min(s) AS b, bool_or(s IS NULL) AS lost FROM g WHERE r IS NOT NULL)"""


@query("statistical_parity", with_pair(LINE, PARITY, final=f"SELECT {r6('a', 'spd_real')}, {r6('b', 'spd_synthetic')}, {r6('CASE WHEN lost THEN 1.0 ELSE abs(b - a) END', 'parity_drift')} FROM t"))
def _parity(spark, d):
    return T.parity(LINE.frame(spark, d), "l_returnflag", "l_linestatus", "O")


@query("statistical_parity_number", with_pair(LINE, PARITY.replace("l_linestatus = 'O'", "CAST(l_quantity AS DOUBLE) = 7"), final=f"SELECT {r6('a', 'spd_real')}, {r6('b', 'spd_synthetic')}, {r6('CASE WHEN lost THEN 1.0 ELSE abs(b - a) END', 'parity_drift')} FROM t"))
def _parity_number(spark, d):
    return T.parity(LINE.frame(spark, d), "l_returnflag", "l_quantity", 7.0)


@query("rare_category_retention", with_pair(PART, lab(PART, False), FREQ, "rare AS (SELECT *, least(ps / pr, 1.0) AS k FROM freq WHERE pr > 0 AND pr < 0.05)", final=f"SELECT col, count(*) AS n_rare, count(*) FILTER (ns = 0) AS n_missing, {r6('sum(k)', 'kept')}, {r6('avg(k)', 'retention')} FROM rare GROUP BY col"))
def _rare(spark, d):
    return T.rare_categories(PART.frame(spark, d).where("_side <> 'h'"), list(PART.categorical))


@query("minority_class_density", with_pair(PART, lab(PART, False), FREQ, "least_one AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY nr, v) AS i FROM freq WHERE nr > 0)", final=f"SELECT col, v AS label, {r6('least(ps / pr, 1.0)', 'density_ratio')} FROM least_one WHERE i = 1"))
def _density(spark, d):
    return T.minority_density(PART.frame(spark, d).where("_side <> 'h'"), list(PART.categorical))


TAILS = """cut AS (SELECT col, quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b, min(x) AS lo, max(x) AS hi FROM num WHERE side = 'r' GROUP BY col),
sh AS (SELECT col, avg(CAST(x < a AS DOUBLE)) AS l, avg(CAST(x > b AS DOUBLE)) AS u FROM num JOIN cut USING (col) WHERE side = 's' GROUP BY col)"""


@query("tail_coverage", with_pair(CUT, num(CUT), TAILS, final=f"SELECT col, {r6('CASE WHEN a <> lo THEN least(l / 0.05, 1.0) END', 'lower')}, {r6('CASE WHEN b <> hi THEN least(u / 0.05, 1.0) END', 'upper')} FROM cut JOIN sh USING (col)"))
def _tails(spark, d):
    return T.tail_coverage(CUT.frame(spark, d), list(CUT.numeric))


GROUPS = {"returned": R.SubgroupSpec("returned", {"l_returnflag": ["R"]}), "big": R.SubgroupSpec("big", {"l_quantity": (40, None), "l_linestatus": ["O"]})}


def _subgroup_sql() -> str:
    inside = "pair AS (SELECT 'returned' AS sg, * FROM pair0 WHERE side <> 'h' AND l_returnflag = 'R' UNION ALL SELECT 'big', * FROM pair0 WHERE side <> 'h' AND l_quantity >= 40 AND l_linestatus = 'O')"
    nums = "num AS (" + " UNION ALL ".join(f"SELECT side, sg || '/{c}' AS col, CAST({c} AS DOUBLE) AS x FROM pair" for c in LINE.numeric) + ")"
    labs = "lab AS (" + " UNION ALL ".join(f"SELECT side, sg || '/{c}' AS col, {c} AS v FROM pair" for c in LINE.categorical) + ")"
    gaps = "gap AS (SELECT col, ks AS d FROM dist UNION ALL SELECT col, sum(abs(pr - ps)) / 2 FROM freq GROUP BY col)"
    final = f"""SELECT sg AS subgroup, nr AS n_real, ns AS n_syn, {r6('CAST(nr AS DOUBLE) / tr', 'share_real')}, {r6('CAST(ns AS DOUBLE) / ts', 'share_syn')}, {r6('1 - d', 'shape_score')}
FROM (SELECT sg, count(*) FILTER (side = 'r') AS nr, count(*) FILTER (side = 's') AS ns FROM pair GROUP BY sg), (SELECT count(*) FILTER (side = 'r') AS tr, count(*) FILTER (side = 's') AS ts FROM pair0),
     (SELECT split_part(col, '/', 1) AS sg2, avg(d) AS d FROM gap GROUP BY 1) WHERE sg = sg2"""
    return "WITH pair0 AS (" + LINE.sql() + "),\n" + ",\n".join([inside, nums, SWEEP, labs, FREQ, gaps]) + "\n" + final


@query("subgroup_fidelity", _subgroup_sql())
def _subgroups(spark, d):
    return T.subgroup_shapes(LINE.frame(spark, d).where("_side <> 'h'"), {n: s.column() for n, s in GROUPS.items()}, list(LINE.numeric), list(LINE.categorical))


HIT = """lim AS (SELECT (max(c_acctbal) - min(c_acctbal)) / 30 AS t FROM pair WHERE side = 'r'),
h AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM pair s WHERE s.side = 's' AND s.c_mktsegment = r.c_mktsegment AND s.c_nationkey = r.c_nationkey AND abs(r.c_acctbal - s.c_acctbal) <= t)) AS k FROM pair r, lim WHERE r.side = 'r')"""


@query("hitting_rate", with_pair(CUSTOMER, HIT, final=f"SELECT n AS n_real, k AS n_hit, {r6('CAST(k AS DOUBLE) / n', 'hit_rate')} FROM h"))
def _hits(spark, d):
    p = CUSTOMER.frame(spark, d)
    m = K.profile(p.where("_side = 'r'"), ["c_acctbal"]).first()
    got = T.hits(p, list(CUSTOMER.numeric), list(CUSTOMER.categorical), {"c_acctbal": (m["hi"] - m["lo"]) / 30}, "id")
    return got.withColumn("hit_rate", F.col("n_hit") / F.col("n_real"))


# ---- neighbours ------------------------------------------------------------------------------

EUCLID = """st AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM pair),
enc AS (SELECT side, id, (c_acctbal - m) / s AS f, c_mktsegment AS g, c_nationkey AS k FROM pair, st)"""
DIST = "sqrt((a.f - b.f) * (a.f - b.f) + 2.0 * CAST(a.g <> b.g AS INT) + 2.0 * CAST(a.k <> b.k AS INT))"
GOWER = """st AS (SELECT max(c_acctbal) - min(c_acctbal) AS s FROM pair WHERE side = 'r'),
enc AS (SELECT side, id, c_acctbal / s AS f, c_acctbal AS raw, s, c_mktsegment AS g, c_nationkey AS k FROM pair, st)"""
GDIST = "(least(abs(a.raw - b.raw) / a.s, 1.0) + CAST(a.g <> b.g AS INT) + CAST(a.k <> b.k AS INT)) / 3"


def nn(name: str, a: str, b: str, dist: str, k: int = 2) -> str:
    same = " AND a.id <> b.id" if a == b else ""
    return f"{name} AS (SELECT id, l[1] AS d1, l[2] AS d2, l[5] AS d5 FROM (SELECT a.id, list_sort(list({dist})) AS l FROM enc a, enc b WHERE a.side = '{a}' AND b.side = '{b}'{same} GROUP BY a.id))"


def both_spaces(name: str, needs: tuple[tuple[str, str], ...], final: str):
    """Register a distance query in the euclidean and the Gower space."""

    def add(f):
        for suffix, enc, dist, make in (("", EUCLID, DIST, N.encode), ("_gower", GOWER, GDIST, N.gower)):
            sql = with_pair(CUSTOMER, enc, *[nn(f"{a}{b}", a, b, dist) for a, b in needs], final=final)

            @query(name + suffix, sql)
            def run(spark, d, make=make):
                from ..functions.storage import saved

                rows, space = make(CUSTOMER.frame(spark, d), CUSTOMER.meta(), "id")
                rows = saved(rows, "encoded")
                return f(lambda a, b, k=1: T.near(rows, space, a, b, k))

        return f

    return add


def first(d: DataFrame) -> DataFrame:
    return N.kth(d, 1)


@both_spaces("dcr", (("s", "r"), ("h", "r"), ("r", "r")), f"SELECT {r6('(SELECT quantile_cont(d1, 0.05) FROM sr)', 'p05_dcr')}, {r6('(SELECT median(d1) FROM sr)', 'median_dcr')}, {r6('(SELECT quantile_cont(d1, 0.05) FROM hr)', 'p05_dcr_holdout')}, {r6('(SELECT quantile_cont(d1, 0.05) FROM rr)', 'p05_dcr_real')}")
def _dcr(near):
    q = lambda d, p, *names: T.first_quantile(first(d), p).select(*[F.element_at("q", i + 1).alias(n) for i, n in enumerate(names)])
    one = q(near("s", "r"), [0.05, 0.5], "p05_dcr", "median_dcr")
    return one.crossJoin(q(near("h", "r"), [0.05], "p05_dcr_holdout")).crossJoin(q(near("r", "r"), [0.05], "p05_dcr_real"))  # one row each


RATIO = "CASE WHEN d2 = 0 THEN 0 ELSE d1 / d2 END"


@both_spaces("nndr", (("s", "r"), ("h", "r")), f"SELECT {r6(f'(SELECT median({RATIO}) FROM sr)', 'nndr_median')}, {r6(f'(SELECT median({RATIO}) FROM hr)', 'nndr_median_holdout')}")
def _nndr(near):
    ratio = F.when(F.element_at("d", 2) == 0, F.lit(0.0)).otherwise(F.try_divide(F.element_at("d", 1), F.element_at("d", 2)))
    m = lambda a, n: T.first_quantile(near(a, "r", 2).select("_id", ratio.alias("d")), [0.5]).select(F.element_at("q", 1).alias(n))
    return m("s", "nndr_median").crossJoin(m("h", "nndr_median_holdout"))  # one row each


@both_spaces("epsilon_identifiability", (("r", "s"), ("r", "r")), f"SELECT {r6('avg(CAST(rs.d1 <= rr.d1 AS DOUBLE))', 'identifiability_risk')} FROM rs JOIN rr USING (id)")
def _epsilon(near):
    a, b = first(near("r", "s")).withColumnRenamed("d", "x"), first(near("r", "r")).withColumnRenamed("d", "y")
    return a.join(b, "_id").agg(F.avg((F.col("x") <= F.col("y")).cast("double")).alias("identifiability_risk"))


@both_spaces("authenticity", (("s", "r"), ("r", "r")), f"SELECT {r6('avg(CAST(d1 > 0.05 * (SELECT median(d1) FROM rr) AS DOUBLE))', 'authenticity')} FROM sr")
def _authenticity(near):
    limit = 0.05 * T.first_quantile(first(near("r", "r")), [0.5]).first()["q"][0]
    return first(near("s", "r")).agg(F.avg((F.col("d") > F.lit(limit)).cast("double")).alias("authenticity"))


@both_spaces("alpha_precision_beta_recall", (("s", "r"), ("r", "s"), ("r", "r"), ("s", "s")), f"SELECT {r6('(SELECT avg(CAST(d1 <= (SELECT quantile_cont(d5, 0.9) FROM rr) AS DOUBLE)) FROM sr)', 'alpha_precision')}, {r6('(SELECT avg(CAST(d1 <= (SELECT quantile_cont(d5, 0.9) FROM ss) AS DOUBLE)) FROM rs)', 'beta_recall')}")
def _alpha(near):
    a, b = (T.first_quantile(N.kth(near(s, s, 5), 5), [0.9]).first()["q"][0] for s in "rs")
    share = lambda x, y, limit, n: first(near(x, y)).agg(F.avg((F.col("d") <= F.lit(limit)).cast("double")).alias(n))
    return share("s", "r", a, "alpha_precision").crossJoin(share("r", "s", b, "beta_recall"))  # one row each


@both_spaces("nn_adversarial_accuracy", (("s", "r"), ("r", "s"), ("r", "r"), ("s", "s")), f"SELECT {r6('((SELECT avg(CAST(rs.d1 > rr.d1 AS DOUBLE)) FROM rs JOIN rr USING (id)) + (SELECT avg(CAST(sr.d1 > ss.d1 AS DOUBLE)) FROM sr JOIN ss USING (id))) / 2', 'nn_adversarial_accuracy')}")
def _nnaa(near):
    side = lambda a, b, n: first(near(a, b)).withColumnRenamed("d", "x").join(first(near(a, a)), "_id").agg(F.avg((F.col("x") > F.col("d")).cast("double")).alias(n))
    return side("r", "s", "p").crossJoin(side("s", "r", "q")).select(((F.col("p") + F.col("q")) / 2).alias("nn_adversarial_accuracy"))  # one row each


@query("mia_auc", with_pair(CUSTOMER, EUCLID, nn("rs", "r", "s", DIST), nn("hs", "h", "s", DIST), final=f"SELECT {r6('avg(CAST(rs.d1 < hs.d1 AS DOUBLE) + 0.5 * CAST(rs.d1 = hs.d1 AS INT))', 'mia_auc')} FROM rs, hs"))
def _mia(spark, d):
    rows, space = N.encode(CUSTOMER.frame(spark, d), CUSTOMER.meta(), "id")
    sides = [first(T.near(rows, space, s, "s", 1)).select((-F.col("d")).alias("p"), F.lit(s == "r").alias("pos")) for s in "rh"]
    return N.auc(sides[0].unionAll(sides[1]), "p", "pos").withColumnRenamed("auc", "mia_auc")


DISCLOSE = """st AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM pair),
enc AS (SELECT side, id, (c_acctbal - m) / s AS f, c_mktsegment AS g, c_nationkey AS k FROM pair, st),
best AS (SELECT a.id, a.g, arg_min(b.g, {'d': sqrt((a.f - b.f) * (a.f - b.f) + 2.0 * CAST(a.k <> b.k AS INT)), 'i': b.id}) AS guess FROM enc a, enc b WHERE a.side = 'r' AND b.side = 's' GROUP BY a.id, a.g)"""


@query("attribute_disclosure", with_pair(CUSTOMER, DISCLOSE, final=f"SELECT {r6('avg(CAST(g = guess AS DOUBLE))', 'disclosure_rate')} FROM best"))
def _disclosure(spark, d):
    p, meta = CUSTOMER.frame(spark, d), CUSTOMER.meta(sensitive=("c_mktsegment",))
    rows, space = N.encode(p, meta, "id", ["c_acctbal"], ["c_nationkey"])
    return R.disclosure(rows, space, p, ["c_mktsegment"], {}, "id", meta)


MINORITY = "own AS (SELECT d1, c_mktsegment = 'BUILDING' AS inside FROM rs JOIN pair ON rs.id = pair.id WHERE side = 'r')"


@query("minority_privacy_risk", with_pair(CUSTOMER, EUCLID, nn("rs", "r", "s", DIST), MINORITY, final=f"SELECT {r6('median(d1) FILTER (inside)', 'median_dcr_subgroup')}, {r6('median(d1) FILTER (NOT inside)', 'median_dcr_rest')}, {r6('median(d1)', 'median_dcr_overall')} FROM own"))
def _minority(spark, d):
    p = CUSTOMER.frame(spark, d)
    rows, space = N.encode(p, CUSTOMER.meta(), "id")
    own = first(T.near(rows, space, "r", "s", 1)).join(p.where("_side = 'r'").select(F.col("id").alias("_id"), (F.col("c_mktsegment") == "BUILDING").alias("inside")), "_id")
    inside, rest, whole = (T.first_quantile(x, [0.5]).select(F.element_at("q", 1).alias(n)) for x, n in ((own.where("inside"), "median_dcr_subgroup"), (own.where("not inside"), "median_dcr_rest"), (own, "median_dcr_overall")))
    return inside.crossJoin(rest).crossJoin(whole)  # one row each


MMD = f"""capped AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5('42:' || id), id) AS i FROM enc WHERE side <> 'h'),
sub AS (SELECT * FROM capped WHERE i <= 500),
ds AS (SELECT a.side AS sa, b.side AS sb, {DIST} AS d, (a.side, a.i) < (b.side, b.i) AS upper FROM sub a, sub b),
g AS (SELECT 1 / (2 * median(d) * median(d) + 1e-12) AS g FROM ds WHERE upper AND d > 0),
ks AS (SELECT sa, sb, avg(exp(-g * d * d)) AS k FROM ds, g GROUP BY sa, sb)"""


@query("mmd", with_pair(CUSTOMER, EUCLID, MMD, final=f"SELECT {r6('sqrt(greatest(0.0, sum(CASE WHEN sa = sb THEN k ELSE -k END)))', 'mmd')} FROM ks"))
def _mmd(spark, d):
    rows, space = N.encode(CUSTOMER.frame(spark, d), CUSTOMER.meta(), "id")
    return spark.createDataFrame([(C.mmd_of(rows, space, 500, 42),)], "mmd double")


MMD_ALL = MMD.replace(" WHERE i <= 500", "")


@query("mmd_all", with_pair(CUSTOMER, EUCLID, MMD_ALL, final=f"SELECT {r6('sqrt(greatest(0.0, sum(CASE WHEN sa = sb THEN k ELSE -k END)))', 'mmd')} FROM ks"))
def _mmd_all(spark, d):
    rows, space = N.encode(CUSTOMER.frame(spark, d), CUSTOMER.meta(), "id")
    return spark.createDataFrame([(C.mmd_of(rows, space, None, 42),)], "mmd double")


# ---- ranking ---------------------------------------------------------------------------------

CANDIDATES = " UNION ALL ".join(
    f"SELECT 'c{i}' AS candidate, '{c}' AS c, '{m}' AS metric, round({e}, 6) AS score FROM lineitem WHERE l_orderkey % 4 = {i}"
    for i in range(4)
    for c, m, e in (("congruence", "a", "avg(l_discount) * 10"), ("congruence", "b", "avg(l_tax) * 12"), ("coverage", "c", "avg(CASE WHEN l_quantity > 25 THEN 1.0E0 ELSE 0.0E0 END)"), ("utility", "d", "min(0.5E0)"))
    if (i, m) != (3, "b") or c != "congruence"
)


def scores(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CANDIDATES.replace("FROM lineitem", "FROM {t}"), t=spark.read.parquet(f"{d}/lineitem.parquet")).withColumn("score", F.col("score").cast("double"))


SCORES = f"WITH sc AS (SELECT candidate, c, metric, CAST(score AS DOUBLE) AS score FROM ({CANDIDATES}))"
NORMS = {
    "linear": "CASE WHEN max(round(score, 14)) OVER w = min(round(score, 14)) OVER w THEN 1.0 ELSE (round(score, 14) - min(round(score, 14)) OVER w) / nullif(max(round(score, 14)) OVER w - min(round(score, 14)) OVER w, 0) END",
    "normal": "CASE WHEN stddev_pop(score) OVER w < 1e-14 THEN 0.0 ELSE (score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0) END",
    "quantile": "CASE WHEN count(*) OVER w < 2 THEN 0.5 ELSE (rank() OVER (PARTITION BY metric ORDER BY round(score, 14)) - 1 + (count(*) OVER (PARTITION BY metric, round(score, 14)) - 1) / 2.0) / nullif(count(*) OVER w - 1, 0) END",
}
for _mode, _sql in NORMS.items():

    @query(f"normalize_{_mode}", f"{SCORES} SELECT candidate, c, metric, {r6(_sql, 'score')} FROM sc WINDOW w AS (PARTITION BY metric)")
    def _norm(spark, d, mode=_mode):
        return ranking.normalised(scores(spark, d), mode)


BOARD = ", cmp AS (SELECT * FROM sc WHERE metric IN (SELECT metric FROM sc GROUP BY metric HAVING count(DISTINCT candidate) = (SELECT count(DISTINCT candidate) FROM sc))), byc AS (SELECT candidate, c, avg(score) AS s FROM cmp GROUP BY candidate, c), tot AS (SELECT candidate, avg(s) AS overall FROM byc GROUP BY candidate)"


@query("leaderboard", f"{SCORES}{BOARD} SELECT row_number() OVER (ORDER BY overall DESC, candidate) AS place, candidate, {r6('overall', 'overall')} FROM tot")
def _board(spark, d):
    return ranking.leaderboard(scores(spark, d))


#: A candidate that scored nothing, beside the others.
UNSCORED = "SELECT candidate FROM sc UNION SELECT 'a_unscored'"


def with_unscored(sc: DataFrame) -> DataFrame:
    return sc.select("candidate").union(sc.sparkSession.createDataFrame([("a_unscored",)], "candidate string")).distinct()


def board_sql(value: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY overall DESC NULLS LAST, candidate) AS place, candidate, {r6('overall', 'overall')} FROM ({UNSCORED}) LEFT JOIN ({value}) USING (candidate)"


@query("ranking_by_metric", f"{SCORES} {board_sql("SELECT candidate, score AS overall FROM sc WHERE metric = 'b'")}")
def _by_metric(spark, d):
    sc = scores(spark, d)
    return ranking.leaderboard(sc, "absolute", "b", with_unscored(sc))


@query("ranking_unscored_normal", f"{SCORES}, z AS (SELECT candidate, c, metric, {NORMS['normal']} AS score FROM sc WHERE metric IN (SELECT metric FROM sc GROUP BY metric HAVING count(DISTINCT candidate) = (SELECT count(DISTINCT candidate) FROM sc)) WINDOW w AS (PARTITION BY metric)) {board_sql('SELECT candidate, avg(s) AS overall FROM (SELECT candidate, c, avg(score) AS s FROM z GROUP BY candidate, c) GROUP BY candidate')}")
def _unscored(spark, d):
    sc = scores(spark, d)
    return ranking.leaderboard(sc, "normal", candidates=with_unscored(sc))


@query("dp_ledger", "SELECT 1.5 :: DOUBLE AS epsilon, 0.00001 :: DOUBLE AS delta")
def _ledger(spark, d):
    got = R.DpLedger(ledger={"epsilon": 1.5, "delta": 1e-5}).compute(None, None, None).scalars
    return spark.createDataFrame([(got["epsilon"], got["delta"])], "epsilon double, delta double")


# ---- models (no SQL) and the scorecard -------------------------------------------------------


def context(spark: SparkSession, d: str, p: Pair, **roles) -> Context:
    rows = p.frame(spark, d)
    side = {s: rows.where(F.col("_side") == s).select(*p.columns) for s in "rs"}
    return Context(side["r"], side["s"], p.meta(**roles))


def scalars(spark: SparkSession, result) -> DataFrame:
    if result.scalars is None:
        raise RuntimeError(result.skip_reason)
    return spark.createDataFrame([(k, float(v) if math.isfinite(v) else None) for k, v in result.scalars.items()], "scalar string, value double")




def of_metric(name: str, cls, pair: Pair = CUSTOMER, **options) -> None:
    @query(name)
    def run(spark, d):
        ctx = context(spark, d, pair)
        return scalars(spark, cls(ctx, **options).compute(ctx.real, ctx.synthetic, ctx.meta))


SEGMENT = [M.UtilityTask("c_mktsegment", "classification")]
of_metric("pmse", C.Pmse)
of_metric("c2st", C.C2st)
of_metric("discriminative_score", R.DiscriminativeScore)
of_metric("tstr_suite", R.TstrSuite, tasks=SEGMENT)
of_metric("multi_target_utility", R.MultiTargetUtility)
of_metric("model_panel_utility", R.ModelPanelUtility, CUT_FLAG, tasks=[M.UtilityTask("l_linestatus", "classification", ("l_quantity", "l_returnflag"))])
of_metric("feature_importance_spearman", R.FeatureImportanceSpearman, tasks=SEGMENT)
of_metric("minority_utility_gap", R.MinorityUtilityGap, tasks=SEGMENT, subgroup_specs=[R.SubgroupSpec("rich", {"c_acctbal": (5000, None)})])


@query("pca_scatter")
def _pca(spark, d):
    ctx = context(spark, d, PART)
    data, _ = M.vectors(ctx.pair, ctx.meta)
    return M.principal(data, 2).select("_row", "y", F.abs(F.element_at("p", 1)).alias("pc1"), F.abs(F.element_at("p", 2)).alias("pc2"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core scorecard of the leaky customer pair: metric, dimension, key, scalar, value."""
    from ..runner import evaluate

    rows = CUSTOMER.frame(spark, sf_dir)
    side = {s: rows.where(F.col("_side") == s).select(*CUSTOMER.columns) for s in "rsh"}
    report = evaluate(side["r"], side["s"], CUSTOMER.meta(quasi=("c_nationkey", "c_mktsegment")), holdout=side["h"])
    return report.frame(spark)


@query("scorecard")
def _scorecard(spark, d):
    return flagship(spark, d)
