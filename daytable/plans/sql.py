"""The same results in SQL for DuckDB, for each query over the test tables."""

from itertools import combinations

from daytable.plans.queries import ASKED, EVENTS, FIELDS, FLOATS, HOLD_OUT, IDS, PRIORITIES, RANGE, RATE, RULES, START, STEP, X, Y

C = ["c_1_urgent", "c_2_high", "c_3_medium", "c_4_not_specified", "c_5_low"]
BARS = [f"{i.lower()}_{f}" for i in IDS for f in FIELDS]
READ = [*FLOATS, "l_linenumber", "condition", "main", "description"]
VARS = sorted([*C, "total", "l_linenumber", "l_quantity", "f_close", "o_high", "constant"])

INCIDENTS = "inc AS (SELECT o_orderdate::DATE AS day, o_orderpriority AS category FROM orders)"
READINGS = "rd AS (SELECT *, l_shipdate::DATE AS day, (ascii(l_returnflag) * 100 + ascii(l_linestatus))::INTEGER AS condition, l_returnflag AS main, l_linestatus AS description FROM lineitem)"
DAILY = "cats AS (SELECT day, " + ", ".join(f"count(*) FILTER (category = '{v}') AS {c}" for v, c in zip(PRIORITIES, C, strict=True)) + ", count(*) AS total FROM inc GROUP BY day)"
def exact_sum(c: str) -> str:
    """The sum of doubles in whole numbers, of what is above and below 1, which no order of rows changes."""
    whole, part = f"sum(floor({c})::HUGEINT)", f"sum(floor(({c} - floor({c})) * {2**78}::DOUBLE)::HUGEINT)"
    return f"(({whole} + {part} // {2**78}::HUGEINT)::DOUBLE + ({part} % {2**78}::HUGEINT)::DOUBLE / {2**78}::DOUBLE)"


MEANS = "means AS (SELECT day, " + ", ".join(f"{exact_sum(f'coalesce({c}::DOUBLE, 0)')} / count(*) AS {c}" for c in FLOATS) + ", trunc(sum(l_linenumber) / count(*))::INTEGER AS l_linenumber FROM rd GROUP BY day)"


def mode(n: str, key: str, name: str = "mode") -> str:
    return f"""{name} AS (SELECT day, condition, n, p.main AS main, p.description AS description FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY n {n}, condition {key}) AS k FROM (
    SELECT day, condition, count(*) AS n, max({{'main': main, 'description': description}}) AS p FROM rd GROUP BY day, condition)) WHERE k = 1)"""


ORDINALS = "ords AS (SELECT condition, dense_rank() OVER (ORDER BY condition) - 1 AS ordinal FROM (SELECT DISTINCT condition FROM rd))"
BAR_ROWS = """bar AS (SELECT o_orderdate::DATE AS day, o_orderstatus AS id, arg_min(o_totalprice::DOUBLE, o_orderkey) AS open, max(o_totalprice::DOUBLE) AS high,
  min(o_totalprice::DOUBLE) AS low, arg_max(o_totalprice::DOUBLE, o_orderkey) AS close, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS volume
  FROM orders WHERE isodow(o_orderdate::DATE) < 6 GROUP BY 1, 2)"""
WIDE = "wide AS (SELECT day, " + ", ".join(f"max(CASE WHEN id = '{i}' THEN {f}{' / 1e6' if f == 'volume' else ''} END) AS {i.lower()}_{f}" for i in IDS for f in FIELDS) + " FROM bar GROUP BY day)"


def filled(name: str, source: str, cols: list[str], gap: str) -> str:
    pack = "{" + ", ".join(f"'{c}': {c}" for c in cols) + "}"
    has = f"coalesce({', '.join(cols)}) IS NOT NULL"
    island = "day - (row_number() OVER (ORDER BY day))::INTEGER" if gap == "break" else "0"
    return f"""{name}_i AS (SELECT *, {has} AS has, CASE WHEN {has} THEN {pack} END AS rec, {island} AS island FROM {source}),
{name}_l AS (SELECT *, coalesce(last_value(rec IGNORE NULLS) OVER (PARTITION BY island ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  (SELECT arg_min(rec, day) FROM {name}_i WHERE has)) AS got FROM {name}_i),
{name} AS (SELECT * EXCLUDE ({", ".join(cols)}, has, rec, island, got), {", ".join(f"got.{c} AS {c}" for c in cols)} FROM {name}_l)"""


def rounded(cols: list[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


MERGED = ",\n".join([
    INCIDENTS, READINGS, DAILY, MEANS, mode("DESC", "ASC"), ORDINALS, BAR_ROWS, WIDE,
    "days AS (SELECT means.*, ords.ordinal::INTEGER AS condition, mode.main, mode.description FROM means JOIN mode USING (day) LEFT JOIN ords ON mode.condition = ords.condition)",
    "met AS (SELECT day, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*C, "total"]) + ", " + ", ".join([*READ, *BARS]) + " FROM cats FULL JOIN days USING (day) FULL JOIN wide USING (day))",
    filled("csw", "met", BARS, "break"),
])
FEATURES = MERGED + ",\nfeat AS (SELECT day, total, " + ", ".join(C) + """, coalesce(l_linenumber, 0) AS l_linenumber, floor(coalesce(l_quantity, 0))::BIGINT AS l_quantity,
  floor(coalesce(f_close, 0) / 1000)::BIGINT AS f_close, floor(coalesce(o_high, 0) / 1000)::BIGINT AS o_high, 7 AS constant FROM csw)"""
NORMAL = FEATURES + ",\nlims AS (SELECT " + ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in VARS) + " FROM feat),\nnorm AS (SELECT day, " + ", ".join(
    f"CASE WHEN lo_{c} = hi_{c} THEN {c}::DOUBLE ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}" for c in VARS) + " FROM feat, lims)"
MOMENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS x, sum(v) AS sum, count(*) AS cnt, count(*) FILTER (v = 0) AS zero, avg(v) AS mean, min(v) AS min, max(v) AS max, sum(v * v) AS sq_sum, count(*) AS sq_cnt, "
    f"count(*) FILTER (v * v = 0) AS sq_zero, avg(v * v) AS sq_mean, var_pop(v) AS var, stddev_pop(v) AS stddev, count(*) FILTER (v = 0) / count(*) * 100 AS zero_pct FROM (SELECT {c}::DOUBLE AS v FROM feat)"
    for c in VARS
)
PRODUCTS = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, sum({a}::DOUBLE * {b}) AS prd_sum, count(*) AS prd_cnt, count(*) FILTER ({a} * {b} = 0) AS prd_zero, avg({a}::DOUBLE * {b}) AS prd_mean FROM feat"
    for a, b in combinations(VARS, 2)
)
CORR = "cor AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN corr({a}, {b}) END AS r, count(*) AS n FROM feat" for a, b in combinations(VARS, 2)
) + ")"
TIER = "CASE WHEN r IS NULL OR abs(r) >= 1.001 THEN 'anomaly' WHEN abs(r) >= .9 THEN '0.9-1.0' WHEN abs(r) >= .8 THEN '0.8-0.9' WHEN abs(r) >= .7 THEN '0.7-0.8' WHEN abs(r) >= .6 THEN '0.6-0.7' WHEN abs(r) >= .5 THEN '0.5-0.6' ELSE '0.0-0.5' END"
IN_RANGE = f"day BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"
W = [f"w_{c}" for c in X]
ERROR = " + ".join(f"w_{c} * {c}" for c in X) + f" + bias - {Y}"
EPOCHS = f"""sums AS (SELECT count(*) AS n, sum({Y}) AS s_y, sum({Y} * {Y}) AS s_yy, {", ".join(f"sum({c}) AS s_{c}, sum({c} * {Y}) AS y_{c}" for c in X)},
  {", ".join(f"sum({a} * {b}) AS p_{a}_{b}" for a in X for b in X)} FROM norm WHERE {IN_RANGE}),
hist AS (
  SELECT 0::BIGINT AS epoch, 0::DOUBLE AS bias, {", ".join(f"0::DOUBLE AS {w}" for w in W)}, 0::DOUBLE AS cost
  UNION ALL
  SELECT epoch + 1, bias - {RATE} * ({" + ".join(f"w_{c} * s_{c}" for c in X)} + bias * n - s_y) / n,
    {", ".join(f"w_{a} - {RATE} * (" + " + ".join(f"w_{b} * p_{a}_{b}" for b in X) + f" + bias * s_{a} - y_{a}) / n" for a in X)},
    ({" + ".join(f"w_{a} * w_{b} * p_{a}_{b}" for a in X for b in X)} + bias * bias * n + s_yy
      + 2 * ({" + ".join(f"w_{a} * (bias * s_{a} - y_{a})" for a in X)} - bias * s_y)) / (2 * n)
  FROM hist, sums WHERE epoch < 50)"""


def steps(n: int) -> str:
    """n steps of descent, each over all rows."""
    out = [f"m0 AS (SELECT 0::DOUBLE AS bias, {', '.join(f'0::DOUBLE AS {w}' for w in W)}, 0::DOUBLE AS cost)"]
    for k in range(n):
        out.append(f"""m{k + 1} AS (SELECT any_value(bias) - {RATE} * sum(e) / count(*) AS bias, {", ".join(f"any_value(w_{c}) - {RATE} * sum({c} * e) / count(*) AS w_{c}" for c in X)},
  sum(e * e) / (2 * count(*)) AS cost FROM (SELECT *, {ERROR} AS e FROM norm, m{k} WHERE {IN_RANGE}))""")
    last = f"m{n}"
    rows = [f"SELECT '{c}' AS name, round(w_{c}, 9) AS value FROM {last}" for c in X] + [f"SELECT '{c}' AS name, round({c}, 9) AS value FROM {last}" for c in ("bias", "cost")]
    return f"WITH {NORMAL},\n" + ",\n".join(out) + "\n" + " UNION ALL ".join(rows)


def wide_matrix(names: list[str]) -> str:
    cell = lambda x, y: f"(SELECT round(r, 6) FROM cor WHERE x = '{min(x, y)}' AND y = '{max(x, y)}')" if x != y else "NULL::DOUBLE"
    return " UNION ALL ".join(f"SELECT '{x}' AS x, " + ", ".join(f"{cell(x, y)} AS {y}" for y in sorted(names)) for x in names)


def dataset(name: str, lacks: list[str]) -> str:
    cols = ", ".join(f"NULL::DOUBLE AS {c}" if c in lacks else f"round({c}, 9) AS {c}" for c in [*X, Y])
    return f"SELECT '{name}' AS dataset, day, {cols} FROM norm"


TYPES = {**dict.fromkeys([*C, "total"], ("bigint", "incidents")), **dict.fromkeys(FLOATS, ("double", "readings")), "l_linenumber": ("int", "readings"), "condition": ("int", "readings"),
         "main": ("string", "readings"), "description": ("string", "readings"), **dict.fromkeys(BARS, ("double", "bars"))}
CATALOGUE = " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{kind}' AS type, '{source}' AS source, count(*) AS rows, count({c}) AS filled, min(day) FILTER ({c} IS NOT NULL)::VARCHAR AS first_day, "
    f"max(day) FILTER ({c} IS NOT NULL)::VARCHAR AS last_day FROM csw" for c, (kind, source) in TYPES.items()
)


def within(text: str) -> str:
    """SQL of day tables over the days of RANGE only."""
    for table, day in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        text = text.replace(f"FROM {table}", f"FROM (SELECT * FROM {table} WHERE {day}::DATE BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}')")
    return text


def run(rule: str, rate: float, start: float, ends: str) -> str:
    """The epoch at which a run ends: the first where `ends` holds of its history h, or else the 50th."""
    h = EPOCHS[EPOCHS.index("hist AS (") :].replace("0::DOUBLE AS w_", f"{start}::DOUBLE AS w_").replace(f"- {RATE} *", f"- {rate} *")
    same = " AND ".join(f"trunc({c} * 100) = trunc(lag({c}) OVER o * 100)" for c in [*W, "bias", "cost"])
    return f"""SELECT '{rule}' AS rule, CASE WHEN {ends} THEN '{rule}' ELSE 'epochs' END AS why, epoch, round(cost, 6) AS cost FROM (
  WITH RECURSIVE {h},
  g AS (SELECT *, {same} AS same, cost >= min(cost) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS flat FROM hist WHERE epoch > 0 WINDOW o AS (ORDER BY epoch))
  SELECT *, same AND lag(same) OVER (ORDER BY epoch) AS steady, flat AND lag(flat) OVER (ORDER BY epoch) AS rising FROM g)
  WHERE {ends} OR epoch = 50 QUALIFY row_number() OVER (ORDER BY epoch) = 1"""


SQL = {
    "daily_category_counts": "SELECT o_orderdate::DATE AS day, coalesce(o_orderpriority, '') AS category, count(*) AS n FROM orders GROUP BY 1, 2",
    "daily_categories": f"WITH {INCIDENTS}, {DAILY} SELECT * FROM cats",
    "event_categories": "SELECT ts::DATE AS day, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS c_{e}" for e in EVENTS) + ", count(*) AS total FROM events GROUP BY 1",
    "date_range": f"WITH {INCIDENTS} SELECT day, count(*) AS n FROM inc WHERE {IN_RANGE} GROUP BY day",
    "daily_means": f"WITH {READINGS}, {MEANS} SELECT day, {rounded(FLOATS, 6)}, l_linenumber FROM means",
    "daily_mode": f"WITH {READINGS}, {mode('DESC', 'ASC')} SELECT * FROM mode",
    "daily_mode_rare_high": f"WITH {READINGS}, {mode('ASC', 'DESC')} SELECT * FROM mode",
    "ordinals": f"WITH {READINGS}, {ORDINALS} SELECT condition, ordinal::BIGINT AS ordinal FROM ords",
    "readings_by_ordinal": f"WITH {READINGS}, {ORDINALS} SELECT day, ordinal::BIGINT AS condition, count(*) AS n FROM rd JOIN ords USING (condition) GROUP BY 1, 2",
    "parsed_incidents": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS day, o_orderpriority AS primarytype, o_orderstatus AS description, o_orderpriority AS fbicode
FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0""",
    "rejected_incidents": "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0",
    "parsed_readings": """SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN l_quantity ELSE 0 END::DOUBLE AS temp,
  CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN l_linenumber ELSE 0 END::INTEGER AS pressure, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN l_linenumber ELSE 0 END::INTEGER AS weather_id,
  0::FLOAT AS rain_1h, l_returnflag AS weather_main, l_linestatus AS weather_description FROM lineitem""",
    "bars_wide": f"WITH {BAR_ROWS}, {WIDE} SELECT day, {rounded(BARS, 9)} FROM wide",
    "bars_filled": f"WITH {INCIDENTS}, {BAR_ROWS}, {WIDE}, src AS (SELECT * FROM (SELECT DISTINCT day FROM inc) LEFT JOIN wide USING (day)), {filled('got', 'src', BARS, 'break')} SELECT day, {rounded(BARS, 9)} FROM got",
    "bars_carried": f"WITH {INCIDENTS}, {BAR_ROWS}, {WIDE}, src AS (SELECT * FROM (SELECT DISTINCT day FROM inc) LEFT JOIN wide USING (day)), {filled('got', 'src', BARS, 'carry')} SELECT day, {rounded(BARS, 9)} FROM got",
    "fill_by_customer": """WITH r AS (SELECT o_custkey, o_orderdate::DATE AS day, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS known FROM orders GROUP BY 1, 2)
SELECT o_custkey, day, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(known IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS known FROM r""",
    "merged_csw": f"WITH {MERGED} SELECT day, {', '.join([*C, 'total'])}, {rounded(FLOATS, 6)}, l_linenumber, condition, main, description, {rounded(BARS, 9)} FROM csw",
    "merged_cw": f"WITH {MERGED} SELECT day, {', '.join([*C, 'total'])}, {rounded(FLOATS, 6)}, l_linenumber, condition, main, description FROM csw",
    "merged_cs": f"WITH {MERGED} SELECT day, {', '.join([*C, 'total'])}, {rounded(BARS, 9)} FROM csw",
    "merged_reconciled": f"WITH {MERGED}, e AS (SELECT count(DISTINCT day) AS expected FROM (SELECT day FROM inc UNION ALL SELECT day FROM rd UNION ALL SELECT day FROM bar)), "
    "n AS (SELECT count(DISTINCT day) AS days FROM csw) SELECT unnest(['csw', 'cw', 'cs']) AS \"table\", days, expected, days = expected AS agrees FROM n, e",
    "merged_catalogue": f"WITH {MERGED} {CATALOGUE}",
    "merged_records": f"WITH {MERGED} " + " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{name}' AS name, count(*) AS rows, count(DISTINCT day) AS days FROM {table}"
        for stage, name, table in (("source", "incidents", "inc"), ("source", "readings", "rd"), ("source", "bars", "bar"), ("day", "incidents", "cats"), ("day", "readings", "days"), ("day", "bars", "wide"), ("table", "csw", "csw"))
    ),
    "unknown_conditions": f"""WITH {READINGS}, u AS (SELECT day, condition + CASE WHEN day > DATE '{RANGE[1]}' THEN month(day) ELSE 0 END AS condition FROM rd)
SELECT condition::BIGINT AS condition, count(*) AS rows FROM u WHERE condition NOT IN (SELECT condition FROM u WHERE day <= DATE '{RANGE[1]}') GROUP BY 1""",
    "base_stats": f"WITH {FEATURES} SELECT x, " + rounded(["sum"], 4) + ", cnt, zero, " + rounded(["mean", "min", "max", "sq_sum"], 4) + ", sq_cnt, sq_zero, " + rounded(["sq_mean", "var", "stddev", "zero_pct"], 4) + f" FROM ({MOMENTS})",
    "pair_products": f"WITH {FEATURES} SELECT x, y, {rounded(['prd_sum'], 4)}, prd_cnt, prd_zero, {rounded(['prd_mean'], 4)} FROM ({PRODUCTS})",
    "statistic_names": f"WITH {FEATURES}, b AS ({MOMENTS}), p AS ({PRODUCTS}), a AS ("
    + " UNION ALL ".join(f"SELECT x, NULL AS y, 'value' AS kind, '{c.upper()}' AS stat, {c}::DOUBLE AS value FROM b" for c in ("sum", "cnt", "zero", "mean", "min", "max"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT x, NULL, 'SQ', '{c.upper()}', sq_{c}::DOUBLE FROM b" for c in ("sum", "cnt", "zero", "mean"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT x, y, 'PRD', '{c.upper()}', prd_{c}::DOUBLE FROM p" for c in ("sum", "cnt", "zero", "mean"))
    + ") SELECT CASE kind WHEN 'value' THEN x || '-' || stat WHEN 'SQ' THEN x || '-SQ-' || stat ELSE x || '+' || y || '-PRD-' || stat END AS name, round(value, 4) AS value, x, y, kind, stat FROM a",
    "correlations": f"WITH {FEATURES}, {CORR} SELECT x, y, round(r, 6) AS r, n FROM cor",
    "correlation_one_pair": "SELECT l_returnflag AS main, round(corr(l_quantity, l_extendedprice), 6) AS r, NULL::DOUBLE AS constant FROM lineitem GROUP BY 1",
    "correlation_matrix": f"WITH {FEATURES}, {CORR} {wide_matrix(VARS)}",
    "correlation_tiers": f"WITH {FEATURES}, {CORR} SELECT {TIER} AS tier, x, y, round(r, 6) AS r FROM cor",
    "correlation_tiers_of_total": f"WITH {FEATURES}, {CORR} SELECT {TIER} AS tier, x, y, round(r, 6) AS r FROM cor WHERE contains(x, 'total') OR contains(y, 'total')",
    "normalised": f"WITH {NORMAL} SELECT day, {rounded(VARS, 9)} FROM norm",
    "normalised_datasets": f"WITH {NORMAL} {dataset('csw', [])} UNION ALL {dataset('cw', ['f_close', 'o_high'])} UNION ALL {dataset('cs', ['l_linenumber', 'l_quantity'])}",
    "gradient_step": steps(1),
    "gradient_steps": steps(3),
    "training_history": f"WITH RECURSIVE {NORMAL}, {EPOCHS} SELECT epoch, {rounded(['cost', 'bias', *W], 9)} FROM hist WHERE epoch > 0",
    "training_runs": f"""WITH RECURSIVE {NORMAL}, {EPOCHS},
h AS (SELECT epoch, cost, min(cost) OVER (ORDER BY epoch) AS least, coalesce(cost < min(cost) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved,
  coalesce(floor(cost * 1e10) = floor(lag(cost) OVER (ORDER BY epoch) * 1e10), false) AS same FROM hist WHERE epoch > 0),
i AS (SELECT *, count(*) FILTER (NOT same) OVER (ORDER BY epoch) AS a, count(*) FILTER (improved) OVER (ORDER BY epoch) AS b FROM h)
SELECT epoch, round(cost, 9) AS cost, round(least, 9) AS least, improved, count(*) FILTER (same) OVER (PARTITION BY a ORDER BY epoch) AS steady_run,
  count(*) FILTER (NOT improved) OVER (PARTITION BY b ORDER BY epoch) AS flat_run FROM i""",
    "predictions": f"WITH RECURSIVE {NORMAL}, {EPOCHS} SELECT day, round({ERROR} + {Y}, 9) AS yhat FROM norm, hist WHERE epoch = 50 AND day >= DATE '{HOLD_OUT[0]}'",
    "verification_summary": f"""WITH RECURSIVE {NORMAL}, {EPOCHS},
p AS (SELECT {Y} AS y, {ERROR} + {Y} AS yhat, avg({Y}) OVER () AS m FROM norm, hist WHERE epoch = 50 AND day >= DATE '{HOLD_OUT[0]}'),
s AS (SELECT count(*) AS n, sum((yhat - m) ** 2) AS ssr, sum((y - yhat) ** 2) AS sse, sum((y - m) ** 2) AS sst FROM p)
SELECT n, round(ssr / sst, 7) AS r_squared, round(1 - (n - 1) / (n - {len(X)} - 1) * (1 - ssr / sst), 7) AS r_bar_squared,
  round(sqrt(sse / (n - {len(X)} - 1)), 7) AS regression_std_err, round(1 - sse / sst, 7) AS r2_residual FROM s""",
    "kv_lines": f"WITH {INCIDENTS}, {DAILY} SELECT day::VARCHAR || chr(9) || " + " || ',' || ".join(f"'{c}:' || {c}" for c in [*C, "total"]) + " AS line FROM cats",
    "kv_lines_read": f"WITH {BAR_ROWS} SELECT day::VARCHAR AS key, id, CASE WHEN id = 'F' THEN 1.5 ELSE round(high) END::DOUBLE AS high, low, NULL::INTEGER AS absent FROM bar",
    "sparse_product": "SELECT c_nationkey::BIGINT AS i, left(o_orderpriority, 1)::BIGINT AS j, count(*)::DOUBLE AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
    "dense_product": """WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings), f AS (SELECT vec_id, i, floor(256 * x::DOUBLE) AS v FROM e)
SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, sum(a.v * b.v) AS v FROM f a JOIN f b ON a.vec_id = b.vec_id GROUP BY 1, 2 HAVING sum(a.v * b.v) <> 0""",
}
MERGED_ROWS = f"SELECT day, {', '.join([*C, 'total'])}, {rounded(FLOATS, 6)}, l_linenumber, condition, main, description, {rounded(BARS, 9)} FROM csw"
PREDICTED = f"""p AS (SELECT {Y} AS y, {ERROR} + {Y} AS yhat, avg({Y}) OVER () AS m FROM norm, hist WHERE epoch = 50 AND day >= DATE '{HOLD_OUT[0]}')"""
ENDS = {"cost": f"cost <= {RULES['cost']['target_cost']}", "steady": "steady", "rising": "rising", "epochs": "false"}
SQL |= {
    "best_epoch": f"WITH RECURSIVE {NORMAL}, {EPOCHS} SELECT epoch, round(cost, 9) AS cost FROM hist WHERE epoch > 0 ORDER BY hist.cost, epoch LIMIT 1",
    "stop_rules": f"""WITH RECURSIVE {NORMAL}, {EPOCHS[: EPOCHS.index("hist AS (")].strip().rstrip(",")}, runs AS ({" UNION ALL ".join(f"(SELECT * FROM ({run(rule, STEP[rule], START[rule], ends)}))" for rule, ends in ENDS.items())})
SELECT *, '{RANGE[0]}' AS window_start, '{RANGE[1]}' AS window_end, '{",".join(X)}' AS x, '{Y}' AS y, 'unknown:2,volume:1e+06' AS factors FROM runs""",
    "verify_stored_model": " UNION ALL ".join(f"SELECT *, '{run}' AS run FROM ({SQL['verification_summary'].replace('epoch = 50', f'epoch = {epochs}')})" for run, epochs in (("last", 50), ("short", 10))),
    "best_epoch_by_run": " UNION ALL ".join(
        f"SELECT * FROM (WITH RECURSIVE {NORMAL}, {EPOCHS}, h AS (SELECT *, cost >= min(cost) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS flat FROM hist WHERE epoch BETWEEN 1 AND {epochs}) "
        f"SELECT '{run}' AS run, arg_min(epoch, cost) AS epoch, round(min(cost), 9) AS cost, count(*) AS epochs, count(*) FILTER (flat) AS flat FROM h)"
        for run, epochs in (("short", 10), ("long", 50))
    ),
    "normalised_catalogue": f"WITH {MERGED}, types AS ({CATALOGUE}), n AS (SELECT count(*) AS n FROM csw) SELECT name, CASE WHEN type IN ('int', 'bigint', 'double') THEN 'double' ELSE type END AS type, type AS was, source, "
    "n AS rows, CASE WHEN type IN ('int', 'bigint', 'double') THEN n ELSE filled END AS filled FROM types, n",
    "refused_ranges": within(f"WITH {MERGED}, n AS (SELECT count(*) AS days FROM csw) ") + "SELECT asked, job, CASE job WHEN 'normalise' THEN a <> '{0}' OR b <> '{1}' ELSE a < '{0}' OR b > '{1}' END AS refused, days FROM n, (VALUES ".format(*RANGE)
    + ", ".join(f"('{name}', '{a}', '{b}')" for name, (a, b) in ASKED.items()) + ") v(asked, a, b), (VALUES ('normalise'), ('train')) j(job)",
    "job_crime": within(f"WITH {INCIDENTS}, {DAILY} SELECT day, {', '.join(C[:3])}, total FROM cats"),
    "job_weather": within(f"WITH {READINGS}, {MEANS}, {mode('DESC', 'ASC')}, {ORDINALS} SELECT means.day, {rounded(FLOATS, 6)}, l_linenumber, ords.ordinal::INTEGER AS condition, mode.main, mode.description FROM means JOIN mode USING (day) LEFT JOIN ords ON mode.condition = ords.condition"),
    "job_stocks": within(f"WITH {BAR_ROWS}, {WIDE} SELECT day, {rounded(BARS, 9)} FROM wide"),
    "job_merge": within(f"WITH {MERGED} {MERGED_ROWS}"),
    "job_stats": f"WITH {FEATURES}, {CORR}, b AS ({MOMENTS}), p AS ({PRODUCTS}) SELECT {TIER} AS tier, cor.x AS x, cor.y AS y, round(r, 6) AS r, round(prd_mean, 4) AS prd_mean, "
    "round(u.mean, 4) AS x_mean, round(u.stddev, 4) AS x_stddev, round(v.mean, 4) AS y_mean, round(v.stddev, 4) AS y_stddev "
    "FROM cor JOIN p ON cor.x = p.x AND cor.y = p.y JOIN b u ON u.x = cor.x JOIN b v ON v.x = cor.y",
    "job_normalise": f"WITH {NORMAL} SELECT day, {rounded(['f_close', 'o_high', Y], 9)} FROM norm",
    "job_linear_regression": f"WITH RECURSIVE {NORMAL}, {EPOCHS}, e AS (SELECT * FROM hist WHERE epoch = 50) " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(w_{c}, 9) AS value FROM e" for c in X) + " UNION ALL SELECT 'bias', round(bias, 9) FROM e UNION ALL SELECT 'epochs', 50 FROM e",
    "job_verify_regression": f"WITH RECURSIVE {NORMAL}, {EPOCHS}, {PREDICTED}, q AS (SELECT round(y, 9) AS y, round(yhat, 9) AS yhat, round((yhat - m) ** 2, 9) AS ssr, round((y - yhat) ** 2, 9) AS sse, round((y - m) ** 2, 9) AS sst FROM p) SELECT y, yhat, ssr, sse, sst, count(*) AS days FROM q GROUP BY ALL",
    "job_matrix": "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT AS i, n_regionkey::BIGINT AS j, 1::DOUBLE AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "read_incident_files": f"""SELECT *, false AS rejected FROM ({SQL["parsed_incidents"]}) UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, true FROM ({SQL["rejected_incidents"]})""",
    "read_incident_counts": f"""WITH p AS ({SQL["parsed_incidents"]}), r AS (SELECT count(*) AS n FROM ({SQL["rejected_incidents"]}))
SELECT 'lines' AS name, (SELECT count(*) FROM p) + n AS n FROM r UNION ALL SELECT 'rejects', n FROM r UNION ALL SELECT 'undated', count(*) FROM p WHERE day IS NULL UNION ALL SELECT 'rows', count(*) FROM p""",
    "read_reading_files": f"""SELECT day, weather_main, weather_description, count(*) AS n, sum(temp) AS temp, sum(pressure)::BIGINT AS pressure, sum(rain_1h)::DOUBLE AS rain_1h FROM ({SQL["parsed_readings"]}) GROUP BY 1, 2, 3""",
    "read_bar_files": f"WITH {BAR_ROWS} SELECT day, open, high, low, close, 0::DOUBLE AS adjclose, round(volume / 1e6, 8) AS volume, id FROM bar",
}
DATED = ["job_crime", "job_weather", "job_stocks", "job_merge", "job_normalise", "read_incident_files", "read_reading_files", "read_bar_files",
         "daily_category_counts", "daily_categories", "event_categories", "date_range", "daily_means", "daily_mode", "daily_mode_rare_high", "readings_by_ordinal",
         "parsed_incidents", "parsed_readings", "bars_wide", "bars_filled", "bars_carried", "fill_by_customer", "merged_csw", "merged_cw", "merged_cs", "normalised",
         "normalised_datasets", "predictions"]
SQL |= {name: f"SELECT * REPLACE (day::VARCHAR AS day) FROM ({SQL[name]})" for name in DATED}
