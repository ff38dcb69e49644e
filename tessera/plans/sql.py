"""SQL texts of the panel operators, for comparison on another engine. Each builder returns a chain of CTEs."""

from __future__ import annotations

OUTCOMES = {
    "nation_quarter": "SELECT CAST(c_nationkey AS BIGINT) AS unit, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS time, AVG(o_totalprice) / 1000 AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "nation_month": "SELECT CAST(c_nationkey AS BIGINT) AS unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS time, AVG(o_totalprice) / 1000 AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "supplier_quarter": "SELECT l_suppkey AS unit, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS time, SUM(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1, 2",
    "supplier_month": "SELECT l_suppkey AS unit, CAST(date_trunc('month', l_shipdate) AS DATE) AS time, SUM(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1, 2",
    "user_day": "SELECT user_id AS unit, CAST(date_trunc('day', ts) AS DATE) AS time, SUM(value) AS y FROM events GROUP BY 1, 2",
}


def cells(panel: str, reversals: bool = False) -> str:
    """CTE ``cells``: the densified panel (unit, time, time_ix, y, d, i_obs, g, x1, ever)."""
    off = " AND NOT (unit % 2 = 0 AND time_ix >= 16 + unit % 5)" if reversals else ""
    return f"""obs AS ({OUTCOMES[panel]}),
ranks AS (SELECT time, row_number() OVER (ORDER BY time) AS time_ix FROM (SELECT DISTINCT time FROM obs)),
grid AS (SELECT u.unit, r.time, r.time_ix FROM (SELECT DISTINCT unit FROM obs) u, ranks r),
cells0 AS (SELECT g.unit, g.time, CAST(g.time_ix AS INT) AS time_ix, o.y, CASE WHEN o.y IS NULL THEN NULL WHEN g.unit % 3 = 1 AND g.time_ix >= 10 + g.unit % 5{off.replace('unit', 'g.unit').replace('time_ix', 'g.time_ix')} THEN 1 ELSE 0 END AS d,
  CASE WHEN o.y IS NULL THEN 0 ELSE 1 END AS i_obs, CAST(g.unit % 4 AS VARCHAR) AS g, CASE WHEN o.y IS NULL THEN NULL ELSE ((g.unit * 7 + g.time_ix * 13 + g.unit * g.time_ix) % 11) / 10.0 END AS x1
  FROM grid g LEFT JOIN obs o ON o.unit = g.unit AND o.time = g.time),
cells AS (SELECT *, MAX(COALESCE(d, 0)) OVER (PARTITION BY unit) AS ever FROM cells0)"""


def event_time(source: str, to: str, name: str, d: str = "d", off: bool = False) -> str:
    """CTEs that add event time ``to`` to ``source``; the last is called ``name``."""
    v = f"last_value({d} IGNORE NULLS) OVER (PARTITION BY unit ORDER BY time_ix ROWS UNBOUNDED PRECEDING)"
    v = f"1 - {v}" if off else v
    return f"""{name}_v AS (SELECT *, {v} AS v_ FROM {source}),
{name}_c AS (SELECT *, CASE WHEN v_ <> lag(v_) OVER (PARTITION BY unit ORDER BY time_ix) THEN 1 ELSE 0 END AS chg_ FROM {name}_v),
{name}_r AS (SELECT *, CASE WHEN v_ IS NOT NULL THEN SUM(chg_) OVER (PARTITION BY unit ORDER BY time_ix ROWS UNBOUNDED PRECEDING) END AS run_ FROM {name}_c),
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY unit, run_ ORDER BY time_ix) AS pos_, COUNT(*) OVER (PARTITION BY unit, run_) AS len_, MAX(run_) OVER (PARTITION BY unit) AS last_ FROM {name}_r),
{name} AS (SELECT * EXCLUDE (v_, chg_, run_, pos_, len_, last_), CAST(CASE WHEN v_ = 1 AND run_ > 0 THEN pos_ WHEN v_ = 0 AND run_ < last_ THEN pos_ - len_ END AS INT) AS {to} FROM {name}_p)"""


UNEVEN_RAW = f"""obs AS ({OUTCOMES["supplier_month"]}),
rk AS (SELECT time, row_number() OVER (ORDER BY time) AS rank FROM (SELECT DISTINCT time FROM obs)),
raw AS (SELECT o.unit, o.time, CASE WHEN (o.unit * 3 + rank) % 17 = 0 THEN NULL WHEN (o.unit * 5 + rank) % 29 = 0 THEN CAST('inf' AS DOUBLE) ELSE o.y END AS y,
  CASE WHEN o.unit % 20 = 3 THEN 1 WHEN o.unit % 3 = 1 AND rank >= 10 + o.unit % 5 AND NOT (o.unit % 2 = 0 AND rank >= 16 + o.unit % 5) THEN 1 ELSE 0 END AS d,
  CAST(CASE WHEN (o.unit + rank) % 13 = 0 THEN 0 ELSE 1 + (o.unit + rank) % 4 END AS DOUBLE) AS w FROM obs o JOIN rk USING (time)),
pruned AS (SELECT unit, time, CASE WHEN isinf(y) THEN NULL ELSE y END AS y, d, w FROM raw WHERE w > 0)"""


def uneven_cells(na_rm: bool = False) -> str:
    """CTE ``cells`` of the uneven panel, with weights."""
    rows = "(SELECT * FROM pruned WHERE y IS NOT NULL AND d IS NOT NULL)" if na_rm else "pruned"
    return f"""{UNEVEN_RAW},
used AS (SELECT * FROM {rows}),
ranks AS (SELECT time, row_number() OVER (ORDER BY time) AS time_ix FROM (SELECT DISTINCT time FROM used)),
grid AS (SELECT u.unit, r.time, r.time_ix FROM (SELECT DISTINCT unit FROM used) u, ranks r),
cells AS (SELECT g.unit, g.time, CAST(g.time_ix AS INT) AS time_ix, o.y, o.d, COALESCE(o.w, 1) AS w, CASE WHEN o.y IS NULL THEN 0 ELSE 1 END AS i_obs, CAST(g.unit % 4 AS VARCHAR) AS g,
  MAX(COALESCE(o.d, 0)) OVER (PARTITION BY g.unit) AS ever FROM grid g LEFT JOIN used o ON o.unit = g.unit AND o.time = g.time)"""


def masked(panel: str, reversals: bool = False) -> str:
    """``base``: cells with t_on, t_off and ii."""
    return (uneven_cells() if panel == "uneven" else cells(panel, reversals)) + ",\n" + event_time("cells", "t_on", "e_on") + ",\n" + event_time("e_on", "t_off", "e_off", off=True) + ",\nbase AS (SELECT *, CASE WHEN i_obs = 1 AND COALESCE(d, 0) = 0 THEN 1 ELSE 0 END AS ii FROM e_off)"


def never_treated(panel: str = "supplier_quarter") -> str:
    """``fit``: base with the closed-form counterfactual and eff."""
    return masked(panel) + """,
m AS (SELECT time_ix, AVG(CASE WHEN ever = 0 THEN y END) AS m FROM base GROUP BY time_ix),
onset AS (SELECT unit, MIN(CASE WHEN d = 1 THEN time_ix END) AS first_ FROM base GROUP BY unit),
own AS (SELECT b.unit, AVG(b.y - m.m) AS a FROM base b JOIN m USING (time_ix) JOIN onset o USING (unit) WHERE b.ii = 1 AND (o.first_ IS NULL OR b.time_ix < o.first_) GROUP BY b.unit),
fit AS (SELECT b.*, m.m + own.a AS y0, CASE WHEN i_obs = 1 THEN b.y - (m.m + own.a) END AS eff FROM base b JOIN m USING (time_ix) LEFT JOIN own USING (unit))"""


def two_way(source: str, y: str = "y", rounds: int = 80, weight: str = "1.0", name: str = "fe") -> str:
    """``fe``: source with y0 of the two-way least-squares fit on its usable cells, by averaging units and periods in turn.

    The chain must begin with WITH RECURSIVE."""

    def mean(value: str, by: str) -> str:
        return f"SUM(CASE WHEN ii = 1 THEN wt * ({value}) END) OVER (PARTITION BY {by}) / SUM(CASE WHEN ii = 1 THEN wt END) OVER (PARTITION BY {by})"

    return f"""{name}_it AS (SELECT unit, time_ix, CAST({y} AS DOUBLE) AS v, ii, CAST({weight} AS DOUBLE) AS wt, 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS x FROM {source}
  UNION ALL SELECT unit, time_ix, v, ii, wt, k + 1, a2, {mean("v - a2", "time_ix")} FROM (SELECT *, {mean("v - x", "unit")} AS a2 FROM {name}_it WHERE k < {rounds})),
{name} AS (SELECT s.*, i.a + i.x AS y0 FROM {source} s JOIN {name}_it i ON i.unit = s.unit AND i.time_ix = s.time_ix AND i.k = {rounds})"""


def top_singular(source: str, rounds: int = 300, name: str = "top") -> str:
    """``top``: s, the largest singular value of source's e (units x periods), by power iteration; ``top_v``: its vector by period. Needs WITH RECURSIVE."""
    return f"""{name}_it AS (SELECT unit, time_ix, e, 0 AS k, CAST(SIN(time_ix) AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS s2 FROM {source}
  UNION ALL SELECT unit, time_ix, e, k + 1, g / SQRT(SUM(g * g) OVER (PARTITION BY unit)), SQRT(SUM(g * g) OVER (PARTITION BY unit)) FROM (SELECT *, SUM(e * u) OVER (PARTITION BY time_ix) AS g FROM (SELECT *, SUM(e * v) OVER (PARTITION BY unit) AS u FROM {name}_it WHERE k < {rounds}))),
{name} AS (SELECT SQRT(MAX(s2)) AS s FROM {name}_it WHERE k = {rounds}), {name}_v AS MATERIALIZED (SELECT time_ix, MAX(v) AS v FROM {name}_it WHERE k = {rounds} GROUP BY time_ix)"""


def rank_one(source: str, rounds: int = 300, rho: str = "0", name: str = "ife", start: str = "top_v") -> str:
    """``ife``: source with y0 of unit and period effects and one factor, by least squares on usable cells with a ridge ``rho`` on loadings and
    factor: each round regresses every unit on the factor and then every period on the loadings. It starts from ``start`` (time_ix, v): the loss has several
    minima where no factor stands out. Needs WITH RECURSIVE."""
    own = lambda value, by: f"AVG(CASE WHEN ii = 1 THEN {value} END) OVER (PARTITION BY {by})"
    slope = lambda a, b, by: f"SUM(CASE WHEN ii = 1 THEN ({a}) * ({b}) END) OVER (PARTITION BY {by}) / (SUM(CASE WHEN ii = 1 THEN ({a}) * ({a}) END) OVER (PARTITION BY {by}) + {rho})"
    return f"""{name}_it AS (SELECT unit, time_ix, CAST(y AS DOUBLE) AS v, ii, 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS l, CAST(s.v AS DOUBLE) AS f FROM {source} JOIN {start} s USING (time_ix)
  UNION ALL SELECT unit, time_ix, v, ii, k + 1, a, mq - f2 * ml, l, f2 FROM (SELECT *, {slope("l - ml", "v - a - mq", "time_ix")} AS f2 FROM (SELECT *, {own("l", "time_ix")} AS ml, {own("v - a", "time_ix")} AS mq FROM
  (SELECT unit, time_ix, v, ii, k, f, l2 AS l, mr - l2 * mf AS a FROM (SELECT *, {slope("f - mf", "v - x - mr", "unit")} AS l2 FROM (SELECT unit, time_ix, v, ii, k, f, x, {own("f", "unit")} AS mf, {own("v - x", "unit")} AS mr FROM {name}_it WHERE k < {rounds})))))),
{name} AS (SELECT s.*, i.a + i.x + i.l * i.f AS y0 FROM {source} s JOIN {name}_it i ON i.unit = s.unit AND i.time_ix = s.time_ix AND i.k = {rounds})"""


def demeaned(source: str, columns: tuple[str, ...], by: tuple[str, str] = ("unit", "time_ix"), rounds: int = 80, name: str = "dm") -> str:
    """``dm``: source's rows with the columns freed from both kinds of means, one after the other. Needs WITH RECURSIVE."""
    keep = ", ".join(dict.fromkeys(c.strip() for part in by for c in part.split(",")))
    once = ", ".join(f"{c} - AVG({c}) OVER (PARTITION BY {by[0]}) AS {c}" for c in columns)
    twice = ", ".join(f"{c} - AVG({c}) OVER (PARTITION BY {by[1]}) AS {c}" for c in columns)
    start = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"""{name}_it AS (SELECT {keep}, 0 AS k, {start} FROM {source} UNION ALL SELECT {keep}, k + 1, {twice} FROM (SELECT {keep}, k, {once} FROM {name}_it WHERE k < {rounds})),
{name} AS (SELECT * FROM {name}_it WHERE k = {rounds})"""


def means(panel: str, force: str, reversals: bool = False) -> str:
    """``fit`` by the grand, unit or period mean of usable cells."""
    by = {"none": "", "unit": "PARTITION BY unit", "time": "PARTITION BY time_ix"}[force]
    return masked(panel, reversals) + f""",
fit0 AS (SELECT *, AVG(CASE WHEN ii = 1 THEN y END) OVER ({by}) AS y0 FROM base),
fit AS (SELECT *, CASE WHEN i_obs = 1 THEN y - y0 END AS eff FROM fit0)"""
