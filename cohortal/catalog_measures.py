"""Queries from filed facts to measures, over the stand-in filings, and their oracle SQL.

The SQL states the rules once more over plain tables: visibility, concepts to items, balance sheets, quarters, years,
trailing twelve months by a recursive walk, debt paths, and every measure by its formula.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions import stats
from cohortal.functions.spec import METRICS as _METRICS
from cohortal.functions.spec import BY_CONCEPT, DEBT_ITEMS, DEBT_LIKE, DEBT_NOISE, DEBT_PARTS, DEBT_SLICES, LARGEST_WINS, LINE_ITEMS
from cohortal.operators import temporal as t
from cohortal.plans import filings as f
from cohortal.plans import intake, month, score
from cohortal.plans import measures as m
from cohortal.plans.stage import dealt, materialised, written
from cohortal.registry import half_up_sql as _hu
from cohortal.registry import query

_DAY = f"DATE '{f.AS_OF}'"
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_ITEMS = [x for x in LINE_ITEMS if x not in BY_CONCEPT]
_REGISTRY = ", ".join(f"('{i}', '{c}', {k}, {str(i in LARGEST_WINS).lower()}, {str(i in BY_CONCEPT).lower()})" for i, cs in LINE_ITEMS.items() for k, c in enumerate(cs))


def _wide(source: str, prefix: str, column: str = "val", items=_ITEMS) -> str:
    """One column for each item."""
    return ", ".join(f"max({column}) FILTER (item = '{i}') AS {prefix}_{i}" for i in items)


def _debt(inst: str, out: str) -> str:
    """CTE ``out`` (entity, value, how): the best debt path of a table of instants."""
    parts = f"""(SELECT entity, max(val) FILTER (item = 'debt_lt_current') AS cur, max(val) FILTER (item = 'debt_short') AS short FROM {inst} GROUP BY 1)"""
    return f"""{out}_all AS (
  SELECT entity, en, 0 AS place, val AS value, 'combined-tag' AS how, concept FROM {inst} WHERE item = 'debt_combined'
  UNION ALL SELECT i.entity, en, 1, val + coalesce(cur, 0) + coalesce(short, 0), 'noncurrent+current+short', concept FROM {inst} i JOIN {parts} USING (entity) WHERE item = 'debt_noncurrent'
  UNION ALL SELECT i.entity, en, 2, val + coalesce(short, 0), 'longtermdebt+short', concept FROM {inst} i JOIN {parts} USING (entity) WHERE item = 'debt_lt_total'),
{out} AS (
  SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.value, b.value) AS value, coalesce(a.how, 'current+short-only') AS how FROM (
    SELECT * FROM {out}_all x WHERE NOT (concept IN ({_list(DEBT_PARTS)}) AND EXISTS (
      SELECT 1 FROM {out}_all o WHERE o.entity = x.entity AND (o.en < x.en OR (o.en = x.en AND o.place > x.place)) AND x.value < 0.75::DOUBLE * o.value))
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY en DESC, place) = 1) a
  FULL JOIN (SELECT entity, coalesce(cur, 0) + coalesce(short, 0) AS value FROM {parts} WHERE cur IS NOT NULL OR short IS NOT NULL) b ON a.entity = b.entity)"""


_FACTS = f"""{f.SQL.format(lineitem="lineitem", orders="orders")},
caps AS (SELECT s_suppkey AS entity, nullif(CASE WHEN s_suppkey % 11 <> 0 THEN round(abs(s_acctbal) * 100) * 1000.0::DOUBLE END, 0) AS cap FROM supplier),
registry(item, concept, priority, nested, single) AS (VALUES {_REGISTRY}),
placed AS (SELECT *, CASE taxonomy WHEN 'us-gaap' THEN 1 WHEN 'ifrs-full' THEN 2 ELSE 3 END AS place FROM filed_facts),
first_taxonomy AS (SELECT * FROM placed QUALIFY place = min(place) OVER (PARTITION BY entity, concept)),
seen AS (SELECT * FROM first_taxonomy WHERE filed <= {_DAY} AND form IN ({_list(t.FORMS)}) AND unit IN ('USD', 'pure', 'shares')),
tagged AS (
  SELECT entity, CASE WHEN single THEN item || ':' || concept ELSE item END AS item, concept, st, en, val, filed, priority, nested AND st IS NOT NULL AS nested
  FROM seen JOIN registry USING (concept) QUALIFY row_number() OVER (PARTITION BY entity, item, concept, st, en ORDER BY filed DESC) = 1),
single AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY entity, item, st, en
  ORDER BY CASE WHEN nested THEN filed END DESC NULLS LAST, CASE WHEN nested THEN val END DESC NULLS LAST, priority) = 1),
anchors AS (SELECT entity, max(en) AS anchor FROM (
  SELECT entity, en FROM filed_facts WHERE taxonomy = 'us-gaap' AND st IS NULL AND val IS NOT NULL AND form IN ({_list(t.FORMS)}) AND filed <= {_DAY} AND en <= filed
  GROUP BY entity, en HAVING count(DISTINCT concept) >= 5) GROUP BY 1),
items AS (SELECT s.*, anchor FROM single s LEFT JOIN anchors USING (entity)),
inst AS (SELECT * FROM (SELECT entity, item, concept, en, val, anchor FROM items WHERE st IS NULL AND en <= {_DAY}
  QUALIFY row_number() OVER (PARTITION BY entity, item ORDER BY en DESC) = 1) WHERE anchor IS NULL OR en >= anchor - 300),
flow AS (SELECT * FROM items WHERE st IS NOT NULL),
tails AS (SELECT a.entity, a.item, (b.en + 1)::DATE AS st, a.en, a.val - b.val AS val, greatest(a.filed, b.filed) AS filed, a.st AS since
  FROM flow a JOIN flow b ON a.entity = b.entity AND a.item = b.item AND a.st = b.st AND a.en - b.en BETWEEN 80 AND 400),
ends AS (SELECT *, max(en) OVER (PARTITION BY entity, item) AS newest, row_number() OVER (PARTITION BY entity, item ORDER BY en DESC) - 1 AS k FROM (
  SELECT * FROM flow WHERE en - st BETWEEN 330 AND 400 QUALIFY row_number() OVER (PARTITION BY entity, item, en ORDER BY filed DESC, st) = 1)),
years AS (SELECT * FROM ends WHERE (anchor IS NULL OR newest >= anchor - 300) AND k < 6),
threes AS (SELECT entity, item, st, en, val, filed, 0 AS tail, st AS since FROM flow UNION ALL SELECT entity, item, st, en, val, filed, 1, since FROM tails),
q AS (SELECT entity, item, en, val FROM threes x WHERE en - st BETWEEN 80 AND 100 AND (tail = 1 OR NOT EXISTS (
    SELECT 1 FROM flow y WHERE y.entity = x.entity AND y.item = x.item AND y.en = x.en AND y.en - y.st BETWEEN 330 AND 400 AND abs(x.val - y.val) <= 0.01::DOUBLE * abs(y.val)))
  QUALIFY row_number() OVER (PARTITION BY entity, item, en ORDER BY tail, filed DESC, since, st) = 1),
walk AS (
  SELECT entity, item, max(en) AS at, 0::BIGINT AS covered, 0.0::DOUBLE AS total, 0 AS n FROM threes GROUP BY 1, 2
  UNION ALL
  SELECT entity, item, (p.st - 1)::DATE, covered + p.days, total + p.val, n + 1 FROM (
    SELECT w.entity, w.item, w.covered, w.total, w.n, max({{'days': p.en - p.st, 'o': DATE '1970-01-01' - p.en, 'tail': -p.tail, 'st': p.st, 'val': p.val}}) AS p
    FROM walk w JOIN threes p ON p.entity = w.entity AND p.item = w.item AND abs(p.en - w.at) <= 4 AND p.en - p.st <= 366 - w.covered + 12
    WHERE w.covered < 350 AND w.n < 6 GROUP BY w.entity, w.item, w.covered, w.total, w.n)),
tiles AS (SELECT w.entity, w.item, covered, total, n, l.last, l.anchor FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY entity, item ORDER BY n DESC) = 1) w
  JOIN (SELECT entity, item, max(en) AS last, max(anchor) AS anchor FROM flow GROUP BY 1, 2) l ON l.entity = w.entity AND l.item = w.item),
ttm AS (
  SELECT entity, item, last AS en, total AS val, CASE WHEN n = 1 THEN 'fy' ELSE 'ttm' END AS basis FROM tiles
  WHERE covered BETWEEN 350 AND 380 AND (anchor IS NULL OR last >= anchor - CASE WHEN n = 1 THEN 300 ELSE 120 END)
  UNION ALL SELECT y.entity, y.item, y.en, y.val, 'fy' FROM tiles w JOIN years y ON y.entity = w.entity AND y.item = w.item AND y.k = 0 WHERE covered NOT BETWEEN 350 AND 380)"""

_DEBT = f"""{_FACTS},
back AS (SELECT entity, (en - 365)::DATE AS day FROM inst WHERE item = 'assets'),
before AS (SELECT * FROM (SELECT i.entity, item, concept, en, val, day FROM items i JOIN back USING (entity) WHERE st IS NULL AND en <= day
  QUALIFY row_number() OVER (PARTITION BY i.entity, item ORDER BY en DESC) = 1) WHERE en >= day - 300),
near AS (SELECT i.entity, item, val FROM items i JOIN back USING (entity) WHERE st IS NULL AND item IN ('equity', 'cash', 'assets') AND abs(en - day) <= 45
  QUALIFY row_number() OVER (PARTITION BY i.entity, item ORDER BY abs(en - day), en) = 1),
borrowed AS (SELECT entity, en, val FROM tagged WHERE item IN ({_list(DEBT_ITEMS)}) AND st IS NULL AND en <= {_DAY}),
last_zero AS (SELECT entity, bool_and(val = 0) AS zero FROM (SELECT * FROM borrowed QUALIFY en = max(en) OVER (PARTITION BY entity)) GROUP BY 1),
prior_zero AS (SELECT entity, bool_and(val = 0) AS zero FROM (SELECT b.* FROM borrowed b JOIN back USING (entity) WHERE en <= day QUALIFY en = max(en) OVER (PARTITION BY b.entity)) GROUP BY 1),
ever AS (SELECT DISTINCT entity FROM filed_facts WHERE taxonomy = 'us-gaap' AND regexp_matches(concept, '{DEBT_LIKE}') AND NOT regexp_matches(concept, '{DEBT_NOISE}')
  UNION SELECT entity FROM filed_facts WHERE concept IN ({_list(DEBT_SLICES)}) AND st IS NULL AND filed <= {_DAY}),
{_debt("inst", "now_debt")},
{_debt("before", "prior_debt")},
i AS (SELECT entity, {_wide("inst", "i")} FROM inst GROUP BY 1),
b AS (SELECT entity, {_wide("before", "b", items=["equity", "assets"])} FROM before GROUP BY 1),
n AS (SELECT entity, {_wide("near", "n", items=["equity", "cash", "assets"])} FROM near GROUP BY 1),
filers AS (SELECT c.entity, cap, anchor FROM caps c LEFT JOIN anchors USING (entity)),
debts AS (
  SELECT x.entity,
    coalesce(d.value, CASE WHEN coalesce(z.zero, false) THEN 0 WHEN z.zero IS NULL AND e.entity IS NULL AND anchor IS NOT NULL AND i_equity IS NOT NULL AND i_assets IS NOT NULL THEN 0 END)::DOUBLE AS debt,
    coalesce(d.how, CASE WHEN coalesce(z.zero, false) THEN 'last-reported-zero'
      WHEN z.zero IS NULL AND e.entity IS NULL AND anchor IS NOT NULL AND i_equity IS NOT NULL AND i_assets IS NOT NULL THEN 'no debt tag ever filed' ELSE 'unresolved' END) AS debt_path,
    coalesce(p.value, CASE WHEN coalesce(pz.zero, false) THEN 0 WHEN pz.zero IS NULL AND e.entity IS NULL AND anchor IS NOT NULL AND b_equity IS NOT NULL AND b_assets IS NOT NULL THEN 0 END)::DOUBLE AS prior_debt
  FROM filers x LEFT JOIN now_debt d USING (entity) LEFT JOIN prior_debt p USING (entity) LEFT JOIN last_zero z USING (entity) LEFT JOIN prior_zero pz USING (entity)
  LEFT JOIN ever e ON e.entity = x.entity LEFT JOIN i ON i.entity = x.entity LEFT JOIN b ON b.entity = x.entity)"""

_LEVELS = f"""{_DEBT},
tt AS (SELECT entity, {_wide("ttm", "t")}, max(en) FILTER (item = 'net_income') AS ni_end, max(en) FILTER (item = 'ocf') AS ocf_end FROM ttm GROUP BY 1),
yy AS (SELECT entity, {", ".join(f"max(val) FILTER (item = '{x}' AND k = {k}) AS y{k}_{x}" for x in ("net_income", "da", "nii", "premiums", "revenue") for k in (0, 3))} FROM years GROUP BY 1),
lately AS (SELECT entity, max(val) FILTER (item LIKE 'one_off_gain:%') AS gain, max(val) FILTER (item LIKE 'one_off_charge:%') AS charge
  FROM flow WHERE item LIKE 'one_off%' AND val > 0 AND anchor - en BETWEEN 0 AND 370 GROUP BY 1),
moved AS (SELECT a.entity, a.item, a.en, a.val, a.val - (SELECT max_by(o.val, o.en) FROM q o WHERE o.entity = a.entity AND o.item = a.item AND a.en - o.en BETWEEN 350 AND 380) AS move,
    row_number() OVER (PARTITION BY a.entity, a.item ORDER BY a.en DESC) AS k, count(*) OVER (PARTITION BY a.entity, a.item) AS n FROM q a WHERE item IN ('operating_income', 'net_income')),
shown AS (SELECT * FROM moved WHERE k <= 4 AND n >= 8 AND move IS NOT NULL),
known AS (
  SELECT x.entity, x.cap, x.anchor, debt, debt_path, prior_debt, i.* EXCLUDE (entity), tt.* EXCLUDE (entity), yy.* EXCLUDE (entity), n.* EXCLUDE (entity),
    nullif(i_assets, 0) AS assets, coalesce(i_cash, 0) AS cash, coalesce(i_liabilities, i_balance_total - i_equity) AS liabilities,
    CASE WHEN t_pretax > 0 AND t_tax IS NOT NULL THEN least(greatest(t_tax / t_pretax, 0), 0.35::DOUBLE) ELSE 0.21::DOUBLE END AS tax,
    coalesce(t_revenue - t_cost, t_gross_profit) AS gross,
    coalesce(t_operating_income, t_revenue - t_cost - t_operating_expense, t_revenue - t_costs_and_expenses, t_pretax + t_interest) AS ebit0,
    CASE WHEN t_operating_income IS NOT NULL THEN 'OperatingIncomeLoss' WHEN t_revenue - t_cost - t_operating_expense IS NOT NULL THEN 'derived: Rev - COGS - OpEx'
      WHEN t_revenue - t_costs_and_expenses IS NOT NULL THEN 'derived: Rev - CostsAndExpenses' WHEN t_pretax + t_interest IS NOT NULL THEN 'derived: pretax income + interest expense' ELSE 'unresolved' END AS ebit_path,
    coalesce(gain, 0) AS gain, coalesce(charge, 0) AS charge
  FROM filers x LEFT JOIN debts USING (entity) LEFT JOIN i USING (entity) LEFT JOIN tt USING (entity) LEFT JOIN yy USING (entity) LEFT JOIN n USING (entity) LEFT JOIN lately USING (entity)),
kept AS (
  SELECT entity,
    CASE WHEN EXISTS (SELECT 1 FROM shown s WHERE s.entity = x.entity AND item = 'operating_income' AND move >= 0.5::DOUBLE * gain AND val >= gain) THEN gain ELSE 0 END AS op_gain,
    CASE WHEN EXISTS (SELECT 1 FROM shown s WHERE s.entity = x.entity AND item = 'operating_income' AND -move >= 0.5::DOUBLE * charge) THEN charge ELSE 0 END AS op_charge,
    CASE WHEN EXISTS (SELECT 1 FROM shown s WHERE s.entity = x.entity AND item = 'net_income' AND move >= 0.5::DOUBLE * gain * (1 - tax)) THEN gain * (1 - tax) ELSE 0 END AS ni_gain,
    CASE WHEN EXISTS (SELECT 1 FROM shown s WHERE s.entity = x.entity AND item = 'net_income' AND -move >= 0.5::DOUBLE * charge * (1 - tax)) THEN charge * (1 - tax) ELSE 0 END AS ni_charge
  FROM known x),
net AS (
  SELECT x.*, CASE WHEN anchor IS NOT NULL AND greatest(abs(ebit0), 0.02::DOUBLE * coalesce(t_revenue, 0)) > 0 AND op_charge <> op_gain
      AND abs(op_charge - op_gain) >= 0.25::DOUBLE * greatest(abs(ebit0), 0.02::DOUBLE * coalesce(t_revenue, 0)) THEN ebit0 + op_charge - op_gain ELSE ebit0 END AS ebit,
    CASE WHEN anchor IS NOT NULL AND greatest(abs(t_net_income), 0.02::DOUBLE * coalesce(t_revenue, 0), 0.005::DOUBLE * coalesce(i_assets, 0)) > 0 AND ni_charge <> ni_gain
      AND abs(ni_charge - ni_gain) >= 0.25::DOUBLE * greatest(abs(t_net_income), 0.02::DOUBLE * coalesce(t_revenue, 0), 0.005::DOUBLE * coalesce(i_assets, 0)) THEN t_net_income + ni_charge - ni_gain ELSE t_net_income END AS ni
  FROM known x JOIN kept USING (entity)),
figures AS (
  SELECT *, ebit + t_da AS ebitda, ni + t_da AS ffo, cap + debt - cash AS ev, debt + i_equity - cash AS close_ic, prior_debt + n_equity - coalesce(n_cash, 0) AS open_ic,
    i_equity - coalesce(i_preferred, 0) - i_goodwill - coalesce(i_intangibles, 0) AS tangible, nullif(greatest(t_nii + t_noninterest_income, 0), 0) AS bank_revenue FROM net)"""

_SERIES = f"""{_LEVELS},
points AS (SELECT * FROM (SELECT entity, item, en, sum(val) OVER w AS v, en - lag(en, 3) OVER (PARTITION BY entity, item ORDER BY en) AS span FROM q
  WINDOW w AS (PARTITION BY entity, item ORDER BY en ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE span <= 300),
asset AS (SELECT entity, en, val FROM items WHERE item = 'assets' AND st IS NULL),
match AS (SELECT y.entity, y.item, y.en, abs(sum(q.val) - y.val) <= 0.05::DOUBLE * abs(y.val) AS ok FROM years y JOIN q ON q.entity = y.entity AND q.item = y.item AND q.en > y.en - 355 AND q.en <= y.en + 10
  WHERE y.k < 5 AND y.val <> 0 GROUP BY y.entity, y.item, y.en, y.val HAVING count(*) = 4),
rev AS (SELECT p.*, max(en) OVER (PARTITION BY p.entity) AS last FROM points p WHERE item = 'revenue'),
rev_now AS (SELECT r.* FROM rev r JOIN anchors USING (entity) WHERE anchor - last <= 120),
rev_fit AS (SELECT entity, regr_slope(ln(CASE WHEN v > 0 THEN v END), (en - DATE '1970-01-01') / 365.25::DOUBLE) AS slope, count(*) AS n, min(en) AS since, min(v) AS least, min_by(v, en) AS first FROM rev_now WHERE last - en <= 1125 GROUP BY 1),
rev_trend AS (SELECT entity, exp(slope) - 1 AS trend FROM rev_fit x WHERE n >= 9 AND least > 0 AND first >= 50e6
  AND NOT EXISTS (SELECT 1 FROM match o WHERE o.entity = x.entity AND o.item = 'revenue' AND o.en >= since - 280 AND NOT ok)),
rev_last AS (SELECT a.entity, CASE WHEN b.v > 0 THEN a.v / b.v - 1 END AS latest FROM rev_now a JOIN (SELECT entity FROM rev_now GROUP BY 1 HAVING count(*) >= 5) USING (entity)
  JOIN LATERAL (SELECT o.v FROM rev_now o WHERE o.entity = a.entity AND a.en - o.en BETWEEN 350 AND 380 ORDER BY o.en DESC LIMIT 1) b ON true WHERE a.en = a.last),
ops AS (SELECT a.entity, a.en, a.val - (SELECT max_by(o.val, o.en) FROM q o WHERE o.entity = a.entity AND o.item = a.item AND a.en - o.en BETWEEN 355 AND 375) AS move,
    row_number() OVER (PARTITION BY a.entity ORDER BY a.en DESC) AS k FROM q a WHERE item = 'operating_income'),
ops_now AS (SELECT entity, count(move) FILTER (k <= 4) AS n, median(move) FILTER (k <= 4) AS m, max(en) AS en, min(en) FILTER (k <= 8) AS since FROM ops GROUP BY 1),
ops_change AS (SELECT x.entity, 4 * m / ((a1 + a2) / 2) AS op_inc_change FROM ops_now x JOIN anchors USING (entity)
  JOIN LATERAL (SELECT val AS a1 FROM asset a WHERE a.entity = x.entity AND abs(a.en - x.en) <= 10 ORDER BY abs(a.en - x.en), a.en LIMIT 1) s ON true
  JOIN LATERAL (SELECT val AS a2 FROM asset a WHERE a.entity = x.entity AND abs(a.en - (x.en - 365)) <= 10 ORDER BY abs(a.en - (x.en - 365)), a.en LIMIT 1) u ON true
  WHERE n = 4 AND anchor - x.en <= 120 AND a1 <> 0 AND a2 <> 0 AND a1 + a2 > 0
  AND NOT EXISTS (SELECT 1 FROM match o WHERE o.entity = x.entity AND o.item = 'operating_income' AND o.en >= since AND NOT ok)),
made AS (SELECT r.entity, r.en, r.val - c.val AS val FROM q r JOIN q c ON c.entity = r.entity AND c.en = r.en AND c.item = 'cost' WHERE r.item = 'revenue'),
via AS (SELECT entity FROM made GROUP BY 1 HAVING count(*) >= 12),
gross_q AS (SELECT m.* FROM made m SEMI JOIN via USING (entity) UNION ALL SELECT entity, en, val FROM q WHERE item = 'gross_profit' AND entity NOT IN (FROM via)),
gross_points AS (SELECT *, max(en) OVER (PARTITION BY entity) AS last FROM (SELECT entity, en, sum(val) OVER w AS v, en - lag(en, 3) OVER (PARTITION BY entity ORDER BY en) AS span FROM gross_q
  WINDOW w AS (PARTITION BY entity ORDER BY en ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE span <= 300),
gross_now AS (SELECT g.* FROM gross_points g JOIN anchors USING (entity) WHERE anchor - last <= 120),
gross_ratio AS (SELECT g.entity, g.en, g.v / a.val AS v FROM gross_now g JOIN LATERAL (SELECT val FROM asset a WHERE a.entity = g.entity AND abs(a.en - g.en) <= 10 ORDER BY abs(a.en - g.en), a.en LIMIT 1) a ON true
  WHERE last - g.en <= 1125 AND a.val > 0),
gross_fit AS (SELECT entity, regr_slope(v, (en - DATE '1970-01-01') / 365.25::DOUBLE) AS slope, count(*) AS n, min(en) - 280 AS since, max(abs(v)) AS most FROM gross_ratio GROUP BY 1),
gross_years AS (SELECT r.entity, r.en, r.val AS revenue, CASE WHEN v.entity IS NOT NULL AND c.val IS NOT NULL THEN r.val - c.val ELSE g.val END AS expected FROM years r
  LEFT JOIN years c ON c.entity = r.entity AND c.en = r.en AND c.item = 'cost' AND c.k < 5 LEFT JOIN years g ON g.entity = r.entity AND g.en = r.en AND g.item = 'gross_profit' AND g.k < 5
  LEFT JOIN via v ON v.entity = r.entity WHERE r.item = 'revenue' AND r.k < 5 AND r.val <> 0),
gross_off AS (SELECT y.entity, y.en FROM gross_years y JOIN gross_now p ON p.entity = y.entity AND abs(p.en - y.en) <= 10
  GROUP BY y.entity, y.en, revenue, expected HAVING abs(min_by(p.v, p.en) - expected) > 0.05::DOUBLE * abs(revenue)),
gross_trend AS (SELECT entity, slope * 3 AS gp_trend FROM gross_fit x WHERE n >= 9 AND most <= 3
  AND NOT EXISTS (SELECT 1 FROM match o WHERE o.entity = x.entity AND o.item = 'revenue' AND o.en >= since AND NOT ok)
  AND NOT EXISTS (SELECT 1 FROM match o JOIN via USING (entity) WHERE o.entity = x.entity AND o.item = 'cost' AND o.en >= since AND NOT ok)
  AND NOT EXISTS (SELECT 1 FROM gross_off o WHERE o.entity = x.entity AND o.en >= since)),
gpoa_ends AS (SELECT r.entity, r.k, r.val AS revenue, (r.val - c.val) / a.val AS gpoa, (r.val - c.val) / nullif(r.val, 0) AS margin FROM years r JOIN years c ON c.entity = r.entity AND c.item = 'cost' AND c.en = r.en
  JOIN LATERAL (SELECT nullif(val, 0) AS val FROM asset a WHERE a.entity = r.entity AND abs(a.en - r.en) <= 45 ORDER BY abs(a.en - r.en), a.en LIMIT 1) a ON true WHERE r.item = 'revenue'),
gpoa_change AS (SELECT a.entity, CASE WHEN coalesce(abs(a.margin - b.margin) > 0.5 AND a.revenue >= 50e6 AND b.revenue >= 50e6, false) THEN NULL ELSE a.gpoa - b.gpoa END AS change
  FROM gpoa_ends a JOIN gpoa_ends b ON a.entity = b.entity AND a.k = 0 AND b.k = 3),
offs_q AS (SELECT entity, en, sum(CASE WHEN kind = 'one_off_charge' THEN val ELSE -val END) AS off FROM (
  SELECT entity, en, split_part(item, ':', 1) AS kind, max(val) AS val FROM q WHERE item LIKE 'one_off%' AND val > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
offs_y AS (SELECT entity, en, sum(CASE WHEN kind = 'one_off_charge' THEN val ELSE -val END) AS off FROM (
  SELECT entity, en, split_part(item, ':', 1) AS kind, max(val) AS val FROM years WHERE item LIKE 'one_off%' AND val > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
spans AS (
  SELECT 'q' AS kind, q.entity, q.en, q.val, off FROM (SELECT * FROM q WHERE item = 'net_income' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY en DESC) <= 21) q LEFT JOIN offs_q o ON o.entity = q.entity AND o.en = q.en
  UNION ALL SELECT 'y', y.entity, y.en, y.val, off FROM years y LEFT JOIN offs_y o ON o.entity = y.entity AND o.en = y.en WHERE item = 'net_income' AND k < 5),
judged AS (SELECT s.kind, s.entity, s.en, s.val, coalesce(off * (1 - tax), 0) AS a, median(abs(s.val)) OVER (PARTITION BY kind, s.entity) AS typical, count(*) OVER (PARTITION BY kind, s.entity) AS n,
    (SELECT min_by(o.val, o.en) FROM spans o WHERE o.kind = s.kind AND o.entity = s.entity AND s.en - o.en BETWEEN 350 AND 380) AS prior FROM spans s JOIN figures USING (entity)),
big AS (SELECT *, coalesce(a <> 0 AND abs(a) >= greatest(0.25::DOUBLE * abs(val), typical) AND (prior - val) * sign(a) >= 0.5::DOUBLE * abs(a), false) AS yes FROM judged),
evened AS (SELECT kind, entity, en, CASE WHEN yes AND count(*) FILTER (yes) OVER (PARTITION BY kind, entity) <= greatest(1, n / 3.0::DOUBLE) THEN val + a ELSE val END AS val FROM big),
ni_q AS (SELECT q.entity, q.en, coalesce(e.val, q.val) AS val FROM q LEFT JOIN evened e ON e.kind = 'q' AND e.entity = q.entity AND e.en = q.en WHERE item = 'net_income'),
ni_points AS (SELECT *, max(en) OVER (PARTITION BY entity) AS last FROM (SELECT entity, en, sum(val) OVER w AS v, en - lag(en, 3) OVER (PARTITION BY entity ORDER BY en) AS span FROM ni_q
  WINDOW w AS (PARTITION BY entity ORDER BY en ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE span <= 300),
probes AS (SELECT DISTINCT p.entity, k, (last - days)::DATE AS target FROM ni_points p JOIN anchors USING (entity), (VALUES (0, 0), (1, 365), (2, 730), (3, 1096), (4, 1461)) z(k, days) WHERE anchor - last <= 120),
returns AS (SELECT p.entity, p.k, x.v / a.val AS v FROM probes p JOIN LATERAL (SELECT o.en, o.v FROM ni_points o WHERE o.entity = p.entity AND abs(o.en - p.target) <= 20 ORDER BY abs(o.en - p.target), o.en LIMIT 1) x ON true
  JOIN LATERAL (SELECT val FROM asset a WHERE a.entity = p.entity AND abs(a.en - x.en) <= 10 ORDER BY abs(a.en - x.en), a.en LIMIT 1) a ON true WHERE a.val > 0),
returns_y AS (SELECT e.entity, y.k, e.val / a.val AS v FROM evened e JOIN years y ON y.entity = e.entity AND y.en = e.en AND y.item = 'net_income'
  JOIN LATERAL (SELECT nullif(val, 0) AS val FROM asset a WHERE a.entity = e.entity AND abs(a.en - e.en) <= 45 ORDER BY abs(a.en - e.en), a.en LIMIT 1) a ON true WHERE e.kind = 'y' AND a.val IS NOT NULL),
scatter AS (SELECT entity, count(*) AS n, CASE WHEN regr_slope(v, -k) > 0 THEN sqrt(greatest(regr_syy(v, -k) - regr_slope(v, -k) * regr_sxy(v, -k), 0) / (count(*) - 2)) ELSE stddev_samp(v) END AS x FROM returns GROUP BY 1),
scatter_y AS (SELECT entity, count(*) AS n, CASE WHEN regr_slope(v, -k) > 0 THEN sqrt(greatest(regr_syy(v, -k) - regr_slope(v, -k) * regr_sxy(v, -k), 0) / (count(*) - 2)) ELSE stddev_samp(v) END AS x FROM returns_y GROUP BY 1),
eps AS (SELECT entity, en, val, val - lag(val, 4) OVER (PARTITION BY entity ORDER BY en, st) AS yoy, row_number() OVER (PARTITION BY entity ORDER BY en DESC, st DESC) AS b, count(*) OVER (PARTITION BY entity) AS n
  FROM flow WHERE item = 'eps' AND en - st BETWEEN 80 AND 100),
sues AS (SELECT entity, (max(yoy) FILTER (b = 1) - avg(yoy) FILTER (b BETWEEN 2 AND 9)) / greatest(stddev_samp(yoy) FILTER (b <= 8), 0.01::DOUBLE * max(abs(val)) FILTER (b = 1), 0.01) AS sue FROM eps WHERE n >= 13 GROUP BY 1)"""


def _items(spark, d):
    facts = f.filings(spark, d)
    return m.resolve_items(m.tagged_facts(facts, f.AS_OF)).join(m.anchors(facts, f.AS_OF), "entity", "left")


def _groups(spark, d):
    facts = f.filings(spark, d)
    flows = m.resolve_items(m.tagged_facts(facts, f.AS_OF)).where("start is not null")
    return dealt(m.gathered_items(flows, dealt(m.anchors(facts, f.AS_OF))))


def _rounded(rows, *cols, digits=6):
    return rows.select("entity", *(stats.half_up(F.col(c).cast("double"), digits).alias(c) for c in cols))


def _of(sql: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"{_hu(x, digits)} AS {name}" for name, x in sql.items())


@query(f"WITH RECURSIVE {_FACTS} SELECT entity, item, concept, st, en, val FROM single")
def facts_to_items(spark, d):
    rows = m.resolve_items(m.tagged_facts(f.filings(spark, d), f.AS_OF))
    return rows.select("entity", "item", "concept", F.col("start").alias("st"), F.col("end").alias("en"), "val")


@query(f"WITH RECURSIVE {_FACTS} SELECT entity, item, concept, en, val FROM inst")
def balance_instants(spark, d):
    return m.instants(_items(spark, d), f.AS_OF).select("entity", "item", "concept", F.col("end").alias("en"), "val")


@query(f"WITH RECURSIVE {_FACTS} SELECT entity, item, en, val FROM q")
def quarters_of_facts(spark, d):
    return t.quarters_of(_groups(spark, d), m.BY_ITEM).select("entity", "item", F.inline("quarters")).select("entity", "item", F.col("end").alias("en"), "val")


@query(f"WITH RECURSIVE {_FACTS} SELECT entity, item, k::BIGINT AS k, en, val FROM years")
def years_of_facts(spark, d):
    years = t.years_of(_groups(spark, d), m.BY_ITEM).select("entity", "item", F.posexplode("years").alias("k", "y"))
    return years.select("entity", "item", F.col("k").cast("long").alias("k"), F.col("y.end").alias("en"), "y.val")


@query(f"WITH RECURSIVE {_FACTS} SELECT entity, item, en, val, basis FROM ttm")
def trailing_year_of_facts(spark, d):
    return t.trailing_of(_groups(spark, d), m.BY_ITEM, m.SOURCE).select("entity", "item", F.col("end").alias("en"), "val", "basis")


def _measures(spark, d):
    return m.measures(f.filings(spark, d), f.listings(spark, d), f.AS_OF)


_OPERATING = {
    "roic": "CASE WHEN coalesce((close_ic + open_ic) / 2, close_ic) > 0 THEN ebit * (1 - tax) / coalesce((close_ic + open_ic) / 2, close_ic) END",
    "gpoa": "gross / assets", "ebit_ev": "CASE WHEN ev > 0 THEN ebit / ev END", "ebitda_ev": "CASE WHEN ev > 0 THEN ebitda / ev END",
    "fcf_ev": "CASE WHEN ev > 0 THEN (t_ocf - t_capex) / ev END", "debt_equity": "CASE WHEN i_equity > 0 THEN debt / i_equity END",
    "net_debt_ebitda": "CASE WHEN ebitda > 0 THEN (debt - cash) / ebitda END",
    "altman_z": "6.56::DOUBLE * (i_current_assets - i_current_liabilities) / assets + 3.26::DOUBLE * i_retained / assets + 6.72::DOUBLE * ebit / assets + 1.05::DOUBLE * i_equity / nullif(liabilities, 0)",
    "ebit": "ebit", "tax_rate": "tax", "debt": "debt", "ev": "ev",
}


@query(f"WITH RECURSIVE {_LEVELS} SELECT entity, {_of(_OPERATING)}, ebit_path, debt_path, anchor FROM figures")
def measures_operating(spark, d):
    rows = _measures(spark, d)
    return _rounded(rows, *_OPERATING).join(rows.select("entity", "ebit_path", "debt_path", "anchor"), "entity")


_step = lambda x: f"(y0_{x} - y3_{x}) / assets / 3"
_over = lambda x, y: f"CASE WHEN {y} > 0 THEN {x} / {y} END"
_FINANCIAL = {
    "roe": _over("ni", "i_equity"), "roa": "ni / assets", "earn_yield": "ni / cap", "book_yield": "CASE WHEN i_equity > 0 THEN i_equity / cap END", "equity_assets": "i_equity / assets",
    "ffo_assets": "ffo / assets", "ffo_yield": "ffo / cap", "debt_assets": "debt / assets", "net_debt_ffo": "CASE WHEN ffo > 0 THEN (debt - cash) / ffo END",
    "profit_growth": _step("net_income"), "ffo_growth": f"{_step('net_income')} + coalesce({_step('da')}, 0)", "efficiency": "t_noninterest_expense / bank_revenue", "credit_cost": "t_provision / bank_revenue",
    "nii_growth": _step("nii"), "nii_assets": "t_nii / assets", "tbv_yield": "CASE WHEN tangible > 0 THEN tangible / cap END", "rotce": "CASE WHEN tangible > 0 AND cap IS NOT NULL THEN ni / tangible END",
    "loss_ratio": _over("t_claims", "t_premiums"), "cost_ratio": _over("t_benefits", "t_revenue"), "invest_yield": "t_investment_income / assets",
    "premium_growth": "CASE WHEN y0_premiums > 0 AND y3_premiums > 0 THEN (y0_premiums / y3_premiums) ** (1 / 3.0::DOUBLE) - 1 END", "reserves_equity": _over("i_reserves", "i_equity"),
    "op_margin": _over("t_operating_income", "t_revenue"), "net_margin": _over("ni", "t_revenue"), "comp_ratio": _over("t_compensation", "t_revenue"), "ni": "ni",
    "net_payout_yield": "CASE WHEN t_ocf IS NOT NULL THEN (coalesce(t_bought, 0) - coalesce(t_issued, 0)) / cap END",
    "accruals": "CASE WHEN ni_end = ocf_end AND coalesce((i_assets + nullif(n_assets, 0)) / 2, i_assets) > 0 THEN (t_net_income - t_ocf) / coalesce((i_assets + nullif(n_assets, 0)) / 2, i_assets) END",
}


@query(f"WITH RECURSIVE {_LEVELS} SELECT entity, {_of(_FINANCIAL)}, i_fund_holdings IS NOT NULL AS is_fund FROM figures")
def measures_financial(spark, d):
    rows = _measures(spark, d)
    return _rounded(rows, *_FINANCIAL).join(rows.select("entity", "is_fund"), "entity")


_TRENDS = {
    "rev_growth": "CASE WHEN latest < growth AND latest < 0 THEN (growth + latest) / 2 ELSE growth END",
    "op_inc_change": "op_inc_change", "delta_gpoa": "coalesce(gp_trend, change)", "earn_var": "coalesce(CASE WHEN s.n = 5 THEN s.x END, CASE WHEN w.n >= 5 THEN w.x END)", "sue": "sue",
}


@query(f"""WITH RECURSIVE {_SERIES} SELECT entity, {_of(_TRENDS)} FROM (
  SELECT *, coalesce(trend, CASE WHEN y3_revenue > 0 AND y0_revenue > 0 THEN (y0_revenue / y3_revenue) ** (1 / 3.0::DOUBLE) - 1 END) AS growth FROM figures LEFT JOIN rev_trend USING (entity)) x
LEFT JOIN rev_last USING (entity) LEFT JOIN ops_change USING (entity) LEFT JOIN gross_trend USING (entity) LEFT JOIN gpoa_change USING (entity) LEFT JOIN sues USING (entity)
LEFT JOIN scatter s USING (entity) LEFT JOIN scatter_y w USING (entity)""")
def measures_trends(spark, d):
    return _rounded(_measures(spark, d), *_TRENDS)


_KEYS = [x.key for x in _METRICS]
_FORMULAS = {k: v for k, v in (_OPERATING | _FINANCIAL | _TRENDS).items() if k in _KEYS} | {"ptbv_gap": "gap"}
_SPEC = ", ".join(f"('{x.key}', '{x.factor}', {str(x.higher_better).lower()}, {str(x.optional).lower()}, {str(x.conditioned).lower()}, {list(x.segments) or 'NULL::VARCHAR[]'})" for x in _METRICS)
#: (sector, industry) of the stand-in filers, by their number; the oracle names segments and peer groups outright.
_KINDS = [("Finance", "Major Banks"), ("Technology", "Computer Software"), ("Finance", "Life Insurance"), ("Industrials", "Metal Fabrications"), ("Technology", "Semiconductors")]
_FILER = """SELECT s_suppkey AS entity, cap AS market_cap, CASE s_suppkey % 5 WHEN 0 THEN 'banks' WHEN 2 THEN 'insurers' ELSE 'operating' END AS segment,
  CASE s_suppkey % 5 WHEN 0 THEN 'Community banks' WHEN 2 THEN 'Life & health insurers' WHEN 3 THEN 'Industrials' ELSE 'Technology' END AS peer FROM supplier JOIN caps ON entity = s_suppkey"""
#: The facts that the monthly run sees, in place of all that are filed.
_SEEN = _SERIES.replace("registry(item", f.MONTH_SQL.format(supplier="supplier", lineitem="lineitem") + ",\nregistry(item", 1).replace("FROM filed_facts", "FROM month_facts").replace(
    "FROM month_facts WHERE NOT (entity % 37", "FROM filed_facts WHERE NOT (entity % 37")
_SETTINGS = score.Settings(cap_floor=1.5e8, adv_floor=58_000.0)
#: Who stays in, rule after rule.
_STAGED = f"""was0 AS (SELECT s_suppkey AS entity, concat('F', s_suppkey) AS listing FROM supplier WHERE s_suppkey % 6 <> 0),
probed AS (SELECT entity, form, filed, en, CASE WHEN taxonomy = 'us-gaap' THEN list_position(['Assets', 'Liabilities', 'StockholdersEquity'], concept) END AS place FROM month_facts WHERE filed <= {_DAY}),
signals AS (SELECT entity, bool_or(form IN ('10-K', '10-Q')) FILTER (place = least) AS domestic, count(DISTINCT (form, filed)) FILTER (place = least AND form IN ('10-K', '10-Q', '20-F', '40-F')) AS n_filings
  FROM (SELECT *, min(place) OVER (PARTITION BY entity) AS least FROM probed) x GROUP BY 1),
met AS (SELECT l.*, i.entity, t.adv, w.listing IS NOT NULL AS was, g.entity IS NOT NULL AS has_facts, domestic, coalesce(n_filings, 0) AS n_filings, anchor AS latest, x.entity IS NOT NULL AS newer, {_DAY} - anchor AS age
  FROM listed l LEFT JOIN matched i USING (listing) LEFT JOIN traded t ON t.owner = l.owner LEFT JOIN was0 w ON w.listing = l.listing
  LEFT JOIN signals g ON g.entity = i.entity LEFT JOIN anchors a ON a.entity = i.entity LEFT JOIN indexed x ON x.entity = i.entity),
first AS (SELECT *, CASE WHEN name NOT LIKE '%Common Stock' THEN 'not_common' WHEN NOT coalesce(market_cap >= 1.5e8 OR (was AND market_cap >= 1.2e8), false) THEN 'market_cap_floor' WHEN entity IS NULL THEN 'no_sec_match' END AS s1 FROM met),
class_kept AS (SELECT entity, max_by(listing, (volume * last_sale, listing)) AS class, list_sort(list(listing)) AS classes FROM first WHERE s1 IS NULL GROUP BY 1),
late AS (SELECT f.*, class, classes, coalesce(s1, CASE WHEN f.listing <> class THEN 'share_class' END) AS s2, latest IS NULL OR age > 200 AS stale,
    coalesce((latest IS NULL OR age > 200) AND was AND newer AND age <= 300, false) AS carry FROM first f LEFT JOIN class_kept USING (entity)),
staged AS (SELECT *, coalesce(s2, CASE WHEN NOT has_facts THEN 'no_facts' WHEN adv IS NULL THEN 'no_price' WHEN NOT coalesce(domestic, false) THEN 'foreign_filer' WHEN n_filings < 5 THEN 'short_history'
    WHEN stale AND NOT carry THEN 'stale' WHEN NOT (adv >= 58000 OR (was AND adv >= 46400)) THEN 'illiquid' END) AS stage FROM late),
told AS (SELECT *, CASE stage WHEN 'not_common' THEN 'not an operating company''s common stock' WHEN 'market_cap_floor' THEN CASE WHEN market_cap IS NULL THEN 'market value unknown' ELSE 'market value under the floor' END
    WHEN 'no_sec_match' THEN 'no filer under this listing' WHEN 'share_class' THEN class || ' stands for the company' WHEN 'no_facts' THEN 'no facts on file' WHEN 'no_price' THEN 'no price'
    WHEN 'foreign_filer' THEN 'files no domestic forms' WHEN 'short_history' THEN n_filings || ' periodic filings' WHEN 'stale' THEN 'latest report is ' || coalesce(latest::VARCHAR, 'missing')
    WHEN 'illiquid' THEN 'average dollar volume under the floor' END AS reason FROM staged)"""
_GRADES = f"""raw AS (SELECT x.*, op_inc_change, coalesce(trend, CASE WHEN y3_revenue > 0 AND y0_revenue > 0 THEN (y0_revenue / y3_revenue) ** (1 / 3.0::DOUBLE) - 1 END) AS growth, latest, gp_trend, change, s.n AS n5, s.x AS x5, w.n AS ny, w.x AS xy
  FROM figures x LEFT JOIN rev_trend USING (entity) LEFT JOIN rev_last USING (entity) LEFT JOIN ops_change USING (entity) LEFT JOIN gross_trend USING (entity) LEFT JOIN gpoa_change USING (entity)
  LEFT JOIN scatter s USING (entity) LEFT JOIN scatter_y w USING (entity)),
points2 AS (SELECT r.entity, peer, least(greatest(ni / tangible, -0.2::DOUBLE), 0.4::DOUBLE) AS x, ln(cap / tangible) AS y FROM raw r JOIN filer USING (entity) WHERE segment = 'banks' AND tangible > 0 AND cap > 0 AND ni IS NOT NULL),
lines AS (SELECT peer, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my FROM points2 GROUP BY 1 HAVING count(*) >= 8 AND max(x) > min(x)),
gaps AS (SELECT entity, my + b * (x - mx) - y AS gap FROM points2 JOIN lines USING (peer)),
wide AS (SELECT r.entity, {", ".join(f"({v.replace('s.n', 'n5').replace('s.x', 'x5').replace('w.n', 'ny').replace('w.x', 'xy')})::DOUBLE AS {k}" for k, v in _FORMULAS.items())} FROM raw r LEFT JOIN gaps USING (entity)),
spec(metric, factor, higher_better, optional, conditioned, segments) AS (VALUES {_SPEC}),
long AS (SELECT entity, metric, raw FROM wide UNPIVOT INCLUDE NULLS (raw FOR metric IN ({", ".join(_FORMULAS)}))),
rows1 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY segment, peer) < 12 THEN 'pooled_thin' ELSE peer END AS cohort FROM filer),
grid0 AS (SELECT r.*, s.*, raw FROM rows1 r JOIN spec s ON segments IS NULL OR list_contains(segments, r.segment) LEFT JOIN long l ON l.entity = r.entity AND l.metric = s.metric),
grid AS (SELECT * FROM grid0 QUALIFY count(raw) OVER (PARTITION BY segment, metric) / count(*) OVER (PARTITION BY segment, metric) >= 0.4),
bounds AS (SELECT segment, cohort, metric, count(raw) AS n, quantile_cont(raw, 0.05) AS lo, quantile_cont(raw, 0.95) AS hi FROM grid GROUP BY 1, 2, 3),
clipped AS (SELECT g.*, CASE WHEN raw IS NULL THEN NULL WHEN b.n < 3 THEN raw ELSE least(greatest(raw, lo), hi) END AS win FROM grid g JOIN bounds b USING (segment, cohort, metric)),
spots AS (SELECT *, count(win) OVER (PARTITION BY segment, cohort, metric) AS size, (rank() OVER (PARTITION BY segment, cohort, metric ORDER BY win NULLS LAST) - 1
  + (count(win) OVER (PARTITION BY segment, cohort, metric, win) - 1) / 2.0::DOUBLE) AS below FROM clipped),
pcts AS (SELECT *, {_hu("CASE WHEN win IS NULL THEN NULL WHEN size = 1 THEN 50.0::DOUBLE WHEN higher_better THEN 100.0::DOUBLE * (below / greatest(size - 1, 1)) ELSE 100.0::DOUBLE * (1 - below / greatest(size - 1, 1)) END", 1)} AS pct0,
  max(CASE WHEN metric = CASE segment WHEN 'operating' THEN 'roic' ELSE 'roe' END THEN raw END) OVER (PARTITION BY entity) AS ret FROM spots),
gated AS (SELECT *, CASE WHEN NOT conditioned THEN pct0 WHEN ret IS NULL THEN NULL WHEN ret <= 0.09 THEN least(pct0, 50.0::DOUBLE) ELSE pct0 END AS pct FROM pcts)"""
_MONTH = f"""{_SEEN},
{_STAGED},
filer AS (SELECT * FROM ({_FILER}) x WHERE entity IN (SELECT entity FROM staged WHERE stage IS NULL)),
{_GRADES},
factors AS (SELECT entity, segment, peer, market_cap, {", ".join(f"{_hu(f'avg(pct) FILTER (factor = {chr(39)}{x}{chr(39)})', 1)} AS {x}" for x in ("quality", "growth", "valuation", "health"))},
  count(pct) AS resolved, count(*) FILTER (pct IS NOT NULL OR NOT optional) AS applicable FROM gated GROUP BY 1, 2, 3, 4),
blended AS (SELECT *, {_hu("((coalesce(quality, 0) + coalesce(growth, 0) + coalesce(valuation, 0) + coalesce(health, 0)) * 25.0::DOUBLE) / nullif(25.0::DOUBLE * ((quality IS NOT NULL)::INT + (growth IS NOT NULL)::INT + (valuation IS NOT NULL)::INT + (health IS NOT NULL)::INT), 0)", 2)} AS composite
  FROM factors WHERE resolved / nullif(applicable, 0) >= 0.7),
now AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY composite DESC NULLS LAST, market_cap DESC NULLS LAST, entity) AS rank FROM blended),
was AS (SELECT s_suppkey AS entity, segment, (s_suppkey % 100)::DOUBLE AS composite, row_number() OVER (PARTITION BY segment ORDER BY s_suppkey % 100 DESC, s_suppkey) AS rank FROM supplier JOIN ({_FILER}) f ON entity = s_suppkey WHERE s_suppkey % 6 <> 0)"""


#: The grid of last month: the same rules over what was filed by then, for those that were scored.
_BEFORE = f"""last_grid AS (WITH RECURSIVE {_SEEN},
filer AS (SELECT * FROM ({_FILER}) x WHERE entity % 6 <> 0),
{_GRADES} SELECT entity, metric, pct FROM gated)""".replace(_DAY, f"DATE '{f.PRIOR_AS_OF}'")


def _kinds(spark):
    return F.broadcast(spark.createDataFrame([(k, *x) for k, x in enumerate(_KINDS)], "k bigint, sector string, industry string"))  # five rows


def _month_inputs(spark, d):
    """The stand-in inputs, with last month's record."""
    given = f.month_inputs(spark, d)
    own = given["listings"].where("listing = concat('F', owner)").join(_kinds(spark), "k").withColumnRenamed("owner", "entity")
    segment = F.when(F.col("k") == 0, "banks").when(F.col("k") == 2, "insurers").otherwise("operating")
    prior = own.where("entity % 6 <> 0").select("entity", "listing", "name", "sector", "industry", "market_cap", segment.alias("segment"), (F.col("entity") % 100).cast("double").alias("composite"))
    prior = prior.withColumn("rank", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("composite"), "entity")).cast("long"))
    return given | {"listings": given["listings"].join(_kinds(spark), "k"), "prior": prior}


def month_of(spark, d, drift: bool = False):
    """The run over the stand-in listings, with a made record of the month before; with ``drift`` against the grid of that month as well."""
    x = _month_inputs(spark, d)
    facts = written(x["facts"])  # made, not read: the run reads facts several times
    grid = month.graded(facts, x["prior"], f.PRIOR_AS_OF, _SETTINGS)[1].select("entity", "metric", "pct") if drift else None
    return month.run_from_listings(facts, x["listings"], x["ids"], x["prices"], f.AS_OF, x["prior"], x["newer"], grid, settings=_SETTINGS)


def _staged(spark, d):
    x = _month_inputs(spark, d)
    return intake.staged(x["listings"], x["ids"], intake.filers(x["facts"], f.AS_OF, x["newer"]), x["prices"], x["prior"], f.AS_OF, _SETTINGS)


@query(f"""WITH RECURSIVE {_MONTH}, rules AS (SELECT unnest(range({len(intake.STAGES) + 1})) AS step, unnest({["listed", *intake.STAGES]}) AS stage),
spots_of AS (SELECT *, coalesce(list_position({intake.STAGES}, stage), {len(intake.STAGES) + 1}) AS place FROM staged),
counted AS (SELECT step, r.stage, count(*) FILTER (place > step) AS survivors, count(*) FILTER (place > step AND was AND ((r.stage = 'market_cap_floor' AND market_cap < 1.5e8 AND market_cap >= 1.2e8)
  OR (r.stage = 'illiquid' AND adv < 58000 AND adv >= 46400))) AS kept_below FROM spots_of, rules r GROUP BY 1, 2)
SELECT step::INTEGER AS step, stage, survivors, coalesce(lag(survivors) OVER (ORDER BY step) - survivors, 0) AS dropped, kept_below FROM counted""")
def monthly_funnel(spark, d):
    return intake.funnel(_staged(spark, d))


@query(f"WITH RECURSIVE {_MONTH} SELECT listing, entity, stage, reason FROM told WHERE stage IS NOT NULL")
def monthly_excluded(spark, d):
    return _staged(spark, d).where("stage is not null").select("listing", "entity", "stage", "reason")


@query(f"""WITH RECURSIVE {_MONTH} SELECT n.entity, n.segment, n.peer, quality, growth, valuation, health, n.composite, n.rank, {_hu("n.composite - w.composite", 2)} AS composite_change,
  w.rank - n.rank AS rank_change, w.entity IS NULL AS is_new FROM now n LEFT JOIN was w USING (entity)""")
def monthly_run(spark, d):
    return month_of(spark, d)["scored"].select("entity", "segment", "peer", "quality", "growth", "valuation", "health", "composite", "rank", "composite_change", "rank_change", "is_new")


_GONE = """left_out AS (SELECT w.entity, w.rank, t.stage, t.reason, f.resolved, f.applicable FROM was w LEFT JOIN told t ON t.listing = concat('F', w.entity) LEFT JOIN factors f ON f.entity = w.entity WHERE w.entity NOT IN (SELECT entity FROM now)),
gone AS (SELECT entity, rank, CASE WHEN stage IN ('share_class', 'market_cap_floor', 'no_sec_match') AND resolved IS NULL THEN stage WHEN stage = 'not_common' AND resolved IS NULL THEN 'unlisted'
    WHEN stage IS NOT NULL AND stage NOT IN ('not_common', 'share_class', 'market_cap_floor', 'no_sec_match') THEN 'excluded' ELSE 'insufficient_data' END AS kind,
  CASE WHEN stage IS NOT NULL AND stage NOT IN ('not_common', 'share_class', 'market_cap_floor', 'no_sec_match') THEN reason
    WHEN resolved IS NOT NULL THEN 'resolved ' || resolved || ' of ' || applicable || ' applicable metrics (' || round_even(resolved * 100.0::DOUBLE / applicable, 0)::INT || '%, threshold 70%)'
    ELSE reason END AS reason FROM left_out)"""


@query(f"WITH RECURSIVE {_MONTH}, {_GONE} SELECT entity, rank, kind, reason FROM gone")
def monthly_exits(spark, d):
    return month_of(spark, d)["exits"].select("entity", "rank", "kind", "reason")


#: Tags that the freshness rule rejects: (entity, tag, en), the newest rejected date of each.
_IGNORED = f"""picks AS (
  SELECT entity, item, max_by(concept, {{'days': en - st, 'o': DATE '1970-01-01' - en, 'tail': -tail, 'st': st}}) AS concept FROM (
    SELECT *, max(en) OVER (PARTITION BY entity, item) AS last FROM (SELECT entity, item, concept, st, en, 0 AS tail FROM flow UNION ALL
      SELECT a.entity, a.item, a.concept, (b.en + 1)::DATE, a.en, 1 FROM flow a JOIN flow b ON a.entity = b.entity AND a.item = b.item AND a.st = b.st AND a.en - b.en BETWEEN 80 AND 400) x) y
  WHERE last - en <= 4 AND en - st <= 378 GROUP BY 1, 2),
rejected AS (
  SELECT entity, concept, en FROM (SELECT * FROM items WHERE st IS NULL AND en <= {_DAY} QUALIFY row_number() OVER (PARTITION BY entity, item ORDER BY en DESC) = 1) WHERE en < anchor - 300
  UNION ALL SELECT entity, concept, en FROM (SELECT i.entity, item, concept, en, day FROM items i JOIN back USING (entity) WHERE st IS NULL AND en <= day
    QUALIFY row_number() OVER (PARTITION BY i.entity, item ORDER BY en DESC) = 1) WHERE en < day - 300 AND item IN ({_list(DEBT_ITEMS)})
  UNION ALL SELECT entity, concept, en FROM ends WHERE k = 0 AND newest < anchor - 300 AND (item IN ({_list(m.ANNUAL_ITEMS)}) OR item LIKE 'one_off%')
  UNION ALL SELECT w.entity, p.concept, last FROM tiles w JOIN picks p ON p.entity = w.entity AND p.item = w.item WHERE covered BETWEEN 350 AND 380 AND last < anchor - CASE WHEN n = 1 THEN 300 ELSE 120 END
  UNION ALL SELECT y.entity, y.concept, y.en FROM tiles w JOIN ends y ON y.entity = w.entity AND y.item = w.item AND y.k = 0 WHERE covered NOT BETWEEN 350 AND 380 AND y.newest < y.anchor - 300),
ignored AS (SELECT entity, concept AS tag, max(en) AS en FROM rejected GROUP BY 1, 2)"""
#: Notes of filers: one-offs that were taken out of a figure, returns on closing capital, ignored tags.
_NOTES = f"""biggest AS (SELECT entity, split_part(item, ':', 1) AS kind, max_by(concept, {{'val': val, 'place': -list_position([{_list(c for k in BY_CONCEPT for c in LINE_ITEMS[k])}], concept), 'o': DATE '1970-01-01' - en}}) AS tag,
    max_by(en, {{'val': val, 'place': -list_position([{_list(c for k in BY_CONCEPT for c in LINE_ITEMS[k])}], concept), 'o': DATE '1970-01-01' - en}}) AS en
  FROM flow WHERE item LIKE 'one_off%' AND val > 0 AND anchor - en BETWEEN 0 AND 370 GROUP BY 1, 2),
taken AS (
  SELECT f.entity, 'ebit' AS metric, 'one_off_gain' AS kind, gain AS amount FROM figures f JOIN kept USING (entity) WHERE ebit <> ebit0 AND kept.op_gain > 0
  UNION ALL SELECT f.entity, 'ebit', 'one_off_charge', charge FROM figures f JOIN kept USING (entity) WHERE ebit <> ebit0 AND kept.op_charge > 0
  UNION ALL SELECT f.entity, 'net_income', 'one_off_gain', gain FROM figures f JOIN kept USING (entity) WHERE ni <> t_net_income AND kept.ni_gain > 0
  UNION ALL SELECT f.entity, 'net_income', 'one_off_charge', charge FROM figures f JOIN kept USING (entity) WHERE ni <> t_net_income AND kept.ni_charge > 0),
noted AS (
  SELECT entity, metric, kind, tag, en, amount FROM taken JOIN biggest USING (entity, kind)
  UNION ALL SELECT entity, 'roic', 'closing_capital', NULL, NULL, NULL FROM figures WHERE ebit IS NOT NULL AND close_ic IS NOT NULL AND open_ic IS NULL
  UNION ALL SELECT entity, 'inputs', 'ignored_tag', tag, en, NULL FROM ignored JOIN figures USING (entity))"""


@query(f"WITH RECURSIVE {_LEVELS}, {_IGNORED}, {_NOTES} SELECT entity, metric, kind, tag, en, amount::DOUBLE AS amount FROM noted")
def measure_notes(spark, d):
    return m.note_rows(_measures(spark, d)).withColumnRenamed("end", "en")


_RAW = {"assets": "assets", "equity": "i_equity", "cash": "cash", "debt": "debt", "ebit": "ebit", "da": "t_da", "ocf": "t_ocf", "capex": "t_capex", "gross_profit": "gross", "market_cap": "cap0", "ev": "ev"}


@query(f"""WITH RECURSIVE {_LEVELS} SELECT entity, {_of({k: v for k, v in _RAW.items() if k != "market_cap"}, 2)}, CASE WHEN s_suppkey % 11 <> 0 THEN round(abs(s_acctbal) * 100) * 1000.0::DOUBLE END AS market_cap
FROM figures JOIN supplier ON s_suppkey = entity""")
def measure_inputs(spark, d):
    raw = _measures(spark, d).select("entity", "raw_inputs.*")
    return _rounded(raw, *(k for k in _RAW if k != "market_cap"), digits=2).join(raw.select("entity", "market_cap"), "entity")


_LOST = f"""{_BEFORE},
missed AS (SELECT b.entity, b.metric, g.metric IS NOT NULL AS looked_at FROM last_grid b JOIN was USING (entity) JOIN now n ON n.entity = b.entity LEFT JOIN gated g ON g.entity = b.entity AND g.metric = b.metric
  WHERE b.pct IS NOT NULL AND g.pct IS NULL),
lost AS (SELECT entity, metric, looked_at AND CASE metric WHEN 'debt_equity' THEN debt IS NOT NULL AND i_equity IS NOT NULL WHEN 'net_debt_ebitda' THEN debt IS NOT NULL AND ebitda IS NOT NULL
    WHEN 'ebit_ev' THEN coalesce(ev <= 0, false) WHEN 'ebitda_ev' THEN coalesce(ev <= 0, false) WHEN 'fcf_ev' THEN coalesce(ev <= 0, false)
    WHEN 'roic' THEN ebit IS NOT NULL AND debt IS NOT NULL AND i_equity IS NOT NULL WHEN 'altman_z' THEN coalesce(liabilities = 0, false) ELSE false END AS economic
  FROM missed JOIN figures USING (entity)),
abandoned AS (SELECT entity, tag AS concept, en AS last_reported FROM ignored JOIN filer USING (entity) WHERE en >= {_DAY} - 450)"""


@query(f"WITH RECURSIVE {_MONTH}, {_IGNORED}, {_LOST} SELECT entity, metric, economic FROM lost")
def monthly_lost(spark, d):
    return month_of(spark, d, drift=True)["lost"].select("entity", "metric", "economic")


@query(f"""WITH RECURSIVE {_MONTH}, {_GONE}, {_IGNORED}, {_LOST},
sums AS (SELECT (SELECT count(*) FROM now) AS n_now, (SELECT count(*) FROM was) AS n_before, (SELECT count(*) FROM gone) AS n_dropped,
  (SELECT count(*) FROM lost WHERE NOT economic) AS n_lost, (SELECT count(*) FROM lost WHERE economic) AS n_economic, (SELECT count(*) FROM abandoned) AS n_abandoned)
SELECT *, round((n_now - n_before) * 100.0::DOUBLE / n_before, 2) AS change_pct,
  CASE WHEN round((n_now - n_before) * 100.0::DOUBLE / n_before, 2) <= -5 THEN 'block' WHEN round((n_now - n_before) * 100.0::DOUBLE / n_before, 2) <= -1 OR n_lost + n_dropped + n_abandoned > 0 THEN 'warn' ELSE 'ok' END AS status FROM sums""")
def monthly_drift(spark, d):
    return month_of(spark, d, drift=True)["drift"].select("n_now", "n_before", "n_dropped", "n_lost", "n_economic", "n_abandoned", "change_pct", "status")
