"""DuckDB twins of the registered queries, written against the same Parquet views.

``BOOK`` restates the whole book with windows and plain joins, independently of the Spark plans.
"""

from __future__ import annotations

BOOK = """
WITH filings AS (
  SELECT o_orderkey AS k, o_custkey // 15 AS m, CAST(o_orderdate AS DATE) + 92 AS filed,
    CASE WHEN o_orderkey % 17 = 3 THEN '13F-NT' WHEN month(o_orderdate) % 3 = 1 THEN '13F-HR' ELSE '13F-HR/A' END AS kind,
    CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period
  FROM orders),
keyed AS (
  SELECT *, lpad(CAST(k AS VARCHAR), 10, '0') AS accession, lpad(CAST(m AS VARCHAR), 10, '0') AS cik,
    year(filed) || 'q' || quarter(filed) || '_form13f.zip' AS archive,
    upper(strftime(period, '%d-%b-%Y')) AS label, upper(strftime(filed, '%d-%b-%Y')) AS filing_label,
    k % 97 <> 11 AS has_cover
  FROM filings),
primary_counts AS (
  SELECT archive, label, period, count(*) AS n, min(k) AS first_row FROM keyed WHERE kind = '13F-HR' GROUP BY ALL),
primary_periods AS (
  SELECT archive, label, period, n FROM primary_counts
  QUALIFY row_number() OVER (PARTITION BY archive ORDER BY n DESC, first_row) = 1),
periods AS (
  SELECT period, min(label) AS label, min(archive) AS source_archive FROM primary_periods GROUP BY period),
links AS (
  SELECT period, lag(period) OVER (ORDER BY period) AS previous_period, lead(period) OVER (ORDER BY period) AS next_period
  FROM periods),
covered AS (
  SELECT f.*,
    (kind LIKE '%/A' OR (has_cover AND k % 19 = 5)) AS amended,
    CASE WHEN NOT has_cover THEN '' WHEN k % 10 = 0 THEN 'RESTATEMENT' WHEN k % 50 = 7 THEN '' ELSE 'NEW HOLDINGS' END AS amendment,
    CASE WHEN has_cover THEN k % 5 ELSE 0 END AS amendment_no,
    CASE WHEN NOT has_cover THEN '' WHEN k % 29 = 0 THEN '13F COMBINATION REPORT' ELSE '13F HOLDINGS REPORT' END AS report_type,
    CASE WHEN NOT has_cover OR m % 100 = 9 THEN '' ELSE 'Manager ' || m END AS manager_name,
    CASE WHEN NOT has_cover THEN '' WHEN m % 2 = 0 THEN 'NY' ELSE 'CA' END AS state_country,
    k % 41 = 0 AS confidential
  FROM keyed f JOIN periods USING (period)),
events AS (
  SELECT * EXCLUDE (label), CASE WHEN NOT amended AND kind LIKE '13F-NT%' THEN 'NOTICE' WHEN NOT amended THEN 'BASE'
    WHEN amendment IN ('NEW HOLDINGS', 'RESTATEMENT') THEN amendment ELSE 'UNKNOWN AMENDMENT' END AS part_type
  FROM covered),
ranked_events AS (
  SELECT *, kind LIKE '13F-HR%' AS is_holdings,
    row_number() OVER (PARTITION BY cik, period, kind LIKE '13F-HR%' ORDER BY filed, amendment_no,
      CASE WHEN part_type = 'NEW HOLDINGS' THEN 1 ELSE 0 END, accession) AS rn
  FROM events),
chain AS (
  SELECT *, coalesce(max(CASE WHEN part_type <> 'NEW HOLDINGS' THEN rn END) OVER g, 1) AS last_reset,
    max(rn) OVER g AS last_rn,
    bool_or(part_type = 'UNKNOWN AMENDMENT' OR (rn = 1 AND part_type = 'NEW HOLDINGS')) OVER g AS inferred
  FROM ranked_events WHERE is_holdings WINDOW g AS (PARTITION BY cik, period)),
parts AS (SELECT * FROM chain WHERE rn >= last_reset),
lines AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_no, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS accession,
    lpad(CAST(l_partkey // 33 AS VARCHAR), 9, '0') AS cusip,
    CASE WHEN l_returnflag <> 'R' THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS position_type,
    CASE WHEN l_linenumber % 7 = 0 THEN 1 ELSE 0 END AS shares_type,
    CAST(floor(l_extendedprice) AS BIGINT) AS value,
    CASE WHEN l_orderkey % 37 <> 0 THEN l_quantity END AS shares,
    'HOLDING CO ' || (l_partkey // 33) || ' & SONS ' || (l_suppkey % 7) AS issuer,
    CASE WHEN l_linestatus = 'F' THEN 'COM' ELSE 'CL A' END AS class
  FROM lineitem),
observed AS (SELECT accession, count(*) AS n, CAST(sum(value) AS BIGINT) AS v FROM lines GROUP BY accession),
part_stats AS (
  SELECT p.accession, p.cik, p.period, p.part_type, p.archive,
    CASE WHEN k % 31 <> 0 THEN coalesce(o.n, 0) + CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END END AS reported_entry_count,
    CASE WHEN k % 53 <> 1 THEN coalesce(o.v, 0) + CASE WHEN k % 47 = 0 THEN 1 ELSE 0 END END AS reported_value,
    coalesce(o.n, 0) AS observed_entry_count, coalesce(o.v, 0) AS observed_value,
    CASE WHEN k % 31 <> 0 THEN k % 23 <> 0 END AS entry_count_matches,
    CASE WHEN k % 53 <> 1 THEN k % 47 <> 0 END AS value_matches,
    ((k % 31 <> 0 AND k % 23 = 0) OR (k % 53 <> 1 AND k % 47 = 0)) AS has_discrepancy
  FROM parts p LEFT JOIN observed o USING (accession)),
latest_any AS (
  SELECT * FROM ranked_events QUALIFY row_number() OVER (PARTITION BY cik, period ORDER BY is_holdings DESC, rn DESC) = 1),
group_flags AS (
  SELECT cik, period, bool_or(inferred) AS inferred, bool_or(confidential AND rn >= last_reset) AS confidential_omitted
  FROM chain GROUP BY cik, period),
part_counts AS (
  SELECT cik, period, count(*) AS part_count, bool_or(has_discrepancy) AS discrepant FROM part_stats GROUP BY cik, period),
first_status AS (
  SELECT l.cik, l.period, l.accession, l.filed, l.filing_label, l.report_type, l.manager_name, l.state_country, l.archive,
    coalesce(g.confidential_omitted, false) AS confidential_omitted, coalesce(c.part_count, 0) AS part_count,
    coalesce(c.discrepant, false) AS discrepant,
    CASE WHEN NOT l.is_holdings THEN 'NOTICE' WHEN g.inferred THEN 'INFERRED'
      WHEN g.confidential_omitted OR l.report_type <> '13F HOLDINGS REPORT' THEN 'PARTIAL' ELSE 'COMPLETE' END AS before_status
  FROM latest_any l LEFT JOIN group_flags g USING (cik, period) LEFT JOIN part_counts c USING (cik, period)),
quarters AS (
  SELECT *, CASE WHEN before_status = 'COMPLETE' AND discrepant THEN 'PARTIAL' ELSE before_status END AS coverage_status
  FROM first_status),
held_lines AS (SELECT l.*, p.cik, p.period, p.archive FROM lines l JOIN part_stats p USING (accession)),
positions AS (
  SELECT cik, period, cusip, position_type, shares_type, CAST(sum(value) AS BIGINT) AS value,
    CASE WHEN count(*) = 1 THEN max(shares) ELSE coalesce(sum(shares), 0.0) END AS shares
  FROM held_lines GROUP BY ALL),
first_filed AS (SELECT archive, min(filed) AS first_filed FROM keyed GROUP BY archive),
tickers AS (
  SELECT DISTINCT p_partkey // 33 AS n, lpad(CAST(p_partkey // 33 AS VARCHAR), 9, '0') AS cusip,
    CASE WHEN p_partkey // 33 % 11 = 0 THEN '' ELSE 'T' || (p_partkey // 33) END AS ticker FROM part),
securities AS (
  SELECT cusip, issuer, class, '' AS figi, coalesce(ticker, '') AS ticker FROM (
    SELECT * FROM held_lines JOIN first_filed USING (archive)
    QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY first_filed DESC, archive DESC, row_no, issuer DESC, class DESC) = 1)
  LEFT JOIN tickers USING (cusip)),
sectors AS (
  SELECT lower(ticker) AS ticker, CASE WHEN n % 3 = 0 THEN 'Technology' ELSE 'Finance' END AS sector,
    CASE WHEN n % 5 = 0 THEN '' ELSE 'Listed Company ' || n END AS name
  FROM tickers WHERE n % 11 <> 0 AND n % 4 <> 0),
manager_stats AS (
  SELECT q.cik, q.period, count(p.cusip) AS position_count, count(DISTINCT p.cusip) AS security_count,
    CAST(coalesce(sum(p.value), 0) AS BIGINT) AS total_value
  FROM quarters q LEFT JOIN positions p USING (cik, period) GROUP BY q.cik, q.period),
complete AS (SELECT cik, period FROM quarters WHERE coverage_status = 'COMPLETE'),
comparable AS (
  SELECT a.cik, a.period, l.previous_period FROM complete a JOIN links l USING (period)
  JOIN complete b ON b.cik = a.cik AND b.period = l.previous_period),
universe AS (SELECT cik, period, total_value FROM manager_stats JOIN complete USING (cik, period) WHERE total_value > 0),
dashboard AS (
  SELECT l.period, l.previous_period, (SELECT count(*) FROM universe u WHERE u.period = l.period) AS weight_manager_count,
    (SELECT count(*) FROM comparable c WHERE c.period = l.period) AS comparable_manager_count
  FROM links l),
manager_weights AS (
  SELECT p.period, p.cusip, p.cik, sum(p.value) * 1.0 / u.total_value AS weight
  FROM positions p JOIN universe u USING (cik, period) WHERE position_type = 0 GROUP BY p.period, p.cusip, p.cik, u.total_value),
holdings AS (SELECT DISTINCT cik, period, cusip FROM positions WHERE position_type = 0),
new_holders AS (
  SELECT h.period, h.cusip, count(*) AS new_holder_count FROM holdings h JOIN comparable c USING (cik, period)
  WHERE NOT EXISTS (SELECT 1 FROM holdings v WHERE v.cik = h.cik AND v.cusip = h.cusip AND v.period = c.previous_period)
  GROUP BY h.period, h.cusip),
weights AS (
  SELECT w.period, w.cusip, count(*) AS holder_count, sum(weight) AS weight_sum,
    100.0 * sum(weight) / any_value(d.weight_manager_count) AS avg_weight,
    coalesce(any_value(n.new_holder_count), 0) AS new_holder_count
  FROM manager_weights w JOIN dashboard d ON d.period = w.period
  LEFT JOIN new_holders n ON n.period = w.period AND n.cusip = w.cusip GROUP BY w.period, w.cusip),
bars AS (
  SELECT 'T' || (l_partkey // 33) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS price_date,
    CAST((sum(CAST(round(l_extendedprice * 100) AS HUGEINT)) * 200 + sum(CAST(l_quantity AS HUGEINT)))
      // (sum(CAST(l_quantity AS HUGEINT)) * 2) AS DOUBLE) / 10000.0 AS close
  FROM lineitem WHERE l_partkey // 33 % 11 <> 0 GROUP BY ALL),
trusted AS (SELECT cusip, ticker FROM tickers WHERE ticker <> '' AND n % 7 <> 0)
"""

LATEST = """, two AS (
  SELECT max(period) AS cur, (SELECT period FROM periods ORDER BY period DESC LIMIT 1 OFFSET {steps}) AS prev FROM periods),
sides AS (
  SELECT cusip, max(CASE WHEN period = cur THEN avg_weight END) AS weight,
    max(CASE WHEN period = cur THEN holder_count END) AS holders,
    max(CASE WHEN period = cur THEN new_holder_count END) AS fresh,
    max(CASE WHEN period = prev THEN avg_weight END) AS old_weight,
    max(CASE WHEN period = prev THEN new_holder_count END) AS old_fresh
  FROM weights, two WHERE period IN (cur, prev) GROUP BY cusip),
named AS (
  SELECT s.cusip, s.ticker, s.issuer, coalesce(nullif(c.name, ''), s.issuer) AS name, coalesce(c.sector, '') AS sector
  FROM securities s LEFT JOIN sectors c ON s.ticker <> '' AND lower(c.ticker) = lower(s.ticker)),
closes AS (
  SELECT symbol, max(CASE WHEN price_date = DATE '2001-09-03' THEN close END) AS mark_close,
    arg_max(close, price_date) FILTER (WHERE price_date < DATE '2001-09-03') AS previous_close,
    arg_max(close, price_date) FILTER (WHERE price_date BETWEEN DATE '2000-12-01' AND DATE '2000-12-31') AS base_close
  FROM bars GROUP BY symbol),
points AS (SELECT * FROM closes WHERE mark_close IS NOT NULL)
"""

_ROW = """cusip, ticker, issuer, name, sector, direction, {metric} AS metric, holders, mark_close AS price,
  CASE WHEN mark_close IS NOT NULL THEN '2001-09-03' END AS price_date,
  CASE WHEN previous_close > 0 THEN round(100.0 * (mark_close / previous_close - 1.0), 4) END AS day_change,
  CASE WHEN base_close > 0 THEN round(100.0 * (mark_close / base_close - 1.0), 4) END AS ytd_change"""

_RANKED = {
    "holdings": """SELECT cusip, weight AS metric, holders, weight AS avg_weight,
      CASE WHEN weight > coalesce(old_weight, 0) THEN 'up' WHEN weight < coalesce(old_weight, 0) THEN 'down' ELSE 'flat' END AS direction
      FROM sides WHERE weight IS NOT NULL""",
    "initiations": """SELECT cusip, fresh AS metric, holders, weight AS avg_weight,
      CASE WHEN fresh > coalesce(old_fresh, 0) THEN 'up' WHEN fresh < coalesce(old_fresh, 0) THEN 'down' ELSE 'flat' END AS direction
      FROM sides WHERE weight IS NOT NULL AND fresh > 0""",
    "gainers": """SELECT cusip, coalesce(weight, 0) - coalesce(old_weight, 0) AS metric, coalesce(holders, 0) AS holders,
      weight AS avg_weight, 'up' AS direction FROM sides WHERE coalesce(weight, 0) - coalesce(old_weight, 0) > 0""",
    "losers": """SELECT cusip, coalesce(weight, 0) - coalesce(old_weight, 0) AS metric, coalesce(holders, 0) AS holders,
      weight AS avg_weight, 'down' AS direction FROM sides WHERE coalesce(weight, 0) - coalesce(old_weight, 0) < 0""",
}


def view_sql(ranked: str, order: str, *, steps: int = 1, size: int = 100, offset: int = 0, mapped: bool = True) -> str:
    metric = "metric" if ranked == "initiations" else "round(metric, 4)"
    return f"""{BOOK}{LATEST.format(steps=steps)}, ranked AS ({_RANKED[ranked]})
SELECT {_ROW.format(metric=metric)}
FROM ranked JOIN named USING (cusip) LEFT JOIN points ON ticker <> '' AND symbol = ticker
{"WHERE ticker <> ''" if mapped else ""} ORDER BY {order} LIMIT {size} OFFSET {offset}"""


def book_sql(select: str) -> str:
    return BOOK + select
