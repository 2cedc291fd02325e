"""SQL twin of every registered query that SQL can state on whole tables."""

from __future__ import annotations

from oracle import BOOK, LATEST, book_sql, view_sql

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"

SQL: dict[str, str] = {}

# ---- filings ----------------------------------------------------------------------------------

SQL["primary_periods"] = book_sql("SELECT archive, label, n AS filings FROM primary_periods")
SQL["period_dimension"] = book_sql("SELECT CAST(period AS VARCHAR) AS period, label, source_archive FROM periods")
SQL["cover_last_row"] = book_sql("""
SELECT archive, accession AS accession_number, k * 2 + 1 AS row_no,
  CASE WHEN k % 10 = 0 THEN ' Restatement ' WHEN k % 50 = 7 THEN '' ELSE 'NEW HOLDINGS' END AS amendmenttype,
  CASE WHEN k % 5 = 0 THEN '' ELSE CAST(k % 5 AS VARCHAR) END AS amendmentno,
  CASE WHEN k % 29 = 0 THEN '13F COMBINATION REPORT' ELSE '13F HOLDINGS REPORT' END AS reporttype
FROM keyed WHERE has_cover""")
SQL["filing_part_types"] = book_sql("""
SELECT accession, cik, CAST(period AS VARCHAR) AS period, CAST(filed AS VARCHAR) AS filing_date,
  kind AS submission_type, part_type, amendment_no FROM events""")
SQL["effective_parts"] = book_sql("SELECT cik, CAST(period AS VARCHAR) AS period, accession, part_type FROM part_stats")
SQL["manager_coverage"] = book_sql("""
SELECT cik, CAST(period AS VARCHAR) AS period, accession, CAST(filed AS VARCHAR) AS filing_date, filing_label,
  archive AS source_archive, report_type, coverage_status, confidential_omitted, part_count FROM quarters""")
SQL["reconciliation"] = book_sql("""
SELECT accession, cik, CAST(period AS VARCHAR) AS period, reported_entry_count, reported_value, observed_entry_count,
  observed_value, entry_count_matches, value_matches, has_discrepancy FROM part_stats""")
SQL["coverage_downgrades"] = book_sql("""
SELECT CAST(period AS VARCHAR) AS period, count(*) FILTER (WHERE before_status = 'COMPLETE' AND discrepant) AS downgrades,
  count(*) AS manager_periods FROM quarters GROUP BY period""")
SQL["comparable_managers"] = book_sql("""
SELECT cik, CAST(period AS VARCHAR) AS period, CAST(previous_period AS VARCHAR) AS previous_period FROM comparable""")
SQL["manager_dimension"] = book_sql("""
SELECT cik, coalesce(nullif(manager_name, ''), 'CIK ' || cik) AS name, state_country,
  CAST(cik AS BIGINT) % 5 = 0 AND CAST(cik AS BIGINT) < 100 AS starred
FROM quarters QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period DESC) = 1""")
SQL["security_dimension"] = book_sql("SELECT cusip, issuer, class, figi, ticker FROM securities")

# ---- positions and rollups --------------------------------------------------------------------

SQL["typed_holdings_rows"] = """
SELECT l_orderkey * 8 + l_linenumber AS row_no, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS accession,
  'X' || lpad(CAST(l_partkey // 33 AS VARCHAR), 8, '0') AS cusip,
  CASE WHEN l_returnflag <> 'R' THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS position_type,
  CASE WHEN l_linenumber = 7 THEN 2 WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS shares_type,
  CASE WHEN l_orderkey % 5 > 1 AND l_orderkey % 43 = 2 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS value,
  CASE WHEN l_orderkey % 37 <> 0 THEN l_quantity END AS shares
FROM lineitem"""
SQL["positions_merged"] = book_sql("""
SELECT cik, CAST(period AS VARCHAR) AS period, cusip, position_type, shares_type, value, shares FROM positions""")
SQL["manager_period_stats"] = book_sql("""
SELECT cik, CAST(period AS VARCHAR) AS period, position_count, security_count, total_value FROM manager_stats""")
SQL["security_period_stats"] = book_sql("""
SELECT CAST(period AS VARCHAR) AS period, cusip, count(*) AS position_count, count(DISTINCT cik) AS manager_count,
  CAST(sum(value) AS BIGINT) AS total_value FROM positions GROUP BY period, cusip""")
_PERIOD_STATS = """
  SELECT q.period,
    (SELECT count(*) FROM positions p WHERE p.period = q.period) AS position_count,
    (SELECT CAST(coalesce(sum(value), 0) AS BIGINT) FROM positions p WHERE p.period = q.period) AS total_value,
    (SELECT count(DISTINCT cik) FROM positions p WHERE p.period = q.period) AS position_manager_count,
    (SELECT count(DISTINCT cusip) FROM positions p WHERE p.period = q.period) AS security_count,
    count(m.cik) AS manager_period_count,
    count(*) FILTER (WHERE coverage_status = 'COMPLETE') AS complete_manager_count,
    count(*) FILTER (WHERE coverage_status = 'PARTIAL') AS partial_manager_count,
    count(*) FILTER (WHERE coverage_status = 'INFERRED') AS inferred_manager_count,
    count(*) FILTER (WHERE coverage_status = 'NOTICE') AS notice_manager_count
  FROM periods q LEFT JOIN quarters m USING (period) GROUP BY q.period"""
SQL["period_stats"] = book_sql(f"""
SELECT * REPLACE (CAST(period AS VARCHAR) AS period) FROM ({_PERIOD_STATS})""")
SQL["stock_changes"] = book_sql(""", c AS (
  SELECT x.period, x.previous_period, p.cik, p.cusip, p.position_type, coalesce(sum(shares), 0) AS shares, sum(value) AS value
  FROM comparable x JOIN positions p ON p.cik = x.cik AND p.period = x.period WHERE shares_type = 0 GROUP BY ALL),
v AS (
  SELECT x.period, x.previous_period, p.cik, p.cusip, p.position_type, coalesce(sum(shares), 0) AS shares, sum(value) AS value
  FROM comparable x JOIN positions p ON p.cik = x.cik AND p.period = x.previous_period WHERE shares_type = 0 GROUP BY ALL),
k AS (SELECT period, previous_period, cik, cusip, position_type FROM c
  UNION SELECT period, previous_period, cik, cusip, position_type FROM v),
j AS (
  SELECT k.*, c.cik IS NOT NULL AS has_now, v.cik IS NOT NULL AS has_before, coalesce(c.shares, 0) AS s, coalesce(v.shares, 0) AS o,
    coalesce(c.value, 0) AS cv, coalesce(v.value, 0) AS ov
  FROM k LEFT JOIN c USING (period, cik, cusip, position_type) LEFT JOIN v USING (period, cik, cusip, position_type))
SELECT CAST(period AS VARCHAR) AS current_period, CAST(previous_period AS VARCHAR) AS previous_period, cusip, position_type,
  count(*) AS comparable_funds, count(*) FILTER (WHERE s > o) AS adding_funds, count(*) FILTER (WHERE s < o) AS cutting_funds,
  count(*) FILTER (WHERE s > o) - count(*) FILTER (WHERE s < o) AS net_add, count(*) FILTER (WHERE has_now) AS current_funds,
  count(*) FILTER (WHERE has_before) AS previous_funds, sum(s) - sum(o) AS net_units, CAST(sum(cv) AS BIGINT) AS current_value,
  CAST(sum(cv) - sum(ov) AS BIGINT) AS value_change
FROM j GROUP BY j.period, j.previous_period, cusip, position_type""")
SQL["period_change_totals"] = book_sql("""
SELECT CAST(l.period AS VARCHAR) AS current_period, CAST(l.previous_period AS VARCHAR) AS previous_period,
  CAST(coalesce((SELECT sum(value) FROM positions p JOIN comparable c ON c.cik = p.cik AND c.period = p.period
    WHERE p.period = l.period), 0) AS BIGINT) AS current_value,
  CAST(coalesce((SELECT sum(value) FROM positions p JOIN comparable c ON c.cik = p.cik AND c.previous_period = p.period
    WHERE p.period = l.previous_period), 0) AS BIGINT) AS previous_value
FROM links l WHERE l.previous_period IS NOT NULL""")
SQL["weight_universe"] = book_sql("""
SELECT CAST(period AS VARCHAR) AS period, CAST(previous_period AS VARCHAR) AS previous_period, weight_manager_count,
  comparable_manager_count FROM dashboard""")
SQL["security_weights"] = book_sql("""
SELECT CAST(period AS VARCHAR) AS period, cusip, holder_count, round(weight_sum, 6) AS weight_sum,
  round(avg_weight, 6) AS avg_weight FROM weights""")
# A price is a whole number of 2 ** -43, so whole numbers add up exactly.
SQL["exact_value_sums"] = """
SELECT l_partkey // 33 AS n, CAST(sum(CAST(l_extendedprice * 8796093022208 AS HUGEINT)) AS DOUBLE) / 8796093022208 AS total, count(*) AS rows
FROM lineitem GROUP BY l_partkey // 33"""
SQL["new_holders"] = book_sql("""
SELECT CAST(period AS VARCHAR) AS period, cusip, new_holder_count FROM weights WHERE new_holder_count > 0""")
SQL["snapshot_summary"] = book_sql(f""", stats AS ({_PERIOD_STATS})
SELECT (SELECT count(*) FROM periods) AS period_count, CAST(period AS VARCHAR) AS latest_period,
  position_count AS holding_count, total_value, position_manager_count AS distinct_managers, security_count AS distinct_issuers
FROM stats ORDER BY period DESC LIMIT 1""")
SQL["period_neighbours"] = book_sql("""
SELECT CAST(period AS VARCHAR) AS period, CAST(previous_period AS VARCHAR) AS previous_period,
  CAST(next_period AS VARCHAR) AS next_period FROM links""")

# ---- ranked views -----------------------------------------------------------------------------

_TOP = "metric DESC, holders DESC, cusip"
SQL["positions_deep_page"] = book_sql(""", placed AS (
  SELECT row_number() OVER (ORDER BY value DESC, cik, period, cusip, position_type, shares_type) AS place, * FROM positions)
SELECT place, cik, CAST(period AS VARCHAR) AS period, cusip, position_type, shares_type, value, coalesce(shares, 0.0) AS shares FROM placed
WHERE place > (SELECT count(*) * 3 // 4 FROM positions) AND place <= (SELECT count(*) * 3 // 4 FROM positions) + 200""")
SQL["top_holdings"] = view_sql("holdings", _TOP)
SQL["top_holdings_unmapped"] = view_sql("holdings", _TOP, size=200, mapped=False)
SQL["top_holdings_by_ticker_page2"] = view_sql(
    "holdings", f"lower(nullif(ticker, '')) ASC NULLS LAST, {_TOP}", size=20, offset=20)
SQL["top_holdings_by_name"] = view_sql("holdings", f"lower(nullif(name, '')) DESC NULLS LAST, {_TOP}", size=200)
SQL["top_holdings_by_sector"] = view_sql("holdings", f"lower(nullif(sector, '')) ASC NULLS LAST, {_TOP}", size=200)
SQL["top_holdings_by_price"] = view_sql("holdings", f"mark_close DESC NULLS LAST, {_TOP}", size=20)
_DAY = "CASE WHEN previous_close > 0 THEN mark_close / previous_close END"
_YTD = "CASE WHEN base_close > 0 THEN mark_close / base_close END"
SQL["top_holdings_by_day"] = view_sql("holdings", f"{_DAY} ASC NULLS LAST, {_TOP}", size=20)
SQL["price_sort_ytd"] = view_sql("holdings", f"{_YTD} DESC NULLS LAST, {_TOP}", size=20)
SQL["top_holdings_lowest"] = view_sql("holdings", "ranked.metric ASC, holders DESC, cusip", size=10)
SQL["fresh_initiations"] = view_sql("initiations", "ranked.metric DESC, avg_weight DESC, cusip")
SQL["movers_gainers_h1"] = view_sql("gainers", "ranked.metric DESC, cusip")
SQL["movers_losers_h2"] = view_sql("losers", "ranked.metric ASC, cusip", steps=2)
SQL["movers_gainers_h4_by_price"] = view_sql("gainers", "mark_close ASC NULLS LAST, ranked.metric DESC, cusip", steps=4)
SQL["movers_losers_h3_unmapped"] = view_sql("losers", "ranked.metric ASC, cusip", steps=3, mapped=False)
SQL["view_match_counts"] = BOOK + LATEST.format(steps=1) + """
SELECT 'holdings' AS view_name, count(*) AS matches FROM sides JOIN named USING (cusip) WHERE ticker <> '' AND weight IS NOT NULL
UNION ALL SELECT 'initiations', count(*) FROM sides JOIN named USING (cusip) WHERE ticker <> '' AND weight IS NOT NULL AND fresh > 0
UNION ALL SELECT 'gainers', count(*) FROM sides JOIN named USING (cusip)
  WHERE ticker <> '' AND coalesce(weight, 0) > coalesce(old_weight, 0)
UNION ALL SELECT 'losers', count(*) FROM sides JOIN named USING (cusip)
  WHERE ticker <> '' AND coalesce(weight, 0) < coalesce(old_weight, 0)"""


def _digits(value: str, digits: int) -> str:
    """Magnitude with fixed decimals; exact halves go up."""
    half = f"(abs({value}) * {2 ** (digits + 1)}.0 = floor(abs({value}) * {2 ** (digits + 1)}.0) AND "
    half += f"(abs({value}) * {2 ** (digits + 1)}.0 * {5 ** digits}.0) % 2 = 1)"
    return f"printf('%.{digits}f', CASE WHEN {half} THEN abs({value}) + 1e-{digits + 3} ELSE abs({value}) END)"


def _share(value: str) -> str:
    return f"CASE WHEN abs({value}) >= 1 THEN {_digits(value, 1)} ELSE {_digits(value, 2)} END"


def _percent(value: str) -> str:
    digits = _digits(value, 1)
    return (f"CASE WHEN {value} IS NULL THEN '—' ELSE CASE WHEN {digits} = '0.0' THEN '' WHEN {value} > 0 THEN '+' ELSE '−' END"
            f" || {digits} || '%' END")


def _money(value: str) -> str:
    half = f"(abs({value}) * 8.0 = floor(abs({value}) * 8.0) AND (abs({value}) * 8.0 * 25.0) % 2 = 1)"
    return (f"CASE WHEN {value} IS NULL THEN '—' ELSE '$' || "
            f"format('{{:,.2f}}', CASE WHEN {half} THEN abs({value}) + 1e-5 ELSE abs({value}) END) END")


SQL["report_rows"] = f"""WITH rows AS ({view_sql("holdings", _TOP, size=200, mapped=False)})
SELECT cusip, ticker,
  CASE WHEN regexp_matches(name, '[a-z]') THEN name
    ELSE regexp_replace(replace(replace(name, 'HOLDING', 'Holding'), 'SONS', 'Sons'), 'CO ', 'Co ') END AS display_name,
  CASE sector WHEN 'Technology' THEN 'Tech' WHEN 'Finance' THEN 'Fin' ELSE '—' END AS sector_short,
  direction, holders, {_share("metric")} || '%' AS metric_text, {_money("price")} AS price_text,
  {_percent("day_change")} AS day_text, {_percent("ytd_change")} AS ytd_text,
  CASE WHEN ticker = '' THEN '' ELSE 'https://finance.yahoo.com/quote/' || ticker END AS quote_url
FROM rows"""
SQL["weight_texts"] = book_sql(f""", r AS (
  SELECT period, cusip, new_holder_count, round(avg_weight, 4) AS w, round(avg_weight, 4) - 2 AS c FROM weights)
SELECT CAST(period AS VARCHAR) AS period, cusip, {_share("w")} || '%' AS weight_text,
  CASE WHEN c < 0 THEN '−' ELSE '+' END || {_share("c")} || 'pp' AS change_text, new_holder_count || ' new' AS new_text FROM r""")

# ---- prices -----------------------------------------------------------------------------------

SQL["weekly_bars"] = book_sql("SELECT symbol, CAST(price_date AS VARCHAR) AS price_date, close FROM bars")
SQL["price_mark_fields"] = BOOK + LATEST.format(steps=1) + """
SELECT cusip, ticker, mark_close AS price, CASE WHEN mark_close IS NOT NULL THEN '2001-09-03' END AS price_date,
  CASE WHEN previous_close > 0 THEN round(100.0 * (mark_close / previous_close - 1.0), 4) END AS day_change,
  CASE WHEN base_close > 0 THEN round(100.0 * (mark_close / base_close - 1.0), 4) END AS ytd_change
FROM tickers LEFT JOIN points ON ticker <> '' AND symbol = ticker"""
SQL["exact_close"] = book_sql("SELECT symbol, close AS mark_close FROM bars WHERE price_date = DATE '2001-09-03'")
_ASKED = """, asked AS (
  SELECT DISTINCT 'T' || (o_custkey // 25) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders)"""
SQL["asof_on_or_before"] = book_sql(f"""{_ASKED}
SELECT a.symbol, CAST(a.date AS VARCHAR) AS date, CAST(max(price_date) AS VARCHAR) AS before_date,
  arg_max(close, price_date) AS before_close
FROM asked a JOIN bars b ON b.symbol = a.symbol AND b.price_date <= a.date GROUP BY a.symbol, a.date""")
SQL["asof_first_after"] = book_sql(f"""{_ASKED}
SELECT a.symbol, CAST(a.date AS VARCHAR) AS date, CAST(min(price_date) AS VARCHAR) AS after_date,
  arg_min(close, price_date) AS after_close
FROM asked a JOIN bars b ON b.symbol = a.symbol AND b.price_date > a.date GROUP BY a.symbol, a.date""")
SQL["bars_upsert"] = book_sql(""", fresh AS (
  SELECT lower(symbol) AS symbol, CASE WHEN n % 2 = 0 THEN price_date ELSE price_date + 3000 END AS price_date, close + 1.0 AS close
  FROM (SELECT *, CAST(substr(symbol, 2) AS INTEGER) AS n FROM bars) WHERE n % 3 = 0),
both_batches AS (SELECT symbol, price_date, close, 0 AS batch FROM bars UNION ALL SELECT *, 1 FROM fresh)
SELECT symbol, CAST(price_date AS VARCHAR) AS price_date, round(close, 6) AS close FROM both_batches
QUALIFY row_number() OVER (PARTITION BY lower(symbol), price_date ORDER BY batch DESC) = 1""")
SQL["bars_file_upsert"] = SQL["bars_upsert"]
SQL["price_history_rows"] = book_sql("""
SELECT symbol, CAST(price_date AS VARCHAR) AS price_date, CAST(printf('%.2f', close) AS DOUBLE) AS close FROM bars""")

# ---- signals ----------------------------------------------------------------------------------

FACTORS = ("0.01, 0.02, 0.025, 0.04, 0.05, 0.1, 0.125, 0.2, 0.25, 1.0 / 3, 0.5, 2.0 / 3, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, "
           "10.0, 20.0, 25.0, 40.0, 50.0, 100.0")


def _factor(ratio: str) -> str:
    nearest = f"list_extract(list_sort(list_transform([{FACTORS}], lambda f: [abs(ln(({ratio}) / CAST(f AS DOUBLE))), CAST(f AS DOUBLE)])), 1)[2]"
    return f"CASE WHEN abs(({ratio}) / {nearest} - 1.0) <= 0.08 THEN {nearest} END"


SIGNALS = f""", share_pos AS (
  SELECT * FROM positions WHERE position_type = 0 AND shares_type = 0 AND shares IS NOT NULL),
quarter_closes AS (
  SELECT h.period, h.cusip, t.ticker, arg_max(b.close, b.price_date) AS close
  FROM (SELECT DISTINCT period, cusip FROM positions) h JOIN trusted t USING (cusip)
  JOIN bars b ON b.symbol = t.ticker AND b.price_date <= h.period GROUP BY ALL),
ratios AS (
  SELECT p.period, p.cusip, q.ticker, q.close, (p.value / p.shares) / q.close AS ratio
  FROM share_pos p JOIN quarter_closes q USING (period, cusip) WHERE p.shares > 0 AND p.value > 0),
medians AS (
  SELECT period, cusip, ticker, close, count(*) AS evidence_count, median(ratio) AS median_ratio FROM ratios GROUP BY ALL),
factors AS (SELECT * FROM (SELECT *, {_factor("median_ratio")} AS factor FROM medians) WHERE factor IS NOT NULL),
events_all AS (
  SELECT c.cik, c.period, c.previous_period, s.cusip FROM comparable c JOIN share_pos s ON s.cik = c.cik AND s.period = c.period
  UNION SELECT c.cik, c.period, c.previous_period, s.cusip FROM comparable c JOIN share_pos s ON s.cik = c.cik AND s.period = c.previous_period),
sided AS (
  SELECT e.*, coalesce(a.shares, 0) AS now_shares, coalesce(b.shares, 0) AS old_shares, t.ticker, q.filed,
    CASE WHEN a.cik IS NULL THEN 1.0 ELSE fa.factor END AS now_factor, CASE WHEN b.cik IS NULL THEN 1.0 ELSE fb.factor END AS old_factor
  FROM events_all e LEFT JOIN share_pos a ON a.cik = e.cik AND a.cusip = e.cusip AND a.period = e.period
  LEFT JOIN share_pos b ON b.cik = e.cik AND b.cusip = e.cusip AND b.period = e.previous_period
  LEFT JOIN factors fa ON fa.cusip = e.cusip AND fa.period = e.period
  LEFT JOIN factors fb ON fb.cusip = e.cusip AND fb.period = e.previous_period
  LEFT JOIN trusted t ON t.cusip = e.cusip JOIN quarters q ON q.cik = e.cik AND q.period = e.period),
deltas AS (
  SELECT *, now_shares * now_factor - old_shares * old_factor AS delta,
    greatest(1e-8, greatest(abs(now_shares * now_factor), abs(old_shares * old_factor)) * 1e-9) AS tolerance FROM sided),
candidates AS (
  SELECT *, delta IS NOT NULL AND ticker IS NOT NULL AS eligible FROM deltas
  WHERE CASE WHEN delta IS NULL THEN abs(now_shares - old_shares) > 1e-8 ELSE abs(delta) > tolerance END),
quotes AS (
  SELECT a.ticker, a.filed, min(b.price_date) AS reference_date, arg_min(b.close, b.price_date) AS reference_close, any_value(m.close) AS mark_close
  FROM (SELECT DISTINCT ticker, filed FROM candidates WHERE eligible) a JOIN bars b ON b.symbol = a.ticker AND b.price_date > a.filed
  JOIN bars m ON m.symbol = a.ticker AND m.price_date = DATE '2001-09-03'
  GROUP BY a.ticker, a.filed HAVING min(b.price_date) <= DATE '2001-09-03'),
priced AS (
  SELECT c.*, q.reference_date, abs(delta) * reference_close AS gross, delta * (mark_close - reference_close) AS pnl
  FROM candidates c LEFT JOIN quotes q ON c.eligible AND q.ticker = c.ticker AND q.filed = c.filed),
sums AS (
  SELECT cik, period, count(*) AS candidate_events, count(*) FILTER (WHERE eligible) AS eligible_events, count(gross) AS priced_events,
    count(*) FILTER (WHERE gross IS NOT NULL AND delta > 0) AS buy_events, count(*) FILTER (WHERE gross IS NOT NULL AND delta < 0) AS sell_events,
    count(*) FILTER (WHERE pnl > 0) AS hit_events, coalesce(CAST(sum(CAST(pnl AS DECIMAL(38, 9))) AS DOUBLE), 0) AS pnl,
    coalesce(CAST(sum(CAST(gross AS DECIMAL(38, 9))) AS DOUBLE), 0) AS gross,
    coalesce(sum(gross * gross), 0) AS squares, min(reference_date) AS reference_date
  FROM priced GROUP BY cik, period),
score_base AS (
  SELECT q.cik, q.period, l.previous_period, q.filed, c.cik IS NOT NULL AS both_complete, s.reference_date,
    coalesce(candidate_events, 0) AS candidate_events, coalesce(eligible_events, 0) AS eligible_events,
    coalesce(priced_events, 0) AS priced_events, coalesce(buy_events, 0) AS buy_events, coalesce(sell_events, 0) AS sell_events,
    coalesce(hit_events, 0) AS hit_events, coalesce(pnl, 0) AS pnl, coalesce(gross, 0) AS gross, coalesce(squares, 0) AS squares
  FROM quarters q JOIN links l USING (period) LEFT JOIN comparable c ON c.cik = q.cik AND c.period = q.period
  LEFT JOIN sums s ON s.cik = q.cik AND s.period = q.period),
score_rates AS (
  SELECT *, CASE WHEN eligible_events > 0 THEN 100.0 * priced_events / eligible_events ELSE 0.0 END AS coverage,
    CASE WHEN squares > 0 THEN gross * gross / squares ELSE 0.0 END AS bets FROM score_base),
score_reasons AS (
  SELECT *, CASE WHEN previous_period IS NULL THEN 'no earlier quarter is available' ELSE concat_ws('; ',
    CASE WHEN NOT both_complete THEN 'adjacent filings are not both complete' END,
    CASE WHEN priced_events < 10 THEN 'fewer than 10 priced signals' END,
    CASE WHEN coverage < 80 THEN 'priced coverage below 80%' END,
    CASE WHEN bets < 5 THEN 'effective bets below 5' END) END AS reason FROM score_rates)
"""

SQL["price_targets"] = book_sql("""
SELECT DISTINCT t.ticker AS symbol FROM trusted t JOIN positions p USING (cusip)
WHERE position_type = 0 AND shares_type = 0 AND shares IS NOT NULL
UNION SELECT DISTINCT ticker FROM securities WHERE ticker <> ''""")
SQL["split_factors"] = book_sql(SIGNALS + """
SELECT CAST(period AS VARCHAR) AS period, cusip, ticker, close, evidence_count, round(median_ratio, 6) AS median_ratio,
  round(factor, 6) AS factor FROM factors""")
SQL["scope_values"] = book_sql(SIGNALS + """, value_ratios AS (
  SELECT p.cik, p.period, p.value / (p.shares * f.close * f.factor) AS r
  FROM share_pos p JOIN factors f USING (period, cusip) WHERE p.shares > 0 AND p.value > 0),
scopes AS (
  SELECT m.cik, m.period, m.total_value, count(r) AS evidence_count, median(r) AS median_value_ratio
  FROM manager_stats m LEFT JOIN value_ratios v ON v.cik = m.cik AND v.period = m.period GROUP BY m.cik, m.period, m.total_value),
scaled AS (
  SELECT *, coalesce(evidence_count >= 3 AND median_value_ratio BETWEEN 0.0005 AND 0.002, false) AS scale_inferred FROM scopes)
SELECT cik, CAST(period AS VARCHAR) AS period, total_value AS raw_reported_value,
  CAST(CASE WHEN scale_inferred THEN 1000 ELSE 1 END AS BIGINT) AS value_scale,
  CAST(least(CAST(total_value AS HUGEINT) * CASE WHEN scale_inferred THEN 1000 ELSE 1 END, 9000000000000000000) AS BIGINT) AS scope_value,
  evidence_count, round(median_value_ratio, 6) AS median_value_ratio, scale_inferred FROM scaled""")
SQL["fund_scores"] = book_sql(SIGNALS + """
SELECT cik, CAST(period AS VARCHAR) AS period, CAST(previous_period AS VARCHAR) AS previous_period,
  CAST(filed AS VARCHAR) AS filing_date, CAST(reference_date AS VARCHAR) AS reference_date, '2001-09-03' AS mark_date,
  round(CASE WHEN reason = '' AND gross > 0 THEN 100.0 * pnl / gross END, 8) AS signal_return,
  round(CASE WHEN gross > 0 THEN 100.0 * pnl / gross END, 8) AS raw_signal_return,
  round(CASE WHEN reason = '' THEN pnl END, 8) AS signal_pnl, round(CASE WHEN gross > 0 THEN pnl END, 8) AS raw_signal_pnl,
  round(CASE WHEN gross > 0 THEN gross END, 8) AS gross_notional, candidate_events, eligible_events, priced_events, buy_events,
  sell_events, hit_events, round(coverage, 8) AS signal_coverage, round(bets, 8) AS effective_bets, reason = '' AS rankable, reason
FROM score_reasons""")
SQL["event_counts_by_security"] = book_sql(SIGNALS + """
SELECT cusip, count(*) AS candidates, count(*) FILTER (WHERE eligible) AS eligible, count(gross) AS priced,
  count(*) FILTER (WHERE pnl > 0) AS hits FROM priced GROUP BY cusip""")
SQL["nearest_split_factor"] = f"""
WITH r AS (SELECT l_extendedprice / l_quantity / p_retailprice AS ratio FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT round({_factor("ratio")}, 6) AS factor FROM r)
SELECT factor, count(*) AS lines FROM f GROUP BY factor"""
SQL["unit_price_medians"] = """
SELECT l_partkey // 33 AS n, count(*) AS rows, round(median(l_extendedprice / l_quantity), 6) AS median_price
FROM lineitem GROUP BY l_partkey // 33"""

# ---- text and reference data ------------------------------------------------------------------

SQL["issuer_keys"] = """
WITH t AS (SELECT doc_id, trim(regexp_replace(replace(upper(strip_accents(replace(text, 'ß', 'SS'))), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')) AS name_key
  FROM documents)
SELECT doc_id, md5(name_key) AS key_hash, length(name_key) AS key_length FROM t"""
SQL["collapsed_texts"] = rf"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, md5(t) AS text_hash, length(t) AS text_length FROM t"""
SQL["ticker_keys"] = """
WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' ' || c_name WHEN 1 THEN substr(c_name, 10, 9)
  WHEN 2 THEN '' ELSE c_name || ' of a much longer name' END AS raw FROM customer)
SELECT c_custkey, CASE WHEN length(raw) > 32 THEN '' ELSE upper(raw) END AS ticker FROM t"""
SQL["display_names"] = """
SELECT p_partkey, p_name || ' inc.' || CASE p_partkey % 8 WHEN 4 THEN ' Preferred Stock Units' WHEN 6 THEN ' Warrants'
  ELSE '' END AS display_name FROM part"""
SQL["tidy_names"] = """
WITH w AS (SELECT *, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' '
  || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS title FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name
  ELSE title || ' & ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' Inc.' ELSE ' Hldgs (USA) O''neil-Co' END END AS tidy_name FROM w"""
SQL["change_texts"] = f"""
WITH c AS (SELECT l_discount * 100 - 5 + l_linenumber / 16.0 AS x, round(l_extendedprice / 8, 3) AS y FROM lineitem)
SELECT {_percent("x")} AS change_text, {_money("y")} AS price_text, count(*) AS lines FROM c GROUP BY ALL"""
SQL["parsed_closes"] = """
SELECT l_orderkey, l_linenumber, count(*) AS lines, round(max(l_extendedprice), 2) AS max_close
FROM lineitem WHERE l_linenumber < 6 GROUP BY l_orderkey, l_linenumber"""
SQL["completed_market_dates"] = """
WITH e AS (
  SELECT event_id, ts, make_date(year(ts), 3, 8) AS march, make_date(year(ts), 11, 1) AS november FROM events),
d AS (
  SELECT event_id, ts - CASE WHEN ts >= march + CAST((7 - dayofweek(march)) % 7 AS INTEGER) + INTERVAL 7 HOUR
    AND ts < november + CAST((7 - dayofweek(november)) % 7 AS INTEGER) + INTERVAL 6 HOUR
    THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS eastern FROM e),
c AS (SELECT event_id, CAST(eastern AS DATE) - CASE WHEN hour(eastern) < 17 THEN 1 ELSE 0 END AS day FROM d)
SELECT event_id, CAST(day - CASE dayofweek(day) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS VARCHAR) AS market_date FROM c"""
_STOCK = """
WITH stock AS (
  SELECT p_partkey AS row_no, CASE WHEN p_partkey % 31 = 0 THEN '' ELSE 'S' || (p_partkey % 1500) END AS symbol,
    p_name || ' Co' AS name, p_type AS sector,
    CASE WHEN p_partkey % 17 <> 0 THEN CAST(round_even(CAST(printf('%.1f', p_retailprice * 1000 + 0.5) AS DOUBLE), 0) AS BIGINT) END AS cap
  FROM part),
etf AS (
  SELECT s_suppkey AS row_no, CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 'E' END || s_suppkey AS symbol,
    CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || ' Fund Units' END AS name FROM supplier),
merged AS (
  SELECT symbol AS ticker, sector, name, 1 AS rank, row_no FROM stock WHERE symbol <> ''
  UNION ALL SELECT symbol, 'ETF', name, 0, row_no FROM etf),
sector_map AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY rank DESC, row_no DESC) = 1)
"""
SQL["market_cap_snapshot"] = _STOCK + """
SELECT symbol AS ticker, arg_max(cap, row_no) AS market_cap FROM stock WHERE symbol <> '' AND cap IS NOT NULL GROUP BY symbol"""
SQL["sector_merge"] = _STOCK + "SELECT ticker, sector, name FROM sector_map"
SQL["sector_values"] = _STOCK + "SELECT DISTINCT sector FROM sector_map WHERE sector <> ''"
SQL["screener_documents"] = """
SELECT CASE WHEN p_partkey % 31 = 0 THEN '' ELSE 'S' || (p_partkey % 1500) END AS symbol, p_name || '  Co Common Stock' AS name,
  count(*) AS documents FROM part GROUP BY ALL"""
SQL["identity_documents"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS cik, s_name AS name, 't' || s_suppkey AS ticker FROM supplier"""

# ---- identifier resolution --------------------------------------------------------------------

_RESOLVE = """
WITH own AS (
  SELECT c_custkey AS k, CAST(c_custkey * 7 AS VARCHAR) AS cik, c_custkey + 10000000000 AS row_no,
    CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) || ' & Co.' ELSE c_name || ', INC' END AS name, 'C' || c_custkey AS ticker
  FROM customer),
identities AS (
  SELECT p_partkey AS row_no, CAST(p_partkey % 64 AS VARCHAR) AS cik, p_name AS name, 'P' || (p_partkey % 64) AS ticker FROM part
  UNION ALL SELECT row_no, cik, name, ticker FROM own
  UNION ALL SELECT row_no + 10000000000, cik, upper(name), ticker || '/W' FROM own WHERE row_no % 11 = 0),
named_ids AS (
  SELECT *, trim(regexp_replace(replace(upper(name), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')) AS name_key FROM identities),
safe AS (
  SELECT name_key, min(ticker) AS ticker, min(cik) AS cik, arg_min(name, row_no) AS name FROM named_ids
  GROUP BY name_key HAVING count(DISTINCT ticker) = 1 AND count(DISTINCT cik) = 1),
listed AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 23 = 0 THEN 'BAD' || c_custkey ELSE 'X' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS cusip,
    CASE WHEN c_custkey % 9 = 4 THEN 'Shared Name Trust' WHEN c_custkey % 10 = 0 THEN c_name || ' and co' ELSE upper(c_name) || ' Inc.' END AS issuer,
    CASE WHEN c_custkey % 3 = 0 THEN 'FIGI' || c_custkey ELSE '' END AS figi,
    CASE WHEN c_custkey % 6 = 1 THEN 'C' || c_custkey ELSE '' END AS ticker,
    latest_value, coalesce(latest_funds, 0) AS latest_funds
  FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS latest_value, count(*) AS latest_funds
    FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
keyed_list AS (
  SELECT *, trim(regexp_replace(replace(upper(issuer), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')) AS name_key FROM listed),
matches AS (
  SELECT l.cusip, l.name_key, s.ticker AS name_ticker, s.cik AS name_cik, s.name FROM keyed_list l JOIN safe s USING (name_key)
  WHERE l.name_key IN (SELECT name_key FROM keyed_list GROUP BY name_key HAVING count(DISTINCT cusip) = 1)),
records AS (
  SELECT cusip, k, CASE WHEN k % 5 = 1 OR k % 8 IN (0, 2) THEN 'C' || k END AS ticker,
    CASE WHEN k % 5 = 1 THEN 'openfigi' WHEN k % 8 = 0 THEN 'sec_name' WHEN k % 8 = 2 THEN 'legacy_cache' END AS source,
    CASE k % 5 WHEN 0 THEN 'unqueried' WHEN 1 THEN 'resolved' WHEN 2 THEN 'not_found' WHEN 3 THEN 'ambiguous' ELSE 'error' END AS status,
    CASE WHEN k % 5 > 0 THEN CASE WHEN k % 7 = 0 THEN 'UN' ELSE 'US' END ELSE '' END AS exchange, k % 5 > 0 AS checked
  FROM listed WHERE k % 2 = 0),
overrides AS (SELECT cusip, 'M' || k AS ticker FROM listed WHERE k % 50 = 7 AND k % 23 <> 0),
answers AS (
  SELECT *, CASE WHEN k % 23 = 0 THEN 'invalid_cusip' WHEN k % 8 = 5 THEN 'not_found' WHEN k % 8 = 6 THEN 'rejected'
      WHEN k % 8 IN (4, 7) THEN 'not_found'
      WHEN k % 8 = 2 AND figi <> '' THEN 'figi_mismatch' WHEN k % 8 = 3 THEN 'no_ticker'
      WHEN k % 8 = 1 AND figi = '' THEN 'ambiguous' ELSE 'resolved' END AS status
  FROM listed WHERE k % 3 <> 1),
resolved AS (
  SELECT cusip, k, figi, status, CASE WHEN status = 'resolved' THEN CASE WHEN k % 8 = 2 THEN 'Z' ELSE 'C' END || k END AS ticker FROM answers),
seeds AS (
  SELECT l.cusip, l.ticker, l.issuer, coalesce(r.ticker, '') AS cached,
    CASE WHEN r.ticker IS NULL THEN 'seed' WHEN r.ticker <> l.ticker THEN 'conflict' ELSE 'keep' END AS action
  FROM listed l LEFT JOIN records r USING (cusip) WHERE l.ticker <> '' AND l.cusip NOT IN (SELECT cusip FROM overrides)),
seeded AS (
  SELECT cusip, CASE WHEN s.action = 'seed' THEN s.ticker ELSE r.ticker END AS ticker,
    CASE WHEN s.action = 'seed' THEN 'existing_db' ELSE r.source END AS source, coalesce(r.status, 'unqueried') AS status
  FROM records r FULL OUTER JOIN (SELECT * FROM seeds WHERE action = 'seed') s USING (cusip)),
after_lookup AS (
  SELECT cusip, CASE WHEN a.cusip IS NULL THEN r.ticker WHEN a.status = 'resolved' THEN a.ticker
      WHEN r.source = 'openfigi' OR a.status IN ('ambiguous', 'figi_mismatch') THEN NULL ELSE r.ticker END AS ticker,
    CASE WHEN a.cusip IS NULL THEN r.source WHEN a.status = 'resolved' THEN 'openfigi'
      WHEN r.source = 'openfigi' OR a.status IN ('ambiguous', 'figi_mismatch') THEN NULL ELSE r.source END AS source,
    coalesce(a.status, r.status) AS status
  FROM seeded r FULL OUTER JOIN resolved a USING (cusip)),
cleared AS (
  SELECT cusip, CASE WHEN source = 'sec_name' THEN NULL ELSE ticker END AS ticker,
    CASE WHEN source = 'sec_name' THEN NULL ELSE source END AS source, status FROM after_lookup),
offered AS (
  SELECT cusip, c.ticker, c.source, coalesce(c.status, 'unqueried') AS status, m.name_ticker, m.name_cik,
    m.cusip IS NOT NULL AND coalesce(c.status, 'unqueried') NOT IN ('resolved', 'ambiguous', 'figi_mismatch') AND c.ticker IS NULL AS take
  FROM cleared c FULL OUTER JOIN matches m USING (cusip)),
final_records AS (
  SELECT cusip, CASE WHEN take THEN name_ticker ELSE ticker END AS ticker, CASE WHEN take THEN 'sec_name' ELSE source END AS source,
    status, CASE WHEN take THEN name_cik END AS sec_cik FROM offered),
mapping AS (
  SELECT cusip, ticker, coalesce(source, 'unknown') AS source FROM final_records
  WHERE ticker IS NOT NULL AND cusip NOT IN (SELECT cusip FROM overrides)
  UNION ALL SELECT cusip, ticker, 'manual_verified' FROM overrides)
"""
SQL["safe_name_index"] = _RESOLVE + "SELECT name_key, ticker, cik, name FROM safe"
SQL["name_matches"] = _RESOLVE + "SELECT cusip, name_key, name_ticker, name_cik, name FROM matches"
SQL["exact_resolution"] = _RESOLVE + """
SELECT cusip, ticker, CASE WHEN status = 'resolved' THEN 'openfigi' END AS source, status AS openfigi_status,
  CASE WHEN k % 23 <> 0 AND k % 8 = 5 THEN 'No identifier found.' WHEN k % 23 <> 0 AND k % 8 = 6 THEN 'Bad request' END AS openfigi_message,
  CAST(CASE WHEN status IN ('resolved', 'ambiguous', 'no_ticker', 'figi_mismatch') THEN CASE WHEN k % 8 < 2 THEN 2 ELSE 1 END ELSE -1 END AS BIGINT) AS result_count,
  CAST(CASE WHEN status IN ('resolved', 'ambiguous', 'no_ticker') THEN CASE WHEN k % 8 = 0 OR (k % 8 = 1 AND figi = '') THEN 2 ELSE 1 END ELSE -1 END AS BIGINT) AS considered_count,
  CASE WHEN status = 'ambiguous' THEN 'C' || k || ',Z' || k END AS candidate_tickers,
  CASE WHEN status = 'figi_mismatch' THEN 'FIGI-OTHER' END AS returned_figis,
  CASE WHEN status = 'resolved' THEN CASE WHEN k % 8 = 2 THEN 'FIGI-OTHER' ELSE 'FIGI' || k END END AS matched_figis
FROM resolved"""
SQL["seed_actions"] = _RESOLVE + "SELECT cusip, ticker, issuer, cached, action FROM seeds"
SQL["merged_records"] = _RESOLVE + "SELECT cusip, ticker, source, status AS openfigi_status, sec_cik FROM final_records"
SQL["ticker_mapping"] = _RESOLVE + "SELECT cusip, ticker, source FROM mapping"
SQL["cache_statistics"] = _RESOLVE + """
SELECT 'source' AS kind, label, count(*) AS securities FROM (
  SELECT coalesce(source, 'unknown') AS label FROM final_records WHERE ticker IS NOT NULL
  UNION ALL SELECT 'manual_verified' FROM overrides) GROUP BY label
UNION ALL SELECT 'status', status, count(*) FROM final_records GROUP BY status"""
SQL["fill_only_mapping"] = _RESOLVE + """
SELECT cusip, l.ticker AS current, m.ticker AS mapped,
  CASE WHEN l.ticker = '' THEN 'fill' WHEN l.ticker = m.ticker THEN 'same' ELSE 'conflict' END AS action
FROM listed l JOIN mapping m USING (cusip)"""
SQL["filled_securities"] = _RESOLVE + """
SELECT cusip, CASE WHEN l.ticker = '' THEN coalesce(m.ticker, '') ELSE l.ticker END AS ticker
FROM listed l LEFT JOIN mapping m USING (cusip)"""
SQL["lookup_topk"] = _RESOLVE + """
SELECT l.cusip, coalesce(latest_value, 0) AS latest_value, latest_funds
FROM listed l LEFT JOIN records r USING (cusip)
WHERE (coalesce(r.checked, false) OR coalesce(r.status, '') IN ('resolved', 'not_found', 'ambiguous')) AND r.exchange <> 'US'
  OR NOT ((l.ticker <> '' AND coalesce(r.source, '') <> 'sec_name') OR coalesce(r.status, '') IN ('resolved', 'not_found', 'ambiguous'))
ORDER BY latest_value DESC NULLS LAST, latest_funds DESC, l.cusip LIMIT 50"""
SQL["security_relevance"] = book_sql("""
SELECT s.cusip, CAST(coalesce(sum(p.value), 0) AS BIGINT) AS latest_value, count(DISTINCT p.cik) AS latest_funds
FROM securities s LEFT JOIN positions p ON p.cusip = s.cusip AND p.period = (SELECT max(period) FROM periods) GROUP BY s.cusip""")
SQL["identity_rule"] = _RESOLVE + """
SELECT count(*) AS found, 1000 AS required FROM (SELECT DISTINCT cik, ticker FROM identities)"""

# ---- quality ----------------------------------------------------------------------------------


def _kpi(name: str, expression: str, table: str) -> str:
    return f"SELECT 'data_quality_{name}_count' AS key, {expression} AS value FROM {table}"


SQL["quality_kpis"] = book_sql("\nUNION ALL ".join([
    _kpi("effective_filing_part", "count(*)", "part_stats"),
    _kpi("summary_discrepancy_part", "count(*) FILTER (WHERE has_discrepancy)", "part_stats"),
    _kpi("summary_discrepancy_manager_period", "count(*)",
         "(SELECT DISTINCT cik, period FROM part_stats WHERE has_discrepancy)"),
    _kpi("summary_entry_mismatch_part", "count(*) FILTER (WHERE NOT entry_count_matches)", "part_stats"),
    _kpi("summary_value_mismatch_part", "count(*) FILTER (WHERE NOT value_matches)", "part_stats"),
    _kpi("summary_unavailable_field",
         "count(*) FILTER (WHERE entry_count_matches IS NULL) + count(*) FILTER (WHERE value_matches IS NULL)", "part_stats"),
    _kpi("coverage_downgrade", "count(*) FILTER (WHERE before_status = 'COMPLETE' AND discrepant)", "quarters"),
    _kpi("missing_ticker_security", "count(*) FILTER (WHERE ticker = '')", "securities"),
    _kpi("null_shares_position", "count(*) FILTER (WHERE shares IS NULL)", "positions"),
    _kpi("zero_value_position", "count(*) FILTER (WHERE value = 0)", "positions"),
    *[_kpi(f"{status.lower()}_manager_period", f"count(*) FILTER (WHERE coverage_status = '{status}')", "quarters")
      for status in ("COMPLETE", "PARTIAL", "INFERRED", "NOTICE")]]))
# On sound tables every rule counts zero; a rule that is missing, renamed, or fires shows as a difference.
_RULES = (
    "manager-period stats row count", "security-period stats row count", "period stats row count",
    "period-change total row count", "filing-part stats row count", "dashboard period stats row count",
    "security weight stats row count", "manager stats position total", "manager stats value total",
    "security stats position total", "security stats value total", "negative position values", "invalid positions",
    "orphan positions", "orphan effective filing parts", "missing latest effective filing parts",
    "orphan filing-part stats", "orphan manager-period stats", "orphan security-period stats", "orphan period stats",
    "orphan dashboard period stats", "orphan security weight stats", "invalid effective filing part types",
    "invalid coverage statuses", "negative materialized statistics", "invalid summary reconciliation flags",
    "invalid dashboard statistics", "empty sector tickers", "invalid market caps", "invalid manager flags",
    "summary discrepancies marked complete", "dashboard previous-period links", "dashboard weight-universe counts",
    "dashboard comparable-manager counts", "period stats mismatches", "manager-period stats mismatches",
    "security-period stats mismatches", "period-change portfolio totals mismatches",
    "latest-period security weight mismatches", "latest-period new-holder mismatches", "orphan changes",
    "orphan change totals",
)
SQL["quality_rules"] = "SELECT unnest([" + ", ".join(f"'{rule}'" for rule in _RULES) + "]) AS rule, CAST(0 AS BIGINT) AS violations"
SQL["quality_rules_tampered"] = book_sql(f""", stats AS ({_PERIOD_STATS}),
sec_stats AS (SELECT DISTINCT period, cusip FROM positions),
shares_held AS (
  SELECT DISTINCT p.cusip FROM comparable c JOIN positions p ON p.cik = c.cik AND p.period IN (c.period, c.previous_period)
  WHERE shares_type = 0),
statuses AS (SELECT cik, period, coverage_status FROM quarters),
fired AS (
  SELECT 'manager stats position total' AS rule, count(*) AS violations FROM manager_stats WHERE cik LIKE '%3'
  UNION ALL SELECT 'manager-period stats mismatches', 2 * count(*) FROM manager_stats WHERE cik LIKE '%3'
  UNION ALL SELECT 'orphan positions', count(DISTINCT cusip) FROM positions WHERE CAST(cusip AS INTEGER) % 10 = 4
  UNION ALL SELECT 'orphan security-period stats', count(*) FROM sec_stats WHERE CAST(cusip AS INTEGER) % 10 = 4
  UNION ALL SELECT 'orphan security weight stats', count(*) FROM weights WHERE CAST(cusip AS INTEGER) % 10 = 4
  UNION ALL SELECT 'orphan changes', count(*) FROM shares_held WHERE CAST(cusip AS INTEGER) % 10 = 4
  UNION ALL SELECT 'latest-period new-holder mismatches', count(*) FROM weights
    WHERE CAST(cusip AS INTEGER) % 10 = 7 AND period = (SELECT max(period) FROM periods)
  UNION ALL SELECT 'latest-period security weight mismatches', count(*) FROM weights
    WHERE CAST(cusip AS INTEGER) % 10 = 8 AND period = (SELECT max(period) FROM periods)
  UNION ALL SELECT 'invalid positions', count(*) FROM positions WHERE CAST(cusip AS INTEGER) % 10 = 6 AND shares_type = 1
  UNION ALL SELECT 'empty sector tickers', count(*) FROM sectors WHERE sector = 'Finance'
  UNION ALL SELECT 'invalid coverage statuses', count(*) FROM statuses WHERE coverage_status = 'NOTICE'
  UNION ALL SELECT 'period stats mismatches', 2 * count(*) FROM stats WHERE notice_manager_count > 0
  UNION ALL SELECT 'invalid summary reconciliation flags', count(*) FROM part_stats WHERE cik LIKE '%2'
  UNION ALL SELECT 'summary discrepancies marked complete', count(*) FROM part_stats JOIN statuses USING (cik, period)
    WHERE coverage_status = 'COMPLETE' AND (CASE WHEN cik LIKE '%2' THEN NOT has_discrepancy ELSE has_discrepancy END)
  UNION ALL SELECT 'dashboard weight-universe counts', count(*) FROM periods WHERE year(period) = 1997
  UNION ALL SELECT 'dashboard comparable-manager counts', count(*) FROM periods WHERE year(period) = 1998
  UNION ALL SELECT 'period-change total row count', count(*) FROM links WHERE previous_period IS NOT NULL AND year(period) = 1996
  UNION ALL SELECT 'period-change portfolio totals mismatches', count(*) FROM links WHERE previous_period IS NOT NULL AND year(period) = 1996)
SELECT rule, CAST(violations AS BIGINT) AS violations FROM fired WHERE violations > 0""")
SQL["score_rule"] = book_sql(SIGNALS + """
SELECT 'duplicate manager-period scores' AS rule, count(*) AS violations FROM (
  SELECT cik, period FROM score_reasons GROUP BY cik, period HAVING count(*) > 1)""")
SQL["mark_coverage"] = book_sql("""
SELECT count(DISTINCT symbol) AS mark_symbols, least(250, greatest(1, (SELECT count(*) FROM (
  SELECT DISTINCT t.ticker FROM trusted t JOIN positions p USING (cusip)
  WHERE position_type = 0 AND shares_type = 0 AND shares IS NOT NULL
  UNION SELECT DISTINCT ticker FROM securities WHERE ticker <> '')) // 2)) AS required
FROM bars WHERE price_date = DATE '2001-09-03'""")

# ---- jobs and landed documents ----------------------------------------------------------------

SQL["fund_scores_job"] = SQL["fund_scores"]
_TRUSTED_COUNT = book_sql(SIGNALS + "SELECT count(DISTINCT ticker) AS n FROM trusted")
SQL["signal_metadata_counts"] = f"""
WITH scores AS ({SQL["fund_scores"]}), scopes AS ({SQL["scope_values"]}), tickers AS ({_TRUSTED_COUNT})
SELECT 'score_count' AS key, CAST(count(*) AS VARCHAR) AS value FROM scores
UNION ALL SELECT 'rankable_score_count', CAST(count(*) FILTER (rankable) AS VARCHAR) FROM scores
UNION ALL SELECT 'scope_value_count', CAST(count(*) AS VARCHAR) FROM scopes
UNION ALL SELECT 'scaled_scope_value_count', CAST(count(*) FILTER (scale_inferred) AS VARCHAR) FROM scopes
UNION ALL SELECT 'trusted_ticker_count', CAST(n AS VARCHAR) FROM tickers"""
SQL["ticker_map_document"] = """
SELECT 'X' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cusip, 'T' || c_custkey AS ticker FROM customer WHERE c_custkey % 4 <> 0"""
SQL["market_cap_document"] = """
SELECT 'P' || p_partkey AS ticker, CAST(floor(p_retailprice * 100) AS BIGINT) AS market_cap FROM part WHERE p_partkey % 5 <> 0 AND floor(p_retailprice * 100) > 0"""
SQL["sector_document"] = """
SELECT 'C' || c_custkey AS ticker, c_mktsegment AS sector, c_name || ' Co' AS name FROM customer"""
SQL["market_cap_object"] = """
SELECT 'O' || o_orderkey AS ticker, CAST(floor(o_totalprice) AS BIGINT) AS market_cap FROM orders WHERE o_orderkey % 5 <> 0 AND floor(o_totalprice) > 0"""
SQL["sector_object"] = """
SELECT 'O' || o_orderkey AS ticker, '{' || o_orderpriority || ', "x"]' AS sector, o_orderstatus || ' \\ Co,' AS name FROM orders"""
SQL["ticker_cache_object"] = """
SELECT 'X' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS cusip, 'T' || o_custkey AS ticker, '{,' || max(o_orderpriority) AS source FROM orders GROUP BY o_custkey"""
SQL["trusted_tickers"] = """
SELECT CASE WHEN c_custkey % 23 = 0 THEN 'BAD' || c_custkey ELSE 'X' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS cusip,
  CASE WHEN c_custkey % 50 = 7 THEN 'M' ELSE 'C' END || c_custkey AS ticker
FROM customer WHERE (c_custkey % 2 = 0 AND c_custkey % 5 = 1) OR (c_custkey % 50 = 7 AND c_custkey % 23 <> 0)"""

# ---- archives and the snapshot job ------------------------------------------------------------

SQL["archive_holdings"] = book_sql("""
SELECT archive, accession, cusip, position_type, shares_type, value, shares, issuer, class, '' AS figi FROM lines JOIN keyed USING (accession)""")
SQL["archive_inputs"] = book_sql(""", counted AS (
  SELECT archive, 'SUBMISSION' AS member, count(*) AS rows FROM keyed GROUP BY archive
  UNION ALL SELECT archive, 'SUMMARYPAGE', count(*) FROM keyed GROUP BY archive
  UNION ALL SELECT archive, 'COVERPAGE', CAST(sum(CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END) AS BIGINT) FROM keyed WHERE has_cover GROUP BY archive
  UNION ALL SELECT archive, 'INFOTABLE', count(*) FROM lines JOIN keyed USING (accession) GROUP BY archive)
SELECT archive, member, rows, true AS hashed, CAST(0 AS BIGINT) AS moved FROM counted""")
SQL["snapshot_weights"] = SQL["security_weights"]
SQL["snapshot_positions"] = SQL["positions_merged"]
SQL["snapshot_stock_changes"] = SQL["stock_changes"]
_TABLE_COUNTS = book_sql("""
SELECT 'period_count' AS key, CAST(count(*) AS VARCHAR) AS value FROM periods
UNION ALL SELECT 'latest_period', max_by(label, period) FROM periods
UNION ALL SELECT 'manager_count', CAST(count(DISTINCT cik) AS VARCHAR) FROM quarters
UNION ALL SELECT 'security_count', CAST(count(*) AS VARCHAR) FROM securities
UNION ALL SELECT 'position_count', CAST(count(*) AS VARCHAR) FROM positions""")
SQL["snapshot_metadata_counts"] = f"""
SELECT key, CAST(value AS VARCHAR) AS value FROM ({SQL["quality_kpis"]}) WHERE key <> 'data_quality_missing_ticker_security_count'
UNION ALL SELECT key, value FROM ({_TABLE_COUNTS})
UNION ALL SELECT 'market_cap_count', '0' UNION ALL SELECT 'sector_count', '0' UNION ALL SELECT 'schema_version', '9'"""
