"""DuckDB SQL for the catalogue: named common table expressions, and queries that pull in those they need."""

from __future__ import annotations

import re

from ledgerwind.functions.calendars import FIRST, LAST

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def sql(body: str) -> str:
    """body with all tables of CTES that it names, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed]
    if "WITH_PREFIX RECURSIVE" in body:
        return body.replace("WITH_PREFIX RECURSIVE", f"WITH RECURSIVE {', '.join(parts)},")
    if "WITH_PREFIX" in body:  # the body has tables of its own
        return body.replace("WITH_PREFIX", f"WITH {', '.join(parts)},")
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _fixed_day(day: str, friday: bool = True) -> str:
    """Whether a weekday is a fixed date, or the Monday after, or the Friday before one on a weekend."""
    on = lambda shift: f"strftime(d {shift}, '%m-%d') = '{day}'"
    return f"({on('')} OR isodow(d) = 1 AND {on('- 1')}" + (f" OR isodow(d) = 5 AND {on('+ 1')})" if friday else ")")


def _weekday(month: int, weekday: int, first: int, last: int) -> str:
    return f"(month(d) = {month} AND isodow(d) = {weekday} AND day(d) BETWEEN {first} AND {last})"


# The holidays once more, told by each date's own weekday and number; Easter by another computation than the calendars'.
cte("c_weekdays", f"SELECT * FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6")
cte("c_good_fridays", """
    SELECT make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) - 2 AS d FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
        SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT CAST(unnest(range(1990, 2031)) AS INT) AS y)))))""")
_BOTH = " OR ".join([_weekday(2, 1, 15, 21), _weekday(5, 1, 25, 31), _fixed_day("07-04"), _weekday(9, 1, 1, 7), _weekday(11, 4, 22, 28), _fixed_day("12-25")])
cte("c_sec_holidays", f"""
    SELECT d FROM c_weekdays WHERE {_BOTH} OR {_weekday(1, 1, 15, 21)} OR {_weekday(10, 1, 8, 14)} OR {_fixed_day("11-11")} OR {_fixed_day("01-01")} OR (year(d) >= 2021 AND {_fixed_day("06-19")})
        OR d IN (DATE '2018-12-05', DATE '2018-12-24', DATE '2019-12-24', DATE '2020-12-24', DATE '2024-12-24', DATE '2025-01-09', DATE '2025-12-24', DATE '2025-12-26')""")
cte("c_nyse_holidays", f"""
    SELECT d FROM c_weekdays WHERE {_BOTH} OR (year(d) >= 1998 AND {_weekday(1, 1, 15, 21)}) OR {_fixed_day("01-01", friday=False)} OR (year(d) >= 2022 AND {_fixed_day("06-19")}) OR d IN (SELECT d FROM c_good_fridays)
        OR d IN (DATE '1994-04-27', DATE '2001-09-11', DATE '2001-09-12', DATE '2001-09-13', DATE '2001-09-14', DATE '2004-06-11', DATE '2007-01-02', DATE '2012-10-29', DATE '2012-10-30', DATE '2018-12-05', DATE '2025-01-09')""")
cte("c_calendar", f"""
    SELECT d, is_sec, is_nyse, CAST(sum(CAST(is_sec AS INT)) OVER (ORDER BY d) AS INT) AS cum_sec, CAST(sum(CAST(is_nyse AS INT)) OVER (ORDER BY d) AS INT) AS cum_nyse
    FROM (SELECT d, isodow(d) < 6 AND d NOT IN (SELECT d FROM c_sec_holidays) AS is_sec, isodow(d) < 6 AND d NOT IN (SELECT d FROM c_nyse_holidays) AS is_nyse
          FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS d))""")
cte("c_sessions", "SELECT d, cum_nyse AS s FROM c_calendar WHERE is_nyse")
cte("c_base", """
    SELECT l_orderkey AS filing_id, o_custkey AS filer_id, l_suppkey AS issuer, CAST(o_orderdate AS DATE) AS filed_on,
        CASE WHEN l_partkey % 50 <> 0 THEN 'S' || l_suppkey END AS ticker, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
        CAST(o_orderdate AS DATE) - CAST(CAST(l_quantity AS INT) % 12 AS INT) + CASE WHEN l_partkey % 97 = 0 THEN 20 ELSE 0 END AS trade_date,
        CAST(l_quantity AS DECIMAL(12,2)) AS shares,
        CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CASE WHEN l_partkey % 23 = 0 THEN 3 ELSE 1 END AS DECIMAL(12,2)) AS price,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CEO' WHEN 'BUILDING' THEN 'CFO' WHEN 'FURNITURE' THEN 'officer' WHEN 'HOUSEHOLD' THEN 'director' WHEN 'MACHINERY' THEN '10% owner' END AS role,
        l_linestatus = 'O' AND l_tax > 0.06 AS is_10b5_1,
        CASE WHEN l_discount > 0 THEN CAST(CAST(l_quantity AS DECIMAL(12,2)) * (1 + l_linenumber) AS DECIMAL(14,2)) END AS owned_after,
        CASE l_linenumber % 3 WHEN 0 THEN 'self' WHEN 1 THEN 'spouse' END AS owner,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS line_no,
        l_linenumber AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""")
cte("c_trades", """
    SELECT *, filing_id * 1000 + line_no AS trade_id, 'edgar' AS source FROM (
        SELECT filing_id, filer_id, issuer, filed_on, ticker, side, trade_date, shares, price, role, is_10b5_1, owned_after, owner, line_no, '4' AS document_type, CAST(NULL AS BIGINT) AS amends_filing_id FROM c_base
        UNION ALL
        SELECT filing_id + 100000000, filer_id, issuer, filed_on + 10, ticker, CASE WHEN n % 4 = 3 THEN CASE side WHEN 'buy' THEN 'sell' ELSE 'buy' END ELSE side END,
            trade_date + CASE WHEN n % 4 = 2 THEN 1 ELSE 0 END, CAST(shares + CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END AS DECIMAL(12,2)), price, role, is_10b5_1, owned_after, owner, line_no, '4/A', filing_id
        FROM c_base WHERE filing_id % 7 = 0
        UNION ALL
        SELECT filing_id + 200000000, filer_id, issuer, filed_on + 3, ticker, side, trade_date, shares, price, role, is_10b5_1, owned_after, owner, line_no, '4', NULL FROM c_base WHERE filing_id % 11 = 0)""")
cte("c_bars", """
    SELECT ticker, date, open, close, open * (1.0 - 0.01 * a) AS adj_open, close * (1.0 - 0.01 * a) AS adj_close, quantity * pow(10.0, v) AS volume FROM (
        SELECT ticker, a, v, date, CAST(sum(retail) AS DOUBLE) / count(*) AS close, CAST(min(retail) AS DOUBLE) AS open, CAST(sum(quantity) AS DOUBLE) AS quantity FROM (
            SELECT unnest([{'ticker': 'S' || l_suppkey, 'a': CAST(l_suppkey % 3 AS DOUBLE), 'v': CAST(l_suppkey % 4 AS DOUBLE)}, {'ticker': 'SPY', 'a': 0.0, 'v': 3.0},
                {'ticker': CASE WHEN l_suppkey % 2 = 0 THEN 'IWM' END, 'a': 0.0, 'v': 3.0}, {'ticker': 'R' || n_regionkey, 'a': 0.0, 'v': 3.0}], recursive := true),
                CAST(l_shipdate AS DATE) AS date, CAST(p_retailprice AS DECIMAL(12,2)) AS retail, CAST(l_quantity AS DECIMAL(12,2)) AS quantity
            FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey)
        WHERE ticker IS NOT NULL AND date IN (SELECT d FROM c_sessions) GROUP BY ticker, a, v, date)""")
_PAIRS = "SELECT DISTINCT filing_id AS am, amends_filing_id AS og FROM c_trades WHERE amends_filing_id IS NOT NULL"
cte("c_m_lines", "SELECT trade_id, line_no, filing_id AS am, side, trade_date, shares, price FROM c_trades WHERE amends_filing_id IS NOT NULL")
cte("c_m_orig", f"SELECT t.trade_id, t.line_no, p.am, t.side, t.trade_date, t.shares, t.price FROM c_trades t JOIN ({_PAIRS}) p ON t.filing_id = p.og")
_RULES = [("amendment_duplicate", "side, trade_date, shares, price"), ("amendment_correction", "side, trade_date"), ("amendment_correction", "side, shares, price")]
for _i, (_kind, _keys) in enumerate(_RULES, 1):
    _done = " AND ".join(f"trade_id NOT IN (SELECT trade_id FROM c_m{j})" for j in range(1, _i)) or "true"
    _used = " AND ".join(f"(am, trade_id) NOT IN (SELECT (am, original_id) FROM c_m{j})" for j in range(1, _i)) or "true"
    _same = " AND ".join(f"m.{k} IS NOT DISTINCT FROM o.{k}" for k in _keys.split(", "))
    cte(f"c_m{_i}", f"""
        SELECT m.trade_id, m.am, o.trade_id AS original_id, '{_kind}' AS kind
        FROM (SELECT *, row_number() OVER (PARTITION BY am, {_keys} ORDER BY line_no, trade_id) AS k FROM c_m_lines WHERE {_done}) m
        JOIN (SELECT *, row_number() OVER (PARTITION BY am, {_keys} ORDER BY line_no, trade_id) AS k FROM c_m_orig WHERE {_used}) o
        ON m.am = o.am AND m.k = o.k AND {_same}""")
cte("c_amended", "SELECT trade_id, original_id, kind FROM c_m1 UNION ALL SELECT trade_id, original_id, kind FROM c_m2 UNION ALL SELECT trade_id, original_id, kind FROM c_m3")
_RK = "filer_id, ticker, side, trade_date, shares, price"
cte("c_r", f"SELECT *, dense_rank() OVER (PARTITION BY {_RK} ORDER BY filed_on, filing_id) AS f, row_number() OVER (PARTITION BY {_RK}, filing_id ORDER BY line_no, trade_id) AS k FROM c_trades WHERE document_type NOT LIKE '%/A' AND shares IS NOT NULL AND price IS NOT NULL")
cte("c_repeated", "SELECT b.trade_id, a.trade_id AS original_id, 'duplicate_filing' AS kind FROM c_r a JOIN c_r b ON a.filer_id = b.filer_id AND a.ticker IS NOT DISTINCT FROM b.ticker AND a.side = b.side AND a.trade_date = b.trade_date AND a.shares = b.shares AND a.price = b.price AND a.k = b.k WHERE a.f = 1 AND b.f > 1")
cte("c_dups", "SELECT * FROM c_repeated UNION ALL SELECT * FROM c_amended WHERE trade_id NOT IN (SELECT trade_id FROM c_repeated)")
cte("c_dated", "SELECT t.*, d.original_id, d.kind, coalesce(o.filed_on, t.filed_on) AS filing_date FROM c_trades t LEFT JOIN c_dups d USING (trade_id) LEFT JOIN c_trades o ON d.original_id = o.trade_id")
cte("c_lagged", """
    SELECT t.*, CAST(f.cum_sec - s.cum_sec AS INT) AS lag, CAST(CASE WHEN f.cum_sec >= s.cum_sec THEN f.cum_sec - s.cum_sec END AS INT) AS lag_days,
        CASE WHEN f.cum_sec >= s.cum_sec THEN (f.cum_sec - s.cum_sec) / 2.0 END AS lag_ratio,
        greatest((SELECT cum_nyse FROM c_calendar WHERE d = DATE '2001-10-01') - f.cum_nyse, 0) AS days_since_filing,
        CASE role WHEN 'CEO' THEN 1.0 WHEN 'CFO' THEN 1.0 WHEN 'officer' THEN 0.75 WHEN 'director' THEN 0.5 WHEN '10% owner' THEN 0.25 END AS role_weight,
        CASE WHEN shares > 0 AND price > 0 THEN CAST(shares * price AS DOUBLE) END AS trade_value
    FROM c_dated t JOIN c_calendar s ON t.trade_date = s.d JOIN c_calendar f ON t.filing_date = f.d""")
cte("c_filer_days", "SELECT filer_id, filing_date, count(*) AS n, sum(lag) AS s, sum(lag * lag) AS q FROM (SELECT filer_id, filing_date, filing_id, max(lag_days) AS lag FROM c_lagged WHERE kind IS NULL AND lag_days IS NOT NULL AND document_type NOT LIKE '%/A' GROUP BY ALL) GROUP BY ALL")
cte("c_zscore", """
    SELECT trade_id, (lag_days - hs / hn) / greatest(sqrt(greatest(hq * hn - hs * hs, 0)) / hn, 0.5) AS filer_lag_zscore FROM (
        SELECT t.trade_id, t.lag_days, CAST(sum(h.n) AS DOUBLE) AS hn, CAST(sum(h.s) AS DOUBLE) AS hs, CAST(sum(h.q) AS DOUBLE) AS hq
        FROM c_lagged t JOIN c_filer_days h ON t.filer_id = h.filer_id AND h.filing_date < t.filing_date WHERE t.lag_days IS NOT NULL GROUP BY ALL)
    WHERE hn >= 3""")
cte("c_own_size", """
    SELECT t.trade_id, count(*) AS n, sum(CASE WHEN h.trade_value < t.trade_value THEN 1 WHEN h.trade_value = t.trade_value THEN 0.5 ELSE 0 END) / count(*) AS score
    FROM c_lagged t JOIN c_lagged h ON t.filer_id = h.filer_id AND t.side = h.side AND h.filing_date < t.filing_date AND h.kind IS NULL
    WHERE t.trade_value IS NOT NULL AND h.trade_value IS NOT NULL GROUP BY t.trade_id HAVING count(*) >= 5""")
cte("c_market_days", "SELECT side, filing_date, trade_value, count(*) AS m FROM c_lagged WHERE kind IS NULL AND trade_value IS NOT NULL GROUP BY ALL")
cte("c_market_size", """
    SELECT t.trade_id, n, score FROM c_lagged t JOIN (
        SELECT a.side, a.filing_date, a.trade_value, sum(h.m) AS n, sum(CASE WHEN h.trade_value < a.trade_value THEN h.m WHEN h.trade_value = a.trade_value THEN 0.5 * h.m ELSE 0 END) / sum(h.m) AS score
        FROM (SELECT DISTINCT side, filing_date, trade_value FROM c_lagged WHERE trade_value IS NOT NULL) a
        JOIN c_market_days h ON a.side = h.side AND h.filing_date < a.filing_date AND h.filing_date >= a.filing_date - 365 GROUP BY ALL HAVING sum(h.m) >= 100) r
    ON t.side = r.side AND t.filing_date = r.filing_date AND t.trade_value = r.trade_value""")
cte("c_sizes", "SELECT trade_id, coalesce(o.score, m.score) AS size_score, CASE WHEN o.score IS NOT NULL THEN 'filer' ELSE 'market' END AS size_basis FROM c_own_size o FULL JOIN c_market_size m USING (trade_id)")
cte("c_direct_clusters", """
    SELECT t.trade_id, CAST(count(DISTINCT h.filer_id) AS INT) AS cluster_count FROM c_dated t JOIN c_dated h
        ON t.ticker = h.ticker AND t.side = h.side AND abs(t.trade_date - h.trade_date) <= 14 AND h.filing_date <= t.filing_date
    WHERE t.kind IS NULL AND h.kind IS NULL GROUP BY t.trade_id""")
cte("c_clusters", """
    SELECT * FROM c_direct_clusters UNION ALL
    SELECT d.trade_id, c.cluster_count FROM c_dups d LEFT JOIN c_dups e ON d.original_id = e.trade_id JOIN c_direct_clusters c ON c.trade_id = coalesce(e.original_id, d.original_id)""")
cte("c_closes", "SELECT ticker, date, adj_close FROM c_bars WHERE adj_close > 0")
cte("c_drift", """
    SELECT t.*, a.date AS d1, a.adj_close AS c1, b.date AS d2, b.adj_close AS c2,
        CASE WHEN lag >= 0 THEN CASE side WHEN 'sell' THEN -1 ELSE 1 END * (b.adj_close / a.adj_close - 1) * 100 END AS drift_pct
    FROM c_lagged t
    LEFT JOIN (SELECT l.trade_id, c.date, c.adj_close FROM c_lagged l ASOF JOIN c_closes c ON l.ticker = c.ticker AND l.trade_date >= c.date WHERE l.trade_date - c.date <= 5) a USING (trade_id)
    LEFT JOIN (SELECT l.trade_id, c.date, c.adj_close FROM c_lagged l ASOF JOIN c_closes c ON l.ticker = c.ticker AND l.filing_date >= c.date WHERE l.filing_date - c.date <= 5) b USING (trade_id)""")
cte("c_features", """
    SELECT t.*, z.filer_lag_zscore, s.size_score, s.size_basis, c.cluster_count, list_filter([
        coalesce(kind, CASE WHEN amends_filing_id IS NOT NULL OR document_type LIKE '%/A' THEN 'amendment' END),
        CASE WHEN is_10b5_1 THEN '10b5_1' END, CASE WHEN lag < 0 THEN 'trade_after_filing' END, CASE WHEN trade_value IS NULL THEN 'no_value' END, CASE WHEN t.ticker IS NULL THEN 'no_ticker' END,
        CASE WHEN lag >= 0 AND t.ticker IS NOT NULL AND p.ticker IS NULL THEN 'no_prices' END,
        CASE WHEN lag >= 0 AND p.ticker IS NOT NULL AND d1 IS NULL THEN 'no_trade_price' END, CASE WHEN lag >= 0 AND p.ticker IS NOT NULL AND d2 IS NULL THEN 'no_filing_price' END], lambda x: x IS NOT NULL) AS flags
    FROM c_drift t LEFT JOIN c_zscore z USING (trade_id) LEFT JOIN c_sizes s USING (trade_id) LEFT JOIN c_clusters c USING (trade_id)
    LEFT JOIN (SELECT DISTINCT ticker FROM c_closes) p ON t.ticker = p.ticker""")
cte("c_lines", "SELECT *, CASE WHEN filing_date IS NULL THEN 'no_features' WHEN original_id IS NOT NULL THEN 'duplicate' WHEN document_type LIKE '%/A' THEN 'amendment' WHEN lag_days IS NULL THEN 'trade_after_filing' WHEN coalesce(ticker, '') = '' THEN 'no_ticker' END AS reason FROM c_lagged LEFT JOIN c_clusters USING (trade_id)")
cte("c_kept", "SELECT * FROM c_lines WHERE reason IS NULL")
cte("c_held", """
    SELECT filer_id, ticker, side, filing_date, CASE WHEN NOT bool_or(missing) THEN CAST(sum(held) AS DOUBLE) END AS held_before FROM (
        SELECT filer_id, ticker, side, filing_date, coalesce(nullif(owner, ''), 'self') AS account, min(owned_after - shares) AS held, bool_or(owned_after IS NULL OR shares IS NULL) AS missing FROM c_kept GROUP BY ALL) GROUP BY ALL""")
cte("c_events", """
    SELECT *, CASE WHEN shares > 0 AND value > 0 THEN value / shares END AS avg_price FROM (
        SELECT filer_id, ticker, side, filing_date, arg_min(issuer, trade_id) AS issuer, min(trade_date) AS first_trade_date, max(trade_date) AS last_trade_date, max(lag_days) AS lag_days, max(lag_ratio) AS lag_ratio,
            CAST(coalesce(sum(CASE WHEN trade_value IS NOT NULL AND shares > 0 THEN shares * price END), 0) AS DOUBLE) AS value, CAST(coalesce(sum(CASE WHEN trade_value IS NOT NULL AND shares > 0 THEN shares END), 0) AS DOUBLE) AS shares,
            max(role_weight) AS role_weight, arg_max(role, {'w': role_weight, 't': -trade_id}) FILTER (role_weight IS NOT NULL) AS role, max(coalesce(cluster_count, 0)) AS cluster_count, bool_or(is_10b5_1) AS is_10b5_1, count(*) AS n_lines, count(DISTINCT filing_id) AS n_filings
        FROM c_kept GROUP BY ALL) LEFT JOIN c_held USING (filer_id, ticker, side, filing_date)""")
cte("c_usable", """
    SELECT *, row_number() OVER t AS bar_no, max(date) OVER (PARTITION BY ticker) AS last_date, lag(adj_close) OVER t AS previous_close, lag(date) OVER t AS previous_date,
        median(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS volume_before,
        median(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volume_upto,
        CASE WHEN row_number() OVER t >= 60 THEN adj_close / max(adj_close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) - 1 END AS drawdown
    FROM c_bars WHERE adj_close > 0 WINDOW t AS (PARTITION BY ticker ORDER BY date)""")
cte("c_last_day", "SELECT max(date) AS d FROM c_usable WHERE ticker = 'SPY'")
cte("c_sectors", "SELECT s_suppkey AS issuer, 'R' || n_regionkey AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey")
cte("c_planned", "SELECT e.*, p.d AS planned, l.d AS latest, row_number() OVER (ORDER BY filing_date, ticker, side, filer_id) AS id FROM c_events e JOIN c_calendar c ON c.d = filing_date JOIN c_sessions p ON p.s = c.cum_nyse + 1 JOIN c_sessions l ON l.s = c.cum_nyse + 6")
cte("c_entry", "SELECT e.id, b.date AS entry_date, b.open, b.adj_open, b.volume_before, b.previous_close, b.previous_date, b.bar_no FROM c_planned e ASOF JOIN c_usable b ON e.ticker = b.ticker AND e.planned <= b.date")
cte("c_t0", "SELECT e.id, b.date AS t0_date, b.adj_close AS t0_close FROM c_planned e ASOF JOIN c_usable b ON e.ticker = b.ticker AND e.first_trade_date >= b.date WHERE e.first_trade_date - b.date <= 5")
cte("c_t1", "SELECT e.id, b.close AS t1_close FROM c_planned e ASOF JOIN c_usable b ON e.ticker = b.ticker AND e.last_trade_date >= b.date WHERE e.last_trade_date - b.date <= 5")
cte("c_checked", """
    SELECT p.*, n.entry_date, n.open AS open_, n.adj_open, n.volume_before, n.previous_close, n.previous_date, n.bar_no, t0_date, t0_close, l.last_date, s.sector,
        CASE WHEN l.last_date IS NULL THEN 'no_prices' WHEN planned > (SELECT d FROM c_last_day) THEN 'not_matured' WHEN l.last_date < planned THEN 'ended_before_entry' WHEN NOT coalesce(n.entry_date <= latest AND n.open <> 0 AND n.adj_open <> 0, false) THEN 'no_entry_bar' END AS early,
        CASE WHEN avg_price > 0 AND t1_close <> 0 THEN avg_price / t1_close END AS ratio
    FROM c_planned p LEFT JOIN c_entry n USING (id) LEFT JOIN c_t0 USING (id) LEFT JOIN c_t1 USING (id) LEFT JOIN (SELECT ticker, max(date) AS last_date FROM c_usable GROUP BY ticker) l ON p.ticker = l.ticker LEFT JOIN c_sectors s ON p.issuer = s.issuer""")
cte("c_outcomes", """
    SELECT *, CASE WHEN early IS NULL THEN ratio END AS price_ratio, early IS NULL AND coalesce(ratio NOT BETWEEN 0.5 AND 2.0, false) AS mismatch,
        CASE WHEN early IS NULL THEN entry_date END AS entry, CASE WHEN early IS NULL THEN open_ END AS entry_open,
        CASE WHEN early IS NULL AND t0_date IS NOT NULL AND previous_date >= t0_date THEN 100 * CASE side WHEN 'sell' THEN 0 - (previous_close / t0_close - 1) ELSE previous_close / t0_close - 1 END END AS drift_pct,
        CASE WHEN early IS NULL AND NOT coalesce(ratio NOT BETWEEN 0.5 AND 2.0, false) THEN volume_before END AS dollar_volume,
        CASE WHEN early IS NULL AND NOT coalesce(ratio NOT BETWEEN 0.5 AND 2.0, false) THEN 2 * (10.0 + CASE WHEN volume_before >= 50e6 THEN 2 WHEN volume_before >= 5e6 THEN 10 WHEN volume_before >= 5e5 THEN 30 WHEN volume_before >= 5e4 THEN 75 ELSE 150 END) / 10000 END AS cost,
        CASE WHEN early IS NULL AND NOT coalesce(ratio NOT BETWEEN 0.5 AND 2.0, false) THEN CASE WHEN sector_bar IS NOT NULL THEN sector ELSE 'SPY' END END AS benchmark
    FROM c_checked LEFT JOIN (SELECT ticker AS st, date AS sd, 1 AS sector_bar FROM c_usable) x ON st = sector AND sd = entry_date""")
cte("c_targets", "SELECT o.id, o.ticker, o.entry, o.adj_open, o.benchmark, o.last_date, h, t.d AS target FROM (SELECT *, unnest([5, 20, 60]) AS h FROM c_outcomes) o JOIN c_calendar c ON c.d = o.entry JOIN c_sessions t ON t.s = c.cum_nyse + h - 1 WHERE early IS NULL AND NOT mismatch AND t.d <= (SELECT d FROM c_last_day)")
cte("c_exit_days", "SELECT t.id, t.h, b.date AS near FROM c_targets t ASOF JOIN c_closes b ON t.ticker = b.ticker AND t.target >= b.date WHERE t.target - b.date <= 10")
cte("c_exits", """
    SELECT t.id, t.h, t.entry, t.adj_open, t.benchmark, b.date AS exit, b.adj_close AS exit_close, n.near IS NULL AS ended_early FROM c_targets t LEFT JOIN c_exit_days n USING (id, h)
    JOIN c_usable b ON b.ticker = t.ticker AND b.date = coalesce(n.near, CASE WHEN t.last_date < t.target THEN t.last_date END)""")
for _name, _bench in (("spy", "'SPY'"), ("sec", "benchmark"), ("iwm", "'IWM'")):
    cte(f"c_leg_{_name}", f"""
        SELECT x.id, x.h, e.adj_close / x.start - 1 AS leg FROM (SELECT y.id, y.h, y.exit, y.bench, s.adj_open AS start FROM (SELECT *, {_bench} AS bench FROM c_exits) y JOIN c_usable s ON s.ticker = y.bench AND s.date = y.entry AND s.adj_open <> 0) x
        ASOF JOIN c_closes e ON e.ticker = x.bench AND x.exit >= e.date WHERE x.exit - e.date <= 10""")
cte("c_legs", "SELECT x.id, x.h, x.exit, x.ended_early, exit_close / adj_open - 1 AS stock, a.leg AS spy, b.leg AS sector_leg, c.leg AS iwm FROM c_exits x LEFT JOIN c_leg_spy a USING (id, h) LEFT JOIN c_leg_sec b USING (id, h) LEFT JOIN c_leg_iwm c USING (id, h)")
cte("c_results", """
    SELECT *, coalesce(early, CASE WHEN mismatch THEN 'ticker_mismatch' WHEN id IN (SELECT id FROM c_legs) THEN 'ok' ELSE 'not_matured' END) AS status, coalesce(entry_open >= 2 AND dollar_volume >= 100000, false) AS liquid FROM c_outcomes""")
cte("c_returns", """
    SELECT l.*, o.filer_id, o.ticker, o.side, o.filing_date, o.entry, o.lag_days, o.role, o.cluster_count, o.is_10b5_1, o.liquid, o.drift_pct, o.cost, o.value,
        CASE side WHEN 'sell' THEN -1 ELSE 1 END * (stock - spy) AS r, CASE side WHEN 'sell' THEN -1 ELSE 1 END * (stock - sector_leg) AS r_sector, CASE side WHEN 'sell' THEN -1 ELSE 1 END * (stock - iwm) AS r_iwm,
        CASE side WHEN 'sell' THEN -1 ELSE 1 END * (stock - spy) - coalesce(cost, 0) AS net, CASE WHEN h <= 20 THEN year(entry) * 100 + month(entry) ELSE year(entry) * 100 + quarter(entry) END AS cluster
    FROM c_legs l JOIN c_results o USING (id) WHERE status = 'ok'""")
cte("c_pool", "SELECT * FROM c_returns WHERE r IS NOT NULL")
cte("c_lag_pool", "SELECT *, CASE WHEN lag_days <= 1 THEN 0 WHEN lag_days = 2 THEN 1 WHEN lag_days <= 4 THEN 2 ELSE 3 END AS lag_bucket FROM c_pool")


def summary(groups: str, source: str, value: str = "r", cluster: str = "cluster") -> str:
    """summarize() in SQL: groups, n, mean, t, hit, clusters, t_cluster."""
    return f"""
        SELECT {groups}, CAST(n AS BIGINT) AS n, mean, CASE WHEN n > 1 AND sd > 0 THEN mean / (sd / sqrt(n)) END AS t, hit, clusters, CASE WHEN clusters > 1 AND x > 0 THEN mean / (sqrt(x * clusters / (clusters - 1)) / n) END AS t_cluster
        FROM (SELECT {groups}, any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, any_value(hit) AS hit, count(*) AS clusters, sum(dev * dev) AS x
            FROM (SELECT {groups}, {cluster}, any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, any_value(hit) AS hit, sum({value} - mean) AS dev
                FROM (SELECT *, count(*) OVER w AS n, avg({value}) OVER w AS mean, stddev_samp({value}) OVER w AS sd, avg(CASE WHEN {value} > 0 THEN 1.0 ELSE 0.0 END) OVER w AS hit FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {groups}))
                GROUP BY {groups}, {cluster}) GROUP BY {groups})"""


cte("c_cuts", "SELECT h, " + ", ".join(f"v[least(n - 1, CAST(floor(n * {k} / 5) AS BIGINT)) + 1] AS cut{k}" for k in range(1, 5)) + " FROM (SELECT h, list_sort(list(drift_pct)) AS v, count(*) AS n FROM c_pool WHERE drift_pct IS NOT NULL GROUP BY h)")
cte("c_quintiles", "SELECT p.*, CASE WHEN drift_pct IS NOT NULL THEN " + " + ".join(f"CASE WHEN drift_pct >= cut{k} THEN 1 ELSE 0 END" for k in range(1, 5)) + " END AS quintile FROM c_lag_pool p LEFT JOIN c_cuts c ON p.h = c.h")
cte("c_repeats", """
    SELECT e.filer_id, e.ticker, e.side, e.filing_date, CAST(CASE WHEN e.side = 'buy' THEN (SELECT count(*) FROM c_events b WHERE b.side = 'buy' AND b.filer_id = e.filer_id AND b.ticker = e.ticker AND b.filing_date < e.filing_date AND b.filing_date >= e.filing_date - 730) ELSE 0 END AS INT) AS repeat_buys FROM c_events e""")
cte("c_known", "SELECT filer_id, exit, r FROM c_returns WHERE h = 20 AND side = 'buy' AND NOT is_10b5_1 AND r IS NOT NULL")
cte("c_track", """
    SELECT o.filer_id, o.ticker, o.side, o.filing_date, CAST(count(k.r) AS INT) AS track_n, CASE WHEN count(k.r) >= 2 THEN avg(k.r) END AS track_record
    FROM c_results o LEFT JOIN c_known k ON k.filer_id = o.filer_id AND k.exit < coalesce(o.entry, o.planned) GROUP BY ALL""")
cte("c_signals", """
    SELECT o.*, repeat_buys, track_n, track_record, drift_pct / 100 AS drift, p.drawdown AS drawdown,
        CASE WHEN held_before IS NOT NULL AND shares > 0 THEN CASE WHEN held_before <= 0 THEN 10.0 ELSE least(shares / held_before, 10.0) END END AS stake_change
    FROM c_results o JOIN c_repeats USING (filer_id, ticker, side, filing_date) JOIN c_track USING (filer_id, ticker, side, filing_date)
    LEFT JOIN (SELECT ticker AS t, bar_no AS n, drawdown FROM c_usable) p ON p.t = o.ticker AND p.n = o.bar_no - 1 AND o.entry IS NOT NULL""")
cte("c_bucketed", """
    SELECT *, coalesce(role, 'none') AS b_role,
        CASE WHEN value < 10000 THEN '<$10k' WHEN value < 50000 THEN '$10k-50k' WHEN value < 250000 THEN '$50k-250k' WHEN value < 1000000 THEN '$250k-1M' ELSE '>=$1M' END AS b_value,
        CASE WHEN stake_change IS NULL THEN 'unknown' WHEN stake_change >= 10 THEN 'new stake' WHEN stake_change < 0.05 THEN '<5%' WHEN stake_change < 0.2 THEN '5-20%' WHEN stake_change < 1 THEN '20-100%' ELSE '>=100%' END AS b_stake,
        CASE WHEN cluster_count <= 1 THEN '1' WHEN cluster_count = 2 THEN '2' ELSE '3+' END AS b_cluster,
        CASE WHEN repeat_buys < 1 THEN '0' WHEN repeat_buys < 2 THEN '1' WHEN repeat_buys < 4 THEN '2-3' ELSE '4+' END AS b_repeat,
        CASE WHEN drawdown IS NULL THEN 'unknown' WHEN drawdown < -0.45 THEN '<=-45%' WHEN drawdown < -0.25 THEN '-45 to -25%' WHEN drawdown < -0.1 THEN '-25 to -10%' ELSE 'within 10%' END AS b_drawdown,
        CASE WHEN track_record IS NULL THEN 'none yet' WHEN track_record < -0.05 THEN '< -5%' WHEN track_record < 0 THEN '-5 to 0%' WHEN track_record < 0.05 THEN '0 to 5%' ELSE '>= 5%' END AS b_track,
        CASE WHEN dollar_volume IS NULL OR dollar_volume < 1000000 THEN '<$1M/day' WHEN dollar_volume < 5000000 THEN '$1-5M/day' WHEN dollar_volume < 50000000 THEN '$5-50M/day' ELSE '>=$50M/day' END AS b_liquidity
    FROM c_signals""")
cte("c_listed", """
    SELECT b.*, l.exit, l.net AS y, l.r AS gross FROM c_bucketed b LEFT JOIN (SELECT filer_id, ticker, side, filing_date, exit, net, r FROM c_returns WHERE h = 20) l USING (filer_id, ticker, side, filing_date)
    WHERE status = 'ok' AND side = 'buy' AND NOT is_10b5_1 AND liquid AND (drift IS NULL OR drift <= 0.2)""")
cte("c_training", """
    SELECT * EXCLUDE (y, lo, hi), least(greatest(y, lo), hi) AS y
    FROM c_listed, (SELECT v[CAST(floor(0.01 * (n - 1)) AS BIGINT) + 1] AS lo, v[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1] AS hi FROM (SELECT list_sort(list(y)) AS v, count(*) AS n FROM c_listed WHERE y IS NOT NULL)) WHERE y IS NOT NULL""")
_COMPONENTS = ("role", "value", "stake", "cluster", "repeat", "drawdown", "track", "liquidity")
cte("c_long_training", " UNION ALL ".join(f"SELECT '{c}' AS component, b_{c} AS bucket, y FROM c_training" for c in _COMPONENTS))
cte("c_tables", "SELECT component, bucket, count(*) AS n, count(*) / (count(*) + 500.0) * (avg(y) - (SELECT avg(y) FROM c_training)) AS value FROM c_long_training GROUP BY component, bucket")


#: Each row's bucket values, in the order of the components, by a fit's own tables.
_VALUES = "[" + ", ".join(f"coalesce(v.m['{c}' || b_{c}], 0)" for c in _COMPONENTS) + "]"
ALL_FOLDS = "SELECT 0 AS fold, DATE '9999-01-01' AS start"
YEAR_FOLDS = "SELECT CAST(fold AS INT) AS fold, make_date(fold, 1, 1) AS start FROM (SELECT DISTINCT year(entry) AS fold FROM c_listed) QUALIFY row_number() OVER (ORDER BY fold) > 2"
ONE_VARIANT = "('all components', [1, 2, 3, 4, 5, 6, 7, 8], [0.0, 1.0, 2.0, 3.0, 5.0, 8.0])"
VARIANTS = ", ".join(
    [ONE_VARIANT]
    + [f"('without {c}', {[j for j in range(1, 9) if j != i]}, [0.0, 1.0, 2.0, 3.0, 5.0, 8.0])" for i, c in enumerate(_COMPONENTS, 1)]
    + ["('no drift penalty', [1, 2, 3, 4, 5, 6, 7, 8], [0.0])"]
)


def score_models(folds: str, variants: str = ONE_VARIANT, least: int = 500, sweeps: int = 250) -> str:
    """Tables up to `chosen`: (fold, variant, w, low, high, beta, cut, n) of every fit.

    Each fold's training rows are copied, its returns cut, and the weights found by cyclic projected steps, one weight at a
    time in a recursion: another way to the minimum than the library's.
    """
    return f"""WITH_PREFIX RECURSIVE folds AS MATERIALIZED ({folds}),
variants AS MATERIALIZED (SELECT * FROM (VALUES {variants}) v(variant, used, betas)),
train AS MATERIALIZED (SELECT f.fold, l.* FROM c_listed l JOIN folds f ON l.y IS NOT NULL AND l.exit < f.start),
bounds AS MATERIALIZED (SELECT fold, n, v[CAST(floor(0.01 * (n - 1)) AS BIGINT) + 1] AS lo, v[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1] AS hi FROM (SELECT fold, count(*) AS n, list_sort(list(y)) AS v FROM train GROUP BY fold HAVING count(*) >= {least})),
cut_rows AS MATERIALIZED (SELECT t.* EXCLUDE (y), least(greatest(y, lo), hi) AS y, n FROM train t JOIN bounds b ON t.fold = b.fold),
means AS MATERIALIZED (SELECT fold, avg(y) AS overall FROM cut_rows GROUP BY fold),
parts AS MATERIALIZED (SELECT fold, component, bucket, count(*) AS n, count(*) / (count(*) + 500.0) * (avg(y) - any_value(overall)) AS value
    FROM ({" UNION ALL ".join(f"SELECT fold, '{c}' AS component, b_{c} AS bucket, y FROM cut_rows" for c in _COMPONENTS)}) JOIN means USING (fold) GROUP BY fold, component, bucket),
looked_up AS MATERIALIZED (SELECT fold, map_from_entries(list((component || bucket, value))) AS m FROM parts GROUP BY fold),
valued AS MATERIALIZED (SELECT t.fold, filing_date, ticker, side, filer_id, drift, t.n, y, y - overall AS over, {_VALUES} AS xs FROM cut_rows t JOIN looked_up v ON t.fold = v.fold JOIN means o ON t.fold = o.fold),
gram AS MATERIALIZED (SELECT fold, i, list(g ORDER BY j) AS g FROM (SELECT fold, i, j, sum(xs[i] * xs[j]) AS g FROM valued, range(1, 9) a(i), range(1, 9) b(j) GROUP BY fold, i, j) GROUP BY fold, i),
sides AS MATERIALIZED (SELECT fold, list(g ORDER BY i) AS g, list(r ORDER BY i) AS r FROM gram JOIN (SELECT fold, i, sum(xs[i] * over) AS r FROM valued, range(1, 9) a(i) GROUP BY fold, i) USING (fold, i) GROUP BY fold),
steps AS (
    SELECT fold, variant, 0 AS step, [CAST(0 AS DOUBLE) FOR x IN range(8)] AS w FROM sides, variants
    UNION ALL
    SELECT fold, variant, step + 1, CASE WHEN NOT list_contains(used, j) OR g[j][j] <= 0 THEN w
        ELSE list_concat(w[:j - 1], [least(greatest(w[j] + (r[j] - list_inner_product(g[j], w)) / g[j][j], 0), 1)], w[j + 1:]) END
    FROM (SELECT k.*, s.g, s.r, v.used, k.step % 8 + 1 AS j FROM steps k JOIN sides s USING (fold) JOIN variants v USING (variant) WHERE step < {8 * sweeps})
),
ends AS MATERIALIZED (SELECT fold, list(low ORDER BY i) AS lows, list(high ORDER BY i) AS highs FROM (SELECT fold, list_position({list(_COMPONENTS)}, component) AS i, min(value) AS low, max(value) AS high FROM parts GROUP BY fold, component) GROUP BY fold),
fitted AS MATERIALIZED (SELECT fold, variant, w, list_inner_product(w, lows) AS low, list_inner_product(w, highs) AS high FROM steps JOIN ends USING (fold) WHERE step = {8 * sweeps}),
tried AS (SELECT fold, variant, beta, n, y, filing_date, ticker, side, filer_id, q * CASE WHEN drift IS NULL THEN 1 ELSE greatest(0, 1 - beta * greatest(drift, -0.2)) END AS score
    FROM (SELECT t.*, variant, CASE WHEN high > low THEN (list_inner_product(w, xs) - low) / (high - low) ELSE 0.5 END AS q, unnest(betas) AS beta FROM valued t JOIN fitted USING (fold) JOIN variants USING (variant))),
tenths AS MATERIALIZED (SELECT fold, variant, beta, avg(y) AS mean, min(score) AS cut, any_value(n) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY fold, variant, beta ORDER BY score DESC, filing_date, ticker, side, filer_id) AS place FROM tried) WHERE place <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) GROUP BY fold, variant, beta),
chosen AS MATERIALIZED (SELECT f.*, beta, cut, n FROM fitted f JOIN (SELECT * FROM (SELECT *, max(mean) OVER (PARTITION BY fold, variant) AS top FROM tenths) WHERE mean > top - 1e-12 QUALIFY row_number() OVER (PARTITION BY fold, variant ORDER BY beta) = 1) USING (fold, variant))"""


#: Test years' events by the models of score_models(YEAR_FOLDS): the best one a ticker and day.
TESTED = f"""tested AS MATERIALIZED (SELECT *, score >= cut AS above FROM (
    SELECT *, quality * CASE WHEN drift IS NULL THEN 1 ELSE greatest(0, 1 - beta * greatest(drift, -0.2)) END AS score FROM (
        SELECT t.filer_id, t.ticker, t.side, t.filing_date, t.entry, t.exit, t.cost, t.y, t.gross, t.drift, c.fold AS year, c.variant, c.beta, c.cut, c.n AS n_train, year(t.entry) * 100 + month(t.entry) AS cluster,
            CASE WHEN high > low THEN (list_inner_product(w, {_VALUES}) - low) / (high - low) ELSE 0.5 END AS quality
        FROM c_listed t JOIN chosen c ON year(t.entry) = c.fold JOIN looked_up v ON v.fold = c.fold))
    QUALIFY row_number() OVER (PARTITION BY variant, ticker, entry ORDER BY score DESC, filing_date, side, filer_id) = 1)"""


def scored(tables: dict[str, dict[str, float]], weights: dict[str, float], beta: float, source: str, days: str = "0") -> str:
    """A fixed model's score and quality in SQL."""
    low, high = (sum(weights[c] * f(tables[c].values()) for c in sorted(weights)) for f in (min, max))
    value = lambda c: "CASE b_" + c + " " + " ".join(f"WHEN '{b}' THEN CAST({v!r} AS DOUBLE)" for b, v in tables[c].items()) + " ELSE CAST(0 AS DOUBLE) END"
    raw = " + ".join(f"CAST({weights[c]!r} AS DOUBLE) * {value(c)}" for c in sorted(weights))
    return f"""SELECT *, quality * CASE WHEN drift IS NULL THEN 1 ELSE greatest(0, 1 - {beta} * greatest(drift, -0.2)) END * exp(-ln(2) / 10 * ({days})) AS score
        FROM (SELECT *, (({raw}) - CAST({low!r} AS DOUBLE)) / (CAST({high!r} AS DOUBLE) - CAST({low!r} AS DOUBLE)) AS quality FROM ({source}))"""


#: Shared by several queries: net excess by delay, and new violations of the validation rules.
DELAYED = """SELECT o.filing_date, o.ticker, o.side, o.filer_id, delay, b.adj_close / a.adj_open - e.adj_close / s.adj_open - coalesce(cost, 0) AS excess
    FROM (SELECT *, unnest([0, 1, 2, 3, 5, 10]) AS delay FROM c_listed) o JOIN c_usable a ON a.ticker = o.ticker AND a.bar_no = o.bar_no + delay JOIN c_usable b ON b.ticker = o.ticker AND b.bar_no = o.bar_no + delay + 19
    JOIN c_usable s ON s.ticker = 'SPY' AND s.date = a.date JOIN c_usable e ON e.ticker = 'SPY' AND e.date = b.date WHERE a.adj_open <> 0"""
REJECTS = """SELECT trade_id, 'trade_after_filing' AS rule FROM c_trades WHERE trade_date > filed_on AND filed_on >= DATE '1997-01-01' UNION ALL SELECT trade_id, 'unknown_ticker' FROM c_trades WHERE ticker IS NULL
    UNION ALL SELECT trade_id, 'price_out_of_range' FROM c_trades t JOIN c_bars b ON t.ticker = b.ticker AND t.trade_date = b.date WHERE price > 0 AND (price < 0.8 * open OR price > 1.2 * close)"""


# Place, first code, last code and fund, written out once more so that the look-up is held against something.
SECTOR_ROWS = """
    (0, 1311, 1389, 'XLE'), (1, 2830, 2836, 'XLV'), (2, 2840, 2844, 'XLP'), (3, 2900, 2999, 'XLE'), (4, 3570, 3579, 'XLK'), (5, 3630, 3639, 'XLY'), (6, 3650, 3652, 'XLY'),
    (7, 3660, 3699, 'XLK'), (8, 3710, 3716, 'XLY'), (9, 3751, 3751, 'XLY'), (10, 3810, 3829, 'XLK'), (11, 3840, 3851, 'XLV'), (12, 3860, 3879, 'XLY'), (13, 4810, 4899, 'XLC'),
    (14, 4955, 4955, 'XLI'), (15, 5122, 5122, 'XLV'), (16, 5400, 5499, 'XLP'), (17, 5912, 5912, 'XLP'), (18, 6500, 6553, 'XLRE'), (19, 6770, 6770, 'SPY'), (20, 6798, 6798, 'XLRE'),
    (21, 7310, 7319, 'XLC'), (22, 7370, 7379, 'XLK'), (23, 7810, 7849, 'XLC'), (24, 100, 999, 'XLP'), (25, 1000, 1499, 'XLB'), (26, 1500, 1799, 'XLI'), (27, 2000, 2199, 'XLP'),
    (28, 2200, 2399, 'XLY'), (29, 2400, 2499, 'XLB'), (30, 2500, 2599, 'XLY'), (31, 2600, 2699, 'XLB'), (32, 2700, 2799, 'XLC'), (33, 2800, 2899, 'XLB'), (34, 3000, 3099, 'XLB'),
    (35, 3100, 3199, 'XLY'), (36, 3200, 3399, 'XLB'), (37, 3400, 3569, 'XLI'), (38, 3580, 3629, 'XLI'), (39, 3640, 3649, 'XLI'), (40, 3700, 3799, 'XLI'), (41, 3800, 3899, 'XLI'),
    (42, 3900, 3999, 'XLY'), (43, 4000, 4799, 'XLI'), (44, 4900, 4999, 'XLU'), (45, 5000, 5099, 'XLI'), (46, 5100, 5199, 'XLP'), (47, 5200, 5999, 'XLY'), (48, 6000, 6799, 'XLF'),
    (49, 7000, 7299, 'XLY'), (50, 7300, 7399, 'XLI'), (51, 7500, 7699, 'XLY'), (52, 7900, 7999, 'XLY'), (53, 8000, 8099, 'XLV'), (54, 8200, 8299, 'XLY'), (55, 8700, 8799, 'XLI')
"""
