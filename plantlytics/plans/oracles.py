"""The same queries as plain SQL on the same tables, for comparison in DuckDB."""

from __future__ import annotations

TELE = """tele AS (
  SELECT event_id AS row_id, ts AS datetime, user_id AS unit,
         CAST(CAST(json_extract_string(props, '$.k') AS INT) % 4 <> 0 AS INT) AS on_flag,
         CAST(event_type <> 'error' AS INT) AS ready, value AS kpi
  FROM events)"""

SHIPMENTS = """wide AS (
  SELECT l_shipdate AS datetime, CAST(l_linestatus = 'O' AS INT) AS "on", CAST(l_returnflag <> 'R' AS INT) AS ready,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem WHERE l_returnflag <> 'R'),
long AS (UNPIVOT wide ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME kpi VALUE value)"""

LONG = f"""{TELE},
long AS (SELECT 'kpi' AS kpi, on_flag AS "on", row_id, datetime, kpi AS value FROM tele WHERE ready = 1)"""

HOT = """tele AS (
  SELECT o_orderkey AS row_id,
         CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1998-01-01' ELSE o_orderdate END AS datetime,
         CAST(o_orderstatus = 'O' AS INT) AS on_flag, CAST(o_orderpriority <> '5-LOW' AS INT) AS ready,
         o_totalprice AS kpi
  FROM orders)"""

DIRTY = f"""{TELE},
dirty AS (
  SELECT row_id,
    CASE WHEN row_id % 97 = 0 THEN 'bad-date' WHEN row_id % 89 = 0 THEN ''
         ELSE strftime(datetime, '%Y-%m-%d %H:%M:%S.%f') END AS "Date",
    CASE WHEN row_id % 53 = 0 THEN '' ELSE CAST(on_flag AS VARCHAR) END AS "X_ON",
    CASE WHEN row_id % 59 = 0 THEN 'null' ELSE CAST(ready AS VARCHAR) END AS "X_READY",
    CASE WHEN row_id % 17 = 0 THEN 'NaN' WHEN row_id % 19 = 0 THEN '  '
         WHEN row_id % 23 = 0 THEN 'abc' WHEN row_id % 29 = 0 THEN '1d'
         ELSE CAST(kpi AS VARCHAR) END AS kpi_txt
  FROM tele)"""

START, END = "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-15'"


def _r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def _num(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({text}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
        f"THEN TRY_CAST({text} AS DOUBLE) END"
    )


def _time(text: str) -> str:
    return f"try_strptime({text}, '%Y-%m-%d %H:%M:%S.%f')"


def _time_text(time: str) -> str:
    return f"CASE WHEN date_trunc('second', {time}) = {time} THEN strftime({time}, '%Y-%m-%d %H:%M:%S') ELSE strftime({time}, '%Y-%m-%d %H:%M:%S.%f') END"


def _clean(text: str) -> str:
    return f"CASE WHEN NOT regexp_matches({text}, '(?i)^\\s*(nan|null|none|nat)?\\s*$') THEN {text} END"


def _flag(text: str) -> str:
    return f"coalesce(TRY_CAST({_num(text)} AS INT), 0)"


TYPED = f"""{DIRTY},
typed AS (
  SELECT row_id, {_time('"Date"')} AS "Date", {_flag('"X_ON"')} AS "X_ON", {_flag('"X_READY"')} AS "X_READY",
         {_num('kpi_txt')} AS kpi_txt, {_time('"Date"')} AS datetime
  FROM dirty)"""

TYPED_LOGS = f"""WITH {TYPED}
SELECT datetime, "X_ON", "X_READY", kpi_txt AS "Feed", row_id FROM typed WHERE datetime IS NOT NULL"""

STATUS = "CASE WHEN on_flag = 1 THEN 2 WHEN on_flag = 0 AND ready = 1 THEN 1 ELSE 0 END"


def _runs(source: str) -> str:
    return f"""WITH {source},
s AS (SELECT row_id, datetime, {STATUS} AS status FROM tele),
c AS (SELECT *, CASE WHEN lag(status) OVER w IS DISTINCT FROM status THEN 1 ELSE 0 END AS chg
      FROM s WINDOW w AS (ORDER BY datetime, row_id)),
b AS (SELECT *, sum(chg) OVER (ORDER BY datetime, row_id ROWS UNBOUNDED PRECEDING) AS block FROM c)
SELECT CAST(block AS BIGINT) AS block, CAST(max(status) AS INT) AS status, min(datetime) AS x0,
       CASE WHEN max(datetime) = min(datetime) THEN max(datetime) + INTERVAL 1 MINUTE ELSE max(datetime) END AS x1,
       count(*) AS n
FROM b GROUP BY block"""


BLOCKS = f"""{TELE},
r AS (SELECT datetime, row_id, on_flag AS state, kpi FROM tele WHERE ready = 1),
c AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS chg,
             lead(state) OVER w AS nxt
      FROM r WINDOW w AS (ORDER BY datetime, row_id)),
b AS (SELECT datetime, row_id, state, kpi, nxt,
             CAST(sum(chg) OVER (ORDER BY datetime, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM c)"""

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_Q = ", ".join(f"{_r(f'quantile_cont(value, {p})')} AS {n}" for n, p in _QUARTILES.items())


def _onoff_stats(source: str) -> str:
    return f"""WITH {source}
SELECT kpi, "on", count(*) AS n, count(value) AS valid_n, {_r('avg(value)')} AS mean,
       {_r('stddev_samp(value)')} AS std, {_r('min(value)')} AS min, {_Q}, {_r('max(value)')} AS max
FROM long GROUP BY kpi, "on\""""


def _fences(source: str) -> str:
    return f"""{source},
q AS (SELECT kpi, "on", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM long GROUP BY kpi, "on"),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


def _box(source: str) -> str:
    return f"""WITH {_fences(source)}
SELECT kpi, "on", count(*) AS n, {_r('min(q1)')} AS q1, {_r('min(median)')} AS median, {_r('min(q3)')} AS q3,
       {_r('avg(value)')} AS mean,
       {_r('min(value) FILTER (WHERE value BETWEEN lo AND hi)')} AS whisker_lo,
       {_r('max(value) FILTER (WHERE value BETWEEN lo AND hi)')} AS whisker_hi,
       count(*) FILTER (WHERE NOT value BETWEEN lo AND hi) AS outliers
FROM long JOIN f USING (kpi, "on") GROUP BY kpi, "on\""""


def _kde(source: str, where: str = "TRUE", scale: str = "1.0") -> str:
    return f"""WITH {source},
g AS (SELECT kpi, "on", count(*) AS n_rows, count(value) AS n,
             stddev_samp(value) * power(count(value), -0.2) AS h
      FROM long WHERE {where} GROUP BY kpi, "on"),
e AS (SELECT kpi, min(value) AS lo, max(value) AS hi FROM long WHERE {where} GROUP BY kpi),
v AS (SELECT kpi, "on", value, count(*) AS weight FROM long
      WHERE {where} AND value IS NOT NULL GROUP BY kpi, "on", value),
p AS (SELECT kpi, "on", CAST(i AS INT) AS i, n, n_rows, h, hi - lo AS span, lo + i * ((hi - lo) / 299) AS x
      FROM g JOIN e USING (kpi), range(300) AS grid(i) WHERE n > 1 AND h > 0)
SELECT kpi, "on", i, {_r('min(x)')} AS x,
       {_r(f"sum(weight * exp(-0.5 * ((x - value) / h) * ((x - value) / h))) / min(h) / sqrt(2 * pi()) * min(span) / 300 * {scale}")} AS y
FROM p JOIN v USING (kpi, "on") GROUP BY kpi, "on", i"""


def _bars(source: str, where: str = "TRUE") -> str:
    return f"""{source},
ends AS (SELECT kpi, min(value) AS lo, max(value) AS hi FROM long GROUP BY kpi),
binned AS (SELECT kpi, "on", lo, (hi - lo) / 40 AS width,
                  CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((value - lo) / ((hi - lo) / 40)) AS INT) + 1, 40) END AS bin
           FROM long JOIN ends USING (kpi) WHERE value IS NOT NULL AND {where})"""


def _deltas(source: str) -> str:
    label = """, CASE WHEN mean_off = 0 THEN 'N/A' ELSE
        format('{:+.2f} ({:+.2f}%)', mean_on - mean_off, 100.0 * (mean_on - mean_off) / mean_off) END AS delta_text"""
    return f"""WITH {source},
m AS (SELECT kpi, avg(value) FILTER (WHERE "on" = 1) AS mean_on, avg(value) FILTER (WHERE "on" = 0) AS mean_off
      FROM long GROUP BY kpi)
SELECT kpi, {_r('mean_on')} AS mean_on, {_r('mean_off')} AS mean_off, {_r('mean_on - mean_off')} AS delta,
       {_r('100.0 * (mean_on - mean_off) / mean_off')} AS delta_pct{label}
FROM m"""


def _describe(long: str, names: str = "kpi") -> str:
    return f"""WITH {long}
SELECT {names} AS kpi, count(value) AS count, count(*) - count(value) AS null_count, {_r('avg(value)')} AS mean,
       {_r('stddev_samp(value)')} AS std, {_r('min(value)')} AS min, {_Q}, {_r('max(value)')} AS max
FROM long GROUP BY kpi"""


def _ohlc(bucket: str) -> str:
    return f"""SELECT {bucket} AS datetime, {_r('arg_min(kpi, (tele.datetime, row_id))')} AS open,
       {_r('max(kpi)')} AS high, {_r('min(kpi)')} AS low, {_r('arg_max(kpi, (tele.datetime, row_id))')} AS close,
       max(on_flag) AS on_flag, max(ready) AS ready"""


WIDTH = """width AS (
  SELECT epoch_us(max(datetime)) - epoch_us(min(datetime)) AS us FROM tele),
chosen AS (
  SELECT us / 86400000000.0 AS span_days,
         CASE WHEN us / 86400000000.0 > 60 THEN 3600 WHEN us / 86400000000.0 > 10 THEN 900
              WHEN us / 86400000000.0 > 2 THEN 300 ELSE 60 END AS width_seconds FROM width)"""

LOG_LINE = """concat_ws(chr(9), "Date", "X_ON", "X_READY", kpi_txt, CAST(row_id AS VARCHAR))"""
FLAT = f"""{TELE},
long AS (SELECT 'kpi' AS kpi, on_flag AS "on", CASE WHEN on_flag = 0 THEN 7.5 ELSE kpi END AS value
         FROM tele WHERE ready = 1)"""

ORACLES: dict[str, str] = {
    "state_efficiency": f"""WITH {TELE}
SELECT count(*) AS total_records, min(datetime) AS date_min, max(datetime) AS date_max,
       count(*) FILTER (WHERE on_flag = 1 AND ready = 1) AS on_ready,
       count(*) FILTER (WHERE on_flag = 0 AND ready = 1) AS off_ready,
       count(*) FILTER (WHERE ready = 0) AS not_ready,
       {_r('100.0 * count(*) FILTER (WHERE on_flag = 1 AND ready = 1) / count(*)')} AS efficiency_pct
FROM tele""",
    "state_shares": f"""WITH {TELE},
s AS (SELECT CASE WHEN ready = 0 THEN 'OFF & No Ready' WHEN on_flag = 1 THEN 'ON & Ready'
                  ELSE 'OFF & Ready (Desperdiciado)' END AS state FROM tele)
SELECT state, count(*) AS records, {_r('100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share_pct
FROM s GROUP BY state""",
    "status_timeline": f"WITH {TELE} SELECT row_id, datetime, {STATUS} AS status FROM tele",
    "status_runs": _runs(TELE),
    "status_runs_no_row_id": _runs(TELE),
    "status_runs_hot_instant": _runs(HOT),
    "status_runs_by_unit": f"""WITH {TELE},
s AS (SELECT unit, row_id, datetime, {STATUS} AS status FROM tele),
c AS (SELECT *, CASE WHEN lag(status) OVER w IS DISTINCT FROM status THEN 1 ELSE 0 END AS chg
      FROM s WINDOW w AS (PARTITION BY unit ORDER BY datetime, row_id)),
b AS (SELECT *, sum(chg) OVER (PARTITION BY unit ORDER BY datetime, row_id ROWS UNBOUNDED PRECEDING) AS block FROM c)
SELECT unit, CAST(block AS BIGINT) AS block, CAST(max(status) AS INT) AS status, min(datetime) AS x0,
       CASE WHEN max(datetime) = min(datetime) THEN max(datetime) + INTERVAL 1 MINUTE ELSE max(datetime) END AS x1,
       count(*) AS n
FROM b GROUP BY unit, block""",
    "state_blocks": f"WITH {BLOCKS} SELECT datetime, row_id, state, kpi, block FROM b",
    "block_points": f"""WITH {BLOCKS}
SELECT datetime, row_id, state, kpi, block, state AS block_state FROM b
UNION ALL
SELECT datetime, row_id, state, kpi, block + 1, nxt FROM b WHERE nxt <> state""",
    "date_range_filter": f"WITH {TELE} SELECT * FROM tele WHERE datetime >= {START} AND datetime < {END}",
    "range_filter": """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
WHERE l_quantity BETWEEN 10 AND 24 AND l_discount BETWEEN 0.02 AND 0.08""",
    "range_bounds": """WITH long AS (UNPIVOT lineitem ON l_quantity, l_extendedprice, l_discount, l_tax
                     INTO NAME variable VALUE value)
SELECT variable, min(value) AS lo, max(value) AS hi FROM long GROUP BY variable HAVING min(value) < max(value)""",
    "clamped_range_filter": """WITH ends AS (
  SELECT min(l_quantity) AS q_lo, max(l_quantity) AS q_hi, min(l_tax) AS t_lo, max(l_tax) AS t_hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem, ends
WHERE l_quantity BETWEEN greatest(q_lo, -5.0) AND least(q_hi, 20.0)
  AND l_tax BETWEEN greatest(t_lo, 0.02) AND least(t_hi, 0.02)""",
    "text_search_literal": "SELECT doc_id, n_chars FROM documents WHERE contains(upper(text), 'LICENSE')",
    "text_search_regex": """SELECT doc_id, n_chars FROM documents
WHERE regexp_matches(text, 'licen[cs]e|copy(right|left)', 'i')""",
    "text_search_regex_case": "SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, 'The [a-z]+')",
    "text_search_columns": """SELECT c_custkey, c_mktsegment FROM customer WHERE contains(upper(c_name), '#00000001(')
UNION ALL
SELECT c_custkey, c_mktsegment FROM customer
WHERE contains(c_name, 'e7') OR contains(c_mktsegment, 'e7') OR contains(CAST(c_acctbal AS VARCHAR), 'e7')
UNION ALL
SELECT c_custkey, c_mktsegment FROM customer WHERE contains(upper(c_mktsegment), 'U')""",
    "text_search_numeric": f"""WITH {TELE}
SELECT row_id, kpi FROM tele
WHERE contains(CAST(kpi AS VARCHAR), '9.1') OR contains(CAST(on_flag AS VARCHAR), '9.1')""",
    "ready_filter": f"WITH {TELE} SELECT * FROM tele WHERE ready = 1",
    "filter_summary": f"""SELECT count(*) AS rows_before, count(*) FILTER (WHERE ok) AS rows_after,
       {_r('100.0 * (count(*) - count(*) FILTER (WHERE ok)) / count(*)')} AS reduction_pct
FROM (SELECT l_quantity BETWEEN 10 AND 24 AND l_discount BETWEEN 0.02 AND 0.08 AS ok FROM lineitem)""",
    "preview_topk": f"WITH {TELE} SELECT * FROM tele ORDER BY datetime, row_id LIMIT 1000",
    "dataset_registry": f"""WITH {TELE}
SELECT 'df_principal' AS name, 0 AS place, count(*) AS rows, {_r('sum(kpi)')} AS kpi_sum, min(datetime) AS first, max(datetime) AS last FROM tele
UNION ALL SELECT 'ready_rows', 1, count(*), {_r('sum(kpi)')}, min(datetime), max(datetime) FROM tele WHERE ready = 1""",
    "filter_pipeline": f"""WITH {TELE},
k AS (SELECT *, kpi BETWEEN 5 AND 60 AND on_flag = 1 AS ok FROM tele)
SELECT count(*) AS rows_before, count(*) FILTER (WHERE ok) AS rows_after,
       {_r('100.0 * (count(*) - count(*) FILTER (WHERE ok)) / count(*)')} AS reduction_pct,
       count(*) FILTER (WHERE ok) AS csv_rows, count(*) FILTER (WHERE ok) AS dataset_rows,
       {_r('sum(kpi) FILTER (WHERE ok)')} AS kpi_sum
FROM k""",
    "onoff_stats": _onoff_stats(LONG),
    "onoff_stats_by_kpi": _onoff_stats(SHIPMENTS),
    "onoff_delta": _deltas(LONG),
    "onoff_delta_by_kpi": _deltas(SHIPMENTS),
    "onoff_means": f"""WITH {LONG},
e AS (SELECT min(datetime) AS t_min, max(datetime) AS t_max FROM long)
SELECT kpi, "on", {_r('avg(value)')} AS mean, min(t_min) AS t_min, min(t_max) AS t_max
FROM long, e GROUP BY kpi, "on\"""",
    "onoff_stats_compact": f"""WITH {LONG}
SELECT kpi, "on", count(*) AS n, {_r('avg(value)', 4)} AS mean, {_r('stddev_samp(value)', 4)} AS std,
       {_r('min(value)', 4)} AS min, {_r('max(value)', 4)} AS max, {_r('median(value)', 4)} AS median
FROM long GROUP BY kpi, "on\"""",
    "describe_profile": _describe(
        "long AS (UNPIVOT lineitem ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME kpi VALUE value)"
    ),
    "describe_profile_dirty": _describe(
        f"""{DIRTY},
long AS (SELECT 'kpi_txt' AS kpi, {_num('kpi_txt')} AS value FROM dirty
         UNION ALL SELECT 'X_ON', {_num('"X_ON"')} FROM dirty
         UNION ALL SELECT 'X_READY', {_num('"X_READY"')} FROM dirty)"""
    ),
    "box_summary": _box(LONG),
    "box_summary_by_kpi": _box(SHIPMENTS),
    "box_outliers": f"""WITH {_fences(LONG)}
SELECT datetime, row_id, kpi, "on", value FROM long JOIN f USING (kpi, "on") WHERE NOT value BETWEEN lo AND hi""",
    "padded_range": f"""WITH e AS (
  SELECT least(min(l_quantity), min(l_extendedprice), min(l_discount), min(l_tax)) AS lo,
         greatest(max(l_quantity), max(l_extendedprice), max(l_discount), max(l_tax)) AS hi FROM lineitem)
SELECT {_r('lo - 0.1 * (hi - lo)')} AS y_min, {_r('hi + 0.1 * (hi - lo)')} AS y_max FROM e WHERE hi > lo""",
    "binary_signal_profile": f"""WITH {TELE},
wide AS (SELECT kpi AS a, CAST(on_flag AS DOUBLE) AS b, CAST(ready AS DOUBLE) AS c, on_flag + 0.25 AS d,
                CAST(CASE WHEN row_id < 0 THEN 1 END AS DOUBLE) AS e, row_id % 4 * 0.4 AS f FROM tele),
long AS (SELECT 'kpi' AS kpi, a AS v FROM wide UNION ALL SELECT 'on_flag', b FROM wide
         UNION ALL SELECT 'ready', c FROM wide UNION ALL SELECT 'opt_level', d FROM wide
         UNION ALL SELECT 'empty_sp', e FROM wide UNION ALL SELECT 'four_steps', f FROM wide)
SELECT kpi, coalesce(count(DISTINCT v) <= 3 AND bool_and(round_even(v, 0) IN (0, 1)), FALSE) AS is_binary,
       CASE WHEN regexp_matches(lower(kpi), 'sp|setpoint|target|opt_') THEN 'Control' ELSE 'Proceso' END AS category
FROM long GROUP BY kpi""",
    "period_summary": f"""WITH {TELE}
SELECT CAST(min(datetime) AS DATE) AS first_day, CAST(max(datetime) AS DATE) AS last_day, count(*) AS records,
       CAST(date_diff('day', CAST(min(datetime) AS DATE), CAST(max(datetime) AS DATE)) + 1 AS INT) AS days
FROM tele""",
    "kde_counts": _kde(LONG),
    "kde_counts_by_kpi": _kde(SHIPMENTS),
    "kde_counts_row_scale": _kde(
        f"""{DIRTY},
long AS (SELECT 'kpi_txt' AS kpi, CAST(coalesce({_num('"X_ON"')} >= 1, FALSE) AS INT) AS "on", {_num('kpi_txt')} AS value
         FROM dirty WHERE {_num('"X_READY"')} >= 1)""",
        scale="min(n_rows) / min(n)",
    ),
    "kde_counts_binned": f"""WITH {LONG},
g AS (SELECT kpi, "on", stddev_samp(value) * power(count(value), -0.2) AS h FROM long GROUP BY kpi, "on"),
e AS (SELECT kpi, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 16383 AS step FROM long GROUP BY kpi),
placed AS (SELECT kpi, "on", (value - lo) / step AS position, least(floor((value - lo) / step), 16382) AS cell
       FROM long JOIN e USING (kpi)),
w AS (SELECT kpi, "on", cell, sum(part) AS weight
      FROM (SELECT kpi, "on", cell, 1 - (position - cell) AS part FROM placed
            UNION ALL SELECT kpi, "on", cell + 1, position - cell FROM placed) GROUP BY kpi, "on", cell),
p AS (SELECT kpi, "on", CAST(i AS INT) AS i, h, lo, step, hi - lo AS span, lo + i * ((hi - lo) / 299) AS x
      FROM g JOIN e USING (kpi), range(300) AS grid(i))
SELECT kpi, "on", i, """ + _r("min(x)") + """ AS x,
       """ + _r("sum(weight * exp(-0.5 * ((x - lo - cell * step) / h) * ((x - lo - cell * step) / h))) / min(h) / sqrt(2 * pi()) * min(span) / 300") + """ AS y
FROM p JOIN w USING (kpi, "on") GROUP BY kpi, "on", i""",
    "histogram_counts": f"""WITH {_bars(LONG)}
SELECT kpi, "on", bin, {_r('min(lo + (bin - 1) * width)')} AS x, count(*) AS n FROM binned GROUP BY kpi, "on", bin""",
    "distribution_curves": f"""SELECT kpi, "on", 'curve' AS shape, i, x, y FROM ({_kde(FLAT)})
UNION ALL
SELECT * FROM (WITH {_bars(FLAT, '"on" = 0')}
  SELECT kpi, "on", 'bars' AS shape, bin AS i, {_r('min(lo + (bin - 1) * width)')} AS x, CAST(count(*) AS DOUBLE) AS y
  FROM binned GROUP BY kpi, "on", bin)""",
    "bucket_ohlc": f"""WITH {TELE}
{_ohlc("time_bucket(INTERVAL 1 HOUR, tele.datetime)")}, {_r('avg(unit)')} AS unit
FROM tele GROUP BY time_bucket(INTERVAL 1 HOUR, tele.datetime)""",
    "bucket_ohlc_adaptive": f"""WITH {TELE}, {WIDTH}
{_ohlc("time_bucket(to_seconds(width_seconds), tele.datetime)")}
FROM tele, chosen GROUP BY time_bucket(to_seconds(width_seconds), tele.datetime)""",
    "bucket_width": f"WITH {TELE}, {WIDTH} SELECT {_r('span_days')} AS span_days, width_seconds FROM chosen",
    "typed_projection": f"WITH {TYPED} SELECT * FROM typed",
    "drop_null_time": f"WITH {TYPED} SELECT row_id, datetime FROM typed WHERE datetime IS NOT NULL",
    "silver_date_range": f"""WITH {TYPED}
SELECT *, CAST(datetime AS DATE) AS day FROM typed WHERE datetime >= {START} AND datetime < {END}""",
    "to01": f"""WITH {DIRTY}
SELECT row_id, CAST(coalesce({_num('"X_ON"')} >= 1, FALSE) AS INT) AS "X_ON",
       CAST(coalesce({_num('"X_READY"')} >= 1, FALSE) AS INT) AS "X_READY",
       CAST(coalesce({_num('kpi_txt')} >= 1, FALSE) AS INT) AS kpi_txt FROM dirty""",
    "numeric_coerce": f"""WITH {DIRTY} SELECT row_id, {_num('kpi_txt')} AS kpi, {_num('"X_READY"')} AS ready FROM dirty""",
    "datetime_coerce": f"""WITH {DIRTY}
SELECT row_id, TRY_CAST("Date" AS TIMESTAMP) AS datetime,
       CASE WHEN row_id % 101 = 0 OR row_id % 103 = 0 THEN NULL WHEN row_id % 3 = 0 THEN date_trunc('second', datetime)
            WHEN row_id % 3 = 1 THEN date_trunc('minute', datetime) ELSE datetime END AS day_first
FROM dirty JOIN tele USING (row_id)""",
    "datetime_audit": f"""WITH {DIRTY}
SELECT 'Date' AS source, count(*) FILTER (WHERE row_id % 97 <> 0 AND row_id % 89 <> 0) AS readable,
       count(*) FILTER (WHERE row_id % 97 <> 0 AND row_id % 89 = 0) AS missing, count(*) FILTER (WHERE row_id % 97 = 0) AS unreadable FROM dirty
UNION ALL
SELECT 'when', count(*) FILTER (WHERE row_id % 101 <> 0 AND row_id % 103 <> 0),
       count(*) FILTER (WHERE row_id % 101 <> 0 AND row_id % 103 = 0), count(*) FILTER (WHERE row_id % 101 = 0) FROM tele""",
    "clean_null_tokens": f"""WITH {DIRTY}
SELECT row_id, {_clean('"Date"')} AS "Date", {_clean('"X_ON"')} AS "X_ON", {_clean('"X_READY"')} AS "X_READY",
       {_clean('kpi_txt')} AS kpi_txt FROM dirty""",
    "series_extract": f"""WITH {TELE}
SELECT datetime, row_id, 'kpi' AS kpi, kpi AS value FROM tele
UNION ALL
SELECT datetime, row_id, 'steps', CASE WHEN row_id % 7 = 0 THEN 0.0 ELSE least(row_id % 3 * 0.75, 1.0) END FROM tele""",
    "series_split": f"""WITH {TELE}
SELECT datetime, row_id, on_flag AS "on", 'kpi' AS kpi, kpi AS value FROM tele WHERE ready = 1""",
    "plant_log_scan": f"""WITH {DIRTY}
SELECT nullif("Date", '') AS "Date", nullif("X_ON", '') AS "X_ON", nullif("X_READY", 'null') AS "X_READY",
       nullif(kpi_txt, 'NaN') AS "Feed", CAST(row_id AS VARCHAR) AS "Id" FROM dirty""",
    "plant_log_split": f"""WITH {DIRTY}
SELECT nullif("Date", '') AS "Date", nullif("X_ON", '') AS "X_ON", nullif("X_READY", 'null') AS "X_READY",
       nullif(kpi_txt, 'NaN') AS "Feed", CAST(row_id AS VARCHAR) AS "Id", row_number() OVER (ORDER BY row_id) AS number FROM dirty""",
    "header_unique": f"""WITH {DIRTY}
SELECT nullif("Date", '') AS "Date", nullif("X_ON", '') AS "X_ON", nullif("X_READY", 'null') AS "X_ON_1",
       nullif(kpi_txt, 'NaN') AS "Feed", CAST(row_id AS VARCHAR) AS "Feed_1", CAST(row_id AS VARCHAR) AS "Feed_1_1" FROM dirty""",
    "discover_logs": TYPED_LOGS,
    "single_path_load": TYPED_LOGS,
    "accepted_extensions": TYPED_LOGS,
    "multi_file_union": f"""WITH {TYPED}
SELECT datetime, "X_ON", CASE WHEN row_id % 2 = 0 THEN "X_READY" ELSE 0 END AS "X_READY", kpi_txt AS "Feed", row_id
FROM typed WHERE datetime IS NOT NULL""",
    "load_summary": f"""WITH {TYPED},
f AS (SELECT greatest(8, CAST(ceil(count(*) / 2000000.0) AS BIGINT)) AS files,
             CAST(sum(strlen({LOG_LINE}) + 1) AS BIGINT) AS body, count(*) FILTER (WHERE row_id % 31 = 0) AS broken FROM dirty)
SELECT files AS file_count, {_r('(body + broken + files * 124) / 1048576.0')} AS total_mb,
       (SELECT count(*) FROM typed WHERE datetime IS NOT NULL) AS records, broken AS replaced FROM f""",
    "csv_roundtrip": f"""WITH {DIRTY}
SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce({_clean('"Date"')}, 'Null') AS "Date",
       coalesce({_clean('"X_ON"')}, 'Null') AS "X_ON", coalesce({_clean('"X_READY"')}, 'Null') AS "X_READY",
       coalesce({_clean('kpi_txt')}, 'Null') AS kpi_txt FROM dirty""",
    "tsv_roundtrip": f"""WITH {TYPED}
SELECT row_id, {_time_text('"Date"')} AS "Date", {_time_text('datetime')} AS datetime, CAST("X_ON" AS VARCHAR) AS "X_ON", CAST("X_READY" AS VARCHAR) AS "X_READY",
       CAST(kpi_txt AS VARCHAR) AS kpi_txt FROM typed WHERE datetime >= {START} AND datetime < {END}""",
    "report_header": f"""WITH {TELE}
SELECT 'Weekly report' AS title, 'events' AS dataset, 2 AS kpi_count, 'kpi, unit' AS kpis, count(*) AS records,
       count(*) FILTER (WHERE ready = 1) AS ready_records, DATE '2024-01-05' AS start_date, DATE '2024-01-14' AS end_date, 10 AS days
FROM tele WHERE datetime >= {START} AND datetime < {END}""",
}

ORACLES |= {
    "role_resolution": f"""WITH {TELE}, {HOT.replace("tele AS", "hot AS")}
SELECT 'events' AS name, 'datetime' AS time, 'X_ON' AS "on", 'X_READY' AS ready, max(datetime) AS last, CAST(sum(on_flag) AS BIGINT) AS on_rows,
       CAST(sum(ready) AS BIGINT) AS ready_rows FROM tele
UNION ALL SELECT 'orders', 'Order Date', 'Season', 'Flag_Ready', max(datetime), CAST(sum(on_flag) AS BIGINT), CAST(sum(ready) AS BIGINT) FROM hot
UNION ALL SELECT 'plain', 'Fecha', 'Running_ON', NULL, max(datetime), CAST(sum(on_flag) AS BIGINT), count(*) FROM tele""",
    "kpi_listing": """WITH wide AS (
  SELECT CAST(l_partkey AS DOUBLE) AS l_partkey, CAST(l_suppkey AS DOUBLE) AS l_suppkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax AS tax_setpoint FROM lineitem),
long AS (UNPIVOT wide ON l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, tax_setpoint INTO NAME kpi VALUE value)
SELECT kpi, count(value) AS n, min(value) AS lo, max(value) AS hi, CASE WHEN kpi = 'tax_setpoint' THEN 'Control' ELSE 'Proceso' END AS category
FROM long GROUP BY kpi""",
    "rename_date": "SELECT o_orderkey, o_orderdate AS datetime, o_totalprice FROM orders",
    "drop_duplicate_time": f"""WITH {TYPED} SELECT row_id, "Date", "X_ON", "X_READY", kpi_txt FROM typed WHERE datetime IS NOT NULL""",
    "search_scope": """SELECT '77' AS needle, c_custkey FROM customer
WHERE contains(CAST(c_custkey AS VARCHAR), '77') OR contains(CAST(c_nationkey AS VARCHAR), '77')
UNION ALL SELECT 'machinery', c_custkey FROM customer WHERE contains(upper(c_mktsegment), 'MACHINERY') OR contains(upper(c_name), 'MACHINERY')
UNION ALL SELECT '#0000000', c_custkey FROM customer WHERE contains(c_name, '#0000000')
UNION ALL SELECT 'BUILDING', c_custkey FROM customer WHERE contains(upper(c_mktsegment), 'BUILDING') OR contains(upper(c_name), 'BUILDING')""",
}

_DATED_TELE = TELE.replace("FROM events)", f"FROM events WHERE ts >= {START} AND ts < {END})")
_DATED_LONG = LONG.replace(TELE, _DATED_TELE)


def _numbers(section: str, item: str, source: str, **columns: str) -> str:
    """The columns of a query as rows ``section, item, name, value``."""
    parts = [
        f"SELECT '{section}' AS section, {item} AS item, '{name}' AS name, {_r(f'CAST({value} AS DOUBLE)')} AS value FROM ({source})"
        for name, value in columns.items()
    ]
    return " UNION ALL ".join(parts)


def _same(*names: str) -> dict[str, str]:
    return {n: f'"{n}"' for n in names}


_STATE_ITEM = """kpi || '|' || "on\""""
_STATISTICS = _numbers(
    "statistics", _STATE_ITEM, _onoff_stats(_DATED_LONG), **_same("n", "valid_n", "mean", "std", "min", "q1", "median", "q3", "max"))
_SECTIONS = {
    "header": _numbers(
        "header", "''", f"WITH {_DATED_TELE} SELECT count(*) AS records, count(*) FILTER (WHERE ready = 1) AS ready FROM tele",
        kpi_count="2", records="records", ready_records="ready", start_date="DATE '2024-01-05' - DATE '1970-01-01'",
        end_date="DATE '2024-01-14' - DATE '1970-01-01'", days="10"),
    "efficiency": _numbers(
        "efficiency", "''", ORACLES["state_efficiency"].replace(TELE, _DATED_TELE), date_min="epoch_us(date_min) / 1000000.0", date_max="epoch_us(date_max) / 1000000.0",
        **_same("total_records", "on_ready", "off_ready", "not_ready", "efficiency_pct")),
    "state_shares": _numbers("state_shares", "state", ORACLES["state_shares"].replace(TELE, _DATED_TELE), **_same("records", "share_pct")),
    "series": _numbers(
        "series", "state || '|' || row_id", f"WITH {BLOCKS.replace(TELE, _DATED_TELE)} SELECT * FROM b", datetime="epoch_us(datetime) / 1000000.0", **_same("kpi", "block")),
    "means": _numbers(
        "means", _STATE_ITEM, ORACLES["onoff_means"].replace(TELE, _DATED_TELE), mean="mean", t_min="epoch_us(t_min) / 1000000.0", t_max="epoch_us(t_max) / 1000000.0"),
    "box": _numbers("box", _STATE_ITEM, _box(_DATED_LONG), **_same("n", "q1", "median", "q3", "mean", "whisker_lo", "whisker_hi", "outliers")),
    "outliers": _numbers(
        "outliers", f"{_STATE_ITEM} || '|' || row_id", ORACLES["box_outliers"].replace(TELE, _DATED_TELE), datetime="epoch_us(datetime) / 1000000.0", value="value"),
    "distribution": _numbers("distribution", f"{_STATE_ITEM} || '|curve|' || i", _kde(_DATED_LONG), **_same("x", "y")),
    "statistics": _STATISTICS,
    "delta": _numbers("delta", "kpi", _deltas(_DATED_LONG), **_same("mean_on", "mean_off", "delta", "delta_pct")),
    "errors": "SELECT 'errors', 'lost', 'listed', 1.0::DOUBLE",
}
ORACLES["report_tables"] = " UNION ALL ".join(_SECTIONS.values())
ORACLES["report_isolation"] = " UNION ALL ".join([
    _STATISTICS, "SELECT 'errors', kpi, 'listed', 1.0::DOUBLE FROM (VALUES ('lost'), ('broken')) AS e(kpi)",
    f"SELECT 'outcomes', section, 'written', 1.0::DOUBLE FROM (VALUES {', '.join(f'({chr(39)}{s}{chr(39)})' for s in _SECTIONS)}) AS o(section)"])
