"""SQL twins of the registered queries, for a second engine on the same tables."""

from __future__ import annotations

READINGS = """readings AS (
  SELECT event_id AS id, 'SENSOR_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS sensor_id, ts AS "timestamp",
         CASE event_type WHEN 'click' THEN 'temperature' WHEN 'signup' THEN 'humidity' WHEN 'purchase' THEN 'soil_moisture'
              WHEN 'error' THEN 'light_intensity' WHEN 'view' THEN 'battery_level' END AS reading_type,
         value, 'field_' || CAST(user_id % 3 AS VARCHAR) AS field,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS battery_level
  FROM events)"""

DIRTY = (
    READINGS
    + """, doubled AS (
  SELECT * FROM readings
  UNION ALL
  SELECT id + 1000000000, sensor_id, "timestamp", reading_type, value, field, battery_level FROM readings WHERE id % 50 = 0
), dirty AS (
  SELECT id, CASE WHEN id % 211 = 0 THEN '' ELSE sensor_id END AS sensor_id, "timestamp", reading_type,
         CASE WHEN id % 97 = 0 THEN NULL WHEN reading_type = 'light_intensity' THEN value * 300 ELSE value END AS value,
         field, battery_level
  FROM doubled)"""
)

TEXT = (
    DIRTY
    + """, numbered AS (SELECT *, CAST(CAST(value AS DECIMAL(20, 4)) AS VARCHAR) AS number FROM dirty
), txt AS (
  SELECT id, sensor_id,
         CASE WHEN id % 19 = 0 THEN 'not a time' WHEN id % 23 = 0 THEN strftime("timestamp", '%Y-%m-%d')
              WHEN id % 29 = 0 THEN NULL
              ELSE strftime(date_trunc('milliseconds', "timestamp"), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS "timestamp",
         CASE WHEN id % 7 = 0 THEN upper(reading_type) ELSE reading_type END AS reading_type,
         CASE WHEN id % 13 = 0 THEN 'n/a' WHEN id % 17 = 0 THEN '  ' || number || ' ' ELSE number END AS value,
         field, battery_level,
         CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN date_trunc('day', "timestamp") WHEN id % 29 = 0 THEN NULL
              ELSE date_trunc('milliseconds', "timestamp") END AS ts
  FROM numbered)"""
)

RULES = """rules AS (
  SELECT * FROM (VALUES ('temperature', 1.0::DOUBLE, 0.0::DOUBLE, -10.0::DOUBLE, 50.0::DOUBLE),
    ('humidity', 1.0, 0.0, 0.0, 100.0), ('soil_moisture', 1.2, -5.0, 0.0, 100.0),
    ('light_intensity', 0.95, 10.0, 0.0, 100000.0), ('battery_level', 1.0, 0.0, 0.0, 100.0))
  AS t(reading_type, multiplier, "offset", min_value, max_value))"""

FLAGS = (
    DIRTY
    + ", "
    + RULES
    + """, flags AS (
  SELECT d.*, coalesce(d.value < r.min_value OR d.value > r.max_value, false) AS is_range
  FROM dirty d LEFT JOIN rules r USING (reading_type))"""
)

UNIQUE = (
    DIRTY
    + """, uniq AS (
  SELECT * FROM dirty
  QUALIFY row_number() OVER (PARTITION BY sensor_id, "timestamp", reading_type ORDER BY id) = 1)"""
)

CLASSES = (
    UNIQUE
    + ", "
    + RULES
    + """, clean AS (SELECT * FROM uniq WHERE value IS NOT NULL
), days AS (SELECT DISTINCT sensor_id, reading_type, CAST("timestamp" AS DATE) AS date FROM clean
), base AS (
  SELECT d.sensor_id, d.reading_type, d.date, avg(c.value) AS bavg, stddev_samp(c.value) AS bsd
  FROM days d JOIN clean c ON c.sensor_id = d.sensor_id AND c.reading_type = d.reading_type
    AND c."timestamp" >= d.date - INTERVAL 7 DAY AND c."timestamp" < d.date
  GROUP BY ALL
), stats AS (
  SELECT reading_type, avg(value) AS m, stddev_samp(value) AS sd FROM clean GROUP BY 1
), scored AS (
  SELECT c.*, r.min_value, r.max_value,
         CASE WHEN st.sd > 0 THEN (c.value - st.m) / st.sd END AS zscore,
         coalesce(c.value < r.min_value OR c.value > r.max_value, false) AS is_range,
         b.bsd, b.bavg
  FROM clean c LEFT JOIN stats st USING (reading_type) LEFT JOIN rules r USING (reading_type)
  LEFT JOIN base b ON b.sensor_id = c.sensor_id AND b.reading_type = c.reading_type AND b.date = CAST(c."timestamp" AS DATE)
), classed AS (
  SELECT *, CASE WHEN is_range THEN 'range_violation'
                 WHEN coalesce(abs(zscore) > 3.0, false) THEN 'statistical_outlier'
                 WHEN coalesce(abs(value - bavg) > 3.0 * bsd AND bsd > 0, false) THEN 'temporal_anomaly' END AS anomaly_class
  FROM scored
), classes AS (
  SELECT *, CASE WHEN anomaly_class IS NULL THEN NULL WHEN coalesce(abs(zscore), 0) >= 3.5 THEN 'high'
                 WHEN coalesce(abs(zscore), 0) >= 3.0 THEN 'medium' ELSE 'low' END AS severity FROM classed)"""
)

HOURS = (
    READINGS
    + """, hours AS (
  SELECT sensor_id, reading_type, date_trunc('hour', "timestamp") AS hour, count(*) AS readings FROM readings GROUP BY ALL
), span AS (SELECT min(hour) AS lo, max(hour) AS hi FROM hours)"""
)

STEPS = (
    READINGS
    + """, steps AS (
  SELECT sensor_id, reading_type, "timestamp" AS gap_end,
         lag("timestamp") OVER (PARTITION BY sensor_id, reading_type ORDER BY "timestamp", id) AS gap_start FROM readings
), gap AS (
  SELECT sensor_id, reading_type, gap_start, gap_end,
         CAST(floor(epoch_us(gap_end - gap_start) / 3600000000.0) AS BIGINT) AS gap_hours
  FROM steps WHERE gap_end > gap_start + INTERVAL 1 HOUR)"""
)

PERCENT = (
    FLAGS
    + """, pct AS (
  SELECT reading_type, sensor_id, count(*) AS n, count(*) FILTER (value IS NULL) AS missing,
         count(*) FILTER (is_range) AS anomalous, max("timestamp") AS "timestamp" FROM flags GROUP BY ALL
), qrows AS (
  SELECT 'missing_percentage' AS metric, reading_type, sensor_id, 100.0::DOUBLE * missing / n AS value, "timestamp" FROM pct
  UNION ALL
  SELECT 'anomaly_percentage', reading_type, sensor_id, 100.0::DOUBLE * anomalous / n, "timestamp" FROM pct
  UNION ALL
  SELECT 'quality_score', 'overall', 'ALL_SENSORS',
         100.0::DOUBLE * count(*) FILTER (sensor_id <> '' AND value IS NOT NULL) / count(*), max("timestamp") FROM flags
), breaches AS (
  SELECT *, CASE metric WHEN 'missing_percentage' THEN 20.0::DOUBLE WHEN 'anomaly_percentage' THEN 10.0::DOUBLE END AS "limit"
  FROM qrows WHERE value > CASE metric WHEN 'missing_percentage' THEN 20.0 WHEN 'anomaly_percentage' THEN 10.0 END)"""
)

BASE = 'id, sensor_id, "timestamp", reading_type, value, field, battery_level'
ALL = f"WITH {READINGS} SELECT {BASE} FROM readings"
ALL_DIRTY = f"WITH {DIRTY} SELECT {BASE} FROM dirty"
INGESTED = f"WITH {DIRTY} SELECT {BASE} FROM dirty WHERE sensor_id <> ''"
INGESTED_PLACED = f"WITH {DIRTY} SELECT {BASE}, 28.5::DOUBLE AS latitude, 77.25::DOUBLE AS longitude FROM dirty WHERE sensor_id <> ''"
HOUR_NUMBER = "epoch_us(\"timestamp\") / 3.6e9"
CODE = """CASE WHEN value IS NULL THEN NULL
  WHEN reading_type = 'temperature' THEN floor((value * 1.02 - 0.5) * 100 + 0.5) / 100
  WHEN reading_type = 'humidity' THEN greatest(0.0, least(100.0, floor((value * 0.98 + 1.5) * 100 + 0.5) / 100))
  ELSE value END"""
SCORE = """CAST(greatest(0, 100 - CASE WHEN "timestamp" IS NULL THEN 20 ELSE 0 END - CASE WHEN value IS NULL THEN 30 ELSE 0 END
  - CASE WHEN sensor_id IS NULL OR sensor_id = '' THEN 15 ELSE 0 END - CASE WHEN battery_level < 20 THEN 10 ELSE 0 END) AS DOUBLE)"""
NUMBER = "TRY_CAST(trim(value) AS DOUBLE)"
DAY_AGGS = """count(*) AS "count", min(value) AS "min", max(value) AS "max", round(avg(value), 6) AS "avg", round(sum(value), 6) AS "sum" """
ERRORS = f"""list_filter([
  CASE WHEN sensor_id IS NULL OR sensor_id = '' THEN 'Missing required field: sensor_id' END,
  CASE WHEN reading_type IS NULL OR reading_type = '' THEN 'Missing required field: reading_type' END,
  CASE WHEN value IS NULL OR value = '' THEN 'Missing required field: value' END,
  CASE WHEN "timestamp" IS NULL OR "timestamp" = '' THEN 'Missing required field: timestamp' END,
  CASE WHEN value <> '' AND {NUMBER} IS NULL THEN 'value must be numeric' END,
  CASE WHEN "timestamp" <> '' AND ts IS NULL THEN 'Invalid timestamp format' END], lambda x: x IS NOT NULL)"""
PROCESSED = f"""SELECT id, sensor_id, ts AS "timestamp", lower(reading_type) AS reading_type, {NUMBER} AS value,
  {SCORE} AS quality_score, coalesce({NUMBER} < -100 OR {NUMBER} > 1000, false) AS anomalous_reading"""
STATS = """count(value) AS "count", round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(stddev_samp(value), 6) AS std_dev, min(value) AS "min", max(value) AS "max" """


def _rolling(source: str) -> str:
    return f"""day AS (SELECT sensor_id, reading_type, CAST("timestamp" AS DATE) AS date, count(*) AS n_rows, avg(value) AS a
      FROM {source} GROUP BY ALL)
    SELECT sensor_id, reading_type, date, n_rows, round(a, 6) AS daily_avg,
      round(avg(a) OVER (PARTITION BY sensor_id, reading_type ORDER BY date
        RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 6) AS rolling_avg FROM day"""


FILLED = f"""WITH {UNIQUE} SELECT id, sensor_id, reading_type,
  last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id, reading_type ORDER BY "timestamp", id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM uniq"""

LOGS = """WITH log AS (SELECT event_type = 'view' AS is_text,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS lvl,
    CASE WHEN event_type = 'view' THEN 'Error seen by view ' ELSE 'event ' END || CAST(event_id AS VARCHAR) AS message,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS t FROM events)
  SELECT CASE WHEN is_text THEN NULL ELSE lvl END AS level, message, CASE WHEN is_text THEN NULL ELSE t END AS "timestamp" FROM log"""

ZED = """round(CASE WHEN sd > 0 THEN (value - m) / sd END, 6) AS zscore,
  coalesce(abs(CASE WHEN sd > 0 THEN (value - m) / sd END) > 3.0, false) AS is_statistical"""

VOLUME = """vol AS (SELECT 'SENSOR_' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS sensor_id, l_shipdate AS "timestamp",
  l_returnflag AS reading_type, l_quantity AS value FROM lineitem)"""

UPDATED = f"""WITH {READINGS} SELECT id, sensor_id, "timestamp", reading_type,
  CASE WHEN value > 100 THEN value / 2 ELSE value END AS value, field, battery_level,
  CASE WHEN value > 100 THEN 'checked' ELSE 'unknown' END AS data_quality FROM readings"""

def _batch(good: str) -> str:
    """Rows that a batch run stores, as ``out``, from the cleaned rows ``good``."""
    return f"""WITH {UNIQUE}, {RULES}, {good},
  stats AS (SELECT reading_type, avg(value) AS m, stddev_samp(value) AS sd FROM good GROUP BY 1),
  out AS (SELECT {BASE}, value * multiplier + "offset" AS calibrated_value, {SCORE} AS quality_score,
    coalesce(value < min_value OR value > max_value, false) OR coalesce(abs((value - m) / sd) > 3.0, false) AS anomalous_reading,
    CAST("timestamp" AS DATE) AS date
  FROM good LEFT JOIN rules USING (reading_type) LEFT JOIN stats USING (reading_type))"""


BATCH_CTE = _batch("good AS (SELECT * FROM uniq WHERE sensor_id <> '' AND value IS NOT NULL)")
BATCH = BATCH_CTE + " SELECT * FROM out"
ODD_BATCH = BATCH_CTE + ' SELECT sensor_id, "timestamp", reading_type, value, calibrated_value, anomalous_reading, date FROM out'
FILLED_BATCH = (
    _batch("""good AS (SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id, reading_type ORDER BY "timestamp", id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value) FROM uniq WHERE sensor_id <> '')""")
    + " SELECT * FROM out"
)

SUMMARY = f"""WITH {FLAGS}, sens AS (
    SELECT sensor_id, max("timestamp") AS latest, count(*) FILTER (is_range) AS flagged FROM flags GROUP BY 1),
  st AS (SELECT count(*) AS n,
    count(*) FILTER (latest >= (SELECT max("timestamp") FROM flags) - INTERVAL 24 HOUR) AS active,
    count(*) FILTER (flagged > 0) AS issues FROM sens),
  per_type AS (SELECT reading_type, count(DISTINCT sensor_id) AS s, count(*) AS n, avg(value) AS a FROM flags GROUP BY 1),
  per_field AS (SELECT field, count(DISTINCT sensor_id) AS s FROM flags GROUP BY 1),
  whole AS (SELECT count(*) AS n, count(value) AS p, count(*) FILTER (value > 100) AS o FROM flags),
  m AS (
    SELECT 'total_sensors' AS metric, 'all' AS "key", CAST(n AS DOUBLE) AS value FROM st
    UNION ALL SELECT 'active_sensors', 'all', CAST(active AS DOUBLE) FROM st
    UNION ALL SELECT 'inactive_sensors', 'all', CAST(n - active AS DOUBLE) FROM st
    UNION ALL SELECT 'sensors_with_issues', 'all', CAST(issues AS DOUBLE) FROM st
    UNION ALL SELECT 'timeliness', 'all', active / n FROM st
    UNION ALL SELECT 'sensors_by_type', reading_type, CAST(s AS DOUBLE) FROM per_type
    UNION ALL SELECT 'readings_by_type', reading_type, CAST(n AS DOUBLE) FROM per_type
    UNION ALL SELECT 'avg_by_type', reading_type, a FROM per_type
    UNION ALL SELECT 'sensors_by_field', field, CAST(s AS DOUBLE) FROM per_field
    UNION ALL SELECT 'data_points', 'all', CAST(n AS DOUBLE) FROM whole
    UNION ALL SELECT 'completeness', 'all', p / n FROM whole
    UNION ALL SELECT 'accuracy', 'all', 1.0::DOUBLE - o / p FROM whole)
  SELECT metric, "key", round(value, 6) AS value FROM m"""

INSIGHTS = f"""WITH {CLASSES}, tr AS (
    SELECT reading_type, regr_slope(value, {HOUR_NUMBER}) AS slope, abs(corr(value, {HOUR_NUMBER})) AS c FROM classes GROUP BY 1),
  sh AS (SELECT reading_type, count(*) FILTER (NOT is_range) / count(*) AS in_range,
    count(*) FILTER (anomaly_class IS NOT NULL) / count(*) AS bad FROM classes GROUP BY 1),
  f AS (
    SELECT reading_type, 'trend' AS type, c AS confidence,
      reading_type || ' is ' || CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END || ', '
        || CASE WHEN c < 0.3 THEN 'weak' WHEN c < 0.7 THEN 'moderate' ELSE 'strong' END AS description,
      CASE WHEN slope = 0 THEN 'neutral' ELSE 'positive' END AS impact FROM tr
    UNION ALL SELECT reading_type, 'pattern', in_range, reading_type || ' readings within range', 'neutral' FROM sh
    UNION ALL SELECT reading_type, 'anomaly', 1.0::DOUBLE - bad,
      reading_type || CASE WHEN bad > 0 THEN ' has anomalies' ELSE ' has no anomalies' END,
      CASE WHEN bad > 0 THEN 'negative' ELSE 'positive' END FROM sh)
  SELECT reading_type, type, round(confidence, 6) AS confidence, description, impact FROM f"""


def _advice(dirty: str, hit: str, source: str = "dirty") -> str:
    """Recommendations by the kind of anomaly that prevails in a series, as ``advice``."""
    rules = f"{dirty}, {RULES}, " if dirty else ""
    return f"""{rules}zs AS (SELECT reading_type, avg(value) AS m, stddev_samp(value) AS sd FROM {source} GROUP BY 1),
        marked AS (SELECT d.*, coalesce(d.value < r.min_value OR d.value > r.max_value, false) AS outside, {hit} AS hit
          FROM {source} d LEFT JOIN rules r USING (reading_type) LEFT JOIN zs USING (reading_type)),
        series AS (SELECT sensor_id, reading_type, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (hit) AS hits,
          count(*) FILTER (hit AND outside) AS ranged FROM marked GROUP BY 1, 2),
        advice AS (
          SELECT sensor_id, reading_type, 'connectivity' AS category, 'high' AS priority, 'Check the connection of sensor ' || sensor_id AS description,
            'Inspect power, wiring and network' AS action FROM series WHERE 100.0 * missing / n > 20.0
          UNION ALL SELECT sensor_id, reading_type, 'calibration', 'medium', 'Calibrate the ' || reading_type || ' sensor ' || sensor_id,
            'Run the calibration procedure' FROM series WHERE 100.0 * hits / n > 10.0 AND 2 * ranged >= hits
          UNION ALL SELECT sensor_id, reading_type, 'validation', 'low', 'Review the value rules of sensor ' || sensor_id,
            'Update the validation limits' FROM series WHERE 100.0 * hits / n > 10.0 AND 2 * ranged < hits)"""


def _temporal(value: str) -> str:
    """Readings against the mean and deviation of the raw values of the seven days before."""
    return f"""WITH {READINGS}, r AS (SELECT * REPLACE ({value} AS value) FROM readings),
        days AS (SELECT DISTINCT sensor_id, reading_type, CAST("timestamp" AS DATE) AS date FROM r),
        b AS (SELECT d.sensor_id, d.reading_type, d.date, avg(c.value) AS a, stddev_samp(c.value) AS sd
          FROM days d JOIN r c ON c.sensor_id = d.sensor_id AND c.reading_type = d.reading_type
            AND c."timestamp" >= d.date - INTERVAL 7 DAY AND c."timestamp" < d.date GROUP BY ALL)
        SELECT r.id, coalesce(abs(r.value - b.a) > 3.0 * b.sd AND b.sd > 0, false) AS is_temporal
        FROM r LEFT JOIN b ON b.sensor_id = r.sensor_id AND b.reading_type = r.reading_type AND b.date = CAST(r."timestamp" AS DATE)"""


def _profile() -> str:
    parts = []
    kinds = (
        ("id", "bigint"), ("sensor_id", "string"), ("timestamp", "string"), ("reading_type", "string"), ("value", "decimal(20,6)"), ("field", "string"), ("battery_level", "int")
    )
    for name, kind in kinds:
        parts.append(
            f"""SELECT '{name}' AS column_name, '{kind}' AS column_type, count(*) AS "rows", count(*) - count({name}) AS nulls,
            count(DISTINCT {name}) AS distinct_values, CAST(min({name}) AS VARCHAR) AS min_value,
            CAST(max({name}) AS VARCHAR) AS max_value FROM dirty"""
        )
    shown = """strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", CAST(value AS DECIMAL(20, 6)) AS value"""
    return f"WITH {DIRTY.replace('dirty AS (', 'plain AS (')}, dirty AS (SELECT * REPLACE ({shown}) FROM plain) " + " UNION ALL ".join(parts)


ORACLE = {
    # sources
    "table_scan": ALL,
    "parquet_scan": "SELECT * FROM events WHERE value > 50 AND event_type = 'click' ORDER BY value DESC, event_id LIMIT 500",
    "parquet_ingest": INGESTED_PLACED,
    "parquet_ingest_counts": f"""WITH {DIRTY} SELECT count(*) FILTER (sensor_id <> '') AS processed,
        count(*) FILTER (sensor_id = '') AS skipped, CAST(0 AS BIGINT) AS errors FROM dirty""",
    "json_ingest": INGESTED_PLACED,
    "mixed_folder_ingest": INGESTED,
    "files_by_time": f"""WITH {READINGS} SELECT id, sensor_id, "timestamp", value, field FROM readings
        WHERE "timestamp" >= TIMESTAMP '2024-01-16 00:00:00'""",
    "odd_json_ingest": f"""WITH {DIRTY} SELECT CASE WHEN id % 10 = 3 THEN NULL ELSE id END AS id, sensor_id, "timestamp", reading_type, value,
        CASE WHEN id % 10 = 5 THEN NULL ELSE field END AS field, battery_level,
        CASE WHEN id % 10 = 5 THEN NULL ELSE 28.5::DOUBLE END AS latitude, CASE WHEN id % 10 = 5 THEN NULL ELSE 77.25::DOUBLE END AS longitude
        FROM dirty WHERE sensor_id <> ''""",
    "odd_parquet_ingest": INGESTED_PLACED,
    "odd_landing_counts": f"""WITH {DIRTY} SELECT count(*) FILTER (sensor_id <> '') AS processed,
        count(*) FILTER (sensor_id = '') AS skipped, CAST(1 AS BIGINT) AS errors FROM dirty""",
    "required_columns": f"""WITH {DIRTY} SELECT count(sensor_id) AS sensor_id_present, count("timestamp") AS timestamp_present,
        count(reading_type) AS reading_type_present, count(value) AS value_present FROM dirty""",
    "log_query": LOGS + " WHERE NOT is_text AND lvl = 'warn' ORDER BY t DESC LIMIT 200",
    "log_query_all_errors": LOGS + " WHERE CASE WHEN is_text THEN contains(lower(message), 'error') ELSE lvl = 'error' END",
    "report_catalog": f"""WITH {PERCENT}, hours AS (SELECT DISTINCT sensor_id, reading_type FROM flags)
        SELECT 'quality_1704067200000' AS report_id, 'Quality Report' AS type, count(*) AS "rows", 'metrics' AS section FROM qrows
        UNION ALL SELECT 'coverage_1704067200001', 'Coverage Report', count(*), 'coverage' FROM hours""",
    "stored_files": f'WITH {TEXT} SELECT id, sensor_id, "timestamp", reading_type, value FROM txt',
    # sinks and table changes
    "append_defaults": f"""WITH {DIRTY} SELECT {BASE}, 'unknown' AS data_quality, 100.0::DOUBLE AS quality_score,
        28.5::DOUBLE AS latitude, 77.25::DOUBLE AS longitude, CAST("timestamp" AS DATE) AS date FROM dirty""",
    "keyed_update": UPDATED,
    "keyed_delete": f"""WITH {READINGS} SELECT {BASE} FROM readings
        WHERE NOT (value > 100 OR CAST("timestamp" AS DATE) = DATE '2024-01-10')""",
    "transformed_backup": f"""WITH {DIRTY} SELECT id, sensor_id, value, {CODE} AS calibrated_value, {SCORE} AS quality_score
        FROM dirty""",
    "daily_lines": f'WITH {READINGS} SELECT id, sensor_id, value, field, CAST("timestamp" AS DATE) AS date FROM readings',
    "partitioned_table": f"""WITH {READINGS} SELECT CAST("timestamp" AS DATE) AS date, count(*) AS "rows",
        min("timestamp") AS "first", max("timestamp") AS "last" FROM readings GROUP BY 1""",
    "master_index": f"""WITH {READINGS}, d AS (SELECT strftime("timestamp", '%Y-%m-%d') AS day FROM readings)
        SELECT day, count(*) AS record_count FROM d GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM d""",
    "export_csv": ALL_DIRTY,
    "export_json": ALL_DIRTY,
    "export_parquet": ALL_DIRTY,
    "report_export": f"""WITH {PERCENT}, st AS (
          SELECT sensor_id, reading_type, "timestamp" AS gap_end,
                 lag("timestamp") OVER (PARTITION BY sensor_id, reading_type ORDER BY "timestamp", id) AS gap_start FROM flags),
        g AS (SELECT 'gap_hours' AS metric, reading_type, sensor_id,
              CAST(max(floor(epoch_us(gap_end - gap_start) / 3600000000.0)) AS DOUBLE) AS value, max(gap_end) AS "timestamp"
              FROM st WHERE gap_end > gap_start + INTERVAL 1 HOUR GROUP BY ALL)
        SELECT metric, reading_type, sensor_id, round(value, 6) AS value, "timestamp" FROM qrows
        UNION ALL SELECT metric, reading_type, sensor_id, value, "timestamp" FROM g""",
    "validation_saved": f"""WITH {DIRTY} SELECT count(*) AS total_records,
        count(*) FILTER (sensor_id <> '' AND value IS NOT NULL) AS valid_records,
        count(*) FILTER (NOT (sensor_id <> '' AND value IS NOT NULL)) AS invalid_records,
        round(100.0::DOUBLE * count(*) FILTER (sensor_id <> '' AND value IS NOT NULL) / count(*), 6) AS quality_score FROM dirty""",
    # filters, order, paging
    "filter_equality": ALL + " WHERE sensor_id = 'SENSOR_000008' AND reading_type = 'temperature'",
    "filter_time": ALL
    + """ WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' AND field = 'field_1'""",
    "filter_value": ALL_DIRTY + " WHERE value BETWEEN 20 AND 30",
    "filter_anomalous": f"WITH {FLAGS} SELECT {BASE} FROM flags WHERE is_range",
    "filter_not_anomalous": f"WITH {FLAGS} SELECT {BASE} FROM flags WHERE NOT is_range",
    "filter_stored_files": f"""WITH {TEXT} SELECT id, sensor_id, "timestamp", reading_type, value FROM txt
        WHERE reading_type = 'temperature'
          AND (ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00')""",
    "filter_transformed": f"""WITH {DIRTY} SELECT id, value, {CODE} AS calibrated_value FROM dirty
        WHERE sensor_id = 'SENSOR_000008' AND reading_type = 'temperature'""",
    "table_columns_only": f"WITH {READINGS} SELECT {BASE}, 'unknown' AS data_quality FROM readings",
    "checked_request": ALL
    + """ WHERE reading_type = 'humidity' AND "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
        ORDER BY value, id LIMIT 1000""",
    "newest_readings": ALL + ' ORDER BY "timestamp" DESC, id LIMIT 25',
    "sorted_by_value": ALL_DIRTY + " ORDER BY value ASC NULLS LAST, id LIMIT 500",
    "sorted_by_sensor": ALL + " ORDER BY sensor_id DESC, id LIMIT 500 OFFSET 500",
    "page_three": ALL + ' ORDER BY "timestamp" DESC, id LIMIT 100 OFFSET 200',
    "page_totals": f"""WITH {READINGS} SELECT CAST(3 AS BIGINT) AS page, CAST(128 AS BIGINT) AS "limit", count(*) AS total,
        CAST(ceil(count(*) / 128.0) AS BIGINT) AS pages FROM readings""",
    "deep_page": ALL + ' ORDER BY "timestamp" DESC, id LIMIT 1000 OFFSET 8000',
    "deep_page_stored": ALL + ' ORDER BY "timestamp", id LIMIT 1000 OFFSET 8000',
    "deep_page_by_rank": ALL + " ORDER BY value ASC NULLS LAST, id LIMIT 1000 OFFSET 8000",
    "page_after_key": f"""WITH {READINGS}, k AS (SELECT "timestamp" AS t, id AS i FROM readings WHERE id = 500)
        SELECT {BASE} FROM readings, k WHERE "timestamp" < t OR ("timestamp" = t AND id > i) ORDER BY "timestamp" DESC, id LIMIT 1000""",
    "offset_page": ALL + ' ORDER BY "timestamp" DESC, id LIMIT 700 OFFSET 150',
    "offset_totals": f"""WITH {READINGS} SELECT count(*) AS total, CAST(1000 AS BIGINT) AS "limit", CAST(500 AS BIGINT) AS "offset",
        1500 < count(*) AS has_more FROM readings""",
    # aggregations
    "table_stats": f"""WITH {READINGS} SELECT coalesce(reading_type, 'TOTAL') AS reading_type, reading_type IS NULL AS is_total,
        count(*) AS readings, max("timestamp") AS latest_timestamp FROM readings GROUP BY ROLLUP (reading_type)""",
    "filtered_count": f"""WITH {READINGS} SELECT count(*) AS total FROM readings
        WHERE reading_type = 'temperature' AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00'""",
    "sensor_directory": f"""WITH {READINGS} SELECT sensor_id, string_agg(DISTINCT reading_type, ',' ORDER BY reading_type) AS reading_types,
        string_agg(DISTINCT field, ',' ORDER BY field) AS fields, max("timestamp") AS latest_reading,
        count(*) AS total_readings FROM readings GROUP BY 1""",
    "sensor_summary": f"""WITH {DIRTY} SELECT sensor_id, count(*) AS total_readings,
        string_agg(DISTINCT reading_type, ',' ORDER BY reading_type) AS reading_types, min("timestamp") AS first_reading,
        max("timestamp") AS latest_reading FROM dirty GROUP BY 1""",
    "one_sensor_summary": f"""WITH {READINGS} SELECT 'SENSOR_000008' AS sensor_id, count(*) AS total_readings,
        coalesce(string_agg(DISTINCT reading_type, ',' ORDER BY reading_type), '') AS reading_types,
        min("timestamp") AS first_reading, max("timestamp") AS latest_reading FROM readings WHERE sensor_id = 'SENSOR_000008'""",
    "absent_sensor_summary": f"""WITH {READINGS} SELECT 'SENSOR_NONE' AS sensor_id, count(*) AS total_readings,
        coalesce(string_agg(DISTINCT reading_type, ',' ORDER BY reading_type), '') AS reading_types,
        min("timestamp") AS first_reading, max("timestamp") AS latest_reading FROM readings WHERE sensor_id = 'SENSOR_NONE'""",
    "summary_by_type": f"""WITH {UNIQUE} SELECT sensor_id, reading_type, count(value) AS "count", min(value) AS "min",
        max(value) AS "max", round(avg(value), 6) AS "avg", arg_max_null(value, "timestamp") AS latest_value,
        max("timestamp") AS latest_timestamp FROM uniq GROUP BY 1, 2 HAVING count(value) > 0""",
    "daily_aggregation": f'WITH {DIRTY} SELECT CAST("timestamp" AS DATE) AS date, {DAY_AGGS} FROM dirty GROUP BY 1 ORDER BY 1',
    "daily_by_sensor_type": f"""WITH {DIRTY} SELECT sensor_id, reading_type, CAST("timestamp" AS DATE) AS date, {DAY_AGGS}
        FROM dirty GROUP BY 1, 2, 3""",
    "ingest_counters": f"""WITH {TEXT} SELECT count(*) FILTER (sensor_id <> '' AND ts IS NOT NULL) AS processed,
        count(*) - count(*) FILTER (sensor_id <> '' AND ts IS NOT NULL) AS skipped FROM txt""",
    "error_counts": f"""WITH {TEXT}, e AS (SELECT unnest({ERRORS}) AS error FROM txt)
        SELECT error, count(*) AS "rows" FROM e GROUP BY 1""",
    "validation_counters": f"""WITH {TEXT}, e AS (SELECT {ERRORS} AS errs FROM txt)
        SELECT count(*) AS processed, count(*) FILTER (len(errs) = 0) AS passed, count(*) FILTER (len(errs) > 0) AS failed,
        CAST(sum(len(errs)) AS BIGINT) AS errors FROM e""",
    "quality_metrics": f"""WITH {DIRTY} SELECT count(*) AS total_records, count(*) - count(value) AS missing_values,
        count(*) FILTER (value > 100) AS outliers, count(DISTINCT sensor_id) AS total_sensors,
        round(count(value) / count(*), 6) AS completeness,
        round(1.0::DOUBLE - count(*) FILTER (value > 100) / count(value), 6) AS accuracy_rate,
        round(100.0::DOUBLE * count(*) FILTER (sensor_id <> '' AND value IS NOT NULL) / count(*), 6) AS overall_quality_score,
        count(*) - count(value) + count(*) FILTER (value > 100) + count(*) FILTER (sensor_id = '') AS quality_issues FROM dirty""",
    "quality_rows": f'WITH {PERCENT} SELECT metric, reading_type, sensor_id, round(value, 6) AS value, "timestamp" FROM qrows',
    "gap_rows": f"""WITH {STEPS} SELECT 'gap_hours' AS metric, reading_type, sensor_id, CAST(max(gap_hours) AS DOUBLE) AS value,
        max(gap_end) AS "timestamp" FROM gap GROUP BY ALL""",
    "descriptive_statistics": f"WITH {DIRTY} SELECT {STATS} FROM dirty",
    "statistics_by_type": f"WITH {DIRTY} SELECT reading_type, {STATS} FROM dirty GROUP BY 1",
    "median_by_rank": f"""WITH {DIRTY} SELECT sensor_id, reading_type, round(median(value), 6) AS median FROM dirty
        WHERE value IS NOT NULL GROUP BY 1, 2""",
    "trends": f"""WITH {READINGS}, t AS (SELECT sensor_id, reading_type, count(value) AS n,
          regr_slope(value, {HOUR_NUMBER}) AS s, corr(value, {HOUR_NUMBER}) AS c FROM readings GROUP BY 1, 2)
        SELECT sensor_id, reading_type, n AS "count", round(s, 6) AS slope, round(c, 6) AS correlation,
          CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' WHEN s = 0 THEN 'stable' END AS direction,
          CASE WHEN abs(c) < 0.3 THEN 'weak' WHEN abs(c) < 0.7 THEN 'moderate' WHEN c IS NOT NULL THEN 'strong' END AS strength
        FROM t""",
    "type_correlations": f"""WITH {READINGS}, h AS (SELECT field, date_trunc('hour', "timestamp") AS hour,
          avg(value) FILTER (reading_type = 'temperature') AS t, avg(value) FILTER (reading_type = 'humidity') AS u,
          avg(value) FILTER (reading_type = 'soil_moisture') AS s FROM readings GROUP BY 1, 2)
        SELECT 'temperature_humidity' AS pair, round(corr(t, u), 6) AS correlation FROM h
        UNION ALL SELECT 'humidity_soil_moisture', round(corr(u, s), 6) FROM h""",
    "summary_report": SUMMARY,
    "coverage": f"""WITH {HOURS} SELECT sensor_id, reading_type, count(*) AS actual_readings,
        max(CAST(date_diff('hour', lo, hi) + 1 AS BIGINT)) AS expected_readings,
        floor(100.0::DOUBLE * count(*) / max(date_diff('hour', lo, hi) + 1) * 10 + 0.5) / 10 AS coverage_percentage
        FROM hours, span GROUP BY 1, 2""",
    "coverage_by_mask": f"""WITH {HOURS} SELECT sensor_id, reading_type, count(*) AS actual_readings,
        CAST(date_diff('hour', min(hour), max(hour)) + 1 AS BIGINT) AS expected_readings,
        floor(100.0::DOUBLE * count(*) / (date_diff('hour', min(hour), max(hour)) + 1) * 10 + 0.5) / 10 AS coverage_percentage
        FROM hours GROUP BY 1, 2""",
    "gaps_by_mask": f"""WITH {HOURS}, s AS (SELECT *, lag(hour) OVER (PARTITION BY sensor_id, reading_type ORDER BY hour) AS prev FROM hours)
        SELECT sensor_id, reading_type, prev + INTERVAL 1 HOUR AS gap_start, CAST(date_diff('hour', prev, hour) - 1 AS BIGINT) AS hours
        FROM s WHERE date_diff('hour', prev, hour) > 1""",
    "profile_from_loads": f"""WITH {DIRTY} """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS "rows", count(*) - count("{c}") AS nulls, true AS distinct_close, true AS median_close FROM dirty"""
        for c in ("id", "sensor_id", "timestamp", "reading_type", "value", "field", "battery_level")
    ),
    "coverage_in_range": f"""WITH {HOURS} SELECT sensor_id, reading_type, count(*) AS actual_readings,
        CAST(240 AS BIGINT) AS expected_readings, floor(100.0::DOUBLE * count(*) / 240 * 10 + 0.5) / 10 AS coverage_percentage
        FROM hours WHERE hour BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-14 23:00:00' GROUP BY 1, 2""",
    "coverage_summary": f"""WITH {STEPS}, hours AS (
          SELECT sensor_id, reading_type, date_trunc('hour', "timestamp") AS hour FROM readings GROUP BY ALL),
        span AS (SELECT date_diff('hour', min(hour), max(hour)) + 1 AS h FROM hours),
        c AS (SELECT count(*) AS actual, count(DISTINCT sensor_id || '/' || reading_type) AS series FROM hours)
        SELECT floor(100.0::DOUBLE * actual / (series * h) * 10 + 0.5) / 10 AS overall_coverage,
          (SELECT count(*) FROM gap) AS total_gaps, (SELECT max(gap_hours) FROM gap) AS longest_gap_hours,
          (SELECT count(DISTINCT sensor_id) FROM gap) AS sensors_with_gaps FROM c, span""",
    "anomaly_totals": f"""WITH {CLASSES} SELECT count(*) AS total_records, count(anomaly_class) AS total_anomalies,
        round(100.0::DOUBLE * count(anomaly_class) / count(*), 6) AS anomaly_percentage,
        count(*) FILTER (anomaly_class = 'statistical_outlier') AS statistical_outliers,
        count(*) FILTER (anomaly_class = 'range_violation') AS range_violations,
        count(*) FILTER (anomaly_class = 'temporal_anomaly') AS temporal_anomalies,
        count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
        count(*) FILTER (severity = 'high') AS high,
        count(DISTINCT CASE WHEN anomaly_class IS NOT NULL THEN sensor_id END) AS sensors_affected FROM classes""",
    "anomaly_breakdown": f"""WITH {CLASSES} SELECT anomaly_class, severity, count(*) AS anomalies,
        count(DISTINCT sensor_id) AS sensors_affected FROM classes WHERE anomaly_class IS NOT NULL GROUP BY 1, 2""",
    "affected_sensors": f"""WITH {CLASSES} SELECT sensor_id, count(*) AS anomalies FROM classes
        WHERE anomaly_class IS NOT NULL GROUP BY 1""",
    "top_anomalies": f"""WITH {CLASSES} SELECT id, sensor_id, reading_type, "timestamp", value,
        CAST(min_value AS VARCHAR) || '-' || CAST(max_value AS VARCHAR) AS expected_range, severity, round(zscore, 6) AS zscore
        FROM classes WHERE anomaly_class IS NOT NULL ORDER BY abs(zscore) DESC NULLS LAST, id LIMIT 20""",
    "custom_report": f"""WITH {READINGS} SELECT date_trunc('day', "timestamp") AS period, round(avg(value), 6) AS average,
        max(value) AS maximum, min(value) AS minimum, count(value) AS "count", round(sum(value), 6) AS "sum",
        round(regr_slope(value, {HOUR_NUMBER}), 6) AS trend FROM readings GROUP BY 1""",
    "custom_report_by_sensor": f"""WITH {READINGS} SELECT sensor_id, date_trunc('week', "timestamp") AS period,
        round(avg(value), 6) AS average, max(value) AS maximum FROM readings
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2""",
    "data_profile": _profile(),
    # series
    "zscore_outliers": f"""WITH {READINGS}, s AS (SELECT reading_type, avg(value) AS m, stddev_samp(value) AS sd FROM readings GROUP BY 1)
        SELECT id, reading_type, value, {ZED} FROM readings LEFT JOIN s USING (reading_type)""",
    "zscore_by_series": f"""WITH {READINGS}, s AS (SELECT sensor_id, reading_type, avg(value) AS m, stddev_samp(value) AS sd
          FROM readings GROUP BY 1, 2)
        SELECT id, sensor_id, reading_type, {ZED} FROM readings LEFT JOIN s USING (sensor_id, reading_type)""",
    "rolling_average": f"WITH {DIRTY}, {_rolling('dirty')}",
    "temporal_anomalies": _temporal("value"),
    "temporal_anomalies_shifted": _temporal("value + 1e7"),
    "gaps": f"WITH {STEPS} SELECT sensor_id, reading_type, gap_start, gap_end, gap_hours FROM gap",
    "longest_gaps": f"""WITH {STEPS} SELECT sensor_id, reading_type, count(*) AS gap_count, max(gap_hours) AS longest_gap_hours
        FROM gap WHERE gap_end > gap_start + INTERVAL 24 HOUR GROUP BY 1, 2""",
    "latest_reading": f"""WITH {READINGS} SELECT sensor_id, reading_type, max("timestamp") AS latest_timestamp,
        arg_max_null(value, "timestamp") AS latest_value, arg_max_null(id, "timestamp") AS latest_id FROM readings GROUP BY 1, 2""",
    "drop_missing": ALL_DIRTY + " WHERE value IS NOT NULL",
    "forward_fill": FILLED,
    "forward_fill_by_file": FILLED,
    "deduplicate": f"WITH {UNIQUE} SELECT {BASE} FROM uniq",
    "duplicate_count": f"""WITH {UNIQUE} SELECT (SELECT count(*) FROM dirty) AS total_rows, (SELECT count(*) FROM uniq) AS unique_rows,
        (SELECT count(*) FROM dirty) - (SELECT count(*) FROM uniq) AS duplicates_removed""",
    "concatenate": f"""WITH {DIRTY} SELECT {BASE} FROM readings UNION ALL
        SELECT id, sensor_id, "timestamp", reading_type, value, field, NULL FROM dirty""",
    "rule_lookup": f"""WITH {READINGS}, {RULES} SELECT id, reading_type, multiplier, "offset", min_value, max_value
        FROM readings LEFT JOIN rules USING (reading_type)""",
    "hourly_spine": f"""WITH {HOURS}, spine AS (SELECT sensor_id, reading_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour
          FROM (SELECT DISTINCT sensor_id, reading_type FROM hours), span)
        SELECT sensor_id, reading_type, CAST(hour AS DATE) AS day, count(*) AS expected,
          count(*) FILTER (readings IS NULL) AS missing, CAST(coalesce(sum(readings), 0) AS BIGINT) AS readings
        FROM spine LEFT JOIN hours USING (sensor_id, reading_type, hour) GROUP BY 1, 2, 3""",
    "missing_hours": f"""WITH {HOURS}, spine AS (SELECT sensor_id, reading_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour
          FROM (SELECT DISTINCT sensor_id, reading_type FROM hours), span)
        SELECT sensor_id, reading_type, CAST(hour AS DATE) AS day, count(*) AS missing, min(hour) AS "first", max(hour) AS "last"
        FROM spine ANTI JOIN hours USING (sensor_id, reading_type, hour) GROUP BY 1, 2, 3""",
    # row functions and rules
    "calibrate_by_code": f"WITH {DIRTY} SELECT id, reading_type, value, {CODE} AS calibrated_value FROM dirty",
    "calibrate_by_config": f"""WITH {DIRTY}, {RULES} SELECT id, reading_type, value, value * multiplier + "offset" AS calibrated_value
        FROM dirty LEFT JOIN rules USING (reading_type)""",
    "quality_score": f"WITH {DIRTY} SELECT id, {SCORE} AS quality_score FROM dirty",
    "range_anomalies": f"WITH {FLAGS} SELECT id, value, is_range FROM flags",
    "hard_limit_anomalies": f"""WITH {DIRTY} SELECT id, coalesce(value < -100 OR value > 1000, false) AS anomalous_reading FROM dirty""",
    "numeric_text": f"WITH {TEXT} SELECT id, {NUMBER} AS number FROM txt",
    "lower_types": f"WITH {TEXT} SELECT id, lower(reading_type) AS reading_type FROM txt",
    "timestamp_text": f'WITH {TEXT} SELECT id, ts AS parsed, ts IS NOT NULL AS is_iso FROM txt',
    "local_time": f'WITH {READINGS} SELECT id, "timestamp" + INTERVAL 330 MINUTE AS local_time FROM readings',
    "date_text": f"""WITH {READINGS} SELECT id, strftime("timestamp", '%Y-%m-%d') AS day,
        strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM readings""",
    "day_list": f"""WITH {READINGS} SELECT CAST(unnest(generate_series(date_trunc('day', min("timestamp")),
        date_trunc('day', max("timestamp")), INTERVAL 1 DAY)) AS DATE) AS day FROM readings""",
    "processing_version": f"WITH {READINGS} SELECT id, '2.0' AS processing_version FROM readings",
    "flatten_location": f"WITH {READINGS} SELECT id, field, 28.5::DOUBLE AS latitude, 77.25::DOUBLE AS longitude FROM readings",
    "report_labels": f"""WITH {READINGS}, r AS (SELECT id, ['quality','processing','coverage','anomaly','analytics','summary','custom','other'][id % 8 + 1] AS p
          FROM readings)
        SELECT p || '_' || CAST(id AS VARCHAR) AS report_id,
          CASE WHEN p = 'other' THEN 'Unknown' ELSE upper(p[1]) || p[2:] || ' Report' END AS type FROM r""",
    "file_dates": f'WITH {READINGS} SELECT id, CAST("timestamp" AS DATE) AS file_date FROM readings',
    "validity_rules": f"""WITH {TEXT} SELECT id, coalesce(sensor_id <> '' AND ts IS NOT NULL, false) AS ingest_ok,
        coalesce(sensor_id <> '' AND "timestamp" <> '' AND value IS NOT NULL, false) AS basic_ok, len({ERRORS}) = 0 AS pipeline_ok,
        coalesce(sensor_id <> '' AND ts IS NOT NULL AND reading_type IN ('temperature', 'humidity', 'soil_moisture',
          'light_intensity', 'battery_level') AND {NUMBER} IS NOT NULL AND battery_level BETWEEN 0 AND 100, false) AS strict_ok
        FROM txt""",
    "validation_errors": f"""WITH {TEXT} SELECT id, coalesce(array_to_string({ERRORS}, ','), '') AS errors, len({ERRORS}) = 0 AS is_valid
        FROM txt""",
    "strict_split": f"""WITH {TEXT} SELECT id, CASE WHEN len({ERRORS}) = 0 THEN 'kept' ELSE 'quarantine' END AS part FROM txt""",
    "rule_compliance": f"""WITH {FLAGS}, e AS (
          SELECT 'Missing required field: sensor_id' AS rule FROM flags WHERE sensor_id = ''
          UNION ALL SELECT 'Missing required field: value' FROM flags WHERE value IS NULL
          UNION ALL SELECT 'value out of range' FROM flags WHERE is_range
          UNION ALL SELECT 'compliant' FROM flags WHERE sensor_id <> '' AND value IS NOT NULL AND NOT is_range)
        SELECT rule, count(*) AS "rows" FROM e GROUP BY 1""",
    "threshold_breaches": f"""WITH {PERCENT} SELECT metric, reading_type, sensor_id, round(value, 6) AS value, "timestamp", "limit"
        FROM breaches""",
    "issue_rows": f"""WITH {DIRTY}
        SELECT id, 'missing_value' AS type, sensor_id, reading_type AS field, NULL::DOUBLE AS value, '' AS expected_range, "timestamp"
        FROM dirty WHERE value IS NULL
        UNION ALL SELECT id, 'outlier', sensor_id, reading_type, value, '0-100', "timestamp" FROM dirty WHERE value > 100
        UNION ALL SELECT id, 'missing_sensor_id', sensor_id, reading_type, NULL, '', "timestamp" FROM dirty WHERE sensor_id = ''""",
    "recommendations": f"""WITH {_advice(DIRTY, "coalesce(value < min_value OR value > max_value, false) OR coalesce(abs((value - m) / sd) > 1.5, false)")}
        SELECT * FROM advice""",
    "anomaly_report": f"""WITH {CLASSES}, odd AS (SELECT * FROM classes WHERE anomaly_class IS NOT NULL)
        SELECT 'totals' AS section, '' AS "key", CAST(count(*) AS DOUBLE) AS value FROM odd
        UNION ALL SELECT 'breakdown', anomaly_class || '/' || severity, count(*) FROM odd GROUP BY anomaly_class, severity
        UNION ALL SELECT 'sensors', sensor_id, count(*) FROM odd GROUP BY sensor_id
        UNION ALL SELECT 'top_anomalies', id || '/' || severity, round(zscore, 6)
          FROM (SELECT * FROM odd ORDER BY abs(zscore) DESC NULLS LAST, id LIMIT 10)""",
    "coverage_report": f"""WITH {STEPS}, hours AS (SELECT DISTINCT sensor_id, reading_type, date_trunc('hour', "timestamp") AS hour FROM readings),
        span AS (SELECT date_diff('hour', min(hour), max(hour)) + 1 AS h FROM hours)
        SELECT 'coverage' AS section, sensor_id || '/' || reading_type AS "key",
          floor(100.0::DOUBLE * count(*) / max(h) * 10 + 0.5) / 10 AS value FROM hours, span GROUP BY sensor_id, reading_type
        UNION ALL SELECT 'gaps', sensor_id || '/' || reading_type || '/' || rtrim(rtrim(strftime(gap_end, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), gap_hours FROM gap
        UNION ALL SELECT 'summary', count(DISTINCT sensor_id) || '/' || count(*), max(gap_hours) FROM gap""",
    "analytics_report": f"""WITH {CLASSES},
        t AS (SELECT sensor_id, reading_type, regr_slope(value, {HOUR_NUMBER}) AS s FROM classes GROUP BY 1, 2),
        h AS (SELECT field, date_trunc('hour', "timestamp") AS hour, avg(value) FILTER (reading_type = 'temperature') AS t,
          avg(value) FILTER (reading_type = 'humidity') AS u FROM classes GROUP BY 1, 2),
        k AS (SELECT reading_type, regr_slope(value, {HOUR_NUMBER}) AS s, corr(value, {HOUR_NUMBER}) AS c,
          count(*) FILTER (NOT is_range) / count(*) AS inside, count(anomaly_class) / count(*) AS odd FROM classes GROUP BY 1)
        SELECT 'statistics' AS section, CAST(count(value) AS VARCHAR) AS "key", round(median(value), 6) AS value FROM classes
        UNION ALL SELECT 'trends', sensor_id || '/' || reading_type || CASE WHEN s > 0 THEN '/increasing' WHEN s < 0 THEN '/decreasing'
          WHEN s = 0 THEN '/stable' ELSE '' END, round(s, 6) FROM t
        UNION ALL SELECT 'correlations', 'temperature_humidity', round(corr(t, u), 6) FROM h
        UNION ALL SELECT 'insights', reading_type || '/trend/' || CASE WHEN s = 0 THEN 'neutral' ELSE 'positive' END, round(abs(c), 6) FROM k
        UNION ALL SELECT 'insights', reading_type || '/pattern/neutral', round(inside, 6) FROM k
        UNION ALL SELECT 'insights', reading_type || '/anomaly/' || CASE WHEN odd > 0 THEN 'negative' ELSE 'positive' END, round(1 - odd, 6) FROM k""",
    "quality_report": f"""WITH {PERCENT}, gap_src AS (
          SELECT sensor_id, reading_type, "timestamp" AS gap_end, lag("timestamp") OVER (PARTITION BY sensor_id, reading_type ORDER BY "timestamp", id) AS gap_start FROM flags),
        gap AS (SELECT *, CAST(floor(epoch_us(gap_end - gap_start) / 3600000000.0) AS BIGINT) AS gap_hours FROM gap_src WHERE gap_end > gap_start + INTERVAL 1 HOUR),
        {_advice("", "is_range", "flags")}
        SELECT 'quality_metrics' AS section, count(*) FILTER (value IS NULL) || '/' || count(*) FILTER (value > 100) AS "key",
          round(count(value) / count(*), 6) AS value FROM flags
        UNION ALL SELECT 'metrics', metric || '/' || sensor_id || '/' || reading_type, round(value, 6) FROM qrows
        UNION ALL SELECT 'metrics', 'gap_hours/' || sensor_id || '/' || reading_type, max(gap_hours) FROM gap GROUP BY sensor_id, reading_type
        UNION ALL SELECT 'issues', id || '/missing_value', id FROM flags WHERE value IS NULL
        UNION ALL SELECT 'issues', id || '/outlier', id FROM flags WHERE value > 100
        UNION ALL SELECT 'issues', id || '/missing_sensor_id', id FROM flags WHERE sensor_id = ''
        UNION ALL SELECT 'recommendations', sensor_id || '/' || reading_type || '/' || category, 1 FROM advice""",
    "alerts": f"""WITH {PERCENT}
        SELECT 'warning' AS level, CASE WHEN metric = 'missing_percentage' THEN 'high' ELSE 'medium' END AS severity,
          CASE WHEN metric = 'missing_percentage' THEN 'missing_data' ELSE 'anomaly' END AS type,
          sensor_id || ' ' || reading_type || ' ' || metric || ' above limit' AS message, "timestamp" FROM breaches
        UNION ALL SELECT 'info', 'low', 'status', 'All sensors operating normally', max("timestamp") FROM flags
        HAVING (SELECT count(*) FROM breaches) = 0""",
    "quiet_alerts": f"""WITH {READINGS} SELECT 'info' AS level, 'low' AS severity, 'status' AS type,
        'All sensors operating normally' AS message, max("timestamp") AS "timestamp" FROM readings""",
    "insights": INSIGHTS,
    # flows
    "process_records": f"WITH {TEXT} {PROCESSED}, '2.0' AS processing_version FROM txt",
    "process_records_strict": f"WITH {TEXT} {PROCESSED} FROM txt WHERE len({ERRORS}) = 0",
    "process_records_lenient": f"""WITH {TEXT} {PROCESSED} FROM txt
        WHERE coalesce("timestamp", '') = '' OR ts IS NOT NULL""",
    "batch_run": BATCH,
    "incremental_load": BATCH,
    "odd_batch_run": ODD_BATCH,
    "incremental_forward_fill": FILLED_BATCH,
    "correction_load": f"""WITH {READINGS} SELECT CASE WHEN value > 100 THEN id + 1000000000 ELSE id END AS id, sensor_id, "timestamp", reading_type,
        CASE WHEN value > 100 THEN value / 2 ELSE value END AS value, field, battery_level FROM readings
        QUALIFY row_number() OVER (PARTITION BY sensor_id, "timestamp", reading_type ORDER BY value > 100 DESC, id) = 1""",
    "load_counters": f"""WITH {DIRTY}, good AS (SELECT *, id >= 1000000000 AS later FROM dirty WHERE sensor_id <> ''),
        loads AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, "timestamp", reading_type ORDER BY id) AS place,
          row_number() OVER (PARTITION BY later, sensor_id, "timestamp", reading_type ORDER BY id) AS own FROM good),
        kept AS (SELECT * FROM loads WHERE place = 1 AND value IS NOT NULL),
        first_stats AS (SELECT reading_type, avg(value) AS m, stddev_samp(value) AS sd FROM loads WHERE NOT later AND own = 1 AND value IS NOT NULL GROUP BY 1),
        stats AS (SELECT reading_type, avg(value) AS m, stddev_samp(value) AS sd FROM kept GROUP BY 1),
        {RULES},
        flagged AS (SELECT k.later, coalesce(value < min_value OR value > max_value, false)
            OR coalesce(abs((value - CASE WHEN later THEN s.m ELSE f.m END) / CASE WHEN later THEN s.sd ELSE f.sd END) > 3.0, false) AS is_out
          FROM kept k LEFT JOIN rules USING (reading_type) LEFT JOIN stats s USING (reading_type) LEFT JOIN first_stats f USING (reading_type))
        SELECT 'ingestion' AS stage, 'records_read' AS metric, count(*) AS total FROM dirty
        UNION ALL SELECT 'ingestion', 'records_ingested', count(*) FILTER (sensor_id <> '') FROM dirty
        UNION ALL SELECT 'ingestion', 'records_skipped', count(*) FILTER (sensor_id = '') FROM dirty
        UNION ALL SELECT 'ingestion', 'records_broken', 0 FROM (SELECT 1)
        UNION ALL SELECT 'ingestion', 'files_cut_short', 0 FROM (SELECT 1)
        UNION ALL SELECT 'ingestion', 'invalid_records', count(*) FILTER (sensor_id = '' OR value IS NULL) FROM dirty
        UNION ALL SELECT 'cleaning', 'duplicates_removed', count(*) FILTER (own > 1) FROM loads
        UNION ALL SELECT 'cleaning', 'records_transformed', count(*) FILTER (own = 1) FROM loads
        UNION ALL SELECT 'storage', 'records_stored', count(*) FROM kept
        UNION ALL SELECT 'storage', 'outliers_detected', count(*) FILTER (is_out) FROM flagged""",
    "processing_report": f"""{BATCH_CTE}
        SELECT 'records_read' AS metric, CAST(count(*) AS DOUBLE) AS value FROM dirty
        UNION ALL SELECT 'records_ingested', count(*) FILTER (sensor_id <> '') FROM dirty
        UNION ALL SELECT 'records_skipped', count(*) FILTER (sensor_id = '') FROM dirty
        UNION ALL SELECT 'records_broken', 0 FROM (SELECT 1)
        UNION ALL SELECT 'files_cut_short', 0 FROM (SELECT 1)
        UNION ALL SELECT 'invalid_records', count(*) FILTER (sensor_id = '' OR value IS NULL) FROM dirty
        UNION ALL SELECT 'duplicates_removed', (SELECT count(*) FILTER (sensor_id <> '') FROM dirty) - count(*) FROM uniq WHERE sensor_id <> ''
        UNION ALL SELECT 'records_transformed', count(*) FROM uniq WHERE sensor_id <> ''
        UNION ALL SELECT 'records_stored', count(*) FROM out
        UNION ALL SELECT 'outliers_detected', count(*) FILTER (anomalous_reading) FROM out
        UNION ALL SELECT 'dates_written', (SELECT count(DISTINCT CAST("timestamp" AS DATE)) FROM uniq WHERE sensor_id <> '') FROM (SELECT 1)""",
    "incremental_averages": f"WITH {UNIQUE}, loaded AS (SELECT * FROM uniq WHERE sensor_id <> ''), {_rolling('loaded')}",
    "volume_daily": f"""WITH {VOLUME} SELECT reading_type, CAST("timestamp" AS DATE) AS date, {DAY_AGGS} FROM vol GROUP BY 1, 2""",
    "volume_rolling": f"WITH {VOLUME}, {_rolling('vol')}",
    "volume_zscore": f"""WITH {VOLUME}, s AS (SELECT reading_type, avg(value) AS m, stddev_samp(value) AS sd FROM vol GROUP BY 1),
        z AS (SELECT reading_type, CASE WHEN sd > 0 THEN (value - m) / sd END AS z FROM vol LEFT JOIN s USING (reading_type))
        SELECT reading_type, count(*) AS "rows", count(*) FILTER (abs(z) > 3.0) AS outliers, round(max(abs(z)), 6) AS largest
        FROM z GROUP BY 1""",
}
ORACLE["validation_totals"] = ORACLE["validation_saved"]
