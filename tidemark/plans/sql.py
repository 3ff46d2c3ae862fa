"""The daily statistics as Spark SQL text, for users who prefer SQL."""

# ``{events}`` is any frame with a ``created_at`` column, ``:fill`` the count of
# an empty day. Bounds come from the counts, so the events are scanned once.
SERIES_STATS = """
WITH counts AS (
  SELECT to_date(created_at) AS date, count(*) AS daily_count
  FROM {events}
  WHERE to_date(created_at) IS NOT NULL
  GROUP BY ALL
),
bounds AS (
  SELECT min(struct(date, daily_count)).date AS first_day, max(struct(date, daily_count)).date AS last_day
  FROM counts
),
spine AS (
  SELECT first_day, explode(sequence(first_day, last_day, INTERVAL 1 DAY)) AS date
  FROM bounds
),
filled AS (
  SELECT first_day, spine.date, coalesce(daily_count, :fill) AS filled_daily_count
  FROM spine LEFT JOIN counts ON counts.date = spine.date
)
SELECT
  date,
  filled_daily_count,
  sum(filled_daily_count) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS running_cumulative_sum,
  CAST(datediff(date, first_day) AS BIGINT) AS days_elapsed
FROM filled
"""
