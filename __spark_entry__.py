"""

``orders`` stands for the table of dated things (order key as slug), ``events``
for keyed series with sub-day time stamps. Every query reads whole tables.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import tidemark as tm  # noqa: E402
from tidemark.plans.sql import SERIES_STATS  # noqa: E402
from tidemark.sources.events import document_schema  # noqa: E402
from tidemark.staging import scratch_path  # noqa: E402

try:  # the training-data operators are an optional part
    from tidemark.llm import queries as llm  # noqa: E402
except ImportError:
    llm = None
try:
    import corpus_pipeline  # noqa: E402
except ImportError:
    corpus_pipeline = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"


FIXED_TARGET = """CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 50000
    WHEN 'view' THEN 1e300 * 1e300 ELSE 2 * last_y END"""
DATE_FORMS = [
    "yyyy-MM-dd",
    "EEE MMM dd yyyy",
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
    "MMMM d, yyyy",
    "d MMM yyyy HH:mm 'GMT'",
    "MM/dd/yyyy",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
]


def _twice_total() -> Column:
    return 2 * F.col("last_y")


ORDERS = """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
    o_orderdate timestamp_ntz, o_orderpriority string"""
EVENTS = """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
    props string"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.read_table(spark, f"{sf_dir}/orders.parquet", schema=ORDERS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.read_table(spark, f"{sf_dir}/events.parquet", schema=EVENTS)


def _order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.series_stats(_orders(spark, sf_dir), "o_orderdate")


def _event_stats(spark: SparkSession, sf_dir: str, by: str, bounds: str = "per_key") -> DataFrame:
    return tm.series_stats(_events(spark, sf_dir), "ts", by, bounds)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


# --- counts, calendars, totals -------------------------------------------------


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.daily_counts(_orders(spark, sf_dir), "o_orderdate")


def daily_counts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.daily_counts(_events(spark, sf_dir), "ts", ["user_id", "event_type"])


def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.date_bounds(daily_counts(spark, sf_dir))


def min_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.min_date(_orders(spark, sf_dir), "o_orderdate")


def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.date_spine(date_bounds(spark, sf_dir))


def densify_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = daily_counts(spark, sf_dir)
    return tm.join_spine(tm.date_spine(tm.date_bounds(counts)), counts)


def densify_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tm.daily_counts(_events(spark, sf_dir), "ts", "user_id")
    return tm.densify(counts, "user_id")


def densify_by_key_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["user_id", "event_type"]
    return tm.densify(tm.daily_counts(_events(spark, sf_dir), "ts", by), by, bounds="global")


def densify_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tm.daily_counts(_events(spark, sf_dir), "ts", "user_id", grain="hour")
    return tm.densify(counts, "user_id", grain="hour")


def densify_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer by month, with the months between them."""
    counts = tm.daily_counts(_orders(spark, sf_dir), "o_orderdate", "o_custkey", grain="month")
    return tm.densify(counts, "o_custkey", grain="month")


def series_stats_weekly_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's weeks, over the weeks of all."""
    return tm.series_stats(_orders(spark, sf_dir), "o_orderdate", "o_custkey", "global", grain="week")


def series_stats_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.series_stats(_orders(spark, sf_dir), "o_orderdate", grain="quarter")


def combined_series_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual and predicted months of the orders, until twice their number."""
    counts = tm.daily_counts(_orders(spark, sf_dir), "o_orderdate", grain="month")
    stats, model = tm.stats_from_counts(counts, grain="month"), tm.fit_counts(counts, grain="month")
    return _rounded(tm.combined_series(stats, model, _twice_total(), grain="month"), tagCount=2)


def crossing_month_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tm.daily_counts(_orders(spark, sf_dir), "o_orderdate", "o_orderstatus", grain="month")
    model = tm.fit_counts(counts, "o_orderstatus", grain="month")
    return tm.crossing_date(model, _twice_total(), "o_orderstatus", grain="month")


def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_stats(spark, sf_dir)


def series_stats_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_stats(spark, sf_dir, "user_id")


def series_stats_by_key_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_stats(spark, sf_dir, "user_id", "global")


def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select(F.col("o_orderdate").alias("created_at"))
    return tm.run_sql(spark, SERIES_STATS, args={"fill": 0}, events=orders)


def series_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.stats_vectors(_order_stats(spark, sf_dir))


def listing_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.event_listing(_orders(spark, sf_dir), "o_orderkey", "o_orderdate")


def tabular_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.tabular_view(_order_stats(spark, sf_dir), ["date"])


def threshold_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day with half of all orders; the total is a one-row broadcast."""
    counts = daily_counts(spark, sf_dir).where("date IS NOT NULL")
    half = counts.agg((F.sum("daily_count") / 2).alias("half"))
    stats = tm.stats_from_counts(counts).crossJoin(F.broadcast(half))
    return tm.first_reaching(stats, F.col("half"))


def threshold_day_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each key's total, which rides along with the sparse counts."""
    counts = tm.daily_counts(_events(spark, sf_dir), "ts", "event_type").where("date IS NOT NULL")
    half = F.sum("daily_count").over(Window.partitionBy("event_type")) / 2
    stats = tm.running_total(counts, by="event_type").withColumn("half", half)
    return tm.first_reaching(stats, F.col("half"), "event_type")


def zero_counts_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of purchases by user: days of other events count 0, bounds are those of all."""
    bought = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("daily_count")
    counts = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("date")).agg(bought)
    return tm.stats_from_counts(counts, "user_id", "global")


def running_total_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tm.daily_counts(_events(spark, sf_dir), "ts", "user_id")
    return tm.days_elapsed(tm.running_total(counts, by="user_id"), "user_id")


def running_total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    return tm.running_total_rows(rows, F.lit(1), ["o_orderdate", "o_orderkey"])


def running_total_rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(
        "event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents")
    )
    return tm.running_total_rows(rows, "cents", ["ts", "event_id"], "event_type")


def running_total_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderdate")
    return tm.running_total_rows(rows, F.lit(1), "o_orderdate", "o_orderstatus", peers=True)


# --- model and forecast ----------------------------------------------------------


def poisson_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tm.fit_stats(_order_stats(spark, sf_dir))
    return _rounded(model.select("intercept", "slope", "n_points"), intercept=6, slope=6)


def poisson_fit_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tm.fit_poisson_distributed(_order_stats(spark, sf_dir))
    return _rounded(model.select("intercept", "slope"), intercept=6, slope=6)


def crossing_date_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tm.fit_poisson_distributed(_order_stats(spark, sf_dir), origin="date")
    return tm.crossing_date(model, _twice_total())


def poisson_fit_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tm.fit_poisson(_event_stats(spark, sf_dir, "event_type"), by="event_type")
    model = model.select("event_type", "intercept", "slope", "n_points")
    return _rounded(model, intercept=6, slope=6)


def poisson_fit_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tm.fit_counts(tm.daily_counts(_events(spark, sf_dir), "ts", "user_id"), "user_id")
    return _rounded(model.select("user_id", "intercept", "slope", "n_points"), intercept=6, slope=6)


def poisson_fit_distributed_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fits of ``poisson_fit_by_key`` for keys that no task could hold."""
    model = tm.fit_poisson_distributed(_event_stats(spark, sf_dir, "event_type"), by="event_type")
    model = model.select("event_type", "intercept", "slope", "n_points")
    return _rounded(model, intercept=6, slope=6)


def _order_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.fit_counts(daily_counts(spark, sf_dir))


def _keyed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.fit_counts(tm.daily_counts(_events(spark, sf_dir), "ts", "event_type"), "event_type")


def forecast_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tm.forecast_until(_order_model(spark, sf_dir), _twice_total())
    return _rounded(rows, tagCount=2)


def forecast_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tm.forecast_until(_keyed_model(spark, sf_dir), _twice_total(), "event_type")
    return _rounded(rows.drop("status"), tagCount=2)


def apply_series_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast of ``forecast_by_key`` as a Python function of whole vectors."""
    predict = tm.predict_vectors

    def predict_twice(csum, days):  # nested, hence shipped to the workers by value
        return predict(csum, days, 2 * csum[-1])

    rows = tm.apply_series(
        tm.stats_vectors(_event_stats(spark, sf_dir, "event_type"), "event_type"),
        predict_twice,
        inputs=["csum", "days_elapsed"],
        schema="days_elapsed bigint, tagCount double",
        by="event_type",
        order="days_elapsed",
    )
    return _rounded(rows, tagCount=2)


def crossing_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.crossing_date(_order_model(spark, sf_dir), _twice_total())


def crossing_date_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.crossing_date(_keyed_model(spark, sf_dir), _twice_total(), "event_type")


def forecast_status_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and status per key for fixed targets: past, ahead, and beyond the calendar."""
    target = F.expr(FIXED_TARGET)
    model = _keyed_model(spark, sf_dir)
    rows = tm.forecast_until(model, target, "event_type").groupBy("event_type").agg(F.count("*").alias("n_rows"))
    status = tm.crossing_date(model, target, "event_type").select("event_type", "status")
    return status.join(rows, "event_type", "left").na.fill({"n_rows": 0})


def actual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.actual_series(_order_stats(spark, sf_dir))


def predicted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tm.predicted_series(_order_model(spark, sf_dir), _twice_total())
    return _rounded(rows, tagCount=2)


def combined_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = daily_counts(spark, sf_dir)
    rows = tm.combined_series(tm.stats_from_counts(counts), tm.fit_counts(counts), _twice_total())
    return _rounded(rows, tagCount=2)


def combined_series_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tm.daily_counts(_events(spark, sf_dir), "ts", "event_type")
    stats = tm.stats_from_counts(counts, "event_type")
    model = tm.fit_counts(counts, "event_type")
    return _rounded(tm.combined_series(stats, model, _twice_total(), "event_type"), tagCount=2)


def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.ordered_series(combined_series_by_key(spark, sf_dir), "event_type")


def sql_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by SQL text on a table registered by name."""
    orders = _orders(spark, sf_dir).select(F.col("o_orderdate").alias("created_at"))
    tm.register_table(orders, "tidemark_orders")
    return tm.run_sql(spark, SERIES_STATS.replace("{events}", "tidemark_orders"), args={"fill": 0})


# --- vectors, documents, records -------------------------------------------------


def vectors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["days_elapsed", "running_cumulative_sum"]
    stats = _event_stats(spark, sf_dir, "user_id")
    vectors = tm.series_to_vectors(stats, columns, "days_elapsed", "user_id")
    return tm.vectors_to_rows(vectors, columns, "user_id")


def record_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["o_orderstatus", "o_custkey", "o_orderpriority"]
    records = _orders(spark, sf_dir).select("o_orderkey", tm.record_map(names).alias("record"))
    return records.select("o_orderkey", F.explode("record").alias("name", "value"))


def vectors_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of all users as vectors of at most 50 days, and back."""
    columns = ["days_elapsed", "running_cumulative_sum"]
    stats = _event_stats(spark, sf_dir, "user_id")
    vectors = tm.series_to_vectors(stats, columns, "days_elapsed", "user_id", max_length=50, one_row_per_order=True)
    return tm.vectors_to_rows(vectors, columns, ["user_id", "part"]).drop("part")


def apply_series_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of each user's days over the day before as one array; 0 / 0 and x / 0 are missing."""

    def growth(days, counts):
        ratio = [float("nan")] + [b / a if a else float("nan") for a, b in zip(counts[:-1], counts[1:], strict=True)]
        return {"days": [list(days)], "growth": [ratio]}

    rows = tm.apply_series(
        _event_stats(spark, sf_dir, "user_id"),
        growth,
        inputs=["days_elapsed", "filled_daily_count"],
        schema="days array<bigint>, growth array<double>",
        by="user_id",
        order="days_elapsed",
    )
    flat = tm.vectors_to_rows(rows, ["days", "growth"], "user_id")
    return _rounded(flat, growth=6)


def apply_series_chunks_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of raw events by a Python generator that carries them from chunk to chunk."""

    def totals(chunks):
        total = 0
        for ids, cents in chunks:
            sums = cents.cumsum() + total
            total = sums[-1]
            yield {"event_id": ids, "running_total": sums}

    cents = F.coalesce(F.round(F.col("value") * 100), F.lit(0)).cast("bigint").alias("cents")
    rows = _events(spark, sf_dir).select("event_id", "event_type", "ts", cents)
    schema, order = "event_id bigint, running_total bigint", ["ts", "event_id"]
    return tm.apply_series_chunks(rows, totals, ["event_id", "cents"], schema, "event_type", order)


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order: a dated tag and one whose date is no date."""

    def tag(slug: Column, created_at: Column) -> Column:
        extra = F.col("o_orderpriority").alias("extra")
        return F.struct(slug.alias("slug"), created_at.alias("created_at"), extra)

    slug = F.col("o_orderkey").cast("string")
    tags = F.array(
        tag(slug, tm.iso_date("o_orderdate")),
        tag(F.concat(slug, F.lit("-status")), F.col("o_orderstatus")),
    )
    return _orders(spark, sf_dir).select(tags.alias("tags"))


def ingest_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON text, read with the declared schema."""
    texts = _order_documents(spark, sf_dir).select(F.to_json(F.struct("tags")).alias("text"))
    docs = texts.select(F.from_json("text", document_schema()).alias("doc")).select("doc.*")
    return tm.parse_days(tm.unnest_documents(docs))


def ingest_large_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags as large documents, one per task of the scan, read again by byte ranges."""
    tags = _order_documents(spark, sf_dir).select(F.inline("tags"))
    path = scratch_path(spark, "documents")
    tm.write_large_documents(tags, path)
    return tm.parse_days(tm.read_large_documents(spark, path, range_bytes=1 << 20))


def ingest_date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in the forms a date text may have, and read again."""
    day = F.col("o_orderdate")
    forms = [F.date_format(day, pattern) for pattern in DATE_FORMS]
    forms.append((F.unix_date(F.to_date(day)).cast("bigint") * 86_400_000).cast("string"))
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % len(forms) + 1).cast("int"))
    rows = _orders(spark, sf_dir).select("o_orderkey", text.alias("created_at"))
    return tm.parse_days(rows)


def date_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.date_quality(tm.unnest_documents(_order_documents(spark, sf_dir)))


def bad_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.bad_dates(tm.unnest_documents(_order_documents(spark, sf_dir)))


def json_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.key_profile(_events(spark, sf_dir), "props", "event_type")


def json_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the events as they are, and one in seven cut short."""
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return tm.json_quality(_events(spark, sf_dir).withColumn("props", cut), "props", "event_type")


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["ts", "event_id"]
    return tm.first_wins(_events(spark, sf_dir), "user_id", "event_type", "value", order)


def first_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tm.collapse_to_map(first_wins(spark, sf_dir), "user_id", "event_type", "value")
    return records.select("user_id", F.explode("record").alias("event_type", "value"))


def first_wins_map_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``first_wins_map`` in parts of at most 64 bytes."""
    records = tm.collapse_to_map(first_wins(spark, sf_dir), "user_id", "event_type", "value", max_bytes=64)
    return records.select("user_id", F.explode("record").alias("event_type", "value"))


def strict_cast_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as vectors, cast strictly, and back to rows."""
    columns = ["o_orderkey", "is_large", "o_orderpriority"]
    orders = _orders(spark, sf_dir).withColumn("is_large", F.col("o_totalprice") > 100000)
    vectors = tm.series_to_vectors(orders, columns, "o_orderkey", "o_custkey")
    kinds = {"o_orderkey": "number[]", "is_large": "boolean[]", "o_orderpriority": "string[]"}
    return tm.vectors_to_rows(tm.strict_cast(vectors, kinds), columns, "o_custkey")


def strict_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select(
        "o_orderkey", (F.col("o_totalprice") > 100000).alias("is_large"), "o_custkey", "o_orderpriority"
    )
    kinds = {"is_large": "number", "o_custkey": "number", "o_orderpriority": "string"}
    return tm.strict_cast(orders, kinds)


def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table read as two half-open ranges of time."""
    path, cut = f"{sf_dir}/orders.parquet", "1998-01-01"
    early = tm.read_table(spark, path, "o_orderdate", end=cut, schema=ORDERS)
    late = tm.read_table(spark, path, "o_orderdate", start=cut, schema=ORDERS)
    return tm.series_stats(early.unionByName(late), "o_orderdate")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    daily_counts,
    daily_counts_by_key,
    date_bounds,
    min_date,
    date_spine,
    densify_daily,
    densify_by_key,
    densify_by_key_global,
    densify_hourly,
    densify_monthly,
    series_stats_weekly_global,
    series_stats_quarterly,
    combined_series_monthly,
    crossing_month_by_key,
    series_stats,
    series_stats_by_key,
    series_stats_by_key_global,
    sql_passthrough,
    series_vectors,
    listing_sorted,
    tabular_view,
    threshold_day,
    threshold_day_by_key,
    zero_counts_global,
    running_total_by_key,
    running_total_rows,
    running_total_rows_by_key,
    running_total_peers,
    poisson_fit,
    poisson_fit_distributed,
    crossing_date_distributed,
    poisson_fit_by_key,
    poisson_fit_distributed_by_key,
    poisson_fit_by_user,
    forecast_until,
    forecast_by_key,
    apply_series_by_key,
    crossing_date,
    crossing_date_by_key,
    actual_series,
    predicted_series,
    combined_series,
    combined_series_by_key,
    forecast_status_by_key,
    chart_series,
    sql_by_name,
    vectors_roundtrip,
    vectors_chunked,
    apply_series_nested,
    apply_series_chunks_by_key,
    record_map,
    ingest_nested,
    ingest_large_documents,
    ingest_date_forms,
    date_quality,
    bad_dates,
    json_key_profile,
    json_quality,
    first_wins,
    first_wins_map,
    first_wins_map_parts,
    strict_cast,
    strict_cast_vectors,
    read_range,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: dense daily statistics of the orders."""
    return series_stats(spark, FLAGSHIP_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {query.__name__: query for query in QUERIES}
    if llm is not None:
        named |= llm.queries()
    if corpus_pipeline is not None:
        named["pipeline"] = corpus_pipeline.run
    return named


# --- oracles (DuckDB) -----------------------------------------------------------


def _stats_sql(source: str, time_col: str, key: str | None = None, whole_range: bool = False, grain: str = "day") -> str:
    """CTEs ending in ``s(key, date, n, csum, x)``: spine, left join, window."""
    k, group = (f"{key} AS k", "GROUP BY 1, 2") if key else ("0 AS k", "GROUP BY 1, 2")
    kind = "TIMESTAMP" if grain == "hour" else "DATE"
    step = "3 months" if grain == "quarter" else f"1 {grain}"
    bounds = "SELECT k, min(d) AS lo, max(d) AS hi FROM c GROUP BY k"
    if whole_range:
        bounds = "SELECT k, (SELECT min(d) FROM c) AS lo, (SELECT max(d) FROM c) AS hi FROM c GROUP BY k"
    return f"""
    c AS (SELECT {k}, CAST(date_trunc('{grain}', {time_col}) AS {kind}) AS d, count(*) AS n FROM {source} {group}),
    b AS ({bounds}),
    spine AS (SELECT k, lo, CAST(unnest(generate_series(lo, hi, INTERVAL '{step}')) AS {kind}) AS d FROM b),
    s AS (SELECT spine.k, spine.d AS date, coalesce(c.n, 0) AS n,
                 CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY spine.k ORDER BY spine.d) AS BIGINT) AS csum,
                 datediff('{grain}', spine.lo, spine.d) AS x
          FROM spine LEFT JOIN c ON c.k = spine.k AND c.d = spine.d)"""


def _fit_sql(stats: str, goal: str = "2 * max(y)") -> str:
    """Add ``m(k, b0, b1)`` by Newton steps and ``f``: the forecast offsets."""
    return f"""WITH RECURSIVE {stats},
    p AS (SELECT k, CAST(x AS DOUBLE) AS x, CAST(csum AS DOUBLE) AS y FROM s),
    fit(i, k, b0, b1) AS (
      SELECT 0, k, ln(avg(y)), CAST(0 AS DOUBLE) FROM p GROUP BY k
      UNION ALL
      SELECT i + 1, k,
             b0 + CASE WHEN s0 * s2 - s1 * s1 > 1e-9 THEN (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1) ELSE 0 END,
             b1 + CASE WHEN s0 * s2 - s1 * s1 > 1e-9 THEN (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) ELSE 0 END
      FROM (SELECT i, k, b0, b1, sum(mu) AS s0, sum(mu * x) AS s1, sum(mu * x * x) AS s2,
                   sum(y - mu) AS g0, sum((y - mu) * x) AS g1
            FROM (SELECT i, fit.k, b0, b1, x, y, exp(b0 + b1 * x) AS mu
                  FROM fit JOIN p ON p.k = fit.k WHERE i < 15)
            GROUP BY i, k, b0, b1)),
    m AS (SELECT k, b0, b1 FROM fit WHERE i = 15),
    t AS (SELECT k, max(x) AS mx, {goal} AS goal, min(date) AS lo, count(*) AS n_points
          FROM (SELECT k, CAST(x AS DOUBLE) AS x, CAST(csum AS DOUBLE) AS y, date FROM s) GROUP BY k),
    h AS (SELECT m.k, b0, b1, lo, n_points, mx + 1 AS first_x,
                 CAST(greatest(mx + 1, ceil((ln(goal) - b0) / b1)) AS BIGINT) AS last_x
          FROM m JOIN t ON m.k = t.k),
    f AS (SELECT k, b0, b1, lo, unnest(generate_series(CAST(first_x AS BIGINT), last_x)) AS x FROM h)
    """


ORDER_STATS = _stats_sql("orders", "o_orderdate")
MONTH_STATS = _stats_sql("orders", "o_orderdate", grain="month")
STATUS_MONTHS = _stats_sql("orders", "o_orderdate", "o_orderstatus", grain="month")
USER_STATS = _stats_sql("events", "ts", "user_id")
TYPE_STATS = _stats_sql("events", "ts", "event_type")
FIXED_GOAL = """CASE k WHEN 'click' THEN 1 WHEN 'error' THEN 50000 ELSE 2 * max(y) END"""
STATS_COLUMNS = "date, n AS filled_daily_count, csum AS running_cumulative_sum, x AS days_elapsed"
PREDICTION = "round(exp(b0 + b1 * x), 2)"
ACTUAL_ROWS = "date AS day, CAST(csum AS DOUBLE) AS tagCount, 'Actual Count' AS valueType FROM s"
PREDICTED_ROWS = (
    f"CAST(lo + CAST(x AS INTEGER) AS DATE) AS day, {PREDICTION} AS tagCount, 'Predicted' AS valueType FROM f"
)
CROSSING = """CASE WHEN last_x = first_x THEN 'already_past' ELSE 'reached' END AS status,
    last_x AS last_day, CAST(lo + CAST(last_x AS INTEGER) AS DATE) AS crossing_date,
    strftime(lo + CAST(last_x AS INTEGER), '%a %b %d %Y') AS crossing_text FROM h"""
FIRST_VALUES = """
    SELECT user_id, event_type, value FROM (
      SELECT user_id, event_type, value,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)
    WHERE r = 1"""
KEY_KIND = """CASE json_type(props, '$.' || key) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
    WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"""


def oracle_sql() -> dict[str, str]:
    named = SQL | (llm.oracle_sql() if llm is not None else {})
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        named["pipeline"] = corpus_pipeline.ORACLE_SQL
    return named


SQL = {
    "daily_counts": """
        SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS daily_count FROM orders GROUP BY 1""",
    "daily_counts_by_key": """
        SELECT user_id, event_type, CAST(ts AS DATE) AS date, count(*) AS daily_count
        FROM events GROUP BY 1, 2, 3""",
    "date_bounds": """
        SELECT CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
        FROM orders""",
    "min_date": "SELECT CAST(min(o_orderdate) AS DATE) AS min_date FROM orders",
    "date_spine": f"WITH {ORDER_STATS} SELECT d AS date FROM spine",
    "densify_daily": f"WITH {ORDER_STATS} SELECT date, n AS daily_count FROM s",
    "densify_by_key": f"WITH {USER_STATS} SELECT k AS user_id, date, n AS daily_count FROM s",
    "densify_by_key_global": """
        WITH c AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, count(*) AS n
                   FROM events GROUP BY 1, 2, 3),
        spine AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL '1 day')) AS DATE) AS d FROM c),
        keys AS (SELECT DISTINCT user_id, event_type FROM c)
        SELECT keys.user_id, keys.event_type, spine.d AS date, coalesce(n, 0) AS daily_count
        FROM keys CROSS JOIN spine
        LEFT JOIN c ON c.user_id = keys.user_id AND c.event_type = keys.event_type AND c.d = spine.d""",
    "densify_hourly": f"""
        WITH {_stats_sql("events", "ts", "user_id", grain="hour")}
        SELECT k AS user_id, date, n AS daily_count FROM s""",
    "densify_monthly": f"""
        WITH {_stats_sql("orders", "o_orderdate", "o_custkey", grain="month")}
        SELECT k AS o_custkey, date, n AS daily_count FROM s""",
    "series_stats_weekly_global": f"""
        WITH {_stats_sql("orders", "o_orderdate", "o_custkey", whole_range=True, grain="week")}
        SELECT k AS o_custkey, {STATS_COLUMNS} FROM s""",
    "series_stats_quarterly": f"""
        WITH {_stats_sql("orders", "o_orderdate", grain="quarter")} SELECT {STATS_COLUMNS} FROM s""",
    "combined_series_monthly": f"""{_fit_sql(MONTH_STATS)}
        SELECT {ACTUAL_ROWS} UNION ALL
        SELECT CAST(lo + to_months(CAST(x AS INTEGER)) AS DATE), {PREDICTION}, 'Predicted' FROM f""",
    "crossing_month_by_key": f"""{_fit_sql(STATUS_MONTHS)}
        SELECT k AS o_orderstatus, CASE WHEN last_x = first_x THEN 'already_past' ELSE 'reached' END AS status,
               last_x AS last_day, CAST(lo + to_months(CAST(last_x AS INTEGER)) AS DATE) AS crossing_date,
               strftime(lo + to_months(CAST(last_x AS INTEGER)), '%a %b %d %Y') AS crossing_text FROM h""",
    "series_stats": f"WITH {ORDER_STATS} SELECT {STATS_COLUMNS} FROM s",
    "series_stats_by_key": f"WITH {USER_STATS} SELECT k AS user_id, {STATS_COLUMNS} FROM s",
    "series_stats_by_key_global": f"""
        WITH {_stats_sql("events", "ts", "user_id", whole_range=True)}
        SELECT k AS user_id, {STATS_COLUMNS} FROM s""",
    "sql_passthrough": f"WITH {ORDER_STATS} SELECT {STATS_COLUMNS} FROM s",
    "series_vectors": f"WITH {ORDER_STATS} SELECT x AS days_elapsed, csum FROM s",
    "listing_sorted": """
        SELECT o_orderkey AS slug, strftime(o_orderdate, '%Y-%m-%d') AS created_at
        FROM orders ORDER BY created_at, slug""",
    "tabular_view": f"""
        WITH {ORDER_STATS}
        SELECT CAST(date AS VARCHAR) AS date, CAST(n AS VARCHAR) AS filled_daily_count,
               CAST(csum AS VARCHAR) AS running_cumulative_sum, CAST(x AS VARCHAR) AS days_elapsed
        FROM s ORDER BY s.date""",
    "threshold_day": f"""
        WITH {ORDER_STATS}
        SELECT min(date) AS day FROM s WHERE csum >= (SELECT max(csum) / 2.0 FROM s)""",
    "threshold_day_by_key": f"""
        WITH {TYPE_STATS}
        SELECT s.k AS event_type, min(date) AS day
        FROM s JOIN (SELECT k, max(csum) AS total FROM s GROUP BY k) w ON w.k = s.k
        WHERE csum >= total / 2.0 GROUP BY 1""",
    "running_total_by_key": f"""
        WITH {USER_STATS}
        SELECT k AS user_id, date, n AS daily_count, csum AS running_cumulative_sum, x AS days_elapsed
        FROM s WHERE n > 0""",
    "running_total_rows": """
        SELECT o_orderkey, o_orderdate,
               CAST(count(*) OVER (ORDER BY o_orderdate, o_orderkey
                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total
        FROM orders""",
    "running_total_rows_by_key": """
        SELECT event_id, event_type, ts, cents,
               CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY ts, event_id
                                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total
        FROM (SELECT event_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""",
    "running_total_peers": """
        SELECT o_orderkey, o_orderstatus, o_orderdate,
               count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS running_total
        FROM orders""",
    "poisson_fit": f"""{_fit_sql(ORDER_STATS)}
        SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope, n_points FROM h""",
    "poisson_fit_distributed": f"""{_fit_sql(ORDER_STATS)}
        SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope FROM h""",
    "poisson_fit_by_key": f"""{_fit_sql(TYPE_STATS)}
        SELECT k AS event_type, round(b0, 6) AS intercept, round(b1, 6) AS slope, n_points FROM h""",
    "poisson_fit_distributed_by_key": f"""{_fit_sql(TYPE_STATS)}
        SELECT k AS event_type, round(b0, 6) AS intercept, round(b1, 6) AS slope, n_points FROM h""",
    "poisson_fit_by_user": f"""{_fit_sql(USER_STATS)}
        SELECT k AS user_id, round(b0, 6) AS intercept, round(b1, 6) AS slope, n_points FROM h""",
    "forecast_until": f"""{_fit_sql(ORDER_STATS)}
        SELECT f.x AS days_elapsed, round(exp(f.b0 + f.b1 * f.x), 2) AS tagCount,
               CASE WHEN last_x = first_x THEN 'already_past' ELSE 'reached' END AS status
        FROM f JOIN h ON f.k = h.k""",
    "forecast_by_key": f"""{_fit_sql(TYPE_STATS)}
        SELECT k AS event_type, x AS days_elapsed, {PREDICTION} AS tagCount FROM f""",
    "apply_series_by_key": f"""{_fit_sql(TYPE_STATS)}
        SELECT k AS event_type, x AS days_elapsed, {PREDICTION} AS tagCount FROM f""",
    "crossing_date": f"{_fit_sql(ORDER_STATS)} SELECT {CROSSING}",
    "crossing_date_by_key": f"{_fit_sql(TYPE_STATS)} SELECT k AS event_type, {CROSSING}",
    "crossing_date_distributed": f"{_fit_sql(ORDER_STATS)} SELECT {CROSSING}",
    "forecast_status_by_key": f"""{_fit_sql(TYPE_STATS, FIXED_GOAL)}
        SELECT k AS event_type,
               CASE WHEN k = 'view' THEN 'beyond_calendar'
                    WHEN last_x = first_x THEN 'already_past' ELSE 'reached' END AS status,
               CASE WHEN k = 'view' THEN 0 ELSE CAST(last_x - first_x + 1 AS BIGINT) END AS n_rows FROM h""",
    "chart_series": f"""{_fit_sql(TYPE_STATS)}
        SELECT k AS event_type, {ACTUAL_ROWS} UNION ALL SELECT k, {PREDICTED_ROWS}
        ORDER BY event_type, valueType, day""",
    "sql_by_name": f"WITH {ORDER_STATS} SELECT {STATS_COLUMNS} FROM s",
    "zero_counts_global": """
        WITH c AS (SELECT user_id AS k, CAST(ts AS DATE) AS d,
                          sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n FROM events GROUP BY ALL),
        spine AS (SELECT k, lo, CAST(unnest(generate_series(lo, hi, INTERVAL '1 day')) AS DATE) AS d
                  FROM (SELECT DISTINCT k FROM c), (SELECT min(d) AS lo, max(d) AS hi FROM c))
        SELECT spine.k AS user_id, spine.d AS date, CAST(coalesce(n, 0) AS BIGINT) AS filled_daily_count,
               CAST(sum(coalesce(n, 0)) OVER (PARTITION BY spine.k ORDER BY spine.d) AS BIGINT) AS running_cumulative_sum,
               datediff('day', lo, spine.d) AS days_elapsed
        FROM spine LEFT JOIN c ON c.k = spine.k AND c.d = spine.d""",
    "ingest_date_forms": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS created_at FROM orders",
    "json_quality": """
        SELECT event_type, count(*) AS n_rows, count(*) - count(p) AS n_null,
               count(CASE WHEN NOT json_valid(p) THEN 1 END) AS n_bad,
               count(CASE WHEN json_valid(p) AND json_type(CASE WHEN json_valid(p) THEN p END) <> 'OBJECT' THEN 1 END) AS n_other
        FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS p FROM events)
        GROUP BY 1""",
    "actual_series": f"WITH {ORDER_STATS} SELECT {ACTUAL_ROWS}",
    "predicted_series": f"{_fit_sql(ORDER_STATS)} SELECT {PREDICTED_ROWS}",
    "combined_series": f"""{_fit_sql(ORDER_STATS)}
        SELECT {ACTUAL_ROWS} UNION ALL SELECT {PREDICTED_ROWS}""",
    "combined_series_by_key": f"""{_fit_sql(TYPE_STATS)}
        SELECT k AS event_type, {ACTUAL_ROWS} UNION ALL SELECT k, {PREDICTED_ROWS}""",
    "vectors_roundtrip": f"""
        WITH {USER_STATS} SELECT k AS user_id, x AS days_elapsed, csum AS running_cumulative_sum FROM s""",
    "vectors_chunked": f"""
        WITH {USER_STATS} SELECT k AS user_id, x AS days_elapsed, csum AS running_cumulative_sum FROM s""",
    "apply_series_nested": f"""
        WITH {USER_STATS}
        SELECT k AS user_id, x AS days,
               round(n / nullif(lag(n) OVER (PARTITION BY k ORDER BY date), 0), 6) AS growth FROM s""",
    "apply_series_chunks_by_key": """
        SELECT event_type, event_id,
               CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total
        FROM (SELECT event_id, event_type, ts, coalesce(CAST(round(value * 100) AS BIGINT), 0) AS cents FROM events)""",
    "record_map": """
        SELECT o_orderkey, 'o_orderstatus' AS name, o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
        UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders""",
    "ingest_nested": """
        SELECT CAST(o_orderkey AS VARCHAR) AS slug, CAST(o_orderdate AS DATE) AS created_at FROM orders
        UNION ALL SELECT o_orderkey || '-status', NULL FROM orders""",
    "ingest_large_documents": """
        SELECT CAST(o_orderkey AS VARCHAR) AS slug, CAST(o_orderdate AS DATE) AS created_at FROM orders
        UNION ALL SELECT o_orderkey || '-status', NULL FROM orders""",
    "date_quality": """
        SELECT 2 * count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, count(*) AS n_bad FROM orders""",
    "bad_dates": "SELECT o_orderkey || '-status' AS slug, o_orderstatus AS created_at FROM orders",
    "json_key_profile": f"""
        SELECT event_type, key, {KEY_KIND} AS kind, count(*) AS n_rows,
               CAST(min(CASE json_type(props, '$.' || key)
                   WHEN 'OBJECT' THEN len(json_keys(props, '$.' || key))
                   WHEN 'ARRAY' THEN json_array_length(props, '$.' || key) END) AS BIGINT) AS min_size,
               CAST(max(CASE json_type(props, '$.' || key)
                   WHEN 'OBJECT' THEN len(json_keys(props, '$.' || key))
                   WHEN 'ARRAY' THEN json_array_length(props, '$.' || key) END) AS BIGINT) AS max_size
        FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events)
        GROUP BY 1, 2, 3""",
    "first_wins": FIRST_VALUES,
    "first_wins_map": FIRST_VALUES,
    "first_wins_map_parts": FIRST_VALUES,
    "strict_cast_vectors": """
        SELECT o_custkey, CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice > 100000 AS is_large, o_orderpriority
        FROM orders""",
    "strict_cast": """
        SELECT o_orderkey, CAST(o_totalprice > 100000 AS DOUBLE) AS is_large,
               CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderpriority FROM orders""",
    "read_range": f"WITH {ORDER_STATS} SELECT {STATS_COLUMNS} FROM s",
}
