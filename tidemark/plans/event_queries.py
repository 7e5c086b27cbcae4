"""Registered queries over the test tables, and the SQL that each must agree with."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import ctr
from tidemark.operators import enrich, panes, repeat, windows
from tidemark.sources import sinks, tables

FIXED = "6 hours"
SLIDING, PERIOD = "2 days", "6 hours"
TO_CLICK, TO_IMPRESSION = "48 hours", "12 hours"
LATENESS = "12 hours"
REPEAT_EVERY, REPEAT_FOR = "12 hours", "2 days"
CACHE_FOR = "6 hours"
BATCH = 250
PUBLISHED = 100.0  # the value of a sign-up that publishes, in the query of views without a publication


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.ad_events(_events(spark, sf_dir))


def _known_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.ad_events(_events(spark, sf_dir), known=True)


def _user_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.ad_events(_events(spark, sf_dir), screens=None)


def _arrived(df: DataFrame) -> DataFrame:
    """Every eleventh event comes two batches late."""
    late = F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)
    return panes.with_arrival(df, (F.floor(F.col("event_id") / BATCH) + late).cast("int"))


def ad_event_to_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctr.to_ctr(_ads(spark, sf_dir)).select("event_id", "ad_id", "screen_id", "clicks", "impressions")


def fixed_window_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fixed_window_ctr(_ads(spark, sf_dir), FIXED)


def sliding_window_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_window_ctr(fixed_window_ctr(spark, sf_dir), SLIDING, PERIOD)


def custom_window_ctr_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.custom_window_ctr(_known_ads(spark, sf_dir), TO_CLICK, TO_IMPRESSION)


def custom_window_ctr_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.custom_window_ctr_live(_known_ads(spark, sf_dir), TO_CLICK, TO_IMPRESSION)


def fixed_window_ctr_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.fixed_window_panes(_arrived(_ads(spark, sf_dir)), FIXED, LATENESS)


def sliding_window_ctr_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.sliding_window_panes(_arrived(ctr.to_ctr(_ads(spark, sf_dir))), SLIDING, PERIOD, LATENESS)


def latest_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctr.latest(model.publications(_events(spark, sf_dir)), ["publication_id"], "event_time", "event_id").select("publication_id", "version", "event_time")


def _by_latest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir)
    return enrich.enrich_by_latest(model.screens_of_views(e), model.publications(e))


def broadcast_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_latest(spark, sf_dir)[0].select("screen_id", "publication_id", "version", "event_time")


def broadcast_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of users whose sign-ups, all of them, were worth little: only others publish here."""
    e = _events(spark, sf_dir)
    published = model.publications(e.where(F.col("value") > PUBLISHED))
    return enrich.enrich_by_latest(model.screens_of_views(e), published)[1].select("screen_id", "publication_id", "event_time")


def repeat_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat.repeat(model.screens_of_signups(_events(spark, sf_dir)), "screen_id", "publication_id", REPEAT_EVERY, REPEAT_FOR)


def _by_repeater(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return enrich.enrich_by_repeater(_user_ads(spark, sf_dir), model.screens_of_signups(_events(spark, sf_dir)), REPEAT_EVERY, REPEAT_FOR)


def repeater_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_repeater(spark, sf_dir)[0]


def repeater_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_repeater(spark, sf_dir)[1]


def windowed_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_in_window(_user_ads(spark, sf_dir), model.screens_of_signups(_events(spark, sf_dir)), SLIDING)[0]


def windowed_left_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_in_window(_user_ads(spark, sf_dir), model.screens_of_signups(_events(spark, sf_dir)), SLIDING)[1]


def _by_cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir)
    return enrich.enrich_by_cache(model.screens_of_views(e), model.publications(e), CACHE_FOR)


def lookup_cache_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_cache(spark, sf_dir)[0]


def lookup_cache_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_cache(spark, sf_dir)[1]


def co_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    both = enrich.co_group(model.screens_of_views(e), model.publications(e), "publication_id")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{c}")
    return both.select("publication_id", size("left_rows"), size("right_rows"))


def co_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    left, right = model.screens_of_views(e).select("publication_id", "event_time", "event_id"), model.publications(e).select("publication_id", "event_time", "event_id")
    ids = lambda c: F.concat_ws(",", F.transform(F.coalesce(c, F.array()), lambda x: x["event_id"].cast("string"))).alias(c)
    return enrich.co_group(left, right, "publication_id").select("publication_id", ids("left_rows"), ids("right_rows"))


def max_instant_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(ctr.max_instant("ts").alias("max_ts"))


def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_table(table(spark, sf_dir, "customer"))


def scan_filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_query(spark, "SELECT c_custkey, c_name, c_nationkey FROM {customer} WHERE c_name LIKE '%9%'", customer=table(spark, sf_dir, "customer"))


def scan_row_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_table(table(spark, sf_dir, "part"), restriction="p_name LIKE '%9%' OR p_size > 40", columns=["p_partkey", "p_name", "p_size"])


def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count(scan_filter_like(spark, sf_dir))


_made: list[tuple[SparkSession, str]] = []


def _new_table(spark: SparkSession, schema) -> str:
    """A table of this run alone; it goes when the program ends."""
    name = f"tidemark_{uuid.uuid4().hex}"
    sinks.ensure_table(spark, name, schema)
    _made.append((spark, name))
    return name


@atexit.register
def _drop() -> None:
    for spark, name in _made:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sinks off one input."""
    to = _new_table(spark, model.RECORD)
    sinks.write_all(tables.generate_records(spark), [lambda df: sinks.write_table(df, to)] * 2)
    return tables.scan_table(to, spark).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


def write_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a table after each write of all customers: added to it while empty, added again, put in place of all."""
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    to = _new_table(spark, own.schema)
    out = []
    for n, how in enumerate((sinks.EMPTY, sinks.APPEND, sinks.TRUNCATE)):
        sinks.write_table(own, to, how)
        out.append((n, how, spark.table(to).count()))
    return spark.createDataFrame(out, "step int, disposition string, n long")


def typed_record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tables.generate_records(spark)
    """Through two tables: one of the row format with a map, one of pairs."""
    as_map, pairs = _new_table(spark, model.MAP_RECORD), _new_table(spark, model.RECORD)
    sinks.write_table(records.withColumn("attributes", tables.pairs_to_map("attributes")), as_map, sinks.EMPTY)
    sinks.write_table(spark.table(as_map).withColumn("attributes", tables.map_to_pairs("attributes")), pairs)
    back = tables.scan_table(pairs, spark)
    return back.select("id", F.col("timestamp").cast("timestamp_ntz").alias("at"), "name", "description", F.explode("attributes").alias("a")).select("id", "at", "name", "description", "a.key", "a.value")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.print_sample(scan_full(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ad_event_to_ctr, fixed_window_ctr, sliding_window_ctr, custom_window_ctr_bounded, custom_window_ctr_live, fixed_window_ctr_panes, sliding_window_ctr_panes, latest_publication, broadcast_enriched, broadcast_dlq,
        repeat_emissions, repeater_enriched, repeater_dlq, windowed_left_join, windowed_left_dlq, lookup_cache_enriched, lookup_cache_dlq, co_group_sizes, co_group_rows, max_instant_by_key, scan_full, scan_filter_like, scan_row_restriction, count_records,
        typed_record_roundtrip, written_twice, write_dispositions, sample,
    )
}

MS = "INTERVAL 1 MILLISECOND"
_AD = """ad AS (SELECT event_id, ts AS event_time, props->>'$.k' AS ad_id, CAST(user_id {screen} AS VARCHAR) AS screen_id,
  CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'Impression' ELSE 'Unknown' END AS action,
  CAST(event_type = 'click' AS INTEGER) AS clicks, CAST(event_type = 'view' AS INTEGER) AS impressions FROM events)"""
AD, USER_AD = _AD.format(screen="% 10"), _AD.format(screen="")


def bucket(width: str, t: str) -> str:
    return f"time_bucket(INTERVAL '{width}', {t}, TIMESTAMP '1970-01-01')"


_FIXED = f"""fixed AS (SELECT screen_id, ad_id, CAST(max(clicks) AS INTEGER) AS clicks, CAST(max(impressions) AS INTEGER) AS impressions, {bucket(FIXED, 'event_time')} AS window_start
  FROM ad GROUP BY ALL)"""
_COPIES = model.millis(SLIDING) // model.millis(PERIOD)
_LATEST = "latest AS (SELECT CAST(user_id AS VARCHAR) AS publication_id, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS version, max(ts) AS event_time FROM events WHERE event_type = 'signup' GROUP BY 1)"
_VIEWS = "views AS (SELECT ts AS event_time, CAST(event_id AS VARCHAR) AS screen_id, CAST(user_id AS VARCHAR) AS publication_id, event_id FROM events WHERE event_type = 'view')"
_ARRIVED = f"""b AS (SELECT *, CAST(event_id // {BATCH} + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS INTEGER) AS batch_id FROM ad),
 m AS (SELECT batch_id, max(max(event_time)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM b GROUP BY batch_id),
 arrived AS (SELECT b.*, m.watermark FROM b JOIN m USING (batch_id))"""


def _panes(windowed: str, length: str, merge: str) -> str:
    return f"""{windowed},
 p AS (SELECT screen_id, ad_id, s, CASE WHEN watermark IS NULL OR watermark <= s + INTERVAL '{length}' - {MS} THEN NULL ELSE batch_id END AS pb, {merge}(clicks) AS c, {merge}(impressions) AS i FROM w
  WHERE watermark IS NULL OR watermark <= s + INTERVAL '{length}' - {MS} + INTERVAL '{LATENESS}' GROUP BY ALL)
SELECT screen_id, ad_id, CAST({merge}(c) OVER o AS INTEGER) AS clicks, CAST({merge}(i) OVER o AS INTEGER) AS impressions, s AS window_start, s + INTERVAL '{length}' AS window_end, s + INTERVAL '{length}' - {MS} AS event_time,
  CASE WHEN pb IS NULL THEN 'ON_TIME' ELSE 'LATE' END AS pane_timing, CAST(row_number() OVER o - 1 AS INTEGER) AS pane_index
FROM p WINDOW o AS (PARTITION BY screen_id, ad_id, s ORDER BY pb NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


_REPEAT = f"""v AS (SELECT CAST(user_id AS VARCHAR) AS k, epoch_us(ts) // 1000 AS t, CAST(event_id AS VARCHAR) AS val, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'signup'),
 f AS (SELECT k, rn, t AS seen, val AS held, t + {model.millis(REPEAT_EVERY)} AS tick, t AS out_t, val AS out_v FROM v WHERE rn = 1
  UNION ALL
  SELECT k, CASE WHEN el THEN nrn ELSE rn END, CASE WHEN el THEN nt ELSE seen END, CASE WHEN el THEN nv ELSE held END,
   CASE WHEN el THEN coalesce(tick, nt + {model.millis(REPEAT_EVERY)}) WHEN tick < seen + {model.millis(REPEAT_FOR)} THEN tick + {model.millis(REPEAT_EVERY)} END,
   CASE WHEN NOT el THEN tick WHEN tick IS NULL THEN nt END, CASE WHEN el THEN nv ELSE held END
  FROM (SELECT f.*, n.rn AS nrn, n.t AS nt, n.val AS nv, n.t IS NOT NULL AND (f.tick IS NULL OR n.t <= f.tick) AS el FROM f LEFT JOIN v n ON n.k = f.k AND n.rn = f.rn + 1)
  WHERE tick IS NOT NULL OR nt IS NOT NULL),
 r AS (SELECT k AS screen_id, out_v AS publication_id, epoch_ms(CAST(out_t AS BIGINT)) AS event_time FROM f WHERE out_t IS NOT NULL)"""


def _windowed(right: str, width: str) -> str:
    return f"""l AS (SELECT screen_id, ad_id, action, {bucket(width, 'event_time')} AS s FROM ad),
 j AS (SELECT l.*, x.publication_id FROM l LEFT JOIN (SELECT screen_id, publication_id, {bucket(width, 'event_time')} AS s FROM {right}) x USING (screen_id, s))"""


def _window_columns(width: str) -> str:
    return f"s AS window_start, s + INTERVAL '{width}' AS window_end, s + INTERVAL '{width}' - {MS} AS event_time"


_SIGNUPS = "signups AS (SELECT ts AS event_time, CAST(user_id AS VARCHAR) AS screen_id, CAST(event_id AS VARCHAR) AS publication_id FROM events WHERE event_type = 'signup')"
_CACHE = f"""u AS (SELECT CAST(user_id AS VARCHAR) AS k, ts AS t, event_id, event_type = 'view' AS is_left, CASE WHEN event_type = 'signup' THEN {{'v': CAST(event_id AS VARCHAR), 't': ts}} END AS found FROM events WHERE event_type IN ('view', 'signup')),
 g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t > lag(t) OVER w + INTERVAL '{CACHE_FOR}' THEN 1 ELSE 0 END AS fresh FROM u WINDOW w AS (PARTITION BY k ORDER BY t, event_id)),
 h AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
 x AS (SELECT *, last_value(found IGNORE NULLS) OVER (PARTITION BY k, sid ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS past,
  first_value(found IGNORE NULLS) OVER (PARTITION BY k, sid ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next, max(t) OVER (PARTITION BY k, sid) AS mx FROM h)"""
_C, _I = model.millis(TO_CLICK), model.millis(TO_IMPRESSION)
_LEN = f"CASE WHEN e.click THEN {_I} ELSE {_C} END"

ORACLE_SQL: dict[str, str] = {
    "ad_event_to_ctr": f"WITH {AD} SELECT event_id, ad_id, screen_id, clicks, impressions FROM ad",
    "fixed_window_ctr": f"WITH {AD}, {_FIXED} SELECT screen_id, ad_id, clicks, impressions, window_start, window_start + INTERVAL '{FIXED}' AS window_end, window_start + INTERVAL '{FIXED}' - {MS} AS event_time FROM fixed",
    "sliding_window_ctr": f"""WITH {AD}, {_FIXED}, w AS (SELECT screen_id, ad_id, clicks, impressions, {bucket(PERIOD, f"window_start + INTERVAL '{FIXED}' - {MS}")} - r.k * INTERVAL '{PERIOD}' AS s FROM fixed, range({_COPIES}) r(k))
SELECT screen_id, ad_id, CAST(sum(clicks) AS INTEGER) AS clicks, CAST(sum(impressions) AS INTEGER) AS impressions, s AS window_start, s + INTERVAL '{SLIDING}' AS window_end, s + INTERVAL '{SLIDING}' - {MS} AS event_time,
 {bucket(PERIOD, f"s + INTERVAL '{SLIDING}' - {MS}")} AS pane_start, {bucket(PERIOD, f"s + INTERVAL '{SLIDING}' - {MS}")} + INTERVAL '{PERIOD}' AS pane_end FROM w GROUP BY screen_id, ad_id, s""",
    "custom_window_ctr_bounded": f"""WITH {AD}, g AS (SELECT screen_id, ad_id, max(clicks) AS clicks, max(impressions) AS impressions, min(event_time) AS s, max(event_time) AS l, count(DISTINCT (event_time, clicks)) AS n FROM ad WHERE action <> 'Unknown' GROUP BY ALL)
SELECT screen_id, ad_id, CAST(clicks AS INTEGER) AS clicks, CAST(impressions AS INTEGER) AS impressions, s AS window_start,
 CASE WHEN clicks = 0 THEN l + INTERVAL '{TO_CLICK}' - {MS} WHEN n = 1 THEN l + INTERVAL '{TO_IMPRESSION}' - {MS} ELSE l END AS event_time FROM g""",
    "custom_window_ctr_live": f"""WITH RECURSIVE {AD}, e AS (SELECT screen_id, ad_id, epoch_us(event_time) // 1000 AS t, action = 'Click' AS click, row_number() OVER (PARTITION BY screen_id, ad_id ORDER BY event_time, event_id) AS rn FROM ad WHERE action <> 'Unknown'),
 f AS (SELECT screen_id, ad_id, rn, 1 AS w, t AS s, t + {_LEN} - 1 AS en, click AS clk, CAST(click AS INTEGER) AS c, CAST(NOT click AS INTEGER) AS i FROM e WHERE rn = 1
  UNION ALL
  SELECT e.screen_id, e.ad_id, e.rn, CASE WHEN f.en < e.t THEN f.w + 1 ELSE f.w END, CASE WHEN f.en < e.t THEN e.t ELSE f.s END,
   CASE WHEN f.en < e.t THEN e.t + {_LEN} - 1 WHEN f.s = e.t AND f.en = e.t + {_LEN} - 1 AND f.clk = e.click THEN f.en WHEN f.clk OR e.click THEN e.t ELSE greatest(f.en, e.t + {_LEN} - 1) END,
   CASE WHEN f.en < e.t THEN e.click ELSE f.clk OR e.click END,
   CASE WHEN f.en < e.t THEN CAST(e.click AS INTEGER) ELSE greatest(f.c, CAST(e.click AS INTEGER)) END, CASE WHEN f.en < e.t THEN CAST(NOT e.click AS INTEGER) ELSE greatest(f.i, CAST(NOT e.click AS INTEGER)) END
  FROM f JOIN e ON e.screen_id = f.screen_id AND e.ad_id = f.ad_id AND e.rn = f.rn + 1)
SELECT screen_id, ad_id, arg_max(c, rn) AS clicks, arg_max(i, rn) AS impressions, epoch_ms(CAST(arg_max(s, rn) AS BIGINT)) AS window_start, epoch_ms(CAST(arg_max(en, rn) AS BIGINT)) AS event_time FROM f GROUP BY screen_id, ad_id, w""",
    "fixed_window_ctr_panes": f"WITH {AD}, {_ARRIVED}, " + _panes(f"w AS (SELECT *, {bucket(FIXED, 'event_time')} AS s FROM arrived)", FIXED, "max"),
    "sliding_window_ctr_panes": f"WITH {AD}, {_ARRIVED}, " + _panes(f"w AS (SELECT a.*, {bucket(PERIOD, 'event_time')} - r.k * INTERVAL '{PERIOD}' AS s FROM arrived a, range({_COPIES}) r(k))", SLIDING, "sum"),
    "latest_publication": f"WITH {_LATEST} SELECT publication_id, version, event_time FROM latest",
    "broadcast_enriched": f"WITH {_LATEST}, {_VIEWS} SELECT v.screen_id, v.publication_id, l.version, v.event_time FROM views v JOIN latest l USING (publication_id)",
    "broadcast_dlq": f"WITH {_VIEWS} SELECT v.screen_id, v.publication_id, v.event_time FROM views v WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'signup' AND e.value > {PUBLISHED} AND CAST(e.user_id AS VARCHAR) = v.publication_id)",
    "repeat_emissions": f"WITH RECURSIVE {_REPEAT} SELECT screen_id, publication_id, event_time FROM r",
    "repeater_enriched": f"WITH RECURSIVE {USER_AD}, {_REPEAT}, {_windowed('r', REPEAT_EVERY)} SELECT screen_id, ad_id, action, publication_id, {_window_columns(REPEAT_EVERY)} FROM j WHERE publication_id IS NOT NULL",
    "repeater_dlq": f"WITH RECURSIVE {USER_AD}, {_REPEAT}, {_windowed('r', REPEAT_EVERY)} SELECT screen_id, ad_id, action, {_window_columns(REPEAT_EVERY)} FROM j WHERE publication_id IS NULL",
    "windowed_left_join": f"WITH {USER_AD}, {_SIGNUPS}, {_windowed('signups', SLIDING)} SELECT screen_id, ad_id, action, publication_id, {_window_columns(SLIDING)} FROM j WHERE publication_id IS NOT NULL",
    "windowed_left_dlq": f"WITH {USER_AD}, {_SIGNUPS}, {_windowed('signups', SLIDING)} SELECT screen_id, ad_id, action, {_window_columns(SLIDING)} FROM j WHERE publication_id IS NULL",
    "lookup_cache_enriched": f"WITH {_CACHE} SELECT k AS publication_id, CAST(event_id AS VARCHAR) AS screen_id, coalesce(past.v, next.v) AS version, CASE WHEN past IS NOT NULL THEN t ELSE next.t END AS event_time FROM x WHERE is_left AND (past IS NOT NULL OR next IS NOT NULL)",
    "lookup_cache_dlq": f"WITH {_CACHE} SELECT k AS publication_id, CAST(event_id AS VARCHAR) AS screen_id, mx AS event_time FROM x WHERE is_left AND past IS NULL AND next IS NULL",
    "co_group_sizes": "SELECT CAST(user_id AS VARCHAR) AS publication_id, count(*) FILTER (event_type = 'view') AS n_left_rows, count(*) FILTER (event_type = 'signup') AS n_right_rows FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1",
    "co_group_rows": """SELECT CAST(user_id AS VARCHAR) AS publication_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (event_type = 'view'), '') AS left_rows,
 coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (event_type = 'signup'), '') AS right_rows FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1""",
    "written_twice": "SELECT i AS id, 'some name ' || i AS name, CAST(2 AS BIGINT) AS n FROM range(1, 101) r(i)",
    "write_dispositions": "SELECT CAST(k AS INTEGER) AS step, ['empty', 'append', 'truncate'][k + 1] AS disposition, count(*) * [1, 2, 1][k + 1] AS n FROM customer, range(3) s(k) GROUP BY k",
    "max_instant_by_key": "SELECT user_id, greatest(max(ts), TIMESTAMP '1970-01-01') AS max_ts FROM events GROUP BY user_id",
    "scan_full": "SELECT * FROM customer",
    "scan_filter_like": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_name LIKE '%9%'",
    "scan_row_restriction": "SELECT p_partkey, p_name, p_size FROM part WHERE p_name LIKE '%9%' OR p_size > 40",
    "count_records": "SELECT count(*) AS count FROM customer WHERE c_name LIKE '%9%'",
    "typed_record_roundtrip": "SELECT i AS id, TIMESTAMP '2024-01-01' AS at, 'some name ' || i AS name, 'some description ' || i AS description, 'key ' || k AS key, 'value ' || i AS value FROM range(1, 101) r(i), range(1, 3) q(k)",
}
