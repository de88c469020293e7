"""Named queries over the test tables and the SQL that gives the same rows.

The test tables hold no instruments; orders stand in for them (customer: exchange, order priority: ticker, status F:
delisted, order date: creation), customers for exchanges, and events for ticks and for lifecycle requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import codes, settings
from tallyforge.operators import audits, lifecycle, market, reads, status
from tallyforge.sources.tables import table_of

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Literals that have rows in the smaller test tables.
CUSTOMER, PRIORITY, ORDER = 400, "3-MEDIUM", 7


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def instruments(spark: SparkSession, d: str) -> DataFrame:
    o = table_of(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", codes.DELISTED).otherwise(codes.LISTED)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("exchange_id"), F.col("o_orderpriority").alias("ticker"), state.alias("status"), F.col("o_orderdate").alias("created_at_utc"))


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    return table_of(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("code"), F.col("c_nationkey").alias("nation"))


_I = "(SELECT o_orderkey AS id, o_custkey AS exchange_id, o_orderpriority AS ticker, CAST(CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END AS INTEGER) AS status, o_orderdate AS created_at_utc FROM orders)"
_E = "(SELECT c_custkey AS id, c_name AS code, c_nationkey AS nation FROM customer)"
_HELD = f"exchange_id = {CUSTOMER} AND ticker = '{PRIORITY}'"


@_query("instrument_by_id", f"SELECT * FROM {_I} WHERE id = {ORDER}")
def _(s, d):
    return reads.by_id(instruments(s, d), ORDER)


@_query("active_by_ticker", f"SELECT * FROM {_I} WHERE {_HELD} AND status <> 3 ORDER BY id LIMIT 1")
def _(s, d):
    return reads.active_by_ticker(instruments(s, d), CUSTOMER, PRIORITY)


@_query("ticker_history", f"SELECT * FROM {_I} WHERE {_HELD} ORDER BY created_at_utc DESC, id DESC")
def _(s, d):
    return reads.ticker_history(instruments(s, d), CUSTOMER, PRIORITY)


@_query("ticker_is_taken", f"SELECT EXISTS (SELECT 1 FROM {_I} WHERE {_HELD} AND status <> 3) AS taken")
def _(s, d):
    one = s.createDataFrame([(CUSTOMER, PRIORITY)], "exchange_id bigint, ticker string")
    return reads.tickers_taken(one, instruments(s, d)).select("taken")


@_query("exchange_by_id", f"SELECT * FROM {_E} WHERE id = 85")
def _(s, d):
    return reads.by_id(exchanges(s, d), 85)


@_query("exchange_by_code", "SELECT c_custkey AS id, upper(substr(replace(c_name, '#', ''), 7)) AS code FROM customer WHERE upper(substr(replace(c_name, '#', ''), 7)) = 'ER000000085'")
def _(s, d):
    rows = exchanges(s, d).select("id", codes.exchange_code(F.substring(F.replace("code", F.lit("#"), F.lit("")), 7, 12)).alias("code"))
    return reads.exchange_by_code(rows, "  er000000085 ")


@_query("exchange_list", f"SELECT * FROM {_E} ORDER BY code")
def _(s, d):
    return reads.exchanges_listed(exchanges(s, d))


@_query("current_holder_all", f"SELECT exchange_id, ticker, min(id) AS id FROM {_I} WHERE status <> 3 GROUP BY ALL")
def _(s, d):
    return reads.current_holders(instruments(s, d))


@_query("taken_tickers_all", f"SELECT exchange_id, ticker, bool_or(status <> 3) AS taken FROM {_I} GROUP BY ALL")
def _(s, d):
    rows = instruments(s, d)
    return reads.tickers_taken(rows.select("exchange_id", "ticker").distinct(), rows)


@_query("ticker_history_all", f"SELECT *, CAST(row_number() OVER (PARTITION BY exchange_id, ticker ORDER BY created_at_utc DESC, id DESC) AS INTEGER) AS turn FROM {_I}")
def _(s, d):
    return reads.histories(instruments(s, d))


@_query("database_round_trip", """
SELECT 'orders' AS name, CASE WHEN EXISTS (SELECT 1 FROM orders) THEN 'Healthy' ELSE 'Unhealthy' END AS status UNION ALL SELECT 'customer', CASE WHEN EXISTS (SELECT 1 FROM customer) THEN 'Healthy' ELSE 'Unhealthy' END
UNION ALL SELECT 'late_events', CASE WHEN EXISTS (SELECT 1 FROM events WHERE ts > TIMESTAMP '2999-01-01') THEN 'Healthy' ELSE 'Unhealthy' END""")
def _(s, d):
    late = table_of(s, d, "events").filter("ts > TIMESTAMP_NTZ '2999-01-01'")
    return reads.answering({"orders": table_of(s, d, "orders"), "customer": table_of(s, d, "customer"), "late_events": late})


#: Kinds of events stand in for the checks of a service: their number is the time taken.
_CHECKS = """(SELECT name, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS place, CASE n % 3 WHEN 0 THEN 'Unhealthy' WHEN 1 THEN 'Degraded' ELSE 'Healthy' END AS status, CAST(n AS DOUBLE) AS duration,
 CASE WHEN n % 3 = 0 THEN 'no answer' END AS description, name <> 'click' AS ready FROM (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1))"""


def checks(s: SparkSession, d: str) -> DataFrame:
    n = table_of(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n") % 3 == 0, "Unhealthy").when(F.col("n") % 3 == 1, "Degraded").otherwise("Healthy")
    tags = F.when(F.col("name") != "click", F.array(F.lit("ready"))).otherwise(F.array(F.lit("live")))
    return n.select("name", F.col("name").alias("place"), state.alias("status"), F.col("n").cast("double").alias("duration_ms"), F.when(F.col("n") % 3 == 0, "no answer").alias("description"), tags.alias("tags"))


@_query("checks_by_tag", f"SELECT name, status FROM {_CHECKS} WHERE ready")
def _(s, d):
    return status.tagged(checks(s, d), "ready").select("name", "status")


@_query("status_report", f"""
SELECT '{{"status":"' || CASE min(CASE status WHEN 'Unhealthy' THEN 0 WHEN 'Degraded' THEN 1 ELSE 2 END) WHEN 0 THEN 'Unhealthy' WHEN 1 THEN 'Degraded' ELSE 'Healthy' END || '","totalDurationMs":' || sum(duration) || ',"checks":[' ||
 string_agg('{{"name":"' || name || '","status":"' || status || '","durationMs":' || duration || coalesce(',"description":"' || description || '"', '') || '}}', ',' ORDER BY place) || ']}}' AS json
FROM {_CHECKS} WHERE ready""")
def _(s, d):
    return status.report(status.tagged(checks(s, d), "ready"))


@_query("service_status", f"""
SELECT service, CASE status WHEN 'Healthy' THEN 'online' WHEN 'Degraded' THEN 'degraded' WHEN 'Unhealthy' THEN 'offline' ELSE 'unknown' END AS status, description AS detail
FROM (SELECT DISTINCT event_type AS service FROM events UNION SELECT 'queue') LEFT JOIN {_CHECKS} ON name = service""")
def _(s, d):
    made = status.report(checks(s, d)).withColumn("live", F.lit(True))
    names = ["queue", *sorted(r.event_type for r in table_of(s, d, "events").select("event_type").distinct().collect())]
    return status.services(status.parsed(made), names)


@_query("duplicate_ids", f"SELECT id, count(*) AS n FROM {_I} GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return audits.duplicates(instruments(s, d), "id")


@_query("orphan_instruments", f"SELECT * FROM {_I} i WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = i.exchange_id)")
def _(s, d):
    return audits.orphans(instruments(s, d), exchanges(s, d), "exchange_id")


@_query("referenced_exchanges", f"SELECT * FROM {_E} e WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = e.id)")
def _(s, d):
    return audits.referenced(exchanges(s, d), instruments(s, d), "exchange_id")


@_query("orphans_of_fewer_exchanges", f"SELECT * FROM {_I} i WHERE exchange_id % 7 = 0")
def _(s, d):
    return audits.orphans(instruments(s, d), exchanges(s, d).filter("id % 7 <> 0"), "exchange_id")


@_query("duplicate_exchange_codes", "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return audits.duplicates(exchanges(s, d), "nation")


@_query("active_ticker_conflicts", f"SELECT exchange_id, ticker, count(*) AS n FROM {_I} WHERE status <> 3 GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return audits.active_ticker_conflicts(instruments(s, d))


@_query("ticker_normalise", """
SELECT p_partkey, CASE WHEN regexp_full_match(b, '[A-Za-z0-9]{1,20}') THEN upper(b) END AS ticker,
       CASE WHEN regexp_full_match(b, '[A-Za-z0-9]{2,12}') THEN upper(b) END AS exchange_code,
       CASE WHEN regexp_full_match(c, '[A-Za-z]{3}') THEN upper(c) END AS currency,
       CASE WHEN regexp_full_match(m, '[A-Za-z0-9]{4}') THEN upper(m) END AS mic, trim(p_name) = '' AS blank
FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN replace(p_brand, '#', '') ELSE p_brand END AS b, substr(p_type, 1, 3) AS c, substr(p_type, 1, 4) AS m FROM part)""")
def _(s, d):
    p = table_of(s, d, "part")
    b = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit(""))).otherwise(F.col("p_brand"))
    pad = lambda x: F.concat(F.lit(" \t"), x, F.lit("\n"))
    kind = lambda n: pad(F.substring("p_type", 1, n))
    return p.select("p_partkey", codes.ticker(pad(b)).alias("ticker"), codes.exchange_code(pad(b)).alias("exchange_code"), codes.currency(kind(3)).alias("currency"), codes.mic(kind(4)).alias("mic"), codes.is_blank(F.col("p_name")).alias("blank"))


@_query("enum_labels", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Listed' WHEN 2 THEN 'Suspended' WHEN 3 THEN 'Delisted' END AS status,
       o_orderkey % 5 <> 3 AS active FROM orders""")
def _(s, d):
    n = (F.col("o_orderkey") % 5).cast("int")
    return table_of(s, d, "orders").select("o_orderkey", codes.label(n, codes.STATUSES).alias("status"), codes.is_active(n).alias("active"))


@_query("settings_texts", """
SELECT s_suppkey, CAST(len(list_filter(string_split(s_name, '#'), lambda x: x <> '')) AS INTEGER) AS parts, replace(s_name, '#', '%23') AS encoded,
       CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE s_name END AS named, CASE WHEN s_suppkey % 3 = 0 THEN 5432 WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey AS INTEGER) ELSE -1 END AS port,
       CAST(least(s_suppkey * 2.0, 15.0) AS DOUBLE) AS delay FROM supplier""")
def _(s, d):
    x, k = F.col("s_name"), F.col("s_suppkey")
    named = F.when(k % 3 == 0, F.lit(" \t")).otherwise(x)
    number = F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, k.cast("string")).otherwise(F.lit("70000"))
    return table_of(s, d, "supplier").select("s_suppkey", F.size(settings.split_list(F.replace(x, F.lit("#"), F.lit(" , ,")))).alias("parts"), settings.percent_encoded(x).alias("encoded"), settings.or_default(named, F.lit("none")).alias("named"), F.coalesce(settings.port(number, 5432), F.lit(-1)).alias("port"), settings.retry_delay(k).alias("delay"))


_OPS = ["list", "suspend", "resume", "delist", "rename", "change_ticker", "transfer", "reclassify"]


def lifecycle_requests(s: SparkSession, d: str) -> DataFrame:
    """Events as lifecycle requests: the first of each user registers, the others' operation follows from the id."""
    from pyspark.sql import Window

    e = table_of(s, d, "events")
    n, k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")), F.col("event_id")
    op = F.when(n == 1, F.lit("register")).otherwise(F.element_at(F.array(*map(F.lit, _OPS)), (k % 8 + 1).cast("int")))
    return e.select(F.col("user_id").cast("string").alias("id"), k.alias("seq"), op.alias("op"), F.timestamp_seconds(1_700_000_000 + k).alias("at_utc"), F.lit("venue").alias("exchange_id"), F.concat(F.lit("T"), (k % 7).cast("string")).alias("ticker"), F.lit("Name").alias("name"), (k % 3).cast("int").alias("asset_type"), F.lit("usd").alias("currency"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).alias("on_date"))


@_query("lifecycle_fold", """
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
         DATE '2024-01-01' + CAST(event_id % 50 AS INTEGER) AS day FROM events),
f(id, n, status, ticker, asset_type, listed_on, delisted_on, n_state, n_validation) AS (
  SELECT id, n, 0, 'T' || (k % 7), CAST(k % 3 AS INTEGER), CAST(NULL AS DATE), CAST(NULL AS DATE), 0, 0 FROM e WHERE n = 1
  UNION ALL
  SELECT f.id, e.n,
    CASE WHEN k % 8 = 0 AND status = 0 THEN 1 WHEN k % 8 = 1 AND status = 1 THEN 2 WHEN k % 8 = 2 AND status = 2 THEN 1
         WHEN k % 8 = 3 AND status IN (1, 2) AND day >= listed_on THEN 3 ELSE status END,
    CASE WHEN k % 8 = 5 AND status <> 3 THEN 'T' || (k % 7) ELSE ticker END,
    CASE WHEN k % 8 = 7 AND k % 3 <> 0 THEN CAST(k % 3 AS INTEGER) ELSE asset_type END,
    CASE WHEN k % 8 = 0 AND status = 0 THEN day ELSE listed_on END,
    CASE WHEN k % 8 = 3 AND status IN (1, 2) AND day >= listed_on THEN day ELSE delisted_on END,
    n_state + CASE WHEN (k % 8 = 0 AND status <> 0) OR (k % 8 = 1 AND status <> 1) OR (k % 8 = 2 AND status <> 2)
                     OR (k % 8 = 3 AND status NOT IN (1, 2)) OR (k % 8 IN (5, 6) AND status = 3) THEN 1 ELSE 0 END,
    n_validation + CASE WHEN (k % 8 = 3 AND status IN (1, 2) AND day < listed_on) OR (k % 8 = 7 AND k % 3 = 0) THEN 1 ELSE 0 END
  FROM f JOIN e ON e.id = f.id AND e.n = f.n + 1)
SELECT id, arg_max(status, n) AS status, arg_max(ticker, n) AS ticker, arg_max(asset_type, n) AS asset_type,
       max(listed_on) AS listed_on, max(delisted_on) AS delisted_on, CAST(max(n_state) AS BIGINT) AS n_state, CAST(max(n_validation) AS BIGINT) AS n_validation
FROM f GROUP BY id""")
def _(s, d):
    now = ("status", "ticker", "asset_type", "listed_on", "delisted_on")
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    done = lifecycle.outcomes(lifecycle_requests(s, d)).groupBy("id").agg(F.max_by(F.struct(*now), "last").alias("now"), of("state"), of("validation"))
    return done.select("id", "now.*", "n_state", "n_validation")


@_query("lifecycle_names_and_venues", """
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
         DATE '2024-01-01' + CAST(event_id % 50 AS INTEGER) AS day FROM events),
f(id, n, status, listed_on, name, venue) AS (
  SELECT id, n, 0, CAST(NULL AS DATE), 'N' || (k % 11), 'v' || (k % 5) FROM e WHERE n = 1
  UNION ALL
  SELECT f.id, e.n,
    CASE WHEN k % 8 = 0 AND status = 0 THEN 1 WHEN k % 8 = 1 AND status = 1 THEN 2 WHEN k % 8 = 2 AND status = 2 THEN 1
         WHEN k % 8 = 3 AND status IN (1, 2) AND day >= listed_on THEN 3 ELSE status END,
    CASE WHEN k % 8 = 0 AND status = 0 THEN day ELSE listed_on END,
    CASE WHEN k % 8 = 4 AND k % 11 <> 0 THEN 'N' || (k % 11) ELSE name END,
    CASE WHEN k % 8 = 6 AND status <> 3 AND k % 5 <> 0 THEN 'v' || (k % 5) ELSE venue END
  FROM f JOIN e ON e.id = f.id AND e.n = f.n + 1)
SELECT id, arg_max(name, n) AS name, arg_max(venue, n) AS exchange_id FROM f GROUP BY id""")
def _(s, d):
    """Renames and transfers: those to a blank name or to no venue are refused, and transfers of what is delisted."""
    k, first = F.col("seq"), F.col("op") == "register"
    asked = lifecycle_requests(s, d).withColumns({
        "name": F.when(~first & (k % 11 == 0), F.lit(" \t")).otherwise(F.concat(F.lit(" N"), (k % 11).cast("string"))),
        "exchange_id": F.when(~first & (k % 5 == 0), F.lit("")).otherwise(F.concat(F.lit("V"), (k % 5).cast("string"), F.lit(" "))),
    })
    return lifecycle.states(asked).select("id", "name", "exchange_id")


def ticks(s: SparkSession, d: str) -> DataFrame:
    return table_of(s, d, "events").select(F.col("user_id").alias("instrument"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price"))


_BARS = """(SELECT user_id AS instrument, date_trunc('day', ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"""
_ORDERED = "PARTITION BY instrument ORDER BY start"


def daily(s: SparkSession, d: str) -> DataFrame:
    return market.bars(ticks(s, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("daily_bars", f"SELECT * FROM {_BARS}")
def _(s, d):
    return daily(s, d)


def _minute_query(minutes: int) -> None:
    sql = f"""
SELECT user_id AS instrument, time_bucket(INTERVAL {minutes} MINUTE, ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close, count(*) AS volume, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"""

    @_query(f"bars_of_{minutes}_minutes", sql)
    def _(s, d):
        return market.minute_bars(ticks(s, d), minutes).withColumns({"start": F.col("start").cast("timestamp_ntz"), "value": F.round("value", 4)})


for _minutes in (1, 5, 15, 30, 60):
    _minute_query(_minutes)


@_query("insane_bars", f"SELECT * FROM {_BARS} WHERE NOT (high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0 AND least(open, high, low, close) > 0)")
def _(s, d):
    return market.insane(daily(s, d))


@_query("overnight_gaps", f"SELECT instrument, start, round(gap, 6) AS gap FROM (SELECT *, open / nullif(lag(close) OVER ({_ORDERED}), 0) - 1 AS gap FROM {_BARS}) WHERE abs(gap) >= 0.3")
def _(s, d):
    return market.overnight_gaps(daily(s, d)).withColumn("gap", F.round("gap", 6))


@_query("duplicate_ticks", "SELECT user_id AS instrument, ts, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return audits.duplicates(ticks(s, d), "instrument", "ts")


@_query("missing_sessions", f"""
SELECT instrument, start FROM (SELECT instrument, unnest(generate_series(min(start), max(start), INTERVAL 1 DAY)) AS start FROM {_BARS} GROUP BY instrument) g
WHERE start IN (SELECT start FROM {_BARS}) AND NOT EXISTS (SELECT 1 FROM {_BARS} b WHERE b.instrument = g.instrument AND b.start = g.start)""")
def _(s, d):
    return market.missing_sessions(daily(s, d))


@_query("volume_ratio", f"SELECT * FROM (SELECT instrument, start, round(volume / avg(volume) OVER ({_ORDERED} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS ratio FROM {_BARS}) WHERE ratio IS NOT NULL")
def _(s, d):
    return market.volume_ratio(daily(s, d)).withColumn("ratio", F.round("ratio", 6))


@_query("market_breadth", f"""
SELECT start, CAST(count_if(move > 0) AS BIGINT) AS advancers, CAST(count_if(move < 0) AS BIGINT) AS decliners, CAST(count_if(move = 0) AS BIGINT) AS unchanged
FROM (SELECT start, close - lag(close) OVER ({_ORDERED}) AS move FROM {_BARS}) WHERE move IS NOT NULL GROUP BY start""")
def _(s, d):
    return market.breadth(daily(s, d))


@_query("breadth_by_volume", f"""
SELECT start, advancing, declining, unchanged, round(advancing / nullif(declining, 0), 6) AS ratio FROM (
  SELECT start, CAST(coalesce(sum(volume) FILTER (move > 0), 0) AS BIGINT) AS advancing, CAST(coalesce(sum(volume) FILTER (move < 0), 0) AS BIGINT) AS declining, CAST(coalesce(sum(volume) FILTER (move = 0), 0) AS BIGINT) AS unchanged
  FROM (SELECT start, volume, close - lag(close) OVER ({_ORDERED}) AS move FROM {_BARS}) WHERE move IS NOT NULL GROUP BY start)""")
def _(s, d):
    return market.breadth_by_volume(daily(s, d)).withColumn("ratio", F.round("ratio", 6))


@_query("as_of_last_purchase", """
SELECT e.user_id AS instrument, e.ts, e.event_id AS tick_id, coalesce(p.event_id, -1) AS last_id, coalesce(p.value, -1) AS last_value
FROM (SELECT * FROM events WHERE event_id % 2 = 0) e LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 1) p
ON p.user_id = e.user_id AND p.ts <= e.ts
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC NULLS LAST, p.event_id DESC) = 1""")
def _(s, d):
    t = ticks(s, d)
    right = t.filter("tick_id % 2 = 1").select("instrument", "ts", F.col("tick_id").alias("last_id"), F.col("price").alias("last_value"))
    got = market.as_of(t.filter("tick_id % 2 = 0").select("instrument", "ts", "tick_id"), right, "instrument", "ts", ["last_id", "last_value"], "last_id")
    return got.fillna(-1, ["last_id", "last_value"])


@_query("factor_ranks", f"SELECT instrument, start, close AS value, CAST(rank() OVER (PARTITION BY start ORDER BY close DESC) AS INTEGER) AS place, round((close - avg(close) OVER (PARTITION BY start)) / nullif(stddev_pop(close) OVER (PARTITION BY start), 0), 6) AS z FROM {_BARS}")
def _(s, d):
    return market.factor_ranks(daily(s, d).select("instrument", "start", F.col("close").alias("value"))).withColumn("z", F.round("z", 6))


@_query("drawdowns", f"SELECT instrument, start, round(close / nullif(max(close) OVER ({_ORDERED} ROWS UNBOUNDED PRECEDING), 0) - 1, 6) AS drawdown FROM {_BARS}")
def _(s, d):
    return market.drawdowns(daily(s, d)).withColumn("drawdown", F.round("drawdown", 6))


@_query("risk_measures", f"""
SELECT instrument, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS deviation, round(quantile_cont(ret, 0.05), 6) AS var_5
FROM (SELECT instrument, close / nullif(lag(close) OVER ({_ORDERED}), 0) - 1 AS ret FROM {_BARS}) WHERE ret IS NOT NULL GROUP BY instrument""")
def _(s, d):
    got = market.risk(market.returns(daily(s, d)))
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "var_5")})


@_query("reconciliation", """
SELECT coalesce(a.k, b.k) AS order_key, coalesce(a.v, -1) AS left_amount, coalesce(b.v, -1) AS right_amount
FROM (SELECT o_orderkey AS k, CAST(count(*) AS BIGINT) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) a
FULL JOIN (SELECT l_orderkey AS k, count(*) AS v FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) b ON a.k = b.k
WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 4""")
def _(s, d):
    a = table_of(s, d, "orders").filter("o_orderkey % 3 <> 0").groupBy(F.col("o_orderkey").alias("order_key")).agg(F.count(F.lit(1)).alias("amount"))
    b = table_of(s, d, "lineitem").filter("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count(F.lit(1)).alias("amount"))
    return market.breaches(a, b, "order_key", 4).fillna(-1)
