"""Named queries of the extension operators, in the same way as the catalog, which they are added to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import codes, settings
from tallyforge.operators import bitemporal, directory, ingest, lifecycle, market, portfolio, research, search_index, selection
from tallyforge.plans.catalog import _BARS, _I, _ORDERED, _query, daily, instruments
from tallyforge.sources import experiments, files, provider
from tallyforge.sources.tables import table_of
from tallyforge.streaming import ingest as stream_ingest

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@_query("alias_resolution", f"""
WITH named AS (
  SELECT {_PRIORITIES}[s_suppkey % 5 + 1] AS alias, s_suppkey AS instrument, TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 30 % 2000 AS INTEGER)) AS a,
         CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 30 % 2000 + 400 AS INTEGER)) END AS b FROM supplier)
SELECT o_orderkey AS mention, coalesce(arg_max(instrument, row(a, -instrument)) FILTER (WHERE instrument IS NOT NULL), -1) AS instrument
FROM orders LEFT JOIN named ON alias = o_orderpriority AND a <= o_orderdate AND (b IS NULL OR o_orderdate < b) GROUP BY 1""")
def _(s, d):
    k = F.col("s_suppkey")
    at = lambda days: F.date_add(F.lit("1995-01-01").cast("date"), days.cast("int")).cast("timestamp_ntz")
    aliases = table_of(s, d, "supplier").select(F.element_at(F.array(*map(F.lit, _PRIORITIES)), (k % 5 + 1).cast("int")).alias("alias"), k.alias("instrument"), at(k * 30 % 2000).alias("valid_from"), F.when(k % 4 != 0, at(k * 30 % 2000 + 400)).alias("valid_to"))
    mentions = table_of(s, d, "orders").select(F.col("o_orderkey").alias("mention"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("alias"), F.col("o_orderdate").alias("at"))
    return directory.resolved(mentions, aliases).select("mention", F.coalesce("instrument", F.lit(-1)).alias("instrument"))


@_query("instrument_search", """
SELECT * FROM (SELECT p_partkey, CAST(CASE WHEN p_type = 'PROMO' THEN 0 WHEN starts_with(p_type, 'PROMO') THEN 1 WHEN starts_with(upper(p_name), 'PROMO') THEN 2 WHEN contains(upper(p_name), 'PROMO') THEN 3 END AS INTEGER) AS place FROM part)
WHERE place IS NOT NULL""")
def _(s, d):
    return directory.search(table_of(s, d, "part"), " promo ", code="p_type", name="p_name").select("p_partkey", "place")


@_query("name_search", "SELECT p_partkey, CAST(CASE WHEN starts_with(p_name, 'wid') THEN 2 ELSE 3 END AS INTEGER) AS place FROM part WHERE contains(p_name, 'wid')")
def _(s, d):
    return directory.search(table_of(s, d, "part"), "Wid", code="p_type", name="p_name").select("p_partkey", "place")


@_query("related_instruments", f"SELECT * FROM {_I} WHERE ticker = (SELECT ticker FROM {_I} WHERE id = 7) AND id <> 7")
def _(s, d):
    rows = instruments(s, d)
    return directory.related(rows, 7).select(rows.columns)


#: Order lines as raw bars: some break a rule, some repeat a key.
_RAW = {"instrument": "l_partkey", "start": "l_shipdate", "open": "l_quantity", "high": "CASE WHEN l_discount >= 0.02 THEN l_quantity + 1 ELSE l_quantity - 1 END", "low": "l_quantity - 1", "close": "l_quantity", "volume": "l_linenumber - 1", "order_key": "l_orderkey", "line": "l_linenumber", "supplier": "l_suppkey"}
_JUDGED = f"""(SELECT *, CASE WHEN NOT good THEN 'invalid' WHEN row_number() OVER (PARTITION BY instrument, start, good ORDER BY order_key DESC, line DESC, supplier DESC) > 1 THEN 'duplicate' END AS fault
FROM (SELECT *, high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0 AND least(open, high, low, close) > 0 AS good FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _RAW.items())} FROM lineitem)))"""


def _judged(s: SparkSession, d: str) -> DataFrame:
    raw = table_of(s, d, "lineitem").selectExpr(*(f"{v} AS {k}" for k, v in _RAW.items()))
    return ingest.judged(raw, ["instrument", "start"], ["order_key", "line", "supplier"])


@_query("ingest_faults", f"SELECT order_key, line, supplier, fault FROM {_JUDGED}")
def _(s, d):
    return _judged(s, d).select("order_key", "line", "supplier", "fault")


@_query("stream_ingest", f"SELECT order_key, line, supplier, fault FROM {_JUDGED}")
def _(s, d):
    """The same rows as ingest_faults, as files that come in two goes of a stream, each in two batches of files as large as
    the table's own partitions."""
    raw = table_of(s, d, "lineitem").selectExpr(*(f"{v} AS {k}" for k, v in _RAW.items()))
    folder = files.work_folder(s, "ingest")
    to = stream_ingest.Ingest(folder, raw.schema, ("instrument", "start"), ("order_key", "line", "supplier"))
    seen = 0
    for go in range(2):
        for part in range(2):
            half = (F.pmod(F.xxhash64("order_key", "line"), F.lit(2)) == go) & (F.pmod("order_key", F.lit(2)) == part)
            raw.filter(half).write.mode("append").parquet(f"{folder}/inbox")
        have = len(s.read.schema(raw.schema).parquet(f"{folder}/inbox").inputFiles())
        each, seen = max(1, -(-(have - seen) // 2)), have
        to.start(s.readStream.schema(raw.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/inbox")).awaitTermination()
    return to.judged(s).select("order_key", "line", "supplier", "fault")


@_query("lineage", "SELECT n_nationkey, n_name, 'nations' AS source, TIMESTAMP '2024-01-01 12:00:00' AS ingested_at, 'v1' AS validation_version, 't2' AS transformation_version FROM nation")
def _(s, d):
    rows = table_of(s, d, "nation").select("n_nationkey", "n_name")
    return ingest.with_lineage(rows, "nations", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), validation="v1", transformation="t2")


@_query("quality_scores", f"""
SELECT p_partkey AS instrument, round(least(100.0, 100.0 * good / nullif(p_size, 0)), 6) AS completeness, round(100.0 * (n - twice) / n, 6) AS consistency, round(100.0 * (n - bad) / n, 6) AS validity, 98.0::DOUBLE AS reliability,
       round((2 * least(100.0, 100.0 * good / nullif(p_size, 0)) + 100.0 * (n - twice) / n + 100.0 * (n - bad) / n + 98.0) / 5, 6) AS overall
FROM part JOIN (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE fault IS NULL) AS good, count(*) FILTER (WHERE fault = 'duplicate') AS twice, count(*) FILTER (WHERE fault = 'invalid') AS bad FROM {_JUDGED} GROUP BY 1) ON instrument = p_partkey WHERE p_size > 0""")
def _(s, d):
    rows = _judged(s, d)
    # Instruments with rows only: those without score 0 in three parts, which a test of its own shows.
    expected = table_of(s, d, "part").filter("p_size > 0").select(F.col("p_partkey").alias("instrument"), F.col("p_size").alias("n")).join(rows.select("instrument"), "instrument", "left_semi")
    return _rounded(ingest.quality(rows, expected, 98.0, (2, 1, 1, 1)), "completeness", "consistency", "validity", "overall")


@_query("gaps_beyond_limits", f"""
SELECT instrument, venue, start, round(gap, 6) AS gap, bound FROM (
  SELECT *, ['HOSE', 'HNX', 'UPCOM', 'OTHER'][instrument % 4 + 1] AS venue, [0.07, 0.1, 0.15, 0.3][instrument % 4 + 1]::DOUBLE AS bound, open / nullif(lag(close) OVER ({_ORDERED}), 0) - 1 AS gap FROM {_BARS})
WHERE abs(gap) > bound""")
def _(s, d):
    venue = F.element_at(F.array(*map(F.lit, ["HOSE", "HNX", "UPCOM", "OTHER"])), (F.col("instrument") % 4 + 1).cast("int"))
    return _rounded(ingest.beyond_limits(daily(s, d).withColumn("venue", venue)), "gap")


_ACTIONS = "(SELECT user_id AS instrument, date_trunc('day', ts) AS ex_start, 1.0 / (1.1 + (event_id % 3) * 0.13) AS factor FROM events WHERE event_id % 10 = 0)"


@_query("adjusted_bars", f"""
SELECT instrument, start, close, round(f, 6) AS factor, round(close * f, 4) AS adjusted_close
FROM (SELECT b.instrument, b.start, any_value(b.close) AS close, exp(coalesce(sum(ln(a.factor)), 0)) AS f FROM {_BARS} b LEFT JOIN {_ACTIONS} a ON a.instrument = b.instrument AND a.ex_start > b.start GROUP BY 1, 2)""")
def _(s, d):
    actions = table_of(s, d, "events").filter("event_id % 10 = 0").select(F.col("user_id").alias("instrument"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ex_start"), (1.0 / (1.1 + (F.col("event_id") % 3) * 0.13)).alias("factor"))
    got = research.adjusted(daily(s, d), actions)
    return got.select("instrument", "start", "close", F.round("factor", 6).alias("factor"), F.round("adjusted_close", 4).alias("adjusted_close"))


#: Parts as companies' statements.
_STATEMENT = {"part": "p_partkey", "price": "p_retailprice", "shares": "CAST(p_size AS DOUBLE)", "earnings": "p_retailprice * (p_size % 7)", "equity": "CAST(p_size % 5 AS DOUBLE)", "ebitda": "p_retailprice * 3", "debt": "CAST(p_size * 2 AS DOUBLE)", "cash": "CAST(p_size % 3 AS DOUBLE)", "assets": "CAST(p_size + 10 AS DOUBLE)", "revenue": "p_retailprice * 20", "current_assets": "CAST(p_size % 11 AS DOUBLE)", "current_liabilities": "CAST(p_size % 4 AS DOUBLE)", "free_cash_flow": "p_retailprice - p_size", "tax_rate": "CAST(0.2 AS DOUBLE)", "operating_income": "p_retailprice * 2"}
_RATIOS = {"price_earnings": "price * shares / nullif(earnings, 0)", "price_book": "price * shares / nullif(equity, 0)", "value_ebitda": "(price * shares + debt - cash) / nullif(ebitda, 0)", "return_equity": "earnings / nullif(equity, 0)", "return_assets": "earnings / nullif(assets, 0)", "return_invested": "operating_income * (1 - tax_rate) / nullif(debt + equity, 0)", "net_margin": "earnings / nullif(revenue, 0)", "debt_equity": "debt / nullif(equity, 0)", "current_ratio": "current_assets / nullif(current_liabilities, 0)", "cash_yield": "free_cash_flow / nullif(price * shares, 0)"}


@_query("fundamental_ratios", f"SELECT part, {', '.join(f'round({v}, 6) AS {k}' for k, v in _RATIOS.items())} FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _STATEMENT.items())} FROM part)")
def _(s, d):
    rows = table_of(s, d, "part").selectExpr(*(f"{v} AS {k}" for k, v in _STATEMENT.items()))
    return _rounded(research.ratios(rows), *_RATIOS).select("part", *_RATIOS)


@_query("sector_comparison", "SELECT c_custkey, c_mktsegment, round(median(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS median, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 6) AS percentile FROM customer WHERE c_acctbal IS NOT NULL")
def _(s, d):
    got = research.against_sector(table_of(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_mktsegment")
    return got.select("c_custkey", "c_mktsegment", F.round("median", 4).alias("median"), F.round("percentile", 6).alias("percentile"))


@_query("price_factors", f"""
SELECT instrument, start, round(close / nullif(lag(close, 3) OVER ({_ORDERED}), 0) - 1, 6) AS momentum,
       round(CASE WHEN count(ret) OVER w = 3 THEN stddev_samp(ret) OVER w END, 6) AS volatility, round(CASE WHEN count(*) OVER w = 3 THEN avg(close * volume) OVER w END, 4) AS liquidity
FROM (SELECT *, close / nullif(lag(close) OVER ({_ORDERED}), 0) - 1 AS ret FROM {_BARS}) WINDOW w AS ({_ORDERED} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    got = research.factors(daily(s, d), 3)
    return _rounded(got, "momentum", "volatility").withColumn("liquidity", F.round("liquidity", 4))


@_query("performance", f"""
WITH r AS (SELECT * FROM (SELECT instrument, start, close / nullif(lag(close) OVER ({_ORDERED}), 0) - 1 AS ret FROM {_BARS}) WHERE ret IS NOT NULL),
b AS (SELECT r.*, m.market, ret - 0.01 AS excess, quantile_cont(ret, 0.05) OVER (PARTITION BY instrument) AS low FROM r JOIN (SELECT start, avg(ret) AS market FROM r GROUP BY 1) m USING (start)),
g AS (SELECT instrument, avg(excess) AS m, stddev_samp(excess) AS sd, sqrt(avg(least(excess, 0) * least(excess, 0))) AS dd, avg(ret) FILTER (WHERE ret <= low) AS cvar, covar_pop(ret, market) AS c, var_pop(market) AS v, avg(ret) AS ar, avg(market) AS am FROM b GROUP BY 1)
SELECT instrument, round(m / nullif(sd, 0) * sqrt(252), 4) AS sharpe, round(m / nullif(dd, 0) * sqrt(252), 4) AS sortino, round(cvar, 5) AS cvar, round(c / nullif(v, 0), 4) AS beta, round(ar - 0.01 - c / nullif(v, 0) * (am - 0.01), 4) AS alpha FROM g""")
def _(s, d):
    rets = market.returns(daily(s, d))
    got = research.performance(rets, research.market_returns(rets), free=0.01)
    return got.withColumns({c: F.round(c, 5 if c == "cvar" else 4) for c in ("sharpe", "sortino", "cvar", "beta", "alpha")})


_EXPOSED = """(SELECT *, sum(share * share) OVER (PARTITION BY o_custkey) AS concentration FROM (
  SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS value, sum(abs(o_totalprice)) / nullif(sum(sum(abs(o_totalprice))) OVER (PARTITION BY o_custkey), 0) AS share FROM orders GROUP BY 1, 2))"""


def _exposed(s: SparkSession, d: str) -> DataFrame:
    return research.exposures(table_of(s, d, "orders").withColumn("value", F.col("o_totalprice")), "o_custkey", "o_orderpriority")


@_query("exposures", f"SELECT o_custkey, o_orderpriority, round(value, 2) AS value, round(share, 6) AS share, round(concentration, 6) AS concentration FROM {_EXPOSED}")
def _(s, d):
    return _rounded(_exposed(s, d), "share", "concentration").withColumn("value", F.round("value", 2))


@_query("over_limit", f"SELECT o_custkey, o_orderpriority, round(share, 6) AS share FROM {_EXPOSED} WHERE share > 0.4")
def _(s, d):
    return research.over_limit(_exposed(s, d), 0.4).select("o_custkey", "o_orderpriority", F.round("share", 6).alias("share"))


@_query("stressed", """
SELECT o_custkey, 'all down 10' AS scenario, round(sum(0.1 * o_totalprice), 4) AS loss FROM orders GROUP BY 1
UNION ALL SELECT o_custkey, 'urgent down 15', round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 0.15 * o_totalprice ELSE 0 END), 4) FROM orders GROUP BY 1""")
def _(s, d):
    shocks = {"all down 10": {"": -0.10}, "urgent down 15": {"1-URGENT": -0.15}}
    got = research.stressed(table_of(s, d, "orders").withColumn("value", F.col("o_totalprice")), "o_custkey", "o_orderpriority", shocks)
    return got.withColumn("loss", F.round("loss", 4))


@_query("watchlist", f"""
SELECT instrument, start, close AS price, round(change, 6) AS change, volume, round(close * volume, 4) AS value, round(ratio, 6) AS volume_ratio
FROM (SELECT *, close - lag(close) OVER ({_ORDERED}) AS change, volume / avg(volume) OVER ({_ORDERED} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ratio, row_number() OVER (PARTITION BY instrument ORDER BY start DESC) AS turn FROM {_BARS}) WHERE turn = 1""")
def _(s, d):
    return _rounded(research.watchlist(daily(s, d)), "change", "volume_ratio").withColumn("value", F.round("value", 4))


@_query("exchange_registration", """
SELECT id, code, name, zone AS time_zone_id, mic, CASE WHEN id LIKE '00000000-%' OR code IS NULL OR zone <> 'Asia/Ho_Chi_Minh' OR bad THEN 'validation' END AS fault FROM (
  SELECT CASE WHEN c_custkey % 10 = 0 THEN '00000000-0000-0000-0000-000000000000' ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 3 <> 1 THEN 'V' || c_custkey END AS code, c_name AS name,
         CASE WHEN c_custkey % 7 = 0 THEN 'Nowhere/Here' ELSE 'Asia/Ho_Chi_Minh' END AS zone, CASE c_custkey % 4 WHEN 0 THEN 'XSTC' END AS mic, c_custkey % 4 = 1 AS bad FROM customer)""")
def _(s, d):
    k, c = F.col("c_custkey"), F.col
    mics = F.element_at(F.array(*map(F.lit, [" xstc", "X!", " ", ""])), (k % 4 + 1).cast("int"))
    asked = table_of(s, d, "customer").select(
        F.when(k % 10 == 0, F.lit(codes.NIL_UUID)).otherwise(k.cast("string")).alias("id"), F.when(k % 3 == 1, F.lit("no code!")).otherwise(F.concat(F.lit(" v"), k.cast("string"))).alias("code"), F.concat(F.lit(" "), c("c_name"), F.lit("\t")).alias("name"),
        F.when(k % 7 == 0, F.lit("Nowhere/Here")).otherwise(F.lit("Asia/Ho_Chi_Minh")).alias("time_zone_id"), mics.alias("mic"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("at_utc"))
    return lifecycle.registered_exchanges(asked).select("id", "code", "name", "time_zone_id", "mic", "fault")


@_query("exchange_rename", """
SELECT c_custkey AS id, coalesce(r.name, c_name) AS name FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max('N' || o_orderkey, o_orderkey) AS name FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1) r ON r.o_custkey = c_custkey""")
def _(s, d):
    born = F.lit("1996-01-01").cast("timestamp_ntz")
    rows = table_of(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), born.alias("created_at_utc"), born.alias("updated_at_utc"))
    k = F.col("o_orderkey")
    asked = table_of(s, d, "orders").select(F.col("o_custkey").alias("id"), k.alias("seq"), F.when(k % 3 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" N"), k.cast("string"))).alias("name"), F.col("o_orderdate").alias("at_utc"))
    return lifecycle.renamed_exchanges(rows, asked).select("id", "name")


@_query("ordered_ids", """
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7' || substr(m, 1, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(m, 4, 1)) - 1) % 4 + 1 AS INTEGER), 1) || substr(m, 5, 3) || '-' || substr(m, 9, 12) AS id
FROM (SELECT o_orderkey, printf('%012x', epoch_ms(o_orderdate)) AS h, md5('order' || chr(31) || o_orderkey) AS m FROM orders)""")
def _(s, d):
    return table_of(s, d, "orders").select("o_orderkey", codes.ordered_uuid(F.col("o_orderdate").cast("timestamp"), F.lit("order"), F.col("o_orderkey")).alias("id"))


@_query("texts_checked", """
SELECT s_suppkey, s_suppkey % 4 < 2 AS utc, s_suppkey % 3 = 0 AS zone, s_suppkey % 5 = 0 AS nil, 'http://' || replace(s_name, '#', '') AS url,
       CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE -1 END::INTEGER AS asset_type FROM supplier""")
def _(s, d):
    k = F.col("s_suppkey")
    of = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    return table_of(s, d, "supplier").select(
        "s_suppkey", codes.is_utc_text(of(4, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+07:00", "2024-01-01T00:00:00")).alias("utc"), codes.is_time_zone(of(3, "Asia/Ho_Chi_Minh", "asia/nowhere", "")).alias("zone"),
        codes.is_nil(of(5, codes.NIL_UUID, "1", "2", "3", "4")).alias("nil"), settings.without_trailing_slash(F.concat(F.lit("http://"), F.replace("s_name", F.lit("#"), F.lit("")), F.lit("//"))).alias("url"),
        F.coalesce(codes.number(of(4, "Unspecified", "Equity", "Bond", "bond"), codes.ASSET_TYPES), F.lit(-1)).alias("asset_type"))


#: Order lines as trades, with an even line as a sale.
_TRADES = """(SELECT l_partkey AS instrument, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS trade, CAST(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS INTEGER) AS side,
 CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem)"""


def trades(s: SparkSession, d: str) -> DataFrame:
    return table_of(s, d, "lineitem").selectExpr("l_partkey AS instrument", "l_shipdate AS at", "l_orderkey * 8 + l_linenumber AS trade", "CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS side", "CAST(l_quantity AS BIGINT) AS quantity", "CAST(round(l_extendedprice * 100) AS BIGINT) AS price")


@_query("profit_by_lots", f"""
WITH t AS (SELECT *, sum(quantity) OVER (PARTITION BY instrument, side ORDER BY ts, trade) AS upto FROM {_TRADES}),
ends AS (SELECT instrument, coalesce(sum(quantity) FILTER (WHERE side = 1), 0) AS bought, coalesce(sum(quantity) FILTER (WHERE side = -1), 0) AS sold, arg_max(price, row(ts, trade)) AS mark FROM {_TRADES} GROUP BY 1),
met AS (SELECT b.instrument, (least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity)) * (s.price - b.price) AS gain FROM t b JOIN t s ON b.side = 1 AND s.side = -1 AND b.instrument = s.instrument AND b.upto > s.upto - s.quantity AND s.upto > b.upto - b.quantity),
realised AS (SELECT instrument, sum(gain) AS gain FROM met GROUP BY 1),
unrealised AS (SELECT instrument, sum(greatest(0, upto - greatest(CASE WHEN side = 1 THEN sold ELSE bought END, upto - quantity)) * side * (mark - price)) AS gain FROM t JOIN ends USING (instrument) GROUP BY 1)
SELECT instrument, CAST(coalesce(r.gain, 0) AS BIGINT) AS realised, CAST(u.gain AS BIGINT) AS unrealised, CAST(coalesce(r.gain, 0) + u.gain AS BIGINT) AS total, CAST(bought - sold AS BIGINT) AS open_quantity
FROM ends JOIN unrealised u USING (instrument) LEFT JOIN realised r USING (instrument)""")
def _(s, d):
    return portfolio.profit(trades(s, d))


#: Daily bars of suppliers' lines at their unit prices.
_DAYS = """(SELECT l_suppkey AS instrument, date_trunc('day', l_shipdate) AS start, arg_min(p, row(l_shipdate, k)) AS open, max(p) AS high, min(p) AS low, arg_max(p, row(l_shipdate, k)) AS close, count(*) AS volume
 FROM (SELECT *, l_extendedprice / l_quantity AS p, l_orderkey * 8 + l_linenumber AS k FROM lineitem) GROUP BY ALL)"""


def line_days(s: SparkSession, d: str) -> DataFrame:
    lines = table_of(s, d, "lineitem").selectExpr("l_suppkey AS instrument", "l_shipdate AS ts", "l_orderkey * 8 + l_linenumber AS tick_id", "l_extendedprice / l_quantity AS price")
    return market.bars(lines).withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("funnel", f"""
WITH days AS (SELECT * FROM {_DAYS}),
months AS (SELECT instrument, date_trunc('month', start) AS month_start, arg_max(close, start) > arg_min(open, start) AS month_up FROM days GROUP BY ALL),
weeks AS (SELECT instrument, date_trunc('week', start) AS week_start, arg_max(close, start) / nullif(arg_min(open, start), 0) AS gain FROM days GROUP BY ALL),
placed AS (SELECT instrument, week_start + INTERVAL 7 DAY AS ended, week_start, CAST(rank() OVER (PARTITION BY week_start ORDER BY gain DESC NULLS LAST) AS INTEGER) AS week_place FROM weeks),
linked AS (SELECT p.*, month_start, month_up FROM placed p ASOF LEFT JOIN (SELECT *, month_start + INTERVAL 1 MONTH AS ended FROM months) m ON m.instrument = p.instrument AND m.ended <= p.ended),
seen AS (SELECT instrument, start, start + INTERVAL 1 DAY AS ended, close, coalesce(close > lag(close) OVER (PARTITION BY instrument ORDER BY start), false) AS entry FROM days)
SELECT s.instrument, s.start, s.close, week_start, week_place, month_start, month_up, entry, month_up AND week_place <= 10 AND entry AS chosen
FROM seen s ASOF JOIN linked b ON b.instrument = s.instrument AND b.ended <= s.ended WHERE month_start IS NOT NULL""")
def _(s, d):
    return portfolio.funnel(line_days(s, d))


@_query("provider_bars", """
SELECT l_partkey AS instrument, l_shipdate AS start, CASE WHEN l_discount >= 0.09 THEN -1 ELSE l_extendedprice / l_quantity END AS high, CAST(l_quantity AS BIGINT) AS volume,
       l_orderkey || '-' || l_linenumber AS reference, CASE WHEN l_discount >= 0.09 THEN 'high' ELSE 'none' END AS error
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'""")
def _(s, d):
    """A feature's own bounds: the part of a provider's history that was asked for."""
    provider.register(s)
    rows = s.read.format("bars").option("provider", "order_lines").option("location", f"{d}/lineitem.parquet").load()
    asked = rows.filter("start >= TIMESTAMP_NTZ '1995-01-01' AND start < TIMESTAMP_NTZ '1998-01-01'")
    return asked.select("instrument", "start", F.coalesce("high", F.lit(-1.0)).alias("high"), "volume", "reference", F.coalesce("error", F.lit("none")).alias("error"))


#: Events as corporate actions of a week: those of one week restate each other, some withdraw, and all are learnt later.
_VERSIONS = """(SELECT user_id AS instrument, date_trunc('week', ts) AS ex_start, ts + to_days(CAST(event_id % 9 AS INTEGER)) AS known_at, event_id AS version,
 1.0 / (1.1 + (event_id % 3) * 0.13) AS factor, event_id % 4 = 0 AS withdrawn, value FROM events WHERE event_id % 2 = 0)"""
_MOMENTS = [dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 25, 12)]
_AT = "(SELECT unnest([TIMESTAMP '2024-01-12 00:00:00', TIMESTAMP '2024-01-25 12:00:00']) AS moment)"
_KNOWN = f"""(SELECT moment, instrument, ex_start, arg_max(row(withdrawn, factor, value), row(known_at, version)) AS last FROM {_AT} JOIN {_VERSIONS} ON known_at <= moment GROUP BY 1, 2, 3)"""


def versions(s: SparkSession, d: str) -> DataFrame:
    return table_of(s, d, "events").filter("event_id % 2 = 0").selectExpr("user_id AS instrument", "CAST(date_trunc('week', ts) AS timestamp_ntz) AS ex_start", "ts + make_dt_interval(CAST(event_id % 9 AS INT)) AS known_at", "event_id AS version", "1.0D / (1.1D + (event_id % 3) * 0.13D) AS factor", "event_id % 4 = 0 AS withdrawn", "value")


@_query("bars_as_known", f"""
SELECT b.instrument, b.start, moment, round(any_value(b.close) * exp(coalesce(sum(ln(factor)), 0)), 4) AS adjusted_close
FROM {_BARS} b JOIN {_AT} ON b.start < moment LEFT JOIN (SELECT moment AS m, instrument, ex_start, last[2] AS factor FROM {_KNOWN} WHERE NOT last[1]) k ON k.m = moment AND k.instrument = b.instrument AND k.ex_start > b.start GROUP BY ALL""")
def _(s, d):
    got = bitemporal.adjusted_as_known(daily(s, d), versions(s, d), _MOMENTS)
    return got.select("instrument", "start", "moment", F.round("adjusted_close", 4).alias("adjusted_close"))


@_query("statements_as_known", f"""
SELECT moment, instrument, ex_start AS period, last[3] AS value FROM {_KNOWN} WHERE NOT last[1] QUALIFY row_number() OVER (PARTITION BY moment, instrument ORDER BY ex_start DESC) = 1""")
def _(s, d):
    return bitemporal.published(versions(s, d).withColumnRenamed("ex_start", "period"), _MOMENTS, ["value"])


@_query("indexed_search", """
SELECT 'promo' AS asked, p_partkey, CAST(CASE WHEN p_type = 'PROMO' THEN 0 WHEN starts_with(p_type, 'PROMO') THEN 1 WHEN starts_with(upper(p_name), 'PROMO') THEN 2 ELSE 3 END AS INTEGER) AS place FROM part WHERE starts_with(p_type, 'PROMO') OR contains(upper(p_name), 'PROMO')
UNION ALL SELECT 'wid', p_partkey, CAST(CASE WHEN starts_with(p_name, 'wid') THEN 2 ELSE 3 END AS INTEGER) FROM part WHERE contains(p_name, 'wid')
UNION ALL SELECT '7', p_partkey, CAST(CASE WHEN starts_with(p_name, '7') THEN 2 ELSE 3 END AS INTEGER) FROM part WHERE contains(p_name, '7')""")
def _(s, d):
    """The index is written once; each search reads its own posting lists."""
    folder = files.work_folder(s, "search")
    search_index.build(table_of(s, d, "part"), folder, key="p_partkey", code="p_type", name="p_name")
    found = [search_index.search(s, folder, text, key="p_partkey", code="p_type", name="p_name").select(F.lit(text.strip()).alias("asked"), "p_partkey", "place") for text in (" promo", "wid", "7 ")]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: Some events as rebalancings of five portfolios: what a portfolio has of one day is all that it then holds.
_WEIGHTS = """(SELECT user_id % 5 AS portfolio, date_trunc('day', ts) AS at_, user_id AS instrument, sum((event_id % 9 + 1) / 20.0) AS weight FROM events WHERE event_id % 10 = 3 GROUP BY 1, 2, 3)"""
_RETS = f"(SELECT instrument, start, ret FROM (SELECT instrument, start, close / nullif(lag(close) OVER ({_ORDERED}), 0) - 1 AS ret FROM {_BARS}) WHERE ret IS NOT NULL)"
def _curve_sql(weights: str, cost: float = 0.0) -> str:
    return f"""
WITH w AS (SELECT * FROM {weights}), r AS (SELECT instrument, start, greatest(least(ret, 0.5), -0.3) AS ret FROM {_RETS}),
times AS (SELECT portfolio, at_, lag(at_) OVER (PARTITION BY portfolio ORDER BY at_) AS prior FROM (SELECT DISTINCT portfolio, at_ FROM w)),
old AS (SELECT t.portfolio, t.at_, instrument, weight AS before FROM times t JOIN w ON w.portfolio = t.portfolio AND w.at_ = t.prior),
moved AS (SELECT portfolio, at_, sum(abs(coalesce(weight, 0) - coalesce(before, 0))) AS turnover FROM w FULL JOIN old USING (portfolio, at_, instrument) GROUP BY 1, 2),
days AS (SELECT d.start, t.portfolio, max(t.at_) AS at_ FROM (SELECT DISTINCT start FROM r) d JOIN times t ON t.at_ <= d.start GROUP BY 1, 2),
daily AS (SELECT portfolio, start, at_, sum(abs(weight)) AS exposure, sum(weight * coalesce(ret, 0)) AS ret FROM days JOIN w USING (portfolio, at_) LEFT JOIN r USING (instrument, start) GROUP BY 1, 2, 3),
turned AS (SELECT daily.*, CASE WHEN row_number() OVER (PARTITION BY portfolio, at_ ORDER BY start) = 1 THEN turnover ELSE 0 END AS turnover FROM daily JOIN moved USING (portfolio, at_)),
net AS (SELECT portfolio, start, at_, exposure, turnover, ret - {cost} * turnover AS ret FROM turned),
valued AS (SELECT *, CASE WHEN max(CASE WHEN ret <= -1 THEN 1 ELSE 0 END) OVER o = 1 THEN 0 ELSE exp(sum(ln(greatest(1 + ret, 1e-12))) OVER o) END AS value FROM net WINDOW o AS (PARTITION BY portfolio ORDER BY start)),
told AS (SELECT portfolio, start, exposure, turnover, ret, value, value / max(greatest(value, 1)) OVER (PARTITION BY portfolio ORDER BY start) - 1 AS drawdown FROM valued)"""


_CURVE = _curve_sql(_WEIGHTS)


def _bounded_returns(s: SparkSession, d: str) -> DataFrame:
    return market.returns(daily(s, d)).withColumn("ret", F.greatest(F.least("ret", F.lit(0.5)), F.lit(-0.3)))


def _curves(s: SparkSession, d: str) -> DataFrame:
    some = table_of(s, d, "events").filter("event_id % 10 = 3")
    weights = some.selectExpr("user_id % 5 AS portfolio", "CAST(date_trunc('day', ts) AS timestamp_ntz) AS at", "user_id AS instrument", "(event_id % 9 + 1) / 20.0D AS weight")
    return portfolio.curve(weights, _bounded_returns(s, d))


@_query("equity_curve", _CURVE + " SELECT portfolio, start, round(exposure, 6) AS exposure, round(turnover, 6) AS turnover, round(ret, 6) AS ret, round(value, 6) AS value, round(drawdown, 6) AS drawdown FROM told")
def _(s, d):
    return _rounded(_curves(s, d), "exposure", "turnover", "ret", "value", "drawdown")


@_query("calmar", _CURVE + " SELECT portfolio, round((pow(arg_max(value, start), 30.0 / nullif(date_diff('day', min(start), max(start)), 0)) - 1) / abs(nullif(min(drawdown), 0)), 4) AS calmar FROM told GROUP BY 1")
def _(s, d):
    """The test events cover a month, which stands for the year."""
    return portfolio.calmar(_curves(s, d), days_a_year=30).withColumn("calmar", F.round("calmar", 4))


@_query("experiment_records", f"""
SELECT length, count(gain) AS n, round(avg(gain), 6) AS mean
FROM (SELECT 3 AS length, close / nullif(lag(close, 3) OVER ({_ORDERED}), 0) - 1 AS gain FROM {_BARS} UNION ALL SELECT 5, close / nullif(lag(close, 5) OVER ({_ORDERED}), 0) - 1 FROM {_BARS}) GROUP BY 1""")
def _(s, d):
    """Gains over 3, 5 and again 3 bars: the third run adds no record."""
    folder, bars = files.work_folder(s, "experiments"), daily(s, d)
    inputs = {"bars": experiments.version(bars)}
    for length in (3, 5, 3):
        before = F.lag("close", length).over(Window.partitionBy("instrument").orderBy("start"))
        gains = bars.select((F.col("close") / F.nullif(before, F.lit(0.0)) - 1).alias("gain"))
        experiments.recorded(s, folder, "gains", {"length": length}, inputs, lambda x=gains, n=length: x.agg(F.count("gain").alias("n"), F.avg("gain").alias("mean")).withColumn("length", F.lit(n)))
    return experiments.records(s, folder).select("length", "n", F.round("mean", 6).alias("mean"))


_BOUNDS = {"position": 0.42, "sector": 1.22, "leverage": 2.02, "drawdown": -0.25, "daily_loss": -0.1}
#: Holdings of the curves' first days of a rebalancing, with an instrument's number as its sector.
_LIMITED = _CURVE + f""",
held AS (SELECT portfolio, at_ AS start, instrument, instrument % 3 AS sector, weight FROM w),
largest AS (SELECT portfolio, start, max(p) AS position, max(abs(s)) AS sector FROM (SELECT portfolio, start, sector, max(abs(weight)) AS p, sum(weight) AS s FROM held GROUP BY 1, 2, 3) GROUP BY 1, 2),
limited AS (SELECT portfolio, start, exposure AS leverage, drawdown, ret AS daily_loss, coalesce(position, 0) AS position, coalesce(sector, 0) AS sector FROM told LEFT JOIN largest USING (portfolio, start)),
judged AS ({' UNION ALL '.join(f"SELECT portfolio, start, '{n}' AS kind, CAST({n} AS DOUBLE) AS value, CAST({b} AS DOUBLE) AS bound, {n} {'>=' if b < 0 else '<='} {b} AS may_proceed FROM limited" for n, b in _BOUNDS.items())})"""


def _limited(s: SparkSession, d: str) -> DataFrame:
    held = table_of(s, d, "events").filter("event_id % 10 = 3").selectExpr("user_id % 5 AS portfolio", "CAST(date_trunc('day', ts) AS timestamp_ntz) AS start", "user_id AS instrument", "user_id % 3 AS sector", "(event_id % 9 + 1) / 20.0D AS weight")
    # Sums of twentieths may differ in their last bit by the order of addition, so bounds lie between their multiples.
    return portfolio.limits(held, _curves(s, d), _BOUNDS)


@_query("portfolio_limits", _LIMITED + " SELECT portfolio, start, kind, round(value, 6) AS value, bound, may_proceed FROM judged")
def _(s, d):
    return _limited(s, d).withColumnRenamed("limit", "kind").withColumn("value", F.round("value", 6))


@_query("orders_within_limits", _LIMITED + """, kept AS (SELECT portfolio, start + INTERVAL 1 DAY AS known, bool_and(may_proceed) AS good FROM judged GROUP BY 1, 2)
SELECT event_id, coalesce(good, true) AS may_proceed FROM (SELECT event_id, user_id % 5 AS portfolio, ts FROM events) e ASOF LEFT JOIN kept k ON k.portfolio = e.portfolio AND k.known <= e.ts""")
def _(s, d):
    asked = table_of(s, d, "events").select((F.col("user_id") % 5).alias("portfolio"), F.col("ts").alias("at"), "event_id")
    return portfolio.orders_that_may_proceed(asked, _limited(s, d)).select("event_id", "may_proceed")


#: Orders as statements of the customers' numbers, which are instruments here, published around the days of the events.
_FACT = {"instrument": "o_custkey", "statement": "o_orderkey", "shares": "CAST(o_orderkey % 11 + 1 AS DOUBLE)", "earnings": "CAST(o_totalprice AS DOUBLE)", "equity": "CAST(o_orderkey % 7 AS DOUBLE)"}
_TILT = {"momentum": 1.0, "volatility": -0.5, "size": -0.25, "value": 1.0, "quality": 0.5, "growth": 0.5}
_FACTOR_SQL = f"""
facts AS (SELECT *, earnings / nullif(lag(earnings) OVER (PARTITION BY instrument ORDER BY start, statement), 0) - 1 AS growth
  FROM (SELECT {", ".join(f"{v} AS {k}" for k, v in _FACT.items())}, TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 40 - 10 AS INTEGER)) AS start FROM orders)),
last_facts AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY instrument, start ORDER BY statement DESC) = 1),
priced AS (SELECT instrument, start, close, close / nullif(lag(close, 3) OVER ({_ORDERED}), 0) - 1 AS momentum, CASE WHEN count(ret) OVER w = 3 THEN stddev_samp(ret) OVER w END AS volatility, CASE WHEN count(*) OVER w = 3 THEN avg(close * volume) OVER w END AS liquidity
  FROM (SELECT *, close / nullif(lag(close) OVER ({_ORDERED}), 0) - 1 AS ret FROM {_BARS}) WINDOW w AS ({_ORDERED} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
factors AS (SELECT p.instrument, p.start, momentum, volatility, liquidity, ln(CASE WHEN close * shares > 0 THEN close * shares END) AS size, earnings / nullif(close * shares, 0) AS value, earnings / nullif(equity, 0) AS quality, growth
  FROM priced p ASOF LEFT JOIN last_facts f ON p.instrument = f.instrument AND p.start >= f.start)"""


def _z(n: str) -> str:
    return f"CASE WHEN {n} IS NOT NULL AND min({n}) OVER s < max({n}) OVER s THEN greatest(-3, least(3, ({n} - avg({n}) OVER s) / stddev_pop({n}) OVER s)) END AS {n}"


_CHOSEN_SQL = f"""WITH {_FACTOR_SQL},
within AS (SELECT * FROM factors WHERE liquidity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY start ORDER BY liquidity DESC, instrument) <= 40),
z AS (SELECT instrument, start, {", ".join(_z(n) for n in _TILT)} FROM within WINDOW s AS (PARTITION BY start)),
told AS (SELECT instrument, start, round(({" + ".join(f"coalesce({n} * {w}, 0)" for n, w in _TILT.items())}) / nullif({" + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {abs(w)} END" for n, w in _TILT.items())}, 0), 9) AS score FROM z),
first AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, instrument) AS place FROM told WHERE score IS NOT NULL QUALIFY place <= 10)
SELECT start, start + INTERVAL 1 DAY AS at_, instrument, place, score, 1.0 / count(*) OVER (PARTITION BY start) AS weight FROM first"""


def _facts(s: SparkSession, d: str) -> DataFrame:
    return table_of(s, d, "orders").selectExpr(*(f"{v} AS {k}" for k, v in _FACT.items()), "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(CAST(o_orderkey % 40 - 10 AS INT)) AS published")


def _chosen(s: SparkSession, d: str) -> DataFrame:
    return selection.selected(daily(s, d), _facts(s, d), _TILT, length=3, most=40, best=10)


@_query("factor_values", f"WITH {_FACTOR_SQL} SELECT instrument, start, {', '.join(f'round({n}, 6) AS {n}' for n in selection.FACTORS)} FROM factors")
def _(s, d):
    return selection.factor_values(daily(s, d), _facts(s, d), 3).select("instrument", "start", *(F.round(n, 6).alias(n) for n in selection.FACTORS))


@_query("factor_portfolio", f"SELECT start, instrument, CAST(place AS INTEGER) AS place, round(score, 5) AS score, round(weight, 6) AS weight FROM ({_CHOSEN_SQL})")
def _(s, d):
    return _chosen(s, d).select("start", "instrument", "place", F.round("score", 5).alias("score"), F.round("weight", 6).alias("weight"))


@_query("factor_portfolio_curve", _curve_sql(f"(SELECT 0 AS portfolio, at_, instrument, weight FROM ({_CHOSEN_SQL}))", 0.002) + " SELECT portfolio, start, round(exposure, 6) AS exposure, round(turnover, 6) AS turnover, round(ret, 6) AS ret, round(value, 6) AS value, round(drawdown, 6) AS drawdown FROM told")
def _(s, d):
    """Rebalanced each session at a cost of 20 basis points of what is traded. The weights are written: a curve reads them
    several times."""
    path = files.work_folder(s, "weights") + "/weights"
    _chosen(s, d).select(F.lit(0).alias("portfolio"), "at", "instrument", "weight").write.parquet(path)
    weights = s.read.parquet(path)
    return _rounded(portfolio.curve(weights, _bounded_returns(s, d), cost=0.002), "exposure", "turnover", "ret", "value", "drawdown")
