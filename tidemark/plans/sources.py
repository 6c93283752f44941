"""SRC and SNK queries: payloads and files that Spark derives from the driver tables."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.audits import audit
from tidemark.plans.fmt import n, r, s, us
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import payloads as P
from tidemark.sources import sinks as K
from tidemark.sources.tables import read_columns, read_frame, read_window


@query("src_01", "SELECT n_nationkey, n_name, n_regionkey, 'csv' AS origin FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'parquet' FROM nation")
def src_01(v):
    """Reader chosen by suffix: the same table from parquet and from CSV."""
    path = scratch_path(v.spark, "nation") + ".csv"
    nation = v.t("nation")
    nation.write.option("header", True).csv(path)
    return read_frame(v.spark, path, nation.schema).withColumn("origin", F.lit("csv")).unionByName(read_frame(v.spark, v.path("nation")).withColumn("origin", F.lit("parquet")))


@query("src_02", "SELECT o_orderkey, o_orderstatus FROM orders")
def src_02(v):
    """Projected read of the wanted columns that exist."""
    return read_columns(v.spark, v.path("orders"), ["o_orderkey", "o_orderstatus", "not_there"])


@query("src_03", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def src_03(v):
    """Timestamp window read with filter pushdown."""
    return read_window(v.spark, v.path("events"), "ts", "2024-01-10 00:00:00", "2024-01-12 00:00:00").select("event_id", "value")


@query("src_04", """SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT session_date_et) AS sessions, epoch_us(min(timestamp)) AS first_at, epoch_us(max(timestamp)) AS last_at,
 epoch_us(min(timestamp) FILTER (WHERE minute_et BETWEEN 570 AND 960)) AS first_regular, count(*) FILTER (WHERE minute_et BETWEEN 570 AND 960) AS regular_rows FROM bars_hour""", ("bars_hour",))
def src_04(v):
    """Metadata scan of a bar dataset in one aggregate."""
    reg = F.col("minute_et").between(570, 960)
    return v.bars_hour.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("session_date_et").alias("sessions"), us(F.min("timestamp"), "first_at"), us(F.max("timestamp"), "last_at"),
                           us(F.min(F.when(reg, F.col("timestamp"))), "first_regular"), F.count_if(reg).alias("regular_rows"))


@query("src_05", """WITH l AS (SELECT *, lag(effective_to) OVER (PARTITION BY ticker ORDER BY effective_from) AS pt FROM memberships)
SELECT count(DISTINCT ticker) AS tickers, count(*) AS windows, count(*) FILTER (WHERE effective_to <= effective_from) AS invalid_windows, count(*) FILTER (WHERE effective_from < pt) AS overlapping_windows FROM l""", ("memberships",))
def src_05(v):
    """Universe scan: tickers, invalid and overlapping windows."""
    from tidemark.operators.joins import interval_match

    m = v.memberships
    base = m.agg(F.countDistinct("ticker").alias("tickers"), F.count(F.lit(1)).alias("windows"), F.count_if(F.col("effective_to") <= F.col("effective_from")).alias("invalid_windows"))
    starts = m.select("ticker", F.col("effective_from").alias("decision_time"))
    over = interval_match(starts, m, ["ticker"], "decision_time", F.col("effective_from"), F.col("effective_to"), "snapshot_id", []).agg(F.count_if(F.col("match_count") > 1).alias("overlapping_windows"))
    return base.join(F.broadcast(over))  # one-row aggregates


@query("src_06", """SELECT x.ticker, CAST(b.c IS NOT NULL AS BIGINT) AS present, coalesce(b.c, 0) AS rows FROM (SELECT unnest(['CLICK', 'VIEW', 'QQQ']) AS ticker) x LEFT JOIN (SELECT ticker, count(*) AS c FROM bars_hour GROUP BY 1) b USING (ticker)""", ("bars_hour",))
def src_06(v):
    """Per-symbol benchmark scan with existence flag."""
    want = v.spark.createDataFrame([("CLICK",), ("VIEW",), ("QQQ",)], "ticker string")
    got = v.bars_hour.groupBy("ticker").agg(F.count(F.lit(1)).alias("c"))
    return want.join(got, "ticker", "left").select("ticker", n(F.col("c").isNotNull(), "present"), F.coalesce("c", F.lit(0)).alias("rows"))


@query("src_07", "SELECT 'customer.parquet' AS file, count(*) AS rows FROM customer UNION ALL SELECT 'supplier.parquet', count(*) FROM supplier")
def src_07(v):
    """Union of several files with the file each row came from."""
    def one(t, key):
        return v.spark.read.parquet(v.path(t)).select(F.col("_metadata.file_name").alias("file"), F.col(key).alias("k"))

    return one("customer", "c_custkey").unionByName(one("supplier", "s_suppkey")).groupBy("file").agg(F.count("k").alias("rows"))


@query("src_08", "SELECT event_type AS source_family, count(*) AS rows, count(DISTINCT user_id) AS tickers FROM events GROUP BY 1")
def src_08(v):
    """Directory canonicalise: every file of a directory read and canonicalised once."""
    path = scratch_path(v.spark, "event-files")
    v.t("events").select("event_id", "user_id", "event_type").write.partitionBy("event_type").parquet(path)
    d = v.spark.read.parquet(path)
    return d.groupBy(F.lower("event_type").alias("source_family")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("tickers"))


@query("src_09", """WITH p AS (SELECT c_custkey, upper(unnest(['c' || c_custkey, 'x' || (c_custkey % 50), '1bad'])) AS t FROM customer), u AS (SELECT t AS ticker, min(c_custkey) AS first_row FROM p WHERE regexp_full_match(t, '[A-Z][A-Z0-9.]{0,9}') GROUP BY 1)
SELECT ticker, first_row, CAST(ticker IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS already_in_universe FROM u""")
def src_09(v):
    """Screener import: pasted symbols split, validated, kept once, universe flag."""
    pasted = v.t("customer").select("c_custkey", F.concat(F.lit(" c"), "c_custkey", F.lit(", x"), F.col("c_custkey") % 50, F.lit("\n1bad")).alias("cell"))
    sym = pasted.select("c_custkey", F.explode(F.split(F.upper(F.trim("cell")), r"[,\s]+")).alias("ticker")).where(F.col("ticker").rlike(r"^[A-Z][A-Z0-9.]{0,9}$"))
    u = sym.groupBy("ticker").agg(F.min("c_custkey").alias("first_row"))
    have = v.t("orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("C"), F.col("o_custkey")).alias("ticker")).distinct().withColumn("hit", F.lit(1))
    return u.join(have, "ticker", "left").select("ticker", "first_row", n(F.col("hit").isNotNull(), "already_in_universe"))


@query("src_10", "SELECT n_name AS ticker, CAST(n_regionkey AS VARCHAR) AS screen FROM nation")
def src_10(v):
    """Multi-file CSV union tagged by metadata in the file path."""
    path = scratch_path(v.spark, "screens")
    v.t("nation").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").option("header", True).csv(path)
    d = v.spark.read.option("header", True).option("recursiveFileLookup", True).schema("n_name string").csv(path)
    return d.select(F.col("n_name").alias("ticker"), F.regexp_extract("_metadata.file_path", r"n_regionkey=(\d+)", 1).alias("screen"))


def _json(*cols):
    return F.to_json(F.struct(*cols))


@query("src_11", """SELECT doc_id, title, 'http://x/' || doc_id AS url, epoch_us(published) AS timestamp, lang AS language FROM headlines WHERE trim(title) <> '' AND doc_id % 7 <> 0""", ("headlines",))
def src_11(v):
    """Article payloads to event rows; incomplete articles are skipped."""
    art = F.struct("title", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("http://x/"), "doc_id")).otherwise("").alias("url"), F.date_format("published", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
                   F.lit("x").alias("domain"), F.col("lang").alias("language"))
    bad = F.struct(F.lit("").alias("title"), F.lit("u").alias("url"), F.lit("nope").alias("seendate"), F.lit("x").alias("domain"), F.lit("y").alias("language"))
    pay = v.headlines.select("doc_id", _json(F.array(art, bad).alias("articles")).alias("payload"))
    return P.articles(pay).select("doc_id", "title", "url", us("timestamp"), "language")


@query("src_12", """SELECT event_id, 'e' || event_id AS item_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN upper(event_type) ELSE array_to_string(list_sort([upper(event_type), 'U' || user_id]), ',') END AS symbols,
 CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 ELSE event_type = 'click' END AS BIGINT) AS relevant FROM events""")
def src_12(v):
    """Tagged feed items to rows with symbols; relevance by tags, else by symbol text."""
    e = F.col("event_id")
    tag = lambda i, nm: F.struct(F.lit("tag").alias("type"), F.lit(i).alias("id"), F.struct(nm.alias("name")).alias("attributes"))
    ids = F.when(e % 3 == 0, F.array().cast("array<struct<id:string>>")).when(e % 3 == 1, F.array(F.struct(F.lit("1").alias("id")))).otherwise(F.array(F.struct(F.lit("1").alias("id")), F.struct(F.lit("2").alias("id"))))
    item = F.struct(F.concat(F.lit("e"), e).alias("id"), F.struct(F.when(e % 2 == 0, "see $CLICK now").otherwise("see CLICKS").alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishOn")).alias("attributes"),
                    F.struct(F.struct(ids.alias("data")).alias("primaryTickers")).alias("relationships"))
    pay = v.t("events").select("event_id", _json(F.array(item).alias("data"), F.array(tag("1", F.col("event_type")), tag("2", F.concat(F.lit("u"), "user_id"))).alias("included")).alias("payload"))
    d = P.tagged_items(pay)
    rel = P.ticker_relevant(F.col("symbols"), F.array(F.lit("CLICK")), F.col("title"))
    return d.select("event_id", "item_id", F.array_join("symbols", ",").alias("symbols"), n(rel, "relevant"))


@query("src_13", """SELECT c_custkey, unnest(['id', 'profile_segment', 'profile_balance', 'tags_count', 'tags_first', 'orders_count', 'orders_first_n']) AS field,
 unnest([CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), '2', 'a', '1', CAST(c_nationkey AS VARCHAR)]) AS value FROM customer""")
def src_13(v):
    """Nested JSON to flat scalar fields with count and first rules."""
    c = v.t("customer")
    pay = c.select("c_custkey", _json(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("segment"), F.floor("c_acctbal").alias("balance")).alias("profile"), F.array(F.lit("a"), F.lit("b")).alias("tags"),
                                      F.array(F.struct(F.col("c_nationkey").alias("n"))).alias("orders")).alias("payload"))
    return pay.select("c_custkey", F.explode(P.flat_scalars("payload")).alias("field", "value"))


@query("src_14", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'B' || c_nationkey END AS quant_rating, CAST(c_nationkey AS VARCHAR) AS growth, CAST(NULL AS VARCHAR) AS momentum FROM customer""")
def src_14(v):
    """Rating fields by first present alias."""
    k = F.col("c_custkey") % 3
    pay = v.t("customer").select("c_custkey", F.when(k == 0, _json(F.lit("").alias("quant_rating"), F.col("c_mktsegment").alias("rating"), F.col("c_nationkey").alias("growth")))
                                 .when(k == 1, _json(F.struct(F.concat(F.lit("B"), "c_nationkey").alias("grade")).alias("quantRating"), F.col("c_nationkey").alias("growth")))
                                 .otherwise(_json(F.col("c_nationkey").alias("growth"))).alias("payload"))
    return pay.select("c_custkey", *[P.field("payload", P.RATING_FIELDS[f]).alias(f) for f in ("quant_rating", "growth", "momentum")])


@query("src_15", """SELECT o_custkey, 'Revenue' AS tag, o_orderstatus AS unit, round(arg_max(o_totalprice, (o_orderdate, o_totalprice)), 6) AS value, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS filed FROM orders GROUP BY 1, 3""")
def src_15(v):
    """Latest filed value per accounting tag and unit."""
    pay = v.t("orders").select("o_custkey", _json(F.struct(F.create_map(F.col("o_orderstatus"), F.array(F.struct(F.col("o_totalprice").alias("val"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed")))).alias("units")).alias("Revenue")).alias("payload"))
    d = P.latest_facts(P.company_facts(pay), ["o_custkey"])
    return d.select("o_custkey", "tag", "unit", r("value"), s("filed"))


@query("src_16", """SELECT o_orderkey, CASE WHEN i = 0 THEN '8-K' ELSE '10-Q' END AS form, 'sec:' || CASE WHEN i = 0 THEN '8-k' ELSE '10-q' END AS source, o_orderkey || '0' || i AS accession,
 epoch_us(((o_orderdate + CASE WHEN i = 0 THEN INTERVAL 10 HOUR ELSE INTERVAL 17 HOUR END) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS timestamp FROM orders, range(2) z(i)""")
def src_16(v):
    """Filing arrays to rows; zone-less acceptance clock is New York time."""
    at = lambda h: F.date_format(F.col("o_orderdate") + F.expr(f"interval {h} hours"), "yyyy-MM-dd'T'HH:mm:ss")
    acc = lambda i: F.concat(F.col("o_orderkey").cast("string"), F.lit(f"-0{i}"))
    pay = v.t("orders").select("o_orderkey", _json(F.array(F.lit("8-k"), F.lit("10-q")).alias("form"), F.array(acc(0), acc(1)).alias("accessionNumber"), F.array(at(10), at(17)).alias("acceptanceDateTime"), F.array(F.lit("a.htm"), F.lit("b.htm")).alias("primaryDocument")).alias("payload"))
    d = P.filings(pay)
    return d.select("o_orderkey", "form", "source", F.split("document", "/").getItem(0).alias("accession"), us("timestamp"))


@query("src_17", "SELECT ticker, epoch_us(bar_start) AS timestamp, round(open, 6) AS open, round(close, 6) AS close, volume, 'iex' AS price_feed FROM bars_hour", ("bars_hour",))
def src_17(v):
    """Bar payload rows to typed OHLCV with the feed tag."""
    bar = F.struct(F.date_format("bar_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    d = P.bar_rows(v.bars_hour.select("ticker", _json(F.array(bar).alias("bars")).alias("payload")), "iex")
    return d.select("ticker", us("timestamp"), r("open"), r("close"), "volume", "price_feed")


@query("src_18", "SELECT 'P' || p_partkey AS old_symbol, 'Q' || p_partkey AS new_symbol, CAST(DATE '2020-01-01' + CAST(p_size AS INT) AS VARCHAR) AS process_date FROM part")
def src_18(v):
    """Symbol-change rows, ordered by date then symbol."""
    d = v.t("part").select(F.concat(F.lit("P"), "p_partkey").alias("old_symbol"), F.concat(F.lit("Q"), "p_partkey").alias("new_symbol"), s(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), "process_date"))
    return d.orderBy("process_date", "old_symbol")


@query("src_19", "SELECT DISTINCT 'P' || p_partkey AS ticker FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size >= 5 AND p_type <> 'ECONOMY'")
def src_19(v):
    """Asset-master filter to a ticker list."""
    return v.t("part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & (F.col("p_size") >= 5) & (F.col("p_type") != "ECONOMY")).select(F.concat(F.lit("P"), "p_partkey").alias("ticker")).distinct()


@query("src_20", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'addition' ELSE 'deletion' END AS action, 'T' || page_id AS ticker, 'Energy' AS sector,
 epoch_us((((DATE '2024-01-01' + CAST(page_id % 300 AS INT))::TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS effective_at FROM pages""")
def src_20(v):
    """Index-change rows out of announcement tables inside whole pages."""
    row = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c], F.lit("</tr>"))
    lit = F.lit
    head = row(*[lit(x) for x in ("Effective Date", "Index Name", "Action", "Company Name", "Ticker", "GICS Sector")])
    day = F.date_format(F.date_add(lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    act = F.when(F.col("page_id") % 2 == 0, "Addition").otherwise("Deletion")
    body = row(day, lit("S&P 500®"), act, lit("Co"), F.concat(lit(" t"), "page_id"), lit("<b>Energy</b>"))
    other = row(day, lit("S&P 400"), act, lit("Co"), lit("zz"), lit("Energy"))
    page = v.t("pages").select("page_id", F.concat("html", lit('<table class="x">'), head, body, body, other, lit("</table>")).alias("html"))
    return P.index_changes(page).select("page_id", "action", "ticker", "sector", us("effective_at"))


@query("src_21", """SELECT doc_id, CAST(CAST(published AS DATE) AS VARCHAR) AS date, source AS provider FROM headlines""", ("headlines",))
def src_21(v):
    """Headline list: a row with only a time carries the last date forward; provider from the title."""
    h = v.headlines
    order = Window.partitionBy("source", F.to_date("published")).orderBy("published", "doc_id")
    first = F.row_number().over(order) == 1
    cell = F.when(first, F.date_format("published", "MMM-dd-yy hh:mma")).otherwise(F.date_format("published", "hh:mma"))
    page = h.select("doc_id", "source", "published", cell.alias("cell"), F.concat(F.lit("headline ("), "source", F.lit(") ")).alias("headline"), F.to_date("published").alias("page"))
    day = F.to_date(F.when(F.col("cell").rlike(r"^[A-Z][a-z]{2}-\d{2}-\d{2}\s"), F.split("cell", " ").getItem(0)), "MMM-dd-yy")
    run = Window.partitionBy("source", "page").orderBy("published", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = page.withColumn("day", day).withColumn("date", F.last("day", ignorenulls=True).over(run))
    return d.select("doc_id", s("date"), F.regexp_extract("headline", r"\(([^()]+)\)\s*$", 1).alias("provider"))


@query("src_22", """SELECT conv_id, turn, epoch_us(TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id AS INT))) AS timestamp, length(trim(text)) AS text_length, md5(text) AS summary_digest, CAST(turn AS DOUBLE) AS engagement_score, CAST(0 AS DOUBLE) AS engagement_comments FROM conversations""")
def src_22(v):
    """Post payloads: epoch seconds, engagement defaults, summary beside the trimmed text."""
    c = v.t("conversations")
    created = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("conv_id") * 60
    post = F.struct(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("selftext"), created.alias("created_utc"), F.col("turn").alias("score")).alias("data"))
    d = P.posts(c.select("conv_id", "turn", _json(F.struct(F.array(post).alias("children")).alias("data")).alias("payload")))
    return d.select("conv_id", "turn", us("timestamp"), n(F.length("text"), "text_length"), F.md5("summary").alias("summary_digest"), "engagement_score", "engagement_comments")


@query("src_23", """SELECT doc_id, 'alpaca:' || source AS source, epoch_us(CASE WHEN doc_id % 2 = 0 THEN published + INTERVAL 1 HOUR ELSE published END) AS timestamp, md5(CASE WHEN doc_id % 3 = 0 THEN title ELSE text END) AS text_digest FROM headlines""", ("headlines",))
def src_23(v):
    """News payload: updated time wins, content before summary."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(F.col("title").alias("headline"), F.col("title").alias("summary"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("content"), F.col("source"),
                    iso("published").alias("created_at"), F.when(F.col("doc_id") % 2 == 0, iso(F.col("published") + F.expr("interval 1 hour"))).alias("updated_at"))
    d = P.news_rows(v.headlines.select("doc_id", _json(F.array(item).alias("news")).alias("payload")))
    return d.select("doc_id", "source", us("timestamp"), F.md5("text").alias("text_digest"))


# --- sinks --------------------------------------------------------------------------------------------------------
def good_bars(v):
    return v.bars_hour.select("ticker", "bar_start", "open", "high", "low", "close", "volume", "available_at")


def write_bars(v):
    path = scratch_path(v.spark, "artifact")
    b = good_bars(v)
    K.write_artifact(b, path, "bars", audit(b, {"ohlcv": "high < low"}, {"identity": ["ticker", "bar_start"]}), "available_at", production=True)
    return path


@query("snk_01", "SELECT 'bars' AS artifact_type, count(*) AS rows, epoch_us(min(available_at)) AS first_available_at, epoch_us(max(available_at)) AS last_available_at, 1::BIGINT AS production_ready FROM bars_hour", ("bars_hour",))
def snk_01(v):
    """Audited artifact write; the manifest row."""
    m = v.spark.read.parquet(write_bars(v) + "/manifest")
    return m.select("artifact_type", "rows", us("first_available_at"), us("last_available_at"), n("production_ready"))


@query("snk_02", "SELECT ticker, count(*) AS rows, round(sum(volume), 6) AS volume FROM bars_hour GROUP BY 1", ("bars_hour",))
def snk_02(v):
    """Verified load: type, columns, count and fingerprint must match the manifest."""
    d = K.load_artifact(v.spark, write_bars(v), "bars", allow_research=False)
    return d.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), r(F.sum("volume"), "volume"))


def monthly(v):
    return v.bars_supp.withColumn("month", F.date_format("date", "yyyy-MM"))


@query("snk_03", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT ticker) AS tickers FROM bars_supp GROUP BY 1", ("bars_supp",))
def snk_03(v):
    """Partitioned write by month, spread by ticker."""
    path = scratch_path(v.spark, "monthly")
    K.write_partitioned(monthly(v), path, "month", ["ticker"])
    return v.spark.read.parquet(path).groupBy(s("month")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"))


@query("snk_04", "SELECT CASE WHEN date >= DATE '2001-01-01' THEN 'replaced' WHEN date >= DATE '1998-01-01' THEN 'resumed' ELSE 'first' END AS batch, count(*) AS rows, count(DISTINCT strftime(date, '%Y-%m')) AS months FROM bars_supp GROUP BY 1", ("bars_supp",))
def snk_04(v):
    """Monthly output: first batch, resume of missing months, dynamic overwrite of chosen months."""
    path = scratch_path(v.spark, "resume")
    m = monthly(v)
    tag = lambda d, t: d.withColumn("batch", F.lit(t))
    K.write_partitioned(tag(m.where("date < date '1998-01-01'"), "first"), path, "month", ["ticker"])
    K.replace_partitions(K.missing_partitions(v.spark, tag(m, "resumed"), path, "month"), path, "month")
    K.replace_partitions(tag(m.where("date >= date '2001-01-01'"), "replaced"), path, "month")
    return v.spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("month").alias("months"))


@query("snk_05", "SELECT count(*) AS rows, 1::BIGINT AS second_write_refused FROM evidence_x WHERE decision_time > TIMESTAMP '2024-01-20'", ("evidence_x",))
def snk_05(v):
    """Immutable partition: a second write is refused."""
    from pyspark.errors import AnalysisException

    path = scratch_path(v.spark, "shadow")
    d = v.evidence.where("decision_time > timestamp '2024-01-20'").select("ticker", "group_id", "score")
    d.write.mode("errorifexists").parquet(path)
    try:
        d.write.mode("errorifexists").parquet(path)
        refused = 0
    except AnalysisException:
        refused = 1
    return v.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).withColumn("second_write_refused", F.lit(refused).cast("long"))


@query("snk_06", "SELECT regime, 2 * count(*) AS rows FROM evidence_x GROUP BY 1", ("evidence_x",))
def snk_06(v):
    """Snapshot append."""
    path = scratch_path(v.spark, "snapshots")
    d = v.evidence.select("ticker", "regime", "score")
    for _ in range(2):
        d.write.mode("append").option("header", True).csv(path)
    return v.spark.read.option("header", True).schema("ticker string, regime string, score double").csv(path).groupBy("regime").agg(F.count(F.lit(1)).alias("rows"))


@query("snk_07", "SELECT ticker, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 4 = 0 THEN 'new' ELSE 'old' END AS run, count(*) AS rows FROM bars_supp GROUP BY 1, 2", ("bars_supp",))
def snk_07(v):
    """Manifest merge: requested keys replaced, the rest kept."""
    m = v.bars_supp.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    new = m.where(F.substring("ticker", 2, 20).cast("long") % 4 == 0).withColumn("run", F.lit("new"))
    return K.merge_manifest(m.withColumn("run", F.lit("old")), new, ["ticker"]).select("ticker", "run", "rows")


@query("snk_08", "SELECT ticker, CAST(date AS VARCHAR) AS date, round(close, 6) AS close, '1d' AS timeframe, 'derived' AS source, 'sip' AS price_feed, 'all' AS adjustment FROM bars_supp", ("bars_supp",))
def snk_08(v):
    """OHLCV export with provenance columns."""
    path = scratch_path(v.spark, "ohlcv")
    out = K.export_ohlcv(v.bars_supp, "1d", "derived", "sip")
    out.write.partitionBy("timeframe").parquet(path)
    # the declared schema keeps "1d" a string; partition type inference would read it as a double
    return v.spark.read.schema(out.schema).parquet(path).select("ticker", s("date"), r("close"), s("timeframe"), "source", "price_feed", "adjustment")


@query("snk_09", """SELECT ticker, count(*) AS rows, count(close) AS with_close FROM (SELECT ticker, date, close FROM bars_user UNION ALL SELECT ticker, session, NULL FROM evidence_x) GROUP BY 1""", ("bars_user", "evidence_x"))
def snk_09(v):
    """Combined per-source datasets, training columns, summary per ticker."""
    a = v.bars_user.select("ticker", "date", "close")
    b = v.evidence.select("ticker", F.col("session").alias("date"), "score")
    return a.unionByName(b, allowMissingColumns=True).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.count("close").alias("with_close"))


@query("snk_10", "SELECT ticker, round(score, 6) AS score FROM evidence_x WHERE decision_time = (SELECT max(decision_time) FROM evidence_x)", ("evidence_x",))
def snk_10(v):
    """Live snapshot: one decision time, no label columns, unique tickers, audited before the write."""
    path = scratch_path(v.spark, "live")
    last = v.evidence.agg(F.max("decision_time").alias("decision_time"))
    d = v.evidence.join(F.broadcast(last), "decision_time").select("ticker", "decision_time", "score")  # one-row aggregate
    K.write_artifact(d, path, "live", audit(d, {"score_missing": "score is null"}, {"unique_ticker": ["ticker"]}), "decision_time")
    return K.load_artifact(v.spark, path, "live").select("ticker", r("score"))


@query("snk_11", "SELECT 'run-1' AS run_id, scope, count(*) AS rows FROM evidence_x GROUP BY 2", ("evidence_x",))
def snk_11(v):
    """Evidence output with the run id."""
    path = scratch_path(v.spark, "evidence")
    v.evidence.select("ticker", "group_id", "scope", "score", "ret").withColumn("run_id", F.lit("run-1")).write.parquet(path)
    return v.spark.read.parquet(path).groupBy("run_id", "scope").agg(F.count(F.lit(1)).alias("rows"))
