"""Archived provider payloads (a JSON or HTML column) to typed rows.

Each function takes a DataFrame of payloads and explodes inside the row, so
work is spread by payload and nothing is grouped.
"""
from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import ET, et_instant, strict_instant
from tidemark.functions.text import social_mention


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def articles(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Article lists: title, url and a parsable time are required."""
    schema = "struct<articles: array<struct<title:string,url:string,seendate:string,domain:string,language:string,snippet:string>>>"
    a = df.select("*", F.explode(F.from_json(payload, schema)["articles"]).alias("_a")).drop(payload)
    t = F.coalesce(F.try_to_timestamp("_a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")), strict_instant("_a.seendate"))
    out = a.withColumns({
        "ticker": F.lit("MARKET"), "timestamp": t, "source": F.lit("gdelt:doc"), "title": _blank(F.col("_a.title")), "url": _blank(F.col("_a.url")),
        "summary": F.coalesce("_a.snippet", "_a.seendate"), "domain": F.trim("_a.domain"), "language": F.trim("_a.language")})
    return out.where("title is not null and url is not null and timestamp is not null").withColumn("text", F.col("title")).drop("_a")


def tagged_items(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Feed items with the symbols their tag ids resolve to through ``included``."""
    schema = ("struct<data: array<struct<id:string, attributes: struct<title:string,publishOn:string>, relationships: struct<primaryTickers: struct<data: array<struct<id:string>>>,"
              "secondaryTickers: struct<data: array<struct<id:string>>>>>>, included: array<struct<type:string,id:string,attributes: struct<name:string,slug:string,symbol:string,ticker:string>>>>")
    p = df.withColumn("_p", F.from_json(payload, schema)).drop(payload)
    tags = F.map_from_entries(F.transform(
        F.filter("_p.included", lambda t: (t["type"] == "tag") & F.coalesce(t["attributes"]["name"], t["attributes"]["slug"], t["attributes"]["symbol"], t["attributes"]["ticker"]).isNotNull()),
        lambda t: F.struct(t["id"], F.upper(F.coalesce(t["attributes"]["name"], t["attributes"]["slug"], t["attributes"]["symbol"], t["attributes"]["ticker"])))))
    items = p.withColumn("_tags", tags).select("*", F.explode("_p.data").alias("_i")).drop("_p")
    rel = lambda k: F.coalesce(F.col(f"_i.relationships.{k}.data"), F.array().cast("array<struct<id:string>>"))
    ids = F.concat(rel("primaryTickers"), rel("secondaryTickers"))
    symbols = F.array_sort(F.array_distinct(F.array_compact(F.transform(ids, lambda x: F.element_at(F.col("_tags"), x["id"])))))
    return items.withColumns({"item_id": F.col("_i.id"), "title": F.col("_i.attributes.title"), "timestamp": strict_instant("_i.attributes.publishOn"), "symbols": symbols}).drop("_i", "_tags")


def ticker_relevant(symbols: Column, aliases: Column, title: Column) -> Column:
    """Tag overlap decides when tags exist; otherwise explicit symbol text."""
    up = F.upper(title)
    text = F.exists(aliases, lambda a: F.regexp_like(up, F.concat(F.lit(r"(?<![A-Z0-9])\$?\Q"), a, F.lit(r"\E(?![A-Z0-9])"))))
    return F.when(F.size(symbols) > 0, F.arrays_overlap(symbols, aliases)).otherwise(text)


def _flatten(text: str, max_depth: int, max_fields: int) -> dict[str, str]:
    try:
        todo = [("", json.loads(text), 0)]
    except (TypeError, ValueError):
        return {}
    out: dict[str, str] = {}
    while todo and len(out) < max_fields:
        name, value, depth = todo.pop()
        if isinstance(value, dict):
            if depth <= max_depth:
                keys = [(re.sub(r"[^A-Za-z0-9_]+", "_", str(k)).strip("_"), v) for k, v in value.items()]
                todo.extend((f"{name}_{k}" if name else k, v, depth + isinstance(v, dict)) for k, v in reversed(keys) if k)
        elif isinstance(value, list):
            out[f"{name}_count" if name else "record_count"] = str(len(value))
            if value and depth < max_depth:
                todo.append((f"{name}_first" if name else "first", value[0], depth + 1))
        elif name:
            out[name] = "" if value is None else json.dumps(value) if isinstance(value, bool) else str(value)
    return out


def flat_scalars(payload: str = "payload", max_depth: float = math.inf, max_fields: float = math.inf) -> Column:
    """Nested JSON to a flat map: ``a_b`` for scalars, ``a_count`` and ``a_first_*`` for lists."""

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _flatten(t, max_depth, max_fields))

    return run(F.col(payload))


# Accepted spellings of each rating and earnings field, in order.
RATING_FIELDS = {
    "quant_rating": ("quant_rating", "quantRating", "rating", "overall"), "valuation": ("valuation", "value"), "growth": ("growth",),
    "profitability": ("profitability",), "momentum": ("momentum",), "eps_revision": ("eps_revision", "epsRevisions", "revisions"),
}
EARNINGS_FIELDS = {
    "eps_actual": ("eps_actual", "epsActual", "actualEPS", "eps"), "eps_estimate": ("eps_estimate", "epsEstimate", "consensusEPS", "estimateEPS"),
    "earnings_date": ("earnings_date", "earningsDate", "reportDate", "date"), "fiscal_period": ("fiscal_period", "fiscalPeriod", "period", "quarter"),
}


def field(payload: str, names) -> Column:
    """First alias with a value, keys in any case; of keys that differ in case only, the last counts.

    An object contributes its value, grade or rating and ends the search, also without any of them.  A payload that is no
    object gives null.
    """
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))
    at = lambda n: F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n.lower()), F.lit(-1))["value"]
    out = F.lit(None).cast("string")
    for n in reversed(names):
        raw = at(n)
        inner = F.coalesce(*[_blank(F.get_json_object(raw, f"$.{k}")) for k in ("value", "grade", "rating")])
        out = F.when(raw.startswith("{"), inner).when(_blank(raw).isNotNull(), raw).otherwise(out)
    return out


def company_facts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Fact lists to rows (tag, unit, value, filed)."""
    schema = "map<string, struct<units: map<string, array<struct<val:double,filed:date>>>>>"
    t = df.select("*", F.explode(F.from_json(payload, schema))).drop(payload).withColumnsRenamed({"key": "tag", "value": "_v"})
    u = t.select("*", F.explode("_v.units")).drop("_v").withColumnsRenamed({"key": "unit", "value": "_v"})
    return u.select("*", F.explode("_v").alias("_e")).drop("_v").withColumns({"val": F.col("_e.val"), "filed": F.col("_e.filed")}).drop("_e")


def latest_facts(rows: DataFrame, keys) -> DataFrame:
    return rows.where("val is not null and filed is not null").groupBy(*keys, "tag", "unit").agg(F.max_by("val", F.struct("filed", "val")).alias("value"), F.max("filed").alias("filed"))


def filings(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Parallel filing arrays to rows; a zone-less acceptance clock is New York time."""
    schema = "struct<form: array<string>, accessionNumber: array<string>, acceptanceDateTime: array<string>, primaryDocument: array<string>>"
    p = df.withColumn("_p", F.from_json(payload, schema)).drop(payload)
    z = p.select("*", F.explode(F.arrays_zip("_p.form", "_p.accessionNumber", "_p.acceptanceDateTime", "_p.primaryDocument")).alias("_z")).drop("_p")
    raw = F.col("_z.acceptanceDateTime")
    t = F.coalesce(strict_instant(raw), F.to_utc_timestamp(F.try_to_timestamp(raw), ET))
    form = F.upper(F.coalesce("_z.form", F.lit("")))
    return z.withColumns({"form": form, "accession_number": F.col("_z.accessionNumber"), "timestamp": t, "source": F.concat(F.lit("sec:"), F.lower(form)),
                          "document": F.concat_ws("/", F.replace(F.col("_z.accessionNumber"), F.lit("-"), F.lit("")), F.col("_z.primaryDocument"))}).drop("_z").where("timestamp is not null")


def bar_rows(df: DataFrame, feed: str, payload: str = "payload") -> DataFrame:
    schema = "struct<bars: array<struct<t:string,o:double,h:double,l:double,c:double,v:double>>>"
    b = df.select("*", F.explode(F.from_json(payload, schema)["bars"]).alias("_b")).drop(payload)
    return b.withColumns({"timestamp": strict_instant("_b.t"), "open": F.col("_b.o"), "high": F.col("_b.h"), "low": F.col("_b.l"), "close": F.col("_b.c"), "volume": F.col("_b.v"),
                          "price_feed": F.lit(feed)}).drop("_b")


def index_changes(df: DataFrame, html: str = "html") -> DataFrame:
    """Addition/deletion rows of announcement tables whose header has the required columns.

    Tables, rows and cells are split by pattern inside the row; the page hash and
    the New York midnight of the effective date are attached, and equal
    (time, action, ticker) rows of a page collapse.
    """
    from tidemark.functions.clean import ticker as clean_ticker

    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)),
                                    lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")))
    t = df.withColumn("_t", F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))))
    t = t.withColumn("_rows", F.transform(F.regexp_extract_all("_t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells))
    head = F.element_at("_rows", 1)
    need = ("Effective Date", "Index Name", "Action", "Company Name", "Ticker", "GICS Sector")
    t = t.where((F.size("_rows") > 1) & F.array_contains(F.transform(F.array(*[F.lit(x) for x in need]), lambda x: F.array_contains(F.element_at(F.col("_rows"), 1), x)), F.lit(False)).__invert__())
    t = t.withColumns({"_h": head, "page_sha256": F.sha2(html, 256)}).select("*", F.explode(F.slice("_rows", F.lit(2), F.greatest(F.size("_rows"), F.lit(0)))).alias("_r")).where(F.size("_r") >= F.size("_h"))
    at = lambda name: F.element_at("_r", F.array_position("_h", F.lit(name)).cast("int"))
    out = t.withColumns({
        "_index": F.trim(F.replace(at("Index Name"), F.lit("®"), F.lit(""))), "action": F.lower(at("Action")), "ticker": clean_ticker(at("Ticker")), "company": at("Company Name"),
        "sector": at("GICS Sector"), "effective_at": et_instant(F.to_date(at("Effective Date")))})
    out = out.where((F.col("_index") == "S&P 500") & F.col("action").isin("addition", "deletion")).drop("_t", "_rows", "_h", "_r", "_index", html)
    ids = [c for c in df.columns if c != html]
    return out.dropDuplicates([*ids, "effective_at", "action", "ticker"])


def posts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Posts with engagement, epoch seconds to UTC, the whole text as summary."""
    schema = "struct<data: struct<children: array<struct<data: struct<id:string,title:string,selftext:string,created_utc:double,score:double,num_comments:double,upvote_ratio:double,permalink:string>>>>>"
    c = df.select("*", F.explode(F.from_json(payload, schema)["data"]["children"]).alias("_c")).drop(payload)
    d = F.col("_c.data")
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return c.withColumns({
        "post_id": d["id"], "timestamp": F.timestamp_micros((d["created_utc"] * 1_000_000).cast("long")), "title": F.coalesce(d["title"], F.lit("")), "summary": d["selftext"],
        "text": F.trim(F.concat_ws(" ", d["title"], d["selftext"])), "engagement_score": z(d["score"]), "engagement_comments": z(d["num_comments"]), "engagement_upvote_ratio": z(d["upvote_ratio"])}).drop("_c")


def matching_comments(comments: DataFrame, body: str, ticker, stopped) -> DataFrame:
    return comments.where(social_mention(body, ticker, stopped))


def news_rows(df: DataFrame, payload: str = "payload") -> DataFrame:
    """News list: time = updated, else created; text = content, else summary."""
    schema = "struct<news: array<struct<id:string,headline:string,summary:string,content:string,source:string,url:string,created_at:string,updated_at:string>>>"
    n = df.select("*", F.explode(F.from_json(payload, schema)["news"]).alias("_n")).drop(payload)
    return n.withColumns({
        "timestamp": strict_instant(F.coalesce(_blank(F.col("_n.updated_at")), "_n.created_at")), "source": F.concat(F.lit("alpaca:"), F.coalesce("_n.source", F.lit("unknown"))),
        "title": F.coalesce("_n.headline", F.lit("")), "summary": F.col("_n.summary"), "text": F.coalesce(_blank(F.col("_n.content")), "_n.summary")}).drop("_n")
