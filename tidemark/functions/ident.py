"""JSON access, identities and content fingerprints."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_text(raw, *paths: str) -> Column:
    """First non-blank of several JSON paths; malformed JSON is null."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(_c(raw), p)), F.lit("")) for p in paths])


def provider_event_id(raw) -> Column:
    return json_text(raw, "$.id", "$.news_id", "$.accession_number")


def event_id(ticker, source, published, title, url, provider_id) -> Column:
    """sha256(ticker|source|provider id, or published|title|url)."""
    iso = F.date_format(_c(published), "yyyy-MM-dd'T'HH:mm:ssXXX")
    text = lambda c: F.trim(F.coalesce(_c(c), F.lit("")))
    own = F.concat_ws("|", iso, text(title), text(url))
    return F.sha2(F.concat_ws("|", F.upper(text(ticker)), F.lower(text(source)), F.coalesce(_c(provider_id), own)), 256)


def row_identity(columns: Sequence) -> Column:
    return F.sha2(F.concat_ws("|", *[_c(c).cast("string") for c in columns]), 256)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content fingerprint: row count and four exact 32-bit lane sums of row md5s.

    Map-side combinable; nothing is sorted or collected, and any engine can recompute it.
    """
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (columns or df.columns)]))
    d = df.select(h.alias("_h"))
    lanes = [F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return d.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(x).cast("string").alias(f"lane_{i}") for i, x in enumerate(lanes)])


def identity_set_hash(df: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Hash of a set of sha256 identities, the same for any row order.

    Each identity contributes 8 integer lanes of 32 bits; exact lane sums are
    combined map-side, so a set of any size never has to fit one task.
    """
    lanes = [F.conv(F.substring(ident, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    distinct = df.select(*keys, ident).distinct()
    g = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), *[F.sum(x).alias(f"_l{i}") for i, x in enumerate(lanes)])
    return g.select(*keys, "members", F.sha2(F.concat_ws("|", *[F.col(f"_l{i}").cast("string") for i in range(8)]), 256).alias("set_sha256"))
