"""Table schemas and the guard for required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


#: Column names of the tables, in the order in which they are exported.
OBSERVATION = _strings("snapshot_id source_name retrieved_at_utc source_path sha256 indicator_type indicator source_value reason provider_timestamp country_class first_seen last_seen status notes")
COLLECTION_LOG = _strings("retrieved_at_utc source url http_status bytes sha256 path status notes")
EVIDENCE = _strings("indicator signal country evidence_source retrieved_at_utc notes")
PREFIXES = _strings("prefix evidence_source access_date notes")
DAILY_SUMMARY = _strings("source snapshot_day unique_indicators unique_ips_cidrs unique_domains_urls additions removals raw_rows")
PARSE_NOTES = _strings("path error")
REGISTRY_METADATA = _strings("country requested_date query_time retrieved_at_utc url response_file sha256 ipv4_prefixes ipv6_prefixes")
ISSUE = _strings("severity code date source detail")

#: Kinds of indicators.
KINDS = ("ip", "cidr", "domain", "url")


def require_columns(df: DataFrame, names) -> DataFrame:
    """df itself; raises if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
