"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hostname(url: Column) -> Column:
    """Lower-case host, '' if the URL can't be parsed or has none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def sanitize_url(url: Column) -> Column:
    """Scheme, host, port if it isn't the scheme's own, and path; without a host, all before ? and #."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":([0-9]+)\z", 1)
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    whole = F.concat(scheme, F.lit("://"), host, F.when(own, "").otherwise(F.concat(F.lit(":"), port)), path)
    return F.coalesce(whole, F.split(F.split(url, r"\?")[0], "#")[0])


def is_outbound(url: Column) -> Column:
    """The host is there and neither this machine nor in 192.168.* or 10.*."""
    host = hostname(url)
    return (host != "") & ~host.isin("localhost", "127.0.0.1", "::1") & ~host.startswith("192.168.") & ~host.startswith("10.")


def is_restricted(url: Column) -> Column:
    """Pages that belong to the browser itself."""
    return url.rlike(r"^(chrome|chrome-extension|edge|about|devtools):")


def privacy_score(outbound: Column) -> Column:
    """100 without outbound requests, 90 up to 2, 70 up to 5, 40 beyond."""
    return F.when(outbound == 0, 100).when(outbound <= 2, 90).when(outbound <= 5, 70).otherwise(40)
