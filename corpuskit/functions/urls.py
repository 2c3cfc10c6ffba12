"""URL functions as native Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.text import strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(strip(url), _SCHEME, 1))


def url_host(url: Column) -> Column:
    """Network location including the port, empty when there is none."""
    return F.coalesce(F.regexp_extract(url, _NETLOC, 1), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, _PATH, 1), F.lit("")), F.lit("/"))


def _host_and_port(url: Column) -> tuple[Column, Column]:
    address = F.regexp_replace(F.regexp_extract(url, _NETLOC, 1), "^.*@", "")
    host = F.regexp_extract(address, r"^(\[[^\]]*\]|[^:]*)", 1)
    return F.lower(F.regexp_replace(host, r"[\[\]]", "")), F.regexp_extract(address, r":(\d+)$", 1).try_cast("int")


def url_hostname(url: Column) -> Column:
    return _host_and_port(strip(url))[0]


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.regexp_replace(c, r"\+", " "))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _sorted_query(query: Column) -> Column:
    filled = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    pairs = F.transform(
        filled,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encode(p.k), F.lit("="), _encode(p.v))), "&")


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, sorted query without blanks."""
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    host, port = _host_and_port(u)
    default = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443)) | (port == 0)
    netloc = F.when(port.isNull() | default, host).otherwise(F.concat(host, F.lit(":"), port.cast("string")))
    path = url_path(u)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = _sorted_query(F.regexp_extract(u, _QUERY, 1))
    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))),
        F.when(netloc == "", "").otherwise(F.concat(F.lit("//"), netloc)),
        path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def url_key(url: Column) -> Column:
    """Canonical URL as a key; null for an empty URL, which equals no other."""
    return F.when(F.coalesce(url, F.lit("")) != "", canonicalize_url(url))


def fetch_error(url: Column) -> Column:
    """Why a URL cannot be fetched; empty when scheme and host are fine."""
    scheme = F.regexp_extract(strip(url), _SCHEME, 1)
    shown = F.coalesce(F.nullif(F.lower(scheme), F.lit("")), F.lit("(无 scheme)"))
    return (
        F.when(F.coalesce(strip(url), F.lit("")) == "", "URL 为空")
        .when(~F.lower(scheme).isin("http", "https"), F.concat(F.lit("仅支持 http/https，收到: "), shown))
        .when(url_hostname(url) == "", "缺少主机名")
        .otherwise("")
    )
