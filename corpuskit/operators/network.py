"""Which URLs and hosts may be fetched: scheme, blocked networks, robots rules."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit.functions import urls as U
from corpuskit.functions.text import strip

# --- fixed values -----------------------------------------------------------
METADATA_IPS = ("169.254.169.254",)
BLOCKED_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16",
    "::1/128", "fc00::/7", "fe80::/10",
)
# -----------------------------------------------------------------------------

# white space that ``strip`` removes and that ends no line
BLANK = r"[ \t\f\x0B]"


def url_fetchable(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the reason why a URL cannot be fetched (empty = can be fetched)."""
    return df.withColumn("error", U.fetch_error(F.col(url))).withColumn("fetchable", F.col("error") == "")


def address_key(ip: Column) -> Column:
    """Sortable text of an address: ``4`` and 8 hex digits, or ``6`` and 32 hex digits."""
    octets = F.transform(F.split(ip, r"\."), lambda o: F.lpad(F.hex(o.try_cast("int")), 2, "0"))
    sides = F.split(ip, "::")

    def groups(side: Column) -> Column:
        filled = F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")
        return F.array_join(F.transform(filled, lambda g: F.lpad(F.upper(g), 4, "0")), "")

    head, tail = groups(F.get(sides, 0)), groups(F.get(sides, 1))
    v6 = F.concat(F.rpad(head, F.lit(32) - F.length(tail), "0"), tail)
    return F.when(ip.contains(":"), F.concat(F.lit("6"), v6)).otherwise(F.concat(F.lit("4"), F.array_join(octets, "")))


def _network_range(cidr: str) -> tuple[str, str]:
    net = ipaddress.ip_network(cidr)
    digits = 8 if net.version == 4 else 32
    return tuple(f"{net.version}{int(ip):0{digits}X}" for ip in (net.network_address, net.broadcast_address))


def blocked_reason(ip: Column, networks: tuple[str, ...] = BLOCKED_NETWORKS) -> Column:
    """First rule that blocks the address, null when it is allowed."""
    key = address_key(ip)
    reason = F.when(ip.isin(*METADATA_IPS), F.lit("metadata"))
    for cidr in networks:
        low, high = _network_range(cidr)
        reason = reason.when(key.between(low, high), F.lit(cidr))
    return reason


def blocked_network_join(host_ips: DataFrame, networks: tuple[str, ...] = BLOCKED_NETWORKS) -> DataFrame:
    """One row per host: safe only when none of its addresses is in a blocked network.

    ``host_ips``: host, ip_order, ip. The reason belongs to the first blocked address.
    """
    checked = host_ips.withColumn("reason", blocked_reason(F.col("ip"), networks))
    first_bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("ip_order", "ip", "reason")))
    return checked.groupBy("host").agg(first_bad.alias("bad")).select(
        "host",
        F.col("bad").isNull().alias("safe"),
        F.col("bad.ip").alias("blocked_ip"),
        F.col("bad.reason").alias("reason"),
    )


def _bits(key: Column) -> Column:
    """``address_key`` with its digits in binary, 32 or 128 of them."""
    parts = F.sequence(F.lit(2), F.length(key) - 7, F.lit(8))
    return F.array_join(F.transform(parts, lambda i: F.lpad(F.conv(F.substring(key, i, F.lit(8)), 16, 2), 32, "0")), "")


def first_network(rows: DataFrame, networks: DataFrame, ip: str = "ip", network: str = "network", order: str = "rule_order") -> DataFrame:
    """Add ``reason``, the first network by ``order`` that holds the address, null when none does.

    ``networks`` may have any number of rows: an address is cut to the prefix lengths that occur (33 and 129 at most), and
    prefixes are joined by equality. Only those lengths come to the driver. Addresses are joined once, however often they
    occur; of networks that are listed twice the first counts; a null address is in no network.
    """
    length = F.substring_index(network, "/", -1).cast("int")
    key = address_key(F.substring_index(network, "/", 1))
    listed = networks.select(F.substring(key, 1, 1).alias("_v"), length.alias("_n"), F.substring(_bits(key), F.lit(1), length).alias("_p"), order, network)
    listed = listed.groupBy("_v", "_n", "_p").agg(F.min(F.struct(F.col(order).alias("o"), F.col(network).alias("reason"))).alias("_rule"))
    lengths = sorted(tuple(r) for r in listed.select("_v", "_n").distinct().collect())
    own = rows.select(F.col(ip).alias("_ip")).filter("_ip IS NOT NULL").distinct()
    own = own.withColumn("_key", address_key(F.col("_ip"))).select("_ip", F.substring("_key", 1, 1).alias("_v"), _bits(F.col("_key")).alias("_b"))
    if not lengths:
        return rows.withColumn("reason", F.lit(None).cast("string"))
    cuts = F.array(*[F.struct(F.lit(v).alias("_v"), F.lit(n).alias("_n")) for v, n in lengths])
    cut = own.select("_ip", "_b", "_v", F.explode(F.filter(cuts, lambda c: c["_v"] == F.col("_v"))).alias("c"))
    cut = cut.select("_ip", "_v", F.col("c._n").alias("_n"), F.expr("substring(_b, 1, c._n)").alias("_p"))
    held = cut.join(listed, ["_v", "_n", "_p"]).groupBy("_ip").agg(F.min("_rule").alias("_rule"))
    held = held.select("_ip", F.col("_rule.reason").alias("reason"))
    return rows.join(held, rows[ip] == held["_ip"], "left").drop("_ip")


def _glob_regex(pattern: Column) -> Column:
    escaped = F.regexp_replace(pattern, r"([\\.^$+(){}|])", r"\\$1")
    open_set = F.when(escaped.contains("]"), F.regexp_replace(escaped, r"\[!", "[^")).otherwise(
        F.regexp_replace(escaped, r"\[", r"\\[")
    )
    any_char = F.replace(F.replace(open_set, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit(r"(?s)\A(?:"), any_char, F.lit(r")\z"))


# Parts over which the URLs of a host (or of one of its first segments) are spread; its wildcard rules are sent to each.
SALTS = 16


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """Rules as rows: host, own, place, allow, pattern (no wildcard matches), kind and key under which URLs meet them.

    ``robots``: host, body. Rules of the agent's own groups (``own``) outrank those of ``*``; an own group without a rule
    that matches allows, so each group leaves a rule of its own below all others. Of equal patterns the last counts, the
    only one that can decide. Several bodies of a host follow each other in the order of their md5. kind ``=``: a path,
    matched by equality; ``/``: a pattern that fixes the first segment; ``*``: any other.
    """
    # a body is cut at its user-agent lines; what stands before the first belongs to "*"
    cut = F.split(F.concat(F.lit("user-agent:*\n"), "body"), rf"(?i)(?:\A|\r\n|\r|\n){BLANK}*user-agent:")
    groups = robots.select("host", F.md5("body").alias("_b"), F.posexplode(cut).alias("_g", "part")).filter("_g > 0")
    first = F.substring_index(F.regexp_replace("part", r"\r", "\n"), "\n", 1)
    named = F.lower(strip(F.substring_index(first, "#", 1))).alias("agent")
    lines = groups.select("host", "_b", "_g", named, F.posexplode(F.split("part", r"\r\n|\r|\n")).alias("_i", "line"))
    wanted = agent.lower()
    lines = lines.filter(F.col("agent").isin(wanted, "*"))
    text = strip(F.substring_index("line", "#", 1))
    head = F.col("_i") == 0
    field = F.lower(F.regexp_extract(text, r"(?i)^(allow|disallow):", 1))
    value = F.regexp_replace(strip(F.regexp_replace(text, "(?s)^[^:]*:", "")), r"\$$", "")
    parsed = lines.withColumns({"field": F.when(~head, field), "pattern": F.when(head, "").otherwise(value)})
    own = F.col("agent") == wanted
    # the first line of a group stands below all rules; the default group allows anyway
    parsed = parsed.filter((head & own) | (F.col("field") != ""))
    place = F.struct(~head, "_b", "_g", "_i", (head | (F.col("field") == "allow")).alias("allow"))
    last = parsed.groupBy("host", own.alias("own"), "pattern", head.alias("_head")).agg(F.max(place).alias("place"))
    pattern = F.col("pattern")
    segment = F.regexp_extract(F.regexp_extract(pattern, r"^[^*?\[]*", 0), "^/[^/]*/", 0)
    everything = pattern.isin("", "/")
    kind = F.when(everything, "*").when(~pattern.rlike(r"[*?\[]"), "=").when(segment != "", "/").otherwise("*")
    keyed = last.withColumns({"kind": kind, "regex": F.when(~everything, _glob_regex(pattern))})
    key = F.when(F.col("kind") == "=", pattern).when(F.col("kind") == "/", segment).otherwise("")
    return keyed.select("host", "own", "place", F.col("place.allow").alias("allow"), "pattern", "kind", key.alias("key"), "regex")


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Add ``host`` and ``allowed``: the last matching rule of the host decides, no rule allows.

    Every path of a host is judged once, however often it occurs. It meets the rules that name it by equality, those of its
    first segment, and the host's remaining wildcard rules; the last match is a partial maximum. A host that holds a third
    of all rules and URLs is spread over its paths and segments, and over SALTS parts where rules have wildcards.
    """
    placed = urls.withColumns({"host": U.url_host(F.col(url)), "_path": F.coalesce(U.url_path(F.col(url)), F.lit(""))})
    paths = placed.select("host", "_path").filter("host IS NOT NULL").distinct()
    salt = F.pmod(F.xxhash64("_path"), F.lit(SALTS)).cast("int")
    segment = F.regexp_extract("_path", "^/[^/]*/", 0)
    none = F.lit(0)
    keys = [("=", F.col("_path"), none), ("/", segment, salt), ("*", F.lit(""), salt)]
    met = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key"), s.alias("salt")) for k, v, s in keys]))
    asked = paths.select("host", "_path", met.alias("k")).select("host", "_path", "k.*").filter("key <> '' OR kind = '*'")
    salts = F.when(F.col("kind") == "=", F.array(none)).otherwise(F.sequence(none, F.lit(SALTS - 1)))
    rules = robots_rules(robots, agent).withColumn("salt", F.explode(salts))
    matches = (F.col("kind") == "=") | F.col("regex").isNull() | F.rlike("_path", "regex")
    hits = asked.join(rules, ["host", "kind", "key", "salt"]).filter(matches)
    decided = hits.groupBy("host", "_path").agg(F.max_by("allow", F.struct("own", "place")).alias("_allow"))
    own = [c for c in urls.columns if c != "host"]
    found = placed.join(decided, ["host", "_path"], "left")
    return found.select("host", *own, F.coalesce("_allow", F.lit(True)).alias("allowed"))
