"""Which URLs may be fetched: scheme, host and address tests with ordered reasons."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import any_of, let
from pagemill.functions.urls import url_netloc, url_scheme
from pagemill.operators.joins import lookup

# Hosts never fetched.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1"]
# Address blocks of the special-purpose registries (private, loopback,
# link-local, multicast, reserved, unspecified), and the global exceptions inside them.
BLOCKED_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32",
    "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6",
    "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
GLOBAL_EXCEPTIONS = [
    "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
]
_V4_RE = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"


def _ranges(networks: list[str]) -> Column:
    """Literal array of (lo, hi) as fixed-width hex, which sorts like the addresses."""
    rows = []
    for text in networks:
        net = ipaddress.ip_network(text)
        width = 8 if net.version == 4 else 32
        rows.append(F.struct(F.lit(f"{int(net[0]):0{width}x}").alias("lo"), F.lit(f"{int(net[-1]):0{width}x}").alias("hi")))
    return F.array(*rows)


def _v4_hex(ip: Column) -> Column:
    return F.array_join(F.transform(F.split(ip, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("bigint"))), 2, "0")), "")


def _v6_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 literal, NULL when it is none."""
    text = F.lower(F.regexp_replace(ip, "%.*$", ""))
    tail = F.regexp_extract(text, r"([\d.]+)$", 1)
    dotted = F.contains(text, F.lit("."))
    v4 = F.when(F.rlike(tail, F.lit(_V4_RE)), _v4_hex(tail))
    text = F.when(dotted, F.concat(
        F.regexp_replace(text, r"[\d.]+$", ""), F.substring(v4, 1, 4), F.lit(":"), F.substring(v4, 5, 4)
    )).otherwise(text)

    def expand(t: Column) -> Column:
        groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
        left, right = groups(F.substring_index(t, "::", 1)), groups(F.regexp_replace(t, "^.*?::", ""))
        gap = F.contains(t, F.lit("::"))
        # '::' stands for at least one group, so an address that has it spells out at most seven.
        fits = F.size(left) + F.size(right) <= 7
        full = F.when(gap & fits, F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)).when(
            ~gap, F.split(t, ":")
        )
        shaped = F.rlike(t, F.lit(r"^(?:[0-9a-f]{1,4}(?::|$)|::?)+$")) & ~F.rlike(t, F.lit(r":::|::.*::|^:[^:]|[^:]:$"))
        return let(full, lambda g: F.when(
            shaped & (F.size(g) == 8) & F.forall(g, lambda x: F.rlike(x, F.lit("^[0-9a-f]{1,4}$"))),
            F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""),
        ))

    return F.when(F.contains(ip, F.lit(":")), let(text, expand))


def ip_hex(ip: Column) -> Column:
    """8 or 32 hex digits of an address literal, NULL for anything else."""
    return F.when(F.rlike(ip, F.lit(_V4_RE)), _v4_hex(ip)).otherwise(_v6_hex(ip))


def _unsafe_hex(h: Column) -> Column:
    # An IPv4 address written inside IPv6 is judged as IPv4 for its scope.
    inside = lambda nets: F.exists(_ranges(nets), lambda r: (F.length(r["lo"]) == F.length(h)) & h.between(r["lo"], r["hi"]))
    return F.when(h.isNotNull(), inside(BLOCKED_NETWORKS) & ~inside(GLOBAL_EXCEPTIONS))


def is_unsafe_ip(ip: Column) -> Column:
    """True for an address inside a blocked block; NULL when the text is no address."""
    return let(ip_hex(ip), _unsafe_hex)


def url_host(url: Column) -> Column:
    """Lower-case host name of a URL without user, port or brackets."""
    def host(netloc: Column) -> Column:
        bracketed = F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)
        return F.lower(F.when(F.startswith(netloc, F.lit("[")), bracketed).otherwise(F.substring_index(netloc, ":", 1)))

    return let(F.regexp_replace(url_netloc(url), "^.*@", ""), host)


def _told_by_url(url: Column) -> Column:
    """struct<host, literal, own>: the host, whether it is an address, and the reason known from the URL alone; each is found once."""
    def reason(u: Column) -> Column:
        return (
            F.when(~u["scheme"].isin("http", "https"), F.concat(F.lit("Unsupported scheme: "), u["scheme"]))
            .when(u["host"] == "", "URL has no hostname")
            .when(any_of(u["host"], BLOCKED_HOSTS), F.concat(F.lit("Blocked host: "), u["host"]))
            .when(_unsafe_hex(u["hex"]), F.concat(F.lit("Blocked internal/private IP: "), u["host"]))
        )

    parts = F.struct(url_scheme(url).alias("scheme"), url_host(url).alias("host"))
    read = let(parts, lambda p: F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), ip_hex(p["host"]).alias("hex")))
    return let(read, lambda u: F.struct(u["host"].alias("host"), u["hex"].isNotNull().alias("literal"), reason(u).alias("own")))


def url_reject_reason(url: Column) -> Column:
    """Reason known from the URL alone; NULL when the host has to be looked up or is fine."""
    return _told_by_url(url)["own"]


def with_reject_reason(urls: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """Add ``reject_reason``. ``dns``: (host, ip), any number of rows per host.

    The address table is folded to one row per host before the join.
    """
    hosts = dns.groupBy(F.lower("host").alias("_host")).agg(
        F.min(F.when(F.coalesce(is_unsafe_ip(F.col("ip")), F.lit(True)), F.col("ip"))).alias("_bad"), F.lit(True).alias("_known")
    )
    # Rejected URLs and address literals have no host to look up: their NULL key meets no row. A row is told once: exploded, so that
    # its parts are not put in place of the columns that are made of them.
    told = urls.select("*", F.explode(F.array(_told_by_url(F.col(url)))).alias("_told")).select(
        *urls.columns, F.col("_told.own").alias("_own"), F.col("_told.literal").alias("_literal"), F.col("_told.host").alias("_all_hosts"))
    asked = told.withColumn("_host", F.when(F.col("_own").isNull() & ~F.col("_literal"), F.col("_all_hosts"))).drop("_all_hosts")
    joined = lookup(asked, hosts, "_host")
    return joined.withColumn(
        "reject_reason",
        F.when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_literal"), F.lit(None))
        .when(F.col("_known").isNull(), F.concat(F.lit("DNS resolution failed for "), F.col("_host")))
        .when(F.col("_bad").isNotNull(), F.concat(F.lit("Blocked internal/private IP: "), F.col("_bad"))),
    ).select(*urls.columns, "reject_reason")


def public_urls(urls: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    return with_reject_reason(urls, dns, url).where(F.col("reject_reason").isNull()).drop("reject_reason")
