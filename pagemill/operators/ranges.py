"""Addresses joined with a table of ranges: which range an address lies in, the innermost one if they nest.

Addresses are texts of bits, 32 or 128. A range is the union of a few blocks, each all addresses with one prefix, at
most two for each bit; an address lies in a range just if one of its prefixes is such a block. So the range join is an equi-join
on prefixes, and only prefixes of lengths that the table has are made: no address meets a range that does not hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.operators.joins import lookup
from pagemill.operators.safety import ip_hex, url_host
from pagemill.session import cut_lineage

BLOCKS = 500_000  # blocks up to which addresses meet them where they lie, which is counted; with more, the same join is shuffled


def ip_bits(ip: Column) -> Column:
    """The bits of an address literal; NULL for anything else."""
    word = lambda h, i: F.lpad(F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 2), 32, "0")
    return let(ip_hex(ip), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.when(F.length(h) == 8, 0).otherwise(3)), lambda i: word(h, i)), ""))


def network_ends(network: Column) -> tuple[Column, Column]:
    """Bits of the first and the last address of ``address/length``; a lone address is its own network."""
    def ends(net: Column, fill: str) -> Column:
        fits = net["length"].between(0, F.length(net["bits"])) & (net["parts"] <= 2)
        return F.when(fits, F.rpad(F.substring(net["bits"], F.lit(1), net["length"]), F.length(net["bits"]), fill))

    def read(parts: Column) -> Column:
        return let(ip_bits(F.get(parts, 0)), lambda bits: F.struct(
            bits.alias("bits"), F.coalesce(F.get(parts, 1).try_cast("int"), F.length(bits)).alias("length"), F.size(parts).alias("parts")))

    filled = lambda fill: let(let(F.split(network, "/"), read), lambda net: ends(net, fill))
    return filled("0"), filled("1")


def covering_prefixes(lo: Column, hi: Column) -> Column:
    """array<string>: the fewest prefixes whose blocks are the range from ``lo`` to ``hi`` (bits of one length); NULL where ``lo > hi``."""
    # Bits that both ends share, by halves; then lo goes on with 0 and hi with 1.
    longer = lambda n, step: F.when((n + step <= F.length(lo)) & F.startswith(hi, F.substring(lo, F.lit(1), n + step)), n + step).otherwise(n)
    shared_bits = F.aggregate(F.expr("array(64, 32, 16, 8, 4, 2, 1, 1)"), F.lit(0), longer)

    # Right of lo: wherever it has a 0 below the shared part, the block with a 1 there. Left of hi the other way round.
    def beside(x: Column, shared: Column, has: str, other: str) -> Column:
        places = F.filter(F.sequence(shared + 2, F.greatest(F.length(x), shared + 2)), lambda i: (i <= F.length(x)) & (F.substring(x, i, F.lit(1)) == has))
        return F.transform(places, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.lit(other)))

    def blocks(shared: Column) -> Column:
        inner = lambda x, fill: F.substring(x, F.lit(1), F.greatest(shared + 1, F.length(F.rtrim(x, F.lit(fill)))))
        rest = F.length(lo) - shared
        whole = F.endswith(lo, F.repeat(F.lit("0"), rest)) & F.endswith(hi, F.repeat(F.lit("1"), rest))
        both = let(F.struct(inner(lo, "0").alias("low"), inner(hi, "1").alias("high")), lambda x: F.concat(
            F.array(x["low"]), beside(x["low"], shared, "0", "1"), F.array(x["high"]), beside(x["high"], shared, "1", "0")))
        return F.when(whole, F.array(F.substring(lo, F.lit(1), shared))).otherwise(both)

    return F.when((lo <= hi) & (F.length(lo) == F.length(hi)), let(shared_bits, blocks))


def range_blocks(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The columns of ``ranges`` with ``_bits`` (of an address) and ``_prefix``, one row a block; ranges that are none give no rows."""
    blocks = ranges.withColumn("_prefix", F.explode(covering_prefixes(F.col(lo), F.col(hi))))
    return blocks.withColumn("_bits", F.length(lo))


def innermost_range(addresses: DataFrame, ranges: DataFrame, ip: str = "ip", value: str = "kind") -> DataFrame:
    """``addresses`` with ``value`` of the innermost range that holds them, NULL if none does or the text is no address.

    ``ranges``: lo, hi (bits, as ``ip_bits`` gives them) and ``value``. Of ranges that cross, the one that begins last counts, then the one
    that ends first, then the smallest value. Each address is looked up once, however many rows have it.
    """
    # Of equal ranges the smallest value counts, and of all ranges that share a block the innermost, so an address meets one row for each length
    # at most, however many ranges nest or come twice. The innermost range begins last: turn the bits of its begin, so that the smallest comes first.
    once = ranges.groupBy("lo", "hi").agg(F.min(F.struct(value)).alias("_v")).select("lo", "hi", F.col(f"_v.{value}").alias(value))
    first = F.min(F.struct(F.translate("lo", "01", "10").alias("from"), "hi", value))
    blocks = cut_lineage(range_blocks(once).groupBy("_bits", "_prefix").agg(first.alias("_first")))
    found = blocks.groupBy("_bits").agg(F.collect_set(F.length("_prefix")).alias("lengths"), F.count(F.lit(1)).alias("n")).collect()
    lengths = {r["_bits"]: sorted(r["lengths"]) for r in found}
    def prefixes(own: Column) -> Column:
        found = F.array().cast("array<string>")
        for bits, some in lengths.items():
            found = F.when(F.length(own) == bits, F.transform(F.array(*[F.lit(n) for n in some]), lambda n: F.substring(own, F.lit(1), n))).otherwise(found)
        return F.transform(found, lambda p: F.struct(F.length(own).alias("_bits"), p.alias("_prefix")))

    asked = addresses.select(F.col(ip).alias("_ip")).distinct()
    keyed = asked.select("_ip", F.explode(let(ip_bits(F.col("_ip")), prefixes)).alias("_p")).select("_ip", "_p._bits", "_p._prefix")
    met = keyed.join(F.broadcast(blocks) if sum(r["n"] for r in found) <= BLOCKS else blocks, ["_bits", "_prefix"])
    best = met.groupBy("_ip").agg(F.min("_first").alias("_best")).select("_ip", F.col(f"_best.{value}").alias(value))
    return addresses.join(best, F.col(ip) == F.col("_ip"), "left").drop("_ip")


def with_blocking_range(urls: DataFrame, ranges: DataFrame, dns: DataFrame, url: str = "url", value: str = "kind") -> DataFrame:
    """Add ``value`` of the range that holds the URL's address, or one of the addresses its host has in ``dns`` (host, ip).

    A caller's own block list: ``ranges`` as for ``innermost_range``. Of several addresses of a host the smallest value counts.
    """
    asked = urls.withColumn("_host", url_host(F.col(url)))
    hosts = asked.select("_host").distinct()
    named = hosts.join(dns.select(F.lower("host").alias("_host"), "ip"), "_host").unionByName(hosts.where(ip_hex(F.col("_host")).isNotNull()).withColumn("ip", F.col("_host")))
    held = innermost_range(named, ranges, "ip", value).where(F.col(value).isNotNull()).groupBy("_host").agg(F.min(value).alias(value))
    return lookup(asked, held, "_host").select(*urls.columns, value)
