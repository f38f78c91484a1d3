"""Lookups by network and by domain: the longest listed prefix or suffix of a value.

A range join would compare every address with every network. Networks are bit
prefixes here, so an address meets only the prefixes of the lengths that occur in
the table (at most 129), and a domain only its own parents: equality joins that
Spark can shuffle, split and broadcast by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.addresses import address_bits, network_prefix
from alertloom.session import cut_lineage


def _lengths(prefixes: DataFrame) -> Column:
    """The lengths that occur among network prefixes: at most 129 numbers."""
    found = sorted(r[0] for r in prefixes.select(F.length("prefix")).where("prefix is not null").distinct().collect())
    return F.array(*[F.lit(n) for n in found]).cast("array<int>")


def longest_network(addresses: DataFrame, networks: DataFrame, ip: str = "ip", network: str = "network") -> DataFrame:
    """``ip, network, bits``: each different address with the narrowest network that holds it.

    Addresses outside all networks, texts that are no address or no network and
    nulls have no row. Of equal networks written differently the smallest text is given.
    """
    listed = networks.select(F.col(network).alias("network"), network_prefix(F.col(network)).alias("prefix"))
    places = addresses.select(F.col(ip).alias("ip")).distinct().withColumn("all", address_bits(F.col("ip"))).where("all is not null")
    keys = places.select("ip", F.explode(F.transform(_lengths(listed), lambda n: F.substring("all", F.lit(1), n))).alias("prefix"))
    known = listed.where("prefix is not null").groupBy("prefix").agg(F.min("network").alias("network"))
    met = keys.join(known, "prefix").select("ip", "network", F.length("prefix").alias("bits"))
    return met.groupBy("ip").agg(F.max_by("network", "bits").alias("network"), F.max("bits").alias("bits"))


def parents(domain: Column) -> Column:
    """A domain in lower case and its parent domains, longest first."""
    labels = F.split(F.lower(domain), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def longest_domain(domains: DataFrame, listed: DataFrame, domain: str = "domain", name: str = "name") -> DataFrame:
    """``domain, name``: each different domain with the longest listed name that is itself or a parent of it."""
    known = listed.select(F.lower(name).alias("name")).where("name <> ''").distinct()
    places = domains.select(F.col(domain).alias("domain")).where("domain is not null").distinct()
    met = places.select("domain", F.explode(parents(F.col("domain"))).alias("name")).join(known, "name")
    return met.groupBy("domain").agg(F.max_by("name", F.length("name")).alias("name"))


def listed_values(values: DataFrame, intel: DataFrame) -> DataFrame:
    """``kind, value, listed_as``: the different values that a threat table (``kind, value``) lists.

    Values are compared in lower case. An entry of kind ip_address may be a network,
    an entry of kind domain covers its subdomains; the narrowest entry is given.
    """
    different = lambda rows: rows.select("kind", F.lower("value").alias("value")).where("value is not null").distinct()
    # written once: the parts below read them several times, and finding them in texts is dear
    asked, known = cut_lineage(different(values), "asked"), cut_lineage(different(intel), "listed")
    of = lambda rows, kind: rows.where(F.col("kind") == kind)
    exact = asked.where(~F.col("kind").isin("ip_address", "domain")).join(known, ["kind", "value"], "left_semi").select(
        "kind", "value", F.col("value").alias("listed_as"))
    # texts that are no address can be listed as they are
    odd = of(asked, "ip_address").where(address_bits(F.col("value")).isNull()).join(known, ["kind", "value"], "left_semi").select(
        "kind", "value", F.col("value").alias("listed_as"))
    nets = longest_network(of(asked, "ip_address"), of(known, "ip_address"), "value", "value").select(
        F.lit("ip_address").alias("kind"), F.col("ip").alias("value"), F.col("network").alias("listed_as"))
    names = longest_domain(of(asked, "domain"), of(known, "domain"), "value", "value").select(
        F.lit("domain").alias("kind"), F.col("domain").alias("value"), F.col("name").alias("listed_as"))
    return exact.unionByName(odd).unionByName(nets).unionByName(names)
