"""Addresses and networks as bits, so that a network is a prefix and a lookup an equality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
#: groups with at most one double colon; their number is checked apart
LOOSE_IPV6 = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"
IPV4_AS_IPV6 = 96


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; inside a lambda nothing else is shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text as a bigint, null when it is not an address."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).cast("bigint")
    return F.when(ip.rlike(STRICT_IPV4), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def carried(ip: Column) -> Column:
    """Four numbers as the address they count to: what exceeds 255 goes to the part before.

    Sources that count hosts write ``10.0.263.9`` for ``10.1.7.9``. Null when the text is not four numbers or the sum no address.
    """
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).cast("bigint")
    number = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    bytes_of = lambda n: F.concat_ws(".", *[F.shiftright(n, at).bitwiseAND(F.lit(255).cast("bigint")) for at in (24, 16, 8, 0)])
    return F.when(ip.rlike(r"^[0-9]{1,9}(?:\.[0-9]{1,9}){3}$"), let(number, lambda n: F.when(n < 1 << 32, bytes_of(n))))


def ipv6_digits(ip: Column) -> Column:
    """IPv6 text as 32 hexadecimal digits, null when it is not an address; no dotted endings, no zones."""
    low = F.lower(ip)
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    short = low.contains("::")
    left, right = groups(F.split_part(low, F.lit("::"), F.lit(1))), groups(F.split_part(low, F.lit("::"), F.lit(2)))
    n = F.size(left) + F.size(right)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
    valid = low.rlike(LOOSE_IPV6) & F.when(short, n <= 7).otherwise(n == 8)
    return F.when(valid, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))


def address_bits(ip: Column) -> Column:
    """128 characters 0 and 1, null when ``ip`` is no address; IPv4 is mapped into ``::ffff:0:0/96``."""
    word = lambda hexa: F.lpad(F.conv(hexa, 16, 2), 32, "0")
    v4 = F.concat(F.lit("0" * 80 + "1" * 16), F.lpad(F.conv(F.hex(ip_number(ip)), 16, 2), 32, "0"))
    v6 = let(ipv6_digits(ip), lambda d: F.concat(*[word(F.substring(d, i, 8)) for i in (1, 9, 17, 25)]))
    return F.when(ip.contains(":"), v6).otherwise(v4)


def network_prefix(network: Column) -> Column:
    """The bits that the addresses of ``a.b.c.d/n`` or ``x::y/n`` share; an address alone is its own network.

    Null when the text is no network. Bits of the address behind the prefix are ignored.
    """
    address, size = F.split_part(network, F.lit("/"), F.lit(1)), F.split_part(network, F.lit("/"), F.lit(2))
    v6 = address.contains(":")
    length = F.when(~network.contains("/"), F.lit(128)).when(
        size.rlike("^[0-9]{1,3}$"), size.cast("int") + F.when(v6, 0).otherwise(IPV4_AS_IPV6))
    return F.when(length <= 128, F.substring(address_bits(address), F.lit(1), length))
