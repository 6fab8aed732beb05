"""Addresses and networks as column expressions.

A network is the string of its leading bits ('0' and '1'): one network holds
another exactly if its bits begin the other's.  Truncation is substring, and a
containment join is an equality join on truncated bits.  Both versions are
handled with native expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Dotted text, with a prefix length or not, that is canonical unless it has host bits.
_PLAIN_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?:/(?:[0-9]|[12][0-9]|3[0-2]))?$"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
#: Bits of an address of each version.
WIDTH = {4: 32, 6: 128}


def is_ipv4(value: Column) -> Column:
    return value.rlike(_V4)


def ipv4_bits(value: Column) -> Column:
    """The 32 bits of dotted text that `is_ipv4` accepts."""
    octet = lambda k: F.substring_index(F.substring_index(value, ".", k), ".", -1).try_cast("bigint")
    return F.lpad(F.bin(((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4)), 32, "0")


def ipv4_text(bits: Column) -> Column:
    """Dotted text of leading bits, the rest zero."""
    full = F.rpad(bits, 32, "0")
    return F.concat_ws(".", *(F.conv(F.substring(full, 8 * k + 1, 8), 2, 10) for k in range(4)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: it is bound as the variable of a lambda, not repeated in the tree."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv6_bits(value: Column) -> Column:
    """The 128 bits of IPv6 text, null if it is none.  A dotted tail counts as two groups; zone ids are refused."""
    tail = F.regexp_extract(value, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    group = lambda bits, a: F.lower(F.conv(F.substring(bits, a, 16), 2, 16))
    dotted = let(ipv4_bits(tail), lambda t: F.concat(F.regexp_replace(value, r"[0-9.]+$", ""), group(t, 1), F.lit(":"), group(t, 17)))
    v = F.when(tail == "", value).when(is_ipv4(tail), dotted)
    groups = lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":"))

    def filled(sides: Column) -> Column:
        left, right = sides["l"], sides["r"]
        missing = 8 - F.size(left) - F.size(right)
        return F.when(sides["n"] == 1, left).when((sides["n"] == 2) & (missing >= 1), F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def bits(full: Column) -> Column:
        good = (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(good, F.array_join(F.transform(full, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

    sides = lambda h: F.struct(groups(h[0]).alias("l"), groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("r"), F.size(h).alias("n"))
    return let(v, lambda t: F.when(t.isNotNull(), let(let(F.split(t, "::"), sides), lambda x: let(filled(x), bits))))


def ipv6_text(bits: Column) -> Column:
    """Compressed text of leading bits: the first longest run of two or more zero groups becomes '::'."""

    def shorten(text: Column) -> Column:
        """':1:0:0:2:' as '1::2': the longest run of zero groups goes, the first of equal ones."""
        runs = F.regexp_extract_all(text, F.lit("(?<=:)((?:0:){2,})"), F.lit(1))
        longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))

        def cut(run: Column) -> Column:
            at = F.position(F.concat(F.lit(":"), run), text)
            head, rest = F.substring(text, F.lit(2), at - 2), F.substring(text, at + F.length(run) + 1, F.length(text))
            return F.when(run == "", F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(F.concat(head, F.lit("::"), F.regexp_replace(rest, ":$", "")))

        return let(longest, cut)

    def text(full: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lower(F.conv(F.substring(full, 16 * k + 1, F.lit(16)), 2, 16)))
        plain = let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), shorten)
        return F.when(full.startswith("0" * 80 + "1" * 16), F.concat(F.lit("::ffff:"), ipv4_text(F.substring(full, 97, 32)))).otherwise(plain)

    return let(F.rpad(bits, 128, "0"), text)


def _mask_length(mask: Column) -> Column:
    """Prefix length of a netmask or hostmask in dotted text, else null."""
    ones = lambda b: F.length(F.regexp_replace(b, "0", ""))
    return let(ipv4_bits(mask), lambda b: F.when(b.rlike("^1*0*$"), ones(b)).when(b.rlike("^0*1*$"), 32 - ones(b)))


def parsed(value: Column) -> Column:
    """struct(kind, version, bits, text, host_bits) of an address or network; null if it is neither.

    Host bits beyond the prefix length are masked and noted.  Leading zeros in
    octets are refused.  Plain dotted text, nearly all there is, takes a few
    expressions without lambdas; only other text goes the long way.
    """
    v = F.trim(value)
    slash = v.contains("/")
    address, size = ipv4_bits(F.substring_index(v, "/", 1)), F.substring_index(v, "/", -1).try_cast("int")
    leading, host = F.substring(address, F.lit(1), size), slash & F.substring(address, size + 1, F.lit(32)).contains("1")
    # only networks are cut and looked through for host bits: an address's bits are computed once
    plain = F.struct(
        F.when(slash, "cidr").otherwise("ip").alias("kind"), F.lit(4).alias("version"), F.when(slash, leading).otherwise(ipv4_bits(v)).alias("bits"),
        F.when(host, F.concat(ipv4_text(leading), F.lit("/"), size.cast("string"))).otherwise(v).alias("text"), host.alias("host_bits"),
    )
    return F.when(v.rlike(_PLAIN_V4), plain).otherwise(_parsed_any(v))


def is_parsed(value: Column) -> Column:
    """Whether `parsed` gives something: as a filter it costs plain dotted text one match, not its parts."""
    return F.coalesce(F.trim(value).rlike(_PLAIN_V4), F.lit(False)) | _parsed_any(F.trim(value)).isNotNull()


def _parsed_any(value: Column) -> Column:
    """The same for text of every form."""

    def described(x: Column) -> Column:
        """x: struct(version, all bits of the address, prefix length or null)."""
        plain = x["size"].isNull()
        width = F.when(x["version"] == 4, 32).otherwise(128)
        bits = F.substring(x["address"], F.lit(1), F.coalesce(x["size"], width))
        text = F.when(x["version"] == 4, ipv4_text(bits)).otherwise(ipv6_text(bits))
        return F.struct(
            F.when(plain, "ip").otherwise("cidr").alias("kind"),
            x["version"].alias("version"),
            bits.alias("bits"),
            F.concat(text, F.when(plain, "").otherwise(F.concat(F.lit("/"), x["size"].cast("string")))).alias("text"),
            F.substring(x["address"], F.coalesce(x["size"], width) + 1, F.lit(128)).contains("1").alias("host_bits"),
        )

    def split(parts: Column) -> Column:
        address, length = parts[0], F.get(parts, F.lit(1))
        four, six = is_ipv4(address), address.contains(":")
        number = F.when(length.rlike(r"^[0-9]{1,4}$"), length.try_cast("int")).when(four & is_ipv4(length), _mask_length(length))
        bits = F.when(four, ipv4_bits(address)).when(six, ipv6_bits(address))
        return F.struct(F.when(four, 4).otherwise(6).alias("version"), bits.alias("address"), number.alias("size"), F.size(parts).alias("n"))

    def checked(x: Column) -> Column:
        most = F.when(x["version"] == 4, 32).otherwise(128)
        ok = x["address"].isNotNull() & ((x["n"] == 1) | ((x["n"] == 2) & F.coalesce(x["size"].between(0, most), F.lit(False))))
        return F.when(ok, described(x))

    return let(let(F.split(F.trim(value), "/"), split), checked)


def n_addresses(version: Column, bits: Column) -> Column:
    """Addresses in a network, as decimal; null where decimal(38) cannot hold it (IPv6 wider than /2)."""
    free = F.when(version == 4, 32).otherwise(128) - F.length(bits)
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")).cast("decimal(19,0)")
    first, second = F.least(free, F.lit(62)), F.least(F.greatest(free - 62, F.lit(0)), F.lit(62))
    third = F.greatest(free - 124, F.lit(0))
    six = F.when(free <= 126, (power(first) * power(second)).cast("decimal(38,0)") * power(third).cast("decimal(1,0)")).cast("decimal(38,0)")
    return F.when(version == 4, F.call_function("shiftleft", F.lit(1).cast("long"), free).cast("decimal(38,0)")).otherwise(six)


def network_text(version: Column, bits: Column) -> Column:
    """CIDR text of leading bits."""
    return F.concat(F.when(version == 4, ipv4_text(bits)).otherwise(ipv6_text(bits)), F.lit("/"), F.length(bits).cast("string"))


def minimal(blocks: Column) -> Column:
    """The least list of networks that covers the same addresses as an array of disjoint ones, in address order.

    Blocks are pushed in order; while the last two are the halves of one network they are joined.
    """

    def halves(s: Column) -> Column:
        a, b = F.get(s, F.size(s) - 2), F.get(s, F.size(s) - 1)
        return (F.size(s) > 1) & (F.length(a) == F.length(b)) & (F.length(a) > 0) & (F.substring(a, F.lit(1), F.length(a) - 1) == F.substring(b, F.lit(1), F.length(b) - 1))

    def joined(s: Column) -> Column:
        a = F.get(s, F.size(s) - 1)
        return F.concat(F.slice(s, F.lit(1), F.size(s) - 2), F.array(F.substring(a, F.lit(1), F.length(a) - 1)))

    def push(stack: Column, block: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(block), F.lit(1))), F.concat(stack, F.array(block)), lambda s, _: F.when(F.coalesce(halves(s), F.lit(False)), joined(s)).otherwise(s))

    return F.aggregate(F.array_sort(blocks), F.array().cast("array<string>"), push)


def range_networks(version: Column, low: Column, after: Column) -> Column:
    """The least list of networks, as leading bits in address order, of the addresses from low up to before `after`.

    Both are all bits of an address; `after` may be '2', the end of the address
    space.  Below the common beginning of both, each 0 of low before its trailing
    zeros and each 1 of `after` is one network, so there are at most two a bit.
    No address gives an empty list.
    """
    width = F.when(version == 4, 32).otherwise(128) + 1

    def networks(x: Column) -> Column:
        lo, hi = x["lo"], x["hi"]
        bit = lambda text, i: F.substring(text, i, F.lit(1))
        upto = lambda text, i: F.substring(text, F.lit(1), i)
        places = F.sequence(F.lit(1), width)

        def cut(split: Column) -> Column:
            """split: the first bit in which both differ."""
            last = width + 1 - F.locate("1", F.reverse(lo))  # of low; its trailing zeros are one network
            inner = F.reverse(F.filter(places, lambda i: (i > split) & (i < last) & (bit(lo, i) == "0")))
            left = F.when(~F.substring(lo, split + 1, width).contains("1"), F.array(upto(lo, split))).otherwise(F.concat(F.array(upto(lo, last)), F.transform(inner, lambda i: F.concat(upto(lo, i - 1), F.lit("1")))))
            right = F.transform(F.filter(places, lambda i: (i > split) & (bit(hi, i) == "1")), lambda i: F.concat(upto(hi, i - 1), F.lit("0")))
            return F.transform(F.concat(left, right), lambda b: F.substring(b, F.lit(2), width))

        return F.when(lo < hi, let(F.array_position(F.transform(places, lambda i: bit(lo, i) != bit(hi, i)), F.lit(True)).cast("int"), cut)).otherwise(F.array().cast("array<string>"))

    ends = F.struct(F.concat(F.lit("0"), low).alias("lo"), F.when(after == "2", F.rpad(F.lit("1"), width, "0")).otherwise(F.concat(F.lit("0"), after)).alias("hi"))
    return let(ends, networks)
