"""Client address and country from headers; IPv4 and IPv6 as ordered values.

IPv4 addresses become BIGINT. IPv6 addresses become 33 hex digits, which order
like the numbers; the extra leading digit leaves room for the successor of the
highest address.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.settings import Settings

DOTTED = r"^\d+\.\d+\.\d+\.\d+$"


def client_ip(settings: Settings) -> Column:
    """First trusted source: CDN header, proxy headers, connection."""
    sources = []
    if settings.behind_cloudflare:
        sources.append(F.trim("cf_connecting_ip"))
    if settings.trust_proxy:
        first = F.trim(F.split("x_forwarded_for", ",")[0])
        sources.append(F.when(F.col("x_forwarded_for") != "", first))
        sources.append(F.trim("x_real_ip"))
    given = [F.nullif(s, F.lit("")) for s in sources]
    return F.coalesce(*given, F.col("remote_addr"), F.lit("unknown"))


def client_country(settings: Settings) -> Column:
    sources = []
    if settings.behind_cloudflare:
        known = ~F.col("cf_ipcountry").isin("XX", "T1")
        sources.append(F.when(known, F.col("cf_ipcountry")))
    if settings.trust_geo_headers:
        sources += [F.col("cloudfront_viewer_country"), F.col("x_country_code")]
    if not sources:
        return F.lit(None).cast("string")
    return F.upper(F.coalesce(*[F.nullif(s, F.lit("")) for s in sources]))


def unmapped(ip: Column) -> Column:
    """The dotted quad inside ::ffff:a.b.c.d or ::a.b.c.d, else the text itself."""
    inner = F.regexp_extract(ip, r"(?i)^::(?:ffff:)?(\d+\.\d+\.\d+\.\d+)$", 1)
    return F.when(ip.startswith("::") & (inner != ""), inner).otherwise(ip)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a number, NULL unless it is four decimal octets."""
    octets = F.transform(F.split(ip, "\\."), lambda o: o.try_cast("int"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(ip.rlike(DOTTED) & F.forall(octets, lambda o: o <= 255), number)


def ipv4_range(start: Column, bits: Column) -> Column:
    """Struct (lo, hi) of a prefix, from its address as a number and its length;
    NULL when malformed."""
    size = F.pow(F.lit(2), 32 - bits).cast("bigint")
    lo = start - F.pmod(start, size)
    return F.when(
        start.isNotNull() & bits.between(0, 32),
        F.struct(lo.alias("lo"), (lo + size - 1).alias("hi")),
    )


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text as 33 hex digits, NULL when malformed."""
    low = F.lower(ip)
    given = F.size(F.filter(F.split(low, ":"), lambda g: g != ""))
    zeros = F.repeat(F.lit("0:"), F.greatest(8 - given, F.lit(0)).cast("int"))
    spelled = F.trim(F.replace(low, F.lit("::"), F.concat(F.lit(":"), zeros)), F.lit(":"))
    # the text between is empty unless it is eight groups of one to four digits
    groups = F.regexp_extract(spelled, "^(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4})$", 1)
    digits = F.array_join(F.transform(F.split(groups, ":"), lambda g: F.lpad(g, 4, "0")), "")
    whole = F.nullif(F.regexp_extract(digits, "^[0-9a-f]{32}$", 0), F.lit(""))
    stray = low.rlike("^:[^:]|[^:]:$|:::")
    # most addresses have no colon and end here
    return F.when(ip.contains(":") & ~stray, F.concat(F.lit("0"), whole))


def prefix_address(cidr: Column) -> Column:
    return F.substring_index(cidr, "/", 1)


def prefix_bits(cidr: Column) -> Column:
    return F.regexp_extract(cidr, r"/\s*(\d+)", 1).try_cast("int")


def ipv6_range(address: Column, bits: Column) -> Column:
    """Struct (lo, hi) of a prefix, from its address in hex digits and its
    length; NULL when malformed. Give stored columns: both are used repeatedly."""
    whole = F.floor(bits / 4).cast("int")  # digits fixed entirely by the prefix
    free = F.pmod(-bits, F.lit(4))  # free bits of the digit after them
    kept = F.substring(address, F.lit(1), whole + 1)
    digit = F.conv(F.substring(address, whole + 2, F.lit(1)), 16, 10).cast("int")
    span = F.pow(F.lit(2), free).cast("int")
    low = digit - F.pmod(digit, span)

    def bound(last: Column, fill: str) -> Column:
        edge = F.when(free > 0, F.lower(F.hex(last))).otherwise("")
        return F.rpad(F.concat(kept, edge), 33, fill)

    return F.when(
        address.isNotNull() & bits.between(0, 128),
        F.struct(bound(low, "0").alias("lo"), bound(low + span - 1, "f").alias("hi")),
    )


def next_number(value: Column) -> Column:
    return value + 1


def next_hex(value: Column) -> Column:
    """The successor of a hex number with a leading zero: trailing f digits turn
    to 0 and the digit before them goes up by one."""
    head = F.regexp_extract(value, "^(.*)([^f])(f*)$", 1)
    digit = F.regexp_extract(value, "^(.*)([^f])(f*)$", 2)
    tail = F.regexp_extract(value, "^(.*)([^f])(f*)$", 3)
    return F.concat(
        head,
        F.translate(digit, "0123456789abcde", "123456789abcdef"),
        F.repeat(F.lit("0"), F.length(tail)),
    )
