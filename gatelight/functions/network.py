"""Client addresses out of forwarded chains, and request parameters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = f"^{_OCTET}(\\.{_OCTET}){{3}}$"
_GROUP = "^[0-9A-Fa-f]{1,4}$"
MAX_AGENT = 400


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _groups(text: Column) -> Column:
    """The colon-separated groups of a part of an address; none if the part is empty."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _without_dots(text: Column) -> Column:
    """An address whose last group is a dotted quad, with the quad as two hexadecimal groups; null if the quad is none."""
    quad = F.substring_index(text, ":", -1)

    def two(b: Column) -> Column:
        pair = lambda i: F.lower(F.hex(b[i].cast("int") * 256 + b[i + 1].cast("int")))
        return F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(quad)), pair(0), F.lit(":"), pair(2))

    return F.when(~F.contains(quad, F.lit(".")), text).when(quad.rlike(_IPV4), _let(F.split(quad, "\\."), two))


def _shortened(groups: Column) -> Column:
    """Canonical text of eight groups: no leading zeros, the first of the longest runs of two zero groups or more as two colons."""
    plain = F.array_join(F.transform(groups, lambda g: F.lower(F.regexp_replace(g, "^0{1,3}(?=.)", ""))), ":")

    def cut(text: Column) -> Column:
        out = text
        for n in range(2, 9):  # the last to match wins, so the longest run does
            run = f"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)$"
            short = F.concat(F.rtrim(F.regexp_extract(text, run, 1), F.lit(":")), F.lit("::"), F.ltrim(F.regexp_extract(text, run, 2), F.lit(":")))
            out = F.when(text.rlike(run), short).otherwise(out)
        return out

    # an address that maps a version 4 one shows it as such
    def mapped(text: Column) -> Column:
        low = "^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
        half = lambda i: F.conv(F.regexp_extract(text, low, i), 16, 10).cast("int")
        quad = F.concat_ws(".", F.floor(half(1) / 256), half(1) % 256, F.floor(half(2) / 256), half(2) % 256)
        return F.when(text.rlike(low), F.concat(F.lit("::ffff:"), quad)).otherwise(text)

    return _let(_let(plain, cut), mapped)


def ipv6(text: Column) -> Column:
    """Canonical text of an IPv6 address, null where it is none. A zone after a percent sign is kept as it is."""
    zone = F.regexp_extract(text, "%(.*)$", 1)
    zoned = F.contains(text, F.lit("%"))
    fine_zone = ~zoned | ((F.length(zone) > 0) & ~F.contains(zone, F.lit("%")))

    def parse(body: Column) -> Column:
        gaps = (F.length(body) - F.length(F.replace(body, F.lit("::"), F.lit("")))) / 2
        left, right = _groups(F.substring_index(body, "::", 1)), _groups(F.substring_index(body, "::", -1))
        gapped = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
        whole = F.when(gaps == 0, F.split(body, ":")).when((gaps == 1) & (F.size(left) + F.size(right) <= 7), gapped)
        return _let(whole, lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike(_GROUP)), _shortened(g)))

    body = F.when(F.substring_index(text, "%", 1).rlike("^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$") & ~F.contains(text, F.lit(":::")), F.substring_index(text, "%", 1))
    found = _let(_without_dots(body), parse)
    return F.when(fine_zone, F.concat(found, F.when(zoned, F.concat(F.lit("%"), zone)).otherwise(F.lit(""))))


def address(text: Column) -> Column:
    """Canonical text of an IPv4 or IPv6 address, null where it is neither."""
    return F.when(text.rlike(_IPV4), text).when(F.contains(text, F.lit(":")), ipv6(text))


def clean_hop(hop: Column) -> Column:
    """One hop without brackets or port as canonical text, or null where it is no address."""
    text = F.trim(hop)
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    bare = F.when(text.startswith("["), F.regexp_extract(text, r"^\[([^\]]*)", 1)).when(colons == 1, F.split_part(text, F.lit(":"), F.lit(1))).otherwise(text)
    return _let(bare, address)


def hops(forwarded: Column) -> Column:
    """The valid hops of a forwarded chain, left to right; an empty array where there are none."""
    cleaned = F.filter(F.transform(F.split(forwarded, ","), clean_hop), lambda h: h.isNotNull())
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def client_ip(peer: Column, chain: Column, trusted: int) -> Column:
    """struct(ip, forwarded) from the valid ``hops``: the n-th from the right if n proxies are trusted, the leftmost of a shorter chain, else the peer."""
    direct = F.struct(peer.alias("ip"), F.lit(False).alias("forwarded"))
    if trusted <= 0:
        return direct
    found = F.element_at(chain, F.greatest(F.size(chain) - trusted + 1, F.lit(1)))
    return F.when(F.size(chain) > 0, F.struct(found.alias("ip"), F.lit(True).alias("forwarded"))).otherwise(direct)


def user_agent(value: Column) -> Column:
    return F.when(F.length(value) > 0, F.substring(value, 1, MAX_AGENT))


def profile_ids(text: Column) -> Column:
    """A JSON list of ids or a comma list; null for empty text and for JSON that is no list."""
    body = F.trim(text)
    parsed = F.try_parse_json(body)
    is_list = body.startswith("[") & parsed.isNotNull()
    items = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x)), lambda x: x != "")
    other_json = parsed.isNotNull() & ~is_list
    return F.when(is_list, F.from_json(body, "array<string>")).when(F.length(body) > 0, F.when(~other_json, items))
