"""Acceptance test for web addresses, close to what browsers accept."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: code points a host may not hold, and escapes that decode to one
FORBIDDEN_HOST = r"\x00-\x20\x7F#%/:<>?@\[\\\]^|"
FORBIDDEN_ESCAPES = "20|23|25|2[fF]|3[aAcCeEfF]|40|5[b-eB-E]|7[cCfF]"

_PORT = r"(:(0*(6553[0-5]|655[0-2]\d|65[0-4]\d\d|6[0-4]\d{3}|[1-5]\d{4}|\d{1,4}))?)?"
_ESCAPE = rf"%(?!{FORBIDDEN_ESCAPES})[2-9a-fA-F][0-9a-fA-F]"
_NAME = rf"([^{FORBIDDEN_HOST}]|{_ESCAPE})+"
_IPV6 = r"\[[0-9a-fA-F]*:[0-9a-fA-F:.]*\]"
# plain host names, which most values are, need no closer look
COMMON = r"^(https?://)?([a-zA-Z0-9-]+\.)+[a-zA-Z]+(/[!-~]*)?\z"


def _number(part: Column) -> Column:
    """A decimal, octal (leading 0) or hexadecimal (leading 0x) part of an address; null when it is none."""
    digits = F.regexp_replace(part, r"^0[xX]?", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    # longer numbers are too large in any case
    small = F.length(digits) <= 16
    read = (
        F.when(part.rlike(r"^0[xX][0-9a-fA-F]*\z"), F.conv(digits, 16, 10))
        .when(part.rlike(r"^0[0-7]*\z"), F.conv(digits, 8, 10))
        .when(part.rlike(r"^[1-9]\d*\z"), part)
    )
    return F.when(small, read.try_cast("decimal(20,0)"))


def is_ipv4(host: Column) -> Column:
    """True for an address of up to four parts, the last of which fills the bytes that are left."""
    parts = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.")
    numbers = F.transform(parts, _number)
    count = F.size(parts)
    last = F.element_at(numbers, -1)
    first = F.slice(numbers, 1, F.greatest(count - 1, F.lit(0)))
    room = F.pow(F.lit(256.0), 5 - count)
    return F.coalesce((count <= 4) & F.forall(first, lambda n: F.coalesce(n <= 255, F.lit(False))) & (last < room), F.lit(False))


def is_valid_url(c: Column) -> Column:
    """True when the text, given ``https://`` unless it starts with http, is a URL."""
    text = F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))
    text = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")
    web = text.rlike(r"^(?i:https?):")
    rest = F.regexp_replace(text, r"^(?i:https?):[/\\]*", "")
    authority = F.regexp_extract(rest, r"^[^/\\?#]*", 0)
    host = F.regexp_replace(authority, r"^.*@", "")
    shaped = host.rlike(rf"^({_NAME}|{_IPV6}){_PORT}\z")
    # a host whose last label is a number must be an IPv4 address
    bare = F.regexp_replace(host, r":\d*\z", "")
    numeric = bare.rlike(r"(^|\.)(\d+|0[xX][0-9a-fA-F]*)\.?\z")
    other_scheme = text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.when(c.rlike(COMMON), True).when(web, shaped & (~numeric | is_ipv4(bare))).otherwise(other_scheme)
