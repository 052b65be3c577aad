"""Address expressions: one spelling for each address, written with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import _col, stripped

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"


def is_ipv4(c: Column | str) -> Column:
    return _col(c).rlike(f"^{_V4}$")


def ipv4_number(c: Column | str) -> Column:
    """Dotted IPv4 as an unsigned 32-bit number in a bigint; null for anything else."""
    p = F.split(_col(c), r"\.")
    n = sum((F.try_element_at(p, F.lit(i + 1)).cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(is_ipv4(c), n)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: expressions that name it often would be copied into each place."""
    return F.transform(F.array(value), use)[0]


def _hex4(n: Column) -> Column:
    return F.lower(F.hex(n))


def _undotted(s: Column) -> Column:
    """A dotted tail as the two groups it stands for."""
    def use(tail: Column) -> Column:
        n = ipv4_number(tail)
        head = s.substr(F.lit(1), F.length(s) - F.length(tail))
        return F.when(tail == "", s).otherwise(F.concat(head, _hex4(F.shiftright(n, 16)), F.lit(":"), _hex4(n.bitwiseAND(0xFFFF))))

    return _let(F.regexp_extract(s, rf":({_V4})$", 1), use)


def _packed(text: Column) -> Column:
    """``:g:g:...:`` with the first of the longest runs of at least two zero groups written as ``::``."""
    def cut(run: str) -> Column:
        at = F.instr(text, run)
        whole = F.concat(text.substr(F.lit(1), at - 1), F.lit("::"), text.substr(at + len(run), F.length(text)))
        return F.when(at > 0, F.regexp_replace(whole, "^:(?!:)|(?<!:):$", ""))

    return F.coalesce(*[cut(":0" * k + ":") for k in range(8, 1, -1)], F.btrim(text, F.lit(":")))


def _mapped(full: Column) -> Column:
    """The IPv4 address that ``0:0:0:0:0:ffff:x:y`` stands for."""
    def use(n: Column) -> Column:
        return F.concat_ws(".", *[F.shiftright(n, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4)])

    return _let(F.conv(F.concat(full[6], F.lpad(full[7], 4, "0")), 16, 10).cast("bigint"), use)


def _v6(s: Column) -> Column:
    """Canonical text of a lower-case IPv6 address without blanks; null if it is none."""
    def groups(x: Column) -> Column:
        return F.filter(F.split(x, ":"), lambda g: g != "")

    def finish(full: Column) -> Column:
        v4 = F.array_join(F.slice(full, 1, 6), ":") == "0:0:0:0:0:ffff"
        text = F.concat(F.lit(":"), F.array_join(full, ":"), F.lit(":"))
        return F.when(F.size(full) == 8, F.when(v4, _mapped(full)).otherwise(_let(text, _packed)))

    def fill(halves: Column) -> Column:
        left = groups(halves[0])
        right = groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
        missing = F.lit(8) - F.size(left) - F.size(right)
        some = F.when(missing > 0, F.concat(left, F.array_repeat(F.lit("0"), missing), right))
        return F.when(F.size(halves) == 2, some).when(F.size(halves) == 1, left)

    def use(plain: Column) -> Column:
        shaped = F.when(plain.rlike("^[0-9a-f:]+$") & ~plain.rlike("[0-9a-f]{5}|:::|^:[^:]|[^:]:$"), F.split(plain, "::"))
        short = F.transform(_let(shaped, fill), lambda g: F.coalesce(F.nullif(F.ltrim(g, F.lit("0")), F.lit("")), F.lit("0")))
        return _let(short, finish)

    return _let(_undotted(s), use)


def canonical_ip(c: Column | str) -> Column:
    """The one spelling of an address: IPv4 dotted, IPv6 in lower case, without leading zeros, compressed by ``::``.

    Blanks around it and letter case don't matter; an IPv4-mapped IPv6 form gives its IPv4 address. Null, empty and
    whatever is no address (an IPv4 part above 255 or with a leading zero included) give null.
    """
    s = F.lower(stripped(c))
    return F.when(is_ipv4(s), s).when(F.instr(s, ":") > 0, _v6(s))
