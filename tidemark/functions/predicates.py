"""What counts: whether a statement is in force, whether it is a purchase or a sale. Nulls never raise and never count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_force(status: Column, valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Whether a statement held at a time, as known afterwards: one that was replaced held until it was.

    A null status is ACTIVE, null bounds are open; a void statement never held, nor did one that was replaced at no known
    time."""
    s = F.upper(F.coalesce(status, F.lit("ACTIVE")))
    within = F.coalesce(valid_from <= at, F.lit(True)) & F.coalesce(at < valid_to, F.lit(True))
    return within & (s.endswith("ACTIVE") | (s.endswith("SUPERSEDED") & valid_to.isNotNull()))


def _side(flag: str, code: str, name: str, columns: tuple[Column, ...]) -> Column:
    stated_code, acquired_disposed, classified, economic = columns
    fits = F.coalesce(acquired_disposed, F.lit("")).isin("", flag)
    named = [F.coalesce(c == v, F.lit(False)) for c, v in ((F.upper(stated_code), code), (F.upper(classified), name), (F.upper(economic), name))]
    return fits & (named[0] | named[1] | named[2])


def purchase(code: Column, acquired_disposed: Column, classified: Column, economic: Column) -> Column:
    """Bought on the open market by code or by either classification, and not flagged as disposed."""
    return _side("A", "P", "OPEN_MARKET_PURCHASE", (code, acquired_disposed, classified, economic))


def sale(code: Column, acquired_disposed: Column, classified: Column, economic: Column) -> Column:
    return _side("D", "S", "OPEN_MARKET_SALE", (code, acquired_disposed, classified, economic))


def positive(c: Column) -> Column:
    return F.coalesce((c > 0) & (c < float("inf")), F.lit(False))


def priced(table_type: Column, shares: Column, price: Column, value: Column) -> Column:
    """A line of the non-derivative table with shares, a price and a value."""
    return F.coalesce(table_type == "NON_DERIVATIVE", F.lit(False)) & positive(shares) & positive(price) & value.isNotNull()


#: Fixed value: how titles of common stock read.
COMMON_STOCK = r"(?i)\b(?:common[ _-]?(?:stock|shares?)|ordinary[ _-]?shares?)\b"


def common_stock(title: Column) -> Column:
    return F.coalesce(title.rlike(COMMON_STOCK), F.lit(False))
