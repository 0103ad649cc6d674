"""Parts of the 12-digit customer id and of the market code, and keys built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordstack.functions.numeric import int_div


def id_prefixes(c: Column) -> dict[str, Column]:
    """The id without its last 8, 9 and 10 digits."""
    return {
        "customer_id_4": int_div(c, 10**8),
        "customer_id_3": int_div(c, 10**9),
        "customer_id_2": int_div(c, 10**10),
    }


def cid8(c: Column) -> Column:
    return int_div(c, 10**4)


def cid5(c: Column) -> Column:
    return int_div(c, 10**7)


def cid3(c: Column) -> Column:
    return int_div(c, 10**4) % 1000


def code_number(c: Column) -> Column:
    """Digits of a code such as ``M17`` after its first letter; other text raises."""
    return F.substring(c, 2, 2147483647).cast("int")


def composite_key(prefix: Column, month: Column, market: Column) -> Column:
    return prefix.cast("bigint") * 10000 + month * 100 + code_number(market)
