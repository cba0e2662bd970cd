"""Nested records of several spellings as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _at(schema: StructType, path: str) -> str | None:
    """The path as the schema spells it, case and underscores aside, or None."""
    plain = lambda name: name.replace("_", "").lower()
    found = []
    for part in path.split("."):
        fields = {plain(f.name): f for f in schema.fields} if isinstance(schema, StructType) else {}
        field = fields.get(plain(part))
        if field is None:
            return None
        found.append(f"`{field.name}`")
        schema = field.dataType
    return None if isinstance(schema, StructType) else ".".join(found)


def first_of(rows: DataFrame, paths: list[str]) -> Column:
    """The first of several paths that is there and not null; null if the schema has none. Snake and camel case are one."""
    there = [F.col(p) for p in (_at(rows.schema, path) for path in paths) if p]
    return F.coalesce(*there) if there else F.lit(None)


#: Columns of a flat transaction, their type, and the paths that may hold them, the nested form first.
TRANSACTION = {
    "issuer_cik": ("string", ["issuer.cik", "issuer_cik", "issuer"]),
    "owner_cik": ("string", ["reporting_owner.cik", "owner_cik", "owner"]),
    "transaction_date": ("date", ["transaction.transaction_date", "transaction_date", "event_at", "date"]),
    "accepted_at": ("timestamp_ntz", ["timestamps.accepted_at", "accepted_at", "filing_at"]),
    "knowledge_at": ("timestamp_ntz", ["timestamps.knowledge_at", "knowledge_at"]),
    "code": ("string", ["transaction.code", "code", "transaction_code"]),
    "acquired_disposed": ("string", ["transaction.acquired_disposed", "acquired_disposed", "acquired_disposed_code"]),
    "table_type": ("string", ["security.table_type", "table_type"]),
    "classification": ("string", ["transaction.classification", "classification"]),
    "economic_classification": ("string", ["transaction.economic_classification", "economic_classification"]),
    "value_usd": ("double", ["transaction.value", "value", "value_usd"]),
    "shares": ("double", ["transaction.shares", "shares"]),
    "price_per_share": ("double", ["transaction.price_per_share", "price_per_share", "price"]),
    "post_transaction_shares": ("double", ["transaction.post_transaction_shares", "shares_owned_following_transaction"]),
    "rule_10b5_1": ("string", ["transaction.rule_10b51", "rule_10b51", "is_10b5_1"]),
    "routine": ("boolean", ["routine", "is_routine"]),
    "role": ("string", ["reporting_owner.role", "role"]),
    "lifecycle_status": ("string", ["lifecycle.status", "status"]),
    "valid_from": ("timestamp_ntz", ["lifecycle.valid_from", "valid_from"]),
    "valid_to": ("timestamp_ntz", ["lifecycle.valid_to", "valid_to"]),
    "symbolic": ("boolean", ["symbolic", "is_symbolic"]),
}


def flat_transactions(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(*keep, columns of TRANSACTION): nested or flat records in any of their spellings as one row each.

    Codes and flags are upper case, a value that isn't stated is shares times price, and what has a usual value gets it: the
    non-derivative table, an UNKNOWN rule, an ACTIVE status. Fields that can't be read as their type are null."""
    f = {name: first_of(rows, paths).try_cast(kind) for name, (kind, paths) in TRANSACTION.items()}
    for name, usual in (("issuer_cik", ""), ("owner_cik", ""), ("code", ""), ("acquired_disposed", ""), ("table_type", "NON_DERIVATIVE"),
        ("rule_10b5_1", "UNKNOWN"), ("lifecycle_status", "ACTIVE")):
        f[name] = F.coalesce(f[name], F.lit(usual))
    for name in ("code", "acquired_disposed", "rule_10b5_1"):
        f[name] = F.upper(f[name])
    f["value_usd"] = F.coalesce(f["value_usd"], f["shares"] * f["price_per_share"])
    return rows.select(*(keep or []), *[c.alias(name) for name, c in f.items()])
