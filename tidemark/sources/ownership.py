"""Ownership documents, XML or JSON, as rows: one per transaction and owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..operators import nested

_LINES = ["nonDerivativeTransaction", "derivativeTransaction"]
#: Members of a transaction that become columns.
_FIELDS = {"transactionDate": "transaction_date", "transactionCode": "code", "transactionShares": "shares", "transactionPricePerShare": "price",
    "transactionAcquiredDisposedCode": "acquired_disposed", "sharesOwnedFollowingTransaction": "shares_after",
    "directOrIndirectOwnership": "nature", "securityTitle": "security"}
#: What a transaction code stands for; every other code is OTHER.
CODES = {
    "P": "OPEN_MARKET_PURCHASE", "S": "OPEN_MARKET_SALE", "A": "AWARD", "M": "OPTION_EXERCISE", "G": "GIFT", "F": "TAX_WITHHOLDING", "T": "TRANSFER", "X": "TRANSFER",
}


def classification(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(code))), F.lit("OTHER"))


def economic_classification(classified: Column, acquired_disposed: Column) -> Column:
    """What a classified transaction means to the owner; transfers and others go by whether shares were acquired."""
    other = F.when(acquired_disposed == "A", "OTHER_ACQUISITION").otherwise("OTHER_DISPOSITION")
    return F.when(classified == "AWARD", "GRANT_AWARD").when(classified.isin("TRANSFER", "OTHER"), other).otherwise(classified)


def roles(title: Column, director: Column, officer: Column, ten_percent: Column, other: Column | None = None) -> Column:
    """Roles out of a title and flags, in a fixed order, each once. Flags are 1, true, t, yes or y in any case."""
    t = F.upper(title)
    flag = lambda c: F.lower(F.trim(c)).isin("1", "true", "t", "yes", "y")
    found = [
        F.when(t.rlike(r"\bCEO\b|CHIEF EXECUTIVE"), "CEO"), F.when(t.rlike(r"\bCFO\b|CHIEF FINANCIAL"), "CFO"), F.when(t.rlike("CHAIR"), "CHAIR"),
        F.when(flag(director), "DIRECTOR"), F.when(flag(officer), "OFFICER"), F.when(flag(ten_percent), "TEN_PERCENT"),
    ]
    return F.array_compact(F.array(*found, *([F.when(flag(other), "OTHER")] if other is not None else [])))


def transactions(records: DataFrame, record: str, document: str) -> DataFrame:
    """(record, table, line, owner_cik, roles, *fields, classification): every transaction of a document with every owner.

    Fields are null where the document has none or where they can't be read as their type. Broken documents give no rows;
    see ``nested.BROKEN``. One parse and one shuffle by record: owners and transactions meet within their document."""
    names = [*_LINES, *_FIELDS, "value", "reportingOwner", "rptOwnerCik", "officerTitle", "isDirector", "isOfficer", "isTenPercentOwner", "isOther"]
    nodes = nested.label_nodes(records, F.col(record), [document], names)
    linked = nested.enclosing(nodes, {"line": _LINES, "field": list(_FIELDS), "owner": ["reportingOwner"]})
    name, value = F.col("name"), F.nullif(F.col("value"), F.lit(""))
    # a field's text is its own or that of its member "value"
    as_field = F.when(F.col("line").isNotNull() & name.isin(list(_FIELDS)), name).when(F.col("field").isNotNull() & (name == "value"), F.col("field.name"))
    owner_field = F.when(F.col("owner").isNotNull() & name.isin("rptOwnerCik", "officerTitle", "isDirector", "isOfficer", "isTenPercentOwner", "isOther"), name)
    group = F.coalesce(F.col("line.pre"), F.col("owner.pre"), F.when(name.isin([*_LINES, "reportingOwner"]), F.col("pre")))
    kind = F.coalesce(F.col("line.name"), F.col("owner.name"), F.when(name.isin([*_LINES, "reportingOwner"]), name))
    rows = linked.select("record", group.alias("group"), kind.alias("kind"),
        F.coalesce(F.col("line.ordinal"), F.when(name.isin(_LINES), F.col("ordinal"))).alias("line"),
        F.coalesce(as_field, owner_field).alias("f"), value.alias("v")).filter("group is not null")
    pick = lambda f: F.max(F.when(F.col("f") == f, F.col("v")))
    each = rows.groupBy("record", "group", "kind").agg(F.max("line").alias("line"), *[pick(f).alias(c) for f, c in _FIELDS.items()],
        *[pick(f).alias(f) for f in ("rptOwnerCik", "officerTitle", "isDirector", "isOfficer", "isTenPercentOwner", "isOther")])
    owner = F.struct(N.cik(F.col("rptOwnerCik")).alias("owner_cik"),
        roles(F.col("officerTitle"), F.col("isDirector"), F.col("isOfficer"), F.col("isTenPercentOwner"), F.col("isOther")).alias("roles"))
    owners = F.collect_list(F.when(F.col("kind") == "reportingOwner", owner)).over(Window.partitionBy("record"))
    lines = each.withColumn("owners", owners).filter(F.col("kind") != "reportingOwner")
    return lines.select("record", F.when(F.col("kind") == "derivativeTransaction", "D").otherwise("N").alias("table"), "line",
        F.explode_outer("owners").alias("o"), N.loose_date(F.col("transaction_date")).alias("transaction_date"), "code",
        classification(F.col("code")).alias("classification"), F.col("shares").try_cast("decimal(38,6)").alias("shares"),
        F.col("price").try_cast("decimal(38,6)").alias("price"), "acquired_disposed",
        F.col("shares_after").try_cast("decimal(38,6)").alias("shares_after"), "nature", "security").select("record", "table", "line",
        "o.owner_cik", "o.roles", "transaction_date", "code", "classification", "shares", "price", "acquired_disposed", "shares_after", "nature",
        "security")


def fingerprints(records: DataFrame, record: str, document: str) -> DataFrame:
    """(record, fingerprint): what a document says about issuer, owners and transactions, whatever its spelling.

    XML and JSON of one content give the same fingerprint: fields are read as their type, roles come from flags and titles,
    order and layout don't count, nor do absent flags that are false. Null and broken documents have none. One parse and one
    shuffle by record."""
    flags = ["isDirector", "isOfficer", "isTenPercentOwner"]
    names = [*_LINES, *_FIELDS, "value", "issuerCik", "reportingOwner", "rptOwnerCik", "officerTitle", *flags]
    nodes = nested.label_nodes(records, F.col(record), [document], names)
    linked = nested.enclosing(nodes, {"line": _LINES, "field": list(_FIELDS), "owner": ["reportingOwner"]})
    name, value = F.col("name"), F.nullif(F.trim("value"), F.lit(""))
    alone = name.isin([*_LINES, "reportingOwner", "issuerCik", nested.BROKEN])
    f = F.when(F.col("line").isNotNull(), F.when(name.isin(list(_FIELDS)), name).when(F.col("field").isNotNull() & (name == "value"),
        F.col("field.name"))).when(F.col("owner").isNotNull(), name).when(name == "issuerCik", name)
    rows = linked.select("record", F.coalesce(F.col("line.pre"), F.col("owner.pre"), F.when(alone, F.col("pre"))).alias("group"),
        F.coalesce(F.col("line.name"), F.col("owner.name"), F.when(alone, name)).alias("kind"), f.alias("f"),
        value.alias("v")).filter("group is not null")
    pick = lambda f: F.max(F.when(F.col("f") == f, F.col("v")))
    each = rows.groupBy("record", "group", "kind").agg(*[pick(x).alias(x) for x in [*_FIELDS, "issuerCik", "rptOwnerCik", "officerTitle", *flags]])
    number = lambda c: F.col(c).try_cast("decimal(38,6)").cast("string")
    fact = F.struct(
        "kind", N.cik(F.col("issuerCik")).alias("issuer"), N.cik(F.col("rptOwnerCik")).alias("owner"), F.upper("officerTitle").alias("title"),
            F.array_join(roles(F.col("officerTitle"), *map(F.col, flags)), ",").alias("roles"),
        F.coalesce(N.loose_date(F.col("transactionDate")).cast("string"), F.col("transactionDate")).alias("date"),
            *[F.upper(c).alias(c) for c in ("transactionCode", "transactionAcquiredDisposedCode", "directOrIndirectOwnership", "securityTitle")],
        *[F.coalesce(number(c), F.col(c)).alias(c) for c in ("transactionShares", "transactionPricePerShare", "sharesOwnedFollowingTransaction")],
    )
    g = each.groupBy("record").agg(F.sort_array(F.collect_list(fact)).alias("facts"), F.bool_or(F.col("kind") == nested.BROKEN).alias("broken"))
    return g.filter("not broken").select("record", F.sha2(F.to_json("facts"), 256).alias("fingerprint"))
