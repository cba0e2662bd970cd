import json
import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tidemark.operators import nested
from tidemark.sources import ownership

NAMES = ["a", "b", "c", "id"]


def random_tree(r, depth=0):
    return {k: [random_tree(r, depth + 1) for _ in range(r.randint(0, 3))] if depth < 3 else r.choice([None, 1, "x", True, 2.5]) for k in r.sample(NAMES, r.randint(0, 3))}


def ancestors(tree, path=()):
    """(path of (name, ordinal)) of every node, plainly."""
    for k, v in tree.items():
        for i, x in enumerate((y for y in v if y is not None) if isinstance(v, list) else () if v is None else (v,), 1):
            yield (*path, (k, i))
            if isinstance(x, dict):
                yield from ancestors(x, (*path, (k, i)))


def to_xml(tree):
    return "".join(f"<{k}>{to_xml(x) if isinstance(x, dict) else x}</{k}>" for k, v in tree.items() for x in (v if isinstance(v, list) else [v]) if x is not None)


def test_containment_like_paths(spark):
    r = random.Random(1)
    trees = [random_tree(r) for _ in range(40)]
    for form in (lambda t: json.dumps(t), lambda t: f"<root>{to_xml(t)}</root>"):
        df = spark.createDataFrame([(i, form(t)) for i, t in enumerate(trees)], "k long, doc string")
        nodes = nested.label_nodes(df, F.col("k"), ["doc"], NAMES)
        got = nested.contained_in(nodes, nodes).groupBy("child_record", "parent_name", "child_name").count().collect()
        want = {}
        for i, t in enumerate(trees):
            for p in ancestors(t):
                for up in p[:-1]:
                    want[i, up[0], p[-1][0]] = want.get((i, up[0], p[-1][0]), 0) + 1
        assert {(x.child_record, x.parent_name, x.child_name): x["count"] for x in got} == want


def test_xml_and_json_give_the_same(spark):
    x = b'\xef\xbb\xbf<?xml version="1.0"?><r xmlns="urn:x"><a><!-- <b>no</b> --><b>1</b><c id="F1"/></a><a/></r>'
    j = json.dumps(json.dumps({"r": {"a": [{"b": 1, "c": {"id": "F1"}}, {}]}}))
    keep = lambda rows: sorted((n.name, n.ordinal, n.value) for n in rows if n.name != "#broken")
    one, two = (nested.label_nodes(spark.createDataFrame([(1, t)], f"k long, d {kind}"), F.col("k"), ["d"], NAMES).collect() for t, kind in ((bytearray(x), "binary"), (j, "string")))
    assert [(n, o) for n, o, _ in keep(one)] == [(n, o) for n, o, _ in keep(two)]
    assert ("id", 1, "F1") in keep(one) and ("id", 1, "F1") in keep(two)


def test_broken_empty_and_deep(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    docs = [None, "", "  ", "<a><b></a>", '{"a": 1', "plain", '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>', deep, "<a>" + "y" * 500_000 + "</a>"]
    df = spark.createDataFrame(list(enumerate(docs)), "k long, d string")
    got = nested.label_nodes(df, F.col("k"), ["d"], ["a"]).groupBy("record", "name").count().collect()
    names = {(x.record, x.name) for x in got}
    assert {k for k, _ in names} & {0, 1, 2} == set()
    assert {(3, "#broken"), (4, "#broken"), (5, "#broken"), (6, "#broken"), (8, "a")} <= names
    assert (7, "a") in names or (7, "#broken") in names
    assert nested.label_nodes(df.limit(0), F.col("k"), ["d"], ["a"]).count() == 0


def test_enclosing_is_the_container(spark):
    doc = "<r><a><b/><b/></a><b/><a><c><b/></c></a></r>"
    nodes = nested.label_nodes(spark.createDataFrame([(1, doc), (2, doc)], "k long, d string"), F.col("k"), ["d"], ["a", "b", "c"])
    got = nested.enclosing(nodes, {"in_a": ["a"], "in_c": ["c"]}).filter("name = 'b' and record = 1").orderBy("pre").collect()
    assert [(x.in_a.ordinal if x.in_a else None, bool(x.in_c)) for x in got] == [(1, False), (1, False), (None, False), (2, True)]


def test_ownership_rows(spark):
    xml = """<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><officerTitle>Chief Executive Officer</officerTitle></reportingOwnerRelationship></reportingOwner>
    <reportingOwner><reportingOwnerId><rptOwnerCik>8</rptOwnerCik></reportingOwnerId></reportingOwner>
    <nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares></transactionAmounts></nonDerivativeTransaction><nonDerivativeHolding/></nonDerivativeTable></ownershipDocument>"""
    got = ownership.transactions(spark.createDataFrame([(1, xml), (2, xml[:300]), (3, None)], "k long, d string"), "k", "d").collect()
    assert len({id(x) for x in got}) == 2 and {x.owner_cik for x in got} == {"0000000007", "0000000008"}
    assert all(x.classification == "OPEN_MARKET_PURCHASE" and int(x.shares) == 10 and x.price is None and str(x.transaction_date) == "2024-01-02" for x in got)
    assert next(x.roles for x in got if x.owner_cik == "0000000007") == ["CEO", "DIRECTOR"]
    assert ET.fromstring(xml) is not None
