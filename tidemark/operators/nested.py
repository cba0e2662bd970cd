"""Deeply nested records as flat tables with parent links.

A depth-first traversal numbers every node of a record: ``pre`` when it is entered, ``post`` when it is left. A node lies
inside another exactly when its pre is greater and its post smaller. XML elements and JSON members give the same trees: an
array is as many nodes of one name, an attribute a child, a single object an array of one. Node tables are cut out of
the labelled nodes by name and linked by those intervals."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name of the one node emitted for a document that is broken off or isn't XML or JSON.
BROKEN = "#broken"
_NODES = pa.schema([("record", pa.int64()), ("document", pa.string()), ("name", pa.string()), ("pre", pa.int32()), ("post", pa.int32()),
    ("depth", pa.int32()), ("ordinal", pa.int32()), ("value", pa.string())])
_DDL = "record long, document string, name string, pre int, post int, depth int, ordinal int, value string"


class _Unfit(ValueError):
    pass


def _xml_nodes(text: bytes, names: frozenset[str]) -> list[list]:
    found: list[list] = []
    open_: list[tuple[list | None, dict, list]] = []  # node or None, counts of child names, texts
    pre = post = 0
    top: dict[str, int] = {}

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal pre, post
        name = tag.rpartition(":")[2]
        counts = open_[-1][1] if open_ else top
        counts[name] = counts.get(name, 0) + 1
        node = None
        if name in names:
            node = [name, pre, 0, len(open_), counts[name], None]
            found.append(node)
        pre += 1
        own: dict[str, int] = {}
        open_.append((node, own, []))
        for key, value in attributes.items():
            own[key] = own.get(key, 0) + 1
            if key in names:
                found.append([key, pre, post, len(open_), own[key], value.strip()])
            pre += 1
            post += 1

    def end(_: str) -> None:
        nonlocal post
        node, own, texts = open_.pop()
        if node is not None:
            node[2] = post
            if not own:
                node[5] = "".join(texts).strip()
        post += 1

    def text_(data: str) -> None:
        if open_[-1][0] is not None:
            open_[-1][2].append(data)

    def doctype(*_: object) -> None:
        raise _Unfit("document types are not read")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, text_, doctype
    parser.Parse(text, True)
    return found


def _json_nodes(tree: object, names: frozenset[str]) -> list[list]:
    """Without recursion, so that depth has no limit but memory."""
    found: list[list] = []
    pre = post = 0
    todo: list[tuple] = [("", tree, 0, 1, None)]  # name, value, depth, ordinal, node to close
    while todo:
        name, value, depth, ordinal, closing = todo.pop()
        if depth < 0:
            if closing is not None:
                closing[2] = post
            post += 1
            continue
        node = None
        if name in names:
            node = [name, pre, 0, depth, ordinal, None if isinstance(value, dict | list) else json.dumps(value) if isinstance(value, bool | float) else str(value)]
            found.append(node)
        pre += 1
        todo.append(("", None, -1, 0, node))
        if isinstance(value, dict):
            children = [(k, x, i) for k, v in value.items() for i, x in enumerate((y for y in v if y is not None) if isinstance(v, list) else () if v is None else (v,), 1)]
        elif isinstance(value, list):  # a list in a list has no name of its own
            children = [("", x, i) for i, x in enumerate(value, 1) if x is not None]
        else:
            children = []
        todo.extend((k, x, depth + 1, i, None) for k, x, i in reversed(children))
    return found


def _document_nodes(text: bytes, names: frozenset[str]) -> list[list]:
    broken = [[BROKEN, 0, 0, 0, 1, None]]
    head = text.removeprefix(b"\xef\xbb\xbf").lstrip()
    try:
        if head[:1] == b"<":
            return _xml_nodes(head, names)
        tree = json.loads(head.decode("utf-8"))
        if isinstance(tree, str):  # JSON that was written as a string
            tree = json.loads(tree)
        return _json_nodes(tree, names) if isinstance(tree, dict | list) else broken
    except (expat.ExpatError, _Unfit, ValueError, RecursionError):
        return broken


def _label(batches: Iterator[pa.RecordBatch], documents: list[str], names: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            rows: list[tuple] = []
            for document in documents:
                for record, text in zip(part.column("record").to_pylist(), part.column(document).to_pylist()):
                    if text and text.strip():
                        rows.extend((record, document, *n) for n in _document_nodes(text, names))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)


def label_nodes(records: DataFrame, record: Column, documents: list[str], names: list[str]) -> DataFrame:
    """(record, document, name, pre, post, depth, ordinal, value): the nodes called one of ``names`` in the documents.

    record: a long that tells records apart. documents: columns with XML or JSON as text or UTF-8 bytes. All nodes are
    numbered, only the named ones come out. ordinal: position from 1 among the parent's children of that name. value: the
    text of a leaf, null of others. JSON nulls are absent, comments aren't there. A null, empty or blank document has no
    nodes; one that is broken off, of no known form or with a document type declaration has one node named BROKEN only."""
    cols = [F.col(d).cast("binary").alias(d) for d in documents]
    return records.select(record.cast("long").alias("record"), *cols).mapInArrow(partial(_label, documents=documents, names=frozenset(names)), _DDL)


def contained_in(children: DataFrame, parents: DataFrame) -> DataFrame:
    """child_*, parent_*: every pair of a node and an ancestor of it, by interval containment within one document."""
    c = children.select(*[F.col(x).alias(f"child_{x}") for x in children.columns])
    p = parents.select(*[F.col(x).alias(f"parent_{x}") for x in parents.columns])
    same = (F.col("child_record") == F.col("parent_record")) & (F.col("child_document") == F.col("parent_document"))
    return c.join(p, same & (F.col("child_pre") > F.col("parent_pre")) & (F.col("child_post") < F.col("parent_post")))


def enclosing(nodes: DataFrame, links: dict[str, list[str]]) -> DataFrame:
    """``nodes`` with a column per link: the (name, pre, ordinal, value) of the node of those names that contains it, or null.

    For names that don't nest in themselves. Sorted by pre, the only candidate is the last such node entered before;
    it contains the node if it is left later. One shuffle by document serves all links, where joins would take one each."""
    before = Window.partitionBy("record", "document").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes
    for column, names in links.items():
        last = F.last(F.when(F.col("name").isin(names), F.struct("name", "pre", "post", "ordinal", "value")), ignorenulls=True).over(before)
        out = out.withColumn(column, last)
    return out.withColumns({c: F.when(F.col(f"{c}.post") > F.col("post"), F.col(c)) for c in links})
