import random

import numpy as np
import pytest

from tidemark.llm import leaks
from tidemark.llm.words import words

r = random.Random(4)
VOCABULARY = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(400)]
DOCS, ITEMS = "doc_id long, text string, share double", "item_id long, text string, doc_id long"


def prose(n):
    return [r.choice(VOCABULARY) for _ in range(n)]


def edited(w):
    out = list(w)
    for i in range(4, len(out) - 1, 9):
        out[i] = ("changed",) if False else "changed" if i % 2 else out[i] + " added"
    return out


@pytest.fixture(scope="module")
def corpus():
    items = {i: prose(r.randint(45, 90)) for i in range(12)}
    docs, truth = {}, set()
    for d in range(160):
        text = prose(r.randint(20, 300))
        i = d % 12
        w = items[i]
        kind = d % 8
        if kind == 0:
            text[10:10] = w
        elif kind == 1:
            text[5:5] = edited(w[: len(w) // 2 + 3])
        elif kind == 2:
            k = len(w) // 3
            text = text[:10] + w[:k] + text[10:] + w[-k:]
        elif kind == 3:
            text[3:3] = w[5:12]
        elif kind == 4:
            text[3:3] = w[::-1]
        elif kind == 5:
            text[3:3] = [f"<b>{x.upper()}</b>," if n % 3 else x[:2] + "​" + x[2:] for n, x in enumerate(w)]
        if kind in (0, 1, 2, 5):
            truth.add((i, d))
        docs[d] = " ".join(text) if kind != 5 else "\n".join(text)
    return items, docs, truth


def frames(spark, items, docs):
    return spark.createDataFrame([(d, t, 0.0) for d, t in docs.items()], DOCS), spark.createDataFrame([(i, " ".join(w), 0) for i, w in items.items()], ITEMS)


@pytest.mark.parametrize("a_pass", [1_000_000, 1000])
def test_finds_planted_and_nothing_else(spark, corpus, a_pass):
    items, docs, truth = corpus
    got = {(x.item_id, x.doc_id) for x in leaks.leaks(*frames(spark, items, docs), shingles_a_pass=a_pass).collect()}
    assert got == truth


def test_like_verifying_every_pair(spark, corpus):
    items, docs, _ = corpus
    want = {(i, d) for i, w in items.items() for d, t in docs.items() if leaks.recurring(w, leaks.seeds(w), [(0, words(t))]) / len(w) >= leaks.SHARE}
    assert {(x.item_id, x.doc_id) for x in leaks.leaks(*frames(spark, items, docs)).collect()} == want


def test_nulls_empties_repeats_and_long_texts(spark, corpus):
    items, docs, _ = corpus
    one = " ".join(items[0])
    rows = [(1, one, 0.0), (1, one, 0.0), (None, one, 0.0), (2, None, 0.0), (3, "", 0.0), (4, "  ", 0.0), (5, " ".join(prose(60_000)) + " " + one, 0.0)]
    its = [(0, one, 0), (0, one, 0), (None, one, 0), (7, None, 0), (8, "", 0), (9, "two words", 0)]
    d, i = spark.createDataFrame(rows, DOCS), spark.createDataFrame(its, ITEMS)
    got = leaks.leaks(d, i).collect()
    assert {(x.item_id, x.doc_id) for x in got} == {(0, 1), (0, 5)} and len(got) == 2
    assert leaks.leaks(d.limit(0), i).count() == leaks.leaks(d, i.limit(0)).count() == 0


def test_words():
    assert words("Ｆｕｌｌ ﬁnal­ Café <b>x</b>&nbsp;y—z 日本") == ["full", "final", "cafe", "x", "y", "z", "日", "本"]
    assert words(None) == words("") == words(" \n") == []


def test_the_prefix_decides_which_shingles_are_joined(spark, corpus, monkeypatch):
    """Of a long item only the rarest shingles are joined, and no leak is lost by that; with a prefix that takes a shingle
    too few, texts that hold just the common ones are."""
    item = prose(400)
    docs = {d: " ".join(item[:300]) for d in range(5)} | {9: " ".join(prose(50) + item[100:300] + prose(50)), 10: " ".join(item[i] for i in range(0, 400, 2))}
    of_item = [(0, 400, h, p, p) for p, h in enumerate(leaks.shingles(item).tolist())]
    known = spark.createDataFrame(of_item, "item_no int, item_words int, shingle long, item_pos int, item_last int")
    counts = {}
    for t in docs.values():
        for h in leaks.shingles(words(t)).tolist():
            counts[h] = counts.get(h, 0) + 1
    frequency = spark.createDataFrame(list(counts.items()), "shingle long, frequency long")
    prefix = leaks._prefixes(known, frequency, leaks.SHARE).collect()
    least = 160 - 8 - 5 * 23
    assert 0 < len(prefix) == 396 - least + 1 - sum(h not in counts for _, _, h, _, _ in of_item)
    rarest = {counts[x.shingle] for x in prefix}
    assert max(rarest) <= min(counts[h] for _, _, h, _, _ in of_item if h in counts and h not in {x.shingle for x in prefix})
    got = {x.doc_id for x in leaks.leaks(*frames(spark, {0: item}, docs)).collect()}
    assert got == {*range(5), 9}


def test_only_windows_of_a_text_leave_its_task(spark):
    import pyarrow as pa

    item = prose(60)
    text = prose(5000) + item + prose(5000) + item[:30] + prose(100)

    class Wanted:
        value = (np.unique(leaks.shingles(item)), leaks.reach(60))

    (batch,) = leaks._hit_documents(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(text)])], names=["doc_id", "text"])]), Wanted)
    pieces = batch.column("pieces").to_pylist()[0]
    assert len(pieces) == 2 and sum(len(p["text"].split()) for p in pieces) < 1000
    assert all(text[p["start"] : p["start"] + len(p["text"].split())] == p["text"].split() for p in pieces)
    docs = spark.createDataFrame([(1, " ".join(text), 0.0)], DOCS)
    (found,) = leaks.leaks(docs, spark.createDataFrame([(0, " ".join(item), 0)], ITEMS)).collect()
    assert found.share == 1.0


def test_a_stock_phrase_in_most_documents(spark):
    """A hot shingle goes to several tasks, and stray phrases stay no case."""
    phrase, item = prose(8), prose(70)
    item[20:20] = phrase
    docs = {d: " ".join(prose(20) + phrase + prose(20)) for d in range(400)} | {1000: " ".join(item)}
    got = leaks.leaks(*frames(spark, {0: item}, docs))
    assert [(x.item_id, x.doc_id) for x in got.collect()] == [(0, 1000)]
