"""Passages of held-out items inside training texts, by a prefix-filtered set join over word shingles.

Shingles of an item are ordered by how rare they are in the corpus. A text that repeats enough of the item shares at
least ``least`` of its shingles, so it must hit one of the item's rarest ``count - least + 1``: only these are joined.
Length and position bounds drop pairs that can't reach the share any more; the rest is verified word by word in windows of
the item's size around the shingles that the text shares with it. Nothing of a text but such windows leaves its task."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .words import words

#: Words of a shingle.
SHINGLE = 5
#: Least share of an item's words to recur, in PASSAGES unbroken passages of LEAST_PASSAGE words or more.
SHARE, PASSAGES, LEAST_PASSAGE = 0.4, 2, 6
#: One word in so many may be changed, missing or added; words between two exact stretches of one passage.
EDIT_EVERY, GAP = 7, 4
#: Words of the exact stretches that passages are made of.
SEED = 3
#: Item shingles sent to all workers at a time (8 bytes each); more items are searched for in as many passes as it takes.
SHINGLES_A_PASS = 1_000_000
#: Parts a frequent shingle's hits are split into.
SALTS = 16


def reach(n: int) -> int:
    """Words of a text that a passage of an item of n words can hold before or after a shingle of it."""
    return n + GAP * (n // SEED + 1)


class _Hashes(dict):
    """Hashes of the words seen lately."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(tokens: list[str], hashes: _Hashes | None = None) -> np.ndarray:
    """64-bit hashes of all runs of SHINGLE words."""
    if len(tokens) < SHINGLE:
        return np.empty(0, np.int64)
    hashes = _Hashes() if hashes is None else hashes
    ids = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    out = np.zeros(len(tokens) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ ids[k : len(ids) - SHINGLE + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_HIT_DOCUMENTS = "doc_id long, n_words int, hits array<struct<pos:int,shingle:long>>, pieces array<struct<start:int,text:string>>"
_PIECES = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))


def _spans(at: np.ndarray, around: int, n: int) -> list[tuple[int, int]]:
    """Stretches of a text of n words within ``around`` words of the shingles at the ascending positions ``at``."""
    first, last = np.maximum(at - around, 0), np.minimum(at + SHINGLE + around, n)
    cuts = np.flatnonzero(first[1:] > last[:-1]) + 1
    return list(zip(first[np.concatenate([[0], cuts])].tolist(), last[np.concatenate([cuts - 1, [len(at) - 1]])].tolist()))


def _hit_documents(batches: Iterator[pa.RecordBatch], wanted: object) -> Iterator[pa.RecordBatch]:
    """The documents that hold any wanted shingle: where which one stands, and the words around."""
    cache = _Hashes()
    only, around = wanted.value
    if not len(only):
        return
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            keys, counts, ends, positions, hashes, pieces = [], [], [0], [], [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if key is None or not text:
                    continue
                tokens = words(text)
                h = shingles(tokens, cache)
                spot = np.searchsorted(only, h)
                spot[spot == len(only)] = 0
                at = np.flatnonzero(only[spot] == h)
                if len(at):
                    keys.append(key)
                    counts.append(len(tokens))
                    ends.append(ends[-1] + len(at))
                    positions.append(at.astype(np.int32))
                    hashes.append(h[at])
                    pieces.append([{"start": a, "text": " ".join(tokens[a:b])} for a, b in _spans(at, around, len(tokens))])
            if keys:
                hits = pa.StructArray.from_arrays([pa.array(np.concatenate(positions)), pa.array(np.concatenate(hashes))], names=["pos", "shingle"])
                columns = [pa.array(keys, pa.int64()), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits), pa.array(pieces, _PIECES)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "hits", "pieces"])


def _stretches(index: dict[tuple, list[int]], start: int, text: list[str]) -> list[list[int]]:
    """Longest exact common stretches of SEED words or more: [item position, text position, words]. ``text`` are words from
    position ``start`` on."""
    found, last = [], {}
    for j, seed in enumerate(zip(*(text[k:] for k in range(SEED))), start):
        for p in index.get(seed, ()):
            b = last.get(j - p)
            if b is not None and b[1] + b[2] - SEED + 1 >= j:
                b[2] = j + SEED - b[1]
            else:
                b = last[j - p] = [p, j, SEED]
                found.append(b)
    return found


def _passages(found: list[list[int]], n: int) -> list[tuple[int, int, int, int, int]]:
    """(words, item from, item to, text from, text to): stretches chained over gaps of at most GAP words on either side,
    each within a stretch of text no longer than the item and its gaps allow. One stretch at least is a shingle long."""
    found = sorted(found, key=lambda b: (b[1], b[0]))
    score, first, whole = [b[2] for b in found], list(range(len(found))), [b[2] >= SHINGLE for b in found]
    window = reach(n)
    for x, (p, j, size) in enumerate(found):
        y = x - 1
        while y >= 0 and j - found[y][1] <= window:
            q, i, length = found[y]
            gap_p, gap_j = p - q - length, j - i - length
            overlap = max(0, -gap_p, -gap_j)
            if gap_p <= GAP and gap_j <= GAP and overlap < SEED and overlap < size and p > q and j > i:
                gained = score[y] + size - overlap + (gap_p > 0)  # one edited word is made up for
                if gained > score[x]:
                    score[x], first[x], whole[x] = gained, first[y], whole[y] or size >= SHINGLE
            y -= 1
    best: dict[int, int] = {}
    for x in range(len(found)):
        if first[x] not in best or score[x] > score[best[first[x]]]:
            best[first[x]] = x
    return [(score[e], found[s][0], found[e][0] + found[e][2], found[s][1], found[e][1] + found[e][2]) for s, e in best.items() if score[e] >= LEAST_PASSAGE and whole[e]]


def recurring(item: list[str], index: dict[tuple, list[int]], windows: list[tuple[int, list[str]]]) -> int:
    """Words of the item in its best one or two passages of the text, the second after the first in both. windows: parts of
    the text that don't touch, each from which word on and its words.

    Of words that differ between two stretches of a passage one counts, as an occasional edit must not matter."""
    made = _passages([b for start, text in windows for b in _stretches(index, start, text)], len(item))
    top = max((m[0] for m in made), default=0)
    if PASSAGES < 2 or len(made) < 2:
        return top
    # best second passage after each: by text end in order, keeping the best passage so far per item position
    made.sort(key=lambda m: m[3])
    by_end = sorted(made, key=lambda m: m[4])
    best_to: list[int] = []  # item ends, ascending, with ascending sizes
    best_size: list[int] = []
    k = 0
    for size, at, _, i, _ in made:
        while k < len(by_end) and by_end[k][4] <= i + 1:
            s, _, to, _, _ = by_end[k]
            spot = bisect_left(best_to, to)
            if spot == 0 or best_size[spot - 1] < s:
                best_to.insert(spot, to)
                best_size.insert(spot, s)
                spot += 1
                while spot < len(best_size) and best_size[spot] <= s:
                    del best_to[spot], best_size[spot]
            k += 1
        spot = bisect_left(best_to, at + 2) - 1
        if spot >= 0:
            top = max(top, size + best_size[spot])
    return top


def seeds(item: list[str]) -> dict[tuple, list[int]]:
    """Where each run of SEED words stands in an item."""
    index: dict[tuple, list[int]] = {}
    for p in range(len(item) - SEED + 1):
        index.setdefault(tuple(item[p : p + SEED]), []).append(p)
    return index


def _windows(item_shingles: np.ndarray, n: int, n_words: int, positions: np.ndarray, hashes: np.ndarray, pieces: list[dict]) -> list[tuple[int, list[str]]]:
    """The text within an item's reach of the shingles it shares with the item; it lies within ``pieces``. item_shingles: sorted."""
    spot = np.searchsorted(item_shingles, hashes)
    spot[spot == len(item_shingles)] = 0
    own = np.sort(positions[item_shingles[spot] == hashes])
    if not len(own):
        return []
    texts = {p["start"]: p["text"] for p in pieces}
    starts, out = sorted(texts), []
    split: dict[int, list[str]] = {}
    for a, b in _spans(own, reach(n), n_words):
        at = starts[bisect_left(starts, a + 1) - 1]
        if at not in split:
            split[at] = texts[at].split(" ")
        out.append((a, split[at][a - at : b - at]))
    return out


def _verify(batches: Iterator[pa.RecordBatch], items: object, share: float) -> Iterator[pa.RecordBatch]:
    known: dict[int, tuple] = {}
    for batch in batches:
        rows = []
        hits = batch.column("hits")
        positions, hashes = (x.to_numpy(zero_copy_only=False) for x in hits.flatten().flatten())
        ends = np.cumsum(hits.value_lengths().to_numpy(zero_copy_only=False))
        for i, (no, doc_id, n_words, pieces) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item_no", "doc_id", "n_words", "pieces")))):
            if no not in known:
                if len(known) > 2000:
                    known.clear()
                item_id, text = items.value[no]
                item = words(text)
                known[no] = item_id, item, seeds(item), np.unique(shingles(item))
            item_id, item, index, own = known[no]
            at = slice(ends[i - 1] if i else 0, ends[i])
            got = recurring(item, index, _windows(own, len(item), n_words, positions[at], hashes[at], pieces)) / len(item)
            if got >= share:
                rows.append((item_id, doc_id, got))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], names=["item_id", "doc_id", "share"])


def least_shared(n: Column, share: float) -> Column:
    """Shingles that a text holding ``share`` of n words in PASSAGES passages shares with the item at least, each edit
    costing SHINGLE of them."""
    need = F.ceil(n * F.lit(share))
    return F.greatest(F.lit(1), need - PASSAGES * (SHINGLE - 1) - SHINGLE * F.ceil(need / EDIT_EVERY))


def _may_reach(need: Column) -> Column:
    """Position bound: whether the words around a hit suffice. Passages follow each other in item and text alike, so no more
    recurs before and after the hit than the shorter of the two has there; an item that holds the shingle at several places
    counts at its best ones. That includes the length bound, as no reach is longer than item or text."""
    reach = F.least("item_last", "pos") + F.least(F.col("item_words") - F.col("item_pos"), F.col("n_words") - F.col("pos"))
    # words the text has otherwise: an edit in so many, and no more than one to a stretch as verification counts them
    return reach + F.greatest(F.ceil(F.col("item_words") / F.lit(EDIT_EVERY)), F.ceil(need / F.lit(SEED + 1))) >= need


def _prefixes(of_items: DataFrame, frequency: DataFrame, share: float) -> DataFrame:
    """The rarest shingles of each item, one of which a text that holds ``share`` of it must have. A shingle that no text has
    is the rarest and costs nothing."""
    once = of_items.join(frequency, "shingle", "left").na.fill(0, ["frequency"])
    per_item = Window.partitionBy("item_no")
    ranked = once.withColumns({"rank": F.row_number().over(per_item.orderBy("frequency", "shingle")), "count": F.count("*").over(per_item)})
    needed = ranked.filter((F.col("frequency") > 0) & (F.col("rank") <= F.col("count") - least_shared(F.col("item_words"), share) + 1))
    return needed.select("item_no", "item_words", "item_pos", "item_last", "shingle")


def _search(docs: DataFrame, items: list[tuple[int, str]], share: float) -> DataFrame:
    """One pass: ``items`` (id, text) are few enough for their shingles to be sent to all workers."""
    spark = docs.sparkSession
    rows, longest = [], 0
    for no, (_, text) in enumerate(items):
        tokens = words(text)
        at: dict[int, list[int]] = {}
        for p, h in enumerate(shingles(tokens).tolist()):
            at.setdefault(h, []).append(p)
        longest = max(longest, len(tokens))
        rows.extend((no, len(tokens), h, min(p), max(p)) for h, p in at.items())
    of_items = spark.createDataFrame(rows, "item_no int, item_words int, shingle long, item_pos int, item_last int")
    wanted = spark.sparkContext.broadcast((np.unique(np.array([r[2] for r in rows], np.int64)), reach(longest)))
    # the texts are read once: what several branches of the plan need of them is written to the shared folder
    checkpoint_dir(spark)
    found = docs.mapInArrow(partial(_hit_documents, wanted=wanted), _HIT_DOCUMENTS).checkpoint()
    hits = found.select("doc_id", "n_words", F.explode("hits").alias("h")).select("doc_id", "n_words", "h.pos", "h.shingle")
    prefix = _prefixes(of_items, hits.groupBy("shingle").agg(F.count("*").alias("frequency")), share)
    # hits of a stock phrase go to several tasks
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copied = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    need = F.ceil(F.col("item_words") * F.lit(share))
    pairs = salted.join(copied, ["shingle", "salt"]).filter(_may_reach(need)).select("item_no", "doc_id").distinct()
    known = spark.sparkContext.broadcast(items)
    return pairs.join(found, "doc_id").mapInArrow(partial(_verify, items=known, share=share), "item_id long, doc_id long, share double")


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, shingles_a_pass: int = SHINGLES_A_PASS) -> DataFrame:
    """(item_id, doc_id, share), distinct: the items of which at least ``share`` recurs in the document.

    documents: doc_id long, text; items: item_id long, text; other columns are dropped. Null, empty and blank texts and
    rows without id are in no pair, items of under SHINGLE words can't be found; repeated rows give one pair. Items are
    searched for in passes over the documents, each for a hash part of the items of about ``shingles_a_pass`` shingles."""
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    its = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    # a shingle begins with each word, and a word is a letter and a space at least
    size = its.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-size // (2 * shingles_a_pass)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    each = [_search(docs, [tuple(r) for r in its.filter(part == k).collect()], share) for k in range(passes)]
    return reduce(DataFrame.unionByName, each).groupBy("item_id", "doc_id").agg(F.max("share").alias("share"))
