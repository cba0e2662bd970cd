"""Languages of documents and of the segments of mixed ones.

A document is a mixture: each of its sentences comes from one language, the languages have proportions. Likelihoods come
from character n-grams; expectation-maximisation over all languages finds the proportions; a language is dropped from the
set when the likelihood it adds is less than its penalty. Sentences then get the language of the greatest posterior under
the document's proportions, neighbours of one language are a segment. N-grams overlap and depend on each other, so their
likelihoods are tempered until posteriors say how often they are right, as measured on held-out fragments."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled sentences the model is fitted on at most, taken in order of sample_id.
TRAINING_ROWS = 20_000
#: Documents that the model learns from besides, if their label agrees with what it finds in them, and the sentences taken
#: of each, by their hash: bounds of a draw for fitting alone.
REFIT_DOCUMENTS, REFIT_SENTENCES = 3_000, 6
#: Orders of the character n-grams, and the hashed table's rows.
ORDERS, BUCKETS = (1, 2, 3, 4, 5), 1 << 17
#: Letters scored at a time.
BLOCK = 1 << 16
#: Share of an n-gram's probability that is spread over all n-grams.
SMOOTHING = 0.05
#: N-grams of all orders overlap, so each counts for a part only.
OVERLAP = 1.0 / len(ORDERS)
#: Tempers tried when posteriors are calibrated, and words of the held-out fragments they are calibrated on.
TEMPERS, FRAGMENTS = tuple(float(t) for t in np.geomspace(0.05, 2.0, 24)), (1, 2, 3, 5, 8)
#: A further language must raise the document's log likelihood, before tempering, by so much. One whole sentence raises it
#: by far more, an odd phrase, a name or a slip by less.
PENALTY = 30.0
#: Letters of a whole sentence: at least so many of an alphabet in so many words, or so many of a script without spaces.
SENTENCE_LETTERS, SENTENCE_WORDS, SENTENCE_SIGNS = 18, 4, 8

_SCRAP = regex.compile(r"#{1,6} [^\n]*|```.*?```|`[^`\n]*`|<[/!?]?[A-Za-z][^<>]*>|&(?:#\d+|[a-zA-Z]{2,8});|https?://\S+|\{[^{}]*\}|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]", regex.S)
_HAS_SCRAP = re.compile(r"[#`<&{(（\[]|://")
_BREAK = re.compile(r"(?<=[。！？])|(?<=[.!?…])[\"'”»)]*\s+|\n\s*\n|\n(?=\s*(?:[-*#•]|\d+[.)]|[A-Z]:)\s)")
_ASCII_CONTROLS = {i: None for i in range(32) if not chr(i).isspace()} | {127: None}
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Co}\p{Cn}]|[\p{Cc}--\s]", regex.V1)
_CODE = re.compile(r"(?<![A-Za-z])[A-Za-z]*\d[A-Za-z\d]*")
#: Ends of a sentence, maybe in quotes; what begins or ends with dots was cut off.
_ENDED = re.compile(r"[.!?。！？;:][\"'”»)\]]*$")
_UNLETTER = regex.compile(r"[^\p{L}\p{M}]+")
_ASCII_UNLETTER = re.compile(r"[^a-z]+")
_SIGN = re.compile("[\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")

#: Names of the languages in ISO 639-1, ISO 639-2 and ISO 639-2/B.
ISO = {
    "en": ("en", "eng"), "de": ("de", "deu", "ger"), "fr": ("fr", "fra", "fre"), "es": ("es", "spa"), "pt": ("pt", "por"), "it": ("it", "ita"),
    "nl": ("nl", "nld", "dut"), "sv": ("sv", "swe"), "da": ("da", "dan"), "pl": ("pl", "pol"), "ja": ("ja", "jpn"),
}


def iso_language(label: Column) -> Column:
    """ISO 639-1 code of a label in any notation (case, padding, three letters, with a region), else null."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_][a-z0-9-_]*)?$", 1)
    pairs = [F.lit(x) for code, names in ISO.items() for name in names for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), head)


def _split(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _BREAK.split(text)) if s]


def _unless_sentences(m: regex.Match) -> str:
    """What stands in brackets is a scrap unless it holds whole sentences, however long it is."""
    found = m[0]
    return found if found[0] in "([（" and any(is_whole(s, letters(s)) for s in _split(found[1:-1])) else " "


def sentences(text: str) -> list[str]:
    """Stretches up to a sentence's end, in order, without scraps: mark-up, headings, code, data, links, phrases in
    brackets."""
    text = text.translate(_ASCII_CONTROLS) if text.isascii() else _INVISIBLE.sub("", text)
    if _HAS_SCRAP.search(text):
        text = _SCRAP.sub(_unless_sentences, text)
    return _split(text)


def letters(sentence: str) -> str:
    """What n-grams are taken of: small letters, one space between words."""
    plain = sentence.isascii()
    flat = _CODE.sub(" ", sentence if plain else unicodedata.normalize("NFKC", sentence)).lower()
    return " " + (_ASCII_UNLETTER if plain else _UNLETTER).sub(" ", flat).strip() + " "


def is_whole(sentence: str, flat: str) -> bool:
    if sentence[0] == "…" or sentence.startswith("...") or sentence[-1] == "…" or sentence.endswith("...") or not _ENDED.search(sentence):
        return False
    if not flat.isascii() and len(_SIGN.findall(flat)) >= SENTENCE_SIGNS:
        return True
    return len(flat.split()) >= SENTENCE_WORDS and len(flat.replace(" ", "")) >= SENTENCE_LETTERS


def _grams(flats: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(table rows, owner) of blocks of BLOCK letters: of each order, and of blocks of letters at last, the row of the n-gram
    that begins at each letter, BUCKETS if it would end in another of ``flats``; and which of them each letter belongs to
    (ascending)."""
    codes = np.frombuffer("".join(flats).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(flats)), [len(f) for f in flats])
    for lo in range(0, len(codes), BLOCK):
        n = min(BLOCK, len(codes) - lo)
        here, whose = codes[lo : lo + n + max(ORDERS) - 1], owner[lo : lo + n + max(ORDERS) - 1]
        found = []
        h = np.zeros(len(here), np.uint32)
        for k in range(max(ORDERS)):
            h = (h[: len(here) - k] ^ (here[k:] + np.uint32(k + 1))) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                rows = np.full(n, BUCKETS)
                m = min(n, len(h))
                rows[:m] = np.where(whose[:m] == whose[k : k + m], h[:m] & np.uint32(BUCKETS - 1), BUCKETS)
                found.append(rows)
        # which script a letter is of says something of letters never seen, too
        found.append(((here[:n] >> np.uint32(7)) * np.uint32(0x9E3779B1) >> np.uint32(9) & np.uint32(BUCKETS - 1)).astype(np.int64))
        yield found, whose[:n]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS + 1 x languages: log probabilities, the last row zeros
    temper: float = 1.0  # by which log likelihoods are multiplied so that posteriors are calibrated

    def scores(self, flats: list[str], table: np.ndarray | None = None) -> np.ndarray:
        """Log likelihood of each of ``flats`` (none empty) in each language."""
        table = self.table if table is None else table
        out = np.zeros((len(flats), table.shape[1]))
        cuts, letters_ = [0], 0
        for i, f in enumerate(flats):  # blocks begin with a sentence, so its sums don't hang on what stands before it
            if letters_ and letters_ + len(f) > BLOCK:
                cuts.append(i)
                letters_ = 0
            letters_ += len(f)
        for lo, hi in zip(cuts, [*cuts[1:], len(flats)]):
            for rows, owner in _grams(flats[lo:hi]):
                each = table.take(rows[0], axis=0)
                for more in rows[1:]:
                    each += table.take(more, axis=0)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
                out[lo + owner[starts]] += np.add.reduceat(each, starts, axis=0)
        return out * OVERLAP

    def fragment(self, flats: list[str]) -> tuple[int, float]:
        """(language, confidence) of letters that make no whole sentence. Besides the languages there is a blend of all,
        which is as likely as they are for what says nothing about any of them: that bounds the confidence."""
        top = self.table.max(axis=1, keepdims=True)
        blend = top[:, 0] + np.log(np.exp(self.table - top).mean(axis=1))
        total = self.temper * np.append(self.scores(flats).sum(axis=0), self.scores(flats, blend[:, None]).sum())
        odds = np.exp(total - total.max())
        k = int(total[:-1].argmax())
        return k, float(odds[k] / odds.sum())


def _fitted(samples: list[tuple[str, str]]) -> Model:
    languages = sorted({lang for lang, _ in samples})
    counts = np.zeros((BUCKETS + 1, len(languages)))
    totals = np.zeros((len(ORDERS) + 1, len(languages)))
    kind = np.zeros(BUCKETS + 1, np.int64)
    for k, language in enumerate(languages):
        texts = [t for lang, t in samples if lang == language]
        plain = ["".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in texts]
        for forms, weight in ((texts, 1.0), (plain, 0.4)):
            for found, _ in _grams([letters(f) for f in forms]):
                for order, rows in enumerate(found):
                    times = np.bincount(rows, minlength=BUCKETS + 1)
                    times[BUCKETS] = 0
                    counts[:, k] += weight * times
                    totals[order, k] += weight * times.sum()
                    kind[times > 0] = order
    share = counts / np.maximum(totals[kind], 1.0)
    table = np.log((1 - SMOOTHING) * share + SMOOTHING / 2000.0).astype(np.float32)
    table[BUCKETS] = 0.0
    return Model(languages, table)


def calibrated_temper(model: Model, held_out: list[tuple[str, str]]) -> float:
    """The temper under which the posteriors of fragments of ``held_out`` fit best what they are."""
    known = [(model.languages.index(lang), letters(t).split() if not _SIGN.search(t) else list(letters(t).strip())) for lang, t in held_out if lang in model.languages]
    cut = [(k, f" {('' if len(w[0]) == 1 and _SIGN.match(w[0]) else ' ').join(w[i : i + n])} ") for k, w in known for n in FRAGMENTS for i in range(0, len(w) - n + 1, n)]
    if not cut:
        return 1.0
    scores = model.scores([f for _, f in cut])
    right = np.array([k for k, _ in cut])

    def loss(temper: float) -> float:
        x = temper * scores
        x -= x.max(axis=1, keepdims=True)
        return float(np.log(np.exp(x).sum(axis=1)).mean() - x[np.arange(len(right)), right].mean())

    return min(TEMPERS, key=loss)


def fit(samples: list[tuple[str, str]], temper: float | None = None) -> Model:
    """samples: (language, text). Each is learnt as it stands and without its accents, as texts come both ways. Without a
    ``temper`` it is calibrated on one half of the samples by a model of the other."""
    model = _fitted(samples)
    if temper is None:
        learnt, held_out = samples[::2], samples[1::2]
        temper = calibrated_temper(_fitted(learnt), held_out) if held_out else 1.0
    model.temper = temper
    return model


def proportions(scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, proportions of the languages, posteriors by sentence) by expectation-maximisation, from equal
    proportions until they stand still. ``scores``: log likelihoods, sentences x languages."""
    share = np.full(scores.shape[1], 1.0 / scores.shape[1])
    top = scores.max(axis=1, keepdims=True)
    odds = np.exp(scores - top)
    while True:
        joint = odds * share
        mass = joint.sum(axis=1, keepdims=True)
        post = joint / mass
        new = post.mean(axis=0)
        if np.abs(new - share).max() < 1e-6:
            return float((np.log(mass) + top).sum()), new, post
        share = new


def mixture(scores: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(language set, proportions, posteriors by sentence): proportions over all languages first; then, one after another,
    the language that would be missed least goes, while the log likelihood loses less than ``penalty``."""
    kept = list(range(scores.shape[1]))
    value, share, post = proportions(scores)
    # without a language the likelihood loses no more than this, so those that add next to nothing can go at once
    loss = -np.log(np.maximum(1 - post, 1e-300)).sum(axis=0)
    order = np.argsort(loss)
    idle = {int(k) for k in order[np.cumsum(loss[order]) < 1e-3 * penalty][: len(kept) - 1]}
    if idle:
        kept = [k for k in kept if k not in idle]
        if len(kept) == 1:
            return kept, np.ones(1), np.ones((len(scores), 1))
        value, share, post = proportions(scores[:, kept])
    while len(kept) > 1:
        tries = [(proportions(scores[:, [k for k in kept if k != out]]), out) for out in kept]
        (less, less_share, less_post), out = max(tries, key=lambda t: t[0][0])
        if value - less >= penalty:
            break
        kept = [k for k in kept if k != out]
        value, share, post = less, less_share, less_post
    return kept, share, post


def _parts(text: str | None) -> tuple[list[tuple[str, str]], bool]:
    """((sentence, its letters) of whole sentences, True), or of all stretches with letters, False, if none is whole."""
    parts = [(s, letters(s)) for s in sentences(text or "")]
    whole = [(s, f) for s, f in parts if is_whole(s, f)]
    return (whole, True) if whole else ([(s, f) for s, f in parts if f.strip()], False)


def _languages_of(model: Model, parts: list[tuple[str, str]], whole: bool, scores: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """(segments, languages) of a document's parts and their scores; see ``document_languages``."""
    if not parts:
        return [], []
    if not whole:
        k, confidence = model.fragment([f for _, f in parts])
        return [(1, " ".join(s for s, _ in parts), model.languages[k], confidence, 0)], [(model.languages[k], 1.0)]
    kept, share, post = mixture(model.temper * scores, model.temper * PENALTY)
    best = post.argmax(axis=1)
    out: list[list] = []
    for (sentence, _), k, p in zip(parts, best.tolist(), post[np.arange(len(best)), best].tolist()):
        if out and out[-1][2] == model.languages[kept[k]]:
            out[-1][1].append(sentence)
            out[-1][3].append(p)
        else:
            out.append([len(out) + 1, [sentence], model.languages[kept[k]], [p]])
    languages = sorted(((model.languages[k], float(x)) for k, x in zip(kept, share)), key=lambda x: (-x[1], x[0]))
    return [(n, " ".join(t), lang, sum(c) / len(c), len(c)) for n, t, lang, c in out], languages


def documents_languages(model: Model, texts: list[str | None]) -> list[tuple[list[tuple], list[tuple]]]:
    """(segments, languages) of each text. Sentences of all of them are scored together; what a text gets depends on it alone."""
    split = [_parts(t) for t in texts]
    flats = [f for parts, whole in split if whole for _, f in parts]
    scores = model.scores(flats) if flats else np.zeros((0, len(model.languages)))
    out, at = [], 0
    for parts, whole in split:
        n = len(parts) if whole else 0
        out.append(_languages_of(model, parts, whole, scores[at : at + n]))
        at += n
    return out


def document_languages(model: Model, text: str | None) -> tuple[list[tuple[int, str, str, float, int]], list[tuple[str, float]]]:
    """(segments, languages). Segments, in order: (number, text, language, confidence, whole sentences). Languages: (language,
    proportion), the greatest first. A text with letters but without whole sentences is one segment of 0 sentences with
    the language it is likeliest of; one without letters has none."""
    return documents_languages(model, [text])[0]


_SEGMENT = pa.list_(pa.struct([("segment", pa.int32()), ("text", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())]))
_LANGUAGE = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _named(rows: list[tuple], kind: pa.ListType) -> list[dict]:
    names = [f.name for f in kind.value_type]
    return [dict(zip(names, r)) for r in rows]


def _segments(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for batch in batches:
        for lo in range(0, batch.num_rows, 32):
            part = batch.slice(lo, 32)
            found = documents_languages(m, part.column("text").to_pylist())
            segments, languages = pa.array([_named(s, _SEGMENT) for s, _ in found], _SEGMENT), pa.array([_named(x, _LANGUAGE) for _, x in found], _LANGUAGE)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), segments, languages], names=["doc_id", "label", "segments", "languages"])


def labelled_samples(samples: DataFrame, training_rows: int = TRAINING_ROWS) -> list[tuple[str, str]]:
    rows = samples.select("sample_id", "lang", "text").filter("lang is not null and text is not null").orderBy("sample_id").limit(training_rows).collect()
    return [(r["lang"], r["text"]) for r in rows]


def _agreeing(batches: Iterator[pa.RecordBatch], model: object, refit_sentences: int) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for batch in batches:
        langs, texts = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            found, _ = document_languages(m, text)
            if len(found) == 1 and found[0][2] == label and found[0][4]:
                whole = {s for s in sentences(text) if is_whole(s, letters(s))}
                drawn = sorted(whole, key=lambda s: (zlib.crc32(s.encode()), s))[:refit_sentences]
                langs += [label] * len(drawn)
                texts += drawn
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], names=["lang", "text"])


def drawn_documents(documents: DataFrame, refit_documents: int) -> DataFrame:
    """``refit_documents`` of the labelled documents, those whose ids have the least hashes. All are counted, by their label
    alone; then a bound on the hash that a fifth more are below lets hardly more than the draw leave the scan."""
    labelled = documents.filter("label is not null")
    part = min(1.0, 1.2 * refit_documents / max(1, labelled.count()))
    below = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int(part * (1 << 40)))
    return labelled.filter(below & F.col("text").isNotNull()).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(refit_documents)


def refitted(model: Model, samples: list[tuple[str, str]], documents: DataFrame, refit_documents: int = REFIT_DOCUMENTS, refit_sentences: int = REFIT_SENTENCES) -> Model:
    """A model that knows the corpus' words, too: fitted on the samples and on ``refit_sentences`` sentences each of
    ``refit_documents`` drawn documents whose label agrees with the only language the first model finds. No more than these
    reach the driver. Without such documents it is the first model."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    agreeing = partial(_agreeing, model=shared, refit_sentences=refit_sentences)
    more = drawn_documents(documents, refit_documents).repartition(8).mapInArrow(agreeing, "lang string, text string").collect()
    return fit([*samples, *((r["lang"], r["text"]) for r in more if r["lang"] in model.languages)], model.temper) if more else model


def segments(documents: DataFrame, samples: DataFrame, training_rows: int = TRAINING_ROWS, refit_documents: int = REFIT_DOCUMENTS, refit_sentences: int = REFIT_SENTENCES) -> DataFrame:
    """(doc_id, label, segments, languages): the label as ISO code or null, the document's segments in order, and its
    languages with their proportions.

    documents: doc_id long, text, lang; samples: sample_id, lang, text; other columns are dropped. A text without whole
    sentences has one segment of 0 sentences with the likeliest language and what that is worth as confidence; one without
    letters (null, empty, blank, numbers) has none. Rows stay where they are; repeated rows are repeated."""
    rows = documents.select("doc_id", "text", iso_language(F.col("lang")).alias("label"))
    known = labelled_samples(samples, training_rows)
    model = documents.sparkSession.sparkContext.broadcast(refitted(fit(known), known, rows, refit_documents, refit_sentences))
    ddl = "doc_id long, label string, segments array<struct<segment:int,text:string,lang:string,confidence:double,sentences:int>>, languages array<struct<lang:string,share:double>>"
    return rows.mapInArrow(partial(_segments, model=model), ddl)


def mislabelled(labelled: DataFrame) -> DataFrame:
    """(doc_id, lang), distinct: of documents whose label is missing or not of their languages, or that have several, a row
    per language they have whole sentences in. ``labelled`` is what ``segments`` gives."""
    langs = F.array_distinct(F.transform(F.filter("segments", lambda s: s["sentences"] > 0), lambda s: s["lang"]))
    cases = labelled.select("doc_id", "label", langs.alias("langs")).filter((F.size("langs") > 1) | ((F.size("langs") == 1) & ~F.coalesce(F.array_contains("langs",
        F.col("label")), F.lit(False))))
    return cases.select("doc_id", F.explode("langs").alias("lang")).distinct()
