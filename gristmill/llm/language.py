"""Language of texts by cross parsing: the language whose sample cuts a text into the fewest phrases.

A phrase is the longest stretch of the text, from where the last one ended, that occurs anywhere in a language's sample. The suffix automaton
of the sample tells, symbol by symbol, whether the stretch still occurs. The number of phrases times the bits that name a place in the
sample, by symbol, is the text's cross entropy; samples of several sizes compare by it.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import U64, Text, chunks, mix, named, settle, spans_hash, table

UNKNOWN = "und"
#: Symbols that are parsed as one piece; a text's phrases are those of its pieces, so long texts are parsed as fast as short ones.
PIECE = 512
#: Languages whose automata a task holds at a time; with more of them rows go through several passes of one stage.
BLOCK = 16
#: A sample's rows give excerpts of so many characters.
EXCERPT = 600
#: A word counts where it begins a run of so many words that the text (or the samples) hasn't had before.
RUN = 4

#: Hashes are cut to this range where a share of the rows is taken.
SHARE = 1 << 30

_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point 2 for a letter, 1 for a mark (part of a letter before it), 0 for all else."""
    if not _KINDS:
        _KINDS.append(np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8))
    return _KINDS[0]


def symbols_of(text: str) -> str:
    """A text as its letters, A-Z and a-z alike, with one space for what is between them."""
    kept = "".join(c if kinds()[ord(c)] else " " for c in text.lower())
    return " ".join(kept.split())


def alphabet_of(samples: list[str], most: int) -> str:
    """The commonest symbols of all samples, the space first."""
    counts = Counter()
    for s in samples:
        counts.update(s)
    counts.pop(" ", None)
    return " " + "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: most - 2])


def samples_of(rows: list[tuple[str, int, str]]) -> dict[str, str]:
    """Each language's excerpts in order as one text. Runs of words that came before in it are left out, and those that several languages
    have: licences, menus and the like tell nothing of a language."""
    words: dict[str, list[str]] = {}
    for lang, _, excerpt in sorted(rows):
        words.setdefault(lang, []).extend(symbols_of(excerpt).split())
    runs = {lang: [tuple(own[k : k + RUN]) for k in range(len(own))] for lang, own in words.items()}
    langs = Counter(run for own in runs.values() for run in set(own))
    out = {}
    for lang, own in words.items():
        seen: set[tuple] = set()
        kept = []
        for word, run in zip(own, runs[lang], strict=True):
            if langs[run] == 1 and run not in seen:
                kept.append(word)
            seen.add(run)
        out[lang] = " ".join(kept or own)
    return out


def automaton(codes: bytes) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton; state 0 is the start."""
    steps, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = cur
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return steps


def _built(alphabet: str, symbols: int):
    """A language's sample to its automaton: (language, size of the sample, states, and the transitions as arrays)."""
    code = {c: k for k, c in enumerate(alphabet)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        text = rows["sample"].iloc[0][:symbols]
        steps = automaton(bytes(code.get(c, len(alphabet)) for c in text))
        source = np.repeat(np.arange(len(steps)), [len(x) for x in steps])
        by = np.array([c for x in steps for c in x], np.uint8)
        to = np.array([s for x in steps for s in x.values()], np.int32)
        known = by < len(alphabet)  # a symbol outside the alphabet matches nothing
        return pd.DataFrame([{"lang": rows["lang"].iloc[0], "size": len(text), "states": len(steps), "source": source[known].astype(np.int32).tobytes(), "by": by[known].tobytes(), "goes": to[known].tobytes()}])

    return run


class Tables:
    """The automata of some languages in one array. State 0 is none; each language has its states, and one that nothing leaves."""

    def __init__(self, alphabet: str, models: list[dict]):
        self.langs = [m["lang"] for m in models]
        self.width = len(alphabet) + 1
        self.bits = np.array([np.log2(max(m["size"], 2)) for m in models])
        states = 1 + sum(m["states"] + 1 for m in models)
        step = np.zeros((states, self.width), np.int32)
        self.first = np.zeros((len(models), self.width), np.int32)
        at = 1
        for k, m in enumerate(models):
            source, by, goes = np.frombuffer(m["source"], np.int32), np.frombuffer(m["by"], np.uint8), np.frombuffer(m["goes"], np.int32)
            step[source + at, by] = goes + at
            alone = at + m["states"]
            self.first[k] = np.where(step[at] > 0, step[at], alone)  # a symbol that the sample lacks is a phrase of its own
            at = alone + 1
        self.step = step.reshape(-1)
        known = np.full(0x110000, len(alphabet), np.uint8)
        known[kinds() == 0] = 0
        for k, c in enumerate(alphabet):
            known[ord(c)] = k
            if len(c.upper()) == 1:
                known[ord(c.upper())] = k
        self.symbol = known

    def phrases(self, pieces: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(languages, pieces): the phrases of each piece. ``pieces`` is time-major, the longest first."""
        out = np.ones((len(self.langs), len(length)), np.int64)
        if not len(length):
            return out
        state = self.first[:, pieces[0]]
        for t in range(1, int(length[0])):
            k = int(np.searchsorted(-length, -t))  # pieces that have a symbol here
            sym = pieces[t, :k]
            further = self.step[state[:, :k] * self.width + sym]
            miss = further == 0
            out[:, :k] += miss
            state = np.where(miss, self.first[:, sym], further)
        return out


def _unrepeated(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the words that begin a run of words which their document had before, so that what a text says again and again counts once."""
    if not len(sym):
        return sym, doc
    new = np.ones(len(sym), bool)
    new[1:] = (doc[1:] != doc[:-1]) | ((sym[1:] != 0) & (sym[:-1] == 0))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(sym))
    h = mix(spans_hash(sym.astype(U64) + U64(1), start, end))
    owner = doc[start]
    run = mix(owner.astype(U64))
    for k in range(min(RUN, len(h))):
        far = np.zeros(len(h), U64)
        far[: len(h) - k] = np.where(owner[k:] == owner[: len(h) - k], h[k:], U64(0))
        run = mix(run + far)
    first = np.zeros(len(h), bool)
    first[np.unique(run, return_index=True)[1]] = True
    kept = np.repeat(first, end - start)
    return sym[kept], doc[kept]


def _parsed(text: Text, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(languages, documents) phrases of a chunk, and each document's symbols, and whether it has a letter."""
    points = np.frombuffer(text.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum((text.data & 0xC0) != 0x80)])
    starts = before[text.offsets]
    n = len(text)
    doc = np.repeat(np.arange(n), np.diff(starts))
    has_letter = np.bincount(doc, weights=kinds()[points] == 2, minlength=n) > 0
    sym = tables.symbol[points]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])  # spaces in a row are one
    sym, doc = _unrepeated(sym[keep], doc[keep])
    size = np.bincount(doc, minlength=n)
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[:-1]
    some = -(-size // PIECE)
    owner = np.repeat(np.arange(n), some)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some)
    start = begin[owner] + nth * PIECE
    length = np.minimum(PIECE, begin[owner] + size[owner] - start)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    longest = int(length[0]) if len(length) else 0
    place = start + np.arange(longest)[:, None]
    pieces = sym[np.minimum(place, max(len(sym) - 1, 0))] if longest else np.zeros((0, 0), np.uint8)
    found = tables.phrases(pieces, length)
    out = np.stack([np.bincount(owner, weights=row, minlength=n) for row in found])
    return out, size, has_letter


ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang_pred", pa.string()), ("least", pa.float64()), ("second", pa.float64())])
DDL = "doc_id long, text string, lang_pred string, least double, second double"
_AT_HAND: dict[str, Tables] = {}


def _pass(key: str, alphabet: str, models):
    """One pass over a block of languages; it carries the best language so far and the two least rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _AT_HAND.get(key)
        if tables is None:
            while len(_AT_HAND) > 1:
                _AT_HAND.pop(next(iter(_AT_HAND)))
            tables = _AT_HAND[key] = Tables(alphabet, models.value)
        langs = np.array([*tables.langs, None], object)
        for batch in batches:
            for text in chunks(batch.column(1), 2_000_000):
                part = batch.slice(text.first, len(text))
                phrases, size, has_letter = _parsed(text, tables)
                rates = phrases * tables.bits[:, None] / np.maximum(size, 1)
                least, second = (np.where(np.isnan(x), np.inf, x) for x in (part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (3, 4)))
                all_ = np.vstack([least, rates, second])
                order = np.argsort(all_, axis=0, kind="stable")
                best = order[0]
                lang = np.where(best == 0, np.array(part.column(2).to_pylist(), object), langs[np.minimum(best - 1, len(langs) - 1)])
                two = np.take_along_axis(all_, order[:2], axis=0)
                lang = np.where(has_letter, lang, None)
                yield table(ROWS, part.column(0), part.column(1), lang.tolist(), two[0], two[1])
        settle()

    return run


def identify(docs: DataFrame, learn, symbols: int = 64_000, sample_rows: int = 2_000, alphabet_size: int = 128, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred and score of every whole text; learned from rows where ``learn`` (a column of ``docs``) is true and text and language are there.

    Fitting takes a bounded sample: of each language ``sample_rows`` rows, those whose ids and texts have the smallest hashes, an excerpt of 600
    characters of each from a place that the hash gives, and ``symbols`` symbols of these. Symbols are lower-cased letters with their marks, and one space for
    all between words; of them the ``alphabet_size`` commonest (254 at most) are told apart. Runs of four words count once in a sample, and not where two
    languages' samples have them (unless nothing is left). Prediction reads the whole of each text, and nothing but the text; a word counts where it begins a run of four words that is new
    in the text, and what counts is parsed in pieces of 512 symbols. An automaton takes about 1.5 states a symbol, so a language some 3 KB for each thousand in the
    broadcast, and ``alphabet_size`` times 6 bytes a symbol in a task, which holds 16 languages at a time; the driver gets the automata only.

    The language of least cross entropy wins, of equal ones the smallest by code points. ``score`` is how much less it is than the
    second's, as a share of it: 0 for a tie, 1 where one language is learned. Null texts and those without a letter are ``und`` with score
    0, and so is every text if nothing was learned. Repeated rows each have their row, an empty table gives none. No shuffle but
    the sample's; texts of any length take memory in proportion. Other columns are not read, whatever their names.
    """
    if not 4 <= alphabet_size <= 254:
        raise ValueError("alphabet_size is from 4 to 254")
    spark = docs.sparkSession
    text, lang = named(text_col).cast("string"), named(lang_col).cast("string")
    hashed = F.xxhash64(named(id_col).cast("string"), text)
    sizes = docs.where(learn & lang.isNotNull()).groupBy(lang.alias("lang")).count().collect()  # a row for each language
    if not sizes:
        return docs.select(named(id_col).cast("long").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    labelled = docs.select(lang.alias("lang"), hashed.alias("h"), text.alias("text"), learn.alias("ok")).where("ok and lang is not null and text is not null and text rlike '\\\\p{L}'")
    span = F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(SHARE, 4 * sample_rows * SHARE // r["count"]))))
    labelled = labelled.where(F.pmod("h", F.lit(SHARE)) < F.element_at(shares, F.col("lang")))  # about four times the sample; the rest is never shuffled
    excerpts = labelled.select("lang", "h", F.substring("text", (F.pmod("h", span) + 1).cast("int"), F.lit(EXCERPT)).alias("excerpt")).distinct()
    picked = excerpts.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "excerpt"))).where(F.col("n") <= sample_rows)
    rows = [(r["lang"], r["n"], r["excerpt"]) for r in picked.collect()]  # bounded by the parameters
    samples = samples_of(rows)
    alphabet = alphabet_of(list(samples.values()), alphabet_size)
    sample = spark.createDataFrame(sorted(samples.items()), "lang string, sample string")
    schema = "lang string, size long, states long, source binary, by binary, goes binary"
    models = sorted((r.asDict() for r in sample.groupBy("lang").applyInPandas(_built(alphabet, symbols), schema).collect()), key=lambda m: m["lang"])
    out = docs.select(named(id_col).cast("long").alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("second"))
    for at in range(0, len(models), BLOCK):
        shared = spark.sparkContext.broadcast(models[at : at + BLOCK])
        out = out.mapInArrow(_pass(f"{shared._jbroadcast.id()}", alphabet, shared), DDL)
    share = F.when(F.col("second") == float("inf"), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("second") - F.col("least"), F.col("second")), F.lit(0.0)))
    return out.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("lang_pred").isNull(), 0.0).otherwise(share).alias("score"))


def language_report(docs: DataFrame, fold: int = 2, folds: int = 4, **options) -> DataFrame:
    """``identify`` learned from documents whose crc32 of the id as text isn't ``fold`` modulo ``folds``; those of the fold are held out.

    doc_id, held_out, lang_pred, score. A null id counts as an empty text (crc32 0).
    """
    left = F.crc32(F.coalesce(named(options.get("id_col", "doc_id")).cast("string"), F.lit("")).cast("binary")) % folds
    found = identify(docs, left != fold, **options)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
