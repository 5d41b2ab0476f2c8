"""The six text features of a candidate in one pass over code points, a batch of documents at a time.

Classes of code points come from one table; words and lines are spans of it, and repeated ones are told by 64-bit hashes of their code points
within a document. The definitions are those of ``gristmill.functions.text``, whose expressions compute each feature on its own in the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.constants import LATIN, SCRIPT_RANGES, SEGMENTED, STOPWORDS
from gristmill.functions.text import EDGE_MARKS
from gristmill.hashing import U64, mix, spans_hash

#: Bits of a code point's class; the scripts' follow.
LETTER, NUMBER, SPACE, DIGIT, BREAK = 1, 2, 4, 8, 16
SCRIPTS = list(dict.fromkeys([tuple(LATIN), *map(tuple, SCRIPT_RANGES.values())]))
FIRST_SCRIPT = 5
#: Code points of the texts that are handled at a time, at some 200 bytes each; a longer text is a part of its own.
PART = 1 << 17
FEATURES = ("repetition_score", "target_script_ratio", "stopword_ratio", "symbol_ratio", "numeric_ratio", "is_latin")
DDL = "struct<repetition_score:double,target_script_ratio:double,stopword_ratio:double,symbol_ratio:double,numeric_ratio:double,is_latin:int>"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point; made once for a worker."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    out = np.array([LETTER if k == "L" else NUMBER if k == "N" else 0 for k in kinds], np.uint32)
    some = np.flatnonzero(out & NUMBER)
    out[[c for c in some.tolist() if chr(c).isdigit()]] |= DIGIT
    out[[c for c in range(0x3001) if chr(c).isspace()]] |= SPACE
    out[[c for c in range(0x202A) if len(f"a{chr(c)}a".splitlines()) == 2]] |= BREAK
    for k, ranges in enumerate(SCRIPTS):
        for a, b in ranges:
            out[a : b + 1] |= np.uint32(1 << (FIRST_SCRIPT + k))
    return out


@lru_cache(maxsize=1)
def _stop_hashes() -> dict[str, np.ndarray]:
    return {lang: np.unique(np.array([_hash(w) for w in words], U64)) for lang, words in STOPWORDS.items() if lang in SEGMENTED}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _hash(word: str) -> int:
    codes = _codes(word)
    return int(mix(spans_hash(codes + np.uint32(1), np.array([0]), np.array([len(codes)])))[0])


def _words(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    return np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)


def _repeated(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of each document, and the share of them that repeat another."""
    many = np.bincount(doc, minlength=n)
    _, first = np.unique(mix(values + doc.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), return_index=True)
    return many, np.where(many > 0, 1 - np.bincount(doc[first], minlength=n) / np.maximum(many, 1), 0.0)


def _stopwords(texts: list[str], langs: list[str | None]) -> np.ndarray:
    """Shares of function words. Texts in lower case are joined by line feeds, which no word crosses."""
    out = np.zeros(len(texts))
    known = _stop_hashes()
    for k, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        if lang in STOPWORDS and lang not in known:  # scripts without word spaces
            out[k] = min(1.0, sum(t.count(w) for w in STOPWORDS[lang]) / max(1.0, len(t) / 20.0))
    some = [k for k, lang in enumerate(langs) if lang in known]
    if not some:
        return out
    low = [texts[k].lower() for k in some]
    codes = _codes("\n".join(low))
    starts = np.cumsum([0, *(len(t) + 1 for t in low)])
    kinds = classes()[codes]
    start, end = _words((kinds & SPACE) > 0)
    doc = np.searchsorted(starts, start, side="right") - 1
    mark = np.zeros(len(codes) + 1, bool)
    mark[:-1] = np.isin(codes, [ord(c) for c in EDGE_MARKS])
    words = np.bincount(doc, minlength=len(some))
    while (go := (start < end) & mark[start]).any():
        start = start + go
    while (go := (start < end) & mark[end - 1]).any():
        end = end - go
    hashes = mix(spans_hash(codes + np.uint32(1), start, end))
    hit = np.zeros(len(doc), bool)
    for lang in {langs[k] for k in some}:
        own = np.array([langs[k] == lang for k in some], bool)[doc]
        hit[own] = (start[own] < end[own]) & np.isin(hashes[own], known[lang])
    out[some] = np.where(words > 0, np.bincount(doc[hit], minlength=len(some)) / np.maximum(words, 1), 0.0)
    return out


def part_features(texts: list[str], langs: list[str | None]) -> list[np.ndarray]:
    """The features of some documents, in the order of ``FEATURES``."""
    n, lengths = len(texts), np.array(list(map(len, texts)), np.int64)
    codes = _codes("\n".join(texts) + "\n")
    bounds = np.cumsum(np.r_[0, lengths + 1])
    kinds = classes()[codes]

    def count(flags: np.ndarray) -> np.ndarray:
        """How many code points of each document have a flag; the line feed after it isn't one of them."""
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[bounds[1:] - 1] - total[bounds[:-1]]

    letter = (kinds & LETTER) > 0
    letters = count(letter)
    inside = np.zeros(n, np.int64)
    script_of = {lang: SCRIPTS.index(tuple(r)) for lang, r in SCRIPT_RANGES.items()}
    own = np.array([script_of.get(lang, -1) for lang in langs])
    latin = count(letter & ((kinds >> np.uint32(FIRST_SCRIPT)) & np.uint32(1) > 0))
    for k in set(own.tolist()) - {-1}:
        inside = np.where(own == k, latin if k == 0 else count(letter & ((kinds >> np.uint32(FIRST_SCRIPT + k)) & np.uint32(1) > 0)), inside)
    share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 0.0)
    symbols = count((kinds & (LETTER | NUMBER | SPACE)) == 0)
    numbers = count((kinds & DIGIT) > 0)

    start, end = _words((kinds & SPACE) > 0)
    doc = np.searchsorted(bounds, start, side="right") - 1
    hashes = mix(spans_hash(codes + np.uint32(1), start, end))
    breaks = np.cumsum((kinds & BREAK) > 0)
    line = breaks[start] if len(start) else start
    opens = np.flatnonzero(np.r_[True, (line[1:] != line[:-1])]) if len(start) else start
    closes = np.r_[opens[1:], len(start)][: len(opens)] - 1
    _, by_line = _repeated(doc[opens], mix(spans_hash(codes + np.uint32(1), start[opens], end[closes])), n)
    three = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    trigram = mix(mix(hashes[three] * U64(3) + hashes[three + 1]) * U64(5) + hashes[three + 2])
    _, by_trigram = _repeated(doc[three], trigram, n)
    words = np.bincount(doc, minlength=n)
    repetition = np.where(words < 6, by_line, np.maximum(by_line, by_trigram))
    return [repetition, share(inside, letters), _stopwords(texts, langs), share(symbols, lengths), share(numbers, lengths), ((letters > 0) & (latin * 2 >= letters)).astype(np.int32)]


def features(texts: pa.Array, langs: pa.Array) -> pa.StructArray:
    """The features of a batch; null texts are empty."""
    out: list[list[np.ndarray]] = [[] for _ in FEATURES]
    text, lang, size = [], [], 0

    def give() -> None:
        for column, values in zip(out, part_features(text, lang), strict=True):
            column.append(values)

    for t, own in zip(texts, langs.to_pylist(), strict=True):
        text.append(t.as_py() or "")
        lang.append(own)
        size += len(text[-1])
        if size > PART:
            give()
            text, lang, size = [], [], 0
    if text:
        give()
    kinds = [pa.float64()] * 5 + [pa.int32()]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds, strict=True)], names=list(FEATURES))


def with_features(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``df`` with the six features, computed in one pass; columns of their names are replaced.

    Spark takes the function as not deterministic, else a filter on a feature goes below it and computes it a second time, with a second Python process for each task.
    """

    @F.arrow_udf(DDL)
    def run(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return features(texts, langs)

    run = run.asNondeterministic()
    kept = [c for c in df.columns if c not in FEATURES]
    return df.withColumn("__features", run(F.col(text_col), F.col(lang_col))).select(*(F.col(f"`{c}`") for c in kept), "__features.*")
