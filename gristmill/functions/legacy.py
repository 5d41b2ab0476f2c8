"""Legacy Burmese text: a detector fitted in Spark, and a converter between the legacy encoding and Unicode.

Both encodings use the code points of one block, the legacy one by how glyphs look: a vowel or medial that is drawn before its consonant is stored before it,
and stacked consonants have code points of their own. So the same code points follow each other in other ways, which is what the detector learns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The legacy code points of stacked consonants, by the consonant.
STACKED = {
    0x1000: 0x1060, 0x1001: 0x1061, 0x1002: 0x1062, 0x1003: 0x1063, 0x1005: 0x1065, 0x1006: 0x1066, 0x1007: 0x1068, 0x1008: 0x1069, 0x100B: 0x106C, 0x100C: 0x106D, 0x100F: 0x1070, 0x1010: 0x1071,
    0x1011: 0x1073, 0x1012: 0x1075, 0x1013: 0x1076, 0x1014: 0x1077, 0x1015: 0x1078, 0x1016: 0x1079, 0x1017: 0x107A, 0x1018: 0x107B, 0x1019: 0x107C, 0x101C: 0x1085,
}
# What other legacy code points stand for: shifted signs, and drawn variants.
SIGNS = {
    0x1039: "်", 0x103A: "ျ", 0x103B: "ြ", 0x103C: "ွ", 0x103D: "ှ", 0x1033: "ု", 0x1034: "ူ", 0x105A: "ါ်", 0x106A: "ဉ", 0x106B: "ည",
    0x1067: "္ဆ", 0x1072: "္တ", 0x1074: "္ထ", 0x107D: "ျ", **dict.fromkeys(range(0x107E, 0x1085), "ြ"), 0x1086: "ဿ", 0x1087: "ှ", 0x1088: "ှု",
    0x1089: "ှူ", 0x108A: "ွှ", 0x108F: "န", 0x1090: "ရ", 0x1094: "့", 0x1095: "့",
}
#: The legacy mark of a consonant that stands under another one's asat, and what it is in Unicode, before its consonant.
KINZI, KINZI_UNICODE = "ၤ", "င်္"
ASAT, VOWEL_E, RA = "်", "ေ", "ြ"
CONSONANT = "[က-အဿ]"

_TO_UNICODE = {**SIGNS, **{legacy: f"္{chr(c)}" for c, legacy in STACKED.items()}}
_LEGACY_SYLLABLE = re.compile(f"({VOWEL_E}?)({RA}?)({CONSONANT})({KINZI}?)((?:္[က-အ])?)([ျွှ]*)")
_SYLLABLE = re.compile(f"((?:{KINZI_UNICODE})?)({CONSONANT})((?:္[က-အ])?)([ျ-ှ]*)({VOWEL_E}?)")
_MEDIALS = {"ျ": "်", "ွ": "ြ", "ှ": "ွ"}


# What a conversion changes, as one match each: signs, and syllables that are written in another order. All else is passed over without a call.
_SIGN = re.compile(f"[{''.join(map(chr, _TO_UNICODE))}]")
_LEGACY_MOVED = re.compile(f"(?:{VOWEL_E}{RA}?|{RA}|(?={CONSONANT}(?:{KINZI}|္[က-အ]|[ျွှ][ျွှ]))){CONSONANT}{KINZI}?(?:္[က-အ])?[ျွှ]*")
_CHANGED = re.compile(f"(?:{KINZI_UNICODE}{CONSONANT}|ဿ|{CONSONANT}(?=[္ျ-ှ{VOWEL_E}]))(?:္[က-အ])?[ျ-ှ]*{VOWEL_E}?|{ASAT}")
#: Syllables that a converter remembers in a process; texts have few different ones.
REMEMBERED = 1 << 12


def _sign(m: re.Match) -> str:
    return _TO_UNICODE[ord(m[0])]


@lru_cache(REMEMBERED)
def _syllable_to_unicode(syllable: str) -> str:
    m = _LEGACY_SYLLABLE.fullmatch(syllable)
    return (KINZI_UNICODE if m[4] else "") + m[3] + m[5] + "".join(sorted(m[2] + m[6])) + m[1]


@lru_cache(REMEMBERED)
def _syllable_to_legacy(syllable: str) -> str:
    if syllable == ASAT:
        return "္"
    m = _SYLLABLE.fullmatch(syllable)
    stack = chr(STACKED[ord(m[3][1])]) if m[3] and ord(m[3][1]) in STACKED else m[3]
    consonant = "ႆ" if m[2] == "ဿ" else m[2]
    return m[5] + ("ျ" if RA in m[4] else "") + consonant + (KINZI if m[1] else "") + stack + "".join(_MEDIALS.get(c, "") for c in m[4])


def to_unicode(text: str) -> str:
    """Legacy text as Unicode: signs by their meaning, all at once, and then each syllable in its order of sound. Text without Burmese stays as it is."""
    return _LEGACY_MOVED.sub(lambda m: _syllable_to_unicode(m[0]), _SIGN.sub(_sign, text))


def to_legacy(text: str) -> str:
    """Unicode text in the legacy encoding; the inverse of ``to_unicode`` for text in canonical order. A stack without a legacy code point stays one."""
    return _CHANGED.sub(lambda m: _syllable_to_legacy(m[0]), text)


FIRST, LAST = 0x1000, 0x109F
#: Symbols: the block's code points, and one for all else.
SYMBOLS = LAST - FIRST + 2
#: Symbols of a window: one, and the four before it. Syllables without a vowel of their own ("ser" and "sre") differ in no shorter span for sure.
WIDTH = 5
#: Windows that a detector keeps at most, the most frequent ones; of the rest it knows the shorter spans within kept ones.
MOST = 1 << 18


def _windows(text: str) -> np.ndarray:
    """The distinct windows of a text as numbers, each once, as repeated words are no further evidence; none without a code point of the block."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = (points >= FIRST) & (points <= LAST)
    if not inside.any():
        return np.zeros(0, np.int64)
    end = SYMBOLS - 1
    symbols = np.concatenate([[end] * (WIDTH - 1), np.where(inside, points - FIRST, end), [end]])
    codes = np.zeros(len(points) + 1, np.int64)
    for k in range(WIDTH):
        codes *= SYMBOLS
        codes += symbols[k : k + len(codes)]
    codes.sort()  # np.unique takes several times as long
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, c, len(found)) for c in counts])


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    known, counts = table
    if not len(known):
        return np.zeros((len(counts), len(keys)))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[:, at], 0.0)


class Detector:
    """Two Markov chains: a symbol's probability after the four before it, mixed with that after three, and so on to none.

    ``windows`` and, for legacy texts and others, the numbers of texts that have each. What a known window says is worked out once, not for each text.
    """

    def __init__(self, windows: np.ndarray, counts: np.ndarray, smoothing: float = 0.5, prior: float = 0.0):
        self.smoothing, self.prior = smoothing, prior
        self.tables = [(_summed(windows % SYMBOLS**k, counts), _summed(windows // SYMBOLS % SYMBOLS ** (k - 1), counts)) for k in range(1, WIDTH + 1)]
        self.known = self.tables[-1][0][0]
        self.evidence = self._weighed(self.known)

    def _weighed(self, windows: np.ndarray) -> np.ndarray:
        """The log odds that each window adds."""
        likely = np.full((2, len(windows)), 1 / SYMBOLS)
        for k, (spans, contexts) in enumerate(self.tables, 1):
            likely = (_found(spans, windows % SYMBOLS**k) + self.smoothing * likely) / (_found(contexts, windows // SYMBOLS % SYMBOLS ** (k - 1)) + self.smoothing)
        old, new = np.log(likely)
        return old - new

    def __call__(self, text: str) -> float:
        """The probability that a text is in the legacy encoding; 0 without a code point of the block."""
        windows = _windows(text)
        if not len(windows):
            return 0.0
        at = np.searchsorted(self.known, windows)
        seen = at < len(self.known)
        seen[seen] = self.known[at[seen]] == windows[seen]
        odds = self.evidence[at[seen]].sum() + self._weighed(windows[~seen]).sum()
        return float(1 / (1 + np.exp(-np.clip(self.prior + odds, -500, 500))))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of texts (text, legacy), with the numbers of legacy texts and of others that have them, about a million at a time. Nulls don't count."""

    def give(held: tuple[list, list]) -> pa.RecordBatch:
        (old, n_old), (new, n_new) = (np.unique(np.concatenate([np.zeros(0, np.int64), *x]), return_counts=True) for x in held)
        counts = np.concatenate([n_old, 0 * n_new]), np.concatenate([0 * n_old, n_new])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([old, new])), *(pa.array(c.astype(np.int64)) for c in counts)], names=["window", "old", "new"])

    held, size = ([], []), 0
    for batch in batches:
        for text, legacy in zip(batch.column(0), batch.column(1), strict=True):
            if not (text.is_valid and legacy.is_valid):
                continue
            own = _windows(text.as_py())
            held[0 if legacy.as_py() else 1].append(own)
            size += len(own)
            if size > 1 << 20:
                yield give(held)
                held, size = ([], []), 0
    if size:
        yield give(held)


def window_counts(texts: DataFrame, text_col: str = "text", legacy_col: str = "legacy") -> DataFrame:
    """Each window with the numbers of legacy texts and of others that have it. Nulls are left out where windows are read: a filter on the text
    would go below a Python step that makes it, which would then run twice."""
    rows = texts.select(F.col(text_col), F.col(legacy_col)).mapInArrow(_counted, "window long, old long, new long")
    return rows.groupBy("window").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))


def fit_detector(texts: DataFrame, text_col: str = "text", legacy_col: str = "legacy", smoothing: float = 0.5, most: int = MOST) -> Detector:
    """A detector from texts that are known to be legacy or not. Windows are counted in Spark, in both chains at once; the driver gets ``most`` of them at most.
    Null texts and unknown encodings (null) don't count."""
    kept = window_counts(texts, text_col, legacy_col).orderBy(F.desc(F.col("old") + F.col("new")), "window").limit(most).toPandas()
    return Detector(kept["window"].to_numpy(np.int64), kept[["old", "new"]].to_numpy(float).T, smoothing)
