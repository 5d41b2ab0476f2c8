"""Text features as native column expressions, Unicode-aware, without UDFs.

The classes follow code-point properties: white space is the full Unicode set with U+001C to U+001F, letters are category L, and combining
marks are neither letters nor digits, so they count as symbols. Nulls are empty texts unless said otherwise; divisors are guarded (ANSI mode).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.constants import LATIN, SCRIPT_RANGES, SEGMENTED, STOPWORDS

#: Body of the white-space class, and line boundaries; Java and RE2 read both alike.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
EDGE_MARKS = ".,!?;:\"'()"
#: Digits outside category Nd: superscripts, subscripts and enclosed or counting forms of a single digit.
DIGITS = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}"
    r"\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def class_of(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text_of(text), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text_of(text), f"[{SPACE}]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(text), LINE_BREAK), strip), lambda x: x != "")


def _repeated(items: Column) -> Column:
    n = F.size(items)
    return F.when(n > 0, 1 - F.size(F.array_distinct(items)) / n).otherwise(0.0)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: within a lambda an expression would be computed anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _trigrams(w: Column) -> Column:
    shifted = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"), F.slice(w, 3, F.size(w)).alias("c"))
    return F.transform(F.slice(shifted, 1, F.size(w) - 2), lambda t: F.concat_ws(" ", t["a"], t["b"], t["c"]))


def repetition_score(text: Column) -> Column:
    """The larger of the shares of repeated lines and of repeated word trigrams; under six words only lines count."""

    def score(w: Column) -> Column:
        by_line = _let(lines(text), _repeated)
        return F.when(F.size(w) < 6, by_line).otherwise(F.greatest(by_line, _let(_trigrams(w), _repeated)))

    return _let(words(text), score)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text_of(text), r"[^\p{L}]", ""))


def letters_in(text: Column, ranges: Iterable[tuple[int, int]]) -> Column:
    return F.length(F.regexp_replace(text_of(text), rf"[^{class_of(ranges)}]|[^\p{{L}}]", ""))


def by_language(lang: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for code, value in cases.items():
        out = F.when(lang == code, value) if out is None else out.when(lang == code, value)
    return otherwise if out is None else out.otherwise(otherwise)


def target_script_ratio(text: Column, lang: Column) -> Column:
    """Share of letters in the language's script; 0 without letters or for an unknown language."""
    scripts: dict[tuple, list[str]] = {}
    for code, ranges in SCRIPT_RANGES.items():
        scripts.setdefault(ranges, []).append(code)
    inside = F.lit(0)
    for ranges, codes in scripts.items():
        inside = F.when(lang.isin(*codes), letters_in(text, ranges)).otherwise(inside)
    return _share(inside, letters(text))


def _segmented(text: Column, stop: list[str]) -> Column:
    marks = "[" + "".join("\\" + c for c in EDGE_MARKS) + "]"
    hits = lambda w: F.filter(w, lambda x: F.regexp_replace(x, rf"^{marks}+|{marks}+\z", "").isin(*stop))
    return _let(words(F.lower(text_of(text))), lambda w: F.when(F.size(w) > 0, F.size(hits(w)) / F.size(w)).otherwise(0.0))


def _unsegmented(text: Column, stop: list[str]) -> Column:
    t = text_of(text)
    hits = F.lit(0)
    for word in stop:
        hits = hits + (F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / F.lit(len(word))
    return F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), F.length(t) / 20.0))


def stopword_ratio(text: Column, lang: Column) -> Column:
    """Share of function words; for scripts without word spaces their occurrences for each 20 characters, at most 1."""
    return by_language(lang, {c: (_segmented if c in SEGMENTED else _unsegmented)(text, s) for c, s in STOPWORDS.items()}, F.lit(0.0))


def _count_share(text: Column, pattern: str) -> Column:
    return _share(F.regexp_count(text_of(text), F.lit(pattern)), F.length(text_of(text)))


def symbol_ratio(text: Column) -> Column:
    return _count_share(text, rf"[^\p{{L}}\p{{N}}{SPACE}]")


def numeric_ratio(text: Column) -> Column:
    return _count_share(text, f"[{DIGITS}]")


def is_latin(text: Column) -> Column:
    """1 if at least half of the letters are Latin, else 0."""
    return F.when(letters(text) > 0, (letters_in(text, LATIN) * 2 >= letters(text)).cast("int")).otherwise(0)


def cheap_features(text: Column, lang: Column) -> dict[str, Column]:
    """The six features of a candidate, by name."""
    return {
        "repetition_score": repetition_score(text), "target_script_ratio": target_script_ratio(text, lang), "stopword_ratio": stopword_ratio(text, lang),
        "symbol_ratio": symbol_ratio(text), "numeric_ratio": numeric_ratio(text), "is_latin": is_latin(text),
    }


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, with the empty strings at the ends."""
    return F.split(F.lower(text_of(text)), "[^a-zA-Z0-9]+")


def has_banned_word(text: Column, banned: Iterable[str]) -> Column:
    own = [w for w in banned if w]
    return F.arrays_overlap(tokens(text), F.array(*map(F.lit, own))) if own else F.lit(False)


def clean_id(raw: Column) -> Column:
    """Without angle brackets at the ends and a leading ``urn:uuid:``."""
    return F.regexp_replace(F.btrim(raw, F.lit("<>")), "^urn:uuid:", "")
