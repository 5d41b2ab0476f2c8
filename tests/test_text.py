"""Text features against a plain version of their definitions, on random Unicode and special rows."""

import random
import re
import sys
import unicodedata
from collections import Counter

import pytest
from gristmill.constants import LATIN, SCRIPT_RANGES, SEGMENTED, STOPWORDS
from gristmill.functions import kernel
from gristmill.functions import text as T
from gristmill.operators import corpus
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ALPHABET = list("aAbz059 .,!'()-\n\r\t\x1c\x85\xa0 　²½éÅß") + list("ไทยกำ็ခမြန်ខ្មែລາວ") + ["\u2009", "😀", "ệ", "đ", "_"]
SPECIAL = ["", " ", "\n", "12 345", "a b c", "a b c d e f", "a b c a b c a b c", "x\r\nx\ny", "a\x85a\u2028a\x1ca", "the of", "và của là", "và, (của) LÀ x", "และที่ใน" * 10, "ng mga ang", "²³", "---", "\u3000a\xa0"]


def rows():
    rng = random.Random(7)
    out = list(SPECIAL)
    out += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += [" ".join(rng.choice(["và", "yang", "the", "ang", "x.", "(dan)", "tidak!"]) for _ in range(rng.randint(0, 12))) for _ in range(100)]
    langs = [*SCRIPT_RANGES, "xx"]
    return [(k, t, langs[k % len(langs)]) for k, t in enumerate(out)]


def kinds(t):
    return Counter(unicodedata.category(c)[0] for c in t)


def ratio(part, whole):
    return part / whole if whole else 0.0


def in_ranges(t, ranges):
    return sum(1 for c in t if unicodedata.category(c)[0] == "L" and any(c in map(chr, range(a, b + 1)) for a, b in ranges))


def repeats(items):
    seen = Counter(items)
    return ratio(sum(seen.values()) - len(seen), sum(seen.values()))


def plain_features(t, lang):
    """From the definitions of SURVEY: categories of code points, counters of lines and of trigrams."""
    tokens = re.split(f"[{SPACES}]+", t.strip(SPACES)) if t.strip(SPACES) else []
    rows = [r.strip(SPACES) for r in re.split("[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]", t)]
    score = repeats(r for r in rows if r)
    if len(tokens) > 5:
        score = max(score, repeats(zip(tokens, tokens[1:], tokens[2:])))
    n = kinds(t)
    low = re.split(f"[{SPACES}]+", t.lower().strip(SPACES)) if t.strip(SPACES) else []
    if lang in SEGMENTED:
        stops = ratio(sum(1 for x in low if re.sub(r"""^[.,!?;:"'()]+|[.,!?;:"'()]+\Z""", "", x) in STOPWORDS[lang]), len(low))
    else:
        stops = min(1.0, sum((len(t) - len(t.replace(x, ""))) / len(x) for x in STOPWORDS.get(lang, ())) * 20 / max(20, len(t)))
    spaces = sum(c in SPACES for c in t)
    signs = len(t) - n["L"] - n["N"] - spaces
    digits = sum(unicodedata.digit(c, None) is not None for c in t)
    script = ratio(in_ranges(t, SCRIPT_RANGES.get(lang, ())), n["L"])
    return score, script, stops, ratio(signs, len(t)), ratio(digits, len(t)), int(n["L"] > 0 and in_ranges(t, LATIN) >= n["L"] / 2)


NAMES = ("repetition_score", "target_script_ratio", "stopword_ratio", "symbol_ratio", "numeric_ratio", "is_latin")


@pytest.mark.parametrize("way", ["expressions", "one pass"])
def test_features(spark, way):
    data = rows()
    df = spark.createDataFrame(data, "k int, text string, lang string").withColumn("stripped", T.strip(F.col("text"))).withColumn("n_tokens", F.size(T.tokens(F.col("text"))))
    df = df.withColumns(T.cheap_features(F.col("text"), F.col("lang"))) if way == "expressions" else corpus.with_features(df.withColumn("is_latin", F.lit(7)), "text", "lang")
    got = {r["k"]: r for r in df.collect()}
    for k, t, lang in data:
        assert tuple(got[k][c] for c in NAMES) == pytest.approx(plain_features(t, lang), abs=1e-12), (t, lang)
        assert got[k]["stripped"] == t.strip(SPACES) and got[k]["n_tokens"] == len(re.split("[^a-zA-Z0-9]+", t.lower()))


def test_parts_of_a_batch(monkeypatch):
    import pyarrow as pa

    data = rows()
    texts, langs = pa.array([t for _, t, _ in data]), pa.array([lang for *_, lang in data])
    whole = kernel.features(texts, langs)
    monkeypatch.setattr(kernel, "PART", 50)
    assert kernel.features(texts, langs) == whole and len(kernel.features(texts[:0], langs[:0])) == 0


def test_nulls(spark):
    df = spark.createDataFrame([(None, "vi")], "text string, lang string")
    r = df.select(*(c.alias(n) for n, c in T.cheap_features(F.col("text"), F.col("lang")).items()), T.has_banned_word(F.col("text"), ["x"]).alias("b")).first()
    assert list(r) == [0.0, 0.0, 0.0, 0.0, 0.0, 0, False]
    assert list(corpus.with_features(spark.createDataFrame([(None, None), ("", "vi")], "text string, lang string"), "text", "lang").select(*NAMES).first()) == [0.0, 0.0, 0.0, 0.0, 0.0, 0]


def test_digit_class_is_complete():
    pattern = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), T.DIGITS.replace(r"\p{Nd}", r"\d")) + "]")
    wrong = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and bool(pattern.match(chr(c))) != chr(c).isdigit()]
    assert not wrong


def test_banned_words(spark):
    texts = ["a bad, word", "badly", "BAD!", "", "ba d"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert [r[0] for r in df.orderBy("k").select(T.has_banned_word(F.col("text"), ["bad"])).collect()] == [True, False, True, False, False]
    assert df.where(T.has_banned_word(F.col("text"), [])).count() == 0


def test_clean_id(spark):
    df = spark.createDataFrame([("<urn:uuid:1-2>",), ("urn:uuid:x",), ("<a>",), ("plain",)], "i string")
    assert [r[0] for r in df.select(T.clean_id(F.col("i"))).collect()] == ["1-2", "x", "a", "plain"]


def test_a_filter_on_features_computes_them_once(spark):
    """Below the features the filter would compute them again, in a second Python process for each task."""
    from gristmill.operators.selection import is_clean

    docs = spark.createDataFrame([(1, "some plain words here", "en", 0.95), (2, "a a a a a a a a", "en", 0.95)], "doc_id long, text string, language string, language_score double")
    clean = kernel.with_features(docs, "text", "language").where(is_clean()).select("doc_id")
    assert clean._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["doc_id"] for r in clean.collect()] == [1]
    assert kernel.PART <= 1 << 18  # some 200 bytes for each code point
