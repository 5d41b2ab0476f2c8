"""Language identification: phrases against plain greedy parsing, what predictions may depend on, and held-out accuracy."""

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from gristmill.llm import language, queries
from gristmill.llm.common import chunks
from gristmill.llm.language import PIECE, Tables, _built, _parsed, automaton, identify, language_report, samples_of, symbols_of
from gristmill.session import load
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SAMPLES = {"aa": "the rain in the plain falls mainly there", "bb": "der regen fällt auf das land", "cc": "ab"}


def plain_phrases(text, sample):
    """Phrases of a text by greedy longest matches in the sample, piece by piece."""
    n = 0
    for at in range(0, len(text), PIECE):
        piece, k = text[at : at + PIECE], 0
        while k < len(piece):
            size = 1
            while k + size < len(piece) and piece[k : k + size + 1] in sample:
                size += 1
            n, k = n + 1, k + size
    return n


def tables(samples=SAMPLES):
    alphabet = " " + "".join(sorted(set("".join(samples.values())) - {" "}))
    built = [_built(alphabet, 10_000)(pd.DataFrame([{"lang": k, "sample": v}])).iloc[0].to_dict() for k, v in samples.items()]
    return Tables(alphabet, built)


def test_automaton_has_the_substrings_and_no_others():
    rng = random.Random(3)
    text = "".join(rng.choice("ab c") for _ in range(60))
    steps = automaton(text.encode())
    for _ in range(500):
        word = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 7))).encode()
        at = 0
        for c in word:
            at = steps[at].get(c) if at is not None else None
        assert (at is not None) == (word in text.encode())


def test_phrases_are_those_of_a_plain_parse():
    rng = random.Random(7)
    seen = [" ".join("".join(rng.choice("abdefgilmnrtuü") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (1, 3, 40, 700)]  # hardly a run of words twice
    texts = [*seen, "", "12 . 3", "Ab", "日本 語"]
    t = tables()
    (chunk,) = chunks(pa.array(texts))
    found, size, letters = _parsed(chunk, t)
    for k, text in enumerate(texts):
        (one,) = chunks(pa.array([text]))
        assert [x[0] for x in _parsed(one, t)[0]] == [row[k] for row in found]  # other texts of a chunk don't matter
        if letters[k]:
            assert [int(row[k]) for row in found] == [plain_phrases(text.lower(), s) for s in SAMPLES.values()]
    assert letters.tolist() == [True] * 4 + [False, False, True, True]


def test_long_texts_parse_as_their_pieces():
    rng = random.Random(11)
    text = "".join(rng.choice("abdefgilmnrtu ü") for _ in range(5000)).strip()
    text = " ".join(text.split())
    t = tables()
    alphabet = {c: k for k, c in enumerate(" " + "".join(sorted(set("".join(SAMPLES.values())) - {" "})))}
    codes = np.array([alphabet.get(c, len(alphabet)) for c in text], np.uint8)
    pieces = [codes[k : k + PIECE] for k in range(0, len(codes), PIECE)]
    pieces.sort(key=len, reverse=True)
    grid = np.zeros((len(pieces[0]), len(pieces)), np.uint8)
    for k, p in enumerate(pieces):
        grid[: len(p), k] = p
    found = t.phrases(grid, np.array([len(p) for p in pieces])).sum(axis=1)
    assert found.tolist() == [plain_phrases(text, s) for s in SAMPLES.values()]


def test_repeats_count_once():
    t = tables()
    base = "the rain in spain stays mainly on plains"
    (one,), (many,) = chunks(pa.array([base])), chunks(pa.array([base + " xa ya." * 400]))
    assert _parsed(many, t)[1][0] - _parsed(one, t)[1][0] < 40


def test_samples_leave_out_what_languages_share():
    rows = [("en", 1, "All rights reserved by us. The sheep are in the meadow"), ("de", 1, "All rights reserved by us. Die Schafe sind auf der Wiese"), ("fr", 1, "all rights reserved by us")]
    found = samples_of(rows)
    assert "all rights" not in found["en"] and "meadow" in found["en"] and "schafe" in found["de"] and found["fr"] == "reserved by us"
    assert samples_of([("en", 1, "one two three four"), ("fr", 1, "one two three four")]) == dict.fromkeys(("en", "fr"), "one two three four")  # nothing would be left
    assert symbols_of("Ab, 9 ÇA!") == "ab ça"


def test_held_out_accuracy_and_folds(spark):
    docs = load(spark, SF, "documents")
    rows = queries.queries()["op13_language_id"](spark, SF).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.99


def test_labels_of_held_out_rows_and_other_columns_are_never_read(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumns({"source": F.lit("s"), "least": F.lit(1), "Second": F.lit(2), "h": F.lit(3), "ok": F.lit(False)})
    assert sorted(language_report(docs).collect()) == sorted(language_report(other).collect())


def test_edges(spark, monkeypatch):
    rows = [(k, "the cat sat on the mat and the dog ran to the house " * 2, "en") for k in range(20)] + [(k, "le chat est sur la table et le chien court vers la maison", "fr") for k in range(20, 40)]
    rows += [(50, None, "en"), (51, "", "fr"), (52, "12345 -- !", None), (53, "the dog", None), (None, "la maison", None), (54, "le chien", "fr"), (54, "le chien", "fr"), (55, "the dog ran to the house " * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"] or -1, r["lang_pred"], r["score"]) for r in identify(docs, F.lit(True)).collect()), key=str)
    found = {i: (lang, score) for i, lang, score in got}
    assert len(got) == len(rows)
    assert [found[k] for k in (50, 51, 52)] == [("und", 0.0)] * 3
    assert [found[k][0] for k in (53, -1, 54, 55)] == ["en", "fr", "fr", "en"]
    monkeypatch.setattr(language, "BLOCK", 1)  # two passes
    assert sorted(((r["doc_id"] or -1, r["lang_pred"], r["score"]) for r in identify(docs, F.lit(True)).collect()), key=str) == got
    assert {(r["lang_pred"], r["score"]) for r in identify(docs.where("lang = 'en'"), F.lit(True)).where("doc_id < 20").collect()} == {("en", 1.0)}
    assert {(r["lang_pred"], r["score"]) for r in identify(docs, F.lit(False)).collect()} == {("und", 0.0)}
    assert identify(docs.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        identify(docs, F.lit(True), alphabet_size=255)
