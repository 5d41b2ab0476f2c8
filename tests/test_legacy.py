"""The legacy Burmese encoding: known words, round trips of generated syllables, and a fitted detector."""

import random
import unicodedata

import pytest
from gristmill.functions import legacy
from gristmill.functions.normalize import converted_share, repair

#: (Unicode, legacy): greeting, language name, school, "is", a stack, a kinzi and the great sa.
WORDS = [
    ("မင်္ဂလာပါ", "မဂၤလာပါ"), ("မြန်မာ", "ျမန္မာ"), ("ကျောင်း", "ေက်ာင္း"), ("ဖြစ်သည်", "ျဖစ္သည္"), ("ဗုဒ္ဓ", "ဗုဒၶ"), ("သတ္တမ", "သတၱမ"), ("ကြွေ", "ေျကြ"), ("ပြည်သူ", "ျပည္သူ"), ("ရှိ", "ရွိ"),
]


@pytest.mark.parametrize(("new", "old"), WORDS)
def test_known_words(new, old):
    assert legacy.to_unicode(old) == new and legacy.to_legacy(new) == old


def syllables(rng, n):
    """Text in canonical order: kinzi, consonant, stack, medials, e, vowels, asat of a final, tone."""
    stacked = [chr(c) for c in legacy.STACKED]
    out = []
    for _ in range(n):
        one = rng.choice(stacked)
        if rng.random() < 0.1:
            one = legacy.KINZI_UNICODE + one
        elif rng.random() < 0.15:
            one += "္" + rng.choice(stacked)
        one += "".join(m for m in "ျြွှ" if rng.random() < 0.15)
        one += rng.choice(["", "", "ေ"]) + rng.choice(["", "ာ", "ိ", "ု", "ူ", "ံ"])
        if rng.random() < 0.3:
            one += rng.choice("ကငစတနပမယ") + "်"
        out.append(one + rng.choice(["", "", "း", "့", " ", "၊ "]))
    return "".join(out)


def test_generated_text_comes_back():
    rng = random.Random(1)
    for n in (0, 1, 5, 200, 5000):
        text = syllables(rng, n)
        assert legacy.to_unicode(legacy.to_legacy(text)) == text
    assert legacy.to_unicode("no Burmese, ünïcode 123\n") == legacy.to_legacy("no Burmese, ünïcode 123\n") == "no Burmese, ünïcode 123\n"


def test_detector_finds_legacy_text_it_has_not_seen(spark):
    rng = random.Random(2)
    make = lambda n, size: [(k, t := syllables(rng, rng.randint(4, size)), k % 2 == 1) for k in range(n)]
    frame = lambda rows: spark.createDataFrame([(k, legacy.to_legacy(t) if old else t, unicodedata.normalize("NFC", t), old) for k, t, old in rows] + [(-1, None, None, True), (-2, "plain", "plain", None)], "id long, text string, right string, legacy boolean")
    detector = legacy.fit_detector(frame(make(200, 40)))
    fixed = repair(frame(make(300, 30)), "text", detector, legacy.to_unicode).where("id >= 0")
    wrong = fixed.where("converted <> legacy").count()
    assert wrong <= 3 and fixed.where("text <> right").count() <= wrong
    assert abs(converted_share(fixed).first()["share"] - 0.5) < 0.02
    assert detector("plain text") == 0.0 and detector("") == 0.0
    assert detector(WORDS[0][1] * 3) > 0.9 > 0.1 > detector(WORDS[0][0] * 3)


def test_repeated_words_and_words_that_differ_late(spark):
    """A word of weak evidence counts once however often it comes, and "ser" is told from "sre" by what stands around it."""
    words = ["တဟေရ", "နေမ", "လိုသေရ", "နသရေတ", "ကသ"]
    texts = [" ".join(words[(k + i * i) % 5] for i in range(4 + k % 3)) for k in range(60)]
    rows = [(legacy.to_legacy(t) if old else t, old) for t in texts for old in (True, False)]
    detector = legacy.fit_detector(spark.createDataFrame(rows, "text string, legacy boolean"))
    text = "တဟ " * 300 + "နေမ တဟေရ လိုသေရ"
    assert detector(legacy.to_legacy(text)) > 0.5 > detector(text)
    for word in words[2:4]:
        assert detector(legacy.to_legacy(word)) > 0.9 > 0.1 > detector(word)
    assert len(legacy.fit_detector(spark.createDataFrame(rows, "text string, legacy boolean"), most=7).tables[-1][0][0]) == 7


def test_no_text_to_learn_from(spark):
    nothing = legacy.fit_detector(spark.createDataFrame([(None, True), ("abc", False)], "text string, legacy boolean"))
    assert nothing(WORDS[0][0]) == pytest.approx(0.5)


def test_syllables_converted_as_matches_equal_whole_syllables():
    """Any string of the block, also one that is no text, becomes what the plain rule gives: each syllable in turn, changed or not."""
    rng = random.Random(3)

    def plain_unicode(text):
        moved = lambda m: (legacy.KINZI_UNICODE if m[4] else "") + m[3] + m[5] + "".join(sorted(m[2] + m[6])) + m[1]
        return legacy._LEGACY_SYLLABLE.sub(moved, text.translate(legacy._TO_UNICODE))

    def plain_legacy(text):
        out, at = [], 0
        for m in legacy._SYLLABLE.finditer(text):
            out += [text[at : m.start()].replace(legacy.ASAT, "္"), legacy._syllable_to_legacy.__wrapped__(m[0])]
            at = m.end()
        return "".join([*out, text[at:].replace(legacy.ASAT, "္")])

    for _ in range(20_000):
        text = "".join(rng.choice("ေြ်ျွှ္ငကဿသၤ ႆ၁") if rng.random() < 0.75 else chr(rng.randint(legacy.FIRST, legacy.LAST)) for _ in range(rng.randint(0, 14)))
        assert legacy.to_unicode(text) == plain_unicode(text) and legacy.to_legacy(text) == plain_legacy(text)


def test_work_is_for_different_syllables_and_windows_only(spark, monkeypatch):
    """A long text costs a conversion for each different syllable, and the detector works out windows that it has not learned only."""
    text = syllables(random.Random(4), 300) + "ကောင်း ကျေ " * 20_000
    legacy._syllable_to_legacy.cache_clear(), legacy._syllable_to_unicode.cache_clear()
    assert legacy.to_unicode(legacy.to_legacy(text)) == text
    assert max(legacy._syllable_to_legacy.cache_info().misses, legacy._syllable_to_unicode.cache_info().misses) < 1000
    detector, done = legacy.fit_detector(spark.createDataFrame([(legacy.to_legacy(text), True), (text, False)], "text string, legacy boolean")), []
    monkeypatch.setattr(legacy.Detector, "_weighed", lambda self, windows: done.append(len(windows)) or 0 * windows.astype(float))
    assert detector(text) < 0.5 < detector(legacy.to_legacy(text)) and sum(done) == 0
    assert detector("ဿဿ") == 0.5 and sum(done) > 0


def test_texts_are_made_once(spark):
    """Windows are counted over one Python step that makes the texts; a filter on them had made it two."""
    from compare import SF
    from gristmill.plans.storage_queries import _burmese

    counts = legacy.window_counts(_burmese(spark, SF).where("doc_id % 4 < 2"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    from compare import SF
    from gristmill.plans import storage_queries as Q

    fit, sizes = Q.fit_detector, []
    monkeypatch.setattr(Q, "fit_detector", lambda rows: sizes.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or fit(rows))
    plan = Q.legacy_repair(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sizes == ["8m"] and "Python" not in plan
