import hashlib
import random
import re
import time

import pytest
from gristmill.llm.lz_fingerprint import likeness, likeness_hex, lz_fingerprints, signature
from gristmill.llm.secrets_scan import KINDS, joined, lexed_spans, scan_secrets

TEXTS = [(5, "abab abab cdcd"), (3, None), (9, ""), (1, "é" * 50), (7, "word " * 2000), (8, "word " * 2000), (2, "x"), (None, "no id here"), (4, "ab"), (4, "zz top")]


def lz_rows(rows):
    order = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in rows), key=lambda r: (r[0], r[1]), reverse=True)
    out = []
    for k, (_, t, i) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        a, b, c = signature(t), signature(edited), signature(following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:1], [(k, "same") for k in range(30)], [(1, "twice")] * 2])
def test_lz_against_plain_rows(docs, rows):
    got = lz_fingerprints(docs(rows, extra=True)).collect()
    found = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=str)
    assert found == lz_rows(rows)
    assert all(likeness_hex(r["fingerprint"], r["edited_fingerprint"]) == r["near_edited"] for r in got)


def test_lz_empty_table(docs):
    assert lz_fingerprints(docs([])).count() == 0


def test_lz_phrases_and_likeness():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    text = " ".join(rng.choice(words) for _ in range(600))
    assert likeness(signature(text), signature(text)) == 1.0
    other = " ".join("".join(rng.choice("stuvwxyz") for _ in range(5)) for _ in range(600))
    near = text[: len(text) * 2 // 3] + other[: len(text) // 3]
    assert likeness(signature(text), signature(near)) > 0.3 > 0.1 > likeness(signature(text), signature(other))
    assert likeness(signature(""), signature("")) == 1.0 and likeness(signature(""), signature("a")) == 0.0


PLAIN = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
]


def base(text):
    out = [(m.start(), 0, m.end()) for m in PLAIN[0].finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in PLAIN[1].finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in PLAIN[2].finditer(text) if len(m[0]) >= 16])


def test_base_spans_on_random_text(docs):
    rng = random.Random(2)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "x", "é😀", "\n", "hunter2hunter2", "ſecret", "=="]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(400)] + [(None, None), (7, "")]
    got = scan_secrets(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i, text in rows[:6] + rows[8:400]:
        spans = base(text)
        r = next(x for x in by_id[i] if x["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest())
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        every = [s.split(":") for s in r["spans"].split(",") if s]
        assert {(int(a), KINDS.index(k), int(b)) for k, a, b in every} >= set(spans)
        assert [(int(a), KINDS.index(k)) for k, a, _ in every] == sorted((int(a), KINDS.index(k)) for k, a, _ in every)
    assert scan_secrets(docs([])).count() == 0


@pytest.mark.parametrize(
    "text,found",
    [
        ('db_password = "kX9!fooBar22"', ["literal"]),
        ('k = "Zx81kd92ls0PQ"\nauth_token = k', ["constant"]),
        ('a = "Zx81kd92"\nb = a + "ls0PQ9zz"\nclient_secret: b', ["constant", "constant"]),
        ('{"clientSecret": "abCD1234xyz!!"}', ["literal"]),
        ("export API_KEY=abCD1234xyzQ99", ["literal"]),
        ('password = "changeme"', []),
        ('title = "Zx81kd92ls0PQ"', []),
        ("a = b\nb = a\nsecret = a", []),
        ("time: 12:30, note: all fine", []),
        ("if token == other: pass", []),
    ],
)
def test_lexer(text, found):
    assert [KINDS[k] for _, k, _ in lexed_spans(text)] == found


@pytest.mark.parametrize(
    "text,found",
    [
        ('k = ""; k = "hV9x2LqTz81Rm"; db_pwd = k', [("constant", "hV9x2LqTz81Rm")]),
        ('k = "hV9x2LqTz81Rm"\ndb_pwd = k\nk = "pQ7w3NsVb52Ty"\nauth_token = k', [("constant", "hV9x2LqTz81Rm"), ("constant", "pQ7w3NsVb52Ty")]),
        ('greeting: str = "hello world"\ndb_pwd: str = "hV9x2LqTz81Rm"', [("literal", "hV9x2LqTz81Rm")]),
        ('title: str = "hV9x2LqTz81Rm"\ndef f(db_pwd: str): pass', []),
        ('title: str = "hV9x2LqTz81Rm"\ndb_pwd: str = title', [("constant", "hV9x2LqTz81Rm")]),
        ('db_pwd: dict[str, str] | None = "hV9x2LqTz81Rm"', [("literal", "hV9x2LqTz81Rm")]),
        ('INFO: db_pwd = "hV9x2LqTz81Rm"', [("literal", "hV9x2LqTz81Rm")]),
        ("token: QUJDREVGR0hJSktM= other", [("literal", "QUJDREVGR0hJSktM=")]),
    ],
)
def test_every_definition_counts(text, found):
    assert [(KINDS[k], text[a:b]) for a, k, b in lexed_spans(text)] == found


VALUE = "hV9x2LqTz81Rm"


@pytest.mark.parametrize(
    "text,kinds",
    [
        ('cfg["db_pwd"] = "%s"', ["literal"]), ('db_pwd = ("%s")', ["literal"]), ('db_pwd = f("%s")', ["literal"]), ('db_pwd = (\n   "%s"\n)', ["literal"]),
        ('db_pwd = \\\n  "%s"', ["literal"]), ("db_pwd:\n  %s\nother: x", ["literal"]), ('"db_pwd":\n  "%s",', ["literal"]), ("db_pwd: |\n  %s\n  more words here\nnext: 1", ["literal"]),
        ("<pwd>%s</pwd>", ["literal"]), ('<add key="db_pwd" value="%s"/>', ["literal"]), ('k = "x"; k = "%s"; auth_token = k', ["constant"]), ('auth_pwd = os.getenv("X", "%s")', ["literal"]),
        ('cfg["k"] = "%s"\nauth_token = cfg["k"]', ["constant"]), ('connect(host="h", db_pwd="%s")', ["literal"]), ('{"a": {"db_pwd": "%s"}}', ["literal"]), ('db_pwd => "%s"', ["literal"]),
        ("[db]\npwd = %s ; note", ["literal"]), ('auth = """%s"""', ["literal"]), ('passwords = ["a", "%s"]', ["literal"]), ("a" * 300 + '_pwd = "%s"', ["literal"]),
        ("it's here: don't say db_pwd = '%s' isn't", ["literal"]), ('# db_pwd = "%s"', ["literal"]), ('/* db_pwd = "%s" */', ["literal"]), ('k = "%s" # a key\nauth_token = wrap(k)', ["constant"]),
        ("note = \"db_pwd = '%s'\"", []), ('if db_pwd == "%s": pass', []), ("url: http://db_pwd:80/%s", []), ('title = "%s"', []), ("auth_pwd = os.getenv(name)", []),
    ],
)
def test_lexer_states(text, kinds):
    text = text.replace("%s", VALUE)
    assert [(KINDS[k], text[a:b]) for a, k, b in lexed_spans(text)] == [(k, VALUE) for k in kinds]


def test_planted_literals_and_decoys():
    """Precision and recall over snippets of several syntaxes between prose; base patterns apart."""
    rng = random.Random(4)
    secret = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(16)) + "7x"
    real = ['db_pwd = "{}"', "  pwd: {}", '{{"auth": "{}", "n": 3}}', "export DB_PWD={}", "<credential>{}</credential>", 'conf["login"]["pwd"] = "{}"', 'let passphrase: string = "{}";', 'v = "{}"\nsession_cookie_auth = v']
    decoy = ['title = "{}"', "  colour: {}", '{{"name": "{}"}}', "digest of {}", "<p>{}</p>", 'if pwd != "{}": pass', 'help = "write pwd = \'{}\' here"', "see https://pwd:1/{}", "f({}, pwd)"]
    found = planted = right = 0
    for _ in range(200):
        values, parts = [], []
        for _ in range(5):
            value = secret()
            if rng.random() < 0.5:
                values.append(value)
                parts.append(rng.choice(real).format(value))
            else:
                parts.append(rng.choice(decoy).format(value))
            parts.append(rng.choice(["Some prose, it isn't code.", "", "Note: all is well", "a = b"]))
        text = "\n".join(parts)
        got = [text[a:b] for a, _, b in lexed_spans(text)]
        found, planted, right = found + len(got), planted + len(values), right + len(set(got) & set(values))
    assert right == planted == found


def plain_phrases(text):
    """Lempel-Ziv parse from its definition: the shortest strings not yet seen, and what is left."""
    seen, at = set(), 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end] in seen:
            end += 1
        seen.add(text[at:end])
        at = end
    return seen


def test_likeness_is_near_the_similarity_of_phrase_sets():
    """128 bins: a standard error of 0.044 at most; three of them for each pair, and a mean error near 0."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    errors = []
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(400))
        keep = rng.randint(0, len(text))
        other = text[:keep] + " ".join("".join(rng.choice("stuvwxyz") for _ in range(5)) for _ in range((len(text) - keep) // 6))
        a, b = plain_phrases(text), plain_phrases(other)
        errors.append(likeness(signature(text), signature(other)) - len(a & b) / len(a | b))
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors) / len(errors)) < 0.02


@pytest.mark.parametrize("make", [lambda n: "a = (\n" * n, lambda n: "('k1', k=[\n" * n, lambda n: "a=b=" * n, lambda n: "x = " + "[" * n + "pwd='hunter2horse9X'" + "]" * n, lambda n: "f(a: b, c=g(" * n])
def test_lexing_takes_time_in_proportion_to_the_text(make):
    def took(n):
        text = make(n)
        return min(_timed(lexed_spans, text) for _ in range(2)) / len(text)

    took(2000)
    assert took(32_000) < 4 * took(4_000) + 1e-6  # eight times the text; it was eight times the time for each character


def _timed(f, x):
    began = time.process_time()
    f(x)
    return time.process_time() - began


def test_more_kinds_of_assignment():
    found = lambda t: [t[a:b] for a, _, b in lexed_spans(t)]
    key = "hunter2horse9X"
    for text in (f'user, pwd = "bob", "{key}"', f'cfg.set("db_pwd", "{key}")', f"define('DB_PWD', '{key}')", f'pwd = x if y else "{key}"', f'pwd = ("a", ["{key}"])', f'pwd, user = "{key}", "bob"', f'pwd = f(a, (b, "{key}"))'):
        assert found(text) == [key]
    for text in (f'pwd, user = "bob", "{key}"', f'cfg.set("colour", "{key}")', f'of pwd, user token is "{key}"', f"pwd, user = 2, other('{key}', 1)"):
        assert found(text) == []


def test_a_bracket_read_for_an_inner_assignment_counts_for_the_outer_one():
    text = 'a = f(pwd=("hunter2horse9X"), b=("plainvalue77Q"))\npassword = a'
    assert [(text[a:b], k) for a, k, b in lexed_spans(text)] == [("hunter2horse9X", 3), ("hunter2horse9X", 4), ("plainvalue77Q", 4)]
