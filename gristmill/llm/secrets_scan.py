"""Secret scan: base patterns, and an assignment-aware lexer that scores literals by the names they reach.

Spans are ``kind:start:end`` in code points, end exclusive. Base kinds, each leftmost and non-overlapping:

* ``assign``: a credential word, ``:`` or ``=``, and a value of 12 or more characters (the span is the whole match);
* ``access``: an access key id; ``hex``: 16 or more lower-case hexadecimal digits.

The lexer adds, without taking any base span away:

* ``literal``: a literal given directly to a sensitive name;
* ``constant``: a literal that reaches a sensitive name by constants (``k = "..."; auth_token = k``, also ``"a" + k``, ``f(k)`` and ``${k}``).

It reads tokens from left to right, with states for comments, strings (also of several lines), brackets and statements, from each line
that has an operator, and parses targets and expressions:

* targets are names (of any length, dotted), subscripts (``cfg["db_pwd"]`` is ``cfg.db_pwd``), quoted keys, and typed names (``name: type = ...``);
* expressions go on in brackets, after a backslash or a joining operator, and on the next line where a key has nothing else on its own. Their
  literals and names count: of calls the arguments but not the function, of lists the elements, of subscripts the name that they make; the
  pairs of a dictionary stand for themselves; several names take values by place, and a call that sets a name to a value (``cfg.set("k", "v")``) is a pair;
* configuration: YAML scalars, also blocks (``|`` and ``>``) by line, INI and environment lines, JSON, XML elements and the pairs of their
  attributes (also ``key="..." value="..."``).

An assignment within a string is text and none of the lexer's; one within a comment is read as a scope of its own, since what is commented out
is as secret. A name stands for all its definitions in its scope, wherever they are, so no binding hides another.

A null or empty text has no spans, an empty table no rows. Rows repeat as they come in; the result has one row for each row of the input, in no
order. Spans that tie in their start are in order of their kinds. Texts are read whole, however long, each bracket once. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import id_and_text, table

KINDS = ("assign", "access", "hex", "literal", "constant")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")  # greedy runs of 18 characters or more
HEX = re.compile("[0-9a-f]{16,}")

# Weights of the words of a target's name, and of pairs of neighbouring words.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "bearer": 0.8, "jwt": 0.8, "privatekey": 1.0, "accesskey": 0.9, "secretkey": 1.0, "signature": 0.5, "cookie": 0.5, "pass": 0.7, "pin": 0.4,
}
NAME_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 0.9, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("pass", "word"): 1.0, ("account", "key"): 0.8}
#: Literals that stand for a secret rather than being one.
PLACEHOLDER = re.compile(r"(?i)^(?:change[-_]?me|example|placeholder|your[-_].*|my[-_].*|todo|none|null|true|false|undefined|dummy|sample|x{4,}|\*+|<.*>|\$\{.*\}|%\(?.*\)?s?)$")

NAME = r"[A-Za-z_$][\w$]*(?:(?:\.|::|->|-)[A-Za-z_$][\w$]*)*"
#: One token; the first alternative that fits. Strings of one line end in it, so that an apostrophe of prose opens none.
TOKEN = re.compile(
    r"""(?P<gap>[^\S\n]+|\\\r?\n)"""
    r"""|(?P<comment>(?:(?<![^\s;{}(,])\#|(?<![:\w"'])//|(?<=\n);)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z))"""
    r"""|(?P<str>(?<![\w])[fFrRbBuU]{0,2}(?:\"""[\s\S]*?\"""|\'\'\'[\s\S]*?\'\'\')|(?:(?<![\w])[fFrRbBuU]{1,2}(?=["']))?(?:"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'|(?<=[rRbBfFuU])'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`))"""
    r"""|(?P<url>[A-Za-z][A-Za-z0-9+.\-]*://[^\s"'`<>]*)"""
    rf"""|(?P<ref>\$\{{{NAME}\}})|(?P<name>{NAME})"""
    r"""|(?P<assign>:=|=>|\?\?=|\|\|=|\+=|\?=|(?<![=!<>~])=(?![=~>])|:(?![:/=]))"""
    r"""|(?P<join>\+(?![+=])|\.\.|\|\||\?\?|%(?=\s*[("'\w]))|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comma>,)|(?P<end>;|\n)|(?P<other>[\s\S])"""
)
#: What a name in a string of a template stands for.
INNER = re.compile(rf"\$\{{({NAME})\}}|\$([A-Za-z_]\w*)|(?<!\{{)\{{({NAME})\}}")
OPERATOR = re.compile(r"(?<![=!<>~])=(?![=~])|:(?![:/])")
BARE = re.compile(r"""[^\s"'`,;#&<>(){}\[\]|]+""")
#: What may stand between ``name:`` and ``=``: words with parameters in brackets, and unions of them.
TYPE = r"[&*]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\n=]*?\]|<[^\n=]*?>)?\??"
TYPED = re.compile(rf"[ \t]*({TYPE}(?:[ \t]*\|[ \t]*{TYPE})*)[ \t]*=(?![=~>])[ \t]*")
BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[ \t]*(?:#[^\n]*)?\n")
#: A setting that a call makes: its name and its value as strings.
SETTING = re.compile(r"""\b(?:set|put|define|setenv|putenv|set_?[pP]roperty|set_?[eE]nv|setdefault)\(\s*(["'])([\w.:-]+)\1\s*,\s*(["'])([^"'\n]+)\3""")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>")
KEYED = re.compile(r"""<[^<>]*?\b(?:key|name|id)\s*=\s*["']([^"'<>]+)["'][^<>]*?\bvalue\s*=\s*["']([^"'<>]+)["']""", re.I)
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Built-in types: as a value of ``name: type`` they are no constants.
BUILT_IN = frozenset("str string String bytes int float bool boolean number char any Any object Object None null undefined Text AnyStr Final".split())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    words = [w.lower() for w in CAMEL.findall(name)]
    joined = "".join(words)
    best = max([0.0, *(NAME_WORDS.get(w, NAME_WORDS.get(w.removesuffix("s"), 0.0)) for w in words), *(NAME_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])
    return max(best, NAME_WORDS.get(joined, 0.0))


def literal_strength(value: str) -> float:
    """0 to 1: how much a literal looks like a secret, by length, entropy and character classes."""
    if len(value) < 8 or PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    return min(1.0, entropy / 3.5) * (0.55 + 0.15 * classes)


#: ("literal", "bare" or "name", value (None: the text there), start, end).
Term = tuple[str, str | None, int, int]
#: Terms, and what brackets hold as groups of their own.
Group = list
#: Words after which an expression goes on, and those of them that may stand where it could have ended.
WANTING = frozenset("or and await new return lambda not if else".split())
JOINING = frozenset("or and if else".split())
#: Names that one assignment may give values to, by place.
LISTED = 64


def _literal(text: str, start: int, end: int) -> list[Term]:
    """The terms of a string token: its contents, and the names that a template holds."""
    while text[start] not in "\"'`":
        start += 1
    quote = 3 if text[start : start + 3] in ('"""', "\'\'\'") and end - start >= 6 else 1
    a, b = start + quote, end - quote
    out: list[Term] = [("literal", text[a:b], a, b)]
    if "{" in text[a:b] or "$" in text[a:b]:
        out += [("name", m[1] or m[2] or m[3], a + m.start(), a + m.end()) for m in INNER.finditer(text[a:b])]
    return out


def _subscript(text: str, at: int, stop: int) -> tuple[str, int] | None:
    """The key of ``["..."]`` that begins at ``at``, and where it ends."""
    m = TOKEN.match(text, at + 1, stop)
    if m and m.lastgroup == "str" and text[m.end() : m.end() + 1] == "]":
        return _literal(text, m.start(), m.end())[0][1], m.end() + 1
    return None


def _brackets(text: str, start: int, stop: int, groups: dict[int, tuple[Group, int, bool]]) -> tuple[Group, int, bool]:
    """What the bracket at ``start`` holds, where it ends, and whether a dictionary cut it off. Brackets in it are read on the way and noted in ``groups``, so that
    none is read twice, however deep it lies and however many assignments begin around it."""
    if start in groups:
        return groups[start]
    open_: list[tuple[int, Group]] = [(start, [])]
    at, cut = start + 1, False
    while open_ and not cut and at < stop and (m := TOKEN.match(text, at, stop)):
        kind, begin, at = m.lastgroup, m.start(), m.end()
        terms = open_[-1][1]
        if kind == "str":
            terms += _literal(text, begin, at)
        elif kind == "ref":
            terms.append(("name", m[0][2:-1], begin, at))
        elif kind == "name":
            if text[at : at + 1] != "(" and m[0] not in WANTING:
                name, at = _subscripted(text, m[0].lstrip("$"), at, stop)
                terms.append(("name", name, begin, at))
        elif kind == "open":
            if m[0] == "{":
                at, cut = begin, True
            elif begin in groups:
                inner, at, cut = groups[begin]
                terms.append(inner)
            else:
                open_.append((begin, []))
                terms.append(open_[-1][1])
        elif kind == "close":
            begin, terms = open_.pop()
            groups[begin] = (terms, at, False)
        elif kind == "assign" and terms and isinstance(terms[-1], tuple) and terms[-1][0] != "literal":
            terms.pop()  # a named argument
    for begin, terms in open_:
        groups[begin] = (terms, at, cut)
    return groups[start]


def _subscripted(text: str, name: str, at: int, stop: int) -> tuple[str, int]:
    while text[at : at + 1] == "[" and (key := _subscript(text, at, stop)):
        name, at = f"{name}.{key[0]}", key[1]
    return name, at


def _value(text: str, at: int, stop: int, assigned: bool, groups: dict[int, tuple[Group, int, bool]]) -> tuple[Group, int]:
    """The terms of the expression that begins at ``at``, and where it ends; those of a bracket are one group. ``assigned``: by an equals sign, not by a colon."""
    terms: Group = []
    wants, lines, first = True, 0, True
    while at < stop and (m := TOKEN.match(text, at, stop)):
        kind, at = m.lastgroup, m.end()
        if kind in ("gap", "comment"):
            continue
        if first and kind not in ("str", "open", "end", "ref") and (end := _bare_end(text, m.start(), stop, groups)) > m.start() and text[end : end + 1] not in ("(", "[") and not (kind == "name" and end == m.end()):
            terms.append(("literal", None, m.start(), end))  # an unquoted value, which may hold others: it is cut out where it matters
            at, first, wants = end, False, False
            continue
        if kind == "end":
            if m[0] == ";" or not wants:
                return terms, m.start()
            lines += 1
            if lines > 1:
                return terms, m.start()
            if first:  # the value may be alone on the next line
                after = text[at : end if (end := text.find("\n", at, stop)) >= 0 else stop].strip()
                if not (after[:1] in "\"'`([" and after or not assigned and BARE.fullmatch(after) and not after.endswith(":")):
                    return terms, m.start()
            continue
        if kind == "str":
            terms += _literal(text, m.start(), m.end())
            wants = False
        elif kind == "ref":
            terms.append(("name", m[0][2:-1], m.start(), at))
            wants = False
        elif kind == "name":
            if not wants and m[0] not in JOINING:
                return terms, m.start()
            wants = m[0] in WANTING
            if text[at : at + 1] == "(" or wants:
                first = False
                continue  # a call: only its arguments count
            name, at = _subscripted(text, m[0].lstrip("$"), at, stop)
            terms.append(("name" if at > m.end() or not first or text[at : at + 1] in ("+", ".") else "bare", name, m.start(), at))
        elif kind == "open":
            if m[0] == "{":  # the pairs in it stand for themselves
                return terms, m.start()
            group, at, cut = _brackets(text, m.start(), stop, groups)
            if group:
                terms.append(group)
            if cut:
                return terms, at
            wants = False
        elif kind == "join":
            wants = True
        else:
            return terms, m.start()
        first = False
    return terms, at


def _bare_end(text: str, at: int, stop: int, groups: dict) -> int:
    """Where the unquoted value that begins at ``at`` ends. One that lies in another ends with it, and isn't looked through again."""
    begin, end = groups.get(-1, (0, 0))
    if not begin <= at < end:
        m = BARE.match(text, at, stop)
        begin, end = groups[-1] = (at, m.end() if m else at)
    return end


def _pairs(text: str, begin: int, stop: int, comments: list[tuple[int, int]]) -> list[tuple[str, Group, bool]]:
    """(name, terms, whether the name is a built-in type) of the assignments in [begin, stop); comments with an operator are noted."""
    out, types, read = [], set(), begin
    groups: dict = {}
    for found in OPERATOR.finditer(text, begin, stop):
        if found.start() < read:
            continue
        at = max(read, text.rfind("\n", begin, found.start()) + 1)
        end = text.find("\n", found.start(), stop)
        end = stop if end < 0 else end + 1
        last: tuple[str, int] | None = None  # the name or key that an operator may follow, and where it begins
        listed: list[tuple[str, int]] = []  # names with commas before it
        opened: list[tuple[str, int] | None] = []
        while at < end and (m := TOKEN.match(text, at, stop)):
            kind, at = m.lastgroup, m.end()
            if kind in ("gap", "url"):
                continue
            if kind == "comment":
                if OPERATOR.search(m[0]):
                    comments.append((m.start(), m.end()))
            elif kind == "name":
                listed = [] if last else listed  # two names without a comma are no list
                last = (m[0].lstrip("$"), m.start())
            elif kind == "str":
                a, b = _literal(text, m.start(), m.end())[0][2:]
                last, listed = (text[a:b], m.start()), []
            elif kind == "open":
                opened.append(last)
                last, listed = None, []
            elif kind == "close":
                base = opened.pop() if opened else None
                last = (f"{base[0]}.{last[0]}" if last else base[0], base[1]) if m[0] == "]" and base else last if m[0] == "]" else None
            elif kind == "comma":
                listed = [*listed, last] if last and not opened and len(listed) < LISTED else []
                last = None
            elif kind == "assign":
                if last and listed and m[0] == "=":
                    names, values, to = [*listed, last], [], at
                    while len(values) < len(names):
                        given, to = _value(text, to, stop, True, groups)
                        values.append(given)
                        if text[to : to + 1] != ",":
                            break
                        to += 1
                    if len(values) < len(names):  # prose, or one value for all; the last name has the first value
                        names, values = names[-1:], values[:1]
                    out += [(name, given, False) for (name, _), given in zip(names, values, strict=True)]
                elif last:
                    assigned = m[0] != ":"
                    given, typed = None, None
                    if not assigned and (block := BLOCK.match(text, at, stop)):
                        given, at = _block(text, last[1], block.end(), stop)
                    elif not assigned and (typed := TYPED.match(text, at, stop)):
                        given, _ = _value(text, typed.end(), stop, True, groups)
                        if given:
                            types.add(typed.start(1))
                    if given is None or typed and not given:
                        given, _ = _value(text, at, stop, assigned, groups)
                    elif typed:
                        given = given + [t for t in _value(text, at, stop, False, groups)[0] if t[0] == "literal"]
                    if given:
                        out.append((last[0], given, last[1] in types and last[0].rpartition(".")[2] in BUILT_IN))
                last, listed = None, []
            else:
                last, listed = None, []
        read = max(read, at)
    return out


def _block(text: str, key: int, at: int, stop: int) -> tuple[list[Term], int]:
    """The lines of a YAML block, which are deeper than its key, as literals."""
    depth = key - (text.rfind("\n", 0, key) + 1)
    terms: list[Term] = []
    while at < stop:
        end = text.find("\n", at, stop)
        end = stop if end < 0 else end
        line = text[at:end]
        if line.strip():
            start = at + len(line) - len(line.lstrip())
            if start - at <= depth:
                break
            terms.append(("literal", line.strip(), start, start + len(line.strip())))
        at = min(end + 1, stop)
    return terms, at


def _resolve(pairs: list[tuple[str, Group, bool]], text: str, threshold: float) -> set[tuple[int, int, int]]:
    """(start, kind, end) of the literals that sensitive names get, directly or by constants."""
    constants: dict[str, Group] = {}
    for name, terms, is_type in pairs:
        if not is_type:
            constants.setdefault(name, []).extend(terms)
    targets: dict[float, list] = {}
    for name, terms, _ in pairs:
        if weight := name_weight(name):
            targets.setdefault(weight, []).extend((t, 3, name) for t in terms)
    out = set()
    for weight, todo in targets.items():  # names of one weight go together, so each definition is followed once for them
        seen: set = set()
        while todo:
            term, kind, name = todo.pop()
            if isinstance(term, list):  # a group counts once for names of one weight, directly and by constants
                if (id(term), kind) not in seen:
                    seen.add((id(term), kind))
                    todo += [(t, kind, name) for t in term]
                continue
            what, value, start, end = term
            if what == "literal":
                if weight * literal_strength(text[start:end] if value is None else value) >= threshold:
                    out.add((start, kind, end))
            elif value in constants and value not in seen and value != name:
                seen.add(value)
                todo += [(t, 4, value) for t in constants[value]]
            elif what == "bare" and kind == 3 and value not in constants and any(c.isdigit() for c in value) and weight * literal_strength(value) >= threshold:
                out.add((start, 3, end))  # a bare word of a configuration file
    return out


def lexed_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the literals that sensitive names get, in order."""
    if "=" not in text and ":" not in text and "</" not in text and not SETTING.search(text):
        return []
    comments: list[tuple[int, int]] = []
    pairs = _pairs(text, 0, len(text), comments)
    pairs += [(m[2], [("literal", m[4], m.start(4), m.end(4))], False) for m in SETTING.finditer(text)]
    if "</" in text or "/>" in text:
        for m in (m for p in (ELEMENT, KEYED) for m in p.finditer(text)):
            if value := m[2].strip():
                start = m.start(2) + m[2].index(value)
                pairs.append((m[1], [("literal", value, start, start + len(value))], False))
    out = _resolve(pairs, text, threshold)
    for a, b in comments:
        mark = len(text[a:b]) - len(text[a:b].lstrip("#/;*<!- \t"))
        out |= _resolve(_pairs(text, a + mark, b, []), text, threshold)
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in SCHEMA]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            base = base_spans(text)
            spans = sorted(base + lexed_spans(text))
            count = Counter(k for _, k, _ in spans)
            for row, x in zip(rows, (doc_id, *(count[k] for k in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                row.append(x)
        yield table(SCHEMA, *rows)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts by kind, the digest of its base spans, and all spans. No shuffle."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, n_constant long, base_sha256 string, spans string")
