r"""Secret scans: fixed patterns, and literals that flow into names which say that they are secret.

``find`` gives the spans of each text in two layers.

*Patterns*, leftmost and non-overlapping for each kind: assign (a telling word, ``:`` or ``=``, six characters or
more), access (``AKIA`` ids of twenty or more), hex (24 hexadecimal digits or more).

*Assignments.* ``pairs`` lexes what source code and configuration have in common: a name (identifier, dotted path,
quoted key, option, subscript with a quoted key, XML element or ``-H`` header), an operator (``=``, ``:``, ``:=``,
``=>``, a type before ``=`` skipped), and a value: string literals (quotes of all kinds, triple ones, prefixes, escapes),
joined by ``+``, ``.``, ``..``, ``||`` or adjacency, names, bare words of configuration lines, and blocks of YAML. Constants
are propagated in text order: a name that is assigned from other names carries their literals, also through ``${NAME}``,
``%NAME%`` and ``{{ NAME }}``, and a literal is judged by the most telling name that it reaches. A literal's score is how
telling the name is (``name_score``) times how random the literal looks (``strength``); LEAST or more makes a span of kind
literal (its own name tells) or flow (a later name tells). A span inside one pattern's span says nothing new and is left out.

Null texts are empty; repeated rows give a row each; positions are code points, ends exclusive. One pass over a text, with
possessive patterns: time grows with its length. Each text is searched whole in its own task; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the patterns of each kind, the group that is measured, and its least length. A run of
#: digits that is too short is not a match at all, which drops the same ones.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24),
}
#: Order of the kinds where spans start at the same place.
KINDS = [*PATTERNS, "literal", "flow"]
#: Least score of a literal.
LEAST = 0.5
#: How telling a word of a name is; two words that stand together are looked up joined.
TELLING = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passwort": 1.0, "contraseña": 1.0, "pwd": 0.9, "pass": 0.7, "pw": 0.7,
    "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.8, "jwt": 0.8, "bearer": 0.8, "authorization": 0.8, "auth": 0.6,
    "credential": 0.9, "credentials": 0.9, "creds": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0,
    "signingkey": 1.0, "encryptionkey": 1.0, "masterkey": 1.0, "authkey": 1.0, "clientsecret": 1.0, "key": 0.4, "salt": 0.6,
    "signature": 0.5, "webhook": 0.6, "dsn": 0.6, "connectionstring": 0.7,
}
#: Words that make a name speak of something about the secret, not of it.
ABOUT = set(
    "length len min max count size type kind name field label hint url uri path file dir regex pattern policy expiry expires "
    "expiration ttl timeout header placeholder column prompt reset public id index endpoint service provider limit algorithm".split()
)
#: Literals that stand for a secret.
PLACEHOLDER = re.compile(
    r"(?i)change_?me|example|placeholder|dummy|sample|default|your[_-]|redacted|todo|fixme|none|null|true|false|undefined|test(?:ing)?\d*$|(.)\1+$|[*x.•_-]+$|<[^>]*>$|\$\{|\{\{|%\(|env(?:iron)?\b|getenv"
)

_ID = r"[^\W\d][\w$]*+"
_NAME = re.compile(
    rf"""(?<![\w$.\-"'`])(?:
      (?P<tag><(?P<element>{_ID}(?:[.:-]\w++)*+)>(?=[^<>\n]++</))
    | (?P<quote>["'`])(?P<key>[^\W\d][\w .$/-]*+)(?P=quote)\x20*+(?P<after_key>=>|:(?!:)|=(?![=~]))
    | (?P<name>(?:--?)?+[$@%]?+{_ID}(?:(?:\.|->|::|-(?=\w))\w++|\[\x20?["'][\w.$-]++["']\x20?\])*+)
      (?:\??:\x20?(?P<type>{_ID}(?:[.<\[|]{_ID}[>\]]?)*+)(?=\x20*+=[^=]))?+\x20*+(?P<op>:=|=>|\|\|=|\?\?=|\?=|\+=|=(?![=~])|:(?![:\w/\\]))
    )""",
    re.X,
)
_STRING = re.compile(
    r"""(?:[rbfuRBFU@$L]{0,2}+)(?:(?P<t>\"{3}|'{3})(?P<triple>(?:(?!(?P=t)|\\)[\s\S]|\\[\s\S])*+)(?P=t)|"(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>(?:[^`\\]|\\.)*+)`)"""
)
_REFERENCE = re.compile(rf"\$\{{\{{?\s?(?:env:|var\.|secrets\.)?({_ID}(?:\.\w++)*+)\s?\}}?\}}|\{{\{{\s?({_ID}(?:\.\w++)*+)\s?\}}\}}|%({_ID})%|\$({_ID})|({_ID}(?:(?:\.|->)\w++)*+)(?![\w(\[])")
_BARE = re.compile(r"(?!#)[^\s,;&'\"`<>(){}\[\]|]++")
_BLANK, _GAP = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"[\s\\(]*+")
_JOIN = re.compile(r"(?:\s|\\\n)*+(?:\+|\.\.|\|\||&|\.(?=\s*+[\"'`$]))(?:\s|\\\n)*+")
_BLOCK = re.compile(r"[|>][+-]?[ \t]*+\r?\n([ \t]++)(\S[^\n]*+)")
_WORD = re.compile(r"[A-Z]++(?![a-z])|[^\W\d_][a-zà-ÿ]*+")


class Literal(NamedTuple):
    start: int
    end: int
    value: str
    quoted: bool


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    name: str | None
    score: float


def matches(text: str) -> list[Found]:
    """The patterns' spans."""
    out = []
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "assign" and ":" not in text and "=" not in text:
            continue
        out += [Found(kind, *m.span(), None, 1.0) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def _value(text: str, at: int, bare: bool) -> tuple[list[Literal | str], int]:
    """The literals and names that the value at ``at`` is made of, and where it ends."""
    parts: list[Literal | str] = []
    if block := _BLOCK.match(text, at):
        return [Literal(*block.span(2), block[2], True)], block.end()
    at = _GAP.match(text, at).end() if not bare else at
    while True:
        if m := _STRING.match(text, at):
            group = m.lastgroup if m.lastgroup != "t" else "triple"
            inside = _REFERENCE.fullmatch(m[group])
            reference = inside and next(filter(None, inside.groups()[:4]), None)
            parts.append(reference or Literal(*m.span(group), m[group], True))
        elif (m := _REFERENCE.match(text, at)) and (not bare or not m[5] or (len(m[5]) > 1 and _ends(text, m.end()))):
            parts.append(next(filter(None, m.groups())))
        elif bare and (m := _BARE.match(text, at)):
            return [*parts, Literal(*m.span(), m[0].rstrip("."), False)], m.end()
        else:
            return parts, at
        at = m.end()
        if join := _JOIN.match(text, at):
            at = join.end()
        else:
            near = _GAP.match(text, at).end()
            if not (isinstance(parts[-1], Literal) and _STRING.match(text, near)):
                return parts, at
            at = near


def _ends(text: str, at: int) -> bool:
    """Whether a name that ends here is all of the value."""
    after = _BLANK.match(text, at).end()
    return after == len(text) or text[after] in "\r\n,;)}]+" or after > at and text.startswith(("#", "//"), after)


def pairs(text: str) -> Iterator[tuple[str, list[Literal | str]]]:
    """(name, value) of each assignment in text order; a value is a list of literals and of names it is made of."""
    at = 0
    while m := _NAME.search(text, at):
        at = m.end()
        if m["tag"]:
            close = text.find("<", at)
            yield m["element"], [Literal(at, close, text[at:close], True)]
            continue
        name = m["key"] or m["name"]
        start = _BLANK.match(text, at).end()
        value, end = _value(text, start, bare=start < len(text) and text[start] not in "\"'`(\n\r")
        if value:
            yield name, value
            at = max(at, end) if isinstance(value[-1], Literal) else at


def name_score(name: str) -> float:
    """How much a name says that its value is a secret, 0 to 1: its most telling word or pair, little if it ends in a word about it."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words:
        return 0.0
    best = max(TELLING.get(w, 0.0) for w in [*words, *map("".join, zip(words, words[1:], strict=False))])
    return best * 0.2 if words[-1] in ABOUT and "".join(words[-2:]) not in TELLING else best


def strength(literal: Literal) -> float:
    """How much a literal looks like a secret, 0 to 1: bits of its characters' entropy, less for words and stand-ins."""
    value = literal.value.strip()
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    bits = sum(-n * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in (r"\d", r"[a-z]", r"[A-Z]", r"[^\w\s]"))
    if " " in value and not literal.quoted or value.count(" ") > 5 or re.match(r"(?:https?|file)://[^@]*+$|/[\w/.-]*+$", value):
        return 0.0
    plain = kinds < 2 or re.fullmatch(r"[^\W\d_]+(?:[ _.-][^\W\d_]+)*", value) is not None
    return min(1.0, bits / 36) * (0.6 if plain and literal.quoted else 0.3 if plain else 1.0)


def assignments(text: str) -> list[Found]:
    """The literals that score LEAST or more, each once, with the name that tells most."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    # one node for each assignment: its name and score, its own literals, and the assignments whose values it takes over
    nodes: list[tuple[str, float, list[Literal], list[int]]] = []
    last: dict[str, int] = {}
    for name, value in pairs(text):
        own, taken = [], []
        for part in value:
            literal = isinstance(part, Literal)
            # a bare word of a configuration line may be a constant's name
            at = None if literal and part.quoted else last.get(part.value if literal else part)
            if at is not None:
                taken.append(at)
            elif literal:
                own.append(part)
        if own or taken:
            last[name.lstrip("-$@%")] = len(nodes)
            nodes.append((name, name_score(name), own, taken))
    reached = [(score, name) for name, score, _, _ in nodes]
    out = []
    for i in range(len(nodes) - 1, -1, -1):  # an assignment takes over earlier ones only
        name, score, own, taken = nodes[i]
        for at in taken:
            reached[at] = max(reached[at], reached[i], key=lambda r: r[0])
        tells, by = reached[i]
        if own and tells >= LEAST:  # the parts of a joined value are judged as one
            total = tells * strength(Literal(own[0].start, own[-1].end, "".join(x.value for x in own), own[0].quoted))
            if total >= LEAST:
                out += [Found("literal" if tells == score else "flow", x.start, x.end, by, total) for x in own]
    return out


def spans(text: str) -> list[Found]:
    """All spans of a text by start, then kind; literals that lie in a pattern's span are left out."""
    base = sorted(matches(text), key=lambda f: f.start)
    reach, far = [], 0
    for f in base:
        far = max(far, f.end)
        reach.append(far)
    out, i = list(base), 0
    for f in sorted(assignments(text), key=lambda f: f.start):
        while i < len(base) and base[i].start <= f.start:
            i += 1
        if not i or reach[i - 1] < f.end:
            out.append(f)
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            found = [[f._asdict() for f in spans(t)] if t else [] for t in batch.column(1).slice(a, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(found, kind)], ["doc_id", "found"])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): each text's spans as array(struct(kind, start, end, name, score)) by start, then kind."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_run, "doc_id long, found array<struct<kind:string,start:long,end:long,name:string,score:double>>")
