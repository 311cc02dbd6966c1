"""Secrets in texts: fixed patterns, and literals that reach sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "flow")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run has no longer one within
_HEX = re.compile(r"[0-9a-f]{16,}")

# Lexemes of configuration and source lines: strings, names, operators that assign or join.
_LEXEME = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<name>--?[A-Za-z][\w-]*|[A-Za-z_$@][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*)"""
    r"""|(?P<set>:=|=>|==|!=|<=|>=|[=:])|(?P<join>\+|\.\.?)|(?P<bare>[^\s"'`,;=:+()\[\]{}<>|]+)|(?P<mark>[,;()\[\]{}<>|])"""
)
_BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>|]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|todo|changeme|change_me|example|placeholder|your.*|<.*>|\$\{?.*|%.*%|\{\{.*)$")
#: How much a part of a name tells about its value; pairs count as one part.
_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "bearer": 2.5, "privatekey": 3.0, "accesskey": 3.0, "authkey": 3.0,
    "signingkey": 3.0, "encryptionkey": 3.0, "secretkey": 3.0, "auth": 1.5, "pass": 1.5, "pin": 1.0, "salt": 1.0, "key": 1.0,
}


def sensitivity(name: str) -> float:
    """Largest weight of a name's parts, and of neighbouring parts taken together."""
    parts = [p.lower() for p in _PART.findall(name)]
    return max([0.0, *(_WEIGHTS.get(p, 0.0) for p in parts), *(_WEIGHTS.get(a + b, 0.0) for a, b in zip(parts, parts[1:]))])


#: Beginnings that make a joined value a placeholder.
_HOLDER_HEAD = re.compile(r"(?i)^(?:your|\$\{?|\{\{|<)")


def _graded(length: float, shares: Iterable[float], kinds: int) -> float:
    bits = -sum(p * math.log2(p) for p in shares)
    return min(3.0, bits / 2 + 0.25 * (kinds - 1) + (0.5 if length >= 16 else 0.0))


def _kinds(chars: Iterable[str]) -> int:
    return sum(any(map(f, chars)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in chars)


def strength(literal: str) -> float:
    """0 to 3: how much a literal looks like a generated value, by length and entropy."""
    if len(literal) < 6 or _HOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    n, counts = len(literal), Counter(literal)
    return _graded(n, (c / n for c in counts.values()), _kinds(counts))


Literal = tuple[str, int, int]
_MANY = object()


class _Value:
    """What a name was given: literals of its own and earlier values, and what they amount to together."""

    __slots__ = ("literals", "parents", "length", "shares", "spaced", "head", "only", "best", "best_joined")

    def __init__(self, literals: list[Literal], parents: list[_Value]) -> None:
        self.literals, self.parents = list(dict.fromkeys(literals)), list({id(p): p for p in parents}.values())
        length, counts = 0.0, Counter()
        for p in self.parents:
            length += p.length
            for c, share in p.shares.items():
                counts[c] += share * p.length
        for text, _, _ in self.literals:
            length += len(text)
            counts.update(text)
        self.shares = {c: n / length for c, n in counts.items()} if length else {}
        self.length = min(length, 1e6)  # no more than that is asked for
        self.spaced = any(p.spaced for p in self.parents) or any(c.isspace() for c in counts)
        self.head = self.literals[0][0] if self.literals else self.parents[0].head if self.parents else ""
        one = {p.only for p in self.parents} | set(self.literals)
        self.only: Literal | object = one.pop() if len(one) == 1 else _MANY
        self.best: tuple[float, str] | None = None
        self.best_joined: tuple[float, str] | None = None

    def joined_strength(self) -> float:
        if self.only is not _MANY:
            return strength(self.only[0])
        if self.length < 6 or self.spaced or _HOLDER_HEAD.match(self.head):
            return 0.0
        return _graded(self.length, self.shares.values(), _kinds(self.shares))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed patterns, leftmost and non-overlapping for each."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def assignments(line: str, offset: int) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """``name = term + term ...`` of one line: the name and its terms.

    A term is ("literal", value, start, end) or ("name", name, 0, 0). Quoted
    keys, brackets after a name, types between the name and the operator, and
    command-line options with a value count as targets.
    """
    items = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _LEXEME.finditer(line)]
    i = 0
    while i < len(items):
        kind, lexeme, start, _ = items[i]
        target = lexeme if kind == "name" else lexeme[1:-1] if kind == "string" else None
        i += 1
        if not target:
            continue
        j = i
        while j < len(items) and items[j][1] in "])":
            j += 1
        option = kind == "name" and target[0] == "-" and j < len(items) and items[j][0] in ("string", "bare", "name") and items[j][2] > items[i - 1][3]
        if not option:
            if j >= len(items) or items[j][0] != "set" or items[j][1] in ("==", "!=", "<=", ">="):
                continue
            j += 1
        terms: list[tuple[str, str, int, int]] = []
        while j < len(items):
            kind, lexeme, start, end = items[j]
            if kind == "string":
                terms.append(("literal", lexeme[1:-1], offset + start + 1, offset + end - 1))
                j += 1
            elif kind in ("name", "bare", "join") and not terms or kind in ("name", "bare"):
                whole = _BARE.match(line, start)
                value = whole.group() if whole else lexeme
                plain = kind == "name" and value == lexeme
                if plain:
                    terms.append(("name", lexeme, offset + start, offset + end))
                else:
                    value = value.rstrip(".,")
                    terms.append(("literal", value, offset + start, offset + start + len(value)))
                    end = start + len(value)
                while j < len(items) and items[j][2] < end:
                    j += 1
            else:
                break
            if j < len(items) and items[j][0] == "join":
                j += 1
            else:
                break
        if terms:
            # the value of a typed declaration follows another operator
            yield target, terms
        i = max(i, j - 1) if not terms else j
        if j < len(items) and items[j][0] == "set" and terms and terms[0][0] == "name":
            i = j - 1  # a: b = c; the type was read as a value


def flow_spans(text: str, least: float = 4.0) -> list[tuple[str, int, int, str, float]]:
    """Literals whose value reaches a sensitive name, with that name and a score.

    Line by line, each name keeps what was last given to it: literals, and the
    values of names on the right, so constants propagate through any number of
    names and joins. A value points to the values it was made of. One pass back
    over all of them hands each the best score of the sensitive names it
    reached, so the work grows with the text, not with the square of its joins.

    A literal's score is the name's sensitivity plus the literal's strength, or the
    strength of all characters joined there if there are several literals. A bare
    word directly after a name is a literal if the text never assigns it.
    """
    known: dict[str, _Value] = {}
    values: list[_Value] = []
    at = 0
    for line in text.split("\n"):
        if "=" in line or ":" in line or "--" in line:
            for target, terms in assignments(line, at):
                literals: list[Literal] = []
                parents: list[_Value] = []
                for kind, value, start, end in terms:
                    if kind == "name" and value in known:
                        parents.append(known[value])
                    elif kind == "literal" or len(terms) == 1:
                        literals.append((value, start, end))
                made = _Value(literals, parents)
                values.append(made)
                known[target] = made
                weight = sensitivity(target)
                if weight >= 1 and (whole := made.joined_strength()) > 0:
                    made.best = (weight, target)
                    if made.only is _MANY:
                        made.best_joined = (weight + whole, target)
        at += len(line) + 1
    found: dict[tuple[int, int], tuple[str, int, int, str, float]] = {}
    for made in reversed(values):
        if made.best is None:
            continue
        for parent in made.parents:
            parent.best = max(parent.best or made.best, made.best, key=_first)
            if made.best_joined:
                parent.best_joined = max(parent.best_joined or made.best_joined, made.best_joined, key=_first)
        for value, start, end in made.literals:
            score, name = made.best[0] + strength(value), made.best[1]
            if made.best_joined and made.best_joined[0] > score:
                score, name = made.best_joined
            own = any(map(str.isdigit, value)) or made.best_joined or text[start - 1 : start] in ('"', "'", "`")
            if score >= least and own and end > start and ((start, end) not in found or found[start, end][4] < score):
                found[start, end] = ("flow", start, end, name, score)
    return list(found.values())


def _first(pair: tuple[float, str]) -> float:
    return pair[0]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, name, score) of every row of ``docs``.

    Spans are in code points, end exclusive, ordered by start, then kind. The base
    kinds are ``assign``, ``access`` and ``hex``; ``flow`` spans are literals that
    reach a sensitive name (their name and score are set) and do not repeat a
    base span. A null text is the empty one and has none. Repeated rows stay.
    """
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            lists = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                places = {(s, e) for _, s, e in base}
                spans = [(*s, None, None) for s in base] + [s for s in flow_spans(t or "") if s[1:3] not in places]
                spans.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
                lists.append([dict(zip(("kind", "start", "end", "name", "score"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"
    )


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
