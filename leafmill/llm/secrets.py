"""Secret scans by assignment-aware lexing.

Base patterns find assignments to sensitive names, access keys and long hex strings. Beside them a small lexer reads
source and configuration syntax into assignments of a name to literals and other names, follows constants to the
literal that they were given, above the use or else below it, and scores each literal by the names that it reaches and by its
own form; literals that are joined are scored as one value too.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

# The base patterns, in the order in which kinds are listed; least characters of a match (group 2 for assign).
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so the same as filtering runs by length
KINDS = ["assign", "access", "hex", "literal"]
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
_SENSITIVE_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of names and how sensitive they are.
NAME_SCORES = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "private": 0.6, "signing": 0.5, "access": 0.4, "api": 0.4, "key": 0.4}
#: Literals that stand for a value to be filled in.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|change_?me.*|your[-_ ].*|example.*|placeholder.*|dummy.*|todo|none|null|true|false|undefined|redacted)$")
LEAST_SCORE, LEAST_LENGTH = 0.5, 8

# name (with quotes or brackets around it), type, operator, then literals and names joined by + or ..
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
_TERM = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|\$\{[A-Za-z_][A-Za-z0-9_.-]*+\}|[A-Za-z0-9_$](?:[A-Za-z0-9_$/+=-]|\.(?=[A-Za-z0-9_$]))*+)"""
#: How deep brackets of a type may stand in one another; a type may be as long as it likes.
TYPE_DEPTH = 8


def _inside(depth: int) -> str:
    """What may stand between the brackets of a type: anything, if brackets in it are paired."""
    inner = r'[^=\n"<>\[\]]*+'
    for _ in range(depth - 1):
        inner = rf'(?:[^=\n"<>\[\]]++|[<\[]{inner}[>\]])*+'
    return inner


_ONE_TYPE = rf"""(?:[&*][ \t]*+)?(?:'[a-z_]++[ \t]++)?(?:(?:mut|dyn|readonly)[ \t]++)?[A-Za-z_][A-Za-z0-9_]*+(?:(?:\.|::)[A-Za-z_][A-Za-z0-9_]*+)*+(?:[<\[]{_inside(TYPE_DEPTH)}[>\]]|[<\[][^=\n"]{{0,100}}[>\]])?[?!*]?"""
_TYPE = rf"(?:[?!]?[ \t]*+:[ \t]*+(?P<type>{_ONE_TYPE}(?:[ \t]*+\|[ \t]*+{_ONE_TYPE})*+)|[ \t]++\*?string|(?:[ \t]*+\[[0-9]*+\])+)[ \t]*+(?==(?![=~>]))"
# a name is looked for once in a run of its characters, after what can't begin it
_STATEMENT = re.compile(rf"""(?<![A-Za-z0-9_.-])[.-]*+(?:[0-9][A-Za-z0-9_]*+[.-]++)*+(?P<name>{_NAME})["'\]]{{0,2}}(?:{_TYPE})?[ \t]*+(?::=|=>|=(?![=~])|:(?![:/]))[ \t]*+(?P<terms>{_TERM}(?:[ \t]*+(?:\+|\.\.)[ \t]*+{_TERM})*+)""")
_PART = re.compile(_TERM)
_ASSIGNED = re.compile(r"[ \t]*+=(?![=~>])")
_SIMPLE_NAME = re.compile(_NAME)
# in double quotes
_INSERTED = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_.-]*+)\}|([A-Za-z_][A-Za-z0-9_]*+))")
#: Characters of either end of a long joined value that are kept, to be compared with placeholders.
ENDS = 32
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a name is: its parts by case and separators, each counted once, 1 at most."""
    parts = {p.lower() for p in _WORDS.findall(name)}
    whole = "".join(p.lower() for p in _WORDS.findall(name))
    return min(1.0, sum(NAME_SCORES.get(p, 0.0) for p in parts) or (1.0 if "apikey" in whole else 0.0))


def _form_score(chars: dict[str, float]) -> float:
    """How random a literal of these characters looks; 0 for prose and for few characters."""
    n = sum(chars.values())
    if " " in chars or len(chars) < 4 or n < LEAST_LENGTH:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in chars.values())
    kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in chars}
    return min(1.0, entropy / 4 + 0.1 * (len(kinds) - 1))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: its length and the entropy of its characters, 0 for placeholders and prose."""
    return 0.0 if len(value) < LEAST_LENGTH or PLACEHOLDER.match(value) else _form_score(Counter(value))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of the base patterns."""
    low = text.lower()
    out = []
    if any(w in low for w in _SENSITIVE_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _statements(text: str):
    """(names, terms) of each assignment, terms as (start, end). A name that is itself assigned (a = b = ...) begins the next one."""
    at = 0
    while m := _STATEMENT.search(text, at):
        terms = [t.span() for t in _PART.finditer(text, m.start("terms"), m.end("terms"))]
        names = [m["name"]]
        if m["type"] and _SIMPLE_NAME.fullmatch(m["type"]) and name_score(m["type"]):
            names.append(m["type"])  # ``note: token = "..."`` reads like a type
        yield names, terms
        a, at = terms[-1][0], m.end()
        if text[a] not in "\"'$" and _ASSIGNED.match(text, at):
            at = a


def _pieces(text: str, a: int, b: int, defined) -> list[tuple[int, int, str | None, bool]]:
    """A term's literals and names: (start, end, name if it is one that is defined, whether quoted)."""
    term = text[a:b]
    if term[0] == '"' and "$" in term:
        out, at = [], a + 1
        for m in _INSERTED.finditer(text, a + 1, b - 1):
            if (name := m[1] or m[2]) in defined:
                out += [(at, m.start(), None, True)] * (m.start() > at) + [(*m.span(), name, True)]
                at = m.end()
        return out + [(at, b - 1, None, True)] * (at < b - 1 or not out)
    if term[0] in "\"'":
        return [(a + 1, b - 1, None, True)]
    name = term.removeprefix("$")
    if name[:1] == "{":
        name = name[1:-1]
    if name in defined or term in defined:
        return [(a, b, name if name in defined else term, False)]
    if "+" in term and all(x.removeprefix("$") in defined for x in term.split("+")):
        out, at = [], a
        for x in term.split("+"):
            out.append((at, at + len(x), x.removeprefix("$"), False))
            at += len(x) + 1
        return out
    # dots join the members of an object, unless the parts look random (signed tokens)
    if "." in term and not all(re.search(x, term) for x in ("[a-z]", "[A-Z]", "[0-9]")):
        b = a + term.index(".")
    return [(a, b, None, False)]


def _placeholder(ends: str, chars: dict[str, float]) -> bool:
    """Whether a long value of these ends and characters is a placeholder: all but those of one repeated character are told by their ends."""
    kinds = {c.lower() for c in chars}
    return bool(PLACEHOLDER.match(kinds.pop() if len(kinds) == 1 else ends)) and (len(kinds) == 0 or len(set(ends.lower())) > 1)


class Joined:
    """What literals give when they are joined: how many, their characters, and the text itself, of a long one its ends. Counts are scaled down where doubling would let them grow without bound."""

    __slots__ = ("best", "chars", "ends", "long", "pieces")

    def __init__(self) -> None:
        self.pieces, self.chars, self.ends, self.long, self.best = 0, {}, "", False, 0.0

    def _end_with(self, ends: str, long: bool) -> None:
        both = self.ends + ends
        self.long = self.long or long or len(both) > 2 * ENDS
        self.ends = both[:ENDS] + both[-ENDS:] if self.long else both

    def add(self, other: Joined) -> None:
        self.pieces = min(self.pieces + other.pieces, 1 << 30)
        for c, k in other.chars.items():
            self.chars[c] = self.chars.get(c, 0) + k
        if sum(self.chars.values()) > 1e12:
            self.chars = {c: k * 1e-6 for c, k in self.chars.items()}
        self._end_with(other.ends, other.long)
        self.best = max(self.best, other.best)

    @classmethod
    def of(cls, value: str) -> Joined:
        out = cls()
        out.pieces, out.chars, out.best = 1, dict(Counter(value)), literal_score(value)
        out._end_with(value, False)
        return out

    def score(self) -> float:
        if not self.long:
            return literal_score(self.ends)
        return 0.0 if _placeholder(self.ends, self.chars) else _form_score(self.chars)


def _parts(text: str, statements) -> list[list[tuple[int, int, bool, int]]]:
    """Literals and names of each statement's value: (start, end, whether known to be a literal, the statement that a name stands for or -1): what it was last given above, or else first below."""
    defined: dict[str, list[int]] = {}
    for i, (names, _) in enumerate(statements):
        for name in names:
            defined.setdefault(name, []).append(i)
    parts = []
    for i, (_, terms) in enumerate(statements):
        own = []
        for a, b in terms:
            for x, y, name, quoted in _pieces(text, a, b, defined):
                given = -1
                if name is not None:
                    all_ = defined[name]
                    k = bisect_left(all_, i)
                    given = all_[k - 1] if k else next((j for j in all_[:2] if j > i), -1)
                own.append((x, y, quoted, given))
        parts.append(own)
    return parts


def _order(parts) -> tuple[list[int], list[list[tuple[int, int, bool, int]]]]:
    """Statements, each after those that its names stand for, and their parts; a name that leads round to its own statement is a literal."""
    order, state = [], [0] * len(parts)  # 1: begun, 2: done
    kept: list = [None] * len(parts)
    for i in range(len(parts)):
        stack = [] if state[i] else [(i, iter(parts[i]))]
        state[i] = state[i] or 1
        while stack:
            j, rest = stack[-1]
            for *_, g in rest:
                if g >= 0 and not state[g]:
                    state[g] = 1
                    stack.append((g, iter(parts[g])))
                    break
            else:
                kept[j] = [(x, y, quoted, g if g >= 0 and state[g] == 2 else -1) for x, y, quoted, g in parts[j]]
                state[j] = 2
                order.append(j)
                stack.pop()
    return order, kept


def literal_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Literals that reach a sensitive name, by assignment or through constants, and lie in no base span.

    Of literals that are joined, those count that score alone and, if the joined value scores, those of LEAST_LENGTH or more; all of them if none scores alone.
    Values are summed up from constants to names and scores handed down from names to literals, so the work grows with the text whatever refers to what.
    """
    if "=" not in text and ":" not in text:
        return []
    statements = list(_statements(text))
    scores = [max(map(name_score, names)) for names, _ in statements]
    if not any(scores):
        return []
    order, parts = _order(_parts(text, statements))
    whole: list = [None] * len(parts)  # of all literals, as names above see the value
    sure: list = [None] * len(parts)  # of those known to be literals, as the statement itself sees it
    for j in order:
        whole[j], sure[j] = Joined(), Joined()
        for x, y, quoted, g in parts[j]:
            if g < 0 and x == y:
                continue
            piece = Joined.of(text[x:y]) if g < 0 else whole[g]
            whole[j].add(piece)
            if quoted or g >= 0:
                sure[j].add(piece)
    # by statement: the highest score that it reaches, and whether a joined value that holds it lists pieces of LEAST_LENGTH (1) or all (2)
    reach, lists = list(scores), [0] * len(parts)
    found = set()
    for j in reversed(order):
        listed = lists[j]
        own = 0
        if scores[j] and sure[j].pieces > 1 and scores[j] * sure[j].score() >= LEAST_SCORE:
            own = 1 if scores[j] * whole[j].best >= LEAST_SCORE else 2
        for x, y, quoted, g in parts[j]:
            if g >= 0:
                reach[g] = max(reach[g], reach[j])
                lists[g] = max(lists[g], listed, own)
                continue
            here = max(listed, own if quoted else 0)
            if x < y and (here == 2 or here == 1 and y - x >= LEAST_LENGTH or reach[j] and reach[j] * literal_score(text[x:y]) >= LEAST_SCORE):
                found.add((x, y))
    starts = [x for x, _, _ in base]
    furthest = list(accumulate((y for _, _, y in base), max))
    inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and furthest[k - 1] >= b
    return [(a, 3, b) for a, b in sorted(found) if not inside(a, b)]


SPAN = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text; other columns stay, or only those of ``carry``) with secrets: kind, start and end (code points of the text, end exclusive), by start and order of kind.

    A null or empty text has none. Rows are judged one by one, so repeated rows have equal results. A column of ``docs`` named secrets is replaced.
    """
    docs = docs.drop("secrets")
    names = docs.columns if carry is None else carry
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            out = []
            for text in K.column(batch, "text"):
                text = text.as_py() or ""
                base = base_spans(text)
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + literal_spans(text, base))])
            yield pa.RecordBatch.from_arrays([*(K.column(batch, c) for c in names), pa.array(out, kind)], [*names, "secrets"])

    return docs.mapInArrow(K.tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + f", secrets {SPAN}")


def redact(text, secrets) -> F.Column:
    """The text with each span of ``secrets`` replaced by [kind]; where spans overlap, the first to start counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x.start < s.at, s).otherwise(F.struct(F.concat(s.out, F.substring(text, s.at + 1, x.start - s.at), F.lit("["), x.kind, F.lit("]")).alias("out"), x.end.alias("at")))
    return F.aggregate(secrets, start, step, lambda s: F.concat(s.out, F.substring(text, s.at + 1, F.length(text))))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), carry=["doc_id"])
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(listed(F.filter("secrets", lambda s: s.kind != "literal")), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
