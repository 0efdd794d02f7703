"""Secret scans: base patterns plus assignment-aware lexing of source and configuration text.

Every whole text is lexed into name-literal pairs (``name = "literal"``, ``name: literal``,
``export NAME=literal``, ``"name": "literal"``, ``{ident}`` chains). Constants are propagated:
a name bound to another name, or to a concatenation of literals and names, takes their joined
value (of a name bound more than once, the last before its use, else the first after it), and
sensitivity goes on from name to name to its fixed point. A literal is then scored by how sensitive
the names it reaches are and by its own shape, a joined value likewise (its shape is that of its
first ``LONG`` characters, names without a value are empty). Spans scoring at least ``LEAST``, of a
joined value those of all its literals, are added to the base spans. Base spans are never removed.

Nulls and empty texts have no spans. Repeated rows give repeated results. Row order is not
defined; spans of one text are ordered by start, then kind.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lakelens.llm.shared import numbered, pick, portions, tidy

KINDS = ("assign", "access", "hex", "named")
#: Letters of the keyword in either case, ASCII only.
_ANY = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile(
    "(" + "|".join((_ANY("password"), _ANY("passwd"), _ANY("secret"), _ANY("token"), _ANY("api") + "_?" + _ANY("key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_HEX_LONG = re.compile("[0-9a-f]{32,}")

#: What stands left of an assignment sign, within its line, and right of it: one value, or several joined by a plus or, in
#: round brackets, one after another; both may go on over lines.
_LEFT = re.compile(r"""([A-Za-z_][A-Za-z0-9_.-]*+)["']?[ \t]{0,8}\Z""")
_LITERAL, _NAME = r"""(?:"[^"\n]*"|'[^'\n]*')""", "[A-Za-z_][A-Za-z0-9_.]*+"
_GAP = r"[ \t]*+(?:\\?\r?\n[ \t]*+)?"
_MORE = rf"{_GAP}\+{_GAP}(?:{_LITERAL}|{_NAME})"
_BRACKETS = rf"\([ \t\r\n]*+{_LITERAL}(?:(?:[ \t\r\n]*+\+)?[ \t\r\n]*+(?:{_LITERAL}|{_NAME}))*+[ \t\r\n]*+\)"
_RIGHT = re.compile(rf"""[ \t]{{0,8}}(?P<value>{_LITERAL}(?:{_MORE})*|{_BRACKETS}|{_NAME}[ \t](?:{_MORE})+|[^\s"',;(){{}}\[\]<>]+)""")
_PART = re.compile(r""""([^"\n]*)"|'([^'\n]*)'|([A-Za-z_][A-Za-z0-9_.]*)""")
_JOINED = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*[ \t]+\+")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SIGN = re.compile(r":=|=>|={2,}|[:=]")

#: How sensitive the parts of a target name are.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "private": 1.5, "auth": 1.5, "bearer": 2.5, "access": 1.0, "key": 1.5, "signing": 1.0, "client": 0.5, "api": 1.0, "pass": 2.0, "salt": 1.5, "webhook": 1.0}
LEAST, HOP, LONG = 4.0, 0.25, 4096
_PLACEHOLDER = re.compile(r"(?i)(?:x{4,}|\*{3,}|\.{3}|<[^>]*>|\$\{?[A-Za-z_]|your[_-]|example|changeme|placeholder|none|null|true|false|undefined)")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns; matches are taken leftmost, then filtered by length."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if _SIGN.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_LONG.search(text):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


def _shape(value: str) -> float:
    """0 to 3 for how random a literal looks."""
    n = len(value)
    if n < 8 or any(c.isspace() for c in value) or _PLACEHOLDER.match(value):
        return -10.0
    counts = Counter(value)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value)
    return min(bits / 2.0, 2.0) + 0.5 * (kinds - 1) + (0.5 if n >= 16 else 0.0)


def _sensitivity(name: str) -> float:
    parts = [p.lower() for p in _WORDS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return min(3.5, sum(SENSITIVE.get(p, 0.0) for p in {*parts} | joined))


def _target(text: str, p: int) -> re.Match | None:
    """The name before an assignment sign at p, however long it is: what is looked at grows as long as a name may go on."""
    width = 80
    while True:
        first = max(0, p - width)
        line = text.rfind("\n", first, p) + 1
        left = _LEFT.search(text, max(line, first), p) if line else _LEFT.search(text, first, p)
        if line or not first or left is None or left.start() > first:
            return left
        width *= 4


def pairs(text: str) -> Iterator[tuple[str, int, str]]:
    """(name, where the value starts, value) of every assignment, left to right."""
    at = 0
    while sign := _SIGN.search(text, at):
        p, at = sign.start(), sign.end()
        if at - p > 1 and text[p:at].strip("=") == "":  # a comparison
            continue
        left = _target(text, p)
        if left and (right := _RIGHT.match(text, at)):
            yield left[1], right.start("value"), right["value"]
            at = right.end()


def named_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    direct: dict[str, list[tuple[int, int]]] = {}  # the literals that a name is bound to
    refs: dict[str, set[str]] = {}  # the names that a name takes its value from
    bound: list[tuple[str, list[tuple[int, int, bool]]]] = []  # a name and the parts of its value: start, end, is it a name
    places: dict[str, list[int]] = {}  # where in `bound` a name is
    for name, at, value in pairs(text):
        if value[0] in "\"'(" or not _IDENT.match(value) and _JOINED.match(value):
            parts = [(at + p.start(g), at + p.end(g), g == 3) for p in _PART.finditer(value) for g in (p.lastindex,)]
        else:
            parts = [(at, at + len(value), bool(_IDENT.match(value)) and value != name)]
        for k, (a, b, is_name) in enumerate(parts):
            if is_name:
                refs.setdefault(name, set()).add(text[a:b])
            if not is_name or k == 0:
                direct.setdefault(name, []).append((a, b))
        places.setdefault(name, []).append(len(bound))
        bound.append((name, parts))
    if not direct:
        return []
    score = {n: _sensitivity(n) for n in {*direct, *refs}}
    moved = True
    while moved:  # a constant is as sensitive as the names that take it, a little less each hop: this ends
        moved = False
        for name, sources in refs.items():
            for s in sources:
                if s in score and score[name] - HOP > score[s]:
                    score[s], moved = score[name] - HOP, True
    names = {*direct, *refs}
    out = set()
    for name, spans in direct.items():
        if score[name] < 1.5:
            continue
        for a, b in spans:
            value = text[a:b]
            if value in names:  # a reference to a constant, not a literal
                continue
            if score[name] + _shape(value) >= LEAST:
                out.add((a, 3, b))
    if all(len(parts) == 1 for _, parts in bound):
        return sorted(out)

    def source(k: int, name: str) -> int | None:
        """The binding that a name stands for in binding k."""
        at = places.get(name)
        if not at:
            return None
        i = bisect_left(at, k)
        return at[i - 1] if i else next((x for x in at if x != k), None)

    values: dict[int, tuple[str, int]] = {}  # of a binding: the joined value, how many hops its literals are away
    opened: set[int] = set()
    for first in range(len(bound)):
        stack = [first]
        while stack:
            k = stack[-1]
            own, parts = bound[k]
            sources = [source(k, text[a:b]) if is_name else None for a, b, is_name in parts]
            if k not in opened:
                opened.add(k)
                stack += {j for j in sources if j is not None and j not in opened}
                continue
            stack.pop()
            if k in values:
                continue
            joined, hops = "", 0
            for (a, b, is_name), j in zip(parts, sources, strict=True):
                if not is_name:
                    joined += text[a : min(b, a + LONG)]
                elif j in values:  # in a circle it is not, and empty
                    joined, hops = joined + values[j][0], max(hops, values[j][1] + (bound[j][0] != own))
            values[k] = joined[:LONG], hops

    emitted: set[int] = set()
    for k, (name, parts) in enumerate(bound):
        value, hops = values[k]
        if len(parts) == 1 or score[name] < 1.5 or score[name] - HOP * hops + _shape(value) < LEAST:
            continue
        todo = [k]
        while todo:
            j = todo.pop()
            if j in emitted:
                continue
            emitted.add(j)
            for a, b, is_name in bound[j][1]:
                if not is_name:
                    out |= {(a, 3, b)} if a < b else set()
                elif (i := source(j, text[a:b])) is not None:
                    todo.append(i)
    return sorted(out)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): an added span lying inside a base span adds nothing and is left out."""
    if not text:
        return [], []
    base = base_spans(text)
    extra = [x for x in named_spans(text) if not any(a <= x[0] and x[2] <= b for a, _, b in base)]
    return base, sorted(base + extra)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with the union of the spans replaced; overlapping spans share one mark."""
    if not text or not spans:
        return text
    out, at, k = [], 0, 0
    spans = sorted((a, b) for a, _, b in spans)
    while k < len(spans):
        a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] <= b:
            k += 1
            b = max(b, spans[k][1])
        out += [text[at:a], mark]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column("text"):
            base, spans = scan_text(text.as_py())
            kinds = [k for _, k, _ in spans]
            for c, v in zip(cols, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans), kinds.count(3)), strict=True):
                c.append(v)
        ints = [pa.array(c, pa.int64()) for c in (*cols[:3], cols[5])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *ints[:3], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), ints[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of each whole text; no shuffle, one pass."""
    d = pick(docs, "doc_id", "text")
    return d.withColumn("doc_id", d["doc_id"].cast("long")).mapInArrow(_digest, _SCHEMA)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span in `text` replaced and `n_chars`, if there, brought up to date."""
    names, at = docs.columns, docs.columns.index("text")
    count = names.index("n_chars") if "n_chars" in names else None
    safe = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, at, 1 << 20):
                old = part.column(at).to_pylist()
                new = [redact(t, scan_text(t)[1], mark) for t in old]
                arrays = list(part.columns)
                arrays[at] = pa.array(new, part.schema.field(at).type)
                if count is not None:
                    had = arrays[count].to_pylist()
                    arrays[count] = pa.array([h if a == b or b is None else len(b) for h, a, b in zip(had, old, new, strict=True)], part.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return safe.mapInArrow(tidy(run), safe.schema).toDF(*names)
