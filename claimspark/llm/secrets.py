"""Secret scans that read assignments: names, literals, and constants passed on by name."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_set, prepare, slices, words

KINDS = ("assign", "access", "hex", "literal")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# fixed values: the patterns of the plain kinds
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile((r"(" + "|".join(_either(w) for w in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").encode())
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
HEX_BYTES = byte_set((0x30, 0x39), (0x61, 0x66))
# fixed values: parts of names that tell of a secret, with their weight, and of values that are only a stand-in
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "key": 0.5, "signature": 0.5, "salt": 0.5, "bearer": 0.9}
STAND_IN = re.compile(rb"(?i)example|changeme|placeholder|your[_-]|dummy|xxxx|\*\*\*\*|<[^<>]*>|\$\{|todo|redacted")
#: A literal's score is its name's weight times how unlike words it is; at least this makes a span.
ACCEPT = 0.45
# fixed values: what opens a comment to the end of its line, and the operators that give a value to a name or only look like it
LINE_COMMENTS = (b"#", b"//", b"-- ", b";")
GIVES, OTHERS = (b":=", b"=>", b"?=", b"=", b":"), (b"===", b"==", b"!=", b"<=", b">=", b"::", b"://")
#: Where the lexer stops: comments, quotes, ends of tags and operators, the longer first. All begin with a fixed byte, so that plain text is passed over fast.
STOPS = re.compile(b"|".join(re.escape(x) for x in sorted((*LINE_COMMENTS, b"/*", b"<!--", b'"', b"'", b"`", b">", *GIVES, *OTHERS), key=len, reverse=True)))
#: Strings by their opening quotes; only those of three quotes go over lines.
STRINGS = {
    b'"""': re.compile(rb'"""((?:[^"\\]|\\.|"(?!""))*)"""', re.S),
    b"'''": re.compile(rb"'''((?:[^'\\]|\\.|'(?!''))*)'''", re.S),
    b'"': re.compile(rb'"((?:[^"\\\n]|\\.)*)"'),
    b"'": re.compile(rb"'((?:[^'\\\n]|\\.)*)'"),
    b"`": re.compile(rb"`([^`\n]*)`"),
}
PREFIX = re.compile(rb"[bBrRuUfF]{0,2}(?=[\"'`])")
#: The bytes of a name, read backwards from its end; the end tag of an element; a bare value; a name that stands for its value; what joins two strings.
NAME_BACK = re.compile(rb"[A-Za-z0-9_.$-]*")
END_TAG = re.compile(rb"</([A-Za-z_][A-Za-z0-9_.:-]*)\s*>")
BARE = re.compile(rb"[A-Za-z0-9+/_.=~@!-]+")
REFERENCE = re.compile(rb"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?")
JOIN = re.compile(rb"[\x20\t]*(?:[+.][\x20\t]*)?(?=[\"'`])")


def name_weight(name: bytes) -> float:
    """The weight of the most telling part of a name, split at case changes and signs; parts that run on are tried joined in pairs too."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.decode("utf-8", "replace"))
    parts = [p for p in re.split(r"[^a-z0-9]+", text.lower()) if p]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *map("".join, zip(parts, parts[1:], strict=False))]), default=0.0)


def value_weight(value: bytes) -> float:
    """0 to 1 for how little a value looks like words: length, bits per character and classes of characters."""
    if len(value) < 8 or STAND_IN.search(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    return min(1.0, bits / 3.5) * min(1.0, 0.4 + 0.3 * (classes - 1) + 0.2 * (n >= 16))


class Lexer:
    """Reads a source or configuration text once, from stop to stop, and tells its name-value pairs. Its time is linear in the text.

    Comments are passed over: #, // and -- after a blank or at the start of a line, ; at the start of a line, /* */ and <!-- -->. A quote behind a letter or digit opens nothing.
    """

    def __init__(self, text: bytes) -> None:
        self.text = text
        #: By kind of quote, up to where one that opened is known not to close: none that opens before closes either. Where the next start of a tag is.
        self.unclosed: dict[bytes, int] = {}
        self.next_tag = -1
        #: Values of names: those in quotes, which a plain name stands for, and all, which $NAME stands for.
        self.quoted: dict[bytes, tuple[bytes, int, int]] = {}
        self.known: dict[bytes, tuple[bytes, int, int]] = {}

    def pairs(self) -> Iterator[tuple[bytes, bytes, int, int]]:
        """(name, value, start, end); start and end enclose the value where it is written.

        Read are name = value, name: value, name := value, name ?= value, "name" => value, x["name"] = value, name: type = value, and <name>value</name>.
        """
        text, at, floor = self.text, 0, 0  # names are looked for behind the floor
        said: tuple[bytes, int, int] | None = None  # a string just before, which may be a name
        typed: tuple[bytes, int] | None = None  # a name whose colon was followed by a bare word, and where that word ends
        while stop := STOPS.search(text, at):
            token, start, at = stop[0], stop.start(), stop.end()
            if token in LINE_COMMENTS:
                if (text[start - 1 : start] in b"\n\r" if token == b";" else text[start - 1 : start].isspace() or not start):
                    end = text.find(b"\n", at)
                    at = floor = len(text) if end < 0 else end
            elif token in (b"/*", b"<!--"):
                end = text.find(b"*/" if token == b"/*" else b"-->", at)
                at = floor = len(text) if end < 0 else end + 2
            elif token in (b'"', b"'", b"`"):
                if not text[start - 1 : start].isalnum() and (found := self.string_at(start)):
                    said, at = (text[found[0] : found[1]], start, found[2]), found[2]
                    floor = at
            elif token == b">":
                if found := self.element_at(at):
                    name, a, b, floor = found
                    at = floor
                    yield from self.keep(name, text[a:b], a, b, True)
            elif token in OTHERS:
                floor, typed = at, None
            else:
                name = self.name_before(start, floor, said)
                if typed and token == b"=" and not text[typed[1] : start].strip(b" \t"):
                    name = typed[0]
                typed = None
                found = self.value_after(at)
                floor = at
                if not found:
                    continue
                value, a, b, quoted, after = found
                if quoted or BARE.match(text, at) or b"=" in value:
                    at = max(at, after)
                if quoted:
                    floor = at
                elif token == b":":
                    typed = (name, after)
                if name:
                    yield from self.keep(name, value, a, b, quoted)

    def string_at(self, at: int) -> tuple[int, int, int] | None:
        """Start and end of a string's inside, and the end of the string, if one opens here."""
        text = self.text
        at = m.end() if (m := PREFIX.match(text, at)) else at
        quote = text[at : at + 3] if text[at : at + 3] in STRINGS else text[at : at + 1]
        if quote not in STRINGS or at < self.unclosed.get(quote, 0):
            return None
        if m := STRINGS[quote].match(text, at):
            return (*m.span(1), m.end())
        end = text.find(b"\n", at) if len(quote) == 1 else -1
        self.unclosed[quote] = len(text) if end < 0 else end
        return None

    def element_at(self, at: int) -> tuple[bytes, int, int, int] | None:
        """Name, start and end of the text of the element whose start tag ends here, and the end of its end tag, if there is no other tag between."""
        text = self.text
        if self.next_tag < at:
            found = text.find(b"<", at)
            self.next_tag = len(text) if found < 0 else found
        tag = self.next_tag
        if text.find(b">", at, tag) >= 0 or not (m := END_TAG.match(text, tag)):
            return None
        inside = text[at:tag]
        start = at + len(inside) - len(inside.lstrip())
        return m[1], start, max(start, at + len(inside.rstrip())), m.end()

    def name_before(self, start: int, floor: int, said: tuple[bytes, int, int] | None) -> bytes:
        """The name that ends before an operator; blanks and the bracket of an index may stand between. Nothing before the floor is read again."""
        before = self.text[floor:start]
        if said and said[2] == floor and not before.strip(b" \t]"):
            return said[0]
        before = before.rstrip(b" \t")
        if before.endswith(b"]"):
            before = before[:-1].rstrip(b" \t")
        return NAME_BACK.match(before[::-1])[0][::-1].lstrip(b"0123456789.$-")

    def value_after(self, at: int) -> tuple[bytes, int, int, bool, int] | None:
        """A value, its start and end where it is written, whether it was in quotes, and where reading goes on."""
        text = self.text
        while text[at : at + 1] in (b" ", b"\t") and at < len(text):
            at += 1
        if found := self.string_at(at):
            parts, (start, end, after) = [text[found[0] : found[1]]], found
            while (j := JOIN.match(text, after)) and (more := self.string_at(j.end())):
                parts.append(text[more[0] : more[1]])
                end, after = more[1:]
            return b"".join(parts), start, end, True, after
        if m := REFERENCE.match(text, at):
            return (*self.known[m[1]], True, m.end()) if m[1] in self.known else None
        if m := BARE.match(text, at):
            if m[0] in self.quoted:
                return *self.quoted[m[0]], True, m.end()
            if text[m.end() : m.end() + 1] not in (b"(", b"["):  # no call
                return m[0], m.start(), m.end(), False, m.end()
        return None

    def keep(self, name: bytes, value: bytes, start: int, end: int, quoted: bool) -> Iterator[tuple[bytes, bytes, int, int]]:
        self.known[name] = (value, start, end)
        if quoted or name in self.quoted:
            self.quoted[name] = (value, start, end)
        yield name, value, start, end


def scored(text: bytes) -> dict[tuple[int, int], float]:
    """The scores of the literals that are secret enough, by their byte spans: the name's weight times how little the value looks like words."""
    out: dict[tuple[int, int], float] = {}
    names: dict[bytes, float] = {}
    weights: dict[tuple[int, int], float] = {}  # a constant may stand for very many names
    for name, value, start, end in Lexer(text).pairs():
        if name not in names:
            names[name] = name_weight(name)
        weight = names[name]
        if weight and (start, end) not in weights:
            weights[start, end] = value_weight(value)
        score = weight * weights[start, end] if weight else 0.0
        if score >= ACCEPT:
            out[start, end] = max(score, out.get((start, end), 0.0))
    return out


def spans_of(text: bytes, hex_runs: list[tuple[int, int]], pairs: bool) -> tuple[dict[str, list[tuple[int, int]]], list[float]]:
    """Byte spans of each kind, and the scores of the literals; pairs: the text has something that may give a name a value."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    scores: list[float] = []
    if pairs:
        out["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        found = sorted(scored(text).items())
        out["literal"], scores = [k for k, _ in found], [v for _, v in found]
    if b"AKIA" in text:
        out["access"] = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out["hex"] = hex_runs
    return out, scores


def _points(text: bytes, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted."""
    if text.isascii():
        return sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in spans[kind])
    heads = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return sorted((int(heads[a]), k, int(heads[b])) for k, kind in enumerate(KINDS) for a, b in spans[kind])


def _written(points: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in points)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans, literal_scores) of each document.

    assign, access and hex are the plain kinds, found leftmost without overlap in the whole text; matches that are too short are dropped
    after they are found. literal spans enclose the values of assignments, in code and configuration, whose name is sensitive and whose value
    isn't like words; a constant counts where it is written; assignments in comments don't count. literal_scores has their scores, in the order of the spans. Offsets count code points, ends are exclusive; spans are ordered by start, then kind,
    base_sha256 is that of the plain kinds' spans. Null and empty texts have none; null ids stay; repeated rows come out as often as they came; other
    columns are ignored; a very long text takes time and memory in proportion to its size; no rows give no rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, at in slices(batch.column(1)):
                raw = data.tobytes()
                starts, ends, _ = words(data, at, HEX_BYTES)
                long = ends - starts >= LEAST["hex"]
                starts, ends = starts[long], ends[long]
                hex_bounds = np.searchsorted(starts, at)
                ops = np.flatnonzero((data == 0x3D) | (data == 0x3A) | (data == 0x3C))
                op_bounds = np.searchsorted(ops, at)
                for r in range(len(at) - 1):
                    lo, hi = int(at[r]), int(at[r + 1])
                    text = raw[lo:hi]
                    a, b = hex_bounds[r], hex_bounds[r + 1]
                    spans, scores = spans_of(text, [(int(s) - lo, int(e) - lo) for s, e in zip(starts[a:b], ends[a:b], strict=True)], bool(op_bounds[r + 1] > op_bounds[r]))
                    points = _points(text, spans) if any(spans.values()) else []
                    base = _written([p for p in points if p[1] < 3])
                    rows.append((*[len(spans[k]) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), _written(points), scores))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (*(pa.int64(),) * 4, pa.string(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans", "literal_scores"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string, literal_scores array<double>")
