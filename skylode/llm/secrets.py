"""Secret scans: credential patterns, and weaker parts linked within scopes."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import map_arrow, texts

#: Code points by which two parts of one credential may lie apart.
REACH = 160
#: Kinds in the order of the report.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, n_bundles long"

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


class Rules:
    """The fixed patterns, compiled."""

    def __init__(self):
        self.assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
        self.access = re.compile(r"AKIA[A-Z0-9]+")
        self.hex = re.compile(r"[0-9a-f]{16,}")
        # Weak parts: none is reported alone. Values go on to their end, however long.
        self.identifier = re.compile(r"""(?ai)(?<![a-z0-9_])(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9@._-]{3,}""")
        self.secret = re.compile(r"""(?ai)(?<![a-z0-9])(?:pwd|pass|password|passwd|secret|token|api_?key|secret_?access_?key)["']?\x20{0,8}[:=]\x20{0,8}["']?[^\s"']{4,}""")
        self.endpoint = re.compile(r"""(?ai)(?:(?:https?|ftps?|ssh|s3|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,})|(?<![a-z0-9])(?:host|hostname|endpoint|server)["']?\x20{0,8}[:=]\x20{0,8}["']?[a-z0-9][a-z0-9.:-]{3,}""")
        self.scope = re.compile(r"\n[ \t]*\n")


RULES = Rules()


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find alone, ordered by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in RULES.assign.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in RULES.access.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in RULES.hex.finditer(text)]
    return sorted(out)


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> tuple[list[Span], int]:
    """Weak parts that complement each other, and the number of bundles that parts form.

    The parts of a text are identifiers (access keys among them), secrets
    (assignments and hex runs among them) and endpoints. Parts of two
    different roles are linked if they lie in one scope (no blank line
    between) and at most ``reach`` code points apart: an interval join of the
    parts with themselves, by a sweep over their starts. An identifier needs a
    secret, a secret any other role, an endpoint a secret. A weak part is reported
    if it is linked, and ends after any base span that it overlaps. A secret that goes
    on from a base span needs no link, as it is the rest of it. A bundle is a run of linked parts.
    """
    if "=" not in text and ":" not in text:
        return [], 0
    role = {0: 1, 1: 0, 2: 1, 3: 0, 4: 1, 5: 2}  # identifier, secret, endpoint
    starts, ends = [s for s, _, _ in base], [e for _, _, e in base]
    weak = [(m.start(), k, m.end()) for k, rule in ((3, RULES.identifier), (4, RULES.secret), (5, RULES.endpoint)) for m in rule.finditer(text)]
    # Base spans come with ends that may nest; a part that ends within one adds nothing to it.
    longest = max((e - s for s, _, e in base), default=0)
    free, rest = [], set()
    for w in weak:
        until = max((ends[i] for i in range(bisect_left(starts, w[0] - longest), bisect_left(starts, w[2])) if ends[i] > w[0]), default=-1)
        if until < w[2]:
            free.append(w)
            if until >= 0 and w[1] == 4:
                rest.add(w)
    if not free:
        return [], 0
    parts = sorted({*base, *free})
    breaks = [m.start() for m in RULES.scope.finditer(text)]
    linked, bundles, open_until = rest, 0, -1
    # Sweep: of each role the part that reaches furthest to the right in the same scope so far.
    before: dict[int, tuple[int, int, Span]] = {}
    for part in parts:
        start, kind, end = part
        scope = bisect_right(breaks, start)
        found = False
        for other, (until, its_scope, its) in before.items():
            if other != role[kind] and 1 in (other, role[kind]) and its_scope == scope and start - until <= reach:
                linked |= {part, its}
                found = True
        if found and start > open_until:
            bundles += 1
        if found:
            open_until = max(open_until, end + reach)
        if role[kind] not in before or before[role[kind]][1] != scope or before[role[kind]][0] <= end:
            before[role[kind]] = (end, scope, part)
    # The other way round, for parts whose partner comes later than a nearer part of their own role.
    after: dict[int, tuple[int, int]] = {}
    for part in reversed(parts):
        start, kind, end = part
        scope = bisect_right(breaks, start)
        if any(o != role[kind] and 1 in (o, role[kind]) and sc == scope and at - end <= reach for o, (at, sc) in after.items()):
            linked.add(part)
        after[role[kind]] = (start, scope)
    return sorted(p for p in linked if p[1] > 2), bundles


def scan(text: str, reach: int = REACH) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and the number of bundles of one text."""
    base = base_spans(text)
    more, bundles = linked_spans(text, base, reach)
    return base, sorted(base + more), bundles


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, n_bundles), one for each row of ``docs``.

    Offsets count code points of the whole text, ends exclusive. Null texts
    count as empty ones, which have no spans. Rows repeated are scanned each,
    a null doc_id is kept, an empty table gives no rows, other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x, reach) for x in texts(batch)]
            counts = [[sum(k == own for _, k, _ in base) for base, _, _ in found] for own in range(3)]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _, _ in found]
            linked, bundles = [len(spans) - len(base) for base, spans, _ in found], [n for _, _, n in found]
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([written(s) for _, s, _ in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(linked, pa.int64()), pa.array(bundles, pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, SCHEMA)


def redact_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The columns of ``docs``, every secret span of ``text`` replaced by [kind]; overlapping spans become one, named by the first.

    A null text stays null. All rows and other columns stay as they are.
    """
    columns, at = docs.columns, docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    pieces, done = [], 0
                    for start, kind, end in scan(text, reach)[1]:
                        if start >= done:
                            pieces += [text[done:start], f"[{KINDS[kind]}]"]
                        done = max(done, end)
                    text = "".join([*pieces, text[done:]])
                out.append(text)
            arrays = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_arrow(docs, kernel, docs.schema)
