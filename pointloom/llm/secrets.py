"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query on trigrams that any match must contain. A block of documents
is indexed once: postings of the trigrams that some rule asks for. Intersecting and uniting postings gives each rule's candidates,
which alone are scanned by the expression. A rule without a mandatory trigram scans every document.
Index and queries fold A-Z and work on UTF-8 bytes, so a query can only let too many documents through, never too few.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import as_bytes, blocks, bounded, column, live, texts_of

_parse, _op = re._parser, re._constants


@dataclass(frozen=True)
class Rule:
    """``least``: the characters that group ``group`` of a match has at least; shorter matches are dropped after they were consumed. ``span``: the group that
    is the secret, where a match takes more than that to be found in one go."""

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 1
    span: int = 0

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.fold else 0)


#: The first three are the base kinds, in this order. A run of hexadecimal digits is as long as it can be either way,
#: so the least length stands in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: A private key goes from BEGIN to the END of the same label; without that (or with another BEGIN or END before it), over known header lines and as far
#: as the run of base64 goes: words of 16 characters or more, on lines of their own or escaped, and up to two shorter lines after them.
_KEY = (
    r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY( BLOCK|)-----(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END \1PRIVATE KEY\2-----"
    r"|(?:(?:\s|\\[nrt])*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+)*+(?:(?:\s|\\[nrt])*+[A-Za-z0-9+/=]{16,}+(?:(?:\s|\\[nrt])++[A-Za-z0-9+/=]{16,}+)*+"
    r"(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/=]{1,15}+(?=[ \t]*(?:[\r\n\\\"']|\Z))){0,2}+)?+)"
)
#: Further public credential formats. Values have no upper bound, so that a span covers the whole value. The last two are tried only where a run of their
#: letters begins and never step back in it, so that a long run is read a few times and not once for each of its letters.
EXTRA = (
    Rule("private_key", _KEY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", span=1),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]++://[^\s/:@]++:[^\s/@]++@)", span=1),
)
RULES = BASE + EXTRA

# ---- From a regular expression to a query: TRUE, ("tri", bytes), ("and", queries), ("or", queries)

TRUE = ("and", frozenset())
#: Sets of strings larger than this are given up for their trigrams, and character classes larger than CLASS for any character.
STRINGS, CLASS = 64, 8


def _all(*queries):
    parts = frozenset().union(*(q[1] if q[0] == "and" else {q} for q in queries))
    return next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(queries):
    parts = frozenset(queries)
    if TRUE in parts or not parts:
        return TRUE
    return next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _within(strings):
    """That one of these strings occurs."""
    return _any(_all(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) for s in strings)


@dataclass(frozen=True)
class Known:
    """What is known of a match: all the strings it can be (or None), how it can begin and end, and what it contains."""

    exact: frozenset | None
    first: frozenset
    last: frozenset
    query: tuple

    @staticmethod
    def of(strings) -> Known:
        strings = frozenset(strings)
        return Known(strings, strings, strings, TRUE)


ANYTHING = Known(None, frozenset({b""}), frozenset({b""}), TRUE)


def _ends(strings, n, last):
    cut = frozenset(s[-n:] if last else s[:n] for s in strings)
    return cut if len(cut) <= STRINGS else (_ends(strings, n - 1, last) if n > 1 else frozenset({b""}))


def _open(k: Known) -> Known:
    """The same without the exact set."""
    return k if k.exact is None else Known(None, _ends(k.exact, 4, False), _ends(k.exact, 4, True), _all(k.query, _within(k.exact)))


def _then(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return Known.of(x + y for x in a.exact for y in b.exact)
    across = TRUE
    if len(a.last) * len(b.first) <= STRINGS:
        across = _within({x[-2:] + y[:2] for x in a.last for y in b.first})
    first = {x + y for x in a.exact for y in b.first} if a.exact is not None and len(a.exact) * len(b.first) <= STRINGS else a.first
    last = {x + y for x in a.last for y in b.exact} if b.exact is not None and len(a.last) * len(b.exact) <= STRINGS else b.last
    a, b = _open(a), _open(b)
    return Known(None, _ends(first, 4, False), _ends(last, 4, True), _all(a.query, b.query, across))


def _or(parts: list[Known]) -> Known:
    if all(k.exact is not None for k in parts) and sum(len(k.exact) for k in parts) <= STRINGS:
        return Known.of(s for k in parts for s in k.exact)
    parts = [_open(k) for k in parts]
    return Known(None, _ends({s for k in parts for s in k.first}, 4, False), _ends({s for k in parts for s in k.last}, 4, True), _any(k.query for k in parts))


def _item(op, arg) -> Known:
    if op is _op.LITERAL:
        return Known.of([chr(arg).encode().lower()])
    if op is _op.IN:
        chars = set()
        for kind, x in arg:
            if kind is _op.LITERAL and len(chars) <= CLASS:
                chars.add(chr(x))
            elif kind is _op.RANGE and x[1] - x[0] < CLASS:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return ANYTHING
        strings = {c.encode().lower() for c in chars}
        return Known.of(strings) if len(strings) <= CLASS else ANYTHING
    if op is _op.SUBPATTERN:
        return _seq(arg[3])
    if op is _op.BRANCH:
        return _or([_seq(x) for x in arg[1]])
    if op in (_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT):
        low, high, inner = arg
        one = _seq(inner)
        if (low, high) == (0, 1):
            return _or([Known.of([b""]), one])
        if low == 0:
            return ANYTHING
        out = one
        for _ in range(min(low, 4) - 1):
            out = _then(out, one)
        return out if low == high and low <= 4 else _then(_then(out, ANYTHING), one) if out.exact is not None else Known(None, out.first, one.last, out.query)
    if op is _op.AT:
        return Known.of([b""])
    return ANYTHING


def _seq(items) -> Known:
    out = Known.of([b""])
    for op, arg in items:
        out = _then(out, _item(op, arg))
    return out


@lru_cache(256)
def trigram_query(pattern: str, flags: int = 0):
    """The Boolean trigram query of a regular expression, in lower case."""
    return _open(_seq(_parse.parse(pattern, flags))).query


def trigrams(query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


# ---- The index of a block

_FOLD = bytes(range(256)).lower()


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.scan = [re.compile(r.pattern, r.flags).finditer for r in rules]
        self.bytes_scan = [re.compile(r.pattern.encode(), r.flags).finditer if r.pattern.isascii() else None for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.wanted = sorted(set().union(*map(trigrams, self.queries)))
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.wanted, 1):
            self.number[int.from_bytes(t, "big")] = i

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ascending positions in ``texts`` by wanted trigram."""
        joined = np.frombuffer(b"\n\n".join(texts).translate(_FOLD), np.uint8)
        if len(joined) < 3:
            return {}
        code = joined[:-2].astype(np.uint32) << 16
        code |= joined[1:-1].astype(np.uint32) << 8
        code |= joined[2:]
        found = self.number[code]
        at = np.flatnonzero(found)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
        both = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        which, doc = np.divmod(both, max(1, len(texts)))
        cuts = np.searchsorted(which, np.arange(1, len(self.wanted) + 2))
        return {t: doc[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.wanted)}

    def candidates(self, query, postings, n: int) -> np.ndarray:
        if query[0] == "tri":
            return postings.get(query[1], np.zeros(0, np.int64))
        parts = sorted((self.candidates(q, postings, n) for q in query[1]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        out = np.arange(n) if not parts else parts[0]
        for p in parts[1:]:
            out = out[np.isin(out, p, assume_unique=True)]
        return out

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, end, rule number), in code points, by start and then rule."""
        out: list[list] = [[] for _ in texts]
        postings = self.postings(texts)
        decoded: dict[int, str] = {}
        for k, rule in enumerate(self.rules):
            full = self.queries[k] == TRUE and self.bytes_scan[k] and r"\s" not in rule.pattern and "^" not in rule.pattern
            for d in self.candidates(self.queries[k], postings, len(texts)).tolist():
                raw = texts[d]
                if full:  # over all documents: bytes need no decoding, as classes and literals are ASCII
                    found = np.array([m.span(rule.span) for m in self.bytes_scan[k](raw) if m.end(rule.group) - m.start(rule.group) >= rule.least], np.int64)
                    out[d] += [(a, b, k) for a, b in _code_points(raw, found.reshape(-1, 2)).tolist()]
                    continue
                if d not in decoded:
                    decoded[d] = raw.decode("utf-8", "replace")
                out[d] += [(*m.span(rule.span), k) for m in self.scan[k](decoded[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for s in out:
            s.sort(key=lambda x: (x[0], x[2]))
        return out


def _code_points(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Byte positions as code points: each byte that continues a character counts for nothing."""
    if not at.size or raw.isascii():
        return at
    first = np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
    return np.where(at > 0, first[at - 1], 0)


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return live(("secrets", rules), lambda: Scanner(rules))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, array of (kind, start, end), of every row, ordered by start and then rule.

    Positions are code points, the end exclusive. A null or empty text has no spans (an empty array); null ids, repeated rows and empty
    tables pass row by row; the longest text is scanned whole.
    """
    kinds = [r.kind for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        scan = scanner(rules)
        for batch in blocks(batches):
            found = scan.spans(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[{"kind": kinds[k], "start": a, "end": b} for a, b, k in s] for s in found], kind)], names=["doc_id", "spans"])

    return texts_of(docs).mapInArrow(work, f"{column('doc_id', docs)}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text, of rows of find()."""
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by [kind]; overlapping spans become one, named for the first of them.

    All columns and rows stay, a null text stays null, and a text without secrets is unchanged to the byte.
    """
    kinds = [r.kind for r in rules]

    def cleaned(raw: bytes, spans) -> bytes:
        if not spans:
            return raw
        text, out, at = raw.decode("utf-8", "replace"), [], 0
        for start, end, k in spans:
            if start >= at:
                out += [text[at:start], f"[{kinds[k]}]"]
            at = max(at, end)
        return "".join([*out, text[at:]]).encode()

    def work(batches):
        scan = scanner(rules)
        for batch in blocks(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            null = batch.column(at).is_null().to_pylist()
            raw = as_bytes(batch.column(at))
            new = [None if no else cleaned(t, s).decode("utf-8", "replace") for t, s, no in zip(raw, scan.spans(raw), null)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return bounded(docs).mapInArrow(work, docs.schema)
