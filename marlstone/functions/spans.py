"""Chunk boundaries as spans of code points; plain Python, no Spark.

A span is (start, end), half open and free of outer white space; a labelled span adds the
structural path.  Strategies whose next boundary depends on the one before live here and run in
Arrow batches (see operators.chunking); those that don't are also available as JVM expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

Span = tuple[int, int]
Named = tuple[int, int, str]

GENERIC = ("fixed", "sliding_window", "recursive", "sentence", "paragraph", "semantic", "proposition")
STRUCTURED = ("section", "hierarchical", "book", "legal", "medical", "code", "conversation")
DOMAINS = ("book", "legal", "medical", "code", "conversation")


@dataclass(frozen=True)
class Policy:
    strategy: str = "recursive"
    max_chars: int = 1200
    overlap_chars: int = 120
    min_chunk_chars: int = 80
    semantic_threshold: float = 0.72
    include_parent_context: bool = True

    def __post_init__(self):
        if self.max_chars <= 0 or not 0 <= self.overlap_chars < self.max_chars or not 0 < self.min_chunk_chars <= self.max_chars:
            raise ValueError("chunk sizes must satisfy 0 <= overlap < max and 0 < min <= max")
        if not 0 <= self.semantic_threshold <= 1:
            raise ValueError("the semantic threshold lies in [0, 1]")


def strip(text: str, lo: int, hi: int) -> Span | None:
    piece = text[lo:hi]
    body = piece.strip()
    if not body:
        return None
    lo += len(piece) - len(piece.lstrip())
    return lo, lo + len(body)


def _solid(text: str, bounds: Iterable[Span]) -> list[Span]:
    return [s for s in (strip(text, lo, hi) for lo, hi in bounds) if s]


def fixed(text: str, limit: int) -> list[Span]:
    return _solid(text, ((i, min(i + limit, len(text))) for i in range(0, len(text), limit)))


def sliding(text: str, limit: int, overlap: int) -> list[Span]:
    out: list[Span] = []
    for i in range(0, len(text), limit - overlap):
        s = strip(text, i, min(i + limit, len(text)))
        if s and s not in out[-1:]:
            out.append(s)
        if i + limit >= len(text):
            break
    return out


#: Where to break an oversize piece, best first: blank line, line, sentence, any white space.
_BREAKS = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+")]


def _last_break(window: str) -> int:
    """Offset of the last break of the best kind that has its last one behind the start."""
    for kind in _BREAKS:
        last = 0
        for m in kind.finditer(window):
            last = m.start()
        if last:
            return last
    return 0


def split(text: str, lo: int, hi: int, limit: int) -> Iterator[Span]:
    """Pieces of at most ``limit``: break at the last good place, else cut hard."""
    while s := strip(text, lo, hi):
        lo, end = s
        if end - lo <= limit:
            yield s
            return
        at = lo + (_last_break(text[lo : lo + limit + 1]) or limit)
        if piece := strip(text, lo, at):
            yield piece
        lo = at


def _split_all(text: str, units: Iterable[Span], limit: int) -> list[Span]:
    return [p for lo, hi in units for p in split(text, lo, hi, limit)]


_SENTENCE = re.compile(r"[.!?]+(?=\s|$)")
_BLANK = re.compile(r"\n\s*\n")


def _between(text: str, lo: int, cuts: Iterable[Span], hi: int) -> list[Span]:
    """Solid pieces between cuts (end of a piece, start of the next)."""
    bounds, at = [], lo
    for a, b in cuts:
        bounds.append((at, a))
        at = b
    return _solid(text, [*bounds, (at, hi)])


def sentences(text: str, lo: int = 0, hi: int | None = None) -> list[Span]:
    hi = len(text) if hi is None else hi
    return _between(text, lo, ((lo + m.end(), lo + m.end()) for m in _sentence_ends(text[lo:hi])), hi)


def _sentence_ends(region: str):
    # "$" also matches before a last line feed, where the look-ahead for white space holds anyway
    return _SENTENCE.finditer(region)


def paragraphs(text: str, lo: int = 0, hi: int | None = None) -> list[Span]:
    hi = len(text) if hi is None else hi
    return _between(text, lo, ((lo + m.start(), lo + m.end()) for m in _BLANK.finditer(text[lo:hi])), hi)


_CLAUSE = re.compile(r"(?:;|,(?=\s+(?:and|but|or)\b))\s+", re.IGNORECASE)


def propositions(text: str, lo: int = 0, hi: int | None = None) -> list[Span]:
    out = []
    for a, b in sentences(text, lo, hi):
        out += _between(text, a, ((a + m.end(), a + m.end()) for m in _CLAUSE.finditer(text[a:b])), b)
    return out


def pack(text: str, units: Iterable[Span], limit: int) -> list[Span]:
    """Extend a chunk by the next unit while the whole, gaps included, stays within ``limit``."""
    out: list[Span] = []
    for lo, hi in _split_all(text, units, limit):
        if out and hi - out[-1][0] <= limit:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def merge_short(spans: Iterable[Span], least: int, most: int) -> list[Span]:
    out: list[Span] = []
    for lo, hi in spans:
        if out:
            a, b = out[-1]
            if hi - a <= most and min(hi - lo, b - a) < least:
                out[-1] = (a, hi)
                continue
        out.append((lo, hi))
    return out


_ASCII_TOKEN = re.compile("[a-z0-9]+")


def semantic(text: str, limit: int, threshold: float) -> list[Span]:
    """Join a sentence to the group before while they fit and share enough of their tokens."""
    out: list[Span] = []
    held: set[str] = set()
    for lo, hi in _split_all(text, sentences(text), limit):
        new = set(_ASCII_TOKEN.findall(text[lo:hi].casefold()))
        both = held | new
        if out and hi - out[-1][0] <= limit and (len(held & new) / len(both) if both else 1.0) >= threshold:
            out[-1] = (out[-1][0], hi)
            held = both
        else:
            out.append((lo, hi))
            held = new
    return out


def _regions(text: str, heads: list[re.Match], name: Callable[[re.Match], str]) -> list[Named]:
    """What lies before the first head, unnamed, and each head with all up to the next."""
    starts = [m.start() for m in heads] + [len(text)]
    named = [(0, starts[0], "")] + [(m.start(), end, name(m)) for m, end in zip(heads, starts[1:])]
    return [(*s, title) for lo, hi, title in named if (s := strip(text, lo, hi))]


_HEADING = re.compile(r"^(#{1,6})[ \t]+(\S[^\n]*?|[^\n]+?)[ \t]*$", re.MULTILINE)


def _markdown(text: str) -> list[Named]:
    open_: dict[int, str] = {}

    def path(m: re.Match) -> str:
        level = len(m[1])
        for deeper in [k for k in open_ if k > level]:
            del open_[deeper]
        open_[level] = m[2].strip(" #:\t")
        return " / ".join(open_[k] for k in sorted(open_))

    return _regions(text, list(_HEADING.finditer(text)), path)


def _any(*options: str) -> str:
    return "(?:" + "|".join(options) + ")"


_ORDINAL = _any("[a-z]+", r"\d+", "[ivxlcdm]+")
_BOOK = re.compile(r"^#+[ \t]+(?P<mark>[^\n]+)$|^(?P<plain>" + _any("book", "part", "chapter") + r"\s+" + _ORDINAL + r"(?:\s*[-:.]\s*[^\n]+)?)[ \t]*$", re.I | re.M)
_NUMBERED = r"\d+(?:\.\d+)*[).]"
_LEGAL = re.compile(r"^(?:#+[ \t]+(?P<mark>[^\n]+)|(?P<plain>" + _any(_any("schedule", "clause", "section", "article") + r"\s+[-.\w]+", _NUMBERED) + r"(?:[ \t]+[^\n]+)?))[ \t]*$", re.I | re.M)
_CLINICAL = sorted(["plan", "allergies", "impression", "findings", "assessment", "diagnosis", r"medications?", "vital signs", "chief complaint", r"laboratory results?", r"history(?: of present illness)?"])
_MEDICAL = re.compile(r"^(?P<plain>" + _any(*_CLINICAL) + r")\s*:\s*[^\n]*$", re.I | re.M)
_NAME = r"[ \t]+[A-Za-z_]\w*"
_CODE = re.compile("^" + _any(r"(?:async[ \t]+)?def" + _NAME, "class" + _NAME, r"(?:export[ \t]+)?" + _any("fn", "impl", "trait", "struct", "enum", "interface", "function") + _NAME, r"(?:public[ \t]+)?" + _any("enum", "interface", "class") + _NAME), re.M)
_SPEAKER = re.compile(r"^([A-Za-z][-A-Za-z0-9 _.]{0,48}):[ \t]*", re.M)


def _title(chars: str) -> Callable[[re.Match], str]:
    return lambda m: (m.groupdict().get("mark") or m["plain"]).strip(chars)


def _each(text: str, regions: list[Named], fallback: str, units, policy: Policy, packed: bool) -> list[Named]:
    out = []
    for lo, hi, path in regions:
        u = units(text, lo, hi)
        spans = pack(text, u, policy.max_chars) if packed else _split_all(text, u, policy.max_chars)
        out += [(*s, path or fallback) for s in merge_short(spans, policy.min_chunk_chars, policy.max_chars)]
    return out


def _unmerged(text: str, heads: list[re.Match], name, before: str, fallback: str, limit: int) -> list[Named]:
    if not heads:
        return [(*s, fallback) for s in split(text, 0, len(text), limit)]
    return [(*s, title or before) for lo, hi, title in _regions(text, heads, name) for s in split(text, lo, hi, limit)]


def spans(text: str, policy: Policy, part: str = "text") -> list[Named]:
    """Labelled spans of one text under a strategy of GENERIC, STRUCTURED, evidence or table."""
    if not text or not text.strip():
        return []
    most, s = policy.max_chars, policy.strategy
    whole = lambda t, lo, hi: [(lo, hi)]
    if s == "evidence":
        return [(*x, f"{part}/row-{i}") for i, x in enumerate(fixed(text, most))]
    if s == "table":
        return [(m.start(), m.end(), f"{part}/row-{i}") for i, m in enumerate(table_rows(text))]
    if s in GENERIC:
        found = {
            "fixed": lambda: fixed(text, most),
            "sliding_window": lambda: sliding(text, most, policy.overlap_chars),
            "recursive": lambda: _split_all(text, paragraphs(text), most),
            "sentence": lambda: pack(text, sentences(text), most),
            "paragraph": lambda: pack(text, paragraphs(text), most),
            "semantic": lambda: semantic(text, most, policy.semantic_threshold),
            "proposition": lambda: _split_all(text, propositions(text), most),
        }[s]()
        return [(*x, part) for x in merge_short(found, policy.min_chunk_chars, most)]
    if s == "section":
        out = _each(text, _markdown(text), part, whole, policy, True)
    elif s == "hierarchical":
        out = _each(text, _markdown(text), part, paragraphs, policy, False)
    elif s == "book":
        out = _each(text, _regions(text, list(_BOOK.finditer(text)), _title(" #\t")), part, paragraphs, policy, True)
    elif s == "legal":
        out = _each(text, _regions(text, list(_LEGAL.finditer(text)), _title(" #:\t")), part, propositions, policy, False)
    elif s == "medical":
        out = _each(text, _regions(text, list(_MEDICAL.finditer(text)), _title(" #:\t")), part, paragraphs, policy, True)
    elif s == "code":
        out = _unmerged(text, list(_CODE.finditer(text)), lambda m: m[0], "module", part, most)
    elif s == "conversation":
        out = _unmerged(text, list(_SPEAKER.finditer(text)), lambda m: m[1], part, part, most)
    else:
        raise ValueError(f"{s!r} is no textual strategy")
    return out if policy.include_parent_context else [(lo, hi, part) for lo, hi, _ in out]


_ROW = re.compile(r"^\s*\S.*?(?=\n|$)", re.M)


def structured(text: str, limit: int, part: str = "text") -> list[Named]:
    """Paragraphs cut at the last space or line break within ``limit``, each with the headings that are
    open where it begins."""
    heads = [(m.start(), len(m[1]), m[2]) for m in re.finditer(r"^(#{1,6})\s+(.+?)\s*$", text, re.M)]
    out, open_, k = [], {}, 0
    for lo, hi in paragraphs(text):
        while True:
            end = hi if hi - lo <= limit else max(text.rfind(c, lo, lo + limit + 1) for c in " \n")
            end = lo + limit if end <= lo else end
            while k < len(heads) and heads[k][0] < lo:
                _, level, title = heads[k]
                open_ = {j: t for j, t in open_.items() if j < level} | {level: title}
                k += 1
            if piece := strip(text, lo, end):
                out.append((*piece, " / ".join(open_[j] for j in sorted(open_)) or part))
            rest = strip(text, end, hi)
            if end >= hi or not rest:
                break
            lo = rest[0]
    return out


def segments(text: str, limit: int) -> list[str]:
    """Consecutive pieces of at most ``limit``, cut at the last space or line break if there is one."""
    out, lo = [], 0
    while rest := strip(text, lo, len(text)):
        lo = rest[0]
        end = min(lo + limit, len(text))
        if end < len(text):
            at = max(text.rfind(c, lo, end + 1) for c in " \n")
            end = at if at > lo else end
        out.append(text[lo:end].strip())
        lo = end
    return out


def table_rows(text: str) -> list[re.Match]:
    return [m for m in _ROW.finditer(text) if m[0].strip()]


def domain(strategy: str, declared: str | None = None) -> str:
    if declared and declared.strip():
        return declared.strip().casefold()
    return strategy if strategy in DOMAINS else "text"


def joined(parts: list[str]) -> tuple[str, list[Span]]:
    """Parts joined by blank lines, and where each lies."""
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p) + 2
    return "\n\n".join(parts), out


def overlapping(ranges: list[Span], spans_: Iterable[Span]) -> list[tuple[int, ...]]:
    """Parts that each span touches; a group equal to the one before is dropped."""
    out: list[tuple[int, ...]] = []
    for lo, hi in spans_:
        group = tuple(i for i, (a, b) in enumerate(ranges) if a < hi and b > lo)
        if group and group not in out[-1:]:
            out.append(group)
    return out


def fill_whole(sizes: list[int], limit: int) -> list[tuple[int, ...]]:
    """Whole parts into groups of at most ``limit``, two characters between; an oversize part alone."""
    out: list[list[int]] = []
    used = 0
    for i, n in enumerate(sizes):
        if out and used + 2 + n <= limit:
            out[-1].append(i)
            used += 2 + n
        else:
            out.append([i])
            used = n
    return [tuple(g) for g in out]


def slide_whole(sizes: list[int], limit: int, overlap: int) -> list[tuple[int, ...]]:
    """As :func:`fill_whole`, each group led by what fits of the tail of the group before."""
    groups = fill_whole(sizes, limit)
    if not overlap:
        return groups
    out = groups[:1]
    for g in groups[1:]:
        room = min(overlap, max(0, limit - sum(sizes[i] for i in g) - 2 * (len(g) - 1)))
        carried: list[int] = []
        used = 0
        for i in reversed(out[-1]):
            more = sizes[i] + 2 * bool(carried)
            if used >= room or used + more > room:
                break
            carried.insert(0, i)
            used += more
        led = (*carried, *g)
        out.append(g if led == out[-1] else led)
    return out
