"""Text expressions that follow Python's Unicode rules inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 29 code points that ``str.isspace`` accepts and trimming removes.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Tokens of the lexical index, of the hashing embedder and of the semantic chunker.
LEXICAL, HASHED, ASCII = r"[\p{L}\p{N}]+", r"[\p{L}\p{N}_]+", "[a-z0-9]+"
SENTENCE_TILE = r"(?s).*?(?:[.!?]+(?=\s|$)|\z)"
PARAGRAPH_TILE = r"(?s).*?(?:\n\s*\n|\z)"


def _folds() -> tuple[str, str, dict[str, str]]:
    """Code points whose casefold differs from their lower case: one to one, and one to several."""
    plain, several = ([], []), {}
    for c in map(chr, range(0x110000)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        low, fold = c.lower(), c.casefold()
        if low != fold and len(low) == 1:
            if len(fold) == 1:
                plain[0].append(low)
                plain[1].append(fold)
            else:
                several[low] = fold
    return "".join(plain[0]), "".join(plain[1]), several


_FROM, _TO, _SEVERAL = _folds()


def _ranges(points: set[int], gap: int = 64) -> str:
    """A character class that covers the points by few ranges, since long classes match slowly."""
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p - out[-1][1] <= gap and p > 0x2FF:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if b > a else rf"\x{{{a:x}}}" for a, b in out) + "]"


#: A superset of the code points that a fold changes beyond lower case, for a cheap test.
_ODD = _ranges({ord(c) for c in {*_FROM, *_SEVERAL} - {"ß"}})


def fold(text: Column) -> Column:
    """``str.casefold``: lower case, then the code points where folding goes further."""
    return fold_lowered(F.lower(text))


def fold_lowered(low: Column) -> Column:
    """The fold of a text that is in lower case already.

    The common code point is expressed alone; the others run, character by character, only on
    texts that need them.
    """
    table = F.create_map(*[F.lit(x) for kv in _SEVERAL.items() for x in kv])
    full = F.array_join(F.transform(F.split(F.translate(low, _FROM, _TO), ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    ascii_only = F.octet_length(low) == F.length(low)
    return F.when(ascii_only, low).when(low.rlike(_ODD), full).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))


def tokens(text: Column, pattern: str = LEXICAL) -> Column:
    """All matches of a token pattern in the folded text; an empty array for null."""
    return _matches(fold(text), pattern)


def _matches(folded: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(folded, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def with_tokens(df: DataFrame, text: str, name: str, pattern: str = LEXICAL, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the tokens of a column as ``name``.  The lower case text is a step of its own,
    since expressions that share it would each compute it again."""
    low = df.select(*keep, F.lower(F.col(text)).alias("_low"))
    return low.select(*keep, _matches(fold_lowered(F.col("_low")), pattern).alias(name))


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def trimmed_span(piece: Column, start: Column) -> Column:
    """struct(start, end, text): a piece that begins at ``start``, without its outer spaces."""
    left = F.length(piece) - F.length(F.ltrim(piece, F.lit(SPACES)))
    body = trim(piece)
    begin = (start + left).cast("int")
    return F.struct(begin.alias("start"), (begin + F.length(body)).alias("end"), body.alias("text"))


def cut(text: Column, start: Column, end: Column) -> Column:
    """Code points [start, end), counted from 0."""
    return F.substring(text, start + 1, end - start)
