"""SQL that states the textual chunking strategies, put together from their steps.

Every step is a table of pieces (document_id, r, n, lo, p, path): text ``p``, free of outer white
space, at code point ``lo``, of region ``r``, in the order of ``n``.
"""

from __future__ import annotations

WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SENTENCE = r"(?s).*?(?:[.!?]+(?:\s|$)|$)"
BLANK = r"(?s).*?(?:\n\s*\n|$)"
_MARK = "chr(1)"


def _solid(src: str, columns: str) -> str:
    """Pieces (q at position ``pos``) without their outer white space; blank ones are left out."""
    return f"SELECT {columns}, pos + len(q) - len(ltrim(q, {WS})) AS lo, trim(q, {WS}) AS p FROM {src} WHERE trim(q, {WS}) <> ''"


def _cut(name: str, of: str, parts: str) -> str:
    """Cut every piece of ``of`` into the list ``parts``, whose elements together make it up."""
    return f"""{name}_l AS (SELECT document_id, r, n, path, lo, {parts} AS l FROM {of}),
{name}_e AS (SELECT document_id, r, n, path, lo, unnest(l) AS q, generate_subscripts(l, 1) AS i FROM {name}_l),
{name}_p AS (SELECT document_id, r, n * 100000 + i AS n, path, q, lo + sum(len(q)) OVER (PARTITION BY document_id, r, n ORDER BY i) - len(q) AS pos FROM {name}_e),
{name} AS ({_solid(f'{name}_p', 'document_id, r, n, path')})"""


def _tiles(name: str, of: str, pattern: str) -> str:
    return _cut(name, of, f"list_filter(regexp_extract_all(p, '{pattern}'), lambda x: x <> '')")


def _clauses(name: str, of: str) -> str:
    marked = f"regexp_replace(p, ';\\s+', '\\0' || {_MARK}, 'g')"
    for _ in range(2):  # a second time for what the first match of two neighbours took
        marked = f"regexp_replace({marked}, '(?i)(,\\s+)((?:and|but|or)(?:[^\\p{{L}}\\p{{N}}_]|$))', '\\1' || {_MARK} || '\\2', 'g')"
    return _cut(name, of, f"string_split({marked}, {_MARK})")


def _split(name: str, of: str, limit: int) -> str:
    """Pieces of at most ``limit``: cut at the last blank line, line, sentence or space, or hard."""
    w = f"substr(p, 1, {limit} + 1)"
    at = rf"""CASE WHEN regexp_matches({w}, '\n\s*\n') THEN len(regexp_extract({w}, '(?s)^(.*)\n\s*\n', 1))
 WHEN contains({w}, chr(10)) THEN len(regexp_extract({w}, '(?s)^(.*)\n', 1))
 WHEN regexp_matches({w}, '[.!?]\s') THEN len(regexp_extract({w}, '(?s)^(.*[.!?])\s', 1))
 WHEN regexp_matches({w}, '\s') THEN len(regexp_extract({w}, '(?s)^(.*)\s', 1)) ELSE {limit} END"""
    return f"""{name}_r AS (SELECT document_id, r, n, 0 AS m, path, lo, p FROM {of}
 UNION ALL SELECT document_id, r, n, m + 1, path, lo + cut_at + len(substr(p, cut_at + 1)) - len(ltrim(substr(p, cut_at + 1), {WS})), trim(substr(p, cut_at + 1), {WS})
  FROM (SELECT *, {at} AS cut_at FROM {name}_r WHERE len(p) > {limit}) WHERE trim(substr(p, cut_at + 1), {WS}) <> ''),
{name} AS (SELECT document_id, r, n * 100000 + m AS n, path, lo, CASE WHEN len(p) > {limit} THEN rtrim(substr(p, 1, {at}), {WS}) ELSE p END AS p FROM {name}_r)"""


def _fold(name: str, of: str, joins: str, more: str = "", carry: str = "") -> str:
    """Join a piece ``x`` to the one before, ``a``, where ``joins`` says so; within regions, in order.

    Of spans (document_id, r, n, path, s, e).  ``more``: further fields of a piece; ``carry``: what
    becomes of them when two are joined.
    """
    keep = "'o': list_append(a.o, {'s': a.s, 'e': a.e})"
    new = more.replace("$", "x.") if more else ""
    return f"""{name}_u AS (SELECT document_id, r, path, list({{'s': s::BIGINT, 'e': e::BIGINT{more.replace('$', '')}, 'o': []::STRUCT(s BIGINT, e BIGINT)[]}} ORDER BY n) AS u FROM {of} GROUP BY ALL),
{name}_f AS (SELECT document_id, r, path, list_reduce(u, lambda a, x: CASE WHEN {joins} THEN {{'s': a.s, 'e': x.e{carry}, 'o': a.o}} ELSE {{'s': x.s, 'e': x.e{new}, {keep}}} END) AS f FROM {name}_u),
{name}_o AS (SELECT document_id, r, path, list_append(f.o, {{'s': f.s, 'e': f.e}}) AS o FROM {name}_f),
{name} AS (SELECT document_id, r, path, i AS n, x.s AS s, x.e AS e FROM (SELECT document_id, r, path, unnest(o) AS x, generate_subscripts(o, 1) AS i FROM {name}_o))"""


def _short(name: str, of: str, least: int, limit: int) -> str:
    return _fold(name, of, f"x.e - a.s <= {limit} AND least(x.e - x.s, a.e - a.s) < {least}")


def _spans(name: str, of: str) -> str:
    return f"{name} AS (SELECT document_id, r, n, path, lo AS s, lo + len(p) AS e, p FROM {of})"


def _regions(head: str, title: str, level: str | None = None) -> str:
    """Regions of the texts ``x``: what lies before the first head line, without a path, and each head
    line with all up to the next.  ``title`` of a line; ``level``: of nested heads."""
    nested = ""
    path = "title"
    if level:
        # a head closes all that are deeper, and the path of a level counts while nothing above it came
        at = ", ".join(f"max(CASE WHEN level = {j} THEN i END) OVER w AS i{j}" for j in range(1, 7))
        names = ", ".join(f"last_value(CASE WHEN level = {j} THEN title END IGNORE NULLS) OVER w AS t{j}" for j in range(1, 7))
        nested = f"nest AS (SELECT document_id, i, level, {at}, {names} FROM head WHERE is_head WINDOW w AS (PARTITION BY document_id ORDER BY i)),\n"
        valid = [f"CASE WHEN {j} <= level AND i{j} > greatest(-1{''.join(f', coalesce(i{u}, -1)' for u in range(1, j))}) THEN t{j} END" for j in range(1, 7)]
        path = f"concat_ws(' / ', {', '.join(valid)})"
    return rf"""ln_l AS (SELECT document_id, text, string_split(text, chr(10)) AS l FROM x),
ln AS (SELECT document_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM ln_l),
head AS (SELECT document_id, i, sum(len(line) + 1) OVER (PARTITION BY document_id ORDER BY i) - len(line) - 1 AS begins, regexp_matches(line, '{head}') AS is_head, {title} AS title, {level or 0} AS level FROM ln),
{nested}cuts AS (SELECT document_id, 0 AS i, 0 AS begins, '' AS path FROM x UNION ALL SELECT document_id, i, begins, {path} AS path FROM head {'JOIN nest USING (document_id, i, level)' if level else ''} WHERE is_head),
reg_b AS (SELECT document_id, i AS r, 0 AS n, path, begins AS pos, substr(text, begins + 1, coalesce(lead(begins) OVER (PARTITION BY document_id ORDER BY i), len(text)) - begins) AS q FROM cuts JOIN x USING (document_id)),
reg AS ({_solid('reg_b', 'document_id, r, n, path')})"""


_ORDINAL = r"(?:[a-z]+|\d+|[ivxlcdm]+)"
_MARKED = r"#+[ \t]+[^\n]+"
_BOOK = rf"(?i)^(?:{_MARKED}|(?:book|part|chapter)\s+{_ORDINAL}(?:\s*[-:.]\s*[^\n]+)?[ \t]*)$"
_LEGAL = rf"(?i)^(?:{_MARKED}|(?:(?:schedule|clause|section|article)\s+[-.\p{{L}}\p{{N}}_]+|\d+(?:\.\d+)*[).])(?:[ \t]+[^\n]+)?)[ \t]*$"
_MEDICAL = r"(?i)^(?:plan|allergies|impression|findings|assessment|diagnosis|medications?|vital signs|chief complaint|laboratory results?|history(?: of present illness)?)\s*:\s*[^\n]*$"
_NAME = r"[ \t]+[A-Za-z_][\p{L}\p{N}_]*"
_CODE = rf"^(?:(?:async[ \t]+)?def{_NAME}|class{_NAME}|(?:export[ \t]+)?(?:fn|impl|trait|struct|enum|interface|function){_NAME}|(?:public[ \t]+)?(?:enum|interface|class){_NAME})"
_SPEAKER = r"^[A-Za-z][-A-Za-z0-9 _.]{0,48}:"
_HEADING = r"^#{1,6}[ \t]+[^\n]*[^\n \t][^\n]*$"
_PLAIN = "trim(regexp_replace(line, '^#+[ \\t]+', ''), ' #{}' || chr(9))"


def chunks(strategy: str, source: str, limit: int, overlap: int = 0, least: int = 80, threshold: float = 0.0, part: str = "text-0") -> str:
    """SQL of (document_id, ordinal, start, end, structural_path, document_domain) under a strategy;
    ``source`` selects (document_id, text)."""
    whole = f"reg AS (SELECT document_id, 0 AS r, 0 AS n, '' AS path, len(text) - len(ltrim(text, {WS})) AS lo, trim(text, {WS}) AS p FROM x WHERE trim(text, {WS}) <> '')"
    steps = ["x AS (SELECT document_id, text FROM (" + source + ") WHERE text IS NOT NULL)"]
    domain, path = "text", f"CASE WHEN path = '' THEN '{part}' ELSE path END"
    last = "z"
    if strategy in ("fixed", "sliding_window"):
        step = limit if strategy == "fixed" else limit - overlap
        stop = "len(text)" if step == limit else f"greatest(0, ceil((len(text) - {limit}) / {step}.0)::BIGINT * {step}) + 1"
        steps += [
            f"w AS (SELECT document_id, 0 AS r, i AS n, '' AS path, i AS pos, substr(text, i + 1, {limit}) AS q FROM (SELECT document_id, text, unnest(range(0, {stop}, {step})) AS i FROM x WHERE len(text) > 0))",
            f"ws AS ({_solid('w', 'document_id, r, n, path')})", _spans("wv", "ws"),
            "wd AS (SELECT * FROM (SELECT *, lag(s) OVER v AS ps, lag(e) OVER v AS pe FROM wv WINDOW v AS (PARTITION BY document_id ORDER BY n)) WHERE ps IS NULL OR ps <> s OR pe <> e)",
            _short("z", "wd", least, limit),
        ]
    elif strategy == "table":
        steps += [
            "ln_l AS (SELECT document_id, string_split(text, chr(10)) AS l FROM x)", "ln AS (SELECT document_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM ln_l)",
            "la AS (SELECT document_id, i, line, sum(len(line) + 1) OVER (PARTITION BY document_id ORDER BY i) - 1 AS e FROM ln)",
            f"z AS (SELECT document_id, 0 AS r, i AS n, coalesce(lag(e) OVER v + 1, 0) AS s, e, '{part}/row-' || (row_number() OVER v - 1) AS path FROM la WHERE trim(line, {WS}) <> '' WINDOW v AS (PARTITION BY document_id ORDER BY i))",
        ]
    elif strategy in ("recursive", "sentence", "paragraph", "proposition", "semantic"):
        steps += [whole, _tiles("u", "reg", BLANK if strategy in ("recursive", "paragraph") else SENTENCE)]
        steps += [_clauses("c", "u")] if strategy == "proposition" else []
        steps += [_split("sp", "c" if strategy == "proposition" else "u", limit), _spans("sv", "sp")]
        last = "sv"
        if strategy in ("sentence", "paragraph"):
            steps.append(_fold("k", "sv", f"x.e - a.s <= {limit}"))
            last = "k"
        elif strategy == "semantic":
            steps.append("st AS (SELECT *, list_distinct(regexp_extract_all(replace(lower(p), 'ß', 'ss'), '[a-z0-9]+')) AS t FROM sv)")
            both = "len(list_distinct(list_concat(a.t, x.t)))"
            alike = f"(CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.t, x.t))::DOUBLE / {both} END) >= {threshold}"
            steps.append(_fold("k", "st", f"x.e - a.s <= {limit} AND {alike}", ", 't': $t", ", 't': list_distinct(list_concat(a.t, x.t))"))
            last = "k"
        steps.append(_short("z", last, least, limit))
    else:
        domain = strategy if strategy in ("book", "legal", "medical", "code", "conversation") else "text"
        plain = lambda chars: _PLAIN.format(chars)
        head, title, level = {
            "section": (_HEADING, plain(":"), "len(regexp_extract(line, '^#+'))"), "hierarchical": (_HEADING, plain(":"), "len(regexp_extract(line, '^#+'))"),
            "book": (_BOOK, plain(""), None), "legal": (_LEGAL, plain(":"), None), "medical": (_MEDICAL, "trim(regexp_extract(line, '^[^:]*'), ' #:' || chr(9))", None),
            "code": (_CODE, f"regexp_extract(line, '{_CODE}')", None), "conversation": (_SPEAKER, "regexp_extract(line, '^[^:]*')", None),
        }[strategy]
        steps.append(_regions(head, title, level))
        if strategy in ("hierarchical", "book", "medical"):
            steps.append(_tiles("u", "reg", BLANK))
        elif strategy == "legal":
            steps += [_tiles("t", "reg", SENTENCE), _clauses("u", "t")]
        steps += [_split("sp", "reg" if strategy in ("section", "code", "conversation") else "u", limit), _spans("sv", "sp")]
        last = "sv"
        if strategy in ("section", "book", "medical"):
            steps.append(_fold("k", "sv", f"x.e - a.s <= {limit}"))
            last = "k"
        if strategy in ("code", "conversation"):
            steps.append(f"z AS (SELECT * FROM {last})")
            if strategy == "code":
                path = f"CASE WHEN path <> '' THEN path WHEN max(path) OVER (PARTITION BY document_id) <> '' THEN 'module' ELSE '{part}' END"
        else:
            steps.append(_short("z", last, least, limit))
    return "WITH RECURSIVE " + ",\n".join(steps) + f"""
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY r, n, s) - 1)::INTEGER AS ordinal, s::INTEGER AS start, e::INTEGER AS "end", {path} AS structural_path, '{domain}' AS document_domain FROM z"""
