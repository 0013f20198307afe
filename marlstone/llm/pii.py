"""Personal data by weak supervision.

Candidate spans are voted on by labelers: strict formats, checksums and plausibility, gazetteers,
words of the context, neighbours that speak against, and shape.  Expectation-maximisation over
the counts of all vote patterns in the corpus estimates how reliable each labeler is, without any
label; its posteriors then train the final span classifier, a logistic regression on features of
the span and its context.
"""

from __future__ import annotations

import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Spans to train the final classifier on; a bound on the sample, never on what is scored.
SAMPLE = 20000
ACCEPT = 0.5
CONTEXT = 48
KINDS = ("email", "ip", "card", "ssn", "phone", "number")
VOTERS = ("format", "checksum", "gazetteer", "cue", "counter", "shape")
#: One character of an address; around an @ there are LOCAL at most before it and HOST after it.
_MAIL_CHAR = r"[^\s<>()\[\],;:\"'=@]"
LOCAL, HOST = 128, 255
_BEFORE = re.compile(_MAIL_CHAR + r"+\Z")
_AFTER = re.compile(rf"(?:{_MAIL_CHAR}|@){{1,{HOST}}}")
_IP = r"\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
_CARD = r"(?:\d{4}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?!\w)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\w-])"
#: A separator inside a number; a space before a whole address, card or SSN ends the number.
_SEP = rf"(?:[.-]| (?!{_IP}|{_CARD}|{_SSN}))"
#: The same after a calling code, where groups of four may look like the head of a card.
_JOIN = rf"(?:[.-]| (?!{_IP}|{_SSN}))"
_NUMBER = re.compile(
    rf"(?P<ip>(?<![\w.]){_IP})"
    rf"|(?P<card>(?<![\w.]){_CARD})"
    rf"|(?P<ssn>(?<![\w.-]){_SSN})"
    r"|(?P<phone>(?<![\w.])(?:"
    rf"(?:\+\d{{1,3}}[ .-]?\d|0\d)(?:{_SEP}\d{{2}}){{4}}(?!\w|\.\d)"  # pairs
    r"|(?:\+\d{8,15}|0\d{8,10}|\d{10})(?!\w|\.\d)"  # no separators
    # only a group of three may be followed by one more, and not by the head of another number
    rf"|(?:\+\d{{1,3}}{_JOIN}?(?:\(\d{{2,4}}\)|\d{{2,4}}){_JOIN}?\d{{3,4}}{_JOIN}|(?:\(\d{{2,4}}\)|\d{{2,4}}){_SEP}?\d{{3,4}}{_SEP})"
    rf"(?:\d{{4}}|\d{{3}}(?:{_SEP}\d{{2,4}}(?![.-]?\d))?)(?!\w|\.\d)))"
    rf"|(?P<number>(?<![\w.])\+?\d(?:{_SEP}|[\d()]){{5,}}\d(?!\w))"
)
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:\d{1,3}\.){3}\d{1,3}"),
    "card": re.compile(r"\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}"),
    "ssn": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "phone": re.compile(r"(?:\+\d{1,3} ?)?\(\d{3}\) ?\d{3}-\d{4}|\+\d{1,3}(?:[ -]\d{2,4}){3,4}|\d{3}[-.]\d{3}[-.]\d{4}|(?:\+\d{1,3} ?\d|0\d)(?:[ .-]\d{2}){4}|\+\d{8,15}|0\d{8,10}|[2-9]\d{2}[2-9]\d{6}"),
    "number": re.compile(r"[+0][\d .()-]+"),  # dialled in groups of no known format
}
_TLDS = set("com org net edu gov mil int info io co biz me dev app ai xyz online site shop cloud tech uk de fr es it nl eu us ca au ch at be jp cn in br pl se no dk fi ie pt gr cz sk hu ro bg hr si lt lv ee lu is ru ua tr il ae sa za ng ke eg ma mx ar cl pe ve kr tw hk sg my th vn ph id nz pk bd lk ir".split())
_CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "55", "61", "81", "82", "86", "90", "91"}
_CUES = set("mail email e courriel correo contact contacto kontakt phone tel telephone téléphone teléfono telefon mobile handy call fax card visa mastercard credit karte carte tarjeta ip host server client address adresse dirección ssn social security account konto compte cuenta".split())
_COUNTER = set("version v page pages section chapter figure fig table isbn issn doi rfc no nr num vol license licence copyright build release id sha md5 hash".split())


def _luhn(d: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def votes(kind: str, span: str, before: str, after: str) -> list[int]:
    """+1 personal, -1 not, 0 no opinion; in the order of VOTERS."""
    digits = re.sub(r"\D", "", span)
    strict = 1 if _STRICT[kind].fullmatch(span) else -1
    octets = [int(x) for x in span.split(".")] if kind == "ip" else []
    if kind == "email":
        local, _, host = span.rpartition("@")
        check = 1 if 0 < len(local) <= 64 and ".." not in span and "." in host else -1
        gaz = 1 if host.rpartition(".")[2].lower() in _TLDS else -1
    elif kind == "ip":
        check = 1 if all(o <= 255 for o in octets) else -1
        gaz = -1 if octets[0] in (0, 127) or octets[0] >= 224 else 1
    elif kind == "card":
        check = 1 if _luhn(digits) else -1
        gaz = 1 if digits[0] in "3456" or 2221 <= int(digits[:4]) <= 2720 else -1
    elif kind == "ssn":
        check, gaz = 0, 1 if int(digits[:3]) <= 772 else 0  # areas that were given out by region
    elif kind == "phone":
        check = 1 if 7 <= len(digits) <= 15 else -1
        gaz = 0 if "+" not in span else 1 if any(digits.startswith(c) for c in _CALLING) else -1
    else:
        check, gaz = -1 if len(digits) > 15 else 0, 0
    near = [w.lower() for w in C.WORD.findall(before)[-5:]] + [w.lower() for w in C.WORD.findall(after)[:2]]
    cue = 1 if any(w in _CUES for w in near) else 0
    last = C.WORD.findall(before)[-1:]
    counter = -1 if (last and last[0].lower() in _COUNTER) or before[-1:] in ("=", "#", "$", "€", "/", "\\", "_") or after[:1] in ("%", "/", "_", "=") else 0
    low, high = {"email": (6, 80), "ip": (7, 15), "card": (13, 23), "ssn": (11, 11), "phone": (9, 22), "number": (9, 24)}[kind]
    return [strict, check, gaz, cue, counter, 1 if low <= len(span) <= high and len(set(digits)) != 1 else -1]


FEATURE_BITS = 12


def features(kind: str, span: str, before: str, after: str, v: list[int]) -> list[int]:
    said = [f"k={kind}", f"len={len(span) // 3}", f"dig={sum(c.isdigit() for c in span) // 2}", f"sep={sum(not c.isalnum() for c in span)}", f"b={before[-1:].isalnum()}{before[-1:].isspace()}", f"a={after[:1].isalnum()}{after[:1].isspace()}"]
    said += [f"{kind}:{n}={x}" for n, x in zip(VOTERS, v)]
    said += [f"w-{i}={w.lower()}" for i, w in enumerate(reversed(C.WORD.findall(before)[-2:]))] + [f"w+={w.lower()}" for w in C.WORD.findall(after)[:1]]
    return sorted({zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1) for s in said})


#: What every number begins with: only there is the long pattern tried.
_START = re.compile(r"[+(\d]")


def _numbers(text: str):
    """All matches of the number pattern, from left to right."""
    at = _START.search(text)
    while at:
        m = _NUMBER.match(text, at.start())
        if m:
            yield m
        at = _START.search(text, m.end() if m else at.start() + 1)


def _mails(text: str):
    """(start, end) around each @, not overlapping; found from the @, so in linear time."""
    at, done = text.find("@"), 0
    while at >= 0:
        before, after = _BEFORE.search(text, max(done, at - LOCAL), at), _AFTER.match(text, at + 1)
        if before and after:
            yield before.start(), after.end()
            done = after.end()
        at = text.find("@", max(done, at + 1))


def candidates(text: str | None):
    """(start, end, kind) of all spans worth a vote, in order of their start; none overlap."""
    if not text:
        return
    mails = list(_mails(text)) if "@" in text else []
    spans = [(s, e, "email") for s, e in mails]
    k = 0
    for m in _numbers(text):  # both in order: each mail is passed once
        while k < len(mails) and mails[k][1] <= m.start():
            k += 1
        if k == len(mails) or m.end() <= mails[k][0]:
            spans.append((m.start(), m.end(), m.lastgroup))
    for s, e, kind in sorted(spans):
        while e > s + 1 and text[e - 1] in ".,;:!?-)" and not (text[e - 1] == ")" and "(" in text[s:e]):
            e -= 1
        yield s, e, kind


_SPAN = "doc_id long, start int, end int, kind string, votes array<byte>, features array<short>"


def _scan(batches):
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), C.each(b.column(1))):
            for s, e, kind in candidates(text):
                before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
                v = votes(kind, text[s:e], before, after)
                rows.append({"doc_id": doc, "start": s, "end": e, "kind": kind, "votes": v, "features": features(kind, text[s:e], before, after, v)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("votes", pa.list_(pa.int8())), ("features", pa.list_(pa.int16()))]))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, trust: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, reliability tables) by expectation-maximisation.

    Each labeler has, for either truth, a distribution over -1, 0 and +1.  A prior worth ``trust``
    of the corpus holds that a labeler with an opinion is right more often than not, which also
    keeps the two truths from swapping or from splitting a one-sided corpus.
    """
    n, k = counts.sum(), patterns.shape[1]
    one = np.stack([(patterns == x) for x in (-1, 0, 1)], 2).astype(float)  # pattern, voter, answer
    prior = np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]]) * trust * n  # truth, answer
    post = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    table = np.zeros((2, k, 3))
    for _ in range(rounds):
        for truth, q in ((0, 1 - post), (1, post)):
            table[truth] = np.einsum("p,pva->va", counts * q, one) + prior[truth]
        table /= table.sum(2, keepdims=True)
        share = (np.array([(counts * (1 - post)).sum(), (counts * post).sum()]) + trust * n / 2) / (n * (1 + trust))
        ll = np.einsum("pva,tva->pt", one, np.log(table)) + np.log(share)
        post = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -50, 50)))
    return post, table


def _logistic(rows: list[list[int]], y: np.ndarray, steps: int = 200, rate: float = 0.1, l2: float = 1e-4) -> np.ndarray:
    col, row = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, s0, s1 = (np.zeros(1 << FEATURE_BITS) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)), -30, 30)))
        g = np.bincount(col, (p - y)[row], len(w)) / len(rows) + l2 * w
        s0, s1 = 0.9 * s0 + 0.1 * g, 0.99 * s1 + 0.01 * g * g
        w -= rate * (s0 / (1 - 0.9**t)) / (np.sqrt(s1 / (1 - 0.99**t)) + 1e-8)
    return w


def find_pii(docs: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, start, end, kind, score) of the spans of personal data in every text.

    Offsets are code points, half open; kind is email, ip, card, ssn, phone or number; score is
    the final classifier's probability, at least ``accept``.  A null or empty text has no span, a
    document without one no row; a null doc_id stays null.  Equal rows give equal spans.  A text is
    searched whole in time linear in its length, however long and with or without spaces; of an
    address no more than LOCAL characters before its @ and HOST after it are taken.  Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spans = C.table(C.require(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _SPAN), "pii-spans")
    seen = spans.groupBy("votes").count().collect()  # at most 3^6 patterns
    if not seen:
        return spark.createDataFrame([], "doc_id long, start int, end int, kind string, score double")
    seen.sort(key=lambda r: tuple(r.votes))
    post, _ = estimate(np.array([list(r.votes) for r in seen], np.int8), np.array([r["count"] for r in seen], float))
    soft = {tuple(r.votes): p for r, p in zip(seen, post)}

    def train(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (str(r["doc_id"]), r["start"]))
        w = _logistic([r["features"] for r in rows], np.array([soft[tuple(r["votes"])] for r in rows]))
        np.save(out := io.BytesIO(), w)
        yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})

    some = spans.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(sample).repartition(1)
    model = spark.sparkContext.broadcast(np.load(io.BytesIO(bytes(some.mapInArrow(train, "model binary").first().model))))

    def judge(batches):
        w = model.value
        for b in batches:
            z = np.array([w[f].sum() for f in b.column(5).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(p, pa.float64())], names=[*b.schema.names[:4], "score"]).filter(pa.array(p >= accept))

    return spans.mapInArrow(judge, "doc_id long, start int, end int, kind string, score double")
