"""Secret scanning with a random forest that removes false positives.

Patterns propose findings; a forest, trained from labelled findings, judges each by its length,
the transitions between its characters, how much of it a dictionary covers, the path it was found
under and the words beside it.
"""

from __future__ import annotations

import bisect
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ACCEPT = 0.5
TREES, DEPTH, LEAF = 40, 9, 3
CONTEXT = 40
_KEY = r"(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
#: From a key word on; the letters before it belong to the key too, but decide nothing.  What is
#: left of a key to its sign is bounded, so that a run without spaces costs linear time.
_KEYED = re.compile(_KEY + r"\w{0,64}[\"']?\s{0,2}(?::=|=>|=|:)\s{0,2}[\"']?(?P<value>[^\s\"'<>(){}\[\],;]{6,})", re.I)
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*\d)(?=[\d+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|sk_live_|xox[bp]-|AIza|glpat-)[A-Za-z0-9_-]{10,}")
_KEY_PARTS = ("passw", "pwd", "secret", "token", "api", "access", "private", "credential", "auth")


def _may_have_key(text: str) -> bool:
    """False only where no key word can match; two letters fold to ASCII in patterns but not in lower case."""
    if not ("=" in text or ":" in text):
        return False
    low = text.lower()
    return any(k in low for k in _KEY_PARTS) or "\u017f" in text or "\u212a" in text


_RUN = re.compile(r"[A-Za-z0-9+/_-]{16}")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "xoxb-", "xoxp-", "AIza", "glpat-")
_DICTIONARY = sorted(
    "password passwd change changeme example sample test dummy fake placeholder your here insert token secret key value default admin user username root login none null true false string todo replace enter the and for with that this from version release build file path name data config setting hello world demo foo bar baz qwerty letmein welcome abc xxx key1 value1 mypassword api auth access private public client server local host index content image style script module function class return object array number license apache general".split(),
    key=lambda w: (-len(w), w),
)
_WORDS = re.compile("|".join(map(re.escape, _DICTIONARY)), re.I)
_SOFT_PATH = re.compile(r"test|example|sample|doc|fixture|mock|demo", re.I)
_SOFT_WORD = re.compile(r"\b(?:example|sample|dummy|fake|placeholder|test|commit|sha\d*|md5|checksum|hash|digest|uuid|revision|version|e\.g)\b", re.I)
_HARD_WORD = re.compile(_KEY, re.I)
_VOWELS = set("aeiouáéíóúäöüèê")
FEATURES = ("length", "digit", "upper", "lower", "other", "transitions", "case_flips", "entropy", "distinct", "longest_run", "steps", "vowels", "dictionary", "hex", "known", "keyed", "soft_path", "soft_word", "hard_word", "assigned")


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(value: str, before: str, after: str, path: str | None) -> list[float]:
    n = len(value)
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    used, at, counts = np.unique(code, return_inverse=True, return_counts=True)
    chars = [chr(c) for c in used]
    kinds = np.array([_class(c) for c in chars])[at]
    a, b = kinds[:-1], kinds[1:]
    ends = np.flatnonzero(np.concatenate([np.diff(code) != 0, [True]]))
    best = int(np.diff(ends, prepend=-1).max())
    letters = int(counts[[c.isalpha() for c in chars]].sum())
    vowels = int(counts[[c.lower() in _VOWELS for c in chars]].sum())
    covered = sum(len(m.group()) for m in _WORDS.finditer(value))
    share = counts / n
    return [
        n, *(np.bincount(kinds, minlength=4) / n),
        float((a != b).sum()) / max(1, n - 1), float((((a == 1) & (b == 2)) | ((a == 2) & (b == 1))).sum()) / max(1, n - 1),
        float(-(share * np.log2(share)).sum()), len(counts) / n, best, float((np.abs(np.diff(code)) <= 1).sum()) / max(1, n - 1),
        vowels / max(1, letters), covered / n,
        float(re.fullmatch(r"[0-9a-f]+", value) is not None), float(_KNOWN.match(value) is not None),
        float(_KEYED.search(before[-24:] + value) is not None), float(_SOFT_PATH.search(path or "") is not None),
        float(_SOFT_WORD.search(before) is not None), float(_HARD_WORD.search(before) is not None), float(before.rstrip("\"' ")[-1:] in ("=", ":")),
    ]


class Forest:
    """Random forest of CART trees: bootstrap samples, sqrt(features) tried at each split."""

    def __init__(self, trees: list[np.ndarray]):
        self.trees = trees

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 5) -> "Forest":
        rng = np.random.default_rng(seed)
        tried = max(1, int(math.sqrt(x.shape[1])))
        out = []
        for _ in range(trees):
            nodes: list[list[float]] = []  # feature (-1: leaf), cut, left, right, probability

            def grow(rows: np.ndarray, left: int) -> int:
                me = len(nodes)
                p = float(y[rows].mean())
                nodes.append([-1, 0.0, 0, 0, p])
                if left == 0 or len(rows) < 2 * leaf or p in (0.0, 1.0):
                    return me
                best = (0.0, None, None)
                for f in rng.permutation(x.shape[1])[:tried]:
                    by = rows[np.argsort(x[rows, f], kind="stable")]
                    v, t = x[by, f], np.cumsum(y[by])
                    k = np.arange(1, len(by))
                    ok = (v[1:] > v[:-1]) & (k >= leaf) & (len(by) - k >= leaf)
                    if not ok.any():
                        continue
                    pl, pr = t[:-1] / k, (t[-1] - t[:-1]) / (len(by) - k)
                    gain = p * (1 - p) - (k * pl * (1 - pl) + (len(by) - k) * pr * (1 - pr)) / len(by)
                    i = int(np.argmax(np.where(ok, gain, -1)))
                    if gain[i] > best[0] + 1e-12:
                        best = (gain[i], int(f), float((v[i] + v[i + 1]) / 2))
                if best[1] is None:
                    return me
                go = x[rows, best[1]] <= best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][2] = grow(rows[go], left - 1)
                nodes[me][3] = grow(rows[~go], left - 1)
                return me

            grow(rng.integers(0, len(y), len(y)), depth)
            out.append(np.array(nodes))
        return Forest(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = t[at, 0].astype(np.int64)
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(f < 0, at, down)
            total += t[at, 4]
        return total / max(1, len(self.trees))


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, secret) - a made-up labelled set to show the method, half secrets:
    credentials in common formats against placeholders, words, identifiers, digests and numbers.
    Findings that people have judged are passed to :func:`fit_forest` in the same form."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syl = "the re en on ti an er ha in ou es le de che ung ra la co mi vo pa tri".split()
    natural = lambda k: "".join(rng.choice(syl) for _ in range(k))
    filler = lambda: " ".join(natural(rng.randint(1, 4)) for _ in range(5))
    keys = ["password", "token", "secret", "api_key", "auth_token", "passwd", "client_secret", "access_key"]
    assign = lambda: rng.choice(keys) + rng.choice(["=", " = ", ": ", ' = "', '="', ": '"])
    paths = ["lib/core", "crawl", "mail", "app/settings.py", "deploy/prod.env", "main.tf", "web", "notes"]
    soft = ["tests/test_login.py", "docs/guide.md", "examples/demo.py", "fixtures/data.json"]
    out = []
    for i in range(n):
        secret = i % 2
        if secret:
            kind = rng.randint(0, 5)
            value = [lambda: pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64])), lambda: pick(alnum, rng.randint(16, 48)), lambda: rng.choice(["AKIA", "ASIA"]) + pick(alnum[:26] + "0123456789", 16), lambda: rng.choice(["ghp_", "sk_live_", "glpat-"]) + pick(alnum, rng.randint(20, 36)), lambda: pick(alnum + "+/", rng.randint(24, 44)) + "=", lambda: pick(alnum + "!#%&*", rng.randint(8, 16))][kind]()
            before = filler() + " " + (assign() if kind not in (2, 3) or rng.random() < 0.5 else "")
            path = rng.choice(paths)
        else:
            kind = rng.randint(0, 8)
            value = [
                lambda: rng.choice(["your_token_here", "changeme", "password123", "example_secret", "xxxxxxxxxxxxxxxx", "************", "<token>", "insert-key-here", "test_password", "my_secret_value", "${TOKEN}", "os.environ", "placeholder"]),
                lambda: natural(rng.randint(4, 9)), lambda: "_".join(natural(rng.randint(1, 3)) for _ in range(3)) + rng.choice(["", "_1", "_v2"]),
                lambda: natural(rng.randint(5, 9)).upper() + rng.choice(["", "1", "2024"]), lambda: pick("0123456789", rng.randint(9, 19)),
                lambda: pick(hexa, rng.choice([32, 40, 64])), lambda: "/".join(natural(2) for _ in range(4)) + str(rng.randint(1, 99)),
                lambda: "abcdefghijklmnopqrstuvwxyz0123456789"[: rng.randint(12, 30)], lambda: rng.choice("abcx01") * rng.randint(8, 24),
            ][kind]()
            before = filler() + " " + (rng.choice(["commit ", "sha256: ", "md5 ", "checksum ", "digest: ", "uuid "]) if kind == 5 else assign() if rng.random() < 0.5 else "")
            path = rng.choice(soft if rng.random() < 0.3 else paths)
        out.append((value, before[-CONTEXT:], " " + filler()[:CONTEXT], path, secret))
    return out


def fit_forest(findings: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    rows = labelled_findings() if findings is None else findings
    return Forest.fit(np.array([describe(v, b, a, p) for v, b, a, p, _ in rows]), np.array([y for *_, y in rows], float))


def findings(text: str | None):
    """(start, end, rule) of proposed findings; where rules overlap the first to match stays."""
    if not text:
        return []
    # each rule is passed over where the text lacks what every match of that rule has
    found = [(m.start(), m.end(), "known") for m in _KNOWN.finditer(text)] if any(p in text for p in _PREFIXES) else []
    found += [(m.start("value"), m.end("value"), "keyed") for m in _KEYED.finditer(text)] if _may_have_key(text) else []
    found += [(m.start(), m.end(), "long") for m in _LONG.finditer(text)] if _RUN.search(text) else []
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []
    for s, e, rule in found:
        while e > s + 1 and text[e - 1] in ".,;:!?":
            e -= 1
        at = bisect.bisect_left(starts, s)
        # disjoint spans in order: only the neighbours can overlap
        if (at == 0 or out[at - 1][1] <= s) and (at == len(out) or out[at][0] >= e):
            starts.insert(at, s)
            out.insert(at, (s, e, rule))
    return out


def scan_secrets(docs: DataFrame, forest: Forest | None = None, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, start, end, rule, score) of the secrets in every text; ``source`` is the path.

    Offsets are code points, half open; score is the forest's probability, at least ``accept``.
    A null or empty text has no finding, a document without one no row; a null source is an empty
    path; a null doc_id stays null.  Equal rows give equal findings.  A text is scanned whole in
    time linear in its length, however long and with or without spaces.  Other columns are ignored;
    an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest or fit_forest())

    def run(batches):
        for b in batches:
            rows, x = [], []
            for doc, text, path in zip(b.column(0).to_pylist(), C.each(b.column(1)), b.column(2).to_pylist()):
                for s, e, rule in findings(text):
                    rows.append((doc, s, e, rule))
                    x.append(describe(text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT], path))
            p = model.value.predict(np.array(x)) if x else np.zeros(0)
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(p, pa.float64())], names=["doc_id", "start", "end", "rule", "score"]).filter(pa.array(p >= accept, pa.bool_()))

    src = C.require(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))
    return src.mapInArrow(run, "doc_id long, start int, end int, rule string, score double")
