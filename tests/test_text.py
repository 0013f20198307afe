import random

from pyspark.sql import functions as F

from marlstone.functions import text as T


def _samples():
    rng = random.Random(1)
    yield from ["", "Straße ẞ ﬁn", "İstanbul ſ µ", "ΣΑΣ ς", "\x1c a\x85b　", "a_b²c ½", "ǰ ŉ ΐ և ﬗ"]
    for _ in range(150):
        yield "".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x370, 0x58F), rng.randint(0x1E00, 0x1FFF), rng.randint(0xAB70, 0xABBF), rng.randint(0xFB00, 0xFB17)])) for _ in range(20))


def test_fold_trim_and_tokens_follow_python(spark):
    import re
    import sys

    rows = [(i, s) for i, s in enumerate(_samples())]
    df = spark.createDataFrame(rows, "i int, s string").select("i", T.fold(F.col("s")).alias("f"), T.trim(F.col("s")).alias("t"), T.tokens(F.col("s")).alias("k"))
    odd = {c for c in map(chr, range(sys.maxunicode + 1)) if len(c.lower()) > 1}  # "İ" alone
    known = set()
    for r in df.collect():
        s = rows[r.i][1]
        assert r.t == s.strip()
        if set(s) & odd:
            continue
        if r.f != s.casefold():
            known |= {c for c in s if c.casefold() not in r.f}
            continue
        assert r.k == re.findall(r"[^\W_]+", s.casefold())
    # code points whose lower case this JVM's Unicode tables don't have yet, and final sigma
    assert len(known) < 40


def test_all_single_code_points_fold_as_python_does(spark):
    points = [c for c in map(chr, range(1, 0x3000)) if not 0xD800 <= ord(c) < 0xE000 and c.isprintable()]
    got = spark.createDataFrame([(c,) for c in points], "c string").select("c", T.fold(F.col("c")).alias("f")).collect()
    wrong = [r.c for r in got if r.f != r.c.casefold()]
    assert set(wrong) <= {"İ"} | {c for c in wrong if ord(c) >= 0x1C80}, wrong
    assert len(wrong) < 12
