"""Spelling variants against comparing all words."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genoweave.llm import spelling


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _counts(rows, least=6):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return found


def _variants(n, times=5):
    form, out = {}, {}
    for w in n:
        near = [v for v in n if _near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
        out[w] = len(near)
    root = {}
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], n[w], out[w], n[form[w]] if form[w] else None) for w in n}


@given(st.binary(max_size=30), st.binary(max_size=30))
@settings(deadline=None)
def test_joined_crc32(a, b):
    got = spelling.joined_crc32(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]))
    assert int(got[0]) == zlib.crc32(a + b)


def test_counted_against_expressions():
    rng = random.Random(2)
    words = ["Straße", "überall", "ABCDEFG", "abcdéfg", "motion's", "naïveté", "x" * 40, "×÷Àÿéè", "日本語abcdefg", "ĀĀabcdefgh"]
    rows = [(k if k % 7 else None, " ".join(rng.choices(words, k=rng.randrange(80)))) for k in range(300)] + [(1, None), (2, "")]
    got, n = spelling.counted([None if i is None else str(i) for i, _ in rows], pa.array([t or "" for _, t in rows]))
    assert dict(zip(got.to_pylist(), n.tolist(), strict=True)) == _counts(rows)


@pytest.mark.parametrize("alphabet", ["ab", "abc", "abcdefghé"])
def test_pairs_of_a_table(spark, alphabet):
    """Every pair once, in groups of any size, among them words of one letter and very long ones."""
    rng = random.Random(len(alphabet))
    found = {"".join(rng.choices(alphabet, k=rng.randrange(6, 10))) for _ in range(250)} | {alphabet[0] * k for k in range(6, 20)} | {"z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499}
    words = spark.createDataFrame([(w, rng.randrange(5, 9)) for w in sorted(found)], "word string, n long")
    for most in (2048, 4):
        rows = spelling.near_words(words, most=most).groupBy("word").agg({"n_near": "sum"}).collect()
        assert {r[0]: r[1] for r in rows} == {w: k for w in found if (k := sum(_near(w, v) for v in found))}


def test_variants_against_all_pairs(spark):
    rng = random.Random(3)
    letters = "abcdé"
    frequent = ["".join(rng.choices(letters, k=rng.randrange(6, 9))) for _ in range(25)]

    def misspelt(word):
        at = rng.randrange(len(word))
        return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])

    often = {w: 2000 // (k + 1) for k, w in enumerate(frequent)}
    for w in frequent:
        for _ in range(5):
            often.setdefault(misspelt(misspelt(w)), rng.randrange(3, 12))
            often.setdefault(misspelt(w), rng.randrange(3, 40))
    pool = [w for w, k in often.items() for _ in range(k)]
    rng.shuffle(pool)
    rows = [(k, " ".join(pool[k * 40 : k * 40 + 40]).upper() if k % 2 else ", ".join(pool[k * 40 : k * 40 + 40])) for k in range(len(pool) // 40)]
    rows += [(None, rows[0][1]), (3, rows[1][1]), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n long, word string")
    n = {w: k for w, k in _counts(rows).items() if k >= 5}
    got = {tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == _variants(n)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_long_chains_of_forms(spark):
    links = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(20)] + [("a", "w05")], "word string, form string")
    assert {tuple(r) for r in spelling.last_forms(links).collect()} == {(f"w{k:02}", "w20") for k in range(20)} | {("a", "w20")}
