"""Suffix-array decontamination against plain loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from genoweave.llm import suffixes


@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_suffix_array_is_sorted(runs):
    text = np.array([c for run in runs for c in [*run, 0]], np.int32)
    order = suffixes.suffix_array(text, 100)
    ends = [text[p : p + 1 + int(np.argmin(text[p:]))].tolist() for p in order]
    assert sorted(order.tolist()) == np.flatnonzero(text).tolist()
    assert ends == sorted(ends)


def _brute(documents, items, window):
    """Per document: words, hit words, item ids, longest match; by comparing every window at every place."""
    out = []
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def words(text):
        return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (text or "").translate(table)).split(" ")

    split = [(i, [w for w in words(t) if w]) for i, t in items]
    for text in documents:
        d = [w for w in words(text) if w]
        hit, ids, longest = set(), set(), 0
        for i, b in split:
            n = min(window, len(b))
            for j in range(len(b) - n + 1 if n else 0):
                for k in range(len(d) - n + 1):
                    if d[k : k + n] == b[j : j + n]:
                        hit |= {*range(k, k + n)}
                        ids.add("" if i is None else str(i))
                        m = n
                        while k + m < len(d) and j + m < len(b) and d[k + m] == b[j + m]:
                            m += 1
                        longest = max(longest, m)
        out.append((len(d), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), longest))
    return out


def test_report_against_every_window(spark):
    rng = random.Random(5)
    words = [f"W{k}" for k in range(12)] + ["é", "Übung"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 6, 15])))) for k in range(12)]
    items += [(3, "alpha beta gamma delta epsilon"), (None, "eins zwei drei"), (99, None), (98, "!?"), (5, items[5][1]), (77, items[0][1])]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(40)]
    texts += [None, "", "...", "eins, ZWEI; drei", "alpha beta GAMMA delta epsilon zeta", " ".join([items[4][1]] * 3), texts[0], "drei"]
    docs = spark.createDataFrame([(k % 45, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, n_words string, place int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, size in ((4, 1 << 20), (4, 200)):
        found = suffixes.find_matches(docs, bench, window, keep=("doc_id", "place"), block_bytes=size)
        got = [
            (r.n_words, sum(s.last - s.first + 1 for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r.spans) > 0, r.longest)
            for r in sorted(found.collect(), key=lambda r: r.place)
        ]
        assert got == _brute(texts, items, window)
    clean = suffixes.decontaminate(docs, bench, 4)
    assert clean.columns == docs.columns
    assert sorted(r.place for r in clean.collect()) == [k for k, r in enumerate(_brute(texts, items, 4)) if not r[4]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = suffixes.decontamination_report(docs, bench.limit(0)).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(1, 3, 0, 0, False)]
    assert suffixes.decontamination_report(docs.limit(0), bench).count() == 0


def test_long_texts_and_copies():
    """A text of 400,000 words that repeats one passage, and an item as long as 20,000 words."""
    rng = random.Random(1)
    passage = [f"p{k}" for k in range(30)]
    item = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    text = " ".join((passage + ["other"]) * 13_000 + item)
    block = suffixes.test_block(["a", "b"], [" ".join(passage), " ".join(item)])
    words, offsets = suffixes.item_words(pa.array([text, "none", " ".join(item[:50])]))
    import pyarrow.compute as pc

    codes = np.asarray(pc.fill_null(pc.index_in(words, block.vocabulary), -1)).astype(np.int32) + 1
    found = suffixes.search_shard(codes, offsets, block)
    first, end = suffixes._spans(found.places, found.lengths, len(words))
    assert (end - first).sum() == 13_000 * 30 + 20_000 + 50
    assert found.longest.max() == 20_000
    assert sorted(zip(found.texts.tolist(), found.items.tolist(), strict=True)) == [(0, 0), (0, 1), (2, 1)]
