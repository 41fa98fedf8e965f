"""Operators on documents against brute force, with nulls, empty and odd texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from genoweave.llm import lines, mixing, ppm, quality, queries, simhash, subwords, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, size string, key string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = "This line is shared by many documents"


def _texts():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(200)] + ["É", "naïve", "漢字", "a\tb", "x\x0by"]
    base = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 60, 24)]
    odd = [None, "", " ", "\n\n", "one", "Two words", "  lead and trail  ", SHARED, SHARED.upper() + " \n" + SHARED, f"{SHARED}\nmore\n{SHARED}", "same line " * 8 + "\n" + "same line " * 8, "a b c d e a b c d e f", "long " * 30_000]
    near = [base[3] + " tail" if base[3] else "tail", base[3]]
    return [*base, *odd, *near, *odd[-4:]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", 0, "clash", "clash", "clash", "clash") for k, t in enumerate(_texts())]
    return spark.createDataFrame(rows + [rows[5]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _all(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_statistics(docs):
    got = collections.Counter(tuple(r) for r in quality.text_statistics(docs).select("doc_id", *quality.COUNTS).collect())
    want = collections.Counter()
    for i, t in _all(docs):
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(cover))] += 1
    assert got == want


def test_rules_find_a_planted_rule_and_spare_the_rest():
    rng = np.random.default_rng(0)
    table = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (table["a"] > 0.8) & (table["b"] <= 0.3)
    rules = quality.learn(table, bad)
    hit, free = np.zeros(3000, bool), np.ones(3000, bool)
    for r in rules:
        hit |= r.rejects & free & r.holds(table)
        free &= ~r.holds(table)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * 3000
    assert quality.learn(table, np.zeros(3000, bool)) == [] and quality.learn(table, np.ones(3000, bool)) == []


def test_a_list_needs_its_keeping_rules():
    """Texts are bad where ``b`` is low, but not in a region of ``a`` that the rejecting rules alone can't spell out exactly."""
    rng = np.random.default_rng(1)
    table = {"a": rng.random(6000), "b": rng.random(6000)}
    good = (table["b"] > 0.5) | (np.floor(table["a"] * 12) % 2 == 0)
    rules = quality.learn(table, ~good, most_rules=30)
    first = np.zeros(6000, int)
    for k, r in enumerate(rules, 1):
        first = np.where((first == 0) & r.holds(table), k, first)
    rejected = np.isin(first, [k for k, r in enumerate(rules, 1) if r.rejects])
    assert (rejected == ~good).mean() > 0.9 and rules[-1].rejects


def test_rule_order_in_the_expression(spark):
    rules = [quality.Rule((quality.Condition("words", True, 5.0),)), quality.Rule((quality.Condition("words", True, 2.0),))]
    out = spark.createDataFrame([(9,), (4,), (1,)], "n_words long").select(quality.rule_expression(rules)).collect()
    assert [r[0] for r in out] == [1, 2, 0]


def test_quality_on_labels(spark, sf, empty):
    out = queries.op2_quality_rules(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right = out.join(labels, "doc_id").select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.85
    assert quality.judge(empty, []).count() == 0 and quality.learn_from(empty, spark.createDataFrame([], "doc_id long, quality int")) == []


def _segments(scores):
    """All maximal scoring segments by their definition: recursively the best subarray, then both sides."""
    out = []

    def go(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12 or abs(total - best[2]) <= 1e-12 and j - i < best[1] - best[0]):
                    best = (i, j, total)
        if best:
            go(a, best[0])
            out.append(best)
            go(best[1] + 1, b)

    go(0, len(scores))
    return out


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = np.where(rng.random(25) < 0.4, rng.random(25) * 3, -0.7)
        special = np.flatnonzero(scores != -0.7)
        got = toxicity.segments(special, scores[special], -0.7)
        want = _segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_toxicity_on_planted_words(spark, empty):
    rng = np.random.default_rng(3)
    words, bad = [f"word{k}" for k in range(400)], ["vile", "foul", "nasty"]
    rows, labels = [], []
    for k in range(600):
        t = list(rng.choice(words, 60))
        toxic = k % 5 == 0
        if toxic:
            for w in rng.choice(bad, 4):
                t.insert(20 + int(rng.integers(6)), w.upper() + "!")
        rows.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (9999, "")], "doc_id long, text string")
    held = toxicity.held_out()
    model = toxicity.train(docs.where(~held), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").where(~held))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(out[k].predicted == (k % 5 == 0) for k in unseen) and out[9999].predicted == out[None].predicted == 0
    assert all(out[k].first_word < 31 and out[k].last_word >= 20 for k in unseen if k % 5 == 0)
    nothing = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, nothing).collect()) and toxicity.score(empty, nothing).count() == 0


@pytest.fixture(scope="module")
def pieces_model():
    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def test_subwords_against_the_library(docs, empty, pieces_model):
    more = ["▁x ▁", " " * 75 + "b", "\t\r\n x", "aaaa" * 50, "ab" * 700, "<s> </s> <unk> <0x0A>", "\x00 \U0010ffff 🎉🎉", "�", " " * 33 + "\n" + " " * 100]
    frame = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(1000 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    out = subwords.tokenize(frame, queries.model_path(), keep=("doc_id", "text")).collect()
    for r in out:
        ids = [1, *pieces_model.encode(r.text or ""), 2]
        assert r.ids == ids and r.decoded == pieces_model.decode(ids)
    digests = {r.doc_id: r for r in subwords.token_digests(frame, queries.model_path()).collect()}
    for r in out:
        d = digests[r.doc_id]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())
    assert subwords.tokenize(empty, queries.model_path()).count() == 0


def test_decode_of_any_ids(pieces_model):
    v, rng = subwords.load(queries.model_path()), np.random.default_rng(4)
    for _ in range(300):
        ids = rng.choice([0, 1, 2, 13, 203, 229, 132, 35, 259, 29871, 15043], int(rng.integers(0, 8))).tolist()
        assert subwords.decode(np.array(ids, np.int64), np.array([0, len(ids)]), v) == [pieces_model.decode(ids)]


def _deduped(rows):
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                holders[k].add(i)
    goes = lambda i, x: len(holders[key(x)]) >= 3 and i != max(holders[key(x)])
    return collections.Counter((i, len(t.split("\n")), sum(goes(i, x) for x in t.split("\n")), "\n".join(x for x in t.split("\n") if not goes(i, x))) for i, t in rows)


def test_line_dedup(docs, empty):
    want = _deduped(_all(docs))
    for batches in (1, 6):
        assert collections.Counter(map(tuple, lines.dedup_lines(docs, batches).collect())) == want
    assert lines.dedup_lines(empty).count() == 0


def test_line_dedup_of_many_lost_lines(spark):
    text = "\n".join(f"a line that is long enough number {k}" for k in range(1500))
    frame = spark.createDataFrame([(1, text), (2, text), (3, text + "\nown"), (None, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in lines.dedup_lines(frame).collect()} == {1: 1500, 2: 1500, 3: 0, None: 1500}


def test_lines_of_repeated_ids_count_once(spark):
    line, other = "a line that is long enough to count", "another line that is long enough too"
    rows = [(1, f"{line}\n{other}"), (1, line), (2, f"{line}\n{other}"), (3, f"own\n{other}"), (3, other)]
    for batches in (1, 3):
        out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches)
        assert collections.Counter(map(tuple, out.collect())) == _deduped(rows)


def test_runs_compact_and_anti_join(spark, docs):
    held = lines.batch_lines(lines.with_batch(docs.select("doc_id", "text"), 5)).distinct()
    runs, _ = lines.build_runs(held, batches=5)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    fresh = spark.createDataFrame([(1, SHARED), (2, "a line that no document has had before")], "doc_id long, text string")
    assert [r.doc_id for r in runs.unseen(lines.batch_lines(fresh)).collect()] == [2]


def test_runs_meet_without_exchange_or_sort(spark, docs):
    from genoweave.plans.durable import sorted_scans

    with sorted_scans(spark):
        held = lines.batch_lines(lines.with_batch(docs.select("doc_id", "text"), 4)).distinct()
        runs, first = lines.build_runs(held, batches=4)
        assert len(runs.runs()) == 1
        for frame in (first, lines.merge(runs.runs()[0], runs.runs()[0])):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and ("SortMergeJoin" not in plan or "Sort [" not in plan)


def _fingerprint(t):
    w = WORD.findall(t.translate(LOW))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, empty):
    prints = {i: _fingerprint(t) for i, t in _all(docs)}
    groups = _components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == groups[r.doc_id] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(25):
            v = s
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    want = _components({v: v for v in values})
    for block in (1 << 13, 4):  # the second deals almost every block out as tile pairs
        links = [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in simhash.links_between(frame, block).collect()]
        assert all((a ^ b).bit_count() <= 3 or want[a] == want[b] for a, b in links)
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]  # noqa: B023
            return x

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {v: find(v) for v in values} == want


def test_mixing(docs, empty):
    got = mixing.mix_sizes(docs).collect()
    sizes = collections.Counter(r.size for r in got)
    assert sizes == collections.Counter(len(WORD.findall(t)) for _, t in _all(docs))
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    total = sum(r.size for r in got)
    by = {(r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in by) - total) < 1e-6 * total and all(t <= 3 * s + 1e-6 for t, s in by)
    assert sorted(map(tuple, mixing.mix_sizes(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    assert mixing.mix_sizes(empty).count() == 0


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5], [0, 10, 3000, 2], [7]])
def test_targets_against_the_loop(spark, sizes):
    frame = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, __size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    weight = {k: 1 + k % 3 for k in range(len(sizes))}
    stopped, target = set(), {}
    while True:
        rest = sum(sizes) - sum(3 * sizes[k] for k in stopped)
        free = [k for k in weight if k not in stopped]
        target = {k: 3.0 * sizes[k] for k in stopped} | {k: rest * weight[k] / sum(weight[j] for j in free) for k in free}
        above = {k for k in free if target[k] > 3 * sizes[k] + 1e-9}
        if not above:
            break
        stopped |= above
    assert all(abs(got[f"s{k}"] - t) < 1e-6 for k, t in target.items())


def test_mix_repeats_rows(spark):
    rows = [(k, "w " * 10, "a" if k < 3 else "b") for k in range(60)] + [(99, None, "b")]
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    counts = collections.Counter(r.doc_id for r in out.collect())
    assert all(counts[k] == 3 for k in range(3)) and counts[99] == 1 and out.columns == ["doc_id", "text", "source"]


def _law(counts, context, byte, order):
    """Escapes and exclusion by the book for one byte after one context."""
    mass, excluded = 1.0, set()
    for k in range(order, -1, -1):
        seen = counts.get((k, context[len(context) - k :]))
        if seen is None:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        if not left:
            continue
        total = sum(left.values()) + len(left)
        if byte in left:
            return mass * left[byte] / total
        mass *= len(left) / total
        excluded |= set(left)
    return mass / (256 - len(excluded))


def test_trie_against_the_book(spark):
    train = ["abracadabra", "abrakadabra", "cadabra", ""]
    frame = spark.createDataFrame([(t,) for t in train], "text string")
    order = 3
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        data = bytes([0xFE] * order) + t.encode() + b"\xff"
        for p in range(order, len(data)):
            for k in range(order + 1):
                counts[k, data[p - k : p]][data[p]] += 1
    trie = ppm.train(ppm.count_corpus(frame, order), order)
    for t in ["abra", "", "zebra", "cad"]:
        data = bytes([0xFE] * order) + t.encode() + b"\xff"
        want = sum(math.log10(_law(counts, data[p - order : p], data[p], order)) for p in range(order, len(data)))
        assert abs(ppm.log10_probabilities(pa.array([t]), trie)[0] - want) < 1e-4
    assert np.allclose((10.0 ** trie.law.astype(float)).sum(1), 1, atol=1e-5)


def test_lm_scores(docs, empty):
    out = ppm.score_documents(docs).collect()
    texts = dict(_all(docs))
    train = collections.Counter()
    for i, t in _all(docs):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(WORD.findall(t.translate(LOW)))
            train["\0"] += 1
    total, kinds = sum(train.values()), len(train)
    for r in out:
        tokens = [*WORD.findall(texts[r.doc_id].translate(LOW)), "\0"]
        base = sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[w] > 0 for w in tokens), total)
        assert abs(base - r.base_score) < 1e-6 * max(1, -base) and r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert ppm.score_documents(empty).count() == 0


@pytest.mark.parametrize(("part", "requests", "many"), [(ppm.PART, ppm.REQUESTS, ppm.LAWS), (4000, 1000, 33)])
def test_no_context_is_lost(spark, monkeypatch, part, requests, many):
    """More contexts than the trie once held; every document's score by the book, held-out ones too, in many parts and lots and with hot ends."""
    for name, value in (("PART", part), ("REQUESTS", requests), ("LAWS", many)):
        monkeypatch.setattr(ppm, name, value)
    rng = np.random.default_rng(9)
    rows = [(k, "".join(chr(97 + c) for c in rng.integers(0, 26, 400))) for k in range(60)]
    train = [t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        data = bytes([0xFE] * 5) + t.encode() + b"\xff"
        for p in range(5, len(data)):
            for k in range(6):
                counts[k, data[p - k : p]][data[p]] += 1
    assert len(counts) > 3 << 14
    out = {r.doc_id: r.score for r in ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, t in rows:
        data = bytes([0xFE] * 5) + t.encode() + b"\xff"
        want = sum(math.log10(_law(counts, data[p - 5 : p], data[p], 5)) for p in range(5, len(data)))
        assert abs(out[k] - want) < 1e-3, (k, out[k], want)
