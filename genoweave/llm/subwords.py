"""SentencePiece encoding and decoding with vectorised merge rounds.

Each batch is cut into words that no merge can span; the distinct ones become flat
symbol arrays, and every round merges, in all words at once, the leftmost pair of
least rank, until no word has a pair left.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import pieces, raw, texts_of

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.int64(1 << 40)


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model file."""

    ids: dict[str, int]
    rank: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    pair_ranks: np.ndarray
    symbols: dict[str, int]
    symbol_piece: np.ndarray
    byte_ids: np.ndarray
    begin: int
    end: int
    unknown: int
    run: int
    breaks_lines: bool
    piece_bytes: np.ndarray
    piece_offsets: np.ndarray
    is_byte: np.ndarray
    is_silent: np.ndarray


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read a model of the BPE kind with byte fallback, no normalisation and a leading space."""
    from sentencepiece import sentencepiece_model_pb2 as formats

    model = formats.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with byte fallback is needed")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models that leave the text as it is and add one leading space")
    if any(p.type in (_USER, _UNUSED) for p in model.pieces):
        raise ValueError("models with user-defined or unused pieces are not supported")
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece has a space after a letter")
    levels = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces if p.type == _NORMAL}, reverse=True))}
    rank = np.array([levels.get(p.score, 0) for p in model.pieces], np.int64)
    # Symbols: every character of a piece and every piece has a number; pieces keep their id.
    symbols = dict(ids)
    for p in ids:
        for c in p:
            symbols.setdefault(c, len(model.pieces) + len(symbols))
    names = sorted(set(symbols.values()))
    dense = {old: k for k, old in enumerate(names)}
    symbols = {s: dense[v] for s, v in symbols.items()}
    symbol_piece = np.full(len(names) + 1, -1, np.int64)
    for p, i in ids.items():
        symbol_piece[symbols[p]] = i
    keys, made, order = [], [], []
    width = len(names) + 1
    for p, i in ids.items():
        for k in range(1, len(p)):
            a, b = symbols.get(p[:k]), symbols.get(p[k:])
            if a is not None and b is not None:
                keys.append(a * width + b)
                made.append(symbols[p])
                order.append(rank[i])
    by_key = np.argsort(np.array(keys, np.int64))
    byte_ids = np.zeros(256, np.int64)
    for i, p in enumerate(model.pieces):
        if p.type == _BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
    shown = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
    begin, end, unknown = (next(i for i, p in enumerate(model.pieces) if p.piece == x) for x in ("<s>", "</s>", "<unk>"))
    shown[unknown] = (model.trainer_spec.unk_surface or " ⁇ ").encode()
    spaces = [len(p) for p in ids if set(p) == {SPACE} and len(p) > 1]
    run = max(spaces, default=0)
    worst = max(levels.values())
    plain = all(rank[ids[SPACE * n]] == worst for n in spaces) and sum(1 for p in ids if len(p) > 1 and rank[ids[p]] == worst) == len(spaces)
    vocabulary = Vocabulary(
        ids, rank, np.array(keys, np.int64)[by_key], np.array(made, np.int64)[by_key], np.array(order, np.int64)[by_key], symbols, symbol_piece, byte_ids, begin, end, unknown, 0,
        not any("\n" in p for p in ids), np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in shown])]).astype(np.int64),
        np.array([p.type == _BYTE for p in model.pieces]), np.array([p.type == _CONTROL for p in model.pieces]),
    )
    # A long run of spaces goes to pieces of the longest run from the left, if the model does so with a few of them.
    if plain and run > 1:
        tokens, _ = encode_words([SPACE * (3 * run)], vocabulary)
        if tokens.tolist() == [ids[SPACE * run]] * 3:
            vocabulary.run = run
    return vocabulary


def _pairs(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rank and symbol of each pair's merge, rank ``_NONE`` where there is none."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = left * len(v.symbol_piece) + right
    at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
    hit = v.pair_keys[at] == key
    return np.where(hit, v.pair_ranks[at], _NONE), np.where(hit, v.pair_ids[at], -1)


def _symbols_of(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol of each character (the last number where it has none), its code point, and each word's first."""
    joined = "".join(words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, back = np.unique(points, return_inverse=True)
    none = len(v.symbol_piece) - 1
    table = np.array([v.symbols.get(chr(c), none) for c in distinct] or [none], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return table[back] if len(points) else np.zeros(0, np.int64), points, starts


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words in a row, and the offset of each word's first.

    In a round, every word merges all leftmost occurrences of its best pair that
    don't overlap. Where such a merge makes a pair of the same or a better rank, that
    pair would have gone before the other occurrences, so the word then merges its
    first occurrence alone. Words without a pair leave the working arrays.
    """
    symbol, points, starts = _symbols_of(words, v)
    word = np.repeat(np.arange(len(words)), np.diff(starts))
    place = np.arange(len(symbol))
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def joint(symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbol), _NONE), np.full(len(symbol), -1, np.int64)
        if len(symbol) > 1:
            rank[:-1], made[:-1] = _pairs(symbol[:-1], symbol[1:], v)
            rank[:-1][word[:-1] != word[1:]] = _NONE
        return rank, made

    rank, made = joint(symbol, word)
    while len(symbol):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, heads)
        span = np.diff(np.concatenate([heads, [len(symbol)]]))
        alive = np.repeat(best < _NONE, span)
        if not alive.all():
            done.append((place[~alive], symbol[~alive]))
            symbol, word, place, rank, made = symbol[alive], word[alive], place[alive], rank[alive], made[alive]
            keep = best < _NONE
            best, span = best[keep], span[keep]
            if not len(symbol):
                break
        best_here = np.repeat(best, span)
        hit = rank == best_here
        # Occurrences that overlap stand side by side: take every second one of such a row.
        at = np.flatnonzero(hit)
        row_start = np.concatenate([[True], at[1:] != at[:-1] + 1])
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(row_start, np.arange(len(at)), 0))
        at = at[since % 2 == 0]
        first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        if not first.all():
            # What a merge makes with its neighbours, as they are before and after their own merges.
            several = np.zeros(int(word[-1]) + 1, bool)
            several[word[at[~first]]] = True
            merged = symbol.copy()
            merged[at] = made[at]
            worse = np.zeros(len(several), bool)
            check = at[several[word[at]]]
            after = check + 2
            ok = (after < len(symbol)) & (word[np.minimum(after, len(symbol) - 1)] == word[check])
            for right in (symbol, merged):
                r, _ = _pairs(made[check[ok]], right[after[ok]], v)
                worse[word[check[ok]][r <= best_here[check[ok]]]] = True
            prior = check - 1
            ok = (prior >= 0) & (word[np.maximum(prior, 0)] == word[check])
            # the left neighbour may itself be the right half of a merge
            half = np.zeros(len(symbol) + 1, bool)
            half[at + 1] = True
            ok &= ~half[np.maximum(prior, 0)]
            r, _ = _pairs(symbol[prior[ok]], made[check[ok]], v)
            worse[word[check[ok]][r <= best_here[check[ok]]]] = True
            at = at[first | ~worse[word[at]]]
        symbol[at] = made[at]
        gone = np.zeros(len(symbol), bool)
        gone[at + 1] = True
        keep = ~gone
        shifted = np.cumsum(keep) - 1
        symbol, word, place = symbol[keep], word[keep], place[keep]
        rank, made = rank[keep], made[keep]
        new = shifted[at]
        touched = np.zeros(len(symbol), bool)
        touched[new] = True
        touched[new[new > 0] - 1] = True
        inner = np.flatnonzero(touched[:-1])
        r, m = _pairs(symbol[inner], symbol[inner + 1], v)
        r = np.where(word[inner] == word[inner + 1], r, _NONE)
        rank[inner], made[inner] = r, m
        rank[-1] = _NONE
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    final = np.full(int(starts[-1]), -1, np.int64)
    for p, s in done:
        final[p] = s
    place = np.flatnonzero(final >= 0)
    symbol = final[place]
    piece = v.symbol_piece[symbol]
    # Characters without a piece go to their UTF-8 bytes.
    lost = piece < 0
    counts = np.ones(len(piece), np.int64)
    if lost.any():
        c = points[place[lost]]
        counts[lost] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.int64)
    out[offsets[:-1][~lost]] = piece[~lost]
    if lost.any():
        data = np.frombuffer("".join(map(chr, points[place[lost]])).encode(), np.uint8)
        where = np.repeat(offsets[:-1][lost] - np.concatenate([[0], np.cumsum(counts[lost])[:-1]]), counts[lost]) + np.arange(len(data))
        out[where] = v.byte_ids[data]
    token_word = np.searchsorted(place, starts)
    return out, offsets[token_word]


def _cut(texts: list[str], v: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """Words that no merge spans, and the offset of each text's first.

    A word is a run of spaces with the letters that follow. Where no piece holds a
    line feed, that is a word of its own. Long runs of spaces are cut as ``load`` found.
    """
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    column = pa.array(marked, pa.large_string())
    if v.breaks_lines:
        column = pc.replace_substring(column, "\n", " \n ")
    column = pc.replace_substring(column, SPACE, " " + SPACE)
    # spaces in a row were set apart as well: put them together again
    if any(SPACE + SPACE in t for t in marked):
        column = pc.replace_substring_regex(column, f"({SPACE}) (?:{SPACE})", SPACE + SPACE)
        column = pc.replace_substring_regex(column, f"({SPACE}) (?:{SPACE})", SPACE + SPACE)
        if v.run:
            whole, more = SPACE * v.run, SPACE * (2 * v.run)
            for k, t in enumerate(marked):
                if more in t:
                    column = pc.if_else(pa.array(np.arange(len(texts)) == k), pa.scalar(_cut_runs(column[k].as_py(), whole), pa.large_string()), column)
    lists = pc.split_pattern(column, " ")
    flat = lists.flatten()
    ends = np.asarray(lists.offsets).astype(np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


def _cut_runs(text: str, whole: str) -> str:
    """Set apart pieces of ``whole`` at the left of every run of spaces over twice that long."""
    out = []
    for word in text.split(" "):
        spaces = len(word) - len(word.lstrip(SPACE))
        n = max(0, spaces // len(whole) - 1)
        out += [whole] * n + [word[n * len(whole) :]]
    return " ".join(out)


def gather(values: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``chosen`` one after another, and the offset of each."""
    sizes = np.diff(starts)[chosen]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts[:-1][chosen] - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def encode(values: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text with begin and end ids, one after another, and each text's offset."""
    words, firsts = _cut(values.to_pylist(), v)
    if len(words):
        coded = words.dictionary_encode()
        tokens, starts = encode_words(coded.dictionary.to_pylist(), v)
        flat, at = gather(tokens, starts, np.asarray(coded.indices).astype(np.int64))
    else:
        flat, at = np.zeros(0, np.int64), np.zeros(1, np.int64)
    inner = at[firsts]
    sizes = np.diff(inner) + 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offsets[-1], np.int64)
    body = np.ones(len(out), bool)
    out[offsets[:-1]], out[offsets[1:] - 1] = v.begin, v.end
    body[offsets[:-1]] = body[offsets[1:] - 1] = False
    out[body] = flat
    return out, offsets


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[str]:
    """The text of each stretch of ids: pieces joined, bytes put together, one leading space taken off.

    Bytes that aren't UTF-8 become the replacement character, one for each byte.
    """
    data, at = gather(v.piece_bytes, v.piece_offsets, ids)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        part = data[at[a] : at[b]].tobytes()
        spoken = a
        while spoken < b and v.is_silent[ids[spoken]]:
            spoken += 1
        if part[:1] == b" " and spoken < b and not v.is_byte[ids[spoken]] and ids[spoken] != v.unknown:
            part = part[1:]
        try:
            out.append(part.decode())
        except UnicodeDecodeError:
            out.append(_decode_bytes(ids[a:b], v))
    return out


def _decode_bytes(ids: np.ndarray, v: Vocabulary) -> str:
    text, held, first = [], bytearray(), True

    def flush() -> None:
        while held:
            for n in (1, 2, 3, 4):
                try:
                    text.append(bytes(held[:n]).decode())
                    del held[:n]
                    break
                except UnicodeDecodeError:
                    pass
            else:
                text.append("�")
                del held[:1]

    for i in ids.tolist():
        part = v.piece_bytes[v.piece_offsets[i] : v.piece_offsets[i + 1]].tobytes()
        if v.is_byte[i]:
            held += part
            first = False
            continue
        flush()
        if v.is_silent[i]:
            continue
        shown = part.decode()
        text.append(shown[1:] if first and shown[:1] == " " and i != v.unknown else shown)
        first = False
    flush()
    return "".join(text)


def tokenize(documents: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the columns ``keep`` with ``ids`` (array of int) and ``decoded``. The
    model file goes to the executors with the job. A null text counts as empty and
    gives the begin and end ids alone; repeated rows give a row each.
    """
    spark = documents.sparkSession
    spark.sparkContext.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]
    kept = documents.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids array<int>", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(SparkFiles.get(name))
        for batch in pieces(batches, "__text"):
            ids, offsets = encode(texts_of(batch, "__text"), v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(decode(ids, offsets, v), pa.string())],
                names=[f.name for f in fields] + ["ids", "decoded"],
            )

    return kept.mapInArrow(run, schema)


def token_digests(documents: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``tokenize``, but per document n_tokens and SHA-256 digests of the ids and the decoded text.

    The digests are taken where the ids are made, so that no ids leave the task.
    """
    spark = documents.sparkSession
    spark.sparkContext.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]
    kept = documents.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(SparkFiles.get(name))
        for batch in pieces(batches, "__text"):
            ids, offsets = encode(texts_of(batch, "__text"), v)
            data = ids.astype("<u4").tobytes()
            digests = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in decode(ids, offsets, v)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.array(np.diff(offsets)), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=[f.name for f in fields] + ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return kept.mapInArrow(run, schema)


__all__ = ["Vocabulary", "decode", "encode", "encode_words", "load", "raw", "token_digests", "tokenize"]
