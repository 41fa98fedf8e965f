"""Arrow and numpy helpers over whole text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space that separates words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


def is_space(data: np.ndarray) -> np.ndarray:
    return _IS_SPACE[data]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of ``column``, or one row.

    No row is ever cut: a longer text forms a batch of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        at = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = at[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(at, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column with nulls as empty strings, packed from offset 0."""
    values = batch.column(column)
    values = pc.fill_null(values, "") if values.null_count else values
    return pa.concat_arrays([values]) if values.offset == 0 else pa.concat_arrays([values, values.slice(0, 0)])


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings, and the offset of each (one more than there are strings)."""
    wide = values.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and the offset of each text's first (one more than there are texts)."""
    lists = pc.ascii_split_whitespace(values)
    flat = lists.flatten()
    ends = np.asarray(lists.offsets).astype(np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    counted = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), counted[ends]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each word, and the distinct words."""
    if len(words) == 0:
        return np.zeros(0, np.int64), pa.array([], words.type)
    coded_words = words.dictionary_encode()
    return np.asarray(coded_words.indices).astype(np.int64), coded_words.dictionary


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive offsets, 0 where there are none."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype != np.float64 else np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers, one to one with ``values`` (the splitmix finaliser)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (numpy's sort is several times faster here than its ``unique``)."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def replaced(values: pa.Array, bytes_to: np.ndarray) -> pa.Array:
    """Texts with each UTF-8 byte replaced by what ``bytes_to`` has for it."""
    data, offsets = raw(values)
    return pa.Array.from_buffers(pa.large_string(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bytes_to[data]))])


def expanded(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [start, start + size), one range after another, and the number of the range of each."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - first[owner] + starts[owner], owner
