"""Word and shingle hashes of whole batches of texts, in numpy.

A word is a longest run of characters other than space, tab, LF, VT, FF and CR. A shingle is
``WIDTH`` consecutive words; a text with fewer words is one shingle, and a text without words
has the one shingle of no words, so every text has at least one.
"""

import numpy as np
import pyarrow.compute as pc

WIDTH = 5
PIECE_BYTES = 1 << 21
SMALL_BYTES = 1 << 19  # keeps the arrays of a slice, 8 to 16 times its bytes each, small in many workers

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**63, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = _RANDOM.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x):
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch, column, limit=PIECE_BYTES):
    """Cut an Arrow batch into slices of about ``limit`` bytes of ``column``, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def joined_bytes(texts):
    """All texts, each followed by a line feed, as bytes, with the start of each and the end."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=offsets[1:])
    return np.frombuffer(b"\n".join([*encoded, b""]), np.uint8), offsets


def word_hashes(texts):
    """Hash of every word of all texts in order, and the offset of each text's words."""
    return run_hashes(*joined_bytes(texts), _SPACE)


def term_hashes(texts):
    """The same for terms: longest runs of letters and digits, ASCII letters in lower case."""
    data, offsets = joined_bytes(texts)
    return run_hashes(_LOWER[data], offsets, _NO_TERM)


def _runs(data, outside):
    """Starts and lengths of the longest runs of bytes not in ``outside``, which marks line feeds;
    the value of each of their bytes, its place in its run, and where each run begins in these."""
    inside = ~outside[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    lengths = np.flatnonzero(before & ~inside) - starts
    heads = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(heads, lengths)
    power = np.ones(int(lengths.max(initial=1)), np.uint64)
    power[1:] = _STEP
    return starts, lengths, _BYTE[data[inside]] * np.cumprod(power)[place], place, heads


def run_hashes(data, offsets, outside):
    """Hash of every run in order, and the offset of each text's runs."""
    starts, _, values, _, heads = _runs(data, outside)
    hashes = mix(np.add.reduceat(values, heads)) if len(heads) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def prefix_hashes(texts, sizes):
    """(text number, hash) of every term and of its first bytes, for each of ``sizes`` it has."""
    data, offsets = joined_bytes(texts)
    data = _LOWER[data]
    starts, lengths, values, place, heads = _runs(data, _NO_TERM)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if not len(heads):
        return doc, np.zeros(0, np.uint64)
    docs, hashes = [doc], [mix(np.add.reduceat(values, heads))]
    for size in sizes:
        long = lengths >= size
        part = np.add.reduceat(np.where(place < size, values, np.uint64(0)), heads)[long]
        docs.append(doc[long])
        hashes.append(mix(part + np.uint64(size)))
    return np.concatenate(docs), np.concatenate(hashes)


def shingle_hashes(hashes, offsets, width=WIDTH):
    """Hash of every shingle in order, repeats included, and the offset of each text's shingles."""
    words = np.diff(offsets)
    counts = np.maximum(words - width + 1, 1)
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    first = np.arange(out[-1]) - np.repeat(out[:-1], counts) + np.repeat(offsets[:-1], counts)
    last = np.repeat(offsets[1:], counts)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    total = np.zeros(out[-1], np.uint64)
    for k in range(width):
        total += np.where(first + k < last, padded[first + k], np.uint64(0)) * _SHINGLE[k]
    return mix(total), out


def shingles_of(texts, width=WIDTH):
    return shingle_hashes(*word_hashes(texts), width)
