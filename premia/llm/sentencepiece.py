"""Encoding with the pieces and scores of a SentencePiece file, and decoding, as a max-plus scan.

A text, with a space put in front and spaces written as U+2581, is cut into the pieces whose scores
have the greatest sum; of equal sums the one whose last piece, then the one before it, ...,
begins earliest. A character without a piece becomes its bytes. This is the library's unigram
search; the scores of a file made for merging are read the same way.

Documents of up to ``CHUNK`` characters are searched by one task each. Longer ones are split:

1. A state at a chunk's border is how far the piece across it reaches into the next chunk. Each
   chunk yields a matrix of best sums from entry state to exit state, on its own.
2. Matrices combine by max-plus products, which are associative: products of pairs, of pairs of
   pairs, and back down give the best sums at every border.
3. From these each chunk finds the entry state behind each exit state; composed from the right
   they give the states of the best path.
4. Each chunk is traced back on its own between its two states.

Before a character that no piece has after a different one (U+2581 in most files) every path is
cut. The stretches between cuts, here called words, are separate searches, and a matrix needs only
the cut stretches at both ends of its chunk. All new words of a batch are searched together along a
double array of the pieces; up to ``KNOWN`` words a task are remembered with their ids.

Nulls count as empty texts, which have no pieces; equal long texts are encoded once; repeated rows
give repeated rows; an empty table gives an empty result; other columns are not read. Decoding
gives the text back, but for U+2581, which becomes a space, as in the library.
"""

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from premia.llm.groups import by_group
from premia.llm.text import SMALL_BYTES
from premia.llm.text import pieces as slices
from premia.storage import dealt, store

SPACE = "▁"
CHUNK = 16_384
MOST_CHUNKS = 4_096
KNOWN, KNOWN_BYTES = 150_000, 8 << 20
LANES = 64
_NONE = float("-inf")


class Pieces:
    """Pieces of a file: ids and scores by string, ids of bytes, what each id stands for."""

    def __init__(self, table, bytes_at, names):
        self.table, self.bytes_at, self.names = table, bytes_at, names
        self.name_bytes = pa.array(names, pa.binary())
        self.reach = max(map(len, table))
        self.unknown = min(score for _, score in table.values()) - 10.0
        self.scores = {}  # of every beginning of a piece; nothing longer need be tried without one
        for piece, (_, score) in table.items():
            for k in range(1, len(piece)):
                self.scores.setdefault(piece[:k], self.unknown if k == 1 else _NONE)
            self.scores[piece] = score
        self.heads, self.runs = _heads(table)
        self.trie = Trie(table, self.scores)
        self.known, self.word_ids = pa.array([], pa.binary()), np.zeros(0, np.int32)
        self.word_ends, self.met = np.zeros(1, np.int64), np.zeros(0, bool)

    @classmethod
    def load(cls, path):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        table, bytes_at, names = {}, {}, []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                bytes_at[int(piece[3:5], 16)] = k
                names.append(bytes([int(piece[3:5], 16)]))
                continue
            names.append(b"" if model.is_control(k) or model.is_unknown(k)
                         else piece.replace(SPACE, " ").encode())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                table[piece] = (k, float(model.get_score(k)))
        return cls(table, bytes_at, names)

    def search(self, text, size, entry=(0.0,)):
        """Best sum at each place, and the start of the last piece there (-1: from the entry).

        Pieces begin before ``size`` and may end behind it. ``entry[s]`` is the sum at place s of
        a piece from before the text. A later start must be better to win.
        """
        best, came = [_NONE] * (len(text) + 1), [-1] * (len(text) + 1)
        best[:len(entry)] = entry[:len(text) + 1]
        scores, unknown, last = self.scores, self.unknown, len(text) + 1
        for start in range(size):
            sum_here = best[start]
            if sum_here == _NONE:
                continue
            for end in range(start + 1, last):
                score = scores.get(text[start:end])
                if score is None:
                    if end > start + 1:
                        break
                    score = unknown
                if sum_here + score > best[end]:
                    best[end], came[end] = sum_here + score, start
        return best, came

    def trace(self, text, came, end):
        """Ids of the pieces up to ``end``, and the place the path enters at."""
        out = []
        while came[end] >= 0:
            start = came[end]
            found = self.table.get(text[start:end])
            if found:
                out.append(found[0])
            else:
                out += [self.bytes_at[b] for b in
                        reversed(text[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        return out[::-1], end

    def _keep(self, which):
        """Forget all known words but these, none of them met again so far."""
        self.known = self.known.take(pa.array(which))  # words as bytes, by number
        counts = np.diff(self.word_ends)[which]
        self.word_ids = ragged(self.word_ids, self.word_ends[which], counts)
        self.word_ends = ends_of(counts)
        self.met = np.zeros(len(which), bool)

    def _numbers(self, words):
        """Number of each of different words, once those not known are searched."""
        if len(self.known) > KNOWN or self.known.nbytes > KNOWN_BYTES:
            again = np.flatnonzero(self.met)
            self._keep(again if len(again) < KNOWN // 2 else again[:0])
            if self.known.nbytes > KNOWN_BYTES // 2:
                self._keep(again[:0])
        out = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(out < 0)
        self.met[out[out >= 0]] = True
        if len(new):
            found = words.take(pa.array(new))
            ids, counts = self._search_words(found)
            out[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, found])
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])
            self.word_ends = np.concatenate([
                self.word_ends, len(self.word_ids) + np.cumsum(counts)])
            self.word_ids = np.concatenate([self.word_ids, ids])
        return out

    def _search_words(self, words):
        """Ids of all words, one after another, and how many each has."""
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        lengths = np.add.reduceat((data & 0xC0) != 0x80, ends[:-1] - ends[0], dtype=np.int64)
        text = data.tobytes().decode("utf-8", "surrogatepass").replace(" ", SPACE)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
        short = lengths <= LANES
        if short.all():
            return self._as_bytes(*self.trie.search(codes, lengths, self.unknown))
        # Long ones by themselves, in their places among the others.
        counts, alone, first = np.zeros(len(words), np.int64), [], ends_of(lengths)
        for k in np.flatnonzero(~short).tolist():
            word = text[first[k]:first[k + 1]]
            ids = self.trace(word, self.search(word, len(word))[1], len(word))[0]
            counts[k] = len(ids)
            alone += ids
        found = np.zeros(0, np.int64)
        if short.any():
            found, counts[short] = self.trie.search(
                codes[np.repeat(short, lengths)], lengths[short], self.unknown)
        ids, of = np.empty(counts.sum(), np.int64), np.repeat(short, counts)
        ids[of], ids[~of] = found, alone
        return self._as_bytes(ids, counts)

    def _as_bytes(self, ids, counts):
        """Ids less than 0, which stand for the character -1 - id, become the ids of its bytes."""
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            coded = [chr(-1 - k).encode("utf-8", "surrogatepass") for k in ids[lost].tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[lost] = list(map(len, coded))
            counts = np.add.reduceat(sizes, np.cumsum(counts) - counts)
            ids, of = np.repeat(ids, sizes), np.repeat(ids < 0, sizes)
            ids[of] = [self.bytes_at[b] for one in coded for b in one]
        return ids.astype(np.int32), counts

    def encode_ready(self, texts):
        """Ids of all texts, with spaces already written as U+2581, one after another, and their ends.

        The texts are cut into words together, and each different word is looked up once.
        """
        coded = [t.replace(SPACE, " ").encode("utf-8", "surrogatepass") for t in texts]
        ends = ends_of(list(map(len, coded)))
        if not ends[-1]:
            return np.zeros(0, np.int32), ends
        held = b"".join(coded)
        data = np.frombuffer(held, np.uint8)
        cut = self.heads[data]
        cut[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(cut)
        inner = self.runs[data[starts]] & (data[starts] == data[starts - 1])
        inner &= ~np.isin(starts, ends[:-1])
        starts = starts[~inner]
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]
        ).dictionary_encode()
        number = self._numbers(words.dictionary)[words.indices.to_numpy()]
        counts = np.diff(self.word_ends)[number]
        ids = ragged(self.word_ids, self.word_ends[number], counts)
        return ids, ends_of(counts)[np.searchsorted(starts, ends)]

    def encode_all(self, texts):
        """Arrow lists of the ids of whole texts."""
        ids, ends = self.encode_ready([prepared(t) for t in texts])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    def encode(self, text):
        """Ids of a whole text."""
        return self.encode_ready([prepared(text)])[0].tolist()

    def decode(self, ids):
        names = self.names
        return b"".join([names[k] for k in ids]).decode("utf-8", "replace").removeprefix(" ")

    def decode_all(self, ids, ends):
        """The texts of the ids between each two neighbours of ``ends``, given an Arrow array."""
        named = self.name_bytes.take(ids)
        offsets = np.frombuffer(named.buffers()[1], np.int32)[named.offset:][ends]
        held = (named.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        return [held[a:b].decode("utf-8", "replace").removeprefix(" ")
                for a, b in zip(offsets.tolist(), offsets[1:].tolist())]

    # Chunks: ``text`` is the chunk of ``size`` characters and what follows within reach.

    def _parts(self, text, size):
        """(head, words between, tail with what follows, characters of the tail), or None."""
        codes = np.frombuffer(text.replace(SPACE, " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(codes, 128).astype(np.uint8)
        cut = self.heads[codes]
        cut[1:] &= ~(self.runs[codes[1:]] & (codes[1:] == codes[:-1]))
        starts = np.flatnonzero(cut[1:]) + 1
        inside = int(np.searchsorted(starts, size))
        if not inside:
            return None
        first, last = int(starts[0]), int(starts[inside - 1])
        behind = int(starts[inside]) if inside < len(starts) else len(text)
        return text[:first], text[first:last], text[last:behind], size - last

    def _exits(self, best, size):
        out = np.full(self.reach, _NONE)
        found = best[size:size + self.reach]
        out[:len(found)] = found
        return out

    def matrix(self, text, size):
        """Best sum from each entry state to each exit state.

        What lies between the first and the last cut adds the same to all, and is left out.
        """
        parts, out = self._parts(text, size), np.full((self.reach, self.reach), _NONE)
        tail = None
        if parts:
            head, _, end, kept = parts
            tail = self._exits(self.search(end, kept)[0], kept)
        for state in range(min(self.reach, len(text) + 1)):
            entry = [_NONE] * state + [0.0]
            if parts is None:
                out[state] = self._exits(self.search(text, size, entry)[0], size)
            elif state <= len(head):
                out[state] = self.search(head, len(head), entry)[0][-1] + tail
        return out

    def entry_states(self, text, size, entry):
        """The entry state behind each exit state, given the best sums at the entry."""
        parts = self._parts(text, size)
        if parts:
            head = parts[0]
            came = self.search(head, len(head), entry)[1]
            return [self.trace(head, came, len(head))[1]] * self.reach
        best, came = self.search(text, size, entry)
        return [self.trace(text, came, size + e)[1]
                if size + e < len(best) and best[size + e] > _NONE else 0
                for e in range(self.reach)]

    def between(self, texts, sizes, entries, leaves):
        """Arrow lists of the ids of the pieces that begin in each chunk, from the best entry to its
        exit. The words between the cuts of all chunks are looked up together."""
        parts = [self._parts(t, n) for t, n in zip(texts, sizes)]
        found, ends = self.encode_ready([p[1] if p else "" for p in parts])
        out = []
        for k, (part, text, size, entry, leave) in enumerate(zip(parts, texts, sizes, entries, leaves)):
            if part is None:
                out.append(self.trace(text, self.search(text, size, entry)[1], size + leave)[0])
                continue
            head, _, tail, kept = part
            out.append(np.concatenate([
                np.array(self.trace(head, self.search(head, len(head), entry)[1], len(head))[0], np.int32),
                found[ends[k]:ends[k + 1]],
                np.array(self.trace(tail, self.search(tail, kept)[1], kept + leave)[0], np.int32)]))
        return pa.array(out, pa.list_(pa.int32()))


def ends_of(counts):
    """0 and the running sums."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged(values, starts, counts):
    """The stretches of ``values`` from each start on, one after another."""
    ends = ends_of(counts)
    return values[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], counts)]


def _heads(table):
    """By byte, with U+2581 as a space: whether words begin at it, and whether a run of it is one.

    A word is the stretch between two cuts; cuts are before ASCII or U+2581 that no piece has after
    a different character.
    """
    found = {chr(c) for c in range(128)} - {" "} | {SPACE}
    found -= {b for piece in table for a, b in zip(piece, piece[1:]) if a != b}
    again = {a for piece in table for a, b in zip(piece, piece[1:]) if a == b} & found
    heads, runs = np.zeros(256, bool), np.zeros(256, bool)
    heads[[ord(c.replace(SPACE, " ")) for c in found]] = True
    runs[[ord(c.replace(SPACE, " ")) for c in again]] = True
    return heads, runs


class Trie:
    """The beginnings of all pieces as a double array, searched for many words at once.

    The child of node n by character class c is node ``base[n] + c``, if ``check`` there is n.
    """

    def __init__(self, table, beginnings):
        characters = Counter(c for piece in table for c in piece)
        number = {c: k for k, (c, _) in enumerate(characters.most_common(), 1)}
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in number]] = list(number.values())
        children = {}
        for text in beginnings:
            children.setdefault(text[:-1], []).append(number[text[-1]])
        most, base = len(number), {"": 0}
        taken = bytearray(4 * (len(beginnings) + most))
        taken[:1] = b"\1"
        for c in children[""]:
            taken[c] = 1
        begin = {}  # where the search for a gap for so many children goes on
        for text in sorted(filter(None, children), key=lambda b: -len(children[b])):
            own = sorted(children[text])
            place = taken.find(0, max(begin.get(len(own), 1), own[0]))
            while any(taken[place - own[0] + c] for c in own):
                place = taken.find(0, place + 1)
            base[text] = begin[len(own)] = place - own[0]
            for c in own:
                taken[base[text] + c] = 1
        size = max(base.values()) + most + 1
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.score, self.ids = np.full(size, _NONE), np.full(size, -1, np.int32)
        node = {"": 0}
        for text in sorted(beginnings, key=len):
            at = node[text] = base[text[:-1]] + number[text[-1]]
            self.check[at], self.base[at] = node[text[:-1]], base.get(text, 0)
            if text in table:
                self.ids[at], self.score[at] = table[text]

    def search(self, codes, lengths, unknown):
        """Ids of the pieces of all texts, one text after another, and how many each has.

        All texts take each step together: first the pieces at every place, then the best sums at
        one place after the other, then the way back. -1 - c stands for a character c without a piece.
        """
        ends = np.cumsum(lengths + 1) - 1  # behind each text is one place more, of class 0
        place = (np.arange(ends[-1] + 1) - np.repeat(ends - lengths, lengths + 1)).astype(np.uint8)
        at = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
        classes = np.zeros(len(place), np.int32)
        classes[at] = self.classes[codes]
        node = classes[at]
        node[self.check[node] != 0] = 0
        have, tail = self.ids[node], self.score[node]
        lost = have < 0
        edges = [(at, np.ones(len(at), np.int8), np.where(lost, unknown, tail),
                  np.where(lost, -1 - codes, have))]
        at, node = at[node > 0], node[node > 0]
        size = 1
        while len(at):
            size += 1
            after = self.base[node] + classes[at + size - 1]
            there = np.flatnonzero(self.check[after] == node)
            at, node = at[there], after[there]
            have = self.ids[node]
            whole = np.flatnonzero(have >= 0)
            edges.append((at[whole], np.full(len(whole), size, np.int8), self.score[node[whole]],
                          have[whole]))
        start, step, score, ids = map(np.concatenate, zip(*edges))
        order = np.argsort(place[start], kind="stable")  # by place, then by size
        start, step, score, ids = start[order], step[order], score[order], ids[order]
        group = place[start].astype(np.int32) * 128 + step
        bounds = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
        best = np.full(len(place), _NONE)
        best[ends - lengths] = 0.0
        came, which = np.zeros(len(place), np.int8), np.zeros(len(place), np.int32)
        end = start + step
        for a, b in zip(bounds, bounds[1:]):
            to = end[a:b]
            total = best[start[a:b]] + score[a:b]
            better = total > best[to]
            to = to[better]
            best[to], came[to], which[to] = total[better], step[a], ids[a:b][better]
        lane, at, back = np.flatnonzero(lengths), ends[lengths > 0], []
        while len(lane):
            back.append((lane, which[at]))
            at = at - came[at]
            more = place[at] > 0
            lane, at = lane[more], at[more]
        counts = np.zeros(len(lengths), np.int64)
        for lane, _ in back:
            counts[lane] += 1
        out, last = np.empty(counts.sum(), np.int64), np.cumsum(counts) - 1
        for k, (lane, found) in enumerate(back):
            out[last[lane] - k] = found
        return out, counts


def prepared(text):
    return SPACE + text.replace(" ", SPACE) if text else ""


@lru_cache(maxsize=2)
def loaded(path):
    return Pieces.load(path)


def times(a, b):
    """Max-plus products of two stacks of matrices."""
    out = np.full_like(a, _NONE)
    for k in range(a.shape[2]):
        np.maximum(out, a[:, :, k, None] + b[:, k, None, :], out=out)
    return out


def border_sums(matrices):
    """Best sums by state at the left border of every chunk, each less its greatest."""
    first = np.full(matrices.shape[1], _NONE)
    first[0] = 0.0
    return _entries(matrices, first)


def _entries(matrices, first):
    if len(matrices) == 1:
        return first[None]
    even = len(matrices) // 2 * 2
    left, right = matrices[0:even:2], matrices[1:even:2]
    outer = _entries(np.concatenate([times(left, right), matrices[even:]]), first)
    inner = (outer[:even // 2, :, None] + left).max(axis=1)
    out = np.empty((len(matrices), len(first)))
    out[0::2], out[1::2] = outer, inner
    return out - out.max(axis=1, keepdims=True)


def encode(docs, path, id_column="doc_id", text_column="text", chunk=CHUNK):
    """doc_id and ids of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        model = loaded(path)
        for batch in batches:
            for piece in slices(batch, "text", SMALL_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), model.encode_all(piece.column("text").to_pylist())],
                    ["doc_id", "ids"])

    short = own.where(F.length("text") <= chunk).mapInArrow(
        whole, f"doc_id {kind}, ids array<int>")
    mark = F.sha2("text", 256)
    long = own.where(F.length("text") > chunk)
    coded = encode_long(long.select(mark.alias("mark"), "text").dropDuplicates(["mark"]), path,
                        chunk)
    return short.unionByName(long.select("doc_id", mark.alias("mark")).join(coded, "mark")
                             .select("doc_id", "ids"))


def encode_long(texts, path, chunk=CHUNK):
    """mark and ids of every (mark, text), each text split over tasks."""
    reach = loaded(path).reach
    ready = texts.select("mark", F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
                         .alias("text")).withColumn("length", F.length("text"))
    size = F.greatest(F.lit(chunk), F.lit(reach), F.ceil(F.col("length") / MOST_CHUNKS)).cast("int")
    count = F.greatest(F.lit(1), F.floor(F.col("length") / F.col("size"))).cast("int")
    cut = (ready.withColumn("size", size).withColumn("count", count)
           .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
           .withColumn("own", F.when(F.col("k") < F.col("count") - 1, F.col("size")).otherwise(
               F.col("length") - F.col("k") * F.col("size")).cast("int"))
           .select("mark", "k", "own", F.substring(
               "text", F.col("k") * F.col("size") + 1, F.col("own") + reach - 1).alias("part")))
    chunks = store(cut.repartition("mark", "k"), "pieces-chunks")

    def each(make, column, kind):
        def run(batches):
            model = loaded(path)
            for batch in batches:
                for part in slices(batch, "part", SMALL_BYTES):
                    f = part.select(part.schema.names[2:]).to_pandas()
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), make(model, f)], ["mark", "k", column])
        return lambda df: df.mapInArrow(run, f"mark string, k int, {column} {kind}")

    matrices = each(lambda model, f: pa.array(
        [model.matrix(t, n).ravel() for t, n in zip(f["part"], f["own"])], pa.list_(pa.float64())),
        "matrix", "array<double>")(chunks)

    def sums(frame):
        frame = frame.sort_values("k", ignore_index=True)
        found = border_sums(np.stack(frame["matrix"].to_numpy()).reshape(-1, reach, reach))
        return pd.DataFrame({"mark": frame["mark"], "k": frame["k"], "entry": list(found)})

    borders = store(by_group(dealt(matrices, "mark"), ["mark"], sums,
                             "mark string, k int, entry array<double>"), "pieces-borders")
    entered = chunks.join(borders, ["mark", "k"])
    states = each(lambda model, f: pa.array(
        [model.entry_states(t, n, e) for t, n, e in zip(f["part"], f["own"], f["entry"])],
        pa.list_(pa.int32())), "states", "array<int>")(entered)

    def leave(frame):
        frame = frame.sort_values("k", ascending=False, ignore_index=True)
        state, out = 0, []
        for found in frame["states"]:
            out.append(state)
            state = int(found[state])
        return pd.DataFrame({"mark": frame["mark"], "k": frame["k"], "leave": out})

    # Stored, so that no task runs two of these steps, in a Python worker each.
    left = store(by_group(dealt(states, "mark"), ["mark"], leave, "mark string, k int, leave int"),
                 "pieces-left")
    coded = each(lambda model, f: model.between(f["part"], f["own"], f["entry"], f["leave"]),
                 "ids", "array<int>")(entered.join(left, ["mark", "k"]))
    return coded.groupBy("mark").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda c: c["ids"])).alias("ids"))


def decode(coded, path, ids_column="ids"):
    """All columns of ``coded`` and ``decoded``, the text of its ids (null: null)."""
    at = coded.schema.names.index(ids_column)
    schema = StructType([*coded.schema.fields, StructField("decoded", StringType())])

    def run(batches):
        model = loaded(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                # The names of all rows' ids are put together at once, then cut by row.
                lists = part.column(at)
                ends = ends_of(lists.value_lengths().fill_null(0).to_numpy())
                found = model.decode_all(lists.flatten(), ends)
                found = [t if there else None for there, t in zip(lists.is_valid().to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())],
                                                 names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(run, schema)
