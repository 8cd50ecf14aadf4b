"""Secret scans with one automaton for all rules.

The scan form of every rule is read into a nondeterministic automaton; subset construction and
minimisation turn all of them into one transition array. A batch of texts is one byte string cut
into lanes, which advance together, a byte a step. A byte that no rule uses takes any state
back to the start and ends every match, so lanes and exact checks are cut there. Stretches in
which the automaton accepts are read again by the rules' full expressions, which give the spans.
A private key has many lines and any characters between them: a text with the scan form of such a
``whole`` rule is read by its full expression from end to end.

Nulls count as empty texts; an empty table gives an empty result; repeated rows give repeated
rows; other columns are not read by ``secret_spans`` and kept by ``redact``.
"""

import hashlib
import re
from dataclasses import dataclass
from re import _constants as code
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from premia.llm.text import SMALL_BYTES, joined_bytes, pieces


@dataclass(frozen=True)
class Rule:
    """``scan`` must match somewhere in each match of ``full`` that is kept.

    A match is dropped if ``group`` of it is shorter than ``least``. A match of a ``whole`` rule may
    go on past bytes that no rule uses.
    """

    kind: str
    full: str
    scan: str
    group: int = 0
    least: int = 0
    base: bool = False
    whole: bool = False


# The three base kinds of secrets as given, in this order, then published formats.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
_KEY = "[A-Z ]*PRIVATE KEY-----"
_BREAK = r"(?:[ \t>]*+(?:\r\n?|\n|\\r\\n|\\n))"  # of a line, also quoted or as written in strings
_BASE64 = r"(?:[A-Za-z0-9+/]{32,}+=*+|[A-Za-z0-9+/]++=++)"
_LINE = rf"(?:{_BASE64}|[A-Za-z0-9+/]++(?=[\"'`<]|[ \t]*+(?:[\r\n\\]|\Z)))"
# To the END line before any other key; without one, over the headers and base64 lines that follow.
_KEY_BODY = (
    rf"(?:(?:[^-]++|-(?!----(?:BEGIN|END) {_KEY}))*+-----END {_KEY}"
    rf"|(?:(?:{_BREAK}[ \t>]*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)++(?={_BREAK}{{2}}))?+"
    rf"(?:[ \t]*+{_BASE64}|{_BREAK}++[ \t>]*+{_LINE})*+)")
RULES = (
    Rule("assign", _ASSIGN + r"([A-Za-z0-9+/_.=-]+)", _ASSIGN + r"[A-Za-z0-9+/_.=-]", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{4}", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", r"AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
         r"\.eyJ"),
    Rule("private_key", f"-----BEGIN {_KEY}{_KEY_BODY}", r"PRIVATE KEY-----", whole=True),
)


class _Nfa:
    """Thompson construction over the parse tree of Python's own expressions."""

    def __init__(self):
        self.empty, self.steps = [], []

    def state(self):
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def add(self, items, at, folded=False):
        for op, value in items:
            at = self._one(op, value, at, folded)
        return at

    def _one(self, op, value, at, folded):
        if op in (code.LITERAL, code.IN):
            end = self.state()
            self.steps[at].append((_byte_set([(op, value)] if op is code.LITERAL else value,
                                             folded), end))
            return end
        if op is code.SUBPATTERN:
            return self.add(value[3], at, folded or bool(value[1] & re.IGNORECASE))
        if op is code.BRANCH:
            end = self.state()
            for branch in value[1]:
                self.empty[self.add(branch, at, folded)].append(end)
            return end
        if op is code.MAX_REPEAT:
            least, most, body = value
            for _ in range(least):
                at = self.add(body, at, folded)
            end = self.state()
            self.empty[at].append(end)
            if most is code.MAXREPEAT:
                hub = self.state()
                self.empty[at].append(hub)
                last = self.add(body, hub, folded)
                self.empty[last] += [hub, end]
                return end
            for _ in range(most - least):
                at = self.add(body, at, folded)
                self.empty[at].append(end)
            return end
        raise ValueError(f"not supported in a rule: {op}")


def _byte_set(items, folded):
    found = set()
    for op, value in items:
        found |= {value} if op is code.LITERAL else set(range(value[0], value[1] + 1))
    if folded:
        found |= {ord(chr(b).swapcase()) for b in found}
    if max(found) > 127:
        raise ValueError("rules are made of ASCII characters")
    return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte_class[byte]]`` is the next state; states are row offsets.

    Offsets from ``accepting`` on accept; offset 0 is the start; ``unused`` marks bytes of no rule.
    """

    table: np.ndarray
    byte_class: np.ndarray
    accepting: int
    unused: np.ndarray


def compile_rules(rules=RULES):
    """The minimal automaton that accepts where the scan form of any rule has just ended."""
    nfa = _Nfa()
    start, final, used = nfa.state(), nfa.state(), set()
    for rule in rules:
        nfa.empty[nfa.add(_parser.parse(rule.scan), start)].append(final)
        full = _Nfa()
        if not rule.whole:
            full.add(_parser.parse(rule.full), full.state())
        used |= {b for steps in (*full.steps, *nfa.steps) for chars, _ in steps for b in chars}
    kinds = {}
    for byte in sorted(used):
        kinds.setdefault(frozenset((s, k) for s, steps in enumerate(nfa.steps)
                                   for k, (chars, _) in enumerate(steps) if byte in chars),
                         []).append(byte)
    byte_class = np.zeros(256, np.int32)
    for number, members in enumerate(kinds.values(), 1):
        byte_class[members] = number
    samples = [members[0] for members in kinds.values()]

    def closed(states):
        seen, todo = set(states), list(states)
        while todo:
            fresh = set(nfa.empty[todo.pop()]) - seen
            seen |= fresh
            todo += fresh
        return frozenset(seen)

    first = closed({start})
    numbers, rows, todo = {first: 0}, {}, [first]
    while todo:
        states = todo.pop()
        row = [0]
        for byte in samples:
            target = closed({start} | {end for s in states for chars, end in nfa.steps[s]
                                       if byte in chars})
            if target not in numbers:
                numbers[target] = len(numbers)
                todo.append(target)
            row.append(numbers[target])
        rows[numbers[states]] = row
    table = np.array([rows[k] for k in range(len(rows))])
    accepts = np.zeros(len(rows), np.int64)
    for states, number in numbers.items():
        accepts[number] = final in states
    table, accepts = _minimal(table, accepts)
    order = np.lexsort((np.arange(len(accepts)) != 0, accepts))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    width = table.shape[1]
    unused = np.ones(256, bool)
    unused[list(used)] = False
    return Automaton((place[table[order]] * width).astype(np.int32).ravel(), byte_class,
                     int((accepts == 0).sum()) * width, unused)


def _minimal(table, accepts):
    """Merge states that no continuation tells apart, by refining until nothing splits."""
    group, count = accepts.copy(), 0
    while True:
        _, first, refined = np.unique(np.column_stack([group, group[table]]), axis=0,
                                      return_index=True, return_inverse=True)
        refined = refined.ravel()
        if len(first) == count:
            break
        group, count = refined, len(first)
    merged = group[table[first]]
    swap = np.arange(count)
    swap[[0, group[0]]] = swap[[group[0], 0]]  # the start keeps number 0
    return swap[merged][swap], accepts[first][swap]


def _accepted(data, automaton, lane=512, few=256):
    """Places in ``data`` (which ends with an unused byte) at which the automaton accepts.

    Once fewer than ``few`` long lanes are left, a plain loop over each is quicker.
    """
    cuts = np.flatnonzero(automaton.unused[data])
    nominal = np.searchsorted(cuts, np.arange(lane, len(data), lane))
    bounds = np.unique(np.concatenate([[0], cuts[np.minimum(nominal, len(cuts) - 1)] + 1,
                                       [len(data)]]))
    starts, lengths = bounds[:-1], np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    classes = automaton.byte_class[data]
    state, found = np.zeros(len(starts), np.int32), []
    alive = len(starts)
    for step in range(int(lengths[0]) if alive else 0):
        alive = int(np.searchsorted(-lengths, -step, side="left"))
        if alive < few:
            table = automaton.table.tolist()
            for begin, length, now in zip(starts[:alive].tolist(), lengths[:alive].tolist(),
                                          state[:alive].tolist()):
                hits = []
                for k, c in enumerate(classes[begin + step:begin + length].tolist(), begin + step):
                    now = table[now + c]
                    if now >= automaton.accepting:
                        hits.append(k)
                found.append(np.array(hits, np.int64))
            break
        at = starts[:alive] + step
        state[:alive] = automaton.table[state[:alive] + classes[at]]
        hit = state[:alive] >= automaton.accepting
        if hit.any():
            found.append(at[hit])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def scan_texts(texts, automaton, rules=RULES):
    """For each text the sorted list of (start, rule number, end) in code points."""
    spans = [[] for _ in texts]
    data, offsets = joined_bytes(texts)
    places = _accepted(data, automaton)
    if not len(places):
        return spans
    cuts = np.concatenate([[-1], np.flatnonzero(automaton.unused[data])])
    after = np.unique(np.searchsorted(cuts, places))
    compiled = [re.compile(rule.full) for rule in rules]
    signs = [re.compile(rule.scan) for rule in rules]
    wholes = set()
    for k in after.tolist():
        start, end = int(cuts[k - 1]) + 1, int(cuts[k])
        doc = int(np.searchsorted(offsets, start, side="right")) - 1
        stretch = data[start:end].tobytes().decode("ascii")
        shift = int(((data[offsets[doc]:start] & 0xC0) != 0x80).sum())
        for number, (rule, pattern) in enumerate(zip(rules, compiled)):
            if rule.whole:
                if signs[number].search(stretch):
                    wholes.add((doc, number))
                continue
            spans[doc] += [(m.start() + shift, number, m.end() + shift)
                           for m in pattern.finditer(stretch)
                           if len(m[rule.group]) >= rule.least]
    for doc, number in wholes:
        spans[doc] += [(m.start(), number, m.end()) for m in compiled[number].finditer(texts[doc])
                       if len(m[rules[number].group]) >= rules[number].least]
    return [sorted(found) for found in spans]


def _texts(batch, name):
    return [t or "" for t in batch.column(name).to_pylist()]


def secret_spans(docs, id_column="doc_id", text_column="text", rules=RULES):
    """One row a document: its id, an array of (kind, start, end) and the text form of ``base``."""
    automaton = compile_rules(rules)
    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def scan(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                spans = scan_texts(_texts(piece, "text"), automaton, rules)
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"),
                    pa.array([[{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in found]
                              for found in spans],
                             pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                 ("end", pa.int64())]))),
                    pa.array([hashlib.sha256(_line(found, rules, True).encode()).hexdigest()
                              for found in spans], pa.string()),
                    pa.array([_line(found, rules, False) for found in spans], pa.string()),
                ], ["doc_id", "found", "base_sha256", "spans"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(scan, f"doc_id {kind}, found array<struct<kind:string,start:bigint,"
                                   "end:bigint>>, base_sha256 string, spans string")


def _line(found, rules, base_only):
    return ",".join(f"{rules[n].kind}:{s}:{e}" for s, n, e in found
                    if rules[n].base or not base_only)


def redact(docs, text_column="text", length_column="n_chars", mark="[secret]", rules=RULES):
    """All rows and columns of ``docs``, with every secret in the text replaced by ``mark``.

    Overlapping spans are replaced as one. A null text stays null. ``length_column``, where
    there is one, is set to the new length of texts that changed.
    """
    automaton, schema = compile_rules(rules), docs.schema
    text_at = schema.names.index(text_column)
    length_at = schema.names.index(length_column) if length_column in schema.names else None

    def clean(batches):
        for batch in batches:
            for piece in pieces(batch, text_at, SMALL_BYTES):
                texts = piece.column(text_at).to_pylist()
                lengths = piece.column(length_at).to_pylist() if length_at is not None else None
                for k, found in enumerate(scan_texts([t or "" for t in texts], automaton, rules)):
                    if found:
                        texts[k] = _masked(texts[k], found, mark)
                        if lengths:
                            lengths[k] = len(texts[k])
                columns = list(piece.columns)
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if lengths:
                    columns[length_at] = pa.array(lengths, columns[length_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)

    return docs.mapInArrow(clean, schema)


def _masked(text, found, mark):
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
