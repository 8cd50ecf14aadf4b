"""Personal data: base rules, and a character-level BiLSTM-CRF for what they miss.

Every kind of span holds a digit or an at sign. Only stretches of text around such characters are
read: cut into overlapping windows, which a bidirectional LSTM turns into a score for each
character and tag. Windows that overlap are averaged by nearness to their middles, and a CRF with
learned transitions then decodes each whole stretch, so a span may be longer than a window.
Decoded spans that overlap no base span, have the form of their kind and a mean marginal
probability of at least ``SURE`` are added to the base spans.

The network is trained in numpy on windows of labelled spans: those of the base rules in the
corpus itself, the ``SAMPLE`` first windows by hash. In a part of the windows telephone numbers
lose the plus sign that the base rule needs, or get other separators, so the network has to tell
them by form and surroundings.

Nulls count as empty texts; texts without digits and at signs have no spans; without labelled spans
nothing is added; an empty table gives an empty result; repeated rows give repeated rows; other
columns are not read.
"""

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from premia.llm.text import pieces

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
SAMPLE = 1_000
SURE = 0.9
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind
SYMBOLS, EMBED, HIDDEN = 131, 12, 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")


def _digits(text):
    return [int(c) for c in text if c in "0123456789"]


def _luhn(digits):
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _emails(text):
    """Leftmost matches; none can hold two at signs, so each at sign is tried once."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text):
    """Matches lie within runs of digits joined by single dots, three dots at least."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for found in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found[0].split(".")):
                    yield found.span()


def base_spans(text):
    """Sorted (start, kind number, end) of the base rules."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if _TRIGGER.search(text):
        spans += [(s, 1, e) for s, e in _ips(text)]
        for kind, rule, least, most in ((2, _CARD, 14, 19), (3, _PHONE, 10, 15)):
            for found in rule.finditer(text):
                digits = _digits(found[0])
                if least <= len(digits) <= most and (kind == 3 or _luhn(digits)):
                    spans.append((found.start(), kind, found.end()))
    return sorted(spans)


def stretches(text):
    """(start, end) of the parts of the text to read: every trigger with half a window each side."""
    out = []
    for found in _TRIGGER.finditer(text):
        start, end = max(0, found.start() - STRIDE), min(len(text), found.end() + STRIDE)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return out


def symbols(text):
    """ASCII as is, then other letters, other characters; 130 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.max(initial=0) < 128:
        return codes.astype(np.int64)
    return np.array([ord(c) if c < "\x80" else 128 + (not c.isalpha()) for c in text], np.int64)


def tags(length, spans):
    out = np.zeros(length, np.int64)
    for start, kind, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


# Network ------------------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Arrays by name: embedding, per direction weights and bias, output, transitions."""

    weights: dict

    @classmethod
    def fresh(cls, rng):
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        arrays = {"embed": draw(SYMBOLS, EMBED) * np.float32(np.sqrt(SYMBOLS) * 0.3)}
        for way in ("ahead", "back"):
            arrays[way] = draw(EMBED + HIDDEN, 4 * HIDDEN)
            arrays[f"{way}_bias"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        return cls(arrays | {"out": draw(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32),
                             "moves": np.zeros((TAGS, TAGS), np.float32)})

    def _run(self, embedded, way, keep):
        """Hidden states along axis 0 of (steps, windows, EMBED), and what the way back needs."""
        steps, n, _ = embedded.shape
        weights, bias = self.weights[way], self.weights[f"{way}_bias"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        states, kept = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if way == "ahead" else range(steps - 1, -1, -1):
            x = np.concatenate([embedded[t], h], axis=1)
            gates = x @ weights + bias
            i, f, o = np.split(_sigmoid(gates[:, :3 * HIDDEN]), 3, axis=1)
            g = np.tanh(gates[:, 3 * HIDDEN:])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            states[t] = h
            if keep:
                kept.append((t, x, i, f, o, g, before, squashed))
        return states, kept

    def emissions(self, windows, keep=False):
        """Scores (windows, steps, TAGS) of (windows, steps) symbols."""
        embedded = self.weights["embed"][windows.T]
        ahead, kept_a = self._run(embedded, "ahead", keep)
        back, kept_b = self._run(embedded, "back", keep)
        hidden = np.concatenate([ahead, back], axis=2)
        scores = hidden @ self.weights["out"] + self.weights["out_bias"]
        return scores.transpose(1, 0, 2), (hidden, kept_a, kept_b)

    def gradients(self, windows, slope, memory):
        """Slopes of all arrays but the transitions from those of the emissions."""
        hidden, kept_a, kept_b = memory
        slope = slope.transpose(1, 0, 2).astype(np.float32)
        grads = {"out": np.einsum("tnh,tnk->hk", hidden, slope), "out_bias": slope.sum((0, 1))}
        down = slope @ self.weights["out"].T
        embed = np.zeros((*windows.T.shape, EMBED), np.float32)
        for way, kept, part in (("ahead", kept_a, down[:, :, :HIDDEN]),
                                ("back", kept_b, down[:, :, HIDDEN:])):
            weights = self.weights[way]
            grad, bias = np.zeros_like(weights), np.zeros(4 * HIDDEN, np.float32)
            dh = np.zeros((windows.shape[0], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, x, i, f, o, g, before, squashed in reversed(kept):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - squashed * squashed)
                d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f),
                                    dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                grad += x.T @ d
                bias += d.sum(axis=0)
                dx = d @ weights.T
                embed[t] += dx[:, :EMBED]
                dh, dc = dx[:, EMBED:], dc * f
            grads[way], grads[f"{way}_bias"] = grad, bias
        grads["embed"] = np.zeros_like(self.weights["embed"])
        np.add.at(grads["embed"], windows.T, embed)
        return grads


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(emissions, moves):
    """Tag chances (n, steps, TAGS), expected moves (TAGS, TAGS) and log of the total."""
    n, steps, _ = emissions.shape
    ahead, back = np.empty_like(emissions), np.zeros_like(emissions)
    ahead[:, 0] = emissions[:, 0]
    for t in range(1, steps):
        ahead[:, t] = emissions[:, t] + _log_sum(ahead[:, t - 1, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        back[:, t] = _log_sum(moves + (emissions[:, t + 1] + back[:, t + 1])[:, None], 2)
    total = _log_sum(ahead[:, -1], 1)
    chance = np.exp(ahead + back - total[:, None, None])
    expected = np.zeros((TAGS, TAGS))
    for t in range(1, steps):
        pair = (ahead[:, t - 1, :, None] + moves
                + (emissions[:, t] + back[:, t] - total[:, None])[:, None])
        expected += np.exp(pair).sum(axis=0)
    return chance, expected, total


def decode(emissions, moves):
    """Best tags (n, steps)."""
    n, steps, _ = emissions.shape
    best, came = emissions[:, 0].copy(), np.empty((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        through = best[:, :, None] + moves
        came[t] = through.argmax(axis=1)
        best = through.max(axis=1) + emissions[:, t]
    path = np.empty((n, steps), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = came[t][np.arange(n), path[:, t]]
    return path


def fit(windows, gold, epochs, batch=64, rate=0.012, seed=11):
    """Adam on the CRF's likelihood of ``gold`` tags."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second, step = {k: np.zeros_like(v) for k, v in net.weights.items()}, 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            scores, memory = net.emissions(windows[part], keep=True)
            chance, expected, _ = marginals(scores.astype(np.float64), net.weights["moves"])
            truth = np.eye(TAGS)[gold[part]]
            grads = net.gradients(windows[part], (chance - truth) / len(part), memory)
            seen = np.zeros((TAGS, TAGS))
            np.add.at(seen, (gold[part][:, :-1], gold[part][:, 1:]), 1)
            grads["moves"] = (expected - seen) / len(part)
            step += 1
            now = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                net.weights[name] -= (now * first[name] / (np.sqrt(second[name]) + 1e-8)
                                      ).astype(np.float32)
    return net


def _varied(text, spans, rng):
    """In half the windows with a telephone number: no plus sign, or other separators."""
    for start, kind, end in spans:
        if kind == 3 and rng.random() < 0.5:
            number = text[start + 1:end]
            if rng.random() < 0.5:
                number = re.sub(r"[\x20().-]+", rng.choice(["-", ".", " "]), number)
            text = text[:start] + number + text[end:]
            return text, [(start, 3, start + len(number))]
    return text, spans


def training_windows(docs, text_column="text", most=SAMPLE):
    """Texts of at most ``most`` windows around triggers, the first by hash of their content."""
    chosen = docs.select(F.col(text_column).alias("text")).where(
        F.col("text").rlike("[0-9@]"))

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = [text[s:s + WINDOW * 2] for text in piece.column("text").to_pylist()
                         for s, _ in stretches(text)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["part"])

    parts = chosen.mapInArrow(cut, "part string").distinct()
    return [r.part for r in parts.orderBy(F.xxhash64("part"), "part").limit(most).collect()]


def train(docs, text_column="text", most=SAMPLE, seed=7, epochs=9):
    """A network, or None where the corpus has no labelled span."""
    rng, windows, gold = np.random.default_rng(seed), [], []
    for part in training_windows(docs, text_column, most):
        part, spans = _varied(part, base_spans(part), rng)
        codes, labels = symbols(part), tags(len(part), spans)
        for start in range(0, max(1, len(codes) - STRIDE), STRIDE):
            window = codes[start:start + WINDOW]
            windows.append(np.pad(window, (0, WINDOW - len(window)), constant_values=130))
            gold.append(np.pad(labels[start:start + WINDOW], (0, WINDOW - len(window))))
    if not windows or not np.any(gold):
        return None
    return fit(np.array(windows), np.array(gold), epochs)


def _formed(kind, part):
    digits = _digits(part)
    if kind == 0:
        return part.count("@") == 1 and "." in part.split("@")[1].strip(".")
    if kind == 1:
        parts = part.split(".")
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255
                                       for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return 7 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[\x20().0-9-]+", part))


def added_spans(texts, base, net, most=512):
    """For each text the sorted spans that the network adds to the base spans."""
    jobs = [(k, s, e) for k, text in enumerate(texts) for s, e in stretches(text)]
    out = [[] for _ in texts]
    jobs.sort(key=lambda job: job[2] - job[1])
    for begin in range(0, len(jobs), most):
        part = jobs[begin:begin + most]
        codes = [symbols(texts[k][s:e]) for k, s, e in part]
        scores = _reconciled(codes, net)
        by_length = {}
        for n, found in enumerate(scores):
            by_length.setdefault(len(found), []).append(n)
        for members in by_length.values():
            stack = np.stack([scores[n] for n in members])
            path, chance = decode(stack, net.weights["moves"]), None
            if not path.any():
                continue
            chance = marginals(stack, net.weights["moves"])[0]
            for row, n in enumerate(members):
                k, shift, _ = part[n]
                for s, kind, e in _spans(path[row]):
                    sure = chance[row, np.arange(s, e), path[row, s:e]].mean()
                    start, end = s + shift, e + shift
                    if (sure >= SURE and _formed(kind, texts[k][start:end])
                            and not any(a < end and start < b for a, _, b in base[k])):
                        out[k].append((start, kind, end))
    return [sorted(set(found)) for found in out]


def _reconciled(codes, net, most=8192):
    """One array of emissions a stretch: the mean over its windows, weighted towards middles."""
    windows, places = [], []
    for n, c in enumerate(codes):
        for start in range(0, max(1, len(c) - STRIDE), STRIDE):
            window = c[start:start + WINDOW]
            windows.append(np.pad(window, (0, WINDOW - len(window)), constant_values=130))
            places.append((n, start, len(window)))
    scores = np.concatenate([net.emissions(np.array(windows[b:b + most]))[0]
                             for b in range(0, len(windows), most)])
    weight = np.minimum(np.arange(WINDOW) + 1.0, WINDOW - np.arange(WINDOW))[:, None]
    total = [np.zeros((len(c), TAGS)) for c in codes]
    share = [np.zeros((len(c), 1)) for c in codes]
    for (n, start, length), found in zip(places, scores):
        total[n][start:start + length] += found[:length] * weight[:length]
        share[n][start:start + length] += weight[:length]
    return [t / s for t, s in zip(total, share)]


def _spans(path):
    out, t = [], 0
    while t < len(path):
        if path[t]:
            kind, start = (path[t] - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 + 2 * kind:
                t += 1
            out.append((start, int(kind), t))
        else:
            t += 1
    return out


def _line(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs, net, id_column="doc_id", text_column="text"):
    """doc_id, array of (kind, start, end, base), digest of the base spans, text form of all."""
    chosen = docs.select(F.col(id_column).alias("doc_id"),
                         F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                ("end", pa.int64()), ("base", pa.bool_())]))

    def read(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.column("text").to_pylist()
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, net) if net else [[] for _ in texts]
                every = [sorted(b + m) for b, m in zip(base, more)]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"),
                    pa.array([[{"kind": KINDS[x[1]], "start": x[0], "end": x[2], "base": x in b}
                               for x in spans] for spans, b in zip(every, base)], shape),
                    pa.array([hashlib.sha256(_line(b).encode()).hexdigest() for b in base],
                             pa.string()),
                    pa.array(map(_line, every), pa.string())],
                    ["doc_id", "found", "base_sha256", "spans"])

    return chosen.mapInArrow(read, f"doc_id {kind}, found array<struct<kind:string,start:bigint,"
                                   "end:bigint,base:boolean>>, base_sha256 string, spans string")
