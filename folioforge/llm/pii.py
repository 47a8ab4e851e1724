"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans (email, ip, card, phone), which always stay. The tagger is trained in numpy on
windows of the documents: spans that the patterns label, and spans written into other windows in the ways that
patterns miss ("a [at] b dot com", spaced dots, numbers without their plus, secrets after a name). It adds what
it then finds, as far as a check of each kind holds (a card's digits pass Luhn, an address's parts fit a byte).

Every kind of span needs a trigger, which the check enforces: a digit, an at sign, a bracketed "at" or dot, "dot"
between spaces, or "at" between spaces before a dotted name. Windows without one can hold no span that the check
lets through and are skipped, which leaves a small part of ordinary text. Windows overlap by half, so spans
of up to 48 characters stand whole in one of them; each character takes its tag from the window in which it is
furthest from an edge, and spans are read off the joined tags. Longer spans may come out in parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .memory import lean
from .scratch import materialise, smallest
from .words import text_batches

#: Kinds in the order in which spans with one start are listed; the last is the tagger's alone.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Characters of a window, and how far apart windows start.
WINDOW, STRIDE = 96, 48
#: Windows that training takes at most (those with the smallest hash of their text).
TRAIN_WINDOWS = 3_000
#: Bytes of text that are decoded together.
SLICE_BYTES = 1 << 18

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's digits are taken whole (possessive) and from their start: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_LABEL = "[A-Za-z0-9-]+"
_TRIGGER = re.compile(rf"[0-9@]|[\[(] ?(?:[aA][tT]|[dD][oO][tT]|\.) ?[\])]| [dD][oO][tT] | [aA][tT] {_LABEL}\.[A-Za-z0-9-]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
            at = text.find("@", free)
        else:
            free = at + 1  # no local part reaches over this sign
            at = text.find("@", free)


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")  # so that no number gets too long to read
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the patterns' matches, sorted."""
    if not _DIGIT.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(_byte(p) for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and passes_luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# The tagger. Tags: 0 outside, then B and I of each kind.
N_TAGS = 1 + 2 * len(KINDS)
_CODES = np.full(128, 1, np.int64)
_CODES[[c for c in range(32, 127)]] = np.arange(2, 97)
N_CODES = 98  # 0 padding, 1 control, 2-96 printable ASCII, 97 other


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 97)


def tags_of(spans: list[tuple[int, int, int]], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for start, kind, end in spans:
        if not out[start:end].any():
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


def _legal() -> np.ndarray:
    """Transitions that CRF decoding may take: I follows B or I of its kind only."""
    ok = np.ones((N_TAGS, N_TAGS), bool)
    for kind in range(len(KINDS)):
        ok[:, 2 + 2 * kind] = False
        ok[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = True
    return ok


LEGAL = _legal()
_SHUT = np.float32(-1e4)


@dataclass(frozen=True)
class Tagger:
    """Sizes and training of the network; examples: windows made from those at hand, however few these are."""

    embedding: int = 12
    hidden: int = 24
    examples: int = 4096
    epochs: int = 12
    batch: int = 64
    rate: float = 0.015
    seed: int = 7


def init_weights(how: Tagger) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(how.seed)
    e, h = how.embedding, how.hidden
    w = {"emb": rng.normal(0, 0.3, (N_CODES, e)), "out": rng.normal(0, 0.2, (2 * h, N_TAGS)), "bias": np.zeros(N_TAGS), "trans": np.zeros((N_TAGS, N_TAGS)), "first": np.zeros(N_TAGS)}
    for d in "fb":
        w["x" + d] = rng.normal(0, 1 / np.sqrt(e), (e, 4 * h))
        w["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        w["c" + d] = np.concatenate([np.ones(h), np.zeros(3 * h)])  # forget gates start open
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, c: np.ndarray, keep: bool):
    """x: time, batch, features -> hidden states; with keep, what the backward pass needs."""
    steps, batch, _ = x.shape
    size = wh.shape[0]
    ahead = x.reshape(-1, x.shape[2]) @ wx + c
    ahead = ahead.reshape(steps, batch, -1)
    h, cell = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    out, saved = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        g = ahead[t] + h @ wh
        gates = _sigmoid(g[:, : 3 * size])
        f, i, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        u = np.tanh(g[:, 3 * size :])
        before = cell
        cell = f * before + i * u
        th = np.tanh(cell)
        if keep:
            saved.append((f, i, o, u, before, th, h))
        h = o * th
        out[t] = h
    return out, saved


def _lstm_back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, saved: list, grad: np.ndarray):
    steps, batch, size = grad.shape
    dg = np.empty((steps, batch, 4 * size), np.float32)
    dh, dc = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    dwh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        f, i, o, u, before, th, h = saved[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - th * th)
        dg[t] = np.concatenate([dc * before * f * (1 - f), dc * u * i * (1 - i), dh * th * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        dwh += h.T @ dg[t]
        dh = dg[t] @ wh.T
        dc = dc * f
    flat = dg.reshape(-1, 4 * size)
    return (flat @ wx.T).reshape(x.shape), x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


def emissions(w: dict[str, np.ndarray], inputs: np.ndarray, keep: bool = False):
    """inputs: time, batch codes -> time, batch, tag scores."""
    x = w["emb"][inputs]
    forward, fs = _lstm(x, w["xf"], w["hf"], w["cf"], keep)
    backward, bs = _lstm(x[::-1], w["xb"], w["hb"], w["cb"], keep)
    both = np.concatenate([forward, backward[::-1]], axis=2)
    return both @ w["out"] + w["bias"], (x, fs, bs, both)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_gradients(e: np.ndarray, trans: np.ndarray, first: np.ndarray, tags: np.ndarray):
    """Negative log-likelihood summed over the batch, and its gradients by emissions, transitions, first."""
    steps, batch, k = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = first + e[0]
    for t in range(1, steps):
        a[t] = _lse(a[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        b[t] = _lse(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    de = np.exp(a + b - z[None, :, None])
    dfirst = de[0].sum(axis=0)
    dtrans = np.zeros_like(trans)
    who = np.arange(batch)
    for t in range(steps - 1):
        dtrans += np.exp(a[t][:, :, None] + trans + (e[t + 1] + b[t + 1])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(dtrans, (tags[t], tags[t + 1]), -1)
    score = first[tags[0]] + sum(e[t, who, tags[t]] for t in range(steps)) + sum(trans[tags[t], tags[t + 1]] for t in range(steps - 1))
    np.add.at(dfirst, tags[0], -1)
    for t in range(steps):
        de[t, who, tags[t]] -= 1
    return float((z - score).sum()), de, dtrans, dfirst


def train_tagger(inputs: np.ndarray, tags: np.ndarray, how: Tagger = Tagger()) -> dict[str, np.ndarray]:
    """inputs, tags: windows by time. Adam over shuffled batches."""
    w = init_weights(how)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    rng, step = np.random.default_rng(how.seed), 0
    shut = np.where(LEGAL, 0, _SHUT).astype(np.float32)
    steps = how.epochs * -(-len(inputs) // how.batch)
    for _ in range(how.epochs):
        order = rng.permutation(len(inputs))
        for lo in range(0, len(order), how.batch):
            own = order[lo : lo + how.batch]
            x, y = inputs[own].T, tags[own].T
            e, (emb, fs, bs, both) = emissions(w, x, keep=True)
            _, de, dtrans, dfirst = crf_gradients(e, w["trans"] + shut, w["first"], y)
            de /= len(own)
            g = {"trans": dtrans / len(own) * LEGAL, "first": dfirst / len(own)}
            flat = de.reshape(-1, N_TAGS)
            g["out"], g["bias"] = both.reshape(-1, both.shape[2]).T @ flat, flat.sum(axis=0)
            dboth = de @ w["out"].T
            h = how.hidden
            dx, g["xf"], g["hf"], g["cf"] = _lstm_back(emb, w["xf"], w["hf"], fs, dboth[:, :, :h])
            dxb, g["xb"], g["hb"], g["cb"] = _lstm_back(emb[::-1], w["xb"], w["hb"], bs, dboth[::-1, :, h:])
            g["emb"] = np.zeros_like(w["emb"])
            np.add.at(g["emb"], x, dx + dxb[::-1])
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            step += 1
            for name, q in g.items():
                q = q * min(1, 5 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * q
                v[name] = 0.999 * v[name] + 0.001 * q * q
                w[name] = (w[name] - how.rate * (1 - 0.95 * step / steps) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def decode(w: dict[str, np.ndarray], inputs: np.ndarray) -> np.ndarray:
    """Best legal tags of windows by time (windows first)."""
    e, _ = emissions(w, inputs.T)
    trans = w["trans"] + np.where(LEGAL, 0, _SHUT)
    first = w["first"] + np.where([t > 0 and t % 2 == 0 for t in range(N_TAGS)], _SHUT, 0)
    steps, batch, _ = e.shape
    best, back = first + e[0], np.empty((steps, batch, N_TAGS), np.int8)
    for t in range(1, steps):
        over = best[:, :, None] + trans
        back[t] = over.argmax(axis=1)
        best = over.max(axis=1) + e[t]
    out = np.empty((steps, batch), np.int8)
    out[-1] = best.argmax(axis=1)
    who = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, who, out[t]]
    return out.T


def trigger_windows(text: str) -> list[int]:
    """Starts of the windows, of a grid over the whole text, that hold the beginning of a trigger or follow on it."""
    if not _TRIGGER.search(text):
        return []
    at = np.array([m.start() for m in _TRIGGER.finditer(text)]) // STRIDE
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    return [s * STRIDE for s in sorted({*np.clip(at, 0, last).tolist(), *np.clip(at - 1, 0, last).tolist()})]


_DOT = r"(?: ?[\[(] ?(?:dot|\.) ?[\])] ?| dot )"
#: An address in words: with a bracketed "at" any dots may follow, with a plain one the first has to be a dot without spaces or a word.
_SPELLED = re.compile(rf"(?i)[a-z0-9._%+-]+(?:{_DOT}[a-z0-9._%+-]+)*(?: ?[\[(] ?at ?[\])] ?{_LABEL}(?:{_DOT}| ?\. ?)| at {_LABEL}(?:{_DOT}|\.)){_LABEL}(?:(?:{_DOT}| ?\. ?){_LABEL})*")
_DOTS = re.compile(r"(?i)\[\.\]|\(\.\)| ?[\[(]dot[\])] ?| dot | ?\. ?| ?, ?")
_COLONS = re.compile(r"(?i)[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}")


def valid(kind: int, text: str) -> bool:
    """What any span of a kind has to hold."""
    digits = _digits(text)
    if kind == 0:
        if "@" not in text:
            return bool(_SPELLED.fullmatch(text))
        return "@" in text[1:-1] and ("." in text[1:-1] or " dot " in text.lower() or "dot]" in text.lower() or "dot)" in text.lower())
    if kind == 1:
        parts = _DOTS.split(text)
        return (len(parts) == 4 and all(p and p == _digits(p) and _byte(p) for p in parts)) or (bool(digits) and text.count(":") >= 2 and bool(_COLONS.fullmatch(text)))
    if kind == 2:
        return 12 <= len(digits) <= 19 and passes_luhn(digits)
    if kind == 3:
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)
    return len(text) >= 16 and not any(c.isspace() for c in text) and bool(digits) and any(c.isalpha() for c in text)


# Spans as people write them. Each maker takes a random generator and gives a span of its kind.


def _pick(rng: np.random.Generator, *choices):
    return choices[int(rng.integers(len(choices)))]


def _number(rng: np.random.Generator, digits: int) -> str:
    return "".join(map(str, rng.integers(0, 10, digits)))


def _name(rng: np.random.Generator, least: int = 2, most: int = 9) -> str:
    return "".join(_pick(rng, *"abcdefghijklmnopqrstuvwxyz") for _ in range(rng.integers(least, most + 1)))


def _make_email(rng: np.random.Generator) -> str:
    first, dot = _name(rng), _pick(rng, ".", ".", " dot ", " [dot] ", "(dot)", " . ")
    at = _pick(rng, "@", "@", " @ ", " at ", "[at]", " [at] ", "(at)", " (at) ") if dot in (".", " . ") else _pick(rng, " at ", " [at] ", "(at)", "@")
    if at == " at ":
        dot = _pick(rng, " dot ", ".")
    local = _pick(rng, first, first + _number(rng, 2), first + "." + _name(rng), first + _pick(rng, ".", "_", "-") + _number(rng, 2), first.capitalize())
    return local + at + dot.join([_name(rng) + _pick(rng, "", _number(rng, 1)), *([_name(rng)] if rng.random() < 0.4 else []), _pick(rng, "com", "org", "net", "de", "es", "fr", "example")])


def _make_ip(rng: np.random.Generator) -> str:
    if rng.random() < 0.15:
        return ":".join(f"{rng.integers(1 << 16):x}" for _ in range(8))
    return _pick(rng, ".", ".", "[.]", "(.)", " . ", " dot ", "[dot]", ". ").join(str(rng.integers(256)) for _ in range(4))


def _make_card(rng: np.random.Generator) -> str:
    size = int(_pick(rng, 13, 15, 16, 16, 16, 16, 19))
    body = _number(rng, size - 1)
    digits = next(body + str(d) for d in range(10) if passes_luhn(body + str(d)))
    by = _pick(rng, "", "", " ", "-", ".", "/", " - ", "  ", "_")
    return by.join(digits[i : i + 4] for i in range(0, size, 4))


def _make_phone(rng: np.random.Generator) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return _pick(
        rng, f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}",
        f"00{rng.integers(1, 99)} {a} {b}{c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}", f"({a}){b}-{c}", f"+{rng.integers(1, 99)}-{a}/{b}-{c}",
    )


def _make_secret(rng: np.random.Generator) -> str:
    letters = _pick(rng, "0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    while True:
        found = _pick(rng, "", "", "", "sk-", "ghp_", "AKIA") + "".join(_pick(rng, *letters) for _ in range(rng.integers(20, 45)))
        if valid(4, found):
            return found


def _lead(rng: np.random.Generator, kind: int) -> str:
    """What often stands before a span of a kind."""
    if kind == 4:
        key = _pick(rng, "token", "secret", "password", "api_key", "apikey", "key", "access_token", "TOKEN", "API_KEY")
        return key + _pick(rng, " = ", "=", ": ", " : ", ":") + _pick(rng, '"', '"', "'", "")
    return _pick(rng, "", "", (("mail ", "e-mail: "), ("ip ", "host: "), ("card ", "no. "), ("tel ", "phone: "))[kind][int(rng.integers(2))])


_MAKERS = (_make_email, _make_ip, _make_card, _make_phone, _make_secret)


def _make_other(rng: np.random.Generator) -> str:
    """Numbers and words that are no personal data."""
    n = _number
    return _pick(
        rng, f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{rng.integers(24)}:{rng.integers(60):02}", f"{n(rng, 3)},{n(rng, 3)}.{n(rng, 2)}", f"{n(rng, 1)}.{n(rng, 1)}",
        f"v{n(rng, 1)}.{n(rng, 1)}.{n(rng, 2)}", f"{rng.integers(1, 400)}", f"{rng.integers(1900, 2100)}", f"{n(rng, 2)}%", f"{n(rng, 3)}-{n(rng, 3)}", f"{n(rng, 5)}", f"{n(rng, 8)}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1900, 2100)}",
        f"{_name(rng)} at {_name(rng)}", f"{_name(rng)} dot {_name(rng)}", f"@{_name(rng)}", f"{_name(rng)}{n(rng, 2)}", f"{_name(rng)}-{n(rng, 4)}", f"{n(rng, 2)}/{n(rng, 2)}",
    )


def make_examples(parts: list[tuple[str, bytes]], how: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags to train on, how.examples of them: two fifths as they are, the others with one or two
    spans, or numbers that are none, written over a part of them. parts: text and tags of windows at hand.
    """
    rng = np.random.default_rng(how.seed)
    inputs, tags = np.zeros((how.examples, WINDOW), np.int64), np.zeros((how.examples, WINDOW), np.int64)
    for i in range(how.examples):
        text, own = parts[i % len(parts)]
        text, own = text[:WINDOW], np.frombuffer(own, np.int8)[: min(len(text), WINDOW)]
        if rng.random() < 0.6:
            text, own = _written_over(rng, text, own)
            text, own = text[:WINDOW], own[:WINDOW]
        c = codes(text)
        inputs[i, : len(c)] = c
        tags[i, : len(own)] = own
    return inputs, tags


def _written_over(rng: np.random.Generator, text: str, own: np.ndarray) -> tuple[str, np.ndarray]:
    cut = int(rng.integers(0, max(1, min(40, len(text)))))
    while 0 < cut < len(own) and own[cut] and own[cut] % 2 == 0:  # not inside a span
        cut -= 1
    kind = int(rng.integers(0, len(KINDS) + 2))
    if kind >= len(KINDS):
        lead, new, marks = "", _make_other(rng), None
    else:
        lead, new = _lead(rng, kind), _MAKERS[kind](rng)
        marks = tags_of([(0, kind, len(new))], len(new))
    before, after = _pick(rng, " ", " ", " ", "\n", "", "("), _pick(rng, " ", " ", ", ", ". ", "\n", ")", "")
    if before == "" and cut and text[cut - 1].isalnum():
        before = " "
    if kind == 4 and lead and lead[-1] in "\"'":
        after = lead[-1] + " "
    keep = cut + len(before) + len(lead)
    rest = text[cut:]
    if after == "" and rest[:1].isalnum():
        after = " "
    none = lambda n: np.zeros(n, np.int64)
    out = np.concatenate([own[:cut], none(keep - cut), marks if marks is not None else none(len(new)), none(len(after)), own[cut:]])
    return text[:cut] + before + lead + new + after + rest, out


def tagged_spans(w: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds in each text: windows decoded together, then joined for each text."""
    where = [(k, s) for k, t in enumerate(texts) for s in trigger_windows(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    tags: dict[int, dict[int, np.ndarray]] = {}
    for lo in range(0, len(where), 512):
        part = where[lo : lo + 512]
        inputs = np.zeros((len(part), WINDOW), np.int64)
        for i, (k, s) in enumerate(part):
            c = codes(texts[k][s : s + WINDOW])
            inputs[i, : len(c)] = c
        for (k, s), row in zip(part, decode(w, inputs), strict=True):
            tags.setdefault(k, {})[s] = row
    centre = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for k, windows in tags.items():
        starts = sorted(windows)
        run_from = 0
        while run_from < len(starts):
            run_to = run_from + 1
            while run_to < len(starts) and starts[run_to] <= starts[run_to - 1] + STRIDE:
                run_to += 1
            origin, end = starts[run_from], min(len(texts[k]), starts[run_to - 1] + WINDOW)
            joined, depth = np.zeros(end - origin, np.int8), np.full(end - origin, -1)
            for s in starts[run_from:run_to]:
                n = min(WINDOW, end - s)
                own = slice(s - origin, s - origin + n)
                better = centre[:n] > depth[own]
                joined[own][better] = windows[s][:n][better]
                depth[own][better] = centre[:n][better]
            at = 0
            while at < len(joined):
                if joined[at] and joined[at] % 2 == 1:
                    kind, to = (int(joined[at]) - 1) // 2, at + 1
                    while to < len(joined) and joined[to] == 2 + 2 * kind:
                        to += 1
                    if valid(kind, texts[k][origin + at : origin + to]):
                        out[k].append((origin + at, kind, origin + to))
                    at = to
                else:
                    at += 1
            run_from = run_to
    return out


def all_spans(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and those of the others that overlap none of them."""
    kept = [m for m in more if not any(m[0] < e and s < m[2] for s, _, e in base)] if base else more
    return sorted({*base, *kept})


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a trigger, and one of each text wherever its length puts it; tags of their base spans."""
    for batch in batches:
        for _, texts in text_batches(batch, limit=SLICE_BYTES):
            rows, labels = [], []
            for text in (t.decode() for t in texts if t):
                spans = _labelled(text)
                for s in {*trigger_windows(text), len(text) * 7919 % max(1, len(text) - WINDOW + 1)}:
                    if any(a < s < b or a < s + WINDOW < b for a, _, b in spans):
                        continue  # cuts a span
                    own = [(a - s, k, b - s) for a, k, b in spans if a >= s and b <= s + WINDOW]
                    rows.append(text[s : s + WINDOW])
                    labels.append(tags_of(own, WINDOW).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(labels, pa.binary())], ["part", "tags"])


_NAMED = re.compile(r"(?i)(?:token|secret|password|passwd|key)[\"']? ?[:=] ?[\"']?([a-z0-9_+/-]{16,})")


def _labelled(text: str) -> list[tuple[int, int, int]]:
    """Base spans; values named as secrets; and numbers as long as a card's whose check digit is wrong, which
    no network sees, but valid() does.
    """
    found = base_spans(text)
    for m in _NAMED.finditer(text):
        if valid(4, m[1]) and not any(a < m.end(1) and m.start(1) < b for a, _, b in found):
            found.append((m.start(1), 4, m.end(1)))
    for m in _CARD.finditer(text):
        if 12 <= len(_digits(m[0])) <= 19 and not any(a < m.end() and m.start() < b for a, _, b in found):
            found.append((m.start(), 2, m.end()))
    return sorted(found)


def _fit(how: Tagger, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)][:windows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train_tagger(*make_examples(rows, how), how))], pa.binary())], ["weights"])

    return run


def train_pii(docs: DataFrame, *, windows: int = TRAIN_WINDOWS, how: Tagger = Tagger()) -> dict[str, np.ndarray] | None:
    """Tagger weights learned from at most ``windows`` windows of the documents; None without any text.

    The windows are the distinct ones with the smallest hashes. One task trains: its size is bounded by
    ``windows``, its work by ``how``.
    """
    import pickle

    found = docs.select("text").mapInArrow(lean(_training_windows), "part string, tags binary").withColumn("place", F.xxhash64("part"))
    sample = smallest(materialise(found.distinct(), "windows"), "place", windows)
    fitted = sample.repartition(1).sortWithinPartitions("place", "part", "tags").select("part", "tags").mapInArrow(lean(_fit(how, windows)), "weights binary").collect()
    return pickle.loads(fitted[0]["weights"]) if fitted else None


_SPANS = "array<struct<start: long, end: long, kind: string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _listed(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans]


def _texts(batch: pa.RecordBatch, column: int, w: dict[str, np.ndarray] | None) -> Iterator[tuple[int, list[str | None], list, list]]:
    """(first row, texts, base spans, all spans) of slices of a batch."""
    for lo, raw in text_batches(batch, batch.schema.names[column], SLICE_BYTES):
        texts = [None if t is None else t.decode() for t in raw]
        base = [base_spans(t or "") for t in texts]
        more = tagged_spans(w, [t or "" for t in texts]) if w else [[] for _ in texts]
        yield lo, texts, base, [all_spans(b, m) for b, m in zip(base, more, strict=True)]


def _find(w: dict[str, np.ndarray] | None, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts, base, spans in _texts(batch, 1, w):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)).cast(id_type), pa.array(map(_listed, base), _SPAN_TYPE), pa.array(map(_listed, spans), _SPAN_TYPE)], ["doc_id", "base", "spans"]
                )

    return run


def find_pii(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, base and spans (start, end, kind; code points, end exclusive) of every row of docs.

    docs: doc_id and text; other columns are ignored. Null texts are empty: no spans. Spans are sorted by start,
    then kind as listed in KINDS; base spans of different kinds may overlap. Repeated rows give the same result.
    Without a model (no text to learn from) spans are the base spans.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    return docs.mapInArrow(lean(_find(model, to_arrow_type(kind))), f"doc_id {kind.simpleString()}, base {_SPANS}, spans {_SPANS}")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the kind of the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _masked(w: dict[str, np.ndarray] | None, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts, _, spans in _texts(batch, column, w):
                part = batch.slice(lo, len(texts))
                new = pa.array([None if t is None else mask(t, s) for t, s in zip(texts, spans, strict=True)], part.column(column).type)
                yield part.set_column(column, part.schema.field(column), new)

    return run


def mask_pii(docs: DataFrame, model: dict[str, np.ndarray] | None, column: str = "text") -> DataFrame:
    """docs with personal data in ``column`` masked; all columns and rows stay, null stays null."""
    return docs.mapInArrow(lean(_masked(model, docs.columns.index(column))), docs.schema)
