"""Personal data: exact base patterns, and a semi-Markov CRF that adds spans.

Base spans are the leftmost, non-overlapping matches of four patterns (email,
ip, card, phone) that pass their checks; they always stay.

The semi-Markov conditional random field works on atoms (runs of letters and
digits, white-space runs, single symbols). A segment is a run of at most
MAX_ATOMS atoms with a type; it is scored as a whole, by its shape, digit
count, checksum, octets, separators, quotes and the words around it. Dynamic
programming over (atom, type of the last segment) chooses boundaries and types
together; an atom outside entities is a segment of type `out`. A segment of an
entity type holds a digit or an @ and seven characters at least, and begins and
ends at a letter, a digit or a bracket, so the recursion splits exactly into
regions around such atoms and the rest of the text costs nothing. Regions of
any length are walked whole; the work grows with their length alone.

Weights are learned by maximum likelihood (forward-backward over segments) on
sentences that a seeded generator writes: entities in many notations, and
decoys such as versions, prices, dates, failed checksums and long counters.
The added kinds are email, ip, card and phone in notations that the base
misses, and `secret` (keys and tokens).

Added spans never overlap base spans. Cases: null and empty texts have no
spans. Texts of any length, with or without spaces, are read whole. Of equally
good segmentations the first found stays: `out` before entities, types in the
order of TYPES. An empty table gives no rows. Repeated rows get equal results. Extra columns are ignored. Offsets
count code points.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

KINDS = ("email", "ip", "card", "phone")
TYPES = ("out", "email", "ip", "card", "phone", "secret")
ORDER = {k: i for i, k in enumerate((*KINDS, "secret"))}
MAX_ATOMS = 24

# The base patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these two can only begin at the first digit of a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """The contract's spans by start, then kind."""
    found = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if len(m[0]) < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found.extend(("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


_ATOM = re.compile(r"[^\W_]+|\s+|.", re.S)
_SIGNAL = re.compile(r"[0-9@]")
_CUES = {
    "email": {"mail", "email", "contact", "write", "address", "mailto"}, "phone": {"phone", "tel", "call", "mobile", "fax", "telefon"}, "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "credit", "karte"}, "secret": {"token", "key", "secret", "password", "apikey", "api"},
}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws}


def _shape(text: str) -> str:
    out = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 5 else "99", text))
    return re.sub(r"\s+", "_", re.sub(r"(?:a?(?:99?a)+(?:99?)?|99?a(?:99?)?|a99?)", "m", out))[:40]


class Region:
    """Atoms around signals, with the features of every candidate segment."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        spots = [(m.start(), m.end()) for m in _ATOM.finditer(text, start, end)]
        self.spots = spots
        self.candidates: list[list[tuple[int, list[str]]]] = [[] for _ in spots]
        word = ""
        signal = [bool(_SIGNAL.search(text, a, b)) for a, b in spots]
        cue = []
        for a, b in spots:
            cue.append(word)
            if text[a].isalpha():
                word = _CUE_OF.get(text[a:b].lower(), "") or word * (b - a < 3)
        for i, (a, _) in enumerate(spots):
            first = text[a]
            if not (first.isalnum() or first in "+("):
                continue
            if i and text[spots[i - 1][0]].isalnum():
                continue
            seen = False
            for j in range(i, min(len(spots), i + MAX_ATOMS)):
                c = text[spots[j][0]]
                if c == "\n" or c.isspace() and spots[j][1] - spots[j][0] > 2:
                    break
                seen = seen or signal[j]
                b = spots[j][1]
                if not seen or b - a < 7 or not (c.isalnum() or c == ")"):
                    continue
                self.candidates[j].append((i, self._features(i, j, a, b, cue[i])))

    def _features(self, i: int, j: int, a: int, b: int, cue: str) -> list[str]:
        text = self.text[a:b]
        digits = _digits(text)
        n, letters = len(digits), sum(c.isalpha() for c in text)
        parts = text.split(".")
        before = self.text[a - 1] if a else " "
        after = self.text[b] if b < len(self.text) else " "
        spaces = text.count(" ")
        out = ["bias", f"shape={_shape(text)}", f"digits={min(n, 20)}", f"spaces={min(spaces, 4)}", f"cue={cue}", f"before={'s' if before.isspace() else 'w' if before.isalnum() else before}", f"after={'s' if after.isspace() else 'w' if after.isalnum() else after}"]
        if "@" in text:
            host = text.rpartition("@")[2]
            out.append(f"at={text.count('@')},{'.' in host},{spaces > 0}")
        if not letters:
            out.append(f"plain={'+' if text[0] == '+' else '('if text[0] == '(' else '9'}{'p' if '(' in text else ''}{'-' if '-' in text else ''}{'.' if '.' in text else ''},{min(n, 20)}")
            if 12 <= n <= 19:
                out.append(f"luhn={luhn(digits)}")
            if len(parts) == 4 and all(p.isdigit() for p in parts):
                out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
        elif n and text.isalnum():
            hexed = all(c in "0123456789abcdefABCDEF" for c in text)
            out.append(f"mixed={min(len(text) // 8, 6)},{hexed}")
            out.append(f"quoted={before == after and before in chr(34) + chr(39)},{len(text) >= 16}")
        else:
            out.append(f"words={min(letters // 4, 6)},{n > 0},{spaces > 0}")
        return out


#: Atoms before a candidate whose words can be its cue.
_CUE_REACH = 16


def regions(text: str) -> list[tuple[int, int]]:
    """Ranges around digits and @ signs that hold every candidate segment: a segment's longest reach in atoms to both sides, the words of its cue, and the atom after it."""
    spots = [(m.start(), m.end()) for m in _ATOM.finditer(text)]
    found: list[tuple[int, int]] = []
    for k, (a, b) in enumerate(spots):
        if not _SIGNAL.search(text, a, b):
            continue
        first, last = max(0, k - MAX_ATOMS - _CUE_REACH), min(len(spots), k + MAX_ATOMS + 1)
        if found and first <= found[-1][1]:
            found[-1] = (found[-1][0], last)
        else:
            found.append((first, last))
    return [(spots[a][0], spots[b - 1][1]) for a, b in found]


class Model:
    """Weights of (feature, type) and of neighbouring segment types."""

    def __init__(self, weights: dict[str, list[float]], change: list[list[float]]):
        self.weights, self.change = weights, change

    def scores(self, features: list[str]) -> list[float]:
        total = [0.0] * len(TYPES)
        for f in features:
            w = self.weights.get(f)
            if w:
                for k in range(1, len(TYPES)):
                    total[k] += w[k]
        return total

    def best(self, region: Region) -> list[tuple[int, int, int]]:
        """(first atom, last atom, type) of the entity segments of the best segmentation."""
        n, kinds = len(region.spots), len(TYPES)
        value = [[-math.inf] * kinds for _ in range(n + 1)]
        back: list[list] = [[None] * kinds for _ in range(n + 1)]
        value[0][0] = 0.0
        for j in range(n):
            for k in range(kinds):
                v = value[j][k]
                if v > -math.inf and v + self.change[k][0] > value[j + 1][0]:
                    value[j + 1][0], back[j + 1][0] = v + self.change[k][0], (j, k)
            for i, features in region.candidates[j]:
                s = self.scores(features)
                for t in range(1, kinds):
                    for k in range(kinds):
                        v = value[i][k] + self.change[k][t] + s[t]
                        if v > value[j + 1][t]:
                            value[j + 1][t], back[j + 1][t] = v, (i, k)
        out, j = [], n
        t = max(range(kinds), key=lambda k: value[n][k])
        while j:
            i, k = back[j][t]
            if t:
                out.append((i, j - 1, t))
            j, t = i, k
        return out[::-1]


def _lse(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def train(examples: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.5) -> Model:
    """Maximum likelihood by AdaGrad; the gradient is gold minus expected segment counts."""
    kinds = len(TYPES)
    weights: dict[str, list[float]] = defaultdict(lambda: [0.0] * kinds)
    squares: dict[str, list[float]] = defaultdict(lambda: [1.0] * kinds)
    model = Model(weights, [[0.0] * kinds for _ in range(kinds)])
    square_change = [[1.0] * kinds for _ in range(kinds)]
    prepared = []
    for text, spans in examples:
        region = Region(text, 0, len(text))
        starts, ends = {a: i for i, (a, _) in enumerate(region.spots)}, {b: i for i, (_, b) in enumerate(region.spots)}
        gold = {(starts[a], ends[b]): TYPES.index(k) for k, a, b in spans if a in starts and b in ends}
        prepared.append((region, gold))
    for _ in range(epochs):
        for region, gold in prepared:
            n = len(region.spots)
            scored = [[(i, f, model.scores(f)) for i, f in row] for row in region.candidates]
            ahead = [[-math.inf] * kinds for _ in range(n + 1)]
            ahead[0][0] = 0.0
            for j in range(n):
                ahead[j + 1][0] = _lse([ahead[j][k] + model.change[k][0] for k in range(kinds)])
                for t in range(1, kinds):
                    into = [_lse([ahead[i][k] + model.change[k][t] for k in range(kinds)]) + s[t] for i, _, s in scored[j]]
                    if into:
                        ahead[j + 1][t] = _lse(into)
            behind = [[-math.inf] * kinds for _ in range(n + 1)]
            behind[n] = [0.0] * kinds
            opens = defaultdict(list)
            for j in range(n):
                for i, f, s in scored[j]:
                    opens[i].append((j, f, s))
            for i in range(n - 1, -1, -1):
                for k in range(kinds):
                    out = [model.change[k][0] + behind[i + 1][0]]
                    out += [model.change[k][t] + s[t] + behind[j + 1][t] for j, _, s in opens[i] for t in range(1, kinds)]
                    behind[i][k] = _lse(out)
            total = _lse(ahead[n])
            slope: dict[str, list[float]] = defaultdict(lambda: [0.0] * kinds)
            moves = [[0.0] * kinds for _ in range(kinds)]
            for i in range(n):
                for k in range(kinds):
                    if ahead[i][k] == -math.inf:
                        continue
                    moves[k][0] -= math.exp(ahead[i][k] + model.change[k][0] + behind[i + 1][0] - total)
                    for j, f, s in opens[i]:
                        for t in range(1, kinds):
                            p = math.exp(min(0.0, ahead[i][k] + model.change[k][t] + s[t] + behind[j + 1][t] - total))
                            if p > 1e-5:
                                moves[k][t] -= p
                                for name in f:
                                    slope[name][t] -= p
            last, i = 0, 0
            by_start = {a: (b, t) for (a, b), t in gold.items()}
            while i < n:
                if i in by_start:
                    b, t = by_start[i]
                    for name in next((f for a, f in region.candidates[b] if a == i), []):
                        slope[name][t] += 1
                    moves[last][t] += 1
                    last, i = t, b + 1
                else:
                    moves[last][0] += 1
                    last, i = 0, i + 1
            for name, g in slope.items():
                w, q = weights[name], squares[name]
                for t in range(1, kinds):
                    d = g[t] - 0.002 * w[t]
                    q[t] += d * d
                    w[t] += rate * d / math.sqrt(q[t])
            for k in range(kinds):
                for t in range(kinds):
                    square_change[k][t] += moves[k][t] ** 2
                    model.change[k][t] += rate * moves[k][t] / math.sqrt(square_change[k][t])
    return Model(dict(weights), model.change)


def examples(count: int = 260, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Sentences with entities and decoys, written by a seeded generator."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "the", "ion", "lo", "mi", "st", "é", "ch", "ra")) for _ in range(r.randint(1, 4)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(good: bool) -> str:
        while True:
            d = r.choice("3456") + number(r.choice((14, 15, 15, 15)))
            if luhn(d) == good:
                return d

    def entity() -> tuple[str, str]:
        kind = r.choice(("email", "ip", "card", "phone", "phone", "secret"))
        if kind == "email":
            host = f"{word()}{number(1)}.{word()}.{r.choice(('com', 'org', 'net'))}".replace("é", "e")
            name = f"{word()}.{number(2)}".replace("é", "e")
            return kind, r.choice((f"{name}@{host}", f"{name}@{host}", f"{name} @ {host}"))
        if kind == "ip":
            parts = [str(r.randint(1, 255)) for _ in range(4)]
            return kind, r.choice((".".join(parts), ".".join(parts), " . ".join(parts)))
        if kind == "card":
            d = card(True)
            return kind, r.choice((d, " ".join(re.findall(".{1,4}", d)), "-".join(re.findall(".{1,4}", d)), ".".join(re.findall(".{1,4}", d))))
        if kind == "phone":
            a, b, c = number(3), number(3), number(4)
            return kind, r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b}{c}", f"00{number(2)} {a} {b} {c}", f"({a}){b}-{c}"))
        return kind, "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 40, 64))))

    def decoy() -> str:
        return r.choice((
            number(r.randint(1, 11)), number(16), card(False), f"{r.randint(1, 9)}.{r.randint(0, 9)}.", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            f"${number(3)}.{number(2)}", f"{number(3)},{number(3)},{number(3)}", f"{number(2)}:{number(2)}:{number(2)}", f"@{word()}", f"{word()}{number(2)}", f"{number(3)}.{number(3)}.{r.randint(300, 999)}.{number(3)}", f"{number(4)} {number(4)}", f"{number(2)}/{number(2)}/{number(4)}",
        ))

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 3))) + " "
            if r.random() < 0.6:
                kind, value = entity()
                if kind == "secret":
                    text += r.choice(('token = "', "key: '", 'secret="', "token "))
                elif r.random() < 0.3:
                    text += r.choice(sorted(_CUES[kind])) + r.choice((" ", ": "))
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
                if kind == "secret" and text[spans[-1][1] - 1] in "\"'":
                    text += text[spans[-1][1] - 1]
            else:
                text += decoy()
            text += r.choice((" ", ", ", ". ", "!! ", "%%% ", " | "))
        out.append((text, spans))
    return out


_trained: dict[tuple[int, int], Model] = {}


def default_model(count: int = 260, seed: int = 5) -> Model:
    """The model of the seeded examples; trained once in a process."""
    if (count, seed) not in _trained:
        _trained[count, seed] = train(examples(count, seed))
    return _trained[count, seed]


def find(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a whole text."""
    if not _SIGNAL.search(text):
        return [], []
    base = base_spans(text)
    added = []
    for a, b in regions(text):
        region = Region(text, a, b)
        for i, j, t in model.best(region):
            span = (TYPES[t], region.spots[i][0], region.spots[j][1])
            if all(span[2] <= s[1] or span[1] >= s[2] for s in _around(base, span)):
                added.append(span)
    return base, sorted(base + added, key=lambda s: (s[1], ORDER[s[0]]))


def _around(spans: list[Span], span: Span) -> list[Span]:
    return [s for s in spans if s[1] < span[2] and s[2] > span[1]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def scan(docs: DataFrame, model: Model | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of base spans, their digest, and all spans of every whole text."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = find(text or "", shared.value)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)
