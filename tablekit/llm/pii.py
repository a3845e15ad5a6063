"""Personal data: exact patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns give the base spans. The random field works on regions: runs of tokens around digits and
``@`` with marks and words beside them, where alone a candidate can lie. Its segments are whole spans of up to ``MAX_TOKENS`` tokens,
scored by features of the entire span (its shape, counts of digits and marks, checksum, what stands
beside it), and dynamic programming over segment ends chooses boundaries and types together. A segment
counts as found if it is on the best path and the field gives it a probability of at least
``certainty``; it is added where no base span is.

Training is a bounded job on the driver: the regions of at most ``train_docs`` documents, labelled by
the patterns, with written variants of the same data ("00" for "+", marks between blanks, "[at]" or
" @ " for "@", dots in card numbers, two cards side by side) that the patterns don't cover. Weights follow the gradient of the conditional likelihood,
which takes forward and backward sums over all segmentations.

Offsets are in code points, ends exclusive. Null counts as empty text. Repeated documents are judged
alike. A region reaches to the blanks around it, however far, and one of any length is decoded; the work
grows with its tokens times ``MAX_TOKENS``. Only training is bounded: it leaves out regions of over
``train_tokens`` tokens and uses at most ``most`` kinds of cases.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm.base import extended, mapped, model, text_sample

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: candidates whose scores a task keeps
CACHED = 20_000
# the lookbehinds don't change what matches: a match that fails at the start of a run fails within it
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+$")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
_AT = ("@", "[at]", "(at)", "[at)", "(at]")
_MARK = re.compile(r"[^\w\s]|_")
# marks, each after a blank or none, up to the next trigger
_MARKS = re.compile(r"(?:\x20?(?![\[(]at[\])])(?:[^\w\s@]|_))*+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W0-9A-Za-z]+|[^\w\s]|_")
_NOT_DIGIT, _NUMBER = re.compile(r"[^0-9]"), re.compile(r"[0-9]+")
_SHAPE = {i: "a" for i in [*range(65, 91), *range(97, 123)]} | {i: "0" for i in range(48, 58)}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d - 9 if d > 9 else d for d in (2 * int(x) for x in digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern local@domain.tld, found from its @: leftmost, no overlaps, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans around triggers: blank-separated runs that hold a trigger, with the marks beside them
    and the word beside an @ or [at] that stands at the edge of its run; they belong together while no
    more than a blank is between."""
    now: list[tuple[int, int]] = []
    end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        least = max(end, 0)
        a, b = _run_start(text, m.start(), least), _run_end(text, m.end())
        if text.startswith(_AT, a) and a - 1 > least and text[a - 1] == " " and text[a - 2] > " ":
            a = _run_start(text, a - 1, least)
        while text.endswith(_AT, a, b) and text[b : b + 1] == " " and text[b + 1 : b + 2] > " ":
            b = _run_end(text, b + 1)
        while (x := a - (text[a - 1 : a] == " ")) > least and _MARK.match(text, x - 1):
            a = x - 1
        b = _MARKS.match(text, b).end()
        if now and (a > end + 1 or "\n" in text[end:a]):
            yield now
            now = []
        end = b
        now.extend(t.span() for t in _TOKEN.finditer(text, a, b))
    if now:
        yield now


_BLANK = re.compile(r"[\x00-\x20]")


def _run_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] > " ":
        at -= 1
    return at


def _run_end(text: str, at: int) -> int:
    m = _BLANK.search(text, at)
    return m.start() if m else len(text)


def features(key: tuple) -> list[str]:
    """Of a whole candidate: its shape with digits as 0 and letters as a, whether it starts with 00, its
    checksum and whether its numbers fit a byte (None where that means nothing), and what is beside it."""
    shape, zeros, check, small, before, after = key
    n, marks = shape.count("0"), "".join(sorted(set(shape) - set("a0")))
    runs = re.findall(r"0+", shape)
    f = ["bias", f"digits={min(n, 20)}", f"marks={marks}", f"first={shape[0]}", f"last={shape[-1]}"]
    f += [f"before={before}", f"after={after}", f"runs={min(len(runs), 6)}", f"dots={min(shape.count('.'), 5)}"]
    f += [f"letters={'a' in shape}", f"longest={min(max(map(len, runs), default=0), 20)}", f"kinds={len(marks)}"]
    at = shape.replace("[aa]", "@").replace("(aa)", "@")
    if "@" in at:
        user, _, host = at.partition("@")
        tail = host.rpartition(".")[2].strip()
        f += ["at", f"at:user={bool(user.strip())}", f"at:dots={min(host.count('.'), 3)}", f"at:n={min(at.count('@'), 2)}"]
        f += [f"at:tail={tail[-1:]}{len(tail) > 1}", f"at:blanks={min(at.strip().count(' '), 3)}"]
    if check is not None and "a" not in shape:
        f += [f"luhn={check}", f"luhn={check}:{n}"]
    if shape[0] == "+" or zeros:
        f += ["abroad", f"abroad:{min(n, 20)}"]
    if small is not None:
        f.append(f"small={small}:{bool(re.fullmatch('0+[.]0+[.]0+[.]0+', shape))}")
    return f


@dataclass
class Field:
    """Weights by (kind, feature). Scores are kept by all that features look at."""

    weights: dict = field(default_factory=dict)
    cache: dict = field(default_factory=dict)

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple]]:
        """(first token, token after the last, key) of all candidates: at least seven digits or a mark
        of an address, a plausible first and last token."""
        origin = tokens[0][0]
        raw = text[origin : tokens[-1][1]]
        shape = raw.translate(_SHAPE)
        for i, (a, _) in enumerate(tokens):
            a -= origin
            if shape[a] not in "a0+(":
                continue
            for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                b = tokens[j - 1][1] - origin
                s = shape[a:b]
                n = s.count("0")
                if s[-1] not in "a0" or n < 7 and "@" not in s and "[aa]" not in s and "(aa)" not in s and (s.count(".") != 3 or not n):
                    continue
                check = luhn(_NOT_DIGIT.sub("", raw[a:b])) if 15 <= n <= 19 else None
                small = all(len(x) <= 3 and int(x) <= 255 for x in _NUMBER.findall(raw[a:b])) if s.count(".") == 3 else None
                before = text[origin + a - 1 : origin + a].translate(_SHAPE) if origin + a else ""
                after = text[origin + b : origin + b + 1].translate(_SHAPE)
                yield i, j, (s, raw[a : a + 2] == "00", check, small, before, after)

    def scores(self, key: tuple) -> tuple[float, ...]:
        got = self.cache.get(key)
        if got is None:
            f = features(key)
            got = tuple(sum(self.weights.get((k, x), 0.0) for x in f) for k in KINDS)
            if len(key[0]) <= 48 and len(self.cache) < CACHED:
                self.cache[key] = got
        return got

    def lattice(self, text: str, tokens: list[tuple[int, int]], keys: bool = True):
        """Segments with scores, by their first token; with their keys where training needs them."""
        by_start: list[list] = [[] for _ in tokens]
        for i, j, key in self.segments(text, tokens):
            by_start[i].append((j, key if keys else None, self.scores(key)))
        return by_start

    def decode(self, text: str, tokens: list[tuple[int, int]], certainty: float) -> list[tuple[str, int, int]]:
        by_start, n = self.lattice(text, tokens, keys=False), len(tokens)
        if not any(by_start):
            return []
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] > best[i + 1]:
                best[i + 1], back[i + 1] = best[i], (i, None)
            for j, _, scores in by_start[i]:
                for k, x in zip(KINDS, scores):
                    if best[i] + x > best[j]:
                        best[j], back[j] = best[i] + x, (i, k)
        path, j = [], n
        while j:
            i, k = back[j]
            if k:
                path.append((k, i, j))
            j = i
        if not path:
            return []
        forward, backward = sums(by_start, n)
        out = []
        for k, i, j in path:
            x = next(s[KINDS.index(k)] for e, _, s in by_start[i] if e == j)
            if math.exp(forward[i] + x + backward[j] - forward[n]) >= certainty:
                out.append((k, tokens[i][0], tokens[j - 1][1]))
        return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def sums(by_start: list[list], n: int) -> tuple[list[float], list[float]]:
    """Logarithms of the sums over all segmentations of the tokens before, and from, each place."""
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    for i in range(n):
        forward[i + 1] = _add(forward[i + 1], forward[i])
        for j, _, scores in by_start[i]:
            for x in scores:
                forward[j] = _add(forward[j], forward[i] + x)
    for i in range(n - 1, -1, -1):
        backward[i] = backward[i + 1]
        for j, _, scores in by_start[i]:
            for x in scores:
                backward[i] = _add(backward[i], x + backward[j])
    return forward, backward


def gold(tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]] | None:
    """Spans as token segments, longest first where kinds overlap; None if one doesn't fit the tokens."""
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    out: list[tuple[str, int, int]] = []
    for k, a, b in sorted(spans, key=lambda s: s[1] - s[2]):
        if b <= tokens[0][0] or a >= tokens[-1][1]:
            continue
        if a not in starts or b not in ends or ends[b] - starts[a] > MAX_TOKENS:
            return None
        i, j = starts[a], ends[b]
        if all(j <= x or y <= i for _, x, y in out):
            out.append((k, i, j))
    return out


def variants(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """A text with one span written another way, for each way; without a span, what is no address because
    its host has no dot, and no number from abroad."""
    for k, a, b in spans:
        raw = text[a:b]
        abroad = raw.replace("+", "00", 1)
        others = {
            "phone": [abroad, *(re.sub(r"[\x20().-]+", x, abroad) for x in (" - ", " / "))],
            "email": [raw.replace("@", x, 1) for x in ("[at]", " [at] ", " @ ")],
            "card": [".".join(raw[i : i + 4] for i in range(0, len(raw), 4))] if raw.isdigit() else [],
        }.get(k, [])
        lo, hi = max(0, a - 40), min(len(text), b + 40)
        if not any(s[0] != k and s[1] < b and a < s[2] for s in spans):
            for other in others:
                if other != raw:
                    yield text[lo:a] + other + text[b:hi], [(k, a - lo, a - lo + len(other))]
        if k == "phone":
            for x in (" - ", " / "):
                yield re.sub(r"[\x20().-]+", x, raw).partition(x)[2], []
        if k == "card" and raw.isdigit():
            yield f"{raw} {raw}", [(k, 0, b - a), (k, b - a + 1, 2 * (b - a) + 1)]
        if k == "email":
            user, _, host = raw.partition("@")
            _, _, rest = host.partition(".")
            for x in (" [at] ", " @ "):
                if "." in rest:
                    yield user + x + rest, [(k, 0, len(user + x + rest))]
                yield user + x + host.rpartition(".")[2], []


def fit(texts: list[str], epochs: int = 40, rate: float = 0.3, seed: int = 3, most: int = 1500, train_tokens: int = 200) -> Field:
    """Stochastic gradient on the conditional likelihood of the regions' segmentations. Regions that
    look alike are one case that counts by the root of its number; at most ``most`` cases are used, and no
    region of over ``train_tokens`` tokens."""
    crf, rng = Field(), random.Random(seed)
    cases: dict[tuple, tuple] = {}
    times: Counter = Counter()
    for text in texts:
        spans = base_spans(text)
        own = [(text, spans), *variants(text, spans)]
        for t, marked in own:
            for tokens in regions(t):
                if not tokens or len(tokens) > train_tokens:
                    continue
                inside = [s for s in marked if s[1] < tokens[-1][1] and tokens[0][0] < s[2]]
                if t is not text and marked and not inside:
                    continue  # what else is near a variant has no labels
                if (target := gold(tokens, inside)) is not None:
                    look = (*(seg[2] for seg in crf.segments(t, tokens)), tuple(target))
                    cases.setdefault(look, (t, tokens, target))
                    times[look] += 1
    some = [(*cases[k], math.sqrt(times[k])) for k in sorted(cases, key=repr)]
    rng.shuffle(some)
    some = some[:most]
    epochs = max(epochs, 12000 // max(1, len(some)))
    for epoch in range(epochs):
        rng.shuffle(some)
        step = rate / (1 + 4 * epoch / epochs)
        for text, tokens, target, often in some:
            crf.cache.clear()
            by_start, n = crf.lattice(text, tokens), len(tokens)
            if not any(by_start):
                continue
            wanted = {(i, j): k for k, i, j in target}
            forward, backward = sums(by_start, n)
            change: Counter = Counter()
            for i, rest in enumerate(by_start):
                for j, key, scores in rest:
                    f = None
                    for k, x in zip(KINDS, scores):
                        g = (wanted.get((i, j)) == k) - math.exp(min(0.0, forward[i] + x + backward[j] - forward[n]))
                        if abs(g) > 1e-4:
                            f = f or features(key)
                            for name in f:
                                change[k, name] += g
            for name, g in change.items():
                crf.weights[name] = crf.weights.get(name, 0.0) * (1 - 1e-4) + step * min(often, 8.0) * g
    crf.cache.clear()
    return crf


def train(docs: DataFrame, text: str = "text", train_docs: int = 800, train_chars: int = 1 << 15) -> Field:
    """The field from at most ``train_docs`` texts with a digit or @, of at most ``train_chars``
    characters, picked by a hash of the text."""
    rows = docs.select(F.col(text).alias("text")).where(F.rlike("text", F.lit("[0-9@]")) & (F.length("text") <= train_chars))
    return fit(sorted(text_sample(rows, train_docs).toArrow().column("text").to_pylist()))


def all_spans(text: str, crf: Field, certainty: float = 0.7) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base with those the field adds, each by kind, then start."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    extra = []
    for tokens in regions(text):
        for k, a, b in crf.decode(text, tokens, certainty) if tokens else ():
            if all(b <= x or y <= a for x, y in taken):
                extra.append((k, a, b))
    every = sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1])) if extra else base
    return base, every


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find_personal_data(docs: DataFrame, crf: Field, text: str = "text", certainty: float = 0.7, mask: bool = False) -> DataFrame:
    """The columns of ``docs`` with base and spans (kind, start, end), in place of columns of that name. With ``mask`` every span of the
    text is replaced by its kind in brackets, overlapping ones by that of the first."""
    docs = docs.drop(*({"base", "spans"} & set(docs.columns)))
    shared = model(docs.sparkSession, crf)
    names = docs.columns
    span = "array<struct<kind:string,start:int,end:int>>"
    schema = extended(docs.schema.fields, f"base {span}, spans {span}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(shared.value.weights)  # its cache ends with the task
        for batch in batches:
            base, every, masked = [], [], []
            for x in batch.column(text):
                raw = x.as_py()
                b, s = all_spans(raw or "", own, certainty)
                base.append([dict(zip(("kind", "start", "end"), y)) for y in b])
                every.append([dict(zip(("kind", "start", "end"), y)) for y in s])
                masked.append(blanked(raw, s) if mask and s else raw)
            columns = [pa.array(masked, batch.column(text).type) if mask and n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base, pa.list_(_SPAN)), pa.array(every, pa.list_(_SPAN))], names=[*names, "base", "spans"])

    return mapped(docs, run, schema)


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
