"""Licence scan: Aho-Corasick finds tags and notices, a shunting-yard parser reads tag expressions.

One automaton over the words of the whole text (in lower case) finds every phrase and every identifier tag
in a single pass, with the number of its first word. Of phrases that begin at one word the longest counts, so
"cc by nc" is no mention of "cc by"; places of base phrases are all reported. The expression behind a tag is
read from the raw text: OR binds weakest, then AND, then WITH; it is turned to postfix form and evaluated against permitted
licences, as is every phrase.

The score is the chance that not all evidence misleads: a phrase counts by its own weight, a tag by
``TAG_WEIGHT``, or by ``STRANGE_WEIGHT`` if a name in its expression is no known licence. ``usable`` is the chance that some
evidence for permitted licences holds and none against. ``permitted`` is whether all of it is permitted, null
without evidence.

Null text is empty: no words, no finds, score 0. A tag with no readable expression counts as a mention
of no licence. Repeated documents are judged alike. Columns kept may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import extended, mapped
from tablekit.llm.words import BLANKED

#: phrase: label; places of these are reported one by one
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: phrase: (label, weight of the evidence); of phrases that begin at one word the longest counts
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "gnu general public license": ("gpl", 0.7),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "dedicated to the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.6),
    "licensed under the apache license": ("apache", 0.8),
    "cc by": ("cc-by", 0.5),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
}
BASE_WEIGHT, TAG_WEIGHT, STRANGE_WEIGHT = 0.9, 0.95, 0.7
TAG = "spdx license identifier"
#: licence identifiers with the labels they give; others give their own name
KNOWN = {
    "0bsd": "0bsd",
    "agpl-3.0": "agpl-3",
    "apache-2.0": "apache-2",
    "artistic-2.0": "artistic-2",
    "bsd-2-clause": "bsd-2",
    "bsd-3-clause": "bsd-3",
    "cc-by-4.0": "cc-by",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc0-1.0": "cc0",
    "epl-2.0": "epl-2",
    "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3",
    "isc": "isc",
    "lgpl-2.1": "lgpl-2",
    "lgpl-3.0": "lgpl-3",
    "mit": "mit",
    "mpl-2.0": "mpl-2",
    "unlicense": "unlicense",
    "zlib": "zlib",
}
PERMITTED = frozenset({"0bsd", "apache-2", "bsd-2", "bsd-3", "cc-by", "cc0", "isc", "mit", "unlicense", "zlib", "apache", "bsd", "public-domain"})
BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_OPERAND = re.compile(r"((?:[ \t]*+\()*+)[ \t]*+([A-Za-z0-9][A-Za-z0-9.+:-]*)")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def bare(name: str) -> str:
    """Without version suffixes, and without the stop or colon that ends a sentence."""
    return re.sub(r"(-only|-or-later|\+)$", "", name.lower().rstrip(".:"))


def label_of(name: str) -> str:
    name = bare(name)
    return KNOWN.get(name, name)


def is_licence(name: str) -> bool:
    """Whether a name after an operator is a licence and not a word of prose."""
    name = bare(name)
    return name in KNOWN or re.search("[0-9-]", name) is not None


def read_expression(text: str, at: int = 0) -> list[str] | None:
    """The licence expression that begins at a place of the text, in postfix form; what follows it is
    neither read nor judged, save the operand after an operator. An operator belongs to it only if an
    operand follows: any name as the first, after WITH or an operator in upper case, and in parentheses
    that close; elsewhere, where prose may follow, a known licence or a name with a digit or a hyphen.
    Parentheses left open close at the end; a single name in them has to be a licence by its looks. None if
    there is no expression."""
    out: list[str] = []
    stack: list[str] = []
    operand, depth = True, 0
    doubt: tuple[int, int, int, list[str]] | None = None  # what was read before a name that only parentheses let in
    while m := _TOKEN.match(text, at):
        t, at = m[1], m.end()
        low = t.lower()
        if operand:
            if t == "(":
                stack.append(t)
                depth += 1
            elif t == ")" or low in BINDS:
                return None
            else:
                out.append(t)
                operand = False
        elif t == ")":
            if not depth:
                break
            while (op := stack.pop()) != "(":
                out.append(op)
            depth -= 1
            if doubt and depth < doubt[0]:
                doubt = None
        elif low in BINDS:
            ahead = _OPERAND.match(text, at)
            if not ahead or ahead[2].lower() in BINDS or low == "with" and ahead[1]:
                break
            if not (low == "with" or t.isupper() or is_licence(ahead[2])):
                if not depth:
                    break
                if not doubt:
                    p = len(stack) - 1
                    while stack[p] != "(":
                        p -= 1
                    doubt = depth, len(out), p, stack[p:]  # what is below stays until this parenthesis closes
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            break
    if doubt:
        _, n, p, rest = doubt
        out, stack = out[:n], stack[:p] + rest
    if operand or depth and not stack[depth:] and len(out) == 1 and not is_licence(out[0]):
        return None
    return out + [t for t in reversed(stack) if t != "("]


def permitted(postfix: Iterable[str], allowed: frozenset[str] = PERMITTED) -> bool:
    """Whether the expression can be met with allowed licences; an exception never takes rights away."""
    stack: list[bool] = []
    for t in postfix:
        if t in BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a and b if t == "and" else a or b)
        else:
            stack.append(label_of(t) in allowed)
    return stack[0]


def licences_in(postfix: list[str]) -> set[str]:
    """Labels of the operands, without the exceptions: a WITH stands right behind its own."""
    return {label_of(t) for t, then in zip(postfix, [*postfix[1:], ""]) if t not in BINDS and then != "with"}


class Automaton:
    """Aho-Corasick over words: a phrase is a tuple of words."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.go: list[dict[bytes, int]] = [{}]
        self.out: list[tuple[tuple[str, int], ...]] = [()]
        for phrase in sorted(set(phrases)):
            words, at = phrase.encode().split(), 0
            for w in words:
                if w not in self.go[at]:
                    self.go.append({})
                    self.out.append(())
                    self.go[at][w] = len(self.go) - 1
                at = self.go[at][w]
            self.out[at] = ((phrase, len(words)),)
        # by breadth: the longest proper suffix that is a state, and what ends there too
        self.fail = [0] * len(self.go)
        queue = list(self.go[0].values())
        for at in queue:
            for w, to in self.go[at].items():
                f = self.fail[at]
                while f and w not in self.go[f]:
                    f = self.fail[f]
                self.fail[to] = self.go[f].get(w, 0)
                self.out[to] += self.out[self.fail[to]]
                queue.append(to)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, str]]:
        """(first word, phrase) of all places."""
        go, fail, out, at = self.go, self.fail, self.out, 0
        for i, w in enumerate(words):
            while at and w not in go[at]:
                at = fail[at]
            at = go[at].get(w, 0)
            if out[at]:
                for phrase, n in out[at]:
                    yield i - n + 1, phrase


def automaton() -> Automaton:
    return Automaton([*BASE, *NOTICES, TAG])


def scan_text(raw: bytes, a: Automaton) -> tuple[int, list[tuple[str, int]], list[tuple[str, int]], list[tuple[str, str, bool]], float]:
    """Of one text: words, (label, word) of base places, (label, word) of other notices, (expression,
    its licences, whether permitted), and the score."""
    words = raw.translate(BLANKED).split()
    base, longest, tags = [], {}, []
    for word, phrase in a.find(words):
        if phrase == TAG:
            tags.append(word)
            continue
        if phrase in BASE:
            base.append((BASE[phrase], word))
        if len(phrase) > len(longest.get(word, "")):
            longest[word] = phrase
    notices = sorted((NOTICES[p][0], w) for w, p in longest.items() if p in NOTICES)
    expressions = []
    if tags:
        after, wanted = {}, {t + 2 for t in tags}
        for n, m in enumerate(_WORD.finditer(raw)):
            if n in wanted:
                after[n - 2] = m.end()
        plain = raw.decode("latin-1")  # expressions are ASCII, and no token goes on beyond a line
        for t in tags:
            if plain.startswith(":", after[t]) and (postfix := read_expression(plain, after[t] + 1)):
                expressions.append((" ".join(postfix), ",".join(sorted(licences_in(postfix))), permitted(postfix)))
    weight = [BASE_WEIGHT] * len(base) + [NOTICES[p][1] for p in longest.values() if p in NOTICES] + [tag_weight(x[1]) for x in expressions]
    return len(words), sorted(base, key=lambda x: (x[1], x[0])), notices, expressions, chance(weight)


def chance(weights: Iterable[float]) -> float:
    """That not all of the evidence misleads."""
    return 1 - math.prod(1 - w for w in weights)


def tag_weight(licences: str) -> float:
    return TAG_WEIGHT if set(licences.split(",")) <= set(KNOWN.values()) else STRANGE_WEIGHT


def judged(base: list[tuple[str, int]], notices: list[tuple[str, int]], expressions: list[tuple[str, str, bool]]) -> tuple[bool | None, float]:
    """permitted and usable."""
    weigh = {label: w for label, w in NOTICES.values()}
    held = [(x in PERMITTED, BASE_WEIGHT) for x, _ in base] + [(x in PERMITTED, weigh[x]) for x, _ in notices]
    held += [(ok, tag_weight(names)) for _, names, ok in expressions]
    if not held:
        return None, 0.0
    return all(ok for ok, _ in held), chance(w for ok, w in held if ok) * (1 - chance(w for ok, w in held if not ok))


_FIND = pa.struct([("label", pa.string()), ("word", pa.int64())])
_EXPRESSION = pa.struct([("postfix", pa.string()), ("licences", pa.string()), ("permitted", pa.bool_())])
_PLACE = "array<struct<label:string,word:bigint>>"
RESULT = (
    f"n_words long, base {_PLACE}, notices {_PLACE}, expressions array<struct<postfix:string,licences:string,permitted:boolean>>, "
    "score double, permitted boolean, usable double"
)


def scan_licences(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` (but those with the names of results) with n_words, base and notices (label, word),
    expressions (postfix, licences, permitted), score, permitted, usable, labels (all, sorted)."""
    added = ("n_words", "base", "notices", "expressions", "score", "permitted", "usable", "labels")
    names = [c for c in keep if c not in added]
    kept = docs.select(*(col(c) for c in names), col(text).alias("_scanned"))
    schema = extended(kept.schema.fields[:-1], RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            rows = []
            for x in batch.column(len(names)).cast(pa.large_binary()):
                n, base, notices, expressions, score = scan_text(x.as_py() or b"", a)
                rows.append((n, base, notices, expressions, score, *judged(base, notices, expressions)))
            n, base, notices, expressions, score, ok, usable = zip(*rows) if rows else ((),) * 7

            def finds(some):
                return pa.array([[{"label": x, "word": w} for x, w in r] for r in some], pa.list_(_FIND))

            made = [
                pa.array(n, pa.int64()),
                finds(base),
                finds(notices),
                pa.array([[dict(zip(("postfix", "licences", "permitted"), x)) for x in r] for r in expressions], pa.list_(_EXPRESSION)),
                pa.array(score, pa.float64()),
                pa.array(ok, pa.bool_()),
                pa.array(usable, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, *added[:-1]])

    found = mapped(kept, run, schema)
    told = F.flatten(F.transform("expressions", lambda x: F.split(x["licences"], ",")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("notices.label"), told)))
    return found.withColumn("labels", labels)
