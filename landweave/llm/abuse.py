"""Abusive, hateful and sexual content by a weighted finite-state grammar over clauses.

A text runs through a cascade of transducers, each reading what the one before wrote:

1. tokens: a written token becomes a word of the lexicon through its disguises (other scripts'
   look-alikes, figures and stars for letters, letters drawn out or set apart, slips of the finger);
2. classes: a word becomes the classes it belongs to (insults, contempt, harm, bodies, persons,
   groups, denial, speech and so on), in English, Hindi, Marathi and romanised Hindi;
3. target, insult, threat, contempt for groups and sexual content: machines over classes, each
   with optional arcs and bounded gaps, that may read what earlier machines accepted;
4. negation, self and mention: what stands before an accepted phrase and takes its weight off;
   reported speech: what stands before it and lets it pass, as quoted abuse counts too.

No word counts on its own: an event needs a phrase with its target, victim or predicate in one
clause. A clause's set of accepted machines is weighed and the document has the score of its best
clause, between 0 and 1. ``fit`` gets the weights from labelled documents.

The positions at which a class or machine accepts are the bits of a whole number, so a machine
runs over all positions of a clause at once, an arc in a few operations.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.abuse_grammar import CLASSES, EVENTS, MACHINES, MODIFIERS, WEIGHTS

#: Score from which a document counts as abusive.
THRESHOLD = 0.5
#: Labelled documents that a fit of the weights takes at most.
FIT_ROWS = 20_000
#: Bias of a clause in which nothing is accepted, prior weight of a machine, and strength of the prior.
BIAS, PRIOR, STRENGTH = -4.0, 5.0, 0.5

#: Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсхуіѕјһԁɡӏкмтвнαοερικνυτ’", "aeopcxyisjhdglkmtbhaoepiknut'")
_PIECE = regex.compile(r"[\p{L}\p{M}\p{N}@$!*'_]+|[.!?।\n\r]+(?=\s|$)|[,;:]| {2,}")
_HIDDEN = regex.compile(r"\p{Cf}")
#: Single letters set apart by one blank, dot, hyphen or star.
_APART = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:[\p{L}@$0-9][ .\-*_]){2,}[\p{L}@$0-9](?![\p{L}\p{M}\p{N}])")
_HYPHEN = regex.compile(r"(?<=\p{L})-(?=\p{L}{2})|(?<=\p{L}{2})-(?=\p{L})")
_MASK = regex.compile(r"[0-9@$!*_]")
_CODE = regex.compile(r"\d+[a-z]{1,2}\d*|[a-z]{1,3}\d+|[\d_]+|!+|'+")
_FIGURES = str.maketrans("013457@$!", "oieastasi")
_COMMA = "\1"
#: Marks of a clause's frame, beside its classes.
_FRAME = ("START", "END", "COMMA", "LAST")


def _squeeze(w: str) -> str:
    return regex.sub(r"(.)\1+", r"\1", w)


class Machine:
    """A linear transducer over class masks: arcs with gaps, optional arcs, and the class it writes."""

    def __init__(self, name: str, line: str):
        """``line`` has arcs in order; ``A|B`` is a choice, ``A?`` may be left out, ``~n`` before an arc frees n tokens."""
        self.name = name
        self.arcs: list[tuple[tuple[str, ...], int, bool]] = []
        gap = 0
        for item in line.split():
            if item.startswith("~"):
                gap = int(item[1:])
                continue
            free = item.endswith("?")
            self.arcs.append((tuple(item.rstrip("?").split("|")), gap, free))
            gap = 0

    def run(self, masks: dict[str, int]) -> int:
        """End positions of what is accepted."""
        state = -1
        for names, gap, free in self.arcs:
            here = 0
            for n in names:
                here |= masks.get(n, 0)
            if state == -1:
                nxt = here
            else:
                reach = state << 1
                for _ in range(gap):
                    reach |= reach << 1
                nxt = reach & here
            if free:
                nxt = nxt | state if state != -1 else -1
            state = nxt
            if not state:
                return 0
        return 0 if state == -1 else state


class Grammar:
    """The compiled lexicon, token transducer and machines."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = dict(WEIGHTS if weights is None else weights)
        self.of: dict[str, tuple[str, ...]] = {}
        of: dict[str, set[str]] = defaultdict(set)
        for name, words in CLASSES.items():
            for w in words.split():
                of[w].add(name)
        self.machines: list[Machine] = []
        for name, lines in MACHINES.items():
            for line in lines.strip().splitlines():
                self.machines.append(Machine(name, line))
        used = {n for m in self.machines for a, _, _ in m.arcs for n in a} | {n for m in MODIFIERS.values() for n in m.split()}
        for n in used:  # words written into the machines themselves are classes of one word
            if n not in CLASSES and n not in MACHINES:
                of[n].add(n)
        for w in list(of):  # a plural that some class lists by itself keeps the classes of its singular
            if w.endswith("s") and w[:-1] in of and len(w) > 3:
                of[w] |= of[w[:-1]]
        self.of = {w: tuple(sorted(c)) for w, c in of.items()}
        self.modifiers = {k: tuple(v.split()) for k, v in MODIFIERS.items()}
        # Classes and machines as bits: which machines a clause's classes can drive is worked out once a set of classes.
        names = sorted({c for cs in self.of.values() for c in cs} | set(MACHINES) | {*_FRAME, *used})
        self.id = {n: 1 << i for i, n in enumerate(names)}
        self.bits = {w: sum(self.id[c] for c in cs) for w, cs in self.of.items()}
        self.always = sum(self.id[n] for n in _FRAME)
        self.needs = [(m, [sum(self.id[n] for n in set(a)) for a, _, free in m.arcs if not free]) for m in self.machines]
        self.driven: dict[int, list[Machine]] = {}
        light = {"COP", "HICOP", "ART", "DEM", "NEG", "I", "HE", "THEY", "YOU", "MODAL", "LIKE"}
        #: Words that a misspelt or masked token may stand for.
        self.heavy = {w for w, c in self.of.items() if not set(c) <= light}
        self.by_squeezed: dict[str, str] = {}
        self.by_length: dict[int, list[str]] = defaultdict(list)
        self.by_deletion: dict[str, set[str]] = defaultdict(set)
        # What is masked or misspelt is an insult sooner than another word.
        rank = lambda w: ("FUCK" not in self.of[w], not {"STRONG", "WEAK", "ADJ"} & set(self.of[w]), w)
        for w in sorted(self.of, key=rank):
            self.by_squeezed.setdefault(_squeeze(w), w)
            if w in self.heavy and len(w) >= 3:
                self.by_length[len(w)].append(w)
            if w in self.heavy and len(w) >= 6:
                for d in (w, *(w[:k] + w[k + 1 :] for k in range(len(w)))):
                    self.by_deletion[d].add(w)
        self.read: dict[str, str | None] = {}

    # ---- the token transducer

    def word(self, piece: str) -> str | None:
        """What a piece of text stands for: a word of the lexicon, "" for any other, a comma, or null for a clause's end."""
        try:
            return self.read[piece]
        except KeyError:
            if len(self.read) > 500_000:
                self.read.clear()
            c = piece[0]
            if c.isalnum() or c in "@$*'_" or c == "!" and piece.strip("!"):
                w: str | None = self._word(piece) or ""
            else:
                w = _COMMA if c in ",;:" else None
            self.read[piece] = w
            return w

    def _plain(self, w: str) -> str | None:
        if w in self.of:
            return w
        for end, put in (("'s", ""), ("s", ""), ("es", ""), ("ies", "y"), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("d", "")):
            if w.endswith(end) and len(w) - len(end) >= 3 and w[: -len(end)] + put in self.of:
                return w[: -len(end)] + put
        if w.endswith("ing") and len(w) > 6 and w[-4] == w[-5] and w[:-4] in self.of:
            return w[:-4]
        return None

    def _word(self, token: str) -> str | None:
        bare = token.strip("_'!*")
        for form in (token, bare):
            if form and (w := self._plain(form)):
                return w
        if not bare or _CODE.fullmatch(bare):
            return None
        if _MASK.search(token):
            letters = sum(c.isalpha() for c in token)
            if not (letters >= 2 and letters >= 0.4 * len(token) or bare[:1].isalpha() and token.count("*") >= 3):
                return None
            for form in (token.replace("_", ""), token.translate(_FIGURES).strip("*_"), token.rstrip("!").translate(_FIGURES), _squeeze(token.translate(_FIGURES))):
                if w := self._plain(form):
                    return w
            for form in (token, token.rstrip("!"), token.strip("_")):  # stars and figures for any letter
                for cut in (form, form[:-1] if form.endswith("s") else ""):
                    if len(cut) >= 4 and cut[0] != "*":
                        pattern = regex.compile("".join("." if _MASK.match(c) else regex.escape(c) for c in cut))
                        for x in self.by_length.get(len(cut), ()):
                            if pattern.fullmatch(x):
                                return x
            return None
        s = _squeeze(bare)
        if len(s) >= 3 and (regex.search(r"(.)\1\1", bare) or len(s) >= 5):
            for form in (s, s[:-1] if s.endswith("s") else s):
                if form in self.by_squeezed:
                    return self.by_squeezed[form]
        if len(bare) >= 6:
            near: set[str] = set(self.by_deletion.get(bare, ()))
            for k in range(len(bare)):
                near |= self.by_deletion.get(bare[:k] + bare[k + 1 :], set())
            near = {x for x in near if abs(len(x) - len(bare)) <= 1 and x[0] == bare[0]}
            if near:
                return min(near, key=lambda x: (abs(len(x) - len(bare)), x))
        return None

    def _join(self, m: regex.Match) -> str:
        """Letters set apart, joined where they make a word, also after a leading article."""
        w = regex.sub(r"[ .\-*_]", "", m.group())
        if not self.word(w) and w[:1] in "ai" and self.word(w[1:]):
            return f"{w[0]} {w[1:]}"
        return w if self.word(w) else m.group()

    def clauses(self, text: str) -> Iterator[list[str]]:
        """Words of each clause; "" stands for a token that isn't in the lexicon."""
        t = unicodedata.normalize("NFKC", text)
        t = _HIDDEN.sub("", t).lower().translate(_LOOKALIKE)
        t = _APART.sub(self._join, t)
        if "-" in t:
            t = _HYPHEN.sub(" ", t)
        read, word, words = self.read, self.word, []
        for piece in _PIECE.findall(t):
            w = read[piece] if piece in read else word(piece)
            if w is not None:
                words.append(w)
            elif words:
                yield words
                words = []
        if words:
            yield words

    # ---- the machines

    def _drive(self, have: int) -> list[Machine]:
        """Machines, in order, that may accept in a clause of these classes; none where no event can come of it."""
        at, out = have, []
        for m, needs in self.needs:
            if all(at & n for n in needs):
                out.append(m)
                at |= self.id[m.name]
        if not any(at & self.id[e] for e in EVENTS):
            out = []
        if len(self.driven) > 200_000:
            self.driven.clear()
        self.driven[have] = out
        return out

    def events(self, words: list[str]) -> list[str]:
        """Events that the clause has, after negation, self and mention."""
        have = self.always
        for w in words:
            if w and w != _COMMA:
                have |= self.bits[w]
        machines = self.driven.get(have)
        if machines is None:
            machines = self._drive(have)
        if not machines:
            return []
        masks: dict[str, int] = defaultdict(int)
        bit = 0
        first = True
        k = 0
        for w in words:
            if w == _COMMA:
                if bit:
                    masks["COMMA"] |= 1 << (k - 1)
                    first = True
                continue
            bit = 1 << k
            if w:
                for c in self.of[w]:
                    masks[c] |= bit
            if first:
                masks["START"] |= bit
                first = False
            k += 1
        masks["END"] = 1 << (k - 1)
        masks["LAST"] = masks["END"] | masks["COMMA"]
        # A contemptuous word before a thing is about the thing.
        for c in ("STRONG", "WEAK"):
            masks[c] &= ~(masks.get("THING", 0) >> 1) | masks.get("COMMA", 0)
        for m in machines:
            got = m.run(masks)
            if got:
                masks[m.name] |= got
        out = []
        for name in EVENTS:
            got = masks.get(name, 0)
            if not got:
                continue
            for modifier in self.modifiers.get(name, ()):
                got &= ~masks.get(modifier, 0)
            if got:
                out.append(name)
        return out

    def weigh(self, events: Iterable[str]) -> float:
        return 1 / (1 + math.exp(-(BIAS + sum(self.weights.get(e, PRIOR) for e in events))))

    def score(self, text: str | None) -> float:
        """Score of the best clause; 0 for null and blank texts and those without any event."""
        if not text or not text.strip():
            return 0.0
        best = 0.0
        for words in self.clauses(text):
            got = self.events(words)
            if got:
                best = max(best, self.weigh(got))
        return best


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar()


def fit(texts: list[str], labels: list[bool], rounds: int = 400) -> dict[str, float]:
    """Weights of the events by logistic regression with a prior, on at most ``FIT_ROWS`` labelled documents.

    A document's features are the events of its best clause under the prior weights; events never
    seen keep the prior. Labels may disagree or be wrong: the prior keeps a rare event from being
    judged by one of them.
    """
    g = Grammar({})
    x = np.zeros((min(len(texts), FIT_ROWS), len(EVENTS)))
    for i, t in enumerate(texts[:FIT_ROWS]):
        best = max((g.events(w) for w in g.clauses(t)), key=len, default=[])
        for e in best:
            x[i, EVENTS.index(e)] = 1
    y = np.asarray(labels[:FIT_ROWS], dtype=float)
    w = np.full(len(EVENTS), PRIOR)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(BIAS + x @ w)))
        grad = x.T @ (p - y) + STRENGTH * (w - PRIOR)
        h = (x.T * (p * (1 - p))) @ x + STRENGTH * np.eye(len(w))
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return {e: round(float(v), 2) for e, v in zip(EVENTS, w)}


def _score_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    g = grammar()
    for df in frames:
        yield pd.DataFrame({"doc_id": df["doc_id"], "source": df["source"], "score": [g.score(t) for t in df["text"]]})


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, source, score) of every document, from its whole text in any language; null and blank texts score 0."""
    return docs.select("doc_id", "source", "text").mapInPandas(_score_all, "doc_id bigint, source string, score double")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, abusive, rate) of each source, null included."""
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate")
    )
