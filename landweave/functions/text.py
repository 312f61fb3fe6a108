"""Text functions: similarity by longest common subsequence, phonetic codes, names and numbers of parcels."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from landweave import config


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b) by bit-parallel rows; two empty texts are equal."""
    if not a and not b:
        return 100.0
    place: dict[str, int] = {}
    for i, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & place.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best indel ratio of the common tokens and of each side's with them; 100 if one side's tokens hold the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base = " ".join(both)
    one, two = " ".join(both + left), " ".join(both + right)
    scores = [indel_ratio(one, two)]
    if base:
        scores += [indel_ratio(base, one), indel_ratio(base, two)]
    return max(scores)


_SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ं": "n", "ः": "h", "ँ": "n", "्": "", "ृ": "ri"}
_LETTERS = dict(zip(
    "अ आ इ ई उ ऊ ए ऐ ओ औ क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(),
    "a a i i u u e ai o au k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split(),
))


@lru_cache(maxsize=100_000)
def normal_name(name: str) -> str:
    """Romanised without inherent vowels, no marks, lower case, no titles, cut at a relational phrase, letters and figures only."""
    if any("ऀ" <= c <= "ॿ" for c in name):
        name = "".join(_LETTERS.get(c, _SIGNS.get(c, c)) for c in name)
    name = "".join(c for c in unicodedata.normalize("NFD", name) if unicodedata.category(c) != "Mn").lower()
    name = " ".join(w for w in name.split() if w.rstrip(".") not in config.HONORIFICS)
    name = regex.split(config.RELATIONAL, name)[0]
    return " ".join(regex.sub(r"[^a-z0-9\s]", " ", name).split())


def indic_soundex(name: str) -> str:
    """First letter and up to four digits; digraphs first, vowels are skipped, a digit isn't repeated."""
    name = name.strip().lower()
    if not name:
        return "0000"
    digits = ""
    for m in regex.finditer(r"(?:[bpcgjkdts]h|.)", name[1:], regex.S):
        digit = config.PHONETIC.get(m.group(), "0")
        if digit != "0" and not digits.endswith(digit):
            digits += digit
    return (name[0].upper() + digits + "0000")[:5]


def compare_names(a: str | None, b: str | None) -> tuple[float, float, str]:
    """(token-set score, composite similarity, level) of two names."""
    x, y = normal_name(a or ""), normal_name(b or "")
    if not x or not y:
        return 0.0, 0.0, "NO_MATCH"
    if x == y:
        return 100.0, 1.0, "EXACT"
    score = token_set_ratio(x, y)
    sounds = indic_soundex(x) == indic_soundex(y) != "0000"
    level = "HIGH" if score >= 90 else "MEDIUM" if score >= 75 or sounds and score >= 50 else "LOW" if score >= 50 else "NO_MATCH"
    return score, min(1.0, (score * 0.7 + 15 * sounds) / 100), level


def best_owner(a: list[str], b: list[str]) -> tuple[float, float, str]:
    """The comparison of the most similar pair of two lists of names, the first of equals."""
    best = (0.0, 0.0, "NO_MATCH")
    for x in a:
        for y in b:
            got = compare_names(x, y)
            if got[1] > best[1]:
                best = got
    return best


def token_set_ratio_col(a: Column, b: Column) -> Column:
    """``token_set_ratio`` over columns; null where either side is."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else token_set_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def indel_ratio_col(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def compare_names_col(a: Column, b: Column) -> Column:
    """struct of score, similarity, level, and the soundex of both names."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(*compare_names(p, q), indic_soundex(normal_name(p or "")), indic_soundex(normal_name(q or ""))) for p, q in zip(x, y)]
        return pd.DataFrame(rows, columns=["score", "similarity", "level", "soundex_a", "soundex_b"])

    return F.pandas_udf(run, "score double, similarity double, level string, soundex_a string, soundex_b string")(a, b)


def field_name(c: Column) -> Column:
    """Lower case, trimmed, everything but letters, figures and underscores as underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]", "_")


def identifier(c: Column) -> Column:
    """Lower-case letters and figures only; null if none is left."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def ulpin_normal(c: Column) -> Column:
    """Without blanks and hyphens."""
    return F.regexp_replace(c, r"[\s-]", "")


def ulpin_status(c: Column) -> Column:
    """EMPTY, NOT_DIGITS, WRONG_LENGTH, UNKNOWN_STATE or VALID."""
    n = ulpin_normal(c)
    state = F.substring(n, 1, 2)
    return (
        F.when(n.isNull() | (n == ""), "EMPTY").when(~n.rlike(r"^\d+$"), "NOT_DIGITS").when(F.length(n) != 14, "WRONG_LENGTH")
        .when(~state.between("01", "38"), "UNKNOWN_STATE").otherwise("VALID")
    )


def demo_identifier(lon: Column, lat: Column, state: str = "15", district: str = "42") -> Column:
    """A 14-figure number from a position; no official number."""
    a = F.lpad((F.floor(F.abs(lat) * 10_000) % 1_000_000).cast("string"), 6, "0")
    b = F.lpad((F.floor(F.abs(lon) * 1000) % 10_000).cast("string"), 4, "0")
    return F.concat(F.lit(state.zfill(2)[:2] + district.zfill(2)[:2]), a, b)


def normal_name_ascii(c: Column) -> Column:
    """``normal_name`` of a text without marks or other scripts, as JVM expressions."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: ~F.regexp_replace(w, r"\.+$", "").isin(*config.HONORIFICS))
    cut = F.element_at(F.split(F.array_join(words, " "), config.RELATIONAL), 1)
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"[^a-z0-9\s]", " "), r"\s+", " "))


def normal_name_col(c: Column) -> Column:
    """``normal_name`` of any text; only those with marks or other scripts go through Python."""
    plain = c.rlike(r"^[ -~]+$")
    run = lambda s: s.map(lambda t: None if t is None else normal_name(t))
    return F.when(plain, normal_name_ascii(c)).otherwise(F.pandas_udf(run, "string")(F.when(~plain, c)))
