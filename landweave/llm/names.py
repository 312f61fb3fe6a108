"""Spellings of one owner's name, linked within a village.

A name is read into parts (first, middle and last name of a person in every order the writing
allows, or the core and kind of a body) after titles, endings, scripts and doubled vowels are
brought to one form. Two parts are the same if they are within a small edit distance: each
distinct part of a village is cut into three segments, the segments go into an inverted index,
every part looks up its position-shifted substrings, and what meets is verified by a banded edit
distance. Names are then joined on equal parts, after each is expanded by its linked spellings, so
bearers of one last name are never paired among themselves. Names with all parts form groups by
connected components; a name that lacks a part or has only an initial joins a group only if no
second group fits it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.llm.components import connected_components
from landweave.session import Stage

#: Edits that a part may have; a part is cut into one segment more.
EDITS = 2

#: Titles, lower case and without dots, also in Devanagari.
TITLES = (
    "sh shri sri shree smt smti shrimati mr mrs ms miss dr prof adv km kum kumari kumar late the m/s messrs "
    "श्री श्रीमती स्व सौ कु डॉ कुमारी मे"
).split()
#: Words between a person's name and the father's or husband's.
RELATIONS = ("s/o", "d/o", "w/o", "c/o", "so", "do", "wo", "son of", "daughter of", "wife of", "पुत्र", "पत्नी", "पुत्री")
#: Endings that don't change who is meant.
ENDINGS = r"(?:\((?:huf|decd\.?|deceased|regd\.?|late)\)|(?:&|and|n) ?(?:\d+ )?(?:others?|ors\.?|anr\.?)|etc\.?|आदि|व अन्य)\s*$"
#: Respectful endings of first names.
RESPECT = ("bhai", "bai", "behn", "ben", "devi", "appa", "amma", "rao", "ji", "jee", "saheb", "sahib")
#: Kinds of bodies and the words by which they are known.
BODIES = {
    "housing": ("housing", "hsg", "chs", "society", "soc"),
    "builders": ("builders", "builder", "bldrs", "bldr", "developers"),
    "trust": ("trust", "edn", "edu", "education", "educational"),
    "warehouse": ("warehousing", "warehouse", "whsg", "sons"),
    "agro": ("agro", "producer", "producers", "prod"),
    "temple": ("temple", "mandir", "cmte", "comm", "committee"),
}
#: Other words of bodies' names that tell nothing.
FORMS = {"ltd", "limited", "pvt", "private", "p", "co", "company", "coop", "cooperative", "operative", "op", "and", "n", "regd", "the"}

_KIND = {w: k for k, words in BODIES.items() for w in words}
_VOWEL = {"ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ृ": "ri", "ॉ": "o", "ॅ": "e"}
_CONSONANT = dict(zip(
    "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(),
    "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split(),
))
_INITIAL = dict(zip("अ आ इ ई उ ऊ ए ऐ ओ औ ऋ".split(), "a aa i ee u oo e ai o au ri".split()))
_ENDING = regex.compile(ENDINGS)
_RELATION = regex.compile(r"(?:^|\s)(?:" + "|".join(regex.escape(r) for r in RELATIONS if len(r) > 2 or "/" in r) + r")\.?\s+")
_BLANKS, _COOP, _CHS = regex.compile(r"\s+"), regex.compile(r"\bco-? ?op(?:erative)?\b"), regex.compile(r"\bc\. ?h\. ?s\b\.?")
_DOTS, _DOTS_COMMAS, _BRACKETS = regex.compile(r"[\s.]+"), regex.compile(r"[\s.,]+"), regex.compile(r"[&()\-]")
_DOUBLED, _C, _STEM = regex.compile(r"(.)\1+"), regex.compile(r"c(?!h)"), regex.compile(r"[^aeiou]*[aeiou]+[^aeiou]+")
_LOOKS = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "6": "b", "8": "b", "9": "g"})


def romanise(text: str) -> str:
    """Devanagari as Latin letters; a consonant without a vowel sign has an a, except at a word's end."""
    if text.isascii():
        return text
    out: list[str] = []
    for i, ch in enumerate(text):
        if ch in _CONSONANT:
            out.append(_CONSONANT[ch])
            nxt = text[i + 1] if i + 1 < len(text) else " "
            if nxt in _CONSONANT or nxt in _INITIAL or nxt in "ंँः":
                out.append("a")
        elif ch in _VOWEL:
            out.append(_VOWEL[ch])
        elif ch in _INITIAL:
            out.append(_INITIAL[ch])
        elif ch in "ंँ":
            out.append("n")
        elif ch in "्ः़":
            continue
        else:
            out.append(ch)
    return "".join(out)


def fold(part: str) -> str:
    """One form of the usual ways to write a sound: doubled letters, long vowels, w and v, q and k."""
    t = part.translate(_LOOKS)
    t = t.replace("ee", "i").replace("oo", "u").replace("w", "v").replace("q", "k").replace("ph", "f").replace("x", "ks")
    return _C.sub("k", _DOUBLED.sub(r"\1", t))


def _respect(t: str) -> str:
    for e in RESPECT:
        if t.endswith(e) and len(t) - len(e) >= 4:
            return t[: -len(e)]
    return t


def _stem(t: str) -> str:
    """First syllable with the consonants that close it, by which a nickname knows its name."""
    m = _STEM.match(t)
    return m.group() if m else ""


def unfolded(part: str) -> str:
    """A part as written, but for figures that stand for letters."""
    return part.translate(_LOOKS)


def read(name: str, form: Callable[[str], str] = fold) -> list[tuple[str, str, str, str]]:
    """(kind, first, middle, last) of each reading of a name; parts in ``form``, an initial is one letter.

    A body has its kind, its core as last, and no other parts. A blank name has no reading.
    """
    t = unicodedata.normalize("NFKC", name).lower()
    t = _BLANKS.sub(" ", t).strip()
    for _ in range(3):
        t = _ENDING.sub("", t).strip(" ,&")
    t = _CHS.sub("chs", _COOP.sub("coop", t))
    words = [w for w in _DOTS.split(_BRACKETS.sub(" ", t.replace("m/s", " "))) if w]
    words = [romanise(w) for w in words]
    kinds = {_KIND[w.strip(",").translate(_LOOKS)] for w in words if w.strip(",").translate(_LOOKS) in _KIND}
    if kinds:
        kind = next((k for k in BODIES if k in kinds), "")
        core = [form(w.strip(",")) for w in words if w.strip(",").translate(_LOOKS) not in _KIND and w.strip(",") not in FORMS and w.strip(",") not in TITLES]
        return [(kind, "", "", "".join(core))] if core else []

    m = _RELATION.search(t)
    tail: list[str] = []
    if m:
        t, after = t[: m.start()], t[m.end() :]
        tail = [romanise(w) for w in _DOTS_COMMAS.split(after) if w]
    comma = "," in t
    head: list[list[str]] = []
    for piece in t.split(","):
        ws = [w for w in _DOTS.split(piece) if w]
        while ws and ws[0].strip(".") in TITLES and len(ws) > 1:
            ws = ws[1:]
        head.append([form(_respect(romanise(w))) for w in ws])
    head = [h for h in head if h]
    if not head:
        return []
    out: list[tuple[str, str, str]] = []
    if tail:
        tail = [form(w) for w in tail if w not in TITLES]
        ws = [w for h in head for w in h]
        if len(tail) >= 2 and len(ws) == 1:
            out.append((ws[0], tail[0], tail[-1]))
        elif tail and len(ws) >= 2:
            out.append((ws[-1], tail[0], ws[0]) if comma else (ws[0], tail[0], ws[-1]))
        elif tail:
            out.append((ws[0], tail[0], ""))
    elif comma and len(head) >= 2:
        last, rest = head[0][-1], head[1]
        out.append((rest[0], rest[1] if len(rest) > 1 else "", last))
    else:
        ws = head[0]
        if len(ws) == 2:
            out.append((ws[0], "", ws[1]))
        elif len(ws) >= 3:
            a, b, c = ws[0], ws[1], ws[-1]
            if len(c) > 1:
                out.append((a, b, c))
            if len(a) > 1:
                out.append((b, c, a))
        else:
            out.append((ws[0], "", ""))
    return [("person", f, m2, s) for f, m2, s in out if len(s) > 1 or not s]


def _read_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = [
            (v, n, kind, f, m, s, _stem(f) if len(f) > 1 else "", f[:-1] if 2 < len(f) <= 6 and f[-1] in "aeiou" else "", raw[1], raw[3])
            for v, n in zip(df["village"], df["name"]) for (kind, f, m, s), raw in zip(read(n), read(n, unfolded))
        ]
        yield pd.DataFrame(rows, columns=["village", "name", "kind", "first", "middle", "last", "stem", "nick", "first_raw", "last_raw"])


def _segments(parts: DataFrame, k: int, least: int, most: int | None) -> DataFrame:
    """(village, part, other) that share a segment: the shorter part, of ``least`` to ``most`` letters, is cut into k + 1, the longer one has up to k letters more."""
    seg_len = lambda i, n: F.floor((n + i) / (k + 1)).cast("int")  # noqa: E731 - later segments are the longer ones
    seg_at = lambda i, n: sum((F.floor((n + j) / (k + 1)) for j in range(i)), F.lit(0)).cast("int")
    fits = lambda n: (n >= least) & (n <= most) if most else n >= least
    n = F.col("n")
    index = parts.where(fits(n)).select(
        "village", "part", "n", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.substring("part", seg_at(i, n) + 1, seg_len(i, n)).alias("seg")) for i in range(k + 1)]))
    )
    looks = []
    for d in range(k + 1):  # the longer part has d letters more
        m = n - d
        for i in range(k + 1):
            for shift in range(-((k - d) // 2), (k + d) // 2 + 1):
                at = seg_at(i, m) + shift
                ok = fits(m) & (at >= 0) & (at + seg_len(i, m) <= n)
                looks.append(F.when(ok, F.struct(F.lit(i).alias("i"), m.alias("n"), F.substring("part", at + 1, seg_len(i, m)).alias("seg"))))
    probe = parts.where(n >= least).select("village", F.col("part").alias("other"), F.explode(F.array_compact(F.array(*looks))).alias("x")).select("village", "other", "x.*")
    return index.join(probe, ["village", "i", "n", "seg"]).where(F.col("part") != F.col("other")).select("village", "part", "other")


def part_links(parts: DataFrame) -> DataFrame:
    """(village, part, other) of distinct parts of a village within the edit distance, both ways and itself.

    Parts of four letters and more allow one edit, those of seven and more ``EDITS``; the same letters
    in another order within two edits count as one slip. Shorter parts are linked to themselves only:
    among three letters one edit leads from most names to another. Pigeonhole: a part that allows k
    edits is cut into k + 1 segments, of which at least one is unharmed and stands in the longer
    part, shifted by no more than the edits allow; letters in another order meet by their sorted letters.
    """
    p = parts.where(F.length("part") >= 4).withColumn("n", F.length("part"))
    letters = p.select("village", "part", F.array_join(F.array_sort(F.split("part", "")), "").alias("letters"))
    turned = letters.join(letters.withColumnRenamed("part", "other"), ["village", "letters"]).where(F.col("part") < F.col("other")).select("village", "part", "other")
    one = _segments(p, 1, 4, 6).withColumn("most", F.lit(1))
    two = _segments(p, EDITS, 7, None).withColumn("most", F.lit(EDITS))
    met = one.unionByName(two).unionByName(turned.withColumn("most", F.lit(2))).groupBy("village", "part", "other").agg(F.max("most").alias("most"))
    dist = F.levenshtein("part", "other", EDITS)
    near = met.where((dist >= 0) & (dist <= F.col("most"))).select("village", "part", "other")
    return near.unionByName(near.select("village", F.col("other").alias("part"), F.col("part").alias("other"))).unionByName(
        parts.select("village", "part", F.col("part").alias("other"))
    ).distinct()


def _initial(c: str) -> Column:
    return F.length(c) == 1


def linked_names(names: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(strong, loose, readings): id pairs that name the same owner surely, those that may, and all readings."""
    read_rows = names.mapInPandas(_read_all, "village string, name string, kind string, first string, middle string, last string, stem string, nick string, first_raw string, last_raw string")
    r = stage.write(read_rows.withColumn("id", F.concat_ws("\u0001", "village", "name")))
    forms = r.select("village", F.inline(F.array(F.struct(F.col("first").alias("part"), F.col("first_raw").alias("raw")), F.struct(F.col("last").alias("part"), F.col("last_raw").alias("raw")))))
    forms = stage.write(forms.where(F.length("part") > 1).distinct())
    # A slip inside a doubled vowel shows in the written form, one between sounds alike in the folded form.
    # Both forms go through one search, told apart by a mark before the village.
    mark = lambda m, c: forms.select(F.concat(F.lit(m), "village").alias("village"), F.col(c).alias("part"))
    found = stage.write(part_links(mark("f", "part").unionByName(mark("w", "raw")).distinct()).select(F.substring("village", 1, 1).alias("mark"), F.expr("substring(village, 2)").alias("village"), "part", "other"))
    as_part = lambda raw, part: forms.select("village", F.col("raw").alias(raw), F.col("part").alias(part))
    written = found.where("mark = 'w' AND part <> other").select("village", F.col("part").alias("raw"), F.col("other").alias("raw2")).join(as_part("raw", "part"), ["village", "raw"]).join(as_part("raw2", "other"), ["village", "raw2"])
    links = stage.write(found.where("mark = 'f'").select("village", "part", "other").unionByName(written.select("village", "part", "other")).distinct())
    full = r.where((F.col("kind") == "person") & (F.length("first") > 1) & (F.col("last") != ""))
    # The expanded side tries every spelling of first and last name; the other side has its own.
    first_of = links.select("village", F.col("part").alias("first"), F.col("other").alias("first2"))
    last_of = links.select("village", F.col("part").alias("last"), F.col("other").alias("last2"))
    expanded = full.join(last_of, ["village", "last"])
    right = full.select("village", F.col("id").alias("id2"), F.col("middle").alias("middle2"), F.col("first").alias("first2"), F.col("last").alias("last2"), F.col("nick").alias("nick2"))
    spelt = expanded.join(first_of, ["village", "first"]).join(right, ["village", "first2", "last2"]).select("village", "id", "id2", "middle", "middle2")
    nicked = expanded.where(F.col("stem") != "").join(
        right.where(F.col("nick2") != ""), (expanded["village"] == right["village"]) & (expanded["last2"] == right["last2"]) & (expanded["stem"] == right["nick2"])
    ).where(F.length("first") >= F.length("first2")).select(expanded["village"], "id", "id2", "middle", "middle2")
    people = spelt.unionByName(nicked).where(F.col("id") != F.col("id2"))
    both = (F.col("middle") != "") & (F.col("middle2") != "")
    letter = F.substring("middle", 1, 1) == F.substring("middle2", 1, 1)
    dist = F.levenshtein("middle", "middle2", EDITS)
    close = (dist >= 0) & (dist <= F.when(F.least(F.length("middle"), F.length("middle2")) >= 4, 2).otherwise(0))
    agree = F.when(_initial("middle") | _initial("middle2"), letter).otherwise(close)
    strong = people.where(both & agree).select("village", "id", "id2")
    loose = people.where(~both).select("village", "id", "id2")
    bodies = r.where(F.col("kind") != "person")
    other = bodies.select("village", "kind", F.col("last").alias("last2"), F.col("id").alias("id2"))
    body = bodies.join(last_of, ["village", "last"]).join(other, ["village", "kind", "last2"]).where(F.col("id") != F.col("id2")).select("village", "id", "id2")
    # An initial for the first name needs a middle name that agrees.
    initial = r.where((F.col("kind") == "person") & (F.length("first") == 1) & (F.col("last") != "") & (F.col("middle") != ""))
    left = initial.join(last_of, ["village", "last"])
    able = r.where((F.col("kind") == "person") & (F.col("last") != "") & (F.col("middle") != "")).select(
        "village", F.substring("first", 1, 1).alias("first"), F.substring("middle", 1, 1).alias("m1"), F.col("middle").alias("middle2"), F.col("last").alias("last2"), F.col("id").alias("id2")
    )
    from_initial = (
        left.withColumn("m1", F.substring("middle", 1, 1)).join(able, ["village", "first", "m1", "last2"])
        .where((F.col("id") != F.col("id2")) & (_initial("middle") | _initial("middle2") | close)).select("village", "id", "id2")
    )
    return strong.unionByName(body).distinct(), loose.unionByName(from_initial).distinct(), r


def owner_groups(names: DataFrame) -> DataFrame:
    """(village, name, group_id) of names that have another spelling; ``names`` has distinct village and name.

    Null and empty names, and names of a null village, have no group. A spelling that fits two
    owners is left out of both.
    """
    stage = Stage(names.sparkSession)
    names = names.where(F.col("village").isNotNull() & F.col("name").isNotNull() & (F.col("name") != ""))
    strong, loose, r = linked_names(names, stage)
    strong, loose = stage.write(strong), stage.write(loose)
    edge = lambda df: df.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct()
    sure = stage.write(connected_components(edge(strong)))
    # Names with a full first and a middle name stand on their own; the others look for one group to join.
    weak = r.groupBy("id").agg(F.max((F.length("first") > 1) & (F.col("middle") != "") | (F.col("kind") != "person")).alias("whole")).where(~F.col("whole")).select("id")
    label = sure.select(F.col("node").alias("id2"), "label")
    to = loose.unionByName(loose.select("village", F.col("id2").alias("id"), F.col("id").alias("id2"))).distinct()
    to = to.join(weak, "id", "left_semi")
    # Weak names alike in first and last name are first taken together, then join as one.
    among = to.join(weak.select(F.col("id").alias("id2")), "id2", "left_semi")
    weak_groups = stage.write(connected_components(edge(among)))
    of_weak = weak.join(weak_groups.select(F.col("node").alias("id"), F.col("label").alias("wg")), "id", "left").withColumn("wg", F.coalesce("wg", "id"))
    outward = (
        to.join(weak.select(F.col("id").alias("id2")), "id2", "left_anti").join(label, "id2", "left").withColumn("label", F.coalesce("label", "id2"))
        .join(of_weak, "id")
    )
    single = outward.groupBy("wg").agg(F.min("label").alias("label"), F.max("label").alias("most")).where(F.col("label") == F.col("most"))
    # A weak group joins one owner whole, so the groups need no further search for components.
    joined = stage.write(of_weak.join(single.select("wg", "label"), "wg", "left").select(F.col("id").alias("node"), F.coalesce("label", "wg").alias("label")))
    strong_nodes = sure.select("node", "label")
    lone = joined.select(F.col("label").alias("node"), "label").distinct().join(strong_nodes.union(joined).select("node"), "node", "left_anti")
    found = strong_nodes.union(joined).union(lone)
    shared = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    found = found.join(shared, "label", "left_semi")
    return found.select(F.element_at(F.split("node", "\u0001"), 1).alias("village"), F.element_at(F.split("node", "\u0001"), 2).alias("name"), F.col("label").alias("group_id"))


def owner_pairs(groups: DataFrame) -> DataFrame:
    """(village, name_a, name_b), name_a < name_b: every pair of spellings of one owner."""
    a = groups.select("village", "group_id", F.col("name").alias("name_a"))
    b = groups.select("village", "group_id", F.col("name").alias("name_b"))
    return a.join(b, ["village", "group_id"]).where(F.col("name_a") < F.col("name_b")).select("village", "name_a", "name_b")
