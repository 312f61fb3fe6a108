"""The training-data operators against brute force, exact round trips and edge cases."""

import itertools
import random

import pytest

from landweave.llm import components, entities, names, packing, tokens

PAIRS = "record_id_a string, record_id_b string, is_match boolean, u string, label string"


def brute_groups(pairs):
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b, m, *_ in pairs:
        if m and a and b and a != b:
            x, y = sorted((top(a), top(b)))
            group[y] = x
    return {(x, min(y for y in group if top(y) == top(x))) for x in list(group)}


def test_groups_match_union_find(spark):
    rng = random.Random(8)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)]
    star = [("zz", f"s{i}") for i in range(30)]
    rand = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    rows = [(a, b, True, "x", "y") for a, b in chain + star + rand + rand[:9] + [(b, a) for a, b in star[:5]]]
    rows += [("c1", "s1", False, "", ""), ("c1", "s1", None, "", ""), (None, "c1", True, "", ""), ("c1", None, True, "", ""), ("self", "self", True, "", ""), ("", "c1", True, "", "")]
    got = components.match_groups(spark.createDataFrame(rows, PAIRS))
    assert {tuple(r) for r in got.collect()} == brute_groups(rows)


def test_no_pairs(spark):
    assert components.match_groups(spark.createDataFrame([], PAIRS)).count() == 0


def test_encoding_is_the_public_tokenizers(spark):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.BYTE_BPE_50K)
    tokenizer.encode_special_tokens = True
    texts = ["", None, " ", "plain words, don't 12345!!", "नमस्ते दुनिया", "a" * 5000, "ab" * 3000 + "  \n\n x", "<|endoftext|>", "é ​ ﻿ 😕☔", "same same same"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts * 2)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    for i, t in enumerate(texts * 2):
        assert got[i] == (tokenizer.encode(t, add_special_tokens=False).ids if t else []) and counts[i] == len(got[i])
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_replay_forgets_and_relearns():
    bpe = tokens.MergeReplay(tokens.BYTE_BPE_50K)
    first = bpe.encode(["alpha beta gamma"])[0].tolist()
    bpe.forget()
    assert bpe.encode(["alpha beta gamma"])[0].tolist() == first


def best_fit_one_by_one(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            r = min(fit)
            rooms.remove(r)
            rooms.append(r - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_best_fit_with_multiplicities_is_item_by_item():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 60))]
        count = {s: sizes.count(s) for s in set(sizes)}
        rooms = sorted(r for m, p in packing._best_fit(dict(count), 20) for r in [20 - sum(s * t for s, t in p.items())] * m)
        assert rooms == best_fit_one_by_one(sizes, 20)


def test_reduction_keeps_the_optimum():
    rng = random.Random(10)

    def optimum(sizes, capacity):
        for n in range(1, len(sizes) + 1):
            def place(i, rooms):
                if i == len(sizes):
                    return True
                return any(r >= sizes[i] and place(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1 :]) for k, r in enumerate(rooms) if r not in rooms[:k])
            if place(0, [capacity] * n):
                return n
        return 0

    for _ in range(60):
        sizes = sorted((rng.randrange(1, 11) for _ in range(rng.randrange(1, 9))), reverse=True)
        count = {s: sizes.count(s) for s in set(sizes)}
        fixed = packing._reduce(count, 10)
        rest = sorted((s for s, n in count.items() for _ in range(n)), reverse=True)
        assert sum(m for m, _ in fixed) + optimum(rest, 10) == optimum(sizes, 10)


def test_containers(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([5, 7, 7, 7, 20, 33, 41, 0, 95]), "x") for i in range(300)] + [(1000, None, "x"), (1001, -1, "x"), (1002, 20, "x")]
    got = packing.fill(spark.createDataFrame(rows, "doc_id bigint, n bigint, size string"), "doc_id", "n", 20).collect()
    used, parts = {}, {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.size
        parts.setdefault(r.doc_id, []).append(r.size)
    assert max(used.values()) <= 20 and sorted(used) == list(range(len(used)))
    for i, n, _ in rows:
        assert sum(parts.get(i, [])) == max(0, n or 0)
        if n and 0 < n <= 20:
            assert len(parts[i]) == 1
    assert packing.fill(spark.createDataFrame([], "doc_id bigint, n bigint"), "doc_id", "n", 20).count() == 0


def test_spellings_of_one_owner(spark):
    same = ["Mipashaj Yuvuk Gaadaaram", "Gaadaaram, Mipashaj Yuvuk", "Kumari Mipashaj d/o Yuvuk Gaadaaram", "M Yuvuk Gaadaaram", "Mipaslaj Yuvuk Gaadaaram", "Mipo Yuvuk Gaadaaram", "मिपशज युवुक गादारम", "Mipashaj Gaadaaram", "MIPASHAJ Y. GAADAARAM (HUF)"]
    body = ["Gulooja Co-operative Housing Society Ltd", "GULOOJA C.H.S. LIMITED", "The Gulooja Coop Hsg Society"]
    others = ["Yuvuk Gaadaaram", "Gulooja Education Trust", "Boloolu Gaadaaram", "", None, "Dr", "x" * 3000]
    rows = [("v", n) for n in same + body + others] + [("w", "Mipashaj Gaadaaram"), (None, "Mipashaj Gaadaaram")]
    got = {tuple(r) for r in names.owner_pairs(names.owner_groups(spark.createDataFrame(rows, "village string, name string").distinct())).collect()}
    want = {("v", *sorted(p, key=lambda s: s.encode())) for g in (same, body) for p in itertools.combinations(g, 2)}
    assert got == want


def test_part_links_match_brute_force(spark):
    rng = random.Random(12)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 10))) for _ in range(150)}
    df = spark.createDataFrame([("v", w) for w in words], "village string, part string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    def same(a, b):
        d = lev(a, b)
        return a == b or min(len(a), len(b)) >= 4 and (d <= 1 or d == 2 and (min(len(a), len(b)) >= 7 or sorted(a) == sorted(b)))

    got = {(r.part, r.other) for r in names.part_links(df).collect()}
    assert got == {(a, b) for a in words for b in words if same(a, b)}


def test_entities(spark):
    def box(x, y, w=0.0002):
        return f'{{"type":"Polygon","coordinates":[[[{x},{y}],[{x + w},{y}],[{x + w},{y + w}],[{x},{y + w}],[{x},{y}]]]}}'

    parcels, records = [], []
    for i in range(12):
        x, y = 74 + (i % 4) * 0.001, 11 + (i // 4) * 0.001
        parcels.append((f"P{i}", "v", box(x, y), None, x + 0.0001, y + 0.0001, "residential", f"Owner{chr(97 + i)}el Family{chr(97 + i)}ab", [f"cad{i}"] + ([f"rev{i}"] if i < 8 else []), 5))
        records.append((f"cad{i}", "DSC", box(x, y), '{"Area": 483.5}', 1))
        records.append((f"rev{i}", "DSR", box(x + 0.00005, y), '{"Area": 485.0, "Unit": "sqm"}', 2))
    records += [records[-1], ("far", "DSR", box(75, 12), '{"Area": 485, "Unit": "sqm"}', 3), ("stall", "DSR", box(74.00014, 11.00009, 0.00002), '{"Area": 5, "Unit": "sqm"}', 4),
                (None, "DSR", None, None, 5), ("nothing", None, None, None, 6), ("broken", "DSR", "{", "{", 7), ("swapped", "DSR", box(74.00105, 11).replace("74.", "#").replace("11.", "74.").replace("#", "11."), "[]", 8)]
    s = spark.createDataFrame(records, "record_id string, source_dataset_id string, geometry string, attributes string, rule int")
    c = spark.createDataFrame(parcels, "canonical_id string, village_code string, geometry string, area_sqm double, centroid_lon double, centroid_lat double, land_use string, owner_reference string, source_record_ids array<string>, kind int")
    got = {r.record_id: r for r in entities.match(s, c).collect()}
    assert {k: got[k].canonical_id for k in got if k.startswith("rev")} == {f"rev{i}": f"P{i}" for i in range(12)}
    assert not {"far", "stall", "nothing", "broken", None} & set(got) and not got["rev9"].is_labelled and 0.5 <= got["rev9"].confidence < 1
    assert entities.match(s.limit(0), c.limit(0)).count() == 0


def test_same_owner():
    assert entities.same_owner("Shri Ramesh Kumar Patil", "Patil, Ramesh K.") and not entities.same_owner("Ramesh Kumar Patil", "Kumar Patil")
    assert entities._edits("abcd", "abdc", 2) == 1 and entities._edits("abcd", "xyzt", 2) == 3
