"""Formatting copies and similar records against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from codexmill.llm import similar
from codexmill.llm.fold import collapsed_records, formatting_copies, labelled_fields, letters
from codexmill.llm.similar import similar_classes, similar_pairs

SCHEMA = "row_id long, act_id string, text string, tuple string, number long, a long, kept string"
BODY = "the clerk of the {0} office shall keep every record that {1} filed on day {2} and return it when the {1} term ends after {2} weeks unless the board of the {0} says that it is to be kept for longer"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def variants(t):
    return [t, t.upper(), t.replace(" ", "  "), " \n" + t.replace(" ", "\t") + ".", t.replace("the", "(the)").replace(",", ";"), t.title()]


def copies_of(rows, canonical):
    groups = defaultdict(list)
    for i, (row_id, key, text) in enumerate(rows):
        if text and len(re.findall(r"[^\W_]+", text)) >= 30:
            groups[canonical(key, text)].append((row_id is not None, row_id, i))
    out = []
    for g in groups.values():
        first = min(g)
        out += [(first[1], r) for g_ in g if g_ != first for r in [g_[1]]]
    return sorted(out, key=repr), sorted([(min(g)[1], len(g)) for g in groups.values()], key=repr)


def test_formatting(spark):
    rows = []
    for n in range(12):
        body = BODY.format(f"n{n}", "naïve", n)
        heads = [f"Authority: {n} U.S.C. 5; Source: 4 FR {n}\n\n", f"[Source: 4 FR {n} | Authority: {n} USC 5]\n", f"source: 4-FR-{n}\nAUTHORITY:  {n} u.s.c. 5\r\n \r\n", ""]
        for head in heads:
            for v in variants(body)[: 1 + n % 6]:
                rows.append((len(rows) + 1, f"STATE_{n}_A" if len(rows) % 2 else f"state-{n}/a", head + v))
    rows += [(900, None, BODY), (901, None, BODY), (902, "", BODY), (903, "x", None), (904, "x", ""), (905, "x", "too short"), (906, "x", "too short"), (1, "STATE_0_A", rows[0][2]), (907, "l", BODY * 2000), (908, "L", BODY.upper() * 2000)]
    random.Random(3).shuffle(rows)

    def canonical(key, text):
        fields, body = labelled_fields(text)
        return letters(key), tuple(sorted((c, letters(v)) for c, v in fields)), letters(body)

    want, groups = copies_of(rows, canonical)
    df = frame(spark, rows)
    got = sorted(((r["kept_row_id"], r["row_id"]) for r in formatting_copies(df).collect()), key=repr)
    assert got == want and len(want) > 50
    assert sorted(((r["row_id"], r["copies"]) for r in collapsed_records(df).collect()), key=repr) == groups


def test_opening_that_lost_its_line(spark):
    """A text with the letters of one whose fields are set off is its copy, also as one line."""
    rows = [(5, "a", "Authority: 1 USC; Source: 2 FR\n\n" + BODY), (6, "a", "Source: 2 FR; Authority: 1 USC\n\n" + BODY), (3, "a", "Authority: 1 USC, Source: 2 FR " + BODY), (4, "a", "Authority is one thing " + BODY)]
    assert {(r[0], r[1]) for r in formatting_copies(frame(spark, rows)).collect()} == {(3, 5), (3, 6)}


@pytest.mark.parametrize("text, n", [("[Authority: x", 0), ("[Authority: x]", 1), ("Authority: x\ny", 0), ("Authority: x\n\ny", 1), ("[Authority: x | note]\ny", 0), ("See Source: x\n\ny", 0), ("Effective : 1; agency: b|SOURCE:c\n \ny", 3), ("", 0)])
def test_fields(text, n):
    fields, rest = labelled_fields(text)
    assert len(fields) == n and (n or rest == text)


def test_hot_group_and_empty(spark):
    rows = [(i, "a", BODY if i % 3 else BODY + str(i)) for i in range(3000)]
    got = formatting_copies(frame(spark, rows)).collect()
    assert len(got) == 1999 and {r["kept_row_id"] for r in got} == {1}
    assert formatting_copies(frame(spark, [])).count() == 0 and collapsed_records(frame(spark, [])).count() == 0


def shingles(text, w, least):
    words = re.findall(r"[^\W_]+", text.lower()) if text else []
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if len(words) >= max(least, w) else None


def brute_pairs(rows, w, t, least):
    sets = {i: s for i, _, x in rows if i is not None and (s := shingles(x, w, least))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * t.denominator >= len(sets[a] | sets[b]) * t.numerator}


def edited(rnd, words):
    words = list(words)
    for _ in range(rnd.randrange(6)):
        i = rnd.randrange(len(words))
        words[i : i + rnd.randrange(2)] = [rnd.choice("alpha beta gamma delta".split())] * rnd.randrange(3)
    if rnd.random() < 0.2:
        i = rnd.randrange(len(words))
        words = words[i:] + words[:i]
    return words


def similar_rows(n, seed):
    rnd, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(60)]
    while len(rows) < n:
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 45, 80, 140]))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            rows.append((len(rows) + 1, "a", " ".join(edited(rnd, base))))
        if rnd.random() < 0.3:
            rows.append((len(rows) + 1, "a", rows[-1][2].upper() + "!"))
    return rows


@pytest.mark.parametrize("kw", [{}, {"part_postings": 500, "crowd": 2, "family_members": 100, "most_families": 2}])
def test_similar(spark, kw):
    rows = similar_rows(250, 5) + [(None, "a", BODY), (7000, "a", None), (7001, "a", ""), (7002, "a", BODY), (7003, "a", BODY), (7004, "a", BODY * 800), (7005, "a", BODY * 800 + " end")]
    df = frame(spark, rows)
    for w, t, least in ((3, Fraction(3, 5), 30), (5, Fraction(4, 5), 1), (2, Fraction(1, 2), 10)):
        got = [tuple(r) for r in similar_pairs(*similar_classes(df, width=w, threshold=t, min_words=least, **kw)).collect()]
        assert len(got) == len({*got}) and {*got} == brute_pairs(rows, w, t, least)


@pytest.mark.parametrize("crowd", [2, 3])
def test_long_lists_that_no_count_shows(spark, monkeypatch, crowd):
    """Without any counts, lists are put together whole, split where they turn out long, and handed on."""
    rows = [(i, "a", BODY.format("x", "y", i % 7) + f" and {i} more") for i in range(120)] + similar_rows(60, 9)
    rows = [(i, k, t) for i, (_, k, t) in enumerate(rows)]
    monkeypatch.setattr(similar, "_frequencies", lambda described: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    handed = []
    met = similar._met

    def seen(postings, t, parts, crowd, hand_on):
        handed.append(hand_on)
        return met(postings, t, parts, crowd, hand_on)

    monkeypatch.setattr(similar, "_met", seen)
    got = {tuple(r) for r in similar_pairs(*similar_classes(frame(spark, rows), width=3, threshold=Fraction(3, 5), min_words=30, crowd=crowd, part_postings=2000)).collect()}
    assert got == brute_pairs(rows, 3, Fraction(3, 5), 30) and len(got) > 1000
    assert handed == [True, False]


def test_leaders_answer_for_close_sets():
    """The overlaps of a set close to its leader follow from the leader's; those of others don't; both are right."""
    lead, far = {*range(100)}, {*range(1000, 1100)}
    sets = {1: lead, 2: lead - {3} | {500}, 3: lead - {4, 5} | {500, 501}, 4: far, 5: far - {1000} | {3}}
    counted = []

    class Watched(set):
        def __and__(self, other):
            counted.append(len(self))
            return set(self) & set(other)

        def __sub__(self, other):
            return Watched(set.__sub__(self, other))

    watched = {k: Watched(v) for k, v in sets.items()}
    pairs = [(1, 2), (1, 3), (2, 3), (4, 5), (3, 5)]
    found = similar._verify_family(pairs, watched, 1, Fraction(4, 5))
    assert found == [(a, b, len(sets[a] & sets[b])) for a, b in pairs if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    assert sorted(n for n in counted if n > 50) == [100] * 4  # the leader with 2, 3 and 5, and 4 with 5: not 2 with 3, nor 3 with 5


def test_classes_hold_every_link(spark):
    rows = similar_rows(120, 3) + [(None, "a", BODY), (800, "a", None)]
    got = {r["row_id"]: r for r in similar.class_links(*similar_classes(frame(spark, rows), width=3, threshold=Fraction(3, 5))).collect()}
    sets = {i: s for i, _, x in rows if i is not None and (s := shingles(x, 3, 1))}
    kept = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    pairs = brute_pairs(rows, 3, Fraction(3, 5), 1)
    linked = {frozenset((kept[a], kept[b])) for a, b in pairs if kept[a] != kept[b]}
    assert {*got} == {*sets} and sum(map(len, linked)) > 20
    for i, r in got.items():
        assert (r["class_id"], r["copies"], r["links"]) == (kept[i], sum(kept[j] == kept[i] for j in sets), sum(kept[i] in p for p in linked))


def test_openings_behind_marks(spark):
    """However many marks stand before a label, the text is mended; one that all have doesn't break it."""
    rows = [(5, "a", "Authority: 1 USC; Source: 2 FR\n\n" + BODY)] + [(10 + i, "a", "- \t" * 200 + "Authority: 1 USC, Source: 2 FR " + BODY) for i in range(50)]
    assert {(r[0], r[1]) for r in formatting_copies(frame(spark, rows)).collect()} == {(5, 10 + i) for i in range(50)}


def test_large_class_is_a_star(spark):
    rows = [(i, "a", BODY) for i in range(40)] + [(100, "a", BODY + " more")]
    members, links = similar_classes(frame(spark, rows), width=3, threshold=Fraction(3, 5))
    got = {tuple(r) for r in similar_pairs(members, links, expand=10).collect()}
    assert got == {(0, i) for i in range(1, 40)} | {(0, 100)}
    assert len(similar_pairs(members, links).collect()) == 41 * 40 // 2


def test_no_similar(spark):
    members, links = similar_classes(frame(spark, []))
    assert members.count() == 0 and links.count() == 0 and similar_pairs(members, links).count() == 0
    assert similar_pairs(*similar_classes(frame(spark, [(1, "a", None), (2, "a", "one two")]))).count() == 0
