"""Packing, leaks and sentences."""

from __future__ import annotations

import os
import random
import re
import time
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexmill.llm import leaks
from codexmill.llm.leaks import common_subsequence, find_leaks, passage_words
from codexmill.llm.packing import DEFAULT_RANKS, Packer, hilbert_keys, pack_texts, packing_report, read_ranks, tokenizer
from codexmill.llm.sentences import Evidence, Verdicts, sentence_units, split_sentences

needs_ranks = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no tokenizer file")
DOCS = "doc_id long, text string, place long, number long, container_id long, item_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], DOCS)


# ------------------------------------------------------------------ packing


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3)])
def test_hilbert_curve_is_one_path(dims, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200), st.integers(1, 50), st.integers(1, 8))
def test_packer_keeps_capacity(sizes, stretch, most_open):
    p, placed, used = Packer(100, 0, stretch, most_open), {}, {}
    got = [x for i, s in enumerate(sizes) for x in p.add(s, i)] + p.pack()
    for item, container in got:
        assert item not in placed
        placed[item] = container
        used[container] = used.get(container, 0) + sizes[item]
    assert len(placed) == len(sizes) and all(u <= 100 for u in used.values())


def budgets(spark, rows):
    return spark.createDataFrame(rows, "budget_id int, budget_name string, capacity_tokens int")


@needs_ranks
def test_packing(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("law act court rule of the §".split()) for _ in range(rnd.randrange(120)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 5000), (None, "a b c"), (1, "a b c"), (1003, "same text here")] + [(2000 + i, "same text here") for i in range(200)]
    limits = {1: 16, 2: 100}
    out = pack_texts(docs(spark, rows), budgets(spark, [(b, "n", c) for b, c in limits.items()] + [(3, "zero", 0), (4, None, None)]), range_items=150, stretch=50).collect()
    enc = tokenizer(read_ranks(DEFAULT_RANKS))
    some = docs(spark, rows)
    packed = spark.createDataFrame(out, "budget_id int, container_id long, doc_id long, piece_no int, start_token long, n_tokens long")
    limits_ = budgets(spark, [(b, "n", c) for b, c in limits.items()])
    for r in packing_report(packed, some, limits_, "item_id").collect():
        assert (r["texts"], r["overfull"], r["gaps"], r["split"], r["alike_inside"], r["alike_among_all"]) == (len(rows), 0, 0, 0, 1.0, 1.0) and r["least_containers"] <= r["containers"]
    worse = packed.withColumn("container_id", F.lit(1).cast("long")).withColumn("start_token", F.col("start_token") + F.col("piece_no"))
    assert all(r["overfull"] == 1 and r["gaps"] > 0 for r in packing_report(worse, some, limits_, "item_id").collect())
    for b, capacity in limits.items():
        mine = [r for r in out if r["budget_id"] == b]
        used, pieces = {}, {}
        for r in mine:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
            pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
        assert max(used.values()) <= capacity
        assert sum(used.values()) > 0.9 * capacity * len(used)
        for doc, text in rows[2:404]:
            n, got = len(enc.encode_ordinary(text or "")), sorted(pieces[doc])
            assert [p[0] for p in got] == list(range(len(got))) and sum(p[2] for p in got) == n
            assert all(p[1] == p[0] * capacity for p in got) and (len(got) == 1 or n > capacity)
        assert len(pieces[None]) == 1 and len(pieces[1]) >= 2 and pieces[1000] == [(0, 0, 0)]
    assert {r["budget_id"] for r in out} == {1, 2}
    assert not {r["container_id"] for r in out if r["budget_id"] == 1} & {r["container_id"] for r in out if r["budget_id"] == 2}


@needs_ranks
def test_nothing_to_pack(spark):
    one = budgets(spark, [(1, "n", 10)])
    assert pack_texts(docs(spark, []), one).count() == 0 and pack_texts(docs(spark, [(1, "a")]), one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_texts(docs(spark, [(1, "a")]), one, most_budgets=0)


# ------------------------------------------------------------------ leaks

ITEM = "item_id long, task string, lang string, text string, doc_id long"


def items(spark, rows):
    return spark.createDataFrame([(i, "t", "en", t, 1) for i, t in rows], ITEM)


def brute_leaks(docs_, items_, run):
    grams = lambda t: {tuple(w[i : i + run]) for w in [passage_words(t)] for i in range(len(w) - run + 1)} if t else set()
    held = [(i, grams(t)) for i, t in items_]
    return {(d, i) for d, t in docs_ for g in [grams(t)] for i, h in held if g & h}


def test_leaks(spark):
    rnd = random.Random(4)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(400)]
    held = [(i, " ".join(rnd.choice(rare if rnd.random() < 0.5 else common) for _ in range(rnd.choice([5, 13, 40, 90])))) for i in range(30)]
    held += [(90, None), (91, ""), (92, "以下" + "甲乙丙丁戊己庚辛壬癸子丑寅卯" + "辰"), (0, held[0][1])]
    corpus = []
    for i in range(300):
        words = [rnd.choice(common) for _ in range(rnd.choice([3, 50, 400]))]
        if i % 3 == 0:
            w = (rnd.choice(held[:30])[1] or "").split()
            a, n = rnd.randrange(max(1, len(w))), rnd.choice([12, 13, 14, 30])
            at = rnd.randrange(len(words))
            words[at:at] = w[a : a + n]
        corpus.append((i, rnd.choice([" ", "  ", ", "]).join(words).upper()))
    corpus += [(900, None), (901, ""), (902, "前文甲乙丙丁戊己庚辛壬癸子丑寅后文"), (903, held[1][1]), (903, held[1][1]), (None, held[1][1]), (904, "c1 " * 100_000)]
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, corpus), items(spark, held)).collect()}
    want = brute_leaks(corpus, held, 13)
    assert len(want) > 30 and (902, 92) in want
    assert got == want
    small = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, corpus), items(spark, held), most_items=7, block_passages=5, fit_documents=20).collect()}
    assert small == want


def test_gram_product():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (0, 1, 12, 13, 14, 26, 27, 100)]
    idf, matrix = np.append(rng.random(8), 0).astype(np.float32), np.vstack([rng.random((8, 3)), np.zeros((1, 3))]).astype(np.float32)
    a = np.zeros((0, 9))
    for t in texts:
        a = np.vstack([a, [[(w == i).sum() for i in range(9)] for w in leaks.windows(t, 8, 13)]])
    a = a * idf
    assert np.allclose(leaks._gram_product(texts, idf, matrix, 13)[:8], (a.T @ (a @ matrix))[:8], rtol=1e-4)


def test_paraphrase(spark):
    item = "suppose that a lessee of the tawny trellis began smelting near the saffron trellis on day 158 while the saffron icehouse stood idle for 16 weeks"
    loose = "suppose then that a lessee of some tawny trellis had begun smelting near that saffron trellis on day 158 while a saffron icehouse stood fully idle for 16 weeks"
    other = "suppose that a lessee of the granite trellis began baking near the copper trellis on day 7 while the velvet icehouse stood idle for 3 weeks"
    rows = [(1, loose), (2, item), (3, other)] + [(10 + i, f"the board of the office shall keep record {i} of the day") for i in range(50)]
    got = {r["doc_id"]: r for r in find_leaks(docs(spark, rows), items(spark, [(1, item)]), paraphrases=True).collect()}
    assert {*got} == {1, 2} and got[2]["run_words"] == 13 and got[1]["run_words"] == 0 and got[1]["common_words"] >= 16


def topics(seed=11):
    """Items and documents that share 13 words of no topic, between words of different topics."""
    rnd = random.Random(seed)
    topic = [[f"t{i}x{j}" for j in range(8)] for i in range(40)]
    talk = lambda i, n: [rnd.choice(topic[i]) for _ in range(n)]
    held, corpus = [], []
    for k in range(120):
        own = [f"own{k}x{j}" for j in range(13)]
        held.append((k, " ".join(talk(k % 40, 20) + own + talk(k % 40, 20))))
        corpus.append((k, " ".join(talk((k + 7) % 40, 30) + own + talk((k + 7) % 40, 30))))
    return held, corpus + [(1000 + i, " ".join(talk(i % 40, 60))) for i in range(4000)]


def test_rare_run_between_other_topics(spark):
    """A rank that holds the topics has no room for the runs; they are found all the same."""
    held, corpus = topics()
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, corpus), items(spark, held)).collect()}
    assert got == brute_leaks(corpus, held, 13) and len(got) >= 120


def search_of(held, corpus, rank, kind=leaks.RunSearch, **kw):
    known = leaks.read_items(held, 13)
    numbered = leaks._numbered(known.vocabulary)
    words = [numbered.of(t) for _, t in corpus]
    seen = np.bincount(np.concatenate([np.unique(w) for w in words]), minlength=numbered.pad + 1)[:-1]
    idf = np.append(1 + np.log((len(corpus) + 1) / (seen + 1)) / np.log(len(corpus) + 2), 0).astype(np.float32)
    x = np.zeros((len(known.passages), numbered.pad + 1), np.float32)
    np.add.at(x, (np.arange(len(x))[:, None], known.passages), 1)
    basis = np.linalg.svd((x * idf)[:, :-1], full_matrices=False)[2][:rank].T
    space = leaks.LatentSpace(idf, np.vstack([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32))
    extra = (leaks.rarity_of(known.vocabulary, seen), np.array([w.isdecimal() for w in known.vocabulary]), 0.6) if kind is leaks.ParaphraseSearch else ()
    return kind(space, numbered, known.passages, known.owner, 13, *extra), x * idf


def test_places_bound_cosines():
    """The cosine of two places is never below that of the passages; more rank examines fewer pairs."""
    held, corpus = topics()
    examined = []
    for rank in (1, 64, 300):
        search, dense = search_of(held, corpus, rank)
        unit = dense / np.linalg.norm(dense, axis=1, keepdims=True)
        assert ((search.place.T @ search.place) >= unit @ unit.T - 1e-5).all()
        cut = np.concatenate([leaks.windows(search.numbered.of(t), search.pad, 13) for _, t in corpus[:1000]])
        least = search.space.least_run(cut, 13)
        examined.append(len(search.candidates(cut[np.isfinite(least)], least[np.isfinite(least)], search.asked)[0]))
    assert examined[0] > examined[1] > examined[2] > 0


def test_paraphrases_at_every_offset(spark):
    """Against all stretches of 26 words of each document, wherever they begin: none is missed."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    held = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([13, 20, 26, 60])))) for i in range(25)]
    corpus = []
    for offset in range(39):
        w = rnd.choice(held)[1].split()
        at = rnd.randrange(max(1, len(w) - 25))
        told = [x if rnd.random() < 0.8 else rnd.choice(vocabulary) for x in w[at : at + 26]]
        noise = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
        corpus.append((offset, " ".join(noise(offset) + told + noise(rnd.randrange(60)))))
    search, _ = search_of(held, corpus, 16, leaks.ParaphraseSearch)
    want = set()
    for d, t in corpus:
        words = search.numbered.of(t)
        for q, listed in enumerate(search.lists):
            for a in range(max(1, len(words) - 25)):
                span = words[a : a + 26].tolist()
                if common_subsequence(listed, [x for x in span if x < search.pad]) >= search.needed[q] and len(search.answers[q] & {*span}) >= search.needs[q]:
                    want.add((d, int(search.owner[q])))
                    break
    got = {(d, i) for d, i, _, _ in search.hits([search.numbered.of(t) for _, t in corpus])}
    assert len(want) > 15 and want <= got
    whole = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, corpus), items(spark, held), paraphrases=True, fit_documents=3).collect()}
    assert {(d, search_item) for d, search_item in want} <= whole


def test_no_leaks(spark):
    words = " ".join(f"w{i}" for i in range(20))
    assert find_leaks(docs(spark, [(1, None), (2, "")]), items(spark, [(1, words), (None, words)]), paraphrases=True).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, [(None, words), (2, words)]), items(spark, [(1, words), (None, words), (3, None)]), paraphrases=True).collect()} == {(None, 1), (None, None), (2, 1), (2, None)}
    some = items(spark, [(1, "one two three")])
    assert find_leaks(docs(spark, []), some).count() == 0 and find_leaks(docs(spark, [(1, "a")]), some.limit(0)).count() == 0 and find_leaks(docs(spark, [(1, "one two three")]), some).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    assert common_subsequence(a, b) == row[-1]


# ------------------------------------------------------------------ sentences

LAW = "The clerk may keep each record. The office closes at noon. Who may see the board? In time the board may wait. No clerk is late. "
UNITS = [
    "The lot was leased to Norwood Timber Co. and later to Calloway Wharf, Inc.|The clerk signed it.",
    "The office closes at 5:46 p.m.|Who may see the board?|It opens at 8 a.m. in Norwood.",
    "Goods shipped from the U.S. to Norwood, i.e. by way of St. Valecroft, need a seal.|The board met.",
    "D. R. Pinecrest, Esq., joint steward, signed it on Dec. 8, 1975.|Costs (e.g. postage, etc.) are 3.5 percent!|Cf. art. 12, cl. 1, and Ex. D to the plan.",
    "The sign reads “No entry. Ask the board.” in letters 4.5 inches high.|The clerk wrote: “The plan is kept.”|The board met.",
    "“Was it kept?” the clerk asked.|“It is late,” the clerk noted, “and it was not kept.”|How was it kept?!|The clerk may wait … and then act …|No one did.",
    "(The amount in table 7.16 is $80,184.70.)|17. The waiver is kept in 1995.|(c) The board may act.|iForm No. 2.6 replaces it.",
    "The notice lists:\n(a) each plan;\n(b) each seal; and\n(c) each record kept in 1995.|The board met.",
    "The notice lists:\n(a) each plan.\n(b) each record.|The board met.",
    "The notice lists:\n(a) each plan; and\n(b) each record.|(c) The board met.|(a) Each seal is kept.",
    "Sec. 37. Archives.||CHAPTER 28. HEDGES||Part F — Fairs||§ 9.9  Final record",
    "See example.com and v1.2.3 of it.|Under 2 U.S.C. 559, it ends.",
    "Am 14. Oktober 1995 prüft das Amt die Urkunde, z. B. im Haus.|Auf dem Schild steht: „Zutritt verboten. Das Amt prüft.“|Der Satz beträgt ca. 8,2 Prozent bzw. 7.131 Taler.|„Wer sucht es?“, fragte das Amt.",
    "Según el art. 66, núm. 6, la junta publica el acta.|«¿Dónde está el plano?», preguntó la junta.|El aviso se manda desde EE. UU. y cuesta 3,8 por ciento, p. ej. hoy.|¡No se admite!",
    "Le taux est d'env. 3,3 % (cf. annexe n° 1).|« Où est la carte ? » demanda le greffe.|L'affiche indique : « Entrée interdite. Le greffe examine. »|Qui publie la carte ?",
    "依照第87.6条，可以核对；费用为8.2元。|登记处问道：“在哪里？”|告示写明“禁止入内。请联系。”并加盖印章。|不得公布！",
    "看板には「立入禁止。連絡のこと。」と書かれている。|だれが保管するか？|第26.8条により補正する。",
    "सूचना में लिखा है “प्रवेश वर्जित। समिति से मिलें।” और मुहर लगी है।|शुल्क 9.4 प्रतिशत है और डॉ. शब्द लिखा है।|कौन देख सकता है?",
    "تبلغ الرسوم 6.5 في المئة؛ ويدفعها المكتب.|من يستطيع أن يطلب القائمة؟|يراجع المكتب الدفتر.",
    "ดร. สมชายอยู่ ๕ วัน|(ห้าม) Act|ห้าม",
    "ค่าธรรมเนียมคิดเป็น 8.1 ส่วนของใบรับเงิน|หอจดหมายเหตุต้องตรวจสอบภายใน 50 วันหลังได้รับแจ้ง|ห้ามตรวจสอบ||หมวด 32",
]


def corpus():
    e = Evidence()
    e.add(LAW * 5 + "The board may act in no case, and the clerk and who it was. " * 9)
    return {w: (e.inner[w], e.word[w], e.name[w]) for w in {*e.inner, *e.word, *e.name}}


@pytest.mark.parametrize("gap", [" ", "  ", "\n"])
@pytest.mark.parametrize("marked", UNITS)
def test_units(marked, gap):
    thai = re.search("[฀-๿]", marked)
    wide = re.search("[぀-ヿ㐀-鿿]", marked)
    if thai and gap != " ":
        gap = " "
    text, want = "", []
    for block in marked.split("||"):
        text += "\n \n" if text else ""
        for i, unit in enumerate(block.split("|")):
            text += ("" if wide else gap) if i else ""
            want.append((len(text), len(text) + len(unit)))
            text += unit
    text = text + " \n"
    got = sentence_units(text, Verdicts(corpus()))
    assert [text[a:b] for a, b in got] == [text[a:b] for a, b in want]


def test_boundary_without_space():
    text = "The word is kept.The board met at 3.Was it late?“Yes.” B. N. Ironvale left.B. Moore stayed."
    got = [text[a:b] for a, b in sentence_units(text, Verdicts(corpus()))]
    assert got[0] == "The word is kept." and got[1].startswith("The board") and "Was it late?" in got[-3] + got[-4]


def test_document_decides():
    """The same words, told apart by what the document shows elsewhere."""
    odd = "He left for Kov. Norwood is far. They keep kov. for a road, and kov. is short. "
    assert not any(t.endswith("Kov.") for t in [odd[a:b] for a, b in sentence_units(odd + "In old Norwood it rains, near Norwood too.", Verdicts({}))])
    plain = "He left for Kov. They met in Kov in May, and Kov is far."
    assert [plain[a:b] for a, b in sentence_units(plain, Verdicts({}))][0] == "He left for Kov."


def units(text, counts=None):
    return [text[a:b] for a, b in sentence_units(text, Verdicts(counts or {}))]


@pytest.mark.parametrize("shown", ["", " There is no doubt, no art, no fig, no mar and no delay. No hay mar, no hay art y no hay fig ni no."])
@pytest.mark.parametrize("first, second", [("The clerk said no.", "The board left."), ("La junta dijo que no.", "El secretario vino."), ("She studied art.", "The board met."), ("Vio el mar.", "El barco vino."), ("He ate a fig.", "The tree fell.")])
def test_listed_words_end_sentences(first, second, shown):
    assert units(f"{first} {second}{shown}")[:2] == [first, second]


def test_listed_words_before_what_they_belong_to():
    whole = "See No. 5, Art. XII of it, Sec. A-1 and Ex. D to the plan."
    assert units(whole + " Mr. Norwood met Dr. Who in St. Mary.") == [whole, "Mr. Norwood met Dr. Who in St. Mary."]
    assert units("He met the rep. The clerk saw the rep, and the rep left. Mr. Norwood left.")[0] == "He met the rep."


def test_long_abbreviations_and_deep_brackets():
    odd = "He left the Departementalrat. Norwood is far. A departementalrat. is old. In old Norwood, near Norwood too."
    assert units(odd)[0] == "He left the Departementalrat. Norwood is far."
    deep = "The plan (a (b (c (d (e) f. Then it ends) x) y) z) is kept."
    assert units(deep + " It ends.") == [deep, "It ends."]


def test_verdicts_are_proportions(spark):
    """Twice the corpus says the same of every word."""
    rows = [(i, f"They met kov. now. He left for Kov. Norwood is far. It is the old Norwood road {i}." if i % 3 else f"The kov and the Kov. Norwood {i}.") for i in range(9)]
    found = [sorted((r["doc_id"], r["start_char"], r["end_char"]) for r in split_sentences(docs(spark, r)).where("doc_id < 100").collect()) for r in (rows, rows + [(100 + i, t) for i, t in rows])]
    assert found[0] == found[1]


def test_time_is_linear():
    """Sixteen times the words, all of them in doubt, take far less than 16 * 16 times as long."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    text = lambda n: " ".join(f"The w{name(i)}q. Zed{name(i)} met inc. Yon{name(i)} it, and so:\n(1) one.\n(2) two." for i in range(n))
    took = []
    for n in (1000, 16_000):
        t, began = text(n), time.process_time()
        units(t)
        took.append(time.process_time() - began)
    assert took[1] < 64 * took[0]
    items = "The list:\n" + "\n".join(f"{i}. Item is it." for i in range(1, 900))
    assert len(units(items)) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\r“”()«»。「」:;…เा।​　é", max_size=60))
def test_units_cover_what_is_visible(text):
    last, inside = 0, set()
    for a, b in sentence_units(text, Verdicts({})):
        assert last <= a < b <= len(text) and text[a:b] == text[a:b].strip()
        last = b
        inside |= {*range(a, b)}
    assert all(i in inside or c.isspace() or c == "​" for i, c in enumerate(text))


def test_split(spark):
    rows = [(1, "One is here. Two is here."), (2, None), (3, ""), (4, " \n\t​ "), (None, "x"), (1, "One is here. Two is here."), (5, "word " * 60_000), (6, "A b. " * 20_000)]
    out = split_sentences(docs(spark, rows), with_text=True)
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"], r["sentence"]))
    assert sorted(by[1]) == sorted([(0, 12, "One is here."), (13, 25, "Two is here.")] * 2)
    assert {2, 3, 4} & {*by} == set() and by[None] == [(0, 1, "x")] and by[5] == [(0, 299_999, ("word " * 60_000).strip())]
    assert len(by[6]) == 20_000
    assert split_sentences(docs(spark, [])).count() == 0


def test_rare_words_of_a_large_corpus(spark):
    """A name that the corpus has four times among half a million words still decides, broadcast or joined."""
    odd = "They met kov. now, and kov. here. He left for Kov. Norwood is far. So u.s.kov. Is it?"
    rows = [(0, "word " * 500_000), *((i, "It is the old Norwood road.") for i in range(1, 5)), (5, odd), (6, odd), (7, None)]
    found = [sorted((r["doc_id"], r["sentence"]) for r in split_sentences(docs(spark, rows), with_text=True, **kw).collect()) for kw in ({}, {"most_words": 2})]
    assert (5, "He left for Kov. Norwood is far.") in found[0]
    assert found[0] == found[1]


def test_fixed_answers():
    assert leaks.passage_words("Ab_c 第12条 x") == ["ab", "c", "第", "12", "条", "x"]
