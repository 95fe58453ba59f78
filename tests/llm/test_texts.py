import random

import pytest

from vecloom.llm import garbled
from vecloom.llm.garbled import Ciphers, garbled_lines, restore
from vecloom.llm.leaks import Automaton, columns, fold, leaks, leaks_of, without_leaks

WORDS = "standing beside the narrow bridge of tarnwick many quiet voices rose above a muddy harvest because every child knew that eleven wooden carts had been closed before noon and nobody forgot the lengthy season".split()


def page(lines, x0=40, y0=60, step=25, width=9):
    return [(ln, {"x0": x0, "y0": y0 + step * i, "x1": x0 + width * len(ln), "y1": y0 + step * i + 20}) for i, ln in enumerate(lines)]


def found(items, placed):
    text = "\n".join(a for a, _ in placed)
    return set(leaks_of(Automaton(items), {}, text, [b for _, b in placed], False))


ITEM = " ".join(WORDS[:30])
FILLER = ["One modest paragraph about", "something else entirely, so", "that nothing here matches."]


def test_automaton_against_brute_force():
    r = random.Random(4)
    for _ in range(150):
        items = [(k, " ".join(r.choice("abc") * 2 for _ in range(r.randrange(1, 30)))) for k in range(4)]
        text = " ".join(r.choice("abcd") * 2 for _ in range(60))
        doc = [fold(w) for w in text.split()]
        want = set()
        for k, t in items:
            seq = [fold(w) for w in t.split()]
            n = min(12, len(seq))
            if any(doc[i : i + n] == seq[j : j + n] for i in range(len(doc) - n + 1) for j in range(len(seq) - n + 1)):
                want.add(k)
        assert set(leaks_of(Automaton(items), {}, text, None, False)) == want


def test_twelve_words_and_no_fewer():
    for n, hit in ((11, False), (12, True), (20, True)):
        w = WORDS[3 : 3 + n]
        lines = FILLER + [" ".join(w[i : i + 4]) for i in range(0, n, 4)] + FILLER
        assert (found([(1, ITEM)], page(lines)) == {1}) is hit


def test_passage_inside_a_longer_run_of_another_item():
    inner = " ".join(["gladly", *WORDS[4:17], "onwards"])
    items = [(1, ITEM), (2, inner), (3, " ".join(["gladly", *WORDS[20:31], "onwards"]))]
    lines = page(FILLER + [" ".join(WORDS[i : i + 5]) for i in range(0, 30, 5)] + FILLER)
    text, boxes = "\n".join(a for a, _ in lines), [b for _, b in lines]
    got = leaks_of(Automaton(items), {}, text, boxes, True)
    assert {k: v[:2] for k, v in got.items()} == {1: (30, 30), 2: (13, 13)}
    assert [" ".join(text[s:e].split()) for s, e in got[2][2]] == [" ".join(WORDS[4:17])]


def test_stock_phrase_after_an_advert():
    stock = WORDS[8:12]
    items = [(1, ITEM)] + [(k, f"opening{'x' * k} {' '.join(stock)} ending{'k' * k}") for k in range(2, 102)]
    lines = page(FILLER + [" ".join(WORDS[0:4]), " ".join(WORDS[4:8])] + ["Soap! Best soap! £2"] + [" ".join(stock)] + FILLER)
    assert found(items, lines) == {1}


def test_short_item_needs_all_words():
    item = [(7, "neither tower nor the meeting gave way,.")]
    assert found(item, page(["Neither TOWER nor", "the mee-", "ting gave way"])) == {7}
    assert found(item, page(["Neither tower nor", "the meeting gave"])) == set()


def test_case_punctuation_breaks_and_misread_letters():
    lines = ["NARROW bridqe of Tarn¬", "wick, rnany “quiet” voi=", "ces rose abovc; a mud-", "dy harvest bccause"]
    assert found([(1, ITEM)], page(lines)) == {1}


def test_columns_side_by_side_and_run_together():
    left = [" ".join(WORDS[i : i + 3]) for i in range(0, 24, 3)]
    right = [f"other words stand {c}" for c in "abcdefgh"]
    side = [z for pair in zip(page(left), page(right, 480, 63)) for z in pair]
    assert found([(1, ITEM)], side) == {1}
    both = [(f"{a}  {b}", {"x0": 40, "y0": 60 + 25 * i, "x1": 480 + 9 * len(b), "y1": 80 + 25 * i}) for i, (a, b) in enumerate(zip(left, right))]
    assert found([(1, ITEM)], both) == {1}
    # a run that begins in one column and ends in the next is none
    half = page(FILLER + [" ".join(WORDS[0:4]), " ".join(WORDS[4:8])]) + page([" ".join(WORDS[8:12]), " ".join(WORDS[12:14]), *FILLER], 480)
    assert found([(1, ITEM)], half) == set()


def test_advert_inside():
    lines = page(FILLER + [" ".join(WORDS[0:5]), " ".join(WORDS[5:8]) + " qu-"])
    ad = page(["Soap! Best soap! £2"], 60, 60 + 25 * 5)
    rest = page(["iet " + " ".join(WORDS[9:13]), " ".join(WORDS[13:15])], 40, 60 + 25 * 6)
    assert found([(1, ITEM)], lines + ad + rest) == {1}


def test_columns_degenerate():
    assert columns("", None) == [[(0, 0, 0, False)]]
    assert columns("a\nb", [None, None]) == [[(0, 0, 1, False), (1, 0, 1, False)]]
    assert found([(1, ""), (2, None), (3, "—")], page(["—", ""])) == set()


SCHEMA = "doc_id long, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int>>, item_id long"


def test_leaks_and_cleaning(spark):
    leak = "\n".join(FILLER + [" ".join(WORDS[i : i + 4]) for i in range(0, 16, 4)] + FILLER)
    docs = spark.createDataFrame([(1, leak, None, 5), (2, None, None, 5), (3, "", None, 5), (4, "word " * 50000, None, 5), (5, leak, None, 5)], SCHEMA)
    items = spark.createDataFrame([(9, ITEM, 1), (None, "x", 1), (8, None, 1), (7, ITEM, 1)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): (r["longest"], r["coverage"]) for r in leaks(docs, items).collect()}
    assert set(got) == {(1, 9), (5, 9), (1, 7), (5, 7)} and got[1, 9][0] == 16 and abs(got[1, 9][1] - 16 / 30) < 1e-9
    clean = {r["doc_id"]: r for r in without_leaks(docs, items).collect()}
    assert set(clean) == {1, 5} and clean[1]["item_ids"] == [7, 9]
    assert "voices" not in clean[1]["text"] and "matches." in clean[1]["text"]
    assert leaks(docs, items.where("item_id < 0")).count() == 0 and leaks(docs.where("doc_id < 0"), items).count() == 0


RU = ["Старый мост через реку закрыли утром потому что лёд подмыл опоры и городской совет боялся за людей", "Новая школа возле вокзала откроется осенью когда мастера закончат крышу а учителя получат книги из столицы"]
GR = ["Η παλιά γέφυρα του χωριού έκλεισε το πρωί επειδή ο πάγος έσπασε τις κολόνες και ο δήμαρχος φοβήθηκε", "Το νέο σχολείο κοντά στον σταθμό ανοίγει το φθινόπωρο όταν οι τεχνίτες τελειώσουν τη στέγη του μεγάλου κτιρίου"]
FRS = ["Où là à été déjà près là où été à dès été cédé à même côté où été né près là", "À peine née la fée gênée léguait là sa forêt brûlée à l’évêque âgé près du château hanté de l’île"]


def test_other_scripts_and_accents():
    for texts in (RU, GR, FRS):
        for k in (0, 1):
            lines = [" ".join(texts[1 - k].split()[i : i + 5]) for i in range(0, 25, 5)]
            assert found([(1, texts[k])], page(lines)) == set()
            lines = [" ".join(texts[k].split()[i : i + 5]).upper() for i in range(0, 25, 5)]
            assert found([(1, texts[k])], page(lines)) == {1}
    lines = [" ".join(FRS[1].split()[i : i + 5]) for i in range(0, 25, 5)]
    for read in ("cp1252", "cp437", "mac_roman", "latin_1"):
        assert found([(1, FRS[1])], page([x.encode("utf-8").decode(read, "replace") for x in lines])) == {1}
    assert found([(1, FRS[1])], page([x.encode("cp1252").decode("cp850") for x in lines])) == {1}
    assert fold("Żółć") == fold("zolc") and fold("—") == "" and fold("лёд") == fold("ЛЕД") != fold("лес")


FR = "La préfecture de Rochançon a été repeinte dès l’été — fort générale — et la sévère forêt fut mesurée. Où donc est passée la clôture à Bréançon? Près de là, la fête «générale» fut évacuée. ÉCOLE DE LA CHAUSSÉE"
DE = "Die schöne Wäscherei bei Grünerberg wurde überflutet, die große Straße blieb für 604 Gäste geschlossen. Äpfel, süß. Die Gießerei läßt sich prüfen. ÖFEN UND WÜRSTE"
EN = "Miss Selby’s brewery won the second prize; the parade can’t be sold at a cost of £459 — said “the muddy season”. Pills, 1s. 1½d. per box; 4¹ the case; 60° guaranteed"


def corpus(pages=40):
    docs = []
    for i in range(pages):
        for k, (lang, t) in enumerate((("fr", FR), ("de", DE), ("EN", EN))):
            words = t.split()
            docs.append((100 * i + k, "\n".join(" ".join(words[j : j + 6]) for j in range(0, len(words), 6)), lang if i % 7 else None, f"{lang} paper"))
    return docs


@pytest.mark.parametrize(("read", "page_"), [("cp1252", "utf-8"), ("cp1250", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("latin_1", "utf-8"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850")])
def test_whole_pages_in_the_wrong_code_page(spark, read, page_):
    c = Ciphers()
    to, back = c.pages[read][0], None
    docs = corpus()

    def spoil(t):
        raw = t.encode("utf-8") if page_ == "utf-8" else bytes(c.pages[page_][1].get(ch, 63) for ch in t)
        return "".join(to[b] for b in raw)

    bad = {0, 301, 602} if page_ != "utf-8" else {0, 301, 602, 1502}
    bad = {d for d in bad if any(d == x[0] for x in docs)}
    spoiled = [(d, spoil(t) if d in bad else t, lang, s) for d, t, lang, s in docs]
    df = spark.createDataFrame(spoiled, "doc_id long, text string, lang string, source string")
    lines = garbled_lines(df)
    assert {r["doc_id"] for r in lines.collect()} == bad
    fixed = {r["doc_id"]: r["text"] for r in restore(df, lines).collect()}
    right = {d: t for d, t, _, _ in docs}
    same = [sum(a == b for a, b in zip(fixed[d], right[d])) / len(right[d]) for d in bad]
    assert back is None and min(same) > (0.97 if page_ == "utf-8" else 0.9)


@pytest.mark.parametrize(("read", "page_"), [("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("swapped", None), ("strange", None)])
def test_a_whole_source(spark, monkeypatch, read, page_):
    """All pages of one source: through Cyrillic pages, and through letter tables that no page has."""
    letters = sorted({ch for ch in FR if ch.isalpha() and ch > "\x7f"})
    if page_ is None:
        to = letters[1:] + letters[:1] if read == "swapped" else [chr(0x10A0 + 7 * k) for k in range(len(letters))]
        table = str.maketrans(dict(zip(letters, to)))
        spoil = lambda t: t.translate(table)
    else:
        spoil = lambda t: t.encode(page_, "replace").decode(read, "replace")
    right = {d: (t, lang, s) for d, t, lang, s in corpus(40 if page_ else 200)}
    bad = {100 * i for i in range(20 if page_ else 4)}
    df = [(d, spoil(t) if d in bad else t, lang, "spoiled" if d in bad else s) for d, (t, lang, s) in right.items()]
    df = spark.createDataFrame(df, "doc_id long, text string, lang string, source string")
    lines = garbled_lines(df)
    assert {r["doc_id"] for r in lines.collect()} == bad
    fixed = {r["doc_id"]: r["text"] for r in restore(df, lines).collect()}
    same = [sum(a == b for a, b in zip(fixed[d], right[d][0]) if b > "\x7f") / sum(b > "\x7f" for b in right[d][0]) for d in bad]
    assert min(same) > (0.9 if page_ else 0.6)
    if page_ is None:  # without learning only known pages are there
        monkeypatch.setattr(garbled, "ROUNDS", 0)
        assert not {r["doc_id"] for r in garbled_lines(df).collect()} & bad


def test_single_line_replacement_character_and_misreadings(spark):
    docs = corpus()
    by = {d: t for d, t, _, _ in docs}
    docs = [(d, t.replace("season”", "season�", 1) if d == 2 else t, lang, s) for d, t, lang, s in docs]
    first = by[100].split("\n")
    docs = [(d, "\n".join([first[0].encode().decode("cp1252", "replace"), *first[1:]]) if d == 100 else t, lang, s) for d, t, lang, s in docs]
    docs += [(9000, "La préfecture a étc repeinte, 1s. ú1tima scène, côte, montèrent", "fr", "x"), (9001, None, "fr", None), (9002, "", None, None), (9003, "plain ascii " * 20000, "en", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lines = garbled_lines(df)
    assert {r["doc_id"] for r in lines.collect()} == {2, 100}
    out = {r["doc_id"]: r for r in restore(df, lines).collect()}
    assert out[100]["text"] == by[100] and out[100]["recovered"] and not out[2]["recovered"]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    lines = garbled_lines(none)
    assert lines.count() == 0 and restore(none, lines).count() == 0


def test_double_encoding_is_undone():
    c = Ciphers()
    twice = "é".encode().decode("cp1252").encode().decode("cp1252")
    assert "é" in c.before(twice).values()


def test_bigrams_beyond_those_in_memory_count_too(spark, monkeypatch):
    to = Ciphers().pages["cp1252"][0]
    spoiled = [(d, "".join(to[b] for b in t.encode("utf-8")) if d in (0, 301, 602, 1502) else t, g, s) for d, t, g, s in corpus(20)]
    docs = spark.createDataFrame(spoiled, "doc_id long, text string, lang string, source string").persist()

    def all_of():
        _, every, sizes, _ = garbled.counts(docs)
        pairs, rare = garbled.held(every, sizes)
        model = garbled.Bigrams(pairs, sizes, rare)
        model.usual = garbled._usual(model)
        return model, {(r[0], r[1]) for r in every.collect()}, rare, pairs

    full, names, none, _ = all_of()
    lines = sorted(map(repr, garbled_lines(docs).drop("gain").collect()))
    monkeypatch.setattr(garbled, "MOST_PAIRS", 10)
    part, _, rare, pairs = all_of()
    assert none is None and rare is not None and len(pairs) < len(names) and lines
    for g, ab in names:
        assert part.two[g].get(ab, 0) == pytest.approx(full.two[g].get(ab, 0)) and part.two[g].get(ab, 0) > 0
    for g in full.size:
        for a, b in ((part.left, full.left), (part.right, full.right), (part.all, full.all)):
            assert a[g] == pytest.approx(b[g])
        assert part.two[g].get("一丁", 0) == 0
    assert part.letters == full.letters and part.after == full.after and part.usual == pytest.approx(full.usual)
    assert sorted(map(repr, garbled_lines(docs).drop("gain").collect())) == lines
