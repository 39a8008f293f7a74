"""The training-data operators against brute force, the library tokenizer and hand-made cases."""

import random
import unicodedata
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrel.llm import sentences as S
from quadrel.llm.leaks import leaks, words_of
from quadrel.llm.spellings import collapsed, duplicate_ids
from quadrel.llm.term_frequency import marked_terms, term_frequencies
from quadrel.llm.tokenizer import DEFAULT_VOCABULARY, BytePairEncoder, decode_ids, encode_texts

# ---------------------------------------------------------------- term frequencies


def test_frequencies_with_hot_terms_and_nulls(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, 1, 2, 3]), 7 if i % 3 == 0 else r.choice([None, 8, 9])) for i in range(400)]
    rows += [(5, 1, 7)] * 300 + [(None, 1, 11)] * 5 + [(None, None, None)]
    df = spark.createDataFrame(rows, "subject long, predicate long, object long").repartition(9).withColumn("field", F.lit("clash"))
    want = {}
    for s, *values in rows:
        for f, v in zip(("predicate", "object"), values):
            if v is not None:
                n, who = want.setdefault((f, v), [0, set()])
                want[f, v][0] = n + 1
                if s is not None:
                    who.add(s)
    got = {(x["field"], x["term"]): (x["occurrences"], x["records"]) for x in term_frequencies(df, ["predicate", "object"], "subject").collect()}
    assert got == {k: (n, len(w)) for k, (n, w) in want.items()}
    every = len({s for s, *_ in rows if s is not None})
    marks = {(k, m) for k, (n, w) in want.items() for m, ok in (("rare", len(w) <= 2), ("common", len(w) > 0.1 * every)) if ok}
    assert {((x["field"], x["term"]), x["mark"]) for x in marked_terms(df, ["predicate", "object"], "subject").collect()} == marks
    assert term_frequencies(df.limit(0), ["predicate", "object"], "subject").count() == 0


# ---------------------------------------------------------------- spellings

def word_key(value):
    """The rule of the problem, one character at a time."""
    low = value.lower()
    letter = lambda c: unicodedata.category(c)[0] in "LN"
    digit = lambda c: unicodedata.category(c)[0] == "N"
    if not any(map(letter, value)):
        return ("bare", value.strip())
    fields = []
    for field in low.replace("|", ";").split(";"):
        out = ""
        for i, c in enumerate(field):
            before, after = field[i - 1 : i] if i else "", field[i + 1 : i + 2]
            between = before and after and digit(before) and digit(after) and not c.isspace()
            sign = c in "+-" and after and digit(after) and not (before and letter(before))
            out += c if letter(c) or between or sign else " "
        if out.split():
            fields.append(" ".join(out.split()))
    return tuple(sorted(fields))


def test_duplicates_against_brute_force(spark):
    r = random.Random(7)
    base = ["Map, x 3.9", "map x 3.9", "MAP X 3.9 ", "map x 39", "map x 3,9", "-5 a", "5 a", "a -5", "a-5", "a 5", "+5", "1-2", "1 2", "1--2", "street: A 7; town: B", "town: b|Street a 7", "b; a", "b a", "a;;b;", "...", " ...", "!", "", "  ", "é", "e", "É", "«é»", "1;2", "2;1", "1 ;2", "x" * 5000 + "!", "X" * 5000, "日本 語", "日本語"]
    iris = ["http://A/b", "<HTTP://a/B>", " http://a /b\t", "http://a/b/", "<<http://a/b>>", "xsd:string"]
    rows = []
    for i in range(600):
        if r.random() < 0.25:
            rows.append([i, 2, r.choice(iris), r.choice([None, 9000]), r.choice([None, "en"])])
        else:
            rows.append([i, r.choice([16, 17, 22]), r.choice(base), r.choice([None, 9000, 9001, 9002, 77]), r.choice([None, None, "en-GB", " EN_gb", "en"])])
    rows += [[7000 + i, 22, "hot", None, None] for i in range(300)]  # a third are copies of one row
    rows += [[8000, 1, "b", None, None], [8001, 1, "b", None, None], [8002, 22, None, None, None], [8003, 22, None, None, None], [8004, None, "hot", None, None], [None, 22, "hot", None, None], [8005, 99, "hot", None, None]]
    rows += [[9000, 2, "xsd:string", None, None], [9001, 2, "<XSD:String>", None, None], [9002, 2, "xsd:decimal", None, None]]
    names = {9000: "xsd:string", 9001: "xsd:string", 9002: "xsd:decimal"}

    def key(row):
        _, kind, value, dt, lang = row
        if kind == 2:
            v = "".join(value.lower().split())
            return ("iri", v[1:-1] if v.startswith("<") and v.endswith(">") else v)
        return ("lit", word_key(value), names.get(dt, f"#{dt}") if dt is not None else "xsd:string", None if lang is None else lang.strip().lower().replace("_", "-"))

    groups = {}
    for row in rows:
        if row[0] is not None and row[1] in (2, 16, 17, 22) and row[2] is not None:
            groups.setdefault(key(row), []).append(row[0])
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    df = spark.createDataFrame(rows, "id long, type int, value string, datatype long, language string").repartition(7).withColumn("key", F.lit(1))
    assert sorted(tuple(x) for x in duplicate_ids(df).collect()) == want
    got = collapsed(df).collect()
    assert sum(x["copies"] for x in got) == sum(1 for row in rows if row[0] is not None)
    assert {x["kept_id"]: x["copies"] for x in got if x["copies"] > 1} == {min(g): len(g) for g in groups.values() if len(g) > 1}
    assert duplicate_ids(df.limit(0)).count() == 0 and collapsed(df.limit(0)).count() == 0


# ---------------------------------------------------------------- tokenizer

@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(DEFAULT_VOCABULARY)
    library.encode_special_tokens = True
    with open(DEFAULT_VOCABULARY, encoding="utf-8") as f:
        return BytePairEncoder(f.read()), library


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="aehinrst0 '\n"), st.text(alphabet="ab", max_size=60), st.text(alphabet="日本語กि́👩‍ "), st.sampled_from(["<|endoftext|>", "a<|endoftext|>b", "a" * 3000, " " * 50, "\x00﻿"])))
def test_encoding_equals_the_library(pair, text):
    own, library = pair
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_encoding_of_a_frame(spark, pair, data):
    _, library = pair
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in encode_texts(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    back = {r["doc_id"]: r["text"] for r in decode_ids(encode_texts(docs)).collect()}
    assert back == texts
    edge = spark.createDataFrame([(1, None), (2, ""), (2, "a"), (None, "a")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["ids"]) for r in encode_texts(edge).collect()), key=str) == sorted([(1, []), (2, []), (2, [64]), (None, [64])], key=str)
    assert encode_texts(edge.limit(0)).count() == 0
    assert decode_ids(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<long>")).orderBy("doc_id").collect() == [(1, None), (2, "")]


# ---------------------------------------------------------------- leaks

#: Words that the corpus uses all the time; what is rarer than LEAST_SEEN is a name.
COMMON_WORDS = "on page the clerk cook wrote that road lake and map of had been quiet for days km before after so end".split()
LEAST_SEEN = 60


def filler():
    r = random.Random(5)
    words = COMMON_WORDS * LEAST_SEEN
    r.shuffle(words)
    return (900, " ".join(f"{w}, 4" if i % 9 == 0 else w for i, w in enumerate(words)) + " 3 km" * LEAST_SEEN)


def test_leaks(spark):
    item = "On page 12 the clerk Adam wrote that the road and the map of Bern had been quiet for 3 km"
    words = item.split()
    docs = [
        (1, "Before. " + item + " After"), (1, "Before. " + item + " After"), (2, " ".join(words[3:13]).upper()), (3, " ".join(words[3:12])), (4, "; ".join(words[:10])), (5, None), (6, ""), (7, "x " * 20),
        (8, item.replace("12", "77").replace("Adam", "Zoe").replace("Bern", "Rome").replace(" 3 ", " 9 ")), (9, item.replace("12", "77")), (10, item.replace("road", "lake")), (None, item), (11, ("z " * 5000) + item), (12, item.replace("Adam", "Bern")), filler(),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3))
    e = spark.createDataFrame([(100, item), (100, item), (101, "too short"), (102, None), (103, "x " * 12)], "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = [(r["doc_id"], r["item_id"]) for r in leaks(d, e).collect()]
    brute = set()
    norm = lambda t: ["".join(c for c in w.lower() if c.isalnum()) for w in t.replace(";", " ").replace(".", " ").split()] if t else []
    for i, t in docs:
        for j, x in ((100, item), (103, "x " * 12)):
            a, b = norm(t), norm(x)
            grams = {tuple(b[k : k + 10]) for k in range(len(b) - 9)}
            if any(tuple(a[k : k + 10]) in grams for k in range(len(a) - 9)):
                brute.add((i, j))
    assert set(got) == brute
    kinds = {(r["doc_id"], r["kind"]) for r in leaks(d, e, reworded=True, least=LEAST_SEEN).collect()}
    assert (8, "reworded") in kinds and (9, "reworded") in kinds
    assert (1, "reworded") not in kinds and (10, "reworded") not in kinds and (12, "reworded") not in kinds
    single = leaks(d, e.where("item_id = 103"))
    assert [r["doc_id"] for r in single.collect()] == [7]
    assert leaks(d, e.limit(0)).count() == 0 and leaks(d.limit(0), e).count() == 0


def test_repeated_documents_count_one_by_one(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, item), (1, item), (2, item)], "doc_id long, text string")
    e = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in leaks(d, e).collect()) == [1, 1, 2]


def test_reworded_parts_of_items(spark):
    item = "On page 12 the clerk Adam wrote that the road and the map of Bern had been quiet for 3 days"
    changed = item.replace("12", "77").replace("Adam", "Zoe").replace("Bern", "Rome").replace(" 3 ", " 9 ").split()
    broken = item.replace("clerk", "cook").replace("Bern", "Rome")  # the first window is gone
    twice = item.replace("Adam", "Zoe").split()
    docs = [
        (1, " ".join(changed[3:])), (2, " ".join(changed[:16])), (3, "And so: " + " ".join(changed[4:17]) + ". The end"), (4, broken),
        (5, " ".join(item.split()[3:])), (6, " ".join(changed[5:14])), (7, " ".join(twice[1:14]) + " Zoe had been quiet"), (8, " ".join(changed[6:]) + " . " + " ".join(changed[:12])),
        (9, "1 2 3 4 5 6 7 8 9 10 11"), (10, "21 22 23 24 25 26 27 28 29 30"), (11, item.replace("12", "1,250").replace(" 3 ", " 3.5 ")), filler(),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(100, item), (101, "5 6 7 8 9 10 11 12 13 14 15")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in leaks(d, e, reworded=True, least=LEAST_SEEN).where("kind = 'reworded'").collect()}
    # 5 is exact, 6 has nine words, 7 makes one name of two, 10 is a part with numbers alone, 11 has numerals with marks
    assert got == {(1, 100): 18, (2, 100): 16, (3, 100): 13, (4, 100): 16, (8, 100): 15, (9, 101): 11, (11, 100): 21}
    assert leaks(d, e).columns == ["doc_id", "item_id", "kind"]


def test_recall_of_reparameterised_items(spark):
    """Every number and every name of every item replaced; names are what occurs in one item only."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").collect()
    seen = Counter(w for r in items for w in {x.lower() for x in words_of(r["text"])})
    planted = []
    for r in items:
        change = lambda m: str(int(m.group()) + 7) if m.group().isdigit() else m.group()[::-1].lower() if seen[m.group().lower()] == 1 and not any(c.isdigit() for c in m.group()) else m.group()
        planted.append((10**9 + r["item_id"], regex.sub(r"[\p{L}\p{N}]+", change, r["text"])))
    got = leaks(docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string")), spark.createDataFrame(items), reworded=True)
    found = {r["item_id"] for r in got.where("kind = 'reworded' and doc_id = item_id + 1000000000").collect()}
    by = Counter(r["lang"] for r in items)
    hit = Counter(r["lang"] for r in items if r["item_id"] in found)
    print({x: (hit[x], n) for x, n in by.items()})
    assert all(hit[x] >= 0.9 * n for x, n in by.items())


# ---------------------------------------------------------------- sentences

@pytest.fixture(scope="module")
def model(spark):
    return S.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


CASES = [
    ["Dr. Kolvo saw the lamp with Gen. Udkadri.", "The river was cold; Temmu watched the engine."],
    ["The forest of Gakari cost 426.51 crowns and weighed 1.1 kg.", "The file Seltisga.v8.txt of 3.8.2019 names Mirloat and the lamp."],
    ["“Where is the map?” asked Fraselne and painted the market.", "Kasenne said: “The engine is narrow. The river is not.”", "The bell lost the school."],
    ["„Wo ist die Karte?“ fragte Stergawin und verlor der Wald.", "Am 7. Mai nannte die Datei Vinvegar.v4.txt zuerst Pustermu und der Lehrer."],
    ["»Wo ist der Markt?« fragte Vomuve und malte die Glocke.", "Piludal sagte: »Der Garten ist alt. Der Garten nicht.«", "Was für ein Tag in Mogarga!"],
    ["The market ... lost the engine and stayed bright.", "What a day in Bern?!", "(The bell was broken; Putembel lost the river.)", "The map saw the road."],
    ["桥梁……穿过了大钟。", "「大钟在哪里？」柏森卡问道，然后丢失了灯火。", "文件map.v7.txt提到加洛加和学校。", "米卡森说：「大钟很破旧。高山不是。」"],
    ["『先生はどこ？』とヌリピトが聞き、灯りを描いた。", "(カルテロで地図が船を見つけた。)", "重さは4.4キロだ。"],
    ["डॉ. सेपिलोदा ने पहाड़ खोया।", "बाज़ार उजला था; लोलोपिसे ने पत्र निहारा।"],
    ["ภูเขาของกากาโตเฮราคา 728.60 บาทและหนัก 2.0 กิโล", "เซบาโตริกับโวกาเฮลูเฝ้าดูหน้าต่าง", "โลเซพีคาพูดว่า“โรงเรียนเก่า มาก”", "ไฟล์ map.v6.txt กล่าวถึงเตเวเตดา"],
]


@pytest.mark.parametrize("want", CASES)
@pytest.mark.parametrize("glue", [" ", "\n\n"])
def test_sentences(model, want, glue):
    text = glue.join(want)
    if glue == " " and "桥" in text:
        text = "".join(want)
    assert [text[a:b] for a, b in S.split(text, model)] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Notes on the garden of Vemupu\n \n\nThe bell saw the lamp.", ["Notes on the garden of Vemupu", "The bell saw the lamp."]),
        ("The \r\n road saw the lamp.\nThe bell lost the map.", ["The \r\n road saw the lamp.", "The bell lost the map."]),
        ("The bell saw the lamp.\n1. The map lost the road.\n2.1. The road saw it.\n- The end.", ["The bell saw the lamp.", "1. The map lost the road.", "2.1. The road saw it.", "- The end."]),
        ("river is cold. The garden is not.” The map saw the road.", ["river is cold. The garden is not.”", "The map saw the road."]),
        ("Kasenne said: “The engine is narrow. The riv", ["Kasenne said: “The engine is narrow. The riv"]),
        ("What a day!The bell saw the lamp.", ["What a day!", "The bell saw the lamp."]),
        ("Quel beau jour ! « Où est la carte ? » demanda Garpuve avant midi.", ["Quel beau jour !", "« Où est la carte ? » demanda Garpuve avant midi."]),
        ("no marks at all", ["no marks at all"]), ("", []), (None, []), (" \n\t　", []), ("...", ["..."]), ("”", ["”"]),
    ],
)
def test_sentence_edges(model, text, want):
    assert [text[a:b] for a, b in S.split(text, model)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB. !?\n\"“”«»()「」。กข1,…-J'", max_size=80))
def test_sentences_hold_all_of_the_text(model, text):
    spans = S.split(text, model)
    rest = list(text)
    last = 0
    for a, b in spans:
        assert last <= a < b and not text[a].isspace() and not text[b - 1].isspace()
        last = b
        rest[a:b] = " " * (b - a)
    assert not "".join(rest).strip()


def test_long_texts_and_quotations(model):
    quoted = "Kasenne said: “" + "The engine is narrow. " * 60 + "The riv"
    assert [quoted[a:b] for a, b in S.split(quoted, model)] == [quoted]  # a quotation cut by the text's end, of any length
    begun = "The garden is not. " * 60 + "It is.” The map saw the road."
    assert [begun[a:b] for a, b in S.split(begun, model)] == [begun[: begun.index("”") + 1], "The map saw the road."]
    single = "Kasenne said: ‘The river is cold. The road isn’t.’ The map saw the lamp’s road."
    assert [single[a:b] for a, b in S.split(single, model)] == ["Kasenne said: ‘The river is cold. The road isn’t.’", "The map saw the lamp’s road."]
    word = "x" * 200_000
    assert [b - a for a, b in S.split(f"The {word} saw the lamp. The bell saw {word}. The map.", model)] == [200_018, 200_014, 8]
    assert S.split("a." * 50_000, model) == [(0, 100_000)]


HELD_OUT = [
    ["Brunhild opened a bakery in Quezon.", "Her cousin Ptolemy disagreed!", "Would anyone pay 3.75 for bread?", "The oven, built in 1911, still works."],
    ["Xaver kaufte 2,5 Liter Milch.", "Die Nachbarin lachte laut!", "Warum regnet es hier immer?", "Niemand wusste eine Antwort."],
    ["Zélie cultive des tomates.", "Le voisin préfère les 12.5 hectares de vigne !", "Qui arrose le potager ?", "La pluie tombe enfin."],
    ["Ксения печёт хлеб.", "Сосед выпил 1.5 литра чая!", "Кто закрыл калитку?", "Снег растаял утром."],
    ["太郎在厨房做饭。", "邻居喝了1.5升茶！", "谁关上了大门？", "雪在早上融化了。"],
    ["नीलम रोटी बनाती है।", "पड़ोसी ने 1.5 लीटर चाय पी!", "दरवाज़ा किसने बंद किया?", "सुबह बर्फ़ पिघल गई।"],
    ["ยายทำขนมปังในครัว", "เพื่อนบ้านดื่มชา 1.5 ลิตร", "หิมะละลายตอนเช้า"],
]


def test_held_out_words_and_names(model):
    """Sentences of words and names that the corpus lacks; in half of the texts the last mark is gone."""
    right = made = wanted = 0
    r = random.Random(9)
    for sentences in HELD_OUT:
        for turn in range(24):
            parts = r.sample(sentences, len(sentences))
            if turn % 2:
                parts[-1] = parts[-1].rstrip(".!?。！？। ")
            glue = "" if "。" in "".join(sentences) else " "
            text, want, at = glue.join(parts), set(), 0
            for x in parts:
                want.add((at, at + len(x)))
                at += len(x) + len(glue)
            got = set(S.split(text, model))
            right, made, wanted = right + len(want & got), made + len(got), wanted + len(want)
    print(right, made, wanted)
    assert right >= 0.95 * made and right >= 0.95 * wanted


def test_a_script_without_marks(spark):
    """No mark anywhere: blocks tell how sentences begin and end, and the model cuts the others between words."""
    r = random.Random(3)
    name = lambda: "".join(r.choice("bdklmnr") + r.choice("aeiou") for _ in range(3))
    sentence = lambda: f"{r.choice(['then', 'yesterday', 'later', 'now'])} {name()} {r.choice(['saw', 'found', 'lost'])} the {r.choice(['old', 'narrow', 'blue'])} {r.choice(['lamp', 'river', 'road', 'bell'])}"
    texts, want = [], {}
    for i in range(3000):
        parts = [sentence() for _ in range(1 if i % 3 else r.randrange(2, 6))]
        texts.append((i, " ".join(parts)))
        want[i] = parts
    got: dict[int, list[str]] = {}
    for x in S.sentences(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "start_pos").collect():
        got.setdefault(x["doc_id"], []).append(texts[x["doc_id"]][1][x["start_pos"] : x["end_pos"]])
    hits = sum(len(set(want[i]) & set(got[i])) for i in want if i % 3 == 0)
    assert hits >= 0.9 * sum(len(set(want[i])) for i in want if i % 3 == 0)
    assert hits >= 0.9 * sum(len(set(got[i])) for i in want if i % 3 == 0)


def test_sentences_of_a_frame(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = S.sentences(docs)
    assert got.columns == ["doc_id", "start_pos", "end_pos"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = got.collect()
    for i, t in texts.items():
        inside = sum(r["end_pos"] - r["start_pos"] for r in rows if r["doc_id"] == i)
        assert inside <= len(t or "")
    assert S.sentences(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (1, "A b. C d."), (1, "A b. C d."), (2, " ")], "doc_id long, text string")
    assert S.sentences(odd).where("doc_id = 2").count() == 0
