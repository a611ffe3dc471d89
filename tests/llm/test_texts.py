import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tanglaw.llm import p2_language, p3_encoding, p4_scans, p7_overlap, p8_tokens, p9_leaks, p10_sentences
from tanglaw.sources.tables import load


def garble(text, codec):
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("times", [1, 2])
def test_wrong_decoding_round_trip(codec, times):
    text = bad = "Siyá “nagtanóm” si Señora… sa piña — didtò."
    for _ in range(times):
        bad = garble(bad, codec)
    fixed, spans, lost = p3_encoding.restore(bad)
    assert fixed == text and spans and not lost


@pytest.mark.parametrize("text", ["Siyá “nagtanóm” si Señora… «Oo!» piña", "sanâ…", "doñâ… na", "batá niño", "", "Ano? Oo.", "KAHÓY «SIYÂ»"])
def test_sound_text_is_no_case(text):
    assert p3_encoding.restore(text) == (text, 0, 0)


def test_lost_characters(spark):
    rows = [(1, "as�n"), (2, "kamarasang?t"), (3, "Ano? Oo"), (4, None), (5, ""), (6, "ba" + "Ã±" + "o " + "x" * 300_000)]
    out = {r.doc_id: (r.spans, r.lost) for r in p3_encoding.damaged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(out) == {1, 2, 6} and out[1] == (0, 1) and out[6] == (1, 0)


def test_network_on_held_out_lines():
    rng = random.Random(4)
    pools = {"aa": ["ang", "ng", "mga", "hindi", "siya"], "bb": ["sang", "kag", "apang", "indi", "sia"], "cc": ["the", "and", "there", "with", "she"]}
    line = lambda k: " ".join(rng.choice(pools[k] + ["bata", "aso", "kahoy", "isda"]) for _ in range(14))
    x, y, symbol = p2_language.training_windows([(k, line(k)) for k in pools for _ in range(60)], sorted(pools))
    pick = np.random.default_rng(0).permutation(len(x))[:3000]
    net = p2_language.Network(sorted(pools), symbol)
    net.train(x[pick], y[pick])
    tests = [(k, line(k)) for k in pools for _ in range(30)]
    windows, owner = p2_language.windows([t for _, t in tests], symbol)
    total = np.zeros((len(tests), 3))
    np.add.at(total, owner, net.log_probabilities(windows))
    assert np.mean([sorted(pools)[i] == k for i, (k, _) in zip(total.argmax(axis=1), tests)]) > 0.95


def test_windows_cover_the_whole_text():
    text = "abcdefghijklmnopqrstuvwxyz" * 50
    x, owner = p2_language.windows(["", text, "ñ é"], p2_language.alphabet([]))
    assert (x[owner == 1] > 0).sum() == len(text) and (x[owner == 0] > 0).sum() == 0 and (x[owner == 2] > 0).sum() == 2


SCAN = (
    "Ang bata naglakat sa dakong dalan kag nagkita sang aso nga nagda-\nlagan sa balay. Indi sia nahadlok\n- 14 -\nAng Aso ni Ana\nkag nagtawag sang iya iloy nga nagapa­\nhuway. "
    "Adlaw-\nadlaw sia naga- lakat sa\ndalan kag nagatan-aw sang m@dako nga\nkahoy nagatubo sa higad\n"
)


def test_page():
    page = p4_scans.Page(SCAN, "Ang Aso ni Ana")
    assert page.scanned and [k + 1 for k, x in enumerate(page.kind) if x == "page"] == [3] and [k + 1 for k, x in enumerate(page.kind) if x == "header"] == [4]
    assert (0, 1, "nagda", "lagan") in page.cuts and (4, 5, "nagapa", "huway") in page.cuts and (6, 6, "naga", "lakat") in page.cuts
    text = p4_scans.paragraphs(SCAN, "Ang Aso ni Ana", {"m@dako": "madako"})
    assert "nagdalagan" in text and "nagapahuway" in text and "Adlaw-adlaw" in text and "madako" in text and "14" not in text
    assert p4_scans.paragraphs("Ang bata. Ang aso.", None, {}) is None and not p4_scans.Page("", None).scanned


@pytest.mark.parametrize("read, word, want", [("nagtanorn", "nagtanom", True), ("maritang", "mantang", True), ("siita", "suta", True), ("turc", "ture", True), ("bato", "sako", False), ("same", "same", False), ("livvat", "liwat", True)])
def test_confusions(read, word, want):
    assert p4_scans.explains(read, word, 100) is want


def test_faults_and_repairs(spark):
    clean = "Ang bata nagtanom sang kahoy kag nagdalagan sa dalan nga madako."
    rows = [(k, None, clean) for k in range(60)] + [(100, "Ang Aso ni Ana", SCAN + "ang bata nagtanorn sang\nkahoy sa dalan"), (101, None, None), (102, None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, title string, text string")
    found = {(r.line_no, r.kind) for r in p4_scans.faults(df).collect()}
    assert {(1, "hyphen"), (3, "page"), (4, "header"), (5, "hyphen"), (8, "char"), (10, "char")} <= found and (6, "hyphen") not in found
    fixed = {r.doc_id: r.text for r in p4_scans.repaired(df).collect()}
    assert set(fixed) == {100} and "nagtanom sang kahoy" in fixed[100] and "madako" in fixed[100]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_common_words(a, b):
    assert p7_overlap.common_words(a, b) == lcs(a, b)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("bdgklmnprst") + rng.choice("aiou") for _ in range(rng.randint(2, 5))) for _ in range(600)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 90))] for _ in range(40)]
    rows, index = [], []
    for k, words in enumerate(base):
        other = [w if rng.random() > 0.1 else rng.choice(vocabulary) for w in words]
        rows += [(2 * k, "x", " ".join(words).capitalize() + "."), (2 * k + 1, "x", "\n".join([" ".join(other[:20]), " ".join(other[20:])]) if k % 3 else " ".join(rng.choice(vocabulary) for _ in words))]
        index += [(k, 2 * k, "train"), (k, 2 * k, "train"), (100 + k, 2 * k + 1, "test")]
    rows += [(500, "x", None), (501, "x", " "), (502, "x", " ".join(base[0])), (503, "x", " ".join(base[0]))]
    index += [(300, 500, "train"), (301, 501, "test"), (302, 502, "val"), (303, 503, "train")]
    df = spark.createDataFrame([(d, x, None, t, "s") for d, x, t in rows], "doc_id bigint, language string, title string, text string, source string")
    high = spark.createDataFrame(index, "pos bigint, doc_id bigint, split_role string")
    low = spark.createDataFrame([], "doc_id bigint")
    bodies = {d: p7_overlap.body(t, None).split() for d, _, t in rows if t}
    want = set()
    for a in {d for _, d, r in index if r == "train"} & bodies.keys():
        for b in {d for _, d, r in index if r != "train"} & bodies.keys():
            if bodies[a] and bodies[b] and lcs(bodies[a], bodies[b]) >= 0.7 * max(len(bodies[a]), len(bodies[b])):
                want.add((min(a, b), max(a, b)))
    got = {(r.doc_id_a, r.doc_id_b) for r in p7_overlap.overlaps(df, high, low).collect()}
    assert got == want and len(want) > 20


@pytest.fixture(scope="module")
def vocabulary():
    return p8_tokens.Vocabulary(p8_tokens.vocabulary_path())


def test_a_wrong_proposal_is_noticed(vocabulary, monkeypatch):
    words = [b"bata", b" balay", b" nagtanom"]
    right = [x.tolist() for x in vocabulary.encode(words)]
    tokens, count = vocabulary.propose(words)
    swapped = tokens.copy()
    swapped[-1] = vocabulary.byte[ord("q")]
    monkeypatch.setattr(vocabulary, "propose", lambda _: (swapped, count))
    assert [x.tolist() for x in vocabulary.encode(words)] == right


def test_words_equal_exact_merging(vocabulary):
    rng = random.Random(5)
    tokens = list(vocabulary.ranks)
    words = list({b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))) for _ in range(4000)} - {b""})
    assert all(a.tolist() == vocabulary.merge(w) for w, a in zip(words, vocabulary.encode(words)))


def test_ids_equal_the_library(spark, data, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    exact = tiktoken.Encoding("exact", pat_str=p8_tokens.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rows = [(r.doc_id, r.text) for r in load(spark, data, "documents").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, "a" * 50_000), (-4, "<|endoftext|> \n\n  x ")]
    out = {r.doc_id: r.ids for r in p8_tokens.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(out) == len(rows) and all(out[d] == exact.encode_ordinary(t or "") for d, t in rows)


def test_leaks_against_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in load(spark, data, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in load(spark, data, "benchmark").select("item_id", "text").collect()]
    docs += [(9_000 + i, "Xx " + t[len(t) // 3 :].upper().replace(" ", "  ") + " yy") for i, t in items[:20]] + [(9_100, None), (9_101, ""), (9_102, items[0][1]), (9_102, items[0][1])]
    items += [(999, None), (998, "too short"), (997, items[0][1])]
    grams = {}
    for i, t in items:
        w = p9_leaks.words(t or "")
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [p9_leaks.words(t or "")] for k in range(len(w) - 7) for i in grams.get(tuple(w[k : k + 8]), ())}
    out = p9_leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want) and all(r.longest >= 8 for r in out)


@pytest.mark.parametrize("text, want", [("Niño ay­ x", ["nino", "ay", "x"]), ("nagda-\nlagan", ["nagdalagan"]), ("a_b c-d", ["a", "b", "c", "d"]), ("pa​la", ["pala"]), ("", [])])
def test_words(text, want):
    assert p9_leaks.words(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Si Dr. Ana ay dito. Oo!", ["Si Dr. Ana ay dito.", "Oo!"]),
        ("Si T. P. Binoto ay dito. Siya.", ["Si T. P. Binoto ay dito.", "Siya."]),
        ("“A na! B ba?” sabi ni C.", ["“A na!", "B ba?” sabi ni C."]),
        ("Sabi ni C: «A. Bata.» Doon.", ["Sabi ni C: «A.", "Bata.»", "Doon."]),
        ("Tingnan No. 5 at p. 7 sa 9.34 a.m. ng v2.1.2 at kuwento73.txt ok.", ["Tingnan No. 5 at p. 7 sa 9.34 a.m. ng v2.1.2 at kuwento73.txt ok."]),
        ("1. Ano? 2. Sino?", ["1. Ano?", "2. Sino?"]),
        ("Pamagat\n\nAng bata\nay dito.Siya", ["Pamagat", "Ang bata\nay dito.", "Siya"]),
        ("siya... ang bata… Oo?!", ["siya... ang bata…", "Oo?!"]),
        ("「走。」他说。「好！」鸟飞。", ["「走。」他说。", "「好！」", "鸟飞。"]),
        ("「見て！」と言った。音が。", ["「見て！」と言った。", "音が。"]),
        ("ยายนก ฝนนก\nเดิน", ["ยายนก", "ฝนนก", "เดิน"]),
        ("ᜁᜊᜓ ᜀᜅ᜵ ᜊᜑ᜶ ᜀᜐᜓ", ["ᜁᜊᜓ ᜀᜅ᜵ ᜊᜑ᜶", "ᜀᜐᜓ"]),
        ("में दौड़ा। घर 3.2 देखा।", ["में दौड़ा।", "घर 3.2 देखा।"]),
        ("  \n ", []),
        ("bata (didto?) sa balay.", ["bata (didto?) sa balay."]),
        ("Pamagat \t\n\nAng bata", ["Pamagat", "Ang bata"]),
        ("1\t\r\r", ["1"]),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in p10_sentences.sentences(text)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1. !?…”“»\n\t\r「」。กA-", max_size=60))
def test_sentences_cover_the_text(text):
    spans = p10_sentences.sentences(text)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_sentence_rows(spark):
    rows = [(1, None, "x"), (2, " ", "x"), (3, "A. B. " * 20_000, "x"), (3, "A.", "y")]
    out = p10_sentences.sentence_spans(spark.createDataFrame(rows, "doc_id bigint, text string, char_start string")).collect()
    assert {r.doc_id for r in out} == {3}
