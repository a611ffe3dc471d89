import random

import numpy as np

from tanglaw.llm import p2_language

POOLS = {
    "russkiy": "человек дерево собака книга вода город утро письмо".split(),
    "ellinika": "άνθρωπος δέντρο σκύλος βιβλίο νερό πόλη πρωί γράμμα".split(),
    "tagalog": "tao puno aso aklat tubig lungsod umaga liham".split(),
}


def test_any_script_can_be_learned():
    rng = random.Random(3)
    line = lambda k: " ".join(rng.choice(POOLS[k]) for _ in range(8))
    names = sorted(POOLS)
    x, y, symbol = p2_language.training_windows([(k, line(k)) for k in names for _ in range(40)], names)
    net = p2_language.Network(names, symbol)
    assert net.step == 1  # more symbols than triples are folded for
    net.train(x[::20], y[::20])
    tests = [(k, line(k)) for k in names for _ in range(20)]
    windows, owner = p2_language.windows([t for _, t in tests], symbol)
    best = net.log_probabilities(windows).argmax(axis=1)
    assert np.mean([names[b] == tests[o][0] for b, o in zip(best, owner)]) > 0.95


def test_accents_fold_and_other_letters_stay():
    assert p2_language.folded("Niño — É! ŋ你") == "nino   e! ŋ你".encode()


def test_every_text_has_a_label_and_unknown_scripts_are_told(spark):
    rng = random.Random(4)
    tagalog = lambda n: " ".join(rng.choice(POOLS["tagalog"]) for _ in range(n))
    english = lambda n: " ".join(rng.choice("man tree dog book water city morning letter".split()) for _ in range(n))
    rows = [(k, "tagalog", tagalog(30)) for k in range(60)] + [(100 + k, "english", english(30)) for k in range(60)]
    rows += [(200, "tagalog", "Привет мир, это русский текст"), (201, None, "你好世界你好世界"), (202, "tagalog", "مرحبا بالعالم"), (203, "english", "123 !!"), (204, "tagalog", None), (205, "tagalog", "  ")]
    rows += [(206, "tagalog", tagalog(30) + "\n" + "Привет мир, это русский текст")]
    df = spark.createDataFrame(rows, "doc_id bigint, language string, text string")
    names = spark.createDataFrame([("tagalog",), ("english",)], "language string")
    out = {(r.doc_id, r.line_no): r.language for r in p2_language.judged(df, names).collect()}
    assert {k for k, line in out if line == 0} == {r[0] for r in rows if r[2] and r[2].strip()}
    assert [out[k, 0] for k in (200, 201, 202, 203)] == ["other"] * 3 + [None]
    assert out[206, 0] == "tagalog" and out[206, 2] == "other"
    assert sum(out[k, 0] == "tagalog" for k in range(60)) + sum(out[100 + k, 0] == "english" for k in range(60)) > 115


def test_spaces_at_the_end_change_nothing():
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("abc de") for _ in range(n))
    net = p2_language.Network(["a", "b"], p2_language.alphabet([]))
    net.fold()
    net.quantize()
    x, _ = p2_language.windows([line(n) for n in (0, 1, 5, 40, 90, 94, 95, 96, 97, 300) for _ in range(9)], net.symbol)
    whole = net.pooled(x) @ net.out + net.out_bias
    whole -= whole.max(axis=1, keepdims=True)
    assert np.allclose(net.log_probabilities(x), whole - np.log(np.exp(whole).sum(axis=1, keepdims=True)), atol=1e-5)
