import random

import numpy as np

from kerbline.llm import quality as Q
from kerbline.llm.inspected import examples


def model():
    starts, rows, kinds = Q.inspected_statistics()
    m = Q.fit_mixture(np.zeros((0, Q.FEATURES)), starts)
    Q.map_components(m, rows, kinds)
    return m


def test_mixture_recovers_clusters():
    r = np.random.default_rng(0)
    centres = np.array([[0.0, 0.0], [8.0, 1.0], [0.0, 9.0]])
    x = np.vstack([c + r.normal(size=(400, 2)) for c in centres])
    m = Q.fit_mixture(x, centres + 1.0, anchor=1.0)
    assert np.abs(m.means * m.scale + m.centre - centres).max() < 0.4
    p = m.responsibilities(x)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == np.repeat([0, 1, 2], 400)).mean() > 0.97


HELD_OUT = {
    "prose": ["The second reviewer did not see the pole in the last tile, so we kept the first sheet and moved on.", "Fine.", "Der Sensor war nass, aber das Bild ist gut.", "we drove it again because the left wall was hidden in the rain and the tape was gone",
              "La note est basse parce que le mur n'est pas visible.", "カメラの前に壁があるので、もう一度撮り直すこと。", "The label is right. 👍", "The rain was too strong.\n\n- pole\n- wall\n\nSo we stopped the run after nine minutes and came back the next day with a new sensor and a dry lens."],
    "list": ["- brush\n- bucket (3)\n- blue rag\n- spare fuse\n- key", "1. brush\n2. bucket\n3. rag\n4. fuse", "brush, bucket, rag, fuse x2, key, torch", "brush\nbucket: 2\nrag\nfuse\nkey ring\ntorch", "[ ] brush\n[x] bucket\n[ ] rag\n[x] key"],
    "table": ["a,b,c,d\n1,2,3,4\n5,6,7,8\n9,1,,3", "| a | b |\n| --- | --- |\n| 1 | x |\n| 2 | y |\n| 3 | z |", "id\tvalue\tname\n1\t4.5\trag\n2\t5.5\tkey\n3\t1.5\tfuse", "name    size  n\nrag     12    4\nkey     9     1\nfuse    120   7",
              "+-----+-----+\n| 1   | 22  |\n| 3   | 4   |\n+-----+-----+", "<table><tr><td>1</td><td>2</td><td>9</td></tr><tr><td>3</td><td>4</td><td>8</td></tr><tr><td>5</td><td>4</td><td>8</td></tr></table>"],
    "junk": ["tile " * 60, "#$%^&*(){}[]<>/\\|~" * 9, "qxzv wkjh pqrt zzxcv mnbvq lkjhg xcvbn qwrtp zxcvq", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgdGV4dA0K" * 4, "\x01\x02�\x7f□▒" * 20, "ok, " * 50, "-----\n=====\n_____\n-----\n....."],
}


def test_held_out_examples():
    m, wrong = model(), []
    for kind, texts in HELD_OUT.items():
        for text, (got, _) in zip(texts, Q.document_kinds(m, texts)):
            if got != kind:
                wrong.append((kind, got, text[:60]))
    assert len(wrong) <= 1, wrong


def test_inspected_examples_are_told_apart():
    m = model()
    for kind, texts in examples():
        got = [k for k, _ in Q.document_kinds(m, texts)]
        assert got.count(kind) >= 0.85 * len(got), (kind, texts[0][:40], got)


def test_ascii_and_general_counts_agree():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab .,;|#\t\n12-'(\x01\x7f$x" ) for _ in range(r.randint(80, 160)))
        if text.strip():
            plain, general = Q.block_statistics(text), Q.block_statistics(text + "​")  # an invisible character takes the general way
            assert np.allclose(plain[4], general[4], atol=0.03) and np.allclose(plain[10], general[10], atol=0.03)


def test_documents(spark):
    rows = [(1, HELD_OUT["list"][0], "x"), (2, HELD_OUT["prose"][0], "x"), (3, None, "x"), (4, "", "x"), (5, " \n\t", "x"), (6, HELD_OUT["junk"][0] * 2000, "x"), (7, HELD_OUT["table"][0], "x"), (7, HELD_OUT["table"][0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted(tuple(r) for r in Q.find_non_prose(df).collect())
    assert got == [(1, "list"), (6, "junk"), (7, "table"), (7, "table")]
    assert Q.find_non_prose(df.limit(0)).count() == 0


def test_plain_statistics(spark):
    df = spark.createDataFrame([(1, "The pole.\r\n\r\nIt is #9!"), (2, None), (3, "  ")], "doc_id long, text string")
    rows = {r.doc_id: r for r in Q.text_statistics(df).collect()}
    assert (rows[1].n_words, rows[1].mean_word_length, rows[1].punctuated_lines, rows[1].common_share) == (5, 12 / 5, 1.0, 0.6)
    assert abs(rows[1].symbol_ratio - 1 / 15) < 1e-9
    assert tuple(rows[2])[1:] == tuple(rows[3])[1:] == (0, 0.0, 0.0, 0.0, 0.0)


def test_words_of_japanese_and_combining_marks(spark):
    text = "カメラの前に壁がある。\nle mur e\u0301tait la\u0300 l’été"
    assert Q._WORD.findall(text) == ["カメラ", "の", "前", "に", "壁", "がある", "le", "mur", "e\u0301tait", "la\u0300", "l’été"]
    row = Q.text_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.common_share, row.punctuated_lines) == (11, 4 / 11, 0.5)


def test_model_is_fitted_to_all_blocks_of_all_documents(spark):
    texts = [t for own in HELD_OUT.values() for t in own]
    r = random.Random(4)
    rows = [(i, r.choice(texts)) for i in range(200)]
    rows += [(300, "\n\n".join([HELD_OUT["prose"][0]] * 60 + [HELD_OUT["table"][0]] * 90)), (301, ""), (302, None)]
    statistics = Q.document_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    x = np.array([Q.block_statistics(b) for _, t in rows if t for b in Q.blocks(t)])
    starts, inspected, kinds = Q.inspected_statistics()
    want = Q.fit_mixture(x, starts)
    Q.map_components(want, inspected, kinds)
    got = Q.fit_model(statistics)
    assert len(x) > 350 and np.allclose(got.centre, np.vstack([x, starts]).mean(axis=0)) and np.allclose(got.scale, want.scale)
    assert np.allclose(got.means, want.means, atol=1e-6) and np.allclose(got.variances, want.variances, atol=1e-6) and (got.kind_of == want.kind_of).all()


def test_no_document_is_left_out_of_the_fit(spark):
    text = HELD_OUT["prose"][4]
    many = spark.range(20_500).selectExpr("id as doc_id", f"'{text.replace(chr(39), chr(92) + chr(39))}' as text")
    found, starts = Q.fit_model(Q.document_statistics(many)), Q.inspected_statistics()[0]
    one = np.array(Q.block_statistics(text))
    assert np.allclose(found.centre, (20_500 * one + starts.sum(axis=0)) / (20_500 + len(starts)), rtol=1e-9)
