import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kerbline.llm import leaks as L

WORDS = [f"w{i}" for i in range(400)]


def make_items(r, n=30, size=(18, 60)):
    phrases = [r.choices(WORDS, k=r.randint(3, 6)) for _ in range(40)]
    items = []
    for i in range(n):
        words = []
        while len(words) < size[0]:
            words += r.choice(phrases) + r.choices(WORDS, k=r.randint(1, 8))
        items.append((i, " ".join(words[: size[1]])))
    return items


def brute_votes(items, document, least):
    def grams(x, n):
        return {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}

    return {k for k, w in enumerate(items) if grams(w, least[k]) & grams(document, least[k])}


def test_automaton_votes_equal_brute_force():
    r = random.Random(4)
    for _ in range(60):
        items = [r.choices(range(6), k=r.randint(1, 14)) for _ in range(r.randint(1, 7))]
        least = [r.randint(1, 5) for _ in items]
        a = L.SuffixAutomaton(items, least)
        for _ in range(30):
            doc = r.choices(range(-1, 7), k=r.randint(0, 25))
            assert a.votes(doc) == brute_votes(items, [x if x >= 0 else -1 - 10 * i for i, x in enumerate(doc)], least)


PIECES = ["The", "café", "cafe\u0301", "ŉight", "<b>", "</b>", '<img alt="x y" src=z>', "[", "](http://a b)", "](http://a)", "&amp;", "&eacute;", "&#39;", "&notit;", "can’t", "sh-\n", "ow", "half-\n> ", "way", "\u200b", "ﬁne", "½", "日本", "ｆｕｌｌ", " ", "\n", "İ", "<", "&", "."]


@given(st.lists(st.sampled_from(PIECES), max_size=25), st.booleans())
@settings(max_examples=300, deadline=None)
def test_places_of_words(pieces, spaced):
    text = (" " if spaced else "").join(pieces)
    vocabulary = {"show": 0, "halfway": 1}
    placed = L.placed_words(text, vocabulary)
    assert [w for w, _, _ in placed] == L.words(text, vocabulary)
    assert all(0 <= a < b <= len(text) for _, a, b in placed)
    assert all(x[1] <= y[1] and x[2] <= y[2] for x, y in zip(placed, placed[1:]))


ITEM = "which gap does the rear camera show behind the blue trailer at dawn"


def test_removal_keeps_all_other_text(spark):
    cases = {
        f'see <img alt="one two three" src=x> then {ITEM} tail': 'see <img alt="one two three" src=x> then  tail',
        f"pre [link](http://x.y/z) {ITEM}, tail": "pre [link](http://x.y/z) , tail",
        f"a &amp; b <b>{ITEM}</b>&nbsp;end": "a &amp; b <b></b>&nbsp;end",
        f"Ünïcode\u200b first. {ITEM.replace('camera', 'cam-' + chr(10) + 'era').replace('blue', '<i>blue</i>')}?! last": "Ünïcode\u200b first. ?! last",
        "nothing leaked here": "nothing leaked here",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    out = {r.doc_id: r for r in L.remove_leaks(df, items, drop_share=0.99).collect()}
    assert [out[i].text for i in range(len(cases))] == list(cases.values())
    assert [out[i].leaked_items for i in range(len(cases))] == [[1]] * 4 + [[]]
    assert L.remove_leaks(df, items, drop_share=0.3).filter("dropped and text is null").count() == 4


def test_short_items_and_close_gaps():
    def found(item, text):
        return [i for i, *_ in L.Matcher([(1, item)], L.MIN_SHARE).find(text)]

    assert found("park the car backwards", "we park the car backwards today") and not found("park the car backwards", "we park the car today")
    ten = [f"t{i}" for i in range(10)]
    assert found(" ".join(ten), " ".join([*ten[:4], "x", "y", "x", "z", "q", *ten[6:9]]))
    assert not found(" ".join(ten), " ".join(ten[:3])) and not found("one", "one")
    sixty = [f"s{i}" for i in range(60)]
    for gaps in ((5, 7, 15, 22), (5, 7, 9, 11), (5, 14, 22, 24)):
        assert found(" ".join(sixty), " ".join("x" if k in gaps else w for k, w in enumerate(sixty[:32]))), gaps


def test_many_items_in_many_shards(spark):
    r = random.Random(2)
    texts = [" ".join(f"v{r.randrange(4000)}" for _ in range(8)) for _ in range(5001)]
    docs = [f"before {texts[i]} after" for i in range(0, 5001, 500)] + ["nothing"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    whole, parts = (L.find_leaks(df, items, shard_words=n).collect() for n in (L.SHARD_WORDS, 4000))
    assert sorted(whole) == sorted(parts) and {(x.doc_id, x.item_id) for x in whole} >= {(k, 500 * k) for k in range(11)}
    cleaned = {x.doc_id: x for x in L.remove_leaks(df, items, drop_share=0.99, shard_words=4000).collect()}
    assert all(cleaned[k].text == "before  after" for k in range(11)) and cleaned[11].text == "nothing"


def test_normalised_forms_are_equal():
    want = L.words("The wide angle tile can't show a small gap")
    forms = [
        "THE WIDE-ANGLE tile; can’t show “a” small gap!", "<b>The</b> wide angle  tile\tcan't\n> show a small​ gap", "Ｔｈｅ wide angle tile can&#39;t show a small gap",
        "The wide angle tile can't show a sm­all gap", "The wide-\nangle tile can't sh-\now a small gap", "The wíde angle tile can't show a small gap",
    ]
    vocabulary = {w: i for i, w in enumerate(want)}
    for form in forms:
        assert L.words(form, vocabulary) == want, form


def test_planted_passages(spark):
    r = random.Random(8)
    items = make_items(r)
    other = [f"z{i}" for i in range(300)]
    fill = lambda n: r.choices(other, k=n)
    docs, want = [], set()
    for d in range(150):
        i, text = r.choice(items)
        w, kind = text.split(), d % 5
        n = len(w)
        if kind == 0:  # whole, with one word in eight replaced
            got = [r.choice(other) if k % 8 == 4 else x for k, x in enumerate(w)]
            docs.append(fill(20) + got + fill(9))
        elif kind == 1:  # one passage of 60 %
            a = r.randint(0, n - int(0.6 * n))
            docs.append(fill(5) + w[a : a + int(0.6 * n) + 1] + fill(30))
        elif kind == 2:  # two passages of 30 %
            k = int(0.3 * n) + 1
            docs.append(w[:k] + fill(25) + w[-k:])
        elif kind == 3:  # other order
            docs.append(fill(3) + r.sample(w, n))
        else:  # 30 %
            docs.append(fill(8) + w[: int(0.3 * n)] + fill(8))
        if kind < 3:
            want.add((d, i))
    df = spark.createDataFrame([(d, " ".join(w), "clash") for d, w in enumerate(docs)] + [(900, None, ""), (901, "", ""), (902, "  ", "")], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([*items, (99, None), (98, "!!")], "item_id long, text string")
    found = {(x.doc_id, x.item_id): x for x in L.find_leaks(df, table).collect()}
    assert want <= set(found)
    planted = {d for d, _ in want}
    assert {d for d, _ in found} == planted
    assert {(x.doc_id, x.item_id) for x in L.find_leaks(df, table, shard_words=300).collect()} == set(found)  # several shards
    cleaned = {x.doc_id: x for x in L.remove_leaks(df, table, drop_share=0.9).collect()}
    assert not {(x.doc_id, x.item_id) for x in L.find_leaks(spark.createDataFrame([(k, x.text) for k, x in cleaned.items()], "doc_id long, text string"), table).collect()}
    assert all((x.leaked_items == []) == (k not in planted) for k, x in cleaned.items())
    assert all(cleaned[d].text == " ".join(docs[d]) for d in range(len(docs)) if d not in planted)


def test_empty_tables_and_long_text(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    assert L.find_leaks(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b c d e f")], items)).count() == 0
    assert L.find_leaks(spark.createDataFrame([(1, "a b c d e f")], docs), spark.createDataFrame([], items)).count() == 0
    item = " ".join(WORDS[:50])
    long = "q " * 200_000 + item + " q" * 1000
    out = L.find_leaks(spark.createDataFrame([(1, long), (1, long)], docs), spark.createDataFrame([(1, item), (2, item)], items)).collect()
    assert sorted((r.doc_id, r.item_id, r.share) for r in out) == [(1, 1, 1.0)] * 2 + [(1, 2, 1.0)] * 2


def test_seed_length_is_a_true_bound():
    for n in range(5, 120):
        p = max(1, int(0.45 * n / 2) + (0.45 * n / 2 % 1 > 0))
        replaced = p // 7
        longest = -(-(p - replaced) // (replaced + 1))
        assert L.seed_length(n) <= max(2, longest)
