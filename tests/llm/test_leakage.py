import random

import numpy as np

from linkloom.llm import leakage

RND = random.Random(9)
WORDS = ["amber", "basket", "corner", "drawer", "evening", "feather", "garden", "hammer", "island", "jacket", "kettle", "ladder", "marble", "needle", "orange", "pillow", "quartz", "ribbon", "saddle", "timber"]
ITEM = " ".join(f"{RND.choice(WORDS)} {RND.choice(WORDS)}{k}" for k in range(60))
HAN = "".join(chr(RND.randrange(0x4E00, 0x5600)) for _ in range(160))
NOTE = " ".join(RND.choice(WORDS) for _ in range(150))


def found(spark, docs, items=((1, ITEM), (2, HAN), (3, None), (4, ""), (None, ITEM))):
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, item_id string, d int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, "doc_id", i, "item_id").collect()}


def test_leaks_and_decoys(spark):
    words = ITEM.split(" ")
    noisy = [w if k % 9 else RND.choice(["really", "", w[:-1] + "x"]) for k, w in enumerate(words)]
    docs = [
        (1, NOTE + " " + ITEM + ". " + NOTE), (2, NOTE + " " + " ".join(words[30:95])), (3, ITEM.upper().replace(" ", " - ")), (4, " ".join(noisy)), (5, "".join(words)),
        (6, "> <b>" + "</b>\n> <i>".join(words[:70])), (7, NOTE + HAN[40:120] + NOTE), (8, " ".join(HAN)), (9, HAN[:30] + "啊" + HAN[30:60] + HAN[61:90]),
        (20, NOTE), (21, " ".join(words[:12]) + NOTE), (22, HAN[:20] + NOTE), (23, None), (24, ""), (25, " \n"), (26, " ".join(sorted(words))), (None, ITEM),
        (27, " ".join(x + " " + NOTE for x in (" ".join(words[k : k + 9]) for k in range(0, 108, 9)))), (1, NOTE + " " + ITEM + ". " + NOTE),
    ]
    assert found(spark, docs) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2), (8, 2), (9, 2)}


def test_very_long_text_and_empty_tables(spark):
    assert found(spark, [(1, NOTE * 400 + ITEM + NOTE * 400)]) == {(1, 1)}
    assert found(spark, []) == set() and found(spark, [(1, ITEM)], []) == set() and found(spark, [(1, ITEM)], [(5, "short")]) == set()


def test_rounds_change_nothing(spark):
    items = [(k, " ".join(RND.choice(WORDS) for _ in range(RND.randrange(3, 60)))) for k in range(40)] + [(90, HAN), (91, ITEM)]
    docs = [(k, NOTE + " " + t[len(t) // 3 :] + " " + NOTE) for k, (_, t) in enumerate(items)] + [(100, NOTE)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [{tuple(r) for r in leakage.find_leaks(d, "doc_id", i, "item_id", index_chars=n).collect()} for n in (600, 4_000_000)]
    assert got[0] == got[1] and {(k, i) for k, (i, _) in enumerate(items)} <= got[0]


def test_short_items_whole_and_half():
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    han = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = [letters(n) for n in range(20, 82, 2)] + [han(n) for n in range(9, 40, 3)]
    index = leakage.Index(list(enumerate(items)))
    assert index.short
    for k, t in enumerate(items):
        half = len(t) // 2
        texts = [letters(300) + t + letters(300), letters(130) + t[:half] + letters(200), letters(77) + t[half:] + letters(90)]
        assert [x for x in leakage.leaked_items(texts, index, 0.4)] == [(0, k), (1, k), (2, k)], t
    assert leakage.leaked_items([letters(5000), han(2000)], index, 0.4) == []


def test_long_items_need_no_short_grams():
    assert not leakage.Index([(1, ITEM), (2, HAN)]).short


def test_wand_finds_what_a_full_scan_finds():
    items = [(k, " ".join(RND.choice(WORDS) for _ in range(90))) for k in range(80)]
    index = leakage.Index(items)
    index.threshold /= 4
    for _ in range(60):
        query = np.unique(RND.choices(range(len(index.terms)), k=40) + sum((np.flatnonzero([k in index.postings(int(t))[0] for t in range(len(index.terms))]).tolist()[:30] for k in RND.choices(range(80), k=2)), []))
        score = np.zeros(80)
        for t in query:
            docs, impacts, _, _ = index.postings(int(t))
            score[np.array(docs)] += impacts
        assert sorted(index.search(query)) == np.flatnonzero(score >= index.threshold).tolist()
