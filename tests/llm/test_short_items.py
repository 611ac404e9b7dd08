import random

from tests.llm.test_search import DOCS, ITEMS, edit_distance_inside
from voxelflow.llm import decontaminate


def found(spark, items, texts):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in enumerate(texts)], DOCS)
    rows = decontaminate.contamination(spark, docs, spark.createDataFrame([(n, t, "x") for n, t in items], ITEMS)).collect()
    return sorted((r.doc_id, r.item_id, r.distance) for r in rows)


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "Who is Ada?"), (2, "cat"), (3, "日本の首都"), (4, "∑ ≠ ∅"), (5, "capital of Peru: Lima")]
    texts = ["so: who is  ADA, then", "who is adam", "a cat.", "concatenate", "これは日本の首都です", "(∑  ≠ ∅).", "∑ ≠ ∅∅", "the capitol of Peru - lima!", "the capitul ov peru lina", "who is da"]
    assert found(spark, items, texts) == [(0, 1, 0), (1, 1, 1), (2, 2, 0), (4, 3, 0), (5, 4, 0), (7, 5, 1), (9, 1, 1)]


def test_short_items_match_all_pairs_of_word_edges():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    for _ in range(300):
        item = " ".join(word() for _ in range(5))[:23].strip()
        near = list(item)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = rng.choice(["a", "b", " a", "", "bb"])
        text = " ".join([*(word() for _ in range(4)), *"".join(near).split(), *(word() for _ in range(4))])
        cuts = [0, *(i for i, c in enumerate(text) if c == " ")]
        stretches = [text[a : b].strip() for a in cuts for b in [*cuts, len(text)] if b > a]
        # The whole distance of two texts is the least one of a marked pattern inside of a marked text.
        least = min(edit_distance_inside("^" * 9 + item + "$" * 9, "^" * 9 + s + "$" * 9) for s in stretches)
        got = decontaminate.Items([(1, item)]).find(text)
        assert [g[1] for g in got] == ([least] if least <= len(item) // 10 else [])


def test_clean_drops_copies_of_short_sign_and_nameless_items(spark):
    items = spark.createDataFrame([(1, "Who is Ada?", "x"), (2, ":-)", "x"), (None, "an item of quite some length without an id", "x"), (3, None, "x")], ITEMS)
    texts = ["Who is Ada?", "fine :-)", "An item of quite some length, without an id", "kept", None]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in decontaminate.clean(spark, docs, items).collect()) == [3, 4]
