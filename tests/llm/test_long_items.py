"""Long benchmark items at the edit limit are found."""

import random

from tessera.llm import decontaminate as dc


def drawer(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5_000)]
    return rng, lambda n: [words[int(5_000 * rng.random() ** 2)] for _ in range(n)]


def test_items_of_100_to_600_words_at_the_full_limit():
    rng, draw = drawer(4)
    items = [(i, draw(n)) for i, n in enumerate([100, 121, 150, 188, 240, 293, 380, 457, 512, 600] * 3)]
    texts = []
    for _, item in items:
        held, edits = list(item), dc.allowed(len(item))
        for at in sorted(rng.sample(range(len(held)), edits), reverse=True):
            held[at : at + 1] = (["other"], ["more", held[at]], [])[rng.randrange(3)]
        texts.append(" ".join([*draw(rng.randrange(200)), *held, *draw(rng.randrange(200))]))
    found = dc.Index([(i, " ".join(x)) for i, x in items]).search(texts)
    assert [[h["item"] for h in hits] for hits in found] == [[i] for i, _ in items]


def test_documents_that_are_an_item_with_words_dropped():
    rng, draw = drawer(5)
    items = [(i, draw(n)) for i, n in enumerate([50, 100, 188, 512])]
    dropped = {50: (10,), 100: (20,), 188: (17, 37), 512: (17, 102)}
    texts, want = [], []
    for i, item in items:
        for n in dropped[len(item)]:
            gone = set(rng.sample(range(len(item)), n))
            texts.append(" ".join(w for at, w in enumerate(item) if at not in gone))
            want.append(i)
    found = dc.Index([(i, " ".join(x)) for i, x in items]).search(texts)
    assert [[h["item"] for h in hits] for hits in found] == [[i] for i in want]


def test_a_walked_class_pads_for_all_its_deletions():
    """One word repeated: the walk meets the target at any length, so the padding alone decides."""
    for n, gone in ((100, 20), (188, 17), (512, 17)):
        index = dc.Index([(1, "same " * n)])
        assert index.classes[0].repeats
        assert [h["item"] for h in index.search(["same " * (n - gone)])[0]] == [1]


def test_the_later_part_of_a_long_item():
    """The first fifth of 2,000 words is rewritten or dropped, the rest is verbatim."""
    rng, draw = drawer(6)
    item = draw(2_000)
    index = dc.Index([(1, " ".join(item))])
    for head in (["other"] * 400, []):
        (hits,) = index.search([" ".join([*draw(50), *head, *item[400:], *draw(50)])])
        assert [h["item"] for h in hits] == [1] and 380 <= hits[0]["edits"] <= 400


def test_a_walked_class_indexes_every_offset():
    words = ["same"] * 2_000
    index = dc.Index([(1, " ".join(words))])
    (held,) = index.classes
    assert held.repeats and all(sorted(offsets.tolist()) == list(range(len(words) - held.size + 1)) for _, _, offsets in held.tables)


def test_the_exact_search_of_texts_that_hold_some_grams_but_no_item():
    rng, draw = drawer(7)
    item = draw(300)
    index = dc.Index([(1, " ".join(item))])
    assert not index.classes[0].repeats
    assert index.search([" ".join(item[:60]), "", None, "word"]) == [[], [], [], []]
