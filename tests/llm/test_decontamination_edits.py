from pipewise.llm import decontamination as dc
from tests.llm.test_decontamination import ITEM, found, items_of  # noqa: F401

STORY = (
    "Anna walks to the market and buys ten green apples. "
    "Bob takes a basket from the old wooden shelf. "
    "Clara counts the red ones before they go home."
)


def test_words_put_in_and_left_out(docs_of, items_of):  # noqa: F811
    words = ITEM.split(" ")
    middle, third = len(words) // 2, len(words) // 3
    put_in = " ".join([*words[:middle], "really", *words[middle:]])
    left_out = " ".join([*words[: middle - 1], *words[middle:]])
    double = " ".join([*words, *words])  # long enough for two edits
    edits = double.split(" ")
    edits = [*edits[: 2 * third], "so", *edits[2 * third : 4 * third], "then", *edits[4 * third :]]
    docs = docs_of([(1, put_in), (2, left_out), (3, " ".join(edits)), (4, "nothing of it " * 20)])
    got = found(docs, items_of([(70, ITEM), (71, double)]))
    assert {(1, 70), (2, 70), (3, 71)} <= set(got) and not [k for k in got if k[0] == 4]


def test_names_that_begin_sentences(docs_of, items_of):  # noqa: F811
    again = STORY.replace("Anna", "Xenia").replace("Bob", "Yusuf").replace("Clara", "Zoe")
    got = found(docs_of([(1, again), (2, STORY)]), items_of([(70, STORY)]))
    assert set(got) == {(1, 70), (2, 70)} and got[1, 70][2] == 3 and got[2, 70][2] == 0


def test_chain_keeps_the_order():
    import numpy as np

    runs = np.array([[0, 0, 5], [9, 8, 5], [40, 5, 3]])
    assert sorted(dc.chain(runs)) == [(0, 0, 5), (9, 8, 5)]
    assert dc.chain(np.array([[0, 8, 5], [9, 0, 5]])) in ([(0, 8, 5)], [(9, 0, 5)])


def test_few_words_and_many_numbers_as_written(docs_of, items_of):  # noqa: F811
    items = items_of(
        [(1, "What is 12 + 30?"), (2, "3 kg 5 m 7 s 9 g 11 cm 13 mm"), (3, "Blue whale"), (4, "May 5, 1821; June 6, 1822")]
    )
    docs = docs_of(
        [
            (10, "It was asked: what is 12 + 30? Then they left."),
            (20, "Given 3 kg 5 m 7 s 9 g 11 cm 13 mm of it."),
            (30, "They saw a blue whale there."),
            (40, "On May 5, 1821; June 6, 1822 and later."),
            (50, "What is 13 + 31? They saw a blue car and 4 kg 6 m 8 s 10 g 12 cm 14 mm."),
        ]
    )
    assert set(found(docs, items)) == {(10, 1), (20, 2), (30, 3), (40, 4)}


def test_copies_in_capitals_and_in_lower_case(docs_of, items_of):  # noqa: F811
    items = items_of([(70, ITEM), (71, STORY)])
    got = found(docs_of([(1, ITEM.upper()), (2, ITEM.lower()), (3, STORY.upper())]), items)
    assert {k: c for k, (_, _, c) in got.items()} == {(1, 70): 0, (2, 70): 0, (3, 71): 0}


def test_slots_refuse_only_what_leans_on_changed_placeholders(docs_of, items_of):  # noqa: F811
    item = "Tom bought 3 kg of rice and 4 kg of beans, then gave 5 kg to Ann for her 6 friends."
    one = "Tom bought 9 kg of rice and 9 kg of beans, then gave 9 kg to Ann for her 9 friends."
    asked = "Tom bought 7 kg of rice and 8 kg of beans, then gave 9 kg to Ann for her 2 friends."
    got = found(docs_of([(1, one), (2, asked), (3, f"{item} {item}".replace("4", "3", 1))]), items_of([(70, item)]))
    assert set(got) == {(2, 70), (3, 70)}


def test_repetitive_texts_are_chained_in_bounded_steps():
    import time

    import numpy as np

    runs = np.array([[p, 0, 113] for p in range(40000)])
    began = time.monotonic()
    assert sum(n for _, _, n in dc.chain(runs)) >= 113
    assert time.monotonic() - began < 20


def test_common_words_count_once_per_text(docs_of, items_of):  # noqa: F811
    docs = docs_of([(1, "whale " * 5000), (2, "a whale, and another whale"), (3, "whales")])
    assert found(docs, items_of([(5, "Whale")])) == {(1, 5): (1, 1, 0), (2, 5): (1, 1, 0)}
