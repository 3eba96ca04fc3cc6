import pytest

from pipewise.llm import decontamination as dc

ITEM = (
    "If Anna Smith buys 12 apples for 3 dollars each and Bob sells 5 of them to the man from "
    "Paris, how many of the apples does the buyer have left after 2 days?"
)
OTHER = "The train that leaves the station at noon goes past the old mill and over the long bridge."


@pytest.fixture
def items_of(spark):
    def make(rows):
        return spark.createDataFrame(
            [(*r, "x") for r in rows], "item_id long, text string, doc_id string"
        )

    return make


def found(docs, items, **more):
    rows = dc.contaminated(docs, items, **more).collect()
    return {(r.doc_id, r.item_id): (r.matched, r.item_windows, r.changed_slots) for r in rows}


def again(text, **names):
    for old, new in names.items():
        text = text.replace(old.replace("_", " "), new)
    return text


def test_copies_and_questions_asked_again(docs_of, items_of):
    changed = again(ITEM, Anna_Smith="Carla", Bob="Dr Otto Weiss", Paris="Rome").replace("12", "1,250")
    mixed = ITEM.replace("5 of them", "12 of them")  # two values become one
    docs = docs_of(
        [
            (1, f"Before it. {ITEM} And after."),
            (2, f"So it goes.\n{changed}\nThe end."),
            (3, f"Clean text of one kind or another, with 12 apples and no more of it. {OTHER}"),
            (4, ITEM.upper()),
            (5, None),
            (6, ""),
            (7, " ".join(["word"] * 40000) + " " + ITEM),
            (1, f"Before it. {ITEM} And after."),
            (None, ITEM),
            (8, mixed),
        ]
    )
    items = items_of([(70, ITEM), (71, OTHER), (72, None), (73, ""), (74, "1 2 3 4 5 6 7 8 9"), (None, ITEM)])
    got = found(docs, items)
    # 8 differs from the item in one number: held as written
    assert set(got) == {(1, 70), (2, 70), (4, 70), (7, 70), (8, 70), (3, 71)}
    # in 7 the first word is read as part of a name
    assert got[1, 70][2] == 0 and got[7, 70][2] <= 1 and got[2, 70][2] == 4
    assert got[1, 70][0] == got[1, 70][1]


def test_short_items_and_empty_tables(docs_of, items_of):
    docs = docs_of([(1, "they say that every good boy does fine they say"), (2, "nothing of it")])
    assert found(docs, items_of([(5, "Every good boy does fine.")])) == {(1, 5): (1, 1, 0)}
    assert found(docs, items_of([])) == {} and found(docs_of([]), items_of([(5, ITEM)])) == {}


def test_tokens():
    text = "Mary Jones had 5 kg of 1,200 apples. The IBM man saw Big Ben.\nIf Tom paid $3.50 --- !"
    own = dc.template_of([text.encode()])
    words = [own.text[a:b].decode() for a, b in zip(own.start, own.end)]
    kinds = dict(zip(words, own.kind.tolist()))
    assert kinds["Mary"] == dc.WORD and kinds["Jones"] == kinds["Big"] == kinds["Tom"] == dc.NAME
    assert kinds["5"] == kinds["1,200"] == kinds["3.50"] == dc.NUMBER and kinds["kg"] == dc.UNIT
    assert kinds["IBM"] == kinds["If"] == kinds["The"] == dc.WORD and "Ben" not in kinds


def plain_windows(text, size):
    own = dc.template_of([text.encode()])
    codes, kinds = own.code.tolist(), own.kind.tolist()
    return [
        (p, tuple(codes[p : p + size]), tuple(own.slots(p, size)))
        for p in range(len(codes) - size + 1)
        if sum(k == dc.WORD for k in kinds[p : p + size]) >= dc.LITERAL
    ]


def test_whole_table_equals_brute_force(table):
    docs, items = table("documents"), table("benchmark")
    own = {r.item_id: plain_windows(r.text, dc.WINDOW) for r in items.collect()}
    index = {}
    for item, windows in own.items():
        for at, codes, slots in windows:
            index.setdefault(codes, []).append((item, at, slots))
    lines = {}
    for r in docs.collect():
        for p, codes, slots in plain_windows(r.text, dc.WINDOW):
            for item, at, item_slots in index.get(codes, ()):
                places, pairs = lines.setdefault((r.doc_id, item, p - at), (set(), set()))
                places.add(at)
                pairs.update(zip(item_slots, slots))
    want = {}
    for (doc, item, _), (places, pairs) in lines.items():
        total = len(own[item])
        one_to_one = len({i for i, _ in pairs}) == len({d for _, d in pairs}) == len(pairs)
        if len(places) >= dc.SHARE * total and one_to_one:
            best = (len(places), -sum(i != d for i, d in pairs))
            want[doc, item] = max(want.get((doc, item), best), best)
    got = found(docs, items)
    assert {k: (m, -c) for k, (m, _, c) in got.items()} == want and want
