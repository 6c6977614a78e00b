"""Decontamination against a plain search of all items in all documents."""

import random
import re

import numpy as np
import pyarrow as pa

from roomloom.llm import leaks

DOCS = "doc_id long, text string, item_id long, score double"
ITEMS = "item_id long, text string, doc_id long"


def runs(text, n):
    w = re.sub(r"[!-/:-@\[-`{-~]", " ", text.lower()).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_finds_exactly_the_documents_with_an_item(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(300)}"
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [" ".join(sentence(rng.randrange(3, 15)) for _ in range(rng.randrange(1, 5))) for _ in range(90)]
    items += [items[0], "", None, "ab cd", "Yes no maybe"]
    docs, leak = [], set()
    for d in range(400):
        body = [sentence(12) for _ in range(rng.randrange(40))]
        if d % 5 == 0:
            i = rng.randrange(90)
            body.insert(rng.randrange(len(body) + 1), items[i].upper() if d % 2 else items[i].replace(" ", "\n"))
            leak.add((d, i))
            if i == 0:
                leak.add((d, 90))
        docs.append(" ".join(body))
    docs += [None, "", "so ab cd."]
    df = spark.createDataFrame([(i if i != 401 else None, t, 7, 0.5) for i, t in enumerate(docs)], DOCS)
    df = df.unionByName(df.filter("doc_id = 0"))
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], ITEMS)
    want = {(d, i) for d, t in enumerate(docs) for i, it in enumerate(items) if it and (n := min(5, len(re.findall(r"\w+", it)))) and runs(it, n) <= runs(t or "", n)}
    assert leak | {(402, 93)} <= want
    for index_items in (1000, 25):
        rows = leaks.find_leaks(df, bench, index_items=index_items).collect()
        got = [(r.doc_id, r.item_id) for r in rows]
        assert len(set(got)) == len(got) and want <= set(got)
        for d, i in set(got) - want:  # near copies only
            assert len(runs(items[i], 5) & runs(docs[d], 5)) >= 0.75 * len(runs(items[i], 5)) or len(items[i].split()) < 12
    whole = leaks.find_leaks(df, bench, min_words=3).collect()
    assert {(r.doc_id, r.item_id) for r in whole} == {p for p in got if p[1] != 93}
    assert leaks.find_leaks(df.limit(0), bench).count() == leaks.find_leaks(df.limit(0), bench, index_items=25).count() == 0
    assert leaks.find_leaks(df, bench.limit(0)).count() == 0


def test_search_equals_exhaustive_scoring():
    rng = random.Random(2)
    items = [(i, " ".join(f"t{rng.randrange(6)}" for _ in range(rng.randrange(3, 30)))) for i in range(150)]
    index = leaks.build_index(items, block=8)
    for threshold in (0.05, 0.3, 0.6):
        query = np.unique(np.random.default_rng(1).integers(0, 40 * len(index.terms), 3000))
        passage, term = query // len(index.terms), query % len(index.terms)
        full = np.zeros((40, len(index.item_ids)))
        for p, t in zip(passage, term):
            for k in range(index.starts[t], index.starts[t + 1]):
                full[p, index.items[k]] += index.weights[k]
        got = leaks.search(index, passage, term, threshold)
        want = np.argwhere(full >= threshold - 1e-9)
        assert [(p, i) for p, i, _ in got] == [tuple(x) for x in want] and np.allclose([s for _, _, s in got], full[full >= threshold - 1e-9])


def test_question_and_answer():
    assert leaks.question_and_answer("Is it so? Yes.\nNo, it is.") == ("Is it so? Yes.\n", "No, it is.")
    assert leaks.question_and_answer("one") == ("one", "one")
    assert len(leaks._words("Ab, cd-ef")) == 3 and pa.array(["x"])[0].as_py() == "x"


def test_scores_do_not_depend_on_the_number_of_indexes(spark):
    item = lambda i: f"What is the long river number {i} called in the {i % 3} old land of the far north. It is called the blue river {i * 7}."
    items = spark.createDataFrame([(i, item(i)) for i in range(40)] + [(50, None), (51, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {item(i).rsplit(' ', 1)[0]} after") for i in range(40)], "doc_id long, text string")
    found = [sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in leaks.find_leaks(docs, items, index_items=n).collect()) for n in (100, 7)]
    assert len(found[0]) >= 40 and found[0] == found[1]


def test_a_very_long_item_changes_nothing_for_the_others(spark):
    item = lambda i: f"What is the long river number {i} called in the {i % 3} old land of the far north. It is called the blue river {i * 7}."
    long_one = " ".join(f"w{i} x{i % 7}" for i in range(700)) + ". It ends here and now at last."
    filler = " ".join(f"f{i}" for i in range(300))
    texts = [f"{filler} {item(i)} {filler}" for i in range(12)] + [f"{filler} {long_one} {item(3)} {filler}", filler, long_one[:2000]]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], "id long, text string, item int, term int, words string")
    short = [(i, item(i), 1, "t", 5) for i in range(12)]
    frame = lambda rows: spark.createDataFrame(rows, "item_id long, text string, id int, term string, width int")
    pairs = lambda rows, **k: {(r["id"], r.item_id) for r in leaks.find_leaks(docs, frame(rows), id_col="id", **k).collect()}
    alone = pairs(short)
    assert {(i, i) for i in range(12)} | {(12, 3)} <= alone
    for how in ({}, {"index_items": 5}, {"index_bytes": 600}):
        assert pairs([*short, (99, long_one, 1, "t", 5)], **how) == alone | {(12, 99)}
