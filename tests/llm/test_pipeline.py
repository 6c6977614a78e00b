"""The pipeline against planted documents and against a plain version of its stages."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_neardup import brute
from .test_rows import brute_base, brute_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "Which river carries the most water of all the rivers that reach the northern sea in winter? The answer is the wide grey Orrelune."


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n)) + "."


def planted():
    """(rows, the texts that must reach packing, by id)."""
    base, mail = prose(1, 300), prose(2, 80)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    kept = {0: base, 7: f"{mail} write to [EMAIL] today", 8: prose(3, 6000), None: prose(4, 50)}
    texts = [
        (0, base), (1, base), (2, near), (3, "too short"), (4, None), (5, "buy this now and here " * 30), (6, f"{prose(5, 60)} {ITEM} {prose(6, 60)}"),
        (7, f"{mail} write to jo.doe@example.org today"), (8, kept[8]), (9, ""), (None, kept[None]),
    ]
    return [(i, t, None, None if i == 8 else "web", None) for i, t in texts], kept


def tables(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_document_ends_as_its_case_demands(spark, tmp_path):
    rows, kept = planted()
    got = {}
    for r in corpus_pipeline.run(spark, tables(spark, tmp_path, rows)).collect():
        assert r.length == len(r.ids) // 4 and r.offset + r.length <= 2048
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    ids = {k: np.frombuffer(b"".join(x for _, x in sorted(v)), "<u4").tolist() for k, v in got.items()}
    assert set(ids) == set(kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k in kept:
        assert ids[k] == [*tokenizer.encode(kept[k], add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    folder = tables(spark, tmp_path, [])
    out = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert out.count() == 0
    assert name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS


def test_rows_with_null_or_repeated_ids_are_judged_each_by_itself(spark, tmp_path):
    p = [prose(20 + i, 60) for i in range(8)]
    leak = [f"{prose(40 + i, 40)} {ITEM}" for i in range(2)]
    rows = [(None, leak[0]), (None, p[0]), (5, leak[1]), (5, p[1]), (6, p[2]), (6, p[2]), (None, p[3]), (None, p[3]), (None, p[4]), (8, p[4]), (7, p[4]), (9, p[5]), (9, p[6])]
    folder = tables(spark, tmp_path, [(i, t, None, "web", None) for i, t in rows])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ends = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert ends(corpus_pipeline.decontamination(spark, docs, folder)) == sorted((r for r in rows if r[1] not in leak), key=str)
    want = [*rows[:5], (None, p[3]), (7, p[4]), *rows[11:]]
    assert ends(corpus_pipeline.near_dedup(spark, docs, folder)) == sorted(want, key=str)


def plain_quality(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda line: " ".join(words(re.sub("[0-9]", "0", line.lower())))
    hosts, docs, texts = Counter(s for _, t, s in rows), Counter(), {}
    for _, t, s in rows:
        for n in {norm(x) for x in t.split("\n")} - {""}:
            docs[s, n] += 1
            texts.setdefault((s, n), set()).add(t)
    common = {k for k, n in docs.items() if n >= 10 and len(texts[k]) >= 10 and (n > 0.05 * hosts[k[0]] or n >= 50)}
    out = []
    for d, t, s in rows:
        clean = "\n".join(x for x in t.split("\n") if (s, norm(x)) not in common)
        n, *_, repeated = brute_base(t)
        left = len(words(clean))
        if n >= 10 and 100 * repeated <= 20 * n and not (left < n and (left < 10 or left < 0.3 * n)):
            out.append((d, clean))
    return out


def plain_pipeline(rows, items):
    """(id, text) of what reaches packing."""
    rows = plain_quality(rows)
    rows = [r for r, found in zip(rows, brute([t for _, t in rows])) if found[3]]
    words = lambda t: " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "
    rows = [(d, t) for d, t in rows if not any(words(i) in words(t) for i in items)]
    out = []
    for d, t in rows:
        at, masked = 0, ""
        for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_spans(t))):
            if start >= at:
                masked += f"{t[at:start]}[{kind.upper()}]"
            at = max(at, end)
        out.append((d, masked + t[at:]))
    return out


def test_the_whole_run_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(31)
    items = [f"{prose(900 + i, 9).capitalize()} {prose(950 + i, 4).capitalize()}" for i in range(12)]
    rows = []
    for i in range(160):
        parts = [prose(100 + i, rng.randrange(12, 90)) for _ in range(rng.randrange(1, 3))]
        if rng.random() < 0.3:
            parts.insert(rng.randrange(len(parts) + 1), f"site menu of {i} pages and more")  # a common line: digits are all alike
        if rng.random() < 0.2:
            parts.append(f"write to u{i}@mail.example or 10.0.0.{i % 300}")
        if rng.random() < 0.15:
            parts.insert(0, rng.choice(items))
        if rng.random() < 0.1:
            parts += ["say it again and again now then"] * 5
        text = "\n".join(parts)
        rows.append((len(rows), text, rng.choice("ab")))
        while rng.random() < 0.35:  # copies and a chain of edits
            words = text.split(" ")
            words[rng.randrange(len(words))] = rng.choice(["changed", words[0]])
            text = " ".join(words)
            rows.append((len(rows), text, rng.choice("ab")))
    rows += [(1000 + i, f"short {i}", "a") for i in range(5)]
    spark.createDataFrame([(d, t, None, s, None) for d, t, s in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = dict(plain_pipeline(rows, items))
    assert 60 < len(want) < len(rows) - 20 and any("[EMAIL]" in t for t in want.values())
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(got) == sorted(want)
    for d, t in want.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(got[d])), "<u4").tolist()
        assert ids == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], d
