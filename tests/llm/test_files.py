"""Token files, packing and WARC: exact round trips and brute force."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roomloom.llm import packing, tokenfile, tokens, warc

DOCS = "doc_id long, text string, id string, ids string, start string"
TEXTS = [None, "", "a  b", "  x\n y \n", "don't stop. Now, é́ 😀!", "\x1c b \x1c!", "hello <|endoftext|> world", "A<|EndOfText|>b", "İ, É.\n\u0958!", "w. " * 900, " ", "one. two. three.\n" * 300, "x" * 3000]


def test_words_are_encoded_as_in_their_texts():
    rng = random.Random(1)
    pool = ["a", "B", "é", "İ", "ß", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", "\u3000", "\x1c", ".", ",", "|", "<|endoftext|>", "<|", "12", "½", "😀", "\u0301", "中文", "\u0958", "---", "\r\n", "ﬁ"]
    texts = [*TEXTS, *("".join(rng.choices(pool, k=rng.randrange(25))) for _ in range(3000))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        own = tokens.PieceEncoder(public_tokenizers.path(name), max_pieces=500)
        got = [ids.tolist() for i in range(0, len(texts), 200) for ids in own.encode(pa.array(texts[i : i + 200], pa.string()))]
        assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def frame(spark, texts):
    return spark.createDataFrame([(None if i == 5 else i, t, "a", "b", "c") for i, t in enumerate(texts)], DOCS)


def encode(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint32)
    assert len(tokenfile.pack(ids, bits)) == -(-1001 * bits // 8)
    assert (tokenfile.unpack(tokenfile.pack(ids, bits), 1001, bits) == ids).all()
    built = tokenfile.FileBuilder(bits, 8)
    built.add(3, ids[:900])
    built.add(None, ids[900:])
    file = tokenfile.TokenFile(built.build(0, 0) + b"\n")
    assert (file.document(1) == ids[900:]).all() and (file.ids(63, 131) == ids[63:131]).all()
    assert file.nulls.tolist() == [False, True]
    if bits < 32:
        with pytest.raises(ValueError):
            tokenfile.pack(np.array([1 << bits]), bits)


def test_token_files_round_trip(spark, tmp_path):
    docs = frame(spark, TEXTS * 3).withColumn("doc_id", F.col("doc_id") * 10)
    path = str(tmp_path / "t")
    tokenfile.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), file_ids=500)
    rows = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    order = sorted(((None if i == 5 else i * 10), t) for i, t in enumerate(TEXTS * 3) if i != 5)
    order = [(None, TEXTS[5]), *order]
    at = 0
    for r, (doc_id, text) in zip(rows, order, strict=True):
        ids = encode("word_bpe_49k.json", text)
        assert (r.id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (doc_id, at, len(ids), crc(ids))
        at += len(ids)
    empty = str(tmp_path / "e")
    tokenfile.write_tokens(docs.limit(0), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert tokenfile.read_tokens(spark, empty).count() == 0


def price(points, penalties, cuts, length):
    cost = sum(penalties[points.index(c)] for c in cuts[1:])
    for a, b in zip(cuts, cuts[1:]):
        n = b - a
        assert n <= length
        cost += 0 if n & (n - 1) == 0 else length - n
    return cost


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(300):
        length = rng.choice([8, 16, 20])
        points = [0]
        while len(points) < rng.randrange(2, 40):
            points.append(points[-1] + rng.randrange(1, length + 1))
        penalties = [0.0] + [rng.choice([0.0, 2.0, 5.5]) for _ in points[1:]]
        each = rng.choice([0.0, 0.0, 3.0])
        best = [0.0] + [float("inf")] * (len(points) - 1)
        for j in range(1, len(points)):
            for i in range(j):
                n = points[j] - points[i]
                if n <= length:
                    best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else length - n) + penalties[j] + each)
        cuts = packing.best_cuts(points, penalties, length, each)
        assert abs(price(points, penalties, cuts, length) + each * (len(cuts) - 1) - best[-1]) < 1e-9


def test_short_windows_are_a_last_resort():
    rng = random.Random(9)
    points = np.cumsum([0] + [rng.randrange(1, 40) for _ in range(4_000)]).tolist()
    penalties = [0.0] + [2.0] * 4_000
    count = lambda price: len(packing.best_cuts(points, penalties, 2048, price)) - 1
    assert count(64.0) <= 1.1 * points[-1] / 2048 < count(0.0)


def test_pieces_hold_each_id_once_in_order(spark):
    texts = TEXTS * 4
    rows = packing.pack(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), length=256, stretch=3000).collect()
    docs, seqs = {}, {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.length > 0
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        if i != 5:
            own = sorted(docs[i], key=lambda r: r.start)
            ids = encode("byte_bpe_50k.json", t)
            assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes() and {r.doc_tokens for r in own} == {len(ids)}
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    padding = 0
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and n <= 256
        padding += 0 if n & (n - 1) == 0 else 256 - n
    assert padding < 0.05 * sum(r.length for r in rows)
    assert packing.pack(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


PAGES = "page_id long, url string, html string, payload string, digest string"


def pages_of(spark, htmls):
    return spark.createDataFrame([(i if i != 4 else None, f"http://x/{i}\r\nA: b é", h, "p", "d") for i, h in enumerate(htmls)], PAGES)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(7)
    noise = lambda n: "".join(map(chr, rng.choices(range(32, 1000), k=n)))
    big = [noise(2000) for _ in range(5)]
    htmls = [None, "", "small", "small", big[0], *big, *big[:3], big[0], "x" * 1000, "x" * 1000, "y" * 999, "y" * 999, *(noise(rng.randrange(6000)) for _ in range(400))]
    df = pages_of(spark, htmls)
    path = str(tmp_path / "w")
    warc.write_warc(df, path, archive_bytes=60_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == len(htmls)
    archives = [gzip.decompress(f.read_bytes()) for f in tmp_path.glob("w/part-*")]
    assert sum(x.count(b"WARC/1.1\r\n") for x in archives) == len(htmls)
    last = {}
    for i, h in enumerate(htmls):
        if i != 4:
            last[h or ""] = i
    for r in rows:
        i = 4 if r.id is None else r.id
        data = (htmls[i] or "").encode()
        revisit = len(data) >= 1000 and last[htmls[i]] != i
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", last[htmls[i]]) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == data
    warc.write_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_pieces_with_a_magic_inside_are_put_together():
    member = warc.build_record(1, "u", b"z" * 50, "d", None, level=0)
    stored = warc.build_record(2, "u", b"\x1f\x8b\x08" + b"q" * 50 + b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" + b"k" * 90, "d", None, level=0)
    data = member + stored + member
    pieces = [b"\x1f\x8b\x08" + x for x in data.split(b"\x1f\x8b\x08")[1:]]
    assert len(pieces) == 5
    assert [m is not None for m, _ in warc.stitched(iter(pieces))] == [True] * 3


#: A member of level 6 that holds a magic at byte 29, before zlib gives any output.
EARLY = base64.b64decode(
    "H4sIAAAAAAAAA02PTW+CQBiE7yT8BxAqBbLAwi4fiwiNXkx6aIyNTW+ru4BWwcLaVn99bWMbkzm8mcwzk3f5MJ+40IGytLxcYHE6cKJ0vD+0Tc+v5pyv246B2ZQoo2PXkAOtOAm9MMAJ"
    "guM/knYVF+B5PiNKLcSBuG672XxiuuU7uj+3H/G2dlBVJc77G4rO7wk7uvWVnVJxWYVJ5AEPXrTwPPKr12vgiZ52LWVguql4L4jS1xSSVVD6JVzBEOMQ+0G85hiFrIwTihjDIWUeZQyW"
    "SJZe/gseeVOJmihJLEuTthG8EdefBf8Sbi32u1RZ17TruciOogQ3uVtWlrAJCy3Xs2Eaac7YUU0DDgsX5UGQpgM7R1mWjorQAbbvRQaygAlT7MFIs7U71R6bhQHiXFf9kepbMPGHup4Y"
    "rqWpxv1oEPqmpWb5z8o3MjfeK58BAAA="
)


def test_a_magic_before_the_first_output_of_a_member_loses_no_record(spark, tmp_path):
    named = bytearray(warc.build_record(5, "u", b"n", "d", None))  # a magic in the header's file name
    named[3:10] = b"\x08" + named[4:10] + b"\x1f\x8b\x08.\0"
    other = [warc.build_record(i, "u", b"k" * 40, "d", None) for i in range(3)]
    data = b"".join([other[0], EARLY, EARLY, other[1], bytes(named), other[2], EARLY])
    pieces = [b"\x1f\x8b\x08" + x for x in data.split(b"\x1f\x8b\x08")[1:]]
    assert len(pieces) == 11 and not warc.starts_record(EARLY[:29])
    for i in range(12):
        for j in range(i, 12):
            parts = [x for own in (pieces[:i], pieces[i:j], pieces[j:]) for x in warc.stitched(iter(own))]
            torn = warc.stitched(d for m, d in parts if m is None)
            assert len([m for m, _ in [*parts, *torn] if m is not None]) == 7, (i, j)
    # A damaged record takes none of those behind it along.
    broken = other[0][:-12] + bytes(12) + EARLY + other[1]
    pieces = [b"\x1f\x8b\x08" + x for x in broken.split(b"\x1f\x8b\x08")[1:]]
    assert len([m for m, _ in warc.stitched(iter(pieces)) if m is not None]) == 2
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(data)
    for size in ("100", "700", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(rows) == 7 and len({r.id for r in rows}) == 5
