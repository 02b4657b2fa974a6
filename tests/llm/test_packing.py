import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import packing as m

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, start string"


def texts():
    rng = random.Random(9)
    bits = ["the", " of", "  ", "\n", "\n\n", "word's", "it'll", "é", "naïve", "12", "3.5", "²½", "Ⅷ", "\x1d", "\x85", "\xa0", "　", "!?", "日本", "🙂", "\t", "\r\n", " a", "'s", "é", "x" * 45, "​", "\x0b"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "a " * 3000, "<|endoftext|>", "<|endoftext|", "a<|endoftext|> b <|endoftext|><|endoftext|>\n", "<|endof<|endoftext|>text|>"]


def test_ids_equal_those_of_the_tokenizers_library():
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encoder = m.Encoder(m.vocabulary_file(), added=m.added_tokens())
    for _ in range(2):  # the second time from the cache
        for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want.ids, repr(text)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(m, "CELL", 50)
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = list(enumerate(texts()[::3])) + [(7000, None), (7001, "words " * 9000)]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], SCHEMA).repartition(3)
    got = m.pack(df, with_ids=True)
    pieces, whole = got.collect(), {r.sequence_id: r for r in m.sequences(got).collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for (d, t), want in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        parts = sorted(by_doc[d], key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in parts)
        assert np.frombuffer(ids, "<u4").tolist() == [*want.ids, 0]
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(want.ids) + 1 for r in parts)
    for s, parts in by_sequence.items():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])
        assert sum(r.length for r in parts) <= 1024
        assert bytes(whole[s].ids) == b"".join(bytes(r.ids) for r in parts)


def test_null_repeated_and_empty(spark):
    df = spark.createDataFrame([(None, "a b", ""), (1, "a b", ""), (1, "a b", ""), (2, "", "")], SCHEMA)
    assert sorted((str(r.doc_id), r.length) for r in m.pack(df).collect()) == [("1", 3), ("1", 3), ("2", 1), ("None", 3)]
    assert m.pack(df.limit(0)).count() == 0


def test_plan_uses_every_piece_once_with_little_padding():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 1024, 20_000), rng.geometric(0.01, 3000).clip(1, 1024), np.full(999, 600), np.array([1]), np.array([1024] * 5 + [512])):
        counts = Counter(int(v) for v in lengths)
        made = m.plan(dict(counts))
        used = Counter()
        for ls, n, _ in made:
            assert sum(ls) <= 1024 and n > 0
            for v in ls:
                used[v] += n
        assert used == counts
    made = m.plan(Counter(int(v) for v in rng.integers(1, 1024, 20_000)))
    said = m.report(made)
    assert said["padding"] < 0.02 and abs(said["full"] + said["solved"] + said["greedy"] - 1) < 1e-9 and said["solved"] > 0.5
    total = sum(n for _, n, _ in made)
    assert abs(said["padding"] - (1 - sum(sum(ls) * n for ls, n, _ in made) / (1024 * total))) < 1e-9


def best_fit_decreasing(lengths, window):
    rooms = []
    for v in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= v]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= v
        else:
            rooms.append(window - v)
    return len(rooms)


def test_plan_is_close_to_a_plain_best_fit():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 64, 900), rng.geometric(0.05, 600).clip(1, 64), rng.choice([21, 22, 31, 33, 42, 43], 500)):
        made = m.plan(Counter(int(v) for v in lengths), 64)
        assert m.report(made, 64)["sequences"] <= 1.04 * best_fit_decreasing([int(v) for v in lengths], 64) + 1


def test_least_squares_finds_an_exact_solution():
    combos = m.combinations(12)
    want = np.zeros(13)
    for lengths, n in (((6, 6), 40), ((7, 5), 30), ((4, 4, 4), 20), ((9, 2, 1), 10)):
        for v in lengths:
            want[v] += n
    x = m.least_squares(want, combos)
    made = np.zeros(13)
    for k, n in zip(combos, x, strict=True):
        for v in k[k > 0]:
            made[v] += n
    assert np.abs(made[1:] - want[1:]).max() < 0.5 and (x >= 0).all()
