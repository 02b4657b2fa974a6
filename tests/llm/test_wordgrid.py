import random
import tracemalloc

from quern.llm import wordgrid as m


def test_chunks_give_the_same_words(monkeypatch):
    rng = random.Random(2)
    parts = [b" ".join(rng.choices([b"a", b"bc", "é".encode(), b"", b"x" * 50], k=rng.randint(0, 30))) for _ in range(40)]
    whole = m.word_grid(parts)
    assert [int((whole.doc == k).sum()) for k in range(40)] == [len(p.split()) for p in parts]
    for chunk in (1, 7, 64):
        monkeypatch.setattr(m, "CHUNK", chunk)
        again = m.word_grid(parts)
        assert (again.code == whole.code).all() and (again.doc == whole.doc).all()
    words = [w for p in parts for w in p.split()]
    assert len(set(words)) == len(set(whole.code.tolist())) and len({(w, c) for w, c in zip(words, whole.code.tolist())}) == len(set(words))


def test_a_long_text_takes_bounded_memory():
    text = b"some words of a long text " * 1_200_000
    tracemalloc.start()
    grid = m.word_grid([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(grid.code) == 7_200_000 and peak < 12 * len(text)
