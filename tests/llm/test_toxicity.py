import itertools
import random
import zlib

import numpy as np

from quern.llm import toxicity as m

SCHEMA = "doc_id long, text string, lang string, score string"


def all_paths(scores, moves):
    """(marginals, expected moves, log of the sum) of one chain by listing its paths."""
    total, hit, pairs = 0.0, np.zeros(len(scores)), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=len(scores)):
        w = np.exp(sum(s * y for s, y in zip(scores, path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        hit += w * np.array(path)
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return hit / total, pairs / total, np.log(total)


def test_forward_backward_matches_all_paths():
    rng = np.random.default_rng(1)
    scores, moves, lengths = rng.normal(size=(5, 6)), rng.normal(size=(2, 2)), np.array([6, 1, 3, 5, 2])
    p, expected, log_sum = m.forward_backward(scores, lengths, moves)
    want = [all_paths(scores[s, : lengths[s]], moves) for s in range(5)]
    for s in range(5):
        assert np.allclose(p[s, : lengths[s]], want[s][0])
    assert np.allclose(expected, sum(w[1] for w in want)) and np.isclose(log_sum, sum(w[2] for w in want))


def test_pieces_of_a_chain_give_what_the_whole_chain_gives():
    rng = np.random.default_rng(4)
    sizes, moves = [11, 0, 3, 4, 9, 1, 8], rng.normal(size=(2, 2)) * 2
    values = rng.normal(size=sum(sizes)) * 2
    matrix, lengths, row, column, follows = m._pad(values, sizes, 4)
    got = m.forward_backward(matrix, lengths, moves, follows)[0][row, column]
    whole = np.concatenate([all_paths(values[b - n : b], moves)[0] for n, b in zip(sizes, np.cumsum(sizes)) if n])
    assert np.allclose(got, whole)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    scores, moves, lengths = rng.normal(size=(4, 5)), rng.normal(size=(2, 2)), np.array([5, 2, 4, 1])
    p, expected, _ = m.forward_backward(scores, lengths, moves)
    eps = 1e-6
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = eps
        slope = (m.forward_backward(scores, lengths, moves + d)[2] - m.forward_backward(scores, lengths, moves - d)[2]) / (2 * eps)
        assert np.isclose(slope, expected[i, j], atol=1e-5)
    for s, t in ((0, 0), (0, 4), (1, 1), (2, 2), (3, 0)):
        d = np.zeros((4, 5))
        d[s, t] = eps
        slope = (m.forward_backward(scores + d, lengths, moves)[2] - m.forward_backward(scores - d, lengths, moves)[2]) / (2 * eps)
        assert np.isclose(slope, p[s, t], atol=1e-5)


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["zotter", "qworm", "zottling", "zottish", "vexume"]
    rows, labels = [], []
    for d in range(700):
        words = rng.choices(vocabulary, k=rng.randint(5, 80))
        toxic = d % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(d, t, "en", "x") for d, t in rows], SCHEMA).repartition(3)
    model = m.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = m.score_toxicity(docs, model).collect()
    truth = {d: t for d, _, t in labels}
    out = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in scored if r.held_out]
    assert len(out) > 100 and sum(out) / len(out) > 0.95
    text = dict(rows)
    marked = {text[r.doc_id][s.start : s.end] for r in scored for s in r.spans}
    assert marked and len([w for w in marked if w[:4] in ("zott", "qwor", "vexu")]) / len(marked) > 0.8
    assert {r.predicted for r in m.digest(m.score_toxicity(docs, model)).collect()} == {0, 1}


def test_held_out_labels_leave_the_model_unchanged(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(d, t, "en", "x") for d, t in rows], SCHEMA)
    out = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    flipped = [(d, 1 - q, 1 - t) if d in out else (d, q, t) for d, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    a, b = (m.fit(docs, spark.createDataFrame(x, kind)) for x in (labels, flipped))
    assert a.weights and a.weights == b.weights and a.bias == b.bias and (a.document == b.document).all() and (a.moves == b.moves).all()
    assert {r.doc_id for r in m.score_toxicity(docs, a).where("held_out").collect()} == out


def test_a_repeated_doc_id_is_one_row_of_the_sample(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(d, t, "en", "x") for d, t in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    again = docs.unionByName(docs).unionByName(docs.where("doc_id = 6"))
    assert m.fit(again, marks).weights == m.fit(docs, marks).weights


def test_copies_tell_nothing_new():
    texts = ["a b c d e f g h i j", "a b c d e f g h i j", "k l m n o p q r s t", ""]
    assert m.distinct_texts(texts) == [0, 2, 3]


def test_nulls_repeats_long_texts_and_missing_labels(spark):
    docs = spark.createDataFrame([(None, "x y", "", ""), (1, None, None, None), (1, "", "", ""), (2, "w " * 100_000, "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = m.digest(m.score_toxicity(docs, m.fit(docs, none))).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    assert m.score_toxicity(docs.limit(0), m.fit(docs.limit(0), none)).count() == 0
