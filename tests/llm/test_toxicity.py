import math
import random

import numpy as np
import pytest

from textloom.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad, good = rng.random() < 0.25, rng.random() < 0.7
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["Awful!", "nasty,", "horrid"]))
        if not good:
            text += ["spam"] * 3
        docs.append((i, " ".join(text)))
        labels.append((i, int(good), int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900, 1)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as _id", "true as is_toxic", "3 as toxic_score", "'a' as `odd name`")
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    chain = tx.fit_chain(frame, known)
    got = {r.doc_id: r for r in tx.score_documents(frame, chain).collect()}
    right = [got[i].is_toxic == bool(bad) for i, _, bad in labels[600:]]
    assert len(got) == 900 and sum(right) / len(right) > 0.95
    assert sum((got[i].quality_score > 0.5) == bool(good) for i, good, _ in labels[600:]) > 285


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, None, None), (None, 1, 1), (0, 1, 0)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "x" * 40000), (None, "a b"), (2, "x" * 40000)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tx.score_documents(docs, tx.fit_chain(docs, known)).collect()
    assert len(got) == 5 and not any(r.is_toxic for r in got)
    assert tx.score_documents(docs.limit(0), tx.fit_chain(docs.limit(0), known)).count() == 0


def plain_fit(bags, earlier, y, use):
    """The logistic model word by word: weights by word, then of earlier logits, then the base."""
    n1 = sum(y[i] for i in use)
    n0 = len(use) - n1
    if not n0 or not n1:
        return {}, [0.0] * len(earlier[0]), 8.0 if use and n1 else -8.0
    words = sorted({w for bag in bags for w in bag})
    scale = {}
    for w in words:
        with1 = sum(y[i] for i in use if w in bags[i])
        with0 = sum(1 - y[i] for i in use if w in bags[i])
        scale[w] = math.log((with1 + 0.5) / (n1 + 1)) - math.log((with0 + 0.5) / (n0 + 1))
    theta = {**{w: 0.0 for w in words}, **{(k,): 0.0 for k in range(len(earlier[0]))}, "base": math.log(n1 / n0)}
    first, second = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)
    for t in range(1, tx.STEPS + 1):
        error = {}
        for i in use:
            z = sum(theta[w] * scale[w] for w in bags[i]) + sum(theta[k,] * e for k, e in enumerate(earlier[i])) + theta["base"]
            error[i] = 1 / (1 + math.exp(-z)) - y[i]
        gradient = {w: scale[w] * sum(error[i] for i in use if w in bags[i]) + 0.3 * theta[w] for w in words}
        gradient |= {(k,): sum(error[i] * earlier[i][k] for i in use) + 0.3 * theta[k,] for k in range(len(earlier[0]))}
        gradient["base"] = sum(error.values())
        for k, g in gradient.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            theta[k] -= 0.1 * (first[k] / (1 - 0.9**t)) / (math.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return {w: theta[w] * scale[w] for w in words}, [theta[k,] for k in range(len(earlier[0]))], theta["base"]


def test_chain_equals_a_plain_one():
    rng = random.Random(4)
    bags = [set(rng.sample(range(12), rng.randint(0, 6))) for _ in range(24)]
    labels = [[int(3 in b or rng.random() < 0.2), int(5 in b and 3 in b)] for b in bags]
    folds = [i % tx.FOLDS for i in range(24)]
    kept = [w for w in range(12) if sum(w in b for b in bags) >= tx.LEAST_TEXTS]
    known = [b & set(kept) for b in bags]
    logit = lambda model, bag, before: sum(model[0].get(w, 0) for w in bag) + sum(a * b for a, b in zip(model[1], before)) + model[2]
    y = [row[0] for row in labels]
    empty = [[] for _ in bags]
    out_of_fold = [0.0] * 24
    for f in range(tx.FOLDS):
        model = plain_fit(known, empty, y, [i for i in range(24) if folds[i] != f])
        for i in range(24):
            if folds[i] == f:
                out_of_fold[i] = max(-8, min(8, logit(model, known[i], [])))
    one = plain_fit(known, empty, y, list(range(24)))
    two = plain_fit(known, [[z] for z in out_of_fold], [row[1] for row in labels], list(range(24)))
    want = []
    for bag in known:
        a = max(-8, min(8, logit(one, bag, [])))
        b = max(-8, min(8, logit(two, bag, [a])))
        want.append([1 / (1 + math.exp(-a)), 1 / (1 + math.exp(-b))])
    as_rows = [np.array(sorted(b), np.uint32) for b in bags]
    chain = tx.Chain(as_rows, np.array(labels), np.array(folds))
    assert np.allclose(chain.predict(as_rows), want, atol=1e-9)


def test_repeated_ids_and_labels_give_one_training_row_each(spark):
    docs, labels = corpus(60, 2)
    once = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    many = once.unionByName(once).unionByName(once)
    doubled = known.unionByName(known.selectExpr("doc_id", "0 as quality", "0 as toxic"))
    a, b = tx.fit_chain(once, known, most=50), tx.fit_chain(many, doubled, most=50)
    assert len(a.held_out) == len(b.held_out) == 50
    assert np.array_equal(a.vocabulary, b.vocabulary) and all(np.array_equal(x, y) for x, y in zip(a.models, b.models, strict=True))
