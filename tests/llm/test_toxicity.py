import random
import zlib

import numpy as np
import pyarrow as pa

from apilattice.llm import toxicity as T


def corpus(n, seed=1):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    bad = ["scoundrel", "numskull", "lowlife", "oafish"]
    docs, labels = [], []
    for k in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 120))]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(rnd.randint(1, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(bad + ["grubling" + rnd.choice(["a", "o", "en", "ish"])])
        docs.append((k, " ".join(words).capitalize()))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500)
    d = spark.createDataFrame(docs + [(9001, None), (9002, ""), (None, "Numskull!")], "doc_id bigint, text string").withColumn("score", T.F.lit(5)).withColumn("held_out", T.F.lit(5))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in T.scored(d, T.trained(d, lab)).collect()}
    assert len(got) == len(docs) + 3
    held = [(got[k].predicted, t) for k, _, t in labels if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in labels)
    assert sum(p == t for p, t in held) / len(held) > 0.98
    assert got[9001].score == got[9002].score < 0.1 and got[None].predicted == 1 and not got[None].held_out


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(300)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, q, t in labels]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    one, two = (T.trained(d, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")) for x in (labels, flipped))
    assert (one.weight == two.weight).all() and one.bias == two.bias


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    rates = [(0.6, 0.01), (0.5, 0.02), (0.4, 0.01), (0.3, 0.3)]
    fires = np.stack([rng.random(4000) < np.where(y, a, b) for a, b in rates] + [rng.random(4000) < 0.05] * 2, axis=1)
    fires = np.c_[fires, fires[:, :1]]  # a voter that only repeats the first
    fires = fires[:, [0, 1, 2, 6, 3, 4, 5]]
    posterior, found, together = T.label_model(fires, 4)
    true = np.array([y[fires[:, k]].mean() for k in range(7)])
    assert np.allclose(found, true, atol=0.15)
    inside = np.corrcoef(fires[y].astype(float).T)
    assert together[0, 3] > 0.95 and np.allclose(together[:4, :4] + np.eye(4), inside[:4, :4], atol=0.15)
    assert ((posterior > 0.5) == y).mean() > 0.9


def test_sample_is_bounded_in_bytes(spark):
    docs, labels = corpus(300)
    long_ = [(5000, "numskull " * 200_000)]
    d = spark.createDataFrame(docs + long_, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(5000, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = T.trained(d, lab, sample_bytes=100_000)
    got = {r.doc_id: r.predicted for r in T.scored(d, model).collect()}
    assert len(got) == 301 and got[5000] == 1


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in T.scored(d, T.trained(d, none)).collect()} == {0}
    assert T.scored(d.limit(0), T.trained(d, none)).collect() == []
    calm = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in T.scored(d, T.trained(d, calm)).collect()} == {0}


def test_terms():
    (whole, at), *begins = list(T.terms(pa.array(["Idiot, idiotic!", None, "IDIOT"])))
    assert at.tolist() == [0, 2, 2, 3] and whole[0] == whole[2] != whole[1]
    assert begins[1][0].shape == (1,)  # only idiotic is longer than five bytes
