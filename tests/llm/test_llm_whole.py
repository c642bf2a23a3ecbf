"""What the operators learn comes from all rows."""

import pickle
import zlib
from collections import Counter

import numpy as np

from shakegrid.llm import kneser_ney, sampling, toxicity
from shakegrid.llm.sampling import labelled

DOCS = "doc_id long, text string, lang string"


def test_every_labelled_document_teaches(spark):
    rows = [(i, f"word {i}", "en") for i in range(2500)] + [(9000, "long " * 9000, "en"), (7, "word 7", "en"), (None, "none", "en"), (9001, "", "en"), (9002, None, "en"), (9003, "no label", "en")]
    labels = [(i, 1) for i in range(2500)] + [(9000, 1), (7, 1), (None, 1), (9001, 1), (9002, 1), (9003, None), (7, 0)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    got = Counter((r.doc_id, r.text, r.quality) for r in labelled(docs, labels, "quality").collect())
    assert got == Counter([(i, f"word {i}", 1) for i in range(2500)] + [(9000, "long " * 9000, 1), (7, "word 7", 0)])


def test_labelled_texts_stay_where_they_lie(spark, monkeypatch):
    """Labelled ids are sent as bitmaps, whatever their number; ids too far apart for them are joined, with the same rows."""
    ids = [*range(-40_000, 40_000, 7), 1 << 40, -(1 << 62), (1 << 63) - 1]
    docs = spark.createDataFrame([(i, f"t{i}", "en") for i in ids] + [(None, "none", "en"), (3, "no label", "en")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in ids if i % 3] + [(9, 1), (None, 0)] + [(i, 1) for i in ids if i % 12 == 0], "doc_id long, toxic int")
    want = Counter((i, f"t{i}", i % 2) for i in ids if i % 3) + Counter((i, f"t{i}", 1) for i in ids if i % 12 == 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sent = labelled(docs, labels, "toxic")
        monkeypatch.setattr(sampling, "BITMAPS", 3)
        met = labelled(docs, labels, "toxic")
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (sent, met)]
        assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
        for x in (sent, met):
            assert x.columns == ["doc_id", "text", "toxic"]
            assert Counter(map(tuple, x.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quality_learns_from_all_trusted_text(spark):
    """A character that only documents beyond the first thousand and long ones hold has its own class."""
    rows = [(i, "the same line " + "éàü"[i % 3] * (i >= 1000), "en") for i in range(1300)] + [(2000, "ø the same line " * 2000, "en")]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    model = kneser_ney.fit(docs, labels)
    for lang in ("en", ""):
        classes = model.alphabets[lang].map
        assert len({classes[ord(c)] for c in "éàüø"} | {kneser_ney.RARE}) == 5


def test_large_models_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda i: " ".join("".join(rng.choice(list("abcdefgh"), 3)) for _ in range(30 * (i % 5)))
    rows = [(i, text(i), ("en", "de", None, "xx")[i % 4]) for i in range(200)] + [(300, None, "en"), (None, "abc abd", "fr"), (5, "abc é一", "de")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(200) if i % 4 < 3 and i % 7], "doc_id long, quality int")
    sent = kneser_ney.fit(docs, labels)
    monkeypatch.setattr(kneser_ney, "MODEL_ROWS", 0)
    monkeypatch.setattr(kneser_ney, "BLOCK_CHARS", 5000)
    table = kneser_ney.fit(docs, labels)
    assert sent.table is None and table.table is not None and set(sent.mean) == set(table.mean)
    assert all(abs(sent.mean[k] - table.mean[k]) < 1e-6 for k in sent.mean)
    a, b = (sorted((str(r.doc_id), r.text or "", r.perplexity) for r in kneser_ney.perplexities(docs, m).collect()) for m in (sent, table))
    assert [x[:2] for x in a] == [x[:2] for x in b] and max(abs(x[2] - y[2]) for x, y in zip(a, b)) < 1e-4


def test_toxicity_learns_from_all_labelled_text(spark, monkeypatch):
    """Long documents teach too, and shards are averaged to one model."""
    monkeypatch.setattr(toxicity, "SHARD", 250)
    monkeypatch.setattr(toxicity, "EPOCHS", 30)
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 200, n))
    rows = [(i, text(40) + " vexgrob " * (i % 5 == 0) + text(20), "en") for i in range(0, 500)]
    rows += [(1000 + i, text(3000) + " quzzilk " * (i % 2) + text(3000), "en") for i in range(60)]
    labels = [(i, int(i % 5 == 0)) for i in range(500)] + [(1000 + i, i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scores = model.scores([text(30) + w + text(30) for w in (" quzzilk ", " vexgrob ", " ") for _ in range(5)])
    assert (scores[:10] >= 0.3).all() and (scores[10:] < 0.3).all()


def test_toxicity_states_leave_a_task_as_one_sum(spark, monkeypatch):
    """Shards that share a task give the model of shards that have one each."""
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "SHARD", 2)
    rows = [(i, f"w{i} a b " + "bad " * (i % 2), "en") for i in range(80)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    made = []
    pinned = lambda df: made.append(df.rdd.getNumPartitions()) or df.localCheckpoint()
    monkeypatch.setattr(toxicity, "pin", pinned)
    together = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "TOGETHER", 1)
    alone = toxicity.train(docs, labels)
    assert made == [16, 40]
    assert all(np.allclose(together.params[k], alone.params[k], atol=1e-6) for k in alone.params)


def test_spelled_gives_crc32_of_the_grams():
    ws = [b"", b"a", b"ab", b"abc", "é中".encode(), b"\x00\xff" * 20, b"$^", b"x" * 64]
    flat, first, size = toxicity.spelled(ws)
    for w, at, n in zip(ws, first, size):
        assert [*flat[at : at + n]] == [zlib.crc32(g) for g in toxicity.grams(w)]
    assert len(flat) == size.sum() and [len(x) for x in toxicity.spelled([])] == [0, 0, 0]


def test_toxicity_prepares_a_shard_once(spark, monkeypatch):
    """Examples come from the pinned rows of their shard; a pass reads them and prepares nothing."""
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    pinned = []
    monkeypatch.setattr(toxicity, "pin", lambda df: pinned.append(df.localCheckpoint()) or pinned[-1])
    rows = [(i, f"w{i} a b " + "bad " * (i % 2), "en") for i in range(20)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    (shard,) = pinned[0].collect()
    examples = pickle.loads(shard.examples)
    assert shard.n == 20 and examples.windows.shape == (20, toxicity.WINDOW) and sorted(examples.y) == [0.0] * 10 + [1.0] * 10
