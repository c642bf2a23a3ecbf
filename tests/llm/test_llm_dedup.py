"""Near-dedup operators, fingerprints and mixing against plain versions."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shakegrid.llm import embedding_dedup, mixing, simhash, weighted_sampling
from shakegrid.llm.components import components
from shakegrid.llm.hnsw import Graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string"


def corpus(n=80, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgäéß") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 5, 40, 200]))) for _ in range(n)]
    for i in range(0, n, 4):
        ws = texts[i].split()
        ws[rnd.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
        texts.append(texts[i].upper().replace(" ", " \t\n"))
    return [(i, t, "en", f"src{i % 3}", len(t), "x", "y") for i, t in enumerate(texts)]


EDGE = [(1000, None, None, None, None, "x", "y"), (1001, "", "en", "", 0, "x", "y"), (None, "no id here", "en", "s", 1, "x", "y"), (1002, "long " * 60_000, "en", "s", 1, "x", "y"), (1003, "twice", "en", "s", 1, "x", "y"), (1003, "twice", "en", "s", 1, "x", "y")]


def plain_fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    ws = [w for w in ws if w]
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(500, x) for x in range(501, 560)] + [(x, x + 1) for x in range(600, 640)]
    want = roots_of({x for p in links for x in p}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark):
    rows = corpus() + EDGE
    got = simhash.groups(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    fp = {r[0]: plain_fingerprint(r[1]) for r in rows if r[0] != 1002}
    assert all(r.fp % (1 << 64) == fp[r.doc_id] for r in got if r.doc_id != 1002)
    fp[1002] = next(r.fp % (1 << 64) for r in got if r.doc_id == 1002)
    known = [i for i in fp if i is not None]
    want = roots_of(known, [(a, b) for a, b in itertools.combinations(known, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    kept = simhash.representatives(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert simhash.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_links_within_two_bits(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps |= {x, x ^ 1 << rnd.randrange(64), x ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64), x ^ 7 << rnd.randrange(60)}
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    for bits in (0, 1, 2):
        got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()]
        want = [(a, b) for a, b in itertools.combinations(signed, 2) if (signed[a] ^ signed[b]).bit_count() <= bits]
        assert roots_of(signed, got) == roots_of(signed, want)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 3)


def test_graph_finds_neighbours():
    x = np.random.default_rng(2).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, _ = Graph(x).beam(x[:200].astype(np.float32), 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len({*a} & {*b[:10]}) / 10 for a, b in zip(true, ids)]) > 0.9
    assert len(Graph(x[:1]).beam(x[:1].astype(np.float32), 8)[0]) == 1


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 120)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 90)
    rng = np.random.default_rng(4)
    centres, rows = rng.normal(size=(30, 16)), []
    for i in range(500):
        v = centres[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25])
        rows.append((i, [float(a) for a in v.astype(np.float32)], int(rng.integers(2)), "extra", 7))
    rows += [(560 + k, [a * 2.0**e for a in rows[3][1]], rows[3][2], "extra", 7) for k, e in enumerate((100, -100))]
    hot = [(600 + i, [float(a) for a in (centres[0] + rng.normal(size=16) * 0.05)], 5, "e", 7) for i in range(250)]
    bad = [(900, None, 1, "e", 1), (901, [], 1, "e", 1), (902, [0.0] * 16, 1, "e", 1), (903, [float("nan")] * 16, 1, "e", 1), (904, [1.0, None] * 8, 1, "e", 1), (905, rows[0][1], None, "e", 1), (906, rows[0][1][:8], rows[0][2], "e", 1), (None, rows[0][1], rows[0][2], "e", 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows + hot + bad + [rows[3]], "vec_id long, embedding array<float>, label int, kept string, n_links int")).collect()
    assert len(got) == len(rows) + len(hot) + len(bad) + 1
    good = rows + hot
    x = np.array([r[1] for r in good], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in good]
    root = roots_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == n and by[i].component_id == root[i] and by[i].kept == (root[i] == i) for i, n in zip(ids, near.sum(1)))
    assert all(by[r[0]].n_links == 0 and by[r[0]].component_id == r[0] for r in bad)
    assert all(r.kept for r in got if r.vec_id is None)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_vectors_of_any_size_are_compared(spark):
    v = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, [a * f for a in v], 1) for i, f in enumerate((1.0, 1e200, 1e-200, 1e-310, -1e300))]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0, True), 1: (3, 0, False), 2: (3, 0, False), 3: (3, 0, False), 4: (0, 4, True)}


def test_fingerprints(spark):
    rows = corpus(40) + [r for r in EDGE if r[0] != 1002]
    got = weighted_sampling.edited(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    known = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}, reverse=True)
    chain = known + [(None, "no id here")]
    words = lambda t: Counter(t.lower().split())
    by, prints, errors = {r.doc_id: r for r in got}, {}, []
    for (i, text), (_, other) in zip(chain, chain[1:] + chain[:1]):
        half = len(text) // 2
        edited, r = text[: len(text) - half] + other[:half], by[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        for likeness, b in ((r.near_edited, edited), (r.near_next, other)):
            x, y = words(text), words(b)
            true = sum((x & y).values()) / max(1, sum((x | y).values())) if x or y else 1.0
            errors.append(likeness - true)
            assert not x or text != b or likeness == 1
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1
    assert by[1001].fingerprint == by[1000].fingerprint == "" and by[1001].near_next == 1.0
    assert weighted_sampling.edited(spark.createDataFrame([], DOCS)).count() == 0


def test_weights_count(spark):
    rows = [(k, t, w) for k, ws in ((1, {1: 9, 2: 1, 3: 4}), (2, {1: 3, 2: 2, 4: 5})) for t, w in ws.items()]
    rows += [(1000 * k + s, 1000 * s + t, w) for s in range(1, 60) for k, t, w in rows[:6]]
    got = {r.k: r.signature for r in weighted_sampling.signatures(spark.createDataFrame(rows, "k long, term long, weight long"), ["k"]).collect()}
    same = [got[1000 + s][i : i + 4] == got[2000 + s][i : i + 4] for s in range(1, 60) for i in range(0, 4 * weighted_sampling.SAMPLES, 4)]
    assert abs(np.mean(same) - (3 + 1) / (9 + 2 + 4 + 5)) < 0.03


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", s, 1, "x", "y") for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 40 + [None] * 100)]
    df = spark.createDataFrame(rows + [rows[0]], DOCS)
    for targets in (None, {"a": 2, "b": 1, None: 1}):
        got = sorted(mixing.mix(df, targets, block=10).collect(), key=lambda r: r.mix_position)
        assert len(got) == len(rows) + 1 and len({r.mix_position for r in got}) == len(got)
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows + [rows[0]])
        slots = {}
        for r in got:
            assert slots.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block) or targets and r.source == "c"
        assert sorted(slots) == list(range(len(slots)))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    ordered = mixing.in_order(mixing.mix(df))
    assert ordered.columns == df.columns and ordered.count() == len(rows) + 1


def test_schedule_stays_within_a_block():
    for weights in ({1: 5.0, 2: 3.0, 3: 1.0}, {i: 1.0 + i * i for i in range(17)}, {1: 1.0}):
        share = mixing.shares(weights)
        period, slots = sum(share.values()), mixing.one_period(share)
        assert sorted(t for s in slots.values() for t in s) == list(range(period))
        for s, m in share.items():
            gone = 0
            for t in range(period):
                gone += t in set(slots[s])
                assert abs(gone - (t + 1) * m / period) < 1
    rows = mixing.plan({1: 50, 2: 10, 3: 7}, {1: 1.0, 2: 1.0, 3: 3.0})
    taken = [base + j // m * period + slots[j % m] for _, first, last, base, period, m, slots in rows for j in range(last - first + 1)]
    assert sorted(taken) == list(range(67))


@pytest.mark.parametrize("weights", [
    {"s0": 0.5, **{f"s{i}": 0.5 / 19 for i in range(1, 20)}}, {"a": 0.001, "b": 0.999}, {f"s{i}": float(1 + i % 7) ** 0.5 for i in range(450)},
])
def test_mixture_stays_within_a_block_of_its_target(weights):
    """Against the exact target weights, over a long run, until the first source runs out."""
    slots, total = 20_000, sum(weights.values())
    sources = [(s, max(1, int(slots * w / total)), w) for s, w in weights.items()]
    most = min(n / w for _, n, w in sources) * total  # the first source runs out then
    placed = list(mixing.schedule(sources))
    assert [t for _, _, t in placed] == list(range(sum(n for _, n, _ in sources)))
    gone = dict.fromkeys(weights, 0)
    names, exact = list(weights), np.array([w / total for w in weights.values()])
    for s, j, t in placed:
        assert j == gone[s]
        gone[s] += 1
        if t + 1 <= most and (t % 7 == 0 or t < 2_000):
            assert np.abs(np.array([gone[x] for x in names]) - exact * (t + 1)).max() < 1 + 1e-9


def test_mixture_of_many_sources_and_of_unnamed_ones(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 260}", 1, "x", "y") for i in range(260 * 12)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=4).collect()
    assert len({(r.source, r.mix_block) for r in got}) == len({r.mix_slot for r in got}) == 260 * 3
    targets = {"s1": 3.0, "s2": 1.0, "s3": 0.0}
    got = mixing.mix(spark.createDataFrame(rows, DOCS), targets, block=4).collect()
    assert {r.source for r in got if r.mix_slot < 6} == {"s1", "s2"} and len({r.mix_position for r in got}) == len(rows)


def test_audit_is_not_hidden_by_a_huge_group():
    rng = np.random.default_rng(4)
    huge = rng.normal(size=32) + 0.01 * rng.normal(size=(700, 32))
    lone = rng.normal(size=(700, 32))
    x, _ = embedding_dedup.unit(np.concatenate([huge, lone, lone + 0.01 * rng.normal(size=lone.shape)]))

    class Lossy:
        """Finds all, but no partner of a pair in a beam below 128."""

        def __init__(self):
            self.x = x

        def beam(self, q, width):
            sims = q @ x.T
            if width < 128:
                r, c = np.nonzero((sims > 0.9) & (sims < 0.999999) & ((sims > 0.9).sum(axis=1) == 2)[:, None])
                sims[r, c] = -1
            ids = np.argsort(-sims, axis=1)[:, :width]
            return ids, np.take_along_axis(sims, ids, axis=1)

    found = {(int(a), int(b)) for part in embedding_dedup.near(Lossy(), x, 0.93) for a, b in zip(*part)}
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.93))}


def test_equal_terms_of_a_pair_draw_once(spark, monkeypatch):
    """Both texts get the signature that each gets alone, and a term that both hold equally often is drawn for once (op4)."""
    texts = {(1, 0): "a b c c", (1, 1): "a B c d", (2, 0): "", (2, 1): "x x", (3, 0): "y z", (3, 1): "y z"}
    df = spark.createDataFrame([(*k, t) for k, t in texts.items()], "k int, which int, text string")
    drawn, draws = [], weighted_sampling.draws

    def counted(weighted, keys):
        drawn.append(weighted.where("weight is not null").count())
        return draws(weighted, keys)

    monkeypatch.setattr(weighted_sampling, "draws", counted)
    got = {(r.k, r.which): r.signature for r in weighted_sampling.paired_signatures(df, ["k"]).collect()}
    assert drawn == [2 + 3 + 1 + 2]
    words = df.selectExpr("k", "which", "explode(split(lower(text), ' ')) w").where("w != ''")
    alone = words.selectExpr("k", "which", "xxhash64(w) term").groupBy("k", "which", "term").count().withColumnRenamed("count", "weight")
    want = {(r.k, r.which): r.signature for r in weighted_sampling.signatures(alone, ["k", "which"]).collect()}
    assert {k: s for k, s in got.items() if s} == want and len(want) == 5


def test_no_join_of_fingerprints_is_a_broadcast(spark):
    """Sizes are read off packed columns from before they are exploded, so a side of 65 rows a fingerprint looks small."""
    fps = spark.range(500).selectExpr("id * 7919 fp")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    docs = spark.createDataFrame(corpus()[:30], DOCS)
    assert "BroadcastHashJoin" not in simhash.groups(docs)._jdf.queryExecution().executedPlan().toString()
