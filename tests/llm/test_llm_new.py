"""Prefix token counts, the conversation trie and centroid clustering against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shakegrid.llm import conversation_trie as ct, prefix_tokens as pt, zone_centroids as zc

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


ODD = [
    "hello world, it's they're you'll we've don't !!'s", "", "  a  b ", "foo<|endoftext|>bar<|startoftext|>", "<|endoftext|><|endoftext|> x <|endoftext", "İstanbul ŉ ẞ Σς",
    "été café ́x", "한국어 한", "日本語のテキスト、漢字", "x'ree 'r 'l 'll' '''s", "1234 a1b2 ²½", "'RE'Ll", "a\x01b\x02c\x00d\x1ce", " a", "ạ̇<|endoftext|>́",
]


@pytest.mark.parametrize("text", ODD)
def test_every_prefix_has_the_count_of_the_library(library, text):
    counts = pt.counter(WORDS).prefixes(text)
    assert counts[-1] == library(text) and len(counts) == len(text) + 1
    assert all(c == library(text[:i]) for i, c in enumerate(counts) if c >= 0)
    # Only places inside a composed character have none.
    assert (counts >= 0).all() or any(ord(c) > 0x2FF or c == "İ" or c == "ŉ" for c in text)


def test_prefixes_of_random_texts(library):
    rnd, own = random.Random(4), pt.counter(WORDS)
    for _ in range(400):
        text = "".join(rnd.choice(["ab", "the", "ing", "x", "'re", " ", "é", "é", "!", "1", "ß", "漢", "İ", "<|endoftext|>", "Q"]) for _ in range(rnd.randint(1, 25)))
        counts = own.prefixes(text)
        assert counts[-1] == library(text)
        i = rnd.randrange(len(text) + 1)
        assert counts[i] < 0 or counts[i] == library(text[:i]), text[:i]


def test_characters_are_classed_as_in_the_library(library):
    own = pt.counter(WORDS)
    for code in [*range(0x400), *range(0x2000, 0x3100), *range(0x400, 0x110000, 1009)]:
        if not 0xD800 <= code < 0xE000:
            assert own.prefixes(text := f"a{chr(code)}b 1{chr(code)}!")[-1] == library(text), hex(code)


def test_caches_may_be_dropped_at_any_time(library, monkeypatch):
    monkeypatch.setattr(pt, "CACHE_CHARS", 20)
    monkeypatch.setattr(pt, "CACHE_PAIRS", 5)
    own = pt.Counter(WORDS)
    for text in ODD * 2:
        assert own.prefixes(text)[-1] == library(text)


def test_token_counts(spark, library):
    texts = [None, *ODD, "word " * 30_000, "x" * 50_000, "twice", "twice"]
    docs = spark.createDataFrame([(i, t, "kept", 7) for i, t in enumerate(texts)], "doc_id long, text string, other string, prefix_tokens int")
    got = pt.prefix_counts(docs, WORDS)
    assert got.columns == ["doc_id", "text", "other", "prefix_tokens", "token_reach"]
    rows = got.select("doc_id", "other", pt.tokens_at().alias("n"), pt.tokens_at(3).alias("three"), pt.longest_within(2).alias("two"), pt.longest_within(10**6).alias("all")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts):
        text = text or ""
        assert r.other == "kept" and r.n == library(text) and r.all == len(text)
        assert r.three is None or r.three == library(text[:3])
        if len(text) < 100:
            fits = [i for i, c in enumerate(pt.counter(WORDS).prefixes(text)) if 0 <= c <= 2]
            assert r.two == max(fits)
    assert pt.prefix_counts(docs.limit(0), WORDS).count() == 0


CONV = "conv_id long, turn long, role string, text string, key string, level int"


def plain_trie(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            same = f"{len(role.encode())}:{role}{text}".encode()
            said[c].append(((turn is not None, turn or 0), role, hashlib.sha256(same).hexdigest(), text))
    said = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(said.get(c - c % 20, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)

    def subtree(n):
        inner = [subtree(k) for k in kids[n]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        return 1 if not inner else sum(x[0] for x in inner), (len(nodes[n]) - 1) * words + sum(x[1] for x in inner)

    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if built[c] == n)))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids[n]), *subtree(n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rnd = random.Random(9)
    rows = []
    for c in range(90):
        same = rnd.random() < 0.5
        for t in range(rnd.choice([1, 2, 3, 5, 11])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"shared turn {t}" if same else rnd.choice(["a b", "c\td e", "ä"])))
    rows += [(200, t, "user", f"long {t % 7}") for t in range(61)] + [(201, t, "user", f"long {t % 7}") for t in range(60)]
    rows += [(5, None, None, None), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (5, 0, "tool", "tie"), (None, 0, "user", "nobody"), (-7, 0, "user", ""), (300, 2, "user", "x " * 20_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 8])
def test_trie(spark, width, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 3)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], CONV)
    got = ct.trie(ct.rebuilt(ct.paths(df)), width)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_of_empty_conversations(spark):
    none = spark.createDataFrame([], CONV)
    assert ct.trie(ct.rebuilt(ct.paths(none))).count() == 0
    one = spark.createDataFrame([], "conv_id long, turns array<binary>").union(spark.sql("SELECT 4L, slice(array(unhex('00')), 1, 0)"))
    assert [tuple(r) for r in ct.trie(one).collect()] == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]


def test_rollup_drops_padding_before_it_sums(spark):
    df = spark.createDataFrame([(*r, "x", 3) for r in conversations()], CONV)
    plan = ct.rolled_up(ct.blocks(ct.paths(df), 8), 8, "count(1) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter CASE") < plan.index("Expand")


def plain_means(vectors, k, rounds, seed):
    """(id, vector) with Python's integers."""
    kept = [(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**17 for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], r[1]))
    centroids = [v for _, v in start[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (gap(v, centroids[c]), c)) for _, v in kept]
        if step < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, own) if o == c]
                if mine:
                    centroids[c] = tuple(sum(x) // len(mine) for x in zip(*mine))
    far = [gap(v, centroids[o]) for (_, v), o in zip(kept, own)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, d, sum(x for x, p in zip(far, own) if p == o), sum(far), names[o]) for (i, _), o, d in zip(kept, own, far)), key=str)


VEC = "vec_id long, embedding array<float>, label int, cluster string, inertia string"


@pytest.mark.parametrize("block", [1, 7, 256])
def test_centroids(spark, block):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.3, (6, 64))
    vectors = [(i, [float(x) for x in np.float32(middle[i % 6] + rng.normal(0, 0.05, 64))]) for i in range(150)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(40)] + [(7, vectors[7][1]), (None, vectors[1][1]), (None, vectors[2][1])]
    bad = [(i, list(v)) for i, v in zip(range(2000, 2004), [vectors[3][1]] * 4)]
    bad[0][1][5], bad[1][1][5], bad[2][1][5], bad[3][1][5] = None, float("nan"), float("inf"), float(2**17)
    vectors += bad + [(2010, None), (2011, []), (2012, [0.5] * 63), (2013, [0.0] * 64), (2014, [100_000.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in vectors], VEC)
    got = sorted((tuple(r) for r in zc.cluster(df, rounds=4, block=block).collect()), key=str)
    assert got == plain_means(vectors, 8, 4, 3)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 64, 1, "x", "y"), (2, [0.5] * 64, 1, "x", "y"), (3, [-0.25] * 64, 1, "x", "y")], VEC)
    got = zc.cluster(df)
    assert got.count() == 3 and got.agg(F.max("inertia")).first()[0] == 0
    none = zc.cluster(df.limit(0))
    assert none.count() == 0 and [t for _, t in none.dtypes] == [t for _, t in got.dtypes]


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (5, 2), (2, 1)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    order = sorted(range(len(cells)), key=lambda i: zc.hilbert_keys(cells, bits)[i].tobytes())
    assert len({zc.hilbert_keys(cells, bits)[i].tobytes() for i in order}) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_boxes_keep_the_nearest_and_drop_far_centroids():
    rng = np.random.default_rng(8)
    middle = rng.integers(-2000, 2000, (8, 64))
    for own in range(8):
        x = middle[own] + rng.integers(-300, 300, (50, 64))
        fits = zc.candidates(x.min(0)[None], x.max(0)[None], middle)[0]
        full, _ = zc.nearest(x, middle, np.arange(8))
        some, _ = zc.nearest(x, middle, np.flatnonzero(fits))
        assert (full == some).all() and fits.sum() == 1
