"""Models, formatting, encoding and extraction against plain versions and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from shakegrid.llm import byte_bpe, chat, dom, gru, html_text, kneser_ney, pitman_yor, toxicity
from shakegrid.llm.common import remainder

DOCS = "doc_id long, text string, lang string, source string, score string, perplexity string, ids string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def spelled(n, seed, tails=("",)):
    rnd = random.Random(seed)
    parts = ["an", "be", "the", "or", "in", "ly", "st"]
    return [" ".join("".join(rnd.choices(parts, k=rnd.randint(1, 3))) + rnd.choice(tails) for _ in range(rnd.choice([4, 30, 120]))) for _ in range(n)]


def test_byte_bpe(spark):
    texts = [None, "", "a", "Ünïcode 中文 \U0001f600 x", "  two   spaces \n\n\t end ", "'s'll don't", "x" * 3000, "word " * 40_000, "1234567 890", "a\x1cb c d e", "a", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "en", "s", "x", "y", "old") for i, t in enumerate(texts)], DOCS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)._mergeable_ranks, special_tokens={})
    for packed in (True, False):
        got = byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, packed=packed), RANKS, public_tokenizers.PATTERN).collect()
        assert len(got) == len(texts)
        for r in got:
            ids = np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids
            assert ids == enc.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert byte_bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_safe_places():
    rnd = random.Random(2)
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for _ in range(200):
        text = "".join(rnd.choices(["a", "é", " ", "  ", "\n", "'s", "'", "9", "!", "\t", "the", " ", "中"], k=60))
        cut = [*byte_bpe.pieces(text, 7)]
        assert "".join(cut) == text
        assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "a<", "|b", "<\\\\|", "\n lead", " é中\U0001f600 ", "", None, "<|endoftext|>"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)], "x") for c in range(12) for t, r in enumerate(["system", "user", "assistant", "assistant", None, "user\nx", "assistant"][: 2 + c % 6])]
    rows += [(50, 0, "assistant", "word " * 30_000, "x"), (None, None, "user", "hi", "x"), (51, 1, "user", "same", "x"), (51, 1, "user", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    of = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        of.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == of.keys()
    for c, turns in of.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    tok = chat.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for r in formatted.limit(5).collect():
        assert tok.decode(r.ids, skip_special_tokens=False) == r.formatted and len(r.formatted) == got[r.conv_id].formatted_chars
    assert chat.read_back(chat.format_conversations(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_escape_restores():
    rnd = random.Random(4)
    for _ in range(500):
        t = "".join(rnd.choices(["<", "|", "\\", "im_end", ">", "x"], k=12))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_html_model_on_held_out_pages():
    pages = [dom.Page(s, labelled=True) for s in dom.labelled_pages(60, 77)]
    f, label = html_text.Forest(pages), np.concatenate([p.label for p in pages])
    p, joint, _ = html_text.marginals(f, *html_text.fitted())
    assert np.mean((p[:, 1] >= 0.5) == label) > 0.97


def test_foreign_label_attributes_and_deep_pages_are_read(spark):
    odd = '<div><p data-y="12.5">One <g data-y=abc>chart</g> here.</p><p data-y=1>Two.</p></div>'
    plain = odd.replace(' data-y="12.5"', "").replace(" data-y=abc", "").replace(" data-y=1", "")
    weights = html_text.fitted()
    assert html_text.texts([odd], weights) == html_text.texts([plain], weights)
    deep = "<div>" * 20_000 + "<p>inner words</p>" + "</div>" * 20_000 + "</section>" * 20_000
    assert len(dom.Page(deep).tag) == 20_002 and dom.Page(deep).pieces == [(20_001, "inner words")]


def test_sum_product_is_exact():
    page = dom.Page("<div class=x><p>a</p><ul><li>b<li>c</ul></div>")
    f = html_text.Forest([page])
    rng = np.random.default_rng(1)
    node, edge = rng.normal(size=html_text.FEATURES), rng.normal(size=(3, 2, 2))
    own = np.bincount(f.row, node[f.feature], f.n)
    total, on = 0.0, np.zeros(f.n)
    for states in np.ndindex(*[2] * f.n):
        w = math.exp(sum(own[i] * s for i, s in enumerate(states)) + sum(edge[f.kind[i], states[f.parent[i]], states[i]] for i in range(1, f.n)))
        total += w
        on += w * np.array(states)
    p, _, logz = html_text.marginals(f, node, edge)
    assert np.allclose(p[:, 1], on / total) and math.isclose(logz, math.log(total))


def test_html_extraction(spark):
    article = "<article><h1>A &amp; B</h1><p>One <b>bo</b>ld\n text, of &#233; words.<br>Next line here.<p>Unclosed, and more words follow.</article>"
    page = f'<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy now.</div>{article}<footer>&copy; x</footer><script>var s="</p>";</script></body></html>'
    pages = [(1, page), (2, None), (3, ""), (4, "<"), (5, page), (6, page.replace("Next", "Next " * 20_000)), (7, "<div>" * 3000 + "deep"), (8, "</p></article>"), (9, '<p class="x')]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame([(i, "u", h, "old") for i, h in pages], "page_id long, url string, html string, text string"), "html").collect()}
    want = "A & B One bold text, of é words. Next line here. Unclosed, and more words follow."
    assert got[1].text == got[5].text == want and got[6].text == want.replace("Next", "Next " * 19_999 + "Next")
    assert got[2].text == got[3].text == got[8].text == ""
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string"), "html").count() == 0


def labelled(spark):
    good, bad = spelled(160, 1), ["#@! " * 40 + t for t in spelled(25, 2, ("###", "&&"))]
    rows = [(i, t, "en" if i % 3 else None, "s", "x", "y", "z") for i, t in enumerate(good + bad)]
    rows += [(900, None, "en", "s", "x", "y", "z"), (901, "", "xx", None, "x", "y", "z"), (None, "the in", "en", "s", "x", "y", "z"), (902, "the in " * 30_000, "en", "s", "x", "y", "z"), rows[0]]
    labels = [(i, int(i < 160), 0) for i in range(185) if i % 4]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows)


def test_quality(spark):
    docs, labels, n = labelled(spark)
    got = kneser_ney.judge(docs, labels).collect()
    assert len(got) == n
    assert all(r.kept for r in got if r.doc_id is None or r.doc_id < 160 or r.doc_id in (900, 901))
    assert not any(r.kept for r in got if r.doc_id is not None and 160 <= r.doc_id < 185)
    assert kneser_ney.judge(docs, labels.limit(0)).where("kept").count() == n
    assert kneser_ney.judge(docs.limit(0), labels).count() == 0


def test_kneser_ney_sums_to_one(spark):
    docs, labels, _ = labelled(spark)
    model = kneser_ney.fit(docs, labels)
    assert all(a.size > 10 for a in model.alphabets.values())
    for lang, alphabet in model.alphabets.items():
        for context in ((2, 2, 2), (5, 6, 7), (3, 3, 3), (10, 10, 10)):
            key = 0
            for c in context:
                key = (key | c) << kneser_ney.BITS
            assert 0.98 < (10 ** model.log10(lang, key | np.arange(alphabet.size))).sum() < 1.0 + 1e-5


def test_each_language_has_its_own_alphabet(spark):
    """More languages than fifty, one of a script of many characters: what it is badly made of is told apart."""
    rnd = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(600)]
    pairs = [(rnd.choice(han), rnd.choice(han)) for _ in range(120)]
    sane = lambda n: "".join("".join(rnd.choice(pairs)) for _ in range(n))
    rows = [(i, sane(150), "zh", "s", "x", "y", "z") for i in range(60)]
    rows += [(100 + i, "".join(rnd.choices(han, k=300)), "zh", "s", "x", "y", "z") for i in range(10)]
    rows += [(1000 + 100 * k + i, t, f"l{k}", "s", "x", "y", "z") for k in range(55) for i, t in enumerate(spelled(2, k))]
    labels = spark.createDataFrame([(r[0], int(not 100 <= r[0] < 110), 0) for r in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    model = kneser_ney.fit(docs, labels)
    assert len(model.shards) == 57 and model.alphabets["zh"].size > 150
    got = {r.doc_id: r.kept for r in kneser_ney.judge(docs, labels).select("doc_id", "kept").collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(100, 110))


def test_gradients():
    rng = np.random.default_rng(1)
    p, x, mask = gru.initial(5, 3, rng), rng.normal(size=(6, 4, 5)), np.ones((6, 4))
    mask[4:, 1] = 0
    x *= mask[:, :, None]
    y, w = np.array([1, 0, 1, 0.0]), np.array([1, 2, 1, 1.0])
    _, g, dx = gru.gradients(p, x, mask, y, w)
    for name in p:
        for i in list(np.ndindex(p[name].shape))[:6]:
            old, sides = p[name][i], []
            for e in (1e-5, -1e-5):
                p[name][i] = old + e
                sides.append(gru.gradients(p, x, mask, y, w)[0])
            p[name][i] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - g[name][i]) < 1e-7


def test_toxicity(spark):
    rnd = random.Random(9)
    texts = spelled(500, 5)
    label = [int(i % 4 == 0) for i in range(500)]
    for i, t in enumerate(texts):
        ws = t.split()
        for _ in range(label[i] * max(1, len(ws) // 25)):
            ws.insert(rnd.randrange(len(ws) + 1), rnd.choice(["zug", "zugo", "Zugix", "vram"]))
        texts[i] = " ".join(ws)
    rows = [(i, t, "en", "s", "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(900, None, None, None, "x", "y", "z"), (901, "", "en", "s", "x", "y", "z"), (None, "the in", "en", "s", "x", "y", "z"), (902, "the in " * 30_000 + "zug vram zugo", "en", "s", "x", "y", "z"), rows[0]]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, y) for i, y in enumerate(label)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, remainder("doc_id", 4) != 2)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    held = [(r.score, label[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score < 0.3 for r in got if r.doc_id in (900, 901)} == {True}
    assert next(r.score for r in got if r.doc_id == 902) >= 0.3
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_windows_cover_long_texts():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        starts = toxicity.starts_of(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_lm_score(spark):
    texts = spelled(120, 6) + ["unseenword here " * 5]
    rows = [(i, t, "en", "s", "x", "y", "z") for i, t in enumerate(texts)] + [(900, None, "en", "s", "x", "y", "z"), (901, "", "en", "s", "x", "y", "z"), (None, "The In", "en", "s", "x", "y", "z"), (902, "the in " * 30_000, "en", "s", "x", "y", "z"), (3, texts[3], "en", "s", "x", "y", "z"), (903, "a\u0000b éÉ x" + "q" * 5000, "en", "s", "x", "y", "z")]
    got = pitman_yor.score(spark.createDataFrame(rows, DOCS), remainder("doc_id", 7) == 2).collect()
    assert len(got) == len(rows)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for r in rows if not out(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    by = {r.doc_id: r for r in got}
    for r in rows:
        ws, g = tokens(r[1]), by[r[0]]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (out(r[0]), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert g.score < 0
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > 1.02 * sum(g.base_score for g in held)
    assert pitman_yor.score(spark.createDataFrame([], DOCS), remainder("doc_id", 7) == 2).count() == 0
    assert {g.score <= 0 for g in pitman_yor.score(spark.createDataFrame(rows, DOCS), F.lit(True)).collect()} == {True}


def test_word_probabilities_sum_to_one(spark):
    counts = [(w.encode(), c) for w, c in {"": 20, "the": 50, "in": 30, "or": 1, "an": 2, "inthe": 1}.items()]
    counts += [(b"unseen", 0), (b"more", 0)]
    table, n, v = pitman_yor.learned(spark.createDataFrame(counts, "word binary, c long"))
    rows = table.collect()
    assert (n, v) == (104, 6)
    assert math.isclose(sum(r.p for r in rows if r.c) + next(r.p for r in rows if not r.c), 1, rel_tol=1e-5)


def test_seating_bounds():
    c, keys = np.array([0, 1, 2, 50, 10_000, 1_000_000], dtype=float), np.arange(6, dtype=np.uint64)
    t = pitman_yor.seat(c, np.full(6, 0.7), 0.5, keys)
    assert (t == pitman_yor.seat(c, np.full(6, 0.7), 0.5, keys)).all()
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[1:] >= 1).all()


def test_toxicity_reads_long_words_to_their_end():
    word = "".join(random.Random(2).choices("abcdefgh", k=1000)).encode()
    pieces = toxicity.tokens(word.decode())
    assert {word[i : i + 4] for i in range(len(word) - 3)} <= {g for w in pieces for g in toxicity.grams(w)}
    assert max(map(len, pieces)) <= toxicity.LONG and toxicity.tokens("a " + "b" * 64) == [b"a", b"b" * 64] and toxicity.tokens(None) == []
    for n in (65, 111, 112, 113, 160, 161):
        assert toxicity.tokens("c" * n)[-1] and sum(map(len, toxicity.tokens("c" * n))) >= n
    rnd = random.Random(3)
    texts = ["_".join(t.split()[:40]) + "_" for t in spelled(400, 8)]
    label = [i % 3 == 0 for i in range(400)]
    texts = [t + (rnd.choice(["zugzugo", "qvramx"]) if y else "") + "_in" for t, y in zip(texts, label)]
    fitted = [[t for t, y in zip(texts[:300], label) if y == v] for v in (True, False)]
    model = toxicity.fit(*fitted, *map(len, fitted))
    assert np.mean((model.scores(texts[300:]) >= 0.3) == np.array(label[300:])) > 0.9


def test_seating_is_sampled():
    """Against the mean and variance of customers that come in one by one; counts are sampled at every size."""
    keys = np.array([zlib.crc32(str(i).encode()) << 20 for i in range(6000)], np.uint64)
    for n, mass in ((400, 60.0), (3000, 900.0)):
        t = pitman_yor.seat(np.full(len(keys), float(n)), np.full(len(keys), mass), 0.0, keys)
        p = mass / (mass + np.arange(1, n))
        assert abs(t.mean() / (1 + p.sum()) - 1) < 0.1 and 0.8 < t.var() / (p * (1 - p)).sum() < 1.4
    for n, p in ((50, 0.3), (1000, 0.999), (100_000, 0.02)):
        x = pitman_yor.binomial(np.full(len(keys), float(n)), np.full(len(keys), p), keys, 40)
        assert abs(x.mean() - n * p) < 5 * (n * p * (1 - p) / len(keys)) ** 0.5 and 0.9 < x.var() / (n * p * (1 - p)) < 1.1
    assert pitman_yor.SWEEPS == 4
