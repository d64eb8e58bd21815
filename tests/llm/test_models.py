import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftscan.llm import html_text, language_model, licences, quality_classifier, sentence_pieces

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- language model -----------------------------------------------------------------------------------------------


def brute_scores(docs):
    tokens = [(k, [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for k, t in docs]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs]
    one, two = Counter(), Counter()
    for (_, t), h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip(["", *t], t))
    n, v, starts = sum(one.values()), len(one), sum(not h for h in held)
    out = []
    for (k, t), h in zip(tokens, held, strict=True):
        word = [(one[w] + 1) / (n + v + 1) for w in t]
        context = [starts, *(one[w] for w in t[:-1])]
        model = [(two[c, w] + language_model.M * p) / (m + language_model.M) for c, w, p, m in zip(["", *t], t, word, context)]
        out.append((k, h, len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, word)), sum(map(math.log10, model))))
    return out


def test_scores_match_brute_force(edge_docs, edge_rows, no_docs):
    wanted = sorted(brute_scores([(k, t) for k, t, *_ in edge_rows]), key=lambda r: (r[0] or 0, r[2]))
    rows = sorted(language_model.scores(edge_docs).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert len(rows) == len(wanted)
    for r, w in zip(rows, wanted, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9)
        assert abs(r.score - w[6]) < 0.03 * r.n_tokens
    assert language_model.scores(no_docs).count() == 0


def test_shards_and_chunks_do_not_change_scores(spark, monkeypatch):
    docs = [(k, prose(k % 9, 40 + k)) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r.score for r in language_model.scores(df).collect()}
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 100)
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", 300)
    cut = {r.doc_id: r.score for r in language_model.scores(df).collect()}
    assert cut == pytest.approx(whole)
    wanted = {r[0]: r for r in brute_scores(docs)}
    held = [k for k in whole if wanted[k][1]]
    assert held and sum(whole[k] for k in held) > sum(wanted[k][5] for k in held)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**20), max_size=80, unique=True), st.sampled_from([2**20 + 1, 1 << 40]))
def test_elias_fano(values, top):
    a = np.array(sorted(values), np.uint64)
    coded = language_model.EliasFano.build(a, top)
    if len(a):
        assert (coded.get(np.arange(len(a))) == a).all()
    asked = np.array(sorted({*values, *(v + 1 for v in values), 0, 7}), np.uint64)
    assert coded.find(asked).tolist() == [values_at if (values_at := sorted(values).index(x) if x in set(values) else -1) >= 0 else -1 for x in asked.tolist()]


def test_elias_fano_of_whole_hashes():
    a = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    coded = language_model.EliasFano.build(a, 1 << 64)
    assert (coded.find(a) == np.arange(len(a))).all() and (coded.find(a + np.uint64(1)) == -1).all()
    assert sum(p.nbytes for p in coded.parts()) < 8 * len(a)


# -- quality classifier -------------------------------------------------------------------------------------------


def labelled(n, seed=0):
    rng = random.Random(seed)
    docs = []
    for k in range(n):
        good = rng.random() < 0.7
        text = prose(seed * 1000 + k, rng.randrange(10, 300))
        if not good:
            text = rng.choice([lambda t: t.replace(" ", "%%% "), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w for w in t.split()[:12] for _ in range(15))])(text)
        docs.append((k, text, int(good)))
    return docs


def test_classifier_on_held_out_rows(spark):
    docs = labelled(500)
    df = spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, None) for k, _, q in docs if k % 10] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.with_scores(df, labels).select("doc_id", "score", quality_classifier.held_out().alias("h")).collect()
    truth = {k: q for k, _, q in docs}
    held = [r for r in rows if r.h]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.3) == (truth[r.doc_id] == 1) for r in held]) > 0.95


def test_classifier_on_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    rows = quality_classifier.with_scores(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert quality_classifier.with_scores(no_docs, labels).count() == 0
    none = quality_classifier.with_scores(edge_docs, labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.stage.__doc__


def test_attention_gradients():
    rng = np.random.default_rng(0)
    m = quality_classifier.train([b"a b", b"c %%% d", b"e"], [1, 0, 1])
    x, per = rng.normal(size=(7, quality_classifier.WIDTH)), np.array([3, 1, 3])
    y = np.array([1.0, 0, 1])
    names = ["w", "b", "v", "u", "a", "c", "d"]
    for k in names:
        m[k] = rng.normal(0, 0.3, m[k].shape)
    loss = lambda: float(-np.mean(y * np.log(p := quality_classifier.forward(m, x, per)[0]) + (1 - y) * np.log(1 - p)))
    p, kept = quality_classifier.forward(m, x, per)
    grads = quality_classifier.gradient(m, x, p, y, kept)
    for k in names:
        at = tuple(0 for _ in m[k].shape)
        m[k][at] += 1e-5
        up = loss()
        m[k][at] -= 2e-5
        down = loss()
        m[k][at] += 1e-5
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


# -- pages --------------------------------------------------------------------------------------------------------


def test_blocks():
    page = "<!doctype html><title>t</title><script>a='<p>';</script><p>a <b>b</b>c&amp;\n d<p>e<br>f<ul><li>g<li>h</ul><!-- i --><div class='x-ad'>j</div><p>k"
    assert [b.text for b in html_text.blocks(page)] == ["a bc& d", "e f", "g", "h", "j", "k"]
    assert html_text.blocks(None) == html_text.blocks("") == []
    assert [b.text for b in html_text.blocks("a < b <!-- never <p>c")] == ["a < b"]
    assert html_text.blocks("<script>x")[:] == []
    assert len(html_text.blocks("<p>" * 3000 + "x" + "<b>" * 3000)) == 1


def test_blocks_keep_all_but_raw_elements():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    assert texts("<p>a<svg width='1'/>b<p>c<math/>d") == ["a", "b", "cd"]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><xmp><b>&amp;</xmp><object data='o'>c</object><noscript>d</noscript>") == ["a x=2 b", "<b>&amp;", "c", "d"]
    assert texts("<p>a<textarea>b<p>c<iframe src=i>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<script src=s />b<style>c</style>d<script>e") == ["a", "b", "d"]
    deep = html_text.blocks("<main><div id=a>" + "<div>" * 300 + "x" + "</div>" * 300 + "<p>y")
    assert [b.path for b in deep][1] == ["main", "div", "p"]


def test_vectors_read_the_whole_block():
    start, rest = ["start"] * 30, [f"rest{k}" for k in range(40)]
    one, two = (html_text.vectors(html_text.blocks(f"<p>{' '.join(words)}.</p>"))[0] for words in (start + rest, start + ["other0"] * 40))
    words = slice(html_text.TAGS + html_text.NAMES, html_text.TAGS + html_text.NAMES + html_text.WORDS)
    assert (one[words] > 0).sum() > 10 and (two[words] > 0).sum() <= 3


def test_labels_on_pages_never_seen():
    m = dict(html_text.default_model())
    right = whole = 0
    for page, y in html_text.training_pages(150, seed=1234):
        found = html_text.blocks(page)
        assert len(found) == len(y)
        p = html_text.label(m, [html_text.vectors(found)])[0]
        right += int(((p >= 0.5) == np.array(y, bool)).sum())
        whole += len(y)
    assert right / whole > 0.97


def test_pages_on_edges(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>T&eacute;</h1><p>One  two.</p><p>Three.</p></article><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page), (3, "w", "plain text"), (4, "x", "<p>" + "long " * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.url or "") for r in found) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert all(r.n_chars == len(r.text) for r in found)
    assert [r.text for r in found if r.page_id == 1] == ["Té One two. Three."] * 2
    assert [r.text for r in found if r.page_id in (2, None)] == ["", ""]
    assert html_text.extract(df.where("page_id < 0")).count() == 0


def test_lstm_gradients():
    rng = np.random.default_rng(2)
    x, mask = rng.normal(size=(2, 4, 3)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    w, u, b = rng.normal(size=(3, 8)), rng.normal(size=(2, 8)), rng.normal(size=8)
    loss = lambda: float((html_text._scan(x, mask, w, u, b)[0] * mask[:, :, None]).sum())
    _, kept = html_text._scan(x, mask, w, u, b)
    dw, du, db = html_text._scan_back(x, u, kept, np.repeat(mask[:, :, None], 2, 2).astype(float))
    for value, grad in ((w, dw), (u, du), (b, db)):
        at = tuple(1 for _ in value.shape)
        value[at] += 1e-6
        up = loss()
        value[at] -= 2e-6
        down = loss()
        value[at] += 1e-6
        assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


# -- sentence pieces ----------------------------------------------------------------------------------------------


def test_pieces_round_trip(edge_docs, edge_rows, no_docs):
    for dropout in (0.0, 0.3):
        rows = sentence_pieces.decode(sentence_pieces.encode(edge_docs, dropout)).collect()
        assert len(rows) == len(edge_rows) and all(r.decoded == r.text for r in rows)
    assert sentence_pieces.encode(no_docs).count() == 0
    again = sentence_pieces.encode(edge_docs, 0.3)
    same = {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()): r.ids for r in again.collect()}
    for r in sentence_pieces.encode(edge_docs.coalesce(1), 0.3).collect():
        assert same[r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()] == r.ids


def pieces_of(texts, dropout, seed=1, chains=None):
    chains = chains or sentence_pieces.Chains(sentence_pieces.pieces(sentence_pieces.default_model()), dropout)
    values, ends = sentence_pieces.encode_texts(chains, texts, seed)
    return [values[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_without_dropout_the_ids_are_the_models_own():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    texts = [prose(k, 60) for k in range(5)] + ["Hello world, naïve café 123!", "x" * 90]
    assert pieces_of(texts, 0.0) == [own.encode(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab th▁é\U0001f600e\n", max_size=60), min_size=1, max_size=6), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_many_at_a_time_is_as_one_by_one(texts, dropout):
    p = sentence_pieces.pieces(sentence_pieces.default_model())
    expected = []
    for t in texts:
        words = sentence_pieces.words_of(t)
        keys = sentence_pieces.keys_of(t, len(words), 5).tolist()
        expected.append(np.frombuffer(b"".join(sentence_pieces.encode_long(p, w, k, dropout) for w, k in zip(words, keys, strict=True)), np.int32).tolist())
    assert pieces_of(texts, dropout, 5) == expected


def test_prose_one_by_one_and_with_a_small_memory(monkeypatch):
    p = sentence_pieces.pieces(sentence_pieces.default_model())
    texts = [prose(k, 300) for k in range(8)] + [None, ""]
    expected = []
    for t in texts:
        words = sentence_pieces.words_of(t)
        keys = sentence_pieces.keys_of(t or "", len(words), 5).tolist()
        expected.append([i for w, k in zip(words, keys, strict=True) for i in np.frombuffer(sentence_pieces.encode_long(p, w, k, 0.2), np.int32).tolist()])
    assert pieces_of(texts, 0.2, 5) == expected
    monkeypatch.setattr(sentence_pieces, "CACHE", 10)
    monkeypatch.setattr(sentence_pieces, "AT_ONCE", 7)
    assert pieces_of(texts, 0.2, 5) == expected


def test_each_occurrence_draws_for_itself():
    text = " ".join(["unbelievable"] * 4000)
    p = sentence_pieces.pieces(sentence_pieces.default_model())
    ids = pieces_of([text], 0.1)[0]
    assert sentence_pieces.decode_ids(p, np.array(ids)) == text
    chains = sentence_pieces.Chains(p, 0.1)
    last = chains.walk([" unbelievable"] * 4000, sentence_pieces.keys_of(text, 4000, 1))
    candidates = int(chains.size.data[0])
    assert len(set(last.tolist())) > 8 and abs((last == 0).mean() - 0.9**candidates) < 0.04


def test_seeds_vary_segmentations():
    p = sentence_pieces.pieces(sentence_pieces.default_model())
    text = prose(3, 200)
    made = {tuple(pieces_of([text], 0.2, seed)[0]) for seed in range(4)}
    assert len(made) == 4
    assert {sentence_pieces.decode_ids(p, np.array(x)) for x in made} == {text}


# -- licences -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return licences.train([prose(k, 30) for k in range(300)])


NOTICES = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}


def test_notices_and_prose(spark, model, no_docs):
    docs = [(k, f"{prose(k)}\n{n}") for k, n in enumerate(NOTICES)] + [(10, prose(10)), (11, None), (12, ""), (13, "He has a license to drive the program."), (0, f"{prose(0)}\n{list(NOTICES)[0]}")]
    rows = {r.doc_id: r for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert [rows[k].families for k in range(4)] == list(NOTICES.values())
    assert all(rows[k].families == "" and rows[k].n_licensed == 0 for k in (10, 11, 12, 13))
    assert rows[0].n_paragraphs == 2 and rows[11].n_paragraphs == 0
    assert licences.scan(no_docs, model).count() == 0


def test_columns_agree_with_the_plain_model(spark, model):
    lines = [*NOTICES, *(" ".join(t.split()[:k]) for ts in licences.TEMPLATES.values() for t in ts for k in (4, 9, 40)), prose(1, 20)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    found = {r.doc_id: r for r in licences.classify(df, model).collect()}
    for k, line in enumerate(lines):
        p = model.probabilities(line)
        best = int(p.argmax())
        assert (k in found) == (best > 0)
        if best:
            assert found[k].family == licences.FAMILIES[best] and found[k].probability == pytest.approx(p[best], rel=1e-6)
            grams = set(licences.grams_of(line))
            shared = grams & {g for t in licences.TEMPLATES[found[k].family] for g in licences.grams_of(t)}
            assert found[k].overlap == pytest.approx(len(shared) / len(grams))


def test_licence_plans_hold_no_python(edge_docs, model):
    plan = licences.scan(edge_docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
