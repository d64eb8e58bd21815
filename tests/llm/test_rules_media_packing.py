import hashlib
import io
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftscan.llm import media, packing, quality_rules

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = Counter(zip(words, words[1:], words[2:]))
    marked = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if three[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x0b\x85 |", max_size=60))
def test_counts_match_brute_force(text):
    assert quality_rules.statistics(text.encode())[:5] == brute_counts(text)


def test_rules_on_edges(edge_docs, edge_rows, no_docs):
    rows = quality_rules.rules(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    expected = Counter((k, *brute_counts(t), n < 50 or 100 * r > 50 * n) for k, t, *_ in edge_rows for n, _, _, _, r in [brute_counts(t)])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == expected
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.rules(no_docs).count() == 0


def test_outliers_go_and_copies_do_not_shift_the_estimate(spark):
    clean = [(k, prose(100 + k % 80, 150), "en", "s") for k in range(160)]
    copies = [(1000 + k, prose(7, 150), "en", "s") for k in range(300)]
    junk = [(2000 + k, prose(500 + k, 150).replace(" ", "%%% ### "), "en", "s") for k in range(20)] + [(3000 + k, prose(600 + k, 150).upper().replace(" ", "!! "), "en", "s") for k in range(20)]
    df = spark.createDataFrame(clean + copies + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.rules(df).where("kept").collect()}
    assert {r[0] for r in clean + copies} <= kept | {r[0] for r in clean + copies if brute_counts(r[1])[4] * 2 > 150}
    assert not kept & {r[0] for r in junk}
    stayed = quality_rules.stage(spark, df, "")
    assert stayed.columns == df.columns and {r.doc_id for r in stayed.collect()} == kept


def test_repeated_lines_alone_reject(spark):
    clean = [(k, prose(k, 120).replace(". ", ".\n"), "en", "a") for k in range(300)]
    junk = []
    for k in range(300, 306):
        own = [prose(9 * k + j, 9).replace("\n", " ") for j in range(14)]
        junk.append((k, "\n".join(f"{line}\nRead more\nGo back" for line in own), "en", "a"))
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in quality_rules.rules(df).collect()}
    assert not any(rows[k].kept for k in range(300, 306))
    assert not any(rows[k].base_failed for k in range(300, 306))
    assert sum(rows[k].kept for k in range(300)) >= 297


def brute_mcd(x, share, seed=1, starts=60):
    """The subset of least determinant by many random starts, each led to convergence; then weighed anew."""
    rng = np.random.default_rng(seed)
    h, best = int(np.ceil(share * len(x))), (np.inf, None, None)
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(starts):
        at = rng.choice(len(x), x.shape[1] + 2, replace=False)
        for _ in range(60):
            m, c = x[at].mean(0), np.cov(x[at].T, bias=True) + 1e-6 * np.eye(x.shape[1])
            was, at = at, np.argsort(distance(m, c))[:h]
            if len(was) == h and set(was) == set(at):
                break
        best = min(best, (np.linalg.slogdet(c)[1], tuple(m), c), key=lambda b: b[0])
    d2 = distance(np.array(best[1]), best[2])
    core = x[d2 <= max(np.median(d2) / quality_rules.CHI2_MEDIAN, 1.0) * quality_rules.CHI2_975]
    return distance(core.mean(0), np.cov(core.T, bias=True))


def test_estimates_match_brute_force(spark):
    rng = np.random.default_rng(4)
    d, groups = 9, {}
    for g in range(2):
        mix = rng.normal(size=(d, d)) / 3 + np.eye(d)
        x = rng.normal(size=(400, d)) @ mix + 3 * g
        x[:50] = rng.normal(size=(50, d)) * 0.3 + 14 + np.arange(d)
        groups[f"l{g}"] = x
    names = quality_rules.NAMES
    rows = [(g, "s", *map(float, v)) for g, x in groups.items() for v in x]
    vectors = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} double" for c in names))
    for r in quality_rules.fit(vectors, ["lang", "source"], names, [1e-3] * d).collect():
        x = groups[r.lang]
        off = x - np.array(r.m)
        ours = np.einsum("ij,jk,ik->i", off, np.array(r.inv).reshape(d, d), off)
        theirs = brute_mcd(x, quality_rules.SUPPORT)
        assert ((ours > quality_rules.CUTOFF) == (theirs > quality_rules.CUTOFF)).all() and (ours[:50] > quality_rules.CUTOFF).all()
        assert np.corrcoef(ours, theirs)[0, 1] > 0.999


def test_quantiles_of_bins(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in (None, "a") for v in np.concatenate([rng.normal(size=500), rng.exponential(1e6, 500)])]
    got = {r.g: r.q for r in quality_rules.quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 0.75).collect()}
    for g in (None, "a"):
        exact = np.sort([v for k, v in rows if k == g])[749]
        assert abs(got[g] / exact - 1) < 2e-3


def test_stage_keeps_clashing_columns(spark, edge_docs):
    assert quality_rules.stage(spark, edge_docs, "").columns == edge_docs.columns


# -- media --------------------------------------------------------------------------------------------------------


def test_text_survives_storage(edge_docs, edge_rows, no_docs):
    rows = media.digests(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    seen = {}
    for r in rows:
        seen.setdefault((r.doc_id, r.n_bytes), r)
    for k, t, *_ in edge_rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = seen[k, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.store_text(raw)[1]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert re.fullmatch("[0-9a-f]{16}", r.feature)
    assert media.digests(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_pictures_round_trip(h, w, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()
    for th, tw in ((h, w), (3, 4), (12, 5)):
        small = media.area_resize(image, th, tw)
        assert small.shape == (th, tw) and abs(small.mean() - image.mean()) < 1e-9
    assert np.allclose(media.area_resize(image, h, w), image)


def test_kinds_of_pictures(spark):
    assert media.decode(b"P1 # c\n2 2\n1 0\n0 1").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n9 1\n\x80\x00").tolist() == [[0] + [255] * 8]
    assert media.decode(b"P2\n2 1\n9\n3 9").tolist() == [[3, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    head = lambda bits, size, h: struct.pack("<2sIHHI", b"BM", 0, 0, 0, size) + struct.pack("<IiiHHIIiiII", 40, 2, h, 1, bits, 0, 0, 0, 0, 2 if bits == 1 else 0, 0)
    assert media.decode(head(24, 54, 1) + bytes([3, 2, 1, 6, 5, 4, 0, 0])).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode(head(24, 54, -1) + bytes([3, 2, 1, 6, 5, 4, 0, 0])).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode(head(1, 62, 1) + bytes([0, 0, 0, 0, 255, 255, 255, 0]) + bytes([0x40, 0, 0, 0])).tolist() == [[0, 255]]
    rows = media.features(spark.createDataFrame([(b"junk",), (None,), (b"P5\n2 2\n255\n",), (media.encode_pgm(np.eye(9, 8, dtype=np.uint8)),)], "media binary")).collect()
    assert [r.dhash is None for r in rows] == [True, True, True, False]
    assert np.load(io.BytesIO(rows[3].tile)).shape == (32, 32)


def test_samples_are_scaled_by_their_maximum(spark):
    """Tiles of pictures with maxima other than 255, and pictures whose numbers no array can hold."""
    wide = b"P5\n32 32\n65535\n" + np.full((32, 32), 32768, ">u2").tobytes()
    small = b"P2\n32 32\n15\n" + b" ".join([b"15"] * 1024)
    bad = [b"P2 1 1 255 99999999999999999999999999", b"P1 2 1 67", b"P2 1 1 15 16", b"P2 1 1 15 -1", b"P1 1 99999999999999999999 1"]
    rows = media.features(spark.createDataFrame([(x,) for x in [wide, small, *bad]], "media binary")).collect()
    assert [int(np.load(io.BytesIO(r.tile)).max()) for r in rows[:2]] == [128, 255]
    assert all(r.dhash is None and r.tile is None for r in rows[2:])


# -- packing ------------------------------------------------------------------------------------------------------


def check_packing(rows, docs, window, ids_of):
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
        assert 0 < r.length <= window
    whole = Counter()
    for k, t in docs:
        whole[k] += len(ids_of(t))
    assert by_doc == whole
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_every_id_lies_in_one_piece(edge_docs, edge_rows, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_vocabulary())
    ids_of = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 0]
    rows = packing.pack(edge_docs).collect()
    docs = [(k, t) for k, t, *_ in edge_rows]
    check_packing(rows, docs, 1024, ids_of)
    pieces = sorted((r.doc_id if r.doc_id is not None else -1, r.start, bytes(r.ids)) for r in rows)
    wanted = sorted((k if k is not None else -1, a, np.array(ids[a : a + 1024], "<u4").tobytes()) for k, t in docs for ids in [ids_of(t)] for a in range(0, len(ids), 1024))
    assert pieces == wanted
    assert packing.pack(no_docs).count() == 0
    small = packing.pack(edge_docs, window=64).collect()
    check_packing(small, docs, 64, ids_of)


def test_digests_follow_from_ids(edge_docs):
    a = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.digests(edge_docs).collect()}
    assert a == {(r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in packing.pack(edge_docs).collect()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.integers(1, 50))
def test_plans_use_each_length_as_often_as_it_occurs(lengths, times):
    histogram = np.bincount(lengths * times, minlength=33).astype(np.int64)
    used = Counter()
    for pattern, n in packing.plan(histogram, 32):
        assert n > 0 and sum(pattern) <= 32
        for v in pattern:
            used[v] += n
    assert used == Counter(lengths * times)


def test_all_triples_are_enumerated():
    lengths = np.arange(1, 65)
    found = packing.combinations(lengths, np.ones(64, np.int64), 64)
    assert set(found) == {(64,)} | {(64 - b, b) for b in range(1, 33)} | {(64 - b - c, b, c) for c in range(1, 22) for b in range(c, (64 - c) // 2 + 1)}


def test_the_stage_keeps_the_ids(edge_docs, no_docs):
    rows = packing.stage(edge_docs.sparkSession, edge_docs, "").collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in edge_docs.collect()}
    assert packing.stage(edge_docs.sparkSession, no_docs, "").count() == 0


def test_plans_leave_little_room():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 1025, 200_000), minlength=1025)
    patterns = packing.plan(histogram)
    room = sum(n for _, n in patterns) * 1024
    assert (histogram * np.arange(1025)).sum() / room > 0.995


def test_least_squares_is_exact_where_it_can_be():
    columns = [(3, 1), (2, 2), (2, 1, 1)]
    target = np.zeros(5)
    for column, n in zip(columns, (4, 3, 5)):
        for v in column:
            target[v] += n
    assert np.allclose(packing.nnls(columns, target, 2000, 1e-12), [4, 3, 5], atol=1e-3)


@pytest.mark.parametrize("text", ["it's 12 <|endoftext|> é  \n\n x", "", "a" * 700])
def test_ids_are_those_of_the_tokenizers_file(text):
    from tokenizers import Tokenizer

    assert packing.encoder(packing.default_vocabulary())(text) == Tokenizer.from_file(packing.default_vocabulary()).encode(text, add_special_tokens=False).ids
