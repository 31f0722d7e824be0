"""Corpus operators without Spark: each against a plain form of what it computes."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import common, embedding_dedup, language_id, mixing, near_dedup, neighbours, packing, pii, range_coder, suffix_dedup


def split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    (_, raw, off), = common.text_parts(pa.array(texts, pa.string()), 1 << 30)
    return raw, off


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tçß€𝄞", max_size=30)), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_word_bounds(texts):
    raw, off = split(texts)
    starts, stops, row = common.word_bounds(raw, off)
    got = [(int(r), bytes(raw[a:b])) for r, a, b in zip(row, starts, stops, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^ \t\n\r\f\v]+", (t or "").encode())]


def test_word_hashes_tell_words_apart():
    words = sorted({"".join(p) for n in range(1, 6) for p in itertools.product("abc", repeat=n)} | {"x" * n for n in range(1, 2100, 7)})
    raw, off = split([" ".join(words)])
    starts, stops, _ = common.word_bounds(raw, off)
    assert len(set(common.word_hashes(raw, starts, stops).tolist())) == len(words)


def test_text_parts_cuts_between_rows():
    texts = ["a" * 10, None, "", "b" * 50, "c"]
    parts = list(common.text_parts(pa.chunked_array([pa.array(texts[:2]), pa.array(texts[2:])]), 12))
    back = [bytes(raw[off[i] : off[i + 1]]).decode() for _, raw, off in parts for i in range(len(off) - 1)]
    assert back == [t or "" for t in texts]
    assert [p[0] for p in parts] == [0, 3, 4]


# --- packing ------------------------------------------------------------------------------------


def padding(hist, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in hist)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_boundaries_are_optimal(hist, k):
    hist = sorted(hist.items())
    got = packing.optimal_boundaries(hist, k)
    top = hist[-1][0]
    best = min(padding(hist, [*c, top]) for m in range(min(k, len(hist))) for c in itertools.combinations([n for n, _ in hist[:-1]], m))
    assert len(got) <= k and got == sorted(set(got)) and got[-1] == top
    assert padding(hist, got) == best


def test_no_lengths_no_boundaries():
    assert packing.optimal_boundaries([], 4) == []


# --- near duplicates ------------------------------------------------------------------------------


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    elem = common.mix64(np.arange(1, 401, dtype=np.uint64))
    x, y = rng.uniform(0.1, 9, 400), rng.uniform(0.1, 9, 400)
    y[:250] = x[:250]
    sig = near_dedup.dart_minhash(np.concatenate([elem, elem]), np.concatenate([x, y]), np.array([400, 400]), 4000)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4000)


def test_dart_signatures_do_not_depend_on_company():
    elem = common.mix64(np.arange(1, 50, dtype=np.uint64))
    alone = near_dedup.dart_minhash(elem[:1], np.ones(1), np.array([1]), 120)
    many = near_dedup.dart_minhash(np.concatenate([elem[:1], elem]), np.ones(50), np.array([1, 0, 49]), 120)
    assert (alone[0] == many[0]).all() and not many[1].any() and (many[2] != 0).all()


def test_shingles():
    raw, off = split(["a b c d e f", "a b", None, "a b c d e f a b c d e f"])
    elem, count, sizes = near_dedup.shingles(raw, off)
    assert sizes.tolist() == [2, 1, 0, 6]
    assert sorted(count[3:].tolist()) == [1, 1, 1, 1, 2, 2]


@pytest.mark.parametrize("seed", range(6))
def test_cross_pairs_connect_what_links_connect(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 5000, 40)
    items = [np.unique(np.where(rng.random(40) < rng.uniform(0, 0.3), rng.integers(0, 5000, 40), base)).astype(np.int32) for _ in range(40)]
    comp = rng.integers(0, 1 << 40, 40)
    comp[:9] = comp[0]
    got = near_dedup.cross_pairs(items, comp, 80)
    forest = embedding_dedup._Forest(40)
    for i in range(9):
        forest.join(0, i)
    want = embedding_dedup._Forest(40)
    for i in range(40):
        if i < 9:
            want.join(0, i)
        for j in range(i):
            common = len(np.intersect1d(items[i], items[j]))
            if common * 180 >= (len(items[i]) + len(items[j])) * 80:
                want.join(i, j)
    for i, j in got:
        assert forest.join(i, j)
    assert [forest.root(i) for i in range(40)] == [want.root(i) for i in range(40)]


# --- language -------------------------------------------------------------------------------------


def test_ngrams_of_long_texts_equal_those_of_their_words(monkeypatch):
    text = "Ab cde, f-g " * 50
    whole, letters = language_id.vectors([text], None)
    monkeypatch.setattr(language_id, "_PIECE", 17)
    cut, again = language_id.vectors([text, ""], None)
    assert (whole[0] == cut[0]).all() and letters[0] == again[0] == 350 and not cut[1].any()


def test_empty_model_knows_nothing():
    model = language_id.Model([], np.ones(language_id.DIMS), np.zeros((0, language_id.DIMS)), np.zeros(0, int), np.zeros((0, 24)))
    assert model.predict(["hello"])[0] == ["und"]


# --- suffix dedup -----------------------------------------------------------------------------------


def brute_windows(texts, length):
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    return [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


@pytest.mark.parametrize("seed", range(8))
def test_column_wise_windows(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(60))
    strings, offset, group = [], [], []
    for g in range(4):
        for _ in range(rng.randrange(1, 7)):
            s = bytearray(base)
            for _ in range(rng.randrange(4)):
                s[rng.randrange(60)] = rng.choice(b"abc")
            a, b = rng.randrange(0, 20), rng.randrange(41, 61)
            strings.append(bytes(s[a:b]))
            offset.append(30 - a)
            group.append(g)
    strings = [bytes(x) for x in strings]
    length = 15
    got = suffix_dedup.repeated_windows(strings, np.array(offset), np.array(group), length)
    for i, flags in enumerate(got):
        for w, flag in enumerate(flags):
            c = w - offset[i]
            text = strings[i][w : w + length]
            want = any(j != i and group[j] == group[i] and c + offset[j] >= 0 and strings[j][c + offset[j] : c + offset[j] + length] == text for j in range(len(strings)))
            assert flag == want


@pytest.mark.parametrize("piece", [1 << 20, 37])
def test_minimiser_strings_hold_each_window_once(monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 5, 19, 20, 21, 200, 90)]
    raw, off = split(texts)
    row, start, n, o, h = suffix_dedup.minimiser_strings(raw, off, 20, 8)
    windows = sorted((int(r), int(s) + k) for r, s, m in zip(row, start, n, strict=True) for k in range(m - 19))
    assert windows == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 19)]
    owner = {}
    for r, s, m, at, x in zip(row, start, n, o, h, strict=True):
        for k in range(m - 19):
            text = texts[r][s + k : s + k + 20]
            assert owner.setdefault(text, (x, at - k)) == (x, at - k)


def test_spans_merge():
    s, e = suffix_dedup._merge(np.array([0, 2, 10, 15]), np.array([5, 9, 15, 20]))
    assert s.tolist() == [0, 10] and e.tolist() == [9, 20]


# --- vectors --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_search_tile_is_exact(seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(300, 7)) * rng.uniform(0.1, 5, (300, 1))
    c[50:90] = c[10]  # ties
    ids = rng.permutation(1000)[:300]
    got = neighbours.search_tile(ids[:20], c[:20], ids, c, 12)
    for i in range(20):
        score = neighbours.dots(np.repeat(c[i : i + 1], 300, 0), c)
        want = sorted((-s, int(j)) for s, j in zip(score, ids, strict=True) if j != ids[i])[:12]
        assert [x[1] for x in got[i]] == [x[1] for x in want]
        assert [-x[0] for x in got[i]] == [-x[0] for x in want]


def test_count_is_calibrated():
    t = embedding_dedup.needed(24, 0.99999)
    rng = np.random.default_rng(0)
    hits = (np.abs(rng.normal(size=(200_000, 24))) <= 2).sum(1)
    assert (hits >= t).mean() > 0.9999 and 10 < t < 20


@pytest.mark.parametrize("same", [True, False])
def test_tile_links(same, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "_SIDE", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 32))[rng.integers(0, 12, 70)] + rng.normal(size=(70, 32)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = rng.integers(1, 4, 70)
    first = np.arange(70) if same else np.arange(30)
    second = first if same else np.arange(30, 70)
    degree, edges = embedding_dedup.tile_links(x, first, second, w, 0.95, embedding_dedup.needed(24, 0.99999))
    link = (x @ x.T >= 0.95) & ~np.eye(70, dtype=bool)
    if not same:
        link[:30, :30] = link[30:, 30:] = False
    assert (degree == (link * w[None, :]).sum(1)).all()
    forest = embedding_dedup._Forest(70)
    for i, j in edges:
        assert link[i, j] and forest.join(i, j)
    assert all(forest.root(i) == forest.root(j) for i, j in zip(*np.nonzero(link), strict=True))


# --- personal data -----------------------------------------------------------------------------------------

PLAIN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= sum(c.isdigit() for c in s) <= 19 and pii._luhn(re.sub("[^0-9]", "", s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= sum(c.isdigit() for c in s) <= 15),
]


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m.group())]


@given(st.text(alphabet="a@.-1290+ (é", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_known():
    text = "mail Jo.X@ex.org, card 4111 1111 1111 1111 or 4111-1111-1111-1112, ip 10.0.0.255 and 10.0.0.256, call +49 (0)30 1234567"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)] == [("email", "Jo.X@ex.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (0)30 1234567")]
    assert pii._luhn("79927398713") and not pii._luhn("79927398710")


def test_base_spans_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "@" * 100_000, "a@b" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 150_000):
        pii.base_spans(text)


def test_exposed_terms():
    text = "alpha beta ab gamma x@y.zz delta" + " " * 500 + "omega last"
    got = [t for *_, t in pii.exposed(text, pii.base_spans(text), 2)]
    assert got == ["beta", "gamma", "delta", "omega"]
    assert pii.redact(text, [(0, 20, 26)], [(0, 5, True), (6, 10, False)]).startswith(" [TERM] ab gamma [EMAIL] delta")


def test_sparse_lengths_take_the_nearest_floor():
    bins = np.array([4] * 20 + [9] * 20 + [14] * 3)
    cos = np.array([0.1] * 20 + [0.5] * 20 + [0.6, 0.7, 0.8])
    low = language_id.floors(cos, bins)
    assert np.allclose(low[[4, 5]], 0.065) and np.allclose(low[[0, 3]], 0.05) and np.allclose(low[[8, 9, 14, 20]], 0.325)
    assert set(language_id.floors(cos[:3], bins[:3])) == {0.05}


# --- coder ---------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 65535), max_size=200), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(ids, block):
    x = np.array(ids, np.int64)
    assert (range_coder.decode(range_coder.encode(x, block)) == x).all()


@pytest.mark.parametrize("make", [lambda r: r.integers(0, 49408, 9000), lambda r: r.zipf(1.2, 9000) % 49408, lambda r: np.zeros(9000, int), lambda r: np.full(9000, 65535), lambda r: np.tile(r.integers(0, 49408, 40), 225)])
def test_coder_round_trip_long(make):
    x = make(np.random.default_rng(5))
    blob = range_coder.encode(x)
    assert (range_coder.decode(blob) == x).all() and len(blob) < 2.3 * len(x) + 200


def test_coder_learns():
    x = np.tile(np.random.default_rng(5).integers(0, 49408, 40), 50)
    assert len(range_coder.encode(x)) < 0.5 * len(x)


def test_coder_finds_damage():
    blob = bytearray(range_coder.encode(np.arange(3000)))
    for at in (0, 12, 20, 40, len(blob) - 300):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode(bytes(bad))
    with pytest.raises(ValueError):
        range_coder.decode(bytes(blob[:-1]))
    with pytest.raises(ValueError):
        range_coder.encode(np.array([range_coder.MOST_IDS]))


def test_coder_takes_large_alphabets_and_several_blocks():
    x = np.random.default_rng(6).zipf(1.3, 30_000) * 7 % range_coder.MOST_IDS
    for block in (1000, 7000, range_coder.BLOCK):
        assert (range_coder.decode(range_coder.encode(x, block)) == x).all()


def test_coder_beats_static_order_0_and_zlib():
    """On the ids of the given documents, by the mix of all three orders; without the lists of orders 1 and 2 it needs more."""
    import public_tokenizers
    import pyarrow.parquet as pq
    import zlib

    from tidelog.llm import token_files

    text = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")["text"]
    coder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.concatenate([coder.encode(raw, off)[0] for _, raw, off in common.text_parts(text)])[: 1 << 20]
    blob = range_coder.encode(ids)
    assert (range_coder.decode(blob) == ids).all()
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    assert len(blob) < -(share * np.log2(share)).sum() / 8 * len(ids) and len(blob) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    keep = range_coder._Followers.learn
    try:
        range_coder._Followers.learn = lambda *_: None
        assert len(range_coder.encode(ids)) > 1.03 * len(blob)
    finally:
        range_coder._Followers.learn = keep


def test_words_are_encoded_as_the_library_does():
    """Real texts, and words of every length about the table's key of 15 bytes, by words and by whole texts, with a table that is emptied often."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from tidelog.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    texts += ["", " ", "x", "it's İstanbul's 3rd ﬁne-day", "é" * 9, "don't,we'll", "a\x00b a\x00", "<|endoftext|>", "x<|startoftext|>y", *("z" * k + "," * j for k in range(12, 20) for j in range(3))]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered in (50, 100_000):
        coder = token_files.Encoder(path, remembered=remembered)
        assert coder.by_words
        for most in (200, 1 << 20):
            at = 0
            for _, raw, off in common.text_parts(pa.array(texts), most=most):
                ids, n = coder.encode(raw, off)
                for part in np.split(ids, np.cumsum(n)[:-1]):
                    assert part.tolist() == want[at], texts[at]
                    at += 1
            assert at == len(texts)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidelog.llm import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, coder = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["two  words\nand a line ", "", " é"]
    (_, raw, off), = common.text_parts(pa.array(texts))
    ids, n = coder.encode(raw, off)
    assert not coder.by_words and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


# --- mixing ---------------------------------------------------------------------------------------------------


def test_bags_have_unit_length():
    (lo, ids, w, size), = mixing.bags(pa.array(["a b a", None, "c"]))
    assert lo == 0 and size.tolist() == [2, 0, 1] and abs((w[:2] ** 2).sum() - 1) < 1e-12
