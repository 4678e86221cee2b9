"""Algorithms against brute force, without Spark."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import chaining, packing, pieces, quality_rules, simhash, substring_exact, toxicity
from lodestar.llm.gsaca import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(t):
    assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_of_runs():
    for t in ([1] * 50, [1, 2] * 30, list(range(40)), list(range(40))[::-1], [5] + [1] * 20 + [5]):
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_agreement_is_that_of_all_pairs():
    rng = random.Random(3)
    reach, gram = substring_exact.REACH, substring_exact.GRAM

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    groups = []
    for _ in range(60):
        left, right = bytes(rng.choices(b"ab", k=reach)), bytes(rng.choices(b"ab", k=reach))
        members = set()
        for _ in range(rng.randint(2, 9)):
            i, j = rng.randint(0, reach), rng.randint(0, reach)
            x = left[:i] + bytes(rng.choices(b"abc", k=reach - i))
            y = right[:j] + bytes(rng.choices(b"abc", k=reach - j))
            members.add((x[: rng.choice([reach, reach, 7])], y[: rng.choice([reach, reach, 60])]))
        groups.append(sorted(members))
    got = substring_exact.agreement(groups)
    for g, res in zip(groups, got, strict=True):
        for a, (x, y) in enumerate(g):
            ok = [(common(x, g[b][0]), common(y, g[b][1])) for b in range(len(g)) if b != a]
            ok = [p for p in ok if sum(p) >= reach]
            want = (max(p[0] for p in ok), max(p[1] for p in ok) + gram) if ok else (0, 0)
            assert res[a] == want


def test_anchors_of_equal_strings_agree():
    rng = random.Random(5)
    shared = bytes(rng.choices(range(97, 110), k=200))
    found = []
    for _ in range(5):
        pre = bytes(rng.choices(range(97, 110), k=rng.randint(0, 900)))
        data = pre + shared + bytes(rng.choices(range(97, 110), k=300))
        p, h = substring_exact.anchors(data)
        found.append({(int(q) - len(pre), int(x)) for q, x in zip(p, h, strict=True)})
        p2, h2 = substring_exact.anchors(data, block=256)
        assert (p == p2).all() and (h == h2).all()
    assert any(0 <= q <= substring_exact.REACH for q, _ in set.intersection(*found))


def test_fingerprint_by_definition():
    import xxhash

    for t in ("", " \n", "One", "one two", "A b c d A b c d", "x\ty\x0bz w \x85 q", "é É ß words here"):
        w = [x for x in __import__("re").split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())) if x]
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(t) == want
    assert simhash.fingerprint(None) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 30))
def test_open_bins(lengths, limit):
    bins = packing.OpenBins(20, limit)
    fill = {}
    for n in lengths:
        b, o = bins.place(n)
        assert fill.get(b, 0) == o
        fill[b] = o + n
        assert fill[b] <= 20
        assert bins.open <= limit
    assert sorted(fill) == list(range(len(fill)))


def test_best_fit_takes_the_tightest_and_the_fullest_closes():
    bins = packing.OpenBins(10, 2)
    assert bins.place(7) == (0, 0)
    assert bins.place(5) == (1, 0)
    assert bins.place(3) == (0, 7)
    assert bins.place(9) == (2, 0)
    assert bins.place(8) == (3, 0)  # bin 2 is the fullest of the two open ones and closes
    assert bins.place(1) == (3, 8)
    assert bins.place(5) == (1, 5)


def _path(name):
    P = pytest.importorskip("public_tokenizers")
    return str(P.path(name))


TEXTS = ["", " ", "Hello, World's 42nd day!", "naïve  café\n\nDon't we'll", "Σίσυφος ΟΔΟΣ", "é  x y", "a\x1cb", "<|endoftext|> tail", "<|EndOfText|>", "日本語 text 😀!!", "x" * 3000, "½ ² Ⅷ ٣", "re've'll 's"]


def test_chunk_tokenizer_is_the_library():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = _path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(4)
    signs = [*map(chr, range(0x250)), *"\u0301\u0345\u017f\ufb01\u212b\uac00\u1100\u1161\u2003\u3000\u200b\ufeff\u0085", "'s", "'LL", "<|endoftext|>", "<|START", "Σς", "the", *" " * 40]
    texts = [*TEXTS, "\x1b[0m red", "--\x00--", "a\x00b c", *["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(3000)]]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}a B{chr(c)}" for c in range(0x3100)]
    for size in (1_000_000, 3):
        tok = packing.ChunkTokenizer(path, max_chunks=size)
        for at in (0, 0, len(texts) // 2):
            data, cut = tok.encode(pa.array(texts[at:]))
            for t, i, j in zip(texts[at:], cut, cut[1:], strict=False):
                assert data[i:j].tolist() == whole.encode(t, add_special_tokens=False).ids, t
        assert len(tok.chunks) == len(tok.values) <= size
    assert tok.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_pieces_are_the_unigram_optimum():
    """The library's own Viterbi over the same pieces and scores: the model file with its type set to unigram."""
    import sentencepiece

    path = _path("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    spec = raw.index(b"\x12\x06tok_v0\x18\x02")
    uni = raw[: spec + 9] + b"\x01" + raw[spec + 10 :]
    sp = sentencepiece.SentencePieceProcessor(model_proto=uni)
    m = pieces.PieceModel(path)
    for t in ["Hello world", "  two  spaces", "naïve café ½ 😀 日本語", "tab\tand\nnew line", "internationalization of straightforward things", "x" * 50, " ", "a▁b", "ééé zzz qqq", "�"]:
        ids = m.encode(t)
        ref = sp.encode(t)
        value = lambda i: sum(m.score[x] for x in i if x not in m.bytes.values())
        assert ids == ref or abs(value(ids) - value(ref)) < 1e-3, (t, ids, ref)
        assert m.decode(ids) == t.replace("▁", " ")


def test_viterbi_against_all_segmentations():
    m = pieces.PieceModel(_path("piece_bpe_32k.model"))

    def best(t):
        top = [0.0]
        for e in range(1, len(t) + 1):
            c = [top[s] + m.score[m.pieces[t[s:e]]] for s in range(e) if t[s:e] in m.pieces]
            if t[e - 1] not in m.pieces:
                c.append(top[e - 1] + m.unknown)
            top.append(max(c))
        return top[-1]

    rng = random.Random(2)
    for _ in range(200):
        t = "▁" + "".join(rng.choices("abcdetion s\n😀é", k=rng.randint(1, 14))).replace(" ", "▁")
        ids = m.viterbi(t)
        unk = sum(ch not in m.pieces for ch in t)
        assert sum(m.score[i] for i in ids if i not in m.bytes.values()) + unk * m.unknown == best(t)


def test_chains_are_optimal():
    rng = random.Random(4)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 9)):
            a, b, n, m = rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 9), rng.randint(1, 9)
            parts.append((a, a + n, b, b + m, float(n)))
        best = {}
        for i in sorted(range(len(parts)), key=lambda i: parts[i][0]):
            a0, _, b0, _, v = parts[i]
            best[i] = v + max([0.0] + [best[j] - 0.05 * (a0 - parts[j][1] + b0 - parts[j][3]) for j in best if parts[j][1] <= a0 and parts[j][3] <= b0])
        got = chaining.chains(parts)
        assert sorted(i for c in got for i in c) == list(range(len(parts)))
        for c in got:
            assert all(parts[x][1] <= parts[y][0] and parts[x][3] <= parts[y][2] for x, y in zip(c, c[1:], strict=False))
        c = [parts[i] for i in got[0]]
        value = sum(p[4] for p in c) - 0.05 * sum(y[0] - x[1] + y[2] - x[3] for x, y in zip(c, c[1:], strict=False))
        assert value == pytest.approx(max(best.values()))


def test_stretches_unite_matches_along_diagonals():
    rng = random.Random(5)
    for _ in range(100):
        m = [(rng.randint(0, 2), a := rng.randint(0, 90), a + rng.randint(-2, 2), rng.choice((4, 12))) for _ in range(rng.randint(1, 40))]
        lines = {}
        for g, a, b, k in sorted(m):
            line = lines.setdefault((g, b - a), [])
            if line and a <= line[-1][1] + chaining.JOIN:
                line[-1][2] |= set(range(a, a + k))
                line[-1][1] = max(line[-1][1], a + k)
            else:
                line.append([a, a + k, set(range(a, a + k))])
        want = sorted((g, a, e, a + d, e + d, len(s)) for (g, d), x in lines.items() for a, e, s in x)
        got = chaining.stretches(*(np.array(c, np.int64) for c in zip(*m, strict=True)))
        assert sorted(zip(*(c.tolist() for c in got), strict=True)) == want


def test_words_and_seeds():
    import pyarrow as pa
    import xxhash

    texts = ["", "  ", "A b\x0bC\td ", "\u00a0x \u2003 y\x1cz", "Äb aB", " ".join("w%d" % i for i in range(30))]
    hashes, cut = chaining.word_hashes(pa.array(texts))
    for t, i, j in zip(texts, cut, cut[1:], strict=False):
        assert hashes[i:j].tolist() == [xxhash.xxh32_intdigest(w) for w in t.encode().lower().split()]
    rng = np.random.default_rng(1)
    words, cut = rng.integers(0, 1 << 32, 3000, np.uint32), np.array([0, 3, 3, 900, 3000])
    at, h, k = chaining.seeds(np.concatenate([words, words]), np.concatenate([cut, 3000 + cut[1:]]))
    ends = np.concatenate([cut[1:], 3000 + cut[1:]])
    assert all(a + n <= ends[np.searchsorted(ends, a, "right")] for a, n in zip(at, k, strict=True))
    assert sorted(zip(at[at < 3000], h[at < 3000], strict=True)) == sorted(zip(at[at >= 3000] - 3000, h[at >= 3000], strict=True))
    assert 800 < (k == 4).sum() / 2 < 1200 and 120 < (k == 12).sum() / 2 < 260
    assert len(chaining.seeds(words[:0], np.zeros(1, np.int64))[0]) == 0


def test_alignment_counts_words_equal_in_order():
    rng = random.Random(6)

    def lcs(x, y):
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1, j + 1] = h[i, j] + 1 if x[i] == y[j] else max(h[i, j + 1], h[i + 1, j])
        return h[-1, -1]

    for _ in range(200):
        x = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        y = [v for v in x if rng.random() < 0.9] + [rng.randint(0, 6) for _ in range(rng.randint(0, 10))]
        assert chaining.common_words(x, y) == lcs(x, y)
    passage = list(range(100, 160))
    x, y = [1, 2, 3, *passage, 4, 5], [9, *passage, 7, 8, 6]
    assert chaining.align(x, y, 20, 40, 18, 38) == (3, 63, 1, 61, 60)
    assert chaining.extend([1, 2, 3], [1, 9, 3]) == (1, 1) and chaining.extend([], [1]) == (0, 0)


def test_rules_are_learned_and_ordered():
    rng = random.Random(8)
    rows = []
    for i in range(900):
        r = dict.fromkeys(quality_rules.STATISTICS, 0.0)
        r["n_words"], r["symbol_rate"], r["repeat_rate"] = rng.randint(20, 500), rng.random() * 0.02, rng.random() * 0.05
        bad = i % 9 == 0
        if bad:
            r["symbol_rate" if i % 2 else "repeat_rate"] = 0.3 + rng.random() * 0.2
        rows.append(r | {"bad": int(bad), "fold": i % 3 if i % 9 else rng.randint(0, 2)})
    rules = quality_rules.learn_rules(rows)
    assert rules and all(r.precision >= 0.9 for r in rules)
    caught = [any(x.holds(r) for x in rules) for r in rows]
    assert sum(c for c, r in zip(caught, rows, strict=True) if r["bad"]) > 95
    assert not sum(c for c, r in zip(caught, rows, strict=True) if not r["bad"])
    assert quality_rules.learn_rules([]) == []
    assert quality_rules.learn_rules([r | {"bad": 0} for r in rows]) == []


def test_toxicity_learns_from_documents_and_locates():
    rng = random.Random(9)
    words = ["stone", "river", "cloud", "grass", "paper", "light"]
    texts, y = [], []
    for i in range(300):
        s = [" ".join(rng.choices(words, k=6)) for _ in range(5)]
        if i % 4 == 0:
            s[rng.randint(0, 4)] += " vile"
        texts.append(". ".join(s))
        y.append(int(i % 4 == 0))
    m = toxicity.fit(texts, y)
    t = m.table()
    assert t[toxicity.token_features("vile")[0]] > 1
    assert len(toxicity.fit([], []).features) == 0
    assert len(toxicity.fit(["a"], [0]).features) == 0
    assert zlib.crc32(b"0") % 5 in range(5)


def test_matched_words_are_a_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        x, y = ([rng.randrange(6) for _ in range(rng.randrange(40))] for _ in range(2))
        got = chaining.matched(x, y, step=7)
        assert len(got) == chaining.common_words(x, y) and all(x[i] == y[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_surroundings_once_a_text():
    rid, pos = np.array([1, 1, 1, 1, 2, 2]), np.array([200, 201, 202, 900, 300, 5])
    n, h, f = np.array([1000, 1000, 1000, 1000, 400, 400]), np.array([7, 7, 7, 7, 7, 3], np.uint64), np.array([4, 4, 4, 4, 4, 4], np.uint64)
    got = sorted(zip(*(c.tolist() for c in substring_exact.once(rid, pos, n, h, f)), strict=True))
    assert got == sorted([(1, 200, 1000, 7, 4, 4), (2, 300, 400, 7, 4, 1), (2, 5, 400, 3, 4, 1), (1, 96, 402, 0, 0, 0), (1, 796, 1000, 0, 0, 0)])
