"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest

from tallyspark.llm import ann, best_fit, bpe, bpe_codec, licence_scan, line_dedup, minhash, quality, token_count, training_order, va_file
from tallyspark.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def path():
    return bpe.default_path()


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    odd = ["", None, " ", "\n\n", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "don't  stop\t\r\n", "é́ñ日本語 ٣٤ \x1c x", "aaaaaaaaaa" * 300, LONG]
    return odd + ["".join(rnd.choice("abe  \n'st1é!<|") for _ in range(rnd.randint(1, 90))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no key at all", "en", "s", 1), (3, texts[3], "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "text as key_", "doc_id as n_", "text as text_").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- tokens --------------------------------------------------------------------------------------------------------


def test_counts_are_the_librarys(docs, path, library):
    got = token_count.token_counts(docs, path, limit=5).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 5)


def test_codec_round_trip(docs, path, library):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe_codec.codec_digest(docs, path).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe_codec.encode_column(docs, path)
    assert {(r["doc_id"], r["text"]) for r in bpe_codec.decode_column(encoded, path).collect()} == {(k, t) for k, t in texts.items()}


def streamed(path, chunks, window=bpe.WINDOW):
    return [i for ids, _ in bpe.Encoder(path, window).plain(chunks) for i in ids]


def test_transducer_and_stream_in_any_portions(path, library):
    m, look = bpe.machine(path), bpe.lookahead(path)
    v, rnd = m.v, random.Random(1)
    longest = max(map(len, v.token))
    tokens = [t for t in v.token if t]
    words = ["".join(rnd.choice("abcdetionghr") for _ in range(rnd.randint(1, 4000))).encode() for _ in range(20)]
    words += [b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 6)))[: rnd.randint(1, 60)] for _ in range(2000)]
    words += [b"-" * 5000, b"a" * 3000, b"=-" * 1500, "ÃÂ".encode() * 900, b" " * 4000]
    for word in words:
        want, t, out, at = v.merge(word), bpe.Transducer(m), [], 0
        while at < len(word):
            n = rnd.randint(1, 60)
            out += t.feed(word[at : at + n])
            assert len(t.tok) - t.base <= look + longest + 2 and len(t.tok) <= 512 + look + longest + 62
            at += n
        assert out + t.finish() == want
    for text in ["It's 10  o'clock \n\n now" * 50, "x" * 20_000, " " * 500 + "a", "1" * 7_000 + "a", "é" * 7_000, "\n" * 3000 + " a", " \n" * 2000, "-" * 900 + " " * 900]:
        want = library.encode(text, add_special_tokens=False).ids
        for n, window in ((rnd.randint(1, 900), 100), (7, 3), (10**6, bpe.WINDOW)):
            assert streamed(path, (text[i : i + n] for i in range(0, len(text), n)), window) == want, (text[:9], n, window)


def test_borders_of_tokens_are_those_of_merging(path):
    m, rnd = bpe.machine(path), random.Random(2)
    pairs = [(rnd.randrange(50256), rnd.randrange(50256)) for _ in range(2000)] + [(t, t) for t in range(0, 50256, 50)] + list(m.v.pairs)[::50]
    for a, b in pairs:
        assert m.apart(a, b) == (m.v.merge(m.v.token[a] + m.v.token[b]) == [a, b])


def test_tokens_go_out_before_a_word_ends(spark, path):
    """On ordinary documents, and nothing of a text is held beyond the window."""
    m, early, late = bpe.machine(path), 0, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect():
        for whole, part, _ in bpe.words(m.v, [r["text"]]):
            for w in [*whole, part]:
                t = bpe.Transducer(m)
                early, late = early + len(t.feed(w.encode())), late + len(t.finish())
    assert early > 0.1 * late > 0
    import tracemalloc

    encode, peaks = bpe.Encoder(path, 1 << 12), []
    for n in (50, 500):
        tracemalloc.start()
        for unit in ("ab ", " ", "x", "\u00e9!"):
            assert sum(len(ids) for ids, _ in encode.plain(unit * (1 << 11) for _ in range(n))) > 0
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_recurring_words_are_transduced_once(path, library):
    """However many other words come between, and however often what is remembered is full."""
    rnd, made = random.Random(4), []
    common, other = [f" c{'abcdefghij'[i]}on" for i in range(10)], set()
    text = ""
    for _ in range(400):
        w = " " + "".join(rnd.choice("abcdefgh") for _ in range(12))
        other.add(w)
        text += w + rnd.choice(common)
    encode = bpe.Encoder(path)
    encode.memo = type(encode.memo)(lambda raw: made.append(raw.decode()) or encode.word(raw), 100)
    got = list(encode.plain([text]))
    assert [i for ids, _ in got for i in ids] == library.encode(text, add_special_tokens=False).ids
    assert len(encode.memo) <= 100 and sum(w in common for w in made) <= 2 * len(common)


def test_both_splits_are_alike(path):
    v, rnd = bpe.vocabulary(path), random.Random(6)
    for i in range(0x10000):
        c = chr(i)
        text = f"a{c}1 {c}{c} b\n{c}!{c}'s {c}  {c}"
        assert bpe.narrow_split().findall(text) == v.split.findall(text), i
    for _ in range(500):
        text = "".join(rnd.choice("ab1!' \n\u00e9\u0301\u00a0\u3000\u0663\x1c\U0001f600\U00020000\U0001d7ce") for _ in range(rnd.randint(0, 30)))
        assert bpe.split_words(v, text) == v.split.findall(text)


def test_stream_split_anywhere_in_contractions(path, library):
    tails = ["'ll", "'re", "'ve", "'s", "'d", "'m", "'t", "'lx", "'r", "'v", "''ll", " 'll", "!'ve", "'LL", "1're"]
    for text in [f"we{t}{end}" for t in tails for end in (" go", "", "x", "\n")]:
        want = library.encode(text, add_special_tokens=False).ids
        for i in range(len(text) + 1):
            assert streamed(path, [text[:i], text[i:]]) == want, (text, i)
        assert streamed(path, text, 2) == streamed(path, text) == want, text


def test_decoder_takes_single_ids_and_bad_bytes(path, library):
    v = bpe.vocabulary(path)
    rnd = random.Random(5)
    for _ in range(300):
        ids = [rnd.randrange(256 if rnd.random() < 0.7 else 50257) for _ in range(rnd.randint(0, 12))]
        d = bpe.Decoder(v)
        assert "".join([d.feed([i]) for i in ids] + [d.finish()]) == library.decode(ids, skip_special_tokens=False)


# -- packing -------------------------------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity, max_docs, max_attention):
    """Best fit over single pieces, longest first: number of sequences."""
    bins = []
    for s in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= s and b[1] >= 1 and b[2] >= s * s]
        b = min(fit, key=lambda b: (b[0] != s, b[0] - s)) if fit else None
        if b is None:
            b = [capacity, max_docs, max_attention]
            bins.append(b)
        b[0], b[1], b[2] = b[0] - s, b[1] - 1, b[2] - s * s
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_docs": 3}, {"max_attention": 1500}, {"max_docs": 4, "max_attention": 2000}])
def test_plan_keeps_every_constraint(rule, limits):
    rnd = random.Random(2)
    for _ in range(15):
        lengths = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 300))]
        histogram = {s: lengths.count(s) for s in set(lengths)}
        d, a = limits.get("max_docs", 50), limits.get("max_attention", 2500)
        bins, seen = {}, set()
        for s, lo, hi, x, off in best_fit.plan(histogram, 50, d, a, rule):
            for r in range(lo, hi):
                assert (s, r) not in seen
                seen.add((s, r))
                bins.setdefault(x + r - lo, []).append((off, s))
        assert len(seen) == len(lengths)
        for placed in bins.values():
            at = 0
            for off, s in sorted(placed):
                assert off == at
                at += s
            assert at <= 50 and len(placed) <= d and sum(s * s for _, s in placed) <= a
        if rule == "norm" and not limits:
            assert len(bins) == plain_best_fit(lengths, 50, d, a)


def test_packed_documents(docs, path, library):
    got = best_fit.pack_documents(docs, path, capacity=64).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = []
    for k, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64)]
        want += [(k, p, s, len(x := ids[s : s + (first if p == 0 else 64)]), zlib.crc32(np.array(x, "<u4").tobytes())) for p, s in enumerate(cuts)]
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=order) == sorted(want, key=order)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for off, s in sorted(placed):
            assert off == at
            at += s
        assert at <= 64
    assert len(bins) <= math.ceil(sum(w[3] for w in want) / 64) + 3


# -- near duplicates -----------------------------------------------------------------------------------------------


def groups(sets, links):
    at = {k: k for k in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {k: find(k) for k in sets}


def brute_groups(texts, k):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, groups(sets, links)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_all_found(spark, k):
    rnd = random.Random(k)
    lexicon = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(12):
        base = [rnd.choice(lexicon) for _ in range(rnd.choice([3, 8, 30, 120]))]
        for _ in range(rnd.choice([1, 2, 9, 25])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, len(w) // 25])):
                w[rnd.randrange(len(w))] = rnd.choice(lexicon)
            texts[len(texts)] = " ".join(w)
    # a chain, in which the ends are far apart, and a mixed group around the threshold
    chain = [f"c{i}" for i in range(160)]
    for s in range(0, 60, 4):
        texts[len(texts)] = " ".join(chain[s : s + 100])
    for t in [None, "", " \n\t", "One Two", "one  two", "one two three", "É x", "é x", "a b c d e f"]:
        texts[len(texts)] = t
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[5], (None, "without a key", "en", "s", 0)], DOCS).selectExpr("*", "1 as component", "text as key_", "2 as rep_")
    got = minhash.near_duplicates(df, k=k).collect()
    assert len(got) == len(rows) + 2
    sizes, component = brute_groups(texts, k)
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, None)
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"])
    left = minhash.one_of_each(df, k=k)
    assert left.columns == df.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in component.items() if i == c) and ids.count(None) == 1


def test_near_copies_under_the_threshold_are_not_all_compared(spark, monkeypatch):
    """A large group whose documents mostly lie a little under the threshold, with families in it that share their changes."""
    rnd = random.Random(9)
    lexicon = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(lexicon) for _ in range(150)]

    def changed(words, n):
        words = list(words)
        for p in rnd.sample(range(len(words)), n):
            words[p] = f"x{rnd.random()}"
        return words

    texts = [base, *(changed(base, 3) for _ in range(60)), *(changed(base, rnd.choice([9, 10, 11])) for _ in range(300))]
    for _ in range(15):
        own = changed(base, 10)
        texts += [changed(own, rnd.choice([0, 1, 3])) for _ in range(4)]
    texts += [base[:20] + [rnd.choice(lexicon) for _ in range(40)] for _ in range(40)]
    texts = {i: " ".join(w) for i, w in enumerate(texts)}
    compared, plain = [], minhash.verified

    def counted(pairs, *how):
        compared.append(pairs.count())
        return plain(pairs, *how)

    monkeypatch.setattr(minhash, "verified", counted)
    sizes, component = brute_groups(texts, 4)
    for weed in (True, False):
        compared.clear()
        got = minhash.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS), k=4, weed=weed).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], component[i]) for i in texts}
        assert sum(compared) < 10 * len(texts)
    assert 300 < len(set(component.values())) < len(texts) - 80


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_join_by_differences_finds_every_link(spark, percent):
    rnd = random.Random(percent)
    texts = {}
    for i in range(90):
        base = [f"{rnd.choice('abc') if i % 5 else 'r'}{j}" for j in range(rnd.choice([6, 40, 41]))]
        for _ in range(rnd.choice([0, 0, 2, 8])):
            base[rnd.randrange(len(base))] = rnd.choice("xyz")
        texts[i] = base
    for i in range(0, 90, 3):
        texts[i] = [w if rnd.random() > 0.08 else rnd.choice("uv") for w in texts[5 * (i // 30)]]
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(7, "another text of the key"), (80, "another text of the key x y z"), (9, " ".join(texts[9]))]
    sets = [(i, {tuple(w[j : j + 2]) for j in range(len(w) - 1)}) for i, t in rows for w in [t.split()]]
    held = spark.createDataFrame(rows, "key_ long, text_ string")
    for ref in (0, 7, 44):
        under = spark.createDataFrame([(ref, i, i // 2) for i in texts], "ref_ long, rep_ long, component long")
        found, pairs = minhash.by_differences(under, held, 2, percent)
        found = {tuple(r) for r in found.collect()}
        got = found | {tuple(r) for r in minhash.verified(pairs, held, 2, percent).collect()}
        links = {(min(i, j), max(i, j)) for i, s in sets for j, t in sets if i != j and 100 * len(s & t) >= percent * len(s | t)}
        assert found == {x for x in links if ref in x} and got <= links
        near = {i for i, s in sets for j, t in sets if j == ref and 100 * len(s & t) >= percent * len(s | t)}
        assert {(i, j) for i, j in links if i // 2 != j // 2 and not (i in near and j in near)} <= got


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            n = int(rnd.choice([5, 60, 900]))
            common = rnd.integers(1, 2**63, max(1, int(n * share)), dtype=np.int64).astype(np.uint64)
            own = [rnd.integers(1, 2**63, n - len(common), dtype=np.int64).astype(np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([common, o])) for o in own)
            s = minhash.signatures([a, b, np.empty(0, np.uint64)], 96)
            errors.append((s[0] == s[1]).mean() - len(common) / (len(a) + len(b) - len(common)))
            assert np.isinf(s[2]).all() and np.isfinite(s[:2]).all()
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_large_sets_in_parts_give_equal_signatures(monkeypatch):
    x = np.unique(np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64))
    whole = minhash.signatures([x], 96)
    monkeypatch.setattr(minhash, "CHUNK", 700)
    assert (minhash.signatures([x], 96) == whole).all()


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == groups(nodes, edges)


def test_components_of_long_chains_in_any_order_of_ids(spark):
    ids = list(range(1000))
    random.Random(0).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(2000, 2001), (2001, 2000), (3000, 3000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, 0) | {2000: 2000, 2001: 2000}


# -- lines ---------------------------------------------------------------------------------------------------------


def test_patience_is_a_common_subsequence_with_all_unique_runs():
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([9, 1, 2, 3, 8], [1, 2, 3]) == [(1, 0), (2, 1), (3, 2)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1], [2]) == []
    rnd = random.Random(0)
    for _ in range(300):
        a, b = ([rnd.randrange(12) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def brute_common_blocks(texts, least):
    """Texts without the lines of runs of ``least`` words that stand in any earlier text, by trying all pairs of places."""
    count = lambda x: len([w for w in x.split(" ") if w])
    lines = {k: [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if count(x)] for k, t in texts.items() if t is not None}
    out = dict(texts)
    for k, mine in lines.items():
        gone = set()
        for other in (v for o, v in lines.items() if o < k):
            for i in range(len(mine)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(mine) and j + n < len(other) and mine[i + n][1] == other[j + n][1]:
                        n += 1
                    if sum(count(x) for _, x in mine[i : i + n]) >= least:
                        gone |= set(range(mine[i][0], mine[i + n - 1][0] + 1))
        out[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize("rare", [2, 8])
def test_line_dedup_against_brute_force(spark, rare):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 3, 5, 12, 22]))) for _ in range(25)]
    texts = {}
    for i in range(60):
        lines = [rnd.choice([*pool, ""]) for _ in range(rnd.randint(0, 12))]
        if i % 4 == 0:
            lines[1:1] = pool[3:8]
        texts[i] = "\n".join(lines)
    texts |= {80: texts[8], 81: texts[8], 82: "", 83: None, 84: "\n\n", 85: "\n".join(["same line of several words here"] * 9), 86: "\n".join(["same line of several words here"] * 9), 87: LONG}
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()] + [(None, texts[0], "en", "s", 0), (81, texts[81], "en", "s", 0)]
    clash = ("key_", "text_hash_", "stays_", "left_", "gone_", "piece_", "bits_", "at_", "h", "x_")
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"{n} as {c}" for n, c in enumerate(clash)))
    out = line_dedup.dedup_lines(df, min_words=2, block_words=20, rare=rare)
    assert out.columns == [*df.columns, "lines_dropped"]
    assert line_dedup.dedup_lines(out, min_words=2, block_words=20).columns == out.columns
    want, got = brute_common_blocks(texts, 20), out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == (texts[0] if r["doc_id"] is None else want[r["doc_id"]]), r["doc_id"]
        assert [r[c] for c in clash] == list(range(len(clash)))
        assert r["doc_id"] is None or r["lines_dropped"] == 0 or r["text"] != texts[r["doc_id"]]
    assert next(r for r in got if r["doc_id"] == 81)["text"] == want[81] != texts[81]
    assert sum(t != texts[k] for k, t in want.items()) > 20


def test_blocks_are_judged_in_each_pair(spark):
    """Four lines of four documents make no block; copies are held against each other, not only against a line's first holder."""
    line = [f"the {w} line has seven words here" for w in ("first", "second", "third", "fourth")]
    apart = {n + 1: x for n, x in enumerate(line)} | {5: "\n".join(line)}
    turned = {11: "\n".join(x + " too" for x in reversed(line)), 12: "\n".join(x + " too" for x in line), 13: "\n".join(x + " too" for x in line)}
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in (apart | turned).items()], DOCS)
    for everywhere in (True, False):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, everywhere=everywhere).collect()}
        assert got == apart | turned | {13: ""}


def test_every_repeat_of_an_earlier_document_goes(spark):
    rnd = random.Random(6)
    line = lambda *_: " ".join(f"x{rnd.randrange(10**6)}" for _ in range(6))
    p, q, r = ([line() for _ in range(4)] for _ in range(3))
    own = lambda: [line(), line()]
    texts = {
        0: [*p, *own(), *p], 1: [*own(), *p], 2: [*p, *own()],  # the first holder has it twice
        10: [*own(), *q], 11: [*q, *own(), *q],  # a later document has it twice
        20: [*r, *own()], 21: [*r, *own(), *q[:2], "", *q[2:], *r],  # in another order, with another line between
    }
    pool = [line()[: rnd.choice([7, 15, 30])].strip() for _ in range(12)]
    texts |= {k: [rnd.choice(pool) for _ in range(rnd.randint(0, 25))] for k in range(30, 60)}
    texts = {k: "\n".join(x) for k, x in texts.items()}
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOCS)
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(df, min_words=3, block_words=10).collect()}
    assert got[0] == texts[0] and not any(x in got[k] for k, x in [(1, p[0]), (2, p[3]), (11, q[0]), (21, q[3]), (21, r[0])])
    assert got == brute_common_blocks(texts, 10)


# -- vectors -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(700, 8)), 2).astype(np.float32)
    x[100:300] = x[100]  # a very common vector
    rows = [(int(i), [float(c) for c in v], "extra") for i, v in enumerate(x)]
    rows += [rows[0], rows[150], (800, None, ""), (900, [0.0] * 8, ""), (1000, [float("nan")] * 8, ""), (1100, [1.0] * 7 + [None], ""), (1200, [float("inf")] * 8, ""), (None, [1.0] * 8, "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id_ string"), x


def test_exact_top(vectors):
    df, x = vectors
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    ids, v = np.append(np.arange(700), 900), np.vstack([v, np.zeros((1, 8), np.int64)])
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        want += [(ids[q], n, ids[i], s[i]) for n, i in enumerate(order, 1)]
    for how in ({}, {"row_block": 100, "query_block": 4}):
        assert sorted(map(tuple, va_file.exact_top(df, **how).collect())) == sorted(want)


def test_exact_top_of_huge_components(spark):
    df = spark.createDataFrame([(0, [3e9, 1.0]), (1, [2e9, 5.0]), (2, [-1e9, 0.5])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in va_file.exact_top(df).collect()}
    assert got[0, 1] == 256 * 3 * 10**9 * 256 * 2 * 10**9 + 256 * 1280 if 256 * 3 * 10**9 * 256 * 2 * 10**9 < 2**63 else 2**63 - 1
    assert got[0, 2] == max(-(2**63), -(768 * 10**9) * (256 * 10**9) + 256 * 128)


def test_nearest(vectors):
    df, x = vectors
    want, d = {}, x.astype(np.float64)
    for q in range(0, 700, 100):
        s = np.sqrt(((d - d[q]) ** 2).sum(1))
        want[q] = [(int(i), s[i]) for i in np.lexsort((np.arange(700), s)) if i != q][:10]
    got = {}
    for r in sorted(ann.nearest(df, leaf=8).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == sorted(want)
    assert all(len(v) == 10 for v in got.values())
    for q in (100, 200):  # the common vector's ties go to the smallest ids
        assert got[q] == want[q]
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 70
    full = {}
    for r in ann.nearest(df, reach=math.inf, row_block=100, query_block=3).collect():
        full.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert {q: [v[i] for i in range(1, 11)] for q, v in full.items()} == want


def test_forest_beyond_its_sample():
    x = np.random.default_rng(0).normal(size=(3000, 16)).astype(np.float32)
    for f in (ann.Forest.fit(x[:256], 3000, trees=4, leaf=16), ann.Forest.fit(x, 3000, trees=4, leaf=16), ann.Forest.fit(x[:9], 9)):
        at = f.leaves(x)
        for q in x[:10]:
            queue = list(f.probe(q, math.inf))
            assert [far for far, _, _ in queue] == sorted(far for far, _, _ in queue)
            assert len({leaf[1:] for leaf in queue}) == len(queue) == len(f.planes) * 2 ** (f.depth + f.extra)
            order = {(t, i): far for far, t, i in queue}
            want = np.array([min(order[t, i] for t, i in enumerate(row)) for row in at[:200].tolist()])
            assert np.allclose(f.priorities(q, at[:200]), want, atol=1e-9)
            reach = float(np.median(want))
            assert ((f.priorities(q, at[:200], reach) <= reach) == (want <= reach)).sum() >= 198
            assert min(order[t, int(i)] for t, i in enumerate(f.leaves(q[None])[0])) < 1e-5
    assert ann.Forest.fit(x[:256], 3000, trees=4, leaf=16).extra > 0


def test_vectors_of_several_lengths(spark):
    rows = [(i, [1.0 + i, 2.0, float(i % 3)]) for i in range(8)] + [(100, [1.0, 2.0]), (200, [5.0]), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id_", "2 as v_", "3 as query_id", "4 as p_", "5 as rank")
    for got in (ann.nearest(df, k=3), va_file.exact_top(df, k=3, every=50)):
        assert {r["query_id"] for r in got.collect()} == {0} and got.count() == 3


# -- training order ------------------------------------------------------------------------------------------------


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        out = training_order.feistel(np.arange(n), n, 42)
        assert sorted(out) == list(range(n))
        assert (training_order.feistel(out, n, 42, inverse=True) == np.arange(n)).all()
    assert (training_order.feistel(np.arange(1000), 1000, 1) != training_order.feistel(np.arange(1000), 1000, 2)).mean() > 0.9


def test_shards_hold_every_sequence(docs, path, library, tmp_path):
    out = f"file://{tmp_path}/shards"
    index = training_order.materialise(docs, path, seed=9, length=32, slots_per_shard=100, out=out).collect()
    rows, each = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())), {}
    stream = []
    for known, k, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [50256]
        each[k if known else None] = ids
        stream += ids
    want = [tuple(stream[i : i + 32]) for i in range(0, len(stream), 32)]
    slots = training_order.feistel(np.arange(len(want)), len(want), 9)
    got = {slot: tuple(ids.tolist()) for slot, ids in training_order.read_slots(out)}
    assert got == dict(zip(slots.tolist(), want, strict=True))
    assert sum(r["n_tokens"] for r in index) == len(stream) and {r["slot"] for r in index} == set(got)
    for r in index:
        ids = each[r["doc_id"]][r["start"] : r["start"] + r["n_tokens"]]
        assert got[r["slot"]][r["offset"] : r["offset"] + r["n_tokens"]] == tuple(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u2").tobytes())
        assert r["shard"] == r["slot"] // 100 and r["byte_offset"] == r["slot"] % 100 * 64
    assert [g[0] for g in training_order.read_slots(out, 150, 120)] == list(range(150, 270))
    manifest = json.loads((tmp_path / "shards/manifest.json").read_text())
    assert manifest["shards"] == math.ceil(len(want) / 100) and manifest["tokens"] == len(stream)
    assert sorted(x.name for x in (tmp_path / "shards").iterdir()) == ["manifest.json", *(f"shard-{i:06d}.bin" for i in range(manifest["shards"]))]


def test_training_order_is_the_same_under_other_splits(docs, path, tmp_path):
    found = []
    for n, split in enumerate((docs.coalesce(1), docs.repartition(5, "text"), docs.orderBy("text"))):
        out = f"file://{tmp_path}/{n}"
        training_order.materialise(split, path, seed=4, length=16, slots_per_shard=64, out=out)
        found.append({f.name: f.read_bytes() for f in (tmp_path / str(n)).iterdir()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 3


# -- classifiers ---------------------------------------------------------------------------------------------------


def test_licence_lines(spark):
    cases = {
        0: ("Some text.\nReleased under the MIT License.", "mit"), 1: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        2: ("x\nLicensed under the Apache License, Version 2.0.\ny", "apache-2.0"), 3: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 4: ("All rights reserved.", "proprietary"),
        5: ("The license plate fell off.\nHe gave permission to enter.", ""), 6: ("", ""), 7: (None, ""), 8: (LONG, ""), 9: ("All seats are reserved.", ""),
        10: ("Licensed under the GNU Lesser General Public License, version 2.1.\nAll rights reserved.", "lgpl,proprietary"),
    }
    rows = [(k, t, "en", "s", 0) for k, (t, _) in cases.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, "All rights reserved.", "en", "s", 0)], DOCS).selectExpr("*", "text as gram_", "1 as key_")
    got = licence_scan.licence_scan(df)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    got = got.collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = "proprietary" if r["doc_id"] is None else cases[r["doc_id"]][1]
        assert (r["families"], r["n_notices"]) == (want, len([x for x in want.split(",") if x])), r


def test_licence_notices_over_several_lines(spark):
    import textwrap

    mit, gpl = licence_scan.NOTICES["mit"][3], licence_scan.NOTICES["gpl"][1]
    bsd = "Redistributions and use in both source and binary forms, with or without any modification, are permitted only provided that these following conditions are met"
    cases = {0: (mit, "mit"), 1: (gpl, "gpl"), 2: (bsd, "bsd"), 3: ("The license plate fell off. He gave permission to enter the library of the software house.", "")}
    rows = [(10 * k + n, textwrap.fill("x y. " + t, width), f) for k, (t, f) in cases.items() for n, width in enumerate((30, 72))]
    got = {r["doc_id"]: r for r in licence_scan.licence_scan(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    for k, t, f in rows:
        assert (got[k]["families"], got[k]["n_notices"]) == (f, int(f != "")), (t, got[k])


def test_licence_scores_match_plain_sums(spark):
    m = licence_scan.model()
    lines = [t for texts in licence_scan.NOTICES.values() for t in texts] + licence_scan.OTHERS
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["key_"]: (r["family"], r["chance"]) for r in licence_scan.licence_lines(df).collect()}
    for i, line in enumerate(lines):
        z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in licence_scan.grams(licence_scan.words(line)) if g in m.weights), np.zeros(len(m.bias)))
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if best and p[best] > 0.5:
            assert got[i][0] == m.classes[best] and abs(got[i][1] - p[best]) < 1e-9
        else:
            assert i not in got
    families = [f for f, texts in licence_scan.NOTICES.items() for _ in texts]
    assert sum(got.get(i, ("",))[0] == f for i, f in enumerate(families)) >= 0.9 * len(families)


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    apart = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in apart) >= 0.95 * len(apart)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_quality_never_learns_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    one, two = ({(r["doc_id"], r["score"]) for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_quality_equals_a_dense_fit(spark):
    """All of it with dense matrices and plain loops on one small table: features, ridge by folds, isotonic, interpolation."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    stats = {k: np.array(quality.statistics(t), np.float32).astype(float) for k, t in texts.items()}
    fold = {r["k"]: r["f"] for r in spark.createDataFrame([(k,) for k in known], "k long").selectExpr("k", "pmod(xxhash64(k), 3) as f").collect()}
    ids = sorted(known)
    x, y, f = np.array([stats[k] for k in ids]), np.array([known[k] for k in ids], float), np.array([fold[k] for k in ids])
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(0, math.sqrt(2 * quality.WIDTH), (x.shape[1], quality.D))
    phase = rng.uniform(0, 2 * math.pi, quality.D)
    mean, std = x.mean(0), x.std(0)

    def features(v):
        v = np.clip((v - mean) / np.where(std > 1e-9, std, 1), -6, 6)
        return np.hstack([np.cos(v @ w + phase) * math.sqrt(2 / quality.D), v / math.sqrt(x.shape[1]), np.ones((len(v), 1))])

    def ridge(z, y, weight):
        # least squares on rows with the penalty's rows below, no normal equations
        penalty = np.sqrt(np.append(np.full(z.shape[1] - 1, quality.RIDGE), 1e-6))
        a = np.vstack([z * np.sqrt(weight)[:, None], np.diag(penalty)])
        return np.linalg.lstsq(a, np.append(y * np.sqrt(weight), np.zeros(z.shape[1])), rcond=None)[0]

    z, weight = features(x), np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = ridge(z, y, weight)
    raw = np.array([z[i] @ ridge(z[f != f[i]], y[f != f[i]], weight[f != f[i]]) for i in range(len(y))])
    cell = np.clip(np.floor((raw + 0.5) * 2048), 0, 4095)
    at = np.unique(cell)
    n, ones = np.array([(cell == c).sum() for c in at]), np.array([y[cell == c].sum() for c in at])
    # isotonic fit by its min-max formula
    level = np.array([max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))])
    want = np.interp(features(np.array([stats[k] for k in sorted(texts)])) @ beta, (at + 0.5) / 2048 - 0.5, level)
    apart = [abs(got[k]["score"] - s) for k, s in zip(sorted(texts), want, strict=True)]
    # a raw score on the edge of a grid cell may fall to either side
    assert np.mean(np.array(apart) < 1e-3) > 0.95, sorted(apart)[-10:]
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert list(x) == [1, 2, 3, 4] and list(y) == [0, 0.5, 0.5, 1]


def test_quality_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}


# -- all on an empty table -----------------------------------------------------------------------------------------


def test_empty_tables(spark, empty, path):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        token_count.token_counts(empty, path), bpe_codec.codec_digest(empty, path), best_fit.pack_documents(empty, path), line_dedup.dedup_lines(empty), minhash.near_duplicates(empty), minhash.one_of_each(empty),
        licence_scan.licence_scan(empty), quality.quality_scores(empty, labels), quality.keep_good(empty, labels), training_order.materialise(empty, path, seed=1), ann.nearest(vectors), va_file.exact_top(vectors),
    ):
        assert out.count() == 0


# -- registration --------------------------------------------------------------------------------------------------


def test_odd_rows_pass_the_other_operators(docs, path):
    n = docs.count()
    assert line_dedup.dedup_lines(docs).count() == n and minhash.near_duplicates(docs).count() == n and licence_scan.licence_scan(docs).count() == n


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert 0.5 * docs.count() < len(ids) <= docs.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, names that operators use inside, and empty tables through every stage."""
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in base]
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "no key at all", "en", "s", 1), rows[0], (9003, rows[1][1], "en", "s", 1), (9004, LONG, "en", "s", len(LONG))]
    clash = ["key_", "text_hash_", "gone_", "left_", "lines_dropped_", "piece_", "bits_", "at_", "same_", "kept", "held_out", "predicted", "component_id"]
    docs = spark.createDataFrame([*rows, *odd], DOCS).selectExpr("*", *(f"'{c}' as {c}" for c in clash))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        held = out.collect()
        assert None in {r["doc_id"] for r in held} <= ids and all(r[c] == c for r in held for c in clash), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name == "minhash_near_dedup":
            left = {r["doc_id"] for r in held}
            assert 9003 not in left and {9001, 9002, 9004} <= left
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    filled = {}
    for r in packed:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 2048 and {r["doc_id"] for r in packed} >= {9001, 9004, None}


def test_encoder_is_merging_and_the_library(path, library):
    v, rnd = bpe.vocabulary(path), random.Random(8)
    whole, encode = v.library(), bpe.encoder(path, "<u4")
    assert whole
    for _ in range(3000):
        raw = bytes(rnd.choice(b" abcdetionghrs\xc3\xa9\xf0\x00") for _ in range(rnd.randint(1, 40)))
        assert list(whole._encode_single_piece(raw)) == v.merge(raw)
    n = bpe.LIBRARY_CHARS
    texts = ["", " " * n, " " * (n + 1), "\n" * n + "x", "a" * n, "a b" * n, "<|endoftext|> a<|endoftext|>", "\x85\xa0\x1c a\u3000b", "\u65e5\u672c" * n]
    texts += ["".join(rnd.choice(" \n\t'ab1!\u00e9\u3000\U0001f600") for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    for x in texts:
        assert encode(x) == np.array(library.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
