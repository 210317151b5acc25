import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from parcelflow.llm import chat, components, decontamination, encoding, huffman, jaccard, maxent, mixing, quality, store, substring_dedup, token_counts, token_files, urls, words
from parcelflow.llm.fmindex import FMIndex, WaveletMatrix
from parcelflow.llm.queries import oracle_sql, queries
from tests.same import rows_of, rows_of_sql

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, _row int, num int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def wild(seed=1, n=120):
    """Nulls in every column, empty and long texts, repeated rows, copies, odd characters, clashing columns."""
    rng = random.Random(seed)
    words = ["a", "b", "É", "the", "x.", "日本", "~1", "|", "\u0301", "🙂"]
    texts = [None, "", " \n\t", "one", "a " * 400] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 60, 150]))) for _ in range(n)]
    texts += [texts[9], texts[9], texts[10] + " more", texts[11].upper(), "line\n" * 50, "w " * 20000]
    rows = [(i, t, rng.choice(["en", "de", None, "xx"]), rng.choice(["s", "hot", "hot", None]), None, "clash", 1, None) for i, t in enumerate(texts)]
    return rows + [rows[7], (None, texts[12], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(wild(), KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_equal_those_of_the_sql(spark, name):
    df = queries()[name](spark, DATA)
    assert rows_of(df) == rows_of_sql(oracle_sql()[name], DATA, df.columns)


def test_token_counts(spark, docs, empty):
    path = encoding.default_path()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    count = collections.Counter(len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in wild())
    total = sum(k * v for k, v in count.items())
    hist = token_counts.histogram(token_counts.document_lengths(spark, docs, path)).cache()
    got = hist.collect()
    assert {r.n_tokens: r.n_docs for r in got} == count
    for r in got:
        assert r.tokens_at_least == sum(k * v for k, v in count.items() if k >= r.n_tokens) and r.total_tokens == total
        assert r.truncated_tokens == sum(min(k, r.n_tokens) * v for k, v in count.items())
    limits = token_counts.at_limits(hist, [10, 100]).collect()
    assert [(r.docs_fit, r.tokens_kept) for r in limits] == [(sum(v for k, v in count.items() if k <= c), sum(min(k, c) * v for k, v in count.items())) for c in (10, 100)]
    flat = sorted(count.elements())
    assert token_counts.quantile(hist, 0.5).first()[0] == flat[math.ceil(len(flat) * 0.5) - 1]
    assert token_counts.histogram(token_counts.document_lengths(spark, empty, path)).count() == 0


def brute_substrings(rows, window=20):
    """By (doc_id, start): a null id comes first; rows of one id don't repeat each other at equal starts."""
    key = lambda i: -math.inf if i is None else i
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, (math.inf, 0)), (key(i), k))
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (key(i), k):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [40_000, 3])
def test_substring_dedup(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 3000)
    rng = random.Random(4)
    more = [(500 + i, " ".join(rng.choice("ab") for _ in range(120)) + " " + " ".join(map(str, range(45)))) for i in range(25)]
    rows = [r[:2] for r in wild()] + more
    df = docs.select("doc_id", "text", "size").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert sorted((tuple(r) for r in substring_dedup.dedup(spark, df).collect()), key=str) == brute_substrings(rows)
    assert substring_dedup.dedup(spark, empty).count() == 0


def test_fm_index_ranks_and_finds_first_places():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 9, 500)
    w = WaveletMatrix(seq, 9)
    c, i = rng.integers(0, 9, 300), rng.integers(0, 501, 300)
    assert w.rank(c, i).tolist() == [int((seq[:b] == a).sum()) for a, b in zip(c, i, strict=True)]
    for depth in (2, 3, 5, 8, 20):
        parts = [rng.integers(1, 3, n) for n in (1, depth, 40, 70)]
        text = np.concatenate([np.concatenate([[0], p]) for p in parts])
        start = np.flatnonzero(text == 0) + 1
        end = start + [len(p) for p in parts]
        places, firsts = FMIndex(text, depth).earliest(text, start, end)
        found = dict(zip(places.tolist(), firsts.tolist(), strict=True))
        valid = [k for a, b in zip(start, end, strict=True) for k in range(a, b - depth + 1)]
        assert sorted(found) == valid
        assert all(found[k] == min(j for j in valid if (text[j : j + depth] == text[k : k + depth]).all()) for k in valid)


def test_lm_scores(spark, docs, empty):
    rows = wild()
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    told = [[*WORD.findall(lower(r[1] or "")), "\n"] for r in rows]
    c = collections.Counter(w for t, h in zip(told, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], h, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for r, t, h in zip(rows, told, held, strict=True)), key=str)
    got = maxent.score(spark, docs).collect()
    assert sorted(((*r[:5], round(r.base_score, 4)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)
    assert maxent.score(spark, empty).count() == 0


def test_lm_beats_unigrams_on_held_out_documents_and_is_normalised(spark):
    rng = random.Random(7)
    tongues = [[f"{p}{i}" for i in range(300)] for p in ("k", "m")]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(120))) for i in range(400)]
    got = [r for r in maxent.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.05 * sum(r.n_tokens for r in got)
    m = maxent.Model(np.zeros(maxent.KINDS), np.zeros((maxent.CLASSES, maxent.SLOTS)), np.arange(maxent.HEAD))
    m.kinds += np.random.default_rng(1).normal(size=m.kinds.shape).astype(np.float32)
    for *_, p, _, _, _, q in m.batches(np.array([5, 1040, 7, 9]), np.array([8, 9, 8, 7]), np.array([0, 4])):
        assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and np.allclose(q.sum(axis=1), 1, atol=1e-5)


def test_lm_score_is_that_of_its_model_token_by_token(spark, monkeypatch):
    """Of the model that score() trains: classes, slots and rows of weights looked up one token at a time."""
    seen = {}
    for name in ("_score", "_encode"):
        real = getattr(maxent, name)
        monkeypatch.setattr(maxent, name, lambda shared, name=name, real=real: seen.setdefault(name, shared.value) is None or real(shared))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "a", "cat", "dog", "ran", f"zz{rng.randrange(30)}"]) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = {r.doc_id: r for r in maxent.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    (known, count, head), (model, tail_log) = seen["_encode"], seen["_score"]
    mask = (1 << 64) - 1

    def mixed(x):
        return int(maxent.mix(np.array([x & mask], dtype=np.uint64))[0])

    def share(bias, weights, rows, k):
        s = bias.astype(float) + sum(weights[r].astype(float) for r in rows)
        e = np.exp(s - s.max())
        return math.log10(e[k] / e.sum())

    place = {int(h): (int(c), int(k)) for h, c, k in zip(known, count, head, strict=True)}
    for i, t in rows:
        h, kind, _ = maxent.tokens(pa.array([t]))
        total, codes = 0.0, []
        for x, tail in zip(h.tolist(), kind.tolist(), strict=True):
            c, k = place.get(x, (0, -1))
            before = [codes[-1] if codes else (maxent.PAD, 0), codes[-2] if len(codes) > 1 else (maxent.PAD, 0)]
            feats = [mixed(before[0][0] * 8 + 1), mixed(before[1][0] * 8 + 2), mixed((mixed(before[0][1]) + before[1][1]) * 8 + 3)]
            cls = int(model.place[k]) // maxent.SLOTS if k >= 0 else maxent.CLASSES + tail
            total += share(model.kind_bias, model.kinds, [f % len(model.kinds) for f in feats], cls)
            if k >= 0:
                wide = [mixed(f + cls * 0x9E3779B97F4A7C15) % len(model.words) for f in feats]
                total += share(model.word_bias[cls], model.words, wide, int(model.place[k]) % maxent.SLOTS)
            else:
                total += math.log10(c + 0.5) - tail_log[tail]
            codes.append((k if k >= 0 else maxent.HEAD + tail, (x >> 32) + 1))
        assert got[i].score == pytest.approx(total, abs=1e-3 * max(1, len(h)))


def test_lm_tables_grow_with_the_vocabulary():
    assert [maxent.table_rows(v) for v in (0, 10**3, 10**6, 10**8, 10**12)] == [4096, 4096, 4096, 65536, 131072]


def twins(n, seed=0):
    """Two different words of 2**n letters that share all sums of letters times powers modulo 2**64 from some length on."""
    a = b"a"
    for _ in range(n):
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    return a.decode(), a.translate(bytes.maketrans(b"ab", b"ba")).decode()


def test_repetitive_words_have_numbers_and_ids_of_their_own(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoding.default_path())
    texts = [w for n in (3, 5, 6, 7, 10, 12) for w in twins(n)]
    assert len(set(words.Words(pa.array(texts)).hashes().tolist())) == len(texts)
    ids, at = encoding.encoder(encoding.default_path()).encode(pa.array(texts))
    assert all(tokenizer.encode(t, add_special_tokens=False).ids == ids[a:b].tolist() for t, a, b in zip(texts, at[:-1], at[1:], strict=True))
    x, y = twins(11)
    fill = " ".join(f"f{i}" for i in range(25))
    rows = [(1, f"{x} {fill}"), (2, f"{y} {fill}"), (3, f"{x} {fill}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(spark, df).collect()} == {1: 0, 2: 25, 3: 26}
    assert {r.doc_id: r.component_id for r in jaccard.join(spark, df, 3, 98, 100, count_links=False).collect()} == {1: 1, 2: 2, 3: 1}


def test_pieces_with_one_number_keep_their_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(words.Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64))  # all words of a length collide
    e, tokenizer = encoding.Encoder(encoding.default_path()), Tokenizer.from_file(encoding.default_path())
    for texts in (["ab cd ab xyz", "zz cd"], ["xyz uvw, ab", "Cd."], [None, ""]):
        ids, at = e.encode(pa.array(texts, pa.string()))
        assert all(tokenizer.encode(t or "", add_special_tokens=False).ids == ids[a:b].tolist() for t, a, b in zip(texts, at[:-1], at[1:], strict=True))


def test_very_long_texts(spark):
    """One text of 3 MB, and one of a single word of 1 MB, through the operators that take texts."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(40000)}" for _ in range(480_000))
    rows = [(1, long, "en", "s"), (2, "q" * 1_000_000, "en", "s"), (3, long, "en", "t"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(spark, df, with_text=False).collect()} == {1: 0, 2: 0, 3: 480_000, 4: 0}
    assert {r.doc_id: r.component_id for r in jaccard.join(spark, df, 5, 80, 100, count_links=False).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert {r.doc_id: r.n_words for r in quality.judge(spark, df, labels).collect()} == {1: 480_000, 2: 1, 3: 480_000, 4: 0}
    assert {r.doc_id: r.n_tokens for r in maxent.score(spark, df).collect()} == {1: 480_001, 2: 2, 3: 480_001, 4: 1}
    item = spark.createDataFrame([(7, " ".join(long.split(" ")[300_000:300_040]))], "item_id long, text string")
    assert {(r.doc_id, r.score) for r in decontamination.contaminated(spark, df, item).collect()} == {(1, 1.0), (3, 1.0)}


def test_decontamination_cuts_long_stretches_without_loss(spark):
    item = [f"i{k}" for k in range(30)]
    text = (item[:16] + ["x"]) * 400 + item
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontamination.contaminated(spark, spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), bench).collect()
    assert len(got) == 1 and got[0].score == 1.0
    items = decontamination.Items(np.array([1]), [words.Words(pa.array([" ".join(item)])).hashes()], 5, 0.5)
    w = words.Words(pa.array([" ".join(text)]))
    _, _, first, last = items.stretches(w.hashes(), w.at)
    assert len(first) > 30 and (last - first).max() <= 4 * items.span[0] and (first[1:] <= last[:-1] - items.span[0]).all()


def test_urls_on_generated_graphs_equal_union_find(spark):
    rng = random.Random(11)
    hosts = ["a.org", "b.org", "q.com", "x.net", "www.example.com", "m.example.com"]
    paths = ["/", "/en/1", "/es/2", "/fr/3", "/p", "/q"]
    pages = []
    for i in range(400):
        host, path = ("hub.org", "/") if 100 <= i < 200 else (rng.choice(hosts), f"{rng.choice(paths)}x{rng.randrange(80)}")
        to = f"http://{rng.choice(hosts)}{rng.choice(paths)}x{rng.randrange(80)}" if i % 100 < 50 else f"http://chain.org/{i + 1}"
        pages.append((i, f"http://{host}{path}" if i % 3 else f"http://chain.org/{i}", f'<link rel="canonical" href="{to}">' if rng.random() < 0.7 else None))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def rule(url):
        host, _, path = url.partition("://")[2].partition("/")
        fits = [(len(h) + len(p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    for _, url, page in pages:
        find(url)
        if page:
            target = re.search('href="([^"]*)"', page)[1]
            up[find(url)] = find(target)
    blocked = {find(u) for u in list(up) if rule(u) == "block"}
    want = {i: rule(u) or ("block" if find(u) in blocked else "allow") for i, u, _ in pages}
    got = {r.page_id: r.verdict for r in urls.judge(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want and set(want.values()) == {"allow", "block"}


def test_urls(spark):
    canonical, refresh = '<html><LINK href="/b" rel=canonical>', "<meta http-equiv='refresh' content='0; url=http://x.net/es/1'>"
    pages = [
        (1, "http://a.org/a", canonical), (2, "https://A.org/b#x", refresh), (3, "http://q.org/z", None), (4, None, None), (5, "nothing", canonical),
        (6, "https://www.example.com/en/1", refresh), (7, "http://x.net/es/1", ""), (8, "http://M.example.COM/en/?q", None), (9, "http://xcom/", None), (10, "s://shop.com#f", None),
    ]
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.org", "/a", None, "block"), 2: ("a.org", "/b", None, "block"), 3: ("q.org", "/z", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 7: ("x.net", "/es/1", "net/es/", "block"), 8: ("m.example.com", "/en/", "example.com/en/", "block"),
        9: ("xcom", "/", None, "allow"), 10: ("shop.com", "", None, "allow"),
    }
    assert urls.judge(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls_resolve_references_as_the_rfc_says(spark):
    base = "http://a/b/c/d;p?q"
    want = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
        "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
        "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g?y/./x": "http://a/b/c/g?y/./x", "/l?to=http://x/": "http://a/l?to=http://x/"}
    assert {t: urls.resolve(t, base) for t in want} == want
    link = lambda href, rel="canonical": f"<link rel='{rel}' href=\"{href}\">"
    pages = [
        (1, "http://a.org/p", link("https://x.net/es/a?page=2&amp;ref=x")), (2, "http://b.org/p", link("http://b.org/q", "alternate canonical")), (3, "http://b.org/q", link("http://x.net/es/2")),
        (4, "http://c.org/d/e", link("../f")), (5, "http://c.org/f", link("http://x.net/fr/")), (6, "http://d.org/d", link("?z=1")), (7, "http://d.org/d?z=1", "<meta http-equiv=refresh content='0; url=&quot;http://x.net/fr/9&quot;'>"),
        (8, "http://e.org/1", link("http://x.net/es/2", "noncanonical")), (9, "http://f.org/q?page=2&ref=x", link("http://x.net/es/3")), (10, "http://f.org/r", link("q?page=2&amp;ref=x")),
        (11, "http://g.org/a/../b", link("http://x.net/es/4")), (12, "http://g.org/r", link("http://g.org/a/../b")),
    ]
    got = {r.page_id: r.verdict for r in urls.judge(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: "allow" if k == 8 else "block" for k in range(1, 13)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 4)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected(spark, spark.createDataFrame(edges, "a long, b long"), store.Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for a, b in edges if a is not None and a != b for x in (a, b)}


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = encoding.default_path()
    t = Tokenizer.from_file(path)
    rows = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in wild()]
    rows.sort(key=lambda r: (-math.inf if r[0] is None else r[0], np.array(r[1], "<u2").tobytes()))
    want, at = [], 0
    for i, ids in rows:
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, at, len(ids), zlib.crc32(raw), raw))
        at += len(ids)
    token_files.write(spark, docs, f"file://{tmp_path}/c", path)
    assert [tuple(r) for r in token_files.read(spark, f"file://{tmp_path}/c").orderBy("start").collect()] == want
    token_files.write(spark, empty, f"file://{tmp_path}/e", path)
    assert token_files.read(spark, f"file://{tmp_path}/e").count() == 0


def test_ids_of_odd_texts_are_the_tokenizers():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = ["a", "É", "é", "ß", "Σ", "ς", " ", "\n", "\u2003", "<|endoftext|>", "<|", "'s", "1", "①", "\u0301", "!", "🙂", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)]
    ids, at = encoding.encoder(encoding.default_path()).encode(pa.array(texts))
    want = Tokenizer.from_file(encoding.default_path()).encode_batch(texts, add_special_tokens=False)
    assert all(w.ids == ids[a:b].tolist() for w, a, b in zip(want, at[:-1], at[1:], strict=True))


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 20_000])
def test_huffman_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 40_000).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16), 16)
    code = huffman.Code(lengths)
    data, marks = code.encode(ids)
    assert lengths.max() <= 16 and (code.decode(data, marks, n) == ids).all()


def brute_components(rows, n, num, den):
    sets = collections.defaultdict(set)
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        if w:
            sets[-math.inf if i is None else i].add(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))))
    up = {x: x for x in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {x: find(x) for x in up}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard(spark, empty, n, num, den):
    rng = random.Random(n)
    base = [[f"w{rng.randrange(900)}" for _ in range(80)] for _ in range(12)]
    rows = [r[:2] for r in wild()]
    for k in range(90):
        w = list(base[k % 12] if k % 3 else base[0])
        for _ in range(k % 4):
            w[rng.randrange(80)] = f"v{k}"
        rows.append((1000 + k, " ".join(w)))
    got = jaccard.join(spark, spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()
    roots = brute_components(rows, n, num, den)
    key = lambda i: -math.inf if i is None else i
    assert len(got) == len(rows) and all(key(r.component_id) == roots.get(key(r.doc_id), key(r.doc_id)) for r in got)
    assert jaccard.join(spark, empty, n, num, den).count() == 0


@pytest.mark.parametrize("block", [256, 7])
def test_jaccard_counts_every_link(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    base = [[f"{b}w{i}" for i in range(90)] for b in range(3)]
    rows = []
    for k in range(75):
        w = list(base[k % 3])
        if k % 5:
            w[rng.randrange(90)] = f"v{k}"
        rows.append((k, " ".join(w)))
    rows += [(200, None), (201, "one"), (202, "one")]
    sets = {i: frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset(w) for i, w in ((i, (t or "").split()) for i, t in rows)}
    want = {i: sum(bool(x) and i != j and 100 * len(x & y) >= 90 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    rows += [(300, " ".join(f"z{i}" for i in range(90))), (300, " ".join(f"z{i}" for i in range(91)))]
    got = jaccard.join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 3, 90, 100).collect()
    assert {r.doc_id: r.n_links for r in got} == want | {300: 1}


def test_rtree_loses_nothing():
    rng = np.random.default_rng(5)
    points = rng.poisson(6, (700, jaccard.GROUPS)).astype(np.int64)
    points[350:] = points[:350] + (rng.random((350, jaccard.GROUPS)) < 0.1)
    sizes = points.sum(axis=1)
    tree = jaccard.RTree(points, sizes, 90, 100)
    for i in range(0, 700, 20):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero((100 * bound >= 90 * (sizes + sizes[i] - bound)) & (100 * sizes >= 90 * sizes[i]) & (100 * sizes[i] >= 90 * sizes))
        assert sorted(tree.search(points[i], int(sizes[i])).tolist()) == want.tolist()


def brute_features(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:]))
    count = collections.Counter(grams)
    cover = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 0), (6, 7, 1)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(spark, docs, labels).collect()]
    want = []
    for r in wild():
        f = brute_features(r[1])
        bad = f[0] < 50 or 100 * f[4] > 50 * f[0]
        want.append((r[0], *f, bad, not bad))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert quality.judge(spark, empty, labels.limit(0)).count() == 0
    kept = quality.keep(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in want)


def test_cutoffs_hold_their_risk():
    assert quality.upper_bound(0, 1000, 0.05) == pytest.approx(1 - 0.05 ** (1 / 1000), abs=1e-9)
    rule = quality.RULES[0]
    rows = [{"stratum": "en", "rule": 0, "cut": c, "good": g, "bad": b} for c, g, b in ((-1, 20_000, 5), (3, 15, 10), (20, 0, 400))]
    assert quality.cutoffs(rows, 0.01, 0.95) == {"en": {"symbols": rule.grid[20]}} or quality.cutoffs(rows, 0.01, 0.95)["en"]["symbols"] >= rule.grid[3]
    assert quality.cutoffs([{"stratum": "en", "rule": 0, "cut": 20, "good": 50, "bad": 50}], 0.01, 0.95) == {}


def test_cutoffs_control_the_union_of_rules_at_few_labels(spark):
    row = lambda rule, cut, good, bad: {"stratum": "de", "rule": rule, "cut": cut, "good": good, "bad": bad}
    for n, want in ((458, {}), (459, {"de": {"symbols": quality.RULES[0].grid[20]}})):
        assert quality.cutoffs([row(0, -1, n, 5), row(0, 20, 0, 30)], 0.01, 0.95) == want
    assert quality.cutoffs([row(0, -1, 3970, 0), row(0, 20, 15, 9)], 0.01, 0.95)
    assert quality.cutoffs([row(0, -1, 3970, 0), row(0, 20, 15, 9), row(1, 20, 25, 9)], 0.01, 0.95) == {}
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=5)) + ("&&&" if i >= 470 else "") for _ in range(60)), "de") for i in range(500)]
    labels = spark.createDataFrame([(i, int(i < 470)) for i in range(485)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.judge(spark, df, labels).collect() if not r.kept} == set(range(470, 500))
    assert quality.keep(spark, df, labels).count() == 470


def test_chat_reads_back_and_checks_turns(spark):
    odd = "~0 [INST] </s> <<SYS>> ~ <s> [/INST] <<ROLE>>"
    rows = [(1, 0, "system", odd), (1, 1, "user", odd), (1, 2, "assistant", odd), (2, 0, "assistant", None), (2, 1, "tool [INST]", "x"), (2, None, None, ""), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (None, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    turns, loss = chat.read_back(F.col("formatted"), F.col("loss_spans"))
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("turns", turns).withColumn("loss", loss).collect()}
    assert [tuple(t) for t in got[1].turns] == [("system", odd), ("user", odd), ("assistant", odd)] and got[1].loss == odd and got[1].valid
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("assistant", ""), ("tool [INST]", "x")] and not got[2].valid and got[2].error_turn == 0
    assert len(got[3].turns) == 2 and got[3].error_turn == 1 and got[None].loss == ""
    assert chat.format_chats(df.limit(0)).count() == 0


def brute_align(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    best, _ = decontamination.align([a for a, _ in pairs], [b for _, b in pairs])
    assert best.tolist() == [brute_align(a.tolist(), b.tolist()) for a, b in pairs]


def test_decontamination(spark, docs, empty, monkeypatch):
    rng = random.Random(1)
    items = [(i, " ".join(f"t{rng.randrange(5000)}" for _ in range(30))) for i in range(20)] + [(90, None), (91, "too short"), (None, "x " * 30)]
    words = items[3][1].split()
    edited = [w if k % 9 else "edit" for k, w in enumerate(words)]
    leaks = [(2000, "start " + items[2][1].upper() + " end"), (2001, "start " + " ".join(edited) + " end"), (2002, " ".join(words[:8])), (2003, items[4][1] + " " + items[5][1])]
    df = docs.unionByName(spark.createDataFrame(leaks, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (1_000_000, 100):
        monkeypatch.setattr(decontamination, "CHUNK_WORDS", chunk)
        got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(spark, df, bench).collect()}
        assert set(got) == {(2000, 2), (2001, 3), (2003, 4), (2003, 5)} and got[2000, 2] == 1.0 and 0.5 <= got[2001, 3] < 1
        kept = decontamination.clean(spark, df, bench)
        assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert decontamination.contaminated(spark, empty, bench).count() == 0


def test_decontamination_equals_alignment_with_every_item(spark):
    rng = random.Random(8)
    prose = [f"p{i}" for i in range(60)]
    items = [(i if i else None, [rng.choice(prose) if rng.random() < 0.5 else f"t{rng.randrange(900)}" for _ in range(rng.choice([5, 12, 50]))]) for i in range(14)]
    items += [(50 + i, [f"s{i}{k}" for k in range(i)]) for i in (1, 2, 4)]
    texts = [[rng.choice(prose) for _ in range(80)] for _ in range(20)]
    for i, w in items:
        for every in (2, 3, 4, 5):
            texts.append(["lead", *("edit" if k % every == every - 1 else x for k, x in enumerate(w)), "tail"])
            texts.append([y for k, x in enumerate(w) for y in ([x, "put"] if k % every == every - 1 else [x])])
        texts.append([*texts[0][:30], *w, *texts[1][:30]])
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {(k, i): brute_align(w, t) / (2 * len(w)) for k, t in enumerate(texts) for i, w in items}
    want = {x: v for x, v in want.items() if v >= (0.5 if len(dict(items)[x[1]]) >= 5 else 1)}
    assert {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(spark, df, bench).collect()} == pytest.approx(want)
    assert decontamination.clean(spark, df, bench).count() == len(texts) - len({k for k, _ in want})


def test_mix(spark, docs, empty):
    got = mixing.mix(spark, docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    by = collections.defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        assert r.taken <= 3 * r["size"]
        b = by[r.source]
        b[0], b[1], b[2], b[3] = b[0] + r.taken, r.target, r.source_size, max(b[3], r["size"])
    assert all(abs(taken - target) <= largest for taken, target, _, largest in by.values())
    assert mixing.mix(spark, empty).count() == 0
    out = mixing.apply(spark, docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixing.mix(spark, docs).collect())


def test_targets_are_shared_anew_above_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, "d": 700, None: 5}
    weights = {s: 1 + k % 3 for k, s in enumerate(["a", "b", "c", "d", None])}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: weights[s] * level for s in free}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(target)


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    copy = docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    rows = docs.unionByName(copy)
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        rows = store.Scratch(spark, "t").put(stage(spark, rows, DATA), "x")
        assert rows.columns == docs.columns
        if k == 1:
            assert rows.where("doc_id >= 100000").count() == 0
    out = cp.STAGES[-1][1](spark, rows, DATA)
    assert out.count() == rows.count()


def test_near_duplicates_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline as cp

    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (9, text("e")), (4, text("e")), (8, text("f")), (8, text("f")), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in cp.near_duplicates(spark, df, DATA).collect()), key=str)
    assert got == sorted([x for x in rows if x != (9, text("e"))][:6] + rows[8:], key=str)


def test_finer_counts_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for n in (1, 2, 40, 300, 2040, 2060, 5000):
        base = list(rng.choice(words, n))
        for changes in (0, 1, n // 20, n):
            t = list(base)
            for at in rng.integers(0, n, changes):
                t[at] = str(rng.choice(words))
            texts.append(" ".join(t))
    texts.append("x " * 70000 + "y")  # a repeated shingle counts once
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rank = rng.integers(0, 200, jaccard.COUNTERS).astype(np.uint8)
    fine = jaccard.Fine(pa.chunked_array([b.column("fine") for b in jaccard._base(3, 90, 100, rank)([batch])]))
    sets = [set(s.tolist()) for s in jaccard._sets(batch, 3, rank)]
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    true = np.array([len(sets[a] ^ sets[b]) for a, b in zip(i, j, strict=True)])
    apart = fine.apart(i, fine, j)
    assert (apart <= true).all() and (apart[i == j] == 0).all()
    same = fine.kind[i] == fine.kind[j]
    assert (apart[same & (true > 0) & (true < 100)] > 0).mean() > 0.9
    bits = jaccard.Fine(pa.chunked_array([b.column("bits") for b in jaccard._base(3, 90, 100, rank)([batch])]))
    assert (bits.apart(i, bits, j) <= true).all()


def test_only_rows_that_can_have_a_partner_are_sent_and_without_counts(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):  # near copies of one text, and texts of other sizes that share its words
        w = list(base)
        for _ in range(k % 12):
            w[rng.randrange(200)] = f"v{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join([*base[:20], *(f"x{k}y{i}" for i in range(3 * 2**k))])) for k in range(9)]
    wrote, put = {}, store.Scratch.put
    monkeypatch.setattr(store.Scratch, "put", lambda self, df, name, by=None: wrote.setdefault(name, put(self, df, name, by)))
    monkeypatch.setattr(store.Scratch, "drop", lambda self, name: None)
    got = jaccard.join(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, count_links=False).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: brute_components(rows, 3, 90, 100).get(i, i) for i, _ in rows}
    assert not {"point", "bits", "fine"} & set(wrote["routed"].columns)
    assert all(r.node < 100 for r in wrote["routed"].collect())
    assert {(r.group, r.node) for r in wrote["hidden-forest"].collect()} <= {(r.group, r.node) for r in wrote["reached"].collect()}


def test_lowest_bits_fold():
    rng = np.random.default_rng(3)
    few, many = (np.packbits(rng.integers(0, 2, (5, n)).astype(np.uint8), axis=1) for n in (64, 512))
    fold = np.bitwise_xor.reduce(np.unpackbits(many, axis=1).reshape(5, 8, 64), axis=1)
    want = (fold != np.unpackbits(few, axis=1)).sum(axis=1)
    a, b = (jaccard.Fine(pa.array([r.tobytes() for r in x], pa.binary())) for x in (few, many))
    assert a.apart(np.arange(5), b, np.arange(5)).tolist() == b.apart(np.arange(5), a, np.arange(5)).tolist() == want.tolist()


def test_a_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(7)
    part = rng.integers(0, 60, (2, 300))
    keep = jaccard._forest(part[0], part[1], part[0], part[1])
    up = {x: x for x in range(60)}

    def joined(pairs):
        root = dict(up)
        for x, y in pairs:
            a, b = root[x], root[y]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        return root

    assert joined(part.T.tolist()) == joined(part.T[keep].tolist()) and keep.sum() < 60


def brute_mix(rows):
    """How often each row (id, words, source) is taken, in the order of rows."""
    size = collections.Counter()
    for i, n, source in rows:
        size[source] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, target, free = sum(size.values()), {}, set(names)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    number = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    own, out = collections.Counter(), []
    for i, n, source in rows:
        own[source, number(i)] += n
    upto = {}
    for s in names:
        run = 0
        for k in sorted(k for t, k in own if t == s):
            run += own[s, k]
            upto[s, k] = run
    for i, n, source in rows:
        whole = int(target[source] // size[source]) if size[source] else 0
        rest, u, o = target[source] - whole * size[source], upto[source, number(i)], own[source, number(i)]
        out.append((whole + (u <= rest or (u - o <= rest and u - rest < rest - (u - o)))) if n else 0)
    return out


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what its predecessor has written: nulls in every column, repeated rows and ids, long texts, clashing names, a map."""
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(40)
    texts = [text(rng.choice([10, 60, 90, 140])) for _ in range(60)] + [None, "", "x " * 90, text(4000)]
    texts += [texts[1], texts[1], texts[2] + " more", " ".join(["edit", *texts[3].split()[1:]]), f"{text(30)} {item} {text(30)}", f"{text(25)} {item.upper()} {text(25)}"]
    rows = [(i if i % 9 else None, t, rng.choice(["en", "de", None]), rng.choice(["a", "hot", "hot", None]), None if i % 5 else len(t or ""), {"k": i}, 1, "c") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (7, text(70), "en", "a", 1, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>, _row int, size string"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 50), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, scratch, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), store.Scratch(spark, "t"), str(tmp_path)
    plain = lambda df: sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r) for r in df.collect()), key=str)
    stage = dict(cp.STAGES)
    got = {}
    for name in list(stage)[:-1]:
        before, docs = docs, scratch.put(stage[name](spark, docs, d), name)
        assert docs.columns == before.columns
        got[name] = (plain(before), plain(docs))
    before, after = got["quality_rules"]
    good = lambda f: f[0] >= 50 and 100 * f[4] <= 50 * f[0]
    assert after == [r for r in before if good(brute_features(r[1]))]  # too few labels for a cutoff
    before, after = got["near_duplicates"]
    sets = [frozenset(zip(*(lower(r[1]).split()[k:] for k in range(5)))) for r in before]
    root = list(range(len(before)))
    for i, j in [(i, j) for i in range(len(before)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    groups = collections.defaultdict(list)
    for r, k in zip(before, root, strict=True):
        groups[k].append(r)
    kept = {k: [r for r in after if r in g] for k, g in groups.items()}
    assert len(after) == len(groups) and all(len(v) >= 1 and v[0][0] == min((r[0] for r in groups[k]), key=lambda x: (x is not None, x or 0)) for k, v in kept.items())
    before, after = got["benchmark_decontamination"]
    words_of = lambda r: lower(r[1]).split()
    assert after == [r for r in before if brute_align(words_of((0, lower(item))), words_of(r)) < 40] and len(after) == len(before) - 2
    before, after = got["source_mix"]
    copies = brute_mix([(r[0], len(WORD.findall(r[1])), r[3]) for r in before])
    assert after == sorted((r for r, n in zip(before, copies, strict=True) for _ in range(n)), key=str)
    t = Tokenizer.from_file(encoding.default_path())
    want = sorted(((r[0], [*t.encode(r[1], add_special_tokens=False).ids, 2]) for r in after), key=lambda x: (-math.inf if x[0] is None else x[0], np.array(x[1], "<u2").tobytes()))
    start, told = 0, []
    for i, ids in want:
        told.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in stage["token_output"](spark, docs, d).orderBy("start").collect()] == told
    empty = spark.createDataFrame([], kind)
    assert all(f(spark, empty, d).count() == 0 for f in stage.values())
