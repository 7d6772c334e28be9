"""Each operator against brute force on small tables, and the cases that it must define."""

import hashlib
import random
import tempfile
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, gif, html_text, language, minhash, mixing, quality, token_files, toxicity, url_filter
from quarry.llm.common import Words, buffers, table
from quarry.llm.tokens import Encoder, public

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean"
ODD = [
    (1, None, None, None, None, 0.5, True),
    (2, "", "en", "a", 0, 0.5, True),
    (3, " \n\t ", "en", "a", 4, None, None),
    (4, "word", None, "a", 4, 0.1, False),
    (5, "word", "en", None, 4, 0.1, False),
    (5, "word", "en", None, 4, 0.1, False),
    (6, "The quick brown fox <|endoftext|> jumps\u00a0over " * 400, "en", "b", None, 0.2, True),
    (7, "x" * 5000, "de", "b", 5000, 0.2, True),
    (None, "no id at all", "en", "b", 12, 0.2, True),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return (text or "").encode().lower().split()


def components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_word_hashes_follow_words_and_case():
    import pyarrow as pa

    w = Words()
    texts = pa.array(["A b  c", None, "", "c B a", "ab c"])
    out = [h for _, part in w.texts(*buffers(texts)) for h in part]
    assert [len(h) for h in out] == [3, 0, 0, 3, 2]
    assert out[0].tolist() == out[3][::-1].tolist() and out[4][0] != out[0][0]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 120]))] for _ in range(12)]
    texts = {}
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            t[rng.randrange(len(t))] = f"n{rng.randrange(50)}"
        texts[i * 3 + 1] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want, sizes = components(texts, k, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, k, 80).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_odd_cases(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, 2, 80).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(ODD)
    assert by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True) and by[3][1:] == (0, 3, True)
    assert by[4][1:] == (1, 4, True) and by[5][1:] == (1, 4, False) and by[None][2:] == (None, True)
    assert minhash.near_duplicates(empty, 2, 80).count() == 0


def test_a_hot_bucket_goes_on_from_task_to_task(spark):
    """Near copies whose buckets fill several tasks, beside copies, and texts that share one passage only."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(0, 400):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    for i in range(400, 460):
        texts[i] = " ".join(base[:40] + [f"y{rng.randrange(10**6)}" for _ in range(200)])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 5, 80).collect()}
    assert got == components(texts, 5, 80)[0]


def test_a_shared_passage_fills_buckets_and_hides_no_link(spark, monkeypatch):
    """Texts that share more than half their words, groups of near copies among them, most far from their bucket's pivot."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    texts = {i: passage + [f"y{rng.randrange(10**7)}" for _ in range(50)] for i in range(300)}
    for i in range(300, 420):
        words = list(texts[rng.randrange(10, 40)])
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**7)}"
        texts[i] = words
    texts = {i: " ".join(w) for i, w in texts.items()}
    again = []
    save = minhash.Scratch.save

    def noting(self, df, name):
        out = save(self, df, name)
        again.extend([out.count()] if name == "star2" else [])
        return out

    monkeypatch.setattr(minhash.Scratch, "save", noting)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2, 80).collect()}
    assert got == components(texts, 2, 80)[0]
    assert 0 < again[0] < 6000  # pairs; all texts have 87,990


def test_far_members_meet_by_a_row_for_each_rare_shingle(spark, monkeypatch):
    """Members far from their pivot have as many keys as rare shingles, whatever number of buckets they are in."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = {i: passage + [f"y{rng.randrange(25)}" for _ in range(40)] for i in range(120)}
    texts |= {i: list(texts[i - 120]) for i in range(120, 240)}
    for i in range(120, 240):
        texts[i][rng.randrange(100)] = f"x{i}"
    texts = {i: " ".join(w) for i, w in texts.items()}
    made, save = {}, minhash.Scratch.save

    def noting(self, df, name):
        out = save(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Scratch, "save", noting)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    want, sizes = components(texts, 2, 80)
    for few in (minhash.FEW, 0, 10**6):  # by the shingle alone, with the pivot where many texts hold it, and both
        monkeypatch.setattr(minhash, "FEW", few)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2, 80).collect()}
        assert got == want and 0 < made["rare"] <= sum(n - -(-80 * n // 100) + 1 for n in sizes.values())


def test_similar_sets_share_a_rare_shingle(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(14)}" for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    rows = pa.record_batch([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    batches = [b for b in minhash.counter(1)(iter([rows]))]
    counts = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], "at int, n bigint")
    rare = [set(r["rare"]) for b in minhash.rarest(1, 80, counts)(iter([rows])) for r in b.to_pylist()]
    sets = [set(t.split()) for t in texts]
    pairs = [(i, j) for i in range(300) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(pairs) > 20 and all(rare[i] & rare[j] for i, j in pairs)
    assert sum(map(len, rare)) < 0.6 * np.sum([len(s) for s in sets])


def test_pivots_of_runs_that_cross_batches_and_tasks():
    import pyarrow as pa

    rows = [(1, 5), (2, 1), (2, 3), (2, 7), (3, 2), (3, 9), (4, 4)]
    batch = lambda part: pa.record_batch([pa.array([r[k] for r in part], pa.int64()) for k in (0, 1)], names=["key", "rep"])
    for cut in range(len(rows) + 1):
        out = [tuple(r.values()) for b in minhash.pivoter()(iter([batch(rows[:cut]), batch(rows[cut:])])) for r in b.to_pylist()]
        assert sorted(r[:3] for r in out if not r[3]) == [(2, 1, 3), (2, 1, 7), (3, 2, 9)]
        assert [r[:3] for r in out if r[3]] == [(1, 5, 5), (4, 4, 4)]


@pytest.mark.parametrize("module, name", [(minhash, "op1_minhash_near_dedup"), (url_filter, "op2_url_filter")])
def test_matches_sql(spark, module, name):
    from oracle import same

    same(module.QUERIES[name](spark, SF), module.ORACLES[name], SF)


def test_url_filter_rules(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q#f", ""), (2, "https://b.example.net/fr/", ""), (3, "http://c.example.com/de/1", ""), (4, "http://org/fr/x", ""),
        (5, "no scheme", ""), (6, None, None), (7, "http://notnet/x", ""), (8, "http://x.net", ""), (9, "ftp://y.example.com?z://q", ""), (9, "ftp://y.example.com?z://q", ""),
    ]
    df = spark.createDataFrame(urls, "page_id bigint, url string, html string").withColumn("verdict", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(df, url_filter.RULES).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("b.example.net", "/fr/", "net/", "block")
    assert got[3] == ("c.example.com", "/de/1", "example.com/de/", "block")
    assert got[4] == ("org", "/fr/x", "org/fr/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2] is None
    assert got[8][:3] == ("x.net", "", None) and got[9] == ("y.example.com", "", None, "allow")
    assert url_filter.filtered(df.limit(0), url_filter.RULES).count() == 0


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = '<a href="http://{}/">x</a>'
    rows = [(1, "http://bad.test/a", ""), (2, "http://fan.test/a", link.format("bad.test")), (3, "http://good.test/a", link.format("friend.test")), (4, "http://friend.test/a", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.host: r for r in url_filter.filtered(df, [], trusted=("good.test",), blocked=("bad.test",)).collect()}
    assert got["bad.test"].verdict == "block" and got["fan.test"].verdict == "block"
    assert got["good.test"].verdict == "allow" and got["friend.test"].verdict == "allow"
    d = url_filter.DAMPING
    assert got["friend.test"].trust == got["fan.test"].distrust == pytest.approx(d / (1 + d), abs=1e-4) and got["fan.test"].trust == 0


def with_host(pages):
    return pages.withColumn("host", url_filter.host_and_path(F.col("url"))[0])


def test_parents_without_pages_are_nodes(spark):
    rows = [(1, "http://a.b.site.test/", ""), (2, "http://a.b.site.test/", ""), (3, "http://c.site.test/", ""), (4, "http://alone.test/", "")]
    edges = url_filter.host_edges(with_host(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()
    got = {(r.src, r.dst): (r.n, round(r.along, 4), round(r.against, 4)) for r in edges}
    up = {("a.b.site.test", "b.site.test"): (1, 1.0, 1.0), ("b.site.test", "site.test"): (1, 0.6667, 1.0), ("c.site.test", "site.test"): (1, 0.3333, 1.0)}
    assert got == up | {(b, a): (n, y, x) for (a, b), (n, x, y) in up.items()}
    assert url_filter.host_edges(with_host(table(spark, SF, "pages"))).count() > 0


def test_ranks_reach_the_fixed_point(spark):
    hosts = [f"h{i}.test" for i in range(31)]
    link = '<a href="http://{}/">x</a>'
    # a chain longer than 20 links, whose end links back
    rows = [(i, f"http://{h}/", link.format(hosts[(i + 1) % 31])) for i, h in enumerate(hosts)]
    rows += [(40, "http://x.a.dom.test/", link.format("h3.test") * 3), (41, "http://y.dom.test/", ""), (42, "http://y.dom.test/", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.filtered(df, [], trusted=("h0.test", "y.dom.test"), blocked=("h30.test",)).collect()}
    edges = {("h3.test", "x.a.dom.test")[::-1]: (3, 3, 3)} | {(h, hosts[(i + 1) % 31]): (1, 1, 1) for i, h in enumerate(hosts)}
    for a, b, share in (("x.a.dom.test", "a.dom.test", 1), ("a.dom.test", "dom.test", 1 / 3), ("y.dom.test", "dom.test", 2 / 3)):
        edges |= {(a, b): (1, share, 1), (b, a): (1, 1, share)}
    names = sorted({h for e in edges for h in e})
    at = {h: i for i, h in enumerate(names)}
    want = []
    for seeds, way in ((("h0.test", "y.dom.test"), 1), (("h30.test",), 2)):
        part, n = np.zeros((2, len(names), len(names)))
        for (a, b), e in edges.items():
            a, b = (a, b) if way == 1 else (b, a)
            part[at[b], at[a]], n[at[b], at[a]] = e[way], e[0]
        system = np.eye(len(names)) - url_filter.DAMPING * part / np.maximum(n.sum(axis=0), 1)
        want.append(np.linalg.solve(system, np.array([float(h in seeds) for h in names])) / np.linalg.solve(system, np.ones(len(names))))
    assert len(got) == 33
    for h, ranks in got.items():
        assert ranks == pytest.approx((want[0][at[h]], want[1][at[h]]), abs=2e-3)
    assert got["h25.test"][0] > 0


def test_url_verdicts_of_pages_by_dense_iteration(spark):
    """The whole query over the pages of the smallest tables, with links between hosts added, in plain numpy."""
    pages = [(r.page_id, r.url, r.html) for r in table(spark, SF, "pages").collect()]
    # hosts without a rule that link to blocked ones, so that their distrust decides
    links = "".join(f'<a href="http://bad{k}.net/">b</a>' for k in range(4))
    pages += [(1000 + k, f"http://bad{k}.net/x", "") for k in range(4)] + [(1010 + k, f"http://fan{k}.test/x", links) for k in range(3)]
    parsed = []
    for i, u, html in pages:
        rest = u.split("://", 1)[1]
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        parsed.append((i, host, max(fits)[2] if fits else None, [x.split("//")[1].split("/")[0].split('"')[0].lower() for x in html.split("<a ")[1:] if 'href="http' in x.split(">")[0]]))
    count = {}
    for _, h, _, _ in parsed:
        count[h] = count.get(h, 0) + 1
    below, edges = {}, {}
    for h, n in count.items():
        parts = h.split(".")
        for k in range(max(1, len(parts) - 1)):
            name = ".".join(parts[k:])
            below[name] = below.get(name, 0) + n
    for h, n in below.items():
        if h.count(".") >= 2:
            up = h.split(".", 1)[1]
            for a, b, x, y in ((h, up, n / below[up], 1), (up, h, 1, n / below[up])):
                e = edges.setdefault((a, b), [0, 0, 0])
                e[0], e[1], e[2] = e[0] + 1, e[1] + x, e[2] + y
    for _, h, _, links in parsed:
        for b in links:
            if b != h:
                e = edges.setdefault((h, b), [0, 0, 0])
                e[0], e[1], e[2] = e[0] + 1, e[1] + 1, e[2] + 1
    names = sorted({*below, *(x for e in edges for x in e), *count})
    at = {h: k for k, h in enumerate(names)}
    share = lambda h, v: sum(x[1] == h and x[2] == v for x in parsed) / count[h] if h in count else 0
    score = {}
    for way, verdict in ((1, "allow"), (2, "block")):
        flow, n = np.zeros((len(names), len(names))), np.zeros(len(names))
        for (a, b), e in edges.items():
            a, b = (a, b) if way == 1 else (b, a)
            flow[at[b], at[a]] += e[way]
            n[at[a]] += e[0]
        rank, mass, seed = np.zeros(len(names)), np.zeros(len(names)), np.array([share(h, verdict) for h in names])
        for _ in range(200):
            rank, mass = seed + url_filter.DAMPING * flow @ (rank / np.maximum(n, 1)), 1 + url_filter.DAMPING * flow @ (mass / np.maximum(n, 1))
        score[verdict] = rank / mass
    want = {i: v or ("block" if score["block"][at[h]] - score["allow"][at[h]] > url_filter.MARGIN else "allow") for i, h, v, _ in parsed}
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filtered(df, url_filter.RULES).collect()}
    assert got == want
    assert sum(v is None and want[i] == "block" for i, _, v, _ in parsed) >= 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(public(name)), Encoder(public(name))
    texts = ["", " ", "  a  b ", "a\n\n b", " it's 'S don't", "<|endoftext|> x<|endoftext|>", "x\x1cy \x1c z", "é e\u0301 ẞ İ", "日本 12 345", "a<|startoftext|>b c", "\t x\r\n y"] + [t for _, t, *_ in ODD if t]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, mine.dtype).tolist() for b in mine.encode(texts)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_keeps_line_breaks(name):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(public(name)), Encoder(public(name))
    texts = ["one two\nthree four.\nFive", "a b\n", "a b\n\nc d\n\n\n", "a \nb c\n d", "a b\t\nc", "a é!\nè's b", "\na b", "a -\n- b", "x y\n'll z\n1 2\n.", "x y\u2003\nz w\x85\nv", "a " + "b" * 70 + "\nc"]
    assert [np.frombuffer(b, mine.dtype).tolist() for b in mine.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_of_a_column_equals_library():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(public("byte_bpe_50k.json")), Encoder(public("byte_bpe_50k.json"))
    some = random.Random(7)
    bits = ["the", "The", "é", "straße", "日本", "12", "'s", "'ll", "don't", "x–y", "–", "<|endoftext|>", "<|", "|>", "|", ",", "...", "\U0001f600", "e\u0301", "\0", "y" * 70, "=" * 70]
    gaps = [" "] * 40 + ["\n"] * 15 + ["", "", "  ", "\n\n", " \n", "\n ", "\t", "\n\t", "\r\n", "\x1c", "\x85", "\u00a0", "\n\u2003", "\u2003", "\n\n\n", "\u2028"]
    texts = ["", " ", "\n", "\n\n", " a", "\na", "a\n", "a ", "a\n\nb c", "\n\nb c", "a\n b", "a\n\u2003b"] + [t for _, t, *_ in ODD if t]
    texts += ["".join(some.choice(bits) + some.choice(gaps) for _ in range(some.randint(1, n))) for n in (3, 12, 40) for _ in range(700)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for lot in ([slice(i, i + 100) for i in range(0, len(texts), 100)], [slice(None)]):
        got = [b for s in lot for b in mine.column(pa.array(texts).slice(s.start or 0, 100 if s.start is not None else None))]
        assert [np.frombuffer(b, mine.dtype).tolist() for b in got] == want
    assert mine.column(pa.array([], pa.string())) == [] and mine.column(pa.array(["", ""])) == [b"", b""]


def test_token_files_learn_a_word_once(monkeypatch):
    """Plain texts reach Python as words that are new to the process, once each, not text by text."""
    monkeypatch.setattr("quarry.llm.tokens._MEMORIES", {})
    monkeypatch.setattr(token_files, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    learned, encoded = [], []
    learn, encode = Encoder._learned, Encoder.encode
    monkeypatch.setattr(Encoder, "_learned", lambda self, words: learned.extend(words) or learn(self, words))
    monkeypatch.setattr(Encoder, "encode", lambda self, texts: encoded.extend(texts) or encode(self, texts))
    with tempfile.TemporaryDirectory() as top:
        batch = pa.record_batch({"doc_id": [1, 2, 3], "text": ["One two, three.\nTwo two; two", "a two three\n\nTwo", None]})
        list(token_files._writer(top, public("byte_bpe_50k.json"), 0, 64, 4)(iter([batch, batch])))
    assert sorted(learned) == ["\nTwo", "three", "two"] and encoded == []


def test_folded_texts_have_the_same_ids():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(public("word_bpe_49k.json")), bpe.Chunks(public("word_bpe_49k.json"))
    plain = ["The Cat, THE cat; the CAT...", "Don't, DON'T! we'LL' it's'S O'Re.", "ÀÉ Éa, ŐŰ\" ǅa ǄB Ŋx ªº ß", "A--B x?! --y-- 12A3, (Q)"]
    odd = ["<|ENDOFTEXT|> A<|endoftext|>", "H\u0331 Ab E\u0301", "İI ΑΣ Σ. Ǆ\u0301"]
    texts = plain + odd + [" ".join(chr(c) + "A, " + chr(c).upper() for c in range(0xA1, 0x250))]
    assert [mine.folded(t.encode()) == t.encode().lower() for t in plain + odd] == [True] * 4 + [False] * 3
    for t in texts:
        pieces = mine.folded(t.encode()).split()
        assert np.frombuffer(mine.of(pieces), mine.dtype).tolist() == library.encode(t, add_special_tokens=False).ids
        ids = np.array(library.encode(t, add_special_tokens=False).ids, mine.dtype)
        assert mine.decoded(ids) == library.decode(ids.tolist(), skip_special_tokens=False).encode()


def test_chunks_are_listed_once(spark, monkeypatch):
    """Each text is cut and hashed once for the list of chunks, however often that is read."""
    calls = spark.sparkContext.accumulator(0)
    listing = bpe._listing

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield from listing(iter([b]))

    monkeypatch.setattr(bpe, "_listing", counted)
    df = spark.createDataFrame([(i, f"text {i % 3} " * 300) for i in range(10)], "doc_id bigint, text string")
    assert bpe.encoded(df, public("word_bpe_49k.json")).count() == 10 and calls.value == 10


def test_bpe_equals_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    shared = " ".join(f"passage{i % 37} of{i % 11}" for i in range(900))
    rows = [(i, f"{'head ' * i}{shared} tail{i}") for i in range(6)] + [(50, shared), (51, shared), (52, "y" * 4000 + shared)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text")).withColumn("ids", F.lit(1))
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(df, path).collect())

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert got == sorted(want(r.doc_id, r.text) for r in df.collect())
    assert bpe.encoded(empty, path).count() == 0


def test_chunks_are_cut_alike_wherever_they_stand():
    rng = np.random.default_rng(3)
    body = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    mine = lambda pre: {(pre + body)[a:b] for a, b in zip(bpe.cuts(pre + body), bpe.cuts(pre + body)[1:])}
    a, b = mine(b""), mine(b"some other beginning ")
    assert len(a & b) >= len(a) - 3 and len(a) > 20
    assert bpe.cuts(b"") == [0]


def test_quality_counts_by_brute_force(spark, odd, empty):
    repeat = "a b c d e f g h i j"
    texts = {10: f"{repeat} x {repeat}", 11: "one\ntwo\none\n\n", 12: "# $ %\n", 13: " ".join(map(str, range(60))), 14: "same " * 40}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "kept": F.lit(0)})
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    for i, t in texts.items():
        w = t.split()
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {p for k, x in enumerate(win) if win.count(x) > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), len("".join(w)), len(cover))
        assert got[i].n_dup_lines == len(lines) - len(set(lines)) and got[i].n_symbols == sum(map(t.count, "#*$%&|<>"))
    assert got[13].kept and not got[14].kept
    assert quality.judged(odd).count() == len(ODD) and quality.judged(empty).count() == 0
    assert quality.passing(df).columns == df.columns


def test_quality_limits_follow_their_group(spark):
    """Two sources of different spread have different limits; what one does often is odd in the other."""
    rng, rows = np.random.default_rng(4), []
    for source, usual in (("prose", 0.002), ("code", 0.08)):
        for i in range(400):
            words = [f"w{k}" for k in rng.integers(0, 10_000, 200)]
            marks = rng.poisson(usual * 900 * rng.uniform(0.5, 1.5))
            rows.append((len(rows), " ".join(words) + " " + "$" * int(marks), "en", source))
    odd_ = " ".join(f"v{k}" for k in range(200)) + " " + "$" * 90
    rows += [(9001, odd_, "en", "prose"), (9002, odd_, "en", "code"), (9003, odd_, "en", "new"), (9004, odd_, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    limits = {r.source: r for r in quality.thresholds(quality.with_shares(quality.with_counts(df))).collect()}
    assert limits["code"].max_symbol_share > 3 * limits["prose"].max_symbol_share
    assert limits["prose"].max_symbol_share < limits["new"].max_symbol_share and limits[None].n_documents == 1
    got = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert not got[9001] and got[9002]
    assert np.mean([got[r[0]] for r in rows[:800]]) > 0.97


def test_quality_matches_sql(spark):
    from oracle import same

    same(quality.op4_quality_rules(spark, SF), quality.ORACLE, SF)


def test_html_blocks_and_text(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><!-- x --><article><h1>Head &amp; line</h1><p>One\n two<br>three <b>four</b><p>Five &lt;6&gt;</article><div class='ad'>Buy</div><footer>&copy; x</footer>"
    assert [b.text for b in html_text.blocks(page)] == ["T", "Home", "Head & line", "One two three four", "Five <6>", "Buy", "© x"]
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<p>" + "word " * 30_000 + "</p>"), (5, "u", "<")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    labeller = html_text.fit(df, made=150)
    got = {r.page_id: r for r in html_text.extracted(df, labeller).collect()}
    assert got[1].text == "Head & line\n\nOne two three four\n\nFive <6>" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].n_blocks == 0 and got[5].text == ""
    rng, wrong = np.random.default_rng(77), 0
    for _ in range(60):
        p = html_text.blocks(html_text.made_page(rng))
        o = labeller.odds([html_text.vectors([html_text.Block(b.path, b.text.replace("\x01", "") or "-", b.linked) for b in p], Words())])[0]
        wrong += any((x > 0) != ("\x01" in b.text) for x, b in zip(o, p))
    assert wrong <= 6


def test_html_text_of_pages_is_their_article(spark):
    """Over the pages of the tables: what stands in the article, read by Python's own parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out, self.held = [], [], []

        def flush(self):
            t = " ".join("".join(self.held).split())
            self.out += [t] if t and "article" in self.open and not {"nav", "aside", "footer", "form", "div"} & set(self.open[self.open.index("article") :]) else []
            self.held = []

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1", "h2", "article", "div", "nav", "aside", "footer", "header", "li", "ul", "section", "form"):
                self.flush()
                while tag in ("p", "div", "aside") and "p" in self.open:
                    self.open.remove("p")
                self.open.append(tag)

        def handle_endtag(self, tag):
            if tag in self.open:
                self.flush()
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

        def handle_data(self, data):
            self.held.append(data)

    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_text.extracted(pages, html_text.fit(pages)).collect()}
    want = {}
    for r in pages.collect():
        p = Article()
        p.feed(r.html)
        p.flush()
        want[r.page_id] = "\n\n".join(p.out)
    assert [i for i in want if got[i] != want[i]] == []


def test_html_text_around_and_in_embedded_elements_stays():
    cut = lambda page: [b.text for b in html_text.blocks(page)]
    assert cut('<article><p>one</p><svg class="i"/><p>two</p><p>three <svg><path d="x"/></svg>four</p></article>') == ["one", "two", "three four"]
    assert cut("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert cut("<p>a</p><object data=x><p>b</p></object><noscript>c</noscript><iframe src=x /><p>d</p><video>e</video>") == ["a", "b", "c", "d", "e"]
    assert cut("<style-guide>a</style-guide><p>b</p><script>c</script><template>d</template><style>e") == ["a", "b"]
    assert cut("<p>if x < 5 then y") == ["if x < 5 then y"] and cut("<p>a <b") == cut("<p>a </") == cut("<p>a <!-") == ["a"]


BAD = ["<script ", "<b ", '<a "', "<div>", "<div>x", "<!", "<!--", "<a<", '<a<" ', "</", "&#1", "<ul><p>", "<script>", "</script", "<a ' \"", '<p class="']


@pytest.mark.parametrize("piece", BAD)
def test_broken_pages_are_cut_in_linear_time(piece):
    """A page of 1 MB each, also with an end that some quote or tag may reach."""
    page = (piece * (1 + 1_000_000 // len(piece)))[:1_000_000]
    for end in ("", ">", "\"> <p>last"):
        began = time.process_time()
        html_text.blocks(page + end)
        assert time.process_time() - began < 8  # a quadratic scan takes hours


def test_html_text_of_a_broken_page_goes_on():
    cut = lambda page: [b.text for b in html_text.blocks(page)]
    assert cut("<p>a <b \" c</p><p>d</p>") == ['a <b " c', "d"]
    assert cut("<p>x<ref=\"/a\">y</p>") == ["x", "y"] and cut("a&#" + "9" * 9000 + ";b&#x" + "f" * 9000 + ";c") == ["a\ufffdb\ufffdc"]
    assert cut("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    deep = html_text.blocks("<div>" * 50_000 + "x")[0]
    assert len(deep.path) == 50_000 and cut("<p>x<!-- y") == ["x"]


def test_html_of_an_empty_table_and_of_a_long_page(spark):
    schema = "page_id bigint, url string, html string, text int"
    long = "<article>" + "<p>Some words of a long page, more than one.</p>" * 20_000 + "</article>"
    labeller = html_text.fit(spark.createDataFrame([], schema), made=150)
    assert html_text.extracted(spark.createDataFrame([], schema), labeller).count() == 0
    row = html_text.extracted(spark.createDataFrame([(1, None, long, 1)], schema), labeller).head()
    assert row.url is None and row.n_blocks > 19_000 and row.n_chars == len(row.text)


def test_html_paths_hold_every_name():
    page = html_text.blocks('<section class="mt-4 px-2 flex items-center md-grid w-full comments"><p>x</p></section>')
    assert ".comments" in page[0].path and page[0].path.count(".full") == 1


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 3000, bytes(range(256)) * 40, random.Random(1).randbytes(40_000)])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_gif_disposal_transparency_and_interlace():
    import struct

    table = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])

    def image(samples, left, top, w, h, disposal, clear=None, interlaced=False):
        control = disposal << 2 | (clear is not None)
        return b"\x21\xf9\x04" + struct.pack("<BHB", control, 7, clear or 0) + b"\0\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + table
    data = head + image([0, 0, 0, 0], 0, 0, 2, 2, 1) + image([1, 2], 0, 0, 2, 1, 3, clear=2) + image([2], 1, 1, 1, 1, 2) + image([3], 0, 0, 1, 1, 0) + b"\x3b"
    frames = list(gif.decode(data))
    px = lambda f: [tuple(p) for p in f.canvas.reshape(4, 4).tolist()]
    red, green, blue, none, grey = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0), (9, 9, 9, 255)
    assert px(frames[0]) == [red] * 4
    assert px(frames[1]) == [green, red, red, red]  # clear index 2 leaves the pixel
    assert px(frames[2]) == [red, red, red, blue]  # the frame before was undone
    assert px(frames[3]) == [grey, red, red, none]  # the frame before was cleared
    assert frames[0].delay_cs == 7
    tall = b"GIF89a" + struct.pack("<HHBBB", 1, 5, 0x81, 0, 0) + table + image([0, 1, 2, 3, 0], 0, 0, 1, 5, 0, interlaced=True) + b"\x3b"
    assert [tuple(p[0]) for p in next(gif.decode(tall)).canvas.tolist()] == [red, grey, blue, red[:0] + red, green][:0] + [tuple(table[3 * i : 3 * i + 3]) + (255,) for i in (0, 3, 2, 0, 1)]
    assert list(gif.decode(data[:60])) is not None
    with pytest.raises(ValueError):
        next(gif.decode(b"PNG"))


def test_broken_and_boundless_gifs_are_null(spark):
    import struct

    good = gif.payload_gif(b"abc" * 64)
    at = 13 + 768 + 8 + 10  # header, palette, control and box come before the code size
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x81, 0, 0) + good[13:]
    media = [(1, 192, good), (2, 0, good[:at] + b"\0" + good[at + 1 :]), (3, 0, good[:at] + b"\x0c" + good[at + 1 :]), (4, 0, huge), (5, 0, b""), (6, 0, None), (7, 192, good[:-20])]
    got = {r.doc_id: r for r in gif.described(spark.createDataFrame(media, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert got[1].payload == b"abc" * 64 and got[6].media_bytes is None
    assert all(got[i].payload is None and not got[i].frames for i in (2, 3, 4, 5, 6)) and len(got[7].payload) == 192


def test_media_query_columns(spark):
    got = {r.doc_id: r for r in gif.op6_media_gif(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        p = gif.padded((r.text or "").encode())
        g, m = got[r.doc_id], gif.payload_gif(p)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        assert g.feature == ",".join(map(str, np.bincount(np.frombuffer(p, np.uint8) >> 4, minlength=16)))


def test_media_round_trip(odd, empty):
    got = gif.described(gif.stored(odd)).collect()
    want = {r[0]: gif.padded((r[1] or "").encode()) for r in ODD}
    assert len(got) == len(ODD) and all(r.payload == want[r.doc_id] for r in got)
    assert all(sum(sum(f.histogram[:16]) for f in r.frames) == len(r.payload) for r in got)
    assert gif.described(gif.stored(empty)).count() == 0


def test_token_files(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/tokens"
    files = token_files.write_token_files(odd, path, public("byte_bpe_50k.json"), length=64, rows=4)
    got = sorted(((r.doc_id or -1, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files, path).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t in sorted(((r[0] or -1, r[1] or "") for r in ODD)):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    for f in files.collect():
        blocks = list(token_files.read_sequences(f"{path}/{f.file}.arrows"))
        assert all(ids.shape[1] == 64 and ids.base is not None for ids, _ in blocks)
        assert sum(int(np.unpackbits(m).sum()) for _, m in blocks) == f.n
        whole = [(i, m) for ids, mask in blocks for i, m in zip(ids, mask)]
        for k, (ids, mask) in enumerate(whole):
            one, bits = token_files.sequence(f"{path}/{f.file}.arrows", k)
            assert (one == ids).all() and (bits == mask).all() and not one.flags.owndata
        for k in (-1, len(whole), len(whole) + 1000):
            with pytest.raises(IndexError):
                token_files.sequence(f"{path}/{f.file}.arrows", k)
    other = f"file://{tmp_path}/none"
    assert token_files.read_token_files(token_files.write_token_files(empty, other, public("byte_bpe_50k.json")), other).count() == 0


def test_mixing_fills_siblings_before_ancestors(spark):
    rows = [("d0", "en", "a", 100), ("d0", "en", "b", 1000), ("d0", "de", "c", 50), ("d1", "en", "d", 5000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint")
    got = {r.source: r.budget for r in mixing.budgets(leaves, {"domain": {"d0": 1, "d1": 1}}, 0.2, 1).collect()}
    assert got == {"a": 100, "b": 465, "c": 50, "d": 615}


def test_mixing_matches_sql_and_odd_cases(spark, odd, empty):
    from oracle import same

    same(mixing.op8_mixing(spark, SF), mixing.ORACLES["op8_mixing"], SF)
    assert mixing.mixed(empty).count() == 0
    assert set(mixing.mixed(odd, share=2.0).columns) >= set(odd.columns)
    assert mixing.mixed(odd, share=2.0).count() == 2 * len(ODD)


def test_language_accuracy_and_odd_cases(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.fit(docs)
    got = language.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    out = got.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    rows = {r.doc_id: r for r in language.identified(odd, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert language.identified(empty, language.fit(empty)).count() == 0


def test_language_votes_by_hand(spark):
    """Trigrams, families and pairs of a few texts in plain loops; repeated rows are predicted alike."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) BETWEEN 40 AND 1500").limit(25).collect()]
    got = [(r.doc_id, r.lang_pred) for r in language.identified(spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string"), model).collect()]
    assert len(got) == 30 and len(set(got)) == 25

    def fold(b):
        return b - 97 + 2 if 97 <= b <= 122 else b - 65 + 2 if 65 <= b <= 90 else b - 128 + 28 if b >= 128 else 1

    for i, text in rows:
        c, count = [1, *map(fold, text.encode()), 1], {}
        for a, b, d in zip(c, c[1:], c[2:]):
            if b > 1 or (a > 1 and d > 1):
                k = ((((a * 160 + b) * 160 + d) * 2654435761) % 2**32) >> 20
                count[k] = count.get(k, 0) + 1
        norm = sum(count.values()) ** 0.5
        score = lambda w: sum(float(w[k]) * n**0.5 / norm for k, n in count.items()) + float(w[-1])
        family = max(model.families, key=lambda f: score(model.of_family[model.families.index(f)]))
        votes = dict.fromkeys(model.members[family], 0.0)
        for (a, b), w in model.pairs.items():
            if a in votes:
                votes[a if score(w) > 0 else b] += 1
        assert dict(got)[i] in [c for c, v in votes.items() if v == max(votes.values())]


def test_every_language_is_learned_and_the_sample_is_bounded(spark, monkeypatch):
    rng, rows = np.random.default_rng(6), []
    for k in range(26):
        letters = [chr(0x400 + 8 * k + j) for j in range(8)]
        for i in range(12 if k < 25 else 9):
            rows.append((100 * k + i, " ".join("".join(rng.choice(letters, 5)) for _ in range(30)), f"q{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sizes, made = [], language.Model
    monkeypatch.setattr(language, "Model", lambda x, langs: sizes.append(langs) or made(x, langs))
    model = language.fit(docs)
    got = {r.doc_id: r.lang_pred for r in language.identified(docs, model).collect()}
    assert {c for m in model.members.values() for c in m} == {r[2] for r in rows}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95
    language.fit(docs, most=60)
    assert len(sizes[1]) == 52 and len(set(sizes[1])) == 26


def test_segments_equal_brute_force():
    rng = np.random.default_rng(2)

    def maximal(s, a, b):
        """Ruzzo and Tompa's definition, by recursion on the best segment."""
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, i, j = max(((sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda t: (round(t[0], 9), t[1]))
        return maximal(s, a, i) + [(i, j)] + maximal(s, j, b)

    for _ in range(40):
        s = np.round(rng.normal(-0.3, 1, 14), 3)
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == maximal(s.tolist(), 0, len(s))


def test_segments_take_linear_time():
    import time

    def seconds(n):
        s = np.full(4 * n, -0.9)
        s[::4] = np.linspace(1, 2, n)  # hits further apart than their weight, each above the last
        t = time.process_time()
        assert len(toxicity.segments(s)) == n
        return time.process_time() - t

    seconds(1000)
    assert seconds(64_000) < 2


def test_toxicity_scores_by_hand(spark):
    """The whole score of short texts from the model's weights, without the package's scan."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit(docs, labels)
    weight, notable = dict(zip(model.buckets.tolist(), model.weights.tolist())), dict(zip(model.buckets.tolist(), model.notable.tolist()))
    some = docs.where("length(text) < 3000").limit(40)
    got = {r.doc_id: r for r in toxicity.scored(some, model).collect()}
    words = Words(toxicity.GAPS, toxicity.SEED, toxicity.PREFIXES)
    for r in some.collect():
        raw = r.text.encode()
        (_, (features,)), = words.texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        s = []
        for f in toxicity._buckets(features).tolist():
            best = max(f, key=lambda b: notable.get(b, 0.0))
            s.append(weight.get(best, -toxicity.DRIFT) if notable.get(best, 0.0) else -toxicity.DRIFT)
        found, rest = [], [(0, len(s))]
        while rest:  # the best segment, then the same on either side of it
            a, b = rest.pop()
            top, low, at, here = (0.0, a, a), 0.0, a, 0.0
            for i in range(a, b):
                here += s[i]
                if here - low > top[0] + 1e-9:
                    top = (here - low, at, i + 1)
                if here < low:
                    low, at = here, i + 1
            if top[0] > 0:
                found.append(top[0])
                rest += [(a, top[1]), (top[2], b)]
        assert got[r.doc_id].score == pytest.approx(model.score(model.significance(found, len(s))), abs=1e-6)


def test_memory_of_word_hashes_is_bounded():
    """However many texts a batch has, what is in memory at once follows ``BLOCK``."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(2500)]
    batch = pa.record_batch([pa.array(texts), pa.array([0] * len(texts), pa.int32())], names=["text", "toxic"])
    tracemalloc.start()
    n = sum(b.num_rows for b in toxicity._counts(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and most < 64 << 20  # 150 MB and more in blocks of 2 MB


def test_toxicity_held_out_and_odd_cases(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert out[out.toxic == 1].predicted.mean() >= 0.9 and out[out.toxic == 0].predicted.mean() < 0.02
    rows = {r.doc_id: r for r in toxicity.scored(odd, model).collect()}
    assert rows[1].score == rows[2].score and rows[1].predicted == 0 and 0 <= rows[6].score <= 1
    assert toxicity.clean(odd, model).columns == odd.columns and toxicity.clean(odd, model).count() == len(ODD)
    assert toxicity.scored(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
