"""Hard negatives, vector codes and archives against brute force, and the cases that they must define."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from quarry.llm import hard_negatives, vector_codes, warc
from quarry.llm.vectors import integers

SF = "/root/testdata/sf0.001"
VECS = "vec_id bigint, embedding array<float>, label int, score double, rank string, slot int"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0.5, "x", 1) for i, v, lab in rows], VECS)


def drawn(n, dims=6, seed=3, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(labels, dims))
    kinds = rng.choice(labels, n, p=[0.4] + [0.6 / (labels - 1)] * (labels - 1))
    vecs = np.round(base[kinds] * 0.6 + rng.normal(size=(n, dims)) * 0.4, 1)
    return [(i, v, int(k)) for i, (v, k) in enumerate(zip(vecs.astype(np.float32).tolist(), kinds))]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def mined_plainly(rows, anchors, low=30, high=90):
    rows = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in usable(rows) if k is not None and i is not None]
    out = []
    for i, v, k in rows:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in rows)
        for p, j, m in [s for s in scored if s[2] == k and s[1] != i][:5]:
            fits = [s for s in scored if s[2] != k and low * -p <= 100 * -s[0] <= high * -p][:10]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("a_round", [8192, 7])
def test_hard_negatives_equal_brute_force(spark, a_round, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "FIRST", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    # ties by the hundred: coarse components, one vector that many rows share
    rows = drawn(400) + [(i, [0.5] * 6, i % 3) for i in range(1000, 1150)]
    got = hard_negatives.mined(frame(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, anchors_a_round=a_round)
    assert sorted(map(tuple, got.collect())) == mined_plainly(rows, lambda i: i % 20 == 0)


def test_hard_negatives_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (1, [0.9, 0.1], 1), (0, [1.0, 0.0], 1), (2, [0.5], 2), (3, [0.6, 0.2], 2), (3, [0.6, 0.2], 2),
        (4, None, 2), (5, [0.5, None], 2), (6, [NAN, 0.5], 2), (7, [INF, 0.5], 2), (8, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (9, [], 3), (100, [], 4),
    ]
    got = sorted(map(tuple, hard_negatives.mined(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()))
    assert got == mined_plainly([(i, v and v + [0.0] * (2 - len(v)) if v is not None else v, k) for i, v, k in rows], lambda i: i % 100 == 0)
    assert {r[1] for r in got} == {1} and {r[3] for r in got} == {2, 3} and len(got) == 2 * 2 * 3
    none = hard_negatives.mined(frame(spark, []), F.col("vec_id") % 100 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_products_are_exact_beyond_doubles():
    a = integers_of([[3e5, 1.0], [2.0, -7e5]])
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in a] for r in a]
    assert hard_negatives.products(a, a).tolist() == want and max(map(max, want)) > 1 << 53
    score = np.array([-250, -1, 0, 1, 99, 100, 101, 1 << 61])
    assert hard_negatives.percent(90, score).tolist() == [90 * int(s) // 100 for s in score]


def integers_of(rows):
    import pyarrow as pa

    return integers(pa.array(rows, pa.list_(pa.float64())), len(rows[0]), 256, hard_negatives.cap(len(rows[0])))


def coded_plainly(rows, entries, rounds=4, parts=4):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(x) // len(x) for x in zip(*own)] if (own := [c[p] for c, m in zip(cut, mine) if m == i]) else e for i, e in enumerate(books[p])]
    out = []
    for (i, _, k), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, k, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("dims", [8, 6])
def test_vector_codes_equal_a_plain_computation(spark, dims, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    monkeypatch.setattr(vector_codes, "STEP", 16)
    rows = drawn(300, dims) + [(500 + i, [0.25] * dims, None) for i in range(150)] + [(None, [0.1] * dims, 1), (3, [0.3] * (dims - 1), 2)]
    rows += [(900, None, 1), (901, [NAN] * dims, 1), (902, [None] * dims, 1), (903, [-INF] * dims, 1)]
    codes, books = vector_codes.quantised(frame(spark, rows).repartition(3), entries=20)
    want, sha = coded_plainly(rows, 20)
    assert sorted(map(tuple, codes.collect()), key=str) == want
    assert vector_codes.digest(books) == sha


def test_vector_codes_of_large_components_few_rows_and_none(spark):
    rows = [(1, [3e5, -3e5, 1.0, 0.5], 1), (2, [2e5, 0.0, 1.0, 0.5], 1), (3, [-3e5, 3e5, 9.0, 0.25], 2)]
    codes, books = vector_codes.quantised(frame(spark, rows), rounds=2)
    want, sha = coded_plainly(rows, 256, rounds=2)
    assert sorted(map(tuple, codes.collect()), key=str) == want and vector_codes.digest(books) == sha and books.shape == (4, 3, 1)
    codes, books = vector_codes.quantised(frame(spark, [(1, None, 1)]))
    assert codes.count() == 0 and books.size == 0
    assert [tuple(r) for r in vector_codes.quantised(frame(spark, [(1, [], 1)]))[0].collect()] == [(1, 1, "00000000", 0)]


@pytest.mark.parametrize("module, name", [(hard_negatives, "op11_hard_negatives"), (vector_codes, "op12_vector_codes"), (warc, "op13_warc")])
def test_matches_sql(spark, module, name):
    same(module.QUERIES[name](spark, SF), module.ORACLES[name], SF)


PAGES = "page_id bigint, url string, html string, digest string, first bigint, records int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 7, 7) for i, u, h in rows], PAGES)


def archived(spark, rows, path, split=None, **how):
    archives = warc.write_warc(pages(spark, rows), path, **how)
    files = archives.where("records > 0").select(F.concat(F.lit(f"{path}/"), "file").alias("path"), F.col("bytes").alias("length"))
    return files, warc.read_warc(files, split)


@pytest.mark.parametrize("split", [None, 150, 1000])
def test_archives_of_odd_pages(spark, tmp_path, split):
    long = "page with ünïcode \r\n\r\nWARC/1.1\r\n" * 20
    rng = random.Random(5)
    huge = "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(300_000 if split is None else 3000))
    rows = [(5, "http://a.b/c d\r\nX: y", long), (3, "http://b", long), (9, None, long), (None, "http://n", long), (3, "http://b", long)]
    rows += [(1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", huge), (None, None, "z" * 200), (None, None, "z" * 200)]
    _, read = archived(spark, rows, str(tmp_path / "w"), split)
    got = sorted((tuple(r) for r in warc.digests(read).collect()), key=str)

    def want(i, html):
        raw = (html or "").encode()
        first = {long: 3}.get(html)
        revisit = first is not None and i != first
        return i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None

    assert got == sorted((want(i, h) for i, _, h in rows), key=str)
    texts = {r.record_id: r for r in read.collect()}
    assert texts["<urn:page:7>"].payload.decode() == huge and texts["<urn:page:5>"].target_uri == "http://a.b/c%20d%0D%0AX:%20y"
    assert texts["<urn:page:9>"].target_uri is None and texts["<urn:page:9>"].refers_to == "<urn:page:3>"


def test_no_pages(spark, tmp_path):
    files, read = archived(spark, [], str(tmp_path / "w"))
    assert files.count() == 0 and read.count() == 0


def other(block: bytes, kind="resource", stored=False) -> bytes:
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:x>\r\nContent-length:{len(block)}\r\n\r\n".encode()
    return gzip.compress(head + block + b"\r\n\r\n", 0 if stored else 6)


def named(spark, path):
    return warc.listed(spark, str(path)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


@pytest.mark.parametrize("split", [90, 1000, 1 << 20])
def test_an_archive_within_a_payload_is_not_split_off(spark, tmp_path, split):
    inner = b"".join(other(b"inner %d" % i * 9) for i in range(12))
    outer = [other(b"first"), other(inner, stored=True), other(b"between"), other(inner * 3, stored=True), other(b"last")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(outer))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = warc.read_warc(named(spark, tmp_path), split).orderBy("start").collect()
    assert [bytes(r.payload) for r in got] == [b"first", inner, b"between", inner * 3, b"last"]
    assert [r.end for r in got] == np.cumsum([len(x) for x in outer]).tolist()


@pytest.mark.parametrize("split", [100, 500, 1 << 20])
def test_broken_members_and_bytes_between_records(spark, tmp_path, split):
    good = [other(bytes(f"record {i} ", "ascii") * 50) for i in range(6)]
    noise = b"\x1f\x8b\x08 no member \x1f\x8b\x08\x00" * 3 + gzip.compress(b"a member that is no record")
    torn = other(random.Random(9).randbytes(800))[:500]
    (tmp_path / "a.warc.gz").write_bytes(noise + good[0] + good[1] + torn + good[2] + noise + good[3] + b"\x00" * 200 + good[4] + good[5][:-20])
    got = warc.read_warc(named(spark, tmp_path), split).orderBy("start").collect()
    assert [r.record_type for r in got] == ["resource", "resource", "broken", "resource", "resource", "resource", "broken"]
    assert [bytes(r.payload)[:8].decode() for r in got if r.payload is not None] == [f"record {i}" for i in range(5)]


def test_a_magic_across_two_pieces_is_found(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ", 16)
    data = b"\0" * 14 + warc.MAGIC + b"\0" * 40 + warc.MAGIC + b"\0"
    (tmp_path / "x").write_bytes(data)
    with warc._File(*warc.opened(str(tmp_path / "x"))) as f:
        assert list(f.magics(0, len(data))) == [14, 57] and list(f.magics(15, 58)) == [57] and list(f.magics(0, 14)) == []
