"""Each stage of the pipeline against a plain computation over its own input."""

import hashlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.saved(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append((before, docs))
    return out


def test_columns_and_shrinking(stages):
    for before, after in stages[:-1]:
        assert tuple(after.columns) == corpus_pipeline.COLUMNS
    sizes = [a.count() for _, a in stages]
    assert sizes[0] <= 200 and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and all(sizes)


def test_quality_keeps_what_it_judges_kept(stages):
    from quarry.llm.quality import judged

    before, after = stages[0]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged(before).where("kept").collect()}


def test_one_of_each_group_stays(stages):
    from test_operators import components

    before, after = stages[2]
    want, _ = components({r.doc_id: r.text for r in before.collect()}, 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))


def test_encoding_equals_library(stages):
    from quarry.llm.tokens import public
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public("word_bpe_49k.json"))
    before, after = stages[4]
    want = []
    for r in before.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in after.collect()) == sorted(want)


def test_toxic_documents_go_and_only_they(spark, stages):
    from quarry.llm import toxicity

    before, after = stages[1]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in toxicity.scored(before, model).where("score < 0.5").collect()}
    assert {r.doc_id for r in after.collect()} == want


def test_mixing_fills_each_leaf_by_hand(stages):
    """Budgets down the tree by repeated shares, then the prefix of each leaf by sorting."""
    import zlib

    from quarry.llm import mixing

    before, after = stages[3]
    rows = [(r.doc_id, f"d{zlib.crc32((r.source or '').encode()) % 3}", r.lang, r.source, len((r.text or "").encode().split())) for r in before.collect()]

    def shares(given, most, weight):
        out, open_ = dict.fromkeys(most, 0.0), set(most)
        while open_ and given > 1e-9:
            step = min(given, min((most[k] - out[k]) / weight[k] for k in open_) * sum(weight[k] for k in open_))
            total = sum(weight[k] for k in open_)
            for k in open_:
                out[k] += step * weight[k] / total
            given -= step
            open_ = {k for k in open_ if most[k] - out[k] > 1e-9}
        return out

    def down(prefix, given):
        if len(prefix) == 3:
            return {prefix: given}
        names = {r[1 + len(prefix)] for r in rows if r[1 : 1 + len(prefix)] == prefix}
        most = {n: mixing.EPOCHS * sum(r[4] for r in rows if r[1 : 2 + len(prefix)] == (*prefix, n)) for n in names}
        w = mixing.WEIGHTS[mixing.LEVELS[len(prefix)]]
        out = {}
        for n, x in shares(given, most, {n: w.get(n, 1) for n in names}).items():
            out |= down((*prefix, n), x)
        return out

    want = []
    for leaf, x in down((), float(int(sum(r[4] for r in rows) * mixing.SHARE))).items():
        mine, budget = [r for r in rows if r[1:4] == leaf], int(round(x, 6))
        tokens = sum(r[4] for r in mine)
        whole = min(budget // tokens, mixing.EPOCHS) if tokens else 0
        rest, part = budget - whole * tokens, set()
        for r in sorted(mine, key=lambda r: hashlib.md5(f"{mixing.SEED}:{whole}:{r[0]}".encode()).hexdigest()):
            if r[4] > rest or whole >= mixing.EPOCHS:
                break
            rest -= r[4]
            part.add(r[0])
        want += [r[0] for r in mine for _ in range(whole + (r[0] in part))]
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, k):
    """Null fields, empty, repeated and very long texts, no rows, and columns whose names clash."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 9), (3, long, "en", "a", 9), (None, "no id " * 30, "en", None, 1), (4, " ".join(f"u{i}" for i in range(40)), None, "a", 1)]
    docs = spark.createDataFrame([(*r, 0.5, True, "x", 7) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, domain string, n_words int")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF).collect()
    assert len(out) <= 2 * len(rows)
    if k < 4:
        assert tuple(out[0].asDict()) == corpus_pipeline.COLUMNS if out else True
    if k == 0:
        assert sorted((r.doc_id or 0) for r in out) == [3, 3, 4]
    if k in (1, 4):
        assert len(out) == len(rows)
    if k == 2:
        assert sorted(r.doc_id or 0 for r in out) == [0, 1, 2, 3, 3, 4]
    assert stage(spark, docs.limit(0), SF).count() == 0
