"""Each stage of the pipeline against a plain version, on a small table."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontam, langid, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
NASTY = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, " \n\t", "en", "s", 3), (None, "one two", "en", "s", 7), (-4, "a b c d e f g", "en", "s", 13), (-4, "a b c d e f g", "en", "s", 13), (-5, "12 34 !!", None, "s", 8), (-6, "word " * 30_000, "en", "s", 150_000)]


@pytest.fixture(scope="module")
def docs(spark):
    base = queries.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    return base.union(spark.createDataFrame(NASTY, base.schema)).cache()


def rows_of(df):
    assert tuple(df.columns) == corpus_pipeline.COLUMNS
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_stage(spark, docs):
    m = toxicity.train(docs, queries.table(spark, SF, "labels"))
    at = {int(h): k for k, h in enumerate(m.vocabulary)}
    want = Counter()
    for r in docs.collect():
        words = set(re.findall(rb"[a-z0-9\x80-\xff]+", (r.text or "").encode().lower()))
        seen = set()
        for w in words:
            made = toxicity.Words(*toxicity.raw(toxicity.pa.array([w.decode()])), 0, 1, toxicity.ALNUM)
            seen |= {at[int(h)] for h in toxicity.terms(made)[1] if int(h) in at}
        some = sorted(seen)
        y = m.w0 + m.w[some].sum() + 0.5 * ((m.v[some].sum(0) ** 2) - (m.v[some] ** 2).sum(0)).sum()
        if 1 / (1 + np.exp(-np.clip(y, -30, 30))) < toxicity.Settings().threshold:
            want[tuple(r)] += 1
    assert rows_of(STAGES["toxicity"](spark, docs, SF)) == want and sum(want.values()) < docs.count()


def test_language_stage(spark, docs):
    m = langid.train(docs)
    want = Counter()
    for r in docs.collect():
        total = m.word_scores(re.findall("[a-z\u0080-\U0010ffff]+", (r.text or "").lower())).sum(0)
        if len(total) and total[-1]:
            h = -total[:-1] / total[-1]
            best = int(h.argmin())
            if h[best] <= m.limit[best] + m.spread[best] * np.sqrt(1 + 400 / total[-1]):
                want[tuple(r)] += 1
    got = rows_of(STAGES["language"](spark, docs, SF))
    assert got == want and not any(r[0] in (-1, -2, -3, -5) for r in got)


def test_near_copies_stage(spark, docs):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i].doc_id is not None and rows[j].doc_id is not None and 100 * len(a & b) >= 80 * len(a | b):
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
    least = {}
    for r, c in zip(rows, comp, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    gone = {r.doc_id for r, c in zip(rows, comp, strict=True) if r.doc_id is not None and r.doc_id != least[c]}
    assert gone and rows_of(STAGES["near copies"](spark, docs, SF)) == Counter(tuple(r) for r in rows if r.doc_id not in gone or r.doc_id is None)


def test_benchmark_stage(spark, docs):
    items = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", r.text.lower()) for r in queries.table(spark, SF, "benchmark").collect() if r.text]
    few = docs.where("length(text) < 3000 or text is null")
    rows = few.collect()
    number = {w: k for k, w in enumerate({w for i in items for w in i})}
    gone = set()
    for r in rows:
        text = np.array([number.get(w, -1) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", (r.text or "").lower())], np.int64)
        for item in items:
            words = np.array([number[w] for w in item], np.int64)
            if np.isin(words, text).mean() >= 0.5 and decontam.align(words, text)[0] >= len(words):  # half of 2 a word
                gone.add(r.doc_id)
                break
    assert gone and rows_of(STAGES["benchmark"](spark, few, SF)) == Counter(tuple(r) for r in rows if r.doc_id not in gone)


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            piece = ids[start : first if k == 0 else start + 2048]
            want[r.doc_id, k, start, len(piece), zlib.crc32(piece.tobytes())] += 1
    got = STAGES["packing"](spark, docs, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1.02 * sum(n * k[3] for k, n in want.items()) / 2048 + 1


def test_stages_of_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
