"""The pipeline's stages on odd documents, and the learned operators against plain versions."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from twinlake.llm import common, langid, quality

from .conftest import SF

LONG = " ".join(f"word{i % 701} of the story" for i in range(60_000))
ROWS = [
    (None, None), (None, "a text without an id, of some words"), (1, None), (2, ""), (3, " \n\t"), (4, "12345 !!"), (5, "one two three four five six seven eight"), (6, "one two three four five six seven eight"),
    (7, 'the token = "57f17a56c90cac3e893f4491169557bdc83d8148" is in the text of the house'), (7, "another text of the same id, with its own words in it"), (8, LONG), (8, LONG), (9, LONG + " end"), (10, "ééé ßßß 中文 😀"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows before many plain ones, with columns named as the operators' own."""
    named = ["row", "id", "held", "gone", "bitmap", "part", "_gone", "_bitmap", "rep", "set_key", "t", "text_", "component", "k", "a.b"]
    df = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, n_chars long")
    for i, c in enumerate(named):
        df = df.withColumn(c, F.lit(None).cast("string") if i % 2 else F.lit(f"{c}!"))
    return df


def test_every_stage_takes_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF).collect()
        none = stage(spark, odd.where("false"), SF)
        assert none.count() == 0, name
        if name == "packing":
            whole = {}
            for r in got:
                whole.setdefault((r.doc_id, r.doc_tokens), 0)
                whole[r.doc_id, r.doc_tokens] += r.length
            assert (1, 1) in whole and (2, 1) in whole and sum(r.doc_id == 8 and r.start == 0 for r in got) == 2
            continue
        assert none.columns == odd.columns and all(r.row == "row!" and r["a.b"] == "a.b!" and r.held == "held!" for r in got), name
        ids = [r.doc_id for r in got]
        if name == "near_dedup":
            assert 5 in ids and 6 not in ids and 9 not in ids and ids.count(8) == 2 and ids.count(7) == 2 and ids.count(None) == 2 and {1, 2, 3} <= set(ids)
        if name == "secret_scan":
            assert len(got) == len(ROWS)
            by = {(r.doc_id, r.n_chars): r for r in got}
            hidden = next(r for r in got if r.doc_id == 7 and "[assign]" in (r.text or ""))
            assert "57f17a" not in hidden.text and hidden.n_chars == len(hidden.text) and by[8, len(LONG)].text == LONG and next(r for r in got if r.doc_id == 1).text is None
        if name == "language_id":
            assert not {1, 2, 3, 4} & set(ids) and ids.count(8) == 2


def test_stages_are_deterministic(spark):
    docs = common.table(spark, SF, "documents")
    kept = corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id")
    again = corpus_pipeline.near_dedup(spark, docs.orderBy(F.desc("doc_id")).repartition(3), SF).select("doc_id")
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in again.collect())


def plain_columns(text):
    """Columns of a text by the docstring of quality, word by word."""
    marks = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    column = lambda f: xxhash.xxh32_intdigest(f.encode()) & 65535
    words = (text or "").split()
    out, stems = set(), set()
    for w in words:
        stem = w.rstrip(marks).lower()
        stems.add(stem)
        if stem:
            out.add(f"w {stem}")
        if len(w.rstrip(marks)) < len(w):
            out.add(f"m {w[len(w.rstrip(marks)) :][:8]}")
    out = {column(f) for f in out}
    begun = [s[:n] for s in stems for n in (4, 5, 6, 7) if len(s) >= n]
    out |= {column(f"b {b}") for b in set(begun) if begun.count(b) > 1}
    n, d, different = max(len(words), 1), max(len(set(words)), 1), set(words)
    lines = (text or "").split("\n")
    more = [
        f"length {n.bit_length()}", f"repeated {n.bit_length() > 4} {int(8 * (1 - d / n))}", f"capitals {int(8 * sum(w.isupper() for w in different) / d)}",
        f"marked {int(8 * sum(not w[-1].isalnum() for w in different) / d)}", f"bars {int(8 * sum(w == '|' for w in words) / n)}", f"lines {int(8 * (1 - len(set(lines)) / len(lines)))}",
    ]
    return out | {column(f) for f in more}


def test_grades_by_a_plain_version(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    m = quality.fit(docs, labels)
    assert list(m.thresholds) == sorted(m.thresholds)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs, m).collect():
        f = sum(float(m.weights[c]) for c in plain_columns(texts[r.doc_id]))
        tail = [1 / (1 + math.exp(-(f - t))) for t in m.thresholds]
        assert r.expected_grade == pytest.approx(sum(tail), abs=1e-4) and r.tail == pytest.approx(tail[-1], abs=1e-4)
        assert r.selected == (r.tail >= m.cut)
    assert set(r.doc_id for r in quality.select(docs, m).collect()) == {r.doc_id for r in quality.score(docs, m).where("selected").collect()}
    assert len(quality._bounded(np.arange(60_000))) == quality.MOST


def test_languages_by_a_plain_version(spark):
    docs = common.table(spark, SF, "documents")
    m = langid.fit(docs.where(~langid.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    mask = 0xFFFFFFFF

    def vector(text):
        """Letter pairs and triples counted one by one."""
        c = [ord(x) if x.isalpha() else 32 for x in f"  {text.lower()} "] + [32, 32]
        n = {}
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            pair = (a * 0x9E3779B1 & mask) ^ (b * 0x85EBCA77 & mask)
            triple = ((pair ^ pair >> 15) * 0xC2B2AE3D & mask) ^ (d * 0x27D4EB2F & mask)
            for h, use, k in ((pair, (a, b), 0x2C1B3C6D), (triple, (a, b, d), 0x297A2D39)):
                if any(x != 32 for x in use):
                    h = h * k & mask
                    h = (h ^ h >> 16) & 4095
                    n[h] = n.get(h, 0) + 1
        v = {h: math.log1p(x) * float(m.weights[h]) for h, x in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {h: x / size for h, x in v.items()}

    rows = langid.predict(docs, m).collect()
    assert len(rows) == len(texts)
    for r in rows[::5]:
        t = texts[r.doc_id]
        if not t or not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = vector(t)
        cos = [sum(x * float(c[h]) for h, x in v.items()) for c in m.centroids]
        assert r.score == pytest.approx(max(cos), abs=1e-4) and cos[[*m.languages].index(r.lang_pred) :] and max(c for c, lang in zip(cos, m.languages, strict=True) if lang == r.lang_pred) == pytest.approx(max(cos), abs=1e-4)
