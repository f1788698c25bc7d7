"""Near-duplicates, fingerprints, chats, pages, the pipeline."""

import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from twinlake.llm import bitmap, chat, fingerprint, html, neardup, queries
from twinlake.llm.common import table

from .conftest import ODD, SF


def sets_of(texts, words):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts, words, percent):
    sets = sets_of(texts, words)
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    both = collections.Counter()
    for at in holders.values():
        for x in range(len(at)):
            for y in range(x):
                both[at[y], at[x]] += 1
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(ids[a]), find(ids[b])
            parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in zip(ids, sets, strict=True)]


def near(df, **k):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, **k).collect()}


def chain(n, length=200, seed=3):
    """Texts each near to the next, the ends far apart."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        out.append(" ".join(words))
        for k in range(3):
            words[(i * 11 + k * 60) % length] = f"v{rng.randrange(10**6)}"
    return out


def test_near_duplicates_of_a_table(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    expected = brute(ids, [r.text for r in rows], 3, 85)
    out = neardup.near_duplicates(docs, words=3, percent=85)
    got = {r.doc_id: r for r in out.collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in ids] == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_chains_and_odd_texts(spark, docs_of, words, percent):
    texts = chain(25) + ODD + chain(8, 60, 9) + ["The SAME words here", "the same\twords  here"] + ["a b", "a b c", "b a"]
    random.Random(1).shuffle(texts)
    got = near(docs_of(texts), words=words, percent=percent)
    assert [got[i] for i in range(len(texts))] == brute(list(range(len(texts))), texts, words, percent)


def test_no_link_is_lost_behind_a_leader(spark, docs_of):
    """Star of texts around a hidden middle: the least id is far from most, yet they are near to each other."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(40):
        w = list(base)
        for k in rng.sample(range(120), 4 if i else 7):
            w[k] = f"z{i}x{k}"
        texts.append(" ".join(w))
    got = near(docs_of(texts), words=3, percent=70)
    assert [got[i] for i in range(40)] == brute(list(range(40)), texts, 3, 70)


def test_repeated_ids_and_empty_table(spark, docs_of):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (1, "x y z q"), (3, "x y z q"), (4, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(df, words=3, percent=85).collect()
    assert len(rows) == 6 and {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert neardup.near_duplicates(docs_of([])).count() == 0


def test_tables_needed():
    assert neardup.sketches_needed(0.85, 3, 1e-4) == 11
    assert 2 * (1 - 0.85**3) ** 11 <= 1e-4


# --- fingerprints


def edited(texts):
    """By descending id."""
    n = len(texts)
    return [t[: len(t) - len(t) // 2] + texts[(i + 1) % n][: len(t) // 2] for i, t in enumerate(texts)]


def test_fingerprints(spark, docs_of):
    rng = random.Random(2)
    texts = ODD + [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 60, 500]))) for _ in range(150)] + ["same text of more than five words"] * 2
    rows = fingerprint.fingerprints(docs_of(texts)).orderBy("doc_id", ascending=False).collect()
    down = [t or "" for t in reversed(texts)]
    changed = edited(down)
    sets, others = sets_of(down, 5), sets_of(changed, 5)
    exact = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in enumerate(rows):
        assert r.n_chars == len(down[i]) and r.edited_sha256 == hashlib.sha256(changed[i].encode()).hexdigest()
        assert abs(r.near_edited - exact(sets[i], others[i])) < 0.22
        assert abs(r.near_next - exact(sets[i], sets[(i + 1) % len(down)])) < 0.22
        assert len(r.fingerprint) == (256 if sets[i] else 0)
    by_text = {}
    for t, r in zip(down, rows, strict=True):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    same = [r.edited_fingerprint == r.fingerprint for t, c, r in zip(down, changed, rows, strict=True) if t == c]
    assert all(same)


@pytest.mark.parametrize("ids", [[5], [-(2**62), 0, 2**62], [1, 1, 2], list(range(0, 1000, 3))])
def test_next_document(spark, ids):
    df = spark.createDataFrame([(i, f"text number {i} {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = fingerprint.fingerprints(df).collect()
    down = sorted(((-i, f"text number {i} {k}") for k, i in enumerate(ids)))
    want = [hashlib.sha256(t.encode()).hexdigest() for t in edited([t for _, t in down])]
    assert sorted(r.edited_sha256 for r in got) == sorted(want)


def test_blocks_follow_the_ids(spark):
    """An id far from all others, and ids of many sizes, leave blocks small."""
    for ids in ([*range(2000), 1 << 60, -(1 << 61)], [1 << (k % 60) | k for k in range(2000)]):
        df = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
        sizes = fingerprint.with_next(df).where("not copied").groupBy("block").count().collect()
        assert max(r["count"] for r in sizes) <= 8 * 64 and sum(r["count"] for r in sizes) == len(ids)
    edges = fingerprint.bounds(df, 64, 1 << 18)
    got = df.select("doc_id", fingerprint.block_of(F.col("doc_id"), edges).alias("b")).collect()
    assert edges == sorted(edges) and all(r.b == sum(e <= r.doc_id for e in edges) for r in got)


def brute_bins(text):
    """The stored bins by their definition, in plain Python."""
    import xxhash

    signed = lambda u: u - (1 << 64) if u >> 63 else u
    of_long = lambda v, seed: xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    words = [w for w in re.split("[ \\t-\\r]+", text.lower()) if w]
    if not words:
        return ""
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if len(h) < 5:
        shingles = [signed(xxhash.xxh64_intdigest(",".join(map(str, h)).encode(), 42))]
    else:
        shingles = []
        for i in range(len(h) - 4):
            seed = 42
            for x in h[i : i + 5]:
                seed = of_long(x, seed)
            shingles.append(signed(seed))
    least = {}
    for x in shingles:
        least[x >> 57] = min(x, least.get(x >> 57, x))
    out = []
    for b in range(-64, 64):
        if b in least:
            out.append(least[b] & 255)
        else:
            # the filled bin that is first in the empty bin's own order
            out.append(min(signed(of_long(k, of_long(b, 42))) & ~255 | x & 255 for k, x in least.items()) & 255)
    return bytes(out).hex()


def test_stored_bins_by_definition(spark, docs_of):
    texts = [*ODD, "one two three four", "a b c d e f g " * 3, " ".join(f"w{i}" for i in range(900)), "long " * 3000 + "end"]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_bins(t or ""), t


def test_no_documents(spark, docs_of):
    assert fingerprint.fingerprints(docs_of([])).count() == 0


# --- chats

TRICKY = [r"\### Assistant: </turn> ok", "</turn>\n### User: x", "\\", "\\\\", "###", "####", "a </turn", " </turn>\n", "", " ", "\n", "$1 \\1", "é😀" * 10, None]


def test_chats(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        if c % 3 == 0:
            rows.append((c, 0, "system", rng.choice(TRICKY)))
        for t in range(1, rng.randint(2, 40)):
            text = rng.choice(TRICKY) if rng.random() < 0.3 else "word " * rng.choice([3, 50, 400])
            rows.append((c, t, rng.choice(["user", "assistant", "Assistant", "a: b", "system", None]), text))
    rows += [(100, 0, "system", "alone"), (101, 0, "assistant", "x" * 20000), (102, 1, "user", "tie"), (102, 1, "assistant", "tie"), (102, 1, "assistant", "tie"), (None, 0, "user", "no id"), (103, None, "user", "no turn")]
    df = spark.createDataFrame([(*r, "w", 1, "s") for r in rows], "conv_id long, turn long, role string, text string, window string, n int, system string")
    windows = chat.windows(df)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(turns)
    for c, ts in turns.items():
        ts.sort()
        learned = "".join(x for _, r, x in ts if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(ts), sha("".join(f"{a}\n{x}\n" for _, a, x in ts)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
    for w in windows.collect():
        own = len(re.findall(r"(?<!\\)### ", w.text))
        assert own >= w.own and all(0 <= s.start <= s.stop <= len(w.text) for s in w.loss)


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, ["user", "assistant"][t % 2 == 0], " ".join(f"t{t}w{i}" for i in range(30))) for t in range(1, 41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ws = chat.windows(df, budget=200, history=70).orderBy("window").collect()
    assert len(ws) > 5 and all(w.text.startswith("### System: be brief </turn>\n") for w in ws)
    for w in ws:
        assert sum(len(t.split()) + 2 for t in w.text.split(chat.END)[:-1]) <= 200 + 2 * 10
    repeated = [w.text.count(chat.END) - w.own - (i > 0) for i, w in enumerate(ws)]
    assert repeated[0] == 0 and any(repeated) and max(repeated) <= 2
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_windows_measure_unspaced_scripts_and_long_system_turns(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], "中文" * 2500) for t in range(19)] + [(2, t, ["user", "assistant"][t % 2], "中文" * 20) for t in range(60)]
    rows += [(3, 0, "system", "rule " * 2000)] + [(3, t, ["user", "assistant"][t % 2], "word " * 40) for t in range(1, 60)]
    ws = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window").collect()
    long, short, ruled = ([w for w in ws if w.conv_id == c] for c in (1, 2, 3))
    # a turn beyond the budget is a window of its own; shorter ones share windows within it, by four bytes to a token
    assert len(long) == 19 and all(w.own == 1 for w in long)
    assert len(short) > 1 and all(len(w.text.encode()) / 4 <= 1024 + 12 * w.text.count(chat.END) for w in short)
    # a system turn beyond the budget leaves a quarter of it to the others
    system = len("rule " * 2000)
    assert len(ruled) > 5 and all(w.text.startswith("### System: rule") and len(w.text) - system <= 4 * (256 + 128) + 12 * w.text.count(chat.END) for w in ruled)


def test_nothing_native_needs_python(spark):
    for name in ("op7_chat_windows", "op8_fingerprints"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- pages

PROSE = "This is a sentence of the article, with some words in it. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><script>var a='<p>no</p>';</script>{body}</body></html>"


def test_pages():
    text = "\n".join(["Head &", *[(PROSE * k).strip() for k in (3, 1, 4)]])
    article = "<h1>Head &amp;</h1>" + "".join(f"<p>{PROSE * k}" for k in (3, 1, 4))
    asides = (
        '<nav><ul><li><a href="/">Home</a><li><a href="/x">Other</a></ul></nav>', '<div class="cookie-banner"><p>We use cookies, as all do. Accept?</p></div>',
        '<aside><h3>More</h3><p>Another story, which is short.</p></aside>', '<form><p>Your name, please.</p><input><button>Send</button></form>',
        f'<section id="comments"><h2>Comments</h2><div class="comment"><p>{PROSE * 2}</p></div></section>', '<div class="ad">Buy this, now. It is good.</div>', "<footer>(c) All rights, reserved.</footer>",
    )
    for shape in (f"<article>{article}</article>", f'<div id="wrap"><div class="story">{article}</div></div>', f"<main>{article}</main>"):
        for extra in ("", *asides, "".join(asides)):
            assert html.extract(page(asides[0] + shape + extra)) == text, (shape[:30], extra[:40])
        assert html.extract(page(f"<article>{article}{asides[4]}{asides[5]}</article>")) == text


def test_names_alone_drop_no_article():
    story = "<h1>Head</h1>" + "".join(f"<p>{PROSE * k}" for k in (3, 1, 4))
    text = "\n".join(["Head", *[(PROSE * k).strip() for k in (3, 1, 4)]])
    side = '<div class="sidebar"><p>Another story, which is short.</p></div>'
    for name in ("site has-sidebar", "layout-no-sidebar", "share-enabled", "side-by-side", "theme-modal-open", "header-fixed", "comments-open"):
        for body in (f"<article>{story}</article>", f"<main>{story}</main>", f'<div class="story">{story}</div>'):
            assert html.extract(page(f'<div class="{name}">{body}{side}</div>')) == text, (name, body[:20])
            assert html.extract(page(f'<x-app class="{name}">{body}{side}</x-app>')) == text, (name, body[:20])
    assert html.extract(page(f'<article class="social-post">{story}</article>{side}')) == text
    assert html.extract(page(f'<article><div class="post widget">{story}</div></article>')) == text
    more = f'<section class="{{}}"><h2>More</h2><p>{PROSE * 2}</p></section>'
    for name in ("discussion", "related"):
        assert html.extract(page(f"<article>{story}{more.format(name)}</article>")) == f"{text}\nMore\n{(PROSE * 2).strip()}"
        assert html.extract(page(f"<article>{story}</article>{more.format(name)}")) == text
    long = f'<section id="comments"><div class="comment"><p>{PROSE * 20}</p></div></section>'
    assert html.extract(page(f"<article>{story}</article>{long}")) == text
    assert html.extract(page(f'<span class="share">{PROSE}</span>')) == PROSE.strip()


def test_path_ratios_select():
    """Without article, main or names, the ratios alone tell content from the rest; the threshold decides."""
    story = "<h2>Head</h2>" + "".join(f"<p>{PROSE * k}</p>" for k in (3, 1, 4)) + "<ul><li>Red wine<li>White bread</ul>"
    text = "\n".join(["Head", *[(PROSE * k).strip() for k in (3, 1, 4)], "Red wine", "White bread"])
    links = "".join(f'<li><a href="/{i}">Place {i}</a>' for i in range(9))
    body = f'<div class="a1"><ul>{links}</ul></div><div class="a2">{story}<div>Buy it now, today.</div>{story}</div><div class="a3">All is ours, all of it.</div>'
    assert html.extract(page(body)) == f"{text}\n{text}"
    assert html.extract(page(f"<article>{story}<div>Buy it now, today.</div>{story}</article>")) == f"{text}\n{text}"
    every, none = html.extract(page(body), float("-inf")), html.extract(page(body), float("inf"))
    assert none == "" and "Buy it now" in every and "Place 3" in every
    # the score of a path as it is defined, from the blocks alone
    found, made = html.blocks(page(body))
    for e in made:
        e.weight = 0.0 if e.aside else 1.0
    least = html.scores(found, made)
    length = [b.length - 0.75 * b.linked for b in found]
    marks = [sum(c in ".,;:!?" for c in b.text) * (1 - 0.75 * b.linked / b.length) for b in found]
    for x in (length, marks):
        x[:] = [(x[max(i - 1, 0)] + 10 * v + x[min(i + 1, len(x) - 1)]) / 12 for i, v in enumerate(x)]
    mean = lambda x, use: sum(v for v, u in zip(x, use, strict=True) if u) / sum(use)
    ratio = lambda use: (mean(length, use) * (mean(marks, use) + 0.1)) ** 0.5
    for b in found:
        if b.element.tag == "p":
            own = ratio([o.element.path == b.element.path for o in found])
            family = ratio([o.element.parent.path == b.element.parent.path for o in found])
            assert b.score == pytest.approx((4 * own * family) ** 0.5) and b.score >= least


def test_no_text_of_the_article_is_lost():
    story = "".join(f"<p>{PROSE * k}</p>" for k in (3, 2, 4))
    text = "\n".join((PROSE * k).strip() for k in (3, 2, 4))
    odd = f"<p class=\"related-work\">{PROSE}</p>"
    assert html.extract(page(f"<article>{story}{odd}{story}</article>")) == f"{text}\n{PROSE.strip()}\n{text}"
    odd = f"<section class=\"discussion\"><h2>Discussion</h2><p>{PROSE}</p></section>"
    assert html.extract(page(f"<article>{story}{odd}</article>")) == f"{text}\nDiscussion\n{PROSE.strip()}"
    assert html.extract(page(f"<article><p data-x=it's>{PROSE}</p><p>{PROSE}</p><p class='a' data-y=\"it's > that\">{PROSE}</p></article>")) == "\n".join([PROSE.strip()] * 3)
    assert html.extract(page(f"<article><p data-x='class=ad'>{PROSE}</p><p title='a>b'>{PROSE}</p></article>")) == "\n".join([PROSE.strip()] * 2)


def test_deep_pages_take_linear_time():
    took = []
    for n in (4000, 16000):
        began = time.process_time()
        assert html.extract("<div>" * n + "deep" + "</x>" * n) == "deep"
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_pages_of_a_table(spark):
    def plain(h):
        import html as H

        a = re.search("<article>(.*?)</article>", h, re.S)[1]
        parts = [" ".join(H.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", a))]
        return "\n".join(x for x in parts if x)

    pages = table(spark, SF, "pages")
    got = {r.page_id: r for r in queries.op5_main_text(spark, SF).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_pages(spark):
    odd = [None, "", "plain words", "<p", "<", "<p>a<b>c</b> d&nbsp;e", "<article></article>", "<script>x", "<!-- x", "<div>" * 2000 + "deep", "x" * 200000, "<p>" * 5000]
    df = spark.createDataFrame([(i, None, h, "n", "t") for i, h in enumerate(odd)], "page_id long, url string, html string, n_chars string, text string")
    got = html.main_text(df).orderBy("page_id").collect()
    assert [r.text for r in got][:8] == ["", "", "plain words", "", "<", "ac d e", "", ""]
    assert got[9].text == "deep" and got[10].n_chars == 200000
    assert html.main_text(df.limit(0)).count() == 0


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        sizes.append(kept.count())
    assert docs.count() > sizes[0] >= sizes[1] > sizes[2] == sizes[3]
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() == sizes[-1]


def test_all_ten_are_registered():
    names = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert names == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in rel.fetchall())


def test_bitmap_minds_no_names(spark):
    rows = spark.createDataFrame([(i, f"t{i}", i, None, "x") for i in range(50)] + [(None, "none", 0, 1, "y")], "doc_id long, _gone string, bitmap int, part int, `a.b` string")
    rows = rows.withColumnRenamed("part", "_bitmap_part").withColumn("row", F.lit(1)).withColumn("id", F.lit(2)).withColumn("held", F.lit(None))
    ids = rows.where("doc_id < 20").select("doc_id")
    left = bitmap.without(rows, ids, "doc_id")
    assert left.columns == rows.columns and sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == list(range(20, 50)) and left.count() == 31
    assert {r.doc_id for r in bitmap.may_hold(rows, ids, "doc_id").collect()} >= set(range(20))
    assert bitmap.bits_for(0) == 22 and bitmap.bits_for(1 << 20) == 24 and bitmap.bits_for(1 << 40) == 30


def test_ids_with_several_texts_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, c), (1, a), (2, b), (3, c), (9, "else where"), (None, "x y z"), (None, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (1, 2, 3, 5)} == {1}
    many = [(7, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(300)] + [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(8, 300, 9)]
    got = neardup.near_duplicates(spark.createDataFrame(many, "doc_id long, text string"), 3, 85).collect()
    assert {r.component_id for r in got} == {7}


def test_bitmap_lets_all_wanted_pass(spark):
    rng = random.Random(4)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(3000)] + list(range(3000))
    wanted = spark.createDataFrame([(i,) for i in ids[::2]], "doc_id long")
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    passed = {r.doc_id for r in bitmap.may_hold(rows, wanted, "doc_id").collect()}
    assert set(ids[::2]) <= passed and len(passed) < len(ids[::2]) + 30
    assert len({r.doc_id for r in bitmap.may_hold(rows, wanted, "doc_id", 15).collect()}) > len(passed)
    assert bitmap.may_hold(rows, wanted.limit(0), "doc_id").count() == 0
    for bits in (15, 22):
        assert sorted(r.doc_id for r in bitmap.without(rows, wanted, "doc_id", bits).collect()) == sorted(set(ids) - set(ids[::2]))
    assert bitmap.without(rows, wanted.limit(0), "doc_id").count() == len(ids)


def test_groups_with_open_keys(spark):
    """A rep counts once, however many of its keys are open; looked at by one key first, it is found by any."""
    from twinlake.llm.neardup import in_any

    # 40 near copies share 30 open keys; id 100 has one open key and a larger one that is not; id 200 has none
    rows = [(k, r, 5, r % 2) for k in range(30) for r in range(40)] + [(0, 100, 5, 3), (77, 100, 9, 3), (78, 200, 2, 4)]
    inside = spark.createDataFrame(rows, "key long, rep long, scale int, part long")
    keys = spark.createDataFrame([(k,) for k in range(30)], "key long")
    got = in_any(inside, keys)
    assert sorted(map(tuple, got.collect())) == sorted([(r, r % 2) for r in range(40)] + [(100, 3)])
