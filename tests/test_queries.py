"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from twinlake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (str, bool)) or v is None:
        return v
    return round(float(v), 9)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    expected = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == expected


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert e.entry(spark).count() == 10


def test_greedy_comparison(spark):
    from twinlake.operators import archives

    a = spark.createDataFrame([(0, "a1", 0b0, 0, 0), (0, "a2", 0b1, 0, 1)], "pair int, internal_path string, fine long, coarse long, pos long")
    b = spark.createDataFrame([(0, "b1", 0b1, 0, 0), (0, "b2", 0b11, 0, 1)], "pair int, internal_path string, fine long, coarse long, pos long")
    got = [(r.a, r.b, r.distance) for r in archives.compare_greedy(a, b, 5).orderBy("a").collect()]
    assert got == [("a1", "b1", 1), ("a2", "b2", 1)]  # a1 takes b1 though it is a2's equal


def test_pair_strategies_agree(spark):
    from pyspark.sql import functions as F

    from twinlake.operators import pairs
    from twinlake.sources import records

    im = records.images(spark, SF)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(pairs.image_pairs_aspect(im, 20, 0.2)) == rows(pairs.image_pairs_nested(im, 20, 0.2))
    odd = im.withColumn("aspect", F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.col("aspect")))
    for tolerance in (0.05, 0.2, 0.9):
        assert rows(pairs.image_pairs_aspect(odd, 20, tolerance)) == rows(pairs.image_pairs_nested(odd, 20, tolerance))
    few = im.withColumn("fine", F.col("fine").bitwiseAND(F.lit(0xFFF)))
    assert rows(pairs.hamming_banded(few, 3)) == rows(pairs.image_pairs_nested(few, 3))


def test_dtw_pairs_against_plain(spark):
    from twinlake.functions.media import dtw_distance
    from twinlake.operators import pairs
    from twinlake.sources import records

    v = records.videos(spark, SF)
    data = {r.id: r for r in v.collect()}
    expected = set()
    for a in data.values():
        for b in data.values():
            if a.id < b.id and abs(a.duration - b.duration) / max(a.duration, b.duration) <= 0.2 and dtw_distance(a.hashes, b.hashes) <= 1.5:
                expected.add((a.id, b.id))
    assert {(r.a, r.b) for r in pairs.video_pairs(v, 1.5, use_dtw=True).collect()} == expected


def test_mean_hashes_in_single_precision(spark, db, tmp_path):
    """(x + 1) * 100 is a whole number in single precision, and just below it in double."""
    x = [0.135] * 63
    rows = [(i, [v, *x], 0) for i, v in enumerate([0.1199999526143074, 0.1199999, 0.13])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(con.execute(catalog.oracle_sql()["mean_hashes"]).fetchall())
    assert sorted(map(tuple, catalog.queries()["mean_hashes"](spark, str(tmp_path)).collect())) == expected
    assert int(expected[0][1]) & 1 == 1


@pytest.fixture
def mixed_lists(monkeypatch):
    """Gathered lists come in another order each time they are computed, as from shuffles over several machines."""
    import random

    from twinlake.operators import blocks

    gathered, mixed = blocks.F.collect_list, lambda rows: rows if rows is None else random.SystemRandom().sample(rows, len(rows))
    kind = {"n": "array<struct<id:bigint,fine:bigint,coarse:bigint,aspect:double>>", "s": "array<struct<id:struct<archive:string,internal_path:bigint>,fine:bigint,coarse:bigint>>"}

    def use(of: str) -> None:
        udf = blocks.F.udf(mixed, kind[of]).asNondeterministic()
        monkeypatch.setattr(blocks.F, "collect_list", lambda c: udf(gathered(c)) if c == "row" else gathered(c))

    return use


def test_archive_image_links_in_any_order(spark, db, mixed_lists):
    """A block is compared with itself in one order: each pair of its rows is found, and once."""
    mixed_lists("s")
    got = sorted(map(tuple, catalog.queries()["archive_image_links"](spark, SF).collect()))
    assert got == sorted(db.execute(catalog.oracle_sql()["archive_image_links"]).fetchall())


def test_scan_union_of_phases_in_any_order(spark, mixed_lists, tmp_path):
    """Groups of pictures lose none of their links; every picture here has four copies."""
    os.symlink(f"{SF}/documents.parquet", f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    con.execute(f"copy (select vec_id + 1000 * k as vec_id, embedding, label from '{SF}/embeddings.parquet', range(5) t(k) where vec_id < 60) to '{tmp_path}/embeddings.parquet'")
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    mixed_lists("n")
    got = sorted(map(tuple, catalog.queries()["scan_union_of_phases"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.oracle_sql()["scan_union_of_phases"]).fetchall())


def test_scan_union_of_phases_on_unknown_values(spark, tmp_path):
    """Documents without text are one group, and those without a path are in the groups of their text, as in the SQL."""
    os.symlink(f"{SF}/embeddings.parquet", f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    con.execute(
        f"""copy (select doc_id, case when doc_id % 10 <> 3 then text end as text, case when doc_id not in (4, 5, 7) then lang end as lang, source from '{SF}/documents.parquet'
          union all select 1000 + doc_id, text, lang, case when doc_id = 4 then null else source end from '{SF}/documents.parquet' where doc_id < 9) to '{tmp_path}/documents.parquet'"""
    )
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    expected = con.execute(catalog.oracle_sql()["scan_union_of_phases"]).fetchall()
    got = catalog.queries()["scan_union_of_phases"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert sum(waste is None for *_, waste in expected) == 1 and sum(key is None for _, key, *_ in expected) == 1


@pytest.fixture
def copied(tmp_path):
    """Every customer and user three times, those of one residue five times more: (path, DuckDB)."""
    con = duckdb.connect()
    for name, key, own in (("orders", "o_custkey", "o_orderkey"), ("events", "user_id", "event_id")):
        con.execute(
            f"copy (select t.* replace ({key} + 100000 * k as {key}, {own} + 1000000 * k as {own}) from '{SF}/{name}.parquet' t, range(8) c(k) where k < 3 or {key} % 7 = 0) to '{tmp_path}/{name}.parquet'"
        )
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    return str(tmp_path), con


@pytest.fixture
def compared(monkeypatch):
    """How many rows each comparison by blocks got."""
    from twinlake.operators import blocks

    seen, near = [], blocks.near_pairs
    monkeypatch.setattr(blocks, "near_pairs", lambda rows, *a, **b: (seen.append(rows.count()), near(rows, *a, **b))[1])
    return seen


@pytest.mark.parametrize(("name", "table", "key"), [("similar_groups_video", "events", "user_id"), ("similar_groups_audio", "orders", "o_custkey"), ("video_pairs_sequence", "events", "user_id"), ("video_pairs_dtw", "events", "user_id"), ("audio_pairs", "orders", "o_custkey")])
def test_copies_are_compared_once(spark, copied, compared, name, table, key):
    """Copies stand as one where rows are compared, and all of them are in the result."""
    sf, con = copied
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df), key=repr)
    expected = rows(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert rows(catalog.queries()[name](spark, sf).collect()) == expected and expected
    assert compared == [con.execute(f"select count(distinct {key} % 100000) from {table}").fetchone()[0]]


@pytest.mark.parametrize("name", ["video_pairs_sequence", "video_pairs_dtw", "audio_pairs"])
def test_pairs_of_rows_without_copies_are_not_shuffled(spark, name):
    """Where no row has copies, nothing is joined or sorted after the comparison."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above and "Join" not in above


def test_pairs_of_rows_with_and_without_copies(spark):
    """Rows with copies and rows without meet among themselves and each other, in neighbouring buckets of durations both ways."""
    from itertools import combinations

    from twinlake.functions.media import dtw_distance
    from twinlake.operators import pairs

    data = [(i, [i % 3, *f], d) for i, f, d in ((1, [7], 10.0), (2, [3], 10.0), (30, [7], 9.0), (3, [7], 9.0), (6, [7], 9.0), (4, [1], 11.9), (5, [3], 12.1), (8, [3], 12.1), (7, [255], 10.0), (9, [7], 8.4), (40, [1], 11.9))]
    v = spark.createDataFrame(data, "id long, hashes array<long>, duration double")
    mean = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) / 2
    for dtw, distance in ((False, mean), (True, dtw_distance)):
        expected = sorted((x, y, distance(a, b)) for (x, a, d), (y, b, e) in combinations(sorted(data), 2) if abs(d - e) / max(d, e) <= 0.2 and distance(a, b) <= 1.5)
        assert sorted(map(tuple, pairs.video_pairs(v, 1.5, use_dtw=dtw).collect())) == expected and len(expected) > 15


def test_rows_that_pair_with_none(spark):
    """No content is near nothing but at a threshold that takes all; an unknown duration pairs with none."""
    from twinlake.operators import pairs

    v = spark.createDataFrame([(1, [], 1.0), (2, [], 1.0), (3, [5], None), (4, [5], None), (5, [5], 1.0), (6, [5], 1.0), (7, [5], 2.0)], "id long, hashes array<long>, duration double")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(pairs.video_pairs(v, 2)) == [(5, 6, 0.0)] == got(pairs.video_pairs(v, 2, use_dtw=True))
    assert got(pairs.video_pairs(v, 64)) == [(1, 2, 64.0), (1, 5, 64.0), (1, 6, 64.0), (2, 5, 64.0), (2, 6, 64.0), (5, 6, 0.0)]
    assert got(pairs.video_groups(v, 2)) == [(5, 5, 2), (6, 5, 2)]
    assert got(pairs.video_groups(v, 64)) == [(i, 1, 4) for i in (1, 2, 5, 6)]


def test_sounds_and_videos_of_many_kinds_as_plain(spark, monkeypatch):
    """Blocks of several tiles, words of few and of many kinds, long and empty lists: as pairs compared one by one."""
    import random
    from itertools import combinations

    from twinlake.functions.media import dtw_distance
    from twinlake.operators import blocks, pairs

    monkeypatch.setattr(blocks, "MANY", 2)
    r = random.Random(5)
    share = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=False)) / (32 * min(len(x), len(y)) or 1) if x and y else 1.0
    for word in (lambda: (1 << r.randrange(6)) - 1, lambda: r.choice([0, 1 << 31, r.getrandbits(32)])):
        data = [(i, [word() for _ in range(r.choice([0, 1, 3, 5, 6, 40]))], r.choice([5.0, 6.0, 7.0])) for i in range(130)]
        df = spark.createDataFrame(data, "id long, fp array<long>, duration double")
        both = [(x, y, a, b) for (x, a, d), (y, b, e) in combinations(data, 2) if abs(d - e) / max(d, e) <= 0.2]
        expected = sorted((x, y, share(a, b)) for x, y, a, b in both if share(a, b) <= 0.1)
        compare = blocks.sequences("fp", 0.1, 0.2, "uint32", 32.0, 1.0)
        key, steps = pairs.tolerance_key("duration", 0.2)
        got = blocks.near_pairs(df, compare, ["fp", "duration"], "double", "id", key, steps, size=16)
        assert sorted(map(tuple, got.collect())) == expected and len(expected) > 15
        joined = blocks.near_pairs(df, compare, ["fp", "duration"], "double", "id", key, steps, size=16, forest=True)
        assert set(map(tuple, joined.collect())) <= set(expected)
        group = lambda df: sorted(map(tuple, pairs.groups_of(df).collect()))
        assert group(joined) == group(got)
        videos = df.withColumnRenamed("fp", "hashes")
        for most in (1.5, 64.0):
            got = blocks.near_pairs(videos, blocks.warped(most, 0.2), ["hashes", "duration"], "double", "id", key, steps, size=16)
            assert sorted(map(tuple, got.collect())) == sorted((x, y, dtw_distance(a, b)) for x, y, a, b in both if dtw_distance(a, b) <= most)


def test_groups_get_few_of_the_pairs(spark, monkeypatch):
    """400 sounds that are all near each other: 79,800 pairs, of which groups get no more than join them."""
    from twinlake.operators import pairs

    seen, parts = [], pairs.connected_components
    monkeypatch.setattr(pairs, "connected_components", lambda e: (seen.append(e.count()), parts(e))[1])
    audio = spark.createDataFrame([(i, [1 << i % 20, i, 7, 9, 5, 5, 5, 5, 5, 5], 10.0) for i in range(400)], "id long, fp array<int>, duration double")
    assert {tuple(r) for r in pairs.audio_groups(audio, 0.1).select("group_id", "n").collect()} == {(0, 400)}
    assert seen == [399]


def test_a_frequent_key_is_copied_few_times(spark):
    """Rows of a key are dealt to no more blocks than there are tasks for them."""
    from pyspark.sql import functions as F

    from twinlake.operators import blocks

    rows = spark.range(100000).select(F.lit(1).alias("k"), "id", F.array(F.lit(1)).alias("fp"))
    assert [r.n for r in blocks._blocks(rows, "id", ["fp"], 512)[1].collect()] == [blocks.MANY]
    long = rows.where("id < 30000").withColumn("fp", F.array_repeat(F.lit(1), 2000))
    assert [r.n for r in blocks._blocks(long, "id", ["fp"], 512)[1].collect()] == [29]


def test_components_of_chains_and_stars(spark):
    import random

    from twinlake.operators.components import connected_components

    ids = list(range(500))
    random.Random(3).shuffle(ids)
    edges = [*zip(ids[:299], ids[1:300], strict=True), *((ids[300], x) for x in ids[301:400]), (7, 7), (ids[450], ids[451]), (ids[451], ids[450])]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    expected = {x: min(part) for part in (ids[:300], ids[300:400], ids[450:452]) for x in part}
    assert got == expected


def test_compared_sounds_are_matched_as_they_come(spark):
    """Near pairs of two archives are sorted once and never gathered or joined; each entry takes the nearest free one."""
    from twinlake.operators import archives

    kind = "internal_path string, fp array<int>, duration double, pos long"
    a = spark.createDataFrame([("a1", [0, 0], 2.0, 1), ("a2", [0, 0], 2.0, 2), ("a3", [1, 0], 2.0, 3)], kind)
    b = spark.createDataFrame([("b1", [3, 0], 2.0, 1), ("b2", [0, 0], 2.0, 2), ("b3", [3, 0], 2.0, 0)], kind)
    got = archives.compare_audio(a, b, 0.08, 0.2)
    assert [(r.a, r.b, r.distance) for r in got.orderBy("a").collect()] == [("a1", "b2", 0.0), ("a2", "b3", 2 / 64), ("a3", "b1", 1 / 64)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan[: plan.index("RepartitionByExpression") if "RepartitionByExpression" in plan else plan.index("Repartition")]
