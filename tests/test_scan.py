import io
import os
import shutil
import tarfile
import zipfile

import pytest

from twinlake.operators import filters
from twinlake.operators.components import connected_components
from twinlake.operators.session import Session
from twinlake.params import ImageConfig, ScanParams
from twinlake.plans.scan import files_read, image_phase, scan
from twinlake.sources import archives as archive_source
from twinlake.sources import state
from twinlake.sources.files import inventory, inventory_builtin

SF = "/root/testdata/sf0.001"


def put(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def groups(spark, root, **params):
    r = scan(spark, ScanParams(folder=str(root), **params))
    return sorted((g.n, g.folder_key, g.waste) for g in r.groups.collect()), r


def test_empty_folder(spark, tmp_path):
    found, r = groups(spark, tmp_path)
    s = r.summary().first()
    assert found == [] and (s.total_waste, s.n_groups, s.scanned_files) == (0, 0, 0)


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="no such folder"):
        inventory(spark, ScanParams(folder=str(tmp_path / "none"))).count()


def test_copies_and_near_misses(spark, tmp_path):
    put(tmp_path, a="triple", b="triple", c="triple", d="aaaaaaa!!", e="bbbbbbb!!", _h_dot_txt="hidden")
    found, r = groups(spark, tmp_path)
    assert found == [(3, "", 12)]
    assert r.summary().first().scanned_files == 6


def test_whole_content_decides(spark, tmp_path):
    put(tmp_path, a="x" * 5000 + "1", b="x" * 5000 + "2", c="x" * 5000 + "2")
    assert [g[0] for g in groups(spark, tmp_path)[0]] == [2]


def test_recursion_and_folders(spark, tmp_path):
    put(tmp_path, A__f="same", A__deep__deeper__f2="same", B__f="same")
    assert groups(spark, tmp_path)[0] == []
    assert groups(spark, tmp_path, recursive=True)[0] == [(3, "", 8)]
    assert groups(spark, tmp_path, by_folder=True)[0] == [(2, "A", 4)]


def test_excluded_folders_and_filters(spark, tmp_path):
    put(tmp_path, keep__a="z" * 3000, skip__b="z" * 3000, c_dot_TMP="z" * 3000)
    names = lambda **p: sorted(r.name for r in inventory(spark, ScanParams(folder=str(tmp_path), recursive=True, **p)).collect())
    assert names(excluded=("skip",)) == ["a", "c.TMP"]
    assert names(exclude_extensions=("tmp",)) == ["a", "b"]
    assert names(include_extensions=("tmp",)) == ["c.TMP"]
    assert names(min_file_size_kb=3) == []
    assert inventory_builtin(spark, str(tmp_path)).count() == 3


def test_second_folder(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    put(one, a="both", b="inside", c="inside")
    put(two, x="both")
    assert [g[0] for g in groups(spark, one, secondary_folder=str(two))[0]] == [2]


def test_similar_pictures_across_two_folders(spark, tmp_path):
    import struct

    def bmp(lift):
        rows = b"".join(bytes(min(255, (x * 3 + y * 2 + (x // 9) * (y // 7) * 5 + lift) % 200 + lift) for x in range(64) for _ in range(3)) for y in range(64))
        return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, 64, 64, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows

    one, two = tmp_path / "one", tmp_path / "two"
    put(one, a_dot_bmp=bmp(0))
    put(two, b_dot_bmp=bmp(1))
    params = ScanParams(folder=str(one), secondary_folder=str(two), find_similar=True)
    listed = inventory(spark, params)
    found = image_phase(spark, spark.createDataFrame(listed.collect(), listed.schema), params.folder, params)
    assert sorted(m.name for m in found.collect()) == ["a.bmp", "b.bmp"]


def test_origin_order_and_ignores(spark, tmp_path):
    put(tmp_path, z="same", a="same", m="same")
    for n, t in (("z", 200), ("a", 100), ("m", 100)):
        os.utime(tmp_path / n, (t, t))
    _, r = groups(spark, tmp_path)
    assert [x.name for x in r.members.orderBy("pos").collect()] == ["a", "m", "z"]
    key = r.groups.first().ignore_key
    assert key == "|".join(sorted(str(tmp_path / n) for n in "zam"))
    assert groups(spark, tmp_path, ignored_keys=(key,))[0] == []


def test_session_reads(spark, tmp_path):
    put(tmp_path / "in", a="one", b="one", c="three", d="three", e="three")
    _, r = groups(spark, tmp_path / "in")
    s = Session.save(str(tmp_path / "s"), r.groups, r.members)
    key = s.groups().where("n = 2").first().ignore_key
    ignores = spark.createDataFrame([(key,)], "ignore_key string")
    assert [g.n for g in s.view(ignores).collect()] == [3]
    assert s.groups().count() == 2  # taken off the list, the group is back
    assert [g.n for g in s.view(query=" /C ").collect()] == [3]
    gone = spark.createDataFrame([(str(tmp_path / "in" / "a"),), (str(tmp_path / "in" / "c"),)], "path string")
    left, members = s.without(gone)
    assert [(g.n, g.waste) for g in left.collect()] == [(2, 5)] and members.count() == 2


def test_saved_state(spark, tmp_path):
    p = str(tmp_path / "ignored")
    state.ignore(spark, p, "k", ["n"])
    state.ignore(spark, p, "k", ["n"])
    state.ignore(spark, p, "l", ["n"])
    schema = "ignore_key string, display_names array<string>, ignored_at bigint"
    assert state.load_table(spark, p, schema).count() == 2
    state.unignore(spark, p, "k")
    assert [r.ignore_key for r in state.load_table(spark, p, schema).collect()] == ["l"]
    profiles = state.Profiles(tmp_path / "profiles")
    profiles.save("one", {}, 1)
    ident = profiles.save("two", {}, 2)
    assert [x["name"] for x in profiles.list()] == ["two", "one"]
    profiles.delete(ident)
    assert len(profiles.list()) == 1
    ImageConfig(fine_hash_size=16).save(tmp_path / "c.json")
    assert ImageConfig.load(tmp_path / "c.json").fine_hash_size == 16
    (tmp_path / "c.json").write_text("{broken")
    assert ImageConfig.load(tmp_path / "c.json") == ImageConfig()


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return b.getvalue()


def tarred(mode, **files):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode=mode) as t:
        for n, x in files.items():
            i = tarfile.TarInfo(n)
            i.size = len(x)
            t.addfile(i, io.BytesIO(x.encode()))
    return b.getvalue()


def test_archives(spark, tmp_path):
    put(
        tmp_path, one_dot_zip=zipped(a="A", b="B"), two_dot_tar_dot_gz=tarred("w:gz", a="A", c="B"), three_dot_tar=tarred("w", x="A", y="other"),
        lone_dot_zip=zipped(q="Q"), lying_dot_cbz=b"Rar!\x1a\x07\x00 data", broken_dot_zip=b"PK\x03\x04junk",
    )
    _, r = groups(spark, tmp_path, scan_archives=True)
    got = {os.path.basename(a.archive): (a.total_entries, a.duplicated_entries, a.can_delete) for a in r.archives.collect()}
    assert got == {"one.zip": (2, 2, True), "two.tar.gz": (2, 2, True), "three.tar": (2, 1, False)}


def test_archive_formats(spark):
    import zstandard

    names = ["a.TAR.GZ", "b.cbz", "c.rar", "d.tar.zst", "e.7z", "f.txz"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(archive_source.detected("n").alias("k")).collect()
    assert [r.k for r in got] == ["TarGz", "Zip", None, "TarZst", "SevenZip", "TarXz"]
    data = zstandard.compress(tarred("w", a="A"))
    assert archive_source.read_entry("TarZst", data, "a") == b"A"
    assert list(archive_source.entries_of("Zip", b"junk")) == []
    ok = spark.createDataFrame([("Zip", b"PK\x03\x04"), ("Zip", b"P"), ("Tar", b"x" * 300), ("Zip", None)], "k string, c binary").select(archive_source.verified("k", "c").alias("v")).collect()
    assert [r.v for r in ok] == [True, False, False, True]


def test_components_match_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_text_filter_is_literal(spark):
    g = spark.createDataFrame([("g1", "a"), ("g2", "vac%")], "group_key string, folder_key string")
    m = spark.createDataFrame([("g1", "x_y", "/p/x_y"), ("g2", "n", "/p/n")], "group_key string, name string, path string")
    find = lambda q: sorted(r.group_key for r in filters.text_filter(g, m, q).collect())
    assert find("%") == ["g2"] and find("X_Y") == ["g1"] and find("  ") == ["g1", "g2"]


def test_incremental(spark, tmp_path):
    from twinlake.streaming import incremental

    put(tmp_path / "in", a="1", b="1")
    cache, check = str(tmp_path / "cache"), str(tmp_path / "check")
    incremental.watch(spark, str(tmp_path / "in"), cache, check).awaitTermination()
    found = state.load_table(spark, cache, incremental.CACHE)
    assert found.count() == 2 and incremental.duplicates(found).first().n == 2
    put(tmp_path / "in", c="2")
    incremental.watch(spark, str(tmp_path / "in"), cache, check).awaitTermination()
    assert state.load_table(spark, cache, incremental.CACHE).count() == 3


def test_rescan_reads_no_content(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    for i in range(12):
        (folder / f"f{i}.txt").write_bytes(b"x" * 5000 + bytes([i % 3]))
    (folder / "alone.txt").write_bytes(b"y")
    p = ScanParams(folder=str(folder), recursive=True)
    plain = sorted(map(tuple, scan(spark, p).groups.collect()))
    first = scan(spark, p, cache_path=cache)
    assert sorted(map(tuple, first.groups.collect())) == plain and files_read(spark, cache) == 12
    before = len(state.versions(spark, f"{cache}/exact"))
    again = scan(spark, p, cache_path=cache)
    assert sorted(map(tuple, again.groups.collect())) == plain
    new = [v for _, _, v in state.versions(spark, f"{cache}/exact")][before:]
    assert len(new) == 2 and all(spark.read.parquet(v).count() == 0 for v in new)
    # a changed file is read again, and only it
    (folder / "f0.txt").write_bytes(b"x" * 5000 + bytes([1]))
    os.utime(folder / "f0.txt", (1, 1))
    changed = scan(spark, p, cache_path=cache)
    assert sorted(map(tuple, changed.groups.collect())) == sorted(map(tuple, scan(spark, p).groups.collect())) != plain
    assert files_read(spark, cache) == 1


def test_kept_tables_survive_a_crash(spark, tmp_path):
    path, schema = str(tmp_path / "kept"), "path string, n int"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    state.save_table(frame(("a", 1), ("b", 1)), path)
    state.append_table(frame(("b", 2), ("c", 2)), path)
    assert {tuple(r) for r in state.load_table(spark, path, schema, "path").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    # a version that was not written to its end doesn't count
    shutil.copytree(state.versions(spark, path)[-1][2].removeprefix("file:"), f"{path}/whole-9")
    os.remove(f"{path}/whole-9/_SUCCESS")
    assert len(state.versions(spark, path)) == 2
    # replaced by a plan that reads it
    state.save_table(state.load_table(spark, path, schema, "path").where("n = 2"), path)
    state.save_table(state.load_table(spark, path, schema, "path").where("path = 'c'"), path)
    assert [tuple(r) for r in state.load_table(spark, path, schema, "path").collect()] == [("c", 2)]


def test_plans(spark):
    """No pair query is a theta join, also where nothing may be broadcast, and no content leaves the scan's stage."""
    from twinlake import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("image_pairs_nested", "image_pairs_aspect", "image_pairs_coarse", "image_pairs_by_folder", "audio_pairs", "video_pairs_dtw", "archive_image_links", "archive_audio_links", "image_pairs_bucket"):
            plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        for name in ("exact_groups", "exact_members_origin_order", "partial_hash_groups"):
            plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and all("text" not in line.split("Exchange", 1)[1] for line in plan.split("\n") if "Exchange" in line), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_groups_keep_their_order(spark):
    """One digest of a third of all rows, with null names and times: positions as by one sort."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from twinlake.operators import exact

    rows = [(f"/p/{i:05d}", None if i % 50 == 0 else f"n{i % 400}", None if i % 70 == 0 else i % 5, "hot" if i % 3 == 0 else f"d{i // 4}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "path string, name string, modified long, full string, size long")
    got = {r.path: (r.group_key, r.pos) for r in exact.exact_members(df).collect()}
    w = W.partitionBy("full")
    want = df.withColumn("n", F.count("*").over(w)).withColumn("k", F.min("path").over(w)).withColumn("p", F.row_number().over(w.orderBy("modified", "name", "path")) - 1).where("n >= 2")
    assert got == {r.path: (r.k, r.p) for r in want.collect()}


def test_pictures_are_remembered_and_cancelled_scans_are_partial(spark, tmp_path, monkeypatch):
    from twinlake.plans import scan as plans
    from twinlake.sources.files import inventory as listed

    calls = []

    def hashes(rows):
        calls.append(rows.count())
        return rows.selectExpr("*", "cast(size as bigint) as fine", "0L as coarse", "1.0D as aspect")

    put(tmp_path / "in", a_dot_png="x", b_dot_png="yy")
    p = ScanParams(folder=str(tmp_path / "in"), recursive=True)
    files = listed(spark, p)
    settings = {"coarse_size": 4, "fine_size": 8, "thumbnail_setting": True}
    for _ in range(2):
        got = plans.remembered(files, str(tmp_path / "cache"), "image", settings, hashes)
        assert sorted((r.name, r.fine) for r in got.collect()) == [("a.png", 1), ("b.png", 2)]
    assert calls == [2]
    plans.remembered(files, str(tmp_path / "cache"), "image", settings | {"fine_size": 16}, hashes)
    assert calls == [2, 2]

    def cancelled(*_):
        raise RuntimeError("Job 3 cancelled as part of cancellation of all jobs")

    monkeypatch.setattr(plans, "image_phase", cancelled)
    r = scan(spark, ScanParams(folder=str(tmp_path / "in"), recursive=True, find_similar=True, scan_archives=True))
    assert r.partial and r.archives is None and r.groups.count() == 0


def test_archives_are_opened_once_for_their_counts(spark):
    """Entries and large ones in one pass over the archives; broken ones and those without content have none."""
    import io
    import tarfile
    import zipfile

    from pyspark.sql import functions as F

    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", b"x" * 150)
        f.writestr("b", b"y")
    with tarfile.open(fileobj=t, mode="w") as f:
        i = tarfile.TarInfo("a")
        i.size = 3
        f.addfile(i, io.BytesIO(b"abc"))
    data = [("z", "Zip", z.getvalue()), ("t", "Tar", t.getvalue()), ("bad", "Zip", b"junk"), ("none", "Zip", None), ("kind", None, b"x")]
    archives = spark.createDataFrame(data, "path string, format string, content binary")
    got = archive_source.counts(archives, large=F.col("size") >= 100)
    size = len(t.getvalue()) * 4
    assert sorted(map(tuple, got.collect())) == sorted([("z", "Zip", 2, 151, 1), ("t", "Tar", 1, size, 0), ("bad", "Zip", 0, 0, 0), ("none", "Zip", 0, 0, 0), ("kind", None, 0, 0, 0)])
    assert {r.path: (r.n_entries, r.estimate) for r in archive_source.counts(archives, F.col("size") < 100).collect()} == {"z": (1, 1), "t": (1, size), "bad": (0, 0), "none": (0, 0), "kind": (0, 0)}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInPandas") == 1 and "Join" not in plan
