"""Registered queries of functions, orders, archive formats and results that `catalog` does not hold already."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.catalog import AUDIO, DURATION, FILES, GROUPS, IMAGES, MEMBERS, PRINT, _CACHE, _groups, _ignored, _members, distance, query, reach
from twinlake.functions import media, scalar
from twinlake.operators import archives, caches, exact, export, filters, pairs, select, session
from twinlake.params import ScanParams
from twinlake.session import ship
from twinlake.sources import archives as archive_source
from twinlake.sources import records


def _docs(spark, sf) -> DataFrame:
    return records.table(spark, sf, "documents")


def _pick(names: tuple, n: int):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % n + 1).cast("int"))


# --- filters and modes


@query("select count(*) as under, 0::bigint as over from documents")
def inventory_saturated_bounds(spark, sf):
    """Bounds beyond what sizes can be: none is over the least, all are under the greatest."""
    f = records.files(spark, sf, content=False)
    under = f.where(filters.inventory_predicate(ScanParams(max_file_size_kb=2**60))).agg(F.count("*").alias("under"))
    return under.join(f.where(filters.inventory_predicate(ScanParams(min_file_size_kb=2**60))).agg(F.count("*").alias("over")))  # one row each


@query("""with e as (select ['jpg','mp4','mp3','txt'][doc_id % 4 + 1] as x from documents)
  select 'one' as flags, count(*) filter (x = 'jpg') as n from e union all select 'two', count(*) from e union all select 'none', count(*) from e""")
def single_mode_filter(spark, sf):
    named = _docs(spark, sf).select(F.concat(F.lit("a."), _pick(("jpg", "mp4", "mp3", "txt"), 4)).alias("name"))
    flags = {"one": ScanParams(find_similar=True), "two": ScanParams(find_similar=True, find_similar_audio=True), "none": ScanParams()}
    out = [filters.restrict_mode(named, p.single_mode()).agg(F.count("*").alias("n")).select(F.lit(k).alias("flags"), "n") for k, p in flags.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"with {FILES} select path from files where modified >= 1699920000 and modified <= 1700002799")
def inventory_date_bounds(spark, sf):
    low, high = scalar.date_bounds("2023-11-14", "2023-11-14", 60)
    return records.files(spark, sf, content=False).where(filters.inventory_predicate(ScanParams(min_modified_timestamp=low, max_modified_timestamp=high))).select("path")


# --- session views and orders


@query(f"""with {GROUPS}, seen as (select * from groups where ignore_key not in (select ignore_key from ignored)),
  hit as (select * from seen g where contains(lower(folder_key), 'src1/') or exists (
    select 1 from members m where m.group_key = g.group_key and (contains(lower(m.name), 'src1/') or contains(lower(m.path), 'src1/'))))
  select count(*) as n_groups, coalesce(sum(waste), 0)::bigint as total_waste from hit""")
def session_filtered_view(spark, sf):
    g, m = _groups(spark, sf)
    return exact.total_waste(filters.text_filter(filters.minus_ignored(g, _ignored(g, m)), m, "src1/"))


@query(f"with {GROUPS}, f as (select folder_key, count(*) as group_count, sum(waste)::bigint as total_wasted_bytes from groups group by folder_key) select * from f order by total_wasted_bytes desc, folder_key limit 20")
def folders_by_waste(spark, sf):
    return session.sorted_folders(exact.folder_summary(_groups(spark, sf)[0])).limit(20)


@query(f"with {GROUPS}, f as (select folder_key, count(*) as group_count, sum(waste)::bigint as total_wasted_bytes from groups group by folder_key) select * from f order by folder_key limit 5")
def folders_by_name(spark, sf):
    return session.sorted_folders(exact.folder_summary(_groups(spark, sf)[0]), "name").limit(5)


@query(f"with {GROUPS} select ignore_key, waste % 1000 as ignored_at from groups order by 2 desc, 1 limit 15")
def ignore_list_order(spark, sf):
    g = _groups(spark, sf)[0].select("ignore_key", (F.col("waste") % 1000).alias("ignored_at"))
    return session.newest_first(g, "ignored_at", "ignore_key").limit(15)


@query(f"""with {GROUPS}, s as (select substr(hash, 1, 1) as id, waste, ignore_key from groups), seen as (select * from s where ignore_key not in (select ignore_key from ignored))
  select id, (select count(*) from seen where seen.id = k.id) as n_groups, coalesce((select sum(waste) from seen where seen.id = k.id), 0)::bigint as total_waste
  from (select distinct id from s) k order by id desc""")
def session_list(spark, sf):
    g, m = _groups(spark, sf)
    of = g.withColumn("id", F.substring("hash", 1, 1))
    return session.session_list(of.select("id").distinct(), of.select("id", "ignore_key", "waste"), _ignored(g, m))


@query(f"with {MEMBERS} select group_key, path from members where pos > 0")
def select_unknown_rule(spark, sf):
    return select.selected(_members(spark, sf), "no such rule").select("group_key", "path")


@query(f"""with recursive {GROUPS}, {IMAGES}, edges as (select a.id as a, b.id as b from pics a join pics b on a.id < b.id and {distance("a.fine", "b.fine")} <= 14), {reach("edges")},
  im as (select '/pics/' || pics.id || '.png' as path, pics.id || '.png' as name, size, 1700000000 + pics.id % 5 as modified, component from pics join parts on parts.id = pics.id),
  ranked as (select *, row_number() over (partition by component order by modified, name, path) - 1 as pos from im),
  ig as (select min(path) as group_key, count(*) as n, arg_min(size, pos) * (count(*) - 1) as waste from ranked group by component)
  select 'exact' as kind, group_key, n, waste::bigint as waste from groups union all select 'image', group_key, n, waste::bigint from ig""")
def scan_union_of_phases(spark, sf):
    im = records.images(spark, sf)
    of = pairs.groups_of(pairs.image_pairs_nested(im, 14)).select("id", "group_id")
    rows = im.select(
        "id", F.concat(F.lit("/pics/"), F.col("id").cast("string"), F.lit(".png")).alias("path"), F.concat(F.col("id").cast("string"), F.lit(".png")).alias("name"),
        "size", (F.lit(1700000000) + F.col("id") % 5).alias("modified"), F.lit("pics").alias("folder"),
    )
    similar = exact.group_rows(exact.origin_order(rows.join(of, "id"), "group_id"), "image")
    return _groups(spark, sf)[0].unionByName(similar).select("kind", "group_key", "n", "waste")


# --- functions


@query("""select doc_id, floor((1 - p / 100) * 64 + 0.5)::int as bits, (100 - p)::int as share, (1 - (doc_id % 65) / 64.0::double) * 100 as score
  from (select doc_id, (doc_id % 101)::double as p from documents)""")
def similarity_percent(spark, sf):
    p = (F.col("doc_id") % 101).cast("double")
    return _docs(spark, sf).select("doc_id", scalar.percent_to_bits(p).alias("bits"), scalar.audio_percent(p).cast("int").alias("share"), scalar.similarity_score(F.col("doc_id") % 65, 64).alias("score"))


@query("select doc_id, (case when h = 0 then 1 else w / h end)::float::double as aspect from (select doc_id, (doc_id % 4000 + 1)::double as w, (doc_id % 7 * 300)::double as h from documents)")
def picture_aspect(spark, sf):
    w, h = (F.col("doc_id") % 4000 + 1).cast("double"), (F.col("doc_id") % 7 * 300).cast("double")
    return _docs(spark, sf).select("doc_id", scalar.aspect(w, h).cast("double").alias("aspect"))


@query("""select doc_id, case when s >= 1073741824 then printf('%.1f GB', round_even(s / 1073741824.0, 1)) when s >= 1048576 then printf('%.1f MB', round_even(s / 1048576.0, 1))
    when s >= 1024 then printf('%.0f KB', round_even(s / 1024.0, 0)) else s || ' B' end as notified,
  case when s >= 1073741824 then printf('%.2f Go', floor(s / 1073741824.0 * 100 + 0.5) / 100) when s >= 1048576 then printf('%.1f Mo', floor(s / 1048576.0 * 10 + 0.5) / 10)
    when s >= 1024 then printf('%.1f Ko', floor(s / 1024.0 * 10 + 0.5) / 10) else s || ' o' end as shown
  from (select doc_id, (n_chars * (doc_id % 3 + 1) * case when doc_id % 5 = 0 then 1000 when doc_id % 5 = 1 then 1000000 else 1 end)::bigint as s from documents)""")
def format_size_styles(spark, sf):
    size = F.col("n_chars") * (F.col("doc_id") % 3 + 1) * F.when(F.col("doc_id") % 5 == 0, 1000).when(F.col("doc_id") % 5 == 1, 1000000).otherwise(1)
    return _docs(spark, sf).select("doc_id", scalar.format_size(size, "notification").alias("notified"), scalar.format_size(size, "screen").alias("shown"))


@query("""select doc_id, md5(case when regexp_matches(text, '[,"\\n]') then '"' || replace(text, '"', '""') || '"' else text end) as csv,
  md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as html
  from (select doc_id, '<a href="' || doc_id || '">' || text as text from documents where text is not null union all select -doc_id - 1, text from documents where text is not null)""")
def escaped_fields(spark, sf):
    d = _docs(spark, sf).where("text is not null")
    both = d.select("doc_id", F.concat(F.lit('<a href="'), F.col("doc_id").cast("string"), F.lit('">'), "text").alias("text")).unionByName(d.select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    return both.select("doc_id", F.md5(scalar.csv_field("text")).alias("csv"), F.md5(scalar.html_field("text")).alias("html"))


@query("""select doc_id, case when need + 1073741824 - free > 0 then need + 1073741824 - free end as deficit
  from (select doc_id, n_chars::bigint * 1000000 as need, doc_id::bigint * 10000000 as free from documents)""")
def disk_deficit(spark, sf):
    return _docs(spark, sf).select("doc_id", scalar.disk_deficit(F.col("n_chars").cast("bigint") * 1000000, F.col("doc_id").cast("bigint") * 10000000).alias("deficit"))


@query("""select doc_id, doc_id % 3 = 0 or doc_id % 3 = 1 and doc_id % 4 = 0 as shown from documents""")
def browser_shown(spark, sf):
    """Pictures that a browser shows: by name, or GIFs that are such by their first bytes too."""
    name = F.concat(F.lit("x."), _pick(("PNG", "gif", "tiff"), 3))
    content = F.when(F.col("doc_id") % 4 == 0, F.lit(b"GIF89a...")).otherwise(F.lit(b"\x89PNG...."))
    return _docs(spark, sf).select("doc_id", (scalar.browser_native(name) | scalar.is_animated_gif(name, content)).alias("shown"))


@query("select doc_id, w as width, h as height from (select doc_id, (doc_id % 5000 + 1)::int as w, (doc_id % 3000 + 7)::int as h from documents)")
def header_dimensions(spark, sf):
    """Headers of PNG and JPEG files, read back."""
    w, h = F.col("doc_id") % 5000 + 1, F.col("doc_id") % 3000 + 7
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(h), 8, "0"))
    jpeg = F.concat(F.lit("FFD8FFE000061122334FFFC0001108"), F.lpad(F.hex(h), 4, "0"), F.lpad(F.hex(w), 4, "0"), F.lit("0301"))
    jpeg = F.replace(jpeg, F.lit("1122334F"), F.lit("11223344"))
    content = F.unhex(F.when(F.col("doc_id") % 2 == 0, png).otherwise(jpeg))
    ship(spark)
    return _docs(spark, sf).withColumn("d", media.image_dimensions(content)).select("doc_id", "d.width", "d.height")


@query("select doc_id, i, duration * (0.1::double + 0.8::double * (i + 0.5::double) / 8) as at from (select doc_id, n_chars / 7.0::double as duration from documents), range(8) t(i)")
def frame_times(spark, sf):
    times = F.pandas_udf(lambda d: d.map(lambda x: media.frame_times(x, 8)), T.ArrayType(T.DoubleType()))
    ship(spark)
    d = _docs(spark, sf).where("n_chars is not null").select("doc_id", F.posexplode(times(F.col("n_chars") / F.lit(7.0))).alias("i", "at"))
    return d.select("doc_id", F.col("i").cast("bigint").alias("i"), "at")


_PIXELS = "select vec_id, [floor((x + 1) * 100)::bigint for x in embedding[1:64]] as p from embeddings"


@query(f"select vec_id, list_sum([case when p[i + 1] >= list_sum(p) // 64 then 1::ubigint << i else 0::ubigint end for i in range(64)])::ubigint::varchar as hash from ({_PIXELS})")
def mean_hashes(spark, sf):
    ship(spark)
    hashed = F.pandas_udf(lambda v: v.map(lambda p: str(media.mean_hash(p))), T.StringType())
    # in the vectors' own single precision, as the SQL has it: doubles round some products to the other side of a whole number
    one, scale = F.lit(1).cast("float"), F.lit(100).cast("float")
    pixels = F.transform(F.slice("embedding", 1, 64), lambda x: F.floor((x + one) * scale).cast("bigint"))
    return records.table(spark, sf, "embeddings").select("vec_id", hashed(pixels).alias("hash"))


@query("""select vec_id, (vec_id % 3)::int as left_, (vec_id % 4)::int as right_, (vec_id % 2)::int as top_, (vec_id % 5)::int as bottom_,
  [((g[1] + g[2] + g[3] + g[4]) // 4)::int for g in [[(vec_id * 7 + (2 * (k // 8) + d // 2) * 13 + (2 * (k % 8) + d % 2) * 29) % 256 for d in range(4)] for k in range(64)]]::varchar as means from embeddings""")
def frame_border_and_means(spark, sf):
    """Dark borders of frames, and the frame of 16 by 16 in 8 by 8 means."""
    def run(v: pd.Series) -> pd.DataFrame:
        out = []
        for i in v:
            inner = np.arange(256).reshape(16, 16)
            gray = (int(i) * 7 + (inner // 16) * 13 + (inner % 16) * 29) % 256
            framed = np.zeros((16 + i % 2 + i % 5, 16 + i % 3 + i % 4), int)
            framed[i % 2 : i % 2 + 16, i % 3 : i % 3 + 16] = gray.clip(60)
            border = media.dark_border(framed)
            framed[i % 2 : i % 2 + 16, i % 3 : i % 3 + 16] = gray
            means = media.block_means(framed, border)
            out.append((*border, "[" + ", ".join(map(str, means.ravel().tolist())) + "]"))
        return pd.DataFrame(out, columns=["left_", "right_", "top_", "bottom_", "means"])

    ship(spark)
    kind = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("left_", "right_", "top_", "bottom_")], T.StructField("means", T.StringType())])
    return records.table(spark, sf, "embeddings").withColumn("r", F.pandas_udf(run, kind)("vec_id")).select("vec_id", "r.*")


@query("select vec_id, list_sum([case when embedding[(k // 8 * 9 + k % 8 + 1) % 64 + 1]::double < embedding[(k // 8 * 9 + k % 8) % 64 + 1]::double - 1e-9 then 1::ubigint << k else 0::ubigint end for k in range(64)])::ubigint::varchar as hash from embeddings")
def gradient_hashes(spark, sf):
    """Gradient hashes of pictures of 32 rows and 36 columns that are made of 8 by 9 even parts."""
    def one(v) -> str:
        parts = np.asarray(v, float)[np.arange(72) % 64].reshape(8, 9)
        return str(int.from_bytes(media.gradient_hash(np.kron(parts, np.ones((4, 4))), 8), "little"))

    ship(spark)
    return records.table(spark, sf, "embeddings").select("vec_id", F.pandas_udf(lambda v: v.map(one), T.StringType())("embedding").alias("hash"))


# --- archive formats


def _packed(spark, sf, kinds: tuple[str, ...]) -> DataFrame:
    """Every document as an archive, a line an entry: (path, format, content), the format by its id."""
    import io
    import tarfile
    import zipfile

    ship(spark)

    def one(kind: str, text: str) -> bytes:
        out = io.BytesIO()
        lines = [x.encode() for x in text.split("\n")]
        if kind == "Zip":
            with zipfile.ZipFile(out, "w") as z:
                for k, x in enumerate(lines):
                    z.writestr(f"p{k}", x)
            return out.getvalue()
        with tarfile.open(fileobj=out, mode={"Tar": "w", "TarGz": "w:gz", "TarBz2": "w:bz2", "TarXz": "w:xz"}.get(kind, "w"), format=tarfile.USTAR_FORMAT) as t:
            for k, x in enumerate(lines):
                i = tarfile.TarInfo(f"p{k}")
                i.size = len(x)
                t.addfile(i, io.BytesIO(x))
        if kind == "TarZst":
            import zstandard

            return zstandard.ZstdCompressor().compress(out.getvalue())
        return out.getvalue()

    def run(frames):
        for f in frames:
            held, most = [], 0
            for i, kind, text in zip(f["doc_id"], f["kind"], f["text"], strict=True):
                held.append((str(i), kind, one(kind, text or "")))
                most += len(held[-1][2])
                # a frame costs more than a small archive, and a large one fills it
                if most > 1 << 20:
                    yield pd.DataFrame(held, columns=["path", "format", "content"])
                    held, most = [], 0
            yield pd.DataFrame(held, columns=["path", "format", "content"])

    return _docs(spark, sf).select("doc_id", _pick(kinds, len(kinds)).alias("kind"), "text").mapInPandas(run, "path string, format string, content binary")


_LINES = "(select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)"


@query(f"select doc_id::varchar as archive, 'p' || (i - 1) as internal_path, md5(lines[i]) as hash, strlen(lines[i])::bigint as size from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from {_LINES})")
def archive_scan_tars(spark, sf):
    t = _packed(spark, sf, ("Tar", "TarGz", "TarBz2", "TarXz", "TarZst"))
    return archive_source.entries(t.where(archive_source.verified("format", "content"))).drop("pos")


@query(f"""select doc_id::varchar as path, len(lines)::bigint as n_entries, list_sum([strlen(x) for x in lines])::bigint as estimate,
  len([x for x in lines if strlen(x) >= 100])::bigint as n_large from {_LINES}""")
def archive_counts(spark, sf):
    return archive_source.counts(_packed(spark, sf, ("Zip",)), n_large=F.col("size") >= 100).select("path", "n_entries", "estimate", "n_large")


@query(f"select doc_id::varchar as path, md5(lines[2]) as second from {_LINES}")
def archive_one_entry(spark, sf):
    def run(kind, content):
        import hashlib

        got = [archive_source.read_entry(k, bytes(c), "p1") for k, c in zip(kind, content, strict=True)]
        return pd.Series([None if g is None else hashlib.md5(g, usedforsecurity=False).hexdigest() for g in got])

    return _packed(spark, sf, ("Zip", "TarGz")).select("path", F.pandas_udf(run, T.StringType())("format", "content").alias("second"))


# --- archives by likeness


_LIKE = f"""{IMAGES}, e as (select 'arch' || (id % 20) as archive, id as internal_path, fine, coarse, md5((fine & 1023::ubigint)::varchar) as hash, id as pos from pics),
  twice as (select hash, min(archive) as lead from e group by hash having count(distinct archive) >= 2),
  free as (select * from e where hash not in (select hash from twice)),
  near as (select a.archive as xa, b.archive as xb, a.internal_path as pa, b.internal_path as pb from free a join free b on a.archive < b.archive and {distance("a.coarse", "b.coarse")} <= 14 and {distance("a.fine", "b.fine")} <= 14),
  links as (select a, b, sum(shared) as shared from (
    select lead as a, archive as b, count(*) as shared from (select distinct archive, hash from e) join twice using (hash) where archive <> lead group by all
    union all select xa, xb, count(distinct pa) from near group by all) group by all)"""


def _like(spark, sf):
    e = records.images(spark, sf).select(
        F.concat(F.lit("arch"), (F.col("id") % 20).cast("string")).alias("archive"), F.col("id").alias("internal_path"), "fine", "coarse",
        F.md5(F.col("fine").bitwiseAND(F.lit(1023)).cast("string")).alias("hash"), F.col("id").alias("pos"),
    )
    near = archives.image_links(archives.unmatched(e, e.select("archive", "internal_path", "fine", "coarse")), 14)
    return e, near, archives.all_links(archives.exact_links(e), archives.linked(near))


@query(f"with {_LIKE} select a, b, shared::bigint as shared from links")
def archive_links_all_kinds(spark, sf):
    return _like(spark, sf)[2]


@query(f"""with recursive {_LIKE}, {reach("links")}, g as (select e.*, component as group_id from e join parts on parts.id = e.archive),
  ok as (select group_id, hash from g group by all having count(distinct archive) >= 2),
  m as (select g.archive, g.internal_path from g join ok using (group_id, hash) union select xa, pa from near union select xb, pb from near)
  select g.archive, g.group_id, count(*) as total_entries, count(m.internal_path) as duplicated_entries, count(*) = count(m.internal_path) as can_delete
  from g left join m on m.archive = g.archive and m.internal_path = g.internal_path group by all""")
def archive_recompute_all_kinds(spark, sf):
    e, near, links = _like(spark, sf)
    return archives.recompute(e, archives.archive_groups(links), near)


@query(f"""with recursive {AUDIO}, s as (select *, row_number() over (order by id) as r from audio),
  near as (select a.id as a, b.id as b, {PRINT} as d from s a join s b on a.id % 2 = 0 and b.id % 2 = 1 and {DURATION} and {PRINT} <= 0.08::double),
  turn(k, taken, a, b, d) as (
    select 0, []::bigint[], null::bigint, null::bigint, null::double
    union all
    select t.k + 1, case when n.b is null then t.taken else list_append(t.taken, n.b) end, n.a, n.b, n.d
    from turn t join (select a, row_number() over (order by a) as k from (select distinct a from near)) o on o.k = t.k + 1
    left join lateral (select near.a, near.b, near.d from near where near.a = o.a and not list_contains(t.taken, near.b) order by near.d, near.b limit 1) n on true)
  select a::varchar as a, b::varchar as b, d as distance, (1 - d) * 100 as score from turn where a is not null""")
def archive_compare_audio(spark, sf):
    a = records.audio(spark, sf).select(F.col("id").cast("string").alias("internal_path"), "fp", "duration", F.col("id").alias("pos"))
    return archives.compare_audio(a.where("pos % 2 = 0"), a.where("pos % 2 = 1"), 0.08, 0.2)


# --- caches of the other kinds, exports


@query("""with f as (select doc_id::varchar as path, n_chars::bigint as mtime, 4 as coarse_size, 8 as fine_size, true as thumbnail_setting, 8 as n_frames, 1 as algorithm_version, n_chars::bigint as size, doc_id from documents)
  select path, doc_id % 7 <> 0 and doc_id % 5 <> 0 as image_hit, doc_id % 7 <> 0 and doc_id % 3 <> 0 as video_hit, doc_id % 7 <> 0 as audio_hit from f""")
def cache_lookup_media(spark, sf):
    """Caches that lack a seventh of the files, with other picture settings for a fifth and other frames for a third."""
    f = _docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("path"), F.col("n_chars").cast("bigint").alias("mtime"), F.col("n_chars").cast("bigint").alias("size"), F.lit(4).alias("coarse_size"), F.lit(8).alias("fine_size"),
        F.lit(True).alias("thumbnail_setting"), F.lit(8).alias("n_frames"), F.lit(1).alias("algorithm_version"), "doc_id",
    )
    held = f.where("doc_id % 7 <> 0")
    image = held.select("path", "mtime", F.when(F.col("doc_id") % 5 == 0, 3).otherwise(4).alias("coarse_size"), "fine_size", "thumbnail_setting")
    video = held.select("path", "mtime", "size", F.when(F.col("doc_id") % 3 == 0, 4).otherwise(8).alias("n_frames"), "algorithm_version")
    out = f.select("path")
    for kind, cache in (("image", image), ("video", video), ("audio", held.select("path", "mtime", "size"))):
        out = out.join(caches.lookup(f, cache, kind).select("path", F.col("hit").alias(f"{kind}_hit")), "path")
    return out


@query(f"with {_CACHE} select f.path from files f left join cache c on c.path = f.path and c.mtime = f.modified and c.size = f.size where c.path is null")
def cache_misses(spark, sf):
    """What a rescan has to hash."""
    return caches.misses(records.files(spark, sf, content=False).withColumnRenamed("modified", "mtime"), records.exact_cache(spark, sf)).select("path")


@query(f"""with {GROUPS}, z as (select *, case when waste >= 1048576 then printf('%.1f Mo', waste / 1048576.0) when waste >= 1024 then printf('%.1f Ko', waste / 1024.0) else waste || ' o' end as w from groups),
  t as (select count(*) as n, coalesce(sum(waste), 0)::bigint as b from groups)
  select 1 as part, group_key, '<tr class="group"><td colspan="4">identical - ' || n || ' files - ' || w || ' wasted</td></tr>' as value from z
  union all select 0, '', '<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Duplicates</title></head><body><ul><li><b>7</b> files scanned</li><li><b>' || n || '</b> groups</li><li><b>'
    || case when b >= 1048576 then printf('%.1f Mo', b / 1048576.0) when b >= 1024 then printf('%.1f Ko', b / 1024.0) else b || ' o' end || '</b> recoverable</li><li><b>/a&amp;b</b> folder</li></ul><table><tbody>' from t
  union all select 2, '', '</tbody></table></body></html>'""")
def export_html_heads(spark, sf):
    """The lines of a report but those of its files."""
    g, m = _groups(spark, sf)
    return export.html_lines(g, m, 7, "/a&b").where("part <> 1 or pos < 0").select("part", "group_key", "value")
