import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from twinlake.functions import media, scalar


def rows(spark, data, schema, **cols):
    return spark.createDataFrame(data, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [([1, 2], [1, 2], 0.0), ([0], [-1], 1.0), ([0x0000FFFF], [0], 0.5), ([], [1], 1.0), ([7, 7, 7, 7], [7], 0.0)],
)
def test_fingerprint_distance(spark, a, b, expected):
    assert rows(spark, [(a, b)], "a array<int>, b array<int>", d=scalar.fingerprint_distance("a", "b"))[0].d == expected


def test_sequence_distance(spark):
    got = rows(spark, [([], [1]), ([0, 0, 0], [0, 0]), ([0], [-1])], "a array<bigint>, b array<bigint>", d=scalar.sequence_distance("a", "b"))
    assert [r.d for r in got] == [64.0, 0.0, 64.0]


def test_dtw():
    h, z = 12345, ~12345
    assert media.dtw_distance([h] * 8, [h] * 10) == 0.0
    a, b = [h, z] * 4, [z, h] * 4
    sequence = np.mean([int(x ^ y).bit_count() if x ^ y >= 0 else 64 for x, y in zip(a, b, strict=True)])
    assert media.dtw_distance(a, b) < sequence
    assert media.dtw_distance([], [1]) == 64.0


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=9), st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=9))
def test_dtw_is_bounded(a, b):
    d = media.dtw_distance(a, b)
    assert 0 <= d <= 128
    assert media.dtw_distance(a, a) == 0


def test_borders():
    g = np.full((32, 32), 200)
    g[:, :10] = 0
    g[:, 22:] = 0
    assert media.dark_border(g) == (10, 10, 0, 0)
    assert media.dark_border(np.zeros((32, 32))) == (0, 0, 0, 0)
    assert media.block_means(np.full((32, 32), 9)).tolist() == [[9] * 8] * 8
    assert media.mean_hash(np.full((8, 8), 5)) == 2**64 - 1
    assert media.frame_hashes([g, None]) is None


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 1920, 1080)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 720, 1280)
    assert media.image_size(png) == (1920, 1080)
    assert media.image_size(jpeg) == (1280, 720)
    assert media.image_size(png[:10]) is None
    assert media.image_size(b"RIFF____WEBP") is None


def test_gradient_hash_is_stable_in_size():
    y, x = np.mgrid[0:64, 0:64]
    big = np.mgrid[0:128, 0:128]
    small, large = media.gradient_hash(np.sin(x / 9) + y, 8), media.gradient_hash(np.sin(big[1] / 18) + big[0] / 2, 8)
    assert sum((a ^ b).bit_count() for a, b in zip(small, large, strict=True)) <= 6


def test_thresholds():
    assert scalar.coarse_threshold(10, 4, 8, 2.0) == 5
    assert scalar.coarse_threshold(0, 4, 8, 2.0) == 0
    assert scalar.percent_to_bits(100) == 0 and scalar.percent_to_bits(90) == 6
    assert scalar.saturating_kb(2**60) == 2**64 - 1


def test_names_and_sizes(spark):
    got = rows(
        spark, [("/r/a/b.JPG", 1536), ("/r/.hid", 2097152), ("/x/c.tar.gz", 5), ("/r/d", 1288490189)], "p string, s bigint",
        e=scalar.extension("p"), k=scalar.media_class("p"), f=scalar.first_level_folder("p", "/r"), z=scalar.format_size("s"), b=scalar.basename("p"),
    )
    assert [tuple(r) for r in got] == [("jpg", "image", "a", "1.5 Ko", "b.JPG"), ("", "other", "", "2.0 Mo", ".hid"), ("gz", "other", "", "5 o", "c.tar.gz"), ("", "other", "", "1.20 Go", "d")]


def test_csv_and_html(spark):
    got = rows(spark, [('a,"b"',), ("plain",), ("<&>",)], "s string", c=scalar.csv_field("s"), h=scalar.html_field("s"))
    assert [r.c for r in got] == ['"a,""b"""', "plain", "<&>"]
    assert got[2].h == "&lt;&amp;&gt;"


def test_parsers(spark):
    text = "DURATION=183\nFINGERPRINT=1885693234,-2113929216,x,42"
    r = rows(spark, [(text,), ("nothing",)], "t string", p=scalar.parse_fingerprint("t"))
    assert r[0].p.words == [1885693234, -2113929216, 42] and r[0].p.duration == 183.0
    assert r[1].p is None
    assert rows(spark, [("not json",)], "t string", p=scalar.parse_probe("t"))[0].p.n_tracks == 0


def test_driver_rules():
    assert scalar.should_notify(5000, 5) and not scalar.should_notify(4999, 5)
    assert scalar.notification_body(0, 0) == "No duplicates found."
    assert scalar.notification_body(2, 1 << 20) == "2 groups found - 1.0 MB recoverable"
    assert scalar.disk_warning(10, 5) == (1 << 30) + 5 and scalar.disk_warning(0, 2 << 30) is None


def test_dates_and_elapsed(spark):
    assert scalar.date_bounds("2024-01-02", "2024-01-02") == (1704153600, 1704153600 + 86399)
    assert scalar.date_bounds(None, "") == (0, 0)
    got = rows(spark, [(0, "/a"), (999, "a"), (1500, "/a/b"), (61000, "x/y"), (3660000, "/")], "ms bigint, p string", e=scalar.format_elapsed("ms"), d=scalar.dirname("p"), t=scalar.format_date("ms"))
    assert [r.e for r in got] == ["0 ms", "999 ms", "2 s", "1 min 1 s", "1 h 1 min"]
    assert [r.d for r in got] == ["/", "", "/a", "x", "/"] and got[0].t == "-" and got[4].t == "12 Feb 1970"
    assert rows(spark, [("A.PNG",), ("a.tiff",)], "n string", b=scalar.browser_native("n"))[0].b
