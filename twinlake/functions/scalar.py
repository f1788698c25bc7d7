"""Scalar and array functions over columns (X1-X10, X18-X33), and the driver-side rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlake.params import AUDIO_EXTENSIONS, BROWSER_IMAGE_EXTENSIONS, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS

MASK32 = 0xFFFFFFFF


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- hashes


def partial_hash(content: Column | str, size: int = 4096) -> Column:
    """Digest of the first bytes."""
    return F.md5(F.substring(col(content), 1, size))


def full_hash(content: Column | str) -> Column:
    """Digest of the whole content."""
    return F.md5(col(content))


def hash_label(digest: Column | str) -> Column:
    """The first 16 characters."""
    return F.substring(col(digest), 1, 16)


# --- distances


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit words."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hamming_words(a: Column | str, b: Column | str) -> Column:
    """Differing bits over the common length of two arrays of 64-bit words (X4 for longer hashes)."""
    return _bits(_paired(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))))


def _paired(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def _bits(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda s, v: s + v)


def sequence_distance(a: Column | str, b: Column | str) -> Column:
    """Mean Hamming distance over the shorter length; 64 if either is empty."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, hamming_words(a, b) / n).otherwise(F.lit(64.0))


def fingerprint_distance(a: Column | str, b: Column | str) -> Column:
    """Share of differing bits of 32-bit words over the shorter length; 1 if either is empty."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    bits = _bits(_paired(a, b, lambda x, y: F.bit_count(x.cast("bigint").bitwiseXOR(y.cast("bigint")).bitwiseAND(F.lit(MASK32)))))
    return F.when(n > 0, bits / (n * F.lit(32.0))).otherwise(F.lit(1.0))


# --- thresholds


def coarse_threshold(threshold: int, coarse: int, fine: int, multiplier: float) -> int:
    """The coarse hash's share of the fine threshold, in 32-bit floats."""
    f = np.float32
    return int(np.floor(f(threshold) * (f(coarse * coarse) / f(fine * fine)) * f(multiplier)))


def percent_to_bits(percent):
    """Similarity in percent, a number or a column, as a distance in bits of 64, halves rounded up."""
    bits = (1 - percent / 100) * 64 + 0.5
    return F.floor(bits).cast("int") if isinstance(percent, Column) else math.floor(bits)


def audio_percent(percent):
    """Similarity in percent as a distance in percent."""
    return 100 - percent


def within_tolerance(a: Column | str, b: Column | str, tolerance: float) -> Column:
    """|a - b| / max(a, b) within the tolerance; true where the larger isn't positive (the filter doesn't apply)."""
    a, b = col(a), col(b)
    most = F.greatest(a, b)
    return (most <= 0) | (F.abs(a - b) / F.when(most > 0, most) <= tolerance)


def aspects_match(a: Column | str, b: Column | str, tolerance: float) -> Column:
    """As within_tolerance; unknown aspects match everything."""
    return F.coalesce(within_tolerance(a, b, tolerance), F.lit(True))


def similarity_score(distance: Column | str, bits: int) -> Column:
    """(1 - d / bits) * 100."""
    return (1 - col(distance) / F.lit(float(bits))) * 100


def aspect(width: Column | str, height: Column | str) -> Column:
    """Width by height; 1 for no height."""
    return F.when(col(height) == 0, F.lit(1.0)).otherwise(col(width) / col(height)).cast("float")


# --- names


def extension(name: Column | str) -> Column:
    """Lower-cased extension, '' without one (X26). A leading dot alone makes no extension."""
    return F.lower(F.regexp_extract(col(name), r"[^/]\.([^./]*)$", 1))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """What stands before the last slash; '/' at the root, '' without a slash."""
    p = col(path)
    return F.when(~F.contains(p, F.lit("/")), "").otherwise(F.coalesce(F.nullif(F.regexp_replace(p, r"/[^/]*$", ""), F.lit("")), F.lit("/")))


def media_class(name: Column | str) -> Column:
    """image, video, audio or other, by extension."""
    e = extension(name)
    return F.when(e.isin(*IMAGE_EXTENSIONS), "image").when(e.isin(*VIDEO_EXTENSIONS), "video").when(e.isin(*AUDIO_EXTENSIONS), "audio").otherwise("other")


def first_level_folder(path: Column | str, root: str) -> Column:
    """First component below the root; '' for direct children and for paths elsewhere."""
    base = root.rstrip("/") + "/"
    parts = F.split(F.substring(col(path), F.lit(len(base) + 1), F.length(col(path))), "/")
    return F.when(F.startswith(col(path), F.lit(base)) & (F.size(parts) > 1), parts[0]).otherwise("")


# --- formatting


def format_size(size: Column | str, style: str = "export") -> Column:
    """Bytes for reading (X24): the export's units, the notification's, or the screen's."""
    s = col(size)
    giga, mega, kilo = 1 << 30, 1 << 20, 1 << 10
    if style == "export":
        steps = ((giga, "%.2f Go"), (mega, "%.1f Mo"), (kilo, "%.1f Ko"))
        rest = F.format_string("%d o", s)
    elif style == "notification":
        steps = ((giga, "%.1f GB"), (mega, "%.1f MB"), (kilo, "%.0f KB"))
        rest = F.format_string("%d B", s)
    elif style == "screen":
        steps = ((giga, "%.2f Go"), (mega, "%.1f Mo"), (kilo, "%.1f Ko"))
        rest = F.format_string("%d o", s)
    else:
        raise ValueError(f"unknown style {style}")
    out = rest
    for unit, form in reversed(steps):
        # halves go to the even digit, but on the screen up, as in the formats that this stands for
        value = s / F.lit(float(unit))
        out = F.when(s >= unit, F.format_string(form, value if style == "screen" else F.bround(value, int(form[2])))).otherwise(out)
    return out


def csv_field(c: Column | str) -> Column:
    """Quoted only where it holds a comma, a quote or a line end."""
    c = col(c)
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def html_field(c: Column | str) -> Column:
    c = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def format_duration(seconds: Column | str) -> Column:
    """h:mm:ss, or m:ss below an hour, of rounded seconds."""
    s = F.floor(col(seconds) + 0.5).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def format_elapsed(ms: Column | str, names: tuple[str, str, str, str] = ("ms", "s", "min", "h")) -> Column:
    """Milliseconds in one or two units: ms, s, min s, h min."""
    v = col(ms)
    s = F.floor(v / 1000 + 0.5).cast("bigint")
    m = F.floor(s / 60).cast("bigint")
    h = F.floor(m / 60).cast("bigint")

    def two(large: Column, name: str, rest: Column, small: str) -> Column:
        return F.when(rest > 0, F.format_string(f"%d {name} %d {small}", large, rest)).otherwise(F.format_string(f"%d {name}", large))

    return (
        F.when(v < 1000, F.format_string(f"%d {names[0]}", v))
        .when(s < 60, F.format_string(f"%d {names[1]}", s))
        .when(m < 60, two(m, names[2], s % 60, names[1]))
        .otherwise(two(h, names[3], m % 60, names[2]))
    )


def format_date(unix: Column | str) -> Column:
    """Day, month, year; '-' without a date."""
    u = col(unix)
    return F.when(u.isNull() | (u == 0), "-").otherwise(F.date_format(F.timestamp_seconds(u), "dd MMM yyyy"))


def ignore_key(paths: Column | str) -> Column:
    """Canonical key of a group: sorted paths joined by |."""
    return F.array_join(F.array_sort(col(paths)), "|")


# --- parsers of external tools' output


def parse_probe(json: Column | str) -> Column:
    """(duration, width, height, codec, tracks, default_track) of the JSON of a media probe."""
    schema = (
        "format struct<duration:string>, streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,"
        "channels:int,channel_layout:string,disposition:struct<default:int>,tags:struct<language:string,title:string>>>"
    )
    p = F.from_json(col(json), schema)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    tracks = F.filter(p["streams"], lambda s: s["codec_type"] == "audio")
    first = F.coalesce(F.get(F.filter(tracks, lambda s: s["disposition"]["default"] == 1), F.lit(0)), F.get(tracks, F.lit(0)))
    return F.when(
        p.isNotNull(),
        F.struct(
            F.coalesce(p["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration"),
            F.coalesce(video["width"], F.lit(0)).alias("width"),
            F.coalesce(video["height"], F.lit(0)).alias("height"),
            F.coalesce(video["codec_name"], F.lit("")).alias("codec"),
            F.coalesce(F.size(tracks), F.lit(0)).alias("n_tracks"),
            first["codec_name"].alias("audio_codec"),
            first["tags"]["language"].alias("audio_language"),
        ),
    )


def parse_fingerprint(text: Column | str) -> Column:
    """(duration, words) of a fingerprint tool's output; null without words."""
    t = col(text)
    words = F.filter(F.transform(F.split(F.regexp_extract(t, r"(?m)^FINGERPRINT=(.*)$", 1), ","), lambda w: F.trim(w).try_cast("int")), lambda w: w.isNotNull())
    duration = F.coalesce(F.regexp_extract(t, r"(?m)^DURATION=(.*)$", 1).try_cast("double"), F.lit(0.0))
    return F.when(F.size(words) > 0, F.struct(duration.alias("duration"), words.alias("words")))


# Containers that a browser plays, those that can be rewrapped for it, and the codecs that it knows.
DIRECT_EXTENSIONS = ("mp4", "m4v", "webm", "ogg", "ogv", "oga")
REMUX_EXTENSIONS = ("flv", "mkv", "ts", "m2ts", "mts", "mov", "3gp", "3g2", "avi", "wmv", "asf", "f4v")
REMUX_CODECS = ("h264", "hevc", "h265", "vp8", "vp9", "av1")


def playback(ext: Column | str, codec: Column | str) -> Column:
    """direct, remux or unsupported."""
    e, c = F.lower(col(ext)), col(codec)
    direct, remux = e.isin(*DIRECT_EXTENSIONS), e.isin(*REMUX_EXTENSIONS) & c.isin(*REMUX_CODECS)
    return F.when(F.coalesce(direct, F.lit(False)), "direct").when(F.coalesce(remux, F.lit(False)), "remux").otherwise("unsupported")


def browser_native(name: Column | str) -> Column:
    """Pictures that a browser shows as they are; GIFs are decided by their content."""
    return extension(name).isin(*BROWSER_IMAGE_EXTENSIONS)


def date_bounds(first: str | None, last: str | None, offset_minutes: int = 0) -> tuple[int, int]:
    """Least and greatest modification time of dates: midnight UTC of the first, the local end of the last; 0 is none."""
    from datetime import UTC, datetime, timedelta, timezone

    low = int(datetime.fromisoformat(first).replace(tzinfo=UTC).timestamp()) if first else 0
    zone = timezone(timedelta(minutes=offset_minutes))
    high = int(datetime.fromisoformat(last).replace(hour=23, minute=59, second=59, tzinfo=zone).timestamp()) if last else 0
    return low, high


def is_animated_gif(name: Column | str, content: Column | str) -> Column:
    """A GIF by its name and its first bytes: it may be shown as it is."""
    return (extension(name) == "gif") & F.hex(F.substring(col(content), 1, 6)).isin(b"GIF87a".hex().upper(), b"GIF89a".hex().upper())


# --- driver rules


def should_notify(duration_ms: int, threshold_secs: int) -> bool:
    return duration_ms >= threshold_secs * 1000


def _readable(size: int) -> str:
    for unit, digits, name in ((1 << 30, 1, "GB"), (1 << 20, 1, "MB"), (1 << 10, 0, "KB")):
        if size >= unit:
            return f"{size / unit:.{digits}f} {name}"
    return f"{size} B"


def notification_body(groups: int, wasted: int, language: str = "en") -> str:
    """Text for the end of a scan."""
    # fixed values: the sentences that are shown, by language
    none, one, many, end = {"fr": ("Aucun doublon trouve.", "groupe trouve", "groupes trouves", "recuperables")}.get(language, ("No duplicates found.", "group found", "groups found", "recoverable"))
    return none if not groups else f"{groups} {one if groups == 1 else many} - {_readable(wasted)} {end}"


def disk_deficit(needed: Column | str, available: Column | str, margin: int = 1 << 30) -> Column:
    """As disk_warning, of columns."""
    short = col(needed) + F.lit(margin) - col(available)
    return F.when(short > 0, short)


def disk_warning(needed: int, available: int, margin: int = 1 << 30) -> int | None:
    """The deficit if less than needed plus a margin is free, else None."""
    return max(0, needed + margin - available) if available < needed + margin else None


def saturating_kb(kb: int) -> int:
    """kB to bytes, at most 2^64 - 1 (F2)."""
    return min(kb * 1024, 2**64 - 1)
