"""Scan parameters and tuning knobs, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

# The extensions of each kind of media.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tiff", "tif", "avif")
VIDEO_EXTENSIONS = ("mp4", "avi", "mkv", "mov", "wmv", "webm", "flv", "m4v", "mpg", "mpeg", "3gp", "ts", "mts", "m2ts")
AUDIO_EXTENSIONS = ("mp3", "flac", "ogg", "m4a", "aac", "wav", "wma", "opus", "aiff", "aif", "ape")
BROWSER_IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "jfif", "pjpeg", "pjp", "webp", "avif", "bmp", "svg", "ico")


class _Stored:
    """Loading and saving as JSON: absent or invalid files and fields give the defaults."""

    @classmethod
    def load(cls, path: str | Path):
        try:
            found = json.loads(Path(path).read_text())
            return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})
        except (OSError, ValueError, TypeError, AttributeError):
            return cls()

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2))


# The names and defaults of stored settings.
@dataclass(frozen=True)
class ImageConfig(_Stored):
    min_file_size_bytes: int = 10240
    min_images_size_filter: int = 50
    aspect_ratio_tolerance: float = 0.20
    min_images_aspect_filter: int = 10
    two_pass_enabled: bool = True
    coarse_hash_size: int = 4
    fine_hash_size: int = 8
    coarse_threshold_multiplier: float = 2.0
    min_images_two_pass: int = 20
    cache_enabled: bool = True
    use_exif_thumbnail: bool = True
    use_bucket_index: bool = True
    use_sorted_aspect: bool = True


@dataclass(frozen=True)
class ScanParams(_Stored):
    folder: str = ""
    recursive: bool = False
    excluded: tuple[str, ...] = ()
    by_folder: bool = False
    find_similar: bool = False
    sim_threshold: int = 10
    find_similar_videos: bool = False
    video_sim_threshold: int = 10
    video_frames: int = 8
    video_duration_tolerance: float = 0.20
    video_cache_enabled: bool = True
    video_use_dtw: bool = False
    exact_cache_enabled: bool = True
    exclude_extensions: tuple[str, ...] = ()
    include_extensions: tuple[str, ...] = ()
    min_file_size_kb: int = 0
    max_file_size_kb: int = 0
    find_similar_audio: bool = False
    audio_sim_threshold: int = 20
    audio_cache_enabled: bool = True
    audio_duration_tolerance: float = 0.20
    ignored_keys: tuple[str, ...] = ()
    secondary_folder: str | None = None
    min_modified_timestamp: int = 0
    max_modified_timestamp: int = 0
    scan_archives: bool = False
    image: ImageConfig = field(default_factory=ImageConfig)

    def single_mode(self) -> str | None:
        """The one kind of media that all phases are restricted to, if exactly one similarity search is on."""
        on = [k for k, v in (("image", self.find_similar), ("video", self.find_similar_videos), ("audio", self.find_similar_audio)) if v]
        return on[0] if len(on) == 1 else None
