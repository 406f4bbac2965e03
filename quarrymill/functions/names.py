"""Parts of paths and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: File suffixes of each role.
PHOTO = ("jpg", "jpeg", "png", "heic", "webp", "bmp", "tif", "tiff")
VIDEO = ("mp4", "mov", "avi", "mkv", "3gp", "m4v", "webm", "mts", "m2ts", "wmv")
ARCHIVE = ("zip", "rar", "7z", "tar", "gz", "bz2", "xz")
UNPACKED = ("zip", "tar", "gz", "bz2", "xz")
SIDECAR = ("json",)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last extension in lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def normal_stem(name: Column) -> Column:
    """Trimmed, lower-cased stem; null for null."""
    return F.lower(F.regexp_replace(F.trim(name), r"(?<=[^.])\.[^.]*$", ""))


def album(path: Column, root: str = "") -> Column:
    """The folder of a path relative to ``root``."""
    folder = F.regexp_replace(path, r"[\\/]?[^\\/]*$", "")
    inside = F.when(F.startswith(folder, F.lit(root)), F.substring(folder, len(root) + 1, 1 << 30)).otherwise(folder)
    return F.regexp_replace(inside, r"^[\\/]+", "")


def album_key(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def last_number(name: Column) -> Column:
    """The last run of digits as a long; null without digits or beyond a long."""
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).try_cast("long")


def numeric_token(name: Column) -> Column:
    """The first run of at least three digits as a long."""
    return F.nullif(F.regexp_extract(name, r"(\d{3,})", 1), F.lit("")).try_cast("long")


def file_role(path: Column) -> Column:
    """media/photo, media/video, sidecar, archive or other, by suffix."""
    s = suffix(path)
    return F.when(s.isin(*PHOTO), "media/photo").when(s.isin(*VIDEO), "media/video").when(s.isin(*SIDECAR), "sidecar").when(s.isin(*ARCHIVE), "archive").otherwise("other")


def asset_id(path: Column) -> Column:
    """Stable id of a place: SHA-1 of the lower-cased path."""
    return F.sha1(F.lower(path).cast("binary"))


def aspect(width: Column, height: Column) -> Column:
    return F.try_divide(width.cast("double"), F.nullif(height.cast("double"), F.lit(0.0)))


#: What names of screen shots contain.
SCREEN_NAMES = ("screenshot", "screen", "img_")


def content_type(path: Column, width: Column, height: Column, face: Column) -> Column:
    """Ordered rules over suffix, shape, face coverage (null: none) and name; null without a known size."""
    f, png = F.coalesce(face, F.lit(0.0)), suffix(path) == "png"
    tall = (width > 0) & (height > 0) & (F.try_divide(height.cast("double"), width.cast("double")) >= 1.8)
    shot = F.lower(file_name(path)).rlike("|".join(SCREEN_NAMES))
    kind = F.when((png | F.coalesce(tall, F.lit(False))) & (f < 0.005), "document").when(f >= 0.03, "people").when(shot & png & (f < 0.01), "document").otherwise("landscape")
    return F.when(width.isNotNull() & height.isNotNull(), kind)


def target_path(root: str, album_path: Column, name: Column) -> Column:
    """root/album/name with forward slashes; an empty album is left out."""
    folder = F.nullif(F.regexp_replace(F.coalesce(album_path, F.lit("")), r"\\", "/"), F.lit(""))
    return F.concat_ws("/", F.lit(root), folder, name)


#: Content labels and their canonical names.
LABELS = {"people": "people", "landscape": "landscapes", "landscapes": "landscapes", "document": "documents", "documents": "documents", "video": "video"}


def content_label(x: Column) -> Column:
    """The label's canonical name; null for unknown labels."""
    known = F.create_map(*[F.lit(v) for pair in LABELS.items() for v in pair])
    return F.try_element_at(known, F.lower(F.trim(x)))


def content_labels(x: Column) -> Column:
    """The canonical names in a comma-joined list of labels, in its order; unknown ones go."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), content_label), lambda t: t.isNotNull())


#: What a client shows for a canonical label.
SHOWN_LABELS = {"people": "People", "landscapes": "Landscapes", "documents": "Documents", "video": "Video"}


def shown_labels(x: Column, words: dict[str, str] = SHOWN_LABELS) -> Column:
    """The display text of a comma-joined list of labels; ``words`` translates them."""
    known = F.create_map(*[F.lit(v) for pair in words.items() for v in pair])
    return F.array_join(F.transform(content_labels(x), lambda t: F.try_element_at(known, t)), ", ")


#: Formats of metrics with a unit.
FORMATS = {"duration_sec_final": "%.2f s", "fps_final": "%.2f fps", "bitrate_kbps_final": "%.1f kbps", "live_photo_penalty": "%.2f"}


def metric_text(name: str, x: Column) -> Column:
    """A metric's display text: with its unit, labels and yes or no in words, else as it is; null for null."""
    value = x.cast("double")
    if name == "file_size":
        text = F.when(value < 1 << 10, F.format_string("%d B", value.cast("long"))).when(value < 1 << 20, F.format_string("%.1f KB", value / 1024.0)).otherwise(F.format_string("%.2f MB", value / float(1 << 20)))
    elif name == "pixels":
        text = F.concat(F.format_number(value.cast("long"), 0), F.lit(" px"))
    elif name in FORMATS:
        text = F.format_string(FORMATS[name], value)
    elif name in ("content_type_file", "content_type_group", "content_type_scene"):
        text = shown_labels(x)
    elif name in ("audio_present_final", "has_live_photo_pair"):
        text = F.when(x.cast("boolean"), "Yes").otherwise("No")
    else:
        text = x.cast("string")
    return F.when(x.isNotNull(), text)


def size_text(width: Column, height: Column) -> Column:
    """Width and height as one metric; null if either is."""
    return F.when(width.isNotNull() & height.isNotNull(), F.format_string("%d × %d px", width.cast("long"), height.cast("long")))
