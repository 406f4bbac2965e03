"""Text to number, boolean, list and time: unparsable input becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Texts that stand for true and false, and those that stand for "no tag".
TRUE_TEXTS, FALSE_TEXTS = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")
NO_TAG = ("", "0", "nan", "None")
#: Fixed value: the EXIF date layout.
EXIF_FORMAT = "yyyy:MM:dd HH:mm:ss"


def non_empty(x: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def number(x: Column) -> Column:
    """A finite double, else null."""
    value = x.cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def positive(x: Column) -> Column:
    """A finite double above zero, else null."""
    return F.when(number(x) > 0, number(x))


def first_positive(*xs: Column) -> Column:
    return F.coalesce(*[positive(x) for x in xs])


def truth(x: Column, default: bool | None = None) -> Column:
    """True or false for the known texts, else the default."""
    text = F.lower(F.trim(x.cast("string")))
    return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False).otherwise(F.lit(default).cast("boolean"))


def sidecar_list(x: Column) -> Column:
    """A JSON array of texts; empty for null, "" and "0"; any other text is a list of itself."""
    text = non_empty(x)
    parsed = F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<string>")
    whole = F.when(text.isNull() | (text == "0"), F.array().cast("array<string>")).otherwise(F.array(text))
    return F.filter(F.coalesce(parsed, whole), lambda s: s.isNotNull() & (F.trim(s) != ""))


def exif_seconds(x: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.trim(x.cast("string")), F.lit(EXIF_FORMAT))).cast("double")


def capture_seconds(exif: Column, json: Column, fs: Column) -> Column:
    """EXIF date, then the sidecar's seconds, then the file's, then 0."""
    return F.coalesce(exif_seconds(exif), number(json), number(fs), F.lit(0.0))


def chosen_time(json: Column, fs: Column) -> tuple[Column, Column]:
    """Positive seconds from the sidecar, else from the file, and which of them they are."""
    a, b = positive(json), positive(fs)
    return F.coalesce(a, b), F.when(a.isNotNull(), "json").when(b.isNotNull(), "fs").otherwise("missing")


def first_time(json: Column, fs: Column) -> Column:
    """Seconds from the sidecar, else from the file, whatever their sign."""
    return F.coalesce(number(json), number(fs))


def json_datetime(json: Column) -> Column:
    """The first of the three timestamps of a sidecar document; bad JSON gives null."""
    fields = ("photoTakenTime", "creationTime", "modificationTime")
    return F.coalesce(*[non_empty(F.get_json_object(json, f"$.{f}.timestamp")) for f in fields])


def ratio(x: Column) -> Column:
    """ "a/b" or a plain number as a double; zero and malformed give null."""
    parts = F.split(F.trim(x), "/")
    value = F.when(F.size(parts) == 2, F.try_divide(number(parts[0]), number(F.get(parts, F.lit(1))))).when(F.size(parts) == 1, number(x))
    return F.when(value != 0, value)


def fourcc(code: Column) -> Column:
    """A little-endian four-character code as printable text, else null."""
    whole = code.cast("long")
    chars = [F.shiftright(whole, 8 * k).bitwiseAND(F.lit(255)) for k in range(4)]
    text = F.trim(F.concat(*[F.when((c >= 32) & (c < 127), F.char(c)).otherwise("") for c in chars]))
    return F.nullif(text, F.lit(""))


def tag_set(values: Column) -> Column:
    """Sorted different tags of an array, without the no-tag texts."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & ~v.isin(*NO_TAG))))


def seconds_text(x: Column) -> Column:
    """Seconds as h:mm:ss."""
    s = F.floor(x).cast("long")
    return F.format_string("%d:%02d:%02d", (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60)
