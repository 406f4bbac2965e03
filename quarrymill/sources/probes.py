"""Technical metrics of videos: backends in order of preference, errors kept, results cached."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.functions import media
from quarrymill.sources import archives
from quarrymill.sources.boxes import header_document
from quarrymill.sources.cache import with_cache
from quarrymill.sources.files import cache_key

#: What a cache of metrics holds.
CACHED = "cache_key string, document string, video_metrics_backend string, video_metrics_error string"
Backend = tuple[str, Callable[[str], str | None]]


def program_backend(program: str) -> Backend:
    """The probe program; a file that it can't read is an error."""

    def probe(path: str) -> str:
        found = archives.probe(program, path)
        if found is None:
            raise ValueError("the probe program failed")
        return found

    return "ffprobe", probe


def default_backends() -> list[Backend]:
    """The probe program if there is one, then the header reader."""
    program = archives.find_probe()
    return [program_backend(program)] * bool(program) + [("header", header_document)]


def documents(rows: DataFrame, backends: list[Backend]) -> DataFrame:
    """(cache_key, document, backend, error) of rows (cache_key, file_path): the first backend that answers.

    If none does, the document is null, the backend the preferred one, and the
    error that of the preferred one.  Workers read the files by their paths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(1).to_pylist():
                errors, found = [], None
                for name, probe in backends:
                    try:
                        found = (probe(path), name, None)
                        break
                    except Exception as error:  # noqa: BLE001  one bad file must not end the task
                        errors.append(str(error) or type(error).__name__)
                out.append(found or (None, backends[0][0], errors[0]))
            columns = zip(*out) if out else ((), (), ())
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), pa.string()) for c in columns)], names=["cache_key", "document", "video_metrics_backend", "video_metrics_error"])

    return rows.select("cache_key", "file_path").mapInArrow(run, CACHED)


def video_metrics(videos: DataFrame, cache: str, backends: list[Backend] | None = None) -> DataFrame:
    """(asset_id, file_path, metrics..., status, backend, error) of a video index (asset_id, file_path, file_size, created_at_fs).

    A file that is in the cache with its path, size, time and preferred backend
    isn't read again.  Its own width and height stand where a probe has none.
    """
    use = backends or default_backends()
    keyed = videos.withColumn("cache_key", cache_key(F.col("file_path"), F.col("file_size"), F.col("created_at_fs"), use[0][0]))
    found = with_cache(keyed, cache, CACHED, lambda new: documents(new, use))
    metrics = media.probe_metrics(F.col("document"))
    for side in ("width", "height"):
        if side in videos.columns:
            metrics[side] = F.coalesce(metrics[side], F.col(side).try_cast("int"))
    return found.select("asset_id", "file_path", *[c.alias(n) for n, c in metrics.items()], "video_metrics_backend", "video_metrics_error")
