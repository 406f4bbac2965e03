"""Unpacking archives before a scan, under an explicit policy."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable
from pathlib import Path

#: Fixed value: the exit code of a stop that the policy asked for.
STOP = 40
POLICIES = ("continue", "stop", "unpack", "interactive")


def unpack(paths: list[str], staging: str) -> tuple[list[str], list[str]]:
    """Unpacks what the standard library can into an emptied staging folder: (done, skipped)."""
    shutil.rmtree(staging, ignore_errors=True)
    done, skipped = [], []
    for n, path in enumerate(sorted(paths)):
        target = Path(staging, f"{n:05d}-{Path(path).stem}")
        try:
            target.mkdir(parents=True)
            options = {} if path.endswith(".zip") else {"filter": "data"}
            shutil.unpack_archive(path, target, **options)
            done.append(path)
        except (shutil.ReadError, ValueError, OSError):
            shutil.rmtree(target, ignore_errors=True)
            skipped.append(path)
    return done, skipped


def preflight(paths: list[str], policy: str, staging: str, ask: Callable[[list[str]], str] | None = None, listing: str | None = None) -> int:
    """0 to go on, STOP to end cleanly; archives are unpacked only if the policy says so.

    The "interactive" policy asks ``ask`` for one of the others.  With
    ``listing`` the archives' paths are saved there before a stop.
    """
    if policy == "interactive":
        if ask is None:
            raise ValueError("the interactive policy needs someone to ask")
        policy = ask(paths) if paths else "continue"
    if policy not in POLICIES[:3]:
        raise ValueError(f"policy must be one of {POLICIES}")
    if paths and policy == "stop":
        if listing:
            Path(listing).write_text("".join(f"{p}\n" for p in sorted(paths)), encoding="utf-8")
        return STOP
    if paths and policy == "unpack":
        unpack(paths, staging)
    return 0


def find_probe() -> str | None:
    """The probe program: from the environment, else from the path."""
    named = os.environ.get("FFPROBE")
    return named if named and os.path.exists(named) else shutil.which("ffprobe")


def probe(program: str, path: str, timeout: float = 60) -> str | None:
    """The probe document of a video, or null if the program fails."""
    command = [program, "-v", "error", "-print_format", "json", "-show_streams", "-show_format", path]
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
