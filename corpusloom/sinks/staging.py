"""Output that is either published whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame

from corpusloom.sources.files import open_folder, refuse_filled, remove_folder

Writer = Callable[[DataFrame, str], None]


def _parquet(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)


def publish(rows: DataFrame, path: str, write: Writer = _parquet, overwrite: bool = False) -> None:
    """Write ``rows`` beside ``path`` and give the result that name once it is whole.

    A target that is not empty is refused with ``FileExistsError`` before any job
    runs, and again by the renaming, for a target that was filled meanwhile. A write
    that fails leaves the target as it was. With ``overwrite`` the old result stays
    readable until the new one is whole, and comes back should the renaming fail.
    """
    if not overwrite:
        refuse_filled(path)
    run = uuid.uuid4().hex
    path = path.rstrip("/")
    parent, _, name = path.rpartition("/")
    staged, old = (f"{parent}/_{name}.{kind}-{run}" for kind in ("staged", "old"))
    try:
        write(rows, staged)
        if overwrite:
            _move(path, old)
        else:
            refuse_filled(path)
        try:
            _move(staged, path)
        except BaseException:
            _move(old, path)
            raise
    finally:
        remove_folder(staged)
    remove_folder(old)


def _move(source: str, target: str) -> None:
    """Rename a folder; nothing happens where there is none."""
    system, path = open_folder(source)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.move(path, open_folder(target)[1])
