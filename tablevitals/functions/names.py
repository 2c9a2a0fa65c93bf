"""Names: table columns, datasets, months in file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def standardize_name(name: str) -> str:
    """Trimmed, lower case, every run of other characters one underscore."""
    return re.sub(r"\W+", "_", name.strip().lower()).strip("_")


def standardize_names(names: list[str]) -> list[str]:
    """Standardized names; a name that occurs again gets ``_2``, ``_3``, …"""
    taken: set[str] = set()
    result = []
    for raw in names:
        base = standardize_name(raw)
        name, n = base, 1
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        result.append(name)
    return result


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def infer_month(name: Column) -> Column:
    """The first ``YYYY-MM`` in a file name, or null."""
    return F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2})", 1), F.lit(""))


def dataset_name(path: Column) -> Column:
    """File stem without a leading 8-hex-digit upload prefix; ``default`` if empty."""
    stem = F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(stem, r"^[0-9a-f]{8}_(?=.)", ""), F.lit("")), F.lit("default"))


def dataset_name_of(path: str) -> str:
    """``dataset_name`` for one path on the driver."""
    stem = re.sub(r"(?<=[^.])\.[^.]+$", "", path.rstrip("/").rsplit("/", 1)[-1])
    return re.sub(r"^[0-9a-f]{8}_(?=.)", "", stem) or "default"


def safe_dataset_key(name: Column) -> Column:
    """A name fit for a path: other characters than letters, digits, - and _ become _."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), F.lit("")), F.lit("default"))
