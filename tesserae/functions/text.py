"""Names, keys, label texts and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: str | Column) -> Column:
    return F.substring_index(_as_col(path), "/", -1)


def stem(path: str | Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parent_name(path: str | Column) -> Column:
    """Name of the folder that holds the file."""
    return F.element_at(F.split(F.concat(F.lit("/"), _as_col(path)), "/"), -2)


def zero_padded(n: str | Column, width: int) -> Column:
    """Decimal text of ``n`` with leading zeros; longer numbers are kept whole."""
    text = _as_col(n).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def label_from_name(name: str | Column) -> Column:
    """Label text in a member name: the first nine characters after the last underscore."""
    return F.substring(F.element_at(F.split(_as_col(name), "_"), -1), 1, 9)


def is_jpeg(name: str | Column) -> Column:
    low = F.lower(_as_col(name))
    return low.endswith(".jpg") | low.endswith(".jpeg")


def key_and_extension(member: str | Column) -> tuple[Column, Column]:
    """Split a member name at the first dot of its base name."""
    m = _as_col(member)
    return (
        F.regexp_extract(m, r"^((?:.*/)?[^/.]+)\.", 1),
        F.regexp_extract(m, r"^(?:.*/)?[^/.]+\.([^/]*)$", 1),
    )


# Fixed value: layout of a training log line.
LOG_LINE = (
    r"^\[(\d\d/\d\d \d\d:\d\d:\d\d) ([^\]]+)\]: Data \(t\): ([0-9.]+), ([0-9.]+)/s/gpu "
    r"Batch \(t\): ([0-9.]+) LR: ([0-9.]+) Step: (\d+)"
)
# Fixed value: layout of a check log file name.
CHECK_LOG_NAME = r"check_files_(\d+)_(\d+)\.out$"


def metric(line: str | Column, name: str) -> Column:
    """Value of ``name: number`` in a log line, NULL when absent."""
    text = F.regexp_extract(_as_col(line), rf"(?:^|[ \]]){name}: (-?[0-9.]+)", 1)
    return F.when(text != "", text.cast("double"))
