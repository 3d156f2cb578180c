"""Project keys, paths and display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path parts that carry no project name.
HOME_PARTS = ("users", "home", "mnt")
WORK_PARTS = ("wrk", "src", "work", "dev", "code", "projects", "repos")
HOST_PARTS = ("github", "gitlab", "bitbucket")
HOST_SUFFIXES = ("com", "org", "io")
MAX_NAME_PARTS = 4


def decode_path(key: Column) -> Column:
    """``-a-b`` to ``/a/b``. Lossy: a real dash becomes a slash too."""
    slashed = F.replace(key, F.lit("-"), F.lit("/"))
    return F.when((key == "") | slashed.startswith("/"), slashed).otherwise(F.concat(F.lit("/"), slashed))


def encode_path(path: Column) -> Column:
    """``/a/b`` to ``a-b``: slashes become dashes, one leading dash is dropped."""
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit("-")), "^-", "")


def display_name(key: Column) -> Column:
    """Readable project name: the last parts of the key after home, work and host prefixes."""
    everything = F.filter(F.split(key, "-"), lambda p: p != "")
    size = F.size(everything)

    def folded(parts: Column, i: int) -> Column:
        return F.lower(F.get(parts, F.lit(i)))

    skip_home = F.when((size > 1) & folded(everything, 0).isin(*HOME_PARTS), F.lit(2)).otherwise(F.lit(0))
    after_home = F.slice(everything, skip_home + 1, size)
    first_kept = F.array_position(F.transform(after_home, lambda p: F.lower(p).isin(*WORK_PARTS)), F.lit(False))
    after_work = F.when(first_kept > 0, F.slice(after_home, first_kept.cast("int"), size)).otherwise(F.slice(everything, 1, 0))
    on_host = (
        (F.size(after_work) > 1)
        & folded(after_work, 0).isin(*HOST_PARTS)
        & folded(after_work, 1).isin(*HOST_SUFFIXES)
    )
    rest = F.when(on_host, F.slice(after_work, 3, size)).otherwise(after_work)
    shown = F.slice(rest, F.greatest(F.size(rest) - MAX_NAME_PARTS + 1, F.lit(1)), MAX_NAME_PARTS)
    return (
        F.when(size == 0, key)
        .when(F.size(rest) == 0, F.element_at(everything, -1))
        .otherwise(F.array_join(shown, "-"))
    )


def under_root(path: Column, root: str) -> Column:
    """True for the root itself and for paths below it, not for name prefixes."""
    root = root.rstrip("/")
    return (path == (root or "/")) | path.startswith(root + "/")
