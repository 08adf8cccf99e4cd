"""Path expressions used by listings, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def swap_path(path: Column, old: str, new: str) -> Column:
    """Replace every occurrence of ``old``."""
    return F.replace(path, F.lit(old), F.lit(new))


def derived_path(path: Column, kind: str, ext: str) -> Column:
    """Where a product of a left image goes: other folder, other extension."""
    moved = swap_path(path, "/left/", f"/{kind}/")
    # an extension is dropped only when the name has a character other than a dot before it
    stem = F.regexp_replace(moved, r"^((?:.*/)?\.*[^./][^/]*)\.[^./]*$", "$1")
    return F.concat(stem, F.lit(f".{ext}"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


def dirname(path: Column) -> Column:
    """All but the last ``/`` part; empty when there is no ``/``."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def join_path(root: str, relative: Column) -> Column:
    """Prefix ``root``; an absolute second part replaces it."""
    if root == "":
        return relative
    glue = root if root.endswith("/") else root + "/"
    return F.when(relative.startswith("/"), relative).otherwise(F.concat(F.lit(glue), relative))


def status_prefix(status: Column) -> Column:
    """Text before the first colon: ``FAILED: out of memory`` counts as ``FAILED``."""
    return F.substring_index(status, ":", 1)


def local_path(uri: Column) -> Column:
    """Turn the ``file:`` URI of a file source into the plain path listings use."""
    return F.regexp_replace(uri, r"^file:/+", "/")
