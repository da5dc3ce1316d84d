"""Which files are RAW images, and where their derivatives go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of RAW formats.
RAW_SUFFIXES = (".3fr", ".arw", ".cr2", ".cr3", ".dng", ".erf", ".fff", ".iiq", ".kdc", ".mef", ".mos", ".mrw", ".nef", ".nrw", ".orf", ".pef", ".raf", ".raw", ".rw2", ".rwl", ".srw", ".x3f")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """With its dot; empty for a name without one or that only begins with one."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]+)?$", 1)


def is_raw(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*RAW_SUFFIXES)


def discover(files: DataFrame, limit: int = 200) -> DataFrame:
    """The first `limit` RAW files by lower-cased name. The limit is the feature; it and the filter come before any look into a file."""
    return files.where(is_raw(F.col("path"))).orderBy(F.lower(file_name(F.col("path"))), "path").limit(limit)


def artifacts(path: Column, out: str, export: str = "jpeg") -> list[Column]:
    """preview, export, recipe and intermediate paths."""
    end = {"jpeg": ".jpg", "jpg": ".jpg", "png": ".png", "tiff": ".tif", "tif": ".tif"}[export.lower()]
    return [
        F.concat(F.lit(f"{out}/previews/"), stem(path), F.lit(".preview.png")).alias("preview_path"), F.concat(F.lit(f"{out}/exports/"), stem(path), F.lit(f".auto{end}")).alias("export_path"),
        F.concat(F.lit(f"{out}/recipes/"), file_name(path), F.lit(".recipe.json")).alias("recipe_path"), F.concat(F.lit(f"{out}/intermediates/"), stem(path), F.lit(".base.tif")).alias("intermediate_path"),
    ]
