"""Column functions on metadata and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The schema of a recipe document, as far as it is read back.
RECIPE = "schema_version string, recipe_id string, source struct<path: string, checksum_sha256: string, immutable: boolean>, adjustments struct<raw: map<string, double>>, exports array<struct<format: string, quality: int>>"


def ascii_text(v: Column) -> Column:
    """Without white space at the ends, other scripts' characters as ?; null for blank."""
    t = F.regexp_replace(v, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when(t != "", F.regexp_replace(t, r"[^\x00-\x7F]", "?"))


def positive_int(v: Column) -> Column:
    n = v.try_cast("bigint")
    return F.when(n > 0, n)


def exif_time(v: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS of EXIF or ISO text; an offset is dropped, not applied; null for anything else."""
    t = F.trim(v)
    iso = F.regexp_replace(t, r"(Z|[+-]\d\d:\d\d)$", "")
    parsed = F.to_timestamp_ntz(F.when(iso.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d$"), F.regexp_replace(iso, "T", " ")))
    return F.when(t.rlike(r"^....:..:.{12}"), F.substring(t, 1, 19)).otherwise(F.date_format(parsed, "yyyy:MM:dd HH:mm:ss"))


def slider(v: Column, low: float, high: float) -> Column:
    """Text as a number in its range, to four decimals; 0 for what isn't one."""
    n = v.try_cast("double")
    n = F.when(F.isnan(n), None).otherwise(n)
    return F.rint(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(n, F.lit(0.0)))) * 1e4) / 1e4


def support(there: str, compression: str, bits: str, cfa: str, width: str, jpeg: str) -> list[Column]:
    """status, reason and issues of a file's header: a list of rules, of which the first that fails is the reason."""
    issues = F.array_compact(F.array(
        F.when(F.col(compression) != 1, F.concat(F.lit("compression "), F.col(compression), F.lit(" is not supported"))), F.when(~F.col(bits).isin(12, 14, 16), F.concat(F.col(bits).cast("string"), F.lit(" bits per sample"))),
        F.when(~F.col(cfa), "no Bayer pattern"), F.when(F.col(width) == 0, "empty image"),
    ))
    status = F.when(~F.col(there), "missing").when(F.size(issues) == 0, "supported").when(F.col(jpeg), "preview_only").when(F.col(compression) == 34713, "import_only").otherwise("unsupported")
    reason = F.when(~F.col(there), "Source file does not exist.").otherwise(F.coalesce(F.get(issues, 0), F.lit("ready")))
    return [status.alias("status"), reason.alias("reason"), F.when(F.col(there), F.size(issues)).otherwise(0).alias("issues")]


def merged(defaults: Column, overrides: Column) -> Column:
    """A map's union; the overrides win, and only the defaults' keys are allowed."""
    allowed = F.map_filter(overrides, lambda k, _: F.map_contains_key(defaults, k))
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(overrides, k))
    return F.map_concat(kept, allowed)


def recipe(path: Column, checksum: Column, defaults: Column, overrides: Column) -> Column:
    """A recipe document as JSON."""
    return F.to_json(F.struct(
        F.lit("recipe.v1").alias("schema_version"), checksum.alias("recipe_id"), F.struct(path.alias("path"), checksum.alias("checksum_sha256"), F.lit(True).alias("immutable")).alias("source"),
        F.struct(merged(defaults, overrides).alias("raw")).alias("adjustments"), F.array(F.struct(F.lit("jpeg").alias("format"), F.lit(92).alias("quality"))).alias("exports"),
    ))


def _tenth(v: Column) -> Column:
    """Ties to even before it is text, as formats differ in ties."""
    return F.rint(v * 10) / 10


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", _tenth(n / 1024))).otherwise(F.format_string("%.1f MB", _tenth(n / (1 << 20))))


def shutter(seconds: Column) -> Column:
    return F.when(seconds >= 1, F.format_string("%.1f s", _tenth(seconds))).otherwise(F.concat(F.lit("1/"), F.rint(1 / seconds).cast("long").cast("string"), F.lit(" s")))
