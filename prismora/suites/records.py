"""Files, metadata, documents, batches and edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as fx
from ..plans import frames
from ..sources import paths
from ..streaming import edits
from .pixel import r6
from .registry import Suite

S = Suite()
SUFFIXES = [*paths.RAW_SUFFIXES, ".JPG", ".Nef", "", ".tar.gz"]
_LIST = ", ".join(f"'{s}'" for s in SUFFIXES)
_RAW = ", ".join(f"'{s}'" for s in paths.RAW_SUFFIXES)
_PATHS = f"p AS (SELECT page_id, '/in/' || regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') || [{_LIST}][page_id % {len(SUFFIXES)} + 1] AS path FROM pages)"
_NAME = "split_part(path, '/', -1)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % len(SUFFIXES) + 1).cast("int"))
    return frames.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/"), F.regexp_replace("url", "[^A-Za-z0-9]+", "_"), named).alias("path"))


@S.add(f"WITH {_PATHS} SELECT page_id, lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)) IN ({_RAW}) AS raw FROM p")
def raw_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", paths.is_raw(F.col("path")).alias("raw"))


@S.add(f"WITH {_PATHS} SELECT path FROM p WHERE lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)) IN ({_RAW}) ORDER BY lower({_NAME}), path LIMIT 200")
def discover_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.discover(_paths(spark, sf_dir)).select("path")


@S.add(f"""WITH {_PATHS}, n AS (SELECT page_id, {_NAME} AS name, regexp_extract({_NAME}, '^(.+?)(\\.[^.]+)?$', 1) AS stem FROM p)
SELECT page_id, '/out/previews/' || stem || '.preview.png' AS preview_path, '/out/exports/' || stem || '.auto.jpg' AS export_path, '/out/recipes/' || name || '.recipe.json' AS recipe_path, '/out/intermediates/' || stem || '.base.tif' AS intermediate_path FROM n""")
def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", *paths.artifacts(F.col("path"), "/out"))


#: Directories by rule: three a photo, the values of a tag differing from one to the next, some absent.
_TAGS = """tags AS (SELECT f.photo, d AS ifd, t AS tag, ((photo * 7 + d * 5) % 11 + 1) * 100 AS area, photo * 100 + d * 10 + t AS v FROM frames f, range(3) a(d), range(6) b(t) WHERE (photo + d + t) % 3 > 0)"""


@S.add(f"WITH {frames.frames_sql()}, {_TAGS} SELECT photo, tag, v FROM tags QUALIFY row_number() OVER (PARTITION BY photo, tag ORDER BY area DESC, ifd) = 1")
def ifd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each tag, larger images' directories first. max_by keeps one row a tag; no sort."""
    t = frames.frames(spark, sf_dir).select("photo", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ifd")).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("tag")).where((F.col("photo") + F.col("ifd") + F.col("tag")) % 3 > 0)
    area = ((F.col("photo") * 7 + F.col("ifd") * 5) % 11 + 1) * 100
    v = F.col("photo") * 100 + F.col("ifd") * 10 + F.col("tag")
    return t.groupBy("photo", F.col("tag").cast("long").alias("tag")).agg(F.max_by(v, F.struct(area, -F.col("ifd"))).alias("v"))


_LINKS = "links AS (SELECT photo, a AS src, (a * 3 + photo) % 9 AS dst FROM frames, range(9) t(a) UNION ALL SELECT photo, a, (a + 4) % 9 FROM frames, range(9) t(a) WHERE (a + photo) % 4 = 0)"


@S.add(f"WITH RECURSIVE {frames.frames_sql()}, {_LINKS}, w AS (SELECT photo, 0::BIGINT AS ifd FROM frames UNION SELECT w.photo, l.dst::BIGINT FROM w JOIN links l ON l.photo = w.photo AND l.src = w.ifd) SELECT photo, count(*) AS reached, sum(ifd)::BIGINT AS total FROM w GROUP BY photo")
def ifd_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories reachable along links, cycles included: breadth first until nothing new is found."""
    f = frames.frames(spark, sf_dir).select("photo")
    nodes = f.select("photo", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k.cast("long"))).alias("src"))
    links = nodes.select("photo", "src", ((F.col("src") * 3 + F.col("photo")) % 9).alias("dst")).union(nodes.where((F.col("src") + F.col("photo")) % 4 == 0).select("photo", "src", ((F.col("src") + 4) % 9).alias("dst")))
    out = links.groupBy("photo").agg(F.collect_list(F.struct("src", "dst")).alias("links"))  # of one file
    step = lambda seen: F.array_distinct(F.concat(seen, F.transform(F.filter("links", lambda l: F.array_contains(seen, l["src"])), lambda l: l["dst"])))
    steps = F.sequence(F.lit(1), F.size("links") + 1)  # a directory that isn't found by then has no path: each step but the last finds one
    seen = F.aggregate(steps, F.array(F.lit(0).cast("long")), lambda a, _: step(a))
    reached = out.select("photo", F.explode(seen).alias("ifd"))
    return reached.groupBy("photo").agg(F.count("*").alias("reached"), F.sum("ifd").alias("total"))


@S.add("SELECT lang, source, n_chars // 1000 AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "documents").groupBy("lang", "source", F.floor(F.col("n_chars") / 1000).alias("bucket")).agg(F.count("*").alias("n"))


_ISSUES = ["'compression ' || c || ' is not supported'", "bits || ' bits per sample'", "'no Bayer pattern'", "'empty image'"]


@S.add(f"""WITH {frames.frames_sql()}, h AS (SELECT photo, CASE photo % 6 WHEN 0 THEN 7 WHEN 1 THEN 34713 ELSE 1 END AS c, [8, 12, 14, 16, 24][photo % 5 + 1] AS bits, photo % 4 > 0 AS cfa, (photo % 9) * 16 AS w, photo % 7 > 0 AS there, photo % 3 > 0 AS jpeg FROM frames),
i AS (SELECT *, CASE WHEN c <> 1 THEN 'compression ' || c || ' is not supported' END AS i1, CASE WHEN bits NOT IN (12, 14, 16) THEN bits || ' bits per sample' END AS i2, CASE WHEN NOT cfa THEN 'no Bayer pattern' END AS i3, CASE WHEN w = 0 THEN 'empty image' END AS i4 FROM h)
SELECT photo, CASE WHEN NOT there THEN 'missing' WHEN coalesce(i1, i2, i3, i4) IS NULL THEN 'supported' WHEN jpeg THEN 'preview_only' WHEN c = 34713 THEN 'import_only' ELSE 'unsupported' END AS status,
  CASE WHEN NOT there THEN 'Source file does not exist.' ELSE coalesce(i1, i2, i3, i4, 'ready') END AS reason, CASE WHEN there THEN (i1 IS NOT NULL)::INTEGER + (i2 IS NOT NULL)::INTEGER + (i3 IS NOT NULL)::INTEGER + (i4 IS NOT NULL)::INTEGER ELSE 0 END AS issues FROM i""")
def support_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("photo")
    h = frames.frames(spark, sf_dir).select("photo", F.when(p % 6 == 0, 7).when(p % 6 == 1, 34713).otherwise(1).alias("compression"), F.element_at(F.array(*map(F.lit, (8, 12, 14, 16, 24))), (p % 5 + 1).cast("int")).alias("bits"), (p % 4 > 0).alias("cfa"), (p % 9 * 16).alias("width"), (p % 7 > 0).alias("there"), (p % 3 > 0).alias("jpeg"))
    return h.select("photo", *fx.support("there", "compression", "bits", "cfa", "width", "jpeg"))


@S.add("""WITH d AS (SELECT doc_id, text AS t, doc_id % 4 AS k, n_chars FROM documents), e AS (SELECT *, strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 3671), '%Y-%m-%dT%H:%M:%S') AS iso, strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 3671), '%Y:%m:%d %H:%M:%S') AS exif FROM d)
SELECT doc_id, CASE WHEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN regexp_replace(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '[^\x00-\x7F]', '?', 'g') END AS ascii_, CASE WHEN n_chars - 500 > 0 THEN n_chars - 500 END AS positive, CASE k WHEN 0 THEN exif WHEN 1 THEN exif WHEN 2 THEN exif ELSE NULL END AS taken FROM e""")
def metadata_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to ASCII, positive numbers, and times: EXIF text with something behind it, ISO with Z, ISO with an offset that is dropped, and no time."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3671)
    iso, exif = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(at, "yyyy:MM:dd HH:mm:ss")
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(exif, F.lit(".25"))).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit("+05:30"))).otherwise("yesterday")
    d = frames.table(spark, sf_dir, "documents")
    return d.select("doc_id", fx.ascii_text(F.col("text")).alias("ascii_"), fx.positive_int((F.col("n_chars") - 500).cast("string")).alias("positive"), fx.exif_time(said).alias("taken"))


_EDITS = "edits AS (SELECT user_id AS source, ts, event_id AS seq, event_type AS action, round_even((value % 4 - 2) * 10000, 0) / 10000 AS value FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.edits(frames.table(spark, sf_dir, "events"))


@S.add(f"WITH {_EDITS} SELECT source, seq, action, value FROM edits QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) = 1")
def edit_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.newest(_log(spark, sf_dir))


@S.add(f"WITH {_EDITS} SELECT source, seq, action, value FROM edits QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) = 1")
def edit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form over the same log; it ends with the same rows."""
    return edits.replay(spark, f"{sf_dir}/events.parquet", "prismora_edit_stream")


_GEN = f"""WITH {_EDITS}, m AS (SELECT *, CASE WHEN action IN ('view', 'click') THEN 'view' ELSE 'detail' END AS mode FROM edits),
c AS (SELECT *, CASE WHEN lag(mode) OVER w IS DISTINCT FROM mode OR coalesce(lag(action) OVER w = 'error', false) THEN 1 ELSE 0 END AS changed FROM m WINDOW w AS (PARTITION BY source ORDER BY ts, seq)),
g AS (SELECT *, sum(changed) OVER (PARTITION BY source ORDER BY ts, seq)::BIGINT AS generation FROM c)"""


@S.add(f"{_GEN} SELECT source, seq, generation FROM g")
def edit_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.generations(_log(spark, sf_dir)).select("source", "seq", "generation")


@S.add(f"{_GEN}, n AS (SELECT *, lead(generation) OVER (PARTITION BY source ORDER BY ts, seq) AS next FROM g) SELECT source, seq, generation FROM n WHERE next IS NOT NULL AND next <> generation")
def stale_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.stale(_log(spark, sf_dir)).where(~F.col("published")).select("source", "seq", "generation")


@S.add()
def undo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.histories(_log(spark, sf_dir))


@S.add(f"""WITH {_EDITS} SELECT seq, greatest(-2::DOUBLE, least(2::DOUBLE, 2 * value)) AS exposure, greatest(-1::DOUBLE, least(1::DOUBLE, value)) AS contrast, greatest(0::DOUBLE, least(1::DOUBLE, value)) AS color_noise, CASE WHEN seq % 7 = 0 THEN 0 ELSE greatest(-1::DOUBLE, least(1::DOUBLE, -value)) END AS tint FROM edits""")
def clean_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliders from text, bad values as 0, each in its own range, to four decimals."""
    said = _log(spark, sf_dir).select("seq", (2 * F.col("value")).cast("string").alias("exposure"), F.col("value").cast("string").alias("contrast"), F.col("value").cast("string").alias("color_noise"), F.when(F.col("seq") % 7 == 0, "much").otherwise((-F.col("value")).cast("string")).alias("tint"))
    return said.select("seq", *(fx.slider(F.col(k), low, high).alias(k) for k, low, high in (("exposure", -2, 2), ("contrast", -1, 1), ("color_noise", 0, 1), ("tint", -1, 1))))


@S.add(f"""WITH {_EDITS} SELECT seq, 'recipe.v1' AS version, sha256('/in/' || source || '.nef') AS checksum, true AS immutable, CASE WHEN action = 'error' THEN 0.1::DOUBLE ELSE value END AS exposure, 0.1::DOUBLE AS contrast, 1 AS n_exports FROM edits""")
def recipe_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested recipe documents as JSON, read back; overrides win over defaults."""
    log = _log(spark, sf_dir)
    path = F.concat(F.lit("/in/"), F.col("source"), F.lit(".nef"))
    overrides = F.when(F.col("action") == "error", F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("exposure"), F.col("value")))
    text = fx.recipe(path, F.sha2(path.cast("binary"), 256), F.create_map(F.lit("exposure"), F.lit(0.1), F.lit("contrast"), F.lit(0.1)), overrides)
    doc = log.select("seq", F.from_json(text, fx.RECIPE).alias("d"))
    return doc.select("seq", F.col("d.schema_version").alias("version"), F.col("d.source.checksum_sha256").alias("checksum"), F.col("d.source.immutable").alias("immutable"), F.col("d.adjustments.raw")["exposure"].alias("exposure"), F.col("d.adjustments.raw")["contrast"].alias("contrast"), F.size("d.exports").alias("n_exports"))


_ITEMS = "items AS (SELECT o_orderkey AS item, o_orderstatus AS s, substr(o_orderpriority, 1, 1)::INTEGER AS p FROM orders)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    return frames.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("s"), (p <= 3).alias("can_render"), (p <= 4).alias("can_preview"))


def _routed(items: DataFrame, cancel_after: int) -> DataFrame:
    status = F.when(F.col("item") > cancel_after, "cancelled").when(~F.col("can_preview"), "skipped").when(F.col("s") == "F", "failed").when(F.col("can_render"), "exported").otherwise("previewed")
    return items.select("item", status.alias("status"))


_ROUTED = "CASE WHEN item > 1200 THEN 'cancelled' WHEN p > 4 THEN 'skipped' WHEN s = 'F' THEN 'failed' WHEN p <= 3 THEN 'exported' ELSE 'previewed' END"


@S.add(f"WITH {_ITEMS} SELECT item, {_ROUTED} AS status FROM items")
def batch_status_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(_items(spark, sf_dir), 1200)


@S.add(f"WITH {_ITEMS}, r AS (SELECT {_ROUTED} AS s FROM items) SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (s = '{s}') AS {s}''' for s in ('exported', 'previewed', 'skipped', 'failed', 'cancelled'))}, count(*) FILTER (s IN ('exported', 'previewed')) AS processed FROM r")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routed(_items(spark, sf_dir), 1200)
    return r.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("exported", "previewed", "skipped", "failed", "cancelled")), F.count_if(F.col("status").isin("exported", "previewed")).alias("processed"))


@S.add("WITH b AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, sha256(text) AS checksum FROM documents WHERE sha256(text) IN (SELECT h FROM b)")
def checksum_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to which an edit is bound by checksum."""
    d = frames.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))
    bound = d.where("doc_id % 3 = 0").select("checksum")
    return d.join(bound, "checksum", "left_semi").select("doc_id", "checksum")


@S.add(f"SELECT item, size, shutter, {r6('fraction')} AS fraction FROM (SELECT l_orderkey * 10 + l_linenumber AS item, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round_even(b / 1024::DOUBLE * 10, 0) / 10) ELSE printf('%.1f MB', round_even(b / 1048576::DOUBLE * 10, 0) / 10) END AS size, CASE WHEN t >= 1 THEN printf('%.1f s', round_even(t * 10, 0) / 10) ELSE '1/' || round_even(1 / t, 0)::BIGINT || ' s' END AS shutter, t / 3 AS fraction FROM (SELECT *, (l_partkey * l_partkey)::BIGINT AS b, l_quantity / 16 AS t FROM lineitem))")
def label_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and shutter speeds as text."""
    li = frames.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), (F.col("l_partkey") * F.col("l_partkey")).alias("b"), (F.col("l_quantity") / 16).alias("t"))
    return li.select("item", fx.byte_size(F.col("b")).alias("size"), fx.shutter(F.col("t")).alias("shutter"), (F.rint(F.col("t") / 3 * 1e6) / 1e6).alias("fraction"))
