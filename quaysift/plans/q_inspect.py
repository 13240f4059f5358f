"""Queries on archives, images and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups
from ..operators import archive as R
from ..operators import image as G
from ..operators import media as D
from .q_admission import CATEGORY, DETECTED, FILES, REG, admitted, detected
from .base import query
from .views import duck, duck_values, registry, table

ENTRIES = f"WITH e AS ({duck('v_entries')})"
SUFFIX = r"(?i)\.(zip|tar|gz|tgz|tar\.gz|tar\.bz2|tar\.xz|bz2|xz|7z|rar|zst|lz4)$"
PATH_REASON = f"""CASE WHEN path LIKE '/%' OR contains(path, '../') OR contains(path, '..\\') THEN 'archive_path_traversal' WHEN regexp_matches(path, '{SUFFIX}') THEN 'archive_nested_archive'
  WHEN length(path) - length(replace(replace(path, '/', ''), '\\', '')) > 8 THEN 'archive_depth_exceeded' END"""
LIMIT = "least(greatest(200::BIGINT * greatest(archive_size, 1), 10485760), 2147483648)"
RUN = "sum(uncomp_size) OVER (PARTITION BY archive_id ORDER BY entry_idx)::BIGINT"
COUNT = "sum(CASE WHEN typeflag IN ('x', 'g', 'L', 'K') THEN 0 ELSE 1 END) OVER (PARTITION BY archive_id ORDER BY entry_idx)::BIGINT"


def entries(spark, sf_dir):
    return table(spark, sf_dir, "v_entries")


@query("arc_3_archive_kind", f"{FILES}, {REG}, {DETECTED} SELECT file_id, CASE WHEN NOT (ext IN (SELECT ext FROM reg WHERE list_contains(scan, 'archive'))) THEN 'none' WHEN file_id % 2 = 0 THEN 'zip' ELSE 'none' END AS kind FROM det")
def arc_3(spark, sf_dir):
    """Files by extension, half of which begin as a zip does."""
    archives = F.broadcast(registry(spark).filter(F.array_contains("scan", "archive")).select("ext", F.lit(True).alias("is_archive")))
    x = detected(spark, sf_dir).join(archives, "ext", "left")
    head = F.when(F.col("file_id") % 2 == 0, F.concat(F.unhex(F.lit("504B0304")), F.col("content").cast("binary"))).otherwise(F.concat(F.lit(b"-"), F.col("content").cast("binary")))
    return x.select("file_id", R.archive_kind(head, F.lit("application/x-none"), F.col("is_archive")).alias("kind"))


@query("arc_4_entry_path", f"{ENTRIES} SELECT archive_id, entry_idx, {PATH_REASON} AS reason FROM e UNION ALL SELECT page_id, -1, {PATH_REASON.replace('path', 'url')} FROM pages")
def arc_4(spark, sf_dir):
    x = entries(spark, sf_dir).select("archive_id", "entry_idx", R.entry_path_reason(F.col("path")).alias("reason"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("archive_id"), F.lit(-1).alias("entry_idx"), R.entry_path_reason(F.col("url")).alias("reason"))
    return x.unionByName(pages)


@query("arc_5_nested_by_magic", f"{FILES} SELECT file_id, file_id % 3 = 0 OR (file_id % 3 <> 1 AND content LIKE 'BZh%' AND strlen(content) >= 4) AS nested FROM f")
def arc_5(spark, sf_dir):
    """Every third file begins as a gzip does, every other third is cut to three bytes of an xz."""
    body = F.col("content").cast("binary")
    head = F.when(F.col("file_id") % 3 == 0, F.concat(F.unhex(F.lit("1F8B0800")), body)).when(F.col("file_id") % 3 == 1, F.unhex(F.lit("FD377A"))).otherwise(body)
    return table(spark, sf_dir, "v_files").select("file_id", R.nested_by_magic(head).alias("nested"))


@query("arc_6_expansion_limit", f"WITH e AS (SELECT file_id, strlen(content) * 1000 AS archive_size FROM ({duck('v_files')})) SELECT file_id, {LIMIT} AS expansion_limit FROM e")
def arc_6(spark, sf_dir):
    return table(spark, sf_dir, "v_files").select("file_id", R.expansion_limit(F.octet_length("content") * 1000).alias("expansion_limit"))


@query("arc_7_running_expansion", f"{ENTRIES} SELECT archive_id, entry_idx, {RUN} AS expanded, {RUN} > {LIMIT} AS over FROM e")
def arc_7(spark, sf_dir):
    return R.running_expansion(entries(spark, sf_dir)).select("archive_id", "entry_idx", "expanded", "over")


@query("arc_8_entry_count", f"{ENTRIES} SELECT archive_id, entry_idx, {COUNT} AS counted, {COUNT} > 4 AS too_many FROM e")
def arc_8(spark, sf_dir):
    return R.running_count(entries(spark, sf_dir), most=4).select("archive_id", "entry_idx", F.col("counted").cast("long").alias("counted"), "too_many")


@query("arc_9_entry_size", f"""{ENTRIES}, s AS (SELECT *, CASE entry_idx % 5 WHEN 0 THEN 'bad_header' WHEN 1 THEN 'truncated' WHEN 2 THEN 'corrupt' ELSE 'ok' END AS status FROM e)
SELECT archive_id, entry_idx, CASE WHEN status = 'bad_header' THEN 'zip_local_header_invalid' WHEN status = 'truncated' THEN 'zip_entry_truncated' WHEN status = 'corrupt' THEN 'zip_entry_corrupt' WHEN actual_size <> uncomp_size THEN 'archive_size_mismatch' END AS reason FROM s""")
def arc_9(spark, sf_dir):
    status = F.when(F.col("entry_idx") % 5 == 0, "bad_header").when(F.col("entry_idx") % 5 == 1, "truncated").when(F.col("entry_idx") % 5 == 2, "corrupt").otherwise("ok")
    reason = R.entry_size_reason(status, F.lit(8), F.col("uncomp_size"), F.col("uncomp_size"), F.col("actual_size"))
    return entries(spark, sf_dir).select("archive_id", "entry_idx", reason.alias("reason"))


@query("arc_10_structure", f"""{ENTRIES}, a AS (SELECT archive_id, count(*) AS n, max(uncomp_size) AS size FROM e GROUP BY archive_id)
SELECT archive_id, CASE WHEN size < 22 THEN 'zip_too_small' WHEN archive_id % 5 = 0 THEN 'zip_no_eocd' WHEN archive_id % 13 = 0 THEN 'archive_entries_exceeded' WHEN archive_id % 7 = 0 THEN 'zip_cd_truncated' WHEN archive_id % 11 = 0 THEN 'zip_cd_malformed' END AS reason FROM a""")
def arc_10(spark, sf_dir):
    """Archives, of which some lack an end record, some declare 3000 entries more, some point past their end, and some declare one entry more."""
    a = entries(spark, sf_dir).groupBy("archive_id").agg(F.count(F.lit(1)).alias("n"), F.max("uncomp_size").alias("size"))
    i, n, size = F.col("archive_id"), F.col("n"), F.col("size")
    reason = R.structure_reason(size, i % 5 != 0, F.when(i % 7 == 0, size + 1).otherwise(size), n, F.when(i % 13 == 0, n + 3000).when(i % 11 == 0, n + 1).otherwise(n))
    return a.select("archive_id", reason.alias("reason"))


@query(
    "arc_11_archive_verdict",
    f"""{ENTRIES}, x AS (SELECT archive_id, entry_idx, CASE WHEN typeflag <> 'x' THEN {PATH_REASON} END AS p, typeflag <> 'x' AND {COUNT} > 6 AS m, {RUN} > {LIMIT} AS o, actual_size <> uncomp_size AS s FROM e),
v AS (SELECT archive_id, entry_idx, CASE WHEN p IS NOT NULL THEN p WHEN m THEN 'archive_entries_exceeded' WHEN o THEN 'archive_expansion_exceeded' WHEN s THEN 'archive_size_mismatch' END AS reason FROM x)
SELECT archive_id, CASE WHEN count(reason) = 0 THEN 'clean' ELSE 'rejected' END AS verdict, 'archive_policy:' || arg_min(reason, entry_idx) FILTER (WHERE reason IS NOT NULL) AS reason FROM v GROUP BY archive_id""",
)
def arc_11(spark, sf_dir):
    return R.archive_verdict(entries(spark, sf_dir), most=6)


KIND = "CASE mime WHEN 'image/png' THEN 'png' WHEN 'image/gif' THEN 'gif' ELSE CASE WHEN ext = 'png' THEN 'png' WHEN ext IN ('jpg', 'jpeg') THEN 'jpeg' ELSE 'unsupported' END END"
CHUNKS = f"WITH c AS ({duck('v_image_chunks')})"


@query("img_1_image_kind", f"{FILES}, {DETECTED} SELECT file_id, {KIND} AS kind FROM det")
def img_1(spark, sf_dir):
    return detected(spark, sf_dir).select("file_id", G.image_kind(F.col("mime"), F.col("ext")).alias("kind"))


@query("img_2_image_dimensions", f"{FILES} SELECT file_id, strlen(content) >= 0 AS ok, (file_id % 5000 + 1)::BIGINT AS width, strlen(content)::BIGINT AS height FROM f")
def img_2(spark, sf_dir):
    """Each file behind a PNG header that tells its number and length."""
    be = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), be((F.col("file_id") % 5000 + 1).cast("long")), be(F.octet_length("content").cast("long")), F.col("content").cast("binary"))
    x = table(spark, sf_dir, "v_files").select("file_id", G.image_dimensions(head, F.lit("png")).alias("d"))
    return x.select("file_id", "d.ok", "d.width", "d.height")


ANIMATED = """an AS (SELECT file_id, coalesce(arg_max(frames, chunk_idx) FILTER (WHERE chunk_type = 'acTL' AND length = 8 AND (d IS NULL OR chunk_idx < d)), 0) > 1 AS animated
  FROM c LEFT JOIN (SELECT file_id, min(chunk_idx) AS d FROM c WHERE chunk_type = 'IDAT' GROUP BY file_id) USING (file_id) GROUP BY file_id)"""
ENDS = """en AS (SELECT *, sum(length + 12) OVER (PARTITION BY file_id ORDER BY chunk_idx) AS e, sum(length + 12) OVER (PARTITION BY file_id) + CASE WHEN file_id % 3 = 0 THEN 5 ELSE 0 END AS file_length FROM c),
tr AS (SELECT file_id, coalesce(NOT (min(e) FILTER (WHERE chunk_type = 'IEND') = max(file_length)), true) AS "trailing" FROM en GROUP BY file_id)"""


def chunks(spark, sf_dir):
    """Chunks with their ends, in files of which every third has bytes behind its last chunk."""
    from pyspark.sql import Window as W

    x = table(spark, sf_dir, "v_image_chunks")
    run, whole = W.partitionBy("file_id").orderBy("chunk_idx").rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy("file_id")
    size = F.col("length") + 12
    return x.withColumns({"end": F.sum(size).over(run), "file_length": F.sum(size).over(whole) + F.when(F.col("file_id") % 3 == 0, 5).otherwise(0)})


@query("img_5_animation", f"{CHUNKS}, {ANIMATED} SELECT * FROM an")
def img_5(spark, sf_dir):
    return G.animation_flags(chunks(spark, sf_dir))


@query("img_6_trailing_data", f"{CHUNKS}, {ENDS} SELECT * FROM tr")
def img_6(spark, sf_dir):
    return G.trailing_data(chunks(spark, sf_dir))


IMAGE = f"""{CHUNKS}, {ANIMATED}, {ENDS}, i AS (SELECT file_id, animated, "trailing", CASE file_id % 6 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' ELSE 'png' END AS kind, file_id % 12 = 0 AS opaque,
  file_id % 17 <> 0 AS header_ok, file_id * 31 % 20000 AS width, file_id * 17 % 15000 AS height, CASE WHEN file_id % 19 = 0 THEN 600 ELSE 1 END * 1048576::BIGINT AS length FROM an JOIN tr USING (file_id)),
r AS (SELECT *, CASE WHEN kind = 'unsupported' AND opaque THEN 'opaque_image_passthrough' WHEN kind = 'unsupported' THEN 'unsupported_image_format' WHEN length > 536870912 THEN 'image_too_large' WHEN NOT header_ok THEN 'image_header_malformed'
  WHEN width > 0 AND height > 0 AND (width > 16384 OR height > 16384) THEN 'image_dimensions_exceeded' WHEN width > 0 AND height > 0 AND width * height > 100000000 THEN 'image_pixel_count_exceeded'
  WHEN animated AND kind IN ('gif', 'png') AND "trailing" THEN kind || '_trailing_data' WHEN animated AND kind IN ('gif', 'png') THEN kind || '_animated_passthrough' END AS reason FROM i)
SELECT file_id, CASE WHEN reason IS NULL THEN 'sanitized' WHEN reason = 'unsupported_image_format' THEN 'error' WHEN reason LIKE '%_passthrough' THEN 'clean' ELSE 'rejected' END AS verdict, reason, reason IS NULL AS reencode FROM r"""


@query("img_7_image_policy", IMAGE)
def img_7(spark, sf_dir):
    i = F.col("file_id")
    x = G.image_flags(chunks(spark, sf_dir)).select(
        "file_id", "animated", "trailing", F.when(i % 6 == 0, "unsupported").when(i % 6 == 1, "gif").when(i % 6 == 2, "jpeg").otherwise("png").alias("kind"), (i % 12 == 0).alias("opaque"), (i % 17 != 0).alias("header_ok"),
        (i * 31 % 20000).alias("width"), (i * 17 % 15000).alias("height"), (F.when(i % 19 == 0, 600).otherwise(1) * F.lit(1 << 20)).cast("long").alias("length"),
    )
    return x.select("file_id", G.image_policy().alias("p")).select("file_id", "p.*")


AUDIO, VIDEO = duck_values("au", ["x", "c", "k"], lookups.AUDIO), duck_values("vi", ["x", "c"], lookups.VIDEO)
PLAN = f"""{FILES}, {REG}, {DETECTED}, {AUDIO}, {VIDEO}, cat AS (SELECT file_id, ext, content, {CATEGORY} AS category FROM det),
pl AS (SELECT file_id, ext, category, CASE category WHEN 'AUDIO' THEN coalesce(au.c, 'mp3') WHEN 'VIDEO' THEN coalesce(vi.c, 'mp4') END AS container, CASE WHEN category = 'AUDIO' THEN au.k END AS codec
  FROM cat LEFT JOIN au ON au.x = ext LEFT JOIN vi ON vi.x = ext)"""


def planned(spark, sf_dir):
    return D.media_plan(admitted(spark, sf_dir).select("file_id", "ext", "category", "content"))


@query("med_1_media_plan", f"{PLAN} SELECT file_id, category, container, codec FROM pl")
def med_1(spark, sf_dir):
    return planned(spark, sf_dir).select("file_id", "category", "container", "codec")


@query("med_2_media_attempts", f"""{PLAN}, a AS (SELECT file_id, CASE WHEN category = 'AUDIO' AND codec IS NOT NULL THEN ['remux', 'reencode', 'reencode_lenient'] WHEN category = 'AUDIO' THEN ['remux'] WHEN category = 'VIDEO' THEN ['remux', 'reencode_mp4'] WHEN category = 'PDF' THEN ['rewrite'] END AS l FROM pl)
SELECT file_id, unnest(range(0, len(l)))::INT AS attempt_idx, unnest(l) AS attempt FROM a WHERE l IS NOT NULL""")
def med_2(spark, sf_dir):
    return D.media_attempts(planned(spark, sf_dir)).select("file_id", "attempt_idx", "attempt")


ATTEMPTS = f"WITH a AS ({duck('v_attempts')})"


@query("med_3_attempt_budget", f"{ATTEMPTS}, s AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY file_id ORDER BY attempt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM a) SELECT file_id, attempt_idx, spent, greatest(least(300, 420 - spent), 0) AS allowed, greatest(least(300, 420 - spent), 0) <= 0 AS exhausted FROM s")
def med_3(spark, sf_dir):
    return D.attempt_budget(table(spark, sf_dir, "v_attempts")).select("file_id", "attempt_idx", "spent", "allowed", "exhausted")


@query("med_4_resolve_attempts", f"""{ATTEMPTS}, r AS (SELECT file_id, category, bool_or(ok) AS k, bool_or(timed_out) AS t FROM a GROUP BY ALL)
SELECT file_id, category, CASE WHEN k THEN 'sanitized' ELSE 'error' END AS verdict, CASE WHEN k THEN NULL WHEN category = 'audio' THEN CASE WHEN t THEN 'ffmpeg_timeout' ELSE 'ffmpeg_sanitize_failed' END
  WHEN category = 'video' THEN 'ffmpeg_remux_and_reencode_failed' ELSE CASE WHEN t THEN 'ghostscript_timeout' ELSE 'ghostscript_failed' END END AS reason FROM r""")
def med_4(spark, sf_dir):
    return D.resolve_attempts(table(spark, sf_dir, "v_attempts"))


@query("med_5_size_limits", f"{PLAN}, z AS (SELECT file_id, category, strlen(content)::BIGINT * 1048576 AS length FROM cat) SELECT file_id, CASE WHEN category = 'PDF' AND length > 1073741824 THEN 'pdf_too_large' WHEN category = 'AUDIO' AND file_id % 2 <> 0 AND length > 1073741824 THEN 'audio_too_large' WHEN category = 'VIDEO' AND length > 5368709120 THEN 'video_too_large' END AS too_large FROM z")
def med_5(spark, sf_dir):
    """Files whose bytes count as MiB; even ones have an opaque extension."""
    x = admitted(spark, sf_dir).select("file_id", "category", (F.octet_length("content").cast("long") * (1 << 20)).alias("length"), (F.col("file_id") % 2 == 0).alias("opaque"))
    return D.size_limits(x).select("file_id", "too_large")
