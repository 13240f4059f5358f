"""Queries on requests, the type registry and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups
from ..functions import checks as C
from ..operators import admission as A
from .base import query
from .views import aliases, duck, duck_values, registry, table

REQ = f"WITH r AS ({duck('v_requests')})"
FILES = f"WITH f AS ({duck('v_files')})"
REG = duck_values("reg", ["ext", "type", "mime", "scan", "zip_based"], lookups.REGISTRY)
ALIAS = duck_values("al", ["mime", "alias"], lookups.ALIASES)
NEVER = "('application/octet-stream', 'application/unknown')"
PAIRS = f"""{REG}, {ALIAS},
pairs AS (SELECT DISTINCT mime, ext FROM (SELECT mime, ext FROM reg UNION ALL SELECT al.alias, ext FROM reg JOIN al USING (mime)
  UNION ALL SELECT z.m, ext FROM reg, (VALUES ('application/zip'), ('application/x-zip-compressed')) z(m) WHERE zip_based))"""
EXT = r"substring(lower(regexp_extract(filename, '^.+\.([^.]+)$', 1)), 1, 31)"
DETECTED = f"det AS (SELECT file_id, filename, mime, {EXT} AS ext, content FROM f)"
CATEGORY = """CASE WHEN mime = 'image/svg+xml' OR ext = 'svg' THEN 'SVG' WHEN mime LIKE 'image/%' THEN 'RASTER' WHEN mime = 'application/pdf' THEN 'PDF' WHEN mime LIKE 'video/%' THEN 'VIDEO'
  WHEN mime LIKE 'audio/%' THEN 'AUDIO' WHEN ext IN (SELECT ext FROM reg WHERE list_contains(scan, 'archive')) THEN 'ARCHIVE' WHEN mime LIKE 'text/%' THEN 'TEXT' ELSE 'GENERIC' END"""
ADMIT = f"""{FILES}, {PAIRS}, {DETECTED},
ex AS (SELECT mime, list(ext) AS exts FROM pairs WHERE mime NOT IN {NEVER} GROUP BY mime),
px AS (SELECT p AS prefix, (SELECT coalesce(list(ext), []) FROM reg WHERE type || '/' = p) AS exts FROM (VALUES ('image/'), ('text/'), ('audio/'), ('video/'), ('font/'), ('model/')) v(p)),
cls AS (SELECT list(ext) AS exts FROM reg WHERE type IN ('certificate', 'database', 'font') OR len(scan) > 0),
hit AS (SELECT det.*, ex.mime IS NOT NULL AS e, ext <> '' AND coalesce(list_contains(ex.exts, ext), false) AS em, px.prefix IS NOT NULL AS p, ext <> '' AND coalesce(list_contains(px.exts, ext), false) AS pm,
  ext <> '' AND det.mime IN ('application/octet-stream', 'application/unknown', 'application/x-empty') AND list_contains(cls.exts, ext) AS c
  FROM det LEFT JOIN ex USING (mime) LEFT JOIN px ON px.prefix = split_part(det.mime, '/', 1) || '/' CROSS JOIN cls),
adm AS (SELECT file_id, filename, mime, ext, content, em OR p OR e OR c AS allowed, CASE WHEN em THEN true WHEN p THEN pm WHEN e THEN false ELSE c END AS matches_ext FROM hit),
ver AS (SELECT *, CASE WHEN NOT allowed THEN 'disallowed_mime_type' WHEN ext <> '' AND NOT matches_ext THEN 'mime_extension_mismatch' END AS reason FROM adm)"""


def detected(spark, sf_dir):
    """Files with their extension."""
    return table(spark, sf_dir, "v_files").withColumn("ext", C.extension(F.col("filename")))


def admitted(spark, sf_dir):
    """Files with category, admission and its reason."""
    reg, al = registry(spark), aliases(spark)
    classes = A.scan_class_exts(reg)
    x = A.admit(detected(spark, sf_dir), A.mime_to_exts(reg, al), A.prefix_to_exts(reg), classes)
    verdict, reason = A.admission_verdict()
    return A.categorize(x.withColumns({"verdict": verdict, "reason": reason}), classes)


@query("val_1_required", f"{REQ} SELECT request_id, CASE WHEN file_path IS NULL THEN 'file_path' WHEN user_id IS NULL THEN 'user_id' WHEN version IS NULL THEN 'version' WHEN plaintext_sha256 IS NULL THEN 'plaintext_sha256' END AS missing FROM r")
def val_1(spark, sf_dir):
    return table(spark, sf_dir, "v_requests").select("request_id", C.required(["file_path", "user_id", "version", "plaintext_sha256"]).alias("missing"))


@query(
    "val_2_ranges",
    f"""{REQ} SELECT request_id, CASE WHEN NOT coalesce(user_id >= 1, false) THEN 'user_id' WHEN version NOT BETWEEN 2 AND 2147483647 THEN 'version' WHEN chunk_size <> 1048576 THEN 'chunk_size'
  WHEN chunks NOT BETWEEN 1 AND 2147483647 THEN 'chunks' WHEN plaintext_size NOT BETWEEN 0 AND 5368709120 THEN 'plaintext_size' WHEN strlen(original_filename) >= 256 THEN 'original_filename'
  WHEN strlen(file_path) NOT BETWEEN 1 AND 4095 THEN 'file_path' END AS out_of_range FROM r""",
)
def val_2(spark, sf_dir):
    return table(spark, sf_dir, "v_requests").select("request_id", C.ranges().alias("out_of_range"))


@query("val_3_chunk_count", f"{REQ} SELECT request_id, abs(chunks - (plaintext_size + chunk_size - 1) // chunk_size) <= 1 AS ok FROM r")
def val_3(spark, sf_dir):
    return table(spark, sf_dir, "v_requests").select("request_id", C.chunk_count_ok(F.col("plaintext_size"), F.col("chunk_size"), F.col("chunks")).alias("ok"))


@query("val_4_safe_path", f"{REQ} SELECT request_id, file_path LIKE '/q/in/%' AND strlen(file_path) > 6 AND NOT contains(file_path, '/../') AND NOT file_path LIKE '%/..' AND NOT file_path LIKE '%/' AS ok FROM r")
def val_4(spark, sf_dir):
    return table(spark, sf_dir, "v_requests").select("request_id", C.safe_path(F.col("file_path"), "/q/in/").alias("ok"))


@query("val_5_hex64", f"{REQ} SELECT request_id, coalesce(regexp_full_match(plaintext_sha256, '[0-9a-f]{{64}}'), false) AS ok FROM r")
def val_5(spark, sf_dir):
    return table(spark, sf_dir, "v_requests").select("request_id", C.hex64(F.col("plaintext_sha256")).alias("ok"))


@query("val_6_base64_length", f"{REQ} SELECT request_id, request_id % 3 <> 0 AS ok FROM r")
def val_6(spark, sf_dir):
    """Digests in base64, of which every third lost its last byte."""
    x = table(spark, sf_dir, "v_requests")
    whole = F.unhex("plaintext_sha256")
    sent = F.base64(F.when(F.col("request_id") % 3 == 0, F.substring(whole, 1, 31)).otherwise(whole))
    return x.select("request_id", C.base64_length(sent, 32).alias("ok"))


@query("val_7_mask_reason", f"WITH s AS ({duck('v_scan_log')}) SELECT event_id, coalesce(nullif(substring(regexp_replace(CASE WHEN reason = '' THEN '' ELSE reason || ' at ' || event_id END, '[^A-Za-z0-9_.-]', '?', 'g'), 1, 63), ''), 'none') AS masked FROM s")
def val_7(spark, sf_dir):
    text = F.when(F.col("reason") == "", "").otherwise(F.concat("reason", F.lit(" at "), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "v_scan_log").select("event_id", C.mask_reason(text).alias("masked"))


@query("snk_1_result_json", f"""WITH s AS ({duck('v_scan_log')}) SELECT event_id, '{{"verdict":"' || verdict || '"' || CASE WHEN reason <> '' THEN ',"reason":"' || reason || '"' ELSE '' END || ',"duration_ms":' || duration_ms || '}}' AS result FROM s""")
def snk_1(spark, sf_dir):
    from ..sources.files import result_json

    x = table(spark, sf_dir, "v_scan_log").withColumn("reason", F.nullif("reason", F.lit("")))
    return x.select("event_id", result_json("verdict", "reason", "duration_ms").alias("result"))


@query("snk_3_sanitized_path", f"{REQ} SELECT request_id, '/q/sanitized/' || split_part(file_path, '/', -1) || '.sanitized' AS path, CAST(NULL AS VARCHAR) AS reason FROM r")
def snk_3(spark, sf_dir):
    path, reason = C.sanitized_path(F.col("file_path"), "/q/")
    return table(spark, sf_dir, "v_requests").select("request_id", path.alias("path"), reason.alias("reason"))


def used(spark, sf_dir):
    """The registry's rows with the number of files that have the extension."""
    n = detected(spark, sf_dir).groupBy("ext").agg(F.count(F.lit(1)).alias("files"))
    return A.validate_registry(registry(spark)), n


COUNTED = f"{FILES}, {DETECTED}, n AS (SELECT ext, count(*) AS files FROM det GROUP BY ext)"


@query("reg_1_validate", f"{COUNTED}, {REG} SELECT reg.ext, type, coalesce(files, 0) AS files FROM reg LEFT JOIN n USING (ext)")
def reg_1(spark, sf_dir):
    reg, n = used(spark, sf_dir)
    return reg.join(n, "ext", "left").select("ext", "type", F.coalesce("files", F.lit(0)).alias("files"))


@query("reg_2_aliases", f"{COUNTED}, {REG}, {ALIAS} SELECT m AS mime, p.ext, coalesce(files, 0) AS files FROM (SELECT DISTINCT m, ext FROM (SELECT mime AS m, ext FROM reg UNION ALL SELECT alias, ext FROM reg JOIN al USING (mime))) p LEFT JOIN n USING (ext)")
def reg_2(spark, sf_dir):
    reg, n = used(spark, sf_dir)
    return A.expand_aliases(reg, aliases(spark)).join(n, "ext", "left").select("mime", "ext", F.coalesce("files", F.lit(0)).alias("files"))


@query("reg_3_zip_based", f"{COUNTED}, {REG} SELECT z.mime, reg.ext, coalesce(files, 0) AS files FROM reg CROSS JOIN (VALUES ('application/zip'), ('application/x-zip-compressed')) z(mime) LEFT JOIN n USING (ext) WHERE zip_based")
def reg_3(spark, sf_dir):
    reg, n = used(spark, sf_dir)
    return A.expand_zip_based(reg).join(n, "ext", "left").select("mime", "ext", F.coalesce("files", F.lit(0)).alias("files"))


@query("reg_4_mime_to_exts", f"{FILES}, {PAIRS}, {DETECTED} SELECT p.mime, array_to_string(list_sort(list(DISTINCT p.ext)), ',') AS exts, (SELECT count(*) FROM det WHERE det.mime = p.mime) AS files FROM pairs p WHERE p.mime NOT IN {NEVER} GROUP BY p.mime")
def reg_4(spark, sf_dir):
    n = detected(spark, sf_dir).groupBy("mime").agg(F.count(F.lit(1)).alias("files"))
    return A.mime_to_exts(registry(spark), aliases(spark)).join(n, "mime", "left").select("mime", F.array_join("exts", ",").alias("exts"), F.coalesce("files", F.lit(0)).alias("files"))


@query(
    "reg_5_prefix_to_exts",
    f"""{FILES}, {REG}, {DETECTED} SELECT p AS prefix, coalesce((SELECT array_to_string(list_sort(list(ext)), ',') FROM reg WHERE type || '/' = p), '') AS exts,
  (SELECT count(*) FROM det WHERE split_part(mime, '/', 1) || '/' = p) AS files FROM (VALUES ('image/'), ('text/'), ('audio/'), ('video/'), ('font/'), ('model/')) v(p)""",
)
def reg_5(spark, sf_dir):
    n = detected(spark, sf_dir).groupBy(F.concat(F.substring_index("mime", "/", 1), F.lit("/")).alias("prefix")).agg(F.count(F.lit(1)).alias("files"))
    return A.prefix_to_exts(registry(spark)).join(n, "prefix", "left").select("prefix", F.array_join("exts", ",").alias("exts"), F.coalesce("files", F.lit(0)).alias("files"))


@query("reg_6_scan_classes", f"{COUNTED}, {REG}, c AS (SELECT 'opaque' AS class, ext FROM reg WHERE type IN ('certificate', 'database', 'font') OR list_contains(scan, 'opaque') UNION ALL SELECT 'archive', ext FROM reg WHERE list_contains(scan, 'archive')) SELECT class, c.ext, coalesce(files, 0) AS files FROM c LEFT JOIN n USING (ext)")
def reg_6(spark, sf_dir):
    reg, n = used(spark, sf_dir)
    return A.scan_class_exts(reg).join(n, "ext", "left").select("class", "ext", F.coalesce("files", F.lit(0)).alias("files"))


@query("typ_1_extension", f"{FILES}, {DETECTED} SELECT file_id, ext FROM det")
def typ_1(spark, sf_dir):
    return detected(spark, sf_dir).select("file_id", "ext")


@query(
    "typ_2_sniff",
    f"""{FILES} SELECT file_id, CASE WHEN content = '' THEN 'application/x-empty' WHEN content LIKE 'GIF87a%' OR content LIKE 'GIF89a%' THEN 'image/gif' WHEN substring(content, 9, 4) = 'WEBP' THEN 'image/webp'
  WHEN substring(content, 258, 5) = 'ustar' THEN 'application/x-tar' WHEN content LIKE '%PDF-%' AND substring(content, 1, 5) = '%PDF-' THEN 'application/pdf' WHEN content LIKE 'BZh%' THEN 'application/x-bzip2'
  WHEN content LIKE 'BM%' THEN 'image/bmp' WHEN content LIKE 'G%' THEN 'video/mp2t' ELSE 'text/plain' END AS sniffed FROM f""",
)
def typ_2(spark, sf_dir):
    x = table(spark, sf_dir, "v_files").withColumn("head", F.col("content").cast("binary"))
    return A.sniff_type(x).select("file_id", "sniffed")


SVG = r"contains(lower({c}), 'http://www.w3.org/2000/svg') OR regexp_matches({c}, '<([A-Za-z0-9_-]+:)?[sS][vV][gG]([ \t\r\n>/]|$)')"


@query(
    "typ_3_reclassify",
    f"""{FILES}, {DETECTED}, a AS (SELECT file_id, content, ext, CASE WHEN file_id % 7 = 0 THEN 'video/mp2t' WHEN file_id % 7 = 1 THEN 'application/ogg' WHEN mime = 'text/xml' AND file_id % 2 = 0 THEN 'application/xml' ELSE mime END AS mime,
   CASE WHEN file_id % 7 = 0 THEN 'ts' WHEN file_id % 7 = 1 THEN CASE WHEN file_id % 2 = 0 THEN 'ogv' ELSE 'oga' END WHEN ext = 'mp4' THEN 'm4a' ELSE ext END AS e FROM det),
b AS (SELECT file_id, e, CASE WHEN file_id % 5 = 0 THEN concat('<svg>', content) ELSE content END AS content, mime FROM a),
c AS (SELECT file_id, content, CASE WHEN mime = 'video/mp2t' AND e = 'ts' AND substring(content, 1, 1) <> 'G' AND content <> '' THEN 'text/plain' WHEN mime = 'video/mp4' AND e = 'm4a' THEN 'audio/mp4'
  WHEN mime LIKE '%ogg%' AND e = 'oga' THEN 'audio/ogg' WHEN mime LIKE '%ogg%' AND e = 'ogv' THEN 'video/ogg' ELSE mime END AS m FROM b)
SELECT file_id, CASE WHEN m IN ('text/xml', 'application/xml') AND ({SVG.format(c='content')}) THEN 'image/svg+xml' ELSE m END AS mime FROM c""",
)
def typ_3(spark, sf_dir):
    """Files under types and extensions that meet every rewrite."""
    i = F.col("file_id")
    x = detected(spark, sf_dir)
    mime = F.when(i % 7 == 0, "video/mp2t").when(i % 7 == 1, "application/ogg").when((F.col("mime") == "text/xml") & (i % 2 == 0), "application/xml").otherwise(F.col("mime"))
    ext = F.when(i % 7 == 0, "ts").when(i % 7 == 1, F.when(i % 2 == 0, "ogv").otherwise("oga")).when(F.col("ext") == "mp4", "m4a").otherwise(F.col("ext"))
    head = F.when(i % 5 == 0, F.concat(F.lit("<svg>"), "content")).otherwise(F.col("content"))
    x = x.select("file_id", mime.alias("mime"), ext.alias("ext"), head.alias("head"))
    return x.select("file_id", C.reclassify(F.col("mime"), F.col("ext"), F.col("head")).alias("mime"))


@query("typ_4_looks_like_svg", f"SELECT page_id, {SVG.format(c='html')} AS svg FROM pages")
def typ_4(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.looks_like_svg(F.col("html")).alias("svg"))


@query("typ_5_admit", f"{ADMIT} SELECT file_id, allowed, matches_ext FROM adm")
def typ_5(spark, sf_dir):
    return admitted(spark, sf_dir).select("file_id", "allowed", "matches_ext")


@query("typ_6_admission_verdict", f"{ADMIT} SELECT file_id, CASE WHEN reason IS NOT NULL THEN 'rejected' END AS verdict, reason FROM ver")
def typ_6(spark, sf_dir):
    return admitted(spark, sf_dir).select("file_id", "verdict", "reason")


@query("typ_7_categorize", f"{FILES}, {REG}, {DETECTED} SELECT file_id, {CATEGORY} AS category FROM det")
def typ_7(spark, sf_dir):
    return A.categorize(detected(spark, sf_dir), A.scan_class_exts(registry(spark))).select("file_id", "category")


@query("typ_8_empty_file", f"{ADMIT} SELECT file_id, CASE WHEN content = '' THEN 'clean' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'undecided' END AS verdict, CASE WHEN content = '' THEN 'empty_file' ELSE reason END AS reason, CASE WHEN content = '' THEN 'application/x-empty' ELSE mime END AS mime FROM ver")
def typ_8(spark, sf_dir):
    empty = F.octet_length("content") == 0
    x = admitted(spark, sf_dir)
    return x.select(
        "file_id", F.when(empty, "clean").otherwise(F.coalesce("verdict", F.lit("undecided"))).alias("verdict"), F.when(empty, "empty_file").otherwise(F.col("reason")).alias("reason"),
        F.when(empty, "application/x-empty").otherwise(F.col("mime")).alias("mime"),
    )


@query("typ_admission_report", f"{ADMIT} SELECT {CATEGORY} AS category, coalesce(reason, 'admitted') AS reason, count(*) AS files, sum(strlen(content))::BIGINT AS bytes FROM ver GROUP BY ALL")
def typ_admission_report(spark, sf_dir):
    x = admitted(spark, sf_dir)
    return x.groupBy("category", F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
