"""Queries on content rules, digests, markup and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lookups
from ..functions import checks as C
from ..operators import integrity as I
from ..operators import markup as K
from ..operators import matching as M
from ..operators import rules as R
from .q_admission import FILES
from .base import query
from .views import duck, table

HITS = f"""{FILES}, hits AS (SELECT file_id, 0 AS ordinal, 'has_und' AS rule_id FROM f WHERE contains(content, ' und ') UNION ALL SELECT file_id, 1, 'has_que' FROM f WHERE contains(content, ' que ')
 UNION ALL SELECT file_id, 2, 'the_pair' FROM f WHERE regexp_matches(content, 'the [a-z]+ the') UNION ALL SELECT file_id, 3, 'pour_hex' FROM f WHERE contains(content, ' pour ') UNION ALL SELECT file_id, 4, 'has_the' FROM f WHERE contains(content, ' the '))"""
CHUNKS = f"WITH c AS ({duck('v_chunks')})"
KEY = b"0123456789abcdef"
IPAD, OPAD = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
HMAC = f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode({{m}}))))"


def files(spark, sf_dir):
    return table(spark, sf_dir, "v_files")


def hits(spark, sf_dir):
    return M.match_rules(files(spark, sf_dir), lookups.RULES)


@query("src_4_valid_rules", f"{FILES} SELECT file_id, contains(content, ' und ') OR contains(content, ' que ') OR regexp_matches(content, 'the [a-z]+ the') OR contains(content, ' pour ') OR contains(content, ' the ') AS may_match FROM f")
def src_4(spark, sf_dir):
    """The alternation of all rules, beside a broken rule that is left out."""
    from ..sources.files import valid_rules

    rules, _ = valid_rules([*lookups.RULES, (9, "broken", "regex", "([")])
    return files(spark, sf_dir).select("file_id", M.prefilter(F.col("content"), rules).alias("may_match"))


@query("mat_1_match_rules", f"{HITS} SELECT file_id, ordinal, rule_id FROM hits")
def mat_1(spark, sf_dir):
    return hits(spark, sf_dir)


@query("mat_2_first_match", f"{HITS} SELECT file_id, arg_min(rule_id, ordinal) AS rule_id, count(*) AS n_rules FROM hits GROUP BY file_id")
def mat_2(spark, sf_dir):
    return M.first_match(hits(spark, sf_dir))


@query("mat_3_match_digests", f"{FILES}, bl AS (SELECT sha256(text) AS digest, 'sig' || min(doc_id) AS signature FROM documents WHERE doc_id % 50 = 0 GROUP BY 1) SELECT file_id, signature FROM f LEFT JOIN bl ON sha256(content) = digest")
def mat_3(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("i"))
    listed = listed.select("digest", F.concat(F.lit("sig"), F.col("i").cast("string")).alias("signature"))
    return M.digest_hits(files(spark, sf_dir), listed).select("file_id", "signature")


@query("mat_9_digest_filter", f"{FILES}, bl AS (SELECT sha256(text) AS digest, 'sig' || min(doc_id) AS signature FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT file_id, signature FROM f LEFT JOIN bl ON sha256(content) = digest")
def mat_9(spark, sf_dir):
    """A list of half of all digests, which is taken to be too long to broadcast: by way of the filter."""
    listed = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("i"))
    listed = listed.select("digest", F.concat(F.lit("sig"), F.col("i").cast("string")).alias("signature"))
    return M.digest_hits(files(spark, sf_dir), listed, few=0).select("file_id", "signature")


REPLY = "CASE event_id % 6 WHEN 0 THEN 'stream:  Sig.' || event_id || ' FOUND' WHEN 1 THEN 'stream: OK' WHEN 2 THEN 'INSTREAM size limit exceeded. ERROR' WHEN 3 THEN '' WHEN 4 THEN 'No colon FOUND' ELSE 'what' END"


@query("mat_4_parse_av_reply", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'infected' WHEN 1 THEN 'clean' WHEN 2 THEN 'too_large' WHEN 4 THEN 'infected' ELSE 'error' END AS verdict, CASE WHEN event_id % 6 = 0 THEN 'Sig.' || event_id END AS signature FROM events")
def mat_4(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", F.expr(REPLY).alias("line"))
    return x.select("event_id", M.parse_av_reply(F.col("line")).alias("r")).select("event_id", "r.*")


AV = "CASE event_id % {n} WHEN 0 THEN 'infected' WHEN 1 THEN 'too_large' WHEN 2 THEN 'unavailable' ELSE 'clean' END"
STATES = f"s AS (SELECT event_id, {AV.format(n=11)} AS stream, {AV.format(n=7)} AS retry, CASE WHEN event_id % 13 = 0 THEN 'disallowed_mime_type' END AS refused, CASE event_id % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'timeout' WHEN 2 THEN 'unavailable' ELSE 'none' END AS rules FROM events)"


@query(
    "mat_5_match_verdict",
    f"""WITH {STATES}, t AS (SELECT *, CASE WHEN stream = 'clean' THEN NULL WHEN retry = 'infected' THEN 'virus_detected' WHEN retry = 'too_large' THEN 'av_too_large' WHEN retry = 'unavailable' THEN 'av_unavailable' END AS av FROM s)
SELECT event_id, CASE WHEN stream = 'infected' THEN 'virus_detected' ELSE coalesce(refused, av, CASE rules WHEN 'match' THEN 'yara_match' WHEN 'timeout' THEN 'yara_timeout' END) END AS reason,
  stream <> 'infected' AND refused IS NULL AND coalesce(av IN ('av_too_large', 'av_unavailable'), false) AS av_unavailable,
  stream <> 'infected' AND refused IS NULL AND av IS NULL AND rules IN ('timeout', 'unavailable') AS rules_unavailable FROM t""",
)
def mat_5(spark, sf_dir):
    s = spark.sql(f"WITH {STATES.replace('FROM events', 'FROM {events}')} SELECT * FROM s", events=table(spark, sf_dir, "events"))
    v = M.match_verdict(F.col("stream"), F.col("refused"), F.col("retry"), F.col("rules"))
    return s.select("event_id", v.alias("v")).select("event_id", "v.*")


@query("mat_6_size_cap", f"{CHUNKS}, r AS (SELECT file_id, sum(strlen(chunk)) OVER (PARTITION BY file_id ORDER BY chunk_idx) AS n FROM c) SELECT file_id, coalesce(max(n) FILTER (WHERE n <= 5000), 0)::BIGINT AS scanned, bool_or(n > 5000) AS oversize FROM r GROUP BY file_id")
def mat_6(spark, sf_dir):
    x = table(spark, sf_dir, "v_chunks").withColumn("bytes", F.octet_length("chunk").cast("long"))
    return M.size_cap_by_chunk(x, 5000)


@query("mat_7_scan_chunks", f"{HITS} SELECT file_id, ordinal, rule_id FROM hits")
def mat_7(spark, sf_dir):
    """All kinds of rules over texts in chunks of 1000 characters, across their edges."""
    return R.scan_chunks(table(spark, sf_dir, "v_chunks"), lookups.RULES)


PHRASES = """WITH b AS (SELECT item_id, (row_number() OVER (ORDER BY item_id, text) - 1)::INT AS ordinal, text AS t FROM benchmark WHERE length(text) >= 60),
p AS (SELECT ordinal, 'item_' || item_id AS rule_id, ordinal % 3 AS k, CASE WHEN ordinal % 3 = 1 THEN substring(t, 5, 12) ELSE substring(t, 5, 40) END AS lit FROM b)"""


@query("mat_8_many_rules", f"""{PHRASES} SELECT doc_id AS file_id, ordinal, rule_id FROM documents JOIN p ON CASE WHEN k = 1 THEN regexp_matches(text, replace(replace(regexp_replace(lit, '[^a-zA-Z0-9 ]', '.', 'g'), ' ', ' +'), '.', '[^\n]'))
  ELSE contains(text, lit) END""")
def mat_8(spark, sf_dir):
    """Documents by rules from a table: a phrase of each benchmark item, as it is, in hex, or as an expression that lets spaces repeat."""
    t, n = F.col("text"), F.col("ordinal") % 3
    items = table(spark, sf_dir, "benchmark").filter(F.length("text") >= 60)
    items = items.withColumn("ordinal", F.row_number().over(Window.orderBy("item_id", "text")) - 1)  # rules are few
    loose = F.replace(F.replace(F.regexp_replace(F.substring("text", 5, 12), "[^a-zA-Z0-9 ]", "."), F.lit(" "), F.lit(" +")), F.lit("."), F.lit("[^\n]"))
    phrase = F.substring("text", 5, 40)
    rules = items.select("ordinal", F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("rule_id"), F.when(n == 1, "regex").when(n == 2, "hex").otherwise("literal").alias("kind"),
        F.when(n == 1, loose).when(n == 2, F.hex(phrase.cast("binary"))).otherwise(phrase).alias("pattern"))
    return R.match_many(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), t.alias("content")), rules)


MARKED = "SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN chr(65279) WHEN doc_id % 4 = 0 THEN chr(65279) || text ELSE text END AS t FROM documents"


@query("txt_1_strip_bom", f"WITH d AS ({MARKED}) SELECT doc_id, CASE WHEN starts_with(t, chr(65279)) THEN 'sanitized' ELSE 'clean' END AS verdict, CASE WHEN starts_with(t, chr(65279)) AND length(t) > 1 THEN 'bom_stripped' END AS reason, starts_with(t, chr(65279)) AS modified, sha256(CASE WHEN starts_with(t, chr(65279)) THEN substring(t, 2) ELSE t END) AS output_sha256 FROM d")
def txt_1(spark, sf_dir):
    """Documents, of which some begin with a byte order mark and some hold nothing else."""
    x = table(spark, sf_dir, "documents")
    mark = F.lit("﻿")
    t = F.when(F.col("doc_id") % 97 == 0, mark).when(F.col("doc_id") % 4 == 0, F.concat(mark, "text")).otherwise(F.col("text"))
    x = x.select("doc_id", C.strip_bom(t.cast("binary")).alias("r"))
    return x.select("doc_id", "r.verdict", "r.reason", "r.modified", F.sha2("r.output", 256).alias("output_sha256"))


TAGS = r"""t AS (SELECT page_id, unnest(regexp_extract_all(html, '{tag}')) AS tag, unnest(range(0, len(regexp_extract_all(html, '{tag}')))) AS ord FROM pages),
el AS (SELECT page_id, ord, regexp_extract(tag, '{tag}', 1) AS name, regexp_extract(tag, '{tag}', 2) AS attributes FROM t),
e AS (SELECT *, lower(split_part(name, ':', -1)) AS local FROM el)""".format(tag=K.TAG.replace("'", "''"))
ALLOWED = "(" + ", ".join(f"'{x}'" for x in lookups.ELEMENTS) + ")"
ALLOWED_AT = "(" + ", ".join(f"'{x}'" for x in lookups.ATTRIBUTES) + ")"
ATTRS = r"""a AS (SELECT page_id, ord, local, unnest(regexp_extract_all(attributes, '{at}', 0)) AS m FROM e),
att AS (SELECT page_id, ord, local, lower(regexp_extract(m, '{at}', 1)) AS name, regexp_extract(m, '{at}', 2) || regexp_extract(m, '{at}', 3) AS value FROM a)""".format(at=K.ATTRIBUTE.replace("'", "''"))


def elements(spark, sf_dir):
    return K.markup_elements(table(spark, sf_dir, "pages"))


@query("mrk_1_elements", f"WITH {TAGS} SELECT page_id, ord::INT AS ord, name, local, local IN {ALLOWED} AS allowed FROM e")
def mrk_1(spark, sf_dir):
    return elements(spark, sf_dir).drop("attributes")


@query("mrk_2_attributes", f"WITH {TAGS}, {ATTRS} SELECT page_id, ord::INT AS ord, local, name, value FROM att")
def mrk_2(spark, sf_dir):
    return K.markup_attributes(elements(spark, sf_dir))


@query(
    "mrk_3_attribute_policy",
    f"""WITH {TAGS}, {ATTRS} SELECT page_id, ord::INT AS ord, name, CASE WHEN name LIKE 'on%' THEN 'event_handler' WHEN name NOT IN {ALLOWED_AT} THEN 'not_allowed' WHEN name IN ('href', 'xlink:href') THEN
  CASE WHEN value = '' THEN 'href_empty' WHEN lower(value) LIKE 'javascript:%' THEN 'href_javascript' WHEN lower(value) LIKE 'data:%' THEN 'href_data' WHEN local IN ('image', 'use') AND value NOT LIKE '#%' THEN 'href_not_fragment'
  WHEN NOT (value LIKE '#%' OR lower(value) LIKE 'http://%' OR lower(value) LIKE 'https://%') THEN 'href_scheme' END
  WHEN name = 'style' AND (contains(lower(value), 'expression(') OR contains(lower(value), 'javascript:') OR contains(lower(value), '@import') OR contains(lower(value), 'behavior:') OR contains(lower(value), 'behaviour:')) THEN 'style_unsafe' END AS dropped FROM att""",
)
def mrk_3(spark, sf_dir):
    x = K.markup_attributes(elements(spark, sf_dir))
    return x.select("page_id", "ord", "name", K.attribute_policy(F.col("local"), F.col("name"), F.col("value")).alias("dropped"))


@query("mrk_4_sanitize_markup")
def mrk_4(spark, sf_dir):
    """Pages rebuilt with the text elements that pages use."""
    return K.sanitize_markup(table(spark, sf_dir, "pages"), "page_id", "html", xml=False, elements=["html", "body", "head", "title", "p", "a", "div", "span", "h1", "h2", "ul", "li", "table", "tr", "td"], root=None)


@query("mrk_5_escape_markup", "SELECT doc_id, sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text_sha256, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS attribute_sha256 FROM documents")
def mrk_5(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(C.escape_markup(t), 256).alias("text_sha256"), F.sha2(C.escape_markup(t, True), 256).alias("attribute_sha256"))


@query("mrk_6_markup_guards", "SELECT page_id, CASE WHEN html = '' THEN 'svg_empty' WHEN contains(lower(substring(html, 1, 256)), '<!doctype') THEN 'svg_doctype_rejected' END AS reason, strlen(html || html) > greatest(4 * strlen(html), 1048576) AS too_large FROM pages")
def mrk_6(spark, sf_dir):
    html = F.col("html")
    reason = F.when(html == "", "svg_empty").when(K.doctype_rejected(html), "svg_doctype_rejected")
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"), K.output_too_large(html, F.concat(html, html)).alias("too_large"))


BYTES = "(SELECT file_id, content AS t, strlen(content) AS n FROM f)"


@query("int_1_split_chunks", f"{FILES} SELECT file_id, i::INT AS chunk_idx, least(1000, greatest(n - i * 1000, 0))::INT AS size FROM (SELECT file_id, n, unnest(range(0, greatest(CAST(ceil(n / 1000.0) AS BIGINT), 1))) AS i FROM {BYTES})")
def int_1(spark, sf_dir):
    return I.split_chunks(files(spark, sf_dir), size=1000).select("file_id", "chunk_idx", F.octet_length("chunk").alias("size"))


def _keys(x):
    """A key and a base for each file, from its number."""
    d = F.sha2(F.concat(F.lit("key"), F.col("file_id").cast("string")), 256)
    return x.select("file_id", F.unhex(d).alias("key"), F.unhex(F.substring(F.sha2(d, 256), 1, 16)).alias("base"))


@query("int_2_seal_chunks", f"{FILES} SELECT file_id, i::INT AS chunk_idx, (least(1000, greatest(n - i * 1000, 0)) + 28)::INT AS size FROM (SELECT file_id, n, unnest(range(0, greatest(CAST(ceil(n / 1000.0) AS BIGINT), 1))) AS i FROM {BYTES})")
def int_2(spark, sf_dir):
    f = files(spark, sf_dir)
    return I.seal_chunks(I.split_chunks(f, size=1000), _keys(f)).select("file_id", "chunk_idx", F.octet_length("sealed").alias("size"))


@query("int_3_unseal_chunks", f"{FILES} SELECT file_id, file_id % 10 <> 0 AS opened FROM f")
def int_3(spark, sf_dir):
    """Sealed and opened again; every tenth file's chunks have another number than they were sealed under."""
    f = files(spark, sf_dir)
    sealed = I.seal_chunks(I.split_chunks(f, size=1000), _keys(f))
    sealed = sealed.withColumn("chunk_idx", F.when(F.col("file_id") % 10 == 0, F.col("chunk_idx") + 1).otherwise(F.col("chunk_idx")))
    return I.unseal_chunks(sealed, _keys(f)).groupBy("file_id").agg(F.bool_and(F.col("chunk").isNotNull()).alias("opened"))


@query("int_4_reassemble", f"{FILES} SELECT file_id, CASE WHEN file_id % 7 <> 0 THEN sha256(content) END AS content_sha256, CASE WHEN file_id % 7 = 0 THEN 'decryption_failed' END AS reason FROM f")
def int_4(spark, sf_dir):
    """Chunks digested in order; every seventh file's declared digest is wrong."""
    f = files(spark, sf_dir)
    chunks = I.split_chunks(f, size=1000)
    n = F.greatest(F.ceil(F.octet_length("content") / 1000), F.lit(1))
    declared = f.select("file_id", n.alias("chunks"), F.when(F.col("file_id") % 7 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return I.verify_chunks(chunks, declared).withColumnRenamed("sha256", "content_sha256")


@query("int_5_frame_digest", f"""{CHUNKS}, x AS (SELECT file_id, string_agg(lpad(hex(strlen(chunk)), 8, '0') || hex(encode(chunk)), '' ORDER BY chunk_idx) AS h FROM c GROUP BY file_id) SELECT file_id, sha256(unhex(h)) AS digest FROM x""")
def int_5(spark, sf_dir):
    return I.frame_digest(table(spark, sf_dir, "v_chunks"))


CANON = "'[' || version || ',\"' || 'n' || request_id || '\",' || chunk_size || ',' || chunks || ',\"' || plaintext_sha256 || '\",' || plaintext_size || ']'"


def canonical(spark, sf_dir):
    x = table(spark, sf_dir, "v_requests")
    c = C.metadata_canonical(F.col("version"), F.concat(F.lit("n"), F.col("request_id").cast("string")), F.col("chunk_size"), F.col("chunks"), F.col("plaintext_sha256"), F.col("plaintext_size"))
    return x.select("request_id", c.alias("canonical"))


@query("int_6_metadata_canonical", f"WITH r AS ({duck('v_requests')}) SELECT request_id, {CANON} AS canonical FROM r")
def int_6(spark, sf_dir):
    return canonical(spark, sf_dir)


@query("int_7_metadata_mac", f"WITH r AS ({duck('v_requests')}) SELECT request_id, {HMAC.format(m=CANON)} AS mac, true AS same FROM r")
def int_7(spark, sf_dir):
    """The code under a key for all, which the form with a key for each row must give as well."""
    x = canonical(spark, sf_dir)
    one, each = C.hmac_sha256(F.col("canonical"), KEY), C.hmac_by_row(F.col("canonical"), F.lit(KEY))
    return x.select("request_id", one.alias("mac"), (one == each).alias("same"))
