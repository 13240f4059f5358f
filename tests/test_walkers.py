"""Walkers and their policies on files built byte by byte."""

import io
import struct
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from quaysift.operators import archive as R
from quaysift.operators import image as G
from quaysift.operators import markup as K
from quaysift.operators import walkers as X
from quaysift.plans import q_bytes


def png(*chunks, tail=b""):
    out = b"\x89PNG\r\n\x1a\n"
    for kind, body in (("IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)), *chunks, ("IEND", b"")):
        out += struct.pack(">I", len(body)) + kind.encode() + body + struct.pack(">I", zlib.crc32(kind.encode() + body))
    return out + tail


def webp(*chunks, off=0, tail=b""):
    body = b"WEBP" + b"".join(k.encode() + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + off) + body + tail


def gif(frames, loop=True, tail=b"\x3b"):
    out = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x80, 0, 0) + bytes(6)
    if loop:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    return out + (b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + b"\x02\x02\x4c\x01\0") * frames + tail


def files(spark, **bodies):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()], "file_id string, content binary")


def by_id(df, column):
    return {r["file_id"]: r[column] for r in df.collect()}


def zipped(*entries, how=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


def test_png(spark):
    control = lambda n: ("acTL", struct.pack(">II", n, 0))
    f = files(
        spark, moving=png(control(4), ("IDAT", b"x")), still=png(("IDAT", b"x")), inside=png(("tEXt", b"acTL" + bytes(8)), ("IDAT", b"x")), late=png(("IDAT", b"x"), control(4)),
        one=png(control(1), ("IDAT", b"x")), junk=png(control(4), ("IDAT", b"x"), tail=b"j" * 32),
    )
    c = X.image_chunks(f, "png").withColumn("offset", F.col("offset"))
    assert by_id(G.animation_flags(c), "animated") == {"moving": True, "still": False, "inside": False, "late": False, "one": False, "junk": True}
    assert by_id(G.trailing_data(c), "trailing") == {"moving": False, "still": False, "inside": False, "late": False, "one": False, "junk": True}
    d = f.select("file_id", G.image_dimensions(F.col("content"), F.lit("png")).alias("d")).select("d.*").distinct().collect()
    assert [tuple(r) for r in d] == [(True, 3, 2)]


def test_webp(spark):
    f = files(
        spark, moving=webp(("ANIM", b"123456"), ("ANMF", b"1"), ("ANMF", b"2")), still=webp(("VP8 ", b"x")), text=webp(("EXIF", b"ANIM")), alone=webp(("ANIM", b"123456")),
        junk=webp(("ANIM", b"123456"), ("ANMF", b"1"), tail=b"jj"), off=webp(("ANIM", b"123456"), ("ANMF", b"1"), off=-16),
    )
    c = X.image_chunks(f, "webp")
    assert by_id(G.webp_animated(c), "animated") == {"moving": True, "still": False, "text": False, "alone": False, "junk": True, "off": True}
    assert by_id(G.trailing_data(c, "RIFF"), "trailing") == {"moving": False, "still": False, "text": False, "alone": False, "junk": True, "off": True}
    # bytes within the RIFF size that are no whole chunk: the walk doesn't land on the end
    body = webp(("ANIM", b"123456"), ("ANMF", b"1"))
    for junk in (b"JUNK", b"JUNK\xff\0\0\0"):
        inside = b"RIFF" + struct.pack("<I", len(body) - 8 + len(junk)) + body[8:] + junk
        flags = G.image_flags(X.image_chunks(files(spark, inside=inside, whole=body)), F.lit("webp")).collect()
        assert {r["file_id"]: (r["animated"], r["trailing"]) for r in flags} == {"inside": (True, True), "whole": (True, False)}


def test_gif(spark):
    f = files(spark, three=gif(3), one=gif(1), bare=gif(1, loop=False), two=gif(2, loop=False), more=gif(2, tail=b"\x3bxx\x3b"), cut=gif(2)[:20], other=b"nothing")
    c = X.image_chunks(f, "gif")
    assert by_id(G.gif_animated(c), "animated") == {"three": True, "one": False, "bare": False, "two": True, "more": True, "cut": False} or "cut" not in by_id(G.gif_animated(c), "animated")
    assert by_id(G.trailing_data(c, "trailer"), "trailing")["more"] is True
    assert by_id(G.trailing_data(c, "trailer"), "trailing")["three"] is False
    assert "other" not in by_id(G.gif_animated(c), "animated")


def test_jpeg(spark):
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 7, 9, 0)
    f = files(spark, a=b"\xff\xd8\xff\xe0\x00\x04ab" + sof, huffman=b"\xff\xd8\xff\xc4\x00\x04ab" + sof, cut=b"\xff\xd8\xff\xe0\x00", none=b"")
    got = lambda f: {r["file_id"]: (r["ok"], r["width"], r["height"]) for r in X.jpeg_dimensions(f).collect()}
    assert got(f) == {"a": (True, 9, 7), "huffman": (True, 9, 7), "cut": (False, None, None), "none": (False, None, None)}
    # markers that stand alone and fill bytes are passed over; a frame must fit; anything but a marker ends the walk
    f = files(spark, start=b"\xff\xd8\xff\xd8" + sof, restart=b"\xff\xd8\xff\xd0" + sof, fill=b"\xff\xd8\xff\xff\xff" + sof, end=b"\xff\xd8\xff\xd9" + sof, short=b"\xff\xd8" + sof[:-1], stray=b"\xff\xd8a" + sof, empty=b"\xff\xd8\xff\xc0\0\x06" + bytes(9))
    assert {k: v[0] for k, v in got(f).items()} == {"start": True, "restart": True, "fill": True, "end": True, "short": False, "stray": False, "empty": False}


def test_jpeg_whole_text():
    """A document of any length stands in the comments whole."""
    for body in (b"", b"ab", b"a" * 1001, bytes(range(256)) * 800):
        made, rows = q_bytes._jpeg(7, body), list(X.jpeg_walk(q_bytes._jpeg(7, body)))
        at, found = 7, b""
        for _, marker, length, *_ in rows[:-1]:
            assert marker == 0xFE
            found += made[at + 4 : at + 2 + length]
            at += 2 + length
        assert found == body and len(rows) == max(1, -(-len(body) // 65_533)) + 1 and rows[-1][3:] == (7, len(body) % 60_000, "frame")


def test_zip(spark):
    whole = zipped(("a.txt", b"x" * 100), ("b/c.txt", b"y" * 5000))
    local = bytearray(whole)
    local[0:4] = b"XXXX"
    corrupt = bytearray(whole)
    corrupt[40:44] = b"\xff\xff\xff\xff"
    declared = bytearray(whole)
    at = declared.find(b"PK\x01\x02")
    declared[at + 24 : at + 28] = struct.pack("<I", 99)
    stored = bytearray(zipped(("s.txt", b"abc"), how=zipfile.ZIP_STORED))
    at = stored.find(b"PK\x01\x02")
    stored[at + 24 : at + 28] = struct.pack("<I", 4)
    count = bytearray(whole)
    at = count.rfind(b"PK\x05\x06")
    count[at + 10 : at + 12] = struct.pack("<H", 3)
    e = X.zip_entries(files(spark, whole=whole, local=bytes(local), corrupt=bytes(corrupt), declared=bytes(declared), stored=bytes(stored), count=bytes(count), none=b"no archive at all, but long enough", small=b"PK"))
    reason = R.entry_size_reason(F.col("status"), F.col("method"), F.col("comp_size"), F.col("uncomp_size"), F.col("actual_size"))
    first = by_id(e.filter("entry_idx = 0").withColumn("r", reason), "r")
    assert first["whole"] is None and first["local"] == "zip_local_header_invalid" and first["declared"] == "archive_size_mismatch" and first["stored"] == "archive_size_mismatch"
    assert first["corrupt"] == "zip_entry_corrupt"
    shape = by_id(e.filter("entry_idx = 0").withColumn("r", R.structure_reason(F.col("size"), F.col("eocd"), F.col("cd_end"), F.col("listed"), F.col("declared"))), "r")
    assert shape["whole"] is None and shape["none"] == "zip_no_eocd" and shape["small"] == "zip_too_small" and shape["count"] == "zip_cd_malformed"


def test_names(spark):
    deep = "/".join("abcdefghij")
    names = {"../x": "archive_path_traversal", "/x": "archive_path_traversal", "a\0b": "archive_entry_null_byte", "x.TAR.gz": "archive_nested_archive", deep: "archive_depth_exceeded", "a/" * 8 + "x": None, "ok/..": None, "": None}
    got = spark.createDataFrame([(k,) for k in names], "path string").select("path", R.entry_path_reason(F.col("path")).alias("r")).collect()
    assert {r["path"]: r["r"] for r in got} == names


def test_tar(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in (("a.txt", b"hello"), ("in.bin", b"\x1f\x8b\x08\x00more"), ("n" * 150, b"")):
            i = tarfile.TarInfo(name)
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))
    bad = bytearray(out.getvalue())
    bad[0] ^= 1
    e = X.tar_entries(files(spark, good=out.getvalue(), bad=bytes(bad)))
    rows = e.filter("file_id = 'good'").orderBy("entry_idx").withColumn("nested", R.nested_by_magic(F.col("head"))).collect()
    assert rows[0]["path"] == "a.txt" and rows[0]["checksum_ok"] and not rows[0]["nested"] and rows[1]["nested"]
    assert any(r["helper"] for r in rows[2:])
    assert [r["checksum_ok"] for r in e.filter("file_id = 'bad'").collect()] == [False]


def test_long_walks():
    """Many helper headers before an entry, and many segments before a frame header."""
    helper, entry = tarfile.TarInfo("h"), tarfile.TarInfo("../x")
    helper.type = b"x"
    rows = list(X.whole(X.tar_walk)(helper.tobuf(tarfile.USTAR_FORMAT) * 9000 + entry.tobuf(tarfile.USTAR_FORMAT)))
    assert len(rows) == 9001 and rows[-1][1] == "../x" and not rows[-1][5] and all(r[4] for r in rows)
    negative = bytearray(helper.tobuf(tarfile.USTAR_FORMAT))
    negative[124:136], negative[148:156] = b"-0000001000\0", b" " * 8
    negative[148:156] = b"%06o\0 " % sum(negative)
    assert [r[2] for r in X.whole(X.tar_walk)(bytes(negative))] == [0]
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 7, 9, 0)
    assert list(X.jpeg_walk(b"\xff\xd8" + b"\xff\xfe\0\2" * 5000 + frame))[-1] == (5000, 0xC0, 8, 9, 7, "frame")


def test_markup(spark):
    svg = lambda inner, attrs="": f'<svg xmlns="http://www.w3.org/2000/svg"{attrs}>{inner}</svg>'.encode()
    cases = {
        "script": (svg("<script><g/></script><g/>"), "sanitized", None), "g": (b"<g/>", "rejected", "svg_root_not_svg"), "html": (b"<html/>", "rejected", "svg_no_root_element"), "bad": (b"<svg><g></svg>", "rejected", "svg_malformed"),
        "doctype": (b" " * 247 + b"<!DOCTYPE svg><svg/>", "rejected", "svg_doctype_rejected"), "later": (b"<svg>" + b" " * 300 + b"</svg>", "sanitized", None), "empty": (b"", "rejected", "svg_empty"),
        "links": (svg('<use href="http://a"/><image href="#b"/><path onclick="x" style="behavior:1" d="M0"/><svg:g xmlns:svg="x">a &lt; b</svg:g><!-- c -->'), "sanitized", None),
    }
    got = {r["file_id"]: r for r in K.sanitize_markup(files(spark, **{k: v[0] for k, v in cases.items()}), "file_id", "content").collect()}
    for k, (_, verdict, reason) in cases.items():
        assert (got[k]["verdict"], got[k]["reason"]) == (verdict, reason), k
    assert got["script"]["output"] == '<svg xmlns="http://www.w3.org/2000/svg"><g></g></svg>'
    assert '<use></use><image href="#b"></image><path d="M0"></path><g>a &lt; b</g>' in got["links"]["output"]


def test_hostile_headers(spark):
    """Sizes beyond a long, junk after digits, and helpers before a bad name are judged, not fatal."""
    def tar(*entries):
        out = b""
        for name, size, kind in entries:
            h = bytearray(512)
            h[: len(name)] = name
            h[124 : 124 + len(size)] = size
            h[156], h[257:262] = ord(kind), b"ustar"
            h[148:156] = b" " * 8
            h[148:156] = b"%06o\0 " % sum(h)
            out += bytes(h)
        return out + bytes(1024)

    huge = b"\x80" + b"\xff" * 11
    f = files(
        spark, huge=tar((b"a", huge, "0")), after=tar((b"a", b"00000000000\0", "0"), (b"b", huge, "0")), junk=tar((b"a", b"0000000000z\0", "0")), many=tar(*[(b"a", b"", "0")] * 2001),
        helpers=tar(*[(b"h", b"", "x")] * 9000, (b"../x", b"", "0")), good=tar((b"a", b"", "0")), none=b"",
    )
    got = {r["file_id"]: (r["reason"] or "").removeprefix("archive_policy:archive_") for r in R.tar_verdict(f).collect()}
    assert got == {"huge": "expansion_exceeded", "after": "expansion_exceeded", "junk": "", "many": "entries_exceeded", "helpers": "path_traversal", "good": "", "none": ""}
    z = {r["file_id"]: r["reason"] for r in R.zip_verdict(files(spark, none=b"", small=b"PK\x05\x06", good=zipped(("a", b"x")), cut=zipped(("a", b"x" * 50), ("b", b"y"))[:-30])).collect()}
    assert z == {"none": "archive_policy:zip_too_small", "small": "archive_policy:zip_too_small", "good": None, "cut": "archive_policy:zip_no_eocd"}


def test_rules_are_the_engines_own(spark, tmp_path):
    from quaysift.operators import matching as M
    from quaysift.sources import files as Q

    (tmp_path / "b.yar").write_text("regex\tpossessive\ta++b\nregex\tnamed\t(?P<x>a)\nliteral\tz\tzz\nliteral\ta\taa\n")
    got = Q.read_rules(spark, str(tmp_path))
    assert [r[1] for r in got[0]] == ["possessive", "z", "a"] and got[1] == 1
    docs = spark.createDataFrame([("f", "aab zz aa")], "file_id string, content string")
    assert [r["rule_id"] for r in M.first_match(M.match_rules(docs, got[0])).collect()] == ["possessive"]


def test_short_chunks(spark):
    """A literal over many chunks, empty ones among them."""
    from quaysift.operators import rules as M

    rows = [("f", i, c) for i, c in enumerate(["x", "a", "", None, "b", "c", "d", "e"])] + [("g", 0, "abcd"), ("h", 0, "ab")]
    got = M.scan_chunks(spark.createDataFrame(rows, "file_id string, chunk_idx int, chunk string"), [(0, "all", "literal", "abcde"), (1, "some", "literal", "bcd")])
    assert {(r["file_id"], r["rule_id"]) for r in got.collect()} == {("f", "all"), ("f", "some"), ("g", "some")}


def test_converter_outcomes(spark):
    from quaysift.operators import media as D

    rows = [("a", "pdf", 0, False, False, True, None), ("b", "pdf", 0, True, False, False, 0), ("c", "audio", 0, False, True, False, None), ("c", "audio", 1, True, False, False, 5), ("d", "video", 0, True, False, False, 0), ("d", "video", 1, True, False, False, 9)]
    df = spark.createDataFrame(rows, "file_id string, category string, attempt_idx int, ok boolean, timed_out boolean, not_started boolean, out_bytes long")
    got = {r["file_id"]: (r["verdict"], r["reason"]) for r in D.resolve_attempts(df).collect()}
    assert got == {"a": ("error", "fork_failed"), "b": ("error", "ghostscript_empty_output"), "c": ("sanitized", None), "d": ("error", "ffmpeg_empty_output")}


def test_image_verdict(spark):
    bmp = lambda dib, w, h: b"BM" + bytes(12) + struct.pack("<Iii", dib, w, h)
    cases = {  # mime, ext, bytes, verdict, reason
        "bmp": ("image/bmp", "", bmp(40, 20_000, -3), "rejected", "image_dimensions_exceeded"), "tall": ("image/bmp", "", bmp(40, 3, -20_000), "rejected", "image_dimensions_exceeded"), "odd_bmp": ("image/bmp", "", b"??", "sanitized", None),
        "old_bmp": (None, "bmp", b"BM" + bytes(12) + struct.pack("<IHH", 12, 20_000, 3), "rejected", "image_dimensions_exceeded"), "odd_png": (None, "PNG", b"GIF89a" + bytes(30), "rejected", "image_header_malformed"),
        "gif_as_webp": ("image/webp", "gif", gif(3), "sanitized", None), "many": (None, "gif", gif(3), "clean", "gif_animated_passthrough"), "none": (None, None, None, "error", "unsupported_image_format"),
        "empty": ("image/jpeg", None, None, "rejected", "image_header_malformed"), "webp": ("IMAGE/WEBP", None, b"", "sanitized", None),
    }
    df = spark.createDataFrame([(k, v[0], v[1], v[2] and bytearray(v[2]), 1) for k, v in cases.items()], "file_id string, mime string, ext string, content binary, kind int")
    got = {r["file_id"]: (r["verdict"], r["reason"]) for r in G.image_verdict(df).collect()}
    assert got == {k: v[3:] for k, v in cases.items()}
    assert G.image_verdict(df.limit(0)).count() == 0


def test_zip_structure_order(spark):
    c = lambda *x: [F.lit(v) for v in x]
    reasons = spark.range(1).select(R.structure_reason(*c(100, True, 200, 3000, 3000)), R.structure_reason(*c(100, True, 200, 3, 3)), R.structure_reason(*c(100, True, 90, 2, 3))).first()
    assert tuple(reasons) == ("archive_entries_exceeded", "zip_cd_truncated", "zip_cd_malformed")


def test_markup_names_and_order(spark):
    cases = {
        "two": (b"<svg><x:y:rect/><x:rect/></svg>", "sanitized", None), "root": (b"<g><a></g>", "rejected", "svg_root_not_svg"), "cut": (b"<svg><g></svg>", "rejected", "svg_malformed"),
        "large": (b"<svg>" + b'"' * (1 << 19) + b"<text>" + b"&gt;" * (1 << 19) + b"</text></svg>", "sanitized", None), "below": (b"<x><svg/></x>", "rejected", "svg_no_root_element"),
    }
    got = {r["file_id"]: r for r in K.sanitize_markup(files(spark, **{k: v[0] for k, v in cases.items()}), "file_id", "content").collect()}
    assert {k: (r["verdict"], r["reason"]) for k, r in got.items()} == {k: v[1:] for k, v in cases.items()}
    assert got["two"]["output"] == "<svg><rect></rect></svg>"
    small = K._Rebuild({"svg"}, set(), "svg", 8)
    assert K._xml(b"<svg>abcdef<g></svg>", small) is False and small.error == "svg_output_too_large"
