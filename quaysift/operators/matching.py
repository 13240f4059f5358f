"""Content rules, digests, scanner replies and their verdicts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lookups
from ..sources.files import valid_rules

Rule = tuple[int, str, str, str]


def _occurs(content: Column, rule: Rule) -> Column:
    _, _, kind, pattern = rule
    if kind == "literal":
        return content.contains(pattern)
    if kind == "regex":
        return content.rlike(pattern)
    return content.contains(F.lit(bytes.fromhex(pattern)).cast("string"))  # byte by byte, within characters too


def match_rules(files: DataFrame, rules: list[Rule], key: str = "file_id", content: str = "content") -> DataFrame:
    """``key, ordinal, rule_id`` for every rule that occurs in a row's text: literal, regular expression, or bytes in hex.

    The rules are a literal array of conditions, so a text is read once and only hits are exploded; rules that are
    invalid (see ``valid_rules``) are skipped. Null texts match nothing.
    """
    rules = valid_rules(rules)[0]
    if not rules:
        return files.select(key).limit(0).select(key, F.lit(0).alias("ordinal"), F.lit("").alias("rule_id"))
    c = F.col(content)
    hits = F.array_compact(F.array(*(F.when(_occurs(c, r), F.struct(F.lit(r[0]).alias("ordinal"), F.lit(r[1]).alias("rule_id"))) for r in rules)))
    return files.select(key, F.explode(hits).alias("hit")).select(key, "hit.ordinal", "hit.rule_id")


def first_rule(content: Column, rules: list[Rule]) -> Column:
    """The first valid rule in order that occurs, or null: ``first_match`` as a column, for streams."""
    return F.coalesce(*(F.when(_occurs(content, r), F.lit(r[1])) for r in sorted(valid_rules(rules)[0])), F.lit(None).cast("string"))


def first_match(matches: DataFrame, key: str = "file_id") -> DataFrame:
    """One rule a row, the first in order, and how many matched."""
    return matches.groupBy(key).agg(F.min_by("rule_id", "ordinal").alias("rule_id"), F.count(F.lit(1)).alias("n_rules"))


def match_digests(files: DataFrame, blocklist: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``signature``: the name that ``blocklist(digest, signature)`` gives the content's SHA-256, or null. The list is joined as Spark sees fit."""
    one = blocklist.groupBy("digest").agg(F.min("signature").alias("signature"))
    return files.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256)).join(one, "digest", "left")


#: Digests of a list that is broadcast as it is; bits of a filter for each digest of a longer one, and most bits of a filter.
BROADCAST_DIGESTS, BITS_EACH, MOST_BITS = 100_000, 16, 1 << 29
_BUCKET = 1 << 15  # bits of a filter's row


def _bit(digest: Column, bits: int) -> Column:
    """Where a filter has a digest's bit: its first 60 bits, modulo."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % bits


def digest_filter(blocklist: DataFrame, bits: int) -> DataFrame:
    """``_bucket, _bits``: which bits of ``blocklist(digest, ..)`` are set, 4 KB a row; at most ``bits / 8`` bytes in all."""
    at = blocklist.select(_bit(F.col("digest"), bits).alias("at"))
    return at.groupBy(F.floor(F.col("at") / _BUCKET).alias("_bucket")).agg(F.expr(f"bitmap_construct_agg(at % {_BUCKET})").alias("_bits"))


def digest_hits(files: DataFrame, blocklist: DataFrame, key: str = "file_id", content: str = "content", few: int = BROADCAST_DIGESTS) -> DataFrame:
    """``key, digest, signature`` of all rows, as ``match_digests`` tells them, for a list ``digest, signature`` of any size; content stays where it is.

    Up to ``few`` digests are broadcast. A longer list becomes a filter of one bit in ``BITS_EACH`` (broadcast, 64 MB at most): files that it rules out go
    straight through, and only the others, the list's own and some six in a hundred more, are shuffled to be joined, by key and digest alone. Null content has no digest and no signature.
    """
    digests = files.select(F.col(key).alias("_key"), F.lower(F.sha2(F.col(content).cast("binary"), 256)).alias("digest"))
    one = blocklist.filter(F.col("digest").isNotNull()).groupBy(F.lower("digest").alias("digest")).agg(F.min("signature").alias("signature"))
    n = one.count()
    if n <= few:
        found = digests.join(F.broadcast(one), "digest", "left")
    else:
        bits = min(MOST_BITS, max(_BUCKET, 1 << (n * BITS_EACH - 1).bit_length()))
        at = digests.withColumn("_at", _bit(F.col("digest"), bits))
        tried = at.join(F.broadcast(digest_filter(one, bits)), F.floor(F.col("_at") / _BUCKET) == F.col("_bucket"), "left")
        byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") % _BUCKET / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        may = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
        tried = tried.select("_key", "digest", may.alias("_may"))
        passed = tried.filter(~F.col("_may")).select("_key", "digest", F.lit(None).cast("string").alias("signature"))
        found = tried.filter("_may").drop("_may").join(one.hint("shuffle_hash"), "digest", "left").select("_key", "digest", "signature").unionByName(passed)
    return found.select(F.col("_key").alias(key), "digest", "signature")


def parse_av_reply(line: Column) -> Column:
    """``struct(verdict, signature)`` of a scanner's reply line."""
    found = line.contains(" FOUND")
    colon, end = F.instr(line, ":"), F.instr(line, " FOUND")
    name = F.regexp_replace(line.substr(colon + 1, F.greatest(end - colon - 1, F.lit(0))), "^ +", "")
    verdict = F.when(F.coalesce(line, F.lit("")) == "", "error").when(found, "infected").when(line.contains(" OK"), "clean").when(line.contains("size limit exceeded"), "too_large").otherwise("error")
    return F.struct(verdict.alias("verdict"), F.when(found & (colon > 0) & (colon < end), name).alias("signature"))


def match_verdict(stream: Column, refused: Column, retry: Column, rules: Column) -> Column:
    """``struct(reason, av_unavailable, rules_unavailable)``: an infected stream first, then admission, the scanner's retry, and rules.

    ``refused`` is admission's reason. Scanners that can't tell reject, rule engines that can't tell pass.
    """
    av = F.when(stream.isin("clean"), F.lit(None).cast("string")).otherwise(
        F.when(retry == "infected", "virus_detected").when(retry == "too_large", "av_too_large").when(retry.isin("unavailable", "error") | retry.isNull(), "av_unavailable")
    )
    reason = F.when(stream == "infected", "virus_detected").otherwise(F.coalesce(refused, av, F.when(rules == "match", "yara_match").when(rules == "timeout", "yara_timeout")))
    asked = (stream != "infected") & refused.isNull()
    return F.struct(
        reason.alias("reason"),
        (asked & F.coalesce(av.isin("av_too_large", "av_unavailable"), F.lit(False))).alias("av_unavailable"),
        (asked & av.isNull() & F.coalesce(rules.isin("timeout", "unavailable"), F.lit(False))).alias("rules_unavailable"),
    )


def size_cap_by_chunk(chunks: DataFrame, cap: int = lookups.STREAM_CAP, size: str = "bytes") -> DataFrame:
    """``file_id, scanned, oversize``: bytes before the chunk that would pass the cap, and whether one did."""
    w = W.partitionBy("file_id").orderBy("chunk_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = chunks.withColumn("_sum", F.sum(size).over(w))
    return run.groupBy("file_id").agg(F.coalesce(F.max(F.when(F.col("_sum") <= cap, F.col("_sum"))), F.lit(0)).alias("scanned"), F.max(F.col("_sum") > cap).alias("oversize"))


def prefilter(content: Column, rules: list[Rule]) -> Column:
    """Whether any literal or regular-expression rule can occur: one alternation for all."""
    parts = [re.escape(p) if kind == "literal" else f"(?:{p})" for _, _, kind, p in rules if kind != "hex"]
    others = [_occurs(content, r) for r in rules if r[2] == "hex"]
    return reduce(lambda a, b: a | b, [*([content.rlike("|".join(parts))] if parts else []), *others], F.lit(False))
