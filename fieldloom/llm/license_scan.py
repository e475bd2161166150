"""Licence scan by canonical digests: texts and lines are normalised in the JVM and hash-joined to known digests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.license_texts import EQUIVALENT, KNOWN, OWN_STATEMENTS, TITLES, WHOLE

SYMBOLS = r"[^\p{L}\p{N}]+"
SPELLINGS = r"(^| )(" + "|".join(a for a, _ in EQUIVALENT) + ")( |$)"


def _spelled(words: str) -> str:
    """Pattern of words (lower case) with any symbols or line breaks between them."""
    return SYMBOLS.join(re.findall(r"[^\W_]+", words.lower())).replace("license", "licen[cs]e")


#: First words of the known texts: where one begins, a copyright holder's name has ended.
OPENINGS = "|".join(sorted({_spelled(" ".join(re.findall(r"[^\W_]+", text)[:4])) for name, text in [*KNOWN, *WHOLE] if name[:10] != "LicenseRef"}))
YEAR = r"[^\p{L}\p{N}\n]*(?:(?:19|20)\d\d(?!\d)|yyyy(?!\p{L})|years?[>\]})])"
#: Word and sign, the sign, or word or (c) with a year: "copyright holders" and an item (c) state nothing.
STATED = rf"(?:copyright[\s:]*(?:\(c\)|©)|\(c\)[ \t]*copyright(?!\p{{L}})|©|(?:copyright|\(c\)){YEAR})"
#: Statements that belong to a whole licence's own text stay in it.
OWN = rf"(?![^\p{{L}}\p{{N}}]*(?:copyright{SYMBOLS})?(?:{'|'.join(map(_spelled, OWN_STATEMENTS))}))"
SENTENCE_END = r"(?<![^\p{L}](?:inc|ltd|co|corp|llc|jr|sr|dr|st|al|\p{L}))[.;!?][ \t]+"
RESERVED = r"(?:all rights reserved[^\p{L}\p{N}\n]*)?"
#: A copyright statement at the beginning of a line, or behind a title ($1): to the end of its line or sentence, or to
#: where a known text begins.
STATEMENT = (
    rf"(?m)^[^\p{{L}}\p{{N}}\n]*((?:(?:{'|'.join(map(_spelled, TITLES))})[^\p{{L}}\p{{N}}©]+?)?)\(?{OWN}{STATED}"
    rf"[^\n]*?(?:{SENTENCE_END}{RESERVED}|(?<![\p{{L}}\p{{N}}])(?=(?:{OPENINGS})(?![\p{{L}}\p{{N}}]))|$)"
)

#: Up to so many known digests (about 10 MB) are broadcast; a longer list is joined by a shuffle.
BROADCAST_KNOWN = 100_000


def canonical_lines(text: Column) -> Column:
    """Lines in lower case, symbols as single spaces, equivalent spellings made the same.

    Copyright statements (STATEMENT) and lines without letters or digits are left out; what follows a statement stays.
    """

    def plain(line: Column) -> Column:
        return F.trim(F.regexp_replace(line, SYMBOLS, " "))

    def same(line: Column) -> Column:
        out = F.concat(F.lit(" "), line, F.lit(" "))
        for spelling, equal in EQUIVALENT:
            for _ in range(2):  # neighbours share a blank
                out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {equal} "))
        return F.when(line.rlike(SPELLINGS), F.trim(out)).otherwise(line)

    low = F.lower(F.coalesce(text, F.lit("")))
    stated = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    lines = F.split(F.when(stated, F.regexp_replace(low, STATEMENT, "$1")).otherwise(low), "\n", -1)
    return F.transform(F.filter(F.transform(lines, plain), lambda x: x != ""), same)


def canonical_digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_digests(spark) -> DataFrame:
    """(license, digest) of the texts in ``license_texts``: one row a text."""
    known = spark.createDataFrame([*KNOWN, *WHOLE], "license string, text string")
    return known.select("license", canonical_digest(canonical_lines(F.col("text"))).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_digest, license, notices, n_notices of every row.

    ``license``: the known licence whose canonical text is the whole canonical text (smallest name if several), or
    null. ``notices``: the known licences of single lines that are a known text by themselves, distinct, sorted, joined
    by commas; ``n_notices``: such lines. Null, empty and blank texts have the digest of the empty text and no match.
    Repeated rows and ids are scanned row by row; equal texts have equal notices, so notices are found once a text.
    Both are equi-joins on digests, with lists of known texts of any length.
    """
    names = known.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))
    if names.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN:
        names = F.broadcast(names)
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    key = F.sha2("body", 256).alias("key")
    texts = docs.select(F.col(doc_id).alias("doc_id"), body).select(
        "doc_id", key, canonical_digest(canonical_lines(F.col("body"))).alias("text_digest")
    )
    lines = docs.select(body).select(key, F.posexplode(F.transform(canonical_lines(F.col("body")), lambda x: F.sha2(x, 256))).alias("pos", "digest"))
    hits = lines.join(names, "digest").select("key", "pos", "license").distinct()
    found = hits.groupBy("key").agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"), F.countDistinct("pos").alias("n_notices")
    )
    whole = names.select(F.col("digest").alias("text_digest"), "license")
    return (
        texts.join(whole, "text_digest", "left")
        .join(found, "key", "left")
        .select("doc_id", "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
    )
