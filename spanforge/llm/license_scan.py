"""Licence scan: whole texts and whole lines looked up by the digest of their canonical form."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.license_texts import DIGESTS, LICENSES

#: Spellings that count as equal, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"),
    ("optimisation", "optimization"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)
#: Words that follow "copyright" in the bodies of licences: lines that begin so are no copyright lines, however a text is wrapped.
BODY_WORDS = tuple(
    "all also and are disclaimer doctrines holder holders holdership if in interest interests law laws license licenses line like notice notices of on or patent permission representations resulting "
    "right rights statement statements status the those treaty under you".split()
)
_BODY_LINE = "^copyright (?:" + "|".join(BODY_WORDS) + ")(?: |$)"
_PUNCTUATION = r"[^\p{L}\p{M}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lines of a text in lower case, with words apart by one space and equal spellings made one."""
    text = F.replace(F.replace(F.lower(text), F.lit("©"), F.lit(" copyright ")), F.lit("(c)"), F.lit(" copyright "))
    text = F.regexp_replace(text, _PUNCTUATION, " ")
    for one, other in SPELLINGS:
        text = F.replace(text, F.lit(one), F.lit(other))
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def whole_text(lines: Column) -> Column:
    """The canonical text: all lines but the empty ones and copyright lines, as one string.

    A copyright line begins with "copyright" and goes on with a year, a sign or a name.
    """
    return F.array_join(F.filter(lines, lambda x: (x != "") & (~x.startswith("copyright") | x.rlike(_BODY_LINE))), " ")


def canonical(text: str) -> str:
    """The canonical text of a Python string; the same as ``whole_text`` of ``canonical_lines``."""
    import regex

    text = text.lower().replace("©", " copyright ").replace("(c)", " copyright ")
    text = regex.sub(_PUNCTUATION, " ", text)
    for one, other in SPELLINGS:
        text = text.replace(one, other)
    lines = (re.sub("^ +| +$", "", x) for x in text.split("\n"))
    return " ".join(x for x in lines if x and (not x.startswith("copyright") or re.search(_BODY_LINE, x)))


def known_digests() -> dict[str, str]:
    """Digest of every known text -> its licence. No text is known under two names."""
    out: dict[str, str] = {}
    for name, digest in [*((n, hashlib.sha256(canonical(t).encode()).hexdigest()) for n, texts in LICENSES.items() for t in texts), *((n, d) for n, digests in DIGESTS.items() for d in digests)]:
        if out.setdefault(digest, name) != name:
            raise ValueError(f"{name} and {out[digest]} have a text in common")
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, line_no, license): every document, and every line of one, that is a known licence text.

    ``unit`` is "document" when the whole text, without its copyright lines, is a known text (line_no is then
    null), and "line" when a line from 0 on is one, as notices are. A text of a single line can give both.
    The known digests are a fixed list of this package, so their side of the join is always broadcast.

    A null text gives no rows, nor does an empty text or line. Texts of any length are read whole. A null doc_id is
    kept. Every repeated row gives its own rows; a text has one licence at most, so there are no ties. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(known_digests().items()), "digest string, license string")
    lines = docs.where("text is not null").select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    whole = F.struct(F.lit("document").alias("unit"), F.lit(None).cast("int").alias("line_no"), whole_text(F.col("lines")).alias("canonical"))
    each = F.transform("lines", lambda x, k: F.struct(F.lit("line").alias("unit"), k.cast("int").alias("line_no"), x.alias("canonical")))
    units = lines.select("doc_id", F.explode(F.concat(F.array(whole), each)).alias("u")).select("doc_id", "u.*").where("canonical <> ''")
    found = units.withColumn("digest", F.sha2(F.col("canonical").cast("binary"), 256)).join(F.broadcast(known), "digest")
    return found.select("doc_id", "unit", "line_no", "license")


def license_scan_sql() -> str:
    text = "replace(replace(lower(text), '©', ' copyright '), '(c)', ' copyright ')"
    text = f"regexp_replace({text}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\n]+', ' ', 'g')"
    for one, other in SPELLINGS:
        text = f"replace({text}, '{one}', '{other}')"
    values = ", ".join(f"('{digest}', '{name}')" for digest, name in sorted(known_digests().items()))
    return f"""
    WITH known(digest, license) AS (VALUES {values}),
    canon AS (SELECT doc_id, {text} AS body FROM documents WHERE text IS NOT NULL),
    numbered AS (SELECT doc_id, body, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS k FROM canon),
    whole AS (SELECT doc_id, body, string_agg(trim(line), ' ' ORDER BY k) FILTER (WHERE trim(line) <> '' AND (NOT starts_with(trim(line), 'copyright') OR regexp_matches(trim(line), '{_BODY_LINE}'))) AS canonical FROM numbered GROUP BY doc_id, body),
    units AS (SELECT doc_id, 'document' AS unit, CAST(NULL AS INTEGER) AS line_no, canonical FROM whole
              UNION ALL SELECT doc_id, 'line', CAST(k AS INTEGER), trim(line) FROM numbered)
    SELECT doc_id, unit, line_no, license FROM units JOIN known ON sha256(canonical) = digest WHERE canonical <> ''
    """
