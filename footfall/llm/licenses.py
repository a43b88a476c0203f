"""Licence scans by canonical digest.

A text's canonical form is lower case, without copyright lines, of letters and digits
alone, with spellings folded until equivalent ones are the same; its SHA-256 is looked
up among the digests of known licence texts. Both the whole text of a document and
each of its lines are looked up, as whole texts. Everything is DataFrame functions; the
known digests are a fixed table of some dozens of rows.

A copyright line names a year or bears a copyright sign; a line that only begins with
the word is part of the text, so it makes no difference where lines break. If a known
text begins in the same line, the copyright line ends there.

Known are the full texts of MIT, BSD-2/3-Clause, 0BSD, ISC, Zlib and the Unlicense
(``LICENSES``) and of the licences in ``FULL_TEXTS``, the notices that files under
Apache-2.0 and the GPL bear, and short references to the licences named in ``LICENSES``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.license_texts import FULL_TEXTS, LICENSES

# Patterns mean the same in Java's and in RE2's dialect.
LINE_END = r"\r?\n"
NO_WORD = r"[^\p{L}\p{N}]+"
_OWNED = r"^[^\p{L}\p{N}]*(?:copyright[^\p{L}\p{N}]*(?:c\)|©|[12][0-9]{3}|year|yyyy)|©|\(c\)[^\p{L}\p{N}]*[12][0-9]{3})"
_RESERVED = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
# Foldings of a text without spaces, applied in this order. They also
# change other words, but both sides alike: owner and holder of a copyright, whilst,
# -our, -gement, artefact, -ogue, programme, wilful and fulfil, https, -ise and
# licence. Hyphens and spaces within a word are gone already.
FOLDINGS = (
    ("copyrightowner", "copyrightholder"), ("whilst", "while"), ("https", "http"), ("our", "or"), ("gem", "gm"),
    ("arte", "arti"), ("ogue", "og"), ("mme", "m"), ("ll", "l"), ("z", "s"), ("c", "s"),
)


def _copyright_line() -> str:
    """Pattern of what isn't part of a text; its group is the beginning of one."""
    paragraphs = (re.findall(r"\w+", p.lower())[:3] for texts in LICENSES.values() for t in texts for p in t.split("\n\n"))
    starts = "|".join(sorted({"[^a-z0-9]+".join(words) for words in paragraphs if len(words) == 3}))
    return f"{_RESERVED}|{_OWNED}(?:.*?({starts})|.*$)"


COPYRIGHT_LINE = _copyright_line()


def _folded(letters: Column) -> Column:
    for old, new in FOLDINGS:
        letters = F.replace(letters, F.lit(old), F.lit(new))
    return letters


def _letters(text: Column) -> Column:
    """Letters and digits of every line but copyright lines, in lower case."""
    lines = F.transform(F.split(F.lower(text), LINE_END), lambda line: F.regexp_replace(line, COPYRIGHT_LINE, "$1"))
    return F.transform(lines, lambda line: F.regexp_replace(F.replace(line, F.lit("&"), F.lit("and")), NO_WORD, ""))


def canonical(text: Column) -> Column:
    """The canonical form; null for null."""
    return _folded(F.array_join(_letters(text), ""))


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the known texts."""
    texts = spark.createDataFrame([(i, t) for i, texts in LICENSES.items() for t in texts], "license_id string, text string")
    listed = texts.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return listed.unionByName(spark.createDataFrame(list(FULL_TEXTS.items()), "license_id string, digest string")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, scope, license_id, n_found): the licences whose text is the whole text of a
    document (scope ``document``) or of so many of its lines (scope ``line``).

    A document of one line that is a licence has a row for each scope. Null, empty and
    wordless texts have none. Repeated rows with one doc_id add up; null doc_ids are
    counted together. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # a generator, so that the lines are taken apart once for both scopes
    lines = texts.select("doc_id", F.inline(F.array(F.struct(_letters(F.col("text")).alias("lines")))))

    def unit(scope: str, letters: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), _folded(letters).alias("text"))

    both = F.concat(
        F.array(unit("document", F.array_join("lines", ""))), F.transform("lines", lambda line: unit("line", line))
    )
    digests = lines.select("doc_id", F.inline(both)).select("doc_id", "scope", F.sha2("text", 256).alias("digest"))
    known = known_digests(docs.sparkSession)  # as many rows as the table of texts
    return (
        digests.join(F.broadcast(known), "digest")
        .groupBy("doc_id", "scope", "license_id").agg(F.count("*").alias("n_found"))
    )


def _folded_sql(letters: str) -> str:
    for old, new in FOLDINGS:
        letters = f"replace({letters}, '{old}', '{new}')"
    return letters


def scan_sql() -> str:
    """The same over ``documents`` as DuckDB SQL."""
    quoted = ",\n".join(f"('{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, texts in LICENSES.items() for t in texts)
    full = ",\n".join(f"('{i}', '{d}')" for i, d in FULL_TEXTS.items())
    letters = (
        f"list_transform(regexp_split_to_array(lower(text), '{LINE_END}'), "
        f"lambda l: regexp_replace(replace(regexp_replace(l, '{COPYRIGHT_LINE}', '\\1'), '&', 'and'), '{NO_WORD}', '', 'g'))"
    )
    return f"""
WITH known AS (
  SELECT DISTINCT license_id, sha256({_folded_sql("letters")}) AS digest
  FROM (SELECT license_id, array_to_string({letters}, '') AS letters FROM (VALUES {quoted}) AS t(license_id, text))
  UNION SELECT * FROM (VALUES {full}) AS f(license_id, digest)
), taken AS (
  SELECT doc_id, {letters} AS lines FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT doc_id, 'document' AS scope, array_to_string(lines, '') AS letters FROM taken
  UNION ALL
  SELECT doc_id, 'line' AS scope, unnest(lines) AS letters FROM taken
)
SELECT doc_id, scope, license_id, count(*) AS n_found
FROM (SELECT doc_id, scope, sha256({_folded_sql("letters")}) AS digest FROM units) JOIN known USING (digest) GROUP BY ALL"""
