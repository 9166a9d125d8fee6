"""License scans by canonical digest: DataFrame functions only.

Texts and lines are brought to a canonical form (lower case, no copyright lines, one spelling for equivalent words, no
punctuation, single blanks), digested with SHA-256, and joined with the digests of known licence texts. A match means
that the whole unit, a document, one of its lines or a run of its lines, is a known licence text or notice. A run starts
at any line and has as many words as a known text, however these are wrapped; runs are only digested where the first
``OPENING`` words hash like those of a known text, which leaves out no match.

Defined cases: null and empty texts have no units and no licence; a unit that is empty in canonical form matches
nothing; blank lines do not end a run, and each of its other lines reports the match;
rows with one id, a null one included, report the union of their matches, a line number and licence counting once;
letters of all scripts count, so that a notice with foreign words before or behind is none; other columns are ignored. The table of known texts is a parameter; it is broadcast
only up to ``BROADCAST_ROWS`` rows, beyond which the join is shuffled.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BROADCAST_ROWS = 100_000
#: Words that tell where a run of lines may be a known text, and hash classes of these.
OPENING, BUCKETS = 4, 8192
#: Licence notices of one line, by SPDX identifier; these alone are in the SQL.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Complete licence texts and file headers, one file each, and titles that may stand before the text.
TEXTS = Path(__file__).parent / "licenses"
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "All rights reserved.", "BSD 2-Clause License All rights reserved."),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "All rights reserved.", "BSD 3-Clause License All rights reserved."),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: What follows the terms themselves, and list numbers that some copies leave out.
APPENDIX = r"(?s)\n[ \t]*(?:How to Apply These Terms|APPENDIX: How to apply|Exhibit A - ).*"
NUMBERS = r"(?m)^[ \t]*[1-9]\.[ \t]+(?=Redistribution|Neither|The origin|Altered|This notice)"
#: Spellings that count as the same, as (pattern, replacement), applied in this order.
EQUIVALENT = [
    ("licen[cs]", "licens"), ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("http://", "https://"), (r"\bv(?:ersion|er\.)? ?([0-9])", "version $1"),
]
#: What is no letter, mark or digit of any script.
OTHER = r"[^\p{L}\p{M}\p{N}\n]+"
COPYRIGHT = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"


#: A wrapped sentence may put the word first in a line; such lines are not copyright lines.
SENTENCE = r"(?!copyright (?:notice|holder|owner|licen[cs]e|law|interest|and |or |statement|disclaimer))"


def complete_texts() -> list[tuple[str, str]]:
    """``license, text`` of all files of ``TEXTS``: with and without title, appendix and list numbers."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        name = path.name.removesuffix(".txt").removesuffix(".header")
        text = path.read_text(encoding="utf-8")
        terms = re.sub(APPENDIX, "", text)
        forms = {text, terms, re.sub(r"(?s)\s*END OF TERMS AND CONDITIONS\s*$", "", terms), re.sub(NUMBERS, "", text)}
        titles = () if path.name.endswith(".header.txt") else TITLES.get(name, ())
        out += [(name, t) for f in sorted(forms) for t in (f, *(f"{title}\n\n{f}" for title in titles))]
    return out


def canonical(text: Column) -> Column:
    """Canonical form with its lines kept apart."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT.replace("(?:copyright", f"(?:{SENTENCE}copyright"), "")
    for pattern, same in EQUIVALENT:
        out = F.regexp_replace(out, pattern, same)
    return F.regexp_replace(out, OTHER, " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, license, words, bucket`` of known texts, of all in ``KNOWN`` and ``TEXTS`` if none are given.

    Of texts with one canonical form the first name in the alphabet stays. ``words`` counts the words of the form;
    ``bucket`` is the hash class of its opening.
    """
    texts = spark.createDataFrame(KNOWN + complete_texts() if known is None else known, "license string, text string")
    texts = texts.select("license", F.trim(F.regexp_replace(canonical(F.col("text")), r"\s+", " ")).alias("whole")).where("whole <> ''")
    texts = texts.withColumns({"words": F.size(F.split("whole", " ")), "bucket": _bucket(F.col("whole"))})
    return texts.groupBy(F.sha2(F.col("whole").cast("binary"), 256).alias("digest")).agg(
        F.min("license").alias("license"), F.min("words").alias("words"), F.min("bucket").alias("bucket")
    )


def _bucket(words: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(words, " ", OPENING)), F.lit(BUCKETS)).cast("int")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, unit, license``: unit 0 is the whole text, the others are its lines, numbered from 1."""
    sizes = {r["bucket"]: sorted(r["sizes"]) for r in known.groupBy("bucket").agg(F.collect_set("words").alias("sizes")).collect()}  # BUCKETS rows
    table_of = F.split(F.lit(";".join(",".join(map(str, sizes.get(b, []))) for b in range(BUCKETS))), ";")
    form = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("form"))
    lines = F.transform(F.split("form", "\n"), lambda x, i: F.struct((i + 1).alias("unit"), F.trim(x).alias("line")))
    form = form.select("doc_id", F.trim(F.regexp_replace("form", r"\s+", " ")).alias("whole"), F.filter(lines, lambda x: x["line"] != "").alias("filled"))

    def runs(i: Column) -> Column:
        """Runs of two and more lines from one line on, with as many words as a known text in the bucket of the opening."""
        # Every line has a word, so that as many lines as words are enough.
        several = lambda count: F.slice("filled", i + 1, count)
        found = F.element_at(table_of, _bucket(F.array_join(several(OPENING)["line"], " ")) + 1)

        def of_size(flow: Column, size: Column) -> Column:
            text = F.call_function("substring_index", F.translate(flow, "\n", " "), F.lit(" "), size)
            ends = F.substr(flow, F.length(text) + 1, F.lit(1)).isin("", "\n")  # with a line
            count = F.size(F.split(F.substr(flow, F.lit(1), F.length(text)), "\n"))
            return F.when(ends & (count > 1), F.struct(several(count)["unit"].alias("units"), text.alias("line")))

        size = F.split(found, ",").cast("array<int>")
        flows = F.transform(F.array(F.array_join(several(F.array_max(size))["line"], "\n")), lambda flow: F.transform(size, lambda n: of_size(flow, n)))
        return F.when(found != "", F.flatten(flows))

    single = F.array(F.struct(F.array(F.lit(0)).alias("units"), F.col("whole").alias("line")))
    each = F.transform("filled", lambda x: F.struct(F.array(x["unit"]).alias("units"), x["line"].alias("line")))
    several = F.transform(F.sequence(F.lit(0), F.size("filled") - 1), runs)
    several = F.when(F.size("filled") > 1, F.flatten(F.filter(several, lambda x: x.isNotNull())))
    units = form.select("doc_id", F.explode(F.concat(single, each, F.coalesce(several, F.array().cast("array<struct<units:array<int>,line:string>>")))).alias("u"))
    units = units.select("doc_id", "u.units", "u.line").where("line <> ''")
    units = units.select("doc_id", "units", F.sha2(F.col("line").cast("binary"), 256).alias("digest"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = known.select("digest", "license")
    return units.join(F.broadcast(known) if small else known, "digest").select("doc_id", F.explode("units").alias("unit"), "license")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, known_digests(spark)).groupBy(F.col("doc_id").alias("found_id")).agg(
        F.max(F.when(F.col("unit") == 0, F.col("license"))).alias("whole_license"),
        F.count_distinct(F.when(F.col("unit") > 0, F.col("unit"))).alias("n_license_lines"),
        F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"),
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", "whole_license", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )


def _sql_form(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', '', 'g')"
    for pattern, same in EQUIVALENT:
        out = f"regexp_replace({out}, '{pattern}', '{same.replace('$1', chr(92) + '1')}', 'g')"
    return f"regexp_replace({out}, '{OTHER}', ' ', 'g')"


_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in k)) for k in KNOWN)
ORACLE = f"""
WITH known AS (SELECT sha256(trim(regexp_replace({_sql_form("t")}, '\\s+', ' ', 'g'))) AS digest, min(l) AS license
               FROM (VALUES {_ROWS}) v(l, t) GROUP BY 1),
  forms AS (SELECT doc_id, {_sql_form("text")} AS form FROM documents),
  units AS (SELECT doc_id, 0 AS unit, trim(regexp_replace(form, '\\s+', ' ', 'g')) AS line FROM forms
            UNION ALL SELECT doc_id, generate_subscripts(x, 1), trim(unnest(x)) FROM (SELECT doc_id, string_split(form, chr(10)) AS x FROM forms)),
  hits AS (SELECT doc_id, unit, license FROM units JOIN known ON sha256(line) = digest WHERE line <> ''),
  agg AS (SELECT doc_id, max(license) FILTER (unit = 0) AS whole_license, count(DISTINCT unit) FILTER (unit > 0) AS n,
            string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hits GROUP BY doc_id)
SELECT d.doc_id, whole_license, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN agg ON d.doc_id IS NOT DISTINCT FROM agg.doc_id
"""
QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES = {"op4_license_scan": ORACLE}
