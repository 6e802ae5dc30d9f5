"""Licence scans by canonical digest.

A text is normalised (case, punctuation, copyright lines and equivalent spellings) and
its digest is joined with those of known licences.  The whole document is looked up, for
files that are a licence, and each of its lines, for licence notices.

The whole text has two digests: with the paragraphs that state a copyright left out, for
a licence with its owner's name, and with everything, for a licence that has such a line
itself and was wrapped anew, so that the line begins elsewhere.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

#: Signs of comments at the beginning of a line.
LEADER = r"(^|\n)[ \t#/*;!%>-]+"
#: A paragraph that begins with the statement of a copyright, to the end of the line, and such lines after it.
COPYRIGHT = r"(^|\n\n)\n*((copyright[ \t]*(\(c\)|©|:|[0-9]{4}|\[|<|\{)|(\(c\)|©)[ \t]*[0-9]{4}|portions copyright|all rights reserved)[^\n]*(\n+|\z))+"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
# Equivalent spellings, of words between single spaces.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("http www", "https www"),
    ("51 franklin street fifth floor boston ma 02110 1301 usa", "foundation address"),
    ("51 franklin st fifth floor boston ma 02110 1301 usa", "foundation address"),
    ("59 temple place suite 330 boston ma 02111 1307 usa", "foundation address"),
    ("675 mass ave cambridge ma 02139 usa", "foundation address"),
)
# Places where licences name their owner.
OWNERS = (
    (r"neither the names? of .{1,120}? nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"software is provided by .{1,80}? as is and any express", "software is provided by the copyright holder as is and any express"),
    (r"in no event shall .{1,80}? be liable for any", "in no event shall the copyright holder be liable for any"),
)

# Notices of well-known licences, a line each.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)
#: What the places begin with.
OWNED = "neither the name|software is provided by|in no event shall"
#: Fixed value: the line after which licences explain how to apply them.
END = "END OF TERMS AND CONDITIONS"
#: Words of a heading at most.
HEADING = 12


def known_texts() -> list[tuple[str, str]]:
    """``(license_id, text)`` of the whole licences known, from the files beside this module, in the forms in use.

    Each as it is, without its heading, with "The" before it, and without what follows the
    end of its terms.
    """
    out = []
    for file in sorted((Path(__file__).parent / "known_licenses").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        forms = [text]
        heading, _, rest = text.strip().partition("\n\n")
        if "\n" not in heading and len(heading.split()) <= HEADING:
            forms += [rest, f"The {text.strip()}", f"The {heading} ({file.stem})\n\n{rest}", f"({heading})\n\n{rest}"]
        if END in text:
            forms += [text[: text.index(END)], text[: text.index(END) + len(END)]]
        out += [(file.stem, f) for f in forms]
    return out


def _spelled(words: Column) -> Column:
    """One spelling, of words between single spaces."""
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(old), F.lit(new))
    return words


def _owned(words: Column) -> Column:
    """One name for owners; looked for only where a licence speaks of them."""
    for pattern, new in OWNERS:
        words = F.regexp_replace(words, pattern, new)
    return words


def _plain(text: Column) -> Column:
    """Lower case, one kind of line break, lines without signs of comments."""
    low = F.replace(F.replace(F.lower(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(low, LEADER, "$1")


def _words(plain: Column) -> Column:
    """Words by single spaces, lines by single line breaks."""
    out = F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(out, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def _whole(words: Column) -> Column:
    return _spelled(F.replace(words, F.lit("\n"), F.lit(" ")))


def _digest(canonical_text: Column) -> Column:
    return F.when(canonical_text != "", F.md5(canonical_text.cast("binary")))


def canonical_digests(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``text_digest, whole_digest, line_digests`` for ``text_col``: without statements of a copyright, with everything, of each line.

    Null texts, and those of punctuation only, have null digests.  In steps, so that each
    form is worked out once: a text without a statement has one digest for both.
    """
    out = rows.withColumn("__plain", _plain(F.col(text_col).cast("string")))
    out = out.withColumns({"__words": _words(F.col("__plain")), "__bare": F.when(F.col("__plain").rlike(COPYRIGHT), F.regexp_replace("__plain", COPYRIGHT, "$1"))}).drop("__plain")
    out = out.withColumns({"__lines": _spelled(F.col("__words")), "__whole": _whole(F.col("__words")), "__bare": _whole(_words(F.col("__bare")))}).drop("__words")
    for c in ("__whole", "__bare"):
        out = out.withColumn(c, F.when(F.col(c).rlike(OWNED), _owned(F.col(c))).otherwise(F.col(c)))
    lines = F.transform(F.filter(F.split("__lines", "\n"), lambda x: x != ""), lambda x: F.md5(x.cast("binary")))
    out = out.withColumns({"whole_digest": _digest(F.col("__whole")), "line_digests": lines})
    return out.withColumn("text_digest", F.when(F.col("__bare").isNotNull(), _digest(F.col("__bare"))).otherwise(F.col("whole_digest"))).drop("__whole", "__bare", "__lines")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, license_id``: canonical digests of known licences and notices; of equal ones the first id."""
    rows = spark.createDataFrame(known_texts() + list(NOTICES) if known is None else list(known), "license_id string, text string")
    both = canonical_digests(rows)
    return both.select(F.explode(F.array("text_digest", "whole_digest")).alias("digest"), "license_id").where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, digests: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_digest, license_id, notices, n_notices``: one row for each row of ``docs``.

    ``text_digest`` is the canonical digest of the entire text without statements of a
    copyright, ``license_id`` the known licence with that digest, else the one with the
    digest of the text with them.  ``notices`` lists the licences of which a line is a known
    notice, sorted and joined by commas, and ``n_notices`` counts such lines.

    Null texts, and texts of punctuation only, have a null digest and no licence.  Rows
    that repeat an id are each judged by their own text.  An empty table gives no rows.
    Other columns are ignored.
    """
    digests = known_digests(docs.sparkSession) if digests is None else digests
    # written once: the canonical forms are the costly part
    rows = canonical_digests(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text").drop("__text")
    rows = materialize(rows, "license-lines")
    lines = rows.select("whole_digest", F.posexplode("line_digests").alias("place", "digest"))
    # lines at one place of texts of one digest are counted once, so that copies do not add up
    matched = lines.join(digests, "digest").groupBy("whole_digest", "place").agg(F.min("license_id").alias("license_id"))
    counted = matched.groupBy("whole_digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"), F.count("*").alias("n_notices"))
    known = [digests.select(F.col("digest").alias(c), F.col("license_id").alias(n)) for c, n in (("text_digest", "by_text"), ("whole_digest", "by_whole"))]
    out = rows.drop("line_digests").join(counted, "whole_digest", "left").join(known[0], "text_digest", "left").join(known[1], "whole_digest", "left")
    return out.select(id_col, "text_digest", F.coalesce("by_text", "by_whole").alias("license_id"), F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
