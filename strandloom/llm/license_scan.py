"""Licence scans by canonical digest.

A text and the known licence texts are brought to one canonical form: lower case, copyright lines removed (on a line
that goes on with the licence, the copyright clause alone), equivalent spellings replaced by one, and every run of other
characters than letters and digits made one space.
Digests of entire canonical texts are then hash-joined. Texts that only contain a licence do not match.

A text of no known digest is looked up once more in its plain form: without its title, `All rights reserved` and copyright
lines that hold no year. The plain forms known are those of `KNOWN` and of the full texts in `licences/`, whole and up to
their end of terms; lists numbered or not. `digest` is always that of the canonical form.

Defined cases: a null text, and one with nothing left after normalising, match nothing and have a null digest; ties
between licences of one canonical text go to the smaller name. Repeated rows each get their row. Extra columns but
the text are kept, those of the result's names replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import small_side

# Published licence texts and notices, without their copyright lines.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "WTFPL-terms": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "CC0-1.0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
}

# Equivalent spellings, whole words only, each pair applied in this order.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("favour", "favor"), ("honour", "honor"), ("per cent", "percent"), ("http", "https"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"))

# A copyright notice with its year, however long, to the end of its line or to the words that a licence begins with; those are kept.
OPENING = "permission is |permission to |redistribution and use|licensed under|this program is|this software is|this is free|everyone is permitted"
COPYRIGHT_LINE = rf"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*?[0-9]{{4}}[^\n]*?($|{OPENING})"

# What the plain form lacks besides: a title (the line, or what stands before the licence's first words in it), lines that reserve all rights, and copyright lines without a year that say (c) or stand alone.
TITLE = r"\A[^a-z0-9]*(?:the )?(?:mit|isc|bsd|new bsd|simplified bsd|modified bsd|[23]-clause bsd|zlib|boost software|apache|gnu|mozilla public|unlicense|creative commons|do what the fuck)(?:[^a-z0-9\n][^\n]*?)?(?:\n|\z|(?=" + OPENING + "|terms and conditions))"
RESERVED = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
YEARLESS = r"(?m)^[^a-z0-9\n]*copyright[ \t]*(?:\(c\)|©)[^\n]*$"
ALONE = r"(?:\A|\n[ \t]*\n)[^a-z0-9\n]*copyright [^\n]*(?=\n[ \t]*\n)"
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
HINT = r"copyright|licen[cs]e|permission"  # each known text says one of these


def spaced(words: str) -> str:
    return words.replace(" ", "  ")


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, one space between words, one spelling for each word."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " $1")
    # two spaces between words: neighbours that are both replaced share none
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {spaced(old)} "), F.lit(f" {spaced(new)} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(F.length(form) > 0, F.sha2(form, 256))


def plain_digest(text: Column) -> Column:
    """The digest of the plain form, null for texts that say none of the words every licence has."""
    out = F.regexp_replace(F.lower(text), "\r\n?", "\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "$1")
    for pattern in (YEARLESS, RESERVED):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, ALONE, "\n\n"), TITLE, "")
    return F.when(F.lower(text).rlike(HINT), digest(F.regexp_replace(out, ALONE, "\n\n")))


def plain_texts() -> list[tuple[str, str]]:
    """(licence, text) of all forms that are known by their plain digest."""
    full = [(p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licences").glob("*.txt"))]
    ended = [(name, text[: text.index(END_OF_TERMS) + len(END_OF_TERMS)]) for name, text in full if END_OF_TERMS in text]
    begun = [(name, text[: text.index(END_OF_TERMS)]) for name, text in full if END_OF_TERMS in text]
    unnumbered = [(name, re.sub(r"(?m)^ *[0-9]\. ", "", text)) for name, text in full if name.startswith("BSD")]
    secure = [(name, text.replace("http://", "https://")) for name, text in full]
    return [*KNOWN.items(), *full, *ended, *begun, *unnumbered, *secure]


def known_plain(spark: SparkSession) -> DataFrame:
    """Licence names and plain digests, one row a digest."""
    rows = spark.createDataFrame(plain_texts(), "license string, body string")
    return rows.groupBy(plain_digest(F.col("body")).alias("license_digest")).agg(F.min("license").alias("license")).where("license_digest is not null")


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """Licence names and canonical digests, one row a digest."""
    rows = spark.createDataFrame(sorted((KNOWN if texts is None else texts).items()), "license string, body string")
    return rows.groupBy(digest(F.col("body")).alias("license_digest")).agg(F.min("license").alias("license")).where("license_digest is not null")


def scan(documents: DataFrame, licences: DataFrame | None = None, text: str = "text") -> DataFrame:
    """`documents` without its text, with its canonical digest and the licence of that digest or of its plain form, or null.

    With a table of `licences` (license_digest, license) of its own, canonical digests alone are looked up.
    """
    columns = [c for c in documents.columns if c not in (text, "digest", "license")]
    spark, own = documents.sparkSession, licences is not None
    licences = licences if own else known(spark)
    rows = documents.select(F.struct(*columns).alias("_row"), digest(F.col(text)).alias("_d"), (F.lit(None).cast("string") if own else plain_digest(F.col(text))).alias("_p"))
    side = lambda df, key, name: small_side(df.select(F.col("license_digest").alias(key), F.col("license").alias(name)), df.count(), 100_000)
    found = rows.join(side(licences, "_k", "_license"), F.col("_d") == F.col("_k"), "left")
    if own:
        return found.select("_row.*", F.col("_d").alias("digest"), F.col("_license").alias("license"))
    found = found.join(side(known_plain(spark), "_j", "_plain"), F.col("_p") == F.col("_j"), "left")
    return found.select("_row.*", F.col("_d").alias("digest"), F.coalesce("_license", "_plain").alias("license"))
