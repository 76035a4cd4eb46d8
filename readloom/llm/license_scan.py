"""License scans by canonical digest.

A text is made canonical: lower case, copyright lines gone, spellings unified, everything but letters and digits one
space. Its digest is looked up among those of known licences and notices by a hash join; so is that of each of its lines,
since notices stand alone in documents.

Whole licences (``licenses``, and the longer of ``KNOWN``) are looked up by a second digest as well, of the text without its
copyright lines, rights line and list numbers; of those lines that begin with "copyright" only such go as name a holder or
year. Their titles and appendices may be there or not. Both digests of a text meet the known ones in one join each. The
known digests are broadcast: the built-in table has some dozens of rows, one passed by the caller ``MAX_KNOWN`` at most.

All is DataFrame functions. Defined results: null counts as empty, whose canonical form is empty and matches nothing;
repeated rows and null ids stand for themselves; a text of any length is one row, its lines one array; input columns with
the names of results give way to them, others pass.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import table, unused

MAX_KNOWN = 1_000
OUTPUTS = ("text_digest", "license", "line_licenses", "n_license_lines")

#: Spellings that mean the same, in lower case: fixed values.
SPELLINGS = (
    ("licence", "license"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("whilst", "while"), ("https", "http"), ("copyright holder", "copyright owner"),
)

#: Public licence texts and notices by SPDX name: fixed values.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


#: Titles that stand above texts of ``KNOWN``, and where appendices begin or end: fixed values.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License")}
APPENDIX = re.compile(r"\n[ \t]*(?:END OF TERMS AND CONDITIONS|APPENDIX:? How to|How to Apply These Terms)", re.I)

#: Words after "copyright" that make a line one of the licence itself.
_PROSE = "notices?|holders?|owners?|laws?|licen[sc]es?|statements?|interests?|treat(?:y|ies)|acts?|disclaimers?|permissions?|protection|and|or|in|is|to|of|on|for|as|under|with|that|which|a|an|any|this|such|the (?:software|program|library|work)"
_OWN_LINES = (
    (rf"\n[ \t]*(?:[-*][ \t]*)?(?:©|\(c\)[ \t]*(?:copyright|[12][0-9]{{3}})|copyright:?[ \t]+(?!(?:{_PROSE})\b)(?=[\p{{L}}\p{{N}}(©<\[{{]))[^\n]*(?=\n)", "\n"),
    (r"\n[ \t]*all rights reserved\.?[ \t]*(?=\n)", "\n"),
    (r"\n[ \t]*[0-9]{1,2}[.)][ \t]+", "\n"),
)


def canonical(text: Column) -> Column:
    found = F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"))
    found = F.regexp_replace(found, r"\n[ \t]*(copyright|\(c\)|©)[^\n]*(?=\n)", "\n")
    for other, usual in SPELLINGS:
        found = F.replace(found, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(found, r"[^\p{L}\p{N}]+", " "))


def canonical_text(text: str | None) -> str:
    """The same for one text, for tests and for the table of known ones."""
    import regex

    found = "\n" + (text or "").lower() + "\n"
    found = regex.sub(r"\n[ \t]*(copyright|\(c\)|©)[^\n]*(?=\n)", "\n", found)
    for other, usual in SPELLINGS:
        found = found.replace(other, usual)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", found).strip(" ")


def body(text: Column) -> Column:
    """The canonical form of a whole licence."""
    found = F.concat(F.lit("\n"), F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r"), F.lit("")), F.lit("\n"))
    for pattern, to in _OWN_LINES:
        found = F.regexp_replace(found, pattern, to)
    for other, usual in SPELLINGS:
        found = F.replace(found, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(found, r"[^\p{L}\p{N}]+", " "))


def body_text(text: str) -> str:
    import regex

    found = "\n" + text.lower().replace("\r", "") + "\n"
    for pattern, to in _OWN_LINES:
        found = regex.sub(pattern, to, found)
    for other, usual in SPELLINGS:
        found = found.replace(other, usual)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", found).strip(" ")


def whole_licenses() -> dict[str, str]:
    """Names by digest of ``body`` for whole licences, with and without title and appendix."""
    import hashlib

    texts = [(n, f"{title}\n{t}") for n, t in KNOWN if len(t) > 200 for title in ("", *TITLES.get(n, ()))]
    for path in sorted(files("readloom.llm").joinpath("licenses").iterdir(), key=str):
        name, t = path.name.removesuffix(".txt"), path.read_text()
        head = re.match(r"\s*(?:[^\n]+\n)+", t)[0]  # the first paragraph is the title
        bare = t if name == "Unlicense" else t[len(head) :]
        for whole in (t, bare):
            cut = APPENDIX.search(whole)
            ends = [whole] if not cut else [whole, whole[: cut.start()], whole[: cut.start()] + "\nEND OF TERMS AND CONDITIONS"]
            texts += [(name, x) for x in ends]
    return {hashlib.md5(body_text(t).encode()).hexdigest(): n for n, t in texts}


def known_licenses(spark: SparkSession, texts=KNOWN) -> DataFrame:
    import hashlib

    rows = {hashlib.md5(canonical_text(t).encode()).hexdigest(): name for name, t in texts}
    return spark.createDataFrame(list(rows.items()), "digest string, license string")


def scan(documents: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``documents`` with text_digest, license (of the whole text, or null), line_licenses (names of the lines' licences,
    sorted, by commas) and n_license_lines."""
    spark = documents.sparkSession
    wholes = spark.createDataFrame(list(whole_licenses().items()) if known is None else [], "body_digest string, whole string")
    rows = (known_licenses(spark) if known is None else known).limit(MAX_KNOWN + 1).collect()
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known digests")
    known = spark.createDataFrame([(r.digest, r.license) for r in rows], "digest string, known string").dropDuplicates(["digest"])
    names = F.create_map(*[F.lit(x) for r in rows for x in (r.digest, r.license)]) if rows else F.create_map().cast("map<string,string>")
    documents = documents.drop(*[c for c in OUTPUTS if c != text])
    digest, body_digest, lines = (unused(documents, x) for x in ("digest", "body_digest", "lines"))
    found = documents.withColumns({digest: F.md5(canonical(F.col(text))), body_digest: F.md5(body(F.col(text)))})
    found = found.join(F.broadcast(known.select(F.col("digest").alias(digest), F.col("known").alias(f"{digest}_known"))), digest, "left")
    found = found.join(F.broadcast(wholes.select(F.col("body_digest").alias(body_digest), F.col("whole").alias(f"{body_digest}_known"))), body_digest, "left")
    of_lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.try_element_at(names, F.md5(canonical(x))))
    found = found.withColumn(lines, F.array_compact(of_lines))
    results = {
        "text_digest": F.col(digest),
        "license": F.coalesce(f"{digest}_known", f"{body_digest}_known"),
        "line_licenses": F.concat_ws(",", F.array_sort(F.array_distinct(lines))),
        "n_license_lines": F.size(lines).cast("long"),
    }
    return found.select(*documents.columns, *[c.alias(n) for n, c in results.items()])


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_digest", "license", "line_licenses", "n_license_lines")


def _sql_canonical(text: str) -> str:
    found = f"chr(10) || lower(coalesce({text}, '')) || chr(10)"
    # the line end goes on both sides of a copyright line, so line ends are doubled before and halved after
    found = f"regexp_replace(replace({found}, chr(10), chr(10) || chr(10)), '\\n[ \\t]*(copyright|\\(c\\)|©)[^\\n]*\\n', chr(10), 'g')"
    for other, usual in SPELLINGS:
        found = f"replace({found}, '{other}', '{usual}')"
    return f"trim(regexp_replace({found}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"


_ROWS = ", ".join("('{}', '{}')".format(canonical_text(t), name) for name, t in KNOWN)
ORACLE = f"""
WITH known(body, license) AS (VALUES {_ROWS}), k AS (
  SELECT md5(body) AS digest, license FROM known
), d AS (
  SELECT doc_id, text, md5({_sql_canonical("text")}) AS text_digest FROM documents
), l AS (
  SELECT doc_id, license FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) x
  JOIN k ON k.digest = md5({_sql_canonical("line")})
), n AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS names FROM l GROUP BY doc_id
)
SELECT d.doc_id, text_digest, license, coalesce(names, '') AS line_licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines
FROM d LEFT JOIN k ON k.digest = d.text_digest LEFT JOIN n ON n.doc_id = d.doc_id
"""
