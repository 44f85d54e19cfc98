"""Licence scans by canonical digests, in DataFrame operations only.

A text is put into a canonical form: lower case, copyright lines gone, equivalent
spellings made one, punctuation and white space squeezed to single blanks.  The
SHA-256 of the whole form is looked up among the digests of known licences.
Licence notices are single lines of longer texts, so each line's own digest is
looked up as well, in the digests of known notices.

The known texts are a small table (their number is checked before it is
broadcast; beyond ``BROADCAST_ROWS`` it is a shuffle join).  Null and empty
texts, and those of copyright lines and punctuation only, have an empty form and no licence.
Repeated rows are each reported.  Of licences with one digest (a tie) the first in string order is named.
A text of any length is put into its form in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelight.llm.licence_digests import DIGESTS

#: Known rows that may be broadcast (some 100 bytes each).
BROADCAST_ROWS = 100_000
#: Known notices, which go with the plan; a longer list is an error.
PLAN_ROWS = 2_000
COPYRIGHT = r"(?im)^[^\n\w]*(?:copyright|\(c\)|©)[^\n]*$|^[^\n\w]*all rights reserved[^\n\w]*$"
#: Equivalent spellings: pattern on the lower-case, blank-separated form -> one spelling.
SPELLINGS = [
    (r"\blicence", "license"), (r"\bgnu general public license\b|\bgnu gpl\b", "gpl"), (r"\bcreative commons\b", "cc"), (r"\battribution non ?commercial\b", "by nc"),
    (r"\bsub license", "sublicense"), (r"\bnon ?commercial\b", "noncommercial"), (r"\bmerchantibility\b", "merchantability"), (r"\bversion ([0-9])", r"v\1"), (r"\bwhilst\b", "while"), (r"\bauthorised\b", "authorized"),
]
#: Short licence texts as published, and the names that notices use.
TEXTS = {
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}
#: Headings a whole text may have, and BSD texts with the wordings and list marks in use.
HEADINGS = {
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"],
    "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)", "ISC"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
}
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n{2}THIS SOFTWARE IS PROVIDED BY {3} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {4} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_THIRD = "{}Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_WHO = [("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"), ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"), ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS")]
#: SPDX ids beside those of NAMES.
SPDX = {"GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"], "MPL-2.0": ["MPL-2.0-no-copyleft-exception"]}
NAMES = {"MIT": "the MIT License", "Apache-2.0": "the Apache License, Version 2.0", "GPL-2.0": "the GNU General Public License, version 2", "GPL-3.0": "the GNU General Public License, version 3", "BSD-3-Clause": "the BSD 3-Clause License", "BSD-2-Clause": "the BSD 2-Clause License", "ISC": "the ISC License", "MPL-2.0": "the Mozilla Public License, Version 2.0", "CC0-1.0": "CC0 1.0", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0", "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0"}
NOTICES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is released under {}.", "SPDX-License-Identifier: {}"]


def canonical(text: Column) -> Column:
    """The canonical form; line breaks stay, so that lines can be told apart."""
    c = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, ""))
    c = F.regexp_replace(c, r"[^\n\p{L}\p{N}]+", " ")
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to.replace(r"\1", "$1"))
    return F.trim(F.regexp_replace(c, r" *\n[\n ]*", "\n"))


def digest(form: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(form, r"\s+", " ")), 256)


def known_rows() -> list[tuple[str, str, str]]:
    rows = [("text", k, v) for k, v in TEXTS.items()]
    rows += [("line", k, n.format(v)) for k, v in NAMES.items() for n in NOTICES]
    return rows + [("line", k, f"SPDX-License-Identifier: {k}") for k in NAMES]


def further_rows() -> list[tuple[str, str, str]]:
    """Known texts that the SQL doesn't list: whole texts with other headings and wordings, and further SPDX ids."""
    bodies = {k: [v.split("\n\n", 1)[1]] for k, v in TEXTS.items()}
    for one, two, three in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")):
        for holders, liable in _BSD_WHO:
            bodies.setdefault("BSD-2-Clause", []).append(_BSD.format(one, two, "", holders, liable))
            for name in ("the copyright holder", "the University", "the copyright owner"):
                bodies.setdefault("BSD-3-Clause", []).append(_BSD.format(one, two, _BSD_THIRD.format(three, name), holders, liable))
    rows = [("text", k, f"{h}\n\n{b}") for k, texts in bodies.items() for b in texts for h in HEADINGS[k]]
    return rows + [("line", k, f"SPDX-License-Identifier: {i}") for k, ids in SPDX.items() for i in ids]


def known_licences(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """kind (text or line), licence, digest, length of the known texts; several spellings may share a digest."""
    df = spark.createDataFrame(rows if rows is not None else known_rows() + further_rows(), "kind string, licence string, text string")
    form = canonical(F.col("text"))
    df = df.select("kind", "licence", digest(form).alias("digest"), F.length(form).alias("length"))
    if rows is None:
        long = [("text", k, x, 0) for k, digests in DIGESTS.items() for x in digests]
        df = df.unionByName(spark.createDataFrame(long, "kind string, licence string, digest string, length int"))
    return df.groupBy("kind", "digest").agg(F.min("licence").alias("licence"), F.max("length").alias("length"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_sha256 (of the canonical form), licence (of the entire text, else null), n_notices and notices.

    ``notices`` are the sorted distinct licences of lines that are known
    notices, comma-joined; an entire text that is one such line also counts as its licence.
    """
    known = known if known is not None else known_licences(docs.sparkSession)
    bounded = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if bounded else (lambda d: d)
    longest = known.filter("kind = 'line'").agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    listed = known.filter("kind = 'line'").select("digest", "licence").limit(PLAN_ROWS + 1).collect()
    if len(listed) > PLAN_ROWS:
        raise ValueError(f"more than {PLAN_ROWS} known notices")
    rows = docs.select(F.col("doc_id"), canonical(F.col("text").cast("string")).alias("form"))
    lines = F.expr(f"transform(filter(split(form, '\\n'), l -> length(l) BETWEEN 1 AND {int(longest)}), l -> sha2(trim(l), 256))")
    rows = rows.select("doc_id", digest(F.col("form")).alias("text_sha256"), (F.col("form") == "").alias("blank"), lines.alias("lines"))
    whole = known.groupBy("digest").agg(F.min("licence").alias("licence")).withColumnRenamed("digest", "text_sha256")
    # the small table of notices goes with the plan: a hash set first, the licence for the few lines that are in it; no row is multiplied
    table = sorted((r["digest"], r["licence"]) for r in listed)
    if table:
        pairs = F.create_map(*[F.lit(x) for kv in table for x in kv])
        found = F.transform(F.filter("lines", lambda l: l.isin(*[d for d, _ in table])), lambda l: F.element_at(pairs, l))
    else:
        found = F.array().cast("array<string>")
    rows = rows.withColumn("found", found).drop("lines")
    rows = rows.join(small(whole), "text_sha256", "left")
    return rows.select("doc_id", "text_sha256", F.when(~F.col("blank"), F.col("licence")).alias("licence"), F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def oracle() -> str:
    def form(x: str) -> str:
        c = f"lower(regexp_replace(coalesce({x}, ''), '{COPYRIGHT}', '', 'g'))"
        c = f"regexp_replace({c}, '[^\\n\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        for p, to in SPELLINGS:
            c = f"regexp_replace({c}, '{p}', '{to}', 'g')"
        return f"trim(regexp_replace({c}, ' *\\n[\\n ]*', '\n', 'g'), ' ')"

    values = ",".join("('{}', '{}', '{}')".format(*(v.replace("'", "''") for v in r)) for r in known_rows())
    dig = lambda x: f"sha256(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' '))"
    return f"""
WITH k0(kind, licence, text) AS (VALUES {values}), k AS MATERIALIZED (SELECT kind, {dig(form('text'))} AS digest, min(licence) AS licence FROM k0 GROUP BY 1, 2),
w AS (SELECT digest, min(licence) AS licence FROM k GROUP BY 1),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {form('text')} AS form FROM documents),
l AS (SELECT r, trim(unnest(string_split(form, '\n')), ' ') AS line FROM d),
f AS (SELECT r, count(*) AS n, array_to_string(list_sort(list(DISTINCT licence)), ',') AS notices FROM l JOIN k ON kind = 'line' AND digest = sha256(line) WHERE line <> '' GROUP BY r)
SELECT doc_id, {dig('form')} AS text_sha256, CASE WHEN form <> '' THEN w.licence END AS licence, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN w ON w.digest = {dig('form')} LEFT JOIN f USING (r)
"""


ORACLE = oracle()
