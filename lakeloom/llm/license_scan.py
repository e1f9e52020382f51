"""License scans by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, white space,
copyright lines and equivalent spellings no longer matter) and its digest is
looked up among the digests of known licence texts by a hash join. The same
lookup for each line finds short notices inside documents. Whole texts are
looked up without their title, and those of the BSD family without the names
of holders and the marks of clauses. Texts never move: only digests of lines
that could match are joined.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import bound

# Spellings that the SPDX matching guidelines treat as equal, and the one they become here.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Spellings of several words in canonical form, and the one they become here.
PHRASES = {
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "per cent": "percent",
    "sub license": "sublicense",
    "sub licensing": "sublicensing",
    "sub licensed": "sublicensed",
}

# Short licence texts and notices, by identifier.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:all-rights-reserved": "All rights reserved.",
}

#: Words that follow "copyright" in the body of a licence, where a line may begin with it; a notice goes on with a mark, a year or a holder.
_BODY = r"(?:notices?|holders?|owners?|ownership|laws?|licen[cs]es?|interests?|statements?|permissions?|protections?|rights?|disclaimers?|doctrines?|treaty|treaties|infringements?|status|and|or|on|in|if|is|are|as|to|for|may|shall|resulting|(?:of )?(?:this|these|such|any)|(?:of )?the (?:software|program|library|package|work|document))\b"
_COPYRIGHT = r"(?m)^[ \t]*(?:©|\(c\)(?=[ \t]*(?:©|copyright\b)|.*\b(?:19|20)\d\d\b|.*all rights reserved)|copyright(?=[ \t:(©])(?![ \t:]*(?:\r?$|\((?!c\)|©)|[,;.)]|" + _BODY + "))).*$"
#: Titles in canonical form, and what is left of a copyright notice below it.
_TITLE = (
    r"^(?:(?:license )?(?:the )?(?:"
    r"(?:mit|expat|isc) license(?: mit| isc| expat)?"
    r"|(?:new |modified |revised |simplified |original )?(?:[234] clause )?bsd(?: [234] clause)?(?: new or revised| new| revised| simplified)? license"
    r"|apache license(?: version)? 2 0(?: january 2004)?(?: https? www apache org licenses)?"
    r"|(?:gnu )?(?:lesser |library |affero )?general public license(?: version \d(?: \d)?)?(?: \d+)?(?: (?:january|february|june|november) (?:\d+ )?\d{4})?"
    r"|mozilla public license version \d \d"
    r") )?(?:all rights reserved )?"
)
#: Forms up to this length are notices and keep all their words.
_SHORT = 200
#: What the SPDX templates of the BSD family leave open.
_HOLDERS = {
    r" (?:\d|[a-d]) (redistributions |neither the name |the names? )": " $1",
    r" neither the names? .{1,300}? may be used to endorse ": " neither the name of holder may be used to endorse ",
    r" this software is provided by .{1,300}? as is and ": " this software is provided by holder as is and ",
    r" in no event shall .{1,300}? be liable ": " in no event shall holder be liable ",
}
_END = "END OF TERMS AND CONDITIONS"
_SPELLING = r"(^| )(" + "|".join(EQUIVALENT) + r")( |$)"


def canonical(text: Column) -> Column:
    """The canonical form of a text: lower-case words joined by one space."""
    pairs = [x for a, b in EQUIVALENT.items() for x in (F.lit(a), F.lit(b))]

    def plain(low: Column) -> Column:
        marked = low.contains("copyright") | low.contains("(c)") | low.contains("©")
        return F.trim(F.regexp_replace(F.when(marked, F.regexp_replace(low, _COPYRIGHT, "")).otherwise(low), r"[^\p{L}\p{N}]+", " "))

    def spelled(form: Column) -> Column:
        words = F.transform(F.split(form, " "), lambda w: F.coalesce(F.create_map(*pairs)[w], w))
        return F.when(form.rlike(_SPELLING), F.array_join(words, " ")).otherwise(form)

    def phrased(form: Column) -> Column:
        done = form
        for a, b in PHRASES.items():
            done = F.regexp_replace(done, f"(^| ){a}( |$)", f"$1{b}$2")
        return F.when(form.rlike("(^| )(copyright owner|per cent|sub licens)"), done).otherwise(form)

    return bound(F.lower(text), lambda low: bound(bound(plain(low), spelled), phrased))


def looked_up(form: Column) -> Column:
    """What of a whole text's canonical form is looked up: no title, and no holders in texts of the BSD family."""

    def open_fields(body: Column) -> Column:
        done = body
        for pattern, text in _HOLDERS.items():
            done = F.regexp_replace(done, pattern, text)
        return F.when(body.startswith("redistribution and use in source and binary forms"), done).otherwise(body)

    return F.when(F.length(form) > _SHORT, bound(F.regexp_replace(form, _TITLE, ""), open_fields)).otherwise(form)


def library() -> list[tuple[str, str]]:
    """(license, text) of KNOWN and of the whole texts in the folder ``licenses``; a text with an appendix also without it."""
    rows = list(KNOWN.items())
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        rows.append((file.stem, text))
        if _END in text:
            rows += [(file.stem, text[: text.index(_END)]), (file.stem, text[: text.index(_END) + len(_END)])]
    return rows


def known_digests(spark: SparkSession, known: dict[str, str] | list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """digest, license of the known texts; of equal digests the least identifier. Texts without a word are left out."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known.items()) if isinstance(known, dict) else known, "license string, text string")
    found = rows.select("license", looked_up(canonical(F.col("text"))).alias("form")).where(F.col("license").isNotNull() & (F.col("form") != ""))
    return found.groupBy(F.md5(F.col("form").cast("binary")).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(df: DataFrame, known: dict[str, str] | list[tuple[str, str]] | DataFrame = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, digest, license (the known text that the whole text equals) and notices (sorted identifiers of the lines that equal one).

    Defined cases: a null text has no digest, licence or notices (an empty
    list); a blank one has the digest of an empty form and matches nothing; a
    line counts once; repeated rows are kept, each with the same result; rows
    with the same id but other texts are judged each for itself; an empty
    table gives an empty result; other columns are not looked at.
    """
    spark = df.sparkSession
    # as large as the list of known texts; Spark broadcasts it if it is under the session's threshold
    digests = known_digests(spark, known)
    text = F.col(text_col)
    docs = df.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("code"), text.alias("body"))
    # one string leaves the lambda: the digest, then that of what is looked up
    both = bound(canonical(F.col("body")), lambda form: F.concat(F.md5(form.cast("binary")), F.md5(looked_up(form).cast("binary"))))
    forms = docs.select("doc", "code", both.alias("both")).select("doc", "code", F.substring("both", 1, 32).alias("own"), F.substring("both", 33, 32).alias("digest"))
    whole = forms.join(digests, "digest", "left").select("doc", "code", F.col("own").alias("digest"), "license")
    forms = F.array_distinct(F.transform(F.split("body", "\n"), lambda x: F.md5(canonical(x).cast("binary"))))
    lines = docs.select("code", F.explode(forms).alias("digest")).join(digests, "digest").select("code", "license")
    notices = lines.groupBy("code").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    none = F.array().cast("array<string>")
    return whole.join(notices, "code", "left").select(F.col("doc").alias(id_col), "digest", "license", F.coalesce("notices", none).alias("notices"))


def _sql_form(x: str) -> str:
    """The canonical form in DuckDB's SQL, whose patterns know no lookahead."""
    start = r"^[ \t]*"
    notice = " or ".join(
        [
            f"regexp_matches(l, '{start}©')",
            rf"(regexp_matches(l, '{start}\(c\)') and (regexp_matches(l, '{start}\(c\)[ \t]*(©|copyright\b)') or regexp_matches(l, '{start}\(c\).*\b(19|20)\d\d\b') or regexp_matches(l, '{start}\(c\).*all rights reserved')))",
            rf"(regexp_matches(l, '{start}copyright[ \t:(©]') and not regexp_matches(l, '{start}copyright[ \t:]*(\r?$|\(([^c©]|c([^)]|$)|$)|[,;.)]|{_BODY})'))",
        ]
    )
    low = f"array_to_string(list_transform(string_split(lower({x}), chr(10)), lambda l: case when {notice} then '' else l end), chr(10))"
    plain = f"trim(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    names = ", ".join(f"'{a}'" for a in EQUIVALENT)
    values = ", ".join(f"'{b}'" for b in EQUIVALENT.values())
    form = f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce(map([{names}], [{values}])[w], w)), ' ')"
    for a, b in PHRASES.items():
        form = f"regexp_replace({form}, '(^| ){a}( |$)', '\\1{b}\\2', 'g')"
    return form


def _sql_looked_up(form: str) -> str:
    """What of the canonical form is looked up, in DuckDB's SQL."""
    body = f"regexp_replace({form}, '{_TITLE}', '')"
    open_fields = body
    for pattern, text in _HOLDERS.items():
        open_fields = f"regexp_replace({open_fields}, '{pattern}', '{text.replace('$', chr(92))}', 'g')"
    return f"case when length({form}) <= {_SHORT} then {form} when starts_with({body}, 'redistribution and use in source and binary forms') then {open_fields} else {body} end"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    """The scan with the texts of ``library`` as SQL for DuckDB."""
    known = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in library())
    return f"""
with f as materialized (select license, {_sql_form('text')} as form from (values {known}) v(license, text)),
k as materialized (select md5({_sql_looked_up('form')}) as digest, min(license) as license from f where form <> '' group by 1),
l as materialized (select distinct doc_id, md5({_sql_form('line')}) as digest from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null)),
n as (select l.doc_id, list_sort(list(distinct k.license)) as found from l join k on l.digest = k.digest group by 1),
w as materialized (select doc_id, {_sql_form('text')} as form from documents)
select w.doc_id, case when form is not null then md5(form) end as digest, k.license, coalesce(array_to_string(n.found, ','), '') as notices
from w left join k on md5({_sql_looked_up('form')}) = k.digest left join n on w.doc_id = n.doc_id
"""
