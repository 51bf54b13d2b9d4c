"""Licence scans by canonical digests.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, spaces) and hashed; the digest is
joined with those of known licences and notices. Whole texts are units, and so are single lines, as notices stand in
longer texts. The known digests are a fixed short table, which is broadcast. DataFrame functions only.

Defined cases: null texts count as empty; a unit that normalises to nothing has no licence; repeated rows are answered
each; an empty table has no rows; of lines with the same licence the name comes once, in name order; texts are
normalised whole, however long, within their row. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import DIGESTS, TEXTS

# How spellings and marks count as equal, after lower-casing, in this order.
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"https", "http"),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-?commercial", "noncommercial"),
    (r"acknowledgement", "acknowledgment"),
    (r"per cent", "percent"),
    (r"copyright owner", "copyright holder"),
    (r"©", "(c)"),
    (r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " "),
)
#: A line is a notice if a sign, a year or a placeholder follows; body text may be wrapped before 'copyright' or '(c)'.
DATED = r"(\d{4}|[<\[{])"
NOTICE = rf"(?m)^[ \t/*#;-]*(copyright[ \t:,]*(\(c\)|©|{DATED})|(\(c\)|©)[ \t]*{DATED})[^\n]*$"
#: Two words count as a spelling across a line break, too.
RULES = ((NOTICE, ""), *((re.sub(r"(?<=[a-z]) (?=[a-z])", lambda _: r"[ \t\n/*#;-]+", a), b) for a, b in SPELLINGS))
SPACE = r"[ \n]+"


def _python(pattern: str) -> str:
    return pattern.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff")


def normal_form(text: str) -> str:
    """The normalised text with its lines apart, in Python; for the known table and for tests."""
    text = text.lower()
    for pattern, by in RULES:
        text = re.sub(_python(pattern), by, text)
    return text


def digest_of(text: str) -> str:
    return hashlib.sha256(re.sub(SPACE, " ", normal_form(text)).strip(" ").encode()).hexdigest()


def known() -> dict[str, str]:
    """Digest to licence."""
    return {digest_of(text): name for name, text in TEXTS} | {digest: name for name, digest in DIGESTS}


def normalised(text: Column) -> Column:
    text = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in RULES:
        text = F.regexp_replace(text, pattern, by)
    return text


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, license, line_licenses, n_license_lines): of the whole text, and of its lines by name order."""
    table = F.create_map(*(F.lit(x) for pair in sorted(known().items()) for x in pair))
    rows = common.pick(docs, doc_id="doc_id", text="text").select("doc_id", normalised(F.col("text")).alias("text"))
    rows = rows.select("doc_id", F.sha2(one_line(F.col("text")), 256).alias("digest"), F.split("text", r"\n").alias("lines"))
    short = F.filter("lines", lambda x: F.length(x).between(*LENGTHS))
    found = F.filter(F.transform(short, lambda x: F.try_element_at(table, F.sha2(one_line(x), 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "digest", found.alias("found"))
    whole = docs.sparkSession.createDataFrame(sorted(known().items()), "digest string, license string")
    rows = rows.join(F.broadcast(whole), "digest", "left")  # as long as the table of known texts
    return rows.select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("line_licenses"), F.size("found").cast("long").alias("n_license_lines"))


#: Normalised lengths of known texts, with a space at either end; a line of another length has no known digest.
LENGTHS = (1, 2 + max(len(normal_form(text)) for _, text in TEXTS))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def _sql() -> str:
    text = "lower(coalesce(text, ''))"
    for pattern, by in RULES:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    line = lambda x: f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known().items()))
    return f"""WITH k AS (SELECT * FROM (VALUES {values}) v(digest, license)),
d AS (SELECT row_number() OVER () AS r, doc_id, {text} AS x FROM documents),
l AS (SELECT r, sha256({line('line')}) AS digest FROM (SELECT r, unnest(string_split(x, chr(10))) AS line FROM d)),
m AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM l JOIN k USING (digest) GROUP BY r)
SELECT doc_id, sha256({line('x')}) AS digest, k.license, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM d LEFT JOIN m USING (r) LEFT JOIN k ON k.digest = sha256({line('x')})"""


ORACLE = _sql()
