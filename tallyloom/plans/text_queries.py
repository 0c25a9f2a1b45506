"""Queries over redaction, labels and replies, with the SQL that gives the same rows where SQL has the patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import redact
from ..operators import replies
from .queries import registered

#: Token-like values in pieces, so that no file holds one whole.
PIECES = (("AK", "IA", "ABCDEFGH12345678"), ("gh", "p_", "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"), ("gl", "pat-", "abcdefghij0123456789"), ("np", "m_", "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"), ("xo", "xb-", "1234567890-abc"), ("AI", "za", "abcdefghijklmnopqrstuvwxyz012345"), ("ya", "29.", "abcdefghijklmnopqrstuvwxyz"))
PLANT = " ".join("".join(p) for p in PIECES[:1])


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one token each, by number; and a password in a URL."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token = F.element_at(F.array(*(F.concat(*map(F.lit, p)) for p in PIECES)), (F.col("doc_id") % len(PIECES) + 1).cast("int"))
    return d.select("doc_id", F.concat("text", F.lit(" "), token, F.lit(" https://bob:pw"), F.col("doc_id").cast("string"), F.lit("x@host/ end")).alias("text"))


_PLANTED = "p AS (SELECT doc_id, text || ' ' || ([" + ", ".join(" || ".join(f"'{x}'" for x in p).join("()") for p in PIECES) + f"])[doc_id % {len(PIECES)} + 1] || ' https://bob:pw' || doc_id || 'x@host/ end' AS text FROM documents)"


def _replaced(x: str, patterns, by: str = "[REDACTED]") -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '{by}', 'g')"
    return x


@registered("redact_prefix_tokens", f"WITH {_PLANTED} SELECT doc_id, {_replaced('text', redact.TOKENS)} AS text FROM p")
def redact_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("text")
    for p in redact.TOKENS:
        out = F.regexp_replace(out, p, r"\[REDACTED\]")
    return planted(spark, sf_dir).select("doc_id", out.alias("text"))


_URL_SQL = r"""(?i)(\b[a-z][a-z0-9+.-]*://[^/\s:@''"]+:)([^@\s/''"]{3,})@"""


@registered("redact_url_password", f"WITH {_PLANTED} SELECT doc_id, regexp_replace(text, '{_URL_SQL}', '\\1[REDACTED]@', 'g') AS text FROM p")
def redact_url_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", F.regexp_replace("text", redact.URL_PASSWORD, r"$1\[REDACTED\]").alias("text"))


_QUOTED_SQL = r"""(?i)([A-Za-z0-9_.-]*(?:key|secret|token|passw(?:or)?d|pwd|credential|auth|private)[A-Za-z0-9_.-]*["'']?\s*[:=]\s*["''`])([^"''`\s]{12,})(["''`])"""


@registered("redact_quoted_value", f"SELECT doc_id, regexp_replace(text, '{_QUOTED_SQL}', '\\1[REDACTED]\\3', 'g') AS text FROM documents")
def redact_quoted_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.regexp_replace("text", redact.QUOTED_VALUE, r"$1\[REDACTED\]").alias("text"))


@registered("redaction_counts", f"WITH {_PLANTED} SELECT doc_id, " + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in redact.TOKENS) + " AS n FROM p")
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sum((F.regexp_count("text", F.lit(p)) for p in redact.TOKENS), F.lit(0))
    return planted(spark, sf_dir).select("doc_id", n.cast("bigint").alias("n"))


_WORDS = "key|secret|token|passw(?:or)?d|pwd|credential|auth|private"
# A value of 12 or more characters with a digit, by where its first digit stands: this engine has no look-ahead.
_DIGITS = "|".join([f"[A-Za-z_+/=.-]{{{k}}}[0-9][A-Za-z0-9_+/=.-]{{{max(0, 11 - k)},}}" for k in range(12)] + ["[A-Za-z_+/=.-]{12,}[0-9][A-Za-z0-9_+/=.-]*"])
_NAME_END = r"""(?:[A-Za-z0-9_.-]*(?:passw(?:or)?d|passphrase)|(?:[A-Za-z0-9_.-]*[_.-])?(?:pass|pwd))\\?["'']?[ \t]*[:=]"""
_NEXT_NAME = r"""[,; \t][ \t]*\\?["'']?[A-Za-z_][A-Za-z0-9_.-]*\\?["'']?[ \t]*[:=]"""
_FIRST_STEPS = (
    *((p.replace(r"\z", "$").replace("'", "''"), "[REDACTED]") for p in redact.ARMOR), *((p, "[REDACTED]") for p in redact.TOKENS),
    (redact.SCHEME_VALUE, r"\1[REDACTED]"), (_URL_SQL, r"\1[REDACTED]@"), (_QUOTED_SQL, r"\1[REDACTED]\3"),
    (rf"(?i)([A-Za-z0-9_.-]*(?:{_WORDS})[A-Za-z0-9_.-]*\s*[:=]\s*)(?:{_DIGITS})", r"\1[REDACTED]"),
    *((rf"""(?i)({_NAME_END}[ \t]*{q})(?:[^\\\r\n{q}]|\\[^\r\n])+""", r"\1[REDACTED]") for q in ('"', "''", "`")),
    (rf"""(?i)((?:^|[^A-Za-z0-9_.-]){_NAME_END}[ \t]*)[^\r\n"''`\\=>\t ][^\r\n"''`]*?($|[\r\n"''`]|{_NEXT_NAME})""", r"\1[REDACTED]\2"),
)
_ASSIGNMENT = (r"""(?i)(\b[A-Za-z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL)[A-Za-z0-9_]*(?:\\?["''])?\s*[=:]\s*(?:\\?["''])?)[A-Za-z0-9._/+~-]{12,}""", r"\1[REDACTED]")
_BARE = "list_reduce(list_prepend({0}, list_filter(regexp_extract_all({0}, '\\b[A-Za-z0-9]{{32,}}\\b'), lambda m: regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]'))), lambda acc, m: replace(acc, m, '[REDACTED]'))"


def _shape_sql(p: str) -> tuple[str, str]:
    """A shape without the look-arounds that this engine lacks."""
    if p == redact.SHAPES[14]:
        return r"(^|[^0-9])[0-9]{8,10}:[A-Za-z0-9_-]{35}($|[^A-Za-z0-9_-])", r"\1[REDACTED]\2"
    if p == redact.SHAPES[15]:
        return p.replace("(?=@)", "@"), r"\1[REDACTED]@"
    if p == redact.SHAPES[20]:
        return p.replace("(?![A-Za-z0-9/+=])", "($|[^A-Za-z0-9/+=])").replace("'", "''"), r"\1[REDACTED]\2"
    return p, "[REDACTED]"


def _stepwise(table: str, steps, last: str = "text") -> str:
    """One expression for each step, as steps of a common table each: nested ones would be evaluated again and again."""
    out, now = [], table
    for i, (p, by) in enumerate(steps):
        out.append(f"s{i} AS MATERIALIZED (SELECT doc_id, " + (p if by is None else f"regexp_replace(text, '{p}', '{by}', 'g')") + f" AS text FROM {now})")
        now = f"s{i}"
    return ", ".join(out) + f" SELECT doc_id, {last} FROM {now}"


_SECOND_STEPS = (_ASSIGNMENT, *_FIRST_STEPS, *_FIRST_STEPS[:3], *map(_shape_sql, redact.SHAPES), (_BARE.format("text"), None), _ASSIGNMENT)
_MARKS = "(length({0}) - length(replace({0}, '[REDACTED]', ''))) // 10"


@registered("redact_full", f"WITH {_PLANTED}, {_stepwise('p', _FIRST_STEPS, 'text, ' + _MARKS.format('text') + ' AS marks')}")
def redact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps, and how many marks a text has then."""
    out = redact.redact(planted(spark, sf_dir), "text")
    return out.select("doc_id", "text", F.regexp_count("text", F.lit(r"\[REDACTED\]")).cast("bigint").alias("marks"))


@registered("redact_values", f"WITH {_PLANTED}, {_stepwise('p', _SECOND_STEPS)}")
def redact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact_values(planted(spark, sf_dir), "text")


@registered("residual_shapes", f"WITH {_PLANTED} SELECT doc_id, true AS token_before, false AS token_after, false AS shape_after FROM p")
def residual_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the token planted in each, ``ya29.`` ones too, shows before redaction, and no token or shape afterwards."""
    token = redact.has_token(F.col("text"))
    p = planted(spark, sf_dir).withColumn("token_before", token)
    return redact.redact_values(p, "text").select("doc_id", "token_before", token.alias("token_after"), redact.has_shape(F.col("text")).alias("shape_after"))


@registered("parse_reply", """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'no JSON' WHEN turn % 4 = 1 THEN NULL WHEN turn % 4 = 2 THEN 'record 0: a cap needs a change' ELSE NULL END AS error, CASE WHEN turn % 4 IN (1, 3) THEN 2 WHEN turn % 4 = 2 THEN 0 ELSE 0 END AS n FROM conversations""")
def parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of four forms: no JSON, fenced, incomplete, with a kind twice."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fix = '{"kind":"fix","summary":"s"}'
    reply = F.when(F.col("turn") % 4 == 0, "sorry").when(F.col("turn") % 4 == 1, '```json\n{"records":[{"kind":"cap","change":"new","name":"n","summary":"s"},' + fix + "]}\n```").when(F.col("turn") % 4 == 2, '{"records":[{"kind":"cap","name":"n","summary":"s"}]}').otherwise('{"records":[' + fix + "," + fix + ',{"kind":"tend","summary":"s"}]}')
    return c.select("conv_id", "turn", replies.parsed(reply).alias("p")).select("conv_id", "turn", F.col("p.error").alias("error"), F.size("p.records").alias("n"))


@registered("label_examples", """WITH l AS (SELECT doc_id, (['- [cap:new] text', '- [cap:deepened] ', '- [fix] mended', '- [tend:new] text', '- [cap] text', 'plain', '- [cap:regressed] slower', '- [other] text'])[doc_id % 8 + 1] || CASE WHEN doc_id % 8 IN (0, 2, 6) THEN ' ' || doc_id ELSE '' END AS line FROM documents)
SELECT doc_id, CASE doc_id % 8 WHEN 2 THEN 'fix' WHEN 0 THEN 'cap' WHEN 6 THEN 'cap' END AS kind, CASE doc_id % 8 WHEN 0 THEN 'new' WHEN 6 THEN 'regressed' END AS change, CASE doc_id % 8 WHEN 0 THEN 'text ' || doc_id WHEN 2 THEN 'mended ' || doc_id WHEN 6 THEN 'slower ' || doc_id END AS text, doc_id % 8 IN (0, 2, 6) AS ok FROM l WHERE doc_id % 8 <> 5""")
def label_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forms = ("- [cap:new] text", "- [cap:deepened] ", "- [fix] mended", "- [tend:new] text", "- [cap] text", "plain", "- [cap:regressed] slower", "- [other] text")
    line = F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % 8 + 1).cast("int")), F.when((F.col("doc_id") % 8).isin(0, 2, 6), F.concat(F.lit(" "), F.col("doc_id").cast("string"))).otherwise(""))
    e = replies.label(line)
    return d.select("doc_id", e.alias("e")).filter("e is not null").select("doc_id", "e.kind", "e.change", "e.text", F.col("e.problem").isNull().alias("ok"))
