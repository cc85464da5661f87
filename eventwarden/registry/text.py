"""Scans over the document, conversation and page tables: whole texts, every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventwarden.operators.textscan import REDACTIONS, SIGNALS, ground_citations, redact, scan
from eventwarden.plans.desk import STRETCH, desk
from eventwarden.registry.base import query
from eventwarden.registry.sql import with_cases
from eventwarden.sources.bridge import read_table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _scan_sql(table: str, ids: str, column: str) -> str:
    rows = ", ".join(f"({i}, {_quoted(p)}, {_quoted(label)})" for i, (p, label) in enumerate(SIGNALS))
    # the first match is found by splitting the text around it
    return f"""
WITH p AS (SELECT * FROM (VALUES {rows}) t(pattern, rx, signal)),
m AS (SELECT {ids}, {column} AS txt, pattern, signal, regexp_extract({column}, rx) AS hit FROM {table}, p WHERE regexp_matches({column}, rx))
SELECT {ids}, CAST(pattern AS BIGINT) AS pattern, signal, substr(substr(txt, greatest(1, strpos(txt, hit) - 40), strpos(txt, hit) + length(hit) + 40 - greatest(1, strpos(txt, hit) - 40)), 1, 200) AS excerpt FROM m"""


def _scan(spark, sf_dir, table, column, keep):
    found = scan(read_table(spark, sf_dir, table), column, keep)
    return found.withColumn("pattern", F.col("pattern").cast("bigint"))


@query("instruction_scan_documents", _scan_sql("documents", "doc_id", "text"))
def instruction_scan_documents(spark, sf_dir):
    return _scan(spark, sf_dir, "documents", "text", ["doc_id"])


@query("instruction_scan_conversations", _scan_sql("(SELECT conv_id, turn, role || ': ' || text AS line FROM conversations)", "conv_id, turn", "line"))
def instruction_scan_conversations(spark, sf_dir):
    """Turns as transcript lines, role first."""
    lines = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line"))
    return scan(lines, "line", ["conv_id", "turn"]).withColumn("pattern", F.col("pattern").cast("bigint"))


@query("instruction_scan_pages", _scan_sql("pages", "page_id", "html"))
def instruction_scan_pages(spark, sf_dir):
    return _scan(spark, sf_dir, "pages", "html", ["page_id"])


def _redact_sql(column: str) -> str:
    out = column
    for pattern, replacement in REDACTIONS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(replacement.replace('$', chr(92)))}, 'g')"
    return out


@query("redact_documents", f"""
SELECT doc_id, md5({_redact_sql('text')}) AS digest, {_redact_sql('text')} <> text AS changed FROM documents""")
def redact_documents(spark, sf_dir):
    """Every document with its secrets replaced, as a digest of the whole result."""
    clean = redact(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), (clean != F.col("text")).alias("changed"))


@query("redact_conversations", f"SELECT conv_id, turn, md5({_redact_sql('line')}) AS digest FROM (SELECT conv_id, turn, 'token=' || role || ' ' || text AS line FROM conversations)")
def redact_conversations(spark, sf_dir):
    """Turns with their role written as a secret, redacted."""
    line = F.concat(F.lit("token="), "role", F.lit(" "), "text")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(redact(line)).alias("digest"))


@query("citation_grounding", with_cases("""
SELECT incident_id AS answer_id, coalesce(string_agg(event_id, ',' ORDER BY pos) FILTER (ok), '') AS kept, coalesce(string_agg(event_id, ',' ORDER BY pos) FILTER (NOT ok), '') AS dropped
FROM (SELECT *, regexp_matches(event_id, '^EVT-[A-Z0-9-]{4,32}$') AND own AS ok FROM (
  SELECT incident_id, event_id, row_number() OVER (PARTITION BY incident_id ORDER BY us, event_id) * 2 AS pos, TRUE AS own FROM ie JOIN ev USING (e) WHERE e % 5 <> 4
  UNION ALL SELECT incident_id, event_id || 'X', row_number() OVER (PARTITION BY incident_id ORDER BY us, event_id) * 2 + 1, FALSE FROM ie JOIN ev USING (e) WHERE e % 5 <> 4)) GROUP BY 1""", STRETCH))
def citation_grounding(spark, sf_dir):
    """Answers citing their incident's events and an invented twin of each."""
    events = desk(spark, sf_dir).incident_events.select("incident_id", "event_id", "us")
    number = F.expr("cast(substring(event_id, 5) as bigint)")
    from eventwarden.operators.groups import numbered

    own = numbered(events.filter(number % 5 != 4).withColumn("day", F.expr("us div 86400000000")), ["incident_id"], "day", ["us", "event_id"], "n")
    cited = own.select(F.col("incident_id").alias("answer_id"), F.explode(F.array(
        F.struct((F.col("n") * 2).alias("position"), F.concat(F.lit(" "), "event_id").alias("identifier")),
        F.struct((F.col("n") * 2 + 1).alias("position"), F.concat("event_id", F.lit("X")).alias("identifier")),
    )).alias("x")).select("answer_id", "x.*")
    allowed = events.select(F.col("incident_id").alias("answer_id"), F.col("event_id").alias("identifier"))
    out = ground_citations(cited, allowed)
    return out.select("answer_id", F.array_join("kept", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))
