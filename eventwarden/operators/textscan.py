"""Text columns: instruction-shaped content, secrets, and citations without ground."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.functions.net import let

EXCERPT_MARGIN = 40
EXCERPT_LENGTH = 200

# What instruction-shaped content looks like, and its label. A blank stands for any run of
# blanks, underscores, hyphens, dots, plus signs or URL blanks. The last entry of each row lists literals one of
# which every match holds; they are looked for before the pattern is tried.
_GAP = r"(?:[\s_\-.+]|%20|\+)+"
_PATTERNS = [
    (r"ignore (all )?(previous|prior|above|earlier|preceding) (instructions?|prompts?|rules?)", "instruction override attempt", ["ignore"]),
    (r"disregard (all )?(previous|prior|the above|everything)", "instruction override attempt", ["disregard"]),
    (r"forget (all |everything )?(you|your|previous|prior)", "instruction override attempt", ["forget"]),
    (r"you are now (a|an|the)?", "role reassignment attempt", ["now"]),
    (r"new (system )?(prompt|instructions?|role)", "role reassignment attempt", ["prompt", "instruction", "role"]),
    (r"(act|behave|respond) as (a|an|if)", "role reassignment attempt", ["act", "behave", "respond"]),
    (r"\b(system|assistant|developer)\s*:\s*\S", "role marker in data", ["system", "assistant", "developer"]),
    (r"</?(system|instructions?|prompt|im_start|im_end)>", "prompt tag in data", ["<"]),
    (r"(drop|delete|truncate) (table|database|from)", "destructive database statement in data", ["drop", "delete", "truncate"]),
    (r"(reveal|print|output|repeat|show|disclose) (your|the) (system )?(prompt|instructions?|rules)", "prompt disclosure attempt",
     ["prompt", "instruction", "rules"]),
    (r"\b(api[_\-\s]?key|secret|password|passwd|token|credential)s?\b\s*[:=]\s*\S", "credential-shaped content",
     ["api", "secret", "passw", "token", "credential"]),
    (r"<<<END_UNTRUSTED_TELEMETRY>>>", "data delimiter in content", ["<<<"]),
    (r"mark (this|the) (incident|alert|event) as (benign|false positive|resolved|safe)", "verdict manipulation attempt", ["mark"]),
    (r"(this|the) (incident|alert|activity) is (benign|authorized|expected|safe)", "verdict manipulation attempt",
     ["incident", "alert", "activity"]),
    (r"do not (report|alert|flag|escalate|log|mention)", "suppression attempt", ["report", "alert", "flag", "escalate", "log", "mention"]),
    (r"(close|dismiss|suppress) (this|the) (incident|alert)", "suppression attempt", ["close", "dismiss", "suppress"]),
    (r"(^|\n)\s*#{1,6}\s*(system|assistant|user|developer|instructions?)\b", "role header in data", ["#"]),
    (r"#{2,}\s*(system|assistant|developer)\s*#{2,}", "role header in data", ["##"]),
    (r"(execute|run|eval|exec) (the )?(following|this|these) (command|code|script|shell)", "command execution request in data",
     ["command", "code", "script", "shell"]),
    (r"(execute|run) (the )?(command|shell|code)\s*[:=]", "command execution request in data", ["command", "code", "shell"]),
    (r"<<<UNTRUSTED_TELEMETRY>>>", "data delimiter in content", ["<<<"]),
    (r"</\s*(untrusted[_\s-]?telemetry|evidence|data|context)\s*>", "data delimiter in content", ["</"]),
]
SIGNALS: list[tuple[str, str]] = [("(?i)" + p.replace(" ", _GAP), label) for p, label, _ in _PATTERNS]
NEEDLES = [words for _, _, words in _PATTERNS]

# Secrets in text and what replaces them.
REDACTIONS = [
    (r"(?i)(authorization\s*[:=]\s*bearer\s+)\S+", "$1[REDACTED]"),
    (r"(?i)\b(sk-[A-Za-z0-9_\-]{8,})", "[REDACTED_API_KEY]"),
    (r"(?i)\b(AKIA[0-9A-Z]{16})\b", "[REDACTED_ACCESS_KEY]"),
    (r"(?i)((?:api[_-]?key|secret|password|passwd|token)\"?\s*[:=]\s*\"?)([^\s\",}]+)", "$1[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b", "[REDACTED_JWT]"),
]

REDACTION_NEEDLES = [["authorization"], ["sk-"], ["akia"], ["api", "secret", "passw", "token"], ["eyj"]]

# Shapes of the ids an answer may cite.
CITABLE = [r"^EVT-[A-Z0-9\-]{4,32}$", r"^ALT-[A-Z0-9\-]{4,32}$", r"^INC-\d{4}-\d{4,}$", r"^IOC-[A-Z0-9\-]{4,32}$"]
CITABLE_TECHNIQUE = r"^T\d{4}(\.\d{3})?$"


def scan(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per (row, signal pattern) found in the whole text, with the text around the first match.

    A pattern is tried only on texts holding a literal it needs, and position and excerpt are worked out only
    where it hit.
    """
    subject = F.col(f"`{text}`")
    df = df.withColumn("_low", F.lower(subject))
    found = []
    for index, (pattern, label) in enumerate(SIGNALS):
        maybe = reduce(or_, [F.col("_low").contains(n) for n in NEEDLES[index]])
        start = F.regexp_instr(subject, F.lit(pattern))
        length = F.length(F.regexp_substr(subject, F.lit(pattern)))
        begin = F.greatest(start - EXCERPT_MARGIN, F.lit(1))
        excerpt = subject.substr(begin, start + length + EXCERPT_MARGIN - begin).substr(F.lit(1), F.lit(EXCERPT_LENGTH))
        found.append(F.when(maybe & subject.rlike(pattern), F.struct(
            F.lit(index).alias("pattern"), F.lit(label).alias("signal"), excerpt.alias("excerpt"))))
    hits = F.explode(F.array_compact(F.array(*found)))
    return df.select(*keep, hits.alias("h")).select(*keep, "h.*")


def redact(text: Column) -> Column:
    """Secrets replaced, in order; a pattern runs only on texts holding a literal it needs."""
    def step(pattern: str, replacement: str, needles: list[str]):
        def replace(t: Column) -> Column:
            maybe = reduce(or_, [F.lower(t).contains(n) for n in needles])
            return F.when(maybe, F.regexp_replace(t, pattern, replacement)).otherwise(t)
        return replace

    out = text
    for (pattern, replacement), needles in zip(REDACTIONS, REDACTION_NEEDLES):
        out = let(out, step(pattern, replacement, needles))
    return out


def ground_citations(cited: DataFrame, allowed: DataFrame, technique: bool = False) -> DataFrame:
    """Cited ids kept (well-formed and in the answer's evidence) and dropped, per answer.

    ``cited(answer_id, position, identifier)``; ``allowed(answer_id, identifier)``. Evidence stays in rows,
    so an answer may draw on any amount of it.
    """
    clean = F.upper(F.trim("identifier")) if technique else F.trim("identifier")
    shapes = [CITABLE_TECHNIQUE] if technique else CITABLE
    rows = cited.withColumn("identifier", clean).withColumn(
        "well_formed", reduce(or_, [F.col("identifier").rlike(s) for s in shapes]))
    known = allowed.select("answer_id", "identifier").distinct().withColumn("known", F.lit(True))
    judged = rows.join(known, ["answer_id", "identifier"], "left").withColumn(
        "kept", F.col("well_formed") & F.coalesce("known", F.lit(False)))
    pick = lambda test, name: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("position", "identifier")))), lambda x: x["identifier"]).alias(name)
    return judged.groupBy("answer_id").agg(pick(F.col("kept"), "kept"), pick(~F.col("kept"), "dropped"))
