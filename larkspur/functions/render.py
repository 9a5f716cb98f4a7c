"""Display text of citations, steps and event lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of the question steps and of the answer sections.
STEP_LABELS = {
    "cmo_router": "CMO Router",
    "medical_librarian": "Medical Librarian",
    "clinical_biostatistician": "Clinical Biostatistician",
    "lead_researcher": "Lead Researcher",
    "peer_reviewer": "Peer Reviewer",
    "finalize": "Finalize",
}
SECTION_LABELS = {
    "background": "Background",
    "evidence": "Evidence",
    "statistics": "Statistics",
    "conclusion": "Conclusion",
}


def score_text(score: Column) -> Column:
    """Score with three decimals, rounded in decimal arithmetic so every engine prints the same digits."""
    return F.coalesce(score, F.lit(0.0)).cast("decimal(18,6)").cast("decimal(18,3)").cast("string")


def citation_badge(citation: Column) -> Column:
    return F.concat(
        F.lit("["), F.coalesce(citation["type"], F.lit("unknown")), F.lit("] "), F.coalesce(citation["id"], F.lit("?"))
    )


def citation_detail(citation: Column) -> Column:
    """Badge, score and title lines, then quote, full content and snapshot where they are non-empty."""

    def given(name: str) -> Column:
        return F.nullif(citation[name], F.lit(""))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("**"), citation_badge(citation), F.lit("** (score: "), score_text(citation["score"]), F.lit(")")),
        F.concat(F.lit("*"), F.coalesce(citation["title"], F.lit("N/A")), F.lit("*")),
        F.concat(F.lit("> "), given("snippet")),
        F.concat(F.lit("\n**Full Content:**\n"), given("content")),
        F.concat(F.lit("\nsnapshot: `"), given("snapshot_ref"), F.lit("`")),
    )


def step_label(step: Column) -> Column:
    """Display name of a step; unknown names pass through."""
    pairs = [F.lit(x) for pair in STEP_LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), step), step)


EVENT_SCHEMA = "node STRING, elapsed_ms BIGINT, query_id STRING, status STRING, summary STRING, agent STRING"


def parse_event_line(line: Column, schema: str = EVENT_SCHEMA) -> Column:
    """Struct from a ``data:{json}`` line; null for other lines and for malformed JSON."""
    body = F.trim(F.substr(line, F.lit(6)))
    valid = F.try_parse_json(body).isNotNull()
    return F.when(line.startswith("data:") & valid, F.from_json(body, schema))
