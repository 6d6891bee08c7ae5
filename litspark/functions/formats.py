"""Output text formats, rendered as Spark ``concat`` expressions.

``fmt("TOPIC {id} (size={size})", id=col1, size=col2)`` splits the template at
its placeholders and concatenates literal pieces and columns (JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Text formats that must equal the reference's output.
DEFAULT_TOPIC_LABEL = "Topic {id}"
TOPIC_CODE = "T{id}"
TOPIC_BLOCK_HEAD = "TOPIC {id} (size={size}, papers={papers}):"
EVIDENCE_LINE = "  - {sentence}"
PROPOSAL_BLOCK_HEAD = "TOPIC {id} (size={size}):"
PROPOSAL_LINE = "  Model {k}: {label} | {reasoning}"
THEME_BLOCK = "THEME: {name}\nSentences: {sentences}"
TAXONOMY_EVIDENCE = "→ {match} | {reasoning}"
THEME_LINE = "- {name} ({n} sentences) {tag}"
NOVEL_TAG = "[NOVEL]"
MAPPED_TAG = "[PAJAIS: {match}]"
MAPPED_LINE = "{name} → {match} (conf={conf}, {n} sentences, {papers} papers)"
NOVEL_LINE = "{name} — NOT in PAJAIS taxonomy ({n} sentences, {papers} papers)"
AGENDA_LINE = "{i}. {name}"
# ---------------------------------------------------------------------------

_PLACEHOLDER = re.compile(r"(\{\w+\})")


def fmt(template: str, **cols: Column) -> Column:
    parts = []
    for piece in _PLACEHOLDER.split(template):
        if not piece:
            continue
        m = re.fullmatch(r"\{(\w+)\}", piece)
        parts.append(cols[m.group(1)].cast("string") if m else F.lit(piece))
    return F.concat(*parts)
