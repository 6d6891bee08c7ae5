"""Column expressions for text: whitespace strip, boilerplate removal and the
sentence boundary rule. All JVM-side regular expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference for equal results.
# Publisher boilerplate removed from abstracts and titles, in this order,
# joined by "|" and matched case-insensitively; each match becomes one space.
BOILERPLATE_PATTERNS = [
    r"©\s*\d{4}.*",
    r"All rights reserved.*",
    r"Published by Elsevier.*",
    r"This is an open access article.*",
    r"doi:.*",
    r"https?://\S+",
    r"www\.\S+",
    r"^\s*\d+\s*$",
    r"^\s*[A-Z]{2,}\s*$",
    r"Abstract\s*[:.]?\s*",
    r"Keywords\s*[:.]?\s*",
    r"Introduction\s*[:.]?\s*",
    r"Conclusions?\s*[:.]?\s*",
    r"References?\s*[:.]?\s*",
    r"Acknowledgements?\s*[:.]?\s*",
    r"Funding\s*[:.]?\s*",
    r"Conflict of interest.*",
    r"Author contributions?.*",
    r"Corresponding author.*",
    r"E-mail address.*",
    r"Received\s+\d+",
    r"Accepted\s+\d+",
]
# Sentences must be strictly longer than this many characters to be kept.
MIN_SENTENCE_CHARS = 30
# ---------------------------------------------------------------------------

# Scholarly abbreviations whose final dot does not end a sentence (the
# reference's trained tokenizer knows such abbreviations; this short list
# covers the common ones in abstracts). Words that often end sentences
# ("etc.", "no.") are left out on purpose.
ABBREVIATIONS = ["e.g", "i.e", "et al", "cf", "vs", "fig", "figs", "eq", "eqs", "vol", "pp", "approx",
                 "resp", "incl", "dr", "mr", "mrs", "ms", "prof"]
ABBREV_REGEX = r"(?i)\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\."
KEEP = "\u0002"   # stands in for an abbreviation's dot while splitting

# Java regex flags giving Python `re` semantics on str patterns:
# i = ignore case, u = Unicode case folding, d = only "\n" ends a line (so "."
# and "$" treat CR, U+0085, U+2028 like Python does), U = Unicode \s \d \w.
PY_FLAGS = "(?iudU)"
# Where a pattern can begin: the start of the text, or the first letters of one (with the letters beyond ASCII that fold to them). Looked at first,
# so that the patterns themselves are tried in few places.
BOILERPLATE_START = ("(?-iu:(?=^|©|[aA](?:[lL][lL]|[bB][sS\u017f]|[cC][kK\u212acC]|[uU][tT])|[pP][uU][bB]|[tT][hH][iI\u0130\u0131]|[dD][oO][iI\u0130\u0131]"
                     "|[hH][tT][tT]|[wW][wW][wW]|[kK\u212a][eE][yY]|[iI\u0130\u0131][nN][tT]|[cC][oO][nNrR]|[rR][eE][fFcC]|[fF][uU][nN]|[eE]-[mM]))")
BOILERPLATE_REGEX = PY_FLAGS + BOILERPLATE_START + "(?:" + "|".join(BOILERPLATE_PATTERNS) + ")"
# What ``\s`` is under (?U): Unicode's white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"

# Sentence boundary: a run of terminal punctuation, optional closing quotes or
# brackets, then whitespace. The boundary is replaced by the punctuation plus a
# U+0001 marker that `split` cuts on (the marker never occurs in text).
SENTENCE_END_REGEX = r"(?U)([.!?]+[\"')\]]*)\s+"
MARK = "\u0001"


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends. ``trim`` strips
    only U+0020, which is not the same thing. NULL stays NULL."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def strip_boilerplate_expr(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return py_strip(F.regexp_replace(col, BOILERPLATE_REGEX, " "))


def sentence_array_expr(c: Column | str) -> Column:
    """Array of raw sentence pieces (not yet stripped/filtered) of a text:
    abbreviation dots are protected (``KEEP``), boundaries marked and the text
    split. Restore the dots in each piece with ``restore_dots``."""
    col = F.col(c) if isinstance(c, str) else c
    protected = F.regexp_replace(col, ABBREV_REGEX, "$1" + KEEP)
    return F.split(F.regexp_replace(protected, SENTENCE_END_REGEX, "$1" + MARK), MARK)


def restore_dots(c: Column | str) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(KEEP), F.lit("."))
