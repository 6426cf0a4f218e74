"""Column-level text functions.  Every function maps Column -> Column and
stays inside whole-stage codegen (no Python per row).

The regular expressions are written so that Java regex (Spark) and RE2
(the DuckDB oracle) give identical matches: no look-behind, no possessive
quantifiers, Unicode classes only through \\p{L} / \\p{N}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must stay as written for parity with the oracle and the
# reference's text handling).
TOKEN_PATTERN = r"[\p{L}\p{N}]+"          # analyzer: letters/digits runs, lower-cased
NON_TOKEN_PATTERN = r"[^a-zA-Z0-9\p{L}\p{N}]+"    # its complement (split form, same tokens; ASCII is tried first)
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"     # sentence = run up to terminal punctuation
WORD_PATTERN = r"\S+"                     # whitespace word
CONTROL_PATTERN = r"[\n\r\t]"             # each control char -> one space
PASSAGE_PROMPT = "Passage: "
QUESTION_PROMPT = "Question: "
SUBJECT_PREFIX = "subject: "
BODY_PREFIX = " body: "
SECTION_MARKER = "_parentSection"
TITLE_SKIP = 6                            # title[6:...] in the title slice
EOS = "</s>"
ASCII_SPACE = " \t\n\x0b\f\r"             # what \\s matches
LINE_ENDS = ("\u0085", "\u2028", "\u2029")  # before which $ matches, and that \\s does not


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """Lower-cased letter/digit runs (the default analyzer).  Written as a
    split on the complement class minus empty pieces: the same tokens as
    ``regexp_extract_all(lower(c), TOKEN_PATTERN)``, about twice as fast."""
    return F.array_remove(F.split(F.lower(_c(c)), NON_TOKEN_PATTERN), "")


def sentences(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(SENTENCE_PATTERN), 0)


def words(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(WORD_PATTERN), 0)


def word_count(c) -> Column:
    return F.size(words(c)).cast("bigint")


def char_count(c) -> Column:
    return F.length(_c(c)).cast("bigint")


def clean_control(c) -> Column:
    """Each of \\n \\r \\t becomes one space (runs are not collapsed)."""
    return F.regexp_replace(_c(c), CONTROL_PATTERN, " ")


def null_to_empty(c) -> Column:
    """Our rule for missing text: null -> '' (never the string 'None')."""
    return F.coalesce(_c(c), F.lit(""))


def subject_of(c, n: int = 6) -> Column:
    """First ``n`` whitespace words, joined by one space.  An anchored match
    reads only the head of the text instead of splitting all of it."""
    head = F.regexp_extract(_c(c), r"^\s*(\S+(?:\s+\S+){0,%d})" % (n - 1), 1)
    return F.regexp_replace(head, r"\s+", " ")


def compose_subject_body(subject, body) -> Column:
    """P2: 'subject: <s> body: <cleaned body>'."""
    return F.concat(F.lit(SUBJECT_PREFIX), null_to_empty(subject), F.lit(BODY_PREFIX),
                    clean_control(null_to_empty(body)))


def compose_contents(subject, body) -> Column:
    """BM25 document contents 'subject\\nbody' (nulls as '')."""
    return F.concat(null_to_empty(subject), F.lit("\n"), null_to_empty(body))


def compose_textrank_input(subject, body) -> Column:
    """P4: 'subject \\n body'."""
    return F.concat(null_to_empty(subject), F.lit(" \n "), null_to_empty(body))


def _drop_head(c: Column, n: int) -> Column:
    return c.substr(F.lit(n + 1), F.lit(1 << 30))


def strip_prompt(c) -> Column:
    """Drop a leading 'Passage: ' then, on the result, a leading 'Question: '."""
    c = _c(c)
    once = F.when(c.startswith(PASSAGE_PROMPT), _drop_head(c, len(PASSAGE_PROMPT))).otherwise(c)
    return F.when(once.startswith(QUESTION_PROMPT),
                  _drop_head(once, len(QUESTION_PROMPT))).otherwise(once)


def title_slice(c) -> Column:
    """Python ``t[6:t.find(marker)]`` on the stripped title.  A missing
    marker gives find = -1, i.e. the slice stops one char before the end."""
    t = strip_ws(c)
    pos = F.locate(SECTION_MARKER, t) - 1            # python find(): -1 when absent
    stop = F.when(pos < 0, F.length(t) - 1).otherwise(pos)
    take = F.greatest(stop - TITLE_SKIP, F.lit(0))
    return t.substr(F.lit(TITLE_SKIP + 1), take)


def strip_ws(c) -> Column:
    """python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def strip_ends(c) -> Column:
    """``strip_ws`` of a plain column by looking at its ends only; the expression
    takes the texts where ``$`` stands before the end."""
    c = _c(c)
    before_end = c.endswith(LINE_ENDS[0]) | c.endswith(LINE_ENDS[1]) | c.endswith(LINE_ENDS[2])
    return F.when(before_end, strip_ws(c)).otherwise(F.trim(c, F.lit(ASCII_SPACE)))


def flatten_newlines(c) -> Column:
    """``s.strip().replace('\\n', ' ')``."""
    return F.regexp_replace(strip_ws(c), "\n", " ")


def role_prefix(prefix: str, *parts) -> Column:
    """P6: 'Passage: {text}', 'Passage: {title}</s>{passage}', 'Question: {q}'."""
    cols = [F.lit(prefix)]
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(EOS))
        cols.append(null_to_empty(p))
    return F.concat(*cols)


def token_truncate(c, max_length: int) -> Column:
    """Analyzer tokens cut to the first ``max_length``."""
    return F.slice(tokens(c), 1, max_length)
