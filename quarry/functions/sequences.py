"""Token-sequence functions (P13-P18) as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import EOS
from quarry.operators.order import global_row_number

# Special tokens.
PAD = "<pad>"
IGNORE = "-100"          # label positions excluded from the loss
UNK = "<unk>"
SEP = "</s>"
WORD_MARKER = "▁"   # sentencepiece word-start marker
SPECIAL = (PAD, EOS, UNK)
NUMERIC_TOKEN = r"^▁?[0-9]*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unmask(seq) -> Column:
    """P13 step 1: ignore marker -> pad token."""
    return F.transform(_c(seq), lambda x: F.when(x == IGNORE, F.lit(PAD)).otherwise(x))


def pad_to(seq, length: int, pad: str = PAD) -> Column:
    """Right-pad with ``pad`` or cut to ``length``."""
    s = _c(seq)
    short = F.greatest(F.lit(length) - F.size(s), F.lit(0))
    return F.slice(F.concat(s, F.array_repeat(F.lit(pad), short)), 1, length)


def batch_pad(df: DataFrame, order: str, seq: str, batch_size: int) -> DataFrame:
    """Consecutive rows (by ``order``) form batches; inputs padded to
    the batch's longest with the pad token, labels with the ignore marker.
    Only the ``order`` ids are numbered (no single-task window); sequences are
    joined to their numbers."""
    numbered = global_row_number(df.select(order), [order])
    b = df.join(numbered, order).withColumn("batch", F.floor((F.col("rn") - 1) / batch_size).cast("bigint"))
    longest = F.max(F.size(seq)).over(Window.partitionBy("batch"))
    b = b.withColumn("_len", longest)
    fill = F.col("_len") - F.size(seq)
    return b.select(order, "batch",
                    F.concat(F.col(seq), F.array_repeat(F.lit(PAD), fill)).alias("input_padded"),
                    F.concat(F.col(seq), F.array_repeat(F.lit(IGNORE), fill)).alias("labels_padded"))


def decode(seq) -> Column:
    """Drop special tokens, join by space, trim."""
    kept = F.filter(_c(seq), lambda x: ~x.isin(*SPECIAL))
    return F.trim(F.array_join(kept, " "))


def pair_input(question, title, text, answer=None, no_title: bool = False) -> Column:
    """Question + SEP + context, context = [answer] [title] text."""
    parts = []
    if answer is not None:
        parts.append(F.coalesce(_c(answer), F.lit("")))
    if not no_title:
        parts.append(F.coalesce(_c(title), F.lit("")))
    parts.append(F.coalesce(_c(text), F.lit("")))
    ctx = F.concat_ws(" ", *parts)
    return F.concat(F.coalesce(_c(question), F.lit("")), F.lit(SEP), ctx)


def numeric_vocab(vocab: DataFrame, col: str = "token") -> DataFrame:
    """Digit tokens (optionally word-marked), the bare marker, eos."""
    t = F.col(col)
    return vocab.where((t.rlike(NUMERIC_TOKEN) & (t != "")) | (t == EOS)).select(col)


def all_semantic(ids: Column) -> Column:
    """True when no id is a plain digit string."""
    return F.bool_and(~ids.rlike(r"^[0-9]+$"))
