"""Chat rendering (B9): a long message table → one prompt per conversation.

Role markup is a parameter (the tokenizer's chat template is outside the
library). Messages of one conversation are gathered with their turn index
and ordered; a conversation is a single prompt, so its group is bounded by
its own length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_HEADER = "<|{role}|>\n"
DEFAULT_END = "\n"


def render_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", system: str | None = None, add_generation_prompt: bool = True,
                header: str = DEFAULT_HEADER, end: str = DEFAULT_END) -> DataFrame:
    """(conv, prompt, n_messages). A null role or text is empty: every
    message of the table is in the prompt."""
    pre, post = header.split("{role}")
    empty = F.lit("")
    g = messages.groupBy(conv).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), empty).alias("r"),
                                             F.coalesce(F.col(text), empty).alias("x")))).alias("_m"))
    body = F.array_join(F.transform("_m", lambda m: F.concat(F.lit(pre), m["r"], F.lit(post), m["x"], F.lit(end))), "")
    parts = []
    if system is not None:
        parts.append(F.lit(f"{pre}system{post}{system}{end}"))
    parts.append(body)
    if add_generation_prompt:
        parts.append(F.lit(f"{pre}assistant{post}"))
    return g.select(conv, F.concat(*parts).alias("prompt"), F.size("_m").alias("n_messages"))
