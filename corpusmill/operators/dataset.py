"""Fine-tuning pairs from chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.functions.prompts import SYSTEM_PROMPT

# Instruction per template, with what answers it.
TEMPLATES: dict[str, tuple[str, Callable[[], Column]]] = {
    "summarise": ("Summarise this fossil record concisely.", lambda: text.first_sentence(F.col("content"))),
    "age": ("From which geological age is this fossil layer?", lambda: F.col("geological_age")),
    "qa": ("What is the main fact recorded in this fossil?", lambda: text.first_sentence(F.col("content"))),
}
FORMATS = ("alpaca", "chat")


def build_pairs(chunks: DataFrame, *, fmt: str = "chat", templates: Sequence[str] | None = None,
                available: dict | None = None, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Chunks times chosen templates: ``alpaca`` or ``chat`` columns next to the chunk's own keys.

    The templates are an array literal exploded per row, so there is no join and no shuffle. Sort by
    ``source_id, layer_version, ordinal, template_no`` for chunk-major order.
    """
    available = TEMPLATES if available is None else available
    names = list(templates) if templates else list(available)
    unknown = [name for name in names if name not in available]
    if unknown:
        raise ValueError(f"unknown template(s): {unknown}; available: {sorted(available)}")
    if fmt not in FORMATS:
        raise ValueError(f"unknown dataset format {fmt!r} (use 'chat' or 'alpaca')")
    options = F.array(*[
        F.struct(F.lit(name).alias("template"), F.lit(available[name][0]).alias("instruction"),
                 available[name][1]().alias("output"))
        for name in names
    ])
    keys = ["source_id", "layer_version", "ordinal", "chunk_id"]
    pairs = chunks.select(*keys, "content", F.posexplode(options).alias("template_no", "t")).select(
        *keys, "template_no", "t.template", "t.instruction", F.col("content").alias("input"), "t.output"
    )
    if fmt == "alpaca":
        return pairs
    user = F.concat(F.col("instruction"), F.lit("\n\nFossil:\n"), F.col("input"))
    turns = [("system", F.lit(system_prompt)), ("user", user), ("assistant", F.col("output"))]
    messages = F.array(*[F.struct(F.lit(role).alias("role"), said.alias("content")) for role, said in turns])
    return pairs.select(*keys, "template_no", "template", messages.alias("messages"))
