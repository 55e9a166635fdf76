"""Chat templates: rendered conversations, their token ids, and which tokens the assistant says."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.registry import query


@dataclass(frozen=True)
class ChatTemplate:
    """What stands before a message, with ``{role}``, and after it."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"


def render_chat(turns: DataFrame, key: str, order: str, role: str, text: str, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(key, rendered, spoken): each conversation as one text, and where the assistant's words and their ends are.

    ``spoken``: (start, end) in code points. Turns of a conversation meet in one row, so a
    conversation must fit a task; null texts are empty.
    """
    said = F.concat(F.coalesce(text, F.lit("")), F.lit(template.after))
    turn = F.struct(F.col(order), (F.col(role) == "assistant").alias("own"), F.replace(F.lit(template.before), F.lit("{role}"), F.col(role)).alias("head"), said.alias("said"))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("t"))

    def walk(state, x):
        start = state["at"] + F.length(x["head"])
        end = start + F.length(x["said"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(state["spoken"], span)).otherwise(state["spoken"]).alias("spoken"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    spoken = F.aggregate("t", F.struct(F.lit(0).alias("at"), none.alias("spoken")), walk, lambda s: s["spoken"])
    return rows.select(key, F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["said"])), "").alias("rendered"), spoken.alias("spoken"))


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def tokenize_chats(rendered: DataFrame, key: str, tokenizer: str) -> DataFrame:
    """(key, ids, mask): token ids of each rendered conversation and 1 for those inside what the assistant says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _tokenizer(tokenizer)
        for batch in batches:
            ids, masks = [], []
            for text, spoken in zip(batch.rendered, batch.spoken):
                found = own.encode(text, add_special_tokens=False)
                ids.append(found.ids)
                starts = np.array([a for a, _ in found.offsets], np.int64)
                edges = np.array([x for s in spoken for x in (s["start"], s["end"])], np.int64)
                masks.append((np.searchsorted(edges, starts, side="right") % 2).astype(np.int32))
            yield pd.DataFrame({key: batch[key], "ids": ids, "mask": masks})

    kind = rendered.schema[key].dataType.simpleString()
    return rendered.select(key, "rendered", "spoken").mapInPandas(run, f"{key} {kind}, ids array<int>, mask array<int>")


@query("str_27_chat_tokens")
def _(t):
    import public_tokenizers

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes()))

    rendered = render_chat(t.conversations, "conv_id", "turn", "role", "text")
    found = tokenize_chats(rendered, "conv_id", public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("conv_id", F.size("ids").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("n_assistant"), crc("ids").alias("ids_crc32"))


@query("str_27_chat_text", r"""
SELECT conv_id, sha256(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS h,
    sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) + 11 ELSE 0 END)::BIGINT AS n_spoken FROM conversations GROUP BY conv_id""")
def _(t):
    rendered = render_chat(t.conversations, "conv_id", "turn", "role", "text")
    return rendered.select("conv_id", F.sha2("rendered", 256).alias("h"), F.aggregate("spoken", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_spoken"))
