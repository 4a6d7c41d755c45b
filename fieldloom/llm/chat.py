"""Chat formatting: transcripts to canonical turns by a hidden Markov model.

A transcript is lines in order without trusted roles. Each line is observed as a symbol
(speaker marker, length, question mark, paragraphs, whether it is the first); roles are the
hidden states. Start, transition and emission counts come from transcripts with known
roles, by grouped sums and a join of neighbouring lines; Viterbi recovers the roles, then
every line is rendered as a canonical turn without its marker.

Viterbi is distributed over chunks of a conversation's lines: for fixed end states the best
path through a chunk is a small max-plus matrix, these are chained per conversation (one
matrix for ``CHUNK`` lines), and each chunk is then decoded by itself between its known
boundary states. A conversation with a third of all lines thus spreads over many tasks and
the result is exactly that of one long Viterbi pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, materialize

CHUNK = 1024
#: Speaker markers before a colon, by role (fixed values).
MARKERS = {"user": ("user", "human", "question", "q", "customer", "me", "prompt"), "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "response"), "system": ("system", "instructions", "context")}
_MARKER = r"^\s*(?:\[|<\|?|\*\*|#+\s*)?(?i:({}))(?:\]|\|?>|\*\*)?\s*(?::|\|>|>|\n)\s*"
_ANY = _MARKER.format("|".join(m for ms in MARKERS.values() for m in ms))
SYMBOLS = 5 * 6 * 2 * 3 * 2


def observe(text: Column, first: Column) -> Column:
    """The line's symbol, 0 to ``SYMBOLS`` - 1; a null text is an empty line."""
    text = F.coalesce(text, F.lit(""))
    marker = F.lit(0)
    for i, names in enumerate(MARKERS.values()):
        marker = F.when(F.regexp_like(text, F.lit(_MARKER.format("|".join(names)))), F.lit(i + 1)).otherwise(marker)
    marker = F.when((marker == 0) & F.regexp_like(text, F.lit(r"^\s*[A-Z][A-Za-z]{1,20}:\s")), F.lit(4)).otherwise(marker)
    n = F.length(text)
    size = sum((F.when(n > b, 1).otherwise(0) for b in (0, 40, 120, 300, 700)), F.lit(0))
    asks = F.when(F.regexp_like(text, F.lit(r"\?\s*$")), 1).otherwise(0)
    breaks = F.least(F.lit(2), F.length(text) - F.length(F.translate(text, "\n", "")))
    return ((((marker * 6 + size) * 2 + asks) * 3 + breaks) * 2 + F.when(first, 1).otherwise(0)).cast("int")


def strip_marker(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _ANY, ""))


def _lines(df: DataFrame, conv_col: str, turn_col: str, text_col: str, *more: Column) -> DataFrame:
    lines = df.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(text_col).alias("_text"), *more).where("_conv IS NOT NULL AND _turn IS NOT NULL")
    least = lines.groupBy("_conv").agg(F.min("_turn").alias("_first"))
    return lines.join(least, "_conv").withColumn("_sym", observe(F.col("_text"), F.col("_turn") == F.col("_first")))


def fit(known: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> dict:
    """Log start, transition and emission tables from transcripts with roles.

    Add-one counts; every role is a state. Lines with a null
    role, conversation or turn are left out. Without any, the states are user and assistant
    with equal tables.
    """
    lines = materialize(_lines(known, conv_col, turn_col, text_col, F.col(role_col).alias("_role")).where("_role IS NOT NULL").select("_conv", "_turn", "_first", "_role", "_sym"), "chat-known")
    roles = sorted(r[0] for r in lines.select("_role").distinct().collect()) or ["assistant", "user"]
    at = {r: i for i, r in enumerate(roles)}
    start, step, emit = np.ones(len(roles)), np.ones((len(roles), len(roles))), np.full((len(roles), SYMBOLS), 0.1)
    for r, s, n, f in lines.groupBy("_role", "_sym").agg(F.count("*"), F.sum(F.when(F.col("_turn") == F.col("_first"), 1).otherwise(0))).collect():  # roles x symbols rows
        emit[at[r], s] += n
        start[at[r]] += f
    turns = lines.groupBy("_conv", "_turn", "_role").agg(F.count("*").alias("_n"))  # repeated lines are counted, not paired
    after = turns.select("_conv", (F.col("_turn") - 1).alias("_turn"), F.col("_role").alias("_next"), F.col("_n").alias("_m"))
    for a, b, n in turns.join(after, ["_conv", "_turn"]).groupBy("_role", "_next").agg(F.sum(F.col("_n") * F.col("_m"))).collect():
        step[at[a], at[b]] += n
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return {"roles": roles, "start": norm(start), "step": norm(step), "emit": norm(emit)}


def chunk_matrix(symbols: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """m[i, j]: best log probability of the chunk from the state i before it to its last state j."""
    m = None
    for s in symbols:
        hop = step + emit[:, s]
        m = hop if m is None else (m[:, :, None] + hop[None]).max(1)
    return m


def viterbi(symbols: np.ndarray, begin: np.ndarray, step: np.ndarray, emit: np.ndarray, last: int | None = None) -> list[int]:
    """States of the best path; ``begin``: log scores of the first line's states, its emission not included. Ties: the lower state."""
    score, back = begin + emit[:, symbols[0]], []
    for s in symbols[1:]:
        ways = score[:, None] + step
        back.append(ways.argmax(0).astype(np.int8))
        score = ways.max(0) + emit[:, s]
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def chain(first: np.ndarray, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, last state) of every chunk on the best path; ``first``: log scores of the first chunk's last states."""
    scores = [first]
    for m in matrices:
        scores.append((scores[-1][:, None] + m).max(0))
    last, out = int(scores[-1].argmax()), []
    for i in range(len(matrices), 0, -1):
        before = int((scores[i - 1] + matrices[i - 1][:, last]).argmax())
        out.append((before, last))
        last = before
    return [(-1, last), *out[::-1]]


def format_chats(transcripts: DataFrame, model: dict, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conversation, turn, role, text, rendered) of every line, roles recovered from the lines alone.

    text: the line without its speaker marker, trimmed; rendered: ``<|role|>``, the text and
    ``<|end|>`` on lines of their own. Lines with a null conversation or turn can't be placed
    and are left out; a null text is an empty line. Repeated lines give a row each and are
    ordered by turn, then symbol and text. A chunk is at most ``chunk`` lines of one
    conversation, however many of them have one turn number: lines are dealt and numbered in
    this order over all tasks.
    """
    order = ["_conv", "_turn", "_sym", "_text"]
    dealt = _lines(transcripts, conv_col, turn_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    lines = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "chat-lines").withColumn("_chunk", F.floor(F.col("_at") / chunk))
    conv, turn = id_type(lines, "_conv"), id_type(lines, "_turn")
    start, step, emit, roles = model["start"], model["step"], model["emit"], model["roles"]
    k = len(roles)
    ordered = lines.groupBy("_conv", "_chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_sym"))), lambda x: x["_sym"]).alias("_syms"))
    first = ordered.groupBy("_conv").agg(F.min("_chunk").alias("_begin"))
    ordered = ordered.join(first, "_conv").withColumn("_begins", F.col("_chunk") == F.col("_begin")).drop("_begin")

    def matrices(it):
        for b in it:
            out = []
            for syms, begins in zip(b["_syms"], b["_begins"], strict=True):
                s = np.asarray(syms)
                if begins:  # every row: the scores from the start
                    score = start + emit[:, s[0]]
                    rest = chunk_matrix(s[1:], step, emit)
                    out.append(np.tile(score if rest is None else (score[:, None] + rest).max(0), k).tolist())
                else:
                    out.append(chunk_matrix(s, step, emit).ravel().tolist())
            yield pd.DataFrame({"_conv": b["_conv"], "_chunk": b["_chunk"], "_m": out})

    def chained(it):
        for b in it:
            rows = []
            for conv_id, chunks in zip(b["_conv"], b["_chunks"], strict=True):
                ms = [np.asarray(c["_m"]).reshape(k, k) for c in chunks]
                rows += [(conv_id, c["_chunk"], *bound) for c, bound in zip(chunks, chain(ms[0][0], ms[1:]), strict=True)]
            yield pd.DataFrame(rows, columns=["_conv", "_chunk", "_before", "_last"])

    small = ordered.mapInPandas(matrices, f"_conv {conv}, _chunk long, _m array<double>")
    of_conv = small.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_chunk", "_m"))).alias("_chunks"))  # one matrix for ``chunk`` lines
    bounds = of_conv.mapInPandas(chained, f"_conv {conv}, _chunk long, _before int, _last int")

    def decoded(it):
        for b in it:
            states = []
            for syms, before, last in zip(b["_syms"], b["_before"], b["_last"], strict=True):
                s = np.asarray(syms)
                states.append(viterbi(s, start if before < 0 else step[before], step, emit, int(last)))
            yield pd.DataFrame({"_conv": b["_conv"], "_chunk": b["_chunk"], "_states": states})

    states = ordered.join(bounds, ["_conv", "_chunk"]).select("_conv", "_chunk", "_syms", "_before", "_last").mapInPandas(decoded, f"_conv {conv}, _chunk long, _states array<int>")
    texts = lines.groupBy("_conv", "_chunk").agg(F.sort_array(F.collect_list(F.struct("_at", "_turn", "_text"))).alias("_lines"))
    names = F.array(*[F.lit(r) for r in roles])
    line = texts.join(states, ["_conv", "_chunk"]).select("_conv", F.explode(F.arrays_zip("_lines", "_states")).alias("_x"))
    text = strip_marker(F.col("_x._lines._text"))
    role = F.element_at(names, F.col("_x._states") + 1)
    return line.select(
        F.col("_conv").alias(conv_col), F.col("_x._lines._turn").cast(turn).alias(turn_col), role.alias("role"), text.alias("text"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"),
    )
