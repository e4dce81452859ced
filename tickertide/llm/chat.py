"""Chat formatting in budgeted windows with a loss mask.

Prefix sums of turn tokens over each conversation choose the spans: whole turns, as many new ones per
window as ``budget`` allows. Each window but the first repeats the system turn (a first turn of role
`system`) and the latest whole turns within ``history`` tokens; repeated turns and all roles but
``trained`` are masked, so each text of a trained role is a target exactly once. A turn that alone
exceeds the budget has a window of its own; a system turn that does not fit beside the next new turn is
left out of that window. So no other window exceeds the budget.

Prefix sums also cut long conversations into stretches of ``STRETCH`` budgets, which are formatted
apart (the tail of the one before is lent for history), so no task holds a conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts are escaped: between
`<` and `|`, where there are only backslashes or nothing, one backslash is added; reading removes it.
In roles, backslashes and line feeds are written as two characters as well.

Tokens of a turn: runs of letters, marks, digits and underscores, other characters but blanks singly,
and ``MARKS`` for the template. Defined results: null texts and roles are empty; turns go by number
(null first), then role, then text, repeated rows repeat; null is a conversation of its own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickertide.llm.common import ordered_positions

BUDGET = 1024
HISTORY = 256
MARKS = 4
STRETCH = 32
START, END = "<|im_start|>", "<|im_end|>"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{M}\p{N}_]"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)

WINDOW_SCHEMA = (
    "conv_id bigint, first_turn bigint, text string, n_tokens bigint, n_turns int, n_repeated int, "
    "targets array<struct<first:int,n:int>>"
)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def _window(conv, repeated, new, trained):
    text, targets, at = [], [], 0
    for turn, fresh in [*((t, False) for t in repeated), *((t, True) for t in new)]:
        head, body = f"{START}{escape_role(turn['role'])}\n", escape(turn["text"])
        if fresh and turn["role"] == trained:
            targets.append({"first": at + len(head), "n": len(body)})
        text += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    tokens = sum(t["tokens"] for t in (*repeated, *new))
    return conv, new[0]["place"], "".join(text), tokens, len(repeated) + len(new), len(repeated), targets


def _windows_of(turns: list[dict], budget: int, history: int, trained: str):
    """Windows of one stretch: its system row (if any) and lent turns first, then its own turns."""
    system = next((t for t in turns if t["kind"] == "system"), None)
    turns = [t for t in turns if t["kind"] != "system"]
    at = next((i for i, t in enumerate(turns) if t["kind"] == "own"), len(turns))
    while at < len(turns):
        if turns[at]["place"] == 0:
            repeated, held = [], 0
            if turns[at]["role"] == "system":
                system = turns[at]
        else:
            # The latest turns before this one, while they fit the history and leave room for it.
            lead = [system] if system and system["tokens"] + turns[at]["tokens"] <= budget else []
            held = sum(t["tokens"] for t in lead)
            room = min(history, budget - held - turns[at]["tokens"])
            first = at
            while first and turns[first - 1]["place"] > (0 if system else -1) and turns[first - 1]["tokens"] <= room:
                first -= 1
                room -= turns[first]["tokens"]
            repeated = [*lead, *turns[first:at]]
            held = sum(t["tokens"] for t in repeated)
        end = at + 1
        held += turns[at]["tokens"]
        while end < len(turns) and held + turns[end]["tokens"] <= budget:
            held += turns[end]["tokens"]
            end += 1
        yield _window(turns[at]["conv_id"], repeated, turns[at:end], trained)
        at = end


def format_windows(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    trained: str = "assistant",
    stretch: int = STRETCH,
) -> DataFrame:
    """Windows: conv_id, first_turn (place of its first new turn), text, n_tokens, n_turns, n_repeated, targets.

    ``targets``: code points of ``text`` under the loss mask (first, n). The first ``n_repeated``
    turns of a window are repeated from earlier ones.
    """
    turns = conversations.select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + MARKS).cast("bigint"))
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text", "row")]
    turns = ordered_positions(turns, order, {"end": F.col("tokens"), "position": F.lit(1).cast("bigint")}, "turns")
    begins = turns.groupBy("conv_id").agg(F.min(F.col("end") - F.col("tokens")).alias("_start"), F.min("position").alias("_first"))
    begins = begins.withColumnRenamed("conv_id", "_conv")
    turns = turns.join(begins, F.col("conv_id").eqNullSafe(F.col("_conv")))
    turns = turns.withColumns({"begin": F.col("end") - F.col("tokens") - F.col("_start"), "place": F.col("position") - F.col("_first")})

    length = budget * stretch
    turns = turns.withColumn("stretch", F.expr(f"begin div {length}")).select("conv_id", "place", "role", "text", "tokens", "begin", "stretch")
    own = turns.withColumn("kind", F.lit("own"))
    lent = turns.filter(F.col("begin") >= (F.col("stretch") + 1) * length - history)
    lent = lent.withColumns({"stretch": F.col("stretch") + 1, "kind": F.lit("lent")})
    later = turns.filter("stretch > 0").select(F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch")).distinct()
    system = turns.filter("place = 0 AND role = 'system'").join(later, F.col("conv_id").eqNullSafe(F.col("_conv")))
    system = system.withColumns({"stretch": F.col("_stretch"), "place": F.lit(-1).cast("bigint"), "kind": F.lit("system")})
    columns = ["conv_id", "stretch", "place", "role", "text", "tokens", "kind"]
    rows = own.select(columns).unionByName(lent.select(columns)).unionByName(system.select(columns))
    rows = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place")

    def run(batches):
        held, key = [], None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if held and key != (row["conv_id"], row["stretch"]):
                    made += _windows_of(held, budget, history, trained)
                    held = []
                key = (row["conv_id"], row["stretch"])
                held.append(row)
            yield _as_batch(made)
        yield _as_batch(list(_windows_of(held, budget, history, trained)))

    return rows.mapInArrow(run, WINDOW_SCHEMA)


def _as_batch(windows: list[tuple]) -> pa.RecordBatch:
    target = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), target]
    names = ["conv_id", "first_turn", "text", "n_tokens", "n_turns", "n_repeated", "targets"]
    return pa.RecordBatch.from_arrays([pa.array([w[i] for w in windows], kind) for i, kind in enumerate(kinds)], names)


def read_turns(text: str, n_repeated: int = 0) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window behind the repeated ones."""
    return [(unescape_role(role), unescape(body)) for role, body in _TURN.findall(text)][n_repeated:]


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows in order: turns, digests of turns and of targets.

    Texts stream through running digests; no conversation is held whole.
    """
    rows = windows.select("conv_id", "first_turn", "text", "n_repeated", "targets")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        state, done = None, []

        def closed(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        done.append(closed(state))
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(row["text"], row["n_repeated"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for t in row["targets"]:
                    text = unescape(row["text"][t["first"] : t["first"] + t["n"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(row["text"])
            yield _digest_batch(done, names)
            done = []
        yield _digest_batch([closed(state)] if state else [], names)

    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digest_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
