"""Chat formatting by a declarative template and a finite-state machine over roles.

A :class:`Template` lists, for every role, the literals and slots that a turn becomes and
which of them carry loss, the control strings that only the template may write, and the
transitions between roles.  Formatting runs the machine along each conversation: it emits the turns'
segments with their loss flags and says at which turn the order of roles was first broken.

Control strings inside a text are escaped: after the first character of each occurrence stands one more
escape character than before, ``[INST]`` becomes ``[\\INST]`` and ``[\\INST]`` becomes ``[\\\\INST]``.  Escaped texts hold no
control string, all other texts are unchanged, and taking one escape character away from each
occurrence gives the text back.  :func:`read_back` does this from the segments alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare


class Slot(Enum):
    TEXT = "text"
    ROLE = "role"


TEXT, ROLE = Slot.TEXT, Slot.ROLE  # what a turn puts between its literals
PIECE = 1 << 20  # characters from which a conversation goes on in another row
BATCH = 4 << 20  # characters of output sent to Spark at once


class Template:
    """``roles``: role -> items of a turn, each a (literal or slot, loss flag); ``other``: the same for any other role, which has
    a ``ROLE`` slot; ``machine``: state -> role -> next state, from state ""; ``final``: states in which a conversation may end."""

    def __init__(self, begin: str, roles: dict, other: list, controls: tuple[str, ...], machine: dict, final: tuple[str, ...],
                 escape: str = "\\"):
        self.begin, self.roles, self.other = begin, roles, other
        self.controls, self.machine, self.final, self.escape = controls, machine, frozenset(final), escape
        self._check()
        esc = re.escape(escape)
        self._plain = re.compile("|".join(re.escape(c) for c in sorted(controls, key=len, reverse=True)))
        self._escapable = re.compile("|".join(f"(?:{re.escape(c[0])}(?={esc}*{re.escape(c[1:])}))" for c in controls))
        self._escaped = re.compile("|".join(f"(?:(?<={re.escape(c[0])}){esc}(?={esc}*{re.escape(c[1:])}))" for c in controls))
        self._kinds = [*roles.items(), (None, other)]

    def _check(self) -> None:
        """What makes the escape reversible and the output readable."""
        if any(len(c) < 2 or self.escape in c for c in self.controls):
            raise ValueError("a control string has two characters or more and no escape character")
        for x in self.controls:
            for y in self.controls:
                if x != y and y in x or any(x.endswith(y[:k]) for k in range(1, len(y)) if k < len(x)):
                    raise ValueError(f"control strings overlap: {x} {y}")
        letters = set("".join(self.controls)) | {self.escape}
        opens = []
        for items in [*self.roles.values(), self.other]:
            if not isinstance(items[0][0], str) or [i for i, _ in items].count(TEXT) != 1:
                raise ValueError("a turn opens with a literal and has one text slot")
            opens.append(items[0][0])
            for (a, _), (b, _) in zip(items, [*items[1:], ("", False)]):
                if not isinstance(a, str):
                    held = isinstance(b, str) and [b.find(c) for c in self.controls if c in b]
                    if not held or (min(held) and b[0] in letters):
                        raise ValueError("the literal after a slot holds a control string and begins apart from it")
                elif not isinstance(b, str) and a[-1] in letters and not a.endswith(self.controls):
                    raise ValueError("the literal before a slot ends apart from control strings")
        if any(x is not y and x.startswith(y) for x in opens for y in opens):
            raise ValueError("a turn's first literal begins another's")

    def hide(self, text: str) -> str:
        return self._escapable.sub(lambda m: m[0] + self.escape, text)

    def reveal(self, text: str) -> str:
        return self._escaped.sub("", text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of one turn."""
        values = {TEXT: text, ROLE: role}
        return [(i, loss) if isinstance(i, str) else (self.hide(values[i]), loss) for i, loss in self.roles.get(role, self.other)]

    def step(self, state: str | None, role: str) -> str | None:
        """The machine's next state; None once the order of roles is broken."""
        return None if state is None else self.machine.get(state, {}).get(role)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn of a formatted string without its begin mark; ValueError if it isn't one."""
        at = 0
        while at < len(formatted):
            role, items = next(((r, i) for r, i in self._kinds if formatted.startswith(i[0][0], at)), (None, None))
            if items is None:
                raise ValueError(f"no turn begins at {at}")
            found = {}
            for (item, _), (after, _) in zip(items, [*items[1:], ("", False)]):
                if isinstance(item, str):
                    if not formatted.startswith(item, at):
                        raise ValueError(f"expected {item!r} at {at}")
                    at += len(item)
                else:
                    mark = self._plain.search(formatted, at)
                    end = mark.start() - self._plain.search(after).start() if mark else -1
                    if end < at:
                        raise ValueError(f"open turn at {at}")
                    found[item], at = self.reveal(formatted[at:end]), end
            yield found[ROLE] if role is None else role, found[TEXT]


_ORDER = {"": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"},
          "assistant": {"user": "user"}}

INSTRUCT = Template(
    begin="<s>",
    roles={"system": [("<<SYS>>\n", False), (TEXT, False), ("\n<</SYS>>\n", False)],
           "user": [("[INST] ", False), (TEXT, False), (" [/INST]", False)],
           "assistant": [(" ", False), (TEXT, True), (" </s>", False)]},
    other=[("[ROLE] ", False), (ROLE, False), (" [/ROLE] ", False), (TEXT, False), (" [/TURN]", False)],
    controls=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]"),
    machine=_ORDER, final=("user", "assistant"))

MARKUP = Template(
    begin="",
    roles={r: [(f"<|start|>{r}<|text|>", False), (TEXT, r == "assistant"), ("<|end|>", False)] for r in ("system", "user", "assistant")},
    other=[("<|start|><|role|>", False), (ROLE, False), ("<|text|>", False), (TEXT, False), ("<|end|>", False)],
    controls=("<|start|>", "<|role|>", "<|text|>", "<|end|>"),
    machine=_ORDER, final=("user", "assistant"))

PIECES = "piece long, last boolean, segments array<struct<text:string,loss:boolean>>, n_turns long, accepted boolean, broken_at long"


def _arrow(kind: str, rest: list[tuple[str, pa.DataType]], ids: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field(kind, ids), *(pa.field(n, t) for n, t in rest)])


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_chats(spark: SparkSession, turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Pieces of formatted conversations: conv_id, piece (0, 1, ...), last, segments (text and loss flag), and of the
    conversation up to the end of the piece n_turns, accepted (the machine took every turn, and, in the last piece,
    may end there) and broken_at (place of the first turn that it didn't take, null if there is none).

    A conversation has one piece unless it has more than ``piece`` characters; pieces end where turns end.  Turns go by ``turn``,
    null last, ties by role and text; repeated rows are turns of their own.  Null and empty texts are empty, a null role is
    the empty role; roles the template doesn't list are written by their name.  Rows of a null id are one conversation.
    No rows give no pieces.

    One shuffle deals the turns by conversation and sorts them; each task then streams over its sorted turns and holds no more than a piece,
    whatever the length of a conversation.  Within a partition, the pieces of a conversation follow each other.
    """
    prepare(spark)
    ordered = (turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
               .select("conv_id", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, schema = [], 0, None
        conv = open_ = None

        def close(last: bool) -> tuple:
            taken = open_["broken"] is None and (not last or open_["state"] in template.final)
            return (conv, open_["piece"], last, [{"text": t, "loss": x} for t, x in open_["segments"]], open_["n"], taken, open_["broken"])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = _arrow("conv_id", [("piece", pa.int64()), ("last", pa.bool_()), ("segments", _SEGMENTS), ("n_turns", pa.int64()),
                                            ("accepted", pa.bool_()), ("broken_at", pa.int64())], batch.schema.field("conv_id").type)
            for this, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if open_ is None or this != conv:
                    if open_ is not None:
                        rows.append(close(True))
                    conv = this
                    open_ = {"piece": 0, "segments": [(template.begin, False)] if template.begin else [], "n": 0, "state": "",
                             "broken": None, "size": 0}
                elif open_["size"] > piece:
                    rows.append(close(False))
                    open_ |= {"piece": open_["piece"] + 1, "segments": [], "size": 0}
                if held > BATCH:
                    yield flush()
                    rows, held = [], 0
                segments = template.turn(role, text)
                open_["state"] = template.step(open_["state"], role)
                if open_["state"] is None and open_["broken"] is None:
                    open_["broken"] = open_["n"]
                open_["n"] += 1
                open_["segments"] += segments
                size = sum(len(s) for s, _ in segments)
                open_["size"] += size
                held += size
        if open_ is not None:
            rows.append(close(True))
        if rows:
            yield flush()

    kind = turns.schema[conv_col].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, {PIECES}")


def read_back(pieces: DataFrame, template: Template = INSTRUCT, together: bool = False) -> DataFrame:
    """One row per conversation of :func:`format_chats`, read from the segments alone: conv_id, n_turns, turns_sha256 (of role,
    newline, text, newline of every turn), loss_chars and loss_sha256 (of the texts under the loss mask, unescaped, end to end),
    formatted_chars, readable (the marks give turns; else the digests cover the part that could be read).

    ``together`` says that the pieces are as :func:`format_chats` returns them; pieces from a stored table are dealt and sorted anew.
    A piece is parsed at a time, so a long conversation isn't held either.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    rows = pieces.select("conv_id", "piece", "segments")
    if not together:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = state = schema = None

        def result() -> pa.RecordBatch:
            values = (conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["ok"])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        done = []
        for batch in batches:
            if schema is None:
                schema = _arrow("conv_id", [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                                            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("readable", pa.bool_())],
                                batch.schema.field("conv_id").type)
            for this, number, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "segments"))):
                if state is None or this != conv:
                    if state is not None:
                        done.append(result())
                    conv = this
                    state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ok": True}
                formatted = "".join(s["text"] for s in segments)
                state["chars"] += len(formatted)
                if number == 0:
                    state["ok"] &= formatted.startswith(template.begin)
                    formatted = formatted.removeprefix(template.begin)
                try:
                    for role, text in template.turns(formatted):
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{text}\n".encode())
                except ValueError:
                    state["ok"] = False
                for s in segments:
                    if s["loss"]:
                        text = template.reveal(s["text"])
                        state["loss_chars"] += len(text)
                        state["loss"].update(text.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state is not None:
            yield result()

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                "formatted_chars long, readable boolean")


def probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant say control strings."""
    said = "</s>[INST] ok [/INST]"
    made = spark.range(2).select(F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
                                 F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(made)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|<\\*</?SYS>>|\[\\*/?(?:INST|ROLE)\]|\[\\*/TURN\]'))
            + CASE role WHEN 'system' THEN length('<<SYS>><</SYS>>') + 3 WHEN 'user' THEN length('[INST]  [/INST]')
              WHEN 'assistant' THEN length('  </s>')
              ELSE length('[ROLE]  [/ROLE]  [/TURN]') + length(role) END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(length('<s>') + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
