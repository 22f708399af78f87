"""Chat formatting: a state machine over roles, a declarative template, per-segment loss flags.

A template gives the strings before and after a role's text and whether the text is
learned from.  Wherever one of the template's control strings, or the escape
character, stands in a text, the escape character is put before it, so the output can
be read back.  Turns are streamed in order, in segments; a conversation is never held
as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role: (before, after, learned).  ``None`` stands for any other role; {role} is its name.
TEMPLATE = {
    "system": ("[SYS] ", " [/SYS]\n", False),
    "user": ("[INST] ", " [/INST]\n", False),
    "assistant": ("[ANS] ", " </s>\n", True),
    None: ("[ROLE {role}] ", " [/ROLE]\n", False),
}
CONTROL = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "<s>", "</s>", "[ROLE ", "[/ROLE]")
ESCAPE = "\\"
#: (state, role): next state; anything else breaks the order.  A conversation may end after an assistant's turn.
TURNS = {
    ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
    ("user", "assistant"): "assistant", ("assistant", "user"): "user",
}
ENDS = {"assistant"}

_SPECIAL = re.compile("|".join(map(re.escape, [ESCAPE, *CONTROL])))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TEXT = r"((?:\\.|[^\\])*?)"
_ROLE = r"((?:\\.|[^\\\]])*)"
_TURN = re.compile(
    "|".join(
        _ROLE.join(map(re.escape, before.split("{role}"))) + _TEXT + re.escape(after) for before, after, _ in TEMPLATE.values()
    ),
    re.S,
)
#: What a turn can end with.
_AFTER = tuple(after for _, after, _ in TEMPLATE.values())


def escaped(text: str) -> str:
    return _SPECIAL.sub(lambda m: ESCAPE + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str) -> list[tuple[str, bool]]:
    """The segments of one turn, each with its loss flag."""
    before, after, learned = TEMPLATE.get(role, TEMPLATE[None])
    name = escaped(role).replace("]", ESCAPE + "]") if role not in TEMPLATE else role
    return [(before.replace("{role}", name), False), (escaped(text), learned), (after, False)]


def first_turn(formatted: str) -> tuple[str, str, int] | None:
    """(role, text, end) of the turn that a formatted text begins with; none if it has not ended yet."""
    m = _TURN.match(formatted)
    if not m:
        return None
    at = 1
    for name in TEMPLATE:
        if m[at] is not None:
            return (unescaped(m[at]), unescaped(m[at + 1]), m.end()) if name is None else (name, unescaped(m[at]), m.end())
        at += 1
    raise AssertionError


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the turns, with the state that the machine is in after each; the turns come in order."""
    conv, state, started, turn = None, "start", False, 0
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv", "turn", "segment", "loss", "state")}
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
            if not started or c != conv:
                conv, state, started, turn = c, "start", True, 0
            state, turn = TURNS.get((state, role), "broken"), turn + 1
            for segment, loss in segments(role, text):
                for k, v in zip(out, (c, turn, segment, loss, state), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["conv"], batch.schema.field("conv").type), pa.array(out["turn"], pa.int64()), pa.array(out["segment"], pa.string()), pa.array(out["loss"], pa.bool_()), pa.array(out["state"], pa.string())],
            names=list(out),
        )


class _Digest:
    """What is read back from the text of one conversation, turn by turn, by the template alone."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars, self.state, self.text = conv, 0, 0, 0, "start", ""
        self.pending: list[str] = []
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, loss: bool, state: str) -> None:
        self.pending.append(segment)
        self.chars += len(segment)
        self.state = state
        if loss:
            text = unescaped(segment)
            self.loss_chars += len(text)
            self.learned.update(text.encode("utf-8", "surrogatepass"))
        if segment.endswith(_AFTER):
            self.parse()

    def parse(self) -> None:
        self.text += "".join(self.pending)
        self.pending = []
        while found := first_turn(self.text):
            role, text, end = found
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.turns, self.text = self.turns + 1, self.text[end:]

    def close(self) -> None:
        self.parse()
        if self.text:
            raise ValueError("a formatted conversation ends inside a turn")

    def row(self) -> tuple:
        self.close()
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.state in ENDS


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: _Digest | None = None
    kind = None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))

    for batch in batches:
        kind, rows = batch.schema.field("conv").type, []
        for c, *rest in zip(*(batch.column(k).to_pylist() for k in ("conv", "segment", "loss", "state")), strict=True):
            if open_ is None or open_.conv != c:
                if open_ is not None:
                    rows.append(open_.row())
                open_ = _Digest(c)
            open_.feed(*rest)
        yield packed(rows)
    if open_ is not None:
        yield packed([open_.row()])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments (conv, turn, segment, loss, state) of all conversations, each conversation's in order within one partition.

    ``turn`` counts the rows of a conversation in the order of ``turn_col`` (null
    first, ties by role and text); ``state`` is the machine's state after the turn,
    "broken" from the first role that may not follow.  A null role or text is empty, a
    null conversation is one of its own; roles the template does not name are written
    with their name.  Other columns are ignored.
    """

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("at"), text(role_col).alias("role"), text(text_col).alias("text"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "at", "role", "text")
    kind = dealt.schema["conv"].dataType.simpleString()
    return dealt.mapInArrow(_formatted, f"conv {kind}, turn long, segment string, loss boolean, state string")


def read_conversations(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read the output of :func:`format_conversations` back: one row of counts and digests per conversation.

    Turns are found in the conversation's whole text by the template; of the segments
    only their order and loss flags are used.

    ``valid`` says that the roles kept the order of the state machine to an allowed end.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    out = formatted.mapInArrow(_read_back, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
    return out.withColumnRenamed("conv", conv_col)
