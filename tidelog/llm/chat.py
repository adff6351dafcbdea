r"""Chat formatting with a grammar round trip.

Rendered turns, one after another without anything between:

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    other      [ROLE:name] text [/ROLE]

A text in which a control string stands could end its turn early; the grammar has none in texts. After
rendering, each turn is parsed by the deterministic parser and compared to its source; where it can't be
parsed or they differ, control strings in the text get
a backslash behind their first character (one more, if there are some already), which the parser takes
out again, until both are identical. Role names are escaped in the same way, with `]` as `\]`.

Conversations are rows in order of their turn (ties: by role, then text; nulls first). Null texts are
empty; a null role is the role "". Rows with a null conv_id form one conversation. A conversation is
put out in parts of about PART characters, cut between turns, so one of any length needs little memory;
its loss mask is the ranges of code points of the part that hold assistant texts. No rows: no output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_batches, only

PART = 1 << 20
OPEN = {"system": "<<SYS>> ", "user": "[INST] ", "assistant": "<s> "}
CLOSE = {"system": " <</SYS>>", "user": " [/INST]", "assistant": " </s>"}
OTHER_CLOSE = " [/ROLE]"
_CONTROL = r"(?:<SYS>>|</SYS>>|/SYS>>|s>|/s>|INST\]|/INST\]|ROLE:|/ROLE\])"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_RAW = re.compile(rf"[<\[](?={_CONTROL})")
_HEAD = re.compile(r"<<SYS>> |\[INST\] |<s> |\[ROLE:((?:[^\\\]]|\\.)*)\] ", re.DOTALL)
_ROLE_OF = {v: k for k, v in OPEN.items()}


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: f"{m[1]}\\{m[2]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _ends(role: str) -> tuple[str, str]:
    if role in OPEN:
        return OPEN[role], CLOSE[role]
    name = role.replace("\\", "\\\\").replace("]", "\\]")
    return f"[ROLE:{name}] ", OTHER_CLOSE


class Ungrammatical(ValueError):
    pass


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn of a rendered text; start and stop bound the text as it stands there."""
    at = 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise Ungrammatical(f"no turn begins at {at}")
        role = _ROLE_OF.get(head[0])
        close = CLOSE[role] if role else OTHER_CLOSE
        if role is None:
            role = re.sub(r"\\(.)", r"\1", head[1], flags=re.DOTALL)
        stop = text.find(close, head.end())
        if stop < 0:
            raise Ungrammatical(f"the turn at {at} has no end")
        if _RAW.search(text, head.end(), stop):
            raise Ungrammatical(f"a control string in the text of the turn at {at}")
        yield role, unescape(text[head.end() : stop]), head.end(), stop
        at = stop + len(close)


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        found = [(r, t) for r, t, _, _ in parse(rendered)]
    except Ungrammatical:
        return False
    return found == [(role, text)]


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A rendered turn that parses to the role and text, and the bounds of the text in it."""
    role, text = role or "", text or ""
    before, after = _ends(role)
    shown = text
    for _ in range(3):
        out = f"{before}{shown}{after}"
        if _reads_back(out, role, text):
            return out, len(before), len(before) + len(shown)
        shown = escape(shown)
    raise Ungrammatical("a turn can't be made to read back")


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, text, loss) from rows (conv_id, turn, role, text)."""
    rows = only(turns, "conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        now, part, pieces, loss, size = None, 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], id_type), pa.array([part], pa.int64()), pa.array(["".join(pieces)]), pa.array([loss], _LOSS)], names=["conv_id", "part", "text", "loss"]
            )

        for b in batches:
            id_type = b.column(0).type
            for conv, _, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and (now[0] != conv or size >= PART):
                    yield row()
                    part = part + 1 if now[0] == conv else 0
                    pieces, loss, size = [], [], 0
                now = (conv,)
                out, start, stop = render(role, text)
                if role == "assistant":
                    loss.append({"start": size + start, "stop": size + stop})
                pieces.append(out)
                size += len(out)
        if now is not None:
            yield row()

    return map_batches(ordered, run, f"conv_id {kind}, part bigint, text string, loss array<struct<start:bigint,stop:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the parser and the loss mask find in the output: digests of each conversation's turns and loss text."""
    rows = only(formatted, "conv_id", "part", "text", "loss")
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now = None

        def row():
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            values = [now[0], n, turns.hexdigest(), chars, under.hexdigest(), size]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for b in batches:
            id_type = b.column(0).type
            for conv, _, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield row()
                    now, n, chars, size = (conv,), 0, 0, 0
                    turns, under = hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["stop"]])
                    chars += len(said)
                    under.update(said.encode())
                size += len(text)
        if now is not None:
            yield row()

    return map_batches(ordered, run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def planted(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    kinds = {f.name: f.dataType for f in turns.schema.fields}
    more = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return only(turns, "conv_id", "turn", "role", "text").unionByName(more.select(*(F.col(c).cast(kinds[c]) for c in more.columns)))
