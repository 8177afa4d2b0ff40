"""Chat formatting with a grammar round trip."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table

#: The template. A turn is its role's opening, the text, the closing; other roles are named after [ROLE] on a line.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
#: Roles whose texts are under the loss mask.
LOSS = ("assistant",)
#: Control strings: a text holds none of them once it is escaped.
CONTROL = re.compile(r"\[/?(?:INST|ROLE)\]|</?s>")
_ESCAPED = re.compile(r"\\\\|([\[<])\\(/?(?:INST|ROLE)\]|/?s>)")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>[^\n]*)\n(?P<other>.*?)\[/ROLE\]", re.S)
_ROLE = re.compile(r"\\([\\n])")


def escape(text: str) -> str:
    """Backslashes are doubled and one is put into each control string, after its first character."""
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2] if m[1] else "\\", text)


def turns_in(rendered: str, at: int = 0) -> Iterator[tuple[str, str, int, int, int]]:
    """The turns that a formatted string holds from `at` on: role, text, first and last place of the text as it stands there
    (escaped), place after the turn. Deterministic: at each place one kind of turn can begin, and it ends at the first
    closing. Stops where no whole turn begins."""
    while m := _TURN.match(rendered, at):
        role = m.lastgroup if m.lastgroup != "other" else unescape(_ROLE.sub(lambda x: "\n" if x[1] == "n" else "\\", m["role"]))
        at = m.end()
        yield role, unescape(m[m.lastgroup]), *m.span(m.lastgroup), at


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. Raises ValueError on anything that is no whole number of turns."""
    turns, at = [], 0
    for role, text, _, _, at in turns_in(rendered):
        turns.append((role, text))
    if at != len(rendered):
        raise ValueError(f"no turn begins at {at}")
    return turns


def _render(role: str, text: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + text + MARKS[role][1]
    return OTHER[0] + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n" + text + OTHER[1]


def render(role: str, text: str) -> str:
    """One turn in the template: as it is if it then reads back as itself and holds no control string, else escaped.
    A turn that reads back alone does so between others, as it begins and ends at its own marks."""
    for candidate in (text, escape(text)):
        out = _render(role, candidate)
        if CONTROL.search(candidate):
            continue
        try:
            if parse(out) == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError("a turn cannot be formatted")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out = [render(r or "", t or "") for r, t in zip(roles, texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r or "" for r in roles], pa.string()), pa.array(out, pa.string())], ["conv_id", "turn", "role", "formatted"])


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) to (conv_id, turn, role, formatted), a row for each turn; a conversation is its
    turns' strings one after the other. Null texts and roles count as empty."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(_rendered, "conv_id long, turn long, role string, formatted string")


_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of strings that stand sorted by conversation, each conversation's joined string read turn by turn: (conv_id, role,
    text, start, stop, size) with places in the joined string, and at its end (conv_id, None, None, size, size, size). Of
    an open conversation only what is not yet a whole turn is kept."""
    none = object()
    key, open_text, size = none, "", 0

    def ended() -> Iterator[tuple]:
        if open_text:
            raise ValueError(f"conversation {key} does not end with a turn")
        if key is not none:
            yield key, None, None, size, size, size

    for batch in batches:
        for conv, rendered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key is none or conv != key:
                yield from ended()
                key, open_text, size = conv, "", 0
            open_text, at = open_text + rendered, 0
            for role, text, start, stop, at in turns_in(open_text):
                yield key, role, text, size + start, size + stop, size + at
            open_text, size = open_text[at:], size + at
    yield from ended()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation sums and hashes; the loss text is what stands under the mask, that is at the places of
    assistants' texts, unescaped."""
    fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256()]
    state, done = fresh(), []
    as_batch = lambda: pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, (_, kind) in enumerate(_DIGEST)], [name for name, _ in _DIGEST])
    for conv, role, text, _, _, size in _read(batches):
        if role is None:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), size))
            state = fresh()
            if len(done) == 1000:
                yield as_batch()
                done = []
            continue
        state[0] += 1
        state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role in LOSS:
            state[2] += len(text)
            state[3].update(text.encode("utf-8", "surrogatepass"))
    if done:
        yield as_batch()


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["conv_id", "start", "stop"])
    for conv, role, _, start, stop, _ in _read(batches):
        if role in LOSS:
            rows.append((conv, start, stop))
        if len(rows) == 1000:
            yield as_batch()
            rows = []
    if rows:
        yield as_batch()


def _ordered(chats: DataFrame) -> DataFrame:
    return chats.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted")


def loss_mask(chats: DataFrame) -> DataFrame:
    """formatted() to (conv_id, start, stop): the places, in code points of a conversation's joined string, on which loss
    falls, a row for each assistant's text as it stands there, escaped. Texts of no characters are empty places."""
    return _ordered(chats).mapInArrow(_masked, "conv_id long, start long, stop long")


def read_back(chats: DataFrame) -> DataFrame:
    """formatted() to one row for each conversation, read back from its joined string alone: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Loss falls on what assistants say (see loss_mask).

    Turns are ordered by turn, then role, then string, nulls first. A conversation is read and hashed in one task as it
    streams by, whatever its length; rendering, checking and escaping are spread over all tasks before."""
    return _ordered(chats).mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L as conv_id, 0L as turn, 'user' as role, '{says}' as text union all select -7L, 1L, 'assistant', '{says}'")
    return read_back(formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, CASE WHEN regexp_matches(text, '\[/?(INST|ROLE)\]|</?s>|\\\\|[\[<]\\(/?(INST|ROLE)\]|/?s>)')
                 THEN length(regexp_replace(replace(text, '\', '\\'), '(\[/?(INST|ROLE)\]|</?s>)', '\1+', 'g')) ELSE length(text) END
            + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
