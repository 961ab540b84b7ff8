"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role the text that opens and closes its
turns and whether its text is trained on, and says which roles may follow
which. The machine walks the turns of a conversation in order, notes turns out
of order, and emits segments with loss flags. Strings of the template that
occur inside texts are escaped, so that the output can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPE = "\\"
#: Characters of output after which a conversation is read back so far.
PART_CHARS = 1 << 20

TEMPLATE = {
    "begin": "<chat>\n",
    "end": "</chat>\n",
    "close": " </turn>\n",
    "roles": {
        "system": {"open": "### System: ", "loss": False},
        "user": {"open": "### User: ", "loss": False},
        "assistant": {"open": "### Assistant: ", "loss": True},
    },
    # any other role: its name stands between these
    "other": {"open": "### Role: ", "name_end": " </role> ", "loss": False},
    "order": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
}


@dataclass(frozen=True)
class Segment:
    text: str
    loss: bool


class ChatMachine:
    def __init__(self, template: dict = TEMPLATE):
        self.t = template
        self.opens = {r["open"]: name for name, r in template["roles"].items()}
        self.controls = list(dict.fromkeys(x.strip() for x in [template["begin"], template["end"], template["close"], template["other"]["open"], template["other"]["name_end"], *self.opens]))
        if any(not c or ESCAPE in c for c in self.controls):
            raise ValueError("a template's strings can't be blank or hold the escape character")
        # also where the text ends in the first part of such a string
        tails = sorted({c[:k] for c in self.controls for k in range(1, len(c))})
        self._escape = re.compile("(?=" + "|".join([re.escape(ESCAPE), *map(re.escape, self.controls), *(re.escape(x) + r"\Z" for x in tails)]) + ")")
        marks = [template["begin"], template["end"], template["close"], template["other"]["open"], template["other"]["name_end"], *self.opens]
        self._mark = re.compile("|".join([re.escape(ESCAPE) + r"[\s\S]", *(re.escape(m) for m in sorted(marks, key=len, reverse=True))]))

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda _: ESCAPE, text)

    def allowed(self, state: str, role: str) -> bool:
        return role in self.t["order"].get(state, [])

    def turn(self, role: str, text: str) -> list[Segment]:
        known = self.t["roles"].get(role)
        if known:
            opened, loss = known["open"], known["loss"]
        else:
            other = self.t["other"]
            opened, loss = other["open"] + self.escape(role) + other["name_end"], other["loss"]
        return [Segment(opened, False), Segment(self.escape(text), loss), Segment(self.t["close"], False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """The (role, text) of each turn of formatted output."""
        role, parts, at = None, [], 0
        for m in self._mark.finditer(formatted):
            parts.append(formatted[at : m.start()])
            at, mark = m.end(), m[0]
            if mark[0] == ESCAPE:
                parts.append(mark[1:])
            elif mark == self.t["close"]:
                yield role, "".join(parts)
                role, parts = None, []
            elif mark == self.t["other"]["name_end"]:
                role, parts = "".join(parts), []
            else:
                role, parts = self.opens.get(mark), []

    def unescape(self, text: str) -> str:
        return re.sub(re.escape(ESCAPE) + r"([\s\S])", r"\1", text)


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; equal turn numbers go by role and text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches) -> Iterator[list]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def format_segments(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The segments of every conversation: conv_id, seq, turn, role, in_order, text, loss.

    Joined by seq, the texts of a conversation are its formatted output. turn
    and role are null for the conversation's own beginning and end. in_order
    is false for a turn whose role may not follow the one before; such turns
    and unknown roles are formatted all the same. Null roles and texts count
    as empty. Conversations may be of any length: turns are read in a stream.
    """
    schema = "conv_id long, seq long, turn long, role string, in_order boolean, text string, loss boolean"

    def run(batches):
        machine, conv, state, seq, out = ChatMachine(template), (), "", 0, []

        def emit(*row):
            nonlocal seq
            out.append((conv, seq, *row))
            seq += 1

        def full():
            done, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()))], names=["conv_id", "seq", "turn", "role", "in_order", "text", "loss"])

        for conv_id, turn, role, text in _turns(batches):
            if conv_id != conv:
                if conv != ():
                    emit(None, None, None, template["end"], False)
                conv, state, seq = conv_id, "", 0
                emit(None, None, None, template["begin"], False)
            ok = machine.allowed(state, role)
            for s in machine.turn(role, text):
                emit(turn, role, ok, s.text, s.loss)
            state = role
            if len(out) >= 4096:
                yield full()
        if conv != ():
            emit(None, None, None, template["end"], False)
        if out:
            yield full()

    return _ordered(conversations).mapInArrow(run, schema)


def read_back(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Formats every conversation and digests what is read back from the output.

    conv_id, n_turns, n_out_of_order, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. The output is written as one text with its beginning and
    end, and with the spans that are trained on. All digests come from that
    text: turns as they are read from it, and what the spans hold, unescaped. A
    long conversation is read back in parts that end with a turn, so that it
    needs no more memory than PART_CHARS and a turn. Equal turn numbers go by
    role and text; other columns are ignored; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("n_turns", T.LongType()), ("n_out_of_order", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])
    names = schema.fieldNames()

    class Written:
        """The formatted output of one conversation and what is read back from it."""

        def __init__(self, machine, conv_id):
            self.machine, self.conv_id, self.state = machine, conv_id, ""
            self.turns = self.odd = self.chars = self.lost = self.size = 0
            self.parts, self.spans = [], []
            self.all_turns, self.loss = hashlib.sha256(), hashlib.sha256()
            self.write(template["begin"])

        def write(self, text: str, loss: bool = False) -> None:
            if loss:
                self.spans.append((self.size, self.size + len(text)))
            self.parts.append(text)
            self.size += len(text)

        def turn(self, role: str, text: str) -> None:
            self.odd += not self.machine.allowed(self.state, role)
            self.state = role
            for s in self.machine.turn(role, text):
                self.write(s.text, s.loss)
            if self.size > PART_CHARS:
                self.read()

        def read(self) -> None:
            output = "".join(self.parts)
            for role, text in self.machine.read(output):
                self.turns += 1
                self.all_turns.update(f"{role}\n{text}\n".encode())
            for start, end in self.spans:
                text = self.machine.unescape(output[start:end])
                self.lost += len(text)
                self.loss.update(text.encode())
            self.chars += len(output)
            self.parts, self.spans, self.size = [], [], 0

        def row(self) -> tuple:
            self.write(template["end"])
            self.read()
            return self.conv_id, self.turns, self.odd, self.all_turns.hexdigest(), self.lost, self.loss.hexdigest(), self.chars

    def run(batches):
        machine, out, now = ChatMachine(template), [], None

        def full():
            done, out[:] = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for c, n in zip(done, names)], names=names)

        for conv_id, _, role, text in _turns(batches):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.append(now.row())
                now = Written(machine, conv_id)
                if len(out) >= 4096:
                    yield full()
            now.turn(role, text)
        if now is not None:
            out.append(now.row())
        if out:
            yield full()

    return _ordered(conversations).mapInArrow(run, schema)


#: A conversation that says what the template's own marks look like.
SPOOF = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_back() of all conversations and of one that imitates the template, conversation -7 (a row of the table with this id is taken as one more turn of it)."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", SPOOF), (-7, 1, "assistant", SPOOF)], "conv_id long, turn long, role string, text string")
    return read_back(rows.unionByName(more))


def oracle(template: dict = TEMPLATE) -> str:
    """read_back() in DuckDB's SQL, for the known roles."""
    m = ChatMachine(template)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    times = lambda c: f"(length(text) - length(replace(text, {quote(c)}, ''))) // {len(c)}"
    tails: dict[int, set[str]] = {}
    for c in m.controls:
        for k in range(1, len(c)):
            tails.setdefault(k, set()).add(c[:k])
    marks = " + ".join([times(c) for c in (ESCAPE, *m.controls)] + [f"CAST(right(text, {k}) IN ({', '.join(map(quote, sorted(v)))}) AS INT)" for k, v in sorted(tails.items())])
    opens = " ".join(f"WHEN {quote(n)} THEN {len(r['open'])}" for n, r in template["roles"].items())
    losses = ", ".join(quote(n) for n, r in template["roles"].items() if r["loss"])
    pairs = ", ".join(f"({quote(a)}, {quote(b)})" for a, bs in template["order"].items() for b in bs)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {quote(SPOOF)}), (-7, 1, 'assistant', {quote(SPOOF)})
), d AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS prior,
         CASE role {opens} END + {len(template['close'])} + length(text) + {marks} AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE (prior, role) NOT IN ({pairs})) AS n_out_of_order,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({losses})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role IN ({losses})), '')) AS loss_sha256,
       CAST(sum(chars) + {len(template['begin']) + len(template['end'])} AS BIGINT) AS formatted_chars
FROM d GROUP BY conv_id
"""
