"""Chat formatting by schema fingerprints.

A record arrives in one of many layouts: one row per turn, prompt and completion, instruction and
input, lists of messages. The sorted set of its nested field paths, as far as any layout knows them, is
hashed into a fingerprint, so that fields besides the layout's don't matter; a registry maps
fingerprints to declarative mappings, and the mapping turns the record into canonical
(position, role, text) turns. Turns are rendered with a template that marks turns with control
strings; control strings inside a text or role are escaped so that reading the output back gives the
very text. Each rendered turn is a row, in order, with the span of it that carries loss.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Control strings that a text may hold and the template must not be confused by.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.S)
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    r"""Double every backslash and put one after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"{START}{escape(role)}{SEP}{escape(text)}{END}\n"


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text; ValueError where it isn't whole turns."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def field_paths(value: object, path: str = "$") -> set[str]:
    """Nested field paths of a parsed JSON value; list items share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{path}.{k}")} or {f"{path}{{}}"}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Layouts by their field paths. "turns" lists (role, path) for one turn each; "each" walks a list whose
#: items hold role and text under the given keys. Roles are renamed by ROLES.
LAYOUTS = [
    ({"$.role", "$.text"}, {"turns": [("$.role", "$.text")]}),
    ({"$.role", "$.content"}, {"turns": [("$.role", "$.content")]}),
    ({"$.prompt", "$.completion"}, {"turns": [("user", "$.prompt"), ("assistant", "$.completion")]}),
    ({"$.prompt", "$.response"}, {"turns": [("user", "$.prompt"), ("assistant", "$.response")]}),
    ({"$.question", "$.answer"}, {"turns": [("user", "$.question"), ("assistant", "$.answer")]}),
    ({"$.instruction", "$.output"}, {"turns": [("user", "$.instruction"), ("assistant", "$.output")]}),
    ({"$.instruction", "$.input", "$.output"}, {"turns": [("user", ("$.instruction", "$.input")), ("assistant", "$.output")]}),
    ({"$.messages[].role", "$.messages[].content"}, {"each": "messages", "role": "role", "text": "content"}),
    ({"$.messages[].role", "$.messages[].text"}, {"each": "messages", "role": "role", "text": "text"}),
    ({"$.conversations[].from", "$.conversations[].value"}, {"each": "conversations", "role": "from", "text": "value"}),
]
# A system text may stand before whole conversations, and a list of messages may be empty.
LAYOUTS += [(p | {"$.system"}, m | {"system": "$.system"}) for p, m in LAYOUTS if not p & {"$.role"}]
LAYOUTS += [({f"$.{k}[]"}, {"each": k, "role": "", "text": ""}) for k in ("messages", "conversations")]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


class Registry:
    """Mappings by the fingerprints of their layouts."""

    def __init__(self, layouts: list[tuple[set[str], dict]]) -> None:
        self.known = set().union(*(paths for paths, _ in layouts))
        self.mappings = {fingerprint(paths): mapping for paths, mapping in layouts}

    def match(self, record: dict) -> tuple[str, dict | None]:
        """The record's fingerprint and its mapping; unknown records have that of all their paths."""
        paths = field_paths(record)
        mark = fingerprint(paths & self.known)
        return (mark, self.mappings[mark]) if mark in self.mappings else (fingerprint(paths), None)


REGISTRY = Registry(LAYOUTS)


def _value(record: dict, path: str) -> str:
    value = record.get(path.removeprefix("$."))
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict, registry: Registry = REGISTRY) -> tuple[str, list[tuple[str, str]] | None]:
    """The record's fingerprint and its turns; None where no mapping is registered for it."""
    mark, mapping = registry.match(record)
    if mapping is None:
        return mark, None
    turns = [("system", _value(record, mapping["system"]))] if "system" in mapping else []
    if "each" in mapping:
        items = record.get(mapping["each"]) or []
        turns += [(_value(x, "$." + mapping["role"]), _value(x, "$." + mapping["text"])) for x in items if isinstance(x, dict)]
    else:
        for role, source in mapping["turns"]:
            role = _value(record, role) if role.startswith("$.") else role
            parts = [_value(record, p) for p in ([source] if isinstance(source, str) else source)]
            turns.append((role, "\n\n".join(p for p in parts if p) if len(parts) > 1 else parts[0]))
    return mark, [(ROLES.get(r, r), t) for r, t in turns]


FORMATTED_SCHEMA = "conv_id long, turn long, part int, fingerprint string, formatted string, loss_start int, loss_end int"


def format_records(df: DataFrame, id_col: str, turn_col: str | None, record_col: str) -> DataFrame:
    """Format JSON records; one output row per turn, to be read in the order ``turn, part``.

    Columns: ``conv_id, turn, part, fingerprint, formatted, loss_start, loss_end`` (the loss span in
    code points of ``formatted``; equal where the turn carries none). ``part`` counts the turns of one
    record, so a record of a whole conversation and records of single turns both work. A missing text
    or role is the empty string. A record that is null, no JSON object or of an unknown layout gives
    one row with its fingerprint and a null ``formatted``, so that nothing is lost silently; one of no
    turns a row with an empty one. Repeated rows stay. An empty table gives an empty result. Other
    columns are ignored.
    """
    turn = F.col(turn_col).cast("long") if turn_col else F.lit(0).cast("long")
    picked = df.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn"), F.col(record_col).alias("record"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("conv_id", "turn", "part", "fingerprint", "formatted", "loss_start", "loss_end")}
        for conv, position, record in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            try:
                parsed = json.loads(record) if record is not None else None
            except ValueError:
                parsed = None
            mark, turns = canonical_turns(parsed) if isinstance(parsed, dict) else (None, None)
            for part, (role, text) in enumerate(turns or [(None, None)]):
                whole = render(role, text) if turns else None if turns is None else ""
                end = len(whole) - len(END) - 1 if role == "assistant" else 0
                start = end - len(escape(text)) if end else 0
                for c, v in zip(out, (conv, position, part, mark, whole, start, end), strict=True):
                    out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return picked.mapInArrow(lambda batches: (rows(b) for b in batches), FORMATTED_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unknown long"


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back and digest them, one row per conversation.

    ``n_unknown`` counts the conversation's records without a format, which are in no digest.
    A digest runs over a conversation in order, so its rows meet in one task, sorted by Spark; the task
    streams them and holds one hash state, not the conversation, however long that is.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, open_, turns, loss, n, loss_chars, chars, unknown = None, False, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0

        def table() -> pa.RecordBatch:
            names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
            kinds = [pa.string() if "string" in x else pa.int64() for x in DIGEST_SCHEMA.split(", ")]
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")]
            for c, text, start, end in zip(*columns, strict=True):
                if open_ and c != conv:
                    done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, unknown))
                    turns, loss, n, loss_chars, chars, unknown = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                conv, open_ = c, True
                if text is None:
                    unknown += 1
                    continue
                for role, said in read_back(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                masked = unescape(text[start:end])
                loss.update(masked.encode())
                loss_chars += len(masked)
                chars += len(text)
            if len(done) >= 5000:
                yield table()
                done = []
        if open_:
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, unknown))
            yield table()

    return ordered.mapInArrow(run, DIGEST_SCHEMA)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1, formatted, read back and digested.

    A row of the table is a record of one turn; conversation -1 comes as one record of two messages. Rows
    of one conversation are ordered by turn (null first), then by role and text.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = json.dumps({"messages": [{"role": r, "content": probe} for r in ("user", "assistant")]})
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    records = table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.to_json(F.struct(text("role").alias("role"), text("text").alias("text"))).alias("record"))
    records = records.unionByName(spark.createDataFrame([(-1, 0, extra)], records.schema))
    return digests(format_records(records, "conv_id", "turn", "record"))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(role) - length(replace(role, '\', ''))
    + length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(role || chr(0) || text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
    + 33 AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_unknown
FROM e GROUP BY conv_id
"""
