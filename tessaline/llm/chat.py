"""Chat formatting: any known layout to canonical turns, turns to training text, and back.

A layout is known by its schema fingerprint: the SHA-256 of its nested field paths (arrays as `[]`, fields that no
mapping knows left out, so extra columns don't matter; one that bears the name of a known field does). Each fingerprint
selects a declarative mapping. Frames are told by their schema, JSON records one by one.

Of a list of turns, null items are none; a record with an item that isn't an object has an unknown layout, and so do
records that are no object or no JSON. A list without turns gives none. Texts given as lists of parts are the texts of
their parts, one after the other; other values count as their JSON. An id is an integer of 64 bits or a string of one,
anything else counts as null.

The template writes each turn as `<|turn|>role`, a line break, the text and `<|end|>`. In roles and texts `~`, `<` and
`[` (in roles also the line break) are escaped, so no control string of this or a common other template (`</s>`,
`[INST]`, `<|im_end|>` ...) remains inside a text, and unescaping gives back every character. Loss spans are code
point ranges of the formatted text that hold the assistant's escaped texts.

Null roles and texts are empty. Turns come in order of turn number (null last), ties by role, then text; repeated
rows are repeated turns. Rows without conversation id form one conversation with a null id. An empty table gives no
rows. A conversation is one value of the result, so it is put together in one task; nothing else is.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaline.llm.base import table

TURN, END = "<|turn|>", "<|end|>"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "~3"))
ASSISTANT = "assistant"
#: Whole numbers in strings, of no more digits than 64 bits have.
INTEGER = re.compile(r"[+-]?[0-9]{1,19}", re.ASCII)

#: Layouts by name. paths: their fields. id: the conversation's id. order: of rows, if turns are rows.
#: turns: (role, path of the text), or for lists (path of the role, path of the text) below `each`.
LAYOUTS = {
    "turn rows": {"paths": ["conv_id", "turn", "role", "text"], "id": "conv_id", "order": "turn", "row": ("role", "text")},
    "messages": {"paths": ["conv_id", "messages[].role", "messages[].content"], "id": "conv_id", "each": "messages", "item": ("role", "content")},
    "from-value": {"paths": ["id", "conversations[].from", "conversations[].value"], "id": "id", "each": "conversations", "item": ("from", "value"), "roles": {"human": "user", "gpt": ASSISTANT}},
    "message parts": {"paths": ["conv_id", "messages[].role", "messages[].content[].type", "messages[].content[].text"], "id": "conv_id", "each": "messages", "item": ("role", "content")},
    "texts and parts": {"paths": ["conv_id", "messages[].role", "messages[].content", "messages[].content[].type", "messages[].content[].text"], "id": "conv_id", "each": "messages", "item": ("role", "content")},
    "prompt": {"paths": ["conv_id", "prompt", "completion"], "id": "conv_id", "turns": [("user", "prompt"), (ASSISTANT, "completion")]},
    "instruction": {"paths": ["conv_id", "instruction", "input", "output"], "id": "conv_id", "turns": [("user", "instruction", "input"), (ASSISTANT, "output")]},
    "plain instruction": {"paths": ["conv_id", "instruction", "output"], "id": "conv_id", "turns": [("user", "instruction"), (ASSISTANT, "output")]},
    "context": {"paths": ["conv_id", "instruction", "context", "response"], "id": "conv_id", "turns": [("user", "instruction", "context"), (ASSISTANT, "response")]},
    "question": {"paths": ["conv_id", "question", "answer"], "id": "conv_id", "turns": [("user", "question"), (ASSISTANT, "answer")]},
    "query": {"paths": ["conv_id", "query", "response"], "id": "conv_id", "turns": [("user", "query"), (ASSISTANT, "response")]},
    "system prompt": {"paths": ["conv_id", "system", "prompt", "completion"], "id": "conv_id", "turns": [("system", "system"), ("user", "prompt"), (ASSISTANT, "completion")]},
}
KNOWN = {p for x in LAYOUTS.values() for p in x["paths"]}

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x["paths"]): name for name, x in LAYOUTS.items()}


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def value_paths(value, prefix: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{prefix}[]")}
    return {prefix}


def record_paths(record: dict) -> set[str]:
    """The paths of a JSON record; a list of turns without any has the fields of one."""
    paths = value_paths(record)
    for how in (x for x in LAYOUTS.values() if "each" in x):
        turns = record.get(how["each"])
        if isinstance(turns, list) and all(x is None for x in turns):
            paths |= {x for x in how["paths"] if x.startswith(f"{how['each']}[].") and x.count("[]") == 1}
    return paths


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _joined(c: Column, kind: T.DataType) -> Column:
    """A text, or the texts of a list of parts."""
    return F.array_join(F.transform(c, lambda x: _text(x["text"])), "") if isinstance(kind, T.ArrayType) else _text(c)


def canonical(df: DataFrame) -> DataFrame:
    """conv_id and turns (array of role and text) of a frame in one of the known layouts."""
    name = BY_FINGERPRINT.get(fingerprint(schema_paths(df.schema)))
    if name is None:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(df.schema))}")
    how = LAYOUTS[name]
    conv = F.col(how["id"]).try_cast("long").alias("conv_id")
    if "row" in how:
        role, text = how["row"]
        one = F.struct(F.col(how["order"]).isNull().alias("last"), F.col(how["order"]).alias("turn"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"))
        rows = df.select(conv, one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
        return rows.select("conv_id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    if "each" in how:
        role, text = how["item"]
        named = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in how.get("roles", {}).items()], _text(c))
        kind = df.schema[how["each"]].dataType.elementType[text].dataType
        some = F.filter(how["each"], lambda x: x.isNotNull())
        return df.select(conv, F.coalesce(F.transform(some, lambda x: F.struct(named(x[role]).alias("role"), F.coalesce(_joined(x[text], kind), F.lit("")).alias("text"))), F.array().cast(TURNS)).alias("turns"))
    turns = F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.nullif(F.col(p).cast("string"), F.lit("")) for p in paths]).alias("text")) for role, *paths in how["turns"]])
    return df.select(conv, turns.alias("turns"))


def _shown(value) -> str:
    """A JSON value as a text, without code points that no text can hold (halves of surrogate pairs)."""
    if isinstance(value, list) and value and all(isinstance(x, dict) and isinstance(x.get("text"), str | None) for x in value):
        value = "".join(x.get("text") or "" for x in value)
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value)
    return text.encode("utf-8", "replace").decode("utf-8")


def _whole_number(value) -> int | None:
    if isinstance(value, str):
        value = int(value) if INTEGER.fullmatch(value.strip()) else None
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def canonical_json(df: DataFrame, column: str = "record") -> DataFrame:
    """conv_id and turns of JSON records, each with a layout of its own (turn rows excepted); unknown ones: null turns."""

    def one(text: str | None):
        try:
            record = json.loads(text or "")
        except (ValueError, RecursionError):  # no JSON, or nested too deeply to be a conversation
            return None, None
        how = LAYOUTS.get(BY_FINGERPRINT.get(fingerprint(record_paths(record))) or "") if isinstance(record, dict) else None
        if how is None or "row" in how:
            return None, None
        if "each" in how:
            role, text_at = how["item"]
            items = [x for x in record[how["each"]] if x is not None] if isinstance(record[how["each"]], list) else [None]
            if not all(isinstance(x, dict) for x in items):
                return None, None
            turns = [(how.get("roles", {}).get(_shown(x.get(role)), _shown(x.get(role))), _shown(x.get(text_at))) for x in items]
        else:
            turns = [(role, "\n".join(t for p in paths if (t := _shown(record.get(p))))) for role, *paths in how["turns"]]
        return _whole_number(record.get(how["id"])), turns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [one(x) for x in batch.column(0).to_pylist()]
            ids = [i for i, _ in got]
            turns = [None if t is None else [{"role": r, "text": x} for r, x in t] for _, t in got]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], names=["conv_id", "turns"])

    return df.select(column).mapInArrow(run, "conv_id bigint, turns array<struct<role:string,text:string>>")


def escape(text: str, how=ESCAPES) -> str:
    for a, b in how:
        text = text.replace(a, b)
    return text


def unescape(text: str, how=ESCAPES) -> str:
    for a, b in reversed(how):
        text = text.replace(b, a)
    return text


def written_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role, ROLE_ESCAPES)}\n", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition("\n")
        out.append((unescape(role, ROLE_ESCAPES), unescape(text)))
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of canonical turns; null turns count as none."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            got = [written_turns([(x["role"] or "", x["text"] or "") for x in row or ()]) for row in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in got], pa.string()), pa.array(spans, kind)], names=["conv_id", "formatted", "loss_spans"])

    return turns.select("conv_id", "turns").mapInArrow(run, "conv_id bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def read_back(texts: DataFrame) -> DataFrame:
    """Counts and digests of what a formatted text and its loss spans hold."""

    def one(text: str, spans) -> tuple:
        turns = read_turns(text)
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        whole = hashlib.sha256()
        for role, t in turns:
            whole.update(f"{role}\n{t}\n".encode())
        return len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            got = [one(t or "", s or ()) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], names=["conv_id", *names])

    return texts.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"))
    return read_back(formatted(canonical(rows.unionByName(more))))


#: The template's length: TURN, line break and END around each turn, one more character for each escape.
OP8_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(16 + length(role) + length(text) + length(regexp_replace(role || text, '[^~<\\[]', '', 'g'))
    + length(role) - length(replace(role, chr(10), '')))::bigint as formatted_chars
from c group by conv_id
"""
