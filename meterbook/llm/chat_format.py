"""Chat formatting: records of different layouts become canonical turns and one template.

Layouts. A record's field paths (``messages[].role``, ``prompt``, ...) that any declared mapping
knows are sorted and hashed; the hash selects the mapping. Fields no mapping knows do not count,
so extra columns change nothing. Every layout but single turns is also declared with a ``system``
field, which becomes the first turn. A hash that no mapping declares, as of a record with fields of
two layouts, selects the mapping with most paths among those whose paths are all there, the one
declared first if several have as many. Only a record that has no mapping's paths is unknown: it is
returned with a null layout and no turns, never dropped.

Template. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<|``
is written ``<||``, so no control string can occur there, and line feeds in roles are written
``<|n>``. Both are undone exactly when the output is read back.

The formatted conversation is kept as one row per turn, in order, with the span under the loss
mask (texts of assistants). A conversation of any length is sorted and streamed, never held.

Defined cases: a null text or role is empty; turns sort by turn, nulls first, then by
their formatted text, and rows that repeat are turns of their own; a null conversation id is one conversation;
a record with an empty or null list of turns has its layout and one row with a null turn; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

START, END, OPEN, ESCAPED = "<|im_start|>", "<|im_end|>", "<|", "<||"
LINE_FEED_IN_ROLE = "<|n>"
ASSISTANT = "assistant"

#: Declared layouts: name, the field paths that identify it, and where its turns are. A turn is
#: ``(role, text)``; a leading ``=`` marks a fixed role, everything else is a path. ``each`` names
#: the list the paths are relative to.
_PLAIN = (
    {"name": "turn_rows", "each": None, "turns": (("role", "text"),)},
    {"name": "role_content", "each": "messages", "turns": (("role", "content"),)},
    {"name": "from_value", "each": "conversations", "turns": (("from", "value"),)},
    {"name": "prompt_response", "each": None, "turns": (("=user", "prompt"), ("=assistant", "response"))},
    {"name": "prompt_completion", "each": None, "turns": (("=user", "prompt"), ("=assistant", "completion"))},
    {"name": "instruction", "each": None, "turns": (("=user", "instruction"), ("=assistant", "output"))},
    {
        "name": "instruction_input",
        "each": None,
        "turns": (("=user", "instruction"), ("=user", "input"), ("=assistant", "output")),
    },
    {"name": "question_answer", "each": None, "turns": (("=user", "question"), ("=assistant", "answer"))},
)
_SYSTEM = ("=system", "system")
LAYOUTS = _PLAIN + tuple({**x, "name": f"system_{x['name']}", "lead": (_SYSTEM,)} for x in _PLAIN[1:])
#: Names that sources use for the three roles; rows of single turns are taken by the names they have.
ROLE_NAMES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


def _layout_paths(layout: dict) -> frozenset[str]:
    prefix = f"{layout['each']}[]." if layout["each"] else ""
    lead = {p for turn in layout.get("lead", ()) for p in turn if p[0] != "="}
    return frozenset(lead.union(prefix + p for turn in layout["turns"] for p in turn if p[0] != "="))


_KNOWN = frozenset().union(*map(_layout_paths, LAYOUTS))


def fingerprint(paths) -> str:
    """Hash of the known field paths among ``paths``."""
    return hashlib.sha256("\n".join(sorted(_KNOWN.intersection(paths))).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(_layout_paths(layout)): layout for layout in LAYOUTS}


def layout_of(paths) -> dict | None:
    """The mapping for a set of field paths."""
    exact = REGISTRY.get(fingerprint(paths))
    if exact is not None:
        return exact
    held = [layout for layout in LAYOUTS if _layout_paths(layout) <= set(paths)]
    return max(held, key=lambda layout: len(_layout_paths(layout)), default=None)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Leaf paths of a Spark type; ``[]`` marks list elements."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}".lstrip(".")) for f in kind))
    return {at}


def _empty_list_paths(record: dict) -> set[str]:
    """The paths that the turns of an empty or null list would have."""
    empty = {x["each"] for x in _PLAIN if x["each"] and x["each"] in record and not record[x["each"]]}
    return set().union(*(_layout_paths(x) for x in _PLAIN if x["each"] in empty))


def record_paths(value, at: str = "") -> set[str]:
    """Leaf paths of a parsed JSON value."""
    if isinstance(value, dict):
        return set().union(*(record_paths(v, f"{at}.{k}".lstrip(".")) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(record_paths(v, at + "[]") for v in value))
    return {at}


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _record_turns(layout: dict, record: dict) -> list[tuple[str, str]]:
    items = record.get(layout["each"]) if layout["each"] else [record]
    turns = [(role[1:], _text(record.get(text))) for role, text in layout.get("lead", ())]
    names = ROLE_NAMES if layout["name"] != "turn_rows" else {}
    for item in items or []:
        for role, text in layout["turns"] if isinstance(item, dict) else ():
            name = role[1:] if role[0] == "=" else _text(item.get(role))
            turns.append((names.get(name, name), _text(item.get(text))))
    return turns


def turns_of_json(records: DataFrame, record_id: str = "record_id", record: str = "record") -> DataFrame:
    """``conv_id, turn, role, text, layout`` from a column of JSON objects of any layout.

    A record that is null, not an object, or of no declared layout gives one row with null turn and
    null layout. The id may be of any type, a struct included.
    """

    key_type = to_arrow_type(records.schema[record_id].dataType)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [key_type, pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    value = json.loads(raw)
                except (TypeError, ValueError):
                    value = None
                paths = record_paths(value) | _empty_list_paths(value) if isinstance(value, dict) else ()
                layout = layout_of(paths)
                turns = _record_turns(layout, value) if layout else []
                for n, (role, text) in enumerate(turns):
                    rows.append((key, n, role, text, layout["name"]))
                if not turns:
                    rows.append((key, None, None, None, layout["name"] if layout else None))
            names = ["conv_id", "turn", "role", "text", "layout"]
            yield _batch(rows, names, kinds)

    kind = records.schema[record_id].dataType.simpleString()
    return records.select(F.col(record_id).alias("k"), F.col(record).alias("r")).mapInArrow(
        convert, f"conv_id {kind}, turn bigint, role string, text string, layout string"
    )


def turns_of_table(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, layout`` from a typed table; its schema is hashed once."""
    layout = layout_of(schema_paths(rows.schema))
    if layout is None:
        raise ValueError(f"no layout is declared for the fields {sorted(schema_paths(rows.schema))}")
    name = F.lit(layout["name"]).alias("layout")
    if layout["name"] == "turn_rows":
        return rows.select("conv_id", "turn", "role", "text", name)

    def turn(item, n: int, role: str, text: str) -> Column:
        said = F.lit(role[1:]) if role[0] == "=" else item[role]
        return F.struct(F.lit(n).alias("n"), said.alias("role"), item[text].cast("string").alias("text"))

    lead = layout.get("lead", ())
    row = F.struct(*[F.col(p) for p in sorted(_layout_paths(layout)) if "[]" not in p])
    first = [turn(row, n, r, t) for n, (r, t) in enumerate(lead)]
    if layout["each"]:  # a list without turns gives one row with a null turn, as for JSON
        (role, text), = layout["turns"]
        turns = F.transform(
            layout["each"],
            lambda x, i: F.struct(
                (i + len(lead)).alias("n"), x[role].cast("string").alias("role"), x[text].cast("string").alias("text")
            ),
        )
        if lead:
            turns = F.concat(F.array(*first), F.coalesce(turns, F.array().cast("array<struct<n:int,role:string,text:string>>")))
    else:
        turns = F.array(*first, *[turn(row, n, r, t) for n, (r, t) in enumerate(layout["turns"], len(lead))])
    role_names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return rows.select("conv_id", F.explode_outer(turns).alias("t")).select(
        "conv_id",
        F.col("t.n").cast("bigint").alias("turn"),
        F.coalesce(role_names[F.col("t.role")], F.col("t.role")).alias("role"),
        F.col("t.text").alias("text"),
        name,
    )


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit(ESCAPED))


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, piece, loss_start, loss_end``: one row per turn.

    The conversation's text is its pieces one after another in the order of ``in_order``. The
    loss span is in code points of the piece, and empty for turns of others than assistants.
    """
    role = F.coalesce("role", F.lit(""))
    safe_role = F.replace(_escaped(role), F.lit("\n"), F.lit(LINE_FEED_IN_ROLE))
    safe_text = _escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), safe_role, F.lit("\n"))
    learned = role == ASSISTANT
    start = F.length(head)
    return turns.select(
        "conv_id",
        "turn",
        F.concat(head, safe_text, F.lit(END + "\n")).alias("piece"),
        start.alias("loss_start"),
        F.when(learned, start + F.length(safe_text)).otherwise(start).alias("loss_end"),
    )


def in_order(pieces: DataFrame) -> DataFrame:
    """Each conversation whole in one partition and in order; rows stream, none is gathered."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")


def unescaped(text: str) -> str:
    return text.replace(ESCAPED, OPEN)


def read_turns(piece: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted text, found by its control strings."""
    at = 0
    while at < len(piece):
        if not piece.startswith(START, at):
            raise ValueError("a turn must begin with its mark")
        line = piece.index("\n", at)
        end = piece.index(END, line)
        role = piece[at + len(START) : line].replace(LINE_FEED_IN_ROLE, "\n")
        yield unescaped(role), unescaped(piece[line + 1 : end])
        at = end + len(END) + 1


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read from the formatted text itself."""
    key = pieces.schema["conv_id"].dataType
    schema = (
        f"conv_id {key.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [to_arrow_type(key), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, piece, start, end in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(_closed(*state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                learned = unescaped(piece[start:end])
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(piece)
            yield _batch(done, names, kinds)
        if state is not None:
            yield _batch([_closed(*state)], names, kinds)

    columns = pieces.select("conv_id", "piece", "loss_start", "loss_end", "turn")
    return in_order(columns).mapInArrow(digest, schema)


def _closed(conv, turns: int, said, chars: int, learned, length: int) -> tuple:
    return conv, turns, said.hexdigest(), chars, learned.hexdigest(), length


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
