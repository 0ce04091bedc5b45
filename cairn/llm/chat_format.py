"""Conversations of any known layout as canonical turns, and those as one text per conversation with a loss mask."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import load

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"

#: Names of roles in known layouts, and what they are here.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How rows with the field paths ``paths`` become turns: ``turns`` is SQL for an array of struct<role, text>, or None
    where each row is one turn already, with the columns turn, role and text."""

    name: str
    paths: tuple[str, ...]
    turns: str | None


def _alternate(*turns: tuple[str, str]) -> str:
    parts = ", ".join(f"named_struct('role', '{role}', 'text', {text})" for role, text in turns)
    return f"filter(array({parts}), t -> t.text IS NOT NULL)"


#: The layouts known, with the paths that tell them apart.
LAYOUTS = (
    Layout("rows", ("conv_id", "role", "text", "turn"), None),
    Layout("messages", ("messages[].content", "messages[].role"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "transform(conversations, m -> named_struct('role', m.from, 'text', m.value))"),
    Layout("instruction_input", ("input", "instruction", "output"), _alternate(("user", "concat_ws('\n\n', instruction, nullif(input, ''))"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), _alternate(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", ("completion", "prompt"), _alternate(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), _alternate(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("answer", "question"), _alternate(("user", "question"), ("assistant", "answer"))),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves of a type, arrays marked ``[]``, in order."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: By fingerprint.
MAPPINGS = {fingerprint(x.paths): x for x in LAYOUTS}


def layout_of(schema: T.StructType, mappings: dict[str, Layout] = MAPPINGS) -> Layout:
    """The layout with a schema's fingerprint: the hash of its nested field paths. Paths that no layout knows (ids, other
    columns) don't count; where some are left over, the layout with the most of its own paths there is taken, the first
    of equals. A schema with no layout's paths is refused."""
    known = {p for x in mappings.values() for p in x.paths}
    paths = [p for p in field_paths(schema) if p in known]
    if exact := mappings.get(fingerprint(paths)):
        return exact
    found = [x for x in mappings.values() if set(x.paths) <= set(paths)]
    if not found:
        raise ValueError(f"no layout has the field paths {field_paths(schema)}")
    return max(found, key=lambda x: len(x.paths))


def _role(role: Column) -> Column:
    given = F.coalesce(role, F.lit(""))
    out = given
    for theirs, ours in ROLES.items():
        out = F.when(given == theirs, ours).otherwise(out)
    return out


def canonical_turns(df: DataFrame, *, conv_id: str = "conv_id", mappings: dict[str, Layout] = MAPPINGS) -> DataFrame:
    """Rows (conv_id, turn, role, text) from a table in any known layout; null roles and texts become empty, null ids stay. A table
    of whole conversations has them numbered from 0 in order. Repeated rows stay repeated; an empty table gives none; columns
    of other names do not count, whatever they are."""
    layout = layout_of(df.schema, mappings)
    if layout.turns is None:
        rows = df.select(F.col(conv_id).alias("conv_id"), "turn", "role", "text")
    else:
        rows = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(F.expr(layout.turns)).alias("turn", "_m")).select("conv_id", F.col("turn").cast("long"), "_m.role", "_m.text")
    return rows.select("conv_id", "turn", _role(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


#: One part of a schema as ``schema_of_variant`` writes it: a field's name, an opening, a closing, or a plain type.
_PART = r"`(?:[^`]|``)*`: |[^\s<>,:`]+: |OBJECT<|ARRAY<|>|[A-Z]+(?:\(\d+,\d+\))?"
#: Walks over such parts: the paths of the objects that are open, the path that the next value has, and those of all values.
_WALK = """aggregate(_parts, named_struct('open', cast(array() AS array<string>), 'at', '', 'paths', cast(array() AS array<string>)), (s, t) -> CASE
  WHEN endswith(t, ': ') THEN named_struct('open', s.open, 'at', concat_ws('.', nullif(element_at(s.open, -1), ''), regexp_extract(t, '^`?(.*?)`?: $', 1)), 'paths', s.paths)
  WHEN t = 'OBJECT<' THEN named_struct('open', array_append(s.open, s.at), 'at', s.at, 'paths', s.paths)
  WHEN t = 'ARRAY<' THEN named_struct('open', array_append(s.open, s.at), 'at', concat(s.at, '[]'), 'paths', s.paths)
  WHEN t = '>' THEN named_struct('open', slice(s.open, 1, size(s.open) - 1), 'at', s.at, 'paths', s.paths)
  ELSE named_struct('open', s.open, 'at', s.at, 'paths', array_append(s.paths, s.at)) END).paths"""


def with_json_paths(df: DataFrame, json: Column, name: str) -> DataFrame:
    """``df`` with the nested field paths of a JSON object, as ``field_paths`` has them for a type; none for what is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(json))
    parts = F.regexp_extract_all(F.coalesce(schema, F.lit("")), F.lit(_PART), F.lit(0))
    return df.withColumn("_parts", parts).withColumn(name, F.array_sort(F.expr(_WALK))).drop("_parts")


def canonical_json(df: DataFrame, json: str = "json", *, conv_id: str = "conv_id", mappings: dict[str, Layout] = MAPPINGS) -> tuple[DataFrame, DataFrame]:
    """For a column of JSON objects in mixed layouts: the canonical turns of all rows of known layouts, and (conv_id, json, paths)
    of every other row: no JSON, no known layout, or no turn in it (no text but null). Each row's fingerprint is the hash of
    its own nested field paths, of those that some layout has; where no layout has just these, the layout with the most paths
    is taken of those whose paths are all there, as for a table. Repeated rows are turns each; the rows are read once."""
    layouts = [x for x in mappings.values() if x.turns]
    known = sorted({p for x in mappings.values() for p in x.paths})
    rows = with_json_paths(df.select(F.col(conv_id).alias("_conv"), F.col(json).alias("_json")), F.col("_json"), "_paths")
    own = F.filter("_paths", lambda p: p.isin(known))
    rows = rows.withColumn("_print", F.sha2(F.array_join(own, "\n"), 256))
    layout = F.lit(None).cast("string")
    for x in sorted(layouts[::-1], key=lambda x: len(x.paths)):  # the last one that fits is taken
        layout = F.when(F.size(F.array_except(F.array(*map(F.lit, x.paths)), "_paths")) == 0, x.name).otherwise(layout)
    for x in layouts:
        layout = F.when(F.col("_print") == fingerprint(x.paths), x.name).otherwise(layout)
    wanted: dict[str, T.DataType] = {}
    for x in layouts:
        for p in x.paths:
            top, _, leaf = p.partition("[].")
            if leaf:
                wanted[top] = T.ArrayType(T.StructType([*(wanted[top].elementType.fields if top in wanted else []), T.StructField(leaf, T.StringType())]))
            else:
                wanted[top] = T.StringType()
    fields = T.StructType([T.StructField(n, t) for n, t in wanted.items()])
    rows = rows.select("_conv", "_json", "_paths", layout.alias("_layout"), F.from_json("_json", fields).alias("_o")).select("_conv", "_json", "_paths", "_layout", "_o.*")
    turns = "CASE " + " ".join(f"WHEN _layout = '{x.name}' THEN {x.turns}" for x in layouts) + " END"
    rows = rows.withColumn("_turns", F.expr(turns))
    some = F.coalesce(F.size("_turns") > 0, F.lit(False))
    each = rows.filter(some).select(F.col("_conv").alias("conv_id"), F.posexplode("_turns").alias("turn", "_m"))
    out = each.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("_m.role")).alias("role"), F.coalesce("_m.text", F.lit("")).alias("text"))
    return out, rows.filter(~some).select(F.col("_conv").alias("conv_id"), F.col("_json").alias("json"), F.col("_paths").alias("paths"))


def escape(text: Column) -> Column:
    """Without ``<|``, reversibly: backslashes are doubled, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, and ``mask``, an array of struct<start, length> in code points, the parts
    on which a loss is taken: the assistant's texts. Turns stand by (turn, role, text), repeated rows as often as they
    are there; all rows of a null id are one conversation, an empty table has none. One conversation is one text, however
    long, so one row holds it."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    parts = turns.select(
        "conv_id",
        F.struct("turn", "role", "text").alias("_o"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("_head"),
        escape(F.col("text")).alias("_body"),
        (F.col("role") == "assistant").alias("_loss"),
    )
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_o", "_head", "_body", "_loss"))).alias("_t"))
    done = grouped.withColumn("formatted", F.concat(F.array_join(F.transform("_t", lambda t: F.concat(t["_head"], t["_body"], F.lit(END + "\n"))), "")))
    lengths = F.transform("_t", lambda t: F.length(t["_head"]) + F.length(t["_body"]) + len(END) + 1)
    masked = done.withColumn("_n", lengths).withColumn(
        "mask",
        F.expr(
            "filter(transform(aggregate(_n, named_struct('at', 0, 'all', cast(array() AS array<int>)), (a, n) -> named_struct('at', a.at + n, 'all', array_append(a.all, a.at))).all,"
            " (at, i) -> struct(at + length(_t[i]._head) AS start, length(_t[i]._body) AS length, _t[i]._loss AS loss)), m -> m.loss)"
        ),
    )
    return masked.select("conv_id", "formatted", F.transform("mask", lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (array of struct<role, text>) and ``loss``, the texts under the mask, from ``formatted`` and ``mask`` alone."""
    seg = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda _, i: i > 0)
    role = lambda s: F.substring_index(s, "\n", 1)
    body = lambda s: s.substr(F.length(role(s)) + 2, F.length(s) - F.length(role(s)) - 2 - len(END))
    return formatted.withColumn("turns", F.transform(seg, lambda s: F.struct(unescape(role(s)).alias("role"), unescape(body(s)).alias("text")))).withColumn(
        "loss", F.transform("mask", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["length"])))
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(f"{END}{START}assistant ok").alias("text"))
    back = read_back(format_chats(canonical_turns(table.unionByName(probe))))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL_OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS r(i)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<|', ''))) / 2)::BIGINT AS formatted_chars
FROM t GROUP BY 1
"""
