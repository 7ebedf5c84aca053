"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record may be laid out in many ways: messages with role and content, conversations with from and value, prompt and response, instruction, input and
output ...  The nested field paths that a row fills are sorted and hashed; the hash selects a declarative mapping to canonical
turns (role, text).  A template then marks the turns; control strings inside texts are escaped reversibly, and segments say
which text is under the loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"


# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Messages:
    """A list of messages: `column`[].`role`, `column`[].`text`."""

    name: str
    column: str
    role: str
    text: str
    renamed: tuple[tuple[str, str], ...] = ()

    def shapes(self) -> list[set[str]]:
        return [{f"{self.column}[].{self.role}", f"{self.column}[].{self.text}"}]

    def turns(self, has: set[str]) -> Column:
        def turn(m: Column) -> Column:
            role = m[self.role]
            for old, new in self.renamed:
                role = F.when(m[self.role] == old, F.lit(new)).otherwise(role)
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text"))

        return F.transform(self.column, turn)


@dataclass(frozen=True)
class Fields:
    """A field for each turn; (role, fields): the filled ones of `fields` are joined by a blank line, none filled: no turn."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def shapes(self) -> list[set[str]]:
        needed = {f for _, fields in self.parts for f in fields} - set(self.optional)
        return [needed | set(some) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]

    def turns(self, has: set[str]) -> Column:
        turns = []
        for role, fields in self.parts:
            filled = [F.col(f) for f in fields if f in has]
            if filled:
                turns.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *filled).alias("text")))
        return F.array(*turns)


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Messages("turns", "turns", "role", "text"),
    Messages("messages", "messages", "role", "content", _SPEAKERS),
    Messages("conversations", "conversations", "from", "value", _SPEAKERS),
    Fields("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Fields("prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    Fields("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    Fields("question_answer", (("user", ("context", "question")), ("assistant", ("answer",))), ("context",)),
    Fields("nested_prompt", (("user", ("prompt.text",)), ("assistant", ("response.text",)))),
)


def _paths(kind: T.DataType, at: Column, name: str) -> list[tuple[str, Column]]:
    """(path, whether the value at `at` fills it) of each leaf."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, at[f.name], f"{name}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        fills = lambda i: lambda e: _paths(kind.elementType, e, "")[i][1]
        return [(path, F.coalesce(F.exists(at, fills(i)), F.lit(False))) for i, path in enumerate(_names(kind.elementType, f"{name}[]"))]
    return [(name, at.isNotNull())]


def _names(kind: T.DataType, name: str) -> list[str]:
    if isinstance(kind, T.StructType):
        return [n for f in kind.fields for n in _names(f.dataType, f"{name}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return _names(kind.elementType, f"{name}[]")
    return [name]


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """A hash of the sorted nested field paths of `columns` that a row fills."""
    found = [p for f in df.schema.fields if f.name in columns for p in _paths(f.dataType, F.col(f"`{f.name}`"), f.name)]
    present = F.array_compact(F.array(*(F.when(filled, F.lit(path)) for path, filled in found)))
    return F.xxhash64(F.array_join(F.array_sort(present), ","))


def canonical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with layout (its name; null: no mapping has this fingerprint) and turns (null if there is no layout); columns of these names are replaced.

    Rows are never dropped; null roles and texts of messages are empty; a field that no layout names makes the
    fingerprint unknown, so pass in `columns` those that hold the record.
    """
    columns = columns or df.columns
    here = {n for f in df.schema.fields if f.name in columns for n in _names(f.dataType, f.name)}
    free = "_fingerprint"
    while free in df.columns:
        free += "_"
    hashed, name, turns = F.col(free), F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for layout in LAYOUTS:
        for shape in layout.shapes():
            if shape <= here:
                known = hashed == F.xxhash64(F.lit(",".join(sorted(shape))))
                name = F.when(known, F.lit(layout.name)).otherwise(name)
                turns = F.when(known, layout.turns(shape).cast(TURN)).otherwise(turns)
    hashes = df.withColumn(free, fingerprint(df, columns))
    return hashes.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("layout", "turns")), name.alias("layout"), turns.alias("turns"))


# ---------------------------------------------------------------- template

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other public templates.
CONTROL = (
    START, END, "<|endoftext|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>",
)
#: Starts an escape; it is followed by 0 for itself, n for a newline in a role, or the control string's letter.
ESCAPE = "␛"
_CODES = {control: chr(ord("A") + i) for i, control in enumerate(CONTROL)}


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0"))
    for control, code in _CODES.items():
        text = F.replace(text, F.lit(control), F.lit(ESCAPE + code))
    return F.replace(text, F.lit("\n"), F.lit(f"{ESCAPE}n")) if role else text


def unescaped(text: Column) -> Column:
    """An escape's code never starts or ends another escape, so the order of replacement doesn't matter but for the last."""
    for control, code in _CODES.items():
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(control))
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}n"), F.lit("\n")), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def formatted(df: DataFrame) -> DataFrame:
    """df (with turns) with segments (text, loss: whether it is under the loss mask) and formatted, all their text in a row; columns of these
    names are replaced."""

    def segments(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(part(F.concat(F.lit(START), escaped(t["role"], True), F.lit("\n")), no), part(escaped(t["text"]), t["role"] == "assistant"), part(F.lit(f"{END}\n"), no))

    out = df.withColumn("segments", F.flatten(F.transform("turns", segments)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, f"\\Q{START}\\E", -1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - len(END) - 1)
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def from_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Records (key, turns) from a row for each turn: key, turn, role, text.  Null roles and texts are empty; equal turns go by role and text.

    A conversation becomes one record, so its rows meet in one task; there is no other form of this result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def laid_out(records: DataFrame) -> DataFrame:
    """Records (conv_id, turns) in the layouts that their roles allow, one for each record: as prompt and response or completion, with or without a
    system text, as conversations between human and gpt, as messages, or as they are.  The other fields are null.
    """
    roles, here = F.transform("turns", lambda t: t["role"]), lambda *r: F.array(*map(F.lit, r))
    text = lambda role: F.try_element_at(F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"]), F.lit(1))
    pair = (roles == here("user", "assistant")) | (roles == here("system", "user", "assistant"))
    even = F.col("conv_id") % 2 == 0
    two = F.forall(roles, lambda r: r.isin("user", "assistant"))
    plain = F.forall(roles, lambda r: ~r.isin(*(old for old, _ in _SPEAKERS)))
    kind = F.when(pair & even, "response").when(pair, "completion").when(two, "conversations").when(plain, "messages").otherwise("turns")
    only = lambda k, c: F.when(F.col("_kind") == k, c)
    says = lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value"))
    fields = F.col("_kind").isin("response", "completion")
    return records.withColumn("_kind", kind).select(
        "conv_id", only("turns", F.col("turns")).alias("turns"), only("conversations", F.transform("turns", says)).alias("conversations"),
        only("messages", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        F.when(fields, text("system")).alias("system"), F.when(fields, text("user")).alias("prompt"),
        only("response", text("assistant")).alias("response"), only("completion", text("assistant")).alias("completion"),
    )


PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    """op2: what is read back from the formatted conversations.

    The table has one layout, so that its records are laid out in several first: the fingerprints then select the mapping that
    brings each back to turns.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    records = laid_out(from_rows(rows.union(probe)))
    out = formatted(canonical(records, records.columns[1:])).select("conv_id", "segments", "formatted")
    back = out.select("conv_id", "formatted", parsed(F.col("formatted")).alias("back"), unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(text: str, role: bool = False) -> str:
    text = f"replace({text}, '{ESCAPE}', '{ESCAPE}0')"
    for control, code in _CODES.items():
        text = f"replace({text}, '{control}', '{ESCAPE}{code}')"
    return f"replace({text}, chr(10), '{ESCAPE}n')" if role else text


SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss,
  sum({len(START) + len(END) + 2} + length({_sql_escaped("role", True)}) + length({_sql_escaped("text")}))::BIGINT AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
