"""Chat formatting: records of any known layout become canonical turns, and turns become one marked text.

Layouts are found by schema fingerprints. The nested field paths of a VARIANT record (`messages[].role`) follow from its
schema; those that any mapping knows are sorted and hashed, and the hash selects a declarative mapping. A mapping is a
list of steps: `Many` reads a list of messages, `Pairs` a list of question and answer pairs, `One` a turn from plain
fields. Its fingerprints are those of all combinations of its optional fields, made while the query is planned; two
mappings with the same fingerprint are refused. Fields that no mapping knows do not count.

The template marks turns as `<|im_start|>role\\ntext<|im_end|>\\n`. In texts and roles one backslash is put between
`<` and `|` (one more where there are some already), so that no text holds a control string, and taking one away gives
the text back. A line break in a role becomes `<|nl|>`. The loss mask has one span for each turn of a trained role:
the number of its turn from 0, and start and length in code points of its escaped text within the turn as it is
rendered. `read_turns` and `masked_texts` read turns and mask back from the formatted text.

Everything is column expressions. Rows of one conversation meet in one record, as its text does in the end; nothing
else is shuffled, and no layout is looked up by a join.

Defined cases: a null or unreadable record, and one whose fingerprint no mapping has, keep their row with null turns
(`layout` null), and `layouts_seen` counts them by their paths; an empty list gives no turns; null roles and texts
inside a list count as empty; a null plain field gives no turn. Turns with a number are ordered by it, null first;
ties by role and text; repeated rows are turns of their own. Rows without a conv_id are one conversation. Texts are
taken whole, up to Spark's limit for a VARIANT (128 MB a conversation). Columns of the input pass through `canonical`
and `formatted`, but for those named like a result (or `paths`), which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterload.llm.common import let

TURNS = "array<struct<role string, text string>>"
#: Names that data sets use for the two speakers (fixed values).
SPEAKERS = {"human": "user", "prompter": "user", "question": "user",
            "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant", "answer": "assistant"}


def _field(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, "$." + path, kind)


@dataclass(frozen=True)
class Many:
    """A list of messages under `path`, ordered by the field `order` or by their place."""

    path: str
    role: str
    text: str
    order: str | None = None
    speakers: Mapping[str, str] | None = None

    def path_sets(self) -> list[frozenset[str]]:
        item = f"{self.path}[]."
        fixed = {item + self.role} | ({item + self.order} if self.order else set())
        text = item + self.text
        texts = [{text}, {f"{text}[]"}, {f"{text}[].text"}, {f"{text}[].text", f"{text}[].type"}]
        return [frozenset({f"{self.path}[]"}), *[frozenset(fixed | some) for some in texts]]

    def turns(self, record: Column) -> Column:
        def turn(item: Column) -> Column:
            role = _field(item, self.role)
            if self.speakers:
                names = F.create_map(*[F.lit(x) for pair in self.speakers.items() for x in pair])
                role = F.coalesce(names[F.lower(role)], role)
            order = [_field(item, self.order, "long").alias("place")] if self.order else []
            return F.struct(*order, F.coalesce(role, F.lit("")).alias("role"),
                            _message_text(_field(item, self.text, "variant")).alias("text"))

        items = F.transform(_field(record, self.path, "array<variant>"), turn)
        if self.order:
            items = F.transform(F.sort_array(items), lambda t: F.struct(t["role"], t["text"]))
        return items


@dataclass(frozen=True)
class Pairs:
    """A list of [question, answer] pairs under `path`."""

    path: str
    roles: tuple[str, str] = ("user", "assistant")
    optional: bool = True

    def path_sets(self) -> list[frozenset[str]]:
        sets = [frozenset({f"{self.path}[][]"}), frozenset({f"{self.path}[]"})]
        return [*sets, frozenset()] if self.optional else sets

    def turns(self, record: Column) -> Column:
        pairs = F.coalesce(_field(record, self.path, "array<array<string>>"), F.array().cast("array<array<string>>"))
        return F.flatten(F.transform(pairs, lambda p: F.array(*[
            F.struct(F.lit(role).alias("role"), F.coalesce(F.get(p, F.lit(i)), F.lit("")).alias("text"))
            for i, role in enumerate(self.roles)])))


@dataclass(frozen=True)
class One:
    """One turn of a role from plain fields, joined by an empty line; the first field is needed unless `optional`."""

    role: str
    fields: tuple[str, ...]
    optional: bool = False

    def path_sets(self) -> list[frozenset[str]]:
        first, *more = self.fields
        sets = [frozenset({first, *some}) for n in range(len(more) + 1) for some in itertools.combinations(more, n)]
        return [*sets, frozenset()] if self.optional else sets

    def turns(self, record: Column) -> Column:
        texts = F.array(*[_field(record, f) for f in self.fields])
        joined = F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")
        turn = F.struct(F.lit(self.role).alias("role"), F.when(F.exists(texts, F.isnotnull), joined).alias("text"))
        return F.filter(F.array(turn), lambda t: t["text"].isNotNull())


def _message_text(content: Column) -> Column:
    """A string, or the texts of a list of parts one after the other; parts without a text (images) add nothing."""
    parts = F.filter(F.transform(content.try_cast("array<variant>"), lambda p: F.coalesce(
        F.try_variant_get(p, "$.text", "string"),
        F.when(~F.schema_of_variant(p).startswith("OBJECT"), F.try_variant_get(p, "$", "string")))),
        lambda t: t.isNotNull())
    whole = F.when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(parts, "")).otherwise(
        F.try_variant_get(content, "$", "string"))
    return F.coalesce(whole, F.lit(""))


@dataclass(frozen=True)
class Layout:
    name: str
    steps: tuple[Many | Pairs | One, ...]

    def path_sets(self) -> set[frozenset[str]]:
        return {frozenset().union(*choice) for choice in itertools.product(*[s.path_sets() for s in self.steps])}

    def turns(self, record: Column) -> Column:
        return F.concat(*[s.turns(record) for s in self.steps]).cast(TURNS)


_SYSTEM = One("system", ("system",), optional=True)
#: Layouts of public instruction and chat data sets.
LAYOUTS = (
    Layout("turn rows", (Many("turns", "role", "text", order="turn"),)),
    Layout("messages", (_SYSTEM, Many("messages", "role", "content", speakers=SPEAKERS))),
    Layout("conversations", (_SYSTEM, Many("conversations", "from", "value", speakers=SPEAKERS))),
    Layout("dialogue", (Many("dialogue", "speaker", "utterance", speakers=SPEAKERS),)),
    Layout("instruction", (_SYSTEM, Pairs("history"), One("user", ("instruction", "input")), One("assistant", ("output",)))),
    Layout("prompt and completion", (_SYSTEM, One("user", ("prompt",)), One("assistant", ("completion",)))),
    Layout("prompt and response", (_SYSTEM, Pairs("history"), One("user", ("prompt",)), One("assistant", ("response",)))),
    Layout("prompt and chosen", (_SYSTEM, One("user", ("prompt",)), One("assistant", ("chosen",)))),
    Layout("question and answer", (_SYSTEM, One("user", ("question", "context")), One("assistant", ("answer",)))),
    Layout("pairs", (_SYSTEM, Pairs("pairs", optional=False))),
)


def fingerprint_of(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _registry(layouts: Sequence[Layout]) -> dict[str, Layout]:
    known: dict[str, Layout] = {}
    for layout in layouts:
        for paths in layout.path_sets():
            other = known.setdefault(fingerprint_of(paths), layout)
            if other is not layout:
                raise ValueError(f"{layout.name} and {other.name} both claim {sorted(paths)}")
    return known


_NAME = r"(?:`(?:[^`]|``)*`|\w+): "
_TOKEN = rf"{_NAME}|ARRAY<|OBJECT<|>|[A-Z_]+(?:\(\d+,\d+\))?"


def field_paths(record: Column) -> Column:
    """The nested field paths of a VARIANT, each once and sorted: `a.b` within objects, `a[]` for list items.

    The schema's text is read token by token. The stack holds the path of each open container (C) or name (N).
    """
    def step(state: Column, token: Column) -> Column:
        stack, out = state["stack"], state["out"]
        top = F.element_at(stack, -1)
        path = F.substring(top, F.lit(2), F.length(top))
        name = F.regexp_replace(F.regexp_replace(token, "^`|`?: $", ""), "``", "`")
        named = F.concat(F.lit("N"), path, F.when(path == "", "").otherwise("."), name)
        without = F.slice(stack, F.lit(1), F.size(stack) - 1)

        def ended(rest: Column) -> Column:  # a value is complete: its name, if it has one, is too
            return F.when(F.element_at(rest, -1).startswith("N"), F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)

        opened = F.when(token == "ARRAY<", F.concat(F.lit("C"), path, F.lit("[]"))).otherwise(F.concat(F.lit("C"), path))
        scalar = ~token.endswith(": ") & ~token.isin("ARRAY<", "OBJECT<", ">")
        return F.struct(
            F.when(token.endswith(": "), F.array_append(stack, named))
            .when(token.isin("ARRAY<", "OBJECT<"), F.array_append(stack, opened))
            .when(token == ">", ended(without)).otherwise(ended(stack)).alias("stack"),
            F.when(scalar, F.array_append(out, path)).otherwise(out).alias("out"))

    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.array(F.lit("C")).alias("stack"), F.array().cast("array<string>").alias("out"))
    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["out"])))


def _as_variant(records: DataFrame, column: str) -> Column:
    kind = records.schema[column].dataType.typeName()
    value = F.col(f"`{column}`")
    if kind == "variant":
        return value
    if kind == "string":
        return F.try_parse_json(value)
    return F.call_function("to_variant_object", value)


def fingerprinted(records: DataFrame, column: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """`records` with the record as VARIANT, its `paths` and the `fingerprint` of those that `layouts` know."""
    vocabulary = sorted({path for layout in layouts for paths in layout.path_sets() for path in paths})
    known = F.array_intersect(F.col("paths"), F.array(*[F.lit(p) for p in vocabulary]))
    print_of = F.substring(F.sha2(F.array_join(F.array_sort(known), "\n"), 256), 1, 16)
    return (records.withColumn(column, _as_variant(records, column))
            .withColumn("paths", field_paths(F.col(f"`{column}`"))).withColumn("fingerprint", print_of))


def canonical(records: DataFrame, column: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """`records` with `fingerprint`, the name of the `layout` it selects, and canonical `turns` instead of the record."""
    registry = _registry(layouts)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        here = F.col("fingerprint").isin(sorted(p for p, other in registry.items() if other is layout))
        name = F.when(here, F.lit(layout.name)).otherwise(name)
        turns = F.when(here, layout.turns(F.col(f"`{column}`"))).otherwise(turns)
    found = fingerprinted(records, column, layouts).withColumn("layout", name)
    return found.withColumn("turns", turns).drop("paths", *([] if column == "turns" else [column]))


def layouts_seen(records: DataFrame, column: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Records by their paths: paths, fingerprint, layout (null: no mapping) and n_records. For declaring new ones."""
    names = {p: layout.name for p, layout in _registry(layouts).items()}
    seen = fingerprinted(records, column, layouts).groupBy("paths", "fingerprint").agg(F.count("*").alias("n_records"))
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return seen.withColumn("layout", table[F.col("fingerprint")])


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    line: str = "<|nl|>"
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = (self.start, self.end, self.line)
        if len(set(marks)) < 3 or not all(re.fullmatch(r"<\|\w+\|>", m) for m in marks):
            raise ValueError("marks are three different words between <| and |>")

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit(self.line))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit(self.line), F.lit("\n")))


CHATML = Template()


def formatted(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """`conversations` with `formatted`, the marked text of their `turns`, and its `loss_mask`."""
    escaped = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(template.start), template.escape_role(t["role"]), F.lit("\n")).alias("head"),
        template.escape(t["text"]).alias("text"), t["role"].isin(*template.trained).alias("trained")))
    mask = F.transform("_escaped", lambda t, i: F.when(t["trained"], F.struct(
        i.alias("turn"), F.char_length(t["head"]).alias("start"), F.char_length(t["text"]).alias("length"))))
    whole = F.array_join(F.transform(
        "_escaped", lambda t: F.concat(t["head"], t["text"], F.lit(template.end + "\n"))), "")
    return (conversations.withColumn("_escaped", escaped).withColumn("formatted", whole)
            .withColumn("loss_mask", F.filter(mask, lambda m: m.isNotNull())).drop("_escaped"))


def rendered_turns(text: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted text as they are rendered, without their end marks: those stand nowhere else."""
    return let(F.split(text, rf"\Q{template.end}\E\n"), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))


def read_turns(rendered: Column, template: Template = CHATML) -> Column:
    """Roles and texts of rendered turns, as they were before formatting."""
    def turn(one: Column) -> Column:
        head = F.instr(one, "\n")
        start = len(template.start)
        return F.struct(
            template.unescape_role(F.substring(one, F.lit(start + 1), head - start - 1)).alias("role"),
            template.unescape(F.substring(one, head + 1, F.char_length(one))).alias("text"))

    return F.transform(rendered, turn)


def masked_texts(rendered: Column, mask: Column, template: Template = CHATML) -> Column:
    """The texts under a loss mask, as they were before formatting."""
    return F.transform(mask, lambda m: template.unescape(
        F.substring(F.get(rendered, m["turn"]), m["start"] + 1, m["length"])))


def records_of(rows: DataFrame) -> DataFrame:
    """One record of turn rows for each conversation of (conv_id, turn, role, text)."""
    turns = F.collect_list(F.struct("turn", "role", "text")).alias("turns")
    return rows.groupBy("conv_id").agg(turns).select("conv_id", F.struct("turns").alias("record"))


def digests(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """Of formatted conversations, read back from the text: turns, masked text and length, as counts and digests."""
    read = conversations.select(
        "conv_id", "formatted", "loss_mask", rendered_turns(F.col("formatted"), template).alias("rendered"))
    read = read.select(
        "conv_id", "formatted", F.size("rendered").cast("long").alias("n_turns"),
        F.array_join(F.transform(read_turns(F.col("rendered"), template), lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(masked_texts(F.col("rendered"), F.col("loss_mask"), template), "").alias("loss"))
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


#: The same in SQL for DuckDB, with the columns of op11.
ORACLE = r"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(length('<|im_start|>') + 1 + length('<|im_end|>') + 1
           + length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>'))
           + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM spoken GROUP BY conv_id
"""
