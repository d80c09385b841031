"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's layout is known by fingerprints: hashes of its nested field paths. LAYOUTS maps paths to the way their turns are read;
of a record's paths those that a layout knows are hashed, in order, and where that is the layout's own fingerprint the record is read
by it, the layout of most paths first. Other fields are let be. Tables of one row a turn are known in the same way by the
paths of their schema. All become turns (role, text), and a template marks them:

    <|turn|>ROLE\\nTEXT<|end|>\\n

Inside role and text a backslash becomes \\e, and the first character of every control string \\l (for <) or \\q (for [);
a line break in a role becomes \\n. No control string is then left in them, and each step can be undone. The loss mask
covers the texts of assistant turns.

Defined cases: a null text or role is empty; a null conv_id is one conversation; turns are ordered by turn (null first),
then role, then text, and repeated rows are turns each; an empty table leaves only what is added; other columns are not read.
A JSON record of unknown layout, or one that does not parse, has no turns and a null layout; its text is kept as it is in the column unread.
A field that is there counts, also where its value is null; a list counts by the fields of any of its items.
A conversation is one output row, so its turns meet in one task: its size is bounded by the longest string Spark can hold.
"""

from __future__ import annotations

from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_free_name

START, END = "<|turn|>", "<|end|>\n"
#: Strings that trained templates read as control, by what follows their first character.
CONTROL_AFTER_LESS, CONTROL_AFTER_BRACKET = r"(?=\||/?s>|</?SYS>>|/?unk>|/?pad>)", r"(?=/?INST\]|/?TOOL)"
TURNS = "array<struct<role:string,text:string>>"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    out = F.regexp_replace(out, "<" + CONTROL_AFTER_LESS, r"\\l")
    out = F.regexp_replace(out, r"\[" + CONTROL_AFTER_BRACKET, r"\\q")
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column) -> Column:
    """Undo: every backslash stands before its letter, so the backslash itself must come back last."""
    out = text
    for mark, char in (("\\n", "\n"), ("\\l", "<"), ("\\q", "["), ("\\e", "\\")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    return out


def formatted(turns: Column) -> Column:
    """One string from an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escaped(t["role"], True), F.lit("\n"), escaped(t["text"]), F.lit(END))), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted string."""
    parts = F.filter(F.split(text, r"<\|end\|>\n"), lambda p: F.startswith(p, F.lit(START)))
    at = lambda p: F.position(F.lit("\n"), p)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring(p, F.lit(len(START) + 1), at(p) - len(START) - 1)).alias("role"),
            unescaped(F.substring(p, at(p) + 1, F.length(p))).alias("text"),
        ),
    )


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema, sorted; [] marks an array."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in paths(f.dataType, f"{prefix}.{f.name}".lstrip(".")))
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, prefix + "[]")
    return [prefix]


#: Names of roles that are told in other words.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def _const(role: str, path: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(role).alias("role"), F.try_variant_get(v, f"$.{path}", "string").alias("text"))


def _list(path: str, role: str, text: str) -> Callable[[Column], Column]:
    def read(v: Column) -> Column:
        items = F.try_variant_get(v, f"$.{path}", "array<variant>")
        name = lambda x: F.try_variant_get(x, f"$.{role}", "string")
        known = F.create_map(*[F.lit(y) for p in ROLES.items() for y in p])
        return F.transform(items, lambda x: F.struct(F.coalesce(F.element_at(known, F.lower(name(x))), name(x)).alias("role"), F.try_variant_get(x, f"$.{text}", "string").alias("text")))

    return read


#: Field paths of a record -> its parts in order: ("one", role, path) or ("list", path, role field, text field).
LAYOUTS: dict[tuple[str, ...], list[tuple[str, ...]]] = {
    ("prompt", "response"): [("one", "user", "prompt"), ("one", "assistant", "response")],
    ("completion", "prompt"): [("one", "user", "prompt"), ("one", "assistant", "completion")],
    ("prompt", "response", "system"): [("one", "system", "system"), ("one", "user", "prompt"), ("one", "assistant", "response")],
    ("instruction", "output"): [("one", "user", "instruction"), ("one", "assistant", "output")],
    ("input", "instruction", "output"): [("both", "user", "instruction", "input"), ("one", "assistant", "output")],
    ("answer", "question"): [("one", "user", "question"), ("one", "assistant", "answer")],
    ("messages[].content", "messages[].role"): [("list", "messages", "role", "content")],
    ("conversations[].from", "conversations[].value"): [("list", "conversations", "from", "value")],
    ("turns[].role", "turns[].text"): [("list", "turns", "role", "text")],
}
#: Columns of tables of one row a turn: conversation, order, role and text.
TABLE_LAYOUTS = [("conv_id", "turn", "role", "text"), ("conversation_id", "position", "role", "content"), ("dialog_id", "turn_id", "speaker", "utterance")]


def fingerprint(names: Column) -> Column:
    """Of an array of paths: the hash of all of them in order."""
    return F.xxhash64(F.array_join(F.array_sort(names), "\n"))


def json_paths(record: Column) -> Column:
    """The nested paths of a parsed record, of all that some layout knows."""
    there = lambda v, path: F.try_variant_get(v, f"$.{path}", "variant").isNotNull()

    def one(path: str) -> Column:
        top, _, inner = path.partition("[].")
        if not inner:
            return F.when(there(record, top), path)
        return F.when(F.exists(F.try_variant_get(record, f"$.{top}", "array<variant>"), lambda x: there(x, inner)), path)

    return F.array_compact(F.array(*[one(p) for p in sorted({p for layout in LAYOUTS for p in layout})]))


def layout_of(payload: Column) -> Column:
    """The paths of the layout of a JSON record, joined by commas; null where none fits."""
    paths_here = json_paths(F.try_parse_json(payload))
    own = lambda layout: F.filter(paths_here, lambda p: p.isin(list(layout)))
    fits = [F.when(fingerprint(own(layout)) == fingerprint(F.array(*[F.lit(p) for p in layout])), ",".join(layout)) for layout in sorted(LAYOUTS, key=lambda v: -len(v))]
    return F.coalesce(*fits)


def _read(payload: Column, parts: list[tuple[str, ...]]) -> Column:
    v = F.try_parse_json(payload)
    got = []
    for kind, *how in parts:
        if kind == "one":
            got.append(F.array(_const(*how)(v)))
        elif kind == "both":
            role, a, b = how
            x, y = (F.coalesce(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")) for p in (a, b))
            got.append(F.array(F.struct(F.lit(role).alias("role"), F.when(y == "", x).otherwise(F.concat(x, F.lit("\n\n"), y)).alias("text"))))
        else:
            got.append(_list(*how)(v))
    return F.concat(*got).cast(TURNS)


def turns_of_json(payload: Column, layout: Column | None = None) -> Column:
    """Canonical turns of a JSON record by its layout; an empty array where the layout is unknown."""
    here = layout_of(payload) if layout is None else layout
    known = [F.when(here == ",".join(paths_), _read(payload, parts)) for paths_, parts in LAYOUTS.items()]
    return F.coalesce(*known, F.array().cast(TURNS))


def table_layout(schema: T.StructType) -> tuple[str, str, str, str]:
    """Columns of conversation, order, role and text of a table, by the fingerprint of its paths that a layout knows."""
    digest_ = lambda names: xxhash.xxh64_intdigest("\n".join(sorted(names)))
    here = set(paths(schema))
    for layout in TABLE_LAYOUTS:
        if digest_(here & set(layout)) == digest_(layout):
            return layout
    raise ValueError(f"no known layout of turns among {sorted(here)}")


def turns_of_table(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table whose schema has a known layout of one row a turn; more columns are let be."""
    conv, turn, role, text = table_layout(rows.schema)
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    per = with_free_name(rows, conv, turn, role, text).groupBy(conv).agg(F.array_sort(F.collect_list(one)).alias("v"))
    return per.select(F.col(conv).alias("conv_id"), F.transform("v", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def turns_of_records(records: DataFrame) -> DataFrame:
    """(conv_id, turns, layout, unread) of records (conv_id, payload) of JSON text; unread is the payload where no layout is known."""
    found = with_free_name(records, "conv_id", "payload").withColumn("layout", layout_of(F.col("payload")))
    return found.select("conv_id", turns_of_json(F.col("payload"), F.col("layout")).alias("turns"), "layout", F.when(F.col("layout").isNull(), F.col("payload")).alias("unread"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans): the string, and the start and length in code points of each assistant text in it."""
    out = turns.select("conv_id", "turns", formatted(F.col("turns")).alias("formatted"))
    parts = F.split("formatted", r"<\|end\|>\n")
    at = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    whole = F.filter(at, lambda x: F.startswith(x["p"], F.lit(START)))
    sizes = F.transform(whole, lambda x: F.struct(F.position(F.lit("\n"), x["p"]).alias("head"), F.length(x["p"]).alias("n"), unescaped(F.substring(x["p"], F.lit(len(START) + 1), F.position(F.lit("\n"), x["p"]) - len(START) - 1)).alias("role")))
    run = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["n"] + len(END)).alias("at"),
            F.when(x["role"] == "assistant", F.concat(s["out"], F.array(F.struct((s["at"] + x["head"]).alias("start"), (x["n"] - x["head"]).alias("length"))))).otherwise(s["out"]).alias("out"),
        ),
    )
    return out.select("conv_id", "formatted", run["out"].alias("spans"))


def digest(conversations: DataFrame) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    added = conversations.sparkSession.sql(f"""select -7L as conv_id, to_json(named_struct('messages', array(named_struct('role', 'user', 'content', '{control}'), named_struct('role', 'assistant', 'content', '{control}')))) as payload""")
    done = render(turns_of_table(conversations).unionByName(turns_of_records(added).select("conv_id", "turns")))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.transform("spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
