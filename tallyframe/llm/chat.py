"""Chat formatting: layouts found by schema fingerprint, turned into marked turns.

Every known layout is a declarative mapping: the nested field paths that make it
up and the SQL that yields its turns. The fingerprint of a table, or of a JSON
record, is the hash of those of its paths that any mapping knows, so unknown
extra fields change nothing; it selects the mapping.

A formatted conversation is one text. Each turn reads ``<turn ROLE>``, a line
break, the text, ``</turn>`` and a line break; the role is percent-encoded.
Inside texts a control string ``<turn`` or ``</turn`` gets one backslash more
after its ``<`` than it has, which reading takes away again, so every text comes
back unchanged and no text can open or close a turn. ``loss`` holds, for each
turn, how many characters from the turn's first are outside the loss and how many
after them are under it.

Only DataFrame and SQL functions are used.

Defined results: null texts and roles count as empty; turns that share a number
are ordered by role, then text; repeated rows are turns of their own; rows of a
null conversation form one conversation; a record of an unknown layout keeps its
fingerprint and has no turns. One conversation becomes one row, so it must fit a
task; conversations are otherwise independent.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
TRAINED_ROLE = "assistant"
_CLOSE = "</turn>\n"


@dataclass(frozen=True)
class Mapping:
    """A layout: its paths, those that may be absent, and SQL for its turns.

    ``{path}`` in ``turns`` stands for the field; an absent one becomes NULL. A
    layout with ``rows`` keeps one turn per row: (conversation, order, role, text).
    """
    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str = ""
    rows: tuple[str, ...] = ()


_PAIR = ("filter(array(named_struct('role', 'system', 'text', {system}), "
         "named_struct('role', 'user', 'text', %s), named_struct('role', 'assistant', 'text', %s)), "
         "t -> t.text IS NOT NULL OR t.role <> 'system')")
_NAMED = ("transform({%s}, m -> named_struct('role', CASE m.%s WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' "
          "ELSE m.%s END, 'text', m.%s))")
#: A system text beside the turns leads them, unless they hold it themselves.
_LED = ("transform(array(%s), t -> concat(filter(array(named_struct('role', 'system', 'text', {system})), "
        "s -> s.text IS NOT NULL AND NOT coalesce(exists(t, x -> x.role = 'system' AND x.text = s.text), false)), t))[0]")
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), ("system",),
            turns=_LED % (_NAMED % ("messages", "role", "role", "content"))),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), ("system",),
            turns=_LED % (_NAMED % ("conversations", "from", "from", "value"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"),
            turns=_PAIR % ("concat_ws('\\n\\n', {instruction}, nullif({input}, ''))", "{output}")),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), turns=_PAIR % ("{prompt}", "{completion}")),
    Mapping("prompt_response", ("prompt", "response"), ("system",), turns=_PAIR % ("{prompt}", "{response}")),
    Mapping("question_answer", ("question", "answer"), ("system",), turns=_PAIR % ("{question}", "{answer}")),
)


def known_paths(mappings: tuple[Mapping, ...] = MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for p in m.paths + m.optional})


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, tuple[Mapping, frozenset[str]]]:
    """Fingerprint -> mapping and the paths present, for every choice of optional paths."""
    return {fingerprint(m.paths + extra): (m, frozenset(m.paths + extra))
            for m in mappings for n in range(len(m.optional) + 1) for extra in combinations(m.optional, n)}


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema, arrays marked with []."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def table_layout(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[Mapping, frozenset[str]]:
    """The mapping that a table's schema selects."""
    paths = set(schema_paths(df.schema)) & set(known_paths(mappings))
    # Paths of other layouts may clash (a column `text` beside `messages`): the largest complete layout counts.
    found = registry(mappings).get(fingerprint(paths))
    if found is None:
        whole = [(len(p), m.name, m, p) for m, p in registry(mappings).values() if p <= paths]
        if not whole:
            raise ValueError(f"no mapping for the fields {sorted(schema_paths(df.schema))}")
        _, _, *found = max(whole, key=lambda w: w[:2])
    return found[0], found[1]


def _turns_sql(mapping: Mapping, present: frozenset[str], field) -> str:
    fields = {p.partition("[")[0] for p in mapping.paths + mapping.optional}
    here = {p.partition("[")[0] for p in present}
    return f"CAST({mapping.turns.format(**{f: field(f) if f in here else 'CAST(NULL AS STRING)' for f in fields})} AS {TURNS})"


def canonical_turns(df: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turns) of a table in any known layout."""
    mapping, present = table_layout(df, mappings)
    if not mapping.rows:
        return df.select(F.col(f"`{id_col}`").alias("conv_id"),
                         F.expr(_turns_sql(mapping, present, lambda f: f"`{f}`")).alias("turns"))
    conv, turn, role, text = (F.col(f"`{c}`") for c in mapping.rows)
    rows = df.select(conv.alias("conv_id"), F.struct(turn.alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    return (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.expr(f"CAST(transform(t, x -> named_struct('role', x.role, 'text', x.text)) AS {TURNS})")
                    .alias("turns")))


def _has(path: str) -> Column:
    """Whether a record has the path; one inside an array counts if any element has it."""
    head, _, field = path.partition("[].")
    if not field:
        return F.try_variant_get("_record", f"$.{path}", "variant").isNotNull()
    return F.exists(F.try_variant_get("_record", f"$.{head}", "array<variant>"),
                    lambda m: F.try_variant_get(m, f"$.{field}", "variant").isNotNull())


def _elements(name: str, fields: list[str]) -> str:
    """SQL for an array of a record, each element read by itself."""
    pairs = ", ".join(f"'{f}', try_variant_get(e, '$.{f}', 'string')" for f in fields)
    return f"transform(try_variant_get(_record, '$.{name}', 'array<variant>'), e -> named_struct({pairs}))"


def canonical_records(df: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` to records of mixed layouts, given as JSON text."""
    whole = [m for m in mappings if not m.rows]
    record = F.try_parse_json(F.col(f"`{json_col}`"))
    parsed = df.withColumn("_record", record)
    present = F.filter(F.array(*[F.when(_has(p), F.lit(p)) for p in known_paths(tuple(whole))]), lambda p: p.isNotNull())
    parsed = parsed.withColumn("_present", present)
    parsed = parsed.withColumn("fingerprint", F.sha2(F.array_join("_present", "\n"), 256))
    known = sorted(registry(tuple(whole)).items(), key=lambda w: (len(w[1][1]), w[1][0].name))
    # A registered fingerprint selects its mapping. Another stands for fields of several layouts: as for
    # tables, the largest complete one counts, the last wrapped around the others, by its own fingerprint.
    largest = F.lit(None).cast("string")
    for key, (_, paths) in known:
        complete = F.size(F.array_except(F.array(*map(F.lit, sorted(paths))), "_present")) == 0
        largest = F.when(complete, F.lit(key)).otherwise(largest)
    own = F.when(F.col("fingerprint").isin([key for key, _ in known]), F.col("fingerprint"))
    parsed = parsed.withColumn("_mapping", F.coalesce(own, largest))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for key, (m, paths) in known:
        lists = {p.partition("[")[0]: [q.partition(".")[2] for q in m.paths if q.startswith(p.partition(".")[0] + ".")]
                 for p in m.paths if "[" in p}
        sql = _turns_sql(m, paths, lambda f, lists=lists: _elements(f, lists[f]) if f in lists else f"try_variant_get(_record, '$.{f}', 'string')")
        chosen = F.col("_mapping") == key
        layout, turns = F.when(chosen, F.lit(m.name)).otherwise(layout), F.when(chosen, F.expr(sql)).otherwise(turns)
    return parsed.withColumns({"layout": layout, "turns": turns}).drop("_record", "_present", "_mapping")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss is one (skip, keep) pair of character counts per turn."""
    parts = conversations.select("conv_id", F.transform(F.coalesce("turns", F.array().cast(TURNS)), lambda t: F.struct(
        F.concat(F.lit("<turn "), F.url_encode(F.coalesce(t["role"], F.lit(""))), F.lit(">\n")).alias("head"),
        escape(F.coalesce(t["text"], F.lit(""))).alias("body"),
        F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False)).alias("trained"))).alias("parts"))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE))), "").alias("formatted"),
        F.transform("parts", lambda p: F.struct(
            F.length(p["head"]).cast("long").alias("skip"),
            F.when(p["trained"], F.length(p["body"])).otherwise(0).cast("long").alias("keep"))).alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` and ``trained`` (the texts under the loss, in order), read from the formatted text."""
    whole = formatted.withColumn("_pieces", F.split("formatted", _CLOSE))
    whole = whole.withColumn("_pieces", F.slice("_pieces", 1, F.size("_pieces") - 1))
    turns = F.transform("_pieces", lambda p: F.struct(
        F.url_decode(F.regexp_extract(p, r"^<turn ([^>]*)>\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"^<turn [^>]*>\n", "")).alias("text")))
    under = F.zip_with("_pieces", "loss", lambda p, n: F.when(
        n["keep"] > 0, unescape(F.substring(p, (n["skip"] + 1).cast("int"), n["keep"].cast("int")))).otherwise(""))
    return whole.withColumns({"turns": turns, "trained": under}).drop("_pieces")
