"""Chat formatting: turn order by a finite-state machine, text segments with loss flags from a template.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """How turns are written, and which orders of roles are valid.

    A turn is ``open``, its role, ``middle``, its escaped text, ``close``. The
    three marks start with ``mark``, a character that ``escape`` replaces inside
    texts and roles, so no text can hold a mark: each escape character becomes
    itself and ``0``, each mark character the escape character and ``1``.
    ``controls`` are strings of other chat formats; one that occurs in a text is
    broken by the escape character and ``2`` after its first character, so the
    output never holds it. Loss is taken over the text of turns whose role is in
    ``loss_roles``. ``steps`` are the machine's transitions, from a state by a
    role to a state; it starts in ``start`` and must end in one of ``final``.
    """

    mark: str = "<"
    escape: str = "\\"
    open: str = "<|turn|>"
    middle: str = "<|text|>"
    close: str = "<|end|>"
    controls: tuple[str, ...] = ("[INST]", "[/INST]", "[SYS]", "[/SYS]")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


TEMPLATE = Template()


def escaped(text: Column, t: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape + "0"))
    out = F.replace(out, F.lit(t.mark), F.lit(t.escape + "1"))
    for c in t.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + t.escape + "2" + c[1:]))
    return out


def unescaped(text: Column, t: Template = TEMPLATE) -> Column:
    """The inverse of escaped: an escape character is always followed by 0, 1 or 2."""
    out = F.replace(text, F.lit(t.escape + "2"), F.lit(""))
    out = F.replace(out, F.lit(t.escape + "1"), F.lit(t.mark))
    return F.replace(out, F.lit(t.escape + "0"), F.lit(t.escape))


def end_state(roles: Column, t: Template = TEMPLATE) -> Column:
    """The machine's state after an array of roles; 'invalid' once a step is missing."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("invalid")
        for (source, by), to in t.steps.items():
            out = F.when((state == source) & (role == by), F.lit(to)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(t.start), step)


def formatted(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", t: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, end_state, valid, segments (array of {text, loss}), formatted.

    The conversation's rows are ordered by turn, then role, then text, so ties
    have one order; repeated rows stay. A null text or role is empty, a null
    turn comes first, and null conversation ids form one conversation. ``end_state``
    is the machine's state after all roles ('invalid' once a step is missing) and
    ``valid`` says whether it accepts them; invalid conversations are
    formatted all the same. ``segments`` alternate between marks without loss and
    texts; ``formatted`` is their concatenation. Other columns are ignored and an
    empty table gives no rows. All rows of one conversation meet in one row, as
    its one output string requires.
    """
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(turn: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t.open), escaped(turn["role"], t), F.lit(t.middle)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(turn["text"], t).alias("text"), turn["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    out = whole.select("conv_id", end_state(F.transform("turns", lambda x: x["role"]), t).alias("end_state"), F.flatten(F.transform("turns", segments)).alias("segments"))
    out = out.select("conv_id", "end_state", F.col("end_state").isin(*t.final).alias("valid"), "segments")
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed(formatted_col: Column, t: Template = TEMPLATE) -> Column:
    """The turns of a formatted string, as an array of {role, text}, read from the string alone."""
    bodies = F.split(F.substring(formatted_col, len(t.open) + 1, 2_147_483_647), _literal(t.close + t.open))
    # The last body still ends with the closing mark, which no text can hold.
    bodies = F.transform(bodies, lambda b: F.replace(b, F.lit(t.close), F.lit("")))
    return F.when(F.length(formatted_col) == 0, F.array().cast(TURNS)).otherwise(
        F.transform(bodies, lambda b: F.struct(unescaped(F.substring_index(b, t.middle, 1), t).alias("role"), unescaped(F.substring_index(b, t.middle, -1), t).alias("text")))
    )


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _literal(s: str) -> str:
    """A regular expression for s itself."""
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def read_back(df: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """conv_id, end_state, valid, formatted, turns, loss_text: from formatted (the turns) and segments (the text under the loss mask)."""
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    return df.select("conv_id", "end_state", "valid", "formatted", parsed(F.col("formatted"), t).alias("turns"), masked.alias("loss_text"))
