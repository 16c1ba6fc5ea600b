"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a template.

The template is data: markers, the roles whose text carries loss, and the allowed transitions. Control
strings inside a text are escaped by one more backslash between '<' and '|', so a text never holds '<|' and
the escape is undone exactly. Built-in functions only.

A conversation is one value of the output, so its rows meet in one row by definition of the format. Segments carry the bytes of the output that
they cover, from running sums over the turns, and the text under the loss mask is cut from the output by them; both take time in proportion to
the conversation, whatever its number of turns.

Cases: a null text or role counts as empty; a role outside the template is formatted all the same and makes
the conversation invalid. Rows are ordered by turn, then role, then text, so ties and repeated rows have one
order; a null turn comes first; rows of a null id form one conversation. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    role_end: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; a state is the last role, or "start"
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    #: states that may end a conversation
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _run(roles: Column, template: Template) -> Column:
    """The state after all roles: the last role while each step is allowed, else 'error'."""
    steps = F.array(*[F.lit(f"{a}\x00{b}") for a, after in template.transitions.items() for b in after])
    return F.aggregate(
        roles,
        F.lit("start"),
        lambda state, role: F.when(F.array_contains(steps, F.concat(state, F.lit("\x00"), role)), role).otherwise(F.lit("error")),
    )


def format_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    template: Template = CHATML,
) -> DataFrame:
    """One row a conversation: id, n_turns, valid, segments array<struct<role, text, loss, start, size>>, formatted.

    start and size count bytes of the formatted text in UTF-8; a segment's text is in its escaped form.
    """
    blank = F.lit("")
    head = lambda role: F.concat(F.lit(template.begin), escape_role(role), F.lit(template.role_end))
    rows = turns.select(
        F.col(id_col).alias("_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), blank).alias("text"),
    )
    rows = rows.withColumn("size", (F.octet_length(head(F.col("role"))) + F.octet_length(escape(F.col("text"))) + len(template.end.encode())).cast("long"))
    before = Window.partitionBy("_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("_id", F.struct("turn", "role", "text", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("start"), "size").alias("_turn"))
    grouped = rows.groupBy("_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    loss = lambda t: t["role"].isin(*template.loss_roles)

    def segment(role: Column, text: Column, flag: Column, start: Column, size: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"), flag.alias("loss"), start.cast("long").alias("start"), size.cast("long").alias("size"))

    def three(t: Column) -> Column:
        first, end = head(t["role"]), len(template.end.encode())
        at = t["start"] + F.octet_length(first)
        return F.array(
            segment(t["role"], first, F.lit(False), t["start"], F.octet_length(first)),
            segment(t["role"], escape(t["text"]), loss(t), at, t["start"] + t["size"] - end - at),
            segment(t["role"], F.lit(template.end), F.lit(False), t["start"] + t["size"] - end, F.lit(end)),
        )

    ended = _run(F.transform("_turns", lambda t: t["role"]), template)
    return grouped.select(
        F.col("_id").alias(id_col),
        F.size("_turns").cast("long").alias("n_turns"),
        ended.isin(*template.final).alias("valid"),
        F.flatten(F.transform("_turns", three)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> parsed from the formatted text alone."""
    marker = lambda s: "\\Q" + s + "\\E"
    pieces = F.split(formatted, marker(template.begin))
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape_role(F.substring_index(p, template.role_end, 1)).alias("role"),
            unescape(
                F.substring(
                    p,
                    F.instr(p, template.role_end) + F.lit(len(template.role_end)),
                    F.length(p) - F.instr(p, template.role_end) + F.lit(1 - len(template.role_end) - len(template.end)),
                )
            ).alias("text"),
        ),
    )


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, cut from the formatted text by the segments' places, unescaped, in order, nothing between."""
    cut = lambda whole: F.transform(
        F.filter(segments, lambda s: s["loss"]), lambda s: unescape(F.decode(F.substring(whole, (s["start"] + 1).cast("int"), s["size"].cast("int")), "UTF-8"))
    )
    # the bytes as a lambda's variable, so that they are made once and not for each segment
    return F.array_join(F.element_at(F.transform(F.array(F.encode(formatted, "UTF-8")), cut), 1), "")
