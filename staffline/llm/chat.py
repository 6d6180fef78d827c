"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template names what stands before and after a turn, the roles whose texts count for the loss, and
the transitions of the turn-order machine. `format_chats` groups turns by conversation, orders them by (turn, role,
text), runs the machine, and emits segments (text, loss) whose concatenation is the formatted conversation.

Texts are escaped reversibly so that no control string can be forged: with E = backslash, E becomes Eb and the control
opener <| becomes <Ep; in roles a line feed also becomes En. Every E in escaped text starts one of these codes, so
`unescape` replaces them in turn, Eb last.

Defined results: null text and null role count as empty; a row with null conversation id belongs to the conversation
null; ties in turn are ordered by role, then text, null turns first; repeated rows are repeated turns; roles the
template does not name are formatted without loss and make the conversation invalid; an empty table gives no rows.
A conversation is one row of the result, so it has to fit in one, as a document has to.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|im_start|>", "<|im_end|>", "\n"
ERROR = "error"


@dataclass(frozen=True)
class Template:
    """open + role + line feed + text + close + end per turn; loss_roles' texts are trained on."""

    open: str = OPEN
    close: str = CLOSE
    end: str = END
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "begin"
    transitions: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: MappingProxyType({
            ("begin", "system"): "system",
            ("begin", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        })
    )
    final: frozenset[str] = frozenset({"user", "assistant"})


CHATML = Template()


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|")) if role else F.replace(c, F.lit("\\p"), F.lit("|"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def _machine(turns: Column, template: Template) -> Column:
    """The state after all turns; ERROR swallows what follows a turn that has no transition."""

    def step(state: Column, turn: Column) -> Column:
        out = None
        for (a, role), b in template.transitions.items():
            ok = (state == F.lit(a)) & (turn["role"] == F.lit(role))
            out = F.when(ok, F.lit(b)) if out is None else out.when(ok, F.lit(b))
        return out.otherwise(F.lit(ERROR))

    return F.aggregate(turns, F.lit(template.start), step)


def format_chats(turns: DataFrame, template: Template = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seg = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    trained = lambda t: t["role"].isin(*sorted(template.loss_roles)) if template.loss_roles else F.lit(False)
    pieces = lambda t: F.array(
        seg(F.concat(F.lit(template.open), escape(t["role"], role=True), F.lit("\n")), F.lit(False)),
        seg(escape(t["text"]), trained(t)),
        seg(F.lit(template.close + template.end), F.lit(False)),
    )
    return (
        turns.groupBy(F.col(conv_id).alias("conv_id"))
        .agg(F.array_sort(F.collect_list(row)).alias("turns"))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), _machine(F.col("turns"), template).isin(*sorted(template.final)).alias("valid"), F.flatten(F.transform("turns", pieces)).alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    parts = F.slice(F.split(formatted, "\\Q" + template.open + "\\E", -1), 2, 2**30)
    head = lambda p: F.substring_index(p, "\n", 1)
    rest = lambda p: F.substr(p, F.length(head(p)) + F.lit(2))
    body = lambda p: F.substr(rest(p), F.lit(1), F.length(rest(p)) - F.lit(len(template.close + template.end)))
    return F.transform(parts, lambda p: F.struct(unescape(head(p), role=True).alias("role"), unescape(body(p)).alias("text")))


def digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid; read back from the output."""
    turns = read_back(F.col("formatted"), template)
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
