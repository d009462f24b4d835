"""Chat formatting: a role machine, a declarative template, and text segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Template:
    """Declares how turns are written and which of them count for the loss.

    labels: role -> label in the header ``open + label + close``; other roles are written as ``role=`` + role.
    learn: roles whose text is under the loss mask. moves: (state, role) -> state; a state is the last role,
    ``start`` before any turn. final: states in which a conversation may end.
    """

    open: str = "### "
    close: str = ": "
    end: str = "</turn>"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learn: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()
_UNKNOWN = "role="


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    r"""text with ``\`` doubled and the control strings ``###``, ``</turn>`` and ``: `` written ``\h``, ``\e``, ``\c``."""
    hashes = t.open.strip()
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(hashes), F.lit("\\h")), F.lit(t.end), F.lit("\\e")), F.lit(t.close), F.lit("\\c"))


def unescape(text: Column, t: Template = TEMPLATE) -> Column:
    """The inverse of escape: pieces between doubled backslashes hold whole escapes only."""
    hashes = t.open.strip()
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit(hashes)), F.lit("\\e"), F.lit(t.end)), F.lit("\\c"), F.lit(t.close))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def _label(role: Column, t: Template) -> Column:
    out = F.concat(F.lit(_UNKNOWN), escape(role, t))
    for r, label in t.labels.items():
        out = F.when(role == r, label).otherwise(out)
    return out


def _role(label: Column, t: Template) -> Column:
    out = unescape(F.substring(label, len(_UNKNOWN) + 1, 1 << 30), t)
    for r, own in t.labels.items():
        out = F.when(label == own, r).otherwise(out)
    return out


def format_chats(rows: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, segments, valid, error_turn and final_state.

    rows: conv_id, turn, role, text. Turns are ordered by turn (null first), ties by role and text; a null text or
    role is empty; repeated rows are repeated turns; rows with a null conv_id are one conversation; an empty table
    gives none. segments are (text, loss) pairs whose texts joined are ``formatted``; only the text of roles in
    t.learn has loss. The role machine walks the turns: error_turn is the place (from 0) of the first role that it
    has no move for, valid tells that there is none and the last state is final. Other columns are not read. A
    conversation is one value, as its output is, and must fit in a task.
    """
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("__turns"))
    head = lambda x: F.concat(F.lit(t.open), _label(x["role"], t), F.lit(t.close))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(F.transform("__turns", lambda x: F.array(seg(head(x), F.lit(False)), seg(escape(x["text"], t), x["role"].isin(*t.learn)), seg(F.lit(t.end + "\n"), F.lit(False)))))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}>{role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        to = F.element_at(moves, F.concat(acc["state"], F.lit(">"), x["role"]))
        bad = F.coalesce(acc["bad"], F.when(to.isNull(), acc["k"]))
        return F.struct(F.when(bad.isNull(), to).otherwise(acc["state"]).alias("state"), bad.alias("bad"), (acc["k"] + 1).alias("k"))

    walked = turns.withColumn("__walk", F.aggregate("__turns", start, step))
    out = walked.select("conv_id", F.size("__turns").cast("long").alias("n_turns"), parts.alias("segments"), "__walk")
    return out.select(
        "conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        (F.col("__walk.bad").isNull() & F.col("__walk.state").isin(*t.final)).alias("valid"), F.col("__walk.bad").alias("error_turn"), F.col("__walk.state").alias("final_state"),
    )


def read_turns(formatted: Column, t: Template = TEMPLATE) -> Column:
    """The (role, text) pairs written in a formatted conversation."""
    whole = F.split(formatted, t.end + "\n")

    def turn(x: Column) -> Column:
        body = F.substring(x, len(t.open) + 1, 1 << 30)
        cut = F.instr(body, t.close)
        return F.struct(_role(F.substring(body, F.lit(1), cut - 1), t).alias("role"), unescape(F.substring(body, cut + len(t.close), F.length(body)), t).alias("text"))

    return let(whole, lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), turn))


def loss_text(segments: Column, t: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
