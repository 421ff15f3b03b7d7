"""Chat formatting: a state machine over roles and a template that can be read back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What marks a turn, which roles carry loss, and which role may follow which state.

    A control string inside a text becomes a backslash and its letter, a backslash becomes
    ``\\b``; so the output holds control strings only where the template put them. Control
    strings start with a character other than a letter or digit and hold no backslash.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def __post_init__(self) -> None:
        if len(self.control) > 20 or any(not c or c[0].isalnum() or "\\" in c for c in self.control):
            raise ValueError("control strings must not start with a letter or digit, nor hold a backslash")
        if not self.open.strip("\n") in self.control or not self.close.strip("\n") in self.control:
            raise ValueError("the marks of a turn must be control strings")

    def _codes(self) -> list[tuple[str, str]]:
        return [(c, f"\\{chr(ord('c') + i)}") for i, c in enumerate(self.control)]

    def escape(self, text: Column) -> Column:
        pairs = [("\\", "\\b"), *self._codes()]
        return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)

    def unescape(self, text: Column) -> Column:
        pairs = [*((b, a) for a, b in self._codes()), ("\\b", "\\")]
        return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("\\a"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("\\a"), F.lit("\n")))

    def step(self) -> Callable[[Column, Column], Column]:
        """The state after a role; 'error' is final."""
        table = F.create_map(*[F.lit(x) for state, roles in self.moves.items() for role in roles for x in (f"{state}>{role}", role)])
        return lambda state, role: F.coalesce(table[F.concat(state, F.lit(">"), role)], F.lit("error"))


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conv_id: conv_id, n_turns, valid, formatted, segments(text, loss).

    Turns are ordered by turn (null first), then role, then text, so ties have one order.
    Null role and null text count as empty. Every turn is formatted; ``valid`` tells whether the
    machine accepts the order of the roles. ``segments`` joined give ``formatted``. Rows with a
    null conv_id form one conversation, repeated rows are turns of their own, an empty table
    gives no rows and other columns are ignored.
    """
    t = template or ChatTemplate()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), filled_text().alias("text"))
    seq = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", F.row_number().over(seq).alias("seq"), "role", F.concat(F.lit(t.open), t.escape_role(F.col("role")), F.lit("\n")).alias("head"), t.escape(F.col("text")).alias("body"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "head", "body"))).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(segment(x["head"], F.lit(False)), segment(x["body"], x["role"].isin(*t.loss_roles)), segment(F.lit(t.close), F.lit(False)))))
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: t.step()(s, x["role"]))
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*t.accept).alias("valid"), segments.alias("segments"))
    return chats.select("conv_id", "n_turns", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def filled_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def read_back(chats: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parse ``formatted`` into turns(role, text), and take the text under the loss mask from the segments."""
    t = template or ChatTemplate()
    parts = F.slice(F.split("formatted", _literal(t.open)), F.lit(2), F.size(F.split("formatted", _literal(t.open))) - 1)
    out = chats.withColumn("parts", parts)
    cut = lambda p: F.split(p, "\n", 2)
    text = lambda p: F.substring(cut(p)[1], F.lit(1), F.length(cut(p)[1]) - len(t.close))
    read = F.transform("parts", lambda p: F.struct(t.unescape_role(cut(p)[0]).alias("role"), t.unescape(text(p)).alias("text")))
    loss = t.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    return out.withColumns({"read": read, "loss_text": loss}).drop("parts")


def _literal(mark: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "\n" else c for c in mark)
