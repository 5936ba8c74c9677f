"""Chat formatting with DataFrame functions only.

A template declares the marks, the roles whose text is under the loss, and the
states: which role may follow which. A conversation becomes an array of segments
(text, loss); joined, they are the formatted text. Control strings inside texts get
a backslash, and one more if they have some already, so the marks stay unambiguous
and the texts can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolark.llm.tables import pick


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: Strings that a tokenizer could take for control tokens; begin and end are among them.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)
    #: States of the machine are the last role, "" at the start; the roles that may come next.
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)

    @property
    def pattern(self) -> str:
        """Java and RE2 alike."""
        return "(" + "|".join(re.sub(r"([\[\]|<>/\\])", r"\\\1", c).replace(r"\<", "<").replace(r"\>", ">").replace(r"\/", "/") for c in self.control) + ")"

    def escape(self, text: Column) -> Column:
        """A run of backslashes is looked at once, from its start and whole, so the time is in proportion to the text."""
        return F.regexp_replace(text, F.lit(r"(?<!\\)(\\*+)" + self.pattern), F.lit(r"\\$1$2"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(r"(?<!\\)\\(\\*+)" + self.pattern), F.lit("$1$2"))

    def escape_role(self, role: Column) -> Column:
        """A role is one line: its backslashes and line ends are escaped."""
        return F.replace(F.replace(self.escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))

    def unescape_role(self, line: Column) -> Column:
        parts = F.transform(F.split(line, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
        return self.unescape(F.array_join(parts, "\\"))


def conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, valid, bad_turn) of rows (conv_id, turn, role, text).

    Turns are in order of turn, then role, then text, nulls first; null roles and texts
    are empty. ``bad_turn`` is the position of the first turn that the machine doesn't
    allow after the one before, or the number of turns if only the end is wrong; null
    for a valid conversation. Invalid conversations are formatted all the same. Rows
    of a null conv_id are one conversation. A conversation is one record of the result,
    so its rows meet in one task. No rows give no rows; other columns are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = pick(rows, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    steps = [f"{a}>{b}" for a, after in template.turns.items() for b in after]
    before = F.concat(F.array(F.lit("")), F.transform("turns", lambda t: t["role"]))
    moves = F.zip_with(before, F.transform("turns", lambda t: t["role"]), lambda a, b: F.concat(a, F.lit(">"), b))
    allowed = F.transform(F.slice(moves, F.lit(1), F.size("turns")), lambda m: m.isin(*steps))
    bad = F.array_position(allowed, F.lit(False)) - 1
    ends = F.element_at("turns", -1)["role"].isin(*template.last)
    told = told.withColumn("bad_turn", F.when(bad >= 0, bad).when(~ends, F.size("turns").cast("long")))

    def segments(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.begin), template.escape_role(t["role"]), F.lit("\n")), F.lit(False)),
            part(template.escape(t["text"]), t["role"].isin(*template.trained)),
            part(F.lit(f"\n{template.end}\n"), F.lit(False)),
        )

    return told.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(text: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted text."""
    mark = re.sub(r"([|])", r"\\\1", template.end)
    pieces = F.filter(F.split(text, rf"(?<!\\){mark}\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(template.begin) + 1))
        line = F.substring_index(body, "\n", 1)
        rest = F.substr(body, F.length(line) + 2, F.length(body) - F.length(line) - 2)
        return F.struct(template.unescape_role(line).alias("role"), template.unescape(rest).alias("text"))

    return F.transform(pieces, turn)


def trained_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
