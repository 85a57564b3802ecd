"""Conversations as training text, in DataFrame operations only.

A template declares how a turn of each role is written, which roles are trained on, and the states of the turn order. A
conversation becomes text segments with a loss flag each; joined they are its text. Control strings inside roles and texts
are escaped, so that what was written can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, DONE, BROKEN = "start", "done", "broken"


@dataclass(frozen=True)
class Template:
    """How turns are written: ``begin`` role ``prompt`` or ``answer`` text ``end``.

    ``answer`` marks turns of ``loss_roles``, ``prompt`` those of all other roles. ``moves`` maps state and role to the
    next state; what is missing leads to ``broken``. ``final`` are the states in which a conversation may end.
    """

    begin: str = "<s>"
    prompt: str = "[INST]"
    answer: str = "[/INST]"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "briefed", (START, "user"): "asked", ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(sorted({self.begin, self.prompt, self.answer, self.end}, key=lambda c: (-len(c), c)))


def escaped(text: Column, template: Template) -> Column:
    """Backslashes doubled, and one put behind the first letter of every control string."""
    pattern = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def order_state(roles: Column, template: Template) -> Column:
    """The state after all turns."""
    moves = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)])
    step = lambda state, role: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit(BROKEN))
    return F.aggregate(roles, F.lit(START), step)


def formatted(
    turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, segments, formatted, state, valid`` of every conversation.

    ``segments`` are structs of ``text`` and ``loss``, three per turn: its marker, its text, its end. ``valid`` tells
    whether the state machine accepts the order of the roles; such conversations are written all the same. Null roles and
    texts are empty. Turns come by number, null numbers last; equal numbers by role, then text, and repeated rows repeat.
    Rows with a null conversation id form one conversation. Other columns are not read. An empty table gives no rows.

    A conversation is one value of the result, so its rows meet in one row of one task, as in any output of this form;
    aggregation by id moves every row once and nothing else.
    """
    row = F.struct(
        F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    talks = turns.select(F.col(conv).alias("conv"), row.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def written(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        mark = F.when(loss, F.lit(template.answer)).otherwise(F.lit(template.prompt))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(F.concat(F.lit(template.begin), escaped(t["role"], template), mark), F.lit(False)),
            segment(escaped(t["text"], template), loss),
            segment(F.lit(template.end), F.lit(False)),
        )

    state = order_state(F.transform("turns", lambda t: t["role"]), template)
    rows = talks.select("conv", F.flatten(F.transform("turns", written)).alias("segments"), state.alias("state"))
    return rows.select(
        F.col("conv").alias(conv), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state",
        F.col("state").isin(*template.final).alias("valid"),
    )


def read_back(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """``rows`` of :func:`formatted` with ``turns`` (role, text), parsed from the text, and ``loss_texts`` from the flags."""
    whole = F.split("formatted", re.escape(template.end))
    marks = f"{re.escape(template.prompt)}|{re.escape(template.answer)}"
    turn = rf"(?s)^{re.escape(template.begin)}(.*?)(?:{marks})(.*)$"
    parse = lambda t: F.struct(unescaped(F.regexp_extract(t, turn, 1)).alias("role"), unescaped(F.regexp_extract(t, turn, 2)).alias("text"))
    return rows.withColumns(
        {
            "turns": F.transform(F.slice(whole, 1, F.size(whole) - 1), parse),
            "loss_texts": F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])),
        }
    )


def digests(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of what :func:`read_back` found."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("loss_texts", "")
    return read_back(rows).select(
        conv, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length(trained).cast("bigint").alias("loss_chars"), F.sha2(trained.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid",
    )


PLANTED = """SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
             FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""


def oracle() -> str:
    """DuckDB SQL for the query, written for the default template."""
    def escape(column: str) -> str:
        sql = rf"replace({column}, '\', '\\')"
        for c in Template().controls:
            sql = f"replace({sql}, '{c}', '{c[0]}' || '\\' || '{c[1:]}')"
        return sql

    wrap = len("<s></s>")
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
    r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({wrap} + length({escape('role')}) + length({escape('text')})
                    + CASE role WHEN 'assistant' THEN {len(Template.answer)} ELSE {len(Template.prompt)} END) AS BIGINT) AS formatted_chars,
           bool_and(CASE role WHEN 'system' THEN before IS NULL
                              WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                              WHEN 'assistant' THEN before = 'user' AND before IS NOT NULL ELSE false END
                    AND (NOT last OR role = 'assistant')) AS valid
    FROM r GROUP BY conv_id"""
