"""Chat formatting (DataFrame functions only).

A template (plain data) says how each role is shown and whether its text is
under the loss mask. Turns of a conversation become an array of segments
(text, loss); control strings inside texts are escaped reversibly, so the
formatted string can be parsed back. A finite-state machine over the roles,
also plain data, judges the order of the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

#: role -> (shown name, loss on its text); any other role is shown as "=" + role, without loss.
TEMPLATE = {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)}
OPEN, CLOSE, END = "### ", ": ", "</turn>\n"

#: Turn order: state -> role -> next state. A role without an entry is an error;
#: a conversation must stop in one of FINAL.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
FINAL = ("user", "assistant")

#: Escapes: no text or role keeps a "#" or "<", so none can hold OPEN or END;
#: ":" and line ends are escaped in role names only. The backslash comes first here and last when undone.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c"), ("\n", "\\n")]


def escape(c: Column, pairs=ESCAPES) -> Column:
    for plain, safe in pairs:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for plain, safe in reversed(pairs):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def _lookup(key: Column, pairs: dict, default: Column) -> Column:
    out = default
    for k, v in pairs.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def turn_error(roles: Column, machine=MACHINE, final=FINAL) -> Column:
    """Null for a valid order; else the 0-based turn at which it breaks (the
    number of turns if it only stops too early)."""
    moves = {f"{s}|{r}": t for s, m in machine.items() for r, t in m.items()}
    step = F.aggregate(
        roles, F.struct(F.lit("start").alias("s"), F.lit(0).alias("n"), F.lit(-1).alias("bad")),
        lambda a, r: F.struct(
            F.when(a["bad"] >= 0, a["s"]).otherwise(_lookup(F.concat(a["s"], F.lit("|"), r), moves, F.lit("error"))).alias("s"),
            (a["n"] + 1).alias("n"),
            F.when(a["bad"] >= 0, a["bad"])
             .when(_lookup(F.concat(a["s"], F.lit("|"), r), moves, F.lit("error")) == "error", a["n"])
             .otherwise(F.lit(-1)).alias("bad")),
        lambda a: F.when(a["bad"] >= 0, a["bad"]).when(~a["s"].isin(*final), a["n"]))
    return step


def format_chats(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
                 template=TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of text,
    loss; its texts joined are ``formatted``), error_turn (see turn_error).

    Rows go by turn, then role and text, so ties and repeated rows have one
    order and each is a turn. Null role or text counts as empty; null turns
    come first; rows with a null conv_id are one conversation. No rows give no
    conversation. A conversation becomes one string, so its own turns (and
    only these) are gathered in one row."""
    d = columns(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    d = d.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    shown = _lookup(F.col("role"), {k: v[0] for k, v in template.items()},
                    F.concat(F.lit("="), escape(F.col("role"), ROLE_ESCAPES)))
    loss = _lookup(F.col("role"), {k: v[1] for k, v in template.items()}, F.lit(False))
    d = d.select("conv_id", F.struct("turn", "role", "text", F.concat(F.lit(OPEN), shown, F.lit(CLOSE)).alias("head"),
                                     escape(F.col("text")).alias("body"), loss.alias("loss")).alias("t"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    segment = lambda text, on: F.struct(text.alias("text"), on.alias("loss"))
    segments = F.flatten(F.transform("t", lambda t: F.array(
        segment(t["head"], F.lit(False)), segment(t["body"], t["loss"]), segment(F.lit(END), F.lit(False)))))
    d = d.select("conv_id", segments.alias("segments"), turn_error(F.col("t.role")).alias("error_turn"))
    return d.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", "error_turn")


def read_back(formatted: Column, template=TEMPLATE) -> Column:
    """Array of (role, text) parsed from a formatted string."""
    turns = F.split(formatted, END, -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)  # what follows the last END is empty
    names = {v[0]: k for k, v in template.items()}

    def turn(t: Column) -> Column:
        head = F.substring_index(t, CLOSE, 1)
        name = F.substring(head, len(OPEN) + 1, F.lit(1 << 30))
        role = _lookup(name, names, unescape(F.substring(name, 2, F.lit(1 << 30)), ROLE_ESCAPES))
        return F.struct(role.alias("role"), unescape(F.substring(t, F.length(head) + len(CLOSE) + 1, F.lit(2147483647))).alias("text"))
    return F.transform(turns, turn)


def digest(chats: DataFrame) -> DataFrame:
    """Columns read back from the output of format_chats, and its verdict on the order of turns."""
    back = chats.withColumn("turns", read_back(F.col("formatted")))
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = back.withColumn("masked", masked)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "error_turn")


def with_probe(rows: DataFrame) -> DataFrame:
    """Conversations plus number -7, whose texts hold the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    probe = rows.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (
  SELECT conv_id, CAST(coalesce(min(i) FILTER (WHERE NOT coalesce(
           CASE coalesce(before, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
                WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' END, false)),
         CASE WHEN arg_max(role, i) = 'system' THEN count(*) END) AS INTEGER) AS error_turn
  FROM o GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS masked,
         sum(length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
             + length('### : </turn>') + 1
             + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
                    ELSE 1 + length(role) + length(role) - length(replace(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''), chr(10), '')) END)
           AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(masked) AS loss_chars,
       sha256(masked) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, error_turn
FROM g JOIN e USING (conv_id)
"""
