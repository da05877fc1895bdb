"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Each turn is rendered between marks that depend on its role.  The rendered
text is parsed again by a strict grammar; where a turn does not come back
exactly as it was, its text is escaped and it is rendered anew.  The parser is
strict: every character must belong to a turn.  A conversation that, put
together, would not be recovered identically stops the job.  Escaping puts one more backslash after the first
character of every control string (and of every one that already holds
backslashes), so taking one away again restores the text.

Edge cases: a null text is empty, a null role is the empty role; turns are
ordered by turn (nulls first), then role, then text, so ties and repeated rows
have a fixed order; rows with a null conversation id form one conversation;
an empty table gives no rows; other columns are ignored.  A conversation is
one value, so it is limited by Spark's 2 GB for a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
CONTROL = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|/TURN\])"
BARE = r"[<\[]" + CONTROL
TO_ESCAPE = r"([<\[])(\\*)" + CONTROL
ESCAPED = r"([<\[])\\(\\*)" + CONTROL
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[/ROLE\].*?\[/TURN\]"
OPEN = {"user": "[INST] ", "assistant": "<s>", "system": "<<SYS>>"}
CLOSE = {"user": " [/INST]", "assistant": "</s>", "system": "<</SYS>>"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, TO_ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _by_role(role: Column, marks: dict[str, str], other) -> Column:
    out = F
    for name, mark in marks.items():
        out = out.when(role == name, F.lit(mark))
    return out.otherwise(other)


def opening(role: Column) -> Column:
    return _by_role(role, OPEN, F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]")))


def closing(role: Column) -> Column:
    return _by_role(role, CLOSE, F.lit("[/TURN]"))


def parse_turn(rendered: Column) -> Column:
    """(role, text, legal) of one rendered turn; legal is false if its text holds a bare control string."""
    role = F.regexp_extract(rendered, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
    inside = lambda o, c: F.substring(rendered, F.lit(len(o) + 1), F.length(rendered) - (len(o) + len(c)))
    body, name = F, F
    for key in OPEN:
        starts = F.startswith(rendered, F.lit(OPEN[key]))
        body, name = body.when(starts, inside(OPEN[key], CLOSE[key])), name.when(starts, F.lit(key))
    at = F.length(role) + len("[ROLE][/ROLE]")
    body = body.otherwise(F.substring(rendered, at + 1, F.length(rendered) - at - len("[/TURN]")))
    name = name.otherwise(unescape(role))
    return F.struct(name.alias("role"), unescape(body).alias("text"), (~body.rlike(BARE)).alias("legal"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text, legal)."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parse_turn)


def strict(formatted: Column) -> Column:
    """Whether the turns found cover the whole text."""
    return F.aggregate(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x)) == F.length(formatted)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: conv_id, n_turns, formatted, loss_spans (start, length in code points of each assistant text as rendered), round_trip.

    round_trip says that strict parsing of formatted gives back every turn of the source; where it would not, the job stops.
    """
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    r, t = F.col("role"), F.col("text")
    turns = turns.withColumn("_plain", F.concat(opening(r), t, closing(r)))
    back = parse(F.col("_plain"))
    same = (F.size(back) == 1) & F.coalesce((back[0]["role"] == r) & (back[0]["text"] == t) & back[0]["legal"], F.lit(False))
    turns = turns.withColumn("_same", same).withColumn("body", F.when(F.col("_same"), t).otherwise(escape(t)))
    turns = turns.select("conv_id", "turn", "role", "text", F.when(F.col("_same"), F.col("_plain")).otherwise(F.concat(opening(r), F.col("body"), closing(r))).alias("rendered"), F.length(opening(r)).alias("_skip"), F.length("body").alias("_len"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_start", F.coalesce(F.sum(F.length("rendered").cast("long")).over(order), F.lit(0)))
    item = F.struct("_start", "rendered", "role", "text", "_skip", "_len")
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("_turns"))
    packed = packed.withColumn("formatted", F.array_join(F.transform("_turns", lambda x: x["rendered"]), ""))
    spans = F.transform(F.filter("_turns", lambda x: x["role"] == "assistant"), lambda x: F.struct((x["_start"] + x["_skip"]).alias("start"), x["_len"].cast("long").alias("length")))
    source = F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.lit(True).alias("legal")))
    same = strict(F.col("formatted")) & (parse(F.col("formatted")) == source)
    told = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("a conversation does not parse back to its turns")).cast("boolean"))
    return packed.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), "formatted", spans.alias("loss_spans"), told.alias("round_trip"))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: counts and digests of the turns and of the text under the loss mask."""
    back = formatted.withColumn("_turns", parse(F.col("formatted")))
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    back = back.withColumn("_loss", F.array_join(under, ""))
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def oracle(extra: str) -> str:
    """The digests of all conversations in DuckDB SQL; extra: further rows, as a SELECT of conv_id, turn, role, text."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    esc = lambda c: f"regexp_replace({c}, {q(TO_ESCAPE)}, {q(chr(92) + '1' + chr(92) * 2 + chr(92) + '2' + chr(92) + '3')}, 'g')"
    case = lambda marks, other: "CASE role " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in marks.items()) + f" ELSE {other} END"
    opened, closed = case(OPEN, f"'[ROLE]' || {esc('role')} || '[/ROLE]'"), case(CLOSE, "'[/TURN]'")
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra})),
    r AS (SELECT *, {opened} || {esc('text')} || {closed} AS rendered FROM t),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(length(rendered)) AS formatted_chars FROM r GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, true AS round_trip FROM c
    """
