"""Chat formatting with a grammar that reads back exactly what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import whole

# The control strings of the template.
OPEN, CLOSE = "<s>", "</s>"
USER, ASSISTANT, SYSTEM = "[INST] ", "[/INST] ", "<<SYS>> "
ROLE_OPEN, ROLE_CLOSE = "[ROLE] ", "[/ROLE] "
#: A control string in a text, with the backslashes that an earlier escape may have put after its first sign.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|/?ROLE\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|<SYS>>|/?ROLE\])"
_OTHER_ROLE = r"(?s)^\[ROLE\] (.*?)\[/ROLE\] "


def escape(text: Column) -> Column:
    """One backslash into every control string, also into those that already have some."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _header(role: Column) -> Column:
    return (F.when(role == "user", USER).when(role == "assistant", ASSISTANT).when(role == "system", SYSTEM)
            .otherwise(F.concat(F.lit(ROLE_OPEN), role, F.lit(ROLE_CLOSE))))


def render_turn(role: Column, text: Column) -> Column:
    """A turn as the three pieces before, in and after its text; ``in_loss`` marks what an assistant says."""
    piece = lambda part, loss: F.struct(part.alias("piece"), loss.alias("in_loss"))
    return F.array(piece(F.concat(F.lit(OPEN), _header(role)), F.lit(False)),
                   piece(text, role == "assistant"), piece(F.lit(CLOSE), F.lit(False)))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation.

    Turns end at ``</s>``, which no turn holds inside; the header after ``<s>`` names the role.
    """
    turns = F.filter(F.split(formatted, CLOSE), lambda t: t != "")

    def read(turn: Column) -> Column:
        body = F.substr(turn, F.lit(len(OPEN) + 1))
        after = lambda header: F.substr(body, F.lit(len(header) + 1))
        named = lambda role, header: F.struct(F.lit(role).alias("role"), unescape(after(header)).alias("text"))
        role = F.regexp_extract(body, _OTHER_ROLE, 1)
        other = F.struct(unescape(role).alias("role"), unescape(F.substr(
            body, F.length(role) + F.lit(len(ROLE_OPEN) + len(ROLE_CLOSE) + 1))).alias("text"))
        return (F.when(F.startswith(body, F.lit(USER)), named("user", USER))
                .when(F.startswith(body, F.lit(ASSISTANT)), named("assistant", ASSISTANT))
                .when(F.startswith(body, F.lit(SYSTEM)), named("system", SYSTEM)).otherwise(other))

    return F.transform(turns, read)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with its rendered pieces and ``escaped``: how often the turn had to be escaped, 0 or 1.

    Every turn is rendered as it is and read back; a turn that does not come back as one turn with its
    own role and text is escaped. After an escape no control string is left in it and the reader takes the
    backslash away again, so a second round cannot differ.
    """
    role, text = whole(F.col("role")), whole(F.col("text"))
    pieces = render_turn(role, text)
    back = parse(F.array_join(F.transform(pieces, lambda p: p["piece"]), ""))
    same = ((F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)
            & ~F.regexp_like(F.concat_ws(" ", role, text), F.lit(_CONTROL)))
    return turns.withColumn("escaped", F.when(same, 0).otherwise(1)).withColumn(
        "pieces", F.when(F.col("escaped") == 0, pieces).otherwise(render_turn(escape(role), escape(text))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row (conv_id, pieces, n_escaped) per conversation of ``turns`` (conv_id, turn, role, text).

    The formatted text is the pieces joined; the loss mask is true on pieces of assistants' texts. Turns are
    ordered by turn, then role and text for repeated numbers; a NULL turn comes first. A NULL
    role or text is empty; an empty text is an empty turn; a NULL conv_id is a conversation of its
    own; repeated rows are repeated turns; no rows give no conversations; further columns are not used. A
    conversation is one training example and so one row: its turns meet in one task, however many they are.
    """
    own = format_turns(turns.select("conv_id", "turn", "role", "text"))
    entry = F.struct("turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"), "pieces")
    grouped = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("turns"), F.sum("escaped").alias("n_escaped"))
    return grouped.select("conv_id", F.flatten(F.col("turns.pieces")).alias("pieces"), "n_escaped")


def formatted_text(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")


def loss_text(pieces: Column) -> Column:
    """What the loss is taken on, as the source had it."""
    masked = F.filter(pieces, lambda p: p["in_loss"])
    return F.array_join(F.transform(masked, lambda p: unescape(p["piece"])), "")
