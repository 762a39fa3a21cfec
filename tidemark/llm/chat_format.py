"""Chat formatting with a grammar that reads the turns back from the rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A turn is "### Name: ", the text and a closing mark on a line of its own. Inside a
# text either control string is preceded by a backslash.
OPEN, CLOSE = "### ", "</turn>"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
LOSS_ROLE = "assistant"

_CONTROL = r"(\\*(?:###|</turn>))"
_ESCAPED = r"\\(\\*(?:###|</turn>))"
_TURN_END = r"\n</turn>\n"


def escape(text: Column) -> Column:
    """One more backslash before each control string and the backslashes before it."""
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _name(role: Column) -> Column:
    """The shown name of a role; any other than the known ones is URL-encoded after "="."""
    shown = F.concat(F.lit("="), F.url_encode(role))
    for known, name in NAMES.items():
        shown = F.when(role == known, name).otherwise(shown)
    return F.coalesce(shown, F.lit("~"))


def _role(name: Column) -> Column:
    role = F.when(name.startswith("="), F.url_decode(F.substring(name, 2, 1 << 30)))
    for known, shown in NAMES.items():
        role = F.when(name == shown, known).otherwise(role)
    return role


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _name(role), F.lit(": "), text, F.lit(f"\n{CLOSE}\n"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered text: array of (role, text, written), in order.

    ``written`` is the text as it stands in the rendered form. A text cannot end a
    turn itself: the parser cuts at closing marks on a line of their own, and inside
    a text one would follow a backslash.
    """
    parts = F.filter(F.split(formatted, _TURN_END), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _role(F.regexp_extract(p, r"^### ([^:]*): ", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"^### [^:]*: ", "")).alias("text"),
            F.regexp_replace(p, r"^### [^:]*: ", "").alias("written"),
        ),
    )


def _reads_back(formatted: Column, role: Column, text: Column) -> Column:
    turns = parse(formatted)
    return (F.size(turns) == 1) & turns[0]["role"].eqNullSafe(role) & (turns[0]["text"] == text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """Render each turn: (conv_id, turn, role, text, rendered, escaped).

    The text is rendered as it is; if the parser does not recover the same turn, its
    control strings are escaped, and a turn that even then does not read back raises
    an error. No turn looks at another, so nothing is shuffled here.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select("conv_id", "turn", "role", text.alias("text"))
    turns = turns.withColumn("plain", render(F.col("role"), F.col("text")))
    turns = turns.withColumn("escaped", ~_reads_back(F.col("plain"), F.col("role"), F.col("text")))
    turns = turns.withColumn(
        "rendered",
        F.when(~F.col("escaped"), F.col("plain")).otherwise(render(F.col("role"), escape(F.col("text")))),
    )
    safe = F.when(
        ~F.col("escaped") | _reads_back(F.col("rendered"), F.col("role"), F.col("text")), F.col("rendered")
    ).otherwise(F.raise_error(F.lit("a turn does not read back")).cast("string"))
    return turns.select("conv_id", "turn", "role", "text", safe.alias("rendered"), "escaped")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, formatted, turns).

    Turns are in order of ``turn`` (equal ones by rendered text, null first);
    ``turns`` are read back from ``formatted``, each with whether the loss counts it.
    Null texts are empty; null and unknown roles come back as they were; rows
    without conv_id form one conversation; repeated rows are turns of their own;
    other columns are ignored; an empty table gives no rows.
    """
    joined = (
        format_turns(conversations)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "rendered"))).alias("all"))
        .select("conv_id", F.array_join(F.col("all.rendered"), "").alias("formatted"))
    )
    return joined.select(
        "conv_id",
        "formatted",
        F.transform(
            parse(F.col("formatted")),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"].eqNullSafe(F.lit(LOSS_ROLE))).alias("loss")),
        ).alias("turns"),
    )
