"""Problem 5: ordered conversations out of message rows.

Rows of a channel (a conversation_id) are put in the order (created_at, id) by ranges, so that a channel with a third of all rows is spread
over many tasks (``operators.ordered``). A silence longer than a gap calibrated on all pauses ends a session; roles are read from
their many spellings. Each session is then summed up in one row: whether all its rows are sound, whether its turns alternate, who
begins and who ends it, how many turns it has.

``rebuild`` keeps the sessions in which user and assistant reply to each other from a user to an assistant. ``found`` puts a conversation
together from its sessions' rows: it is kept if every session is sound, the turns go on alternating from one session to the next, the
first begins with the user and the last ends with the assistant.

Defined results for awkward input: exact repeats of a row count once; a null conversation_id or one unknown to
``conversations`` gives no turn; a null or unreadable role, a null time or invisible content of any
non-system row drops its session (in ``found`` its conversation); a message sent again is left out, also after a silence; equal times are ordered by id;
empty tables give an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.llm.bounds import broadcast_if_small
from tesselle.operators import ordered
from tesselle.session import cut

# Spellings of the speaker roles (lower case, outer blanks dropped), several languages.
ROLES = {
    "user": "user utilisateur utilisatrice usager human humain usuario humano benutzer nutzer mensch client customer visitor visiteur question me",
    "assistant": "assistant assistante asistente assistent bot ai ia ki agent chatbot model modèle modelo modell gpt answer",
    "system": "system système systeme sistema developer",
}
BLANK = r"[\s\p{Z}\p{C}]"
DEFAULT_GAP = 1800.0
BROADCAST_ROWS = 1_000_000


def read_role(role: Column) -> Column:
    """user, assistant, system, or null when unreadable."""
    key = F.lower(F.regexp_replace(role, rf"^{BLANK}+|{BLANK}+$", ""))
    out = F.lit(None).cast("string")
    for name, words in ROLES.items():
        out = F.when(key.isin(words.split()), F.lit(name)).otherwise(out)
    return out


def _order() -> list[Column]:
    return [F.col("created_at").asc_nulls_first(), F.col("id").asc()]


def _place() -> Column:
    return F.struct("created_at", "id")


def turns(messages: DataFrame, conversations: DataFrame, with_text: bool) -> DataFrame:
    """The non-system rows of known conversations with the row before each: pause in seconds, resent, same (speaker as before)."""
    known = conversations.select(F.col("id").alias("conversation_id")).where("conversation_id is not null").distinct()
    text = ["content"] if with_text else []
    m = (
        messages.select("id", "conversation_id", "role", "content", "created_at")
        .where("conversation_id is not null")
        .withColumn("speaker", read_role(F.col("role")))
        .where("speaker is null or speaker <> 'system'")
        .withColumn("said", F.regexp_replace("content", rf"^{BLANK}+|{BLANK}+$", ""))
        .withColumn("bad", F.expr("speaker is null or created_at is null or said is null or said = ''"))
        .withColumn("row", F.xxhash64("role", "content"))
        .select("id", "conversation_id", "created_at", "speaker", F.xxhash64("said").alias("said"), "bad", "row", *text)
        .dropDuplicates(["id", "conversation_id", "created_at", "row"])
        .drop("row")
        .join(broadcast_if_small(known, BROADCAST_ROWS), "conversation_id", "left_semi")
    )
    m = ordered.ranged(m, "conversation_id", _order())
    w = ordered.within("conversation_id", _order())
    had = ["created_at", "speaker", "said"]
    before = ordered.carried(m, "conversation_id", last=F.max_by(F.struct(*had), _place()))
    x = m.join(before, ["conversation_id", ordered.PART], "left").withColumn("b", F.coalesce(F.lag(F.struct(*had)).over(w), "last")).drop("last")
    return x.withColumns({
        "pause": _seconds("created_at") - _seconds("b.created_at"),
        "resent": F.col("b").isNotNull() & F.col("speaker").eqNullSafe(F.col("b.speaker")) & F.col("said").eqNullSafe(F.col("b.said")),
        "same": F.coalesce(F.col("speaker") == F.col("b.speaker"), F.lit(False)),
    }).drop("b", "said")


def _seconds(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def calibrate_gap(messages: DataFrame, default: float = DEFAULT_GAP) -> float:
    """Seconds of silence that separate two sessions: 20 times the 90th percentile of the usual pause, from
    all consecutive pairs; ``default`` for a table without any pair. One number reaches the driver."""
    m = ordered.ranged(messages.where("created_at is not null and conversation_id is not null").select("id", "conversation_id", "created_at"), "conversation_id", _order())
    before = ordered.carried(m, "conversation_id", last=F.max("created_at"))
    x = m.join(before, ["conversation_id", ordered.PART], "left").withColumn("b", F.coalesce(F.lag("created_at").over(ordered.within("conversation_id", _order())), "last"))
    return _gap(x.select((_seconds("created_at") - _seconds("b")).alias("pause")), default)


def _gap(pauses: DataFrame, default: float = DEFAULT_GAP) -> float:
    row = pauses.where("pause > 0").agg(F.percentile_approx("pause", 0.9, 1000)).first()
    return default if row[0] is None else max(60.0, 20 * row[0])


def sessions(turns: DataFrame, gap_seconds: float) -> DataFrame:
    """The turns with session_no and at (their place among the conversation's turns, from 1; a resent row has that of its turn)."""
    w = ordered.within("conversation_id", _order()).rowsBetween(Window.unboundedPreceding, 0)
    x = turns.withColumns({"brk": (F.coalesce("pause", F.lit(0.0)) > gap_seconds).cast("int"), "turn": (~F.col("resent")).cast("int")})
    base = ordered.carried_sum(x, "conversation_id", brk0=F.sum("brk"), turn0=F.sum("turn"))
    x = x.withColumns({"brk1": F.sum("brk").over(w), "turn1": F.sum("turn").over(w)}).join(base, ["conversation_id", ordered.PART], "left")
    return x.withColumns({"session_no": 1 + F.col("brk1") + F.coalesce("brk0", F.lit(0)), "at": F.col("turn1") + F.coalesce("turn0", F.lit(0))})


def summaries(x: DataFrame) -> DataFrame:
    """One row a session: sound, begins, ends, follows (its first turn is by another speaker than the turn before), first (place of its first turn), last."""
    first = (F.col("brk") == 1) | (F.col("at") == 1)
    turn = F.when(~F.col("resent"), _place())
    return x.groupBy("conversation_id", "session_no").agg(
        F.max(F.col("bad") | (F.col("same") & ~F.col("resent") & ~first)).alias("broken"),
        F.max(first & F.col("same") & ~F.col("resent")).alias("collides"),
        F.min_by("speaker", turn).alias("begins"),
        F.max_by("speaker", turn).alias("ends"),
        F.min(F.when(~F.col("resent"), F.col("at"))).alias("first"),
        F.max(F.when(~F.col("resent"), F.col("at"))).alias("last"),
    )


def rebuild(messages: DataFrame, conversations: DataFrame, gap_seconds: float | None = None) -> DataFrame:
    """(conversation_id, session_no, turn_no, message_id, role, created_at, content) of all kept sessions; ``gap_seconds`` None calibrates the gap."""
    t = cut(turns(messages, conversations, with_text=True))
    x = cut(sessions(t, _gap(t) if gap_seconds is None else gap_seconds))
    kept = summaries(x).where("not broken and begins = 'user' and ends = 'assistant'").select("conversation_id", "session_no", "first")
    out = x.where("not resent").join(broadcast_if_small(cut(kept), BROADCAST_ROWS), ["conversation_id", "session_no"])
    return out.select("conversation_id", F.col("session_no").cast("int").alias("session_no"), (F.col("at") - F.col("first") + 1).cast("int").alias("turn_no"), F.col("id").alias("message_id"), F.col("speaker").alias("role"), "created_at", "content")


def found(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    t = cut(turns(messages, conversations, with_text=False))
    x = cut(sessions(t, _gap(t)))
    whole = summaries(x).groupBy("conversation_id").agg(
        F.max(F.col("broken") | F.col("collides")).alias("broken"),
        F.min_by("begins", "first").alias("begins"),
        F.max_by("ends", "last").alias("ends"),
    )
    kept = whole.where("not broken and begins = 'user' and ends = 'assistant'").select("conversation_id")
    out = x.where("not resent").join(broadcast_if_small(cut(kept), BROADCAST_ROWS), "conversation_id", "left_semi")
    return out.select("conversation_id", F.col("at").cast("int").alias("turn_no"), F.col("id").alias("message_id"))
