"""Event-sourced chat formatting: fold a log of events into final messages, then render them.

An event names its conversation, a ``slot`` (the place of a message), a ``seq`` that orders the log, and a kind:

- ``open``: the message begins, with its role; what an earlier opening held is gone
- ``delta``: text to append
- ``edit``: the text so far is replaced
- ``regenerate``: the text so far is dropped, and so are later slots opened before this event

Template of a turn: ``<s>[INST]role[/INST]text</s>``. Inside roles and texts a backslash is doubled and each
control string gets a backslash after its first character, so no control string is left in them and
``unescape`` gives back every text.

Defined results: null roles and texts are empty; null ids form one conversation; rows that are equal in every
column stay separate turns next to each other; unknown kinds and slots without ``open`` add nothing to a text
but their slot keeps an empty role; an empty log gives no conversations. A rendered conversation is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"
DELTA_CHARS = 200


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, slot, role, text`` of the messages that stand at the end of the log."""
    here = Window.partitionBy("conv_id", "slot")
    kind, seq = F.col("kind"), F.col("seq")
    newest = lambda *kinds: F.max(F.when(kind.isin(*kinds), seq))
    kept = events.select("conv_id", "slot", "seq", "kind", "role", "text").withColumn(
        "_reset", newest("open", "edit", "regenerate").over(here)
    )
    counts = F.col("_reset").isNull() | (seq >= F.col("_reset"))
    adds = counts & kind.isin("edit", "delta")
    messages = kept.groupBy("conv_id", "slot").agg(
        F.max_by(F.when(kind == "open", F.coalesce("role", F.lit(""))), F.when(kind == "open", seq)).alias("role"),
        newest("open").alias("_opened"),
        newest("regenerate").alias("_again"),
        F.sort_array(F.collect_list(F.when(adds, F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))).alias("_parts"),
    )
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    standing = messages.withColumn("_cut", F.max("_again").over(before)).where(
        F.col("_cut").isNull() | F.col("_opened").isNull() | (F.col("_opened") > F.col("_cut"))
    )
    return standing.select(
        "conv_id", "slot", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, mask``: the mask lists start and length (code points) of each learned text."""
    opening = F.concat(F.lit("<s>[INST]"), escape(F.col("role")), F.lit("[/INST]"))
    order = Window.partitionBy("conv_id").orderBy("slot")
    turns = messages.select(
        "conv_id", "slot", "role", opening.alias("_opening"), escape(F.col("text")).alias("_body")
    ).withColumn("_turn", F.concat("_opening", "_body", F.lit("</s>")))
    upto = F.sum(F.length("_turn").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = turns.withColumn("_start", upto - F.length("_turn") + F.length("_opening") + 1)
    learned = F.when(
        F.col("role") == LEARNED_ROLE, F.struct(F.col("_start").alias("start"), F.length("_body").cast("bigint").alias("length"))
    )
    joined = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", F.col("_turn").alias("turn")))).alias("_turns"),
        F.sort_array(F.collect_list(learned)).alias("mask"),
    )
    return joined.select("conv_id", F.array_join(F.transform("_turns", lambda t: t["turn"]), "").alias("formatted"), "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learned texts, from the rendered text and its mask alone."""
    split = formatted.withColumns({
        "_split": F.split("formatted", "</s>"), "_wide": F.encode("formatted", "UTF-32")
    })
    split = split.withColumns({
        "_split": F.slice("_split", F.lit(1), F.size("_split") - 1),
        "formatted_chars": F.length("formatted").cast("bigint"),
        "_wide_bytes": F.octet_length("_wide"),
    })
    body = lambda t: F.substring(t, F.lit(len("<s>[INST]") + 1), F.length(t))
    role = lambda t: F.substring_index(body(t), "[/INST]", 1)
    text = lambda t: F.substring(body(t), F.length(role(t)) + F.lit(len("[/INST]") + 1), F.length(t))
    turn = lambda t: F.struct(unescape(role(t)).alias("role"), unescape(text(t)).alias("text"))
    # Fixed-width code points: each masked stretch is one slice of bytes.
    learned = lambda m: unescape(F.decode(
        F.substring(F.col("_wide"), (4 * m["start"] - 3).cast("int"), (4 * m["length"]).cast("int")), "UTF-32"
    ))
    return split.select(
        "conv_id", "formatted_chars", "_wide_bytes", F.transform("_split", turn).alias("turns"),
        F.array_join(F.transform("mask", learned), "").alias("learned"),
    ).drop("_wide_bytes")


def as_events(rows: DataFrame) -> DataFrame:
    """A log for (conv_id, turn, role, text) rows: users correct a draft, assistants are asked again."""
    text = F.coalesce("text", F.lit(""))
    counted = rows.select("conv_id", "turn", "role", text.alias("text")).groupBy("conv_id", "turn", "role", "text").count()
    each = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count")))).withColumns({
        "slot": F.struct("turn", "role", F.md5("text").alias("digest"), F.col("_copy").alias("copy")),
        "_pieces": F.transform(
            F.sequence(F.lit(0), F.floor(F.length("text") / DELTA_CHARS).cast("int")),
            lambda i: F.substring(F.col("text"), i * DELTA_CHARS + 1, F.lit(DELTA_CHARS)),
        ),
    })
    event = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("text"))
    deltas = lambda pieces: F.transform(pieces, lambda p: event("delta", p))
    draft = event("delta", F.concat(F.lit("draft "), F.get("_pieces", F.lit(0))))
    opened = event("open", F.lit(None).cast("string"))
    first, rest = F.get("_pieces", F.lit(0)), F.slice("_pieces", F.lit(2), F.size("_pieces"))
    log = (
        F.when(F.col("role") == "assistant", F.concat(
            F.array(opened, draft, event("regenerate", F.lit(None).cast("string"))), deltas(F.col("_pieces"))
        ))
        .when(F.col("role") == "user", F.concat(F.array(opened, draft, event("edit", first)), deltas(rest)))
        .otherwise(F.concat(F.array(opened), deltas(F.col("_pieces"))))
    )
    return each.select("conv_id", "slot", "role", F.posexplode(log).alias("_k", "_event")).select(
        "conv_id", "slot", F.struct("slot", F.col("_k").alias("k")).alias("seq"), F.col("_event")["kind"].alias("kind"),
        "role", F.col("_event")["text"].alias("text"),
    )
