"""Conversations as windows of training text within a token budget, in DataFrame functions only.

A window holds whole turns. Prefix sums of the turns' tokens choose its span: it
takes new turns while they fit. Before them it repeats the system turn and a little
of what came before. The loss mask covers the texts of new assistant turns, so each
assistant text is a target once, wherever it is repeated.

Template: `<s>`, then turns, each `[INST]role LF text[/INST]`, or
`[OUT]role LF text</s>` for the assistant. Roles are URL-encoded. In a text a control
string gets a backslash after its first character, one more than it may have there
already; reading takes one away. So no text holds a control string, and any text comes back.

Turns are dealt by conversation and BLOCK_TURNS turn numbers, so a task holds a part
of a long conversation, not all of it. A part's last turns go to the next part
too, as history, and the system turn to all parts; a window doesn't cross parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, BLOCK_TURNS = 2048, 4, 512, 1024
#: Tokens of a turn's role and marks.
TURN_TOKENS = 4
ASSISTANT, SYSTEM = "assistant", "system"
# The control strings of the template.
BEGIN, OPEN, CLOSE, OPEN_OUT, CLOSE_OUT = "<s>", "[INST]", "[/INST]", "[OUT]", "</s>"
_CONTROL = r"<(?=\\*+/?s>)|\[(?=\\*+(?:/?INST|OUT)\])"
_ESCAPED = r"(?:(?<=<)\\(?=\\*+/?s>))|(?:(?<=\[)\\(?=\\*+(?:/?INST|OUT)\]))"
_CLOSES = r"\[/INST\]|</s>"
#: A token of the estimate: a run of letters or marks, a digit, or another visible character.
_TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "")


def tokens(text: Column) -> Column:
    """An estimate that needs no vocabulary: words, digits and signs."""
    return F.regexp_count(text, F.lit(_TOKEN)).cast("long") + TURN_TOKENS


def _parts(rows: DataFrame) -> DataFrame:
    """Rows with `part`; old: a copy for another part, as history or system turn; more: the conversation has further parts."""
    part = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(0)).cast("long")
    rows = rows.withColumn("part", part)
    nearly = F.coalesce(F.pmod("turn", F.lit(BLOCK_TURNS)) >= BLOCK_TURNS - HISTORY_TURNS, F.lit(False))
    places = F.when(nearly, F.array(F.col("part"), F.col("part") + 1)).otherwise(F.array(F.col("part")))
    new = rows.select("conv_id", "turn", "role", "text", F.col("part").alias("own"), F.explode(places).alias("part"))
    new = new.select("conv_id", "part", (F.col("own") != F.col("part")).alias("old"), F.lit(False).alias("more"), "turn", "role", "text")
    # Filters reach the scan: without long conversations these read next to nothing.
    long = rows.where((F.col("turn") >= BLOCK_TURNS) | (F.col("turn") < 0)).select("conv_id", "part").distinct()
    opening = rows.where((F.col("role") == SYSTEM) & (F.col("part") == 0))
    opening = opening.join(long.select(F.col("conv_id").alias("c")).distinct(), opening["conv_id"].eqNullSafe(F.col("c")), "left_semi")
    opening = opening.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("s"))
    joined = long.alias("l").join(opening.alias("o"), F.col("l.conv_id").eqNullSafe(F.col("o.conv_id")))
    repeated = joined.select("l.conv_id", "l.part", F.lit(True).alias("old"), F.lit(False).alias("more"), "o.s.*")
    marks = long.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(True).alias("old"), F.lit(True).alias("more"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    marks = marks.unionByName(long.select("conv_id", "part", F.lit(True).alias("old"), F.lit(True).alias("more"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")))
    return new.unionByName(repeated).unionByName(marks)


def _starts(sums: Column, first_room: Column, room: Column) -> Column:
    """First turns of the windows, from the prefix sums (sums[i]: tokens before turn i): each takes turns while they fit, one at least."""
    count = F.size(sums) - 1

    def step(state: Column, i: Column) -> Column:
        last = F.element_at(state, -1)
        limit = F.when(F.size(state) == 1, first_room).otherwise(room)
        full = F.get(sums, i + 1) - F.get(sums, last) > limit
        return F.when(full & (i > last), F.array_append(state, i)).otherwise(state)

    return F.when(count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), F.array(F.lit(0)), step))


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, part, window, text, loss, repeated, turns, tokens, more): the windows of all conversations in order of part and window.

    `loss` has the masked spans (start, end in code points of `text`); the first
    `repeated` of its `turns` turns are copies. Within `budget` tokens, by `tokens`,
    unless one turn alone passes it with the system turn: turns are never cut. History is
    up to `history_turns` turns (HISTORY_TURNS at most over a part's edge) of up to `history_tokens`.

    Rows (conv_id, turn, role, text) are ordered by turn, nulls first, then role and text; repeated
    rows are turns of their own. A null text or role counts as empty, and rows
    without conv_id are one conversation. Other columns are not read. The system
    turn is the first one of role system in part 0. An empty table gives an empty one.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Tokens are counted before rows are grouped: what a later filter or lambda uses is an array of numbers, not a pattern to match again.
    dealt = _parts(rows).withColumn("n", tokens(F.col("text")))
    turn = F.struct("turn", "role", "text", "n", "old")
    parts = dealt.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.when(~F.col("more"), turn))).alias("all"), F.max("more").alias("more"), F.count_if(~F.col("old")).alias("new"))
    parts = parts.where(F.col("new") > 0)
    # Copies come first. The system turn is a copy, or in part 0 one of the new turns.
    first = F.filter("all", lambda t: (t["role"] == SYSTEM) & (t["old"] | (F.col("part") == 0)))
    parts = parts.select("conv_id", "part", "more", F.slice(first, 1, 1).alias("head"),
        F.concat(F.filter("all", lambda t: t["old"] & (t["role"] != SYSTEM)), F.filter("all", lambda t: ~t["old"])).alias("turns"))
    place = F.when(F.exists("head", lambda t: ~t["old"]), F.array_position(F.transform("turns", lambda t: t["role"]), SYSTEM).cast("int") - 1)
    parts = parts.select("conv_id", "part", "more", "head", "turns",
        F.coalesce(place, F.lit(-1)).alias("place"), F.size(F.filter("turns", lambda t: t["old"])).alias("skip"),
        F.coalesce(F.get("head", F.lit(0))["n"], F.lit(0).cast("long")).alias("head_n"),
        F.aggregate("turns", F.array(F.lit(0).cast("long")), lambda s, t: F.array_append(s, F.element_at(s, -1) + t["n"])).alias("sums"))
    room = F.lit(budget) - F.col("head_n") - history_tokens
    first_room = F.when(F.col("skip") > 0, room).when(F.col("place") == 0, F.lit(budget)).otherwise(F.lit(budget) - F.col("head_n"))
    parts = parts.select("*", room.alias("room"), first_room.alias("first_room"), F.slice("sums", F.col("skip") + 1, F.size("sums") - F.col("skip")).alias("new_sums"))
    starts = _starts(F.col("new_sums"), F.col("first_room"), F.col("room"))
    parts = parts.select("*", F.transform(starts, lambda i: i + F.col("skip")).alias("starts"))

    def window(start: Column, w: Column) -> Column:
        end = F.coalesce(F.get("starts", w + 1), F.size("turns"))
        before = F.get("sums", start)
        # A turn that passes the budget by itself gets no history.
        allowed = F.least(F.lit(history_tokens), F.lit(budget) - F.col("head_n") - (F.get("sums", end) - before))
        tried = F.sequence(F.greatest(F.lit(0), start - history_turns), start)
        begin = F.element_at(F.filter(tried, lambda i: before - F.get("sums", i) <= F.greatest(allowed, F.lit(0))), 1)
        return F.struct(w.cast("long").alias("window"), begin.alias("begin"), start.alias("start"), F.slice("turns", begin + 1, end - begin).alias("turns"))

    # Each window takes its own turns along; the outer form keeps Catalyst from testing the whole array once more in a filter.
    parts = parts.select("conv_id", "part", "more", "head", "place", F.explode_outer(F.transform("starts", window)).alias("w")).select("conv_id", "part", "more", "head", "place", "w.*")
    # The system turn is repeated unless the window has it: as a new turn, or as history.
    repeats_head = (F.size("head") > 0) & ((F.col("place") < 0) | (F.col("place") < F.col("begin")))
    parts = parts.select("conv_id", "part", "window", "more",
        F.when(repeats_head, F.concat("head", "turns")).otherwise(F.col("turns")).alias("turns"),
        (F.col("start") - F.col("begin") + repeats_head.cast("int")).alias("repeated"))

    def piece(t: Column) -> Column:
        said = t["role"] == ASSISTANT
        before = F.concat(F.when(said, OPEN_OUT).otherwise(OPEN), F.url_encode(t["role"]), F.lit("\n"))
        return F.struct(before.alias("before"), escaped(t["text"]).alias("text"), F.when(said, CLOSE_OUT).otherwise(CLOSE).alias("after"), said.alias("said"))

    parts = parts.withColumn("pieces", F.transform("turns", piece))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), ""))
    zero = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def masked(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["before"])
        end = start + F.length(p["text"])
        mask = p["said"] & (state["i"] >= F.col("repeated"))
        spans = F.when(mask, F.array_append(state["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(state["spans"])
        return F.struct((end + F.length(p["after"])).alias("at"), (state["i"] + 1).alias("i"), spans.alias("spans"))

    return parts.select("conv_id", "part", "window", text.alias("text"),
        F.aggregate("pieces", zero, masked, lambda s: s["spans"]).alias("loss"),
        F.col("repeated").cast("long").alias("repeated"), F.size("turns").cast("long").alias("turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["n"]).alias("tokens"), "more")


def read_back(text: Column) -> Column:
    """The turns of a window's text, as an array of role and text."""
    pieces = F.split(F.substring(text, len(BEGIN) + 1, F.length(text)), _CLOSES, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        role = F.url_decode(F.substring(head, F.locate("]", head) + 1, F.length(head)))
        return F.struct(role.alias("role"), unescaped(F.substring(p, F.length(head) + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation the contract's columns, read from the windows.

    A conversation in one part gives its digests where it is; only parts of longer ones
    move once more, as a digest over a whole conversation needs its whole text in one row.
    """
    found = windows(conversations)
    new = F.slice(read_back(F.col("text")), F.col("repeated") + 1, F.col("turns") - F.col("repeated"))
    said = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    read = found.select("conv_id", "part", "window", "more", F.length("text").cast("long").alias("chars"), new.alias("t"), F.array_join(said, "").alias("loss"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    piece = F.struct("window", whole.alias("turns"), "loss")
    parts = read.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(piece)).alias("w"), F.sum(F.size("t")).cast("long").alias("n_turns"), F.sum("chars").alias("chars"), F.max("more").alias("more"))
    parts = parts.select("conv_id", "part", "n_turns", "chars", "more", F.array_join(F.col("w.turns"), "").alias("turns"), F.array_join(F.col("w.loss"), "").alias("loss"))
    single = ~F.col("more")
    row = F.struct("part", F.when(F.col("more"), F.col("turns")).alias("turns"), F.when(F.col("more"), F.col("loss")).alias("loss"))
    parts = parts.select("conv_id", "n_turns", "chars", row.alias("row"),
        F.when(single, F.sha2("turns", 256)).alias("turns_sha256"), F.when(single, F.length("loss").cast("long")).alias("loss_chars"), F.when(single, F.sha2("loss", 256)).alias("loss_sha256"))
    whole = parts.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("row")).alias("rows"), *(F.max(c).alias(c) for c in ("turns_sha256", "loss_chars", "loss_sha256")))
    turns, loss = F.array_join(F.col("rows.turns"), ""), F.array_join(F.col("rows.loss"), "")
    return whole.select("conv_id", "n_turns",
        F.coalesce("turns_sha256", F.sha2(turns, 256)).alias("turns_sha256"),
        F.coalesce("loss_chars", F.length(loss).cast("long")).alias("loss_chars"),
        F.coalesce("loss_sha256", F.sha2(loss, 256)).alias("loss_sha256"), "formatted_chars")


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7 of the contract, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = rows.sparkSession.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"))
    return rows.unionByName(extra)
