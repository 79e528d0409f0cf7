"""Chat formatting in budgeted windows, with DataFrame functions only.

Tokens of a turn are counted as its words and marks plus the template's FRAME; this is the unit of all
budgets here, not the ids of a tokenizer. Prefix sums over a conversation, taken within chunks of CHUNK turn
numbers and over the chunks' totals, place every turn on a line. A window holds the conversation's system
turn, at most `history` tokens of the last turns of the window before it, and its own turns. For those the
budget leaves a room, and the line is cut every half of it: a turn of at most half a room goes with the
others that end in its stretch, whose sum is less than a room; a longer one has a window of its own. So no
window of several own turns exceeds the budget, no turn is split, and a window is chosen by sums alone,
without a walk along the conversation. Only own assistant turns are targets: repeated ones are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and those of them that the history may take at most.
BUDGET, HISTORY = 2048, 256
#: Turn numbers that are summed in one task at most, before the chunks' totals are.
CHUNK = 64
#: Tokens that the template adds to a turn.
FRAME = 4


def escape(text: Column) -> Column:
    """A text without control strings: every "<|" is followed by one more "|"."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    """As escape, and a line feed, which would end the role, becomes "<|n|>"."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """Words and marks of a text, and FRAME."""
    return (F.size(F.split(text, r"(?U)\s+|(?<=\w)(?=[^\w\s])")) + FRAME).cast("long")


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its place `at`, the end of its tokens on its conversation's line, its window, the next
    turn's window, and the tokens of the conversation's system turn; c and n are conv_id in a form that joins nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"),
        F.col("conv_id").isNull().alias("n"),
        F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**60))) / CHUNK).alias("chunk"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        tokens(text).alias("tokens"),
    )
    key = ["c", "n", "chunk"]
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    in_chunk = Window.partitionBy(*key).orderBy(*order)
    base = base.withColumns({
        "at": F.row_number().over(in_chunk).cast("long"), "end": F.sum("tokens").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.lead("tokens").over(in_chunk),
    })
    first = F.col("at") == 1
    totals = base.groupBy(*key).agg(
        F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("sum"), F.max(F.when(first, F.col("tokens"))).alias("first_tokens"),
        F.max(F.when(first & (F.col("role") == "system"), F.col("tokens"))).alias("system"),
    )
    along = Window.partitionBy("c", "n").orderBy("chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *key,
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"),
        F.coalesce(F.first("system").over(along), F.lit(0)).alias("system"),
        F.lead("first_tokens").over(along).alias("next_tokens"),
    )
    rows = base.join(offsets, key).withColumns({"at": F.col("at") + F.col("turns_before"), "end": F.col("end") + F.col("sum_before")})
    # Where a long system turn leaves less than the history, the history gives way.
    room = F.when(budget - F.col("system") >= 2 * history, budget - F.col("system") - history).otherwise(budget - F.col("system"))
    half = F.greatest(F.lit(1), room) / 2
    window = lambda end, size: 2 * F.floor(end / half) + F.when(size > half, 0).otherwise(1)
    return rows.withColumn("after", F.coalesce("after", "next_tokens")).select(
        "c", "n", "role", "text", "tokens", "at", "system",
        (F.col("system") > 0).alias("headed"),
        window(F.col("end"), F.col("tokens")).alias("window"),
        window(F.col("end") + F.col("after"), F.col("after")).alias("next_window"),
    )


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_repeated, n_turns, n_tokens, formatted, targets) of every conversation.

    targets: (start, length) in code points of each own assistant text within formatted; n_repeated turns
    at the start (system turn, history) are not the window's own. n_tokens exceeds budget only in a window
    of one own turn, which then repeats no history. A system turn is the first turn, if its role is
    "system". Turns are ordered by turn, role, text, nulls first; a null role or text is empty; a null
    conv_id is a conversation; repeated rows are turns of their own. An empty table has no windows. Other
    columns are not read.
    """
    rows = _placed(turns, budget, history)
    turn = F.struct("at", "role", "text", "tokens")
    own = rows.groupBy("c", "n", "window").agg(
        F.array_sort(F.collect_list(turn)).alias("own"),  # a room's tokens, or one turn
        F.max(F.when(F.col("next_window") != F.col("window"), F.col("next_window"))).alias("next_window"),
        F.max("system").alias("system"),
        F.sum("tokens").alias("own_tokens"),
    )
    # The last turns of a window that the next one repeats: as many as the history has room for.
    tail = F.aggregate(
        F.reverse("own"),
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<at:bigint,role:string,text:string,tokens:bigint>>").alias("kept")),
        lambda acc, t: F.struct(
            (acc["sum"] + t["tokens"]).alias("sum"),
            F.when((acc["sum"] + t["tokens"] <= history) & ~((t["at"] == 1) & (F.col("system") > 0)), F.concat(F.array(t), acc["kept"]))
            .otherwise(acc["kept"]).alias("kept"),
        ),
        lambda acc: acc["kept"],
    )
    last = own.where("next_window is not null").select("c", "n", F.col("next_window").alias("window"), tail.alias("past")).where("size(past) > 0")
    head = rows.where("at = 1 and headed").select("c", "n", F.col("window").alias("home"), F.array(turn).alias("head"))
    heads = own.select("c", "n", "window").join(head, ["c", "n"]).where("window != home").drop("home")
    none = F.array().cast("array<struct<at:bigint,role:string,text:string,tokens:bigint>>")
    per = own.join(last, ["c", "n", "window"], "left").join(heads, ["c", "n", "window"], "left")
    per = per.withColumns({"past": F.coalesce("past", none), "head": F.coalesce("head", none)})
    total = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"])
    fits = F.col("own_tokens") + total(F.col("past")) + total(F.col("head")) <= budget
    per = per.withColumn("past", F.when(fits, F.col("past")).otherwise(none))

    start = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    piece = lambda t, mine: F.struct(
        F.concat(start(t), escape(t["text"]), F.lit(f"{END}\n")).alias("s"), F.length(start(t)).alias("skip"),
        F.length(escape(t["text"])).alias("n"), (mine & (t["role"] == "assistant")).alias("target"),
    )
    repeated = F.concat("head", "past")
    pieces = F.concat(F.transform(repeated, lambda t: piece(t, F.lit(False))), F.transform("own", lambda t: piece(t, F.lit(True))))
    per = per.select(
        F.when(~F.col("n"), F.col("c")).alias("conv_id"), "window", F.size(repeated).alias("n_repeated"),
        (F.col("own_tokens") + total(repeated)).alias("n_tokens"), F.inline(F.array(F.struct(pieces.alias("pieces")))),
    )
    targets = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["target"], F.concat(acc["out"], F.array(F.struct((acc["at"] + p["skip"]).alias("start"), p["n"].alias("length")))))
            .otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return per.select(
        "conv_id",
        "window",
        "n_repeated",
        F.size("pieces").alias("n_turns"),
        "n_tokens",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        targets.alias("targets"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, losses, formatted_chars) parsed from windows' formatted texts alone:
    turns is role, line feed, text, line feed of every turn once; losses all text under the masks."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda s, i: i > F.col("n_repeated"))

    def turn(s):
        role = F.substring_index(s, "\n", 1)
        text = s.substr(F.length(role) + 2, F.greatest(F.lit(0), F.length(s) - F.length(role) - len(END) - 2))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    losses = F.transform("targets", lambda t: unescape(F.substring(F.col("formatted"), t["start"] + 1, t["length"])))
    per = formatted.select(
        "conv_id",
        F.struct(
            "window", F.array_join(F.transform(parts, turn), "").alias("turns"), F.array_join(losses, "").alias("losses"),
        ).alias("w"),
        F.size(parts).cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = per.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws")
    )
    return whole.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("ws", lambda w: w["turns"]), "").alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["losses"]), "").alias("losses"),
        "formatted_chars",
    )
