"""Chat formatting in budgeted windows, by DataFrame functions alone.

Prefix sums of turn tokens choose the spans: with a budget of B tokens, a turn that lies within one block of B tokens
goes with the other such turns of that block, and a turn across the edge of a block is a window of its own. So a
window's own turns keep to the budget, but for a single turn that is longer. A leading system turn is retained in
every window, out of the same budget; where it leaves less than a quarter of it, a quarter is kept for other turns, and
windows are longer than the budget by what the system turn takes beyond that. From the window before, the last turns are repeated as far as the history's budget goes. The loss mask
covers the assistant texts of a window's own turns; repeated ones are masked out, so each is learned once.

A turn is written `### Role: text </turn>` and a line end. Inside roles and texts a backslash is doubled, and
`###`, `</turn>` and a role's colons get backslashes, so that no text can open or close a turn; undoing is exact.

Null roles and texts count as empty; turns with equal numbers go by role, then text. A turn is never cut, however long
its text. Repeated rows are repeated turns.
Conversations without an id form one of their own. An empty table gives no windows. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlake.llm.common import utf8

END = " </turn>\n"
BUDGET, HISTORY = 1024, 128


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\#\\#\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Words of a turn's text, or a token to four of its bytes where that is more (long words, scripts without spaces), and two for its marks."""
    return F.greatest(F.size(F.split(F.trim(text), r"\s+")), F.ceil(F.octet_length(text) / 4)).cast("bigint") + 2


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, own, loss): formatted windows in order.

    own is the number of turns at the end of the window that are not repeated; loss has the (start, stop) code points
    of the texts to learn. A window's text is bounded by the budget and its longest turn.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    conv = W.partitionBy("conv_id")
    rows = df.select("conv_id", "turn", utf8("role").alias("role"), utf8("text").alias("text"))
    rows = rows.withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("is_system", (F.col("n") == 1) & (F.col("role") == "system")).withColumn("tokens", tokens(F.col("text")))
    turn_tokens = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("tokens"))
    rows = rows.withColumn("after", F.sum(turn_tokens).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("after") - turn_tokens)
    system_tokens = F.coalesce(F.first(F.when(F.col("is_system"), F.col("tokens")), ignorenulls=True).over(conv), F.lit(0))
    rows = rows.withColumn("room", F.greatest(F.lit(budget // 4), F.lit(budget - history) - system_tokens).cast("bigint"))
    block = F.expr("before div room + (after - 1) div room")
    rows = rows.withColumn("window", F.when(~F.col("is_system"), block))
    rows = rows.withColumn("window", F.coalesce("window", F.lead("window").over(order), F.lit(0).cast("bigint")))
    rows = rows.withColumn("next", F.lead("window").over(order))
    rows = rows.withColumn("next", F.max("next").over(W.partitionBy("conv_id", "window")))
    stop = F.max("after").over(W.partitionBy("conv_id", "window"))
    rows = rows.withColumn("repeats", ~F.col("is_system") & (F.col("next") > F.col("window")) & (stop - F.col("before") <= history))
    own = F.struct(F.col("window"), F.lit(1).alias("own"))
    again = F.when(F.col("repeats"), F.struct(F.col("next").alias("window"), F.lit(0).alias("own")))
    placed = rows.withColumn("at", F.explode(F.array_compact(F.array(own, again))))

    part = F.concat(F.lit("### "), F.replace(escape(F.initcap(F.col("role"))), F.lit(":"), F.lit("\\:")), F.lit(": "))
    # the role as it was, where capitals change it
    part = F.when(F.lower(F.initcap("role")) == F.col("role"), part).otherwise(F.concat(F.lit("### ="), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": ")))
    turn = F.struct(
        F.col("n"),
        F.col("at.own").alias("own"),
        part.alias("head"),
        escape(F.col("text")).alias("body"),
        ((F.col("role") == "assistant") & (F.col("at.own") == 1)).alias("learn"),
    )
    system = F.max(F.when(F.col("is_system"), F.concat(part, escape(F.col("text")), F.lit(END)))).over(conv)
    grouped = (
        placed.withColumn("system", system)
        .groupBy("conv_id", F.col("at.window").alias("window"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("system").alias("system"))
    )
    kept = F.when(F.col("turns")[0]["n"] == 1, F.lit("")).otherwise(F.coalesce("system", F.lit("")))
    grouped = grouped.withColumn("kept", kept)
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    size = lambda c: F.char_length(c).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    start = F.struct(size(F.col("kept")).alias("at"), none.alias("spans"))

    def step(acc, t):
        begin = acc["at"] + size(t["head"])
        stop = begin + size(t["body"])
        spans = F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), stop.alias("stop"))))).otherwise(acc["spans"])
        return F.struct((stop + len(END)).alias("at"), spans.alias("spans"))

    return grouped.select(
        "conv_id",
        "window",
        F.concat("kept", body).alias("text"),
        F.size(F.filter("turns", lambda t: t["own"] == 1)).alias("own"),
        F.aggregate("turns", start, step)["spans"].alias("loss"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds turns: (role, text) of each window's own turns, parsed from its text."""
    pieces = F.filter(F.split("text", f"\\Q{END}\\E"), lambda p: p != "")
    head = r"(?s)^### (=?)([^:\\]*+(?:\\.[^:\\]*+)*+): (.*)$"

    def parse(p):
        role = unescape(F.regexp_extract(p, head, 2))
        return F.struct(
            F.when(F.regexp_extract(p, head, 1) == "=", role).otherwise(F.lower(role)).alias("role"),
            unescape(F.regexp_extract(p, head, 3)).alias("text"),
        )

    return formatted.withColumn("pieces", pieces).withColumn("turns", F.transform(F.slice("pieces", -F.col("own"), F.col("own")), parse)).drop("pieces")


def learned(text: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    cut = F.transform(loss, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return F.array_join(cut, "")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, learned text and size."""
    read = read_turns(formatted).select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            learned(F.col("text"), F.col("loss")).alias("learned"),
        ).alias("part"),
        F.size("turns").cast("bigint").alias("n"),
        F.char_length("text").cast("bigint").alias("chars"),
    )
    per = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    whole = lambda name: F.array_join(F.col(f"parts.{name}"), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return per.select(
        "conv_id",
        "n_turns",
        sha(whole("turns")).alias("turns_sha256"),
        F.char_length(whole("learned")).cast("bigint").alias("loss_chars"),
        sha(whole("learned")).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
