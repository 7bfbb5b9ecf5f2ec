"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Prefix sums of turn tokens choose
spans of whole turns: a span closes where the next turn would pass the budget left after the
system turn and the repeated history. Every window carries the system turn (the first turn, if
its role is ``system``), then as many turns before the span as fit ``history`` tokens, then the
span. The loss mask covers assistant texts of the span only, so a repeated target is masked and
each assistant text is learned once. A turn larger than the budget has a window of its own.

Inside texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so the template's
marks cannot occur there; roles also write a line break as ``<\\n``. Reading back undoes it.

Defined results: null texts and roles are empty. Turns of equal number are ordered by role and
text; repeated rows are turns each. Null conversation ids form one conversation. An assistant
turn without text gives an empty target.

Windows are chosen from narrow rows: turns are dealt by ranges of (conversation, turn, role, text), sums are carried
between ranges, and the chain of spans is followed by doubling, so a conversation of any size is spread. Texts meet per
window only. ``read_back`` gathers a conversation in one row, as its digest needs all of it in order: there
it must stay below the 2 GB of a row and the memory of an executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import materialise

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
TARGET, SYSTEM = "assistant", "system"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    return _swap(_swap(text, "\\", "\\\\"), "<|", "<\\|")


def unescaped(text: Column) -> Column:
    return _swap(_swap(text, "<\\|", "<|"), "\\\\", "\\")


def byte_tokens(text: Column) -> Column:
    """An estimate that needs no vocabulary: a token for every four bytes begun, and four for a turn's marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


BUCKET = 1 << 16  # tokens


def _counted(values: DataFrame, queries: DataFrame, ties: bool) -> DataFrame:
    """(g, i, n): how many ``v`` of the group lie below a query's ``v``; with ``ties``, equal ones too."""
    both = values.select("g", "v", F.lit(None).cast("bigint").alias("i")).unionByName(queries.select("g", "v", "i")).withColumn("b", F.floor(F.col("v") / BUCKET))
    own = F.when(F.col("i").isNull(), 1).otherwise(0)
    later = F.col("i").isNotNull() if ties else F.col("i").isNull()
    within = Window.partitionBy("g", "b").orderBy("v", later).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.groupBy("g", "b").agg(F.sum(own).alias("n"))
    earlier = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lower"))
    found = both.withColumn("n", F.sum(own).over(within)).where("i is not null")
    return found.join(sums, ["g", "b"]).select("g", "i", (F.col("n") + F.col("lower")).alias("n"))


def _placed(conversations: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """Written turns with their group ``g``, place from 0 and the tokens before them."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    group = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), tokens(text).cast("bigint").alias("tokens"), group.alias("g"))
    order = ("g", "turn", "role", "text")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "turns")
    sums = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_lower") for c in ("rows", "sum")))
    own = Window.partitionBy("g", "part").orderBy("at")
    before = F.coalesce(F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    narrow = dealt.select("g", "part", "at", "tokens").withColumns({"place": F.row_number().over(own) - 1, "before": before}).join(sums, ["g", "part"])
    narrow = materialise(narrow.select("g", "at", (F.col("place") + F.col("rows_lower")).alias("place"), (F.col("before") + F.col("sum_lower")).alias("before")), "places")
    return dealt.drop("part").join(narrow.drop("g"), "at")


def windows(conversations: DataFrame, budget: int = 2048, history: int = 512, tokens: Callable[[Column], Column] = byte_tokens) -> DataFrame:
    """(conv_id, window, formatted, loss, repeated, n_tokens): loss holds (start from 1, length) in characters of ``formatted``;
    the first ``repeated`` turns of a window stand in earlier ones as well."""
    head = F.concat(F.lit(START), _swap(escaped(F.col("role")), "\n", "<\\n"), F.lit("\n"))
    rows = materialise(_placed(conversations, tokens), "placed")
    piece = F.concat(head, escaped(F.col("text")), F.lit(END + "\n"))
    led = (F.col("place") == 0) & (F.col("role") == SYSTEM)
    sizes = rows.groupBy("g").agg(F.max("conv_id").alias("conv_id"), F.max(led.cast("int")).alias("lead"), F.count(F.lit(1)).alias("rows"),
                                  F.coalesce(F.max(F.when(led, F.col("tokens"))), F.lit(0)).alias("opening_tokens"))
    opened = rows.where(led).select("g", piece.alias("opening"))
    talks = materialise(sizes.join(opened, "g", "left").withColumn("opening", F.coalesce("opening", F.lit(""))), "talks")
    body = rows.select("g", "place", "tokens", "before").join(talks.select("g", "lead", "opening_tokens"), "g").where("place >= lead")
    body = body.select("g", (F.col("place") - F.col("lead")).alias("i"), "tokens", (F.col("before") - F.col("opening_tokens")).alias("before"),
                       F.greatest(F.lit(1), F.lit(budget - history) - F.col("opening_tokens")).alias("room"))
    body = materialise(body, "body")
    ends = body.select("g", (F.col("before") + F.col("tokens")).alias("v"))
    fits = _counted(ends, body.select("g", "i", (F.col("before") + F.col("room")).alias("v")), ties=True)
    count = talks.select("g", (F.col("rows") - F.col("lead")).alias("size"))
    after = fits.select("g", "i", F.greatest(F.col("i") + 1, F.col("n")).alias("next")).join(count, "g").where("next < size")
    first = hops = materialise(after.select("g", "i", "next"), "hops")
    # Chains of spans, twice as long each time: the starts numbered below 2^k and the hops over 2^k spans.
    starts, step = materialise(talks.select("g", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("window")), "starts"), 1
    while not hops.isEmpty():
        more = starts.join(hops, ["g", "i"]).select("g", F.col("next").alias("i"), (F.col("window") + step).alias("window"))
        starts = materialise(starts.unionByName(more), "starts")
        hops = materialise(hops.join(hops.select("g", F.col("i").alias("next"), F.col("next").alias("then")), ["g", "next"]).select("g", "i", F.col("then").alias("next")), "hops")
        step *= 2
    spans = starts.join(first, ["g", "i"], "left").join(count, "g").select("g", "window", "i", F.coalesce("next", "size").alias("stop"))
    asked = starts.join(body.select("g", "i", "before"), ["g", "i"]).select("g", "i", (F.col("before") - history).alias("v"))
    passed = _counted(body.select("g", F.col("before").alias("v")), asked, ties=False).select("g", "i", F.col("n").alias("from"))
    spans = spans.join(passed, ["g", "i"], "left").withColumn("from", F.coalesce("from", F.lit(0)))
    # Each span names its turns; texts join them and meet again per window.
    some = F.when(F.col("from") < F.col("stop"), F.sequence("from", F.col("stop") - 1))
    named = spans.select("g", "window", F.col("i").alias("start"), "from", F.explode_outer(some).alias("i")).join(talks.select("g", "lead"), "g")
    named = named.select("g", "window", "start", "from", "i", (F.col("i") + F.col("lead")).alias("place"))
    text = rows.select("g", "place", "tokens", piece.alias("piece"), F.length(head).alias("head_chars"), F.length(escaped(F.col("text"))).alias("body_chars"),
                       (F.col("role") == TARGET).alias("target"))
    turn = F.struct("i", "piece", "tokens", F.length("piece").alias("chars"), "head_chars", "body_chars", "target")
    cut = named.join(text, ["g", "place"], "left").groupBy("g", "window").agg(
        F.first("start").alias("start"), F.first("from").alias("from"), F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), turn))).alias("held"))
    cut = cut.join(talks.select("g", "conv_id", "lead", "opening", "opening_tokens"), "g")
    marked = F.aggregate("held", F.struct(F.length("opening").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")), lambda acc, t: F.struct(
        (acc["at"] + t.chars).alias("at"),
        F.when(t.target & (t["i"] >= F.col("start")), F.concat(acc.loss, F.array(F.struct((acc["at"] + t.head_chars + 1).alias("start"), t.body_chars.alias("length")))))
        .otherwise(acc.loss).alias("loss")))
    # Without a window yet, the system turn is new; afterwards it is repeated.
    return cut.select("conv_id", F.col("window").cast("int").alias("window"), F.concat("opening", F.array_join(F.col("held.piece"), "")).alias("formatted"), marked.loss.alias("loss"),
                      (F.when(F.col("window") > 0, F.col("lead")).otherwise(0) + F.col("start") - F.col("from")).cast("int").alias("repeated"),
                      (F.col("opening_tokens") + F.aggregate("held", F.lit(0).cast("bigint"), lambda acc, t: acc + t.tokens)).alias("n_tokens"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted window as (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescaped(_swap(role, "<\\n", "\n")).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation from its windows alone: repeated turns leave, learned texts follow each other."""
    own = F.col("formatted")
    learned = F.transform("loss", lambda s: unescaped(F.substring(own, s.start, s.length)))
    rows = formatted.select("conv_id", "window", F.length(own).cast("bigint").alias("chars"), F.array_join(learned, "").alias("learned"),
                            F.expr("slice(t, repeated + 1, size(t))").alias("turns")) if "t" in formatted.columns else None
    if rows is None:
        return read_back(formatted.withColumn("t", turns_of(own)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    rows = rows.select("conv_id", F.struct("window", "chars", "learned", said.alias("said"), F.size("turns").alias("n")).alias("w"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"))
    learned = F.array_join(F.col("w.learned"), "")
    return talks.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), "").cast("binary"), 256).alias("turns_sha256"),
                        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
