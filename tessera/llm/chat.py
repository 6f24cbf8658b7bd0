"""Chat formatting in Spark expressions only.

Turns are collected per conversation and sorted; adjacent turns of one role become one block by array aggregation;
blocks are concatenated. The template marks them like this, a merged block holding several texts:

    <s>[INST]user[/INST]first text[TURN]second text</s><s>[INST]assistant[/INST]answer</s>

Roles and texts are escaped so that none of the five control strings occurs in them: a backslash becomes two, and a
control string gets one after its first character. Dropping each backslash but what follows it reverses both. ``loss``
holds the spans (start from 0, length, in code points) of the assistant's texts; it covers no marks.

Work is in proportion to a conversation's length: runs of a role are found first and sliced once, and positions are
summed in two levels (``_starts``).

Defined results: null texts and roles count as empty. Turns are ordered by turn (null first), role, text, so repeated
rows and ties have one order; repeated rows are turns of their own. Each row with a null conv_id is a conversation of
its own, as nothing says what it belongs to, so many of them don't meet in a task. An empty table gives no rows. Other
columns, whatever their names, are ignored. A conversation, however long, is one row of the result and so has to fit a
task; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE, BODY, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "[TURN]", "</s>"
_CONTROL = r"([<\[])(s>|/s>|INST\]|/INST\]|TURN\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _starts(lengths: Column, block: int = 256) -> Column:
    """The sum of the entries before each one. Appending to an array copies it, so blocks are summed apart and then shifted."""
    none = F.expr("cast(array() as array<bigint>)")

    def running(x: Column) -> Column:
        """The sums before each entry, and of all."""
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("starts"))
        return F.aggregate(x, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))

    blocks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / block).cast("int")), lambda k: running(F.slice(lengths, k * block + 1, block))))
    shifts = running(F.transform(blocks, lambda b: b["at"]))["starts"]
    return F.flatten(F.zip_with(blocks, shifts, lambda b, by: F.transform(b["starts"], lambda x: x + by)))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and length), blocks (how many after merging)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    chats = rows.withColumn("alone", alone).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", "turns", F.transform("turns", lambda t: t["role"]).alias("roles"))

    # where a run of one role starts, and the runs, each sliced once
    n = F.size("turns")
    new = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("roles", i) != F.element_at("roles", F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(F.col("new"), 2, F.size("new")), F.array(n + 1))
    chats = chats.withColumn("new", new).withColumn("runs", F.arrays_zip(F.col("new").alias("a"), ends.alias("b")))
    block = lambda r: F.struct(F.element_at("roles", r["a"]).alias("role"), F.transform(F.slice("turns", r["a"], r["b"] - r["a"]), lambda t: t["text"]).alias("texts"))
    chats = chats.select("conv_id", F.transform("runs", block).alias("blocks"))

    def part(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    def parts(b: Column) -> Column:
        mark = F.lit(False)
        head = part(F.concat(F.lit(OPEN + ROLE), escape(b["role"]), F.lit(BODY)), mark)
        texts = F.flatten(F.transform(b["texts"], lambda x, i: F.array(part(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), mark), part(escape(x), b["role"] == "assistant"))))
        return F.concat(F.array(head), texts, F.array(part(F.lit(CLOSE), mark)))

    chats = chats.select("conv_id", F.size("blocks").cast("long").alias("blocks"), F.flatten(F.transform("blocks", parts)).alias("parts"))
    chats = chats.withColumn("lengths", F.transform("parts", lambda p: F.length(p["s"]).cast("long")))
    spans = F.zip_with(F.zip_with("parts", "lengths", lambda p, n: F.struct(p["loss"].alias("loss"), n.alias("length"))), _starts(F.col("lengths")), lambda p, at: F.struct(p["loss"].alias("loss"), at.alias("start"), p["length"].alias("length")))
    loss = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
    return chats.select("conv_id", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), loss.alias("loss"), "blocks")


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of each), loss_text: what the formatted text and its mask say."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, BODY, 1)
        role = unescape(F.substring(head, len(OPEN + ROLE) + 1, 1 << 30))
        body = F.substring(block, F.length(head) + len(BODY) + 1, F.lit(1 << 30))
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.split("formatted", CLOSE, -1)
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    # a substring is found by counting from the start, so the text is cut into chunks once
    size = 1024
    chunks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def masked(s: Column, chunks: Column) -> Column:
        first, last = F.floor(s["start"] / size), F.floor((s["start"] + s["length"] - 1) / size)
        near = F.array_join(F.slice(chunks, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "")
        return unescape(F.substring(near, (s["start"] - first * size + 1).cast("int"), s["length"].cast("int")))

    # the variable of a lambda is computed once, a column could be for each span
    under = F.transform(F.array(chunks), lambda c: F.array_join(F.transform("loss", lambda s: masked(s, c)), ""))[0]
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), under.alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the output."""
    back = read_chats(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
