"""Chat formatting as a relational query: DataFrame expressions only.

Turns are collected into sorted structs, runs of one role are merged, and the merged turns are concatenated
under a template: ``<s>`` in front, ``[INST] body [/INST]`` for users, `` body </s>`` for assistants,
``<<SYS>> body <</SYS>>`` for the system, ``[ROLE] role\\4body [/ROLE]`` for any other role. Bodies hold no
control string: backslash, ``<`` and ``[`` are written ``\\0``, ``\\1`` and ``\\2``, and ``\\3`` stands between
the texts of a merged turn, so that the turns can be read back exactly. The loss mask is a list of character
spans, one for each assistant body.

How it scales: one shuffle by conversation. The result is one string a conversation, so a conversation's turns
meet in one task by the nature of the result; conversations of a common first turn or text do not meet. The work is
linear in a conversation's length: where segments begin are running sums of a window over its exploded segments (no
further shuffle), and spans are read from the string cut once into blocks of ``BLOCK`` characters.

Defined results: a null text is empty, a null role is the empty role; null conversation ids are one
conversation; turns are ordered by number (null first), ties by role and text; repeated rows are repeated
turns; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = {"user": "[INST] ", "assistant": " ", "system": "<<SYS>> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
OTHER_OPEN, OTHER_CLOSE = "[ROLE] ", " [/ROLE]"
START, JOINT, ROLE_END = "<s>", "\\3", "\\4"
#: Characters of a block in which a span is looked up: finding a character costs what stands before it.
BLOCK = 4_096
SEGMENT = r"\[INST\] [^\[<]* \[/INST\]|<<SYS>> [^\[<]* <</SYS>>|\[ROLE\] [^\[<]* \[/ROLE\]| [^\[<]* </s>"


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def plain(text: Column) -> Column:
    for code, back in (("\\2", "["), ("\\1", "<"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(back))
    return text


def _by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = other
    for r, mark in marks.items():
        out = F.when(role == r, F.lit(mark)).otherwise(out)
    return out


def merged_turns(turns: Column) -> Column:
    """Runs of one role as structs of the role and the joined, escaped body."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(turns, F.greatest(i - 1, F.lit(1))).role != F.element_at(turns, i).role))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n + 1))
    runs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.transform(
        runs,
        lambda r: F.struct(
            F.element_at(turns, r["a"]).role.alias("role"),
            F.array_join(F.transform(F.slice(turns, r["a"], r["b"] - r["a"]), lambda t: escaped(t.text)), JOINT).alias("body"),
        ),
    )


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start from 0 and length, in characters)."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    chats = chats.select("conv_id", merged_turns(F.col("turns")).alias("runs"))

    def segment(r: Column) -> Column:
        opening = _by_role(r.role, OPEN, F.concat(F.lit(OTHER_OPEN), escaped(r.role), F.lit(ROLE_END)))
        return F.struct(
            F.concat(opening, r.body, _by_role(r.role, CLOSE, F.lit(OTHER_CLOSE))).alias("text"),
            F.length(opening).alias("lead"), F.length(r.body).alias("body"), (r.role == "assistant").alias("loss"),
        )

    parts = chats.select("conv_id", F.posexplode(F.transform("runs", segment)).alias("pos", "s"))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("begin", F.coalesce(F.sum(F.length("s.text")).over(before), F.lit(0)) + len(START))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "begin", "s"))).alias("parts"))
    spans = F.transform(
        F.filter("parts", lambda z: z.s.loss),
        lambda z: F.struct((z.begin + z.s.lead).cast("int").alias("start"), z.s.body.alias("length")),
    )
    text = F.concat(F.lit(START), F.array_join(F.transform("parts", lambda z: z.s.text), ""))
    return whole.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def cut_out(text: Column, spans: Column) -> Column:
    """The texts of spans (start from 0 and length, in characters), each in time that does not grow with its start."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def one(blocks: Column, s: Column) -> Column:
        first, last = F.floor(s.start / BLOCK).cast("int"), F.floor((s.start + s.length) / BLOCK).cast("int")
        return F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), s.start % BLOCK + 1, s.length)

    # The blocks are an argument, so they are cut once and not for each span.
    both = F.array(F.struct(blocks.alias("blocks"), spans.alias("spans")))
    return F.element_at(F.transform(both, lambda z: F.transform(z.spans, lambda s: one(z.blocks, s))), 1)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: structs of role and text, merged ones apart again."""
    segments = F.regexp_extract_all(F.substr(formatted, F.lit(len(START) + 1)), F.lit(SEGMENT), F.lit(0))

    def turns(s: Column) -> Column:
        role = F.lit("assistant")
        opening = F.lit(OPEN["assistant"])
        closing = F.lit(CLOSE["assistant"])
        for r in ("user", "system"):
            here = F.startswith(s, F.lit(OPEN[r]))
            role, opening, closing = F.when(here, F.lit(r)).otherwise(role), F.when(here, F.lit(OPEN[r])).otherwise(opening), F.when(here, F.lit(CLOSE[r])).otherwise(closing)
        other = F.startswith(s, F.lit(OTHER_OPEN))
        named = F.substring_index(F.substr(s, F.lit(len(OTHER_OPEN) + 1)), ROLE_END, 1)
        role = F.when(other, plain(named)).otherwise(role)
        lead = F.when(other, F.length(named) + len(OTHER_OPEN) + len(ROLE_END)).otherwise(F.length(opening))
        tail = F.when(other, F.lit(len(OTHER_CLOSE))).otherwise(F.length(closing))
        body = F.substr(s, lead + 1, F.length(s) - lead - tail)
        return F.transform(F.split(body, r"\\3", -1), lambda t: F.struct(role.alias("role"), plain(t).alias("text")))

    return F.flatten(F.transform(segments, turns))


def digests(chats: DataFrame) -> DataFrame:
    """What the contract asks for, read back from ``formatted`` and ``loss_spans``."""
    turns = F.col("turns")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    masked = F.array_join(F.transform(cut_out(F.col("formatted"), F.col("loss_spans")), lambda t: plain(F.replace(t, F.lit(JOINT), F.lit("")))), "")
    read = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("masked", masked)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
