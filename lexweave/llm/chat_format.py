r"""Chat formatting by relational expressions only.

The turns of a conversation are collected as structs, sorted, merged where neighbours share a
role, and concatenated under a template:

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>
    any other  <<ROLE>>role<</ROLE>>text<</TURN>>

Texts of a merged turn are joined by ``<<SEP>>``. A control string inside a text gets a tilde
behind its first character, one more if tildes are there already, so no text can close or open
a turn and every text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE, SEP = "<<ROLE>>", "<</ROLE>>", "<</TURN>>", "<<SEP>>"
CONTROL = r"(/?s>|/?INST\]|</?(?:SYS|ROLE|TURN|SEP)>>)"
TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|<<ROLE>>.*?<</ROLE>>)(.*?)(?:<</SYS>>|\[/INST\]|</s>|<</TURN>>)"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + CONTROL, "$1$2$3")


def _open(role: Column) -> Column:
    out = F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE))
    for name, mark in OPEN.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _close(role: Column) -> Column:
    out = F.lit(TURN_CLOSE)
    for name, mark in CLOSE.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _role(mark: Column) -> Column:
    cut = len(ROLE_OPEN), len(ROLE_OPEN) + len(ROLE_CLOSE)
    out = unescape(F.substring(mark, F.lit(cut[0] + 1), F.length(mark) - F.lit(cut[1])))
    for name, known in OPEN.items():
        out = F.when(mark == known, F.lit(name)).otherwise(out)
    return out


SPANS = "array<struct<start:bigint,length:bigint>>"


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once a row: a generator over one struct, which the optimizer doesn't inline."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def run_starts(turns: str) -> Column:
    """Where in the sorted turns a run of one role begins."""
    every = F.when(F.size(turns) > 0, F.sequence(F.lit(0), F.size(turns) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))


def merge_turns(turns: str, starts: str) -> Column:
    """Neighbours of one role become one element (role, texts) that holds their texts in order.

    ``turns`` is a column of sorted structs with ``role`` and ``text``, ``starts`` its
    :func:`run_starts`; every turn is copied once.
    """
    return F.transform(
        F.col(starts),
        lambda at, k: F.struct(
            F.get(turns, at)["role"].alias("role"),
            F.transform(F.slice(turns, at + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - at), lambda t: t["text"]).alias("texts"),
        ),
    )


def loss_spans(df: DataFrame, pieces: str, out: str) -> DataFrame:
    """``df`` with the (start, length) of each piece under the loss.

    Places add up in blocks of about the square root of their number, so the arrays that grow
    inside an aggregate stay short in a conversation of any length.
    """
    measured = F.transform(pieces, lambda p: F.struct(F.length(p["piece"]).cast("bigint").alias("n"), p["loss"].alias("loss")))
    df = _held(df, _measured=measured, _block=F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(pieces)))).cast("int"))
    df = _held(df, _firsts=F.when(F.size(pieces) > 0, F.sequence(F.lit(1), F.size(pieces), F.col("_block"))).otherwise(F.array().cast("array<int>")))
    size_of = lambda at: F.aggregate(F.slice("_measured", at, F.col("_block")), F.lit(0).cast("bigint"), lambda n, p: n + p["n"])
    none = F.array().cast("array<bigint>")
    run = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("starts"))
    starts = F.aggregate("_firsts", run, lambda acc, at: F.struct((acc["at"] + size_of(at)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))
    df = _held(df, _starts=starts["starts"])

    def of_block(at, k):
        run = F.struct(F.get("_starts", k).alias("at"), F.array().cast(SPANS).alias("spans"))
        own = lambda acc, p: F.array(F.struct(acc["at"].alias("start"), p["n"].alias("length")))
        add = lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"), F.when(p["loss"], F.concat(acc["spans"], own(acc, p))).otherwise(acc["spans"]).cast(SPANS).alias("spans")
        )
        return F.aggregate(F.slice("_measured", at, F.col("_block")), run, add)["spans"]

    return df.withColumn(out, F.flatten(F.transform("_firsts", of_block))).drop("_measured", "_block", "_firsts", "_starts")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``, one per assistant text:
    where the training loss applies. Turns sort by turn, then role, then text, so repeated or
    tied turns have one defined order; a null turn number comes first, a null role is the empty
    role, a null text is empty. A null conv_id is a conversation of its own. An empty table
    gives an empty result; other columns are ignored. One conversation becomes one row and so
    has to fit into one; its turns are gathered per task before they are shuffled.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_all"))
    held = _held(_held(sorted_turns, _turns=F.col("_all")).drop("_all"), _runs=run_starts("_turns"))
    merged = _held(held, _merged=merge_turns("_turns", "_runs")).drop("_turns", "_runs")
    # pieces alternate between marks and escaped texts; a span is where a piece of the loss role starts
    pieces = F.flatten(
        F.transform(
            "_merged",
            lambda m: F.concat(
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda t, i: F.array(
                            F.struct(F.when(i == 0, _open(m["role"])).otherwise(F.lit(SEP)).alias("piece"), F.lit(False).alias("loss")),
                            F.struct(escape(t).alias("piece"), (m["role"] == LOSS_ROLE).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(_close(m["role"]).alias("piece"), F.lit(False).alias("loss"))),
            ),
        )
    )
    cut = loss_spans(_held(merged, _pieces=pieces).drop("_merged"), "_pieces", "loss_spans")
    return cut.select("conv_id", F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns inside a formatted conversation: array of (role, text), each text as it was."""
    marks = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.flatten(
        F.transform(
            F.arrays_zip(marks.alias("mark"), bodies.alias("body")),
            lambda z: F.transform(
                F.split(z["body"], SEP), lambda t: F.struct(_role(z["mark"]).alias("role"), unescape(t).alias("text"))
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its spans."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
