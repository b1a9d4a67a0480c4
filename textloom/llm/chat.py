"""Chat formatting by multi-party perspective rotation, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Turns of a conversation that one row renders at most; longer ones go on in further parts.
PART_TURNS = 1024
#: The template's marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """turns with `nth`, the place of a turn in its conversation's order, without gathering a conversation in one task.

    A conversation of any size stands by turn, role and text, nulls first. One of more than PART_TURNS turns is
    counted by distinct turn, dealt out by ranges of that order, and numbered from the sums of the ranges before.
    """
    keys = ["conv", "turn", "role", "body"]
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("conv", "c")
    both = turns.join(sizes.hint("merge"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    by_conv = Window.partitionBy("conv").orderBy("turn", "role", "body")
    small = both.filter(F.col("size") <= PART_TURNS).withColumn("nth", (F.row_number().over(by_conv) - 1).cast("long")).select(*keys, "nth")
    cells = both.filter(F.col("size") > PART_TURNS).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # Stored, so that every use sees the same ranges.
    cells = stored(cells.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = cells.groupBy("conv", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select(F.col("conv").alias("rc"), F.col("range").alias("rr"), earlier(Window.partitionBy("conv").orderBy("range")).alias("before_range"))
    cells = cells.withColumn("before", earlier(Window.partitionBy("conv", "range").orderBy("turn", "role", "body")))
    cells = cells.join(ranges.hint("merge"), F.col("conv").eqNullSafe(F.col("rc")) & (F.col("range") == F.col("rr")))
    first = F.col("before_range") + F.col("before")
    return small.unionByName(cells.select(*keys, F.explode(F.sequence(first, first + F.col("n") - 1)).alias("nth")))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_own, rendered, mask): the dialogue as each participant sees it.

    Participants are the distinct roles of a conversation but 'system', whose turns are rendered as such for
    everybody. A participant's own turns are 'assistant', all others 'user name=<role>'. Turns stand by turn
    number, then role, then text, nulls first; repeated rows are repeated turns. A null role is the participant
    'unknown', a null text is empty. `mask` lists (begin, end) of the characters of `rendered` that the participant
    speaks, the closing mark included; everything else is not to be learned. A conversation of more than
    PART_TURNS turns goes on in further parts of as many turns, each from its own offset 0; parts joined in
    order are the whole dialogue. A conversation of system turns alone has no perspective; an empty table gives
    an empty one; a null conversation id is one conversation; other columns don't matter.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body")
    )
    speaker = F.coalesce("role", F.lit("unknown")).alias("speaker")
    people = rows.select("conv", speaker).filter("speaker <> 'system'").distinct().withColumnRenamed("speaker", "perspective")
    ordered = numbered(rows).withColumn("part", F.floor(F.col("nth") / PART_TURNS))
    # PART_TURNS turns at most in one group.
    parts = ordered.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("nth", speaker, "body"))).alias("turns"))
    seen = parts.withColumnRenamed("conv", "c").join(people.hint("merge"), F.col("c").eqNullSafe(F.col("conv")))
    header = lambda t: F.when(t["speaker"] == "system", F.lit("system")).when(t["speaker"] == F.col("perspective"), F.lit("assistant")).otherwise(
        F.concat(F.lit("user name="), t["speaker"])
    )
    own = lambda t: t["speaker"] == F.col("perspective")
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), header(t), F.lit("\n")).alias("head"), F.concat(t["body"], F.lit(CLOSE)).alias("said"), own(t).alias("own")))
    seen = seen.withColumn("pieces", pieces)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(a, p):
        begin = a["at"] + F.length(p["head"])
        end = begin + F.length(p["said"])
        span = F.struct(begin.alias("begin"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return seen.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        F.col("part").cast("long").alias("part"),
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["said"])), "").alias("rendered"),
        F.aggregate("pieces", zero, step, lambda a: a["spans"]).alias("mask"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's view; the mask as text `begin-end,...`."""
    seen = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    return seen.withColumn("mask", F.array_join(spans, ","))


OP10_SQL = r"""
with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as body,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as nth from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
x as (select t.conv_id, p.perspective, t.nth // 1024 as part, t.nth, t.speaker = p.perspective as own,
    '<|im_start|>' || case when t.speaker = 'system' then 'system' when t.speaker = p.perspective then 'assistant' else 'user name=' || t.speaker end || chr(10) as head,
    t.body || '<|im_end|>' || chr(10) as said from t join p using (conv_id)),
y as (select *, sum(length(head) + length(said)) over (partition by conv_id, perspective, part order by nth) as stop from x)
select conv_id, perspective, cast(part as bigint) as part, count(*) as n_turns, count(*) filter (where own) as n_own,
  string_agg(head || said, '' order by nth) as rendered,
  coalesce(string_agg(cast(stop - length(said) as varchar) || '-' || cast(stop as varchar), ',' order by nth) filter (where own), '') as mask
from y group by conv_id, perspective, part
"""
