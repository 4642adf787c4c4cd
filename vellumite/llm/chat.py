"""Operator 2 - chat formatting: a dialogue seen by each of its participants. DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that
speaker as ``assistant`` and all others as named users; the mask marks what the
model is trained on, the speaker's own words and their end mark. Speakers in
``context`` (system) are told to everyone, keep their role and have no
perspective of their own.

A rendered dialogue is a sequence of segments, one row a message, with the place
of each in the whole text: ``start`` and ``stop`` in characters, ``mask_start``
and ``mask_stop`` of the trained part (equal where nothing is trained). Segments
in ``seq`` order, put together, are the dialogue. So a conversation of any length
is never held in one task: offsets are running sums inside range partitions plus
the sums of the partitions ahead.

Marks inside a text or a name (``<|``) are broken up (``< |``), so no text can forge
a turn or an end; a name's line ends become spaces.

Null texts are empty; a null role speaks as ``unknown``; a null conv_id is one
conversation. Equal turns are ordered by role and text; repeated rows are
repeated messages. A conversation without participants renders nothing. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
CONTEXT = ("system",)


def perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """(conv_id, perspective, seq, turn, speaker, segment, start, stop, mask_start, mask_stop), one row a message and perspective."""
    unmarked = lambda c, none: F.replace(F.coalesce(c, F.lit(none)), F.lit("<|"), F.lit("< |"))
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), unmarked("text", "").alias("text"))
    known = ", ".join("'" + c.replace("'", "\\'") + "'" for c in context) or "''"
    heard = F.expr(f"speaker in ({known})")
    cast = said.where(~heard).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.lit(1).alias("_"))
    cast = cast.selectExpr("conv_id as _conv", "perspective")
    views = said.join(cast, F.expr("conv_id <=> _conv")).drop("_conv")
    own = F.expr("speaker = perspective")
    head = F.when(own, "assistant").when(heard, F.col("speaker")).otherwise(F.concat(F.lit("user name="), F.translate(unmarked("speaker", ""), "\r\n", "  ")))
    head = F.concat(F.lit(OPEN), head, F.lit(MIDDLE))
    views = views.withColumn("_head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(CLOSE))).withColumn("_own", own)
    order = ["conv_id", "perspective", "turn", "speaker", "text"]
    dealt = views.repartitionByRange(*(F.asc_nulls_first(c) for c in order)).sortWithinPartitions(*(F.asc_nulls_first(c) for c in order))
    dealt = dealt.withColumn("_mid", F.monotonically_increasing_id())
    dealt = common.stored(dealt.drop("text"), "perspectives").withColumn("_pid", F.shiftright("_mid", 33))
    # inside a partition, then the sums of this dialogue's partitions ahead
    inner = "over (partition by _pid, conv_id, perspective order by _mid)"
    local = dealt.selectExpr("*", f"row_number() {inner} - 1 as _seq", f"sum(length(segment)) {inner} as _upto")
    parts = dealt.groupBy("conv_id", "perspective", "_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("segment")).alias("_size"))
    ahead = "over (partition by conv_id, perspective order by _pid rows between unbounded preceding and 1 preceding)"
    parts = parts.selectExpr("conv_id as _conv", "perspective as _view", "_pid as _part", f"coalesce(sum(_n) {ahead}, 0) as _seqs", f"coalesce(sum(_size) {ahead}, 0) as _chars")
    placed = local.join(parts, F.expr("_pid = _part and perspective = _view and conv_id <=> _conv"))
    placed = placed.selectExpr("conv_id", "perspective", "_seqs + _seq as seq", "turn", "speaker", "segment", "_chars + _upto - length(segment) as start", "_chars + _upto as stop", "_head", "_own")
    begin = "case when _own then start + _head else stop end as mask_start"
    end = f"case when _own then stop - {len(CLOSE) - len(CLOSE.rstrip())} else stop end as mask_stop"
    return placed.selectExpr("conv_id", "perspective", "seq", "turn", "speaker", "segment", "start", "stop", begin, end)


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(common.read_table(spark, sf_dir, "conversations"))


QUERIES = {"op2_perspectives": op2_perspectives}
ORACLES = {
    "op2_perspectives": """
        with said as (select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
        seats as (select distinct conv_id as conv, speaker as perspective from said where speaker <> 'system'),
        views as (
            select conv_id, perspective, turn, speaker, text,
                   '<|turn|>' || case when speaker = perspective then 'assistant' when speaker = 'system' then speaker
                                        else 'user name=' || translate(replace(speaker, '<|', '< |'), chr(13) || chr(10), '  ') end || chr(10) as head
            from said join seats on conv_id is not distinct from conv),
        told as (select *, head || text || '<|end|>' || chr(10) as segment from views),
        placed as (
            select *, row_number() over w - 1 as seq, sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, text rows unbounded preceding) as stop
            from told window w as (partition by conv_id, perspective order by turn nulls first, speaker, text))
        select conv_id, perspective, seq, turn, speaker, segment, cast(stop - length(segment) as bigint) as start, cast(stop as bigint) as stop,
               cast(case when speaker = perspective then stop - length(segment) + length(head) else stop end as bigint) as mask_start,
               cast(case when speaker = perspective then stop - 1 else stop end as bigint) as mask_stop
        from placed"""
}
