"""Preference formatting of conversations. Native.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows becomes a pair of completions, each
with a mask of the character spans that training looks at (the assistant's
own text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.llm.common import table

ASSISTANT = "assistant"


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    """A turn's text; markers inside it are broken up, null is empty."""
    return F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |"))


TAIL = "\n<|end|>\n"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit(TAIL))), "")


def mask(turns: Column) -> Column:
    """``(start, end)`` of each non-empty assistant text in ``render(turns)``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(head(t))
        end = begin + F.length(body(t))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        trained = F.coalesce(t["role"] == ASSISTANT, F.lit(False)) & (end > begin)
        return F.struct((end + len(TAIL)).alias("at"), F.when(trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text (null-safe)."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, n).otherwise((first - 1).cast("int"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected`` -> prompt and paired masked completions.

    ``chosen`` and ``rejected`` are arrays of ``struct<role, text>``. A null
    array counts as empty. Equal conversations give empty completions; other
    columns are ignored.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    cut = sides.withColumn("k", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("k") + 1, F.size(x))
    parts = cut.select("pair_id", "k", F.slice("c", F.lit(1), F.col("k")).alias("p"), rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    return parts.select(
        "pair_id",
        F.col("k").cast("long").alias("n_prompt_turns"),
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        mask(F.col("c")).alias("chosen_mask"),
        render(F.col("r")).alias("rejected"),
        mask(F.col("r")).alias("rejected_mask"),
    )


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations, one per ``conv_id``.

    Chosen: a conversation up to its last assistant turn. Rejected: the same
    turns before that one, answered by the last assistant turn of the partner,
    the conversation whose id differs in the lowest bit. Without partner or
    answer the rejected side ends before the answer; without an assistant turn
    both sides are the whole conversation. Turns of one number are ordered by
    role and text. Rows with null ``conv_id`` belong to no conversation.
    """
    turn = F.struct("conv_id", "turn", "role", "text")
    two = conversations.where("conv_id is not null").groupBy(F.shiftright("conv_id", 1).alias("two")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    ids = F.array_distinct(F.transform("turns", lambda t: t["conv_id"]))
    each = two.select("turns", F.explode(ids).alias("pair_id"))
    plain = lambda keep: F.transform(F.filter("turns", keep), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sides = each.select("pair_id", plain(lambda t: t["conv_id"] == F.col("pair_id")).alias("own"), plain(lambda t: t["conv_id"] != F.col("pair_id")).alias("other"))
    from_end = lambda x: F.array_position(F.transform(F.reverse(x), lambda t: F.coalesce(t["role"] == ASSISTANT, F.lit(False))), F.lit(True))
    placed = sides.withColumn("i", F.size("own") - from_end(F.col("own")) + 1).withColumn("j", F.size("other") - from_end(F.col("other")) + 1)
    answered = F.col("i") <= F.size("own")
    reply = F.when(F.col("j") <= F.size("other"), F.slice("other", F.col("j").cast("int"), F.lit(1))).otherwise(F.slice("other", F.lit(1), F.lit(0)))
    before = F.slice("own", F.lit(1), (F.col("i") - 1).cast("int"))
    return placed.select(
        "pair_id",
        F.when(answered, F.slice("own", F.lit(1), F.col("i").cast("int"))).otherwise(F.col("own")).alias("chosen"),
        F.when(answered, F.concat(before, reply)).otherwise(F.col("own")).alias("rejected"),
    )


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations; masks as text such as ``14-208,230-401``."""
    out = format_preferences(swapped_pairs(table(spark, sf_dir, "conversations")))
    return out.withColumn("chosen_mask", spans_text("chosen_mask")).withColumn("rejected_mask", spans_text("rejected_mask"))


ORACLE = r"""
with t as (select conv_id c, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) n from conversations where conv_id is not null),
l as (select c, max(n) filter (role = 'assistant') i, max(n) top from t group by c),
ans as (select t.c, t.role, t.text from t join l on l.c = t.c and l.i = t.n),
side as (
  select t.c, 'c' side, n, role, text from t join l on l.c = t.c where n <= coalesce(i, top)
  union all select t.c, 'r', n, role, text from t join l on l.c = t.c where i is null or n < i
  union all select l.c, 'r', l.i, ans.role, ans.text from l join ans on ans.c = xor(l.c, 1) where l.i is not null),
pre as (
  select l.c, coalesce((select min(a.n) - 1 from side a left join side b on b.c = a.c and b.side = 'r' and b.n = a.n and b.role is not distinct from a.role and b.text is not distinct from a.text
     where a.c = l.c and a.side = 'c' and b.c is null),
     (select count(*) from side a where a.c = l.c and a.side = 'c')) k from l),
r as (
  select side.c, side, n, k, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) h, replace(coalesce(text, ''), '<|', '< |') b, role from side join pre on pre.c = side.c),
o as (
  select *, sum(case when n > k then length(h) + length(b) + 9 else 0 end) over (partition by c, side order by n) - 9 e, chr(10) || '<|end|>' || chr(10) z from r),
s as (
  select c, side, coalesce(string_agg(case when n > k then h || b || z end, '' order by n), '') txt,
   coalesce(string_agg(case when n <= k then h || b || z end, '' order by n), '') pr,
   coalesce(string_agg(case when n > k and role = 'assistant' and length(b) > 0 then cast(cast(e - length(b) as bigint) as varchar) || '-' || cast(cast(e as bigint) as varchar) end, ',' order by n), '') m
  from o group by c, side)
select pre.c pair_id, cast(k as bigint) n_prompt_turns, coalesce(x.pr, '') prompt, coalesce(x.txt, '') chosen, coalesce(x.m, '') chosen_mask, coalesce(y.txt, '') rejected, coalesce(y.m, '') rejected_mask
from pre left join s x on x.c = pre.c and x.side = 'c' left join s y on y.c = pre.c and y.side = 'r'
"""
