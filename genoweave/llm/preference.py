"""Preference formatting: a shared prompt and two masked completions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written, and the role that is trained on.
TURN = ("<|", "|>\n", "\n<|end|>\n")
TRAINED_ROLE = "assistant"


def _escaped(text: Column) -> Column:
    """Null as empty; '<|' as '<||', so that no text can hold a mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(TURN[0]), _escaped(turn["role"]), F.lit(TURN[1]), _escaped(turn["text"]), F.lit(TURN[2]))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and ``turns`` (turn, role, text) in order of turn, then role, then text."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return conversations.where("conv_id is not null").groupBy("conv_id").agg(turns.alias("turns"))


def _prefix_length(a: Column, b: Column) -> Column:
    """How many turns both lists have in common from the start, by role and text."""
    shorter = F.least(F.size(a), F.size(b))
    same = lambda i: F.element_at(a, i)["role"].eqNullSafe(F.element_at(b, i)["role"]) & F.element_at(a, i)["text"].eqNullSafe(F.element_at(b, i)["text"])
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    differing = F.filter(places, lambda i: ~same(i))
    return F.when(F.size(differing) > 0, F.element_at(F.slice(differing, 1, 1), 1) - 1).otherwise(shorter)


def _tail(turns: Column, n: Column) -> Column:
    return F.when(F.size(turns) > n, F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(1)))).otherwise(F.filter(turns, lambda _: F.lit(False)))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """The turns of a completion as (chars, trained): lengths of its rendered stretches and whether they count in the loss."""
    return F.transform(turns, lambda t: F.struct(F.char_length(_rendered(t)).cast("long").alias("chars"), (F.coalesce(t["role"], F.lit("")) == TRAINED_ROLE).alias("trained")))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From (pair_id, chosen, rejected), two lists of turns: prompt, both completions and their masks.

    The prompt is the longest run of leading turns that both sides share by role and
    text, rendered once. A completion is the rest of its side; its mask lists the
    rendered length of each turn and whether it is trained on (the assistant's are).
    A missing side has no turns, so the prompt is empty and its completion too. Null
    roles and texts render as empty and equal each other. Equal sides leave two
    empty completions.
    """
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    sides = pairs.withColumn("chosen", F.coalesce("chosen", none)).withColumn("rejected", F.coalesce("rejected", none))
    n = sides.withColumn("n_shared", _prefix_length(F.col("chosen"), F.col("rejected")))
    n = n.withColumn("prompt", _text(F.when(F.col("n_shared") > 0, F.slice("chosen", 1, F.greatest("n_shared", F.lit(1)))).otherwise(F.filter("chosen", lambda _: F.lit(False)))))
    n = n.withColumn("__c", _tail(F.col("chosen"), F.col("n_shared"))).withColumn("__r", _tail(F.col("rejected"), F.col("n_shared")))
    return n.select(
        "pair_id",
        "n_shared",
        "prompt",
        _text(F.col("__c")).alias("chosen"),
        _text(F.col("__r")).alias("rejected"),
        _mask(F.col("__c")).alias("chosen_mask"),
        _mask(F.col("__r")).alias("rejected_mask"),
    )


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as one pair k; a missing one is null.

    Pairs come from one aggregation by conversation and one by pair, so a first turn
    that many conversations share has no group of its own. Rows without a
    conversation id belong to none and are left out.
    """
    lists = turn_lists(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    even = F.pmod("conv_id", F.lit(2)) == 0
    return lists.groupBy(F.expr("cast((conv_id - pmod(conv_id, 2)) div 2 as bigint)").alias("pair_id")).agg(
        F.first(F.when(even, F.col("turns")), ignorenulls=True).alias("chosen"),
        F.first(F.when(~even, F.col("turns")), ignorenulls=True).alias("rejected"),
    )


def trained_chars(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + F.when(m["trained"], m["chars"]).otherwise(0))


def mask_text(mask: Column) -> Column:
    """A mask as text: the length of each stretch, ':' and 1 where it is trained on or 0, parted by commas."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["chars"].cast("string"), F.lit(":"), m["trained"].cast("int").cast("string"))), ",")


def preference_report(conversations: DataFrame) -> DataFrame:
    """Per pair: pair_id, n_shared, the three texts, both masks, and how many characters of each completion are trained on."""
    out = format_pairs(neighbouring_pairs(conversations))
    return out.select(
        "pair_id",
        F.col("n_shared").cast("long").alias("n_shared"),
        "prompt",
        "chosen",
        "rejected",
        mask_text(F.col("chosen_mask")).alias("chosen_mask"),
        mask_text(F.col("rejected_mask")).alias("rejected_mask"),
        trained_chars(F.col("chosen_mask")).alias("chosen_trained"),
        trained_chars(F.col("rejected_mask")).alias("rejected_trained"),
    )


PREFERENCE_SQL = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k,
    role, text, '<|' || replace(coalesce(role, ''), '<|', '<||') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<||') || chr(10) || '<|end|>' || chr(10) as shown
    from conversations where conv_id is not null),
c as (select conv_id // 2 as pair_id, * from t where conv_id % 2 = 0),
r as (select (conv_id - (conv_id % 2 + 2) % 2) // 2 as pair_id, * from t where conv_id % 2 <> 0),
ids as (select pair_id from c union select pair_id from r),
agree as (select pair_id, k, bool_and(same) over (partition by pair_id order by k) as so_far from (
    select c.pair_id, c.k, c.role is not distinct from r.role and c.text is not distinct from r.text as same
    from c join r on c.pair_id = r.pair_id and c.k = r.k)),
n as (select ids.pair_id, coalesce((select count(*) from agree a where a.pair_id = ids.pair_id and a.so_far), 0) as n from ids),
cs as (select n.pair_id, coalesce(string_agg(shown, '' order by k) filter (k <= n), '') as prompt,
    coalesce(string_agg(shown, '' order by k) filter (k > n), '') as chosen,
    coalesce(string_agg(length(shown) || ':' || (coalesce(role, '') = 'assistant')::int, ',' order by k) filter (k > n), '') as cm,
    coalesce(sum(length(shown)) filter (k > n and role = 'assistant'), 0) as ct
    from n left join c on c.pair_id = n.pair_id group by n.pair_id),
rs as (select n.pair_id, coalesce(string_agg(shown, '' order by k) filter (k > n), '') as rejected,
    coalesce(string_agg(length(shown) || ':' || (coalesce(role, '') = 'assistant')::int, ',' order by k) filter (k > n), '') as rm,
    coalesce(sum(length(shown)) filter (k > n and role = 'assistant'), 0) as rt
    from n left join r on r.pair_id = n.pair_id group by n.pair_id)
select n.pair_id, n.n::bigint as n_shared, cs.prompt, cs.chosen, rs.rejected, cs.cm as chosen_mask, rs.rm as rejected_mask, cs.ct::bigint as chosen_trained, rs.rt::bigint as rejected_trained
from n join cs on cs.pair_id = n.pair_id join rs on rs.pair_id = n.pair_id
"""
