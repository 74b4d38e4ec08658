r"""Quotation linking for chats (DataFrame functions only).

A line's quote level is the number of '>' it starts with, blanks aside. Consecutive quoted lines of one level form a
passage. Passages and their lines are normalised (markers off, lower case, blanks folded) and hashed; the unquoted
bodies, paragraphs and lines of the messages of the same conversation are hashed likewise. A quoted unit points at the
latest earlier message that has it; a message replies to the one that its units point at with most characters, the
later one among equals. Messages are ordered by the root of their thread and then by turn, so each follows the one it
replies to. Texts come without quoted lines and without an attribution line ("... wrote:") just before a quote.

The latest earlier message is found by a running maximum inside stretches of turns and a carry between stretches, so
neither a long conversation nor an often repeated text is gathered or paired up.

Defined cases: null and empty texts have no quotes; a null conversation is one of its own; a message with a null turn
neither replies nor is replied to; messages that share conversation and turn are one place in the order and share a
reply (the latest of theirs); a quote that no earlier message has leaves no link; an empty table gives an empty result.
Extra columns are kept; one named as an output (quoted_lines, quote_level, reply_to, root_turn, depth) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_names, materialise, read

MARK = r"^(?:[ \t]*>)+"
WROTE = r"(?i)^[ \t]*\S.{0,200} wrote:[ \t]*$"
STRETCH = 8  #: bits of a turn number that are handled together


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and the attributions before them."""
    lines = F.split(text, "\n")
    keep = F.filter(lines, lambda x, i: (level(x) == 0) & ~(x.rlike(WROTE) & (F.coalesce(level(F.get(lines, i + 1)), F.lit(0)) > 0)))
    return F.array_join(keep, "\n")


def quoted_units(messages: DataFrame) -> DataFrame:
    """conv, turn, h (hash) and n (characters) of the quoted passages and lines."""
    rows = messages.where(F.col("text").rlike(r"(?m)" + MARK)).select("conv", "turn", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("conv", "turn", "th", "pos", level(F.col("line")).alias("level"), F.regexp_replace("line", MARK, "").alias("line")).where("level > 0")
    # within one message: consecutive positions of one level have the same difference to their rank
    island = F.col("pos") - F.row_number().over(Window.partitionBy("conv", "turn", "th", "level").orderBy("pos"))
    lines = rows.withColumn("island", island)
    passages = lines.groupBy("conv", "turn", "th", "level", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p"))
    whole = passages.select("conv", "turn", normalised(F.array_join(F.transform("p", lambda x: x["line"]), "\n")).alias("u"))
    units = whole.union(lines.select("conv", "turn", normalised(F.col("line")).alias("u"))).where("u <> ''")
    return units.select("conv", "turn", F.xxhash64("u").alias("h"), F.length("u").alias("n"))


def original_units(messages: DataFrame) -> DataFrame:
    """conv, turn, h of the bodies, paragraphs and lines that messages wrote themselves."""
    own = unquoted(F.col("text"))
    parts = F.array_distinct(F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n")))
    rows = messages.where("turn is not null and text is not null").select("conv", "turn", F.explode(parts).alias("u"))
    return rows.select("conv", "turn", normalised(F.col("u")).alias("u")).where("u <> ''").select("conv", "turn", F.xxhash64("u").alias("h")).distinct()


def latest_before(asks: DataFrame, facts: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The asks with `found`, the greatest `at` of a fact of the same keys that is smaller than theirs."""
    both = facts.select(*keys, at, F.lit(0).alias("ask"), F.lit(0).alias("n")).union(asks.select(*keys, at, F.lit(1), "n")).withColumn("part", F.shiftright(at, STRETCH))
    tops = facts.groupBy(*keys, F.shiftright(at, STRETCH).alias("part")).agg(F.max(at).alias("top"))
    wanted = asks.select(*keys, F.shiftright(at, STRETCH).alias("part"), F.lit(None).cast("long").alias("top")).distinct()
    carry = tops.union(wanted).groupBy(*keys, "part").agg(F.max("top").alias("top"))
    carry = carry.select(*keys, "part", F.max("top").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inside = Window.partitionBy(*keys, "part").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("inside", F.max(F.when(F.col("ask") == 0, F.col(at))).over(inside)).where("ask = 1")
    return near.join(carry, [*keys, "part"], "left").select(*keys, at, "n", F.coalesce("inside", "carry").alias("found")).where("found is not null")


def threads(links: DataFrame) -> DataFrame:
    """conv, turn, root_turn, depth for places that reply (links: conv, turn, reply_to), by pointer doubling."""
    now = materialise(links.select("conv", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth"), F.lit(False).alias("done")))
    while not now.where("not done").isEmpty():
        higher = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("done").alias("end"))
        step = now.join(higher, ["conv", "up"], "left")
        now = materialise(step.select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce(F.col("end"), F.lit(True)).alias("done")))
    return now.select("conv", "turn", F.col("up").alias("root_turn"), "depth")


def link_quotes(messages: DataFrame, *, conv="conv_id", turn="turn", text="text") -> DataFrame:
    """The messages, their text without quotes, with quoted_lines, quote_level, reply_to, root_turn and depth.

    Ordered by (conv, root_turn, turn) they are the reply-ordered conversations.
    """
    messages = messages.drop(*({c for c in messages.columns if c.lower() in ("quoted_lines", "quote_level", "reply_to", "root_turn", "depth")} - {conv, turn, text}))
    rows = messages.select(F.coalesce(F.xxhash64(F.when(F.col(conv).isNotNull(), F.col(conv).cast("string"))), F.lit(0)).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text"))
    quoted = materialise(quoted_units(rows.where("turn is not null")))
    wanted = original_units(rows).join(quoted.select("conv", "h").distinct(), ["conv", "h"], "left_semi")
    points = latest_before(quoted, wanted, ["conv", "h"], "turn").groupBy("conv", "turn", "found").agg(F.sum("n").alias("n"))
    links = materialise(points.groupBy("conv", "turn").agg(F.max(F.struct("n", "found"))["found"].alias("reply_to")))
    mine, c, t = free_names(messages, "_key", "_conv", "_turn")
    placed = links.join(threads(links), ["conv", "turn"]).withColumnsRenamed({"conv": c, "turn": t})
    levels = F.transform(F.split(text, "\n"), level)
    out = messages.withColumns({
        "quoted_lines": F.coalesce(F.size(F.filter(levels, lambda x: x > 0)), F.lit(0)),
        "quote_level": F.coalesce(F.array_max(levels), F.lit(0)),
        mine: F.coalesce(F.xxhash64(F.when(F.col(conv).isNotNull(), F.col(conv).cast("string"))), F.lit(0)),
        text: F.when(F.col(text).rlike(r"(?m)" + MARK), unquoted(F.col(text))).otherwise(F.col(text)),
    })
    out = out.withColumn("quoted_lines", F.greatest("quoted_lines", F.lit(0)))
    joined = out.join(placed, (F.col(mine) == F.col(c)) & (F.col(turn) == F.col(t)), "left")
    return joined.withColumns({"root_turn": F.coalesce("root_turn", F.col(turn).cast("long")), "depth": F.coalesce("depth", F.lit(0))}).drop(mine, c, t)


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text", "quoted_lines", "quote_level", "reply_to", "root_turn", "depth")


OP2_SQL = r"""
with recursive
m as (select *, coalesce(conv_id::varchar, '') || (conv_id is null)::varchar as k, row_number() over () as id from conversations),
l as (select id, k, turn, unnest(str_split(text, chr(10))) as line, generate_subscripts(str_split(text, chr(10)), 1) as pos from m),
v as (select *, len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) as lev, regexp_replace(line, '^(?:[ \t]*>)+', '') as body from l),
f as (select *, lev = 0 and not (regexp_full_match(line, '(?i)[ \t]*\S.{0,200} wrote:[ \t]*') and coalesce(lead(lev) over (partition by id order by pos), 0) > 0) as own from v),
t as (select id, any_value(k) as k, any_value(turn) as turn, coalesce(string_agg(line, chr(10) order by pos) filter (own), '') as own, count(*) filter (lev > 0) as quoted_lines, max(lev) as quote_level from f group by id),
i as (select *, pos - row_number() over (partition by id, lev order by pos) as isl from v where lev > 0),
q as (select k, turn, string_agg(body, chr(10) order by pos) as u from i where turn is not null group by id, k, turn, lev, isl union all select k, turn, body from i where turn is not null),
qn as (select k, turn, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) as u from q),
o as (select k, turn, own as u from t union all select k, turn, unnest(regexp_split_to_array(own, '\n\s*\n')) from t union all select k, turn, unnest(str_split(own, chr(10))) from t),
n as (select distinct k, turn, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) as u from o where turn is not null),
p as (select q.k, q.turn, len(q.u) as n, (select max(n.turn) from n where n.k = q.k and n.u = q.u and n.turn < q.turn) as found from qn q where q.u <> ''),
s as (select k, turn, found, sum(n) as n from p where found is not null group by all),
r as (select k, turn, arg_max(found, (n, found)) as reply_to from s group by all),
c as (select k, turn, reply_to as up, 1 as depth from r union all select c.k, c.turn, r.reply_to, c.depth + 1 from c join r on r.k = c.k and r.turn = c.up),
d as (select k, turn, arg_max(up, depth) as root_turn, max(depth) as depth from c group by all)
select conv_id, m.turn, role, case when coalesce(quoted_lines, 0) > 0 then t.own else text end as text, coalesce(quoted_lines, 0)::int as quoted_lines, coalesce(quote_level, 0)::int as quote_level,
       reply_to, coalesce(root_turn, m.turn) as root_turn, coalesce(depth, 0)::int as depth
from m left join t using (id) left join r on r.k = m.k and r.turn = m.turn left join d on d.k = m.k and d.turn = m.turn
"""
