"""Preference formatting: one prompt and two masked completions from two conversations.

The prompt is the longest common prefix of turns (same role, same text) of the
chosen and the rejected conversation, rendered once; what follows is rendered
for each.  A turn is rendered as "<|role|>\\n" + text + "\\n<|end|>\\n".  The mask
of a completion lists the character ranges [start, end) to learn from: the text
and end mark of each assistant turn.

DataFrame functions only.  A conversation's turns are put together in order of
turn, then role, then text; repeated turns stay.  A null turn sorts first, a null
role or text counts as "".  A conversation without an id is left out.  A pair
whose one side does not exist has an empty completion there.  Conversations that
are alike have them all as prompt and empty completions.  A conversation is one
row, however long.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: The marks around a turn.
OPEN, CLOSE, END = "<|", "|>\n", "\n<|end|>\n"
LEARN = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns array<struct<role,text>>."""
    item = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    return got.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common(a: Column, b: Column) -> Column:
    """How many turns the two begin with alike."""
    first_off = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first_off > 0, first_off - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """Character ranges of the assistant's texts and end marks within rendered(turns)."""
    head = lambda t: F.length(t["role"]) + F.lit(len(OPEN) + len(CLOSE))
    tail = lambda t: F.length(t["text"]) + F.lit(len(END))
    span = "struct<start:int,end:int>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + head(t)
        end = start + tail(t)
        mine = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == LEARN, F.concat(s["spans"], mine)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_turns(both: DataFrame, chosen: str, rejected: str, keep: list[str]) -> DataFrame:
    """The columns in keep, n_common, prompt, and text and mask of both completions, of two columns of turns (null: none)."""
    empty = F.array().cast(both.schema[chosen].dataType)
    c, r = F.coalesce(chosen, empty), F.coalesce(rejected, empty)
    x = both.select(*keep, c.alias("_c"), r.alias("_r")).withColumn("n_common", common(F.col("_c"), F.col("_r")))
    rest = lambda t: F.slice(t, F.col("n_common") + 1, F.greatest(F.size(t) - F.col("n_common"), F.lit(0)))
    x = x.withColumns({"_pc": rest(F.col("_c")), "_pr": rest(F.col("_r"))})
    return x.select(
        *keep, "n_common", rendered(F.slice("_c", F.lit(1), F.col("n_common"))).alias("prompt"),
        rendered(F.col("_pc")).alias("chosen"), mask(F.col("_pc")).alias("chosen_mask"), rendered(F.col("_pr")).alias("rejected"), mask(F.col("_pr")).alias("rejected_mask"),
    )


def format_pairs(pairs: DataFrame, convs: DataFrame) -> DataFrame:
    """pairs (chosen_id, rejected_id) -> n_common, prompt, and text and mask of both completions."""
    c = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("_c"))
    r = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("_r"))
    both = pairs.select("chosen_id", "rejected_id").join(c, "chosen_id", "left").join(r, "rejected_id", "left")
    return format_turns(both.toDF("rejected_id", "chosen_id", "c", "r"), "c", "r", ["chosen_id", "rejected_id"])


def ranked(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
    """rows with rank (0, 1, .. in order of key), and their number; ranks are worked out within range parts of about `most` rows and moved by what the parts before hold."""
    n = rows.count()
    parts = written(rows.repartitionByRange(max(1, -(-n // most)), key).withColumn("part", F.spark_partition_id()))
    earlier = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = parts.groupBy("part").count().withColumn("before", earlier).select("part", "before")
    at = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return parts.withColumn("at", at).join(F.broadcast(before), "part").withColumn("rank", F.col("at") + F.col("before")).drop("part", "at", "before"), n


def other_answers(convs: DataFrame, most: int = 1 << 16) -> DataFrame:
    """(chosen_id, rejected_id, c, r): each conversation c that has an answer, and r, the same with its last answer replaced by that of the next such conversation in order of id (after the last comes the first)."""
    back = F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == LEARN), True)
    own = convs.withColumn("last", (F.size("turns") - back + 1).cast("int")).where(back > 0)
    heads, n = ranked(own.select("conv_id", F.element_at("turns", F.col("last"))["text"].alias("answer")), "conv_id", most)
    if n < 2:
        own, n = own.limit(0), 1
    donors = heads.select(F.pmod(F.col("rank") - 1, F.lit(n)).alias("rank"), F.col("conv_id").alias("rejected_id"), "answer")
    x = heads.select("conv_id", "rank").join(donors, "rank").select("conv_id", "rejected_id", "answer").join(own, "conv_id")
    changed = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("last"), F.struct(t["role"].alias("role"), F.col("answer").alias("text"))).otherwise(t))
    return x.select(F.col("conv_id").alias("chosen_id"), "rejected_id", F.col("turns").alias("c"), changed.alias("r"))


def same_opening(convs: DataFrame, most: int = 1 << 16) -> DataFrame:
    """Pairs of conversations that open with the same turn: neighbours in order of id, each in one pair; the last of an odd number has no partner (null).

    Ids are ranked within range parts of about `most` rows, and what the parts
    before hold of an opening is added, so no task holds all of a hot opening.
    """
    heads = convs.select("conv_id", F.xxhash64(F.coalesce(F.col("turns")[0]["role"], F.lit("")), F.coalesce(F.col("turns")[0]["text"], F.lit(""))).alias("h"))
    parts = max(1, -(-convs.count() // most))
    ranged = written(heads.repartitionByRange(parts, "h", "conv_id").withColumn("part", F.spark_partition_id()))
    earlier = F.sum("count").over(W.partitionBy("h").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # Only the first opening of a part can go on from parts before: at most a row a part.
    before = ranged.groupBy("h", "part").count().withColumn("before", earlier).where("before > 0").select("h", "part", "before")
    at = F.row_number().over(W.partitionBy("h", "part").orderBy("conv_id")) - 1
    rows = ranged.withColumn("at", at).join(F.broadcast(before), ["h", "part"], "left").withColumn("at", F.col("at") + F.coalesce("before", F.lit(0)))
    side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("conv_id")))
    return rows.groupBy("h", F.floor(F.col("at") / 2).alias("k")).agg(side(0).alias("chosen_id"), side(1).alias("rejected_id")).select("chosen_id", "rejected_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another's last answer (kind answer), and conversations that open alike in pairs (kind opening)."""
    convs = written(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    keep = ["kind", "chosen_id", "rejected_id"]
    answers = format_turns(other_answers(convs).withColumn("kind", F.lit("answer")), "c", "r", keep)
    openings = format_pairs(same_opening(convs).where("rejected_id is not null"), convs).withColumn("kind", F.lit("opening"))
    out = answers.unionByName(openings)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select(*keep, "n_common", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask"))


SQL = """
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, row_number() OVER w - 1 AS place, lead(conv_id) OVER w AS other
  FROM c WINDOW w AS (PARTITION BY turns[1].role, turns[1].text ORDER BY conv_id)
), p AS (SELECT conv_id AS chosen_id, other AS rejected_id FROM h WHERE place % 2 = 0 AND other IS NOT NULL
), l AS (
  SELECT conv_id, turns, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM c
), d AS (
  SELECT conv_id, turns, last, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS other, coalesce(lead(turns[last].text) OVER w, first_value(turns[last].text) OVER w) AS answer
  FROM l WHERE last IS NOT NULL WINDOW w AS (ORDER BY conv_id)
), b AS (
  SELECT 'opening' AS kind, chosen_id, rejected_id, x.turns AS ct, y.turns AS rt
  FROM p JOIN c x ON x.conv_id = chosen_id JOIN c y ON y.conv_id = rejected_id
  UNION ALL
  SELECT 'answer', conv_id, other, turns, list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN i = last THEN struct_pack(role := 'assistant', text := answer) ELSE turns[i] END)
  FROM d WHERE other <> conv_id
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(ct), len(rt)) + 1), lambda i: ct[i] <> rt[i])) - 1, least(len(ct), len(rt))) AS k FROM b
), s AS (
  SELECT kind, chosen_id, rejected_id, k, ct[1:k] AS pt, ct[k + 1:] AS c2, rt[k + 1:] AS r2 FROM n
), t AS (
  SELECT *, list_transform(pt, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)) AS ps,
    list_transform(c2, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)) AS cs,
    list_transform(r2, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)) AS rs FROM s
), u AS (
  SELECT *, list_transform(range(1, len(cs) + 1), lambda i: coalesce(list_sum(list_transform(cs[1:i], lambda z: length(z))), 0)::BIGINT) AS ce,
    list_transform(range(1, len(rs) + 1), lambda i: coalesce(list_sum(list_transform(rs[1:i], lambda z: length(z))), 0)::BIGINT) AS re FROM t
)
SELECT kind, chosen_id, rejected_id, k::INTEGER AS n_common, array_to_string(ps, '') AS prompt, array_to_string(cs, '') AS chosen, array_to_string(rs, '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(c2) + 1), lambda i: c2[i].role = 'assistant'), lambda i: (ce[i] - length(c2[i].text) - 9)::VARCHAR || '-' || ce[i]::VARCHAR), ',') AS chosen_mask,
  array_to_string(list_transform(list_filter(range(1, len(r2) + 1), lambda i: r2[i].role = 'assistant'), lambda i: (re[i] - length(r2[i].text) - 9)::VARCHAR || '-' || re[i]::VARCHAR), ',') AS rejected_mask
FROM u
"""
