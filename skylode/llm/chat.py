"""Preference pairs: the shared beginning of two conversations once, and masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import scanned

#: Roles whose text a model is trained on.
LEARNED = ("assistant",)
ROW = "struct<turn:bigint,role:string,text:string>"


def _head(x: Column) -> Column:
    return F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    """Each turn as a header line, its text and a line end."""
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), x["text"], F.lit("\n"))), "")


def _mask(turns: str, learned: tuple[str, ...]) -> Column:
    """start:end of the learned turns' texts in the rendered completion, in code points, comma-joined."""
    begins, roles = "(s_.state + length(x.role) + 5)", ", ".join(f"'{r}'" for r in learned) or "null"  # a header is the role and five characters
    ends = f"({begins} + length(x.text))"
    span = f"if(x.role in ({roles}), concat_ws(':', {begins}, {ends}), null)"
    return F.array_join(F.expr(scanned(turns, "0L", f"{ends} + 1", span, "string"))["out"], ",")  # nulls are left out


def with_other_answers(turns: DataFrame, answering: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides (pair_id, turn, role, text) made of conversations (conv_id, turn, role, text) alone.

    Chosen is a conversation up to its last answer. Rejected is the same but for that answer, whose place takes the last answer of a neighbour, the conversation
    whose id differs in the last bit; a conversation without such a neighbour, or whose neighbour has no answer, has nothing there. A conversation without an answer is
    whole on both sides. Turns without a number come first. Of several answers with the last number the greatest text is the
    neighbour's. Rows with a null conv_id are left out. Last answers are found by a partial aggregate, neighbours by an equi-join.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = F.max(F.when((F.col("role") == answering) & F.col("turn").isNotNull(), F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    answers = rows.groupBy("pair_id").agg(last.alias("last"))
    placed = rows.join(answers.select("pair_id", F.col("last.turn").alias("until")), "pair_id")
    early = F.col("until").isNull() | F.col("turn").isNull()
    donors = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("text")).where("text is not null")
    other = answers.where("last is not null").join(donors, "pair_id").select("pair_id", F.col("last.turn").alias("turn"), F.lit(answering).alias("role"), "text")
    return placed.where(early | (F.col("turn") <= F.col("until"))).drop("until"), placed.where(early | (F.col("turn") < F.col("until"))).drop("until").unionByName(other)


def preference_pairs(chosen: DataFrame, rejected: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Rows (pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, n_chosen_turns, n_rejected_turns).

    Both inputs have (pair_id, turn, role, text), a row for each turn. The
    prompt is the longest run of first turns that are equal in role and text, rendered
    once; each completion renders the turns after it. The masks give the
    spans of a completion that are trained on. A pair with only one side has an
    empty prompt and a null completion on the other. Turns are ordered by
    (turn, role, text), nulls first, and repeated rows are turns of their own;
    the numbers of turns don't count for equality, only their order. Null roles
    and texts count as empty. Rows with a null pair_id are left out, and an empty side leaves the
    other side's pairs. One shuffle, by pair: a row holds one pair of conversations.
    """

    def side(turns: DataFrame, name: str) -> DataFrame:
        row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        return turns.select(F.col("pair_id").cast("long").alias("pair_id"), row.alias("row"), F.lit(name).alias("side"))

    rows = side(chosen, "chosen").unionByName(side(rejected, "rejected")).where("pair_id is not null")
    turns = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("row"))))
    pairs = rows.groupBy("pair_id").agg(turns("chosen").alias("c"), turns("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    pairs = pairs.withColumn("k", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda c: F.when(F.size(c) > F.col("k"), F.slice(c, F.col("k") + 1, F.size(c))).otherwise(F.expr(f"cast(array() as array<{ROW}>)"))
    pairs = pairs.withColumn("cc", rest("c")).withColumn("rr", rest("r"))
    there = lambda c, value: F.when(F.size(c) > 0, value)
    return pairs.select(
        "pair_id",
        F.col("k").cast("long").alias("n_prompt_turns"),
        F.when(F.col("k") > 0, _rendered(F.slice("c", F.lit(1), F.col("k")))).otherwise("").alias("prompt"),
        there("c", _rendered(F.col("cc"))).alias("chosen"),
        there("r", _rendered(F.col("rr"))).alias("rejected"),
        there("c", _mask("cc", learned)).alias("chosen_mask"),
        there("r", _mask("rr", learned)).alias("rejected_mask"),
        F.size("cc").cast("long").alias("n_chosen_turns"),
        F.size("rr").cast("long").alias("n_rejected_turns"),
    )


#: Each conversation against itself with a neighbour's last answer, see :func:`with_other_answers`.
ORACLE = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
     l AS (SELECT conv_id, turn AS last, max(coalesce(text, '')) AS answer FROM c WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id, turn QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)),
     s AS (SELECT c.*, 0 AS side FROM c LEFT JOIN l USING (conv_id) WHERE last IS NULL OR turn IS NULL OR turn <= last
           UNION ALL SELECT c.*, 1 FROM c LEFT JOIN l USING (conv_id) WHERE last IS NULL OR turn IS NULL OR turn < last
           UNION ALL SELECT l.conv_id, l.last, 'assistant', o.answer, 1 FROM l JOIN l o ON o.conv_id = xor(l.conv_id, 1)),
     t AS (SELECT conv_id AS pair_id, side, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM s),
     j AS (SELECT pair_id, n, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b,
                  coalesce(min(role) = max(role) AND min(text) = max(text) AND count(*) = 2, false) AS same FROM t GROUP BY pair_id, n),
     k AS (SELECT pair_id, coalesce(min(n) FILTER (NOT same) - 1, max(n)) AS k, sum(a) AS a, sum(b) AS b FROM j GROUP BY pair_id),
     x AS (SELECT t.*, k.k, '<|' || role || '|>' || chr(10) AS head FROM t JOIN k USING (pair_id)),
     y AS (SELECT *, coalesce(sum(length(head) + length(text) + 1) OVER (PARTITION BY pair_id, side, n > k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM x),
     z AS (SELECT pair_id, side, string_agg(head || text || chr(10), '' ORDER BY n) FILTER (n <= k) AS prompt, string_agg(head || text || chr(10), '' ORDER BY n) FILTER (n > k) AS rest,
                  string_agg(CAST(s AS VARCHAR) || ':' || CAST(s + length(text) AS VARCHAR), ',' ORDER BY n) FILTER (n > k AND role = 'assistant') AS mask, count(*) FILTER (n > k) AS turns FROM y GROUP BY pair_id, side)
SELECT k.pair_id, CAST(k.k AS BIGINT) AS n_prompt_turns, coalesce(c.prompt, '') AS prompt, CASE WHEN k.a > 0 THEN coalesce(c.rest, '') END AS chosen, CASE WHEN k.b > 0 THEN coalesce(r.rest, '') END AS rejected,
       CASE WHEN k.a > 0 THEN coalesce(c.mask, '') END AS chosen_mask, CASE WHEN k.b > 0 THEN coalesce(r.mask, '') END AS rejected_mask,
       CAST(coalesce(c.turns, 0) AS BIGINT) AS n_chosen_turns, CAST(coalesce(r.turns, 0) AS BIGINT) AS n_rejected_turns
FROM k LEFT JOIN z c ON c.pair_id = k.pair_id AND c.side = 0 LEFT JOIN z r ON r.pair_id = k.pair_id AND r.side = 1
"""
