"""Quotation linking in conversations, of DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The marks at a line's start: one > for each level, with blanks around.
MARKS = r"^([ \t]*>)+[ \t]?"
#: Rounds of root finding, each of which doubles the distance; a thread deeper than 2^40 can't be.
ROUNDS = 40


def _normal(text: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s]+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with __lines: (level, content) of each line of its text; and __runs: (level, content) of each stretch of lines of one level.

    Index arithmetic on arrays keeps it linear in the number of lines, however long a text is.
    """
    marks = lambda line: F.regexp_extract(line, MARKS, 0)
    line = lambda x: F.struct((F.length(marks(x)) - F.length(F.regexp_replace(marks(x), ">", ""))).alias("level"), F.regexp_replace(x, MARKS, "").alias("content"))
    lined = messages.withColumn("__lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line))
    starts = lined.withColumn("__starts", F.expr("filter(sequence(0, size(__lines) - 1), i -> i = 0 or __lines[i].level <> __lines[i - 1].level)"))
    runs = F.expr("transform(__starts, (s, k) -> named_struct('level', __lines[s].level, 'content', array_join(transform(slice(__lines, s + 1, coalesce(get(__starts, k + 1), size(__lines)) - s), l -> l.content), '\n')))")
    return starts.withColumn("__runs", runs).drop("__starts")


def _paragraphs(text: Column) -> Column:
    return F.split(text, r"\n[ \t]*\n", -1)


def _hash(text: Column) -> Column:
    return F.md5(_normal(text))


def _pieces(text: Column) -> Column:
    """(at, kind, hash, n) of the whole text (at -1, kind 0), of its paragraphs (kind 1) and of their distinct lines (kind 2), with the number of the paragraph's lines."""
    piece = lambda at, kind, of, n: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), of.alias("hash"), n.cast("int").alias("n"))
    said = lambda x: _normal(x) != ""
    lines = lambda p: F.array_distinct(F.transform(F.filter(F.split(p, "\n", -1), said), _hash))
    paragraphs = F.transform(F.filter(_paragraphs(text), said), lambda p: F.struct(_hash(p).alias("hash"), lines(p).alias("lines")))
    each = F.transform(paragraphs, lambda p, k: piece(k, 1, p["hash"], F.size(p["lines"])))
    every = F.flatten(F.transform(paragraphs, lambda p, k: F.transform(p["lines"], lambda h: piece(k, 2, h, F.size(p["lines"])))))
    return F.concat(F.array(piece(F.lit(-1), 0, _hash(text), F.lit(0))), each, every)


def originals(lined: DataFrame) -> DataFrame:
    """(conv_id, hash, first_turn): the passages that a message says itself, unquoted: its whole body, each stretch between quotes, each paragraph of these and each line; the first message of a conversation that says one is its original."""
    own = lined.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.expr("filter(__runs, r -> r.level = 0)").alias("own"))
    body = F.array_join(F.transform("own", lambda r: r["content"]), "\n")
    stretches = F.transform("own", lambda r: r["content"])
    said = F.concat(F.array(body), stretches, _paragraphs(body), F.split(body, "\n", -1), F.flatten(F.transform("own", lambda r: _paragraphs(r["content"]))))
    said = own.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(said, _normal))).alias("said")).where("said <> ''")
    return said.groupBy("conv_id", F.md5("said").alias("hash")).agg(F.min("turn").alias("first_turn"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, thread_root, depth, n_quotes, n_linked, body) of every message.

    Lines that begin with > marks are quotes, one level for each mark. A stretch of lines of one level is a passage; its
    normalised text's hash is joined to those of what messages of the conversation say themselves (bodies, stretches between quotes, paragraphs, lines), and its
    original is the first that says it, if that comes earlier; a passage without one whose paragraphs all have originals,
    themselves or line by line, has the latest of these. A message
    replies to the latest original of its least deep linked passages; without any it starts a thread. body is the text without its quoted lines and without white space at its ends. Ordered by
    conv_id, thread_root and turn, every message comes after the one it replies to.

    Null texts have an empty body; messages with a null conv_id or turn link nothing and have a null thread_root where turn is null. Rows that repeat conv_id and turn
    share their links and stay as many. Other columns are ignored. No message's text is shuffled to find links: only hashes are, after
    one row for each conversation and hash is left; no conversation is gathered in one task.
    """
    picked = conversations.select(*(F.col(f"`{c}`") for c in ("conv_id", "turn", "role", "text")))
    lined = parsed(picked)
    quoted = lined.where("exists(__runs, r -> r.level > 0) and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.expr("filter(__runs, r -> r.level > 0)")).alias("run"))
    quoted = quoted.select("conv_id", "turn", F.col("run.level").alias("level"), F.md5(F.col("run.content")).alias("raw"), _hash(F.col("run.content")).alias("whole"), _pieces(F.col("run.content")).alias("pieces"))
    pieces = quoted.select("conv_id", "turn", "level", "raw", "whole", F.expr("size(filter(pieces, p -> p.kind = 1))").alias("n"), F.explode("pieces").alias("piece")).select("*", F.col("piece.hash").alias("hash"))
    found = pieces.join(originals(lined), ["conv_id", "hash"]).where("first_turn < turn")
    first = lambda kind: F.max(F.when(F.col("piece.kind") == kind, F.col("first_turn")))
    lines = F.when(F.countDistinct(F.when(F.col("piece.kind") == 2, F.col("hash"))) == F.max("piece.n"), first(2))
    by_paragraph = found.groupBy("conv_id", "turn", "level", "raw", "whole", "n", F.col("piece.at").alias("at")).agg(first(0).alias("all"), F.coalesce(first(1), lines).alias("part"))
    by_parts = F.when(F.count("part") == F.max("n"), F.max("part"))
    passages = by_paragraph.groupBy("conv_id", "turn", "level", "raw", "whole").agg(F.coalesce(F.max("all"), by_parts).alias("first_turn")).where("first_turn is not null")
    links = passages.groupBy("conv_id", "turn").agg(F.countDistinct("whole").alias("n_linked"), F.min(F.struct("level", (-F.col("first_turn")).alias("earlier"))).alias("best"))
    links = cut(links.select("conv_id", "turn", "n_linked", (-F.col("best.earlier")).cast("long").alias("reply_to")), "replies")
    placed = _roots(links)
    body = F.regexp_replace(F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")
    rows = lined.select("conv_id", "turn", "role", F.size(F.expr("filter(__runs, r -> r.level > 0)")).cast("long").alias("n_quotes"), body.alias("body"))
    return rows.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread_root", "turn").cast("long").alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body"
    )


def _roots(links: DataFrame) -> DataFrame:
    """links with thread_root and depth, by pointer jumping: a message's pointer moves to its ancestor's pointer."""
    at = links.select("conv_id", "turn", "reply_to", "n_linked", F.col("reply_to").alias("thread_root"), F.lit(1).cast("long").alias("depth"))
    for _ in range(ROUNDS):
        above = at.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("up"), F.col("depth").alias("more"))
        moved = at.join(above, ["conv_id", "thread_root"], "left")
        if moved.where("up is not null").isEmpty():
            return at
        at = cut(moved.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("up", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")
    raise RuntimeError("replies go round in a circle")


#: The same in SQL, by exploded lines and a recursive walk.
SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
p AS (SELECT conv_id, turn, i, len(regexp_extract(line, '^([ \t]*>)+[ \t]?')) - len(replace(regexp_extract(line, '^([ \t]*>)+[ \t]?'), '>', '')) AS level,
             regexp_replace(line, '^([ \t]*>)+[ \t]?', '') AS content FROM l),
f AS (SELECT *, CASE WHEN lag(level) OVER w = level THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM f),
r AS (SELECT conv_id, turn, run, any_value(level) AS level, string_agg(content, chr(10) ORDER BY i) AS content FROM g GROUP BY ALL),
b AS (SELECT conv_id, turn, coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0), '') AS body FROM p GROUP BY ALL),
s AS (SELECT conv_id, turn, body AS said FROM b
      UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(body, '\n[ \t]*\n')) FROM b
      UNION ALL SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM b),
o AS (SELECT conv_id, lower(trim(regexp_replace(said, '\s+', ' ', 'g'))) AS said, min(turn) AS first_turn FROM s GROUP BY ALL),
k AS (SELECT r.conv_id, r.turn, r.level, o.first_turn, o.said FROM r JOIN o ON r.conv_id = o.conv_id AND lower(trim(regexp_replace(r.content, '\s+', ' ', 'g'))) = o.said
      WHERE r.level > 0 AND o.said <> '' AND o.first_turn < r.turn),
n AS (SELECT conv_id, turn, count(DISTINCT said) AS n_linked, -(min(struct_pack(a := level, z := -first_turn)).z) AS reply_to FROM k GROUP BY ALL),
t AS (SELECT conv_id, turn, reply_to AS up, 1 AS depth FROM n UNION ALL SELECT t.conv_id, t.turn, n.reply_to, t.depth + 1 FROM t JOIN n ON n.conv_id = t.conv_id AND n.turn = t.up),
q AS (SELECT conv_id, turn, max_by(up, depth) AS thread_root, max(depth) AS depth FROM t GROUP BY ALL),
c AS (SELECT conv_id, turn, count(*) AS n_quotes FROM r WHERE level > 0 GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, n.reply_to::BIGINT AS reply_to, coalesce(q.thread_root, m.turn)::BIGINT AS thread_root, coalesce(q.depth, 0)::BIGINT AS depth,
       coalesce(c.n_quotes, 0)::BIGINT AS n_quotes, coalesce(n.n_linked, 0)::BIGINT AS n_linked, regexp_replace(b.body, '^\s+|\s+$', '', 'g') AS body
FROM m JOIN b USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn) LEFT JOIN q USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn)
"""
