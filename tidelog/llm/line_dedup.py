"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

The lines of a text that hold a word form its sequence; blank lines are not compared. A window
starts at each of them and ends where it holds ``min_words`` words, so its width follows the text:
one long line, or several short ones. The smallest line hash of a window is its fingerprint, and the places of these minima are what
is selected of a text, one row for each. Two texts that share a run of lines with ``min_words`` words are certain
to select the same fingerprint in it.

Places whose fingerprint the corpus selects only once are dropped. The others meet on their fingerprint and are extended both ways: every window that owns the
place, from those that end with it to those that begin with it, is compared with the first equal window of the corpus, and from the end of an
equal window the match goes on to the right, line by line, as long as lines equal those behind the first window and hold, with
the window's lines but its first, fewer than ``min_words`` words (with as many, they end a window of their own). A window with an earlier equal (smaller
doc_id, then smaller line) marks its lines and those that it is extended by, and marked lines are deleted.

Only hashes and positions are shuffled until the end; no two occurrences are ever paired, so a line
that a third of the corpus shares costs a minimum, which is taken before the shuffle.

Defined results: a null text stays null, with no lines; an empty text has one blank line; ends of a
text with fewer than ``min_words`` words stay, but for such extensions; a row repeated under the same doc_id counts as one
document; a null doc_id is earlier than all others. Blank lines between deleted lines of a match go too. Texts of any length are compared whole; other
columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import keep, same_row, table, text_hash

MIN_WORDS = 8

#: Of each worded line: the window that starts there.
_WINDOWS = """
transform(units, (u, i) -> aggregate(
  slice(units, i + 1, {t}),
  named_struct('words', 0, 'pos', u.pos, 'last', u.pos, 'fp', u.h, 'fp_pos', u.pos, 'a', 17L, 'b', 29, 'own', u.words, 'next', i),
  (s, x) -> if(s.words >= {t}, s, named_struct(
    'words', s.words + x.words,
    'pos', s.pos,
    'last', x.pos,
    'fp', least(s.fp, x.h),
    'fp_pos', if(x.h < s.fp, x.pos, s.fp_pos),
    'a', xxhash64(s.a, x.h),
    'b', hash(s.b, x.g),
    'own', s.own,
    'next', s.next + 1))))
"""
#: The lines behind a window that hold, with its lines but the first, fewer words than a window.
_TAIL = """
aggregate(
  if(coalesce(get(units, w.next).words, {t}) + w.words - w.own >= {t}, slice(units, 1, 0), slice(units, w.next + 1, {t})),
  named_struct('words', w.words - w.own, 'lines', cast(array() AS array<struct<h: bigint, pos: int>>)),
  (s, x) -> named_struct(
    'words', s.words + x.words,
    'lines', if(s.words + x.words < {t}, array_append(s.lines, named_struct('h', x.h, 'pos', x.pos)), s.lines)),
  s -> s.lines)
"""


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, units (the worded lines) and ws (the whole windows) of each text."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", text_hash().alias("th"), F.split("text", "\n", -1).alias("lines"))
    units = lines.select(
        "doc_id",
        "th",
        F.expr(
            "filter(transform(lines, (x, i) -> named_struct('pos', i, 'words', regexp_count(x, '\\\\S+'), 'h', xxhash64(x), 'g', hash(x))), u -> u.words > 0)"
        ).alias("units"),
    )
    return units.withColumn("ws", F.expr(f"filter({_WINDOWS.format(t=min_words)}, w -> w.words >= {min_words})"))


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, fp, fp_pos): the selected places."""
    chosen = F.expr("array_distinct(transform(ws, w -> named_struct('fp', w.fp, 'fp_pos', w.fp_pos)))")
    return _windows(docs, min_words).select("doc_id", "th", F.explode(chosen).alias("f")).select("doc_id", "th", "f.fp", "f.fp_pos")


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, fp, pos, last, a, b, tail): the windows round the places, their worded lines' hashes, and the lines behind them."""
    told = f"transform(ws, w -> named_struct('fp', w.fp, 'pos', w.pos, 'last', w.last, 'a', w.a, 'b', w.b, 'tail', {_TAIL.format(t=min_words)}))"
    return _windows(docs, min_words).select("doc_id", "th", F.explode(F.expr(told)).alias("w")).select("doc_id", "th", "w.*")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, gone): the deleted line numbers, from 0, of the texts that lose any."""
    # what is aggregated is kept, so that the joins are of plain exchanges, whose hot keys Spark can split
    places = fingerprints(docs, min_words).distinct()  # a repeated row selects nothing twice
    often = keep(places.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"))
    w = keep(windows(docs, min_words).join(often, "fp", "left_semi"))
    place = F.struct("doc_id", "th", "pos")
    start = F.struct("doc_id", "th", "pos", F.expr("transform(tail, x -> x.h)").alias("then"))
    first = keep(w.groupBy("fp", "a", "b").agg(F.min(start).alias("first"), F.max(place).alias("final")).where("struct(first.doc_id, first.th, first.pos) <> final").drop("final"))
    later = w.join(first, ["fp", "a", "b"]).where(place > F.expr("struct(first.doc_id, first.th, first.pos)"))
    same = """aggregate(tail, named_struct('at', 0, 'n', 0), (s, x) -> named_struct(
      'at', s.at + 1, 'n', if(s.n = s.at AND coalesce(get(first.then, s.at) = x.h, false), s.n + 1, s.n)), s -> s.n)"""
    reach = later.withColumn("more", F.expr(same)).withColumn("last", F.expr("if(more > 0, tail[more - 1].pos, last)"))
    runs = reach.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "last")).alias("runs"))
    return runs.select("doc_id", "th", F.expr("array_distinct(flatten(transform(runs, r -> sequence(r.pos, r.last))))").alias("gone"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """struct r of each row, with n_lines, n_removed and the text that is left."""
    gone = deletions(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    rows = rows.withColumn("th", text_hash())
    joined = rows.join(gone, same_row(rows, gone, "doc_id", "th", "__id", "__th"), "left").select("r", "text", "__gone")
    cut = joined.withColumn("lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1))).withColumn(
        "left", F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), __gone), i -> lines[i]), '\n')")
    )
    none = F.col("__gone").isNull()
    return cut.select(
        "r",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
        F.when(none, F.col("text")).when(F.expr("size(array_except(sequence(0, size(lines) - 1), __gone)) = 0"), F.lit("")).otherwise(F.col("left")).alias("left"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("r.doc_id", "n_lines", "n_removed", F.col("left").alias("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeated runs; one that loses its last word goes."""
    out = dedup(docs).where((F.col("n_removed") == 0) | F.col("left").rlike("\\S"))
    changed = F.col("n_removed") > 0

    def column(name: str) -> F.Column:
        if name == "text":
            return F.col("left").alias("text")
        if name == "n_chars":
            return F.when(changed, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("r.n_chars")).alias("n_chars")
        return F.col("r")[name].alias(name)

    return out.select(*(column(c) for c in docs.columns))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), u AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\\t\\n\\v\\f\\r ]+')) AS words FROM l
), v AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k,
         sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM u WHERE words > 0
), e AS (
  SELECT s.doc_id, s.pos, s.k, s.upto, min(t.k) AS ke
  FROM v s JOIN v t ON s.doc_id = t.doc_id AND t.k >= s.k AND t.k < s.k + {MIN_WORDS}
                   AND t.upto - s.upto + s.words >= {MIN_WORDS}
  GROUP BY s.doc_id, s.pos, s.k, s.upto
), w AS (
  SELECT e.doc_id, e.pos, e.k, e.ke, e.upto, max(v.pos) AS last, string_agg(v.line, chr(10) ORDER BY v.pos) AS body
  FROM e JOIN v ON v.doc_id = e.doc_id AND v.k BETWEEN e.k AND e.ke
  GROUP BY ALL
), x AS (
  SELECT *, row_number() OVER f AS nth, first_value(doc_id) OVER f AS doc0, first_value(ke) OVER f AS ke0
  FROM w WINDOW f AS (PARTITION BY body ORDER BY doc_id, pos)
), y AS (
  SELECT x.doc_id, x.pos, n.pos AS spot, n.k, coalesce(n.line = m.line, false) AS same
  FROM x JOIN v n ON n.doc_id = x.doc_id AND n.k > x.ke AND n.k < x.ke + {MIN_WORDS} AND n.upto - x.upto < {MIN_WORDS}
  LEFT JOIN v m ON m.doc_id = x.doc0 AND m.k = x.ke0 + n.k - x.ke
  WHERE x.nth > 1
), z AS (
  SELECT doc_id, pos, spot, bool_and(same) OVER (PARTITION BY doc_id, pos ORDER BY k) AS ok FROM y
), g AS (
  SELECT doc_id, pos, max(spot) AS spot FROM z WHERE ok GROUP BY doc_id, pos
), r AS (
  SELECT x.doc_id, x.pos, greatest(x.last, coalesce(g.spot, x.last)) AS last
  FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos WHERE x.nth > 1
), d AS (
  SELECT DISTINCT l.doc_id, l.pos FROM r JOIN l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.pos AND r.last
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL), '') AS text
  FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.pos = l.pos GROUP BY l.doc_id
)
SELECT a.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN a.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents a LEFT JOIN k ON a.doc_id = k.doc_id
"""
