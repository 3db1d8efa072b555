"""Operator 8: removal of repeated runs of lines, with DataFrame functions only.

Documents are sequences of line ids; blank lines don't count. All lines have
one position in the corpus, with a gap between documents. The suffixes from each
line on are ranked by distributed prefix doubling: pairs of the ranks by the
first 2^l lines and by the 2^l after them are put in order, which ranks them by
2^(l+1) lines. A suffix whose first lines occur once has found its place and
drops out. So the ranks are the suffix array of all suffixes that share their
first lines with others, as far as MIN_CHARS characters go.

Suffixes that share their first lines, MIN_CHARS characters of them or more,
are an interval of the array whose common prefixes are that long. Whether two
have so many first lines in common is told by two ranks each, of the first and
of the last 2^l lines among them, l as large as fits. The first suffix of an
interval in the corpus is the copy that stays; each other one is a later copy of
these lines. Intervals are taken at the shortest prefixes of MIN_CHARS
characters from each line on, and back from each line; these cover every run
of lines that also occurs earlier, and their union is the maximal repeated
runs. So runs of any length are found while no block has more than MIN_CHARS
lines.

Equal texts are one before any of this: the first stays in the array, the
others lose all their lines if these have MIN_CHARS characters. Lines, blocks
and texts of which there are very many (over one in HOT) are at most HOT; they
are joined by broadcast, the others by shuffle.

Defined cases: null text stays null; a text that is all repeats becomes empty
but for blank lines; documents are told apart by doc_id and 128 bits of their
text, so rows of equal doc_id and text are one document and keep the same
lines, and texts that share a doc_id are documents each; null doc_ids come
first, equal ones in an order of their texts; blank lines stay; other columns
are unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions.running import range_numbered, running_total
from geoweft.llm.common import HOT, free_name, looked_up, shuffle_partitions, staged, temporary
from geoweft.session import checkpointed

MIN_CHARS = 150


def _blank(x: Column) -> Column:
    return F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) == ""


def _hashes(text: Column, one: str, two: str) -> list[Column]:
    return [F.xxhash64(text).alias(one), F.xxhash64(F.lit(1), text).alias(two)]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, first, copies, chars, doc, lines): a row per text that has a line, for use with few columns at a time. first: its smallest doc_id in a struct;
    doc: the corpus position of its first line; lines: those that aren't blank, with number, length and hashes."""
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.char_length(x).alias("n"), *_hashes(x, "l1", "l2"), _blank(x).alias("blank")))
    rows = docs.where("text is not null").select("doc_id", *_hashes(F.col("text"), "h1", "h2"), F.filter(parts, lambda x: ~x["blank"]).alias("lines")).where("size(lines) > 0")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id")).alias("first")
    texts = rows.groupBy("h1", "h2").agg(first, F.count("*").alias("copies"), F.first("lines").alias("lines"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("chars")
    texts = staged(texts.select("h1", "h2", "first", "copies", chars, "lines"), "line-texts")
    light = texts.select("h1", "h2", "first", (F.size("lines") + 1).cast("long").alias("places"))
    order = ["first", "h1", "h2"]
    light = range_numbered(light, order, shuffle_partitions(docs.sparkSession), "bucket", "line-texts-order")
    places = running_total(light, "places", order, "bucket", "doc").select("h1", "h2", "doc")
    return texts.join(places, ["h1", "h2"])


def line_table(texts: DataFrame) -> DataFrame:
    """(doc, pos, line, n, l1, l2): the lines in the array."""
    return texts.select("doc", F.posexplode("lines").alias("k", "x")).select("doc", (F.col("doc") + F.col("k")).alias("pos"), "x.line", "x.n", "x.l1", "x.l2")


def ranked(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The rows whose keys occur twice or more, with their rank: how many of these rows have smaller keys; and first, the first pos that has the keys. rows are stored."""
    classes = rows.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("pos").alias("first")).where("_c > 1")
    classes = range_numbered(classes, keys, shuffle_partitions(rows.sparkSession), "bucket", "line-classes")
    ranks = staged(running_total(classes, "_c", keys, "bucket", out).select(*keys, "_c", "first", out), "line-ranks")
    return looked_up(rows, ranks, keys, "_c", rows.count())


def intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that share a prefix, told by the ranks of its parts, with leader, the first pos that has it. rows are stored."""
    shared = staged(rows.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("pos").alias("leader")).where("_c > 1"), "line-intervals")
    return looked_up(rows, shared, keys, "_c", rows.count())


def windows(lines: DataFrame, min_chars: int) -> DataFrame:
    """(doc, pos, line, rank, first, ahead, back, most): ahead and back are the lines of the shortest stretches of min_chars
    from here on, and to here, null where the run of adjoining lines has none; most is the largest of the run."""
    run = Window.partitionBy("doc", "run")
    lines = lines.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    lines = lines.withColumn("t", F.sum("n").over(run.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("long")).withColumn("s", (F.col("t") - F.col("n")).cast("long"))
    on = run.orderBy("s").rangeBetween(0, min_chars - 1)
    to = run.orderBy("t").rangeBetween(-(min_chars - 1), 0)
    ahead = F.when(F.max("t").over(on) - F.col("s") >= min_chars, F.max("pos").over(on) - F.col("pos") + 1)
    back = F.when(F.col("t") - F.min("s").over(to) >= min_chars, F.col("pos") - F.min("pos").over(to) + 1)
    sized = lines.withColumn("ahead", ahead).withColumn("back", back)
    return sized.withColumn("most", F.max(F.greatest("ahead", "back")).over(run)).select("doc", "pos", "line", "rank", "first", "ahead", "back", "most")


def later_copies(found: DataFrame) -> DataFrame:
    """(doc, pos, end): stretches of lines that occur earlier too, by the intervals of their common prefixes."""
    starts = found.where("ahead is not null").select("doc", "pos", F.col("ahead").alias("size"))
    ends = found.where("back is not null").select("doc", (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("size"))
    later = [found.where("(ahead = 1 or back = 1) and first < pos").select("doc", "pos", (F.col("pos") + 1).alias("end"))]
    prefixes = checkpointed(starts.unionByName(ends).where("size > 1").distinct().withColumn("level", F.floor(F.log2("size")).cast("int")))
    deepest = prefixes.agg(F.max("level")).first()[0] or 0
    ranks = found.select("doc", "pos", "rank", "most")
    for level in range(1, deepest + 1):
        half = 1 << (level - 1)
        behind = Window.partitionBy("doc").orderBy("pos").rangeBetween(half, half)
        pairs = ranks.where(F.col("most") >= 2 * half).withColumn("other", F.max("rank").over(behind)).where("other is not null")
        ranks = ranked(staged(pairs, "line-pairs"), ["rank", "other"], "next").select("doc", "pos", F.col("next").alias("rank"), "most")
        ranks = checkpointed(ranks)
        # Suffixes have a prefix in common if the ranks of its first and of its last 2^level lines agree; these are one for as many lines.
        ahead = prefixes.where(F.col("level") == level).join(ranks.select("pos", "rank"), "pos")
        last = ranks.select(F.col("pos").alias("pos2"), F.col("rank").alias("rank2"))
        ahead = ahead.withColumn("pos2", F.col("pos") + F.col("size") - 2 * half).join(last, "pos2")
        common = intervals(staged(ahead.select("doc", "pos", "size", "rank", "rank2"), "line-prefixes"), ["size", "rank", "rank2"])
        later.append(staged(common.where("leader < pos").select("doc", "pos", (F.col("pos") + F.col("size")).alias("end")), "line-later"))
    return reduce(DataFrame.unionByName, later)


def repeated_lines(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, lines): for each text in the array that loses any, the numbers of its lines in runs that occur earlier."""
    lines = ranked(staged(line_table(texts), "lines"), ["l1", "l2"], "rank")
    found = staged(windows(lines.select("doc", "pos", "line", "n", "rank", "first"), min_chars), "line-windows")
    both = found.select("doc", "pos", "line", F.lit(None).cast("long").alias("end")).unionByName(later_copies(found).select("doc", "pos", F.lit(None).cast("int").alias("line"), "end"))
    reach = F.max("end").over(Window.partitionBy("doc").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("end", reach).where("line is not null and end > pos").groupBy("doc").agg(F.collect_list("line").alias("lines"))


def remove_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with its columns, text without the removed lines; and n_lines, n_removed (named apart from its columns)."""
    with temporary(docs.sparkSession):
        texts = distinct_texts(docs)
        gone = repeated_lines(texts, min_chars).withColumnRenamed("lines", "gone")
        known = texts.select("h1", "h2", "first", "copies", "chars", "doc").join(gone, "doc", "left")
        known = known.where(F.col("gone").isNotNull() | ((F.col("copies") > 1) & (F.col("chars") >= min_chars)))
        known = staged(known.drop("doc"), "line-known", keep=True)
    total = docs.count()
    hot = F.broadcast(known.where(F.col("copies") > total // HOT).select("h1", "h2", "first", "chars"))  # at most HOT rows
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), *_hashes(F.col("text"), "h1", "h2"))
    rows = rows.join(hot.withColumnsRenamed({"first": "hot_first", "chars": "hot_chars"}), ["h1", "h2"], "left")
    own = lambda first: F.col("r.doc_id").eqNullSafe(F.col(f"{first}.doc_id"))
    # A copy of a very common text needs nothing but to know that, so it goes wherever there is room.
    rows = rows.withColumn("copy", F.coalesce(F.col("hot_first").isNotNull() & ~own("hot_first"), F.lit(False)) | F.col("r.text").isNull())
    rows = rows.select("r", "copy", F.when(F.col("copy"), F.col("hot_chars")).alias("hot_chars"), F.when(F.col("copy"), F.xxhash64("r.doc_id")).otherwise(F.col("h1")).alias("k1"), F.when(F.col("copy"), F.lit(0)).otherwise(F.col("h2")).alias("k2"))
    other = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(False).alias("copy"), "first", "chars", "gone")
    # The same join at every size: texts move once, and no side must fit one machine.
    joined = rows.join(other.hint("shuffle_hash"), ["k1", "k2", "copy"], "left")
    later = F.when(F.col("copy"), F.col("hot_chars")).when(F.col("first").isNotNull() & ~own("first"), F.col("chars")) >= min_chars
    lines = F.split("r.text", "\n", -1)
    left = F.when(later, F.filter(lines, _blank)).when(F.col("gone").isNotNull(), F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)))
    done = joined.select("r", F.when(F.col("r.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n"), left.alias("left"))
    text = F.when(F.col("left").isNull(), F.col("r.text")).otherwise(F.array_join("left", "\n"))
    columns = [text.alias(c) if c == "text" else F.col("r").getField(c).alias(c) for c in docs.columns]
    n_removed = F.when(F.col("left").isNull(), 0).otherwise(F.col("n") - F.size("left")).cast("long")
    return done.select(*columns, F.col("n").alias(free_name(docs, "n_lines")), n_removed.alias(free_name(docs, "n_removed")))


def report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars, text_sha256 of each document after removal."""
    done = remove_lines(docs.select("doc_id", "text"), min_chars)
    return done.select("doc_id", "n_lines", "n_removed", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"))


#: The same by definition: the windows' texts themselves are compared.
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, text FROM documents),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs WHERE text IS NOT NULL),
lines AS (SELECT *, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM split WHERE trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> ''),
places AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS t, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS s FROM lines),
found AS (
  SELECT doc_id, k AS a, max(k) OVER f AS b, max(t) OVER f - s AS size, string_agg(x, chr(10) ORDER BY k) OVER f AS content FROM places
  WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {MIN_CHARS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(k) OVER g, k, t - min(s) OVER g, string_agg(x, chr(10) ORDER BY k) OVER g FROM places
  WINDOW g AS (PARTITION BY doc_id ORDER BY t RANGE BETWEEN {MIN_CHARS - 1} PRECEDING AND CURRENT ROW)),
large AS (SELECT DISTINCT doc_id, a, b, content FROM found WHERE size >= {MIN_CHARS}),
first AS (SELECT content, min(row(doc_id, a)) AS leader FROM large GROUP BY content),
later AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS k FROM large JOIN first USING (content) WHERE row(doc_id, a) > leader),
gone AS (SELECT DISTINCT l.doc_id, l.line FROM lines l JOIN later USING (doc_id, k)),
left_over AS (SELECT s.doc_id, string_agg(s.x, chr(10) ORDER BY s.line) AS text, count(*) AS n FROM split s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.line = g.line GROUP BY s.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM split GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, (coalesce(c.n, 0) - coalesce(o.n, 0))::BIGINT AS n_removed,
  length(coalesce(o.text, ''))::BIGINT AS n_chars, sha256(coalesce(o.text, '')) AS text_sha256
FROM docs d LEFT JOIN counts c USING (doc_id) LEFT JOIN left_over o USING (doc_id)
"""
