"""Line de-duplication (operator 8) by winnowing over line hashes; DataFrame operations only.

Lines without a word are passed over.  Words are counted by the blanks and tabs between them, so double blanks count
once more: a run of n words never counts less than n.  A gram is the shortest span of whole lines from a line on with at
least GRAM words; its hash is that of its lines' 64-bit hashes.  In every span of at least WINDOW words the gram with the least hash is a
fingerprint.  So a run of lines with WINDOW words or more that occurs twice shares a fingerprint for sure, and
whatever is removed has repeated for GRAM words at least.

Each later occurrence of a fingerprint is joined with its first one (order: doc_id, text hash, line) and with the one
before it in the same document, never all with all.  On the diagonal that they fix, equal lines are matched both ways as
far as they go; the runs around fingerprints are deleted from the later place.  A stretch that repeats within a
document, as one line a thousand times does, lies on one diagonal.

Defined results: null text has no lines and stays null; a text whose lines all repeat becomes empty; rows with equal
id and text get the same result and don't remove each other; rows with equal id and other text are separate documents,
those without an id too, and stand before all others;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, unwritten, written

GRAM, WINDOW = 30, 50
#: Lines compared at a time on a diagonal.
STRETCH = 64
DIAGONAL = ["doc_id", "th", "a_doc", "a_th", "shift"]


def place_id() -> Column:
    """The id in the order of places; null comes before all."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos, nth (among lines with words), key, nw, c0 (words before) per line with words."""
    rows = docs.where("text is not null").select(place_id().alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = F.btrim("line", F.lit(SPACE))
    gaps = lambda c: F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(c), F.lit("")))
    rows = rows.where(bare != "").select("doc_id", "th", "pos", F.xxhash64("line").alias("key"), (gaps(" ") + gaps("\t") + 1).cast("long").alias("nw"))
    own = W.partitionBy("doc_id", "th")
    order = own.orderBy("pos")
    rows = rows.withColumn("before", F.lag("pos").over(order)).where("before is null or before <> pos").drop("before")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns({"nth": F.row_number().over(order), "c0": F.coalesce(F.sum("nw").over(before), F.lit(0)).cast("long")})


def fingerprints(rows: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, th, gram, nth: the selected grams and where they start."""
    order = W.partitionBy("doc_id", "th").orderBy("c0")
    span, reach = order.rangeBetween(0, gram - 1), order.rangeBetween(0, window - gram)
    rows = rows.withColumns({
        "total": F.sum("nw").over(W.partitionBy("doc_id", "th")),
        "gram": F.when(F.max(F.col("c0") + F.col("nw")).over(span) >= F.col("c0") + gram, F.xxhash64(F.collect_list("key").over(span))),
    })
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "nth"))).over(reach)
    chosen = rows.withColumn("least", least).where(F.col("total") - F.col("c0") >= window)
    return chosen.select("doc_id", "th", "least.gram", "least.nth").distinct()


def anchors(marks: DataFrame) -> DataFrame:
    """doc_id, th, a_doc, a_th, shift, nth: where a later place meets an earlier one, both by a fingerprint.

    A fingerprint's later place in a document meets the place before it there, so that all of a repeating stretch lies on
    one diagonal, whatever its period.  It meets the first place of all too, unless the fingerprints on both sides of it
    repeat as well: then it's inside such a stretch, whose ends stand for it.
    """
    own = W.partitionBy("doc_id", "th")
    along, again = own.orderBy("nth"), W.partitionBy("doc_id", "th", "gram").orderBy("nth")
    near = lambda step: F.struct(step("gram").over(along).alias("gram"), (step("nth").over(along) - F.col("nth")).alias("off"))
    rows = marks.withColumns({"left": near(F.lag), "right": near(F.lead)})
    rows = rows.withColumns({"before": F.lag("nth").over(again), "inner": (F.lag("left").over(again) == F.col("left")) & (F.lag("right").over(again) == F.col("right"))})
    rows = rows.select("doc_id", "th", "gram", "nth", "before", F.coalesce("inner", F.lit(False)).alias("inner"))
    inside = rows.where("before is not null").select("doc_id", "th", F.col("doc_id").alias("a_doc"), F.col("th").alias("a_th"), (F.col("nth") - F.col("before")).alias("shift"), "nth")
    first = marks.groupBy("gram").agg(F.min(F.struct("doc_id", "th", "nth")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.where("not inner").join(first.select("gram", "a"), "gram").where("not (doc_id = a.doc_id and th = a.th and nth = a.nth)")
    across = met.select("doc_id", "th", F.col("a.doc_id").alias("a_doc"), F.col("a.th").alias("a_th"), (F.col("nth") - F.col("a.nth")).alias("shift"), "nth")
    return inside.unionByName(across).distinct()


def matches(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, th, nth of the lines that run on, equal on both places, from an anchor.

    Only the stretches of STRETCH lines around anchors are compared at first.  Where a run reaches the end of what was
    compared on its diagonal, further stretches follow, twice as many a round, until no run does; diagonals without such a
    run are done with.  So the work is in proportion to what matches.
    """
    rows = rows.select("doc_id", "th", "nth", "key", F.floor(F.col("nth") / STRETCH).alias("part"))
    there = rows.select(F.col("doc_id").alias("a_doc"), F.col("th").alias("a_th"), F.col("nth").alias("a_nth"), F.col("key").alias("a_key"))
    at = F.floor(F.col("nth") / STRETCH)
    new = written(found.select(*DIAGONAL, F.explode(F.array(at - 1, at, at + 1)).alias("part")).where("part >= 0").distinct(), "stretches")
    longest = written(rows.groupBy("doc_id", "th").agg(F.max("part").alias("last")), "longest")
    seen, same, done, step = None, None, None, 1
    while True:
        own = rows.join(new, ["doc_id", "th", "part"]).withColumn("a_nth", F.col("nth") - F.col("shift"))
        if step > 1:  # few lines by now: as a table of known size they are sent to the others', which stay where they are
            own = written(own, "lines")
        both = own.join(there, ["a_doc", "a_th", "a_nth"]).where("key = a_key")
        more = written(both.select(*DIAGONAL, "nth"), "matches")
        same = more if same is None else same.unionByName(more)
        seen = new if seen is None else seen.unionByName(new)
        runs = same.withColumn("run", F.col("nth") - F.row_number().over(W.partitionBy(*DIAGONAL).orderBy("nth")))
        marked = runs.join(found.withColumn("anchor", F.lit(1)), [*DIAGONAL, "nth"], "left")
        kept = marked.groupBy(*DIAGONAL, "run").agg(F.min("nth").alias("lo"), F.max("nth").alias("hi"), F.max("anchor").alias("has")).where("has = 1")
        kept = written(kept.select(*DIAGONAL, "lo", "hi"), "runs")
        low, high = F.floor((F.col("lo") - 1) / STRETCH), F.floor((F.col("hi") + 1) / STRETCH)
        ends = kept.select(*DIAGONAL, F.explode(F.array(F.struct(low.alias("part"), F.lit(-1).alias("way")), F.struct(high.alias("part"), F.lit(1).alias("way")))).alias("e"))
        ends = ends.select(*DIAGONAL, "e.part", "e.way").join(seen, [*DIAGONAL, "part"], "left_anti")
        ahead = F.explode(F.sequence(F.col("part"), F.col("part") + F.col("way") * (step - 1), F.col("way").cast("long")))
        new = ends.select(*DIAGONAL, ahead.alias("part")).distinct().join(longest, ["doc_id", "th"]).where("part between 0 and last").drop("last")
        new = written(new.join(seen, [*DIAGONAL, "part"], "left_anti"), "stretches")
        open_ = new.select(*DIAGONAL).distinct()
        closed = kept.join(open_, DIAGONAL, "left_anti").select("doc_id", "th", "lo", "hi")
        done = closed if done is None else done.unionByName(closed)
        if new.isEmpty():
            # overlapping runs of a document become one before lines are counted out
            before = W.partitionBy("doc_id", "th").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
            apart = done.withColumn("upto", F.coalesce(F.max("hi").over(before), F.lit(0))).withColumn("lo", F.greatest("lo", F.col("upto") + 1)).where("lo <= hi")
            return apart.select("doc_id", "th", F.explode(F.sequence("lo", "hi")).alias("nth"))
        same, seen, step = same.join(open_, DIAGONAL, "left_semi"), seen.join(open_, DIAGONAL, "left_semi"), 2 * step


def remaining(rows: DataFrame, marks: DataFrame, gone: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, nth of further lines that lie in a span of `window` words or more which stands earlier as well."""
    often = marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    again = written(marks.join(often, "gram", "left_semi").select("doc_id", "th", "nth").distinct(), "again")
    own = rows.join(again.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").select("doc_id", "th", "nth", "key", "c0", (F.col("c0") + F.col("nw")).alias("c1"))
    own = own.join(again.withColumn("marked", F.lit(1)), ["doc_id", "th", "nth"], "left").join(gone.distinct().withColumn("gone", F.lit(1)), ["doc_id", "th", "nth"], "left")
    whole = W.partitionBy("doc_id", "th")
    # from a line on: the lines that begin within `window` words of its start; up to a line: those that end within so many of its end
    ways = (whole.orderBy("c0").rangeBetween(0, window - 1), whole.orderBy("c1").rangeBetween(-(window - 1), 0))
    span = lambda w: F.when((F.max("c1").over(w) - F.min("c0").over(w) >= window) & (F.max("marked").over(w) == 1), F.struct(F.xxhash64(F.collect_list("key").over(w)).alias("span"), F.min("nth").over(w).alias("lo"), F.max("nth").over(w).alias("hi"), (F.count("gone").over(w) < F.count(F.lit(1)).over(w)).alias("open")))
    spans = own.select("doc_id", "th", span(ways[0]).alias("a"), span(ways[1]).alias("b"))
    spans = spans.select("doc_id", "th", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("s")).select("doc_id", "th", "s.*")
    spans = written(spans, "spans")
    asked = spans.where("open")
    first = spans.join(asked.select(F.col("span").alias("wanted")).distinct(), F.col("span") == F.col("wanted"), "left_semi").groupBy("span").agg(F.min(F.struct("doc_id", "th", "lo")).alias("a"))
    late = asked.join(first, "span").where("not (doc_id = a.doc_id and th = a.th and lo = a.lo)")
    out = written(late.select("doc_id", "th", F.explode(F.sequence("lo", "hi")).alias("nth")).distinct(), "remaining")
    unwritten(spans, again)
    return out


def repeated(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, th, removed (sorted line numbers), words (in them) of the documents that lose lines."""
    rows = written(lines(docs), "lines")
    marks = written(fingerprints(rows, gram, window), "marks")
    gone = written(matches(rows, written(anchors(marks), "anchors")), "gone")
    gone = gone.unionByName(remaining(rows, marks, gone, window)).distinct()
    lost = gone.join(rows.select("doc_id", "th", "nth", "pos", "nw"), ["doc_id", "th", "nth"])
    return lost.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("pos")).alias("removed"), F.sum("nw").alias("words"))


def deduplicated(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, words_removed, text (what is left)."""
    docs = docs.select("doc_id", "text")
    gone = repeated(docs, gram, window)
    whole = docs.withColumns({"th": F.xxhash64("text"), "place": place_id()})
    both = whole.join(gone.withColumnRenamed("doc_id", "place"), ["place", "th"], "left")
    parts = F.split("text", "\n", -1)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed")), lambda i: F.get(parts, i)), "\n")
    return both.select(
        "doc_id", F.when(F.col("text").isNotNull(), F.size(parts)).otherwise(0).cast("long").alias("n_lines"), F.when(F.col("removed").isNotNull(), F.size("removed")).otherwise(0).cast("long").alias("n_removed"),
        F.coalesce("words", F.lit(0)).cast("long").alias("words_removed"), F.when(F.col("removed").isNotNull(), left).otherwise(F.col("text")).alias("text"),
    )
