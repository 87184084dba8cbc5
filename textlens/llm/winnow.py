"""Document fingerprints by winnowing, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: A unit is one character other than white space; grams begin at each of them.
UNIT = 1
#: Units of a gram; grams of a window, a multiple of `STEP`. Two texts that share GRAM + WINDOW - 1 units in a row share a
#: fingerprint, wherever these begin and however white space parts them.
GRAM, WINDOW = 12, 20
#: A window's minimum is taken over minima of this many grams.
STEP = 4
#: Units of a whole window; those before a seam within which windows that reach over it, or picks that only these decide, begin.
REACH = GRAM + WINDOW - 1
BACK = REACH + WINDOW - 2
#: Bytes of text of a range, about, where the session's shuffle partitions would make larger ones.
RANGE_BYTES = 64 << 20
LOW = 0xFFFFFFFF


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the chosen grams of ``text`` in order, each (hash of 31 bits) << 32 | (2^32 - 1 - position).

    Every window of `WINDOW` grams gives its smallest value; as positions count down, the rightmost of equal hashes is
    smallest. A text with fewer grams is one window, one with fewer units a single gram; without units the array is
    empty. Null is the empty text. Each step is a column of its own, so that none is computed twice.
    """
    rest = [c for c in df.columns]
    df = df.select(*rest, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "").alias("_solid"))
    each = F.regexp_extract_all("_solid", F.lit(r"(?s)(?=(.{%d}))." % GRAM), F.lit(1))
    whole = F.when(F.col("_solid") == "", F.array().cast("array<string>")).otherwise(F.array("_solid"))
    grams = F.when(F.char_length("_solid") >= GRAM, each).otherwise(whole)

    def numbered(gram: Column, i: Column) -> Column:
        return F.shiftleft(F.xxhash64(gram).bitwiseAND(F.lit(0x7FFFFFFF)), 32) + (F.lit(LOW) - i)

    def lowest(name: str, jumps: range) -> Callable[[Column], Column]:
        # beyond the end of a short text get() gives null, which least() passes over
        return lambda i: F.least(*[F.get(name, i + j) for j in jumps])

    df = df.select(*rest, F.transform(grams, numbered).alias("_grams"))
    df = df.select(*rest, F.transform(steps(F.size("_grams")), lowest("_grams", range(STEP))).alias("_few"))
    windows = F.greatest(F.size("_few") - WINDOW + 1, F.least(F.size("_few"), F.lit(1)))
    return df.select(*rest, F.array_distinct(F.transform(steps(windows), lowest("_few", range(0, WINDOW, STEP)))).alias(name))


def steps(count: Column) -> Column:
    """0, 1, ... count - 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 32)))


def positions(chosen: Column) -> Column:
    """Where each chosen gram begins, in units (characters other than white space)."""
    return F.transform(chosen, lambda x: F.lit(LOW) - x.bitwiseAND(F.lit(LOW)))


def written(chosen: Column) -> Column:
    """A fingerprint as text: each chosen value in hexadecimal."""
    return F.array_join(F.transform(chosen, lambda x: F.lower(F.hex(x))), " ")


def likeness(one: str, two: str) -> Column:
    """Shared over all hashes of two sets; two empty sets are alike, 1."""
    common = F.size(F.array_intersect(one, two))
    whole = F.size(one) + F.size(two) - common
    return F.when(whole == 0, F.lit(1.0)).otherwise(common / whole)


def part_below(value: Column, bounds: Column, count: int) -> Column:
    """How many of the sorted ``bounds``, at most ``count``, lie under ``value``, by halving steps."""
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, count.bit_length())))])
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.get(bounds, at + jump - 1) < value, at + jump).otherwise(at))


def joined_fingerprint(df: DataFrame, head: str, tail: str, own: str, other: str, name: str) -> DataFrame:
    """Adds ``name``: what `with_fingerprint` gives for ``head`` + ``tail``, a prefix of a text with the fingerprint ``own`` and
    one of a text with the fingerprint ``other``.

    Windows that lie in one of the two chose in its text what they choose here, so picks that only such windows can have
    made are taken over, those of the tail moved. Two stretches are computed anew: the windows over the seam and those at
    the end, with as many before as may share their picks. Positions of picks never fall from window to window, so the
    parts are in order and only what two of them hold is left out.
    """
    rest = df.columns
    df = df.select(*rest, *[F.regexp_replace(F.col(c), r"[\x20\x09-\x0D]+", "").alias(n) for c, n in ((head, "_h"), (tail, "_t"))])
    df = df.select(*rest, "_h", "_t", F.char_length("_h").alias("_m"), F.char_length("_t").alias("_q"))
    long_tail = F.col("_q") >= REACH + BACK
    start = F.greatest(F.col("_m") - BACK, F.lit(0))
    seam = F.concat(F.expr(f"substring(_h, greatest(_m - {BACK}, 0) + 1)"), F.substring("_t", F.lit(1), F.when(long_tail, F.lit(REACH)).otherwise(F.col("_q"))))
    end = F.when(long_tail, F.expr(f"substring(_t, _q - {BACK} + 1)")).otherwise(F.lit(""))
    df = df.select(*rest, "_m", "_q", seam.alias("_seam"), end.alias("_end"))
    df = with_fingerprint(with_fingerprint(df, "_seam", "_seam_picks"), "_end", "_end_picks")

    def within(picks: str, last: Column) -> Column:
        return F.filter(picks, lambda x: x.bitwiseAND(F.lit(LOW)) >= F.lit(LOW) - last)

    def moved(picks: Column, by: Column) -> Column:
        return F.transform(picks, lambda x: x - by)

    none = F.array().cast("array<bigint>")
    before = F.when(F.col("_m") >= BACK, within(own, F.col("_m") - REACH)).otherwise(none)
    after = F.when(long_tail, moved(within(other, F.col("_q") - REACH), F.col("_m"))).otherwise(none)
    parts = [before, moved(F.col("_seam_picks"), start), after, moved(F.col("_end_picks"), F.col("_m") + F.col("_q") - BACK)]
    return df.select(*rest, F.array_distinct(F.concat(*parts)).alias(name))


def in_ranges(documents: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """Rows of ``documents`` with guests, and the window in which the next row is the text next in descending doc_id.

    Rows go to ranges of doc_id (_part) of about `RANGE_BYTES` of text or less, and the first row of the following range (after the last: of the first) comes
    along as a guest (_guest = 1). Only the ranges' bounds, one number each, pass through the driver. Equal doc_ids are
    ordered by text, a row without doc_id comes last.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_at"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    found = rows.agg(F.percentile_approx("_at", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0] or []
    bounds = sorted(set(found))
    sent = spark.createDataFrame([(bounds,)], "_bounds array<bigint>")
    rows = rows.crossJoin(F.broadcast(sent)).withColumn("_part", part_below(F.col("_at"), F.col("_bounds"), len(bounds))).drop("_bounds")
    firsts = sorted((r["_part"], r["first"]) for r in rows.groupBy("_part").agg(F.max("_at").alias("first")).collect())
    firsts.reverse()  # in reading order: the highest range first
    guests = [(to, first) for (to, _), (_, first) in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True)]
    sent = spark.createDataFrame(guests, "_to int, _at bigint")
    visiting = rows.join(F.broadcast(sent), "_at").select("doc_id", "text", "_at", F.col("_to").alias("_part"), F.lit(1).alias("_guest"))
    both = rows.select("doc_id", "text", "_at", "_part", F.lit(0).alias("_guest")).union(visiting)
    order = Window.partitionBy("_part").orderBy("_guest", F.col("_at").desc(), "text")
    return both, order


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 3) characters replaced by the first as many (or all) of the text next in
    descending doc_id, after the last row that of the first. near_edited and near_next are shared over all hashes of two
    fingerprints. Null texts are empty; an empty text has an empty fingerprint, and two empty ones are alike (1.0).
    Equal doc_ids are ordered by text, rows without doc_id come last; a single row is its own next. Columns other than
    doc_id and text are ignored, an empty table gives an empty table. A text is one row from end to end, so very long ones
    cost memory for themselves, about 150 bytes a character. The edited text is fingerprinted from its two parts (see
    `joined_fingerprint`), with the same result as from the whole.
    """
    both, order = in_ranges(documents)
    marked = with_fingerprint(both, "text", "_own")
    chars = F.char_length("text")
    paired = marked.select(
        "doc_id", "_guest", "text", "_own",
        chars.alias("n_chars"),
        F.lead("_own").over(order).alias("_next"),
        F.lead("text").over(order).alias("_after"),
    ).filter("_guest = 0")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.expr("substring(text, 1, n_chars - CAST(floor(n_chars / 3) AS INT))")
    taken = F.substring("_after", F.lit(1), cut)
    changed = paired.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "_own", "_next", kept.alias("_kept"), taken.alias("_taken"))
    full = joined_fingerprint(changed, "_kept", "_taken", "_own", "_next", "_new").withColumn("_edited", F.concat("_kept", "_taken"))
    sets = full.select(
        "doc_id", "n_chars", "_edited", "_own", "_new",
        hashes(F.col("_own")).alias("_a"), hashes(F.col("_new")).alias("_b"), hashes(F.col("_next")).alias("_c"),
    )
    return sets.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        written(F.col("_own")).alias("fingerprint"),
        written(F.col("_new")).alias("edited_fingerprint"),
        likeness("_a", "_b").alias("near_edited"),
        likeness("_a", "_c").alias("near_next"),
    )
