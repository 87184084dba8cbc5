"""Mixing sources to target weights: the cube method picks documents so that token and document totals stay balanced."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import stored, word_count
from textlens.operators.ranking import global_index

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0
#: Most documents of a source whose probabilities one task moves.
GROUP = 1 << 13
_EPS = 1e-9


def flight(sizes: np.ndarray, chances: np.ndarray, seed: int = 0) -> np.ndarray:
    """Flight phase of the cube method with two constraints, the number of documents and their words.

    Three documents with a fractional probability are taken at a time; probabilities move along the null space of their
    constraints until one of them is 0 or 1, so that both totals stay what they were. At most two stay fractional. Coins
    come from ``seed`` and the number of documents.
    """
    out = chances.astype(np.float64).copy()
    live: list[int] = []
    rng = np.random.default_rng([seed, len(out)])
    coins = rng.random(len(out) + 3).tolist()
    for i in np.flatnonzero((out > _EPS) & (out < 1 - _EPS)).tolist():
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = (float(sizes[j]) for j in live)
        way = (b - c, c - a, a - b)
        if not any(way):
            way = (1.0, -1.0, 0.0)
        up = down = np.inf
        for j, step in zip(live, way, strict=True):
            p = out[j]
            if step > 0:
                up, down = min(up, (1 - p) / step), min(down, p / step)
            elif step < 0:
                up, down = min(up, -p / step), min(down, (p - 1) / step)
        move = up if coins[i] * (up + down) < down else -down
        for j, step in zip(live, way, strict=True):
            out[j] += move * step
        kept = []
        for j in live:
            if _EPS < out[j] < 1 - _EPS:
                kept.append(j)
            else:
                out[j] = round(out[j])
        live = kept
    return out


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size and target of every source of ``sizes`` (source, size), one row each.

    Sources in order of their code points, null last, weigh ``weights`` in turn and share ``share`` of all sizes; a target
    stops at ``limit`` times its source's size and the excess goes to the others by weight until none is above.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = global_index(totals, [F.col("source").asc_nulls_last()], "rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    table = stored(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    rest, level = share * (table.agg(F.sum("source_size")).first()[0] or 0), None
    capped = F.lit(False)
    while True:
        full, open_weight = table.agg(F.sum(F.when(capped, F.col("source_size") * limit)), F.sum(F.when(~capped, F.col("weight")))).first()
        if not open_weight:
            break
        fresh = (rest - (full or 0.0)) / open_weight
        if level is not None and fresh <= level * (1 + 1e-12):
            break
        level = fresh
        capped = F.col("weight") * F.lit(level) > F.col("source_size") * limit
    capped_size = F.col("source_size") * F.lit(float(limit))
    shared = capped_size if level is None else F.least(F.col("weight") * F.lit(level), capped_size)
    return stored(table.select("source", "source_size", shared.cast("double").alias("target")), "targets")


def choose(units: DataFrame, group: int = GROUP) -> DataFrame:
    """``units`` (unit, source, size, chance) with the chance moved to 0 or 1 for all but at most two units of a source.

    A source is cut into groups of about ``group`` units, each moved by one task; what stays fractional, two of a group
    at most, is gathered in a further round of fewer groups, until each source is one group. Groups are dealt by unit, size
    and, if there is one, ``mark``, so that one unit of many rows is spread as well.
    """
    done: list[DataFrame] = []
    schema = units.schema
    columns = units.columns
    order = [c for c in ("unit", "size", "mark") if c in columns]
    while True:
        counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
        cells = units.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        parts = F.ceil(F.col("_n") / group)
        cells = cells.withColumn("_cell", F.pmod(F.xxhash64(*order), parts)).withColumn("_parts", parts)
        most = counts.agg(F.max("_n")).first()[0] or 0

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in order])
            seed = zlib.crc32(f"{table['source'][0].as_py()}/{table['_cell'][0].as_py()}".encode())
            moved = flight(table["size"].to_numpy(), table["chance"].to_numpy(), seed)
            return table.select(columns).set_column(columns.index("chance"), "chance", pa.array(moved))

        moved = stored(cells.groupBy("source", "_cell").applyInArrow(run, schema), "moved")
        if most <= group:
            done.append(moved)
            break
        partly = (F.col("chance") > _EPS) & (F.col("chance") < 1 - _EPS)
        done.append(moved.filter(~partly))
        units = moved.filter(partly)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def mix(units: DataFrame, whole: bool, **settings: object) -> DataFrame:
    """``units`` (unit, source, size; if ``whole`` also n, the number of like documents) with source_size, target, copies, taken.

    A unit of n documents is taken floor(n * target / source_size) times or once more, as the cube method picks. The at most
    two units of a source that stay fractional land by their fraction: of one more copy its words up to that share are
    taken, or, if ``whole``, a copy if the share is at least one half.
    """
    n = F.col("n") if whole else F.lit(1)
    goals = targets(units.select("source", (F.col("size") * n).alias("size")), **settings)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("rate", rate).withColumnRenamed("source", "_s")
    joined = units.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", F.col("rate") * n)
    base = F.floor(F.col("rate") + _EPS)
    joined = joined.withColumn("base", base).withColumn("chance", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    moved = choose(joined.drop("rate"))
    if whole:
        copies = F.col("base") + F.floor(F.col("chance") + 0.5)
        return moved.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    taken = F.least(F.col("size") * F.col("base") + F.round(F.col("size") * F.col("chance")).cast("bigint"), F.col("size") * 2)
    return moved.withColumn("copies", F.col("base") + F.ceil(F.col("chance") - _EPS)).withColumn("taken", taken)


def mixture(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``documents`` (doc_id, text, source).

    size is the number of words; null, empty and blank texts have 0 and are never taken. Null sources are one source, the
    last. Repeated rows are documents of their own; long texts count whole, and only their sizes are shuffled. An empty table
    gives an empty table; other columns are ignored.
    """
    mark = F.xxhash64("text").alias("mark")
    units = stored(documents.select(F.col("doc_id").alias("unit"), "source", word_count(F.col("text")).alias("size"), mark), "units")
    out = mix(units, whole=False)
    return out.select(F.col("unit").alias("doc_id"), "size", F.col("source_size").cast("bigint"), "target", F.col("taken").cast("bigint"))


def mix_documents(documents: DataFrame) -> DataFrame:
    """``documents`` as often as the mix takes them, whole; same columns.

    Rows of the same doc_id, text and source are one unit of several documents; its copies are dealt evenly to its rows.
    Only names, sources and sizes are shuffled to choose; texts are read again once it is known how often each is taken.
    """
    digest = F.xxhash64("doc_id", "text", "source", F.col("text").isNull(), F.col("doc_id").isNull())
    unit = F.concat_ws("/", digest.cast("string"), "source").alias("unit")
    sizes = documents.select(unit, "source", word_count(F.col("text")).alias("size"))
    units = stored(sizes.groupBy("unit", "source").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n")), "units")
    chosen = stored(mix(units, whole=True).filter("copies > 0").select("unit", "n", "copies"), "chosen")
    rows = documents.select(unit, F.struct("*").alias("row"))
    out = rows.join(chosen.filter("n = 1"), "unit").select("row", "copies")
    several = chosen.filter("n > 1")
    if not several.isEmpty():
        same = stored(rows.join(several, "unit").withColumn("id", F.monotonically_increasing_id()), "same")
        places = stored(global_index(same.select("unit", "id", "n", "copies"), [F.col("unit"), F.col("id")], "place"), "places")
        first = places.groupBy("unit").agg(F.min("place").alias("first"))
        more = (F.col("place") - F.col("first") < F.col("copies") % F.col("n")).cast("bigint")
        dealt = places.join(first, "unit").select("id", (F.floor(F.col("copies") / F.col("n")) + more).alias("copies"))
        out = out.union(same.select("row", "id").join(dealt.filter("copies > 0"), "id").select("row", "copies"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return out.select("row", times.alias("copy")).select("row.*")
