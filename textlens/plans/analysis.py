"""Queries over time and stance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.operators.stance import (
    classify,
    classify_with,
    evaluate,
    fit_classifier,
    sample_class,
    stance_from_logits,
    stance_over_time,
    train_and_evaluate,
)
from textlens.operators.asof import asof_join
from textlens.operators.joins import lookup_join
from textlens.operators.sampling import split_dataset
from textlens.operators.temporal import entity_trend, event_overlay, similarity_over_time, stance_by_bucket, term_frequency
from textlens.plans import inputs
from textlens.plans.inputs import BUCKET_SPACES, POSTS, SCORED, SEED, TOKENS, uniform_sql
from textlens.plans.registry import plan, rounded, rounded_sql, shown
from textlens.session import scratch_path
from textlens.sources.lines import read_labelled_folders, read_survey, write_labelled_folders, write_survey
from textlens.streaming.jobs import read_updates, run_available, run_updates, running_stance, running_word_counts


@plan("term_frequency", f"WITH {TOKENS} SELECT bucket, word, count(*) AS mentions FROM tokens GROUP BY ALL")
def _term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequency(inputs.tokens(spark, sf_dir)).select("bucket", "word", "mentions")


_BY_MONTH = TOKENS + """,
monthly AS MATERIALIZED (SELECT bucket, word, count(*) AS mentions FROM tokens GROUP BY ALL HAVING count(*) >= 2)"""


@plan(
    "term_proportion",
    f"""WITH {_BY_MONTH} SELECT bucket, word, mentions,
    {rounded_sql('mentions / sum(mentions) OVER (PARTITION BY bucket)', 9)} AS proportion FROM monthly""",
)
def _term_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = term_frequency(inputs.tokens(spark, sf_dir), min_frequency=2)
    return series.withColumn("proportion", rounded(F.col("proportion"), 9))


@plan(
    "chosen_terms",
    f"""WITH {_BY_MONTH}, cut AS (
      SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY mentions DESC, word) AS rank FROM monthly),
    kept AS (SELECT bucket, word, mentions, sum(mentions) OVER (PARTITION BY bucket) AS size FROM cut WHERE rank <= 500)
    SELECT bucket, word, mentions, {rounded_sql('mentions / size', 9)} AS proportion FROM kept
    WHERE word IN ('climate_change', 'the', 'and', '#topic')""",
)
def _chosen_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["climate_change", "the", "and", "#topic"]
    series = term_frequency(inputs.tokens(spark, sf_dir), words, min_frequency=2, max_tokens=500)
    return series.withColumn("proportion", rounded(F.col("proportion"), 9))


@plan(
    "similarity_over_time",
    f"""WITH {BUCKET_SPACES} SELECT a.bucket, {rounded_sql('list_cosine_similarity(a.vec, b.vec)')} AS similarity
    FROM spaces a JOIN spaces b ON a.bucket = b.bucket WHERE a.word = 'w3' AND b.word = 'w17'""",
)
def _similarity_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = similarity_over_time(inputs.spaces_by_bucket(spark, sf_dir), "w3", "w17")
    return series.withColumn("similarity", rounded(F.col("similarity")))


@plan(
    "entity_trend",
    f"""WITH weekly AS (SELECT event_type AS entity, (dayofyear(ts) - 1) // 7 AS year, count(*) AS n FROM events GROUP BY ALL),
    shares AS (SELECT entity, year, n / sum(n) OVER (PARTITION BY year) AS prop FROM weekly)
    SELECT entity, {rounded_sql('max_by(prop, year) - min_by(prop, year)')} AS change FROM shares
    GROUP BY entity HAVING max_by(prop, year) - min_by(prop, year) >= -0.01""",
)
def _entity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.floor((F.dayofyear("ts") - 1) / 7).cast("bigint").alias("year")
    weekly = inputs.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity"), week).agg(F.count(F.lit(1)).alias("n"))
    totals = weekly.groupBy("year").agg(F.sum("n").alias("total"))
    survey = weekly.join(totals, "year").select("entity", "year", (F.col("n") / F.col("total")).alias("prop"))
    trend = entity_trend(survey, rise=-0.01)
    return trend.select("entity", rounded(F.col("change")).alias("change"))


@plan(
    "survey_trend",
    f"""WITH weekly AS (SELECT event_type AS entity, (dayofyear(ts) - 1) // 7 AS year, count(*) AS n FROM events GROUP BY ALL)
    SELECT entity, {rounded_sql('CAST(max_by(n, year) AS DOUBLE) - min_by(n, year)')} AS change FROM weekly GROUP BY entity""",
)
def _survey_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of surveys that lie in CSV files, one per entity."""
    week = F.floor((F.dayofyear("ts") - 1) / 7).cast("int").alias("year")
    weekly = inputs.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity"), week).agg(F.count(F.lit(1)).cast("double").alias("prop"))
    path = scratch_path(spark, "survey")
    write_survey(weekly, path)
    return entity_trend(read_survey(spark, path)).select("entity", rounded(F.col("change")).alias("change"))


# Days of events that the monthly series are read against.
EVENTS = ["2018-06-08", "2018-09-14", "2019-03-15", "2019-08-19", "2019-09-20", "2019-11-04", "2020-06-12"]
_EVENT_ROWS = ", ".join(f"(DATE '{day}', 'event {n + 1}')" for n, day in enumerate(EVENTS))


@plan(
    "event_overlay",
    f"""WITH {TOKENS}, series AS (
      SELECT word AS series, CAST(bucket AS DATE) AS bucket, count(*) AS value FROM tokens WHERE word IN ('the', 'and', 'climate_change') GROUP BY ALL),
    happened(day, event) AS (VALUES {_EVENT_ROWS}),
    marked AS (
      SELECT s.series, s.bucket, s.value, max(h.day) AS day, max_by(h.event, h.day) AS event
      FROM series s LEFT JOIN happened h ON h.day <= last_day(s.bucket) GROUP BY ALL),
    means AS (
      SELECT m.series, m.bucket,
             avg(CASE WHEN s.bucket < date_trunc('month', m.day) THEN s.value END) AS mean_before,
             avg(CASE WHEN s.bucket >= date_trunc('month', m.day) THEN s.value END) AS mean_after
      FROM marked m JOIN series s ON s.series = m.series AND s.bucket >= date_trunc('month', m.day) - INTERVAL 2 MONTH
           AND s.bucket < date_trunc('month', m.day) + INTERVAL 2 MONTH GROUP BY ALL)
    SELECT m.series, CAST(m.bucket AS VARCHAR) AS bucket, m.value, coalesce(CAST(CAST(m.day AS DATE) AS VARCHAR), 'null') AS day,
           coalesce(m.event, 'null') AS event, coalesce({rounded_sql('mean_before')}, -1) AS mean_before,
           coalesce({rounded_sql('mean_after')}, -1) AS mean_after
    FROM marked m LEFT JOIN means ON means.series = m.series AND means.bucket = m.bucket""",
)
def _event_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["the", "and", "climate_change"]
    # Mentions alone: no other word need be counted.
    terms = term_frequency(inputs.tokens(spark, sf_dir).filter(F.col("word").isin(words)), words)
    series = terms.select(F.col("word").alias("series"), "bucket", F.col("mentions").alias("value"))
    rows = [(day, f"event {n + 1}") for n, day in enumerate(EVENTS)]
    events = spark.createDataFrame(rows, "day string, event string").withColumn("day", F.to_date("day"))
    overlay = event_overlay(series, events, window=2)
    means = [F.coalesce(rounded(F.col(c)), F.lit(-1.0)).alias(c) for c in ("mean_before", "mean_after")]
    return overlay.select("series", "bucket", "value", shown("day"), shown("event"), *means)


def _asof_sql(keep: str) -> str:
    return f"""WITH bought AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, e.user_id, coalesce(b.event_id, -1) AS purchase_id, coalesce(b.value, 0) AS paid
    FROM (SELECT * FROM events WHERE {keep}) e ASOF LEFT JOIN bought b ON e.user_id = b.user_id AND e.ts >= b.ts"""


def _latest_purchase(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase_id"), F.col("value").alias("paid"))
    seen = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    met = asof_join(seen, bought, "ts", "bought_at", by=["user_id"], values=["purchase_id", "paid"], **options)
    return met.select("event_id", "user_id", F.coalesce("purchase_id", F.lit(-1)).alias("purchase_id"), F.coalesce("paid", F.lit(0.0)).alias("paid"))


@plan("latest_purchase", _asof_sql("event_type <> 'purchase'"))
def _latest_purchase_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_purchase(spark, sf_dir)


@plan("latest_purchase_slices", _asof_sql("event_type <> 'purchase'"))
def _latest_purchase_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for series too large for one task, cut into ranges of time."""
    return _latest_purchase(spark, sf_dir, slice_rows=64)


@plan("stance_from_logits", f"WITH {SCORED} SELECT id, CAST(class AS BIGINT) AS class, CAST(stance AS BIGINT) AS stance, {rounded_sql('confidence')} AS confidence FROM scored")
def _stance_from_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stance_from_logits(inputs.scored(spark, sf_dir))
    return scored.select("id", "class", "stance", rounded(F.col("confidence")).alias("confidence"))


@plan("weighted_stance", f"WITH {SCORED} SELECT bucket, {rounded_sql('sum(stance * confidence) / count(*)')} AS value FROM scored GROUP BY bucket")
def _weighted_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = stance_by_bucket(stance_from_logits(inputs.scored(spark, sf_dir)))
    return series.select("bucket", rounded(F.col("value")).alias("value"))


@plan(
    "stance_statistic",
    f"WITH {SCORED} SELECT bucket, {rounded_sql('max(abs(stance) * confidence) - min(confidence)')} AS value FROM scored GROUP BY bucket",
)
def _stance_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(stance: Column, confidence: Column) -> Column:
        return F.max(F.abs(stance) * confidence) - F.min(confidence)

    series = stance_by_bucket(stance_from_logits(inputs.scored(spark, sf_dir)), spread)
    return series.select("bucket", rounded(F.col("value")).alias("value"))


_SOFTMAX = SCORED + """,
powers AS (SELECT id, label, class, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM scored)"""


@plan(
    "evaluate",
    f"""WITH {_SOFTMAX} SELECT {rounded_sql('avg(ln(list_sum(e)) + list_max(logits) - logits[label + 1])')} AS loss,
    {rounded_sql('avg(CASE WHEN class = label THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM powers""",
)
def _evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = evaluate(inputs.scored(spark, sf_dir))
    return measured.select(rounded(F.col("loss")).alias("loss"), rounded(F.col("accuracy")).alias("accuracy"))


@plan(
    "sample_class",
    f"""WITH {_SOFTMAX}, shares AS (SELECT id, list_transform(e, lambda x: x / list_sum(e)) AS p, {uniform_sql('id')} AS u FROM powers)
    SELECT id, CAST(CASE WHEN u < p[1] THEN 0 WHEN u < p[1] + p[2] THEN 1 WHEN u < p[1] + p[2] + p[3] THEN 2 ELSE 3 END AS BIGINT) AS sampled
    FROM shares""",
)
def _sample_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_class(inputs.scored(spark, sf_dir), ["id"], SEED).select("id", "sampled")


def _by_length() -> object:
    """A stand-in for a model: logits from the length and the blanks of a text."""

    def score(texts: list[str]) -> list[list[float]]:
        return [[len(t) % 7 / 2.0, t.count(" ") % 5 / 2.0, len(t) % 3 / 4.0, t.count("e") % 11 / 8.0] for t in texts]

    return score


@plan(
    "user_scorer",
    f"""WITH {POSTS}, counted AS (
      SELECT id, length(text) AS n, length(text) - length(replace(text, ' ', '')) AS b, length(text) - length(replace(text, 'e', '')) AS e FROM posts),
    logits AS (SELECT id, [n % 7 / 2.0, b % 5 / 2.0, n % 3 / 4.0, e % 11 / 8.0]::DOUBLE[] AS logits FROM counted)
    SELECT id, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS class,
           {rounded_sql('1 / (1 + exp(-list_max(logits)))')} AS confidence FROM logits""",
)
def _user_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stance_from_logits(classify_with(inputs.posts(spark, sf_dir).select("id", "text"), _by_length))
    return scored.select("id", "class", rounded(F.col("confidence")).alias("confidence"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = inputs.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("label"))
    # Texts are large and labels small: only labels are sent, if they were measured to be few.
    return lookup_join(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), labels, ["doc_id"])


@plan("classify")
def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled texts, scored by a model that has seen those of the training part alone."""
    parts = split_dataset(_labelled(spark, sf_dir), ["doc_id"], SEED, 0.2, 0.2)
    model = fit_classifier(parts.filter("part = 'train'"), features=1 << 14)
    scored = stance_from_logits(classify(parts, model))
    return scored.select("doc_id", "part", "label", "class", "stance", "confidence")


@plan("stance_over_time")
def _stance_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_classifier(_labelled(spark, sf_dir), features=1 << 14)
    posts = inputs.posts(spark, sf_dir).select("id", "bucket", "text")
    return stance_over_time(posts, lambda texts: classify(texts, model), size=20, seed=SEED)


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents, written to a folder per class and read back."""
    path = scratch_path(spark, "folders")
    named = _labelled(spark, sf_dir).withColumn("class", F.concat(F.lit("c"), F.col("label").cast("string")))
    write_labelled_folders(named, path)
    return read_labelled_folders(spark, path)


@plan(
    "labelled_folders",
    """SELECT md5(d.text) AS text_md5, 'c' || (quality + 2 * toxic) AS class, dense_rank() OVER (ORDER BY quality + 2 * toxic) - 1 AS label
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def _labelled_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir).select(F.md5("text").alias("text_md5"), "class", "label")


@plan("train_and_evaluate")
def _train_and_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders read, split, a model fitted to its tolerance, saved, and measured on what it has not seen."""
    texts = _folders(spark, sf_dir).withColumn("key", F.md5("text"))
    found, measured = train_and_evaluate(texts, ["key"], SEED, features=1 << 14)
    return measured.withColumns({"iterations": F.lit(found.iterations), "converged": F.lit(found.converged)})


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a file stream of English posts, dated over sixty days."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return _dated(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*"))


def _dated(stream: DataFrame) -> DataFrame:
    """English posts of arriving documents, dated over sixty days."""
    day = F.timestamp_add("DAY", F.col("doc_id") % 60, F.lit("2018-02-01 09:30:00").cast("timestamp"))
    dated = inputs.as_posts(stream.withColumn("created_ts", day), "created_ts")
    return dated.filter(F.col("lang") == "en")


_DAYS = "CAST(CAST(DATE '2018-02-01' + to_days(CAST({key} % 60 AS INT)) AS DATE) AS VARCHAR)"


@plan("stream_word_counts", f"WITH {TOKENS} SELECT {_DAYS.format(key='line_id')} AS day, word, count(*) AS freq FROM tokens GROUP BY ALL")
def _stream_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(running_word_counts(_arriving(spark, sf_dir), phrases=inputs.PHRASES), final=True)


@plan(
    "stream_stance",
    f"""WITH {SCORED} SELECT {_DAYS.format(key='s.id')} AS day, {rounded_sql('sum(stance * confidence) / count(*)')} AS value
    FROM scored s JOIN posts p ON p.id = s.id WHERE p.lang = 'en' GROUP BY ALL""",
)
def _stream_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = run_available(running_stance(_arriving(spark, sf_dir), inputs.with_logits), final=True)
    return series.select("day", rounded(F.col("value")).alias("value"))


# Documents arrive in three files of twenty days each, and in a fourth one that comes last, for most days too late: a
# micro-batch leaves out what is older than the watermark that the one before it began with.
_ARRIVALS = f"""{TOKENS},
arrived AS MATERIALIZED (
  SELECT line_id, CASE WHEN line_id % 11 = 0 THEN 3 ELSE line_id % 60 // 20 END AS batch,
         TIMESTAMP '2018-02-01 09:30:00' + to_days(CAST(line_id % 60 AS INT)) AS ts FROM corpus),
marks AS (
  SELECT b.batch, max(a.ts) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT batch FROM arrived) b LEFT JOIN arrived a ON a.batch < b.batch - 1 GROUP BY b.batch),
kept AS (
  SELECT line_id FROM arrived JOIN marks ON marks.batch = arrived.batch
  WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)"""


FILE_BYTES = 16 << 20  # text of an arriving file


def _part(files: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(files))


def _files_each(documents: DataFrame, batch: Column) -> int:
    """Files that each batch of documents is dealt to: as many for every batch, and none without a document."""
    sizes = documents.groupBy(batch.alias("batch")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    files = max(1, -(-int(sizes.agg(F.max("bytes")).first()[0] or 0) // FILE_BYTES))
    while files > 1:
        held = documents.select(batch.alias("batch"), _part(files).alias("part")).distinct().groupBy("batch").count()
        if [row["count"] for row in held.collect()] == [files] * 4:
            break
        files //= 2
    return files


@plan(
    "stream_restarted",
    f"""WITH {_ARRIVALS} SELECT {_DAYS.format(key='t.line_id')} AS day, word, count(*) AS freq
    FROM tokens t JOIN kept ON kept.line_id = t.line_id GROUP BY ALL""",
)
def _stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running word counts over four micro-batches, stopped after two and started again; late documents do not count."""
    documents = inputs.table(spark, sf_dir, "documents")
    batch = F.when(F.col("doc_id") % 11 == 0, 3).otherwise(F.floor(F.col("doc_id") % 60 / 20)).cast("int")
    files = _files_each(documents, batch)
    landing, path, checkpoint = (scratch_path(spark, name) for name in ("landing", "stream", "stream-state"))

    def counts() -> DataFrame:
        reader = spark.readStream.schema(documents.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        return running_word_counts(_dated(reader.option("maxFilesPerTrigger", files).parquet(landing)), phrases=inputs.PHRASES)

    for arriving in ((0, 1), (2, 3)):
        for number in arriving:
            # So many files are one micro-batch; files are read in the order of their times.
            arrived = documents.filter(batch == number).withColumn("part", _part(files)).repartition(files, "part")
            (arrived.write.partitionBy("part") if files > 1 else arrived.drop("part").write).parquet(f"{landing}/{number}")
        run_updates(counts(), path, checkpoint)
    return read_updates(counts(), path)
