"""The knowledge corpus: enrichment, keywords, chunks, maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relayloom.functions import vocabulary as V
from relayloom.operators.text import SPACES, strip

DOCUMENT = "id string, title string, text string, category string, keywords array<string>, metadata map<string,string>, content_hash string, created_at timestamp, updated_at timestamp, word_count int, char_count int"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def keywords(docs: DataFrame, most: int = 10) -> DataFrame:
    """(id, keywords): the most frequent words of three ASCII letters or more, ties by first place.

    Stop words go before the shuffle; the key is (id, word), so a long document spreads out.
    """
    words = docs.select("id", F.posexplode_outer(tokens(F.col("text"))).alias("pos", "word")).where(F.col("word").rlike("^[a-z]{3,}$") & ~F.col("word").isin(V.STOP_WORDS))
    counted = words.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "pos"))).where(F.col("r") <= most)
    return ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("keywords"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"{SPACES}+"), lambda x: x != ""))


def enrich(docs: DataFrame, now: Column) -> DataFrame:
    """Rows of DOCUMENT from (title, text, category, metadata and maybe id)."""
    made = F.substring(F.md5(F.concat_ws(":", F.coalesce("title", F.lit("")), "text")), 1, 12)
    docs = docs.withColumn("id", F.coalesce("id", made) if "id" in docs.columns else made)
    found = keywords(docs)
    return docs.join(found, "id", "left").select(
        "id", "title", "text", "category", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "metadata", F.sha2("text", 256).alias("content_hash"),
        now.alias("created_at"), now.alias("updated_at"), word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"),
    )


def content_id(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id, F.substring(F.sha2(text, 256), 1, 12))


def chunks(docs: DataFrame, size: int = 600, overlap: int = 120) -> DataFrame:
    """Overlapping character chunks: chunk_id, text, parent_doc_id, chunk_index, chunk_count, content_hash.

    Chunk i starts at i * (size - overlap); an empty text has one empty chunk.
    """
    size = max(100, size)
    step = size - max(0, min(overlap, size // 2))
    body = docs.select("id", "content_hash", strip(F.coalesce("text", F.lit(""))).alias("body"))
    cut = F.regexp_extract_all("body", F.lit("(?s).{1,%d}" % step), F.lit(0))  # a chunk is a piece and the head of the next
    n = F.when(F.length("body") <= size, 1).otherwise(F.ceil((F.length("body") - size) / step) + 1).cast("int")
    pieces = body.select("id", "content_hash", cut.alias("pieces"), n.alias("n"))
    whole = F.transform("pieces", lambda p, i: strip(F.concat(p, F.substring(F.coalesce(F.get("pieces", i + 1), F.lit("")), 1, size - step))))
    texts = F.filter(F.slice(whole, 1, F.col("n")), lambda x: x != "")
    made = pieces.select("id", "content_hash", F.when(F.size("pieces") == 0, F.array(F.lit(""))).otherwise(texts).alias("texts"))
    # An outer explode: the filter that an inner one infers would be pushed down and cut every text again.
    df = made.select("id", "content_hash", F.size("texts").alias("chunk_count"), F.posexplode_outer("texts").alias("chunk_index", "text"))
    return df.select(F.concat_ws("::", "id", F.lit("chunk"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", F.col("id").alias("parent_doc_id"), "chunk_index", "chunk_count", "content_hash")


def upsert(base: DataFrame, patch: DataFrame, order: str = "seq", keep_created: bool = True) -> DataFrame:
    """``base`` with the last patch row of each id: null fields keep the old value, metadata is merged.

    A changed text renews the columns derived from it; ``keep_created`` is the update rule, without it
    the creation time is the patch's.
    """
    last = patch.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    b, p = base.alias("b"), last.alias("p")
    new = lambda c: F.coalesce(F.col(f"p.{c}"), F.col(f"b.{c}"))
    text = new("text")
    merged = F.map_zip_with(F.coalesce("b.metadata", F.create_map().cast("map<string,string>")), F.coalesce("p.metadata", F.create_map().cast("map<string,string>")), lambda k, x, y: F.coalesce(y, x))
    created = F.coalesce("b.created_at", "p.created_at") if keep_created else F.coalesce("p.created_at", "b.created_at")
    return b.join(p, F.col("b.id") == F.col("p.id"), "full_outer").select(
        new("id").alias("id"), new("title").alias("title"), text.alias("text"), new("category").alias("category"), merged.alias("metadata"), F.sha2(text, 256).alias("content_hash"),
        created.alias("created_at"), new("updated_at").alias("updated_at"), word_count(text).alias("word_count"), F.length(text).alias("char_count"),
    )


def delete(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def retained(docs: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """Documents not created more than ``days`` before ``now``; those with unreadable dates stay."""
    created = F.try_to_timestamp(F.col("created_at").cast("string"))
    return docs.where(created.isNull() | (created >= now - F.make_interval(days=F.lit(days))))


def sync_plan(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, action) of (id, content_hash) tables: new, changed, same or stale."""
    a, b = docs.select("id", F.col("content_hash").alias("h")), stored.groupBy("id").agg(F.max("content_hash").alias("old"))
    action = F.when(F.col("h").isNull(), "stale").when(F.col("old").isNull(), "new").when(F.col("h") != F.col("old"), "changed").otherwise("same")
    return a.join(b, "id", "full_outer").select("id", action.alias("action"))


def index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): added, removed or changed between two (id, content_hash) indexes.

    One aggregate over both: what each side says of an id is how often it stands there and a digest of its hashes,
    whatever their order, so repeated ids are compared as a whole.
    """
    side = lambda df, name: df.select("id", "content_hash", F.lit(name).alias("side"))
    both = side(before, "before").unionByName(side(after, "after"))
    told = lambda name: F.struct(*[f(F.when(F.col("side") == name, F.col("content_hash"))).alias(n) for n, f in (("n", F.count), ("least", F.min), ("most", F.max))], F.bit_xor(F.when(F.col("side") == name, F.xxhash64("content_hash"))).alias("mix"))
    seen = both.groupBy("id").agg(F.max(F.col("side") == "before").alias("was"), F.max(F.col("side") == "after").alias("stays"), told("before").alias("a"), told("after").alias("b"))
    change = F.when(~F.col("was"), "added").when(~F.col("stays"), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return seen.select("id", change.alias("change")).where("change is not null")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents, words and mean words for each category and, with a null category, in total."""
    return docs.rollup("category").agg(F.count("*").alias("documents"), F.sum("word_count").alias("words"), F.round(F.avg("word_count"), 4).alias("mean_words"), F.count_distinct("category").alias("categories"))


def unseen(texts: DataFrame, cache: DataFrame, limit: int = 1024) -> DataFrame:
    """(key, text): distinct texts, cut to ``limit`` characters, whose md5 is not in ``cache``."""
    cut = F.when(F.length("text") > limit, F.concat(F.substring("text", 1, limit), F.lit("..."))).otherwise(F.col("text"))
    return texts.select(F.md5("text").alias("key"), cut.alias("text")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def speaker_sessions(sessions: DataFrame, speakers: DataFrame) -> DataFrame:
    """(speaker_id, name, n_sessions, sessions) from the sessions' speaker lists."""
    each = sessions.select(F.col("id").alias("session_id"), F.explode("speakers").alias("speaker_id"))
    grouped = each.groupBy("speaker_id").agg(F.count("*").alias("n_sessions"), F.sort_array(F.collect_list("session_id")).alias("sessions"))
    return speakers.select(F.col("id").alias("speaker_id"), "name").join(grouped, "speaker_id", "left").select("speaker_id", "name", F.coalesce("n_sessions", F.lit(0)).cast("long").alias("n_sessions"), "sessions")


#: Schemas of the six nested corpus files.
SCHEMAS = {
    "schedule": "conference string, dates string, location string, days array<struct<date string, label string, blocks array<struct<time string, title string, location string, speaker string>>>>",
    "sessions": "sessions array<struct<id string, title string, track string, day int, time string, room string, type string, speakers array<string>, description string>>",
    "speakers": "speakers array<struct<id string, name string, title string, company string, bio string, sessions array<string>>>",
    "venues": "main_venue struct<name string, address string, levels array<struct<level string, areas array<string>>>, amenities array<string>>, hotels array<struct<name string, distance string, shuttle boolean, rate string>>, "
    "restaurants array<struct<name string, cuisine string, distance string, price string>>, transport struct<shuttle string, rideshare string, parking string, public_transit string>",
    "city": "city string, weather struct<july_average_high string, july_average_low string, conditions string>, emergency struct<event_security string, first_aid string, local_emergency string, nearest_hospital string, pharmacy string>, "
    "attractions array<struct<name string, type string, distance string, description string>>, tips array<string>",
    "architecture": "architecture array<struct<id string, text string, category string>>",
}


def _filled(name: str, *values: Column | str) -> Column:
    """A corpus template with its values; a null value is empty."""
    return F.format_string(V.CORPUS_TEXTS[name], *[F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")) for v in values])


def _named(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(name), " ", "_"))


def _documents(df: DataFrame, doc_id: Column, text: Column, **metadata: Column | str) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v.cast("string"))]
    return df.select(doc_id.alias("doc_id"), text.alias("text"), F.create_map(*pairs).alias("metadata"))


def schedule_documents(schedule: DataFrame) -> DataFrame:
    """(doc_id, text, metadata) of a schedule: an overview and one a block."""
    blocks = schedule.select(F.explode("days").alias("d")).select("d.date", "d.label", F.explode("d.blocks").alias("b")).select("date", "label", "b.*")
    text = F.concat(_filled("schedule_block", "label", "time", "title", "location"), F.when(F.col("speaker").isNotNull(), _filled("schedule_speaker", "speaker")).otherwise(F.lit("")))
    key = F.concat(F.lit("sched_"), "date", F.lit("_"), F.replace(F.replace("time", F.lit(":"), F.lit("")), F.lit("-"), F.lit("_")))
    whole = _documents(schedule, F.lit("schedule_overview"), _filled("schedule_overview", "conference", "dates", "location"), category="schedule", priority="high")
    return whole.unionByName(_documents(blocks, key, text, category="schedule", day=F.col("date")))


def session_documents(sessions: DataFrame) -> DataFrame:
    """(doc_id, text, metadata) of session rows."""
    return _documents(sessions, F.col("id"), _filled("session", "title", "track", "day", "time", "room", "type", "description"), category="sessions", track=F.col("track"), type=F.col("type"))


def speaker_documents(speakers: DataFrame) -> DataFrame:
    """(doc_id, text, metadata) of speaker rows."""
    return _documents(speakers, F.col("id"), _filled("speaker", "name", "title", "company", "bio", F.greatest(F.size("sessions"), F.lit(0))), category="speakers", company=F.col("company"))


def venue_documents(venues: DataFrame) -> DataFrame:
    """(doc_id, text, metadata) of a venue file: the main venue, levels, hotels, restaurants, transport."""
    main = venues.select("main_venue.*")
    level = main.select(F.explode("levels").alias("x")).select("x.*")
    hotel, food = (venues.select(F.explode(c).alias("x")).select("x.*") for c in ("hotels", "restaurants"))
    shuttle = F.when(F.col("shuttle"), F.lit(V.CORPUS_TEXTS["shuttle"])).otherwise(F.lit(""))
    parts = [
        _documents(main, F.lit("venue_main"), _filled("venue", "name", "address", F.array_join("amenities", "; ")), category="venue"),
        _documents(level, F.concat(F.lit("venue_level_"), "level"), _filled("level", "level", F.array_join("areas", ", ")), category="venue"),
        _documents(hotel, _named("hotel_", "name"), _filled("hotel", "name", "distance", shuttle, "rate"), category="hotels"),
        _documents(food, _named("food_", "name"), _filled("restaurant", "name", "cuisine", "distance", "price"), category="food"),
        _documents(venues.select("transport.*"), F.lit("transport_info"), _filled("transport", "shuttle", "rideshare", "parking", "public_transit"), category="transport"),
    ]
    return reduce(DataFrame.unionByName, parts)


def city_documents(city: DataFrame) -> DataFrame:
    """(doc_id, text, metadata) of a city guide: weather, emergency, attractions, tips."""
    sight, tip = city.select(F.explode("attractions").alias("x")).select("x.*"), city.select(F.posexplode("tips").alias("i", "tip"))
    parts = [
        _documents(city.select("city", "weather.*"), F.lit("city_weather"), _filled("weather", "city", "july_average_high", "july_average_low", "conditions"), category="weather"),
        _documents(city.select("emergency.*"), F.lit("city_emergency"), _filled("emergency", "event_security", "first_aid", "local_emergency", "nearest_hospital", "pharmacy"), category="emergency", priority="high"),
        _documents(sight, _named("attraction_", "name"), _filled("attraction", "name", "type", "distance", "description"), category="attractions"),
        _documents(tip, F.concat(F.lit("tip_"), F.col("i").cast("string")), F.col("tip"), category="tips"),
    ]
    return reduce(DataFrame.unionByName, parts)


def architecture_documents(entries: DataFrame) -> DataFrame:
    """(doc_id, text, metadata) of architecture rows."""
    return _documents(entries, F.col("id"), F.col("text"), category=F.coalesce("category", F.lit("architecture")))


def corpus_documents(files: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, text, metadata) of the six corpus files, as ``read_corpus`` gives them."""
    rows = lambda name: files[name].select(F.explode(name).alias("x")).select("x.*")
    parts = [
        schedule_documents(files["schedule"]), session_documents(rows("sessions")), speaker_documents(rows("speakers")),
        venue_documents(files["venues"]), city_documents(files["city"]), architecture_documents(rows("architecture")),
    ]
    return reduce(DataFrame.unionByName, parts)


def read_corpus(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A nested JSON document of the kind ``name`` of SCHEMAS; one row a file."""
    return spark.read.schema(SCHEMAS[name]).option("multiLine", True).json(path)


def export_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)


def import_documents(base: DataFrame, path: str) -> DataFrame:
    """``base`` with the rows of an export; rows of equal id are the export's."""
    new = base.sparkSession.read.parquet(path)
    return delete(base, new).unionByName(new, allowMissingColumns=True)
