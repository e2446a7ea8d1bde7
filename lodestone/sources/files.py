"""File, cache and REST sources as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import MIME_TYPES, duration_seconds, extension, format_seconds, mime_type
from lodestone.operators.joins import label

CONTENT = ["pdf", "txt", "md", "html", "xml", "json", "csv"]
DOCUMENTS = ["pdf", "txt", "md", "html", "xml"]
VIDEOS = [k for k, v in MIME_TYPES.items() if v.startswith("video/")]
#: Video category ids and their labels.
VIDEO_CATEGORIES = {"1": "Film & Animation", "2": "Autos & Vehicles", "10": "Music", "15": "Pets & Animals", "17": "Sports", "20": "Gaming", "22": "People & Blogs", "23": "Comedy", "24": "Entertainment", "25": "News & Politics", "26": "Howto & Style", "27": "Education", "28": "Science & Technology"}


def scan_directory(spark: SparkSession, folder: str, extensions: list[str], glob: str = "*", most: int = 50, content: bool = False) -> DataFrame:
    """path, length, mime[, content] of a folder's files with one of the extensions: sorted, at most ``most``.

    Contents are only read where they are asked for; columns are pruned at the source.
    """
    own = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    own = own.filter(extension(F.col("path")).isin(extensions))
    return own.select("path", "length", mime_type(F.col("path")).alias("mime"), *(["content"] if content else [])).orderBy("path").limit(most)


def scan_paths(spark: SparkSession, paths: list[str], extensions: list[str]) -> DataFrame:
    """n, path, length, mime of listed files in the given order; others than ``extensions`` are dropped, a missing one raises."""
    if not paths:
        return spark.createDataFrame([], "n long, path string, length long, mime string")
    listed = spark.createDataFrame(list(enumerate(paths)), "n long, asked string").withColumn("key", F.regexp_replace("asked", "^file:/*", "/"))
    found = spark.read.format("binaryFile").load(list(dict.fromkeys(paths))).select("path", "length").withColumn("key", F.regexp_replace("path", "^file:/*", "/"))
    own = listed.join(found, "key").filter(extension(F.col("path")).isin(extensions))
    return own.select("n", "path", "length", mime_type(F.col("path")).alias("mime")).orderBy("n")


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON or CSV file; what doesn't fit the schema is kept in _corrupt_record."""
    full = f"{schema}, _corrupt_record string"
    if path.endswith(".csv"):
        return spark.read.schema(full).option("header", True).option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def dotenv_lines(spark: SparkSession, path: str) -> DataFrame:
    """n, line of a small settings file; Spark's readers skip names with a leading dot, so the driver opens it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.createDataFrame(list(enumerate(text.splitlines())), "n int, line string")


def parse_dotenv(lines: DataFrame) -> DataFrame:
    """name, value of lines (n, line): comments and export, quotes taken off; the last of equal names."""
    pattern = "^\\s*(?:export\\s+)?([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*?)\\s*$"
    own = lines.select("n", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("v")).filter("name <> ''")
    quoted = F.col("v").rlike("^\".*\"$") | F.col("v").rlike("^'.*'$")
    value = F.when(quoted, F.substring(F.col("v"), F.lit(2), F.length("v") - 2)).otherwise(F.col("v"))
    return own.groupBy("name").agg(F.max_by(value, "n").alias("value"))


ENVELOPE = "cached_at string, content_id string, tool string, model string"


def cache_entries(files: DataFrame) -> DataFrame:
    """Readable cache files (file, body), the newest first, those without a time last."""
    own = files.filter(F.try_parse_json("body").isNotNull()).withColumn("e", F.from_json("body", ENVELOPE)).withColumn("analysis", F.get_json_object("body", "$.analysis"))
    return own.select("file", "e.*", F.coalesce("analysis", "body").alias("analysis")).orderBy(F.coalesce("cached_at", F.lit("")).desc(), "file")


def cache_lookup(entries: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """Entries that are no older than the TTL at ``now``."""
    age = F.unix_seconds(F.to_timestamp(F.lit(now))) - F.unix_seconds(F.try_to_timestamp("cached_at"))
    return entries.filter(age <= ttl_seconds)


def registry_entries(files: DataFrame) -> DataFrame:
    """content_id, model, name of nested JSON maps (body); values of another type are ignored."""
    top = files.select(F.explode(F.from_json("body", "map<string,string>")).alias("content_id", "inner"))
    inner = top.select("content_id", F.explode(F.from_json("inner", "map<string,string>")).alias("model", "name"), "inner")
    text = F.schema_of_variant(F.variant_get(F.try_parse_json("inner"), F.concat(F.lit("$['"), F.col("model"), F.lit("']")), "variant")) == "STRING"
    return inner.filter(text).select("content_id", "model", "name")


VIDEO = "items array<struct<id string, snippet struct<title string, channelTitle string, categoryId string, tags array<string>>, contentDetails struct<duration string, caption string>, statistics struct<viewCount string, likeCount string, commentCount string>>>"


def video_rows(responses: DataFrame) -> DataFrame:
    """Flat rows of video responses (body); missing counts are 0."""
    i = responses.select(F.explode(F.from_json("body", VIDEO)["items"]).alias("i")).select("i.*")
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)).alias
    own = i.select(F.col("id").alias("video_id"), F.col("snippet.title").alias("title"), F.col("snippet.channelTitle").alias("channel_title"), F.col("snippet.categoryId").alias("__c"), F.col("snippet.tags").alias("tags"), number("statistics.viewCount")("view_count"), number("statistics.likeCount")("like_count"), number("statistics.commentCount")("comment_count"), duration_seconds(F.col("contentDetails.duration")).alias("duration_seconds"), (F.lower("contentDetails.caption") == "true").alias("has_captions"))
    return own.select("video_id", "title", "channel_title", label(own, "__c", VIDEO_CATEGORIES).alias("category"), "tags", "view_count", "like_count", "comment_count", "duration_seconds", format_seconds(F.col("duration_seconds")).alias("duration_display"), "has_captions")


PLAYLIST = "pageInfo struct<totalResults bigint>, items array<struct<snippet struct<title string, position bigint, resourceId struct<videoId string>>>>"


def playlist_rows(responses: DataFrame, most: int = 50) -> DataFrame:
    """position, video_id, title of playlist pages (body), at most ``most``."""
    s = responses.select(F.explode(F.from_json("body", PLAYLIST)["items"]).alias("i")).select("i.snippet.*")
    return s.select("position", F.col("resourceId.videoId").alias("video_id"), "title").orderBy("position").limit(most)


COMMENTS = "items array<struct<snippet struct<topLevelComment struct<snippet struct<textDisplay string, likeCount bigint, authorDisplayName string>>>>>"


def comment_rows(responses: DataFrame, most: int = 200) -> DataFrame:
    """n (from 0), text, likes, author of comment pages (page, body) in their order, at most ``most`` of a video."""
    own = responses.select("page", F.posexplode(F.from_json("body", COMMENTS)["items"]).alias("at", "i"))
    own = own.select("page", "at", "i.snippet.topLevelComment.snippet.*").orderBy("page", "at").limit(most)  # a few pages
    n = (F.row_number().over(Window.orderBy("page", "at")) - 1).alias("n")
    return own.select(n, F.coalesce("textDisplay", F.lit("")).alias("text"), F.coalesce("likeCount", F.lit(0)).alias("likes"), F.coalesce("authorDisplayName", F.lit("")).alias("author"))


def entry_blocks(lines: DataFrame, kind: str) -> DataFrame:
    """entry (from 1), name, value of the entries in a text file (n, line): 'yaml' lists of flat maps, or 'markdown' headings with bullets.

    An entry begins at a dash (yaml) or a second-level heading (markdown, its text being the title); 'name: value' lines belong to
    the entry before them.  A file is one object, so its lines are numbered in one window.
    """
    begins = "^- " if kind == "yaml" else "^## "
    own = lines.withColumn("entry", F.sum(F.col("line").rlike(begins).cast("int")).over(Window.orderBy("n"))).filter("entry > 0")
    titled = F.when(F.lit(kind == "markdown") & F.col("line").rlike(begins), F.concat(F.lit("title: "), F.regexp_replace("line", begins, ""))).otherwise(F.col("line"))
    pattern = "^(?:- |\\s*)(?:[-*] )?([A-Za-z_][A-Za-z0-9_]*):\\s*(.*?)\\s*$"
    own = own.select("entry", F.regexp_extract(titled, pattern, 1).alias("name"), F.regexp_extract(titled, pattern, 2).alias("value"))
    return own.filter("name <> ''").withColumn("value", F.regexp_replace("value", "^([\"'])(.*)\\1$", "$2"))


OUTPUTS = "array<struct<text string, content array<struct<type string, text string>>>>"


def report_texts(df: DataFrame) -> DataFrame:
    """id, report: the texts of nested outputs (JSON), joined by a blank line."""
    o = F.from_json("outputs", OUTPUTS)
    inner = lambda x: F.transform(F.filter(F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string>>")), lambda c: c["type"] == "text"), lambda c: c["text"])
    parts = F.flatten(F.transform(o, lambda x: F.when(F.coalesce(x["text"], F.lit("")) != "", F.array(x["text"])).otherwise(inner(x))))
    return df.select("id", F.array_join(parts, "\n\n").alias("report"))


#: Steps of a video project in order, with the file that shows that a step is done.
PROJECT_STEPS = [("script", "script/script.json"), ("narration", "narration/narrations.json"), ("scenes", "scenes/index.ts"), ("voiceover", "voiceover/manifest.json"), ("storyboard", "storyboard/storyboard.json"), ("render", "output/final.mp4")]


def project_status(listing: DataFrame, steps: list[tuple[str, str]] = PROJECT_STEPS) -> DataFrame:
    """project, n, step, completed for every project of a listing (project, file) and every step; hidden projects are skipped."""
    own = listing.filter(~F.col("project").startswith("."))
    dim = own.sparkSession.createDataFrame([(i, s, f) for i, (s, f) in enumerate(steps)], "n int, step string, file string")
    done = own.join(F.broadcast(dim), "file").select("project", "step").distinct().withColumn("__d", F.lit(True))  # a few steps
    every = own.select("project").distinct().crossJoin(F.broadcast(dim.select("n", "step")))
    return every.join(done, ["project", "step"], "left").select("project", "n", "step", F.coalesce("__d", F.lit(False)).alias("completed"))


def project_list(status: DataFrame) -> DataFrame:
    """project, completed_steps, steps, rendered."""
    render = F.bool_or((F.col("step") == "render") & F.col("completed"))
    return status.groupBy("project").agg(F.count_if("completed").alias("completed_steps"), F.count("*").alias("steps"), render.alias("rendered"))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file from the driver: whole under a temporary name, which then replaces the file in one step."""
    jvm = spark._jvm
    tmp, final = jvm.org.apache.hadoop.fs.Path(path + ".tmp"), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(tmp), fs.makeQualified(final), replace)
