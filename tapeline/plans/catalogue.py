"""All queries over the fixture tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import kinds, loglines, paths
from tapeline.functions.text import LINE_BREAKS, LOG_SPACE, STRIPPED, clamp, default_text, yaml_quote
from tapeline.functions.timecode import frames, from_frames, timecode, to_frames
from tapeline.operators import links, logs, selection, transcript
from tapeline.operators.recognise import recognise
from tapeline.plans.adapters import event_lines, line_sql, segments, table
from tapeline.schemas import Settings
from tapeline.sinks.markdown import write_markdown
from tapeline.sources import media
from tapeline.sources.results import parse_results
from tapeline.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CREATED = "2024-01-02 03:04:05"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _chars(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


def _tc(x: str) -> str:
    f = f"CAST(round_even((CASE WHEN ({x}) IS NULL OR isnan({x}) OR ({x}) < 0 THEN 0 ELSE ({x}) END) * 25, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d:%02d', {f} // 90000, {f} // 1500 % 60, {f} // 25 % 60, {f} % 25)"


def _strip(x: str) -> str:
    return f"trim({x}, {_chars(STRIPPED)})"


def _quote(x: str) -> str:
    return f"""('"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"')"""


@query(f"SELECT event_id, value, {_tc('value')} AS timecode FROM events")
def timecode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value", timecode(F.col("value")).alias("timecode"))


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, {_tc('l_extendedprice')} AS timecode FROM lineitem")
def timecode_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", timecode(F.col("l_extendedprice")).alias("timecode"))


@query(
    f"SELECT o_orderkey, {_tc('o_totalprice')} AS timecode, CAST(round_even(o_totalprice * 25, 0) AS BIGINT) AS frames, TRUE AS inverts FROM orders"
)
def timecode_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(F.col("o_totalprice"))
    tc = from_frames(f)
    return table(spark, sf_dir, "orders").select("o_orderkey", tc.alias("timecode"), f.alias("frames"), (to_frames(tc) == f).alias("inverts"))


_SEGMENTS = f"""
WITH s AS (
  SELECT conv_id AS file_index, turn AS segment_index, {_strip("coalesce(text, '')")} AS text, length(text) * 60 AS ms,
         sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn) AS upto
  FROM conversations
), t AS (
  SELECT file_index, segment_index, CAST((upto - ms) / 1000 AS DOUBLE) AS start, CAST(upto / 1000 AS DOUBLE) AS "end", text FROM s WHERE text <> ''
), p AS (
  SELECT *, {_tc("start")} AS start_tc, {_tc('"end"')} AS end_tc FROM t
), b AS (SELECT *, start_tc || ' - ' || end_tc || chr(10) || text AS block FROM p)
"""


@query(_SEGMENTS + "SELECT * FROM b")
def segments_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.prepare(segments(spark, sf_dir))


@query(_SEGMENTS + "SELECT file_index, count(*) AS n_blocks, string_agg(block, chr(10) || chr(10) ORDER BY segment_index) AS timed FROM b GROUP BY file_index")
def transcript_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.bodies(transcript.prepare(segments(spark, sf_dir)), "file_index")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_index, path, timed, full_text of each conversation."""
    rows = transcript.prepare(segments(spark, sf_dir))
    path = F.concat(F.lit("/media/day "), (F.col("file_index") % 7).cast("string"), F.lit('/conv"'), F.floor(F.col("file_index") / 2).cast("string"), F.when(F.col("file_index") % 2 == 0, ".mp3").otherwise(".mov"))
    got = rows.groupBy("file_index").agg(transcript.joined("segment_index", "block", r"\n\n").alias("timed"), transcript.joined("segment_index", "text", " ").alias("full_text"))
    return got.withColumn("path", path)


@query(_SEGMENTS + f"SELECT file_index, {_strip("string_agg(text, ' ' ORDER BY segment_index)")} AS body FROM b GROUP BY file_index")
def transcript_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_index", transcript.chosen_body(F.col("timed"), F.col("full_text"), wanted=False).alias("body"))


_DOCUMENT = f"""
, f AS (
  SELECT file_index, string_agg(block, chr(10) || chr(10) ORDER BY segment_index) AS timed,
         'conv"' || CAST(file_index // 2 AS VARCHAR) AS stem, CASE WHEN file_index % 2 = 0 THEN '.mp3' ELSE '.mov' END AS ext
  FROM b GROUP BY file_index
), d AS (
  SELECT file_index, '/out/' || stem || '.md' AS output_path,
    '---' || chr(10) || 'created: "2024-01-02 03:04"' || chr(10) || 'model: "large"' || chr(10) || 'device: "cpu"' || chr(10)
    || 'source_file: ' || {_quote("stem || ext")} || chr(10) || 'fps_timecode: 25' || chr(10) || 'timecodes: true' || chr(10) || '---' || chr(10) || chr(10)
    || '# Transkript: ' || stem || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {_strip("timed")} || chr(10) AS content
  FROM f
)
SELECT output_path, max(file_index) AS file_index, arg_max(content, file_index) AS content, count(*) - 1 AS overwritten FROM d GROUP BY output_path
"""


@query(_SEGMENTS + _DOCUMENT)
def transcript_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.render(_files(spark, sf_dir), Settings(output_folder="/out"), F.lit(CREATED).cast("timestamp"))


@query(f"SELECT doc_id, {_quote('text')} AS quoted FROM documents")
def yaml_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", yaml_quote(F.col("text")).alias("quoted"))


_PATHS = """
WITH b AS (SELECT page_id, url, regexp_replace(url, '(.)/+$', '\\1') AS bare FROM pages),
n AS (SELECT *, list_extract(string_split(bare, '/'), -1) AS name, regexp_replace(bare, '/[^/]*$', '') AS folder FROM b),
p AS (SELECT *, CASE WHEN regexp_extract(name, '(?s)^(.+)\\.[^.]+$', 1) <> '' THEN regexp_extract(name, '(?s)^(.+)\\.[^.]+$', 1) ELSE name END AS stem FROM n)
"""


@query(
    _PATHS + "SELECT page_id, name, stem, regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1) AS suffix, folder, folder || '/' || stem || '.md' AS target, name || '    ' || folder AS display FROM p"
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", paths.name(url).alias("name"), paths.stem(url).alias("stem"), paths.suffix(url).alias("suffix"), paths.folder(url).alias("folder"), paths.target(url).alias("target"), paths.display(url).alias("display")
    )


@query(_PATHS + "SELECT '/out/' || stem || '.md' AS output_path, max(page_id) AS page_id, arg_max(url, page_id) AS url, count(*) - 1 AS overwritten FROM p GROUP BY 1")
def output_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", paths.target(F.col("url"), F.lit("/out")).alias("output_path"))
    return transcript.keep_last(rows, "output_path", "page_id")


def selection_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a label are selected already; all documents are chosen now. The text is the key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.join(labels, "doc_id", "left_semi"), docs


_SELECTION = """
WITH e AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
a AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), n AS (SELECT * FROM a WHERE text NOT IN (SELECT text FROM e))
"""


@query(_SELECTION + "SELECT doc_id, length(text) AS chars FROM n")
def selection_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, chosen = selection_tables(spark, sf_dir)
    return selection.additions(existing, chosen, "text", "doc_id").select("doc_id", F.length("text").cast("long").alias("chars"))


@query(_SELECTION + "SELECT doc_id, row_number() OVER (ORDER BY part, doc_id) AS file_index FROM (SELECT doc_id, 0 AS part FROM e UNION ALL SELECT doc_id, 1 AS part FROM n)")
def selection_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, chosen = selection_tables(spark, sf_dir)
    return selection.append(existing, chosen, "text", "doc_id").select("doc_id", "file_index")


@query("SELECT source, count(*) AS n, CASE count(*) WHEN 1 THEN '1 file selected' ELSE CAST(count(*) AS VARCHAR) || ' files selected' END AS label FROM documents GROUP BY source")
def selection_count_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.count_text(table(spark, sf_dir, "documents"), "source")


_I, _N = "row_number() OVER (PARTITION BY conv_id ORDER BY turn)", "count(*) OVER (PARTITION BY conv_id)"


@query(f"SELECT conv_id, turn, CAST({_I} AS VARCHAR) || '/' || CAST({_N} AS VARCHAR) AS label, {_I} < {_N} AS waits FROM conversations")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.progress(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query(
    """
WITH c AS (SELECT s_nationkey, min(s_suppkey) FILTER (WHERE s_acctbal > 5000) AS at, arg_min(s_name, s_suppkey) FILTER (WHERE s_acctbal > 5000) AS chosen FROM supplier GROUP BY 1)
SELECT c.s_nationkey, c.chosen, coalesce(string_agg(s.s_name, chr(10) ORDER BY s.s_suppkey), '') AS rejected
FROM c LEFT JOIN supplier s ON s.s_nationkey = c.s_nationkey AND s.s_acctbal <= 5000 AND (c.at IS NULL OR s.s_suppkey < c.at) GROUP BY 1, 2
"""
)
def first_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_candidate(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name", F.col("s_acctbal") > 5000)


@query(
    f"""SELECT event_id, coalesce(nullif({_strip("CASE WHEN event_type = 'view' THEN chr(160) ELSE ' ' || event_type END")}, ''), 'large') AS model_name,
least(60, greatest(0, CAST(floor(value) AS INTEGER) - 20)) AS buffer_seconds, CASE WHEN event_type = 'click' THEN NULL ELSE '/out' END AS output_folder,
event_type IN ('de', 'en') AS language_ok FROM events"""
)
def settings_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        default_text(F.when(kind == "view", "\xa0").otherwise(F.concat(F.lit(" "), kind)), "large").alias("model_name"),
        clamp(F.floor("value").cast("int") - 20, 0, 60).alias("buffer_seconds"),
        F.when(kind != "click", "/out").alias("output_folder"),
        kind.isin("de", "en").alias("language_ok"),
    )


_BREAK = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in LINE_BREAKS) + "]"


@query(
    f"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '{_BREAK}') AS parts FROM documents),
u AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line_no, unnest(parts) AS line FROM l)
SELECT doc_id, line_no, trim(line, {_chars(LOG_SPACE)}) AS line FROM u WHERE trim(line, {_chars(LOG_SPACE)}) <> ''"""
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


ROUTED = f"""
WITH e AS ({line_sql()}), c AS (SELECT event_id, ts, user_id, trim(line, {_chars(LOG_SPACE)}) AS line FROM e),
k AS (SELECT *, contains(line, '%|') OR contains(line, 'frames/s]') OR contains(line, 'it/s]') AS progress, lower(line) AS low,
  regexp_extract(line, '(?:^|[^0-9])([0-9]{{1,3}}%)', 1) AS pct, regexp_extract(line, '<([^,\\]]+)', 1) AS eta FROM c),
r AS (SELECT event_id, ts, user_id, line, CASE WHEN progress THEN 'progress' ELSE 'log' END AS route,
  CASE WHEN progress THEN NULL WHEN contains(low, 'error') OR contains(low, 'failed') OR contains(low, 'traceback') THEN 'error'
       WHEN contains(low, 'saved:') OR contains(low, 'complete') OR contains(low, 'loaded') THEN 'success' ELSE 'info' END AS kind,
  CASE WHEN NOT progress THEN line WHEN pct = '' THEN 'Transcribing...' WHEN eta = '' THEN 'Transcribing... ' || pct ELSE 'Transcribing... ' || pct || ', ETA ' || eta END AS message FROM k)
"""


def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.routed(logs.split_lines(event_lines(spark, sf_dir), "line")).drop("line_no")


@query(ROUTED + "SELECT event_id, line, route, kind, message FROM r")
def log_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_events(spark, sf_dir).select("event_id", "line", "route", "kind", "message")


@query(
    ROUTED
    + "SELECT event_id, '[' || strftime(ts, '%H:%M:%S') || '] ' || CASE kind WHEN 'success' THEN 'OK' WHEN 'error' THEN 'ERROR' ELSE 'INFO' END || ': ' || message || chr(10) AS formatted FROM r WHERE route = 'log'"
)
def log_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.log_rows(routed_events(spark, sf_dir))
    return rows.select("event_id", loglines.formatted(F.col("ts"), F.col("kind"), F.col("message")).alias("formatted"))


@query(
    """WITH p AS (SELECT event_id, event_type || '|' || coalesce(props, '') || '|' || CAST(user_id AS VARCHAR) AS payload FROM events)
SELECT event_id, substr(payload, 1, position('|' IN payload) - 1) AS level, substr(payload, position('|' IN payload) + 1) AS message FROM p"""
)
def log_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = F.lit("|")
    payload = F.concat("event_type", bar, F.coalesce("props", F.lit("")), bar, F.col("user_id").cast("string"))
    return logs.decoded(table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))).select("event_id", "level", "message")


_LATEST = ROUTED + "SELECT user_id, arg_max(message, event_id) AS message, max(event_id) AS event_id FROM r WHERE route = 'progress' GROUP BY user_id"


@query(_LATEST)
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(routed_events(spark, sf_dir).where("route = 'progress'"), "user_id", "event_id")


@query(
    """SELECT conv_id, ['--language', 'en', '--model', 'large', '--buffer', '2', '--timecodes', '--output-dir', '/out'] || flatten(list(['--file', 'turn-' || CAST(turn AS VARCHAR)] ORDER BY turn)) AS arguments
FROM conversations GROUP BY conv_id"""
)
def run_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    files = F.transform("turns", lambda t: F.concat(F.lit("turn-"), t.cast("string")))
    return turns.select("conv_id", transcript.arguments(Settings(language="en", output_folder="/out"), files).alias("arguments"))


@query()
def transcribe_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_index"), F.col("url").alias("path"))
    rows = transcript.explode_results(recognise(pages, Settings(language="en")).drop("error", "device", "created"))
    return transcript.prepare(rows).select("file_index", "segment_index", "block")


@query(
    """WITH k AS (SELECT page_id, page_id % 5 AS k, 'd' || CAST(page_id AS VARCHAR) AS d FROM pages)
SELECT page_id, CASE k WHEN 0 THEN '/base/' || d || '/a.mp3' WHEN 1 THEN '/' || d || '/b' WHEN 2 THEN '/base/c' WHEN 3 THEN '/' || d ELSE '/base/' || d END AS absolute FROM k"""
)
def paths_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.concat(F.lit("d"), F.col("page_id").cast("string"))
    spelled = [
        F.concat(F.lit("./"), d, F.lit("//x/../a.mp3")), F.concat(F.lit("/"), d, F.lit("/./b/")), F.concat(d, F.lit("/../c")), F.concat(F.lit("../../../"), d), d,
    ]
    path = F.get(F.array(*spelled), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", paths.absolute(path, "/base").alias("absolute"))


@query(
    """SELECT part, count(*) AS files, string_agg(name, chr(10) ORDER BY name) AS names FROM (
  SELECT CASE p_partkey % 4 WHEN 0 THEN 'p' || p_partkey || '.MP3' WHEN 1 THEN 'p' || p_partkey || '.mov' WHEN 2 THEN 'p' || p_partkey || '.txt' ELSE 'p' || p_partkey END AS name,
         p_partkey % 4 AS kind, p_partkey % 3 AS part FROM part) WHERE kind < 2 GROUP BY part"""
)
def media_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files by extension, described, in order of their names."""
    ending = F.get(F.array(F.lit(".MP3"), F.lit(".mov"), F.lit(".txt"), F.lit("")), (F.col("p_partkey") % 4).cast("int"))
    path = F.concat(F.lit("/media/"), (F.col("p_partkey") % 3).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"), ending)
    rows = media.described(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_index"), path.alias("path")).where(paths.is_media(F.col("path"))))
    found = rows.groupBy(paths.name(F.col("folder")).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("files"), transcript.joined("name", "name", r"\n").alias("names"))
    return found.select("part", "files", "names")


@query("SELECT conv_id AS file_index, CAST(turn - min(turn) OVER (PARTITION BY conv_id) AS INTEGER) AS segment_index, 0.0::DOUBLE AS start, coalesce(text, '') AS text FROM conversations")
def results_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as results in JSON, read back with defaults for what is missing."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    as_json = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["text"].alias("text"))).alias("segments")))
    rows = parse_results(turns.select(F.col("conv_id").alias("file_index"), as_json.alias("json")))
    return transcript.explode_results(rows).select("file_index", "segment_index", "start", "text")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'The helper of the run is missing.' WHEN 1 THEN 'No usable interpreter among: ' || event_type WHEN 2 THEN 'The run ended with code ' || event_type
  ELSE 'Error: ' || event_type || chr(10) || 'at ' || CAST(user_id AS VARCHAR) END AS messages FROM events"""
)
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.get(F.array(*map(F.lit, ("helper", "interpreter", "exit", "other"))), (F.col("event_id") % 4).cast("int"))
    trace = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("at "), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(loglines.error_rows(case, F.col("event_type"), trace), "\n").alias("messages"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS message FROM documents")
def chunks_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary chunks as text; every third is spoiled and drops out as null."""
    chunk = F.encode("text", "UTF-8")
    spoiled = F.concat(chunk, F.unhex(F.lit("FF")))
    return table(spark, sf_dir, "documents").select("doc_id", loglines.decoded(F.when(F.col("doc_id") % 3 == 0, spoiled).otherwise(chunk)).alias("message"))


@query("SELECT count(*) AS n, 'No files selected' AS label FROM documents WHERE FALSE")
def selection_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.count_text(selection.cleared(table(spark, sf_dir, "documents")))


@query(_SEGMENTS + _DOCUMENT.replace("SELECT output_path, max(file_index) AS file_index, arg_max(content, file_index) AS content, count(*) - 1 AS overwritten FROM d GROUP BY output_path", "SELECT output_path, arg_max(content, file_index) AS content FROM d GROUP BY output_path"))
def documents_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as Markdown files, one a row, read back whole."""
    root = work_path(spark, "documents")
    write_markdown(transcript_document(spark, sf_dir), root)
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
    return rows.select(F.concat(F.lit("/out/"), paths.name(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))).alias("output_path"), F.col("value").alias("content"))


@query(
    f"""WITH e AS ({line_sql()}) SELECT trim(line, {_chars(LOG_SPACE)}) AS line, count(*) AS n FROM e WHERE trim(line, {_chars(LOG_SPACE)}) <> '' GROUP BY 1"""
)
def log_text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines as text files, read as a stream of files to its end."""
    from tapeline.streaming.logs import read_lines

    source, out = work_path(spark, "text-lines"), work_path(spark, "text-log")
    event_lines(spark, sf_dir).where("line is not null").select("line").write.text(source)
    stream = logs.split_lines(read_lines(spark, source), "value").select("line")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "text-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("line string").parquet(out).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(_LATEST)
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, run to its end; the latest progress over all micro-batches."""
    source = work_path(spark, "log-lines")
    event_lines(spark, sf_dir).write.parquet(source)
    from tapeline.streaming.logs import transform, write_both

    schema = spark.read.parquet(source).schema
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(source), "line")
    log, progress = work_path(spark, "log-table"), work_path(spark, "progress-table")
    write_both(stream, log, progress, work_path(spark, "log-checkpoint"), "user_id", "event_id").awaitTermination()
    return logs.latest(spark.read.parquet(progress), "user_id", "event_id")


_FOLLOWED = """
WITH RECURSIVE l AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 30 = 10 THEN least(s_suppkey + 9, (SELECT max(s_suppkey) FROM supplier)) ELSE s_suppkey - 1 END AS t
  FROM supplier WHERE s_suppkey % 10 <> 0 OR s_suppkey % 30 = 10
), f(p, k, hops) AS (
  SELECT p_partkey, 1 + p_partkey % (SELECT count(*) FROM supplier), 0 FROM part
  UNION ALL SELECT p, t, hops + 1 FROM f JOIN l USING (k) WHERE hops <= 20
), e AS (SELECT p, arg_max(k, hops) AS k, max(hops) > 20 AS loop FROM f GROUP BY p)
SELECT p AS p_partkey, CASE WHEN NOT loop THEN '/s/n' || CAST(k AS VARCHAR) || '/p' || CAST(p AS VARCHAR) || '.mp3' END AS resolved, loop FROM e
"""


@query(_FOLLOWED)
def links_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of parts below folders of suppliers that are links to the one before, up to each tenth; some tens run in circles."""
    k, last = F.col("s_suppkey"), F.lit(table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0])
    at = F.when(k % 30 == 10, F.least(k + 9, last)).otherwise(k - 1)
    table_ = table(spark, sf_dir, "supplier").where((k % 10 != 0) | (k % 30 == 10))
    linked = table_.select(F.concat(F.lit("/s/n"), k.cast("string")).alias("link"), F.concat(F.lit("../s/n"), at.cast("string")).alias("target"))
    n = table(spark, sf_dir, "supplier").count()
    path = F.concat(F.lit("/./s/n"), (1 + F.col("p_partkey") % n).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".mp3"))
    return links.resolved(table(spark, sf_dir, "part").select("p_partkey", path.alias("path")), linked).select("p_partkey", "resolved", "loop")


_HEADS = {"524946460000000057415645": "wav", "5249464600000000415649204C495354": "avi", "00000018667479704D344120": "m4a", "0000001866747970": "mp4", "1A45DFA39F4286810142F7810142F2810442F381084282847765626D": "webm", "1A45DFA3": "mkv", "FFFB9064": "mp3", "2D2D2D": None}


@query(
    f"""SELECT p_partkey, CASE p_partkey % {len(_HEADS)} {" ".join(f"WHEN {i} THEN {'NULL' if k is None else repr(k)}" for i, k in enumerate(_HEADS.values()))} END AS kind,
lower(p_name[-3:]) IN ('wav', 'mp3') AS named FROM part"""
)
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by the first bytes: each part's name is the rest of a file that begins as one of several kinds."""
    head = F.get(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % len(_HEADS)).cast("int"))
    data = F.concat(F.unhex(head), F.encode("p_name", "UTF-8"))
    named = F.lower(F.right("p_name", F.lit(3))).isin("wav", "mp3")
    return table(spark, sf_dir, "part").select("p_partkey", kinds.kind(F.substring(data, 1, kinds.HEAD)).alias("kind"), named.alias("named"))
