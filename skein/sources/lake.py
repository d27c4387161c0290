"""Readers and writers of a lake of JSON Lines, JSON, Markdown and source files, transcripts and saved tables."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import extension

#: Suffixes that are read, folders that are not, the largest file, and categories by path in order.
SUFFIXES = (".md", ".txt", ".json", ".jsonl", ".py", ".ts", ".tsx", ".yaml", ".yml", ".toml")
SKIPPED = ("__pycache__", "node_modules", ".git", ".venv", "venv", ".next", "dist", "build", ".cache", "$RECYCLE.BIN", "System Volume Information")
MAX_BYTES = 5 * 1024 * 1024
#: Folders that a reader is given by name; beyond them it is given what is above all.
MAX_FOLDERS = 10_000
CATEGORY_PARTS = (("decision", "decision"), ("learning", "learning"), ("problem", "problem_solution"), ("solution", "problem_solution"), ("session", "conversation"), ("conversation", "conversation"), ("code-change", "code_change"), ("training", "training_data"), ("claude.md", "prompt_template"), ("readme", "documentation"))
CATEGORY_ENDS = ((".py", "code_python"), (".ts", "code_typescript"), (".tsx", "code_typescript"), (".js", "code_typescript"))
#: Least stripped lengths of typed log entries.
MIN_LENGTHS = {"reasoning": 100, "lesson_learned": 50, "description": 50, "how_fixed": 100}


def category(path: Column) -> Column:
    """What a file is about, by the first part that its lower-cased path holds."""
    low, out = F.lower(path), F.lit("other")
    for end, name in reversed(CATEGORY_ENDS):
        out = F.when(F.endswith(low, F.lit(end)), name).otherwise(out)
    for part, name in reversed(CATEGORY_PARTS):
        out = F.when(F.contains(low, F.lit(part)), name).otherwise(out)
    return out


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, suffix, category) of the files under `root` that are indexed; contents aren't read. A root that is missing has none."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    files = found.select("path", "length", F.col("modificationTime").alias("modified"))
    relative = F.replace("path", F.lit(root.rstrip("/")), F.lit(""))
    parts = F.split(relative, "/")
    listed = files.filter((F.col("length") <= MAX_BYTES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))))
    listed = listed.withColumn("suffix", F.lower(extension(F.col("path")))).filter(F.col("suffix").isin(*SUFFIXES))
    return listed.withColumn("category", category(relative))


def lake_stats(files: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension values or nulls, files, bytes) over all files and by each dimension on its own, in one pass."""
    sets = [[], *([F.col(d)] for d in dimensions)]
    return files.groupingSets(sets, *dimensions).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), *(F.grouping(d).cast("long").alias(f"all_{d}") for d in dimensions))


def search(files: DataFrame, query: str, limit: int = 50, **equal: str) -> DataFrame:
    """Files (path, content, …) whose path or content holds the query in any case; the limit is part of the feature.

    `equal` names columns, as category or lake, and the value that they must have.
    """
    q = F.lit(query.lower())
    for name, value in equal.items():
        files = files.filter(F.col(name) == value)
    return files.filter(F.contains(F.lower("path"), q) | F.contains(F.lower("content"), q)).orderBy("path").limit(limit)


def decode_objects(text: str) -> tuple[list[str], int]:
    """The JSON objects of a text that isn't one object a line, and how many times decoding had to find the next brace."""
    out, failures, at, decoder = [], 0, 0, json.JSONDecoder()
    while True:
        at = text.find("{", at)
        if at < 0:
            return out, failures
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            failures += 1
            at += 1
            continue
        out.append(json.dumps(value, ensure_ascii=False))
        at = end


def read_records(spark: SparkSession, path: str, first_line: bool = False, since: str | None = None) -> DataFrame:
    """(file, ord, record): the JSON objects of each file, as text, numbered in each file.

    A file is read by lines if its lines parse at least as often as not, or, with `first_line`, if its first line with
    content is an object; otherwise it is decoded as objects that follow one another, whatever the line ends. Files
    that were last changed before `since` are not read.
    """
    read = spark.read
    if since:
        read = read.option("modifiedAfter", since)
    read = read.option("recursiveFileLookup", True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, i, r) for f, v in zip(pdf["file"], pdf["value"], strict=True) for i, r in enumerate(records_of(v, first_line))]
            yield pd.DataFrame(rows, columns=["file", "ord", "record"])

    whole = read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.mapInPandas(run, "file string, ord long, record string")


def records_of(text: str, first_line: bool = False) -> list[str]:
    """The JSON objects of one file's text; see `read_records`."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    good, bad, first = [], 0, None
    for line in lines:
        try:
            value = json.loads(line)
        except ValueError:
            bad, first = bad + 1, False if first is None else first
            continue
        first = isinstance(value, dict) if first is None else first
        if isinstance(value, dict):
            good.append(line)
    if (first if first_line else good and len(good) >= bad):
        return good
    return decode_objects(text)[0]


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """`files` (path, suffix, …) with content as text, the parsed `record` of a .json file and the `n_records` of a .jsonl file.

    Bytes that are no UTF-8 are dropped; text that is no JSON has no record, lines that are none don't count. The
    listing is joined with its own folder's contents, so only listed files are read.
    """
    roots = [r["root"] for r in files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("root")).distinct().limit(MAX_FOLDERS + 1).collect()]
    if not roots:
        return files.select("*", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("record"), F.lit(None).cast("long").alias("n_records"))
    read = spark.read.format("binaryFile")
    if len(roots) > MAX_FOLDERS:
        # What the first and the last path share is above all others; of its files only the listed ones pass the join.
        ends = files.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
        read, roots = read.option("recursiveFileLookup", True), os.path.commonprefix([ends["a"], ends["b"]]).rpartition("/")[0]
    raw = read.load(roots).filter(F.col("length") <= MAX_BYTES).select("path", F.decode("content", "UTF-8").alias("content"))
    text = raw.withColumn("content", F.replace("content", F.lit("\ufffd"), F.lit("")))
    both = files.join(text, "path")
    parsed = F.when((F.col("suffix") == ".json") & F.try_parse_json("content").isNotNull(), F.col("content"))
    lines = F.filter(F.split("content", "\n"), lambda x: (F.trim(x) != "") & F.try_parse_json(x).isNotNull())
    return both.select("*", parsed.alias("record"), F.when(F.col("suffix") == ".jsonl", F.size(lines).cast("long")).alias("n_records"))


def of_category(files: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """The files of one category, the first `limit` by path if given (the limit is part of that reader)."""
    own = files.filter(F.col("category") == name)
    return own.orderBy("path").limit(limit) if limit else own


def captures_since(records: DataFrame, since: str | None) -> DataFrame:
    """Capture records (record) as columns, without those whose own time is before `since`; a time that can't be read stays."""
    schema = "id string, timestamp string, type string, tool string, project string, file_modified string, change_type string, description string, tags array<string>, tool_use_id string, transcript_path string, reasoning string, enrichment_confidence string"
    rows = records.select("file", "ord", F.from_json("record", schema).alias("r")).select("file", "ord", "r.*")
    if since is None:
        return rows
    return rows.filter(F.coalesce(F.try_to_timestamp("timestamp") >= F.lit(since).cast("timestamp"), F.lit(True)))


def index_rows(records: DataFrame, text_field: str = "output", category: str = "training", least: int = 50) -> DataFrame:
    """(text, source, category, project) of records (file, record) for the vector index.

    Texts under `least` characters are left out; an instruction turns the text into question and answer. The project is
    the first part of `source_file`.
    """
    j = lambda name: F.get_json_object("record", f"$.{name}")
    text, asked = F.coalesce(j(text_field), F.lit("")), F.coalesce(j("instruction"), F.lit(""))
    return records.filter(F.length(text) >= least).select(
        F.when(asked != "", F.concat(F.lit("Q: "), asked, F.lit("\nA: "), text)).otherwise(text).alias("text"),
        F.col("file").alias("source"),
        F.coalesce(j("category"), F.lit(category)).alias("category"),
        F.split_part(F.coalesce(j("source_file"), F.lit("")), F.lit("/"), F.lit(1)).alias("project"),
    )


def keyword_rows(records: DataFrame, least: int = 50) -> DataFrame:
    """(id, text, category) of records (record) for the keyword index: output, else text, under the instruction if there is one."""
    j = lambda name: F.coalesce(F.get_json_object("record", f"$.{name}"), F.lit(""))
    text = F.when(j("output") != "", j("output")).otherwise(j("text"))
    whole = F.when(j("instruction") != "", F.concat(j("instruction"), F.lit("\n"), text)).otherwise(text)
    return records.filter(F.length(text) >= least).select(F.substring(F.md5(whole.cast("binary")), 1, 12).alias("id"), whole.alias("text"), F.lit("training").alias("category"))


def last_files(files: DataFrame, n: int = 30) -> DataFrame:
    """The `n` files that come last by path: the number is part of that reader."""
    return files.orderBy(F.desc("path")).limit(n)


def text_of_content(content: Column, kind: str = "text") -> Column:
    """Of a message's content, a variant that is a string or an array of strings and blocks: its texts (or its blocks' `kind`), line by line.

    Blocks of other types are dropped; nothing left is an empty text.
    """
    blocks = F.try_variant_get(content, "$", "array<variant>")
    own = F.transform(blocks, lambda b: F.when(F.try_variant_get(b, "$.type", "string") == kind, F.try_variant_get(b, f"$.{kind}", "string")).when((F.schema_of_variant(b) == "STRING") & F.lit(kind == "text"), F.try_variant_get(b, "$", "string")))
    joined = F.array_join(F.filter(own, lambda x: x.isNotNull() & (x != "")), "\n")
    alone = F.try_variant_get(content, "$", "string") if kind == "text" else F.lit("")
    return F.coalesce(F.when(F.schema_of_variant(content) == "STRING", alone).otherwise(joined), F.lit(""))


def messages_of(records: DataFrame) -> DataFrame:
    """(file, ord, type, uuid, parent, timestamp, role, text, thinking, tools) of transcript records (file, ord, record).

    `text` and `thinking` join the blocks of their kind; `tools` has (id, name, path) of tool blocks. Only user and
    assistant records are messages.
    """
    v = records.select("file", "ord", F.try_parse_json("record").alias("v")).filter("v IS NOT NULL")
    s = lambda path: F.try_variant_get("v", path, "string")
    content = F.try_variant_get("v", "$.message.content", "variant")
    used = F.filter(F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>")), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")
    tools = F.transform(used, lambda b: F.struct(F.try_variant_get(b, "$.id", "string").alias("id"), F.try_variant_get(b, "$.name", "string").alias("name"), F.try_variant_get(b, "$.input.file_path", "string").alias("path")))
    return v.filter(s("$.type").isin("user", "assistant")).select(
        "file", "ord", s("$.type").alias("type"), s("$.uuid").alias("uuid"), s("$.parentUuid").alias("parent"), s("$.timestamp").alias("timestamp"),
        F.coalesce(s("$.message.role"), s("$.type")).alias("role"), text_of_content(content).alias("text"), text_of_content(content, "thinking").alias("thinking"), tools.alias("tools"),
    )


def thinking_blocks(records: DataFrame) -> DataFrame:
    """(file, ord, no, text): the thinking blocks of assistant records (file, ord, record), in order."""
    v = records.select("file", "ord", F.try_parse_json("record").alias("v")).filter("v IS NOT NULL")
    own = v.filter(F.try_variant_get("v", "$.type", "string") == "assistant")
    blocks = own.select("file", "ord", F.posexplode(F.coalesce(F.try_variant_get("v", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))).alias("no", "b"))
    return blocks.filter(F.try_variant_get("b", "$.type", "string") == "thinking").select("file", "ord", F.col("no").cast("long").alias("no"), F.coalesce(F.try_variant_get("b", "$.thinking", "string"), F.lit("")).alias("text"))


def thinking_stats(records: DataFrame, least: int = 100) -> DataFrame:
    """(file, scanned, found, processed): records, thinking blocks, and those of `least` characters or more, of each file."""
    blocks = thinking_blocks(records).groupBy("file").agg(F.count("*").alias("found"), F.count_if(F.length("text") >= least).alias("processed"))
    every = records.groupBy("file").agg(F.count("*").alias("scanned")).join(blocks, "file", "left")
    return every.select("file", "scanned", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("processed", F.lit(0)).alias("processed"))


def outcomes_of(records: DataFrame, topic: str | None = None, task: str | None = None) -> DataFrame:
    """Outcome records (record) as columns, of one topic or task if given; what can't be read is left out."""
    schema = "id string, timestamp string, query string, response_summary string, task_type string, model string, topic string, competence_level string, outcome string, inference_reason string, latency_ms double, session_id string"
    rows = records.select(F.from_json("record", schema).alias("r")).select("r.*").filter("id IS NOT NULL")
    if topic is not None:
        rows = rows.filter(F.col("topic") == topic)
    return rows.filter(F.col("task_type") == task) if task is not None else rows


def zone_rows(spark: SparkSession, root: str) -> DataFrame:
    """(text, source, category, project) of a lake's four zones for the vector index.

    Training pairs, decisions and learnings in Markdown cut into overlapping pieces, and the descriptions of the last
    thirty files of code changes.
    """
    from skein.operators.chunks import chunk

    files = scan(spark, root)
    own = lambda part, suffix: files.filter(F.contains("path", F.lit(part)) & (F.col("suffix") == suffix))
    changes = last_files(own("/code-changes/", ".jsonl"))
    parts = [index_rows(_records_in(read_files(spark, own("/training-pairs/", ".jsonl")))), index_rows(_records_in(read_files(spark, changes)), "description", "code_change")]
    for part, name in (("/decisions/", "decision"), ("/learnings/", "learning")):
        text = read_files(spark, own(part, ".md")).filter(F.trim("content") != "").select(F.col("path").alias("doc_id"), F.col("content").alias("text"))
        parts.append(chunk(text).select(F.col("chunk").alias("text"), F.col("doc_id").alias("source"), F.lit(name).alias("category"), F.lit("").alias("project")))
    return reduce(DataFrame.unionByName, parts)


def _records_in(files: DataFrame) -> DataFrame:
    """(file, ord, record): the lines of files (path, content) that are JSON."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("ord", "record"))
    return lines.filter((F.trim("record") != "") & F.try_parse_json("record").isNotNull())


def messages_by_uuid(messages: DataFrame) -> DataFrame:
    """One message for each uuid of a file, the last one."""
    rest = [c for c in messages.columns if c not in ("file", "uuid")]
    return messages.filter("uuid IS NOT NULL").groupBy("file", "uuid").agg(F.max_by(F.struct(*rest), "ord").alias("m")).select("file", "uuid", *(f"m.{c}" for c in rest))


def tool_messages(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tool_use_id, file, uuid, ord): the first assistant message with the tool block that each wanted (tool_use_id) names."""
    blocks = messages.filter("role = 'assistant'").select("file", "uuid", "ord", F.explode("tools").alias("t")).select("file", "uuid", "ord", F.col("t.id").alias("tool_use_id"))
    hit = wanted.select("tool_use_id").distinct().join(blocks, "tool_use_id")
    return hit.groupBy("tool_use_id").agg(F.min_by("file", F.struct("ord", "file")).alias("file"), F.min_by("uuid", F.struct("ord", "file")).alias("uuid"), F.min("ord").alias("ord"))


def transcripts_of(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project, path) of transcripts (path, folder) whose folder's name holds the project's, hyphens and case aside.

    Projects are a short list, held against each folder in its own row.
    """
    names = [r["project"] for r in projects.select("project").distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 projects")
    plain = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit(""))
    held = F.filter(F.array(*map(F.lit, names)).cast("array<string>"), lambda p: F.contains(plain(F.col("folder")), plain(p)))
    return files.select(F.explode(held).alias("project"), "path")


def read_table_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small saved table of JSON Lines or a JSON array, in its last version if it was replaced.

    An empty one where it is missing, and without rows that can't be read.
    """
    found = _last_version(spark, path)
    return _read_or_empty(spark, found[0] if found else path, schema)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", path.endswith(".json")).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def benchmark_cases(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Evaluation cases of JSON arrays, of one category if named."""
    schema = "id string, category string, difficulty string, language string, input struct<prompt:string,context:string>, expected_behavior struct<must_include:array<string>,must_not_include:array<string>,ideal_response:string>"
    cases = spark.read.schema(schema).option("multiLine", True).json(path)
    return cases.filter(F.col("category") == name) if name else cases


def unprocessed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, modified) that the state (file_key, modified) doesn't know in this version or a later one."""
    known = state.select(F.col("file_key"), F.col("modified").alias("done"))
    return files.join(known, (files["path"] == known["file_key"]) & (known["done"] >= files["modified"]), "left_anti")


def quality_gate(entries: DataFrame, least: dict[str, int] = MIN_LENGTHS) -> DataFrame:
    """`entries` with `reasons`, the fields that are too short once stripped, and `accepted`."""
    short = [F.when(F.length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")) < n, F.lit(f"{c}<{n}")) for c, n in least.items() if c in entries.columns]
    return entries.withColumn("reasons", F.array_join(F.array_compact(F.array(*short)), ",")).withColumn("accepted", F.col("reasons") == "")


def write_by_day(rows: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Appends JSON Lines in one folder for each day of the record's own time."""
    rows.withColumn("day", F.substring(F.col(ts).cast("string"), 1, 10)).write.mode("append").partitionBy("day").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Appends JSON Lines: the log of drifts, of feedback marks, or of processed files."""
    rows.write.mode("append").json(path)


def _versions(path: str) -> str:
    return f"{path.rstrip('/')}.versions"


def _last_version(spark: SparkSession, path: str) -> list[str]:
    """The folders of a replaced table, the last one first; none for a table that never was."""
    log = _read_or_empty(spark, f"{_versions(path)}/log", "version string, no long")
    return [f"{_versions(path)}/{r['version']}" for r in log.orderBy(F.desc("no"), "version").collect()]


def replace_table(rows: DataFrame, path: str) -> None:
    """Puts `rows` in the place of a saved table, from which they may come.

    They are written to a folder of their own, and readers see them once the log of versions names it: a crash before
    leaves the table as it was. The version before stays for readers that have begun, older ones are deleted.
    """
    import uuid

    spark, version = rows.sparkSession, uuid.uuid4().hex
    rows.write.json(f"{_versions(path)}/{version}")
    before = _last_version(spark, path)
    spark.createDataFrame([(version, len(before))], "version string, no long").coalesce(1).write.mode("append").json(f"{_versions(path)}/log")
    fs = spark._jvm.org.apache.hadoop.fs.Path(_versions(path)).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in before[1:]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)


def mark_processed(files: DataFrame, path: str) -> None:
    """Notes files (path, modified) as processed, whether or not anything came of them."""
    append(files.select(F.col("path").alias("file_key"), "modified"), path)


def append_vectors(rows: DataFrame, path: str, key: str | None = None) -> None:
    """Appends rows to a vector table; with `key`, only those whose key the table doesn't hold yet."""
    from pyspark.errors import AnalysisException

    if key is not None:
        try:
            known = rows.sparkSession.read.parquet(path).select(key)
            rows = rows.join(known, key, "left_anti")
        except AnalysisException:
            pass  # there is no table yet
        rows = rows.dropDuplicates([key])
    rows.write.mode("append").parquet(path)


def write_stream_by_day(stream: DataFrame, path: str, state: str, ts: str = "timestamp") -> None:
    """Works off what a stream of records has at present into JSON Lines in one folder for each day."""
    dated = stream.withColumn("day", F.substring(F.col(ts).cast("string"), 1, 10))
    dated.writeStream.format("json").option("path", path).option("checkpointLocation", state).partitionBy("day").trigger(availableNow=True).start().awaitTermination()


def save_graph(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a new version of the graph, and its counts by type; readers see it once its name is in the list of versions."""
    import uuid

    version = uuid.uuid4().hex
    entities.write.parquet(f"{path}/{version}/entities")
    edges.write.parquet(f"{path}/{version}/edges")
    counts = entities.groupBy(F.lit("entity").alias("what"), F.col("type").alias("type")).count().unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("type")).count())
    counts.withColumn("version", F.lit(version)).withColumn("saved", F.current_timestamp()).write.mode("append").json(f"{path}/versions")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The last version that was saved whole; None where there is none."""
    last = read_table_or(spark, f"{path}/versions", "version string, saved timestamp").orderBy(F.desc("saved")).limit(1).collect()
    if not last:
        return None
    return tuple(spark.read.parquet(f"{path}/{last[0]['version']}/{part}") for part in ("entities", "edges"))
