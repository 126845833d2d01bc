"""File sources: text folders, session logs, chat exports and the list of what has been taken in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_LINE = "type string, id string, timestamp string, message struct<role:string,content:string,timestamp:string>"
BLOCKS = "array<struct<type:string,text:string,name:string>>"


def text_files(spark: SparkSession, folder: str, recursive: bool = True, pattern: str = "*.{[mM][dD],[tT][xX][tT],[mM][aA][rR][kK][dD][oO][wW][nN]}") -> DataFrame:
    """(file, text) for each text file of a folder."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(file, n, line) of (file, text), n from 0."""
    return files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))


def session_messages(logs: DataFrame) -> DataFrame:
    """(session, turn, role, text, tools, timestamp) of the lines (file, n, line) of JSONL session logs.

    A session's id is that of its `session` line, or else its file's name; lines that are not JSON
    are passed over. A content is a text, or blocks whose texts are joined and whose tools are listed.
    """
    parsed = logs.withColumn("j", F.from_json("line", SESSION_LINE)).filter("j.type is not null")
    named = parsed.filter("j.type = 'session'").groupBy("file").agg(F.max_by("j.id", "n").alias("id"))
    blocks = F.from_json("j.message.content", BLOCKS)
    text = F.when(F.col("blocks").isNotNull(), F.array_join(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"]), "\n")).otherwise(F.coalesce(F.col("j.message.content"), F.lit("")))
    tools = F.transform(F.filter(F.coalesce("blocks", F.expr(f"cast(array() as {BLOCKS})")), lambda b: (b["type"] == "tool_use") & b["name"].isNotNull()), lambda b: b["name"])
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.jsonl)?$", 1)
    messages = parsed.filter("j.type = 'message' and j.message is not null").withColumn("blocks", F.when(F.col("j.message.content").startswith("["), blocks))
    return messages.join(named, "file", "left").select(F.coalesce("id", stem).alias("session"), F.col("n").alias("turn"), F.col("j.message.role").alias("role"), text.alias("text"), tools.alias("tools"), F.col("j.timestamp").alias("timestamp"))


def session_logs(spark: SparkSession, folder: str) -> DataFrame:
    """session_messages of every *.jsonl file of a folder."""
    return session_messages(lines(text_files(spark, folder, False, "*.jsonl")))


def not_taken(files: DataFrame, ledger: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """The files that the ledger (file) does not have; of those the first `limit` by name, if given."""
    new = files if force else files.join(ledger.select("file"), "file", "left_anti")
    return new if limit is None else new.orderBy("file").limit(limit)


def known_entities(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(pattern, name, type) of a JSON file of such objects, for graph.entities; none if it is not there or not JSON."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    stream = fs.open(at)
    try:
        rows = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        return [(r["pattern"], r["name"], r["type"]) for r in rows]
    except (ValueError, KeyError, TypeError):
        return []
    finally:
        stream.close()


def _walk(export: str | None) -> Iterator[tuple[str | None, str | None, int, str | None, str]]:
    """One export's messages, depth first from the nodes whose parent is not there, children in their order."""
    try:
        c = json.loads(export or "")
    except ValueError:
        return
    mapping = c.get("mapping") if isinstance(c, dict) else None
    if not isinstance(mapping, dict):
        return
    todo = [n for n, v in reversed(mapping.items()) if (v or {}).get("parent") not in mapping]
    seen, place = set(), 0
    while todo:
        node = todo.pop()
        if node in seen or node not in mapping:
            continue
        seen.add(node)
        v = mapping[node] or {}
        message = v.get("message") or {}
        parts = (message.get("content") or {}).get("parts") or []
        text = "\n".join(p if isinstance(p, str) else json.dumps(p, separators=(",", ":"), ensure_ascii=False) for p in parts if p)
        yield c.get("id"), c.get("title"), place, (message.get("author") or {}).get("role"), text
        place += 1
        todo += reversed(v.get("children") or [])


def export_messages(conversations: DataFrame) -> DataFrame:
    """(conversation, title, place, role, text) of chat exports (json), depth first from the roots, children in their order; place counts from 0.

    A conversation is a row and walked by itself in one pass; what is no export gives no messages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for export in batch.column(0):
                rows = list(_walk(export.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conversation", "title", "place", "role", "text"])

    return conversations.select("json").mapInArrow(run, "conversation string, title string, place long, role string, text string")


def chunks(messages: DataFrame, limit: int = 2000, least: int = 20) -> DataFrame:
    """(conversation, chunk, text): user's and assistant's texts longer than `least`, in order, put together while they stay within the limit."""
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    good = messages.filter((F.length("text") > least) & F.col("role").isin("user", "assistant"))
    ordered = good.groupBy("conversation").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("all"))

    def step(acc, x):
        fits = (F.size(acc) > 0) & (F.length(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))) + F.length(x) <= limit)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), F.lit("\n\n"), x)))
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(x)))

    cut = F.aggregate("all", F.expr("cast(array() as array<string>)"), step)
    return ordered.select("conversation", F.posexplode(cut).alias("chunk", "text"))
