"""Readers and writers: JSON lines, SQuAD, BEIR, Parquet tables, result files."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.text import content_hash, stable_hash, strip
from spanforge.operators import gold
from spanforge.plans.session import materialise, numbered

SPAN = "struct<source_id:string,start:int,end:int,quoted_text:string,source_version:string>"
GOLD = f"struct<alternatives:array<struct<required_spans:array<{SPAN}>>>>"
ALTERNATIVE = "struct<source_id:string,answer:string,answer_all:array<string>>"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSON-lines file with line_no; blank lines are skipped.

    A line that is not a JSON object, or lacks a required field, raises ValueError naming path and
    line. Line numbers are those of the file: it is read as one split, as line order is the
    corpus order; many files are better kept as a table.
    """
    if not Path(path.removeprefix("file:")).exists() and "://" not in path:
        raise FileNotFoundError(f"no such file: {path}")
    lines = spark.read.option("wholetext", False).text(path).coalesce(1)
    numbered = lines.withColumn("line_no", F.monotonically_increasing_id() + 1).where(F.length(strip(F.col("value"))) > 0)
    bad_field = "__bad"
    parsed = numbered.withColumn("r", F.from_json("value", f"{schema}, {bad_field} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_field}))
    broken = F.col(f"r.{bad_field}").isNotNull() | F.col("r").isNull()
    for name in required:
        broken = broken | F.col(f"r.{name}").isNull()
    first = parsed.where(broken).select("line_no").orderBy("line_no").limit(1).collect()
    if first:
        raise ValueError(f"{path}:{first[0]['line_no']}: invalid JSON record")
    return parsed.select("line_no", "r.*").drop(bad_field)


def unique_documents(rows: DataFrame, id_col: str = "id", text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """(id, text, doc_pos): the last text of an id at its first position; null ids go, null texts become empty."""
    return (
        rows.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max_by(F.coalesce(text_col, F.lit("")), order_col).alias("text"), F.min(order_col).cast("bigint").alias("doc_pos"))
    )


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, doc_pos, meta): meta is the record's free-form object as JSON text, or null."""
    rows = read_jsonl(spark, path, "id string, text string, meta string", ("id", "text"))
    meta = rows.groupBy("id").agg(F.max_by(F.struct("meta"), "line_no")["meta"].alias("meta"))
    return unique_documents(rows, order_col="line_no").join(meta, "id")


def unique_queries(rows: DataFrame, order: tuple[str, ...] = ("asked_at", "text")) -> DataFrame:
    """(query_id, text, gold): the first row of an id; null ids go."""
    first = F.row_number().over(W.partitionBy("id").orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    return rows.where("id is not null").withColumn("__n", first).where("__n = 1").select(F.col("id").alias("query_id"), "text", "gold")


def load_queries(spark: SparkSession, path: str, documents: DataFrame, strict: bool = True) -> DataFrame:
    """Queries whose gold verifies, with query_pos; strict raises on the first that does not."""
    rows = read_jsonl(spark, path, f"id string, text string, gold {GOLD}, meta string", ("id", "text", "gold"))
    queries = rows.select(F.col("id").alias("query_id"), "text", "gold", F.col("line_no").alias("query_pos"), "meta")
    return gold.load_verified(queries, documents, strict)


def load_authoring(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """Queries from quotes: offsets and versions are stamped; an absent or empty quote raises."""
    rows = read_jsonl(spark, path, f"id string, text string, source_id string, answer string, answer_all array<string>, alternatives array<{ALTERNATIVE}>", ("id", "text"))
    return build_queries(rows.withColumnRenamed("id", "query_id").withColumnRenamed("line_no", "query_pos"), documents)


def authoring_entries(rows: DataFrame) -> DataFrame:
    """(query_id, alt_idx, span_idx, source_id, quote, occurrence) of authoring rows."""
    own = F.array(F.struct("source_id", "answer", "answer_all"))
    alts = rows.select("query_id", F.posexplode(F.coalesce("alternatives", own)).alias("alt_idx", "a"))
    quotes = F.coalesce("a.answer_all", F.array("a.answer"))
    return alts.select("query_id", "alt_idx", "a.source_id", F.posexplode(quotes).alias("span_idx", "quote")).withColumn("occurrence", F.lit(0))


def build_queries(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, text, gold, query_pos) from rows(query_id, text, source_id, answer, answer_all, alternatives, query_pos)."""
    spans = gold.author_spans(authoring_entries(rows), documents)
    bad = spans.where("reason is not null").orderBy("query_id", "alt_idx", "span_idx").first()
    if bad is not None:
        raise ValueError(f"query {bad['query_id']}: {bad['reason']} in source {bad['source_id']}")
    span = F.struct("source_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "quoted_text", "source_version")
    per_alt = spans.groupBy("query_id", "alt_idx").agg(F.array_sort(F.collect_list(F.struct("span_idx", span.alias("s")))).alias("x"))
    per_alt = per_alt.withColumn("required_spans", F.transform("x", lambda p: p["s"]))
    per_query = per_alt.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("alt_idx", F.struct("required_spans").alias("a")))).alias("y"))
    packed = per_query.select("query_id", F.struct(F.transform("y", lambda p: p["a"]).alias("alternatives")).alias("gold"))
    return rows.select("query_id", "text", "query_pos").join(packed, "query_id").select("query_id", "text", "gold", "query_pos")


@dataclass
class DatasetImport:
    """documents(id, text, doc_pos, title), queries(query_id, text, gold, query_pos) and counters of what was skipped."""

    documents: DataFrame
    queries: DataFrame
    skipped: dict[str, int]

    def summary(self) -> str:
        left = ", ".join(f"{k}={v}" for k, v in sorted(self.skipped.items()) if v)
        return f"{self.documents.count()} documents, {self.queries.count()} queries" + (f" (skipped: {left})" if left else "")

    def write_jsonl(self, folder: str) -> tuple[str, str]:
        docs, queries = str(Path(folder) / "docs.jsonl"), str(Path(folder) / "queries.jsonl")
        write_documents_jsonl(self.documents, docs)
        write_queries_jsonl(self.queries, queries)
        return docs, queries


def _one_answer_span(source: Column, answer: Column, version: Column) -> Column:
    text, start = answer["text"], answer["answer_start"].cast("int")
    return F.struct(source.alias("source_id"), start.alias("start"), (start + F.length(text)).alias("end"), text.alias("quoted_text"), version.alias("source_version"))


def load_squad(spark: SparkSession, path: str, max_queries: int | None = None, max_answers: int | None = None) -> DatasetImport:
    """SQuAD 1.1 or 2.0 JSON, wrapped or a bare list; each answer is one alternative, stamped with its context's version.

    Equal contexts are one document with the title of the first. Unanswerable questions, questions without answers and those
    none of whose answers matches the context are counted and skipped; 0 means no cap. With
    max_queries, documents first met after the last kept query are left out.
    """
    answer = "struct<text:string,answer_start:int>"
    article = f"struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<{answer}>>>>>>"
    raw = spark.read.option("wholetext", True).text(path)
    wrapped = F.from_json("value", f"struct<data:array<{article}>>")["data"]
    articles = raw.select(F.posexplode(F.coalesce(wrapped, F.from_json("value", f"array<{article}>"))).alias("a_no", "a"))
    paragraphs = articles.select("a_no", F.col("a.title").alias("title"), F.posexplode("a.paragraphs").alias("p_no", "p"))
    paragraphs = paragraphs.withColumn("id", F.concat(F.lit("sq-"), F.substring(stable_hash(F.col("p.context")), 1, 16)))
    qas = paragraphs.select("a_no", "p_no", "id", F.col("p.context").alias("context"), F.posexplode("p.qas").alias("q_no", "q"))
    found = F.filter(F.coalesce("q.answers", F.array().cast(f"array<{answer}>")), lambda x: (F.length(x["text"]) > 0) & x["answer_start"].isNotNull())
    true = F.filter(found, lambda x: (x["answer_start"] >= 0) & (F.substring(F.col("context"), x["answer_start"] + 1, F.length(x["text"])) == x["text"]))
    unique = F.array_distinct(F.transform(true, lambda x: F.struct(x["answer_start"].alias("answer_start"), x["text"].alias("text"))))
    capped = F.slice(unique, 1, max_answers) if max_answers else unique
    state = (
        F.when(F.coalesce("q.is_impossible", F.lit(False)), "impossible")
        .when(F.coalesce(F.size("q.answers"), F.lit(0)) <= 0, "no_answer")
        .when(F.size(true) == 0, "unverified").otherwise("kept")
    )
    rows = qas.withColumn("at", F.struct("a_no", "p_no", "q_no")).withColumn("state", state).withColumn("answers", capped)
    if max_queries:
        last = rows.where("state = 'kept'").orderBy("at").limit(max_queries).agg(F.max("at").alias("last"))
        rows = rows.join(F.broadcast(last), F.lit(True)).where("last is null or at <= last")
        seen = paragraphs.join(F.broadcast(last), F.lit(True)).where("last is null or struct(a_no, p_no) <= struct(last.a_no, last.p_no)")
    else:
        seen = paragraphs
    first = F.row_number().over(W.partitionBy("id").orderBy("a_no", "p_no"))
    docs = seen.withColumn("n", first).where("n = 1").select("id", F.col("p.context").alias("text"), (F.col("a_no").cast("bigint") * 1_000_000 + F.col("p_no")).alias("doc_pos"), "title", F.to_json(F.struct("title"), {"ignoreNullFields": "false"}).alias("meta"))
    alternatives = F.transform("answers", lambda x: F.struct(F.array(_one_answer_span(F.col("id"), x, F.col("version"))).alias("required_spans")))
    kept = numbered(rows.where("state = 'kept'").withColumn("version", content_hash(F.col("context"))), "query_pos", "at").select(
        F.col("q.id").alias("query_id"), F.col("q.question").alias("text"), F.struct(alternatives.alias("alternatives")).alias("gold"), "query_pos", F.lit('{"dataset": "squad"}').alias("meta"),
    )
    skipped = {r["state"]: r["count"] for r in rows.where("state <> 'kept'").groupBy("state").count().collect()}
    return DatasetImport(docs, kept, {k: skipped.get(k, 0) for k in ("impossible", "no_answer", "unverified")})


def passage_text(title: Column, text: Column) -> Column:
    """title, a blank line and text, both stripped; the text alone without a title."""
    t, x = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(text, F.lit("")))
    return F.when(t != "", F.concat(t, F.lit("\n\n"), x)).otherwise(x)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, query_id, corpus_id, score); rows with fewer than three fields or without an integer score are skipped."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).coalesce(1).withColumn("line_no", F.monotonically_increasing_id())
    rows = lines.where(F.size(parts) >= 3).select("line_no", parts[0].alias("query_id"), parts[1].alias("corpus_id"), F.expr("try_cast(split(value, '\\t')[2] as int)").alias("score"))
    return rows.where("score is not null")


def load_beir(spark: SparkSession, corpus: str, queries: str, qrels: str, min_score: int = 1, max_queries: int | None = None) -> DatasetImport:
    """BEIR files: the whole corpus stays; each relevant passage is one alternative spanning it whole.

    Judgements below min_score or of passages not in the corpus do not exist: queries come in the
    order of their first one that is left, and only queries with such are counted when skipped.
    """
    docs = read_jsonl(spark, corpus, "_id string, title string, text string", ("_id",))
    docs = docs.withColumn("whole", passage_text(F.col("title"), F.col("text")))
    docs = unique_documents(docs, "_id", "whole", "line_no")
    asked = read_jsonl(spark, queries, "_id string, text string", ("_id",)).groupBy(F.col("_id").alias("query_id")).agg(F.max_by("text", "line_no").alias("text"))
    rels = read_qrels(spark, qrels).where(F.col("score") >= min_score)
    good = rels.join(docs, rels["corpus_id"] == docs["id"]).groupBy("query_id", "corpus_id").agg(F.min("line_no").alias("line_no"), F.first("text").alias("text"))
    span = F.struct(F.col("corpus_id").alias("source_id"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("quoted_text"), content_hash(F.col("text")).alias("source_version"))
    alternative = F.when(F.length("text") > 0, F.struct("line_no", F.struct(F.array(span).alias("required_spans")).alias("a")))
    state = good.groupBy("query_id").agg(F.min("line_no").alias("first"), F.array_sort(F.collect_list(alternative)).alias("x")).join(asked, "query_id", "left")
    known = F.col("text").isNotNull()
    state = materialise(state.withColumn("state", F.when(~known, "unknown_query").when(F.size("x") == 0, "no_relevant").otherwise("kept")))
    if max_queries:  # reading stops at the last kept query, and so do the counters
        last = state.where("state = 'kept'").orderBy("first").limit(max_queries).agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("last")).first()
        state = state.where(F.col("first") <= last["last"]) if last["n"] == max_queries else state
    kept = numbered(state.where("state = 'kept'"), "query_pos", "first").select(
        "query_id", "text", F.struct(F.transform("x", lambda p: p["a"]).alias("alternatives")).alias("gold"), "query_pos", F.lit('{"dataset": "beir"}').alias("meta")
    )
    counts = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
    return DatasetImport(docs, kept, {k: counts.get(k, 0) for k in ("no_relevant", "unknown_query")})


def _write_lines(rows, path: str) -> str:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("w", encoding="utf-8") as f:
        for record in rows:
            f.write(json.dumps(record, ensure_ascii=False) + "\n")
    return str(out)


def write_documents_jsonl(documents: DataFrame, path: str) -> str:
    """One file in corpus order, streamed partition by partition; for large corpora use write_json_folder."""
    rows = _with_meta(documents).select("id", "text", "meta", "doc_pos").orderBy("doc_pos").toLocalIterator()
    return _write_lines(({"id": r["id"], "text": r["text"]} | _meta(r) for r in rows), path)


def _with_meta(df: DataFrame) -> DataFrame:
    return df if "meta" in df.columns else df.withColumn("meta", F.lit(None).cast("string"))


def _meta(row) -> dict:
    """The meta field of a record; left out when empty."""
    value = json.loads(row["meta"]) if row["meta"] else None
    return {"meta": value} if value else {}


def _no_nulls(x):
    if isinstance(x, dict):
        return {k: _no_nulls(v) for k, v in x.items() if v is not None}
    return [_no_nulls(v) for v in x] if isinstance(x, list) else x


def write_queries_jsonl(queries: DataFrame, path: str) -> str:
    rows = _with_meta(queries).select("query_id", "text", "gold", "meta", "query_pos").orderBy("query_pos").toLocalIterator()
    return _write_lines(({"id": r["query_id"], "text": r["text"], "gold": _no_nulls(r["gold"].asDict(recursive=True))} | _meta(r) for r in rows), path)


def write_json_folder(df: DataFrame, path: str) -> None:
    """A folder of JSON-lines files, written in parallel; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)
