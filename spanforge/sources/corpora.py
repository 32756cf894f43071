"""Small built-in corpora: a basic one, a realistic one, and one planted failure per stage. All text is our own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources import tables

DOC_SCHEMA = "id string, text string, doc_pos bigint"
AUTHOR_SCHEMA = f"query_id string, text string, source_id string, answer string, answer_all array<string>, alternatives array<{tables.ALTERNATIVE}>, query_pos bigint, kind string"


@dataclass
class Corpus:
    documents: DataFrame
    queries: DataFrame


def _build(spark: SparkSession, docs: list[tuple[str, str]], queries: list[tuple]) -> Corpus:
    """queries: (id, text, source, answer or list of answers that all are required, or a list of (source, answer) alternatives, kind)."""
    documents = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], DOC_SCHEMA)
    rows = []
    for n, (qid, text, source, answer, *kind) in enumerate(queries):
        if source is None:
            row = (qid, text, None, None, None, [(s, a, None) for s, a in answer])
        elif isinstance(answer, list):
            row = (qid, text, source, None, answer, None)
        else:
            row = (qid, text, source, answer, None, None)
        rows.append((*row, n, kind[0] if kind else "easy"))
    return Corpus(documents, tables.build_queries(spark.createDataFrame(rows, AUTHOR_SCHEMA), documents))


def basic(spark: SparkSession) -> Corpus:
    docs = [
        ("tides", "Harbour tides turn twice a day. The spring tide follows the full moon by two days."),
        ("bread", "A sourdough loaf rests overnight. Bake it at two hundred and thirty degrees for forty minutes."),
        ("bees", "Honey bees overwinter in a cluster. The queen stays in its warm middle until March."),
        ("rail", "The night train leaves from platform nine. Sleeping cars are at the rear of the train."),
    ]
    return _build(spark, docs, [
        ("q-tide", "when does the spring tide come after the full moon", "tides", "The spring tide follows the full moon by two days."),
        ("q-bake", "how hot to bake a sourdough loaf", "bread", "Bake it at two hundred and thirty degrees for forty minutes."),
        ("q-queen", "where does the queen stay in winter", "bees", "The queen stays in its warm middle until March."),
        ("q-sleep", "which end has the sleeping cars", "rail", "Sleeping cars are at the rear of the train."),
    ])


# Name, subject and facts of the realistic corpus; each subject becomes three documents.
_SUBJECTS = (
    ("pump", "The circulation pump", "runs at three speeds", "fault code ZX-4471 means a seized rotor", "bleed the valve before the first start of the season"),
    ("kiln", "The pottery kiln", "reaches cone ten in nine hours", "fault code KR-2093 means a broken thermocouple", "vent the chamber until it falls below ninety degrees"),
    ("loom", "The floor loom", "takes warps of thirty metres", "fault code LM-7718 means a slack heddle", "oil the batten pivots after every second warp"),
    ("press", "The letter press", "prints four hundred sheets an hour", "fault code PR-5502 means a jammed platen", "wash the rollers with spirit at the end of each shift"),
    ("boat", "The rescue boat", "carries eight people", "fault code BT-3316 means water in the fuel", "flush the engine with fresh water after each launch"),
    ("still", "The oil still", "holds sixty litres", "fault code ST-9027 means a blocked condenser", "rinse the coil with vinegar once a month"),
    ("lathe", "The wood lathe", "turns bowls up to forty centimetres", "fault code LT-6645 means a worn spindle", "sharpen the gouge whenever the surface tears"),
    ("hive", "The observation hive", "shows two brood frames", "fault code HV-1180 means a dead sensor", "feed syrup when the scale drops below ten kilograms"),
    ("organ", "The chapel organ", "has twelve stops", "fault code OR-8804 means a leaking bellows", "tune the reeds when the nave has warmed to eighteen degrees"),
)


def realistic(spark: SparkSession) -> Corpus:
    """27 documents and 18 queries of seven kinds: rare term, fragmentation, paraphrase, distractor, multi-span, multi-alternative, easy."""
    docs = []
    for key, name, fact, fault, care in _SUBJECTS:
        long = " ".join(f"Paragraph {i} of the manual recalls what the workshop learned about {name.lower()} in its season number {i}." for i in range(1, 7))
        docs.append((f"{key}-guide", f"{name} {fact}. {long} Keep this in mind: {care}. {long}"))
        docs.append((f"{key}-faults", f"Fault list. {name} reports faults on its panel. {fault[0].upper() + fault[1:]}. Any other code calls for the service desk."))
        docs.append((f"{key}-notes", f"Notes on {name.lower()}. Questions about {name.lower()}, its faults and its care come up every week. Ask the desk about {name.lower()} and its care."))
    q = []
    for key, name, fact, fault, care in _SUBJECTS[:3]:
        code = fault.split()[2]
        q.append((f"rare-{key}", f"meaning of {code}", f"{key}-faults", fault[0].upper() + fault[1:] + ".", "rare-term"))
    for key, name, _, _, care in _SUBJECTS[3:6]:
        q.append((f"frag-{key}", f"{name.lower()} keep this in mind {care}", f"{key}-guide", f"Keep this in mind: {care}. Paragraph 1 of the manual recalls what the workshop learned about {name.lower()} in its season number 1.", "fragmentation"))
    for key, _, _, _, care in _SUBJECTS[6:9]:
        q.append((f"para-{key}", {"lathe": "when should the cutting tool get a new edge", "hive": "at which weight do bees need sugar water", "organ": "temperature of the church for adjusting pipes"}[key], f"{key}-guide", care, "paraphrase"))
    for key, name, fact, _, _ in _SUBJECTS[:3]:
        q.append((f"dist-{key}", f"questions about {name.lower()} its faults and its care", f"{key}-guide", f"{name} {fact}.", "distractor"))
    for key, name, fact, _, care in _SUBJECTS[3:5]:
        q.append((f"multi-{key}", f"{name.lower()} {fact} and {care}", f"{key}-guide", [f"{name} {fact}.", f"Keep this in mind: {care}."], "multi-span"))
    for key, name, _, fault, care in _SUBJECTS[5:7]:
        q.append((f"alt-{key}", f"{name.lower()} service desk or {care}", None, [(f"{key}-faults", "Any other code calls for the service desk."), (f"{key}-guide", care)], "multi-alternative"))
    for key, name, fact, _, _ in _SUBJECTS[7:9]:
        q.append((f"easy-{key}", f"{name.lower()} {fact}", f"{key}-guide", f"{name} {fact}.", "easy"))
    return _build(spark, docs, q)


def planted(spark: SparkSession, stage: str) -> tuple[Corpus, dict]:
    """(corpus, settings): a corpus on which the named stage loses the evidence under the settings."""
    if stage == "representation":
        text = "a" * 300 + " The hidden answer is forty two. " + "b" * 300
        return _build(spark, [("d", text)], [("q", "hidden answer", "d", "The hidden answer is forty two.")]), {"drop": (295, 340)}
    if stage == "final_cutoff":
        whole = "The first half names the lantern keeper. The second half names the lantern maker."
        docs = [("d", whole), ("e", "Lantern lantern lantern keeper."), ("f", "Lantern maker maker lantern.")]
        return _build(spark, docs, [("q", "lantern keeper maker", "d", whole)]), {"size": len(whole) // 2, "top_k": 1}
    if stage == "candidate_generation":
        docs = [("d", "Copper pans brown evenly."), ("e", "which vessel gives an even colour which vessel gives an even colour"), ("f", "Nothing of note.")]
        return _build(spark, docs, [("q", "which vessel gives an even colour", "d", "Copper pans brown evenly.")]), {"candidate_n": 1, "top_k": 1}
    if stage == "reranker_demotion":
        docs = [("d", "Gardeners pruning roses: pruned roses flowered, flowering roses were pruned."), ("e", "prune rose flower"), ("f", "A list of tools.")]
        return _build(spark, docs, [("q", "prune rose flower", "d", docs[0][1])]), {"candidate_n": 3, "top_k": 1}
    if stage == "budget_cutoff":
        docs = [("d", "The ferry crosses at dawn with the mail and the morning papers on board."), ("e", "Unrelated words.")]
        return _build(spark, docs, [("q", "when does the ferry cross with the mail", "d", docs[0][1])]), {"budget": 4}
    raise ValueError(f"no planted corpus for {stage!r}")


def span_in(documents: DataFrame, source: str, needle: str) -> DataFrame:
    """(source_id, start, end) of the first occurrence of a text; start is -1 where it is absent."""
    at = F.instr("text", needle) - 1
    return documents.where(F.col("id") == source).select(F.col("id").alias("source_id"), at.alias("start"), (at + len(needle)).alias("end"))


def write_corpus(spark: SparkSession, name: str, folder: str) -> tuple[str, str]:
    corpus = {"basic": basic, "realistic": realistic}[name](spark)
    return tables.DatasetImport(corpus.documents, corpus.queries, {}).write_jsonl(folder)
