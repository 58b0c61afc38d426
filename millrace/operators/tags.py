"""Topic tags: candidates, evidence, anchoring, semantic rank, selection, and writing them back."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..shipping import shipped
from ..tables import ranked, written
from . import blocks

# Sizes, and below the weights and limits of ranking and selection.
MAX_CANDIDATES, MAX_SAMPLES, MAX_TAGS, EVIDENCE = 128, 24, 5, 4000
#: Documents of a block that meets the topics of their knowledge base.
DOCUMENTS = 256
#: Documents whose anchors leave a task at once.
ANCHORED = 512
WORD = re.compile("[a-z0-9]+")
KEPT_TAGS, TAG_LENGTH = 12, 32
#: Added before rounding, so that halves, which sums of rounded similarities often are, go up whatever the binary fraction is.
TIE = 1e-9

#: Topics of this library: label, description, terms that anchor it.
TOPICS = [
    ("Articles", "texts about things named with an article", ["the"]),
    ("Places", "where something lies", ["in", "on"]),
    ("Origins", "where something comes from", ["from", "von"]),
    ("Company", "together with others", ["with", "avec", "mit"]),
    ("Being", "what is and was", ["was", "est", "ist"]),
    ("Purpose", "what something is for", ["for", "pour", "por", "für"]),
    ("Ownership", "what belongs to whom", ["of", "de"]),
    ("Licensing", "terms of use and rights", ["licensed", "license", "rights"]),
    ("Statistics", "numbers and measurement", ["percent", "average"]),
    ("Cooking", "food and recipes", ["recipe", "oven"]),
    ("Programming", "source code and how it is written", ["function", "compiler", "programming"]),
    ("Databases", "tables, queries and storage of data", ["database", "sql", "index"]),
    ("Networks", "computers that exchange messages", ["network", "router", "protocol"]),
    ("Security", "protection of systems and secrets", ["password", "encryption", "token"]),
    ("Machine learning", "models fitted to data", ["neural", "training data", "classifier"]),
    ("Hardware", "devices and their parts", ["processor", "circuit", "sensor"]),
    ("Mathematics", "proofs, numbers and structures", ["theorem", "equation", "algebra"]),
    ("Physics", "matter, energy and motion", ["quantum", "energy", "particle"]),
    ("Chemistry", "substances and their reactions", ["molecule", "acid", "reaction"]),
    ("Biology", "living things and their cells", ["species", "protein", "cell"]),
    ("Medicine", "illness, treatment and care", ["patient", "therapy", "diagnosis"]),
    ("Nutrition", "what to eat and drink", ["vitamin", "diet", "calories"]),
    ("Fitness", "training of the body", ["workout", "running", "muscle"]),
    ("Psychology", "mind, feeling and behaviour", ["anxiety", "memory", "behavior"]),
    ("Education", "schools, courses and learning", ["student", "teacher", "lesson"]),
    ("Research", "studies and their methods", ["experiment", "hypothesis", "study"]),
    ("Law", "courts, statutes and contracts", ["court", "contract", "statute"]),
    ("Politics", "government and elections", ["election", "parliament", "minister"]),
    ("History", "what happened in earlier times", ["century", "empire", "ancient"]),
    ("Geography", "land, water and borders", ["river", "mountain", "coast"]),
    ("Travel", "journeys and places to stay", ["flight", "hotel", "luggage"]),
    ("Transport", "vehicles, roads and rails", ["train", "traffic", "vehicle"]),
    ("Environment", "nature and its protection", ["climate", "forest", "pollution"]),
    ("Weather", "rain, wind and temperature", ["rain", "storm", "temperature"]),
    ("Agriculture", "fields, animals and harvests", ["harvest", "soil", "cattle"]),
    ("Energy supply", "power plants and fuels", ["solar", "battery", "fuel"]),
    ("Economy", "trade, prices and growth", ["inflation", "market", "trade"]),
    ("Finance", "money, banks and investment", ["bank", "investment", "loan"]),
    ("Accounting", "books, taxes and invoices", ["invoice", "tax", "balance sheet"]),
    ("Management", "leading teams and plans", ["project", "deadline", "strategy"]),
    ("Marketing", "brands and advertising", ["brand", "campaign", "advertising"]),
    ("Sales", "customers and orders", ["customer", "order", "discount"]),
    ("Careers", "work, pay and applications", ["salary", "interview", "employer"]),
    ("Manufacturing", "factories and production", ["factory", "assembly", "production"]),
    ("Construction", "building and its materials", ["concrete", "roof", "building"]),
    ("Housing", "homes, rent and repair", ["apartment", "rent", "kitchen"]),
    ("Gardening", "plants around the house", ["garden", "seeds", "flower"]),
    ("Family", "parents, children and relatives", ["mother", "children", "family"]),
    ("Religion", "faith and its customs", ["prayer", "church", "temple"]),
    ("Philosophy", "questions of knowledge and good", ["ethics", "philosophy", "truth"]),
    ("Literature", "novels, poems and authors", ["novel", "poem", "author"]),
    ("Language", "words, grammar and translation", ["grammar", "translation", "vocabulary"]),
    ("Music", "songs, instruments and concerts", ["song", "guitar", "orchestra"]),
    ("Visual arts", "painting, sculpture and photography", ["painting", "gallery", "photograph"]),
    ("Film", "movies and those who make them", ["movie", "actor", "director"]),
    ("Games", "play on boards and screens", ["player", "game", "puzzle"]),
    ("Sport", "matches, teams and results", ["team", "match", "league"]),
    ("News", "reports of current events", ["reporter", "headline", "press"]),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TOPICS)], "position int, label string, description string, terms array<string>")


def tag_frequency(docs: DataFrame) -> DataFrame:
    return docs.select("kb_id", F.explode("tags").alias("tag")).groupBy("kb_id", "tag").agg(F.count("*").alias("n"))


def candidates(topics: DataFrame, frequency: DataFrame) -> DataFrame:
    """kb_id, label, description, terms, source, position: the topics and a knowledge base's own tags, most used first, up to the limit. Own tags have no
    position."""
    own = frequency.withColumn("tag", F.trim("tag")).where((F.col("tag") != "") & (F.length("tag") <= TAG_LENGTH) & ~F.col("tag").contains("\n"))
    own = own.join(topics.select(F.lower("label").alias("known")), F.lower("tag") == F.col("known"), "left_anti")
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy("kb_id", F.lower("tag")).orderBy(F.desc("n"), "tag"))).where("_r = 1")
    n = topics.count()
    if n > MAX_CANDIDATES:
        raise ValueError(f"at most {MAX_CANDIDATES} topics")
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("n"), "tag"))).where(F.col("_r") <= MAX_CANDIDATES - n)
    kbs = frequency.select("kb_id").distinct()
    fixed = kbs.crossJoin(F.broadcast(topics)).select("kb_id", "label", "description", "terms", F.lit("catalog").alias("source"), "position")  # a fixed list
    tag = F.col("tag")
    return fixed.unionByName(own.select("kb_id", tag.alias("label"), F.concat(F.lit("Documents about "), tag).alias("description"), F.array(F.lower(tag)).alias("terms"), F.lit("library").alias("source"), F.lit(None).cast("int").alias("position")))


def encoded(candidates: DataFrame, encoder: Callable, signature: str) -> DataFrame:
    """Candidates with the embedding of their prompt, each distinct prompt encoded once, whatever the number of knowledge bases."""
    prompts = candidates.select(vectors.role_prefix(F.lit("query"), prompt(F.col("label"), F.col("description"))).alias("prompt")).distinct()
    of = vectors.embed(prompts, "prompt", encoder, signature)
    own = candidates.withColumn("_p", vectors.role_prefix(F.lit("query"), prompt(F.col("label"), F.col("description"))))
    return own.join(of, F.col("_p") == F.col("prompt")).drop("_p", "prompt")


def prompt(label: Column, description: Column) -> Column:
    return F.concat(label, F.lit(": "), description)


def sample_evenly(rows: DataFrame, group: str, order: str, most: int = MAX_SAMPLES, large: bool = False) -> DataFrame:
    """All rows of a group, or ``most`` of them at even distances, first and last included. ``large``: a group may hold any part of the rows."""
    if large:
        numbered = ranked(rows, [F.asc_nulls_first(group), F.asc(order)], "_i", "samples", group=group).withColumnRenamed("_i_of", "_n")
    else:
        w = Window.partitionBy(group)
        numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (most - 1)))
    return numbered.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_i").cast("long"))).drop("_i", "_n")


def evidence(samples: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, kb_id, evidence: lowered title and the first characters of each sampled chunk."""
    body = samples.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.substring("text", 1, EVIDENCE).alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return docs.select("doc_id", "kb_id", "title").join(body, "doc_id").select("doc_id", "kb_id", F.lower(F.concat_ws("\n", "title", "body")).alias("evidence"))


def anchored(terms: list[str], text: Column) -> Column:
    """Any term occurs: ASCII ones as a whole word, others anywhere. One pattern for all of them."""
    parts = [rf"(?<![a-z0-9])\Q{t}\E(?![a-z0-9])" if t.isascii() else rf"\Q{t}\E" for t in (t.lower() for t in terms)]
    return text.rlike("|".join(parts))


def _anchored_by(terms: Column, text: Column) -> Column:
    """As ``anchored`` with terms of a column; patterns are only built for terms that occur at all."""
    quoted = lambda t: F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return F.exists(terms, lambda t: F.contains(text, t) & F.when(t.rlike("[^\\x00-\\x7F]"), F.lit(True)).otherwise(F.rlike(text, quoted(t))))


class Anchors:
    """Which of some topics, each a list of lowered terms, have a term in a lowered text. Terms of ASCII letters and digits are looked up among the
    text's words, so the cost is that of reading the text once, whatever the number of topics; others are sought, ASCII ones as whole words."""

    def __init__(self, topics: list[list[str]]):
        self.words: dict[str, list[int]] = {}
        self.others: dict[str, list[int]] = {}
        for k, terms in enumerate(topics):
            for t in terms:
                (self.words if WORD.fullmatch(t) else self.others).setdefault(t, []).append(k)
        self.patterns = {t: re.compile(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])") for t in self.others if t.isascii()}

    def of(self, text: str, words: set[str]) -> set[int]:
        found = {k for w in self.words.keys() & words for k in self.words[w]}
        for t, ks in self.others.items():
            if t in text and (t not in self.patterns or self.patterns[t].search(text)):
                found.update(ks)
        return found


def anchors(evidence_rows: DataFrame, topics: list, own: DataFrame | None = None) -> DataFrame:
    """doc_id, label, anchored for each document (doc_id, kb_id, evidence) and topic (label, description, terms), and for each of the own tags of its
    knowledge base (kb_id, label, terms), which are at most ``MAX_CANDIDATES``. Each text is read once for all of them."""
    spark = evidence_rows.sparkSession
    shipped(spark)
    labels, lists = [label for label, _, _ in topics], [[t.lower() for t in terms] for _, _, terms in topics]
    rows, with_own = evidence_rows.select("doc_id", "evidence"), own is not None
    if with_own:
        # written, so that the planner knows how small it is and leaves the texts where they are
        of = written(own.groupBy("kb_id").agg(F.collect_list(F.struct("label", "terms")).alias("own")), "own-tags")
        rows = evidence_rows.join(of, "kb_id", "left").select("doc_id", "evidence", "kb_id", "own")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("label", T.StringType()), T.StructField("anchored", T.BooleanType())])

    def run(batches):
        fixed, of_kb = Anchors(lists), {}
        for whole in batches:
            for at in range(0, len(whole), ANCHORED):
                b = whole.slice(at, ANCHORED)
                where, names, hits = [], [], []
                for i, text in enumerate(b.column("evidence")):
                    text, theirs = text.as_py() or "", ([], None)
                    if with_own and b.column("own")[i].is_valid:
                        kb = b.column("kb_id")[i].as_py()
                        if kb not in of_kb:
                            if len(of_kb) >= ANCHORED:
                                of_kb.clear()
                            tags = b.column("own")[i].as_py()
                            of_kb[kb] = [o["label"] for o in tags], Anchors([o["terms"] for o in tags])
                        theirs = of_kb[kb]
                    words = set(WORD.findall(text))
                    for ls, finder in ((labels, fixed), theirs):
                        if ls:
                            found = np.zeros(len(ls), bool)
                            found[list(finder.of(text, words))] = True
                            where.append(np.full(len(ls), i))
                            names += ls
                            hits.append(found)
                if names:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.concatenate(where))), pa.array(names, pa.string()), pa.array(np.concatenate(hits))], names=["doc_id", "label", "anchored"])

    return rows.mapInArrow(run, schema)


def semantic(samples: DataFrame, candidates: DataFrame, block: int = DOCUMENTS) -> DataFrame:
    """doc_id, label, semantic of each document's sampled chunks (doc_id, kb_id, embedding) with the topics of its knowledge base (kb_id, label,
    embedding): most the best of the cosines (moved into 0 to 1), some the mean of their best quarter.

    A document is one row of at most ``MAX_SAMPLES`` vectors; blocks of them meet the at most ``MAX_CANDIDATES`` topics as one product of matrices."""
    shipped(samples.sparkSession)

    def hold(t: pa.Table):
        lists = t.column("vectors").combine_chunks()
        return t.column("doc_id"), lists.value_lengths().to_numpy(), blocks.vectors_of(pa.chunked_array([lists.flatten()]))

    def match(held, topics: pa.Table):
        ids, sizes, own = held
        similar = np.round(0.5 + 0.5 * blocks.cosines(own, blocks.vectors_of(topics.column("topic")), (int(sizes.sum()), len(topics))), 6)
        starts, out = np.cumsum(sizes) - sizes, np.zeros((len(ids), len(topics)))
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            best = -np.sort(-similar[starts[at][:, None] + np.arange(n)], axis=1)
            out[at] = np.round(0.65 * best[:, 0] + 0.35 * best[:, : max(1, -(-n // 4))].mean(axis=1) + TIE, 6)
        n, m = out.shape
        yield from pa.table([ids.take(pa.array(np.repeat(np.arange(n), m))), topics.column("label").take(pa.array(np.tile(np.arange(m), n))), pa.array(out.ravel())], names=["doc_id", "label", "semantic"]).to_batches()

    def run(batches):
        yield from blocks.block_by_block(batches, "kb_id", hold, match, MAX_CANDIDATES)

    docs = samples.groupBy("kb_id", "doc_id").agg(F.collect_list(F.col("embedding").cast("array<float>")).alias("vectors"))
    topics = candidates.select("kb_id", "label", F.col("embedding").cast("array<float>").alias("topic"))
    return blocks.dealt(docs, topics, "kb_id", "doc_id", block).mapInArrow(run, "doc_id long, label string, semantic double")


def select(ranked: DataFrame) -> DataFrame:
    """doc_id, position, label, rank from (doc_id, label, semantic, anchored), at most ``MAX_CANDIDATES`` a document; documents without contrast get no tags."""
    rows = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("semantic", "label", "anchored"))).alias("up"))
    rows = rows.select("doc_id", F.get("up", F.expr("size(up) div 2").cast("int"))["semantic"].alias("median"), F.round(F.get("up", F.size("up") - 1)["semantic"] - F.get("up", F.lit(0))["semantic"], 6).alias("spread"), "up")
    down = F.array_sort(F.transform("up", lambda x: F.struct((-F.round(x["semantic"] + F.when(x["anchored"], 0.07).otherwise(0.0), 6)).alias("r"), x["label"].alias("label"), x["semantic"].alias("semantic"), x["anchored"].alias("anchored"))))
    rows = rows.where("spread >= 0.015").select("doc_id", "median", down.alias("down"))

    def passes(x: Column) -> Column:
        least, margin = F.when(x["anchored"], 0.30).otherwise(0.48), F.when(x["anchored"], 0.05).otherwise(0.08)
        return (x["semantic"] >= least) & (x["semantic"] >= F.round(F.col("median") + margin, 6)) & (-x["r"] >= F.round(-F.get("down", F.lit(0))["r"] - 0.10, 6))

    picked = rows.select("doc_id", F.posexplode(F.slice(F.filter("down", passes), 1, MAX_TAGS)).alias("i", "x"))
    return picked.select("doc_id", (F.col("i") + 1).alias("position"), "x.label", (-F.col("x.r")).alias("rank"))


def targets(docs: DataFrame) -> DataFrame:
    """Ready documents without tags."""
    return docs.where((F.col("status") == "ready") & (F.size("tags") == 0))


def apply(docs: DataFrame, proposed: DataFrame) -> DataFrame:
    """doc_id, outcome: proposals (doc_id, seen_at, new_tags) are written only where the document is ready, untagged and unchanged."""
    p = proposed.join(docs.select("doc_id", "status", "tags", "updated_at"), "doc_id", "left")
    fine = (F.col("status") == "ready") & (F.size("tags") == 0) & (F.col("updated_at") == F.col("seen_at"))
    return p.select("doc_id", F.when(F.coalesce(fine, F.lit(False)), "written").otherwise("stale").alias("outcome"), F.array_join("new_tags", ",").alias("new_tags"))


def normalized(tags: Column) -> Column:
    """Trimmed, distinct and sorted tags; the first dozen, each then cut to its length."""
    clean = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(F.slice(F.array_sort(F.array_distinct(clean)), 1, KEPT_TAGS), lambda t: F.substring(t, 1, TAG_LENGTH))


def parsed_input(text: Column) -> Column:
    parts = F.transform(F.split(text, "[,，、;；\n]"), lambda t: F.trim(t))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))
