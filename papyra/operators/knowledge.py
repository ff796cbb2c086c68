"""Mode B: entities with contexts, relations, merged aliases and the graph's report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import graph
from papyra.operators.assembly import LABELS

#: A recogniser maker is called once per task and returns a function from text to (entities, relations):
#: entities as (start, end, label), relations as (subject, predicate, object).
Recogniser = Callable[[], Callable[[str], tuple[list[tuple[int, int, str]], list[tuple[str, str, str]]]]]
CONTEXT, CONTEXTS = 100, 5


def by_dictionary(names: dict[str, str], verbs: tuple[str, ...] = ()) -> Recogniser:
    """A recogniser that knows given names and their labels; two names of a sentence with one of ``verbs`` between them are related by it."""

    def make():
        import re

        known = re.compile("|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) or r"(?!)")
        said = re.compile(r"\b(" + "|".join(map(re.escape, verbs)) + r")\b") if verbs else None

        def run(text: str):
            ents = [(m.start(), m.end(), names[m.group()]) for m in known.finditer(text)]
            rels = []
            for (a, b, _), (c, d, _) in zip(ents, ents[1:]):
                between = text[b:c]
                if said and not re.search(r"[.!?。！？]", between) and (m := said.search(between)):
                    rels.append((text[a:b], m.group(1), text[c:d]))
            return ents, rels

        return run

    return make


# What the pattern recogniser goes by, in order of precedence.
PATTERNS = [
    ("ORG", r"(?:[A-Z][\w’'&-]+ ){1,3}(?:Institute|Council|Energy|Holdings|Grid|Partners|Works|Observatory|Agency|Ministry|University|Bank|Company|Group|Gruppe|Werke|Netze|Institut|Instituto|Grupo|Conseil|Groupe)\b|[\u4e00-\u9fff]{2,6}?(?:集团|公司|委员会|研究院|智库|电力|能源|观察)|[\u30a0-\u30ff]{2,8}(?:機構|研究所|電力|エネルギー)"),
    ("PERSON", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|M|Mme)\.? [A-ZÀ-Þ][\w-]+(?: [A-ZÀ-Þ][\w-]+)?"),
    ("DATE", r"\b(?:19|20)\d\d-\d\d-\d\d\b|(?:19|20)\d\d\s?年(?:\d{1,2}月)?(?:\d{1,2}日)?|\b(?:19|20)\d\d\b"),
    ("QUANTITY", r"\d[\d.,]*\s?(?:%|percent\b|MW\b|GW\b|GWh\b|hours\b|tonnes\b|kilometres\b|households\b|million \w+|万户|亿元|公里|兆瓦|吉瓦|小时|万吨|台套|个百分点)"),
    ("GPE", r"(?:(?<=\bin )|(?<=\bat )|(?<=\bIn )|(?<=\ben )|(?<=\bà )|(?<=\bem ))[A-ZÀ-Þ][a-zß-ÿ]+"),
]


def by_patterns() -> Recogniser:
    """A recogniser by patterns of names, dates and quantities; two entities of a sentence with a verb form between them are related by it."""

    def make():
        import re

        any_ = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS))
        verb = re.compile(r"\b(?:is|are|was|were|has|have|had|said|set|[a-z]{3,}(?:ed|es))\b")

        def run(text: str):
            ents = [(m.start(), m.end(), m.lastgroup) for m in any_.finditer(text)]
            rels = []
            for (a, b, _), (c, d, _) in zip(ents, ents[1:]):
                between = text[b:c]
                if len(between) < 120 and not re.search(r"[.!?。！？\n]", between) and (m := verb.search(between)):
                    rels.append((text[a:b].strip(), m.group(), text[c:d].strip()))
            return ents, rels

        return run

    return make


def recognised(docs: DataFrame, recogniser: Recogniser, key: str = "file_id", text: str = "body") -> DataFrame:
    """M5, M6: (doc, pos, name, label, context, subject, predicate, object): a row per mention and per relation, by an injected recogniser.
    Labels are those of the report; names have two characters at least. The whole text is read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = recogniser()
        for f in frames:
            out = []
            for k, t in zip(f["doc"], f["text"]):
                ents, rels = find(t or "")
                kept = [(a, b, label) for a, b, label in ents if label in LABELS and len(t[a:b].strip()) >= 2]
                out += [(k, i, t[a:b].strip(), label, t[max(0, a - CONTEXT) : b + CONTEXT].replace("\n", " ").strip(), None, None, None) for i, (a, b, label) in enumerate(kept)]
                out += [(k, i, None, None, None, *r) for i, r in enumerate(rels)]
            yield pd.DataFrame(out, columns=["doc", "pos", "name", "label", "context", "subject", "predicate", "object"])

    src = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return src.mapInPandas(run, f"doc {src.schema['doc'].dataType.simpleString()}, pos int, name string, label string, context string, subject string, predicate string, object string")


def entities(mentions: DataFrame) -> DataFrame:
    """(name, label of the first mention, mentions, docs, contexts): the first five contexts in order of (doc, pos).

    Contexts are ranked within (name, doc) first, so at most five a document reach the name's own ranking."""
    m = mentions.where("name IS NOT NULL")
    near = m.withColumn("_r", F.row_number().over(Window.partitionBy("name", "doc").orderBy("pos"))).where(F.col("_r") <= CONTEXTS)
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("doc", "pos"))).where(F.col("_r") <= CONTEXTS)
    lists = best.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("_r", "context"))).alias("l")).select("name", F.transform("l", lambda x: x["context"]).alias("contexts"))
    return graph.entity_counts(m).join(lists, "name")


def merged(counted: DataFrame, mentions: DataFrame) -> DataFrame:
    """(label, name, mentions, docs, aliases): aliases folded into canonical names; documents counted once for all names of an entity."""
    named = graph.resolve(counted)
    docs = mentions.where("name IS NOT NULL").select("name", "doc").distinct().join(named.select("label", "name", "canonical"), "name").groupBy("label", "canonical").agg(F.countDistinct("doc").alias("docs"))
    sums = named.groupBy("label", "canonical").agg(F.sum("mentions").alias("mentions"), F.sort_array(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name")))).alias("aliases"))
    return sums.join(docs, ["label", "canonical"]).select("label", F.col("canonical").alias("name"), "mentions", "docs", "aliases")


def label_top(ents: DataFrame, n: int = 30) -> DataFrame:
    """The n most mentioned entities of each label, labels in the report's order: adds label_ord and rank. Ranked in two
    steps, so that no task ranks a whole label."""
    order = F.coalesce(*[F.when(F.col("label") == x, F.lit(i)) for i, x in enumerate(LABELS)])
    e = ents.withColumn("label_ord", order).where("label_ord IS NOT NULL")
    by = [F.desc("mentions"), F.col("name")]
    some = e.withColumn("_s", F.pmod(F.xxhash64("name"), F.lit(64))).withColumn("_r", F.row_number().over(Window.partitionBy("label", "_s").orderBy(*by))).where(F.col("_r") <= n)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*by))).where(F.col("rank") <= n).drop("_s", "_r")


def graph_report(docs: DataFrame, ents: DataFrame, mentions: DataFrame) -> str:
    """M8: the report of mode B: entities by label, the hundred most frequent relations, fifty paragraphs richest in the twenty
    most mentioned entities. The driver gets these bounded lists only."""
    lines = ["## 实体"]
    for r in label_top(ents).orderBy("label_ord", "rank").collect():
        also = f" (aka {', '.join(r.aliases)})" if r.aliases else ""
        lines.append(f"- {r.label}: {r['name']}{also} [{r.mentions} mentions, {r.docs} docs]")
    lines += ["", "## 关系"]
    for r in graph.relation_counts(mentions.where("subject IS NOT NULL").select("subject", "predicate", "object")).collect():
        lines.append(f"- {r.subject} --{r.predicate}--> {r.object}" + (f" (x{r.n})" if r.n > 1 else ""))
    lines += ["", "## 证据段落"]
    top = [r["name"] for r in ents.orderBy(F.desc("mentions"), "name").limit(20).collect()]
    from papyra.operators.corpus import paragraphs

    label = docs.select("file_id", T.source_label(F.col("source"), F.col("published"), F.col("filename")).alias("source"))
    rich = graph.evidence(paragraphs(docs), top)
    for r in rich.join(label, "file_id").orderBy(F.desc("hits"), "file_id", "para_ord").collect():
        lines += [f"> [来源: {r.source}] {r.para}", ""]
    return "\n".join(lines).strip()
