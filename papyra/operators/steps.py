"""Steps that ask a language model or another service, as rows: a prompt column, one operator that answers it, a parser of the answer.

Every step takes a client maker (see ``external``); ``external.stub`` serves for dry runs. Prompts are short forms; texts
that a prompt quotes are cut at the step's limit, the answers are used whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import markdown as M
from papyra.functions import text as T
from papyra.operators import assembly, external, reports
from papyra.operators.common import stored

# Limits of quoted texts, rounds and shares of the loops.
QUOTED, REORGANISED, ROUNDS, FLOOR, GAIN = 30_000, 100_000, 3, 0.65, 0.05
ISSUE = "struct<type:string,severity:string,location:string,problem:string,description:string,suggestion:string>"


def asked(df: DataFrame, prompt: Column, client: external.Client, to: str = "answer", cache: DataFrame | None = None) -> DataFrame:
    """Rows with the answer to their prompt in ``to``. Each distinct prompt is sent once and its answer stored before it is
    joined back by hash, so a lost executor sends nothing again."""
    d = df.withColumn("_p", prompt)
    answers = stored(external.answered(d, "_p", client, cache), "answers").withColumnRenamed("answer", to)
    return d.withColumn("prompt_hash", F.md5("_p")).join(answers, "prompt_hash", "left").drop("_p", "prompt_hash")


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def cut(name: str, n: int = QUOTED) -> Column:
    return F.substring(F.coalesce(F.col(name), F.lit("")), 1, n)


def outlines(raw: DataFrame, key: str, text: str, client: external.Client) -> DataFrame:
    """(key, title, summary, keywords, chapters, parsed) by F4 of the answer."""
    a = asked(raw.select(key, text), say("Give title, summary, at most five keywords and an outline with densities as JSON for:\n", cut(text)), client)
    return a.select(key, M.outline(F.col("answer")).alias("o")).select(key, "o.*")


def structures(raw: DataFrame, key: str, text: str, client: external.Client) -> DataFrame:
    """(key, chapters) by F5 of the answer."""
    return asked(raw.select(key, text), say("Give the chapters as JSON for:\n", cut(text)), client).select(key, M.structure(F.col("answer")).alias("chapters"))


def per_chapter(ch: DataFrame, key: str, task: str, client: external.Client, *quoted: str) -> DataFrame:
    """Every chapter rewritten under a task, with what stands before and after it and further
    quoted columns: (key, chap_ord, title, body). A blank answer keeps the chapter."""
    d = ch.join(reports.contexts(ch, key), [key, "chap_ord"])
    extra = [x for q in quoted for x in (f"\n[{q}]\n", F.col(q))]
    a = asked(d, say(task, "\n# ", F.col("title"), "\n", F.col("body"), "\n[before]\n", F.col("prev_summary"), "\n[after]\n", F.col("next_summary"), *extra), client)
    return a.select(key, "chap_ord", "title", F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", F.col("body")).otherwise(F.col("answer")).alias("body"))


def assembled_sections(raw: DataFrame, key: str, text: str, sections: str, size: int, client: external.Client) -> DataFrame:
    """(key, text): the windows of F16 answered one by one, the answers in order."""
    w = reports.section_windows(raw, key, text, sections, size).where(T.strip(F.col("part")) != "")
    a = asked(w, say("Assemble the section from:\n", F.col("part")), client).where(F.trim("answer") != "")
    g = a.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("window", "answer"))).alias("l"))
    return g.select(key, F.array_join(F.transform("l", lambda x: x["answer"]), "\n\n").alias("text"))


def experts(rep: DataFrame, key: str, text: str, roles: dict[str, str], client: external.Client) -> tuple[DataFrame, DataFrame]:
    """Opinions (key, role, opinion, inventions) of every role on every report, and the arbitrated one (key, opinion)."""
    role = F.explode(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])).alias("role", "_task")
    got = asked(rep.select(key, text, role), say(F.col("_task"), "\n", cut(text)), client, "opinion").select(key, "role", "opinion", T.hallucination_section(F.col("opinion")).alias("inventions"))
    got = stored(got, "opinions")
    all_ = got.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("role", "opinion"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["opinion"])), "\n\n").alias("_all"))
    return got, asked(all_, say("Weigh these opinions:\n", cut("_all")), client, "opinion").select(key, "opinion")


def evaluations(rep: DataFrame, key: str, text: str, dimensions: list[str], client: external.Client, rubric: str = "") -> DataFrame:
    """(key, dimension, score, assessment, issues); a score that does not parse is -1."""
    d = rep.select(key, text, F.explode(F.array(*map(F.lit, dimensions))).alias("dimension"))
    a = asked(d, say("Score 0 to 100 as JSON (score, assessment, issues): ", F.col("dimension"), "\n", M.section(F.lit(rubric), F.col("dimension")), "\n", cut(text)), client)
    j = F.from_json(T.clean_json(F.col("answer")), f"score int, assessment string, issues array<{ISSUE}>")
    return a.select(key, "dimension", F.coalesce(j["score"], F.lit(-1)).alias("score"), F.coalesce(j["assessment"], F.lit("")).alias("assessment"), F.coalesce(j["issues"], F.array().cast(f"array<{ISSUE}>")).alias("issues"))


def checked_facts(rep: DataFrame, key: str, text: str, client: external.Client) -> DataFrame:
    """(key, problem): lines of the check of at most ten facts that are marked as wrong."""
    facts = asked(rep.select(key, text), say("List the facts, one a line:\n", cut(text)), client).select(key, F.explode(M.list_lines(F.col("answer"), 15, 10)).alias("fact"))
    said = asked(facts, say("Mark with ✅ or ❌: ", F.col("fact")), client)
    return said.select(key, F.explode(F.split("answer", "\n")).alias("problem")).where(F.col("problem").contains("❌")).select(key, T.strip(F.col("problem")).alias("problem"))


def consistency(rep: DataFrame, key: str, text: str, client: external.Client) -> DataFrame:
    """(key, issues, report)."""
    a = asked(rep.select(key, text), say("List contradictions as a JSON array (type, severity, location, description, suggestion):\n", cut(text)), client)
    issues = F.coalesce(F.from_json(T.clean_json(F.col("answer")), f"array<{ISSUE}>"), F.array().cast(f"array<{ISSUE}>"))
    return a.select(key, issues.alias("issues")).withColumn("report", M.issue_list(F.col("issues")))


def reachable(cites: DataFrame, url: str, check: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Rows with ``status``: each distinct address checked once by an injected function (ok or unreachable); blank ones are unreachable."""
    a = asked(cites, F.when(F.trim(F.coalesce(url, F.lit(""))) != "", F.col(url)), check, "status")
    return a.withColumn("status", F.coalesce("status", F.lit("unreachable")))


def compressed(ch: DataFrame, key: str, client: external.Client, rounds: int = ROUNDS, floor: float = FLOOR, gain: float = GAIN) -> DataFrame:
    """Chapters shortened round by round. A report stops once it is under ``floor`` of its first length or a round
    gains less than ``gain``; a chapter that loses over 70 % in a round keeps its text. Rounds are stored."""
    size = ch.groupBy(key).agg(F.sum(F.length("body")).alias("first"))
    now = stored(ch.join(size, key).select(key, "chap_ord", "title", "body", "first", F.lit(True).alias("on")), "round")
    for _ in range(rounds):
        if now.where("on").isEmpty():
            break
        target = F.floor(F.length("body") * 0.9).cast("string")
        a = asked(now.where("on"), say("Shorten to ", target, " characters:\n", F.col("body")), client)
        short = a.withColumn("new", F.when(F.length("answer") >= 0.3 * F.length("body"), F.col("answer")).otherwise(F.col("body")))
        w = Window.partitionBy(key)
        before, after = F.sum(F.length("body")).over(w), F.sum(F.length("new")).over(w)
        go = (after >= floor * F.col("first")) & (after <= (1 - gain) * before)
        now = stored(short.select(key, "chap_ord", "title", F.col("new").alias("body"), "first", go.alias("on")).unionByName(now.where(~F.col("on"))), "round")
    return now.select(key, "chap_ord", "title", "body")


SEARCH = "text string, citations array<struct<url:string,title:string>>"


def cited_search(df: DataFrame, query: str, client: external.Client) -> DataFrame:
    """Rows with ``content`` and ``citations`` of a search whose client answers in JSON (text, citations); other answers are content without citations."""
    j = F.from_json("answer", SEARCH)
    a = asked(df, F.col(query), client)
    return a.select(*df.columns, F.coalesce(j["text"], F.col("answer")).alias("content"), F.coalesce(j["citations"], F.array().cast("array<struct<url:string,title:string>>")).alias("citations"))


def research(topics: DataFrame, key: str, topic: str, client: external.Client, search: external.Client, questions: int = 5, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Findings (key, round, question, content, citations) of planned and following questions, and reports (key, report) with
    each source once. Rounds end when no topic has a further question."""
    plan = asked(topics.select(key, topic), say("List research questions on ", F.col(topic)), client).select(key, topic, F.explode(M.list_lines(F.col("answer"), 10, questions)).alias("question"))
    found, todo = None, stored(plan, "plan")
    for n in range(rounds):
        if todo.isEmpty():
            break
        got = stored(cited_search(todo, "question", search).withColumn("round", F.lit(n)), "findings")
        found = got if found is None else found.unionByName(got)
        said = got.groupBy(key, topic).agg(F.array_join(F.sort_array(F.collect_list("content")), "\n").alias("_c"))
        more = asked(said, say("What is still open on ", F.col(topic), "?\n", cut("_c")), client).where(~F.coalesce(T.keyword_flags(F.col("answer"))["covered"], F.lit(False)))
        todo = stored(more.select(key, topic, F.explode(M.list_lines(F.col("answer"), 10, 3)).alias("question")), "plan")
    if found is None:
        return cited_search(plan, "question", search).withColumn("round", F.lit(0)).drop(topic).where("false"), topics.select(key, F.lit("").alias("report")).where("false")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("round", "question", "content", "citations"))), lambda x: F.concat(F.lit("### "), x["question"], F.lit("\n"), x["content"], F.lit("\n"), M.sources_list(x["citations"], 5))), "\n\n")
    sources = F.array_distinct(F.filter(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("round", "question", "citations"))), lambda x: x["citations"])), lambda c: F.trim(F.coalesce(c["url"], F.lit(""))) != ""))
    g = found.groupBy(key, topic).agg(text.alias("_t"), sources.alias("_s"))
    rep = asked(g, say("Write a report on ", F.col(topic), " from:\n", cut("_t")), client)
    return found.drop(topic), rep.select(key, say("# ", F.col(topic), "\n\n", F.col("answer"), "\n\n## 参考来源\n\n", M.sources_list(F.col("_s"))).alias("report"))


def quality(rep: DataFrame, key: str, text: str, client: external.Client) -> DataFrame:
    """(key, coverage, structure, language, density, overall, commentary); what does not parse is -1."""
    names = ["coverage", "structure", "language", "density", "overall"]
    a = asked(rep.select(key, text), say("Score as JSON (coverage, structure, language, density, overall, commentary):\n", cut(text)), client)
    j = F.from_json(T.clean_json(F.col("answer")), ", ".join(f"{n} int" for n in names) + ", commentary string")
    return a.select(key, *[F.coalesce(j[n], F.lit(-1)).alias(n) for n in names], F.coalesce(j["commentary"], F.lit("")).alias("commentary"))


def claims(rep: DataFrame, key: str, text: str, client: external.Client) -> DataFrame:
    """(key, claims); two versions are compared word for word by ``assembly.drift``."""
    return asked(rep.select(key, text), say("List the core claims, one a line:\n", cut(text)), client).select(key, M.list_lines(F.col("answer"), 10, 1_000_000).alias("claims"))


def reorganised(corpora: DataFrame, key: str, text: str, client: external.Client, most: int = REORGANISED) -> DataFrame:
    """(key, text): the first part reorganised, the rest as it stands behind it."""
    a = asked(corpora.select(key, text), say("Remove repetitions and put in order:\n", cut(text, most)), client)
    rest = F.substr(F.coalesce(text, F.lit("")), F.lit(most + 1))
    return a.select(key, F.concat(F.col("answer"), F.when(rest != "", F.concat(F.lit("\n\n"), rest)).otherwise("")).alias("text"))


def full_report(raw: DataFrame, key: str, text: str, client: external.Client, roles: dict[str, str], tasks: list[str] | None = None) -> DataFrame:
    """Outline, sections, expert opinions, then every task over the chapters: (key, report)."""
    o = stored(outlines(raw, key, text, client), "outlines")
    body = raw.join(o.select(key, F.size("chapters").alias("_n")), key)
    ch = o.join(assembled_sections(body, key, text, "_n", 50_000, client).withColumnRenamed("text", "_s"), key, "left").select(key, "title", F.posexplode("chapters").alias("chap_ord", "c"), "_s", F.size("chapters").alias("_n"))
    part = F.substr(F.coalesce("_s", F.lit("")), F.floor(F.col("chap_ord") * F.length("_s") / F.col("_n")).cast("int") + 1, F.floor(F.length("_s") / F.col("_n")).cast("int") + 1)
    ch = stored(ch.select(key, "chap_ord", F.col("c.level1").alias("title"), F.coalesce(part, F.lit("")).alias("body")), "chapters")
    _, opinion = experts(raw, key, text, roles, client)
    for task in tasks if tasks is not None else ["Revise by the opinion.", "Turn into prose.", "Check the citations."]:
        ch = stored(per_chapter(ch.join(opinion, key, "left"), key, task, client, "opinion"), "chapters")
    whole = assembly.merge_same_titles(ch, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("island", "title", "body"))).alias("l"))
    return o.join(whole, key).select(key, M.assembled(F.col("title"), F.col("summary"), F.col("keywords"), F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["body"].alias("body")))).alias("report"))
