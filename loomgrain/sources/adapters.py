"""Source records to governed blocks, queries and gold, as DataFrame plans: papers, supporting-fact QA, candidate-document QA, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import text as T

_EMPTY = "array<string>"


def _blocks(rows: DataFrame, dataset: str, split: str) -> DataFrame:
    """Adds the columns that every block has."""
    return rows.select(
        "doc_id", F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.col("doc_id").alias("source_doc_id"), "block_id", "type", "text",
        F.col("order").cast("int").alias("order"), "level", "title_path", "section_name", F.lit(None).cast("string").alias("asset_file") if "asset_file" not in rows.columns else F.col("asset_file"),
        F.coalesce("entity_tags", F.array().cast(_EMPTY)).alias("entity_tags") if "entity_tags" in rows.columns else F.array().cast(_EMPTY).alias("entity_tags"),
        *(["parent_heading_id"] if "parent_heading_id" in rows.columns else []),
    )


# ---- papers -------------------------------------------------------------------------------


def paper_blocks(papers: DataFrame, dataset: str = "papers", split: str = "train") -> DataFrame:
    """papers: id, title, abstract, sections array<struct<name,paragraphs>>, figures array<struct<caption,file>>.

    Title, an Abstract heading and the abstract, then for each section headings for every
    path prefix not met before and its paragraphs, then captions; one running order. A
    block's parent is the heading of its path, a heading's that of the path above it.
    """
    doc = papers.withColumn("doc_id", T.safe_id("id"))
    row = "struct<part:int,a:int,b:int,c:int,kind:string,text:string,level:int,path:array<string>,asset:string,section:string>"

    def item(part: int, a: Column, b: Column, c: Column, kind: Column, text: Column, level: Column, path: Column, asset: Column, name: Column | None = None) -> Column:
        return F.struct(F.lit(part), a, b, c, kind, text, level, path, asset, F.lit(None).cast("string") if name is None else name).cast(row)

    zero, none, no_path = F.lit(0), F.lit(None).cast("string"), F.array().cast(_EMPTY)
    head = F.array(
        item(0, zero, zero, zero, F.lit("title"), T.normalize("title"), zero, no_path, none),
        item(1, zero, zero, zero, F.when(T.normalize("abstract") != "", F.lit("heading")), F.lit("Abstract"), F.lit(1), F.array(F.lit("Abstract")), none),
        item(1, zero, zero, F.lit(1), F.lit("abstract"), T.normalize("abstract"), F.lit(1), F.array(F.lit("Abstract")), none),
    )

    def section(s: Column, i: Column) -> Column:
        path = T.section_path(s["name"])
        headings = F.transform(
            F.sequence(F.lit(1), F.size(path)),
            lambda d: item(2, i, zero, d, F.lit("heading"), F.element_at(path, d), d, F.slice(path, 1, d), none),
        )
        bodies = F.transform(s["paragraphs"], lambda p, j: item(2, i, j + 1, zero, F.lit("paragraph"), T.normalize(p), F.size(path), path, none, T.normalize(s["name"])))
        # A section without a name has no headings and no place: it is left out.
        return F.when(T.normalize(s["name"]) != "", F.concat(headings, bodies)).otherwise(F.slice(F.concat(headings, bodies), 1, 0))

    body = F.flatten(F.transform("sections", section))
    figures = F.transform(
        "figures",
        lambda f, i: item(3, i, zero, zero, T.caption_type(f["caption"]), T.normalize(f["caption"]), F.lit(1), F.array(F.lit("Figures and Tables")), f["file"]),
    )
    empty = F.array().cast(f"array<{row}>")
    each = doc.select("doc_id", F.explode(F.concat(head, F.coalesce(body, empty), F.coalesce(figures, empty))).alias("x")).select("doc_id", "x.*")
    each = each.filter("kind IS NOT NULL AND text <> ''")
    first = F.row_number().over(Window.partitionBy("doc_id", "kind", F.to_json("path")).orderBy("part", "a", "b", "c"))
    kept = each.withColumn("first", first).filter("kind <> 'heading' OR first = 1")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "a", "b", "c"))
    numbered = kept.withColumn("order", order).withColumnsRenamed({"kind": "type", "path": "title_path", "asset": "asset_file"})
    # The section's name: fixed ones for title, abstract and captions, a heading's own path, and a section's name as it was given.
    section = (
        F.when(F.col("type") == "title", "Title").when(F.col("part") == 2, F.when(F.col("type") == "heading", F.array_join("title_path", " ::: ")).otherwise(F.col("section")))
        .otherwise(F.array_join("title_path", " ::: "))
    )
    named = numbered.withColumns({"block_id": F.format_string("%s_%s_%05d", "doc_id", "type", "order"), "section_name": section})
    above = F.when(F.col("type") == "heading", F.slice("title_path", 1, F.greatest(F.size("title_path") - 1, F.lit(0)))).when(F.col("part") < 3, F.col("title_path"))
    heads = named.filter("type = 'heading'").select("doc_id", F.to_json("title_path").alias("_up"), F.col("block_id").alias("parent_heading_id"))
    return _blocks(named.withColumn("_up", F.to_json(above)).join(heads, ["doc_id", "_up"], "left"), dataset, split)


def paper_answer(a: Column) -> Column:
    """text, type, unanswerable of one answer: free form, else spans, else yes or no."""
    spans = F.array_join(F.array_distinct(F.filter(F.transform(a["extractive_spans"], T.normalize), lambda s: s != "")), " | ")
    free = T.normalize(a["free_form_answer"])
    no = F.coalesce(a["unanswerable"], F.lit(False))
    kind = F.when(no, "unanswerable").when(free != "", "free_form").when(spans != "", "extractive").when(a["yes_no"].isNotNull(), "yes_no").otherwise("unknown")
    text = F.when(no, "UNANSWERABLE").when(free != "", free).when(spans != "", spans).when(a["yes_no"], "Yes").when(~a["yes_no"], "No").otherwise("")
    return F.struct(text.alias("text"), kind.alias("type"), no.alias("unanswerable"))


def paper_queries(papers: DataFrame) -> DataFrame:
    """papers with qas array<struct<question,question_id,answers,nlp_background,topic_background,paper_read>>: one row a question, with its evidence texts."""
    doc = papers.select(T.safe_id("id").alias("doc_id"), F.explode("qas").alias("q")).select("doc_id", "q.*")
    each = doc.withColumn("parsed", F.transform("answers", paper_answer))
    texts = F.array_distinct(F.filter(F.transform("parsed", lambda p: p["text"]), lambda t: t != ""))
    gold = F.flatten(F.transform("answers", lambda a: F.concat(F.coalesce(a["evidence"], F.array().cast(_EMPTY)), F.coalesce(a["highlighted_evidence"], F.array().cast(_EMPTY)))))
    difficulty = F.concat_ws(";", F.concat(F.lit("nlp="), "nlp_background"), F.concat(F.lit("topic="), "topic_background"), F.concat(F.lit("paper_read="), "paper_read"))
    return each.select(
        F.col("question_id").alias("query_id"), "doc_id", T.normalize("question").alias("question"), F.array_join(texts, " | ").alias("answer"),
        F.coalesce(F.element_at("parsed", -1)["type"], F.lit("unknown")).alias("answer_type"),
        F.forall("parsed", lambda p: p["unanswerable"]).alias("is_unanswerable"),
        F.array_distinct(F.filter(F.transform(gold, T.normalize), lambda t: t != "")).alias("gold_evidence_texts"), difficulty.alias("difficulty"),
    )


# ---- question answering over given contexts ------------------------------------------------


def fact_blocks(records: DataFrame, dataset: str = "facts", split: str = "train") -> DataFrame:
    """records: id, question, answer, context array<struct<title,sentences>>, facts array<struct<title,sentence>>: a sentence is a block under its article."""
    each = records.select(T.safe_id_or_hash("id").alias("doc_id"), F.posexplode("context").alias("i", "c")).select("doc_id", "i", F.col("c.title").alias("title"), F.posexplode("c.sentences").alias("j", "text"))
    full = each.filter(T.normalize("text") != "").withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "j")))
    tags = F.slice(F.array_distinct(F.concat(F.array("title"), T.entities("text"))), 1, 12)
    return _blocks(
        full.withColumns(
            {
                "block_id": F.format_string("%s_c%02d_s%03d", "doc_id", F.col("i") + 1, F.col("j") + 1), "type": F.lit("paragraph"), "level": F.lit(1),
                "title_path": F.array("title"), "section_name": F.col("title"), "entity_tags": tags,
            }
        ), dataset, split,
    )


def fact_gold(records: DataFrame) -> DataFrame:
    """query_id, doc_id, gold_block_ids, n_missing, is_unanswerable: supporting facts met by (title, sentence)."""
    doc = records.withColumn("doc_id", T.safe_id_or_hash("id"))
    where = doc.select("doc_id", F.posexplode("context").alias("i", "c")).select("doc_id", "i", F.col("c.title").alias("title"), F.posexplode("c.sentences").alias("j", "text"))
    held = where.filter(T.normalize("text") != "").select("doc_id", "title", F.col("j").alias("sentence"), F.format_string("%s_c%02d_s%03d", "doc_id", F.col("i") + 1, F.col("j") + 1).alias("block_id"))
    facts = doc.select("doc_id", F.posexplode("facts").alias("p", "f")).select("doc_id", "p", "f.title", "f.sentence")
    met = facts.join(held, ["doc_id", "title", "sentence"], "left").groupBy("doc_id").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("block_id").isNotNull(), F.struct("p", "block_id")))), lambda x: x["block_id"])).alias("gold_block_ids"),
        F.count_if(F.col("block_id").isNull()).alias("n_missing"),
    )
    out = doc.select("doc_id", "answer").join(met, "doc_id", "left")
    none = F.coalesce(F.size("gold_block_ids"), F.lit(0)) <= 0
    return out.select(F.col("doc_id").alias("query_id"), "doc_id", F.coalesce("gold_block_ids", F.array().cast(_EMPTY)).alias("gold_block_ids"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), (none | (T.normalize("answer") == "")).alias("is_unanswerable"))


def candidate_blocks(records: DataFrame, dataset: str = "candidates", split: str = "dev") -> DataFrame:
    """records: question_id, question, answers, answer_docs, documents array<struct<title,paragraphs,segmented_title,is_selected,most_related_para>>."""
    each = records.select(T.safe_id_or_hash("question_id").alias("doc_id"), F.posexplode("documents").alias("i", "d")).select("doc_id", "i", "d", F.posexplode("d.paragraphs").alias("j", "text"))
    full = each.filter(T.normalize("text") != "").withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "j")))
    title = F.concat(F.lit("候选文档"), (F.col("i") + 1).cast("string"), F.lit(": "), T.normalize("d.title"))
    tags = F.filter(F.slice("d.segmented_title", 1, 8), lambda t: ~t.isin("_", "-", "|", "") & t.isNotNull())
    return _blocks(
        full.withColumns(
            {
                "block_id": F.format_string("%s_d%02d_p%03d", "doc_id", F.col("i") + 1, F.col("j") + 1), "type": F.lit("paragraph"), "level": F.lit(1),
                "title_path": F.array(title), "section_name": title, "entity_tags": tags,
            }
        ), dataset, split,
    )


def candidate_gold(records: DataFrame) -> DataFrame:
    """query_id, gold_block_ids, answer: the most related paragraph of selected documents, else of the answer's documents."""
    doc = records.withColumn("doc_id", T.safe_id_or_hash("question_id"))

    def of(keep) -> Column:
        named = F.transform("documents", lambda d, i: F.when(keep(d, i) & (T.normalize(F.get(d["paragraphs"], d["most_related_para"])) != ""), F.format_string("%s_d%02d_p%03d", F.col("doc_id"), i + 1, d["most_related_para"] + 1)))
        return F.filter(named, lambda b: b.isNotNull())

    selected = of(lambda d, i: F.coalesce(d["is_selected"], F.lit(False)))
    answered = of(lambda d, i: F.coalesce(F.array_contains("answer_docs", i), F.lit(False)))
    gold = F.when(F.size(selected) > 0, selected).otherwise(answered)
    return doc.select(F.col("doc_id").alias("query_id"), "doc_id", gold.alias("gold_block_ids"), T.compact_answer("answers").alias("answer"), (F.size("answers") == 0).alias("is_unanswerable"))


# ---- Markdown -------------------------------------------------------------------------------


def markdown_blocks(texts: DataFrame, dataset: str = "markdown", split: str = "input") -> DataFrame:
    """texts: doc_id, text. Runs of lines of one kind are blocks; found by windows, not by a walk.

    A line's kind follows from itself and the parity of code fences before it; a new run
    starts where the kind changes, at every heading, and after a blank line or a fence.
    Code keeps blank lines. A heading of level n sits under the last headings of lower levels.
    """
    lines = texts.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("i", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")))
    by = Window.partitionBy("doc_id").orderBy("i")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").startswith("```")
    lines = lines.withColumn("fences", F.count_if(fence).over(upto))
    bars = F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))
    kind = (
        F.when(fence, "fence").when(F.col("fences") % 2 == 1, "code").when(F.col("line").rlike(r"^#{1,6}\s+.+$"), "heading")
        .when(F.col("line") == "", "blank").when(bars >= 2, "table").when(F.col("line").rlike(r"^([-*+]|\d+[.)])\s+"), "list").otherwise("paragraph")
    )
    lines = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(by))
    starts = (F.col("kind") == "heading") | F.col("before").isNull() | (F.col("kind") != F.col("before"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#+)", 1)))
    title = F.when(F.col("kind") == "heading", T.normalize(F.regexp_replace("line", r"^#+\s+", "")))
    lines = lines.withColumns({"run": F.sum(F.when(starts, 1).otherwise(0)).over(upto), "level": level, "title": title})
    # The open heading of each level: the last one there, if no higher-ranking heading came after it.
    seen = {n: F.last(F.when(F.col("level") == n, F.struct("i", "title")), ignorenulls=True).over(upto) for n in range(1, 7)}
    lines = lines.withColumns({f"h{n}": c for n, c in seen.items()})
    lines = lines.withColumns({f"l{n}": F.last(F.when(F.col("level") <= n, F.col("i")), ignorenulls=True).over(upto) for n in range(1, 7)})
    path = F.array(*[F.when(F.col(f"h{n}.i") == F.col(f"l{n}"), F.col(f"h{n}.title")) for n in range(1, 7)])
    lines = lines.withColumn("path", F.filter(path, lambda t: t.isNotNull()))
    kept = lines.filter(~F.col("kind").isin("fence", "blank"))
    body = F.when(F.col("kind") == "heading", F.col("title")).when(F.col("kind") == "code", F.col("raw")).otherwise(F.col("line"))
    runs = kept.groupBy("doc_id", "run", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", body.alias("t")))), lambda x: x["t"]), "\n").alias("text"), F.first("path").alias("title_path"), F.max("level").alias("level"))
    full = runs.withColumn("text", T.normalize("text")).filter("text <> ''").withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("run")))
    found = F.regexp_extract_all("text", F.lit(r"(?U)(\b[A-Z][A-Za-z0-9_+\-]{2,}\b|[一-鿿]{2,8})"), F.lit(1))
    return _blocks(
        full.withColumns(
            {
                "block_id": F.format_string("%s_b%05d", "doc_id", "order"), "type": F.col("kind"), "level": F.coalesce("level", F.size("title_path")),
                "section_name": F.coalesce(F.when(F.size("title_path") > 0, F.element_at("title_path", -1)), F.col("doc_id")), "entity_tags": F.slice(F.array_distinct(found), 1, 12),
            }
        ), dataset, split,
    )


def flat_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of governed documents (schemas.DOCUMENT) in the flat form the chunkers read."""
    each = documents.select("doc_id", "dataset", "split", "source_doc_id", F.explode("blocks").alias("b"))
    a = F.col("b.source_anchor")
    return each.select(
        "doc_id", "dataset", "split", "source_doc_id", "b.block_id", "b.type", "b.text", "b.order", "b.level", "b.title_path",
        a["section_name"].alias("section_name"), a["asset_file"].alias("asset_file"), "b.entity_tags",
    )
