"""Queries of question answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspan.functions.providers import DigestChat
from litspan.operators import qa as Q
from litspan.plans.registering import ORACLES, query
from litspan.sources.tables import literal, table

ASKED = "('How many references are there?'), ('what is reference 12?'), ('Citation number 7'), ('show me reference 4'), ('reference 12345'), ('last citation number?'), ('Explain the Methodology'), ('which findings'), ('works cited?'), ('the dataset and the method'), ('total citations')"
BOTH = f"(SELECT text, lower(trim(text)) AS q FROM (SELECT text FROM conversations UNION ALL VALUES {ASKED}))"
ANY = lambda words: " OR ".join(f"contains(q, '{w}')" for w in words)


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("text").union(literal(spark, "text", ASKED))


@query(f"SELECT text, CASE WHEN {ANY(Q.REFERENCE_WORDS)} THEN 'references' ELSE 'specific' END AS label FROM {BOTH}")
def question_router(spark, sf_dir):
    """A question's label without a model."""
    return _asked(spark, sf_dir).select("text", Q.question_label(F.col("text")).alias("label"))


@query(f"SELECT text, (contains(q, 'how many') AND (contains(q, 'reference') OR contains(q, 'citation'))) OR {ANY(Q.COUNT_PHRASES)} AS asks_count, {ANY(Q.LAST_PHRASES)} AS asks_last FROM {BOTH}")
def ref_question_flags(spark, sf_dir):
    """questions on the number of references."""
    return _asked(spark, sf_dir).select("text", Q.asks_count(F.col("text")).alias("asks_count"), Q.asks_last(F.col("text")).alias("asks_last"))


@query(rf"SELECT text, TRY_CAST(nullif(regexp_extract(q, '\b(?:reference|citation)\s*(?:number\s*)?([0-9]{{1,4}})\b', 1), '') AS INT) AS number FROM {BOTH}")
def ref_number_extract(spark, sf_dir):
    """The reference a question asks for."""
    return _asked(spark, sf_dir).select("text", Q.asked_number(F.col("text")).alias("number"))


@query(f"SELECT text, CASE {' '.join(f'''WHEN contains(q, '{a}') THEN '{b}' ''' for a, b in Q.TRIGGERS)} END AS section FROM {BOTH}")
def section_trigger(spark, sf_dir):
    """the section named by a question's words."""
    return _asked(spark, sf_dir).select("text", Q.trigger_section(F.col("text")).alias("section"))


KINDS = ["what is the main idea", "list the references", "explain part three", "how many references are there?", "show me reference 99", "give an outline", "last citation number?", ""]
PAPERS = """SELECT label AS paper_id, 'Paper ' || label AS title, CASE WHEN label = 8 THEN 'processing' WHEN label = 9 THEN NULL ELSE 'ready' END AS status, label % 3 AS has_tree, count(*)::INT AS reference_count,
    CASE WHEN label % 2 = 0 THEN (label + 20)::INT END AS last_reference_number FROM embeddings GROUP BY label"""
COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(rf"""WITH asked AS (SELECT vec_id AS question_id, label AS paper_id, ([{', '.join(repr(k) for k in KINDS)}])[CAST(vec_id // 20 % {len(KINDS)} AS INT) + 1] AS question, embedding FROM embeddings WHERE vec_id % 20 = 0),
    papers AS ({PAPERS}), paired AS (SELECT *, lower(trim(question)) AS q FROM asked LEFT JOIN papers USING (paper_id)),
    labelled AS (SELECT *, CASE WHEN {ANY(Q.REFERENCE_WORDS)} THEN 'references' WHEN contains(q, 'outline') AND has_tree <> 0 THEN 'outline' WHEN contains(q, 'outline') THEN 'structural' ELSE 'specific' END AS label,
        CASE WHEN paper_id = 3 AND contains(q, 'part') THEN 'Part three' WHEN contains(q, 'part three') THEN NULL END AS part FROM paired),
    told AS (SELECT *, CASE WHEN question = '' THEN '{Q.NO_QUESTION}' WHEN status = 'processing' THEN '{Q.PROCESSING}' WHEN status IS NULL THEN '{Q.NOT_INGESTED.replace("'", "''")}'
        WHEN label = 'outline' THEN '- Intro  (page 1)' || chr(10) || '  - Aim  (page 2)' WHEN label = 'references' AND contains(q, 'how many') THEN 'There are ' || reference_count || ' references in the paper.'
        END AS stored FROM labelled),
    hits AS (SELECT t.question_id, t.label, t.part, e.vec_id AS chunk_index, d.text, {COS.replace('q.', 't.')} AS score, row_number() OVER (PARTITION BY t.question_id ORDER BY {COS.replace('q.', 't.')} DESC, e.vec_id) AS r,
        row_number() OVER (PARTITION BY t.question_id ORDER BY e.vec_id DESC) AS from_end FROM told t JOIN embeddings e ON e.label = t.paper_id JOIN documents d ON d.doc_id = e.vec_id WHERE t.stored IS NULL),
    taken AS (SELECT *, CASE WHEN part IS NOT NULL THEN 'section' ELSE label END AS mode FROM hits WHERE part IS NOT NULL OR r <= CASE label WHEN 'specific' THEN 12 WHEN 'structural' THEN 50 ELSE 80 END OR (label = 'references' AND from_end <= 30)),
    ordered AS (SELECT *, CASE WHEN mode = 'specific' THEN -score ELSE chunk_index END AS place, CASE mode WHEN 'specific' THEN 12000 WHEN 'structural' THEN 20000 WHEN 'references' THEN 40000 ELSE 80000 END AS budget FROM taken WHERE length(text) > 0),
    summed AS (SELECT *, sum(length(text)) OVER (PARTITION BY question_id ORDER BY place, chunk_index) AS cum FROM ordered),
    packed AS (SELECT question_id, place, chunk_index, CASE WHEN cum <= budget THEN text ELSE text[:CAST(budget - cum + length(text) AS INT)] END AS part_text FROM summed
        WHERE cum <= budget OR (cum - length(text) <= budget AND budget - cum + length(text) > 200)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place, chunk_index) AS k FROM packed),
    joined AS (SELECT question_id, count(*)::INT AS n, string_agg(part_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) FILTER (k <= 3) AS best FROM numbered GROUP BY question_id)
    SELECT t.question_id, t.label, t.part AS section, CASE WHEN stored IS NOT NULL THEN 'stored' WHEN part IS NOT NULL THEN 'section' ELSE t.label END AS mode, coalesce(n, -1) AS n_excerpts,
        md5(coalesce(stored, '{Q.NO_MODEL[:-2]}' || chr(10) || chr(10) || best, '{Q.NO_CONTENT}')) AS answer_md5 FROM (SELECT *, CASE WHEN stored IS NULL THEN part END AS kept FROM told) t LEFT JOIN joined USING (question_id)""".replace("t.part AS section", "t.kept AS section"))
def qa_answers(spark, sf_dir):
    """A question for every twentieth vector, answered from its paper's status, outline and references, or with excerpts."""
    return _answers(spark, sf_dir)


PROMPT = f"""CASE WHEN title <> '' THEN 'Paper: ' || title || chr(10) || chr(10) ELSE '' END || 'Excerpts from the paper:' || chr(10) || chr(10) || best || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || question"""


@query(ORACLES["qa_answers"].replace(" FILTER (k <= 3) AS best", " AS best").replace(f"'{Q.NO_MODEL[:-2]}' || chr(10) || chr(10) || best", f"'Digest ' || md5({PROMPT}) || ' of ' || length({PROMPT}) || ' characters'"))
def qa_answers_model(spark, sf_dir):
    """The same questions with a model, asked with title, excerpts and question; the stand-in tells the digest of its prompt."""
    return _answers(spark, sf_dir, DigestChat)


def _answers(spark, sf_dir, chat=None):
    vectors = table(spark, sf_dir, "embeddings")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_index"), "text", F.length("text").alias("text_length"))
    chunks = vectors.select(F.col("vec_id").alias("chunk_index"), F.col("label").alias("paper_id"), "embedding", F.concat(F.lit("Part three of "), F.col("label").cast("string")).alias("section_heading")).join(texts, "chunk_index")
    asked = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.floor(F.col("vec_id") / 20) % len(KINDS)).cast("int"))
    questions = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question_id"), F.col("label").alias("paper_id"), asked.alias("question"), F.col("embedding").alias("vector"))
    questions = questions.withColumn("given", F.when(F.contains("question", F.lit("outline")), " Outline.").otherwise("?"))
    label = F.col("label")
    tree = F.from_json(F.lit('[{"level": 1, "text": "Intro", "page": 1}, {"level": 3, "text": "Deep", "page": 1}, {"level": 2, "text": "Aim", "page": 2}]'), "array<struct<level:int,text:string,page:int>>")
    papers = vectors.groupBy("label").agg(F.count("*").cast("int").alias("reference_count")).select(
        label.alias("paper_id"), F.concat(F.lit("Paper "), label.cast("string")).alias("title"), F.when(label == 8, "processing").when(label != 9, "ready").alias("status"), F.when(label % 3 != 0, tree).alias("tree"), "reference_count",
        F.when(label % 2 == 0, label.cast("int") + 20).alias("last_reference_number"), F.lit("").alias("reference_heading"), F.lit(0).alias("reference_start_page"), F.lit(0).alias("reference_end_page"),
    )
    headings = literal(spark, "paper_id, pos, heading", "(3, 0, 'III. Part three')")
    found = Q.answer_batch(questions, chunks, headings, papers, model="given", chat=chat)
    return found.select("question_id", "label", "section", "mode", F.coalesce(F.size("excerpts"), F.lit(-1)).alias("n_excerpts"), F.md5("answer").alias("answer_md5"))
