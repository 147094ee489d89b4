"""Registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import ball_simhash, chat, decontaminate, importance, langid, licenses, near_vectors, pieces, pii, quality_rules, spelling, toxicity, turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_simhash_ball")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_language_codes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.remainder("doc_id", 4)
    coder = langid.train(docs.where(fold != 2))
    found = langid.predict(docs, coder)
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op3_benchmark_windows")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_gumbel_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load_lexicon())


@query("op1_weak_labels_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query(
    "op2_collision_vectors",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    fine AS (
        SELECT vec_id, label, e FROM v
        WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0
    ),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
    ),
    reach(node, seen) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION
        SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.node
    ),
    parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
    FROM embeddings e JOIN parts p ON p.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_importance_resampling")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    # The share of good texts among the labelled ones is what is drawn.
    share = labels.agg(F.avg("quality")).first()[0]
    return importance.resample(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"), share=share or 0.0)


def _chat_sql() -> str:
    """The template once more, written out."""
    controls = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[NAME]"]

    def esc(x: str) -> str:
        out = f"replace({x}, '\\', '\\e')"
        for letter, control in zip("ABCDEFGHI", controls):
            out = f"replace({out}, '{control}', '\\{letter}')"
        return out

    return f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ),
    m AS (
        SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM t
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
        CAST(sum(length({esc("text")}) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
            ELSE 23 + length({esc("role")}) END) AS BIGINT) AS formatted_chars,
        bool_and(CASE
            WHEN prev IS NULL THEN role IN ('system', 'user')
            WHEN prev = 'system' OR prev = 'assistant' THEN role = 'user'
            WHEN prev = 'user' THEN role = 'assistant'
            ELSE false END) AND NOT bool_or(next IS NULL AND role = 'system') AS valid
    FROM m GROUP BY conv_id
    """


@query("op6_chat_machine", _chat_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.segments(turns))


@query("op7_license_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op9_string_kernel_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(langid.remainder("doc_id", 5) != 0).select("doc_id", "toxic")
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (langid.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op11_quality_list")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts are read once: what follows needs their counts only.
    stats = checkpointed(quality_rules.statistics(table(spark, sf_dir, "documents")))
    found = quality_rules.judge(stats, quality_rules.train(stats, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op13_turn_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.report(turns, turn_repair.damaged(turns))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), damage=199))
