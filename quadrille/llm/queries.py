"""The thin queries over the driver's tables, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jaccard_join, licenses, lm_score, quality, spm_codec, substring_dedup, token_counts, toxicity
from .columns import fold_of

def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of("doc_id", 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold != 1)
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of("doc_id", 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", fold != 0)
    out = quality.score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.summary(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_found", "containment")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm_codec.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.join_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(), 4096)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "cut_chars")


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_toxicity, op3_ann, op4_quality, op5_substring_dedup, op6_licenses, op7_decontaminate, op8_sentencepiece, op9_jaccard_join, op10_token_counts)}


def _licenses_sql() -> str:
    every = licenses.BASE + licenses.OWN

    def words(ws: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in ws) + "]"

    parts = []
    for number, t in enumerate(every):
        n = len(t.phrase)
        share = "1.0" if n == len(t.words) else "(" + " + ".join(f"coalesce((ws[s + {j + 1}] = '{w}')::int, 0)" for j, w in enumerate(t.words)) + f") / {float(len(t.words))}"
        parts.append(f"SELECT doc_id, rn, {number} AS template, '{t.label}' AS label, s, ({share})::double AS share FROM (SELECT doc_id, rn, ws, unnest(list_filter(range(len(ws)), lambda s: ws[s + 1 : s + {n}] = {words(t.phrase)})) AS s FROM w WHERE list_contains(ws, '{t.phrase[0]}'))")
    return f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rn, count(*) FILTER (template < {len(licenses.BASE)}) AS n_base, min(s) FILTER (template < {len(licenses.BASE)}) AS first_word, max(s) FILTER (template < {len(licenses.BASE)}) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {len(licenses.BASE)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM p GROUP BY rn)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM w LEFT JOIN g USING (rn)"""


def _sets_sql(table: str, key: str, size: int, lowered: str) -> str:
    """Distinct (rn, key, sh): shingles of ``size`` words, or the whole sequence if it is shorter."""
    ahead = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, size))
    joined = " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, size))])
    return f"""
  WITH t AS (SELECT {key}, row_number() OVER () AS rn, regexp_extract_all({lowered}, '[^\\x20\\x09-\\x0D]+') AS ws FROM {table}),
  u AS (SELECT {key}, rn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t WHERE len(ws) >= {size}),
  l AS (SELECT {key}, rn, w, {ahead} FROM u WINDOW o AS (PARTITION BY rn ORDER BY i))
  SELECT DISTINCT {key}, rn, {joined} AS sh FROM l WHERE w{size - 1} IS NOT NULL
  UNION ALL SELECT {key}, rn, array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND {size - 1}"""


DECONTAMINATE_SQL = f"""
WITH ds AS ({_sets_sql("documents", "doc_id", 5, "lower(coalesce(text, ''))")}),
bs AS (SELECT item_id, rn AS bn, sh FROM ({_sets_sql("benchmark", "item_id", 5, "lower(coalesce(text, ''))")})),
n AS (SELECT bn, count(*) AS n_item FROM bs GROUP BY bn)
SELECT doc_id, item_id, n_item::bigint AS n_item, count(*)::bigint AS n_found, count(*) / n_item::double AS containment
FROM ds JOIN bs USING (sh) JOIN n USING (bn) GROUP BY doc_id, rn, item_id, bn, n_item HAVING count(*) * 5 >= n_item * 4"""

REPEATS_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT rn, unnest(ws) AS w, generate_subscripts(ws, 1) AS j, len(ws) AS n FROM t),
s AS (SELECT rn, j, n, string_agg(w, ' ') OVER (PARTITION BY rn ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS run FROM u),
d AS (SELECT rn, j FROM s WHERE j + 34 <= n QUALIFY count(*) OVER (PARTITION BY run) > 1),
c AS (SELECT DISTINCT rn, unnest(range(j, j + 35)) AS j FROM d),
k AS (SELECT rn, count(*) AS kept, string_agg(w, ' ' ORDER BY j) AS text FROM u ANTI JOIN c USING (rn, j) GROUP BY rn)
SELECT doc_id, len(ws)::bigint AS n_words, (len(ws) - coalesce(kept, 0))::bigint AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM t LEFT JOIN k USING (rn)"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""
WITH RECURSIVE ds AS MATERIALIZED ({_sets_sql("documents", "doc_id", 4, _LOWERED)}),
n AS MATERIALIZED (SELECT rn, doc_id, count(*) AS n FROM ds GROUP BY ALL),
m AS (SELECT a.rn AS x, b.rn AS y, count(*) AS m FROM ds a JOIN ds b USING (sh) GROUP BY ALL),
p AS MATERIALIZED (SELECT x, y FROM m JOIN n a ON a.rn = x JOIN n b ON b.rn = y WHERE 100 * m >= 85 * (a.n + b.n - m)),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
k AS (SELECT x, min(doc_id) AS component_id FROM r JOIN n ON n.rn = y GROUP BY x),
d AS (SELECT doc_id, row_number() OVER () AS rn FROM documents)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, coalesce(component_id, d.doc_id)::bigint AS component_id FROM d LEFT JOIN n USING (rn) LEFT JOIN k ON k.x = d.rn"""

SQL = {"op9_jaccard_join": JACCARD_SQL, "op5_substring_dedup": REPEATS_SQL, "op6_licenses": _licenses_sql(), "op7_decontaminate": DECONTAMINATE_SQL}
