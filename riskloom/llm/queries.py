"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.common import ready

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.packing import pack

    placed = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@register(
    "op5_mixing",
    r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size::DOUBLE) OVER () AS total,
         sum(3.0::DOUBLE * source_size) OVER w + 3.0::DOUBLE * source_size / weight * (sum(weight) OVER () - sum(weight) OVER w) AS poured
  FROM sources
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, (total - sum(CASE WHEN poured <= total THEN cap ELSE 0 END) OVER ())
            / nullif(sum(CASE WHEN poured <= total THEN 0 ELSE weight END) OVER (), 0) AS level
  FROM filling),
targets AS (
  SELECT source, source_size, CASE WHEN poured <= total THEN cap ELSE level * weight END AS target FROM levels),
rates AS (
  SELECT doc_id, size, draw, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rates""",
)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.mixing import mix_plan

    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.tokencount import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@register("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.neardup import near_duplicates, placed_members

    members, nodes = near_duplicates(table(spark, sf_dir, "documents"))
    blank = members.where("node is null").withColumns({"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    placed = placed_members(members, nodes)
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return placed.unionByName(blank).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.toxicity import fit_field, in_training, toxicity, training_sample

    docs = table(spark, sf_dir, "documents")
    field = fit_field(training_sample(docs, table(spark, sf_dir, "labels"), in_training(F.col("label_id"))))
    scored = toxicity(docs.select("doc_id", "text"), field)
    return scored.select(
        "doc.doc_id",
        F.coalesce(~in_training(F.col("doc.doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.quality import quality_rules, ratio_table

    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    judged = quality_rules(docs.select("doc_id", "text"), ratio_table(docs, trusted))
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"
    )


#: Fixed values of the query: verdict, host and path of each rule.
URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


@register("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.urlfilter import filter_urls, parse_rule

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = filter_urls(pages, [parse_rule(line) for line in URL_RULES])
    return judged.select("page.page_id", "host", "path", "rule", "verdict", "block_score")


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.pii import pseudonymised

    changed = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key="example key")
    return changed.select("doc.doc_id", F.col("new_text").alias("text"), "n_replaced")


@register(
    "op2_top_k",
    """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
)
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.topk import exact_top_k, whole_vectors

    vectors = table(spark, sf_dir, "embeddings")
    whole = whole_vectors(vectors, "vec_id", F.col("embedding")).select("id", F.transform("v", lambda x: F.floor(64 * x.cast("double"))).alias("v"))
    return exact_top_k(whole, whole.where("id % 20 = 0"), 20)


@register("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.htmltext import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@register(
    "op11_prefix_trie",
    """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || coalesce(text, ''))) - 1 AS "at",
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
               lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 1, 2, 3, 4, 5, 6, 7],
                 lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, o."at", role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o."at" < c.h
  UNION ALL
  SELECT c.conv_id, 1 AS part, o."at", role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o."at" >= c.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, "at") AS d, role, text FROM rebuilt),
paths AS (
  SELECT conv_id, 0::BIGINT AS d, 0::BIGINT AS bytes, '' AS node FROM convs
  UNION ALL
  SELECT conv_id, d, strlen(text)::BIGINT AS bytes,
         md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node FROM turns),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY node, d),
tree AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.node AS parent
  FROM nodes n LEFT JOIN paths h ON h.conv_id = n.conv_id AND h.d = n.d - 1 LEFT JOIN nodes p ON p.node = h.node AND p.d = h.d),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY parent, d),
sums AS (
  SELECT h.node, h.d, sum((u.n_convs - 1) * u.bytes)::BIGINT AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes u LEFT JOIN children c USING (node, d) JOIN paths h ON h.conv_id = u.conv_id AND h.d <= u.d GROUP BY h.node, h.d),
ends AS (
  SELECT node, d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY node, d)
SELECT t.conv_id, t.d AS depth, t.parent_conv_id, t.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves,
       s.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tree t LEFT JOIN children c USING (node, d) JOIN sums s USING (node, d) LEFT JOIN ends e USING (node, d)""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.prefixtrie import numbered_turns, prefix_trie, with_shared_heads

    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    turns, convs = with_shared_heads(numbered_turns(table(spark, sf_dir, "conversations")), family=5, most=8, head=head)
    return prefix_trie(turns, convs)


@register(
    "op12_ngram_join",
    r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM worded),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (
  SELECT x AS doc_id, y AS other FROM links
  UNION
  SELECT reached.doc_id, links.y FROM reached JOIN links ON links.x = reached.other),
least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least(doc_id, other), doc_id) AS component_id
FROM sets LEFT JOIN least USING (doc_id)""",
)
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.ngramjoin import class_of_documents, ngram_join

    members, classes, _links = ngram_join(table(spark, sf_dir, "documents"))
    return class_of_documents(members, classes)


@register(
    "op13_hard_negatives",
    """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.hardneg import hard_negatives, scaled, whole_labelled

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = whole_labelled(vectors, F.col("vec_id"), label, F.col("embedding")).withColumn("v", scaled(F.col("v"), 256))
    return hard_negatives(whole, F.col("id") % 100 == 0)


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
